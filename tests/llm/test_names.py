import numpy as np
import pytest

from graphloom.llm import names
from graphloom.llm.spelling import Vocabulary, canon, core_gap, distance, fit, near_keys, read_name, rest_keys, rests_agree, unite

#: word -> share of persons among the names it stands in
VOCABULARY = Vocabulary({canon(w): 0.0 for w in ("bank", "society", "savings", "университет", "банк", "shipping", "company")})
BARE = Vocabulary({})


@pytest.mark.parametrize("vocabulary", [VOCABULARY, BARE])
@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Patricia D. Lenemubiv", "Lenemubiv P.D.", True),
        ("Patricia D. Lenemubiv", "Lenemubiv PD", True),
        ("Bob Buzheskeshuv", "Robert Charles Buzheskeshuv", True),
        ("Upper Vuvachunir", "upper вувачунир", True),
        ("Upper Vuvachunir", "Upper Vuva chunir", True),
        ("Vusapifev H.S.", "Vusapifev Historical Society", True),
        ("Vusapifev H.S.", "Vusapifev Historcal Society", True),
        ("Грапредаговский банк", "ОАО Грапредаговский б-к", True),
        ("Общество с ограниченной ответственностью Гомакумский университет", "Гомакумский ун-т", True),
        ("ООО Гомакумский университет", "Гомакумский университет", True),
        ("Gwendolyn Zishefur", "G. Zishefur", True),
        ("Gwendolyn Zishefur", "Zishefur, Gwendolyn", True),
        ("Zishefur Brewery", "Brewery Zishefur", True),
        ("Zishefur Savings Bank", "Bank Savings Zishefur", True),
        ("Zuck Zorafosev", "Zorafosev Z.E.", True),
        ("Chuck Zorafosev", "Zorafosev C.E.", True),
        ("Patricia Lenemubiv", "Peter Lenemubiv", False),
        ("Upper Vuvachunir", "Vuvachunir", False),
        ("Lochakrustos Glass and Ceramics", "Lochakrustos Savings Bank", False),
        ("Patricia Lenemubiv", "Lenemubiv Savings Bank", False),
        ("Gwendolyn Zishefur", "Natalia Zishefur", False),
        ("Gwendolyn Zishefur", "Gwendolyn Brotchev", False),
        ("Zishefur Brewery", "Zishefur", False),
    ],
)
def test_readings(vocabulary, a, b, same):
    assert (fit(read_name(a, vocabulary), read_name(b, vocabulary)) is not None) == same


def test_types_tell_persons_from_things():
    person, thing = read_name("M. Zishefur", BARE, ["PERSON"]), read_name("M. Zishefur", BARE, ["CITY"])
    assert fit(person, thing) is None and fit(person, read_name("Mary Zishefur", BARE)) is not None
    assert fit(read_name("г. Зишефур", BARE), read_name("Зишефур", BARE, ["CITY"])) is not None


def test_united_profiles_say_more_than_their_parts():
    plain, initials, cousin = (read_name(n, BARE, ["PERSON"]) for n in ("Nicholas Zuniprogral", "N. P. Zuniprogral", "Nicholas R. Zuniprogral"))
    assert fit(plain, cousin) and fit(plain, initials) and not fit(initials, cousin)
    both = unite(plain, initials)
    assert [a.rest for a in both] == [("nichola" + "s", "p")] or [len(a.rest) for a in both] == [2]
    assert fit(both, cousin) is None


def test_rests_that_agree_share_a_key():
    words = [read_name(f"{g} Zuniprogral", BARE, ["PERSON"])[0].rest for g in "Chuck Charles C. Hcarles Xharles harles Liz Elizabeth E. Iurii Yuri J. James Jim".split()]
    for a in words:
        for b in words:
            if rests_agree(a, True, b, True):
                assert rest_keys(a) & rest_keys(b), (a, b)


def test_distance_is_bounded_and_knows_swaps():
    assert distance("abcd", "abdc", 2) == 1 and distance("abcdef", "uvwxyz", 2) == 3 and distance("", "ab", 2) == 2


def people(spark, entities, relations):
    e = spark.createDataFrame(entities, "id string, entity_name string, entity_type string, name string, key string")
    r = spark.createDataFrame(relations, "subject_id string, subject_name string, object_id string, object_name string, kind string")
    return e, r


def groups(spark, entities, relations):
    out = {}
    for r in names.entities_of_names(*people(spark, entities, relations)).collect():
        out.setdefault(r["entity"], set()).add(r["name"])
    return sorted(map(sorted, out.values()))


def test_merge_and_rematch(spark):
    e = [
        ("e1", "Nicholas Zuniprogral", "PERSON", None, None),
        ("e2", "Zuniprogral, Nicholas P.", "PERSON", None, None),
        ("e3", "Natalia Zuniprogral", "PERSON", None, None),
        ("e4", "Zuniprogral Savings Bank", "ORGANIZATION", None, None),
        ("e5", None, "PERSON", None, None),
        ("e6", "  ", None, None, None),
        (None, "NICHOLAS  ZUNIPROGRAL", None, None, None),
        ("e1", "Nicholas Zuniprogral", "PERSON", None, None),
    ]
    # "N. P." fits Nicholas and not Natalia only once Nicholas has his second initial; the bare initial fits both cousins
    r = [("e9", "N. P. Zuniprogral", None, None, "x"), ("e8", "N. Zuniprogral", "e4", "Zuniprogral S.B.", "x")]
    got = groups(spark, e, r)
    together = next(g for g in got if "Nicholas Zuniprogral" in g)
    assert together == ["N. P. Zuniprogral", "NICHOLAS  ZUNIPROGRAL", "Nicholas Zuniprogral", "Zuniprogral, Nicholas P."]
    assert ["Natalia Zuniprogral"] in got and ["N. Zuniprogral"] in got
    assert ["Zuniprogral S.B.", "Zuniprogral Savings Bank"] in got


def test_record_ids_are_no_proof(spark):
    e = [("e1", "Completely Different", "PERSON", None, None), ("e1", "Another Spelling", "PERSON", None, None)]
    assert groups(spark, e, []) == [["Another Spelling"], ["Completely Different"]]


def test_variant_pairs_have_the_smaller_name_first(spark):
    e = [("e1", n, "PERSON", None, None) for n in ("Nicholas Zuniprogral", "zuniprogral nicholas", "Zuniprogral, N.")]
    pairs = names.variant_pairs(names.entities_of_names(*people(spark, e, []))).collect()
    assert sorted(tuple(p) for p in pairs) == [
        ("Nicholas Zuniprogral", "Zuniprogral, N."), ("Nicholas Zuniprogral", "zuniprogral nicholas"), ("Zuniprogral, N.", "zuniprogral nicholas"),
    ]


def test_parts_of_blocks_change_nothing(spark, monkeypatch):
    # a hot family name: half of all spellings, more than a part of a block holds
    given = ["Nicholas", "Natalia", "Peter", "Walter", "Rebecca", "Gregory"]
    e = [(None, f"{g} {m}. Zuniprogral", "PERSON", None, None) for g in given for m in "ABCDEF"]
    e += [(None, f"Zuniprogral, {g} {m}.", None, None, None) for g in given for m in "ABCDEF"]
    whole = groups(spark, e, [])
    assert len(whole) == len(given) * 6 and all(len(g) == 2 for g in whole)
    monkeypatch.setattr(names, "TILE", 3)
    assert groups(spark, e, []) == whole


def test_no_names(spark):
    assert groups(spark, [], []) == []
    assert groups(spark, [(None, "...", None, None, None), (None, "", None, None, None)], [(None, None, None, None, None)]) == []


def test_long_and_odd_names(spark):
    long = "Zuniprogral " + "x" * 5000
    got = groups(spark, [(None, long, None, None, None), (None, "12", None, None, None), (None, "Q", None, None, None), (None, "ООО", None, None, None)], [])
    assert sorted(n for g in got for n in g) == sorted([long, "12", "Q", "ООО"])


def test_two_errors_at_different_places_meet(spark):
    # two letters replaced, put in or left out, far apart: no key with one letter deleted is shared
    for other in ("Zumiprogtal", "Zunixprogdral", "Zniprogrl"):
        a, b = (read_name(f"Nicholas {x}", VOCABULARY)[0].cores[0] for x in ("Zuniprogral", other))
        assert core_gap(a, b) == 2 and near_keys(a) & near_keys(b)
    e = [("e1", "Nicholas Zuniprogral", "PERSON", None, None), ("e2", "Nicholas Zumiprogtal", "PERSON", None, None)]
    assert groups(spark, e, []) == [["Nicholas Zumiprogtal", "Nicholas Zuniprogral"]]


def test_near_pairs_are_those_of_the_full_comparison(spark):
    rng = np.random.default_rng(5)
    cores = {"".join(rng.choice(list("abc"), rng.integers(3, 9))) for _ in range(150)} | {"zuniprogral", "zumiprogtal"}
    found = {tuple(r) for r in names.near_pairs(spark.createDataFrame([(c,) for c in sorted(cores)], "core string")).collect()}
    assert found == {(a, b) for a in cores for b in cores if a < b and core_gap(a, b) <= 2}
