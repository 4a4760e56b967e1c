import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import abuse, leakage, mixing, repetition, splitter

TOKENS = mixing.TOKENIZER


# repetition


def slow_share(words, run=6):
    seen, hit = {}, set()
    for i in range(len(words) - run + 1):
        g = tuple(words[i : i + run])
        if g in seen:
            hit |= set(range(i, i + run))
        seen[g] = i
    return len(hit) / len(words) if words else 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_share_against_brute_force(words):
    assert abs(repetition.repeated_share(words) - slow_share(words)) < 1e-12


def test_repetition_cases(spark):
    line = "the same old sentence comes again and again here. "
    rng = random.Random(1)
    normal = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(2, 6) for _ in range(40)) + "." for _ in range(60)]
    texts = [line * 6, line + "something quite new and different follows in this text.", None, "", "!!!", "word " * 5000] + normal + [line * 6]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "rec_no long, text string, share string")
    scored = repetition.score_repetition(rows.select("rec_no", "text"), ["rec_no"], "text")
    assert scored.count() == len(texts)
    assert {r["rec_no"] for r in repetition.repetitive(scored).collect()} == {0, 5, len(texts) - 1}
    assert scored.filter("rec_no in (2, 3, 4) and share = 0").count() == 3
    assert repetition.score_repetition(rows.limit(0).select("rec_no", "text"), ["rec_no"], "text").count() == 0


def test_estimation_trusts_the_majority():
    yes, no = repetition._encode([1] * 6), repetition._encode([-1] * 6)
    mixed = repetition._encode([1, 1, 1, 0, -1, 0])
    p = repetition.estimate({yes: 10, no: 90, mixed: 3})
    assert p[yes] > 0.99 and p[no] < 0.01 and p[mixed] > 0.5
    assert repetition.estimate({}) == {}


# splitting


def holds(text, limits):
    cut = splitter.pieces(text, limits)
    assert "".join(text[c:e] for _, c, e in cut) == text or not text.strip()
    for s, c, e in cut:
        assert s <= c < e and e - s <= limits.max_chars and len(text[s:e].split()) <= limits.max_tokens
        assert c - s <= limits.overlap
    return cut


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n,ж", min_size=150, max_size=600))
def test_pieces_keep_limits_and_lose_nothing(text):
    holds(text, splitter.Limits(max_chars=60, max_tokens=12, overlap=10, every=16, reach=8))


def test_long_texts_of_every_shape():
    limits = splitter.Limits()
    for text in ("x" * 9000, "a " * 1000, " " * 3000, "слово. " * 2000, "\n\n".join(["y" * 700] * 9), "z" * 1401):
        holds(text, limits)


def test_an_edit_moves_only_near_pieces():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", "."]) for _ in range(3000))
    edited = text[:9000] + " inserted words " + text[9000:]
    a, b = ({t[c:e] for _, c, e in splitter.pieces(t)} for t in (text, edited))
    assert len(a & b) >= len(a) - 4


def test_split_rows(spark):
    long = "Sentence number one is here. " * 100
    rows = [(1, "c1", long, 3, "d", 5, "x"), (2, "c2", "short", 0, "d", None, "x"), (3, "c3", None, 0, None, 0, "x"), (4, "c4", "", None, None, 0, "x"), (5, "c1", long, None, None, None, "x")]
    df = spark.createDataFrame(rows, "rec_no long, id string, content string, chunk_order_idx int, doc_id string, num_tokens int, start_char string")
    got = splitter.split_oversized(df)
    assert {r["rec_no"] for r in got.collect()} == {1, 5}
    one = got.filter("rec_no = 1").orderBy("chunk_order_idx").collect()
    assert [r["chunk_order_idx"] for r in one] == list(range(len(one)))
    assert "".join(r["content"][r["overlap_chars"] :] for r in one) == long
    assert all(r["num_tokens"] == len(r["content"].split()) for r in one)
    everything = splitter.resplit(df)
    assert {r["rec_no"] for r in everything.collect()} == {1, 2, 3, 4, 5}
    assert splitter.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitter.Limits(overlap=2000)


# leakage


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def test_leaks(spark):
    item, other = words(60, 1), words(50, 2)
    filler = " ".join(words(400, 3))
    changed = [w if i % 7 else "changed" for i, w in enumerate(item)]
    docs = [
        (1, f"{filler} {' '.join(item).upper()} {filler}"),
        (2, f"{filler} <b>{'</b> ** '.join(changed)} {filler}"),
        (3, f"{filler} {' '.join(item[:36])}"),
        (4, f"{filler} {' '.join(item[:15])} {filler}"),
        (5, f"{' '.join(item[:16])} {filler} {' '.join(item[40:56])}"),
        (6, None),
        (7, ""),
        (8, " ".join(reversed(item))),
        (1, f"{filler} {' '.join(item).upper()} {filler}"),
        (9, "tiny item"),
    ]
    items = [(10, " ".join(item)), (11, " ".join(item)), (12, " ".join(other)), (13, None), (14, ""), (15, "Tiny, item!")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(k, t, "en") for k, t in items], "item_id long, text string, lang string")
    want = {(n, k) for n in (1, 2, 3) for k in (10, 11)} | {(9, 15)}
    got = leakage.leaks(d, i)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert got.filter("doc_id = 1").count() == 4
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i, max_grams=200).collect()} == want
    assert {r["doc_id"] for r in leakage.remove_leaks(d, got).collect()} == {4, 5, 6, 7, 8}
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("every", [3, 4, 5, 6, 7])
@pytest.mark.parametrize("how", ["changed", "missing"])
@pytest.mark.parametrize("share", [0.55, 1.0])
def test_leaks_survive_regular_changes(every, how, share):
    item = words(40, 8)
    index = leakage.Index([(1, item)], 0.5)
    kept = item[: round(share * len(item)) + (every if share < 1 else 0)]
    part = [w if i % every else ("other" if how == "changed" else None) for i, w in enumerate(kept)]
    text = " ".join([*words(200, 9), *(w for w in part if w), *words(200, 10)])
    assert [(n, i) for n, i, _ in index.leaks(["nothing here", text, ""])] == [(1, 1)]


def test_short_items_leak_by_half_their_words_together():
    items = [(1, ["alpha", "beta", "gamma", "delta"]), (2, ["one"]), (3, ["red", "green"]), (4, ["x1", "x2", "x3", "x4", "x5", "x6"])]
    index = leakage.Index(items, 0.5)
    texts = ["the alpha beta gamma lies", "one", "red and green", "red green", "alpha far from any gamma but beta", "x2 x9 x4 x5", "x1 y x3 y y x6", "zeta"]
    # "x1 y x3" is half of the item with a single word changed
    assert {(n, i) for n, i, _ in index.leaks(texts)} == {(0, 1), (1, 2), (3, 3), (5, 4), (6, 4)}


# mixing


def test_pivotal_keeps_the_mass_and_the_chances():
    rng = np.random.default_rng(5)
    w = rng.integers(1, 50, 200).astype(float)
    p = rng.random(200)
    mean = np.zeros(200)
    for _ in range(400):
        out = mixing.pivotal(p, w, rng)
        assert ((out < 1e-9) | (out > 1 - 1e-9)).sum() >= 199
        assert abs((out * w).sum() - (p * w).sum()) < 1e-6
        mean += out / 400
    assert np.abs(mean - p).max() < 0.13


def test_mixture_meets_its_shares(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng.randint(5, 60), i)), rng.choice(["a", "a", "a", " A", "b", "c"]), "x") for i in range(700)]
    rows += [(9001, None, "a", "x"), (9002, "", "b", "x"), (9003, "text", None, "x"), (9004, "text", "unlisted", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    m = spark.createDataFrame([("a", 0.5, 1), ("B ", 0.3, 2), ("c", 0.1, 3), ("none", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(d, m, TOKENS, bucket=40, fan=3)
    report = {r["source"]: r for r in mixing.share_report(mixed, m).collect()}
    assert set(report) == {"a", "b", "c", "none"} and report["none"]["actual_share"] == 0
    largest = max(r["tokens"] for r in mixed.collect())
    used = sum(r["tokens"] for r in report.values())
    for s, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(report[s]["tokens"] - share * used) <= 4 * largest
        assert report[s]["most_copies"] <= report[s]["max_repeats"]
    assert {tuple(r) for r in mixed.collect()} == {tuple(r) for r in mixing.mixture(d, m, TOKENS, bucket=40, fan=3).collect()}
    assert mixing.mixture(d.limit(0), m, TOKENS).count() == 0 and mixing.mixture(d, m.limit(0), TOKENS).count() == 0


def test_tokens_are_those_of_the_tokenizer(spark):
    texts = ["Hello world", "Привет, мир", None, "", "a" * 5000]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    encode = mixing._encoding(TOKENS).encode_ordinary
    got = {r["doc_id"]: r["tokens"] for r in mixing.count_tokens(d, ["doc_id"], tokenizer=TOKENS).collect()}
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}


# content


RUDE = ["go away you utter blockhead", "nobody likes you wretched worm", "you people are vermin and should leave"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = ". ".join(" ".join(words(9, rng.random())) for _ in range(4))
        bad = i % 3 == 0
        if bad:
            rude = rng.choice(RUDE)
            if i % 2:
                rude = rude.replace("o", "0").replace("e", "е").replace("w", "w​")
            text = f"{text}. {rude}. {text[::-1]}"
        out.append((i, text, bad))
    return out


def test_disguise_is_folded():
    plain = abuse.fold(["go away you utter blockhead"])[0]
    for other in ("GO AWAY, you utter bl0ckhead!!", "g o   a w a y you uttter bloсkhеad", "go away you u​tter blockhead"):
        folded = abuse.fold([other])[0]
        assert folded[folded > 0].tolist() == plain[plain > 0].tolist()


def test_compatibility_letters_are_resolved():
    plain = abuse.fold(["go away"])[0]
    for other in ("".join(chr(0x1D400 + ord(c) - 65) if c.isalpha() else c for c in "GO AWAY"), "ＧＯ　ＡＷＡＹ", "ⓖⓞ ⓐⓦⓐⓨ"):
        assert abuse.fold([other])[0].tolist() == plain.tolist()


def test_too_few_bad_labels_abstain(spark):
    rows = corpus(80, 3)
    d = spark.createDataFrame([(i, t, "a") for i, t, _ in rows], "doc_id long, text string, source string")
    v = spark.createDataFrame([(i, "abusive" if bad else "clean") for i, _, bad in rows], "doc_id long, verdict string")
    assert sum(bad for _, _, bad in rows) < abuse.MIN_BAD and abuse.fit(d, v) is None
    rates = abuse.source_rates(abuse.score_abuse(d, None)).first()
    assert rates["documents"] == 80 and rates["flagged"] is None and rates["rate"] is None


def test_the_threshold_lies_amid_the_equally_good_cuts():
    scores, bad = np.array([3.0, 2.9, 2.8, 0.0, -1.0, -1.1]), np.array([True, True, True, False, False, False])
    assert abuse._threshold(scores, bad) == 1.4
    assert abuse._threshold(np.array([1.0]), np.array([True])) == 0.5


def test_scores_find_held_out_abuse(spark):
    rows = corpus(360, 1)
    d = spark.createDataFrame([(i, t, " News", 0.0) for i, t, _ in rows] + [(9000, None, None, 0.0), (9001, "", "b", 0.0), (9002, "123", "b", 0.0), (9003, rows[0][1], "b", 0.0)], "doc_id long, text string, source string, score double")
    reviewed = [(i, " Abusive" if bad else "CLEAN", "r") for i, _, bad in rows if i < 240] + [(7, None, "r"), (8, "odd", "r"), (9, "clean", "r"), (9, "abusive", "r")]
    v = spark.createDataFrame(reviewed, "doc_id long, verdict string, reviewer string")
    model = abuse.fit(d, v)
    scored = abuse.score_abuse(d, model)
    flagged = {r["doc_id"] for r in scored.filter("flagged").collect()}
    held = [(i, bad) for i, _, bad in rows if i >= 240]
    hit = sum(1 for i, bad in held if bad and i in flagged)
    wrong = sum(1 for i, bad in held if not bad and i in flagged)
    assert hit >= 0.9 * sum(bad for _, bad in held) and wrong <= 4
    assert 9003 in flagged and scored.count() == d.count()
    assert {r["score"] for r in scored.filter("doc_id in (9000, 9001, 9002)").collect()} == {abuse.FLOOR}
    rates = {r["source"]: r["documents"] for r in abuse.source_rates(scored).collect()}
    assert rates == {"news": 360, None: 1, "b": 3}


def test_without_labels_nothing_is_found(spark):
    d = spark.createDataFrame([(1, "text", "a")], "doc_id long, text string, source string")
    v = spark.createDataFrame([], "doc_id long, verdict string")
    assert abuse.fit(d, v) is None
    assert abuse.score_abuse(d, None).filter("flagged").count() == 0


def test_masked_words_score_as_the_words_they_hide(spark):
    rows = corpus(240, 2)
    d = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows], "doc_id long, text string, score double")
    v = spark.createDataFrame([(i, "abusive" if bad else "clean") for i, _, bad in rows], "doc_id long, verdict string")
    model = abuse.fit(d, v)
    plain = "so you people are vermin and should leave"
    masked = [plain.replace("vermin", m).replace("people", p) for m in ("v****n", "v*rm*n", "V****N", "v＊＊＊＊n") for p in ("people", "p****e")]
    assert np.allclose(model.scores([plain, *masked], model.table()), model.scores([plain], model.table())[0])
    # what no reviewed word fits, and signs beside words, stay
    assert model.unmask("q***z is *bold* and 2 * 3") == "q***z is *bold* and 2 * 3"


def test_two_inserted_letters_are_bridged():
    folded = lambda text: abuse.fold([text])[0]
    codes = lambda text: {int(c) for code, _ in abuse._features(folded(text)) for c in code}
    plain = int(next(abuse._features(folded("worm")))[0][0])
    assert all(plain in codes(t) for t in ("worm", "wxorm", "wxoyrm", "woxyrm", "w x o r y m"))
    assert plain not in codes("wxoyrzm")
