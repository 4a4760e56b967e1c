"""Reading a name: what of it tells the entity apart, and when two readings agree.

A spelling is read into one or more *alternatives*: one of its rarer words is
the *core* (a family, place or brand name), all others are the *rest* (given
names and initials of a person, the words that say what kind of thing another
name is). Which words are common, and which of these are given names, is
learned from the spellings themselves (see ``names``); where nothing is known of
a spelling's words each long one may be the core. Words are put into one Latin
alphabet, without accents, doubled letters, titles and legal forms.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

# Romanisation of Cyrillic letters.
ROMAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "i", "ь": "", "э": "e", "ю": "iu", "я": "ia",
    "і": "i", "ї": "i", "є": "e", "ґ": "g",
}
# Short forms of given names that are no beginnings of them, romanised; general, not taken from any data.
SHORT_FORMS = {
    "abigail": "abby gail", "albert": "bert bertie", "alexander": "alec sandy xander", "amelia": "millie",
    "andrew": "drew", "anthony": "tony", "arthur": "artie", "barbara": "babs", "bernard": "bernie", "catherine": "kate katie kathy kitty",
    "charles": "charlie chuck", "charlotte": "lottie", "christopher": "kit", "david": "dave", "deborah": "debbie",
    "dorothy": "dot dolly dottie", "edmund": "ned ted", "edward": "ted ned teddy", "eleanor": "nell nora",
    "elizabeth": "liz lizzie beth betty", "emily": "millie", "eugene": "gene", "florence": "flossie", "francis": "frank",
    "frederick": "fritz", "gerald": "gerry jerry", "harold": "hal harry", "helen": "nell", "henry": "hank harry",
    "isabella": "bella izzy", "james": "jim jimmy jamie", "jennifer": "jenny", "john": "jack johnny", "joseph": "jo joe",
    "josephine": "jo josie", "judith": "judy", "katherine": "kate katie kathy kitty", "lawrence": "larry", "leonard": "len lenny",
    "lucille": "lucy", "margaret": "peggy maggie meg", "martha": "patty", "mary": "molly polly", "matilda": "tilly",
    "michael": "mike mick", "nicholas": "nick", "patricia": "patty tricia", "quentin": "quin", "rebecca": "becky",
    "reginald": "reggie", "richard": "dick rick", "robert": "bob bobby", "rosemary": "romy", "sarah": "sally",
    "stephen": "steve", "susanna": "sue susie", "theodore": "ted teddy", "thomas": "tom tommy", "victoria": "vicky tori",
    "virginia": "ginny", "walter": "wally", "william": "bill billy liam", "zachary": "zack zach",
    "aleksandr": "sasha shura sania", "aleksandra": "sasha shura", "aleksei": "alesha lesha", "anastasia": "nastia",
    "anatoli": "tolia", "andrei": "andriusha", "anna": "ania", "anton": "antosha", "arkadi": "arkasha", "boris": "boria",
    "denis": "deniska", "dmitri": "dima mitia", "egor": "gosha", "ekaterina": "katia", "elena": "lena", "elizaveta": "liza",
    "evgenia": "zhenia", "evgeni": "zhenia", "fedor": "fedia fiodor", "galina": "galia", "gennadi": "gena", "georgi": "gosha zhora",
    "grigori": "grisha", "iakov": "iasha", "ilia": "iliusha", "irina": "ira", "iulia": "iulka", "iuri": "iura", "ivan": "vania",
    "konstantin": "kostia", "ksenia": "ksiusha", "larisa": "lara", "leonid": "lenia", "lidia": "lida", "liubov": "liuba",
    "liudmila": "liuda liusia mila", "maksim": "maks", "maria": "masha marusia", "mikhail": "misha", "nadezhda": "nadia",
    "natalia": "natasha", "nikolai": "kolia", "oleg": "olezha", "olga": "olia", "pavel": "pasha", "petr": "petia",
    "semen": "sema senia", "sergei": "serezha", "sofia": "sonia", "stanislav": "stas", "stepan": "stepa", "svetlana": "sveta",
    "tamara": "toma", "tatiana": "tania", "timofei": "tima timosha", "valentin": "valia", "vasili": "vasia", "viacheslav": "slava",
    "viktor": "vitia", "vladimir": "vova volodia", "zinaida": "zina",
}
# Forms of address, romanised.
TITLES = "mr mrs ms miss dr prof professor sir lady lord rev capt tov gn gzha akad proff tovarishch gospodin gospozha".split()
# Legal forms and words without weight in a name, romanised.
LEGAL = (
    "inc incorporated ltd limited corp corporation llc plc gmbh ag sa ao oo ooo zao pao oao the of and an de la city town gorod".split()
)
# Legal forms of several words, romanised without doubled letters.
PHRASES = [
    "obshchestvo s ogranichenoi otvetstvenostiu", "otkritoe aktsionernoe obshchestvo", "zakritoe aktsionernoe obshchestvo",
    "publichnoe aktsionernoe obshchestvo", "aktsionernoe obshchestvo", "limited liability company", "public limited company",
]

# Sounds written with several Latin letters count as one letter.
_SOUNDS = dict(zip("shch zh kh ch sh ts iu ia".split(), "шжхчсцюя", strict=True))
_PACK = re.compile("|".join(_SOUNDS))
_UNPACK = {v: k for k, v in _SOUNDS.items()}
_SPLIT = re.compile(r"[^\W_]+(?:-[^\W\d_]{1,2}(?![^\W_]))?")
_ABBREVIATED = re.compile(r"([^\W\d_]{1,4})-([^\W\d_]{1,2})$")


@lru_cache(maxsize=200_000)
def roman(word: str) -> str:
    """Lower case, Latin, no accents; i for y and j; doubled letters kept."""
    word = word.lower()
    if not word.isascii():
        out = []
        for ch in word:
            if ch in ROMAN:
                out.append(ROMAN[ch])
            else:
                out.append("".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)))
        word = "".join(out)
    return re.sub("i{2,}", "i", word.replace("y", "i").replace("j", "i").replace("'", ""))


def single(word: str) -> str:
    """Doubled letters collapsed."""
    return re.sub(r"(.)\1+", r"\1", word)


def packed(word: str) -> str:
    """One sign per sound, so that a mistyped Cyrillic letter stays one typing error."""
    return _PACK.sub(lambda m: _SOUNDS[m[0]], word)


def spelled(word: str) -> str:
    return "".join(_UNPACK.get(c, c) for c in word)


@lru_cache(maxsize=200_000)
def canon(word: str) -> str:
    """The form words are compared in."""
    return single(packed(roman(word)))


FORMAL: dict[str, frozenset[str]] = {}
for _full, _shorts in SHORT_FORMS.items():
    for _short in [_full, *_shorts.split()]:
        FORMAL[canon(_short)] = FORMAL.get(canon(_short), frozenset()) | {canon(_full)}
TITLES = frozenset(map(canon, TITLES))
LEGAL = frozenset(map(roman, LEGAL))
PHRASES = [tuple(map(canon, p.split())) for p in PHRASES]
COMPANY = frozenset(map(canon, ["co", "company"]))
PATRONYMIC = re.compile(rf"(ovi{canon('ch')}|evi{canon('ch')}|ovna|evna|i{canon('ch')}na)$")


@dataclass(frozen=True)
class Word:
    """A word as read: romanised, its form for comparison, and whether a sign marks it as cut short."""

    plain: str
    form: str
    cut: bool


def words_of(name: str) -> list[Word]:
    """The words of a name in order, without forms of address and legal forms unless nothing else is left.

    A hyphen parts words unless it abbreviates one; letters run together in a
    name of mixed case are initials (``Smith JB``).
    """
    text = unicodedata.normalize("NFKC", name)
    mixed = any(c.islower() for c in text)
    out: list[Word] = []
    for raw in _SPLIT.findall(text):
        short = _ABBREVIATED.match(raw) is not None
        parts = [raw.replace("-", "")] if short else raw.split("-")
        for part in parts:
            if mixed and 2 <= len(part) <= 3 and part.isupper() and roman(part) not in LEGAL and canon(part) not in TITLES:
                out += [Word(roman(c), canon(c), False) for c in part]
            elif roman(part):
                out.append(Word(roman(part), canon(part), short))
    for phrase in PHRASES:
        for i in range(len(out) - len(phrase) + 1):
            if tuple(w.form for w in out[i : i + len(phrase)]) == phrase and len(out) > len(phrase):
                out = out[:i] + out[i + len(phrase) :]
                break
    out = [w for w in out if w.form not in TITLES] or out
    return [w for w in out if w.plain not in LEGAL] or out


def distance(a: str, b: str, most: int) -> int:
    """Edits (swaps of neighbours included) between two words; ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def abbreviates(short: str, word: str) -> bool:
    """A short form keeps the first letter and the order of the others."""
    if not short or len(short) >= len(word) or short[0] != word[0] or len(short) > 6:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def deletions(word: str) -> list[str]:
    """The word and what is left of it without one letter: two words one typing error apart share one of these."""
    if len(word) < 4:
        return [word]
    return sorted({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))})


@lru_cache(maxsize=500_000)
def near(a: str, b: str) -> bool:
    """One typing error apart at most, by sounds or by letters."""
    if a == b:
        return True
    x, y = spelled(a), spelled(b)
    return min(len(x), len(y)) >= 4 and (distance(a, b, 1) <= 1 or distance(x, y, 1) <= 1)


def starts(short: str, word: str) -> bool:
    return word.startswith(short) or spelled(word).startswith(spelled(short))


@dataclass
class Vocabulary:
    """Common words with the share of persons among the names they stand in (None where no type is known)."""

    common: dict[str, float | None]
    _near: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for word in sorted(w for w in {**self.common, **FORMAL} if len(w) >= 4):
            for part in {*deletions(word), *deletions(spelled(word))}:
                self._near.setdefault(part, []).append(word)
        self._long = sorted(w for w in self.common if len(w) >= 4)

    def known(self, word: str) -> bool:
        return word in self.common or word in FORMAL or bool(PATRONYMIC.search(word))

    def mend(self, word: str) -> str | None:
        """The common word one typing error away."""
        if len(spelled(word)) >= 4:
            for own in (word, spelled(word)):
                for part in deletions(own):
                    for known in self._near.get(part, ()):
                        # short words are a typing error away from some given name or other
                        if near(word, known) and (known in self.common or len(spelled(word)) >= 5):
                            return known
        return None

    def shortened(self, word: str) -> bool:
        return any(abbreviates(word, w) for w in self._long)

    def is_given(self, word: str) -> bool:
        share = self.common.get(word)
        return word in FORMAL or bool(PATRONYMIC.search(word)) or (share is not None and share >= 0.9)

    def is_kind(self, word: str) -> bool:
        share = self.common.get(word)
        return word not in FORMAL and share is not None and share <= 0.5


@dataclass(frozen=True)
class Alternative:
    """One way to read a spelling, or a profile of several: its cores, its rest, whether it is a person (None: open)."""

    cores: tuple[str, ...]
    rest: tuple[str, ...]
    person: bool | None

    def full(self) -> int:
        """How much it says: letters of the rest."""
        return sum(map(len, self.rest))


def _stem(word: str) -> str:
    """A core without the ending of an adjective."""
    for ending in ("ski", "skoe", "skaia"):
        if word.endswith(ending) and len(word) > len(ending) + 4:
            return word[: -len(ending)]
    return word


def read_name(name: str, vocabulary: Vocabulary, kinds: Iterable[str] = ()) -> tuple[Alternative, ...]:
    """``kinds``: entity types the spelling is stored with; they settle whether it names a person."""
    words = words_of(name)
    if not words:
        return ()
    forms = [w.form for w in words]
    fresh = [
        i for i, w in enumerate(words)
        if len(w.form) >= 4 and not w.form.isdigit() and not w.cut and not vocabulary.known(w.form)
        and not (len(w.form) == 4 and vocabulary.shortened(w.form))
    ]
    for i in list(fresh):
        if sum(len(forms[k]) for k in fresh if k != i) >= 5 and (fixed := vocabulary.mend(forms[i])):
            forms[i] = fixed
            fresh.remove(i)
    if not fresh:
        long = [i for i, f in enumerate(forms) if len(f) >= 4 and not words[i].cut]
        fresh = [i for i in long if not vocabulary.is_given(forms[i])] or long
        fresh = fresh or [max(range(len(forms)), key=lambda i: (len(forms[i]), -i))]
    types = {k for k in kinds if k}
    # one rare word is the core, or two neighbouring ones that a stray blank has parted
    odd = [len(w.form) > 1 and not w.form.isdigit() and not w.cut and not vocabulary.known(w.form) for w in words]
    spans = [(i, i + 1) for i in fresh] + [(i, i + 2) for i in range(len(words) - 1) if odd[i] and odd[i + 1]]
    out = []
    for lo, hi in spans:
        rest = tuple(forms[:lo] + forms[hi:])
        if types:
            person: bool | None = "PERSON" in types
        elif any(vocabulary.is_kind(f) for f in rest):
            person = False
        elif any(vocabulary.is_given(f) for f in rest):
            person = True
        else:
            person = None
        plain = "".join(w.plain for w in words[lo:hi])
        core = forms[lo] if hi == lo + 1 and forms[lo] != words[lo].form else canon(_stem(plain))
        if person is not True and rest == ("g",):
            out.append(Alternative((core,), (), False))  # the short form of "city" before a name
        if person is not False or rest != ("g",):
            out.append(Alternative((core,), rest, person))
    return tuple(dict.fromkeys(out))


def near_keys(core: str) -> set[str]:
    """Any two cores that ``core_gap`` accepts share one of these; not all that share one are accepted."""
    out = level = {core, spelled(core)}
    for _ in range(2 if len(core) >= 7 else 1 if len(core) >= 5 else 0):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


@lru_cache(maxsize=500_000)
def core_gap(a: str, b: str) -> int:
    """Edits between two cores, by sounds or by letters; 3 if too many for their length."""
    most = 2 if min(len(a), len(b)) >= 7 else 1 if min(len(a), len(b)) >= 5 else 0
    gap = distance(a, b, most)
    if gap > 1:
        gap = min(gap, distance(spelled(a), spelled(b), most))
    return gap if gap <= most else 3


def rest_keys(rest: tuple[str, ...]) -> set[str]:
    """Letters of which any two rests that agree share one: words agree by their first letter or, mistyped, the second."""
    out = set()
    for w in rest:
        for form in (w, spelled(w)):
            out |= {form[0], *form[1 : 2 if len(w) >= 4 else 1]}
        out |= {n[0] for n in FORMAL.get(w, ())}
    return out or {""}


@lru_cache(maxsize=500_000)
def _same_given(x: str, y: str) -> bool:
    short, word = sorted((x, y), key=len)
    if x == y or (len(short) in (1, 3, 4, 5) and starts(short, word)) or near(x, y):
        return True
    # one a short form of the other, or both of one name
    names = FORMAL.get(x, frozenset({x})), FORMAL.get(y, frozenset({y}))
    if len(short) == 1:
        return any(starts(short, n) for n in FORMAL.get(word, ()))
    return bool(names[0] & names[1]) or any(near(n, x) for n in names[1]) or any(near(n, y) for n in names[0])


def _given_agree(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    return bool(a) and bool(b) and all(_same_given(x, y) for x, y in zip(a, b, strict=False))


def _same_kind(x: str, y: str, loose: bool) -> bool:
    """``loose``: a typing error counts in words of any length, as others speak for the pair too."""
    if loose and min(len(x), len(y)) >= 2 and distance(x, y, 1) <= 1:
        return True
    short, word = sorted((x, y), key=len)
    swapped = len(x) == len(y) == 3 and sorted(x) == sorted(y)
    return near(x, y) or swapped or abbreviates(short, word) or abbreviates(spelled(short), spelled(word))


def _kinds_agree(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Every word has its counterpart, in any order; "company" may be left out."""
    if len(a) != len(b):
        a, b = (tuple(w for w in r if w not in COMPANY) for r in (a, b))
    if len(a) != len(b):
        return False
    left = list(b)
    for x in sorted(a, key=len, reverse=True):
        hit = next((y for y in left if x == y), None) or next((y for y in left if _same_kind(x, y, len(a) > 2)), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


@lru_cache(maxsize=500_000)
def rests_agree(a: tuple[str, ...], a_person: bool | None, b: tuple[str, ...], b_person: bool | None) -> bool:
    """Whether the rests can belong to one entity, given agreeing cores."""
    known = {a_person, b_person} - {None}
    if len(known) == 2:
        return False
    if a == b:
        return True
    return (False not in known and _given_agree(a, b)) or (True not in known and _kinds_agree(a, b))


#: (gap between the cores, minus the words that speak for it, where each side's alternative stands)
Fit = tuple[int, int, int, int]


def fit(a: tuple[Alternative, ...], b: tuple[Alternative, ...]) -> Fit | None:
    """How well two profiles fit, best alternatives first; None if they can't be one entity."""
    best: Fit | None = None
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if rests_agree(x.rest, x.person, y.rest, y.person):
                gap = min(core_gap(p, q) for p in x.cores for q in y.cores)
                if gap <= 2:
                    own = (gap, -min(len(x.rest), len(y.rest)), i, j)
                    best = own if best is None or own < best else best
    return best


def unite(a: tuple[Alternative, ...], b: tuple[Alternative, ...]) -> tuple[Alternative, ...]:
    """The profile of both: all cores, and the fuller of each word of the rests; only alternatives that agree stay."""
    out = []
    for x in a:
        for y in b:
            if rests_agree(x.rest, x.person, y.rest, y.person) and min(core_gap(p, q) for p in x.cores for q in y.cores) <= 2:
                person = x.person if x.person is not None else y.person
                if person is not False and _given_agree(x.rest, y.rest):
                    more = max(x.rest, y.rest, key=lambda r: (len(r), r))
                    rest = tuple(max(p, q, key=lambda w: (len(w), w)) for p, q in zip(x.rest, y.rest, strict=False))
                    rest += more[len(rest) :]
                else:
                    rest = max(x.rest, y.rest, key=lambda r: (sum(map(len, r)), r))
                out.append(Alternative(tuple(sorted({*x.cores, *y.cores})), rest, person))
    return tuple(dict.fromkeys(out))
