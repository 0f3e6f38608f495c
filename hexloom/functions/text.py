"""Names and labels as Column expressions; Arrow UDFs only for the likeness of character sequences."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

# Letters and their Latin stand-ins of one character. Hamza, alef, tatweel and vowel marks have none.
_FROM = "بتجحدرزسصضطظغفقكلمنهويئپڤگ٠١٢٣٤٥٦٧٨٩àáâãäåāçćčèéêëēìíîïīñńòóôõöøōśšùúûüūýÿźż" + "ءاأإآىـًٌٍَُِّْ"
_TO = "btjhdrzssdtzgfqklmnhwyypvg0123456789aaaaaaaccceeeeeiiiiinnooooooossuuuuuyyzz"
# Letters that two or three Latin ones stand for.
_LONG = {"ث": "th", "خ": "kh", "ذ": "dh", "ش": "sh", "چ": "ch", "ؤ": "w", "ß": "ss", "æ": "ae", "œ": "oe"}
# Words that say what a place is or where, not which; also as consonants.
GENERIC = """
design designs studio studios marketing agency agencies mall store stores shop shops boutique group company co corp holding holdings center centre
services service solutions systems trading international intl restaurant cafe coffee bakery pharmacy clinic clinics hospital school academy gym fitness
salon spa office offices branch the and for of el al new grand royal golden city plaza tower towers dr prof eng
egypt cairo giza alexandria maadi zayed sheikh downtown katameya tagamoa zamalek heliopolis nasr smouha roushdy sporting karmouz bacos imbaba
landscape decor rent car parking express
mtm qhw qhwh qhwt shrk mhl mrkz msr lqhr lskndry lmdy lmdyy lm dy sh shr shrl dwn twn mwl lshykh zyd
""".split()
_GENERIC = frozenset(GENERIC)
#: Names as alike as BAR are held to what is left without generic words: that must be as alike as OWN.
BAR, OWN, STRICT = 0.72, 0.62, 0.9
_RUN = r"[A-Za-z0-9][A-Za-z0-9\s&'\-]*|[؀-ۿ][؀-ۿ\s]*"


def normalize(c: Column) -> Column:
    """Latin letters, lower case, anything but a-z, 0-9 and blanks a blank, blanks reduced, trimmed."""
    latin = F.translate(F.lower(c), _FROM, _TO)
    for letter, stands in _LONG.items():
        latin = F.replace(latin, F.lit(letter), F.lit(stands))
    return F.trim(F.regexp_replace(F.regexp_replace(latin, "[^a-z0-9 ]", " "), " +", " "))


def sql_normalize(c: str) -> str:
    latin = f"translate(lower({c}), '{_FROM}', '{_TO}')"
    for letter, stands in _LONG.items():
        latin = f"replace({latin}, '{letter}', '{stands}')"
    return f"trim(regexp_replace(regexp_replace({latin}, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


_SINGLE = str.maketrans(_FROM[: len(_TO)], _TO, _FROM[len(_TO) :]) | {ord(k): v for k, v in _LONG.items()}


@lru_cache(200_000)
def normal(x: str) -> str:
    """normalize() of one text."""
    return " ".join(re.sub("[^a-z0-9 ]", " ", x.lower().translate(_SINGLE)).split())


def skeleton(c: Column) -> Column:
    """Consonants and digits of a normalised name."""
    return F.regexp_replace(c, r"[aeiou\s]", "")


def variants(c: Column) -> Column:
    """Distinct spellings in one field: the parts between bars, and in them runs of one script that have at least four characters."""
    parts = F.transform(F.split(c, r"\|"), lambda x: F.trim(x))
    runs = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(f"({_RUN})"), 1)))
    runs = F.filter(F.transform(runs, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= 4)
    return F.array_distinct(F.filter(F.concat(parts, runs), lambda x: x != ""))


def spellings(c: Column) -> Column:
    """The normalised variants of a name between bars; '' where nothing is left. What tells two names apart for likeness()."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(variants(c), normalize), lambda x: x != ""))), "|")


def strip_generic(c: Column) -> Column:
    """Words of a normalised name that are no generic words, nor their consonants, and have two characters; '' if none is left."""
    kept = F.filter(F.split(c, " "), lambda w: (F.length(w) > 1) & ~w.isin(GENERIC) & ~F.regexp_replace(w, "[aeiou]", "").isin(GENERIC))
    return F.array_join(kept, " ")


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters; a shorter text as a whole."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))
    return F.array_distinct(F.when(F.length(c) < 2, F.array(c)).otherwise(pairs))


def snapshot_date(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)


def date_shape(c: Column) -> Column:
    return F.regexp_replace(c, r"\d", "9")


def plural(c: Column) -> Column:
    """English plural: -y after a consonant -ies, after s, x, z, ch, sh -es, else -s."""
    return F.when(c.rlike("(?i)[^aeiou]y$"), F.concat(F.substr(c, F.lit(1), F.length(c) - 1), F.lit("ies"))).when(c.rlike("(?i)(s|x|z|ch|sh)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def first_filled(*cs: Column) -> Column:
    """First that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in cs])


def text_map(c: Column) -> Column:
    """JSON object of texts as a map; malformed or null text as an empty one."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def _matched(a: str, b: str) -> int:
    """Characters in SequenceMatcher's matching blocks: the longest common run, the first in a, then in b, and those on either side of it."""
    best = at = i = 0
    while i + best < len(a):
        while i + best < len(a) and a[i : i + best + 1] in b:
            best, at = best + 1, i
        i += 1
    if not best:
        return 0
    j, to = b.find(a[at : at + best]), at + best
    got = best
    if at and j:
        got += _matched(a[:at], b[:j])
    if to < len(a) and j + best < len(b):
        got += _matched(a[to:], b[j + best :])
    return got


@lru_cache(100_000)
def ratio(a: str, b: str) -> float:
    """SequenceMatcher.ratio(), which leaves out frequent characters of texts from 200 on."""
    if len(b) >= 200:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _matched(a, b) / (len(a) + len(b)) if a or b else 1.0


_SOFT = dict.fromkeys(map(ord, "aeiou "))


@lru_cache(200_000)
def _bones(x: str) -> str:
    return x.translate(_SOFT)


@lru_cache(200_000)
def _distinct(x: str) -> str:
    return " ".join(w for w in x.split() if len(w) > 1 and w not in _GENERIC and _bones(w) not in _GENERIC)


def _window(a: str, b: str, least: int = 5) -> float:
    """Best ratio of the texts and, if the shorter one is not too short, of it with any window of its length in the longer one."""
    whole = ratio(a, b)
    short, long = (b, a) if len(a) > len(b) else (a, b)
    if len(short) < least:
        return whole
    return max(whole, *(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)))


@lru_cache(200_000)
def _score(a: str, b: str) -> float:
    return max(ratio(a, b), _window(_bones(a), _bones(b)))


def _own_words_agree(a: str, b: str) -> bool:
    """Whether two normalised names are alike in what is left without generic words.

    Nothing left on either side is no evidence. Little left, or much more on one side,
    must agree closely.
    """
    a, b = _distinct(a), _distinct(b)
    if not a or not b:
        return False
    x, y = _bones(a), _bones(b)
    few, many = sorted((len(x), len(y)))
    if few < 4:
        return ratio(x, y) >= STRICT
    if few < 0.5 * many:
        return ratio(a, b) >= STRICT
    return max(ratio(a, b), _window(x, y)) >= OWN


@lru_cache(200_000)
def likeness(a: str, b: str) -> float:
    """Likeness of two names by their spellings(), 0 to 1.

    The best of any two spellings: the ratio of the names, of their consonants, or of a
    window of them. From BAR on it counts only if two spellings that are alike are so
    in their own words too, else it is 0: words for the kind or the place alone make no match.
    """
    pairs = [(x, y) for x in a.split("|") for y in b.split("|") if x and y]
    full = max((_score(x, y) for x, y in pairs), default=0.0)
    if full < BAR or any(_score(x, y) >= BAR and _own_words_agree(x, y) for x, y in pairs):
        return full
    return 0.0


@F.pandas_udf(DoubleType())
def name_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """likeness() of two columns of spellings(); 0 for null."""
    return pd.Series([likeness(x, y) if isinstance(x, str) and isinstance(y, str) else 0.0 for x, y in zip(a, b)])


# What likeness() accepts must also pass the bounds below: characters that match are
# common to both texts, however often each has them, and a common subsequence.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
_BIT = {x: 1 << i for i, x in enumerate(_LETTERS)}
_HARD = sum(b for x, b in _BIT.items() if x not in "aeiou ")
#: Above the rounding of the products, below any step of a ratio.
_EPS = 1e-9


# Number of each letter by its byte; of what is no letter, theirs.
_CODE = np.full(256, len(_LETTERS), np.uint8)
_CODE[np.frombuffer(_LETTERS.encode(), np.uint8)] = np.arange(len(_LETTERS))


def _held(texts: list[str]) -> list[np.ndarray]:
    """The letters that each text holds once, twice and three times, as bits."""
    each, wide = [x.encode() for x in texts], len(_LETTERS) + 1
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    n = np.bincount(row * wide + _CODE[np.frombuffer(b"".join(each), np.uint8)], minlength=len(each) * wide).reshape(-1, wide)[:, :-1]
    return [(n >= k) @ (np.int64(1) << np.arange(wide - 1)) for k in (1, 2, 3)]


HELD = ["n1", "n2", "n3", "n", "nb", "d1", "d2", "d3", "d", "db"]


@F.pandas_udf(StructType([StructField(k, LongType()) for k in HELD]))
def letters(norm: pd.Series) -> pd.DataFrame:
    """Letters that a normalised spelling and its own words hold once, twice and three times, and their lengths with and without vowels."""
    columns: list = []
    for texts in (list(norm), [_distinct(a) for a in norm]):
        columns += [*_held(texts), [len(x) for x in texts], [len(_bones(x)) for x in texts]]
    return pd.DataFrame(dict(zip(HELD, columns)), columns=HELD)


def may_be_alike(l: str, r: str, least: float) -> Column:  # noqa: E741
    """False only where two spellings can't be what makes likeness() reach `least` > 0. l, r: prefixes of columns of letters(), without nulls."""
    l, r = ({k: F.col(f"{p}_{k}") for k in HELD} for p in (l, r))  # noqa: E741

    def common(p: str, size: str, of: int | None = None) -> Column:
        got, rest = None, [l[size], r[size]]
        for k in "123":
            a, b = (x[p + k] if of is None else x[p + k].bitwiseAND(F.lit(of)) for x in (l, r))
            both = F.bit_count(a.bitwiseAND(b))
            got, rest = both if got is None else got + both, [rest[0] - F.bit_count(a), rest[1] - F.bit_count(b)]
        return got + F.least(*rest)

    def reaches(p: str, bar) -> Column:
        b = p + "b"
        hard, short, both = common(p, b, _HARD), F.least(l[b], r[b]), l[b] + r[b]
        # Two empty texts have the ratio 1.
        return (2 * common(p, p) >= bar * (l[p] + r[p])) | (2 * hard >= bar * both) | ((short >= 5) & (hard >= bar * short))

    if least < BAR:
        return reaches("n", F.lit(least - _EPS))
    strict = (F.least(l["db"], r["db"]) < 4) | (F.least(l["db"], r["db"]) < 0.5 * F.greatest(l["db"], r["db"]))
    own = F.when(strict, F.lit(STRICT)).otherwise(F.lit(OWN))
    return (l["d"] > 0) & (r["d"] > 0) & reaches("n", F.lit(BAR - _EPS)) & reaches("d", own - _EPS)


@lru_cache(20_000)
def _places_of(x: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(x):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    at, full = _places_of(a), (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _reaches(a: str, b: str, bar: float) -> bool:
    x, y = _bones(a), _bones(b)
    hard, short = _subsequence(x, y), min(len(x), len(y))
    return 2 * hard >= bar * (len(x) + len(y)) or short >= 5 and hard >= bar * short or 2 * _subsequence(a, b) >= bar * (len(a) + len(b))


def _may_be_alike(a: str, b: str, least: float) -> bool:
    """The same for two spellings, by common subsequences."""
    if least < BAR:
        return _reaches(a, b, least - _EPS)
    da, db = _distinct(a), _distinct(b)
    if not da or not db:
        return False
    few, many = sorted((len(_bones(da)), len(_bones(db))))
    return _reaches(a, b, BAR - _EPS) and _reaches(da, db, (STRICT if few < 4 or few < 0.5 * many else OWN) - _EPS)


@lru_cache(200_000)
def _ratio_beyond(a: str, b: str, least: float) -> float:
    """ratio() where a common subsequence lets it reach `least`, else 0: what matches is one, so no ratio is beyond it."""
    size = len(a) + len(b)
    return ratio(a, b) if not size or 2.0 * _subsequence(a, b) / size >= least else 0.0


def _window_beyond(a: str, b: str, best: float, least: int = 5) -> float:
    """The larger of `best` and _window(); windows that can't be beyond it are not compared."""
    common, size = _subsequence(a, b), len(a) + len(b)
    if not size or 2.0 * common / size >= best:
        best = max(best, ratio(a, b))
    short, long = (b, a) if len(a) > len(b) else (a, b)
    k = len(short)
    if k >= least and best < 1.0 and common > best * k - _EPS:
        at, full = _places_of(short), (1 << k) - 1
        places = [at.get(c, 0) for c in long]
        known = [0, *accumulate(map(bool, places))]
        for i in range(len(long) - k + 1):
            if known[i + k] - known[i] <= best * k - _EPS:
                continue
            v = full
            for x in places[i : i + k]:
                u = v & x
                v = (v + u | v - u) & full
            if k - v.bit_count() > best * k - _EPS:
                best = max(best, ratio(short, long[i : i + k]))
    return best


@lru_cache(200_000)
def _own_words_reach(a: str, b: str) -> bool:
    """_own_words_agree(), by bounds first."""
    a, b = _distinct(a), _distinct(b)
    if not a or not b:
        return False
    x, y = _bones(a), _bones(b)
    few, many = sorted((len(x), len(y)))
    if few < 4:
        return _ratio_beyond(x, y, STRICT) >= STRICT
    if few < 0.5 * many:
        return _ratio_beyond(a, b, STRICT) >= STRICT
    below = OWN - _EPS  # no ratio lies between
    return _ratio_beyond(a, b, OWN) >= OWN or _window_beyond(x, y, below) >= OWN


def likeness_beyond(a: str, b: str, least: float) -> float:
    """likeness() where it is at least `least`, else some value below; whatever can't reach it is not compared."""
    below, full, scored = min(least, BAR) - _EPS, 0.0, []
    for x in a.split("|"):
        for y in b.split("|"):
            if x and y:
                one = _window_beyond(_bones(x), _bones(y), max(below, _ratio_beyond(x, y, below)))
                full = max(full, one)
                scored.append((one, x, y))
    if full < least or full < BAR:
        return full if full >= least else 0.0
    return full if any(s >= BAR and _own_words_reach(x, y) for s, x, y in scored) else 0.0


class _Tables:
    """Spellings as numbers, for common subsequences of many pairs at once: of the name, its consonants, its own words and their consonants."""

    #: Characters in a machine word, spellings held at once.
    WIDE, MOST = 64, 20_000

    def __init__(self):
        self.row: dict[str, int] = {}
        self.held: list[str] = []
        self.room(1024)

    def room(self, n: int) -> None:
        """Space for n spellings; those held stay."""
        k = len(self.held)
        old = (self.codes, self.masks, self.size) if k else None
        none = len(_LETTERS)
        self.codes, self.masks, self.size = np.full((4, n, self.WIDE), none, np.uint8), np.zeros((4, n, none + 1), np.uint64), np.zeros((4, n), np.int64)
        if old:
            for new, was in zip((self.codes, self.masks, self.size), old):
                new[:, :k] = was[:, :k]

    def rows(self, texts: list[str]) -> np.ndarray:
        """Row of each text; -1 of one that is too long or not normalised."""
        self.add([x for x in dict.fromkeys(texts) if x not in self.row])
        return np.array([self.row[x] for x in texts], np.int64)

    def add(self, texts: list[str]) -> None:
        fit = [x for x in texts if len(x) <= self.WIDE and _BIT.keys() >= set(x)]
        k, n, none = len(self.held), len(fit), len(_LETTERS)
        if k + n > self.size.shape[1]:
            self.room(max(2 * k, k + n))
        self.row |= dict.fromkeys(texts, -1) | {x: k + at for at, x in enumerate(fit)}
        self.held += fit
        own = [_distinct(x) for x in fit]
        each = np.arange(k, k + n)
        for p, part in enumerate((fit, [_bones(x) for x in fit], own, [_bones(x) for x in own])):
            self.size[p, k : k + n] = [len(x) for x in part]
            codes = _CODE[np.array([x.encode() for x in part] or [b""], f"S{self.WIDE}")[:n].view(np.uint8).reshape(n, self.WIDE)]
            self.codes[p, k : k + n] = codes
            for i in range(self.size[p, k : k + n].max(initial=0)):
                self.masks[p, each, codes[:, i]] |= np.uint64(1 << i)
            self.masks[p, k : k + n, none] = 0

    def common(self, p: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """_subsequence() of the parts p of rows i and j."""
        none = len(_LETTERS) + 1
        if not len(i):
            return np.zeros(0, np.int64)
        masks, first, codes = self.masks[p].ravel(), i * none, np.ascontiguousarray(self.codes[p][j, : self.size[p, j].max()].T)
        v = np.full(len(i), ~np.uint64(0))
        for c in codes:
            u = v & masks[first + c]
            v = (v + u) | (v - u)
        n = self.size[p, i]
        unused = np.where(n < 64, ~np.uint64(0) << np.minimum(n, 63).astype(np.uint64), np.uint64(0))
        return n - np.bitwise_count(v & ~unused).astype(np.int64)

    def reach(self, p: int, i: np.ndarray, j: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """_reaches() of rows i and j, p: 0 for names, 2 for their own words."""
        x, y = self.size[p + 1, i], self.size[p + 1, j]
        hard, short = self.common(p + 1, i, j), np.minimum(x, y)
        ok = (2 * hard >= bar * (x + y)) | (short >= 5) & (hard >= bar * short)
        rest = np.flatnonzero(~ok)
        ok[rest] = 2 * self.common(p, i[rest], j[rest]) >= bar[rest] * (self.size[p, i[rest]] + self.size[p, j[rest]])
        return ok

    def may_be_alike(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """_may_be_alike() of rows i and j."""
        if least < BAR:
            return self.reach(0, i, j, np.full(len(i), least - _EPS))
        few, many = np.minimum(self.size[3, i], self.size[3, j]), np.maximum(self.size[3, i], self.size[3, j])
        bar = np.where((few < 4) | (few < 0.5 * many), STRICT, OWN) - _EPS
        ok = (self.size[2, i] > 0) & (self.size[2, j] > 0)
        for p, bars in ((2, bar), (0, np.full(len(i), BAR - _EPS))):
            at = np.flatnonzero(ok)
            ok[at] = self.reach(p, i[at], j[at], bars[at])
        return ok


@lru_cache(1)
def _tables() -> list[_Tables]:
    """Those of this worker, in a list, to be replaced when they are full."""
    return [_Tables()]


def table_rows(texts: list[str]) -> tuple[_Tables, np.ndarray]:
    """This worker's tables and the row of each spelling in them; earlier rows may be gone."""
    held = _tables()
    if len(held[0].row) > _Tables.MOST:
        held[0] = _Tables()
    return held[0], held[0].rows(texts)


def may_be_alike_all(x: pd.Series, y: pd.Series, least: float) -> np.ndarray:
    """_may_be_alike() of two columns of spellings."""
    (ix, ux), (iy, uy) = pd.factorize(x), pd.factorize(y)
    tables, row = table_rows([*ux, *uy])
    i, j = row[: len(ux)][ix], row[len(ux) :][iy]
    ok = (i >= 0) & (j >= 0)
    odd = np.flatnonzero(~ok)
    ok[ok] = tables.may_be_alike(i[ok], j[ok], least)
    ok[odd] = [_may_be_alike(x.iloc[k], y.iloc[k], least) for k in odd]
    return ok


def may_be_alike_rows(texts: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """_may_be_alike() of pairs of places in an array of spellings."""
    at, of = np.unique(np.concatenate([i, j]), return_inverse=True)
    tables, row = table_rows(list(texts[at]))
    ok = (row[of[: len(i)]] >= 0) & (row[of[len(i) :]] >= 0)
    odd = np.flatnonzero(~ok)
    ok[ok] = tables.may_be_alike(row[of[: len(i)]][ok], row[of[len(i) :]][ok], least)
    ok[odd] = [_may_be_alike(texts[i[k]], texts[j[k]], least) for k in odd]
    return ok


class Held:
    """may_be_alike() for rows of columns of letters(), many pairs at once."""

    def __init__(self, held: pd.DataFrame):
        col = lambda k: held[k].to_numpy(np.int64)
        self.sets = {p: [col(p + k) for k in "123"] for p in "nd"}
        self.sets |= {p + "b": [a & _HARD for a in self.sets[p]] for p in "nd"}
        self.size = {k: col(k) for k in ("n", "nb", "d", "db")}
        self.rest = {k: self.size[k] - sum(np.bitwise_count(a).astype(np.int64) for a in self.sets[k]) for k in self.size}

    def common(self, k: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum((np.bitwise_count(a[i] & a[j]) for a in self.sets[k]), np.uint8(0)) + np.minimum(self.rest[k][i], self.rest[k][j])

    def reach(self, p: str, i: np.ndarray, j: np.ndarray, bar) -> np.ndarray:
        x, y, hard = self.size[p + "b"][i], self.size[p + "b"][j], self.common(p + "b", i, j)
        short = np.minimum(x, y)
        return (2 * self.common(p, i, j) >= bar * (self.size[p][i] + self.size[p][j])) | (2 * hard >= bar * (x + y)) | (short >= 5) & (hard >= bar * short)

    def may_be_alike(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Whether each pair of rows i, j passes."""
        if least < BAR:
            return self.reach("n", i, j, least - _EPS)
        x, y = self.size["db"][i], self.size["db"][j]
        bar = np.where((np.minimum(x, y) < 4) | (np.minimum(x, y) < 0.5 * np.maximum(x, y)), STRICT, OWN) - _EPS
        ok = (self.size["d"][i] > 0) & (self.size["d"][j] > 0) & self.reach("d", i, j, bar)
        at = np.flatnonzero(ok)
        ok[at] = self.reach("n", i[at], j[at], BAR - _EPS)
        return ok

    def matrices(self, at: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
        """For meeting(): what rows hold as numbers, in columns of consonants and of other characters, and what they ask for."""
        p, bar = ("n", least) if least < BAR else ("d", OWN)
        held = np.concatenate([np.unpackbits(a[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(_LETTERS)] for a in self.sets[p]], axis=1)
        hard = np.tile([c not in "aeiou " for c in _LETTERS], 3)
        size, bones = self.size[p][at], self.size[p + "b"][at]
        ask = np.where((p == "d") & (bones < 4), STRICT, bar) * bones
        # A column for rows without consonants: they are alike to one another.
        return np.c_[held[:, hard], bones == 0].astype(np.float32), held[:, ~hard].astype(np.float32), np.float32(bar * size), np.maximum(ask, 0.5).astype(np.float32), self.rest[p][at].astype(np.float32)

    @staticmethod
    def meeting(l: tuple[np.ndarray, ...], r: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
        """Places of all pairs in matrices() of two sets of rows that may_be_alike() can accept, and of some others."""
        common = l[0] @ r[0].T
        rest = np.minimum.outer(l[4], r[4]) if l[4].any() and r[4].any() else np.float32(0)
        few = np.minimum.outer(l[3], r[3])
        ok = common + rest >= few - np.float32(1e-3)
        common += l[1] @ r[1].T
        common += rest + np.float32(1e-3)
        common *= 2
        ok |= common >= np.add.outer(l[2], r[2])
        return np.nonzero(ok)


def likeness_from(a: Column, b: Column, x: Column, y: Column, least: float) -> Column:
    """The likeness of two names where the spellings x and y may bring it to `least` > 0, else a value below."""

    @F.pandas_udf(DoubleType())
    def reached(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for k in np.flatnonzero(may_be_alike_all(x, y, least)):
            out[k] = likeness_beyond(a.iloc[k], b.iloc[k], least)
        return pd.Series(out)

    return reached(a, b, x, y)
