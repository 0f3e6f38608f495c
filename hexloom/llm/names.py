"""Typed names reduced to what tells one from another: folded core words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Arabic letters and the Latin letters they fold to.
ARABIC = dict(zip(
    "ا أ إ آ ى ب ت ث ج ح خ د ذ ر ز س ش ص ض ط ظ ع غ ف ق ك ل م ن ه ة و ي ئ ؤ ء".split(),
    "a a i a a b t t g h k d d r z s s s d t z a g f k k l m n h a u i i u -".replace("-", "").split() + [""],
))

# Words for the kind of a venue, as typed in full or shortened.
KIND_WORDS = """restaurant rest rstrnt restrnt grill grills restaurants eatery
grocery groc grcry market mkt markets groceries supermarket
pharmacy phcy pharm pharmacies chemist
cafe cfe coffee cof cafes
fashion boutique btq fshn boutiques apparel
clinic clin clinics medical center centre med ctr
salon sln beauty beaut salons
bakery bak bkry bakeries
auto service services svc motors mtrs garage
pizza piz pizzeria pizzas
gym fitness fit gyms
real estate properties props property
school sch academy acad schools
bank bnk banking banks
صيدلية مدرسة بيتزا مطعم كافيه مقهى عيادة جيم صالون عقارات ملابس ورشة بنك فرن مخبز بقالة سوبر ماركت مركز طبي""".split()

# Forms of address and articles.
TITLES = "mr mrs ms dr prof eng el al د م أ السيد الدكتور".split()

_DIGRAPHS = [("dh", "d"), ("th", "t"), ("sh", "s"), ("kh", "k"), ("gh", "g"), ("ph", "f"), ("ou", "u"), ("oo", "u"), ("ee", "i")]
_SINGLES = str.maketrans("oywjqcxv", "uiugkkkf")
_WORD = re.compile(r"[^\W\d_]+(?:['’`][^\W\d_]+)*")


@lru_cache(200_000)
def fold(word: str) -> str:
    """A word of either script in a small Latin alphabet in which its usual spellings agree; doubled letters count once."""
    w = unicodedata.normalize("NFKC", word).lower()
    w = "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) not in ("Mn", "Cf"))
    if any("؀" <= c <= "ۿ" for c in w):
        w = unicodedata.normalize("NFC", w)
        if len(w) > 4 and w.startswith("ال"):
            w = w[2:]
        w = "".join(ARABIC.get(c, c) for c in w)
    for a, b in _DIGRAPHS:
        w = w.replace(a, b)
    w = re.sub(r"[^a-z]", "", w.translate(_SINGLES))
    return re.sub(r"(.)\1+", r"\1", w)


_KINDS = frozenset(map(fold, KIND_WORDS))
_LONG_KINDS = tuple(sorted(k for k in _KINDS if len(k) >= 8))
_TITLES = frozenset(map(fold, TITLES)) - {"a"}


@lru_cache(200_000)
def distance(a: str, b: str, most: int = 3) -> int:
    """Edits between two words (insert, drop, change, swap of neighbours); most + 1 if more than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


@lru_cache(200_000)
def is_kind(folded: str) -> bool:
    return folded in _KINDS or (len(folded) >= 7 and any(distance(folded, k, 1) <= 1 for k in _LONG_KINDS))


def words_of(name: str | None) -> list[str]:
    """Raw words in typed order: of a name given in two scripts the Latin one, without a place after ' - ' and without numbers."""
    if not name:
        return []
    n = unicodedata.normalize("NFKC", name)
    n = re.sub(r"\s[-–—]\s.*$", "", n)
    n = re.sub(r"(?i)\br\.\s?e\.(?=\s|$)", " ", n)
    parts = [p for p in re.split(r"[|()]", n) if p.strip()]
    if len(parts) > 1:
        parts = [p for p in parts if re.search("[A-Za-z]", p)][:1] or parts[:1]
    return _WORD.findall(" ".join(parts))


def core_words(name: str | None) -> tuple[str, ...]:
    """Folded words without titles, articles and words for the kind of a venue.

    Null, empty or a name of nothing else: no words. One-letter words (initials) stay.
    """
    out = []
    for w in words_of(name):
        f = fold(w)
        if not f or (len(w) > 1 and (f in _TITLES or is_kind(f))) or w in ("د", "م"):
            continue
        out.append(f)
    return tuple(out)


def grams(words: tuple[str, ...] | list[str], q: int = 2) -> set[str]:
    """q-grams of each word; a word shorter than q is one gram."""
    return {w[i : i + q] for w in words for i in range(max(1, len(w) - q + 1))}


@lru_cache(200_000)
def word_likeness(a: str, b: str) -> float:
    """1 for equal, down by edits; 0 beyond what misspelling explains: one edit in four or five letters, two in six and more."""
    if a == b:
        return 1.0
    most = 0 if min(len(a), len(b)) < 4 else 1 if max(len(a), len(b)) < 6 else 2
    e = distance(a, b, most)
    return 0.0 if e > most else 1 - e / (max(len(a), len(b)) + 1)


def soft_likeness(a: tuple[str, ...], b: tuple[str, ...], weight=lambda w: 1.0) -> float:
    """Soft weighted token similarity: paired words' weights times likeness over all weights; rare words weigh more.

    Words typed together are compared as one: a word may stand for two neighbours of
    the other name.
    """
    if not a or not b:
        return 0.0
    best = _paired(a, b, weight)
    if len(a) != len(b):
        longer, shorter = (a, b) if len(a) > len(b) else (b, a)
        for i in range(len(longer)):
            for j in range(len(longer)):
                if i != j:
                    joined = fold(longer[i] + longer[j])
                    rest = tuple(w for k, w in enumerate(longer) if k not in (i, j))
                    best = max(best, _paired((*rest, joined), shorter, weight))
    return best


def _paired(a: tuple[str, ...], b: tuple[str, ...], weight) -> float:
    found = sorted(((word_likeness(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), key=lambda t: (-t[0], t[1], t[2]))
    got, total, ai, bj = 0.0, 0.0, set(), set()
    for s, i, j in found:
        if s and i not in ai and j not in bj:
            ai.add(i), bj.add(j)
            load = min(weight(a[i]), weight(b[j]))  # a misspelling is rarer than its word and must not weigh more
            got, total = got + s * load, total + load
    total += max(sum(weight(w) for i, w in enumerate(a) if i not in ai), sum(weight(w) for j, w in enumerate(b) if j not in bj))
    return got / total if total else 0.0
