"""Per-document text statistics and the documents that are no natural prose.

All statistics of a document form a vector. For each language the robust mean and
covariance of prose are estimated over all documents: from medians and quartiles a
first core of documents is taken, then mean and covariance of the core are computed
again while the core is what lies near them. A document's squared Mahalanobis
distance is the sum of what each statistic adds to it: the distance tells prose from
the rest, and the parts tell the rest apart.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.runtime import cut, spread

STATS = (
    "log_words", "word_length", "token_length", "symbol_ratio", "digit_ratio", "end_punctuation", "common_words", "words_per_line",
    "marked_lines", "entry_lines", "field_lines", "top_line", "packed_size", "vowels", "odd_letters", "tags",
)
#: Least standard deviation of each statistic, for those that hardly vary in prose. Prose may be short: length tells little.
FLOOR = (1.5, 0.3, 0.5, 0.02, 0.02, 0.2, 0.04, 1.2, 0.05, 0.08, 0.05, 0.05, 0.05, 0.03, 0.02, 0.03)
#: Squared distance up to which a document belongs to the core that mean and covariance are taken of.
CORE = 30.0
#: Squared distance beyond which a document is no prose: prose typed carelessly or with a small list stays within it.
FAR = 130.0
LIST_SHARE = 1 / 3
ROUNDS = 3
SHRINK_DOCS = 200
#: Correlations count less by this share, so that statistics that go together in all documents leave the covariance regular.
SHRINK = 0.1

# Common words of the corpus' languages.
COMMON = {
    "en": """the a an and of to on is it at as was were for that what in with by has have had not this these those be been its from i there so all but no
        which could would should are up one since they them he she his her does do did about or you your we us our before after than then where when who how why if can will
        my me am most more some any each into over under near far only also while whether because until although such both yet even here now still just very
        said say says asked told left went took made seemed many few two three between past next along""",
    "fr": """le la les l de des du d et en un une est dans que qui sur pour pas au aux il elle a ce cette ces sont par mais nous vous ils ont avec plus ne se sa son
        ou où y on depuis sans tout deux entre été être fait comme était encore trop après avant""",
    "ar": """في إلى من أن على هل كان ثم مع لم وقد أو هذا هذه بين و قد عن ما لا كل غير بعد قبل التي الذي ذلك بسبب عند حتى لكن ولكن وهذا وهو وهي أمام خلف إن كله هنا هناك
        لنا مباشرة كانت يكون أكثر أقل أكبر حيث منذ مما سوى جدا لماذا عام بنسبة وأمامه وربما مرة أخرى فقط بجوار ولم يقع يقول""",
}
_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
_ANY = frozenset().union(*_COMMON.values())

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TAG = re.compile(r"<[/!?A-Za-z][^<>]*>")
_MARK = re.compile(r"^\s*(?:[-*•·–—+▪◦‣●○■□✓]|\[[ xX✓]?\]|\(?\d{1,3}[.)\]]|\(?[A-Za-z][.)]|[ء-ي][.)])\s+\S")
_END = re.compile(r"[.!?؟…。:]['\"”’)\]]*\s*$")
_SPLITS = {"|": re.compile(r"\|"), "│": re.compile(r"│"), "\t": re.compile(r"\t"), ";": re.compile(r";(?=\S)"), ",": re.compile(r",(?=\S)"), " ": re.compile(r"(?<=\S) {2,}(?=\S)")}


#: Bits of what a character is.
_SPACE, _DIGIT, _ALNUM, _ALPHA, _ASCII, _VOWEL, _ARABIC, _LATIN, _ODD = (1 << k for k in range(9))


@lru_cache(1)
def _character_bits() -> np.ndarray:
    """Bits of every character of the basic plane; those beyond count as symbols."""
    out = np.zeros(0x10000 + 1, dtype=np.uint16)
    for k in range(0x10000):
        c = chr(k)
        ascii_letter = c.isascii() and c.isalpha()
        out[k] = (
            _SPACE * c.isspace() | _DIGIT * c.isdigit() | _ALNUM * c.isalnum() | _ALPHA * c.isalpha() | _ASCII * ascii_letter | _VOWEL * (c.lower() in "aeiouy")
            | _ARABIC * (0x600 <= k <= 0x6FF) | _LATIN * (ascii_letter or 0xC0 <= k <= 0x24F) | _ODD * (0x80 <= k <= 0xDF or k == 0xFFFD)
        )
    return out


def _counts(text: str) -> dict[int, int]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bits = _character_bits()[np.minimum(codes, 0x10000)]
    return {b: int(np.count_nonzero(bits & b)) for b in (_SPACE, _DIGIT, _ALNUM, _ALPHA, _ASCII, _VOWEL, _ARABIC, _LATIN, _ODD)}


def language_of(has: dict[int, int], words: list[str]) -> str:
    """ar, en, fr or mixed, by script and common words; what has no letters counts with en."""
    arabic, latin = has[_ARABIC], has[_LATIN]
    if arabic and latin and min(arabic, latin) > 0.15 * (arabic + latin):
        return "mixed"
    if arabic > latin:
        return "ar"
    fr, en = (sum(len(w) > 1 and w in _COMMON[k] for w in words) for k in ("fr", "en"))
    return "fr" if fr > en and fr >= 0.15 * len(words) else "en"


def _share(lines: list[str], chosen: list[bool]) -> float:
    """Share of the chosen lines, by number or by length, whichever is less: a paragraph is one line, but much of a text."""
    if len(lines) < 3:
        return 0.0
    return min(sum(chosen) / len(lines), sum(len(x) for x, c in zip(lines, chosen) if c) / sum(map(len, lines)))


def _fields(lines: list[str]) -> float:
    """Share of lines that have the usual number of separators, for the separator that fits best."""
    best = 0.0
    if len(lines) >= 3:
        for name, sep in _SPLITS.items():
            if not any(("  " if name == " " else name) in x for x in lines):
                continue
            counts = [len(sep.findall(x.strip())) for x in lines]
            (often, n), *_ = Counter(c for c in counts if c).most_common(1) or [(0, 0)]
            if not often or n < 3:
                continue
            rows = [c == often for c in counts]
            if name in " ,;":  # fields are short, a sentence is not
                rows = [r and all(len(f.split()) <= 5 for f in sep.split(x.strip())) for r, x in zip(rows, lines)]
            best = max(best, _share(lines, rows))
    return best


def statistics(text: str) -> tuple[str, list[float]]:
    """Language and the vector of STATS of a text that is not blank."""
    words, tokens = _WORD.findall(text.lower()), text.split()
    lines = [x for x in text.splitlines() if x.strip()]
    n, k, has = max(1, len(text)), max(1, len(lines)), _counts(text)
    bare = len(text) - has[_SPACE] or 1
    common = sum(w in _ANY for w in words)
    marked = [bool(_MARK.match(x)) and len(x.split()) <= 10 for x in lines]
    entries = []
    for x, m in zip(lines, marked):
        own = _WORD.findall(x)
        entries.append(0 < len(own) <= 8 and (m or not _END.search(x)) and sum(w.lower() in _ANY for w in own) <= m)
    raw = text.encode()
    values = [
        np.log1p(len(words)),
        sum(map(len, words)) / max(1, len(words)),
        min(60.0, bare / max(1, len(tokens))),
        (len(text) - has[_SPACE] - has[_ALNUM]) / bare,
        has[_DIGIT] / bare,
        sum(bool(_END.search(x)) for x in lines) / k,
        common / max(1, len(words)),
        np.log1p(len(tokens) / k),
        _share(lines, marked),
        _share(lines, entries),
        _fields(lines),
        (Counter(lines).most_common(1)[0][1] - 1) / k if k > 3 else 0.0,
        min(1.0, (len(zlib.compress(raw, 6)) - 8) / (40 + len(raw) * 0.9)) if len(raw) > 40 else 0.5,
        has[_VOWEL] / has[_ASCII] if has[_ASCII] > 20 and has[_ASCII] > 0.5 * has[_ALPHA] else 0.4,
        has[_ODD] / n,
        1 - len(_TAG.sub("", text)) / n if "<" in text else 0.0,
    ]
    return language_of(has, words), [float(v) for v in values]


def part(*names: str) -> Column:
    """What the named statistics add to the squared distance."""
    return sum((F.col("parts")[STATS.index(n)] for n in names[1:]), F.col("parts")[STATS.index(names[0])])


def kind() -> Column:
    """list, table or junk of a document that lies far from prose, by what put it there; null for prose.

    A table's lines of separated fields alone put it out; of a list's distance its marked
    lines and short entries make up LIST_SHARE; whatever else lies out reads as no language.
    """
    table = part("field_lines") > FAR
    entries = part("marked_lines", "entry_lines") >= LIST_SHARE * F.col("d2")
    return F.when(F.col("d2") > FAR, F.when(table, "table").when(entries, "list").otherwise("junk"))


def document_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, x ARRAY<DOUBLE> of STATS) of each document with a text that is not blank; whole texts."""
    kind = dict(docs.select(key).dtypes)[key]
    rows = spread(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull()))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(k, *statistics(t)) for k, t in zip(b["_k"], b["_t"]) if t.strip()]
            yield pd.DataFrame(got, columns=[key, "language", "x"])

    return rows.mapInPandas(measure, f"`{key}` {kind}, language string, x array<double>")


Models = dict[str, tuple[np.ndarray, np.ndarray]]


def _parts(b: pd.DataFrame, models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a batch and what each statistic adds to their squared distances."""
    x = np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, len(STATS)))
    parts = np.zeros_like(x)
    language = b["language"].to_numpy()
    for k in set(language):
        own = language == k
        mean, inv = models[k]
        z = x[own] - mean
        parts[own] = z * (z @ inv)
    return x, parts


def _core_sums(stats: DataFrame, models: Models) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of the documents near the models, by language.

    Each task adds up its own documents; what leaves it is one number for each sum.
    """
    d = len(STATS)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            x, parts = _parts(b, models)
            near, language = parts.sum(axis=1) <= CORE, b["language"].to_numpy()
            for k in set(language):
                own = np.hstack([np.ones((int((m := near & (language == k)).sum()), 1)), x[m]])
                sums[k] = sums.get(k, 0) + own.T @ own
        rows = [(k, i, float(v)) for k, s in sums.items() for i, v in enumerate(s.ravel())]
        yield pd.DataFrame(rows, columns=["language", "i", "v"])

    added = stats.select("language", "x").mapInPandas(add, "language string, i int, v double").groupBy("language", "i").agg(F.sum("v").alias("v"))
    flat: dict[str, np.ndarray] = {}
    for r in added.collect():  # four languages by (d + 1)^2
        flat.setdefault(r.language, np.zeros((d + 1) ** 2))[r.i] = r.v
    whole = {k: v.reshape(d + 1, d + 1) for k, v in flat.items()}
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in whole.items() if m[0, 0] > 0}


def prose_models(stats: DataFrame) -> Models:
    """Robust mean and inverse covariance of prose by language, over all documents.

    A language with few documents leans on the covariance of all: its own counts as
    much as its documents do against SHRINK_DOCS.
    """
    d = len(STATS)
    q = [F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 1000) for i in range(d)]
    start = {r.language: np.array(r.q) for r in stats.groupBy("language").agg(F.array(*q).alias("q")).collect()}
    floor = np.array(FLOOR)
    models = {k: (v[:, 1], np.diag(1 / np.maximum((v[:, 2] - v[:, 0]) / 1.349, floor) ** 2)) for k, v in start.items()}
    for _ in range(ROUNDS):
        sums = _core_sums(stats, models)
        total = sum((n for n, _, _ in sums.values()), 0.0)
        if not total:
            return models
        within = sum(p - np.outer(s, s) / n for n, s, p in sums.values()) / total
        for k, (n, s, p) in sums.items():
            mean = s / n
            cov = ((p - n * np.outer(mean, mean)) + SHRINK_DOCS * within) / (n + SHRINK_DOCS)
            lift = np.maximum(0, floor**2 - np.diag(cov))
            cov = (1 - SHRINK) * (cov + np.diag(lift)) + SHRINK * np.diag(np.diag(cov) + lift)
            models[k] = (mean, np.linalg.inv(cov))
    return models


def with_distance(stats: DataFrame, models: Models) -> DataFrame:
    """stats with d2 and parts: what each statistic adds to d2."""
    shared = {k: (m.copy(), v.copy()) for k, (m, v) in models.items()}
    names = [f for f in stats.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", d2 double, parts array<double>"

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, parts = _parts(b, shared)
            b["d2"], b["parts"] = parts.sum(axis=1), list(parts)
            yield b

    return stats.drop("d2", "parts").mapInPandas(far, schema)


def prose_outliers(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, x, d2, parts, kind): every document that is not null or blank.

    parts: what each statistic adds to d2. kind: list, table, junk or null. Null, empty and blank texts are left out; repeated
    rows keep their own rows; a table without any text gives no rows.
    """
    stats = cut(document_statistics(docs, key=key, text=text))
    far = with_distance(stats, prose_models(stats))
    return far.withColumn("kind", kind())
