import random

import numpy as np
import pytest

from hexloom.llm import leaks, quality
from hexloom.llm import tokens as T

DOC = "doc_id long, text string, ids string, x string, _k int, language string, share int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "", "", 0, "", 0) for i, t in rows], DOC)


MIXED = ["", "a", " \n\n x", "Hello world's  end <|endoftext|>", "سلام عليكم، صيدلية", "🍕🍕 naïve 12,5% ‏\t\r\n", "x" * 900, " " * 300 + "y", "word " * 400, "\n\n\n".join("line %d of it" % i for i in range(200)), "ab̀" * 100]


@pytest.fixture(scope="module")
def vocabulary():
    import os

    if not os.path.exists(T.vocabulary_path()):
        pytest.skip("no vocabulary here")
    return T.vocabulary_path()


def test_chunks_give_the_ids_of_the_whole(spark, vocabulary):
    rnd = random.Random(1)
    rows = list(enumerate(MIXED)) + [(50, None), (51, "".join(rnd.choice(["a", "b ", "  ", "\n", "'s", "é", "7", "!", "word"]) for _ in range(3000))), (0, "again"), (None, "no id")]
    got = T.encode_texts(docs(spark, rows), key="doc_id", text="text", chunk=100, overlap=30).collect()
    want = sorted((i is None, i or 0, T.encoder(vocabulary).encode_ordinary(t) if t else []) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in got) == want
    for i, t in rows:
        if t:
            assert t in [T.decode_ids(r.ids) for r in got if r.doc_id == i]
    assert T.encode_texts(docs(spark, []), key="doc_id", text="text").collect() == []


def test_long_texts_come_in_pieces(vocabulary):
    """With the query's own lengths a long text is cut, at shared boundaries only."""
    from concurrent.futures import ThreadPoolExecutor

    rnd = random.Random(2)
    text = "".join(rnd.choice(["a", "b ", "  ", "\n", "'s", "é", "7", "!", "word ", "سلام "]) for _ in range(40000))
    with ThreadPoolExecutor(2) as pool:
        got = T.pieces(text, T.CHUNK_CHARS, T.OVERLAP_CHARS, pool)
        assert len(got) > 5 and "".join(got) == text and max(map(len, got)) <= T.CHUNK_CHARS
        assert [e for p, o in zip(got, np.cumsum([0, *map(len, got)])) for e in (b + int(o) for b in T.boundaries(p))] == T.boundaries(text)
        assert T.pieces("x" * 50000, T.CHUNK_CHARS, T.OVERLAP_CHARS, pool) == ["x" * 50000]  # one word: nothing to cut at
        assert T.pieces("", 100, 10, pool) == [""]


def test_same_as_the_library(vocabulary):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary.replace(".tiktoken", ".json"))
    lib.encode_special_tokens = True
    for t in MIXED:
        assert lib.encode(t, add_special_tokens=False).ids == T.encoder(vocabulary).encode_ordinary(t)


ITEM = "In 1197 the damp vault of Dhishasu replaced honey and ledgers beside Khudhughu, unless Huthihu counted its jetty. Darafi weighed 180 salt along the damp orchard, unless the harbour of Huwiri inherited arid linen across from Thisami."
SHORT = "Glass from Gharidu leased the eastern kiln beneath Jadhiza because 57 salt of Yadisa leased a loom."
FILL = "Prices here are fair and the staff is friendly but the square is hard to find at night when nobody is about. " * 20


def words(t, a, b):
    return " ".join(t.split()[a:b])


def test_leaks(spark):
    altered = " ".join("zzz" if i % 8 == 7 else w for i, w in enumerate(ITEM.split()))
    rows = [
        (1, FILL + ITEM + FILL), (2, FILL + ITEM.upper().replace(" ", "\n") + FILL), (3, "x " * 5000 + altered + FILL), (4, FILL + words(ITEM, 0, 20) + " . " + FILL), (5, words(ITEM, 0, 12) + " " + FILL + words(ITEM, 20, 32)),
        (6, FILL + words(ITEM, 3, 9) + FILL), (7, None), (8, ""), (9, " \n "), (10, "<b>" + SHORT.replace(" ", "</b> <i>") + "</i>"), (11, SHORT.replace("e", "e​")), (12, FILL), (13, " ".join(reversed(ITEM.split()))), (1, FILL + ITEM),
    ]
    items = spark.createDataFrame([(70, ITEM, 0), (71, SHORT, 0), (72, None, 0), (73, "", 0), (None, ITEM, 0), (71, SHORT, 0)], "item_id long, text string, share int")
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaked_items(docs(spark, rows), items).collect())
    assert got == [(1, 70), (2, 70), (3, 70), (4, 70), (5, 70), (10, 71), (11, 71)]
    none = items.limit(0)
    assert leaks.leaked_items(docs(spark, rows), none).collect() == [] and leaks.leaked_items(docs(spark, []), items).collect() == []


def test_sketches_miss_no_contained_item(spark):
    """The candidate search against exact containment: half an item, every seventh word altered, within a long text."""
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([17, 30, 60, 100, 400, 1500])))) for i in range(60)]
    texts, want = [], set()
    for k in range(200):
        i, t = rnd.choice(items)
        w = t.split()
        part = w[: len(w) // 2 + 1]
        for j in range(rnd.randrange(7), len(part), 7):
            part[j] = "altered"
        lead = [rnd.choice(vocab) for _ in range(rnd.randint(0, 900))]
        texts.append((k, k, " ".join(lead + part + lead[::-1])))
        want.add((k, i))
    few = [(1000 + i, 1000 + i, f"{words(t, 5, 8)} " + " ".join(rnd.choice(vocab) for _ in range(300))) for i, t in items]  # one shingle each
    pairs, _, _ = leaks.candidates(spark.createDataFrame(texts + few, "_n long, _d long, _t string"), spark.createDataFrame(items, "i long, t string"))
    found = {tuple(r) for r in pairs.collect()}
    assert len(want & found) >= 0.98 * len(want)
    assert sum(n >= 1000 for n, _ in found) <= 0.2 * len(few)


def test_the_estimate_decides(spark, monkeypatch):
    monkeypatch.setattr(leaks, "LEAST_SLOTS", leaks.SLOTS + 1)
    items = spark.createDataFrame([(70, ITEM)], "item_id long, text string")
    assert leaks.leaked_items(docs(spark, [(1, FILL + ITEM)]), items).collect() == []


def test_estimates_follow_the_containment():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    for share in (0.3, 0.6, 1.0):
        got = []
        for _ in range(30):
            item = [rnd.choice(vocab) for _ in range(128)]
            doc = leaks.word_hashes(item[: int(share * 128)] + [rnd.choice(vocab) for _ in range(256 - int(share * 128))])
            _, keys = leaks.block_keys([doc], np.full(1 << (leaks.TABLE_BITS - 3), 255, dtype=np.uint8), list(range(len(leaks.SIZES))))
            got.append(leaks.estimate(len(set(keys.tolist()) & set(leaks.item_keys(leaks.word_hashes(item)).tolist()))))
        assert abs(np.mean(got) - share) <= 0.12


def test_many_runs_and_stretches():
    """No limit on how many runs or stretches are looked at."""
    item = [f"i{k}" for k in range(120)]
    doc = []
    for k in range(0, 120, 5):
        doc += item[k : k + 5] + [f"x{j}" for j in range(9)] + item[:2] * 30
    assert leaks.held_share(leaks.word_hashes(item), leaks.word_hashes(doc)) == 1.0
    assert leaks.held_share(leaks.word_hashes(item), leaks.word_hashes(item[::-1])) == 0.0


PROSE = "The bakery beside the market closed in the spring and nobody on the street seemed surprised. We walked the lane from end to end and counted %d doors that were open for business. Prices near the square are fair, but the staff is not always there when you ask. "
LIST = "Places to check:\n" + "\n".join(f"- Dina{c} Rafu{c} Cafe" for c in "abcdefghij")
TABLE = "name,count,lat\n" + "\n".join(f"Rafi{c} Dun,{i * 7},{20 + i}.5" for i, c in enumerate("abcdefghij"))


def test_kinds(spark):
    rnd = random.Random(6)
    prose = [(i, PROSE % i * rnd.randint(1, 4)) for i in range(150)]
    other = {
        900: ("list", LIST), 901: ("table", TABLE), 902: ("table", TABLE.replace(",", "\t")), 903: ("junk", "ok\n" * 200), 904: ("junk", " ".join("".join(rnd.choice("bcdfghjklmnp") for _ in range(8)) for _ in range(60))),
        905: ("junk", "".join(rnd.choice("{}[]<>|!#$%&*") for _ in range(400))), 906: ("junk", '<div class="a"><span></span></div>' * 40), 907: ("junk", "".join(rnd.choice("abcdEFGH0123+/") for _ in range(300))),
    }
    keep = {800: PROSE % 3 + "\n" + LIST[:60], 801: "We closed early.", 802: (PROSE % 4).lower().replace(".", ""), 803: "\n".join((PROSE % 5)[i : i + 50] for i in range(0, 250, 50))}
    rows = prose + [(k, t) for k, (_, t) in other.items()] + list(keep.items()) + [(700, None), (701, ""), (702, " \n")]
    got = {r.doc_id: r for r in quality.prose_outliers(docs(spark, rows)).collect()}
    assert set(got) == {k for k, t in rows if t and t.strip()}
    assert {k: got[k].kind for k in other} == {k: kind for k, (kind, _) in other.items()}
    assert [k for k, r in got.items() if r.kind and k not in other] == []
    assert all(abs(sum(r.parts) - r.d2) <= 1e-6 * max(1, abs(r.d2)) for r in got.values())
    assert quality.prose_outliers(docs(spark, [(1, None)])).collect() == []


def test_the_distance_decides(spark):
    """One text is an outlier where prose is prose, and none where the documents around it are of its kind."""
    rnd = random.Random(7)
    gram = lambda: " ".join("".join(rnd.choice("bcdfghjklmnp") for _ in range(8)) for _ in range(60))
    own = gram()
    prose = [(i, PROSE % i * rnd.randint(1, 4)) for i in range(150)] + [(999, own)]
    noise = [(i, gram()) for i in range(150)] + [(999, own)]
    of = lambda rows: {r.doc_id: r for r in quality.prose_outliers(docs(spark, rows)).collect()}[999]
    a, b = of(prose), of(noise)
    assert a.kind == "junk" and a.d2 > quality.FAR and b.kind is None and b.d2 <= quality.FAR


def test_the_parts_decide(spark):
    parts = lambda **k: [float(k.get(s, 0)) for s in quality.STATS]
    rows = [(1, parts(field_lines=300, digit_ratio=900)), (2, parts(marked_lines=60, entry_lines=60, common_words=90)), (3, parts(entry_lines=150, top_line=800)), (4, parts(entry_lines=80, marked_lines=40)), (5, parts())]
    df = spark.createDataFrame([(i, p, sum(p)) for i, p in rows], "i int, parts array<double>, d2 double")
    assert [r.kind for r in df.withColumn("kind", quality.kind()).orderBy("i").collect()] == ["table", "list", "junk", None, None]
