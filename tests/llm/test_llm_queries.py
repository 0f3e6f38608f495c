import pytest

from hexloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_finds_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows and len(set(map(str, rows))) == len(rows)


def test_statistics_show_what_decides(spark, data):
    """The parts of a distance add up to it, and the kinds found are those of the statistics."""
    stats = {r.doc_id: r for r in QUERIES["p10_statistics"](spark, data).collect()}
    for r in stats.values():
        d = r.asDict()
        assert abs(sum(v for k, v in d.items() if k.startswith("part_")) - r.d2) <= 1e-6 * max(1.0, abs(r.d2))
    found = {(r.doc_id, r.kind) for r in QUERIES["p10_found"](spark, data).collect()}
    assert found == {(k, r.kind) for k, r in stats.items() if r.kind} and {k for _, k in found} == {"list", "table", "junk"}


def test_leaks_hold_half_of_the_item(spark, data):
    rows = QUERIES["p9_shares"](spark, data).collect()
    assert min(r.share for r in rows) >= 0.5 and {(r.doc_id, r.item_id) for r in rows} == {tuple(r) for r in QUERIES["p9_found"](spark, data).collect()}


def test_ids_decode_to_the_text(spark, data):
    from hexloom.llm.tokens import decode_ids
    from hexloom.runtime import table

    text = {r.doc_id: r.text or "" for r in table(spark, data, "documents").select("doc_id", "text").collect()}
    rows = QUERIES["p8_ids"](spark, data).collect()
    assert len(rows) == len(text) and all(decode_ids(r.ids) == text[r.doc_id] for r in rows)


def test_groups_and_pairs_agree(spark, data):
    group = {r.entry: (r.batch, r.group) for r in QUERIES["p6_groups"](spark, data).collect()}
    pairs = {tuple(r) for r in QUERIES["p6_found"](spark, data).collect()}
    assert all(group[a] == group[b] and a < b for a, b in pairs)


def test_confident_pairs_are_near(spark, data):
    pairs = {(r.place_id_1, r.place_id_2): r for r in QUERIES["p3_pairs"](spark, data).collect()}
    found = [tuple(r) for r in QUERIES["p3_found"](spark, data).collect()]
    assert found and all(pairs[k].metres <= 500 and 0 <= pairs[k].confidence <= 1 for k in found)


COLUMNS = {"p3_found": ["place_id_1", "place_id_2"], "p6_found": ["entry_1", "entry_2"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind"]}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, data, name):
    assert QUERIES[name](spark, data).columns == COLUMNS[name]
