import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from sparkloom.llm import quality_ledger, retrieval_packing  # noqa: E402
from sparkloom.llm._shared import staged, table  # noqa: E402


from test_line_chunks import deduplicated  # noqa: E402
from test_near_copies import by_row  # noqa: E402


def test_stages_against_plain_ones(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["quality", "toxicity", "line dedup", "near dedup", "packing"]

    rows = {r["doc_id"]: r for r in docs.collect()}
    passed = staged(pipeline.quality(spark, docs, sf_dir), "t1")
    v1 = quality_ledger.POLICIES["v1"]

    def fine(text):
        n, chars, symbols, dup, repeated, lines = quality_ledger.measure_text(text)
        return not (n < 50 or 100 * repeated > 50 * n or 10 * symbols > n or 2 * dup > lines or chars < 2 * n or chars > 14 * n)

    assert len(v1.rules) == 6 and {r["doc_id"] for r in passed.collect()} == {i for i, r in rows.items() if fine(r["text"])}

    mild = staged(pipeline.toxicity(spark, passed, sf_dir), "t2")
    toxic = {r["doc_id"] for r in table(spark, sf_dir, "labels").filter("toxic = 0").collect()}
    before = {r["doc_id"] for r in passed.collect()} & toxic
    assert len({r["doc_id"] for r in mild.collect()} & before) >= 0.98 * len(before)

    lines = staged(pipeline.line_dedup(spark, mild, sf_dir), "t3")
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == {i: t for (i, _), t in deduplicated([(r["doc_id"], r["text"]) for r in mild.collect()]).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = staged(pipeline.near_dedup(spark, lines, sf_dir), "t4")
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({c for _, c in by_row([(r["doc_id"], r["text"]) for r in lines.collect()])})

    packed = pipeline.packing(spark, near, sf_dir).collect()
    use = retrieval_packing.vocabulary(retrieval_packing.default_vocabulary())
    assert sum(p["length"] for p in packed) == sum(len(use.ids(r["text"])) + 1 for r in near.collect())
    for df in (passed, mild, lines, near):
        assert df.columns == names

    assert pipeline.run(spark, sf_dir).count() > 0


WORDS = "the heron stands by the old lock and waits for a fish that never comes while the river runs on under the bridge of stone and reeds".split()


def edge_cases(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, ids that repeat, columns whose names clash."""
    text = lambda k: "\n".join(" ".join(f"{w}{k}{i}" for w in WORDS) for i in range(4))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (None, text("n"), None, None, None)]
    rows += [(i, text(i), "en", "a", len(text(i))) for i in range(4, 9)] + [(4, text(4), "en", "a", len(text(4)))] * 2 + [(5, text("other"), "en", "b", 9)]
    rows += [(9, text(4), "en", "c", len(text(4))), (10, " ".join(f"w{i}" for i in range(100_000)), "en", "d", 1)]
    return spark.createDataFrame([(*r, 1.5, "x", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, keep_id boolean")


@pytest.mark.parametrize("number", range(5))
def test_edge_cases_of_each_stage(spark, sf_dir, number):
    name, stage = pipeline.STAGES[number]
    docs = edge_cases(spark)
    result = staged(stage(spark, docs, sf_dir), "edges")
    assert stage(spark, docs.limit(0), sf_dir).collect() == []
    rows = result.collect()
    if name == "packing":
        assert sum(r["start"] + r["length"] == r["doc_tokens"] for r in rows) == docs.count()
        return
    assert result.columns == docs.columns
    ids = sorted((r["doc_id"] for r in rows if r["doc_id"] is not None))
    if name == "quality":
        assert ids == [4, 4, 4, 5, 5, 6, 7, 8, 9, 10] and len(rows) == 11
    elif name == "toxicity":
        assert {1, 2, 3} <= set(ids) and {r["text"] for r in rows if r["doc_id"] == 1} == {None}
    elif name == "line dedup":
        assert len(rows) == docs.count()
        assert {r["text"] for r in rows if r["doc_id"] == 9} == {""} and {r["n_chars"] for r in rows if r["doc_id"] == 9} == {0}
        assert [r["text"] is None for r in rows if r["doc_id"] == 1] == [True]
    else:
        assert ids == [1, 4, 5, 5, 6, 7, 8, 10] and sum(r["doc_id"] is None for r in rows) == 1
