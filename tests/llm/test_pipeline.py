import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ridgeline.llm import queries  # noqa: E402
from ridgeline.llm.common import materialize  # noqa: E402
from tests.llm import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == names and set(after) <= set(before) and after
        if name == "quality":
            assert not any(brute.quality(t)[5] for t in after.values())
        if name == "near_dup":
            groups = brute.near_dup(list(before.items()))
            assert set(after) == {i for i, g in groups.items() if g[2]}
        if name == "pii":
            assert set(after) == set(before) and not any(brute.pii(t)[1] for t in after.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(after)


def test_run_matches_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_unusual_rows(spark):
    """Null ids, texts and languages, repeated ids with equal and other texts, columns with the stages' names."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, source, SF).collect()}
    good = [r for r in source.orderBy("doc_id").collect() if r.doc_id in kept][:6]
    a, b, c, d, e, f = (r.text for r in good)
    rows = [(1, a), (1, a), (2, b), (2, c), (None, a), (None, d), (None, d), (3, None), (4, ""), (5, c), (6, e), (7, f)]
    schema = "doc_id long, text string, lang string, kept string, score double, __id string, ambiguous string, rank int"
    docs = spark.createDataFrame([(i, t, None, "x", 0.5, "y", "z", 1) for i, t in rows], schema)
    once = corpus_pipeline.near_dup_stage(spark, docs, SF)
    assert once.columns == docs.columns
    got = [(r.doc_id, r.text) for r in once.collect()]
    ids = [i for i, _ in got]
    # 2 and 5 share a text, 2 with another text is one document; the copies without an id are one row.
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7] and [t for i, t in got if i is None] == [d]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.where("rank = 0"), SF).count() == 0, name
    assert {r.text for r in corpus_pipeline.pii_stage(spark, docs, SF).where("doc_id in (3, 4)").collect()} == {None, ""}
    packed = corpus_pipeline.packing_stage(spark, docs, SF)
    assert packed.where("piece = 0").count() == len(rows)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_queries_with_sql(spark):
    from tests.compare import connect, differences

    con = connect(SF)
    assert set(queries.oracle_sql()) <= set(queries.queries())
    for name, sql in queries.oracle_sql().items():
        assert not differences(queries.queries()[name](spark, SF), con, sql), name
