"""What the pipeline's stages hold at a time."""

import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ridgeline.llm import language_id, near_dup, packing, quality, vocab  # noqa: E402

SF = "/root/testdata/sf0.001"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_hold_texts_once_and_are_bounded(spark, monkeypatch):
    """300 texts of 50 KB, which are fewer rows than a batch may have."""
    spark.conf.unset(BYTES)
    text = "concat_ws(' ', transform(sequence(1, 5000), x -> concat('word', hash(id, x) % 100000)))"
    docs = spark.range(0, 300, 1, 1).selectExpr("id doc_id", f"{text} text", "'en' lang", "'s' source").localCheckpoint()
    whole = sum(len(r.text) for r in docs.collect())
    seen, through = [], type(docs).mapInArrow

    def watched(df, run, schema, *rest):
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
        seen.append([r.n for r in through(df, sizes, "n long").collect()])
        return through(df, run, schema, *rest)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    for name, stage in corpus_pipeline.STAGES:
        seen.clear()
        stage(spark, docs, SF)
        assert all(sum(n) < 1.2 * whole and max(n, default=0) < corpus_pipeline.BATCH_BYTES + 100_000 for n in seen), (name, seen)
        assert name == "pii" or max(map(sum, seen)) > whole, name


def test_a_set_limit_stays(spark):
    spark.conf.set(BYTES, str(1 << 20))
    corpus_pipeline.language_stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(20), SF)
    assert spark.conf.get(BYTES) == str(1 << 20)
    spark.conf.unset(BYTES)


def test_workers_let_go_of_other_stages_words(spark, monkeypatch):
    """The stages' functions, called in one process as by one worker: the packer's words are not kept through
    the others' tasks."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).select("doc_id", "text", "lang").localCheckpoint()
    runs = []
    through = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: runs.append(run) or through(df, run, schema))
    language_id.predict(docs, None), near_dup.sketch(docs), near_dup.shingle_sets(docs), quality.measure(docs)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a text of some words"])], ["doc_id", "text"])
    for run in runs:
        packing.id_bytes(vocab.default_path())
        assert list(run(iter([batch])))
        assert not packing.id_bytes.cache_info().currsize and not vocab.load.cache_info().currsize
    assert len(runs) == 4
