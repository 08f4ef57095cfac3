"""From raw documents to packed training sequences: quality rules, language identification,
near-duplicate removal, masking of personal data, packing.

Every stage works on all rows that the one before kept. All but the last return the columns of
`documents`, whatever further columns there are and whatever their names; the last returns the pieces of the
packed sequences. What each stage does with unusual rows:

* null or empty texts have no words: the quality rules reject them. The other stages, run alone, leave them:
  language identification rejects them (no letter), near-duplicate removal keeps each, masking leaves null null
  and empty empty, packing gives each one piece with the closing id;
* texts of any length are read whole;
* a null id is no reason to go: quality and language look at the text alone, near-duplicate removal compares
  such rows like all others and prefers rows with an id to stay, packing returns the piece with a null id;
* rows that repeat, id and text, are copies: one stays. An id with different texts is one document to the
  near-duplicate stage, of which one row stays: the one whose text comes first by its hash;
* ties (copies) go to the smallest id; empty tables give empty tables; columns `lang` and `n_chars` may be
  missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm import language_id, near_dup, packing, pii, quality
from ridgeline.llm.common import held_out, materialize, table

ROW = "__row"
#: Ids of rows without one, in the near-duplicate stage: above all others, so that these rows give way.
NO_ID = 1 << 62
#: Bytes in an Arrow batch of a session that has no limit of its own: all stages share the executors' memory, which
#: keeps what the largest batches took.
BATCH_BYTES = 2 << 20


def _bounded(spark: SparkSession) -> None:
    """Results run when the caller likes, so the limit of a batch's bytes stays in the session's settings."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def _whole(docs: DataFrame) -> DataFrame:
    """Each row with its columns but the text packed in one, beside the text and what else a stage reads: whole
    texts go to Python and back once."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return docs.select("doc_id", "text", lang, F.struct(*[c for c in docs.columns if c != "text"]).alias(ROW))


def _rows(whole: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows with the columns of `docs`."""
    text = F.col("text").cast(docs.schema["text"].dataType) if "text" in docs.columns else None
    return whole.select(*[(text if c == "text" else F.col(ROW).getField(c)).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their stratum's cutoffs reject go."""
    _bounded(spark)
    measured = materialize(quality.measure(_whole(docs), keep=("lang", ROW), keep_text=True), "stage-quality")
    cutoffs = quality.thresholds(measured.drop(ROW, "text"), table(spark, sf_dir, "labels"))
    return _rows(quality.judge(measured, cutoffs).where("kept"), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose codeword is as near to another language's, go."""
    _bounded(spark)
    whole = _whole(docs)
    model = language_id.fit(whole.drop(ROW).where(~held_out(F.col("doc_id"), 5, 0)))
    found = language_id.predict(whole, model, keep=(ROW,), keep_text=True)
    return _rows(found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")), docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the smallest id."""
    _bounded(spark)
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID)))
    whole = docs.select(number.alias("__id"), F.col("text").alias("__text"), F.struct(*docs.columns).alias(ROW))
    kept = near_dup.group(whole, "__id", "__text").where("kept").select(F.col("doc_id").alias("__id")).distinct()
    stay = whole.join(kept, "__id", "left_semi")
    repeated = materialize(whole.groupBy("__id").count().where("count > 1").select("__id"), "repeated")
    if not repeated.count():
        return stay.select(f"{ROW}.*")
    first = Window.partitionBy("__id").orderBy(F.xxhash64("__text"), F.xxhash64(ROW))
    again = stay.join(repeated, "__id", "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return stay.join(repeated, "__id", "left_anti").select(f"{ROW}.*").unionByName(again.select(f"{ROW}.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text."""
    masked = pii.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    _bounded(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dup", near_dup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The stages learn from data and search for groups, which SQL doesn't express; tests/llm compares the rows of
#: run() with those of plain versions, chained.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
