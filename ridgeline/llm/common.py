"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import filterfalse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of about this many bytes are held as Python objects at a time.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or, where that is unset
    (tests on one machine), a temporary folder that is then kept in the session's settings."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = spark.conf.get("spark.ridgeline.shared.dir", None)
    if not made:
        made = tempfile.mkdtemp(prefix="ridgeline-")
        spark.conf.set("spark.ridgeline.shared.dir", made)
    return made


#: Rows in an Arrow batch while intermediate tables are written: rows hold whole texts, and a batch exists
#: twice on its way to Python and back.
BATCH_ROWS = 2000


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of fewer rows than usual while something is written; the session's own setting, where it
    is smaller or anything else runs, is left as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage is cut, and the rows outlive
    the executors that made them. Tables lie in a folder of the application's, and can be deleted
    with it; `discard` deletes those that no result reads any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.__dict__["_written"] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables. No plan that is still to run may read them."""
    for t in tables:
        if path := t.__dict__.get("_written"):
            context = t.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts. Results that are maps over it run when the caller likes, and a plan has no batch
    size of its own: where the session has not been given one, it gets `BATCH_ROWS`. One that was set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def long_id(df: DataFrame, name: str):
    return df[name].cast("long").alias(name)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts the batches so that the texts in column number `text` stay near `most` bytes a slice."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(text)
        if column.nbytes <= most:
            yield batch
            continue
        lengths = pc.binary_length(column).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(lengths):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


class Recent(dict):
    """A dictionary of bounded size: when `limit` new keys have come, those not asked for since the
    last time are forgotten. `make` gives the value of an unknown key."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def learn(self, keys: set, make_all) -> None:
        """Puts all the keys in, those unknown with make_all's values; all are there until the next call."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        new = list(filterfalse(self.__contains__, keys))
        old = self.old
        known = list(filter(old.__contains__, new))
        self.update(zip(known, map(old.__getitem__, known), strict=True))
        if len(known) < len(new):
            missing = list(filterfalse(old.__contains__, new))
            self.update(zip(missing, make_all(missing), strict=True))


#: Functions whose values a Python worker keeps from task to task.
_KEPT: list = []


def kept(make):
    """`functools.cache`, until `let_go`."""
    found = cache(make)
    _KEPT.append(found)
    return found


def let_go() -> None:
    """Gives back what this Python worker keeps for an operator that it served before: workers outlive the stages
    of a pipeline, and what one stage keeps would stand beside the next one's memory."""
    if not any(f.cache_info().currsize for f in _KEPT):
        return
    for f in _KEPT:
        f.cache_clear()
    pa.default_memory_pool().release_unused()
    # Only glibc holds freed memory back in this way, and has this function.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def held_out(doc_id: F.Column, parts: int, part: int) -> F.Column:
    """Whether crc32 of the id as text leaves `part` when divided by `parts`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts) == F.lit(part), F.lit(False))
