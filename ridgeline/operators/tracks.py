"""Running a NumPy kernel on every track: one grouped Arrow call a track.

Tracks are dealt out by `track_id` to as many partitions as the session shuffles into. That number is given
explicitly, because the work is in the kernels, not in the bytes by which adaptive execution would merge
partitions; the grouped call needs no further shuffle. Only the columns that a kernel reads are sent.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ridgeline.schema import FIELDS, POINTS, default, points

KEY = [T.StructField("track_id", T.StringType())]


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out by track, whatever their bytes: for folds, whose cost is in their steps."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "track_id")


def by_track(df: DataFrame):
    return dealt(df).groupBy("track_id")


def ordered(table: pa.Table) -> pa.Table:
    seq = table.column("seq").to_numpy()
    if (seq[1:] >= seq[:-1]).all():
        return table
    return table.take(pc.sort_indices(table, sort_keys=[("seq", "ascending")]))


def arrays(table: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    """The columns as numbers, NaN for null."""
    out = {}
    for n in names:
        c = table.column(n)
        c = c if pa.types.is_float64(c.type) else c.cast(pa.float64())
        out[n] = (pc.fill_null(c, np.nan) if c.null_count else c).to_numpy().copy()
    return out


def map_tracks(df: DataFrame, kernel: Callable) -> DataFrame:
    """Point table to point table: kernel(track) -> track. Points are numbered anew from 0."""
    schema = to_arrow_schema(POINTS)

    def run(table: pa.Table) -> pa.Table:
        t = kernel(arrays(ordered(table), FIELDS))
        n = len(t["latitude"])
        return pa.table([pa.array([table.column("track_id")[0].as_py()] * n, pa.string()), pa.array(np.arange(n)), *(pa.array(t[f], pa.float64()) for f in FIELDS)], schema=schema)

    return by_track(points(df)).applyInArrow(run, POINTS)


def add_columns(df: DataFrame, reads: list[str], writes: list[str], kernel: Callable) -> DataFrame:
    """Fills columns of the points: kernel(arrays of `reads`) -> arrays of `writes`; every other column
    passes beside it."""
    rest = [c for c in df.columns if c not in writes]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(w, T.DoubleType()) for w in writes])

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table)
        made = kernel(arrays(table, reads))
        return pa.table([table.column(c) for c in rest] + [pa.array(made[w], pa.float64()) for w in writes], names=[*rest, *writes])

    return by_track(df).applyInArrow(run, schema)


def summarize(df: DataFrame, reads: list[str], fields: str, kernel: Callable) -> DataFrame:
    """track_id with the rows (dictionaries) that kernel(arrays of `reads`) returns."""
    schema = T.StructType([*KEY, *T._parse_datatype_string(fields).fields])
    arrow, names = to_arrow_schema(schema), [f.name for f in schema.fields[1:]]

    def run(table: pa.Table) -> pa.Table:
        rows = kernel(arrays(ordered(table), reads))
        rows = rows if isinstance(rows, list) else [rows]
        key = table.column("track_id")[0].as_py()
        return pa.Table.from_pylist([{"track_id": key, **{n: r[n] for n in names}} for r in rows], schema=arrow)

    have = set(df.columns)
    picked = df.select(F.col("track_id").cast("string"), "seq", *[(F.col(c).cast("double") if c in have else F.lit(default(c))).alias(c) for c in reads])
    return by_track(picked).applyInArrow(run, schema)


def renumbered(df: DataFrame) -> DataFrame:
    """seq from 0 without gaps, in the same order."""
    from ridgeline.operators.windows import in_order

    return df.withColumn("seq", F.row_number().over(in_order()).cast("long") - 1)
