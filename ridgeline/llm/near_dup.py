"""Operator 10: near-duplicates by SuperMinHash.

A document's set holds the 64-bit hashes of its distinct five-word shingles (a shorter text's whole
sequence is its one shingle). Each element deals out the slots of a signature in an order of its own:
the slot that it reaches at step j gets at most j plus a fraction. Steps end as soon as no slot can
improve. Signatures are cut into bands; documents that share a band are candidates, candidates are
confirmed on their full sets, and confirmed links are joined to groups by union-find.

How work stays in proportion to the input:
* equal sets are one class with one representative before any banding, so exact copies never pair;
* every representative is first compared with one other, the smallest first member of its buckets whose
  size fits, which joins most of a group of near copies in one step, whatever its size;
* documents of buckets that are then still in several groups are joined across groups by prefix
  filtering on their full sets: exact, and blind to what very many of them have in common, so neither a
  passage that documents share nor a large group of distant copies makes all its pairs. A shingle that only
  one group has joins nothing, and a frequent one is dealt out over tasks.
With 42 bands of 5 rows, a pair at similarity 0.75 shares no band in 1 of 90,000 cases, at 0.8 in 1 of
20 million. No bucket, group or list of candidates is capped, sampled or held by one task or the driver.

Union-find is distributed: rounds of links to the smallest neighbour, from both sides, until nothing
changes; tables between rounds are written to the shared folder.

Texts without words and null texts have an empty set and are linked with nothing. A repeated id comes
back once for each of its rows; if its texts differ it is linked with what any of them is like, in whatever
order the rows come. A row without an id is linked with nothing and has no component. Columns other than the
id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import Recent, discard, let_go, materialize, slices, struct, table

BANDS, BAND_ROWS = 42, 5
SLOTS = BANDS * BAND_ROWS
SHINGLE, LEAST, MOST = 5, 75, 100  # links: 100 * common >= 75 * all
#: Elements whose slot orders are held at a time.
BLOCK = 1 << 15
#: Sizes na and nb that allow the similarity.
FITS = f"least(na, nb) * {MOST} >= greatest(na, nb) * {LEAST}"
#: Sets that a shingle's key holds before it is dealt out.
CROWD = 1000
UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Shingler:
    def __init__(self, known: int = 200_000):
        self.words = Recent(xxhash.xxh64_intdigest, known)

    def __call__(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingles of a lower-cased text."""
        words = self.words
        ids = np.array([words[w] for w in text.split()], dtype=np.uint64)
        if not len(ids):
            return ids
        n = max(1, len(ids) - SHINGLE + 1)
        h = np.full(n, min(len(ids), SHINGLE), dtype=np.uint64)
        for k in range(min(len(ids), SHINGLE)):
            h = mix(h + ids[k : k + n])
        return np.unique(h)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of 64-bit slots for each set: step number above, fraction below. Empty sets stay unset."""
    out = np.full((len(sets), slots), UNSET, dtype=np.uint64)
    order = sorted((i for i, s in enumerate(sets) if len(s)), key=lambda i: len(sets[i]))
    at = 0
    while at < len(order):
        end, held = at, 0
        while end < len(order) and (not held or held + len(sets[order[end]]) <= BLOCK):
            held += len(sets[order[end]])
            end += 1
        rows = np.array(order[at:end])
        out[rows] = _block([sets[i] for i in rows], slots)
        at = end
    return out


def _block(sets: list[np.ndarray], slots: int) -> np.ndarray:
    sig = np.full(len(sets) * slots, UNSET, dtype=np.uint64)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    dealt = None
    for step in range(slots):
        draw = mix(element + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        # Step `step` of a shuffle: swap this place with one at or after it.
        pick = step + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        if dealt is None:
            slot = pick
        else:
            row = np.arange(len(element)) * slots
            slot = dealt[row + pick].astype(np.int64)
            dealt[row + pick] = dealt[row + step]
            dealt[row + step] = slot
        np.minimum.at(sig, owner * slots + slot, np.uint64(step) << np.uint64(32) | draw >> np.uint64(32))
        # A set whose slots all lie below the next step is done.
        open_ = (sig.reshape(-1, slots) >= np.uint64(step + 1) << np.uint64(32)).any(axis=1)
        live = open_[owner]
        if not live.any():
            break
        if not live.all() or dealt is None:
            element, owner = element[live], owner[live]
            if dealt is None:
                dealt = np.tile(np.arange(slots, dtype=np.uint16), len(element))
                row = np.arange(len(element)) * slots
                dealt[row + slot[live]] = 0
                dealt[row] = slot[live]
            else:
                dealt = dealt.reshape(-1, slots)[live].reshape(-1)
    return sig.reshape(-1, slots)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature, different between bands."""
    parts = sig.reshape(len(sig), BANDS, BAND_ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for k in range(BAND_ROWS):
        h = mix(h + mix(parts[:, :, k]))
    return h.view(np.int64)


def _lower(column: pa.Array) -> list[bytes]:
    return [t.lower() if t else b"" for t in column.cast(pa.binary()).to_pylist()]


def sketch(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest (equal for equal sets, null for empty ones) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        shingles = Shingler()
        for b in slices(batches):
            sets = [shingles(t) for t in _lower(b.column(1))]
            keys = band_keys(signatures(sets))
            digest = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), bands], ["doc_id", "n_shingles", "digest", "bands"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, struct(("doc_id", T.LongType()), ("n_shingles", T.LongType()), ("digest", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))))


def shingle_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its full set, as an array of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        shingles = Shingler()
        for b in slices(batches):
            sets = [shingles(t).view(np.int64) for t in _lower(b.column(1))]
            offsets = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["doc_id", "shingles"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, struct(("doc_id", T.LongType()), ("shingles", T.ArrayType(T.LongType()))))


def sets_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The full sets of the documents whose doc_id is in `wanted`, made again from their texts: doc_id, d (a
    number of the set) and shingles. An id that has several texts has all their sets."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = shingle_sets(ids.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")).where(F.size("shingles") > 0)
    return materialize(found.withColumn("d", F.xxhash64("shingles")).dropDuplicates(["doc_id", "d"]), "sets")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of which any two full sets are similar enough."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(two, "b").join(one, "a").where(MOST * both >= LEAST * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def prefixes(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """x, doc_id, n, at, c: the shingles by which a set can meet another, with their place in the set (rarest
    first, those of this set alone before all others) and the set's group. Shingles that only one group has are
    left out."""
    each = materialize(sets.select("doc_id", "d", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("x")), "shingles")
    often = each.groupBy("x").agg(F.count("*").alias("f")).where("f > 1")
    by_rarity = Window.partitionBy("doc_id", "d").orderBy("f", "x")
    placed = each.join(often, "x").withColumn("k", F.row_number().over(by_rarity)).withColumn("own", F.count("*").over(Window.partitionBy("doc_id", "d")))
    placed = placed.withColumn("at", F.col("k") + F.col("n") - F.col("own")).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * LEAST / MOST) + 1)
    placed = materialize(placed.join(groups, "doc_id").select("x", "doc_id", "n", "at", "c"), "prefixes")
    several = placed.groupBy("x").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("x")
    out = materialize(placed.join(several, "x"), "prefixes")
    discard(each, placed)
    return out


def across(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of different groups among the sets, by prefix filtering: with shingles in order
    of frequency, rarest first, two sets as similar as asked share one among the first of each, and at a
    place that leaves room for all that they must share.

    What can be said of one set alone is asked before pairs are made: of two sets the smaller one must share
    2 * LEAST / (LEAST + MOST) of its shingles, so it meets others by its first seventh, the larger by its first
    quarter; sizes meet by steps of a third, a set's own and the next. So documents that have three quarters in
    common, but less than makes a link, meet nobody by that. A shingle of very many sets is dealt out by salt."""
    placed = prefixes(sets, groups)
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(MOST / LEAST)).cast("int")
    small = placed.where(F.col("n") * 2 * LEAST <= (F.col("n") - F.col("at") + 1) * (LEAST + MOST)).withColumn("step", F.explode(F.array(step, step + 1)))
    large = placed.withColumn("step", step)
    # So many parts of a key's smaller sets as keep each part to CROWD.
    parts = small.groupBy("x", "step").agg(F.ceil(F.count("*") / CROWD).alias("parts")).where("parts > 1")
    small = small.join(parts, ["x", "step"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))))
    large = large.join(parts, ["x", "step"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)))
    side = lambda rows, z: rows.select("x", "step", "salt", F.col("doc_id").alias(z), F.col("n").alias(f"n{z}"), F.col("at").alias(f"at{z}"), F.col("c").alias(f"c{z}"))
    room = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) + 1
    needed = (F.col("na") + F.col("nb")) * LEAST <= room * (LEAST + MOST)
    # Equal sizes stand on both sides: each such pair is made once.
    once = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    pairs = side(small, "a").join(side(large, "b"), ["x", "step", "salt"]).where("ca <> cb").where(once).where(FITS).where(needed)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for all nodes of the links (a, b)."""
    edges = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "links")
    last = None
    while True:
        # Each node's neighbours beyond it move to the smallest node it knows, then so do those below it.
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).where("u <> v").distinct()
        edges, before = materialize(small, "links"), edges
        discard(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))


def same_ids(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of classes that hold different texts of one id."""
    several = full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    held = full.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(classes, "digest").select("doc_id", F.col("rep").alias("b"))
    return held.join(held.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").where("a <> b").select("a", "b")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's smallest id) of every row."""
    sketches = materialize(sketch(docs, id_col, text_col), "sketches")
    full = sketches.where("digest is not null and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    entries = reps.select(F.explode("bands").alias("band"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    shared = entries.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("first"), F.count("*").alias("members")).where("members > 1").select("band", "first")
    entries = materialize(entries.join(shared, "band"), "buckets")
    # Each representative is compared with the smallest first member of its buckets that may be similar.
    near = entries.select(F.col("first.rep").alias("a"), F.col("rep").alias("b"), F.col("first.n").alias("na"), F.col("n").alias("nb")).where("a <> b").where(FITS)
    pairs = materialize(near.groupBy("b").agg(F.min("a").alias("a")), "pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, id_col, text_col)
    links = materialize(confirm(pairs, sets).unionByName(same_ids(full, classes)), "confirmed")
    discard(sets, pairs)
    found = components(links)
    # Buckets that this has not made one group, and an exact join of their members across groups.
    placed = entries.select("band", "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
    rest = materialize(placed.join(mixed, "band").select(F.col("rep").alias("doc_id"), "c").distinct(), "mixed")
    discard(entries, found)
    sets = sets_of(rest, docs, id_col, text_col)
    more = materialize(confirm(materialize(across(sets, rest), "cross"), sets), "confirmed")
    discard(sets, rest)
    found = components(links.unionByName(more))
    labelled = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("c"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(labelled, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))


#: The same by comparing all pairs that share a shingle, for DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM t WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS x FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT node, min(other) AS c FROM r GROUP BY node)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, t.doc_id = m.c AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN m ON m.node = t.doc_id
"""
