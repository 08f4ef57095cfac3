"""Operator 1: language-model scoring by context-tree weighting.

Text is modelled as its lower-cased words, each followed by a blank, and one closing byte. Every byte
is coded as eight binary decisions; for each decision there is a tree of contexts, the bytes before it
in the whole text (blanks before its start), up to `DEPTH` bytes, so contexts run on from word to word.
Each node of a tree has a Krichevsky-Trofimov estimate, and nodes of all depths are mixed with the
weights that the training text earns them: a node's block probability is half its own estimate, half
the product of its children.

All counts come from all training texts:
* one pass counts distinct words, `(word, times)`, for the base score;
* one pass unrolls whole texts to `(context, byte, times)`, sums them in each task and then over all;
  from each depth they are summed again to the one above; every depth is a table of its own, sorted by
  context, over which weights are computed in numpy runs. Nothing of it is collected;
* mixed probabilities flow down from the root by joins on the shorter context;
* workers hold the most frequent rows of the deepest table (at most `HELD`), and look up every byte of every
  text there; what they don't hold is joined, summed by text, with the rest of the table.

Texts' words are looked up in the same pass: the most frequent words (at most `HEAD`) in a broadcast table,
longer ones by a digest; all others are sent, summed by document, to their word's partition. So no key that
is joined is one that very many texts share.

A null or empty text has one token, its end. Rows that repeat, id and text, come back as often. A null
id counts as training. Columns other than id and text are not read. Without training rows every
estimate is that of an empty tree.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import discard, held_out, materialize, slices, struct, table

DEPTH = 6
#: Words that are broadcast, the length from which a digest stands for them, and distinct words counted before
#: they are passed on.
HEAD, HEAD_BYTES, COUNTED = 131_072, 64, 150_000
#: Rows of the deepest table that workers hold, 16 to 20 bytes each.
HELD = 6_000_000
#: Bytes of text counted and looked up at a time, and rows of sums that a task holds before they are passed on.
COUNT_BYTES, LOOK_BYTES, SUMMED = 4 << 20, 1 << 20, 4_000_000
#: The closing byte, without a blank after it; no word holds it.
END = b"\n"
LOG10_2 = float(np.log10(2.0))
BITS = range(8)


# --- words -------------------------------------------------------------------------------------


def count_words(docs: DataFrame, parts: int, part: int) -> DataFrame:
    """word, times (in training texts), seen (in all) over all texts; ends are counted as END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other = Counter(), Counter()

        def flush():
            words = list(train.keys() | other.keys())
            t = [train.get(w, 0) for w in words]
            s = [a + other.get(w, 0) for a, w in zip(t, words, strict=True)]
            train.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(t, pa.int64()), pa.array(s, pa.int64())], ["word", "times", "seen"])

        for b in slices(batches):
            for text, held in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.lower().split() if text else []
                words.append(END)
                (other if held else train).update(words)
            if len(train) + len(other) > COUNTED:
                yield flush()
        if train or other:
            yield flush()

    source = docs.select("doc_id", F.col("text").cast("string"), held_out(F.col("doc_id"), parts, part).alias("held"))
    counted = source.mapInArrow(run, struct(("word", T.BinaryType()), ("times", T.LongType()), ("seen", T.LongType())))
    return counted.groupBy("word").agg(F.sum("times").alias("times"), F.sum("seen").alias("seen"))


def normal(text: bytes | None) -> bytes:
    """The text as it is modelled: its words with a blank after each, and the closing byte."""
    return b" ".join([*(text.lower().split() if text else []), END])


def unroll(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text (a blank follows where the closing byte does not end it): context and
    byte as one number; and the number of bytes of each text."""
    coded = [w if w.endswith(END) else w + b" " for w in texts]
    sizes = np.array([len(w) for w in coded], dtype=np.int64)
    pad = b" " * DEPTH
    a = np.frombuffer(pad.join([b"", *coded]), dtype=np.uint8)
    # Two, four and seven bytes, DEPTH and the coded one.
    two = a[:-1].astype(np.uint16) << 8 | a[1:]
    four = two[:-2].astype(np.uint32) << 16 | two[2:]
    key = four[:-3].astype(np.int64) << 24 | four[3:] & 0xFFFFFF
    # Windows that end in the padding before a text belong to none.
    between = np.cumsum(sizes[:-1] + DEPTH)[:, None] - 1 - np.arange(DEPTH)
    return np.delete(key, between.ravel()), sizes


def summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their times."""
    if not len(key):
        return key, times
    if times.max() <= 1:
        both = key << 1 | times
        both.sort()
        key, times = both >> 1, both & 1
    else:
        order = np.argsort(key)
        key, times = key[order], times[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(times, first)


def grams(texts: DataFrame, code=bytes) -> DataFrame:
    """key (context and byte), times: the deepest table, with a row also for what only unseen texts need.
    texts: what is unrolled, after `code`, and how many times it counts. A task passes on few rows a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, least = [], 0, 0

        def merged():
            return summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for b in slices(batches, 0, COUNT_BYTES):
            key, sizes = unroll([code(x) for x in b.column(0).to_pylist()])
            held.append(summed(key, np.repeat(b.column(1).to_numpy(), sizes)))
            size += len(held[-1][0])
            if size > least + SUMMED:
                held = [merged()]
                size = least = len(held[0][0])
                if least > SUMMED:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["key", "times"])
                    held, size, least = [], 0, 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["key", "times"])

    return texts.mapInArrow(run, struct(("key", T.LongType()), ("times", T.LongType()))).repartition("key").groupBy("key").agg(F.sum("times").alias("times"))


def text_grams(docs: DataFrame, parts: int, part: int) -> DataFrame:
    """The deepest table of whole texts: those in training count once, the others not at all."""
    times = F.when(held_out(F.col("doc_id"), parts, part), 0).otherwise(1).cast("long")
    return grams(docs.select(F.col("text").cast("string").cast("binary").alias("text"), times.alias("times")), normal)


# --- trees -------------------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series after a shift by 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def weigh(context: np.ndarray, byte: np.ndarray, times: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by context and byte, a column for each bit: the estimate of the row's bit, the
    weight of the node's own estimate, and the logarithm of the node's block probability (on the first
    row of each node, zero on its others). below: the sums of the children's, or None at the deepest."""
    n = len(context)
    estimate, weight, block = (np.zeros((n, 8)) for _ in range(3))
    starts = [np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (byte[1:] >> (8 - k) != byte[:-1] >> (8 - k)))) for k in range(9)]
    sums = [np.add.reduceat(times, s) for s in starts]
    sizes = [np.diff(np.append(s, n)) for s in starts]
    for k in BITS:
        total, branch = np.repeat(sums[k], sizes[k]).astype(float), np.repeat(sums[k + 1], sizes[k + 1]).astype(float)
        estimate[:, k] = (branch + 0.5) / (total + 1)
        first = starts[k]
        a, b = branch[first], total[first] - branch[first]
        own = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - np.log(np.pi)
        if below is None:
            block[first, k], weight[:, k] = own, 1
        else:
            rest = np.add.reduceat(below[:, k], first)
            block[first, k] = np.logaddexp(own, rest) - np.log(2)
            weight[:, k] = np.repeat(1 / (1 + np.exp(np.clip(rest - own, -700, 700))), sizes[k])
    return estimate, weight, block


KT, WEIGHT, BLOCK, BELOW = ([f"{name}{k}" for k in BITS] for name in ("kt", "w", "block", "below"))


def level(rows: DataFrame, deepest: bool) -> DataFrame:
    """key, times, estimates, weights and block logarithms of one depth. Contexts are dealt out whole and
    sorted, so that a run over a partition meets each of them in one piece."""
    names = ["key", "times", *([] if deepest else BELOW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done(part):
            key = part[0].astype(np.int64)
            results = weigh(key >> 8, key & 255, part[1], None if deepest else np.stack(part[2:], axis=1))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[1].astype(np.int64)), *(pa.array(m[:, k]) for m in results for k in BITS)], ["key", "times", *KT, *WEIGHT, *BLOCK])

        for b in batches:
            part = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
            if held is not None:
                part = [np.concatenate([x, y]) for x, y in zip(held, part, strict=True)]
            if not len(part[0]):
                continue
            context = part[0] >> 8
            cut = int(np.searchsorted(context, context[-1])) if (context[1:] >= context[:-1]).all() else 0
            held = [x[cut:] for x in part]
            if cut:
                yield done([x[:cut] for x in part])
        if held is not None and len(held[0]):
            yield done(held)

    fields = struct(("key", T.LongType()), ("times", T.LongType()), *((c, T.DoubleType()) for c in (*KT, *WEIGHT, *BLOCK)))
    dealt = rows.select(*names).withColumn("context", F.shiftright("key", 8)).repartition("context").sortWithinPartitions("key").drop("context")
    return dealt.mapInArrow(run, fields)


def shorter(key, depth: int):
    """The key of the same byte after a context of `depth` bytes."""
    return key.bitwiseAND(F.lit((1 << (8 * (depth + 1))) - 1))


def tree(deepest: DataFrame) -> DataFrame:
    """key, score, times: log10 of the mixed probability of each byte after each deepest context, and how often
    the training texts have it."""
    levels = {DEPTH: materialize(level(deepest, True), "level")}
    for d in range(DEPTH - 1, -1, -1):
        up = levels[d + 1].groupBy(shorter(F.col("key"), d).alias("key")).agg(F.sum("times").alias("times"), *[F.sum(b).alias(s) for b, s in zip(BLOCK, BELOW, strict=True)])
        levels[d] = materialize(level(up, False), "level")
    mixed = levels[0].select("key", *[(F.col(w) * F.col(e)).alias(f"p{k}") for k, (w, e) in enumerate(zip(WEIGHT, KT, strict=True))], *[(1 - F.col(w)).alias(f"r{k}") for k, w in enumerate(WEIGHT)])
    for d in range(1, DEPTH + 1):
        above = mixed.withColumnRenamed("key", "up")
        own = levels[d].select("key", "times", *KT, *WEIGHT).withColumn("up", shorter(F.col("key"), d - 1))
        # The tables of contexts of no or one byte have 256 and 65,536 rows at most.
        joined = own.join(F.broadcast(above) if d <= 2 else above, "up")
        mixed = joined.select("key", *(["times"] if d == DEPTH else []), *[(F.col(f"p{k}") + F.col(f"r{k}") * F.col(WEIGHT[k]) * F.col(KT[k])).alias(f"p{k}") for k in BITS], *[(F.col(f"r{k}") * (1 - F.col(WEIGHT[k]))).alias(f"r{k}") for k in BITS])
    score = sum((F.log10(f"p{k}") for k in BITS), F.lit(0.0))
    found = materialize(mixed.select("key", score.alias("score"), "times"), "tree")
    discard(*levels.values())
    return found


#: An odd number; times it, modulo 2 ** 64, is a permutation that spreads keys over the high bits.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(key: np.ndarray) -> np.ndarray:
    return key.view(np.uint64) * FACTOR


class Held:
    """Rows of the deepest table in memory: mixed keys in order, and where each value of their first bits starts."""

    def __init__(self, mixed: np.ndarray, score: np.ndarray):
        # A last row that no key is below ends every search.
        self.mixed, self.score = np.append(mixed, np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(score, np.nan)
        self.shift = np.uint64(64 - max(1, len(mixed).bit_length() - 1))
        sizes = np.bincount((mixed >> self.shift).view(np.int64), minlength=1 << (64 - int(self.shift)))
        self.start = (np.cumsum(sizes) - sizes).astype(np.int32)

    def of(self, key: np.ndarray) -> np.ndarray:
        """The scores of keys; NaN for those that are not held."""
        mixed = mix(key)
        at = self.start[(mixed >> self.shift).view(np.int64)]
        got = self.mixed[at]
        left = np.flatnonzero(got < mixed)
        while len(left):
            at[left] += 1
            next_ = self.mixed[at[left]]
            got[left] = next_
            left = left[next_ < mixed[left]]
        found = self.score[at]
        if (other := got != mixed).any():
            found[other] = np.nan
        return found


def held_rows(scored: DataFrame, most: int) -> tuple[DataFrame, int, int]:
    """The most frequent rows, as many whole steps of frequency as fit in `most`, their number, and that of all."""
    step = F.floor(F.log2(F.col("times") + 1.0) * 64)
    least, held, total = None, 0, 0
    for r in scored.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if held == total and held + r["count"] <= most:
            least, held = r["step"], held + r["count"]
        total += r["count"]
    return scored.where(step >= least if least is not None else F.lit(False)), held, total


def held_tree(rows: DataFrame, n: int) -> Held:
    """The n rows in the driver's memory, for workers to hold; they come in sixteen pieces, so that the driver
    has little besides them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(b.column(0).to_numpy()).view(np.int64)), b.column(1)], ["mixed", "score"])

    table_ = materialize(rows.select("key", "score").mapInArrow(run, struct(("mixed", T.LongType()), ("score", T.DoubleType()))), "held-tree")
    mixed, score, at = np.zeros(n, np.uint64), np.zeros(n), 0
    for k in range(16):
        got = table_.where(F.shiftrightunsigned("mixed", 60) == k).toArrow()
        key = got.column("mixed").to_numpy().view(np.uint64)
        order = np.argsort(key)
        mixed[at : at + len(key)], score[at : at + len(key)] = key[order], got.column("score").to_numpy()[order]
        at += len(key)
    discard(table_)
    return Held(mixed, score)


def text_keys(docs: DataFrame, held) -> DataFrame:
    """doc_id, digest, key, times_here: what each text looks up in the deepest table and workers do not hold
    (`held`: a broadcast Held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, LOOK_BYTES):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            digest = pa.array([digest_of(x) for x in texts], pa.int64())
            for i, text in enumerate(texts):
                key, times = np.unique(unroll([normal(text)])[0], return_counts=True)
                rest = np.isnan(held.value.of(key))
                key, times = key[rest], times[rest]
                place = pa.array(np.full(len(key), i))
                yield pa.RecordBatch.from_arrays([b.column(0).take(place), digest.take(place), pa.array(key), pa.array(times)], ["doc_id", "digest", "key", "times_here"])

    source = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    return source.mapInArrow(run, T.StructType([source.schema[0], *struct(("digest", T.LongType()), ("key", T.LongType()), ("times_here", T.LongType())).fields]))


# --- texts -------------------------------------------------------------------------------------


def digest_of(text: bytes | None) -> int:
    return xxhash.xxh64_intdigest(text or b"") - (1 << 63)


def train(docs: DataFrame, parts: int, part: int) -> tuple[DataFrame, DataFrame]:
    """word, times, seen of every distinct word of all texts; key, score of every context and byte of all
    texts, learned from the training texts."""
    return materialize(count_words(docs, parts, part), "words"), tree(text_grams(docs, parts, part))


def name_of(word: bytes) -> bytes:
    """What a word is looked up by."""
    return word if len(word) <= HEAD_BYTES else hashlib.sha256(word).digest() * 3


def head_of(words: DataFrame) -> dict[bytes, int]:
    """The most frequent words by their names: as many whole steps of frequency as fit in HEAD."""
    long = F.unhex(F.repeat(F.sha2("word", 256), 3))
    short = words.select(F.when(F.length("word") <= HEAD_BYTES, F.col("word")).otherwise(long).alias("word"), "times", "seen")
    step = F.floor(F.log2("seen") * 16)
    least, total = None, 0
    for r in short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > HEAD:
            break
        least = r["step"]
    if least is None:
        return {}
    return {bytes(r["word"]): r["times"] for r in short.where(step >= least).select("word", "times").collect()}


def score(docs: DataFrame, parts: int = 7, part: int = 2, held_most: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every text.
    Texts whose id's crc32 leaves `part` when divided by `parts` are held out of training."""
    words, scored = train(docs, parts, part)
    totals = words.agg(F.sum("times").alias("n"), F.count(F.when(F.col("times") > 0, 1)).alias("v")).first()
    n, v = int(totals["n"] or 0), int(totals["v"] or 0)
    unit = float(np.log10(n + v + 1))
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(head_of(words))
    rows_, n_held, n_rows = held_rows(scored, HELD if held_most is None else held_most)
    tree_ = held_tree(rows_, n_held)
    held = spark.sparkContext.broadcast(tree_)
    del tree_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = frequent.value
        at = {w: i for i, w in enumerate(table_)}
        times = np.array(list(table_.values()), dtype=float)
        # The last place is that of words not in the table.
        base, known = np.append(np.log10(times + 1), 0), np.append(times > 0, False).astype(np.int64)
        for b in slices(batches, 1, LOOK_BYTES):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            digests = [digest_of(x) for x in texts]
            tokens = [[*(x.lower().split() if x else []), END] for x in texts]
            coded, flat, m = [b" ".join(x) for x in tokens], [*chain.from_iterable(tokens)], len(texts)
            tokens_ = np.array([len(x) for x in tokens], dtype=np.int64)
            begin = np.cumsum(tokens_) - tokens_
            named = flat if max(map(len, flat)) <= HEAD_BYTES else map(name_of, flat)
            found = np.fromiter(map(at.get, named, repeat(-1)), np.int64, len(flat))
            known_, base_ = np.add.reduceat(known[found], begin), np.add.reduceat(base[found], begin)
            some = np.flatnonzero(found < 0)
            owner = np.searchsorted(begin, some, side="right") - 1
            others = Counter(zip(owner.tolist(), [flat[k] for k in some.tolist()], strict=True))
            rows, word, count = [i for i, _ in others], [w for _, w in others], [*others.values()]
            key, sizes = unroll(coded)
            own_ = np.add.reduceat(np.nan_to_num(held.value.of(key)), np.cumsum(sizes) - sizes).tolist()
            size_ = [len(x) for x in coded]
            take = pa.array([*range(m), *rows], pa.int32())
            zero = [0] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), pa.array(digests, pa.int64()).take(take), pa.array([None] * m + word, pa.binary()), pa.array([1] * m + count, pa.int64()), pa.array([*tokens_, *zero], pa.int64()), pa.array([*known_, *zero], pa.int64()), pa.array([*base_, *zero], pa.float64()), pa.array([*own_, *zero], pa.float64()), pa.array([*size_, *zero], pa.int64())],
                ["doc_id", "digest", "word", "times_here", "n_tokens", "n_known", "base", "own", "size"],
            )

    source = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    fields = struct(("digest", T.LongType()), ("word", T.BinaryType()), ("times_here", T.LongType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("own", T.DoubleType()), ("size", T.LongType()))
    parts_ = materialize(source.mapInArrow(run, T.StructType([source.schema[0], *fields.fields])), "scored-parts")
    here = F.col("times_here")
    rare = parts_.where("word is not null").select("doc_id", "digest", "word", "times_here").join(words.select("word", "times").hint("shuffle_hash"), "word")
    rare = rare.select("doc_id", "digest", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("times") > 0, here).otherwise(F.lit(0)).cast("long").alias("n_known"), (here * F.log10(F.col("times") + 1.0)).alias("base"), F.lit(0.0).alias("own"), F.lit(0).cast("long").alias("size"))
    common = parts_.where("word is null").select("doc_id", "digest", F.lit(1).cast("long").alias("copies"), "n_tokens", "n_known", "base", "own", "size")
    every = common.unionByName(rare)
    if n_held < n_rows:
        found = text_keys(docs, held).join(scored.select("key", "score"), "key").groupBy("doc_id", "digest").agg(F.sum(here * F.col("score")).alias("own"))
        none = F.lit(0).cast("long")
        every = every.unionByName(found.select("doc_id", "digest", *[none.alias(c) for c in ("copies", "n_tokens", "n_known")], F.lit(0.0).alias("base"), "own", none.alias("size")))
    both = every.groupBy("doc_id", "digest").agg(*[F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "own", "size")])
    one = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    per = lambda c: F.col(c) / F.col("copies")
    return one.select(
        "doc_id",
        held_out(F.col("doc_id"), parts, part).alias("held_out"),
        per("n_tokens").cast("long").alias("n_tokens"),
        per("n_known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (per("base") - per("n_tokens") * unit).alias("base_score"),
        per("own").alias("score"),
        (-F.col("own") / F.col("size") / LOG10_2).alias("bits_per_byte"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
