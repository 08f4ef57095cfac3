"""Operator 4: best-fit packing by a configuration linear program over the length histogram.

Texts become token ids with a closing id; only what is longer than a sequence is cut. The number of
pieces of each length (a histogram of at most `capacity` entries, whatever the corpus's size) is all
that the program needs. A configuration says how many pieces of which length share a sequence; the
program asks for the least number of configurations that cover all pieces. Multiplicative weights
solve it: prices of lengths fall as they get covered, and a knapsack dynamic program over the capacity
prices configurations. Multiples are rounded to whole sequences, the fullest configurations first, and the
program is solved again for the pieces that rounding leaves, until none is left: every piece is placed by a
configuration that the program priced. Prices also give a lower bound on the number of sequences.

Pieces of a length are numbered within salted groups whose sizes add up to offsets, so a length that a
third of all pieces share is dealt out over many tasks; the number then gives sequence and offset.

A null text counts as empty: one piece with the closing id alone. A repeated id is packed once for
each of its rows, its equal pieces being numbered in any order. Only the id and the text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import vocab
from ridgeline.llm.common import Recent, kept, materialize, slices, struct, table

CHUNKS, WORDS = 60_000, 220_000
#: Words that the library encodes at once.
JOINED = 200
#: Bytes of text cut into words at a time.
SLICE = 2 << 20
CAPACITY = 2048
#: Rounds of pricing: in inverse proportion to the knapsack's items, within limits (the upper ones loose, level).
WORK, LEAST_ROUNDS, MOST_ROUNDS = 45_000, 14, (600, 100)
#: Share of the volume that whole parts of multiples must place, for fractions to be left to the next solution.
SHARE = 0.2
#: How fast prices fall with coverage, how far coverage goes (loose, level), how near the best a configuration must be, how far a
#: length's coverage may run ahead in a round, and how near its bound a plan is taken without a second try.
STEEP, COVER, NEAR, AHEAD, GOOD = 1.5, (24.0, 4.0), 0.99, 0.5, 1.002


class IdBytes:
    """Token ids of texts as the tokenizer library gives them, as little-endian unsigned 32-bit numbers.
    The library encodes each new word once; a text's words are then looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.vocabulary = Tokenizer.from_file(path), vocab.load(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.chunks, self.words = Recent(None, CHUNKS), Recent(None, WORDS)
        self.ending = self.vocabulary.ending()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = self.words
        tokens = [self.vocabulary.tokens(t) for t in texts]
        words.learn(set().union(*filter(None, tokens)), self._words)
        # Few texts need more than that: theirs are looked up by what stands between blanks.
        rest = [t.split() for t, found in zip(texts, tokens, strict=True) if found is None]
        look = words.__getitem__
        out = [None if found is None else b"".join(map(look, found)) for found in tokens]
        if rest:
            chunks = self.chunks
            chunks.learn(set().union(*rest), self._chunks)
            others = iter(rest)
            out = [b"".join([chunks[c] for c in next(others)]) if ids is None else ids for ids in out]
        return out

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        """A chunk of letters alone is one word; only others are cut into pieces."""
        words, pieces = self.words, self.vocabulary.pieces
        plain = [c.isalpha() for c in chunks] if self.vocabulary.simple else [False] * len(chunks)
        lowered = b" ".join(chunks).lower().split(b" ")
        cut = {c: pieces(c) for c in compress(chunks, map(not_, plain))}
        words.learn({*compress(lowered, plain), *(p for ps in cut.values() for p in ps if type(p) is bytes)}, self._words)
        join = lambda ps: b"".join([p.to_bytes(4, "little") if type(p) is int else words[p] for p in ps])
        return [words[w] if alone else join(cut[c]) for c, w, alone in zip(chunks, lowered, plain, strict=True)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. The library encodes `JOINED` words at a time, with blanks between them, which no
        step sees across; a word's ids end with the one that carries the mark of a word's end."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out = []
        for group, e in zip(groups, self._ids([b" ".join(g) for g in groups]), strict=True):
            ids = np.array(e, dtype="<u4")
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                out += [np.array(x, dtype="<u4").tobytes() for x in self._ids(group)]
                continue
            raw, cuts = ids.tobytes(), (4 * ends).tolist()
            out += [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]
        return out

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]


@kept
def id_bytes(path: str) -> IdBytes:
    return IdBytes(path)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing: int = 0, path: str | None = None) -> DataFrame:
    """id_col, piece, start, length and ids_crc32 of every piece."""
    path = path or vocab.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last, size = id_bytes(path), closing.to_bytes(4, "little"), 4 * capacity
        for b in slices(batches, most=SLICE):
            rows, number, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])):
                ids += last
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append(i)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])

    source = df.select(F.col(id_col), F.col(text_col).cast("string"))
    rest = struct(("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))
    return source.mapInArrow(run, T.StructType([source.schema[0], *rest.fields]))


def items(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and copies of the knapsack's items, long lengths first: as many copies of a length as there are
    and as fit, split into powers of two so that every number up to that is a sum of items."""
    capacity, length, copies = len(counts) - 1, [], []
    for k in np.flatnonzero(counts)[::-1].tolist():
        n, m = min(int(counts[k]), capacity // k), 1
        while n > 0:
            m = min(m, n)
            length.append(k)
            copies.append(m)
            n, m = n - m, 2 * m
    return np.array(length, dtype=np.int64), np.array(copies, dtype=np.int64)


def knapsack(price: np.ndarray, length: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best value within each capacity, every item once at most, and whether each item is taken there.
    price[l] is that of length l; price[0] is not used. An item comes in only where it gains something."""
    capacity = len(price) - 1
    best, taken = np.zeros(capacity + 1), np.zeros((len(length), capacity + 1), dtype=bool)
    for i, (w, v) in enumerate(zip((length * copies).tolist(), (price[length] * copies).tolist(), strict=True)):
        with_it = best[: capacity + 1 - w] + v
        np.greater(with_it, best[w:] + 1e-12, out=taken[i, w:])
        np.maximum(best[w:], with_it, out=best[w:])
    return best, taken


def filled(room: np.ndarray, taken: np.ndarray, length: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For each capacity in `room` a row of how many pieces of each length the best value there has."""
    room, out = room.copy(), np.zeros((len(room), taken.shape[1]), dtype=np.int64)
    for i in range(len(length) - 1, -1, -1):
        here = taken[i, room]
        if here.any():
            out[here, length[i]] += copies[i]
            room -= here * (length[i] * copies[i])
    return out


def solve(counts: np.ndarray, level: bool = True) -> tuple[dict[tuple, float], float]:
    """Fractional multiples of configurations, and a lower bound on the number of sequences.

    A length's price starts at its size and falls with its coverage. Each round prices configurations by
    the knapsack program and takes those within `NEAR` of the best: the best itself, and the best ones that
    hold each of the least covered lengths. No configuration has more pieces of a length than there are.
    In a round coverage rises by at most `AHEAD`: above that of the least covered length (level), which keeps the
    solution usable early, or above each length's own, which finds the better prices where sizes alone don't
    decide. Coverage is driven to `COVER` times the counts and scaled back to the counts at most."""
    capacity = len(counts) - 1
    present = np.flatnonzero(counts)
    if not len(present):
        return {}, 0.0
    size = np.arange(capacity + 1) / capacity
    length, copies = items(counts)
    covered, multiples, bound = np.zeros(capacity + 1), {}, float(np.ceil((counts * size).sum() - 1e-9))
    for _ in range(max(LEAST_ROUNDS, min(MOST_ROUNDS[level], WORK // len(length)))):
        price = np.where(counts > 0, size * np.exp(-STEEP * (covered - covered[present].min())), 0)
        best, taken = knapsack(price, length, copies)
        bound = max(bound, float((counts * price).sum() / best[capacity]))
        most = (np.full(capacity + 1, covered[present].min()) if level else covered.copy()) + AHEAD
        around = np.append(0, present[np.argsort(covered[present], kind="stable")])
        around = around[np.where(around > 0, price[around], 0) + best[capacity - around] >= NEAR * best[capacity]]
        made = filled(capacity - around, taken, length, copies)
        made[np.arange(len(around)), around] += around > 0
        for one in made[(made <= counts).all(axis=1)]:
            k = np.flatnonzero(one)[::-1]
            step = float(((most[k] - covered[k]) * counts[k] / one[k]).min(initial=np.inf)) / 2
            if not 1e-3 < step < np.inf:
                continue
            key = tuple(zip(k.tolist(), one[k].tolist(), strict=True))
            multiples[key] = multiples.get(key, 0) + step
            covered[k] += one[k] * step / counts[k]
        if covered[present].min() >= COVER[level]:
            break
    return {k: x / covered.max() for k, x in multiples.items()}, bound


def rounded(multiples: dict[tuple, float], left: np.ndarray) -> list[tuple[tuple, int]]:
    """Whole multiples of the program's configurations, taken out of `left`: the whole parts, as long as they
    place a good share; otherwise one of each that still fits, the fullest first and of these those with the
    longest pieces. Once half of the volume is placed, only the fullest go on: the rest is solved anew."""
    chosen, capacity = [], len(left) - 1
    used = lambda key: sum(k * a for k, a in key)
    volume = placed = int((left * np.arange(capacity + 1)).sum())

    def take(key: tuple, m: int) -> int:
        m = min(m, *(int(left[k]) // a for k, a in key))
        if m > 0:
            chosen.append((key, m))
            for k, a in key:
                left[k] -= a * m
        return max(m, 0) * used(key)

    placed = sum(take(key, int(x)) for key, x in sorted(multiples.items(), key=lambda e: (-e[1], e[0])) if x >= 1)
    if placed >= SHARE * volume:
        return chosen
    by_room: dict[int, list[tuple]] = {}
    for key in multiples:
        by_room.setdefault(capacity - used(key), []).append(key)
    for room in sorted(by_room):
        placed += sum(take(key, 1) for key in sorted(by_room[room], key=lambda key: (-key[0][0], -multiples[key], key)))
        if 2 * placed >= volume:
            break
    return chosen


def plan(counts: np.ndarray) -> tuple[list[tuple[tuple, int]], float]:
    """Configurations with whole multiples that hold exactly `counts` pieces of each length, and the
    lower bound on the number of sequences. The program is solved, rounded, and solved again for what
    rounding left, until all pieces are placed. A plan that is not near the bound is tried against one from
    prices that are let loose; the better one counts."""
    capacity = len(counts) - 1
    short = counts.astype(np.int64).copy()
    long, short[capacity] = int(short[capacity]), 0
    found, bound = attempt(short, True)
    if sum(found.values()) > GOOD * bound + 1:
        other, low = attempt(short, False)
        bound = max(bound, low)
        if sum(other.values()) < sum(found.values()):
            found = other
    return ([(((capacity, 1),), long)] if long else []) + list(found.items()), long + bound


def attempt(counts: np.ndarray, level: bool) -> tuple[dict[tuple, int], float]:
    left, found, bound = counts.copy(), {}, 0.0
    while left.any():
        multiples, low = solve(left, level)
        bound = bound or low
        for key, m in rounded(multiples, left):
            found[key] = found.get(key, 0) + m
    return found, bound


def layout(chosen: list[tuple[tuple, int]]) -> tuple[np.ndarray, ...]:
    """Sorted by length and first number: length, first number, copies in a sequence, first sequence,
    offset of the first copy."""
    rows, used, sequence = [], {}, 0
    for key, m in chosen:
        offset = 0
        for length, copies in key:
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * m
            offset += copies * length
        sequence += m
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return tuple(a[:, i].copy() for i in range(5))


def numbered(parts: DataFrame, counts: np.ndarray, id_col: str) -> DataFrame:
    """The pieces with `number`: from 0 within their length. Groups of a length are so small that no
    task gets much more than others; their sizes are summed up to offsets."""
    group = max(200, int(counts.sum()) // 1000)
    salts = F.create_map(*[F.lit(x) for n in np.flatnonzero(counts > group).tolist() for x in (n, -(-int(counts[n]) // group))]) if (counts > group).any() else None
    salt = F.pmod(F.xxhash64(id_col, "piece"), F.coalesce(salts[F.col("length")], F.lit(1))) if salts is not None else F.lit(0).cast("long")
    salted = parts.withColumn("salt", salt)
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(F.broadcast(before), ["length", "salt"]).withColumn("number", F.col("rank") + F.col("before")).drop("salt", "rank", "before")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing: int = 0, path: str | None = None) -> DataFrame:
    """Every piece with its sequence_id and its offset in it."""
    parts = materialize(pieces(df, id_col, text_col, capacity, closing, path), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in parts.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    length, first, copies, sequence, offset = layout(plan(counts)[0])
    key, names = length << 44 | first, parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("length").to_numpy()
            number = b.column("number").to_numpy()
            at = np.searchsorted(key, n << 44 | number, side="right") - 1
            into = number - first[at]
            columns = [b.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + into // copies[at]), pa.array(offset[at] + into % copies[at] * n)], [*names, "sequence_id", "offset"])

    source = numbered(parts, counts, id_col).select(*names, "number")
    return source.mapInArrow(run, T.StructType([*parts.schema.fields, *struct(("sequence_id", T.LongType()), ("offset", T.LongType())).fields]))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
