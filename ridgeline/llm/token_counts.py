"""Operator 5: token counts by rank-synchronous array merging.

The pre-tokens of a slice of texts that are not yet known are held together as one ragged numpy
array. Each round looks up the ranks of all adjacent pairs, finds every sequence's lowest rank and
merges all its pairs of that rank at once; sequences without a pair left drop out, and what
survives is counted. A merge's result only takes part in later ranks, so taking all equal pairs of
a sequence in one round gives what one by one would give.

Documents are independent, so this is a map without a shuffle. Null texts count as empty: no bytes,
no tokens. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import vocab
from ridgeline.llm.common import Recent, slices, struct, table

CHUNKS, WORDS = 500_000, 300_000
NONE = np.iinfo(np.int64).max


def count_words(words: list[bytes], v: vocab.Vocabulary) -> np.ndarray:
    """The number of tokens of each pre-token (none may be empty)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts = np.ones(len(words), dtype=np.int64)
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    symbols = np.asarray(v.inner, dtype=np.int64)[raw]
    ends = np.cumsum(lengths) - 1
    symbols[ends] = np.asarray(v.final, dtype=np.int64)[raw[ends]]
    keys, ranks, made = v.sorted_merges
    owner = np.repeat(np.arange(len(words)), lengths)
    while len(symbols):
        left, right = symbols[:-1], symbols[1:]
        pair = left << 16 | right
        pair[owner[:-1] != owner[1:]] = -1
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        known = keys[at] == pair
        rank = np.append(np.where(known, ranks[at], NONE), NONE)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(symbols)))
        counts[owner[starts]] = sizes
        live = lowest != NONE
        if not live.any():
            break
        hit = (rank == np.repeat(lowest, sizes)) & (rank != NONE)
        # Pairs that share a symbol are in a run: take every other one, from the left.
        where = np.flatnonzero(hit)
        first = np.append(True, np.diff(where) != 1)
        start_of_run = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
        where = where[(np.arange(len(where)) - start_of_run) % 2 == 0]
        symbols[where] = made[at[where]]
        keep = np.repeat(live, sizes)
        keep[where + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return counts


class Counter:
    def __init__(self, path: str):
        self.vocabulary = vocab.load(path)
        self.chunks, self.words = Recent(None, CHUNKS), Recent(None, WORDS)

    def count(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        young, old = self.chunks, self.chunks.old
        new = list({c for s in split for c in s if c not in young})
        known = {}
        if new:
            missing = []
            for c in new:
                if (n := old.get(c)) is None:
                    missing.append(c)
                else:
                    known[c] = n
            known.update(zip(missing, self._count_chunks(missing), strict=True))
        out = []
        if not known:
            for s in split:
                out.append(sum([young[c] for c in s]))
            return out
        look = young.copy() if len(young) < len(known) else None
        if look is not None:
            look.update(known)
            out = [sum([look[c] for c in s]) for s in split]
        else:
            get = dict.get
            for s in split:
                out.append(sum([n if (n := get(young, c)) is not None else known[c] for c in s]))
        for c, n in known.items():
            young.put(c, n)
        return out

    def _count_chunks(self, chunks: list[bytes]) -> list[int]:
        pieces = [self.vocabulary.pieces(c) for c in chunks]
        words, get = self.words, dict.get
        new = list({p for ps in pieces for p in ps if type(p) is bytes and p not in words})
        known = {}
        missing = []
        for w in new:
            if (n := words.old.get(w)) is None:
                missing.append(w)
            else:
                known[w] = n
        if missing:
            known.update(zip(missing, count_words(missing, self.vocabulary).tolist(), strict=True))
        out = [sum([1 if type(p) is int else n if (n := get(words, p)) is not None else known[p] for p in ps]) for ps in pieces]
        for w, n in known.items():
            words.put(w, n)
        return out


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, path: str | None = None) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (more tokens than `limit`) of every whole text."""
    path = path or vocab.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches):
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            n = c.count(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    source = df.select(F.col(id_col), F.col(text_col).cast("string"))
    rest = struct(("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))
    return source.mapInArrow(run, T.StructType([source.schema[0], *rest.fields]))


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
