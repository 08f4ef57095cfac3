"""Operator 2: BPE encoding and decoding.

Each pre-token is a doubly linked list of symbols with a priority queue of the ranks of adjacent
pairs; entries whose symbols have changed since are skipped when they come up. Decoding joins
vocabulary strings. Documents are independent of each other, so both directions are maps over the
input's own partitions: no shuffle, memory bounded by the caches and one slice of texts.

Null texts count as empty and give no tokens. Rows repeat as often as they come; columns other than
the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import vocab
from ridgeline.llm.common import Recent, slices, struct, table

#: Chunks and pre-tokens whose ids a worker remembers (twice so many at most).
CHUNKS, WORDS = 300_000, 200_000


def merge_word(word: bytes, v: vocab.Vocabulary) -> tuple[int, ...]:
    """The ids of one pre-token."""
    n = len(word)
    if n == 1:
        return (v.final[word[0]],)
    ids: list[int] = [v.inner[b] for b in word]
    ids[-1] = v.final[word[-1]]
    merges = v.merges
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = []
    for i in range(n - 1):
        pair = ids[i] << 16 | ids[i + 1]
        if (found := merges.get(pair)) is not None:
            queue.append((found[0], i, pair, found[1]))
    heapify(queue)
    while queue:
        _, i, pair, made = heappop(queue)
        j = after[i]
        if j < 0 or ids[i] < 0 or ids[i] << 16 | ids[j] != pair:
            continue  # stale: one of the two has been merged meanwhile
        ids[i], ids[j] = made, -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (found := merges.get(p := made << 16 | ids[k])) is not None:
                heappush(queue, (found[0], i, p, found[1]))
        h = before[i]
        if h >= 0 and (found := merges.get(p := ids[h] << 16 | made)) is not None:
            heappush(queue, (found[0], h, p, found[1]))
    return tuple([x for x in ids if x >= 0])


class Encoder:
    def __init__(self, path: str):
        v = self.vocabulary = vocab.load(path)
        self.words = Recent(lambda w: merge_word(w, v), WORDS)
        self.chunks = Recent(self._chunk, CHUNKS)
        self.decimals = [str(i) for i in range(v.size)]

    def _chunk(self, chunk: bytes) -> tuple[int, ...]:
        parts = self.vocabulary.pieces(chunk)
        if len(parts) == 1 and type(parts[0]) is bytes:
            return self.words[parts[0]]
        return tuple(i for p in parts for i in ((p,) if type(p) is int else self.words[p]))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        chunks = self.chunks
        for c in text.encode("utf-8", "surrogatepass").split():
            ids += chunks[c]
        return ids

    def decode(self, ids: list[int]) -> str:
        strings = self.vocabulary.strings
        return " ".join([strings[i] for i in ids])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col, ids array<int>: the token ids of every whole text."""
    path = path or vocab.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in slices(batches):
            ids = [e.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    source = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id_col, text: the vocabulary strings of the ids, joined by blanks (null ids: empty text)."""
    path = path or vocab.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in slices(batches):
            texts = [e.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    source = df.select(F.col(id_col), F.col(ids_col))
    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("text", T.StringType())]))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col, n_tokens, ids_text (decimal ids joined by a blank) and decoded of every whole text, in
    one pass: the text is encoded, and the ids are decoded again."""
    path = path or vocab.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        decimals = e.decimals
        for b in slices(batches):
            counts, ids_text, decoded = [], [], []
            for t in b.column(1).to_pylist():
                ids = e.encode(t or "")
                counts.append(len(ids))
                ids_text.append(" ".join([decimals[i] for i in ids]))
                decoded.append(e.decode(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_text, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_text", "decoded"])

    source = df.select(F.col(id_col), F.col(text_col).cast("string"))
    rest = struct(("n_tokens", T.LongType()), ("ids_text", T.StringType()), ("decoded", T.StringType()))
    return source.mapInArrow(run, T.StructType([source.schema[0], *rest.fields]))


def query(spark, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
