"""Operator 9: language identification by error-correcting output codes.

Every language gets a codeword of bits; one linear classifier over hashed byte n-grams is trained for
each bit. A text's bits are decoded to the codeword of least loss, each bit weighted by how reliable
its classifier was in training; a winner that is hardly better than the runner-up is flagged.

The classifiers are fitted on a bounded sample of labelled rows (`per_language` of each language,
chosen by a hash of the id), the driver holds only those rows' features; the number of languages is not
limited. Every row is then predicted
from its whole text in one map without a shuffle. A text that is null or has no letter gets `und`
with score 0, and so does every text when no row is labelled. Of languages that are equally near the first
in order of name wins, and the text is flagged as ambiguous. Label, source and id never enter a
prediction; ids that repeat are predicted one by one, a null id like any other. Texts of any length are
counted whole, a megabyte at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import held_out, let_go, materialize, slices, struct, table

#: Hashed features of a text, and how many texts are turned into features at once.
WIDTH, ROWS = 2048, 512
#: Bytes of text that are turned into n-grams at a time.
PIECE = 1 << 20
#: So many labels are broadcast; more are joined.
BROADCAST_LABELS = 10_000
LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are not letters count as one blank.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each text: square roots of the hashed n-gram counts (n = 1 to 3), scaled to length 1. Texts are
    counted a piece at a time, so memory doesn't grow with a text's length."""
    out = np.zeros((len(texts), WIDTH))
    at, n = 0, len(texts)
    while at < n:
        end, held = at, 0
        while end < n and held + len(texts[end]) <= PIECE:
            held += len(texts[end])
            end += 1
        if end > at:
            _count(texts[at:end], out[at:end])
        else:
            # A longer text, in pieces that run on by two bytes; an n-gram counts where it begins.
            text, end = texts[at], at + 1
            for a in range(0, len(text), PIECE):
                _count([text[a : a + PIECE + 2]], out[at:end], PIECE)
        at = end
    x = np.sqrt(out)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _count(texts: list[bytes], out: np.ndarray, begins: int | None = None) -> None:
    """Adds the n-grams that begin in the first `begins` bytes (of a single text) to the texts' rows."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    a = FOLD[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    code = np.zeros(len(a), dtype=np.uint64)
    for n in range(1, 4):
        m = len(a) - n + 1
        if m <= 0:
            break
        code = code[:m] << np.uint64(8) | a[n - 1 :]
        slot = ((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(53)).astype(np.int64)
        inside = owner[:m] == owner[n - 1 :]
        if begins is not None:
            inside[begins:] = False
        out += np.bincount((owner[:m] * WIDTH + slot)[inside], minlength=out.size).reshape(out.shape)


def lowered(text: str) -> bytes:
    """A text as it is learned from and as it is predicted."""
    return text.lower().encode("utf-8", "surrogatepass")


def codewords(k: int) -> np.ndarray:
    """A row of +1 and -1 for each of k classes. Up to 6 classes have all divisions in two; more get,
    of many random codes, the one whose closest rows are farthest apart."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 6:
        bits = [[1] + [1 - 2 * (c >> i & 1) for i in range(k - 1)] for c in range(1, 1 << (k - 1))]
        return np.array(bits, dtype=float).T
    rng, length = np.random.default_rng(k), 10 * int(np.ceil(np.log2(k)))
    if k > 2000:
        # Random words of this length differ in a third of their bits and more; all pairs are too many to look at.
        return rng.choice([-1.0, 1.0], (k, length))
    best, most = None, -1.0
    for _ in range(200 if k <= 500 else 20):
        code = rng.choice([-1.0, 1.0], (k, length))
        if (np.abs(code.sum(axis=0)) == k).any():
            continue
        gap = code @ code.T
        np.fill_diagonal(gap, -length)
        if (least := (length - gap.max()) / 2) > most:
            best, most = code, least
    return best


@dataclass
class Model:
    labels: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the label's number, its score, and the runner-up's score."""
        margins = x @ self.weights + self.bias
        # A bit's loss where the codeword has +1 and where it has -1, weighted by the bit's reliability.
        losses = (np.logaddexp(0, -margins) * self.trust) @ (self.code > 0).T + (np.logaddexp(0, margins) * self.trust) @ (self.code < 0).T
        p = np.exp(losses.min(axis=1, keepdims=True) - losses)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = 0
        return best, top, p.max(axis=1)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], rounds: int = 150, decay: float = 1e-5, rate: float = 8.0) -> Model:
    """Logistic regression for all bits at once, by accelerated gradient descent; every class has the same weight."""
    code = codewords(len(labels))
    target = code[y]
    share = (1 / np.bincount(y, minlength=len(labels)))[y]
    share = (share / share.sum())[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    ahead_w, ahead_b = w, b
    for i in range(rounds):
        g = -target * share / (1 + np.exp(np.clip(target * (x @ ahead_w + ahead_b), -50, 50)))
        new_w, new_b = ahead_w - rate * (x.T @ g + decay * ahead_w), ahead_b - rate * g.sum(axis=0)
        pull = i / (i + 3)
        ahead_w, ahead_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w, new_b
    right = ((target * (x @ w + b) > 0) * share).sum(axis=0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return Model(labels, code, w, b, trust / trust.sum() * len(trust))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 400) -> Model | None:
    """Learns from rows with a label. `per_language` bounds the sample of each language; all rows are
    used where there are fewer."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(id_col).cast("string")).alias("order"), F.col(text_col).cast("string").alias("text"))
    sizes = materialize(rows.groupBy("label").count(), "labels")
    if sizes.count() <= BROADCAST_LABELS:
        sizes = F.broadcast(sizes)
    part = F.pmod(F.col("order"), F.lit(1_000_000))
    # Half as many again as wanted, so that chance leaves enough.
    chosen = part < F.floor(1_000_000 * F.least(F.lit(1.0), 1.5 * per_language / F.col("count"))) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in slices(batches, 2):
            for at in range(0, b.num_rows, ROWS):
                s = b.slice(at, ROWS)
                x = features([lowered(t) for t in s.column(2).to_pylist()]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "order", "x"])

    sample = rows.join(sizes, "label").where(chosen).select("label", "order", "text")
    got = sample.mapInArrow(run, struct(("label", T.StringType()), ("order", T.LongType()), ("x", T.BinaryType()))).collect()
    got.sort(key=lambda r: (r["label"], r["order"]))
    taken: dict[str, int] = {}
    kept = [r for r in got if (taken.update({r["label"]: taken.get(r["label"], 0) + 1}) or taken[r["label"]]) <= per_language]
    labels = sorted({r["label"] for r in kept})
    if not labels:
        return None
    number = {label: i for i, label in enumerate(labels)}
    x = np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in kept]).astype(np.float64)
    return train(x, np.array([number[r["label"]] for r in kept]), labels)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", least_gap: float = 0.1, keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """The rows' id and the columns `keep`, with keep_text the text as a string, with lang_pred, score (the winner's share, 0 to 1) and ambiguous: the winner's score
    is less than `least_gap` above the runner-up's."""
    text = [text_col] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in slices(batches):
            for at in range(0, b.num_rows, ROWS):
                s = b.slice(at, ROWS)
                texts = s.column(1).to_pylist()
                lang, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
                some = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
                if some and model is not None:
                    best, top, second = model.predict(features([lowered(texts[i]) for i in some]))
                    for i, k in zip(some, best.tolist(), strict=True):
                        lang[i] = model.labels[k]
                    score[some], doubt[some] = top, top - second < least_gap
                yield pa.RecordBatch.from_arrays([s.column(0), *(s.column(i + 2) for i in range(len(keep))), *(s.column(1) for _ in text), pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)], [id_col, *keep, *text, "lang_pred", "score", "ambiguous"])

    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), *keep)
    rest = struct(*((c, T.StringType()) for c in text), ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("ambiguous", T.BooleanType()))
    return source.mapInArrow(run, T.StructType([source.schema[0], *(source.schema[k] for k in keep), *rest.fields]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")
