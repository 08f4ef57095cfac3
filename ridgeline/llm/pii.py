"""Operator 3: personal data by weak supervision, in DataFrame functions only.

Patterns give candidate spans. Base patterns (e-mail, IP, card, phone) find what always counts; looser
ones find national phone numbers, spelled-out addresses and credentials, and base matches that
fail their check. Labelers vote on every candidate: its pattern, its checksum or ranges, a gazetteer
(top-level domains, card prefixes, country codes), the words before it, and its edges. An
expectation-maximisation over the histogram of votes estimates each labeler's reliability, as the
probability of each of its votes for true and for false candidates; the posteriors then train a
logistic span classifier over votes, kind, form and length. Candidates that it accepts are added to
the base spans, which stay in any case.

Votes, kind, form and length take a bounded number of values, so the histogram has a bounded number of
rows however many documents there are; it alone reaches the driver, counted over all candidates. The
text itself is read in one map without a shuffle. Patterns are possessive or anchored, so that long
runs of digits or letters take linear time.

A null text counts as empty and has no spans. Rows that repeat come back as often. Positions are code
points, ends exclusive. Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, table

#: Kinds in the order in which spans at one place are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Candidate patterns: name, kind, expression. Base ones first. An e-mail may begin where the last one
#: ended, inside a run of its letters, but nowhere else within a run.
PATTERNS = (
    ("email", "email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", "card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("national", "phone", r"(?<![0-9+.])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("spelled", "email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?i:dot)[\])]|\.)\x20?[A-Za-z0-9-]++)++"),
    ("secret", "secret", r"(?i:token|api[_-]?key|secret|password|passwd)[\x20\t]{0,2}[=:][\x20\t]{0,2}[\x22\x27]?[A-Za-z0-9_+/-]{16,}+"),
)
BASE = 4
#: Fixed lists that labelers look up.
TOP_LEVEL = "com org net edu gov io co info biz de fr es uk eu us ca it nl ch at be se no dk pl pt br mx jp cn in au nz ru".split()
BEFORE = {"email": "mail e-mail contact write address", "ip": "ip host server address login from", "card": "card visa credit mastercard payment pay number", "phone": "phone tel call mobile fax dial contact", "secret": "key token secret password auth bearer credential"}
NEAR = 24
#: Elements of an array that one fold carries along.
BLOCK = 256
VOTES = ("pattern", "check", "gazetteer", "words", "edges")


def _before(steps: Column, value, combine, zero: Column) -> Column:
    """For each element the combination of `value` over all elements before it. An array that a fold carries is
    copied at every step, so the fold runs within blocks, whose own totals are folded first."""
    n = F.size(steps)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    part = lambda i: F.slice(steps, i * BLOCK + 1, F.lit(BLOCK))

    def fold(values: Column, start: Column, of) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, begin, lambda a, x: F.struct(combine(a["at"], of(x)).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    totals = F.transform(blocks, lambda i: F.aggregate(part(i), zero, lambda a, x: combine(a, value(x))))
    inside = F.flatten(F.zip_with(fold(totals, zero, lambda x: x), blocks, lambda at, i: fold(part(i), at, value)))
    return F.when(n == 0, F.array().cast("array<int>")).when(n <= BLOCK, fold(steps, zero, value)).otherwise(inside)


def _spans(found: Column, gaps: Column, number: int) -> Column:
    """array<struct<p, start, end, s, before, after>> of a pattern's matches, given those and the texts between
    them: `before` has up to NEAR characters, `after` one. Nothing is looked up in the whole text."""
    near = lambda x: F.substring(x, -NEAR, NEAR)
    at = _before(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)), lambda x: x, lambda a, x: a + x, F.lit(0))

    def span(m, i):
        gap, after = F.element_at(gaps, i + 1), F.element_at(gaps, i + 2)
        left = F.when(i > 0, near(F.element_at(found, F.greatest(i, F.lit(1))))).otherwise(F.lit(""))
        right = F.when(F.length(after) > 0, after).otherwise(F.coalesce(F.get(found, i + 1), F.lit("")))
        return F.struct(F.lit(number).alias("p"), F.length(gap).alias("start"), F.length(m).alias("end"), m.alias("s"), near(F.concat(left, near(gap))).alias("before"), F.substring(right, 1, 1).alias("after"))

    def place(x, t):
        start = t + x["start"]
        return F.struct(x["p"].alias("p"), start.alias("start"), (start + x["end"]).alias("end"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after"))

    return F.zip_with(F.transform(found, span), at, place)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the string's digits pass the check: every second one from the right doubled."""
    digits = F.transform(F.split(F.reverse(_digits(s)), ""), lambda d: d.cast("int"))
    parts = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(p: Column, s: Column) -> Column:
    """Whether a match of a base pattern passes the base's own check."""
    n = F.length(_digits(s))
    short = F.transform(F.split(s, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    octets = F.forall(short, lambda x: (F.length(x) <= 3) & (F.coalesce(F.substring(x, 1, 3).try_cast("int"), F.lit(0)) <= 255))
    return F.when(p == 0, True).when(p == 1, octets).when(p == 2, n.between(12, 19) & F.when(n.between(12, 19), _luhn(s)).otherwise(False)).when(p == 3, n.between(9, 15)).otherwise(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _one_of(x: Column, values) -> Column:
    return x.isin(*values)


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """id_col and `found`: the candidates of every whole text, with their kind, whether they are base spans
    and their cell (votes, kind, form and length as one number)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = df.select(F.col(id_col).alias("__id"), text.alias("__text"))
    t = F.col("__text")
    digit = t.rlike("[0-9]")
    names = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+")), "spelled": t.rlike(r"(?i)[\[(]at[\])]"), "secret": t.rlike("(?i)token|key|secret|passw")}
    cut = []
    for i, (name, _, expression) in enumerate(PATTERNS):
        guard = names.get(name, digit)
        cut.append(F.when(guard, F.regexp_extract_all(t, F.lit(expression), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"__f{i}"))
        cut.append(F.when(guard, F.split(t, expression, -1)).otherwise(F.array().cast("array<string>")).alias(f"__g{i}"))
    pieces = source.select("*", *cut)
    found = pieces.select("__id", "__text", F.concat(*[_spans(F.col(f"__f{i}"), F.col(f"__g{i}"), i) for i in range(len(PATTERNS))]).alias("raw"))
    kinds = F.array(*[F.lit(KINDS.index(k)) for _, k, _ in PATTERNS])

    def judge(x):
        p, s = x["p"], x["s"]
        kind = F.element_at(kinds, p + 1)
        valid = _valid(p, s)
        n = F.length(_digits(s))
        before, right = F.lower(x["before"]), x["after"]
        left = F.substring(before, -1, 1)
        domain = F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1))
        digits = _digits(s)
        gazetteer = (
            F.when(kind == 0, _vote(_one_of(domain, TOP_LEVEL), domain.rlike("^[0-9]+$")))
            .when(kind == 1, _vote(s.rlike(r"^(10|127|172|192)\."), s.rlike(r"^0")))
            .when(kind == 2, _vote(digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^(0|1|9)")))
            .when(kind == 3, _vote(digits.rlike("^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), digits.rlike("^0")))
            .otherwise(_vote(s.rlike("[0-9]") & s.rlike("[A-Za-z]{2}"), ~s.rlike("[0-9]")))
        )
        words = F.lit(0)
        for i, k in enumerate(KINDS):
            words = F.when((kind == i) & before.rlike(r"\b(" + "|".join(BEFORE[k].split()) + r")\b"), 1).otherwise(words)
        check = F.when(p < BASE, _vote(valid, ~valid)).when(p == 4, _vote(n == 10, n != 10)).when(p == 6, _vote(F.length(s) >= 28, F.length(s) < 24)).otherwise(0)
        edges = _vote(~left.rlike("[A-Za-z0-9_.-]") & ~right.rlike("[A-Za-z0-9_-]"), left.rlike("[A-Za-z0-9_]") | right.rlike("[A-Za-z0-9_]"))
        pattern = F.when(p < BASE, 1).otherwise(0)
        cell = p * 8 + F.least(F.floor(F.length(s) / 6), F.lit(7)).cast("int")
        for v in (pattern, check, gazetteer, words, edges):
            cell = cell * 3 + v + 1
        return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), valid.alias("base"), cell.cast("int").alias("cell"))

    columns = [F.col("__id").alias(id_col), F.transform("raw", judge).alias("found")]
    return found.select(*columns, t.alias(text_col)) if keep_text else found.select(*columns)


def _unpack(cell: int) -> tuple[int, int, list[int]]:
    """Pattern, length step and votes of a cell."""
    votes = []
    for _ in VOTES:
        cell, v = divmod(cell, 3)
        votes.append(v - 1)
    return cell // 8, cell % 8, votes[::-1]


def reliabilities(votes: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation. votes: rows of -1, 0, 1; weight: how often each row was seen. Gives each
    row's posterior and, by labeler, the probabilities of its three votes for false and for true."""
    post = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    table_ = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        for truth, share in ((0, 1 - post), (1, post)):
            for v in range(3):
                # Labelers are taken to be right more often than wrong: a prior keeps the two sides apart.
                prior = 2.0 if v == 1 else 4.0 if (v == 2) == (truth == 1) else 1.0
                table_[truth, :, v] = ((votes == v - 1) * (weight * share)[:, None]).sum(axis=0) + prior
        table_ /= table_.sum(axis=2, keepdims=True)
        prior_true = (weight @ post + 1) / (weight.sum() + 2)
        at = np.arange(votes.shape[1])
        odds = np.log(prior_true / (1 - prior_true)) + (np.log(table_[1, at, votes + 1]) - np.log(table_[0, at, votes + 1])).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, table_


def train(cells: dict[int, int], rounds: int = 300) -> set[int]:
    """The cells whose candidates the span classifier accepts, learned from the cells' counts."""
    if not cells:
        return set()
    names = sorted(cells)
    unpacked = [_unpack(c) for c in names]
    votes = np.array([u[2] for u in unpacked])
    weight = np.array([cells[c] for c in names], dtype=float)
    post, _ = reliabilities(votes, weight)
    forms = np.array([[u[0] == i for i in range(len(PATTERNS))] + [u[1] == i for i in range(8)] for u in unpacked], dtype=float)
    x = np.hstack([votes, forms, np.ones((len(names), 1))])
    share = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (share * (post - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    accepted = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) >= 0.5
    return {c for c, ok in zip(names, accepted.tolist(), strict=True) if ok}


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """id_col, base (array<struct<start, kind, end>> in order) and spans (base and added ones)."""
    found = materialize(candidates(df, id_col, text_col, keep_text), "candidates")
    cells = {r["cell"]: r["count"] for r in found.select(F.explode("found").alias("x")).select("x.cell").groupBy("cell").count().collect()}
    # A base pattern's match that fails its check is a vote against it in training, never a span.
    accepted = sorted(c for c in train(cells) if _unpack(c)[0] >= BASE)
    plain = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    base = plain(F.filter("found", lambda x: x["base"]))
    new = plain(F.filter("found", lambda x: x["cell"].isin(*accepted))) if accepted else F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rest = [text_col] if keep_text else []
    sorted_ = found.select(F.col(id_col), *rest, base.alias("base"), new.alias("new"))
    alone = F.filter("new", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return sorted_.select(F.col(id_col), *rest, "base", F.array_sort(F.concat("base", alone)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of the rows, with each span of the text replaced by its kind in brackets. Spans that overlap
    are replaced together, by the kind of the first. Null texts stay null."""
    columns = df.columns
    packed = df.select(F.struct(*columns).alias("__row"), F.col(text_col).alias("__body"))
    found = find(packed, "__row", "__body")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # `gone`: where the text already replaced before each span ends.
    ends = found.select("__row", "spans", _before(F.col("spans"), lambda x: x["end"], lambda a, x: F.greatest(a, x), F.lit(0)).alias("gone"))
    t, spans, gone = F.col("__row")[text_col], F.col("spans"), F.col("gone")

    def piece(x, at):
        return F.when(x["start"] >= at, F.concat(F.substring(t, at + 1, x["start"] - at), F.element_at(names, x["kind"] + 1))).otherwise(F.lit(""))

    last = F.greatest(F.element_at(gone, -1), F.element_at(spans, -1)["end"])
    masked = F.concat(F.array_join(F.zip_with(spans, gone, piece), ""), F.substring(t, last + 1, F.length(t)))
    new = F.when(t.isNull() | (F.size(spans) == 0), t).otherwise(masked)
    return ends.select(*[(new if c == text_col else F.col("__row")[c]).alias(c) for c in columns])


def query(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
