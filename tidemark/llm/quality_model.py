"""Quality by a weak-label model: heuristic labellers, their accuracies by expectation-maximisation, a linear scorer.

Each labeller says of a text that it is good, bad, or nothing. How often each set of votes occurs is counted over
all documents; expectation-maximisation finds, from these counts alone, how good texts are voted on and how bad ones,
and so the probability that a text with given votes is good. These probabilities are the labels on which a linear
scorer over hashed features is trained. No labelled row is used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import cut
from .workers import frugal

BUCKETS = 1 << 14
#: Letters to ``A`` and ``a`` (any byte beyond ASCII counts as a lower-case letter), digits to ``0``.
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
#: Upper-case letters of Latin scripts beyond ASCII, which ``SHAPE`` alone would take for lower case.
UPPER = re.compile("[À-ÖØ-Þ]")
SYMBOLS = b"#*$%&|<>=^~"
#: Votes; a text too short for a labeller is no evidence of anything.
GOOD, BAD, NONE, SHORT = 1, 0, 2, 3
KINDS = 4


class Facts:
    """What labellers and features look at, from one pass over a text."""

    def __init__(self, text: str | None):
        text = text or ""
        raw = UPPER.sub("A", text).encode()
        self.words = raw.split()
        shaped = raw.translate(SHAPE)
        for run in (b"a", b"A", b"0", b"!"):
            while run * 2 in shaped:
                shaped = shaped.replace(run * 4, run).replace(run * 2, run)
        self.shapes = shaped.split()
        self.n = n = len(self.words)
        self.per = 1 / max(1, n)
        self.twice = sum(map(eq, self.words, self.words[1:])) * self.per
        self.distinct = len(set(self.words)) * self.per
        kinds = Counter(self.shapes)
        self.kinds = kinds
        share = lambda ok: sum([c for s, c in kinds.items() if ok(s)]) * self.per
        self.upper = share(lambda s: b"a" not in s and b"A" in s)
        self.lower = share(lambda s: s.strip(b".,;:") == b"a" or s.strip(b".,;:") in (b"Aa", b"A"))
        self.symbols = share(lambda s: any(c in SYMBOLS for c in s))
        self.shouts = share(lambda s: s.endswith(b"!"))
        self.ends = share(lambda s: s[-1:] in b".!?" and len(s) > 1)
        self.length = len(text) * self.per
        lines = [x for x in text.split("\n") if x.strip()]
        self.dup_lines = (len(lines) - len(set(lines))) / max(1, len(lines))


#: Name, and what each labeller says. A text that shows no junk of one kind is not thereby good, so most can only say
#: bad or nothing.
LABELLERS = (
    ("words in a row", lambda f: BAD if f.twice > 0.1 else NONE),
    ("distinct words", lambda f: SHORT if f.n < 50 else BAD if f.distinct < 0.12 and f.n < 5000 else GOOD if f.distinct > 0.35 else NONE),
    ("capitals", lambda f: BAD if f.upper > 0.4 else NONE),
    ("symbols", lambda f: BAD if f.symbols > 0.15 else NONE),
    ("shouting", lambda f: BAD if f.shouts > 0.3 else NONE),
    ("plain words", lambda f: SHORT if f.n < 5 else BAD if f.lower < 0.65 else GOOD if f.lower > 0.85 else NONE),
    ("sentences", lambda f: SHORT if f.n < 20 else BAD if f.ends < 0.005 or f.ends > 0.6 else GOOD if 0.02 < f.ends < 0.3 else NONE),
    ("word length", lambda f: BAD if f.n >= 5 and not 2.5 < f.length < 14 else NONE),
    ("lines again", lambda f: BAD if f.dup_lines > 0.3 else NONE),
    ("too short", lambda f: BAD if f.n < 3 else NONE),
)


def features(f: Facts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (distinct buckets, values) of length one: shapes, pairs of shapes, and steps of shares."""
    named: dict[bytes, float] = {b"s " + s: (c * f.per) ** 0.5 for s, c in f.kinds.items()}
    pairs = Counter(zip(f.shapes, f.shapes[1:], strict=False))
    for (a, b), c in pairs.items():
        named[b"p " + a + b" " + b] = (c * f.per) ** 0.5
    for name, x in (("twice", f.twice), ("upper", f.upper), ("symbols", f.symbols), ("shouts", f.shouts), ("dup", f.dup_lines), ("distinct", f.distinct), ("ends", f.ends), ("lower", f.lower)):
        named[f"x {name} {int(min(x, 0.999) * 10)}".encode()] = 0.5
    at = np.fromiter([xxhash.xxh3_64_intdigest(k) % BUCKETS for k in named], np.int64, len(named))
    v = np.fromiter(named.values(), np.float32, len(named))
    at, of = np.unique(at, return_inverse=True)
    v = np.bincount(of, v, len(at)).astype(np.float32)
    return at, v / max(1e-9, float(np.sqrt((v * v).sum())))


def votes(f: Facts) -> int:
    """Votes of all labellers as one number, in base four."""
    out = 0
    for _, say in LABELLERS:
        out = out * KINDS + say(f)
    return out


def _digits(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // KINDS ** (len(LABELLERS) - 1 - k) % KINDS for k in range(len(LABELLERS))], axis=1)


def fit_votes(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation: probability that texts with each set of votes are good, how each labeller votes on
    bad (0) and good (1) texts, (labeller, kind, vote), and the share of good texts.

    It starts from labellers that call three in ten bad texts bad and one in fifty good texts, and of those that can
    say good, from such that say it twice as often of good texts. Counts are smoothed, so no vote is impossible.
    """
    d, n = _digits(codes), counts.astype(float)
    p = np.ones((len(LABELLERS), 2, KINDS))  # 1 for texts too short: they change nothing
    for k in range(len(LABELLERS)):
        praise = n[d[:, k] == GOOD].sum() > 0
        p[k, :, :SHORT] = [[0.3, 0.35, 0.35], [0.02, 0.7, 0.28]] if praise else [[0.3, 0.01, 0.69], [0.02, 0.01, 0.97]]
    prior = 0.8
    good = np.zeros(len(codes))
    for _ in range(rounds):
        like = np.log([[1 - prior], [prior]]) + np.stack([np.log(p[np.arange(len(LABELLERS)), kind, d]).sum(axis=1) for kind in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        moved, good = np.abs(new - good).max(initial=0), new
        prior = float(np.clip((n * good).sum() / max(1.0, n.sum()), 0.02, 0.98))
        for kind, w in ((0, n * (1 - good)), (1, n * good)):
            for k in range(len(LABELLERS)):
                seen = np.bincount(d[:, k], weights=w, minlength=KINDS)[:SHORT] + 0.5
                p[k, kind, :SHORT] = seen / seen.sum()
        if moved < 1e-6:
            break
    return good, p, prior


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adagrad."""
    w, bias, square, sb = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-6), 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = (1 / (1 + np.exp(-np.clip(w[at] @ v + bias, -30, 30))) - y[i]) * weight[i]
            np.add.at(square, at, (g * v) ** 2)
            np.add.at(w, at, -0.3 * g * v / np.sqrt(square[at]))
            sb += g * g
            bias -= 0.3 * g / np.sqrt(sb)
    return w, bias


def quality_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000, max_features: int = 4_000_000, least: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: id, vote_score (from votes alone), score (the scorer's), kept (score >= ``least``),
    and the columns in ``carry``.

    Votes of all rows are counted. The scorer is trained on at most ``max_rows`` rows that votes alone call good (a
    probability of one half or more) and as many that they call bad, the first by a hash of the text, as far as each
    kind has ``max_features`` hashed features together: the driver gets at most 8 bytes for each. It scores all whole
    texts. Null and empty texts have no words: a labeller calls
    them too short. Repeated rows are scored alike. Null ids are kept as they are. An empty table gives an empty
    result; where votes call all texts good, or all bad, so does the scorer.
    """
    more = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(m) for c, m in zip(carry, more, strict=True)])
    kinds = "".join(f", {m} {rows.schema[m].dataType.simpleString()}" for m in more)
    kind = rows.schema["id"].dataType.simpleString()

    @frugal
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, at, value, mark = [], [], [], []
            for t in b.column(1):
                text = t.as_py()
                f = Facts(text)
                x = features(f)
                code.append(votes(f))
                at.append(x[0].astype(np.uint16).tobytes())
                value.append(x[1].astype(np.float16).tobytes())
                mark.append(xxhash.xxh3_64_intdigest((text or "").encode()) >> 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.int32()), pa.array(at, pa.binary()), pa.array(value, pa.binary()), pa.array(mark, pa.int64()), *b.columns[2:]], names=["id", "votes", "at", "v", "mark", *more])

    seen = cut(rows.mapInArrow(look, f"id {kind}, votes int, at binary, v binary, mark bigint{kinds}"), "quality")
    patterns = seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()  # at most KINDS ** labellers
    codes, counts = np.array([r.votes for r in patterns], np.int64), np.array([r.n for r in patterns], np.int64)
    good = fit_votes(codes, counts)[0] if len(codes) else np.zeros(0)
    by_code = dict(zip(codes.tolist(), good.tolist(), strict=True))
    sides = [[c for c, g in by_code.items() if (g >= 0.5) == side] for side in (False, True)]
    sample = []
    for side in sides:
        if side:
            first = seen.where(F.col("votes").isin(side)).select("mark", "id", "votes", "at", "v").orderBy("mark", "id").limit(max_rows)
            first = first.withColumn("sum", F.sum(F.length("at") / 2).over(W.orderBy("mark", "id").rowsBetween(W.unboundedPreceding, 0)))
            sample += first.where(F.col("sum") <= max_features).select("votes", "at", "v").collect()
    pairs = [(np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.v, np.float16).astype(np.float32)) for r in sample]
    y = np.array([by_code[r.votes] for r in sample])
    # Each side weighs as it does among all rows, so that scores are probabilities.
    share = np.array([sum(n for c, n in zip(codes.tolist(), counts.tolist(), strict=True) if (by_code[c] >= 0.5) == side) for side in (False, True)], float)
    took = np.array([(y < 0.5).sum(), (y >= 0.5).sum()], float)
    weight = np.where(y >= 0.5, share[1] / max(1, took[1]), share[0] / max(1, took[0])) if len(y) else y
    w, bias = fit_scorer(pairs, y, weight / max(1e-9, weight.mean()) if len(y) else weight)
    shared = docs.sparkSession.sparkContext.broadcast((w, bias, by_code))

    @frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, by_code = shared.value
        for b in batches:
            z = [float(w[np.frombuffer(a.as_py(), np.uint16)] @ np.frombuffer(v.as_py(), np.float16)) + bias for a, v in zip(b.column(2), b.column(3), strict=True)]
            s = 1 / (1 + np.exp(-np.clip(np.array(z, float), -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([by_code[c] for c in b.column(1).to_pylist()], pa.float64()), pa.array(s, pa.float64()), pa.array(s >= least), *b.columns[4:]], names=["id", "vote_score", "score", "kept", *more])

    out = seen.select("id", "votes", "at", "v", *more).mapInArrow(score, f"id {kind}, vote_score double, score double, kept boolean{kinds}")
    return out.select(F.col("id").alias(id_col), "vote_score", "score", "kept", *[F.col(m).alias(c) for c, m in zip(carry, more, strict=True)])
