"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's embedding is the sum of three rows: two are found by parts of its hash, so that a word which shares one
row with a toxic word looks half like it, and one by the hash of its first six bytes, for words of a family. Rows start from the log-odds of labelled training texts that have a word
of the row, beside small random numbers; embeddings, filters and the output layer are then trained in numpy by
gradient descent. Thresholds are calibrated for each language on training texts that training left out, and a
score is shifted so that its language's threshold is at ``CUT``. The language is guessed from function words of the
text itself; no score reads a column other than the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .language_model import held_out
from .workers import frugal

CUT = 0.7
BITS, DIMS, FILTERS, WIDTHS = 17, 8, 6, (1, 2, 3)
PREFIX = 6
PAD = 3 << BITS  # a row of zeros
#: Words scored at once; memory is about 400 bytes for each.
AT_ONCE = 100_000
#: Texts hashed at once.
ROWS = 1000
#: Lower-cases A-Z and makes ASCII punctuation white space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))
#: Frequent function words by language.
FUNCTION_WORDS = {
    "de": "der die und den von das ist nicht mit ein eine einer zu auf für als im dem des sich",
    "en": "the of and to in is that for with on was as by be this are from at it an",
    "es": "el los las de la que y en un una del por con no su se al lo es para",
    "fr": "le la les des de et que un une du est en par qui dans pour au sur ne pas",
}


def hashes(text: str | None) -> np.ndarray:
    """(n, 2) hashes of the words and of their first bytes."""
    words = (text or "").encode().translate(TABLE).split()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.stack([own, np.fromiter(map(xxhash.xxh3_64_intdigest, [w[:PREFIX] for w in words]), np.uint64, len(words))], axis=1)


def rows_of(h: np.ndarray) -> np.ndarray:
    """(n, 3) rows of the embedding table."""
    mask = np.uint64((1 << BITS) - 1)
    return np.stack([(h[:, 0] & mask), ((h[:, 0] >> np.uint64(32)) & mask) + np.uint64(1 << BITS), (h[:, 1] & mask) + np.uint64(2 << BITS)], axis=1).astype(np.int64)


_LANGUAGES = sorted(FUNCTION_WORDS)
_FUNCTION = sorted((xxhash.xxh3_64_intdigest(w.encode()), i) for i, l in enumerate(_LANGUAGES) for w in FUNCTION_WORDS[l].split())
_FUNCTION_HASH = np.array([h for h, _ in _FUNCTION], np.uint64)
_FUNCTION_OF = np.array([i for _, i in _FUNCTION])


def language(h: np.ndarray) -> int:
    """Index of the language whose function words are most frequent; the number of languages if there are none."""
    h = h[:, 0]
    left, right = np.searchsorted(_FUNCTION_HASH, h), np.searchsorted(_FUNCTION_HASH, h, side="right")
    votes = np.zeros(len(_LANGUAGES))
    for k in range(int((right - left).max(initial=0))):  # a word may belong to several languages
        at = left[right - left > k] + k
        votes += np.bincount(_FUNCTION_OF[at], minlength=len(votes))
    return int(votes.argmax()) if votes.any() else len(votes)


@dataclass
class Model:
    table: np.ndarray  # (PAD + 1, DIMS)
    filters: list[np.ndarray]  # for each width (width, DIMS, FILTERS)
    out: np.ndarray  # (len(WIDTHS) * FILTERS,)
    bias: float
    shift: np.ndarray  # for each language and for none
    scale: float

    def features(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Max-pooled activations of texts. ``rows`` holds every text and then paddings."""
        e = self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]
        pooled = []
        for width, f in zip(WIDTHS, self.filters, strict=True):
            act = e @ f[0]
            for j in range(1, width):
                act[:-j] += e[j:] @ f[j]
            ends = np.minimum(starts + np.maximum(sizes, 1), len(act) - 1)
            pooled.append(np.maximum.reduceat(act, np.stack([starts, ends], axis=1).ravel(), axis=0)[::2])
        return np.maximum(np.concatenate(pooled, axis=1), 0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, h in enumerate(texts):
            if len(h) > AT_ONCE:  # overlapping parts: the largest of maxima is the maximum
                parts = [h[i : i + AT_ONCE + max(WIDTHS) - 1] for i in range(0, len(h), AT_ONCE)]
                out[k] = np.max([self._features([p]) for p in parts], axis=0)[0] @ self.out + self.bias
        short = [k for k, h in enumerate(texts) if len(h) <= AT_ONCE]
        at = 0
        while at < len(short):
            end, size = at, 0
            while end < len(short) and (end == at or size + len(texts[short[end]]) <= AT_ONCE):
                size += len(texts[short[end]]) + 3
                end += 1
            out[short[at:end]] = self._features([texts[k] for k in short[at:end]]) @ self.out + self.bias
            at = end
        return out

    def _features(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.features(*_joined([rows_of(h) for h in texts]))

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        z = (self.logits(texts) - self.shift[[language(h) for h in texts]]) * self.scale + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pad = np.full((max(WIDTHS), 3), PAD)
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes + len(pad))[:-1]]).astype(np.int64)
    return np.concatenate([x for r in rows for x in (r, pad)]), starts, sizes


def _initial(rows: Iterable[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> Model:
    have = np.ones((2, PAD + 1))
    for r, label in zip(rows, y, strict=True):
        have[int(label), np.unique(r)] += 1
    odds = np.log(have[1] / (y.sum() + 2)) - np.log(have[0] / (len(y) - y.sum() + 2))
    seen = have.sum(axis=0) - 2
    table = rng.normal(0, 0.05, (PAD + 1, DIMS)).astype(np.float32)
    table[:, 0] = odds * seen / (seen + 4) / 4  # rows that few texts have tell little
    table[PAD] = 0
    filters = [rng.normal(0, 0.1, (w, DIMS, FILTERS)).astype(np.float32) / w for w in WIDTHS]
    for f in filters:
        f[0, 0, 0] = 1.0
    out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
    out[0] = 4.0
    return Model(table, filters, out, -4.0, np.zeros(len(_LANGUAGES) + 1), 1.0)


def train(texts: list[np.ndarray], labels: list[int], epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 7) -> Model:
    """A model of texts (word hashes) and labels; every fifth text calibrates thresholds and trains nothing."""
    rng, y = np.random.default_rng(seed), np.array(labels, np.float32)
    held = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~held)
    model = _initial((rows_of(texts[i]) for i in fit), y[fit], rng)
    if not len(fit) or y[fit].min() == y[fit].max():
        model.bias, model.out[:] = (-9.0 if not len(fit) or not y[fit].max() else 9.0), 0
        return model
    weight = np.where(y == 1, 0.5 / max(1, y[fit].sum()), 0.5 / max(1, len(fit) - y[fit].sum())) * len(fit)
    square = {"out": np.full_like(model.out, 1e-2), "bias": 1e-2, "table": np.full(PAD + 1, 1e-2, np.float32), "filters": [np.full_like(f, 1e-2) for f in model.filters]}
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), batch):
            _step(model, [rows_of(texts[i]) for i in order[at : at + batch]], y[order[at : at + batch]], weight[order[at : at + batch]], square, rate)
    _calibrate(model, [texts[i] for i in np.flatnonzero(held)], y[held])
    return model


def _step(m: Model, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, square: dict, rate: float) -> None:
    """One step of Adagrad. Of each filter and text only the place of the maximum has a gradient."""
    rows, starts, sizes = _joined(texts)
    e = m.table[rows[:, 0]] + m.table[rows[:, 1]] + m.table[rows[:, 2]]
    n, pooled, place = len(texts), np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32), np.zeros((len(texts), len(WIDTHS) * FILTERS), np.int64)
    for k, (width, f) in enumerate(zip(WIDTHS, m.filters, strict=True)):
        act = e @ f[0]
        for j in range(1, width):
            act[:-j] += e[j:] @ f[j]
        for i in range(n):
            part = act[starts[i] : starts[i] + max(1, sizes[i])]
            best = part.argmax(axis=0)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            pooled[i, cols], place[i, cols] = part[best, np.arange(FILTERS)], best + starts[i]
    active = pooled > 0
    feature = pooled * active
    p = 1 / (1 + np.exp(-np.clip(feature @ m.out + m.bias, -30, 30)))
    g = ((p - y) * weight / n).astype(np.float32)
    back = g[:, None] * m.out[None, :] * active
    d_out, d_bias = feature.T @ g, float(g.sum())
    d_table = np.zeros((0, DIMS), np.float32)
    touched, grads = [], []
    for k, (width, f) in enumerate(zip(WIDTHS, m.filters, strict=True)):
        d_f = np.zeros_like(f)
        b, at = back[:, k * FILTERS : (k + 1) * FILTERS], place[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(width):
            x = e[np.minimum(at + j, len(e) - 1)]  # (n, FILTERS, DIMS)
            d_f[j] = np.einsum("nf,nfd->df", b, x)
            touched.append(rows[np.minimum(at + j, len(e) - 1)].reshape(-1, 3))
            grads.append(np.einsum("nf,df->nfd", b, f[j]).reshape(-1, DIMS))
        square["filters"][k] += d_f**2
        f -= rate * d_f / np.sqrt(square["filters"][k])
    touched_rows, d_table = np.concatenate(touched), np.concatenate(grads)
    for c in range(3):
        rows_c = touched_rows[:, c]
        np.add.at(square["table"], rows_c, (d_table**2).mean(axis=1))
        np.add.at(m.table, rows_c, -rate * d_table / np.sqrt(square["table"][rows_c])[:, None])
    m.table[PAD] = 0
    square["out"] += d_out**2
    m.out -= rate * d_out / np.sqrt(square["out"])
    square["bias"] += d_bias**2
    m.bias -= rate * d_bias / np.sqrt(square["bias"])


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the fewest errors, in the middle of the widest such gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = edges[1:] - edges[:-1]
    best = np.flatnonzero(wrong == wrong.min())
    k = best[gap[best].argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


def _calibrate(m: Model, texts: list[np.ndarray], y: np.ndarray) -> None:
    if not len(texts):
        return
    z, of = m.logits(texts), np.array([language(h) for h in texts])
    if y.min() == y.max():
        return
    m.shift[:] = _best_cut(z, y)
    for k in range(len(m.shift)):
        own = of == k
        if y[own].sum() >= 10 and (1 - y[own]).sum() >= 10:
            m.shift[k] = _best_cut(z[own], y[own])


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, fold: int = 1, max_rows: int = 3000, max_chars: int = 8_000_000, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row for each input row: id, held_out, score, predicted, and the columns in ``carry``.

    The model learns from at most ``max_rows`` labelled rows of each label (the first by a hash of the id) whose
    crc32 of the id doesn't leave ``fold``, and of these from as many as have ``max_chars`` characters together; one
    with more than a twentieth of that teaches nothing. So the driver gets at most 16 bytes for each of 2 *
    ``max_chars``. All rows are scored on their whole texts. Null and empty texts have the
    score of a text without words. Null labels teach nothing; a null id counts as the empty text for the folds. Rows
    that repeat an id are scored one by one. With labels of one kind, or none, no text is told apart: scores are near
    1 or 0 as the only label is, and 0 without labels. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id"), folds, fold))
    marked = marked.groupBy("id").agg(F.max("y").cast("int").alias("y"))
    sizes = rows.groupBy("id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    known = sizes.where(F.col("chars") <= max_chars // 20).join(marked, "id")

    def pick(label: int) -> DataFrame:
        first = known.where(F.col("y") == label).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max_rows)
        return first.withColumn("sum", F.sum("chars").over(W.orderBy("h", "id"))).where(F.col("sum") <= max_chars).select("id", "y")

    chosen = pick(1).unionByName(pick(0))

    @frugal
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashes(t.as_py()).tobytes() for t in b.column(1)], pa.binary()), b.column(2)], names=["id", "h", "y"])

    kind = rows.schema["id"].dataType.simpleString()
    sample = rows.join(F.broadcast(chosen), "id").select("id", "text", "y").mapInArrow(hashed, f"id {kind}, h binary, y int").collect()
    sample.sort(key=lambda r: (xxhash.xxh3_64_intdigest(r.h), r.id))
    shared = docs.sparkSession.sparkContext.broadcast(train([np.frombuffer(r.h, np.uint64).reshape(-1, 2) for r in sample], [r.y for r in sample]))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            texts = [hashes(t.as_py()) for t in b.column(1)]
            s = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32)), *b.columns[3:]], names=names)

    more = [f"c{i}" for i in range(len(carry))]
    names = ["id", "held_out", "score", "predicted", *more]
    full = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col), folds, fold).alias("held"), *[F.col(c).alias(m) for c, m in zip(carry, more, strict=True)])
    kinds = "".join(f", {m} {full.schema[m].dataType.simpleString()}" for m in more)
    out = full.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int{kinds}")
    return out.select(F.col("id").alias(id_col), "held_out", "score", "predicted", *[F.col(m).alias(c) for c, m in zip(carry, more, strict=True)])
