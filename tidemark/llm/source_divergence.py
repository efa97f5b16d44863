"""Audit of how far the sources of a language diverge, by exact smoothed term probabilities.

Terms are counted by task and merged; each language keeps those that enough of its documents have. Two reports follow.

Terms: for each (language, source) group, terms with the same count there form a bucket, and so have the same
probability p; the least probability q in the language that a bucket holds bounds the divergence (p - q)^2 / q of all
its terms. Buckets are evaluated best bound first, in rounds, until every bucket left is bounded strictly below the
group's kth value.

Pairs: the sum over all kept terms is that of two sources without terms, plus what each source's counts change against
the other's zero (by buckets), plus a correction for terms that both have. The last comes from postings, the sources
of a term; pairs of them are summed up in the task, never made rows.

Counts beyond 9e9 are divided as decimals; all else are 64-bit integers, which hold every value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import cut, discard
from .workers import frugal

#: Lower-cases A-Z and makes a space of every other byte that is no part of a term.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE = 1_000_000_000
#: A task hands on its counts when it holds so many, reads a long text in slices of so many bytes, and sums up so many
#: pairs at once.
HELD, SLICE, PAIRS = 300_000, 1 << 20, 1 << 21
#: The first round evaluates buckets until they hold k terms; each further round so many times as many.
TIMES = 4


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """Lists of terms; no cut falls inside a term."""
    flat, at = text.translate(TERM), 0
    while at < len(flat):
        end = flat.find(b" ", at + SLICE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = ["lang", "source", "term", "n", "docs"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                of = pa.array(list(n), pa.binary()).cast(pa.string())
                cols = [pa.array([lang] * len(of), pa.string()), pa.array([source] * len(of), pa.string()), of, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
            held.clear()

        size = 0
        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            for key, value in zip(keys, b.column(2), strict=True):
                n, docs = held.setdefault(key, (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in _slices(value.as_buffer().to_pybytes()):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(n) - before
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact."""
    short, long = f"({SCALE}L * ({n} + 1)) div ({total} + {terms})", f"({SCALE} * cast({n} + 1 as decimal(20, 0))) div cast({total} + {terms} as decimal(20, 0))"
    return F.expr(f"if({total} + {terms} = 0, null, 1 + if({n} < 9000000000, {short}, {long}))")


def divergence(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _scored(docs: DataFrame, text_col: str, lang_col: str, source_col: str, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Terms that a group has (lang, source, place, term, n, p, zero, q), and all groups (lang, source, place, terms,
    zero), where p and q are the term's probability in the group and the language, and zero that of a term without
    occurrences in the group."""
    of_term = W.partitionBy("lang", "term")
    counts = term_counts(docs, text_col, lang_col, source_col)
    counts = counts.withColumns({"all_docs": F.sum("docs").over(of_term), "all_n": F.sum("n").over(of_term), "first": (F.col("source") == F.min("source").over(of_term)).cast("long")})
    terms = cut(counts.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "all_n", "first"), "terms", release=True)
    text = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    groups = docs.select(text(lang_col, "lang"), text(source_col, "source")).distinct()
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("own"))
    of_lang = W.partitionBy("lang")
    groups = groups.join(sums, ["lang", "source"], "left").na.fill(0)
    groups = groups.withColumns({"terms": F.sum("own").over(of_lang), "lang_total": F.sum("total").over(of_lang), "place": F.row_number().over(of_lang.orderBy("source")).cast("long") - 1})
    groups = cut(groups.withColumn("zero", probability("0L", "total", "terms")), "groups")
    scored = terms.join(groups, ["lang", "source"]).select("lang", "source", "place", "term", "n", probability("n", "total", "terms").alias("p"), "zero", probability("all_n", "lang_total", "terms").alias("q"))
    scored = cut(scored, "scored", release=True)
    discard(terms)
    return scored, groups


def _top_terms(scored: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """(lang, source, item, value, rank) of the k terms of each group that diverge most from the language."""
    group = W.partitionBy("lang", "source")
    bound = buckets.where("least < p").withColumn("bound", F.expr(divergence("p", "least")))
    before = F.sum("terms").over(group.orderBy(F.desc("bound"), "n").rowsBetween(W.unboundedPreceding, -1))
    open_ = cut(bound.withColumn("before", F.coalesce(before, F.lit(0))).select("lang", "source", "n", "bound", "before"), "bounds")
    found, low, high = None, 0, k
    while True:
        now = open_.where((F.col("before") >= low) & (F.col("before") < high)).select("lang", "source", "n")
        new = scored.where("q < p").join(now, ["lang", "source", "n"], "left_semi").select("lang", "source", F.col("term").alias("item"), F.expr(divergence("p", "q")).alias("value"))
        rank = F.row_number().over(group.orderBy(F.desc("value"), "item"))
        best = (new if found is None else found.drop("rank").unionByName(new)).withColumn("rank", rank).where(F.col("rank") <= k)
        old, found = found, cut(best, "found")
        if old is not None:
            discard(old)
        kth = found.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
        rest = open_.where(F.col("before") >= high).join(kth, ["lang", "source"], "left").where("kth is null or bound >= kth").drop("kth")
        left = cut(rest, "bounds")
        discard(open_)
        if left.isEmpty():
            return found
        open_, low, high = left, high, high * TIMES


def _shared(scored: DataFrame) -> DataFrame:
    """(lang, s, t, value): what terms that both sources have change in the sum of s against t."""
    names = ["lang", "s", "t", "value"]

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def summed(lang: list[str], of: np.ndarray, place: np.ndarray, p: np.ndarray, zero: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        a, b = a[a != b], b[a != b]
        value = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
        order = np.lexsort((place[b], place[a], of[a]))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.concatenate([[True], (of[a][1:] != of[a][:-1]) | (place[a][1:] != place[a][:-1]) | (place[b][1:] != place[b][:-1])]))
        cols = [pa.array([lang[k] for k in of[a][starts].tolist()], pa.string()), pa.array(place[a][starts]), pa.array(place[b][starts]), pa.array(np.add.reduceat(value[order], starts))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            lang, entries = codes.dictionary.to_pylist(), batch.column(1)
            sizes = np.diff(entries.offsets.to_numpy()).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            flat = entries.flatten()
            place, p, zero = (flat.field(c).to_numpy() for c in ("place", "p", "zero"))
            of = np.repeat(codes.indices.to_numpy(), sizes)
            cost = np.concatenate([[0], np.cumsum(sizes * sizes)])
            x = 0
            while x < len(sizes):
                y = max(x + 1, int(np.searchsorted(cost, cost[x] + PAIRS, side="right")) - 1)
                if sizes[x] > 1 and y == x + 1:  # one long list, in slices
                    k, step = int(sizes[x]), max(1, PAIRS // int(sizes[x]))
                    for i in range(0, k, step):
                        n = min(step, k - i)
                        yield summed(lang, of, place, p, zero, at[x] + i + np.repeat(np.arange(n), k), at[x] + np.tile(np.arange(k), n))
                else:
                    which = np.repeat(np.arange(x, y), sizes[x:y] ** 2)
                    within = np.arange(cost[y] - cost[x]) - (cost[which] - cost[x])
                    yield summed(lang, of, place, p, zero, at[which] + within // sizes[which], at[which] + within % sizes[which])
                x = y

    postings = scored.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "p", "zero")).alias("e")).where(F.size("e") > 1)
    sums = postings.select("lang", "e").mapInArrow(run, "lang string, s bigint, t bigint, value bigint")
    return sums.groupBy("lang", "s", "t").agg(F.sum("value").alias("both"))


def _pairs(scored: DataFrame, groups: DataFrame, buckets: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of each source against every other of its language."""
    shapes = buckets.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("shape"))
    sides = cut(groups.join(shapes, ["lang", "source"], "left").select("lang", "source", "place", "terms", "zero", F.coalesce("shape", F.array().cast("array<struct<p:bigint,terms:bigint>>")).alias("shape")), "sides")
    both = cut(_shared(scored), "both")
    a = sides.select("lang", "source", "terms", F.col("place").alias("s"), F.col("zero").alias("zero_s"), F.col("shape").alias("shape_s"))
    b = sides.select("lang", F.col("source").alias("item"), F.col("place").alias("t"), F.col("zero").alias("zero_t"), F.col("shape").alias("shape_t"))
    none = divergence("zero_s", "zero_t")
    own = lambda shape, p, q: f"aggregate({shape}, 0L, (s, x) -> s + x.terms * ({divergence(p, q)} - {none}))"
    value = F.expr(f"if(terms = 0, 0L, terms * ({none}) + {own('shape_s', 'x.p', 'zero_t')} + {own('shape_t', 'zero_s', 'x.p')} + coalesce(both, 0L))")
    pairs = a.join(b, "lang").where("s <> t").join(both, ["lang", "s", "t"], "left").select("lang", "source", "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, k: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: the report of pairs of sources (``pair``, whole) and of terms (``term``,
    the first ``k`` of each group).

    Null texts, languages and sources are the empty string. Rows that repeat an id are documents of their own; ids and
    other columns aren't read. A group without terms has pairs, against which its terms count as missing; in a language
    that keeps no term every pair has the value 0. Equal values are ranked by item. No rows give no rows.
    """
    scored, groups = _scored(docs, text_col, lang_col, source_col, min_docs)
    buckets = cut(scored.groupBy("lang", "source", "n", "p").agg(F.count(F.lit(1)).alias("terms"), F.min("q").alias("least")), "buckets")
    out = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", _pairs(scored, groups, buckets)), ("term", _top_terms(scored, buckets, k)))]
    return out[0].unionByName(out[1])
