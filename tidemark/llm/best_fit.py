"""Packing of documents into as few sequences as possible, by linear grouping and best fit.

Pieces are told apart by length and a running number within it, so a histogram of lengths, as long as a sequence, is
all that the plan needs. Large pieces, from the longest down, are dealt into groups of equal cardinality and count as
long as their group's longest. Configurations of these few sizes are optimised as a linear program, whose columns are
found by a knapsack. Whole multiples of configurations take the actual pieces of their groups; the rest, and all small
pieces, go from the longest down where they leave the least space.

Everything in the plan is a run: so many pieces of one length from a number on, into as many sequences from an id on,
at one offset. Its size depends on the lengths there can be, not on the number of documents. Tasks number the pieces of
each length as they write them; a sum over tasks, by length, gives each task's first number, and a piece finds its
place by arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import _lanes, shared_file
from .store import cut, discard
from .workers import frugal

#: Numbers of groups, and least shares of a sequence that make a piece large; the plan with the fewest sequences stays.
GROUPS, LARGE = (24, 48, 96), (1 / 2, 1 / 3, 1 / 4)
#: Steps of the linear program for each size; every step has a valid solution.
STEPS = 12
#: Up to so many (task, length) cells are sent to all executors; beyond, pieces are joined with them.
BROADCAST_CELLS = 100_000


class Run(NamedTuple):
    """``count`` pieces of ``length`` from ``number`` on, into sequences from ``sequence`` on, at ``offset``."""

    length: int
    number: int
    count: int
    sequence: int
    offset: int


def knapsack(sizes: list[int], prices: np.ndarray, length: int) -> np.ndarray:
    """How often to take each size, for the highest price within ``length``."""
    tables = [np.zeros(length + 1)]
    for size, price in zip(sizes, prices.tolist(), strict=True):
        best = tables[-1].copy()
        if price > 0:
            for a in range(size, length + 1, size):
                b = min(a + size, length + 1)
                np.maximum(best[a:b], best[a - size : b - size] + price, out=best[a:b])
        tables.append(best)
    out, at = np.zeros(len(sizes)), length
    for k in range(len(sizes) - 1, -1, -1):
        while at >= sizes[k] and tables[k + 1][at] > tables[k][at] + 1e-12:
            out[k] += 1
            at -= sizes[k]
    return out


def configurations(sizes: list[int], demand: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of how often each size stands in a sequence, and the multiples of them that meet the demand with the
    fewest sequences (not whole numbers)."""
    each = np.array([length // s for s in sizes], float)
    basis, x = np.diag(each), np.array(demand, float) / each
    for _ in range(STEPS * len(sizes)):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = knapsack(sizes, prices, length)
        if prices @ column <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf)
        k = int(ratio.argmin())
        step = ratio[k]
        if not np.isfinite(step):
            break
        x = np.maximum(x - step * change, 0)
        basis[:, k], x[k] = column, step
    return basis, x


def grouped(histogram: dict[int, int], least: int, groups: int) -> tuple[list[int], list[int]]:
    """Sizes, falling, and how many pieces count as long as each."""
    step = max(1, math.ceil(sum(n for x, n in histogram.items() if x >= least) / groups))
    sizes: list[int] = []
    demand: list[int] = []
    room = 0
    for x in sorted((x for x in histogram if x >= least), reverse=True):
        n = histogram[x]
        while n:
            if not room:
                room = step
                if not sizes or sizes[-1] != x:
                    sizes.append(x)
                    demand.append(0)
            t = min(n, room)
            demand[-1], n, room = demand[-1] + t, n - t, room - t
    return sizes, demand


class Stock:
    """How many pieces of each length are left, and the number of the next."""

    def __init__(self, histogram: dict[int, int], length: int):
        self.left, self.next = np.zeros(length + 1, np.int64), np.zeros(length + 1, np.int64)
        for x, n in histogram.items():
            self.left[x] = n

    def longest(self, most: int) -> int:
        """The longest piece up to ``most``; 0 if there is none."""
        here = self.left[most::-1] > 0
        k = int(here.argmax())
        return most - k if here[k] else 0

    def take(self, x: int, n: int) -> int:
        first = int(self.next[x])
        self.next[x] += n
        self.left[x] -= n
        return first


class Plan:
    """Runs and the space that they leave: by free tokens, lists of (first sequence, how many, tokens used)."""

    def __init__(self, length: int):
        self.length, self.runs, self.sequences = length, [], 0
        self.open: list[list[tuple[int, int, int]]] = [[] for _ in range(length + 1)]
        self.any = np.zeros(length + 1, bool)

    def _put(self, sequence: int, count: int, used: int) -> None:
        free = self.length - used
        self.open[free].append((sequence, count, used))
        self.any[free] = True

    def substitute(self, slots: list[tuple[int, int]], times: int, stock: Stock) -> None:
        """Up to ``times`` new sequences of a configuration, whose slots have a size and the one below it. Each takes the
        longest piece that counts as its size; the last one the longest that still fits, since the others leave what
        rounding added. A slot for which no piece of its size is left ends this."""
        while times:
            free, taken = self.length, []
            for k, (size, below) in enumerate(slots):
                x = stock.longest(free if k == len(slots) - 1 else size)
                if x <= below:
                    break
                stock.left[x] -= 1
                taken.append(x)
                free -= x
            for x in taken:
                stock.left[x] += 1
            if len(taken) < len(slots):
                return
            n = min(times, *(int(stock.left[x]) // taken.count(x) for x in taken))
            used = 0
            for x in taken:
                self.runs.append(Run(x, stock.take(x, n), n, self.sequences, used))
                used += x
            self._put(self.sequences, n, used)
            self.sequences, times = self.sequences + n, times - n

    def _fill(self, x: int, number: int, sequence: int, count: int, used: int, each: int) -> None:
        for k in range(each):
            self.runs.append(Run(x, number + k * count, count, sequence, used + k * x))
        self._put(sequence, count, used + each * x)

    def best_fit(self, x: int, number: int, count: int) -> None:
        """Pieces of one length, one by one where they leave the least space, else into new sequences."""
        while count:
            fits = self.any[x:]
            free = x + int(fits.argmax())
            if not fits[free - x]:
                each = min(self.length // x, count)
                n = count // each
                self._fill(x, number, self.sequences, n, 0, each)
                self.sequences += n
            else:
                sequence, n, used = self.open[free].pop()
                each = min(free // x, count)
                more = n - min(n, count // each)
                n -= more
                if more:
                    self.open[free].append((sequence + n, more, used))
                self.any[free] = bool(self.open[free])
                self._fill(x, number, sequence, n, used, each)
            number, count = number + n * each, count - n * each


def planned(histogram: dict[int, int], length: int, groups: int, least: int) -> Plan:
    plan, stock = Plan(length), Stock(histogram, length)
    sizes, demand = grouped(histogram, least, groups)
    if sizes:
        basis, x = configurations(sizes, demand, length)
        slots = list(zip(sizes, [*sizes[1:], 0], strict=True))
        every = [([s for s, n in zip(slots, column, strict=True) for _ in range(n)], times) for column, times in zip(basis.T.astype(int).tolist(), np.floor(x + 1e-9).astype(int).tolist(), strict=True)]
        for chosen, times in sorted(every, reverse=True):
            plan.substitute(chosen, times, stock)
    for x in np.flatnonzero(stock.left)[::-1].tolist():
        plan.best_fit(x, int(stock.next[x]), int(stock.left[x]))
    return plan


def best_plan(histogram: dict[int, int], length: int) -> Plan:
    """The plan with the fewest sequences."""
    return min((planned(histogram, length, g, max(1, int(length * s))) for g in GROUPS for s in LARGE), key=lambda p: p.sequences)


def pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, length: int, end_id: int) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids, and the task that wrote it with its number there among
    the pieces of its length."""
    data = shared_file(docs, vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "piece", "start", "length", "task", "number", "ids"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes, task, seen = _lanes(data.value), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for b in batches:
            for x, y, at, ids in lanes.ids(b.column(1), end_id):
                size = np.diff(at)
                each = -(-size // length)
                doc = np.repeat(np.arange(y - x), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * length
                n = np.minimum(size[doc] - start, length)
                order = np.argsort(n, kind="stable")
                same = n[order]
                first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
                number = np.empty(len(n), np.int64)
                number[order] = seen[same] + np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
                seen += np.bincount(n, minlength=length + 1)
                ends = (4 * np.concatenate([[0], np.cumsum(n)])).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                cols = [b.column(0).slice(x, y - x).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(n), pa.array(np.full(len(n), task, np.int64)), pa.array(number), binary]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, task bigint, number bigint, ids binary")


def best_fit(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids (little-endian, four bytes each), sequence_id, offset.

    Null and empty texts are a document of the end id alone. Only documents of more than ``length`` tokens are cut, into
    pieces of ``length``; the last may be shorter. Rows that repeat an id are packed one by one. Sequence ids run from
    0 without gaps. Other columns aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table = cut(pieces(docs, vocabulary, id_col, text_col, length, end_id), "pieces")
    cells = cut(table.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "cells")
    plan = best_plan(dict(cells.groupBy("length").agg(F.sum("n")).collect()), length)  # at most ``length`` rows
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for r in sorted(plan.runs):
        by_length.setdefault(r.length, []).append((r.number, r.count, r.sequence, r.offset))
    runs = spark.createDataFrame(list(by_length.items()), "length bigint, runs array<struct<number: bigint, count: bigint, sequence: bigint, offset: bigint>>")
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    mine = F.filter("runs", lambda r: (r["number"] < F.col("before") + F.col("n")) & (r["number"] + r["count"] > F.col("before")))
    # A run as the task counts: it begins at ``first``, perhaps before the task's own pieces.
    local = F.transform(mine, lambda r: F.struct((r["number"] - F.col("before")).alias("first"), r["count"].alias("count"), r["sequence"].alias("sequence"), r["offset"].alias("offset")))
    placed = cut(cells.withColumn("before", before).join(F.broadcast(runs), "length").select("task", "length", local.alias("runs")), "places")
    if cells.count() <= BROADCAST_CELLS:
        placed = F.broadcast(placed)
    found = F.element_at(F.filter("runs", lambda r: (F.col("number") >= r["first"]) & (F.col("number") < r["first"] + r["count"])), 1)
    out = table.join(placed, ["task", "length"]).withColumn("run", found)
    discard(cells)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids", (F.col("run.sequence") + F.col("number") - F.col("run.first")).alias("sequence_id"), F.col("run.offset").alias("offset"))
