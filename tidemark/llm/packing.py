"""Packing of documents into sequences of at most ``length`` tokens, in order, by dynamic programming.

Each task packs the stream of its documents as it reads them: nothing is shuffled, documents keep their order and a
task that runs again gives the same rows. Cuts fall on ends of documents or sentences; where none is near, every
``HARD`` tokens. The program minimises padding plus what each cut costs; the best start of a sequence is the least
of a sliding window, which a monotone queue holds. Sequences whose length is a power of two need no padding.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _lanes, is_sentence_end, shared_file
from .workers import frugal

#: Costs in tokens of padding: a cut inside a document at a sentence's end, elsewhere, and each sequence.
AT_SENTENCE, ELSEWHERE, SEQUENCE = 4.0, 64.0, 16.0
#: Places to cut are at most so many tokens apart.
HARD = 64
#: Tokens that are packed at once; what the last sequence holds goes on to the next round.
ROUND = 1 << 18


def best_cuts(places: np.ndarray, costs: np.ndarray, length: int) -> list[int]:
    """Indices into ``places`` (rising from 0, gaps at most ``length``) where sequences end, at least total cost."""
    n = len(places)
    exact: list[list[int]] = [[] for _ in range(n)]  # starts that make a sequence of a power of two
    size = 1
    while size <= length:
        at = np.searchsorted(places, places - size)
        for j in np.flatnonzero((places >= size) & (places[np.minimum(at, n - 1)] == places - size)).tolist():
            exact[j].append(int(at[j]))
        size *= 2
    place, cost = places.tolist(), costs.tolist()
    total, come = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # rising by total + place
    for j in range(1, n):
        here = place[j]
        while place[queue[0][1]] < here - length:
            queue.popleft()
        key, i = queue[0]
        best = key + length - here
        for x in exact[j]:
            if total[x] < best:
                best, i = total[x], x
        total[j], come[j] = best + cost[j] + SEQUENCE, i
        key = total[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n - 1
    while j:
        out.append(j)
        j = come[j]
    return out[::-1]


class Packer:
    """The stream of one task. ``add`` and ``end`` give lists of pieces."""

    def __init__(self, ends_sentence: np.ndarray, length: int, first: int):
        self.ends, self.length, self.sequence = ends_sentence, length, first
        self.open: list[tuple[object, np.ndarray, int, int]] = []  # id, ids, start, tokens of the whole document
        self.size = 0

    def add(self, key: object, ids: np.ndarray) -> list[tuple]:
        self.open.append((key, ids, 0, len(ids)))
        self.size += len(ids)
        return self._pack(False) if self.size >= ROUND else []

    def end(self) -> list[tuple]:
        return self._pack(True) if self.open else []

    def _pack(self, last: bool) -> list[tuple]:
        ids = np.concatenate([x[1] for x in self.open])
        starts = np.concatenate([[0], np.cumsum([len(x[1]) for x in self.open])])
        cost = np.full(len(ids) + 1, np.inf)
        cost[1:][self.ends[ids]] = AT_SENTENCE
        cost[starts] = 0.0
        near = np.flatnonzero(cost < np.inf)
        for a, b in zip(near[:-1], near[1:], strict=True):
            if b - a > HARD:
                cost[a + HARD : b : HARD] = ELSEWHERE
        places = np.flatnonzero(cost < np.inf)
        cuts = places[best_cuts(places, cost[places], self.length)].tolist()
        rest = cuts.pop(-2) if not last and len(cuts) > 1 else None
        if rest is not None:
            cuts[-1] = rest
        else:
            cuts = cuts[:-1] + self._tail(cuts[-2] if len(cuts) > 1 else 0, cuts[-1])
        upto = cuts[-1]
        bounds = np.unique(np.concatenate([starts[starts < upto], [0], cuts])).tolist()
        data, out = memoryview(ids.astype("<u4").tobytes()), []
        of_doc = (np.searchsorted(starts, bounds[:-1], side="right") - 1).tolist()
        of_seq = np.searchsorted(cuts, bounds[:-1], side="right").tolist()
        begins = [0, *cuts]
        for a, b, d, q in zip(bounds[:-1], bounds[1:], of_doc, of_seq, strict=True):
            key, _, before, whole = self.open[d]
            out.append((key, before + a - int(starts[d]), b - a, bytes(data[4 * a : 4 * b]), whole, self.sequence + q, a - begins[q]))
        self.sequence += len(cuts)
        left = []
        if upto < len(ids):
            d = int(np.searchsorted(starts, upto, side="right") - 1)
            for k in range(d, len(self.open)):
                key, own, before, whole = self.open[k]
                skip = max(0, upto - int(starts[k]))
                left.append((key, own[skip:], before + skip, whole))
        self.open, self.size = left, len(ids) - upto
        return out

    def _tail(self, a: int, b: int) -> list[int]:
        """Ends of the stream's last sequences: powers of two, unless little padding is left."""
        out = []
        while a < b:
            n = b - a
            a += n if self.length - n <= HARD // 2 else 1 << (n.bit_length() - 1)
            out.append(a)
        return out


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, at_once: int | None = None) -> DataFrame:
    """One row for each piece: id, start, length, ids (little-endian, four bytes each), doc_tokens, sequence_id, offset.

    Null and empty texts are a document of the end id alone. Rows that repeat an id are packed one by one. A text
    of any length is cut into as many pieces as it needs. Sequence ids hold the task's number in their upper bits.
    An empty table gives no rows. ``length`` is a power of two and at least ``HARD``. Some ``at_once`` bytes of text are
    encoded together: fewer take less memory and more time.
    """
    data = shared_file(docs, vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in names[1:]]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = _lanes(data.value)
        text = lanes.enc.v.text
        ends = np.zeros(max(text) + 1, dtype=bool)
        ends[[i for i, t in text.items() if is_sentence_end(t)]] = True
        packer = Packer(ends, length, TaskContext.get().partitionId() << 36)
        key_type = None

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *[pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)]], names=names)

        for b in batches:
            key_type, keys = b.column(0).type, b.column(0).to_pylist()
            for x, y, at, ids in lanes.ids(b.column(1), end_id, at_once):
                ids, at = ids.astype("<u4"), at.tolist()
                for k in range(x, y):
                    if pieces := packer.add(keys[k], ids[at[k - x] : at[k - x + 1]]):
                        yield table(pieces)
        if pieces := packer.end():
            yield table(pieces)

    out = rows.mapInArrow(run, "id {}, {}".format(kind.simpleString(), ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names[1:])))
    return out.withColumnRenamed("id", id_col)
