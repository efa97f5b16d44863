"""Scores of texts by a weighted backoff automaton.

Words of the training documents are counted whole, and so are all pairs and triples; those that occur ``LEAST`` times
or more are part of the model, at any size of input. States are the empty context, words, and pairs. An arc takes the
next word and has its log-probability, discounted; a failure arc goes to the shorter context and has the weight of
what is left, so that the probabilities of each state sum to one.

No machine holds the automaton. Texts are cut into blocks of about ``BLOCK`` tokens, each written once as numbers of
its own distinct words. A block asks for what it visits, by hash, from buckets that the hashes are dealt into:

1. It sends its distinct words, pairs and triples with their counts in training, and gets the counts in all blocks.
   Of the blocks that have an n-gram, one is told that it stands for it.
2. It sends its contexts, with sums over the n-grams that it stands for, and gets the sums of all blocks, of which the
   weights of failure arcs are made. All numbers sent are whole: small, and the same in any order.
3. It walks its texts: each token takes an arc, or one or two failure arcs and then an arc.

N-grams are told apart by 59 bits of hash. A block and a bucket have bounded sizes; how many there are grows with the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import ODD, mix, word_hashes, word_list
from .store import cut
from .workers import frugal, frugal_group, frugal_pair

#: Occurrences in training from which on a pair or triple is part of the model.
LEAST = 2
DISCOUNT = 0.5
#: Tokens in a block; keys in a bucket, about.
BLOCK, BUCKET = 1 << 20, 2_000_000
#: Bits of a key.
KEY = 60
SHIFT = 20
#: The start and the end of a text as tokens: no word has white space or is empty.
START, END = b"\n", b""


def held_out(id_: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds == fold


class Automaton:
    """The same model whole and in one memory, for small tables: blocks must score as it does.

    Arcs by state and word. State 0 is the empty context, 1 + word a word; pairs come after.
    """

    def __init__(self, words: list[bytes], counts: list[int], total: int, known: int):
        self.ids = {w: i for i, w in enumerate(words)}
        self.start = len(words)  # the context before a text
        self.total = total
        self.denominator = total + known + 1
        self.unigram = [math.log10((c + 1) / self.denominator) for c in counts]
        self.context = [*counts, counts[self.ids[END]]]  # as many starts as ends
        self.arcs = {i: (1 + i, p) for i, p in enumerate(self.unigram)}
        self.fail: list[tuple[int, float]] = [(0, 0.0)] * (2 + len(words))
        self.pairs: dict[int, int] = {}

    def _with_weights(self, state: int, below: int, seen: list[tuple[int, int]], whole: int, go) -> None:
        kept = lower = 0.0
        for word, c in seen:
            p = (c - DISCOUNT) / whole
            kept += p
            lower += 10 ** self.step(below, word)[1]
            self.arcs[state << SHIFT | word] = (go(word), math.log10(p))
        self.fail[state] = (below, math.log10(max(1 - kept, 1e-12) / max(1 - lower, 1e-12)))

    def add_pairs(self, counts: dict[int, int]) -> None:
        by: dict[int, list[tuple[int, int]]] = {}
        for n, (key, c) in enumerate(sorted(counts.items())):
            self.pairs[key] = len(self.context) + 1 + n
            by.setdefault(key >> SHIFT, []).append((key & ((1 << SHIFT) - 1), c))
        self.fail += [(0, 0.0)] * len(counts)
        for a, seen in by.items():
            self._with_weights(1 + a, 0, seen, self.context[a], lambda w, a=a: self.pairs[a << SHIFT | w])
        for key, state in self.pairs.items():
            self.fail[state] = (1 + (key & ((1 << SHIFT) - 1)), 0.0)

    def add_triples(self, counts: dict[int, int], pair_counts: dict[int, int]) -> None:
        by: dict[int, list[tuple[int, int]]] = {}
        for key, c in sorted(counts.items()):
            by.setdefault(key >> SHIFT, []).append((key & ((1 << SHIFT) - 1), c))
        for pair, seen in by.items():
            b = pair & ((1 << SHIFT) - 1)
            self._with_weights(self.pairs[pair], 1 + b, seen, pair_counts[pair], lambda w, b=b: self.pairs[b << SHIFT | w])

    def step(self, state: int, word: int) -> tuple[int, float]:
        """Next state and log-probability of a frequent word."""
        total = 0.0
        while (arc := self.arcs.get(state << SHIFT | word)) is None:
            state, weight = self.fail[state]
            total += weight
        return arc[0], total + arc[1]

    def score(self, ids: list[int | None]) -> float:
        """Log-probability of a text, but for what words without an id (None) have as single words."""
        arcs, fail, state, total = self.arcs, self.fail, 1 + self.start, 0.0
        for word in ids:
            if word is None:
                while state:
                    state, weight = fail[state]
                    total += weight
                continue
            while (arc := arcs.get(state << SHIFT | word)) is None:
                state, weight = fail[state]
                total += weight
            state = arc[0]
            total += arc[1]
        return total


def _planes(x: np.ndarray) -> np.ndarray:
    """Lowest bytes of all numbers, then the next ones, and so on: high bytes are alike and pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_planes(x).tobytes())


def _unpacked(x: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Steps between sorted keys: four bytes of noise as they are, the others packed."""
    planes = _planes(np.diff(keys, prepend=np.uint64(0)))
    return planes[:4].tobytes() + zstandard.ZstdCompressor(level=1).compress(planes[4:].tobytes())


def _unpacked_keys(x: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(x[: 4 * n] + zstandard.ZstdDecompressor().decompress(x[4 * n :]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _blocks(rows: DataFrame) -> DataFrame:
    """Texts (id, text, held) as blocks: ids, held and sizes of texts; hashes of distinct words, of which the first are
    ``START`` and ``END``; all tokens as numbers of words, with a start and an end for each text."""
    kind = rows.schema["id"].dataType

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 36
        ids, held, sizes, flat, index = [], [], [], [], {START: 0, END: 1}

        def given() -> pa.RecordBatch:
            of_ids = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(of_ids)], pa.int32()), of_ids)
            out = np.concatenate(held)
            trained = int((np.array(sizes, np.int64) * ~out).sum())
            cols = [pa.array([block], pa.int64()), lists, pa.array([_packed(out)]), pa.array([_packed(np.array(sizes, np.int64))]), pa.array([word_hashes(list(index)).tobytes()]), pa.array([_packed(np.array(flat, np.uint32))]), pa.array([len(flat)], pa.int64()), pa.array([trained], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "held", "sizes", "words", "tokens", "n", "trained"])

        for b in batches:
            at = 0
            for k, text in enumerate(b.column(1)):
                put, tokens = index.setdefault, word_list(text.as_py())
                flat.append(0)
                flat.extend([put(t, len(index)) for t in tokens])
                flat.append(1)
                sizes.append(len(tokens) + 1)
                if len(flat) >= BLOCK or k == b.num_rows - 1:
                    ids.append(b.column(0).slice(at, k + 1 - at))
                    held.append(np.array(b.column(2).slice(at, k + 1 - at).to_pylist(), bool))
                    at = k + 1
                if len(flat) >= BLOCK:
                    yield given()
                    block, ids, held, sizes, flat, index = block + 1, [], [], [], [], {START: 0, END: 1}
        if flat:
            yield given()

    return cut(rows.select("id", "text", "held").mapInArrow(run, f"block bigint, ids array<{kind.simpleString()}>, held binary, sizes binary, words binary, tokens binary, n bigint, trained bigint"), "blocks")


class _Block:
    """Distinct n-grams of a block, where they are, and their keys. Keys of words are odd, of pairs and triples even."""

    def __init__(self, held: bytes, sizes: bytes, words: bytes, tokens: bytes):
        h, flat = np.frombuffer(words, np.uint64), _unpacked(tokens, np.uint32).astype(np.int64)
        self.held, self.sizes, self.n = _unpacked(held, bool), _unpacked(sizes, np.int64), len(h)
        at = np.flatnonzero(flat)  # all but starts
        self.token = flat[at]
        pairs, self.pair = np.unique(flat[at - 1] * self.n + self.token, return_inverse=True)
        self.first, self.second = pairs // self.n, pairs % self.n
        self.third = np.flatnonzero(flat[at - 1])  # tokens with two before them
        triples, where, self.triple = np.unique(self.pair[self.third - 1] * self.n + self.token[self.third], return_index=True, return_inverse=True)
        self.before, self.after = triples // self.n, self.pair[self.third[where]]  # pairs in a triple
        one, spare = np.uint64(1), np.uint64(64 - KEY)
        two = mix(mix(h * ODD[0])[self.first] * ODD[1] + mix(h * ODD[2])[self.second])
        three = mix(mix(two * ODD[3])[self.before] * ODD[4] + mix(h * ODD[5])[triples % self.n])
        self.keys = [mix(h) >> spare | one, two >> spare & ~one, three >> spare & ~one]

    def counts(self) -> list[np.ndarray]:
        train = np.repeat(~self.held, self.sizes)
        return [np.bincount(x[t], minlength=len(k)) for x, t, k in zip((self.token, self.pair, self.triple), (train, train, train[self.third]), self.keys, strict=True)]

    def learn(self, answer: np.ndarray, total: int, known: int) -> None:
        """Counts of all blocks (doubled, and one more where this block stands for the n-gram)."""
        ends = np.cumsum([len(k) for k in self.keys])[:-1]
        self.c1, self.c2, self.c3 = np.split(answer >> 1, ends)
        _, self.own2, self.own3 = np.split((answer & 1).astype(bool), ends)
        self.kinds = total + known + 1
        self.p1 = (self.c1 + 1) / self.kinds
        self.whole = self.c1.copy()
        self.whole[0] = self.c1[1]  # as many starts as ends
        self.known2, self.known3 = self.c2 >= LEAST, self.c3 >= LEAST
        self.p2 = np.where(self.known2, (self.c2 - DISCOUNT) / np.maximum(self.whole[self.first], 1), 1.0)
        self.p3 = np.where(self.known3, (self.c3 - DISCOUNT) / np.maximum(self.c2[self.before], 1), 1.0)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Which words and pairs can have arcs: all others are followed by nothing that is known."""
        return np.flatnonzero(self.whole >= LEAST), np.flatnonzero(self.known2)

    def sums(self) -> list[np.ndarray]:
        """Of each context, numerators of the probabilities of the known n-grams that this block stands for, here and one
        word shorter. The denominators are a context's own, so sums need no more than these."""
        words, pairs = self.contexts()
        x, y = self.own2 & self.known2, self.own3 & self.known3
        one = [np.bincount(self.first[x], p[x], self.n)[words] for p in (2 * self.c2 - 1, self.c1[self.second] + 1)]
        two = [np.bincount(self.before[y], p[y], len(self.c2))[pairs] for p in (2 * self.c3 - 1, 2 * self.c2[self.after] - 1)]
        return [np.concatenate(z).astype(np.int64) for z in zip(one, two, strict=True)]

    def scored(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, sum of single words, and score of each text. ``sums``: of all blocks, two rows."""
        words, pairs = self.contexts()
        kept = sums[0] / np.concatenate([2 * self.whole[words], 2 * self.c2[pairs]])
        lower = sums[1] / np.concatenate([np.full(len(words), self.kinds), 2 * np.maximum(self.whole[self.second[pairs]], 1)])
        weights = np.log10(np.maximum(1 - kept, 1e-12) / np.maximum(1 - lower, 1e-12))
        fail1, fail2 = np.zeros(self.n), np.zeros(len(self.c2))
        fail1[words], fail2[pairs] = np.split(weights, [len(words)])
        single = np.log10(self.p1)
        of_pair = np.where(self.known2, np.log10(self.p2), fail1[self.first] + single[self.second])
        of_triple = np.where(self.known3, np.log10(self.p3), fail2[self.before] + of_pair[self.after])
        step = of_pair[self.pair]
        step[self.third] = of_triple[self.triple]
        at = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        return tuple(np.add.reduceat(x, at) for x in ((self.c1 > 0)[self.token].astype(np.int64), single[self.token], step))


def _asked(block: int, keys: np.ndarray, values: list[np.ndarray], buckets: int) -> list[tuple]:
    """Rows (block, bucket, m, keys, x, y) in the order of keys; m of them."""
    order = np.argsort(keys)
    keys, values = keys[order], [v[order] for v in values]
    ends = np.searchsorted(((keys >> np.uint64(KEY - 32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1).astype(np.uint64))
    spans = [(k, slice(ends[k], ends[k + 1])) for k in range(buckets) if ends[k] < ends[k + 1]]
    return [(block, k, int(s.stop - s.start), _packed_keys(keys[s]), *[_packed(v[s]) for v in values], *[None] * (2 - len(values))) for k, s in spans]


ASKED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("m", pa.int64()), ("keys", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])
ASKED_SQL = "block bigint, bucket int, m bigint, keys binary, x binary, y binary"
ANSWER = pa.schema([("block", pa.int64()), ("step", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary()), ("kinds", pa.int64())])
ANSWER_SQL = "block bigint, step int, bucket int, answer binary, kinds bigint"


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _answered(asked: DataFrame, step: int) -> DataFrame:
    """Step 0: counts. Step 1: two sums. ``kinds``: words of the bucket that training has, once a bucket."""

    @frugal_group
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        parts = [_unpacked_keys(x, m) for x, m in zip(t.column("keys").to_pylist(), t.column("m").to_pylist(), strict=True)]
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.diff(np.concatenate([at, [len(keys)]]))

        def total(name: str) -> np.ndarray:
            return np.add.reduceat(np.concatenate([_unpacked(x, np.int64) for x in t.column(name).to_pylist()])[order], at)

        kinds = 0
        if step:
            of = np.repeat(np.stack([total("x"), total("y")]), times, axis=1)
        else:
            c = total("x")
            kinds = int(((keys[at] & np.uint64(1) == 1) & (c > 0)).sum())
            of = np.repeat(c * 2, times)[None, :]
            of[0, at] += 1
        out = np.empty_like(of)
        out[:, order] = of
        blobs = [_packed(x.ravel()) for x in np.split(out, np.cumsum([len(p) for p in parts])[:-1], axis=1)]
        n = len(blobs)
        return pa.table([t.column("block").combine_chunks(), pa.array([step] * n, pa.int32()), t.column("bucket").combine_chunks(), pa.array(blobs, pa.binary()), pa.array([kinds] + [0] * (n - 1), pa.int64())], schema=ANSWER)

    return cut(asked.groupBy("bucket").applyInArrow(run, ANSWER_SQL), "answers", release=True)


def _block_of(t: pa.Table) -> _Block:
    return _Block(*[t.column(c)[0].as_py() for c in ("held", "sizes", "words", "tokens")])


def _received(answers: pa.Table, keys: np.ndarray, step: int) -> np.ndarray:
    """What was asked with ``_asked``, in the order of ``keys``: a row of counts, or two of sums."""
    rows = sorted((b, a) for s, b, a in zip(*[answers.column(c).to_pylist() for c in ("step", "bucket", "answer")], strict=True) if s == step)
    out = np.empty((step + 1, len(keys)), np.int64)
    if rows:
        out[:, np.argsort(keys)] = np.concatenate([_unpacked(a, np.int64).reshape(step + 1, -1) for _, a in rows], axis=1)
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """One row for each input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id leaves ``fold`` train nothing. Null and empty texts are the end token alone. A null id
    counts as the empty text for the folds. Rows that repeat an id are scored one by one. With no training text all
    tokens are unknown; an empty table gives an empty result. A word of any length is a word.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("held", held_out(F.col("id"), folds, fold))
    kind = rows.schema["id"].dataType
    blocks = _blocks(rows)
    size, total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    buckets = max(8, math.ceil(size / BUCKET))

    @frugal
    def ask_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(k, 1)])
                x = _block_of(t)
                yield from _columns(_asked(t.column("block")[0].as_py(), np.concatenate(x.keys), [np.concatenate(x.counts()).astype(np.int64)], buckets), ASKED).to_batches()

    counts = _answered(blocks.select("block", "held", "sizes", "words", "tokens").mapInArrow(ask_counts, ASKED_SQL), 0)
    known = counts.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]

    def learned(t: pa.Table, answers: pa.Table) -> tuple[_Block, np.ndarray]:
        x = _block_of(t)
        x.learn(_received(answers, np.concatenate(x.keys), 0)[0], total, known)
        words, pairs = x.contexts()
        return x, np.concatenate([x.keys[0][words], x.keys[1][pairs]])

    @frugal_pair
    def ask_weights(t: pa.Table, answers: pa.Table) -> pa.Table:
        x, keys = learned(t, answers)
        return _columns(_asked(t.column("block")[0].as_py(), keys, x.sums(), buckets), ASKED)

    @frugal_pair
    def walk(t: pa.Table, answers: pa.Table) -> pa.Table:
        x, keys = learned(t, answers)
        found, base, score = x.scored(_received(answers, keys, 1))
        return pa.table({"id": t.column("ids").combine_chunks().flatten(), "held": x.held, "n": x.sizes, "found": found, "base": base, "score": score})

    by_block = lambda df: df.groupBy("block")
    weights = _answered(by_block(blocks).cogroup(by_block(counts)).applyInArrow(ask_weights, ASKED_SQL), 1)
    out = by_block(blocks).cogroup(by_block(counts.unionByName(weights))).applyInArrow(walk, f"id {kind.simpleString()}, held boolean, n bigint, found bigint, base double, score double")
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("found").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
