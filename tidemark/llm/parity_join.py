"""Similarity join of documents by the Jaccard index of their word shingles, over parity sketches.

A sketch of a set is made by XOR: each element flips bits in one of ``k`` words, so two sketches differ in no more
words (and no more bits, where an element flips one) than the sets' symmetric difference has elements. Sets with an
index of at least ``t`` differ in at most d = (1 - t) / (1 + t) * (|A| + |B|) elements.

1. Profiles: each text's number of shingles, a 128-bit digest, and a bit sketch. Texts with equal sets are a class,
   named by 64 bits of the digest; from here on classes are compared, never ids or copies. Counters of shingles in
   2^20 cells tell frequent shingles.
2. Bands of sizes, each 1 / t wide; a set belongs to its own band and the next, so any two that can be similar meet.
   Words of sketches with more than d words, of which at least one is equal and not empty, are the join keys. First
   only shingles that aren't frequent count, which cannot raise the difference; a set with too few of these for the
   argument to hold adds keys of all its shingles, dealt out anew until it holds. So a passage that many documents
   share is no key of documents that have much else.
3. Of classes with an equal key, all are compared with the smallest name alone: first within a task before anything is
   shuffled, then of all tasks. Bit sketches with too large a Hamming distance drop out; the others are verified on
   the sets themselves, and links make components.
4. Where such a comparison failed, classes of different components may still be similar. Two that have a key in common
   were both compared with that key's smallest, so failed comparisons connect them: what they connect is a group, and
   every pair that isn't decided is within one. A group's members are compared in blocks of bounded size, in memory, by
   bit sketches, each pair once. First a block gives a spanning forest of what is near, so no more pairs than
   members; these are verified, and links make larger components. Then all near pairs that are still across
   components are verified.
5. A group of more than ``GROUP`` members is compared by key instead: only members that have a key in common meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import ODD, mix, shingle_set
from .store import cut, discard
from .workers import frugal, frugal_group

CELLS = 1 << 20
CHUNK = 1 << 16
#: A cell is frequent from this many documents on, or from this many times the mean of all cells.
FREQUENT, TIMES = 32, 8
#: Keys that a task gathers before it compares them and hands them on; keys in a bucket; members in a block.
GATHER, BUCKET, BLOCK = 700_000, 1_000_000, 4096
#: Bits of a key within its bucket, and of a class's name beside it (8 more from 2^26 texts on).
KEY, NAME = 40, 32
#: A group of bit sketches is cut into this many parts of ``BLOCK`` members, then into no more than keep a part within
#: so many members and so many elements of their sets: each member is copied once for each part.
PARTS, WIDE, SKETCHED = 2, 32_768, 16_000_000
#: Elements of the sets in a block.
ELEMENTS = 2_000_000
#: Bits of a set of ids that is sent to all executors: 1 MB. False hits cost time only.
FILTER = 1 << 23
LIGHT_TRIES, FULL_TRIES = 3, 40
#: Members of a group from which on they are compared by key: speed, not results.
GROUP = 100_000


class Keys:
    """Join keys of sets. ``num / den`` is the least similarity."""

    def __init__(self, num: int, den: int, frequent: np.ndarray):
        self.num, self.den, self.frequent = num, den, frequent
        self.step = math.log(max(den / num, 1.05))
        self.tops: dict[int, int] = {}

    def band_of(self, n: int) -> int:
        return int(math.floor(math.log(n) / self.step + 1e-9))

    def band_top(self, band: int) -> int:
        """The largest size in a band; of a band without sizes, that of the band before."""
        n = int(math.exp(self.step * (band + 1))) + 2
        while self.band_of(n) > band:
            n -= 1
        return n

    def differ(self, total: int) -> int:
        """The most elements that the symmetric difference of similar sets with ``total`` elements has."""
        return (self.den - self.num) * total // (self.den + self.num)

    def of(self, s: np.ndarray) -> np.ndarray:
        light = s[~self.frequent[(s & np.uint64(CELLS - 1)).astype(np.int64)]]
        own = self.band_of(len(s))
        return np.concatenate([self._in_band(s, light, own), self._in_band(s, light, own + 1)])

    def _in_band(self, s: np.ndarray, light: np.ndarray, band: int) -> np.ndarray:
        top = self.tops[band] if band in self.tops else self.tops.setdefault(band, self.band_top(band))
        need = self.differ(len(s) + min(top, len(s) * self.den // self.num))
        words = int(1.12 * self.differ(2 * top)) + 2
        out = []
        for stage in range(LIGHT_TRIES + FULL_TRIES):
            base, t = (light, stage) if stage < LIGHT_TRIES else (s, stage - LIGHT_TRIES)
            if not len(base):
                continue
            u = np.sort(mix(base * ODD[1] + np.uint64(t))) if t else base
            word = ((u >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)  # rises with u
            at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out.append(mix(np.bitwise_xor.reduceat(u, at) ^ mix(word[at] * ODD[2] + np.uint64(band * 64 + stage))))
            if len(at) > need:
                return np.concatenate(out)
        return np.concatenate([*out, mix(s ^ mix(np.uint64([band * 64 + 63])))])  # each element is a key


def _name(digest: bytes) -> int:
    """The name of a class: the first 64 bits of the digest of its set."""
    return int.from_bytes(digest[:8], "little", signed=True)


def sketch_of(s: np.ndarray) -> bytes:
    """Parity bits, about three for each element; a power of two from 512 to 65,536."""
    bits = min(1 << 16, max(512, 1 << (3 * len(s)).bit_length()))
    odd = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The same sketch with fewer bits: parities of the parts together."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, k1, k2, bits) of every text, and of each task (-1, chunk, counters) with ``n`` null."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen, fresh, size = np.zeros(CELLS, np.uint32), set(), [], 0  # a class has its sketch once in a task
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bits", pa.binary())])
        for b in batches:
            n, k1, k2, bits = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), width)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                k1.append(_name(digest))
                k2.append(int.from_bytes(digest[8:], "little", signed=True))
                bits.append(sketch_of(s) if len(s) and digest not in seen else None)
                if digest not in seen:
                    seen.add(digest)
                    fresh.append((s & np.uint64(CELLS - 1)).astype(np.int64))
                    size += len(s)
                    if size >= GATHER:
                        cells, fresh, size = cells + np.bincount(np.concatenate(fresh), minlength=CELLS).astype(np.uint32), [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.binary())], schema=schema)
        if fresh:
            cells = cells + np.bincount(np.concatenate(fresh), minlength=CELLS).astype(np.uint32)
        if seen:
            pack = zstandard.ZstdCompressor(level=1).compress
            parts = [pack(cells[i : i + CHUNK].tobytes()) for i in range(0, CELLS, CHUNK)]
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(range(len(parts)), pa.int64()), none, pa.array(parts, pa.binary())], schema=schema)

    return cut(docs.mapInArrow(run, "id bigint, n bigint, k1 bigint, k2 bigint, bits binary"), "profiles")


def _frequent(profiles: DataFrame) -> np.ndarray:
    """Which cells are frequent: 2^20 flags, whatever the input's size."""

    @frugal_group
    def add(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        total = np.zeros(CHUNK, np.int64)
        for x in t.column("bits"):
            total += np.frombuffer(unpack(x.as_py()), np.uint32)
        return pa.table({"chunk": [t.column("k1")[0].as_py()], "sum": [int(total.sum())], "cells": [total.tobytes()]})

    parts = profiles.where("n is null and k1 is not null and k2 is null").select("k1", "bits").groupBy("k1").applyInArrow(add, "chunk bigint, sum bigint, cells binary")
    cells, total = np.zeros(CELLS, np.int64), 0
    for r in parts.collect():
        cells[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.cells, np.int64)
        total += r.sum
    return cells >= max(FREQUENT, TIMES * total / CELLS)


def _starred(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and id; in that order where each key begins, how many members it has, and each member's smallest."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.concatenate([at, [len(keys)]]))
    return order, at, times, np.repeat(ids[at], times)


def _distinct(*columns: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([c.astype(np.int64) for c in columns], axis=1), axis=0)


def _label(place: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """A key as a column: its place in the bucket, and the bucket. Keys that clash are compared as one, which costs time only."""
    return (place ^ (np.asarray(bucket).astype(np.uint64) << np.uint64(KEY))).view(np.int64)


def _planes(x: np.ndarray, first: int, end: int) -> bytes:
    """Bytes ``first`` to ``end`` of integers: all first ones, then all second ones."""
    return x.view(np.uint8).reshape(-1, 8)[:, first:end].T.tobytes()


def _integers(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view(np.uint64).ravel()


def coded(place: np.ndarray, names: np.ndarray, more: np.ndarray, name: int, pack: Callable[[bytes], bytes]) -> bytes:
    """Keys of a bucket by place, a class's name of ``name`` bytes with each, and a flag. Only steps between places are
    there; their upper bytes are few and packed. What a key takes hardly depends on how many buckets there are."""
    step = np.diff(place, prepend=np.uint64(0)) & np.uint64((1 << KEY) - 1)
    upper = pack(_planes(step, 3, 4))
    return np.array([len(step), len(upper)], np.uint32).tobytes() + _planes(step, 0, 3) + _planes(names, 0, name) + upper + pack(_planes(step, 4, KEY // 8) + more.tobytes())


def decoded(block: bytes, name: int, unpack: Callable[[bytes], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, names and flags of a block."""
    n, upper = np.frombuffer(block[:8], np.uint32).tolist()
    names, packed = 8 + 3 * n, 8 + (3 + name) * n
    last = unpack(block[packed + upper :])
    step = _integers(block[8:names] + unpack(block[packed : packed + upper]) + last[:-n], n)
    return np.cumsum(step) & np.uint64((1 << KEY) - 1), _integers(block[names:packed], n).view(np.int64), np.frombuffer(last[-n:], bool)


def _met(docs: DataFrame, keys: Keys, width: int, buckets: int, bits: int, members: bool = False) -> DataFrame:
    """Rows (key, a, b, w) of classes by the last ``bits`` bits of their names. Without a key: the smallest that has some
    key, and another that has it; ``w`` is 1 if there is a third. With ``members``, also with a key: a member ``a`` of a
    key; all members of keys of three or more are there.

    Of a key that three or more have in a task only the first is sent to the key's bucket. The others, and pairs, are
    dealt out evenly: they pass through the exchange, but need not meet."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), *[(c, pa.int64()) for c in "kabw"]])
    size_of_name = -(-bits // 8)
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def rows(bucket, keys_=None, key=None, a=None, b=None, w=None) -> pa.RecordBatch:
        n = len(bucket)
        cols = [pa.array(bucket, pa.int32()), keys_, key, a, b, w]
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, pack = shared.value, set(), zstandard.ZstdCompressor(level=1).compress
        found: list[np.ndarray] = []
        whose: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            k, i = np.concatenate(found), np.concatenate(whose)
            order, at, times, least = _starred(k, i)
            k, i = k[order], i[order]
            several = np.repeat(times, times) > 2
            up = ~several
            up[at] = True
            bucket = ((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            ends = np.searchsorted(bucket[up], np.arange(buckets + 1).astype(np.uint64))
            used = [x for x in range(buckets) if ends[x] < ends[x + 1]]
            # Where a key is in its bucket: the first bits are enough, since pairs are verified.
            place = (k * np.uint64(buckets)) >> np.uint64(64 - KEY)
            first, names, more = place[up], i[up], several[up]
            spans = [slice(ends[x], ends[x + 1]) for x in used]
            yield rows(used, [coded(first[x], names[x], more[x], size_of_name, pack) for x in spans])
            rest = ~up & members
            labels, others = _label(place[rest], bucket[rest]), i[rest]
            for x in range(0, len(labels), 100_000):
                y = slice(x, x + 100_000)
                yield rows(np.arange(x, x + len(labels[y])) % buckets, key=labels[y], a=others[y])
            star = several & (i != least)
            pairs = _distinct(least[star], i[star])
            for x in range(0, len(pairs), 100_000):
                p = pairs[x : x + 100_000]
                yield rows(np.arange(x, x + len(p)) % buckets, a=p[:, 0], b=p[:, 1], w=np.ones(len(p), np.int64))

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingle_set(text.as_py(), width)
                if i is None or not len(s):
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if digest in seen:
                    continue  # another row of the task stands for this set
                seen.add(digest)
                found.append(make.of(s))
                whose.append(np.full(len(found[-1]), _name(digest) & ((1 << bits) - 1), np.int64))
                size += len(found[-1])
                if size >= GATHER:
                    yield from flush()
                    found, whose, size = [], [], 0
        if found:
            yield from flush()

    @frugal_group
    def meet(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        known = t.filter(t.column("keys").is_valid())
        out = [t.filter(t.column("keys").is_null()).select(list("kabw"))]
        if known.num_rows:
            k, ids, more = (np.concatenate(x) for x in zip(*[decoded(x.as_py(), size_of_name, unpack) for x in known.column("keys")], strict=True))
            order, at, times, least = _starred(k, ids)
            k, ids, more = k[order], ids[order], more[order]
            wide = np.repeat((times > 2) | (np.add.reduceat(more.astype(np.int64), at) > 0), times)
            star = ids != least
            pairs = _distinct(least[star], ids[star], wide[star])
            out.append(pa.table({"k": pa.nulls(len(pairs), pa.int64()), "a": pairs[:, 0], "b": pairs[:, 1], "w": pairs[:, 2]}))
            if members:
                labels = _label(k[wide], known.column("bucket")[0].as_py())
                none = pa.nulls(len(labels), pa.int64())
                out.append(pa.table({"k": labels, "a": ids[wide], "b": none, "w": none}))
        return pa.concat_tables(out).rename_columns(["key", "a", "b", "w"])

    parts = docs.mapInArrow(run, "bucket int, keys binary, k bigint, a bigint, b bigint, w bigint")
    return cut(parts.groupBy("bucket").applyInArrow(meet, "key bigint, a bigint, b bigint, w bigint"), "met", release=True)


def _named(met: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, w): pairs of classes, of pairs in ``met`` that have their short names (``names``: c, short). A short name of
    several classes stands for each, and they make pairs, too, with the smallest: keys can't tell them apart."""
    pairs = met.groupBy("a", "b").agg(F.max("w").alias("w"))
    for c in "ab":
        pairs = pairs.join(names.select(F.col("short").alias(c), F.col("c").alias(f"c{c}")), c)
    least = names.groupBy("short").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("short", "a")
    twins = names.join(least, "short").where("c > a").select("a", F.col("c").alias("b"), F.lit(1).cast("long").alias("w"))
    return pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w").unionByName(twins)


def _flags(ids: DataFrame) -> np.ndarray:
    """A set of ids (column ``id``) as ``FILTER`` bits by hash."""
    h = ids.select(F.xxhash64("id").bitwiseAND(FILTER - 1).alias("h"))
    words = h.select(F.shiftright("h", 6).alias("w"), F.expr("shiftleft(1L, int(h & 63))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    out = np.zeros(FILTER // 64, np.int64)
    for r in words.collect():
        out[r.w] = r.v
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _sets_of(docs: DataFrame, classes: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """(c, s): the sets of the classes in ``names`` (c), from the texts of the ids that stand for them."""
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(_flags(classes.join(names, "c", "left_semi").select("id"))))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(packed.value).astype(bool)
        for b in batches:
            sets = [shingle_set(text.as_py(), width) for text in b.column(0).filter(pa.array(flags[np.asarray(b.column(1))]))]
            data = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([_name(xxhash.xxh3_128_digest(x)) for x in data], pa.int64()), pa.array(data, pa.binary())], names=["c", "s"])

    rows = docs.where("id is not null").select("text", F.xxhash64("id").bitwiseAND(FILTER - 1).alias("h"))
    sets = rows.mapInArrow(run, "c bigint, s binary").join(names, "c", "left_semi")
    return cut(sets.dropDuplicates(["c"]), "sets")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, keys: Keys, width: int) -> DataFrame:
    """Links among distinct ``pairs`` (a, b) of classes."""
    side = lambda c: classes.select(F.col("c").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}"))
    num, den = keys.num, keys.den
    fit = F.least("na", "nb") * den >= F.greatest("na", "nb") * num

    @frugal
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.to_pydict()
            keep = []
            for na, nb, sa, sb in zip(x["na"], x["nb"], x["sa"], x["sb"], strict=True):
                size = min(len(sa), len(sb))
                keep.append(int(np.bitwise_count(folded(sa, size) ^ folded(sb, size)).sum()) <= keys.differ(na + nb))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    close = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(fit).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near, "a bigint, b bigint"), "close", batch=1000)
    names = close.select(F.col("a").alias("c")).unionByName(close.select(F.col("b").alias("c"))).distinct()
    sets = _sets_of(docs, classes, names, width)

    @frugal
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for sa, sb in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = close.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    out = cut(both.select("a", "b", "sa", "sb").mapInArrow(check, "a bigint, b bigint"), "verified", batch=100)
    discard(close, sets)
    return out


def _groups(pairs: DataFrame, roots: DataFrame, classes: DataFrame, step: float) -> DataFrame:
    """(key, id, n): classes of a group, for each band, and their sizes. Failed comparisons among ``pairs`` connect components; keys belong
    to a band, so only those connect that both have the band as their own or the next."""
    band = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9)
    own = classes.select(F.col("c").alias("id"), band.alias("own"), "n").join(roots, "id", "left").select("id", "own", "n", F.coalesce("root", "id").alias("root"))
    both = pairs
    for c in "ab":
        both = both.join(own.select(F.col("id").alias(c), F.col("own").alias(f"own_{c}"), F.col("root").alias(f"root_{c}")), c)
    bands = F.when(F.col("own_a") == F.col("own_b"), F.array(F.col("own_a"), F.col("own_a") + 1)).when(F.abs(F.col("own_a") - F.col("own_b")) == 1, F.array(F.greatest("own_a", "own_b")))
    failed = both.where("root_a <> root_b").select("root_a", "root_b", F.explode(bands).alias("band"))
    node = lambda root: F.xxhash64(F.col(root), F.col("band"))
    group = components(failed.select(F.least(node("root_a"), node("root_b")).alias("a"), F.greatest(node("root_a"), node("root_b")).alias("b")).distinct())
    placed = own.select("id", "n", "root", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("band")).select("id", "n", node("root").alias("node"))
    return cut(placed.join(group.select(F.col("id").alias("node"), F.col("root").alias("key")), "node").select("key", "id", "n"), "groups")


def _blocks(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, id, n, root, m, size) of entries (key, id, n) of keys whose members, ``m`` of them with ``size`` elements, are
    of different components."""
    placed = entries.join(roots, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    across = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("size")).where("lo <> hi").select("key", "m", "size")
    return placed.join(across, "key")


def _near(entries: DataFrame, classes: DataFrame, keys: Keys, forest: bool) -> DataFrame:
    """Of members of a key, of different components, whose bit sketches are near: with ``forest``, pairs (key, a, b) that
    join what no pair before in their block has joined; else (key, a, a) of each member that has such another.
    ``entries`` (key, id, n, root, m, size)."""
    parts = F.greatest(F.least(F.ceil(F.col("m") / BLOCK), F.lit(PARTS)), F.ceil(F.col("m") / WIDE), F.ceil(F.col("size") / SKETCHED))
    members = entries.select("key", "id", "n", "root", parts.cast("int").alias("parts"))
    members = members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = classes.select(F.col("c").alias("id"), "bits")
    members = members.join(own, "id").select("key", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "id", "root", F.col("n").cast("int").alias("n"), "bits")
    ordered = members.repartition(F.col("key"), F.col("p"), F.col("q")).sortWithinPartitions("key", "p", "q", "part")

    def compare(rows: list[tuple]) -> Iterator[np.ndarray]:
        """``rows``: (part, id, root, n, bits) of one block against another, or against itself; ids of pairs."""
        size = min(len(r[4]) for r in rows)
        bits = np.stack([folded(r[4], size) for r in rows])
        part, ids, root, n = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        itself = part[0] == part[-1]
        at = 0 if itself else int(np.searchsorted(part, part[-1]))
        marked = np.zeros(len(rows), bool)
        # Few enough at once that their sketches stay in the processor's cache.
        for c, x in ((c, x) for c in range(at, len(rows), 2048) for x in range(min(c + 2048, len(rows)) - 1 if itself else at)):
            y = slice(max(x + 1, c) if itself else c, c + 2048)
            ok = (root[y] != root[x]) & (np.minimum(n[y], n[x]) * keys.den >= np.maximum(n[y], n[x]) * keys.num)
            if not ok.any():
                continue
            z = np.flatnonzero(ok) + y.start
            far = np.bitwise_count(bits[z] ^ bits[x]).sum(axis=1)
            z = z[far <= (keys.den - keys.num) * (n[z] + n[x]) // (keys.den + keys.num)]
            if not len(z):
                continue
            if forest:
                yield _joined(ids, root, x, z)
            else:
                marked[x] = marked[z] = True
        if marked.any():
            yield np.stack([ids[marked], ids[marked]], axis=1)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = (None,), []

        def of_group() -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for pairs in compare(rows) if len(rows) > 1 else ():
                out.append(pairs)
                size += len(pairs)
                if size >= 100_000:
                    yield given(out)
                    out, size = [], 0
            if out:
                yield given(out)

        def given(out: list[np.ndarray]) -> pa.RecordBatch:
            x = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), group[0], np.int64)), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["key", "a", "b"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for key, p, q, *row in zip(*cols, strict=True):
                if (key, p, q) != group:
                    yield from of_group()
                    group, rows = (key, p, q), []
                rows.append(tuple(row))
        yield from of_group()

    return cut(ordered.mapInArrow(run, "key bigint, a bigint, b bigint"), "near")


def _joined(ids: np.ndarray, root: np.ndarray, x: int, z: np.ndarray) -> np.ndarray:
    """Pairs of ``x`` with one of ``z`` of each component, which become one in ``root``."""
    joined, first = np.unique(root[z], return_index=True)
    z = z[first]
    root[np.isin(root, joined)] = root[x]
    return np.stack([np.minimum(ids[z], ids[x]), np.maximum(ids[z], ids[x])], axis=1)


def links_within(part: np.ndarray, ids: np.ndarray, root: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> Iterator[np.ndarray]:
    """Links that join components, of one block against another, or against itself. What a set has in common with all
    others comes from an index of the shingles that several sets have."""
    n = np.array([len(s) for s in sets], np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    times = np.bincount(element)
    owner = np.repeat(np.arange(len(sets)), n)[np.argsort(element, kind="stable")]
    first = np.cumsum(times) - times
    itself = part[0] == part[-1]
    at = 0 if itself else int(np.searchsorted(part, part[-1]))
    for x in range(len(sets) - 1) if itself else range(at):
        y = slice(x + 1, None) if itself else slice(at, None)
        ok = (root[y] != root[x]) & (np.minimum(n[y], n[x]) * den >= np.maximum(n[y], n[x]) * num)
        if not ok.any():
            continue
        own = element[ends[x] : ends[x + 1]]
        own = own[times[own] > 1]
        size = times[own]
        both = np.bincount(owner[np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(size.sum())], minlength=len(sets))
        z = np.flatnonzero(ok) + y.start
        z = z[den * both[z] >= num * (n[x] + n[z] - both[z])]
        if len(z):
            yield _joined(ids, root, x, z)


def _decided(docs: DataFrame, near: DataFrame, entries: DataFrame, classes: DataFrame, keys: Keys, width: int) -> DataFrame:
    """Links (a, b) among the members (key, a) in ``near`` that join their components (``entries``: key, id, root)."""
    own = classes.select(F.col("c").alias("id"), "n")
    members = entries.select("key", "id", "root").join(near.select("key", F.col("a").alias("id")).distinct(), ["key", "id"]).join(own, "id")
    members = cut(members, "members")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / ELEMENTS)).cast("int").alias("parts")
    spread = members.join(members.groupBy("key").agg(parts), "key")
    spread = spread.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sets = _sets_of(docs, classes, members.select(F.col("id").alias("c")).distinct(), width)
    spread = spread.join(sets.select(F.col("c").alias("id"), "s"), "id").select("key", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "id", "root", "s")
    ordered = spread.repartition(F.col("key"), F.col("p"), F.col("q")).sortWithinPartitions("key", "p", "q", "part")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []

        def of_block() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                part, ids, root = (np.array([r[k] for r in rows], np.int64) for k in range(3))
                for x in links_within(part, ids, root, [np.frombuffer(r[3], np.uint64) for r in rows], keys.num, keys.den):
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for key, p, q, *row in zip(*cols, strict=True):
                if (key, p, q) != block:
                    yield from of_block()
                    block, rows = (key, p, q), []
                rows.append(tuple(row))
        yield from of_block()

    out = cut(ordered.mapInArrow(run, "a bigint, b bigint").distinct(), "decided", batch=100)
    discard(members, sets)
    return out


def parity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """One row for each input row: id, n_shingles and component_id, the smallest id that links reach.

    Two texts link when the Jaccard index of their sets of ``width``-word shingles is at least ``num / den``
    (exactly: den * intersection >= num * union). Null texts count as empty; texts without words link with nothing
    and are their own component. Ids are integers. A row with a null id counts its shingles and has no component.
    Rows that repeat an id and a text are one document, returned as often; rows that repeat an id with other texts
    are documents of that name, each with the component of its own text. An empty table gives an empty result.
    """
    rows = _rows(docs, id_col, text_col)
    table = _profiles(rows, width)
    keys = Keys(num, den, _frequent(table))
    profiles = table.where("n is not null")
    total, texts = profiles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # A task that has a class first in a row with a null id has its sketch there.
    by_set = profiles.where("n > 0").groupBy(F.col("k1").alias("c")).agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    classes = cut(by_set.where("id is not null"), "classes")

    buckets = max(8, math.ceil(total / BUCKET))
    bits = NAME if texts < 1 << 26 else NAME + 8
    names = classes.select("c", "n", F.col("c").bitwiseAND((1 << bits) - 1).alias("short"))
    met = _met(rows, keys, width, buckets, bits)
    pairs = cut(_named(met, names), "pairs")
    links = _verified(rows, pairs.select("a", "b"), classes, keys, width)
    roots = components(links)
    groups = _groups(pairs.where("w = 1"), roots, classes, keys.step)
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    entries = groups.join(sizes.where(F.col("size") <= GROUP), "key", "left_semi")
    large = groups.join(sizes.where(F.col("size") > GROUP), "key", "left_semi").select("id")
    if not large.isEmpty():
        texts = rows.join(classes.join(large, classes.c == large.id, "left_semi").select("id"), "id", "left_semi")
        met = _met(texts, keys, width, buckets, bits, members=True).where("key is not null").select("key", F.col("a").alias("short")).distinct()
        entries = entries.unionByName(met.join(names, "short").select("key", F.col("c").alias("id"), "n"))
    first = cut(_blocks(entries, roots), "members-of-keys")
    near = _near(first, classes, keys, forest=True)
    if not near.isEmpty():
        links = links.unionByName(_verified(rows, near.select("a", "b").distinct(), classes, keys, width))
        roots = components(links)
        # A component that no pair of the forest touches is near no other: its members, and other keys, are done.
        ends = near.select("key", F.col("a").alias("id")).unionByName(near.select("key", F.col("b").alias("id"))).distinct()
        open_ = first.join(ends, ["key", "id"], "left_semi").select("key", "root").distinct()
        left = cut(_blocks(first.join(open_, ["key", "root"], "left_semi").select("key", "id", "n"), roots), "members-left")
        marked = _near(left, classes, keys, forest=False)
        if not marked.isEmpty():
            links = links.unionByName(_decided(rows, marked, left, classes, keys, width))
            roots = components(links)

    own = classes.select("c", "id").join(roots.select(F.col("id").alias("c"), "root"), "c", "left").select("c", "id", F.coalesce("root", "c").alias("root"))
    least = own.groupBy("root").agg(F.min("id").alias("least"))
    of_class = own.join(least, "root").select(F.col("c").alias("k1"), "least")
    out = profiles.select("id", "n", "k1").join(of_class, "k1", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
