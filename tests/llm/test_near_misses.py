"""Groups of texts that share much, but too little to link: every pair is decided, and what is written grows with the texts."""

import collections
import itertools
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import parity_join


def template(rng, k, own, shared=90):
    """Texts of one template: ``shared`` words, then ``own`` of their own."""
    return " ".join([f"t{i}" for i in range(shared)] + [f"w{k}x{i}x{rng.randrange(10**9)}" for i in range(own)])


def least_by_pairs(docs, num=3, den=4):
    """The smallest id that links reach, with every pair compared."""
    sets = {i: set(parity_join.shingle_set(t).tolist()) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def written(spark, monkeypatch, docs):
    """Result, and the rows of each table that is written on the way."""
    rows = collections.Counter()
    cut = parity_join.cut

    def counted(df, name, **how):
        out = cut(df, name, **how)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(parity_join, "cut", counted)
    got = {r.doc_id: r.component_id for r in parity_join.parity_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    monkeypatch.setattr(parity_join, "cut", cut)
    return got, rows


def test_near_misses_write_rows_in_proportion(spark, monkeypatch):
    rng, count = random.Random(1), {}
    for n in (200, 400):
        docs = [(k, template(rng, k, 15)) for k in range(n)]  # 86 of 101 shingles: an index of 0.741
        got, rows = written(spark, monkeypatch, docs)
        assert got == {k: k for k in range(n)}
        count[n] = rows
    assert all(count[400][name] <= 2.5 * count[200][name] + 200 for name in count[400])
    assert max(count[400].values()) <= 60 * 400


@pytest.mark.parametrize("block,elements", [(16, 2_000_000), (4096, 900)])
def test_links_in_groups_of_near_misses(spark, monkeypatch, block, elements):
    monkeypatch.setattr(parity_join, "BLOCK", block)
    monkeypatch.setattr(parity_join, "ELEMENTS", elements)
    rng = random.Random(5)
    docs = [(k, template(rng, k, rng.choice([12, 14, 15, 16, 30]))) for k in range(80)]
    for k in range(80, 120):  # some are like one another beyond the template
        i, other = rng.choice(docs)
        words = other.split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    got, _ = written(spark, monkeypatch, docs)
    assert got == least_by_pairs(docs)
    assert 1 < len(set(got.values())) < len(docs)


@pytest.mark.parametrize("cross", [False, True])
def test_links_within_a_block(cross):
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(6)]
        sets = [np.unique(np.concatenate([base[rng.integers(6)], rng.integers(100, 10**6, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(40)]
        part = np.arange(40) // 20 if cross else np.zeros(40, np.int64)
        ids = rng.permutation(40)
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *parity_join.links_within(part, ids, np.arange(40), sets, 3, 4)])
        of = {int(i): s for i, s in zip(ids, sets, strict=True)}
        index = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert all(index(of[a], of[b]) >= 0.75 for a, b in pairs.tolist())

        def reached(links):
            root = {int(i): int(i) for i in ids}  # noqa: B023
            for a, b in links:
                x, y = root[a], root[b]
                root = {i: x if r == y else r for i, r in root.items()}
            return {frozenset(i for i in root if root[i] == r) for r in root.values()}

        every = [(int(ids[a]), int(ids[b])) for a, b in itertools.combinations(range(40), 2) if index(sets[a], sets[b]) >= 0.75 and (part[a] != part[b] or not cross)]
        assert reached(pairs.tolist()) == reached(every)
        assert len(pairs) < 40


def test_keys_take_as_much_in_many_buckets():
    """What is sent of a key doesn't grow with the buckets, and so not with the input."""
    rng, pack, unpack = np.random.default_rng(3), zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    keys, taken = np.sort(rng.integers(0, 1 << 64, 300_000, np.uint64)), {}
    for buckets in (8, 128, 2048):
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        place = (keys * np.uint64(buckets)) >> np.uint64(64 - parity_join.KEY)
        names, more = rng.integers(0, 1 << 32, len(keys)), rng.random(len(keys)) < 0.02
        taken[buckets] = 0
        for x in range(buckets):
            of = bucket == x
            block = parity_join.coded(place[of], names[of], more[of], 4, pack)
            assert all(np.array_equal(a, b) for a, b in zip(parity_join.decoded(block, 4, unpack), (place[of], names[of], more[of]), strict=True))
            taken[buckets] += len(block)
    assert max(taken.values()) < 9.3 * len(keys) and taken[2048] < 1.25 * taken[8]


@pytest.mark.parametrize("group", [100_000, 5])
def test_short_names_that_clash(spark, monkeypatch, group):
    """Names of two bits: a short name stands for many classes, and no link is lost."""
    for name, value in (("NAME", 2), ("GROUP", group), ("BUCKET", 300), ("GATHER", 2_000)):
        monkeypatch.setattr(parity_join, name, value)
    rng = random.Random(8)
    docs = [(k, template(rng, k, rng.choice([12, 15, 30]), shared=60)) for k in range(30)]
    for k in range(30, 60):
        words = rng.choice(docs)[1].split()
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    got, _ = written(spark, monkeypatch, docs)
    assert got == least_by_pairs(docs) and len(set(got.values())) < len(docs)


def shuffled(spark):
    """Bytes that all stages have written for exchanges."""
    status, jvm, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = status.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_near_misses_are_copied_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 8)
    rng, took = random.Random(2), {}
    for n in (150, 600):
        docs = spark.createDataFrame([(k, template(rng, k, 15)) for k in range(n)], "doc_id long, text string")
        before = shuffled(spark)
        real, parity_join._decided = parity_join._decided, lambda docs, near, *_: near.select("a", F.col("a").alias("b")).limit(0)  # blocks of sets have limits of their own
        try:
            assert parity_join.parity_join(docs).count() == n
        finally:
            parity_join._decided = real
        took[n] = sum(x for k, x in shuffled(spark).items() if k not in before)
    assert took[600] < 6 * took[150]
