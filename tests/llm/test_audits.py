"""Audits of sources and filters, and best-fit packing, against brute force."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import best_fit, filter_audit, oracle, packing, queries, source_divergence

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, source string, lang string, id string, n long, part string, mask int, h string, t string, key string, term string"


def frame(spark, rows):
    """Documents with columns that operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", "w", "k", "v") for r in rows], SCHEMA)


def prose(seed, n, words=60):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, long = prose(1, 120), prose(2, 20_000, 10_000)
    out = [(1, base, "a", "en"), (2, base, "a", "en"), (3, base, "b", "en"), (4, base.upper(), None, "en"), (5, None, "a", None), (6, "", "", "en"), (7, " \t\n", "a", "en"), (8, "one two", "a", "en"), (8, "one two", "a", "en")]
    out += [(9, "two one", "b", "en"), (10, long, "a", "de"), (11, long, "b", "de"), (12, long[:-1] + "!", "b", "de"), (13, long[:70] + "?" + long[71:], "b", "de"), (None, base, "a", "en"), (14, "5 $ & more " * 30, "a", "en")]
    return out + [(20 + k, prose(k % 4 + 5, 55), "abc"[k % 3], "en") for k in range(12)]


LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (8, 1, None), (8, 0, 1), (20, 1, 0), (24, 1, 0), (99, 1, 1), (None, 1, 1)]


def audited(rows):
    """Every order walked document by document."""
    docs = []
    for i, t, p, _ in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows)
        of = [x for x in LABELS if x[0] == i and i is not None]
        docs.append((p or "", {f for f, x in fails.items() if x}, any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)))
    out, total = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for k, f in enumerate(order):
                now = [d for d in left if f in d[1]]
                total[part, f] += len(now)
                redundant = sum(f in d[1] for d in gone)
                left, gone = [d for d in left if f not in d[1]], gone + now
                alone = sum(d[1] == {f} for d in docs if d[0] == part)
                out[part, "".join(order), k + 1] = [len(left), len(now), redundant, alone, sum(d[2] for d in now), sum(d[3] for d in now)]
    return {(p, o, k, *v, total[p, o[k - 1]]) for (p, o, k), v in out.items()}


@pytest.mark.parametrize("bits,most", [(64, 200_000), (2, 0)])
def test_filter_audit(spark, rows, monkeypatch, bits, most):
    monkeypatch.setattr(filter_audit, "BROADCAST_CLASSES", most)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(frame(spark, rows), labels, hash_bits=bits)
    assert {tuple(r) for r in got.collect()} == audited(rows)


def test_filter_audit_of_no_rows_and_of_single_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(frame(spark, []), labels).count() == 0
    got = filter_audit.filter_audit(frame(spark, [(1, "a b", None, "en"), (2, "a b c", None, "en")]), labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got] == [(0, 2, 0, 2, 240)] + [(0, 0, 0, 0, 0)] * 4


def test_filter_audit_sql(spark, rows):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).toPandas())
    con.register("labels", labels.toPandas())
    want = con.sql(oracle.FILTER_AUDIT)
    got = filter_audit.filter_audit(frame(spark, rows), labels).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def diverged(rows, min_docs=3, k=200):
    """Every term of every pair of sources, in whole numbers of any size."""
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for _, t, so, la in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(w for d in mine for w in set(d[2]))
        kept = sorted(w for w, n in seen.items() if n >= min_docs)
        v = len(kept)

        def chances(texts):
            c = collections.Counter(w for t in texts for w in t if w in kept)  # noqa: B023
            return c, {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + v) for w in kept}  # noqa: B023

        _, q = chances([d[2] for d in mine])
        p = {s: chances([d[2] for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (c, own) in p.items():
            f = lambda x, y: (x - y) ** 2 // y
            pairs = [(sum(f(own[w], other[w]) for w in kept), t) for t, (_, other) in p.items() if t != s]
            terms = [(f(own[w], q[w]), w) for w in kept if c[w] and own[w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, w, value, r + 1) for r, (value, w) in enumerate(items) if part == "pair" or r < k}
    return out


@pytest.mark.parametrize("k,held,pairs", [(200, 300_000, 1 << 21), (3, 5, 4), (1, 300_000, 1)])
def test_source_divergence(spark, rows, monkeypatch, k, held, pairs):
    for name, value in (("HELD", held), ("PAIRS", pairs), ("SLICE", 50 if k == 3 else 1 << 20), ("TIMES", 2)):
        monkeypatch.setattr(source_divergence, name, value)
    more = [(50, "Été ÉTÉ été x-ray naïve", "c", "fr"), (51, "été naïve", "c", "fr"), (52, "x ray naïve été", "d", "fr"), (53, "", "e", "fr"), (54, "solo", "f", "xx"), (55, None, "g", "xx")]
    got = source_divergence.source_divergence(frame(spark, rows + more), k=k)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and [t for _, t in got.dtypes] == ["string"] * 4 + ["bigint", "int"]
    got = list(map(tuple, got.collect()))
    assert len(got) == len(set(got)) and set(got) == diverged(rows + more, k=k)


def test_source_divergence_of_no_rows(spark):
    assert source_divergence.source_divergence(frame(spark, [])).count() == 0


def test_probability_is_exact_beyond_64_bits(spark):
    n, total, terms = 98_765_432_109, 987_654_321_098_765, 12_345
    df = spark.createDataFrame([(n, total, terms), (5, 7, 3), (0, 0, 0)], "n long, t long, v long")
    got = [r[0] for r in df.select(source_divergence.probability("n", "t", "v")).collect()]
    assert got == [1 + 10**9 * (n + 1) // (total + terms), 1 + 10**9 * 6 // 10, None]


def packed(spark, docs, length):
    tok = Tokenizer.from_file(PATH)
    got = best_fit.best_fit(frame(spark, docs), PATH, length=length).collect()
    want = collections.Counter()
    for i, t, *_ in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.update((i, k, a, len(ids[a : a + length]), np.array(ids[a : a + length], "<u4").tobytes()) for k, a in enumerate(range(0, len(ids), length)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences), [r.length for r in got]


@pytest.mark.parametrize("length,cells", [(2048, 100_000), (64, 0), (100, 100_000)])
def test_best_fit(spark, rows, monkeypatch, length, cells):
    monkeypatch.setattr(best_fit, "BROADCAST_CELLS", cells)
    docs = rows + [(100 + k, prose(k, 1 + k * 7 % 40), "a", "en") for k in range(300)]
    n, lengths = packed(spark, docs, length)
    free: list[int] = []
    for x in sorted(lengths, reverse=True):  # one by one, into the fullest sequence that has room
        k = min((k for k, f in enumerate(free) if f >= x), key=lambda k: free[k], default=None)
        if k is None:
            free.append(length)
            k = -1
        free[k] -= x
    assert n <= len(free) + 1


def test_best_fit_of_no_rows(spark):
    assert best_fit.best_fit(frame(spark, []), PATH).count() == 0


def test_plans_hold_each_piece_once_and_waste_little():
    rng = np.random.default_rng(1)
    for draw in (lambda n: rng.integers(1, 2049, n), lambda n: rng.integers(600, 700, n), lambda n: np.full(n, 1025), lambda n: np.minimum(2048, 1 + rng.exponential(500, n).astype(int))):
        n = draw(5000)
        histogram = dict(zip(*(x.tolist() for x in np.unique(n, return_counts=True)), strict=True))
        for times in (1, 1_000_000):
            h = {x: c * times for x, c in histogram.items()}
            plan = best_fit.best_plan(h, 2048)
            held = collections.defaultdict(list)
            for r in plan.runs:
                held[r.length].append((r.number, r.count))
            for x, c in h.items():
                at = 0
                for number, count in sorted(held[x]):
                    assert number == at
                    at += count
                assert at == c
            least = max(-(-sum(x * c for x, c in h.items()) // 2048), sum(c for x, c in h.items() if x > 1024), -(-sum(c for x, c in h.items() if x > 682) // 2))
            assert plan.sequences <= 1.002 * least + 1 and len(plan.runs) < 50_000


def test_configurations_meet_the_demand_at_the_least_cost():
    basis, x = best_fit.configurations([7, 5, 3], [10, 20, 30], 15)
    assert np.allclose(basis @ x, [10, 20, 30]) and (basis.T @ [7, 5, 3] <= 15).all()
    assert abs(x.sum() - (10 * 7 + 20 * 5 + 30 * 3) / 15) < 1e-6


def test_source_divergence_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(oracle.SOURCE_DIVERGENCE)
    got = queries.op11_source_divergence(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_packing_query_has_checksums_of_its_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {(r.doc_id, r.piece): zlib.crc32(bytes(r.ids)) for r in best_fit.best_fit(docs, PATH).collect()}
    got = queries.op12_best_fit_packing(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got.collect()} == ids


def test_packing_in_small_slices_gives_the_same_pieces(spark):
    texts = [f"Words of text {k}, it's number {k * k}. " * (1 + k % 7) for k in range(40)] + ["", None, "x" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    whole, small = (sorted(map(repr, packing.pack(docs, queries.VOCABULARY, **how).collect())) for how in ({}, {"at_once": 300}))
    assert whole == small
