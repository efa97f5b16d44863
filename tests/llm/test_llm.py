"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import types
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, components, exact_dedup, html_extract, language_model, oracle, packing, parity_join, quality_model, quality_rules, store, toxicity, url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
#: Columns whose names operators use inside.
SCHEMA = "doc_id long, text string, source string, id string, n long, sha string, row int, h string, words string, level int, root long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "y", 2, "z", "w", 3, 4) for i, t, s in rows], SCHEMA)


def prose(seed, n, words=60):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    out = [(1, base, "a"), (2, " ".join(near), "a"), (3, base, "b"), (4, base.upper(), None), (5, None, "a"), (6, "", "a"), (7, " \t\n", "a"), (8, "one two", "a"), (8, "one two", "a"), (9, "ONE  two", "a")]
    return out + [(10, prose(2, 30_000, 10_000), "a"), (11, prose(3, 40) + "\nshared line of a host\n" + prose(4, 40), "a"), (12, "shared line of a host\nshared line of a host", "a"), (None, prose(5, 30), "a"), (14, "Straße <|endoftext|> naïve 世界 ½ a's", "a")]


def test_exact_dedup(spark, rows):
    want = collections.Counter()
    flat = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in rows]
    for text in {t for _, t in flat}:
        ids = [i for i, t in flat if t == text]
        stays, done = min((i for i in ids if i is not None), default=None), False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            want[(i, stays, len(ids), i == stays and not done, hashlib.sha256(text.encode()).hexdigest())] += 1
            done |= i == stays
    for bits in (64, 3):
        got = exact_dedup.exact_dedup(frame(spark, rows), block_chars=16, hash_bits=bits)
        assert collections.Counter(map(tuple, got.collect())) == want
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("sql,run", [(oracle.EXACT_DEDUP, exact_dedup.exact_dedup), (oracle.QUALITY_RULES, quality_rules.quality_rules)])
def test_sql(spark, sql, run):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.sql(sql)
    got = run(spark.read.parquet(f"{SF}/documents.parquet")).select(*rel.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(parity_join.shingle_set.__globals__["LOWER"]))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(sets, num=3, den=4):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def test_parity_join(spark, rows):
    got = parity_join.parity_join(frame(spark, rows)).collect()
    want = brute_components({i: shingles(t) for i, t, _ in rows if i is not None})
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted((i, len(shingles(t)), want[i]) for i, t, _ in rows if i is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert parity_join.parity_join(frame(spark, [])).count() == 0


@pytest.mark.parametrize("group", [100_000, 5])
def test_parity_join_of_chains_and_passages(spark, monkeypatch, group):
    """Chains of copies of copies, and a passage that all texts share, with tiny limits for every step."""
    for name, value in (("GATHER", 400), ("BUCKET", 500), ("BLOCK", 4), ("FREQUENT", 6), ("GROUP", group)):
        monkeypatch.setattr(parity_join, name, value)
    rng, texts = random.Random(9), []
    passage = prose(100, 60).split()
    for k in range(8):
        words = prose(200 + k, 50).split() + passage
        for _ in range(6):
            texts.append(" ".join(words))
            for _ in range(2):
                words[rng.randrange(50)] = f"new{rng.random()}"
    docs = [(i, t, "a") for i, t in enumerate(texts)]
    want = brute_components({i: shingles(t) for i, t, _ in docs})
    got = {r.doc_id: r.component_id for r in parity_join.parity_join(frame(spark, docs)).collect()}
    assert got == want


def test_parity_join_at_the_limit(spark):
    """Texts that share six words, with one or two of their own: many pairs are similar at exactly 3/4 of other widths."""
    rng = random.Random(12)
    docs = [(i, " ".join(["p q r s t u", *[f"w{rng.randrange(4)}" for _ in range(rng.randrange(3))]]), "a") for i in range(200)]
    docs += [(500, prose(40, 30), "a"), (500, prose(41, 30), "a"), (501, prose(40, 30) + " more", "a"), (502, "x " + prose(41, 30), "a")]
    for width, num, den in ((1, 3, 4), (5, 3, 4), (2, 1, 2), (1, 9, 10)):
        kinds = {}
        for i, t, _ in docs:
            kinds.setdefault((i, frozenset(parity_join.shingle_set(t, width).tolist())), len(kinds))
        sets = {k: s for (_, s), k in kinds.items()}
        ids = {k: i for (i, _), k in kinds.items()}
        root = brute_components(sets, num, den)
        least = {r: min(ids[k] for k in root if root[k] == r) for r in root.values()}
        want = sorted((i, least[root[kinds[i, frozenset(parity_join.shingle_set(t, width).tolist())]]]) for i, t, _ in docs)
        got = parity_join.parity_join(frame(spark, docs), width=width, num=num, den=den).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == want


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(60):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: r for i, r in root.items() if i in got} and set(root) - set(got) <= {a for a, b in links if a == b}


def test_keys_hold_the_guarantee():
    """Any two sets within the limit have a key in common."""
    rng = random.Random(4)
    keys = parity_join.Keys(3, 4, np.zeros(parity_join.CELLS, bool))
    for _ in range(150):
        n = rng.choice([1, 2, 3, 4, 7, 12, 40, 150])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        while True:
            c = set(b)
            c.discard(rng.choice(sorted(c))) if rng.random() < 0.5 and len(c) > 1 else c.add(rng.getrandbits(64))
            if 4 * len(a & c) < 3 * len(a | c):
                break
            b = c
        x, y = (keys.of(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert np.intersect1d(x, y).size


def test_language_model(spark, rows):
    docs = rows + [(20 + k, prose(k % 3, 200, 5), "a") for k in range(40)]
    got = language_model.score_texts(frame(spark, docs)).collect()
    tokens = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").lower().encode() if (t or "").isascii() else (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))) + [b""]) for i, t, _ in docs]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((i or -1, held(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    repeated = [r for r in got if (r.doc_id or 0) >= 20 and r.held_out]
    assert repeated and all(r.score > r.base_score for r in repeated)
    assert language_model.score_texts(frame(spark, [])).count() == 0


def test_keys_hold_the_guarantee_with_frequent_shingles():
    """Also where few shingles are light, so that one set may stop at a stage that the other must emit."""
    rng = random.Random(8)
    for _ in range(3000):
        frequent = np.zeros(parity_join.CELLS, bool)
        a = [rng.getrandbits(64) for _ in range(rng.randrange(4, 40))]
        frequent[[x & (parity_join.CELLS - 1) for x in a if rng.random() < 0.7]] = True
        b = rng.sample(a, -(-3 * len(a) // 4))
        keys = parity_join.Keys(3, 4, frequent)
        x, y = (keys.of(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert np.intersect1d(x, y).size


def brute_scores(tokens, held):
    """Scores by the automaton of all words, and of all pairs and triples that occur twice."""
    training = [ws for (_, ws), h in zip(tokens, held, strict=True) if not h]
    counts = collections.Counter(w for ws in training for w in ws)
    words = [*counts]
    model, bit = language_model.Automaton(words, [counts[w] for w in words], sum(counts.values()), len(words)), language_model.SHIFT
    flat = [[model.start, *[model.ids[w] for w in ws]] for ws in training]
    pairs = collections.Counter(a << bit | b for ws in flat for a, b in itertools.pairwise(ws))
    triples = collections.Counter((a << bit | b) << bit | c for ws in flat for a, b, c in zip(ws, ws[1:], ws[2:], strict=False))
    pairs, triples = ({k: c for k, c in x.items() if c >= 2} for x in (pairs, triples))
    model.add_pairs(pairs)
    model.add_triples(triples, pairs)
    unknown = math.log10(1 / model.denominator)
    return [model.score([model.ids.get(w) for w in ws]) + unknown * sum(w not in model.ids for w in ws) for _, ws in tokens]


@pytest.mark.parametrize("limits", [(1 << 20, 2_000_000), (300, 50)])
def test_language_model_keeps_rare_pairs_in_much_text(spark, monkeypatch, limits):
    """What occurs twice counts, however much other text there is, and however blocks and buckets are cut."""
    monkeypatch.setattr(language_model, "BLOCK", limits[0])
    monkeypatch.setattr(language_model, "BUCKET", limits[1])
    much = limits[0] > 300
    docs = [(k, f"rare{k // 4}a rare{k // 4}b rare{k // 4}c and rare{k // 4}d", "a") for k in range(80)]
    docs += [(100 + k, prose(k, 100_000 if much else 100, 5), "a") for k in range(8)] + [(200, None, "a"), (201, "nowhere else", "a"), (None, "rare1a rare1b", "a")]
    tokens = [(i, [w.encode() for w in (t or "").split()] + [b""]) for i, t, _ in docs]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in tokens]
    want = dict(zip([i for i, _ in tokens], brute_scores(tokens, held), strict=True))
    got = {r.doc_id: r.score for r in language_model.score_texts(frame(spark, docs)).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_automaton_sums_to_one():
    model = language_model.Automaton([b"a", b"b", b"c", b""], [6, 4, 3, 2], 15, 4)
    bit = language_model.SHIFT
    model.add_pairs({0 << bit | 1: 3, 1 << bit | 2: 2})
    model.add_triples({(0 << bit | 1) << bit | 2: 2}, {0 << bit | 1: 3, 1 << bit | 2: 2})
    for state in range(len(model.fail)):
        unknown, s = 0.0, state
        while s:
            s, w = model.fail[s]
            unknown += w
        mass = sum(10 ** model.step(state, w)[1] for w in range(4)) + 10 ** (unknown + math.log10(1 / model.denominator))
        assert mass == pytest.approx(1)


def test_url_filter(spark):
    urls = [f"http://{h}.example.{t}/{l}/{k}" for h in ("a", "B.c") for t in ("com", "net", "org") for l in ("en", "de", "es") for k in (7, 80, 123)] + [None, "", "nothing", "https://HOST.net?x=/en/", "x://net/de/8", "http://é.com/en/"] * 2
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.url_filter(df).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fit = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, best and best[0] + best[1])
        assert got[k].verdict == best[2] if best else got[k].verdict in ("allow", "block")
    assert url_filter.url_filter(df.where("false")).count() == 0


def brute_url_scores(urls):
    """Log-ratios by the longest known context, with Witten-Bell smoothing, from (url, good) to score."""
    symbol = {c: k % 63 for k, c in enumerate(url_filter.ALPHABET, 1)}
    coded = lambda u: [63] * 5 + [symbol.get(c, 0) for c in u.translate({c: c + 32 for c in range(65, 91)})]
    counts = {good: collections.defaultdict(collections.Counter) for good in (True, False)}
    for u, good in urls:
        x = coded(u)
        for i in range(5, len(x)):
            for k in range(6):
                counts[good][tuple(x[i - k : i])][x[i]] += 1

    def p(good, context, c):
        lower = p(good, context[1:], c) if context else 1 / 64
        seen = counts[good].get(context)
        return (seen[c] + len(seen) * lower) / (sum(seen.values()) + len(seen)) if seen else lower

    def score(u):
        x = coded(u)
        return np.mean([math.log(p(True, tuple(x[i - 5 : i]), x[i]) / p(False, tuple(x[i - 5 : i]), x[i])) for i in range(5, len(x))])

    return score


@pytest.mark.parametrize("limit", [500_000, 0])
def test_url_scores(spark, monkeypatch, limit):
    """Scores and verdicts of the model against a plain one, with broadcasts and with joins by key."""
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", limit)
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    urls = [f"http://{word('abc')}.com/en/{word('defg')}" for _ in range(60)] + [f"http://{word('uvw')}.net/de/{word('xyz')}" for _ in range(60)]
    urls += [f"http://{word(k)}.info/{word(k)}" for k in ("abcdefg", "uvwxyz") * 20] + ["http://é.info/ÄÖ", "x"]
    taught = [(u, "net" in u) for u in urls if "info" not in u and u != "x"]
    fold = lambda u: zlib.crc32(u.encode()) % url_filter.FOLDS
    score = brute_url_scores([x for x in taught if fold(x[0])])
    got = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert {k: r.llr for k, r in got.items()} == pytest.approx({k: score(u) for k, u in enumerate(urls)}, rel=1e-6, abs=1e-9)
    held = [(score(u), good) for u, good in taught if not fold(u)]
    gain = lambda at: sum(s < at for s, g in held if not g) / sum(not g for _, g in held) - sum(s < at for s, g in held if g) / sum(g for _, g in held)
    free = [(got[k].llr, got[k].verdict) for k, u in enumerate(urls) if "info" in u]
    blocked = [s for s, v in free if v == "block"]
    assert len(blocked) > 10 and max(blocked) < min(s for s, v in free if v == "allow")
    assert gain(np.nextafter(max(blocked), 9)) >= max(gain(s) for s, _ in held) - 1e-9


def test_bpe(spark, rows):
    tok, enc = Tokenizer.from_file(PATH), bpe.Encoder(open(PATH, "rb").read())
    letters = "aabcdeeghilmnoprstu  ''..,!?012éßñ世İΣ\x1c\x85 ½🙂"
    rng = random.Random(5)
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) + "<|endoftext|>" * (k % 9 == 0) for k in range(3000)]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == ids and enc.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    lanes = bpe._lanes(open(PATH, "rb").read())
    texts += ["don't we'll 'tis ''s x's's 'rex 've'd 'SS o'", "a" * 500 + " b", "", None, "Ⱥȴ İı ŉ"]
    for a, b, at, ids in lanes.ids(bpe.pa.array(texts)):
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(b - a)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts[a:b]]
    want = sorted((i or -1, len(x := tok.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((r[0] or -1, *r[1:]) for r in bpe.bpe_round_trip(frame(spark, rows), PATH).collect()) == want
    back = bpe.bpe_decode(bpe.bpe_encode(frame(spark, rows), PATH), PATH)
    assert back.count() == len(rows)


def test_bpe_of_slices_and_very_long_words(monkeypatch):
    """Texts beyond the size of a slice, words beyond what lanes take, one word of 160,000 letters in linear time."""
    tok, lanes, rng = Tokenizer.from_file(PATH), bpe._lanes(open(PATH, "rb").read()), random.Random(7)
    texts = [prose(k, 40) + "".join(rng.choices("abcdefgh", k=rng.randrange(120))) for k in range(60)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for limit in (1, 700, 1 << 20):
        monkeypatch.setattr(bpe, "SLICE", limit)
        got = [ids[at[k - a] : at[k - a + 1]].tolist() for a, b, at, ids in lanes.ids(bpe.pa.array(texts)) for k in range(a, b)]
        assert got == want
    took = []
    for n in (20_000, 160_000):
        word, began = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)), time.process_time()
        ids = next(lanes.ids(bpe.pa.array([word])))[3]
        took.append(time.process_time() - began)
        assert ids.tolist() == tok.encode(word, add_special_tokens=False).ids
    assert took[1] < 24 * took[0]


def test_best_cuts():
    """The least cost of all ways to cut."""
    rng = random.Random(6)
    for _ in range(40):
        places = np.array([0, *sorted(rng.sample(range(1, 40), 9))])
        costs = np.array([0.0] + [rng.choice([0.0, 4.0, 64.0]) for _ in places[1:]])
        if np.diff(places).max() > 16:
            continue

        def cost(cuts, places=places, costs=costs):
            a, out = 0, 0.0
            for j in cuts:
                size = places[j] - places[a]
                if size > 16:
                    return math.inf
                out += (0 if size & (size - 1) == 0 else 16 - size) + costs[j] + packing.SEQUENCE
                a = j
            return out

        every = [(*c, len(places) - 1) for k in range(len(places) - 1) for c in itertools.combinations(range(1, len(places) - 1), k)]
        assert cost(packing.best_cuts(places, costs, 16)) == min(map(cost, every))


def test_packing(spark, rows, monkeypatch):
    tok = Tokenizer.from_file(PATH)
    got = packing.pack(frame(spark, rows), PATH).collect()
    left = collections.Counter()
    for i, t, _ in rows:
        left[(i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1)] += 1
    sums = collections.Counter()
    for r in got:
        sums[(r.doc_id, r.doc_tokens)] += r.length
        ids = np.array(tok.encode(next(t for i, t, _ in rows if i == r.doc_id) or "", add_special_tokens=False).ids + [1], "<u4")
        assert ids[r.start : r.start + r.length].tobytes() == bytes(r.ids) and len(r.ids) == 4 * r.length
    assert sums == {k: k[1] * c for k, c in left.items()}
    for _, g in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in g:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_toxicity(spark, rows):
    bad = "vileword nastyword foulword".split()
    docs, marks = [], []
    for k in range(240):
        words = prose(k, 40, 30).split()
        if k % 4 == 0:
            words[k % 40] = bad[k % 3]
        docs.append((k, " ".join(words), "a"))
        marks.append((k, 1, int(k % 4 == 0), "lang"))
    labels = spark.createDataFrame(marks + [(1, 1, None, "x"), (None, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity(frame(spark, docs + [(1000 + k, t, s) for k, (_, t, s) in enumerate(rows)]), labels).collect()
    assert len(got) == len(docs) + len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.9
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0
    assert toxicity.toxicity(frame(spark, docs[:3]), labels.where("false")).count() == 3


def test_gradients_of_the_toxicity_model():
    """A step moves every parameter against its gradient, as finite differences give it."""
    rng, mask = np.random.default_rng(3), (1 << toxicity.BITS) - 1
    texts = [rng.integers(0, 30, (n, 3)) + np.array([0, mask + 1, 2 * (mask + 1)]) for n in (1, 2, 5, 9, 12)]
    y, weight = np.array([1, 0, 1, 0, 1], np.float32), np.array([1, 2, 1, 0.5, 1], np.float32)

    def fresh():
        r = np.random.default_rng(5)
        m = toxicity._initial(texts, y, r)
        m.table[:] = r.normal(0, 0.5, m.table.shape)
        m.table[toxicity.PAD] = 0
        m.filters = [r.normal(0, 0.5, f.shape) for f in m.filters]
        m.out, m.bias = r.normal(0, 0.5, m.out.shape), -0.1
        m.table = m.table.astype(np.float64)
        return m

    def loss(m):
        z = m.features(*toxicity._joined(texts)) @ m.out + m.bias
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() / len(y))

    m, big = fresh(), 1e12  # squares so large that a step of the rate's size is the gradient itself
    square = {"out": np.full_like(m.out, big), "bias": big, "table": np.full(toxicity.PAD + 1, big), "filters": [np.full_like(f, big) for f in m.filters]}
    toxicity._step(m, texts, y, weight, square, rate=big**0.5)
    base = fresh()
    moved = {"out": (base.out - m.out, lambda x: x.out), "table": (base.table - m.table, lambda x: x.table)}
    moved |= {k: (base.filters[k] - m.filters[k], lambda x, k=k: x.filters[k]) for k in range(len(m.filters))}
    used = sorted({int(r) for t in texts for r in t.ravel()})
    for name, (grad, part) in moved.items():
        places = [(r, d) for r in used[::7] for d in (0, 3)] if name == "table" else [tuple(i) for i in np.ndindex(grad.shape)][::5]
        for at in places:
            up, down = fresh(), fresh()
            part(up)[at] += 1e-4
            part(down)[at] -= 1e-4
            assert grad[at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-4), (name, at)


def test_toxicity_learns_from_a_bounded_sample_and_one_label(spark):
    docs = [(k, ("vileword " if k % 2 else "") + prose(k, 20), "a") for k in range(60)] + [(99, prose(99, 5000), "a")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(99, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(frame(spark, docs), labels, max_chars=20_000).collect()}
    assert len(got) == 61 and np.mean([(got[k] >= 0.7) == (k % 2 == 1) for k in range(60)]) > 0.9
    for only, side in ((1, lambda s: s > 0.9), (0, lambda s: s < 0.1)):
        one = toxicity.toxicity(frame(spark, docs), labels.where(f"toxic = {only}")).collect()
        assert all(side(r.score) for r in one)


def test_votes_find_the_accuracies_of_labellers():
    """EM against the rates that drew the votes, and its likelihood, smoothing counts included, never falls."""
    rng, k = np.random.default_rng(9), len(quality_model.LABELLERS)
    rate = np.stack([np.tile([0.6, 0.1, 0.3], (k, 1)), np.tile([0.05, 0.5, 0.45], (k, 1))], axis=1)
    good = rng.random(20_000) < 0.7
    d = np.stack([[rng.choice(3, p=rate[j, int(g)]) for j in range(k)] for g in good[:4000]])
    code = (d * quality_model.KINDS ** np.arange(k)[::-1]).sum(axis=1)
    codes, which, counts = np.unique(code, return_inverse=True, return_counts=True)
    p_good, p, prior = quality_model.fit_votes(codes, counts)
    assert np.abs(p[:, :, :3] - rate).max() < 0.06 and abs(prior - 0.7) < 0.03
    assert ((p_good[which] > 0.5) == good[:4000]).mean() > 0.98

    def likelihood(p, prior):
        digits = quality_model._digits(codes)
        each = [np.log(w) + np.log(p[np.arange(k), kind, digits]).sum(axis=1) for kind, w in ((0, 1 - prior), (1, prior))]
        return float((counts * np.logaddexp(*each)).sum() + 0.5 * np.log(p[:, :, :3]).sum())

    steps = [likelihood(*quality_model.fit_votes(codes, counts, rounds=n)[1:]) for n in (1, 2, 3, 5, 9, 30)]
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(steps))


def test_quality_scorer_follows_its_labels(spark):
    rows = [(np.array([k % 7, 7 + k % 3]), np.array([0.6, 0.8], np.float32)) for k in range(300)]
    y = np.array([0.95 if k % 7 < 4 else 0.05 for k in range(300)])
    w, bias = quality_model.fit_scorer(rows, y, np.ones(300))
    z = np.array([w[at] @ v + bias for at, v in rows])
    assert ((z > 0) == (y > 0.5)).all()
    same = [(k, re.sub(r"\d+", "", prose(k, 90)).replace("zeta ", "zeta. ").capitalize(), "a") for k in range(30)]
    assert all(r.kept and r.vote_score >= 0.5 for r in quality_model.quality_model(frame(spark, same), max_features=500).collect())


def test_quality_model(spark, rows):
    junk = [" ".join(["again"] * 80), " ".join(w.upper() + "!!" for w in prose(1, 80).split()), " ".join(w + "###" for w in prose(2, 80).split()), prose(3, 80).replace(" ", " | ")]
    good = [re.sub(r"\d+", "", prose(k, 90)).replace("zeta ", "zeta. ").capitalize() for k in range(80)]
    docs = [(k, t, "a") for k, t in enumerate(good + junk * 5)]
    got = {r.doc_id: r.kept for r in quality_model.quality_model(frame(spark, docs)).collect()}
    assert np.mean([got[k] == (k < len(good)) for k in got]) > 0.95
    assert quality_model.quality_model(frame(spark, rows)).count() == len(rows)
    assert quality_model.quality_model(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hosts", [20_000, 0])
def test_quality_rules(spark, rows, monkeypatch, hosts):
    """Lines on many texts of a host go; a text of little else is rejected; copies count once; other hosts are apart."""
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", hosts)
    line, rare = "Read  more of this SITE every single day of the week here", "a line that two texts have and no more of them"
    docs = [(100 + k, f"{line}\n{prose(k, 40)}\n\n{rare * (k < 2)}", "host") for k in range(12)]
    docs += [(200, f"{line.lower()}\nplain words {prose(50, 8)}", "host")]
    docs += [(300 + k, f"copied line\n{prose(60, 40)}", "host") for k in range(8)] + [(400 + k, f"{line}\n{prose(70 + k, 40)}", None if k else "other") for k in range(2)]
    df = frame(spark, rows + docs)
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert quality_rules.quality_rules(df).count() == len(rows) + len(docs)
    assert all(got[100 + k].removed_words == 12 and got[100 + k].kept for k in range(12))
    assert got[200].removed_words == 12 and not got[200].base_failed and not got[200].kept
    assert all(got[k].removed_words == 0 and got[k].kept for k in (*range(300, 308), 400, 401))
    assert got[12].n_dup_lines == 1 and got[12].base_failed and not got[5].kept and got[10].n_words == 30_000
    texts = {r.doc_id: r.text for r in quality_rules.without_common_lines(df).collect()}
    assert texts[100] == f"{prose(0, 40)}\n\n{rare}" and texts[200] == f"plain words {prose(50, 8)}" and texts[5] is None and texts[300] == docs[13][1]
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0 and quality_rules.without_common_lines(frame(spark, [])).count() == 0


def test_quality_rules_remove_lines_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.quality_rules(docs).where("removed_words > 0").collect()
    assert len(got) > 20
    gone = [r for r in got if not r.base_failed and not r.kept]
    assert len(gone) >= 5 and all(r.n_words - r.removed_words < 20 for r in gone)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='cookie-notice'>x</div><article><h1>A &amp; B</h1><p><b>bold<br>line<p>two &lt;3<script>no()</script></p><div class=comments><p>reader</p></div></article><footer>f</footer>"
    rows = [(1, "http://h/a", page), (2, "http://h/b", None), (3, None, ""), (3, None, ""), (4, "http://h/c", "<p>plain"), (5, "http://h/d", "<p>" + "word " * 100_000)]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    assert got[1] == "A & B\n\nbold line\n\ntwo <3" and got[2] == "" and got[3] == "" and got[4] == "plain" and len(got[5]) == 499_999
    assert html_extract.extract_text(df).count() == len(rows) and html_extract.extract_text(df.where("false")).count() == 0


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("limit", [200_000, 0])
def test_style_tree_removes_what_pages_share(spark, monkeypatch, limit):
    """Unmarked boilerplate of a host with seven pages, and of forty hosts with two; copies of a page are one page."""
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", limit)
    body = lambda k, more="": f"<body><div class=x>the same on all pages</div>{more}<div class=y><p>{prose(k, 20)}</p></div></body>"
    pages = [(k, f"http://h/{k}", body(k)) for k in range(7)]
    pages += [(100 + k, f"http://h{k // 2}/{k}", body(k, f"<div class=z>{prose(k, 5)}</div>")) for k in range(80)]
    pages += [(300 + k, "http://copies/a", f"<body><section class=one><p>{prose(1, 20)}</p></section></body>") for k in range(12)]
    pages += [(400 + k, f"http://inside/{k}", f"<article><p>{prose(k, 20)}</p><p class=plea>Subscribe to us today</p></article>") for k in range(9)]
    pages += [(500 + k, f"http://few/{k}", f"<body><section><div>stays, for want of pages</div><p>{prose(k, 9)}</p></section></body>") for k in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(pages, PAGES)).collect()}
    for k in range(7):
        assert got[k] == prose(k, 20)
    for k in range(80):
        assert got[100 + k] == f"{prose(k, 5)}\n\n{prose(k, 20)}"
    assert all(got[300 + k] == prose(1, 20) for k in range(12)) and all(got[400 + k] == prose(k, 20) for k in range(9))
    assert all(got[500 + k] == f"stays, for want of pages\n\n{prose(k, 9)}" for k in range(3))


def test_style_tree_against_brute_force(spark, monkeypatch):
    for name, value in (("PAGES", 2), ("PAGES_OF_ALL", 3), ("HOSTS", 2)):
        monkeypatch.setattr(html_extract, name, value)
    rng, rows = random.Random(4), []
    for k in range(60):
        parts = [f"<div class={c}><p>{c if rng.random() < 0.6 else prose(k, 3)}</p>{'<p>more</p>' * rng.randrange(2)}</div>" for c in rng.sample("abcde", 4)]
        rows.append((f"h{k % 4}", f"<body>{''.join(parts)}</body>"))
    own, every = html_extract.style_tree(spark.createDataFrame(rows + rows[:5], "host string, html string"))
    seen = collections.defaultdict(list)
    for host, source in rows:
        for path, (content, style) in html_extract.Page(source).nodes().items():
            for where in (host, None):
                seen[where, html_extract._path(path)].append((content, style))
    want = {}
    for at, pairs in seen.items():
        m, left = len(pairs), 1.0
        for side in zip(*pairs, strict=True):
            counts = collections.Counter(side)
            entropy = -sum(c / m * math.log(c / m) for c in counts.values())
            left *= 1 - (entropy / math.log(m) if m > 1 else 1.0)
        if m >= (2 if at[0] else 3):
            want[at] = (m, pytest.approx(1 - left, abs=1e-9))
    got = {(r.host, r.path): (r.m, r.importance) for r in own.collect()} | {(None, r.path): (r.m, r.importance) for r in every.collect()}
    assert got == want


@pytest.mark.parametrize(
    "source,text",
    [
        ("<div class='share-price'><p>Up by two.</p></div>", "Up by two."),
        ("<section id='search-results'><p>Found.</p></section>", "Found."),
        ("<article><p>One.</p><div class='related-work'><p>Two.</p></div></article>", "One.\n\nTwo."),
        ('<p><img alt="5" tall"> hello</p>', "hello"),
        ("<p title='a > b'>it's <a href=x/y>5 < 6 &lt;b&gt;</a></p>", "it's 5 < 6 <b>"),
        ("<body><header>top</header><div class=page-footer>x</div><div class='ad-slot'>y</div><p>text <span class=advert>buy</span> on</p></body>", "text on"),
        ("<main><p>a</p><div class='comments-list'><p>reader</p></div><form>f</form><aside>s</aside></main><footer>f</footer>", "a"),
    ],
)
def test_one_page(spark, source, text):
    assert html_extract.Page(source).main(lambda path: 1.0) == text


def test_a_cluster_must_name_a_shared_folder():
    session = lambda master, named: types.SimpleNamespace(sparkContext=types.SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named} if named else {}))
    assert store.folder(session("spark://h:7077", "hdfs://x/y")) == "hdfs://x/y" and store.folder(session("local[4]", None)) == store.FALLBACK
    with pytest.raises(RuntimeError):
        store.folder(session("yarn", None))


def edge_rows(spark, rows):
    schema = "doc_id long, text string, source string, lang string, n_chars long, id string, words string, score double, root long, kept string"
    every = [(i, t, s, "en", k, "x", "w", 0.5, 3, "k") for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(every, schema)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_any_rows(spark, rows, stage):
    """Null and repeated ids, null, empty and long texts, columns that clash; and an empty table."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    docs = edge_rows(spark, [*rows, (8, prose(90, 40), "a"), (8, prose(91, 40), "a"), (None, None, "b"), (13, prose(91, 40) + " more", "a")])
    got = run(spark, docs, SF)
    assert run(spark, docs.where("false"), SF).count() == 0
    if stage == 4:
        assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
        return
    assert got.columns == docs.columns
    kept, before = collections.Counter(map(tuple, got.collect())), collections.Counter(map(tuple, docs.collect()))
    assert not kept - before
    pairs = {(r[0], r[1]) for r in kept}
    if stage == 2:
        flat = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in kept.elements()]
        assert len(flat) == len(set(flat)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in before})
        assert kept[(8, "one two", "a", "en", 7, "x", "w", 0.5, 3, "k")] == 1
    if stage == 3:  # the first near copy of each goes; of a repeated id only the text that has a copy before it
        assert (1, rows[0][1]) in pairs and (2, rows[1][1]) not in pairs and (3, rows[0][1]) not in pairs
        assert (8, prose(90, 40)) in pairs and (8, prose(91, 40)) in pairs and not any(i == 13 for i, _ in pairs)
        assert (None, prose(5, 30)) in pairs and (5, None) in pairs and (6, "") in pairs


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        kept = {r.doc_id: r.text for r in after.collect()}
        assert kept.items() <= before.items()
        if k == 2:
            firsts = {}
            for i in sorted(before):
                firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
            assert set(kept) == set(firsts.values())
        if k == 3:
            want = brute_components({i: shingles(t) for i, t in before.items()})
            assert set(kept) == {i for i, r in want.items() if i == r}
        docs, before = spark.createDataFrame(after.collect(), after.schema), kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(before)
