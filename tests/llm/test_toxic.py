"""Scores of the toxicity model by plain loops, and how many toxic texts it finds among those it hasn't seen."""

import math
import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import queries, toxicity


def by_hand(model, text):
    """The score of a text, word by word and filter by filter."""
    words = (text or "").encode().translate(toxicity.TABLE).split()
    size, mask = 1 << toxicity.BITS, (1 << toxicity.BITS) - 1
    vectors = []
    for w in words:
        h, start = xxhash.xxh3_64_intdigest(w), xxhash.xxh3_64_intdigest(w[: toxicity.PREFIX])
        vectors.append([float(sum(float(model.table[r][d]) for r in (h & mask, size + (h >> 32 & mask), 2 * size + (start & mask)))) for d in range(toxicity.DIMS)])
    vectors += [[0.0] * toxicity.DIMS] * max(toxicity.WIDTHS)
    z = float(model.bias)
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max(sum(vectors[i + j][d] * float(model.filters[k][j][d][f]) for j in range(width) for d in range(toxicity.DIMS)) for i in range(max(1, len(words))))
            z += max(best, 0.0) * float(model.out[k * toxicity.FILTERS + f])
    votes = {lang: sum(w.decode() in toxicity.FUNCTION_WORDS[lang].split() for w in words) for lang in sorted(toxicity.FUNCTION_WORDS)}
    of = max(votes, key=votes.get) if any(votes.values()) else None
    z -= float(model.shift[list(votes).index(of) if of else len(votes)])
    return 1 / (1 + math.exp(-(z * model.scale + math.log(toxicity.CUT / (1 - toxicity.CUT)))))


def test_scores_by_hand():
    rng = random.Random(3)
    draw = lambda bad: " ".join(rng.choices("the of and der die le la el los sun moon tree river stone".split(), k=rng.randrange(3, 30)) + ["Vile!", "NASTY"] * bad)
    labels = [k % 2 for k in range(80)]
    model = toxicity.train([toxicity.hashes(draw(y)) for y in labels], labels)
    texts = [draw(k % 2) for k in range(12)] + ["", None, "vile", "one-word", "nasty the vile"]
    got = model.scores([toxicity.hashes(t) for t in texts])
    assert got == pytest.approx([by_hand(model, t) for t in texts], abs=1e-4)
    assert (got[1:12:2] >= toxicity.CUT).all() and (got[0:12:2] < toxicity.CUT).all()


def test_cut_counts_both_kinds_of_errors_alike():
    z, y = np.array([0.0, 1.0, 2.0, 3.0, 4.0]), np.array([0, 1, 0, 1, 1])
    assert toxicity._best_cut(z, y) in (0.5, 2.5)
    assert toxicity._best_cut(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1])) == 3.0


def test_held_out_toxic_texts_are_found(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted) for r in queries.op6_toxicity(spark, sf).where("held_out").collect() if labels.get(r.doc_id) in (0, 1)]
    toxic, clean = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.015 * len(clean)
