"""Near-dedup of the pipeline against brute-force Jaccard components."""

import math

import numpy as np
import pytest

import corpus_pipeline
from textloom.llm import jaccard


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_kept(rows):
    """The smallest id of each component of links at a Jaccard similarity of 0.8 or more, and all similarities."""
    rows = sorted(rows)
    sets = [shingle_set(t) for _, t in rows]
    label, seen = list(range(len(rows))), {}
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            both = len(a & b)
            union = len(a) + len(b) - both
            if both:
                seen[rows[i][0], rows[j][0]] = both / union
            if 5 * both >= 4 * union:
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return {rows[v][0] for v in label}, seen


def near(spark, sf, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(path), sf).collect())


def test_planted_pairs(spark, sf, tmp_path):
    rng = np.random.default_rng(11)
    common = " ".join(f"same{i}" for i in range(40))
    rows = []
    for n, goal in enumerate(np.linspace(0.6, 0.95, 120)):
        size = int(rng.integers(60, 400))
        w = [f"w{x}" for x in rng.integers(0, 5000, size)]
        rows.append((10 * n, f"{' '.join(w)} {common}" if n % 4 == 0 else " ".join(w)))
        # A changed word takes five shingles from either text.
        at = rng.choice(np.arange(2, size - 2), max(1, math.floor(size * (1 - goal) / (1 + goal) / 5)), replace=False)
        for i in at:
            w[i] = f"new{n}x{i}"
        rows.append((10 * n + 1, f"{' '.join(w)} {common}" if n % 4 == 0 else " ".join(w)))
    want, seen = brute_kept(rows)
    planted = [seen[10 * n, 10 * n + 1] for n in range(120)]
    assert sum(0.7 <= x < 0.8 for x in planted) > 20 and sum(0.8 <= x < 0.9 for x in planted) > 20
    assert near(spark, sf, rows, str(tmp_path / "d")) == sorted(want)


@pytest.mark.parametrize("small", [False, True])
def test_chain_and_large_group(spark, sf, tmp_path, small, monkeypatch):
    if small:  # shuffled joins, one of several copies, rounds of one neighbour
        monkeypatch.setattr(jaccard, "BROADCAST_NODES", 0)
        monkeypatch.setattr(jaccard, "COPIES", 1)
        monkeypatch.setattr(jaccard, "ROUNDS", ((1, 1), (2, 2), (3, None)))
    rng = np.random.default_rng(12)
    base = [f"b{x}" for x in range(200)]
    rows = []
    for i in range(60):  # near copies of one text, each with words of its own
        w = list(base)
        for j in rng.choice(200, 2 + i % 3, replace=False):
            w[j] = f"own{i}x{j}"
        rows.append((i, " ".join(w)))
    chain = [f"c{x}" for x in range(300)]
    for i in range(12):  # each like its neighbours only
        rows.append((100 + i, " ".join(chain[10 * i : 10 * i + 100])))
    rows += [(200, ""), (201, None), (202, "One two"), (203, "one TWO"), (204, "one two three"), (205, "a b c d e f " * 20), (206, "a b c d e f " * 30)]
    rows += [(300 + i, rows[5][1]) for i in range(4)] + [(310 + i, rows[5][1] + " end") for i in range(3)]
    want, _ = brute_kept(rows)
    assert near(spark, sf, rows, str(tmp_path / "d")) == sorted(want)


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_real_texts(spark, at):
    docs = spark.read.parquet(f"/root/testdata/{at}/documents.parquet")
    want, _ = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, at).collect()) == sorted(want)
