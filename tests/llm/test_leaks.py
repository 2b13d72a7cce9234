"""Passages of the benchmark in texts: verbatim, changed, and against a plain search over all pairs."""

from collections import Counter

import numpy as np
import pytest

from textloom.llm import leaks


def block_of(items, n_docs, df):
    """A block with its latent space by plain SVD."""
    block = leaks.Block(items, n_docs, df)
    matrix = np.zeros((len(items), len(block.vocabulary)))
    for i, (k, x) in enumerate(map(block.row, block.words)):
        matrix[i, k] = x
    block.place(np.linalg.svd(matrix, full_matrices=False)[2][: block.rank()].T)
    return block


def read(at):
    import pyarrow.parquet as pq

    passages = [(r["item_id"], r["text"]) for r in pq.read_table(f"/root/testdata/{at}/benchmark.parquet").to_pylist()]
    return passages, pq.read_table(f"/root/testdata/{at}/documents.parquet").column("text").to_pylist()


def counted(passages, texts, n_docs):
    vocabulary = set().union(*(leaks.words_of(t) for _, t in passages))
    held = Counter(w for t in texts for w in vocabulary.intersection(leaks.words_of(t)))
    return block_of(passages, n_docs, {w: n * n_docs // len(texts) for w, n in held.items()})


@pytest.mark.parametrize("n_docs", [10_000, 100_000_000])
def test_verbatim_passage_among_foreign_words(n_docs):
    passages, texts = read("sf0.01")
    block = counted(passages, texts, n_docs)
    rng = np.random.default_rng(13)
    for p, (_, t) in enumerate(passages):
        for _ in range(4):
            around = [b"foreign%d" % x for x in rng.integers(0, 10**9, 300)]
            k = int(rng.integers(0, 300))
            found = {m[1] for m in leaks._matches(block, [around[:k] + leaks.words_of(t) + around[k:]])}
            assert p in found


@pytest.mark.parametrize("how", ["dropped", "replaced"])
@pytest.mark.parametrize("alone", [True, False])
def test_recall_of_changed_passages(how, alone):
    """A quarter of a passage's words is dropped or replaced."""
    passages, texts = read("sf0.1")
    texts = texts[:3000]
    block = counted(passages, texts, len(texts))
    bodies = [w for w in map(leaks.words_of, texts) if 150 < len(w) < 600]
    rng = np.random.default_rng(14)
    hits = []
    for p, words in enumerate(block.words):
        keep = rng.random(len(words)) > 0.25
        other, around = (bodies[rng.integers(len(bodies))] for _ in range(2))
        changed = [w if k else other[rng.integers(len(other))] for w, k in zip(words, keep, strict=True) if k or how == "replaced"]
        k = int(rng.integers(len(around)))
        hits.append(p in {m[1] for m in leaks._matches(block, [changed if alone else around[:k] + changed + around[k:]])})
    assert np.mean(hits) >= 0.95


def test_result_depends_on_the_text_alone(spark, sf):
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rng = np.random.default_rng(17)
    items = [r.text.split() for r in benchmark.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i, w in enumerate(items * 10):  # short texts with part of a passage
        rows.append((10_000 + i, " ".join(x for x in w if rng.random() > 0.3)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(tuple, leaks.find(df.repartition(n), benchmark).collect())) for n in (1, 50))
    assert one == many and len(one) > len(items)
    alone = block_of([(r.item_id, r.text) for r in benchmark.orderBy("item_id").collect()], 1, {})
    texts = [leaks.words_of(t) for _, t in rows]
    together = Counter((t, p, lcs) for t, p, _, lcs, _ in leaks._matches(alone, texts))
    assert together == Counter((i, p, lcs) for i, t in enumerate(texts) for _, p, _, lcs, _ in leaks._matches(alone, [t]))


def test_against_all_pairs():
    """Every text against every passage by plain common subsequences of all stretches."""
    passages, texts = read("sf0.001")
    rng = np.random.default_rng(18)
    texts = [t for t in texts if t][:60]
    for n, (_, t) in enumerate(passages * 3):
        w = [x for x in t.split() if rng.random() > 0.1 * (n % 6)]
        f = texts[n % 60].split()[:400]
        texts.append(" ".join(f[:100] + w + f[100:]))
    block = counted(passages, texts, len(texts))
    got = {(t, p) for t, p, *_ in leaks._matches(block, [leaks.words_of(t) for t in texts])}
    sure, possible = set(), set()
    for i, t in enumerate(texts):
        words = leaks.words_of(t)
        for p, own in enumerate(block.words):
            answer = leaks.answer_of(passages[p][1])
            for stretch, into in ((len(own), sure), (2 * len(own) + 24, possible)):
                for at in range(0, max(1, len(words) - stretch + 1)):
                    part = words[at : at + stretch]
                    share = 0.7 if into is sure else None
                    need = share * len(own) if share else leaks.least_common(len(own))
                    if leaks.common(own, part) >= need and leaks.common(answer, part) >= leaks.least_answer(len(answer)):
                        into.add((i, p))
                        break
    assert sure <= got <= possible and len(sure) > 20


def test_short_passages(spark):
    items = [(1, "Two words"), (2, "one, two; three four"), (3, "..."), (4, None), (5, "a long passage of many words that stands here. Its answer is forty two")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "here two words stand"), (2, "two other words"), (3, "ONE two three (four)."), (4, "three one two four"), (5, "words two"), (6, ""), (7, None), (8, "two words " * 5000)]
    got = sorted((r.doc_id, r.item_id) for r in leaks.find(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect())
    assert got == [(1, 1), (3, 2), (8, 1)]
    only = leaks.find(spark.createDataFrame(rows, "doc_id long, text string"), benchmark.filter("item_id = 3"))
    assert only.count() == 0


def test_blocks(spark, sf, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted((r.doc_id, r.item_id, r.lcs_ratio) for r in leaks.find(docs, benchmark).collect())
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 200)
    monkeypatch.setattr(leaks, "BLOCKS", 2)
    assert sorted((r.doc_id, r.item_id, r.lcs_ratio) for r in leaks.find(docs, benchmark).collect()) == want
