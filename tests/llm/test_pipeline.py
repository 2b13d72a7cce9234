"""The pipeline's stages, each on its own input, and as a whole."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_jaccard import brute_kept
from textloom.llm import leaks, mixing, rules


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = (docs, out)
        docs = out
    before, after = seen["quality_rules"]
    good = {r.doc_id for r in rules.cascade(before).filter("rejected_by is null").collect()}
    assert {r.doc_id for r in after.collect()} == good and after.columns == columns
    before, after = seen["near_dedup"]
    want, _ = brute_kept([(r.doc_id, r.text) for r in before.collect()])
    assert Counter(r.doc_id for r in after.collect()) == Counter(want)
    before, after = seen["decontamination"]
    held = {r.doc_id for r in leaks.find(before, benchmark).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - held and after.columns == columns
    before, after = seen["mix_sources"]
    assert Counter(r.doc_id for r in after.collect()) == Counter({r._key: r._copies for r in mixing.rates(before).collect() if r._copies})
    before, after = seen["shard"]
    sizes = Counter(r.shard for r in after.collect())
    assert after.count() == before.count() and max(sizes.values()) - min(sizes.values()) <= 1
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.shard) for r in whole.collect()) == sorted((r.doc_id, r.shard) for r in after.collect())


def test_empty(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "none"))
    empty = spark.read.parquet(str(tmp_path / "none"))
    assert [stage(spark, empty, sf).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns that clash with the stages' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _in string, _row int, _text string, _src string, _copies int, rejected_by string"
    good = " ".join(f"word{i % 97} other{i % 89}" for i in range(400))
    texts = [None, "", " \n", good, good, good + " end", "a b c " * 100, "x" * 300_000]
    rows = [(i, t, None, f"s{i % 2}" if i % 3 else None, None, "a", 1, "b", "c", 2, "d") for i, t in enumerate(texts)]
    rows += [rows[3], (None, good.upper(), None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    docs = odd = spark.read.parquet(str(tmp_path / "in"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, sf).write.parquet(str(tmp_path / f"alone_{name}"))
        alone = spark.read.parquet(str(tmp_path / f"alone_{name}"))
        assert set(alone.columns) >= set(docs.columns)
        kept[name] = Counter((r.doc_id, r.text) for r in alone.collect())
    every = Counter((r[0], r[1]) for r in rows)
    assert kept["quality_rules"] == Counter({k: n for k, n in every.items() if k[1] and len(k[1].split()) >= 50 and len(set(k[1].split())) > 9})
    one = Counter(t.lower().split()[0] if t and t.split() else "" for _, t in kept["near_dedup"].elements())
    assert one == Counter({"": 1, "word0": 1, "a": 1, "x" * 300_000: 1}) and (None, good.upper()) in kept["near_dedup"]  # null ids come first
    assert kept["decontamination"] == every
    assert set(kept["mix_sources"]) <= set(every) and all(n <= 3 * every[k] for k, n in kept["mix_sources"].items())
    assert kept["shard"] == every
