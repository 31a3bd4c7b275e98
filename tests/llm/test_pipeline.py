"""The pipeline's stages against what each should do with its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from stratograph.llm import decontamination
from stratograph.llm._spark import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf), name)
        seen[name] = (before, docs)
        assert docs.columns[: len(columns)] == columns
    a, b = seen["quality_classifier"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good, junk = labels.where("quality = 1").select("doc_id"), labels.where("quality = 0").select("doc_id")
    assert b.join(good, "doc_id").count() >= 0.98 * a.join(good, "doc_id").count() and b.join(junk, "doc_id").count() <= 0.2 * junk.count()
    a, b = seen["minhash_near_dedup"]
    texts = a.select("text").distinct().count()
    assert b.count() <= texts and b.select("text").distinct().count() == b.count()
    a, b = seen["benchmark_decontamination"]
    found = decontamination.find_contamination(a, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert {r["doc_id"] for r in found if not r["contaminated"]} == {r["doc_id"] for r in b.collect()} and b.count() < a.count()
    a, b = seen["source_mixing"]
    words = lambda df: sum(len(r["text"].split()) for r in df.select("text").collect())
    assert abs(words(b) - 1.5 * words(a)) <= 40
    a, b = seen["sharding"]
    sizes = Counter(r["shard"] for r in b.select("shard").collect())
    assert b.count() == a.count() and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(set)
    for r in b.select("shard", "slot").collect():
        slots[r["shard"]].add(r["slot"])
    assert all(slots[s] == set(range(n)) for s, n in sizes.items())


def test_run_agrees_with_itself(spark, sf):
    one, two = (sorted((r["doc_id"], r["n_chars"]) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_chars").collect()) for _ in range(2))
    assert one == two and one


def test_awkward_rows_pass_every_stage(spark, sf):
    """Nulls, empty and long texts, repeated rows and clashing columns: no crash, and the given columns come out."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, taken string, row string"
    rows = [(i, f"plain words of text number {i} that say little", "en", "a", 40) for i in range(12)]
    rows += [(None, "some text without an id", None, None, 1), (20, None, None, None, None), (21, "", "en", "a", 0), (22, "w " * 20_000, "en", "b", 1)]
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows + rows[:3]], schema)
    for given in (docs, docs.where("false")):
        own = given
        for name, stage in corpus_pipeline.STAGES:
            own = written(stage(spark, own, sf), name)
            assert set(given.columns) <= set(own.columns) and len(own.columns) == len(set(own.columns))
        assert (own.count() > 0) == (given.count() > 0)
