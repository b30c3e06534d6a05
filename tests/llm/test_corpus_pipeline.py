"""Each stage of the pipeline against a brute-force version of its decision, on its own input."""

import collections

from checking import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import common, jaccard, line_dedup, quality


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    inputs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(common.stored(stage(spark, inputs[-1], SMALL)))
    rows = [{r["doc_id"]: r for r in d.collect()} for d in inputs]
    assert all(d.columns == columns for d in inputs[:-1])
    assert set(rows[1]) == {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    lines = line_dedup.dedup_lines(inputs[1])
    assert {d: r["text"] for d, r in rows[2].items()} == {r["doc_id"]: r["text"] for r in lines.collect() if r["n_removed"] == 0 or r["text"]}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2].values())
    groups = collections.defaultdict(set)
    for r in jaccard.group_near(inputs[2]).collect():
        groups[r["component_id"]].add(r["doc_id"])
    assert set(rows[3]) == {min(g) for g in groups.values()}
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = r["text"].lower().replace(".", " ").replace(",", " ").split()
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    dirty = {d for d, r in rows[3].items() if (w := r["text"].lower().replace(".", " ").replace(",", " ").split()) and any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))}
    assert not dirty & set(rows[4]) and set(rows[4]) <= set(rows[3])
    assert {"copies", "taken"} <= set(inputs[5].columns) and all(r["taken"] == r["copies"] * len(r["text"].split()) for r in rows[5].values())


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, None, None, None, 0), (2, "", "en", "a", 0), (3, "good words in a line here. " * 3 + " ".join(f"w{k}" for k in range(60)), None, None, 5), (3, "good", "en", "a", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("size", "taken", "_size", "kept")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x y")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(rows)
    empty = tmp_path / "empty"
    df.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
