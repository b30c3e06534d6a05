import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone import streaming
from siltstone.plans import answers, dataset, pages
from siltstone.sources import sinks, sites, urls


def test_upsert(spark):
    old = spark.createDataFrame([(1, "A", "x", "d0", "d0"), (2, "B", "y", "d0", "d0")], "seq long, name string, v string, extraction_date string, last_updated string")
    new = spark.createDataFrame([(1, " a ", ""), (2, "C", "z"), (3, "c", "w")], "seq long, name string, v string")
    rows = {r["name"].strip().lower(): r for r in dataset.upserted(old, new, ["name"], now="d1").collect()}
    assert len(rows) == 3
    assert (rows["a"]["v"], rows["a"]["extraction_date"], rows["a"]["last_updated"], rows["a"]["operation"], rows["a"]["seq"]) == ("", "d0", "d1", "Updated", 1)
    assert (rows["b"]["operation"], rows["c"]["operation"], rows["c"]["v"]) == ("Unchanged", "Inserted", "w")
    assert dataset.upserted(old, new, [], now="d1").count() == 5


def test_pages_isolate_failures(spark):
    df = spark.createDataFrame([(1, "http://a.b", "<h1>Hi</h1>"), (2, None, None)], urls.PAGES)
    got = {r["page_id"]: r["page"] for r in pages.pages_with(df, raw=True).collect()}
    assert got[1]["fields"]["franchise_name"] == "Hi" and got[2]["error"] is None and got[2]["blocks"] == []


def test_sites_and_urls(spark, tmp_path):
    df = spark.createDataFrame([("https://x.b.com/1",), ("http://c.org",)], "url string")
    got = {r["url"]: r["site"] for r in sites.matched(df, sites.frame(spark, [("b.com", "low", 1), ("x.b.com", "high", 5)])).collect()}
    assert got == {"https://x.b.com/1": "high", "http://c.org": "default"}
    (tmp_path / "u.txt").write_text(" http://a \n\n\thttp://b\n")
    assert [r["url"] for r in urls.urls_from_text(spark, str(tmp_path / "u.txt")).collect()] == ["http://a", "http://b"]
    panes = spark.createDataFrame([(1, "p", 0, "<b>aa</b>"), (1, "p", 1, "<b>bb</b>"), (1, "q", 1, "x")], "page_id long, pane_id string, seq int, html string")
    assert {r["pane_id"]: r["html"] for r in urls.longest_panes(panes).collect()} == {"p": "<b>aa</b>", "q": "x"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("₹5", 'a,"b"\nc', None)], "x string, y string, z string")
    sinks.sink_for("CSV", str(tmp_path / "c")).write(df)
    back = spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, escape='"').first()
    assert (back["x"], back["y"], back["z"]) == ("₹5", 'a,"b"\nc', None)
    sinks.sink_for("excel", str(tmp_path / "w.xlsx")).write(df)
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert "₹5" in z.read("xl/worksheets/sheet1.xml").decode()
    with pytest.raises(ValueError):
        sinks.sink_for("pdf", "x")


def test_answers(spark):
    class Echo:  # a local class travels to the workers
        def answer(self, prompt):
            if prompt == "bad":
                raise RuntimeError("quota exceeded: per day")
            return json.dumps({"said": prompt})

    df = spark.createDataFrame([(1, "hello"), (2, "bad"), (3, "more")], "page_id long, prompt string").coalesce(1)
    got = {r["page_id"]: r for r in answers.asked(df, Echo, retries=0).collect()}
    assert json.loads(got[1]["answer"]) == {"said": "hello"} and "per day" in got[2]["answer_error"] and got[3]["answer"] is None
    kept = answers.recorded(df, spark.createDataFrame([(1, '{"a": [1')], "page_id long, answer string"))
    assert kept.select(answers.repaired_json(F.col("answer")).alias("j")).where("j is not null").first()["j"] == '{"a": [1]}'


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "u1", "a"), (2, "u2", "b")], urls.PAGES).coalesce(1).write.parquet(src)
    rows = lambda: streaming.arriving_pages(spark, src).select(F.col("page_id").alias("seq"), "url", "html")
    run = lambda: streaming.keep_dataset(rows(), out, ["url"], checkpoint=str(tmp_path / "cp"), now=lambda n: f"t{n}").awaitTermination()
    run()
    spark.createDataFrame([(3, "u1", "c")], urls.PAGES).coalesce(1).write.mode("append").parquet(src)
    run()
    got = {r["url"]: (r["html"], r["extraction_date"], r["last_updated"]) for r in spark.read.parquet(f"{out}/v1").collect()}
    assert got == {"u1": ("c", "t0", "t1"), "u2": ("b", "t0", "t0")}
