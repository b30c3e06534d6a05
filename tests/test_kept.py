"""Datasets kept in buckets, jobs as composed effects and as streams, sites without a shuffle, one parse a run."""

import random

import pytest
from checking import SMALL
from pyspark.sql import functions as F

from siltstone import streaming
from siltstone.plans import catalogue, dataset, jobs
from siltstone.sources import sites
from siltstone.sources.kept import KeptDataset


def _files(spark, kept):
    return {b: sorted(spark.read.parquet(f"{kept.folder}/{p}").inputFiles()) for b, p in kept.manifest()["parts"].items()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    kept = KeptDataset(spark, str(tmp_path / "d"), ["name"], buckets=8)
    assert kept.read() is None
    first = spark.createDataFrame([(k, f"N{k}", f"v{k}") for k in range(200)], "seq long, name string, value string")
    kept.merge(first, now="d1")
    files = _files(spark, kept)
    assert len(files) == 8 and kept.read().count() == 200
    second = spark.createDataFrame([(0, " n7 ", "new"), (1, "N300", "more"), (2, "n7", "newest")], "seq long, name string, value string")
    made = kept.merge(second, now="d2")
    after, touched = _files(spark, kept), {b for b, p in made["parts"].items() if p.startswith("data/000000000001")}
    assert 1 <= len(touched) <= 2 and all(after[b] == files[b] for b in files if b not in touched) and all(after[b] != files[b] for b in touched)
    want = dataset.upserted(dataset.upserted(first.limit(0).withColumns({"extraction_date": F.lit(""), "last_updated": F.lit("")}), first, ["name"], now="d1").drop("operation"), second, ["name"], now="d2").drop("operation")
    assert sorted(map(tuple, kept.read().collect())) == sorted(map(tuple, want.collect()))
    assert kept.read(number=0).count() == 200 and {r["value"] for r in kept.read().where("seq = 7").collect()} == {"newest"}
    kept.merge(second.limit(0), now="d3")  # touches nothing
    assert _files(spark, kept) == after


def test_merge_lost_before_its_manifest(spark, tmp_path, monkeypatch):
    kept = KeptDataset(spark, str(tmp_path / "d"), ["name"], buckets=4)
    rows = spark.createDataFrame([(k, f"N{k}") for k in range(20)], "seq long, name string")
    kept.merge(rows, now="d1", batch_id=0)
    before = sorted(map(tuple, kept.read().collect()))

    def lost(manifest):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(kept, "_commit", lost)
        with pytest.raises(OSError):
            kept.merge(rows.withColumn("name", F.concat("name", F.lit("x"))), now="d2", batch_id=1)
    again = KeptDataset(spark, kept.folder, ["other"])  # keys and buckets are the dataset's own
    assert (again.keys, again.buckets) == (["name"], 4) and sorted(map(tuple, again.read().collect())) == before
    again.merge(rows.withColumn("name", F.concat("name", F.lit("x"))), now="d2", batch_id=1)
    assert again.read().count() == 40 and again.merge(rows, now="d3", batch_id=1) == again.manifest() and again.manifest()["number"] == 1
    gone = again.clear()
    assert gone and again.read().count() == 40 and all(p not in gone for p in again.manifest()["parts"].values())
    with pytest.raises(RuntimeError):
        again._commit(again.manifest())  # its number is taken
    with pytest.raises(ValueError):
        again.merge(spark.createDataFrame([(1, "x")], "seq long, other string"), now="d4")


def test_stream_into_buckets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        spark.createDataFrame([(j, f"n{j % 7}", f"b{k}") for j in range(10)], "seq long, name string, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("seq long, name string, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = KeptDataset(spark, str(tmp_path / "d"), ["name"], buckets=4)
    streaming.keep_buckets(rows, kept, checkpoint=str(tmp_path / "c"), now=lambda n: f"d{n}").awaitTermination()
    assert kept.manifest()["batch_id"] == 2 and {(r["name"], r["value"], r["extraction_date"], r["last_updated"]) for r in kept.read().collect()} == {(f"n{j}", "b2", "d0", "d2") for j in range(7)}


def test_jobs_replayed_by_effects(spark):
    """Against one event after the other, with a job that has most of the events and is in several tasks, and any state at the start."""
    rng = random.Random(3)
    names = [m[0] for m in jobs.MOVES] + ["unheard of"]
    rows = [(0 if rng.random() < 0.7 else rng.randrange(1, 40), k, rng.choice(names)) for k in range(3000)]
    states = {k: rng.choice(jobs.STATES) for k in range(45)} | {99: "no such state"}
    want = {}
    allowed = {(n, b): a for n, bs, a in jobs.MOVES for b in bs}
    for job, s in states.items():
        refused = 0
        for i, _, e in rows:
            if i == job:
                refused += (e, s) not in allowed and e != jobs.QUIET
                s = allowed.get((e, s), s)
        want[job] = (s, refused)
    rng.shuffle(rows)
    given = spark.createDataFrame([(j, s, "kept") for j, s in states.items()], "id long, status string, more string")
    events = spark.createDataFrame(rows, "id long, at long, event string").repartition(6)
    done = jobs.replayed(given, events)
    assert {r["id"]: (r["status"], r["refused"]) for r in done.collect()} == want and done.columns == ["id", "status", "more", "refused"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or these few rows are one task's
    try:
        assert {r["id"]: (r["status"], r["refused"]) for r in jobs.replayed(given, events).collect()} == want
        parts = jobs.segments(events).where("id = 0").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1 and "collect_list" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert jobs.replayed(given, events.limit(0)).where("refused = 0").count() == len(states)


def test_stream_of_jobs_with_a_timer(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        batches = [
            [("a", "2024-01-01 00:00:00", "run"), ("b", "2024-01-01 00:00:00", "run"), ("b", "2024-01-01 00:01:00", "complete"), ("b", "2024-01-01 00:02:00", "run")],
            [("c", "2024-01-01 05:00:00", "run")],
            [("c", "2024-01-01 05:01:00", "cancel")],
            [("a", "2024-01-01 05:02:00", "fail")],
        ]
        path = tmp_path / "in"
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, "id string, ts string, event string").coalesce(1).write.parquet(str(path / f"k={k}"))
        events = spark.readStream.schema("id string, ts string, event string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
        got = []
        query = streaming.followed_jobs(events, stuck_after_seconds=3600).writeStream.outputMode("update").foreachBatch(lambda df, n: got.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = [r[1:] for r in got]
        assert ("b", "completed", 1, False) in rows and ("a", "running", 0, False) in rows and ("a", "running", 0, True) in rows
        assert ("c", "cancelled", 0, False) in rows and ("a", "failed", 0, False) in rows
        assert not any(r[0] == "b" and r[3] for r in rows)
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_sites_without_a_shuffle(spark):
    """Against all pairs, with sites of one domain, ties of priority, and domains of no site; pages are not exchanged."""
    rng = random.Random(1)
    labels = ["a", "b", "com", "net"]
    domains = [".".join(rng.choices(labels, k=rng.randint(1, 4))) for _ in range(300)]
    named = [(".".join(rng.choices(labels, k=rng.randint(1, 3))), f"s{k}", rng.randint(0, 3)) for k in range(25)]
    df = spark.createDataFrame([(k, f"http://{d}/x", "html") for k, d in enumerate(domains)] + [(1000, None, "html"), (1001, "no url", "html")], "page_id long, url string, html string")
    got = sites.matched(df, sites.frame(spark, named))
    want = {}
    for k, d in enumerate(domains):
        fits = [(p, -n, s) for n, (x, s, p) in enumerate(named) if d == x or d.endswith("." + x)]
        want[k] = max(fits)[2] if fits else "default"
    assert {r["page_id"]: r["site"] for r in got.where("page_id < 1000").collect()} == want and got.count() == 302
    plan = got._jdf.queryExecution().executedPlan().toString()
    big = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "html" in line]
    assert not big and got.columns == ["page_id", "url", "html", "domain", "site"]
    assert {r["site"] for r in sites.matched(df, sites.frame(spark, named).limit(0)).collect()} == {"default"}


@pytest.mark.parametrize("name", ["dataset_run", "dataset_summary", "failed_urls"])
def test_a_run_reads_pages_once(spark, name):
    plan = catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan  # the one evaluation is behind the table that the plan reads
