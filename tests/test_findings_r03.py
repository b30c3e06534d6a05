"""What the third round's findings showed, on small inputs."""

from pyspark.sql import functions as F

from siltstone.plans import run, run_queries


def evaluations(df) -> int:
    """How often a plan calls the function that reads pages."""
    return str(df._jdf.queryExecution().executedPlan().toString()).count("[read(")


def test_recorded_merge_reads_pages_once(spark):
    from checking import SMALL

    assert evaluations(run_queries.recorded_llm_merge(spark, SMALL)) == 0  # what was read lies in the shared folder


PAGES = [
    (1, "http://a.test/", "<html><head><title> A &amp;&quot; b&amp</title></head><body><header><h1>One</h1></header><div><h1></h1></div></body></html>"),
    (2, "http://a.test/", "<html><body><div class='x'><h1>Menu</h1></div></body></html>"),
    (3, "http://a.test/", None),
]


def with_pages(spark, folder):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def same_on(spark, folder, name):
    import duckdb
    from checking import same_rows

    from siltstone.plans import catalogue

    duck = duckdb.connect()
    for t in {p.stem for p in folder.glob("*.parquet")}:
        duck.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    same_rows(catalogue.QUERIES[name](spark, str(folder)), duck, catalogue.SQL[name])


def test_headings_are_those_of_the_page_as_it_stands(spark, tmp_path):
    with_pages(spark, tmp_path)
    same_on(spark, tmp_path, "dom_heading_counts")


def test_titles_as_pages_write_them(spark, tmp_path):
    with_pages(spark, tmp_path)
    same_on(spark, tmp_path, "page_metadata")


def test_equal_scores_are_equal_however_they_come_about(spark):
    from siltstone.plans import mapping

    rows = [(1, 0, "a", 2, 3), (1, 2, "z", 2, 8), (2, 0, "a", 1, 1), (2, 1, "z", 1, 6), (3, 0, "a", 2, 1), (3, 4, "z", 2, 6)]
    e = spark.createDataFrame(rows, "k long, idx long, entity_type string, n_records long, n_attributes long")
    got = {r.k: (r.entity_type, r.score) for r in mapping.primary_entity(e, keys=["k"], words=["company"]).collect()}
    assert got == {1: ("a", 1.6), 2: ("a", 6.2), 3: ("a", 1.2)}


def test_resumed_titles_as_pages_write_them(spark, tmp_path):
    with_pages(spark, tmp_path)
    same_on(spark, tmp_path, "resumed_pages")


def test_parts_of_a_sheet_start_where_their_rows_do(spark, tmp_path):
    import zipfile

    from siltstone.sources import workbook
    from siltstone.sources.sinks import WorkbookSink

    path = f"{tmp_path}/w.xlsx"
    WorkbookSink(path).write(spark.range(1000).select(F.col("id").cast("string").alias("id")).orderBy(F.col("id").cast("int")))
    with zipfile.ZipFile(path) as book:
        (_, part), *_ = workbook.sheet_parts(book)
        whole = list(workbook.rows_of(book, part, 0, None))
        parts = workbook._Reader(path, part, ["id"], 3).partitions()
        assert len(parts) <= workbook.MOST_PARTS
        read = [r for p in parts for r in workbook.rows_of(book, part, p.first, p.last, p.start)]
    assert len(whole) == 1001 and read == whole[1:]


def test_mapped_values_are_decided_in_their_row(spark):
    from checking import SMALL

    from siltstone.plans import dataset_queries, mapping

    plan = str(dataset_queries.field_mapper_first_wins(spark, SMALL)._jdf.queryExecution().executedPlan().toString())
    assert "Exchange" not in plan and "Sort" not in plan
    pairs = "map('B-b', '', 'b_b', '2', 'B B', '3', 'c', null, 'z', '9')"
    got = mapping.first_wins_in(spark.range(1), F.expr(pairs), {"b b": "B", "c": "C", "Z": "Z"}, keys=["id"])
    assert sorted((r.column, r.value) for r in got.collect()) == [("B", "2"), ("Z", "9")]


def test_narrow_tables_are_dealt_by_their_rows(spark, tmp_path):
    from siltstone.plans import record_queries, registry

    spark.range(10).write.parquet(f"{tmp_path}/t.parquet")
    t = registry.table(spark, str(tmp_path), "t")
    assert registry.spread(t, rows=1).rdd.getNumPartitions() == 10
    from checking import SMALL

    assert record_queries._listings(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pages_of_a_batch_are_made_in_slices(spark, monkeypatch):
    from siltstone.plans import pages

    monkeypatch.setattr(pages, "SLICE", 3)
    rows = spark.createDataFrame([(k, "http://a.test/", f"<title>t{k}</title>") for k in range(10)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.title for r in pages.pages_with(rows, want=["title"]).select("page_id", "page.title").collect()}
    assert got == {k: f"t{k}" for k in range(10)}


def test_snippets_are_made_only_where_layouts_are_wanted():
    from siltstone.operators.blocks import layouts
    from siltstone.operators.tree import parse

    html = "<dl><dt>Fee</dt><dd>5</dd></dl>"
    assert [x["snippet"] for x in layouts(parse(html), snippets=False)] == [None]
    assert [x["snippet"] for x in layouts(parse(html))] == [html]
