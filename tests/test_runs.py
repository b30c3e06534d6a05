"""Whole runs, schemas, evaluation, merging of pieces, journeys and jobs on small rows with expected values."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import evidence
from siltstone.plans import evaluation, jobs, journey, pieces, records, run, schema
from siltstone.plans.pages import pages_with
from siltstone.sources import urls

LEGACY = {
    "sheet_name": "Listings",
    "extraction_fields": {"franchise_name": {"type": "string"}, "investment_required": {}, "products": {"type": "array", "description": "What it sells"}},
    "aliases": {"total cost": "Investment Required", "investment_required": "Investment Required"},
    "columns": ["Franchise Name", "Investment Required", "Source URL", "Brand", "Additional Information"],
    "primary_key": ["Franchise Name"],
    "required_fields": ["Franchise Name", "Source URL"],
}


def test_schema_forms(tmp_path):
    s = schema.schema_of(LEGACY)
    assert [(f.name, f.column, f.required, f.aliases) for f in s.fields] == [("franchise_name", "Franchise Name", True, ()), ("investment_required", "Investment Required", False, ("total cost", "investment_required")), ("products", "Products", False, ())]
    assert (s.keys, s.key_columns(), s.extra_columns, s.extra_required) == (("franchise_name",), ["Franchise Name"], ("Source URL", "Brand"), ("Source URL",))
    assert s.columns()[-1] == "Page Title" and "Source Url" not in s.columns()  # the url has a column of its own
    assert schema.schema_of(LEGACY | {"metadata_columns": []}).metadata_columns() == {}
    again = schema.schema_of(schema.as_dict(s))
    assert again.fields == s.fields and again.keys == s.keys
    assert s.json_schema()["properties"]["products"] == {"type": "array", "nullable": True, "items": {"type": "string"}, "description": "What it sells"}
    assert schema.column_name("products/services_of a_kind") == "Products/Services Of A Kind"
    (tmp_path / "franchise_page.json").write_text(json.dumps(LEGACY))
    (tmp_path / "misc.json").write_text(json.dumps({"fields": [{"name": "x"}]}))
    found = schema.from_folder(str(tmp_path))
    assert schema.for_page_type(found, "Franchise Page").sheet == "Listings" and schema.for_page_type(found, "Blog").fields[0].name == "x"
    assert schema.for_page_type({}, None).own_columns()[0] == "Source URL"


@pytest.mark.parametrize(
    "made, words",
    [
        (lambda: schema.Field(" "), "name must not be empty"),
        (lambda: schema.Field("Page Title"), "reserved"),
        (lambda: schema.Field("x", "text"), "type 'text'"),
        (lambda: schema.Field("x", owner="me"), "owner 'me'"),
        (lambda: schema.Field("x", policy="any"), "policy 'any'"),
        (lambda: schema.Schema("s", (schema.Field("x"), schema.Field("x"))), "more than once"),
        (lambda: schema.Schema("s", metadata=("confidence",)), "metadata column"),
        (lambda: schema.Site("", "a.b"), "name must not be empty"),
        (lambda: schema.Site("s", priority="1"), "priority"),
        (lambda: schema.site_of({"name": "s", "keep_tables": "yes"}), "keep_tables"),
        (lambda: jobs.Settings(output_format="pdf"), "output format"),
    ],
)
def test_specs_that_cannot_be(made, words):
    with pytest.raises(ValueError, match=words):
        made()


def test_site_profile():
    site = schema.site_of({"name": "s", "domain": ["a.b", "c.d"], "aliases": ["e.f"], "priority": 3, "heading_keep_score": 20, "removable_elements": {"classes": ["junk"]}, "dom_clean_config": {"ignored_ids": ["x"]}})
    profile = schema.profile_of(site)
    assert (site.domain, site.aliases, profile.heading_keep, profile.remove_classes, site.clean) == ("a.b", ("c.d", "e.f"), 20, ("junk",), {"ignored_ids": ["x"]})


def test_run_keeps_and_rejects(spark, tmp_path):
    spec = schema.Schema("t", (schema.Field("franchise_name", required=True), schema.Field("phone"), schema.Field("industry"), schema.Field("royalty", required=True)), keys=("franchise_name",))
    page = "<h1>{}</h1><p>Call <a href='tel:9876543210'>us</a></p>"
    rows = [(1, "http://a/1", page.format("Alpha"), None), (2, "http://a/2", page.format("Beta"), None), (3, "http://a/3", "", "connection reset"), (4, "http://a/4", page.format("Gamma"), None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, load_error string")
    answers = spark.createDataFrame([(1, '{"industry": "Food", "royalty": "5%", "phone": "999"}'), (2, '{"industry": ["Tea", "Milk"], "royalty": "Rs 2 Lakhs'), (4, "none")], "page_id long, answer string")
    first = run.run_pages(pages, spec, answers, now="d1", keep=run.snapshots(str(tmp_path / "one")))
    rows = {r["Franchise Name"]: r for r in first.dataset.collect()}
    assert sorted(rows) == ["Alpha", "Beta"]
    a, b = rows["Alpha"], rows["Beta"]
    assert (a["Phone"], a["Industry"], a["Source Url"], a["operation"], a["extraction_date"]) == ("+91 9876543210", "Food", "http://a/1", "Inserted", "d1")
    assert (b["Industry"], b["Royalty"]) == ("Tea, Milk", "₹2 Lakhs")
    assert [(r["page_id"], r["missing"]) for r in first.rejected.collect()] == [(4, ["Royalty"])]
    assert {r["page_id"]: (r["status"], r["error"]) for r in first.summary.collect()} == {1: ("Success", ""), 2: ("Success", ""), 3: ("Failed", "connection reset"), 4: ("Skipped", "missing required fields: Royalty")}
    assert {r["page_id"]: r["retry"] for r in first.failed.collect()} == {3: "Yes", 4: "No"}
    assert tuple(run.counters(first.summary).first()) == (4, 2, 2)
    old = first.dataset.drop("operation")
    again = run.run_pages(pages.where("page_id = 1"), spec, answers, old, now="d2")
    assert {r["Franchise Name"]: (r["operation"], r["extraction_date"], r["last_updated"]) for r in again.dataset.collect()} == {"Alpha": ("Updated", "d1", "d2"), "Beta": ("Unchanged", "d1", "d1")}
    assert spark.read.parquet(str(tmp_path / "one" / "merged")).count() == 3


def test_pages_fail_alone(spark, monkeypatch):
    from siltstone.operators import clean

    def broken(root):
        if any("boom" in s for s in root.strings()):
            raise RuntimeError("boom")
        return {"title": "", "description": "", "social": {}}

    monkeypatch.setattr(clean, "metadata_of", broken)
    df = spark.createDataFrame([(1, "http://a", "<p>fine</p>"), (2, "http://b", "<p>boom</p>")], urls.PAGES).coalesce(1)
    from siltstone.plans import pages

    got = [pages.page_of(r["html"], r["url"], frozenset(["title", "visible"]), None, None, None, False) for r in df.orderBy("page_id").collect()]
    assert got[0]["error"] is None and got[0]["visible"] == "fine" and got[1] == {"error": "RuntimeError: boom"}


def test_one_evaluation_a_page(spark):
    """An explode of what a page gives does not make Spark read the page twice."""
    from siltstone.plans import page_queries, pages

    df = spark.createDataFrame([(1, "http://a", "<h1>x</h1>")], urls.PAGES)
    for frame in (pages.blocks_of(pages_with(df, want=["blocks"])), pages.facts_of(pages_with(df, want=["said"]))):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
    assert page_queries.pages is not None


def test_evidence_lists_and_scores(spark):
    df = spark.createDataFrame([("Coffee and tea. Call 98765 43210. Return in 24 month.", ["https://x.com/me", "/menu.PDF"], ["tea", "rum"], [], "menu.pdf")], "text string, hrefs array<string>, products array<string>, services array<string>, documents string")
    on = evidence.page(F.col("text"), F.col("hrefs"), F.array().cast("array<string>"))
    r = df.select(
        evidence.any_borne_out("products", F.col("products"), on).alias("some"),
        evidence.any_borne_out("services", F.col("services"), on).alias("none"),
        evidence.borne_out("documents", F.col("documents"), on).alias("paper"),
        evidence.borne_out("payback_period", F.lit("2 years"), on).alias("span"),
        evidence.spoken_of("twitter", on).alias("twitter"),
        evidence.spoken_of("facebook", on).alias("facebook"),
        F.array_join(evidence.odd_items("products", F.array(F.lit("a"), F.lit(" "))), ";").alias("odd"),
    ).first()
    assert tuple(r) == (True, True, True, True, True, False, "Field 'products' contains an empty item at index 1")
    done = evaluation.evaluated(df.withColumn("evidence", on).select("evidence", "products", F.lit("1234567890").alias("phone")), fields=("products", "phone", "email"), required=("phone",))
    row = done.withColumn("report", evaluation.report_text()).first()
    assert row["statuses"] == {"products": "Extracted Successfully", "phone": "Possible Hallucination", "email": "Missing on Page"}
    assert (row["coverage"], row["page_score"], row["required_percent"]) == ("1 / 1", 75.0, 100.0) and row["score"] == pytest.approx(30 + 22.5 + 20 + 20 - 15 - 3)
    assert "Possible hallucinations: phone" in row["report"]


def test_pieces(spark):
    df = spark.createDataFrame([(1, 2, "b", "about b", ["y", "x"]), (1, 1, "", "about", ["x", "x"]), (1, 3, "c", "about", None), (2, 1, None, None, ["q", "q"])], "k long, seq long, name string, about string, tags array<string>")
    got = {r["k"]: (r["name"], r["about"], r["tags"]) for r in pieces.merged_records(df, ["k"], "seq").collect()}
    assert got == {1: ("b", "about\nabout b", ["x", "y"]), 2: (None, None, ["q", "q"])}


def test_journey_report(spark):
    spec = schema.Schema("s", (schema.Field("brand"), schema.Field("roi")))
    text = "brand x roi 5"
    df = spark.createDataFrame([(1, text, text, text, "brand x", ["brand"], ["roi"], {"roi": "5"}, {"brand": "x", "roi": "5"}, {"Brand": "x"})], "page_id long, raw string, clean string, relevant string, blocks string, solved array<string>, asked array<string>, answered map<string,string>, valid map<string,string>, written map<string,string>")
    rows = journey.journeys(df, spec, {"brand": "Brand"})
    got = {r["field"]: (r["blocks"], r["first_loss"], r["final_source"]) for r in rows.collect()}
    assert got == {"brand": ("YES", None, "Deterministic"), "roi": ("NO", "DOM Blocks", "None")}
    text = journey.report(rows.collect(), journey.summary(rows).first())
    assert "first loss: DOM Blocks" in text and "| written | 1 |" in text


def test_jobs(spark):
    states = spark.createDataFrame([("created", "run"), ("completed", "run"), ("completed", "rerun"), ("running", "run"), ("failed", "cancel"), ("queued", "complete")], "s string, e string")
    got = [tuple(r) for r in states.select(jobs.moved(F.col("s"), F.col("e")), jobs.refused(F.col("s"), F.col("e"))).collect()]
    assert got == [("running", None), ("completed", "already completed; rerun it"), ("running", None), ("running", "already running"), ("failed", None), ("queued", "complete is not possible when queued")]
    assert jobs.Settings.of(spark).safe_tokens == 60_000
    assert records.clean_value({"a": [" ", {"b": None}], "c": " x "}) == {"c": "x"} and records.value_text([1, 2], ", ") == "1, 2" and records.value_text(3.0) == "3"
