"""Workbooks read in parts, pages fetched with tries and pauses, tab panes."""

import http.server
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.operators import panes
from siltstone.plans import evaluation
from siltstone.plans.pages import with_panes
from siltstone.sources import fetch, workbook
from siltstone.sources.sinks import WorkbookSink


def test_workbook_reads_back(spark, tmp_path):
    rows = [(str(k), None if k % 7 == 0 else f"text <{k}> & ü\n", f"  {k}  ") for k in range(500)]
    df = spark.createDataFrame(rows, "id string, `a.b` string, note string").coalesce(1)
    path = str(tmp_path / "book.xlsx")
    WorkbookSink(path, "Listings").write(df)
    workbook.register(spark)
    for options, parts in (({"rows": 200}, 3), ({"sheet": "Listings"}, 1), ({"sheet": "1", "rows": 500}, 1)):
        read = spark.read.format("workbook").options(**options).load(path)
        assert read.rdd.getNumPartitions() == parts and read.columns == ["id", "a.b", "note"]
        assert [tuple(r) for r in read.collect()] == [tuple("" if c is None else c for c in r) for r in rows]
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("workbook").option("sheet", "Other").load(path).count()
    WorkbookSink(path).write(df.limit(0))
    assert spark.read.format("workbook").load(path).count() == 0


def test_workbook_of_other_makers(spark, tmp_path):
    """Shared strings with runs, cells left out, numbers, booleans, results of formulas, a sheet by an absolute path, names that repeat."""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook {space} xmlns:r="{rel}"><sheets><sheet name="First" sheetId="1" r:id="a"/><sheet name="Two" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {space}><si><t>name</t></si><si><r><t>bold</t></r><r><t> and plain</t></r><rPh><t>reading</t></rPh></si><si><t>unused</t></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {space}><sheetData/></worksheet>",
        "xl/worksheets/two.xml": f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>far</t></is></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.5</v></c><c r="AB2" t="b"><v>1</v></c></row><row r="5"><c r="C5" t="str"><f>A1</f><v>made</v></c></row></sheetData></worksheet>',
    }
    path = str(tmp_path / "book.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    workbook.register(spark)
    df = spark.read.format("workbook").options(sheet="Two", rows=1).load(path)
    assert len(df.columns) == 28 and df.columns[:3] == ["name", "_c1", "name.1"] and df.columns[27] == "far"
    got = df.select("name", "_c1", F.col("`name.1`"), "far").collect()
    assert [tuple(r) for r in got] == [("bold and plain", "1.5", None, "true"), (None, None, "made", None)]
    assert spark.read.format("workbook").load(path).columns == [] and workbook.column_number("AB12") == 27


def test_numbers_over_tasks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    got = evaluation.numbered(df, [-F.col("k")]).collect()
    assert [r["number"] for r in sorted(got, key=lambda r: -r["k"])] == list(range(1, 1001))
    assert evaluation.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_fetch_over_http(spark):
    hits: list[tuple[str, float]] = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            hits.append((self.path, time.monotonic()))
            tries = sum(p == self.path for p, _ in hits)
            good = not self.path.startswith("/bad") and (not self.path.startswith("/second") or tries > 1)
            body = "<h1>é</h1>".encode("latin-1") if self.path == "/latin" else f"<p>{self.path}</p>".encode() * (50 if self.path == "/long" else 1)
            self.send_response(200 if good else 503)
            self.send_header("Content-Type", "text/html" + ("; charset=latin-1" if self.path == "/latin" else ""))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        paths = ["/a", "/b", "/latin", "/second", "/bad", "/long"]
        urls = spark.createDataFrame([(k, at + p) for k, p in enumerate(paths)] + [(7, None), (8, " "), (9, "http://127.0.0.1:1/none")], "page_id long, url string").repartition(4)
        got = {r["page_id"]: r for r in fetch.fetched(urls, lambda: fetch.Http(timeout=5, most_bytes=200), retries=1, retry_seconds=0.0, host_seconds=0.05).collect()}
        assert [got[k]["html"] for k in range(4)] == ["<p>/a</p>", "<p>/b</p>", "<h1>é</h1>", "<p>/second</p>"] and [got[k]["attempts"] for k in (0, 3, 4, 7, 9)] == [1, 2, 2, 0, 2]
        assert "503" in got[4]["load_error"] and got[4]["html"] is None and "longer than 200" in got[5]["load_error"] and got[7]["load_error"] == got[8]["load_error"] == "the url is empty" and "refused" in got[9]["load_error"]
        first = sorted(min(t for p, t in hits if p == path) for path in paths)
        assert all(b - a > 0.045 for a, b in zip(first, first[1:], strict=False))  # one task, one request in so long
    finally:
        server.shutdown()


def test_fetch_deals_hosts(spark):
    """Rows of a host are in one task, those of a host with lanes in several; extra columns stay."""
    rows = [(k, f"http://h{k % 5}.test/{k}", "x", [(None, "ok")]) for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, responses array<struct<error:string,html:string>>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        where = lambda lanes: fetch.fetched(df, fetch.Recorded, lanes=lanes).select("url", F.spark_partition_id().alias("p"), "html").collect()
        one, many = where(1), where(4)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    host = lambda r: r["url"].split("/")[2]
    assert all(len({r["p"] for r in one if host(r) == h}) == 1 for h in map(host, one)) and any(len({r["p"] for r in many if host(r) == h}) > 1 for h in map(host, many))
    assert {r["html"] for r in one} == {"ok"} and fetch.fetched(df.limit(0), fetch.Recorded).columns == ["page_id", "url", "responses", "html", "load_error", "attempts"]


def test_panes(spark):
    assert panes.spliced(None, []) == "" and panes.spliced("<p>x</p>", [("a", "<div class=tab-pane id=a>long</div>")]) == "<p>x</p>"
    pages = spark.createDataFrame([(1, "u", "<body><div class='tab-pane' id='a'>one</div></body>"), (2, "u", "<body>plain</body>"), (3, "u", None)], "page_id long, url string, html string")
    shots = spark.createDataFrame(
        [(1, 0, "<div class='tab-pane' id='a'>on</div>"), (1, 1, "<div class='tab-pane' id='b'>first</div><div class='tab-pane'>no id</div><p class='tab-pane' id='c'>no div</p>"), (1, 2, "<div class='tab-pane' id='b'>fir<b>st</b></div>"), (1, 3, None), (9, 0, "<div role=tabpanel id=z>of no page</div>")],
        "page_id long, seq int, html string",
    )
    got = {r["page_id"]: r["html"] for r in with_panes(pages, shots).collect()}
    assert got[1] == '<body><div class="tab-pane active show" id="a">one</div><div class="tab-pane active show" id="b">first</div></body>' and got[2] == "<body>plain</body>" and got[3] is None
    nested = '<body><div class="tab-pane" id="out">a<div class="tab-pane" id="in">b</div></div></body>'
    assert 'id="in">longer text' in panes.spliced(nested, [("in", '<div class="tab-pane" id="in">longer text</div>')])
