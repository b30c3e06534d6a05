"""Queries over whole runs: pages to dataset, what became of each url, where fields were lost, jobs.

Pages are put together from ``part``, so that what a run gives can be said in SQL over the same columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import quoted
from ..sources import fetch, shared, workbook
from ..sources.sinks import WorkbookSink
from . import evaluation, jobs, journey, run
from .pages import exploded, facts_of, pages_with, with_panes
from .registry import ROWS_A_TASK, query, spread, table
from .schema import Field, Schema, Site

LISTING = Schema(
    "listing",
    (
        Field("franchise_name", required=True),
        Field("investment_required", aliases=("total investment",)),
        Field("phone"),
        Field("website"),
        Field("industry", description="What it deals in"),
        Field("products", "array"),
    ),
    keys=("franchise_name", "Source Url"),
)
HTML = """concat('<html><head><title>T', p_partkey, '</title></head><body><nav>Menu of links</nav><h1>', case when p_size % 10 = 0 then '' else concat('Name ', p_partkey) end, '</h1>',
 '<dl><dt>Total Investment</dt><dd>Rs. ', p_size, ' Lakhs</dd><dt>Mobile</dt><dd>98765', 10000 + p_partkey % 89999, '</dd></dl>',
 '<p>Kinds: see <a href=\"https://shop', p_partkey, '.example.org/\">our website</a></p></body></html>')"""
ANSWER = """case p_size % 3 when 0 then concat('{\"industry\": \"', p_type, '\", \"investment_required\": \"1 Cr\", \"products\": [\"a\", \"b\"]}') when 1 then concat('```json {\"industry\": \"', p_type, '\", \"franchise_name\": \"Said ') end"""


def listing_pages(spark, sf_dir):
    """(page_id, url, html, load_error) and the recorded answers to them."""
    p = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK)
    pages = p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("http://pages.test/"), "p_partkey").alias("url"), F.expr(HTML).alias("html"), F.when(F.col("p_partkey") % 50 == 7, "navigation timed out").when(F.col("p_partkey") % 50 == 8, "no such host").alias("load_error"))
    return pages, p.select(F.col("p_partkey").alias("page_id"), F.expr(ANSWER).alias("answer"))


def listing_run(spark, sf_dir):
    pages, answers = listing_pages(spark, sf_dir)
    return run.run_pages(pages, LISTING, answers, site=Site("pages"), now="2024-01-01")


_RUN_SQL = """with p as (select *, coalesce(case when p_partkey % 50 = 7 then 'navigation timed out' when p_partkey % 50 = 8 then 'no such host' end, '') as load_error, p_size % 10 = 0 as unnamed from part),
r as (select *, case when not unnamed then 'Name ' || p_partkey else 'T' || p_partkey end as name, case when p_size % 3 < 2 then p_type else '' end as industry from p)"""


@query(_RUN_SQL + """ select p_partkey as seq, name as "Franchise Name", '₹' || p_size || ' Lakhs' as "Investment Required", '+91 98765' || (10000 + p_partkey % 89999) as "Phone", 'https://shop' || p_partkey || '.example.org/' as "Website",
 industry as "Industry", 'http://pages.test/' || p_partkey as "Source Url", 'T' || p_partkey as "Page Title", 'Inserted' as operation from r where load_error = ''""")
def dataset_run(spark, sf_dir):
    """Pages through parsing, recorded answers, merging, checks, mapping and upsert into a dataset."""
    rows = listing_run(spark, sf_dir).dataset
    return rows.select("seq", *[F.col(quoted(c)) for c in ("Franchise Name", "Investment Required", "Phone", "Website", "Industry", "Source Url", "Page Title")], "operation")


@query(_RUN_SQL + """ select p_partkey as page_id, 'http://pages.test/' || p_partkey as url, case when load_error <> '' then 'Failed' else 'Success' end as status, load_error as error, '2024-01-01' as timestamp from r""")
def dataset_summary(spark, sf_dir):
    """A line for each url of a run."""
    return listing_run(spark, sf_dir).summary.select("page_id", "url", "status", "error", "timestamp")


@query(_RUN_SQL + """ select p_partkey as page_id, load_error as reason, case when load_error like '%timed out%' then 'Yes' else 'No' end as retry from r where load_error <> ''""")
def failed_urls(spark, sf_dir):
    """Urls without a row, why, and whether another try may help."""
    return listing_run(spark, sf_dir).failed.select("page_id", "reason", "retry")


@query(_RUN_SQL + """ select count(*) as processed, count(*) filter (where load_error = '') as success, count(*) filter (where load_error <> '') as failed from r""")
def run_counters(spark, sf_dir):
    return run.counters(listing_run(spark, sf_dir).summary)


@query(_RUN_SQL + """ select p_partkey as page_id, name as franchise_name, 'Rs. ' || p_size || ' Lakhs' as investment_required, '98765' || (10000 + p_partkey % 89999) as phone, industry,
 'franchise_name, investment_required, phone, website' as fields_from_dom, case when p_size % 3 < 2 then 'industry' else '' end || case when p_size % 3 = 0 then ', products' else '' end as fields_from_llm from r where load_error = ''""")
def recorded_llm_merge(spark, sf_dir):
    """What a page states and what a recorded answer says, merged field by field as each field's policy has it."""
    kept = {}

    def keep(name, stage):
        # pages are read once, into the shared folder; nothing after the merge is asked for
        kept[name] = run.in_shared(name, stage) if name == "parsed" else stage
        return kept[name]

    pages, answers = listing_pages(spark, sf_dir)
    run.run_pages(pages, LISTING, answers, site=Site("pages"), now="2024-01-01", keep=keep)
    names = ["page_id", "franchise_name", "investment_required", "phone", "industry", "fields_from_dom", "fields_from_llm"]
    return kept["merged"].select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c not in ("page_id",) else F.col(c) for c in names])


@query(_RUN_SQL + """ select p_partkey as page_id, 6 + 2 as total_fields, 4 + case when p_size % 3 < 2 then 1 else 0 end + case when p_size % 3 = 0 then 1 else 0 end as mapped_fields, 3 as normalized_fields,
 4 as deterministic_fields, case p_size % 3 when 0 then 2 when 1 then 1 else 0 end as llm_fields, 3 - case p_size % 3 when 0 then 2 when 1 then 1 else 0 end as missing_fields, 1 as unmapped_fields from r where load_error = ''""")
def coverage_stats(spark, sf_dir):
    """How many fields of a record are mapped, normalised and missing."""
    rows = listing_run(spark, sf_dir).rows
    return rows.select("page_id", "total_fields", "mapped_fields", "normalized_fields", "deterministic_fields", "llm_fields", "missing_fields", "unmapped_fields")


@query(_RUN_SQL + """ select p_partkey as page_id, 'franchise_name -> Alias Match -> Franchise Name (95%)|investment_required -> Alias Match -> Investment Required (95%)|phone -> Exact Match -> Phone (100%)|website -> Exact Match -> Website (100%)'
 || case when p_size % 3 < 2 then '|industry -> Exact Match -> Industry (100%)' else '' end || case when p_size % 3 = 0 then '|products -> Exact Match -> Products (100%)' else '' end as paths,
 case p_size % 3 when 0 then '100.00%' when 1 then '85.71%' else '71.43%' end as coverage from r where load_error = ''""")
def mapping_paths(spark, sf_dir):
    """By which name each field of a record came to its column, and what share of the dataset's columns that are filled is."""
    return listing_run(spark, sf_dir).rows.select("page_id", F.array_join("paths", "|").alias("paths"), "coverage")


@query(_RUN_SQL + """, f as (select p_partkey as page_id, unnest([
  ['franchise_name', 'WRITTEN', 'Deterministic', case when unnamed then 'DOM Blocks' else '' end], ['investment_required', 'WRITTEN', 'Deterministic', ''], ['phone', 'WRITTEN', 'Deterministic', ''], ['website', 'WRITTEN', 'Deterministic', ''],
  case when p_size % 3 < 2 then ['industry', 'WRITTEN', 'LLM', 'Raw HTML'] else ['industry', 'EMPTY', 'None', 'Raw HTML'] end, case when p_size % 3 = 0 then ['products', 'WRITTEN', 'LLM', 'Raw HTML'] else ['products', 'EMPTY', 'None', 'Raw HTML'] end]) as x from r where load_error = '')
 select page_id, x[1] as field, x[2] as dataset, x[3] as final_source, x[4] as first_loss from f""")
def run_journeys(spark, sf_dir):
    """Each field of each page that a run read, through all stages of the run, and the first that lost it: values that only the model says stand on no page."""
    pages, answers = listing_pages(spark, sf_dir)
    found = run.run_pages(pages, LISTING, answers, site=Site("pages"), now="2024-01-01", trace=True).journeys
    return found.select("page_id", "field", "dataset", "final_source", F.coalesce("first_loss", F.lit("")).alias("first_loss"))


@query(_RUN_SQL + """, n as (select count(*) as n, count(*) filter (where unnamed) as u, count(*) filter (where p_size % 3 < 2) as i, count(*) filter (where p_size % 3 = 0) as p from r where load_error = '')
 select n * 6 as fields, n * 4 as in_raw, n * 4 - u as in_blocks, n * 4 as solved, i + p as answered, n * 4 + i + p as valid, n * 4 + i + p as written from n""")
def run_journey_counts(spark, sf_dir):
    """How many fields of a run's pages each stage still had."""
    pages, answers = listing_pages(spark, sf_dir)
    found = run.run_pages(pages, LISTING, answers, site=Site("pages"), now="2024-01-01", trace=True).journeys
    return journey.summary(found).select("fields", "in_raw", "in_blocks", "solved", "answered", "valid", "written")


_FACTS = """concat('<html><body><ul class=\"breadcrumb\"><li>Home</li><li>Food</li><li>', p_type, '</li></ul><h1>', p_brand, '</h1><table><tr><td>Franchise Fee</td><td>Rs ', p_size, '</td></tr><tr><td>Staff</td><td>', p_size + 1, '</td></tr></table>',
 '<p><a href=\"mailto:a', p_partkey, '@mail.test?x=1\">Mail</a> <a href=\"tel:+91', 9000000000 + p_partkey, '\">Call</a> <a href=\"https://www.facebook.com/p', p_partkey, '\">F</a></p>',
 '<script type=\"application/ld+json\">{\"@type\": \"Organization\", \"name\": \"Org ', p_partkey, '\", \"logo\": \"https://cdn.test/', p_size, '.png\", \"address\": {\"streetAddress\": \"', p_size, ' Road\", \"addressCountry\": \"IN\"}}</script>',
 '<div class=\"faq-list\"><h3>What is ', p_size, '?</h3><p>It is a size.</p><h3>Why?</h3><p>Because.</p></div></body></html>')"""


def _fact_pages(spark, sf_dir, *want, raw=True):
    p = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK).select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("http://pg.abc/"), "p_partkey").alias("url"), F.expr(_FACTS).alias("html"))
    return pages_with(p, want=want, raw=raw)


@query("""with f as (select p_partkey as page_id, unnest([['franchise_name', 'Org ' || p_partkey], ['logo', 'https://cdn.test/' || p_size || '.png'], ['logo_url', 'https://cdn.test/' || p_size || '.png'], ['category', p_type], ['segment', 'Home > Food > ' || p_type],
 ['brand', p_brand], ['email', 'a' || p_partkey || '@mail.test'], ['phone', '+91' || (9000000000 + p_partkey)], ['facebook', 'https://www.facebook.com/p' || p_partkey], ['franchise_fee', 'Rs ' || p_size], ['number_of_employees', cast(p_size + 1 as varchar)]]) as kv from part)
select page_id, kv[1] as field, kv[2] as value from f""")
def stated_facts(spark, sf_dir):
    """Facts of pages with linked data, breadcrumbs, links and a table: of each field the first that is stated."""
    return facts_of(_fact_pages(spark, sf_dir, "said")).select("page_id", "field", "value")


@query("""select p_partkey as page_id, 0 as idx, 'What is ' || p_size || '?' as question, 'It is a size.' as answer from part union all select p_partkey, 1, 'Why?', 'Because.' from part""")
def faq_pairs(spark, sf_dir):
    """Questions of a page and the answers below them."""
    return exploded(_fact_pages(spark, sf_dir, "faq"), ["page_id"], "page.faq", "idx", "q").select("page_id", "idx", "q.question", "q.answer")


@query("""select p_partkey as page_id, p_type as category, 'Home > Food > ' || p_type as segment from part""")
def breadcrumbs(spark, sf_dir):
    said = facts_of(_fact_pages(spark, sf_dir, "said")).where("source = 'breadcrumb'")
    return said.groupBy("page_id").agg(F.max(F.when(F.col("field") == "category", F.col("value"))).alias("category"), F.max(F.when(F.col("field") == "segment", F.col("value"))).alias("segment"))


@query("""with b as (select p_partkey as page_id, unnest([['list', 'Home | Food | ' || p_type], ['heading', p_brand], ['table', 'Franchise Fee: Rs ' || p_size || ' | Staff: ' || (p_size + 1)], ['paragraph', 'Mail Call F'], ['heading', 'What is ' || p_size || '?'], ['paragraph', 'It is a size.'], ['heading', 'Why?'], ['paragraph', 'Because.']]) as x, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8], 1) - 1 as idx from part)
select page_id, idx, x[1] as type, x[2] as text from b""")
def listing_blocks(spark, sf_dir):
    """A page as semantic blocks; nothing of it is pruned by a profile that removes nothing."""
    from ..operators.relevant import Profile

    p = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK).select(F.col("p_partkey").alias("page_id"), F.lit("http://site.test").alias("url"), F.expr(_FACTS).alias("html"))
    b = exploded(pages_with(p, want=["blocks"], profile=Profile(remove_classes=())), ["page_id"], "page.blocks", "idx", "b")
    rows = F.array_join(F.transform("b.rows", lambda r: F.array_join(r, ": ")), " | ")
    return b.select("page_id", "idx", "b.type", F.coalesce("b.text", F.nullif(F.array_join("b.items", " | "), F.lit("")), rows).alias("text"))


_CLEAN = """concat('<html><head><script>var x;</script><style>p{}</style></head><body><!-- note --><nav>Menu</nav><div class=\"ad banner\">Buy</div><h1 onclick=\"f()\" class=\"t\">', p_name, '</h1><p>Text <b>bold</b> ', p_size, '</p>',
 '<img src=\"a.png\" alt=\"Pic\"><a href=\"/x\" data-z=\"1\">link</a><footer><table><tr><td>kept</td></tr></table></footer></body></html>')"""


def _clean_pages(spark, sf_dir, config, *want):
    p = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK).select(F.col("p_partkey").alias("page_id"), F.lit("http://site.test/").alias("url"), F.expr(_CLEAN).alias("html"))
    return pages_with(p, config=config, want=want)


@query("""select p_partkey as page_id, '<html><head></head><body><h1 class="t">' || p_name || '</h1><p>Text <b>bold</b> ' || p_size || '</p> [Image: Pic] link (/x) <footer><table><tr><td>kept</td></tr></table></footer></body></html>' as cleaned from part""")
def clean_listing(spark, sf_dir):
    """Scripts, styles, comments, ads and a menu go; a footer with a table stays; images and links become text."""
    config = {"removable_selectors": ["nav", "footer"], "ignored_classes": ["ad"], "image_handling": "text", "link_handling": "text"}
    return _clean_pages(spark, sf_dir, config, "cleaned").select("page_id", F.col("page.cleaned").alias("cleaned"))


@query("""select p_partkey as page_id, '<html><head></head><body><h1 class="t">' || p_name || '</h1><p>Text <b>bold</b> ' || p_size || '</p><img src="a.png" alt="Pic"/><a href="/x">link</a></body></html>' as filtered, cast(0 as bigint) as kept, cast(3 as bigint) as removed, true as contact_lost from part""")
def prune_listing(spark, sf_dir):
    """A menu, an ad and a footer are pruned; what is left states no contact."""
    from ..operators.relevant import Profile

    p = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK).select(F.col("p_partkey").alias("page_id"), F.lit("http://site.test/").alias("url"), F.expr(_CLEAN).alias("html"))
    done = pages_with(p, want=["filtered", "kept", "removed", "contact_lost"], profile=Profile(remove_classes=("ad",)))
    return done.select("page_id", "page.filtered", "page.kept", "page.removed", "page.contact_lost")


_KINDS = """case p_size % 5 when 0 then concat('<details>a</details><details>b</details><details>c</details>') when 1 then '<p>franchise territory</p>' when 2 then '<p>$1 buy now</p>'
 when 3 then '<p>about us contact us careers</p>' else '<p>nothing</p>' end"""


@query("""select p_partkey as page_id, case p_size % 5 when 0 then 'FAQ' when 1 then 'Franchise Listing' when 2 then 'Product Page' when 3 then 'Company Website' else 'Unknown' end as page_type,
 cast(case p_size % 5 when 0 then 0.6 when 1 then 0.8 when 2 then 0.7 when 3 then 0.7 else 0.0 end as double) as confidence from part""")
def listing_kinds(spark, sf_dir):
    """The kind of a page, by what it has most of."""
    p = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK).select(F.col("p_partkey").alias("page_id"), F.lit("http://site.test/").alias("url"), F.expr(_KINDS).alias("html"))
    return pages_with(p, want=["page_type", "confidence"]).select("page_id", "page.page_type", "page.confidence")


_JOURNEY = Schema("journey", (Field("brand"), Field("royalty"), Field("support", aliases=("help",)), Field("roi"), Field("city"), Field("fee")))


@query("""with p as (select p_partkey as page_id, p_size, p_brand from part),
f as (select page_id, unnest([['brand', 'WRITTEN', ''], ['city', 'EMPTY', case when p_size % 2 = 0 then 'Raw HTML' else 'Cleaned HTML' end], ['fee', 'EMPTY', 'Schema Mapper'], ['roi', 'EMPTY', 'LLM Extraction'], ['royalty', 'EMPTY', 'Validator'], ['support', 'EMPTY', 'Deterministic Extraction']]) as x from p)
select page_id, x[1] as field, x[2] as dataset, x[3] as first_loss from f""")
def field_journey(spark, sf_dir):
    """Each field of each page through all stages, and the first that lost it."""
    return _journeys(spark, sf_dir).select("page_id", "field", "dataset", F.coalesce("first_loss", F.lit("")).alias("first_loss"))


def _journeys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("brand "), "p_brand", F.lit(" royalty 5 help roi 7 fee 9"))
    named = F.when(F.col("p_size") % 2 == 0, text).otherwise(F.concat(text, F.lit(" city")))
    stages = p.select(
        F.col("p_partkey").alias("page_id"),
        named.alias("raw"),
        *[text.alias(t) for t in ("clean", "relevant", "blocks")],
        F.array(F.lit("brand")).alias("solved"),
        F.array(F.lit("royalty"), F.lit("roi"), F.lit("fee")).alias("asked"),
        F.create_map(F.lit("royalty"), F.lit("5"), F.lit("fee"), F.lit("9")).alias("answered"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("fee"), F.lit("9")).alias("valid"),
        F.create_map(F.lit("Brand"), F.col("p_brand")).alias("written"),
    )
    return journey.journeys(stages, _JOURNEY, {"brand": "Brand"})


@query("""select '' as first_loss, count(*) as fields from part union all select case when p_size % 2 = 0 then 'Raw HTML' else 'Cleaned HTML' end, count(*) from part group by 1
 union all select unnest(['Schema Mapper', 'LLM Extraction', 'Validator', 'Deterministic Extraction']), count(*) from part group by 1""")
def first_loss_counts(spark, sf_dir):
    return journey.loss_counts(_journeys(spark, sf_dir)).select(F.coalesce("first_loss", F.lit("")).alias("first_loss"), "fields")


@query("""select count(*) * 6 as fields, count(*) * 5 + count(*) filter (where p_size % 2 = 1) as in_raw, count(*) * 5 as in_clean, count(*) as solved, count(*) * 2 as answered, count(*) * 2 as valid, count(*) as lost_in_validator, count(*) as written from part""")
def journey_summary(spark, sf_dir):
    return journey.summary(_journeys(spark, sf_dir)).select("fields", "in_raw", "in_clean", "solved", "answered", "valid", "lost_in_validator", "written")


@query("""with s as (select page_id, url, html, case when page_id % 10 = 3 then 2 when page_id % 10 = 7 then 0 else 1 end as good from pages)
select page_id, case when good > 0 then 'loaded' else 'OSError: 503 service unavailable' end as status, case good when 0 then 3 else good end as attempts, case when good > 0 then length(html) end as n_chars from s""")
def fetch_pages(spark, sf_dir):
    """Pages served from recorded responses, some at the second try only and some never."""
    p = table(spark, sf_dir, "pages")
    answer = lambda error, html: F.struct(error.cast("string").alias("error"), html.cast("string").alias("html"))
    none, down = F.lit(None), F.lit("503 service unavailable")
    responses = F.when(F.col("page_id") % 10 == 3, F.array(answer(F.lit("navigation timed out"), none), answer(none, F.col("html")))).when(F.col("page_id") % 10 == 7, F.array(answer(down, none))).otherwise(F.array(answer(none, F.col("html"))))
    served = fetch.fetched(p.select("page_id", "url", responses.alias("responses")), fetch.Recorded, retries=2, retry_seconds=0.0, lanes=4)
    return served.select("page_id", F.coalesce("load_error", F.lit("loaded")).alias("status"), "attempts", F.length("html").cast("long").alias("n_chars"))


_TABS = """concat('<html><body><h1>', p_name, '</h1><div class=\"tab-pane\" id=\"one\">', {one}, '</div><div role=\"tabpanel\" id=\"two\" style=\"display:none\">', {two}, '</div>', {more}, '</body></html>')"""


@query("""select p_partkey as page_id, '<html><body><h1>' || p_name || '</h1><div class="tab-pane active show" id="one"><p>' || p_type || '</p></div><div role="tabpanel" id="two" style="display:block" class="active show">Made by ' || p_brand || ' since long ago</div>'
 || case when p_size % 3 = 0 then '<div class="tabpane x active show" id="three"><b>Size</b> ' || p_size || '</div>' else '' end || '</body></html>' as html from part where p_size % 5 > 0
 union all select p_partkey, '<html><body><h1>' || p_name || '</h1><div class="tab-pane" id="one"><p>' || p_type || '</p></div><div role="tabpanel" id="two" style="display:none">-</div></body></html>' from part where p_size % 5 = 0""")
def merge_tabs(spark, sf_dir):
    """Pages with the panes that snapshots of their tabs show; a fifth has no snapshots."""
    p = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK)
    shape = lambda one, two, more="''": F.expr(_TABS.format(one=one, two=two, more=more))
    own = "concat('<p>', p_type, '</p>')"
    base = p.select(F.col("p_partkey").alias("page_id"), shape(own, "'-'").alias("html"))
    third = "case when p_size % 3 = 0 then concat('<div class=\"tabpane x\" id=\"three\"><b>Size</b> ', p_size, '</div>') else '' end"
    clicked = p.where("p_size % 5 > 0")
    seen = [shape("'x'", "concat('Made by ', p_brand)"), shape("''", "concat('Made by ', p_brand, ' since long ago')", third), shape(own, "concat('Made by ', p_brand, ' since LONG ago')")]
    snapshots = clicked.select(F.col("p_partkey").alias("page_id"), F.posexplode(F.array(*seen)).alias("seq", "html"))
    return with_panes(base, snapshots).select("page_id", "html")


@query("""select format('{:s}{:04d}', 'BK', row_number() over (order by s_suppkey)) as id, s_name, s_acctbal from (select s_suppkey, s_name, case when s_suppkey % 4 > 0 then cast(s_acctbal as varchar) end as s_acctbal from supplier)""")
def workbook_items(spark, sf_dir):
    """Rows written to a workbook and read back from all its sheets in several parts, numbered as they stand there."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal").cast("string")).alias("s_acctbal")).orderBy("s_suppkey")
    path = f"{shared.local(shared.fresh(spark, 'workbook'))}.xlsx"
    WorkbookSink(path).write(rows)
    workbook.register(spark)
    read = spark.read.format("workbook").options(sheet="*", rows=40).load(path)
    numbered = evaluation.numbered(read, [F.col("s_suppkey").cast("long")])
    return numbered.select(F.format_string("BK%04d", "number").alias("id"), "s_name", F.nullif("s_acctbal", F.lit("")).alias("s_acctbal"))


_EVENT = "case event_type when 'click' then 'run' when 'view' then 'complete' when 'purchase' then 'cancel' else 'rerun' end"


@query(f"""with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as k, {_EVENT} as event from events),
s(user_id, k, status, refused) as (select distinct user_id, cast(0 as bigint), 'created', 0 from events
 union all select s.user_id, e.k, case when event = 'run' and status in ('created', 'validating', 'queued') then 'running' when event = 'rerun' and status <> 'running' then 'running' when event = 'cancel' and status in ('created', 'validating', 'queued', 'running') then 'cancelled' when event = 'complete' and status = 'running' then 'completed' else status end,
 refused + case when event = 'run' and status in ('created', 'validating', 'queued') then 0 when event = 'rerun' and status <> 'running' then 0 when event = 'cancel' then 0 when event = 'complete' and status = 'running' then 0 else 1 end
 from s join e on e.user_id = s.user_id and e.k = s.k + 1)
select user_id as id, arg_max(status, k) as status, max(refused) as refused from s group by 1""")
def job_states(spark, sf_dir):
    """The states of jobs after their events, and how many events were refused."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.expr(_EVENT).alias("event"))
    return jobs.replayed(e.select("id").distinct().withColumn("status", F.lit("created")), e)


@query("""select p_partkey, case when p_size % 5 = 0 then 'name must not be empty' when p_size % 5 = 1 then 'urls must not be empty' when p_size % 5 = 2 then 'urls has 1 empty entries' when p_size % 5 = 3 then 'status is unknown: lost' else '' end as reason,
 coalesce(nullif(trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', '_', 'g'), '_'), ''), 'extraction_job') || '.csv' as file from part""")
def invalid_jobs(spark, sf_dir):
    """Why a job can't be, and the file that it would be written to."""
    k = F.col("p_size") % 5
    t = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(k == 0, " ").otherwise(F.col("p_name")).alias("name"), F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("http://a"), F.lit(" "))).otherwise(F.array(F.lit("http://a"))).alias("urls"), F.when(k == 3, "lost").otherwise("created").alias("status"))
    return t.select("p_partkey", F.coalesce(jobs.invalid(t), F.lit("")).alias("reason"), jobs.file_name(F.col("p_name"), F.lit(".csv")).alias("file"))


@query("""select s_suppkey, s_name from supplier where s_suppkey % 2 = 0""")
def taken_names(spark, sf_dir):
    """New names that a saved one already has."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return jobs.taken_names(s, s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("  "), F.upper("name")).alias("name"))).select("s_suppkey", F.col("name").alias("s_name"))


@query("""select o_orderstatus as status, count(*) as jobs, count(*) filter (where o_totalprice > 100000) as large from orders group by 1""")
def dashboard_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("jobs"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("""select doc_id, k - 1 as idx, coalesce(lag(case when head then x end ignore nulls) over (partition by doc_id order by k), '') as heading from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as k from documents) t, lateral (select length(x) < 60 and not contains(x, '. ') as head)""")
def heading_above(spark, sf_dir):
    """The heading that each line of a document stands under."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "x"))
    head = F.when((F.length("x") < 60) & ~F.col("x").contains(". "), F.col("x"))
    above = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    return d.select("doc_id", "idx", F.coalesce(F.last(head, ignorenulls=True).over(above), F.lit("")).alias("heading"))


@query("""with p as (select page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1)) as href from pages)
select page_id, href, count(*) as n from p group by 1, 2""")
def distinct_links(spark, sf_dir):
    """Links of parsed pages, each with how often its page has it."""
    from .page_queries import html_of

    p = exploded(pages_with(html_of(spark, sf_dir), want=["links"]), ["page_id"], "page.links", "idx", "a")
    return p.groupBy("page_id", F.col("a.href").alias("href")).agg(F.count("*").alias("n"))
