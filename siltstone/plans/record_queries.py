"""Queries over records: what a page bears out, quality, pieces, model answers, schemas.

The tables have no listings, so that pages and records are put together from columns, the same way in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence, text, validate
from . import answers, dataset, evaluation, fields, mapping, pieces, prompts, records
from .registry import ROWS_A_TASK, query, spread, table
from .run_queries import stated_facts
from .scalar_queries import AREA, MONEY
from .schema import Field, Schema

PAGE = """concat('Acme ', p_brand, ' since ', 1980 + p_size, '. Call +91-98765-', 10000 + p_partkey % 89999, '. Area ', p_size * 10, ' - ', p_size * 20,
 ' sq ft. Payback ', p_size, ' month. Fee Rs. ', p_size, ' Lakhs. Office: 12, ', p_name, ' Street. Mail a', p_partkey, '@x.in')"""
VALUES = {
    "phone": "case p_size % 5 when 0 then concat('(98765) ', 10000 + p_partkey % 89999) when 1 then concat('9198765', 10000 + p_partkey % 89999) when 2 then '12345' when 3 then null else '+91 11111 22222' end",
    "email": "case p_size % 3 when 0 then concat('A', p_partkey, '@X.in') when 1 then 'b@y.in' end",
    "established_year": "case p_size % 3 when 0 then concat('Est. ', 1980 + p_size) when 1 then 'Since 1801' else concat(p_size, ' now') end",
    "payback_period": "case p_size % 3 when 0 then concat(p_size, ' months') when 1 then '999 months' else 'Soon enough' end",
    "area_required": "case p_size % 3 when 0 then concat(p_size * 10, '-', p_size * 20, ' Sq.ft') when 1 then '77777 sq ft' else 'Any street' end",
    "address": "case p_size % 2 when 0 then concat('12 ', upper(p_name), ' STREET') else 'Nowhere, zz' end",
    "brand": "case p_size % 4 when 0 then p_brand when 1 then 'Zedless' when 2 then 'N/A' end",
    "website": "case p_size % 3 when 0 then 'https://www.Acme.com/' when 1 then 'http://other.org' else '' end",
}


def _in(words: str, hay: str) -> str:
    return f"len(list_filter({words}, lambda x: contains({hay}, x))) > 0"


_BARE = "regexp_replace(regexp_replace(lower({}), '(?:₹|\\$|rs\\.?|inr|usd|lakhs?|crores?|cr|thousand|million|k)', '', 'g'), '[\\s-]+', '', 'g')"
_NUMBERS = "regexp_extract_all({}, '\\d+')"
_MONTHS = "case when regexp_extract({0}, '\\d+(?:\\.\\d+)?') = '' then null when contains({0}, 'year') or contains({0}, 'yr') then cast(regexp_extract({0}, '\\d+(?:\\.\\d+)?') as double) * 12 when contains({0}, 'mo') then cast(regexp_extract({0}, '\\d+(?:\\.\\d+)?') as double) when contains({0}, 'day') then cast(regexp_extract({0}, '\\d+(?:\\.\\d+)?') as double) / 30 end"
_REST = f"""case when {{0}} in ('yes', 'no', 'true', 'false', 'n/a', 'none', 'null') or (length({{0}}) < 3 and regexp_matches({{0}}, '^[a-z]+$')) then true
 when {_BARE.format("{0}")} <> '' and contains(bare, {_BARE.format("{0}")}) then true
 when len({_NUMBERS.format("{0}")}) > 0 and contains(digits, array_to_string({_NUMBERS.format("{0}")}, '')) then true
 when len({_NUMBERS.format("{0}")}) > 0 and not ({_in(_NUMBERS.format("{0}"), "page")}) then false
 when len(list_filter(regexp_extract_all({{0}}, '[a-z0-9]{{{{3,}}}}'), lambda x: x not in ('lakh', 'lakhs', 'crore', 'crores', 'cr', 'percent', 'rs', 'inr', 'usd', 'franchise'))) = 0 then true
 else {_in("list_filter(regexp_extract_all({0}, '[a-z0-9]{{3,}}'), lambda x: x not in ('lakh', 'lakhs', 'crore', 'crores', 'cr', 'percent', 'rs', 'inr', 'usd', 'franchise'))", "page")} end"""
_OWN = {
    "phone": "length(regexp_replace({0}, '\\D', '', 'g')) >= 7 and (contains(digits, regexp_replace({0}, '\\D', '', 'g')) or (starts_with(regexp_replace({0}, '\\D', '', 'g'), '91') and length(regexp_replace({0}, '\\D', '', 'g')) > 10 and contains(digits, substr(regexp_replace({0}, '\\D', '', 'g'), 3))))",
    "email": "contains(page, {0})",
    "established_year": f"case when len(regexp_extract_all({{0}}, '\\b\\d{{{{4}}}}\\b')) > 0 then {_in("regexp_extract_all({0}, '\\b\\d{{4}}\\b')", "page")} when len({_NUMBERS.format("{0}")}) > 0 then {_in(_NUMBERS.format("{0}"), "page")} else {_REST} end",
    "payback_period": f"coalesce(abs({_MONTHS} - p_size) < 0.1, false) or {_in(_NUMBERS.format("{0}"), "page")} or {_in("list_filter(string_split({0}, ' '), lambda x: length(x) > 3)", "page")}",
    "area_required": f"(len({_NUMBERS.format("{0}")}) > 0 and contains(digits, array_to_string({_NUMBERS.format("{0}")}, ''))) or {_REST}",
    "address": f"contains(regexp_replace(page, '\\W+', '', 'g'), regexp_replace({{0}}, '\\W+', '', 'g')) or {_REST}",
    "brand": _REST,
    "website": "contains('acme.com/about', trim(regexp_replace({0}, 'https://|http://|www\\.', '', 'g'), '/')) or contains(page, trim(regexp_replace({0}, 'https://|http://|www\\.', '', 'g'), '/'))",
}
_PAGES_SQL = f"""p as (select *, lower({PAGE}) as page from part),
q as (select *, regexp_replace(page, '\\D', '', 'g') as digits, {_BARE.format("page")} as bare, {", ".join(f"{v} as {f}" for f, v in VALUES.items())} from p)"""


def _told_sql(f: str) -> str:
    return f"case when {f} is null or {f} = '' then true else ({_OWN[f].format(f'lower(trim({f}))')}) end"


def _listings(spark, sf_dir):
    t = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK)
    kept = t.select("p_partkey", F.expr(PAGE).alias("text"), *[F.expr(v).alias(f) for f, v in VALUES.items()])
    on = evidence.page(F.col("text"), F.array(F.lit("https://acme.com/About/"), F.lit("#top"), F.lit("mailto:a@b.c")), F.array(F.lit("/logo.png")))
    return kept.select("p_partkey", on.alias("evidence"), *VALUES)


@query(f"with {_PAGES_SQL} select p_partkey, {', '.join(f'{_told_sql(f)} as {f}' for f in VALUES)} from q")
def value_in_dom(spark, sf_dir):
    """Whether each value of a record stands on its page."""
    return _listings(spark, sf_dir).select("p_partkey", *[evidence.borne_out(f, F.col(f), F.col("evidence")).alias(f) for f in VALUES])


_JUDGED = ("phone", "email", "brand", "area_required", "website")
_MISSED = {"phone": "true", "email": "true", "brand": "regexp_matches(page, 'brand|trademark|name')", "area_required": "true", "website": "true"}
_STATUS = {f: f"case when {f} is null or trim({f}) = '' then case when {_MISSED[f]} then 'Likely Missed' else 'Missing on Page' end when {_told_sql(f)} then 'Extracted Successfully' else 'Possible Hallucination' end" for f in _JUDGED}
_ODD = [
    "case when email is not null and not regexp_matches(trim(email), '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$') then 1 else 0 end",
    "case when phone is not null and length(regexp_replace(phone, '\\D', '', 'g')) not between 7 and 15 then 1 else 0 end",
    "case when area_required is not null and not regexp_matches(area_required, '\\d') then 1 else 0 end",
    "case when website <> '' and not regexp_matches(website, '^(https?://)?([a-zA-Z0-9-]+\\.)+[a-zA-Z0-9-]+(/.*)?$') then 1 else 0 end",
]
_EVALUATED_SQL = f"""with {_PAGES_SQL},
s as (select p_partkey, brand as b, email as e, {", ".join(f"{v} as {f}" for f, v in _STATUS.items())}, {" + ".join(_ODD)} as odd from q),
n as (select *, {" + ".join(f"cast({f} = 'Extracted Successfully' as int)" for f in _JUDGED)} as found, {" + ".join(f"cast({f} = 'Possible Hallucination' as int)" for f in _JUDGED)} as invented,
 {" + ".join(f"cast({f} = 'Likely Missed' as int)" for f in _JUDGED)} as missed, {" + ".join(f"cast({f} = 'Likely Missed' as int)" for f in _JUDGED if f in evaluation.CRITICAL)} as critical_missed,
 {" + ".join(f"cast({f} = 'Missing on Page' as int)" for f in _JUDGED if f in evaluation.CRITICAL)} as critical_absent, (cast(coalesce(b, '') <> '' as int) + cast(coalesce(e, '') <> '' as int)) * 50.0 as required from s),
v as (select *, greatest(1, found + missed) as present, greatest(0, 100 - 15 * missed - 25 * invented) as page_score, greatest(0, 100 - 10 * odd) as valid from n)"""


def _evaluated(spark, sf_dir):
    return evaluation.evaluated(_listings(spark, sf_dir).select("p_partkey", "evidence", *_JUDGED), fields=_JUDGED, required=("brand", "email"))


@query(f"{_EVALUATED_SQL} select p_partkey, {', '.join(_JUDGED)}, odd from v")
def field_statuses(spark, sf_dir):
    """The status of each field of a record: found, invented, missed or not on the page."""
    return _evaluated(spark, sf_dir).select("p_partkey", *[F.col("statuses")[f].alias(f) for f in _JUDGED], F.size("odd").alias("odd"))


@query(f"{_EVALUATED_SQL} select p_partkey, found || ' / ' || present as coverage, cast(page_score as double) as page_score, round(greatest(0, least(100, found / present * 100 * 0.3 + page_score * 0.3 + required * 0.2 + valid * 0.2 - 15 * invented - 10 * critical_missed - 3 * critical_absent)), 6) as score from v")
def quality_score(spark, sf_dir):
    """The score of a record, of what was measured."""
    return _evaluated(spark, sf_dir).select("p_partkey", "coverage", "page_score", F.round("score", 6).alias("score"))


@query(f"""{_EVALUATED_SQL}, c as (select unnest([{", ".join(_JUDGED)}]) as status from v) select status, count(*) as n from c group by status""")
def status_counts(spark, sf_dir):
    return _evaluated(spark, sf_dir).select(F.explode(F.map_values("statuses")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""{_EVALUATED_SQL} select '2024-01-01 00:00:00' as timestamp, 'http://x/' || p_partkey as url, found || ' / ' || present as coverage, printf('%.1f%%', cast(page_score as double)) as dom_match, invented as hallucinations,
 coalesce(nullif(array_to_string(list_filter([{", ".join(f"case when {f} in ('Likely Missed', 'Missing on Page') then '{f}' end" for f in ("phone", "email", "area_required", "website"))}], lambda x: x is not null), ', '), ''), 'None') as critical, '0.00' as execution_time_sec, 0 as token_count from v""")
def quality_log(spark, sf_dir):
    done = _evaluated(spark, sf_dir).withColumn("source_url", F.concat(F.lit("http://x/"), "p_partkey"))
    log = evaluation.quality_log(done, now="2024-01-01 00:00:00")
    critical = F.transform(F.split("critical_fields_missing", ", "), lambda f: f)
    order = F.array(*[F.lit(f) for f in ("phone", "email", "area_required", "website", "None")])
    return log.select("timestamp", "url", "coverage", "dom_match", "hallucinations", F.array_join(F.array_intersect(order, critical), ", ").alias("critical"), "execution_time_sec", "token_count")


@query("""select 'FAQ' || lpad(cast(row_number() over (order by n_name) as varchar), 4, '0') as id, '{"n_name":"' || n_name || '"' || case when n_regionkey = 1 then '' else ',"region":"' || n_regionkey || '"' end || '}' as item from nation where n_nationkey % 3 <> 0 or n_regionkey <> 1""")
def benchmark_items(spark, sf_dir):
    """Rows of a sheet as numbered items, without empty cells and rows."""
    named = (F.col("n_nationkey") % 3 != 0) | (F.col("n_regionkey") != 1)
    n = table(spark, sf_dir, "nation").select(F.when(named, F.col("n_name")).alias("n_name"), F.when(F.col("n_regionkey") == 1, " ").otherwise(F.col("n_regionkey").cast("string")).alias("region"))
    return evaluation.benchmark_items(n, "faq", ["n_name"])


@query("""with t as (select conv_id, list(text order by turn) as l, count(*) as parts from conversations group by conv_id)
select conv_id, list_reduce(l, lambda a, x: case when trim(x) = '' or contains(a, trim(x)) then a else a || chr(10) || x end) as page_summary, l[1] as page_title, parts from t""")
def merge_chunk_results(spark, sf_dir):
    """Records of a page's pieces as one: summaries append, titles stand as first said."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("page_summary"), F.col("text").alias("page_title"), F.array(F.col("turn").cast("string")).alias("turns"))
    return pieces.merged_records(c, ["conv_id"], "turn").select("conv_id", "page_summary", "page_title", F.size("turns").cast("long").alias("parts"))


@query("""with e as (select l_orderkey, l_linenumber as seq, case when l_returnflag = 'N' then 'Franchise Opportunity' else 'Company ' || l_returnflag end as entity_type, l_linestatus || '/' || (l_suppkey % 4) as form, l_linestatus as st, l_suppkey % 4 as mode from lineitem),
d as (select l_orderkey, entity_type, form, st, mode, min(seq) as seq from e group by all), g as (select l_orderkey, max(cast(entity_type <> 'Franchise Opportunity' as int)) as generic, min(seq) as first from d group by 1)
select d.l_orderkey as l_orderkey, entity_type, count(*) filter (where generic = 1 or seq = first) as records, coalesce(string_agg(form, ' ' order by seq, mode, st) filter (where generic = 1 or seq = first), '') as forms from d join g on d.l_orderkey = g.l_orderkey group by 1, 2""")
def merge_chunk_entities(spark, sf_dir):
    """Entity records of a page's pieces, each once for its type."""
    kind = F.when(F.col("l_returnflag") == "N", pieces.PLAIN_ENTITY).otherwise(F.concat(F.lit("Company "), "l_returnflag"))
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq"), F.lit(0).alias("idx"), kind.alias("entity_type"), F.create_map(F.lit("status"), "l_linestatus", F.lit("mode"), (F.col("l_suppkey") % 4).cast("string")).alias("attributes"))
    done = pieces.merged_entities(e, ["l_orderkey"])
    return done.select("l_orderkey", "entity_type", F.size("records").cast("long").alias("records"), F.array_join(F.transform("records", lambda r: F.concat(r["status"], F.lit("/"), r["mode"])), " ").alias("forms"))


@query("""with recursive l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) as k, cast(l_quantity as bigint) as n from lineitem),
b(l_orderkey, k, n, used, batch) as (select l_orderkey, k, n, n, 0 from l where k = 1
 union all select l.l_orderkey, l.k, l.n, case when b.used + l.n <= 60 then b.used + l.n else l.n end, case when b.used + l.n <= 60 then b.batch else b.batch + 1 end from b join l on l.l_orderkey = b.l_orderkey and l.k = b.k + 1)
select l_orderkey, k - 1 as idx, n, batch from b""")
def chunk_batches(spark, sf_dir):
    """Sizes in order packed into batches of at most 60."""
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("n")))).alias("l"))
    sizes = held.select("l_orderkey", F.transform("l", lambda x: x["n"]).alias("sizes"))
    both = sizes.select("l_orderkey", F.posexplode(F.arrays_zip("sizes", pieces.batches(F.col("sizes"), 60).alias("batch"))).alias("idx", "x"))
    return both.select("l_orderkey", "idx", F.col("x.sizes").alias("n"), F.col("x.batch").alias("batch"))


RAW = """case p_size % 5 when 0 then concat('```json\n{"k": ', p_size, ', }\n```') when 1 then '{"a": ["x", "y' when 2 then '{"a": {"b": 1' when 3 then '{"a": 1, "b": [1, 2, ], }' else null end"""


@query("""select p_partkey, case p_size % 5 when 0 then '{"k": ' || p_size || '}' when 1 then '{"a": ["x", "y"]}' when 2 then '{"a": {"b": 1}}' when 3 then '{"a": 1, "b": [1, 2]}' end as answer from part""")
def repair_json(spark, sf_dir):
    """Answers of a model as JSON that parses."""
    t = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK).select("p_partkey", F.expr(RAW.replace("\n{", "\\n{").replace("\n`", "\\n`")).alias("raw"))
    return t.select("p_partkey", answers.repaired_json(F.col("raw")).alias("answer"))


ANSWER = """case p_size % 4 when 0 then concat('{"name": "', p_brand, '", "outlets": "12", "fee": {"min": 1, "max": 2}, "open": "yes", "items": "a, b"}')
 when 1 then concat('{"name": ["', p_brand, '", "x"], "outlets": 3.0, "items": ["a"], "other": 1}') when 2 then '{"outlets": "many", "open": false, "fee": {"a": 1, "b": "c"}}' else 'no json' end"""
ASKED = Schema("asked", (Field("name"), Field("outlets", "integer"), Field("fee"), Field("open", "boolean"), Field("items", "array")))


@query("""select p_partkey, case p_size % 4 when 0 then p_brand when 1 then p_brand || ', x' end as name, case p_size % 4 when 0 then 12 when 1 then 3 end as outlets, case p_size % 4 when 0 then '1 - 2' when 2 then 'a: 1, b: c' end as fee,
 case p_size % 4 when 0 then true when 2 then false end as open, case p_size % 4 when 0 then 'a|b' when 1 then 'a' end as items, p_size % 4 = 3 as broken from part""")
def coerce_to_schema(spark, sf_dir):
    """Answers in the types of a schema; what can't be is null."""
    t = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK).select("p_partkey", F.expr(ANSWER).alias("raw"))
    done = t.withColumn("a", records.typed(records.coerced_json(F.col("raw"), ASKED), ASKED))
    return done.select("p_partkey", "a.name", "a.outlets", "a.fee", "a.open", F.array_join("a.items", "|").alias("items"), F.col("a").isNull().alias("broken"))


@query("""select p_partkey, case p_size % 4 when 1 then 'other' else '' end as unexpected from part where p_size % 4 <> 3""")
def unexpected_keys(spark, sf_dir):
    t = table(spark, sf_dir, "part").where("p_size % 4 <> 3").select("p_partkey", F.expr(ANSWER).alias("raw"))
    return t.select("p_partkey", F.array_join(records.unexpected(F.col("raw"), ASKED), ",").alias("unexpected"))


@query("""select p_partkey, case when p_size % 3 = 0 then p_brand when p_size % 3 = 1 then p_type else null end as value from part""")
def alias_resolution(spark, sf_dir):
    """A value under a field's own name, or else under an alias."""
    found = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("area_required"), "p_brand", F.lit("space_required"), "p_type")).when(F.col("p_size") % 3 == 1, F.create_map(F.lit("space_required"), "p_type")).otherwise(F.create_map(F.lit("other"), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", fields.resolved("Area Required", ["space-required"], found).alias("value"))


_PAIRS = [("franchise_name", "Franchise Name"), ("phone", "Phone"), ("investment", "Investment Required"), ("contact", "Contact Person"), ("total", "Total Area Sold"), ("roi", "Email"), ("franchise_fee", "franchise fee")]
_TOLD = [(0.95, "Alias Match"), (1.0, "Exact Match"), (0.8, "Normalized Match"), (0.8, "Normalized Match"), (0.6, "Fuzzy Match"), (0.0, "No Match"), (0.95, "Alias Match")]
_PAIRS_SQL = ", ".join(f"('{f}', '{c}', {s}, '{m}')" for (f, c), (s, m) in zip(_PAIRS, _TOLD, strict=True))


@query(f"select n_nationkey, field, col as \"column\", score, kind from nation cross join (values {_PAIRS_SQL}) t(field, col, score, kind)")
def column_confidence(spark, sf_dir):
    """How surely a field belongs to a column: decided when the plan is made."""
    known = mapping.Aliases([f for f, _ in _PAIRS])
    told = [F.struct(F.lit(f).alias("field"), F.lit(c).alias("column"), F.lit(float(known.confidence(f, c)[0])).alias("score"), F.lit(known.confidence(f, c)[1]).alias("kind")) for f, c in _PAIRS]
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*told)).alias("t")).select("n_nationkey", "t.*")


@query("""select p_partkey, case p_size % 4 when 0 then 'Franchise Name' when 1 then 'Investment Required' when 2 then 'Phone' end as "column" from part""")
def field_to_column(spark, sf_dir):
    known = mapping.Aliases(["franchise_name", "investment_required", "phone"], {"phone": ["mobile"]})
    columns = ["Franchise Name", "Investment Required", "Phone"]
    name = F.element_at(F.array(F.lit("franchise_name"), F.lit("investment"), F.lit("mobile"), F.lit("colour")), F.col("p_size") % 4 + 1)
    home = F.create_map(*[F.lit(x) for f in ("franchise_name", "investment", "mobile", "colour") for x in (f, known.column_for(f, columns)[0])])
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(home, name).alias("column"))


@query(f"""with t as (select p_partkey, {MONEY} as t, replace(lower({MONEY}), ',', '') as l, {AREA} as a from part),
n as (select *, list_transform(regexp_extract_all(l, '\\d+(?:\\.\\d+)?'), lambda x: trunc(cast(x as double) *
  case when contains(l, 'lakh') then 100000.0 when contains(l, 'cr') then 10000000.0 when contains(l, 'million') then 1000000.0 when contains(l, 'k') then 1000.0 else 1.0 end)) as v,
  regexp_matches(l, 'upto|up to|max|below|less than') as most, list_transform(regexp_extract_all(a, '\\d+'), lambda x: cast(x as double)) as r from t)
select p_partkey, case when len(v) >= 2 or (len(v) = 1 and not most) then v[1] end as investment_min, case when len(v) >= 2 then v[2] when len(v) = 1 and most then v[1] end as investment_max, r[1] as area_min, r[2] as area_max from n""")
def derive_ranges(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(MONEY).alias("investment_required"), F.expr(AREA).alias("area_required"))
    return validate.ranges(t).select("p_partkey", "investment_min", "investment_max", "area_min", "area_max")


@query("""select event_id, k as key, json_extract_string(props, '$.' || k) as value from (select event_id, props, unnest(json_keys(props)) as k from events) where lower(k) <> 'k'""")
def unmapped_fields(spark, sf_dir):
    """Raw keys that no column has."""
    e = table(spark, sf_dir, "events").select("event_id", F.posexplode(F.expr("from_json(props, 'map<string,string>')")).alias("seq", "key", "value"))
    return mapping.unmatched(e, {"K": "Count"}).select("event_id", "key", "value")


@query("""select c_custkey, count(*) over (partition by lower(trim(c_mktsegment)), c_nationkey) as n from customer""")
def duplicate_detect(spark, sf_dir):
    """How many rows have a row's key."""
    c = table(spark, sf_dir, "customer").withColumn("_key", dataset.key_of(["c_mktsegment", "c_nationkey"]))
    counted = c.groupBy(F.col("_key").alias("_of")).agg(F.count("*").alias("n"))
    return c.join(counted, F.col("_key") == F.col("_of")).select("c_custkey", "n")


@query("""select c_name, c_custkey as seq, '2021' as extraction_date, 'Inserted' as operation from customer where c_custkey % 2 = 0 union all select c_name, c_custkey, '2020', 'Unchanged' from customer where c_custkey % 2 = 1""")
def append_dataset(spark, sf_dir):
    """Without a key, every row is new."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), "c_name")
    old = c.where("seq % 2 = 1").withColumns({"extraction_date": F.lit("2020"), "last_updated": F.lit("2020")})
    return dataset.upserted(old, c.where("seq % 2 = 0"), [], now="2021").select("c_name", "seq", "extraction_date", "operation")


@query("""select p_partkey, array_to_string(list_filter([case when p_size % 3 = 0 then 'name' end, case when p_size % 5 = 0 then 'kind' end], lambda x: x is not null), ',') as missing from part where p_size % 3 = 0 or p_size % 5 = 0""")
def quarantine(spark, sf_dir):
    """Rows without what is required, and what they lack."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("kind"))
    return dataset.split_valid(p, ["name", "kind"])[1].select("p_partkey", F.array_join("missing", ",").alias("missing"))


@query("""select p_partkey, case when p_size % 3 = 0 then 'Brand=' || p_brand || '|Kind Of Part=' || p_type when p_size % 3 = 1 then '' else '' end as pairs from part""")
def label_value_pairs(spark, sf_dir):
    said = F.expr("case p_size % 3 when 0 then concat('Brand: ', p_brand, '\n\n  Kind Of Part :  ', p_type) when 1 then concat('Brand: ', p_brand) else concat('Brand: ', p_brand, '\nand prose') end".replace("\n", "\\n"))
    pairs = text.label_pairs(said)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "|").alias("pairs"))


_BLOCK = "struct<type:string,text:string>"


def _line_blocks(spark, sf_dir):
    """Documents as blocks: a short line without a full stop is a heading, others are paragraphs."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    head = lambda x: (F.length(x) < 60) & ~x.contains(". ")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in prompts.BLOCKS.elementType.fields}
    made = lambda x: F.struct(*[(F.when(head(x), "heading").otherwise("paragraph") if n == "type" else x if n == "text" else v).alias(n) for n, v in empty.items()])
    return d.select("doc_id", F.transform("lines", made).alias("blocks"))


@query("""with recursive b as (select doc_id, k, length(x) < 60 and not contains(x, '. ') as head, 15 * (cast(contains(lower(x), 'the') as int) + cast(contains(lower(x), 'and') as int)) as words
 from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents)),
s(doc_id, k, score, lifts, lifted) as (select doc_id, k, case when head then 15 else 0 end + words, head and words > 0, false from b where k = 1
 union all select b.doc_id, b.k, case when b.head then 15 else 0 end + b.words + case when s.lifts then 8 else 0 end + case when s.lifted then 8 else 0 end,
  b.head and b.words + case when s.lifts then 8 else 0 end + case when s.lifted then 8 else 0 end > 0, s.lifts from s join b on b.doc_id = s.doc_id and b.k = s.k + 1)
select doc_id, k - 1 as idx, cast(score as double) as score from s""")
def block_scores(spark, sf_dir):
    """The score of each block for a model's prompt, with what headings lend to the blocks below, and these to others."""
    scored = _line_blocks(spark, sf_dir).select("doc_id", prompts.block_scores(F.col("blocks"), {"the", "and"}).alias("s"))
    return scored.select("doc_id", F.posexplode_outer("s").alias("idx", "score")).where("idx is not null")


@query()
def select_blocks_budget(spark, sf_dir):
    """The blocks that fit the budget of a prompt."""
    return _line_blocks(spark, sf_dir).select("doc_id", F.array_join(prompts.chosen_blocks(F.col("blocks"), {"the", "and"}), ",").alias("chosen"))


_FIELDS_ASKED = Schema("p", (Field("brand", description="Who makes it", aliases=("maker", "Brand")), Field("parts", "array"), Field("phone")))


@query("""select p_partkey, '## Task' || chr(10) || 'Fill the fields below from the page. Answer with one JSON object and nothing else.' || chr(10) || chr(10) || '## Page' || chr(10) || p_brand || chr(10) || 'http://x/' || p_partkey || chr(10) || chr(10) || '## Fields' || chr(10)
 || '- brand (string): Who makes it [also: maker]' || chr(10) || '- parts (array)' || chr(10) || chr(10) || '## Known' || chr(10) || 'phone' || chr(10) || chr(10) || '## Rules' || chr(10) || 'Use null for what the page does not say. Do not guess. Copy values as they stand.' || chr(10) || chr(10)
 || '## Content' || chr(10) || '[{"type": "paragraph", "text": "' || p_name || '"}]' || chr(10) || chr(10) || '## Answer' || chr(10) || '{"brand": ..., "parts": ...}' as prompt from part""")
def build_prompt(spark, sf_dir):
    """What a model is asked: only what the page itself has not given."""
    empty = {f.name: F.lit(None).cast(f.dataType) for f in prompts.BLOCKS.elementType.fields}
    blocks = F.array(F.struct(*[(F.lit("paragraph") if n == "type" else F.col("p_name") if n == "text" else v).alias(n) for n, v in empty.items()]))
    p = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK).select("p_partkey", "p_brand", "p_name")
    return p.select("p_partkey", prompts.prompts(F.concat(F.lit("http://x/"), "p_partkey"), F.col("p_brand"), F.array(F.lit("phone")), blocks, _FIELDS_ASKED).alias("prompt"))


@query("""select p_partkey, case when p_size % 3 = 0 then p_brand when p_size % 3 = 1 then p_name else 'http://x/' || p_partkey end as page_title,
 case when p_size % 2 = 0 then 'https://a.b/?k=1|5' else '' end as bag, case when p_size % 2 = 0 then '• Q: q? A: ' || p_size || chr(10) || '• k: v' else '5' end as cell from part""")
def record_fallbacks(spark, sf_dir):
    """Titles of last resort, overflow without what is empty, values as cells show them."""
    t = spread(table(spark, sf_dir, "part"), rows=ROWS_A_TASK).select("p_partkey", "p_size", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise("").alias("page_title"), F.concat(F.lit("http://x/"), "p_partkey").alias("source_url"))
    bag = F.when(F.col("p_size") % 2 == 0, F.lit('{"a": " https://a.b/?utm_x=1&k=1 ", "b": {"c": "", "d": []}, "n": 5, "Known Key": "x", "": 1}')).otherwise(F.lit('{"a": null, "known_key": 7}'))
    cell = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('[{"question": "q?", "answer": "'), "p_size", F.lit('"}, {"key": "k", "value": "v"}]'))).otherwise(F.lit("5.0"))
    done = records.with_generic_fallbacks(t).select("p_partkey", "page_title", F.from_json(records.clean_json(bag, frozenset(["known key"])), "map<string,string>").alias("m"), records.json_text(cell).alias("cell"))
    return done.select("p_partkey", "page_title", F.coalesce(F.array_join(F.map_values("m"), "|"), F.lit("")).alias("bag"), "cell")


@query("""select p_partkey, coalesce(case when p_size % 2 = 0 then p_brand end, case when p_size % 3 = 0 then p_type end) as franchise_name, case when p_size % 3 = 0 then '5 Lakhs' end as investment_required,
 case when p_size % 3 = 0 then 'Company:2' when p_size % 2 = 0 then 'Franchise Opportunity:1' else '' end as entities, coalesce(case when p_size % 2 = 0 then p_brand end, case when p_size % 3 = 0 then p_type end, 'Franchise Opportunity') as page_title from part""")
def entity_fallbacks(spark, sf_dir):
    """Flat fields from entities, and an entity from flat fields."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    entity = F.array(F.struct(F.lit("Company").alias("entity_type"), F.array(F.struct(F.array(pair("franchise_name", F.col("p_type")), pair("investment", F.lit("5 Lakhs"))).alias("attributes"))).alias("records")))
    t = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("franchise_name"), F.lit(None).cast("string").alias("investment_required"), F.when(F.col("p_size") % 3 == 0, entity).cast(records.ENTITIES).alias("entities"))
    done = records.with_entity_fallbacks(t)
    shown = F.transform("entities", lambda e: F.concat(e["entity_type"], F.lit(":"), F.size(F.get(e["records"], F.lit(0))["attributes"]).cast("string")))
    return done.select("p_partkey", "franchise_name", "investment_required", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("entities"), "page_title")


@query("""select p_partkey, case p_size % 6 when 0 then 'Invalid email format: ''no mail''' when 1 then 'Phone number digit count is unusual (expected 7-15 digits): ''12''' when 2 then 'Investment value lacks numeric figures: ''Moderate'''
 when 3 then 'ROI value lacks expected percentage symbol (%) or return indicators: ''about 5''' when 4 then 'Field ''established_year'' is not a valid date format (YYYY-MM-DD or YYYY): ''long ago''' else '' end as odd from part""")
def odd_values(spark, sf_dir):
    """What a person should look at: values of an odd shape, in words."""
    value = {"email": (0, "no mail"), "phone": (1, "12"), "investment_required": (2, "Moderate"), "roi": (3, "about 5"), "established_year": (4, "long ago")}
    good = {"email": "a@b.c", "phone": "+91 98765 43210", "investment_required": "₹5 Lakhs", "roi": "5%", "established_year": "since 1999"}
    told = [evidence.odd(f, F.when(F.col("p_size") % 6 == k, F.lit(v)).otherwise(F.lit(good[f]))) for f, (k, v) in value.items()]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_compact(F.array(*told)), "; ").alias("odd"))


_OWNED = "[" + ", ".join(f"['{f}', 'hybrid']" for f in ("franchise_name", "category", "segment", "brand")) + ", " + ", ".join(f"['{f}', 'deterministic']" for f in ("logo", "logo_url", "email", "phone", "facebook", "franchise_fee", "number_of_employees")) + "]"


@query(f"""with f as (select p_partkey, unnest({_OWNED}) as x from part) select x[2] as owner, count(distinct x[1]) as fields, count(*) as stated from f group by 1""")
def owner_counts(spark, sf_dir):
    """How many fields that pages state, and how many values, fall to each owner."""
    said = stated_facts(spark, sf_dir).withColumn("owner", fields.owner(F.col("field")))
    return said.groupBy("owner").agg(F.countDistinct("field").alias("fields"), F.count("*").alias("stated"))
