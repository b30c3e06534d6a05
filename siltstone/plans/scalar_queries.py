"""Scalar functions and validation over the test tables.

The tables have no listings, so that texts in their style are put together from columns, the same way in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contact, money, text, validate
from .registry import SQL, query, spread, table

# a text of each style for every part: (Spark SQL and DuckDB agree on these expressions)
MONEY = """case p_size % 8 when 0 then concat('Rs. ', p_size, ' Lakhs - ', p_size + 25, ' Lakhs') when 1 then concat('upto ', p_size, ' Lakhs')
 when 2 then concat(p_size, '.5 Cr - ', p_size + 1, ' Cr') when 3 then concat('Above ₹', p_size, ' Lakhs') when 4 then concat('INR ', p_size, ',500')
 when 5 then concat('$', p_size, ',000') when 6 then 'Moderate' else concat(p_size, 'k to ', p_size + 5, 'k') end"""
AREA = """case p_size % 4 when 0 then concat(p_size * 10, ' - ', p_size * 20, ' sq ft') when 1 then concat(p_size, ' sqft')
 when 2 then concat('1,', p_size + 100, ' Sq.ft') else 'Spacious Room' end"""
PHONE = """case p_size % 5 when 0 then concat('98765', 10000 + p_partkey % 89999) when 1 then concat('9198765', 10000 + p_partkey % 89999)
 when 2 then concat('+91 99999-', 10000 + p_partkey % 89999) when 3 then concat(3000 + p_size, ' - ', 5000 + p_size) else concat('+91-11111-', 10000 + p_size, ', short') end"""
HOURS = "case p_size % 3 when 0 then concat(p_size, ' Hours') when 1 then concat(p_size, ' - ', p_size + 2, ' hrs/month') else concat(p_size, '') end"
NAME = "case p_size % 6 when 0 then 'Franchise Opportunity' when 1 then concat('  ', p_brand, ' ') else p_name end"
YEAR = "case p_size % 3 when 0 then concat('Established in ', 1980 + p_size) when 1 then 'Not Revealed' else concat('Since 18', p_size + 10) end"
TERM = "case p_size % 4 when 0 then concat(p_size, ' Years') when 1 then 'Yes' when 2 then concat(p_size, '.5 years') else ' Lifetime ' end"
MAIL = "case p_size % 3 when 0 then concat('Info', p_partkey, '@Brand.COM') when 1 then 'invalid_email' else concat(' a.b+', p_partkey, '@x.co.in') end"
SITE = "case p_size % 3 when 0 then concat('www.brand', p_partkey, '.com') when 1 then concat('http://b', p_partkey, '.org/') else concat('https://c', p_partkey, '.in/a/') end"
ROI = "case p_size % 3 when 0 then concat(p_size, '% - ', p_size + 10, '.5%') when 1 then 'High Return' else concat(p_size, ' percent') end"
RECORD = {
    "franchise_name": NAME,
    "established_year": YEAR,
    "agreement_duration": TERM,
    "phone": PHONE,
    "email": MAIL,
    "roi": ROI,
    "investment_required": MONEY,
    "area_required": AREA,
    "expected_hours": HOURS,
    "website": SITE,
}


def parts(spark, sf_dir, **texts):
    return table(spark, sf_dir, "part").select("p_partkey", *[F.expr(e).alias(c) for c, e in texts.items()])


@query(f"""
with t as (select p_partkey, {MONEY} as t, replace(lower({MONEY}), ',', '') as l from part),
n as (select *, list_transform(regexp_extract_all(l, '\\d+(?:\\.\\d+)?'), lambda x: cast(trunc(cast(x as double) *
  case when contains(l, 'lakh') then 100000.0 when contains(l, 'cr') then 10000000.0 when contains(l, 'million') then 1000000.0 when contains(l, 'k') then 1000.0 else 1.0 end) as bigint)) as v,
  regexp_matches(l, 'upto|up to|max|below|less than') as most from t)
select p_partkey, t as value, case when len(v) >= 2 or (len(v) = 1 and not most) then v[1] end as low,
  case when len(v) >= 2 then v[2] when len(v) = 1 and most then v[1] end as high from n
""")
def parse_investment_range(spark, sf_dir):
    t = parts(spark, sf_dir, value=MONEY)
    ends = money.investment_range(F.col("value"))
    return t.select("p_partkey", "value", ends["low"].alias("low"), ends["high"].alias("high"))


@query(f"""
with t as (select p_partkey, {AREA} as t from part),
n as (select *, list_transform(regexp_extract_all(t, '\\d+'), lambda x: cast(x as bigint)) as v from t)
select p_partkey, t as value, v[1] as low, v[2] as high from n
""")
def parse_area_range(spark, sf_dir):
    t = parts(spark, sf_dir, value=AREA)
    ends = money.area_range(F.col("value"))
    return t.select("p_partkey", "value", ends["low"].alias("low"), ends["high"].alias("high"))


@query(f"""
with t as (select p_partkey, {AREA} as t from part),
n as (select *, regexp_replace(trim(t), '\\s*[\\-–—]\\s*', '-', 'g') as d from t)
select p_partkey, trim(regexp_replace(d, '(?i)\\s*(sq\\.?\\s*f[t|eet]+|sqft|sft)\\b', '', 'g')) || ' Sq.ft' as area from n
""")
def normalize_area(spark, sf_dir):
    return parts(spark, sf_dir, value=AREA).select("p_partkey", money.area_text(F.col("value")).alias("area"))


@query(f"""
with t as (select p_partkey, regexp_replace({HOURS}, '(?i)\\s*(hrs|hr|hours?)(?:\\s*/\\s*month)?\\b', ' hrs/month', 'g') as t from part)
select p_partkey, regexp_replace(case when contains(t, 'hrs/month') then t else t || ' hrs/month' end, '(\\d+)\\s*[\\-–—]\\s*(\\d+)', '\\1-\\2', 'g') as hours from t
""")
def normalize_hours(spark, sf_dir):
    return parts(spark, sf_dir, value=HOURS).select("p_partkey", money.hours_text(F.col("value")).alias("hours"))


_GROUPED = "regexp_replace(regexp_replace(cast({0} as varchar), '(\\d)(\\d{{3}})$', '\\1,\\2'), '(\\d)(\\d{{3}}),', '\\1,\\2,')"
_AMOUNT = (
    "case when {0} >= 10000000 and {0} % 10000000 = 0 then '₹' || ({0} // 10000000) || ' Crore' when {0} >= 10000000 and {0} % 1000000 = 0 then '₹' || regexp_replace(printf('%.1f', {0} / 10000000.0), '\\.0$', '') || ' Crore'"
    " when {0} >= 100000 and {0} % 100000 = 0 then '₹' || ({0} // 100000) || ' Lakhs' when {0} >= 100000 and {0} % 10000 = 0 then '₹' || regexp_replace(printf('%.1f', {0} / 100000.0), '\\.0$', '') || ' Lakhs'"
    " when {0} >= 1000 and {0} % 1000 = 0 then '₹' || ({0} // 1000) || ' K' else '₹' || " + _GROUPED + " end"
)


@query("select o_orderkey, " + _AMOUNT.format("(cast(trunc(o_totalprice) as bigint) * 1000)") + " as amount, " + _AMOUNT.format("(cast(trunc(o_totalprice) as bigint) * 100)") + " as smaller from orders")
def format_investment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("bigint").alias("n"))
    return o.select("o_orderkey", money.amount_text(F.col("n") * 1000, F.lit("₹")).alias("amount"), money.amount_text(F.col("n") * 100, F.lit("₹")).alias("smaller"))


@query("""select p_partkey, value, case p_size % 8 when 0 then '₹' || p_size || ' Lakhs - ₹' || (p_size + 25) || ' Lakhs' when 1 then 'Upto ₹' || p_size || ' Lakhs' when 2 then '₹' || p_size || '.5 Crore - ₹' || (p_size + 1) || ' Crore'
 when 3 then 'Starting from ₹' || p_size || ' Lakhs' when 4 then '₹' || p_size || ',500' when 5 then value when 6 then 'Moderate' else '₹' || p_size || ' K - ₹' || (p_size + 5) || ' K' end as investment from (select *, """ + MONEY + """ as value from part)""")
def normalize_investment(spark, sf_dir):
    return parts(spark, sf_dir, value=MONEY).select("p_partkey", "value", money.investment_text(F.col("value")).alias("investment"))


@query("""select p_partkey, value, case p_size % 8 when 0 then p_size || '00000 - ' || (p_size + 25) || '00000' when 1 then p_size || '00000' when 2 then p_size || '5000000 - ' || (p_size + 1) || '0000000'
 when 3 then p_size || '00000' when 4 then p_size || '500' when 5 then p_size || '000' when 6 then null else p_size || '000 - ' || (p_size + 5) || '000' end as amount from (select *, """ + MONEY + """ as value from part)""")
def normalize_currency(spark, sf_dir):
    return parts(spark, sf_dir, value=MONEY).select("p_partkey", "value", money.currency(F.col("value")).alias("amount"))


_Q = "case when regexp_extract(replace({0}, ',', ''), '\\d+(?:\\.\\d+)?') = '' then null else regexp_replace(cast(cast(regexp_extract(replace({0}, ',', ''), '\\d+(?:\\.\\d+)?') as double) as varchar), '\\.0$', '') end"


@query(f"""
with t as (select p_partkey, {ROI} as t from part), s as (select *, string_split(t, ' - ') as e from t)
select p_partkey, case when len(e) = 2 then {_Q.format("e[1]")} || ' - ' || {_Q.format("e[2]")} else {_Q.format("t")} end as quantity from s
""")
def normalize_measurement(spark, sf_dir):
    return parts(spark, sf_dir, value=ROI).select("p_partkey", money.quantity(F.col("value")).alias("quantity"))


_PHONE_SQL = """case when not regexp_matches({0}, '[-() ]') and length(regexp_replace({0}, '\\D', '', 'g')) = 10 then '+91 ' || regexp_replace({0}, '\\D', '', 'g')
 when not regexp_matches({0}, '[-() ]') and length(regexp_replace({0}, '\\D', '', 'g')) = 12 then '+91 ' || substr(regexp_replace({0}, '\\D', '', 'g'), 3)
 else trim(regexp_replace(regexp_replace({0}, '[^\\d+\\-()\\s]', '', 'g'), '\\s+', ' ', 'g')) end"""


@query(f"with t as (select p_partkey, {PHONE} as t from part) select p_partkey, {_PHONE_SQL.format('t')} as phone from t")
def normalize_phone(spark, sf_dir):
    return parts(spark, sf_dir, value=PHONE).select("p_partkey", contact.phone(F.col("value")).alias("phone"))


@query(f"""
with t as (select p_partkey, unnest(list_transform(string_split({PHONE}, ','), lambda x: trim(x))) as t, generate_subscripts(string_split({PHONE}, ','), 1) as k from part),
good as (select * from t where regexp_matches(t, '^\\+?[\\d\\s\\-()]{{7,22}}$') and length(regexp_replace(t, '\\D', '', 'g')) >= 7
  and not (not starts_with(t, '+') and regexp_matches(t, '^\\d+\\s*-\\s*\\d{{1,5}}$')))
select p_partkey, string_agg({_PHONE_SQL.format("good.t")}, ', ' order by k) as phone from part left join good using (p_partkey) group by p_partkey
""")
def validate_phone(spark, sf_dir):
    return parts(spark, sf_dir, value=PHONE).select("p_partkey", validate.phones(F.col("value")).alias("phone"))


@query(f"""select p_partkey, case when regexp_matches(lower(trim({MAIL})), '^[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{{2,}}$') then lower(trim({MAIL})) end as email,
 nullif(regexp_extract({YEAR}, '\\b((?:19|20)\\d\\d)\\b', 1), '') as year,
 nullif(array_to_string(regexp_extract_all({ROI}, '\\d+(?:\\.\\d+)?'), ' - '), '') as roi,
 case when lower(trim({TERM})) in ('yes', 'no', 'true', 'false') then null when regexp_extract({TERM}, '\\d+(?:\\.\\d+)?') = '' then trim({TERM})
  else regexp_replace(cast(cast(regexp_extract({TERM}, '\\d+(?:\\.\\d+)?') as double) as varchar), '\\.0$', '') end as duration,
 case when lower(trim({NAME})) not in ('franchise opportunity', 'franchise opportunities', 'franchise for sale') then trim({NAME}) end as name from part""")
def validate_fields(spark, sf_dir):
    t = parts(spark, sf_dir, **RECORD)
    c = F.col
    return t.select("p_partkey", validate.email(c("email")).alias("email"), validate.year(c("established_year")).alias("year"), validate.numbers(c("roi")).alias("roi"), validate.duration(c("agreement_duration")).alias("duration"), validate.name(c("franchise_name")).alias("name"))


_CHANGED = "case when {0} <> {1} then '\"normalized_from_{2}\":' || to_json({0}) end"
_RAW = {"established_year": YEAR, "agreement_duration": TERM, "phone": PHONE, "email": MAIL, "roi": ROI, "investment_required": MONEY, "area_required": AREA}
_LOG = ", ".join(_CHANGED.format(f"({raw})", f"v.{f}", f) for f, raw in _RAW.items())


@query(f"""with f as ({SQL["validate_fields"]}), ph as ({SQL["validate_phone"]}), inv as ({SQL["normalize_investment"]}), ar as ({SQL["normalize_area"]}), hr as ({SQL["normalize_hours"]}),
v as (select part.*, name as franchise_name, year as established_year, duration as agreement_duration, phone, email, roi, case when p_size % 8 <> 6 then investment end as investment_required, case when p_size % 4 <> 3 then area end as area_required, hours as expected_hours,
  case when starts_with({SITE}, 'http') then '' else 'https://' end || {SITE} as website from part join f using (p_partkey) join ph using (p_partkey) join inv using (p_partkey) join ar using (p_partkey) join hr using (p_partkey))
select p_partkey, franchise_name, established_year, agreement_duration, phone, email, roi, investment_required, area_required, expected_hours, website,
 cast(case p_size % 8 when 0 then p_size * 100000 when 2 then p_size * 10000000 + 5000000 when 3 then p_size * 100000 when 4 then p_size * 1000 + 500 when 5 then p_size * 1000 when 7 then p_size * 1000 end as double) as investment_min,
 cast(case p_size % 8 when 0 then (p_size + 25) * 100000 when 1 then p_size * 100000 when 2 then (p_size + 1) * 10000000 when 7 then (p_size + 5) * 1000 end as double) as investment_max,
 cast(case p_size % 4 when 0 then p_size * 10 when 1 then p_size when 2 then 1 end as double) as area_min, cast(case p_size % 4 when 0 then p_size * 20 when 2 then p_size + 100 end as double) as area_max,
 '{{' || array_to_string(list_filter([{_LOG}], lambda x: x is not null), ',') || '}}' as normalized_from from v""")
def validate_record(spark, sf_dir):
    """All checks in one projection, with the log of what changed and the numeric ranges."""
    done = validate.ranges(validate.validated(spread(parts(spark, sf_dir, **RECORD))))
    return done.withColumn("normalized_from", F.to_json("normalized_from"))


@query(f"""select p_partkey, array_to_string(list_filter([case when {YEAR} <> regexp_extract({YEAR}, '\\b((?:19|20)\\d\\d)\\b', 1) and regexp_extract({YEAR}, '\\b((?:19|20)\\d\\d)\\b', 1) <> '' then {YEAR} end], lambda x: x is not null), ',') as was from part""")
def normalization_log(spark, sf_dir):
    done = validate.validated(parts(spark, sf_dir, established_year=YEAR))
    return done.select("p_partkey", F.coalesce(F.col("normalized_from")["normalized_from_established_year"], F.lit("")).alias("was"))


@query("""select p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g') as field,
 coalesce(nullif(trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', '_', 'g'), '_'), ''), 'part') as slug from part""")
def field_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.field_name(F.col("p_type")).alias("field"), text.slug(F.col("p_name"), "part").alias("slug"))


@query("""select page_id, case when not contains(url, '?') then url else regexp_extract(url, '^([^?]*)', 1) ||
 case when q = '' then '' else '?' || q end end as url from (select page_id, url,
 array_to_string(list_filter(string_split(regexp_extract(url, '\\?(.*)$', 1), '&'), lambda p: not regexp_matches(p, '(?i)^(utm_[^=]*|fbclid|gclid|yclid|msclkid)=')), '&') as q from pages)""")
def strip_tracking_params(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", contact.untracked(F.col("url")).alias("url"))


@query("select page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)), '^www\\.', '') as domain from pages")
def url_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", contact.domain(F.col("url")).alias("domain"))


@query("""select doc_id, nullif(regexp_extract(coalesce(text, ''), '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}'), '') as email,
 case when length(regexp_replace(p, '\\D', '', 'g')) >= 9 then p end as phone
 from (select doc_id, text, regexp_extract(coalesce(text, ''), '\\+?\\d[\\d\\s\\-()]{7,18}\\d') as p from documents)""")
def first_email_phone(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", contact.first_email(F.col("text")).alias("email"), contact.first_phone(F.col("text")).alias("phone"))


@query("""select c_custkey, case when c_custkey % 4 = 0 then 'https://' || replace(lower(c_name), ' ', '') else c_name end as name_url,
 regexp_replace(trim(c_mktsegment), '\\s+', ' ', 'g') as segment,
 case c_custkey % 3 when 0 then '2021-03-0' || (c_custkey % 9 + 1) when 1 then cast(1990 + c_custkey % 30 as varchar) else 'unknown' end as since from customer""")
def field_normalizer(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    since = F.expr("case c_custkey % 3 when 0 then concat(c_custkey % 9 + 1, '/3/2021') when 1 then concat('since ', 1990 + c_custkey % 30) else 'unknown' end")
    return c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 4 == 0, contact.by_kind(F.lit("Website"), F.lower("c_name"))).otherwise(F.col("c_name")).alias("name_url"),
        contact.by_kind(F.lit("Segment"), F.concat(F.lit("  "), "c_mktsegment")).alias("segment"),
        contact.by_kind(F.lit("Established"), since).alias("since"),
    )


@query("""select conv_id, turn, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')) as lines,
 contains(text, '?') as asks from conversations""")
def conversation_lines(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), text.squeeze), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(lines).cast("long").alias("lines"), F.col("text").contains("?").alias("asks"))


@query(f"""select p_partkey, case when {NAME} is null then 'missing' when trim({NAME}) = '' then 'missing' else '' end as missing from part""")
def required_field_check(spark, sf_dir):
    t = parts(spark, sf_dir, name=NAME).withColumns({"source_url": F.lit("https://x.org"), "page_title": F.lit("X")})
    return validate.required(t, ["name"]).select("p_partkey", F.when(F.size("missing") > 0, "missing").otherwise("").alias("missing"))
