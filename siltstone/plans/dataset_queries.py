"""Queries over records: ownership, mapping, upsert, quality, jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import lookup_keys, merged_list
from ..sources import shared
from ..sources.kept import KeptDataset
from . import dataset, mapping
from .fields import field_of, merged
from .registry import SQL, query, table

_DET = "case when p_size % 3 = 0 then null when p_size % 3 = 1 then '' else p_brand end"
_LLM = "case when p_size % 4 = 0 then null else p_type end"


@query(f"""with t as (select p_partkey, nullif({_DET}, '') as d, nullif({_LLM}, '') as m from part)
select p_partkey, coalesce(d, m) as brand, case when d is not null then 'Deterministic' when m is not null then 'LLM' else 'None' end as brand_source,
 m as description, case when m is not null then 'LLM' else 'None' end as description_source, d as investment_min, case when d is not null then 'Deterministic' else 'None' end as min_source from t""")
def ownership_merge(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(_DET).alias("d"), F.expr(_LLM).alias("m"))
    out = []
    for field, source in (("brand", "brand_source"), ("description", "description_source"), ("investment_min", "min_source")):
        value, of = merged(field, F.col("d"), F.col("m"))
        out += [value.alias(field), of.alias(source)]
    return t.select("p_partkey", *out)


@query(f"""with t as (select p_partkey, nullif({_DET}, '') as d, nullif({_LLM}, '') as m from part)
select p_partkey, array_to_string(list_filter([case when d is not null then 'brand' end, case when d is not null then 'phone' end], lambda x: x is not null), ', ') as from_page,
 array_to_string(list_filter([case when d is null and m is not null then 'brand' end, case when d is null and m is not null then 'phone' end, case when m is not null then 'about' end], lambda x: x is not null), ', ') as from_model from t""")
def merge_provenance(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(_DET).alias("d"), F.expr(_LLM).alias("m"))
    fields = ["brand", "phone", "about"]
    page, model = dataset.provenance(fields, [merged(f, F.col("d"), F.col("m"))[1] for f in fields])
    return t.select("p_partkey", page.alias("from_page"), model.alias("from_model"))


@query("""select p_partkey, label, case when label in ('capital', 'total investment') then 'investment_required' when label = 'staff' then 'number_of_employees' when label = 'mobile' then 'phone'
 when label = 'do you need capital' then 'operations_commenced' end as field
 from (select p_partkey, case p_size % 5 when 0 then 'capital' when 1 then 'total investment' when 2 then 'staff' when 3 then 'mobile' else 'colour' end as label from part)""")
def label_fields(spark, sf_dir):
    """Labels to fields, as one ordered CASE."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr("case p_size % 5 when 0 then 'capital' when 1 then 'total investment' when 2 then 'staff' when 3 then 'mobile' else 'colour' end").alias("label"))
    return t.select("p_partkey", "label", field_of(F.col("label")).alias("field"))


@query("""select n_nationkey, replace(lower(n_name), ' ', '_') || ',' || 'area_required' as keys from nation""")
def alias_keys(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.array_join(lookup_keys(F.col("n_name"), F.array(F.lit("Area Required"), F.col("n_name"), F.lit("area-required"))), ",").alias("keys"))


@query("""select p_partkey, p_brand || case when p_type <> p_brand then ' | ' || p_type else '' end || ' | extra' as products from part""")
def mergeable_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", merged_list(F.col("p_brand"), F.concat(F.col("p_type"), F.lit(" | "), F.col("p_brand"), F.lit(" | extra")), " | ").alias("products"))


_COLUMNS = ["Franchise Name", "Investment Required", "Phone", "Total Capital", "Additional Information"]


@query("""select p_partkey, p_brand as "Franchise Name", p_type as "Investment Required", '' as "Phone", '' as "Total Capital", '{"colour":"' || p_size || '"}' as "Additional Information", '60.00%' as coverage from part""")
def map_record(spark, sf_dir):
    r = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("franchise_name"), F.col("p_type").alias("investment_required"), F.lit("").alias("phone"), F.col("p_size").cast("string").alias("colour"))
    out = mapping.mapped(r, _COLUMNS, mapping.Aliases(["franchise_name", "investment_required", "phone"]), keys=["p_partkey"], overflow="Additional Information")
    return out.drop("paths")


@query("""select event_id, 'Count' as "column", v as value from (select event_id, json_extract_string(props, '$.k') as v from events) where v is not null and v <> ''""")
def field_mapper_first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return mapping.first_wins_in(e, F.expr("from_json(props, 'map<string,string>')"), {"K": "Count"}, keys=["event_id"])


@query("""with old as (select c_custkey as seq, c_name, c_mktsegment from customer where c_custkey % 3 <> 0), new as (select c_custkey as seq, upper(c_name) || ' ' as c_name, case when c_custkey % 2 = 0 then '' else c_mktsegment || '2' end as c_mktsegment from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0)
select coalesce(new.c_name, old.c_name) as c_name, coalesce(new.c_mktsegment, old.c_mktsegment) as c_mktsegment, coalesce(old.seq, new.seq) as seq,
 case when old.seq is not null then '2020' else '2021' end as extraction_date, case when new.seq is null then '2020' else '2021' end as last_updated,
 case when new.seq is null then 'Unchanged' when old.seq is not null then 'Updated' else 'Inserted' end as operation from old full join new on lower(trim(old.c_name)) = lower(trim(new.c_name))""")
def upsert_dataset(spark, sf_dir):
    old, new = _customer_batches(spark, sf_dir)
    return dataset.upserted(old.withColumns({"extraction_date": F.lit("2020"), "last_updated": F.lit("2020")}), new, ["c_name"], now="2021")


def _customer_batches(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), "c_name", "c_mktsegment")
    new = c.where("seq % 2 = 0 or seq % 3 = 0").select("seq", F.concat(F.upper("c_name"), F.lit(" ")).alias("c_name"), F.expr("case when seq % 2 = 0 then '' else concat(c_mktsegment, '2') end").alias("c_mktsegment"))
    return c.where("seq % 3 <> 0"), new


@query(SQL["upsert_dataset"])
def upsert_buckets(spark, sf_dir):
    """The same two batches merged one after the other into a dataset of buckets in the shared folder."""
    old, new = _customer_batches(spark, sf_dir)
    kept = KeptDataset(spark, shared.fresh(spark, "kept"), ["c_name"], buckets=16)
    kept.merge(old, now="2020")
    kept.merge(new, now="2021")
    rows = kept.read()
    return rows.withColumn("operation", F.when(F.col("last_updated") == "2020", "Unchanged").when(F.col("extraction_date") == "2020", "Updated").otherwise("Inserted"))


_OUTCOME = "case when event_id % 7 = 0 then 'failed' when event_id % 101 = 0 then 'cancelled' else 'success' end"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.expr(_OUTCOME).alias("outcome"), F.col("ts").cast("string").alias("ts"))


@query(f"""with c as (select user_id, count(*) as urls, count(*) filter (where o = 'success') as completed, count(*) filter (where o = 'failed') as failed, count(*) filter (where o = 'cancelled') as cancelled from (select *, {_OUTCOME} as o from events) group by user_id)
select *, case when cancelled > 0 then 'cancelled' when failed > 0 and completed > 0 then 'partial' when failed > 0 then 'failed' else 'completed' end as status from c""")
def job_status(spark, sf_dir):
    return dataset.job_status(_events(spark, sf_dir), "user_id", "outcome")


@query(f"""select count(*) filter (where {_OUTCOME} = 'success') as completed, count(*) filter (where {_OUTCOME} = 'failed') as failed, count(*) filter (where {_OUTCOME} = 'cancelled') as cancelled from events""")
def job_url_counts(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("success", "completed"), ("failed", "failed"), ("cancelled", "cancelled"))])


@query("""select user_id, round(sum(value), 4) as seconds, count(distinct event_type) as kinds, string_agg(distinct event_type, ',' order by event_type) as names from events group by user_id""")
def job_durations(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("seconds"), F.count_distinct("event_type").alias("kinds"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"))


@query("""select user_id, max(event_id) as latest from events group by user_id order by latest desc limit 10""")
def recent_jobs(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max("event_id").alias("latest")).orderBy(F.desc("latest")).limit(10)


@query(f"""select user_id, max(event_id) as event_id from events where {_OUTCOME} = 'success' group by user_id""")
def latest_success(spark, sf_dir):
    return _events(spark, sf_dir).where("outcome = 'success'").groupBy("user_id").agg(F.max_by("event_id", "event_id").alias("event_id"))


@query("""with e as (select l_orderkey, l_linenumber - 1 as idx, l_returnflag || case when l_linestatus = 'O' then ' company' else ' contact' end as entity_type, l_linenumber % 2 + 1 as n_records, cast(l_quantity as bigint) as n_attributes from lineitem),
s as (select *, (case when contains(lower(entity_type), 'company') then 10.0 else 0.0 end) + (case when n_records = 1 then 5.0 else 0.0 end) + least(n_attributes, 10) * 0.2 + (case when idx = 0 then 1.0 else 0.0 end) as score from e)
select l_orderkey, entity_type, round(cast(score as double), 4) as score from (select *, row_number() over (partition by l_orderkey order by score desc, idx, entity_type desc) as k from s) where k = 1""")
def primary_entity(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("idx"), F.concat("l_returnflag", F.when(F.col("l_linestatus") == "O", " company").otherwise(" contact")).alias("entity_type"), (F.col("l_linenumber") % 2 + 1).alias("n_records"), F.col("l_quantity").cast("bigint").alias("n_attributes"))
    return mapping.primary_entity(e, keys=["l_orderkey"], words=["company", "brand"]).select("l_orderkey", "entity_type", F.round("score", 4).alias("score"))
