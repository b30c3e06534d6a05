"""One run from pages to a dataset: parse, ask, merge, validate, map, keep, and what became of each url."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validate
from ..functions.text import RESERVED, is_empty, quoted
from ..sources import shared
from . import answers, dataset, fields, journey, mapping, records
from .pages import pages_with
from .schema import Schema, Site, profile_of

#: Writes a stage under its name and gives back what is to be read from then on.
Keep = Callable[[str, DataFrame], DataFrame]

# Other names of fields that columns may have; fields whose values are normalised before they are mapped.
DEFAULT_ALIASES = {
    "about": ["About", "overview", "company_profile"],
    "description": ["Description", "overview", "summary"],
    "services": ["Services", "offerings", "business_services"],
    "operational_support": ["Support", "support", "business_support"],
    "investment_required": ["Investment Required", "Investment", "capital_required", "Investment Range"],
    "franchise_name": ["Franchise Name", "brand_name"],
    "investment_min": ["Minimum Investment", "min_investment", "investment min"],
    "investment_max": ["Maximum Investment", "max_investment", "investment max"],
    "area_min": ["Minimum Area", "min_area", "area min"],
    "area_max": ["Maximum Area", "max_area", "area max"],
}
NORMALISED = ("investment_required", "franchise_fee", "royalty", "area_required", "expected_hours", "phone", "email", "website")

#: Reasons that another try may mend.
TRANSIENT = ("timeout", "timed out", "connection", "429", "rate", "503", "502")


def in_memory(name: str, stage: DataFrame) -> DataFrame:
    """Keeps nothing: each output of a run computes its stages anew."""
    return stage


def in_shared(name: str, stage: DataFrame) -> DataFrame:
    """Keeps what is dear to make anew, pages as they were read and records as they were checked, in the shared folder."""
    return shared.stored(name, stage) if name in ("parsed", "mapped") else stage


def snapshots(folder: str) -> Keep:
    """Every stage as Parquet in a folder of its own, so that each is computed once and can be looked at."""

    def keep(name: str, stage: DataFrame) -> DataFrame:
        stage.write.mode("overwrite").parquet(f"{folder}/{name}")
        return stage.sparkSession.read.parquet(f"{folder}/{name}")

    return keep


def aliases_of(schema: Schema, known: list[str]) -> mapping.Aliases:
    """The names of fields by the schema's aliases, its columns, and those that all schemas share."""
    manual: dict[str, list[str]] = {f: list(names) for f, names in DEFAULT_ALIASES.items() if f in known}
    for f in schema.fields:
        manual.setdefault(f.name, []).extend([f.column, *f.aliases])
    return mapping.Aliases(known, manual)


def merged_answers(parsed: DataFrame, schema: Schema) -> DataFrame:
    """One row a page with the schema's fields, each of the page or of the model's answer as its policy says, and which came from where.

    ``parsed`` has ``page`` (with ``fields`` and ``lists``), ``url``, ``title`` and ``answer``, a struct of the schema's types.
    """
    out, sources = [], []
    for f in schema.fields:
        if f.type == "array":
            by_name = fields.resolved(f.name, f.aliases, F.transform_values("page.lists", lambda k, v: F.to_json(v)))
            page: Column = F.to_json(F.from_json(by_name, "array<string>"))
            model: Column = F.when(F.size(F.col("answer")[f.name]) > 0, F.to_json(F.col("answer")[f.name]))
        else:
            page, model = fields.resolved(f.name, f.aliases, F.col("page.fields")), F.col("answer")[f.name].cast("string")
        value, source = fields.merged(f.name, page, model, f.merge_policy())
        out.append((F.array_join(F.from_json(value, "array<string>"), ", ") if f.type == "array" else value).alias(f.name))
        sources.append(source)
    from_page, from_model = dataset.provenance([f.name for f in schema.fields], sources)
    trace = []
    if "_texts" in parsed.columns:
        names = F.array(*[F.lit(f.name) for f in schema.fields])
        solved = F.split(from_page, ", ")
        answered = F.map_from_arrays(names, F.array(*out))
        trace = [F.struct("_texts", solved.alias("solved"), F.array_except(names, solved).alias("asked"), answered.alias("answered")).alias("_trace")]
    return parsed.select("page_id", F.col("url").alias("source_url"), F.col("page.title").alias("page_title"), F.col("page.page_type").alias("page_type"), *out, from_page.alias("fields_from_dom"), from_model.alias("fields_from_llm"), *trace)


def mapped_records(valid: DataFrame, schema: Schema) -> DataFrame:
    """``page_id``, the dataset's columns with those of the pipeline's own values, ``coverage``, the counts behind it and ``paths``."""
    own = ["page_id", "source_url", "page_title", "page_type", "fields_from_dom", "fields_from_llm", *(["_trace", "_valid"] if "_trace" in valid.columns else [])]
    known = [c for c in valid.columns if c not in own and c not in ("normalized_from", *RESERVED)]
    names = aliases_of(schema, known)
    columns = schema.own_columns()
    if "_trace" in valid.columns:
        named = [f.name for f in schema.fields if f.name in valid.columns]
        valid = valid.withColumn("_valid", F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*[F.col(f).cast("string") for f in named])))
    flat = valid.select(*own, *[F.col(c).cast("string").alias(c) for c in known])
    done = mapping.mapped(flat, columns, names, keys=own, overflow=schema.overflow, tell=True)
    homes = {f: names.column_for(f, columns)[0] for f in known}
    count = lambda among: sum((F.col(f"_filled_{f}").cast("int") for f in among), F.lit(0))
    listed = lambda c: F.split(F.coalesce(c, F.lit("")), ", ")
    won = F.col("_winners")
    counts = {
        "total_fields": F.lit(len(known)),
        "mapped_fields": F.size(won),
        "deterministic_fields": F.size(F.array_intersect(won, listed(F.col("fields_from_dom")))),
        "llm_fields": F.size(F.array_intersect(won, listed(F.col("fields_from_llm")))),
        "normalized_fields": count([f for f in known if f in NORMALISED]),
        "missing_fields": F.lit(len(known)) - count(known),
        "unmapped_fields": count([f for f in known if homes[f] is None]),
    }
    meta = {"source_url": F.col("source_url"), "page_title": F.col("page_title")}
    seen = []
    if "_trace" in own:
        places = {f: c for f in known if (c := homes[f]) in columns}
        seen = [
            journey.masks(
                schema,
                places,
                texts={t: F.col(f"_trace._texts.{t}") for t in journey.TEXTS},
                **{m: F.col(f"_trace.{m}") for m in ("solved", "asked", "answered")},
                valid=F.col("_valid"),
                written=F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(quoted(c)) for c in columns])),
            ).alias("_seen")
        ]
    return done.select("page_id", *seen, F.col("source_url").alias("_url"), F.col("page_title").alias("_title"), *map(quoted, columns), *[F.coalesce(meta[m], F.lit("")).alias(c) for m, c in schema.metadata_columns().items()], "coverage", *[v.cast("long").alias(k) for k, v in counts.items()], "paths")


def required_checked(rows: DataFrame, schema: Schema) -> DataFrame:
    """``rows`` with ``missing``: required columns still empty after urls, and titles and names, are filled from the page."""
    needed = [*[f.column for f in schema.fields if f.required], *schema.extra_required]
    out = rows
    for c in needed:
        low = c.lower()
        fill = F.col("_url") if "url" in low else F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.col("_url")) if "title" in low or "name" in low else None
        if fill is not None and c in rows.columns:
            out = out.withColumn(c, F.when(is_empty(F.col(quoted(c))), F.coalesce(fill, F.lit(""))).otherwise(F.col(quoted(c))))
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(is_empty(F.col(quoted(c))), F.lit(c)) for c in needed if c in rows.columns])))


@dataclass(frozen=True)
class Result:
    """What a run gives, as plans: the dataset after it, its rows, those that lack what is required, a line and, where it failed, a reason for each url."""

    dataset: DataFrame
    rows: DataFrame
    rejected: DataFrame
    summary: DataFrame
    failed: DataFrame
    journeys: DataFrame | None = None


def run_pages(pages: DataFrame, schema: Schema, recorded: DataFrame, old: DataFrame | None = None, *, site: Site | None = None, now: str, keep: Keep | None = None, trace: bool = False) -> Result:
    """Pages (page_id, url, html, and ``load_error`` if loading can fail) with recorded answers (page_id, answer) into a dataset.

    ``old`` is the dataset so far, with the columns that a run gives; the rows of the run are kept in it by the schema's keys.
    A page that fails, or whose answer does, is in ``failed`` and stops nothing.  Pages are read, and answers mended, once: by default what
    they gave is kept in the folder that all executors share, and every output starts from there.
    With ``trace`` it also gives ``journeys``, which stages each field of a page that was read came through and which lost it; the texts of the
    stages then travel with a page's row as far as the mapping, where a bit for each field and stage is left of them.
    """
    keep = keep or in_shared
    site = site or Site("default")
    shape = {"columns": schema.own_columns(), "aliases": {a: f for a, f in schema.aliases().items()}}
    loaded = pages if "load_error" in pages.columns else pages.withColumn("load_error", F.lit(None).cast("string"))
    wanted = ["title", "page_type", "fields", "lists", "filtered", *(["cleaned", "blocks"] if trace else [])]
    made = pages_with(loaded, config=site.clean, schema=shape, profile=profile_of(site), want=wanted)
    if trace:
        made = made.withColumn("_texts", F.struct(*[F.lower(c).alias(t) for t, c in zip(journey.TEXTS, (F.col("html"), F.col("page.cleaned"), F.col("page.filtered"), block_text(F.col("page.blocks"))), strict=True)]))
    parsed = keep("parsed", made.drop("html"))
    said = answers.recorded(parsed, recorded)
    answered = said.withColumn("answer", records.typed(records.coerced_json(answers.repaired_json(F.col("answer")), schema), schema))
    merged = keep("merged", records.with_generic_fallbacks(merged_answers(answered.where("load_error is null and page.error is null"), schema)))
    valid = keep("validated", validate.ranges(validate.validated(merged)))
    checked = keep("mapped", required_checked(mapped_records(valid, schema), schema))
    good, rejected = checked.where(F.size("missing") == 0), checked.where(F.size("missing") > 0)

    columns = schema.columns()
    fresh = good.select(F.col("page_id").alias("seq"), *map(quoted, columns))
    empty = fresh.limit(0).withColumns({"extraction_date": F.lit(""), "last_updated": F.lit("")})
    kept = dataset.upserted(old if old is not None else empty, fresh, schema.key_columns() or [schema.metadata_columns().get("source_url", columns[0])], now=now)

    reasons = parsed.select("page_id", "url", F.col("page.page_type").alias("page_type"), F.coalesce("load_error", "page.error").alias("error"))
    lines = reasons.join(checked.select("page_id", F.array_join("missing", ", ").alias("missing"), "coverage"), "page_id", "left")
    reason = F.coalesce("error", F.when(F.col("missing") != "", F.concat(F.lit("missing required fields: "), F.col("missing"))))
    status = F.when(F.col("error").isNotNull(), "Failed").when(F.col("missing") != "", "Skipped").otherwise("Success")
    summary = lines.select("page_id", "url", status.alias("status"), "page_type", F.lit("DIRECT").alias("strategy"), "coverage", F.lit(now).alias("timestamp"), F.coalesce(reason, F.lit("")).alias("error"))
    return Result(kept, good, rejected, summary, failed_urls(summary), journey.opened(checked, F.col("_seen"), schema) if trace else None)


def block_text(blocks: Column) -> Column:
    """All that blocks say, as one text."""
    pairs = lambda b: F.transform(b["pairs"], lambda p: F.concat_ws(" ", p["key"], p["value"]))
    one = lambda b: F.concat_ws(" ", b["text"], b["items"], pairs(b), F.flatten(b["rows"]), b["src"], b["alt"], b["placeholder"], b["value"])
    return F.array_join(F.transform(blocks, one), "\n")


def failed_urls(summary: DataFrame) -> DataFrame:
    """(page_id, url, reason, timestamp, retry): the urls without a row, and whether another try may help."""
    again = F.lower("error").rlike("|".join(TRANSIENT))
    return summary.where("status <> 'Success'").select("page_id", "url", F.col("error").alias("reason"), "timestamp", F.when(again, "Yes").otherwise("No").alias("retry"))


def counters(summary: DataFrame) -> DataFrame:
    """processed, success and failed, over all urls of a run."""
    return summary.agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "Success").alias("success"), F.count_if(F.col("status") != "Success").alias("failed"))
