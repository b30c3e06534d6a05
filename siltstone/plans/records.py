"""Records between extraction and dataset: fallbacks, clean forms, model answers in a schema's types."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contact import TRACKING
from ..functions.text import first_filled, is_empty
from ..operators.model import coerced
from .schema import Schema

ENTITIES = T.ArrayType(T.StructType([T.StructField("entity_type", T.StringType()), T.StructField("records", T.ArrayType(T.StructType([T.StructField("attributes", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))])))]))
# The kind and the fields of the entity that a flat record gives, an attribute's other name, titles of last resort.
FLAT_ENTITY, FLAT_FIELDS = "Franchise Opportunity", ("franchise_name", "phone", "email", "investment_required")
OTHER_NAME = {"investment": "investment_required"}
UNTITLED = "Untitled Page"


def _column(records: DataFrame, name: str) -> Column:
    return F.col(name) if name in records.columns else F.lit(None).cast("string")


def _first_named(attributes: Column, names: list[str]) -> Column:
    return F.get(F.filter(attributes, lambda a: a["key"].isin(*names)), F.lit(0))["value"]


def with_generic_fallbacks(records: DataFrame) -> DataFrame:
    """A page title from the url, and a summary that is not null."""
    title = first_filled(_column(records, "page_title"), _column(records, "source_url"), F.lit(UNTITLED))
    return records.withColumns({"page_title": title, "page_summary": F.coalesce(_column(records, "page_summary"), F.lit(""))})


def with_entity_fallbacks(records: DataFrame) -> DataFrame:
    """Null fields from the first attribute of their name; without entities, one of the flat fields; title and summary from others.

    ``entities`` is of the type ``ENTITIES``.
    """
    attributes = F.flatten(F.transform(F.flatten(F.transform(F.coalesce("entities", F.array().cast(ENTITIES)), lambda e: e["records"])), lambda r: r["attributes"]))
    named = records.withColumn("_attributes", attributes)
    kinds = dict(records.dtypes)
    filled = {}
    for f in records.columns:
        if kinds[f] == "string":
            names = [f, *(a for a, to in OTHER_NAME.items() if to == f)]
            filled[f] = F.coalesce(F.col(f), _first_named(F.col("_attributes"), names))
    out = named.withColumns(filled)
    other = {to: a for a, to in OTHER_NAME.items()}
    pairs = F.array_compact(F.array(*[F.when(~is_empty(_column(out, f)), F.struct(F.lit(other.get(f, f)).alias("key"), _column(out, f).alias("value"))) for f in FLAT_FIELDS]))
    one = F.array(F.struct(F.lit(FLAT_ENTITY).alias("entity_type"), F.array(F.struct(pairs.alias("attributes"))).alias("records"))).cast(ENTITIES)
    none = F.col("entities").isNull() | (F.size("entities") == 0)
    out = out.withColumn("entities", F.when(none & ~is_empty(_column(out, "franchise_name")), one).otherwise(F.col("entities")))
    title = first_filled(_column(out, "page_title"), _column(out, "franchise_name"), _column(out, "brand"), F.lit(FLAT_ENTITY))
    summary = F.coalesce(first_filled(_column(out, "page_summary"), _column(out, "description"), _column(out, "about")), F.lit(""))
    return out.withColumns({"page_title": title, "page_summary": summary}).drop("_attributes")


def clean_record(records: DataFrame, label: str = "Extracted Record") -> Column:
    """A record as JSON for a caller: title, type, summary, and its fields as the one entity of its type."""
    kind = first_filled(_column(records, "page_type"), F.lit(label))
    fields = F.struct(*[F.col(c) for c in records.columns])
    return F.to_json(F.struct(first_filled(_column(records, "page_title"), _column(records, "source_url"), F.lit(UNTITLED)).alias("page_title"), kind.alias("page_type"), F.coalesce(_column(records, "page_summary"), F.lit("")).alias("page_summary"), F.create_map(kind, F.array(fields)).alias("entities")))


def _untracked(text: str) -> str:
    base, mark, query = text.partition("?")
    if not mark or "://" not in text:
        return text
    kept = [p for p in query.split("&") if "=" not in p or not (p.split("=", 1)[0].lower().startswith("utm_") or p.split("=", 1)[0].lower() in TRACKING)]
    return f"{base}?{'&'.join(kept)}" if kept else base


def clean_value(value):
    """A value without anything empty in it, texts stripped and links without tracking; None if nothing is left."""
    if isinstance(value, str):
        return _untracked(value.strip()) or None
    if isinstance(value, dict):
        return {k: v for k, v in ((k, clean_value(v)) for k, v in value.items() if k) if v is not None} or None
    if isinstance(value, list):
        return [v for v in map(clean_value, value) if v is not None] or None
    return value


def value_text(value, delimiter: str | None = None) -> str:
    """A value as a cell shows it: whole numbers without a fraction, pairs as "k: v", several items as bullets or joined."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if not isinstance(value, list):
        return str(value)
    items = [f"Q: {x['question']} A: {x['answer']}" if isinstance(x, dict) and {"question", "answer"} <= set(x) else f"{x['key']}: {x['value']}" if isinstance(x, dict) and {"key", "value"} <= set(x) else str(x) for x in value]
    return "\n".join(f"• {x}" for x in items) if delimiter is None and len(items) > 1 else (delimiter or ", ").join(items)


def _on_json(change: Callable) -> Callable[[Column], Column]:
    @F.arrow_udf(T.StringType())
    def apply(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            try:
                out.append(None if t.as_py() is None else change(json.loads(t.as_py())))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return apply


def clean_json(raw: Column, mapped: frozenset[str] = frozenset()) -> Column:
    """JSON objects of any depth without what is empty, and at the top without keys that ``mapped`` has; '' if nothing is left, null if it is no JSON."""

    def change(data) -> str:
        kept = {k: v for k, v in data.items() if k.lower().strip().replace("_", " ").replace("-", " ") not in mapped} if isinstance(data, dict) else data
        left = clean_value(kept)
        return json.dumps(left, ensure_ascii=False) if left is not None else ""

    return _on_json(change)(raw)


def json_text(raw: Column, delimiter: str | None = None) -> Column:
    return _on_json(lambda data: value_text(data, delimiter))(raw)


def coerced_json(raw: Column, schema: Schema) -> Column:
    """Answers as JSON objects that have the schema's fields, each in its type; what can't be is null."""
    kinds = {f.name: f.type for f in schema.fields}
    return _on_json(lambda data: json.dumps({f: coerced(data.get(f), kind) for f, kind in kinds.items()} if isinstance(data, dict) else {}, ensure_ascii=False))(raw)


def typed(answer: Column, schema: Schema, corrupt: str = "_corrupt") -> Column:
    """A JSON answer as a struct of the schema's types; an answer that is no object is in ``corrupt``, with all fields null."""
    return F.from_json(answer, T.StructType([*schema.struct().fields, T.StructField(corrupt, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})


def unexpected(answer: Column, schema: Schema) -> Column:
    """The keys of a JSON answer that the schema does not have, in order."""
    keys = F.coalesce(F.map_keys(F.from_json(answer, "map<string,string>")), F.array().cast("array<string>"))
    return F.array_except(keys, F.array(*[F.lit(f.name) for f in schema.fields]))
