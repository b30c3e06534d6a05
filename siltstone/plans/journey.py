"""Where each field of a page was lost on its way into the dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .schema import Schema

# What follows a stage that a field did not pass, in the order of the stages.
REASONS = {
    "Raw HTML": "Field does not exist on webpage.",
    "Cleaned HTML": "Removed during HTML preprocessing (cleaning).",
    "Relevant DOM": "Filtered out by Relevant DOM score/pruning threshold.",
    "DOM Blocks": "Dropped by DOM semantic block builder.",
    "Validator": "Failed validation or normalization.",
    "LLM Extraction": "Model failed to extract despite receiving the information.",
    "Schema Mapper": "Dropped during mapping because the field has no target column in the destination schema.",
    "Deterministic Extraction": "Deterministic regex / selector patterns failed to match.",
}
TEXTS = ("raw", "clean", "relevant", "blocks")


def said(text: Column, names: list[str], values: list[Column]) -> Column:
    """Whether a text in lower case has one of a field's names or values, whatever their case."""
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(text.contains(n.lower().strip()), F.lit(False))
    for v in values:
        low = F.lower(strip(F.coalesce(v, F.lit(""))))
        out = out | ((low != "") & F.coalesce(text.contains(low), F.lit(False)))
    return out


#: What is known of each field of a page, a bit a field in words of ``WORD_BITS``.
MASKS = (*TEXTS, "solved", "asked", "answered", "valid", "written")
WORD_BITS = 62


def _ordered(schema: Schema) -> list:
    return sorted(schema.fields, key=lambda f: f.name)


def masks(schema: Schema, columns: dict[str, str], *, texts: dict[str, Column], solved: Column, asked: Column, answered: Column, valid: Column, written: Column) -> Column:
    """A struct of ``MASKS`` for a row that holds a page's texts, ``solved`` and ``asked`` (arrays of fields), ``answered`` and ``valid`` (maps by field) and ``written`` (by column).

    ``columns`` are the columns of fields that have one; texts are in lower case.  What is as long as the page need not outlive the row.
    """
    given = {**texts, "solved": solved, "asked": asked, "answered": answered, "valid": valid, "written": written}
    # bound once: spelled out, the expressions behind these would be there for every field and mask
    bound = F.array(F.struct(*[c.alias(m) for m, c in given.items()]))
    return F.get(F.transform(bound, lambda row: _masks(row, _ordered(schema), columns)), F.lit(0))


def _masks(row: Column, fields: list, columns: dict[str, str]) -> Column:
    flags: dict[str, list[Column]] = {m: [] for m in MASKS}
    for f in fields:
        names = list(dict.fromkeys([f.name, f.name.replace("_", " "), *f.aliases]))
        of = lambda m, key: F.nullif(F.element_at(row[m], F.lit(key)), F.lit(""))
        own, answer = of("valid", f.name), of("answered", f.name)
        for t in TEXTS:
            flags[t].append(said(row[t], names, [own, answer]))
        flags["solved"].append(F.array_contains(row["solved"], f.name))
        flags["asked"].append(F.array_contains(row["asked"], f.name))
        flags["answered"].append(answer.isNotNull())
        flags["valid"].append(own.isNotNull())
        flags["written"].append(of("written", columns[f.name]).isNotNull() if f.name in columns else F.lit(False))

    def word(bits: list[Column]) -> Column:
        return sum((F.when(b, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, b in enumerate(bits)), F.lit(0).cast("long"))

    return F.struct(*[F.array(*[word(bits[k : k + WORD_BITS]) for k in range(0, max(1, len(bits)), WORD_BITS)]).alias(m) for m, bits in flags.items()])


def opened(rows: DataFrame, seen: Column, schema: Schema) -> DataFrame:
    """(page_id, field, a column a stage, final_source, first_loss, reason), a row for each page and field, of the masks ``seen``.

    Each page gives its rows by itself: no shuffle.
    """
    names = F.array(*[F.lit(f.name) for f in _ordered(schema)])
    each = rows.select("page_id", seen.alias("_seen"), F.posexplode(names).alias("_k", "field"))
    bit = lambda m: F.call_function("shiftright", F.get(F.col(f"_seen.{m}"), F.floor(F.col("_k") / WORD_BITS).cast("int")), F.col("_k") % WORD_BITS).bitwiseAND(F.lit(1)) == 1
    flags = each.select("page_id", "field", *[bit(m).alias(f"_{m}") for m in MASKS])
    on = {m: F.col(f"_{m}") for m in MASKS}
    for before, t in zip(TEXTS, TEXTS[1:], strict=False):
        on[t] = on[before] & on[t]  # what one stage lost no later one has
    solved, asked, answered = on["solved"], on["asked"], on["answered"]
    yes = lambda c: F.when(c, "YES").otherwise("NO")
    staged = flags.select(
        "page_id",
        "field",
        *[yes(on[t]).alias(t) for t in TEXTS],
        yes(solved).alias("deterministic"),
        F.when(solved, "SKIPPED (already solved)").when(asked, "INCLUDED").otherwise("NOT APPLICABLE").alias("prompt"),
        F.when(solved | ~asked, "NOT REQUESTED").when(answered, "YES").otherwise("NULL").alias("llm"),
        F.when(solved | (asked & answered), F.when(on["valid"], "PASSED").otherwise("REJECTED")).otherwise("NOT EXECUTED").alias("validator"),
        on["written"].alias("_written"),
    )
    mapped = staged.withColumn("mapper", F.when(F.col("validator") != "PASSED", "EMPTY").when(F.col("_written"), "PASSED").otherwise("DROPPED"))
    lost = F.when(F.lit(False), F.lit(""))
    for t, stage in zip(TEXTS, REASONS, strict=False):
        lost = lost.when(F.col(t) == "NO", stage)
    lost = lost.when(F.col("validator") == "REJECTED", "Validator").when(F.col("llm") == "NULL", "LLM Extraction").when(F.col("mapper") == "DROPPED", "Schema Mapper").when(F.col("prompt") == "NOT APPLICABLE", "Deterministic Extraction")
    arrived = F.col("mapper") == "PASSED"
    source = F.when(~arrived, "None").when(F.col("deterministic") == "YES", "Deterministic").otherwise("LLM")
    out = mapped.drop("_written").withColumns({"dataset": F.when(arrived, "WRITTEN").otherwise("EMPTY"), "final_source": source, "first_loss": lost})
    why = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return out.withColumn("reason", F.element_at(why, F.col("first_loss")))


def journeys(pages: DataFrame, schema: Schema, columns: dict[str, str]) -> DataFrame:
    """:func:`opened` of pages with the columns that :func:`masks` reads, each under its name."""
    pages = pages.withColumns({t: F.lower(t) for t in TEXTS})
    seen = masks(schema, columns, texts={t: F.col(t) for t in TEXTS}, **{m: F.col(m) for m in ("solved", "asked", "answered", "valid", "written")})
    return opened(pages.select("page_id", seen.alias("seen")), F.col("seen"), schema)


def loss_counts(rows: DataFrame) -> DataFrame:
    """(first_loss, fields): how many fields each stage lost, over all pages; null for those that arrived."""
    return rows.groupBy("first_loss").agg(F.count("*").alias("fields"))


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts: fields in all, that each stage still had, and that each stage lost."""
    lost = lambda stage: F.count_if(F.col("first_loss") == stage)
    return rows.agg(
        F.count("*").alias("fields"),
        *[F.count_if(F.col(t) == "YES").alias(f"in_{t}") for t in TEXTS],
        F.count_if((F.col("raw") == "YES") & (F.col("relevant") == "NO")).alias("lost_before_relevant"),
        F.count_if((F.col("relevant") == "YES") & (F.col("blocks") == "NO")).alias("lost_in_blocks"),
        F.count_if(F.col("deterministic") == "YES").alias("solved"),
        F.count_if(F.col("llm") == "YES").alias("answered"),
        F.count_if(F.col("validator") == "PASSED").alias("valid"),
        lost("Deterministic Extraction").alias("lost_in_deterministic"),
        lost("LLM Extraction").alias("lost_in_llm"),
        lost("Validator").alias("lost_in_validator"),
        lost("Schema Mapper").alias("lost_in_mapper"),
        F.count_if(F.col("dataset") == "WRITTEN").alias("written"),
    )


def report(page_rows: list, counts) -> str:
    """One page's journeys as Markdown, of its collected rows and the row of :func:`summary`: for a person who looks at a page."""
    lines = ["# Extraction journey", ""]
    for r in sorted(page_rows, key=lambda r: r["field"]):
        lines += [f"## {r['field']}", "", *[f"- {c}: {r[c]}" for c in (*TEXTS, "deterministic", "prompt", "llm", "validator", "mapper", "dataset", "final_source")]]
        lines += [f"- first loss: {r['first_loss']}: {r['reason']}", ""] if r["first_loss"] else [""]
    return "\n".join([*lines, "## Summary", "", "| count | fields |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in counts.asDict().items()]])
