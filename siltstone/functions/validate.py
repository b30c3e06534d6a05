"""Checks of a record's fields: each gives the normalised value, or null for one that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contact, money
from .text import any_of, is_empty, strip

# Names that stand for no name, answers that are no duration, and hints of a currency and of an area.
PLACEHOLDERS = ("franchise opportunity", "franchise opportunities", "franchise for sale")
NO_DURATION = ("yes", "no", "true", "false")
CURRENCY = ("rs", "₹", "$", "inr", "lakh", "crore", "cr", "l")
AREA = ("sq", "feet", "yard", "meter", "acre", "ft", "sft")


def name(c: Column) -> Column:
    return F.when(~F.lower(strip(c)).isin(*PLACEHOLDERS), strip(c))


def year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d\d)\b", 1), F.lit(""))


def duration(c: Column) -> Column:
    """The first number; a text without one as it is; null for yes and no."""
    low = F.lower(strip(c))
    found = F.regexp_extract(low, f"({money.NUMBER})", 1)
    n = found.cast("double")
    return F.when(low.isin(*NO_DURATION), F.lit(None).cast("string")).when(found == "", strip(c)).when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))


def phones(c: Column) -> Column:
    """Of the comma-separated parts those that are phones, and no range of numbers; null if none is."""

    def good(p: Column) -> Column:
        halves = F.transform(F.split(p, "-"), strip)
        span = p.contains("-") & ~p.startswith("+") & (F.size(halves) == 2) & F.forall(halves, lambda h: h.rlike(r"^\d+$")) & (F.length(F.get(halves, F.lit(1))) <= 5)
        return p.rlike(r"^\+?[\d\s\-()]{7,22}$") & (F.length(F.regexp_replace(p, r"\D", "")) >= 7) & ~span

    parts = F.filter(F.transform(F.split(strip(c), ","), strip), good)
    return F.nullif(F.array_join(F.transform(parts, contact.phone), ", "), F.lit(""))


def email(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.rlike(f"^{contact.EMAIL}$"), low)


def numbers(c: Column) -> Column:
    """All numbers, joined by " - "; null if there is none."""
    return F.nullif(F.array_join(F.regexp_extract_all(c, F.lit(f"({money.NUMBER})"), F.lit(1)), " - "), F.lit(""))


def investment(c: Column) -> Column:
    return F.when(any_of(F.lower(c), CURRENCY) | c.rlike(r"\d"), money.investment_text(strip(c)))


def area(c: Column) -> Column:
    return F.when(any_of(F.lower(c), AREA) | c.rlike(r"\d"), money.area_text(strip(c)))


#: Fields are known by their literal names.
CHECKS = {
    "franchise_name": name,
    "established_year": year,
    "founded_year": year,
    "franchise_start_year": year,
    "agreement_duration": duration,
    "phone": phones,
    "email": email,
    "roi": numbers,
    "investment_required": investment,
    "franchise_fee": investment,
    "royalty": investment,
    "area_required": area,
    "expected_hours": money.hours_text,
    "website": contact.with_scheme,
}
#: Of which the log says what they were.
TRACKED = ("established_year", "founded_year", "franchise_start_year", "agreement_duration", "phone", "email", "roi", "investment_required", "franchise_fee", "area_required")


def validated(records: DataFrame, log: str = "normalized_from") -> DataFrame:
    """``records`` with every known field checked, and a map of the tracked ones that changed to what they were.

    Empty values stay as they are.  All checks are one projection.
    """
    present = [c for c in records.columns if c in CHECKS]
    checked = {c: F.when(is_empty(F.col(c)), F.col(c)).otherwise(CHECKS[c](F.col(c).cast("string"))) for c in present}
    out = records.select("*", *[v.alias(f"_new_{c}") for c, v in checked.items()])
    changed = [F.when(~is_empty(F.col(c)) & ~is_empty(F.col(f"_new_{c}")) & (F.col(c) != F.col(f"_new_{c}")), F.struct(F.lit(f"{log}_{c}").alias("key"), F.col(c).alias("value"))) for c in present if c in TRACKED]
    logged = F.map_from_entries(F.array_compact(F.array(*changed))) if changed else F.create_map().cast("map<string,string>")
    return out.select(*[F.col(f"_new_{c}").alias(c) if c in checked else F.col(c) for c in records.columns], logged.alias(log))


def ranges(records: DataFrame) -> DataFrame:
    """``records`` with the ends of investment and area as doubles, read from their normalised texts."""
    out = records
    for field, to, of in (("investment_required", "investment", money.investment_range), ("area_required", "area", money.area_range)):
        if field in records.columns:
            ends = of(F.col(field))
            out = out.withColumns({f"{to}_min": ends["low"].cast("double"), f"{to}_max": ends["high"].cast("double")})
    return out


def required(records: DataFrame, fields: list[str], url: str = "source_url", title: str = "page_title") -> DataFrame:
    """``records`` with a missing url and title or name filled from the page, and ``missing``, the required fields still empty."""
    out = records
    if "url" in records.columns:
        out = out.withColumn("url", F.when(is_empty(F.col("url")), F.col(url)).otherwise(F.col("url")))
    for c in ("title", "name"):
        if c in records.columns:
            out = out.withColumn(c, F.when(is_empty(F.col(c)), F.when(is_empty(F.col(title)), F.col(url)).otherwise(F.col(title))).otherwise(F.col(c)))
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(is_empty(F.col(f)), F.lit(f)) for f in fields])))
