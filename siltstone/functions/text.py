"""Names, emptiness, white space and lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as the patterns of this package take it.
S = r"(?U)\s"

# Identities that the pipeline itself fills, and the columns that a schema may ask for.
RESERVED = ("source_url", "extracted_at", "confidence", "page_type", "page_title", "page_summary", "entities", "faq", "additional_information", "metadata")
METADATA_COLUMNS = {"source_url": "Source Url", "page_title": "Page Title"}


def quoted(name: str) -> str:
    """A column's name as ``col`` reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether the text contains one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def strip(c: Column) -> Column:
    """Without white space at either end, not blanks alone as ``trim``."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{S}+", " "))


def is_empty(c: Column) -> Column:
    """Null or empty text; numbers and booleans that are not null count as values."""
    return c.isNull() | (c.cast("string") == "")


def is_empty_list(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def first_filled(*columns: Column) -> Column:
    """The first that is not empty; null if all are."""
    return F.coalesce(*[F.when(~is_empty(c), c) for c in columns])


def field_name(c: Column) -> Column:
    """'Franchise Fee' -> 'franchise_fee'."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)[\s\-]+", "_"), "_+", "_")


def lookup_keys(name: Column, aliases: Column) -> Column:
    """The field's own name and then its aliases, normalised, each once."""
    keys = F.transform(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), field_name)
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def is_reserved(name: Column) -> Column:
    return field_name(name).isin(*RESERVED)


def slug(c: Column, otherwise: str) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(otherwise))


def joined_distinct(items: Column, delimiter: str = " | ") -> Column:
    """Stripped items that are not empty, each once, in order."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda x: x != "")), delimiter)


def merged_list(old: Column, new: Column, delimiter: str) -> Column:
    """``old`` as it is with the items of ``new`` that it lacks behind it; of an empty side the other."""
    parts = lambda c: F.filter(F.transform(F.split(c, f"\\Q{delimiter.strip()}\\E"), strip), lambda x: x != "")
    unseen = F.filter(parts(new), lambda x: ~F.array_contains(parts(old), x))
    return F.when(is_empty(old), new).when(is_empty(new), old).otherwise(F.array_join(F.concat(parts(old), unseen), delimiter))


def mapping_key(c: Column) -> Column:
    """As mappers compare column names: lower case, underscores and hyphens as blanks."""
    return F.trim(F.translate(F.lower(c), "_-", "  "))


#: How a value says that there is none.
NEGATIVE = ("not revealed", "not disclosed", "n/a", "nil", "none", "not specified", "not available")


def says_none(c: Column) -> Column:
    """Whether a value is, or begins with, a phrase for "nothing"."""
    low = F.lower(strip(c))
    out = F.lit(False)
    for phrase in NEGATIVE:
        out = out | low.startswith(phrase)
    return out


def sane_brand(c: Column) -> Column:
    """The brand, or null if it is a sentence: over 60 characters, over 8 words, or with a full stop."""
    words = F.size(F.split(squeeze(c), " "))
    return F.when((F.length(c) <= 60) & (words <= 8) & ~c.contains("."), c)


#: How a question for yes or no begins.
YES_NO = ("do you", "do we", "does the", "does your", "is there", "is it", "are you", "are there", "can i", "can we", "will you", "will the", "have you", "has the", "is the")


def asks_yes_no(c: Column) -> Column:
    out = F.lit(False)
    for phrase in YES_NO:
        out = out | F.lower(strip(c)).startswith(phrase)
    return out


def label_pairs(text: Column) -> Column:
    """``Label: value`` lines as an array of (k, v), if at least two lines are and all others are blank."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), squeeze), lambda x: x != "")
    pattern = r"^(\p{Lu}[^:\n]{0,80}?)\s*:\s*(\S.*)$"
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("k"), F.regexp_extract(x, pattern, 2).alias("v")))
    good = F.forall(pairs, lambda p: (p["k"] != "") & (F.size(F.split(p["k"], " ")) <= 6))
    return F.when((F.size(lines) >= 2) & good, pairs).otherwise(F.filter(pairs, lambda p: F.lit(False)))
