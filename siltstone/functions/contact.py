"""Phones, addresses of mail and web, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, squeeze, strip

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?\d[\d\s\-()]{7,18}\d"

# Parameters that only track.
TRACKING = ("fbclid", "gclid", "yclid", "msclkid")


def phone(c: Column) -> Column:
    """Digits, signs and single blanks; ten bare digits, or twelve from 91, get their country code."""
    kept = squeeze(F.regexp_replace(c, r"(?U)[^\d+\-()\s]", ""))
    digits = F.regexp_replace(kept, r"(?U)\D", "")
    bare = ~strip(c).rlike(r"[-() ]")
    return F.when(bare & (F.length(digits) == 10), F.concat(F.lit("+91 "), digits)).when(bare & (F.length(digits) == 12) & digits.startswith("91"), F.concat(F.lit("+91 "), F.substring(digits, 3, 10))).otherwise(kept)


def first_email(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), f"({EMAIL})", 1), F.lit(""))


def first_phone(c: Column) -> Column:
    """The first that looks like one, if it has nine digits; no second is tried."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), f"({PHONE})", 1)
    return F.when(F.length(F.regexp_replace(found, r"\D", "")) >= 9, found)


def domain(url: Column) -> Column:
    """Host in lower case without port and leading ``www.``; a scheme is not needed."""
    full = F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(full, r"^[^:]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def untracked(url: Column) -> Column:
    """Without tracking parameters; a fragment belongs to the last one, and a parameter without a value stays."""
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(f"(?i)^(utm_[^=]*|{'|'.join(TRACKING)})=")), "&")
    base = F.regexp_extract(url, r"^([^?]*)", 1)
    return F.when(~url.contains("?"), url).when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def with_scheme(c: Column) -> Column:
    bare = strip(c)
    return F.when((bare == "") | bare.startswith("http://") | bare.startswith("https://"), bare).otherwise(F.concat(F.lit("https://"), bare))


#: What a field's name contains tells how its value is cleaned; the first kind that fits counts.
KINDS = {
    "phone": ("phone", "mobile", "contact number", "landline"),
    "email": ("email",),
    "url": ("website", "url", "link", "site", "facebook", "instagram", "linkedin", "twitter", "youtube"),
    "money": ("investment", "fee", "royalty", "roi", "capital", "payback", "cost", "price", "revenue"),
    "date": ("date", "year", "since", "established", "founded", "payback period"),
}


def by_kind(key: Column, value: Column) -> Column:
    """A value cleaned as its field's name asks; null is empty."""
    v, k = squeeze(F.coalesce(value, F.lit(""))), F.lower(key)
    as_phone = squeeze(F.regexp_replace(v, r"(?U)[^\d+\-()\sa-zA-Z]", ""))
    mail = F.regexp_extract(F.lower(v), r"(?U)([\w.\-_+]+@[\w.\-_]+\.[a-zA-Z]{2,})", 1)
    link = F.regexp_replace(v, " ", "")
    link = F.when((link == "") | link.rlike("^(http://|https://|ftp://)"), link).otherwise(F.concat(F.lit("https://"), link))
    link = F.when(link.endswith("/") & (F.length(link) - F.length(F.regexp_replace(link, "/", "")) > 2), F.regexp_replace(link, "/+$", "")).otherwise(link)
    money = squeeze(F.translate(v, "–— ", "-- "))
    year = F.regexp_extract(v, r"\b((?:19|20)\d{2})\b", 1)
    full = r"(\d{1,2})[\-/](\d{1,2})[\-/]((?:19|20)\d{2})"
    part = lambda n: F.regexp_extract(v, full, n)
    date = F.when(year == "", v).when(part(3) != "", F.concat(part(3), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"))).otherwise(year)
    return (
        F.when(any_of(k, KINDS["phone"]), as_phone)
        .when(any_of(k, KINDS["email"]), F.when(mail != "", mail).otherwise(F.lower(v)))
        .when(any_of(k, KINDS["url"]), link)
        .when(any_of(k, KINDS["money"]), money)
        .when(any_of(k, KINDS["date"]), date)
        .otherwise(v)
    )
