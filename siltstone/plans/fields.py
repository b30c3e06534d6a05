"""Which source owns a field, how two sources merge, and which field a label means."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_empty

# Fixed values: (owner, policy) of the known fields; others belong to the model.
OWNERS: dict[tuple[str, str], tuple[str, ...]] = {
    ("hybrid", "deterministic_first"): ("franchise_name", "brand", "category", "segment", "training", "support", "business_support", "products", "services", "preferred_locations", "expansion_locations", "expected_hours"),
    ("llm", "llm_only"): ("page_type", "industry", "description", "about", "business_model", "concept", "marketing_support", "operational_support", "address", "city", "state", "country", "faq", "additional_information", "metadata", "entities", "source_url", "extracted_at", "confidence", "page_title", "page_summary", "contact_person"),
    ("deterministic", "deterministic_first"): ("founded_year", "franchise_start_year", "operations_commenced", "established_year", "number_of_outlets", "number_of_employees", "franchise_since", "investment_required", "franchise_fee", "royalty", "roi", "payback_period", "agreement_duration", "area_required", "phone", "email", "website", "facebook", "instagram", "linkedin", "twitter", "youtube", "whatsapp_link", "logo", "logo_url", "images", "brochures", "documents"),
    ("deterministic", "deterministic_only"): ("investment_min", "investment_max", "area_min", "area_max"),
}
_STRATEGY = {f: s for s, fields in OWNERS.items() for f in fields}

# Labels that mean a field, in the order tried.
CONCEPTS: dict[str, tuple[str, ...]] = {
    "investment_required": ("investment", "capital", "investment required", "initial investment", "total investment", "capital required"),
    "area_required": ("area", "space", "floor area", "space required", "store size", "area required"),
    "franchise_fee": ("fee", "franchise fee", "joining fee", "signup fee", "entry fee"),
    "agreement_duration": ("agreement", "contract", "term", "tenure", "agreement duration"),
    "expected_hours": ("hours", "working hours", "expected hours"),
    "training": ("training", "training support"),
    "support": ("support", "assistance", "business support"),
    "preferred_locations": ("location", "preferred location", "expansion location", "preferred locations"),
    "number_of_employees": ("employees", "staff", "no of employees", "number of employees"),
    "number_of_outlets": ("outlets", "stores", "units", "number of outlets", "franchise outlets"),
    "established_year": ("established", "founded", "established year", "year founded", "founded year", "operations commenced on", "operational since", "operations since"),
    "franchise_start_year": ("franchise since", "franchising commenced", "franchise start", "franchise since year", "franchising / distribution commenced on", "franchising commenced on", "distribution commenced on"),
    "operations_commenced": ("operations commenced", "business commenced"),
    "phone": ("phone", "mobile", "contact", "tele", "telephone"),
    "email": ("email", "mail", "email address"),
    "website": ("website", "site", "web site", "official website"),
    "address": ("address", "registered office", "head office"),
    "brand": ("brand", "brand name", "name of brand"),
    "franchise_name": ("franchise name", "name of the franchise"),
}
# How a question for yes or no begins, and the fields that such a label never means.
QUESTIONS = ("do you", "do we", "is there", "are there", "has ", "does ", "is it", "is this", "are you", "can ", "should ", "will ", "would ", "have you", "suitable for")
NOT_ASKED = ("agreement_duration", "training", "support", "investment_required", "franchise_fee")


def strategy(field: str) -> tuple[str, str]:
    return _STRATEGY.get(field, ("llm", "llm_only"))


def owner(field: Column) -> Column:
    """Who decides a field, the page, the model or both, for names in a column."""
    out = F.lit(strategy("")[0])
    for who in sorted({w for w, _ in OWNERS}):
        named = [f for (w, _), names in OWNERS.items() if w == who for f in names]
        out = F.when(field.isin(*named), who).otherwise(out)
    return out


def allowed(field: str) -> bool:
    """Whether pages alone may set the field."""
    return strategy(field)[0] in ("deterministic", "hybrid")


def field_for(label: str, aliases: dict[str, str] | None = None) -> str | None:
    """The field that a label means: an alias of the schema, a known label, then either of which one contains the other."""
    return _meant(label.lower().strip().rstrip(":"), tuple((aliases or {}).items()))


@lru_cache(maxsize=4096)
def _meant(key: str, aliases: tuple[tuple[str, str], ...]) -> str | None:
    barred = NOT_ASKED if key.startswith(QUESTIONS) else ()
    fits = lambda f: f not in barred and allowed(f)
    known = [(a, f) for f, words in CONCEPTS.items() for a in words]
    for pairs, near in ((aliases, lambda a: a == key), (known, lambda a: a == key), (aliases, lambda a: a in key or key in a), (known, lambda a: len(a) > 3 and (a in key or key in a))):
        for a, f in pairs:
            if near(a) and fits(f):
                return f
    return None


def field_of(label: Column, aliases: dict[str, str] | None = None) -> Column:
    """``field_for`` as a column: one ordered CASE over the known labels."""
    key = F.regexp_replace(F.lower(F.trim(label)), ":+$", "")
    asks = F.lit(False)
    for q in QUESTIONS:
        asks = asks | key.startswith(q)
    known = [(a, f) for f, words in CONCEPTS.items() for a in words]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pairs, exact in (((aliases or {}).items(), True), (known, True), ((aliases or {}).items(), False), (known, False)):
        for a, f in pairs:
            if not allowed(f) or (not exact and pairs is known and len(a) <= 3):
                continue
            test = key == a if exact else key.contains(a) | F.lit(a).contains(key)
            out = out.when(test & ~asks if f in NOT_ASKED else test, F.lit(f))
    return out


def merged(field: str, page: Column, model: Column, policy: str | None = None) -> tuple[Column, Column]:
    """Value and source (Deterministic, LLM or None) of a field that a page and a model may both give."""
    policy = policy or strategy(field)[1]
    from_page, from_model = (~is_empty(page), page, "Deterministic"), (~is_empty(model), model, "LLM")
    order = {"deterministic_only": [from_page], "deterministic_first": [from_page, from_model], "llm_first": [from_model, from_page]}.get(policy, [from_model])
    value, source = F.when(F.lit(False), page), F.when(F.lit(False), F.lit(""))
    for present, v, s in order:
        value, source = value.when(present, v), source.when(present, F.lit(s))
    return value, source.otherwise(F.lit("None"))


def resolved(name: str, aliases: Iterable[str], found: Column) -> Column:
    """The value in a map under the field's own name or the first alias that is a key of it, even an empty one."""
    keys = list(dict.fromkeys(k for k in (_normal(x) for x in (name, *aliases)) if k))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k in keys:
        out = out.when(F.map_contains_key(found, F.lit(k)), F.element_at(found, F.lit(k)))
    return out


def _normal(name: str) -> str:
    return "_".join(p for p in name.strip().lower().replace("-", " ").replace("_", " ").split() if p)
