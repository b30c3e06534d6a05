"""Site configurations, and which one a page's domain has."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contact import domain


def frame(spark: SparkSession, sites: list[tuple[str, str, int]]) -> DataFrame:
    """(domain, site, priority, ord) in the order given; aliases of a site are rows of their own."""
    return spark.createDataFrame([(d.lower(), n, p, k) for k, (d, n, p) in enumerate(sites)], "site_domain string, site string, priority int, ord int")


def from_folder(folder: str) -> list[tuple[str, str, int]]:
    """Domain, name and priority of every ``*/config.json`` below a folder; the one of domain ``*`` is no site."""
    out = []
    for path in sorted(Path(folder).glob("*/config.json")):
        config = json.loads(path.read_text(encoding="utf-8"))
        out += [(d, config["name"], int(config.get("priority", 0))) for d in [config["domain"], *config.get("aliases", [])] if d != "*"]
    return out


#: Domains of sites that are broadcast at most: they are configurations, not data; more are joined by a shuffle.
MOST_SITES = 100_000


def matched(pages: DataFrame, sites: DataFrame, *, default: str = "default") -> DataFrame:
    """``pages`` with ``domain`` and ``site``: that of the highest priority whose domain is the page's or a parent of it.

    Of sites with one domain the best is picked first.  A page then looks up the end of its domain that has one label, two, and so on up to the
    longest domain that a site has, each in a table of the sites of that many labels that travels with the tasks, and keeps
    the best of what it found.  Pages are neither shuffled nor made longer.
    """
    labels = F.size(F.split("site_domain", r"\."))
    best = sites.groupBy("site_domain").agg(F.max(F.struct("priority", (-F.col("ord")).alias("ord"), "site")).alias("found"))
    longest = sites.agg(F.max(labels), F.count("*")).first()
    out = pages.withColumn("domain", domain(F.col("url")))
    parts, found = F.split("domain", r"\."), []
    for k in range(1, (longest[0] or 0) + 1):
        some = best.where(labels == k).select(F.col("site_domain").alias(f"_d{k}"), F.col("found").alias(f"_s{k}"))
        end = F.when(F.size(parts) >= k, F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
        out = out.join(F.broadcast(some) if longest[1] <= MOST_SITES else some, end == F.col(f"_d{k}"), "left").drop(f"_d{k}")
        found.append(f"_s{k}")
    top = F.greatest(*found) if len(found) > 1 else F.col(found[0]) if found else None
    site = top["site"] if top is not None else F.lit(None).cast("string")
    return out.withColumn("site", F.coalesce(site, F.lit(default))).drop(*found)
