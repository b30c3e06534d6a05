"""URL filter: a sorted sweep over reversed-host keys with a stack of nested rules.

Every rule ``host/path`` becomes the key ``reversed labels + path``; all urls that it fits under one
host have keys that begin with it, so the rule is the interval [key, key + 0xFF).  A url is probed
under its own host and under each parent domain that is as deep as some rule's host.  Intervals of
prefixes either nest or are apart, so in key order the number of open intervals is the height of a
stack, and the innermost open rule at a probe is the last rule that started at that height.  Two
window functions over one sort order compute both: a running sum of starts less ends, and the last
start within each height.  The longest rule over a url's domains wins.

Scale: the key line is cut into cells at quantiles of the rules' keys (at most ``MAX_CELLS``, so the
bounds are a short literal), and each cell is dealt to as many salts as its share of the probes asks for.  Rules
are copied to the salts of their cells, probes go to one salt each: a host that holds a third of all
urls spreads over many tasks, and nothing is broadcast.  Only ids, hosts and paths are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import lower_ascii, quoted

#: Cells of the key line at most.
MAX_CELLS = 64
#: Rules from which the key line is cut at all; fewer go to every salt of a single cell.
RULES_PER_CELL = 4096

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host_labels_reversed: Column, path: Column) -> Column:
    """No host has a ``/``, so one sets the host apart from the path."""
    return F.concat(F.array_join(host_labels_reversed, "."), F.lit("/"), path).cast("binary")


#: A fit is one long: the rule's length, its number of host labels, and whether it blocks.
_LEN, _DEPTH = 1 << 24, 1 << 1


def prepared(rules: DataFrame) -> DataFrame:
    """(key, depth, fit): one row a host and path; of contrary rules, block wins.

    A rule without a ``/`` has an empty path.  Rules that are null or have no host fit nothing and are dropped.
    """
    host = lower_ascii(F.regexp_extract("rule", r"(?s)^([^/]*)", 1))
    path = F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    labels = F.split(host, r"\.")
    blocks = (F.coalesce("verdict", F.lit("block")) == "block").cast("long")
    return (
        rules.where(F.col("rule").isNotNull() & (host != ""))
        .select(
            key_of(F.reverse(labels), path).alias("key"),
            F.size(labels).alias("depth"),
            ((F.length(host) + F.length(path)).cast("long") * _LEN + F.size(labels) * _DEPTH + blocks).alias("fit"),
        )
        .groupBy("key", "depth")
        .agg(F.max("fit").alias("fit"))
    )


def filter_urls(docs: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``docs``.

    The longest rule that fits wins; of two as long, the one with the deeper host.  No rule fits: rule
    is null and the verdict is ``default``.  A null url, or one without ``://``, has empty host and path.
    Repeated rows are all returned; columns of ``docs`` other than the two named are not read.
    """
    spark = docs.sparkSession
    ready = prepared(rules)
    about = ready.agg(F.count("*").alias("n"), F.collect_set("depth").alias("depths")).first()
    n_rules, depths = about["n"], sorted(about["depths"] or [])
    pages = docs.select(F.col(quoted(id_col)).alias("_id"), host_of(F.col(quoted(url_col))).alias("_host"), path_of(F.col(quoted(url_col))).alias("_path"))
    named = [F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path")]
    if not n_rules:
        return pages.select(*named, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    bounds: list[bytes] = []
    if n_rules > RULES_PER_CELL:
        n_cells = min(MAX_CELLS, n_rules // RULES_PER_CELL + 1)
        least = ready.select("key").repartitionByRange(n_cells, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
        bounds = sorted(bytes(r["key"]) for r in least.collect())[1:]  # a row a cell

    def cell(key: Column) -> Column:
        return F.size(F.filter(F.array(*[F.lit(bytearray(b)) for b in bounds]), lambda b: b <= key)) if bounds else F.lit(0)

    labels = F.reverse(F.split("_host", r"\."))
    fitting = F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: d <= F.size(labels))
    probes = pages.withColumn("key", F.explode_outer(F.transform(fitting, lambda d: key_of(F.slice(labels, 1, d), F.col("_path"))))).withColumn(
        "key", F.coalesce("key", F.unhex(F.lit("00")))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = {0: 1}
    if bounds:
        asked = {r["c"]: r["n"] for r in probes.groupBy(cell(F.col("key")).alias("c")).agg(F.count("*").alias("n")).collect()}
    salts = F.array(*[F.lit(max(1, -(-parts * asked.get(c, 0) // sum(asked.values())))) for c in range(len(bounds) + 1)])

    end = F.concat(F.col("key"), F.unhex(F.lit("FF")))
    edge = lambda key, step: F.struct(key.alias("key"), F.lit(step).alias("step"))
    edges = (
        ready.withColumn("cell", F.explode(F.sequence(cell(F.col("key")), cell(end))))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.element_at(salts, F.col("cell") + 1) - 1)))
        .withColumn("e", F.explode(F.array(edge(F.col("key"), 1), edge(end, -1))))
        .select("cell", "salt", "e.key", "e.step", "fit")
    )
    dealt = (
        probes.withColumn("cell", cell(F.col("key")))
        .withColumn("salt", F.pmod(F.xxhash64("_id", "_host", "_path"), F.element_at(salts, F.col("cell") + 1)).cast("int"))
        .withColumn("step", F.lit(0))
    )
    order = [F.col("key"), F.col("step").desc()]
    upto = (W.unboundedPreceding, W.currentRow)
    swept = (
        dealt.unionByName(edges, allowMissingColumns=True)
        .withColumn("height", F.sum("step").over(W.partitionBy("cell", "salt").orderBy(*order).rowsBetween(*upto)))
        .withColumn("top", F.last(F.when(F.col("step") == 1, F.col("fit")), ignorenulls=True).over(W.partitionBy("cell", "salt", "height").orderBy(*order).rowsBetween(*upto)))
        .where("step = 0")
    )
    best = swept.groupBy("_id", "_host", "_path").agg(F.max(F.when(F.col("height") > 0, F.col("top"))).alias("fit"), F.count("*").alias("n"))
    length, depth = F.expr(f"cast(fit div {_LEN} as int)"), F.expr(f"cast(fit % {_LEN} div {_DEPTH} as int)")
    suffix = F.array_join(F.reverse(F.slice(labels, F.lit(1), depth)), ".")
    return (
        best.withColumn("_again", F.explode(F.expr(f"sequence(1L, n div greatest(size({_sql_depths(depths)}), 1))")))
        .withColumn("_suffix", F.when(F.col("fit").isNotNull(), suffix))
        .select(
            *named,
            F.concat(F.col("_suffix"), F.substr(F.col("_path"), F.lit(1), length - F.length("_suffix"))).alias("rule"),
            F.when(F.col("fit").isNull(), F.lit(default)).when(F.col("fit") % 2 == 1, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        )
    )


def _sql_depths(depths: list[int]) -> str:
    """The depths that a row was probed at, as SQL."""
    return f"filter(array({', '.join(map(str, depths))}), d -> d <= size(split(_host, '[.]')))"
