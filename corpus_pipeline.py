"""A corpus pipeline: quality, line dedup, near duplicates, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, decontam, jaccard, line_dedup, mixing, quality


def _apart(docs: DataFrame) -> DataFrame:
    """Id, text, and the other columns as one struct, so that no name of theirs meets a name that an operator adds."""
    rest = [F.col(common.quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(0)]).alias("_rest"))


def _whole(done: DataFrame, docs: DataFrame, **instead: Column) -> DataFrame:
    """The columns of ``docs`` again."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | instead
    return done.select(*[own.get(c, F.col(f"_rest.{common.quoted(c)}")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are good by their posterior.

    Null, empty and short texts fail and go.  Rows that repeat each stay or go by themselves, alike.  An empty table gives
    no rows.  All columns keep their values, whatever their names.
    """
    return _whole(quality.judge(_apart(docs)).where("kept"), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of three-line windows; ``n_chars`` follows.  Texts that lose every line go.

    Null and empty texts have no window and stay as they are.  Rows that repeat id and text are one document and keep the
    same lines; documents come in the order of id, null first.  An empty table gives no rows.  Columns but text and
    ``n_chars`` keep their values, whatever their names.
    """
    done = line_dedup.dedup_lines(_apart(docs)).where((F.col("n_removed") == 0) | (F.col("text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_rest.n_chars")) if "n_chars" in docs.columns else None
    return _whole(done, docs, **({} if n_chars is None else {"n_chars": n_chars}))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Documents without words are in no group and stay; of rows that share an id, all go or stay, and
    rows without an id stay, unless they are near one with an id.  An empty table gives no rows.  No column is changed.
    """
    found = common.stored(jaccard.group_near(docs.select("doc_id", "text")))
    gone = found.where(F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts have none and stay, as all do if the benchmark is empty.  Rows that repeat go or stay alike.  An
    empty table gives no rows.  All columns keep their values, whatever their names.
    """
    found = decontam.find_benchmark(_apart(docs), common.table(spark, sf_dir, "benchmark"))
    return _whole(found.where("not contaminated"), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, each as one row that says how often: ``copies``; ``taken`` counts words.

    Each row is decided by its own source and hash, so ids may repeat within and across sources; rows alike in source, id
    and text share a decision.  Null is a source.  Texts without words are taken like others and count nothing.
    An empty table gives no rows.  Columns but the two added keep their values, whatever their names.
    """
    return mixing.mix_rows(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Quality by expectation-maximisation and mixing by hashes are not SQL's; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again in the shared checkpoint folder.

    What a stage stored on its way is deleted once it is written, and its input once the next one is.
    """
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        done = common.settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if k:
            common.discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
