"""From findings to reports: limits, totals, and the written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions import fixed_values as fx
from galley.plans.joins import durable


def first_rows(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group.

    A rank filter alone, so Spark keeps ``k`` rows per group before it
    shuffles: a huge group never gathers in one task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def limited_report(found: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of each (document, check, rule) a report shows, and how many
    more there are; of each item where a check is limited so.  ``limit`` overrides
    the usual number for every check."""
    keys = ["doc_id", "check", "rule", "of"]
    own_item = F.when(F.col("check").isin(fx.REPORT_PER_ITEM), F.col("item"))
    # read for the totals and for the first rows: the checks run once
    found = durable(found).withColumn("of", F.coalesce(own_item, F.lit("")))
    totals = found.groupBy(*keys).agg(F.count("*").alias("n_total"))
    order = [
        F.when(F.col("check") == "long lines", -F.col("n")).otherwise(0),
        "line_no",
        "para_no",
        "item",
        "context",
    ]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) if isinstance(c, str) else c for c in order])
    ranked = found.withColumn("rank", F.row_number().over(w))
    biggest = limit or max(fx.REPORT_LIMIT, *fx.REPORT_LIMITS.values(), *fx.REPORT_RULE_LIMITS.values())
    shown = ranked.filter(F.col("rank") <= biggest)
    k = F.lit(limit or fx.REPORT_LIMIT)
    if limit is None:
        for check, own in fx.REPORT_LIMITS.items():
            k = F.when(F.col("check") == check, own).otherwise(k)
        for rule, own in fx.REPORT_RULE_LIMITS.items():
            k = F.when(F.col("rule") == rule, own).otherwise(k)
    return (
        shown.filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("long"))
        .join(totals, keys)
        .withColumn("n_more", F.greatest(F.col("n_total") - k, F.lit(0)).cast("long"))
        .drop("of")
    )


def summary(found: DataFrame) -> DataFrame:
    """Findings per check and rule, per check, and in all (``ALL``)."""
    return (
        found.rollup("check", "rule")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
        .select(
            F.coalesce("check", F.lit("ALL")).alias("check"),
            F.coalesce("rule", F.lit("ALL")).alias("rule"),
            "n",
            F.col("level").cast("long").alias("level"),
        )
    )


def summary_by_doc(found: DataFrame) -> DataFrame:
    """Findings per document, check and rule, to rank documents by."""
    return found.groupBy("doc_id", "check", "rule").agg(F.count("*").alias("n"))


def write_texts(texts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store ``texts(doc_id, text)`` as text files, one for every document, in a
    folder named by its ``doc_id``."""
    texts.select("doc_id", "text").write.mode(mode).partitionBy("doc_id").option("lineSep", "\n").text(path)


def store_texts(texts: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Store ``texts(doc_id, text)`` as a table with a row for every document, and
    read it back.

    Files follow the size of the texts; a folder and a file for every document, as
    ``write_texts`` makes, are for as many as a file system lists with ease.
    """
    texts.select("doc_id", "text").write.mode(mode).parquet(path)
    return texts.sparkSession.read.parquet(path)


def write_findings(found: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Store findings by check and read them back.

    Rows are dealt by check first, and adaptive execution cuts a large check and
    joins small ones, so the files are as many as the rows need.
    """
    found.hint("rebalance", "check").write.mode(mode).partitionBy("check").parquet(path)
    return found.sparkSession.read.parquet(path)
