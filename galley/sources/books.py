"""Reading documents: ``books(doc_id, text)``, one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.arrays import let

BOM = "\ufeff"


def from_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents held in a table; a missing text is an empty one."""
    return df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def from_parquet(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tasks: int | None = None,
) -> DataFrame:
    """Documents of a Parquet table, in the splits of its files.

    ``tasks`` deals them out anew, for a table that one row group holds; left
    out, nothing is shuffled, whatever the table's size.
    """
    books = from_table(spark.read.parquet(path), id_col, text_col)
    return books if tasks is None else books.repartition(tasks, "doc_id")


def from_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One UTF-8 text file per document; the key is a hash of the file path."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"),
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("path"),
    )


def text_body(text: Column) -> Column:
    """The text with ``\\n`` line ends, no byte-order mark and no last line end."""

    def unmarked(t: Column) -> Column:
        body = F.when(F.startswith(t, F.lit(BOM)), F.substr(t, F.lit(2))).otherwise(t)
        return F.replace(body, F.lit("\r\n"), F.lit("\n"))

    return let(
        let(text, unmarked),
        lambda b: F.when(F.endswith(b, F.lit("\n")), F.left(b, F.length(b) - 1)).otherwise(b),
    )


def line_array(text: Column) -> Column:
    """Lines of a text without their ends; a last line end opens no line."""
    none = F.array().cast("array<string>")
    return let(
        text, lambda t: F.when(t == "", none).otherwise(F.split(text_body(t), "\n", -1))
    )
