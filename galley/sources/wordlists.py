"""Word lists, the he/be list and dictionaries as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import fixed_values as fx
from galley.functions.text import find_all, title_case, upper_case
from galley.operators.derived import plain_paragraphs
from galley.sources.books import BOM, text_body


def _without_bom(word: Column) -> Column:
    return F.when(F.startswith(word, F.lit(BOM)), F.substr(word, F.lit(2))).otherwise(word)


def good_words(listed: DataFrame) -> DataFrame:
    """``good_words(word)`` from a list of words, one per row.

    Blank rows are skipped and straight apostrophes curled; an all-lower word
    also counts in Title and UPPER form, a Title word also in UPPER.
    """
    word = F.replace(_without_bom(F.col("word")), F.lit("'"), F.lit("’"))
    return (
        listed.filter("word != ''")
        .select(word.alias("word"))
        .select(
            F.explode(
                F.array_compact(
                    F.array(
                        F.col("word"),
                        F.when(F.lower("word") == F.col("word"), title_case(F.col("word"))),
                        F.when(
                            (F.lower("word") == F.col("word"))
                            | (title_case(F.col("word")) == F.col("word")),
                            upper_case(F.col("word")),
                        ),
                    )
                )
            ).alias("word")
        )
        .distinct()
    )


def scanno_list(listed: DataFrame) -> DataFrame:
    """``scannos(word)``: each word and its Title and UPPER forms."""
    return (
        listed.select(_without_bom(F.col("word")).alias("word"))
        .select(
            F.explode(
                F.array(
                    F.col("word"), title_case(F.lower("word")), upper_case(F.lower("word"))
                )
            ).alias("word")
        )
        .distinct()
    )


def common_scannos(spark: SparkSession) -> DataFrame:
    """The built-in list of commonly mis-scanned words, with their forms."""
    rows = [(w,) for w in fx.COMMON_SCANNOS]
    return scanno_list(spark.createDataFrame(rows, "word string"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Words of a text file, one per line."""
    return spark.read.text(path).select(F.col("value").alias("word"))


def hebe_counts(files: DataFrame) -> DataFrame:
    """``hebe(doc_id, form, phrase, n)`` from he/be list files.

    ``files`` is ``(doc_id, text)``, one row per file.  Rows ``w1|he|w2:n``
    count between the marker lines of their form; a phrase listed twice keeps
    its last count.
    """
    parts = []
    for form, begin, end in [("be", fx.BEGIN_BE, fx.END_BE), ("he", fx.BEGIN_HE, fx.END_HE)]:
        section = rf"(?:^|\n)\Q{begin}\E(?=\n)(?s:(.*?))(?=\n\Q{end}\E\n|\z)"
        rows = F.regexp_extract_all(
            F.concat(text_body(F.col("text")), F.lit("\n")), F.lit(section), F.lit(1)
        )
        listed = F.flatten(F.transform(rows, lambda r: F.split(r, "\n", -1)))
        parts.append(
            files.select("doc_id", F.lit(form).alias("form"), F.posexplode(listed).alias("pos", "row"))
        )
    markers = [fx.BEGIN_HE, fx.END_HE, fx.BEGIN_BE, fx.END_BE]
    count = F.split_part(F.col("row"), F.lit(":"), F.lit(2))
    return (
        parts[0]
        .unionByName(parts[1])
        .filter(F.contains("row", F.lit(":")) & ~F.col("row").isin(markers))
        .select(
            "doc_id",
            "form",
            "pos",
            F.replace(F.split_part(F.col("row"), F.lit(":"), F.lit(1)), F.lit("|"), F.lit(" ")).alias("phrase"),
            F.coalesce(F.when(count.rlike(r"^[+-]?\d+\z"), count.try_cast("long")), F.lit(0)).alias("n"),
        )
        .groupBy("doc_id", "form", "phrase")
        .agg(F.max_by("n", "pos").alias("n"))
    )


def hebe_train(books: DataFrame) -> DataFrame:
    """``hebe(form, phrase, n)`` counted over trusted documents."""
    paras = plain_paragraphs(books).select(F.lower("text").alias("text"))
    found = [
        paras.select(F.lit(form).alias("form"), F.explode(find_all(F.col("text"), triple)).alias("phrase"))
        for form, triple in [("be", fx.TRIPLE_BE), ("he", fx.TRIPLE_HE)]
    ]
    return found[0].unionByName(found[1]).groupBy("form", "phrase").agg(F.count("*").alias("n"))


def dictionary(listed: DataFrame) -> DataFrame:
    """``accepted(word)``: dictionary words with their Title and UPPER forms."""
    return (
        listed.select(F.replace(F.col("word"), F.lit("'"), F.lit("’")).alias("word"))
        .select(
            F.explode(F.array(F.col("word"), title_case(F.col("word")), upper_case(F.col("word")))).alias("word")
        )
        .distinct()
    )
