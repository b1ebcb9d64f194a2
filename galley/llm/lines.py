"""Line dedup: repeated passages of lines.

``line_dedup`` takes out every repeated passage.  A passage is two or more lines
with more than white space (blank lines between them belong to it), so it
consists of pairs of neighbouring lines, and a line goes if a pair it belongs to
stood at an earlier place (by ``doc_id``, then by place).  No boundary is chosen:
each pair is looked up, whatever stands around it.  What goes is always found
at an earlier place; a place that overlaps a pair's first place (three equal
lines in a row) does not count.  A single line with other neighbours stays.
Repeated hashes only nominate pairs; equal bytes decide, as the pairs are grouped
and joined by their text.

Nulls: a null text has no lines and stays null; a null ``doc_id`` comes last.
Documents of one line and lines of white space alone are left as they are.
Rows with equal ``doc_id`` and text are one document and get one result each.
Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.arrays import let
from galley.llm.common import set_aside, text_or_empty


_PAIRS = "array<struct<at:int,to:int>>"


def line_pairs(lines: Column) -> Column:
    """``(at, to)`` of each two lines with only blank lines between them."""
    full = F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1),
        lambda i: F.trim(F.translate(F.get(lines, i), "\t\r", "  ")) != "",
    )

    def neighbours(f: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(f) - 1),
            lambda k: F.struct(F.get(f, k - 1).alias("at"), F.get(f, k).alias("to")),
        )

    return let(full, lambda f: F.when(F.size(f) >= 2, neighbours(f)).otherwise(F.array().cast(_PAIRS)))


def _passage(lines: Column, pair: Column) -> Column:
    return F.array_join(F.slice(lines, pair["at"] + 1, pair["to"] - pair["at"] + 1), "\n")


def repeated_pairs(rows: DataFrame) -> DataFrame:
    """``doc_id, th, drop``: the pairs of lines each of ``rows(doc_id, th, text)`` loses."""
    # hashes alone travel for all pairs, texts for those whose hash repeats
    hashed = let(
        F.split(text_or_empty(), "\n", -1),
        lambda x: F.transform(
            line_pairs(x), lambda p: F.struct(p["at"].alias("at"), p["to"].alias("to"), F.xxhash64(_passage(x, p)).alias("h"))
        ),
    )
    pairs = rows.select("doc_id", "th", F.inline(hashed))
    again = pairs.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    named = (
        pairs.join(again, "h", "left_semi")
        .groupBy("doc_id", "th")
        .agg(F.collect_set(F.struct("at", "to")).alias("some"))
        .select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "some")
    )
    met = rows.join(named, rows["doc_id"].eqNullSafe(named["_id"]) & (rows["th"] == named["_th"]))
    texts = let(
        F.split(text_or_empty(), "\n", -1),
        lambda x: F.transform(
            "some", lambda p: F.struct(p["at"].alias("at"), p["to"].alias("to"), _passage(x, p).alias("passage"))
        ),
    )
    found = met.select("doc_id", "th", F.inline(texts))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "at")
    ends = F.struct(place.alias("place"), "to")
    first = found.groupBy("passage").agg(F.min(ends).alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = F.col("doc_id").eqNullSafe(F.col("first.place.doc_id")) & (F.col("th") == F.col("first.place.th"))
    later = found.join(first, "passage").filter(~same | (F.col("at") > F.col("first.to")))
    return later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "to")).alias("drop"))


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, and two more columns
    (in place of any so named): ``lines_before`` and ``lines_dropped``."""
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text")]
    more = [c for c, kind in docs.dtypes if c != "text" and (c, kind) != ("doc_id", "bigint")]
    # without further columns both joins read one exchange of the texts
    rows = docs.select(*keys, *([F.struct(*[F.col(f"`{c}`") for c in more]).alias("row")] if more else []))
    gone = repeated_pairs(rows.select("doc_id", "th", "text"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "drop")
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["th"] == gone["_th"]), "left")
    text = F.col("text")
    # by hashing, so that a long document is no square
    left = lambda x: F.array_except(
        F.sequence(F.lit(0), F.size(x) - 1),
        F.flatten(F.transform("drop", lambda p: F.sequence(p["at"], p["to"]))),
    )
    kept = let(F.split(text, "\n", -1), lambda x: F.transform(left(x), lambda i: F.get(x, i)))
    split = joined.withColumn("kept", F.when(F.col("drop").isNotNull(), kept))
    before = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
    counts = {
        "lines_before": before,
        "lines_dropped": F.when(F.col("drop").isNull(), 0).otherwise(before - F.size("kept")),
    }
    return split.select(
        *[F.col(f"row.`{c}`" if c in more else c).alias(c) for c in docs.columns if c != "text" and c not in counts],
        F.when(F.col("drop").isNull(), text).otherwise(F.array_join("kept", "\n")).alias("text"),
        *[value.cast("long").alias(name) for name, value in counts.items()],
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every row."""
    done = drop_repeated_passages(docs.select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("lines_before").alias("n_lines"),
        F.col("lines_dropped").alias("n_removed"),
        F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"),
    )
