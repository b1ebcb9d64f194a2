"""The one result table every check returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = {
    "doc_id": "long",
    "check": "string",
    "rule": "string",
    "line_no": "long",
    "para_no": "long",
    "item": "string",
    "n": "long",
    "context": "string",
}


def findings(
    df: DataFrame,
    check: str,
    rule: Column | str | None = None,
    line_no: Column | None = None,
    para_no: Column | None = None,
    item: Column | None = None,
    n: Column | None = None,
    context: Column | None = None,
) -> DataFrame:
    """Shape ``df`` as findings; what a check does not have is NULL."""
    given = {
        "doc_id": F.col("doc_id"),
        "check": F.lit(check),
        "rule": F.lit(check) if rule is None else F.lit(rule) if isinstance(rule, str) else rule,
        "line_no": line_no,
        "para_no": para_no,
        "item": item,
        "n": n,
        "context": context,
    }
    return df.select(
        *[
            (F.lit(None) if given[c] is None else given[c]).cast(t).alias(c)
            for c, t in COLUMNS.items()
        ]
    )


FINDINGS = "array<struct<" + ", ".join(f"{c}: {t}" for c, t in COLUMNS.items() if c != "doc_id") + ">>"


def finding(
    check: str | Column,
    rule: Column | str | None = None,
    line_no: Column | None = None,
    para_no: Column | None = None,
    item: Column | None = None,
    n: Column | None = None,
    context: Column | None = None,
) -> Column:
    """One finding as a struct, for checks worked out inside a document's row."""
    named = F.lit(check) if isinstance(check, str) else check
    given = {
        "check": named,
        "rule": named if rule is None else F.lit(rule) if isinstance(rule, str) else rule,
        "line_no": line_no,
        "para_no": para_no,
        "item": item,
        "n": n,
        "context": context,
    }
    return F.struct(
        *[
            (F.lit(None) if given[c] is None else given[c]).cast(t).alias(c)
            for c, t in COLUMNS.items()
            if c != "doc_id"
        ]
    )


def gathered(*arrays: Column) -> Column:
    """Arrays of findings as one; a NULL array counts as empty."""
    return F.concat(*[F.coalesce(a, F.array()).cast(FINDINGS) for a in arrays])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
