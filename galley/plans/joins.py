"""Joins against lookup tables of unknown size, safe against hot keys."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
PLAN_BYTES = 256 << 10
SALTS = 32


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the cluster."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Take ``spark.checkpoint.dir``; make up a folder in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="galley-checkpoint-")
    context.setCheckpointDir(shared)


@dataclass(frozen=True)
class Lookup:
    """A table with one row per key, stored once and measured.

    Up to ``BROADCAST_BYTES`` it is broadcast, so the large side is not
    shuffled at all.  Beyond that both sides are shuffled on the key plus a
    salt: the lookup is copied to every salt, and rows of a hot key spread
    over as many tasks.
    """

    table: DataFrame
    n_bytes: int
    limit: int = BROADCAST_BYTES
    salts: int = SALTS

    @classmethod
    def of(cls, table: DataFrame, limit: int = BROADCAST_BYTES, salts: int = SALTS) -> Lookup:
        stored = durable(table)
        widths = [
            F.coalesce(F.octet_length(F.col(c) if t == "string" else F.to_json(F.struct(c))), F.lit(0))
            if t == "string" or t.startswith("array")
            else F.lit(8)
            for c, t in stored.dtypes
        ]
        per_row = sum(widths[1:], widths[0]) + 16 * len(widths)
        size = stored.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("b")).first()["b"]
        return cls(stored, size, limit, salts)

    @property
    def small(self) -> bool:
        return self.n_bytes <= self.limit

    def listed(self, column: str, limit: int = PLAN_BYTES) -> list | None:
        """The values of a column if they are few enough to stand in a plan."""
        if self.n_bytes > limit:
            return None
        return sorted({r[0] for r in self.table.select(column).collect()})

    def join(self, large: DataFrame, on: list[str], how: str, spread_by: list[str]) -> DataFrame:
        """``large JOIN lookup``; ``spread_by`` are columns of ``large`` that
        differ between rows of one key (the salt is a hash of them)."""
        if self.small:
            return large.join(F.broadcast(self.table), on, how)
        if set(on) >= set(spread_by):  # a hash of the key itself spreads nothing
            raise ValueError(f"{spread_by} do not differ between rows of one {on}")
        salted = large.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(self.salts)))
        copies = self.table.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.salts - 1).cast("long")))
        )
        return salted.join(copies, [*on, "_salt"], how).drop("_salt")

    def join_unique(self, large: DataFrame, on: list[str], how: str) -> DataFrame:
        """``large JOIN lookup`` where ``large`` has few rows per key (a line, a
        document): no key can be hot, so beyond the limit it is a plain join."""
        return large.join(F.broadcast(self.table) if self.small else self.table, on, how)
