"""What a rule is, and how all rules of a table of facts are evaluated at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    check_id: str
    title: str
    severity: str
    confidence: str
    scope: str
    condition: str
    measure: str
    effort: str = "medium"

    @property
    def stage(self) -> str:
        return self.check_id.split(".")[0]

    @property
    def category(self) -> str:
        return "engagement" if self.stage == "act" else "discoverability"


def fired(facts: DataFrame, checks: tuple[Check, ...], keys: list[str]) -> DataFrame:
    """``keys``, check_id and measure of every rule that holds: one scan, one explode."""
    rows = [F.when(F.expr(c.condition), F.struct(F.lit(c.check_id).alias("check_id"), F.expr(f"CAST({c.measure} AS BIGINT)").alias("measure"))) for c in checks]
    return facts.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("x")).select(*keys, "x.check_id", "x.measure")
