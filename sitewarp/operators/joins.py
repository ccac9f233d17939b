"""Joins that hold when one key carries a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "__salt"


def salted_join(many: DataFrame, one: DataFrame, on: list[str], spread: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """Equi-join ``many`` with ``one``, whose rows are few per key.

    A hot key of ``many`` is spread over ``salts`` reducers by a hash of column ``spread``;
    ``one`` is replicated that many times. ``how`` may be inner, left, left_semi or left_anti.
    Nulls in ``on`` never match, as in any equi-join.
    """
    left = many.withColumn(SALT, F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    right = one.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, SALT], how).drop(SALT)
