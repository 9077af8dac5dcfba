"""Joins of a child that may hold a hot key with a frame of one row per key.

Hot keys are measured, not guessed: the child's rows are counted per key (reduced before the
shuffle), and each of the ``MOST_HOT`` largest keys above ``ROWS_PER_SALT`` rows gets as many salts as it has
such shares.  Child rows take a salt by a hash of their own, the other side's row is repeated once per
salt.  The table of hot keys has at most ``MOST_HOT`` rows, so it may be collected and broadcast; a key that
is not in it holds less than a ``MOST_HOT``-th of all rows.  The count runs while the join is being planned,
so a child without hot keys is joined as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT, MOST_HOT = 50_000, 10_000
SALT, SALTS = "_salt", "_salts"


def hot_keys(many: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT, most_hot: int = MOST_HOT) -> DataFrame:
    """``key``, the number of its salts: keys with more than ``rows_per_salt`` rows, at most ``most_hot`` of them, largest first."""
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    largest = counts.where(F.col("_rows") > rows_per_salt).orderBy(F.col("_rows").desc(), key).limit(most_hot)
    return largest.select(key, F.ceil(F.col("_rows") / rows_per_salt).cast("int").alias(SALTS))


def salted(many: DataFrame, one: DataFrame, key: str, spread: Column, rows_per_salt: int = ROWS_PER_SALT,
           most_hot: int = MOST_HOT) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt column: rows of ``many`` dealt by ``spread``, rows of ``one`` once per salt of their key."""
    hot = hot_keys(many, key, rows_per_salt, most_hot)
    return _salted_by(hot.sparkSession.createDataFrame(hot.collect(), hot.schema), many, one, key, spread)


def _salted_by(hot: DataFrame, many: DataFrame, one: DataFrame, key: str, spread: Column) -> tuple[DataFrame, DataFrame]:
    hot = F.broadcast(hot)
    salts = F.coalesce(F.col(SALTS), F.lit(1))
    dealt = many.join(hot, key, "left").withColumn(SALT, F.pmod(spread, salts).cast("int")).drop(SALTS)
    repeated = one.join(hot, key, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), salts - 1))).drop(SALTS)
    return dealt, repeated


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: Column, rows_per_salt: int = ROWS_PER_SALT,
                most_hot: int = MOST_HOT) -> DataFrame:
    """Inner join of ``many`` with ``one`` (one row per key): the plain join's rows, no key in one task."""
    hot = hot_keys(many, key, rows_per_salt, most_hot)
    measured = hot.collect()
    if not measured:
        return many.join(one, key)
    dealt, repeated = _salted_by(hot.sparkSession.createDataFrame(measured, hot.schema), many, one, key, spread)
    return dealt.join(repeated, [key, SALT]).drop(SALT)
