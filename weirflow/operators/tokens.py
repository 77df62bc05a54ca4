"""Token streams: DataFrames with a dense position.

A stream holds tokens 0..n-1 in a bigint column `pos` beside its value columns.
Every data-movement operator is arithmetic on `pos`, so streams keep no order
on disk and need none."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

POS = "pos"


@dataclass(frozen=True)
class TokenStream:
    df: DataFrame

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c != POS]

    def at(self, pos: str, where: str | None = None) -> TokenStream:
        """The tokens that pass at other positions; both are SQL over `pos`, whose DIV and % keep whole numbers exact."""
        df = self.df if where is None else self.df.where(where)
        return TokenStream(df.select(F.expr(pos).cast("bigint").alias(POS), *self.values))

    def check(self) -> int:
        """The number of tokens; raises unless positions are 0..n-1."""
        n, k, low, high = self.df.agg(F.count("*"), F.count_distinct(POS), F.min(POS), F.max(POS)).first()
        if n and (k != n or low != 0 or high != n - 1):
            raise ValueError(f"{n} tokens stand at {k} places from {low} to {high}")
        return n


def from_table(df: DataFrame, order_by: Sequence[str], columns: Sequence[str]) -> TokenStream:
    """Rows of a table in a total order as tokens.

    Rows are dealt by ranges of the first key, numbered within their range, and
    a range's first position is the number of rows in the ranges before it, of
    which the driver sees one count a range. Bounds come from a sample drawn by
    hash and stand in the plan, so a part that is computed again after a loss
    numbers its rows as before. No exchange gathers all rows in one partition,
    and rows that share their first key are the most that one task may get.
    """
    keys = [F.col(c) for c in order_by]
    picked = df.select(*dict.fromkeys([*order_by, *columns]))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = sorted({r[0] for r in picked.select(keys[0]).where(keys[0].isNotNull()).orderBy(F.xxhash64(*keys)).limit(32 * parts).collect()})
    bounds = sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []
    part = _range_of(bounds, keys[0])
    dealt = picked.withColumn("__part", F.when(keys[0].isNull(), F.lit(0)).otherwise(part))
    counts = {r["__part"]: r.n for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    first, total = [], 0
    for p in range(len(bounds) + 1):
        first.append(total)
        total += counts.get(p, 0)
    row = F.row_number().over(W.partitionBy("__part").orderBy(*keys)) - 1
    offset = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in first]), F.col("__part") + 1)
    return TokenStream(dealt.withColumn("__row", row).select((offset + F.col("__row")).alias(POS), *columns))


def _range_of(bounds: Sequence, key: Column) -> Column:
    """How many of the bounds (in order) are not over the key, in two steps of
    about the square root of their number each."""
    if not bounds:
        return F.lit(0)
    width = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    under = lambda values: F.size(F.filter(values, lambda b: b <= key))
    group = under(F.array(*[F.lit(g[0]) for g in groups]))
    own = F.element_at(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), F.greatest(F.lit(1), group))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * width + under(own))


def from_dense(df: DataFrame, key: str, columns: Sequence[str], first: int = 0) -> TokenStream:
    """Rows of a table whose key already counts rows without a gap: a
    projection, without any exchange or driver work."""
    return TokenStream(df.select((F.col(key).cast("bigint") - first).alias(POS), *columns))


def from_order(df: DataFrame, order_by: Sequence[str], columns: Sequence[str]) -> TokenStream:
    """Rows numbered by one global window: for tables that fit one task only."""
    row = F.row_number().over(W.orderBy(*order_by)) - 1
    return TokenStream(df.select(row.cast("bigint").alias(POS), *columns))


def counting(spark: SparkSession, n: int, name: str = "v") -> TokenStream:
    return TokenStream(spark.range(n).select(F.col("id").alias(POS), F.col("id").alias(name)))


def zeros(spark: SparkSession, n: int, like: TokenStream) -> TokenStream:
    """n tokens of zeros in the columns of another stream."""
    return TokenStream(spark.range(n).select(F.col("id").alias(POS), *[zero(like.df.schema[c].dataType).alias(c) for c in like.values]))


def zero(kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.StructType):
        return F.struct(*[zero(f.dataType).alias(f.name) for f in kind])
    return F.lit(None).cast(kind)
