"""Sources and sinks of streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from weirflow.operators.tokens import POS, TokenStream, from_dense, from_table


def parquet(spark: SparkSession, path: str, order_by: Sequence[str], columns: Sequence[str], dense: bool = False) -> TokenStream:
    """A Parquet table as a stream; dense: order_by[0] counts its rows from 0."""
    df = spark.read.parquet(path)
    return from_dense(df, order_by[0], columns) if dense else from_table(df, order_by, columns)


def buffer(spark: SparkSession, values: Sequence, kind: str = "bigint", name: str = "v") -> TokenStream:
    """A list that the caller holds."""
    return TokenStream(spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"{POS} bigint, {name} {kind}"))


def collected(stream: TokenStream) -> list:
    """Tokens in order, to a caller who knows that they are few."""
    rows = stream.df.orderBy(POS).collect()
    return [r[1] if len(stream.values) == 1 else tuple(r[1:]) for r in rows]


def write_parquet(stream: TokenStream, path: str, mode: str = "error") -> None:
    """Tokens with their positions; files are in ranges of positions, so that slices read few of them."""
    stream.df.repartitionByRange(POS).sortWithinPartitions(POS).write.mode(mode).parquet(path)


def as_table(stream: TokenStream) -> DataFrame:
    return stream.df
