"""Kernels: what actors compute on blocks.

A kernel is called with a `Firing`, which has the input streams, their rates,
the output rates, the values of the actor's refinement parameters and the number
of firings, and returns one stream per output. The makers below cover the usual
cases with built-in expressions; `arrow` runs a numpy function over blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weirflow.operators.tokens import POS, TokenStream, counting


@dataclass(frozen=True)
class Firing:
    spark: SparkSession
    ins: Sequence[TokenStream]
    in_rates: Sequence[int]
    out_rates: Sequence[int]
    params: Sequence[int]
    firings: int


Kernel = Callable[[Firing], Sequence[TokenStream]]


def mapped(**columns: Column) -> Kernel:
    """Token by token: 1 in, 1 out, of equal rates."""
    return lambda f: [TokenStream(f.ins[0].df.select(POS, *[c.alias(n) for n, c in columns.items()]))]


def reduced(**aggregates: Column) -> Kernel:
    """A block to one token, by an aggregation that combines before the shuffle."""

    def run(f: Firing) -> list[TokenStream]:
        block = F.expr(f"pos div {f.in_rates[0]}").alias("__f")
        found = f.ins[0].df.groupBy(block).agg(*[c.alias(n) for n, c in aggregates.items()])
        return [TokenStream(found.select(F.col("__f").alias(POS), *aggregates))]

    return run


def zipped(**columns: Column) -> Kernel:
    """One token of each input a firing side by side; columns see input k's value v as ik_v."""

    def run(f: Firing) -> list[TokenStream]:
        sides = [s.df.select(POS, *[F.col(c).alias(f"i{k}_{c}") for c in s.values]) for k, s in enumerate(f.ins)]
        both = reduce(lambda a, b: a.join(b, POS), sides)
        return [TokenStream(both.select(POS, *[c.alias(n) for n, c in columns.items()]))]

    return run


def generated(**columns: Column) -> Kernel:
    """A source: tokens from their positions."""
    return lambda f: [TokenStream(counting(f.spark, f.firings * f.out_rates[0]).df.select(POS, *[c.alias(n) for n, c in columns.items()]))]


def arrow(function: Callable[[dict[str, object]], Mapping[str, object]], schema: str) -> Kernel:
    """One input's block as arrays by column name -> columns of one output block of its rate."""

    def run(f: Firing) -> list[TokenStream]:
        rate, out = f.in_rates[0], f.out_rates[0]

        def block(key, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(POS)
            found = pd.DataFrame(dict(function({c: g[c].to_numpy() for c in g.columns if c not in (POS, "__f")})))
            if len(found) != out:
                raise ValueError(f"a kernel gave {len(found)} tokens, its rate is {out}")
            found.insert(0, POS, key[0] * out + found.index)
            return found

        df = f.ins[0].df.withColumn("__f", F.expr(f"pos div {rate}"))
        return [TokenStream(df.groupBy("__f").applyInPandas(block, f"{POS} bigint, {schema}"))]

    return run


def nothing(f: Firing) -> list[TokenStream]:
    """An actor that only takes part in the schedule."""
    return []


def linear_scan(stream: TokenStream, value: str, keep: float, gain: float = 1.0, out: str = "acc", block: int = 1024) -> TokenStream:
    """acc[n] = keep * acc[n-1] + gain * value[n], in parallel.

    Within a block of positions acc is keep^i times the running sum of
    value[j] / keep^j, a window over the block; across blocks, what blocks hand
    on is the same scan over their ends with keep ** block, one level up, until
    one block is left. No task gets more than a block."""
    if keep == 0:
        return TokenStream(stream.df.select(POS, (F.col(value).cast("double") * gain).alias(out)))
    if abs(keep) != 1:  # powers stay within what a double holds
        block = max(2, min(block, int(200 / abs(math.log10(abs(keep))))))
    df = stream.df.select(POS, (F.col(value).cast("double") * gain).alias("__x"), F.expr(f"pos div {block}").alias("__f"), F.expr(f"pos % {block}").alias("__i"))
    power = F.pow(F.lit(float(keep)), F.col("__i"))
    running = F.sum(F.col("__x") / power).over(W.partitionBy("__f").orderBy(POS))
    own = df.select(POS, "__f", "__i", (running * power).alias("__own"))
    last = stream.df.agg(F.max(POS)).first()[0]
    if last is None or last < block:
        return TokenStream(own.select(POS, F.col("__own").alias(out)))
    ends = TokenStream(own.where(f"__i = {block - 1}").select(F.col("__f").alias(POS), F.col("__own").alias("end")))
    given = linear_scan(ends, "end", keep**block, 1.0, "__carry", block).df.select((F.col(POS) + 1).alias("__g"), "__carry")
    whole = own.join(given, F.col("__f") == F.col("__g"), "left")
    return TokenStream(whole.select(POS, (F.col("__own") + F.coalesce("__carry", F.lit(0.0)) * power * keep).alias(out)))
