"""Graphs over unbounded streams: micro-batches in, whole iterations out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirflow.operators.tokens import POS, TokenStream, from_table


def run_stream(source: DataFrame, folder: str, order_by: list[str], columns: list[str], tokens: int, step: Callable[[TokenStream, int, int], DataFrame], sink: str, once: bool = True) -> StreamingQuery:
    """Feed a streaming DataFrame to `step` in whole iterations.

    Micro-batches are ordered by `order_by` and cut into iterations of `tokens`
    tokens; step(stream, iterations, first iteration) gives the rows to append
    to `sink`. What is left over waits in `folder` for the next batch. Batch k
    reads the state of batch k - 1 and overwrites its own and its own part of
    the sink, so a batch that is run again after a failure leaves one result.
    """
    spark = source.sparkSession

    def batch(df: DataFrame, k: int) -> None:
        done, rest = 0, None
        if k > 0:
            done = spark.read.parquet(f"{folder}/done/{k - 1}").first()[0]
            rest = spark.read.parquet(f"{folder}/rest/{k - 1}")
        fresh = df.select(*dict.fromkeys([*order_by, *columns]))
        whole = fresh if rest is None else rest.unionByName(fresh)
        whole = whole.persist()
        n = whole.count() // tokens
        stream = from_table(whole, order_by, list(dict.fromkeys([*order_by, *columns])))
        step(stream.at("pos", f"pos < {n * tokens}"), n, done).write.mode("overwrite").parquet(f"{sink}/batch={k}")
        stream.df.where(F.col(POS) >= n * tokens).drop(POS).write.mode("overwrite").parquet(f"{folder}/rest/{k}")
        spark.createDataFrame([(done + n,)], "done bigint").write.mode("overwrite").parquet(f"{folder}/done/{k}")
        whole.unpersist()

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()
