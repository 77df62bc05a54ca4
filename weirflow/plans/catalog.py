"""Registered dataflow queries and their SQL.

Stream E is `events` by event_id (which counts its rows), stream O `orders` by
o_orderkey. Sums of doubles are rounded, since their last bits depend on order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import motion, neural
from weirflow.functions.expr import Expression
from weirflow.operators import kernels as K
from weirflow.operators import movement as M
from weirflow.operators.tokens import TokenStream, from_dense, from_table
from weirflow.plans import lineage, repetition
from weirflow.plans.expand import unroll
from weirflow.plans.graph import Graph
from weirflow.plans.lower import complete_iterations, lower
from weirflow.plans.rewrite import optimize
from weirflow.plans.runtime import Runtime
from weirflow.plans.schedule import Platform, Processor, as_table, schedule, statistics

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

E_SQL = "WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, value AS v, event_id FROM events) "
O_SQL = "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_totalprice AS v FROM orders) "


def query(sql: str | None, name: str = "") -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return keep


def events(spark: SparkSession, sf: str) -> TokenStream:
    return from_dense(spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("value").alias("v")), "event_id", ["v"])


def orders(spark: SparkSession, sf: str) -> TokenStream:
    return from_table(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("v")), ["o_orderkey"], ["v"])


@query(E_SQL + "SELECT pos // 10 AS pos, round(sum(v) FILTER (pos % 10 < 3), 4) AS s3, round(sum(v) FILTER (pos % 10 >= 3), 4) AS s7 FROM e WHERE pos < (SELECT count(*) // 10 * 10 FROM e) GROUP BY 1")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """events -> fork(3, 7) -> two sums a firing -> zip, as a graph."""
    g = Graph("flagship")
    source = g.add("extern_in", "events", 0, 1)
    cut = g.add("fork", "cut", 1, 2)
    a, b = (g.actor(n, 1, 1, K.reduced(s=F.sum("v"))) for n in ("three", "seven"))
    both = g.actor("both", 2, 1, K.zipped(s3=F.round("i0_s", 4), s7=F.round("i1_s", 4)))
    out = g.add("extern_out", "result", 1, 0)
    g.edge(source, 0, 10, cut, 0, 10)
    g.edge(cut, 0, 3, a, 0, 3)
    g.edge(cut, 1, 7, b, 0, 7)
    g.edge(a, 0, 1, both, 0, 1)
    g.edge(b, 0, 1, both, 1, 1)
    g.edge(both, 0, 1, out, 0, 1)
    stream = events(spark, sf)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    return lower(g, spark, {"events": stream}, complete_iterations(g, "events", n)).outputs["result"].df


@query(E_SQL + "SELECT pos // 10 * 3 + pos % 10 AS pos, v FROM e WHERE pos % 10 < 3")
def fork_slice_0(spark: SparkSession, sf: str) -> DataFrame:
    return M.fork(events(spark, sf), 10, [3, 7])[0].df


@query(E_SQL + "SELECT pos // 10 * 7 + pos % 10 - 3 AS pos, v FROM e WHERE pos % 10 >= 3")
def fork_slice_1(spark: SparkSession, sf: str) -> DataFrame:
    return M.fork(events(spark, sf), 10, [3, 7])[1].df


@query(E_SQL + "SELECT pos, v FROM e")
def join_concat(spark: SparkSession, sf: str) -> DataFrame:
    return M.join(M.fork(events(spark, sf), 10, [3, 7]), [3, 7], 10).df


@query(E_SQL + "SELECT pos // 10 * 4 + pos % 10 AS pos, v FROM e WHERE pos % 10 < 4")
def head_block(spark: SparkSession, sf: str) -> DataFrame:
    return M.head([events(spark, sf)], [10], 4).df


@query(E_SQL + "SELECT pos // 10 * 4 + pos % 10 - 6 AS pos, v FROM e WHERE pos % 10 >= 6")
def tail_block(spark: SparkSession, sf: str) -> DataFrame:
    return M.tail([events(spark, sf)], [10], 4).df


@query(E_SQL + "SELECT pos // 10 * 5 + pos % 10 AS pos, v FROM e WHERE pos % 10 < 5")
def head_two_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return M.head(M.fork(events(spark, sf), 10, [3, 7]), [3, 7], 5).df


@query(E_SQL + "SELECT pos // 10 * 8 + pos % 10 - 2 AS pos, v FROM e WHERE pos % 10 >= 2")
def tail_two_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return M.tail(M.fork(events(spark, sf), 10, [3, 7]), [3, 7], 8).df


@query(E_SQL + "SELECT f * 25 + j AS pos, v FROM (SELECT DISTINCT pos // 10 AS f FROM e) CROSS JOIN (SELECT range AS j FROM range(25)) JOIN e ON e.pos = f * 10 + j % 10")
def repeat_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    return M.repeat(events(spark, sf), 10, 25).df


@query(E_SQL + "SELECT pos // 10 * 4 + pos % 10 AS pos, v FROM e WHERE pos % 10 < 4")
def repeat_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return M.repeat(events(spark, sf), 10, 4).df


@query(E_SQL + "SELECT 0 AS port, pos, v FROM e UNION ALL SELECT 1, pos, v FROM e UNION ALL SELECT 2, pos, v FROM e")
def duplicate_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    parts = [s.df.withColumn("port", F.lit(k)) for k, s in enumerate(M.duplicate(events(spark, sf), 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT range AS pos, CAST(0 AS BIGINT) AS v FROM range(12)")
def init_zeros(spark: SparkSession, sf: str) -> DataFrame:
    g = Graph("init")
    a, b = g.add("init", "zeros", 0, 1), g.add("extern_out", "out", 1, 0)
    g.edge(a, 0, 12, b, 0, 12)
    return lower(g, spark).outputs["out"].df


@query(E_SQL + "SELECT pos, coalesce(lag(v, 3) OVER (ORDER BY pos), 0) AS v FROM e")
def persistent_delay_lag(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    return M.persistent_delay(events(spark, sf), 3, n)[0].df


@query(E_SQL + "SELECT pos, coalesce(lag(v, 2) OVER (PARTITION BY pos // 10 ORDER BY pos), 0) AS v FROM e")
def local_delay_reset(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    return M.local_delay(events(spark, sf), 2, 10, n // 10)[0].df


@query(E_SQL + "SELECT pos // 10 * 2 + pos % 10 - 8 AS pos, v FROM e WHERE pos % 10 >= 8")
def local_delay_getter(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    return M.local_delay(events(spark, sf), 2, 10, n // 10)[1].df


def _nested(spark: SparkSession, sf: str, outer_in: int, inner_in: int, inner_out: int, outer_out: int) -> DataFrame:
    """events -> nested graph with one actor between its interfaces -> out."""
    g = Graph("top")
    source, out = g.add("extern_in", "events", 0, 1), g.add("extern_out", "out", 1, 0)
    s = g.subgraph("nested", 1, 1)
    g.edge(source, 0, outer_in * 2, s, 0, outer_in)
    g.edge(s, 0, outer_out, out, 0, outer_out * 2)
    work = s.actor("work", 1, 1, K.mapped(v=F.col("v") * 2))
    s.edge(s.input(0), 0, outer_in, work, 0, inner_in)
    s.edge(work, 0, inner_out, s.output(0), 0, outer_out)
    n = spark.read.parquet(f"{sf}/events.parquet").count() // (outer_in * 2)
    return lower(g, spark, {"events": events(spark, sf)}, n).outputs["out"].df


@query(E_SQL + "SELECT f * 12 + j AS pos, v * 2 AS v FROM (SELECT DISTINCT pos // 5 AS f FROM e) CROSS JOIN (SELECT range AS j FROM range(12)) JOIN e ON e.pos = f * 5 + j % 5")
def interface_input_repeat(spark: SparkSession, sf: str) -> DataFrame:
    return _nested(spark, sf, 5, 12, 12, 12)


@query(E_SQL + "SELECT pos // 5 * 2 + pos % 5 - 3 AS pos, v * 2 AS v FROM e WHERE pos % 5 >= 3")
def interface_output_tail(spark: SparkSession, sf: str) -> DataFrame:
    return _nested(spark, sf, 5, 5, 5, 2)


@query(E_SQL + "SELECT pos // 10 AS pos, round(sum(v), 4) AS total, max(v) AS most, count(*) AS n FROM e GROUP BY 1")
def firing_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    f = K.Firing(spark, [events(spark, sf)], [10], [1], [], 0)
    return K.reduced(total=F.round(F.sum("v"), 4), most=F.max("v"), n=F.count("*"))(f)[0].df


@query(E_SQL.rstrip() + ", o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_totalprice AS w FROM orders) SELECT e.pos, v, w FROM e JOIN o USING (pos)")
def firing_zip(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    return K.zipped(v=F.col("i0_v"), w=F.col("i1_v"))(K.Firing(spark, [events(spark, sf), o], [1, 1], [1], [], 0))[0].df


@query(E_SQL + "SELECT e.pos, round(s, 4) AS v FROM e JOIN (SELECT pos // 10 AS f, sum(v) AS s FROM e GROUP BY 1) ON f = pos // 10")
def downsample_upsample(spark: SparkSession, sf: str) -> DataFrame:
    sums = K.reduced(v=F.round(F.sum("v"), 4))(K.Firing(spark, [events(spark, sf)], [10], [1], [], 0))[0]
    return M.repeat(sums, 1, 10).df


@query(E_SQL + "SELECT pos, round(v - avg(v) OVER (PARTITION BY pos // 10), 4) AS v FROM e")
def arrow_kernel(spark: SparkSession, sf: str) -> DataFrame:
    centred = K.arrow(lambda c: {"v": (c["v"] - c["v"].mean()).round(10)}, "v double")(K.Firing(spark, [events(spark, sf)], [10], [10], [], 0))[0]
    return centred.df.select("pos", F.round("v", 4).alias("v"))


@query(O_SQL + "SELECT pos, v FROM o")
def position_by_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).df


#: Expressions over x = o_totalprice / 100000 and k = o_orderkey mod 7, and their SQL.
EXPRESSIONS = {
    "add": ("x + 2", "x + 2"), "subtract": ("x - 2", "x - 2"), "multiply": ("3x", "3 * x"), "divide": ("x / 4", "x / 4"), "modulo": ("x % 2", "fmod(x, 2)"), "power": ("x ^ 2", "pow(x, 2)"),
    "factorial": ("k!", "CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE)"),
    "equal": ("k == 3", "CASE WHEN k = 3 THEN 1.0 ELSE 0.0 END"), "not_equal": ("k != 3", "CASE WHEN k <> 3 THEN 1.0 ELSE 0.0 END"),
    "greater": ("x > 1", "CASE WHEN x > 1 THEN 1.0 ELSE 0.0 END"), "greater_equal": ("k >= 3", "CASE WHEN k >= 3 THEN 1.0 ELSE 0.0 END"),
    "less": ("x < 1", "CASE WHEN x < 1 THEN 1.0 ELSE 0.0 END"), "less_equal": ("k <= 3", "CASE WHEN k <= 3 THEN 1.0 ELSE 0.0 END"),
    **{f: (f"{f}(x)", f"{f}(x)") for f in ("cos", "sin", "tan", "cosh", "sinh", "tanh", "exp", "ceil", "floor", "abs", "sqrt")},
    "log": ("log(x)", "ln(x)"), "log2": ("log2(x)", "log2(x)"), "log10": ("log10(x)", "log10(x)"),
    "max": ("max(x, 1.5)", "greatest(x, 1.5)"), "min": ("min(x, 1.5)", "least(x, 1.5)"),
    "if": ("if(x > 1, x, k)", "CASE WHEN x > 1 THEN x ELSE k END"), "and": ("and(k, x > 1)", "CASE WHEN k <> 0 AND x > 1 THEN 1.0 ELSE 0.0 END"), "or": ("or(k, x > 1)", "CASE WHEN k <> 0 OR x > 1 THEN 1.0 ELSE 0.0 END"),
    "constants": ("pi * x + e", "pi() * x + exp(1)"), "precedence": ("4 * k % 3 + 2 ^ 2", "4 * fmod(k, 3) + 4"),
}


def _expression(text: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("x"), (F.col("o_orderkey") % 7).cast("double").alias("k"))
        return o.select("o_orderkey", F.round(Expression(text).column(), 9).alias("y"))

    return run


for _name, (_text, _sql) in EXPRESSIONS.items():
    query(f"SELECT o_orderkey, round(CAST({_sql} AS DOUBLE), 9) AS y FROM (SELECT o_orderkey, o_totalprice / 100000 AS x, CAST(o_orderkey % 7 AS DOUBLE) AS k FROM orders)", f"expr_{_name}")(_expression(_text))


@query("SELECT range AS k, greatest(-1, CAST(floor((range * 3 - 4) / 2.0) AS BIGINT)) AS first, greatest(-1, CAST(floor((range * 3 + 3 - 4 - 1) / 2.0) AS BIGINT)) AS last FROM range(1000)")
def dependency_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.lineage(spark, 3, 2, 4, 1000).select("k", "first", "last")


@query("SELECT range AS k, CASE WHEN (range * 2 + 4) // 3 >= 600 THEN -1 ELSE (range * 2 + 4) // 3 END AS first, CASE WHEN (range * 2 + 4) // 3 >= 600 THEN -1 ELSE least(599, (range * 2 + 5) // 3) END AS last FROM range(1000)")
def consumer_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.consumers(spark, 3, 2, 4, 1000, 600)


@query("SELECT * FROM (VALUES ('v0', 2), ('v1', 2), ('nested', 1), ('v4', 1)) t(actor, firings)")
def repetition_vector(spark: SparkSession, sf: str) -> DataFrame:
    g = _three_levels()
    return spark.createDataFrame([(v.name, n) for v, n in repetition.repetitions(g).items()], "actor string, firings int")


def _three_levels() -> Graph:
    g = Graph("top")
    v0, v1, v4 = g.actor("v0", 0, 1), g.actor("v1", 1, 1), g.actor("v4", 1, 0)
    s = g.subgraph("nested", 1, 1)
    g.persistent_delay(g.edge(v0, 0, 1, v1, 0, 1), 1)
    g.edge(v1, 0, 1, s, 0, 2)
    g.edge(s, 0, 5, v4, 0, 5)
    work = s.actor("v2", 1, 1)
    s.edge(s.input(0), 0, 2, work, 0, 2)
    s.edge(work, 0, 5, s.output(0), 0, 5)
    return g


@query("SELECT * FROM (VALUES ('before', 8, 7), ('after', 6, 5)) t(form, nodes, links)")
def rewrite_fork_fork(spark: SparkSession, sf: str) -> DataFrame:
    g = Graph("forks")
    a = g.actor("a", 0, 1)
    forks = [g.add("fork", f"f{k}", 1, 2) for k in range(3)]
    g.edge(a, 0, 4, forks[0], 0, 4)
    for k in (0, 1):
        g.edge(forks[0], k, 2, forks[k + 1], 0, 2)
    for k in range(4):
        g.edge(forks[k // 2 + 1], k % 2, 1, g.actor(f"v{k}", 1, 0), 0, 1)
    u = unroll(g)
    rows = [("before", len(u.nodes), len(u.links))]
    optimize(u)
    return spark.createDataFrame([*rows, ("after", len(u.nodes), len(u.links))], "form string, nodes int, links int")


def _slice_of_joined(spark: SparkSession, sources: dict[str, TokenStream], n: int) -> DataFrame:
    """Blocks of 5 and 5 joined and cut into 3, 4 and 3; the middle slice."""
    g = Graph("joined")
    whole, cut = g.add("join", "whole", 2, 1), g.add("fork", "cut", 1, 3)
    if len(sources) == 1:
        source, halves = g.add("extern_in", "e", 0, 1), g.add("fork", "halves", 1, 2)
        g.edge(source, 0, 10 * n, halves, 0, 10)
        for k in range(2):
            g.edge(halves, k, 5, whole, k, 5)
    else:
        for k, name in enumerate(sources):
            g.edge(g.add("extern_in", name, 0, 1), 0, 5 * n, whole, k, 5)
    g.edge(whole, 0, 10, cut, 0, 10)
    for k, rate in enumerate((3, 4, 3)):
        g.edge(cut, k, rate, g.add("extern_out", "out", 1, 0) if k == 1 else g.add("end", f"end_{k}", 1, 0), 0, rate * n if k == 1 else rate)
    return lower(g, spark, sources).outputs["out"].df


@query(E_SQL + "SELECT pos // 10 * 4 + pos % 10 - 3 AS pos, v FROM e WHERE pos % 10 BETWEEN 3 AND 6 AND pos < (SELECT count(*) // 10 * 10 FROM e)")
def join_then_fork(spark: SparkSession, sf: str) -> DataFrame:
    """What was cut, joined and cut again is one slice: one scan, one filter."""
    n = spark.read.parquet(f"{sf}/events.parquet").count() // 10
    return _slice_of_joined(spark, {"e": events(spark, sf)}, n)


@query(E_SQL.rstrip() + ", o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_totalprice AS v FROM orders), n AS (SELECT least((SELECT count(*) FROM e), (SELECT count(*) FROM o)) // 5 AS n) SELECT pos // 5 * 4 + pos % 5 - 3 AS pos, v FROM e, n WHERE pos % 5 >= 3 AND pos < 5 * n UNION ALL SELECT pos // 5 * 4 + pos % 5 + 2, v FROM o, n WHERE pos % 5 < 2 AND pos < 5 * n")
def rewrite_join_fork(spark: SparkSession, sf: str) -> DataFrame:
    """A slice across two joined streams: each is read once, for its part of the slice."""
    n = min(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("events", "orders")) // 5
    return _slice_of_joined(spark, {"e": events(spark, sf), "o": orders(spark, sf)}, n)


@query("SELECT vec_id, round(sum(CAST(x AS DOUBLE) * (i % 5 - 2)) + 0.5, 5) AS y FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY vec_id")
def mlp_neuron(spark: SparkSession, sf: str) -> DataFrame:
    w = F.array(*[F.lit(float(k % 5 - 2)) for k in range(64)])
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.round(neural.neuron(F.col("embedding"), w, F.lit(0.5)), 5).alias("y"))


@query("SELECT event_id, round(tanh(value / 100), 6) AS tanh, greatest(value / 100, 0) AS relu, round(value / 100 / (1 + abs(value / 100)), 6) AS softsign, round(1 / (1 + exp(-value / 100)), 6) AS logistic, round(1 - pow(tanh(value / 100), 2), 6) AS d_tanh FROM events")
def mlp_activations(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("value") / 100
    a = neural.ACTIVATIONS
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(a["tanh"](x), 6).alias("tanh"), a["relu"](x).alias("relu"), F.round(a["softsign"](x), 6).alias("softsign"), F.round(a["logistic"](x), 6).alias("logistic"), F.round(neural.DERIVATIVES["tanh"](x), 6).alias("d_tanh"))


@query("SELECT event_id, round(value / 100 - 0.001 * (m / (1 - pow(0.9, 2))) / (sqrt(v / (1 - pow(0.999, 2))) + 1e-8), 6) AS param, round(m, 6) AS m, round(v, 6) AS v FROM (SELECT event_id, value, 0.9 * 0.1 + 0.1 * value / 50 AS m, 0.999 * 0.2 + 0.001 * value / 50 * value / 50 AS v FROM events)")
def adam_step(spark: SparkSession, sf: str) -> DataFrame:
    found = neural.adam(F.col("value") / 100, F.col("value") / 50, F.lit(0.1), F.lit(0.2), 2)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", *[F.round(c, 6).alias(n) for n, c in found.items()])


@query("SELECT event_id, round(value + 0.99 * user_id - 3, 5) AS error, least(50, greatest(-50, value)) AS clipped FROM events")
def temporal_difference(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(neural.td_error(F.col("value"), F.col("user_id"), F.lit(3)), 5).alias("error"), neural.clip(F.col("value"), -50.0, 50.0).alias("clipped"))


_COV = "WITH e AS (SELECT event_id // 50 AS b, CAST(floor(value) AS BIGINT) AS x, user_id % 100 AS y FROM events), s AS (SELECT b, count(*) AS n, CAST(sum(x) AS BIGINT) // count(*) AS mx, CAST(sum(y) AS BIGINT) // count(*) AS my FROM e GROUP BY b) "


@query(_COV + "SELECT b, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, round(sum((x - mx) * (x - mx)) / (any_value(n) - 1), 4) AS cxx, round(sum((y - my) * (y - my)) / (any_value(n) - 1), 4) AS cyy, round(sum((x - mx) * (y - my)) / (any_value(n) - 1), 4) AS cxy FROM e JOIN s USING (b) GROUP BY b")
def block_covariance(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id div 50 AS b", "CAST(floor(value) AS BIGINT) AS x", "user_id % 100 AS y")
    return motion.block_statistics(e, "b", "x", "y").select("b", "n", "mx", "my", *[F.round(c, 4).alias(c) for c in ("cxx", "cyy", "cxy")])


#: The filter looks back 3000 tokens block by block: 0.98 ** 3000 is under 1e-26.
_ACC = E_SQL.rstrip() + ", w AS (SELECT pos, v, pos // 1000 AS b, pos % 1000 AS i FROM e), s AS (SELECT b, sum(v * pow(0.98, 999 - i)) AS t FROM w GROUP BY b), a AS (SELECT w.pos, sum(v * pow(0.98, -i)) OVER (PARTITION BY w.b ORDER BY pos) * pow(0.98, i) + pow(0.98, i + 1) * (coalesce(x.t, 0) + pow(0.98, 1000) * coalesce(y.t, 0) + pow(0.98, 2000) * coalesce(z.t, 0)) AS acc FROM w LEFT JOIN s x ON x.b = w.b - 1 LEFT JOIN s y ON y.b = w.b - 2 LEFT JOIN s z ON z.b = w.b - 3) "


@query(_ACC + "SELECT pos, round(acc, 4) AS acc FROM a")
def accumulate_motion(spark: SparkSession, sf: str) -> DataFrame:
    """acc' = 0.98 acc + v over all tokens."""
    return K.linear_scan(events(spark, sf), "v", 0.98, block=256).df.select("pos", F.round("acc", 4).alias("acc"))


@query(E_SQL.rstrip() + ", n AS (SELECT 2 + count(*) % 3 AS n FROM nation) SELECT pos // n AS pos, round(sum(v), 4) AS total FROM e, n WHERE pos < (SELECT count(*) FROM e) // n * n GROUP BY 1")
def dynamic_rate_config(spark: SparkSession, sf: str) -> DataFrame:
    """A config actor sets the rate from a table, the graph is lowered with it."""
    g = Graph("dynamic")
    width = g.dynamic_param("width")
    g.config("set", 0, 0, lambda s, _: [2 + s.read.parquet(f"{sf}/nation.parquet").count() % 3]).output_params(width)
    source, out = g.add("extern_in", "events", 0, 1), g.add("extern_out", "out", 1, 0)
    total = g.actor("sum", 1, 1, K.reduced(total=F.round(F.sum("v"), 4)))
    g.edge(source, 0, "width * blocks", total, 0, "width")
    g.edge(total, 0, 1, out, 0, "blocks")
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    g.static_param("tokens", n)
    g.derived_param("blocks", "floor(tokens / max(width, 1))")
    return Runtime(g, spark).run({"events": events(spark, sf)}).outputs["out"].df


#: Fixed values, worked out by hand: a join of two tokens from p0 and p1 goes to p2, which ends first even with two sends and receives of 1.
_SCHEDULE = """SELECT processor, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", CAST(load AS BIGINT) AS load, CAST(jobs AS BIGINT) AS jobs, CAST("end" - "start" - load AS BIGINT) AS idle, load / 503 AS utilization, CAST(503 AS BIGINT) AS makespan
    FROM (VALUES ('p0', 0, 200, 200, 2), ('p1', 0, 401, 400, 4), ('p2', 203, 503, 300, 3)) t(processor, "start", "end", load, jobs)"""


@query(_SCHEDULE)
def schedule_list_bestfit(spark: SparkSession, sf: str) -> DataFrame:
    platform = Platform([Processor("p0", 0, True), Processor("p1", 0), Processor("p2", 1)])
    return statistics(as_table(spark, schedule(unroll(_three_levels()), platform)))


@query(None)
def pendulum_episodes(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", (F.col("value") / 100).alias("torque"))
    return neural.pendulum(e, "user_id", "event_id", "torque")


@query("WITH p AS (SELECT event_id // 240 AS frame, event_id % 240 // 20 AS y, event_id % 20 AS x, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_id < (SELECT count(*) // 240 * 240 FROM events)), b AS (SELECT *, y // 4 * 5 + x // 4 AS block FROM p), s AS (SELECT a.range AS dx, c.range AS dy FROM range(-2, 3) a, range(-1, 2) c), c AS (SELECT b.frame, b.block, dx, dy, CAST(sum((b.v - q.v) * (b.v - q.v)) AS BIGINT) // count(*) AS cost, count(*) AS k FROM b, s, p q WHERE q.frame + 1 = b.frame AND q.x = b.x + dx AND q.y = b.y + dy GROUP BY ALL) SELECT frame, block, dx, dy, cost FROM c WHERE 2 * k >= 16 QUALIFY row_number() OVER (PARTITION BY frame, block ORDER BY cost, dy, dx) = 1")
def block_motion(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all whole frames of 240 events."""
    read = spark.read.parquet(f"{sf}/events.parquet")
    whole = read.count() // 240 * 240
    pixels = read.where(F.col("event_id") < whole).selectExpr("event_id div 240 AS frame", "event_id % 240 div 20 AS y", "event_id % 20 AS x", "CAST(floor(value) AS BIGINT) AS v")
    found = motion.motion_vectors(motion.blocks(pixels, 4, 4, 20, 12), pixels, 2, 1)
    return found.select("frame", "block", F.col("dx").cast("bigint").alias("dx"), F.col("dy").cast("bigint").alias("dy"), "cost")


#: Vectors by frame, 50 events each: whole numbers from -4 to 4, and -1 to 1.
_VECTORS = "event_id // 50 AS frame, CAST(floor(value) AS BIGINT) % 9 - 4 AS dx, user_id % 3 - 1 AS dy"
_STATS = f"WITH e AS (SELECT event_id, {_VECTORS} FROM events), s AS (SELECT frame, count(*) AS n, CAST(trunc(avg(dx)) AS BIGINT) AS mx, CAST(trunc(avg(dy)) AS BIGINT) AS my FROM e GROUP BY frame), c AS (SELECT frame, any_value(mx) AS mx, any_value(my) AS my, sum((dx - mx) * (dx - mx)) / (any_value(n) - 1) AS xx, sum((dy - my) * (dy - my)) / (any_value(n) - 1) AS yy, sum((dx - mx) * (dy - my)) / (any_value(n) - 1) AS xy FROM e JOIN s USING (frame) GROUP BY frame HAVING any_value(n) > 1), d AS (SELECT event_id, frame, dx, dy, CASE WHEN xx * yy - xy * xy > 0 THEN exp(-(yy * (dx - mx) * (dx - mx) - 2 * xy * (dx - mx) * (dy - my) + xx * (dy - my) * (dy - my)) / (2 * (xx * yy - xy * xy))) / (2 * pi() * sqrt(xx * yy - xy * xy)) WHEN xx > 0 THEN exp(-(dx - mx) * (dx - mx) / (2 * xx)) / sqrt(2 * pi() * xx) WHEN yy > 0 THEN exp(-(dy - my) * (dy - my) / (2 * yy)) / sqrt(2 * pi() * yy) ELSE 1 END AS p FROM e JOIN c USING (frame)) "


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "event_id div 50 AS frame", "CAST(floor(value) AS BIGINT) % 9 - 4 AS dx", "user_id % 3 - 1 AS dy")


@query(_STATS + "SELECT event_id, round(p, 8) AS p FROM d")
def motion_densities(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    scored = v.join(motion.block_statistics(v, "frame"), "frame")
    return scored.select("event_id", F.round(motion.density(F.col("dx"), F.col("dy"), {k: F.col(k) for k in ("mx", "my", "cxx", "cyy", "cxy")}), 8).alias("p"))


@query(_STATS + "SELECT frame, round(avg(dx), 6) AS mx, round(avg(dy), 6) AS my FROM d JOIN (SELECT frame, max(p) AS most FROM d GROUP BY frame) USING (frame) WHERE p > most * 2 / 3 GROUP BY frame")
def dominating_motion(spark: SparkSession, sf: str) -> DataFrame:
    found = motion.dominating_motion(_vectors(spark, sf))
    return found.select("frame", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"))


@query("WITH p AS (SELECT event_id // 240 AS frame, event_id % 240 // 20 AS y, event_id % 20 AS x, CAST(floor(value) AS BIGINT) AS v FROM events) SELECT b.frame, b.y, b.x, coalesce(a.v, CAST(trunc(b.v * 0.9) AS BIGINT)) AS v FROM p b LEFT JOIN p a ON a.frame = b.frame + 1 AND a.y + 2 = b.y AND a.x - 3 = b.x")
def render_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame pasted over the faded one before it, 3 to the left and 2 down."""
    pixels = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id div 240 AS frame", "event_id % 240 div 20 AS y", "event_id % 20 AS x", "CAST(floor(value) AS BIGINT) AS v")
    return motion.rendered(pixels.withColumn("frame", F.col("frame") - 1), -3, 2, pixels, by=("frame",))


@query(_ACC.rstrip() + ", k AS (SELECT pos, coalesce(lag(acc) OVER (ORDER BY pos), 0) AS before FROM a) SELECT pos, round(before * (1 - 0.98) / 2, 6) AS residue, round(before, 4) AS before FROM k")
def motion_residue(spark: SparkSession, sf: str) -> DataFrame:
    """What the high-pass filter lets through: half of what it takes from the motion accumulated so far."""
    acc = K.linear_scan(events(spark, sf), "v", 0.98, block=256)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    before = M.persistent_delay(acc, 1, n)[0].df
    return before.select("pos", F.round(motion.residue(F.col("acc"), 0.98), 6).alias("residue"), F.round("acc", 4).alias("before"))


_NET = "WITH x AS (SELECT event_id, value / 100 AS p, user_id % 7 / 7 AS t, tanh(value / 100) AS a FROM events) "


_ERROR = "2 * (p - t) * (1 - a * a)"
_GRADIENTS = {"error": _ERROR, "b0": f"{_ERROR} * 0.5 * (1 - a * a)", "b1": f"{_ERROR} * -0.25 * a", "g0": f"{_ERROR} * p", "g1": f"{_ERROR} * t", "loss": "((t - p) * (t - p) + a * a) / 2"}


@query(_NET + "SELECT event_id, " + ", ".join(f"CASE WHEN round({x}, 6) = 0 THEN 0 ELSE round({x}, 6) END AS {n}" for n, x in _GRADIENTS.items()) + " FROM x")
def mlp_gradients(spark: SparkSession, sf: str) -> DataFrame:
    """An output neuron's error, the errors of two neurons before it, the gradients of two weights, and a loss of two outputs."""
    x = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("value") / 100).alias("p"), (F.col("user_id") % 7 / 7).alias("t")).withColumn("a", F.tanh("p"))
    slope = neural.DERIVATIVES["tanh"](F.col("p"))
    found = x.withColumn("e", neural.output_error(F.col("p"), F.col("t"), slope))
    errors = F.array("e")
    back = neural.back_propagated(errors, F.array(F.array(F.lit(0.5), F.lit(-0.25))), F.array(slope, F.col("a")))
    gradients = neural.weight_gradients(errors, F.array("p", "t"))
    loss = neural.half_squared_loss(F.array("p", F.lit(0.0)), F.array("t", "a"))
    found = found.select("event_id", "e", back.alias("b"), gradients.alias("g"), loss.alias("l"))
    return found.select("event_id", *[F.round(c, 6).alias(n) for n, c in {"error": F.col("e"), "b0": F.col("b")[0], "b1": F.col("b")[1], "g0": F.col("g")[0][0], "g1": F.col("g")[0][1], "loss": F.col("l")}.items()])


@query("SELECT event_id, value / 100 AS linear, CAST(1 AS DOUBLE) AS d_linear, CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS d_relu, round(1 / pow(1 + abs(value / 100), 2), 6) AS d_softsign, round(1 / (1 + exp(-value / 100)) * (1 - 1 / (1 + exp(-value / 100))), 6) AS d_logistic FROM events")
def mlp_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    x, d = F.col("value") / 100, neural.DERIVATIVES
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", neural.ACTIVATIONS["linear"](x).alias("linear"), d["linear"](x).alias("d_linear"), d["relu"](x).alias("d_relu"), F.round(d["softsign"](x), 6).alias("d_softsign"), F.round(d["logistic"](x), 6).alias("d_logistic"))


def _deep() -> Graph:
    """Three levels, a delay at each: src -> mid (a -> low (b)) -> end."""
    g = Graph("top")
    src, end, mid = g.actor("src", 0, 1), g.actor("end", 1, 0), g.subgraph("mid", 1, 1)
    g.edge(src, 0, 4, mid, 0, 2)
    g.persistent_delay(g.edge(mid, 0, 1, end, 0, 1), 1)
    a, low = mid.actor("a", 1, 1), mid.subgraph("low", 1, 1)
    mid.edge(mid.input(0), 0, 2, a, 0, 1)
    mid.local_delay(mid.edge(a, 0, 2, low, 0, 4), 1)
    mid.edge(low, 0, 1, mid.output(0), 0, 1)
    b = low.actor("b", 1, 1)
    low.edge(low.input(0), 0, 4, b, 0, 3)
    low.edge(b, 0, 1, low.output(0), 0, 1)
    return g


#: Fixed values, worked out by hand: mid fires twice, a four times, low twice, b four times.
_READS = """SELECT sink, CAST(k AS BIGINT) AS k, port, CAST("at" AS BIGINT) AS "at", source, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, CAST("from" AS BIGINT) AS "from", CAST("to" AS BIGINT) AS "to" FROM (VALUES
    ('mid/a', 0, 0, 0, 'src', 0, 0, 0, 0), ('mid/a', 1, 0, 0, 'src', 0, 0, 1, 1), ('mid/a', 2, 0, 0, 'src', 0, 0, 2, 2), ('mid/a', 3, 0, 0, 'src', 0, 0, 3, 3),
    ('mid/low/b', 0, 0, 0, 'delay-a_0--low_0', -1, -1, 0, 0), ('mid/low/b', 0, 0, 1, 'mid/a', 0, 0, 0, 1),
    ('mid/low/b', 1, 0, 0, 'mid/a', 1, 1, 0, 0), ('mid/low/b', 1, 0, 1, 'delay-a_0--low_0', -1, -1, 0, 0), ('mid/low/b', 1, 0, 2, 'mid/a', 0, 0, 0, 0),
    ('mid/low/b', 2, 0, 0, 'delay-a_0--low_0', -1, -1, 0, 0), ('mid/low/b', 2, 0, 1, 'mid/a', 2, 2, 0, 1),
    ('mid/low/b', 3, 0, 0, 'mid/a', 3, 3, 0, 0), ('mid/low/b', 3, 0, 1, 'delay-a_0--low_0', -1, -1, 0, 0), ('mid/low/b', 3, 0, 2, 'mid/a', 2, 2, 0, 0),
    ('end', 0, 0, 0, 'delay-mid_0--end_0', -1, -1, 0, 0), ('end', 1, 0, 0, 'mid/low/b', 1, 1, 0, 0)
) t(sink, k, port, "at", source, first, last, "from", "to")"""
_READERS = """SELECT source, CAST(firing AS BIGINT) AS firing, sink, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, CAST("from" AS BIGINT) AS "from", CAST("to" AS BIGINT) AS "to" FROM (VALUES
    ('src', 0, 'mid/a', 0, 3, 0, 3),
    ('mid/a', 0, 'mid/low/b', 0, 0, 0, 1), ('mid/a', 0, 'mid/low/b', 1, 1, 0, 0), ('mid/a', 1, 'mid/low/b', 1, 1, 0, 0), ('mid/a', 2, 'mid/low/b', 2, 2, 0, 1), ('mid/a', 2, 'mid/low/b', 3, 3, 0, 0), ('mid/a', 3, 'mid/low/b', 3, 3, 0, 0),
    ('mid/low/b', 0, NULL, -1, -1, 0, 0), ('mid/low/b', 1, 'end', 1, 1, 0, 0), ('mid/low/b', 2, NULL, -1, -1, 0, 0), ('mid/low/b', 3, NULL, -1, -1, 0, 0)
) t(source, firing, sink, first, last, "from", "to")"""


@query(_READS)
def exec_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """What every firing of a graph of three levels reads, in one iteration."""
    return lineage.reads(spark, _deep()).drop("source_port")


@query(_READERS)
def cons_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Who reads what every firing of that graph makes."""
    return lineage.readers(spark, _deep()).drop("source_port", "port")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
