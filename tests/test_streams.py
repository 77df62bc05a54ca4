import collections
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.functions import neural
from weirflow.operators import kernels as K
from weirflow.operators import movement as M
from weirflow.operators.tokens import TokenStream, _range_of, counting, from_table
from weirflow.plans import catalog
from weirflow.plans.graph import Graph, GraphError
from weirflow.plans.lower import complete_iterations, lower
from weirflow.plans.runtime import Options, Runtime
from weirflow.sources.tables import buffer, collected, parquet, write_parquet
from weirflow.streaming.driver import run_stream

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(st.lists(st.integers(0, 4), min_size=1, max_size=4).filter(any), st.integers(1, 4))
def test_fork_join_round_trip(spark, rates, firings):
    total = sum(rates)
    s = counting(spark, total * firings)
    parts = M.fork(s, total, rates)
    for k, (p, r) in enumerate(zip(parts, rates, strict=True)):
        first = sum(rates[:k])
        assert collected(p) == [f * total + first + o for f in range(firings) for o in range(r)]
    whole = M.join(parts, rates, total)
    assert collected(whole) == list(range(total * firings)) and whole.check() == total * firings


@few
@given(st.integers(1, 6), st.integers(1, 14), st.integers(1, 3))
def test_repeat(spark, rate, out, firings):
    got = collected(M.repeat(counting(spark, rate * firings), rate, out))
    assert got == [f * rate + j % rate for f in range(firings) for j in range(out)]


@few
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_head_and_tail_of_two(spark, a, b, data):
    out = data.draw(st.integers(1, a + b))
    x, y = buffer(spark, list(range(2 * a))), buffer(spark, list(range(100, 100 + 2 * b)))
    blocks = [list(range(f * a, f * a + a)) + list(range(100 + f * b, 100 + f * b + b)) for f in range(2)]
    assert collected(M.head([x, y], [a, b], out)) == [v for block in blocks for v in block[:out]]
    assert collected(M.tail([x, y], [a, b], out)) == [v for block in blocks for v in block[-out:]]


def test_rate_errors(spark):
    s = counting(spark, 6)
    for bad in (lambda: M.fork(s, 6, [2, 3]), lambda: M.join([s, s], [1, 2], 4), lambda: M.head([s], [3], 4), lambda: M.repeat(s, 0, 3)):
        with pytest.raises(M.RateError):
            bad()


def test_delays(spark):
    s = counting(spark, 12)
    out, state = M.persistent_delay(s, 3, 12)
    assert collected(out) == [0, 0, 0, *range(9)] and collected(state) == [9, 10, 11]
    out, state = M.persistent_delay(s, 3, 12, state)
    assert collected(out)[:4] == [9, 10, 11, 0]
    use, get = M.local_delay(s, 2, 4, 3, buffer(spark, [90, 91, 92, 93, 94, 95]))
    assert collected(use) == [90, 91, 0, 1, 92, 93, 4, 5, 94, 95, 8, 9] and collected(get) == [2, 3, 6, 7, 10, 11]


def test_positions_from_a_table(spark, tmp_path):
    rows = [(k * 7919 % 1000, k) for k in range(1000)]
    s = from_table(spark.createDataFrame(rows, "key bigint, v bigint"), ["key"], ["v"])
    assert s.check() == 1000 and collected(s) == [v for _, v in sorted(rows)]
    assert from_table(spark.createDataFrame([], "key bigint, v bigint"), ["key"], ["v"]).check() == 0
    write_parquet(s, str(tmp_path / "t"))
    assert collected(parquet(spark, str(tmp_path / "t"), ["pos"], ["v"], dense=True)) == [v for _, v in sorted(rows)]
    text = spark.createDataFrame([("b", 1), (None, 2), ("a", 3)], "key string, v bigint")
    assert collected(from_table(text, ["key"], ["v"])) == [2, 3, 1]


def test_linear_scan(spark):
    want, acc = [], 0.0
    for v in range(50):
        acc = 0.5 * acc + v
        want.append(acc)
    assert collected(K.linear_scan(counting(spark, 50), "v", 0.5, block=7)) == pytest.approx(want)


def test_accumulate_motion_has_all_events(spark, tmp_path):
    spark.range(3700).selectExpr("id AS event_id", "CAST(id * 37 % 101 - 50 AS DOUBLE) AS value").write.parquet(str(tmp_path / "events.parquet"))
    want, acc = [], 0.0
    for k in range(3700):
        acc = 0.98 * acc + (k * 37 % 101 - 50)
        want.append(acc)
    got = catalog.queries()["accumulate_motion"](spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(3700)) and [r.acc for r in got] == pytest.approx(want, abs=1e-4)


def test_block_motion_has_all_whole_frames(spark, tmp_path):
    spark.range(7 * 240 + 100).selectExpr("id AS event_id", "CAST(id * id % 97 AS DOUBLE) + 0.5 AS value").write.parquet(str(tmp_path / "events.parquet"))
    v = lambda f, y, x: (f * 240 + y * 20 + x) ** 2 % 97
    want = {}
    for f, block in ((f, b) for f in range(1, 7) for b in range(15)):
        own, found = [(block // 5 * 4 + k // 4, block % 5 * 4 + k % 4) for k in range(16)], []
        for dy, dx in ((dy, dx) for dy in range(-1, 2) for dx in range(-2, 3)):
            both = [(v(f, y, x) - v(f - 1, y + dy, x + dx)) ** 2 for y, x in own if 0 <= y + dy < 12 and 0 <= x + dx < 20]
            found += [(sum(both) // len(both), dy, dx)] if 2 * len(both) >= 16 else []
        want[f, block] = min(found)
    got = {(r.frame, r.block): (r.cost, r.dy, r.dx) for r in catalog.queries()["block_motion"](spark, str(tmp_path)).collect()}
    assert got == want


def nested(levels_delay=None):
    """source:6 -> s:3 (twice); in s: in:3 -> w:1 (three times) -> out:3, last 2 leave."""
    g = Graph("top")
    a, out = g.add("extern_in", "a", 0, 1), g.add("extern_out", "out", 1, 0)
    s = g.subgraph("s", 1, 1)
    g.edge(a, 0, 6, s, 0, 3)
    g.edge(s, 0, 2, out, 0, 4)
    w = s.actor("w", 1, 1, K.mapped(v=F.col("v") + 100))
    e = s.edge(s.input(0), 0, 3, w, 0, 1)
    s.edge(w, 0, 1, s.output(0), 0, 2)
    if levels_delay is not None:
        if levels_delay == 0:
            s.local_delay(e, 1)
        else:
            s.local_persistent_delay(e, 1, levels_delay)
    return g


def test_hierarchy(spark):
    src = {"a": counting(spark, 14)}
    assert complete_iterations(nested(), "a", 14) == 2
    assert collected(lower(nested(), spark, src, 2).outputs["out"]) == [101, 102, 104, 105, 107, 108, 110, 111]


def test_delay_levels(spark):
    src = {"a": counting(spark, 12)}
    run = lambda k: collected(lower(nested(k), spark, src, 2).outputs["out"])
    assert run(0) == [100, 101, 103, 104, 106, 107, 109, 110]  # zeros enter at every firing of s
    assert run(1) == [100, 101, 103, 104, 106, 107, 109, 110]
    assert run(-1) == [100, 101, 103, 104, 106, 107, 109, 110]


def test_cycles_are_refused(spark):
    g = Graph("g")
    x, y = g.actor("x", 1, 1, K.mapped(v=F.col("v"))), g.actor("y", 1, 1, K.mapped(v=F.col("v")))
    g.edge(x, 0, 1, y, 0, 1)
    g.persistent_delay(g.edge(y, 0, 1, x, 0, 1), 1)
    with pytest.raises(GraphError):
        lower(g, spark)
    h = Graph("h")
    h.edge(h.actor("x", 0, 1), 0, 1, h.add("end", "e", 1, 0), 0, 1)
    with pytest.raises(GraphError, match="no kernel"):
        lower(h, spark)


def test_runtime_keeps_state(spark, tmp_path):
    g = Graph("g")
    a, b, out = g.add("extern_in", "a", 0, 1), g.actor("b", 1, 1, K.mapped(v=F.col("v"))), g.add("extern_out", "out", 1, 0)
    g.persistent_delay(g.edge(a, 0, 4, b, 0, 4), 2)
    g.edge(b, 0, 4, out, 0, 4)
    for folder in (None, str(tmp_path)):
        r = Runtime(g, spark, folder)
        got = r.loop(lambda k: {"a": buffer(spark, [4 * k + j + 1 for j in range(4)])}, 3)
        assert [x for o in got for x in collected(o.outputs["out"])] == [0, 0, *range(1, 11)] and r.steps == 3


def test_dynamic_graph(spark):
    g = Graph("g")
    w = g.dynamic_param("w")
    widths = iter([2, 5])
    g.config("c", 0, 0, lambda s, p: [next(widths)]).output_params(w)
    src, total, out = g.actor("src", 0, 1, K.generated(v=F.lit(1))), g.actor("sum", 1, 1, K.reduced(v=F.sum("v"))), g.add("extern_out", "out", 1, 0)
    g.edge(src, 0, "w", total, 0, "w")
    g.edge(total, 0, 1, out, 0, 1)
    r = Runtime(g, spark)
    assert [collected(r.run().outputs["out"]) for _ in range(2)] == [[2], [5]]
    with pytest.raises(GraphError):
        r.run(iterations=2)


def test_actors_that_do_not_fire(spark):
    g = Graph("g")
    v0, v1, v2 = g.actor("v0", 0, 2, lambda f: [counting(f.spark, f.firings), None]), g.add("extern_out", "v1", 1, 0), g.actor("v2", 1, 0)
    g.edge(v0, 0, 1, v1, 0, 1)
    g.edge(v0, 1, 0, v2, 0, 0)
    out = lower(g, spark)
    assert collected(out.outputs["v1"]) == [0] and out.counts[v2] == 0


def test_streaming_equals_batch(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS v").repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id bigint, v bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    step = lambda s, n, first: K.reduced(v=F.sum("v"))(K.Firing(spark, [s], [7], [1], [], n))[0].df.withColumn("pos", F.col("pos") + first)
    run_stream(source, str(tmp_path / "state"), ["id"], ["v"], 7, step, str(tmp_path / "out")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 14 and [r.pos for r in got.orderBy("pos").collect()] == list(range(14))
    left = sum(r.v for r in got.collect())
    rest = max(int(x) for x in os.listdir(tmp_path / "state" / "rest"))
    assert left + spark.read.parquet(str(tmp_path / "state" / "rest" / str(rest))).agg(F.sum("v")).first()[0] == 9900


def test_trace_replay_and_endless_runs(spark, caplog):
    g = Graph("g")
    g.static_param("n", 3)
    source, work, out = g.add("extern_in", "in", 0, 1), g.actor("work", 1, 1, K.mapped(v=F.col("v") + 1)), g.add("extern_out", "out", 1, 0)
    g.edge(source, 0, "n", work, 0, 1)
    g.edge(work, 0, 1, out, 0, "n")
    run = Runtime(g, spark, options=Options(verbose=True))
    s = counting(spark, 6)
    with caplog.at_level("INFO", "weirflow"):
        first = run.run({"in": s}, 2)
    assert collected(first.outputs["out"]) == list(range(1, 7)) and run.run({"in": s}, 2) is first
    assert run.run({"in": s}, 1) is not first and "2 iterations" in caplog.text
    assert run.trace[0].firings == {"in": 2, "work": 6, "out": 2} and [x.replayed for x in run.trace] == [False, True, False]
    assert run.summary(100.0)["iterations"] == 5 and run.summary(100.0)["overhead"] < 1
    runs = run.forever(lambda k: {"in": counting(spark, 3)}, until=lambda k: k == 2)
    assert [collected(x.outputs["out"]) for x in runs] == [[1, 2, 3]] * 2
    quiet = Runtime(g, spark, options=Options(trace=False, replay=False))
    assert quiet.run({"in": s}) is not quiet.run({"in": s}) and not quiet.trace


def test_state_goes_to_the_shared_folder(spark, tmp_path, monkeypatch):
    g = Graph("g")
    source, out = g.add("extern_in", "in", 0, 1), g.add("extern_out", "out", 1, 0)
    g.persistent_delay(g.edge(source, 0, 2, out, 0, 2), 1)
    monkeypatch.setattr("weirflow.plans.runtime.shared_folder", lambda _: f"file://{tmp_path}")
    run = Runtime(g, spark)
    assert [collected(run.run({"in": counting(spark, 2)}).outputs["out"]) for _ in range(2)] == [[0, 0], [1, 0]]
    assert len(os.listdir(tmp_path)) == 1


def test_persistent_state_is_never_replayed(spark):
    g = Graph("g")
    source, out = g.add("extern_in", "in", 0, 1), g.add("extern_out", "out", 1, 0)
    g.persistent_delay(g.edge(source, 0, 2, out, 0, 2), 1)
    run, s = Runtime(g, spark), counting(spark, 2)
    assert [collected(run.run({"in": s}).outputs["out"]) for _ in range(3)] == [[0, 0], [1, 0], [1, 0]]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_movement_that_cancels_out_is_not_planned(spark, sf):
    assert scans(catalog.queries()["join_then_fork"](spark, sf)) == 1
    assert scans(catalog.queries()["rewrite_join_fork"](spark, sf)) == 2


@few
@given(st.lists(st.integers(1, 5), min_size=1, max_size=4), st.data())
def test_blocks_are_what_their_pieces_say(spark, rates, data):
    """Forks, joins and cuts of two streams against lists, read in one step."""
    streams = [(counting(spark, 60), list(range(60))), (counting(spark, 60).at("pos"), list(range(60)))]
    total = sum(rates)
    n = 60 // total
    sides = [(M.Blocks.of(s, total), [x[k * total : (k + 1) * total] for k in range(n)]) for s, x in streams]
    parts = [(b.cut(o, r), [x[o : o + r] for x in f]) for b, f in sides for o, r in zip([sum(rates[:k]) for k in range(len(rates))], rates, strict=True)]
    order = data.draw(st.lists(st.sampled_from(range(len(parts))), min_size=1, max_size=5))
    whole, want = M.Blocks.joined([parts[k][0] for k in order]), [sum((parts[k][1][f] for k in order), []) for f in range(n)]
    first = data.draw(st.integers(0, whole.size - 1))
    length = data.draw(st.integers(1, whole.size - first))
    got = [r.v for r in whole.cut(first, length).stream().df.where(f"pos < {n * length}").orderBy("pos").collect()]
    assert got == sum((x[first : first + length] for x in want), [])


def test_pendulum_by_plain_fold(spark):
    rng = np.random.default_rng(0)
    rows = [(k % 3, k, float(rng.normal(0, 2))) for k in range(60)] + [(9, 0, None)]
    got = collections.defaultdict(list)
    for r in neural.pendulum(spark.createDataFrame(rows, "who int, at bigint, torque double"), "who", "at", "torque").orderBy("who", "step").collect():
        got[r.who].append((r.step, r.theta, r.speed, r.reward))
    for who in (0, 1, 2, 9):
        theta, speed, want = math.pi, 0.0, []
        for w, at, u in rows:
            if w == who:
                u = max(-2.0, min(2.0, u or 0.0))
                angle = math.atan2(math.sin(theta), math.cos(theta))
                reward = -(angle**2 + 0.1 * speed**2 + 0.001 * u**2)
                speed = max(-8.0, min(8.0, speed + 0.05 * (15 * math.sin(theta) + 3 * u)))
                theta += 0.05 * speed
                want.append((at, theta, speed, reward))
        assert np.allclose(got[who], want, atol=1e-9)


def test_ranges_of_bounds(spark):
    for n in (0, 1, 2, 3, 10, 101):
        bounds = [3 * k for k in range(n)]
        got = [r[0] for r in spark.range(-2, 320, 1, 1).select(_range_of(bounds, F.col("id"))).collect()]
        assert got == [sum(b <= x for b in bounds) for x in range(-2, 320)]


@pytest.mark.parametrize(("keep", "n"), [(0.98, 3000), (0.5, 700), (1.0, 500), (-0.9, 300), (0.0, 20), (1.01, 300)])
def test_linear_scan_over_many_blocks(spark, keep, n):
    acc, want = 0.0, {}
    for k in range(n):
        acc = keep * acc + k % 17
        want[k] = acc
    got = {r.pos: r.acc for r in K.linear_scan(TokenStream(spark.range(n).selectExpr("id AS pos", "id % 17 AS v")), "v", keep, block=8).df.collect()}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert K.linear_scan(TokenStream(spark.range(0).selectExpr("id AS pos", "id AS v")), "v", keep).df.count() == 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "orders", "embeddings", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        assert got[c].tolist() == pytest.approx(want[c].tolist(), rel=1e-9, abs=1e-9, nan_ok=True) if got[c].dtype != object else got[c].tolist() == want[c].tolist(), c
