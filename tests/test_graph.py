import pytest
from hypothesis import given
from hypothesis import strategies as st

from weirflow.plans.expand import Unrolled, unroll
from weirflow.plans.export import gantt_svg, gantt_xml, graph_dot, statistics_text, unrolled_dot
from weirflow.plans.graph import Graph, GraphError, Kind, split_configs
from weirflow.plans.repetition import consumers, first_firing, last_firing, lineage, repetitions
from weirflow.plans.rewrite import fork_fork, init_end, join_end, join_fork, join_join, optimize, repeat_fork
from weirflow.plans.schedule import Constraints, Platform, Processor, as_table, schedule, statistics


def pair(a, b, delay=0):
    g = Graph("pair")
    x, y = g.actor("x", 0, 1), g.actor("y", 1, 0)
    e = g.edge(x, 0, a, y, 0, b)
    if delay:
        g.persistent_delay(e, delay)
    return g


def test_repetitions_of_a_chain():
    g = Graph("top")
    v0, v1, v4 = g.actor("v0", 0, 1), g.actor("v1", 1, 1), g.actor("v4", 1, 0)
    s = g.subgraph("s", 1, 1)
    g.persistent_delay(g.edge(v0, 0, 1, v1, 0, 1), 1)
    g.edge(v1, 0, 1, s, 0, 2)
    g.edge(s, 0, 5, v4, 0, 5)
    assert [repetitions(g)[v] for v in (v0, v1, s, v4)] == [2, 2, 1, 1]


@pytest.mark.parametrize(("a", "b"), [(1, 0), (0, 1)])
def test_one_zero_rate_is_refused(a, b):
    with pytest.raises(GraphError):
        repetitions(pair(a, b))


def test_zero_rates_do_not_fire():
    g = pair(0, 0)
    assert set(repetitions(g).values()) == {0}


def test_unbalanced_cycle_and_open_port():
    g = Graph("cycle")
    x, y = g.actor("x", 1, 1), g.actor("y", 1, 1)
    g.edge(x, 0, 1, y, 0, 1)
    g.edge(y, 0, 2, x, 0, 1)
    with pytest.raises(GraphError):
        repetitions(g)
    h = Graph("open")
    h.actor("x", 1, 0)
    with pytest.raises(GraphError):
        repetitions(h)


def test_config_fires_once():
    g = Graph("g")
    p = g.dynamic_param("n")
    c, x = g.config("c", 0, 1).output_params(p), g.actor("x", 1, 0)
    g.edge(c, 0, 1, x, 0, 2)
    with pytest.raises(GraphError):
        repetitions(g)


def test_building_errors():
    g = Graph("g")
    a, b = g.actor("a", 0, 1), g.actor("b", 1, 1)
    e = g.edge(a, 0, 1, b, 0, 1)
    for bad in (lambda: g.edge(a, 0, 1, b, 0, 1), lambda: g.edge(a, 5, 1, b, 0, 1), lambda: g.add(Kind.JOIN, "j", 2, 2), lambda: g.add("repeat", "r", 2, 1), lambda: g.add("input", "i", 0, 1), lambda: g.static_param("pi", 3), lambda: g.inherited_param("x", None), lambda: b.output_params(), lambda: g.input(3)):
        with pytest.raises(GraphError):
            bad()
    assert g.persistent_delay(e, 0) is None
    d = g.local_delay(e, 2)
    assert d.vertex.name == "delay-a_0--b_0" and not d.persistent
    with pytest.raises(GraphError):
        g.persistent_delay(e, 1)
    g.remove_edge(e)
    assert a.outs == [None] and not g.delays
    with pytest.raises(GraphError):
        Graph("other").edge(a, 0, 1, b, 0, 1)


def test_dynamic_delay_is_refused():
    g = Graph("g")
    n = g.dynamic_param("n")
    e = g.edge(g.actor("a", 0, 1), 0, 1, g.actor("b", 1, 0), 0, 1)
    with pytest.raises(GraphError):
        g.persistent_delay(e, "n")
    n.set(4)
    assert n.value() == 4


def test_parameters():
    g = Graph("g")
    w = g.static_param("Width", 10)
    assert g.param("WIDTH") is w and w.name == "width"
    with pytest.raises(GraphError):
        w.set(3)
    assert g.derived_param("half", "width / 2").value() == 5 and not g.derived_param("third", "width/3").dynamic
    d = g.dynamic_param("d")
    twice = g.derived_param("twice", "d * 2")
    d.set(7)
    assert twice.dynamic and g.scope()["twice"] == 14
    s = g.subgraph("s")
    assert s.inherited_param("w", w).value() == 10 and s.inherited_param("t", twice) and s.scope()["t"] == 14
    assert not g.fully_static and g.actor_count() == 0


@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 6), st.integers(0, 7))
def test_dependencies_match_enumeration(p, c, d, k):
    read = [-1 if t < d else (t - d) // p for t in range(k * c, (k + 1) * c)]
    assert (first_firing(k, c, p, d), last_firing(k, c, p, d)) == (read[0], read[-1])


def test_lineage_table(spark):
    for r in lineage(spark, 3, 2, 4, 20).collect():
        assert (r.k * 0 + r["first"], r["last"]) == (first_firing(r.k, 3, 2, 4), last_firing(r.k, 3, 2, 4))
    total = 12
    for r in consumers(spark, 3, 2, 4, 20, total).collect():
        read = [(t // 3) for t in range(r.k * 2 + 4, r.k * 2 + 6) if t // 3 < total]
        assert (r["first"], r["last"]) == ((read[0], read[-1]) if read else (-1, -1))


@pytest.mark.parametrize(("a", "b", "d", "nodes", "links"), [(1, 1, 0, 2, 1), (2, 1, 0, 4, 3), (1, 2, 0, 4, 3), (1, 1, 1, 4, 2), (1, 1, 2, 6, 5), (1, 2, 1, 6, 4), (2, 1, 1, 6, 4), (1, 2, 2, 6, 4)])
def test_unrolled_counts(a, b, d, nodes, links):
    u = unroll(pair(a, b, d))
    assert (len(u.nodes), len(u.links)) == (nodes, links)


def test_unrolled_cycles_and_hierarchy():
    g = Graph("self")
    x = g.actor("x", 1, 1)
    e = g.edge(x, 0, 2, x, 0, 2)
    g.persistent_delay(e, 1)
    with pytest.raises(GraphError):
        unroll(g)
    e.delay = None
    g.delays.clear()
    g.persistent_delay(e, 2)
    u = unroll(g)
    assert (len(u.nodes), len(u.links)) == (3, 2)
    h = Graph("h")
    a, s, b = h.actor("a", 0, 1), h.subgraph("s", 1, 1), h.actor("b", 1, 0)
    w = s.actor("w", 1, 1)
    h.edge(a, 0, 1, s, 0, 1)
    h.edge(s, 0, 1, b, 0, 1)
    s.edge(s.input(0), 0, 1, w, 0, 1)
    s.edge(w, 0, 1, s.output(0), 0, 1)
    u = unroll(h)
    assert (len(u.nodes), len(u.links)) == (3, 2)
    assert "subgraph" in graph_dot(h) and "->" in unrolled_dot(u)


def fan(kind, outer, inner):
    """A node with forks (or joins) below the first one."""
    u = Unrolled()
    if kind == "fork":
        a = u.node("normal", "a", 0, 1)
        top = u.node("fork", "top", 1, outer)
        u.link(a, 0, top, 0, outer * inner)
        for k in range(outer):
            low = u.node("fork", f"f{k}", 1, inner)
            u.link(top, k, low, 0, inner)
            for j in range(inner):
                u.link(low, j, u.node("normal", f"v{k}{j}", 1, 0), 0, 1)
    else:
        a = u.node("normal", "a", 1, 0)
        top = u.node("join", "top", outer, 1)
        u.link(top, 0, a, 0, outer * inner)
        for k in range(outer):
            low = u.node("join", f"j{k}", inner, 1)
            u.link(low, 0, top, k, inner)
            for j in range(inner):
                u.link(u.node("normal", f"v{k}{j}", 0, 1), 0, low, j, 1)
    return u


@pytest.mark.parametrize(("kind", "rule"), [("fork", fork_fork), ("join", join_join)])
def test_nested_forks_and_joins_flatten_in_order(kind, rule):
    u = fan(kind, 2, 3)
    while rule(u):
        pass
    assert len(u.nodes) == 8
    top = next(n for n in u.nodes if n.kind == kind)
    ends = [e.sink.name for e in top.outs] if kind == "fork" else [e.source.name for e in top.ins]
    assert ends == ["v00", "v01", "v02", "v10", "v11", "v12"]


def test_join_fork_cancels():
    u = Unrolled()
    a, b = (u.node("normal", n, 0, 1) for n in "ab")
    c, d = (u.node("normal", n, 1, 0) for n in "cd")
    j, f = u.node("join", "j", 2, 1), u.node("fork", "f", 1, 2)
    u.link(a, 0, j, 0, 2)
    u.link(b, 0, j, 1, 2)
    u.link(j, 0, f, 0, 4)
    u.link(f, 0, c, 0, 2)
    u.link(f, 1, d, 0, 2)
    assert join_fork(u) and len(u.nodes) == 4
    assert {(e.source.name, e.sink.name) for e in u.links} == {("a", "c"), ("b", "d")}


def test_other_rewrites():
    u = Unrolled()
    u.link(u.node("init", "i", 0, 1), 0, u.node("end", "e", 1, 0), 0, 1)
    assert init_end(u) and not u.nodes
    a = u.node("normal", "a", 0, 1)
    b = u.node("normal", "b", 0, 1)
    j = u.node("join", "j", 2, 1)
    u.link(a, 0, j, 0, 1)
    u.link(b, 0, j, 1, 1)
    u.link(j, 0, u.node("end", "e", 1, 0), 0, 2)
    assert join_end(u) and len(u.nodes) == 4
    v = Unrolled()
    r, f = v.node("repeat", "r", 1, 1), v.node("fork", "f", 1, 2)
    v.link(v.node("normal", "a", 0, 1), 0, r, 0, 2)
    v.link(r, 0, f, 0, 4)
    for k in range(2):
        v.link(f, k, v.node("normal", f"v{k}", 1, 0), 0, 2)
    assert repeat_fork(v) and len(v.nodes) == 4 and any(n.kind is Kind.DUPLICATE for n in v.nodes)


def test_config_split():
    g = Graph("g")
    n = g.dynamic_param("n")
    c = g.config("c", 0, 1).output_params(n)
    x = g.actor("x", 1, 1).input_params(n)
    y = g.actor("y", 1, 0)
    g.edge(c, 0, 1, x, 0, 1)
    g.edge(x, 0, "n", y, 0, 1)
    run = split_configs(g)
    assert g.vertices == [c, run] and set(run.vertices) == {x, y} and len(run.inputs) == 1
    n.set(3)
    assert repetitions(run)[y] == 3


def test_schedule(spark):
    g = Graph("g")
    a, f = g.actor("a", 0, 1, timing=50), g.actor("b", 1, 0)
    g.edge(a, 0, 2, f, 0, 1)
    platform = Platform([Processor("p0", 0), Processor("p1", 0), Processor("p2", 1)])
    for scheduler in ("list", "greedy"):
        for mapper in ("best-fit", "round-robin"):
            tasks = schedule(unroll(g), platform, None, scheduler, mapper)
            ends = {t.node: t for t in tasks if t.what == "run"}
            assert len(ends) == 4
            for t in ends.values():
                assert all(ends[e.source].end <= t.start for e in t.node.ins if e is not None)
            alone(tasks)
    only = schedule(unroll(g), platform, Constraints({x: {"p1"} for x in ("a", "b", "fork-a_0")}))
    rows = statistics(as_table(spark, only)).collect()
    assert len(rows) == 1 and rows[0].jobs == 4 and rows[0].idle == 0 and rows[0].utilization == 1.0
    assert "<event" in gantt_xml(only) and gantt_svg(only).count("<rect") == 4 and "p1" in statistics_text(rows)


def test_walk_and_visit():
    g = Graph("g")
    a, s = g.actor("a", 0, 1), g.subgraph("s", 1, 0)
    b = s.actor("b", 1, 0)
    assert list(g.walk()) == [a, s, b]
    assert g.visit({"graph": lambda v: f"[{v.name}]", "normal": lambda v: v.name}) == ["a", "[s]", "b"]
    assert g.visit({"default": lambda v: v.kind}) == ["normal", "graph", "normal"] and g.visit({"fork": str}) == []


def alone(tasks):
    """No processor does two things at once."""
    for p in {t.processor.name for t in tasks}:
        own = sorted((t.start, t.end) for t in tasks if t.processor.name == p)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))


def test_transfers_take_time_on_both_sides():
    g = Graph("g")
    a, f = g.actor("a", 0, 1, timing=50), g.actor("b", 1, 0, timing=10)
    g.edge(a, 0, 3, f, 0, 3)
    platform = Platform([Processor("p0", 0), Processor("p1", 1)], send=lambda n: 5 * n, receive=lambda n: 7 * n)
    tasks = schedule(unroll(g), platform, Constraints({"a": {"p0"}, "b": {"p1"}}))
    assert [(t.what, t.processor.name, t.start, t.end) for t in tasks] == [("run", "p0", 0, 50), ("send", "p0", 50, 65), ("receive", "p1", 65, 86), ("run", "p1", 86, 96)]
    # Not told where, b stays where its tokens are: 60 on p0 against 50 + 10 + 15 + 21.
    assert {t.processor.name for t in schedule(unroll(g), platform, Constraints({"a": {"p0"}}))} == {"p0"}


def test_round_robin_turns_in_each_cluster():
    g = Graph("g")
    for k in range(4):
        g.edge(g.actor(f"a{k}", 0, 1), 0, 1, g.actor(f"b{k}", 1, 0), 0, 1)
    tasks = schedule(unroll(g), Platform([Processor("p0", 0), Processor("p1", 0)]), None, "list", "round-robin")
    assert sorted(t.processor.name for t in tasks) == ["p0"] * 4 + ["p1"] * 4
    alone(tasks)


def test_optimize_keeps_what_runs():
    u = optimize(unroll(pair(2, 1)))
    assert {n.name for n in u.nodes if n.vertex} == {"x", "y_0", "y_1"}
