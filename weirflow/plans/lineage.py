"""Which firings' tokens a firing reads, and which firings read its tokens,
through interfaces, nested graphs, delays and any number of producers.

Positions stay global across the firings of nested graphs, so the way back from
what an actor reads to what another one made is arithmetic on a position, hop by
hop: one expression for each way. It is applied to the positions of one or more
iterations as a DataFrame; nothing is unrolled and nothing is joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.plans.graph import Edge, Graph, GraphError, Kind, Vertex
from weirflow.plans.repetition import rates, repetitions


@dataclass(frozen=True)
class Way:
    """Tokens of an input port that come from one output port: for which
    positions (SQL over `p`), and where they stand among those made. rate 0:
    tokens that a delay holds from the start, which no firing made."""

    when: str
    place: str
    source: str
    port: int
    rate: int


def _paths(graph: Graph, firings: int = 1, prefix: str = "") -> dict[Vertex, tuple[str, int]]:
    """Name and firings in one iteration of every actor at every level."""
    out: dict[Vertex, tuple[str, int]] = {}
    for v, n in repetitions(graph).items():
        out[v] = f"{prefix}{v.name}", n * firings
        if isinstance(v, Graph):
            out |= _paths(v, n * firings, f"{prefix}{v.name}/")
    return out


def _fires(graph: Graph) -> int:
    """How often a graph fires in one iteration of the top graph."""
    n, g = 1, graph
    while g.graph is not None:
        n *= repetitions(g.graph)[g]
        g = g.graph
    return n


def _ways(e: Edge, p: str, when: list[str], names: dict[Vertex, tuple[str, int]]) -> list[Way]:
    graph = e.graph
    scope = graph.scope()
    rv = repetitions(graph, scope)
    a, b = rates(e, scope)
    if a == 0 or b == 0:
        return []
    if e.source.kind is Kind.DELAY:
        return _getter(e, p, when, names)
    inner = b * rv.get(e.sink, 1)
    if e.delay is not None:
        d = e.delay.size.value(scope)
        if e.delay.persistent and e.delay.levels is None:
            held = [Way(" AND ".join([*when, f"({p}) < {d}"]), f"({p})", e.delay.vertex.name, 0, 0)]
            return held + _before(e, f"(({p}) - {d})", [*when, f"({p}) >= {d}"], names, inner)
        block, g = inner, graph
        for _ in range(e.delay.levels or 0):
            if g.graph is None:
                break
            block, g = block * repetitions(g.graph)[g], g.graph
        early, late = [*when, f"({p}) % {block} < {d}"], [*when, f"({p}) % {block} >= {d}"]
        return _set(e, f"(({p}) div {block} * {d} + ({p}) % {block})", early, names, d) + _before(e, f"(({p}) - {d})", late, names, inner)
    return _before(e, p, when, names, inner)


def _set(e: Edge, p: str, when: list[str], names: dict[Vertex, tuple[str, int]], size: int) -> list[Way]:
    """Tokens that a local delay holds when its graph starts."""
    if e.delay.setter is not None:
        return _ways(e.delay.setter, p, when, names)
    return [Way(" AND ".join(when), f"({p}) % {size}", e.delay.vertex.name, 0, 0)]


def _getter(e: Edge, p: str, when: list[str], names: dict[Vertex, tuple[str, int]]) -> list[Way]:
    """What a delay hands on when its graph ends: the last of what it held and what came."""
    d = next(d for d in e.graph.delays if d.vertex is e.source)
    size, block = d.size.value(e.graph.scope()), rates(d.edge, e.graph.scope())[1] * repetitions(e.graph)[d.edge.sink]
    line = f"({block} + ({p}) % {size})"
    early, late = [*when, f"{line} < {size}"], [*when, f"{line} >= {size}"]
    return _set(d.edge, f"(({p}) div {size} * {size} + {line})", early, names, size) + _before(d.edge, f"(({p}) div {size} * {block} + {line} - {size})", late, names, block)


def _before(e: Edge, p: str, when: list[str], names: dict[Vertex, tuple[str, int]], inner: int) -> list[Way]:
    """From a position on an edge, less its delay, to what was made."""
    graph, v = e.graph, e.source
    a, b = rates(e, graph.scope())
    if v.kind is Kind.INPUT:
        if e.sink.kind is not Kind.OUTPUT and a != inner:
            p = f"(({p}) div {inner} * {a} + ({p}) % {inner} % {a})"
        outer = graph.ins[graph.inputs.index(v)]
        return _ways(outer, p, when, names) if outer is not None else []
    if e.sink.kind is Kind.OUTPUT:
        made = a * repetitions(graph).get(v, 1)
        if made != b:
            p = f"(({p}) div {b} * {made} + {made - b} + ({p}) % {b})"
    if isinstance(v, Graph):
        return _ways(v.outputs[e.source_port].ins[0], p, when, names)
    return [Way(" AND ".join(when), p, names[v][0], e.source_port, a)]


def _tokens(spark: SparkSession, graph: Graph, iterations: int) -> DataFrame:
    """A row for each token that an actor reads: sink, port, k (the firing), at
    (its place there), source, source_port, firing and place there; firing -1: a delay."""
    if graph.graph is not None:
        raise GraphError("lineage starts at the top graph")
    names, parts = _paths(graph), []
    for v, (name, n) in names.items():
        if isinstance(v, Graph):
            continue
        for port, e in enumerate(v.ins):
            b = rates(e, e.graph.scope())[1]
            if not b or not n:
                continue
            read = spark.range(n * b * iterations).withColumnRenamed("id", "p")
            for w in _ways(e, "p", [], names):
                found = read.where(w.when) if w.when else read
                firing, place = (f"({w.place}) div {w.rate}", f"({w.place}) % {w.rate}") if w.rate else ("-1L", w.place)
                parts.append(found.select(F.lit(name).alias("sink"), F.lit(port).alias("port"), F.expr(f"p div {b}").alias("k"), F.expr(f"p % {b}").alias("at"), F.lit(w.source).alias("source"), F.lit(w.port).alias("source_port"), F.expr(firing).cast("bigint").alias("firing"), F.expr(place).cast("bigint").alias("place"), F.expr(f"({w.place}) - p").cast("bigint").alias("__run")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def reads(spark: SparkSession, graph: Graph, iterations: int = 1) -> DataFrame:
    """What each firing reads, a row a stretch of tokens: sink, port, k, at
    (where the stretch starts in what firing k reads), source, source_port, first
    and last firing that made it, and its first place in the one and its last in
    the other. A delay's own tokens are firing -1, their places count them."""
    runs = _tokens(spark, graph, iterations).groupBy("sink", "port", "k", "source", "source_port", "__run", F.expr("firing < 0").alias("__held"))
    found = runs.agg(F.min(F.struct("at", "firing", "place")).alias("a"), F.max(F.struct("at", "firing", "place")).alias("z"))
    return found.select("sink", "port", "k", F.col("a.at").alias("at"), "source", "source_port", F.col("a.firing").alias("first"), F.col("z.firing").alias("last"), F.col("a.place").alias("from"), F.col("z.place").alias("to"))


def readers(spark: SparkSession, graph: Graph, iterations: int = 1) -> DataFrame:
    """The inverse: for each firing and output port of an actor, the firings that
    read it, a row a stretch: source, source_port, firing, sink, port, first and
    last firing that reads, the places of the stretch in what was made (from, to).
    Output that nothing reads within these iterations has no sink and firing -1."""
    runs = _tokens(spark, graph, iterations).where("firing >= 0").groupBy("source", "source_port", "firing", "sink", "port", "__run")
    found = runs.agg(F.min("k").alias("first"), F.max("k").alias("last"), F.min("place").alias("from"), F.max("place").alias("to")).drop("__run")
    names, made = _paths(graph), []
    for v, (name, n) in names.items():
        if not isinstance(v, Graph):
            for port, e in enumerate(v.outs):
                a = rates(e, e.graph.scope())[0]
                if a and n:
                    made.append(spark.range(n * iterations).select(F.lit(name).alias("source"), F.lit(port).alias("source_port"), F.col("id").alias("firing"), F.lit(a - 1).cast("bigint").alias("__to")))
    if not made:
        return found
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    keys = ["source", "source_port", "firing"]
    alone = every.join(found.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit(None).cast("string").alias("sink"), F.lit(-1).alias("port"), F.lit(-1).cast("bigint").alias("first"), F.lit(-1).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("from"), F.col("__to").alias("to"))
    return found.select(*alone.columns).unionByName(alone)
