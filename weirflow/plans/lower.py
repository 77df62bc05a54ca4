"""A graph and its streams to DataFrames.

Firings are never unrolled: an actor's firings are blocks of positions, and a
nested graph is lowered once for all its firings, because positions stay global
across them. Data movement is not planned actor by actor: a run of forks, joins,
heads, tails and duplicates is put together as pieces of the streams that enter
it, so what cancels out leaves no trace and each stream is read once. Cycles are allowed where a delay breaks them only through state
kept between runs; a cycle within one run has no lowering and is refused."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import SparkSession

from weirflow.operators import movement as M
from weirflow.operators.kernels import Firing
from weirflow.operators.tokens import TokenStream
from weirflow.plans.graph import Edge, Graph, GraphError, Kind, Vertex
from weirflow.plans.repetition import rates, repetitions


#: Actors that only rearrange the tokens of a firing.
MOVES = (Kind.FORK, Kind.JOIN, Kind.HEAD, Kind.TAIL, Kind.DUPLICATE)


@dataclass
class Lowered:
    """Streams of every edge as its sink reads them, what external outputs got
    and the tokens that persistent delays hold at the end."""

    edges: dict[Edge, TokenStream] = field(default_factory=dict)
    outputs: dict[str, TokenStream] = field(default_factory=dict)
    state: dict[str, TokenStream] = field(default_factory=dict)
    counts: dict[Vertex, int] = field(default_factory=dict)


def lower(graph: Graph, spark: SparkSession, sources: Mapping[str, TokenStream] | None = None, iterations: int = 1, state: Mapping[str, TokenStream] | None = None) -> Lowered:
    """`iterations` iterations of a graph whose parameters are all set. Streams
    in `sources` feed the EXTERN_IN actors of these names; an incomplete last
    iteration is not fired: positions beyond it are left out."""
    out = Lowered()
    _body(graph, spark, sources or {}, iterations, dict(state or {}), {}, out)
    return out


def complete_iterations(graph: Graph, source: str, tokens: int) -> int:
    """How many iterations `tokens` tokens of a source feed."""
    v = next(v for v in graph.vertices if v.name == source)
    need = v.outs[0].source_rate.value(graph.scope()) * repetitions(graph)[v]
    return tokens // need if need else 0


def _order(graph: Graph) -> list[Vertex]:
    """Actors after those that feed them. Setters and getters of delays count as edges of the delayed one."""
    feeds: dict[Vertex, set[Vertex]] = {v: set() for v in graph.vertices}
    for e in graph.edges:
        source = e.delay.setter.source if e.delay is not None and e.delay.setter is not None else None
        ends = [(e.source, e.sink)] + ([(source, e.sink)] if source is not None else [])
        if e.source.kind is Kind.DELAY:
            d = next(d for d in graph.delays if d.vertex is e.source)
            ends = [(d.edge.source, e.sink)]
        for a, b in ends:
            if a in feeds and b in feeds:
                feeds[b].add(a)
    done: list[Vertex] = []
    while len(done) < len(feeds):
        ready = [v for v in feeds if v not in done and feeds[v] <= set(done)]
        if not ready:
            raise GraphError("a cycle feeds itself within one iteration; lower it iteration by iteration")
        done += ready
    return done


def _body(graph: Graph, spark: SparkSession, sources: Mapping[str, TokenStream], firings: int, state: dict[str, TokenStream], given: dict[Vertex, TokenStream], out: Lowered) -> dict[Vertex, TokenStream]:
    scope = graph.scope()
    rv = repetitions(graph, scope)
    made: dict[tuple[Vertex, int], TokenStream | M.Blocks] = {(v, 0): s for v, s in given.items()}
    left: dict[Vertex, TokenStream] = {}

    def read(e: Edge) -> TokenStream | M.Blocks | None:
        """The stream of an edge as its sink sees it; blocks where data is only moved on."""
        a, b = rates(e, scope)
        if e.source.kind is Kind.DELAY:
            d = next(d for d in graph.delays if d.vertex is e.source)
            read(d.edge)
        found = made.get((e.source, e.source_port))
        if found is None or b == 0:
            return None
        if isinstance(found, M.Blocks):
            if e.sink.kind in MOVES and a == b and e.delay is None:
                return found
            found = found.stream()
        inner = b * (rv[e.sink] if e.sink in rv else 1)
        if e.source.kind is Kind.INPUT and e.sink.kind is not Kind.OUTPUT:
            found = M.input_interface(found, a, inner)
        elif e.sink.kind is Kind.OUTPUT:
            found = M.output_interface(found, a * (rv.get(e.source, 1)), b)
        if e.delay is not None:
            size = e.delay.size.value(scope)
            if e.delay.persistent and e.delay.levels is None:
                key = e.delay.vertex.name
                found, out.state[key] = M.persistent_delay(found, size, inner * firings, state.get(key))
            else:
                # Kept across levels: the stream of one firing of the graph that many levels up is one block.
                block, times, g = inner, firings, graph
                for _ in range(e.delay.levels or 0):
                    if g.graph is None:
                        break
                    n = repetitions(g.graph)[g]
                    block, times, g = block * n, times // max(1, n), g.graph
                setter = read(e.delay.setter) if e.delay.setter is not None else None
                found, made[(e.delay.vertex, 0)] = M.local_delay(found, size, block, times, setter)
        out.edges[e] = found
        return M.Blocks.of(found, b) if e.sink.kind in MOVES else found

    for v in _order(graph):
        n = rv[v] * firings
        out.counts[v] = n
        if n == 0:
            continue
        ins = [read(e) for e in v.ins]
        in_rates, out_rates = [rates(e, scope)[1] for e in v.ins], [rates(e, scope)[0] for e in v.outs]
        if isinstance(v, Graph):
            inner = {v.inputs[k]: s for k, s in enumerate(ins) if s is not None}
            found = _body(v, spark, sources, n, state, inner, out)
            results = [found.get(o) for o in v.outputs]
        else:
            results = _fire(v, spark, ins, in_rates, out_rates, [p.value(scope) for p in v.passes], n, sources, out)
        for port, s in enumerate(results):
            if s is not None:
                made[(v, port)] = s
    for o in graph.outputs:
        if o.ins[0] is not None:
            found = read(o.ins[0])
            if found is not None:
                left[o] = found
    return left


def _fire(v: Vertex, spark: SparkSession, ins: list, in_rates: list[int], out_rates: list[int], params: list[int], n: int, sources: Mapping[str, TokenStream], out: Lowered) -> list[TokenStream | None]:
    match v.kind:
        case Kind.EXTERN_IN:
            if v.name not in sources:
                raise GraphError(f"no stream for {v.name}")
            return [sources[v.name].at("pos", f"pos < {n * out_rates[0]}")]
        case Kind.EXTERN_OUT:
            out.outputs[v.name] = ins[0]
            return []
        case Kind.FORK:
            if in_rates[0] != sum(out_rates):
                raise M.RateError(f"a fork of {in_rates[0]} tokens gives {sum(out_rates)}")
            return [ins[0].cut(o, r) for o, r in zip(accumulate([0, *out_rates]), out_rates, strict=False)]
        case Kind.JOIN:
            if sum(in_rates) != out_rates[0]:
                raise M.RateError(f"a join of {sum(in_rates)} tokens gives {out_rates[0]}")
            return [M.Blocks.joined([x for x in ins if x is not None])]
        case Kind.HEAD | Kind.TAIL:
            whole = M.Blocks.joined([x for x in ins if x is not None])
            return [whole.cut(0 if v.kind is Kind.HEAD else whole.size - out_rates[0], out_rates[0])]
        case Kind.REPEAT:
            return [M.repeat(ins[0], in_rates[0], out_rates[0])]
        case Kind.DUPLICATE:
            if any(r != in_rates[0] for r in out_rates):
                raise M.RateError(f"{v.name} duplicates {in_rates[0]} tokens to {out_rates}")
            return [ins[0]] * len(out_rates)
        case Kind.INIT:
            return [TokenStream(spark.range(n * out_rates[0]).selectExpr("id AS pos", "0L AS v"))]
        case Kind.END:
            return []
        case _:
            if v.kernel is None:
                raise GraphError(f"{v.name} has no kernel")
            if v.kind is Kind.CONFIG and not v.outs:
                return []
            found = list(v.kernel(Firing(spark, ins, in_rates, out_rates, params, n)))
            return found + [None] * (len(v.outs) - len(found))
