"""The graph that users describe: actors, edges with rates, delays, parameters,
interfaces and nested graphs. Building checks what can be checked at once;
rates and repetitions are `repetition`'s business."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from enum import StrEnum

from weirflow.functions.expr import Expression


class GraphError(ValueError):
    """A graph that cannot be built or run."""


class Kind(StrEnum):
    NORMAL = "normal"
    CONFIG = "config"
    DELAY = "delay"
    FORK = "fork"
    JOIN = "join"
    REPEAT = "repeat"
    DUPLICATE = "duplicate"
    TAIL = "tail"
    HEAD = "head"
    EXTERN_IN = "extern_in"
    EXTERN_OUT = "extern_out"
    INIT = "init"
    END = "end"
    GRAPH = "graph"
    INPUT = "input"
    OUTPUT = "output"


#: Ports that a kind must have: (inputs, outputs), None for any number.
ARITY = {
    Kind.DELAY: (1, 1), Kind.FORK: (1, None), Kind.JOIN: (None, 1), Kind.REPEAT: (1, 1), Kind.DUPLICATE: (1, None), Kind.TAIL: (None, 1), Kind.HEAD: (None, 1),
    Kind.EXTERN_IN: (0, 1), Kind.EXTERN_OUT: (1, 0), Kind.INIT: (0, 1), Kind.END: (1, 0), Kind.INPUT: (0, 1), Kind.OUTPUT: (1, 0),
}


class ParamKind(StrEnum):
    STATIC = "static"
    DYNAMIC = "dynamic"
    DERIVED = "derived"
    INHERITED = "inherited"


class Param:
    """A named whole number of one graph."""

    def __init__(self, name: str, kind: ParamKind, value: int | None = None, expression: Expression | None = None, parent: Param | None = None):
        self.name = name.lower()
        if not self.name or self.name in ("pi", "e"):
            raise GraphError(f"a parameter cannot be named {name!r}")
        self.kind, self.expression, self.parent, self._value = kind, expression, parent, value

    @property
    def dynamic(self) -> bool:
        return self.kind is ParamKind.DYNAMIC or (self.kind is ParamKind.DERIVED) or (self.kind is ParamKind.INHERITED and self.parent.dynamic)

    def set(self, value: int) -> None:
        if self.kind is not ParamKind.DYNAMIC:
            raise GraphError(f"{self.name} is not dynamic")
        self._value = int(value)

    def value(self, scope: Mapping[str, int] | None = None) -> int:
        if self.kind is ParamKind.INHERITED:
            return self.parent.value()
        if self.kind is ParamKind.DERIVED:
            return self.expression.value(scope or {})
        return self._value or 0


class Vertex:
    def __init__(self, kind: Kind, name: str, inputs: int, outputs: int, graph: Graph | None = None, kernel: Callable | None = None, timing: int = 100):
        want = ARITY.get(kind, (None, None))
        if any(w is not None and w != n for w, n in zip(want, (inputs, outputs), strict=True)):
            raise GraphError(f"a {kind} has {want[0]} inputs and {want[1]} outputs, {name!r} has {inputs} and {outputs}")
        if kind in (Kind.FORK, Kind.DUPLICATE) and outputs < 1 or kind in (Kind.JOIN, Kind.HEAD, Kind.TAIL) and inputs < 1:
            raise GraphError(f"{name!r} needs a port on its open side")
        self.kind, self.name, self.graph, self.kernel, self.timing = kind, name, graph, kernel, timing
        self.ins: list[Edge | None] = [None] * inputs
        self.outs: list[Edge | None] = [None] * outputs
        self.sees: list[Param] = []
        self.passes: list[Param] = []
        self.sets: list[Param] = []

    @property
    def executable(self) -> bool:
        return self.kind not in (Kind.GRAPH, Kind.INPUT, Kind.OUTPUT)

    def input_params(self, *params: Param) -> Vertex:
        self._own(params)
        self.sees += params
        return self

    def refinement_params(self, *params: Param) -> Vertex:
        """Parameters whose values the kernel is given, in this order."""
        self._own(params)
        self.passes += params
        return self

    def output_params(self, *params: Param) -> Vertex:
        if self.kind is not Kind.CONFIG:
            raise GraphError("only a config actor sets parameters")
        self._own(params)
        if any(p.kind is not ParamKind.DYNAMIC for p in params):
            raise GraphError("a config actor sets dynamic parameters only")
        self.sets += params
        return self

    def _own(self, params: Sequence[Param]) -> None:
        for p in params:
            if self.graph is None or self.graph.params.get(p.name) is not p:
                raise GraphError(f"{p.name} belongs to another graph than {self.name}")

    def __repr__(self) -> str:
        return f"{self.kind}:{self.name}"


class Delay:
    """`size` tokens that wait on an edge.

    levels 0: local, per firing of the graph, with an optional setter (port,
    rate) for the first and getter for the last tokens; levels k: kept across k
    levels of hierarchy; levels None: kept across iterations of the top graph.
    """

    def __init__(self, edge: Edge, size: Expression, levels: int | None, setter: tuple | None, getter: tuple | None):
        if any(p in edge.graph.params and edge.graph.params[p].dynamic for p in size.parameters):
            raise GraphError("a delay's size must be static")
        if levels != 0 and (setter or getter):
            raise GraphError("a persistent delay has no setter and no getter")
        if edge.delay is not None:
            raise GraphError("an edge has one delay at most")
        if Kind.DELAY in (edge.source.kind, edge.sink.kind):
            raise GraphError("no delay on an edge of a delay")
        self.edge, self.size, self.levels = edge, size, levels
        self.vertex = Vertex(Kind.DELAY, f"delay-{edge.source.name}_{edge.source_port}--{edge.sink.name}_{edge.sink_port}", 1, 1, edge.graph)
        edge.graph.delays.append(self)
        self.setter = self.getter = None
        if setter:
            self.setter = edge.graph.edge(setter[0], setter[1], setter[2], self.vertex, 0, size.text)
        if getter:
            self.getter = edge.graph.edge(self.vertex, 0, size.text, *getter)
        edge.delay = self

    @property
    def persistent(self) -> bool:
        return self.levels != 0


class Edge:
    def __init__(self, graph: Graph, source: Vertex, source_port: int, source_rate, sink: Vertex, sink_port: int, sink_rate):
        self.graph, self.delay = graph, None
        self.source = self.sink = None
        for v in (source, sink):
            inner = v.graph is not graph and v not in graph.inputs and v not in graph.outputs
            if inner:
                raise GraphError(f"{v.name} is not in graph {graph.name}")
        self.set_source(source, source_port, source_rate)
        try:
            self.set_sink(sink, sink_port, sink_rate)
        except GraphError:
            source.outs[source_port] = None
            raise

    def set_source(self, vertex: Vertex, port: int, rate) -> None:
        _free(vertex, vertex.outs, port, "output")
        if self.source is not None:
            self.source.outs[self.source_port] = None
        self.source, self.source_port, self.source_rate = vertex, port, Expression(rate)
        vertex.outs[port] = self

    def set_sink(self, vertex: Vertex, port: int, rate) -> None:
        _free(vertex, vertex.ins, port, "input")
        if self.sink is not None:
            self.sink.ins[self.sink_port] = None
        self.sink, self.sink_port, self.sink_rate = vertex, port, Expression(rate)
        vertex.ins[port] = self

    def __repr__(self) -> str:
        return f"{self.source.name}:{self.source_port} -> {self.sink.name}:{self.sink_port}"


def _free(vertex: Vertex, ports: list, port: int, what: str) -> None:
    if not 0 <= port < len(ports):
        raise GraphError(f"{vertex.name} has no {what} {port}")
    if ports[port] is not None:
        raise GraphError(f"{what} {port} of {vertex.name} is taken")


class Graph(Vertex):
    """A graph, itself an actor of the graph that holds it."""

    def __init__(self, name: str, inputs: int = 0, outputs: int = 0, graph: Graph | None = None):
        super().__init__(Kind.GRAPH, name, inputs, outputs, graph)
        self.inputs = [Vertex(Kind.INPUT, f"in_{k}", 0, 1, self) for k in range(inputs)]
        self.outputs = [Vertex(Kind.OUTPUT, f"out_{k}", 1, 0, self) for k in range(outputs)]
        self.vertices: list[Vertex] = []
        self.edges: list[Edge] = []
        self.delays: list[Delay] = []
        self.params: dict[str, Param] = {}

    # Building
    def add(self, kind: Kind | str, name: str, inputs: int, outputs: int, kernel: Callable | None = None, timing: int = 100) -> Vertex:
        kind = Kind(kind)
        if kind in (Kind.DELAY, Kind.INPUT, Kind.OUTPUT, Kind.GRAPH):
            raise GraphError(f"a {kind} is not added like this")
        return self.add_vertex(Vertex(kind, name, inputs, outputs, self, kernel, timing))

    def actor(self, name: str, inputs: int = 0, outputs: int = 0, kernel: Callable | None = None, timing: int = 100) -> Vertex:
        return self.add(Kind.NORMAL, name, inputs, outputs, kernel, timing)

    def config(self, name: str, inputs: int = 0, outputs: int = 0, kernel: Callable | None = None) -> Vertex:
        return self.add(Kind.CONFIG, name, inputs, outputs, kernel)

    def subgraph(self, name: str, inputs: int = 0, outputs: int = 0) -> Graph:
        return self.add_vertex(Graph(name, inputs, outputs, self))

    def add_vertex(self, vertex: Vertex) -> Vertex:
        if vertex in self.vertices:
            raise GraphError(f"{vertex.name} is in the graph already")
        vertex.graph = self
        self.vertices.append(vertex)
        return vertex

    def remove_vertex(self, vertex: Vertex) -> None:
        if vertex not in self.vertices:
            raise GraphError(f"{vertex.name} is not in the graph")
        for e in [x for x in [*vertex.ins, *vertex.outs] if x is not None]:
            self.remove_edge(e)
        self.vertices.remove(vertex)
        vertex.graph = None

    def move_vertex(self, vertex: Vertex, to: Graph) -> None:
        """The vertex goes to another graph, its edges stay where they are."""
        if vertex not in self.vertices or to is self:
            raise GraphError(f"{vertex.name} cannot be moved")
        self.vertices.remove(vertex)
        to.add_vertex(vertex)

    def edge(self, source: Vertex, source_port: int, source_rate, sink: Vertex, sink_port: int, sink_rate) -> Edge:
        e = Edge(self, source, source_port, source_rate, sink, sink_port, sink_rate)
        self.edges.append(e)
        return e

    def remove_edge(self, e: Edge) -> None:
        if e not in self.edges:
            raise GraphError(f"{e} is not in the graph")
        e.source.outs[e.source_port] = e.sink.ins[e.sink_port] = None
        if e.delay in self.delays:
            self.delays.remove(e.delay)
        self.edges.remove(e)

    def move_edge(self, e: Edge, to: Graph) -> None:
        if e not in self.edges or to is self:
            raise GraphError(f"{e} cannot be moved")
        self.edges.remove(e)
        to.edges.append(e)
        e.graph = to

    def add_input(self, name: str = "") -> Vertex:
        self.ins.append(None)
        self.inputs.append(Vertex(Kind.INPUT, name or f"in_{len(self.inputs)}", 0, 1, self))
        return self.inputs[-1]

    def add_output(self, name: str = "") -> Vertex:
        self.outs.append(None)
        self.outputs.append(Vertex(Kind.OUTPUT, name or f"out_{len(self.outputs)}", 1, 0, self))
        return self.outputs[-1]

    def input(self, k: int) -> Vertex:
        if not 0 <= k < len(self.inputs):
            raise GraphError(f"{self.name} has no input {k}")
        return self.inputs[k]

    def output(self, k: int) -> Vertex:
        if not 0 <= k < len(self.outputs):
            raise GraphError(f"{self.name} has no output {k}")
        return self.outputs[k]

    # Parameters
    def _param(self, p: Param) -> Param:
        if p.name in self.params:
            raise GraphError(f"{self.name} has a parameter {p.name} already")
        self.params[p.name] = p
        return p

    def static_param(self, name: str, value: int) -> Param:
        return self._param(Param(name, ParamKind.STATIC, int(value)))

    def dynamic_param(self, name: str) -> Param:
        return self._param(Param(name, ParamKind.DYNAMIC))

    def derived_param(self, name: str, expression: str) -> Param:
        e = Expression(expression)
        known = {x: self.param(x) for x in e.parameters}
        if not any(p.dynamic for p in known.values()):
            return self._param(Param(name, ParamKind.STATIC, e.value(self.scope())))
        return self._param(Param(name, ParamKind.DERIVED, expression=e))

    def inherited_param(self, name: str, parent: Param | None) -> Param:
        if parent is None:
            raise GraphError("an inherited parameter needs a parent")
        if not parent.dynamic:
            return self._param(Param(name, ParamKind.STATIC, parent.value()))
        return self._param(Param(name, ParamKind.INHERITED, parent=parent))

    def param(self, name: str) -> Param:
        if name.lower() not in self.params:
            raise GraphError(f"{self.name} has no parameter {name}")
        return self.params[name.lower()]

    def remove_param(self, p: Param) -> None:
        if self.params.get(p.name) is not p:
            raise GraphError(f"{p.name} is not in the graph")
        del self.params[p.name]

    def scope(self) -> dict[str, int]:
        """Values of all parameters; derived ones after those they name."""
        out = {n: p.value() for n, p in self.params.items() if p.kind is not ParamKind.DERIVED and not (p.kind is ParamKind.INHERITED and p.parent.kind is ParamKind.DERIVED)}
        for n, p in self.params.items():
            if p.kind is ParamKind.INHERITED and n not in out:
                out[n] = p.parent.value(self.graph.scope())
        left = [p for n, p in self.params.items() if n not in out]
        while left:
            ready = [p for p in left if p.expression.parameters <= out.keys()]
            if not ready:
                raise GraphError("parameters depend on each other")
            for p in ready:
                out[p.name] = p.value(out)
            left = [p for p in left if p not in ready]
        return out

    # Delays
    def persistent_delay(self, e: Edge, size) -> Delay | None:
        return self._delay(e, size, None)

    def local_persistent_delay(self, e: Edge, size, levels: int = 1) -> Delay | None:
        return self._delay(e, size, None if levels < 0 else levels)

    def local_delay(self, e: Edge, size, setter: tuple | None = None, getter: tuple | None = None) -> Delay | None:
        return self._delay(e, size, 0, setter, getter)

    def _delay(self, e: Edge, size, levels: int | None, setter: tuple | None = None, getter: tuple | None = None) -> Delay | None:
        size = Expression(size)
        if size.static and size.value() < 0:
            raise GraphError("a delay holds no negative number of tokens")
        if not any(self.params[p].dynamic for p in size.parameters if p in self.params) and size.value(self.scope()) == 0:
            return None  # a delay of nothing is no delay
        return Delay(e, size, levels, setter, getter)

    # Looking
    def walk(self) -> Iterator[Vertex]:
        """All vertices at all levels, a graph before what it holds."""
        for v in self.vertices:
            yield v
            if isinstance(v, Graph):
                yield from v.walk()

    def visit(self, visitors: Mapping[Kind | str, Callable[[Vertex], object]]) -> list:
        """What the visitors of their kinds return for all vertices; "default" is for the other kinds."""
        by_kind = {Kind(k) if k != "default" else k: f for k, f in visitors.items()}
        found = [(v, by_kind.get(v.kind, by_kind.get("default"))) for v in self.walk()]
        return [f(v) for v, f in found if f is not None]

    @property
    def subgraphs(self) -> list[Graph]:
        return [v for v in self.vertices if isinstance(v, Graph)]

    @property
    def configs(self) -> list[Vertex]:
        return [v for v in self.vertices if v.kind is Kind.CONFIG]

    @property
    def dynamic(self) -> bool:
        return any(p.kind is ParamKind.DYNAMIC for p in self.params.values())

    @property
    def fully_static(self) -> bool:
        return not self.dynamic and all(g.fully_static for g in self.subgraphs)

    def actor_count(self) -> int:
        """Actors at all levels; a subgraph counts by what it holds."""
        return sum(v.actor_count() if isinstance(v, Graph) else 1 for v in self.vertices)

    def clear(self) -> None:
        for v in list(self.vertices):
            self.remove_vertex(v)
        for e in list(self.edges):
            self.remove_edge(e)
        self.params.clear()
        self.delays.clear()

    def indirect_source(self, e: Edge) -> tuple[Vertex, int]:
        """The actor that feeds an edge, through interfaces and subgraphs."""
        v, port = e.source, e.source_port
        while v.kind in (Kind.INPUT, Kind.GRAPH):
            e = v.graph.ins[v.graph.inputs.index(v)] if v.kind is Kind.INPUT else v.outputs[port].ins[0]
            if e is None:
                break
            v, port = e.source, e.source_port
        return v, port

    def indirect_sink(self, e: Edge) -> tuple[Vertex, int]:
        v, port = e.sink, e.sink_port
        while v.kind in (Kind.OUTPUT, Kind.GRAPH):
            e = v.graph.outs[v.graph.outputs.index(v)] if v.kind is Kind.OUTPUT else v.inputs[port].outs[0]
            if e is None:
                break
            v, port = e.sink, e.sink_port
        return v, port


def split_configs(graph: Graph) -> Graph | None:
    """Config actors stay, everything else moves to a new subgraph `run`, at
    every level; edges that now cross get interfaces. Returns the subgraph, or
    None where nothing had to be done."""
    for g in list(graph.subgraphs):
        split_configs(g)
    if not graph.configs or not graph.dynamic:
        return None
    for c in graph.configs:
        if any(e is not None and e.source.kind is not Kind.INPUT for e in c.ins):
            raise GraphError("a config actor is fed by interfaces only")
    moved = [v for v in graph.vertices if v.kind is not Kind.CONFIG]
    if not moved:
        return None
    run = graph.subgraph("run")
    for p in list(graph.params.values()):
        run.inherited_param(p.name, p)
    for v in moved:
        graph.move_vertex(v, run)
        # Parameters of what moves are those of the new graph.
        v.sees, v.passes = ([run.params[p.name] for p in x] for x in (v.sees, v.passes))
        if isinstance(v, Graph):
            for p in v.params.values():
                if p.kind is ParamKind.INHERITED and graph.params.get(p.parent.name) is p.parent:
                    p.parent = run.params[p.parent.name]
    for e in list(graph.edges):
        inside = [v in moved or v.kind is Kind.DELAY for v in (e.source, e.sink)]
        if all(inside):
            graph.move_edge(e, run)
            if e.delay is not None:
                graph.delays.remove(e.delay)
                run.delays.append(e.delay)
                e.delay.vertex.graph = run
        elif inside[1]:  # from a config actor or an interface into the run graph
            gate, sink, port, rate = run.add_input(), e.sink, e.sink_port, e.sink_rate.text
            e.set_sink(run, len(run.ins) - 1, e.source_rate.text)
            run.edge(gate, 0, e.source_rate.text, sink, port, rate)
        elif inside[0]:
            gate, source, port, rate = run.add_output(), e.source, e.source_port, e.source_rate.text
            e.set_source(run, len(run.outs) - 1, e.sink_rate.text)
            run.edge(source, port, rate, gate, 0, e.sink_rate.text)
    return run
