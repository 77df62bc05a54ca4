"""Graphs and schedules as text: DOT, Gantt XML, Gantt SVG, statistics."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from weirflow.plans.expand import Unrolled
from weirflow.plans.graph import Graph, Kind
from weirflow.plans.schedule import Task

COLOURS = {Kind.FORK: "lightblue", Kind.JOIN: "lightgreen", Kind.CONFIG: "orange", Kind.INIT: "grey", Kind.END: "grey"}


def _quote(x: str) -> str:
    return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'


def graph_dot(graph: Graph) -> str:
    """Actors as boxes, nested graphs as clusters, rates and delays on edges."""
    lines = ["digraph {", "  rankdir=LR; node [shape=box];"]

    def name(path: str, v) -> str:
        return _quote(f"{path}{v.name}")

    def body(g: Graph, path: str, pad: str) -> None:
        for p in g.params.values():
            lines.append(f"{pad}{_quote(f'{path}param {p.name}')} [shape=ellipse,label={_quote(p.name)}];")
        for v in [*g.inputs, *g.outputs, *g.vertices]:
            if isinstance(v, Graph):
                lines.append(f"{pad}subgraph {_quote(f'cluster {path}{v.name}')} {{ label={_quote(v.name)};")
                body(v, f"{path}{v.name}/", pad + "  ")
                lines.append(f"{pad}}}")
            else:
                lines.append(f"{pad}{name(path, v)} [label={_quote(v.name)},fillcolor={COLOURS.get(v.kind, 'white')},style=filled];")
        for e in g.edges:
            # An edge of a nested graph ends at the interface inside.
            ends = []
            for v, port, side in ((e.source, e.source_port, "outputs"), (e.sink, e.sink_port, "inputs")):
                ends.append(_quote(f"{path}{v.name}/{getattr(v, side)[port].name}") if isinstance(v, Graph) else name(path, v))
            label = f"{e.source_rate.text} -> {e.sink_rate.text}" + (f" (delay {e.delay.size.text})" if e.delay is not None else "")
            lines.append(f"{pad}{ends[0]} -> {ends[1]} [label={_quote(label)}];")

    body(graph, "", "  ")
    return "\n".join([*lines, "}"])


def unrolled_dot(g: Unrolled) -> str:
    lines = ["digraph {", "  rankdir=LR; node [shape=box];"]
    lines += [f"  {_quote(n.name)} [fillcolor={COLOURS.get(n.kind, 'white')},style=filled];" for n in g.nodes]
    lines += [f"  {_quote(e.source.name)} -> {_quote(e.sink.name)} [label={_quote(str(e.rate))}];" for e in g.links]
    return "\n".join([*lines, "}"])


def gantt_xml(tasks: list[Task]) -> str:
    events = [f'  <event start="{t.start}" end="{t.end}" title={quoteattr(t.node.name)} mapping={quoteattr(t.processor.name)} kind="{t.what}"/>' for t in tasks]
    return "\n".join(["<data>", *events, "</data>"])


def gantt_svg(tasks: list[Task], width: int = 1000, row: int = 24) -> str:
    names = sorted({t.processor.name for t in tasks})
    scale = width / max([t.end for t in tasks], default=1)
    boxes = []
    for t in tasks:
        y = names.index(t.processor.name) * row
        boxes.append(f'  <g><title>{t.node.name}: {t.start} - {t.end}</title><rect x="{t.start * scale:.2f}" y="{y}" width="{max(1, (t.end - t.start) * scale):.2f}" height="{row - 4}" fill="{"#7aa" if t.what == "run" else "#a77"}"/></g>')
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{row * len(names)}">', *boxes, "</svg>"])


def statistics_text(rows: list) -> str:
    """The rows of schedule.statistics, one line a processor."""
    return "\n".join(f"{r.processor}: start {r.start}, end {r.end}, load {r.load}, idle {r.idle}, jobs {r.jobs}, use {r.utilization:.3f}" for r in rows)
