"""Running graphs: iterations, configuration phases, state between runs."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from weirflow.operators.tokens import TokenStream
from weirflow.plans.graph import Graph, GraphError
from weirflow.plans.lower import Lowered, lower


log = logging.getLogger("weirflow")


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the session's machines share, if it names one."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)


@dataclass
class Options:
    """What a runtime does besides running: keep a trace, say what it does, use
    the plan of an earlier run with the same parameters and sources again."""

    trace: bool = True
    verbose: bool = False
    replay: bool = True


@dataclass
class Step:
    """One run: its iterations, the seconds that configuring and planning took, firings by actor, and whether the plan was at hand."""

    iterations: int
    configured: float
    planned: float
    firings: dict[str, int]
    replayed: bool


@dataclass
class Runtime:
    """Runs a graph again and again, keeping what persistent delays hold.

    Static graphs run any number of iterations as one plan (`run(n)`). In a
    dynamic graph, config actors run first: their kernels are called with the
    session and return values for the parameters they set, then the graph is
    lowered with those; so a dynamic graph takes one `run()` an iteration."""

    graph: Graph
    spark: SparkSession
    folder: str | None = None
    state: dict[str, TokenStream] = field(default_factory=dict)
    steps: int = 0
    options: Options = field(default_factory=Options)
    trace: list[Step] = field(default_factory=list)
    _plans: dict[tuple, tuple[dict, Lowered]] = field(default_factory=dict, repr=False)

    def run(self, sources: Mapping[str, TokenStream] | None = None, iterations: int = 1) -> Lowered:
        if iterations > 1 and not self.graph.fully_static:
            raise GraphError("a dynamic graph runs one iteration at a time")
        began = time.perf_counter()
        self.configure(self.graph)
        configured = time.perf_counter()
        given = dict(sources or {})
        key = (iterations, tuple((g.name, *sorted(g.scope().items())) for g in self._graphs()), tuple(sorted((k, id(s)) for k, s in given.items())))
        replayed = self.options.replay and not self.state and key in self._plans
        out = self._plans[key][1] if replayed else lower(self.graph, self.spark, given, iterations, self.state)
        if not out.state:  # without state a plan says the same whenever it is used; its sources are kept, so their ids stay theirs
            self._plans = {key: (given, out)}
        planned = time.perf_counter()
        self.steps += iterations
        self.state = {k: self._held(k, s) for k, s in out.state.items()}
        if self.options.trace:
            firings = {v.name: n for v, n in out.counts.items() if not isinstance(v, Graph)}
            self.trace.append(Step(iterations, configured - began, planned - configured, firings, replayed))
        if self.options.verbose:
            log.info("%s: %d iterations, %d firings, planned in %.3f s%s", self.graph.name, iterations, sum(out.counts.values()), planned - began, " (replayed)" if replayed else "")
        return out

    def _graphs(self) -> list[Graph]:
        return [self.graph, *(v for v in self.graph.walk() if isinstance(v, Graph))]

    def loop(self, sources_of, times: int) -> list[Lowered]:
        """`times` runs, with the sources of run k from sources_of(k)."""
        return [self.run(sources_of(k)) for k in range(times)]

    def forever(self, sources_of, until: Callable[[int], bool] = lambda k: False) -> Iterator[Lowered]:
        """Runs without end, each when it is asked for, until until(k) holds before run k."""
        k = 0
        while not until(k):
            yield self.run(sources_of(k))
            k += 1

    def summary(self, seconds: float | None = None) -> dict[str, float]:
        """Of all runs so far: iterations, firings, seconds of configuring and
        planning, and their share of the seconds that the application took, if these are given."""
        own = sum(s.configured + s.planned for s in self.trace)
        out = {"runs": len(self.trace), "iterations": sum(s.iterations for s in self.trace), "firings": sum(sum(s.firings.values()) for s in self.trace), "replayed": sum(s.replayed for s in self.trace), "seconds": own}
        return out | ({"overhead": own / seconds} if seconds else {})

    def configure(self, graph: Graph) -> None:
        for c in graph.configs:
            if c.sets:
                if c.kernel is None:
                    raise GraphError(f"{c.name} has no kernel")
                values = c.kernel(self.spark, [p.value(graph.scope()) for p in c.passes])
                if len(values) != len(c.sets):
                    raise GraphError(f"{c.name} gave {len(values)} values for {len(c.sets)} parameters")
                for p, x in zip(c.sets, values, strict=True):
                    p.set(x)
        for g in graph.subgraphs:
            self.configure(g)

    def _held(self, key: str, s: TokenStream) -> TokenStream:
        """State as a table, so that plans do not grow from run to run: in the
        folder given, where it outlives the session, or in the one that the
        session's machines share. Only where there is neither it goes through
        the driver, as many tokens as the delay holds."""
        if self.folder is None:
            shared = shared_folder(self.spark)
            if shared:
                self.folder = f"{shared.rstrip('/')}/weirflow-state-{uuid.uuid4().hex}"
        if self.folder is None:
            return TokenStream(self.spark.createDataFrame(s.df.collect(), s.df.schema))
        path = f"{self.folder}/{key}/{self.steps}"
        s.df.write.parquet(path)
        return TokenStream(self.spark.read.parquet(path))
