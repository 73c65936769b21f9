"""A graph of nodes that runs: each node's stores and pushes as continuous queries.

A query hands the changed keys of a batch, as they stand, to the stores and pushes of its node; a
delta push gets the rows that came in. Sinks of one node and interval share a query; between two
triggers a key that changed many times is handed on once. Every query has a checkpoint named after
its node, so what is stopped and started again, edited or not, goes on where it ended.

Lookups that are given as functions are loaded when a query starts; ``reload`` starts the queries
that use them again, on fresh tables and old state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.build import Context, build_graph, changed
from ..plans.specs import LookupSpec, NodeSpec, PushSpec, SpecError, StoreSpec
from ..sources.sinks import Delivery, deliver
from .run import start


@dataclass(frozen=True)
class Part:
    """What one query of a node serves."""

    node: int
    interval: int
    delta: bool
    stores: tuple[StoreSpec, ...]
    pushes: tuple[PushSpec, ...]

    @property
    def name(self) -> str:
        return f"node-{self.node}-{'delta' if self.delta else 'full'}-{self.interval}"


def parts_of(node: NodeSpec) -> list[Part]:
    """The queries that a node needs: one for each interval, and for deltas apart from full rows."""
    wanted: dict[tuple[int, bool], tuple[list[StoreSpec], list[PushSpec]]] = {}
    for s in node.stores:
        wanted.setdefault((s.interval_seconds, False), ([], []))[0].append(s)
    for p in node.pushes:
        wanted.setdefault((p.interval_seconds, p.delta), ([], []))[1].append(p)
    return [Part(node.id, interval, delta, tuple(s), tuple(p)) for (interval, delta), (s, p) in sorted(wanted.items())]


@dataclass
class RunningGraph:
    """Nodes, what they read, and the queries that run them.

    lookups: a spec and a table, or a function that loads one. writers: how a store's target or a
    push's kind delivers a batch. folder: shared by all executors, for checkpoints. once: queries
    take what is there and end, instead of running until they are stopped.
    """

    nodes: Sequence[NodeSpec]
    messages: Mapping[int, DataFrame]
    writers: Mapping[str, Delivery]
    folder: str
    lookups: Mapping[int, tuple[LookupSpec, DataFrame | Callable[[], DataFrame]]] = field(default_factory=dict)
    context: Context | None = None
    once: bool = False
    queries: dict[str, StreamingQuery] = field(default_factory=dict)

    def __post_init__(self) -> None:
        missing = sorted({s.target for n in self.nodes for s in n.stores} | {p.kind for n in self.nodes for p in n.pushes} - set(self.writers))
        if missing := [m for m in missing if m not in self.writers]:
            raise SpecError(f"no writer for {', '.join(missing)}")

    def start(self, only: Iterable[int] | None = None) -> RunningGraph:
        """Starts the queries of all nodes, or of some."""
        chosen = None if only is None else set(only)
        loaded = {k: (spec, table() if callable(table) else table) for k, (spec, table) in self.lookups.items()}
        built = build_graph(self.nodes, replace(self.context or Context({}), messages=self.messages, lookups=loaded))
        for node in self.nodes:
            if chosen is None or node.id in chosen:
                for part in parts_of(node):
                    self._start(part, node, built[node.id].delta if part.delta else built[node.id].full)
        return self

    def _start(self, part: Part, node: NodeSpec, rows: DataFrame) -> None:
        if part.name in self.queries and self.queries[part.name].isActive:
            raise SpecError(f"{part.name} runs already")
        aggregated = not part.delta and (node.grouped or len(node.inputs) > 1)
        every = None if self.once else f"{part.interval} seconds"
        hand_on = lambda batch, n: deliver(batch, n, part.stores, part.pushes, self.writers)
        self.queries[part.name] = start(rows, hand_on, f"{self.folder}/{part.name}", "update" if aggregated else "append", every, part.name)

    def _of(self, nodes: Iterable[int] | None) -> list[str]:
        chosen = None if nodes is None else {f"node-{n}-" for n in nodes}
        return [name for name in self.queries if chosen is None or any(name.startswith(c) for c in chosen)]

    def drain(self, nodes: Iterable[int] | None = None) -> None:
        """Waits until all that has arrived is delivered; a query that failed raises its error."""
        for name in self._of(nodes):
            query = self.queries[name]
            query.awaitTermination() if self.once else query.processAllAvailable()

    def stop(self, nodes: Iterable[int] | None = None, drain: bool = True) -> None:
        """Stops queries, after what has arrived is delivered; start() goes on from their checkpoints."""
        if drain:
            self.drain(nodes)
        for name in self._of(nodes):
            self.queries.pop(name).stop()

    def reload(self, lookups: Iterable[int]) -> set[int]:
        """Loads lookups again for the nodes that use them and those that read from these; returns the nodes."""
        wanted = set(lookups)
        users = {n.id for n in self.nodes if any(j.lookup in wanted for j in n.joins)}
        while more := {n.id for n in self.nodes if n.id not in users and any(i.from_node and i.source in users for i in n.inputs)}:
            users |= more
        if users:
            self.stop(users)
            self.start(users)
        return users

    def edit(self, nodes: Sequence[NodeSpec]) -> set[int]:
        """Takes other nodes in place of these and starts again what the edit touches; returns these nodes.

        An edited node goes on from its checkpoint, which Spark allows as long as its keys and
        measures stay; give a node that aggregates otherwise another id.
        """
        touched = changed(self.nodes, nodes)
        self.stop(touched)
        self.nodes = nodes
        self.start(touched & {n.id for n in nodes})
        return touched
