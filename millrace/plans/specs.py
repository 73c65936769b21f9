"""What a dataflow is made of, as plain data: messages, nodes, lookups, stores and pushes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame


# Kinds of sources that a variable may have.
MESSAGE, NODE, LOOKUP = 0, 1, 2


class SpecError(ValueError):
    """A declaration that cannot be built."""


@dataclass(frozen=True)
class FieldSpec:
    """An output column of a node.

    value: Spark SQL text, or ``class:<function>:f1,f2`` for a registered function. For a key of a
    node with several inputs: ``inputId:text;inputId:text``. source: the input that a column of
    such a node is computed from, if its names do not tell. variables: names that the value's text
    uses, each with the kind and id of its source and its column there; the text then sees these only.
    """

    name: str
    type: str = "VARCHAR"
    value: str = ""
    method: str = "NONE"
    key: bool = False
    source: int | None = None
    variables: Mapping[str, tuple[int, int, str]] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class InputSpec:
    """An input edge: of a message or a node, its full rows or its deltas, filtered."""

    id: int
    source: int
    from_node: bool = False
    filter: str | None = None
    delta: bool = False


@dataclass(frozen=True)
class JoinSpec:
    """A lookup of a node: its key columns, and the columns of the input or of an earlier lookup that they equal."""

    lookup: int
    on: Mapping[str, str]
    take: Mapping[str, str]
    parent: int = 0
    input: int | None = None


@dataclass(frozen=True)
class LookupSpec:
    """A dimension table. unique_keys: each a list of columns; order decides which of equals is last; check filters.

    unique: its source sees to it that no key occurs twice, so none has to be looked for.
    """

    id: int
    name: str
    unique_keys: tuple[tuple[str, ...], ...]
    types: Mapping[str, str] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    check: str | None = None
    unique: bool = False


@dataclass(frozen=True)
class StoreSpec:
    """A sink with a filter and a renaming projection; key names the columns that a row replaces by.

    interval_seconds: how often a continuous query hands its changed keys on (0: as fast as it can).
    """

    target: str
    mapping: Mapping[str, str] = field(default_factory=dict)
    filter: str | None = None
    key: tuple[str, ...] = ()
    interval_seconds: int = 0


@dataclass(frozen=True)
class PushSpec:
    """A message sink with a filter; key_kind: hash of the key, long field, or text of fields.

    delta: it gets a row for each row that came in, else the rows of changed keys as they stand.
    """

    kind: str
    target: str
    filter: str | None = None
    delta: bool = False
    key_kind: str = "hash"
    key: tuple[str, ...] = ()
    options: Mapping[str, str] = field(default_factory=dict)
    interval_seconds: int = 0


@dataclass(frozen=True)
class NodeSpec:
    """A query operator: inputs, lookups, output columns, sinks."""

    id: int
    name: str
    inputs: tuple[InputSpec, ...]
    fields: tuple[FieldSpec, ...]
    joins: tuple[JoinSpec, ...] = ()
    output_filter: str | None = None
    null_policy: str = "zero"
    arrival_order: tuple[str, ...] = ()
    stores: tuple[StoreSpec, ...] = ()
    pushes: tuple[PushSpec, ...] = ()

    @property
    def grouped(self) -> bool:
        return any(f.method != "NONE" for f in self.fields)

    def __post_init__(self) -> None:
        if not self.inputs:
            raise SpecError(f"{self.name}: a node needs an input")
        if len({f.name for f in self.fields}) != len(self.fields):
            raise SpecError(f"{self.name}: two columns have one name")
        if self.grouped:
            loose = [f.name for f in self.fields if f.method == "NONE" and not f.key]
            if loose:
                raise SpecError(f"{self.name}: {', '.join(loose)} must be a key or have a group method")
        if len(self.inputs) > 1 and not any(f.key for f in self.fields):
            raise SpecError(f"{self.name}: several inputs meet on a key, and none is declared")
        known = {0}
        for j in self.joins:
            if j.parent not in known:
                raise SpecError(f"{self.name}: lookup {j.lookup} follows {j.parent}, which is not joined before it")
            known.add(j.lookup)
            if not j.on:
                raise SpecError(f"{self.name}: lookup {j.lookup} has no key")
            if len(self.inputs) > 1 and j.input is not None and j.input not in {i.id for i in self.inputs}:
                raise SpecError(f"{self.name}: lookup {j.lookup} belongs to input {j.input}, which there is not")


_NESTED = {"inputs": InputSpec, "fields": FieldSpec, "joins": JoinSpec, "stores": StoreSpec, "pushes": PushSpec}


def from_dict(kind: type, data: Mapping[str, Any]) -> Any:
    """A spec from a dictionary, as JSON gives it; an unknown entry is an error."""
    names = {f.name for f in fields(kind)}
    if unknown := set(data) - names:
        raise SpecError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    plain = {}
    for name, value in data.items():
        if kind is NodeSpec and name in _NESTED:
            value = tuple(from_dict(_NESTED[name], x) for x in value)
        elif isinstance(value, list):
            value = tuple(tuple(x) if isinstance(x, list) else x for x in value)
        plain[name] = value
    return kind(**plain)


def pairs(text: str | None) -> dict[str, str]:
    """``a:b,c:d`` as a mapping; parts that are no pair are passed over."""
    return dict(p.split(":") for p in (text or "").split(",") if p.count(":") == 1)


def key_lists(text: str | None) -> tuple[tuple[str, ...], ...]:
    """``k1,k2;k3``: alternative keys of columns."""
    return tuple(tuple(c.strip() for c in k.split(",")) for k in (text or "").split(";") if k.strip())


def variable_sources(text: str | None) -> dict[str, tuple[int, int, str]]:
    """``variable:kind:id:column,...``: where each variable of a column's text comes from."""
    out = {}
    for part in (p for p in (text or "").split(",") if p.strip()):
        found = [x.strip() for x in part.split(":")]
        if len(found) != 4 or found[1] not in ("0", "1", "2") or not found[2].isdigit():
            raise SpecError(f"no variable, kind, id and column in {part}")
        out[found[0]] = (int(found[1]), int(found[2]), found[3])
    return out


def option_lines(text: str | None) -> dict[str, str]:
    """``key=value`` lines."""
    return {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in (text or "").splitlines()) if k.strip() and _}


def nodes_from_tables(tables: Mapping[str, DataFrame]) -> list[NodeSpec]:
    """Nodes from a catalogue in tables: node, input, field and, if there, join, store and push.

    Columns are named as the specs' entries; field, input, join, store and push have node_id. A
    catalogue is small by nature and is read to the driver.
    """

    def grouped(name: str) -> dict[int, list[dict[str, Any]]]:
        out: dict[int, list[dict[str, Any]]] = {}
        if name in tables:
            for row in tables[name].collect():
                entry = {k: v for k, v in row.asDict().items() if v is not None}
                out.setdefault(entry.pop("node_id"), []).append(entry)
        return out

    def ordered(entries: Iterable[dict[str, Any]]) -> list[dict[str, Any]]:
        found = sorted(entries, key=lambda e: e.get("position", 0))
        return [{k: v for k, v in e.items() if k != "position"} for e in found]

    inputs, columns, joins, stores, pushes = (grouped(n) for n in ("input", "field", "join", "store", "push"))
    for entry in (e for es in columns.values() for e in es if "variables" in e):
        entry["variables"] = variable_sources(entry["variables"])
    for entry in (e for es in joins.values() for e in es):
        entry |= {"on": pairs(entry.get("on")), "take": pairs(entry.get("take"))}
    for entry in (e for es in stores.values() for e in es):
        entry |= {"mapping": pairs(entry.get("mapping")), "key": tuple(c for c in entry.get("key", "").split(",") if c)}
    for entry in (e for es in pushes.values() for e in es):
        entry |= {"options": option_lines(entry.get("options")), "key": tuple(c for c in entry.get("key", "").split(",") if c)}
    found = []
    for row in tables["node"].collect():
        entry = {k: v for k, v in row.asDict().items() if v is not None}
        entry["arrival_order"] = tuple(c for c in entry.get("arrival_order", "").split(",") if c)
        n = entry["id"]
        found.append(from_dict(NodeSpec, entry | {"inputs": ordered(inputs.get(n, [])), "fields": ordered(columns.get(n, [])), "joins": ordered(joins.get(n, [])), "stores": ordered(stores.get(n, [])), "pushes": ordered(pushes.get(n, []))}))
    return found
