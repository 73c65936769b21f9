"""Specs to DataFrames. Every node is one lazy plan; Spark plans the graph as a whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import FunctionRegistry
from ..functions.types import spark_type, typed
from ..operators.aggregate import Measure, aggregate, aggregate_inputs, deltas
from ..operators.lookup import lookup_join
from ..operators.merge import merged_rows
from .specs import LOOKUP, NODE, FieldSpec, InputSpec, JoinSpec, LookupSpec, NodeSpec, SpecError


@dataclass(frozen=True)
class NodeResult:
    """full: a row for each key as it stands now; delta: a row for each row that came in."""

    full: DataFrame
    delta: DataFrame


@dataclass
class Context:
    """Tables that a graph reads, and the functions that its columns may call."""

    messages: Mapping[int, DataFrame]
    lookups: Mapping[int, tuple[LookupSpec, DataFrame]] = field(default_factory=dict)
    functions: FunctionRegistry = field(default_factory=FunctionRegistry)


def column_of(text: str, functions: FunctionRegistry) -> Column:
    """A column's value: Spark SQL text, or a registered function of columns."""
    if text.startswith("class:"):
        _, name, arguments = text.split(":", 2)
        return functions.call(name, *(F.col(a.strip()) for a in arguments.split(",") if a.strip()))
    return F.expr(text)


def resolves(df: DataFrame, column: Column) -> bool:
    try:
        df.select(column)
    except AnalysisException:
        return False
    return True


def with_lookups(node: NodeSpec, df: DataFrame, joins: Sequence[JoinSpec], context: Context) -> DataFrame:
    for j in joins:
        if j.lookup not in context.lookups:
            raise SpecError(f"{node.name}: there is no lookup {j.lookup}")
        spec, table = context.lookups[j.lookup]
        if spec.unique_keys and not any(set(k) == set(j.on.values()) for k in spec.unique_keys):
            raise SpecError(f"{node.name}: {', '.join(j.on.values())} is no declared key of {spec.name}")
        missing = [c for c in j.on if c not in df.columns]
        if missing:
            raise SpecError(f"{node.name}: {', '.join(missing)} is in no input or lookup before {spec.name}")
        types = {new: spec.types[c] for new, c in j.take.items() if c in spec.types}
        df = lookup_join(df, table, j.on, j.take, types, spec.order, spec.check, spec.unique)
    return df


def key_parts(node: NodeSpec, f: FieldSpec) -> dict[int, str]:
    """A key's text for each input."""
    ids = [i.id for i in node.inputs]
    if len(ids) == 1:
        return {ids[0]: f.value}
    found = {int(i): text for i, _, text in (p.partition(":") for p in f.value.split(";"))}
    if set(found) != set(ids):
        raise SpecError(f"{node.name}: key {f.name} needs a value for each of the inputs {ids}")
    return found


def _owner(f: FieldSpec, column: Column, inputs: Mapping[int, DataFrame]) -> int | None:
    """The input that has all that a column names, -1 if none has; None for a count that names nothing."""
    if f.source is not None:
        return f.source
    if f.method == "COUNT" and resolves(next(iter(inputs.values())).select(F.lit(1).alias("_nothing")), column):
        return None
    return next((i for i, df in inputs.items() if resolves(df, column)), -1)


def with_variables(node: NodeSpec, df: DataFrame, sources: Sequence[InputSpec]) -> DataFrame:
    """df and a column for each field whose variables all come from it, computed from these alone.

    A variable names a column of a message, of a node, or one that a lookup gave.
    """
    out = df
    for f in node.fields:
        if f.variables and (found := _variables(node, f, sources, df)) is not None:
            narrow = out.select(F.struct("*").alias("_all"), *(F.col(c).alias(v) for v, c in found.items()))
            out = narrow.select("_all", F.expr(f.value).alias(variable_column(f))).select("_all.*", variable_column(f))
    return out


def variable_column(f: FieldSpec) -> str:
    return f"_value_of_{f.name}"


def _variables(node: NodeSpec, f: FieldSpec, sources: Sequence[InputSpec], df: DataFrame) -> dict[str, str] | None:
    """Column of df for each variable of a field; None if df has not all of them."""
    out = {}
    for variable, (origin, source, name) in f.variables.items():
        if origin == LOOKUP:
            taken = next((new for j in node.joins if j.lookup == source for new, c in j.take.items() if c == name), None)
        else:
            taken = name if any(i.source == source and i.from_node == (origin == NODE) for i in sources) else None
        if taken is None or taken not in df.columns:
            return None
        out[variable] = taken
    return out


def build_node(node: NodeSpec, inputs: Mapping[int, DataFrame], context: Context) -> NodeResult:
    """The node's plan over its inputs, by input id."""
    tables = {}
    for i in node.inputs:
        df = inputs[i.id].filter(i.filter) if i.filter else inputs[i.id]
        own = [j for j in node.joins if j.input in (None, i.id)] if len(node.inputs) > 1 else node.joins
        if len(node.inputs) > 1:
            own = [j for j in own if j.input == i.id or all(c in df.columns for c in j.on)]
        tables[i.id] = with_variables(node, with_lookups(node, df, own, context), [i])
    keys = [f for f in node.fields if f.key]
    result = _single(node, tables, keys, context) if len(tables) == 1 else _several(node, tables, keys, context)
    if node.output_filter:
        result = NodeResult(result.full.filter(node.output_filter), result.delta.filter(node.output_filter))
    return result


def _column(f: FieldSpec, context: Context) -> Column:
    return F.col(variable_column(f)) if f.variables else column_of(f.value, context.functions)


def _measure(f: FieldSpec, column: Column) -> Measure:
    return Measure(f.name, f.method, None if f.method == "COUNT" else column, f.type)


def _single(node: NodeSpec, tables: Mapping[int, DataFrame], keys: list[FieldSpec], context: Context) -> NodeResult:
    (df,) = tables.values()
    columns = {f.name: _column(f, context) if f.value else F.lit(None) for f in node.fields}
    for f in node.fields:
        if not resolves(df, columns[f.name]):
            raise SpecError(f"{node.name}: {f.value} of {f.name} names a column that its input has not")
    if not node.grouped:
        rows = df.select(*(typed(columns[f.name], f.type).alias(f.name) for f in node.fields))
        return NodeResult(rows, rows)
    measures = [_measure(f, columns[f.name]) for f in node.fields if f.method != "NONE"]
    order = [c for c in node.arrival_order]
    key_columns = [typed(columns[f.name], f.type).alias(f.name) for f in keys]
    names = [f.name for f in node.fields]
    full = aggregate(df, key_columns, measures, order, node.null_policy).select(*names)
    return NodeResult(full, deltas(df, key_columns, measures, null_policy=node.null_policy).select(*names))


def _several(node: NodeSpec, tables: Mapping[int, DataFrame], keys: list[FieldSpec], context: Context) -> NodeResult:
    key_columns = {i: {f.name: typed(column_of(key_parts(node, f)[i], context.functions), f.type) for f in keys} for i in tables}
    own: dict[int, list[tuple[FieldSpec, Column]]] = {i: [] for i in tables}
    late: list[tuple[FieldSpec, Column]] = []
    everywhere: list[FieldSpec] = []
    for f in node.fields:
        if f.key:
            continue
        column = _column(f, context) if f.value else F.lit(1)
        owner = _owner(f, column, tables)
        if owner is None:
            everywhere.append(f)
        elif owner == -1:
            if node.grouped:
                raise SpecError(f"{node.name}: {f.name} must be computed from one input")
            late.append((f, column))
        else:
            own[owner].append((f, column))
    names = [f.name for f in keys]
    order = list(node.arrival_order)
    if node.grouped:
        # A count that names no input counts the rows of all of them.
        parts = [(tables[i], list(key_columns[i].values()), [*(_measure(f, c) for f, c in own[i]), *(Measure(f"_{f.name}_{i}", "COUNT") for f in everywhere)]) for i in tables]
        merged = aggregate_inputs(parts, names, order, node.null_policy)
        for f in everywhere:
            merged = merged.withColumn(f.name, sum((F.coalesce(F.col(f"_{f.name}_{i}"), F.lit(0)) for i in tables), F.lit(0).cast("long")))
        full = merged.select(*(f.name for f in node.fields))
    else:
        # A column that needs several inputs is computed once all are there, from the rows they have.
        sides = [(tables[i], key_columns[i], {f.name: c for f, c in own[i]} | ({"_row": F.struct("*")} if late else {}), order) for i in tables]
        merged = merged_rows(sides)
        place = {i: n for n, i in enumerate(tables)}
        plain = [F.col(n) for n in names] + [typed(F.col(f"row_{place[i]}").getField(f.name), f.type).alias(f.name) for i in tables for f, _ in own[i]]
        full = merged.select(F.struct(*plain).alias("_known"), "_complete", *(F.col(f"row_{n}._row").alias(f"_row_{n}") for n in place.values() if late))
        computed = {}
        for f, column in late:
            if f.variables:
                found = {}
                for i in node.inputs:
                    for v, spec in f.variables.items():
                        one = _variables(node, FieldSpec(f.name, variables={v: spec}, value=f.value), [i], tables[i.id])
                        found.setdefault(v, F.col(f"_row_{place[i.id]}").getField(one[v])) if one else None
                if missing := set(f.variables) - set(found):
                    raise SpecError(f"{node.name}: no input has {', '.join(sorted(missing))} of {f.name}")
                column = F.expr(f.value)
            else:
                # Of inputs that share a name the first one is meant; variables tell them apart.
                found = {c: F.col(f"_row_{place[i]}").getField(c) for i in reversed(list(tables)) for c in tables[i].columns}
            narrow = full.select(F.struct("*").alias("_all"), *(c.alias(v) for v, c in found.items()))
            if not resolves(narrow, column):
                raise SpecError(f"{node.name}: {f.value} of {f.name} names a column that no input has")
            computed[f.name] = f"_late_{f.name}"
            full = narrow.select("_all", column.alias(computed[f.name])).select("_all.*", computed[f.name])
        full = full.select(*((F.when(F.col("_complete"), F.col(computed[f.name])) if f.name in computed else F.col(f"_known.{f.name}")).alias(f.name) for f in node.fields))
    delta = None
    for i, df in tables.items():
        values = {f.name: (F.lit(1).cast("long") if f.method == "COUNT" else typed(c, f.type)) for f, c in own[i]} | {f.name: F.lit(1).cast("long") for f in everywhere} | key_columns[i]
        rows = df.select(*((values[f.name] if f.name in values else F.lit(None).cast(default_type(f))).alias(f.name) for f in node.fields))
        delta = rows if delta is None else delta.unionByName(rows)
    return NodeResult(full, delta)


def default_type(f: FieldSpec) -> str:
    return spark_type(f.type).simpleString()


def build_graph(nodes: Sequence[NodeSpec], context: Context) -> dict[int, NodeResult]:
    """All nodes by id. A node that several others read is planned once for all."""
    by_id = {n.id: n for n in nodes}
    built: dict[int, NodeResult] = {}

    def visit(n: int, path: tuple[int, ...]) -> NodeResult:
        if n in built:
            return built[n]
        if n in path:
            raise SpecError(f"nodes read each other in a circle: {' > '.join(map(str, [*path, n]))}")
        if n not in by_id:
            raise SpecError(f"there is no node {n}")
        tables = {}
        for i in by_id[n].inputs:
            if i.from_node:
                above = visit(i.source, (*path, n))
                tables[i.id] = above.delta if i.delta else above.full
            elif i.source in context.messages:
                tables[i.id] = context.messages[i.source]
            else:
                raise SpecError(f"{by_id[n].name}: there is no message {i.source}")
        built[n] = build_node(by_id[n], tables, context)
        return built[n]

    for n in by_id:
        visit(n, ())
    return built


def changed(old: Sequence[NodeSpec], new: Sequence[NodeSpec]) -> set[int]:
    """Ids of nodes to start again: added, removed or edited ones, and all that read from them."""
    before, after = {n.id: n for n in old}, {n.id: n for n in new}
    found = {i for i in before.keys() | after.keys() if before.get(i) != after.get(i)}
    while more := {n.id for n in [*old, *new] if n.id not in found and any(i.from_node and i.source in found for i in n.inputs)}:
        found |= more
    return found


__all__ = ["Context", "NodeResult", "build_graph", "build_node", "changed"]
