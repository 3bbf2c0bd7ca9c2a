"""Patterns of nodes and relationships as joins.

match(graph, node("a", "Person"), out("KNOWS", "r"), node("b")) gives one row per match with flat columns: a__id,
a__name, r__id, r__since, b__id … so that Catalyst prunes what isn't used. A repeated variable is an equality, not a
second copy; a foreign-key relationship met from its source is a column, met from its target one join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph, Nodes, Rels, SemanticError


@dataclass(frozen=True)
class Node:
    var: str
    labels: tuple[str, ...] = ()
    props: tuple[tuple[str, Any], ...] = ()
    #: False: bind the id only, joining no node table.
    fetch: bool = True


@dataclass(frozen=True)
class Rel:
    types: tuple[str, ...]
    direction: str
    var: str | None = None
    props: tuple[tuple[str, Any], ...] = ()
    hops: tuple[int, int | None] | None = None
    path: str | None = None


def node(var: str, *labels: str, fetch: bool = True, **props: Any) -> Node:
    return Node(var, labels, tuple(props.items()), fetch)


def _types(types: str | list[str] | None) -> tuple[str, ...]:
    return () if types is None else (types,) if isinstance(types, str) else tuple(types)


def out(types=None, var: str | None = None, hops: tuple[int, int | None] | None = None, path: str | None = None, **props: Any) -> Rel:
    return Rel(_types(types), "out", var, tuple(props.items()), hops, path)


def into(types=None, var: str | None = None, hops: tuple[int, int | None] | None = None, path: str | None = None, **props: Any) -> Rel:
    return Rel(_types(types), "in", var, tuple(props.items()), hops, path)


def both(types=None, var: str | None = None, hops: tuple[int, int | None] | None = None, path: str | None = None, **props: Any) -> Rel:
    return Rel(_types(types), "both", var, tuple(props.items()), hops, path)


def prop(var: str, key: str = "id") -> Column:
    return F.col(f"{var}__{key}")


def value_of(df: DataFrame, var: str, key: str) -> Column:
    """A property's column, null if no node of the binding has it; a variable that isn't bound is an error."""
    if f"{var}__{key}" in df.columns:
        return prop(var, key)
    if not any(c.startswith(f"{var}__") for c in df.columns):
        raise SemanticError(f"{var} isn't bound")
    return F.lit(None)


def _where(df: DataFrame, props) -> DataFrame:
    for key, value in props:
        df = df.where(F.col(key) == value) if key in df.columns else df.where(F.lit(False))
    return df


def bind_nodes(graph: Graph, n: Node, tables: list[Nodes] | None = None) -> DataFrame:
    """The candidates of a node pattern, columns prefixed by its variable. The label of the table is a column too."""
    own = tables
    if own is None:
        own = [graph.nodes[k] for k in graph.tables_of(n.labels[0])] if n.labels else graph.nodes.values()
    parts = []
    for t in own:
        df = t.df
        for label in n.labels:
            if "labels" in df.columns:
                df = df.where(F.array_contains("labels", label))
            elif label != t.label:
                df = df.where(F.lit(False))
        df = _where(df, n.props)
        parts.append(df.select(F.lit(t.label).alias(f"{n.var}__label"), *(F.col(c).alias(f"{n.var}__{c}") for c in df.columns)))
    if not parts:
        return graph.spark.createDataFrame([], f"{n.var}__label string, {n.var}__id long")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _edges(graph: Graph, r: Rel, tables: list[Rels]) -> DataFrame:
    """(near, near_label, far, far_label, relationship's columns) of a relationship pattern, either way round if it has
    no direction; a loop comes once."""
    name = r.var or "_r"
    parts = []
    for t in tables:
        df = _where(graph.rel_frame(t), r.props)
        own = [F.lit(t.type).alias(f"{name}__type"), F.lit(f"{t.src}>{t.dst}").alias(f"{name}__ends"), *(F.col(c).alias(f"{name}__{c}") for c in df.columns)]
        ahead = df.select(F.col("src").alias("_near"), F.lit(t.src).alias("_near_label"), F.col("dst").alias("_far"), F.lit(t.dst).alias("_far_label"), *own)
        back = df.select(F.col("dst").alias("_near"), F.lit(t.dst).alias("_near_label"), F.col("src").alias("_far"), F.lit(t.src).alias("_far_label"), *own)
        if r.direction in ("out", "both"):
            parts.append(ahead)
        if r.direction == "in":
            parts.append(back)
        if r.direction == "both":
            parts.append(back.where("_near <> _far") if t.src == t.dst else back)
    if not parts:
        return graph.spark.createDataFrame([], f"_near long, _near_label string, _far long, _far_label string, {name}__id long, {name}__src long, {name}__dst long, {name}__type string, {name}__ends string")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df if r.var else df.drop(*(c for c in df.columns if c.startswith("_r__")))


def _possible(tables: list[Rels], direction: str, near: set[str] | None, far: set[str] | None) -> list[Rels]:
    """A relationship type fixes its ends' labels: tables that no end of the pattern fits go unread."""

    def fits(a: str, b: str) -> bool:
        return (near is None or a in near) and (far is None or b in far)

    return [t for t in tables if (direction != "in" and fits(t.src, t.dst)) or (direction != "out" and fits(t.dst, t.src))]


def _tables_of(graph: Graph, n: Node) -> set[str] | None:
    if not n.labels:
        return None
    return set(graph.tables_of(n.labels[0]))


def match(graph: Graph, *pattern: Node | Rel, into_df: DataFrame | None = None) -> DataFrame:
    """All matches of a chain of node and relationship patterns. into_df: bindings that the chain's first node, and any
    other variable they share, continue from."""
    first, rest = pattern[0], pattern[1:]
    bound = into_df
    if bound is None:
        df = _start(graph, first, *rest[:2]) if rest and not first.fetch and not first.props else None
        if df is not None:
            return match(graph, rest[1], *rest[2:], into_df=df) if len(rest) > 2 else df
        df = bind_nodes(graph, first)
    elif f"{first.var}__id" in bound.columns:
        df = bound
    else:
        df = bound.crossJoin(bind_nodes(graph, first))  # disjoint patterns: all combinations are what is asked for
    here = first
    for r, n in zip(rest[::2], rest[1::2], strict=True):
        df = _expand(graph, df, here, r, n)
        here = n
    return df


def _shortcut(tables: list[Rels], r: Rel) -> tuple[Rels, bool] | None:
    """The foreign key that the pattern follows, and whether from its holder."""
    if len(tables) != 1 or not tables[0].held or r.props or r.var or r.hops or r.direction == "both":
        return None
    return tables[0], bool(tables[0].key) == (r.direction == "out")


def _start(graph: Graph, first: Node, r: Rel, n: Node) -> DataFrame | None:
    """The first hop of a chain whose first node is bound by id only: its relationships tell the id, so its table isn't
    joined."""
    if r.hops or n.var == first.var:
        return None
    tables = _possible(graph.rel_tables(list(r.types)), r.direction, _tables_of(graph, first), _tables_of(graph, n))
    if not tables or any(graph.several(x) for t in tables for x in (t.src, t.dst)):
        return None
    short = _shortcut(tables, r)
    if short:
        t, ahead = short
        if ahead:
            return None
        holder, key, other = t.held
        far = bind_nodes(graph, n, [graph.nodes[holder]])
        return far.where(prop(n.var, key).isNotNull()).withColumns({f"{first.var}__id": prop(n.var, key).cast("long"), f"{first.var}__label": F.lit(other)})
    edges = _edges(graph, r, tables).withColumnsRenamed({"_near": f"{first.var}__id", "_near_label": f"{first.var}__label"})
    return _far_end(graph, edges, r, n, tables)


def _expand(graph: Graph, df: DataFrame, here: Node, r: Rel, n: Node) -> DataFrame:
    seen = f"{n.var}__id" in df.columns
    if r.hops:
        from ..operators.paths import expand_paths

        return expand_paths(graph, df, here, r, n, graph.rel_tables(list(r.types)), seen)
    tables = _possible(graph.rel_tables(list(r.types)), r.direction, _tables_of(graph, here), _tables_of(graph, n))
    short = None if seen else _shortcut(tables, r)
    if short:
        t, ahead = short
        holder, column, other = t.held
        if ahead and f"{here.var}__{column}" in df.columns:
            key = prop(here.var, column).cast("long")
            if not n.fetch and not n.props:
                return df.where(key.isNotNull()).withColumns({f"{n.var}__id": key, f"{n.var}__label": F.lit(other)})
            return df.join(bind_nodes(graph, n, [graph.nodes[other]]), key == prop(n.var))
        if not ahead:
            return df.join(bind_nodes(graph, n, [graph.nodes[holder]]), prop(here.var) == prop(n.var, column))
    edges = _edges(graph, r, tables)
    mixed = len({x for t in tables for x in (t.src, t.dst)}) > 1 and f"{here.var}__label" in df.columns
    on = prop(here.var) == F.col("_near")
    if mixed and len({t.src if r.direction == "out" else t.dst for t in tables}) > 1 or mixed and r.direction == "both":
        on &= prop(here.var, "label") == F.col("_near_label")
    if seen:
        on &= prop(n.var) == F.col("_far")
        if f"{n.var}__label" in df.columns:
            on &= prop(n.var, "label") == F.col("_far_label")
        return df.join(edges, on).drop("_near", "_near_label", "_far", "_far_label")
    return _far_end(graph, df.join(edges, on).drop("_near", "_near_label"), r, n, tables)


def _far_end(graph: Graph, df: DataFrame, r: Rel, n: Node, tables: list[Rels]) -> DataFrame:
    """Binds the far node of a hop."""
    if not n.fetch and not n.props:
        return df.withColumnsRenamed({"_far": f"{n.var}__id", "_far_label": f"{n.var}__label"})
    ends = {t.dst for t in tables if r.direction != "in"} | {t.src for t in tables if r.direction != "out"}
    far = bind_nodes(graph, n, [graph.nodes[x] for x in sorted(ends) if x in graph.nodes])
    on = F.col("_far") == prop(n.var)
    if len(ends) > 1:
        on &= F.col("_far_label") == prop(n.var, "label")
    return df.join(far, on).drop("_far", "_far_label")


def join_patterns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two patterns' matches: equal on the variables they share, all combinations if they share none."""
    shared = sorted(c for c in set(left.columns) & set(right.columns) if c.endswith("__id"))
    twice = [c for c in right.columns if c in left.columns and c not in shared]
    right = right.drop(*twice)
    return left.join(right, shared) if shared else left.crossJoin(right)


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """OPTIONAL MATCH: the right pattern's matches, already filtered, or nulls."""
    shared = sorted(c for c in set(left.columns) & set(right.columns) if c.endswith("__id"))
    right = right.drop(*[c for c in right.columns if c in left.columns and c not in shared])
    if not shared:
        return left.join(right, F.lit(True), "left")
    return left.join(right, shared, "left")


def having(left: DataFrame, right: DataFrame, negate: bool = False) -> DataFrame:
    """EXISTS(pattern), or NOT EXISTS: a semi join or an anti join on the variables they share."""
    shared = sorted(c for c in set(left.columns) & set(right.columns) if c.endswith("__id"))
    if not shared:
        raise SemanticError("EXISTS needs a variable that both sides have")
    return left.join(right.select(*shared), shared, "left_anti" if negate else "left_semi")


def distinct_edges(df: DataFrame, *vars_: str) -> DataFrame:
    """Relationship uniqueness: keeps rows whose named relationships differ. Ids are those of a type between two labels,
    so type and ends tell relationships apart, too."""
    for i, a in enumerate(vars_):
        for b in vars_[:i]:
            df = df.where((prop(a) != prop(b)) | (prop(a, "type") != prop(b, "type")) | (prop(a, "ends") != prop(b, "ends")))
    return df


def count_pairs(left: DataFrame, right: DataFrame, r: str, s: str, *by: str) -> DataFrame:
    """(by, pairs): how many rows of two patterns that meet on the variables they share hold different relationships r, of
    the left, and s, of the right. Counts are multiplied and pairs of one relationship taken off, so no pair is made. by
    are columns of the left beside the shared ones."""
    shared = sorted(c for c in set(left.columns) & set(right.columns) if c.endswith("__id"))
    if not shared:
        raise SemanticError("the patterns share no variable")
    same = ("id", "type", "ends")
    left = left.where(prop(r).isNotNull()).withColumnsRenamed({f"{r}__{c}": f"_{c}" for c in same})
    right = right.where(prop(s).isNotNull()).withColumnsRenamed({f"{s}__{c}": f"_{c}" for c in same})
    own, names = [f"_{c}" for c in same], [*shared, *(c for c in by if c not in shared)]

    def counted(keys: list[str], more: list[str]) -> DataFrame:
        n, m = (df.groupBy(*k).agg(F.count(F.lit(1)).alias(c)) for df, k, c in ((left, [*keys, *more], "_n"), (right, keys, "_m")))
        return n.join(m, keys).select(*names, (F.col("_n") * F.col("_m")).alias("_pairs"))

    extra = [c for c in names if c not in shared]
    every = counted(shared, extra).unionByName(counted([*shared, *own], extra).withColumn("_pairs", -F.col("_pairs")))
    return every.groupBy(*names).agg(F.sum("_pairs").alias("pairs")).where("pairs > 0")


def argument(spark: SparkSession) -> DataFrame:
    """One row without columns: where a query without a pattern starts."""
    return spark.range(1).select()


def return_all(df: DataFrame) -> DataFrame:
    """RETURN *: each bound variable, in name order, as a struct of its columns."""
    names = sorted({c.split("__", 1)[0] for c in df.columns if "__" in c and not c.startswith("_")})
    return df.select(*(F.struct(*(F.col(c).alias(c.split("__", 1)[1]) for c in df.columns if c.startswith(f"{v}__"))).alias(v) for v in names))


def returned(df: DataFrame, *items: str) -> DataFrame:
    """RETURN of variables' properties under their default names: returned(df, "n.name") has a column n.name."""
    out = []
    for item in items:
        var, _, key = item.partition(".")
        out.append(value_of(df, var, key or "id").alias(item))
    return df.select(*out)
