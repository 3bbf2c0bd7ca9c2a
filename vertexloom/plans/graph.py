"""A property graph as a snapshot of DataFrames.

Nodes: one DataFrame per label with `id` and a typed column per property (and, if nodes have more labels, `labels`).
Relationships: one DataFrame per type with `id`, `src`, `dst` and property columns. A relationship that a foreign key of
a node table stands for has no rows of its own: expanding it adds no join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import numbered

#: Ids of different labels share one space when labels are mixed: a label's number stands above this bit.
LABEL_SHIFT = 40


class GraphError(Exception):
    """Anything this package refuses."""


class SemanticError(GraphError):
    """A name that isn't bound or a pattern that doesn't fit the graph."""


class ConstraintViolation(GraphError):
    """A write that would break a constraint or leave a relationship without its node."""


class ReadOnly(GraphError):
    """A write through a read-only handle."""


class TypeMismatch(GraphError):
    """A value of a kind that an operation doesn't take."""


class NotFound(GraphError):
    """A label, type or id that the graph doesn't have."""


class ExecutionError(GraphError, RuntimeError):
    """A limit that a running query hits."""


class TransactionError(GraphError):
    """A use of a transaction that has ended."""


@dataclass(frozen=True)
class Later:
    """A table that is opened when it is first asked for. Its nodes have one label each."""

    make: Callable[[], Any]
    code: int = 0


class Tables(dict):
    """Tables by name; those that are Later are opened, and kept, on access."""

    def __getitem__(self, name):
        value = super().__getitem__(name)
        if isinstance(value, Later):
            value = value.make()
            super().__setitem__(name, value)
        return value

    def get(self, name, default=None):
        return self[name] if name in self else default

    def values(self):
        return [self[k] for k in self]

    def items(self):
        return [(k, self[k]) for k in self]

    def __or__(self, other):
        return Tables({**{k: dict.__getitem__(self, k) for k in self}, **other})

    def code(self, name) -> int:
        return dict.__getitem__(self, name).code

    def pending(self, name) -> bool:
        return isinstance(dict.__getitem__(self, name), Later)


@dataclass(frozen=True)
class Nodes:
    label: str
    df: DataFrame
    code: int = 0

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("id", "labels") and not c.startswith("_")]


@dataclass(frozen=True)
class Rels:
    type: str
    src: str
    dst: str
    df: DataFrame | None = None
    #: Of a foreign-key relationship: the column of the source's node table that holds the target's id, or the column of
    #: the target's that holds the source's.
    key: str | None = None
    back: str | None = None

    @property
    def held(self) -> tuple[str, str, str] | None:
        """(label of the table that holds the key, its column, label it refers to)."""
        if self.key:
            return self.src, self.key, self.dst
        return (self.dst, self.back, self.src) if self.back else None

    @property
    def properties(self) -> list[str]:
        return [] if self.df is None else [c for c in self.df.columns if c not in ("id", "src", "dst")]


@dataclass(frozen=True)
class Graph:
    """An immutable snapshot; writes return another."""

    spark: SparkSession
    nodes: Tables = field(default_factory=Tables)
    rels: Tables = field(default_factory=Tables)
    indexes: frozenset[tuple[str, str]] = frozenset()
    unique: frozenset[tuple[str, str]] = frozenset()
    required: frozenset[tuple[str, str]] = frozenset()

    def __post_init__(self):
        for name in ("nodes", "rels"):
            if not isinstance(getattr(self, name), Tables):
                object.__setattr__(self, name, Tables(getattr(self, name)))

    @staticmethod
    def of(spark: SparkSession, nodes: dict[str, DataFrame], rels: dict[str, tuple[str, str, DataFrame]] | None = None) -> Graph:
        """nodes: label to DataFrame with id; rels: type to (source label, target label, DataFrame with src, dst)."""
        made = {label: Nodes(label, df, k + 1) for k, (label, df) in enumerate(nodes.items())}
        tables = {}
        for kind, (src, dst, df) in (rels or {}).items():
            tables.setdefault(kind, []).append(Rels(kind, src, dst, df if "id" in df.columns else with_ids(df)))
        return Graph(spark, made, tables)

    def add_nodes(self, label: str, df: DataFrame | Callable[[], DataFrame], code: int | None = None) -> Graph:
        """df may be a function that opens the table; it is called once the table is asked for."""
        code = code or len(self.nodes) + 1
        table = Nodes(label, df, code) if isinstance(df, DataFrame) else Later(lambda: Nodes(label, df(), code), code)
        return replace(self, nodes=self.nodes | {label: table})

    def tables_of(self, label: str) -> list[str]:
        """The names of the tables whose nodes may have a label: its own, and those whose nodes have several."""
        return [k for k in self.nodes if k == label or self.several(k)]

    def several(self, name: str) -> bool:
        """Whether a table's nodes may have more labels than its name."""
        return name in self.nodes and not self.nodes.pending(name) and "labels" in self.nodes[name].df.columns

    def add_rels(self, rels: Rels) -> Graph:
        return replace(self, rels=self.rels | {rels.type: [*self.rels.get(rels.type, []), rels]})

    def node_table(self, label: str) -> Nodes | None:
        return self.nodes.get(label)

    def rel_frame(self, rels: Rels) -> DataFrame:
        """(id, src, dst, properties); a foreign key's relationship takes its holder's id."""
        if rels.df is not None:
            return rels.df
        holder, key, _ = rels.held
        own = self.nodes[holder].df.where(F.col(key).isNotNull())
        ends = [F.col("id"), F.col(key).cast("long")] if rels.key else [F.col(key).cast("long"), F.col("id")]
        return own.select("id", ends[0].alias("src"), ends[1].alias("dst"))

    def rel_tables(self, types: list[str] | None) -> list[Rels]:
        names = list(self.rels) if not types else [t for t in types if t in self.rels]
        return [r for t in names for r in self.rels[t]]

    # Introspection

    def all_nodes(self, *properties: str) -> DataFrame:
        """(id, labels, and the named properties) of all nodes; ids are of the shared space."""
        parts = []
        for n in self.nodes.values():
            labels = F.col("labels") if "labels" in n.df.columns else F.array(F.lit(n.label))
            parts.append(n.df.select(self.shared_id(n.label, F.col("id")).alias("id"), labels.alias("labels"), *(p for p in properties if p in n.df.columns)))
        if not parts:
            return self.spark.createDataFrame([], "id long, labels array<string>")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def all_rels(self, types: list[str] | None = None) -> DataFrame:
        """(type, src, dst) of all relationships, with ids of the shared space."""
        parts = [self.rel_frame(r).select(F.lit(r.type).alias("type"), self.shared_id(r.src, F.col("src")).alias("src"), self.shared_id(r.dst, F.col("dst")).alias("dst")) for r in self.rel_tables(types)]
        if not parts:
            return self.spark.createDataFrame([], "type string, src long, dst long")
        return reduce(DataFrame.unionByName, parts)

    def shared_id(self, label: str, local: Column) -> Column:
        """An id of the space that all labels share; raises where a local one is too large for it."""
        fits = (local >= 0) & (local < 1 << LABEL_SHIFT)
        return F.when(fits | local.isNull(), F.lit(self.nodes.code(label) << LABEL_SHIFT) + local).otherwise(F.raise_error(F.lit(f"an id of {label} is too large")).cast("long"))

    def labels(self) -> DataFrame:
        """The labels that nodes have; a table of one label is read for a single row."""
        parts = [n.df.select(F.explode("labels").alias("label")).distinct() if "labels" in n.df.columns else n.df.limit(1).select(F.lit(n.label).alias("label")) for n in self.nodes.values()]
        return reduce(DataFrame.unionByName, parts).distinct() if parts else self.spark.createDataFrame([], "label string")

    def relationship_types(self) -> list[str]:
        """The types that have relationships, in order; of each table a single row is read."""
        parts = [self.rel_frame(r).limit(1).select(F.lit(t).alias("type")) for t, tables in self.rels.items() for r in tables]
        return sorted({r.type for r in reduce(DataFrame.unionByName, parts).collect()}) if parts else []

    def node_count(self) -> int:
        return self.all_nodes().count()

    def relationship_count(self) -> int:
        return self.all_rels().count()

    def nodes_by_property(self, label: str, key: str, value) -> DataFrame:
        """The label's nodes whose property equals a value; none where no node has the property."""
        df = self._table(label).df
        return df.where(F.col(key) == value) if key in df.columns else df.where(F.lit(False))

    def _table(self, label: str) -> Nodes:
        if label not in self.nodes:
            raise NotFound(f"no label {label}")
        return self.nodes[label]

    def get_node(self, label: str, node_id: int) -> DataFrame:
        """A node by its id: one row or none; the filter reaches the scan."""
        return self._table(label).df.where(F.col("id") == node_id)

    def get_relationship(self, kind: str, rel_id: int, src: str | None = None, dst: str | None = None) -> DataFrame:
        """(type, start, end, id, src, dst) of the type's relationships with an id; the ends' labels tell those of
        several tables apart."""
        if kind not in self.rels:
            raise NotFound(f"no type {kind}")
        own = [r for r in self.rels[kind] if src in (None, r.src) and dst in (None, r.dst)]
        parts = [self.rel_frame(r).where(F.col("id") == rel_id).select(F.lit(kind).alias("type"), F.lit(r.src).alias("start"), F.lit(r.dst).alias("end"), "id", "src", "dst") for r in own]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "type string, start string, end string, id long, src long, dst long")

    def relationships_of(self, label: str, node_id: int, direction: str = "both", types: list[str] | None = None) -> DataFrame:
        """(type, id, src, dst) of a node's relationships; a loop counts once."""
        parts = []
        for r in self.rel_tables(types):
            ends = []
            if direction != "in" and r.src == label:
                ends.append(F.col("src") == node_id)
            if direction != "out" and r.dst == label:
                ends.append(F.col("dst") == node_id)
            if ends:
                parts.append(self.rel_frame(r).where(reduce(Column.__or__, ends)).select(F.lit(r.type).alias("type"), "id", "src", "dst"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "type string, id long, src long, dst long")

    def degrees(self, types: list[str] | None = None) -> DataFrame:
        """(id, degree) of nodes with relationships, over both directions; a loop counts once."""
        edges = self.all_rels(types)
        ends = edges.select(F.explode(F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))).alias("id"))
        return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def with_ids(df: DataFrame, start: int = 1) -> DataFrame:
    """Adds ids from start on, fixed in the shared folder."""
    return numbered(df.drop("id"), start)
