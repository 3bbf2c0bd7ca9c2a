"""Writes: each returns another snapshot of the graph and what it changed. Bindings are evaluated once, before the write,
in a checkpoint in the shared folder, so that a write never sees itself and a lost executor costs a reread."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import ConstraintViolation, Graph, Nodes, NotFound, ReadOnly, Rels, SemanticError, TransactionError
from ..sources.scratch import fixed, numbered


@dataclass
class Stats:
    nodes_created: int = 0
    nodes_deleted: int = 0
    relationships_created: int = 0
    relationships_deleted: int = 0
    properties_set: int = 0
    labels_added: int = 0
    labels_removed: int = 0

    def __add__(self, other: Stats) -> Stats:
        return Stats(*(a + b for a, b in zip(vars(self).values(), vars(other).values(), strict=True)))


def _next_id(df: DataFrame | None) -> int:
    return 1 if df is None else (df.agg(F.max("id")).first()[0] or 0) + 1


def _checked(graph: Graph, label: str) -> Graph:
    """Enforces the label's constraints."""
    own = graph.nodes[label].df
    for name, key in graph.unique:
        if name == label and key in own.columns and not own.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
            raise ConstraintViolation(f"{label}.{key} isn't unique")
    for name, key in graph.required:
        if name == label and (key not in own.columns or not own.where(F.col(key).isNull()).isEmpty()):
            raise ConstraintViolation(f"{label}.{key} is missing")
    return graph


def _with_rows(graph: Graph, label: str, rows: DataFrame) -> Graph:
    old = graph.nodes.get(label)
    df = rows if old is None else old.df.unionByName(rows, allowMissingColumns=True)
    return _checked(replace(graph, nodes=graph.nodes | {label: Nodes(label, df, old.code if old else len(graph.nodes) + 1)}), label)


def create_nodes(graph: Graph, label: str, rows: DataFrame, *more_labels: str) -> tuple[Graph, Stats]:
    """A node for each row, its columns being the properties."""
    old = graph.nodes.get(label)
    made = fixed(numbered(rows.drop("id"), _next_id(old.df if old else None)))
    if more_labels or (old is not None and "labels" in old.df.columns):
        made = made.withColumn("labels", F.array(*(F.lit(x) for x in (label, *more_labels))))
        if old is not None and "labels" not in old.df.columns:
            graph = replace(graph, nodes=graph.nodes | {label: replace(old, df=old.df.withColumn("labels", F.array(F.lit(label))))})
    n = made.count()
    return _with_rows(graph, label, made), Stats(nodes_created=n, labels_added=n * (1 + len(more_labels)))


def create_rels(graph: Graph, kind: str, src_label: str, dst_label: str, rows: DataFrame) -> tuple[Graph, Stats]:
    """A relationship for each row (src, dst, properties). Ids go on from the largest of the type, those that stand for
    keys included."""
    tables = graph.rels.get(kind, [])
    start = max((_next_id(graph.rel_frame(t)) for t in tables), default=1)
    made = fixed(numbered(rows.drop("id"), start))
    out, joined = [], False
    for t in tables:
        if (t.src, t.dst) == (src_label, dst_label) and t.df is not None:
            t, joined = replace(t, df=t.df.unionByName(made, allowMissingColumns=True)), True
        out.append(t)
    if not joined:
        out.append(Rels(kind, src_label, dst_label, made))
    return replace(graph, rels=graph.rels | {kind: out}), Stats(relationships_created=made.count())


def _set(df: DataFrame, key: str, updates: DataFrame) -> tuple[DataFrame, int]:
    new = fixed(updates.groupBy("id").agg(F.max("value").alias("_new"), F.lit(True).alias("_hit")))
    old = F.col(key) if key in df.columns else F.lit(None)
    return df.join(new, "id", "left").withColumn(key, F.when(F.col("_hit"), F.col("_new")).otherwise(old)).drop("_new", "_hit"), new.count()


def set_property(graph: Graph, label: str, key: str, updates: DataFrame) -> tuple[Graph, Stats]:
    """updates (id, value): of several values for one node the largest stays; null removes the property."""
    df, n = _set(graph.nodes[label].df, key, updates)
    out = replace(graph, nodes=graph.nodes | {label: replace(graph.nodes[label], df=df)})
    return _checked(out, label), Stats(properties_set=n)


def set_rel_property(graph: Graph, kind: str, src: str, dst: str, key: str, updates: DataFrame) -> tuple[Graph, Stats]:
    """updates (id, value) for relationships of a type between two labels; of several values for one the largest stays,
    null removes the property. A relationship that stands for a key gets a table of its own."""
    out, n, found = [], 0, False
    for t in graph.rels.get(kind, []):
        if (t.src, t.dst) == (src, dst):
            df, n = _set(graph.rel_frame(t), key, updates)
            t, found = Rels(kind, src, dst, df), True
        out.append(t)
    if not found:
        raise NotFound(f"no {kind} from {src} to {dst}")
    return replace(graph, rels=graph.rels | {kind: out}), Stats(properties_set=n)


def remove_rel_property(graph: Graph, kind: str, src: str, dst: str, key: str, ids: DataFrame) -> tuple[Graph, Stats]:
    own = [graph.rel_frame(t) for t in graph.rels.get(kind, []) if (t.src, t.dst) == (src, dst)]
    kind_of = dict(own[0].dtypes).get(key, "string") if own else "string"
    return set_rel_property(graph, kind, src, dst, key, ids.select("id", F.lit(None).cast(kind_of).alias("value")))


def merge_properties(graph: Graph, label: str, ids: DataFrame, values: dict[str, Any], replace_all: bool = False) -> tuple[Graph, Stats]:
    """SET n += map, or with replace_all SET n = map, for the nodes in ids (id)."""
    own = graph.nodes[label]
    hit = fixed(ids.select("id").distinct().withColumn("_hit", F.lit(True)))
    df = own.df.join(hit, "id", "left")
    for key in {*values, *(own.properties if replace_all else ())}:
        old = F.col(key) if key in own.df.columns else F.lit(None)
        df = df.withColumn(key, F.when(F.col("_hit"), F.lit(values.get(key))).otherwise(old))
    n = hit.count()
    out = replace(graph, nodes=graph.nodes | {label: replace(own, df=df.drop("_hit"))})
    return _checked(out, label), Stats(properties_set=n * len(values))


def remove_property(graph: Graph, label: str, key: str, ids: DataFrame) -> tuple[Graph, Stats]:
    kind = dict(graph.nodes[label].df.dtypes).get(key, "string")
    return set_property(graph, label, key, ids.select("id", F.lit(None).cast(kind).alias("value")))


def _relabel(graph: Graph, label: str, ids: DataFrame, change) -> Graph:
    own = graph.nodes[label]
    df = own.df if "labels" in own.df.columns else own.df.withColumn("labels", F.array(F.lit(label)))
    hit = fixed(ids.select("id").distinct().withColumn("_hit", F.lit(True)))
    df = df.join(hit, "id", "left").withColumn("labels", F.when(F.col("_hit"), change(F.col("labels"))).otherwise(F.col("labels"))).drop("_hit")
    return replace(graph, nodes=graph.nodes | {label: replace(own, df=df)})


def add_label(graph: Graph, label: str, added: str, ids: DataFrame) -> Graph:
    return _relabel(graph, label, ids, lambda x: F.array_union(x, F.array(F.lit(added))))


def remove_label(graph: Graph, label: str, removed: str, ids: DataFrame) -> Graph:
    return _relabel(graph, label, ids, lambda x: F.array_remove(x, removed))


def delete_nodes(graph: Graph, label: str, ids: DataFrame, detach: bool = False) -> tuple[Graph, Stats]:
    """Without detach, a node that has relationships is an error. With it, each relationship of a node that goes is deleted
    and counted once; where a key stands for it, the key of a node that stays becomes null."""
    gone = fixed(ids.select("id").distinct())
    mark = {end: gone.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")) for end in ("src", "dst")}
    rels, cut = {}, 0
    for kind, tables in graph.rels.items():
        out = []
        for t in tables:
            ends = [end for end, own in (("src", t.src), ("dst", t.dst)) if own == label]
            if ends:
                edges = graph.rel_frame(t)
                marked = edges
                for end in ends:
                    marked = marked.join(mark[end], end, "left")
                hit = reduce(Column.__or__, (F.col(f"_{end}").isNotNull() for end in ends))
                n = marked.where(hit).count()
                if n and not detach:
                    raise ConstraintViolation(f"nodes of {label} still have {kind} relationships")
                cut += n
                if n and t.held is None:
                    t = replace(t, df=marked.where(~hit).select(*edges.columns))
                elif n:
                    holder, key, other = t.held
                    if other == label:  # the key goes with what it refers to
                        own = graph.nodes[holder]
                        df = own.df.join(gone.select(F.col("id").alias("_gone")), F.col(key) == F.col("_gone"), "left")
                        df = df.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")
                        graph = replace(graph, nodes=graph.nodes | {holder: replace(own, df=df)})
            out.append(t)
        rels[kind] = out
    own = graph.nodes[label]
    df = own.df.join(gone, "id", "left_anti")
    n = own.df.join(gone, "id", "left_semi").count()
    return replace(graph, nodes=graph.nodes | {label: replace(own, df=df)}, rels=graph.rels | rels), Stats(nodes_deleted=n, relationships_deleted=cut)


def delete_rels(graph: Graph, kind: str, ids: DataFrame) -> tuple[Graph, Stats]:
    gone, n, out = fixed(ids.select("id").distinct()), 0, []
    for t in graph.rels.get(kind, []):
        if t.df is None:
            raise SemanticError(f"{kind} stands for a key; set the key to null")
        n += t.df.join(gone, "id", "left_semi").count()
        out.append(replace(t, df=t.df.join(gone, "id", "left_anti")))
    return replace(graph, rels=graph.rels | {kind: out}), Stats(relationships_deleted=n)


def merge_nodes(graph: Graph, label: str, rows: DataFrame, on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> tuple[Graph, DataFrame, Stats]:
    """A node for each different row of keys that no node of the label matches; rows of one statement see each other.
    on_create, on_match: expressions over the node's columns. Returns the merged nodes (id, keys) too."""
    keys = rows.columns
    wanted = fixed(rows.dropDuplicates())
    old = graph.nodes.get(label)
    if old is None or any(k not in old.df.columns for k in keys):
        graph, stats = create_nodes(graph, label, wanted.withColumns(on_create or {}))
        return graph, _first(graph.nodes[label].df, wanted, keys), stats
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    new = wanted.join(old.df.select(*keys), same(wanted, old.df), "left_anti")
    stats = Stats()
    if on_match:
        hit = old.df.join(wanted, same(old.df, wanted), "left_semi")
        for key, value in on_match.items():
            graph, more = set_property(graph, label, key, hit.select("id", value.alias("value")))
            stats += more
    if not new.isEmpty():
        graph, more = create_nodes(graph, label, new.withColumns(on_create or {}))
        stats += more
    return graph, _first(graph.nodes[label].df, wanted, keys), stats


def _first(nodes: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    found = nodes.join(wanted, [nodes[k].eqNullSafe(wanted[k]) for k in keys]).select(nodes["id"], *(nodes[k] for k in keys))
    return found.groupBy(*keys).agg(F.min("id").alias("id"))


def merge_rels(graph: Graph, kind: str, src_label: str, dst_label: str, rows: DataFrame) -> tuple[Graph, Stats]:
    """A relationship for each different (src, dst) that has none of the type."""
    wanted = rows.select("src", "dst").dropDuplicates()
    for t in graph.rels.get(kind, []):
        if (t.src, t.dst) == (src_label, dst_label):
            wanted = wanted.join(graph.rel_frame(t).select("src", "dst"), ["src", "dst"], "left_anti")
    return create_rels(graph, kind, src_label, dst_label, wanted)


class Transaction:
    """A working snapshot: writes go to it, commit hands it to the store, rollback drops it."""

    def __init__(self, store: Store, write: bool):
        self.store, self.write, self.graph, self.stats, self.open = store, write, store.graph, Stats(), True

    def apply(self, change, *args: Any, **kwargs: Any):
        """change: a write of this module; its graph argument is the working snapshot."""
        if not self.open:
            raise TransactionError("the transaction has ended")
        if not self.write:
            raise ReadOnly("a read-only transaction can't write")
        out = change(self.graph, *args, **kwargs)
        self.graph, *rest = out if isinstance(out, tuple) else (out,)
        self.stats += next((x for x in rest if isinstance(x, Stats)), Stats())
        return rest[0] if len(rest) == 2 else None

    def commit(self) -> Stats:
        if not self.open:
            raise TransactionError("the transaction has ended")
        self.store.graph, self.open = self.graph, False
        return self.stats

    def rollback(self) -> None:
        self.graph, self.open = self.store.graph, False


class Store:
    """Holds the current snapshot."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def begin(self, write: bool = True) -> Transaction:
        return Transaction(self, write)


def create_index(graph: Graph, label: str, key: str) -> Graph:
    """Recorded for introspection; scans prune by Parquet statistics, which sorting by the key on save improves."""
    return replace(graph, indexes=graph.indexes | {(label, key)})


def drop_index(graph: Graph, label: str, key: str) -> Graph:
    return replace(graph, indexes=graph.indexes - {(label, key)})


def create_constraint(graph: Graph, label: str, key: str, kind: str = "unique") -> Graph:
    out = replace(graph, unique=graph.unique | {(label, key)}) if kind == "unique" else replace(graph, required=graph.required | {(label, key)})
    return _checked(out, label) if label in out.nodes else out


def drop_constraint(graph: Graph, label: str, key: str) -> Graph:
    return replace(graph, unique=graph.unique - {(label, key)}, required=graph.required - {(label, key)})
