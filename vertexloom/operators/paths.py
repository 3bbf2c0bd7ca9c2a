"""Variable-length expansion and shortest paths: a frontier that is joined level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import LABEL_SHIFT, ExecutionError, Graph
from ..plans.match import Node, Rel, _edges, _tables_of, bind_nodes, prop
from ..sources.scratch import fixed

#: Levels that an unbounded expansion goes at most.
MOST_HOPS = 100


def _shared(graph: Graph, labels: list[str], ident: Column, label: Column) -> Column:
    """The id in the space that all labels share, by a column with the label."""
    out = F.lit(None).cast("long")
    for x in labels:
        out = F.when(label == x, graph.shared_id(x, ident)).otherwise(out)
    return out


def expand_paths(graph: Graph, df: DataFrame, here: Node, r: Rel, n: Node, tables, seen: bool) -> DataFrame:
    """All node-simple paths of r.hops (least, most) relationships. Binds the far node's id and, if r.path is named, the
    path's node ids, relationship ids and length. Where the relationships join several labels, the path's node ids are
    those of the space that labels share. Without an upper bound (most None), an error tells if MOST_HOPS levels aren't
    enough."""
    labels = sorted({x for t in tables for x in (t.src, t.dst)})
    mixed = len(labels) > 1
    least, most = r.hops
    edges = _edges(graph, Rel(r.types, r.direction, "_s", r.props), tables)
    if mixed:
        edges = edges.withColumns({c: _shared(graph, labels, F.col(c), F.col(f"{c}_label")) for c in ("_near", "_far")})
    edges = edges.select("_near", "_far", F.col("_s__id").alias("_rel"))
    name = r.path or "_p"
    start = _shared(graph, labels, prop(here.var), prop(here.var, "label")) if mixed else prop(here.var)
    level = df.select("*", F.array(start).alias(f"{name}__nodes"), F.array().cast("array<bigint>").alias(f"{name}__rels"), start.alias("_at"))
    out = None
    for k in range(1, (MOST_HOPS + 1 if most is None else most) + 1):
        step = level.join(edges, F.col("_at") == F.col("_near")).where(~F.array_contains(f"{name}__nodes", F.col("_far")))
        level = step.select(*df.columns, F.concat(f"{name}__nodes", F.array("_far")).alias(f"{name}__nodes"), F.concat(f"{name}__rels", F.array("_rel")).alias(f"{name}__rels"), F.col("_far").alias("_at"))
        long = most is None or most > 16
        if k % 8 == 0 and (most is None or k < most) or long and k % 4 == 0:
            level = fixed(level)  # cuts the lineage in the shared folder
        if long and k % 4 == 0 and level.isEmpty():  # long bounds: stop at an empty frontier
            break
        if most is None and k > MOST_HOPS:
            if not level.isEmpty():
                raise ExecutionError(f"paths are longer than {MOST_HOPS} hops")
            break
        if k >= least:
            out = level if out is None else out.unionByName(level)
    out = level.where(F.lit(False)) if out is None else out
    out = out.withColumn(f"{name}__length", F.size(f"{name}__rels"))
    if not r.path:
        out = out.drop(f"{name}__nodes", f"{name}__rels", f"{name}__length")
    if seen:
        there = _shared(graph, labels, prop(n.var), prop(n.var, "label")) if mixed else prop(n.var)
        return out.where(F.col("_at") == there).drop("_at")
    ends = sorted({t.dst for t in tables if r.direction != "in"} | {t.src for t in tables if r.direction != "out"})
    if not n.fetch and not n.props:
        wanted = _tables_of(graph, n)
        label = F.lit(labels[0] if labels else None)
        for x in labels if mixed else ():
            label = F.when(F.shiftright("_at", LABEL_SHIFT) == graph.nodes.code(x), x).otherwise(label)
        out = out.withColumn(f"{n.var}__label", label)
        if mixed:
            out = out.withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << LABEL_SHIFT) - 1)))
            out = out if wanted is None else out.where(prop(n.var, "label").isin(*sorted(wanted)))
        return out.withColumnRenamed("_at", f"{n.var}__id")
    far = bind_nodes(graph, n, [graph.nodes[x] for x in (ends if mixed else labels) if not mixed or (_tables_of(graph, n) or {x}) & {x}])
    there = _shared(graph, labels, prop(n.var), prop(n.var, "label")) if mixed else prop(n.var)
    return out.join(far, F.col("_at") == there).drop("_at")


def shortest_paths(edges: DataFrame, sources: DataFrame, most: int | None = None, directed: bool = True) -> DataFrame:
    """(source, target, hops, path) from each of sources (id) to all it reaches over edges (src, dst): breadth first,
    level by level; of paths of one length the least by node ids stays. The source itself is there with 0 hops.
    Without `most`, an error tells if MOST_HOPS levels aren't enough."""
    links = edges.select("src", "dst")
    if not directed:
        links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = links.distinct()
    found = sources.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0).alias("hops"), F.array("id").alias("path"))
    level = found
    for k in range(1, (MOST_HOPS + 1 if most is None else most) + 1):
        step = level.join(links, F.col("target") == F.col("src")).select("source", F.col("dst").alias("target"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(found.select("source", "target"), ["source", "target"], "left_anti").groupBy("source", "target").agg(F.min("path").alias("path"))
        level = fixed(step.select("source", "target", F.lit(k).alias("hops"), "path"))
        if level.isEmpty():
            break
        if most is None and k > MOST_HOPS:
            raise ExecutionError(f"paths are longer than {MOST_HOPS} hops")
        found = found.unionByName(level)
        if k % 4 == 0:  # one table again, of which the next levels read two columns
            found = fixed(found)
    return found


def path_nodes(path: str):
    return F.col(f"{path}__nodes")


def path_relationships(path: str):
    return F.col(f"{path}__rels")


def path_start(path: str):
    return F.element_at(f"{path}__nodes", 1)


def path_end(path: str):
    return F.element_at(f"{path}__nodes", -1)


def path_triples(path: str):
    """(start, relationship, end) of each step."""
    nodes, rels = F.col(f"{path}__nodes"), F.col(f"{path}__rels")
    return F.transform(rels, lambda r, i: F.struct(F.element_at(nodes, i + 1).alias("src"), r.alias("rel"), F.element_at(nodes, i + 2).alias("dst")))


def path_reversed(path: str):
    return F.struct(F.reverse(f"{path}__nodes").alias("nodes"), F.reverse(f"{path}__rels").alias("rels"))


def path_contains_node(path: str, node_id) -> Column:
    return F.array_contains(f"{path}__nodes", node_id)


def path_contains_relationship(path: str, rel_id) -> Column:
    return F.array_contains(f"{path}__rels", rel_id)


def path_node_at(path: str, place: int) -> Column:
    """The node id at a place counted from 0; null beyond the end."""
    return F.get(f"{path}__nodes", F.lit(place))


def path_relationship_at(path: str, place: int) -> Column:
    return F.get(f"{path}__rels", F.lit(place))


def path_append(df: DataFrame, path: str, rel_id: Column, node_id: Column) -> DataFrame:
    """The path with one more relationship and its node."""
    longer = {f"{path}__nodes": F.concat(f"{path}__nodes", F.array(node_id)), f"{path}__rels": F.concat(f"{path}__rels", F.array(rel_id)), f"{path}__length": F.col(f"{path}__length") + 1}
    return df.withColumns(longer)


def other_node(rel: str, node_id: Column) -> Column:
    """The other end of a bound relationship; null if the node is at neither."""
    src, dst = prop(rel, "src"), prop(rel, "dst")
    return F.when(node_id == src, dst).when(node_id == dst, src)
