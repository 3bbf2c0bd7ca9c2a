"""A property graph over the star schema's Parquet tables, and graphs saved as Parquet."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.graph import Graph, Later, Nodes, Rels

# Label, table, key column; type, source label, key column of the source, target label.
NODE_TABLES = (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("PurchaseOrder", "orders", "o_orderkey"))
MORE_TABLES = (("Event", "events", "event_id", 8), ("Document", "documents", "doc_id", 9), ("Vec", "embeddings", "vec_id", 10))
KEY_RELS = (("IN_REGION", "Nation", "n_regionkey", "Region"), ("IN_NATION", "Customer", "c_nationkey", "Nation"), ("IN_NATION", "Supplier", "s_nationkey", "Nation"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nodes keep their table's columns besides id. PLACED and DID are keys of orders and events; HAS_PART and FROM_SUPPLIER are the
    lines, with their measures; SUPPLIES the different pairs; DID and NEXT come from events. Tables are opened when a
    query asks for them."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def keyed(name: str, key: str):
        return lambda: read(name).withColumn("id", F.col(key).cast("long"))

    graph = Graph(spark)
    for code, (label, name, key) in enumerate(NODE_TABLES, 1):
        graph = graph.add_nodes(label, keyed(name, key), code)
    for label, name, key, code in MORE_TABLES:
        graph = graph.add_nodes(label, keyed(name, key), code)
    graph = graph.add_nodes("User", lambda: read("events").where("user_id is not null").select(F.col("user_id").alias("id"), "user_id").distinct(), 7)
    for kind, src, key, dst in KEY_RELS:
        graph = graph.add_rels(Rels(kind, src, dst, key=key))
    graph = graph.add_rels(Rels("PLACED", "Customer", "PurchaseOrder", back="o_custkey"))

    def of_lines(kind: str, key: str, dst: str):
        def make() -> list[Rels]:
            rows = with_row_ids(read("lineitem"))
            measures = [c for c in rows.columns if c not in ("id", "l_orderkey", "l_partkey", "l_suppkey")]
            return [Rels(kind, "PurchaseOrder", dst, rows.select("id", F.col("l_orderkey").alias("src"), F.col(key).alias("dst"), *measures))]

        return Later(make)

    def supplies() -> list[Rels]:
        pairs = read("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
        fits = F.col("src").between(0, (1 << 23) - 1) & F.col("dst").between(0, (1 << 40) - 1)
        both = F.when(fits, F.col("src") * (1 << 40) + F.col("dst")).otherwise(F.raise_error(F.lit("a key is too large")).cast("long"))
        return [Rels("SUPPLIES", "Supplier", "Part", pairs.select(both.alias("id"), "src", "dst"))]

    def nexts() -> list[Rels]:
        after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        return [Rels("NEXT", "Event", "Event", read("events").select(F.col("event_id").alias("id"), F.col("event_id").alias("src"), after.alias("dst")).where("dst is not null"))]

    made = {"HAS_PART": of_lines("HAS_PART", "l_partkey", "Part"), "FROM_SUPPLIER": of_lines("FROM_SUPPLIER", "l_suppkey", "Supplier"), "SUPPLIES": Later(supplies)}
    graph = replace(graph, rels=graph.rels | made)
    graph = graph.add_rels(Rels("DID", "User", "Event", back="user_id"))
    return replace(graph, rels=graph.rels | {"NEXT": Later(nexts)})


def with_row_ids(df: DataFrame) -> DataFrame:
    """Adds as id a row's place in its file, and above bit 40 the file's place among the table's files."""
    rows = df.select("*", F.col("_metadata.row_index").alias("id"), F.col("_metadata.file_path").alias("_file"))
    if len(df.inputFiles()) < 2:
        return rows.drop("_file")
    files = sorted(r[0] for r in rows.select("_file").distinct().collect())
    numbers = df.sparkSession.createDataFrame([(f, k) for k, f in enumerate(files)], "_file string, _no long")  # a row for each file
    return rows.join(numbers, "_file").withColumn("id", F.col("_no") * (1 << 40) + F.col("id")).drop("_file", "_no")


def save(graph: Graph, path: str) -> None:
    """A folder of Parquet tables and a one-row description; nodes are sorted within files by indexed properties."""
    plan = {"nodes": [], "rels": [], "indexes": sorted(graph.indexes), "unique": sorted(graph.unique), "required": sorted(graph.required)}
    for n in graph.nodes.values():
        keys = [k for label, k in sorted(graph.indexes) if label == n.label and k in n.df.columns]
        (n.df.sortWithinPartitions(*keys) if keys else n.df).write.parquet(f"{path}/nodes/{n.label}")
        plan["nodes"].append([n.label, n.code])
    for tables in graph.rels.values():
        for k, t in enumerate(tables):
            if t.df is not None:
                t.df.write.parquet(f"{path}/rels/{t.type}-{k}")
            plan["rels"].append([t.type, t.src, t.dst, t.key, t.back, k])
    graph.spark.createDataFrame([(json.dumps(plan),)], "plan string").coalesce(1).write.text(f"{path}/plan")


def load(spark: SparkSession, path: str) -> Graph:
    plan = json.loads(spark.read.text(f"{path}/plan").first()[0])
    graph = Graph(spark, {label: Nodes(label, spark.read.parquet(f"{path}/nodes/{label}"), code) for label, code in plan["nodes"]})
    for kind, src, dst, key, back, k in plan["rels"]:
        graph = graph.add_rels(Rels(kind, src, dst, None if key or back else spark.read.parquet(f"{path}/rels/{kind}-{k}"), key, back))
    pairs = lambda name: frozenset(map(tuple, plan[name]))
    return replace(graph, indexes=pairs("indexes"), unique=pairs("unique"), required=pairs("required"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """LOAD CSV WITH HEADERS: rows by a given schema."""
    return spark.read.schema(schema).option("header", True).csv(path)
