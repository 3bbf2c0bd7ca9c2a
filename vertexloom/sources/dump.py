"""Graphs as text: one CREATE statement per node and per relationship, written and read by Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.graph import Graph

# Characters of strings and how they are written, the escape itself first.
ESCAPES = (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"))


def literal(value: Column, kind: T.DataType) -> Column:
    """A value as a literal; kinds without one are null."""
    if isinstance(kind, T.StringType):
        text = value
        for plain, written in ESCAPES:
            text = F.replace(text, F.lit(plain), F.lit(written))
        text = F.concat(F.lit("'"), text, F.lit("'"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, T.FractionalType):
        text = value.cast("string")
        text = F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: literal(x, kind.elementType)), ", "), F.lit("]"))
    else:
        text = F.lit("null")
    return F.coalesce(text, F.lit("null"))


def _properties(df: DataFrame, names: list[str]) -> Column:
    """key: value, …; keys that begin with _ and missing values are left out."""
    parts = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}: "), literal(F.col(n), df.schema[n].dataType))) for n in sorted(names) if not n.startswith("_")]
    return F.concat_ws(", ", *parts) if parts else F.lit("")


def dump_lines(graph: Graph) -> DataFrame:
    """(part, line): 0 header, 1 nodes, 2 relationships."""
    spark = graph.spark
    head = [(0, "// Graph as statements"), (0, f"// Nodes: {graph.node_count()}"), (0, f"// Relationships: {graph.relationship_count()}")]
    parts = [spark.createDataFrame(head, "part int, line string")]
    for n in graph.nodes.values():
        labels = F.array_join("labels", ":") if "labels" in n.df.columns else F.lit(n.label)
        props = _properties(n.df, n.properties)
        line = F.concat(F.lit("CREATE (n:"), labels, F.lit(" {_id: "), graph.shared_id(n.label, F.col("id")).cast("string"), F.when(props != "", F.concat(F.lit(", "), props)).otherwise(""), F.lit("});"))
        parts.append(n.df.select(F.lit(1).alias("part"), line.alias("line")))
    for tables in graph.rels.values():
        for t in tables:
            df = graph.rel_frame(t)
            props = _properties(df, t.properties)
            ends = [graph.shared_id(label, F.col(end)).cast("string") for label, end in ((t.src, "src"), (t.dst, "dst"))]
            line = F.concat(F.lit("MATCH (a {_id: "), ends[0], F.lit("}), (b {_id: "), ends[1], F.lit(f"}}) CREATE (a)-[:{t.type}"), F.when(props != "", F.concat(F.lit(" {"), props, F.lit("}"))).otherwise(""), F.lit("]->(b);"))
            parts.append(df.select(F.lit(2).alias("part"), line.alias("line")))
    return reduce(DataFrame.unionByName, parts)


def export_dump(graph: Graph, path: str) -> None:
    """Text files, by their names in the order of the parts: partitions of a union keep its order, so nothing is moved."""
    dump_lines(graph).select("line").write.text(path)


#: key: value. Possessive, so that the pattern reads long strings without recursion.
_PAIR = r"""(?s)(\w+): ('(?:[^'\\]|\\.)*+'|\[(?:'(?:[^'\\]|\\.)*+'|[^'\]])*+\]|[^,\[\]']+)"""


def import_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, labels, properties map of literals' text) and relationships (type, src, dst, properties) of a dump; in
    bulk, so that a relationship joins its own two nodes only."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))

    def pairs(text: Column) -> Column:
        keys = F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1))
        values = F.transform(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2)), _plain)
        return F.map_filter(F.map_from_arrays(keys, values), lambda k, v: k != "_id")

    def _plain(v: Column) -> Column:
        # Escaped escapes are cut at first, so that what is between them is read once.
        def read(part: Column) -> Column:
            for plain, written in ESCAPES[1:]:
                part = F.replace(part, F.lit(written), F.lit(plain))
            return part

        bare = F.split(F.substring(v, 2, F.length(v) - 2), r"\\\\")
        return F.when(v.startswith("'"), F.array_join(F.transform(bare, read), "\\")).otherwise(v)

    own = lines.where(F.col("line").startswith("CREATE"))
    inside = F.regexp_extract("line", r"(?s)\{(.*)\}\);$", 1)
    nodes = own.select(F.regexp_extract("line", r"_id: (\d+)", 1).cast("long").alias("id"), F.split(F.regexp_extract("line", r"^CREATE \(n:([\w:]+)", 1), ":").alias("labels"), pairs(inside).alias("properties"))
    tied = lines.where(F.col("line").startswith("MATCH"))
    ends = r"(?s)^MATCH \(a \{_id: (\d+)\}\), \(b \{_id: (\d+)\}\) CREATE \(a\)-\[:(\w+)(?: \{(.*)\})?\]->\(b\);$"
    rels = tied.select(F.regexp_extract("line", ends, 3).alias("type"), F.regexp_extract("line", ends, 1).cast("long").alias("src"), F.regexp_extract("line", ends, 2).cast("long").alias("dst"), pairs(F.regexp_extract("line", ends, 4)).alias("properties"))
    return nodes, rels
