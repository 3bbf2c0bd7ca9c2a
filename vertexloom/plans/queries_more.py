"""More queries with SQL: values and functions, paths, writes, dumps, reasoning and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blocks, reasoning, scalar, vectors
from ..operators import algorithms, paths, procedures, writes
from ..sources.dump import dump_lines, export_dump, import_dump
from ..sources.scratch import shared_folder
from ..sources.tables import load, save
from .graph import Graph
from .match import argument, both, into, match, node, out, prop, return_all, returned
from .registry import query

# Sources


@query("SELECT 1 AS one, 'x' AS word, NULL::INTEGER AS none, [1, 2][2] AS second")
def argument_row(g: Graph) -> DataFrame:
    return argument(g.spark).select(F.lit(1).alias("one"), F.lit("x").alias("word"), F.lit(None).cast("int").alias("none"), F.element_at(F.array(F.lit(1), F.lit(2)), 2).alias("second"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def nodes_by_property(g: Graph) -> DataFrame:
    return g.nodes_by_property("Customer", "c_mktsegment", "MACHINERY").select("id", F.col("c_name").alias("name"))


@query("SELECT 'node' AS kind, c_custkey AS id, c_nationkey::BIGINT AS dst FROM customer WHERE c_custkey = 11 UNION ALL SELECT 'relationship', o_orderkey, o_custkey FROM orders WHERE o_orderkey = 12")
def get_by_id(g: Graph) -> DataFrame:
    one = g.get_node("Customer", 11).select(F.lit("node").alias("kind"), "id", F.col("c_nationkey").cast("long").alias("dst"))
    return one.unionByName(g.get_relationship("PLACED", 12).select(F.lit("relationship").alias("kind"), "id", F.col("src").alias("dst")))


@query("SELECT c_custkey AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def saved_graph(g: Graph) -> DataFrame:
    """Saved as Parquet, loaded and matched."""
    folder = _new_folder(g)
    small = Graph(g.spark, {k: g.nodes[k] for k in ("Region", "Nation", "Customer")}, {"IN_REGION": g.rels["IN_REGION"], "IN_NATION": [r for r in g.rels["IN_NATION"] if r.src == "Customer"]})
    save(writes.create_index(small, "Customer", "c_nationkey"), folder)
    again = load(g.spark, folder)
    rows = match(again, node("c", "Customer"), out("IN_NATION"), node("n", "Nation"), out("IN_REGION"), node("r", "Region"))
    return rows.select(prop("c").alias("customer"), prop("n", "n_name").alias("nation"), prop("r", "r_name").alias("region"))


def _new_folder(g: Graph) -> str:
    import uuid

    return f"{shared_folder(g.spark)}/graph-{uuid.uuid4().hex}"


@query("SELECT part, line FROM (SELECT 0 AS part, '// Graph as statements' AS line UNION ALL SELECT 0, '// Nodes: ' || ((SELECT count(*) FROM region) + (SELECT count(*) FROM nation)) UNION ALL SELECT 0, '// Relationships: ' || (SELECT count(*) FROM nation) UNION ALL SELECT 1, 'CREATE (n:Region {_id: ' || (1099511627776 + r_regionkey) || ', r_name: ''' || r_name || ''', r_regionkey: ' || r_regionkey || '});' FROM region UNION ALL SELECT 1, 'CREATE (n:Nation {_id: ' || (2199023255552 + n_nationkey) || ', n_name: ''' || n_name || ''', n_nationkey: ' || n_nationkey || ', n_regionkey: ' || n_regionkey || '});' FROM nation UNION ALL SELECT 2, 'MATCH (a {_id: ' || (2199023255552 + n_nationkey) || '}), (b {_id: ' || (1099511627776 + n_regionkey) || '}) CREATE (a)-[:IN_REGION]->(b);' FROM nation)")
def dump_statements(g: Graph) -> DataFrame:
    return dump_lines(Graph(g.spark, {k: g.nodes[k] for k in ("Region", "Nation")}, {"IN_REGION": g.rels["IN_REGION"]}))


@query("SELECT doc_id AS id, md5(text) AS digest, lang, n_chars::VARCHAR AS n_chars FROM documents")
def dump_round_trip(g: Graph) -> DataFrame:
    """All documents as statements of text files, read back: what strings hold comes back whole."""
    folder = _new_folder(g)
    export_dump(Graph(g.spark, {"Document": g.nodes["Document"]}), folder)
    nodes, _ = import_dump(g.spark, folder)
    own, local = F.col("properties"), (1 << 40) - 1
    return nodes.select(F.col("id").bitwiseAND(F.lit(local)).alias("id"), F.md5(own["text"]).alias("digest"), own["lang"].alias("lang"), own["n_chars"].alias("n_chars"))


@query("SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'PurchaseOrder', count(*) FROM orders UNION ALL SELECT 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'Customer', count(*) FROM customer")
def dump_relationships(g: Graph) -> DataFrame:
    """Nodes and relationships of a dump, counted after import."""
    folder = _new_folder(g)
    export_dump(Graph(g.spark, {k: g.nodes[k] for k in ("Region", "Nation", "Customer", "PurchaseOrder")}, {k: g.rels[k] for k in ("IN_REGION", "PLACED")}), folder)
    nodes, rels = import_dump(g.spark, folder)
    return nodes.groupBy(F.col("labels")[0].alias("label")).agg(F.count(F.lit(1)).alias("n")).unionByName(rels.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n")))


# Projection, values, functions


@query('SELECT n_name AS "n.n_name", n_nationkey::BIGINT AS n, r_name AS "r.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey')
def default_aliases(g: Graph) -> DataFrame:
    return returned(match(g, node("n", "Nation"), out("IN_REGION"), node("r", "Region")), "n.n_name", "n", "r.r_name")


@query("SELECT n_name AS nation, n_nationkey::BIGINT AS id, 'Region' AS label, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def return_star(g: Graph) -> DataFrame:
    whole = return_all(match(g, node("n", "Nation"), out("IN_REGION"), node("r", "Region")))
    assert whole.columns == ["n", "r"]
    return whole.select(F.col("n.n_name").alias("nation"), F.col("n.id").alias("id"), F.col("r.label").alias("label"), F.col("r.r_name").alias("region"))


@query("SELECT standing, count(*) AS n FROM (SELECT CASE WHEN c_acctbal IS NULL OR c_acctbal >= 0 THEN 'no' ELSE 'yes' END AS standing FROM customer) GROUP BY 1")
def is_null_property(g: Graph) -> DataFrame:
    """A property that only some nodes have: IS NULL and IS NOT NULL."""
    debt = match(g, node("c", "Customer")).where(prop("c", "c_acctbal") < 0).select(prop("c").alias("id"), F.lit("debtor").alias("value"))
    g, _ = writes.set_property(g, "Customer", "standing", debt)
    rows = match(g, node("c", "Customer"))
    none, some = rows.where(prop("c", "standing").isNull()), rows.where(prop("c", "standing").isNotNull())
    counted = none.select(F.lit("no").alias("standing")).unionByName(some.select(F.lit("yes").alias("standing")))
    return counted.groupBy("standing").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, c_acctbal < 0 AS debtor FROM customer WHERE c_acctbal < 100")
def label_test(g: Graph) -> DataFrame:
    """n:Label of a label that some nodes have besides their first."""
    g = writes.add_label(g, "Customer", "Debtor", g.nodes["Customer"].df.where("c_acctbal < 0").select("id"))
    rows = match(g, node("c", "Customer")).where(prop("c", "c_acctbal") < 100)
    return rows.select(prop("c").alias("id"), F.array_contains(prop("c", "labels"), "Debtor").alias("debtor"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal < 0")
def second_label_scan(g: Graph) -> DataFrame:
    g = writes.add_label(g, "Customer", "Debtor", g.nodes["Customer"].df.where("c_acctbal < 0").select("id"))
    return match(g, node("c", "Debtor")).select(prop("c").alias("id"), prop("c", "c_name").alias("name"))


@query("SELECT p_partkey AS id, 3 AS items, [1, 2, p_size]::VARCHAR AS joined, length(p_name || '/' || p_brand) AS size FROM part")
def list_concat_and_size(g: Graph) -> DataFrame:
    """+ of lists and of strings; size of both."""
    items = scalar.add(F.array(F.lit(1), F.lit(2)), F.array(prop("p", "p_size")), T.ArrayType(T.IntegerType()))
    text = scalar.add(scalar.add(prop("p", "p_name"), F.lit("/"), T.StringType()), prop("p", "p_brand"), T.StringType())
    return match(g, node("p", "Part")).select(prop("p").alias("id"), F.size(items).alias("items"), F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")).alias("joined"), scalar.length(text).alias("size"))


@query("SELECT e.event_id AS id, json_extract(props, '$.k')::VARCHAR::DOUBLE / 2 AS half, length(props) AS size FROM events e")
def to_float_strings(g: Graph) -> DataFrame:
    text = F.get_json_object(prop("e", "props"), "$.k")
    return match(g, node("e", "Event")).select(prop("e").alias("id"), (scalar.to_float(text) / 2).alias("half"), scalar.length(prop("e", "props")).alias("size"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal, s_nationkey AS nation FROM supplier")
def properties_struct(g: Graph) -> DataFrame:
    df = match(g, node("s", "Supplier"))
    return df.select(prop("s").alias("id"), scalar.properties_of(df, "s").alias("p")).select("id", F.col("p.s_name").alias("name"), F.col("p.s_acctbal").alias("bal"), F.col("p.s_nationkey").alias("nation"))


@query("SELECT o_custkey AS id, sum(DISTINCT o_orderkey % 7)::BIGINT AS total, round(avg(DISTINCT o_orderkey % 7), 9) AS mean, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS kinds, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1")
def agg_distinct_all(g: Graph) -> DataFrame:
    rows = match(g, node("c", "Customer", fetch=False), out("PLACED"), node("o", "PurchaseOrder"))
    left = prop("o") % 7
    return rows.groupBy(prop("c").alias("id")).agg(F.sum_distinct(left).alias("total"), F.round(F.expr("avg(DISTINCT o__id % 7)"), 9).alias("mean"), F.array_join(F.sort_array(F.collect_set(prop("o", "o_orderstatus"))), ",").alias("kinds"), F.count_distinct(prop("o", "o_orderstatus")).alias("n"))


@query("SELECT c_custkey AS id, x FROM customer, (VALUES (1), (2)) t(x) WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey > 3")
def unwind_cases(g: Graph) -> DataFrame:
    """Lists, empty lists and nulls; then a value that isn't a list, which is one row, and null, which is none."""
    rows = match(g, node("c", "Customer"))
    items = F.when(prop("c") % 4 == 0, F.array(F.lit(1), F.lit(2))).when(prop("c") % 4 == 1, F.array().cast("array<int>"))
    lists = rows.select(prop("c").alias("id"), scalar.unwind(items, T.ArrayType(T.IntegerType())).alias("x"))
    alone = F.when(prop("c", "c_nationkey") > 3, prop("c", "c_nationkey"))
    return lists.unionByName(rows.select(prop("c").alias("id"), scalar.unwind(alone, T.IntegerType()).alias("x")))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(g: Graph) -> DataFrame:
    rows = [match(g, node("x", label)).select(prop("x", key).alias("nation")) for label, key in (("Customer", "c_nationkey"), ("Supplier", "s_nationkey"))]
    return reduce(DataFrame.unionByName, rows).distinct()


@query("SELECT p_partkey AS id, CASE WHEN n <= 10 THEN 'endgame' WHEN n <= 24 THEN 'middlegame' ELSE 'opening' END AS phase FROM (SELECT p_partkey, length(regexp_replace(repeat(p_name, 1 + p_size % 3), '[^A-Za-z]', '', 'g')) AS n FROM part)")
def game_phase(g: Graph) -> DataFrame:
    return match(g, node("p", "Part")).select(prop("p").alias("id"), procedures.game_phase(F.repeat(prop("p", "p_name"), 1 + prop("p", "p_size") % 3)).alias("phase"))


# Paths

_NEXT = "e AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), n AS (SELECT src, dst FROM e WHERE dst IS NOT NULL)"


@query("SELECT r_name AS region, 'Nation' AS label, n_nationkey::BIGINT AS id, 1 AS hops FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'Customer', c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'Supplier', s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def var_length_across_labels(g: Graph) -> DataFrame:
    rows = match(g, node("r", "Region"), into(["IN_REGION", "IN_NATION"], hops=(1, None), path="p"), node("x", fetch=False))
    return rows.select(prop("r", "r_name").alias("region"), prop("x", "label").alias("label"), prop("x").alias("id"), prop("p", "length").alias("hops"))


@query(f"WITH {_NEXT} SELECT x.src AS a, y.dst AS b, x.dst AS middle, NULL::BIGINT AS beyond, x.dst % 3 = 0 AS third, x.src::VARCHAR || ',' || x.dst::VARCHAR AS rels, y.dst::VARCHAR || '<' || x.dst::VARCHAR || '<' || x.src::VARCHAR AS back, true AS has FROM n x JOIN n y ON x.dst = y.src")
def path_helpers(g: Graph) -> DataFrame:
    """node_at, contains, relationships and reverse of two-step paths."""
    rows = match(g, node("a", "Event", fetch=False), out("NEXT", hops=(2, 2), path="p"), node("b", "Event", fetch=False))
    middle = paths.path_node_at("p", 1)
    return rows.select(
        prop("a").alias("a"), prop("b").alias("b"), middle.alias("middle"), paths.path_node_at("p", 3).alias("beyond"), (middle % 3 == 0).alias("third"), F.array_join(paths.path_relationships("p"), ",").alias("rels"),
        F.array_join(paths.path_reversed("p")["nodes"], "<").alias("back"), (paths.path_contains_node("p", prop("b")) & paths.path_contains_relationship("p", paths.path_relationship_at("p", 0))).alias("has"),
    )


@query(f"WITH {_NEXT} SELECT x.src AS a, 3 AS hops, z.dst AS stop FROM n x JOIN n y ON x.dst = y.src JOIN n z ON y.dst = z.src")
def path_appended(g: Graph) -> DataFrame:
    rows = match(g, node("a", "Event", fetch=False), out("NEXT", hops=(2, 2), path="p"), node("b", "Event", fetch=False), out("NEXT", "r"), node("c", "Event", fetch=False))
    longer = paths.path_append(rows, "p", prop("r"), prop("c"))
    return longer.select(prop("a").alias("a"), prop("p", "length").alias("hops"), paths.path_end("p").alias("stop"))


@query(f"WITH {_NEXT} SELECT src AS rel, src AS here, dst AS there FROM n UNION ALL SELECT src, dst, src FROM n WHERE src <> dst")
def other_ends(g: Graph) -> DataFrame:
    rows = match(g, node("a", "Event", fetch=False), both("NEXT", "r"), node("b", "Event", fetch=False))
    return rows.select(prop("r").alias("rel"), prop("a").alias("here"), paths.other_node("r", prop("a")).alias("there"))


# Writes


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'debt' END AS standing, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_name END AS name FROM customer")
def set_map_and_remove(g: Graph) -> DataFrame:
    """SET n += map, and REMOVE of a property."""
    own = g.nodes["Customer"].df
    g, _ = writes.merge_properties(g, "Customer", own.where("c_acctbal < 0").select("id"), {"standing": "debt", "c_mktsegment": None})
    g, _ = writes.remove_property(g, "Customer", "c_name", own.where("c_nationkey = 3").select("id"))
    return match(g, node("c", "Customer")).select(prop("c").alias("id"), prop("c", "standing").alias("standing"), prop("c", "c_mktsegment").alias("segment"), prop("c", "c_name").alias("name"))


@query("SELECT r_regionkey::BIGINT AS id, CASE WHEN r_regionkey < 2 THEN NULL ELSE r_name END AS name, CASE WHEN r_regionkey < 2 THEN 'new' END AS kind FROM region")
def set_whole_map(g: Graph) -> DataFrame:
    """SET n = map: other properties go."""
    g, _ = writes.merge_properties(g, "Region", g.nodes["Region"].df.where("id < 2").select("id"), {"kind": "new"}, replace_all=True)
    return match(g, node("r", "Region")).select(prop("r").alias("id"), prop("r", "r_name").alias("name"), prop("r", "kind").alias("kind"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal >= -500 AND c_acctbal < 0 THEN 'Customer' WHEN c_acctbal < 0 THEN 'Customer,Debtor' ELSE 'Customer' END AS labels FROM customer")
def labels_added_and_removed(g: Graph) -> DataFrame:
    own = g.nodes["Customer"].df
    g = writes.add_label(g, "Customer", "Debtor", own.where("c_acctbal < 0").select("id"))
    g = writes.remove_label(g, "Customer", "Debtor", own.where("c_acctbal >= -500").select("id"))
    return match(g, node("c", "Customer")).select(prop("c").alias("id"), F.array_join(F.sort_array(prop("c", "labels")), ",").alias("labels"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'web' END AS channel, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN o_custkey END AS weight FROM orders")
def rel_property_writes(g: Graph) -> DataFrame:
    """Properties of relationships that stood for a key: set, set again, removed."""
    rows = g.rel_frame(g.rels["PLACED"][0])
    g, _ = writes.set_rel_property(g, "PLACED", "Customer", "PurchaseOrder", "channel", rows.where("id % 5 = 0").select("id", F.lit("web").alias("value")))
    g, _ = writes.set_rel_property(g, "PLACED", "Customer", "PurchaseOrder", "weight", rows.where("id % 2 = 0").select("id", F.col("src").alias("value")))
    g, _ = writes.remove_rel_property(g, "PLACED", "Customer", "PurchaseOrder", "weight", rows.where("id % 3 = 0").select("id"))
    found = match(g, node("c", "Customer", fetch=False), out("PLACED", "r"), node("o", "PurchaseOrder", fetch=False))
    return found.select(prop("r").alias("id"), prop("r", "channel").alias("channel"), prop("r", "weight").alias("weight"))


@query("SELECT l_suppkey AS supplier, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) FILTER (l_partkey % 3 <> 0) > 0 AND count(DISTINCT l_partkey) >= 1")
def supplied_parts(g: Graph) -> DataFrame:
    rows = match(g, node("s", "Supplier", fetch=False), out("SUPPLIES"), node("p", "Part", fetch=False))
    return rows.groupBy(prop("s").alias("supplier")).agg(F.count(F.lit(1)).alias("parts"), F.count(F.when(prop("p") % 3 != 0, 1)).alias("_some")).where("_some > 0").drop("_some")


@query("SELECT l_suppkey AS supplier, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1")
def rels_deleted(g: Graph) -> DataFrame:
    gone = g.rel_frame(g.rels["SUPPLIES"][0]).where("dst % 3 = 0").select("id")
    g, _ = writes.delete_rels(g, "SUPPLIES", gone)
    rows = match(g, node("s", "Supplier", fetch=False), out("SUPPLIES"), node("p", "Part", fetch=False))
    return rows.groupBy(prop("s").alias("supplier")).agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS ids, (SELECT count(*) FROM customer) AS from_customers")
def rels_created_beside_keys(g: Graph) -> DataFrame:
    """IN_NATION from nations to themselves, beside those that stand for customers' keys: no id comes twice."""
    own = [r for r in g.rels["IN_NATION"] if r.src == "Customer"]
    g = Graph(g.spark, {k: g.nodes[k] for k in ("Customer", "Nation")}, {"IN_NATION": own})
    g, _ = writes.create_rels(g, "IN_NATION", "Nation", "Nation", g.nodes["Nation"].df.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    rows = match(g, node("a", fetch=False), out("IN_NATION", "r"), node("n", "Nation", fetch=False))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(prop("r")).alias("ids"), F.count(F.when(prop("r", "ends") == "Customer>Nation", 1)).alias("from_customers"))


@query("SELECT (SELECT count(*) FROM nation WHERE n_regionkey <> 1) AS nations, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1) AS customers, (SELECT count(*) FROM nation WHERE n_regionkey = 1) + (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1) AS cut")
def detach_delete_keys(g: Graph) -> DataFrame:
    """Nations of a region go: their own key relationships, and those of customers and suppliers that refer to them."""
    g = Graph(g.spark, {k: g.nodes[k] for k in ("Region", "Nation", "Customer", "Supplier")}, {k: g.rels[k] for k in ("IN_REGION", "IN_NATION")})
    g, stats = writes.delete_nodes(g, "Nation", g.nodes["Nation"].df.where("n_regionkey = 1").select("id"), detach=True)
    left = match(g, node("c", "Customer", fetch=False), out("IN_NATION"), node("n", "Nation")).agg(F.count(F.lit(1)).alias("customers"))
    return left.crossJoin(g.nodes["Nation"].df.agg(F.count(F.lit(1)).alias("nations"))).withColumn("cut", F.lit(stats.relationships_deleted).cast("long"))  # one row each


# Reasoning

_NINE = ", ".join(f"((vec_id * {k + 3}) % 11) / 10.0::DOUBLE AS {d}" for k, d in enumerate(reasoning.DIMENSIONS))
_SIGN = "(s_sign + p_sign + o_sign) / 3.0::DOUBLE"
_TOTAL = "(" + " + ".join(reasoning.DIMENSIONS) + ") / 9.0::DOUBLE"
_STATE = f"CASE WHEN {_TOTAL} > 0.5 THEN 'Crystallized' WHEN {_SIGN} < 0.3 THEN 'Tensioned' ELSE 'Uncertain' END"


def _tensors(g: Graph, *more: str) -> DataFrame:
    """A tensor for each vector, made from its id."""
    return g.nodes["Vec"].df.select("id", *more, *(((F.col("id") * (k + 3)) % 11 / 10.0).alias(d) for k, d in enumerate(reasoning.DIMENSIONS)))


@query(f"WITH t AS (SELECT vec_id, {_NINE} FROM embeddings) SELECT vec_id AS id, CASE {' '.join(f'WHEN {d} = least({", ".join(reasoning.DIMENSIONS)}) THEN {chr(39)}{d}{chr(39)}' for d in reasoning.DIMENSIONS)} END AS name, least({', '.join(reasoning.DIMENSIONS)}) AS value FROM t")
def most_tensioned(g: Graph) -> DataFrame:
    return _tensors(g).withColumn("least", reasoning.most_tensioned()).select("id", "least.name", "least.value")


@query(f"WITH t AS (SELECT vec_id, {_NINE} FROM embeddings) SELECT vec_id AS id, round((s_sign + s_exp + s_mant) / 9.0::DOUBLE, 9) AS subject, round((s_sign + p_sign + o_sign) / 9.0::DOUBLE, 9) AS causal, round({_TOTAL}, 9) AS every, 3 AS active FROM t")
def masked_agreement(g: Graph) -> DataFrame:
    rows = _tensors(g)
    seen = {name: reasoning.masked(rows, mask).select("id", F.round(reasoning.agreement(), 9).alias(name)) for name, mask in (("subject", "subject"), ("causal", "causal"), ("every", "all"))}
    return reduce(lambda a, b: a.join(b, "id"), seen.values()).withColumn("active", F.lit(reasoning.active_count("object")))


@query("SELECT c_custkey AS id, greatest(0, least(1, c_acctbal / 5000)) AS frequency, greatest(0, least(1, c_nationkey / 20.0::DOUBLE)) AS confidence, round(greatest(0, least(1, c_nationkey / 20.0::DOUBLE)) * (greatest(0, least(1, c_acctbal / 5000)) - 0.5) + 0.5, 9) AS expectation FROM customer")
def truth_values(g: Graph) -> DataFrame:
    rows = match(g, node("c", "Customer")).select(prop("c").alias("id"), reasoning.truth(prop("c", "c_acctbal") / 5000, prop("c", "c_nationkey") / 20.0).alias("t"))
    return rows.select("id", "t.frequency", "t.confidence", F.round(reasoning.expectation(F.col("t.frequency"), F.col("t.confidence")), 9).alias("expectation"))


@query(f"WITH t AS (SELECT label, {_NINE}, vec_id FROM embeddings), s AS (SELECT *, {_STATE} AS state FROM t), c AS (SELECT label, round(avg(s_sign), 9) AS s_sign, count(*) FILTER (state = 'Crystallized') AS crystallized, count(*) FILTER (state = 'Tensioned') AS tensioned, count(*) FILTER (state = 'Uncertain') AS uncertain, count(*) AS total FROM s GROUP BY 1) SELECT *, CASE WHEN crystallized >= greatest(tensioned, uncertain) THEN 'Crystallized' WHEN tensioned >= uncertain THEN 'Tensioned' ELSE 'Uncertain' END AS dominant FROM c")
def perspective_gestalt(g: Graph) -> DataFrame:
    rows = reasoning.perspective(_tensors(g, "label"), "label")
    return rows.select("label", F.round("s_sign", 9).alias("s_sign"), "crystallized", "tensioned", "uncertain", "total", "dominant")


@query(f"WITH t AS (SELECT vec_id, {_NINE} FROM embeddings) SELECT vec_id AS id, round({_SIGN}, 9) AS sign FROM t WHERE {_SIGN} BETWEEN 0.4 AND 0.8 AND {_STATE} = 'Crystallized'")
def resonance_query(g: Graph) -> DataFrame:
    return reasoning.resonance(_tensors(g), least_sign=0.4, most_sign=0.8, state="Crystallized").select("id", F.round(reasoning.agreement("sign"), 9).alias("sign"))


_STEP = "(({k} * 3 + {j}) % 11) / 10.0::DOUBLE"
_EDGES = "SELECT n_regionkey::BIGINT AS src, 100 + n_nationkey::BIGINT AS dst, n_nationkey::BIGINT AS k FROM nation UNION ALL SELECT 100 + c_nationkey, 1000 + c_custkey, c_custkey FROM customer"
_STEPS = f"e AS ({_EDGES}), s AS (SELECT src, dst, ({' + '.join(_STEP.format(k='k', j=j) for j in (0, 3, 6))}) / 3.0::DOUBLE AS sign, ({' + '.join(_STEP.format(k='k', j=j) for j in (1, 4, 7))}) / 3.0::DOUBLE AS exp, ({' + '.join(_STEP.format(k='k', j=j) for j in (2, 5, 8))}) / 3.0::DOUBLE AS mant FROM e)"


@query(f"WITH {_STEPS} SELECT src AS source, dst AS target, 1 AS hops, round(sign, 9) AS sign, round(exp, 9) AS exp, round(mant, 9) AS mant FROM s WHERE src < 100 UNION ALL SELECT a.src, b.dst, 2, round(a.sign * b.sign + (1 - a.sign) * (1 - b.sign), 9), round(a.exp + b.exp, 9), round(a.mant * b.mant, 9) FROM s a JOIN s b ON a.dst = b.src WHERE a.src < 100")
def causal_path(g: Graph) -> DataFrame:
    """From each region over its nations to all their customers, with tensors made from keys."""
    tensor = [(((F.col("k") * 3 + j) % 11) / 10.0).alias(d) for j, d in enumerate(reasoning.DIMENSIONS)]
    nation = g.nodes["Nation"].df.select(F.col("n_regionkey").cast("long").alias("src"), (F.lit(100) + F.col("id")).alias("dst"), F.col("id").alias("k"))
    customer = g.nodes["Customer"].df.select((F.lit(100) + F.col("c_nationkey").cast("long")).alias("src"), (F.lit(1000) + F.col("id")).alias("dst"), F.col("id").alias("k"))
    edges = nation.unionByName(customer).select("src", "dst", *tensor)
    found = reasoning.causal_paths(edges, g.nodes["Region"].df.select("id"))
    return found.select("source", "target", "hops", *(F.round(c, 9).alias(c) for c in ("sign", "exp", "mant")))


# Vectors and records

_THIRDS = (("subject", 1, 21), ("predicate", 22, 42), ("object", 43, 63))
_WORDS = "x AS (SELECT vec_id, d, (v::FLOAT + 2::FLOAT)::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)), w AS (SELECT vec_id, d, CASE WHEN v < 0 THEN 1 ELSE 0 END AS s, floor(log2(abs(v)))::INTEGER + 127 AS e, floor((abs(v) / pow(2, floor(log2(abs(v)))) - 1) * 128)::INTEGER AS m FROM x WHERE v <> 0)"


@query(f"WITH {_WORDS} SELECT vec_id AS id, string_agg((s * 32768 + e * 128 + m)::VARCHAR, ',' ORDER BY d) AS words FROM w GROUP BY 1")
def bf16_codec(g: Graph) -> DataFrame:
    return g.nodes["Vec"].df.select("id", F.array_join(vectors.to_bf16("embedding"), ",").alias("words"))


@query(f"WITH {_WORDS}, p AS (SELECT a.vec_id AS query, b.vec_id AS id, CASE WHEN d <= 21 THEN 's' WHEN d <= 42 THEN 'p' ELSE 'o' END AS part, (a.s <> b.s)::INTEGER AS f, abs(a.e - b.e) AS e, CASE WHEN a.s = b.s AND abs(a.e - b.e) <= 2 THEN bit_count(xor(a.m, b.m)) ELSE 0 END AS m FROM w a JOIN w b USING (d) WHERE a.vec_id % 50 = 0 AND d <= 63) SELECT query, id, (sum(64 * f + 4 * e + m))::BIGINT AS total, round(1 - sum(f) FILTER (part = 's') / 21.0::DOUBLE, 9) AS s_sign, round(1 - sum(e) FILTER (part = 'o') / (255.0::DOUBLE * 21), 9) AS o_exp FROM p GROUP BY 1, 2")
def spo_distance(g: Graph) -> DataFrame:
    """Thirds of the vectors as subject, predicate and object; the tensor of each pair."""
    rows = g.nodes["Vec"].df.select("id", vectors.to_bf16("embedding").alias("w"))
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query")
    return blocks.every_pair(rows, queries, _spo_measures, "total bigint, s_sign double, o_exp double")


def _spo_measures(q, r) -> list:
    """The total of the distances, the subject's agreement in sign and the object's in exponent."""
    sums = [blocks.bf16_sums(q[a - 1 : b], r[a - 1 : b]) for _, a, b in _THIRDS]
    total = sum(vectors.SIGN_WEIGHT * f + vectors.EXP_WEIGHT * e + m for f, e, m, _ in sums)
    n_subject, n_object = (len(q[a - 1 : b]) for _, a, b in (_THIRDS[0], _THIRDS[2]))
    return [total, blocks.half_up(1.0 - sums[0][0] / n_subject, 9), blocks.half_up(1.0 - sums[2][1] / (float(vectors.EXP_MOST) * n_object), 9)]


_BOOK = "b AS (SELECT d, min(v) AS lo, CASE WHEN abs(max(v) - min(v)) >= 1e-9 THEN max(v) ELSE min(v) + 1 END AS hi FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY 1)"
_NIBBLES = f"{_BOOK}, n AS (SELECT vec_id, d, lo, hi, greatest(0, least(15, round((v - lo) / (hi - lo) * 15)::INTEGER)) AS n FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) JOIN b USING (d))"


@query(f"WITH {_NIBBLES}, p AS (SELECT a.vec_id AS query, x.vec_id AS id, d, abs(a.n - x.n) AS n FROM n a JOIN n x USING (d) WHERE a.vec_id % 50 = 0 AND d <= 63) SELECT query, id, (sum(n) FILTER (d <= 21))::INTEGER AS subject, (sum(n) FILTER (d BETWEEN 22 AND 42))::INTEGER AS predicate, sum(n)::INTEGER AS total, round(sum(n) / (15.0::DOUBLE * 63), 9) AS normalized FROM p GROUP BY 1, 2")
def spo_nibble_distance(g: Graph) -> DataFrame:
    book = vectors.Codebook.fit(g.nodes["Vec"].df, "embedding")
    rows = g.nodes["Vec"].df.select("id", book.encode(F.col("embedding")).alias("n"))
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query")
    return blocks.every_pair(rows, queries, _spo_nibble_measures, "subject int, predicate int, total int, normalized double")


def _spo_nibble_measures(q, r) -> list:
    subject, predicate, object_ = (blocks.nibble_sums(q[a - 1 : b], r[a - 1 : b]) for _, a, b in _THIRDS)
    total = subject + predicate + object_
    return [subject, predicate, total, blocks.half_up(total / blocks.worst_nibbles(len(q[: _THIRDS[-1][2]])), 9)]


@query(f"WITH {_NIBBLES} SELECT vec_id AS id, string_agg(n::VARCHAR, ',' ORDER BY d) AS nibbles, round(sum(lo + n / 15.0::DOUBLE * (hi - lo)), 6) AS total, sum(n * (CASE (d - 1) % 4 WHEN 0 THEN 1 WHEN 1 THEN 16 WHEN 2 THEN 256 ELSE 4096 END)) FILTER (d <= 4) AS first_word FROM n GROUP BY 1")
def nib4_codec(g: Graph) -> DataFrame:
    """Encoded, decoded and packed."""
    book = vectors.Codebook.fit(g.nodes["Vec"].df, "embedding")
    rows = g.nodes["Vec"].df.select("id", book.encode(F.col("embedding")).alias("n"))
    packed = vectors.pack_words(F.slice("n", 1, 16), F.lit(True))
    return rows.select("id", F.array_join("n", ",").alias("nibbles"), F.round(F.aggregate(book.decode(F.col("n")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"), packed[0].cast("long").alias("first_word"))


@query("SELECT o_orderkey AS id, bit_count(xor(o_orderkey, o_custkey))::BIGINT AS score_0, 0::BIGINT AS score_1, o_orderkey * 3.0::DOUBLE AS score_2 FROM orders WHERE bit_count(xor(o_orderkey, o_custkey)) < 6 AND o_orderkey & 3 = 1")
def record_pipeline(g: Graph) -> DataFrame:
    """A sweep, a filter under a mask and a dot product: a step is looked at only where those before it passed."""
    rows = g.nodes["PurchaseOrder"].df.select("id", F.array("o_orderkey").alias("record"), F.array("o_custkey").alias("asked"))
    found = vectors.sweep(rows, [vectors.hamming_sweep(F.col("record"), F.col("asked"), 6), vectors.meta_filter(F.col("record"), 0, 3, 1), vectors.vector_dot(F.col("record"), F.array(F.lit(3)))])
    return found.select("id", "score_0", "score_1", "score_2")


@query("SELECT l_orderkey AS src, l_partkey AS rel, l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def edge_binding(g: Graph) -> DataFrame:
    """Edges bound of three words, and the target recovered from the other two."""
    part, supplier = (g.rel_frame(g.rels[k][0]).select("id", "src", F.col("dst").alias(name)) for k, name in (("HAS_PART", "rel"), ("FROM_SUPPLIER", "dst")))
    rows = part.join(supplier.drop("src"), "id")
    bound = rows.select("src", "rel", vectors.edge_bind(F.array("src"), F.array("rel"), F.array("dst")).alias("edge"))
    found = bound.select("src", "rel", vectors.edge_unbind(F.col("edge"), F.array("src"), F.array("rel"))[0].alias("dst"))
    return found.groupBy("src", "rel", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT c_custkey % 60 AS a, 60 + c_nationkey AS b FROM customer UNION ALL SELECT s_suppkey % 60, 60 + s_nationkey FROM supplier UNION ALL SELECT c_custkey % 60, (c_custkey * 7) % 60 FROM customer) WHERE a <> b), t AS (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b) SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1")
def triangles(g: Graph) -> DataFrame:
    """Of a graph made from the keys of all customers and suppliers."""
    customer, supplier = g.nodes["Customer"].df, g.nodes["Supplier"].df
    edges = customer.select((F.col("id") % 60).alias("src"), (F.lit(60) + F.col("c_nationkey").cast("long")).alias("dst"))
    edges = edges.unionByName(supplier.select((F.col("id") % 60).alias("src"), (F.lit(60) + F.col("s_nationkey").cast("long")).alias("dst")))
    return algorithms.triangles(edges.unionByName(customer.select((F.col("id") % 60).alias("src"), (F.col("id") * 7 % 60).alias("dst"))))


@query("WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), n AS (SELECT a, count(*) AS n FROM e GROUP BY 1), m AS (SELECT x.a AS a, y.a AS b, count(*) AS m FROM e x JOIN e y ON x.b = y.b AND x.a <> y.a GROUP BY 1, 2), s AS (SELECT m.a, m.b, m / (p.n + q.n - m)::DOUBLE AS s FROM m JOIN n p ON p.a = m.a JOIN n q ON q.a = m.b) SELECT a, b, round(s, 9) AS similarity, row_number() OVER (PARTITION BY a ORDER BY s DESC, b)::INTEGER AS place FROM s QUALIFY place <= 3")
def nearest_neighbours(g: Graph) -> DataFrame:
    """The three suppliers most like each one, by the parts that they supply."""
    edges = g.rel_frame(g.rels["SUPPLIES"][0])
    return algorithms.nearest_neighbours(edges, 3).select("a", "b", F.round("similarity", 9).alias("similarity"), "place")
