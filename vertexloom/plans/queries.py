"""One query per graph operator over the star graph, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, reasoning, scalar, vectors
from ..operators import algorithms, paths, procedures, writes
from ..sources.dump import dump_lines
from ..streaming import events as stream
from .graph import Graph
from .match import both, count_pairs, distinct_edges, having, into, join_patterns, match, node, optional, out, prop, value_of
from .registry import QUERIES, SQL, cents, query

__all__ = ["QUERIES", "SQL"]

# Scans, filters, projections


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def node_scan(g: Graph) -> DataFrame:
    return match(g, node("n", "Nation")).select(prop("n").alias("id"), prop("n", "n_name").alias("name"))


@query("SELECT label, cnt FROM (SELECT 'Region' AS label, count(*) AS cnt FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'PurchaseOrder', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Vec', count(*) FROM embeddings)")
def all_nodes_count(g: Graph) -> DataFrame:
    return g.all_nodes().select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT c_custkey AS id, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING'")
def label_filter_eq(g: Graph) -> DataFrame:
    return match(g, node("c", "Customer", c_mktsegment="BUILDING")).select(prop("c").alias("id"), prop("c", "c_acctbal").alias("bal"))


@query("SELECT c_custkey AS id FROM customer WHERE (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') OR (NOT (c_acctbal > 0) AND c_nationkey < 5) OR ((c_custkey % 2 = 0) <> (c_acctbal < 100) AND c_nationkey = 7)")
def multi_predicate_and_or_not_xor(g: Graph) -> DataFrame:
    bal, nation = prop("c", "c_acctbal"), prop("c", "c_nationkey")
    test = ((bal > 5000) & (prop("c", "c_mktsegment") == "BUILDING")) | (~(bal > 0) & (nation < 5)) | (scalar.xor(prop("c") % 2 == 0, bal < 100) & (nation == 7))
    return match(g, node("c", "Customer")).where(test).select(prop("c").alias("id"))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS nulls FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def is_null_filter(g: Graph) -> DataFrame:
    rows = optional(match(g, node("c", "Customer")), match(g, node("c", "Customer"), out("PLACED"), node("o", "PurchaseOrder")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(prop("o").isNull(), 1)).alias("nulls"))


@query("SELECT p_partkey AS id FROM part WHERE p_size IN (1, 5, 9)")
def in_list(g: Graph) -> DataFrame:
    return match(g, node("p", "Part")).where(scalar.member(prop("p", "p_size"), F.array(F.lit(1), F.lit(5), F.lit(9)))).select(prop("p").alias("id"))


@query("SELECT p_partkey AS id FROM part WHERE (starts_with(p_name, 'red') OR ends_with(p_name, 'bolt')) AND NOT contains(p_name, 'd w')")
def starts_ends_contains(g: Graph) -> DataFrame:
    name = prop("p", "p_name")
    return match(g, node("p", "Part")).where((name.startswith("red") | name.endswith("bolt")) & ~name.contains("d w")).select(prop("p").alias("id"))


@query("SELECT n_name AS name FROM nation WHERE regexp_full_match(n_name, '.*[AEIOU]{2}.*|NATION_1.')")
def regex_match(g: Graph) -> DataFrame:
    return match(g, node("n", "Nation")).where(scalar.whole_match(prop("n", "n_name"), ".*[AEIOU]{2}.*|NATION_1.")).select(prop("n", "n_name").alias("name"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer")
def case_searched(g: Graph) -> DataFrame:
    bal = prop("c", "c_acctbal")
    return match(g, node("c", "Customer")).select(prop("c").alias("id"), F.when(bal < 0, "debt").when(bal < 5000, "low").otherwise("high").alias("band"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS code FROM orders")
def case_simple(g: Graph) -> DataFrame:
    status = scalar.simple_case(prop("o", "o_orderstatus"), [(F.lit("O"), F.lit(1)), (F.lit("F"), F.lit(2))], F.lit(0))
    return match(g, node("o", "PurchaseOrder")).select(prop("o").alias("id"), status.alias("code"))


@query("SELECT p_partkey AS id, p_size * 2 + 3 - p_partkey AS a, -p_size AS b FROM part")
def arithmetic_mix(g: Graph) -> DataFrame:
    size = prop("p", "p_size")
    return match(g, node("p", "Part")).select(prop("p").alias("id"), (size * 2 + 3 - prop("p")).alias("a"), (-size).alias("b"))


@query("SELECT p_partkey AS id, (p_partkey // 7)::BIGINT AS q, ((0 - p_partkey) % 7)::BIGINT AS m, power(p_size, 2)::DOUBLE AS sq FROM part")
def int_division_mod_pow(g: Graph) -> DataFrame:
    return match(g, node("p", "Part")).select(prop("p").alias("id"), scalar.int_divide(prop("p"), F.lit(7)).alias("q"), ((0 - prop("p")) % 7).alias("m"), F.pow(prop("p", "p_size"), F.lit(2)).alias("sq"))


@query("SELECT p_partkey AS id, p_brand || '/' || p_type AS tag FROM part")
def string_concat(g: Graph) -> DataFrame:
    return match(g, node("p", "Part")).select(prop("p").alias("id"), F.concat(prop("p", "p_brand"), F.lit("/"), prop("p", "p_type")).alias("tag"))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal BETWEEN 100 AND 900")
def param_substitution(g: Graph) -> DataFrame:
    given = {"low": 100, "high": 900}
    return match(g, node("c", "Customer")).where(prop("c", "c_acctbal").between(given["low"], given["high"])).select(prop("c").alias("id"))


@query("SELECT r_regionkey::BIGINT AS id, NULL::VARCHAR AS missing FROM region")
def property_missing_null(g: Graph) -> DataFrame:
    df = match(g, node("r", "Region"))
    return df.select(prop("r").alias("id"), value_of(df, "r", "nowhere").cast("string").alias("missing"))


@query("SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT AS first, (n_nationkey + 2)::BIGINT AS last, 2 AS rest, 0 AS none FROM nation")
def list_functions(g: Graph) -> DataFrame:
    items = scalar.span(prop("n"), prop("n") + 2)
    return match(g, node("n", "Nation")).select(prop("n").alias("id"), scalar.head(items).alias("first"), scalar.last(items).alias("last"), F.size(scalar.tail(items)).alias("rest"), F.size(scalar.span(F.lit(5), F.lit(1))).alias("none"))


@query("SELECT o_orderkey AS id, trunc(o_totalprice)::BIGINT AS whole, o_orderkey::VARCHAR AS text, (o_orderstatus = 'O') AS opened FROM orders")
def conversions(g: Graph) -> DataFrame:
    flag = scalar.to_boolean(F.when(prop("o", "o_orderstatus") == "O", "TRUE").otherwise("false"))
    return match(g, node("o", "PurchaseOrder")).select(prop("o").alias("id"), scalar.to_integer(prop("o", "o_totalprice")).alias("whole"), scalar.to_string(prop("o")).alias("text"), flag.alias("opened"))


@query("SELECT c_custkey AS id, coalesce(max(o_orderkey), -1) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1")
def coalesce_fn(g: Graph) -> DataFrame:
    big = match(g, node("c", "Customer", fetch=False), out("PLACED"), node("o", "PurchaseOrder")).where(prop("o", "o_totalprice") > 200000)
    rows = optional(match(g, node("c", "Customer")), big)
    return rows.groupBy(prop("c").alias("id")).agg(F.coalesce(F.max(prop("o")), F.lit(-1)).alias("last_order"))


@query("SELECT n_nationkey::BIGINT AS id, 'Nation' AS label, 'IN_REGION' AS type, n_nationkey::BIGINT AS rel_id, 'n_name,n_nationkey,n_regionkey' AS keys FROM nation")
def type_labels_id_fns(g: Graph) -> DataFrame:
    df = match(g, node("n", "Nation"), out("IN_REGION", "r"), node("m", "Region", fetch=False))
    return df.select(prop("n").alias("id"), prop("n", "label").alias("label"), prop("r", "type").alias("type"), prop("r").alias("rel_id"), F.array_join(scalar.keys_of(df, "n"), ",").alias("keys"))


# Distinct, order, paging, unwinding, union


@query("SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def return_distinct_multi(g: Graph) -> DataFrame:
    return match(g, node("c", "Customer")).select(prop("c", "c_nationkey").alias("nation"), prop("c", "c_mktsegment").alias("segment")).distinct()


@query("SELECT p_partkey AS id, p_size AS size FROM part ORDER BY CASE WHEN p_size > 40 THEN NULL ELSE p_size END DESC NULLS FIRST, p_partkey LIMIT 50")
def order_multi_key_nulls(g: Graph) -> DataFrame:
    size = prop("p", "p_size")
    return match(g, node("p", "Part")).orderBy(scalar.descending(F.when(size <= 40, size)), scalar.ascending(prop("p"))).limit(50).select(prop("p").alias("id"), size.alias("size"))


@query("SELECT c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 30")
def skip_limit(g: Graph) -> DataFrame:
    return match(g, node("c", "Customer")).orderBy(prop("c")).offset(30).limit(20).select(prop("c").alias("id"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(g: Graph) -> DataFrame:
    price = prop("o", "o_totalprice")
    return match(g, node("o", "PurchaseOrder")).orderBy(scalar.descending(price), prop("o")).limit(10).select(prop("o").alias("id"), price.alias("price"))


@query("SELECT r_regionkey::BIGINT AS id, x::BIGINT AS x FROM region, (VALUES (1), (2), (3)) t(x) WHERE x <= r_regionkey + 1")
def unwind_literal(g: Graph) -> DataFrame:
    items = F.array(*(F.lit(k).cast("long") for k in (1, 2, 3)))
    return match(g, node("r", "Region")).select(prop("r").alias("id"), F.explode(items).alias("x")).where("x <= id + 1")


@query("SELECT n_regionkey::BIGINT AS region, n_name AS name FROM nation")
def unwind_collect(g: Graph) -> DataFrame:
    held = match(g, node("n", "Nation"), out("IN_REGION"), node("r", "Region", fetch=False)).groupBy(prop("r").cast("long").alias("region")).agg(scalar.collect_sorted(prop("n", "n_name"), prop("n", "n_name")).alias("names"))
    return held.select("region", F.explode("names").alias("name"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_all(g: Graph) -> DataFrame:
    return match(g, node("n", "Nation")).select(prop("n", "n_name").alias("name")).unionByName(match(g, node("r", "Region")).select(prop("r", "r_name").alias("name")))


# Patterns


@query("SELECT n_name AS nation, count(*) AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 ORDER BY cnt DESC, nation LIMIT 5")
def nation_top5(g: Graph) -> DataFrame:
    rows = match(g, node("c", "Customer"), out("IN_NATION"), node("n", "Nation")).where(prop("c", "c_acctbal") > 0)
    return rows.groupBy(prop("n", "n_name").alias("nation")).agg(F.count(prop("c")).alias("cnt")).orderBy(F.desc("cnt"), "nation").limit(5)


@query("SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def expand_out(g: Graph) -> DataFrame:
    return match(g, node("c", "Customer"), out("IN_NATION"), node("n", "Nation")).select(prop("c", "c_name").alias("customer"), prop("n", "n_name").alias("nation"))


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON r_regionkey = n_regionkey")
def expand_in(g: Graph) -> DataFrame:
    return match(g, node("r", "Region"), into("IN_REGION"), node("n", "Nation")).select(prop("r", "r_name").alias("region"), prop("n", "n_name").alias("nation"))


@query("WITH e AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), b AS (SELECT src, dst FROM e WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM e WHERE dst IS NOT NULL AND src <> dst) SELECT src AS a, dst AS b FROM b")
def expand_both(g: Graph) -> DataFrame:
    return match(g, node("a", "Event", fetch=False), both("NEXT"), node("b", "Event", fetch=False)).select(prop("a").alias("a"), prop("b").alias("b"))


@query("SELECT type, count(*) AS n FROM (SELECT 'HAS_PART' AS type FROM lineitem UNION ALL SELECT 'FROM_SUPPLIER' FROM lineitem) GROUP BY 1")
def expand_multi_type(g: Graph) -> DataFrame:
    rows = match(g, node("o", "PurchaseOrder", fetch=False), out(["HAS_PART", "FROM_SUPPLIER"], "r"), node("x", fetch=False))
    return rows.groupBy(prop("r", "type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def two_hop(g: Graph) -> DataFrame:
    rows = match(g, node("c", "Customer"), out("IN_NATION"), node("n", "Nation"), out("IN_REGION"), node("r", "Region"))
    return rows.groupBy(prop("r", "r_name").alias("region")).agg(F.count(prop("c")).alias("customers"))


@query("SELECT r_name AS region, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def three_hop(g: Graph) -> DataFrame:
    rows = match(g, node("r", "Region"), into("IN_REGION"), node("n", "Nation"), into("IN_NATION"), node("c", "Customer"), out("PLACED"), node("o", "PurchaseOrder", fetch=False))
    return rows.groupBy(prop("r", "r_name").alias("region")).agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03")
def rel_property_filter(g: Graph) -> DataFrame:
    rows = match(g, node("o", "PurchaseOrder", fetch=False), out("HAS_PART", "l"), node("p", "Part", fetch=False))
    return rows.where((prop("l", "l_quantity") >= 45) & (prop("l", "l_discount") < 0.03)).select(prop("o").alias("o"), prop("p").alias("p"))


@query("SELECT p_brand AS brand, count(*) AS lines, round(sum(round(l_extendedprice * 100)::BIGINT) / 100.0, 2)::DOUBLE AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1")
def rel_props_return(g: Graph) -> DataFrame:
    rows = match(g, node("o", "PurchaseOrder", fetch=False), out("HAS_PART", "l", l_returnflag="R"), node("p", "Part"))
    return rows.groupBy(prop("p", "p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("lines"), cents(prop("l", "l_extendedprice")).alias("total"))


@query("SELECT c_custkey AS c, s_suppkey AS s FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_acctbal > 9000 AND s_acctbal > 5000")
def cartesian_where_join(g: Graph) -> DataFrame:
    """Two patterns that share no variable, tied by an equality: an equi-join."""
    c, s = (match(g, node(v, label)) for v, label in (("c", "Customer"), ("s", "Supplier")))
    rich = c.where(prop("c", "c_acctbal") > 9000).join(s.where(prop("s", "s_acctbal") > 5000), prop("c", "c_nationkey") == prop("s", "s_nationkey"))
    return rich.select(prop("c").alias("c"), prop("s").alias("s"))


@query("SELECT n_name AS nation, c.n AS customers, s.n AS suppliers FROM nation JOIN (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1) c ON c.k = n_nationkey JOIN (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) s ON s.k = n_nationkey")
def shared_var_join(g: Graph) -> DataFrame:
    c = match(g, node("c", "Customer"), out("IN_NATION"), node("n", "Nation", fetch=False)).groupBy("n__id").agg(F.count(F.lit(1)).alias("customers"))
    s = match(g, node("s", "Supplier"), out("IN_NATION"), node("n", "Nation", fetch=False)).groupBy("n__id").agg(F.count(F.lit(1)).alias("suppliers"))
    return join_patterns(join_patterns(match(g, node("n", "Nation")), c), s).select(prop("n", "n_name").alias("nation"), "customers", "suppliers")


@query("SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) s ON s.l_suppkey = a.l_suppkey AND s.l_partkey = b.l_partkey")
def cyclic_pattern(g: Graph) -> DataFrame:
    """A supplier of an order that supplies a part of the same order."""
    rows = match(g, node("s", "Supplier", fetch=False), into("FROM_SUPPLIER"), node("o", "PurchaseOrder", fetch=False), out("HAS_PART"), node("p", "Part", fetch=False), into("SUPPLIES"), node("s", "Supplier", fetch=False))
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM (SELECT e1.event_id FROM (SELECT event_id, lead(event_id) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) e1 WHERE d IS NOT NULL) x JOIN (SELECT event_id, lead(event_id) OVER w AS d, lag(event_id) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) y USING (event_id) WHERE y.p IS NOT NULL")
def edge_unique_two_hop(g: Graph) -> DataFrame:
    """Undirected steps a-b-c over different relationships, from each middle's later neighbour to its earlier one."""
    rows = distinct_edges(match(g, node("a", "Event", fetch=False), into("NEXT", "r"), node("b", "Event", fetch=False), both("NEXT", "s"), node("c", "Event", fetch=False)), "r", "s")
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) * (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS pairs FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def edge_unique_two_tables(g: Graph) -> DataFrame:
    """Customer, nation, supplier: the two relationships are of one type and may have one id, but are never the same."""
    customers = match(g, node("c", "Customer", fetch=False), out("IN_NATION", "r"), node("n", "Nation"))
    suppliers = match(g, node("x", "Supplier", fetch=False), out("IN_NATION", "s"), node("n", "Nation", fetch=False))
    return count_pairs(customers, suppliers, "r", "s", "n__n_name").groupBy(prop("n", "n_name").alias("nation")).agg(F.sum("pairs").alias("pairs"))


@query("SELECT c_custkey AS id, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def optional_match(g: Graph) -> DataFrame:
    done = match(g, node("c", "Customer", fetch=False), out("PLACED"), node("o", "PurchaseOrder", o_orderstatus="F"))
    return optional(match(g, node("c", "Customer")), done).groupBy(prop("c").alias("id")).agg(F.count(prop("o")).alias("orders"))


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def exists_semi(g: Graph) -> DataFrame:
    big = match(g, node("c", "Customer", fetch=False), out("PLACED"), node("o", "PurchaseOrder")).where(prop("o", "o_totalprice") > 300000)
    return having(match(g, node("c", "Customer")), big).select(prop("c").alias("id"))


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def not_exists_anti(g: Graph) -> DataFrame:
    urgent = match(g, node("c", "Customer", fetch=False), out("PLACED"), node("o", "PurchaseOrder", o_orderpriority="1-URGENT", o_orderstatus="F"))
    return having(match(g, node("c", "Customer")), urgent, negate=True).select(prop("c").alias("id"))


# Aggregation


@query("SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(sum(round(c_acctbal * 100)::BIGINT) / 100.0, 2)::DOUBLE AS total, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer")
def agg_global_six(g: Graph) -> DataFrame:
    bal = prop("c", "c_acctbal")
    return match(g, node("c", "Customer")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(prop("c", "c_nationkey")).alias("nations"), cents(bal).alias("total"), F.round(F.avg(bal), 4).alias("mean"), F.min(bal).alias("low"), F.max(bal).alias("high"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, max(o_totalprice) AS high FROM orders GROUP BY 1")
def agg_grouped(g: Graph) -> DataFrame:
    return match(g, node("o", "PurchaseOrder")).groupBy(prop("o", "o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.max(prop("o", "o_totalprice")).alias("high"))


@query("SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def count_distinct(g: Graph) -> DataFrame:
    rows = match(g, node("c", "Customer", fetch=False), out("PLACED"), node("o", "PurchaseOrder"))
    return rows.groupBy(prop("o", "o_orderstatus").alias("status")).agg(F.count_distinct(prop("c")).alias("customers"))


@query("SELECT 0::BIGINT AS n, 0::BIGINT AS total, NULL::DOUBLE AS mean")
def agg_empty(g: Graph) -> DataFrame:
    none = match(g, node("x", "Nowhere"))
    return none.agg(F.count(F.lit(1)).alias("n"), scalar.sum_or_zero(prop("x")).alias("total"), F.avg(prop("x")).alias("mean"))


@query("SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def collect_sorted(g: Graph) -> DataFrame:
    rows = match(g, node("n", "Nation"), out("IN_REGION"), node("r", "Region"))
    return rows.groupBy(prop("r", "r_name").alias("region")).agg(F.array_join(scalar.collect_sorted(prop("n", "n_name"), prop("n", "n_name")), ",").alias("nations"))


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > (SELECT count(*) / 25 FROM customer)")
def with_having(g: Graph) -> DataFrame:
    total = g.nodes["Customer"].df.agg((F.count(F.lit(1)) / 25).alias("mean"))
    return match(g, node("c", "Customer")).groupBy(prop("c", "c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), F.col("n") > F.col("mean")).select("nation", "n")


@query("SELECT o_orderstatus AS status, count(*) * 2 + 1 AS twice, max(o_totalprice) - min(o_totalprice) AS range FROM orders GROUP BY 1")
def nested_agg_expr(g: Graph) -> DataFrame:
    price = prop("o", "o_totalprice")
    return match(g, node("o", "PurchaseOrder")).groupBy(prop("o", "o_orderstatus").alias("status")).agg((F.count(F.lit(1)) * 2 + 1).alias("twice"), (F.max(price) - F.min(price)).alias("range"))


@query("SELECT c_mktsegment AS segment, round(quantile_cont(c_acctbal, 0.5), 6) AS mid, quantile_disc(c_acctbal, 0.9) AS ninth, round(stddev_samp(c_acctbal), 4) AS spread FROM customer GROUP BY 1")
def percentiles(g: Graph) -> DataFrame:
    bal = prop("c", "c_acctbal")
    disc = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY c__c_acctbal)")
    return match(g, node("c", "Customer")).groupBy(prop("c", "c_mktsegment").alias("segment")).agg(F.round(F.percentile(bal, 0.5), 6).alias("mid"), disc.alias("ninth"), F.round(F.stddev_samp(bal), 4).alias("spread"))


# Paths

_NEXT = "e AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), n AS (SELECT src, dst FROM e WHERE dst IS NOT NULL)"


@query(f"WITH {_NEXT} SELECT src AS a, dst AS b, 1 AS hops FROM n UNION ALL SELECT x.src, y.dst, 2 FROM n x JOIN n y ON x.dst = y.src UNION ALL SELECT x.src, z.dst, 3 FROM n x JOIN n y ON x.dst = y.src JOIN n z ON y.dst = z.src")
def var_length_1_3(g: Graph) -> DataFrame:
    rows = match(g, node("a", "Event", fetch=False), out("NEXT", hops=(1, 3), path="p"), node("b", "Event", fetch=False))
    return rows.select(prop("a").alias("a"), prop("b").alias("b"), prop("p", "length").alias("hops"))


@query(f"WITH {_NEXT} SELECT x.src AS start, y.dst AS stop, x.src::VARCHAR || '>' || x.dst::VARCHAR || '>' || y.dst::VARCHAR AS path, 2 AS length FROM n x JOIN n y ON x.dst = y.src")
def path_length(g: Graph) -> DataFrame:
    rows = match(g, node("a", "Event", fetch=False), out("NEXT", hops=(2, 2), path="p"), node("b", "Event", fetch=False))
    return rows.select(paths.path_start("p").alias("start"), paths.path_end("p").alias("stop"), F.array_join(paths.path_nodes("p"), ">").alias("path"), F.size(paths.path_triples("p")).alias("length"))


_ID = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "PurchaseOrder": 6}


def _shared(label: str, key: str) -> str:
    """The id in the space that all labels share, in SQL."""
    return f"({_ID[label] << 40} + {key})"


_TREE = f"""t AS (SELECT {_shared("Region", "n_regionkey")} AS src, {_shared("Nation", "n_nationkey")} AS dst FROM nation UNION ALL SELECT {_shared("Nation", "c_nationkey")}, {_shared("Customer", "c_custkey")} FROM customer
UNION ALL SELECT {_shared("Nation", "s_nationkey")}, {_shared("Supplier", "s_suppkey")} FROM supplier UNION ALL SELECT {_shared("Customer", "o_custkey")}, {_shared("PurchaseOrder", "o_orderkey")} FROM orders)"""


@query(f"WITH RECURSIVE {_TREE}, w AS (SELECT {_shared('Region', 'r_regionkey')} AS source, {_shared('Region', 'r_regionkey')} AS target, 0 AS hops FROM region UNION ALL SELECT source, dst, hops + 1 FROM w JOIN t ON target = src) SELECT source, target, min(hops) AS hops FROM w GROUP BY 1, 2")
def shortest_path(g: Graph) -> DataFrame:
    """From every region to all it reaches: nations, their customers and suppliers, and orders."""
    down = g.all_rels(["IN_REGION", "IN_NATION"]).select(F.col("dst").alias("src"), F.col("src").alias("dst")).unionByName(g.all_rels(["PLACED"]).select("src", "dst"))
    start = g.nodes["Region"].df.select(g.shared_id("Region", F.col("id")).alias("id"))
    return paths.shortest_paths(down, start).select("source", "target", "hops")


# Writes


@query("SELECT count(*) + 3 AS nations, 3::BIGINT AS made FROM nation")
def create_then_count(g: Graph) -> DataFrame:
    rows = g.spark.createDataFrame([("ATLANTIS", 0), ("MU", 1), ("LEMURIA", 2)], "n_name string, n_regionkey int")
    g, stats = writes.create_nodes(g, "Nation", rows)
    return g.nodes["Nation"].df.agg(F.count(F.lit(1)).alias("nations")).withColumn("made", F.lit(stats.nodes_created).cast("long"))


@query("SELECT n_name AS nation, c_custkey AS customer, CASE WHEN c_acctbal < 0 THEN 'debtor' END AS standing FROM customer JOIN nation ON c_nationkey = n_nationkey")
def set_then_read(g: Graph) -> DataFrame:
    debt = match(g, node("c", "Customer")).where(prop("c", "c_acctbal") < 0).select(prop("c").alias("id"), F.lit("debtor").alias("value"))
    g, _ = writes.set_property(g, "Customer", "standing", debt)
    return match(g, node("c", "Customer"), out("IN_NATION"), node("n", "Nation")).select(prop("n", "n_name").alias("nation"), prop("c").alias("customer"), prop("c", "standing").alias("standing"))


@query("SELECT segment, segment <> 'NEW' AS seen FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer UNION ALL SELECT 'NEW')")
def merge_upsert(g: Graph) -> DataFrame:
    """MERGE of segments twice: the second run creates only what is new."""
    rows = match(g, node("c", "Customer")).select(prop("c", "c_mktsegment").alias("segment"))
    g, _, _ = writes.merge_nodes(g, "Segment", rows, on_create={"seen": F.lit(False)})
    more = rows.unionByName(g.spark.createDataFrame([("NEW",), ("NEW",)], "segment string"))
    g, _, _ = writes.merge_nodes(g, "Segment", more, on_create={"seen": F.lit(False)}, on_match={"seen": F.lit(True)})
    return g.nodes["Segment"].df.select("segment", "seen")


@query("SELECT count(*) AS orders, (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS customers FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0")
def detach_delete_count(g: Graph) -> DataFrame:
    debt = match(g, node("c", "Customer")).where(prop("c", "c_acctbal") < 0).select(prop("c").alias("id"))
    g, _ = writes.delete_nodes(g, "Customer", debt, detach=True)
    placed = match(g, node("c", "Customer"), out("PLACED"), node("o", "PurchaseOrder", fetch=False)).agg(F.count(F.lit(1)).alias("orders"))
    return placed.crossJoin(g.nodes["Customer"].df.agg(F.count(F.lit(1)).alias("customers")))  # one row each


@query("SELECT count(*) AS edges, count(DISTINCT c_nationkey) AS nations FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def merge_relationships(g: Graph) -> DataFrame:
    rows = match(g, node("c", "Customer")).select(prop("c", "c_nationkey").cast("long").alias("src"), prop("c", "c_mktsegment").alias("segment"))
    g, merged, _ = writes.merge_nodes(g, "Segment", rows.select("segment"))
    pairs = rows.join(merged, "segment").select("src", F.col("id").alias("dst"))
    g, _ = writes.merge_rels(g, "BUYS", "Nation", "Segment", pairs)
    g, _ = writes.merge_rels(g, "BUYS", "Nation", "Segment", pairs)
    return match(g, node("n", "Nation", fetch=False), out("BUYS"), node("s", "Segment", fetch=False)).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct(prop("n")).alias("nations"))


# Reasoning and vectors

@query("WITH n AS (SELECT c_custkey AS a, c_nationkey::BIGINT AS b, (c_custkey % 10) / 10.0::DOUBLE AS f1, 0.9::DOUBLE AS c1 FROM customer), r AS (SELECT n_nationkey::BIGINT AS b, n_regionkey::BIGINT AS d, 0.8::DOUBLE AS f2, (n_nationkey % 7) / 10.0::DOUBLE AS c2 FROM nation) SELECT a AS src, d AS dst, round(f1 * f2, 9) AS frequency, round(c1 * c2 * (f1 * f2), 9) AS confidence FROM n JOIN r USING (b)")
def nars_deduction_2hop(g: Graph) -> DataFrame:
    """Customer to nation, nation to region: customer to region. Ends are told apart by the shared id space."""
    c = g.nodes["Customer"].df.select(g.shared_id("Customer", F.col("id")).alias("src"), g.shared_id("Nation", F.col("c_nationkey")).alias("dst"), ((F.col("id") % 10) / 10.0).alias("frequency"), F.lit(0.9).alias("confidence"))
    n = g.nodes["Nation"].df.select(g.shared_id("Nation", F.col("id")).alias("src"), g.shared_id("Region", F.col("n_regionkey")).alias("dst"), F.lit(0.8).alias("frequency"), ((F.col("id") % 7) / 10.0).alias("confidence"))
    found = reasoning.deduction(c.unionByName(n).withColumn("id", F.xxhash64("src", "dst")))
    local = (1 << 40) - 1
    return found.select(F.col("src").bitwiseAND(F.lit(local)).alias("src"), F.col("dst").bitwiseAND(F.lit(local)).alias("dst"), F.round("frequency", 9).alias("frequency"), F.round("confidence", 9).alias("confidence"))


_NEAR = "u AS (SELECT s_suppkey AS id, s_suppkey AS src, s_nationkey::BIGINT AS dst, (s_suppkey % 10) / 10.0::DOUBLE AS f, (s_nationkey % 9) / 10.0::DOUBLE AS c FROM supplier)"
_BOUGHT = "u AS (SELECT o_orderkey AS id, o_custkey AS src, o_orderkey AS dst, (o_custkey % 10) / 10.0::DOUBLE AS f, (o_orderkey % 9) / 10.0::DOUBLE AS c FROM orders)"


def _opinions(rows: DataFrame) -> DataFrame:
    """Relationships with truth values made from their ends."""
    return rows.select("id", "src", "dst", ((F.col("src") % 10) / 10.0).alias("frequency"), ((F.col("dst") % 9) / 10.0).alias("confidence"))


def _rounded(rows: DataFrame) -> DataFrame:
    """In nine digits; values from 0 to 1, of which there may be billions, so in plain arithmetic."""
    return rows.withColumns({c: F.floor(F.col(c) * 1e9 + 0.5) / 1e9 for c in ("frequency", "confidence")})


@query(f"WITH {_NEAR} SELECT a.src AS src, a.dst AS via, b.src AS dst, round(a.f, 9) AS frequency, round(a.c * b.c * b.f, 9) AS confidence FROM u a JOIN u b ON a.dst = b.dst AND a.id <> b.id")
def nars_abduction(g: Graph) -> DataFrame:
    """All suppliers of a nation, two by two."""
    return _rounded(reasoning.abduction(_opinions(g.rel_frame(next(r for r in g.rels["IN_NATION"] if r.src == "Supplier")))))


@query(f"WITH {_BOUGHT} SELECT a.dst AS src, a.src AS via, b.dst AS dst, round(b.f, 9) AS frequency, round(a.c * b.c * a.f, 9) AS confidence FROM u a JOIN u b ON a.src = b.src AND a.id <> b.id")
def nars_induction(g: Graph) -> DataFrame:
    """All orders of a customer, two by two."""
    return _rounded(reasoning.induction(_opinions(g.rel_frame(g.rels["PLACED"][0]))))


_TRUTHS = "t AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), u AS (SELECT src * 1099511627776 + dst AS id, src, dst, (src % 10) / 10.0::DOUBLE AS f, (dst % 9) / 10.0::DOUBLE AS c FROM t)"


@query(f"WITH {_TRUTHS} SELECT a.src AS src, a.dst AS via, b.src AS dst, round(a.f, 9) AS frequency, round(a.c * b.c * b.f, 9) AS confidence FROM u a JOIN u b ON a.dst = b.dst AND a.id <> b.id")
def nars_abduction_all(g: Graph) -> DataFrame:
    """All suppliers of a part, two by two."""
    return _rounded(reasoning.abduction(_opinions(g.rel_frame(g.rels["SUPPLIES"][0]))))


_NINE = ", ".join(f"((vec_id * {k + 3}) % 11) / 10.0::DOUBLE AS {d}" for k, d in enumerate(reasoning.DIMENSIONS))
_MEAN = "(" + " + ".join(reasoning.DIMENSIONS) + ") / 9.0::DOUBLE"


@query(f"WITH t AS (SELECT vec_id, {_NINE} FROM embeddings), m AS (SELECT vec_id, {_MEAN} AS total, (s_sign + p_sign + o_sign) / 3.0::DOUBLE AS sign FROM t) SELECT vec_id AS id, round(total, 9) AS total, CASE WHEN total > 0.5 THEN 'Crystallized' WHEN sign < 0.3 THEN 'Tensioned' ELSE 'Uncertain' END AS state, CASE WHEN sign > 0.7 THEN 'Aligned' WHEN sign < 0.3 THEN 'Inverted' ELSE 'Mixed' END AS direction FROM m")
def awareness_state(g: Graph) -> DataFrame:
    rows = g.nodes["Vec"].df.select("id", *(((F.col("id") * (k + 3)) % 11 / 10.0).alias(d) for k, d in enumerate(reasoning.DIMENSIONS)))
    return rows.select("id", F.round(reasoning.agreement(), 9).alias("total"), reasoning.awareness_state().alias("state"), reasoning.causal_direction().alias("direction"))


@query("SELECT (d - 1)::INTEGER AS d, min(v) AS low, max(v) AS high FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY 1")
def nib4_codebook(g: Graph) -> DataFrame:
    book = vectors.Codebook.fit(g.nodes["Vec"].df, "embedding")
    return g.spark.createDataFrame([(d, lo, hi) for d, (lo, hi) in enumerate(zip(book.low, book.high, strict=True))], "d int, low float, high float")


def _with_queries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (id, vector), and as queries those whose id is divisible by 50."""
    return rows, rows.where("id % 50 = 0").withColumnRenamed("id", "query")


_BOOK = "b AS (SELECT d, min(v) AS lo, CASE WHEN abs(max(v) - min(v)) >= 1e-9 THEN max(v) ELSE min(v) + 1 END AS hi FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY 1)"
_NIBBLES = f"{_BOOK}, n AS (SELECT vec_id, d, greatest(0, least(15, round((v - lo) / (hi - lo) * 15)::INTEGER)) AS n FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings) JOIN b USING (d))"


@query(f"WITH {_NIBBLES}, s AS (SELECT a.vec_id AS query, x.vec_id AS id, sum(abs(a.n - x.n))::INTEGER AS distance, string_agg(upper(to_hex(x.n)), ':' ORDER BY d) AS hex FROM n a JOIN n x USING (d) WHERE a.vec_id % 50 = 0 GROUP BY 1, 2) SELECT query, id, distance, hex FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, id) <= 10")
def nib4_knn(g: Graph) -> DataFrame:
    book = vectors.Codebook.fit(g.nodes["Vec"].df, "embedding")
    rows = g.nodes["Vec"].df.select("id", book.encode(F.col("embedding")).alias("n"))
    near = blocks.best_each(*_with_queries(rows), blocks.nibble_sums, "int", 10, largest=False)
    return near.select("query", "id", F.col("score").alias("distance"), vectors.nibble_hex(F.col("vector")).alias("hex"))


_WORDS = "x AS (SELECT vec_id, d, (v::FLOAT + 2::FLOAT)::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)), e AS (SELECT vec_id, d, CASE WHEN v < 0 THEN 1 ELSE 0 END AS s, abs(v) AS v, CASE WHEN v = 0 THEN 0 ELSE floor(log2(abs(v)))::INTEGER + 127 END AS e FROM x), w AS (SELECT vec_id, d, s, e, CASE WHEN e = 0 THEN 0 ELSE floor((v / pow(2, e - 127) - 1) * 128)::INTEGER END AS m FROM e)"


@query(f"WITH {_WORDS}, p AS (SELECT a.vec_id AS query, b.vec_id AS id, (a.s <> b.s)::INTEGER AS f, abs(a.e - b.e) AS e, a.s = b.s AND abs(a.e - b.e) <= 2 AS near, bit_count(xor(a.m, b.m)) AS m FROM w a JOIN w b USING (d) WHERE a.vec_id % 50 = 0), t AS (SELECT query, id, sum(f)::BIGINT AS f, sum(e)::BIGINT AS e, coalesce(sum(m) FILTER (near), 0)::BIGINT AS m, count(*) FILTER (near) AS c, count(*) AS n FROM p GROUP BY 1, 2) SELECT query, id, 64 * f + 4 * e + m AS score, f AS sign_flips, e AS exp_delta_sum, m AS mant_bit_flips, round(1 - (64 * f + 4 * e + m) / (1084.0::DOUBLE * n), 9) AS similarity, round(1 - f / n::DOUBLE, 9) AS sign, round(1 - e / (255.0::DOUBLE * n), 9) AS exp, round(CASE WHEN c > 0 THEN 1 - m / (7.0::DOUBLE * c) ELSE 0 END, 9) AS mant, round(c / n::DOUBLE, 9) AS gate FROM t")
def bf16_distance(g: Graph) -> DataFrame:
    rows = g.nodes["Vec"].df.select("id", vectors.to_bf16("embedding").alias("w"))
    return blocks.every_pair(*_with_queries(rows), blocks.bf16_measures, "score bigint, sign_flips bigint, exp_delta_sum bigint, mant_bit_flips bigint, similarity double, sign double, exp double, mant double, gate double")


@query("WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM embeddings, q) SELECT query, id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 10")
def cosine_knn(g: Graph) -> DataFrame:
    near = blocks.best_each(*_with_queries(g.nodes["Vec"].df.select("id", "embedding")), blocks.cosines, "double", 10)
    return near.select("query", "id", F.round("score", 6).alias("score"))


@query("SELECT q.vec_id AS query, v.vec_id AS id, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS l2, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dot FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0")
def vector_distances(g: Graph) -> DataFrame:
    measures = lambda q, r: [blocks.half_up(x, 6) for x in (blocks.euclideans(q, r), blocks.dots(q, r))]
    return blocks.every_pair(*_with_queries(g.nodes["Vec"].df.select("id", "embedding")), measures, "l2 double, dot double")


@query("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)::DOUBLE[]) DESC, vec_id LIMIT 10")
def vector_query(g: Graph) -> DataFrame:
    """The procedure: the ten nearest to one vector that the caller gives, here that of the smallest id."""
    first = g.nodes["Vec"].df.orderBy("id").select("embedding").first()
    asked = first["embedding"] if first else [0.0]
    return procedures.call(g, "db.index.vector.queryNodes", "Vec", "embedding", 10, asked).select("id", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey AS id, bit_count(xor(o_orderkey, o_custkey))::INTEGER AS distance FROM orders WHERE bit_count(xor(o_orderkey, o_custkey)) < 6")
def hamming_sweep(g: Graph) -> DataFrame:
    rows = g.nodes["PurchaseOrder"].df.select("id", vectors.hamming(F.array("o_orderkey"), F.array("o_custkey")).alias("distance"))
    return rows.where("distance < 6")


# Introspection, procedures, algorithms, sinks, streams


@query("SELECT label FROM (VALUES ('Region'), ('Nation'), ('Customer'), ('Supplier'), ('Part'), ('PurchaseOrder'), ('User'), ('Event'), ('Document'), ('Vec')) t(label)")
def call_labels(g: Graph) -> DataFrame:
    return procedures.call(g, "db.labels", yields=["label"])


@query("SELECT type FROM (VALUES ('DID'), ('FROM_SUPPLIER'), ('HAS_PART'), ('IN_NATION'), ('IN_REGION'), ('NEXT'), ('PLACED'), ('SUPPLIES')) t(type)")
def call_relationship_types(g: Graph) -> DataFrame:
    return procedures.call(g, "db.relationshipTypes")


@query("SELECT 'IN_NATION' AS type, c_custkey AS id, c_custkey AS src, c_nationkey::BIGINT AS dst FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'PLACED', o_orderkey, o_custkey, o_orderkey FROM orders WHERE o_custkey = 7")
def relationships_of_node(g: Graph) -> DataFrame:
    return g.relationships_of("Customer", 7, "out")


@query(f"WITH {_TREE} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM t UNION ALL SELECT dst FROM t) GROUP BY 1")
def degree(g: Graph) -> DataFrame:
    return g.degrees(["IN_REGION", "IN_NATION", "PLACED"])


@query("SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1")
def component_sizes(g: Graph) -> DataFrame:
    """Events of a user are one component over NEXT; the user is found by its smallest event."""
    parts = algorithms.components(g.rel_frame(g.rels["NEXT"][0]))
    own = g.nodes["Event"].df.select("id", "user_id")
    sizes = own.join(parts, "id", "left").select("id", "user_id", F.coalesce("component", "id").alias("component")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(own.withColumnRenamed("id", "component"), "component").select(F.col("user_id").alias("id"), "n")


def _page_rank_sql(rounds: int) -> str:
    """page_rank unrolled."""
    parts = [f"t AS (SELECT {_shared('Nation', 'n_nationkey')} AS src, {_shared('Region', 'n_regionkey')} AS dst FROM nation UNION ALL SELECT {_shared('Customer', 'c_custkey')}, {_shared('Nation', 'c_nationkey')} FROM customer UNION ALL SELECT {_shared('Supplier', 's_suppkey')}, {_shared('Nation', 's_nationkey')} FROM supplier)"]
    parts += ["o AS (SELECT src, count(*) AS n FROM t GROUP BY 1)", "v AS (SELECT DISTINCT id FROM (SELECT src AS id FROM t UNION ALL SELECT dst FROM t))", "c AS (SELECT count(*)::DOUBLE AS n FROM v)", "r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM v, c)"]
    for k in range(rounds):
        parts.append(f"l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE id NOT IN (SELECT src FROM o))")
        parts.append(f"g{k} AS (SELECT dst, sum(rank / n) AS got FROM t JOIN r{k} ON src = id JOIN o USING (src) GROUP BY 1)")
        parts.append(f"r{k + 1} AS (SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + lost / n) AS rank FROM v CROSS JOIN c CROSS JOIN l{k} LEFT JOIN g{k} ON v.id = dst)")
    return f"WITH {', '.join(parts)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query(_page_rank_sql(5))
def page_rank(g: Graph) -> DataFrame:
    return algorithms.page_rank(g.all_rels(["IN_NATION", "IN_REGION"]), rounds=5).select("id", F.round("rank", 9).alias("rank"))


_COMMON = "e AS (SELECT DISTINCT o_custkey AS a, l_partkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT a, count(*) AS n FROM e GROUP BY 1), m AS (SELECT x.a AS a, y.a AS b, count(*) AS m FROM e x JOIN e y ON x.b = y.b AND x.a < y.a GROUP BY 1, 2)"


def _bought(g: Graph) -> DataFrame:
    rows = match(g, node("c", "Customer", fetch=False), out("PLACED"), node("o", "PurchaseOrder", fetch=False), out("HAS_PART"), node("p", "Part", fetch=False))
    return rows.select(prop("c").alias("src"), prop("p").alias("dst"))


@query(f"WITH {_COMMON} SELECT m.a AS a, m.b AS b, round(m / (p.n + q.n - m)::DOUBLE, 9) AS similarity FROM m JOIN n p ON p.a = m.a JOIN n q ON q.a = m.b")
def jaccard_similarity(g: Graph) -> DataFrame:
    """All pairs of customers that bought a part in common."""
    return algorithms.similar_all(_bought(g), digits=9)


@query(f"WITH {_COMMON} SELECT c_custkey AS a, c_custkey + 1 AS b, round(coalesce(m / least(p.n, q.n)::DOUBLE, 0), 9) AS similarity FROM customer LEFT JOIN n p ON p.a = c_custkey LEFT JOIN n q ON q.a = c_custkey + 1 LEFT JOIN m ON m.a = c_custkey AND m.b = c_custkey + 1")
def overlap_similarity(g: Graph) -> DataFrame:
    """Each customer with the next, by the parts that they bought."""
    pairs = g.nodes["Customer"].df.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return algorithms.overlap(_bought(g), pairs).withColumn("similarity", F.round("similarity", 9))


@query(None)
def export_dump(g: Graph) -> DataFrame:
    return dump_lines(g)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(g: Graph) -> DataFrame:
    return stream.tumbling_counts(g.nodes["Event"].df).select("start", "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_counts(g: Graph) -> DataFrame:
    return stream.sessions(g.nodes["Event"].df).select("user_id", "start", "n")


from . import queries_more  # noqa: E402, F401  (registers the rest)
