import random

import pytest
from pyspark.sql import functions as F

from vertexloom.functions import reasoning, scalar, vectors
from vertexloom.operators import algorithms, paths, procedures, writes
from vertexloom.plans.graph import ConstraintViolation, Graph, GraphError, NotFound, ReadOnly, Rels, SemanticError, TransactionError
from vertexloom.plans.match import both, having, into, match, node, optional, out, prop, returned, value_of
from vertexloom.sources.dump import dump_lines, export_dump, import_dump
from vertexloom.sources.tables import load, save


@pytest.fixture
def people(spark):
    nodes = spark.createDataFrame([(1, "Alice", 25), (2, "Bob", 30), (3, "Charlie", 35)], "id long, name string, age int")
    knows = spark.createDataFrame([(1, 1, 2, 2020), (2, 2, 3, 2015)], "id long, src long, dst long, since int")
    works = spark.createDataFrame([(1, 1, 3)], "id long, src long, dst long")
    return Graph.of(spark, {"Person": nodes}, {"KNOWS": ("Person", "Person", knows), "WORKS_WITH": ("Person", "Person", works)})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hops_directions_and_types(people):
    a, b = node("a", "Person"), node("b", "Person")
    names = lambda df, *v: rows(df.select(*(prop(x, "name") for x in v)))
    assert names(match(people, a, out("KNOWS"), b), "a", "b") == [("Alice", "Bob"), ("Bob", "Charlie")]
    assert names(match(people, a, into("KNOWS"), b), "a", "b") == [("Bob", "Alice"), ("Charlie", "Bob")]
    assert len(names(match(people, a, both("KNOWS"), b), "a", "b")) == 4  # each edge from either end
    assert len(names(match(people, a, out(), b), "a", "b")) == 3
    assert names(match(people, a, out("KNOWS"), b, out("KNOWS"), node("c")), "a", "c") == [("Alice", "Charlie")]
    assert names(match(people, a, out("KNOWS", "r", since=2020), b), "b") == [("Bob",)]
    assert names(match(people, node("a", name="Bob"), out("KNOWS"), b), "b") == [("Charlie",)]
    assert match(people, node("x", "Nobody")).count() == 0 and match(people, a, out("HATES"), b).count() == 0


def test_loops_and_cycles(spark):
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3)], "id long")
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 1, 1)], "id long, src long, dst long")
    g = Graph.of(spark, {"N": nodes}, {"E": ("N", "N", edges)})
    a = node("a", "N")
    assert rows(match(g, a, out("E"), node("b", "N"), out("E"), node("c", "N"), out("E"), a).where("a__id <> b__id and b__id <> c__id").select("a__id")) == [(1,), (2,), (3,)]
    assert match(g, a, both("E"), node("b", "N")).where("a__id = 1").count() == 3  # the loop comes once
    assert g.relationships_of("N", 1).count() == 3 and dict(rows(g.degrees()))[(1 << 40) + 1] == 3
    assert rows(algorithms.triangles(edges)) == [(1, 1), (2, 1), (3, 1)]


def test_optional_exists_and_missing(people):
    a = match(people, node("a", "Person"))
    later = match(people, node("a", "Person", fetch=False), out("KNOWS"), node("b", "Person"))
    assert rows(optional(a, later).select("a__name", "b__name")) == [("Alice", "Bob"), ("Bob", "Charlie"), ("Charlie", None)]
    assert rows(having(a, later).select("a__name")) == [("Alice",), ("Bob",)]
    assert rows(having(a, later, negate=True).select("a__name")) == [("Charlie",)]
    assert a.select(value_of(a, "a", "email")).first()[0] is None
    with pytest.raises(SemanticError):
        value_of(a, "z", "name")
    assert a.groupBy().agg(F.avg("a__age")).first()[0] == 30.0


def test_labels(spark):
    g = Graph.of(spark, {"Person": spark.createDataFrame([("Bob",)], "name string").withColumn("id", F.lit(1).cast("long"))})
    g, stats = writes.create_nodes(g, "Person", spark.createDataFrame([("Ada",)], "name string"), "Employee")
    assert stats.nodes_created == 1 and match(g, node("p", "Person")).count() == 2
    assert rows(match(g, node("p", "Employee")).select("p__name")) == [("Ada",)]
    g = writes.add_label(g, "Person", "Boss", g.nodes["Person"].df.where("name = 'Bob'"))
    assert rows(match(g, node("p", "Person", "Boss")).select("p__name")) == [("Bob",)]
    g = writes.remove_label(g, "Person", "Boss", g.nodes["Person"].df)
    assert rows(g.labels()) == [("Employee",), ("Person",)]


def test_variable_length_equals_search(spark):
    rng = random.Random(5)
    for _ in range(3):
        edges = [(k, rng.randint(1, 7), rng.randint(1, 7)) for k in range(1, 13)]
        g = Graph.of(spark, {"N": spark.createDataFrame([(k,) for k in range(1, 8)], "id long")}, {"E": ("N", "N", spark.createDataFrame(edges, "id long, src long, dst long"))})
        for least, most in ((1, 2), (2, 3)):
            want, level = [], [((n,), ()) for n in range(1, 8)]
            for k in range(1, most + 1):
                level = [((*p, d), (*r, e)) for p, r in level for e, s, d in edges if s == p[-1] and d not in p]
                want += [(list(p), list(r)) for p, r in level] if k >= least else []
            got = match(g, node("a", "N", fetch=False), out("E", hops=(least, most), path="p"), node("b", "N", fetch=False))
            assert sorted((r.p__nodes, r.p__rels) for r in got.collect()) == sorted(want)
    dist = {1: 0}
    for k in range(1, 8):
        for _, s, d in edges:
            if dist.get(s) == k - 1:
                dist.setdefault(d, k)
    got = paths.shortest_paths(spark.createDataFrame(edges, "id long, src long, dst long"), spark.createDataFrame([(1,)], "id long"))
    assert {r.target: r.hops for r in got.collect()} == dist


def test_variable_length_across_labels(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    g = Graph.of(spark, {"N": nodes, "M": nodes}, {"E": ("N", "M", spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "id long, src long, dst long"))})
    g, _ = writes.create_rels(g, "E", "M", "N", spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "src long, dst long"))
    n, m = 1 << 40, 2 << 40
    want = [("M", 1, [n + 1, m + 1]), ("M", 2, [n + 1, m + 2]), ("N", 2, [n + 1, m + 1, n + 2])]  # 2 leads back to the start
    for hops in ((1, 5), (1, None)):
        got = match(g, node("a", "N"), out("E", hops=hops, path="p"), node("b", fetch=False))
        assert rows(got.where("a__id = 1").select("b__label", "b__id", "p__nodes")) == rows_of(want)
        got = match(g, node("a", "N"), out("E", hops=hops, path="p"), node("b", "M"))
        assert rows(got.where("a__id = 1").select("b__label", "b__id", "p__nodes")) == rows_of(want[:2])
    assert match(g, node("a", "N"), both("E", hops=(2, 2)), node("b", "N", fetch=False)).where("a__id = 1").count() == 1


def rows_of(items):
    return sorted(items, key=str)


def test_identity_of_relationships(spark, tmp_path):
    """Ids are those of a type between two labels; files and keys don't share them."""
    from vertexloom.sources.tables import with_row_ids

    frame = spark.createDataFrame([(k, k) for k in range(40)], "a long, b long").repartition(4)
    frame.write.parquet(f"{tmp_path}/t")
    got = with_row_ids(spark.read.parquet(f"{tmp_path}/t"))
    assert got.columns == ["a", "b", "id"] and got.select("id").distinct().count() == 40
    people = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "id long, boss long")
    g = Graph.of(spark, {"P": people, "Q": spark.createDataFrame([(1,)], "id long")}).add_rels(Rels("BOSS", "P", "P", key="boss"))
    g, _ = writes.create_rels(g, "BOSS", "Q", "P", spark.createDataFrame([(1, 2)], "src long, dst long"))
    found = match(g, node("a"), out("BOSS", "r"), node("b"))
    assert rows(found.select("r__ends", "r__id")) == [("P>P", 2), ("P>P", 3), ("Q>P", 4)]
    h, stats = writes.delete_nodes(g, "P", spark.createDataFrame([(1,), (2,)], "id long"), detach=True)
    assert (stats.nodes_deleted, stats.relationships_deleted) == (2, 3)
    assert match(h, node("a"), out("BOSS"), node("b", fetch=False)).count() == 0 and rows(h.nodes["P"].df) == [(3, None)]
    h, stats = writes.set_rel_property(g, "BOSS", "P", "P", "since", spark.createDataFrame([(2, 1999)], "id long, value int"))
    assert rows(match(h, node("a", "P"), out("BOSS", "r"), node("b", "P")).select("r__id", "r__since")) == [(2, 1999), (3, None)] and stats.properties_set == 1
    h, _ = writes.remove_rel_property(h, "BOSS", "P", "P", "since", spark.createDataFrame([(2,)], "id long"))
    assert rows(h.rel_frame(h.rels["BOSS"][0]).select("id", "since")) == [(2, None), (3, None)]
    assert g.get_relationship("BOSS", 2, src="P").count() == 1 and g.get_node("P", 9).count() == 0


def test_kinds_of_errors(people, spark):
    for kind, f in (
        (NotFound, lambda: people.get_node("Nobody", 1)),
        (NotFound, lambda: people.get_relationship("HATES", 1)),
        (NotFound, lambda: writes.set_rel_property(people, "HATES", "Person", "Person", "x", spark.createDataFrame([(1, 1)], "id long, value int"))),
        (SemanticError, lambda: returned(match(people, node("a", "Person")), "b.name")),
        (TransactionError, lambda: _ended(people).commit()),
        (TransactionError, lambda: _ended(people).apply(writes.create_index, "Person", "name")),
    ):
        with pytest.raises(kind):
            f()
    assert people.nodes_by_property("Person", "nothing", 1).count() == 0
    big = Graph.of(spark, {"N": spark.createDataFrame([(1 << 41,)], "id long")})
    with pytest.raises(Exception, match="too large"):
        big.all_nodes().collect()
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.range(1).select(F.lit(2**62) * F.lit(2)).collect()


def _ended(graph):
    tx = writes.Store(graph).begin()
    tx.rollback()
    return tx


def test_tables_are_opened_when_asked_for(spark):
    opened = []

    def table():
        opened.append(1)
        return spark.createDataFrame([(1,)], "id long")

    g = Graph(spark).add_nodes("A", table).add_nodes("B", spark.createDataFrame([(2,)], "id long"))
    assert match(g, node("b", "B")).count() == 1 and not opened and g.nodes.code("A") == 1
    assert match(g, node("a", "A")).count() == 1 and match(g, node("a", "A")).count() == 1 and len(opened) == 1


def test_fixed_tables_are_cleared(spark):
    from vertexloom.sources import scratch

    df = scratch.fixed(spark.range(5))
    assert df.count() == 5 and scratch.clear(spark) >= 1 and scratch.clear(spark) == 0
    assert scratch.fixed(spark.range(1).select(F.lit(None).alias("nothing"))).count() == 1  # Parquet can't hold it
    assert rows(scratch.numbered(spark.range(40).repartition(3), 5).select("id")) == rows(spark.range(5, 45))


def test_writes_and_transactions(people, spark):
    with pytest.raises(ConstraintViolation):
        writes.delete_nodes(people, "Person", spark.createDataFrame([(2,)], "id long"))
    g, stats = writes.delete_nodes(people, "Person", spark.createDataFrame([(2,)], "id long"), detach=True)
    assert (stats.nodes_deleted, stats.relationships_deleted, g.relationship_count()) == (1, 2, 1)
    ids = people.nodes["Person"].df.where("age > 26")
    g, _ = writes.merge_properties(people, "Person", ids, {"tag": "old"})
    assert rows(g.nodes["Person"].df.select("name", "tag")) == [("Alice", None), ("Bob", "old"), ("Charlie", "old")]
    g, _ = writes.remove_property(g, "Person", "age", ids)
    assert rows(g.nodes["Person"].df.where("age is not null").select("name")) == [("Alice",)]
    g, _ = writes.delete_rels(people, "KNOWS", spark.createDataFrame([(1,)], "id long"))
    assert g.relationship_count() == 2
    ask = spark.createDataFrame([("Alice",), ("Zed",), ("Zed",)], "name string")
    for _ in range(2):
        g, merged, stats = writes.merge_nodes(g, "Person", ask)
    assert stats.nodes_created == 0 and g.node_count() == 4 and merged.count() == 2
    store = writes.Store(people)
    tx = store.begin()
    tx.apply(writes.create_nodes, "City", spark.createDataFrame([("Rome",)], "name string"))
    assert tx.graph.node_count() == 4 and store.graph.node_count() == 3
    tx.rollback()
    assert store.graph.node_count() == 3
    tx = store.begin()
    tx.apply(writes.create_nodes, "City", spark.createDataFrame([("Rome",)], "name string"))
    assert tx.commit().nodes_created == 1 and store.graph.node_count() == 4
    with pytest.raises(ReadOnly):
        store.begin(write=False).apply(writes.create_index, "Person", "name")
    with pytest.raises(GraphError):
        tx.apply(writes.create_index, "Person", "name")
    g = writes.create_constraint(people, "Person", "name")
    with pytest.raises(ConstraintViolation):
        writes.create_nodes(g, "Person", spark.createDataFrame([("Bob",)], "name string"))
    with pytest.raises(ConstraintViolation):
        writes.create_constraint(writes.create_nodes(people, "Person", spark.createDataFrame([("No age",)], "name string"))[0], "Person", "age", "required")


def test_dump_round_trip_and_saved_graphs(people, spark, tmp_path):
    lines = [r.line for r in dump_lines(people).orderBy("part").collect()]
    assert "// Nodes: 3" in lines and "// Relationships: 3" in lines
    assert sum(x.startswith("CREATE") for x in lines) == 3 and sum(x.startswith("MATCH") for x in lines) == 3
    odd = people.nodes["Person"].df.withColumn("name", F.when(F.col("id") == 1, "O'Hara, \"x\": {y}\\").otherwise(F.col("name"))).withColumn("tags", F.array(F.lit("a"), F.lit("b")))
    g = people.add_nodes("Person", odd, 1)
    export_dump(g, f"{tmp_path}/dump")
    nodes, rels = import_dump(spark, f"{tmp_path}/dump")
    base = 1 << 40
    assert rows(nodes.select("id", F.col("properties")["name"], F.col("properties")["age"])) == [(base + 1, "O'Hara, \"x\": {y}\\", "25"), (base + 2, "Bob", "30"), (base + 3, "Charlie", "35")]
    assert rows(rels.select("type", "src", "dst", F.col("properties")["since"])) == [("KNOWS", base + 1, base + 2, "2020"), ("KNOWS", base + 2, base + 3, "2015"), ("WORKS_WITH", base + 1, base + 3, None)]
    save(writes.create_index(g, "Person", "age"), f"{tmp_path}/graph")
    again = load(spark, f"{tmp_path}/graph")
    assert again.node_count() == 3 and again.relationship_count() == 3 and again.indexes == {("Person", "age")}
    assert rows(dump_lines(again)) == rows(dump_lines(g))
    hard = ["C:\\new\\table", "a\r\nb\n", "it's \\' \\\\n", "\\", "x, y: 'z'], [", "\u2028 line", "é😀", "'", "\\\n"]
    text = spark.createDataFrame(list(enumerate(hard, 1)), "id long, name string").withColumn("tags", F.array("name", F.lit("]")))
    export_dump(Graph.of(spark, {"T": text}), f"{tmp_path}/hard")
    nodes, _ = import_dump(spark, f"{tmp_path}/hard")
    assert {r.id - base: r.properties["name"] for r in nodes.collect()} == dict(enumerate(hard, 1))
    assert dump_lines(Graph(spark)).count() == 3


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    items = F.array(F.lit(1), F.lit(2), F.lit(None))
    assert value(scalar.span(F.lit(1), F.lit(9), F.lit(4))) == [1, 5, 9] and value(scalar.span(F.lit(3), F.lit(1), F.lit(-1))) == [3, 2, 1]
    assert value(scalar.span(F.lit(1), F.lit(3), F.lit(0))) == [] and value(scalar.tail(F.array().cast("array<int>"))) == []
    assert (value(scalar.head(items)), value(scalar.last(items)), value(scalar.tail(items))) == (1, None, [2, None])
    assert value(scalar.member(F.lit(7), items)) is False and value(scalar.member(F.lit(None).cast("int"), items)) is None
    assert value(scalar.to_boolean(F.lit("maybe"))) is None and value(scalar.int_divide(F.lit(-7), F.lit(2))) == -3
    assert value(scalar.whole_match(F.lit("abc\n"), "abc")) is False and value(scalar.whole_match(F.lit("abc"), "a|abc")) is True
    assert value(scalar.simple_case(F.lit(None).cast("int"), [(F.lit(None).cast("int"), F.lit("null"))], F.lit("no"))) == "null"


def test_vectors(spark):
    df = spark.createDataFrame([([0] * 1024, [1 << 15] * 1024)], "a array<int>, b array<int>")
    d = df.select(vectors.bf16_distance(F.col("a"), F.col("b")).alias("d")).select("d.*", vectors.bf16_similarity(F.col("d")).alias("s"), vectors.mant_agreement(F.col("d")).alias("m"), vectors.sign_agreement(F.col("d")).alias("g"), vectors.exp_agreement(F.col("d")).alias("e")).first()
    assert (d.score, d.sign_flips, d.mant_elements_compared, d.m, d.g, d.e) == (65_536, 1024, 0, 0.0, 0.0, 1.0)
    df = spark.createDataFrame([([0.0, 1.5, -2.0],)], "v array<float>")
    back = df.select(vectors.from_bf16(vectors.to_bf16("v")).alias("v")).first().v
    assert all(abs(x - y) < 0.02 for x, y in zip(back, [0.0, 1.5, -2.0], strict=True))
    book = vectors.Codebook([0.0, -1.0, 5.0], [1.0, 1.0, 6.0])
    got = spark.createDataFrame([([0.0, 1.0, 5.5],)], "v array<double>").select(book.encode(F.col("v")).alias("n")).select("n", book.decode(F.col("n")).alias("d"), vectors.nibble_hex(F.col("n")).alias("h")).first()
    assert got.n == [0, 15, 8] and got.h == "0:F:8" and abs(got.d[2] - 5.5) < 0.04
    df = spark.createDataFrame([([1, 15] * 8, [2, 14] * 8)], "a array<int>, b array<int>")
    df = df.select("a", "b", vectors.pack_words(F.col("a"), F.lit(True)).alias("p"), vectors.pack_words(F.col("b"), F.lit(False)).alias("q"))
    got = df.select(vectors.full_distance(F.col("p"), F.col("q")).alias("d"), vectors.unpack_words(F.col("p")).alias("u"), vectors.nibble_distance(F.col("a"), F.col("b")).alias("n"), vectors.hamming(F.col("a"), F.col("b")).alias("h"), vectors.bind(vectors.bind(F.col("a"), F.col("b")), F.col("b")).alias("x")).first()
    assert (got.d, got.n, got.h, got.u.nibbles, got.u.intensity, got.x) == (32, 16, 24, [1, 15] * 8, True, [1, 15] * 8)


def test_reasoning(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0.8, 0.9), (2, 2, 3, 0.7, 0.8)], "id long, src long, dst long, frequency double, confidence double")
    r = reasoning.deduction(edges).first()
    assert (r.src, r.via, r.dst) == (1, 2, 3) and abs(r.frequency - 0.56) < 1e-9 and abs(r.confidence - 0.4032) < 1e-9
    meet = edges.withColumn("dst", F.lit(9).cast("long"))
    r = reasoning.abduction(meet).where("src = 1").first()
    assert abs(r.frequency - 0.8) < 1e-9 and abs(r.confidence - 0.504) < 1e-9
    part = edges.withColumn("src", F.lit(9).cast("long"))
    r = reasoning.induction(part).where("src = 2").first()
    assert abs(r.frequency - 0.7) < 1e-9 and abs(r.confidence - 0.576) < 1e-9
    tensors = spark.createDataFrame([(1, *[0.9] * 9), (2, *[0.1] * 9), (3, *[0.5, 0.2, 0.4] * 3)], "id int, " + ", ".join(f"{d} double" for d in reasoning.DIMENSIONS))
    got = rows(tensors.select("id", reasoning.awareness_state(), reasoning.causal_direction(), reasoning.most_tensioned()["name"]))
    assert got == [(1, "Crystallized", "Aligned", "s_sign"), (2, "Tensioned", "Inverted", "s_sign"), (3, "Uncertain", "Mixed", "s_exp")]
    t = spark.range(1).select(reasoning.truth(F.lit(1.5), F.lit(-1.0)).alias("t"), reasoning.expectation(F.lit(0.8), F.lit(0.5)).alias("e"), reasoning.revision(F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(0.5)).alias("r")).first()
    assert (t.t.frequency, t.t.confidence, round(t.e, 9), round(t.r.frequency, 9), round(t.r.confidence, 9)) == (1.0, 0.0, 0.65, 0.5, 0.666666667)
    assert reasoning.masked(tensors, "s_sign").first()["o_mant"] == 0.0
    assert [reasoning.active_count(m) for m in ("all", "causal", "subject", ("s_exp",))] == [9, 3, 3, 1]
    assert rows(reasoning.resonance(tensors, state="Crystallized").select("id")) == [(1,)] and reasoning.resonance(tensors, most_sign=0.5).count() == 2
    assert reasoning.resonance(tensors, state="Crystallized", mask="subject").count() == 0 and reasoning.resonance(tensors, direction="Aligned", mask="causal").first()["s_exp"] == 0.9
    steps = spark.createDataFrame([(1, 2, *[0.9, 0.1, 0.5] * 3), (2, 3, *[0.2, 0.3, 0.5] * 3), (1, 3, *[0.5] * 9), (3, 1, *[0.9, 0.1, 0.5] * 3)], "src long, dst long, " + ", ".join(f"{d} double" for d in reasoning.DIMENSIONS))
    got = {r.target: (r.hops, round(r.sign, 9), round(r.exp, 9), round(r.mant, 9)) for r in reasoning.causal_paths(steps.where("src <> 1 or dst <> 3"), spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {2: (1, 0.9, 0.1, 0.5), 3: (2, round(0.18 + 0.08, 9), 0.4, 0.25)}


def test_shortest_paths_do_not_end_silently(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(4)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "id long")
    assert paths.shortest_paths(edges, start).count() == 5
    assert paths.shortest_paths(edges, start, most=2).count() == 3
    for most in (4, 3):
        monkeypatch.setattr(paths, "MOST_HOPS", most)
        if most == 4:
            assert paths.shortest_paths(edges, start).count() == 5
        else:
            with pytest.raises(RuntimeError):
                paths.shortest_paths(edges, start)


def test_dump_holds_the_whole_graph(spark):
    from vertexloom.plans.queries import QUERIES
    from vertexloom.sources.tables import star_graph

    g = star_graph(spark, "/root/testdata/sf0.001")
    parts = {r.part: r["count"] for r in QUERIES["export_dump"](spark, "/root/testdata/sf0.001").groupBy("part").count().collect()}
    assert parts == {0: 3, 1: g.node_count(), 2: g.relationship_count()}


def test_every_query_vector_is_asked(spark):
    from vertexloom.plans.queries import QUERIES

    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = {r.vec_id for r in table.collect() if r.vec_id % 50 == 0}
    book = vectors.Codebook.fit(table, "embedding")
    coded = {r.vec_id: r.n for r in table.select("vec_id", book.encode(F.col("embedding")).alias("n")).collect()}
    want = set()
    for q in asked:
        each = sorted((sum(abs(x - y) for x, y in zip(coded[q], n, strict=True)), i) for i, n in coded.items())
        want |= {(q, i, d) for d, i in each[:10]}
    assert {(r.query, r.id, r.distance) for r in QUERIES["nib4_knn"](spark, "/root/testdata/sf0.001").collect()} == want and len(asked) == 10
    near = QUERIES["bf16_distance"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.query, r.id) for r in near} == {(q, i) for q in asked for i in coded} and len(near) == len(asked) * len(coded)
    assert all(r.score == 0 for r in near if r.query == r.id)


def test_whole_tables_are_reasoned_over(spark):
    """As many rows as all relationships and all customers give, not those of some keys."""
    from collections import Counter
    from itertools import combinations

    from vertexloom.plans.queries import QUERIES

    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    pairs = {(r.l_suppkey, r.l_partkey) for r in read("lineitem").collect()}
    squares = lambda keys: sum(n * (n - 1) for n in Counter(keys).values())
    assert QUERIES["nars_abduction_all"](spark, "/root/testdata/sf0.001").count() == squares(p for _, p in pairs)
    assert QUERIES["nars_abduction"](spark, "/root/testdata/sf0.001").count() == squares(r.s_nationkey for r in read("supplier").collect())
    assert QUERIES["nars_induction"](spark, "/root/testdata/sf0.001").count() == squares(r.o_custkey for r in read("orders").collect())
    supplies = read("lineitem").select(F.xxhash64("l_suppkey", "l_partkey").alias("id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(0.5).alias("frequency"), F.lit(0.5).alias("confidence")).distinct()
    assert reasoning.induction(supplies).count() == squares(s for s, _ in pairs)
    bought = {}
    for r in read("orders").join(read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).collect():
        bought.setdefault(r.o_custkey, set()).add(r.l_partkey)
    want = {(a, b, round(len(bought[a] & bought[b]) / len(bought[a] | bought[b]), 9)) for a, b in combinations(sorted(bought), 2) if bought[a] & bought[b]}
    assert {tuple(r) for r in QUERIES["jaccard_similarity"](spark, "/root/testdata/sf0.001").collect()} == want and len(want) > 1000


def test_algorithms_and_procedures(spark, people):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51)], "src long, dst long")
    assert {r.id: r.component for r in algorithms.components(edges).collect()} == {k: 0 for k in range(31)} | {50: 50, 51: 50}
    ranks = algorithms.page_rank(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long"), 20).collect()
    assert abs(sum(r.rank for r in ranks) - 1) < 1e-9 and max(ranks, key=lambda r: r.rank).id == 1
    assert rows(procedures.call(people, "db.labels")) == [("Person",)]
    with pytest.raises(SemanticError):
        procedures.call(people, "no.such")
    procedures.register("my.count", lambda g, label: g.nodes[label].df.groupBy().count())
    assert rows(procedures.call(people, "my.count", "Person", yields=["count"])) == [(3,)]
    loops = spark.createDataFrame([(7, 7), (1, 2), (2, 2)], "src long, dst long")
    assert {r.id: r.component for r in algorithms.components(loops).collect()} == {7: 7, 1: 1, 2: 1}
    marks = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 10), (3, 11), (3, 12)], "src long, dst long")
    assert rows(algorithms.overlap(marks, spark.createDataFrame([(1, 3), (2, 9)], "a long, b long"))) == [(1, 3, 1.0), (2, 9, 0.0)]
    assert rows(algorithms.nearest_neighbours(marks, 1).select("a", "b")) == [(1, 3), (2, 1), (3, 1)]


def test_stream_of_events(spark, tmp_path):
    from vertexloom.streaming.events import did, read_events, tumbling_counts

    folder = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(str(folder))
    for name, f in (("did", lambda e: did(e, "click", 1.0)), ("counts", lambda e: tumbling_counts(e, late="60 days"))):
        q = f(read_events(spark, str(folder))).writeStream.format("memory").queryName(name).outputMode("append" if name == "did" else "complete").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        assert rows(spark.table(name)) == rows(f(spark.read.parquet("/root/testdata/sf0.001/events.parquet")))


def test_blocks_measure_as_columns_do(spark, monkeypatch):
    """Every pair, over several blocks and tiles, has the numbers of the column expressions; missing vectors have none."""
    import random

    from vertexloom.functions import blocks

    for name, size in (("QUERY_BLOCK", 3), ("ROW_BLOCK", 7), ("BEST_BLOCK", 5), ("TILE", 10)):
        monkeypatch.setattr(blocks, name, size)
    random.seed(7)
    made = [(i, [random.uniform(-3, 3) for _ in range(70)]) for i in range(40)] + [(40, None), (41, [1.0, None] * 35), (42, [1.0] * 3)]
    table = spark.createDataFrame(made + [(43, made[3][1])], "id long, v array<float>").repartition(3)
    coded = table.where("id < 40").select("id", vectors.to_bf16("v").alias("v"))
    queries = lambda df: df.where("id % 5 = 0").withColumnRenamed("id", "query")
    beside = lambda df: df.crossJoin(queries(df).withColumnRenamed("v", "q"))
    d = beside(coded).select("query", "id", vectors.bf16_distance(F.col("v"), F.col("q")).alias("d"))
    ratios = (vectors.bf16_similarity, vectors.sign_agreement, vectors.exp_agreement, vectors.mant_agreement, vectors.gate_pass_ratio)
    want = d.select("query", "id", "d.score", "d.sign_flips", "d.exp_delta_sum", "d.mant_bit_flips", *(F.round(f(F.col("d")), 9) for f in ratios))
    got = blocks.every_pair(coded, queries(coded), blocks.bf16_measures, "a bigint, b bigint, c bigint, d bigint, e double, f double, g double, h double, i double")
    assert rows(got) == rows(want) and got.count() == 8 * 40
    pairs = blocks.every_pair(table, queries(table), lambda q, r: [blocks.euclideans(q, r), blocks.dots(q, r)], "l2 double, dot double")
    want = beside(table).select("query", "id", vectors.euclidean(F.col("v"), F.col("q")), vectors.dot(F.col("v"), F.col("q")))
    assert sorted(map(repr, pairs.collect())) == sorted(repr(r).replace(r.__fields__[2] + "=", "l2=").replace(r.__fields__[3] + "=", "dot=") for r in want.collect())
    near = blocks.best_each(table.where("id < 42 or id = 43"), queries(table.where("id < 40")), blocks.cosines, "double", 3)
    whole = beside(table.where("id < 40 or id = 43")).where("query < 40").select("query", "id", vectors.cosine(F.col("v"), F.col("q")).alias("s"))
    best = {}
    for r in whole.collect():
        best.setdefault(r.query, []).append((-r.s, r.id))
    assert {(r.query, r.id, r.score) for r in near.collect()} == {(q, i, -s) for q, each in best.items() for s, i in sorted(each)[:3]}
    assert rows(blocks.best_each(table.where("id in (5, 40)"), queries(table.where("id = 5")), blocks.dots, "double", 3).select("id", F.col("score").isNull())) == [(40, True), (5, False)]


def test_pairs_of_relationships_are_counted(spark):
    """As many as distinct_edges keeps, where relationships are the same and where only their ids are."""
    from vertexloom.plans.match import count_pairs, distinct_edges, into, match, node, out

    people, towns = spark.range(1, 8), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, name string")
    lives = people.where("id < 7").select("id", F.col("id").alias("src"), (F.col("id") % 2 + 1).alias("dst"))
    likes = people.select("id", F.col("id").alias("src"), (F.col("id") % 3 + 1).alias("dst"))
    g = Graph.of(spark, {"P": people, "T": towns}, {"LIVES": ("P", "T", lives), "LIKES": ("P", "T", likes)})
    for s in ("LIVES", "LIKES"):
        whole = match(g, node("a", "P", fetch=False), out("LIVES", "r"), node("t", "T"), into(s, "s"), node("b", "P", fetch=False))
        want = distinct_edges(whole, "r", "s").groupBy("t__id", "t__name").agg(F.count(F.lit(1)).alias("pairs"))
        one, two = (match(g, node(v, "P", fetch=False), out(kind, e), node("t", "T", fetch=fetch)) for v, kind, e, fetch in (("a", "LIVES", "r", True), ("b", s, "s", False)))
        got = count_pairs(one, two, "r", "s", "t__name")
        assert rows(got) == rows(want) and got.count()


def test_hot_keys_meet_in_cells(spark, monkeypatch):
    """Every pair of a hot key's edges comes once, from several tasks; keys without relationships on one side give none."""
    monkeypatch.setattr(reasoning, "CELL", 16)
    made = [(k, k, 0 if k < 100 else k // 3, k / 300, 0.5) for k in range(200)] + [(300, 300, None, 0.1, 0.1), (301, 0, 5, 0.2, 0.2)]
    edges = spark.createDataFrame(made, "id long, src long, dst long, frequency double, confidence double")
    own = {k: (s, d, f, c) for k, s, d, f, c in made if d is not None}
    got = reasoning.abduction(edges)
    want = sorted((s, d, t, f, c * e * h) for k, (s, d, f, c) in own.items() for m, (t, u, h, e) in own.items() if d == u and k != m)
    assert sorted(map(tuple, got.collect())) == want
    assert got.where("via = 0").select(F.spark_partition_id().alias("p")).distinct().count() > 4
    want = sorted((s, d, u, f * h) for s, d, f, c in own.values() for t, u, h, e in own.values() if d == t)
    assert sorted((r.src, r.via, r.dst, r.frequency) for r in reasoning.deduction(edges).collect()) == want


def test_dump_is_written_where_its_rows_are(spark, tmp_path):
    """No task gets all statements of a kind, and files by name hold nodes before relationships."""
    people = spark.range(100).repartition(6).withColumn("x", F.col("id") / 2)
    knows = spark.range(90).repartition(5).select("id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    export_dump(Graph.of(spark, {"P": people}, {"KNOWS": ("P", "P", knows)}), f"{tmp_path}/many")
    files = [f.read_text().splitlines() for f in sorted((tmp_path / "many").glob("part-*"))]
    assert max(map(len, files)) < 40 and sum(map(len, files)) == 193
    kinds = [line.split(" ")[0] for lines in files for line in lines]
    assert kinds == ["//"] * 3 + ["CREATE"] * 100 + ["MATCH"] * 90
    assert "CREATE (n:P {_id: 1099511627779, x: 1.5});" in sum(files, []) and "CREATE (n:P {_id: 1099511627780, x: 2});" in sum(files, [])


def test_similar_nodes_of_long_lists(spark, monkeypatch):
    """Neighbours of more nodes than a list holds; pairs are counted where the lists are, in as many tasks as they ask for."""
    from itertools import combinations

    monkeypatch.setattr(algorithms, "LIST", 4)
    monkeypatch.setattr(algorithms, "TASK_MEETINGS", 50)
    made = [(s, d) for s in range(25) for d in range(12) if (s * 7 + d * 5) % 3 and (d or s > 2)] + [(99, 50), (98, None), (None, 3), (3, None)]
    edges = spark.createDataFrame(made * 2, "src long, dst long")
    own = {}
    for s, d in made:
        own.setdefault(s, []).append(d)
    both = lambda a, b: len(set(own[a]) & set(own[b]) - {None})
    pairs = [(a, b) for a, b in combinations(sorted(k for k in own if k is not None), 2) if both(a, b)]
    for kind, by in (("jaccard", lambda a, b: len(own[a]) + len(own[b]) - both(a, b)), ("overlap", lambda a, b: min(len(own[a]), len(own[b])))):
        want = {(a, b): both(a, b) / by(a, b) for a, b in pairs}
        got = algorithms.similar_all(edges, kind)
        assert {(r.a, r.b): r.similarity for r in got.collect()} == want and got.count() == len(want)
        near = {}
        for (a, b), s in want.items():
            near.setdefault(a, []).append((-s, b))
            near.setdefault(b, []).append((-s, a))
        best = {(a, b, -s, k) for a, each in near.items() for k, (s, b) in enumerate(sorted(each)[:3], 1)}
        assert {tuple(r) for r in algorithms.nearest_neighbours(edges, 3, kind).collect()} == best
    assert algorithms.similar_all(edges).select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_pairs_of_nodes_are_not_moved(spark):
    """What is shuffled follows the edges, not the pairs that meet."""
    import random

    from vertexloom.operators.meetings import from_planes, to_planes

    random.seed(5)
    for x in ([], [0], [-1, 5, 5, 1 << 40], [-(1 << 63), (1 << 63) - 1, 0], [random.randrange(1 << 20) for _ in range(999)]):
        assert from_planes(to_planes(x)).tolist() == x
    made = [(s, d) for d in range(400) for s in random.sample(range(0, 300_000, 100), 80)]  # 2.5 million meetings
    edges = spark.createDataFrame(made, "src long, dst long")
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    for found, n in ((algorithms.nearest_neighbours(edges, 3), 9000), (algorithms.similar_all(edges), None)):
        before = moved()
        rows_found = found.collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert moved() - before < 4_000_000 and len(rows_found) > 8_000 and n in (None, len(rows_found))
