import pytest
from pyspark.sql import functions as F

from graphvec.functions.registry import register
from graphvec.graph import EdgeTable, NodeTable, PropertyGraph
from graphvec.plans.syntax import CypherError, parse


@pytest.fixture(scope="module")
def people(spark):
    """Ten persons, ages 20 to 29, each knows the next; the even ones live in one city, person 9 has no age."""
    persons = spark.createDataFrame([(i, f"P{i}", None if i == 9 else 20 + i, ["Person", "Even"] if i % 2 == 0 else ["Person"]) for i in range(10)], "id long, name string, age long, labels array<string>")
    knows = spark.createDataFrame([(i, i + 1, 0.1 * (i + 1), "KNOWS") for i in range(9)] + [(9, 0, 1.0, "KNOWS"), (0, 0, 1.0, "SELF"), (0, 5, 0.5, "LIKES")], "src long, dst long, weight double, relation string")
    cities = spark.createDataFrame([(1, "Ulm"), (2, "Bonn")], "id long, name string")
    lives = spark.createDataFrame([(i, 1 if i % 2 == 0 else 2) for i in range(9)], "src long, dst long")
    graph = PropertyGraph(spark).with_node(NodeTable("Person", persons, "id", "labels")).with_node(NodeTable("City", cities))
    return graph.with_edge(EdgeTable("Person", "", "Person", knows)).with_edge(EdgeTable("Person", "LIVES_IN", "City", lives))


def rows(graph, text, params=None, **options):
    return [tuple(r) for r in graph.cypher(text, params, **options).collect()]


@pytest.mark.parametrize("text", [
    "MATCH (n) RETURN n", "MATCH (n:A:B {x: 1}) WHERE n.x > 1 AND NOT n.y = 2 RETURN n.x AS x ORDER BY x DESCENDING SKIP 1 LIMIT 2", "MATCH (a)-->(b)<--(c)--(d) RETURN a", "MATCH (a)-[r:X|Y|:Z*1..3 {w: 1}]->(b) RETURN b",
    "OPTIONAL MATCH (a) RETURN a;", "RETURN 'it\\'s' AS s, \"q\" AS t, -1.5e3 AS f, [1, 2] AS l, {a: 1} AS m", "CREATE (a:X {id: 1})-[:R]->(b:Y)", "MATCH (n:X) DETACH DELETE n", "MATCH (n:X) SET n.a = 1, n += {b: 2}, n:L",
    "MATCH (nullable) RETURN nullable.orange AS android", "RETURN CASE 1 WHEN 1 THEN 2 ELSE 3 END AS c // comment",
])
def test_parses(text):
    assert parse(text).clauses


@pytest.mark.parametrize("text", ["", "MATCH (n)", "RETURN", "MATCH (n RETURN n", "MATCH (a)-[*3..1]->(b) RETURN a", "MATCH (a)-[*1..101]->(b) RETURN a", "RETURN 1 +", "RETURN 99999999999999999999", "FOO (n)", "MATCH (n) RETURN n LIMIT -1", "RETURN CASE END", "MATCH (a)<-[]->(b) RETURN a", "RETURN '" + "x" * 100_001 + "'"])
def test_rejects(text):
    with pytest.raises(CypherError):
        parse(text)


def test_filters_and_nulls(people):
    assert rows(people, "MATCH (p:Person) WHERE p.age > 27 RETURN p.name AS n ORDER BY n") == [("P8",)]
    assert rows(people, "MATCH (p:Person) WHERE NOT p.age > 21 RETURN p.id AS i ORDER BY i") == [(0,), (1,)]
    assert rows(people, "MATCH (p:Person) WHERE p.age IS NULL RETURN p.id") == [(9,)]
    assert rows(people, "MATCH (p:Person {name: $n}) RETURN p.age", {"n": "P3"}) == [(23,)]
    assert rows(people, "MATCH (p:Person:Even) RETURN count(*) AS n") == [(5,)]
    assert rows(people, "MATCH (p:Person) RETURN p.nothing AS x LIMIT 1") == [(None,)]
    with pytest.raises(CypherError):
        rows(people, "MATCH (p:Person) RETURN p._secret")
    with pytest.raises(CypherError):
        rows(people, "MATCH (p:Person) WHERE p.age = $missing RETURN p")


def test_compatible_logic(people):
    # two-valued: a null comparison is false and its negation true; NULL is the lowest value and equals itself
    assert rows(people, "MATCH (p:Person) WHERE p.age < 21 RETURN p.id AS i ORDER BY i", compat=True) == [(0,), (9,)]
    assert rows(people, "RETURN NULL = NULL AS a, 1 = 1.0 AS b, NULL < 5 AS c, NOT NULL AS d", compat=True) == [(True, False, True, True)]
    assert rows(people, "RETURN NULL = NULL AS a, 1 = 1.0 AS b, NULL < 5 AS c") == [(None, True, None)]


def test_expand(people):
    assert rows(people, "MATCH (a:Person {id: 0})-[:KNOWS]->(b) RETURN b.id") == [(1,)]
    assert rows(people, "MATCH (a:Person {id: 0})<-[:KNOWS]-(b) RETURN b.id") == [(9,)]
    assert rows(people, "MATCH (a:Person {id: 0})-[:KNOWS]-(b) RETURN b.id AS b ORDER BY b") == [(1,), (9,)]
    assert rows(people, "MATCH (a:Person {id: 0})-[r]->(b:Person) RETURN type(r) AS t, b.id AS b, r.weight AS w ORDER BY t") == [("KNOWS", 1, 0.1), ("LIKES", 5, 0.5), ("SELF", 0, 1.0)]
    assert rows(people, "MATCH (a:Person {id: 0})-[:KNOWS|LIKES {weight: 0.5}]->(b) RETURN b.id") == [(5,)]
    assert rows(people, "MATCH (a:Person {id: 0})-[]->(b:Person) RETURN b.id AS b ORDER BY b", compat=True) == [(1,), (5,)]
    assert rows(people, "MATCH (a:Person)-[:LIVES_IN]->(c:City)<-[:LIVES_IN]-(b:Person) WHERE a.id < b.id RETURN c.name AS c, count(*) AS n ORDER BY c") == [("Bonn", 6), ("Ulm", 10)]
    assert rows(people, "MATCH (a:Person) WHERE NOT (a)-[:LIVES_IN]->() RETURN a.id") == [(9,)]
    assert rows(people, "MATCH (a:Person) OPTIONAL MATCH (a)-[:LIVES_IN]->(c:City {name: 'Ulm'}) RETURN count(a) AS a, count(c) AS c") == [(10, 5)]


def test_variable_length(people):
    assert rows(people, "MATCH (a:Person {id: 0})-[:KNOWS*2..3]->(b) RETURN b.id AS b ORDER BY b") == [(2,), (3,)]
    # each node once, at its least depth, never the source
    assert rows(people, "MATCH (a:Person {id: 0})-[*]->(b:Person) RETURN count(*) AS n") == [(9,)]
    assert rows(people, "MATCH (a:Person {id: 0})-[r:KNOWS|LIKES*1..5]->(b:Person {id: 5}) RETURN r") == [(1,)]
    # paths without a repeated edge: by KNOWS five times, and directly
    assert rows(people, "MATCH (a:Person {id: 0})-[:KNOWS|LIKES*1..5]->(b:Person {id: 5}) RETURN count(*) AS n", path_mode="trail") == [(2,)]


def test_projection_order(people):
    assert rows(people, "MATCH (p:Person) RETURN p.age AS a ORDER BY a LIMIT 2") == [(None,), (20,)]
    assert rows(people, "MATCH (p:Person) RETURN p.age AS a ORDER BY a DESC SKIP 8") == [(20,), (None,)]
    assert rows(people, "MATCH (p:Person) RETURN DISTINCT p.age / 5 AS d ORDER BY d") == [(None,), (4,), (5,)]
    assert people.cypher("MATCH (p:Person) RETURN p.name, p.age + 1, p AS node").columns == ["p.name", "column_1", "node"]
    assert rows(people, "MATCH (p:Person) WITH p.age AS a, p WHERE a > 27 RETURN p.name AS n, a") == [("P8", 28)]
    assert rows(people, "MATCH (p:Person) RETURN count(p.age) AS n, collect(p.age)[0] AS lo, max(p.age) AS hi, avg(p.age) AS m") == [(9, 20, 28, 24.0)]


def test_arithmetic_errors(people):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        rows(people, "RETURN 1 / 0 AS x")
    assert rows(people, "RETURN -7 / 2 AS a, -7 % 2 AS b, 7.0 / 2 AS c, 2 ^ 10 AS d") == [(-3, -1, 3.5, 1024.0)]


def test_mutations(people):
    made = people.execute("MATCH (p:Person {id: 1}) CREATE (p)-[:OWNS {weight: 3}]->(d:Dog {id: 7, name: 'Rex'})")
    assert (made.stats.nodes_created, made.stats.relationships_created) == (1, 1)
    assert rows(made.graph, "MATCH (p)-[o:OWNS]->(d:Dog) RETURN p.name AS p, o.weight AS w, d.name AS d") == [("P1", 3, "Rex")]
    changed = made.graph.execute("MATCH (d:Dog) SET d.name = 'Max', d.age = 3, d:Old")
    assert rows(changed.graph, "MATCH (d:Old) RETURN d.name AS n, d.age AS a") == [("Max", 3)]
    merged = changed.graph.execute("MATCH (d:Dog) SET d = {age: 4}")
    assert rows(merged.graph, "MATCH (d:Dog) RETURN d.name AS n, d.age AS a") == [(None, 4)]
    gone = merged.graph.execute("MATCH (d:Dog) DETACH DELETE d")
    assert gone.stats.nodes_deleted == 1
    assert rows(gone.graph, "MATCH (p:Person)-[:OWNS]->() RETURN count(*) AS n") == [(0,)]
    cut = people.execute("MATCH (a:Person {id: 0})-[r:LIKES]->(b) DELETE r")
    assert cut.stats.relationships_deleted == 1
    assert rows(cut.graph, "MATCH (a:Person {id: 0})-[r]->(b:Person) RETURN count(*) AS n") == [(2,)]
    assert rows(people, "MATCH (a:Person {id: 0})-[r]->(b:Person) RETURN count(*) AS n") == [(3,)]  # the old graph stays


def test_functions_and_explain(people):
    register("shout", lambda s: F.concat(F.upper(s), F.lit("!")))
    assert rows(people, "RETURN shout('a') AS a, range(1, 5, 2) AS r, [1, 2, 3][-1] AS l, toInteger('12') AS i, coalesce(NULL, 2) AS c") == [("A!", [1, 3, 5], 3, 12, 2)]
    with pytest.raises(CypherError):
        rows(people, "RETURN nosuch(1) AS x")
    plan = people.explain("MATCH (a:Person)-[:KNOWS]->(b) WHERE a.age > 3 RETURN b.name AS n ORDER BY n LIMIT 2").splitlines()
    assert plan[0] == "Limit(2)" and plan[-1].strip() == "NodeByLabelScan(a, :Person)"


def test_pushdown(spark, tmp_path):
    """Only the named columns are read, and filters reach the scan."""
    spark.range(100).selectExpr("id", "id * 2 AS a", "id * 3 AS b").write.parquet(f"{tmp_path}/t")
    graph = PropertyGraph(spark).with_node(NodeTable("T", spark.read.parquet(f"{tmp_path}/t")))
    plan = graph.cypher("MATCH (t:T) WHERE t.a > 150 RETURN t.a AS a")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,150)" in plan and "ReadSchema: struct<a:bigint>" in plan or "id:bigint" in plan and "b:bigint" not in plan


def test_trails_know_their_edges(spark):
    """A path may not take an edge back, whichever way it is turned, but may take a parallel one."""
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    once = spark.createDataFrame([(1, 2)], "src long, dst long")
    graph = lambda edges: PropertyGraph(spark).with_node(NodeTable("N", nodes)).with_edge(EdgeTable("N", "R", "N", edges))
    trails = lambda g, text: sorted(tuple(r) for r in g.cypher(text, path_mode="trail").collect())
    assert trails(graph(once), "MATCH (a:N)-[:R*2]-(b:N) RETURN a.id AS a, b.id AS b") == []
    assert trails(graph(once.union(once)), "MATCH (a:N)-[:R*2]-(b:N) RETURN a.id AS a, b.id AS b") == [(1, 1), (1, 1), (2, 2), (2, 2)]
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 2)], "src long, dst long")
    assert trails(graph(chain), "MATCH (a:N {id: 1})-[:R*2..3]->(b:N) RETURN a.id AS a, b.id AS b") == [(1, 1), (1, 2), (1, 3), (1, 3)]
    assert trails(graph(once), "MATCH (a:N)-[:R*5]->(b:N) RETURN a.id AS a, b.id AS b") == []


def test_distinct_aggregates_and_whole_numbers(people):
    assert rows(people, "UNWIND [1, 1, 4] AS x RETURN avg(DISTINCT x) AS a, sum(DISTINCT x) AS s, stdevp(x) AS p") == [(2.5, 5, 2 ** 0.5)]
    with pytest.raises(Exception, match="DISTINCT"):
        rows(people, "UNWIND [1, 1, 4] AS x RETURN stdev(DISTINCT x) AS a")
    assert rows(people, "RETURN toInteger('9007199254740993') AS a, toInteger('2.9') AS b, toInteger('x') AS c") == [(9007199254740993, 2, None)]
    assert rows(people, "RETURN duration('P1DT1S') AS a, duration('soon') AS b, duration('PT') AS c, time('07:05') AS t") == [(86401.0, None, None, "07:05:00.000000")]


@pytest.mark.parametrize("text, wanted", [
    ("MATCH (a:Person)-[:LIVES_IN]->(c:City), (b:Person)-[:LIVES_IN]->(c) RETURN c.name AS c, count(*) AS n ORDER BY c", [("Bonn", 16), ("Ulm", 25)]),
    ("MATCH (a:Person)-[:LIVES_IN]->(c:City)<-[:LIVES_IN]-(b) RETURN c.name AS c, count(a) AS n, count(b.age) AS m, count(DISTINCT b) AS d, max(b.age) AS x ORDER BY c", [("Bonn", 16, 16, 4, 27), ("Ulm", 25, 25, 5, 28)]),
    ("MATCH (a:Person)-[:LIVES_IN]->(c:City), (b:Person)-[:LIVES_IN]->(c) WHERE a.age > 24 AND b.age < 24 AND c.name <> 'Bonn' RETURN count(*) AS n, count(a) + count(b) AS m", [(4, 8)]),
    ("MATCH (a:Person)-[:LIVES_IN]->(c:City), (b:Person)-[:LIVES_IN]->(c) WHERE a.age < b.age RETURN count(*) AS n", [(16,)]),
    ("MATCH (a:Person)-[:LIVES_IN]->(c:City), (b:Person)-[:LIVES_IN]->(c) WHERE EXISTS((a)-[:SELF]->(a)) RETURN c.name AS c, count(*) AS n", [("Ulm", 5)]),
    ("MATCH (a:Person)-[:LIVES_IN]->(c:City)<-[:LIVES_IN]-(b) RETURN DISTINCT c.name AS c ORDER BY c", [("Bonn",), ("Ulm",)]),
    ("MATCH (a:Person)-[:LIVES_IN]->(c:City) MATCH (c)<-[:LIVES_IN]-(b) OPTIONAL MATCH (c)<-[:LIVES_IN]-(d) WHERE d.age > 27 RETURN c.name AS c, count(*) AS n, count(d) AS d ORDER BY c", [("Bonn", 16, 0), ("Ulm", 25, 25)]),
    ("MATCH (a:Person)-[:LIVES_IN]->(c:City) WITH c, count(a) AS k MATCH (c)<-[:LIVES_IN]-(b)-[:KNOWS]->(d) RETURN k, count(*) AS n ORDER BY k", [(4, 4), (5, 5)]),
    ("MATCH (a:Person), (b:Person), (c:City) RETURN count(*) AS n", [(200,)]),
    ("MATCH (a:Person {id: 77}), (c:City) RETURN c.name AS c, count(*) AS n", []),
    ("MATCH (a:Person)-[:LIVES_IN]->(c:City)<-[:LIVES_IN]-(b) RETURN c.name AS c, sum(b.age) AS s, size(collect(a.age)) AS l ORDER BY c", [("Bonn", 4 * 96, 16), ("Ulm", 5 * 120, 25)]),
    ("MATCH (p:Person) OPTIONAL MATCH (p)-[:SELF]->(q) MATCH (c:City) RETURN count(q) AS q, count(*) AS n", [(2, 20)]),
])
def test_counts_of_joined_patterns(people, text, wanted):
    """What is only counted is the same, whether or not its rows are made."""
    assert rows(people, text) == wanted


def test_counting_makes_no_pairs(spark):
    """300,000 x 300,000 pairs of one place are counted from the members of each side."""
    place = spark.createDataFrame([(1, "x")], "id long, name string")
    member = spark.range(300_000).select("id", F.lit(1).cast("long").alias("place"))
    graph = PropertyGraph(spark).with_node(NodeTable("Place", place))
    for label in ("A", "B"):
        graph = graph.with_node(NodeTable(label, member)).with_edge(EdgeTable(label, "IN", "Place", member.select(F.col("id").alias("src"), F.col("place").alias("dst"))))
    for text in ("MATCH (a:A)-[:IN]->(p:Place), (b:B)-[:IN]->(p) RETURN p.name AS p, count(*) AS n", "MATCH (a:A)-[:IN]->(p:Place)<-[:IN]-(b:B) RETURN p.name AS p, count(a) AS n"):
        plan = graph.explain(text).splitlines()[::-1]
        assert [s.strip() for s in plan].index("Count(p)") < max(i for i, s in enumerate(plan) if "Expand" in s)
        assert rows(graph, text) == [("x", 300_000**2)]
