"""The engine's own queries over the star-schema tables, and the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection
from .functions.distance import distance
from .graph import similar_edges, star_graph
from .model import EDGES, CollectionConfig
from .operators import knn as K
from .operators.index import InvertedLists
from .operators import quantization as Q
from .operators import traversal as T
from .runtime import checkpoint_dir, table
from .sources.payload import encode, value
from .sources.documents import strip_html
from .sources.store import export_collection, hot_over_cold, import_collection, load_collection
from .streaming.log import LOG, DurableCollection, LogSink, replay

#: Fixed parameters of the benchmark queries.
PROBE, K_NEAREST, LABEL = 0, 10, 3

# name -> (query, SQL)
CYPHER: dict[str, tuple[str, str]] = {
    "match_all": ("MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n", """
        SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier
        UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Embedding', count(*) FROM embeddings UNION ALL SELECT 'Page', count(*) FROM pages
        UNION ALL SELECT 'Document', (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id)) UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Turn', count(*) FROM conversations
        UNION ALL SELECT 'Party', count(*) FROM customer"""),
    "match_label": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name", "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "return_star": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN *", "SELECT n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r FROM nation"),
    "match_props": ("MATCH (c:Customer {c_mktsegment: 'BUILDING', c_nationkey: 3}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3"),
    "multi_label": ("MATCH (p:Party:Vip) RETURN p.c_custkey AS k, p.c_acctbal AS bal", "SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000"),
    "has_label": ("MATCH (p:Party) WHERE NOT p:Vip RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_acctbal <= 5000"),
    "node_by_id": ("MATCH (c:Customer {id: 42}) RETURN c.id AS id, c.c_name AS name", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 42"),
    "where_cmp": ("MATCH (c:Customer) WHERE c.c_acctbal >= 9000 AND c.c_acctbal < 9500 AND c.c_nationkey <> 7 RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal >= 9000 AND c_acctbal < 9500 AND c_nationkey <> 7"),
    "where_chain": ("MATCH (p:Part) WHERE 10 < p.p_size <= 12 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 10 AND p_size <= 12"),
    "where_bool": ("MATCH (o:Order) WHERE (o.o_orderstatus = 'F' XOR o.o_totalprice > 250000) AND NOT (o.o_orderpriority = '1-URGENT' OR o.o_custkey < 100) RETURN o.o_orderkey AS k",
        "SELECT o_orderkey AS k FROM orders WHERE ((o_orderstatus = 'F') <> (o_totalprice > 250000)) AND NOT (o_orderpriority = '1-URGENT' OR o_custkey < 100)"),
    "where_null": ("MATCH (d:Document) WHERE d.quality IS NULL RETURN count(*) AS n, count(d.toxic) AS toxic", "SELECT count(*) AS n, count(toxic) AS toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL"),
    "where_not_null": ("MATCH (d:Document) WHERE d.quality IS NOT NULL AND d.toxic = 1 RETURN d.doc_id AS id", "SELECT doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic = 1"),
    "exists_prop": ("MATCH (d:Document) WHERE exists(d.toxic) RETURN count(*) AS n", "SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL"),
    "where_in": ("MATCH (n:Nation) WHERE n.n_nationkey IN [1, 3, 5] OR n.n_name IN $names RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 3, 5) OR n_name IN ('NATION_7', 'NATION_8')"),
    "where_string": ("MATCH (p:Part) WHERE p.p_name STARTS WITH 'blue' AND NOT p.p_name ENDS WITH 'ring' OR p.p_type CONTAINS 'BRASS' RETURN p.p_partkey AS k",
        "SELECT p_partkey AS k FROM part WHERE p_name LIKE 'blue%' AND NOT p_name LIKE '%ring' OR p_type LIKE '%BRASS%'"),
    "regex_match": ("MATCH (n:Nation) WHERE n.n_name =~ 'NATION_1[0-4]' RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE regexp_full_match(n_name, 'NATION_1[0-4]')"),
    "case_expr": ("MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'medium' ELSE 'large' END AS size, CASE p.p_brand WHEN 'Brand#1' THEN 1 ELSE 0 END AS first, count(*) AS n",
        "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, (CASE p_brand WHEN 'Brand#1' THEN 1 ELSE 0 END)::BIGINT AS first, count(*) AS n FROM part GROUP BY ALL"),
    "truthiness": ("MATCH (d:Document) WHERE d.toxic RETURN count(*) AS n", "SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic <> 0"),
    "params": ("MATCH (c:Customer) WHERE c.c_acctbal > $least RETURN c.c_custkey AS k ORDER BY k SKIP $skip LIMIT $limit", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000 ORDER BY k LIMIT 7 OFFSET 5"),
    "arith": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size + 2 * 3 - 1 AS a, -p.p_size AS b, (p.p_size + 1) / 2 AS c, p.p_size % 7 AS d, p.p_retailprice / 4 AS e",
        "SELECT p_partkey AS k, (p_size + 2 * 3 - 1)::BIGINT AS a, -p_size AS b, ((p_size + 1) // 2)::BIGINT AS c, (p_size % 7)::BIGINT AS d, p_retailprice / 4 AS e FROM part"),
    "int_div_mod": ("UNWIND range(-5, 5) AS x RETURN x, x / 2 AS q, x % 3 AS r", "SELECT x, trunc(x / 2)::BIGINT AS q, x % 3 AS r FROM range(-5, 6) t(x)"),
    "pow_expr": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_nationkey ^ 2 AS p", "SELECT n_nationkey AS k, n_nationkey ^ 2 AS p FROM nation"),
    "string_concat": ("MATCH (n:Nation) RETURN n.n_name + '-' + n.n_regionkey AS s, toUpper(substring(n.n_name, 0, 3)) AS t, size(n.n_name) AS l", "SELECT n_name || '-' || n_regionkey AS s, upper(substr(n_name, 1, 3)) AS t, length(n_name) AS l FROM nation"),
    "string_functions": ("MATCH (p:Part) RETURN p.p_partkey AS k, replace(p.p_name, ' ', '_') AS a, split(p.p_name, ' ')[0] AS b, left(p.p_type, 4) AS c, right(p.p_type, 3) AS d, reverse(p.p_brand) AS e, trim(' x ') AS f",
        "SELECT p_partkey AS k, replace(p_name, ' ', '_') AS a, string_split(p_name, ' ')[1] AS b, left(p_type, 4) AS c, right(p_type, 3) AS d, reverse(p_brand) AS e, 'x' AS f FROM part"),
    "math_functions": ("MATCH (c:Customer) RETURN c.c_custkey AS k, abs(c.c_acctbal) AS a, sign(c.c_acctbal) AS s, round(sqrt(abs(c.c_acctbal)), 4) AS q, coalesce(nullif(c.c_nationkey, 3), -1) AS z",
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, sign(c_acctbal)::DOUBLE AS s, round(sqrt(abs(c_acctbal)), 4) AS q, coalesce(nullif(c_nationkey, 3), -1)::BIGINT AS z FROM customer"),
    "list_map_literals": ("UNWIND [1, 2, 3] AS x RETURN x, [x, x * 2][1] AS y, {a: x + 1, b: 'z'}.a AS z, head([x, 9]) AS h, last([x, 9]) AS l, size(tail([x, 9, 8])) AS t", "SELECT x, x * 2 AS y, x + 1 AS z, x AS h, 9::BIGINT AS l, 2::BIGINT AS t FROM range(1, 4) t(x)"),
    "return_only": ("RETURN 1 + 2 AS a, 'x' AS b, true AS c, 2.5 AS d", "SELECT 3::BIGINT AS a, 'x' AS b, true AS c, 2.5::DOUBLE AS d"),
    "order_multi": ("MATCH (o:Order) RETURN o.o_orderpriority AS p, o.o_totalprice AS t, o.o_orderkey AS k ORDER BY p DESC, t ASC, k LIMIT 25", "SELECT o_orderpriority AS p, o_totalprice AS t, o_orderkey AS k FROM orders ORDER BY p DESC NULLS LAST, t NULLS FIRST, k LIMIT 25"),
    "order_nulls": ("MATCH (d:Document) RETURN d.doc_id AS k, d.quality AS q ORDER BY q, k LIMIT 700", "SELECT doc_id AS k, quality AS q FROM documents LEFT JOIN labels USING (doc_id) ORDER BY q NULLS FIRST, k LIMIT 700"),
    "order_hidden": ("MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 10", "SELECT c_custkey AS k FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10"),
    "topk": ("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS t ORDER BY t DESC, k LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY t DESC, k LIMIT 10"),
    "skip_limit": ("MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name AS name ORDER BY name, k SKIP 100 LIMIT 20", "SELECT c_custkey AS k, c_name AS name FROM customer ORDER BY name, k LIMIT 20 OFFSET 100"),
    "distinct_project": ("MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p ORDER BY s, p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "expand_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000"),
    "expand_in": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON r_regionkey = n_regionkey"),
    "expand_both": ("MATCH (e:Embedding {vec_id: 5})-[:SIMILAR]-(x:Embedding) RETURN x.vec_id AS v", "WITH s AS ({similar}) SELECT dst AS v FROM s WHERE src = 5 UNION ALL SELECT src FROM s WHERE dst = 5"),
    "expand_types": ("MATCH (n:Nation)<-[r:IN_NATION|IN_REGION]-(x) RETURN type(r) AS t, labels(x)[0] AS l, n.n_name AS n, count(*) AS c",
        "SELECT 'IN_NATION' AS t, l, n_name AS n, count(*) AS c FROM (SELECT 'Customer' AS l, c_nationkey AS k FROM customer UNION ALL SELECT 'Supplier', s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY ALL"),
    "unknown_relation": ("MATCH (n:Nation)-[:NO_SUCH]->(x) RETURN count(*) AS n", "SELECT 0::BIGINT AS n"),
    "chain_two_hop": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, n.n_name AS n, count(c) AS c",
        "SELECT r_name AS r, n_name AS n, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"),
    "expand_rel_props": ("MATCH (o:Order)-[l:CONTAINS {l_returnflag: 'R'}]->(p:Part) WHERE l.l_quantity >= 49 RETURN o.o_orderkey AS o, l.l_linenumber AS i, p.p_name AS p, l.l_discount AS d",
        "SELECT l_orderkey AS o, l_linenumber AS i, p_name AS p, l_discount AS d FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 49"),
    "labelled_target": ("MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier {s_nationkey: 4}) WHERE s.s_acctbal > 0 RETURN s.s_suppkey AS k", "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey = 4 AND s_acctbal > 0"),
    "multi_pattern": ("MATCH (a:Region), (b:Nation) WHERE a.r_regionkey < b.n_regionkey RETURN a.r_name AS a, b.n_name AS b", "SELECT r_name AS a, n_name AS b FROM region, nation WHERE r_regionkey < n_regionkey"),
    "shared_pattern": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.n_name AS n, count(*) AS pairs", "SELECT n_name AS n, count(*) AS pairs FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 280000 RETURN c.c_custkey AS c, count(o) AS n, max(o.o_totalprice) AS m",
        "SELECT c_custkey AS c, count(o_orderkey) AS n, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 280000 GROUP BY ALL"),
    "exists_pattern": ("MATCH (c:Customer) WHERE EXISTS((c)-[:PLACED]->(:Order {o_orderstatus: 'P'})) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "not_exists_pattern": ("MATCH (p:Part) WHERE NOT (p)<-[:CONTAINS]-(:Order {o_orderstatus: 'P'}) RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = p_partkey AND o_orderstatus = 'P')"),
    "exists_or": ("MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 290000 } OR c.c_acctbal < -900 RETURN c.c_custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 290000) OR c_acctbal < -900"),
    "agg_count": ("MATCH (c:Customer) RETURN count(*) AS n, count(c.c_nationkey) AS k", "SELECT count(*) AS n, count(c_nationkey) AS k FROM customer"),
    "agg_group": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_mktsegment AS s, o.o_orderstatus AS t, count(*) AS n, round(sum(o.o_totalprice), 2) AS total",
        "SELECT c_mktsegment AS s, o_orderstatus AS t, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL"),
    "agg_distinct": ("MATCH (o:Order)-[:CONTAINS]->(p:Part) RETURN p.p_brand AS b, count(DISTINCT o) AS orders, count(DISTINCT p) AS parts", "SELECT p_brand AS b, count(DISTINCT l_orderkey) AS orders, count(DISTINCT p_partkey) AS parts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL"),
    "agg_minmaxavg": ("MATCH (c:Customer) RETURN c.c_nationkey AS n, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi, round(avg(c.c_acctbal), 4) AS mean", "SELECT c_nationkey AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY ALL"),
    "agg_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, collect(n.n_name) AS names", "SELECT r_name AS r, list(n_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"),
    "agg_expr": ("MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) * 2 + 1 AS n, max(o.o_orderkey) - min(o.o_orderkey) AS span", "SELECT o_orderstatus AS s, count(*) * 2 + 1 AS n, max(o_orderkey) - min(o_orderkey) AS span FROM orders GROUP BY ALL"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n > 15 MATCH (c)-[:IN_NATION]->(x:Nation) RETURN x.n_name AS nation, count(*) AS busy",
        "SELECT n_name AS nation, count(*) AS busy FROM (SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING count(*) > 15) JOIN customer ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL"),
    "agg_avg_distinct": ("MATCH (p:Part) RETURN p.p_brand AS b, round(avg(DISTINCT p.p_size), 6) AS m, round(stdev(p.p_size), 6) AS s", "SELECT p_brand AS b, round(avg(DISTINCT p_size), 6) AS m, round(stddev_samp(p_size), 6) AS s FROM part GROUP BY ALL"),
    "temporal": ("MATCH (n:Region) RETURN n.r_name AS r, year(date('2024-02-29')) AS y, date('2024-02-29') < date('2024-03-01') AS before, duration('P1DT2H30M') AS seconds, time('12:30:05') AS t, point({x: 1, y: 2}).y AS py, toInteger('9007199254740993') AS big, date('no date') AS nothing",
        "SELECT r_name AS r, 2024 AS y, true AS before, 95400.0::DOUBLE AS seconds, '12:30:05.000000' AS t, 2.0::DOUBLE AS py, 9007199254740993::BIGINT AS big, NULL::DATE AS nothing FROM region"),
    "unwind": ("UNWIND [1, 2, 2, 3] AS x RETURN x, count(*) AS n", "SELECT x, count(*) AS n FROM (SELECT unnest([1, 2, 2, 3])::BIGINT AS x) GROUP BY ALL"),
    "var_len_1_3": ("MATCH (a:Embedding)-[:SIMILAR*1..3]->(b:Embedding) RETURN a.vec_id AS a, b.vec_id AS b", "{walks} SELECT a, b FROM d WHERE depth <= 3"),
    "var_len_exact2": ("MATCH (a:Embedding)-[:SIMILAR*2]->(b:Embedding) RETURN a.vec_id AS a, b.vec_id AS b", "{walks} SELECT a, b FROM d WHERE depth = 2"),
    "var_len_chain": ("MATCH (t:Turn {turn: 0})-[:NEXT*..4]->(u:Turn) RETURN t.conv_id AS c, u.turn AS turn", "SELECT conv_id AS c, turn FROM conversations c WHERE turn BETWEEN 1 AND 4 AND (SELECT count(*) FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn < c.turn AND d.turn >= 0) = c.turn"),
    "cypher_vector_similarity": ("MATCH (e:Embedding) WHERE vector_similarity(e.embedding, $q) > 0.25 RETURN e.vec_id AS v, round(vector_similarity(e.embedding, $q), 4) AS s",
        "SELECT e.vec_id AS v, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) > 0.25"),
    "hybrid_rerank": ("MATCH (a:Embedding {vec_id: 0})-[:SIMILAR*1..4]->(b:Embedding) RETURN b.vec_id AS v, round(b.embedding <-> $q, 4) AS d ORDER BY b.embedding <-> $q, v LIMIT 10",
        "WITH RECURSIVE s AS ({similar}), w(b, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN s ON src = b WHERE depth < 4), r AS (SELECT DISTINCT b FROM w WHERE b <> 0) SELECT vec_id AS v, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS d FROM r JOIN embeddings e ON vec_id = b, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), v LIMIT 10"),
}

SIMILAR = "SELECT vec_id AS src, (vec_id * 7 + 1) % n AS dst, 1.0 AS weight FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id <> (vec_id * 7 + 1) % n UNION ALL SELECT vec_id, (vec_id * 13 + 5) % n, 0.5 FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id <> (vec_id * 13 + 5) % n"
WALKS = "WITH RECURSIVE s AS ({similar}), w(a, b, depth) AS (SELECT vec_id, vec_id, 0 FROM embeddings UNION SELECT a, dst, depth + 1 FROM w JOIN s ON src = b WHERE depth < 3), d AS (SELECT a, b, min(depth) AS depth FROM w WHERE a <> b GROUP BY a, b)"


def _filled(sql: str) -> str:
    return sql.replace("{walks}", WALKS).replace("{similar}", SIMILAR)


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own among those that the cluster shares; it goes when the process ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/graphvec-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the shared folder's owner clears it
        pass


def probe(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == PROBE).select("embedding").first()
    return [float(x) for x in row[0]]


def cypher_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, _ = CYPHER[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        params = {"names": ["NATION_7", "NATION_8"], "least": 5000, "skip": 5, "limit": 7}
        if "$q" in text:
            params["q"] = probe(spark, sf_dir)
        return star_graph(spark, sf_dir).cypher(text, params)

    return run


# -- vectors -----------------------------------------------------------------------------------------------------------
def _points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 4).alias("score"))


def knn(metric: str, **options):
    def run(spark, sf_dir):
        where = F.col("label") == LABEL if options.get("filtered") else None
        return _rounded(K.knn(_points(spark, sf_dir), probe(spark, sf_dir), K_NEAREST, metric, where=where, score_threshold=options.get("threshold")), "id")

    return run


def knn_batch(spark, sf_dir):
    """Every row whose id is divisible by 50 against all rows."""
    points = _points(spark, sf_dir)
    return _rounded(K.knn_batch(points, points.filter("pmod(id, 50) = 0").select(F.col("id").alias("query_id"), "vector"), K_NEAREST), "query_id", "id", "rank")


def unit_cosine(spark, sf_dir):
    from .functions.distance import cosine_unit

    points = _points(spark, sf_dir)
    q = probe(spark, sf_dir)
    return points.select("id", F.round(cosine_unit("vector", q), 4).alias("score"))


def hybrid_knn_expand(spark, sf_dir):
    points = _points(spark, sf_dir)
    near = K.knn(points, probe(spark, sf_dir), K_NEAREST)
    edges = similar_edges(table(spark, sf_dir, "embeddings"))
    # the nearest are K_NEAREST rows: they are broadcast against the edges
    joined = edges.join(F.broadcast(near), F.col("src") == F.col("id"))
    return joined.select("id", F.round("score", 4).alias("score"), F.col("dst").alias("neighbour"), F.col("weight").cast("double").alias("weight"))


def sq8_roundtrip(spark, sf_dir):
    q = Q.sq8_quantize("vector")
    rows = _points(spark, sf_dir).select("id", F.col("vector").cast("array<double>").alias("v"), q.alias("q"))
    back = Q.sq8_dequantize(F.col("q"))
    return rows.select("id", F.aggregate("q.codes", F.lit(0), lambda a, c: a + c.cast("int")).cast("long").alias("code_sum"), F.round("q.scale", 6).alias("scale"), F.round(F.array_max(F.zip_with("v", back, lambda a, b: F.abs(a - b))), 4).alias("worst"))


def sq8_knn(spark, sf_dir):
    return _rounded(Q.sq8_knn(_points(spark, sf_dir), probe(spark, sf_dir), K_NEAREST), "id")


def pq_search(spark, sf_dir):
    points = _points(spark, sf_dir)
    pq = Q.ProductQuantizer.train(points, 8, 64)
    return pq.search_with_rerank(pq.encode(points), points, probe(spark, sf_dir), K_NEAREST, factor=20)


def ivf_knn(spark, sf_dir):
    """Half of the lists; the answers are near, so there is no SQL."""
    return InvertedLists.build(_points(spark, sf_dir), 16).search(probe(spark, sf_dir), K_NEAREST, probes=8)


def _changed_index(spark, sf_dir, **options) -> InvertedLists:
    """An index on disk that points were deleted from and added to."""
    points = _points(spark, sf_dir)
    index = InvertedLists.build(points, 16, **options).write(_scratch(spark, "index"))
    index = index.delete(points.filter("id % 7 = 3"))
    return index.insert(points.filter("id % 5 = 1").select((F.col("id") + 1_000_000).alias("id"), "vector"))


def ivf_all_lists(spark, sf_dir):
    """All lists of a changed index on disk: the exact answers."""
    return _rounded(_changed_index(spark, sf_dir).search(probe(spark, sf_dir), K_NEAREST, probes=16), "id")


def ivf_pq_rerank(spark, sf_dir):
    """All lists by product codes, as many ranked by their exact distance as there are points: the exact answers."""
    index = _changed_index(spark, sf_dir, parts=8)
    return _rounded(index.search_coded(probe(spark, sf_dir), K_NEAREST, probes=16, factor=index.ids().count()), "id")


def ivf_sizes(spark, sf_dir):
    index = _changed_index(spark, sf_dir)
    return index.sizes().agg(F.sum("n").alias("points"))


def pq_codes(spark, sf_dir):
    """Codes, and how far each decoded vector lies from its own: compression with its error."""
    points = _points(spark, sf_dir)
    pq = Q.ProductQuantizer.train(points, 8, 64)
    own = F.array(*[F.lit(float(x)) for x in probe(spark, sf_dir)])
    return pq.encode(points).select("id", "codes", F.round(pq.adc(F.col("codes"), probe(spark, sf_dir)), 6).alias("by_tables"), F.size(own).alias("size"))


# -- collections -------------------------------------------------------------------------------------------------------
def _collection(spark, sf_dir) -> Collection:
    docs = table(spark, sf_dir, "documents")
    points = docs.select(F.col("doc_id").alias("id"), F.array(F.col("n_chars").cast("float")).alias("vector"), F.array("source").alias("labels"), encode(lang=F.col("lang"), n_chars=F.col("n_chars")).alias("payload"))
    return Collection(CollectionConfig("documents", 1), points, spark.createDataFrame([], EDGES))


def get_points(spark, sf_dir):
    return _collection(spark, sf_dir).get_points([5, 3, 999_999_999, 7]).select("pos", "id", value("payload", "lang", "string").alias("lang"), value("payload", "n_chars", "long").alias("n_chars"))


def scroll_page(spark, sf_dir):
    return _collection(spark, sf_dir).scroll(10, 25).points.select("id", value("payload", "lang", "string").alias("lang"))


def scroll_next_offset(spark, sf_dir):
    return spark.createDataFrame([(_collection(spark, sf_dir).scroll(10, 25).next_offset,)], "next_offset long")


def ids_by_label(spark, sf_dir):
    return _collection(spark, sf_dir).point_ids("src3")


def neighbours(spark, sf_dir):
    edges = similar_edges(table(spark, sf_dir, "embeddings"))
    points = _points(spark, sf_dir)
    return Collection(CollectionConfig("e", 64), points, edges).neighbours(9, "SIMILAR", "both").select("neighbour", F.col("weight").cast("double").alias("weight"), "direction")


def upsert_merge(spark, sf_dir):
    base = _collection(spark, sf_dir)
    new = base.points.filter("id % 3 = 0").withColumn("labels", F.array(F.lit("new"))).unionByName(base.points.filter("id < 50").withColumn("id", F.col("id") + 10_000_000))
    out = base.upsert(new)
    return out.collection.points.select("id", F.col("labels")[0].alias("label")).withColumns({"inserted": F.lit(out.inserted).cast("long"), "updated": F.lit(out.updated).cast("long")})


def delete_anti(spark, sf_dir):
    base = _collection(spark, sf_dir)
    out, n = base.delete_points(base.points.filter("id % 7 = 0"))
    return out.points.select("id").withColumn("deleted", F.lit(n).cast("long"))


def import_merge(spark, sf_dir):
    base = _collection(spark, sf_dir)
    half = Collection(base.config, base.points.filter("id % 2 = 0"), base.edges)
    out, imported, skipped = import_collection(base, "merge", half)
    return out.points.groupBy(F.col("labels")[0].alias("label")).agg(F.count("*").alias("n")).withColumns({"imported": F.lit(imported).cast("long"), "skipped": F.lit(skipped).cast("long")})


def hot_cold(spark, sf_dir):
    points = _points(spark, sf_dir)
    hot = points.filter("id % 5 = 0").withColumn("label", F.lit(-1))
    return hot_over_cold(points, hot).select("id", "label")


def edge_dedupe(spark, sf_dir):
    edges = similar_edges(table(spark, sf_dir, "embeddings")).withColumn("seq", F.xxhash64("src", "dst", "weight"))
    base = Collection(CollectionConfig("e", 64), _points(spark, sf_dir), spark.createDataFrame([], EDGES))
    out = base.add_edges(edges.unionByName(edges.withColumn("seq", F.col("seq") + 1)).withColumn("dst", F.when(F.col("src") == 1, 999_999).otherwise(F.col("dst"))))
    return out.edges.groupBy("src").agg(F.count("*").alias("n"))


def event_log(spark, sf_dir) -> DataFrame:
    """The events as a mutation log: a click deletes its user's point, anything else upserts it; every 50th is aborted."""
    events = table(spark, sf_dir, "events")
    empty = F.lit(None)
    point = F.struct(F.col("user_id").alias("id"), F.array(F.col("value").cast("float")).alias("vector"), F.array("event_type").alias("labels"), F.map_from_arrays(F.array(F.lit("props")), F.array("props")).alias("payload"))
    drop = F.col("event_type") == "click"
    rows = events.select(F.col("event_id").alias("lsn"), F.when(drop, "delete").otherwise("upsert").alias("op"), F.when(drop, F.array("user_id")).alias("ids"), F.when(~drop, point).alias("point"), empty.alias("edge"), empty.alias("aborted_lsn"))
    aborts = events.filter("event_id % 50 = 0").select((F.col("event_id") + 1_000_000_000).alias("lsn"), F.lit("abort").alias("op"), empty.alias("ids"), empty.alias("point"), empty.alias("edge"), F.col("event_id").alias("aborted_lsn"))
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG]
    return rows.select(*typed).unionByName(aborts.select(*typed))


def wal_replay(spark, sf_dir):
    out = replay(spark, CollectionConfig("users", 1), event_log(spark, sf_dir))
    return out.points.select("id", F.col("labels")[0].alias("event_type"), F.round(F.col("vector")[0].cast("double"), 2).alias("value"))


def create_set_delete(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    g = g.execute("CREATE (n:Nation {id: 100, n_name: 'ATLANTIS', n_regionkey: 1})").graph
    g = g.execute("MATCH (n:Nation) WHERE n.n_regionkey = 2 SET n.n_name = toLower(n.n_name)").graph
    g = g.execute("MATCH (n:Nation) WHERE n.n_nationkey < 3 DETACH DELETE n").graph
    return g.cypher("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name")


def cypher_after(*changes: str, ask: str):
    """Mutations one after the other, then a query on what they leave."""

    def run(spark, sf_dir):
        g = star_graph(spark, sf_dir)
        for text in changes:
            g = g.execute(text).graph
        return g.cypher(ask)

    return run


def _embedded(spark, sf_dir) -> Collection:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.array().cast("array<string>").alias("labels"), encode(label=F.col("label")).alias("payload"))
    return Collection(CollectionConfig("e", 64), points, _similar(spark, sf_dir))


def payload_filter(spark, sf_dir):
    return _rounded(_embedded(spark, sf_dir).search(probe(spark, sf_dir), K_NEAREST, where={"must": {"label": LABEL}}), "id")


def payload_must_not(spark, sf_dir):
    return _rounded(_embedded(spark, sf_dir).search(probe(spark, sf_dir), K_NEAREST, where={"must_not": {"label": LABEL}}), "id")


def query_nearest(spark, sf_dir):
    return _rounded(_embedded(spark, sf_dir).query({"nearest": PROBE}, K_NEAREST), "id")


def get_edges(spark, sf_dir):
    return _embedded(spark, sf_dir).get_edges(9).select("dst", "relation", F.col("weight").cast("double").alias("weight"))


def remove_edge(spark, sf_dir):
    left = _embedded(spark, sf_dir).remove_edge(0, 1, "SIMILAR").remove_edge(1, 8).edges
    return left.groupBy("src").agg(F.count("*").alias("n"))


def export_load(spark, sf_dir):
    path = _scratch(spark, "export")
    export_collection(_embedded(spark, sf_dir), path)
    back = load_collection(spark, path)
    return back.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges")).join(back.points, "id", "right").select("id", F.coalesce("edges", F.lit(0)).alias("edges"), value("payload", "label", "long").alias("label"))


def import_create(spark, sf_dir):
    out, imported, skipped = import_collection(_collection(spark, sf_dir), "create")
    return out.points.agg(F.count("*").alias("n")).withColumns({"imported": F.lit(imported).cast("long"), "skipped": F.lit(skipped).cast("long")})


def import_replace(spark, sf_dir):
    base = _collection(spark, sf_dir)
    small = Collection(base.config, base.points.filter("id % 4 = 0"), base.edges)
    out, imported, skipped = import_collection(small, "replace", base)
    return out.points.agg(F.count("*").alias("n")).withColumns({"imported": F.lit(imported).cast("long"), "skipped": F.lit(skipped).cast("long")})


def durable_log(spark, sf_dir):
    """Points logged, some replaced, some deleted, edges added and removed; one snapshot in between."""
    base = _embedded(spark, sf_dir)
    store = DurableCollection(LogSink(spark, base.config, _scratch(spark, "log")))
    store.upsert(base.points)
    store.add_edges(base.edges)
    store.checkpoint()
    store.upsert(base.points.filter("id % 4 = 0").withColumn("payload", encode(label=F.lit(-1))))
    store.delete(base.points.filter("id % 10 = 3").select("id"))
    out = store.remove_edges(base.edges.filter("src % 2 = 0"))
    degree = out.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"))
    return out.points.join(degree, "id", "left").select("id", value("payload", "label", "long").alias("label"), F.coalesce("edges", F.lit(0)).alias("edges"))


def page_points(spark, sf_dir):
    """Web pages without their markup, as an upsert would take them."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.length("html") > F.length(strip_html("html"))).alias("shorter"), F.contains(strip_html("html"), F.lit("<script")).alias("marked"))


# -- traversal ---------------------------------------------------------------------------------------------------------
def _similar(spark, sf_dir) -> DataFrame:
    return similar_edges(table(spark, sf_dir, "embeddings"))


def traverse_depth(spark, sf_dir):
    return T.traverse(_similar(spark, sf_dir), 0, 4).select("target_id", "depth", F.size("path").alias("nodes"))


def traverse_relations(spark, sf_dir):
    edges = _similar(spark, sf_dir).withColumn("relation", F.when(F.col("weight") == 1, "strong").otherwise("weak"))
    return T.traverse(edges, 0, 5, ["strong"]).select("target_id", "depth", "relation")


def bfs_levels(spark, sf_dir):
    return T.bfs(_similar(spark, sf_dir), 0, 6).groupBy("depth").agg(F.count("*").alias("n"))


def shortest_path(spark, sf_dir):
    return T.shortest_paths(_similar(spark, sf_dir), 0).select("node", F.round("cost", 4).alias("cost"))


def path_weight(spark, sf_dir):
    """Total weight of the path to each node within four steps of 0."""
    edges = _similar(spark, sf_dir)
    found = T.path_weight(T.traverse(edges, 0, 4).select("path"), edges)
    return found.select(F.element_at("path", -1).alias("target_id"), F.array_join("path", "-").alias("path"), F.col("total_weight").cast("double").alias("total_weight"))


def dfs_reached(spark, sf_dir):
    """All that depth first meets from 0, which is what breadth first meets, each node at a position of its own."""
    return T.dfs(_similar(spark, sf_dir), 0).agg(F.count("*").alias("nodes"), F.count_distinct("node").alias("distinct_nodes"), F.max("position").cast("long").alias("last"))


VECTOR_SQL = {m: f for m, f in (("cosine", "1 - list_cosine_similarity({a}, {b})"), ("euclid", "list_distance({a}, {b})"), ("dot", "-list_inner_product({a}, {b})"))}


def _knn_sql(metric: str, where: str = "", threshold: float | None = None) -> str:
    d = VECTOR_SQL[metric].format(a="e.embedding::DOUBLE[]", b="q.embedding::DOUBLE[]")
    inner = f"SELECT e.vec_id AS id, {d} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {PROBE}) q {where} ORDER BY s, id LIMIT {K_NEAREST}"
    return f"SELECT id, round(s, 4) AS score FROM ({inner}){'' if threshold is None else f' WHERE s <= {threshold}'}"


def _changed_sql() -> str:
    """The nearest of the points without every seventh, and with copies of every fifth."""
    d = VECTOR_SQL["cosine"].format(a="e.v", b="q.embedding::DOUBLE[]")
    rows = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 7 <> 3 UNION ALL SELECT vec_id + 1000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 5 = 1"
    return f"SELECT id, round(s, 4) AS score FROM (SELECT e.id, {d} AS s FROM ({rows}) e, (SELECT embedding FROM embeddings WHERE vec_id = {PROBE}) q ORDER BY s, id LIMIT {K_NEAREST})"


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "knn_cosine": (knn("cosine"), _knn_sql("cosine")),
    "knn_euclid": (knn("euclid"), _knn_sql("euclid")),
    "knn_dot": (knn("dot"), _knn_sql("dot")),
    "knn_threshold": (knn("cosine", threshold=0.68), _knn_sql("cosine", threshold=0.68)),
    "knn_filtered": (knn("cosine", filtered=True), _knn_sql("cosine", f"WHERE e.label = {LABEL}")),
    "knn_batch": (knn_batch, f"SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {VECTOR_SQL['cosine'].format(a='e.embedding::DOUBLE[]', b='q.embedding::DOUBLE[]')}, e.vec_id)::INTEGER AS rank, round({VECTOR_SQL['cosine'].format(a='e.embedding::DOUBLE[]', b='q.embedding::DOUBLE[]')}, 4) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= {K_NEAREST}"),
    "unit_cosine": (unit_cosine, "SELECT e.vec_id AS id, round(1 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"),
    "hybrid_knn_expand": (hybrid_knn_expand, f"WITH s AS ({SIMILAR}), k AS ({_knn_sql('cosine')}) SELECT id, score, dst AS neighbour, weight::DOUBLE AS weight FROM k JOIN s ON src = id"),
    "sq8_roundtrip": (sq8_roundtrip, """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT id, v, list_min(v) AS lo, (list_max(v) - list_min(v)) / 255.0 AS s FROM e),
        c AS (SELECT id, v, lo, s, list_transform(v, lambda x: least(greatest(round((x - lo) / s), 0), 255)::INTEGER - 128) AS q FROM m)
        SELECT id, list_sum(q)::BIGINT AS code_sum, round(s, 6) AS scale, round(list_max(list_transform(list_zip(v, q), lambda p: abs(p[1] - ((p[2] + 128.0::DOUBLE) * s + lo)))), 4) AS worst FROM c"""),
    "sq8_knn": (sq8_knn, f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT id, v, list_min(v) AS lo, (list_max(v) - list_min(v)) / 255.0 AS s FROM e),
        c AS (SELECT id, list_transform(v, lambda x: (least(greatest(round((x - lo) / s), 0), 255)::INTEGER)::DOUBLE * s + lo) AS d FROM m)
        SELECT id, round(x, 4) AS score FROM (SELECT c.id, 1 - list_cosine_similarity(c.d, q.v) AS x FROM c, (SELECT v FROM e WHERE id = {PROBE}) q ORDER BY x, c.id LIMIT {K_NEAREST})"""),
    "pq_search": (pq_search, None),
    "ivf_knn": (ivf_knn, None),
    "get_points": (get_points, "SELECT p.pos::INTEGER AS pos, doc_id AS id, lang, n_chars FROM documents JOIN (VALUES (0, 5), (1, 3), (2, 999999999), (3, 7)) p(pos, id) ON doc_id = p.id"),
    "scroll_page": (scroll_page, "SELECT doc_id AS id, lang FROM documents WHERE doc_id > 25 ORDER BY doc_id LIMIT 10"),
    "scroll_next_offset": (scroll_next_offset, "SELECT max(doc_id) AS next_offset FROM (SELECT doc_id FROM documents WHERE doc_id > 25 ORDER BY doc_id LIMIT 10)"),
    "ids_by_label": (ids_by_label, "SELECT doc_id AS id FROM documents WHERE source = 'src3'"),
    "neighbours": (neighbours, f"WITH s AS ({SIMILAR}) SELECT dst AS neighbour, weight::DOUBLE AS weight, 'out' AS direction FROM s WHERE src = 9 UNION ALL SELECT src, weight::DOUBLE, 'in' FROM s WHERE dst = 9"),
    "upsert_merge": (upsert_merge, "SELECT *, (SELECT count(*) FROM documents WHERE doc_id < 50) AS inserted, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS updated FROM (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS label FROM documents UNION ALL SELECT doc_id + 10000000, source FROM documents WHERE doc_id < 50)"),
    "delete_anti": (delete_anti, "SELECT doc_id AS id, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS deleted FROM documents WHERE doc_id % 7 <> 0"),
    "import_merge": (import_merge, "SELECT source AS label, count(*) AS n, (SELECT count(*) FROM documents WHERE doc_id % 2 = 1) AS imported, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS skipped FROM documents GROUP BY source"),
    "hot_cold": (hot_cold, "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label FROM embeddings"),
    "edge_dedupe": (edge_dedupe, f"WITH s AS ({SIMILAR}) SELECT src, count(DISTINCT dst) AS n FROM s WHERE src <> 1 GROUP BY src"),
    "wal_replay": (wal_replay, "SELECT user_id AS id, event_type, round(value::FLOAT::DOUBLE, 2) AS value FROM (SELECT * FROM events WHERE event_id % 50 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'click'"),
    "create_set_delete": (create_set_delete, "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS name FROM nation WHERE n_nationkey >= 3 UNION ALL SELECT 100, 'ATLANTIS'"),
    "traverse_depth": (traverse_depth, f"WITH RECURSIVE s AS ({SIMILAR}), w(b, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN s ON src = b WHERE depth < 4) SELECT b AS target_id, min(depth)::INTEGER AS depth, min(depth)::INTEGER + 1 AS nodes FROM w WHERE b <> 0 GROUP BY b"),
    "traverse_relations": (traverse_relations, f"WITH RECURSIVE s AS (SELECT * FROM ({SIMILAR}) WHERE weight = 1), w(b, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN s ON src = b WHERE depth < 5) SELECT b AS target_id, min(depth)::INTEGER AS depth, 'strong' AS relation FROM w WHERE b <> 0 GROUP BY b"),
    "bfs_levels": (bfs_levels, f"WITH RECURSIVE s AS ({SIMILAR}), w(b, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN s ON src = b WHERE depth < 6) SELECT depth, count(*) AS n FROM (SELECT b, min(depth)::INTEGER AS depth FROM w GROUP BY b) GROUP BY depth"),
    # costs are multiples of a half below 64, so (node, cost) has few states; no shortest path of these graphs costs as much
    "shortest_path": (shortest_path, f"WITH RECURSIVE s AS ({SIMILAR}), w(b, cost) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT dst, cost + weight::DOUBLE FROM w JOIN s ON src = b WHERE cost < 24) SELECT b AS node, round(min(cost), 4) AS cost FROM w GROUP BY b"),
    "path_weight": (path_weight, f"""WITH RECURSIVE s AS ({SIMILAR}), w(b, depth, path, total) AS (SELECT 0::BIGINT, 0, [0::BIGINT], 0.0::DOUBLE UNION ALL SELECT dst, depth + 1, list_append(path, dst), total + (SELECT min(weight) FROM s x WHERE x.src = b AND x.dst = s.dst)::DOUBLE FROM w JOIN s ON src = b WHERE depth < 4 AND dst <> 0),
        f AS (SELECT DISTINCT * FROM w WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY b ORDER BY depth, path) = 1) SELECT b AS target_id, array_to_string(path, '-') AS path, total AS total_weight FROM f"""),
    "dfs_reached": (dfs_reached, f"WITH RECURSIVE s AS ({SIMILAR}), w(b) AS (SELECT 0::BIGINT UNION SELECT dst FROM w JOIN s ON src = b) SELECT count(*) AS nodes, count(*) AS distinct_nodes, count(*) - 1 AS last FROM w"),
    "ivf_all_lists": (ivf_all_lists, _changed_sql()),
    "ivf_pq_rerank": (ivf_pq_rerank, _changed_sql()),
    "ivf_sizes": (ivf_sizes, "SELECT sum(CASE WHEN vec_id % 7 <> 3 THEN 1 ELSE 0 END + CASE WHEN vec_id % 5 = 1 THEN 1 ELSE 0 END)::BIGINT AS points FROM embeddings"),
    "pq_codes": (pq_codes, None),
    "payload_filter": (payload_filter, _knn_sql("cosine", f"WHERE e.label = {LABEL}")),
    "payload_must_not": (payload_must_not, _knn_sql("cosine", f"WHERE e.label <> {LABEL}")),
    "query_nearest": (query_nearest, _knn_sql("cosine", f"WHERE e.vec_id <> {PROBE}")),
    "get_edges": (get_edges, f"SELECT dst, 'SIMILAR' AS relation, weight::DOUBLE AS weight FROM ({SIMILAR}) WHERE src = 9"),
    "remove_edge": (remove_edge, f"SELECT src, count(*) AS n FROM ({SIMILAR}) WHERE NOT (src = 0 AND dst = 1) AND NOT (src = 1 AND dst = 8) GROUP BY src"),
    "export_load": (export_load, f"WITH s AS ({SIMILAR}) SELECT vec_id AS id, (SELECT count(*) FROM s WHERE src = vec_id) AS edges, label::BIGINT AS label FROM embeddings"),
    "import_create": (import_create, "SELECT count(*) AS n, count(*) AS imported, 0::BIGINT AS skipped FROM documents"),
    "import_replace": (import_replace, "SELECT count(*) AS n, count(*) AS imported, 0::BIGINT AS skipped FROM documents WHERE doc_id % 4 = 0"),
    "durable_log": (durable_log, f"WITH s AS ({SIMILAR}) SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END::BIGINT AS label, (SELECT count(DISTINCT dst) FROM s WHERE src = vec_id AND src % 2 = 1) AS edges FROM embeddings WHERE vec_id % 10 <> 3"),
    "page_points": (page_points, "SELECT page_id AS id, true AS shorter, false AS marked FROM pages"),
    "create_relationship": (cypher_after("MATCH (a:Region {r_regionkey: 0}), (b:Nation {n_regionkey: 1}) CREATE (a)-[:TRADES {weight: 2.5}]->(b)", ask="MATCH (a:Region)-[t:TRADES]->(b:Nation) RETURN a.r_name AS a, b.n_name AS b, t.weight AS w"), "SELECT r_name AS a, n_name AS b, 2.5::DOUBLE AS w FROM region, nation WHERE r_regionkey = 0 AND n_regionkey = 1"),
    "create_chain": (cypher_after("CREATE (a:Nation {id: 200, n_name: 'OVER'})-[:NEAR]->(b:Nation {id: 201, n_name: 'YONDER'}), (c:Nation {id: 202, n_name: 'ALONE'})", ask="MATCH (a:Nation) WHERE a.id >= 200 OPTIONAL MATCH (a)-[:NEAR]->(b:Nation) RETURN a.n_name AS a, b.n_name AS b"), "SELECT * FROM (VALUES ('OVER', 'YONDER'), ('YONDER', NULL), ('ALONE', NULL)) t(a, b)"),
    "delete_relationship": (cypher_after("MATCH (n:Nation)-[r:IN_REGION]->(x:Region) WHERE x.r_regionkey < 2 DELETE r", ask="MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_REGION]->(x:Region) RETURN n.n_name AS n, x.r_name AS r"), "SELECT n_name AS n, r_name AS r FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey >= 2"),
    "set_map": (cypher_after("MATCH (n:Nation) WHERE n.n_regionkey = 2 SET n += {n_name: 'CHANGED'}", "MATCH (n:Nation) WHERE n.n_regionkey = 3 SET n = {n_name: 'ONLY'}", ask="MATCH (n:Nation) RETURN n.id AS id, n.n_name AS name, n.n_regionkey AS r"), "SELECT n_nationkey::BIGINT AS id, CASE n_regionkey WHEN 2 THEN 'CHANGED' WHEN 3 THEN 'ONLY' ELSE n_name END AS name, CASE WHEN n_regionkey <> 3 THEN n_regionkey END AS r FROM nation"),
    "set_label": (cypher_after("MATCH (n:Nation) WHERE n.n_regionkey = 1 SET n:Coastal", ask="MATCH (n:Coastal) RETURN n.n_name AS name"), "SELECT n_name AS name FROM nation WHERE n_regionkey = 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: cypher_query(name) for name in CYPHER} | {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _filled(sql) for name, (_, sql) in CYPHER.items()} | {name: sql for name, (_, sql) in QUERIES.items() if sql}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the nearest vectors of one, and the neighbours that they are linked to."""
    return hybrid_knn_expand(spark, sf_dir)


__all__ = ["distance", "entry", "oracle_sql", "queries"]
