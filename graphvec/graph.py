"""Property graphs over DataFrames: a table for each node label, a table for each kind of edge."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import table


@dataclass(frozen=True)
class NodeTable:
    """Nodes with one main label. `key` names the id column; `labels`, if given, an array column of all labels of a row.
    `rows` is a DataFrame, or a function that makes it when a query first needs it."""

    label: str
    rows: DataFrame | Callable[[], DataFrame]
    key: str = "id"
    labels: str | None = None

    @cached_property
    def df(self) -> DataFrame:
        return self.rows() if callable(self.rows) else self.rows

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c != self.labels]


@dataclass(frozen=True)
class EdgeTable:
    """Edges of one relation (or, if that is empty, of several told apart by the column `relation`) between two labels; other
    columns are properties. Columns src and dst hold the keys. `rows` as for nodes."""

    src_label: str
    relation: str
    dst_label: str
    rows: DataFrame | Callable[[], DataFrame]

    @cached_property
    def df(self) -> DataFrame:
        return self.rows() if callable(self.rows) else self.rows

    @property
    def mixed(self) -> bool:
        return not self.relation

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("src", "dst", "relation")]


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    nodes: Mapping[str, NodeTable] = field(default_factory=dict)
    edges: tuple[EdgeTable, ...] = ()

    def with_node(self, node: NodeTable) -> PropertyGraph:
        return replace(self, nodes={**self.nodes, node.label: node})

    def with_edge(self, edge: EdgeTable) -> PropertyGraph:
        return replace(self, edges=(*self.edges, edge))

    def cypher(self, text: str, params: Mapping | None = None, **options) -> DataFrame:
        """The rows that a query returns. Mutating queries: see execute."""
        return self.execute(text, params, **options).rows

    def execute(self, text: str, params: Mapping | None = None, **options):
        from .plans.compiler import Compiler

        return Compiler(self, params or {}, **options).run(text)

    def explain(self, text: str, params: Mapping | None = None) -> str:
        """The logical plan as an indented tree, the last step first."""
        from .plans.compiler import Compiler

        steps = Compiler(self, params or {}).run(text).plan
        return "\n".join("  " * i + s for i, s in enumerate(reversed(steps)))

    @staticmethod
    def validate(text: str) -> None:
        """Raise CypherError if the text can't be parsed."""
        from .plans.syntax import parse

        parse(text)


def similar_edges(embeddings: DataFrame) -> DataFrame:
    """src, dst, relation, weight: v to (7v + 1) mod N with weight 1 and to (13v + 5) mod N with 0.5, no loops."""
    n = embeddings.agg(F.count("*").alias("n"))
    v = embeddings.select("vec_id").join(F.broadcast(n))

    def to(a: int, b: int, relation: str, weight: float) -> DataFrame:
        dst: Column = (F.col("vec_id") * a + b) % F.col("n")
        return v.select(F.col("vec_id").alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.lit(weight).cast("float").alias("weight"))

    return to(7, 1, "SIMILAR", 1.0).unionByName(to(13, 5, "SIMILAR", 0.5)).filter("src <> dst")


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of the star-schema tables: nodes by table, edges by foreign key. A table is opened when a query needs it."""
    t = cache(lambda name: table(spark, sf_dir, name))
    graph = PropertyGraph(spark)
    plain = {
        "Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"),
        "Order": ("orders", "o_orderkey"), "Embedding": ("embeddings", "vec_id"), "Page": ("pages", "page_id"),
    }
    for label, (name, key) in plain.items():
        graph = graph.with_node(NodeTable(label, lambda name=name: t(name), key))

    def turns() -> DataFrame:
        return t("conversations").withColumn("turn_id", F.col("conv_id") * 1_000_000 + F.col("turn"))

    def follows() -> DataFrame:
        ids = turns().select("turn_id")
        return ids.select(F.col("turn_id").alias("src"), (F.col("turn_id") + 1).alias("dst")).join(ids.select(F.col("turn_id").alias("dst")), "dst", "left_semi").select("src", "dst")

    def party() -> DataFrame:
        vip = F.when(F.col("c_acctbal") > 5000, F.array(F.lit("Party"), F.lit("Vip"))).otherwise(F.array(F.lit("Party")))
        return t("customer").withColumn("labels", vip)

    graph = graph.with_node(NodeTable("Document", lambda: t("documents").join(t("labels"), "doc_id", "left"), "doc_id"))
    graph = graph.with_node(NodeTable("User", lambda: t("events").select("user_id").distinct(), "user_id"))
    graph = graph.with_node(NodeTable("Turn", turns, "turn_id"))
    graph = graph.with_node(NodeTable("Party", party, "c_custkey", "labels"))

    def edge(src: str, relation: str, dst: str, name: str, a: str, b: str, *props: str, distinct: bool = False) -> EdgeTable:
        def rows() -> DataFrame:
            found = t(name).select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"), *props)
            return found.distinct() if distinct else found

        return EdgeTable(src, relation, dst, rows)

    line = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    for e in (
        edge("Nation", "IN_REGION", "Region", "nation", "n_nationkey", "n_regionkey"),
        edge("Customer", "IN_NATION", "Nation", "customer", "c_custkey", "c_nationkey"),
        edge("Supplier", "IN_NATION", "Nation", "supplier", "s_suppkey", "s_nationkey"),
        edge("Customer", "PLACED", "Order", "orders", "o_custkey", "o_orderkey"),
        edge("Order", "CONTAINS", "Part", "lineitem", "l_orderkey", "l_partkey", *line),
        edge("Supplier", "SUPPLIES", "Part", "lineitem", "l_suppkey", "l_partkey", distinct=True),
        EdgeTable("Embedding", "SIMILAR", "Embedding", lambda: similar_edges(t("embeddings"))),
        EdgeTable("Turn", "NEXT", "Turn", follows),
    ):
        graph = graph.with_edge(e)
    return graph
