"""Queries to DataFrames. Every clause turns the rows so far, a DataFrame with columns such as `n.name`, into the next ones;
Catalyst sees ordinary scans, joins and aggregates, and only the properties that a query names are read.

Semantics follow openCypher: three-valued logic, projection before DISTINCT, ORDER BY, SKIP and LIMIT, aliases in ORDER BY,
directions honoured. Variable-length steps take each node once, at its least depth, never the source (path_mode="bfs"), or
enumerate paths without a repeated edge (path_mode="trail"). compat=True gives two-valued logic over truthiness, structural
equality, NULL as the lowest value, and one row for each source and target of a step.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distance import cosine
from ..functions.registry import AGGREGATE, SCALAR
from ..graph import EdgeTable, NodeTable, PropertyGraph
from ..operators.traversal import expand_levels
from ..runtime import checkpointed
from .syntax import (
    MAX_PARAMETERS, Binary, Call, Case, Create, CypherError, Delete, Exists, Index, ListOf, Literal, MapOf, Match, NodePattern, Param, Pattern, Projection, Prop, RelPattern, SetProps, Star, Unary, Unwind, Var, parse, walk,
)

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Aggregates that can be taken from distinct rows and the number of each.
WEIGHED = ("count", "min", "max")


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Binding:
    """What a variable stands for: node (its labels and property columns), rel, or value (one column)."""

    kind: str
    name: str
    labels: tuple[str, ...] = ()
    props: tuple[str, ...] = ()

    def columns(self) -> list[str]:
        if self.kind == "value":
            return [self.name]
        own = ("__id", "__label", "__labels") if self.kind == "node" else ("__src", "__dst", "__type")
        return [f"{self.name}.{c}" for c in (*own, *self.props)]

    def identity(self) -> list[str]:
        return {"node": [f"{self.name}.__id", f"{self.name}.__label"], "rel": [f"{self.name}.__src", f"{self.name}.__dst", f"{self.name}.__type"], "value": [self.name]}[self.kind]


@dataclass
class Stats:
    nodes_created: int = 0
    relationships_created: int = 0
    nodes_deleted: int = 0
    relationships_deleted: int = 0
    properties_set: int = 0
    labels_added: int = 0


@dataclass
class Result:
    rows: DataFrame
    graph: PropertyGraph
    plan: list[str]
    stats: Stats = field(default_factory=Stats)

    @property
    def columns(self) -> list[str]:
        return self.rows.columns


class Compiler:
    def __init__(self, graph: PropertyGraph, params: Mapping[str, Any], compat: bool = False, path_mode: str = "bfs"):
        if len(params) > MAX_PARAMETERS:
            raise CypherError(f"more than {MAX_PARAMETERS} parameters")
        if path_mode not in ("bfs", "trail"):
            raise CypherError(f"unknown path mode {path_mode!r}")
        self.graph, self.params, self.compat, self.path_mode = graph, params, compat, path_mode
        self.stored: dict[str, DataFrame] = {}
        self.spark = graph.spark
        self.plan: list[str] = []
        self.fresh = 0
        self.weight: str | None = None  # the column that says how many rows a row stands for
        self.waiting: list = []  # conjuncts of WHERE that are not applied yet
        self.stats = Stats()

    # -- a whole query ---------------------------------------------------------------------------------------------------
    def run(self, text: str) -> Result:
        query = parse(text)
        self.used = {x.name for x in walk(query.clauses) if isinstance(x, Prop)}
        self.used |= {name for x in walk(query.clauses) if isinstance(x, (NodePattern, RelPattern)) for name, _ in x.props}
        self.all_props = any(isinstance(x, Call) and x.name in ("properties", "keys") for x in walk(query.clauses))
        df, env = None, {}
        clauses = list(query.clauses)
        for i, clause in enumerate(clauses):
            if isinstance(clause, Match):
                df, env = self.optional(df, env, clause) if clause.optional else self.match(df, env, clause, self.later(clauses, i, env))
            elif isinstance(clause, Unwind):
                df, env = self.unwind(df, env, clause)
            elif isinstance(clause, Projection):
                df, env = self.project(self.one_row() if df is None else df, env, clause)
            elif isinstance(clause, Create):
                df, env = self.create(df, env, clause)
            elif isinstance(clause, SetProps):
                self.set_props(df, env, clause)
            elif isinstance(clause, Delete):
                self.delete(df, env, clause)
        return Result(self.one_row().limit(0).drop("__one") if df is None else df, self.graph, self.plan, self.stats)

    def one_row(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(1).alias("__one"))

    def name(self) -> str:
        self.fresh += 1
        return f"__anon{self.fresh}"

    # -- scans -----------------------------------------------------------------------------------------------------------
    def tables(self, labels: tuple[str, ...], only: set[str] | None = None) -> list[NodeTable]:
        """Node tables that may hold nodes with all these labels."""
        return [t for t in self.graph.nodes.values() if (only is None or t.label in only) and (t.labels or all(x == t.label for x in labels))]

    def scan(self, var: str, labels: tuple[str, ...], only: set[str] | None = None) -> tuple[DataFrame, Binding]:
        found = self.tables(labels, only)
        wanted = sorted({p for t in found for p in t.props if self.all_props or p in self.used})
        kinds = {p: {dict(t.df.dtypes)[p] for t in found if p in t.props} for p in wanted}
        parts = []
        for t in found:
            marks = F.col(t.labels) if t.labels else F.array(F.lit(t.label))
            rows = t.df
            for x in labels:
                if x != t.label:
                    rows = rows.filter(F.array_contains(marks, x))
            props = [(F.col(p) if len(kinds[p]) == 1 else F.col(p).cast("string")).alias(f"{var}.{p}") for p in wanted if p in t.props]
            missing = [F.lit(None).cast("string" if len(kinds[p]) > 1 else next(iter(kinds[p]))).alias(f"{var}.{p}") for p in wanted if p not in t.props]
            parts.append(rows.select(F.col(t.key).cast("long").alias(f"{var}.__id"), F.lit(t.label).alias(f"{var}.__label"), marks.alias(f"{var}.__labels"), *props, *missing))
        if not parts:
            return self.spark.createDataFrame([], f"`{var}.__id` long, `{var}.__label` string, `{var}.__labels` array<string>"), Binding("node", var)
        df = reduce(DataFrame.unionByName, parts)
        return df, Binding("node", var, tuple(t.label for t in found), tuple(wanted))

    # -- patterns --------------------------------------------------------------------------------------------------------
    def match(self, df, env, clause: Match, later: set[str] | None = None):
        """later: the names that what follows needs, if equal rows may be held as one with their number."""
        if later is not None:
            self.waiting = [clause.where] if self.compat else _conjuncts(clause.where)
        for i, pattern in enumerate(clause.patterns):
            df, env = self.path(df, env, pattern, None if later is None else later | _names(clause.patterns[i + 1 :]))
        if later is not None:
            waiting, self.waiting = self.waiting, []
            for x in waiting:
                df = df if x is None else self.where(df, env, x)
        elif clause.where is not None:
            df = self.where(df, env, clause.where)
        return df, env

    def later(self, clauses: list, i: int, env) -> set[str] | None:
        """The names that are used after clause i, if the projection that ends its rows gives the same for distinct rows and
        their numbers; else None. There, count(x) of a variable that is never null becomes count(*)."""
        j = next((j for j in range(i + 1, len(clauses)) if not isinstance(clauses[j], (Match, Unwind))), len(clauses))
        if j == len(clauses) or not isinstance(clauses[j], Projection):
            return None
        p, bound, sure = clauses[j], set(env), set()
        for c in clauses[i:j]:
            new = ({c.var} if isinstance(c, Unwind) else _names(c.patterns)) - bound
            bound |= new
            if isinstance(c, Match) and not c.optional:
                sure |= new
        for x in [x for x in walk((p.items, p.order)) if isinstance(x, Call) and x.name == "count" and not x.distinct and len(x.args) == 1 and isinstance(x.args[0], Var) and x.args[0].name in sure]:
            p = _swap(p, x, replace(x, args=(Star(),)))
        tree = (p.items, p.order)
        calls = [x for x in walk(tree) if isinstance(x, Call) and x.name in AGGREGATE]
        rows = [x for x in calls if x.args and isinstance(x.args[0], Star)]
        if sum(isinstance(x, Star) for x in walk(tree)) > len(rows) or not (calls or p.distinct) or any(x.name not in WEIGHED and not x.distinct and x not in rows for x in calls):
            return None
        clauses[j] = p
        return _names(clauses[i + 1 : j], tree, p.where)

    def fewer(self, df, env, live: set[str]):
        """Rows that differ only in what no name in `live` stands for become one row with their number, so that the next join
        doesn't multiply them. Conditions that can be tested are tested before."""
        ready = [x for x in self.waiting if x is not None and _names(x) <= set(env) and not any(isinstance(y, Exists) for y in walk(x))]
        for x in ready:
            df = self.where(df, env, x)
        self.waiting = [x for x in self.waiting if not any(x is y for y in ready)]
        live = live | _names(self.waiting)
        kept = {v: b for v, b in env.items() if v in live}
        keys = [c for b in kept.values() for c in b.columns()]
        if len(kept) == len(env) or not all(_groups(df.schema[c].dataType) for c in keys):
            return df, env
        count, self.weight = F.sum(col(self.weight)) if self.weight else F.count(F.lit(1)), self.name()
        self.plan.append(f"Count({', '.join(kept)})")
        df = df.groupBy(*map(col, keys)).agg(count.alias(self.weight))
        return df if keys else df.filter(col(self.weight) > 0), kept

    def where(self, df: DataFrame, env, condition) -> DataFrame:
        """Conjuncts one by one; existential ones become semi- or anti-joins."""
        if isinstance(condition, Binary) and condition.op == "AND" and not self.compat:
            return self.where(self.where(df, env, condition.a), env, condition.b)
        if isinstance(condition, Exists):
            return self.existing(df, env, condition, "left_semi")
        if isinstance(condition, Unary) and condition.op == "NOT" and isinstance(condition.x, Exists):
            return self.existing(df, env, condition.x, "left_anti")
        before = df.columns
        df, condition = self.flagged(df, env, condition)
        self.plan.append("Filter")
        return df.filter(self.truth(self.expr(df, env, condition), df)).select(*map(col, before))

    def existing(self, df, env, x: Exists, how: str) -> DataFrame:
        inner, keys = self.inner(df, env, x.pattern, x.where)
        self.plan.append(f"{'Semi' if how == 'left_semi' else 'Anti'}Join(pattern)")
        return self.join_on(df, inner.select(*map(col, keys)).distinct(), keys, how)

    def flagged(self, df, env, tree):
        """Patterns inside other expressions become columns that say whether one was found."""
        for x in [x for x in walk(tree) if isinstance(x, Exists)]:
            inner, keys = self.inner(df, env, x.pattern, x.where)
            flag = self.name()
            df = self.join_on(df, inner.select(*map(col, keys)).distinct().withColumn(flag, F.lit(True)), keys, "left")
            env[flag] = Binding("value", flag)
            tree = _swap(tree, x, Call("coalesce", (Var(flag), Literal(False))))
        return df, tree

    def inner(self, df, env, pattern: Pattern, where):
        """The pattern matched from the distinct values of the outer variables that it names."""
        named = {n.var for n in pattern.nodes} | {r.var for r in pattern.rels} | {x.name for x in walk((where, pattern)) if isinstance(x, Var)}
        outer = {v: b for v, b in env.items() if v in named}
        if not outer:
            raise CypherError("a pattern predicate names no variable that is bound")
        keys = [c for b in outer.values() for c in b.identity()]
        rows = df.select(*[col(c) for b in outer.values() for c in b.columns()]).dropDuplicates(keys)
        rows, found = self.path(rows, dict(outer), pattern)
        if where is not None:
            rows = self.where(rows, found, where)
        return rows, keys

    def join_on(self, left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
        renamed = right.select(*[col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[col(c) for c in right.columns if c not in keys])
        on = [col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]
        return left.join(renamed, on, how).drop(*[f"__r{i}" for i in range(len(keys))])

    def optional(self, df, env, clause: Match):
        if df is None:
            raise CypherError("OPTIONAL MATCH needs rows to extend")
        named = {n.var for p in clause.patterns for n in p.nodes} | {r.var for p in clause.patterns for r in p.rels} | {x.name for x in walk((clause.where, clause.patterns)) if isinstance(x, Var)}
        outer = {v: b for v, b in env.items() if v in named}
        keys = [c for b in outer.values() for c in b.identity()]
        rows = df.select(*[col(c) for b in outer.values() for c in b.columns()]).dropDuplicates(keys) if outer else None
        rows, found = self.match(rows, dict(outer), replace(clause, optional=False))
        new = {v: b for v, b in found.items() if v not in env}
        self.plan.append(f"OptionalExpand({', '.join(v for v in new if not v.startswith('__'))})")
        right = rows.select(*map(col, keys), *[col(c) for b in new.values() for c in b.columns()])
        df = self.join_on(df, right, keys, "left") if keys else df.join(right, F.lit(True), "left")
        return df, {**env, **new}

    def path(self, df, env, pattern: Pattern, later: set[str] | None = None):
        nodes, rels = list(pattern.nodes), list(pattern.rels)
        if rels and (nodes[0].var not in env) and (nodes[-1].var in env or (df is None and _weight(nodes[-1]) > _weight(nodes[0]))):
            # start from the bound end, or from the more selective one
            nodes, rels = nodes[::-1], [replace(r, direction={"out": "in", "in": "out"}.get(r.direction, "both")) for r in rels[::-1]]
        nodes = [n if n.var else replace(n, var=self.name()) for n in nodes]
        if later is not None and df is not None:
            df, env = self.fewer(df, env, later | _names(nodes, rels))
        df, env = self.start(df, env, nodes[0])
        for i, rel in enumerate(rels):
            if later is not None and i:
                df, env = self.fewer(df, env, later | _names(nodes[i:], rels[i:]))
            df, env = self.expand(df, env, nodes[i].var, rel, nodes[i + 1])
        return df, env

    def start(self, df, env, node: NodePattern):
        if node.var in env:
            return self.constrain(df, env, node), env
        rows, binding = self.scan(node.var, node.labels)
        self.plan.append(f"NodeByLabelScan({node.var}, :{':'.join(node.labels)})" if node.labels else f"AllNodesScan({node.var})")
        env = {**env, node.var: binding}
        rows = self.props(rows, env, node.var, node.props)
        if df is not None:
            self.plan.append("CartesianProduct")
            rows = df.crossJoin(rows)
        return rows, env

    def constrain(self, df, env, node: NodePattern) -> DataFrame:
        """Labels and properties of a node that is bound already."""
        if env[node.var].kind != "node":
            raise CypherError(f"{node.var} is not a node")
        for x in node.labels:
            df = df.filter(F.array_contains(col(f"{node.var}.__labels"), x) | (col(f"{node.var}.__label") == x))
        return self.props(df, env, node.var, node.props)

    def props(self, df, env, var: str, props) -> DataFrame:
        for name, value in props:
            df = df.filter(self.truth(self.expr(df, env, Binary("=", Prop(Var(var), name), value)), df))
        return df

    def edge_rows(self, types, direction: str, sources, targets, r: str | None, numbered: bool = False) -> tuple[DataFrame, tuple[str, ...], set[str]]:
        """__f, __fl, __t, __tl and the columns of r: edges of these types from these labels to those, as the arrow says.
        numbered: and __e, which tells edges apart, parallel ones too, and is the same whichever way an edge is turned."""
        found: list[tuple[EdgeTable, bool]] = []
        for e in self.graph.edges:
            if types and e.relation not in types and not e.mixed:
                continue
            for turned in {"out": (False,), "in": (True,), "both": (False, True)}[direction]:
                a, b = (e.dst_label, e.src_label) if turned else (e.src_label, e.dst_label)
                if a in sources and b in targets:
                    found.append((e, turned))
        wanted = sorted({p for e, _ in found for p in e.props if self.all_props or p in self.used}) if r else []
        kinds = {p: next(dict(e.df.dtypes)[p] for e, _ in found if p in e.props) for p in wanted}
        parts = []
        for e, turned in found:
            a, b = ("dst", "src") if turned else ("src", "dst")
            rows = self.numbered_edges(e) if numbered else e.df
            kind = F.col("relation") if e.mixed else F.lit(e.relation)
            if types and e.mixed:
                rows = rows.filter(kind.isin(list(types)))
            own = [F.col("src").alias(f"{r}.__src"), F.col("dst").alias(f"{r}.__dst"), kind.alias(f"{r}.__type")] if r else []
            props = [(F.col(p) if p in e.props else F.lit(None)).cast(kinds[p]).alias(f"{r}.{p}") for p in wanted]
            ends = (e.dst_label, e.src_label) if turned else (e.src_label, e.dst_label)
            parts.append(rows.select(F.col(a).alias("__f"), F.lit(ends[0]).alias("__fl"), F.col(b).alias("__t"), F.lit(ends[1]).alias("__tl"), *own, *props, *(["__e"] if numbered else [])))
        if not parts:
            own = f", `{r}.__src` long, `{r}.__dst` long, `{r}.__type` string" if r else ""
            return self.spark.createDataFrame([], f"__f long, __fl string, __t long, __tl string{own}{', __e string' if numbered else ''}"), (), set()
        return reduce(DataFrame.unionByName, parts), tuple(wanted), {(e.src_label if turned else e.dst_label) for e, turned in found}

    def numbered_edges(self, e: EdgeTable) -> DataFrame:
        """The edges of a table with a number each, stored once so that a number stays with its edge."""
        place = str(next(i for i, x in enumerate(self.graph.edges) if x is e))
        if place not in self.stored:
            rows = e.df.select("src", "dst", *(["relation"] if e.mixed else []))
            self.stored[place] = checkpointed(rows.withColumn("__e", F.concat_ws(":", F.lit(place), F.monotonically_increasing_id().cast("string"))))
        return self.stored[place]

    def expand(self, df, env, source: str, rel: RelPattern, node: NodePattern):
        sources = set(env[source].labels)
        bound = env.get(node.var)
        targets = set(bound.labels) if bound else {t.label for t in self.tables(node.labels)}
        r = rel.var or (self.name() if rel.props else None)
        arrow = {"out": ("-", "->"), "in": ("<-", "-"), "both": ("-", "-")}[rel.direction]
        hops = "" if rel.hops is None else f"*{rel.hops[0]}..{rel.hops[1]}"
        self.plan.append(f"Expand(({source}){arrow[0]}[{':' if rel.types else ''}{'|'.join(rel.types)}{hops}]{arrow[1]}({node.var}))")
        if rel.hops is not None:
            steps, reached = self.steps(df, env, source, rel, sources, targets, r)
            found = {r: Binding("value", r)} if r else {}
        else:
            steps, wanted, reached = self.edge_rows(rel.types, rel.direction, sources, targets, r)
            if self.compat:
                steps = steps.filter("__f <> __t or __fl <> __tl").dropDuplicates(["__f", "__fl", "__t", "__tl"])
            found = {r: Binding("rel", r, (), wanted)} if r else {}
        on = [col(f"{source}.__id") == F.col("__f")]
        if len(sources) > 1:
            on.append(col(f"{source}.__label") == F.col("__fl"))
        if bound:
            on += [col(f"{node.var}.__id") == F.col("__t"), col(f"{node.var}.__label") == F.col("__tl")]
        rows = df.join(steps, on)
        env = {**env, **found}
        if rel.hops is None:
            rows = self.props(rows, env, r, rel.props)
        if bound:
            return self.constrain(rows.drop("__f", "__fl", "__t", "__tl"), env, node), env
        there, binding = self.scan(node.var, node.labels, reached)
        env = {**env, node.var: binding}
        there = self.props(there, env, node.var, node.props)
        on = [F.col("__t") == col(f"{node.var}.__id")]
        if len(reached) > 1:
            on.append(F.col("__tl") == col(f"{node.var}.__label"))
        return rows.join(there, on).drop("__f", "__fl", "__t", "__tl"), env

    def steps(self, df, env, source, rel: RelPattern, sources, targets, r):
        """__f, __fl, __t, __tl (and the depth as r) of a variable-length step."""
        every = set(self.graph.nodes)
        edges, _, _ = self.edge_rows(rel.types, rel.direction, every, every, None, numbered=self.path_mode != "bfs")
        key = lambda i, l: F.struct(F.col(l).alias("l"), F.col(i).cast("long").alias("i"))
        links = edges.select(key("__f", "__fl").alias("src"), key("__t", "__tl").alias("dst"), *(["__e"] if "__e" in edges.columns else []))
        start = df.select(F.struct(col(f"{source}.__label").alias("l"), col(f"{source}.__id").alias("i")).alias("source")).distinct()
        low, high = rel.hops
        found = expand_levels(start, links, low, high) if self.path_mode == "bfs" else self.trails(start, links, low, high)
        depth = [F.col("depth").alias(r)] if r else []
        rows = found.select(F.col("source.i").alias("__f"), F.col("source.l").alias("__fl"), F.col("target.i").alias("__t"), F.col("target.l").alias("__tl"), *depth)
        reached = {e.dst_label for e in self.graph.edges if not rel.types or e.relation in rel.types or e.mixed}
        if rel.direction != "out":
            reached |= {e.src_label for e in self.graph.edges if not rel.types or e.relation in rel.types or e.mixed}
        reached &= targets
        return rows.filter(F.col("__tl").isin(sorted(reached))), reached

    def trails(self, start: DataFrame, links: DataFrame, low: int, high: int) -> DataFrame:
        """A row for each path of low to high edges without a repeated edge; a loop is one edge, whichever way it is taken."""
        now = start.select("source", F.col("source").alias("node"), F.array().cast("array<string>").alias("edges"))
        links = links.distinct()
        out = None
        for depth in range(1, high + 1):
            now = now.join(links, F.col("node") == F.col("src")).filter(~F.array_contains("edges", F.col("__e"))).select("source", F.col("dst").alias("node"), F.array_append("edges", F.col("__e")).alias("edges"))
            if depth < high:
                now = checkpointed(now)
                if now.isEmpty():
                    break
            if depth >= low:
                level = now.select("source", F.col("node").alias("target"), F.lit(depth).alias("depth"))
                out = level if out is None else out.unionByName(level)
        return now.select("source", F.col("node").alias("target"), F.lit(0).alias("depth")) if out is None else out

    # -- UNWIND and projections --------------------------------------------------------------------------------------------
    def unwind(self, df, env, clause: Unwind):
        df = self.one_row() if df is None else df
        self.plan.append(f"Unwind({clause.var})")
        rows = df.select(*map(col, df.columns), F.explode(self.expr(df, env, clause.expr)).alias(clause.var))
        return rows, {**env, clause.var: Binding("value", clause.var)}

    def header(self, item, i: int) -> str:
        if item.alias:
            return item.alias
        x = item.expr
        if isinstance(x, Var):
            return x.name
        if isinstance(x, Prop) and isinstance(x.base, Var):
            return f"{x.base.name}.{x.name}"
        return f"column_{i}"

    def project(self, df, env, p: Projection):
        items = []
        for item in p.items:
            if isinstance(item.expr, Star):
                items += [replace(item, expr=Var(v)) for v in env if not v.startswith("__")]
            else:
                items.append(item)
        df, exprs = self.flagged(df, env, tuple(i.expr for i in items))
        items = [replace(i, expr=x) for i, x in zip(items, exprs)]
        names = [self.header(item, i) for i, item in enumerate(items)]
        if len(set(names)) < len(names):
            raise CypherError(f"a column name is given twice: {names}")
        grouped = any(self.aggregates(i.expr) for i in items)
        out, columns, keys = {}, [], []
        for item, name in zip(items, names):
            if not p.final and isinstance(item.expr, Var) and item.expr.name in env and env[item.expr.name].kind != "value":
                # WITH keeps a node or a relationship with its columns
                old = env[item.expr.name]
                new = replace(old, name=name)
                pairs = list(zip(old.columns(), new.columns()))
                out[name] = new
            else:
                pairs, out[name] = None, Binding("value", name)
            cols = [col(a).alias(b) for a, b in pairs] if pairs else [self.expr(df, env, item.expr).alias(name)]
            columns += cols
            if grouped and not self.aggregates(item.expr):
                keys += cols
        order, hidden = [], []
        for x, down in p.order:
            same = next((n for n, item in zip(names, items) if item.expr == x or isinstance(x, Var) and x.name == n), None)
            if same is None and (grouped or p.distinct):
                key = self.expr(None, {**out}, _rename(x, items, names))
            elif same is None:
                h = self.name()
                hidden.append(self.expr(df, {**env}, _inline(x, items, names)).alias(h))
                key = col(h)
            else:
                key = col(same if out[same].kind == "value" else out[same].identity()[0])
            order.append(key.desc_nulls_last() if down else key.asc_nulls_first())
        if grouped:
            aggregates = [c for c, item in zip(columns, [i for i, n in zip(items, names) for _ in (out[n].columns() if out[n].kind != "value" else [n])]) if self.aggregates(item.expr)]
            self.plan.append(f"Aggregate({', '.join(names)})")
            rows = df.groupBy(*keys).agg(*aggregates)
            flat = [c for n in names for c in out[n].columns()]
            rows = rows.select(*map(col, flat))
        else:
            self.plan.append(f"Project({', '.join(names)})")
            rows = df.select(*columns, *hidden)
        if p.distinct:
            self.plan.append("Distinct")
            rows = rows.distinct()
        if order:
            self.plan.append("Sort")
            rows = rows.orderBy(*order)
        if p.skip is not None:
            self.plan.append(f"Skip({self.amount(p.skip)})")
            rows = rows.offset(self.amount(p.skip))
        if p.limit is not None:
            self.plan.append(f"Limit({self.amount(p.limit)})")
            rows = rows.limit(self.amount(p.limit))
        rows = rows.select(*[col(c) for n in names for c in out[n].columns()])
        self.weight = None
        if p.where is not None:
            rows = self.where(rows, out, p.where)
        return rows, out

    def amount(self, x) -> int:
        n = x.value if isinstance(x, Literal) else self.param(x.name)
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise CypherError("SKIP and LIMIT take integers that are not negative")
        return n

    # -- expressions -------------------------------------------------------------------------------------------------------
    def aggregates(self, x) -> bool:
        return any(isinstance(y, Call) and y.name in AGGREGATE for y in walk(x))

    def param(self, name: str):
        if name not in self.params:
            raise CypherError(f"parameter ${name} is missing")
        return self.params[name]

    def literal(self, v) -> Column:
        if isinstance(v, (list, tuple)):
            return F.array(*map(self.literal, v))
        if isinstance(v, dict):
            return F.struct(*[self.literal(x).alias(k) for k, x in v.items()])
        return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)

    def type(self, c: Column, df: DataFrame | None) -> T.DataType:
        return (self.one_row() if df is None else df).select(c.alias("x")).schema[0].dataType

    def truth(self, c: Column, df) -> Column:
        kind = self.type(c, df)
        if isinstance(kind, T.BooleanType):
            return c
        if isinstance(kind, NUMBERS):
            return c != 0
        if isinstance(kind, T.StringType):
            return F.length(c) > 0
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.size(c) > 0
        return F.lit(False) if isinstance(kind, T.NullType) else c.isNotNull()

    def expr(self, df, env, x) -> Column:
        match x:
            case Literal(value=v):
                return self.literal(v)
            case Param(name=name):
                return self.literal(self.param(name))
            case Var(name=name):
                if name not in env:
                    raise CypherError(f"variable {name} is not bound")
                b = env[name]
                return col({"node": f"{name}.__id", "value": name}.get(b.kind, "")) if b.kind != "rel" else F.struct(*[col(c).alias(c.split(".", 1)[1].removeprefix("__")) for c in b.columns()])
            case Prop(base=Var(name=name), name=prop) if name in env and env[name].kind != "value":
                return self.prop(env[name], prop, df)
            case Prop(base=base, name=prop):
                c = self.expr(df, env, base)
                kind = self.type(c, df)
                if isinstance(kind, T.StructType):
                    return c.getField(prop) if prop in kind.names else F.lit(None)
                if isinstance(kind, T.MapType):
                    return F.try_element_at(c, F.lit(prop))
                raise CypherError(f"{kind.simpleString()} has no properties")
            case ListOf(items=items):
                return F.array(*[self.expr(df, env, i) for i in items])
            case MapOf(items=items):
                return F.struct(*[self.expr(df, env, v).alias(k) for k, v in items])
            case Index(base=base, index=index):
                i, c = self.expr(df, env, index), self.expr(df, env, base)
                return F.get(c, F.when(i < 0, i + F.size(c)).otherwise(i).cast("int"))
            case Unary(op=op, x=y):
                c = self.expr(df, env, y)
                if op == "-":
                    return -c
                if op == "NOT":
                    return ~self.logic(c, df)
                return c.isNull() if op == "IS NULL" else c.isNotNull()
            case Binary():
                return self.binary(df, env, x)
            case Case(subject=subject, whens=whens, default=default):
                out = None
                for a, b in whens:
                    test = self.truth(self.expr(df, env, a), df) if subject is None else self.expr(df, env, Binary("=", subject, a))
                    value = self.expr(df, env, b)
                    out = F.when(test, value) if out is None else out.when(test, value)
                return out.otherwise(self.expr(df, env, default))
            case Call():
                return self.call(df, env, x)
            case Star():
                return F.array(*[self.expr(df, env, Var(v)) for v in env if not v.startswith("__")])
        raise CypherError(f"{type(x).__name__} can't stand here")

    def prop(self, b: Binding, prop: str, df) -> Column:
        if b.kind == "rel":
            return col(f"{b.name}.{prop}") if prop in b.props else F.lit(None)
        if prop == "id" and "id" not in b.props:
            return col(f"{b.name}.__id")
        if prop == "_labels":
            return col(f"{b.name}.__labels")
        if prop.startswith("_") and prop not in b.props:
            raise CypherError(f"property {prop} is internal")
        return col(f"{b.name}.{prop}") if prop in b.props else F.lit(None)

    def logic(self, c: Column, df) -> Column:
        c = self.truth(c, df)
        return F.coalesce(c, F.lit(False)) if self.compat else c

    def binary(self, df, env, x: Binary) -> Column:
        a, b, op = self.expr(df, env, x.a), self.expr(df, env, x.b), x.op
        if op in ("AND", "OR", "XOR"):
            a, b = self.logic(a, df), self.logic(b, df)
            return a & b if op == "AND" else a | b if op == "OR" else a != b
        if op in ("=", "<>"):
            if self.compat:
                ka, kb = self.type(a, df), self.type(b, df)
                same = a.eqNullSafe(b) if isinstance(ka, T.NullType) or isinstance(kb, T.NullType) or isinstance(ka, WHOLE) == isinstance(kb, WHOLE) else F.lit(False)
                return same if op == "=" else ~same
            return a == b if op == "=" else a != b
        if op in ("<", "<=", ">", ">="):
            c = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
            if not self.compat:
                return c
            order = F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
            return {"<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[op]
        if op == "IN":
            if isinstance(x.b, ListOf):
                return a.isin(*[self.expr(df, env, i) for i in x.b.items]) if x.b.items else F.lit(False)
            return F.array_contains(b, a)
        if op == "<->":
            return cosine(a, b)
        if op in ("CONTAINS", "STARTS WITH", "ENDS WITH"):
            return {"CONTAINS": F.contains, "STARTS WITH": F.startswith, "ENDS WITH": F.endswith}[op](a, b)
        if op == "=~":
            return F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))
        if op == "^":
            return F.pow(a, b)
        ka, kb = self.type(a, df), self.type(b, df)
        if op == "+" and (isinstance(ka, T.StringType) or isinstance(kb, T.StringType)):
            return F.concat(a.cast("string"), b.cast("string"))
        if op == "+" and isinstance(ka, T.ArrayType):
            return F.concat(a, b)
        if op == "/":
            return F.call_function("div", a, b) if isinstance(ka, WHOLE) and isinstance(kb, WHOLE) else a / b
        return {"+": a + b, "-": a - b, "*": a * b, "%": a % b}[op]

    def call(self, df, env, x: Call) -> Column:
        name, args = x.name, x.args
        if name in AGGREGATE:
            if args and isinstance(args[0], Star):
                return F.coalesce(F.sum(col(self.weight)), F.lit(0)) if self.weight else F.count(F.lit(1))
            if len(args) != 1:
                raise CypherError(f"{name} takes one argument")
            if self.weight and name == "count" and not x.distinct:
                return F.coalesce(F.sum(F.when(self.expr(df, env, args[0]).isNotNull(), col(self.weight))), F.lit(0))
            return AGGREGATE[name](self.expr(df, env, args[0]), x.distinct)
        first = args[0] if args else None
        b = env.get(first.name) if isinstance(first, Var) else None
        if name in ("labels", "haslabel", "id", "type", "properties", "keys", "startnode", "endnode") and b is None:
            raise CypherError(f"{name} takes a node or a relationship")
        if name == "labels":
            return col(f"{b.name}.__labels")
        if name == "haslabel":
            return reduce(lambda p, q: p & q, [F.array_contains(col(f"{b.name}.__labels"), a.value) | (col(f"{b.name}.__label") == a.value) for a in args[1:]])
        if name == "id":
            return col(f"{b.name}.__id")
        if name in ("type", "startnode", "endnode"):
            return col(f"{b.name}.__{dict(type='type', startnode='src', endnode='dst')[name]}")
        if name == "properties":
            return F.struct(*[col(f"{b.name}.{p}").alias(p) for p in b.props])
        if name == "keys":
            return F.filter(F.array(*[F.when(col(f"{b.name}.{p}").isNotNull(), F.lit(p)) for p in b.props]), lambda k: k.isNotNull())
        columns = [self.expr(df, env, a) for a in args]
        if name == "size" or name == "length":
            return (F.length if isinstance(self.type(columns[0], df), T.StringType) else F.size)(columns[0]).cast("long")
        if name == "round" and len(args) == 2:
            return F.round(columns[0], args[1].value)
        if name not in SCALAR:
            raise CypherError(f"unknown function {name}")
        return SCALAR[name](*columns)

    # -- mutations: a new graph, the old one stays --------------------------------------------------------------------------
    def create(self, df, env, clause: Create):
        """New nodes and relationships for each row. A new node's id is its property `id` if given, else a hash of its
        variable, its properties and the row's identities; relationships join variables that are bound or created."""
        base = self.one_row() if df is None else df
        env = dict(env)
        for pattern in clause.patterns:
            nodes = [n if n.var else replace(n, var=self.name()) for n in pattern.nodes]
            for n in nodes:
                if n.var in env:
                    continue
                if not n.labels:
                    raise CypherError("a node needs a label to be created")
                given = dict(n.props)
                values = {k: self.expr(base, env, v) for k, v in given.items()}
                whole = [c for b in env.values() for c in b.identity()]
                key = values["id"].cast("long") if "id" in values else F.xxhash64(F.lit(n.var), *[v.cast("string") for v in values.values()], *map(col, whole))
                label = n.labels[0]
                old = self.graph.nodes.get(label)
                base = base.select(*map(col, base.columns), key.alias(f"{n.var}.__id"), F.lit(label).alias(f"{n.var}.__label"), F.array(*map(F.lit, n.labels)).alias(f"{n.var}.__labels"), *[v.alias(f"{n.var}.{k}") for k, v in values.items() if k != "id"])
                env[n.var] = Binding("node", n.var, (label,), tuple(k for k in given if k != "id"))
                fresh = base.select(col(f"{n.var}.__id").alias(old.key if old else "id"), *[col(f"{n.var}.{k}").alias(k) for k in env[n.var].props if not old or k != old.key], col(f"{n.var}.__labels").alias("_labels"))
                self.stats.nodes_created += fresh.count()
                if old:
                    marks = old.df.select(*old.props, (F.col(old.labels) if old.labels else F.array(F.lit(label))).alias("_labels"))
                    types = dict(marks.dtypes)
                    fresh = fresh.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in fresh.columns])
                    table = NodeTable(label, marks.unionByName(fresh, allowMissingColumns=True), old.key, "_labels")
                else:
                    table = NodeTable(label, fresh, "id", "_labels")
                self.graph = self.graph.with_node(table)
            for a, rel, b in zip(nodes, pattern.rels, nodes[1:]):
                if len(rel.types) != 1 or rel.hops is not None:
                    raise CypherError("a relationship is created with one type and no length")
                a, b = (b, a) if rel.direction == "in" else (a, b)
                props = {k: self.expr(base, env, v) for k, v in rel.props}
                props.setdefault("weight", F.lit(1.0))
                rows = base.select(col(f"{a.var}.__id").alias("src"), col(f"{b.var}.__id").alias("dst"), *[v.alias(k) for k, v in props.items()])
                self.stats.relationships_created += rows.count()
                for src in env[a.var].labels:
                    for dst in env[b.var].labels:
                        mine = rows if len(env[a.var].labels) == len(env[b.var].labels) == 1 else base.filter((col(f"{a.var}.__label") == src) & (col(f"{b.var}.__label") == dst)).select(col(f"{a.var}.__id").alias("src"), col(f"{b.var}.__id").alias("dst"), *[v.alias(k) for k, v in props.items()])
                        self.graph = self.graph.with_edge(EdgeTable(src, rel.types[0], dst, mine))
        self.plan.append("Create")
        return base, env

    def set_props(self, df, env, clause: SetProps) -> None:
        self.plan.append("SetProperty")
        for var in dict.fromkeys(i[1] for i in clause.items):
            b = env.get(var)
            if b is None or b.kind != "node":
                raise CypherError(f"SET takes a node, {var} is none")
            values: dict[str, Column] = {}
            added: list[str] = []
            only = False
            for kind, name, prop, value in clause.items:
                if name != var:
                    continue
                if kind == "prop":
                    values[prop] = self.expr(df, env, value)
                elif kind == "labels":
                    added += value
                else:
                    only |= kind == "replace"
                    if not isinstance(value, MapOf):
                        raise CypherError("SET takes a map of properties")
                    values |= {k: self.expr(df, env, v) for k, v in value.items}
            changes = df.select(col(f"{var}.__id").alias("__id"), col(f"{var}.__label").alias("__label"), *[v.alias(f"__{k}") for k, v in values.items()]).dropDuplicates(["__id", "__label"])
            self.stats.properties_set += changes.count() * len(values)
            self.stats.labels_added += changes.count() * len(added)
            for label in b.labels:
                t = self.graph.nodes[label]
                mine = changes.filter(F.col("__label") == label).drop("__label").withColumn("__hit", F.lit(True))
                joined = t.df.join(mine, F.col(t.key).cast("long") == F.col("__id"), "left")
                hit, types, out = F.coalesce("__hit", F.lit(False)), dict(t.df.dtypes), []
                for c in dict.fromkeys([*t.props, *values]):
                    if c == t.key:
                        out.append(F.col(c))
                    elif c in values:
                        new = F.col(f"__{c}")
                        out.append((F.when(hit, new.cast(types[c])).otherwise(F.col(c)) if c in types else F.when(hit, new)).alias(c))
                    else:
                        out.append((F.when(~hit, F.col(c)) if only else F.col(c)).alias(c))
                marks = F.col(t.labels) if t.labels else F.array(F.lit(label))
                if added:
                    marks = F.when(hit, F.array_union(marks, F.array(*map(F.lit, added)))).otherwise(marks)
                named = t.labels or ("_labels" if added else None)
                rows = joined.select(*out, *([marks.alias(named)] if named else []))
                self.graph = self.graph.with_node(NodeTable(label, rows, t.key, named))

    def delete(self, df, env, clause: Delete) -> None:
        self.plan.append(f"{'Detach' * clause.detach}Delete({', '.join(clause.names)})")
        if df is None:
            return
        for var in clause.names:
            b = env.get(var)
            if b is None or b.kind == "value":
                raise CypherError(f"DELETE takes nodes and relationships, {var} is none")
            if b.kind == "rel":
                gone = df.select(*[col(c).alias(c.split(".__")[1]) for c in b.identity()]).distinct()
                self.stats.relationships_deleted += gone.count()
                out = []
                for e in self.graph.edges:
                    kind = F.col("relation") if e.mixed else F.lit(e.relation)
                    rows = e.df.withColumn("__type", kind)
                    out.append(replace(e, rows=rows.join(gone.withColumnRenamed("type", "__type"), ["src", "dst", "__type"], "left_anti").select(e.df.columns)))
                self.graph = replace(self.graph, edges=tuple(out))
                continue
            gone = df.select(col(f"{var}.__id").alias("__id"), col(f"{var}.__label").alias("__label")).distinct()
            self.stats.nodes_deleted += gone.count()
            for label in b.labels:
                t, mine = self.graph.nodes[label], gone.filter(F.col("__label") == label)
                rows = t.df.join(mine, F.col(t.key).cast("long") == F.col("__id"), "left_anti")
                self.graph = self.graph.with_node(replace(t, rows=rows))
                if clause.detach:
                    out = []
                    for e in self.graph.edges:
                        rows = e.df
                        if e.src_label == label:
                            rows = rows.join(mine, F.col("src") == F.col("__id"), "left_anti")
                        if e.dst_label == label:
                            rows = rows.join(mine, F.col("dst") == F.col("__id"), "left_anti")
                        out.append(replace(e, rows=rows))
                    self.graph = replace(self.graph, edges=tuple(out))


def _weight(n: NodePattern) -> int:
    """How selective a node pattern looks."""
    return 3 * any(k == "id" for k, _ in n.props) + 2 * bool(n.props) + bool(n.labels)


def _names(*trees) -> set[str]:
    """Variables that trees name, in patterns or expressions."""
    found = [x for tree in trees for x in walk(tuple(tree) if isinstance(tree, list) else tree)]
    return {x.name for x in found if isinstance(x, Var)} | {x.var for x in found if isinstance(x, (NodePattern, RelPattern, Unwind)) and x.var}


def _conjuncts(x) -> list:
    return _conjuncts(x.a) + _conjuncts(x.b) if isinstance(x, Binary) and x.op == "AND" else [x]


def _groups(kind: T.DataType) -> bool:
    """Whether rows can be grouped by it."""
    if isinstance(kind, T.StructType):
        return all(_groups(f.dataType) for f in kind)
    return _groups(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _swap(tree, old, new):
    if tree is old:
        return new
    if isinstance(tree, tuple):
        return tuple(_swap(x, old, new) for x in tree)
    if hasattr(tree, "__dataclass_fields__"):
        return replace(tree, **{f: _swap(getattr(tree, f), old, new) for f in tree.__dataclass_fields__})
    return tree


def _inline(tree, items, names):
    """Aliases replaced by what they stand for."""
    known = {n: i.expr for n, i in zip(names, items)}
    for x in [x for x in walk(tree) if isinstance(x, Var) and x.name in known and known[x.name] != x]:
        tree = _swap(tree, x, known[x.name])
    return tree


def _rename(tree, items, names):
    """Projected expressions replaced by their aliases."""
    for n, i in zip(names, items):
        for x in [x for x in walk(tree) if x == i.expr]:
            tree = _swap(tree, x, Var(n))
    return tree
