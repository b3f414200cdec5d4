"""Guarded ad-hoc queries: one read-only SQL statement over the views nodes
and edges, and a small pattern language compiled to the same. The guard looks
at the parsed plan, not at words, so aliases and comments cannot mislead it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph

# Longest query, greatest number of rows of a result.
MAX_CHARS, MAX_ROWS = 16_384, 10_000
#: Logical operators that only read.
_READS = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit LimitAndOffset Offset Union Distinct Deduplicate SubqueryAlias UnresolvedRelation Except Intersect Window WithWindowDefinition Generate "
    "UnresolvedWith UnresolvedHaving UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedSubqueryColumnAliases LateralJoin Pivot Expand ParameterizedQuery NameParameterizedQuery View UnresolvedTVFAliases".split()
)
#: Columns a query may not see.
_HIDDEN = ("embedding", "summary")
#: Functions that reach outside the views.
_OUTSIDE = frozenset("java_method reflect try_reflect input_file_name read_files from_avro current_user session_user user version".split())


class Rejected(ValueError):
    """The guard's reason not to run a query."""


def _nodes(plan):
    yield plan
    for children in (plan.children(), plan.innerChildren()):
        for i in range(children.size()):
            child = children.apply(i)
            if hasattr(child, "children"):
                yield from _nodes(child)


def guard(spark, text: str) -> None:
    """Raise Rejected unless text is a single SELECT over nodes and edges."""
    if len(text) > MAX_CHARS:
        raise Rejected(f"longer than {MAX_CHARS} characters")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Rejected(f"no single statement: {str(e).splitlines()[0]}") from None
    names: set[str] = set()
    for node in _nodes(plan):
        kind = node.nodeName().replace("'", "")
        if kind not in _READS:
            raise Rejected(f"{kind} is not allowed")
        if kind == "UnresolvedWith":
            relations = node.cteRelations()
            for i in range(relations.size()):
                name, alias = relations.apply(i)._1(), relations.apply(i)._2()
                names.add(name)
                for x in _nodes(alias):
                    if x.nodeName().replace("'", "") not in _READS:
                        raise Rejected(f"{x.nodeName()} is not allowed")
    spelled = plan.toString()
    for relation in re.findall(r"'?UnresolvedRelation \[([^\]]*)\]", spelled):
        if relation.split(", ")[0].lower() not in {"nodes", "edges", *(n.lower() for n in names)} or "," in relation:
            raise Rejected(f"relation {relation} is not nodes or edges")
    words = {w.lower() for w in re.findall(r"\w+", re.sub(r"'(?:[^'\\]|\\.)*'", "''", text))}
    for w in (*_HIDDEN, *_OUTSIDE):
        if w in words:
            raise Rejected(f"{w} may not be used")


def graph_sql(g: Graph, text: str, limit: int = MAX_ROWS, args: dict | None = None) -> DataFrame:
    """The rows of one guarded SELECT over the views nodes and edges, at most
    limit; every cell must be a scalar."""
    spark = g.nodes.sparkSession
    guard(spark, text)
    tag = uuid.uuid4().hex
    g.some(columns=("type", "name", "properties", "repo_id", "file_path", "start_line", "end_line")).createOrReplaceTempView(f"n_{tag}")
    g.links().createOrReplaceTempView(f"e_{tag}")
    try:
        body = f"WITH nodes AS (SELECT * FROM n_{tag}), edges AS (SELECT * FROM e_{tag}) SELECT * FROM ({text}\n) LIMIT {int(limit)}"
        df = spark.sql(body, args=args) if args else spark.sql(body)
    finally:
        spark.catalog.dropTempView(f"n_{tag}")
        spark.catalog.dropTempView(f"e_{tag}")
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant")]
    if nested:
        raise Rejected(f"cells must be scalar: {nested}")
    return df


_PATTERN = re.compile(r"\s*MATCH\s+(?P<path>.+?)(?:\s+WHERE\s+(?P<where>.+?))?\s+RETURN\s+(?P<what>.+?)(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*", re.I | re.S)
_NODE = re.compile(r"\(\s*(\w+)\s*(?::\s*(\w+))?\s*\)")
_EDGE = re.compile(r"(<?)-\[\s*(\w*)\s*(?::\s*([\w|]+))?\s*\]-(>?)")


def compile_match(text: str, params: dict | None = None) -> str:
    """SQL for MATCH (a:type)-[r:TYPE]->(b) ... WHERE ... RETURN ... [ORDER BY
    ... LIMIT n]: one join for each edge, grouped by the plain items when an
    item aggregates. STARTS WITH, CONTAINS and toLower are understood."""
    m = _PATTERN.fullmatch(text)
    if not m:
        raise Rejected("not MATCH ... RETURN ...")
    path, at, tables, where = m["path"].strip(), 0, [], []
    seen: set[str] = set()

    def node(p: int) -> tuple[str, int]:
        x = _NODE.match(path, p)
        if not x:
            raise Rejected(f"no node at {path[p:p + 20]!r}")
        if x[1] not in seen:
            seen.add(x[1])
            tables.append(f"nodes {x[1]}")
        if x[2]:
            where.append(f"{x[1]}.type = '{x[2]}'")
        return x[1], x.end()

    left, at = node(at)
    k = 0
    while at < len(path):
        x = _EDGE.match(path, at)
        if not x or bool(x[1]) == bool(x[4]):
            raise Rejected("an edge needs one direction")
        right, at = node(x.end())
        name, k = x[2] or f"r_{k}", k + 1
        tables.append(f"edges {name}")
        a, b = (left, right) if x[4] else (right, left)
        where += [f"{name}.source_id = {a}.id", f"{name}.target_id = {b}.id"]
        if x[3]:
            where.append(f"{name}.type IN ({', '.join(repr(t) for t in x[3].split('|'))})")
        left = right
    if m["where"]:
        c = re.sub(r"([\w.()]+)\s+STARTS\s+WITH\s+(\$?\w+|'[^']*')", r"startswith(\1, \2)", m["where"], flags=re.I)
        c = re.sub(r"([\w.()]+)\s+CONTAINS\s+(\$?\w+|'[^']*')", r"contains(\1, \2)", c, flags=re.I)
        where.append("(" + re.sub(r"\btoLower\b", "lower", c, flags=re.I) + ")")
    items = [x.strip() for x in re.split(r",(?![^(]*\))", m["what"])]
    plain = [re.sub(r"\s+AS\s+\w+$", "", x, flags=re.I) for x in items if not re.match(r"(?:count|min|max|sum|avg)\s*\(", x, re.I)]
    sql = f"SELECT {', '.join(items)} FROM {', '.join(tables)} WHERE {' AND '.join(where) or 'true'}"
    if len(plain) < len(items) and plain:
        sql += f" GROUP BY {', '.join(plain)}"
    sql += f" ORDER BY {m['order']}" if m["order"] else ""
    sql += f" LIMIT {m['limit']}" if m["limit"] else ""
    return re.sub(r"\$(\w+)", r":\1", sql)


def match(g: Graph, text: str, params: dict | None = None, limit: int = MAX_ROWS) -> DataFrame:
    """The rows of a MATCH query (see compile_match), guarded like graph_sql."""
    return graph_sql(g, compile_match(text, params), limit, params)


def rows_or_reason(g: Graph, text: str) -> DataFrame:
    """Whether the guard lets a query through: allowed, reason."""
    try:
        guard(g.nodes.sparkSession, text)
        why = ""
    except Rejected as e:
        why = str(e)
    return g.nodes.sparkSession.range(1).select(F.lit(not why).alias("allowed"), F.lit(why).alias("reason"))
