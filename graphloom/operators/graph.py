"""The graph as two tables, and what every read of it shares: one row for each
id, properties by key, scopes, pages and limits."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of nodes and edges as they are stored.
NODE_TYPES = (
    "repository package file function class interface entrypoint entity component route state_store type_alias enum variable external_call"
).split()
EDGE_TYPES = (
    "CONTAINS_PACKAGE CONTAINS_FILE CONTAINS_FUNCTION CONTAINS_CLASS CONTAINS_INTERFACE CONTAINS_TYPE_ALIAS CONTAINS_ENUM CONTAINS_VARIABLE "
    "CONTAINS_ENTITY CONTAINS_COMPONENT CONTAINS_ROUTE HAS_METHOD CALLS IMPORTS EXTENDS IMPLEMENTS_INTERFACE USES_TYPE HANDLES OPERATES_ON "
    "RENDERS_COMPONENT USES_COMPONENT MAKES_EXTERNAL_CALL REFERENCES_VARIABLE RESOLVES_TO"
).split()
# Edges that carry flow, and edges that count as a use of a node of a type.
FLOW = ("CALLS", "HANDLES", "MAKES_EXTERNAL_CALL", "RESOLVES_TO", "REFERENCES_VARIABLE")
USAGE = {
    "function": ("CALLS", "HANDLES", "REFERENCES_VARIABLE"),
    "class": ("EXTENDS", "USES_TYPE", "CALLS"),
    "interface": ("IMPLEMENTS_INTERFACE", "EXTENDS", "USES_TYPE"),
    "variable": ("REFERENCES_VARIABLE",),
    "enum": ("USES_TYPE", "REFERENCES_VARIABLE"),
}
USAGE_ELSE = ("USES_TYPE", "IMPORTS", "CALLS")
# Fixed values: (greatest, default) limit of each paged read, and the greatest depth of a walk.
LIMITS = {
    "neighbors": (200, 50),
    "list": (1000, 50),
    "edges_among": (10_000, 2000),
    "subgraph": (200, 50),
    "expand": (100_000, 1000),
    "dead": (200, 50),
    "bridges": (200, 50),
    "callers": (1000, 100),
    "entrypoints": (1000, 20),
    "unresolved": (1000, 50),
}
DEPTH = 10

NODE_COLUMNS = ("type", "name", "properties", "summary", "repo_id", "file_path", "start_line", "end_line")
EDGE_COLUMNS = ("source_id", "target_id", "type", "confidence", "created_by", "properties")


def clamp_limit(n: float | None, kind: str) -> int:
    """A limit as whole number within the bounds of its kind; what is no
    positive number gives the default."""
    most, usual = LIMITS[kind]
    if n is None or not math.isfinite(n) or n < 1:
        return usual
    return min(int(n), most)


def clamp_depth(n: float | None) -> int:
    """A depth within 1 to DEPTH; what is no number gives 1."""
    return 1 if n is None or not math.isfinite(n) else max(1, min(int(n), DEPTH))


def prop(key: str, of: str = "properties") -> Column:
    """A property as text; absent and JSON null give null."""
    return F.get_json_object(F.col(of), f"$.{key}")


def one_per_id(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row for each id: the least value of each column. Repeated rows and
    respelled properties fold; called after filters, so these reach the scan."""
    return rows.where("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in columns])


@dataclass(frozen=True)
class Graph:
    """Node and edge rows, possibly repeated. scope limits every read to the
    repositories in it (None: all); both ends of an edge must lie inside."""

    nodes: DataFrame
    edges: DataFrame
    scope: tuple[str, ...] | None = None

    def node_rows(self, *types: str) -> DataFrame:
        """Node rows of the given types (all if none) in scope."""
        n = self.nodes if not types else self.nodes.where(F.col("type").isin(*types))
        return n if self.scope is None else n.where(F.col("repo_id").isin(*self.scope))

    def some(self, *types: str, where: Column | str | None = None, columns: Iterable[str] = NODE_COLUMNS) -> DataFrame:
        """Nodes of the given types that meet the condition, each once."""
        n = self.node_rows(*types)
        return one_per_id(n if where is None else n.where(where), columns)

    def edge_rows(self, *types: str) -> DataFrame:
        """Edge rows of the given types (all if none) with both ends in scope."""
        e = self.edges if not types else self.edges.where(F.col("type").isin(*types))
        if self.scope is not None:
            inside = [F.substring_index(F.col(c), ":", 1).isin(*self.scope) for c in ("source_id", "target_id")]
            e = e.where(inside[0] & inside[1])
        return e

    def links(self, *types: str) -> DataFrame:
        """Edges of the given types (all if none), each id once."""
        return one_per_id(self.edge_rows(*types), EDGE_COLUMNS)

    def pairs(self, *types: str) -> DataFrame:
        """Distinct (source_id, target_id) over edges of the given types, by
        hash and without the id that links() sorts by."""
        return self.edge_rows(*types).where("id is not null").select("source_id", "target_id").distinct()

    def named(self, prefix: str, *types: str, columns: Iterable[str] = ("type", "name", "repo_id", "file_path")) -> DataFrame:
        """Nodes with every column under a prefix, to be joined to edges."""
        return self.some(*types, columns=columns).select(F.col("id").alias(f"{prefix}_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def page(rows: DataFrame, key: str, limit: int, cursor: str = "") -> DataFrame:
    """The rows after the cursor, by key, at most limit, with has_more: true
    when another page follows. '' starts at the beginning."""
    got = rows.where(F.col(key) > cursor) if cursor else rows
    top = got.orderBy(key).limit(limit + 1)
    # at most limit + 1 rows meet here
    from pyspark.sql import Window

    w = Window.orderBy(key)
    return top.withColumn("_r", F.row_number().over(w)).withColumn("has_more", F.max("_r").over(Window.partitionBy(F.lit(0))) > limit).where(F.col("_r") <= limit).drop("_r")


def glob_regex(pattern: str) -> str:
    """A glob as anchored regular expression: * any text, ? one character,
    all else literal."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob_match(column: Column, pattern: str) -> Column:
    """Whether a column matches a glob as a whole, case aside."""
    return F.lower(column).rlike("(?s)" + glob_regex(pattern.lower()))
