"""Route paths: one spelling of parameters, signatures, segment matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How route parameters are written.
_PARAM = r"(?:\$\{[^}]*\}|\{[^}]*\}|<[^>]*>|\[[^\]]*\]|:[A-Za-z_][\w]*|\*\*?)"


def param_blind(path: Column) -> Column:
    """A route path in lower case with every parameter segment as :p."""
    parts = F.transform(F.split(F.lower(path), "/"), lambda s: F.when(s.rlike(f"^{_PARAM}$"), ":p").otherwise(s))
    return F.array_join(parts, "/")


def signature(path: Column) -> Column:
    """The signature that calls and entrypoints are matched by: no query and
    fragment, no template glued to a segment's end, parameters as :_, single
    slashes, a slash in front and none at the end. Null stays null."""
    p = F.regexp_replace(path, r"[?#].*$", "")
    p = F.regexp_replace(p, r"([A-Za-z0-9_-])\$\{[^}]*\}$", "$1")
    p = F.regexp_replace(p, r"\$\{[^}]*\}|\{[^}]*\}|:[A-Za-z_][A-Za-z0-9_]*", ":_")
    p = F.regexp_replace(F.concat(F.lit("/"), p), r"/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/$", ""))


def segments(sig: Column) -> Column:
    """Segments of a signature."""
    return F.split(F.regexp_replace(sig, r"^/", ""), "/")


def accepts(entry: Column, call: Column) -> Column:
    """Whether an entrypoint's segments accept a call's: of one length, a
    parameter of the entrypoint accepts anything, one of the call only one."""
    same = F.zip_with(entry, call, lambda e, c: (e == ":_") | (e == c))
    return (F.size(entry) == F.size(call)) & F.forall(same, lambda x: x)


def suffix_match(a: Column, b: Column) -> Column:
    """File paths that name one file: equal, or the shorter has a folder and
    is a path suffix of the longer."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | (F.contains(short, F.lit("/")) & F.endswith(long, F.concat(F.lit("/"), short)))
