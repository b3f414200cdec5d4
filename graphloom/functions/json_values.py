"""JSON texts as values: one spelling for all spellings of a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\]|\\.)*+"'
_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_TOKEN = rf'{_STRING}|{_NUMBER}|[^"\d-]+|-'


def _plain(token: Column) -> Column:
    """A number with an exponent as a plain decimal, if that is exact."""
    plain = token.try_cast("decimal(38,18)")
    exact = plain.cast("double").eqNullSafe(token.try_cast("double"))
    return F.when(token.rlike(r"^-?\d[^\"]*[eE]") & exact, plain.cast("string")).otherwise(token)


def canonical_json(text: Column) -> Column:
    """Text of the same JSON value with keys in order, no spaces, plain
    escapes and the shortest decimal spelling of numbers (7, 7.0, 7e0 agree).
    Array order, value types and null against absent stay apart. Null gives
    null; a text that is no JSON gives itself after a 'raw:' mark. Runs in the
    JVM; the token-wise path is taken only where an exponent may occur."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), _plain)
    spelled = F.when(text.rlike(r"\d[eE][+-]?\d"), F.array_join(tokens, "")).otherwise(text)
    value = F.to_json(F.try_parse_json(spelled))
    return F.when(text.isNull(), None).otherwise(F.coalesce(value, F.concat(F.lit("raw:"), text)))
