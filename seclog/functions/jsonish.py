"""Tolerant JSON reading of model responses into VARIANT, and verdict typing.

Ladder (first candidate that is one strict JSON value wins): the trimmed text;
the body of a ```json fence; the text with trailing commas removed; the span
from the first ``{`` to the last ``}`` with trailing commas removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .iocs import _bound, strip_ws

_FENCE = "(?Us)" + rules.JSON_FENCE
_TRAILING_COMMA = "(?U)" + rules.JSON_TRAILING_COMMA
_BRACES = r"(?s)\{.*\}"
# What a strict JSON value can begin with.
_VALUE_START = r'^[{\["\-0-9tfn]'


VERDICT_FIELDS = [
    ("is_threat", "boolean"),
    ("attack_type", "string"),
    ("mitre_id", "string"),
    ("tactic", "string"),
    ("technique_name", "string"),
    ("confidence", "double"),
    ("evidence", "string"),
    ("recommendation", "string"),
]


def _type_error(kind: Column) -> Column:
    """The error text of assigning a key on a non-object JSON value (Python names)."""
    pyname = (
        F.when(kind.startswith("ARRAY"), F.lit("list"))
        .when(kind.startswith("STRING"), F.lit("str"))
        .when(kind.startswith("BOOLEAN"), F.lit("bool"))
        .when(kind.startswith("DOUBLE") | kind.startswith("DECIMAL") | kind.startswith("FLOAT"), F.lit("float"))
        .otherwise(F.lit("int"))
    )
    return F.when(pyname == "list", F.lit("list indices must be integers or slices, not str")).otherwise(
        F.format_string("'%s' object does not support item assignment", pyname)
    )


def truthy(v: Column) -> Column:
    """Whether a JSON value counts as true: a true boolean, a number but 0, a non-empty text, list or object; null if absent."""

    def of(v: Column, kind: Column) -> Column:
        return (
            F.when(v.isNull() | (kind == "VOID"), F.lit(None).cast("boolean"))
            .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
            .when(kind.startswith("ARRAY"), F.to_json(v) != "[]")
            .when(kind.startswith("OBJECT"), F.to_json(v) != "{}")
            .otherwise(F.try_variant_get(v, "$", "double") != 0)
        )

    return _bound(v, lambda v: _bound(F.schema_of_variant(v), lambda kind: of(v, kind)))


def _strict(c: Column) -> Column:
    """The value of a text that is one strict JSON value, else null. A text that cannot begin one is not parsed (to fail costs
    far more than to succeed)."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    value = _bound(wrapped, lambda w: F.when(F.try_variant_get(w, "$[1]", "variant").isNull(), F.try_variant_get(w, "$[0]", "variant")))
    return F.when(c.rlike(_VALUE_START), value)


def with_verdict(df: DataFrame, raw_col: str, keep: list[str]) -> DataFrame:
    """The tolerant ladder and the typed verdict fields plus ``error`` (null when the verdict is usable), in stages.

    Every stage reads attributes of the previous one (trimmed text → candidates → the chosen value → its kind → typed fields),
    so the plan stays small. A candidate is parsed once, only if those before it are no JSON and only if its text is none of
    theirs; the typed fields come out of a one-row ``inline`` generator that later filters cannot be pushed through.
    """
    u = df.select(*keep, strip_ws(F.col(raw_col)).alias("_u"))
    cand = u.select(
        *keep,
        F.col("_u").alias("_c1"),
        strip_ws(F.regexp_extract(F.col("_u"), _FENCE, 1)).alias("_c2"),
        F.regexp_replace(F.col("_u"), _TRAILING_COMMA, "$1").alias("_c3"),
        F.regexp_replace(F.regexp_extract(F.col("_u"), _BRACES, 0), _TRAILING_COMMA, "$1").alias("_c4"),
    )
    c = [F.col(f"_c{i}") for i in range(1, 5)]
    new = [F.when(~c[i].isin(*c[:i]), _strict(c[i])) if i else _strict(c[i]) for i in range(4)]
    chosen = cand.select(*keep, F.coalesce(*new).alias("_v"))
    kinds = chosen.select(*keep, "_v", F.schema_of_variant("_v").alias("_kind"))
    v, kind = F.col("_v"), F.col("_kind")
    is_obj = kind.startswith("OBJECT")
    threat = truthy(F.try_variant_get(v, "$.is_threat", "variant"))
    cols = [F.when(is_obj, threat if name == "is_threat" else F.try_variant_get(v, f"$.{name}", t)).alias(name) for name, t in VERDICT_FIELDS]
    error = F.when(v.isNull() | (kind == "VOID"), F.lit(rules.VERDICT_PARSE_ERROR)).when(~is_obj, _type_error(kind))
    return kinds.select(*keep, F.inline(F.array(F.struct(*cols, error.alias("error")))))
