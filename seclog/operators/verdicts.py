"""Verdicts: raw model responses → typed rows, attached to clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.jsonish import VERDICT_FIELDS, with_verdict


def parse_verdicts(raw: DataFrame, raw_col: str = "raw", keep: Sequence[str] | None = None) -> DataFrame:
    """Adds the typed verdict columns and ``error``; ``keep`` = key columns to retain.

    The response text is materialised first and the verdict columns come out
    of a one-row ``inline`` generator: a later filter on ``is_threat`` or
    ``error`` then cannot be pushed below it and re-run the JSON ladder (or
    re-derive the response text) inside the predicate.
    """
    keep = [c for c in raw.columns if c != raw_col] if keep is None else list(keep)
    return with_verdict(raw, raw_col, keep)


def attach_verdicts(
    clusters: DataFrame,
    verdicts: DataFrame,
    on: Sequence[tuple[str, str]] = (("log_id", "log_id"), ("cluster_id", "cluster_id")),
) -> DataFrame:
    """Left join clusters → parsed verdicts (equi-join on ``on`` pairs).

    A cluster without a response row behaves like an empty response: the
    verdict is unparsable and ``error`` says so.
    """
    names = [n for n, _t in VERDICT_FIELDS]
    v = verdicts.select(
        *[F.col(r).alias(f"_k{i}") for i, (_l, r) in enumerate(on)],
        *names,
        "error",
        F.lit(True).alias("_has_verdict"),
    )
    cond = None
    for i, (left, _r) in enumerate(on):
        c = clusters[left] == v[f"_k{i}"]
        cond = c if cond is None else cond & c
    joined = clusters.join(v, cond, "left")
    error = F.when(F.col("_has_verdict").isNull(), F.lit(rules.VERDICT_PARSE_ERROR)).otherwise(F.col("error"))
    return joined.select(*[clusters[c] for c in clusters.columns], *names, error.alias("error"))


def threats(events: DataFrame) -> DataFrame:
    """Threat events: ``is_threat`` true and no ``error``."""
    return events.where(F.coalesce(F.col("is_threat"), F.lit(False)) & F.col("error").isNull())
