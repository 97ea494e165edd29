"""Report tables: risk bands, display defaults, MITRE matrix, threat report,
knowledge-base query text and context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..session import cut_lineage
from .intel import enrich_registration, enrich_reputation


def risk_band(confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return (
        F.when(c >= rules.RISK_HIGH_MIN, F.lit(rules.RISK_HIGH))
        .when(c >= rules.RISK_MEDIUM_MIN, F.lit(rules.RISK_MEDIUM))
        .otherwise(F.lit(rules.RISK_LOW))
    )


def display(c: Column, default: str) -> Column:
    """Falsy (null or empty) text shows the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def event_display(events: DataFrame) -> DataFrame:
    """Display columns of each event; ``ioc_text`` = '无IOC' when it has no indicators.

    The per-indicator lines stay rows (``report_iocs``) so a large event never
    becomes one giant string.
    """
    cols = [display(F.col(k), v).alias(f"{k}_display") for k, v in rules.DISPLAY_DEFAULTS.items()]
    n = F.coalesce(F.col("n_iocs"), F.lit(0))
    return events.select(
        "*",
        *cols,
        risk_band(F.col("confidence")).alias("risk_band"),
        F.when(n == 0, F.lit(rules.DISPLAY_NO_IOC)).alias("ioc_text"),
    )


def report_iocs(
    threat_events: DataFrame, merged: DataFrame, reputation: DataFrame, registration: DataFrame, keys: Sequence[str] = ("log_id",)
) -> DataFrame:
    """One row per indicator of a threat event: ``type: value`` display line, risk band, ``vt_*`` and ``whois_*``
    columns, ``event_malicious`` (the event's sum) and its list order ``first_chunk_ix, first_ioc_ix``.

    The event's sum is an aggregate joined back, so an event with very many indicators is no window in one task.
    """
    of = [*keys, "cluster_id"]
    band = threat_events.select(*of, risk_band(F.col("confidence")).alias("risk_band"))
    # enriched once and written: the rows are read for themselves and for the totals
    known = cut_lineage(enrich_reputation(merged.join(band, of), reputation))
    totals = known.groupBy(*of).agg(F.sum(F.coalesce("vt_malicious_count", F.lit(0))).cast("long").alias("event_malicious"))
    rows = enrich_registration(known, registration).withColumn("line", F.concat(F.col("type"), F.lit(": "), F.col("value")))
    return rows.join(totals.select(*[F.col(c).alias(c) for c in totals.columns]), of)


def mitre_matrix(threat_events: DataFrame) -> DataFrame:
    """Threat events by tactic × technique (display defaults for missing values)."""
    tactic = display(F.col("tactic"), rules.DISPLAY_DEFAULTS["tactic"])
    mitre = display(F.col("mitre_id"), rules.DISPLAY_DEFAULTS["mitre_id"])
    tech = display(F.col("technique_name"), rules.DISPLAY_DEFAULTS["technique_name"])
    return threat_events.groupBy(tactic.alias("tactic"), mitre.alias("mitre_id"), tech.alias("technique_name")).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("sample_count").cast("long").alias("samples"),
        F.max("confidence").alias("max_confidence"),
    )


def mitre_pivot(threat_events: DataFrame, tactics: Sequence[str] | None = None) -> DataFrame:
    """The matrix as a view: a row per technique, a column of event counts per tactic (``tactics``: the columns in their
    order; by default those that occur, which Spark limits by ``spark.sql.pivotMaxValues``)."""
    cells = mitre_matrix(threat_events).groupBy("mitre_id", "technique_name")
    return cells.pivot("tactic", list(tactics) if tactics is not None else None).agg(F.sum("events").cast("long")).na.fill(0)


def kb_query_text(
    clusters: DataFrame,
    summary: DataFrame,
    keys: Sequence[str] = ("log_id",),
    fallback_chars: int = rules.KB_QUERY_FALLBACK_CHARS,
) -> DataFrame:
    """First sha256, first domain and the first two keyword hits joined by a
    space; when all are absent, the first ``fallback_chars`` of the sample."""
    order = F.struct("first_chunk_ix", "first_ioc_ix")
    firsts = (
        summary.where(F.col("type").isin("sha256", "domain"))
        .groupBy(*keys, "cluster_id")
        .agg(
            F.min_by(F.when(F.col("type") == "sha256", F.col("value")), F.when(F.col("type") == "sha256", order)).alias("q_sha256"),
            F.min_by(F.when(F.col("type") == "domain", F.col("value")), F.when(F.col("type") == "domain", order)).alias("q_domain"),
        )
    )
    parts = F.concat(
        F.array_compact(F.array(F.col("q_sha256"), F.col("q_domain"))),
        F.slice(F.col("all_keyword_hits"), 1, 2),
    )
    q = F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(
        F.substring(F.col("representative_chunk"), 1, fallback_chars)
    )
    return clusters.join(firsts, [*keys, "cluster_id"], "left").select(*clusters.columns, q.alias("kb_query"))


def kb_context(
    hits: DataFrame,
    query_key: Sequence[str] = ("query_id",),
    max_chars: int = rules.KB_CONTEXT_MAX_CHARS,
) -> DataFrame:
    """Hit contents in rank order joined by the separator, cut at ``max_chars``.

    A query has at most k hits, so the per-query list is bounded by k.
    """
    docs = F.array_sort(F.collect_list(F.struct("rank", "content")))
    joined = F.array_join(F.transform(docs, lambda d: d["content"]), rules.KB_CONTEXT_SEPARATOR)
    out = hits.groupBy(*query_key).agg(joined.alias("ctx"))
    cut = F.when(
        F.length("ctx") > max_chars,
        F.concat(F.substring("ctx", 1, max_chars), F.lit(rules.KB_CONTEXT_TRUNCATION_MARK)),
    ).otherwise(F.col("ctx"))
    return out.select(*query_key, cut.alias("kb_context"))
