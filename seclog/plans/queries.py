"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the driver
tables (or views Spark derives from them), run on the whole tables.

Result columns are flat (strings, numbers, booleans, timestamps) and named
exactly like the matching DuckDB oracle in ``oracles.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..operators import intel, kb, report
from ..operators.chunking import chunk_text, spread
from ..operators.funnel import (
    cluster_counts,
    cluster_events,
    cluster_ids,
    cluster_key,
    cluster_windows,
    extract_iocs,
    extract_whole,
    filter_chunks,
    ioc_summary,
    merged_iocs,
    merged_keys,
    run_summary,
    suspicious,
)
from ..functions.iocs import ioc_rows
from ..operators.verdicts import attach_verdicts, parse_verdicts, threats
from ..sources.fixtures import FIXTURE_AS_OF
from ..session import cut_lineage
from ..sources.tables import table
from . import inputs
from .analyze import extract_iocs_job, summarize_logs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            inputs.session(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return run

    return deco


def _ioc_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, ioc_rows(F.col("iocs")))


# ------------------------------------------------------------------ chunking

@register("chunk_fixed")
def chunk_fixed(spark, sf):
    """Documents cut into 4000-character chunks."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunk_text(docs, keys=["doc_id"], size=rules.ANALYSIS_CHUNK_SIZE, overlap=0)


@register("chunk_overlap")
def chunk_overlap(spark, sf):
    """Documents cut into 500-character chunks overlapping by 50."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunk_text(docs, keys=["doc_id"], size=rules.KB_CHUNK_SIZE, overlap=rules.KB_CHUNK_OVERLAP)


@register("preview")
def preview_q(spark, sf):
    """The first 5000 characters of every document."""
    from ..functions.text import preview

    return table(spark, sf, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


# ------------------------------------------------------------------ extraction

def _make_ioc_query(types):
    def q(spark, sf):
        lines = spread(inputs.seclog_lines(spark, sf).select("event_id", "line"))
        return _ioc_rows(extract_iocs(lines, text_col="line", decode="none", types=types), ["event_id"])

    return q


for _t, _p, _ic, _g in rules.IOC_PATTERNS:
    register(f"ioc_{_t}")(_make_ioc_query([_t]))
register("ioc_all")(_make_ioc_query(None))


@register("ioc_ipv4_documents")
def ioc_ipv4_documents(spark, sf):
    """P19 shape: addresses over each whole document text (no chunking)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = extract_whole(docs, keys=["doc_id"], decode="none", types=["ipv4"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("type_ix", "block_ix", "ioc_ix")) - 1
    return found.select("doc_id", place.cast("int").alias("ioc_ix"), "type", "value", "confidence", "context")


@register("ioc_pages")
def ioc_pages(spark, sf):
    """All types over 4000-char chunks of raw web pages (positions/context stress)."""
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    ch = spread(chunk_text(pages, keys=["page_id"]))
    return _ioc_rows(extract_iocs(ch, decode="none"), ["page_id", "chunk_ix"])


@register("ioc_reference_decode")
def ioc_reference_decode(spark, sf):
    """All types over seclog lines after the full decode chain (URL, HTML, base64)."""
    lines = spread(inputs.seclog_lines(spark, sf).select("event_id", "line"))
    return _ioc_rows(extract_iocs(lines, text_col="line", decode="reference"), ["event_id"])


@register("extract_iocs_documents")
def extract_iocs_documents(spark, sf):
    """Per document, the indicator count over the whole decoded text."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("log_id"), "text")
    return extract_iocs_job(docs).withColumnRenamed("log_id", "doc_id")


# ------------------------------------------------------------------ decoding

@register("decode_url")
def decode_url(spark, sf):
    """X6 alone over seclog lines."""
    from ..functions.decode import url_unquote

    lines = inputs.seclog_lines(spark, sf)
    return lines.select("event_id", url_unquote(F.col("line")).alias("decoded"))


@register("decode_html")
def decode_html(spark, sf):
    """X7 alone over raw pages."""
    from ..functions.decode import html_unescape

    pages = spread(table(spark, sf, "pages").select("page_id", "html"))
    return pages.select("page_id", html_unescape(F.col("html")).alias("decoded"))


@register("decode_base64")
def decode_base64(spark, sf):
    """X8 alone over seclog lines (payload lines and hash lines)."""
    from ..functions.decode import base64_run_decode

    lines = inputs.seclog_lines(spark, sf)
    return lines.select("event_id", base64_run_decode(F.col("line")).alias("decoded"))


@register("decode_full")
def decode_full(spark, sf):
    """X6–X8 over documents and pages."""
    from ..functions.decode import with_decoded

    logs = spread(inputs.text_logs(spark, sf))
    return with_decoded(logs, "text").select("log_id", "decoded")


# ------------------------------------------------------------------ keywords / filter

@register("keyword_hits")
def keyword_hits_q(spark, sf):
    """P3 over seclog lines, document chunks and page chunks."""
    from ..functions.text import keyword_hits

    lines = inputs.seclog_lines(spark, sf).select(
        F.lit("seclog").alias("src"), F.col("event_id").alias("id"), F.lit(0).alias("chunk_ix"), F.col("line").alias("chunk")
    )
    docs = chunk_text(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), keys=["id"]).select(
        F.lit("documents").alias("src"), "id", "chunk_ix", "chunk"
    )
    pages = chunk_text(
        table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), keys=["id"]
    ).select(F.lit("pages").alias("src"), "id", "chunk_ix", "chunk")
    allc = lines.unionByName(docs).unionByName(pages)
    return allc.select("src", "id", "chunk_ix", F.posexplode(keyword_hits(F.col("chunk"))).alias("kw_ix", "keyword")).select(
        "src", "id", "chunk_ix", F.col("kw_ix").cast("int").alias("kw_ix"), "keyword"
    )


def _seclog_filtered(spark, sf, decode="none", context=rules.CONTEXT_WINDOW):
    return filter_chunks(spread(inputs.seclog_chunks(spark, sf)), decode=decode, context=context)


@register("suspicious")
def suspicious_q(spark, sf):
    """P4 per seclog line: indicator and keyword counts and the verdict of the rule filter."""
    f = _seclog_filtered(spark, sf)
    return f.select(
        "event_id",
        F.size("iocs").cast("int").alias("n_iocs"),
        F.size("keyword_hits").cast("int").alias("n_keywords"),
        "is_suspicious",
    )


# ------------------------------------------------------------------ clustering

def _seclog_keyed(spark, sf, decode="none", shared=False, context=rules.CONTEXT_WINDOW):
    """Suspicious seclog lines with cluster keys; ``shared``: written once (reliable checkpoint) for queries that read them
    more than once. ``context=None``: without contexts, for queries that do not show them."""
    keyed = cluster_key(suspicious(_seclog_filtered(spark, sf, decode, context)))
    return cut_lineage(keyed) if shared else keyed


@register("cluster_key")
def cluster_key_q(spark, sf):
    """A1 per suspicious seclog line."""
    return _seclog_keyed(spark, sf).select("event_id", "log_id", "src_ip", "signature", "cluster_id")


def _clusters(keyed):
    return cluster_events(keyed, first_cols=["event_id"])


@register("cluster_events")
def cluster_events_q(spark, sf):
    """One row per (log, cluster)."""
    c = _clusters(_seclog_keyed(spark, sf, shared=True, context=None))
    return c.select(
        "log_id",
        "cluster_id",
        "first_chunk_ix",
        "sample_count",
        "representative_chunk",
        F.array_join("all_keyword_hits", "|").alias("keyword_list"),
    )


@register("merged_iocs")
def merged_iocs_q(spark, sf):
    """Distinct (type, value) per cluster, first occurrence kept."""
    return merged_iocs(_seclog_keyed(spark, sf, shared=True))


@register("ioc_summary")
def ioc_summary_q(spark, sf):
    """Type → values in first-seen order, as rows."""
    return ioc_summary(merged_keys(_seclog_keyed(spark, sf, context=None)))


@register("cluster_window_300s")
def cluster_window_q(spark, sf):
    """Clusters within 300-second event-time windows."""
    return cluster_windows(_seclog_keyed(spark, sf), ts_col="ts")


@register("funnel_documents")
def funnel_documents(spark, sf):
    """E1 over documents and pages as log files (4000-char chunks, no decoding)."""
    return _funnel_clusters(spark, sf, "none")


@register("funnel_documents_decoded")
def funnel_documents_decoded(spark, sf):
    """E1 over documents and pages with the reference decode chain."""
    return _funnel_clusters(spark, sf, "reference")


def _funnel_clusters(spark, sf, decode):
    cut = chunk_text(inputs.text_logs(spark, sf), keys=["log_id"])
    # what the chunks' clusters need is written without their texts
    keyed = cut_lineage(cluster_ids(spread(cut), keys=["log_id", "chunk_ix"], decode=decode).where("cluster_id is not null"))
    c = cluster_events(keyed, chunks=cut)
    return c.select(
        "log_id",
        "cluster_id",
        "first_chunk_ix",
        "sample_count",
        F.md5("representative_chunk").alias("representative_md5"),
        F.array_join("all_keyword_hits", "|").alias("keyword_list"),
    )


# ------------------------------------------------------------------ verdicts and report

@register("parse_verdicts")
def parse_verdicts_q(spark, sf):
    """tolerant JSON ladder and verdict typing."""
    return parse_verdicts(spread(inputs.verdict_raw(spark, sf)), keep=["log_id", "cluster_no"])


def _seclog_events(spark, sf, shared=False):
    """(analysed events, merged indicators): clusters with verdicts attached (J4) and their merged-indicator counts. Only keys
    and values are written in between: no lines, no contexts. ``shared``: both are written once as well (reliable checkpoints), for
    queries that read them more than once."""
    lines = _seclog_keyed(spark, sf, context=None)
    keyed = cut_lineage(lines.select("log_id", "chunk_ix", "cluster_id", F.transform("iocs", lambda i: F.struct(i["type"].alias("type"), i["value"].alias("value"), i["confidence"].alias("confidence"), i["context"].alias("context"))).alias("iocs")))
    verdicts = parse_verdicts(spread(inputs.verdict_raw(spark, sf)), keep=["log_id", "cluster_no"])
    events = attach_verdicts(cluster_counts(keyed), verdicts, on=[("log_id", "log_id"), ("first_chunk_ix", "cluster_no")])
    merged = merged_keys(keyed)
    if shared:
        merged = cut_lineage(merged)
    counts = merged.groupBy("log_id", "cluster_id").agg(F.count(F.lit(1)).alias("merged_count"))
    events = events.join(counts, ["log_id", "cluster_id"], "left").withColumn(
        "n_iocs", F.when(F.col("error").isNull(), F.coalesce("merged_count", F.lit(0))).otherwise(F.lit(0)).cast("long")
    )
    return (cut_lineage(events) if shared else events), merged


@register("threats")
def threats_q(spark, sf):
    """P8 + J4: threat events (is_threat and no error) of the seclog clusters."""
    events, _m = _seclog_events(spark, sf)
    return threats(events).select(
        "log_id", "cluster_id", "sample_count", "attack_type", "mitre_id", "tactic", "technique_name", "confidence"
    )


@register("run_summary")
def run_summary_q(spark, sf):
    """One row per seclog log (user), clean logs included."""
    events, _m = _seclog_events(spark, sf)
    # read for the clusters and for the verdicts: attached and written once
    events = cut_lineage(events.select("log_id", "cluster_id", "sample_count", "is_threat", "error", "n_iocs"))
    lines = inputs.seclog_chunks(spark, sf)
    totals = lines.groupBy("log_id").agg(F.count(F.lit(1)).alias("total_chunks_processed"))
    return run_summary(totals, None, events.select("log_id", "cluster_id", "sample_count"), events.select("log_id", "cluster_id", "is_threat", "error", "n_iocs"))


@register("risk_band")
def risk_band_q(spark, sf):
    """P15 over threat events."""
    events, _m = _seclog_events(spark, sf)
    return threats(events).select("log_id", "cluster_id", "confidence", report.risk_band(F.col("confidence")).alias("risk_band"))


@register("event_display")
def event_display_q(spark, sf):
    """P16 over all analysed events (display defaults for failed verdicts)."""
    events, _m = _seclog_events(spark, sf)
    d = report.event_display(events)
    return d.select(
        "log_id",
        "cluster_id",
        *[f"{k}_display" for k in rules.DISPLAY_DEFAULTS],
        "risk_band",
        "ioc_text",
        "n_iocs",
    )


@register("mitre_matrix")
def mitre_matrix_q(spark, sf):
    """Threat events by tactic × technique."""
    events, _m = _seclog_events(spark, sf)
    return report.mitre_matrix(threats(events))


@register("mitre_pivot")
def mitre_pivot_q(spark, sf):
    """A11 as a view: events by technique (rows) and tactic (columns)."""
    events, _m = _seclog_events(spark, sf)
    return report.mitre_pivot(threats(events), [f"tac{i}" for i in range(3)])


@register("result_sink")
def result_sink_q(spark, sf):
    """Run rows, events and their indicators written as JSON lines and read again; one row per log with what the files hold."""
    from ..session import checkpoint_dir
    from ..sources.logs import write_result

    events, merged = _seclog_events(spark, sf, shared=True)
    totals = inputs.seclog_chunks(spark, sf).groupBy("log_id").agg(F.count(F.lit(1)).alias("total_chunks_processed"))
    runs = run_summary(totals, None, events.select("log_id", "cluster_id", "sample_count"), events.select("log_id", "cluster_id", "is_threat", "error", "n_iocs"))
    path = f"{checkpoint_dir(spark)}/result-{uuid.uuid4().hex}"
    write_result(runs, path, events.drop("merged_count"), merged)
    back = lambda name, df: spark.read.schema(df.schema).json(f"{path}/{name}")
    events_in = back("events", events.drop("merged_count")).groupBy("log_id").agg(F.count("*").alias("events"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    iocs_in = back("iocs", merged).groupBy("log_id").agg(F.count("*").alias("iocs"), F.sum(F.length("value")).alias("ioc_chars"))
    out = back("runs", runs).join(events_in, "log_id", "left").join(iocs_in, "log_id", "left")
    return out.select("log_id", "summary", "threat_events", "total_iocs", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("events", "iocs", "ioc_chars")], F.round("confidence", 6).alias("confidence"))


@register("report_events")
def report_events_q(spark, sf):
    """One row per threat event with its IOC count, display fields and risk band."""
    events, _m = _seclog_events(spark, sf)
    t = report.event_display(threats(events))
    return t.select(
        "log_id",
        "cluster_id",
        "sample_count",
        "attack_type_display",
        "mitre_id_display",
        "tactic_display",
        "technique_name_display",
        "confidence",
        "risk_band",
        "evidence_display",
        "recommendation_display",
        "n_iocs",
    ).orderBy(F.col("confidence").desc(), "log_id", "cluster_id")


# ------------------------------------------------------------------ enrichment

def _reputation(spark, sf):
    raw = inputs.reputation_raw(spark, sf)
    snap = intel.fresh_snapshot(raw, ["ioc_type", "ioc_value"], FIXTURE_AS_OF, rules.REPUTATION_TTL_SEC)
    return intel.project_reputation(snap)


def _registration(spark, sf):
    raw = intel.with_clean_domain(inputs.registration_raw(spark, sf))
    snap = intel.fresh_snapshot(raw, ["domain"], FIXTURE_AS_OF, rules.REGISTRATION_TTL_SEC)
    return intel.project_registration(snap)


@register("fresh_snapshot")
def fresh_snapshot_q(spark, sf):
    """W4 + F7: latest fresh reputation response per key, projected."""
    r = _reputation(spark, sf)
    return r.select(
        "ioc_type",
        "ioc_value",
        "found",
        "malicious_count",
        "suspicious_count",
        "community_score",
        "first_seen",
        F.array_join("tags", ",").alias("tags"),
        "error",
        "fetched_at",
    )


@register("registration_snapshot")
def registration_snapshot_q(spark, sf):
    """W4 + F4 + F8/F9: latest fresh registration response per domain, projected."""
    r = _registration(spark, sf)
    return r.select(
        "domain",
        "source",
        "registrar",
        "creation_date",
        "expiration_date",
        F.array_join("name_servers", ",").alias("name_servers"),
        "status",
        "error",
    )


@register("fresh_snapshot_no_errors")
def fresh_snapshot_no_errors_q(spark, sf):
    """W4 with D12 mended: failures are not remembered, so an older answer of the key counts."""
    snap = intel.fresh_snapshot(inputs.reputation_raw(spark, sf), ["ioc_type", "ioc_value"], FIXTURE_AS_OF, 6 * rules.REPUTATION_TTL_SEC, drop_errors=True)
    return intel.project_reputation(snap).select("ioc_type", "ioc_value", "found", "malicious_count", "error", "fetched_at")


def _stored_responses(spark, sf):
    """The reputation responses as a lake would hold them: JSON files, some bodies cut off on the way."""
    from ..session import checkpoint_dir
    from ..sources.logs import read_responses

    path = f"{checkpoint_dir(spark)}/responses-{uuid.uuid4().hex}"
    raw = inputs.reputation_raw(spark, sf).withColumn("fetched_at", F.col("fetched_at").cast("string"))
    cut = F.when(F.length("ioc_value") % 4 == 3, F.substring("body", 1, 20)).otherwise(F.col("body"))
    raw.withColumn("body", cut).write.json(path)
    schema = "ioc_type string, ioc_value string, http_status int, body string, fetched_at string"
    good, bad = read_responses(spark, path, ["ioc_type", "ioc_value"], "json", schema)
    return good.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), bad


@register("read_responses")
def read_responses_q(spark, sf):
    """Responses read from files, those with a broken body in quarantine."""
    good, bad = _stored_responses(spark, sf)
    cols = ["ioc_type", "ioc_value", "http_status"]
    return good.select(*cols, F.lit("ok").alias("state")).unionByName(bad.select(*cols, F.col("reason").alias("state")))


@register("enrich_stored")
def enrich_stored_q(spark, sf):
    """S10 + W4 + J1: the fresh part of stored responses as a table bucketed by key, joined to the merged indicators; the snapshot
    is not shuffled."""
    from ..session import checkpoint_dir
    from ..sources.logs import write_snapshot

    good, _bad = _stored_responses(spark, sf)
    name = f"reputation_{uuid.uuid4().hex}"
    fresh = intel.project_reputation(intel.fresh_snapshot(good, ["ioc_type", "ioc_value"], FIXTURE_AS_OF, rules.REPUTATION_TTL_SEC))
    snapshot = write_snapshot(fresh, name, f"{checkpoint_dir(spark)}/{name}", ["ioc_type", "ioc_value"])
    e = intel.enrich_reputation(merged_keys(_seclog_keyed(spark, sf, context=None)), snapshot)
    return e.select("log_id", "cluster_id", "type", "value", "route", "vt_found", "vt_malicious_count", "vt_error")


@register("enrich_reputation")
def enrich_reputation_q(spark, sf):
    """Every merged indicator of every cluster, with reputation when known."""
    merged = merged_keys(_seclog_keyed(spark, sf, context=None))
    e = intel.enrich_reputation(merged, _reputation(spark, sf))
    return e.select(
        "log_id", "cluster_id", "type", "value", "route", "vt_found", "vt_malicious_count", "vt_suspicious_count", "vt_error"
    )


@register("enrich_registration")
def enrich_registration_q(spark, sf):
    """Domain indicators with their registration record."""
    merged = merged_keys(_seclog_keyed(spark, sf, context=None)).where(F.col("type") == "domain")
    e = intel.enrich_registration(merged, _registration(spark, sf))
    return e.select("log_id", "cluster_id", "value", "whois_registrar", "whois_creation_date", "whois_error")


@register("enrich_events")
def enrich_events_q(spark, sf):
    """Indicators of threat events with reputation and registration fields."""
    events, merged = _seclog_events(spark, sf)
    t = threats(events).select("log_id", "cluster_id")
    rows = merged.join(t, ["log_id", "cluster_id"], "left_semi")
    e = intel.enrich_registration(intel.enrich_reputation(rows, _reputation(spark, sf)), _registration(spark, sf))
    return e.select(
        "log_id",
        "cluster_id",
        "first_chunk_ix",
        "first_ioc_ix",
        "type",
        "value",
        "route",
        "vt_found",
        "vt_malicious_count",
        "vt_error",
        "whois_registrar",
        "whois_error",
    )


@register("report_iocs")
def report_iocs_q(spark, sf):
    """One row per indicator of a threat event: display line, risk band, intelligence, and the event's total of
    malicious votes, with the list order in columns."""
    events, merged = _seclog_events(spark, sf)
    return report.report_iocs(threats(events), merged, _reputation(spark, sf), _registration(spark, sf)).select(
        "log_id", "cluster_id", "first_chunk_ix", "first_ioc_ix", "line", "route", "risk_band", "vt_found", "vt_malicious_count",
        "vt_community_score", F.array_join("vt_tags", ",").alias("vt_tags"), "vt_error", "whois_registrar", "whois_creation_date",
        F.array_join("whois_name_servers", ",").alias("whois_name_servers"), "whois_error", "event_malicious",
    )


@register("registration_worklist")
def registration_worklist_q(spark, sf):
    """C11: domains without a fresh registration response."""
    raw = intel.with_clean_domain(inputs.registration_raw(spark, sf))
    return intel.registration_worklist(merged_keys(_seclog_keyed(spark, sf, context=None)), intel.fresh(raw, FIXTURE_AS_OF, rules.REGISTRATION_TTL_SEC))


@register("lookup_worklist")
def lookup_worklist_q(spark, sf):
    """C11: routable indicators without a fresh reputation response."""
    merged = merged_keys(_seclog_keyed(spark, sf, context=None))
    snap = intel.fresh(inputs.reputation_raw(spark, sf), FIXTURE_AS_OF, rules.REPUTATION_TTL_SEC)
    return intel.lookup_worklist(merged, snap)


# ------------------------------------------------------------------ knowledge base

def _existing_kb(spark, sf):
    bench = inputs.kb_benchmark_files(spark, sf)
    return cut_lineage(kb.kb_upsert(None, kb.kb_chunks(kb.kb_new_docs(bench))))


def _doc_index(spark, sf):
    files = inputs.kb_document_files(spark, sf)
    existing = _existing_kb(spark, sf)
    new = kb.kb_new_docs(files, existing)
    chunks = kb.kb_chunks(new)
    return files, existing, new, chunks


@register("kb_new_docs")
def kb_new_docs_q(spark, sf):
    """Documents to index (first of each content hash, not in the KB yet)."""
    files = inputs.kb_document_files(spark, sf)
    keys = kb.kb_new_keys(files, _existing_kb(spark, sf)).select("file_order", "content_hash")
    return files.select("file_order", "file_id", "source").join(keys, "file_order")


@register("kb_chunks")
def kb_chunks_q(spark, sf):
    """500/50 chunks of the new documents with ids and metadata."""
    _f, _e, _n, chunks = _doc_index(spark, sf)
    return chunks.select("id", "file_order", "file_id", "chunk_index", "content_hash", "source", "content")


@register("kb_upsert")
def kb_upsert_q(spark, sf):
    """KB after indexing the documents (last write of an id wins)."""
    _f, existing, _n, chunks = _doc_index(spark, sf)
    return kb.kb_upsert(existing, chunks).select("id", "file_id", "chunk_index", "content_hash", "source", "content")


@register("kb_delete")
def kb_delete_q(spark, sf):
    """The upserted KB with the benchmark files deleted again."""
    _f, existing, _n, chunks = _doc_index(spark, sf)
    full = kb.kb_upsert(existing, chunks)
    return kb.kb_delete(full, existing.select("file_id")).select("id", "file_id", "chunk_index", "content_hash", "source")


@register("kb_files")
def kb_files_q(spark, sf):
    """Files in the upserted KB with chunk counts."""
    _f, existing, _n, chunks = _doc_index(spark, sf)
    return kb.kb_files(kb.kb_upsert(existing, chunks).select("file_id", "chunk_index", "source", "content_hash"))


@register("kb_index_report")
def kb_index_report_q(spark, sf):
    """Per document success / skipped / error."""
    files, existing, _n, chunks = _doc_index(spark, sf)
    return kb.kb_index_report(files, chunks, existing)


def _letters(content):
    """A vector of letter counts: an ``embed`` function that SQL can repeat."""
    return F.array(*[(F.length(content) - F.length(F.replace(content, F.lit(c), F.lit("")))).cast("float") for c in "aeiorst"])


@register("kb_end_to_end")
def kb_end_to_end_q(spark, sf):
    """E4 + J3 + P12: files read as KB documents, indexed with vectors, written as a version and read again; the context
    that each file's first chunk finds in the whole KB."""
    from ..session import checkpoint_dir
    from ..sources.logs import read_kb_docs
    from .analyze import index_kb

    files = read_kb_docs(spark, f"{_stage_documents_as_files(spark, sf)}/src", recursive=True)
    files = files.withColumn("file_id", F.concat(F.lit("log"), F.regexp_extract("file_order", r"log_no=(\d+)", 1)))
    new, _report = index_kb(files, embed=_letters)
    stored = kb.read_kb(spark, kb.write_kb(new, checkpoint_dir(spark)))
    rows = stored.where("exists(embedding, x -> x != 0)").withColumn("home", F.col("file_id")).withColumn("file_id", F.lit(rules.KB_DEFAULT_FILE_ID))
    asked = rows.where("chunk_index = 0").select(F.col("home").alias("query_id"), "file_id", F.col("embedding").alias("vector"))
    hits = kb.kb_topk(asked, rows.select("id", "file_id", "embedding"), k=rules.KB_ANALYSIS_TOP_K)
    found = hits.join(stored.select("id", "content"), "id")
    return report.kb_context(found).select("query_id", F.length("kb_context").alias("n_chars"), F.md5("kb_context").alias("context_md5"))


@register("kb_query_text")
def kb_query_text_q(spark, sf):
    """Knowledge-base query text per seclog cluster."""
    keyed = _seclog_keyed(spark, sf, shared=True, context=None)
    clusters = _clusters(keyed)
    return report.kb_query_text(clusters, ioc_summary(merged_keys(keyed))).select("log_id", "cluster_id", "kb_query")


@register("enhance_query")
def enhance_query_q(spark, sf):
    """P10: enhancement of each cluster's KB query (indicator values or SOC suffix)."""
    keyed = _seclog_keyed(spark, sf, shared=True, context=None)
    q = report.kb_query_text(_clusters(keyed), ioc_summary(merged_keys(keyed)))
    return kb.enhance_query(q.select("log_id", "cluster_id", "kb_query")).select(
        "log_id", "cluster_id", "kb_query", "enhanced_query"
    )


def _vector_queries(spark, sf):
    """Each vector asks its own file, every tenth one the next file too, and some queries have no vector."""
    e = inputs.embedding_kb(spark, sf).select(F.col("id").alias("query_id"), "file_id", F.col("embedding").alias("vector"))
    other = e.where("query_id % 10 = 0").withColumn("file_id", F.col("file_id") + 1)
    blank = e.where("query_id % 10 = 1").select(-F.col("query_id"), "file_id", F.lit(None).cast("array<float>"))
    return e.unionByName(other).union(blank)


@register("kb_topk")
def kb_topk_q(spark, sf):
    """Exact cosine top-5 of every vector among the vectors of its label."""
    hits = kb.kb_topk(_vector_queries(spark, sf), inputs.embedding_kb(spark, sf), k=rules.KB_TOP_K)
    return hits.select(
        "query_id", F.col("rank").cast("int").alias("rank"), "id", "file_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance")
    )


@register("kb_topk_lsh")
def kb_topk_lsh_q(spark, sf):
    """J3 at scale: the queries of ``kb_topk`` by random-hyperplane buckets with exact distances (recall is tested)."""
    hits = kb.kb_topk_lsh(_vector_queries(spark, sf), inputs.embedding_kb(spark, sf), dims=64, k=rules.KB_TOP_K)
    return hits.select(
        "query_id", F.col("rank").cast("int").alias("rank"), "id", "file_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance")
    )


@register("kb_versions")
def kb_versions_q(spark, sf):
    """A store in three versions: the benchmark files, the documents upserted, every second benchmark file deleted. The
    newest version's rows, and in which version each was there already."""
    from ..session import checkpoint_dir

    store = kb.KbStore(spark, f"{checkpoint_dir(spark)}/kb-{uuid.uuid4().hex}")
    store.upsert(kb.kb_chunks(kb.kb_new_docs(inputs.kb_benchmark_files(spark, sf))))
    first = store.read(1, with_embedding=False)
    new = kb.kb_new_docs(inputs.kb_document_files(spark, sf), first)
    store.upsert(kb.kb_chunks(new))
    store.delete(first.select("file_id").where("cast(substring(file_id, 6) as int) % 2 = 0"))
    known = first.select("id", F.lit(True).alias("in_first"))
    rows = store.read(with_embedding=False).join(known, "id", "left")
    return rows.select("id", "file_id", "chunk_index", "content_hash", "source", F.md5("content").alias("content_md5"), F.coalesce("in_first", F.lit(False)).alias("in_first"))


@register("kb_embed_batches")
def kb_embed_batches_q(spark, sf):
    """Vectors of the benchmark files' chunks by a function that takes texts in batches."""
    chunks = kb.kb_chunks(kb.kb_new_docs(inputs.kb_benchmark_files(spark, sf)), embed=kb.embed_in_batches(_letter_counter))
    return chunks.select("id", *[F.col("embedding")[i].cast("int").alias(f"n_{c}") for i, c in enumerate("aeiorst")])


def _letter_counter():
    return lambda texts: [[float(t.count(c)) for c in "aeiorst"] for t in texts]


@register("kb_context")
def kb_context_q(spark, sf):
    """Context text from each query's top-3 hits in its file; some contexts are cut."""
    hits = kb.kb_topk(_vector_queries(spark, sf), inputs.embedding_kb(spark, sf), k=rules.KB_ANALYSIS_TOP_K)
    hits = hits.withColumn("content", F.concat(F.lit("vec "), F.col("id").cast("string"), F.lit(" "), F.expr("repeat('x', cast(id % 3 * 400 as int))")))
    return report.kb_context(hits, query_key=("query_id", "file_id"))


# ------------------------------------------------------------------ whole chain

@register("analyze_logs")
def analyze_logs_q(spark, sf):
    """E1 roll-up over documents and pages as log files: one result row per log."""
    return summarize_logs(inputs.text_logs(spark, sf), decode="none")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


# ------------------------------------------------------------------ intake and streaming

#: Documents in each staged log file.
DOCS_PER_LOG = 25


def _stage_documents_as_files(spark, sf) -> str:
    """Spark writes the documents as log files of ``DOCS_PER_LOG`` neighbouring ids (``log_no=N/part-*.txt``)
    under the shared checkpoint folder; returns the folder."""
    from ..session import checkpoint_dir

    root = f"{checkpoint_dir(spark)}/intake-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", "text", F.expr(f"doc_id div {DOCS_PER_LOG}").alias("log_no"))
    whole = docs.repartition("log_no").sortWithinPartitions("log_no", "doc_id").select("text", "log_no")
    whole.write.partitionBy("log_no").text(f"{root}/src")
    return root


@register("stream_logs")
def stream_logs_q(spark, sf):
    """Documents written as log files, picked up by a binaryFile
    stream (availableNow), admitted, decoded and analysed per micro-batch;
    returns the run rows the stream wrote (decode off, so SQL can check it)."""
    from ..streaming.intake import stream_logs

    root = _stage_documents_as_files(spark, sf)
    q = stream_logs(spark, f"{root}/src", f"{root}/out", f"{root}/chk", decode="none", extensions=("txt",))
    q.awaitTermination()
    runs = spark.read.parquet(f"{root}/out/runs")
    return runs.select(
        F.regexp_extract("log_id", r"log_no=(\d+)", 1).cast("long").alias("log_no"),
        "summary",
        "total_chunks_processed",
        "suspicious_chunks",
        "clustered_events",
    )


@register("read_logs")
def read_logs_q(spark, sf):
    """Batch binaryFile scan of the same staged files, admission and charset decode."""
    from ..sources.logs import admit_logs, logs_from_files, read_logs

    root = _stage_documents_as_files(spark, sf)
    accepted, _rejected = admit_logs(read_logs(spark, f"{root}/src"))
    logs = logs_from_files(accepted)
    return logs.select(
        F.regexp_extract("log_id", r"log_no=(\d+)", 1).cast("long").alias("log_no"),
        F.length("text").cast("long").alias("n_chars"),
        F.md5("text").alias("text_md5"),
    )


@register("stream_cluster_window_300s")
def stream_cluster_window_q(spark, sf):
    """C10 as a stream: the events table read by a file stream (availableNow),
    seclog lines clustered in 300-second windows with a 10-minute watermark,
    append mode into parquet; returns what the stream emitted (every window
    closed by the final watermark)."""
    from ..session import checkpoint_dir
    from ..sources.fixtures import fixture
    from ..streaming.intake import stream_cluster_windows

    root = f"{checkpoint_dir(spark)}/windows-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    lines = fixture(spark, "seclog", events).select(
        F.col("user_id").alias("log_id"), F.col("event_id").alias("chunk_ix"), F.col("line").alias("chunk"), "ts"
    )
    q = (
        stream_cluster_windows(lines, decode="none")
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/chk")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


#: The stream of responses: how many minutes after its cluster one arrives (too late for an hour's wait at 80), by event.
_ANSWER_MINUTES = "cast(event_id % 3 * 40 as int)"


@register("stream_verdicts")
def stream_verdicts_q(spark, sf):
    """S11/J4 as a stream: clusters and the responses that arrive later, joined with watermarks; a cluster without an answer
    within the hour ends with the error of a missing one. Returns what the stream emitted."""
    from ..session import checkpoint_dir
    from ..streaming.intake import stream_verdicts

    root = f"{checkpoint_dir(spark)}/verdicts-{uuid.uuid4().hex}"
    lines = _seclog_keyed(spark, sf, context=None)
    first = lines.groupBy("log_id", "cluster_id").agg(F.min("event_id").alias("event_id"))
    at = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("seen_at"))
    clusters = cut_lineage(first.join(at, "event_id"))
    answers = clusters.where("event_id % 5 != 4").join(inputs.verdict_raw(spark, sf).select(F.col("cluster_no").alias("event_id"), "raw"), "event_id")
    answers = answers.select("log_id", "cluster_id", "raw", F.expr(f"seen_at + make_dt_interval(0, 0, {_ANSWER_MINUTES})").alias("answered_at"))
    clusters.select("log_id", "cluster_id", "event_id", "seen_at").write.parquet(f"{root}/clusters")
    answers.write.parquet(f"{root}/answers")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{root}/{name}").schema).parquet(f"{root}/{name}")
    out = stream_verdicts(read("clusters"), read("answers"))
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/chk").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out").select("log_id", "cluster_id", "event_id", "is_threat", "attack_type", "confidence", "error")


@register("stream_worklist")
def stream_worklist_q(spark, sf):
    """C11/W4 as a stream: the indicators of the log lines in three runs of the stream, by time; each key is asked for once per time
    to live."""
    from ..session import checkpoint_dir
    from ..streaming.intake import stream_worklist

    root = f"{checkpoint_dir(spark)}/worklist-{uuid.uuid4().hex}"
    lines = _seclog_filtered(spark, sf, context=None).select("event_id", F.col("ts").cast("timestamp").alias("ts"), ioc_rows(F.col("iocs")))
    rows = cut_lineage(lines.select("ts", "type", "value"))
    low, high = rows.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    part = F.least(F.floor((F.col("ts").cast("double") - F.lit(low or 0.0)) / F.lit(((high or 0.0) - (low or 0.0)) / 3 + 1)), F.lit(2))
    for i in range(3):
        rows.where(part == i).write.mode("append").parquet(f"{root}/in")
        asks = stream_worklist(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
        q = asks.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/chk").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(asks.schema).parquet(f"{root}/out").select("ioc_type", "ioc_value", F.col("asked_at").cast("string").alias("asked_at"))
