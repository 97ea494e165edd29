"""The analysis funnel: indicators and keywords per chunk, suspicious filter,
clustering, merged indicators and per-log run summary.

Everything is keyed explicitly by ``(log_id, chunk_ix, ioc_ix)``; list order
of the original is carried in those columns, never in row order.

Skew: the ``unknown:ioc_only`` cluster may hold most chunks of a log. All
cluster aggregates are partial-aggregatable (``count``, ``min``, ``min_by``),
so a hot cluster is pre-aggregated on the map side; no aggregate collects the
chunks of a cluster into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.decode import with_decoded
from ..functions.iocs import IOC_ARRAY, any_indicator, first_address, ioc_rows, is_blank, iocs_from_decoded, keys_from_decoded, select_patterns
from ..functions.text import keyword_hits
from .chunking import at_least_spread, spread, text_blocks


def extract_iocs(
    df: DataFrame,
    text_col: str = "chunk",
    out: str = "iocs",
    decode: str = "reference",
    context: int = rules.CONTEXT_WINDOW,
    types: Sequence[str] | None = None,
    keep_decoded: bool = False,
) -> DataFrame:
    """Adds ``out: array<struct<type,value,confidence,context>>``.

    The decoded text is a column of its own so the decode chain is evaluated
    once per row and the 11 pattern scans read the materialised value.
    """
    return _extract(df, text_col, {out: None}, decode, context, types, keep_decoded)


def _extract(df, text_col, outs, decode, context=rules.CONTEXT_WINDOW, types=None, keep_decoded=False, keywords=None):
    """Shared body: decode, then emit the computed columns through a one-row
    ``inline`` generator.

    The generator is an optimisation barrier on purpose: a later filter on
    ``iocs``/``is_suspicious`` cannot be pushed below it, so Catalyst does
    not copy the extraction expression into a pushed-down predicate (which
    would run it twice, and before any rebalancing shuffle).
    """
    raw = F.col(text_col)
    staged = with_decoded(df, text_col, "decoded", decode)
    found = F.when(is_blank(raw), F.array().cast(IOC_ARRAY)).otherwise(
        iocs_from_decoded("decoded", context=context, types=types)
    )
    fields = []
    for name in outs:
        if name == "keyword_hits":
            fields.append(keyword_hits(raw, keywords if keywords is not None else tuple(rules.SUSPICIOUS_KEYWORDS)).alias(name))
        else:
            fields.append(found.alias(name))
    keep = [c for c in staged.columns if keep_decoded or c != "decoded"]
    return staged.select(*keep, F.inline(F.array(F.struct(*fields))))


#: The one type whose matches may hold blanks (a header, any white space, and part of a line).
_WITH_BLANKS = "user_agent"


def _whole_blocks(texts: DataFrame, keys: Sequence[str], text_col: str, decode: str, types: Sequence[str] | None, context: int, of_text) -> tuple[DataFrame, list[str]]:
    """(blocks of the decoded texts, the types to look for in them). A text with a user-agent header has one block more, numbered
    -1 and empty, with what ``of_text`` finds for that type in the whole text (column ``ready``; else empty)."""
    wanted = [t for t, *_ in select_patterns(types)]
    # few large splits would leave the decoding to a task or two
    staged = with_decoded(at_least_spread(texts), text_col, "decoded", decode)
    staged = staged.where(~is_blank(F.col(text_col))).select(*keys, "decoded")
    blocks = text_blocks(F.col("decoded"), around=context)
    if _WITH_BLANKS in wanted:
        found = of_text("decoded", [_WITH_BLANKS])
        kind = staged.select(found.alias("f")).schema["f"].dataType
        empty = F.lit("")
        blocks = F.transform(blocks, lambda b: F.struct(b["block_ix"].alias("block_ix"), b["lead"].alias("lead"), b["block"].alias("block"), b["trail"].alias("trail"), F.array().cast(kind).alias("ready")))
        whole = F.transform(F.array(found), lambda f: F.struct(F.lit(-1).alias("block_ix"), empty.alias("lead"), empty.alias("block"), empty.alias("trail"), f.alias("ready")))
        blocks = F.concat(F.filter(whole, lambda w: F.size(w["ready"]) > 0), blocks)
    return spread(staged.select(*keys, F.inline(blocks))), [t for t in wanted if t != _WITH_BLANKS]


def extract_whole(
    texts: DataFrame,
    keys: Sequence[str] = ("log_id",),
    text_col: str = "text",
    decode: str = "reference",
    types: Sequence[str] | None = None,
    context: int = rules.CONTEXT_WINDOW,
) -> DataFrame:
    """Indicators of whole texts of any length, as rows ``keys…, type_ix, block_ix, ioc_ix, type, value, confidence, context``.

    The same rows as one search of the whole decoded text. It is cut after blanks into blocks that know what stands
    around them, the blocks are dealt evenly, and each is searched by itself, so a giant text is the work of many tasks and costs
    time in proportion to its length. Only user agents may hold blanks; they are looked for in the text before it is cut, which
    for a text without their header is no work. Of each ``(type, lower(value))`` the first occurrence stays; list order
    is ``(type_ix, block_ix, ioc_ix)``.
    """
    blocks, inside = _whole_blocks(texts, keys, text_col, decode, types, context, lambda x, t: iocs_from_decoded(x, context=context, types=t))
    found = iocs_from_decoded("block", context=context, types=inside, around=("lead", "trail")) if inside else F.array().cast(IOC_ARRAY)
    if "ready" in blocks.columns:
        found = F.concat("ready", found)
    rows = blocks.select(*keys, "block_ix", F.inline(F.array(F.struct(found.alias("iocs"))))).select(*keys, "block_ix", ioc_rows(F.col("iocs")))
    order = F.array(*[F.lit(t) for t, *_ in rules.IOC_PATTERNS])
    rows = rows.withColumn("type_ix", F.array_position(order, F.col("type")).cast("int") - 1)
    first = Window.partitionBy(*keys, "type", F.lower("value")).orderBy("block_ix", "ioc_ix")
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def count_whole(texts: DataFrame, keys: Sequence[str] = ("log_id",), text_col: str = "text", decode: str = "reference", types: Sequence[str] | None = None) -> DataFrame:
    """``keys…, total_iocs_found``: how many rows :func:`extract_whole` has for each text that has any. Only distinct (type,
    value) are made and shuffled, no contexts."""
    blocks, inside = _whole_blocks(texts, keys, text_col, decode, types, 0, lambda x, t: keys_from_decoded(x, types=t))
    parts = ([keys_from_decoded("block", types=inside)] if inside else []) + ([F.transform("ready", lambda r: F.struct(F.lit(-1).alias("type_ix"), r["key"].alias("key")))] if "ready" in blocks.columns else [])
    found = blocks.select(*keys, F.inline(F.concat(*parts))).distinct()
    return found.groupBy(*keys).agg(F.count("*").alias("total_iocs_found"))


def filter_chunks(
    chunks: DataFrame,
    text_col: str = "chunk",
    decode: str = "reference",
    keywords: Sequence[str] = tuple(rules.SUSPICIOUS_KEYWORDS),
    context: int | None = rules.CONTEXT_WINDOW,
) -> DataFrame:
    """Rule filter per chunk: ``iocs``, ``keyword_hits`` (raw text), ``is_suspicious``. ``context=None``: indicators without
    contexts, for what only counts or joins them."""
    res = _extract(chunks, text_col, {"iocs": None, "keyword_hits": None}, decode, context, keywords=keywords)
    return res.withColumn("is_suspicious", (F.size("iocs") > 0) | (F.size("keyword_hits") > 0))


def suspicious(filtered: DataFrame) -> DataFrame:
    return filtered.where(F.col("is_suspicious"))


def first_ip(iocs: Column) -> Column:
    return F.get(F.filter(iocs, lambda i: i["type"] == "ipv4"), 0)["value"]


def signature(hits: Column) -> Column:
    return F.when(F.size(hits) > 0, F.array_join(F.array_sort(hits), "|")).otherwise(F.lit(rules.CLUSTER_IOC_ONLY))


def cluster_key(df: DataFrame) -> DataFrame:
    """``src_ip`` (first ipv4 or 'unknown'), ``signature``, ``cluster_id`` = md5(ip:sig)[:12]."""
    ip = F.coalesce(first_ip(F.col("iocs")), F.lit(rules.CLUSTER_UNKNOWN_IP))
    sig = signature(F.col("keyword_hits"))
    cid = F.substring(F.md5(F.concat_ws(":", ip, sig)), 1, rules.CLUSTER_ID_LENGTH)
    # one projection (one analysis pass over the large upstream plan)
    return df.withColumns({"src_ip": ip, "signature": sig, "cluster_id": cid})


def cluster_ids(chunks: DataFrame, keys: Sequence[str] = ("log_id",), text_col: str = "chunk", decode: str = "reference") -> DataFrame:
    """``keys…, cluster_id, keyword_hits`` for each chunk, the id null for one that is not suspicious: what clusters need, found
    without building the indicators."""
    raw = F.col(text_col)
    x = F.col("decoded")
    staged = with_decoded(chunks, text_col, "decoded", decode)
    # out of a generator, so that the three columns are computed once and before what is done with them
    parts = staged.select(*keys, F.inline(F.array(F.struct(any_indicator(x).alias("_any"), first_address(x).alias("_ip"), keyword_hits(raw).alias("keyword_hits")))))
    cid = F.substring(F.md5(F.concat_ws(":", F.coalesce("_ip", F.lit(rules.CLUSTER_UNKNOWN_IP)), signature(F.col("keyword_hits")))), 1, rules.CLUSTER_ID_LENGTH)
    return parts.select(*keys, F.when(F.col("_any") | (F.size("keyword_hits") > 0), cid).alias("cluster_id"), "keyword_hits")


def cluster_counts(keyed: DataFrame, keys: Sequence[str] = ("log_id",)) -> DataFrame:
    """``keys…, cluster_id, first_chunk_ix, sample_count``: a hash aggregate over narrow rows, pre-aggregated where they are."""
    return keyed.groupBy(*keys, "cluster_id").agg(F.min("chunk_ix").alias("first_chunk_ix"), F.count(F.lit(1)).alias("sample_count"))


def cluster_events(
    keyed: DataFrame,
    keys: Sequence[str] = ("log_id",),
    text_col: str = "chunk",
    first_cols: Sequence[str] = (),
    chunks: DataFrame | None = None,
) -> DataFrame:
    """One row per ``(keys…, cluster_id)``.

    ``sample_count`` = chunks in the cluster, ``representative_chunk`` = the
    first chunk, ``all_keyword_hits`` = the cluster's keyword set (all members
    share it: the signature is part of the key), ``first_chunk_ix`` = first-seen
    order. ``first_cols`` are taken from the first chunk as well.

    Which chunk is first is found on numbers alone; texts are joined to the winners afterwards. ``keyed`` is read twice, so
    pass a table that is written (or cheap to make again); ``chunks``: where the texts (``keys…, chunk_ix, text_col``) are, if not
    in ``keyed``. A chunk's number is unique within ``keys``.
    """
    found = cluster_counts(keyed, keys)
    at = [*keys, "first_chunk_ix"]
    own = keyed.select(*keys, "cluster_id", F.col("chunk_ix").alias("first_chunk_ix"), F.array_sort("keyword_hits").alias("all_keyword_hits"),
                       *([] if chunks is not None else [F.col(text_col).alias("representative_chunk")]), *first_cols)
    out = found.join(own, [*at, "cluster_id"])
    if chunks is not None:
        out = out.join(chunks.select(*keys, F.col("chunk_ix").alias("first_chunk_ix"), F.col(text_col).alias("representative_chunk")), at)
    return out.select(*keys, "cluster_id", "first_chunk_ix", "sample_count", "representative_chunk", "all_keyword_hits", *first_cols)


def chunk_iocs(filtered: DataFrame, keys: Sequence[str] = ("log_id",), extra: Sequence[str] = ()) -> DataFrame:
    """Indicator rows ``keys…, chunk_ix, ioc_ix, type, value, confidence, context``."""
    return filtered.select(*keys, *extra, "chunk_ix", ioc_rows(F.col("iocs")))


_IOC_PLACES = 1 << 31


def merged_keys(keyed: DataFrame, keys: Sequence[str] = ("log_id",)) -> DataFrame:
    """Distinct ``(type, value)`` (case-sensitive) per cluster, and where each comes first.

    Rows: ``keys…, cluster_id, first_chunk_ix, first_ioc_ix, type, value``; list order = ``(first_chunk_ix, first_ioc_ix)``.
    One shuffle on ``(keys, cluster_id, type, value)`` after a map-side hash aggregate of one number (the place), so
    distinct values spread over tasks even in a hot cluster.
    """
    wide = keyed.schema["chunk_ix"].dataType.simpleString() != "int"
    rows = chunk_iocs(keyed, keys, extra=("cluster_id",))
    place = F.col("chunk_ix").cast("decimal(38,0)" if wide else "long") * F.lit(_IOC_PLACES) + F.col("ioc_ix")
    found = rows.groupBy(*keys, "cluster_id", "type", "value").agg(F.min(place.cast("decimal(38,0)") if wide else place).alias("_at"))
    kind = keyed.schema["chunk_ix"].dataType
    return found.select(
        *keys, "cluster_id", F.expr(f"_at div {_IOC_PLACES}").cast(kind).alias("first_chunk_ix"), (F.col("_at") % F.lit(_IOC_PLACES)).cast("int").alias("first_ioc_ix"), "type", "value"
    )


def merged_iocs(keyed: DataFrame, keys: Sequence[str] = ("log_id",)) -> DataFrame:
    """:func:`merged_keys` with the ``confidence`` and ``context`` of the first occurrence, joined to the winners afterwards (by
    place, so no key is hot). ``keyed`` is read twice: pass a table that is written."""
    rows = chunk_iocs(keyed, keys).select(*keys, F.col("chunk_ix").alias("first_chunk_ix"), F.col("ioc_ix").cast("int").alias("first_ioc_ix"), "confidence", "context")
    found = merged_keys(keyed, keys).join(rows, [*keys, "first_chunk_ix", "first_ioc_ix"])
    return found.select(*keys, "cluster_id", "first_chunk_ix", "first_ioc_ix", "type", "value", "confidence", "context")


def ioc_summary(merged: DataFrame, keys: Sequence[str] = ("log_id",)) -> DataFrame:
    """Type → distinct values in first-seen order, as rows (the map's entries)."""
    return merged.select(*keys, "cluster_id", "type", "value", "first_chunk_ix", "first_ioc_ix")


def cluster_windows(
    keyed: DataFrame,
    ts_col: str = "ts",
    keys: Sequence[str] = ("log_id",),
    seconds: int = rules.EVENT_TIME_WINDOW_SEC,
    text_col: str = "chunk",
) -> DataFrame:
    """Event-time clustering: the cluster key plus a tumbling window of ``seconds``."""
    w = F.window(F.col(ts_col), f"{seconds} seconds")
    order = F.col("chunk_ix")
    return (
        keyed.groupBy(*keys, w.alias("w"), "cluster_id")
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.min(order).alias("first_chunk_ix"),
            F.min_by(F.col(text_col), order).alias("representative_chunk"),
        )
        .select(
            *keys,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "cluster_id",
            "sample_count",
            "first_chunk_ix",
            "representative_chunk",
        )
    )


def run_summary(
    totals: DataFrame,
    suspicious_chunks: DataFrame | None,
    clusters: DataFrame,
    events: DataFrame | None = None,
    keys: Sequence[str] = ("log_id",),
) -> DataFrame:
    """One row per log, including logs with nothing suspicious.

    ``totals``: ``keys…, total_chunks_processed``. ``events`` (optional):
    ``keys…, cluster_id, is_threat, error, n_iocs`` — analysed clusters; a
    threat is ``is_threat and error is null``, ``total_iocs`` sums ``n_iocs``.
    With ``suspicious_chunks=None`` the count is the sum of the clusters'
    ``sample_count`` (every suspicious chunk is in exactly one cluster), so
    the chunk table is read by one aggregate only.
    """
    if suspicious_chunks is None:
        per_log = clusters.groupBy(*keys).agg(
            F.sum("sample_count").cast("long").alias("suspicious_chunks"),
            F.count(F.lit(1)).alias("clustered_events"),
        )
        out = totals.join(per_log, list(keys), "left")
    else:
        susp = suspicious_chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("suspicious_chunks"))
        clus = clusters.groupBy(*keys).agg(F.count(F.lit(1)).alias("clustered_events"))
        out = totals.join(susp, list(keys), "left").join(clus, list(keys), "left")
    if events is not None:
        ev = events.groupBy(*keys).agg(
            F.sum(F.when(F.col("is_threat") & F.col("error").isNull(), 1).otherwise(0)).cast("long").alias("threat_events"),
            F.sum(F.coalesce(F.col("n_iocs"), F.lit(0))).cast("long").alias("total_iocs"),
        )
        out = out.join(ev, list(keys), "left")
    return run_rows(out, keys)


def run_rows(counts: DataFrame, keys: Sequence[str] = ("log_id",)) -> DataFrame:
    """Run rows from ``keys…, total_chunks_processed, suspicious_chunks, clustered_events`` and, if there were
    verdicts, ``threat_events, total_iocs``; missing counts are 0."""
    out = counts
    for c in ("threat_events", "total_iocs"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("long"))
    s = F.coalesce(F.col("suspicious_chunks"), F.lit(0)).cast("long")
    t = F.coalesce(F.col("threat_events"), F.lit(0)).cast("long")
    summary = F.when(s == 0, F.lit(rules.SUMMARY_CLEAN)).otherwise(
        F.format_string(rules.SUMMARY_FOUND, t, s)
    )
    return out.select(
        *keys,
        summary.alias("summary"),
        F.coalesce("total_chunks_processed", F.lit(0)).cast("long").alias("total_chunks_processed"),
        s.alias("suspicious_chunks"),
        F.coalesce(F.col("clustered_events"), F.lit(0)).cast("long").alias("clustered_events"),
        t.alias("threat_events"),
        F.coalesce(F.col("total_iocs"), F.lit(0)).cast("long").alias("total_iocs"),
    )
