"""DuckDB SQL oracles for the registered queries (same column names and types).

The driver tables are pre-registered views in DuckDB; generated views
(``seclog`` etc.) are inlined as CTEs. Indicator extraction is written with
``regexp_extract_all`` / ``regexp_split_to_array`` (exact match positions) and
window-function dedup; the fixed patterns are shared with the Spark side.
DuckDB's ``\\b``/``\\s`` are ASCII, so oracles are exact on ASCII text.
"""

from __future__ import annotations

from .. import rules
from ..sources.fixtures import FIXTURE_AS_OF, view_sql
from .queries import DOCS_PER_LOG


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


KWS = _list(rules.SUSPICIOUS_KEYWORDS)
FPS = ", ".join(_lit(v) for v in rules.FALSE_POSITIVE_DOMAINS)
STRIP = r"'^\s+|\s+$', '', 'g'"


def views(*names: str) -> list[str]:
    return [f"{n} as ({view_sql(n, 'duckdb')})" for n in names]


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def ioc_ctes(src: str, keys: list[str], types=None, tag: str = "i") -> list[str]:
    """CTEs ``raw_{tag}`` and ``kept_{tag}`` over ``src(keys…, x)``.

    ``kept_{tag}``: ``keys…, type, tix, ord, value, confidence, context, ioc_ix``
    (``ioc_ix`` = 0-based position in the text's indicator list).
    """
    k = ", ".join(keys)
    parts = []
    for ti, (t, p, ic, g) in enumerate(rules.IOC_PATTERNS):
        if types is not None and t not in types:
            continue
        rx = _lit(("(?i)" if ic else "") + p)
        conf = rules.HASH_CONFIDENCE if t in rules.HASH_TYPES else rules.DEFAULT_CONFIDENCE
        vs = f"regexp_extract_all(x, {rx}, {g})" if g else "ms"
        parts.append(
            f"""select {k}, x, '{t}' as type, {ti} as tix, cast({conf} as double) as confidence, u.ord as ord, u.m0 as m0,
  rtrim(regexp_replace(vs[u.ord], {STRIP}), '.,;:)') as value,
  cast(coalesce(list_sum(list_transform(list_slice(ps, 1, u.ord), lambda s: length(s))), 0)
   + coalesce(list_sum(list_transform(list_slice(ms, 1, u.ord - 1), lambda s: length(s))), 0) as bigint) as pos
from (select {k}, x, ms, {vs} as vs, regexp_split_to_array(x, {rx}) as ps
      from (select {k}, x, regexp_extract_all(x, {rx}, 0) as ms from {src} where x is not null) s0) s,
     unnest(ms) with ordinality as u(m0, ord)"""
        )
    raw = f"raw_{tag} as (" + "\nunion all\n".join(parts) + ")"
    w = rules.CONTEXT_WINDOW
    kept = f"""kept_{tag} as (
select {k}, type, tix, ord, value, confidence,
  regexp_replace(replace(substring(x, greatest(pos - {w}, 0) + 1, least(pos + length(m0) + {w}, length(x)) - greatest(pos - {w}, 0)), chr(10), ' '), {STRIP}) as context,
  cast(row_number() over (partition by {k} order by tix, ord) - 1 as integer) as ioc_ix
from (select *, row_number() over (partition by {k}, type, lower(value) order by ord) as rk from raw_{tag}) r
where rk = 1 and not (type = 'domain' and lower(value) in ({FPS})))"""
    return [raw, kept]


# A valid UTF-8 sequence in upper-case hex digits, by its number of bytes.
_UTF8_HEX = (
    "[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]"
    "|(?:E0[AB][0-9A-F]|ED[89][0-9A-F]|E[1-9ABCEF][89AB][0-9A-F])[89AB][0-9A-F]"
    "|(?:F0[9AB][0-9A-F]|F[123][89AB][0-9A-F]|F48[0-9A-F])[89AB][0-9A-F][89AB][0-9A-F]"
)


def decode_ctes(src: str, keys: list[str], out: str, steps: str = "url html base64") -> list[str]:
    """CTEs that decode ``src(keys…, x)`` into ``out(keys…, raw, x)``: URL escapes, HTML entities, one base64 run.

    The tables hold four entities; any other one makes the query fail rather than pass unnoticed. DuckDB decodes
    strict UTF-8 only, so the bytes of a base64 run are kept as hex, cut into valid sequences, and the rest dropped.
    """
    k = ", ".join(keys)
    url = "case when regexp_matches(x, '%[0-9A-Fa-f]{2}') then url_decode(url_decode(url_decode(x))) else x end" if "url" in steps else "x"
    entities = (("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"))
    plain = "h0"
    for name, char in entities:
        plain = f"replace({plain}, '{name}', '{char}')"
    known = "|".join(n.strip("&;") for n, _ in entities) + "|amp"
    known = f"regexp_replace(h0, '&(?:{known});|&amp', '', 'g')"
    unknown = f"regexp_matches({known}, '&(?:[A-Za-z][A-Za-z0-9]*;|#)')"
    html = f"case when {unknown} then error('unknown entity') else regexp_replace({plain}, '&amp;?', '&', 'g') end" if "html" in steps else "h0"
    if "base64" not in steps:
        return [f"{out} as (select {k}, raw, {html} as x from (select {k}, x as raw, {url} as h0 from {src}) u)"]
    return [
        f"{out}_h as (select {k}, raw, {html} as h from (select {k}, x as raw, {url} as h0 from {src}) u)",
        f"{out}_m as (select *, regexp_extract(h, {_lit(rules.BASE64_RUN)}, 0) as m, rtrim(regexp_extract(h, {_lit(rules.BASE64_RUN)}, 0), '=') as d from {out}_h)",
        f"{out}_b as (select *, case when length(m) > 0 and (length(d) % 4 = 0 or (length(d) % 4 = 2 and length(m) - length(d) = 2) "
        "or (length(d) % 4 = 3 and length(m) - length(d) >= 1)) "
        f"then hex(from_base64(concat(d, repeat('=', cast((4 - length(d) % 4) % 4 as bigint))))) end as b from {out}_m)",
        f"{out}_t as (select *, decode(unhex(array_to_string(list_filter(regexp_extract_all(b, '{_UTF8_HEX}|..'), "
        f"lambda p: regexp_full_match(p, '{_UTF8_HEX}')), ''))) as t from {out}_b)",
        f"{out} as (select {k}, raw, case when t is not null and regexp_full_match(t, '(?:[^\\p{{C}}\\p{{Z}}]| )*') then replace(h, m, t) else h end as x from {out}_t)",
    ]


def hits(col: str) -> str:
    return f"list_filter({KWS}, lambda kw: contains(lower({col}), kw))"


def chunks_sql(table: str, key: str, text: str, size: int, step: int, key_alias: str | None = None) -> str:
    ka = key_alias or key
    return (
        f"select {key} as {ka}, cast(o // {step} as integer) as chunk_ix, substring({text}, o + 1, {size}) as chunk "
        f"from {table}, unnest(range(0, length({text}), {step})) as r(o)"
    )


ORACLES: dict[str, str] = {}

# ------------------------------------------------------------------ chunking

ORACLES["chunk_fixed"] = "select doc_id, cast(o // 4000 as integer) as chunk_ix, substring(text, o + 1, 4000) as chunk from documents, unnest(range(0, length(text), 4000)) as r(o)"
ORACLES["chunk_overlap"] = "select doc_id, cast(o // 450 as integer) as chunk_ix, substring(text, o + 1, 500) as chunk from documents, unnest(range(0, length(text), 450)) as r(o)"

ORACLES["preview"] = "select doc_id, substring(text, 1, 5000) as preview from documents"

# ------------------------------------------------------------------ extraction

_IOC_OUT = "ioc_ix, type, value, confidence, context"


def _seclog_ioc(types):
    return (
        with_(*views("seclog"), "src as (select event_id, line as x from seclog)", *ioc_ctes("src", ["event_id"], types))
        + f"select event_id, {_IOC_OUT} from kept_i"
    )


for _t, _p, _ic, _g in rules.IOC_PATTERNS:
    ORACLES[f"ioc_{_t}"] = _seclog_ioc([_t])
ORACLES["ioc_all"] = _seclog_ioc(None)

ORACLES["ioc_ipv4_documents"] = (
    with_("src as (select doc_id, text as x from documents)", *ioc_ctes("src", ["doc_id"], ["ipv4"]))
    + f"select doc_id, {_IOC_OUT} from kept_i"
)

ORACLES["ioc_pages"] = (
    with_(
        "src as (select page_id, chunk_ix, chunk as x from (" + chunks_sql("pages", "page_id", "html", 4000, 4000) + "))",
        *ioc_ctes("src", ["page_id", "chunk_ix"]),
    )
    + f"select page_id, chunk_ix, {_IOC_OUT} from kept_i"
)

ORACLES["decode_url"] = with_(*views("seclog")) + (
    "select event_id, case when contains(line, '%') then url_decode(url_decode(url_decode(line))) else line end as decoded from seclog"
)

ORACLES["decode_html"] = with_(*decode_ctes("(select page_id, html as x from pages) s", ["page_id"], "dec", "html")) + "select page_id, x as decoded from dec"
ORACLES["decode_base64"] = with_(*views("seclog"), *decode_ctes("(select event_id, line as x from seclog) s", ["event_id"], "dec", "base64")) + (
    "select event_id, x as decoded from dec"
)
ORACLES["decode_full"] = with_(
    *decode_ctes(
        "(select concat('doc:', cast(doc_id as varchar)) as log_id, text as x from documents "
        "union all select concat('page:', cast(page_id as varchar)), html from pages) s",
        ["log_id"],
        "dec",
    )
) + "select log_id, x as decoded from dec"
ORACLES["ioc_reference_decode"] = (
    with_(*views("seclog"), *decode_ctes("(select event_id, line as x from seclog) s", ["event_id"], "src"), *ioc_ctes("src", ["event_id"]))
    + f"select event_id, {_IOC_OUT} from kept_i"
)
ORACLES["extract_iocs_documents"] = with_(
    *decode_ctes("(select doc_id, text as x from documents) s", ["doc_id"], "src"), *ioc_ctes("src", ["doc_id"])
) + "select d.doc_id, count(k.doc_id) as total_iocs_found from documents d left join kept_i k on k.doc_id = d.doc_id group by 1"

# ------------------------------------------------------------------ keywords / filter

ORACLES["keyword_hits"] = with_(
    *views("seclog"),
    "allc as (select 'seclog' as src, event_id as id, 0 as chunk_ix, line as chunk from seclog "
    "union all select 'documents', id, chunk_ix, chunk from (" + chunks_sql("documents", "doc_id", "text", 4000, 4000, "id") + ") d "
    "union all select 'pages', id, chunk_ix, chunk from (" + chunks_sql("pages", "page_id", "html", 4000, 4000, "id") + ") p)",
) + (
    f"select src, id, chunk_ix, cast(u.ord - 1 as integer) as kw_ix, u.keyword as keyword "
    f"from allc, unnest({hits('chunk')}) with ordinality as u(keyword, ord)"
)


def _seclog_chain(decode_none: bool = True) -> list[str]:
    """CTE chain over seclog lines: filter, cluster keys, clusters, merged
    indicators, parsed verdicts and analysed events."""
    return [
        *views("seclog", "verdict_raw"),
        "src as (select event_id, line as x from seclog)",
        *ioc_ctes("src", ["event_id"]),
        "cnt as (select event_id, count(*) as n from kept_i group by 1)",
        "ipf as (select event_id, arg_min(value, ord) as ip from kept_i where type = 'ipv4' group by 1)",
        f"flt as (select s.event_id, s.user_id, s.ts, s.line, {hits('s.line')} as hits, coalesce(c.n, 0) as n_iocs "
        "from seclog s left join cnt c on c.event_id = s.event_id)",
        "keyed as (select f.event_id, f.user_id as log_id, f.ts, f.line, f.hits, coalesce(ipf.ip, 'unknown') as src_ip, "
        "case when len(f.hits) > 0 then array_to_string(list_sort(f.hits), '|') else 'ioc_only' end as signature, "
        "substring(md5(concat(src_ip, ':', signature)), 1, 12) as cluster_id "
        "from flt f left join ipf on ipf.event_id = f.event_id where f.n_iocs > 0 or len(f.hits) > 0)",
        "clusters as (select log_id, cluster_id, min(event_id) as first_chunk_ix, count(*) as sample_count, "
        "arg_min(line, event_id) as representative_chunk, arg_min(array_to_string(list_sort(hits), '|'), event_id) as keyword_list, "
        "min(event_id) as first_event_id from keyed group by 1, 2)",
        "merged as (select k.log_id, k.cluster_id, i.type, i.value, "
        "first(k.event_id order by k.event_id, i.ioc_ix) as first_chunk_ix, first(i.ioc_ix order by k.event_id, i.ioc_ix) as first_ioc_ix, "
        "first(i.confidence order by k.event_id, i.ioc_ix) as confidence, first(i.context order by k.event_id, i.ioc_ix) as context "
        "from keyed k join kept_i i on i.event_id = k.event_id group by 1, 2, 3, 4)",
        *verdict_ctes(),
        "evts as (select c.*, v.is_threat, v.attack_type, v.mitre_id, v.tactic, v.technique_name, v.confidence, v.evidence, v.recommendation, "
        "case when v.log_id is null then 'llm_json_parse_failed' else v.error end as error "
        "from clusters c left join verdicts v on v.log_id = c.log_id and v.cluster_no = c.first_event_id)",
        "events_n as (select e.*, cast(case when e.error is null then coalesce(m.n, 0) else 0 end as bigint) as n_iocs "
        "from evts e left join (select log_id, cluster_id, count(*) as n from merged group by 1, 2) m "
        "on m.log_id = e.log_id and m.cluster_id = e.cluster_id)",
        "threat as (select * from events_n where coalesce(is_threat, false) and error is null)",
    ]


def verdict_ctes() -> list[str]:
    """Tolerant JSON ladder in DuckDB: strict text, fenced body, no trailing
    commas, first '{' to last '}' without trailing commas."""
    tc = _lit(rules.JSON_TRAILING_COMMA) + r", '\1', 'g'"
    return [
        "vcand as (select log_id, cluster_no, trim(raw) as c1, "
        f"trim(regexp_extract(trim(raw), {_lit('(?s)' + rules.JSON_FENCE)}, 1)) as c2, "
        f"regexp_replace(trim(raw), {tc}) as c3, "
        rf"regexp_replace(regexp_extract(trim(raw), '(?s)\{{.*\}}', 0), {tc}) as c4 from verdict_raw)",
        "vjson as (select log_id, cluster_no, coalesce(case when c1 <> '' and json_valid(c1) then c1 end, "
        "case when c2 <> '' and json_valid(c2) then c2 end, case when c3 <> '' and json_valid(c3) then c3 end, "
        "case when c4 <> '' and json_valid(c4) then c4 end) as j from vcand)",
        "verdicts as (select log_id, cluster_no, "
        "case when json_type(j) = 'OBJECT' then case json_type(j, '$.is_threat') when 'BOOLEAN' then cast(j->>'$.is_threat' as boolean) "
        "when 'VARCHAR' then (j->>'$.is_threat') <> '' when 'ARRAY' then json_array_length(j, '$.is_threat') > 0 "
        "when 'OBJECT' then len(json_keys(j, '$.is_threat')) > 0 when 'NULL' then null "
        "else cast(j->>'$.is_threat' as double) <> 0 end end as is_threat, "
        "case when json_type(j) = 'OBJECT' then j->>'$.attack_type' end as attack_type, "
        "case when json_type(j) = 'OBJECT' then j->>'$.mitre_id' end as mitre_id, "
        "case when json_type(j) = 'OBJECT' then j->>'$.tactic' end as tactic, "
        "case when json_type(j) = 'OBJECT' then j->>'$.technique_name' end as technique_name, "
        "case when json_type(j) = 'OBJECT' then cast(j->>'$.confidence' as double) end as confidence, "
        "case when json_type(j) = 'OBJECT' then j->>'$.evidence' end as evidence, "
        "case when json_type(j) = 'OBJECT' then j->>'$.recommendation' end as recommendation, "
        "case when j is null or json_type(j) = 'NULL' then 'llm_json_parse_failed' end as error from vjson)",
    ]


ORACLES["suspicious"] = with_(*_seclog_chain()) + (
    "select event_id, cast(n_iocs as integer) as n_iocs, cast(len(hits) as integer) as n_keywords, "
    "(n_iocs > 0 or len(hits) > 0) as is_suspicious from flt"
)

ORACLES["cluster_key"] = with_(*_seclog_chain()) + "select event_id, log_id, src_ip, signature, cluster_id from keyed"

ORACLES["cluster_events"] = with_(*_seclog_chain()) + (
    "select log_id, cluster_id, first_chunk_ix, sample_count, representative_chunk, keyword_list from clusters"
)

ORACLES["merged_iocs"] = with_(*_seclog_chain()) + (
    "select log_id, cluster_id, first_chunk_ix, first_ioc_ix, type, value, confidence, context from merged"
)

ORACLES["ioc_summary"] = with_(*_seclog_chain()) + (
    "select log_id, cluster_id, type, value, first_chunk_ix, first_ioc_ix from merged"
)

ORACLES["cluster_window_300s"] = with_(*_seclog_chain()) + (
    "select log_id, time_bucket(interval 300 second, ts) as window_start, "
    "time_bucket(interval 300 second, ts) + interval 300 second as window_end, cluster_id, "
    "count(*) as sample_count, min(event_id) as first_chunk_ix, arg_min(line, event_id) as representative_chunk "
    "from keyed group by log_id, time_bucket(interval 300 second, ts), cluster_id"
)


def _funnel_oracle(logs: str | None = None, decode: bool = False) -> str:
    logs = logs or (
        "logs as (select concat('doc:', cast(doc_id as varchar)) as log_id, text from documents "
        "union all select concat('page:', cast(page_id as varchar)) as log_id, html as text from pages)"
    )
    ch = "ch as (" + chunks_sql("logs", "log_id", "text", 4000, 4000) + ")"
    return with_(
        logs,
        ch,
        *(
            decode_ctes("(select log_id, chunk_ix, chunk as x from ch) s", ["log_id", "chunk_ix"], "src")
            if decode
            else ["src as (select log_id, chunk_ix, chunk as x from ch)"]
        ),
        *ioc_ctes("src", ["log_id", "chunk_ix"]),
        "cnt as (select log_id, chunk_ix, count(*) as n from kept_i group by 1, 2)",
        "ipf as (select log_id, chunk_ix, arg_min(value, ord) as ip from kept_i where type = 'ipv4' group by 1, 2)",
        f"flt as (select c.log_id, c.chunk_ix, c.chunk, {hits('c.chunk')} as hits, coalesce(n.n, 0) as n_iocs "
        "from ch c left join cnt n on n.log_id = c.log_id and n.chunk_ix = c.chunk_ix)",
        "keyed as (select f.*, coalesce(ipf.ip, 'unknown') as src_ip, "
        "case when len(f.hits) > 0 then array_to_string(list_sort(f.hits), '|') else 'ioc_only' end as signature, "
        "substring(md5(concat(src_ip, ':', signature)), 1, 12) as cluster_id "
        "from flt f left join ipf on ipf.log_id = f.log_id and ipf.chunk_ix = f.chunk_ix where f.n_iocs > 0 or len(f.hits) > 0)",
    )


_FUNNEL_OUT = (
    "select log_id, cluster_id, min(chunk_ix) as first_chunk_ix, count(*) as sample_count, "
    "md5(arg_min(chunk, chunk_ix)) as representative_md5, arg_min(array_to_string(list_sort(hits), '|'), chunk_ix) as keyword_list "
    "from keyed group by 1, 2"
)

ORACLES["funnel_documents"] = _funnel_oracle() + _FUNNEL_OUT
ORACLES["funnel_documents_decoded"] = _funnel_oracle(decode=True) + _FUNNEL_OUT

ORACLES["analyze_logs"] = _funnel_oracle().rstrip("\n") + (
    ",\nsn as (select log_id, count(*) as s from keyed group by 1),\n"
    "cn as (select log_id, count(distinct cluster_id) as c from keyed group by 1)\n"
    "select l.log_id, case when coalesce(sn.s, 0) = 0 then '未发现安全威胁' "
    "else printf('发现%d个安全事件，共%d条可疑日志聚类而成', 0, sn.s) end as summary, "
    "cast((length(l.text) + 3999) // 4000 as bigint) as total_chunks_processed, "
    "cast(coalesce(sn.s, 0) as bigint) as suspicious_chunks, cast(coalesce(cn.c, 0) as bigint) as clustered_events, "
    "cast(0 as bigint) as threat_events, cast(0 as bigint) as total_iocs "
    "from logs l left join sn on sn.log_id = l.log_id left join cn on cn.log_id = l.log_id"
)

# ------------------------------------------------------------------ verdicts / report

ORACLES["parse_verdicts"] = with_(*views("verdict_raw"), *verdict_ctes()) + (
    "select log_id, cluster_no, is_threat, attack_type, mitre_id, tactic, technique_name, confidence, evidence, recommendation, error from verdicts"
)

ORACLES["threats"] = with_(*_seclog_chain()) + (
    "select log_id, cluster_id, sample_count, attack_type, mitre_id, tactic, technique_name, confidence from threat"
)

ORACLES["run_summary"] = with_(
    *_seclog_chain(),
    "tot as (select user_id as log_id, count(*) as t from seclog group by 1)",
    "sn as (select log_id, count(*) as s from keyed group by 1)",
    "cn as (select log_id, count(*) as c from clusters group by 1)",
    "en as (select log_id, sum(case when coalesce(is_threat, false) and error is null then 1 else 0 end) as th, sum(n_iocs) as ni from events_n group by 1)",
) + (
    "select tot.log_id, case when coalesce(sn.s, 0) = 0 then '未发现安全威胁' "
    "else printf('发现%d个安全事件，共%d条可疑日志聚类而成', coalesce(en.th, 0), sn.s) end as summary, "
    "cast(tot.t as bigint) as total_chunks_processed, cast(coalesce(sn.s, 0) as bigint) as suspicious_chunks, "
    "cast(coalesce(cn.c, 0) as bigint) as clustered_events, cast(coalesce(en.th, 0) as bigint) as threat_events, "
    "cast(coalesce(en.ni, 0) as bigint) as total_iocs "
    "from tot left join sn on sn.log_id = tot.log_id left join cn on cn.log_id = tot.log_id left join en on en.log_id = tot.log_id"
)

_BAND = (
    f"case when coalesce(confidence, 0) >= {rules.RISK_HIGH_MIN} then '{rules.RISK_HIGH}' "
    f"when coalesce(confidence, 0) >= {rules.RISK_MEDIUM_MIN} then '{rules.RISK_MEDIUM}' else '{rules.RISK_LOW}' end"
)


def _disp(col: str) -> str:
    return f"coalesce(nullif({col}, ''), {_lit(rules.DISPLAY_DEFAULTS[col])})"


ORACLES["risk_band"] = with_(*_seclog_chain()) + f"select log_id, cluster_id, confidence, {_BAND} as risk_band from threat"

ORACLES["event_display"] = with_(*_seclog_chain()) + (
    "select log_id, cluster_id, "
    + ", ".join(f"{_disp(k)} as {k}_display" for k in rules.DISPLAY_DEFAULTS)
    + f", {_BAND} as risk_band, case when n_iocs = 0 then {_lit(rules.DISPLAY_NO_IOC)} end as ioc_text, n_iocs from events_n"
)

ORACLES["mitre_matrix"] = with_(*_seclog_chain()) + (
    f"select {_disp('tactic')} as tactic, {_disp('mitre_id')} as mitre_id, {_disp('technique_name')} as technique_name, "
    "count(*) as events, cast(sum(sample_count) as bigint) as samples, max(confidence) as max_confidence "
    "from threat group by 1, 2, 3"
)

ORACLES["mitre_pivot"] = with_(*_seclog_chain()) + (
    f"select {_disp('mitre_id')} as mitre_id, {_disp('technique_name')} as technique_name, "
    + ", ".join(f"cast(count(*) filter (where {_disp('tactic')} = 'tac{i}') as bigint) as tac{i}" for i in range(3))
    + " from threat group by 1, 2"
)

ORACLES["result_sink"] = with_(
    *_seclog_chain(),
    "tot as (select user_id as log_id, count(*) as t from seclog group by 1)",
    "sn as (select log_id, count(*) as s from keyed group by 1)",
    "en as (select log_id, count(*) as e, sum(case when coalesce(is_threat, false) and error is null then 1 else 0 end) as th, sum(n_iocs) as ni, "
    "sum(coalesce(confidence, 0)) as conf from events_n group by 1)",
    "mn as (select log_id, count(*) as i, sum(length(value)) as c from merged group by 1)",
) + (
    "select tot.log_id, case when coalesce(sn.s, 0) = 0 then '未发现安全威胁' "
    "else printf('发现%d个安全事件，共%d条可疑日志聚类而成', coalesce(en.th, 0), sn.s) end as summary, "
    "cast(coalesce(en.th, 0) as bigint) as threat_events, cast(coalesce(en.ni, 0) as bigint) as total_iocs, cast(coalesce(en.e, 0) as bigint) as events, "
    "cast(coalesce(mn.i, 0) as bigint) as iocs, cast(coalesce(mn.c, 0) as bigint) as ioc_chars, round(en.conf, 6) as confidence "
    "from tot left join sn on sn.log_id = tot.log_id left join en on en.log_id = tot.log_id left join mn on mn.log_id = tot.log_id"
)

ORACLES["report_events"] = with_(*_seclog_chain()) + (
    f"select log_id, cluster_id, sample_count, {_disp('attack_type')} as attack_type_display, {_disp('mitre_id')} as mitre_id_display, "
    f"{_disp('tactic')} as tactic_display, {_disp('technique_name')} as technique_name_display, confidence, {_BAND} as risk_band, "
    f"{_disp('evidence')} as evidence_display, {_disp('recommendation')} as recommendation_display, n_iocs from threat"
)

# ------------------------------------------------------------------ enrichment

_AS_OF = f"timestamp '{FIXTURE_AS_OF}'"


def _fresh(table: str, keys: str, ttl: int) -> str:
    return (
        f"select * from (select *, row_number() over (partition by {keys} order by fetched_at desc) as rn from {table} "
        f"where epoch({_AS_OF}) - epoch(fetched_at) < {ttl} ) t where rn = 1"
    )


_ATTR = "'$.data.attributes"
REPUTATION_CTES = [
    *views("reputation_raw"),
    f"rep_latest as ({_fresh('reputation_raw', 'ioc_type, ioc_value', rules.REPUTATION_TTL_SEC)})",
    "rep as (select ioc_type, ioc_value, "
    "case when http_status = 200 then true when http_status = 404 then false end as found, "
    f"cast(case when http_status = 200 then coalesce(cast(json_extract(body, {_ATTR}.last_analysis_stats.malicious') as bigint), 0) "
    "when http_status = 404 then 0 end as integer) as malicious_count, "
    f"cast(case when http_status = 200 then coalesce(cast(json_extract(body, {_ATTR}.last_analysis_stats.suspicious') as bigint), 0) end as integer) as suspicious_count, "
    f"cast(case when http_status = 200 then coalesce(cast(json_extract(body, {_ATTR}.reputation') as bigint), 0) end as integer) as community_score, "
    f"case when http_status = 200 then cast(json_extract(body, {_ATTR}.first_submission_date') as bigint) end as first_seen, "
    f"case when http_status = 200 then array_to_string(list_slice(coalesce(cast(json_extract(body, {_ATTR}.tags') as varchar[]), []), 1, {rules.REPUTATION_TAGS_MAX}), ',') end as tags, "
    f"case when http_status = 429 then {_lit(rules.REPUTATION_RATE_LIMIT_ERROR)} "
    "when http_status not in (200, 404) then printf('VT API返回%d', http_status) end as error, "
    "cast(fetched_at as varchar) as fetched_at from rep_latest)",
]

ORACLES["fresh_snapshot"] = with_(*REPUTATION_CTES) + (
    "select ioc_type, ioc_value, found, malicious_count, suspicious_count, community_score, first_seen, tags, error, fetched_at from rep"
)


ORACLES["fresh_snapshot_no_errors"] = (
    with_(*REPUTATION_CTES)
    .replace("from reputation_raw where", "from (select * from reputation_raw where http_status in (200, 404)) rr where")
    .replace(f"< {rules.REPUTATION_TTL_SEC} ", f"< {6 * rules.REPUTATION_TTL_SEC} ")
) + "select ioc_type, ioc_value, found, malicious_count, error, fetched_at from rep"

_STORED = (
    "stored as (select * replace (case when length(ioc_value) % 4 = 3 then substring(body, 1, 20) else body end as body) from reputation_raw)",
    "judged as (select *, case when http_status = 200 and body is not null and not json_valid(body) then 'corrupt_body' else 'ok' end as state from stored)",
)
ORACLES["read_responses"] = with_(*views("reputation_raw"), *_STORED) + "select ioc_type, ioc_value, http_status, state from judged"


def _clean_domain(c: str) -> str:
    return f"regexp_extract(regexp_replace(lower(regexp_replace({c}, {STRIP})), '^(?:https://)?(?:http://)?(?:ftp://)?', ''), '^[^/:]*', 0)"


REGISTRATION_CTES = [
    *views("registration_raw"),
    "reg_clean as (select * replace (" + _clean_domain("domain") + " as domain) from registration_raw)",
    f"reg_latest as ({_fresh('reg_clean', 'domain', rules.REGISTRATION_TTL_SEC)})",
    "reg_j as (select *, cast(json_extract(body, '$.entities') as json[]) as ents, cast(json_extract(body, '$.events') as json[]) as evs, "
    "cast(json_extract(body, '$.nameservers') as json[]) as nss from reg_latest)",
    "reg_r as (select *, list_filter(ents, lambda e: list_contains(cast(json_extract(e, '$.roles') as varchar[]), 'registrar'))[1] as ent from reg_j)",
    "reg as (select domain, source, "
    "case when http_status = 200 then case when source = 'rdap' then coalesce(json_extract_string("
    "list_filter(cast(json_extract(ent, '$.vcardArray[1]') as json[]), lambda it: json_extract_string(it, '$[0]') = 'fn')[1], '$[3]'), '') "
    "else coalesce(json_extract_string(body, '$.registrar'), '') end end as registrar, "
    "case when http_status = 200 then case when source = 'rdap' then coalesce(json_extract_string("
    "list_filter(evs, lambda e: json_extract_string(e, '$.eventAction') = 'registration')[-1], '$.eventDate'), '') "
    "else coalesce(case when json_type(json_extract(body, '$.creation_date')) = 'ARRAY' then json_extract_string(body, '$.creation_date[0]') "
    "else json_extract_string(body, '$.creation_date') end, '') end end as creation_date, "
    "case when http_status = 200 then case when source = 'rdap' then coalesce(json_extract_string("
    "list_filter(evs, lambda e: json_extract_string(e, '$.eventAction') = 'expiration')[-1], '$.eventDate'), '') "
    "else coalesce(case when json_type(json_extract(body, '$.expiration_date')) = 'ARRAY' then json_extract_string(body, '$.expiration_date[0]') "
    "else json_extract_string(body, '$.expiration_date') end, '') end end as expiration_date, "
    "case when http_status = 200 then case when source = 'rdap' then array_to_string(list_slice(list_transform(list_filter(nss, "
    "lambda n: json_extract(n, '$.ldhName') is not null), lambda n: json_extract_string(n, '$.ldhName')), 1, 5), ',') "
    "else array_to_string(list_slice(list_transform(coalesce(cast(json_extract(body, '$.name_servers') as varchar[]), []), lambda s: lower(s)), 1, 5), ',') end end as name_servers, "
    "case when http_status = 200 then case when source = 'rdap' then concat('[', array_to_string(list_transform("
    "coalesce(cast(json_extract(body, '$.status') as varchar[]), []), lambda s: concat('''', s, '''')), ', '), ']') "
    "else coalesce(json_extract_string(body, '$.status'), '') end end as status, "
    "case when http_status <> 200 then printf('RDAP返回%d', http_status) end as error from reg_r)",
]

ORACLES["registration_snapshot"] = with_(*REGISTRATION_CTES) + (
    "select domain, source, registrar, creation_date, expiration_date, name_servers, status, error from reg"
)

_ROUTE = (
    "case type when 'ipv4' then 'ip' when 'domain' then 'domain' when 'md5' then 'hash' "
    "when 'sha1' then 'hash' when 'sha256' then 'hash' end"
)

ORACLES["enrich_reputation"] = with_(*views("reputation_raw"), *_seclog_chain(), *REPUTATION_CTES[1:]) + (
    f"select m.log_id, m.cluster_id, m.type, m.value, {_ROUTE} as route, r.found as vt_found, r.malicious_count as vt_malicious_count, "
    f"r.suspicious_count as vt_suspicious_count, r.error as vt_error from merged m left join rep r on r.ioc_type = {_ROUTE} and r.ioc_value = m.value"
)

ORACLES["enrich_stored"] = with_(
    *views("reputation_raw"),
    *_STORED,
    "kept_raw as (select * from judged where state = 'ok')",
    *_seclog_chain(),
    *[c.replace("from reputation_raw where", "from kept_raw where") for c in REPUTATION_CTES[1:]],
) + (
    f"select m.log_id, m.cluster_id, m.type, m.value, {_ROUTE} as route, r.found as vt_found, r.malicious_count as vt_malicious_count, "
    f"r.error as vt_error from merged m left join rep r on r.ioc_type = {_ROUTE} and r.ioc_value = m.value"
)

ORACLES["enrich_registration"] = with_(*views("registration_raw"), *_seclog_chain(), *REGISTRATION_CTES[1:]) + (
    "select m.log_id, m.cluster_id, m.value, g.registrar as whois_registrar, g.creation_date as whois_creation_date, g.error as whois_error "
    f"from merged m left join reg g on g.domain = {_clean_domain('m.value')} where m.type = 'domain'"
)

ORACLES["enrich_events"] = with_(
    *views("reputation_raw", "registration_raw"), *_seclog_chain(), *REPUTATION_CTES[1:], *REGISTRATION_CTES[1:]
) + (
    f"select m.log_id, m.cluster_id, m.first_chunk_ix, m.first_ioc_ix, m.type, m.value, {_ROUTE} as route, r.found as vt_found, "
    "r.malicious_count as vt_malicious_count, r.error as vt_error, g.registrar as whois_registrar, g.error as whois_error "
    "from merged m join threat t on t.log_id = m.log_id and t.cluster_id = m.cluster_id "
    f"left join rep r on r.ioc_type = {_ROUTE} and r.ioc_value = m.value "
    f"left join reg g on m.type = 'domain' and g.domain = {_clean_domain('m.value')}"
)

ORACLES["report_iocs"] = with_(
    *views("reputation_raw", "registration_raw"), *_seclog_chain(), *REPUTATION_CTES[1:], *REGISTRATION_CTES[1:]
) + (
    f"select m.log_id, m.cluster_id, m.first_chunk_ix, m.first_ioc_ix, concat(m.type, ': ', m.value) as line, {_ROUTE} as route, "
    f"{_BAND.replace('confidence', 't.confidence')} as risk_band, r.found as vt_found, r.malicious_count as vt_malicious_count, "
    "r.community_score as vt_community_score, r.tags as vt_tags, r.error as vt_error, g.registrar as whois_registrar, "
    "g.creation_date as whois_creation_date, g.name_servers as whois_name_servers, g.error as whois_error, "
    "cast(sum(coalesce(r.malicious_count, 0)) over (partition by m.log_id, m.cluster_id) as bigint) as event_malicious "
    "from merged m join threat t on t.log_id = m.log_id and t.cluster_id = m.cluster_id "
    f"left join rep r on r.ioc_type = {_ROUTE} and r.ioc_value = m.value "
    f"left join reg g on m.type = 'domain' and g.domain = {_clean_domain('m.value')}"
)

ORACLES["registration_worklist"] = with_(*views("registration_raw"), *_seclog_chain(), *REGISTRATION_CTES[1:]) + (
    f"select distinct {_clean_domain('m.value')} as domain from merged m where m.type = 'domain' "
    f"and not exists (select 1 from reg g where g.domain = {_clean_domain('m.value')})"
)

ORACLES["lookup_worklist"] = with_(*views("reputation_raw"), *_seclog_chain()) + (
    f"select distinct {_ROUTE} as ioc_type, value as ioc_value from merged m where {_ROUTE} is not null "
    f"and not exists (select 1 from reputation_raw r where r.ioc_type = {_ROUTE} and r.ioc_value = m.value "
    f"and epoch({_AS_OF}) - epoch(r.fetched_at) < {rules.REPUTATION_TTL_SEC})"
)

# ------------------------------------------------------------------ knowledge base

KB_CTES = [
    "bfiles as (select item_id as file_order, concat('bench', cast(item_id as varchar)) as file_id, "
    "concat('item_', cast(item_id as varchar), '.txt') as source, text as content, substring(sha256(text), 1, 16) as content_hash from benchmark)",
    "bnew as (select b.* from bfiles b join (select content_hash, min(file_order) as file_order from bfiles where length(content) > 0 group by 1) w "
    "on w.content_hash = b.content_hash and w.file_order = b.file_order)",
    "bchunks as (select concat(file_id, '_chunk_', cast(cast(o // 450 as integer) as varchar)) as id, file_order, file_id, "
    "cast(o // 450 as integer) as chunk_index, content_hash, source, substring(content, o + 1, 500) as content "
    "from bnew, unnest(range(0, length(content), 450)) as r(o))",
    "existing as (select id, file_id, chunk_index, content_hash, source, content from "
    "(select *, row_number() over (partition by id order by file_order desc) as rn from bchunks) t where rn = 1)",
    "files as (select doc_id as file_order, case when doc_id % 50 = 0 then 'again' else concat('doc', cast(doc_id as varchar)) end as file_id, concat('doc_', cast(doc_id as varchar), '.txt') as source, text as content, "
    "substring(sha256(text), 1, 16) as content_hash from documents)",
    "newf as (select f.* from files f join (select content_hash, min(file_order) as file_order from files where length(content) > 0 group by 1) w "
    "on w.content_hash = f.content_hash and w.file_order = f.file_order where f.content_hash not in (select content_hash from existing))",
    "nchunks as (select concat(file_id, '_chunk_', cast(cast(o // 450 as integer) as varchar)) as id, file_order, file_id, "
    "cast(o // 450 as integer) as chunk_index, content_hash, source, substring(content, o + 1, 500) as content "
    "from newf, unnest(range(0, length(content), 450)) as r(o))",
    "upserted as (select id, file_id, chunk_index, content_hash, source, content from existing where id not in (select id from nchunks) "
    "union all select id, file_id, chunk_index, content_hash, source, content from "
    "(select *, row_number() over (partition by id order by file_order desc) as rn from nchunks) t where rn = 1)",
]

ORACLES["kb_new_docs"] = with_(*KB_CTES) + "select file_order, file_id, source, content_hash from newf"
ORACLES["kb_chunks"] = with_(*KB_CTES) + "select id, file_order, file_id, chunk_index, content_hash, source, content from nchunks"
ORACLES["kb_upsert"] = with_(*KB_CTES) + "select id, file_id, chunk_index, content_hash, source, content from upserted"
ORACLES["kb_delete"] = with_(*KB_CTES) + (
    "select id, file_id, chunk_index, content_hash, source from upserted where file_id not in (select file_id from existing)"
)
ORACLES["kb_files"] = with_(*KB_CTES) + (
    "select coalesce(file_id, 'unknown') as file_id, count(*) as chunks, arg_min(coalesce(source, ''), chunk_index) as source, "
    "arg_min(coalesce(content_hash, ''), chunk_index) as content_hash from upserted group by 1"
)
ORACLES["kb_index_report"] = with_(
    *KB_CTES,
    "cnts as (select file_order, count(*) as chunks from nchunks group by 1)",
    "holders as (select coalesce(o.content_hash, n.content_hash) as content_hash, coalesce(o.h, n.h) as holder from "
    "(select content_hash, arg_min(file_id, file_order) as h from nchunks group by 1) n full outer join "
    "(select content_hash, min(file_id) as h from existing group by 1) o on o.content_hash = n.content_hash)",
) + (
    "select f.file_order, case when length(f.content) = 0 then 'error' when c.chunks is not null then 'success' else 'skipped' end as status, "
    "case when length(f.content) > 0 and c.chunks is null then coalesce(h.holder, 'unknown') else f.file_id end as file_id, "
    "cast(coalesce(c.chunks, 0) as bigint) as chunks, f.content_hash, "
    "case when length(f.content) = 0 then 'No chunks generated' when c.chunks is null then 'duplicate content' end as reason "
    "from files f left join cnts c on c.file_order = f.file_order left join holders h on h.content_hash = f.content_hash"
)

ORACLES["kb_versions"] = with_(*KB_CTES) + (
    "select id, file_id, chunk_index, content_hash, source, md5(content) as content_md5, id in (select id from existing) as in_first from upserted "
    "where file_id not in (select file_id from existing where cast(substring(file_id, 6) as integer) % 2 = 0)"
)
ORACLES["kb_embed_batches"] = with_(*KB_CTES) + (
    "select id, " + ", ".join(f"cast(length(content) - length(replace(content, '{c}', '')) as integer) as n_{c}" for c in "aeiorst") + " from bchunks"
)

_KB_QUERY = (
    "select c.log_id, c.cluster_id, case when len(parts) > 0 then array_to_string(parts, ' ') "
    "else substring(c.representative_chunk, 1, 200) end as kb_query from ("
    "select c.*, list_concat(list_filter([s.sha, s.dom], lambda v: v is not null), "
    "list_slice(string_split(nullif(c.keyword_list, ''), '|'), 1, 2)) as parts from clusters c left join "
    "(select log_id, cluster_id, first(value order by first_chunk_ix, first_ioc_ix) filter (where type = 'sha256') as sha, "
    "first(value order by first_chunk_ix, first_ioc_ix) filter (where type = 'domain') as dom from merged group by 1, 2) s "
    "on s.log_id = c.log_id and s.cluster_id = c.cluster_id) c"
)
ORACLES["kb_query_text"] = with_(*_seclog_chain()) + _KB_QUERY
_SOC = " or ".join(f"contains(lower(q.kb_query), {_lit(k)})" for k in rules.SOC_QUERY_KEYWORDS)
ORACLES["enhance_query"] = with_(
    *_seclog_chain(),
    f"q as ({_KB_QUERY})",
    *decode_ctes("(select log_id, cluster_id, kb_query as x from q) s", ["log_id", "cluster_id"], "qsrc"),
    *ioc_ctes("qsrc", ["log_id", "cluster_id"], tag="q"),
    f"top as (select log_id, cluster_id, string_agg(value, ' ' order by ioc_ix) as vals from kept_q where ioc_ix < {rules.ENHANCE_IOC_VALUES} group by 1, 2)",
) + (
    "select q.log_id, q.cluster_id, q.kb_query, case when trim(q.kb_query) = '' then '' "
    f"when top.vals is not null then concat(top.vals, ' ', {_lit(rules.ENHANCE_IOC_SUFFIX)}) "
    f"when not ({_SOC}) then concat(q.kb_query, ' ', {_lit(rules.ENHANCE_PLAIN_SUFFIX)}) else q.kb_query end as enhanced_query "
    "from q left join top on top.log_id = q.log_id and top.cluster_id = q.cluster_id"
)

_VEC = (
    "e as (select vec_id, label, cast(embedding as double[]) as v from embeddings)",
    "q as (select vec_id, label, v from e union all select vec_id, label + 1, v from e where vec_id % 10 = 0)",
    "d as (select q.vec_id as query_id, k.vec_id as id, k.label as file_id, "
    "1 - list_inner_product(q.v, k.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(k.v, k.v))) as distance "
    "from q join e k on q.label = k.label)",
    "r as (select *, row_number() over (partition by query_id, file_id order by round(distance, 6), id) as rank from d)",
)

ORACLES["kb_topk"] = with_(*_VEC) + (
    "select query_id, cast(rank as integer) as rank, id, file_id, round(distance, 6) + 0.0 as distance from r where rank <= 5"
)
ORACLES["kb_context"] = with_(*_VEC) + (
    "select query_id, file_id, case when length(ctx) > 1500 then concat(substring(ctx, 1, 1500), chr(10) || '...[截断]') else ctx end as kb_context "
    "from (select query_id, file_id, string_agg(concat('vec ', cast(id as varchar), ' ', repeat('x', id % 3 * 400)), chr(10) || '---' || chr(10) order by rank) as ctx "
    "from r where rank <= 3 group by 1, 2) t"
)


# ------------------------------------------------------------------ intake and streaming
# Spark's text writer puts a newline after each document's text.
_FILE_LOGS = f"logs as (select doc_id // {DOCS_PER_LOG} as log_id, concat(string_agg(text, chr(10) order by doc_id), chr(10)) as text from documents group by 1)"

ORACLES["stream_logs"] = _funnel_oracle(_FILE_LOGS).rstrip("\n") + (
    ",\nsn as (select log_id, count(*) as s from keyed group by 1),\n"
    "cn as (select log_id, count(distinct cluster_id) as c from keyed group by 1)\n"
    "select l.log_id as log_no, case when coalesce(sn.s, 0) = 0 then '未发现安全威胁' "
    "else printf('发现%d个安全事件，共%d条可疑日志聚类而成', 0, sn.s) end as summary, "
    "cast((length(l.text) + 3999) // 4000 as bigint) as total_chunks_processed, "
    "cast(coalesce(sn.s, 0) as bigint) as suspicious_chunks, cast(coalesce(cn.c, 0) as bigint) as clustered_events "
    "from logs l left join sn on sn.log_id = l.log_id left join cn on cn.log_id = l.log_id"
)

ORACLES["read_logs"] = (
    with_(_FILE_LOGS) + "select log_id as log_no, cast(length(text) as bigint) as n_chars, md5(text) as text_md5 from logs"
)


ORACLES["stream_cluster_window_300s"] = with_(*_seclog_chain()) + (
    "select log_id, time_bucket(interval 300 second, ts) as window_start, "
    "time_bucket(interval 300 second, ts) + interval 300 second as window_end, cluster_id, "
    "count(*) as sample_count, min(event_id) as first_chunk_ix "
    "from keyed group by log_id, time_bucket(interval 300 second, ts), cluster_id "
    "having time_bucket(interval 300 second, ts) + interval 300 second <= "
    "(select max(ts) from events) - interval 10 minute"
)

ORACLES["stream_verdicts"] = with_(
    *_seclog_chain(),
    "fc as (select c.log_id, c.cluster_id, c.first_event_id as event_id, e.ts as seen_at from clusters c join events e on e.event_id = c.first_event_id)",
    "ans as (select fc.*, seen_at + to_minutes(cast(event_id % 3 * 40 as integer)) as answered_at from fc where event_id % 5 <> 4)",
    "wm as (select least((select max(seen_at) from fc), (select max(answered_at) from ans)) - interval 10 minute as w)",
    "j as (select fc.*, a.answered_at is not null as answered from fc left join ans a on a.event_id = fc.event_id and a.log_id = fc.log_id "
    "and a.cluster_id = fc.cluster_id and a.answered_at <= fc.seen_at + interval 1 hour)",
    "emitted as (select * from j where answered or seen_at + interval 1 hour < (select w from wm))",
) + (
    "select e.log_id, e.cluster_id, e.event_id, case when answered then v.is_threat end as is_threat, case when answered then v.attack_type end as attack_type, "
    "case when answered then v.confidence end as confidence, case when answered then v.error else 'llm_json_parse_failed' end as error "
    "from emitted e left join verdicts v on v.log_id = e.log_id and v.cluster_no = e.event_id"
)

ORACLES["stream_worklist"] = with_(
    *views("seclog"),
    "src as (select event_id, line as x from seclog)",
    *ioc_ctes("src", ["event_id"]),
    f"k as materialized (select distinct {_ROUTE} as ioc_type, value as ioc_value, ts from kept_i i join seclog s on s.event_id = i.event_id where {_ROUTE} is not null)",
    "asks as (select ioc_type, ioc_value, min(ts) as asked_at from k group by all union all "
    "select a.ioc_type, a.ioc_value, min(k.ts) from asks a join k on k.ioc_type = a.ioc_type and k.ioc_value = a.ioc_value "
    f"and k.ts >= a.asked_at + interval {rules.REPUTATION_TTL_SEC} second group by all)",
).replace("with ", "with recursive ", 1) + "select ioc_type, ioc_value, cast(asked_at as varchar) as asked_at from asks"

_LETTERS = "[" + ", ".join(f"cast(length(content) - length(replace(content, '{c}', '')) as double)" for c in "aeiorst") + "]"
ORACLES["kb_end_to_end"] = with_(
    _FILE_LOGS,
    "f as (select log_id, text, sha256(text) as h from logs)",
    "u as (select f.* from f join (select h, min(cast(log_id as varchar)) as m from f group by 1) w on w.h = f.h and w.m = cast(f.log_id as varchar))",
    "c as (select concat('log', cast(log_id as varchar)) as home, cast(o // 450 as integer) as ix, substring(text, o + 1, 500) as content "
    "from u, unnest(range(0, length(text), 450)) as r(o))",
    f"v as (select *, concat(home, '_chunk_', cast(ix as varchar)) as id, {_LETTERS} as e from c)",
    "n as (select * from v where list_sum(e) > 0)",
    "d as (select q.home as query_id, k.id, k.content, round(1 - list_inner_product(q.e, k.e) / (sqrt(list_inner_product(q.e, q.e)) * "
    "sqrt(list_inner_product(k.e, k.e))), 6) as dist from n q join n k on q.ix = 0)",
    "t as (select *, row_number() over (partition by query_id order by dist, id) as rank from d)",
    f"x as (select query_id, string_agg(content, chr(10) || '---' || chr(10) order by rank) as ctx from t where rank <= {rules.KB_ANALYSIS_TOP_K} group by 1)",
    f"y as (select query_id, case when length(ctx) > {rules.KB_CONTEXT_MAX_CHARS} then concat(substring(ctx, 1, {rules.KB_CONTEXT_MAX_CHARS}), "
    f"{_lit(rules.KB_CONTEXT_TRUNCATION_MARK)}) else ctx end as ctx from x)",
) + "select query_id, cast(length(ctx) as integer) as n_chars, md5(ctx) as context_md5 from y"


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

