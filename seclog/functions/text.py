"""Small scalar column helpers (all built-in expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def keyword_hits(raw: Column, keywords: Sequence[str] = tuple(rules.SUSPICIOUS_KEYWORDS)) -> Column:
    """Keywords found case-insensitively in the raw text, in keyword-list order.

    Written without a lambda so the lower-cased text is computed once per row
    (common-subexpression elimination) and the whole thing stays in codegen.
    """
    lowered = F.lower(raw)
    hits = [F.when(lowered.contains(k.lower()), F.lit(k)) for k in keywords]
    return F.coalesce(F.array_compact(F.array(*hits)), F.array().cast("array<string>"))


def clean_domain(c: Column) -> Column:
    """strip → lower → drop https://, http://, ftp:// (each once, in this order) → cut at / or :."""
    d = F.lower(F.regexp_replace(c, F.lit(r"(?U)^\s+|\s+\z"), F.lit("")))
    prefix = "^" + "".join(f"(?:{p})?" for p in rules.DOMAIN_SCHEME_PREFIXES)
    d = F.regexp_replace(d, F.lit(prefix), F.lit(""))
    return F.regexp_extract(d, r"^[^/:]*", 0)


def content_hash(text: Column, length: int = rules.KB_CONTENT_HASH_LENGTH) -> Column:
    """First ``length`` hex digits of sha256 over the UTF-8 text."""
    return F.substring(F.sha2(text, 256), 1, length)


def chunk_id(file_id: Column, chunk_index: Column) -> Column:
    return F.concat(file_id, F.lit("_chunk_"), chunk_index.cast("string"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def preview(text: Column, n: int = rules.PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, n)
