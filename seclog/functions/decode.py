"""Payload decoding: URL unquote, HTML entities, one base64 run.

All steps are built-in expressions (JVM). For HTML entities, which Spark has no function for, a
text is split at its references; each is looked up in a constant table made from Python's own
(names by their first two characters, then the longest name that the reference begins with).

Each step references its input as few times as possible, and
:func:`with_decoded` materialises every step as its own column, so the
expression tree stays linear in the number of steps (a step that used its
input four times would make three nested rounds 64 copies deep).
"""

from __future__ import annotations

import html
import html.entities
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

DECODE_MODES = ("reference", "safe", "none")

# Python's str.isprintable(): no code point of category C* or Z* except ' '.
_PRINTABLE = r"^(?:[^\p{C}\p{Z}]| )*\z"
_PURE_HEX_HASH = r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\z"


def url_unquote_once(c: Column) -> Column:
    """One round of percent-decoding with Python ``unquote`` semantics.

    ``+`` is protected as ``%2B`` and a ``%`` not followed by two hex digits
    as ``%25``, so the decoder restores both literally and never fails;
    invalid UTF-8 byte runs become U+FFFD. A text without ``%`` comes back
    unchanged.
    """
    protected = F.regexp_replace(
        F.replace(c, F.lit("+"), F.lit("%2B")), F.lit("%(?![0-9A-Fa-f]{2})"), F.lit("%25")
    )
    return F.try_url_decode(protected)


def url_unquote(c: Column, rounds: int = rules.URL_DECODE_ROUNDS) -> Column:
    """Repeated unquote; rounds after the fixpoint change nothing."""
    for _ in range(rounds):
        c = url_unquote_once(c)
    return c


# what Python's html.unescape takes for a reference
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_REPLACEMENT = "\ufffd"


def _entity_table() -> Column:
    """``map<two characters, struct<names, texts>>``: the names that begin so (the longest first) and what they stand for."""
    by: dict[str, list[tuple[str, str]]] = {}
    for name, text in html.entities.html5.items():
        by.setdefault(name[:2], []).append((name, text))
    table = {}
    for start, pairs in sorted(by.items()):
        pairs.sort(key=lambda p: (-len(p[0]), p[0]))
        table[start] = {"names": [n for n, _ in pairs], "texts": [t for _, t in pairs]}
    # one constant, read when the plan is made
    return F.from_json(F.lit(json.dumps(table)), "map<string,struct<names:array<string>,texts:array<string>>>")


def _named(s: Column, table: Column) -> Column:
    """A reference without its ``&`` by the longest name that it begins with; null if there is none."""
    of = F.try_element_at(table, F.substring(s, 1, 2))

    def found(entry: Column) -> Column:
        i = F.get(F.filter(F.transform(entry["names"], lambda n, i: F.when(s.startswith(n), i)), lambda i: i.isNotNull()), 0)
        return F.concat(F.get(entry["texts"], i), F.substring(s, F.length(F.get(entry["names"], i)) + 1, F.length(s)))

    return F.get(F.transform(F.array(of), found), 0)


def _numbered(s: Column) -> Column:
    """A numeric reference without its ``&#``."""
    digits = F.regexp_replace(s, F.lit("^[xX]?0*|;$"), F.lit(""))
    # what has more digits than any code point is beyond them
    code = F.when(F.length(digits) > 7, F.lit(0x7FFFFFFF)).otherwise(F.conv(F.when(digits == "", F.lit("0")).otherwise(digits), 16, 10).cast("int"))
    plain = F.when(F.length(digits) > 7, F.lit(0x7FFFFFFF)).otherwise(F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("int")))
    number = F.when(s.rlike("^[xX]"), code).otherwise(plain)

    def text(n: Column) -> Column:
        odd = F.create_map(*[F.lit(v) for k, t in html._invalid_charrefs.items() for v in (k, t)])
        return (
            F.when(n.isin(*html._invalid_charrefs), F.try_element_at(odd, n))
            .when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit(_REPLACEMENT))
            .when(n.isin(*html._invalid_codepoints), F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    return F.get(F.transform(F.array(number), text), 0)


def html_unescape(c: Column) -> Column:
    """HTML5 entity unescape, as Python's ``html.unescape``; a text without ``&`` comes back unchanged."""

    def replaced(table: Column) -> Column:
        def one(r: Column) -> Column:
            s = F.substring(r, 2, F.length(r))
            return F.when(s.startswith("#"), _numbered(F.substring(s, 2, F.length(s)))).otherwise(F.coalesce(_named(s, table), r))

        references = F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0)), one)
        gaps = F.split(c, _REFERENCE, -1)
        # a gap, a reference, a gap, ...
        both = F.zip_with(gaps, references, lambda g, r: F.concat(g, F.coalesce(r, F.lit(""))))
        return F.array_join(both, "")

    return F.when(c.contains("&"), F.get(F.transform(F.array(_entity_table()), replaced), 0)).otherwise(c)


def base64_text(m: Column) -> Column:
    """UTF-8 text of a base64 run (invalid bytes dropped); null when Python's
    lenient decoder would reject the padding."""
    data = F.regexp_replace(m, F.lit("=+$"), F.lit(""))
    n = F.length(data) % 4
    pads = F.length(m) - F.length(data)
    valid = (F.length(m) > 0) & ((n == 0) | ((n == 2) & (pads == 2)) | ((n == 3) & (pads >= 1)))
    padded = F.concat(data, F.when(n == 2, F.lit("==")).when(n == 3, F.lit("=")).otherwise(F.lit("")))
    text = F.replace(F.make_valid_utf8(F.unbase64(padded).cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.when(valid, text)


def base64_applies(m: Column, text: Column, mode: str = "reference") -> Column:
    ok = text.isNotNull() & text.rlike(_PRINTABLE)
    if mode == "safe":
        ok = ok & ~m.rlike(_PURE_HEX_HASH)
    return ok


def base64_run_decode(c: Column, mode: str = "reference") -> Column:
    """Replace every occurrence of the first base64-looking run by its decoding,
    when it decodes and the text is printable (column form)."""
    m = F.regexp_extract(c, rules.BASE64_RUN, 0)
    text = base64_text(m)
    return F.when(base64_applies(m, text, mode), F.replace(c, m, text)).otherwise(c)


def check_mode(mode: str) -> None:
    if mode not in DECODE_MODES:
        raise ValueError(f"decode mode must be one of {DECODE_MODES}, got {mode!r}")


def with_decoded(df: DataFrame, text_col: str, out: str = "decoded", mode: str = "reference") -> DataFrame:
    """Adds ``out`` = decoded ``text_col``; every step is its own column."""
    check_mode(mode)
    if mode == "none":
        return df.withColumn(out, F.col(text_col))
    staged = (
        df.withColumn("_dec_url", url_unquote(F.col(text_col)))
        .withColumn("_dec_html", html_unescape(F.col("_dec_url")))
        .withColumn("_dec_run", F.regexp_extract(F.col("_dec_html"), rules.BASE64_RUN, 0))
        .withColumn("_dec_txt", base64_text(F.col("_dec_run")))
    )
    h, m, t = F.col("_dec_html"), F.col("_dec_run"), F.col("_dec_txt")
    return staged.withColumn(out, F.when(base64_applies(m, t, mode), F.replace(h, m, t)).otherwise(h)).drop(
        "_dec_url", "_dec_html", "_dec_run", "_dec_txt"
    )
