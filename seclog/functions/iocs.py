"""Indicator extraction as one array-valued column expression.

For every pattern the text is scanned by ``regexp_extract_all`` (the pattern is
a literal, so Spark compiles it once per task): once for the matches and, if there
are any, once for the gaps in front of them, and for a pattern with a value group
once for that group. Gaps and matches are all of the text up to the last match, so a match's
context is joined from its neighbours, without positions. Repeats of a lower-cased
value (first wins) go by sorting, so a row with very many matches takes time in proportion
to their number (times its logarithm).

Cheap necessary-condition prefilters (``contains``) skip the regex work for
texts that cannot match a pattern; they never change a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .. import rules

IOC_STRUCT = StructType(
    [
        StructField("type", StringType()),
        StructField("value", StringType()),
        StructField("confidence", DoubleType()),
        StructField("context", StringType()),
    ]
)
IOC_ARRAY = ArrayType(IOC_STRUCT)

# The domain pattern repeats a group that can match in several ways, which java.util.regex does by recursion: a long
# dotted run overflows its stack. This one takes the whole run without giving back (possessive, a loop), and the
# longest part of it that ends in a listed top-level domain is cut out afterwards: the same matches.
_LABEL = r"(?=[a-zA-Z0-9])[a-zA-Z0-9\-]{1,63}+(?<!-)\."
_TLD = "(?:" + "|".join(rules.DOMAIN_TLDS) + r")\b"
DOMAIN_RUN = rf"\b(?:{_LABEL})++(?:{_TLD})?+"
DOMAIN_IN_RUN = rf"(?Udi)\A(?s:.*)\.{_TLD}"

_WS_EDGES = r"(?U)^\s+|\s+\z"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(c, F.lit(_WS_EDGES), F.lit(""))


def _flags(ignore_case: bool) -> str:
    return "(?Udi)" if ignore_case else "(?Ud)"


def pattern_regex(pattern: str, ignore_case: bool) -> str:
    return _flags(ignore_case) + pattern


def gap_regex(pattern: str, ignore_case: bool) -> str:
    """Group 1 = the text between the previous match and the next one.

    ``\\G`` pins every attempt to the end of the previous match, so a scan that
    finds no further match stops after one pass instead of restarting at each
    later position (which would be quadratic in the unmatched tail).
    """
    return _flags(ignore_case) + "\\G(?s:(.*?))(?:" + pattern + ")"


def _prefilter(ioc_type: str, x: Column) -> Column | None:
    if ioc_type in ("ipv4", "domain"):
        return x.contains(".")
    if ioc_type == "url":
        return x.contains("://")
    if ioc_type in rules.HASH_TYPES:
        return x.rlike("[a-fA-F0-9]{32}")
    if ioc_type == "email":
        return x.contains("@")
    if ioc_type == "user_agent":
        return x.rlike("(?Udi)(?:User-Agent|user-agent):")
    if ioc_type in ("registry", "mutex"):
        return x.contains("\\")
    if ioc_type == "process":
        return x.contains("\\") | x.contains("/")
    return None


def _empty_iocs() -> Column:
    return F.array().cast(IOC_ARRAY)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _is_run(ioc_type: str, pattern: str) -> bool:
    return ioc_type == "domain" and pattern == _DOMAIN_PATTERN


def _found(x: Column, ioc_type: str, pattern: str, ignore_case: bool, group: int = 0) -> Column:
    """The matches (or what a group of theirs holds) as an array."""
    rx = F.lit(pattern_regex(DOMAIN_RUN if _is_run(ioc_type, pattern) else pattern, ignore_case))
    pre, matches = _prefilter(ioc_type, x), F.regexp_extract_all(x, rx, F.lit(group))
    return matches if pre is None else F.when(pre, matches).otherwise(F.array().cast("array<string>"))


def _value(v: Column) -> Column:
    return F.regexp_replace(strip_ws(v), F.lit("[" + rules.VALUE_RSTRIP_CHARS + r"]+\z"), F.lit(""))


def type_keys(
    x: Column, ioc_type: str, pattern: str, ignore_case: bool, group: int, drop_domains: Sequence[str] = tuple(rules.FALSE_POSITIVE_DOMAINS)
) -> Column:
    """``array<string>``: the distinct lower-cased values of :func:`type_iocs`, from one scan."""
    values = _found(x, ioc_type, pattern, ignore_case, group)
    if _is_run(ioc_type, pattern):
        values = F.filter(F.transform(values, lambda m: F.regexp_extract(m, DOMAIN_IN_RUN, 0)), lambda v: v != "")
    keys = F.array_distinct(F.transform(values, lambda v: F.lower(_value(v))))
    return F.array_except(keys, F.array(*map(F.lit, drop_domains))) if ioc_type == "domain" and drop_domains else keys


def type_iocs(
    x: Column,
    ioc_type: str,
    pattern: str,
    ignore_case: bool,
    group: int,
    context: int | None = rules.CONTEXT_WINDOW,
    drop_domains: Sequence[str] = tuple(rules.FALSE_POSITIVE_DOMAINS),
    around: tuple[Column, Column] | None = None,
) -> Column:
    """array<struct<type,value,confidence,context>> for one pattern, in match order.

    ``around=(lead, trail)``: what stands before and after ``x`` in a longer text; it is only seen in contexts.
    ``context=None``: contexts are null and the text is scanned once.
    """
    run = _is_run(ioc_type, pattern)
    lead, trail = around or (F.lit(""), F.lit(""))
    # neighbours that surely make up a context: no match of the fixed patterns is under four characters
    reach = (context or 0) // 4 + 2 if (ioc_type, pattern, ignore_case, group) in rules.IOC_PATTERNS else (context or 0) + 1
    confidence = rules.HASH_CONFIDENCE if ioc_type in rules.HASH_TYPES else rules.DEFAULT_CONFIDENCE
    left, right = (lambda c: F.left(c, F.lit(context))), (lambda c: F.right(c, F.lit(context)))

    def items(b: Column) -> Column:
        """``key, i, value, context`` of each match."""

        def item(s: Column, i: Column) -> Column:
            inner = F.regexp_extract(s["m"], DOMAIN_IN_RUN, 0) if run else s["v"]
            if context is None:
                return seen_(inner, i, F.lit(None).cast("string"))
            core = inner if run else s["m"]
            before = F.concat(lead, F.array_join(F.slice(b["tails"], F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), ""), right(s["g"]))
            after = F.concat(F.array_join(F.slice(b["heads"], i + 2, F.lit(reach)), ""), b["rest"], trail)
            if run:
                after = F.concat(F.substring(s["m"], F.length(inner) + 1, F.lit(context)), after)
            around_ = F.concat(right(before), core, left(after))
            return seen_(inner, i, strip_ws(F.replace(around_, F.lit("\n"), F.lit(" "))))

        def seen_(inner: Column, i: Column, text: Column) -> Column:
            value = _value(inner)
            seen = F.struct(F.lower(value).alias("key"), i.alias("i"), value.alias("value"), text.alias("context"))
            return F.when(inner != "", seen) if run else seen

        return F.array_compact(F.transform(b["steps"], item)) if run else F.transform(b["steps"], item)

    def located(ms: Column) -> Column:
        gaps = ms if context is None else F.regexp_extract_all(x, F.lit(gap_regex(DOMAIN_RUN if run else pattern, ignore_case)), F.lit(1))
        values = _found(x, ioc_type, pattern, ignore_case, group) if group else ms
        steps = F.transform(F.arrays_zip(gaps.alias("g"), ms.alias("m"), values.alias("v")), lambda s: F.struct(s["g"].alias("g"), s["m"].alias("m"), s["v"].alias("v")))

        def pieces(steps: Column) -> Column:
            if context is None:
                return F.struct(steps.alias("steps"))
            upto = F.aggregate(steps, F.lit(0), lambda n, s: n + F.length(s["g"]) + F.length(s["m"]))
            return F.struct(
                steps.alias("steps"),
                F.transform(steps, lambda s: right(F.concat(right(s["g"]), right(s["m"])))).alias("tails"),
                F.transform(steps, lambda s: left(F.concat(left(s["g"]), left(s["m"])))).alias("heads"),
                F.substring(x, upto + 1, F.lit(context)).alias("rest"),
            )

        def firsts(ordered: Column) -> Column:
            new = F.filter(ordered, lambda s, i: (i == 0) | (s["key"] != F.get(ordered, i - 1)["key"]))
            if ioc_type == "domain" and drop_domains:
                new = F.filter(new, lambda s: ~s["key"].isin(*drop_domains))
            return F.array_sort(F.transform(new, lambda s: F.struct(s["i"].alias("i"), s["value"].alias("value"), s["context"].alias("context"))))

        found = _bound(F.array_sort(_bound(_bound(steps, pieces), items)), firsts)
        return F.transform(
            found,
            lambda s: F.struct(F.lit(ioc_type).alias("type"), s["value"].alias("value"), F.lit(confidence).cast("double").alias("confidence"), s["context"].alias("context")),
        )

    # the matches are bound once; the second scan, for the gaps, runs only where there are any
    return _bound(_found(x, ioc_type, pattern, ignore_case), lambda ms: F.when(F.size(ms) > 0, located(ms)).otherwise(_empty_iocs()))


_DOMAIN_PATTERN = next(p for t, p, _, _ in rules.IOC_PATTERNS if t == "domain")


def any_indicator(x: Column, drop_domains: Sequence[str] = tuple(rules.FALSE_POSITIVE_DOMAINS)) -> Column:
    """Whether :func:`iocs_from_decoded` would find anything, without positions, contexts or duplicates: each pattern stops
    at its first match, and only the domains are listed, because some do not count."""
    found = F.lit(False)
    for t, pattern, ignore_case, _group in sorted(rules.IOC_PATTERNS, key=lambda p: p[0] == "domain"):
        if t == "domain":
            runs = F.regexp_extract_all(x, F.lit(pattern_regex(DOMAIN_RUN, ignore_case)), F.lit(0))
            hit = F.exists(runs, lambda r: ~F.lower(F.regexp_extract(r, DOMAIN_IN_RUN, 0)).isin("", *drop_domains))
        else:
            hit = x.rlike(pattern_regex(pattern, ignore_case))
        pre = _prefilter(t, x)
        found = found | (hit if pre is None else F.when(pre, hit).otherwise(F.lit(False)))
    return found


def first_address(x: Column) -> Column:
    """The value of the first ipv4 indicator; null if there is none."""
    pattern = next(p for t, p, _, _ in rules.IOC_PATTERNS if t == "ipv4")
    return F.nullif(F.regexp_extract(x, pattern_regex(pattern, False), 0), F.lit(""))


def select_patterns(types: Sequence[str] | None = None, patterns=None):
    specs = list(patterns if patterns is not None else rules.IOC_PATTERNS)
    if types is None:
        return specs
    unknown = set(types) - {s[0] for s in specs}
    if unknown:
        raise ValueError(f"unknown indicator types: {sorted(unknown)}")
    return [s for s in specs if s[0] in set(types)]


_BUILT: dict = {}


def _built(name: str | None, key: tuple, build) -> Column:
    """An expression over named columns, built once per JVM and reused: building it costs thousands of driver→JVM calls,
    its result only depends on the arguments, and an unresolved expression can be shared by any number of plans."""
    if name is None:
        return build()
    from pyspark.sql import SparkSession

    key = (SparkSession.active().sparkContext.applicationId, name, *key)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def iocs_from_decoded(
    x: Column | str,
    context: int | None = rules.CONTEXT_WINDOW,
    types: Sequence[str] | None = None,
    patterns=None,
    drop_domains: Sequence[str] = tuple(rules.FALSE_POSITIVE_DOMAINS),
    around: tuple[str, str] | None = None,
) -> Column:
    """All indicators of an already-decoded text: pattern order, then position. ``around``: names of the columns with what
    stands before and after the text."""
    specs = [tuple(s) for s in select_patterns(types, patterns)]
    col = F.col(x) if isinstance(x, str) else x
    edges = None if around is None else (F.col(around[0]), F.col(around[1]))

    def build() -> Column:
        parts = [type_iocs(col, *s, context, drop_domains, edges) for s in specs]
        return F.concat(*parts) if len(parts) != 1 else parts[0]

    return _built(x if isinstance(x, str) else None, ("iocs", context, tuple(specs), tuple(drop_domains), around), build)


def keys_from_decoded(x: str, types: Sequence[str] | None = None, patterns=None, drop_domains: Sequence[str] = tuple(rules.FALSE_POSITIVE_DOMAINS)) -> Column:
    """``array<struct<type_ix,key>>``: the distinct (type, lower-cased value) of all indicators, without contexts."""
    specs = [tuple(s) for s in select_patterns(types, patterns)]

    def of(i: int, spec: tuple) -> Column:
        return F.transform(type_keys(F.col(x), *spec, drop_domains), lambda k: F.struct(F.lit(i).alias("type_ix"), k.alias("key")))

    return _built(x, ("keys", tuple(specs), tuple(drop_domains)), lambda: F.concat(*[of(i, s) for i, s in enumerate(specs)]))


def is_blank(raw: Column) -> Column:
    """Null, empty or whitespace-only text yields no indicators."""
    return raw.isNull() | raw.rlike(r"(?U)^\s*\z")


def ioc_rows(iocs: Column) -> Column:
    """Generator of ``ioc_ix, type, value, confidence, context`` rows.

    ``inline`` over an indexed copy of the array: the generator output needs
    no struct-field access afterwards, so the optimizer never clones the
    extraction expression once per field (as nested-column aliasing does
    for ``posexplode(...)`` followed by ``col.field`` selects).
    """
    return F.inline(
        F.transform(
            iocs,
            lambda x, i: F.struct(
                i.alias("ioc_ix"), x["type"].alias("type"), x["value"].alias("value"),
                x["confidence"].alias("confidence"), x["context"].alias("context"),
            ),
        )
    )

