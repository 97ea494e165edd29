"""Enrichment: reputation and domain-registration snapshots joined to indicators.

Network lookups of the original become snapshot tables of raw responses
``(key…, http_status, body, fetched_at)``; the cache TTL becomes a freshness
predicate against an explicit ``as_of`` time. Joins are plain equi-joins: AQE
measures the snapshot side at runtime and broadcasts it only when it is under
the broadcast threshold, otherwise it shuffles (and splits skewed keys).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    LongType,
    StringType,
    StructField,
    StructType,
    VariantType,
)

from .. import rules
from ..functions.text import clean_domain


def route_ioc(ioc_type: Column) -> Column:
    """Lookup kind of an indicator type: ip / domain / hash; null = not routable."""
    m = F.create_map(*[x for k, v in rules.IOC_ROUTES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, ioc_type)


def fresh(df: DataFrame, as_of: str, ttl_sec: int, ts_col: str = "fetched_at") -> DataFrame:
    """Rows younger than the TTL at ``as_of`` (strict ``age < ttl``; one fetched after ``as_of`` is younger still)."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(ts_col))
    return df.where(age < ttl_sec)


def latest(df: DataFrame, keys: Sequence[str], ts_col: str = "fetched_at") -> DataFrame:
    """Newest row per key (a later write replaces an earlier one).

    ``max`` over a struct led by the timestamp: partial-aggregatable, so a key
    with many fetches is collapsed map-side; ties break on the remaining columns.
    """
    rest = [c for c in df.columns if c not in keys and c != ts_col]
    best = F.max(F.struct(F.col(ts_col), *[F.col(c) for c in rest])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest], F.col(f"_b.{ts_col}").alias(ts_col))


def with_clean_domain(raw: DataFrame) -> DataFrame:
    """Registration responses keyed by the cleaned name, so that spellings of one domain are one key."""
    return raw.withColumn("domain", clean_domain(F.col("domain")))


def fresh_snapshot(raw: DataFrame, keys: Sequence[str], as_of: str, ttl_sec: int, drop_errors: bool = False) -> DataFrame:
    """Latest fresh response per key (what the TTL cache would return). Failures are remembered like
    answers; with ``drop_errors`` only statuses 200 and 404 count."""
    kept = raw.where(F.col("http_status").isin(200, rules.REPUTATION_NOT_FOUND_STATUS)) if drop_errors else raw
    return latest(fresh(kept, as_of, ttl_sec), keys)


_REPUTATION_BODY = StructType(
    [
        StructField(
            "data",
            StructType(
                [
                    StructField(
                        "attributes",
                        StructType(
                            [
                                StructField(
                                    "last_analysis_stats",
                                    StructType([StructField("malicious", LongType()), StructField("suspicious", LongType())]),
                                ),
                                StructField("reputation", LongType()),
                                StructField("first_submission_date", LongType()),
                                StructField("tags", ArrayType(StringType())),
                            ]
                        ),
                    )
                ]
            ),
        )
    ]
)


def project_reputation(raw: DataFrame) -> DataFrame:
    """200 → counts (missing → 0), score, first_seen, ≤10 tags; 404 → found=false;
    429 and other statuses → error text."""
    a = F.from_json(F.col("body"), _REPUTATION_BODY)["data"]["attributes"]
    st = F.col("http_status")
    ok, nf = st == 200, st == rules.REPUTATION_NOT_FOUND_STATUS
    stats = a["last_analysis_stats"]
    return raw.select(
        "ioc_type",
        "ioc_value",
        F.when(ok, F.lit(True)).when(nf, F.lit(False)).alias("found"),
        F.when(ok, F.coalesce(stats["malicious"], F.lit(0))).when(nf, F.lit(0)).cast("int").alias("malicious_count"),
        F.when(ok, F.coalesce(stats["suspicious"], F.lit(0))).cast("int").alias("suspicious_count"),
        F.when(ok, F.coalesce(a["reputation"], F.lit(0))).cast("int").alias("community_score"),
        F.when(ok, a["first_submission_date"]).alias("first_seen"),
        F.when(ok, F.slice(F.coalesce(a["tags"], F.array().cast("array<string>")), 1, rules.REPUTATION_TAGS_MAX)).alias("tags"),
        F.when(st == rules.REPUTATION_RATE_LIMIT_STATUS, F.lit(rules.REPUTATION_RATE_LIMIT_ERROR))
        .when(~ok & ~nf, F.format_string(rules.REPUTATION_STATUS_ERROR, st))
        .alias("error"),
        "fetched_at",
    )


_RDAP_BODY = StructType(
    [
        StructField(
            "events",
            ArrayType(StructType([StructField("eventAction", StringType()), StructField("eventDate", StringType())])),
        ),
        StructField("nameservers", ArrayType(StructType([StructField("ldhName", StringType())]))),
        StructField(
            "entities",
            ArrayType(StructType([StructField("roles", ArrayType(StringType())), StructField("vcardArray", VariantType())])),
        ),
        StructField("status", ArrayType(StringType())),
    ]
)
_WHOIS_BODY = StructType(
    [
        StructField("registrar", StringType()),
        StructField("creation_date", VariantType()),
        StructField("expiration_date", VariantType()),
        StructField("name_servers", ArrayType(StringType())),
        StructField("status", VariantType()),
    ]
)


def _event_date(events: Column, action: str) -> Column:
    """Date of the last event with this action (later keys overwrite earlier ones)."""
    return F.get(F.reverse(F.filter(events, lambda e: e["eventAction"] == action)), 0)["eventDate"]


def _first_or_value(v: Column) -> Column:
    """A multi-valued WHOIS field shows its first value; absent → ''."""
    first = F.try_variant_get(v, "$[0]", "string")
    scalar = F.try_variant_get(v, "$", "string")
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    return F.coalesce(F.when(is_list, first).otherwise(scalar), F.lit(""))


def _py_list_repr(arr: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]"))


def project_registration(raw: DataFrame) -> DataFrame:
    """RDAP and WHOIS responses → one registration row per (cleaned) domain."""
    r = F.from_json(F.col("body"), _RDAP_BODY)
    w = F.from_json(F.col("body"), _WHOIS_BODY)
    is_rdap = F.col("source") == "rdap"
    ok = F.col("http_status") == 200
    registrar_entity = F.get(F.filter(r["entities"], lambda e: F.array_contains(e["roles"], "registrar")), 0)
    vcard = F.try_variant_get(registrar_entity["vcardArray"], "$[1]", "array<array<variant>>")
    fn_item = F.get(F.filter(vcard, lambda it: F.try_variant_get(it[0], "$", "string") == "fn"), 0)
    rdap_registrar = F.coalesce(F.try_variant_get(fn_item[3], "$", "string"), F.lit(""))
    rdap_ns = F.slice(
        F.transform(F.filter(r["nameservers"], lambda n: n["ldhName"].isNotNull()), lambda n: n["ldhName"]),
        1,
        rules.REGISTRATION_NS_MAX,
    )
    whois_ns = F.slice(
        F.transform(F.coalesce(w["name_servers"], F.array().cast("array<string>")), lambda s: F.lower(s)),
        1,
        rules.REGISTRATION_NS_MAX,
    )
    whois_status = F.coalesce(F.try_variant_get(w["status"], "$", "string"), F.lit(""))
    return raw.select(
        "domain",
        "source",
        F.when(ok, F.when(is_rdap, rdap_registrar).otherwise(F.coalesce(w["registrar"], F.lit("")))).alias("registrar"),
        F.when(
            ok,
            F.when(is_rdap, F.coalesce(_event_date(r["events"], "registration"), F.lit(""))).otherwise(
                _first_or_value(w["creation_date"])
            ),
        ).alias("creation_date"),
        F.when(
            ok,
            F.when(is_rdap, F.coalesce(_event_date(r["events"], "expiration"), F.lit(""))).otherwise(
                _first_or_value(w["expiration_date"])
            ),
        ).alias("expiration_date"),
        F.when(ok, F.when(is_rdap, rdap_ns).otherwise(whois_ns)).alias("name_servers"),
        F.when(
            ok,
            F.when(is_rdap, _py_list_repr(F.coalesce(r["status"], F.array().cast("array<string>")))).otherwise(whois_status),
        ).alias("status"),
        F.when(~ok, F.format_string(rules.REGISTRATION_STATUS_ERROR, F.col("http_status"))).alias("error"),
        "fetched_at",
    )


def routable_iocs(ioc_rows: DataFrame) -> DataFrame:
    """Indicator rows plus ``route`` (ip/domain/hash); non-routable types keep a null route."""
    return ioc_rows.withColumn("route", route_ioc(F.col("type")))


def enrich_reputation(ioc_rows: DataFrame, reputation: DataFrame) -> DataFrame:
    """Left join on (route, value): every indicator row kept, ``vt_*`` null when unknown."""
    rep = reputation.select(
        F.col("ioc_type").alias("_rt"),
        F.col("ioc_value").alias("_rv"),
        *[F.col(c).alias(f"vt_{c}") for c in ("found", "malicious_count", "suspicious_count", "community_score", "first_seen", "tags", "error")],
    )
    rows = routable_iocs(ioc_rows)
    return rows.join(rep, (rows["route"] == rep["_rt"]) & (rows["value"] == rep["_rv"]), "left").drop("_rt", "_rv")


def enrich_registration(ioc_rows: DataFrame, registration: DataFrame) -> DataFrame:
    """Domain indicators joined on the cleaned domain; ``whois_*`` null otherwise."""
    reg = registration.select(
        F.col("domain").alias("_rd"),
        *[F.col(c).alias(f"whois_{c}") for c in ("registrar", "creation_date", "expiration_date", "name_servers", "status", "error")],
    )
    rows = ioc_rows.withColumn("_cd", F.when(F.col("type") == "domain", clean_domain(F.col("value"))))
    return rows.join(reg, rows["_cd"] == reg["_rd"], "left").drop("_rd", "_cd")


def registration_worklist(ioc_rows: DataFrame, registration_keys: DataFrame) -> DataFrame:
    """Distinct cleaned domains with no fresh registration response."""
    keys = ioc_rows.where(F.col("type") == "domain").select(clean_domain(F.col("value")).alias("domain")).distinct()
    return keys.join(registration_keys.select("domain"), "domain", "left_anti")


def lookup_worklist(ioc_rows: DataFrame, reputation_keys: DataFrame) -> DataFrame:
    """Distinct routable (route, value) with no fresh snapshot row: what is left to look up."""
    keys = routable_iocs(ioc_rows).where(F.col("route").isNotNull()).select(
        F.col("route").alias("ioc_type"), F.col("value").alias("ioc_value")
    ).distinct()
    return keys.join(reputation_keys.select("ioc_type", "ioc_value"), ["ioc_type", "ioc_value"], "left_anti")
