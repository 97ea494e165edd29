"""URL filters: rules, and for what no rule fits, trust and distrust carried over the links between hosts.

Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
or the end. A null url or one without ``://`` has empty host and path. A rule ``host/path`` fits its host and all
subdomains if the url's path starts with its path; the longest rule wins.

Seeds: a host's seed of trust (distrust) is the number of its pages that rules allow (block). Edges: absolute
links (``href``, ``src``) from a page's host to another host, counted, and one between a host and its nearest
listed parent domain in either direction. Trust is personalised PageRank from the trusted seeds along the
edges; distrust is the same from the blocked seeds against them, so it reaches those who link to blocked hosts. Both
are in units of pages. A host is blocked if its distrust is over its trust by more than ``threshold`` of
its number of pages. Hosts without seeds and edges have neither and are allowed.

Everything is DataFrame operations. Masses are whole numbers (``UNIT`` for a page), so sums do not depend on
their order and reruns agree. Repeated rows are pages of their own. Links are counted per pair of hosts
before any shuffle; a step of the propagation joins one row per host with the edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table, with_small

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, STEPS, THRESHOLD = 0.85, 12, 0.5
#: Steps between two cuts of the lineage.
EVERY = 4
UNIT = 1_000_000
AFTER = r"(?s)^.*?://"
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, AFTER + r"([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER + r"[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null; of equal length the first in code point order."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _verdict(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def judged_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, ruled`` (the rule's verdict or null)."""
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", _verdict(F.col("rule"), rules))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``src, dst, w`` between different hosts. ``pages``: ``host, html``; ``hosts``: ``host``."""
    links = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    # every host's parent domains, nearest first; the nearest one that is a host itself gives an edge
    parts = F.split("host", r"\.")
    ups = hosts.where("host != ''").select("host", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("nth", "up")).where("up != ''")
    near = ups.join(hosts.select(F.col("host").alias("up")), "up").groupBy("host").agg(F.min(F.struct("nth", "up")).alias("m")).select("host", F.col("m.up").alias("up"))
    both = near.select(F.col("host").alias("src"), F.col("up").alias("dst"), F.lit(1).cast("long").alias("w"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagated(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """``kind, host, mass``: what the seeds (``kind, host, mass``) give each host: the sum over the steps t of the
    mass that arrives after t steps, damped by ``damping**t`` (PageRank's constant factor is left out).
    Kind 'distrust' walks against the edges. Mass at a host without an edge goes nowhere."""
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    total = ways.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    ways = cut_lineage(ways.join(total, ["kind", "src"]))
    wave = cut_lineage(seeds)
    waves = []
    for step in range(1, steps + 1):
        moved = wave.withColumnRenamed("host", "src").join(ways, ["kind", "src"])
        flow = F.floor(F.col("mass").cast("double") * F.lit(damping) * F.col("w").cast("double") / F.col("all").cast("double")).cast("long")
        wave = moved.select("kind", F.col("dst").alias("host"), flow.alias("flow")).groupBy("kind", "host").agg(F.sum("flow").alias("mass")).where("mass > 0")
        if step % EVERY == 0 or step == steps:
            wave = cut_lineage(wave)
        waves.append(wave)
    out = seeds
    for w in waves:
        out = out.unionByName(w)
    return out.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def blocked_hosts(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``host, bad`` from ``host, ruled, html``."""
    hosts = cut_lineage(pages.groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad")))
    seeds = hosts.select("host", F.inline(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("good") * UNIT).alias("mass")), F.struct(F.lit("distrust").alias("kind"), (F.col("bad") * UNIT).alias("mass")))))
    seeds = seeds.where("mass > 0 and host != ''").select("kind", "host", "mass")
    mass = propagated(host_edges(pages, hosts), seeds)
    net = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(-F.col("mass"))).alias("net"))
    over = F.coalesce(F.col("net"), F.lit(0)) > F.floor(F.col("n") * F.lit(threshold * UNIT))
    return hosts.join(net, "host", "left").select("host", over.alias("bad"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: ``page_id, host, path, rule, verdict``."""
    ruled = judged_by_rules(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    bad = cut_lineage(blocked_hosts(ruled))
    out = with_small(ruled.select("page_id", "host", "path", "rule", "ruled"), bad, ["host"], "left")
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _steps_sql() -> str:
    out = ""
    for i in range(1, STEPS + 1):
        out += f""",
v{i} as (select kind, dst host, sum(floor(mass::double * {DAMPING}::double * w::double / "all"::double)::bigint)::bigint mass
  from (select v.kind, v.mass, y.dst, y.w, y."all" from v{i - 1} v join ways y on v.kind = y.kind and v.host = y.src) group by all having sum(floor(mass::double * {DAMPING}::double * w::double / "all"::double)::bigint) > 0)"""
    return out


def _rule_sql() -> str:
    out = "null"
    for _, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, _, rest = rule.partition("/")
        out = f"case when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{rest}') then '{rule}' else {out} end"
    return out


SQL = f"""
with u as materialized (select page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
r as materialized (select *, case {' '.join(f"when rule = '{x}' then '{v}'" for v, x in RULES)} end ruled from (select *, {_rule_sql()} rule from u)),
h as materialized (select host, count(*) n, count(*) filter (ruled = 'allow') good, count(*) filter (ruled = 'block') bad from r group by 1),
l as (select src, dst, count(*) w from (select host src, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s<>]+)', 1)), '{UPPER}', '{LOWER}') dst
  from u where host != '') where src != dst group by all),
up as (select host, i nth, array_to_string(p[i:], '.') up from (select host, string_split(host, '.') p, unnest(range(2, greatest(len(string_split(host, '.')), 2) + 1)) i from h where host != '')),
near as (select up.host, arg_min(up.up, nth) up from up join h on h.host = up.up where up.up != '' group by 1),
e as (select src, dst, sum(w)::bigint w from (from l union all select host, up, 1 from near union all select up, host, 1 from near) group by all),
k as (select 'trust' kind, src, dst, w from e union all select 'distrust', dst, src, w from e),
ways as materialized (select k.*, (sum(w) over (partition by kind, src))::bigint "all" from k),
v0 as (select kind, host, mass from (select 'trust' kind, host, good * {UNIT} mass from h union all select 'distrust', host, bad * {UNIT} from h) where mass > 0 and host != ''){_steps_sql()},
net as (select host, sum(case when kind = 'distrust' then mass else -mass end) net from ({' union all '.join(f'from v{i}' for i in range(STEPS + 1))}) group by 1),
b as (select h.host, coalesce(net, 0) > floor(n * {THRESHOLD * UNIT}) bad from h left join net on net.host = h.host)
select page_id, r.host, path, rule, coalesce(ruled, case when b.bad then 'block' else 'allow' end) verdict from r left join b on b.host = r.host
"""
