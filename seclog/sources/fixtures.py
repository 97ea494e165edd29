"""Generated views over the driver tables (FIXTURES.md).

The same SQL text runs in Spark and in DuckDB; only a few type/function names
differ per dialect. Each view is derived from ``events`` so its size grows
with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DIALECT = {
    "spark": {
        "S": "string",
        "SHA256": "sha2(cast(event_id % 40 as string), 256)",
        "B64": "base64(cast(concat('cmd.exe /c ping 198.51.100.', event_id % 4, ' -n 1') as binary))",
    },
    "duckdb": {
        "S": "varchar",
        "SHA256": "sha256(cast(event_id % 40 as varchar))",
        "B64": "to_base64(encode(concat('cmd.exe /c ping 198.51.100.', event_id % 4, ' -n 1')))",
    },
}

# One log line per event; every indicator type appears.
SECLOG_SQL = """select event_id, ts, user_id, case event_id % 12
 when 0 then concat('sshd failed password from ', 10 + event_id % 5, '.', user_id % 250, '.1.', event_id % 7, ' port 22')
 when 1 then concat('src=203.0.113.', user_id % 20, ' GET http://c2-', event_id % 9, '.evil.xyz/p?id=1%20union select 1')
 when 2 then concat('proc C:', chr(92), 'Windows', chr(92), 'Temp', chr(92), 'p', event_id % 6, '.exe powershell -enc')
 when 3 then concat('reg HKLM', chr(92), 'Software', chr(92), 'Run', chr(92), 'k', event_id % 4)
 when 4 then concat('mutex ', chr(92), 'BaseNamedObjects', chr(92), 'm', event_id % 5)
 when 5 then concat('file hash ', md5(cast(event_id % 40 as {S})), ' seen on 192.0.2.', event_id % 3)
 when 6 then concat('file hash ', sha1(cast(event_id % 40 as {S})), ' quarantined')
 when 7 then concat('file hash ', {SHA256}, ' mimikatz')
 when 8 then concat('mail from u', user_id % 10, '@mail', event_id % 3, '.bad.top rcpt staff@example.com')
 when 9 then concat('User-Agent: sqlmap/1.', event_id % 8, ' (http://sqlmap.org)')
 when 10 then concat('payload ', {B64}, ' end')
 else concat('user ', user_id, ' action ', event_type, ' ok') end as line
from events"""

# Model responses keyed by (user, event): strict JSON, fenced JSON with a
# trailing comma, prose around JSON, and a failure text.
VERDICT_RAW_SQL = """select user_id as log_id, event_id as cluster_no,
 case event_id % 4 when 0 then obj when 1 then concat('```json', chr(10), replace(obj, '}', ',}'), chr(10), '```')
  when 2 then concat('Result: ', obj, ' end') else 'Error: timeout' end as raw
from (select user_id, event_id, concat('{"is_threat":', case when event_id % 13 = 3 then '""' when event_id % 13 = 4 then '"false"' when event_id % 13 = 5 then '0' when event_id % 13 = 6 then '2.5' when event_id % 3 = 0 then 'false' else 'true' end, ',"attack_type":"t', event_id % 5, '","mitre_id":"T10', 10 + event_id % 7, '","tactic":"tac', event_id % 3, '","technique_name":"tech', event_id % 7, '","confidence":0.', event_id % 10, ',"evidence":"e","recommendation":"r"}') as obj from events) o"""

# Reputation responses: two fetches per address (one fresh, one stale at
# as_of 2024-01-31 00:00:00), statuses 200/404/429; domains with twelve tags;
# hashes fetched after as_of, statuses 200/404/500.
REPUTATION_RAW_SQL = """select 'ip' as ioc_type, concat('203.0.113.', k) as ioc_value,
 case k % 4 when 2 then 404 when 3 then 429 else 200 end as http_status,
 case when k % 4 < 2 then concat('{"data":{"attributes":{"last_analysis_stats":{"malicious":', k, case when k % 4 = 0 then ',"suspicious":1' else '' end, '},"reputation":-', k, ',"first_submission_date":1700000000,"tags":["a","b"]}}}') end as body,
 case f when 0 then timestamp '2024-01-30 23:30:00' else timestamp '2024-01-30 20:00:00' end as fetched_at
from (select distinct user_id % 20 as k from events) t cross join (select 0 as f union all select 1 as f) u
union all select 'domain', concat('c2-', k, '.evil.xyz'), 200,
 concat('{"data":{"attributes":{"last_analysis_stats":{"malicious":', k, '},"tags":["t1","t2","t3","t4","t5","t6","t7","t8","t9","t10","t11","t12"]}}}'), timestamp '2024-01-30 23:40:00'
from (select distinct event_id % 9 as k from events) d
union all select 'hash', md5(cast(k as {S})), case when k % 5 = 0 then 404 when k % 5 = 1 then 500 else 200 end,
 case when k % 5 > 1 then concat('{"data":{"attributes":{"reputation":', k, ',"tags":[]}}}') end, timestamp '2024-01-31 00:10:00'
from (select distinct event_id % 40 as k from events) h"""

# Registration responses in RDAP (even) and WHOIS (odd) form; every third domain has a later response under another
# spelling, with seven name servers.
REGISTRATION_RAW_SQL = """select concat('c2-', k, '.evil.xyz') as domain, case when k % 2 = 0 then 'rdap' else 'whois' end as source,
 case when k % 4 = 2 then 404 else 200 end as http_status,
 case when k % 4 = 0 then concat('{"events":[{"eventAction":"registration","eventDate":"2020-01-0', k + 1, '"},{"eventAction":"expiration","eventDate":"2030-01-01"}],"nameservers":[{"ldhName":"NS1.X.ORG"},{"other":1}],"entities":[{"roles":["registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Reg', k, '"]]]}],"status":["active"]}')
  when k % 2 = 1 then concat('{"registrar":"Reg', k, '","creation_date":["2020-01-0', k, '","2021-01-01"],"expiration_date":["2030-01-01"],"name_servers":["NS1.X.ORG"],"status":"ok"}') end as body,
 timestamp '2024-01-30 23:00:00' as fetched_at
from (select distinct event_id % 9 as k from events) t
union all select concat(' HTTPS://C2-', k, '.Evil.XYZ:443/x'), 'whois', 200,
 concat('{"registrar":"Late', k, '","creation_date":"2021-02-03","name_servers":["A.x","B.x","C.x","D.x","E.x","F.x","G.x"]}'), timestamp '2024-01-30 23:30:00'
from (select distinct event_id % 9 as k from events) s where k % 3 = 0"""

# The point in time the snapshot fixtures are judged at.
FIXTURE_AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "seclog": SECLOG_SQL,
    "verdict_raw": VERDICT_RAW_SQL,
    "reputation_raw": REPUTATION_RAW_SQL,
    "registration_raw": REGISTRATION_RAW_SQL,
}


def view_sql(name: str, dialect: str = "spark") -> str:
    sql = VIEWS[name]
    for k, v in _DIALECT[dialect].items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def fixture(spark: SparkSession, name: str, events: DataFrame) -> DataFrame:
    """Build a fixture view from an ``events`` DataFrame (Spark dialect)."""
    return spark.sql(re.sub(r"\bfrom events\b", "from {events}", view_sql(name, "spark").replace("{", "{{").replace("}", "}}")), events=events)
