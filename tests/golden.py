"""Hand-made inputs with the results they must have, as literals."""

# (text, decoded text, indicators of the plain text, indicators of the decoded text if they differ, else None)
EDGE = [
    ('', '', [], None),
    ('   \n\t ', '   \n\t ', [], None),
    ('GET / HTTP/1.1\r\nUser-Agent: Mozilla/5.0 (X11; Linux)\r\nHost: a.evil.xyz\r\n', 'GET / HTTP/1.1\r\nUser-Agent: Mozilla/5.0 (X11; Linux)\r\nHost: a.evil.xyz\r\n', [('domain', 'a.evil.xyz'), ('user_agent', 'Mozilla/5.0 (X11; Linux')], None),
    ('src\xa0203.0.113.9\xa0dst\u20281.2.3.4', 'src\xa0203.0.113.9\xa0dst\u20281.2.3.4', [('ipv4', '203.0.113.9'), ('ipv4', '1.2.3.4')], None),
    ('😀😀 prefix 10.0.0.1 then 😀 evil.com', '😀😀 prefix 10.0.0.1 then 😀 evil.com', [('ipv4', '10.0.0.1'), ('domain', 'evil.com')], None),
    ('éabc.com and abc.com', 'éabc.com and abc.com', [('domain', 'abc.com')], None),
    ('bad %zz escape %c3 lone and %253Cscript%253E double', 'bad %zz escape � lone and <script> double', [], None),
    ('payload YWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXo= end', 'payload abcdefghijklmnopqrstuvwxyz end', [], None),
    ('run QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo9 x', 'run ABCDEFGHIJKLMNOPQRSTUVWXYZ= x', [], None),
    ('odd QUJDREVGR0hJSktMTU5PUFFSU1RVVldY== y', 'odd ABCDEFGHIJKLMNOPQRSTUVWX y', [], None),
    ('hex d41d8cd98f00b204e9800998ecf8427e and da39a3ee5e6b4b0d3255bfef95601890afd80709', 'hex w]}4om8{4|yn and da39a3ee5e6b4b0d3255bfef95601890afd80709', [('md5', 'd41d8cd98f00b204e9800998ecf8427e'), ('sha1', 'da39a3ee5e6b4b0d3255bfef95601890afd80709')], [('sha1', 'da39a3ee5e6b4b0d3255bfef95601890afd80709')]),
    ('Evil.COM then evil.com then EVIL.com', 'Evil.COM then evil.com then EVIL.com', [('domain', 'Evil.COM')], None),
    ('url http://x.io/a.b), done; https://y.cc/p?q=1.', 'url http://x.io/a.b), done; https://y.cc/p?q=1.', [('domain', 'x.io'), ('domain', 'y.cc'), ('url', 'http://x.io/a.b'), ('url', 'https://y.cc/p?q=1')], None),
    ("&lt;script&gt;eval(atob('x'))&lt;/script&gt; &amp;&#39; &copy;", "<script>eval(atob('x'))</script> &' ©", [], None),
    ('mail a.b+c@d-e.co, reg HKEY_LOCAL_MACHINE\\Soft\\X;', 'mail a.b+c@d-e.co, reg HKEY_LOCAL_MACHINE\\Soft\\X;', [('domain', 'd-e.co'), ('email', 'a.b+c@d-e.co'), ('registry', 'HKEY_LOCAL_MACHINE\\Soft\\X')], None),
    ('C:\\Users\\a b\\run.exe and /usr/bin/x.sh and \\BaseNamedObjects\\Mtx1', 'C:\\Users\\a b\\run.exe and /usr/bin/x.sh and \\BaseNamedObjects\\Mtx1', [('process', '/usr/bin/x.sh'), ('mutex', '\\BaseNamedObjects\\Mtx1')], None),
]

# (verdict text, is_threat, error)
VERDICTS = [
    ('{"is_threat": true, "confidence": 0.8}', True, None),
    ('```json\n{"is_threat": false, "attack_type": "x",}\n```', False, None),
    ('Result: {"is_threat": true, "mitre_id": "T1059"} end', True, None),
    ('{"is_threat": true, "is_threat": false}', False, None),
    ('{"x": [1, 2,], "is_threat": true}', True, None),
    ('{"is_threat": "yes, confirmed"}', True, None),
    ('{"is_threat": "false"}', True, None),
    ('{"is_threat": ""}', False, None),
    ('{"is_threat": 1}', True, None),
    ('{"is_threat": 0}', False, None),
    ('{"is_threat": 0.0}', False, None),
    ('{"is_threat": 0.5}', True, None),
    ('{"is_threat": []}', False, None),
    ('{"is_threat": [0]}', True, None),
    ('{"is_threat": {}}', False, None),
    ('{"is_threat": {"a": 1}}', True, None),
    ('{"is_threat": null}', None, None),
    ('{"other": 1}', None, None),
    ('{"a": 1}{"b": 2}', None, "llm_json_parse_failed"),
    ("Error: timeout", None, "llm_json_parse_failed"),
    ("", None, "llm_json_parse_failed"),
    ("   ", None, "llm_json_parse_failed"),
    ("null", None, "llm_json_parse_failed"),
    ("[1, 2]", None, "list indices must be integers or slices, not str"),
    ('"just text"', None, "'str' object does not support item assignment"),
]

# (line, first address, sorted keywords, md5 of "address:keywords" cut to 12 digits is the cluster)
CLUSTERS = [
    ("src=10.0.0.1 to 10.0.0.2 PowerShell mimikatz", "10.0.0.1", "mimikatz|powershell"),
    ("host evil.xyz only", "unknown", "ioc_only"),
    ("UNION SELECT 1 <SCRIPT>", "unknown", "<script>|union select"),
]

# (query, enhanced query)
QUERIES = [
    ("", ""),
    (" \n", ""),
    ("10.0.0.1 evil.xyz http://a.io/x 10.0.0.2", "10.0.0.1 10.0.0.2 evil.xyz threat intelligence IOC malicious indicator"),
    ("plain words", "plain words cybersecurity threat analysis SOC"),
    ("a Malware report", "a Malware report"),
]

# (text, size, overlap, chunks)
CHUNKS = [
    ("", 5, 0, []),
    ("abcde", 5, 0, ["abcde"]),
    ("abcdef", 5, 0, ["abcde", "f"]),
    ("a\n😀b\r\nc", 3, 0, ["a\n😀", "b\r\n", "c"]),
    ("abcde", 5, 2, ["abcde", "de"]),
    ("abc", 5, 2, ["abc"]),
    ("abcdefgh😀", 5, 2, ["abcde", "defgh", "gh😀"]),
]
