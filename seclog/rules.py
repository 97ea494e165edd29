"""Rule constants.

Every value in this module is a FIXED VALUE: results only agree with the
analyser this engine re-implements if these stay exactly as written. They are
plain data; all behaviour lives in the column functions and operators. Each
public function takes the matching value as a parameter so a caller can
override it.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — indicator patterns, in the order results are emitted.
# (type, regex, ignore_case, value_group). Regex text is written in the
# java.util.regex dialect Spark uses; every pattern is compiled with the
# Unicode-class (U) and unix-lines (d) flags so that \b, \w, \s, \d and "."
# behave like a Python 3 str pattern.
# ---------------------------------------------------------------------------
IOC_PATTERNS: list[tuple[str, str, bool, int]] = [
    ("ipv4",
     r"\b(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\b",
     False, 0),
    ("domain",
     r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+"
     r"(?:com|net|org|io|cn|ru|tk|xyz|top|info|biz|cc|me|co|dev|app|cloud)\b",
     True, 0),
    ("url", r"https?://[^\s<>\"'\)\]\}]+", True, 0),
    ("md5", r"\b[a-fA-F0-9]{32}\b", False, 0),
    ("sha1", r"\b[a-fA-F0-9]{40}\b", False, 0),
    ("sha256", r"\b[a-fA-F0-9]{64}\b", False, 0),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", False, 0),
    ("user_agent", r"(?:User-Agent|user-agent):\s*(.{10,200})", True, 1),
    ("process",
     r"(?:[A-Z]:\\[^\s]*\.(?:exe|dll|bat|ps1|vbs|scr)|/[a-zA-Z0-9_./\-]+\.(?:sh|py|pl|rb|elf))\b",
     False, 0),
    ("registry", r"(?:HKEY_[A-Z_]+|HKLM|HKCU|HKCR)\\[^\s\"']+", True, 0),
    ("mutex", r"\\BaseNamedObjects\\[^\s\"'\\]+", True, 0),
]

# FIXED VALUES — the top-level domains of the domain pattern above.
DOMAIN_TLDS = ["com", "net", "org", "io", "cn", "ru", "tk", "xyz", "top", "info", "biz", "cc", "me", "co", "dev", "app", "cloud"]

# FIXED VALUES — characters stripped from the right of every value after
# surrounding whitespace is removed.
VALUE_RSTRIP_CHARS = ".,;:)"

# FIXED VALUES — confidence per indicator type.
HASH_TYPES = ["md5", "sha1", "sha256"]
HASH_CONFIDENCE = 0.9
DEFAULT_CONFIDENCE = 0.7

# FIXED VALUES — context characters kept on each side of a match.
CONTEXT_WINDOW = 80

# FIXED VALUES — domain values dropped after extraction (exact, lower-case).
FALSE_POSITIVE_DOMAINS = [
    "localhost", "example.com", "test.local", "internal.corp",
    "google.com", "microsoft.com", "apple.com", "amazonaws.com",
]

# FIXED VALUES — suspicious keywords, matched case-insensitively as
# substrings of the raw chunk; hits keep this order.
SUSPICIOUS_KEYWORDS = [
    "union select", "<script>", "eval(", "exec(",
    "cmd.exe", "powershell", "webshell", "../..",
    "reverse_shell", "mimikatz", "cobaltstrike",
]

# FIXED VALUES — payload decoding.
URL_DECODE_ROUNDS = 3
BASE64_RUN = r"[A-Za-z0-9+/]{20,}={0,2}"

# FIXED VALUES — chunking.
ANALYSIS_CHUNK_SIZE = 4000
ANALYSIS_CHUNK_OVERLAP = 0
KB_CHUNK_SIZE = 500
KB_CHUNK_OVERLAP = 50

# FIXED VALUES — clustering.
CLUSTER_UNKNOWN_IP = "unknown"
CLUSTER_IOC_ONLY = "ioc_only"
CLUSTER_ID_LENGTH = 12
EVENT_TIME_WINDOW_SEC = 300

# FIXED VALUES — knowledge base.
KB_DEFAULT_FILE_ID = "default"
KB_TOP_K = 5
KB_ANALYSIS_TOP_K = 3
KB_CONTENT_HASH_LENGTH = 16
EMBED_BATCH = 20
KB_QUERY_FALLBACK_CHARS = 200
KB_CONTEXT_MAX_CHARS = 1500
KB_CONTEXT_SEPARATOR = "\n---\n"
KB_CONTEXT_TRUNCATION_MARK = "\n...[截断]"
ENHANCE_IOC_VALUES = 3
ENHANCE_IOC_SUFFIX = "threat intelligence IOC malicious indicator"
ENHANCE_PLAIN_SUFFIX = "cybersecurity threat analysis SOC"
SOC_QUERY_KEYWORDS = [
    "attack", "vulnerability", "cve", "malware", "intrusion",
    "threat", "indicator", "exploit", "webshell", "injection",
]

# FIXED VALUES — preview.
PREVIEW_CHARS = 5000

# FIXED VALUES — the fence and the trailing comma that verdict texts may have.
JSON_FENCE = r"```(?:json)?\s*\n?(.*?)\n?\s*```"
JSON_TRAILING_COMMA = r",\s*([}\]])"

# FIXED VALUES — verdict parsing and run summary texts.
VERDICT_PARSE_ERROR = "llm_json_parse_failed"
SUMMARY_CLEAN = "未发现安全威胁"
SUMMARY_FOUND = "发现%d个安全事件，共%d条可疑日志聚类而成"

# FIXED VALUES — risk bands over verdict confidence (lower bounds, inclusive).
RISK_HIGH_MIN = 0.7
RISK_MEDIUM_MIN = 0.4
RISK_HIGH = "高风险"
RISK_MEDIUM = "中风险"
RISK_LOW = "低风险"

# FIXED VALUES — display defaults of the event report.
DISPLAY_DEFAULTS = {
    "attack_type": "未知攻击",
    "evidence": "无详细证据",
    "mitre_id": "unmapped",
    "tactic": "未知阶段",
    "technique_name": "未知技术",
    "recommendation": "无建议",
}
DISPLAY_NO_IOC = "无IOC"

# FIXED VALUES — enrichment.
IOC_ROUTES = {"ipv4": "ip", "domain": "domain", "md5": "hash", "sha1": "hash", "sha256": "hash"}
REPUTATION_TTL_SEC = 3600
REGISTRATION_TTL_SEC = 7200
REPUTATION_TAGS_MAX = 10
REGISTRATION_NS_MAX = 5
DOMAIN_SCHEME_PREFIXES = ["https://", "http://", "ftp://"]
REPUTATION_NOT_FOUND_STATUS = 404
REPUTATION_RATE_LIMIT_STATUS = 429
REPUTATION_RATE_LIMIT_ERROR = "VT API速率限制(429)，请稍后重试"
REPUTATION_STATUS_ERROR = "VT API返回%d"
REGISTRATION_STATUS_ERROR = "RDAP返回%d"

# FIXED VALUES — file admission.
LOG_MAX_MB = 200
IOC_ONLY_MAX_MB = 50
LOG_EXTENSIONS = ["log", "txt", "json"]
REJECT_TOO_LARGE = "FILE_TOO_LARGE"
REJECT_MISSING_NAME = "MISSING_FILENAME"
