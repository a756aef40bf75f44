"""The semantic type patterns, as data.

Each entry is (type, name, confidence in hundredths, regular expression, ignore case).  Of
several matches the highest confidence wins, and of equal ones the earlier entry."""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    type: str
    name: str
    confidence: int
    regex: str
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.regex}" if self.ignore_case else self.regex

    @property
    def group(self) -> int:
        """1 if the expression has a capturing group, whose text then is the value."""
        depth = self.regex.replace(r"\(", "")
        return int(any(depth[i] == "(" and depth[i : i + 2] != "(?" for i in range(len(depth))))


#: The recogniser's expressions and confidences, by category, in order.
PATTERNS: tuple[Pattern, ...] = (
    Pattern("TIMESTAMP", "iso8601", 95, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:?\d{2})?"),
    Pattern("TIMESTAMP", "unix_ms", 90, r"\b\d{13}\b"),
    Pattern("TIMESTAMP", "unix_sec", 85, r"\b\d{10}\b"),
    Pattern("TIMESTAMP", "syslog", 90, r"\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)?\s*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\s+\d{4})?\b"),
    Pattern("TIMESTAMP", "custom_yyyymmdd", 95, r"\b\d{8}-\d{2}:\d{2}:\d{2}:\d{3}\b"),
    Pattern("TIMESTAMP", "time_ms", 85, r"\b\d{2}:\d{2}:\d{2}[,\.]\d{3,6}\b"),
    Pattern("TIMESTAMP", "time_simple", 70, r"\b\d{2}:\d{2}:\d{2}\b"),
    Pattern("TIMESTAMP", "short_datetime", 85, r"\b\d{1,2}\.\d{2}\s+\d{2}:\d{2}:\d{2}\b"),
    Pattern("IP_ADDRESS", "ipv4", 95, r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    Pattern("IP_ADDRESS", "ipv6_full", 95, r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    Pattern("IP_ADDRESS", "ipv6_compressed", 90, r"\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b"),
    Pattern("PORT", "port_colon", 85, r":(\d{1,5})\b"),
    Pattern("PORT", "port_keyword", 90, r"\bport[:\s=]+(\d{1,5})\b", True),
    Pattern("SEVERITY", "standard_levels", 95, r"\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE|NOTICE)\b", True),
    Pattern("SEVERITY", "syslog_levels", 90, r"\b(emerg|alert|crit|err|warning|notice|info|debug)\b", True),
    Pattern("STATUS", "common_status", 85, r"\b(success|successful|failed?|failure|timeout|denied|accepted|rejected|ok|error)\b", True),
    Pattern("STATUS", "http_status", 95, r"\bstatus:\s*(\d{3})\b", True),
    Pattern("ERROR_CODE", "error_keyword", 95, r"\b(?:error|errno|err)[\s_-]?(?:code)?[:\s=]+([A-Z0-9_-]+)\b", True),
    Pattern("ERROR_CODE", "uppercase_code", 80, r"\b[A-Z]{2,}[\s_-]?\d{3,}\b"),
    Pattern("ERROR_CODE", "bracketed_error", 90, r"\[ERR[0-9X]+\]", True),
    Pattern("USER_ID", "user_keyword", 95, r"""\b(?:user|username|uid)[:\s=]+["\']?([a-zA-Z0-9_-]+)["\']?\b""", True),
    Pattern("USER_ID", "uid_numeric", 90, r"\buid[:\s=]+(\d+)\b", True),
    Pattern("PROCESS_ID", "pid_keyword", 95, r"\b(?:pid|process_id|proc)[:\s=]+(\d+)\b", True),
    Pattern("PROCESS_ID", "bracketed_number", 75, r"\[(\d{4,6})\]"),
    Pattern("METRIC_VALUE", "time_metric", 90, r"\b(\d+(?:\.\d+)?)\s*(ms|milliseconds?|seconds?|sec|minutes?|min|hours?|hrs?)\b", True),
    Pattern("METRIC_VALUE", "size_metric", 90, r"\b(\d+(?:\.\d+)?)\s*(bytes?|KB|MB|GB|TB)\b", True),
    Pattern("METRIC_VALUE", "percent_metric", 85, r"\b(\d+(?:\.\d+)?)\s*(%|percent|CPU|memory|disk)\b", True),
    Pattern("MODULE", "dotted_module", 85, r"\b([a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*){2,})\b"),
    Pattern("MODULE", "prefixed_component", 90, r"\b(Step_[A-Za-z]+)\b"),
    Pattern("REQUEST_ID", "bracketed_uuid", 95, r"\[req-([a-f0-9-]{36,})\]", True),
    Pattern("REQUEST_ID", "request_keyword", 90, r"\brequest[_-]?id[:\s=]+([a-zA-Z0-9-]+)\b", True),
    Pattern("FILENAME", "log_filename", 90, r"\b([a-zA-Z0-9_-]+\.log(?:\.\d+)?(?:\.\d{4}-\d{2}-\d{2}_\d{2}:\d{2}:\d{2})?)\b"),
    Pattern("FILENAME", "source_file", 85, r"\b([a-zA-Z0-9_/-]+\.(?:py|java|c|cpp|js|conf|cfg))\b"),
    Pattern("HOST", "fqdn", 90, r"\b([a-z0-9-]+(?:\.[a-z0-9-]+)+\.[a-z]{2,})\b", True),
    Pattern("HOST", "hostname", 75, r"\b([a-z][a-z0-9-]*(?:\.[a-z][a-z0-9-]*)+)\b"),
    Pattern("ACTION", "action_verb", 80, r"\b(start(?:ed|ing)?|stop(?:ped|ping)?|restart(?:ed|ing)?|open(?:ed|ing)?|clos(?:ed?|ing)|connect(?:ed|ing)?|disconnect(?:ed|ing)?)\b", True),
)

#: What a value is that no pattern fits, and a blank one.
DEFAULT = Pattern("MESSAGE", "default_message", 50, "")
UNKNOWN = Pattern("UNKNOWN", "no_match", 0, "")

#: Types of a domain of one's own, anchored at the start.
CUSTOM_PATTERNS: tuple[Pattern, ...] = (
    Pattern("ERROR_CODE", "custom_error_code", 95, r"^ERR-\d{4}$"),
    Pattern("ERROR_CODE", "custom_error_code", 90, r"^[A-Z]{3}-ERROR-\d{3,5}$"),
    Pattern("ERROR_CODE", "custom_error_code", 85, r"^E\d{6}$"),
    Pattern("TRANSACTION_ID", "custom_transaction_id", 95, r"^TXN-[A-Z0-9]{8}$"),
    Pattern("TRANSACTION_ID", "custom_transaction_id", 90, r"^ORDER-\d{6,10}$"),
    Pattern("TRANSACTION_ID", "custom_transaction_id", 80, r"^[A-F0-9]{32}$"),
    Pattern("CUSTOMER_ID", "custom_customer_id", 95, r"^CUST-\d{8}$"),
    Pattern("CUSTOMER_ID", "custom_customer_id", 85, r"^C\d{10}$"),
    Pattern("SESSION_ID", "custom_session_id", 95, r"^SID-[A-Z0-9]{16}$"),
    Pattern("SESSION_ID", "custom_session_id", 90, r"^sess_[a-f0-9]{32}$"),
)


class Registry:
    """Patterns in the order in which they win; custom ones may come before all others."""

    def __init__(self, patterns: tuple[Pattern, ...] = PATTERNS):
        self.patterns = tuple(patterns)

    def add_pattern(self, type: str, name: str, confidence: float, regex: str, ignore_case: bool = False, first: bool = False) -> Registry:
        new = Pattern(type, name, round(confidence * 100), regex, ignore_case)
        return Registry((new, *self.patterns) if first else (*self.patterns, new))

    def by_priority(self) -> list[Pattern]:
        return sorted(self.patterns, key=lambda p: -p.confidence)


def with_custom(custom: tuple[Pattern, ...] = CUSTOM_PATTERNS, least: float = 0.7) -> Registry:
    """A registry in which custom patterns over ``least`` win over every built-in one."""
    strong = tuple(p._replace(confidence=p.confidence + 100) for p in custom if p.confidence > least * 100)
    return Registry((*strong, *PATTERNS))
