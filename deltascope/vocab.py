"""Vocabularies, weights and patterns of the domain.

Everything here is a fixed value: results depend on these words, numbers and
patterns being exactly what they are, so they are stated plainly as data and the
operators take them as parameters with these tables as defaults.
"""

# --------------------------------------------------------------------------
# Severity order
SEVERITIES = ["None", "Low", "Moderate", "High", "Critical"]

# Permission -> (level, score). Names not listed are Moderate / 10.
PERMISSION_RISK = {
    "cookies": ("Critical", 25),
    "history": ("Critical", 25),
    "webRequest": ("Critical", 25),
    "webRequestBlocking": ("Critical", 30),
    "debugger": ("Critical", 30),
    "scripting": ("Critical", 25),
    "nativeMessaging": ("Critical", 30),
    "proxy": ("Critical", 25),
    "privacy": ("Critical", 20),
    "tabs": ("High", 15),
    "downloads": ("High", 15),
    "browsingData": ("High", 15),
    "management": ("High", 15),
    "clipboardRead": ("High", 15),
    "clipboardWrite": ("High", 10),
    "geolocation": ("High", 15),
    "storage": ("Moderate", 5),
    "activeTab": ("Moderate", 5),
    "notifications": ("Moderate", 5),
    "contextMenus": ("Moderate", 5),
    "unlimitedStorage": ("Moderate", 5),
    "alarms": ("Low", 2),
    "idle": ("Low", 2),
    "offscreen": ("Moderate", 10),
}
DEFAULT_PERMISSION_RISK = ("Moderate", 10)

# Permissions that raise the combination rule / the critical rule
SENSITIVE_WITH_GLOBAL_HOST = ["cookies", "history", "scripting"]
CRITICAL_PERMISSIONS = [
    "cookies", "history", "webRequest", "webRequestBlocking",
    "debugger", "scripting", "nativeMessaging", "proxy",
]

# Host patterns
GLOBAL_HOSTS = ["<all_urls>", "*://*/*", "http://*/*", "https://*/*"]
HOST_SCOPE_SCORES = {"Global": 100, "Global Wildcard": 90, "Domain Wildcard": 50, "Specific Host": 10}

# Sensitive API patterns. `anchor` is a literal that must occur in
# any match; it lets a line be ruled out before the regular expression runs.
_MEMBER = r"(?:\.[a-zA-Z0-9_]+)+"
API_PATTERNS = [
    {"name": "chrome.cookies", "anchor": "chrome.cookies", "pattern": r"\bchrome\.cookies" + _MEMBER, "category": "Cookies", "severity": "Critical"},
    {"name": "chrome.history", "anchor": "chrome.history", "pattern": r"\bchrome\.history" + _MEMBER, "category": "History", "severity": "Critical"},
    {"name": "chrome.tabs", "anchor": "chrome.tabs", "pattern": r"\bchrome\.tabs" + _MEMBER, "category": "Tabs", "severity": "High"},
    {"name": "chrome.webRequest", "anchor": "chrome.webRequest", "pattern": r"\bchrome\.webRequest" + _MEMBER, "category": "Network Interception", "severity": "Critical"},
    {"name": "chrome.downloads", "anchor": "chrome.downloads", "pattern": r"\bchrome\.downloads" + _MEMBER, "category": "Downloads", "severity": "High"},
    {"name": "chrome.proxy", "anchor": "chrome.proxy", "pattern": r"\bchrome\.proxy" + _MEMBER, "category": "Proxy Control", "severity": "Critical"},
    {"name": "chrome.debugger", "anchor": "chrome.debugger", "pattern": r"\bchrome\.debugger" + _MEMBER, "category": "Debugger Access", "severity": "Critical"},
    {"name": "chrome.identity", "anchor": "chrome.identity", "pattern": r"\bchrome\.identity" + _MEMBER, "category": "Identity", "severity": "High"},
    {"name": "chrome.storage", "anchor": "chrome.storage", "pattern": r"\bchrome\.storage" + _MEMBER, "category": "Storage", "severity": "Moderate"},
    {"name": "chrome.scripting", "anchor": "chrome.scripting", "pattern": r"\bchrome\.scripting" + _MEMBER, "category": "Code Injection", "severity": "Critical"},
    {"name": "chrome.management", "anchor": "chrome.management", "pattern": r"\bchrome\.management" + _MEMBER, "category": "Management", "severity": "High"},
    {"name": "navigator.clipboard", "anchor": "navigator.clipboard", "pattern": r"\bnavigator\.clipboard" + _MEMBER, "category": "Clipboard", "severity": "High"},
    {"name": "fetch", "anchor": "fetch", "pattern": r"\bfetch\s*\(", "category": "Network Request", "severity": "Moderate"},
    {"name": "XMLHttpRequest", "anchor": "XMLHttpRequest", "pattern": r"\bnew\s+XMLHttpRequest\s*\(", "category": "Network Request", "severity": "Moderate"},
    {"name": "WebSocket", "anchor": "WebSocket", "pattern": r"\bnew\s+WebSocket\s*\(", "category": "WebSocket", "severity": "Moderate"},
    {"name": "sendBeacon", "anchor": "sendBeacon", "pattern": r"\bnavigator\.sendBeacon\s*\(", "category": "Telemetry Sink", "severity": "Moderate"},
    {"name": "localStorage", "anchor": "localStorage", "pattern": r"\blocalStorage\b", "category": "Local Storage", "severity": "Low"},
    {"name": "indexedDB", "anchor": "indexedDB", "pattern": r"\bindexedDB\b", "category": "Database Storage", "severity": "Low"},
]

# Obfuscation patterns
OBFUSCATION_PATTERNS = [
    {"name": "eval_call", "anchor": "eval", "pattern": r"\beval\s*\(", "score": 25, "description": "Dynamic code evaluation via eval()."},
    {"name": "new_function", "anchor": "Function", "pattern": r"\bnew\s+Function\s*\(", "score": 25, "description": "Dynamic function instantiation via new Function()."},
    {"name": "string_timer", "anchor": "set", "pattern": r"\b(?:setTimeout|setInterval)\s*\(\s*['\"`]", "score": 15, "description": "String-based timer execution."},
    {"name": "atob_decode", "anchor": "atob", "pattern": r"\batob\s*\(", "score": 10, "description": "Base64 decoding via atob()."},
    {"name": "from_char_code", "anchor": "String.fromCharCode", "pattern": r"\bString\.fromCharCode\s*\(", "score": 10, "description": "Char code decoding via String.fromCharCode()."},
    {"name": "hex_escaping", "anchor": r"\x", "pattern": r"(?:\\x[0-9a-fA-F]{2}){4,}", "score": 15, "description": "Hexadecimal string escaping sequence."},
    {"name": "unicode_escaping", "anchor": r"\u", "pattern": r"(?:\\u[0-9a-fA-F]{4}){4,}", "score": 15, "description": "Unicode string escaping sequence."},
    {"name": "dynamic_script_creation", "anchor": "document.createElement", "pattern": r"document\.createElement\s*\(\s*['\"`]script['\"`]\s*\)", "score": 15, "description": "Dynamic DOM script tag creation."},
    {"name": "dynamic_import", "anchor": "import", "pattern": r"\bimport\s*\(", "score": 10, "description": "Dynamic JavaScript module import."},
    {"name": "wasm_usage", "anchor": "WebAssembly", "pattern": r"\bWebAssembly\.(?:compile|instantiate)", "score": 20, "description": "WebAssembly binary execution."},
]
WASM_FILE = {"name": "wasm_file", "score": 25, "description": "WebAssembly binary file introduced in package."}
HIGH_ENTROPY = {"name": "high_entropy_string", "score": 15, "min_length": 40, "min_entropy": 5.0}
LONG_BASE64 = {"name": "long_base64_string", "score": 10, "min_length": 60, "description": "Long Base64 encoded string detected."}
DYNAMIC_EXECUTION_TYPES = [
    "eval_call", "new_function", "string_timer", "dynamic_script_creation",
    "dynamic_import", "wasm_usage", "wasm_file",
]

# Data sources and outbound sinks
FLOW_SOURCES = [
    {"name": "cookies", "anchor": "chrome.cookies.", "pattern": r"\bchrome\.cookies\.(?:get|getAll)\b"},
    {"name": "history", "anchor": "chrome.history.", "pattern": r"\bchrome\.history\.(?:search|getVisits)\b"},
    {"name": "clipboard", "anchor": "navigator.clipboard", "pattern": r"\bnavigator\.clipboard\.readText\b"},
    {"name": "tabs", "anchor": "chrome.tabs.", "pattern": r"\bchrome\.tabs\.(?:query|get)\b"},
    {"name": "storage", "anchor": "chrome.storage.", "pattern": r"\bchrome\.storage\.(?:local|sync)\.get\b"},
    {"name": "localStorage", "anchor": "localStorage", "pattern": r"\blocalStorage\.(?:getItem|key)\b|\blocalStorage\b"},
    {"name": "sessionStorage", "anchor": "sessionStorage", "pattern": r"\bsessionStorage\.(?:getItem|key)\b|\bsessionStorage\b"},
    {"name": "indexedDB", "anchor": "indexedDB", "pattern": r"\bindexedDB\b"},
    {"name": "geolocation", "anchor": "navigator.geolocation", "pattern": r"\bnavigator\.geolocation\.(?:getCurrentPosition|watchPosition)\b"},
    {"name": "dom_form_fields", "anchor": "", "pattern": r"\b(?:document\.querySelector|getElementById|getElementsByName)\s*\([^)]*(?:input|password|email|form|textarea)"},
]
FLOW_SINKS = [
    {"name": "fetch", "anchor": "fetch", "pattern": r"\bfetch\s*\("},
    {"name": "xhr", "anchor": "XMLHttpRequest", "pattern": r"\bnew\s+XMLHttpRequest\b"},
    {"name": "websocket", "anchor": "WebSocket", "pattern": r"\bnew\s+WebSocket\b"},
    {"name": "sendBeacon", "anchor": "sendBeacon", "pattern": r"\bnavigator\.sendBeacon\b"},
    {"name": "form_submission", "anchor": "submit", "pattern": r"\b(?:HTMLFormElement\.prototype\.submit|\.submit\s*\()"},
    {"name": "external_messaging", "anchor": "", "pattern": r"\b(?:chrome|browser)\.runtime\.(?:sendMessage|connect)\b|\bpostMessage\s*\("},
]
CRITICAL_FLOW_SOURCES = ["cookies", "history", "clipboard", "dom_form_fields"]
FLOW_CONFIDENCE = 0.75
FLOW_CLAIM = "Heuristic indicator only; not confirmed exfiltration."

# symbols
FUNCTION_PATTERN = r"\bfunction\s+([a-zA-Z0-9_$]+)\s*\(|\bconst\s+([a-zA-Z0-9_$]+)\s*=\s*(?:function|\([^)]*\)\s*=>)"
LISTENER_PATTERN = r"(?:addEventListener|chrome\.[a-zA-Z0-9\.]+\.addListener)\s*\(\s*['\"`]?([a-zA-Z0-9_\-]+)['\"`]?"

# Network indicators
_URL_HOST = r"(?:\[[0-9a-fA-F:]+\]|[a-zA-Z0-9.\-]+)"
_URL_PATH = r"(?:/[^\s'\"`<>]*)?"
URL_PATTERN = r"https?://" + _URL_HOST + r"(?::\d+)?" + _URL_PATH
WEBSOCKET_PATTERN = r"wss?://" + _URL_HOST + r"(?::\d+)?" + _URL_PATH
IPV4_PATTERN = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
DOMAIN_PATTERN = r"(?<![@/\w.-])(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?::\d+)?" + _URL_PATH
NON_NETWORK_TLDS = [
    "js", "json", "html", "htm", "css", "png", "jpg", "jpeg", "gif",
    "svg", "wasm", "txt", "md", "map",
]
LOCAL_HOST_PATTERN = (
    r"^127\.\d+\.\d+\.\d+$|^(?i:localhost)$|^0\.0\.0\.0$|^\[?::1\]?$"
    r"|(?i:\.local)$|(?i:untrusted-domain\.com)$"
)
UNCOMMON_PORT_PATTERN = r":(?!80(?:/|$)|443(?:/|$))\d+"
DECODED_SOURCE = "Decoded static endpoint indicator"
BASE64_MIN_LENGTH = 12
BASE64_MAX_LENGTH = 4096
DECODED_MAX_BYTES = 8192
MAX_PLAIN_JSON_BYTES = 2 * 1024 * 1024

# Archive quotas
MAX_ARCHIVE_BYTES = 25 * 1024 * 1024
MAX_ARCHIVE_ENTRIES = 1000
MAX_ENTRY_RATIO = 10.0
MAX_UNPACKED_BYTES = 100 * 1024 * 1024

# --------------------------------------------------------------------------
# Labels, sources, tiers
LABELS = {
    # label: (severity order, may be used for training)
    "benign_transition": (0, True),
    "risky_transition": (1, True),
    "malicious_transition": (2, True),
    "controlled_malicious_transition": (2, False),
    "needs_review": (-1, False),
    "uncertain": (-1, False),
    "excluded": (-2, False),
}
LABEL_SOURCES = {
    # source: reliability order
    "controlled_ground_truth": 5,
    "peer_reviewed_dataset_label": 4,
    "reputable_security_report": 4,
    "repository_documented_change": 3,
    "multi_analyst_manual_review": 3,
    "single_reviewer_provisional": 2,
    "unknown": 0,
}
OWN_SCORE_SOURCE = "engine_score"
REVIEW_STATUSES = ["unreviewed", "provisional", "reviewed", "adjudicated", "excluded"]
QUALITY_TIERS = [
    "CONTROLLED_GROUND_TRUTH", "EXTERNAL_CONFIRMED", "MULTI_REVIEWER_ADJUDICATED",
    "SINGLE_REVIEWER_PROVISIONAL", "UNCERTAIN",
]
SUPERVISED_LABELS = ["benign_transition", "risky_transition", "malicious_transition"]
GOLD_TIERS = ["CONTROLLED_GROUND_TRUTH", "EXTERNAL_CONFIRMED", "MULTI_REVIEWER_ADJUDICATED"]
SOURCE_CATEGORIES = ["real_public", "research_dataset", "open_source_repository", "controlled", "unknown/unverified"]
ACCEPTABLE_SOURCES = ["real_public", "research_dataset", "open_source_repository", "controlled"]
RESEARCH_LICENSES = ["allowed", "research_only", "redistribution_restricted"]
QUARANTINE_LICENSES = ["unknown", "disallowed"]
CONFIDENCES = ["low", "medium", "high"]
SPLITS = ["train", "validation", "test"]
HOLDOUT_SPLIT = "controlled_holdout"
TARGET_MAPPING = {
    "benign_transition": "BENIGN",
    "risky_transition": "REVIEW_WORTHY",
    "controlled_malicious_transition": "REVIEW_WORTHY",
}
BINARY_LABELS = {"benign_transition": 0, "risky_transition": 1, "controlled_malicious_transition": 1}
HUMAN_LABELS = {
    "BENIGN_TRANSITION": "benign_transition",
    "RISKY_TRANSITION": "risky_transition",
    "MALICIOUS_TRANSITION": "malicious_transition",
    "UNCERTAIN": "uncertain",
    "EXCLUDED": "excluded",
}
NOT_COMPARABLE = "NOT_COMPARABLE"
REVIEW_CONFIDENCES = ["HIGH", "MEDIUM", "LOW"]
NON_HUMAN_REVIEWERS = ["AI", "LLM", "codex", "assistant"]
EXTERNAL_HOLDOUT_NOTE = "EXTERNAL_REPLICATION_HOLDOUT"

# Words that may not occur in feature names or feature text
FEATURE_NAME_TERMS = [
    "label", "rationale", "risk_score", "risk_classification", "recommendation", "severity",
    "split", "path", "filename", "benign", "risky", "malicious", "conclusion",
]
STRICT_FEATURE_NAME_TERMS = [
    "label", "rationale", "reviewer", "review_", "confidence", "eligible", "split", "target",
    "ground_truth", "risk_score", "risk_classification", "recommendation", "severity",
    "mutation_label", "controlled_folder_class", "filename", "file_path", "path_", "benign",
    "risky", "malicious", "conclusion",
]
FEATURE_TEXT_TERMS = ["benign", "risky", "malicious", "samples", "risk_score"]

# Keys that a blind packet or submission may not carry
FORBIDDEN_PACKET_KEYS = [
    "current_dataset_label", "current_label_quality_tier", "current_label_confidence",
    "risk_score", "risk_classification", "final_severity", "rule_recommendation",
    "recommendation", "predicted_label", "predicted_probability", "prediction", "probability",
    "ml_output", "gold_set_flag", "gold_label_source", "reviewer_a_label", "reviewer_01_label",
]
# Public-privacy rules
PRIVATE_KEY_FRAGMENTS = [
    "rationale", "resolution_basis", "change_reason", "evidence_reference", "reviewer_id",
    "adjudicator_id", "alias_mapping", "private_notes", "verbatim", "password", "api_key",
    "access_token", "token", "secret",
]
PRIVATE_VALUE_PATTERNS = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "windows_path": r"(?i)(?:^|[\s'\"])[A-Z]:\\",
    "private_unix_path": r"(?:^|[\s'\"])/(?:home|Users)/",
    "private_id": r"(?i)\b(?:human[_-]?reviewer[_-]?\d+|reviewer0?\d+|reviewer\s+[AB]|adjudicator[_-]?\d+)\b",
}

# Review priority triggers (feature, weight, reason)
PRIORITY_BASE = 10
PRIORITY_LABELS = {
    "malicious_transition": (120, "MALICIOUS_TRANSITION candidate"),
    "risky_transition": (100, "RISKY_TRANSITION requires independent confirmation"),
    "uncertain": (90, "UNCERTAIN label requires resolution attempt"),
}
PRIORITY_HOLDOUT = (40, "external holdout label quality should be strengthened without tuning leakage")
PRIORITY_FEATURES = [
    ("added_sensitive_permission_count", 35, "high-impact sensitive permission expansion"),
    ("all_urls_introduced", 35, "broad <all_urls> host expansion"),
    ("wildcard_host_introduced", 20, "wildcard host expansion"),
    ("critical_api_added", 35, "new critical browser API"),
    ("added_api_count", 25, "new sensitive browser API usage"),
    ("new_external_network_count", 25, "new external network destinations"),
    ("source_sink_flow_count", 30, "source-to-sink heuristic indicator"),
    ("decoded_endpoint_addition_count", 20, "decoded static endpoint indicator"),
    ("dynamic_execution_added_count", 20, "new dynamic execution indicator"),
    ("added_obfuscation_score", 20, "substantial obfuscation change"),
]
PRIORITY_THRESHOLD = 70
PRIORITY_NONE = "low-priority benign maintenance candidate"

# Ablation families and the words that put a feature in them
ABLATION_FAMILIES = {
    "permission": ["permission", "critical_permission", "high_permission"],
    "host": ["host", "all_urls"],
    "api": ["api", "sensitive_api"],
    "network": ["network", "endpoint", "domain", "websocket", "beacon"],
    "obfuscation": ["obfuscation", "entropy", "encoded", "decoded", "base64"],
    "structural": ["structural", "function", "line_count", "js_file", "package_file"],
    "source_sink": ["source_sink", "source_to_sink"],
}

ANALYZERS = ["api_analyzer", "network_analyzer", "obfuscation_analyzer", "structure_analyzer"]

METADATA_COLUMNS = [
    "record_id", "provenance_id", "extension_id", "extension_name", "old_version", "new_version",
    "old_timestamp", "new_timestamp", "label", "label_source", "label_review_status",
    "label_quality_tier", "eligible_for_supervised_training", "source", "source_type",
    "is_controlled", "controlled_mutation_type", "functional_category", "split",
]

# Feature name, family, kind of number, and the projections it belongs to.
PERMISSION_ONLY = "permission_only"
MANIFEST_PERMISSION = "manifest_permission"
LATEST_STATIC = "latest_version_static"
SIMPLE_DIFFERENTIAL = "simple_differential"
FULL_DIFFERENTIAL = "full_differential"
PROJECTIONS = [PERMISSION_ONLY, MANIFEST_PERMISSION, LATEST_STATIC, SIMPLE_DIFFERENTIAL, FULL_DIFFERENTIAL]
_PMF = [PERMISSION_ONLY, MANIFEST_PERMISSION, FULL_DIFFERENTIAL]
_MF = [MANIFEST_PERMISSION, FULL_DIFFERENTIAL]
_L = [LATEST_STATIC]
_SF = [SIMPLE_DIFFERENTIAL, FULL_DIFFERENTIAL]
_F = [FULL_DIFFERENTIAL]
FEATURES = [
    ("added_permission_count", "permission_drift", "count", _PMF),
    ("removed_permission_count", "permission_drift", "count", _PMF),
    ("added_sensitive_permission_count", "permission_drift", "count", _PMF),
    ("removed_sensitive_permission_count", "permission_drift", "count", _PMF),
    ("permission_risk_delta", "permission_drift", "continuous", _PMF),
    ("critical_permission_added", "permission_drift", "binary", _PMF),
    ("high_permission_added", "permission_drift", "binary", _PMF),
    ("optional_permission_change_count", "manifest_permission", "count", _PMF),
    ("host_count_delta", "host_drift", "count", [MANIFEST_PERMISSION, SIMPLE_DIFFERENTIAL, FULL_DIFFERENTIAL]),
    ("added_host_count", "host_drift", "count", _MF),
    ("host_scope_score_delta", "host_drift", "continuous", _MF),
    ("wildcard_host_introduced", "host_drift", "binary", _MF),
    ("all_urls_introduced", "host_drift", "binary", _MF),
    ("content_script_changed", "manifest_permission", "binary", _MF),
    ("service_worker_introduced", "manifest_permission", "binary", _MF),
    ("externally_connectable_changed", "manifest_permission", "binary", _MF),
    ("web_accessible_resource_change_count", "manifest_permission", "count", _MF),
    ("csp_changed", "manifest_permission", "binary", _MF),
    ("v2_total_permission_count", "latest_static", "count", _L),
    ("v2_sensitive_permission_count", "latest_static", "count", _L),
    ("v2_total_host_count", "latest_static", "count", _L),
    ("v2_wildcard_host_count", "latest_static", "count", _L),
    ("v2_all_urls_present", "latest_static", "binary", _L),
    ("v2_service_worker_present", "latest_static", "binary", _L),
    ("v2_sensitive_api_count", "latest_static", "count", _L),
    ("v2_external_domain_count", "latest_static", "count", _L),
    ("v2_http_endpoint_count", "latest_static", "count", _L),
    ("v2_hardcoded_ip_count", "latest_static", "count", _L),
    ("v2_obfuscation_indicator_count", "latest_static", "count", _L),
    ("v2_dynamic_execution_count", "latest_static", "count", _L),
    ("v2_function_count", "latest_static", "count", _L),
    ("v2_source_sink_indicator_count", "latest_static", "count", _L),
    ("permission_count_delta", "simple_differential", "count", _SF),
    ("file_count_delta", "simple_differential", "count", _SF),
    ("package_size_delta_bytes", "simple_differential", "continuous", _SF),
    ("js_file_count_delta", "simple_differential", "count", _SF),
    ("api_count_delta", "simple_differential", "count", _SF),
    ("network_destination_count_delta", "simple_differential", "count", _SF),
    ("obfuscation_count_delta", "simple_differential", "count", _SF),
    ("function_count_delta", "simple_differential", "count", _SF),
    ("added_api_count", "api_drift", "count", _F),
    ("critical_api_added", "api_drift", "binary", _F),
    ("new_external_network_count", "network_drift", "count", _F),
    ("new_local_network_count", "network_drift", "count", _F),
    ("plain_http_addition_count", "network_drift", "count", _F),
    ("decoded_endpoint_addition_count", "network_drift", "count", _F),
    ("hardcoded_ip_addition_count", "network_drift", "count", _F),
    ("added_obfuscation_score", "obfuscation_drift", "continuous", _F),
    ("dynamic_execution_added_count", "obfuscation_drift", "count", _F),
    ("added_function_count", "structural_drift", "count", _F),
    ("added_event_listener_count", "structural_drift", "count", _F),
    ("source_sink_flow_count", "structural_drift", "count", _F),
    ("modified_file_count", "package_drift", "count", _F),
] + [
    (f"{analyzer}_available", "analyzer_health", "binary", [LATEST_STATIC, SIMPLE_DIFFERENTIAL, FULL_DIFFERENTIAL])
    for analyzer in ANALYZERS
]

# The five baseline rules; a row is flagged when any listed feature is above zero.
BASELINE_RULES = {
    PERMISSION_ONLY: [
        "added_sensitive_permission_count", "permission_risk_delta",
        "critical_permission_added", "high_permission_added",
    ],
    MANIFEST_PERMISSION: [
        "added_sensitive_permission_count", "permission_risk_delta", "host_scope_score_delta",
        "all_urls_introduced", "service_worker_introduced", "content_script_changed",
        "externally_connectable_changed",
    ],
    LATEST_STATIC: [
        "v2_sensitive_permission_count", "v2_all_urls_present", "v2_sensitive_api_count",
        "v2_external_domain_count", "v2_obfuscation_indicator_count", "v2_source_sink_indicator_count",
    ],
    SIMPLE_DIFFERENTIAL: [
        "permission_count_delta", "host_count_delta", "api_count_delta",
        "network_destination_count_delta", "obfuscation_count_delta",
    ],
    FULL_DIFFERENTIAL: [
        "added_sensitive_permission_count", "all_urls_introduced", "added_api_count",
        "new_external_network_count", "decoded_endpoint_addition_count", "added_obfuscation_score",
        "source_sink_flow_count",
    ],
}


def feature_names(projection: str | None = None) -> list[str]:
    """Feature columns, in schema order, optionally of one projection."""
    return [name for name, _, _, projections in FEATURES if projection is None or projection in projections]


def severity_rank(severity: str) -> int:
    return SEVERITIES.index(severity)
