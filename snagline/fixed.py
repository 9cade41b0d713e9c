"""Fixed values.

Everything in this module is a value that stored data, issue trackers or other
readers already agree on: changing one changes results.  Nothing here is logic.
"""

# --- fixed values: record vocabulary ---------------------------------------
REPORT = "papercut"
RESOLUTION = "resolution"
RECORD_TYPES = ["papercut", "resolution"]
CATEGORIES = [
    "harness_config",
    "instruction_gap",
    "model_behavior",
    "project_dx",
    "should_be_script",
]
SEVERITIES = ["high", "medium", "low"]
STATUSES = ["fixed", "mitigated", "reported-upstream", "wontfix", "out-of-scope"]
CITED_STATUSES = ["reported-upstream", "out-of-scope"]
MACHINES = ["default", "strict"]
SOURCES = ["auto", "manual"]
REPORT_KEYS = ["category", "severity", "title", "description", "suggested_fix"]
RESOLUTION_KEYS = ["resolves", "status", "fix_url"]
CONTROLLED_KEYS = [
    "id", "v", "type", "producer", "ts", "machine", "source", "session_id", "repo",
]
FREE_TEXT_KEYS = ["title", "description", "suggested_fix"]
LINK_KEYS = ["fix_url"]
MAX_LENGTHS = {"title": 100, "description": 1000, "suggested_fix": 500, "fix_url": 300}

# --- fixed values: patterns -------------------------------------------------
ID_PATTERN = (
    "pc_[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}"
)
TS_PATTERN = "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z"
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ID_PREFIX = "pc_"
PREFIX_PATTERN = "pc_([0-9a-f]{8})"
TARGET_NAME_PATTERN = "[a-z0-9][a-z0-9._-]*"
REPO_PATTERN = "[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+"
RUN_DATE_PATTERN = "[0-9]{4}-[0-9]{2}-[0-9]{2}"

# --- fixed values: redaction markers and allowlisted words ------------------
MARKERS = {
    "pem": "[pem-block]",
    "jwt": "[jwt]",
    "credentials": "[redacted]@",
    "key": "[key]",
    "email": "[email]",
    "ip": "[ip]",
    "token": "[token]",
    "home": "~",
    "denylist": "[redacted]",
}
PEM_PATTERN = "-----BEGIN [^-]+-----.*?-----END [^-]+-----"
IPV6_CANDIDATE = r"[0-9A-Fa-f:]{2,}(?:\.[0-9]{1,3}){0,3}"
HOME_PREFIX = "/(?:Users|home)/"
TOKEN_ALLOWLIST = [
    "dependency-readiness",
    "backward-compatibility",
    "consistency-checking",
    "sandbox-network-guard",
    "merge-claude-settings",
    "sandbox-network-guard-style",
    "dangerouslyDisableSandbox",
    "must-read-before-write",
    "Closed-without-merge",
    "Operation-not-permitted",
    "operation-not-permitted",
    "--skip-git-repo-check",
]

# --- fixed values: session mining -------------------------------------------
MIN_HUMAN_TURNS = 6
ANCHOR_CAP = 50
ANCHOR_KINDS = ["tool_error", "permission_prompt"]
ERROR_CLASSES = [
    "nonzero_exit", "timeout", "not_found", "interrupted", "denied", "unknown",
]
QUIET_HOURS = 24
ANCHOR_TTL_DAYS = 7
REVIEW_TTL_DAYS = 30
SWEEP_SESSIONS = 5

# Characters of an error message that its class is told from.
ERROR_TEXT_LOOKED_AT = 1000

# --- fixed values: transcript reduction -------------------------------------
COMPACT_BUDGET = 200000
ERROR_CAP = 4000
INPUT_FIELD_CAP = 200
STUB_HEAD = 200
NEIGHBOR_RADIUS = 2
TRUNCATION_MARKER = "...[truncated]..."
MALFORMED_EXCERPT = 500

# --- fixed values: labels, targets and rendered text ------------------------
BASE_LABEL = "papercut"
FIX_NOW_LABEL = "papercut-fix-now"
PRIORITY_LABELS = ["priority:high", "priority:medium", "priority:low"]
UNOWNED = "unowned"
TRACKER = "gh-issue"
RATINGS = ["low", "medium", "high"]
MEMBERS_KEY = "papercut_ids"
MEMBERS_HEADING = "Source papercuts:"
COMMENT_HEADING = "**Consolidation:**"
