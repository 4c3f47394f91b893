"""Word lists, enums and grammars that results must agree on."""

# --- fixed values: paths -------------------------------------------------------------------
ENV_TEMPLATE_NAMES = (".env.example", ".env.sample", ".env.template")
BUILD_PARTS = ("vendor", "node_modules", "build", "dist", ".cache", "cache", "__pycache__")
DOMAIN_FRAGMENTS = ("payroll", "medical", "health", "customer")
STRONG_FRAGMENTS = ("record", "dump", "raw", "export")
SAFE_PATH_WORDS = (
    "policy", "policies", "guideline", "guidelines", "template", "templates",
    "example", "examples", "sample", "samples",
)
BULK_PATH_WORDS = ("database", "dump", "dumps", "upload", "uploads", "generated")
SENSITIVE_PARTS = (
    "uploads", "upload", "generated", "generated-documents", "payroll", "medical", "health",
    "customers", "customer-data", "database", "dumps", "dump",
)
BINARY_SUFFIXES = (
    "sql", "dump", "sqlite", "sqlite3", "pdf", "doc", "docx", "xls", "xlsx", "zip", "gz", "tar",
    "png", "jpg", "jpeg", "gif", "ico", "woff", "woff2", "ttf", "mp3", "mp4",
)

# --- fixed values: sensitive keys, one family per caller -----------------------------------
PREFLIGHT_SAFE_LAST_WORDS = (
    "budget", "limit", "count", "policy", "policies", "handling", "rules", "template", "example",
)
PREFLIGHT_KEY_WORDS = ("password", "passphrase", "secret", "credential", "authorization")
KEY_PAIRS = (
    "api key", "api token", "access token", "refresh token", "bearer token", "private key",
)
HASH_KEY_LAST_WORDS = ("hash", "sha", "sha256", "digest", "checksum", "uuid", "id")
REGISTRY_SAFE_LAST_WORDS = ("budget", "limit", "count", "policy", "handling", "rules")
REGISTRY_KEY_WORDS = ("password", "secret", "credential", "authorization")
REGISTRY_EXEMPT_KEYS = ("credential_sources",)
SECRET_KEYS = (
    "token", "apitoken", "apikey", "accesstoken", "refreshtoken", "bearertoken", "authorization",
    "password", "secret", "credential", "privatekey", "clientsecret", "signingsecret",
    "webhooksecret",
)
BODY_KEYS = ("content", "originaltext", "payload", "taskpayload", "rawbody", "body")
LISTING_KEYS = ("data", "items")

# --- fixed values: policies, classifications, phases ---------------------------------------
CREDENTIAL_POLICIES = ("exclude", "allow_project_staging")
CLASSIFICATIONS = ("include", "include_redacted", "exclude", "blocked_review", "derived_after_audit")
ELIGIBLE = ("include", "include_redacted")
DELTAS = ("new", "unchanged", "changed", "deleted", "renamed")
EXPORTED_DELTAS = ("new", "changed", "renamed")
SINGLETON_TAGS = ("user", "project", "kind", "scope", "trust", "knowledge")
RESERVED_TAGS = ("source", "harness")
RELATIONSHIPS = ("new_product", "existing_product_additional_root")
IDENTITY_COLUMNS = ("product_identity", "relationship", "owner_slug", "project_slug")
TERMINAL_STATES = ("completed", "failed", "cancelled")
PENDING_STATES = ("pending", "processing", "queued")
PHASES = (
    "intended", "acknowledged", "completed", "failed", "cancelled", "timed_out", "uncertain",
)
VIOLATION_CLASSES = (
    "fabrication", "project_mixing", "provenance", "temporal", "web_mobile", "credential_policy",
)
SUMMARY_COLUMNS = (
    "id", "bank_id", "content_hash", "created_at", "updated_at", "memory_unit_count",
    "text_length", "tags", "metadata", "document_metadata", "observation_scopes",
)
CAPSULE_SUBJECT_TYPES = ("route", "entity", "wiki")

# --- fixed values: limits ------------------------------------------------------------------
OPAQUE_MIN_LENGTH = 32
OPAQUE_MIN_CLASSES = 3
OPAQUE_MIN_ENTROPY = 4.0
MAX_EDGES = 12
PAGE_LIMIT = 100
TEXT_CAP = 512
LIST_CAP = 100
DEADLINE_SECONDS = 300

# --- fixed values: formats -----------------------------------------------------------------
SHA256_HEX = "^[0-9a-f]{64}$"
TAG_COMPONENT = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
BANK_ID = "^[a-z0-9]+(?:-[a-z0-9]+)*::[a-z0-9]+(?:-[a-z0-9]+)*$"
EVENT_HEADING = "### \\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2} CEST - "
LOGBOOK_ZONE = "Europe/Rome"
STALE_POLICY = "explicit_deletion_approval_required"
REDACTED = "[REDACTED]"
MASKED = "<redacted>"
