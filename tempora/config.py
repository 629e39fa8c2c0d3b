"""Defaults and fixed values.

The lists under "Fixed values" must equal the ones of the evaluated study for
results to be comparable; everything else is an ordinary parameter default.
"""

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written, in this order)
# ---------------------------------------------------------------------------
CLASS_NAMES = [
    "emotet", "swisyn", "qakbot", "trickbot", "lokibot",
    "njrat", "zeus", "ursnif", "adload", "harhar",
]
DETECTION_TERMS = [
    "yara", "signature", "detection", "avclass",
    "malware", "classification", "sig",
]
FEATURE_FIELDS = [
    "files", "read_files", "write_files", "delete_files",
    "keys", "read_keys", "write_keys", "delete_keys",
    "mutexes", "executed_commands", "resolved_apis",
    "started_services", "created_services",
]
AUDIT_FIELDS = FEATURE_FIELDS + ["domains", "hosts", "urls", "ips"]
FILE_FIELDS = ["files", "read_files", "write_files", "delete_files"]
REGISTRY_FIELDS = ["keys", "read_keys", "write_keys", "delete_keys"]
SERVICE_FIELDS = ["started_services", "created_services"]
SELECTIVE_THRESHOLDS = [0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
PE_FEATURES = [
    "pe_timestamp", "pe_imagebase", "pe_entrypoint", "pe_n_sections",
    "pe_mean_entropy", "pe_max_entropy", "pe_std_entropy", "pe_total_size",
    "pe_n_import_dlls", "pe_n_import_funcs", "pe_n_exports",
]
GUID_PATTERN = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
HEX_PATTERN = "[0-9a-f]{8,}"
FUSION_VIEWS = ["api_tfidf", "art_tfidf", "counts", "pe"]
VIEW_ALIASES = {
    "api": "api_tfidf",
    "artifacts": "art_tfidf",
    "artifacts_tfidf": "art_tfidf",
    "counts_scaled": "counts",
    "pe_scaled": "pe",
}
VALID_VIEWS = ["api_tfidf", "api_hash", "art_tfidf", "counts", "pe", "fusion"]
TOKEN_PREFIXES = ["api::", "artifact::"]
VOCABULARY_VIEWS = ["api_tfidf", "art_tfidf"]

# ---------------------------------------------------------------------------
# Parameter defaults
# ---------------------------------------------------------------------------
SEED = 42
TRAIN_FRAC = 0.8
VAL_FRAC = 0.1
WINDOW_DAYS = 30
MIN_TRAIN = 500
MIN_TEST = 50
TRAILING = 3
FLOOR = 0.75
DROP_MARGIN = 0.10
KNOWN_RETENTION = 0.95
MIN_UNKNOWN = 25
TOP_K_PER_SIDE = 6
BOOTSTRAP_B = 10_000
BOOTSTRAP_SEED = 2026
TFIDF_MIN_DF = 2
TFIDF_MAX_TERMS = 50_000
ARTIFACT_TOKEN_CAP = 400
