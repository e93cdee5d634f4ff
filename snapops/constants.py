"""Fixed values the results depend on, and the default settings."""

# File types, in the order in which a path is searched for them.
FILE_TYPES = ["CL", "META", "META_V2", "SNAP", "SNAPSHOT_VERIFIED", "SST", "SST_V2"]
DATA_TYPES = ["SNAP", "SST", "SST_V2"]
V2_TYPES = ["META_V2", "SST_V2"]
COMPRESSIONS = ["SNAPPY", "LZ4", "NONE"]
ENCRYPTIONS = ["PLAINTEXT", "PGP"]

# Backup dialects.
SNAPSHOT_BACKUP = 1
SNAPSHOT_META_SERVICE = 2

# Keyspaces the database owns, never compacted or flushed.
SYSTEM_KEYSPACES = [
    "system",
    "system_schema",
    "system_traces",
    "system_auth",
    "system_distributed",
    "dse_system",
]

# System tables never backed up or restored.
NEVER_BACKED_UP = {
    "system": ["local", "peers", "hints", "compactions_in_progress", "LocationInfo"]
}

# Names and patterns of files.
MANIFEST_V1_NAME = "meta.json"
MANIFEST_V2_PATTERN = r"^meta_v2_.*\.json$"
COMPRESSION_INFO_SUFFIX = "-CompressionInfo.db"
DATA_FILE_SUFFIX = "-Data.db"
TMP_SUFFIX = ".tmp"
TMP_LINK_PATTERN = r"^((.*)\-(.*)\-)?tmp(link)?\-((?:l|k).)\-(\d)*\-(.*)$"

# Placeholder instance id of a slot nobody owns yet.
NEW_SLOT = "new_slot"
DEAD_SUFFIX = "-dead"

# Instance states that do not count as live.
LEAVING_STATES = ["terminating", "shutting-down", "terminated"]

# Defaults of settings.
SECOND_MS = 1_000
MINUTE_MS = 60 * SECOND_MS
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS
COMPACTION_GRACE_DAYS = 5
READ_GRACE_DAYS = 3
FEATURE_START_MS = 1_514_764_800_000  # 2018-01-01
MAX_PARTS = 9_995
READ_STEP = 2_048
CHUNK_SIZE = 10 * 1024 * 1024
STATUS_DAYS = 60
MAX_COMMIT_LOGS = 10
SLO_HOURS = 24
RATE_CHANGE_THRESHOLD = 0.1
