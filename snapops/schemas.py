"""Column types of the tables the operators exchange.

Every instant is a ``bigint`` of epoch milliseconds (suffix ``_ms``): the form the object
paths and the manifests carry, independent of session time zones, and prunable by Parquet
statistics.
"""

LISTING = "remote_path string, size bigint, modified_ms bigint"

CATALOG = (
    "remote_path string, base_dir string, region string, cluster string, token string, "
    "file_type string, keyspace string, column_family string, file_name string, "
    "time_ms bigint, last_modified_ms bigint, compression string, encryption string, "
    "size bigint, is_v2 boolean, is_data boolean, error string"
)

INVENTORY = "cluster string, token string, region string, local_path string, size bigint, modified_ms bigint"

MANIFEST_ENTRY = (
    "cluster string, token string, snapshot_ms bigint, manifest_path string, "
    "keyspace string, column_family string, prefix string, file_name string, "
    "last_modified_ms bigint, creation_ms bigint, size bigint, compression string, "
    "encryption string, is_uploaded boolean, backup_path string"
)

STATUS_EVENT = (
    "cluster string, token string, version int, start_ms bigint, event_ms bigint, seq bigint, "
    "status string, completed_ms bigint, snapshot_ok boolean, location string, last_validated_ms bigint"
)

RING_INSTANCE = (
    "app string, id bigint, instance_id string, hostname string, ip string, rack string, "
    "dc string, token string, updated_ms bigint"
)

# Field names of the two manifest documents.
MANIFEST_V2_JSON = (
    "struct<info:struct<version:smallint,appName:string,region:string,rack:string,"
    "backupIdentifier:array<string>>,"
    "data:array<struct<keyspaceName:string,columnfamilyName:string,"
    "sstables:array<struct<prefix:string,sstableComponents:array<struct<"
    "fileName:string,lastModifiedTime:bigint,fileCreationTime:bigint,fileSizeOnDisk:bigint,"
    "compression:string,encryption:string,isUploaded:boolean,backupPath:string>>>>>>>"
)
MANIFEST_V1_JSON = "array<string>"

# Field names of a node's status document.
STATUS_DOCUMENT_JSON = (
    "struct<live:array<string>,unreachable:array<string>,joining:array<string>,"
    "leaving:array<string>,moving:array<string>,tokenToEndpointMap:map<string,string>>"
)
