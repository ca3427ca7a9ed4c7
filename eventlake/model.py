"""Event model: class dimension, stored schemas, finding schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Public OCSF categories (uid, name).
CATEGORIES = [
    (0, "other"),
    (1, "system"),
    (2, "findings"),
    (3, "iam"),
    (4, "network"),
    (5, "discovery"),
    (6, "application"),
    (7, "remediation"),
]

# Public OCSF classes (class_uid, name); the category is derived from the uid.
CLASSES = [
    (0, "base_event"),
    (1001, "file_activity"),
    (1002, "kernel_extension_activity"),
    (1003, "kernel_activity"),
    (1004, "memory_activity"),
    (1005, "module_activity"),
    (1006, "scheduled_job_activity"),
    (1007, "process_activity"),
    (1008, "event_log_activity"),
    (1009, "script_activity"),
    (2001, "security_finding"),
    (2002, "vulnerability_finding"),
    (2003, "compliance_finding"),
    (2004, "detection_finding"),
    (2005, "incident_finding"),
    (2006, "data_security_finding"),
    (3001, "account_change"),
    (3002, "authentication"),
    (3003, "authorize_session"),
    (3004, "entity_management"),
    (3005, "user_access"),
    (3006, "group_management"),
    (4001, "network_activity"),
    (4002, "http_activity"),
    (4003, "dns_activity"),
    (4004, "dhcp_activity"),
    (4005, "rdp_activity"),
    (4006, "smb_activity"),
    (4007, "ssh_activity"),
    (4008, "ftp_activity"),
    (4009, "email_activity"),
    (4010, "network_file_activity"),
    (4011, "email_file_activity"),
    (4012, "email_url_activity"),
    (4013, "ntp_activity"),
    (4014, "tunnel_activity"),
    (5001, "inventory_info"),
    (5002, "config_state"),
    (5003, "user_inventory"),
    (5004, "patch_state"),
    (6001, "web_resources_activity"),
    (6002, "application_lifecycle"),
    (6003, "api_activity"),
    (6004, "web_resource_access_activity"),
    (6005, "datastore_activity"),
    (6006, "file_hosting"),
    (6007, "scan_activity"),
    (7001, "remediation_activity"),
    (7002, "file_remediation_activity"),
    (7003, "process_remediation_activity"),
    (7004, "network_remediation_activity"),
    (201001, "win/registry_key_activity"),
    (201002, "win/registry_value_activity"),
    (201003, "win/windows_resource_activity"),
    (201004, "win/windows_service_activity"),
]

FINDING_CLASS_UID = 2004
PRODUCT_NAME = "EventLake"


def category_of(class_uid: int) -> str:
    return dict(CATEGORIES)[class_uid % 10000 // 1000]


def class_path(class_uid: int) -> str:
    """Folder of a class below the store root: category/class."""
    return f"{category_of(class_uid)}/{dict(CLASSES)[class_uid]}"


_STR, _INT, _LONG, _DBL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_BOOL, _TS = T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


PRODUCT = _struct(vendor_name=_STR, product_name=_STR)
METADATA = _struct(uid=_STR, correlation_uid=_STR, version=_STR, product=PRODUCT)
USER = _struct(uid=_STR, name=_STR, type=_STR)
ENDPOINT = _struct(ip=_STR, port=_INT, hostname=_STR)

_BASE = [
    T.StructField("class_uid", _INT, False),
    T.StructField("time", _TS, True),
    T.StructField("severity", _STR, True),
    T.StructField("activity_id", _INT, True),
    T.StructField("activity_name", _STR, True),
    T.StructField("message", _STR, True),
    T.StructField("status", _STR, True),
    T.StructField("raw_data", _STR, True),
    T.StructField("user", USER, True),
    T.StructField("metadata", METADATA, True),
]


def _class(**extra: T.DataType) -> T.StructType:
    return T.StructType(_BASE + [T.StructField(name, dtype, True) for name, dtype in extra.items()])


# Stored schema per class_uid. A class without an entry is not stored; its events go to quarantine.
CLASS_SCHEMAS: dict[int, T.StructType] = {
    1007: _class(
        process=_struct(
            name=_STR,
            pid=_LONG,
            cmd_line=_STR,
            parent_process=_struct(name=_STR, pid=_LONG, cmd_line=_STR),
        )
    ),
    3001: _class(value=_DBL, k=_LONG),
    3002: _class(src_endpoint=ENDPOINT, is_mfa=_BOOL, logon_type=_STR),
    4002: _class(
        http_request=_struct(http_method=_STR, url=_struct(url_string=_STR), user_agent=_STR),
        src_endpoint=ENDPOINT,
        value=_DBL,
        k=_LONG,
    ),
    6001: _class(web_resources=T.ArrayType(_struct(name=_STR, url_string=_STR)), value=_DBL, k=_LONG),
    6003: _class(
        actor=_struct(app_name=_STR),
        api=_struct(operation=_STR, service=_struct(name=_STR)),
        authorizations=T.ArrayType(_struct(decision=_STR, is_applied=_BOOL)),
        src_endpoint=ENDPOINT,
        value=_DBL,
        k=_LONG,
    ),
}

# Folders of a stored class: the batch that wrote it, then the date of the events.
PARTITIONS = T.StructType([T.StructField("batch_id", _STR), T.StructField("event_date", T.DateType())])

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("class_uid", _INT, False),
        T.StructField("time", _TS, True),
        T.StructField("severity", _STR, True),
        T.StructField("rule_id", _STR, True),
        T.StructField("observables", _STR, True),
        T.StructField("finding_info", _struct(uid=_STR, title=_STR), True),
        T.StructField(
            "metadata", _struct(uid=_STR, correlation_uid=_STR, product=PRODUCT), True
        ),
    ]
)


def class_dimension(spark: SparkSession, schemas: dict[int, T.StructType] | None = None) -> DataFrame:
    """class_uid, category, class_name, has_schema; one row per known class (fixed size)."""
    loaded = set(CLASS_SCHEMAS if schemas is None else schemas) | {FINDING_CLASS_UID}
    rows = [(uid, category_of(uid), name, uid in loaded) for uid, name in CLASSES]
    return spark.createDataFrame(
        rows, "class_uid bigint, category string, class_name string, has_schema boolean"
    )
