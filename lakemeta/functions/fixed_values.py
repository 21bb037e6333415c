"""Constants that must hold exactly for results to agree with existing catalogs."""

# Logical type families and the native names each covers (everything else is DTYPE-VARCHAR).
TYPE_FAMILIES = {
    "DTYPE-INTEGER": [
        "int", "int2", "int4", "int8", "integer", "bigint", "smallint", "tinyint", "mediumint",
        "serial", "bigserial", "int64", "long", "short", "byte", "byteint"],
    "DTYPE-NUMERIC": [
        "numeric", "decimal", "number", "float", "float4", "float8", "double", "real", "money",
        "smallmoney", "float64"],
    "DTYPE-VARCHAR": [
        "varchar", "nvarchar", "varchar2", "character", "character varying", "string", "json",
        "jsonb", "xml", "variant", "object", "array", "struct", "map", "geography", "geometry",
        "uuid", "uniqueidentifier"],
    "DTYPE-TEXT": ["text", "ntext", "clob", "nclob", "longtext", "mediumtext"],
    "DTYPE-CHAR": ["char", "nchar", "bpchar"],
    "DTYPE-BOOLEAN": ["boolean", "bool", "bit"],
    "DTYPE-DATE": ["date"],
    "DTYPE-TIMESTAMP": [
        "datetime", "datetime2", "datetimeoffset", "timestamp", "timestamp without time zone",
        "timestamp with time zone", "timestamptz", "timestamp_ntz", "timestamp_ltz",
        "timestamp_tz", "time", "smalldatetime"],
    "DTYPE-BINARY": ["binary", "varbinary", "blob", "bytea", "image", "raw", "long raw", "bytes"],
}
DEFAULT_TYPE = "DTYPE-VARCHAR"
TYPE_MODIFIERS = ["unsigned", "signed", "zerofill", "identity"]

# Column names that mark personal or secret data.
PII_PATTERN = (
    "password|passwd|secret|ssn|social.?security|credit.?card|card.?number|email|phone|mobile|"
    "address|date.?of.?birth|dob|national.?id|passport|driver.?license|bank.?account|"
    "routing.?number|api.?key|token")

# Schemas each database type keeps for itself; compared case-sensitively.
SYSTEM_SCHEMAS = {
    "POSTGRESQL": ["pg_catalog", "information_schema", "pg_toast", "pg_temp_1", "pg_toast_temp_1"],
    "MYSQL": ["information_schema", "mysql", "performance_schema", "sys"],
    "MSSQL": [
        "INFORMATION_SCHEMA", "sys", "guest", "db_owner", "db_accessadmin", "db_securityadmin",
        "db_ddladmin", "db_backupoperator", "db_datareader", "db_datawriter", "db_denydatareader",
        "db_denydatawriter"],
    "ORACLE": [
        "SYS", "SYSTEM", "CTXSYS", "DBSNMP", "MDSYS", "OLAPSYS", "ORDDATA", "ORDSYS", "OUTLN",
        "WMSYS", "XDB", "APEX_PUBLIC_USER", "FLOWS_FILES", "ANONYMOUS", "APEX_040000",
        "APPQOSSYS", "AUDSYS", "DBSFWUSER", "DIP", "GGSYS", "GSMADMIN_INTERNAL", "GSMCATUSER",
        "GSMUSER", "LBACSYS", "OJVMSYS", "REMOTE_SCHEDULER_AGENT", "SI_INFORMTN_SCHEMA",
        "SYSBACKUP", "SYSDG", "SYSKM", "SYSRAC"],
    "SNOWFLAKE": ["INFORMATION_SCHEMA"],
    "REDSHIFT": ["information_schema", "pg_catalog", "pg_internal"],
    "TERADATA": [
        "DBC", "SYSLIB", "SYSJDBC", "SYSUDTLIB", "SystemFe", "All", "Crashdumps", "SYSSPATIAL",
        "SysAdmin", "SYSBAR", "EXTUSER", "dbcmngr", "SQLJ", "TDStats", "tdwm", "TD_SERVER_DB",
        "TD_SYSFNLIB", "TD_SYSXML", "TDPUSER", "console"],
}

# Lineage providers and how far each is trusted.
SOURCE_WEIGHTS = {"FK": 100, "OPERATIONAL": 80, "ETL": 60, "MANUAL": 50, "SQL_PARSER": 40}
CROSS_APP = "__CROSS_APP__"
UNKNOWN_APP = "__UNKNOWN__"

# Discovery limits.
MAX_SCHEMAS = 100
MAX_TABLES_PER_SCHEMA = 5000
MAX_COLUMNS_PER_TABLE = 10000

# Column attributes a snapshot diff compares, in report order.
COMPARED_COLUMN_FIELDS = [
    "data_type", "full_data_type", "is_nullable", "column_default", "ordinal_position",
    "character_max_length", "numeric_precision", "numeric_scale", "is_primary_key",
    "is_auto_increment", "column_comment"]

# Payload constants.
CONTAINER_TYPE = "TYP-RDBMS"
CONTAINER_SERVER = "discovered-via-mcp"
ENTITY_TYPE_VIEW = "ENT-TYP-VW"
ENTITY_TYPE_TABLE = "ENT-TYP-TBL"
DROPPED_DESCRIPTION = "DROPPED"
SELF_EDGE_ERROR = "Self-referencing edge"
ORPHANED_RUN_ERROR = "Orphaned run recovered on startup"

# Redaction: keys whose values are secrets, in masking order, and the masks.
SECRET_KEYS = ["password", "pwd", "secret", "token", "api[_-]?key", "apikey", "authorization"]
BEARER_PATTERN = r"(?i)bearer\s+[A-Za-z0-9._~+/=-]*"
URL_PASSWORD_PATTERN = r":[^@\s]+@"
MASK = "*****"
COLUMN_MASK = "********"

# Redaction of HTTP bodies: pattern and replacement, in order.
HTTP_BODY_MASKS = [
    (r"(?i)bearer\s+[A-Za-z0-9._~+/=-]*", "Bearer *****"),
    (r"""(?i)authorization["':\s]*[^\s"',}]+""", "Authorization: *****"),
    (r"""(?i)x-api-key["':\s]*[^\s"',}]+""", "X-Api-Key: *****"),
    (r"""(?i)x-auth-token["':\s]*[^\s"',}]+""", "X-Auth-Token: *****"),
    (r"""(?i)cookie["':\s]*[^\s"',}]+""", "Cookie: *****"),
    (r"""(?i)["']?(api[_-]?key|access[_-]?token|refresh[_-]?token|secret)["']?"""
     r"""\s*[:=]\s*["']?[^\s"',}]+""", "$1: *****"),
]

# Redaction of service errors: pattern and replacement, in order.
SERVICE_ERROR_MASKS = [
    (r"(?i)password[=:]\s*\S+", "password=*****"),
    (r"(?i)PWD[=:]\s*\S+", "PWD=*****"),
    (r"(?i)apikey[=:]\s*\S+", "apikey=*****"),
    (r":[^@/]+@", ":*****@"),
]
MISSING_ERROR = "Unknown error"

# What a run that timed out is marked with; the seconds stand between the two parts.
TIMED_OUT = "TIMED_OUT"
TIMEOUT_ERROR = ("Job timed out after ", "s")
