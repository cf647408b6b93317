"""Table schemas, column mappings and fixed texts.

The header names, messages and extension lists below are fixed values that
must stay equal to the original application's for results to match.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: manifest header -> catalog column --------------------------
MANIFEST_COLUMN_MAP = {
    "BRnum": "brnumber",
    "Title": "title",
    "Publication Year": "publication_year",
    "Name": "organization_name",
    "Organization type": "organization_type",
    "Sector": "organization_sector",
    "Country": "country",
    "Region": "region",
    "Pdf_URL": "pdf_url",
    "Report Html Address": "pdf_backup_url",
}
REQUIRED_MANIFEST_COLUMNS = ("BRnum", "Pdf_URL")

# --- fixed values: messages and markers ---------------------------------------
STATUS_TRUE = "TRUE"
STATUS_FALSE = "FALSE"
MSG_EXISTS_IN_FOLDER = "File already exists in this folder"
MSG_ALREADY_TRUE = ("Download_status for {brnumber} was already TRUE, should be found in folder: "
                    "{folder}, wont attempt download to folder: {dest}")
MSG_NOT_PDF = "Not received as PDF file"
MSG_DOWNLOADED = "File downloaded successfully"
MSG_MISSING_URL = "missing url"
PDF_SIGNATURE = b"%PDF-"
PDF_SUFFIX = ".pdf"

MSG_USERNAME_SHORT = "Username must be at least 3 characters long"
MSG_USERNAME_CHARS = "Username can only contain letters, numbers, and underscores"
MSG_EMAIL_INVALID = "Invalid email address"
MSG_NOT_NULL = "{key} cannot be null"
MSG_TOO_LONG = "{key} must be less than {n} characters"
MSG_USERNAME_EXISTS = "Username already exists"
MSG_EMAIL_EXISTS = "Email already exists"
USERNAME_PATTERN = "^[A-Za-z0-9_]+$"
EMAIL_PATTERN = r"(^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$)"

MSG_TASK_CANCELLED = "Task cancelled"
MSG_TASK_FINISHED = "Task is already finished"
MSG_NO_SUCH_TASK = "No such task"
MSG_TASK_RUNNING = "Task already running"

MSG_PDF_NOT_FOUND = "PDF file not found"
MSG_PDF_NOT_DOWNLOADED = "PDF file not downloaded"
MSG_BAD_RESPONSE_TYPE = "Invalid response_type"
DELIVERY_MODES = ("local", "link", "download")

MSG_INVALID_UPLOAD = "Invalid file type. Only Excel files are allowed."
MSG_FILE_EXISTS = "File {name} already exists."
MSG_UNIQUE_TAKEN = "A row with the same unique field value already exists."

MSG_BAD_PAGE = "Page number must be at least 1"
MSG_BAD_FILTER_JSON = "Invalid JSON format in filters"
MSG_NULL_FILTER_KEY = "Filter key cannot be None"
MSG_NULL_FILTER_VALUE = "Filter value for {key} cannot be None"

# run extensions (with dot, as os.path.splitext gives them); upload extensions
RUN_EXTENSIONS = (".csv", ".xlsx", ".xlsm", ".xltx", ".xltm")
UPLOAD_EXTENSIONS = ("xlsx", "xls")


# --- schemas ------------------------------------------------------------------
S = T.StringType()
L = T.LongType()
TS = T.TimestampNTZType()

MANIFEST_RAW_SCHEMA = T.StructType([T.StructField(h, S, True) for h in MANIFEST_COLUMN_MAP])

CATALOG_SCHEMA = T.StructType([
    T.StructField("id", L, True),
    T.StructField("brnumber", S, False),
    T.StructField("title", S, True),
    T.StructField("file_name", S, True),
    T.StructField("file_folder", S, True),
    T.StructField("publication_year", S, True),
    T.StructField("organization_name", S, True),
    T.StructField("organization_type", S, True),
    T.StructField("organization_sector", S, True),
    T.StructField("country", S, True),
    T.StructField("region", S, True),
    T.StructField("download_status", S, False),
    T.StructField("download_message", S, True),
    T.StructField("download_attempt_date", TS, True),
    T.StructField("pdf_url", S, True),
    T.StructField("pdf_backup_url", S, True),
])
CATALOG_COLUMNS = [f.name for f in CATALOG_SCHEMA.fields]

RUN_SCHEMA = T.StructType([
    T.StructField("task_id", S, False),
    T.StructField("name", S, True),
    T.StructField("status", S, False),
    T.StructField("running_file", S, True),
    T.StructField("start_time", TS, True),
    T.StructField("end_time", TS, True),
    T.StructField("processed_rows", L, True),
    T.StructField("start_row", L, True),
    T.StructField("num_rows", L, True),
    T.StructField("results", S, True),
])

RESULTS_SCHEMA = T.StructType([
    T.StructField("successful", L, True),
    T.StructField("already_downloaded", L, True),
    T.StructField("failed", L, True),
    T.StructField("processed_rows", L, True),
])

ACCOUNT_SCHEMA = T.StructType([
    T.StructField("id", L, True),
    T.StructField("username", S, False),
    T.StructField("email", S, False),
    T.StructField("is_admin", S, True),
    T.StructField("created_at", TS, True),
    T.StructField("updated_at", TS, True),
])
