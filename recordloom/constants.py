"""Fixed values of the record data model.

These are formats, names and limits that stored data and callers depend on, so
they are written out here once and used everywhere else by name.
"""

# A relation cell is the URI "<scheme>/<record type>/<record id>".
RELATION_SCHEME = "terra-wds:"

# Names the model reserves for itself.
RESERVED_PREFIX = "sys_"
DEFAULT_PRIMARY_KEY = "sys_name"
ROOT_COLUMN = "sys_root"

# Primary key of an imported table whose manifest names no single key.
MANIFEST_DEFAULT_KEY = "datarepo_row_id"

# Prefix of the columns that record where imported rows came from.
IMPORT_METADATA_PREFIX = "import:"

# Characters allowed in attribute and record type names.
NAME_PATTERN = r"^[A-Za-z0-9\-_ ]*$"

# Paging and batching limits.
MAX_PAGE_SIZE = 1000
DEFAULT_PAGE_SIZE = 10

# Jobs.
TERMINAL_STATUSES = ("SUCCEEDED", "ERROR", "CANCELLED")
NONTERMINAL_STATUSES = ("CREATED", "QUEUED", "RUNNING", "UNKNOWN")
STALLED_AFTER_HOURS = 6
EXTERNAL_STATUS = {
    "ReadyForUpsert": "RUNNING",
    "Upserting": "RUNNING",
    "Done": "SUCCEEDED",
    "Error": "ERROR",
}

# URL schemes each kind of import may be read from.
IMPORT_SCHEMES = {
    "NESTED": ("https", "drs"),
    "OPERATIONS": ("gs",),
    "MANIFEST": ("https",),
}

# Data-use value that every consent group must equal for the open-access gate.
OPEN_CONSENT = "NRES"

# Names an element record may have for its list to be unwrapped; the field's own
# name followed by "_tuple" counts as well.
LIST_WRAPPER_NAMES = ("list", "array")

# Prefixes of exported attribute names, by where the records came from.
EXPORT_PREFIX_NESTED = "pfb"
EXPORT_PREFIX_MANIFEST = "tdr"
