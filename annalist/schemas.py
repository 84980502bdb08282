"""Fixed schemas of the five history tables and of the inputs they are loaded from."""

from pyspark.sql import types as T


def _strings(*names):
    return [T.StructField(name, T.StringType()) for name in names]


def _counters(*names):
    return [T.StructField(name, T.LongType()) for name in names]


_COMMIT_FIELDS = (
    "repo_name",
    "hash",
    "branch",
    "datetime",
    "author_name",
    "author_email",
    "author_domain",
)

COMMIT = T.StructType(_strings(*_COMMIT_FIELDS))
CHANGE = T.StructType(_strings(*_COMMIT_FIELDS, "ext") + _counters("insertion", "deletion"))
TAG = T.StructType(_strings("repo_name", "branch", "datetime", "tag"))
SNAPSHOT = T.StructType(
    _strings("repo_name", "branch", "datetime", "ext") + _counters("code", "comments", "blanks")
)
ACTIVE = T.StructType(_strings("repo_name") + _counters("forks", "stars"))

TABLES = {
    "commit": COMMIT,
    "change": CHANGE,
    "tag": TAG,
    "snapshot": SNAPSHOT,
    "active": ACTIVE,
}

# What a stored table with a ``datetime`` carries beside it; see ``functions.fields``.
PARSED_TIME = [
    T.StructField("local_ts", T.TimestampNTZType()),
    T.StructField("utc_ts", T.TimestampType()),
    T.StructField("tz", T.StringType()),
    T.StructField("commit_year", T.IntegerType()),
]

# Parsed log sections on storage, between the log and the tables.
PARSED = T.StructType(
    _strings(*_COMMIT_FIELDS)
    + _counters("files")
    + [
        T.StructField(
            "entries",
            T.ArrayType(T.StructType(_strings("ext") + _counters("insertion", "deletion"))),
        )
    ]
    + _strings("reject")
    + PARSED_TIME
    + _counters("section")
)

MANIFEST = T.StructType(
    _strings("name", "branch", "remote", "path") + _counters("forks_count", "stargazers_count")
)
API_REPOSITORY = T.StructType(
    _strings("full_name", "clone_url", "default_branch")
    + _counters("forks_count", "stargazers_count")
)
AUTHOR_MAPPING = T.StructType(
    [T.StructField("ord", T.IntegerType())]
    + _strings("src_name", "src_email", "dst_name", "dst_email")
)


def columns(schema: T.StructType) -> list[str]:
    return schema.fieldNames()


def stored(name: str) -> T.StructType:
    """Schema of a table on storage."""
    fields = TABLES[name].fields
    return T.StructType(fields + (PARSED_TIME if "datetime" in TABLES[name].names else []))
