"""The five history tables on storage: Parquet for work, CSV for exchange."""

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from pyspark.sql import functions as F, types as T

from annalist import schemas
from annalist.functions import fields
from annalist.sources import shared

_PARTITIONED = ("commit", "change")
_CSV = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_table(name: str, df: DataFrame, base: str) -> None:
    """Replace one table below ``base``.

    Tables with a ``datetime`` get the parsed columns of ``fields.enrich``. Commits and
    changes are partitioned by the local year; the rebalance hint lets adaptive execution
    merge small years and split large ones into files of an even size. Inside a file the rows
    lie by author and repository, the usual filters, so that the pages of others are skipped.
    """
    if "datetime" in df.columns and "commit_year" not in df.columns:
        df = fields.enrich(df)
    if name in _PARTITIONED:
        even = df.hint("rebalance", "commit_year")
        ordered = even.sortWithinPartitions("commit_year", "author_name", "repo_name")
        _replace(ordered).partitionBy("commit_year").parquet(f"{base}/{name}")
    else:
        _replace(df.hint("rebalance")).parquet(f"{base}/{name}")


def _replace(df: DataFrame) -> DataFrameWriter:
    """A writer that replaces the whole table, whatever the session says about partitions."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "static")


def write_csv(name: str, df: DataFrame, base: str) -> None:
    df.select(*schemas.columns(schemas.TABLES[name])).write.mode("overwrite").options(
        **_CSV
    ).csv(f"{base}/{name}")


def read_table(spark: SparkSession, name: str, base: str) -> DataFrame:
    return spark.read.schema(schemas.stored(name)).parquet(f"{base}/{name}")


def _csv_path(spark: SparkSession, name: str, base: str) -> "str | None":
    """Where a CSV table lies: a folder ``name`` or a single file ``name.csv``."""
    for path in (f"{base}/{name}", f"{base}/{name}.csv"):
        if shared.exists(spark, path):
            return path
    return None


def read_csv(spark: SparkSession, name: str, base: str) -> DataFrame:
    """One CSV table with its fixed schema; an empty text field is ``''``, never NULL.

    Columns are found by the names in the header, in any order and any case; one that is
    missing is empty, and others are left out.
    """
    path = _csv_path(spark, name, base) or f"{base}/{name}"
    schema = schemas.TABLES[name]
    raw = spark.read.schema(_csv_schema(spark, schema, path)).options(**_CSV).csv(path)
    held = set(raw.columns)
    picked = [
        (F.col(f.name) if f.name in held else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    return raw.select(*picked).na.fill("")


def _csv_schema(spark: SparkSession, schema: T.StructType, path: str) -> T.StructType:
    """The types of a table on the columns of a file, in the order of the file's header."""
    head = spark.read.options(**_CSV).option("inferSchema", False).csv(path).columns
    known = {f.name.lower(): f for f in schema.fields}
    other = (T.StructField(f"_other{i}", T.StringType()) for i in range(len(head)))
    return T.StructType([known.get(h.strip().lower(), o) for h, o in zip(head, other)]) or schema


def _quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _forget(spark: SparkSession, db: str, name: str) -> None:
    """Drop a table or view of a database from the catalogue; files stay where they are."""
    if spark.catalog.tableExists(f"`{db}`.`{name}`"):
        kind = spark.catalog.getTable(f"`{db}`.`{name}`").tableType
        spark.sql(f"DROP {'VIEW' if kind == 'VIEW' else 'TABLE'} `{db}`.`{name}`")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _register_parquet(spark: SparkSession, table: str, name: str, path: str) -> None:
    by_year = "PARTITIONED BY (commit_year)" if name in _PARTITIONED else ""
    spark.sql(
        f"CREATE TABLE {table} ({_ddl(schemas.stored(name))}) USING parquet {by_year}"
        f" LOCATION {_quoted(path)}"
    )
    if by_year:
        spark.catalog.recoverPartitions(table)


def _register_csv(spark: SparkSession, table: str, raw: str, name: str, path: str) -> None:
    """The files as one table, and a view on it without NULL texts."""
    schema = schemas.TABLES[name]
    found = _csv_schema(spark, schema, path)
    held = set(found.fieldNames())

    def column(f: T.StructField) -> str:
        value = f"`{f.name}`" if f.name in held else f"CAST(NULL AS {f.dataType.simpleString()})"
        return f"coalesce({value}, '')" if f.dataType == T.StringType() else value

    filled = ", ".join(f"{column(f)} AS `{f.name}`" for f in schema.fields)
    options = ", ".join(f"{k} {_quoted(str(v).lower())}" for k, v in _CSV.items())
    spark.sql(
        f"CREATE TABLE {raw} ({_ddl(found)}) USING csv OPTIONS ({options})"
        f" LOCATION {_quoted(path)}"
    )
    spark.sql(f"CREATE VIEW {table} AS SELECT {filled} FROM {raw}")


def register_database(spark: SparkSession, db: str, base: str, fmt: str = "parquet") -> list[str]:
    """Make the tables below ``base`` known as ``db.commit`` and so on; missing ones are skipped.

    Several databases may be registered together. Names of an earlier registration go first,
    so that a database can move to another folder or format. Returns what was found.
    """
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{db}` LOCATION {_quoted(base)}")
    found = []
    for name in schemas.TABLES:
        table = f"`{db}`.`{name}`"
        _forget(spark, db, name)
        _forget(spark, db, f"{name}_csv")
        if fmt == "parquet":
            if not shared.exists(spark, f"{base}/{name}"):
                continue
            _register_parquet(spark, table, name, f"{base}/{name}")
        else:
            path = _csv_path(spark, name, base)
            if path is None:
                continue
            _register_csv(spark, table, f"`{db}`.`{name}_csv`", name, path)
        found.append(name)
    return found
