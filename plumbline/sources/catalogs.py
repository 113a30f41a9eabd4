"""Nested JSON catalogs as flat tables, and catalogs of tables that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMN = "array<struct<name:string,type:string,comment:string,nullable:boolean>>"
_TABLE = (
    "struct<table_name:string,name:string,row_count:bigint,storage_size_gb:double,size_gb:double,bytes:bigint,"
    "table_format:string,table_type:string,clustering_key:string,partitions:array<string>,"
    f"foreign_keys:array<string>,columns:{_COLUMN}>"
)
SOURCE_SCHEMA = f"databases array<struct<name:string,tables:array<{_TABLE}>,schemas:array<struct<name:string,tables:array<{_TABLE}>>>>>"
TARGET_SCHEMA = (
    "fabric_schema struct<workspaces:array<struct<lakehouses:array<struct<tables:array<struct<name:string,"
    "properties:struct<original_row_count:bigint,foreign_keys:array<string>>,"
    "schema:struct<columns:array<struct<name:string,type:string,nullable:boolean>>>>>>>>>>"
)


def read_source_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return flatten_source(spark.read.schema(SOURCE_SCHEMA).option("multiLine", True).json(path))


def flatten_source(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tables, columns)`` of a source catalog, with or without a schema level."""
    databases = catalog.select(F.explode("databases").alias("d"))
    direct = databases.select(F.col("d.name").alias("database"), F.lit(None).cast("string").alias("schema"), F.explode("d.tables").alias("t"))
    nested = databases.select(F.col("d.name").alias("database"), F.explode("d.schemas").alias("s")).select(
        "database", F.col("s.name").alias("schema"), F.explode("s.tables").alias("t"))
    rows = direct.unionByName(nested).withColumn("table_name", F.coalesce("t.table_name", "t.name"))
    gb = F.coalesce("t.storage_size_gb", "t.size_gb", F.col("t.bytes") / F.lit(1024.0**3))
    tables = rows.select(
        "database", "schema", "table_name", F.coalesce("t.row_count", F.lit(0)).alias("row_count"), gb.alias("size_gb"),
        F.col("t.table_format").alias("table_format"), F.col("t.table_type").alias("table_type"),
        F.col("t.clustering_key").alias("clustering_key"),
        F.coalesce("t.partitions", F.array().cast("array<string>")).alias("partitions"),
        F.col("t.foreign_keys").alias("foreign_keys"))
    columns = rows.select("database", "schema", "table_name", F.explode("t.columns").alias("c")).select(
        "database", "schema", "table_name", F.col("c.name").alias("column"), F.col("c.type").alias("type"),
        F.coalesce("c.nullable", F.lit(False)).alias("nullable"))
    return tables, columns


def flatten_target(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = (plan.select(F.explode("fabric_schema.workspaces").alias("w")).select(F.explode("w.lakehouses").alias("l"))
            .select(F.explode("l.tables").alias("t")))
    tables = rows.select(
        F.col("t.name").alias("table_name"), F.coalesce("t.properties.original_row_count", F.lit(0)).alias("row_count"),
        F.col("t.properties.foreign_keys").alias("foreign_keys"))
    columns = rows.select(F.col("t.name").alias("table_name"), F.explode("t.schema.columns").alias("c")).select(
        "table_name", F.col("c.name").alias("column"), F.col("c.type").alias("type"),
        F.coalesce("c.nullable", F.lit(False)).alias("nullable"))
    return tables, columns


def csv_presence(tables: DataFrame, root: str) -> DataFrame:
    """``(database, table_name, path, found)``: which tables have ``<root>/<database>/<table>.csv``, a file or a folder
    of part files. Only file names are read."""
    spark = tables.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    place = r"^(.*/([^/]+)/([^/]+)\.csv)(/[^/]+)?$"
    # A part file's folder is the table; a file directly under the database is a table of its own.
    folder = r"^(.*/([^/]+)/([^/]+)\.csv)/[^/]+$"
    pattern = F.when(F.col("path").rlike(folder), F.lit(folder)).otherwise(F.lit(place))
    part = lambda i: F.expr(f"regexp_extract(path, pattern, {i})")
    listed = files.select("path", pattern.alias("pattern")).select(part(2).alias("_d"), part(3).alias("_t"), part(1).alias("path")).distinct()
    wanted = tables.select("database", "table_name").distinct()
    same = F.col("database").eqNullSafe(F.col("_d")) & F.col("table_name").eqNullSafe(F.col("_t"))
    return wanted.join(listed, same, "left").select("database", "table_name", "path", F.col("path").isNotNull().alias("found"))


def mapping_digest(mapping: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, sha256)``: a digest of each mapping's entries in source order, for the audit trail."""
    entries = F.array_sort(F.collect_list(F.struct("source", "target", "type")))
    return mapping.groupBy(*keys).agg(F.sha2(F.to_json(entries), 256).alias("sha256"))


def append_audit(entries: DataFrame, path: str) -> None:
    entries.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)
