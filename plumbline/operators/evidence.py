"""Source against target catalogs, and declared rules against the data itself.

Table rows are ``(database, table_name, row_count, size_gb, partitions, ...)`` and column rows
``(database, table_name, column, type, nullable)``, for the source and for the target. A side without rows is no
evidence: such checks are ``skipped``, never ``passed``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import types as Y
from plumbline.operators.cells import quoted


def _status(equal: Column, seen: Column) -> Column:
    return F.when(~seen, "skipped").when(equal, "passed").otherwise("failed")


def _keys(source: DataFrame, target: DataFrame) -> list[str]:
    """What names a table: database, schema and name, as far as both catalogs say."""
    return [c for c in ("database", "schema", "table_name") if c in source.columns and c in target.columns]


def _sides(source: DataFrame, target: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Both catalogs under each other, marked, so that one exchange brings the sides of a key together. NULL in a key
    is a value like any other."""
    chosen = [*keys, *values]
    return source.select(*chosen, F.lit("source").alias("_side")).unionByName(target.select(*chosen, F.lit("target").alias("_side")))


def _of(side: str, value: str) -> Column:
    return F.when(F.col("_side") == side, F.col(value))


def table_row_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(*key, source_rows, target_rows, status)`` per table, so opposite errors cannot cancel out.

    A key that names several tables of one side is ``ambiguous``: which of them is meant can't be told.
    """
    keys = _keys(source, target)
    both = _sides(source, target, keys, "row_count").groupBy(*keys).agg(
        F.max(_of("source", "row_count")).alias("source_rows"), F.max(_of("target", "row_count")).alias("target_rows"),
        F.greatest(F.count_if(F.col("_side") == "source"), F.count_if(F.col("_side") == "target")).alias("_tables"))
    status = F.when(F.col("_tables") > 1, "ambiguous").when(F.col("source_rows").eqNullSafe(F.col("target_rows")), "passed").otherwise("failed")
    return both.withColumn("status", status).drop("_tables")


def row_count_check(source: DataFrame, target: DataFrame) -> DataFrame:
    rows = table_row_counts(source, target)
    return rows.agg(
        F.coalesce(F.sum("source_rows"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("target_rows"), F.lit(0)).alias("target_rows"),
        F.count_if(F.col("status") != "passed").alias("tables_failed"),
        (F.count("source_rows") * F.count("target_rows")).alias("seen"),
    ).select("source_rows", "target_rows", "tables_failed",
             _status(F.col("tables_failed") == 0, F.col("seen") > 0).alias("status"))


def schema_drift(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """``(*key, column, side)``: columns, names taken as written, that only one side has."""
    keys = [*_keys(source_columns, target_columns), "column"]
    both = _sides(source_columns, target_columns, keys).groupBy(*keys).agg(F.min("_side").alias("side"), F.max("_side").alias("_other"))
    return both.filter(F.col("side") == F.col("_other")).drop("_other")


def nullability_drift(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """``(*key, column, source_nullable, target_nullable)`` where the two disagree, column by column; not knowing
    disagrees with knowing."""
    keys = [*_keys(source_columns, target_columns), "column"]
    both = _sides(source_columns, target_columns, keys, "nullable").groupBy(*keys).agg(
        F.max(_of("source", "nullable")).alias("source_nullable"), F.max(_of("target", "nullable")).alias("target_nullable"),
        F.min("_side").alias("_first"), F.max("_side").alias("_last"))
    differ = (F.col("_first") != F.col("_last")) & ~F.col("source_nullable").eqNullSafe(F.col("target_nullable"))
    return both.filter(differ).drop("_first", "_last")


def foreign_key_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(*key, source_keys, target_keys)`` for tables whose declared foreign keys differ."""
    keys, none = _keys(source, target), F.array().cast("array<string>")
    declared = [df.withColumn("foreign_keys", F.array_sort(F.coalesce("foreign_keys", none))) for df in (source, target)]
    both = _sides(*declared, keys, "foreign_keys").groupBy(*keys).agg(
        F.max(_of("source", "foreign_keys")).alias("source_keys"), F.max(_of("target", "foreign_keys")).alias("target_keys"))
    return both.filter(~F.col("source_keys").eqNullSafe(F.col("target_keys")))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, relation: str) -> DataFrame:
    """One row ``(relation, orphan_rows, orphan_keys)``. Child rows are counted per key before the join, so a
    key that fills the child table reaches the join as one row."""
    keys = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    known = parent.select(F.col(parent_key).alias("k")).distinct()
    lost = keys.join(known, "k", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), F.count("*").alias("orphan_keys")).select(
        F.lit(relation).alias("relation"), "orphan_rows", "orphan_keys")


def runtime_checks(source: DataFrame, target: DataFrame, loaded: DataFrame) -> DataFrame:
    """Per source table: rows loaded against both catalogs.

    ``loaded`` is ``(*key, rows_loaded, digest, null_cells, nulls)``; a table that was not loaded is skipped. Tables
    are matched by database, schema and name as far as both sides carry them; a name that fits several tables of a
    side is ``ambiguous``. Without an expected target count the digest status is unknown.
    """
    keys = [c for c in ("database", "schema", "table_name") if c in source.columns]

    def one_each(df: DataFrame, by: list[str], *values: str) -> DataFrame:
        """One row per key, with how many tables it names."""
        return df.groupBy(*by).agg(F.count("*").alias("_n"), *[F.first(v).alias(v) for v in values])

    def matched(left: DataFrame, right: DataFrame, by: list[str], *values: str) -> DataFrame:
        found = one_each(right, by, *values).select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_n").alias("_found"), *values)
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by])
        joined = left.join(found, same, "left").drop(*[f"_k_{k}" for k in by])
        return joined.withColumn("_unclear", F.col("_unclear") | (F.coalesce("_found", F.lit(0)) > 1)).drop("_found")

    s = source.groupBy(*keys).agg(F.first("row_count").alias("expected_source_rows"), (F.count("*") > 1).alias("_unclear"))
    for side in (target, loaded):
        by = [k for k in keys if k in side.columns]
        if by != keys:
            # Several source tables that the other side can't tell apart.
            s = s.withColumn("_unclear", F.col("_unclear") | (F.count("*").over(Window.partitionBy(*by)) > 1))
    rows = matched(s, target.withColumnRenamed("row_count", "expected_target_rows"), [k for k in keys if k in target.columns], "expected_target_rows")
    rows = matched(rows, loaded, [k for k in keys if k in loaded.columns], "rows_loaded", "digest", "null_cells", "nulls")
    unclear, missing = F.col("_unclear"), F.col("rows_loaded").isNull()
    expected_target = F.coalesce("expected_target_rows", F.lit(0))
    status = F.when(unclear, "ambiguous").when(missing, "skipped").otherwise("checked")

    def checked(value: Column) -> Column:
        return F.when(status == "checked", value)

    def verdict(expected: Column) -> Column:
        return F.when(F.col("rows_loaded") == expected, "passed").otherwise("failed")

    return rows.select(
        *keys, status.alias("status"), F.when(status == "skipped", "csv_not_found").alias("reason"),
        checked(F.col("rows_loaded")).alias("rows_loaded"),
        checked(F.col("expected_source_rows")).alias("expected_source_rows"),
        checked(expected_target).alias("expected_target_rows"),
        checked(verdict(F.col("expected_source_rows"))).alias("row_count_status"),
        checked(F.when(expected_target == 0, "unknown").otherwise(verdict(expected_target))).alias("checksum_status"),
        checked(F.col("digest")).alias("digest"), checked(F.col("null_cells")).alias("null_cells"), checked(F.col("nulls")).alias("nulls"))


def loaded_stats(df: DataFrame, table_name: str, database: str | None = None) -> DataFrame:
    """``([database,] table_name, rows_loaded, digest, null_cells, nulls)`` of one loaded table, in one pass.

    ``nulls`` lists each column, in order, with its cells that are NULL or empty.
    """
    from plumbline.operators.reconcile import row_digest

    columns = [F.col(quoted(c)) for c in df.columns]
    names = [F.lit(table_name).alias("table_name")] if database is None else [F.lit(database).alias("database"), F.lit(table_name).alias("table_name")]
    one = df.agg(
        F.count("*").alias("rows_loaded"), F.coalesce(F.sum(row_digest(columns)), F.lit(0)).cast("string").alias("digest"),
        *[F.count_if(c.isNull() | (c.cast("string") == "")).alias(f"n{i}") for i, c in enumerate(columns)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(df.columns)])
    total = sum((F.col(f"n{i}") for i in range(len(columns))), F.lit(0).cast("long"))
    return one.select(*names, "rows_loaded", "digest", total.alias("null_cells"), entries.alias("nulls"))


# ---- estimates and compatibility over a source catalog -------------------------------------------------------------

def capacity(tables: DataFrame) -> DataFrame:
    """Totals of a catalog and the capacity they call for: 2 units per 100 GB, at least 4, at 20 dollars a day."""
    units = F.greatest(F.lit(4), F.floor(F.col("total_size_gb") / 100) * 2).cast("long")
    return tables.agg(
        F.count("*").alias("total_tables"), F.countDistinct("database").alias("total_databases"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("size_gb"), F.lit(0.0)).alias("total_size_gb"),
    ).withColumn("estimated_cu", units).withColumn("daily_cost_usd", F.col("estimated_cu") * 20).withColumn(
        "monthly_cost_usd", F.col("daily_cost_usd") * 30)


def transfer_estimate(tables: DataFrame, gb_per_hour: int = 100, usd_per_gb: float = 0.05) -> DataFrame:
    """Hours and dollars to move a catalog. The warehouse case moves 150 GB an hour at 0.04."""
    return tables.agg(F.coalesce(F.sum("size_gb"), F.lit(0.0)).alias("total_size_gb")).select(
        (F.floor(F.col("total_size_gb") / gb_per_hour) + 2).cast("long").alias("duration_hours"),
        F.round(F.col("total_size_gb") * usd_per_gb, 2).cast("double").alias("cost_usd"))


def database_rollup(tables: DataFrame) -> DataFrame:
    return tables.groupBy("database").agg(
        F.count("*").alias("tables"), F.sum("row_count").alias("rows"), F.sum("size_gb").alias("size_gb"))


def partitioned_tables(tables: DataFrame) -> DataFrame:
    return tables.filter(F.size("partitions") > 0)


def text_tables(tables: DataFrame) -> DataFrame:
    """Tables stored as text, largest first, with the space a columnar copy saves."""
    return tables.filter("table_format = 'TEXTFILE'").select(
        "database", "table_name", "row_count", "size_gb", (F.col("size_gb") * 0.9).alias("saved_gb")).orderBy(
        F.desc("size_gb"), "database", "table_name")


def risks(tables: DataFrame) -> DataFrame:
    """``(risk_id, category, severity, description)``: the rules that apply to a catalog."""
    totals = tables.agg(
        F.coalesce(F.sum("size_gb"), F.lit(0.0)).alias("gb"), F.count("*").alias("n"),
        F.count_if(F.size("partitions") > 0).alias("partitioned"))

    def risk(applies: Column, risk_id: str, category: str, severity: str, description: Column) -> Column:
        return F.when(applies, F.struct(F.lit(risk_id).alias("risk_id"), F.lit(category).alias("category"),
                                        F.lit(severity).alias("severity"), description.alias("description")))

    gb, n, parts = F.col("gb"), F.col("n"), F.col("partitioned")
    found = F.array_compact(F.array(
        risk(gb > 100, "R001", "Data Volume", "high", F.concat(
            F.lit("Large data volume ("), F.round(gb, 1).cast("decimal(38,1)").cast("string"),
            F.lit(" GB) - migration window may exceed SLA"))),
        risk(parts > 0, "R002", "Schema Complexity", "medium", F.concat(
            parts.cast("string"), F.lit(" partitioned tables require partition pruning strategy"))),
        risk(F.lit(True), "R003", "Type Mapping", "medium", F.lit(
            "Hive complex types (array, map, struct) mapped to JSON - validate application queries")),
        risk(n > 10, "R004", "Dependencies", "medium", F.concat(
            n.cast("string"), F.lit(" tables may have inter-table dependencies"))),
    ))
    return totals.select(F.explode(found).alias("r")).select("r.*")


def plan_validation(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``(check, status, message)``: schema coverage, columns left to the default type, and the monthly cost limit."""
    cost = capacity(tables)
    typed = columns.agg(
        F.count("*").alias("columns"),
        F.count_if((Y.hive_to_tsql(F.col("type")) == "nvarchar(max)") & ~F.col("type").isin("string", "varchar")).alias("unmapped"))
    # One row on each side, put into one.
    names = ["total_tables", "monthly_cost_usd", "columns", "unmapped"]
    both = cost.select("total_tables", "monthly_cost_usd").unionByName(typed, allowMissingColumns=True).agg(
        *[F.max(n).alias(n) for n in names])
    tables_n, unmapped, monthly = F.col("total_tables"), F.col("unmapped"), F.col("monthly_cost_usd")

    def row(check: str, ok: Column, good: Column, bad: Column, failure: str) -> Column:
        return F.struct(F.lit(check).alias("check"), F.when(ok, "passed").otherwise(failure).alias("status"),
                        F.when(ok, good).otherwise(bad).alias("message"))

    money = F.format_number(monthly, 0)
    return both.select(F.explode(F.array(
        row("Schema Coverage", tables_n > 0,
            F.concat(F.lit("All "), tables_n.cast("string"), F.lit(" tables have schema definitions")),
            F.lit("No tables found in catalog"), "failed"),
        row("Type Mapping", unmapped == 0,
            F.concat(F.lit("All "), F.col("columns").cast("string"), F.lit(" columns mapped successfully")),
            F.concat(unmapped.cast("string"), F.lit(" columns mapped to default type (nvarchar(max))")), "warning"),
        row("Capacity Limits", monthly <= 100_000,
            F.concat(F.lit("Capacity within limits: $"), money, F.lit("/month")),
            F.concat(F.lit("High monthly cost estimate: $"), money, F.lit(" - review optimization")), "warning"),
    )).alias("r")).select("r.*")


def hadoop_warnings(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``(database, table_name, column, warning)``: types without an equivalent and tables stored as text."""
    # The types taken over as they are. DATE has an equivalent too.
    supported = ["STRING", "INT", "BIGINT", "DOUBLE", "BOOLEAN", "TIMESTAMP", "DECIMAL", "DATE"]
    by_column = columns.filter(~F.col("type").isin(*supported)).select(
        "database", "table_name", "column",
        F.concat(F.lit("Tipo não suportado em Spark SQL: "), "type", F.lit(" (coluna "), "column", F.lit(")")).alias("warning"))
    by_table = tables.filter("table_format = 'TEXTFILE'").select(
        "database", "table_name", F.lit(None).cast("string").alias("column"),
        F.concat(F.lit("Tabela "), "table_name", F.lit(" em formato TEXT — converter para PARQUET é recomendado")).alias("warning"))
    return by_column.unionByName(by_table)


def warehouse_warnings(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Type warnings, transient tables and clustering keys of a warehouse catalog."""
    none = F.lit(None).cast("string")
    typed = columns.withColumn("note", Y.warehouse_warning(F.col("type"))).filter("note is not null").select(
        "database", "table_name", "column",
        F.concat("database", F.lit("."), "schema", F.lit("."), "table_name", F.lit("."), "column", F.lit(" ("), "type",
                 F.lit("): "), "note").alias("warning"))
    named = F.concat(F.lit("Tabela "), "schema", F.lit("."), "table_name")
    transient = tables.filter("table_type = 'TRANSIENT'").select(
        "database", "table_name", none.alias("column"),
        F.concat(named, F.lit(" é TRANSIENT — sem Fail-safe; mapear para Delta table sem Time Travel estendido")).alias("warning"))
    clustered = tables.filter("clustering_key <> ''").select(
        "database", "table_name", none.alias("column"),
        F.concat(named, F.lit(" usa clustering_key "), "clustering_key",
                 F.lit(" — avaliar Z-ORDER/liquid clustering no Delta")).alias("warning"))
    return typed.unionByName(transient).unionByName(clustered)


def oracle_warnings(columns: DataFrame) -> DataFrame:
    return columns.withColumn("note", Y.oracle_warning(F.col("type"))).filter("note is not null").select(
        "database", "table_name", "column",
        F.concat("database", F.lit("."), "schema", F.lit("."), "table_name", F.lit("."), "column", F.lit(": "), "note")
        .alias("warning"))


def compatibility(warnings: DataFrame, listed: int = 10) -> DataFrame:
    """Status and number of warnings, with the first ones in catalog order. The list is a report's top rows; the
    count covers them all."""
    order = ["database", "table_name", "column", "warning"]
    first = warnings.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(listed).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(
            "database", "table_name", F.coalesce("column", F.lit("\uffff")).alias("column"), "warning"))),
            lambda s: s["warning"]).alias("warnings"))
    total = warnings.agg(F.count("*").alias("warnings_count"))
    status = F.when(F.col("warnings_count") > 0, "COMPATIBLE_WITH_WARNINGS").otherwise("FULLY_COMPATIBLE")
    # One row on each side, put into one.
    both = total.unionByName(first, allowMissingColumns=True).agg(
        F.max("warnings_count").alias("warnings_count"), F.max("warnings").alias("warnings"))
    return both.select(status.alias("compatibility_status"), "warnings_count", "warnings")


def lineage_edges(jobs: DataFrame) -> DataFrame:
    """``(job_name, direction, dataset)``: what each job reads and writes. Inputs meet outputs in their job, so the
    edges stay as many as the declarations."""
    reads = jobs.select("job_name", F.lit("input").alias("direction"), F.explode("inputs.name").alias("dataset"))
    writes = jobs.select("job_name", F.lit("output").alias("direction"), F.explode("outputs.name").alias("dataset"))
    return reads.unionByName(writes).distinct()


def grants_per_principal(grants: DataFrame) -> DataFrame:
    each = grants.select("principal_name", "resource_name", F.explode("permissions").alias("permission"))
    return each.groupBy("principal_name").agg(
        F.count("*").alias("grants"), F.countDistinct("permission").alias("permissions"))
