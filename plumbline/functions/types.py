"""Types: what can hold what was measured, and how types are named on the other platforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The types a mapping may ask for.
TARGET_TYPES = ["string", "int", "bigint", "double", "decimal", "boolean", "date", "timestamp"]
NUMERIC_TARGETS = ["int", "bigint", "double", "decimal"]
INT_MAX = 2_147_483_647
SPARE_DIGITS = 4
VARCHAR_SIZES = [16, 32, 64, 128, 256, 512, 1024, 4000, 8000]

# Which target types agree with a measured type.
FAMILIES = {
    "integer": ["int", "bigint"], "decimal": ["double", "decimal"], "boolean": ["boolean"],
    "date": ["date", "timestamp"], "text": ["string"], "mixed": ["string"], "empty": ["string"],
}

# Type names per platform pair.
HIVE_TO_TSQL = {
    "bigint": "bigint", "int": "int", "string": "nvarchar(max)", "double": "float", "float": "real",
    "boolean": "bit", "timestamp": "datetime2(3)", "date": "date", "decimal": "decimal",
    "binary": "varbinary(max)", "char": "char", "varchar": "varchar", "array": "nvarchar(max)",
    "map": "nvarchar(max)", "struct": "nvarchar(max)",
}
HIVE_TO_LAKE = {
    "STRING": "STRING", "INT": "INT", "BIGINT": "LONG", "DOUBLE": "DOUBLE", "BOOLEAN": "BOOLEAN",
    "TIMESTAMP": "TIMESTAMP", "DECIMAL": "DECIMAL(18,4)", "DATE": "DATE", "ARRAY": "ARRAY<STRING>",
    "MAP": "MAP<STRING,STRING>", "STRUCT": "STRUCT<>",
}
WAREHOUSE_TO_DELTA = {
    "VARCHAR": "STRING", "NUMBER": "DECIMAL(38,10)", "FLOAT": "DOUBLE", "BOOLEAN": "BOOLEAN", "DATE": "DATE",
    "TIMESTAMP_NTZ": "TIMESTAMP_NTZ", "TIMESTAMP_TZ": "TIMESTAMP", "VARIANT": "VARIANT", "OBJECT": "STRUCT",
    "ARRAY": "ARRAY<STRING>", "BINARY": "BINARY",
}
WAREHOUSE_WARNINGS = {
    "TIMESTAMP_TZ": "Timezone info collapsed to UTC — normalizar antes da migração",
    "VARIANT": "Requer Databricks Runtime 15+ para tipo VARIANT nativo; fallback: STRING (JSON)",
    "OBJECT": "Mapeamento manual de STRUCT recomendado; fallback: STRING (JSON)",
    "ARRAY": "Elemento assumido como STRING; validar tipo real",
}
ORACLE_TO_DELTA = {
    "VARCHAR2": "STRING", "NUMBER": "DECIMAL(38)", "FLOAT": "DOUBLE", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP",
    "CLOB": "STRING", "BLOB": "BINARY", "XMLTYPE": "STRING",
}


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), default)


def hive_to_tsql(declared: Column) -> Column:
    base = F.lower(F.trim(F.substring_index(declared, "(", 1)))
    return lookup(base, HIVE_TO_TSQL, F.lit("nvarchar(max)"))


def hive_to_lake(declared: Column) -> Column:
    return lookup(declared, HIVE_TO_LAKE, F.lit("STRING"))


def warehouse_to_delta(declared: Column) -> Column:
    return lookup(declared, WAREHOUSE_TO_DELTA, F.lit("STRING"))


def warehouse_warning(declared: Column) -> Column:
    known = F.coalesce(declared.isin(*WAREHOUSE_TO_DELTA), F.lit(False))
    return F.when(~known, F.concat(F.lit("Tipo desconhecido: "), declared)).otherwise(
        lookup(declared, WAREHOUSE_WARNINGS, F.lit(None).cast("string")))


def oracle_to_delta(declared: Column) -> Column:
    return lookup(declared, ORACLE_TO_DELTA, F.lit("STRING"))


def oracle_warning(declared: Column) -> Column:
    known = F.coalesce(declared.isin(*ORACLE_TO_DELTA), F.lit(False))
    return F.when(~known, "Unknown type, fallback STRING")


def _magnitude(low: Column, high: Column) -> Column:
    """The larger absolute bound; NULL when a bound is not a number."""
    zero = F.lit("0")
    low_number = F.coalesce(F.nullif(low, F.lit("")), zero).try_cast("double")
    high_number = F.coalesce(F.nullif(high, F.lit("")), zero).try_cast("double")
    return F.when(low_number.isNotNull() & high_number.isNotNull(), F.greatest(F.abs(low_number), F.abs(high_number)))


def type_conflict(kind: Column, suggested: Column, low: Column, high: Column, has_time: Column) -> Column:
    """Why the suggested type cannot hold the measured column, or NULL when it can. The first reason counts."""
    named = F.coalesce(kind, F.lit("None"))
    is_a = F.concat(F.lit("a coluna é "), named)
    integral = suggested.isin("int", "bigint")
    # The reasons, as they are shown.
    return (
        F.when(suggested.isin(*NUMERIC_TARGETS) & ~named.isin("integer", "decimal"), F.concat(is_a, F.lit(", não numérica")))
        .when(integral & (named == "decimal"), "há casas decimais que seriam perdidas")
        .when((suggested == "int") & (_magnitude(low, high) > INT_MAX),
              F.concat(F.lit("valores até "), F.coalesce(high, F.lit("None")), F.lit(" não cabem em int (use bigint)")))
        .when((suggested == "boolean") & (named != "boolean"), F.concat(is_a, F.lit(", não booleana")))
        .when(suggested.isin("date", "timestamp") & (named != "date"),
              F.concat(is_a, F.lit(", não tem um formato de data reconhecido")))
        .when((suggested == "date") & F.coalesce(has_time, F.lit(False)),
              "os valores têm hora, que se perderia em date (use timestamp)")
    )


def inferred_type(kind: Column, low: Column, high: Column, has_time: Column) -> Column:
    """The safest target type for what was measured."""
    return (
        F.when(kind == "integer", F.when(_magnitude(low, high) <= INT_MAX, "int").otherwise("bigint"))
        .when(kind == "date", F.when(F.coalesce(has_time, F.lit(False)), "timestamp").otherwise("date"))
        .when(kind.isin("decimal", "boolean"), kind)
        .otherwise("string")
    )


def safe_type(kind: Column, suggested: Column, low: Column, high: Column, has_time: Column) -> Column:
    """A type that holds the measured column, as near to the suggested one as that allows."""
    return (
        F.when(suggested.isin("int", "bigint") & (kind == "integer"), "bigint")
        .when(suggested.isin("int", "bigint", "double") & (kind == "decimal"), "decimal")
        .when(suggested.isin("date", "timestamp") & (kind == "date"),
              F.when(F.coalesce(has_time, F.lit(False)), "timestamp").otherwise("date"))
        .when(suggested.isin(*NUMERIC_TARGETS, "boolean", "date", "timestamp"), "string")
        .otherwise(inferred_type(kind, low, high, has_time))
    )


def decimal_type(digits: Column, scale: Column) -> Column:
    precision = F.least(F.lit(38), F.greatest(F.lit(1), digits + scale + SPARE_DIGITS))
    known = F.concat(F.lit("DECIMAL("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")"))
    return F.when(digits.isNull() | scale.isNull(), "DECIMAL(38,10)").otherwise(known)


def spark_type(target: Column, digits: Column, scale: Column) -> Column:
    return F.when(target == "decimal", decimal_type(digits, scale)).otherwise(F.upper(target))


def varchar_type(max_len: Column) -> Column:
    """The first size that holds twice the measured characters: an accented letter takes two bytes."""
    wanted = F.greatest(F.coalesce(max_len, F.lit(1)), F.lit(1)) * 2
    size = F.lit(VARCHAR_SIZES[-1])
    for candidate in reversed(VARCHAR_SIZES):
        size = F.when(wanted <= candidate, candidate).otherwise(size)
    return F.concat(F.lit("VARCHAR("), size.cast("string"), F.lit(")"))


def tsql_type(target: Column, max_len: Column, digits: Column, scale: Column) -> Column:
    fixed = {"int": "INT", "bigint": "BIGINT", "double": "FLOAT", "boolean": "BIT", "date": "DATE",
             "timestamp": "DATETIME2(6)"}
    return F.when(target == "string", varchar_type(max_len)).when(
        target == "decimal", decimal_type(digits, scale)).otherwise(lookup(target, fixed, F.lit(None).cast("string")))
