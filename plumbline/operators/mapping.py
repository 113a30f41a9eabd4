"""Column mappings: reading suggested ones, checking them against a profile, and correcting them.

A mapping row is ``(dataset, source, target, type, legacy)``. ``legacy`` marks the short form that names a target
and no type. A profile row needs ``(dataset, position, name, type, min, max, has_time)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.functions import types as Y
from plumbline.operators.flags import in_order

# The checks in order, with the detail shown when they pass and when they fail.
CHECKS = [
    ("covers_all_columns", "Toda coluna de origem tem destino.", "Colunas de origem sem destino."),
    ("no_unknown_columns", "Nenhuma coluna inventada.", "O modelo mapeou colunas que não existem."),
    ("delta_safe_names", "Todos os nomes de destino são seguros para Delta.", "Nomes de destino fora de [a-z_][a-z0-9_]*."),
    ("unique_targets", "Nenhum destino repetido.", "Várias colunas apontam para o mesmo destino."),
    ("valid_types", "Todos os tipos são suportados.",
     "Tipos fora de string, int, bigint, double, decimal, boolean, date, timestamp."),
    ("type_fits_data", "Todo tipo sugerido comporta os dados medidos.", "Tipo sugerido não comporta os dados medidos."),
]


def parsed_answers(answers: DataFrame, content: str = "content") -> DataFrame:
    """Suggested mappings from free-text answers: ``(*answer columns, error, entries)``.

    The JSON object is taken from a code fence or from the outermost braces, and nothing else may stand between them.
    An answer without one has no entries and an error. Of a name given twice the last entry counts.
    """
    text = F.col(content)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(text.rlike(r"(?s)```(?:json)?\s*.*?```"), fenced).otherwise(text)
    braces = F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))
    # In brackets, whatever follows the object is an error or a second element.
    listed = F.try_parse_json(F.concat(F.lit("["), braces, F.lit("]"))).cast("array<variant>")
    entries = F.when(F.size(listed) == 1, F.get(listed, 0).cast("map<string,variant>"))
    return answers.withColumn("entries", entries).withColumn(
        "error", F.when(F.col("entries").isNull(), "unparseable model output"))


def _text_at(entry: Column, path: str) -> Column:
    """The text at a path of a JSON value, NULL if anything else stands there."""
    found = F.try_variant_get(entry, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(entry, path, "string"))


def mapping_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One mapping row per entry of each parsed answer. An entry is a text, the target, or an object; anything else, and
    a target that is not a text, gives none."""
    rows = parsed.select(*keys, F.explode("entries").alias("source", "entry"))
    entry = F.col("entry")
    return rows.select(
        *keys, "source", F.coalesce(_text_at(entry, "$"), _text_at(entry, "$.target")).alias("target"),
        _text_at(entry, "$.type").alias("type"), (F.schema_of_variant(entry) == "STRING").alias("legacy"))


def _joined(profile: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("dataset").alias("m_dataset"), F.col("source"), F.col("target"),
                       F.col("type").alias("suggested"), F.col("legacy"))
    matched = (profile["dataset"] == m["m_dataset"]) & (profile["name"] == m["source"])
    return profile.join(m, matched, "full_outer")


def unknown_columns(profile: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped columns that the dataset does not have."""
    known = profile.select("dataset", F.col("name").alias("source"))
    return mapping.join(known, ["dataset", "source"], "left_anti").select("dataset", "source")


def uncovered_columns(profile: DataFrame, mapping: DataFrame) -> DataFrame:
    """Columns of the dataset that no mapping gives a target."""
    covered = mapping.filter(F.col("target").isNotNull()).select("dataset", F.col("source").alias("name"))
    return profile.join(covered, ["dataset", "name"], "left_anti").select("dataset", "name")


def mapping_offenders(profile: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(dataset, check, position, offender)``: everything the six checks object to."""
    j = _joined(profile, mapping)
    source, target, suggested = F.col("source"), F.col("target"), F.col("suggested")
    known, mapped = F.col("name").isNotNull(), F.col("source").isNotNull()
    typed = known & mapped & ~F.col("legacy")
    conflict = Y.type_conflict(F.col("type"), suggested, F.col("min"), F.col("max"), F.col("has_time"))
    arrow = F.lit(" → ")

    def offence(check: str, when: Column, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(check).alias("check"), text.alias("offender")))

    rows = j.select(
        F.coalesce("dataset", "m_dataset").alias("dataset"), "position",
        F.explode(F.array_compact(F.array(
            offence("covers_all_columns", known & target.isNull(), F.col("name")),
            offence("no_unknown_columns", ~known, source),
            offence("delta_safe_names", known & target.isNotNull() & ~target.rlike(N.TARGET_NAME),
                    F.concat("name", arrow, target)),
            offence("valid_types", typed & ~F.coalesce(suggested.isin(*Y.TARGET_TYPES), F.lit(False)),
                    F.concat("name", F.lit(": "), F.coalesce(F.concat(F.lit("'"), suggested, F.lit("'")), F.lit("None")))),
            offence("type_fits_data", typed & conflict.isNotNull(),
                    F.concat("name", F.lit(": "), suggested, F.lit(", "), conflict)),
        ))).alias("o"),
    ).select("dataset", "o.check", "position", "o.offender")
    shared = (
        profile.select("dataset", "position", "name")
        .join(mapping.filter(F.col("target").isNotNull())
              .select("dataset", F.col("source").alias("name"), "target"), ["dataset", "name"])
        .groupBy("dataset", "target")
        .agg(F.count("*").alias("n"), F.min("position").alias("position"), in_order("position", F.col("name")).alias("names"))
        .filter("n > 1")
        .select("dataset", F.lit("unique_targets").alias("check"), "position",
                F.concat(F.concat_ws(", ", "names"), arrow, F.col("target")).alias("offender"))
    )
    return rows.unionByName(shared)


@dataclass(frozen=True)
class OwnCheck:
    """A check of the user's own. ``offends`` gets profile and mapping side by side, ``(dataset, position, name, type,
    ..., source, target, suggested, legacy)``, and returns ``(dataset, position, offender)``, a row for each offence."""

    name: str
    passed: str
    failed: str
    offends: Callable[[DataFrame], DataFrame]


class OwnChecks:
    """The user's checks in the order they were registered; names are their own and none of the six."""

    def __init__(self) -> None:
        self.all: list[OwnCheck] = []

    def register(self, name: str, passed: str = "", failed: str = "") -> Callable[[Callable], Callable]:
        if name in {c[0] for c in CHECKS} | {c.name for c in self.all}:
            raise ValueError(f"there is a check {name!r} already")

        def add(offends: Callable[[DataFrame], DataFrame]) -> Callable:
            self.all.append(OwnCheck(name, passed or f"{name}: ok", failed or f"{name}: failed", offends))
            return offends

        return add

    def offenders(self, profile: DataFrame, mapping: DataFrame) -> DataFrame:
        """``(dataset, check, position, offender)`` of all registered checks."""
        joined = _joined(profile, mapping).withColumn("dataset", F.coalesce("dataset", "m_dataset")).drop("m_dataset")
        found = []
        for check in self.all:
            rows = check.offends(joined)
            missing = {"dataset", "position", "offender"} - set(rows.columns)
            if missing:
                raise ValueError(f"check {check.name!r} returns no {', '.join(sorted(missing))}")
            found.append(rows.select("dataset", F.lit(check.name).alias("check"), F.col("position").cast("int").alias("position"),
                                     F.col("offender").cast("string").alias("offender")))
        return reduce(DataFrame.unionByName, found)


def check_mapping(profile: DataFrame, mapping: DataFrame, with_offenders: bool = True, own: OwnChecks | None = None) -> DataFrame:
    """``(dataset, ordinal, name, status, details, n_offenders, offenders)``: six checks per dataset, and ``own`` ones
    after them, which count like the six.

    The offenders of a check are columns of one table. Without them nothing but counts is gathered, and
    ``mapping_offenders`` gives them one per row.
    """
    more = own.all if own else []
    skeleton = profile.select("dataset").distinct().select(
        "dataset", F.explode(F.array(*[
            F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), F.lit(ok).alias("ok"), F.lit(bad).alias("bad"))
            for i, (n, ok, bad) in enumerate([*CHECKS, *((c.name, c.passed, c.failed) for c in more)])])).alias("c")).select("dataset", "c.*")
    aggregates = [F.count("*").alias("n")]
    if with_offenders:
        entry = F.struct(F.coalesce("position", F.lit(2**31 - 1)).alias("p"), F.col("offender").alias("o"))
        aggregates.append(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["o"]).alias("found"))
    offenders = mapping_offenders(profile, mapping)
    if more:
        offenders = offenders.unionByName(own.offenders(profile, mapping))
    found = offenders.groupBy("dataset", F.col("check").alias("name")).agg(*aggregates)
    rows = skeleton.join(found, ["dataset", "name"], "left")
    failed = F.col("n").isNotNull()
    columns = [
        "dataset", "ordinal", "name", F.when(failed, "failed").otherwise("passed").alias("status"),
        F.when(failed, F.col("bad")).otherwise(F.col("ok")).alias("details"),
        F.coalesce("n", F.lit(0)).cast("int").alias("n_offenders")]
    if with_offenders:
        columns.append(F.coalesce("found", F.array().cast("array<string>")).alias("offenders"))
    return rows.select(*columns)


def pass_rates(items: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """The share of passed checks per item. No checks is no evidence: the rate is 0."""
    counted = checks.groupBy(*keys).agg(
        F.count("*").alias("checks"), F.count_if(F.col("status") == "passed").alias("passed"))
    return items.select(*keys).distinct().join(counted, keys, "left").select(
        *keys, F.coalesce("checks", F.lit(0)).cast("long").alias("checks"),
        F.coalesce("passed", F.lit(0)).cast("long").alias("passed"),
        F.coalesce(F.col("passed") / F.col("checks"), F.lit(0.0)).alias("pass_rate"))


def _settled(group: pd.DataFrame) -> pd.DataFrame:
    """The name of each column of a family, by proposals: a column asks for its own name, then for ``name_2``,
    ``name_3``... A name goes to the earliest column that asks for it; one that loses a name asks for its next."""
    held: dict[str, tuple[int, str, int]] = {}
    asking = [(int(position), base, 1) for position, base in zip(group["position"], group["base"])]
    while asking:
        position, base, number = asking.pop()
        name = base if number == 1 else f"{base}_{number}"
        other = held.get(name)
        if other is None or position < other[0]:
            held[name] = (position, base, number)
        else:
            other = (position, base, number)
        if other is not None:
            asking.append((other[0], other[1], other[2] + 1))
    names = {position: name for name, (position, _, _) in held.items()}
    return pd.DataFrame({"rows": group["rows"], "unique": group["position"].map(names)})


def with_unique_names(columns: DataFrame) -> DataFrame:
    """Add ``unique`` to rows with ``(dataset, position, base)``: earlier columns keep their names.

    Names can only meet inside a family: the same name once trailing ``_<number>`` parts are cut off. Repeats are
    numbered; only families in which a repeated name meets other names need their columns taken one after the other.
    Rows are brought together once, by dataset: a dataset's rows are the columns of one table.
    """
    names = columns.columns
    same, family = Window.partitionBy("dataset", "base"), Window.partitionBy("dataset", "family")
    told = (
        columns.withColumn("family", F.regexp_replace("base", "(_[0-9]+)+$", "")).repartition("dataset")
        .withColumn("times", F.count("*").over(same)).withColumn("turn", F.row_number().over(same.orderBy("position")))
        .withColumn("tangled", (F.max("times").over(family) > 1) & (F.min("base").over(family) != F.max("base").over(family))))
    turn = F.col("turn")
    simple = told.filter("NOT tangled").select(
        *names, F.when(turn == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), turn.cast("string"))).alias("unique"))
    # Whole rows go through as one value, whatever their types.
    rows = told.filter("tangled").select("dataset", "family", F.col("position").cast("long").alias("position"), "base", F.struct(*names).alias("rows"))
    kind = rows.schema["rows"].dataType
    packed = rows.withColumn("rows", F.to_json("rows", {"ignoreNullFields": "false"}))
    settled = packed.groupBy("dataset", "family").applyInPandas(_settled, "rows string, unique string")
    return simple.unionByName(settled.select(F.from_json("rows", kind).alias("rows"), "unique").select("rows.*", "unique"))


def unique_names(columns: DataFrame) -> DataFrame:
    """``(dataset, position, base)`` to ``(dataset, position, unique)``; see ``with_unique_names``."""
    named = with_unique_names(columns.select("dataset", "position", "base"))
    return named.select("dataset", F.col("position").cast("long").alias("position"), "unique")


def correct_mapping(profile: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(corrected mapping, changes)``. Only what a rule can settle is changed, and every change says why."""
    target, kind = F.col("target"), F.col("suggested")
    rows = _joined(profile, mapping).filter(F.col("name").isNotNull())
    spelled = F.coalesce(target.rlike(N.TARGET_NAME), F.lit(False))
    based = rows.withColumn("base", F.when(target.isNull(), N.snake_case(F.col("name")))
                            .when(~spelled, N.snake_case(target)).otherwise(target))
    named = with_unique_names(based.select(
        "dataset", "position", "name", "type", "min", "max", "has_time", "target", "suggested", "base"))
    measured = (F.col("type"), F.col("min"), F.col("max"), F.col("has_time"))
    supported = F.coalesce(kind.isin(*Y.TARGET_TYPES), F.lit(False))
    typed = (
        named.withColumn("first_type", F.when(supported, kind).otherwise(Y.inferred_type(*measured)))
        .withColumn("conflict", Y.type_conflict(F.col("type"), F.col("first_type"), *measured[1:]))
        .withColumn("final_type", F.when(F.col("conflict").isNull(), F.col("first_type"))
                    .otherwise(Y.safe_type(F.col("type"), F.col("first_type"), *measured[1:])))
    )
    corrected = typed.select(
        "dataset", "position", F.col("name").alias("source"), F.col("unique").alias("target"),
        F.col("final_type").alias("type"), F.lit(False).alias("legacy"))

    def change(when: Column, seq: int, field: str, old: Column, new: Column, reason: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(seq).alias("seq"), F.lit(field).alias("field"), old.alias("from"), new.alias("to"), reason.alias("reason")))

    unique = F.col("unique")
    sentence = F.concat(F.upper(F.left("conflict", F.lit(1))), F.substr("conflict", F.lit(2)), F.lit("."))
    # The reasons, as they are shown.
    changed = typed.select("dataset", "position", F.col("name").alias("column"), F.explode(F.array_compact(F.array(
        change(target.isNull(), 1, "destino", target, unique, F.lit("A coluna não tinha destino no mapeamento.")),
        change(target.isNotNull() & ~spelled, 1, "destino", target, unique, F.lit("Nome fora de [a-z_][a-z0-9_]*.")),
        change(spelled & (unique != target), 1, "destino", target, unique, F.lit("Destino repetido.")),
        change(~supported, 2, "tipo", kind, F.col("first_type"), F.lit("Tipo ausente ou não suportado; inferido do perfil.")),
        change(F.col("conflict").isNotNull(), 3, "tipo", F.col("first_type"), F.col("final_type"), sentence),
    ))).alias("c")).select("dataset", "position", "column", "c.*")
    none = F.lit(None).cast("string")
    invented = unknown_columns(profile, mapping).select(
        "dataset", F.lit(-1).cast("long").alias("position"), F.col("source").alias("column"), F.lit(0).alias("seq"),
        F.lit("coluna").alias("field"), F.lit("mapeada").alias("from"), none.alias("to"),
        F.lit("A coluna não existe no arquivo.").alias("reason"))
    return corrected, changed.withColumn("position", F.col("position").cast("long")).unionByName(invented)
