"""Quality flags and ratios from column profiles. All inputs hold one row per column or per dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.operators.cells import quoted

# Flag kinds in reporting order, with their titles and what to do about them.
FLAGS = [
    ("column_names", "Nomes de coluna incompatíveis com Delta",
     "Renomeie antes de migrar para Fabric ou Databricks; o plano de migração depende destes nomes."),
    ("duplicate_columns", "Colunas duplicadas (sem diferenciar maiúsculas)", "Delta não diferencia maiúsculas: unifique ou renomeie."),
    ("malformed_rows", "Linhas com número de campos diferente do cabeçalho",
     "Estas linhas foram excluídas dos números acima; trate as métricas como incompletas."),
    ("identical_columns", "Colunas com conteúdo idêntico",
     "Confirme se uma delas é redundante antes de migrar; manter as duas duplica armazenamento e pode divergir."),
    ("mixed_types", "Colunas com tipos misturados", "Defina o tipo de destino manualmente; o tipo inferido é ambíguo."),
    ("ambiguous_dates", "Datas ambíguas (dia/mês ou mês/dia)",
     "Todos os valores são válidos nas duas ordens; o perfil assumiu dia/mês (padrão brasileiro). "
     "Confirme com o dono do dado: um erro aqui troca dia e mês sem gerar nenhuma falha."),
    ("encoding", "Arquivo fora de UTF-8",
     "O código de carga gerado já informa essa codificação. Se puder, exporte em UTF-8 para evitar surpresas."),
    ("mostly_empty", "Colunas majoritariamente vazias", "Confirme se devem migrar; valide a regra de negócio com o dono do dado."),
    ("duplicate_rows", "Linhas duplicadas",
     "A reconciliação de contagem falhará se a origem e o destino tratarem duplicatas de forma diferente."),
]
LISTED = 8
MOSTLY_EMPTY = 0.5


def listed(items: Column, n_items: Column | None = None) -> Column:
    """The first items and how many more there are."""
    total = F.size(items) if n_items is None else n_items
    more = F.concat(F.lit("… e mais "), (total - LISTED).cast("string"))
    return F.when(total > LISTED, F.concat(F.slice(items, 1, LISTED), F.array(more))).otherwise(items)


def in_order(position: str, item: Column) -> Column:
    """Items of a group in position order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), item.alias("i")))), lambda s: s["i"])


def _items(rows: DataFrame, kind: str) -> DataFrame:
    """``(dataset, p, item)`` to the flag of each dataset."""
    return rows.groupBy("dataset").agg(in_order("p", F.col("item")).alias("items")).select(
        "dataset", F.lit(kind).alias("kind"), "items")


def _first_items(rows: DataFrame, kind: str) -> DataFrame:
    """Like ``_items`` for items that grow with the data: only the listed ones are gathered, the rest are counted.
    Spark keeps the first rows of each dataset per task before the shuffle."""
    first = Window.partitionBy("dataset").orderBy("p", "item")
    kept = rows.withColumn("_turn", F.row_number().over(first)).filter(F.col("_turn") <= LISTED)
    shown = kept.groupBy("dataset").agg(in_order("p", F.col("item")).alias("items"))
    counts = rows.groupBy("dataset").agg(F.count("*").alias("n_items"))
    return shown.join(counts, "dataset").select("dataset", F.lit(kind).alias("kind"), "items", "n_items")


def unsafe_names(columns: DataFrame) -> DataFrame:
    bad = columns.filter(N.is_unsafe_name(F.col("name")))
    return bad.select("dataset", F.col("position").alias("p"), F.concat(F.lit("'"), "name", F.lit("'")).alias("item"))


def clashing_names(columns: DataFrame) -> DataFrame:
    groups = columns.groupBy("dataset", F.lower(F.trim("name")).alias("key")).agg(
        F.count("*").alias("n"), F.min("position").alias("p"), in_order("position", F.col("name")).alias("names"))
    return groups.filter("n > 1").select("dataset", "p", F.concat_ws(", ", "names").alias("item"))


def mixed_columns(columns: DataFrame) -> DataFrame:
    return columns.filter("type = 'mixed'").select("dataset", F.col("position").alias("p"), F.col("name").alias("item"))


def ambiguous_dates(columns: DataFrame) -> DataFrame:
    item = F.concat("name", F.lit(" (assumido "), "date_format", F.lit(")"))
    return columns.filter("date_ambiguous").select("dataset", F.col("position").alias("p"), item.alias("item"))


def mostly_empty(columns: DataFrame) -> DataFrame:
    share = F.bround(F.col("null_ratio") * 100, 0).cast("int").cast("string")
    return columns.filter((F.col("rows") > 0) & (F.col("null_ratio") > MOSTLY_EMPTY)).select(
        "dataset", F.col("position").alias("p"), F.concat("name", F.lit(" ("), share, F.lit("% vazia)")).alias("item"))


def identical_columns(df: DataFrame, columns: DataFrame) -> DataFrame:
    """``(dataset, p, item)`` for columns of ``df`` equal in every row.

    The profile's content fingerprint, which looks at values and not at their order, names the candidates. One scan
    adds up a hash of row and value for each, which groups those equal in the same rows; a second one compares each
    with the first of its group, so a hash never decides.
    """
    spark = df.sparkSession
    filled = columns.filter("nulls < rows").select("dataset", "position", "name", "nulls", "fingerprint").collect()
    groups: dict[tuple, list] = {}
    for row in sorted(filled, key=lambda r: r["position"]):
        groups.setdefault((row["fingerprint"], row["nulls"]), []).append(row)
    candidates = [row for g in groups.values() if len(g) > 1 for row in g]
    if not candidates:
        return spark.createDataFrame([], "dataset string, p int, item string")
    from plumbline.functions.values import trimmed

    def cell(row: object) -> Column:
        return trimmed(F.col(quoted(f"c{row['position']}")))

    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    numbered = named.withColumn("_row", F.monotonically_increasing_id())
    ordered = numbered.agg(*[
        F.sum(F.xxhash64("_row", cell(c)).cast("decimal(38,0)")).alias(f"h{i}") for i, c in enumerate(candidates)]).first()
    alike: dict[tuple, list] = {}
    for i, row in enumerate(candidates):
        alike.setdefault((row["fingerprint"], row["nulls"], ordered[i]), []).append(row)
    pairs = [(g[0], other) for g in alike.values() for other in g[1:]]
    if not pairs:
        return spark.createDataFrame([], "dataset string, p int, item string")
    differing = named.agg(*[
        F.count_if(~cell(a).eqNullSafe(cell(b))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)])
    rows = differing.select(F.explode(F.array(*[
        F.struct(F.lit(a["dataset"]).alias("dataset"), F.lit(a["position"]).alias("p"), F.lit(a["name"]).alias("first"),
                 F.lit(b["position"]).alias("q"), F.lit(b["name"]).alias("other"), F.col(f"d{i}").alias("differing"))
        for i, (a, b) in enumerate(pairs)])).alias("pair")).select("pair.*").filter("differing = 0")
    return rows.groupBy("dataset", "p", "first").agg(in_order("q", F.col("other")).alias("others")).select(
        "dataset", "p", F.concat_ws(" = ", F.array("first"), "others").alias("item"))


def flags(columns: DataFrame, totals: DataFrame, identical: DataFrame | None = None,
          malformed: DataFrame | None = None, encodings: DataFrame | None = None) -> DataFrame:
    """``(dataset, ordinal, kind, title, items, n_items, action)``: one row per flag raised, in reporting order.

    ``totals`` carries ``duplicate_rows``. ``malformed`` is ``(dataset, p, item)`` with line numbers, ``encodings``
    is ``(dataset, encoding)``.
    """
    found = [
        _items(unsafe_names(columns), "column_names"),
        _items(clashing_names(columns), "duplicate_columns"),
        _items(mixed_columns(columns), "mixed_types"),
        _items(ambiguous_dates(columns), "ambiguous_dates"),
        _items(mostly_empty(columns), "mostly_empty"),
        totals.filter("duplicate_rows > 0").select(
            "dataset", F.lit("duplicate_rows").alias("kind"),
            F.array(F.concat(F.col("duplicate_rows").cast("string"), F.lit(" linhas idênticas a uma anterior"))).alias("items")),
    ]
    if identical is not None:
        found.append(_items(identical, "identical_columns"))
    if malformed is not None:
        found.append(_first_items(malformed, "malformed_rows"))
    if encodings is not None:
        found.append(encodings.filter("encoding <> 'utf-8'").select(
            "dataset", F.lit("encoding").alias("kind"), F.array("encoding").alias("items")))
    rows = found[0].withColumn("n_items", F.lit(None).cast("long"))
    for other in found[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    ordinal, title, action = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (kind, text, advice) in enumerate(FLAGS):
        ordinal = F.when(F.col("kind") == kind, i).otherwise(ordinal)
        title = F.when(F.col("kind") == kind, text).otherwise(title)
        action = F.when(F.col("kind") == kind, advice).otherwise(action)
    rows = rows.withColumn("n_items", F.coalesce("n_items", F.size("items").cast("long")).cast("int"))
    return rows.select("dataset", ordinal.alias("ordinal"), "kind", title.alias("title"),
                       listed(F.col("items"), F.col("n_items")).alias("items"), "n_items", action.alias("action"))


def quality(columns: DataFrame, totals: DataFrame) -> DataFrame:
    """Five ratios per dataset; 1.0 where there is nothing to measure."""
    by_dataset = columns.groupBy("dataset").agg(
        F.count_if(F.col("type") != "mixed").alias("consistent"),
        F.count_if(~N.is_unsafe_name(F.col("name"))).alias("safe_names"))
    t = totals.join(by_dataset, "dataset")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(1.0))

    read = F.col("rows") + F.col("rows_discarded")
    return t.select(
        "dataset",
        share(F.col("filled_cells"), F.col("total_cells")).alias("completeness"),
        share(F.col("rows") - F.col("duplicate_rows"), F.col("rows")).alias("row_uniqueness"),
        share(F.col("consistent"), F.col("columns")).alias("type_consistency"),
        share(F.col("safe_names"), F.col("columns")).alias("name_compatibility"),
        share(F.col("rows"), read).alias("rows_kept"),
    )


def column_notes(columns: DataFrame) -> DataFrame:
    """One measured observation per column."""
    key = F.when(F.col("is_key_candidate"), "candidata a chave (valores únicos)")
    scale, digits = F.col("max_scale"), F.coalesce("max_int_digits", F.lit(0))
    decimal = F.concat(F.lit("decimal("), (digits + scale).cast("string"), F.lit(","), scale.cast("string"),
                       F.lit(") é o mínimo observado"),
                       F.when(F.col("number_style") == "br", "; vírgula decimal e ponto de milhar").otherwise(""))
    integer = F.concat(F.lit("faixa "), "min", F.lit(" a "), "max")
    date = F.concat(F.lit("de "), "min", F.lit(" a "), "max",
                    F.coalesce(F.concat(F.lit("; formato "), "date_format"), F.lit("")),
                    F.when(F.col("date_ambiguous"), " (ambíguo: dia/mês assumido)").otherwise(""))
    text = F.when(F.col("max_len") > 0, F.concat(F.lit("até "), F.col("max_len").cast("string"), F.lit(" caracteres")))
    measured = (F.when(F.col("type") == "decimal", decimal).when(F.col("type") == "integer", integer)
                .when(F.col("type") == "date", date).when(F.col("type") == "text", text))
    return columns.select("dataset", "position", "name", F.concat_ws("; ", key, measured).alias("note"))
