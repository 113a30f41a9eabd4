import hashlib
import json

import pytest

from pyspark.sql import functions as F

from plumbline.operators import evidence as E
from plumbline.sources import catalogs as C
from plumbline.sources import delimited as D


def test_file_facts(spark, tmp_path):
    contents = {"a.csv": "a,b\n1,é\n".encode(), "b.csv": "a;b\n1;é\n".encode("cp1252"), "c.csv": b"a\n\x81\n", "d.csv": b"\xff\xfea\x00", "e.csv": b"a\n\x00\n"}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    facts = {r["path"].rsplit("/", 1)[1]: r for r in D.file_facts(spark, str(tmp_path)).collect()}
    assert {n: r["encoding"] for n, r in facts.items()} == {"a.csv": "utf-8", "b.csv": "windows-1252", "c.csv": "latin-1", "d.csv": None, "e.csv": None}
    assert all(facts[n]["sha256"] == hashlib.sha256(raw).hexdigest() for n, raw in contents.items())


def test_delimiters(spark, tmp_path):
    for mark in D.DELIMITERS:
        path = tmp_path / f"f{ord(mark)}.csv"
        path.write_text(mark.join(["x", "y,z" if mark != "," else "y", "w"]) + "\n" + mark.join(["1", "2", "3"]) + "\n")
        assert D.layout(spark, str(path)).delimiter == mark
    single = tmp_path / "one.csv"
    single.write_text("only\n1\n2\n")
    assert D.layout(spark, str(single)).delimiter == ","


def test_header_order_names_and_quotes_survive(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,ID,"a ""b"""\n1,2,"x,""y"""\n\n3,4,\n')
    found = D.layout(spark, str(path))
    assert found.header == ("id", "ID", 'a "b"')
    good, bad = D.split_malformed(D.read_delimited(spark, str(path), found), found)
    assert {tuple(r) for r in good.collect()} == {("1", "2", 'x,"y"'), ("3", "4", None)} and bad.count() == 0


def test_malformed_rows_do_not_leak_into_narrow_reads(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    found = D.layout(spark, str(path))
    good, bad = D.split_malformed(D.read_delimited(spark, str(path), found), found)
    assert [r["c0"] for r in good.select("c0").collect()] == ["1"]
    assert sorted(r["line"] for r in bad.collect()) == ["4,5", "6,7,8,9"]
    assert [r["line"] for r in D.malformed_lines(spark, str(path), found).orderBy("line").collect()] == [3, 4]


def test_records_hold_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "r.csv"
    long = "x" * 60_000 + '""' * 5_000
    path.write_text('id,text,n\n1,"two\nlines",1\n2,plain 5" pipe,2\n3,"a ""b""\n\n,""",3\n4,"' + long + '",4\n5,x\n6,"q\n",6,7\n7,"",8\n', encoding="utf-8")
    found = D.layout(spark, str(path))
    assert found.line_breaks and found.header == ("id", "text", "n")
    good, bad = D.split_malformed(D.read_delimited(spark, str(path), found), found)
    assert {r["c0"]: (r["c1"], r["c2"]) for r in good.collect()} == {
        "1": ("two\nlines", "1"), "2": ('plain 5" pipe', "2"), "3": ('a "b"\n\n,"', "3"), "4": ("x" * 60_000 + '"' * 5_000, "4"), "7": (None, "8")}
    assert sorted(r["line"] for r in bad.collect()) == ["5,x", '6,"q\n",6,7']
    assert {r["line"]: r["text"] for r in D.malformed_lines(spark, str(path), found).collect()} == {9: "5,x", 10: '6,"q\n",6,7'}
    assert D.to_parquet(spark, {"t": str(path)}, str(tmp_path / "out")).select("rows", "discarded").first() == (5, 2)


def test_records_in_many_byte_ranges(spark, tmp_path):
    import csv
    import random

    rng = random.Random(4)
    rows = [(str(i), "".join(rng.choice('a"\n,;b é') for _ in range(rng.randint(1, 40))) + ".") for i in range(3000)]
    path = tmp_path / "m.csv"
    with path.open("w", encoding="utf-8", newline="") as file:
        csv.writer(file, lineterminator="\n").writerows([("k", "v"), *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = D.layout(spark, str(path))
        good, bad = D.split_malformed(D.read_delimited(spark, str(path), found), found)
        assert good.rdd.getNumPartitions() > 1 and bad.count() == 0
        assert sorted(tuple(r) for r in good.collect()) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_headers_are_read_whole(spark, tmp_path):
    names = [f"column_number_{i}" for i in range(2000)]
    path = tmp_path / "w.csv"
    path.write_text(",".join(names) + "\n" + ",".join(map(str, range(2000))) + "\n")
    found = D.layout(spark, str(path))
    assert found.header == tuple(names)
    good, bad = D.split_malformed(D.read_delimited(spark, str(path), found), found)
    assert good.count() == 1 and bad.count() == 0


def test_malformed_text_is_decoded(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_bytes("a,b\né,2\nção,2,3\n".encode("cp1252"))
    found = D.layout(spark, str(path))
    assert [r["text"] for r in D.malformed_lines(spark, str(path), found).collect()] == ["ção,2,3"]


CATALOG = {"databases": [{"name": "sales", "tables": [
    {"table_name": "customers", "row_count": 2500000, "storage_size_gb": 15.3, "partitions": ["dt"], "columns": [{"name": "id", "type": "bigint", "nullable": False}]},
    {"table_name": "orders", "row_count": 15000000, "storage_size_gb": 85.7, "columns": [{"name": "id", "type": "map", "nullable": True}]}]},
    {"name": "wh", "schemas": [{"name": "public", "tables": [{"name": "t", "row_count": 5, "bytes": 1073741824, "columns": []}]}]}]}
TARGET = {"fabric_schema": {"workspaces": [{"lakehouses": [{"tables": [
    {"name": "customers", "properties": {"original_row_count": 2500000}, "schema": {"columns": [{"name": "id", "type": "bigint", "nullable": False}]}},
    {"name": "orders", "properties": {"original_row_count": 14000000}, "schema": {"columns": [{"name": "ID", "type": "nvarchar(max)", "nullable": False}]}}]}]}]}}


def test_catalogs_flatten_and_compare(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CATALOG, indent=1))
    (tmp_path / "t.json").write_text(json.dumps(TARGET))
    tables, columns = C.read_source_catalog(spark, str(tmp_path / "c.json"))
    assert {(r["database"], r["schema"], r["table_name"], r["size_gb"]) for r in tables.collect()} == {
        ("sales", None, "customers", 15.3), ("sales", None, "orders", 85.7), ("wh", "public", "t", 1.0)}
    target, target_columns = C.flatten_target(spark.read.schema(C.TARGET_SCHEMA).json(str(tmp_path / "t.json")))
    source = tables.filter("database = 'sales'")
    check = E.row_count_check(source, target).first()
    assert (check["status"], check["tables_failed"]) == ("failed", 1)
    drift = {(r["table_name"], r["column"], r["side"]) for r in E.schema_drift(columns, target_columns).collect()}
    assert drift == {("orders", "id", "source"), ("orders", "ID", "target")}
    capacity = E.capacity(source).first()
    assert (capacity["total_tables"], capacity["estimated_cu"], capacity["monthly_cost_usd"]) == (2, 4, 2400)
    assert [r["risk_id"] for r in E.risks(source).collect()] == ["R001", "R002", "R003"]


def test_tables_are_told_apart_by_database(spark):
    tables = spark.createDataFrame([("a", "t", 1, ["k"]), ("b", "t", 2, None), ("b", None, 3, None)],
                                   "database string, table_name string, row_count long, foreign_keys array<string>")
    assert tuple(E.row_count_check(tables, tables).first()) == (6, 6, 0, "passed")
    assert E.foreign_key_drift(tables, tables).count() == 0
    bare = tables.drop("database")
    assert {r["table_name"]: r["status"] for r in E.table_row_counts(tables, bare).collect()} == {"t": "ambiguous", None: "passed"}
    columns = spark.createDataFrame([("a", "t", "c", True), ("b", "t", "c", False), ("b", "t", "d", None)],
                                    "database string, table_name string, column string, nullable boolean")
    other = spark.createDataFrame([("a", "t", "c", True), ("b", "t", "c", None), ("b", "t", "e", None)],
                                  "database string, table_name string, column string, nullable boolean")
    assert E.schema_drift(columns, columns).count() == 0 and E.nullability_drift(columns, columns).count() == 0
    assert [tuple(r) for r in E.nullability_drift(columns, other).collect()] == [("b", "t", "c", False, None)]
    assert {(r["column"], r["side"]) for r in E.schema_drift(columns, other).collect()} == {("d", "source"), ("e", "target")}


def test_csv_presence(spark, tmp_path):
    (tmp_path / "sales").mkdir()
    (tmp_path / "sales" / "customers.csv").write_text("id\n1\n")
    tables = spark.createDataFrame([("sales", "customers"), ("sales", "orders")], "database string, table_name string")
    assert {r["table_name"]: r["found"] for r in C.csv_presence(tables, str(tmp_path)).collect()} == {"customers": True, "orders": False}


def test_audit_entries_are_appended(spark, tmp_path):
    mapping = spark.createDataFrame([("d", "b", "y", "int"), ("d", "a", "x", "int")], "dataset string, source string, target string, type string")
    path = str(tmp_path / "audit")
    for _ in range(2):
        C.append_audit(C.mapping_digest(mapping, ["dataset"]), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 2 and rows.select("sha256").distinct().count() == 1


def test_text_copy_is_compared(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("a"))
    assert D.text_to_parquet(df, str(tmp_path / "copy")).first()["status"] == "passed"


def test_text_table_is_replaced_by_a_columnar_one(spark):
    spark.sql("DROP TABLE IF EXISTS notes")
    spark.createDataFrame([("1", "á"), ("2", None)], "id string, v string").write.format("csv").saveAsTable("notes")
    assert D.convert_text_table(spark, "notes").first()["status"] == "passed"
    assert spark.sql("DESCRIBE EXTENDED notes").filter("col_name = 'Provider'").first()["data_type"].lower() == "parquet"
    assert spark.table("notes").count() == spark.table("notes_text_backup").count() == 2
    with pytest.raises(ValueError):
        D.convert_text_table(spark, "notes")
    for name in ("notes", "notes_text_backup"):
        spark.sql(f"DROP TABLE {name}")


def test_a_record_that_is_never_closed_is_malformed_line_by_line(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text('a,b,c\n1,"x\ny",2\n3,4,5\n6,"open\n7,8,9\n' + "10,11,12\n" * 500, encoding="utf-8")
    found = D.layout(spark, str(path))
    good, bad = D.split_malformed(D.read_delimited(spark, str(path), found), found)
    assert sorted(tuple(r) for r in good.collect()) == [("1", "x\ny", "2"), ("3", "4", "5")] and bad.count() == 502
    lines = D.malformed_lines(spark, str(path), found)
    assert lines.agg(F.min("line"), F.max("line"), F.count("*")).first()[:] == (5, 506, 502)


def test_a_header_that_is_never_closed_is_refused_without_being_read_whole(spark, tmp_path):
    path = tmp_path / "head.csv"
    path.write_text('a,"b\n' + "1,2\n" * 3000, encoding="utf-8")
    with pytest.raises(D.UnreadableFile, match="never closed"):
        D.layout(spark, str(path))


def test_a_header_over_many_lines(spark, tmp_path):
    path = tmp_path / "long.csv"
    name = "\n".join(f"part {i}" for i in range(200))
    path.write_text(f'a,"{name}"\n1,2\n', encoding="utf-8")
    found = D.layout(spark, str(path))
    assert found.header == ("a", name)
    good, bad = D.split_malformed(D.read_delimited(spark, str(path), found), found)
    assert [tuple(r) for r in good.collect()] == [("1", "2")] and bad.count() == 0


@pytest.mark.parametrize("header, names", [(("a", "A", "b"), ["a", "A_2", "b"]), (("a", "A", "a_2", ""), ["a", "A_3", "a_2", "column_4"]), (("x", "x", "X"), ["x", "x_2", "X_3"])])
def test_copies_have_names_of_their_own(spark, tmp_path, header, names):
    assert D.column_names(header) == names
    path = tmp_path / "names.csv"
    path.write_text(",".join(header) + "\n" + ",".join("1" for _ in header) + "\n" + ",".join("2" for _ in header) + ",3\n", encoding="utf-8")
    row = D.to_parquet(spark, {"t": str(path)}, str(tmp_path / "out")).first()
    assert (row.rows, row.discarded) == (1, 1) and spark.read.parquet(row.path).columns == names
    assert [r.line for r in spark.read.parquet(row.path + "_discarded").collect()] == [",".join("2" for _ in header) + ",3"]


def test_the_delimiter_is_looked_for_in_the_whole_sample(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_text("a;b\n" + "x,y\n" * 210 + "1;2\n" * 2000, encoding="utf-8")
    assert D.layout(spark, str(path)).delimiter == ";"


@pytest.mark.parametrize("content", [b"\n", b"abc", b"abc\n", b"a\r\nb\n\nc", b"\xef\xbb\xbfa;b\n1;2\n", b"\xef\xbb\xbfa", b"\xff\xfe\x00\n\x81", "é ü\n".encode("latin-1", "replace")])
def test_files_are_hashed_line_by_line(spark, tmp_path, content):
    (tmp_path / "f.csv").write_bytes(content)
    (tmp_path / "empty.csv").touch()
    r, = D.file_digests(spark, str(tmp_path)).collect()
    assert (r.bytes, r.sha256) == (len(content), hashlib.sha256(content).hexdigest()) and r.path.endswith("/f.csv")


def test_a_file_of_many_byte_ranges_is_hashed_as_one(spark, tmp_path):
    lines = "".join(f"{i};{'x' * (i % 90)}\n" for i in range(60_000)).encode()
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_bytes(lines + name.encode())
    ranges, limit = "spark.sql.files.maxPartitionBytes", "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(ranges, str(len(lines) // 7))
    spark.conf.set(limit, "1000")
    try:
        found = {r.path[-5:]: r.sha256 for r in D.file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(ranges)
        spark.conf.unset(limit)
    assert found == {f"{n}.csv": hashlib.sha256(lines + n.encode()).hexdigest() for n in ("a", "b")}


def test_an_exported_mapping_reads_back(spark, tmp_path):
    rows = spark.createDataFrame([('a "b"', "=x", "int", False), ("c,d", None, "int", True)], "source string, target string, type string, legacy boolean")
    D.write_mapping(rows, F.lit("pending"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert sorted(set(text.splitlines())) == ['"a ""b""","\'=x","int","pending"', '"c,d","","","pending"', '"source_column","target_column","type","decision"']


def test_one_file_is_written_from_ranges_in_order_without_sorting(spark, tmp_path, capsys):
    from plumbline.session import kept_in_order

    rows = kept_in_order(spark.range(1000).selectExpr("cast(999 - id as string) AS value", "999 - id AS n").repartitionByRange(7, "n").sortWithinPartitions("n").drop("n"))
    assert rows.rdd.getNumPartitions() > 1
    one = rows.coalesce(1)
    one.explain()
    assert "Sort" not in capsys.readouterr().out
    one.write.text(str(tmp_path / "one"))
    files = list((tmp_path / "one").glob("part-*"))
    assert len(files) == 1 and files[0].read_text().split() == [str(i) for i in range(1000)]
