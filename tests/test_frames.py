"""Rows against schemas: column expressions against the matcher, against DuckDB, and on streams."""

import os

import pytest

from shapewright import NotColumnar, Schema, conforming, error_rows, report, validate
from shapewright.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"

DOCUMENTS = [
    "{}", '{"k":1}', '{"k":1.0}', '{"k":1e2}', '{"k":-5}', '{"k":"x"}', '{"k":null}', '{"k":18446744073709551615}', '{"k":9223372036854775808}', '{"k":99999999999999999999999}', '{"k":[1,"x"]}', '{"k":{"l":2}}',
    '{"k":true,"z":"q"}', '{"k":2,"l":[1,2,3]}', '{"l":[],"k":0}', "[]", "[1,2]", '[1,"x"]', "3", '"text"', "null", "true", "1.5", "", "{", None, '{"k":"2020-01-01T00:00:00Z"}', '{"k":"http://a/b"}', '{"k":"Zm8"}', '{"é":"é"}',
]
SCHEMAS = [
    "a = { ? k: int, * tstr => any }", "a = { ? k: uint }", "a = { k: float }", "a = { k: number, ? l: [* int] }", "a = { k: int / tstr / nil }", "a = { k: [int, tstr] }", "a = { k: { l: 1..3 } }", "a = { ? k: bool, ? z: tstr .size 1 }",
    "a = [* int]", "a = [int, int]", "a = [int, * (int / tstr)]", "a = int / tstr / bool", "a = any", "a = { k: tdate / uri / b64url }", "a = { * tstr => tstr }", "a = { + tstr => int }", "a = 1.0..2.0", "a = { k: -10..10 }",
    'a = { k: tstr .regexp "x" // k: int .ge 1 }', "a = { k: uint .size 1 }", "a = { k: int .ne 1 }", "a = nil", "a = {}", "a = { k: 18446744073709551615 / 1 }", "a = { k: nint }", "a = [2*3 int]",
]


def test_columns_agree_with_matcher(spark):
    df = spark.createDataFrame(list(enumerate(DOCUMENTS)), "i int, doc string").coalesce(1).cache()
    for schema in SCHEMAS:
        a = {r.i: r.valid for r in validate(df, schema, "doc", tier="columns").collect()}
        b = {r.i: r.valid for r in validate(df, schema, "doc", tier="matcher").collect()}
        assert a == b, (schema, [(DOCUMENTS[i], a[i], b[i]) for i in a if a[i] != b[i]])


def test_row_columns_agree_with_matcher(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'x', array(1, 2), named_struct('p', 1.5D, 'q', CAST(NULL AS STRING)), X'00FF'), (-1, '', array(), named_struct('p', CAST(NULL AS DOUBLE), 'q', 'z'), X''), (NULL, NULL, NULL, NULL, NULL) AS t(n, s, l, r, b)")
    for column, schema in [("n", "a = uint"), ("n", "a = -1..0"), ("s", "a = tstr .size 1"), ("s", "a = int"), ("l", "a = [+ int]"), ("r", "a = { p: float, ? q: tstr }"), ("r", "a = { ? p: float, q: tstr }"), ("b", "a = bstr .size 2"), ("b", "a = tstr")]:
        a = [r.valid for r in validate(df, schema, column, format="row", tier="columns").collect()]
        b = [r.valid for r in validate(df, schema, column, format="row", tier="matcher").collect()]
        assert a == b, (column, schema, a, b)
    assert [r.valid for r in validate(df, "a = { n: int, s: tstr }", ["n", "s"], format="row").collect()] == [True, True, False]


def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = oracle_sql()
    for name, f in queries().items():
        df = f(spark, SF)
        rows = sorted(map(str, map(tuple, df.select(*sorted(df.columns)).collect())))
        if name not in sql:
            assert rows
            continue
        names = [d[0] for d in con.execute(sql[name]).description]
        assert sorted(names) == sorted(df.columns), name
        want = sorted(map(str, con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in sorted(names))} FROM ({sql[name]})").fetchall()))
        assert rows == want, name


def test_no_python_or_shuffle_in_columns(spark):
    df = spark.createDataFrame([("{}",)], "doc string")
    plan = validate(df, "a = { ? k: int }", "doc")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_bare_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "n").write.parquet(str(tmp_path / "t"))
    plan = conforming(spark.read.parquet(str(tmp_path / "t")), "a = 2..5", "n", format="row")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,2)" in plan


def test_matcher_only(spark):
    df = spark.createDataFrame([("[1]",)], "doc string")
    with pytest.raises(NotColumnar):
        validate(df, "a = [* a] / int", "doc", tier="columns")
    assert validate(df, "a = [* a] / int", "doc").first().valid


def test_errors_and_report(spark):
    df = spark.createDataFrame([(1, '{"k":1}'), (2, '{"k":"x"}'), (3, "{"), (4, None)], "i int, doc string")
    found = {(r.i, r.location) for r in error_rows(df, "a = { k: int }", "doc").collect()}
    assert found == {(2, "/k"), (3, ""), (4, "")}
    assert sum(r.n for r in report(df, "a = { k: int }", "doc").collect()) == 3
    assert all(r.message.startswith("error validating at ") for r in error_rows(df, "a = { k: int }", "doc").collect())


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc string, errors string")
    assert validate(df, "a = { k: int }", "doc").count() == 0
    assert validate(df.drop("errors"), "a = { k: int }", "doc", errors=True).count() == 0


def test_stream(spark, tmp_path):
    from shapewright.streaming import quarantine, validate_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([('{"k":1}',), ('{"k":"x"}',)], "doc string").write.parquet(source)
    stream = spark.readStream.schema("doc string").parquet(source)
    q = quarantine(validate_stream(stream, "a = { k: int }", "doc"), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_sources(spark, tmp_path):
    from shapewright.sources.readers import cbor_documents, csv_documents, json_documents
    from shapewright.sources.values import Map, to_cbor

    (tmp_path / "a.json").write_text('{"k":\n1}')
    (tmp_path / "a.cbor").write_bytes(to_cbor(Map(((1, "x"),))))
    (tmp_path / "a.csv").write_text('n,v\n"x\ny",2\n')
    assert validate(json_documents(spark, str(tmp_path / "a.json")), "a = { k: int }", "document").first().valid
    assert validate(cbor_documents(spark, str(tmp_path / "a.cbor")), "a = { 1: tstr }", "document", format="cbor").first().valid
    assert validate(csv_documents(spark, str(tmp_path / "a.csv")), "a = [[2*2 tstr], * [tstr, uint]]", "document", format="csv", has_header=True).first().valid


def test_types_read_data(spark):
    schema = Schema.parse("a = { id: int, name: tstr, ? tags: [* tstr], more: { * tstr => float } }")
    df = spark.read.schema(schema.to_struct_type()).json(spark.sparkContext.parallelize(['{"id":1,"name":"x","more":{"y":1.5}}']))
    assert validate(df, schema, df.columns, format="row").first().valid
