"""Both tiers over odd texts: a schema has one answer."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shapewright import DecodeError, NotColumnar, Schema, ValueModel, cbor_text, diagnoses, error_function, error_rows, validate
from shapewright.operators.columns import _END
from shapewright.operators.matcher import Compiler, run
from shapewright.sources.values import Map, csv_records, from_json

TEXTS = [
    '{"k":1}', '{"k":1}x', '{"k":1} ', ' {"k":1}\n', '{"k":1}{"k":1}', '{"k":1},{"k":2}', '{"k":1}]', '{"k":1}}', '{"k":1},"a":2', '[1]x', "[1]]", "1 2", "1,2", "1]", "1}", "1x", "1", "01", "-0", "1.0", "1e3", "1e400", "NaN", "Infinity",
    "nul", "null", "null,", "truefalse", "true", '"a"', '"a"b', '"a" "b"', '"\ud800"', '"\t"', "", " ", "{", "}", "[", "]", "{}", "[]", "{'k':1}", '{"k":1,}', "[1,]", "// c\n1", '{"k":1,"k":2}', '{"k":1,"k":"x"}', '{"k":"x","k":1}', '{"a":{"k":1,"k":"x"}}',
    f'1,"{_END}"', f'"{_END}"', f'{{"k":1}},"{_END}"]', f'"{_END}"]x', '"\\u0001 end of the document \\u0001"', "\ufeff1", "[" * 30 + "]" * 30, '{"k":123456789012345678901234567890}', '{"k":18446744073709551615}', None,
]
SCHEMAS = ["m = any", "m = {* tstr => any}", "m = {k: number}", "m = {k: int}", "m = tstr", "m = [* any]", "m = null / bool", "m = {a: {k: tstr}}", "m = int / float"]


@pytest.mark.parametrize("schema", SCHEMAS)
def test_json_texts(spark, schema):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    columns = {r.i: r.valid for r in validate(df, schema, "t", tier="columns").collect()}
    matcher = {r.i: r.valid for r in validate(df, schema, "t", tier="matcher").collect()}
    assert [(TEXTS[i], v, matcher[i]) for i, v in columns.items() if v != matcher[i]] == []


@pytest.mark.parametrize("expression", ["a.b", "^a$", "a$", "^a.b$", "\\\\w\\\\s", "[.$]b", "\\\\bab?\\\\b", "^\\\\d+$", "a\\\\$"])
@pytest.mark.parametrize("op", [".regexp", ".pcre"])
def test_expressions(spark, expression, op):
    between = ["", "\n", "\r", "\u0085", "\u2028", "x", "$", ".", "é", "\u00a0", "1", "\u0661"]
    texts = [json.dumps(v) for b in between for v in (f"a{b}b", f"a{b}", b, f"{b}b")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    schema = f'm = tstr {op} "{expression}"'
    columns = validate(df, schema, "t", tier="columns").collect()
    matcher = validate(df, schema, "t", tier="matcher").collect()
    assert [(a.t, a.valid) for a, b in zip(columns, matcher, strict=True) if a.valid != b.valid] == []


def test_dot_and_end():
    check = Compiler(Schema.parse('m = tstr .regexp "a.b$"').symbols).root()
    assert [run(check, t)[0] for t in ("a\rb", "a\u2028b", "a\nb", "axb\n")] == [True, True, False, False]


def matches(schema, text):
    return run(Compiler(Schema.parse(schema).symbols).root(), from_json(text))


def test_flat_maps_under_repeated_groups():
    many = json.dumps({f"k{i}": i for i in range(1200)})
    assert matches("m = { * g }\ng = (tstr => int)", many)[0]
    assert not matches("m = { * g }\ng = (tstr => int)", many[:-1] + ', "z": "no"}')[0]
    ok, why = matches("m = { * g }\ng = (* g, a: int)", '{"a":1}')
    assert not ok and any("without progress" in e[0] for e in why)


def test_assignment_against_all_assignments():
    """Single entries with typed keys and tables, against trying every order."""
    from itertools import permutations

    rng = random.Random(3)
    kinds = {"int": lambda v: type(v) is int, "tstr": lambda v: type(v) is str, "(int / tstr)": lambda v: type(v) in (int, str), "bool": lambda v: type(v) is bool}
    for _ in range(300):
        entries = [(rng.random() < 0.3, rng.choice(list(kinds))) for _ in range(rng.randint(2, 4))]
        table = rng.choice([None, "int", "bool"])
        doc = {f"k{i}": rng.choice([1, "x", True]) for i in range(rng.randint(0, 5))}
        schema = "m = {" + ", ".join(f"{'? ' * optional}tstr => {k}" for optional, k in entries) + (f", * tstr => {table}" if table else "") + "}"
        values = list(doc.values())

        def good(order, entries=entries, table=table, values=values):
            left = list(range(len(values)))
            for (optional, k), j in zip(entries, order, strict=True):
                if j is None:
                    if not optional:
                        return False
                elif not kinds[k](values[j]):
                    return False
                else:
                    left.remove(j)
            return all(table and kinds[table](values[j]) for j in left)

        want = any(good(o) for o in set(permutations([*range(len(values)), *[None] * len(entries)], len(entries))))
        assert matches(schema, json.dumps(doc))[0] == want, (schema, doc)


def test_many_single_entries_are_quick():
    import time

    start = time.perf_counter()
    for first in ('"x"', "1"):
        matches("m = {" + ", ".join(["tstr => int"] * 12) + "}", "{" + ", ".join(f'"k{i}": {first if i == 0 else i}' for i in range(12)) + "}")
    assert time.perf_counter() - start < 0.5


def test_join_of_many_texts():
    assert matches('m = tstr .join ["a", tstr, "b", tstr, "c"]', '"axxbyyc"')[0]
    assert not matches('m = tstr .join [tstr, "a", tstr, "a", tstr, "a", tstr, "z"]', json.dumps("a" * 200))[0]


def test_errors_of_failing_rows_alone(spark):
    df = spark.createDataFrame([(1, '{"k":1}'), (2, '{"k":"x"}'), (3, None), (4, '{"k":')], "i int, t string")
    rows = {r.i: r for r in validate(df, "m = {k: int}", "t", errors=True).collect()}
    assert rows[1].valid and rows[1].errors == [] and rows[2].errors[0].location == "/k"
    assert rows[3].errors[0].reason == "no document" and rows[4].errors[0].decode_error == "syntax"
    assert {r.i for r in error_rows(df, "m = {k: int}", "t").collect()} == {2, 3, 4}


def test_error_function(spark):
    spark.udtf.register("wrong", error_function("m = {k: int}"))
    spark.createDataFrame([(1, '{"k":1}'), (2, '{"k":"x"}'), (3, None)], "i int, t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT i, e.location, e.reason FROM texts, LATERAL wrong(t) e").collect()
    assert {(r.i, r.location) for r in got} == {(2, "/k"), (3, "")}


def test_value_model(spark):
    def pairs(text):
        if "=" not in text:
            raise DecodeError("no pairs", "syntax", 0)
        return Map(tuple((k, int(v) if v.isdigit() else v) for k, v in (p.split("=") for p in text.split(";"))))

    model = ValueModel("pairs", pairs, kinds={"uri": lambda v: v == "here"})
    df = spark.createDataFrame([(0, "a=1;b=here"), (1, "a=x;b=here"), (2, "a=1;b=http:x"), (3, "?")], "i int, t string")
    assert {r.i: r.valid for r in validate(df, "m = {a: int, b: uri}", "t", format=model).collect()} == {0: True, 1: False, 2: False, 3: False}
    assert {r.offset for r in error_rows(df, "m = {a: int, b: uri}", "t", format=model).filter("decode_error is not null").collect()} == {0}


def test_csv_forms():
    assert csv_records('a,"b ""c""",\r\n\n"x\ny",1\rz') == [["a", 'b "c"', ""], ["x\ny", "1"], ["z"]]
    assert csv_records('""\n') == [[""]] and csv_records("") == [] and csv_records(",") == [["", ""]]


def test_other_columns_stay_in_the_plan(spark):
    df = spark.range(3).select("id", F.lit('{"k":1}').alias("t"), F.expr("interval 3 months").alias("i"))
    with pytest.raises(NotColumnar):
        validate(df, "m = {k: m} / {k: int}", "t", tier="columns")
    assert validate(df, "m = {k: m} / {k: int}", "t").filter("valid").count() == 3


def test_diagnoses_have_ranges_and_hints(spark):
    df = spark.createDataFrame([(1, "a = { x: tstrr }\nb = int"), (2, "a = int"), (3, None), (4, "a = {x: \nb = [int")], "i int, s string")
    rows = [tuple(r) for r in diagnoses(df, "s").filter("i = 1").select("line", "column", "end_column", "hint").collect()]
    assert rows == [(1, 10, 15, "did you mean tstr?")]
    assert {r.i for r in diagnoses(df, "s").collect()} == {1, 4}


def test_cbor_text(spark):
    texts = ["a1 61:6b 01", "0xA1, 0x61, 0x6B, 0x01", "oWFrAQ==", "oWFrAQ", "o-_", "?!", None]
    got = [r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select(cbor_text("t").alias("b")).collect()]
    assert [None if b is None else bytes(b) for b in got] == [b"\xa1ak\x01"] * 4 + [b"\xa3\xef", None, None]


def test_text_keeps_comments():
    text = "; about a\na = { x: int, ; the x\n y: tstr }\nb = \"; no\" ; yes\n\n; last\n"
    out = Schema.parse(text, check_refs=False).to_text()
    assert out.splitlines()[:2] == ["; about a", "; the x"] and out.splitlines()[3].endswith("; yes") and out.splitlines()[-1] == "; last"
    assert Schema.parse(out).to_text() == out and ";" not in Schema.parse(text).to_text(comments=False).replace("; no", "")


def test_values_of_choices_as_metadata():
    kind = Schema.parse('a = { s: "x" / "y", n: int, ? e: &(one: 1, two: 2) }').to_struct_type()
    assert kind["s"].metadata == {"values": ["x", "y"]} and kind["n"].metadata == {} and kind["e"].metadata.get("values", [1, 2]) == [1, 2]
