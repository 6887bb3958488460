"""No document stops a job, whatever it holds, and both tiers give it one answer."""

import random

import pytest

from shapewright import DecodeError, Schema, validate
from shapewright.operators.matcher import Compiler, run
from shapewright.sources.values import NESTED, coerced, from_cbor, from_json

LONG = ["9" * 25, "9" * 310, "9" * 5000, "-" + "1" * 400, "1e400", "1e308", "0." + "1" * 500, "1E+0999", '"' + "1" * 400 + '"', '"\\ud800"', '"\\udc00\\ud800"', '"\\ud83d\\ude00"', '"\\\\ud800"', '"\\ud800\\\\\\udc00"', '{"\\ud800":1}', '{"a":"1e999"}', '{"a":1e999}', "[" * 260 + "]" * 260]


@pytest.mark.parametrize("schema", ["m = any", "m = number", "m = tstr .size (0..400)", "m = {* tstr => any}", "m = tstr / int / float"])
def test_odd_json_in_both_tiers(spark, schema):
    df = spark.createDataFrame(list(enumerate(LONG)), "i int, t string")
    columns = {r.i: r.valid for r in validate(df, schema, "t", tier="columns").collect()}
    matcher = {r.i: r.valid for r in validate(df, schema, "t", tier="matcher").collect()}
    assert [(LONG[i][:30], v, matcher[i]) for i, v in columns.items() if v != matcher[i]] == []


def test_one_limit_of_depth(spark):
    texts = ["[" * n + "]" * n for n in (NESTED, NESTED + 1)] + ['{"a":' * n + "1" + "}" * n for n in (NESTED, NESTED + 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for schema, tier in (("m = any", "columns"), ("m = any", "matcher"), ("m = [* m] / {a: m} / int", "matcher")):
        assert [r.valid for r in validate(df, schema, "t", tier=tier).orderBy("i").collect()] == [True, False] * 2
    items = spark.createDataFrame([(n, bytearray(b"\x81" * n + b"\x01")) for n in (NESTED, NESTED + 1, 100_000)], "n int, b binary")
    assert [r.valid for r in validate(items, "m = [m] / int", "b", format="cbor").orderBy("n").collect()] == [True, False, False]


def test_long_numbers_and_chunks():
    assert [coerced(x) for x in ("+007", "-0", "18446744073709551615", "-9223372036854775808", "1.5", "0" * 40 + "12")] == [7, 0, 18446744073709551615, -(1 << 63), 1.5, 12]
    assert coerced("9" * 5000) == "9" * 5000 and type(coerced("9" * 30)) is float
    base10 = Compiler(Schema.parse("m = tstr .base10 (1..5)").symbols).root()
    assert not run(base10, "7" * 9000)[0] and run(Compiler(Schema.parse("m = tstr .base10 uint").symbols).root(), "7" * 9000)[0]
    for bad in ("5f5f4101ffff", "7f7f6161ffff"):
        with pytest.raises(DecodeError):
            from_cbor(bytes.fromhex(bad))
    assert from_cbor(bytes.fromhex("5f41014102ff")) == b"\x01\x02"
    with pytest.raises(DecodeError):
        from_json("1" * 400)


def test_random_bytes_and_texts(spark):
    rng = random.Random(4)
    pieces = ["{", "}", "[", "]", '"', ":", ",", "1", "9" * 30, "e9", "\\", "u", "d8", "\\ud8", "null", "a", "-", ".", " ", "\n", "é", ";"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    blobs = [bytearray(rng.randbytes(rng.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame(list(zip(range(400), texts, blobs, strict=True)), "i int, t string, b binary")
    schema = 'm = { * tstr => any } / [* m] / tstr .size (1..3) / tstr .json m / tstr .base10 uint / int .gt 3 / bstr .cbor m / tstr .regexp "[0-9]"'
    for on, format in (("t", "json"), ("b", "cbor"), ("t", "csv"), ("t", "row"), ("b", "row")):
        assert validate(df, schema, on, format=format, errors=True).filter("not valid and size(errors) = 0").count() == 0


def test_rows_have_one_answer(spark):
    df = spark.sql(
        "SELECT int(id) AS i, if(id = 0, double('NaN'), 2.0D) AS x, map_filter(map('a', 1), (k, v) -> id = 1) AS m, timestamp'2024-01-01 00:00:00' AS at, if(id = 1, 'x', null) AS s FROM range(2)"
    )
    cases = [("n = float .gt 1.0", "x"), ("n = float .ge 1.0", "x"), ("n = float .lt 1.0", "x"), ("n = { * tstr => int }", "m"), ("n = {}", "m"), ("n = tdate", "at"), ("n = tstr", "at"), ("n = any", "at"), ("n = nil", "s"), ("n = nil / tstr", "s")]
    for schema, on in cases:
        columns = [r.valid for r in validate(df, schema, on, format="row", tier="columns").orderBy("i").collect()]
        assert columns == [r.valid for r in validate(df, schema, on, format="row", tier="matcher").orderBy("i").collect()], (schema, on)
