"""Work that must not land in one task, or be done again for equal values."""

import pyarrow as pa
import pytest

from shapewright import Schema, lints, struct_types, validate
from shapewright.catalog import queries
from shapewright.operators.conformance import _distinct
from shapewright.plans.analysis import names_in

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["types", "lint", "samples", "recursive_deep", "recursive_json", "cbor_map", "map_closed_matcher", "csv_records"])
def test_rows_of_one_file_are_many_tasks(spark, name):
    assert queries()[name](spark, SF).rdd.getNumPartitions() == 4


def test_equal_texts_are_parsed_once():
    some, which = _distinct(pa.array(["a", None, "b", "a", "a", None]))
    assert some.to_pylist() == ["a", "b"] and which.to_pylist() == [0, None, 1, 0, 0, None]
    assert _distinct(pa.array(["a", "b", "c"]))[1] is None and _distinct(pa.array([1.0, 1.0, 1.0]))[1] is None


def test_types_of_equal_and_odd_texts(spark):
    texts = ["a = int", None, "b = tstr", "a = int", "a = [", None, "a = int", "b = tstr"] * 3
    rows = struct_types(spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1), "s").collect()
    want = [(i, "a", "bigint") if s == "a = int" else (i, "b", "string") for i, s in enumerate(texts) if s in ("a = int", "b = tstr")]
    assert [(r.i, r.rule, r.type) for r in rows] == want


def test_lints_of_equal_texts(spark):
    long = "a = [" + "\n; x\n1," * 20_000 + "\n]"
    rows = lints(spark.createDataFrame([(i, long) for i in range(20)], "i int, s string").coalesce(1), "s").collect()
    assert [(r.i, r.message) for r in rows] == [(i, "line 40001: a comma before the closing bracket") for i in range(20)]


def test_walks_take_no_frames():
    body = Schema.parse("a = " + "[" * 60 + "b" + "]" * 60 + "\nb = { x: c, y: d }\nc = int\nd = tstr").rules
    assert [n for r in body for n in names_in(r.body)] == ["b", "c", "d", "int", "tstr"]


def test_equal_documents_are_matched_once(spark):
    docs = ["[[]]", None, "[1]", "{", "[[]]", "[[],[]]", None, "[[]]"] * 3
    for errors in (False, True):
        rows = validate(spark.createDataFrame(list(enumerate(docs)), "i int, d string").coalesce(1), "n = [* n]", "d", tier="matcher", errors=errors).collect()
        assert [r.valid for r in rows] == [d is not None and d not in ("[1]", "{") for d in docs]
        if errors:
            assert [r.errors[0].reason for r in rows[1:4]] == ["no document", "expected an array, got 1", "decode: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)"]
            assert all(a.errors == b.errors for a, b in zip(rows, rows[8:], strict=False))


def test_deep_and_short_arrays():
    for text, doc, good, why in [
        ("n = [2*3 int]", [1], False, "an item is missing"),
        ("n = [2*3 int]", [1, 2, 3, 4], False, "item 3 isn't expected"),
        ("n = [2*3 int]", [1, "x"], False, "expected int, got 'x'"),
        ("n = [3*2 int]", [1, 2], False, "the array's items don't match"),
        ("n = [+ int]", [], False, "an item is missing"),
        ("n = [* n]", [[[], [[]]], []], True, None),
        ("n = m / [* n]\nm = n", [[]], True, None),
        ("n = m\nm = n", [], False, "n refers to itself without progress"),
    ]:
        ok, errors = Schema.parse(text).compiled()(doc)
        assert ok == good and (ok or why in [e[0] for e in errors]), (text, errors)


def test_maps_of_named_keys_tell_what_the_general_way_tells(monkeypatch):
    from shapewright.operators import matcher
    from shapewright.sources.values import Map

    docs = [Map(p) for p in [(), (("k", 1),), (("k", "x"),), (("k", 1), ("l", 2)), (("k", 1), ("l", "x")), (("l", 1),), (("k", 1), ("z", 2), (3, 4)), (("k", 1), ("k", 2)), (("k", 1), ([], 2)), (("m", Map((("k", "x"),))), ("k", 1))]]
    schemas = ["a = { k: int, ? l: int }", "a = { k: int, ? \"l\" => int }", 'a = { ? "k" => int, ? "l" => tstr, ? "m" => a }', "a = { k: int, ? m: a, ? l: tstr / bool }", "a = { ? k: int, ? k: tstr }"]
    found = [[Schema.parse(s).compiled("cbor")(d) for d in docs] for s in schemas]
    monkeypatch.setattr(matcher, "_named", lambda arm: [])
    assert found == [[Schema.parse(s).compiled("cbor")(d) for d in docs] for s in schemas]


def test_samples_of_one_sampler(spark):
    from shapewright import sampled

    text = "y = pair<int, tstr> / { g, ? p: ~v, * tstr => y }\npair<A, B> = [A, B, ? pair<B, A>]\ng = ( h: int // i: float )\nv = #6.1(number)"
    schema = Schema.parse(text)
    draw = schema.sampler()
    made = [draw(2, seed) for seed in range(100)]
    assert [[t for _, t in m] for m in made] == [schema.sample_json(2, seed) for seed in range(100)] and all(len(m) == 2 for m in made)
    assert len({t for m in made for _, t in m}) > 100
    none = sampled(spark.range(3), "a = tstr .regexp \"[0-9]{9}\"", "id")  # no draw gives one: null, and no error
    assert [r["sample"] for r in none.collect()] == [None] * 3
