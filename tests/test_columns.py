"""Arrays of groups and errors in columns, against the matcher over random schemas and documents."""

import json
import random

import pytest

from shapewright import NotColumnar, dangling, error_rows, report, validate

OCCURRENCES = ["", "", "", "? ", "* ", "+ ", "2*3 ", "*2 ", "1*1 "]
KINDS = ["int", "tstr", "1", "0..1", '"x"', "bool", "any", "(int / tstr)"]


def random_group(rng, depth):
    def entry():
        part = rng.choice(KINDS) if depth == 0 or rng.random() < 0.6 else f"({random_choice(rng, depth - 1)})" if rng.random() < 0.8 else rng.choice("gh")
        return rng.choice(OCCURRENCES) + part

    return ", ".join(entry() for _ in range(rng.randint(1, 3)))


def random_choice(rng, depth):
    return " // ".join(random_group(rng, depth) for _ in range(rng.choice([1, 1, 2])))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_in_arrays(spark, seed):
    rng = random.Random(seed)
    docs = ["[" + ",".join(rng.choice(["1", "0", "2", '"x"', '"y"', "true", "[]"]) for _ in range(rng.randint(0, 6))) + "]" for _ in range(200)] + ["{}", "1", "[", None]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string").coalesce(1).cache()
    for _ in range(8):
        schema = f"m = [{random_choice(rng, 2)}]\ng = (int, ? tstr)\nh = (+ 0..1 // tstr, bool)"
        columns = {r.i: r.valid for r in validate(df, schema, "t", tier="columns").collect()}
        matcher = {r.i: r.valid for r in validate(df, schema, "t", tier="matcher").collect()}
        assert [docs[i] for i in columns if columns[i] != matcher[i]] == [], schema


SCALARS = ["int", "tstr", "float", "bool", "nil", "number", "0..5", "1.5", '"x"', "uint .lt 4", "tstr .size (1..3)", 'tstr .regexp "^[a-m]"', "&(p: 1, q: 2)", "any", "u", "(int .gt 1) .and (int .lt 9)"]


def random_type(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.45:
        return rng.choice(SCALARS)
    if kind < 0.6:
        return f"{random_type(rng, depth - 1)} / {random_type(rng, depth - 1)}"
    if kind < 0.8:
        return random_map(rng, depth)
    entries = [rng.choice(["", "", "2*2 "]) + f"({random_type(rng, depth - 1)})" for _ in range(rng.randint(0, 2))]
    if rng.random() < 0.6:
        entries.append(rng.choice(["* ", "+ ", "? ", "*3 ", "2*4 "]) + f"({random_type(rng, depth - 1)})")
    return "[" + ", ".join(entries) + "]"


def random_map(rng, depth):
    entries = [rng.choice(["", "? "]) + f"{key}: {random_type(rng, depth - 1)}" for key in rng.sample("abc", rng.randint(0, 3))]
    if rng.random() < 0.4:
        entries.append(rng.choice(["* tstr => ", "+ tstr => ", "2* tstr => ", "* tstr ^ => "]) + f"({random_type(rng, depth - 1)})")
    return "{" + ", ".join(entries) + "}"


def random_value(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.4:
        return rng.choice([0, 1, 2, 7, -3, 1.5, 2.25, 1e20, 0.1234567, "x", "abc", "zebra", "it's " + "y" * 70, True, None, "é", "", 12345678901234567890123])
    if kind < 0.75:
        return {rng.choice("abcde"): random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def test_errors_in_columns(spark):
    rng = random.Random(3)
    docs = [json.dumps(random_value(rng, 3), ensure_ascii=False) for _ in range(200)] + [None, "{", "1.50", "-0.0", "1e-9", "-0.0000001"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string").coalesce(1).cache()
    plain = lambda r: [tuple(e)[:7] for e in r.errors if not e.decode_error]
    for _ in range(10):
        schema = f"m = {random_map(rng, 2) if rng.random() < 0.6 else random_type(rng, 2)}\nu = {{? a: int, * tstr => any}} / [* v]\nv = int / tstr"
        columns = {r.i: r for r in validate(df, schema, "t", tier="columns", errors=True).collect()}
        matcher = {r.i: r for r in validate(df, schema, "t", tier="matcher", errors=True).collect()}
        assert [docs[i] for i in columns if columns[i].valid != matcher[i].valid or plain(columns[i]) != plain(matcher[i])] == [], schema
        assert columns[len(docs) - 6].errors[0].reason == "no document" and columns[len(docs) - 5].errors[0].decode_error == "syntax"


def test_errors_need_no_python(spark):
    df = spark.createDataFrame([('{"k":"x","z":1}',), ('{"k":1}',), (None,), ("{",)], "t string")
    schema = "m = {k: int, ? a: [* {b: 0..3}]}"
    for made in (error_rows(df, schema, "t"), report(df, schema, "t")):
        assert "Python" not in made._jdf.queryExecution().executedPlan().toString() and "ArrowEval" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.rule, r.reason, r.n) for r in report(df, schema, "t").collect()} == {("m", "expected int, got 'x'", 1), ("", "no document", 1), ("", "decode: not a JSON document", 1)}
    detailed = {r.reason: r.offset for r in error_rows(df, schema, "t", details=True).collect()}
    assert any(r.startswith("decode: ") and o == 1 for r, o in detailed.items())
    with pytest.raises(NotColumnar):
        validate(df, "m = {* g}\ng = (k: int)", "t", tier="columns", errors=True)


def test_columns_of_own_names_stay(spark):
    df = spark.createDataFrame([('{"k":1}', 5, 6), ('{"k":"x"}', 7, 8)], "t string, _parsed int, _good int")
    for made in (validate(df, "m = {k: int}", "t"), validate(df, "m = {k: int}", "t", errors=True), error_rows(df, "m = {k: int}", "t")):
        assert {"_parsed", "_good"} <= set(made.columns) and {(r._parsed, r._good) for r in made.collect()} <= {(5, 6), (7, 8)}
    assert [r.valid for r in validate(df, "m = {k: int}", "t").orderBy("_parsed").collect()] == [True, False]
    found = dangling(df.withColumnRenamed("_good", "_ref"), "d = {k: ref-x}\nref-x = any", "t", {"x": (spark.range(1), "id")}).collect()
    assert {(r._parsed, r._ref, r.value) for r in found} == {(5, 6, "1"), (7, 8, "x")}
