"""Accept and reject vectors for each operator of the schema language, on the matcher."""

import pytest

from shapewright.operators.matcher import Compiler, run
from shapewright.plans.analysis import SchemaError, Symbols
from shapewright.plans.syntax import SchemaSyntaxError, parse, text_of
from shapewright.schema import Schema
from shapewright.sources.values import UNDEFINED, DecodeError, Map, Simple, Tag, cbor_from_text, from_cbor, from_csv, from_json, to_cbor


def json_ok(schema, doc, features=None):
    return run(Compiler(Symbols(parse(schema)), "json", features).root(), from_json(doc))[0]


def cbor_ok(schema, value):
    return run(Compiler(Symbols(parse(schema)), "cbor").root(), value)[0]


JSON = [
    # kinds
    ("a = uint", ["0", "18446744073709551615"], ["-1", "1.0", '"1"', "true"]),
    ("a = int", ["-5", "5"], ["1.0", "18446744073709551615", "null"]),
    ("a = nint", ["-1"], ["0", "1"]),
    ("a = float", ["1.0", "1e2"], ["1", '"1"']),
    ("a = number", ["1", "1.5"], ['"1"']),
    ("a = tstr", ['"x"', '""'], ["1", "null"]),
    ("a = bool", ["true", "false"], ["0", "null"]),
    ("a = true", ["true"], ["false"]),
    ("a = nil", ["null"], ["false", "0"]),
    ("a = any", ["null", "{}", "[1]"], []),
    ("a = bstr", [], ['"x"']),
    ("a = tdate", ['"2020-02-29T23:59:60Z"', '"2020-01-02T03:04:05.5+01:00"'], ['"2020"', '"2021-02-29T00:00:00Z"', '"2020-01-01T25:00:00Z"', "1"]),
    ("a = time", ["0", "1.5"], ['"x"']),
    ("a = uri", ['"http://example.org/a?b#c"', '"urn:x:y"'], ['"no scheme"', '"1a:b"']),
    ("a = b64url", ['"Zm8"', '""'], ['"Zm9-x"', '"Z"', '"Zm+v"']),
    ("a = biguint", [], ["1"]),
    # literals and choices
    ('a = 1 / "x" / 1.5', ["1", '"x"', "1.5"], ["2", '"y"', "1.0"]),
    ("a = b\nb = 1\nb /= 2", ["1", "2"], ["3"]),
    ("$s /= int\n$s /= tstr\na = $s", ["1", '"x"'], ["null"]),
    ("a = &(x: 1, y: 2)", ["1", "2"], ["3"]),
    ("a = &g\ng = (x: 1, y: 2)", ["1"], ["0"]),
    ("a = (int / tstr)", ["1", '"x"'], ["1.5"]),
    ("a = 0x10 / 0b11", ["16", "3"], ["10"]),
    # ranges
    ("a = 2..5", ["2", "5"], ["1", "6", "2.0"]),
    ("a = 2...5", ["2", "4"], ["1", "5"]),
    ("a = -5..-2", ["-5", "-2"], ["-6", "-1"]),
    ("a = -5..5", ["-5", "0", "5"], ["-6", "6"]),
    ("a = 1.5..2.5", ["1.5", "2.5", "2"], ["1.4", "2.6", "3"]),
    ("a = low .. high\nlow = 1\nhigh = 3", ["1", "3"], ["0", "4"]),
    ("a = 1..2.5", [], ["1", "2.0"]),
    # maps
    ("a = {}", ["{}"], ['{"x":1}', "[]"]),
    ("a = { k: int }", ['{"k":1}'], ["{}", '{"k":"x"}', '{"k":1,"l":2}', "[]"]),
    ("a = { ? k: int }", ["{}", '{"k":1}'], ['{"k":"x"}']),
    ('a = { "k k": int, l => tstr }\nl = "q"', ['{"k k":1,"q":"z"}'], ['{"k k":1}']),
    ("a = { * tstr => int }", ["{}", '{"x":1,"y":2}'], ['{"x":"y"}']),
    ("a = { + tstr => int }", ['{"x":1}'], ["{}"]),
    ("a = { 1*2 tstr => int }", ['{"x":1}', '{"x":1,"y":2}'], ["{}", '{"x":1,"y":2,"z":3}']),
    ("a = { k: int, * tstr => any }", ['{"k":1,"z":null}'], ['{"k":"x"}']),
    ("a = { ? k: int, * tstr => tstr }", ['{"z":"y"}', '{"k":1}'], ['{"k":"x"}']),
    ("a = { * tstr => any, k: int }", [], ['{"k":1}']),
    ("a = { * tstr => tstr, k: int }", ['{"k":1,"z":"y"}'], ['{"z":"y"}']),
    ("a = { tstr => int, tstr => tstr }", ['{"a":"x","b":1}', '{"a":1,"b":"x"}'], ['{"a":1,"b":2}']),
    ("a = { x: int // y: tstr }", ['{"x":1}', '{"y":"z"}'], ['{"x":1,"y":"z"}', "{}"]),
    ("a = { g }\ng = (x: int, ? y: int)", ['{"x":1}', '{"x":1,"y":2}'], ['{"y":2}']),
    ("a = { g }\ng = (x: int)\ng //= (y: int)", ['{"x":1}', '{"y":1}'], ["{}"]),
    ("a = { x: int, ~b }\nb = { y: tstr }", ['{"x":1,"y":"z"}'], ['{"x":1}']),
    ("a = { k: any, * $$more }", ['{"k":1}'], ['{"k":1,"z":2}']),
    ("a = { k: any, * $$more }\n$$more //= (z: int)", ['{"k":1,"z":2}', '{"k":1}'], ['{"k":1,"z":"x"}']),
    # arrays
    ("a = []", ["[]"], ["[1]", "{}"]),
    ("a = [int, tstr]", ['[1,"x"]'], ["[1]", '[1,"x",2]', '["x",1]']),
    ("a = [* int]", ["[]", "[1,2]"], ['[1,"x"]']),
    ("a = [+ int]", ["[1]"], ["[]"]),
    ("a = [? int, tstr]", ['["x"]', '[1,"x"]'], ["[1]"]),
    ("a = [2*3 int]", ["[1,2]", "[1,2,3]"], ["[1]", "[1,2,3,4]"]),
    ("a = [2* int]", ["[1,2,3,4]"], ["[1]"]),
    ("a = [*2 int]", ["[]", "[1,2]"], ["[1,2,3]"]),
    ("a = [* int, int]", [], ["[1]", "[1,2]"]),
    ("a = [* (int, tstr)]", ["[]", '[1,"x",2,"y"]'], ['[1,"x",2]']),
    ("a = [(int // tstr, bool)]", ["[1]", '["x",true]'], ['["x"]']),
    ("a = [k: int, l: tstr]", ['[1,"x"]'], ['["x",1]']),
    ("a = [* ()]", ["[]"], ["[1]"]),
    ("a = [g, g]\ng = (int, ? tstr)", ["[1,2]", '[1,"x",2,"y"]'], ["[1]"]),
    # generics and recursion
    ("a = m<int>\nm<t> = [t, ? m<t>]", ["[1]", "[1,[2,[3]]]"], ['[1,["x"]]']),
    ("a = p<1, tstr>\np<x, y> = { k: x, l: y }", ['{"k":1,"l":"z"}'], ['{"k":2,"l":"z"}']),
    ("a = [* a] / int", ["1", "[[],[1]]"], ['["x"]']),
    ("a = a / int", ["1"], ['"x"']),
    # controls
    ("a = tstr .size 2", ['"ab"', '"é"'], ['"a"', '"abc"']),
    ("a = tstr .size (1..3)", ['"a"', '"abc"'], ['""', '"abcd"']),
    ("a = uint .size 1", ["0", "255"], ["256"]),
    ("a = int .lt 5", ["-3", "4"], ["5"]),
    ("a = int .ge 5", ["5"], ["4"]),
    ("a = int .eq 5", ["5"], ["4"]),
    ("a = bool .eq true", ["true"], ["false"]),
    ('a = tstr .ne "x"', ['"y"'], ['"x"', "1"]),
    ("a = uint .bits 3", ["8", "12"], ["7", "0"]),
    ("a = uint .bits flags\nflags = &(p: 0, q: 2)", ["1", "4"], ["2"]),
    ("a = uint .bitfield [3, 2]", ["31"], ["32"]),
    ('a = tstr .regexp "b+"', ['"abc"'], ['"ac"']),
    ('a = tstr .pcre "b(?=c)c"', ['"bc"'], ['"abc"', '"bc\\n"']),
    ('a = tstr .pcre "(?<x-y>b)"', ['"b"'], ['"c"']),
    ('a = tstr .iregexp "[a-c]*"', ['"abc"'], ['"abd"']),
    ("a = (uint .gt 5) .and (uint .le 30)", ["6", "30"], ["5", "31"]),
    ("a = int .and 5", ["5"], ["6"]),
    ("a = (1..9) .within uint", ["9"], ["10"]),
    ("a = (1..9) .default 3", ["9"], ["10"]),
    ('a = "x" .cat ("y" / "z")', ['"xy"', '"xz"'], ['"x"']),
    ('a = " x" .det "\n  y"', ['"x\\ny"'], ['" x"']),
    ("a = 1 .plus 2", ["3"], ["2"]),
    ("a = tstr .abnf \"s\\ns = 1*DIGIT [%x2E 1*DIGIT]\"", ['"12"', '"1.5"'], ['"1."', '""']),
    ("a = tstr .b64u 'hi'", ['"aGk"'], ['"aGk="']),
    ("a = tstr .b64c 'hi'", ['"aGk="'], ['"aGk"']),
    ("a = tstr .b64u-sloppy 'hi'", ['"aGk"', '"aGk="', '"aGl"'], ['"aGm1"']),
    ("a = tstr .hex 'AB'", ['"4142"'], ['"4143"']),
    ("a = tstr .hex h'abcd'", ['"abcd"', '"ABCD"'], ['"abce"']),
    ("a = tstr .hexlc h'abcd'", ['"abcd"'], ['"ABCD"']),
    ("a = tstr .hexuc h'abcd'", ['"ABCD"'], ['"abcd"']),
    ("a = tstr .b32 'hi'", ['"NBUQ"'], ['"nbuq"']),
    ("a = tstr .h32 'hi'", ['"D1KG"'], ['"NBUQ"']),
    ("a = tstr .b45 'AB'", ['"BB8"'], ['"BB9"']),
    ("a = tstr .base10 12", ['"12"'], ['"012"']),
    ("a = tstr .base10 int", ['"12"', '"-3"'], ['"012"', '"x"']),
    ('a = tstr .printf ["%04x-%s", 255, "q"]', ['"00ff-q"'], ['"ff-q"']),
    ("a = tstr .json { x: int }", ['"{\\"x\\":1}"'], ['"{}"', '"{"']),
    ('a = tstr .join ["x", tstr, "y"]', ['"xy"', '"x12y"'], ['"x"', '"12y"']),
]


@pytest.mark.parametrize("schema,good,bad", JSON, ids=[s for s, _, _ in JSON])
def test_json(schema, good, bad):
    assert [d for d in good if not json_ok(schema, d)] == []
    assert [d for d in bad if json_ok(schema, d)] == []


CBOR = [
    ("a = #6.32(tstr)", [Tag(32, "x")], [Tag(33, "x"), "x"]),
    ("a = #6(tstr)", [Tag(9, "x")], ["x"]),
    ("a = #6.<1..3>(tstr)", [Tag(2, "x")], [Tag(4, "x")]),
    ("a = #0", [1], [-1]),
    ("a = #1.4", [-5], [-4, 4]),
    ("a = #2.2", [b"ab"], [b"a"]),
    ("a = #7.25", [1.5], [1]),
    ("a = #7.99", [Simple(99)], [Simple(98)]),
    ("a = undefined", [UNDEFINED], [None]),
    ("a = nint", [-1], [1]),
    ("a = unsigned", [1, Tag(2, b"\1")], [-1]),
    ("a = biguint", [Tag(2, b"\1")], [Tag(3, b"\1")]),
    ("a = decfrac", [Tag(4, [1, 2])], [[1, 2]]),
    ("a = bstr .size 2", [b"ab"], [b"abc"]),
    ("a = bstr .bits 9", [b"\0\2"], [b"\2\0", b""]),
    ("a = bstr .cbor { x: 1 }", [to_cbor(Map((("x", 1),)))], [b"\xff", to_cbor(Map((("x", 2),)))]),
    ("a = bstr .cborseq [1, 2]", [b"\1\2"], [b"\1"]),
    ("a = { 1: int, ? 2: tstr }", [Map(((1, 5),)), Map(((1, 5), (2, "x")))], [Map(((2, "x"),)), Map(((1, 5), (1, 5)))]),
    ("a = { * int => tstr, * tstr => int }", [Map(((1, "a"), ("b", 2)))], [Map(((1, 2),))]),
    ("a = { [int, int] => tstr }", [Map((([1, 2], "x"),))], [Map((([1], "x"),))]),
    ("a = { int => tstr, int => bstr }", [Map(((1, b"x"), (2, "y")))], [Map(((1, b"x"), (2, b"y")))]),
    ("a = { ? k => int, * tstr => any }\nk = \"k\"", [Map((("k", "x"),))], []),
    ("a = { ? k ^ => int, * tstr => any }\nk = \"k\"", [Map((("k", 1),))], [Map((("k", "x"),))]),
    ("a = ~uri", ["x"], [Tag(32, "x")]),
]


@pytest.mark.parametrize("schema,good,bad", CBOR, ids=[s for s, _, _ in CBOR])
def test_cbor(schema, good, bad):
    assert [d for d in good if not cbor_ok(schema, d)] == []
    assert [d for d in bad if cbor_ok(schema, d)] == []


def test_features():
    schema = 'a = (int .feature "f") / tstr'
    assert json_ok(schema, "1") and json_ok(schema, "1", ["f"]) and not json_ok(schema, "1", []) and json_ok(schema, '"x"', [])


def test_rulings_raise():
    with pytest.raises(SchemaError):
        json_ok('a = tstr .abnf "one-line"', '"x"')
    with pytest.raises(SchemaError):
        json_ok("a<t> = t", "1")
    with pytest.raises(SchemaError):
        json_ok('a = tstr .regexp "b(?=c)"', '"b"')
    with pytest.raises(SchemaError):
        Schema.parse("a = 1\na = 2")
    with pytest.raises(SchemaError):
        Schema.parse("a = b")


def test_syntax_round_trip():
    text = "\n".join(f"r{i} = {s.split('=', 1)[1].splitlines()[0].strip()}" for i, (s, _, _) in enumerate(JSON + CBOR) if "\n" not in s and s.startswith("a = "))
    rules = parse(text)
    assert parse("\n".join(map(text_of, rules))) == rules


@pytest.mark.parametrize("text", ["a", "a = ", "a = {", "a = [1, ", 'a = "x', "a = h'0'", "a = (int", "a = int ~", "= 1", "a = #6.(x)"])
def test_syntax_errors(text):
    with pytest.raises(SchemaSyntaxError) as e:
        parse(text)
    assert e.value.line == 1 and e.value.column >= 1


def test_nesting_is_linear():
    import time

    def cost(depth):
        t = time.perf_counter()
        for _ in range(5):
            parse("a = " + "[(" * depth + "int" + ")]" * depth)
        return time.perf_counter() - t

    cost(8)
    assert cost(24) < 30 * cost(8)


def test_cbor_decoding():
    assert from_cbor(bytes.fromhex("bf61610161629f0203ffff")) == Map((("a", 1), ("b", [2, 3])))
    assert from_cbor(bytes.fromhex("7f657374726561646d696e67ff")) == "streaming"
    assert from_cbor(bytes.fromhex("f93e00")) == 1.5
    for bad in ("", "18", "ff", "62c328", "8201", "1c", "0000"):
        with pytest.raises(DecodeError):
            from_cbor(bytes.fromhex(bad))
    assert from_cbor(b"\0\0", allow_trailing=True) == 0
    assert cbor_from_text("A1 01 02") == cbor_from_text("oQEC") == bytes.fromhex("a10102")


def test_csv():
    text = 'name,n\n"a, ""b""",1\nx,-2.5,extra\n"two\nlines",+7\n'
    assert from_csv(text, True) == [["name", "n"], ['a, "b"', 1], ["x", -2.5, "extra"], ["two\nlines", 7]]
    assert from_csv("") == [] and from_csv(",\n") == [["", ""]]


def test_errors_have_places():
    ok, errors = Schema.parse("a = { k: 0..9, l: [* b] }\nb = { n: tstr }").compiled()(from_json('{"k":5,"l":[{"n":"x"},{"n":1}]}'))
    assert not ok and [(e[1], e[2]) for e in errors] == [("/l/1/n", "b")]


def test_samples_match():
    schema = Schema.parse('a = { k: 0..49, ? n: tstr / nil, l: [1*3 b], * tstr => uint }\nb = { x: int .lt 5, ? a: a, c: "p" / "q", t: tdate }')
    made = schema.sample(15, seed=3)
    assert len(made) == 15
    check = schema.compiled()
    assert all(check(v)[0] for v in made)


def test_order_of_pairs_and_choices_is_free():
    import random

    rng = random.Random(2)
    schema, swapped = Schema.parse("a = { x: int, y: tstr / bool }"), Schema.parse("a = { y: bool / tstr, x: int }")
    for _ in range(50):
        pairs = [(k, rng.choice([1, "z", True, None])) for k in rng.sample(["x", "y", "z"], rng.randrange(1, 4))]
        shuffled = rng.sample(pairs, len(pairs))
        assert schema.compiled("cbor")(Map(tuple(pairs)))[0] == swapped.compiled("cbor")(Map(tuple(shuffled)))[0]


def test_lint_and_diagnose():
    assert {k for k, _, _ in Schema.parse("a = { x: int .regexp \"y\", }\nb = [* b]").lint()} >= {"unused", "recursive", "control"}
    found = Schema.diagnose("a = {x: \nb = q\nc = [int")
    assert [(line, text) for line, _, text in found if "isn't defined" in text] == [(2, "rule b refers to q, which isn't defined")]
    assert len([f for f in found if "isn't defined" not in f[2]]) == 2
    assert Schema.diagnose("a = int ; fine\n") == []


def test_command_line(tmp_path, capsys):
    from shapewright.__main__ import main

    (tmp_path / "s").write_text("a = { k: int }")
    (tmp_path / "good.json").write_text('{"k":1}')
    (tmp_path / "bad.json").write_text('{"k":"x"}')
    assert main(["compile-schema", str(tmp_path / "s")]) == 0
    assert main(["validate", "--schema", str(tmp_path / "s"), "--json", str(tmp_path / "good.json")]) == 0
    assert main(["validate", "--schema", str(tmp_path / "s"), "--json", str(tmp_path / "*.json")]) == 1
    assert "/k" in capsys.readouterr().out


def test_visitor_and_parents():
    from shapewright.plans.syntax import Literal, Name
    from shapewright.plans.visitor import Parents, Visitor

    rules = parse("a = { k: int, l: [* b] }\nb = 1 / 2")
    found = []

    class Names(Visitor):
        def visit_name(self, node):
            found.append(node.name)
            self.walk(node)

        def visit_literal(self, node):
            found.append(node.value)

    Names().visit_schema(rules)
    assert found == ["k", "int", "l", "b", 1, 2]
    parents = Parents(rules)
    inner = rules[1].body.choices[1].target
    assert inner == Literal(2) and parents.rule_of(inner) is rules[1] and parents.of(rules[0]) is None and not isinstance(parents.of(inner), Name)


def test_comments_become_types_metadata():
    schema = Schema.parse("; a person\nperson = {\n  name: tstr, ; full name\n  ; in years\n  ? age: uint\n}")
    fields = {f.name: f.metadata for f in schema.to_struct_type().fields}
    assert fields == {"name": {"comment": "full name"}, "age": {"comment": "in years"}}
