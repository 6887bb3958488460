"""Expressions in both engines: what is written for one finds what is written for the other."""

import random

import pytest
from pyspark.sql import functions as F

from shapewright import Schema, SchemaError, validate
from shapewright.functions import expressions

REGEXP = [
    r"[[:alpha:]]+", r"[a-z&&[^b]]", r"[[a]]", r"\x{41}", r"(?<n>a)", r"\p{Greek}", r"a{,2}$", r"\w\s", r"(?i)straße", r"[^a-c\d]", r"(?i:a)b", r"\bab?\b", r"[a-z--[aeiou]]+", r"[a-d~~c-f]", r"^a.b$", r"(?m)^b$",
    r"(?s)a.b", r"(?x) a b # c", r"[]a]", r"[^]]", r"[a\-z]", r"a|b|", r"\pL\PL", r"[\p{Lu}\s]", r"(?U)a+b", r"\@", r"[[:^digit:]x]", r"(?i)[k-l]", r"(?i)\p{Lu}",
]
PCRE = [r"(?<n>a)\k<n>", r"(a)\1", r"(?=.*[A-Z])(?=.*[0-9]).{8,}", r"foo(?<=foo)bar", r"(?>a+)b", r"a++b", r"(?<x-y>b)", r"(?i)(a)\1"]
IREGEXP = [r"[^@]+@[^@]+", r"[0-9]{3}", r"\p{Lu}.", r"a\.b", r"[a-c]*", r"[-a]"]
REFUSED = [("regexp", "b(?=c)"), ("regexp", "a("), ("regexp", "[a"), ("regexp", r"\p{Nope}"), ("regexp", "*a"), ("pcre", r"\2(a)"), ("iregexp", r"\d"), ("iregexp", "a*?"), ("iregexp", "(?:a)"), ("iregexp", "^a"), ("iregexp", "[[a]]")]
TEXTS = ["", "a", "b", "ab", "aB", "A", "AA", "abc", "a\nb", "b\na", "a\rb", "aaa", "aab", "é", "Ω", "αβ", "STRASSE", "straße", "STRAẞE", "-", "]", "&", "x1", "٣", "_ ", " ", "a-b", "zz", "foobar", "Passw0rdX", "123", "x@y", "B.", "@", "K", "k", "ǅ", "\U0001f600", "ſ", "a.b", " "]


def random_expressions(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    atoms = ["a", "b", "[ab]", "[^a]", ".", r"\d", r"\w", "[a-c&&[b-d]]", r"\p{L}", "(a|b)", "(?:ab)", "(?i:a)", r"\s", "[[:alpha:]]", "^", "$", r"\b", r"[^\W\d]", "[[^a]b--é]"]
    times = ["", "", "*", "+", "?", "{1,2}", "*?"]
    return ["".join(rng.choice(atoms) + rng.choice(times) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_both_engines_agree(spark):
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("ab1 \nAé-") for _ in range(rng.randint(0, 5))) for _ in range(60)]
    cases = [("regexp", x) for x in REGEXP + random_expressions(120, 5)] + [("pcre", x) for x in PCRE] + [("iregexp", x) for x in IREGEXP]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").cache()
    for at in range(0, len(cases), 60):
        part = cases[at : at + 60]
        rows = df.select("i", *(F.col("t").rlike(expressions.java(x, k)).alias(f"c{j}") for j, (k, x) in enumerate(part))).collect()
        for j, (k, x) in enumerate(part):
            find = expressions.python(x, k)
            assert [texts[r.i] for r in rows if r[f"c{j}"] != bool(find(texts[r.i]))] == [], (k, x)


@pytest.mark.parametrize(("kind", "text"), REFUSED)
def test_refused(kind, text):
    with pytest.raises(expressions.ExpressionError):
        expressions.tree(text, kind)


def test_meaning():
    finds = lambda x, t, kind="regexp": bool(expressions.python(x, kind)(t))
    assert finds("[a-z&&[^b]]", "b") is False and finds("[a-z&&[^b]]", "xb") and finds("[[:alpha:]]", "1a") and not finds("[[:alpha:]]", "é")
    assert finds("[a-z--[aeiou]]", "aeb") and not finds("[a-z--[aeiou]]", "ae") and finds("[a-d~~c-f]", "a") and not finds("[a-d~~c-f]", "c")
    assert finds("(?i)k", "K") and finds(r"(?<n>a)\k<n>", "aa", "pcre") and not finds("a$", "a\n") and not finds(".", "\r", "iregexp")


def test_bad_expressions_fail_on_the_driver(spark):
    df = spark.createDataFrame([('{"k":"a"}',)], "t string")
    schema = Schema.parse('m = { k: [* x] / tstr .cat "x" / x }\nx = [y]\ny = tstr .regexp "(?<n>a)\\\\k<m>"')
    for tier in ("matcher", "auto"):
        with pytest.raises(SchemaError):
            validate(df, schema, "t", tier=tier)


def test_unknown_controls_are_problems():
    from shapewright.plans.analysis import problems

    assert problems('a = int .foo 3\nb = tstr .regexq "x"') == [(1, 9, 13, "no control .foo", None), (2, 10, 17, "no control .regexq", "did you mean .regexp?")]
