"""References from documents to tables: which values in documents no row of a table has.

A rule named ``ref-orders`` marks every place of a schema that names it as a reference to ``orders``. The places follow from the schema once, on
the driver; values are taken from parsed documents by column expressions. Only different values are looked up, so a value that a third of all
documents have is looked up once for each task; missing ones are joined back with a salt, so that their documents aren't one task's either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.syntax import ArrayOf, Group, MapOf, Name, Paren, Type
from ..schema import Schema
from .columns import NotColumnar, free_name, parsed_json
from .matcher import Compiler

PREFIX = "ref-"
#: Parts that the documents of one missing value are joined in.
SALTS = 32


def reference_paths(schema: Schema | str, root: str | None = None) -> list[tuple[tuple[str | None, ...], str]]:
    """(steps, table) of all references of a schema without recursion; a step is a key, or None for all items of an array."""
    schema = schema if isinstance(schema, Schema) else Schema.parse(schema)
    names = Compiler(schema.symbols, "json")
    recursive = schema.symbols.recursive()
    out: dict[tuple, None] = {}

    def group(g: Group, env: dict, steps: tuple, in_array: bool) -> None:
        for choice in g.choices:
            for e in choice:
                if isinstance(e.value, Group):
                    group(e.value, env, steps, in_array)
                    continue
                if in_array:
                    here = (*steps, None)
                elif e.key is not None:
                    keys = names.folded(e.key.type, env) or [...]
                    here = (*steps, keys[0])
                else:
                    here = steps
                kind(e.value, env, here)

    def kind(t, env: dict, steps: tuple) -> None:
        if isinstance(t, Type):
            for c in t.choices:
                kind(c.target, env, steps)
        elif isinstance(t, Paren):
            kind(t.type, env, steps)
        elif isinstance(t, MapOf):
            group(t.group, env, steps, False)
        elif isinstance(t, ArrayOf):
            group(t.group, env, steps, True)
        elif isinstance(t, Name) and t.name in env:
            kind(*env[t.name], steps)
        elif isinstance(t, Name):
            if t.name.startswith(PREFIX):
                if any(s is ... for s in steps):
                    raise NotColumnar("a reference below a key that isn't literal")
                out[steps, t.name.removeprefix(PREFIX)] = None
                return
            d, own = names.definition(t, env)
            if d is not None and t.name in recursive:
                raise NotColumnar(f"{t.name} is recursive")
            for x in d.types if d is not None else ():
                kind(x, own, steps)
            if d is not None and d.entries:
                g, own = names.group_of(t, env)
                group(g, own, steps[:-1] if steps and steps[-1] is None else steps, bool(steps) and steps[-1] is None)

    kind(Name(root or schema.symbols.root()), {}, ())
    return list(out)


def _below(key: str):
    """What lies below a key."""
    return lambda x: F.struct(F.concat(x["location"], F.lit(f"/{key}")).alias("location"), F.try_element_at(F.try_variant_get(x["v"], "$", "map<string,variant>"), F.lit(key)).alias("v"))


def _items(x: Column) -> Column:
    """The items of an array."""
    items = F.coalesce(F.try_variant_get(x["v"], "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(items, lambda y, i: F.struct(F.concat(x["location"], F.lit("/"), i.cast("string")).alias("location"), y.alias("v")))


def _of(table: str):
    return lambda x: F.struct(x["location"].alias("location"), F.lit(table).alias("table"), x["value"].alias("value"))


def _values(doc: Column, steps: tuple[str | None, ...]) -> Column:
    """An array of (location, value) of what lies at steps; empty where there is nothing."""
    found = F.array(F.struct(F.lit("").alias("location"), doc.alias("v")))
    for step in steps:
        found = F.flatten(F.transform(found, _items)) if step is None else F.transform(found, _below(step))
        found = F.filter(found, lambda x: x["v"].isNotNull() & ~F.schema_of_variant(x["v"]).isin("VOID"))
    found = F.filter(found, lambda x: ~F.schema_of_variant(x["v"]).rlike("^(OBJECT|ARRAY)<"))
    return F.transform(found, lambda x: F.struct(x["location"].alias("location"), F.try_variant_get(x["v"], "$", "string").alias("value")))


def dangling(df: DataFrame, schema: Schema | str, on: str, tables: dict[str, tuple[DataFrame, str]], root: str | None = None) -> DataFrame:
    """df's columns, location, table, value: a row for each reference in the JSON documents of ``on`` to what ``tables`` (name -> table, key) don't have.

    Documents that aren't JSON have no references; a null is no reference. Numbers and texts that are written alike are the same key. Rows of df
    that are equal each have their rows.
    """
    paths = reference_paths(schema, root)
    unknown = {t for _, t in paths} - set(tables)
    if unknown:
        raise ValueError(f"no tables for references to {', '.join(sorted(unknown))}")
    parsed, ref, salt = (free_name(df, n) for n in ("_parsed", "_ref", "_s"))
    own = df.withColumn(parsed, parsed_json(F.col(f"`{on}`")))
    each = [F.transform(_values(F.col(parsed), steps), _of(table)) for steps, table in paths]
    columns = [F.col(f"`{c}`") for c in df.columns]
    if not each:
        return df.select(*columns, F.lit("").alias("location"), F.lit("").alias("table"), F.lit("").alias("value")).filter("false")
    found = own.select(*columns, F.explode(F.concat(*each)).alias(ref))
    of = F.col(ref)
    asked = found.select(of["table"].alias("table"), of["value"].alias("value")).distinct()
    keys = None
    for name in sorted({t for _, t in paths}):
        parent, key = tables[name]
        some = parent.select(F.lit(name).alias("table"), F.col(f"`{key}`").cast("string").alias("value")).filter("value is not null").distinct()
        keys = some if keys is None else keys.unionByName(some)
    t, v, part = (free_name(df, n) for n in ("_t", "_v", "_salt"))
    missing = asked.join(keys, ["table", "value"], "left_anti").select(F.col("table").alias(t), F.col("value").alias(v), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(part))
    salted = found.withColumn(salt, F.pmod(F.xxhash64(*columns, of["location"]), F.lit(SALTS)).cast("int"))
    rows = salted.join(missing, (of["table"] == F.col(t)) & (of["value"] == F.col(v)) & (F.col(salt) == F.col(part)))
    return rows.select(*columns, of["location"].alias("location"), of["table"].alias("table"), of["value"].alias("value"))
