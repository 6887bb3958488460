"""Errors of JSON documents as column expressions: an array of error structs, empty for a document that conforms.

The errors are those of the matcher, in its order: of a map's entries the first that fails tells, tables and unexpected keys tell all of theirs, of an
array's items the first one that fails does, and of a type choice all arms do. Places are threaded through as columns, so items of
arrays and pairs of tables have theirs. What the expressions don't say (groups in arrays, group choices in maps, embedded documents, limited
tables) raises NotColumnar, and the matcher is asked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fold
from ..plans.analysis import SchemaError
from ..plans.syntax import ArrayOf, Enum, Group, Literal, MapOf, Name, Paren, Type, Type1, text_of
from .columns import Columns, NotColumnar, Variant, _bound

FIELDS = ("reason", "location", "rule", "multi_type_choice", "multi_group_choice", "group_enum", "entry_name", "decode_error", "offset")
#: Of documents that can't be decoded: decode_error is the kind, offset the byte or letter where it is known.
ERROR = T.StructType([T.StructField(n, T.BooleanType() if n.startswith(("multi", "group")) else T.LongType() if n == "offset" else T.StringType()) for n in FIELDS])
ERRORS = T.ArrayType(ERROR)
#: Numbers with a fraction are shown with so many places, below this bound.
PLACES, LARGEST = 6, 1e15


def error(reason: Column, path: Column, rule: str = "", type_choice: bool = False, enum: bool = False, entry: Column | None = None, kind: str | None = None) -> Column:
    """An array of one error."""
    parts = (reason, path, F.lit(rule), F.lit(type_choice), F.lit(False), F.lit(enum), F.lit("") if entry is None else entry, F.lit(kind).cast("string"), F.lit(None).cast("bigint"))
    return F.array(F.struct(*(p.alias(n) for n, p in zip(FIELDS, parts, strict=True))))


def none() -> Column:
    return F.array().cast(ERRORS)


def quoted(text: Column) -> Column:
    whole = F.concat(F.lit("'"), text, F.lit("'"))
    return F.when(F.length(whole) > 60, F.concat(F.substring(whole, 1, 57), F.lit("..."))).otherwise(whole)


def shown(v: Variant) -> Column:
    """A value as the matcher's errors name it."""
    number = v.as_number()
    fixed = F.regexp_replace(number.cast(f"decimal(38,{PLACES})").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    return (
        F.when(v.text, quoted(v.as_text()))
        .when(v.int, v.as_int().cast("string"))
        .when(v.bool, F.when(v.as_bool(), F.lit("True")).otherwise(F.lit("False")))
        .when(v.null, F.lit("None"))
        .when(v.schema.startswith("OBJECT<"), F.concat(F.lit("a map of "), F.size(F.try_variant_get(v.col, "$", "map<string,variant>")).cast("string")))
        .when(v.schema.startswith("ARRAY<"), F.concat(F.lit("an array of "), F.size(F.try_variant_get(v.col, "$", "array<variant>")).cast("string")))
        .when(F.abs(number) >= LARGEST, F.lit("a number beyond 10^15"))
        .otherwise(fixed)
    )


def farthest(errors: Column) -> Column:
    """Of an array's errors those that lie deepest."""
    step = lambda x: F.when(x.rlike(r"^[0-9]+\z"), F.struct(F.lit(1).alias("a"), x.cast("decimal(38,0)").alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), F.lit(0).cast("decimal(38,0)").alias("b")))
    depth = lambda e: F.transform(F.filter(F.split(e["location"], "/"), lambda _, i: i > 0), step)

    def best(found: Column) -> Column:
        return _bound(F.array_max(F.transform(found, depth)), lambda most: F.array_distinct(F.filter(found, lambda e: depth(e) == most)))

    return _bound(errors, lambda e: F.when(F.size(e) > 1, best(e)).otherwise(e))


class Failures(Columns):
    """Compiles types of one schema to errors of variants."""

    def errors(self, root: str | None, doc: Column) -> Column:
        found = self.of_type2(Name(root or self.symbols.root()), {}, Variant(doc), F.lit(""), "", False)
        return F.array_distinct(found)

    def unless(self, good: Column, reason: Column, path: Column, rule: str, choice: bool, enum: bool = False) -> Column:
        return F.when(F.coalesce(good, F.lit(False)), none()).otherwise(error(reason, path, rule, choice, enum))

    def expected(self, what: str, v: Variant) -> Column:
        return F.concat(F.lit(f"expected {what}, got "), shown(v))

    def of_type(self, t: Type, env: dict, v: Variant, path: Column, rule: str, choice: bool) -> Column:
        if len(t.choices) == 1:
            return self.of_type1(t.choices[0], env, v, path, rule, choice)
        return self.any_of([self.of_type1(c, env, v, path, rule, True) for c in t.choices])

    @staticmethod
    def any_of(arms: list[Column]) -> Column:
        """No errors if an arm has none, else those of all arms."""
        return _bound(F.array(*arms), lambda all_: F.when(F.exists(all_, lambda e: F.size(e) == 0), none()).otherwise(F.flatten(all_)))

    def of_type1(self, t: Type1, env: dict, v: Variant, path: Column, rule: str, choice: bool) -> Column:
        if t.op is None:
            return self.of_type2(t.target, env, v, path, rule, choice)
        if t.op in ("..", "...") or t.op in (".cat", ".det", ".plus"):
            low, high = (t.target, t.controller) if t.op in ("..", "...") else (0, 0)
            if t.op in ("..", "...") and type(self.names.one(low, env, (int, float), "an end")) is not type(self.names.one(high, env, (int, float), "an end")):
                raise NotColumnar("a range whose ends differ in kind")
            return self.unless(self.type1(t, env, v), self.expected(text_of(t), v), path, rule, choice)
        if t.op in (".feature", ".json"):
            raise NotColumnar(f"{t.op} needs the matcher for errors")
        target = self.of_type2(t.target, env, v, path, rule, choice)
        if t.op == ".default":
            return target
        if t.op in (".and", ".within"):
            other = self.of_type2(t.controller, env, v, path, rule, choice)
        else:
            if t.op in fold.ENCODERS and self.names.folded(t.controller, env) is None:
                raise NotColumnar(f"{t.op} needs the matcher for errors")
            other = self.unless(self.control(t, env, v), self.expected(text_of(t), v), path, rule, choice)
        return _bound(target, lambda e: F.when(F.size(e) > 0, e).otherwise(other))

    def of_type2(self, t, env: dict, v: Variant, path: Column, rule: str, choice: bool) -> Column:
        if isinstance(t, Type):
            return self.of_type(t, env, v, path, rule, choice)
        if isinstance(t, Paren):
            return self.of_type(t.type, env, v, path, rule, choice)
        if isinstance(t, Literal):
            return self.unless(self.type2(t, env, v), self.expected(text_of(t), v), path, rule, choice)
        if isinstance(t, Enum):
            return self.unless(self.type2(t, env, v), self.expected(f"one of {text_of(t)}", v), path, rule, choice, True)
        if isinstance(t, Name):
            return self.of_name(t, env, v, path, rule, choice)
        if isinstance(t, MapOf):
            return self.of_map(t.group, env, v, path, rule, choice)
        if isinstance(t, ArrayOf):
            return self.of_array(t.group, env, v, path, rule, choice)
        raise NotColumnar(f"{text_of(t)} needs the matcher")

    def of_name(self, t: Name, env: dict, v: Variant, path: Column, rule: str, choice: bool) -> Column:
        if t.name in env:
            bound, own = env[t.name]
            return self.of_type(bound, own, v, path, rule, choice)
        d, own = self.names.definition(t, env)
        if d is None:
            if t.name.startswith("$"):
                raise NotColumnar("an empty socket")
            if t.name == "any":
                return none()
            return self.unless(self.kind(t.name, v), self.expected(t.name, v), path, rule, choice)
        if t.name in self.recursive:
            raise NotColumnar(f"{t.name} is recursive")
        if not d.types:
            raise SchemaError(f"{t.name} is a group, not a type")
        if len(d.types) == 1:
            return self.of_type(d.types[0], own, v, path, t.name, choice)
        return self.any_of([self.of_type(x, own, v, path, t.name, True) for x in d.types])

    def flat(self, group: Group, env: dict) -> list[tuple]:
        """Entries of a map without group choices, with those of its groups: (entry, env)."""
        if len(group.choices) != 1:
            raise NotColumnar("group choices need the matcher for errors")
        out = []
        for e in group.choices[0]:
            if e.key is None:
                inner, own = self.spliced(e, env)
                out += self.flat(inner, own)
            else:
                out.append((e, env))
        return out

    def of_map(self, group: Group, env: dict, v: Variant, path: Column, rule: str, choice: bool) -> Column:
        self.members(group, env)  # raises where columns can't check
        entries = self.flat(group, env)
        below = lambda key: F.concat(path, F.lit("/"), key)

        def told(pairs: Column) -> Column:
            known, out = [], F.when(F.lit(False), none())
            table = None
            for e, own in entries:
                label = text_of(e.key.type)
                keys = self.names.folded(e.key.type, own)
                if not (keys and len(keys) == 1 and e.high == 1):
                    if e.high is not None:
                        raise NotColumnar("a limited table needs the matcher for errors")
                    table = (e, own, label)
                    continue
                missing = error(F.lit(f"a pair with key {label} is missing"), path, rule, choice, entry=F.lit(label))
                if not isinstance(keys[0], str):
                    out = out.when(F.lit(e.low > 0), missing)
                    continue
                known.append(keys[0])
                there = F.map_contains_key(pairs, F.lit(keys[0]))
                if e.low:
                    out = out.when(~there, missing)
                value = Variant(F.try_element_at(pairs, F.lit(keys[0])))
                bad = there & ~F.coalesce(self.type(e.value, own, value), F.lit(False))
                out = out.when(bad, self.of_type(e.value, own, value, below(F.lit(keys[0])), rule, choice))
            rest = F.map_filter(pairs, lambda k, _: ~k.isin(known)) if known else pairs
            unexpected = lambda keys: F.flatten(F.transform(keys, lambda k: error(F.concat(F.lit("unexpected key "), quoted(k)), path, rule, choice, entry=k)))
            if table is None:
                return out.otherwise(unexpected(F.array_sort(F.map_keys(rest))))
            e, own, label = table

            def of_table(left: Column) -> Column:
                wrong = F.array_sort(F.map_keys(F.map_filter(left, lambda _, x: ~F.coalesce(self.type(e.value, own, Variant(x)), F.lit(False)))))
                own_errors = lambda k: self.of_type(e.value, own, Variant(F.try_element_at(left, k)), below(k), rule, choice)

                def with_wrong(keys: Column) -> Column:
                    count = F.size(left) - F.size(keys)
                    if e.key.cut:
                        stop = F.when(F.size(keys) > 0, own_errors(F.element_at(keys, 1)))
                    else:
                        stop = F.when(F.lit(False), none())
                    every = F.flatten(F.transform(keys, own_errors))
                    few = error(F.concat(F.lit(f"{e.low} pairs with key {label} are needed, not "), count.cast("string")), path, rule, choice, entry=F.lit(label))
                    return stop.when(count < e.low, F.concat(every, few)).otherwise(F.concat(every, unexpected(keys)))

                return _bound(wrong, with_wrong)

            return out.otherwise(_bound(rest, of_table))

        pairs = F.try_variant_get(v.col, "$", "map<string,variant>")
        no = error(self.expected("a map", v), path, rule, choice)
        return F.when(v.schema.startswith("OBJECT<"), _bound(pairs, told)).otherwise(no)

    def of_array(self, group: Group, env: dict, v: Variant, path: Column, rule: str, choice: bool) -> Column:
        if len(group.choices) != 1:
            raise NotColumnar("group choices need the matcher for errors")
        fixed, repeated = [], None
        for e in group.choices[0]:
            if isinstance(e.value, Group) or self.is_group(e.value, env) or repeated is not None:
                raise NotColumnar("groups in arrays need the matcher for errors")
            if e.low == e.high and e.low <= 16:
                fixed += [e.value] * e.low
            else:
                repeated = e
        below = lambda i: F.concat(path, F.lit("/"), i.cast("string"))

        def told(items: Column) -> Column:
            n = F.size(items)
            out = F.when(F.lit(False), none())
            for i, t in enumerate(fixed):
                out = out.when(n <= i, error(F.lit("an item is missing"), below(F.lit(i)), rule, choice))
                item = Variant(F.get(items, F.lit(i)))
                bad = ~F.coalesce(self.type(t, env, item), F.lit(False))
                out = out.when(bad, farthest(self.of_type(t, env, item, below(F.lit(i)), rule, choice)))
            k, high = len(fixed), None
            if repeated is not None:
                high = None if repeated.high is None else k + repeated.high
                last = n if high is None else F.least(n, F.lit(high))
                places = F.sequence(F.lit(k), last - 1)
                good = lambda i: F.coalesce(self.type(repeated.value, env, Variant(F.get(items, i))), F.lit(False))
                wrong = F.when(last > k, F.get(F.filter(places, lambda i: ~good(i)), F.lit(0)))
                at = lambda i: farthest(self.of_type(repeated.value, env, Variant(F.get(items, i)), below(i), rule, choice))
                tail = F.when(n < k + repeated.low, error(F.lit("an item is missing"), below(n), rule, choice))
                tail = tail.when(n > high, error(F.lit(f"item {high} isn't expected"), below(F.lit(high)), rule, choice)) if high is not None else tail
                return out.otherwise(_bound(wrong, lambda i: F.when(i.isNotNull(), at(i)).otherwise(F.coalesce(tail, none()))))
            return out.when(n > k, error(F.lit(f"item {k} isn't expected"), below(F.lit(k)), rule, choice)).otherwise(none())

        no = error(self.expected("an array", v), path, rule, choice)
        return F.when(v.schema.startswith("ARRAY<"), _bound(F.try_variant_get(v.col, "$", "array<variant>"), told)).otherwise(no)
