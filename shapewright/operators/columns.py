"""Schemas as column expressions: rows are checked by Catalyst, without Python on the executors.

A column of JSON text is parsed to a variant, whose parts are told apart by ``schema_of_variant``, never by casts, as casts convert.
Columns of other types are checked by type: what no value of the type can be is folded to false. SQL NULL in a column or field of a
row stands for an absent member; a variant's null is a null.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions, fold
from ..plans.analysis import SchemaError, Symbols
from ..plans.syntax import ArrayOf, Entry, Enum, Group, Literal, MapOf, Name, Paren, Type, Type1, Unwrap, text_of
from .matcher import Compiler


class NotColumnar(SchemaError):
    """The schema, or this part of it, needs the matcher."""


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_LONG_MOST = (1 << 63) - 1
#: RFC 3339 and RFC 3986 forms, as Java's expressions.
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
_URI = r"^[A-Za-z][A-Za-z0-9+.-]*:([A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=-]|%[0-9A-Fa-f]{2})*\z"
_B64URL = r"^(?:[A-Za-z0-9_-]{4})*(?:[A-Za-z0-9_-][AQgw]|[A-Za-z0-9_-]{2}[AEIMQUYcgkosw048])?\z"
#: What stands behind a JSON text while it is parsed.
_END = "\\u0001 end of the document \\u0001"


def parsed_json(text: Column) -> Column:
    """The variant of a text that is one JSON document and nothing else; null for other texts. Of a repeated key the last value counts.

    Parsing stops after a document, whatever follows. So the text is parsed as the first of two items of an array, the other of which must be
    there in the end. Texts that hold that other item are parsed as an array's only item and as an object's only value: no
    text but one document fits into both.
    """
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    two = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    end = F.lit(_END.replace("\\u0001", "\u0001"))
    whole = ~text.contains(_END) & (F.try_variant_get(two, "$[1]", "string") == end)
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}")))
    odd = text.contains(_END) & alone.isNotNull() & named.isNotNull()
    fine = ~text.rlike(_ODD) | (~_halved(text) & ~_infinite(text))
    return F.when(whole & fine, F.try_variant_get(two, "$[0]", "variant")).when(odd & fine, F.try_variant_get(alone, "$[0]", "variant"))


#: Texts that may hold half of a surrogate pair, or a number beyond a double's range.
_ODD = r"\\u[dD][89a-fA-F]|[0-9.]{300}|[eE]\+?0*[1-9][0-9][0-9]"


def _halved(text: Column) -> Column:
    """Whether a JSON text has half of a surrogate pair: one is left when whole pairs go."""
    plain = F.regexp_replace(text, r"\\\\", " ")
    whole = F.regexp_replace(plain, r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", "")
    return whole.rlike(r"\\u[dD][89a-fA-F]")


def _infinite(text: Column) -> Column:
    """Whether a JSON text has a number beyond a double's range outside its strings."""
    plain = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', '""')
    numbers = F.regexp_extract_all(plain, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"), F.lit(1))
    return F.exists(numbers, lambda x: F.abs(x.cast("double")) == float("inf"))


class Value:
    """A typed column: predicates and parts of it."""

    def __init__(self, col: Column, kind: T.DataType):
        self.col, self.kind = col, kind
        self.is_int = isinstance(kind, _INTEGERS) or isinstance(kind, T.DecimalType) and kind.scale == 0
        self.is_float = isinstance(kind, (T.FloatType, T.DoubleType)) or isinstance(kind, T.DecimalType) and kind.scale > 0
        self.text = self.guard(isinstance(kind, T.StringType))
        self.bytes = self.guard(isinstance(kind, T.BinaryType))
        self.bool = self.guard(isinstance(kind, T.BooleanType))
        self.null = col.isNull()
        self.int, self.float = self.guard(self.is_int), self.guard(self.is_float)

    def guard(self, yes: bool) -> Column | None:
        """A predicate that holds for the type, or None where no value has it."""
        return self.col.isNotNull() if yes else None

    def as_int(self) -> Column:
        return self.col

    def as_number(self) -> Column:
        return self.col.cast("double") if self.is_float else self.col

    def as_text(self) -> Column:
        return self.col

    def as_bool(self) -> Column:
        return self.col

    def as_bytes(self) -> Column:
        return self.col


class Variant(Value):
    """A variant column of parsed JSON; ``inner``: one in a lambda, where Spark doesn't see that expressions are the same."""

    def __init__(self, col: Column, inner: bool = False):
        self.col, self.inner = col, inner
        self.schema = F.schema_of_variant(col)
        s = self.schema
        decimal = s.startswith("DECIMAL(")
        big = decimal & s.endswith(",0)") & (F.abs(self._get("decimal(38,0)")) > F.lit(_LONG_MOST))
        self.unsigned = big & (self._get("decimal(38,0)") > 0) & (self._get("decimal(38,0)") < F.expr("cast(18446744073709551616BD as decimal(38,0))"))
        self.int = (s == "BIGINT") | self.unsigned
        self.float = (s == "DOUBLE") | (s == "FLOAT") | (decimal & ~self.unsigned)
        self.text, self.bool, self.null = s == "STRING", s == "BOOLEAN", s == "VOID"
        self.bytes = None
        self.is_int = self.is_float = True

    def _get(self, kind: str, path: str = "$") -> Column:
        return F.try_variant_get(self.col, path, kind)

    def as_int(self) -> Column:
        return self._get("decimal(20,0)")

    def as_number(self) -> Column:
        return self._get("double")

    def as_text(self) -> Column:
        return self._get("string")

    def as_bool(self) -> Column:
        return self._get("boolean")


def _and(*parts: Column | None) -> Column:
    if any(p is None for p in parts):
        return F.lit(False)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _or(*parts: Column | None) -> Column:
    some = [p for p in parts if p is not None]
    if len(some) == 1:
        return some[0]  # as it is, so that the scan can take it over
    some = [F.coalesce(p, F.lit(False)) for p in some]
    out = some[0] if some else F.lit(False)
    for p in some[1:]:
        out = out | p
    return out


def free_name(df, name: str) -> str:
    """A column's name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _bound(value: Column, body) -> Column:
    """body(value), where value is computed once. An aggregate's type follows from its end alone, so that nesting these stays cheap to analyse."""
    return F.aggregate(F.array(F.lit(0)), value, lambda kept, _: kept, body)


def _number(n: int | float) -> Column:
    if isinstance(n, float):
        return F.lit(n)
    return F.lit(n) if -(1 << 63) <= n < 1 << 63 else F.expr(f"cast('{n}' as decimal(38,0))")


class Columns:
    """Compiles types of one schema."""

    def __init__(self, symbols: Symbols, features: list[str] | None = None):
        self.symbols, self.features = symbols, features
        self.names = Compiler(symbols, "json", features)
        self.recursive = symbols.recursive()

    def root(self, name: str | None, value: Value) -> Column:
        """The check; null or false where the value doesn't conform."""
        return self.type2(Name(name or self.symbols.root()), {}, value)

    def type(self, t: Type, env: dict, v: Value) -> Column:
        return _or(*(self.type1(c, env, v) for c in t.choices))

    def type1(self, t: Type1, env: dict, v: Value) -> Column:
        if t.op is None:
            return self.type2(t.target, env, v)
        if t.op in ("..", "..."):
            return self.range(t, env, v)
        return self.control(t, env, v)

    def literal(self, want, v: Value) -> Column:
        if isinstance(want, bool):
            raise NotColumnar("a literal of no kind")
        if isinstance(want, int):
            return _and(v.int, v.as_int() == _number(want)) if v.int is not None else F.lit(False)
        if isinstance(want, float):
            return _and(v.float, F.abs(v.as_number() - F.lit(want)) < F.lit(2.220446049250313e-16)) if v.float is not None else F.lit(False)
        if isinstance(want, str):
            return _and(v.text, v.as_text() == F.lit(want)) if v.text is not None else F.lit(False)
        return _and(v.bytes, v.as_bytes() == F.unhex(F.lit(want.hex()))) if v.bytes is not None else F.lit(False)

    def type2(self, t, env: dict, v: Value) -> Column:
        if isinstance(t, Type):
            return self.type(t, env, v)
        if isinstance(t, Literal):
            return self.literal(t.value, v)
        if isinstance(t, Paren):
            return self.type(t.type, env, v)
        if isinstance(t, Name):
            return self.name(t, env, v)
        if isinstance(t, Enum):
            group, own = self.names.group_of(t.group, env)
            return _or(*(self.type2(e.value, own, v) for c in group.choices for e in c))
        if isinstance(t, MapOf):
            return self.map(t.group, env, v)
        if isinstance(t, ArrayOf):
            return self.array(t.group, env, v)
        raise NotColumnar(f"{text_of(t)} needs the matcher")

    def name(self, t: Name, env: dict, v: Value) -> Column:
        if t.name in env:
            bound, own = env[t.name]
            return self.type(bound, own, v)
        d, own = self.names.definition(t, env)
        if d is not None:
            if t.name in self.recursive:
                raise NotColumnar(f"{t.name} is recursive")
            if not d.types:
                raise SchemaError(f"{t.name} is a group, not a type")
            return _or(*(self.type(x, own, v) for x in d.types))
        return self.kind(t.name, v)

    def kind(self, name: str, v: Value) -> Column:
        if name == "any":
            return F.lit(True)
        if name in ("uint", "unsigned"):
            return _and(v.int, v.as_int() >= 0) if v.int is not None else F.lit(False)
        if name == "nint":
            return _and(v.int, v.as_int() < 0) if v.int is not None else F.lit(False)
        if name in ("int", "integer"):
            return _and(v.int, v.as_int() <= F.lit(_LONG_MOST)) if v.int is not None else F.lit(False)
        if name.startswith("float"):
            return _or(v.float)
        if name == "number":
            return _or(v.int, v.float)
        if name in ("tstr", "text"):
            return _or(v.text)
        if name in ("bstr", "bytes"):
            return _or(v.bytes)
        if name in ("bool", "true", "false"):
            if v.bool is None:
                return F.lit(False)
            return v.bool if name == "bool" else _and(v.bool, v.as_bool() == F.lit(name == "true"))
        if name in ("nil", "null"):
            return v.null
        if name == "tdate":
            if v.text is None:
                return F.lit(False)
            s = v.as_text()
            day = F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd").isNotNull()
            clock = (F.substring(s, 12, 2).cast("int") < 24) & (F.substring(s, 15, 2).cast("int") < 60) & (F.substring(s, 18, 2).cast("int") <= 60)
            return _and(v.text, s.rlike(_DATE), day, clock)
        if name == "uri":
            return _and(v.text, v.as_text().rlike(_URI)) if v.text is not None else F.lit(False)
        if name == "b64url":
            return _and(v.text, v.as_text().rlike(_B64URL)) if v.text is not None else F.lit(False)
        if name == "time":
            return _or(_and(v.int, v.as_int().between(-8_334_601_228_800, 8_210_266_876_799)) if v.int is not None else None, _and(v.float, v.as_number().between(-8334601228800.0, 8210266876799.0)) if v.float is not None else None)
        if name.startswith("$"):
            return F.lit(False)
        raise NotColumnar(f"{name} needs the matcher")

    def range(self, t: Type1, env: dict, v: Value) -> Column:
        low, high = (self.names.one(x, env, (int, float), "a range's end") for x in (t.target, t.controller))
        if type(low) is not type(high):
            return F.lit(False)
        kind, number = (v.int, v.as_int()) if isinstance(low, int) else (_or(v.int, v.float), v.as_number())
        if kind is None:
            return F.lit(False)
        if not isinstance(v, Variant) and isinstance(low, int) and not v.is_int:
            return F.lit(False)
        if t.op == "...":
            return _and(kind, number >= _number(low), number < _number(high))
        return _and(kind, number >= _number(low), number <= _number(high))

    def control(self, t: Type1, env: dict, v: Value) -> Column:
        op, c, one = t.op, t.controller, self.names.one
        if op in (".cat", ".det", ".plus"):
            values = self.names.folded(t, env)
            if values is None:
                raise SchemaError(f"{op} needs literals")
            return _or(*(self.literal(x, v) for x in values))
        if op == ".feature":
            names = self.names.folded(c, env)
            if names is None:
                raise NotColumnar(".feature with an array")
            if self.features is not None and not any(n in self.features for n in names):
                return F.lit(False)
            return self.type2(t.target, env, v)
        target = self.type2(t.target, env, v)
        if op == ".default":
            return target
        if op in (".and", ".within"):
            return _and(target, self.type2(c, env, v))
        if op == ".eq":
            return _and(target, self.type2(c, env, v))
        if op == ".ne":
            return _and(target, ~F.coalesce(self.type2(c, env, v), F.lit(False)))
        if op in (".lt", ".le", ".gt", ".ge"):
            n = one(c, env, (int, float), op)
            x = v.as_number() if isinstance(n, float) or not isinstance(v, Variant) else v.as_number() if v.float is not None and isinstance(t.target, Name) and t.target.name not in ("int", "uint", "nint") else v.as_int()
            if v.int is None and v.float is None:
                return F.lit(False)
            m = _number(n)
            if op in (".gt", ".ge") and v.is_float:  # Spark orders NaN above all numbers
                target = _and(target, ~F.isnan(v.as_number()))
            return _and(target, {".lt": x < m, ".le": x <= m, ".gt": x > m, ".ge": x >= m}[op])
        if op == ".size":
            return _and(target, self.size(c, env, v))
        if op == ".bits":
            bits = self.names.folded(c, env)
            if bits is None or v.int is None or isinstance(v, Variant):
                raise NotColumnar(".bits on this")
            return _and(target, _or(*(F.getbit(v.as_int(), F.lit(b)) == 1 for b in bits if 0 <= b < 32)))
        if op == ".bitfield":
            total = sum(w[0] for w in self.names.parts(c, env) if w)
            return _and(target, v.int, v.as_int() >= 0, v.as_int() < _number(1 << total)) if v.int is not None and 1 <= total < 63 else self._no(op)
        if v.text is None:
            return F.lit(False)
        s = v.as_text()
        if op in (".regexp", ".pcre", ".iregexp"):
            values = self.names.folded(c, env)
            if not values:
                raise NotColumnar(op)
            return _and(target, _or(*(s.rlike(self.java(x, op)) for x in values)))
        if op in fold.ENCODERS and not op.endswith("-sloppy"):
            values = self.names.folded(c, env)
            if values is None:
                raise NotColumnar(op)
            texts = [fold.ENCODERS[op](x if isinstance(x, bytes) else str(x).encode()) for x in values]
            return _and(target, (F.lower(s) if op == ".hex" else s).isin(texts))
        if op == ".base10":
            values = self.names.folded(c, env)
            if values is None:
                raise NotColumnar(op)
            return _and(target, s.isin([str(x) for x in values]))
        if op == ".printf":
            parts = self.names.parts(c, env)
            return _and(target, s.isin([fold.printf(f, [p[0] for p in parts[1:]]) for f in parts[0]]))
        if op == ".join" and isinstance(c, ArrayOf):
            parts = [(self.names.folded(e.value, env), text_of(e.value)) for e in c.group.choices[0]]
            if all(p[0] and len(p[0]) == 1 for p in parts):
                return _and(target, s == F.lit("".join(str(p[0][0]) for p in parts)))
            if len(parts) == 2 and parts[0][0] and len(parts[0][0]) == 1 and parts[1][1] in ("tstr", "text"):
                return _and(target, s.startswith(parts[0][0][0]))
            if len(parts) == 2 and parts[1][0] and len(parts[1][0]) == 1 and parts[0][1] in ("tstr", "text"):
                return _and(target, s.endswith(parts[1][0][0]))
        if op == ".json":
            inner = Variant(parsed_json(s))
            return _and(target, inner.col.isNotNull(), self.type2(c, env, inner))
        raise NotColumnar(f"{op} needs the matcher")

    def _no(self, op: str):
        raise NotColumnar(f"{op} needs the matcher")

    @staticmethod
    def java(text: str, op: str) -> str:
        try:
            return expressions.java(text, op[1:])
        except expressions.ExpressionError as e:
            raise SchemaError(f"malformed expression: {e}") from None

    def size(self, c, env: dict, v: Value) -> Column:
        values = self.names.folded(c, env)
        if values is not None:
            hit = lambda n: n.isin([x for x in values if type(x) is int])
            most = max((x for x in values if type(x) is int), default=0)
        else:
            r = c.type.choices[0] if isinstance(c, Paren) and len(c.type.choices) == 1 else self._no(".size")
            if r.op not in ("..", "..."):
                self._no(".size")
            low, most = (self.names.one(x, env, (int,), ".size") for x in (r.target, r.controller))
            hit = (lambda n: (n >= low) & (n < most)) if r.op == "..." else (lambda n: (n >= low) & (n <= most))
        parts = []
        if v.text is not None:
            parts.append(_and(v.text, hit(F.octet_length(v.as_text()))))
        if v.bytes is not None:
            parts.append(_and(v.bytes, hit(F.octet_length(v.as_bytes()))))
        if v.int is not None:
            parts.append(_and(v.int, v.as_int() >= 0, v.as_int() < _number(256**most)) if most < 15 else _and(v.int, v.as_int() >= 0))
        return _or(*parts)

    # maps and arrays

    def members(self, group: Group, env: dict) -> list[tuple[list[tuple], tuple | None]]:
        """For each group choice its literal members (key, low, type, env) and its table (low, high, key domain, type, env)."""
        out = []
        for choice in group.choices:
            arms: list[tuple[list, tuple | None]] = [([], None)]
            for e in choice:
                if e.key is None:
                    inner, own = self.spliced(e, env)
                    arms = [(members + m, table or t) for members, table in arms for m, t in self.members(inner, own)]
                    continue
                if any(table for _, table in arms):
                    raise NotColumnar("a map entry follows a table")
                keys = self.names.folded(e.key.type, env)
                if keys and len(keys) == 1 and e.high == 1:
                    if not isinstance(keys[0], str):
                        arms = [([*members, (None, e.low, e.value, env)], table) for members, table in arms]
                        continue
                    if not e.key.cut and e.low == 0:
                        raise NotColumnar("an optional entry without a cut")
                    for members, _ in arms:
                        if any(m[0] == keys[0] for m in members):
                            raise NotColumnar("a key twice")
                        members.append((keys[0], e.low, e.value, env))
                elif text_of(e.key.type) in ("tstr", "text", "any") and e.high != 1:
                    arms = [(members, (e.low, e.high, e.key.cut, e.value, env)) for members, _ in arms]
                else:
                    raise NotColumnar("an entry with a typed key")
            out += arms
        return out

    def spliced(self, e, env: dict) -> tuple[Group, dict]:
        if e.low != 1 or e.high != 1:
            raise NotColumnar("a group with an occurrence")
        if isinstance(e.value, Group):
            return e.value, env
        target = e.value.choices[0].target
        if len(e.value.choices) == 1 and isinstance(target, Name) and target.name not in self.recursive:
            return self.names.group_of(target, env)
        raise NotColumnar(f"{text_of(e)} in a map needs the matcher")

    def map(self, group: Group, env: dict, v: Value) -> Column:
        arms = self.members(group, env)
        if isinstance(v, Variant):
            return _and(v.schema.startswith("OBJECT<"), _or(*(self.variant_map(m, t, v) for m, t in arms)))
        if isinstance(v.kind, T.StructType):
            return _and(v.col.isNotNull(), _or(*(self.struct(m, t, v) for m, t in arms)))
        if isinstance(v.kind, T.MapType) and isinstance(v.kind.keyType, T.StringType):
            return _and(v.col.isNotNull(), _or(*(self.map_column(m, t, v.col, v.kind.valueType) for m, t in arms)))
        return F.lit(False)

    def variant_map(self, members: list, table: tuple | None, v: Variant) -> Column:
        pairs = F.try_variant_get(v.col, "$", "map<string,variant>")
        if v.inner:
            return _bound(pairs, lambda p: self.map_column(members, table, p, T.VariantType(), True))
        return self.map_column(members, table, pairs, T.VariantType())

    def map_column(self, members: list, table: tuple | None, pairs: Column, kind: T.DataType, inner: bool = False) -> Column:
        wrap = lambda col, inner=inner: Variant(col, inner) if isinstance(kind, T.VariantType) else Value(col, kind)
        parts = []
        for key, low, t, env in members:
            if key is None:
                if low:
                    return F.lit(False)
                continue
            there = F.map_contains_key(pairs, F.lit(key))
            good = F.coalesce(self.type(t, env, wrap(F.try_element_at(pairs, F.lit(key)))), F.lit(False))
            parts.append(there & good if low else ~there | good)
        known = [m[0] for m in members if m[0] is not None]
        rest = F.map_filter(pairs, lambda k, _: ~k.isin(known)) if known else pairs
        if table is None:
            parts.append(F.size(rest) == 0)
        else:
            low, high, _, t, env = table
            parts.append(F.forall(F.map_values(rest), lambda x: F.coalesce(self.type(t, env, wrap(x, True)), F.lit(False))))
            parts += [F.size(rest) >= low] if low else []
            parts += [F.size(rest) <= high] if high is not None else []
        return _and(*parts)

    def struct(self, members: list, table: tuple | None, v: Value) -> Column:
        parts = []
        fields = {f.name: Value(v.col[f.name], f.dataType) for f in v.kind.fields}
        known = set()
        for key, low, t, env in members:
            known.add(key)
            if key not in fields:
                if low:
                    return F.lit(False)
                continue
            own = fields[key]
            good = self.type(t, env, own)
            parts.append(_and(own.col.isNotNull(), good) if low else own.col.isNull() | F.coalesce(good, F.lit(False)))
        rest = [f for n, f in fields.items() if n not in known]
        if table is None:
            parts += [f.col.isNull() for f in rest]
        else:
            low, high, _, t, env = table
            parts += [f.col.isNull() | F.coalesce(self.type(t, env, f), F.lit(False)) for f in rest]
            count = sum((f.col.isNotNull().cast("int") for f in rest), F.lit(0))
            parts += [count >= low] if low else []
            parts += [count <= high] if high is not None else []
        return _and(F.lit(True), *parts)

    def array(self, group: Group, env: dict, v: Value) -> Column:
        if isinstance(v, Variant):
            items, kind, there = F.try_variant_get(v.col, "$", "array<variant>"), T.VariantType(), v.schema.startswith("ARRAY<")
        elif isinstance(v.kind, T.ArrayType):
            items, kind, there = v.col, v.kind.elementType, v.col.isNotNull()
        else:
            return F.lit(False)
        within = isinstance(v, Variant) and v.inner
        wrap = lambda col, inner=within: Variant(col, inner) if isinstance(kind, T.VariantType) else Value(col, kind)
        fixed, repeated = [], None
        for e in group.choices[0] if len(group.choices) == 1 else ():
            if isinstance(e.value, Group) or self.is_group(e.value, env) or repeated is not None:
                return self.sequence(group, env, items, there, wrap)
            if e.low == e.high:
                fixed += [e.value] * min(e.low, 1000)
                if len(fixed) > 64 and len(group.choices[0]) > 1:
                    return self.sequence(group, env, items, there, wrap)
            else:
                repeated = e
        if len(group.choices) != 1 or len(fixed) == 1000:
            return self.sequence(group, env, items, there, wrap)
        n = F.size(items)
        if repeated is None and fixed and all(t is fixed[0] for t in fixed):
            return _and(there, n == len(fixed), F.forall(items, lambda x: F.coalesce(self.type(fixed[0], env, wrap(x, True)), F.lit(False))))
        parts = [F.coalesce(self.type(t, env, wrap(F.get(items, F.lit(i)))), F.lit(False)) for i, t in enumerate(fixed)]
        if repeated is None:
            return _and(there, n == len(fixed), *parts)
        tail = F.slice(items, len(fixed) + 1, F.greatest(n - len(fixed), F.lit(0))) if fixed else items
        parts += [F.forall(tail, lambda x: F.coalesce(self.type(repeated.value, env, wrap(x, True)), F.lit(False))), n >= len(fixed) + repeated.low]
        if repeated.high is not None:
            parts.append(n <= len(fixed) + repeated.high)
        return _and(there, *parts)

    # arrays whose entries are groups: an expression gives where a part that begins at a place ends, null where it doesn't match

    def sequence(self, group: Group, env: dict, items: Column, there: Column, wrap) -> Column:
        """Whether all items match. Places are bound by lambdas, so each part's check is in the expression once."""
        choices = self.entries(group, env)
        ends = lambda xs: _bound(F.size(xs), lambda n: F.coalesce(self.choice(choices, xs, n, F.lit(0), wrap) == n, F.lit(False)))
        return _and(there, _bound(items, ends))

    def entries(self, group: Group, env: dict) -> list[list[tuple]]:
        """Group choices as lists of (low, high, type, env) and (low, high, choices)."""
        return [[self.entry(e, env) for e in choice] for choice in group.choices]

    def entry(self, e, env: dict) -> tuple:
        if isinstance(e.value, Group):
            if e.key is not None:
                raise NotColumnar("a key is followed by a group")
            return e.low, e.high, self.entries(e.value, env)
        c = e.value.choices[0]
        if e.key is None and len(e.value.choices) == 1 and c.op is None:
            if isinstance(c.target, Paren):
                return self.entry(Entry(e.low, e.high, None, c.target.type), env)
            if isinstance(c.target, Name) and c.target.name in env:
                bound, own = env[c.target.name]
                return self.entry(Entry(e.low, e.high, None, bound), own)
            name = c.target.name if isinstance(c.target, Unwrap) else c.target if isinstance(c.target, Name) else None
            d = self.symbols.table.get(name.name) if name is not None else None
            if d is not None and name.name in self.recursive:
                raise NotColumnar(f"{name.name} is recursive")
            if isinstance(c.target, Unwrap):
                d, own = self.names.definition(c.target.name, env)
                inner = d.types[0].choices[0].target if d is not None and d.types else None
                if isinstance(inner, ArrayOf) and inner.group is not None:
                    return e.low, e.high, self.entries(inner.group, own)
                raise NotColumnar("an unwrapped type that is no array")
            if d is not None and d.entries:
                group, own = self.names.group_of(c.target, env)
                return e.low, e.high, self.entries(group, own)
            if d is None and name is not None and name.name.startswith("$$"):
                return 0, e.high, []
        return e.low, e.high, e.value, env

    def choice(self, choices: list[list[tuple]], items: Column, n: Column, at: Column, wrap) -> Column:
        """Where the first choice that matches from ``at`` on ends."""
        ends = [self.parts_in_order(c, items, n, at, wrap) for c in choices]
        return F.coalesce(*ends) if ends else F.lit(None).cast("int")

    def parts_in_order(self, parts: list[tuple], items: Column, n: Column, at: Column, wrap) -> Column:
        if not parts:
            return at
        end = self.times(parts[0], items, n, at, wrap)
        return end if len(parts) == 1 else _bound(end, lambda x: F.when(x.isNotNull(), self.parts_in_order(parts[1:], items, n, x, wrap)))

    def once(self, part: tuple, items: Column, n: Column, at: Column, wrap) -> Column:
        if len(part) == 3:
            return self.choice(part[2], items, n, at, wrap)
        return F.when((at < n) & F.coalesce(self.type(part[2], part[3], wrap(F.get(items, at))), F.lit(False)), at + 1)

    def times(self, part: tuple, items: Column, n: Column, at: Column, wrap) -> Column:
        """Where a part that is repeated as often as it matches ends; what it doesn't move it repeats without end."""
        low, high = part[0], part[1]
        if (low, high) == (1, 1):
            return self.once(part, items, n, at, wrap)
        if (low, high) == (0, 1):
            return F.coalesce(self.once(part, items, n, at, wrap), at)
        if high == 0:
            return at
        most = n - at + 1 if high is None else F.least(n - at + 1, F.lit(high))

        def step(state: Column, _) -> Column:
            stopped = F.struct(state["at"].alias("at"), state["count"].alias("count"), F.lit(False).alias("more"))
            move = lambda end: F.when(end.isNull(), stopped).when(end == state["at"], F.struct(end.alias("at"), F.greatest(state["count"] + 1, F.lit(low)).alias("count"), F.lit(False).alias("more"))).otherwise(F.struct(end.alias("at"), (state["count"] + 1).alias("count"), F.lit(True).alias("more")))
            return F.when(state["more"], _bound(self.once(part, items, n, state["at"], wrap), move)).otherwise(state)

        start = F.struct(at.cast("int").alias("at"), F.lit(0).alias("count"), F.lit(True).alias("more"))
        return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: F.when(s["count"] >= low, s["at"]))

    def is_group(self, t: Type, env: dict) -> bool:
        c = t.choices[0]
        if len(t.choices) == 1 and c.op is None and isinstance(c.target, Paren):
            return self.is_group(c.target.type, env)
        if len(t.choices) != 1 or c.op is not None or not isinstance(c.target, Name):
            return isinstance(c.target, Unwrap)
        if c.target.name in env:
            return self.is_group(env[c.target.name][0], env[c.target.name][1])
        d = self.symbols.table.get(c.target.name)
        return d is not None and d.is_group
