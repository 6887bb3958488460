"""A schema, and what can be derived from it on the driver."""

from __future__ import annotations

import random
import re
from bisect import bisect_right

from pyspark.sql import types as T

from .functions import fold
from .operators.matcher import Compiler, run
from .plans import analysis
from .plans.syntax import ArrayOf, Enum, Group, Literal, Major, MapOf, Name, Paren, Tagged, Type, Type1, Unwrap, comments, parse, text_of
from .sources.values import Map, Tag, from_json, to_json

DEEPEST, NODES, REPEATS = 32, 5000, 64


class Schema:
    """A parsed schema; a plain object that can be sent to executors."""

    def __init__(self, text: str, check_refs: bool = True):
        self.text = text
        self.rules = parse(text)
        self.symbols = analysis.Symbols(self.rules)
        missing = self.symbols.undefined() if check_refs else []
        if missing:
            raise analysis.SchemaError("; ".join(f"rule {r.name} refers to {n}, which isn't defined" for r, n in missing))

    parse = classmethod(lambda cls, text, check_refs=True: cls(text, check_refs))

    def __reduce__(self):
        return Schema, (self.text, False)

    @property
    def root_name(self) -> str:
        return self.symbols.root()

    def root_candidates(self) -> list[str]:
        return self.symbols.root_candidates()

    def to_text(self, comments: bool = True) -> str:
        """The schema again, a rule a line; comments in a rule stand above it, those at the end of its last line behind it."""
        above, behind, end = _comments_of(self.text, [r.at for r in self.rules]) if comments else ({}, {}, [])
        lines = []
        for i, r in enumerate(self.rules):
            lines += above.get(i, [])
            lines.append(text_of(r) + "".join(f" {c}" for c in behind.get(i, [])))
        return "\n".join([*lines, *end]) + "\n"

    @staticmethod
    def diagnose(text: str, check_refs: bool = True) -> list[tuple[int, int, str]]:
        """(line, column, message) of all errors."""
        return analysis.diagnose(text, check_refs)

    def lint(self) -> list[tuple[str, str, str]]:
        """(kind, rule, message) of what looks wrong."""
        return analysis.lint(self.text)

    def compiled(self, model: str = "json", root: str | None = None, features: list[str] | None = None):
        """A function value -> (valid, errors)."""
        check = Compiler(self.symbols, model, features).root(root)
        return lambda value: run(check, value)

    # types of rows

    def to_struct_types(self, any_type: T.DataType | None = None, substitute: dict[str, T.DataType] | None = None) -> dict[str, T.DataType]:
        """A Spark type for each type rule without parameters."""
        names = dict.fromkeys(r.name for r in self.rules if not r.params and isinstance(r.body, Type))
        return {n: self.to_struct_type(n, any_type, substitute) for n in names}

    def to_struct_type(self, rule: str | None = None, any_type: T.DataType | None = None, substitute: dict[str, T.DataType] | None = None) -> T.DataType:
        """The Spark type of a rule; what no one type can hold is ``any_type``, VARIANT by default.

        Fields have their comment, and the values of a choice of literals (byte strings as hex digits), as metadata.
        """
        return _Types(self, any_type or T.VariantType(), substitute or {}).name(Name(rule or self.root_name), {}, frozenset())[0]

    # samples

    def sample(self, n: int = 1, seed: int = 0, root: str | None = None, model: str = "json", features: list[str] | None = None, tries: int = 200) -> list:
        """n values that match; fewer where ``tries`` draws for each don't give one."""
        draw = self.sampler(root, model, features, tries)
        return [v for v, _ in draw(n, seed)]

    def sampler(self, root: str | None = None, model: str = "json", features: list[str] | None = None, tries: int = 200):
        """A function (n, seed) -> sample()'s values with their JSON text (None in other models), which is made ready once for all seeds."""
        check = self.compiled(model, root, features)
        names, start, rng = Compiler(self.symbols, model, features), Name(root or self.root_name), random.Random()
        sampler = _Sampler(names, rng, model)

        def draw(n: int, seed: int) -> list[tuple[object, str | None]]:
            rng.seed(seed)
            out = []
            for _ in range(n):
                for _ in range(tries):
                    try:
                        value, text = sampler.drawn(start), None
                        if model == "json":
                            value = from_json(to_json(value))
                    except (_Dead, ValueError, TypeError, RecursionError):
                        continue
                    if check(value)[0]:
                        out.append((value, to_json(value) if model == "json" else None))
                        break
            return out

        return draw

    def sample_json(self, n: int = 1, seed: int = 0, **how) -> list[str]:
        return [to_json(v) for v in self.sample(n, seed, **how)]


#: Names of the prelude and the Spark types that hold them.
_SPARK = {
    "uint": T.DecimalType(20, 0), "unsigned": T.DecimalType(20, 0), "nint": T.LongType(), "int": T.LongType(), "integer": T.LongType(), "time": T.LongType(),
    "float": T.DoubleType(), "float16": T.DoubleType(), "float32": T.DoubleType(), "float64": T.DoubleType(), "float16-32": T.DoubleType(), "float32-64": T.DoubleType(), "number": T.DoubleType(),
    "tstr": T.StringType(), "text": T.StringType(), "tdate": T.StringType(), "uri": T.StringType(), "b64url": T.StringType(), "regexp": T.StringType(), "b64legacy": T.StringType(), "mime-message": T.StringType(),
    "bstr": T.BinaryType(), "bytes": T.BinaryType(), "biguint": T.BinaryType(), "bignint": T.BinaryType(), "bigint": T.BinaryType(), "encoded-cbor": T.BinaryType(),
    "bool": T.BooleanType(), "true": T.BooleanType(), "false": T.BooleanType(), "nil": T.NullType(), "null": T.NullType(), "undefined": T.NullType(),
    "decfrac": T.StructType([T.StructField("e10", T.LongType()), T.StructField("m", T.LongType())]), "bigfloat": T.StructType([T.StructField("e2", T.LongType()), T.StructField("m", T.LongType())]),
}


def _comments_of(text: str, starts: list[int]) -> tuple[dict[int, list[str]], dict[int, list[str]], list[str]]:
    """Comments above each rule, behind it, and behind all rules."""
    above: dict[int, list[str]] = {}
    behind: dict[int, list[str]] = {}
    end: list[str] = []
    found = [m for m in re.finditer(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|;[^\n]*', text) if m[0].startswith(";")]
    bare = list(text)
    for m in found:
        bare[m.start() : m.end()] = " " * (m.end() - m.start())
    plain = "".join(bare)
    for m in found:
        i = bisect_right(starts, m.start()) - 1
        until = starts[i + 1] if i + 1 < len(starts) else len(text)
        comment = m[0].rstrip()
        if i >= 0 and plain[m.end() : until].strip():
            above.setdefault(i, []).append(comment)
        elif i >= 0 and plain[plain.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
            behind.setdefault(i, []).append(comment)
        elif i + 1 < len(starts):
            above.setdefault(i + 1, []).append(comment)
        else:
            end.append(comment)
    return above, behind, end


class _Types:
    """(type, whether null is one of its values) of nodes."""

    def __init__(self, schema: Schema, any_type: T.DataType, substitute: dict[str, T.DataType]):
        self.any, self.substitute = any_type, substitute
        self.names = Compiler(schema.symbols, "cbor")
        self.recursive = schema.symbols.recursive()
        self.comments = comments(schema.text)

    def name(self, t: Name, env: dict, seen: frozenset) -> tuple[T.DataType, bool]:
        if t.name in self.substitute:
            return self.substitute[t.name], False
        if t.name in env:
            bound, own = env[t.name]
            return self.type(bound, own, seen)
        d, own = self.names.definition(t, env)
        if d is None:
            return _SPARK.get(t.name, self.any), t.name in ("nil", "null")
        if t.name in self.recursive and t.name in seen:
            return self.any, False
        if d.is_group and not d.types:
            return self.struct(self.names.group_of(t, env)[0], own, seen | {t.name}), False
        return self.merged([self.type(x, own, seen | {t.name}) for x in d.types])

    def type(self, t: Type, env: dict, seen: frozenset) -> tuple[T.DataType, bool]:
        return self.merged([self.type1(c, env, seen) for c in t.choices])

    def merged(self, found: list[tuple[T.DataType, bool]]) -> tuple[T.DataType, bool]:
        null = any(n for _, n in found)
        kinds = [k for k, _ in found if not isinstance(k, T.NullType)]
        if not kinds:
            return T.NullType(), True
        return (kinds[0] if all(k == kinds[0] for k in kinds) else self.any), null

    def type1(self, t: Type1, env: dict, seen: frozenset) -> tuple[T.DataType, bool]:
        if t.op == ".bitfield":
            return T.DecimalType(20, 0), False
        return self.type2(t.target, env, seen)

    def type2(self, t, env: dict, seen: frozenset) -> tuple[T.DataType, bool]:
        if isinstance(t, Literal):
            return {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType()}[type(t.value)], False
        if isinstance(t, Name):
            return self.name(t, env, seen)
        if isinstance(t, Paren):
            return self.type(t.type, env, seen)
        if isinstance(t, Tagged):
            return self.type(t.type, env, seen)
        if isinstance(t, Unwrap):
            return self.name(t.name, env, seen)
        if isinstance(t, Enum):
            group, own = self.names.group_of(t.group, env)
            return self.merged([self.type(e.value, own, seen) if isinstance(e.value, Type) else (self.any, False) for c in group.choices for e in c])
        if isinstance(t, MapOf):
            return self.struct(t.group, env, seen), False
        if isinstance(t, ArrayOf):
            entries = t.group.choices[0] if len(t.group.choices) == 1 else ()
            if len(entries) == 1 and isinstance(entries[0].value, Type):
                e = entries[0]
                if (e.low, e.high) != (1, 1):
                    kind, null = self.type(e.value, env, seen)
                    return T.ArrayType(kind, null), False
            return T.ArrayType(self.any, True), False
        if isinstance(t, Major):
            return {0: T.DecimalType(20, 0), 1: T.LongType(), 2: T.BinaryType(), 3: T.StringType()}.get(t.major, self.any), False
        return self.any, False

    def struct(self, group: Group, env: dict, seen: frozenset) -> T.DataType:
        if len(group.choices) != 1:
            return self.any
        entries = group.choices[0]
        if len(entries) == 1 and entries[0].key is not None and entries[0].high != 1:
            key, _ = self.type1(entries[0].key.type, env, seen)
            value, null = self.type(entries[0].value, env, seen)
            return T.MapType(key, value, null)
        fields: list[T.StructField] = []
        for e in entries:
            if e.key is None:
                inner, own = (e.value, env) if isinstance(e.value, Group) else self._spliced(e, env)
                kind = self.struct(inner, own, seen) if inner is not None else None
                if not isinstance(kind, T.StructType):
                    return self.any
                fields += [T.StructField(f.name, f.dataType, f.nullable or e.low == 0) for f in kind.fields]
                continue
            keys = self.names.folded(e.key.type, env)
            if not keys or len(keys) != 1 or e.high != 1 or not isinstance(e.value, Type):
                key, _ = self.type1(e.key.type, env, seen)
                fields.append(T.StructField("extra", T.MapType(key, self.any, True), True))
                continue
            kind, null = self.type(e.value, env, seen)
            about = {"comment": self.comments[e]} if e in self.comments else {}
            values = self.names.folded(e.value, env)
            if values and len(values) > 1:
                about["values"] = [v.hex() if isinstance(v, bytes) else v for v in values]
            fields.append(T.StructField(str(keys[0]), kind, null or e.low == 0, about or None))
        if len({f.name for f in fields}) < len(fields):
            return self.any
        return T.StructType(fields)

    def _spliced(self, e, env: dict):
        target = e.value.choices[0].target if len(e.value.choices) == 1 else None
        if isinstance(target, Unwrap):
            d, own = self.names.definition(target.name, env)
            inner = d.types[0].choices[0].target if d is not None and d.types else None
            return (inner.group, own) if isinstance(inner, MapOf) else (None, env)
        if isinstance(target, Name):
            try:
                return self.names.group_of(target, env)
            except analysis.SchemaError:
                return None, env
        return None, env


class _Dead(Exception):
    """A draw that can't be completed."""


def _pick(r: random.Random, some):
    return some[int(r.random() * len(some))] if len(some) > 1 else some[0]


def _word(r: random.Random) -> str:
    return "".join(r.choices("abcdefghij klmno", k=int(r.random() * 12)))


_COUNTS = (0, 1, 23, 24, 255, 256, 65536)


def _count(r: random.Random) -> int:
    k = int(r.random() * 8)
    return _COUNTS[k] if k < 7 else int(r.random() * (1 << 31))


#: What is drawn for the prelude's names; nothing that isn't used is drawn, as tables take many samples.
_BUILTIN = {
    "uint": _count, "unsigned": _count, "integer": _count, "time": _count, "nint": lambda r: -1 - _count(r), "int": lambda r: _pick(r, (1, -1)) * _count(r), "number": lambda r: _count(r) + _pick(r, (0, 0.5)), "tstr": _word, "text": _word,
    "bool": lambda r: r.random() < 0.5, "true": lambda r: True, "false": lambda r: False, "nil": lambda r: None, "null": lambda r: None, "any": lambda r: _pick(r, (_count, _word, lambda r: True, lambda r: None))(r),
    "tdate": lambda r: f"20{r.randrange(10, 40)}-0{r.randrange(1, 10)}-1{r.randrange(10)}T0{r.randrange(10)}:00:00Z", "uri": lambda r: f"http://example.org/{_count(r)}", "b64url": lambda r: fold.base64_text(_word(r).encode(), True),
    "bstr": lambda r: _word(r).encode(), "bytes": lambda r: _word(r).encode(), "biguint": lambda r: Tag(2, b"\1" + bytes(8)), "bignint": lambda r: Tag(3, b"\1" + bytes(8)), "bigint": lambda r: Tag(2, b"\1" + bytes(8)),
    "encoded-cbor": lambda r: Tag(24, b"\0"), "regexp": lambda r: Tag(35, "a+"),
}


def _dead(depth: int):
    raise _Dead


class _Sampler:
    """Draws values: each node is made a function of its depth once, which is then called for every value."""

    def __init__(self, names: Compiler, rng: random.Random, model: str):
        self.names, self.rng, self.model, self.nodes = names, rng, model, 0
        self.known: dict = {}

    def drawn(self, t: Name):
        self.nodes = 0
        return self.name(t, {})(0)

    def spend(self, depth: int) -> None:
        self.nodes += 1
        if depth > DEEPEST or self.nodes > NODES:
            raise _Dead

    @staticmethod
    def made(make, *args):
        """A node's function; one of which none can be made ends the draws that come to it."""
        try:
            return make(*args)
        except (_Dead, ValueError, TypeError):
            return _dead

    def spending(self, inner, deeper: int = 0):

        def draw(depth: int):
            self.nodes += 1
            if depth > DEEPEST or self.nodes > NODES:
                raise _Dead
            return inner(depth + deeper)

        return draw

    def name(self, t: Name, env: dict):
        if t.name in env:
            return self.spending(self.made(self.type, *env[t.name]))
        if not t.args and t.name in self.known:
            return self.known[t.name]
        d, own = self.names.definition(t, env)
        if d is None:
            draw = self.spending(self.builtin(t.name))
        elif not d.types:
            draw = _dead
        else:
            arms: list = []

            def inner(depth: int):
                these = arms or [self.made(self.type, x, own) for x in d.types]
                if not arms and not t.args:  # generics may grow without end
                    arms.extend(these)
                return _pick(self.rng, these)(depth)

            draw = self.spending(inner, 1)
        if not t.args:
            self.known[t.name] = draw
        return draw

    def builtin(self, name: str):
        r = self.rng
        if name.startswith("float"):
            return lambda depth: _count(r) + 0.5
        if name not in _BUILTIN:
            return _dead
        of = _BUILTIN[name]
        return lambda depth: of(r)

    def type(self, t: Type, env: dict):
        arms = [self.made(self.type1, c, env) for c in t.choices]
        return arms[0] if len(arms) == 1 else lambda depth: _pick(self.rng, arms)(depth)

    def type1(self, t: Type1, env: dict):
        r = self.rng
        if t.op is None or t.op in (".default", ".feature", ".within", ".and", ".ne", ".regexp", ".pcre", ".iregexp", ".abnf", ".abnfb"):
            return self.type2(t.target, env)
        if t.op in ("..", "..."):
            low, high = (self.names.one(x, env, (int, float), t.op) for x in (t.target, t.controller))
            if isinstance(low, float):
                return lambda depth: r.uniform(low, high)
            last = high - (t.op == "...")
            draws = (lambda: low, lambda: last, lambda: r.randint(low, last))
            return lambda depth: _pick(r, draws)()
        values = self.names.folded(t.controller, env) if t.op != ".size" else None
        if t.op in (".cat", ".det", ".plus"):
            some = self.names.folded(t, env) or [None]
            return lambda depth: _pick(r, some)
        if t.op == ".eq":
            return self.type2(t.controller, env)
        if t.op in (".lt", ".le", ".gt", ".ge") and values:
            bound = values[0] + {".lt": -1, ".le": 0, ".gt": 1, ".ge": 0}[t.op]
            return lambda depth: bound
        if t.op == ".size":
            size, target = self.type2(t.controller, env), self.type2(t.target, env)

            def sized(depth: int):
                n, v = size(depth), target(depth)
                return "x" * n if isinstance(v, str) else b"x" * n if isinstance(v, bytes) else r.randrange(256**n)

            return sized
        if t.op == ".bits" and values:
            return lambda depth: 1 << _pick(r, values)
        if t.op in fold.ENCODERS and values:
            text = fold.ENCODERS[t.op](values[0] if isinstance(values[0], bytes) else str(values[0]).encode())
            return lambda depth: text
        if t.op == ".base10" and values:
            return lambda depth: str(_pick(r, values))
        if t.op == ".printf":
            parts = self.names.parts(t.controller, env)
            shown = fold.printf(parts[0][0], [p[0] for p in parts[1:]])
            return lambda depth: shown
        if t.op == ".json":
            inner = self.type2(t.controller, env)
            return lambda depth: to_json(inner(depth))
        if t.op in (".cbor", ".cborseq"):
            from .sources.values import to_cbor

            inner = self.type2(t.controller, env)
            return (lambda depth: to_cbor(inner(depth))) if t.op == ".cbor" else lambda depth: b"".join(map(to_cbor, inner(depth)))
        if t.op == ".join":
            joined = [self.made(self.type, e.value, env) for e in t.controller.group.choices[0]]
            return lambda depth: "".join(str(f(depth)) for f in joined)
        return self.type2(t.target, env)

    def type2(self, t, env: dict):
        if isinstance(t, Type):
            return self.spending(self.type(t, env))
        if isinstance(t, Literal):
            return self.spending(lambda depth: t.value)
        if isinstance(t, Name):
            return self.spending(self.name(t, env), 1)
        if isinstance(t, Paren):
            return self.spending(self.type(t.type, env))
        if isinstance(t, Enum):
            group, own = self.names.group_of(t.group, env)
            arms = [self.made(self.type, e.value, own) for c in group.choices for e in c]
            return self.spending(lambda depth: _pick(self.rng, arms)(depth), 1)
        if isinstance(t, Unwrap):
            return self.spending(self.name(t.name, env), 1)
        if isinstance(t, Tagged):
            inner = self.type(t.type, env)
            return self.spending(lambda depth: Tag(t.number or 0, inner(depth)), 1)
        if isinstance(t, ArrayOf):
            inner = self.entries(t.group, env, "array")
            return self.spending(lambda depth: [v for _, v in inner(depth)], 1)
        if isinstance(t, MapOf):
            inner = self.entries(t.group, env, "map")
            return self.spending(lambda depth: Map(tuple(inner(depth))), 1)
        if isinstance(t, Major) and t.major is None:
            return self.spending(self.builtin("any"))
        return _dead

    def entries(self, group: Group, env: dict, where: str):
        """A function of depth that draws a list of (key, value)."""
        r, spend, arms = self.rng, self.spend, []

        def draw(depth: int) -> list[tuple]:
            if not arms:
                arms.extend([self.entry(e, env, where) for e in c] for c in group.choices)
            out: list[tuple] = []
            for low, more, sub, key, value in _pick(r, arms):
                for _ in range(low + int(r.random() * (more + 1)) if more > 0 and depth < 8 else low):
                    spend(depth)
                    if sub is not None:
                        out += sub(depth + 1)
                    else:
                        out.append((None if key is None else key(depth), value(depth + 1)))
            return out

        return draw

    def entry(self, e, env: dict, where: str) -> tuple:
        """The least number, how many more, and functions of what is drawn: entries, or a key and a value."""
        high = min(e.high if e.high is not None else e.low + 3, e.low + 3, REPEATS)
        sub = self.made(self.group, e, env, where)
        if sub is not None:
            return e.low, high - e.low, sub, None, None
        key = self.made(self.type1, e.key.type, env) if e.key is not None and where == "map" else None
        return e.low, high - e.low, None, key, self.made(self.type, e.value, env)

    def group(self, e, env: dict, where: str):
        """The entries of a group in an entry's place, or None where it is a value."""
        if isinstance(e.value, Group):
            return self.entries(e.value, env, where)
        target = e.value.choices[0].target
        if e.key is not None or isinstance(target, Name) and target.name in env:
            return None
        if isinstance(target, Name):
            d = self.names.definition(target, env)[0]
            return self.once(target, where, False, lambda: self.names.group_of(target, env)) if d is not None and d.is_group else None
        if isinstance(target, Unwrap):
            d, own = self.names.definition(target.name, env)
            return self.once(target.name, where, True, lambda: (d.types[0].choices[0].target.group, own)) if d is not None else _dead
        return None

    def once(self, t: Name, where: str, bare: bool, group):
        """entries() of a named group, the same for all that name it."""
        key = (t.name, where, bare)
        if t.args or key not in self.known:
            draw = self.entries(*group(), where)
            if t.args:
                return draw
            self.known[key] = draw
        return self.known[key]
