"""Text of an RFC 8610 schema to its syntax tree, by recursive descent.

An entry's first type is parsed once; only then is it looked whether ``=>`` or ``:`` makes it a key. So nesting costs linear time.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field

INFINITE = None


class SchemaSyntaxError(ValueError):
    """A schema that doesn't parse; has line and column (from 1) and a short reason."""

    def __init__(self, short: str, text: str, at: int):
        self.short, self.position = short, at
        self.line = text.count("\n", 0, at) + 1
        self.column = at - (text.rfind("\n", 0, at) + 1) + 1
        self.extended = f"{short}; near {text[at : at + 24]!r}" if at < len(text) else f"{short}; at the end"
        super().__init__(f"line {self.line}, column {self.column}: {self.extended}")


@dataclass(frozen=True)
class Literal:
    """int, float, str or bytes."""

    value: int | float | str | bytes


@dataclass(frozen=True)
class Name:
    name: str
    args: tuple["Type", ...] = ()


@dataclass(frozen=True)
class MapOf:
    group: "Group"


@dataclass(frozen=True)
class ArrayOf:
    group: "Group"


@dataclass(frozen=True)
class Paren:
    type: "Type"


@dataclass(frozen=True)
class Unwrap:
    name: Name


@dataclass(frozen=True)
class Enum:
    """``&`` before a group or its name."""

    group: "Group | Name"


@dataclass(frozen=True)
class Tagged:
    """``#6.n(t)``; number is None for any, or a type."""

    number: "int | Type | None"
    type: "Type"


@dataclass(frozen=True)
class Major:
    """``#n.m``, or ``#`` for anything."""

    major: int | None
    argument: int | None


@dataclass(frozen=True)
class Type1:
    target: object
    op: str | None = None
    controller: object = None


@dataclass(frozen=True)
class Type:
    choices: tuple[Type1, ...]


@dataclass(frozen=True)
class Key:
    type: Type1
    cut: bool


@dataclass(frozen=True)
class Entry:
    low: int
    high: int | None
    key: Key | None
    value: "Type | Group"


@dataclass(frozen=True)
class Group:
    choices: tuple[tuple[Entry, ...], ...]


@dataclass(frozen=True)
class Rule:
    name: str
    params: tuple[str, ...]
    op: str  # "=", "/=" or "//="
    body: Type | Entry  # an Entry makes it a group rule
    at: int = field(compare=False, default=0)


_SPACE = re.compile(r"(?:[ \t\r\n]|;[^\n]*(?:\n|\Z))*")
_ID = re.compile(r"[A-Za-z@_$](?:[-.]*[A-Za-z0-9@_$])*")
_INT = r"0x[0-9A-Fa-f]+|0b[01]+|[0-9]+"
_NUMBER = re.compile(rf"-?(?:0x[0-9A-Fa-f]+(?:\.[0-9A-Fa-f]+)?[pP][+-]?[0-9]+|0x[0-9A-Fa-f]+|0b[01]+|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)")
_OCCUR = re.compile(rf"({_INT})?\*({_INT})?|\+|\?")
_CONTROL = re.compile(r"\.[A-Za-z@_$](?:[-.]*[A-Za-z0-9@_$])*")
_TEXT = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_BYTES = re.compile(r"(h|b64)?'((?:[^'\\]|\\.)*)'", re.S)
_ESCAPE = re.compile(r"\\(u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|.)", re.S)
_SIMPLE = {'"': '"', "'": "'", "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _number(text: str) -> int | float:
    if "p" in text.lower() and "0x" in text:
        return float.fromhex(text)
    if "0x" in text or "0b" in text:
        return int(text, 0)
    return float(text) if re.search(r"[.eE]", text) else int(text)


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        s = m[1]
        if s[0] == "u" and len(s) > 1:
            return chr(int(s.strip("u{}"), 16))
        if s not in _SIMPLE:
            raise ValueError(f"unknown escape \\{s}")
        return _SIMPLE[s]

    out = _ESCAPE.sub(one, text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16")


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.spots: list[tuple[int, int, Entry]] = []  # entries with keys, and where they begin and end

    def fail(self, short: str, at: int | None = None):
        raise SchemaSyntaxError(short, self.text, self.at if at is None else at)

    def space(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def looking(self, token: str) -> bool:
        self.space()
        return self.text.startswith(token, self.at)

    def take(self, token: str) -> bool:
        if self.looking(token):
            self.at += len(token)
            return True
        return False

    def expect(self, token: str) -> None:
        if not self.take(token):
            self.fail(f"expected {token!r}")

    def match(self, pattern: re.Pattern) -> re.Match | None:
        self.space()
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def rules(self) -> list[Rule]:
        out = []
        self.space()
        while self.at < len(self.text):
            out.append(self.rule())
            self.space()
        return out

    def rule(self) -> Rule:
        self.space()
        start = self.at
        m = self.match(_ID) or self.fail("expected a rule's name")
        params: list[str] = []
        if self.text.startswith("<", self.at):
            self.at += 1
            while True:
                params.append((self.match(_ID) or self.fail("expected a parameter's name"))[0])
                if not self.take(","):
                    break
            self.expect(">")
        op = next((o for o in ("//=", "/=", "=") if self.take(o)), None) or self.fail("expected '=', '/=' or '//='")
        body_at = self.at
        entry = self.entry()
        plain = entry.low == entry.high == 1 and entry.key is None
        if op == "//=":
            body = entry
        elif plain and isinstance(entry.value, Type):
            body = entry.value
        elif op == "/=":
            self.fail("a type choice can't be a group", body_at)
        else:
            body = entry
        return Rule(m[0], tuple(params), op, body, start)

    def type(self) -> Type:
        choices = [self.type1()]
        while self.slash():
            choices.append(self.type1())
        return Type(tuple(choices))

    def slash(self) -> bool:
        """A single slash; two part group choices, and one with '=' begins an augmenting rule's sign."""
        self.space()
        if self.text.startswith("/", self.at) and not self.text.startswith(("//", "/="), self.at):
            self.at += 1
            return True
        return False

    def type1(self) -> Type1:
        target = self.type2()
        return self.operated(target)

    def operated(self, target) -> Type1:
        self.space()
        for op in ("...", ".."):
            if self.text.startswith(op, self.at):
                if isinstance(target, Group):
                    target = self.as_type(target)
                self.at += len(op)
                return Type1(target, op, self.closed(self.type2()))
        m = _CONTROL.match(self.text, self.at)
        if m:
            if isinstance(target, Group):
                target = self.as_type(target)
            self.at = m.end()
            return Type1(target, m[0], self.closed(self.type2()))
        return Type1(target)

    def closed(self, target):
        return self.as_type(target) if isinstance(target, Group) else target

    def as_type(self, group: Group) -> Paren:
        if len(group.choices) == 1 and len(group.choices[0]) == 1:
            e = group.choices[0][0]
            if e.key is None and e.low == e.high == 1 and isinstance(e.value, Type):
                return Paren(e.value)
        self.fail("a group stands where a type is needed")

    def type2(self):
        """A type2; a parenthesis gives its Group, which may be a type or not."""
        self.space()
        at, text = self.at, self.text
        c = text[at : at + 1]
        if c == "(":
            self.at += 1
            group = self.group(")")
            return group
        if c == "{":
            self.at += 1
            return MapOf(self.group("}"))
        if c == "[":
            self.at += 1
            return ArrayOf(self.group("]"))
        if c == "~":
            self.at += 1
            return Unwrap(self.name())
        if c == "&":
            self.at += 1
            if self.take("("):
                return Enum(self.group(")"))
            return Enum(self.name())
        if c == "#":
            return self.sharp()
        if c == '"':
            m = self.match(_TEXT) or self.fail("text isn't closed")
            try:
                return Literal(_unescaped(m[0][1:-1]))
            except ValueError as e:
                self.fail(str(e), at)
        m = _BYTES.match(text, at)
        if m:
            self.at = m.end()
            try:
                return Literal(self.byte_string(m[1], m[2]))
            except ValueError as e:
                self.fail(f"bad byte string: {e}", at)
        m = _NUMBER.match(text, at)
        if m:
            self.at = m.end()
            return Literal(_number(m[0]))
        if _ID.match(text, at):
            return self.name()
        self.fail("expected a type")

    @staticmethod
    def byte_string(kind: str | None, body: str) -> bytes:
        if kind is None:
            return _unescaped(body).encode()
        body = re.sub(r";[^\n]*", "", body)
        body = re.sub(r"\s+", "", body)
        if kind == "h":
            return bytes.fromhex(body)
        body = body.rstrip("=").replace("+", "-").replace("/", "_")
        if not re.fullmatch(r"[A-Za-z0-9_-]*", body):
            raise ValueError("not base 64")
        return base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))

    def sharp(self):
        self.at += 1
        m = re.compile("[0-7]").match(self.text, self.at)
        if not m:
            return Major(None, None)
        self.at = m.end()
        major, argument = int(m[0]), None
        if self.text.startswith(".", self.at) and not self.text.startswith("..", self.at):
            self.at += 1
            if self.text.startswith("<", self.at):
                self.at += 1
                argument = self.type()
                self.expect(">")
            else:
                n = re.compile(_INT).match(self.text, self.at) or self.fail("expected a number")
                self.at = n.end()
                argument = int(n[0], 0)
        if major == 6:
            if self.text.startswith("(", self.at):
                self.at += 1
                inner = self.type()
                self.expect(")")
            else:
                inner = Type((Type1(Major(None, None)),))
            return Tagged(argument, inner)
        if isinstance(argument, Type):
            self.fail("only tags have a type for their number")
        return Major(major, argument)

    def name(self) -> Name:
        m = self.match(_ID) or self.fail("expected a name")
        args: list[Type] = []
        if self.text.startswith("<", self.at):
            self.at += 1
            while True:
                args.append(Type((self.closed1(self.type1()),)))
                if not self.take(","):
                    break
            self.expect(">")
        return Name(m[0], tuple(args))

    def closed1(self, t: Type1) -> Type1:
        return Type1(self.as_type(t.target), t.op, t.controller) if isinstance(t.target, Group) else t

    def group(self, close: str) -> Group:
        choices, entries = [], []
        while True:
            self.space()
            if self.take(close):
                choices.append(tuple(entries))
                return Group(tuple(choices))
            if self.take("//"):
                choices.append(tuple(entries))
                entries = []
                continue
            if self.at >= len(self.text):
                self.fail(f"expected {close!r}")
            entries.append(self.entry())
            self.take(",")

    def entry(self) -> Entry:
        self.space()
        start = self.at
        made = self._entry()
        if made.key is not None:
            self.spots.append((start, self.at, made))
        return made

    def _entry(self) -> Entry:
        low, high = self.occurrence()
        first = self.type1()
        self.space()
        cut = False
        if self.text.startswith("^", self.at):
            self.at += 1
            cut = True
            self.expect("=>")
            key = Key(self.closed1(first), True)
        elif self.text.startswith("=>", self.at):
            self.at += 2
            key = Key(self.closed1(first), False)
        elif self.text.startswith(":", self.at) and first.op is None and (isinstance(first.target, Literal) or isinstance(first.target, Name) and not first.target.args):
            self.at += 1
            t = first.target
            key = Key(Type1(Literal(t.name) if isinstance(t, Name) else t), True)
        else:
            key = None
        if key is not None:
            first = self.type1()
        if isinstance(first.target, Group) and first.op is None:
            self.space()
            more = self.text.startswith("/", self.at) and not self.text.startswith(("//", "/="), self.at)
            g = first.target
            single = len(g.choices) == 1 and len(g.choices[0]) == 1
            e = g.choices[0][0] if single else None
            is_type = e is not None and e.key is None and e.low == e.high == 1 and isinstance(e.value, Type)
            if not more and not is_type:
                return Entry(low, high, key, g)
            first = self.closed1(first)
        choices = [first]
        while self.slash():
            choices.append(self.closed1(self.type1()))
        return Entry(low, high, key, Type(tuple(choices)))

    def occurrence(self) -> tuple[int, int | None]:
        self.space()
        m = _OCCUR.match(self.text, self.at)
        if not m:
            return 1, 1
        self.at = m.end()
        if m[0] == "?":
            return 0, 1
        if m[0] == "+":
            return 1, INFINITE
        return int(m[1], 0) if m[1] else 0, int(m[2], 0) if m[2] else INFINITE


def parse(text: str) -> list[Rule]:
    """The rules of a schema."""
    parser = Parser(text)
    try:
        return parser.rules()
    except RecursionError:
        raise SchemaSyntaxError("nested too deeply", text, parser.at) from None


def comments(text: str) -> dict[Entry, str]:
    """Comments of entries with keys: on an entry's last line after it, or else on the lines right above it."""
    if ";" not in text:
        return {}
    parser = Parser(text)
    parser.rules()
    lines = text.split("\n")
    out: dict[Entry, str] = {}
    for start, end, entry in parser.spots:
        first, last = text.count("\n", 0, start), text.count("\n", 0, end)
        tail = re.match(r"[\s,]*;(.*)", text[end:].split("\n", 1)[0])
        found = [tail[1].strip()] if tail else []
        while not tail and first and lines[first - 1].strip().startswith(";"):
            first -= 1
            found.insert(0, lines[first].strip().lstrip(";").strip())
        if found and last >= first:
            out.setdefault(entry, " ".join(found))
    return out


def text_of(node) -> str:
    """Schema text of a node; parsing it gives the node again."""
    if isinstance(node, Rule):
        params = f"<{', '.join(node.params)}>" if node.params else ""
        return f"{node.name}{params} {node.op} {text_of(node.body)}"
    if isinstance(node, Type):
        return " / ".join(map(text_of, node.choices))
    if isinstance(node, Type1):
        if node.op is None:
            return text_of(node.target)
        return f"{text_of(node.target)} {node.op} {text_of(node.controller)}"
    if isinstance(node, Literal):
        v = node.value
        if isinstance(v, bytes):
            return f"h'{v.hex()}'"
        if isinstance(v, str):
            return '"' + "".join("\\" + c if c in '"\\' else f"\\u{ord(c):04x}" if ord(c) < 32 else c for c in v) + '"'
        return repr(v)
    if isinstance(node, Name):
        return node.name + (f"<{', '.join(map(text_of, node.args))}>" if node.args else "")
    if isinstance(node, MapOf):
        return f"{{ {text_of(node.group)} }}"
    if isinstance(node, ArrayOf):
        return f"[ {text_of(node.group)} ]"
    if isinstance(node, Paren):
        return f"({text_of(node.type)})"
    if isinstance(node, Unwrap):
        return "~" + text_of(node.name)
    if isinstance(node, Enum):
        return "&" + (text_of(node.group) if isinstance(node.group, Name) else f"( {text_of(node.group)} )")
    if isinstance(node, Tagged):
        n = "" if node.number is None else f".{node.number}" if isinstance(node.number, int) else f".<{text_of(node.number)}>"
        return f"#6{n}({text_of(node.type)})"
    if isinstance(node, Major):
        return "#" + ("" if node.major is None else str(node.major) + ("" if node.argument is None else f".{node.argument}"))
    if isinstance(node, Group):
        return " // ".join(", ".join(map(text_of, c)) for c in node.choices)
    if isinstance(node, Entry):
        occur = {(1, 1): "", (0, 1): "? ", (0, None): "* ", (1, None): "+ "}.get((node.low, node.high))
        if occur is None:
            occur = f"{node.low or ''}*{'' if node.high is None else node.high} "
        key = ""
        if node.key:
            t = node.key.type
            short = node.key.cut and t.op is None and isinstance(t.target, Literal)
            key = f"{text_of(t)}: " if short else f"{text_of(t)} {'^ ' if node.key.cut else ''}=> "
        return occur + key + (f"( {text_of(node.value)} )" if isinstance(node.value, Group) else text_of(node.value))
    raise TypeError(node)
