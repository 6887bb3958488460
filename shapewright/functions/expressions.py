"""One language of text expressions for both tiers: parsed to a tree, then written out for Java and for Python.

The language is that of linear-time engines (character classes with nested classes, ``&&``, ``--``, ``~~`` and POSIX names, Unicode properties, scoped
flags, lazy quantifiers, ``\\x{..}``), for ``.pcre`` with look-around, references to groups, and atomic and possessive parts as well. ``.iregexp`` takes what
RFC 9485 allows and nothing else. The tree holds sets of characters, anchors, repetitions and groups without names, so that what is written is
made of parts that both engines read alike. A dot is any letter but a line feed (in RFC 9485 no carriage return either), ``$`` is the very end, and case is folded
as Unicode does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

try:
    import regex as _engine
except ImportError:  # the standard module lacks properties and operations of sets
    import re as _engine


class ExpressionError(ValueError):
    """An expression that can't be read."""


@dataclass(frozen=True)
class Chars:
    """A range of characters; both ends belong to it."""

    low: int
    high: int


@dataclass(frozen=True)
class Property:
    """A Unicode property: a general category, a script, or a binary one."""

    kind: str
    name: str


@dataclass(frozen=True)
class Union:
    parts: tuple


@dataclass(frozen=True)
class Both:
    """Characters that are in all parts."""

    parts: tuple


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Anchor:
    kind: str


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    of: object
    low: int
    high: int | None
    mode: str


@dataclass(frozen=True)
class Capture:
    of: object


@dataclass(frozen=True)
class Special:
    """Look-around or an atomic part; ``kind`` is how both engines begin it."""

    kind: str
    of: object


@dataclass(frozen=True)
class Back:
    number: int
    folded: bool


_CATEGORIES = "C Cc Cf Cn Co L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split()
#: Long names of categories (Unicode's PropertyValueAliases), and binary properties as Java and Python call them.
_LONG = {"letter": "L", "lowercaseletter": "Ll", "uppercaseletter": "Lu", "titlecaseletter": "Lt", "mark": "M", "number": "N", "decimalnumber": "Nd", "punctuation": "P", "punct": "P", "symbol": "S", "separator": "Z", "spaceseparator": "Zs", "other": "C", "control": "Cc", "format": "Cf"}
_BINARY = {"alphabetic": "Alphabetic", "alpha": "Alphabetic", "lowercase": "Lowercase", "lower": "Lowercase", "uppercase": "Uppercase", "upper": "Uppercase", "whitespace": "White_Space", "space": "White_Space", "joincontrol": "Join_Control", "ideographic": "Ideographic"}
_DIGIT = Property("category", "Nd")
_SPACE = Property("binary", "White_Space")
_WORD = Union((Property("binary", "Alphabetic"), Property("category", "M"), _DIGIT, Property("category", "Pc"), Property("binary", "Join_Control")))
_CLASSES = {"d": _DIGIT, "s": _SPACE, "w": _WORD}


def _of(*ranges: str) -> Union:
    return Union(tuple(Chars(ord(r[0]), ord(r[-1])) for r in ranges))


#: ASCII classes as POSIX names them.
_POSIX = {
    "alnum": _of("0-9", "A-Z", "a-z"), "alpha": _of("A-Z", "a-z"), "ascii": _of("\x00-\x7f"), "blank": _of("\t", " "), "cntrl": _of("\x00-\x1f", "\x7f"), "digit": _of("0-9"), "graph": _of("!-~"),
    "lower": _of("a-z"), "print": _of(" -~"), "punct": _of("!-/", ":-@", "[-`", "{-~"), "space": _of("\t-\r", " "), "upper": _of("A-Z"), "word": _of("0-9", "A-Z", "_", "a-z"), "xdigit": _of("0-9", "A-F", "a-f"),
}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}
_STRICT_ESCAPES = "()*+-.?[\\]^nrt{|}"


@cache
def _fold_classes() -> list[list[int]]:
    """Letters that are one letter where case doesn't matter (one letter folds to one)."""
    found: dict[str, list[int]] = {}
    for n in range(0x1F000):
        c = chr(n)
        if c.isalpha() or c.isnumeric() or c.lower() != c.upper():
            key = next(k for k in (c.casefold(), c.lower(), c) if len(k) == 1)
            found.setdefault(key, []).append(n)
    return [x for x in found.values() if len(x) > 1]


_CASED = Union((Property("category", "Lu"), Property("category", "Ll"), Property("category", "Lt")))


def _folded(s):
    """A set under the flag that case doesn't matter."""
    if isinstance(s, Chars):
        more = {m for x in _fold_classes() if any(s.low <= n <= s.high for n in x) for m in x}
        return Union((s, *(Chars(m, m) for m in sorted(more) if not s.low <= m <= s.high))) if more else s
    if isinstance(s, Property):
        return _CASED if s.name in ("Lu", "Ll", "Lt", "Uppercase", "Lowercase") else s
    if isinstance(s, Not):
        return Not(_folded(s.of))
    return type(s)(tuple(map(_folded, s.parts)))


class Parser:
    """Reads one expression. ``kind``: "regexp", "pcre" or "iregexp"."""

    def __init__(self, text: str, kind: str):
        self.text, self.kind, self.at = text, kind, 0
        self.looks, self.strict = kind == "pcre", kind == "iregexp"
        self.flags = {"i": False, "m": False, "s": False, "x": False, "U": False}
        self.names: dict[str, int] = {}
        self.groups = 0
        self.backs: list[int] = []

    def fail(self, what: str):
        raise ExpressionError(f"{what} at {self.at} of {self.text!r}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, what: str) -> bool:
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def next(self) -> str:
        if self.at >= len(self.text):
            self.fail("the expression ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def whole(self):
        tree = self.alternatives()
        if self.at < len(self.text):
            self.fail("an unopened bracket")
        if any(n > self.groups for n in self.backs):
            self.fail("a reference to no group")
        return tree

    def alternatives(self):
        kept = dict(self.flags)
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        self.flags = kept
        return parts[0] if len(parts) == 1 else Alt(tuple(parts))

    def sequence(self):
        out = []
        while self.at < len(self.text) and self.peek() not in "|)":
            if self.flags["x"]:
                if self.peek().isspace():
                    self.at += 1
                    continue
                if self.peek() == "#":
                    end = self.text.find("\n", self.at)
                    self.at = len(self.text) if end < 0 else end + 1
                    continue
            part = self.atom()
            if part is None:
                continue
            out.append(self.repeated(part))
        return out[0] if len(out) == 1 else Seq(tuple(out))

    def repeated(self, part):
        while True:
            c = self.peek()
            if c and c in "*+?":
                self.at += 1
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            elif c == "{":
                end = self.text.find("}", self.at)
                body = self.text[self.at + 1 : end].replace(" ", "") if end > 0 else ""
                a, comma, b = body.partition(",")
                if not (a.isascii() and a.isdigit() or (not a and comma and b and not self.strict)) or (b and not (b.isascii() and b.isdigit())):
                    self.fail("a malformed quantifier")
                self.at = end + 1
                low = int(a or 0)
                high = (int(b) if b else None) if comma else low
                if high is not None and high < low or max(low, high or 0) > 1000:
                    self.fail("a quantifier out of range")
            else:
                return part
            if isinstance(part, Anchor):
                part = Seq((part,))
            mode = ""
            if not self.strict:
                if self.take("?"):
                    mode = "?"
                elif self.looks and self.take("+"):
                    mode = "+"
                if self.flags["U"] and mode != "+":
                    mode = "" if mode else "?"
            elif self.peek() and self.peek() in "*+?{":
                self.fail("a quantifier of a quantifier")
            part = Repeat(part, low, high, mode)

    def set(self, of):
        return _folded(of) if self.flags["i"] else of

    def atom(self):
        c = self.next()
        if c == "(":
            return self.group()
        if c == "[":
            return self.set(self.bracket())
        if c == ".":
            if self.flags["s"]:
                return Union((Chars(0, 0x10FFFF),))
            return Not(Union((Chars(10, 10), Chars(13, 13)))) if self.strict else Not(Chars(10, 10))
        if c in "*+?":
            self.fail("nothing to repeat")
        if self.strict and c in "{}]^$":
            self.fail("a letter that must be escaped")
        if c == "{":
            self.fail("nothing to repeat")
        if c == "^":
            return Anchor("line start" if self.flags["m"] else "start")
        if c == "$":
            return Anchor("line end" if self.flags["m"] else "end")
        if c == "\\":
            return self.escape()
        return self.set(Chars(ord(c), ord(c)))

    def group(self):
        if self.strict and self.peek() == "?":
            self.fail("a kind of group that there isn't")
        if not self.take("?"):
            self.groups += 1
            inner = Capture(self.alternatives())
        elif self.looks and self.peek() in ("=", "!", ">") or self.looks and self.peek(2) in ("<=", "<!"):
            kind = self.next()
            kind += self.next() if kind == "<" else ""
            inner = Special(kind, self.alternatives())
        elif self.take("#"):
            self.at = self.text.find(")", self.at)
            if self.at < 0:
                self.at = len(self.text)
                self.fail("an open comment")
            inner = None
        elif self.take("P=") and self.looks:
            name = self.text[self.at : (end := self.text.find(")", self.at))]
            self.at = end
            inner = self.named(name)
        elif self.take("P<") or self.take("<"):
            end = self.text.find(">", self.at)
            name = self.text[self.at : end]
            if end < 0 or not name or name in self.names or not (name[0].isalpha() or name[0] == "_") or not all(x.isalnum() or x in "_-.[]" for x in name):
                self.fail("look-around isn't of this kind of expression" if name[:1] in ("=", "!") else "a malformed name of a group")
            self.at = end + 1
            self.groups += 1
            self.names[name] = self.groups
            inner = Capture(self.alternatives())
        elif self.peek() in ("=", "!"):
            self.fail("look-around isn't of this kind of expression")
        else:
            on, changes = True, {}
            while self.peek() and self.peek() not in ":)":
                f = self.next()
                if f == "-" and on:
                    on = False
                elif f in self.flags:
                    changes[f] = on
                elif f not in "uR":
                    self.fail("no such flag")
            if self.take(")"):
                self.flags |= changes  # for what follows in this group
                return None
            if not self.take(":"):
                self.fail("an open group")
            kept = dict(self.flags)
            self.flags |= changes
            inner = self.alternatives()
            self.flags = kept
            inner = Seq((inner,))
        if not self.take(")"):
            self.fail("an open group")
        return inner

    def named(self, name: str):
        if name not in self.names:
            self.fail("a reference to no group")
        return Back(self.names[name], self.flags["i"])

    def code(self, c: str) -> int | None:
        """The character of an escape by number."""
        if c in "xuU" and not self.strict:
            if self.take("{"):
                end = self.text.find("}", self.at)
                digits = self.text[self.at : end] if end > 0 else ""
                self.at = end + 1
            else:
                n = {"x": 2, "u": 4, "U": 8}[c]
                digits = self.peek(n)
                self.at += n
                if len(digits) < n:
                    digits = ""
            try:
                value = int(digits, 16) if digits.isalnum() else -1
            except ValueError:
                value = -1
            if not 0 <= value <= 0x10FFFF or 0xD800 <= value <= 0xDFFF:
                self.fail("no such character")
            return value
        if c in _ESCAPES and not (self.strict and c not in "nrt"):
            return ord(_ESCAPES[c])
        return None

    def escape(self):
        c = self.next()
        if self.strict and c not in _STRICT_ESCAPES + "pP":
            self.fail("an escape that there isn't")
        found = self.code(c)
        if found is not None:
            return self.set(Chars(found, found))
        if (made := self.class_of(c)) is not None:
            return self.set(made)
        if c in "bB":
            return Anchor("word" if c == "b" else "no word")
        if c in "Az":
            return Anchor("start" if c == "A" else "end")
        if self.looks and c in "123456789":
            while self.peek().isascii() and self.peek().isdigit():
                c += self.next()
            self.backs.append(int(c))
            return Back(int(c), self.flags["i"])
        if self.looks and c == "k" and self.peek() in ("<", "{", "'"):
            close = {"<": ">", "{": "}", "'": "'"}[self.next()]
            end = self.text.find(close, self.at)
            name = self.text[self.at : end]
            self.at = end + 1
            return self.named(name)
        if c.isascii() and c.isalnum() and (self.looks or c.isdigit()):
            self.fail("an escape that there isn't")
        return self.set(Chars(ord(c), ord(c)))  # a letter that needs no escape

    def class_of(self, c: str):
        if c.lower() in _CLASSES and not self.strict:
            made = _CLASSES[c.lower()]
            return Not(made) if c.isupper() else made
        if c in "pP":
            if self.take("{"):
                end = self.text.find("}", self.at)
                name = self.text[self.at : end] if end > 0 else ""
                self.at = end + 1
            else:
                name = "" if self.strict else self.next()
            no = name.startswith("^") and not self.strict
            made = self.property(name[no:])
            return Not(made) if no != (c == "P") else made
        return None

    def property(self, name: str):
        if self.strict:
            if name not in _CATEGORIES:
                self.fail("no such category")
            return Property("category", name)
        key, _, value = name.replace(":", "=").rpartition("=")
        plain = value.replace("_", "").replace("-", "").replace(" ", "").lower()
        key = key.replace("_", "").lower()
        if key in ("", "gc", "generalcategory"):
            for c in _CATEGORIES:
                if plain == c.lower() or _LONG.get(plain) == c:
                    return Property("category", c)
            if plain == "any" and not key:
                return Chars(0, 0x10FFFF)
            if not key and plain in _BINARY:
                return Property("binary", _BINARY[plain])
        if key in ("", "sc", "script"):
            try:
                _engine.compile(rf"\p{{Script={value}}}")
                return Property("script", value.replace(" ", "_").replace("-", "_"))
            except _engine.error:
                pass
        self.fail("no such property")

    # classes in brackets

    def bracket(self):
        """What stands after an opening bracket, its closing one included."""
        no = self.take("^")
        left, op, items, first = None, None, [], True

        def joined(items: list):
            nonlocal left
            own = Union(tuple(items))
            left = own if left is None else Both((left, own)) if op == "&&" else Both((left, Not(own))) if op == "--" else Both((Union((left, own)), Not(Both((left, own)))))

        while True:
            two = self.peek(2)
            if self.peek() == "]" and not (first and not self.strict):
                self.at += 1
                break
            if not self.strict and two in ("&&", "--", "~~") and not (two == "--" and first):
                self.at += 2
                joined(items)
                op, items = two, []
                continue
            items.append(self.member(first))
            first = False
        joined(items)
        return Not(left) if no else left

    def member(self, first: bool):
        c = self.next()
        if c == "[" and not self.strict:
            if self.peek() == ":":
                end = self.text.find(":]", self.at)
                name = self.text[self.at + 1 : end] if end > 0 else ""
                no = name.startswith("^")
                if name[no:] in _POSIX:
                    self.at = end + 2
                    return Not(_POSIX[name[no:]]) if no else _POSIX[name[no:]]
            return self.bracket()
        if self.strict and c == "[":
            self.fail("a letter that must be escaped")
        if c == "\\":
            d = self.next()
            if self.strict and d not in _STRICT_ESCAPES + "pP":
                self.fail("an escape that there isn't")
            low = self.code(d)
            if low is None:
                if (made := self.class_of(d)) is not None:
                    return made
                if d == "b" and self.looks:
                    d = "\b"
                elif d.isascii() and d.isalnum() and (self.looks or d.isdigit()):
                    self.fail("an escape that there isn't")
                low = ord(d)
        else:
            low = ord(c)
            if self.strict and c == "-" and not first and self.peek() != "]":
                self.fail("a letter that must be escaped")
        if self.peek() == "-" and self.peek(2) not in ("-]", "--") and len(self.peek(2)) == 2:
            self.at += 1
            d = self.next()
            if d == "[":
                self.fail("a class at a range's end")
            if d == "\\":
                e = self.next()
                high = self.code(e)
                if high is None:
                    if e in "dswDSWpP":
                        self.fail("a class at a range's end")
                    high = ord(e)
            else:
                high = ord(d)
            if high < low:
                self.fail("a range that ends before it begins")
            return Chars(low, high)
        return Chars(low, low)


class Writer:
    """Writes trees for one engine."""

    java = True

    def letter(self, n: int) -> str:
        c = chr(n)
        return c if c.isascii() and c.isalnum() else f"\\x{{{n:X}}}" if self.java else f"\\U{n:08X}"

    def chars(self, s) -> str:
        """A set, as an item of a class."""
        if isinstance(s, Chars):
            return self.letter(s.low) if s.low == s.high else f"{self.letter(s.low)}-{self.letter(s.high)}"
        if isinstance(s, Property):
            if s.kind == "category":
                return f"\\p{{{s.name}}}" if self.java else f"\\p{{gc={s.name}}}"
            if s.kind == "binary":
                return f"\\p{{Is{s.name}}}" if self.java else f"\\p{{{s.name}}}"
            return f"\\p{{IsScript={s.name}}}".replace("IsScript", "script") if self.java else f"\\p{{Script={s.name}}}"
        if isinstance(s, Union):
            return f"[{''.join(map(self.chars, s.parts))}]" if s.parts else "[a&&[^a]]" if self.java else "[[a]&&[^a]]"
        if isinstance(s, Both):
            return f"[{'&&'.join(f'[{self.chars(p)}]' for p in s.parts)}]"
        return f"[^{self.chars(s.of)}]"

    def write(self, t) -> str:
        if isinstance(t, Chars) and t.low == t.high:
            return self.letter(t.low)
        if isinstance(t, (Chars, Property, Union, Both, Not)):
            return f"[{self.chars(t)}]"
        if isinstance(t, Anchor):
            ends = {"start": r"\A", "end": r"\z" if self.java else r"\Z", "line start": "(?m:^)", "line end": "(?m:$)"}
            if t.kind in ends:
                return ends[t.kind]
            word = self.chars(_WORD)
            edge = f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"
            return edge if t.kind == "word" else f"(?!{edge})"
        if isinstance(t, Seq):
            return "".join(map(self.part, t.parts))
        if isinstance(t, Alt):
            return "|".join(map(self.write, t.parts))
        if isinstance(t, Repeat):
            times = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((t.low, t.high)) or f"{{{t.low},{'' if t.high is None else t.high}}}"
            return f"(?:{self.write(t.of)}){times}{t.mode}"
        if isinstance(t, Capture):
            return f"({self.write(t.of)})"
        if isinstance(t, Special):
            return f"(?{t.kind}{self.write(t.of)})"
        return f"(?i{'u' if self.java else ''}:\\{t.number})" if t.folded else f"(?:\\{t.number})"

    def part(self, t) -> str:
        return f"(?:{self.write(t)})" if isinstance(t, (Alt, Seq)) else self.write(t)


class PythonWriter(Writer):
    java = False


def tree(text: str, kind: str):
    """The tree of an expression of .regexp, .pcre or .iregexp."""
    return Parser(text, kind).whole()


def java(text: str, kind: str) -> str:
    """For ``rlike``: whether a text has the expression, or for .pcre and .iregexp is one."""
    body = Writer().write(tree(text, kind))
    return "(?d)" + (body if kind == "regexp" else rf"\A(?:{body})\z")


def python(text: str, kind: str):
    """A function of a text: whether it has, or for .pcre and .iregexp is, the expression."""
    body = PythonWriter().write(tree(text, kind))
    made = _engine.compile(body, getattr(_engine, "V1", 0))
    return made.search if kind == "regexp" else made.fullmatch
