"""Functions of literals that RFC 9165 and RFC 9741 controls name; they are folded when a schema is compiled."""

from __future__ import annotations

import base64
import re


def cat(a, b):
    """Concatenation; the result has the first one's kind."""
    if isinstance(a, str):
        return a + (b if isinstance(b, str) else b.decode())
    return a + (b.encode() if isinstance(b, str) else b)


def dedented(x):
    """Without the white space that lines begin with."""
    if isinstance(x, bytes):
        return dedented(x.decode()).encode()
    return re.sub(r"(?m)^[ \t]+", "", x)


def plus(a, b):
    """Sum of numbers; an integer stays one."""
    return a + int(b) if isinstance(a, int) else a + b


def base64_text(data: bytes, url: bool) -> str:
    made = base64.urlsafe_b64encode(data) if url else base64.b64encode(data)
    return made.decode().rstrip("=") if url else made.decode()


def base32_text(data: bytes, extended: bool = False) -> str:
    return (base64.b32hexencode(data) if extended else base64.b32encode(data)).decode().rstrip("=")


#: RFC 9285's alphabet.
_B45 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"


def base45_text(data: bytes) -> str:
    out = []
    for i in range(0, len(data), 2):
        n = int.from_bytes(data[i : i + 2], "big")
        for _ in range(3 if i + 1 < len(data) else 2):
            n, k = divmod(n, 45)
            out.append(_B45[k])
    return "".join(out)


_FORMAT = re.compile(r"%(%|[-+ 0#]*(?:\d+)?(?:\.\d+)?[diuxXoBbscfeEgG])")


def printf(form: str, args: list) -> str:
    """C's formats, with b and B for binary digits."""
    left = list(args)

    def one(m: re.Match) -> str:
        spec = m[1]
        if spec == "%":
            return "%"
        if not left:
            raise ValueError("fewer arguments than the format has places")
        v, kind = left.pop(0), spec[-1]
        if kind in "bB":
            flags = re.fullmatch(r"([-+ 0#]*)(\d*)(?:\.(\d+))?", spec[:-1])
            digits = format(int(v), "b").rjust(int(flags[3] or 0), "0")
            digits = (f"0{kind}" if "#" in flags[1] and v else "") + digits
            width = int(flags[2] or 0)
            return digits.ljust(width) if "-" in flags[1] else digits.rjust(width, "0" if "0" in flags[1] else " ")
        if kind in "diu":
            return ("%" + spec[:-1] + "d") % int(v)
        if kind in "xXo":
            return ("%" + spec[:-1].replace("#", "") + kind) % int(v) if "#" not in spec or kind != "o" else "0" + "%o" % int(v)
        if kind == "c":
            return ("%" + spec[:-1] + "s") % (chr(v) if isinstance(v, int) else v)
        if kind == "s":
            return ("%" + spec) % (v.decode() if isinstance(v, bytes) else v)
        return ("%" + spec) % float(v)

    out = _FORMAT.sub(one, form)
    if left:
        raise ValueError("more arguments than the format has places")
    return out


#: Controls whose text is an encoding of bytes: name -> encoder.
ENCODERS = {
    ".b64u": lambda b: base64_text(b, True),
    ".b64c": lambda b: base64_text(b, False),
    ".b64u-sloppy": lambda b: base64_text(b, True),
    ".b64c-sloppy": lambda b: base64_text(b, False).rstrip("="),
    ".hex": lambda b: b.hex(),
    ".hexlc": lambda b: b.hex(),
    ".hexuc": lambda b: b.hex().upper(),
    ".b32": base32_text,
    ".h32": lambda b: base32_text(b, True),
    ".b45": base45_text,
}
