"""python -m shapewright compile-schema FILE | compile-json FILE... | validate --schema FILE [--json P...] [--cbor P...] [--csv P...] [--stdin] [--ci]

With --ci only what isn't valid is named. Exit 0: everything is fine; 1: something isn't.
"""

from __future__ import annotations

import argparse
import glob
import sys
from pathlib import Path

from .plans.analysis import SchemaError
from .plans.syntax import SchemaSyntaxError
from .schema import Schema
from .sources.values import DecodeError, from_cbor, from_csv, from_json


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="shapewright")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("compile-schema")
    one.add_argument("file")
    many = commands.add_parser("compile-json")
    many.add_argument("files", nargs="+")
    check = commands.add_parser("validate")
    check.add_argument("--schema", required=True)
    for kind in ("json", "cbor", "csv"):
        check.add_argument(f"--{kind}", nargs="*", default=[])
    check.add_argument("--csv-header", action="store_true")
    check.add_argument("--stdin", action="store_true")
    check.add_argument("--ci", action="store_true")
    check.add_argument("--features", nargs="*")
    check.add_argument("--root")
    given = top.parse_args(args)
    try:
        if given.command == "compile-schema":
            found = Schema.diagnose(Path(given.file).read_text())
            for line, column, message in found:
                print(f"{given.file}:{line}:{column}: {message}")
            return int(bool(found))
        if given.command == "compile-json":
            for f in given.files:
                from_json(Path(f).read_text())
            return 0
        schema = Schema.parse(Path(given.schema).read_text())
        checks = {m: schema.compiled(m, given.root, given.features) for m in ("json", "cbor")}
    except (SchemaError, SchemaSyntaxError, DecodeError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    bad = 0
    work = [(kind, p) for kind in ("json", "cbor", "csv") for pat in getattr(given, kind) for p in sorted(glob.glob(pat)) or [pat]]
    for kind, path in work + [("stdin", "stdin")] * given.stdin:
        try:
            data = sys.stdin.buffer.read() if kind == "stdin" else Path(path).read_bytes()
            own = kind
            if kind == "stdin":
                try:
                    data.decode()
                    own = "json"
                except UnicodeDecodeError:
                    own = "cbor"
            value = from_cbor(data) if own == "cbor" else from_json(data.decode()) if own == "json" else from_csv(data.decode(), given.csv_header)
            ok, errors = checks["cbor" if own == "cbor" else "json"](value)
        except (DecodeError, OSError, UnicodeDecodeError) as e:
            ok, errors = False, [(str(e), "")]
        if not ok or not given.ci:
            print(f"{path}: {'valid' if ok else 'not valid'}")
        for e in errors:
            print(f"  at {e[1] or 'the root'}: {e[0]}")
        bad += not ok
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main())
