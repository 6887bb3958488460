"""Schema conformance for Spark DataFrames, by schemas in the language of RFC 8610."""

from importlib import import_module

#: Public names and their modules; they are loaded when they are first used, as executors need few of them.
_PLACES = {
    "Schema": "schema",
    "SchemaError": "plans.analysis",
    "SchemaSyntaxError": "plans.syntax",
    "NotColumnar": "operators.columns",
    "validate": "operators.conformance",
    "conforming": "operators.conformance",
    "error_rows": "operators.conformance",
    "report": "operators.conformance",
    "csv_rows": "operators.conformance",
    "csv_file_rows": "operators.conformance",
    "csv_file_records": "sources.csv_files",
    "dangling": "operators.references",
    "reference_paths": "operators.references",
    "error_function": "operators.conformance",
    "lints": "operators.conformance",
    "struct_types": "operators.conformance",
    "sampled": "operators.conformance",
    "spread": "operators.conformance",
    "diagnoses": "operators.conformance",
    "cbor_text": "operators.conformance",
    "ValueModel": "operators.matcher",
    "DecodeError": "sources.values",
}

__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(import_module(f"{__name__}.{_PLACES[name]}"), name)
    raise AttributeError(name)
