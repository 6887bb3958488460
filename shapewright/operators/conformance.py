"""Rows against a schema: ``valid`` for each row, errors as rows, and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.analysis import lint, problems
from ..plans.syntax import ArrayOf, Group, Name
from ..schema import Schema
from ..sources.csv_files import csv_file_records
from ..sources.values import DecodeError, Map, coerced, csv_records, from_cbor, from_csv, from_json
from .columns import Columns, NotColumnar, Value, Variant, free_name, parsed_json
from .failures import ERROR, ERRORS, FIELDS, Failures, error
from .matcher import Compiler, ValueModel, run
from .shipping import ship

_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}
_ARROW_ERRORS = pa.list_(pa.struct([(f.name, _ARROW[f.dataType.simpleString()]) for f in ERROR]))


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt anew over as many tasks as Spark's shuffles have. A file of a few megabytes is one task, however long its rows take in Python.

    Best before documents are made or read from the columns, as these travel.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _distinct(values: pa.Array) -> tuple[pa.Array, pa.Array | None]:
    """A batch's distinct texts or byte strings, and which of them each value is (null for null); other values, and texts that are seldom equal, as they are."""
    kind = values.type
    if not (pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind)):
        return values, None
    found = values.dictionary_encode()
    return (found.dictionary, found.indices) if 2 * len(found.dictionary) <= len(values) else (values, None)


def as_schema(schema: Schema | str) -> Schema:
    return schema if isinstance(schema, Schema) else Schema.parse(schema)


def valid_column(df: DataFrame, schema: Schema | str, on: str | list[str], format: str = "row", root: str | None = None, features: list[str] | None = None) -> Column:
    """The check as a column, null or false where a row doesn't conform; raises NotColumnar where the schema needs the matcher.

    format "row": ``on`` is a column, or a list of columns that make a map. format "json": a column of JSON text.
    """
    schema = as_schema(schema)
    compiler = Columns(schema.symbols, features)
    if format == "json":
        if not isinstance(df.schema[on].dataType, T.StringType):
            raise TypeError(f"{on} isn't text")
        parsed = parsed_json(F.col(f"`{on}`"))
        return parsed.isNotNull() & compiler.root(root, Variant(parsed))
    if format != "row":
        raise NotColumnar("this format needs the matcher")
    if isinstance(on, list):
        kind = T.StructType([df.schema[c] for c in on])
        return compiler.root(root, Value(F.struct(*(F.col(f"`{c}`") for c in on)), kind))
    kind = df.schema[on].dataType
    col = F.col(f"`{on}`")
    return col.isNotNull() & compiler.root(root, Variant(col) if isinstance(kind, T.VariantType) else Value(col, kind))


def row_decoder(kind: T.DataType):
    """A function from a column's values to documents: fields that are null are absent, decimals without places are integers.

    Dates, timestamps and intervals are of no type but any, in both tiers.
    """
    if isinstance(kind, T.StructType):
        parts = {f.name: row_decoder(f.dataType) for f in kind}
        return lambda value: None if value is None else Map(tuple((k, parts[k](v)) for k, v in value.items() if v is not None))
    if isinstance(kind, T.MapType):
        of_key, of_value = row_decoder(kind.keyType), row_decoder(kind.valueType)
        return lambda value: None if value is None else Map(tuple((of_key(k), of_value(v)) for k, v in value))
    if isinstance(kind, T.ArrayType):
        item = row_decoder(kind.elementType)
        return lambda value: None if value is None else [item(v) for v in value]
    if isinstance(kind, T.DecimalType):
        return lambda value: None if value is None else int(value) if kind.scale == 0 else float(value)
    return lambda value: value


def _decoder(format: str | ValueModel, has_header: bool, kind: T.DataType | None = None):
    if isinstance(format, ValueModel):
        return format.decode
    if format == "json":
        return from_json
    if format == "cbor":
        return from_cbor
    if format == "row":
        return row_decoder(kind)
    if format == "csv":
        return lambda text: from_csv(text, has_header)
    raise ValueError(f"format is json, cbor, csv or row, not {format}")


def validate(df: DataFrame, schema: Schema | str, on: str | list[str], format: str | ValueModel = "json", root: str | None = None, features: list[str] | None = None, errors: bool = False, tier: str = "auto", has_header: bool = False, details: bool = False) -> DataFrame:
    """df with ``valid`` (never null), and with ``errors`` their list.

    tier: "columns" for column expressions, "matcher" for the matcher over Arrow arrays, "auto" for columns where the schema allows them.
    Errors of JSON documents are columns, too, where ``operators.failures`` can say them; else they come from the matcher, which gets the documents that
    columns find not valid. Columns tell of a text that isn't JSON that it isn't; ``details`` has the matcher say why and where. A null document is not
    valid. Of repeated keys of a JSON object the last counts. In rows, a null field is an absent member. ``format`` may be a ValueModel of your own.
    """
    schema = as_schema(schema)
    if tier not in ("auto", "columns", "matcher"):
        raise ValueError(f"no tier {tier}")
    good = None
    if tier != "matcher" and errors and format == "json" and not details:
        try:
            return _with_errors(df, schema, on, root, features)
        except NotColumnar:
            if tier == "columns":
                raise
    if tier != "matcher":
        try:
            if format == "json" and not errors:
                return _checked_json(df, schema, on, root, features)
            good = F.coalesce(valid_column(df, schema, on, format, root, features), F.lit(False))
        except NotColumnar:
            if tier == "columns":
                raise
    if good is not None and not errors:
        return df.withColumn("valid", good)
    if isinstance(on, list):
        made = df.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in on)))
        return _matched(made, schema, "_row", format, root, features, errors, has_header, good).drop("_row")
    return _matched(df, schema, on, format, root, features, errors, has_header, good)


def _parsed(df: DataFrame, on: str) -> tuple[DataFrame, str]:
    """df with its documents as variants, in a column of a free name and a projection of its own, so that each is parsed once."""
    if not isinstance(df.schema[on].dataType, T.StringType):
        raise TypeError(f"{on} isn't text")
    name = free_name(df, "_parsed")
    return df.withColumn(name, parsed_json(F.col(f"`{on}`"))), name


def _kept(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if c not in ("valid", "errors")]


def _checked_json(df: DataFrame, schema: Schema, on: str, root: str | None, features: list[str] | None) -> DataFrame:
    made, name = _parsed(df, on)
    good = Columns(schema.symbols, features).root(root, Variant(F.col(name)))
    return made.withColumn("valid", F.coalesce(F.col(name).isNotNull() & good, F.lit(False))).drop(name)


def _with_errors(df: DataFrame, schema: Schema, on: str, root: str | None, features: list[str] | None) -> DataFrame:
    """valid and errors without Python."""
    compiler = Failures(schema.symbols, features)
    made, name = _parsed(df, on)
    doc, text, told = F.col(name), F.col(f"`{on}`"), free_name(df, "_good")
    found = F.when(text.isNull(), error(F.lit("no document"), F.lit(""))).when(doc.isNull(), error(F.lit("decode: not a JSON document"), F.lit(""), kind="syntax"))
    good = F.coalesce(doc.isNotNull() & compiler.root(root, Variant(doc)), F.lit(False))
    checked = made.withColumn(told, good)
    wrong = found.otherwise(compiler.errors(root, doc))
    return checked.select(*_kept(df), F.col(told).alias("valid"), F.when(F.col(told), F.array().cast(ERRORS)).otherwise(wrong).alias("errors"))


def conforming(df: DataFrame, schema: Schema | str, on: str | list[str], format: str = "json", root: str | None = None, features: list[str] | None = None) -> DataFrame:
    """The rows that conform. Comparisons of columns stay bare, so that they reach the scan."""
    try:
        return df.filter(valid_column(df, schema, on, format, root, features))
    except NotColumnar:
        return validate(df, schema, on, format, root, features).filter("valid").drop("valid")


def _failure(reason: str, kind: str | None = None, offset: int | None = None) -> dict:
    return dict(zip(FIELDS, (reason, "", "", False, False, False, "", kind, offset), strict=True))


def _matched(df: DataFrame, schema: Schema, on: str, format: str | ValueModel, root: str | None, features: list[str] | None, errors: bool, has_header: bool, good: Column | None = None) -> DataFrame:
    """valid and errors by the matcher, which is sent the documents alone; with ``good`` only those for which it doesn't hold. A batch's equal documents are matched once."""
    model = format if isinstance(format, ValueModel) else "cbor" if format == "cbor" else "json"
    compiler = Compiler(schema.symbols, model, features)
    compiler.root(root)
    compiler.settled()  # a bad schema fails here, not on executors
    ship(df.sparkSession)
    decode = _decoder(format, has_header, df.schema[on].dataType)
    fields = [T.StructField("valid", T.BooleanType())] + [T.StructField("errors", ERRORS)] * errors

    def judged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        check = Compiler(schema.symbols, model, features).root(root)
        for docs in parts:
            valid, found = [], []
            docs, which = _distinct(docs)
            for doc in [*docs.to_pylist(), None] if which is not None else docs.to_pylist():
                why: list = []
                if doc is None:
                    ok, why = False, [_failure("no document")]
                else:
                    try:
                        ok, texts = run(check, decode(doc))
                        why = [dict(zip(FIELDS, (*e, None, None), strict=True)) for e in texts] if errors else why
                    except DecodeError as e:
                        ok, why = False, [_failure(f"decode: {e}", e.kind, e.offset)]
                    except Exception as e:  # no document stops a job
                        ok, why = False, [_failure(f"check: {type(e).__name__}: {e}"[:1000])]
                valid.append(ok)
                found.append(why)
            columns = [pa.array(valid, pa.bool_())] + ([pa.array(found, _ARROW_ERRORS)] if errors else [])
            made = pa.StructArray.from_arrays(columns, ["valid", "errors"][: 1 + errors])
            yield made if which is None else made.take(which.fill_null(len(docs)))

    judge = F.arrow_udf(judged, T.StructType(fields))
    if not errors:
        return df.withColumn("valid", judge(F.col(f"`{on}`"))["valid"])
    judge = judge.asNondeterministic()  # both fields come from one call
    if good is None:
        made = df.withColumn("_judged", judge(F.col(f"`{on}`")))
        return made.select(*(F.col(f"`{c}`") for c in df.columns), F.col("_judged.valid").alias("valid"), F.col("_judged.errors").alias("errors"))
    made = df.withColumn("valid", good).withColumn("_judged", judge(F.when(~F.col("valid"), F.col(f"`{on}`"))))
    return made.select(*(F.col(f"`{c}`") for c in df.columns), "valid", F.when(F.col("valid"), F.lit([]).cast(ERRORS)).otherwise(F.col("_judged.errors")).alias("errors"))


def error_rows(df: DataFrame, schema: Schema | str, on: str, **how) -> DataFrame:
    """A row for each error: df's columns and those of the error, with its text."""
    found = validate(df, schema, on, errors=True, **how).filter(~F.col("valid")).withColumn("error", F.explode("errors"))
    e = F.col("error")
    inside = F.concat(F.lit("error validating"), F.when(e["multi_group_choice"], F.lit(" group choice")).otherwise(F.lit("")), F.when(e["multi_type_choice"], F.lit(" type choice")).otherwise(F.lit("")))
    text = F.concat(inside, F.lit(" at "), F.when(e["location"] == "", F.lit("the root")).otherwise(e["location"]), F.lit(": "), e["reason"])
    return found.select(*(F.col(f"`{c}`") for c in df.columns), "error.*", text.alias("message"))


def report(df: DataFrame, schema: Schema | str, on: str, **how) -> DataFrame:
    """How often each reason occurs: rule, reason, n."""
    return error_rows(df, schema, on, **how).groupBy("rule", "reason").agg(F.count("*").alias("n"))


def _record_checks(schema: Schema, has_header: bool):
    """A function (number of a record, fields) -> whether it conforms, made where it runs.

    The root must be an array of fixed records and one repeated record last, so that each record's type follows from its number.
    """
    d, env = Compiler(schema.symbols, "json").definition(Name(schema.root_name), {})
    target = d.types[0].choices[0].target
    if len(d.types) != 1 or len(d.types[0].choices) != 1 or not isinstance(target, ArrayOf) or len(target.group.choices) != 1:
        raise NotColumnar("the root isn't one array")
    entries = target.group.choices[0]
    if any(isinstance(e.value, Group) for e in entries) or any(e.low != e.high for e in entries[:-1]):
        raise NotColumnar("only the last record may repeat")

    def make():
        own = Compiler(schema.symbols, "json")
        checks = [own.type(e.value, env) for e in entries for _ in range(e.low if e.low == e.high else 1)]
        fixed = len(checks) - (bool(entries) and entries[-1].low != entries[-1].high)

        def good(k: int, fields: list[str]) -> bool:
            check = checks[k] if k < fixed else checks[-1] if fixed < len(checks) else None
            try:
                return check is not None and run(check, list(fields) if has_header and k == 0 else [coerced(f) for f in fields])[0]
            except Exception:  # no record stops a job
                return False

        return good

    return make


def csv_rows(df: DataFrame, schema: Schema | str, on: str, has_header: bool = False) -> DataFrame:
    """A row for each record of CSV texts, checked by itself: row (from 0), fields, valid; see _record_checks() for the schemas that it takes."""
    make = _record_checks(as_schema(schema), has_header)
    ship(df.sparkSession)
    record = T.StructType([T.StructField("row", T.LongType()), T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("valid", T.BooleanType())])

    def judged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        good = make()
        for texts in parts:
            fields, number, until = [], [], [0]
            for text in texts.to_pylist():
                records = csv_records(text or "")
                number += range(len(records))
                fields += records
                until.append(len(fields))
            valid = [good(k, r) for k, r in zip(number, fields, strict=True)]
            rows = pa.StructArray.from_arrays([pa.array(number, pa.int64()), pa.array(fields, pa.list_(pa.string())), pa.array(valid, pa.bool_())], record.names)
            yield pa.ListArray.from_arrays(pa.array(until, pa.int32()), rows)

    found = df.withColumn("_record", F.explode(F.arrow_udf(judged, T.ArrayType(record))(F.col(f"`{on}`"))))
    return found.select(*(F.col(f"`{c}`") for c in df.columns), "_record.*")


def csv_file_rows(spark: SparkSession, path: str | list[str], schema: Schema | str, has_header: bool = False) -> DataFrame:
    """file, row, fields, valid of CSV files, which are read in splits; the schemas are those of csv_rows()."""
    make = _record_checks(as_schema(schema), has_header)

    def judged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        good = make()
        for records in parts:
            yield pa.array([good(r["row"], r["fields"]) for r in records.to_pylist()], pa.bool_())

    return csv_file_records(spark, path).withColumn("valid", F.arrow_udf(judged, T.BooleanType())(F.struct("row", "fields")))


def error_function(schema: Schema | str, format: str | ValueModel = "json", root: str | None = None, features: list[str] | None = None, has_header: bool = False):
    """A table function of one document: a row for each error. ``spark.udtf.register(name, error_function(schema))`` makes it one of SQL."""
    schema = as_schema(schema)
    model = format if isinstance(format, ValueModel) else "cbor" if format == "cbor" else "json"
    compiler = Compiler(schema.symbols, model, features)
    compiler.root(root)
    compiler.settled()
    decode = _decoder(format, has_header)

    class Errors:
        def __init__(self) -> None:
            self.check = Compiler(schema.symbols, model, features).root(root)

        def eval(self, document):
            if document is None:
                yield tuple(_failure("no document").values())
                return
            try:
                found = [(*e, None, None) for e in run(self.check, decode(document))[1]]
            except DecodeError as e:
                found = [tuple(_failure(f"decode: {e}", e.kind, e.offset).values())]
            except Exception as e:  # no document stops a query
                found = [tuple(_failure(f"check: {type(e).__name__}: {e}"[:1000]).values())]
            yield from found

    return F.udtf(Errors, returnType=ERROR)


def diagnoses(df: DataFrame, on: str) -> DataFrame:
    """A row for each error in a column of schema texts: df's columns, line, column, end_column, message, hint. A null text has none."""
    ship(df.sparkSession)
    names = ("line", "column", "end_column", "message", "hint")
    kind = T.StructType([T.StructField(n, T.IntegerType() if i < 3 else T.StringType()) for i, n in enumerate(names)])

    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        arrow = pa.list_(pa.struct([(n, pa.int32() if i < 3 else pa.string()) for i, n in enumerate(names)]))
        for texts in parts:
            texts, which = _distinct(texts)
            made = pa.array([[dict(zip(names, p, strict=True)) for p in problems(t)] if t is not None else [] for t in texts.to_pylist()], arrow)
            yield made if which is None else made.take(which)

    each = df.withColumn("_problem", F.explode(F.arrow_udf(found, T.ArrayType(kind))(F.col(f"`{on}`"))))
    return each.select(*(F.col(f"`{c}`") for c in df.columns), "_problem.*")


def _of_schemas(df: DataFrame, on: str, names: tuple[str, ...], rows) -> DataFrame:
    """df's columns and a row for each of rows(schema text); a null text, or one that isn't a schema, has none. A batch's equal texts are parsed once."""
    ship(df.sparkSession)
    kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))

    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            out = []
            texts, which = _distinct(texts)
            for t in texts.to_pylist():
                try:
                    out.append([dict(zip(names, r, strict=True)) for r in rows(t)] if t is not None else [])
                except ValueError:
                    out.append([])
            made = pa.array(out, pa.list_(pa.struct([(n, pa.string()) for n in names])))
            yield made if which is None else made.take(which)

    each = df.withColumn("_row", F.explode(F.arrow_udf(found, kind)(F.col(f"`{on}`"))))
    return each.select(*(F.col(f"`{c}`") for c in df.columns), "_row.*")


def lints(df: DataFrame, on: str) -> DataFrame:
    """A row for each lint of a column of schema texts: df's columns, kind, rule, message."""
    return _of_schemas(df, on, ("kind", "rule", "message"), lambda text: lint(text))


def struct_types(df: DataFrame, on: str) -> DataFrame:
    """A row for each rule of a column of schema texts that is a type of rows: df's columns, rule, type."""
    return _of_schemas(df, on, ("rule", "type"), lambda text: [(n, t.simpleString()) for n, t in Schema.parse(text).to_struct_types().items()])


def sampled(df: DataFrame, schema: Schema | str, seed: str | Column, name: str = "sample") -> DataFrame:
    """df with a JSON document of the schema in each row, drawn by the row's seed; null where the seed is, or where no draw gives one."""
    schema = as_schema(schema)
    ship(df.sparkSession)

    def drawn(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        draw = schema.sampler()
        for seeds in parts:
            found = [[] if s is None else draw(1, s) for s in seeds.to_pylist()]
            yield pa.array([f[0][1] if f else None for f in found], pa.string())

    return df.withColumn(name, F.arrow_udf(drawn, "string")((F.col(seed) if isinstance(seed, str) else seed).cast("bigint")))


def cbor_text(on: str | Column) -> Column:
    """Bytes of a column of hex digits (with separators between) or base 64; null where it is neither."""
    text = F.col(on) if isinstance(on, str) else on
    digits = F.regexp_replace(text, r"(?i)0x|[\s,:;_-]", "")
    body = F.translate(F.regexp_replace(F.regexp_replace(text, r"\s", ""), "=+$", ""), "-_", "+/")
    whole = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(digits)).otherwise(F.try_to_binary(whole, F.lit("base64")))
