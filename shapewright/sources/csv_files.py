"""CSV files in splits: one large file is read by many tasks, quoted line ends across splits included.

Spark's text reader gives lines with the split that each comes from. A line begins either outside of quotes, at a record's beginning, or inside
of them, so a split is a function from the one state to the other, and the number of records that begin in it has two values. One pass finds these,
with both states at once; a row for each split is put in order to learn each split's first state and record number; a second pass parses. What is
left of a record that crosses a split's end, some lines at its beginning or end, is sent by file and record number and parsed there; no
other text is moved.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shipping import ship
from .values import csv_records

#: Rows of splits that are broadcast; beyond, lines are sent to them.
SPLITS = 200_000
#: Letters of whole records that are parsed at a time.
PARSED = 1 << 20
_RECORDS = "file string, row bigint, fields array<string>"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether quotes are open behind a line; a quote opens at a field's beginning only."""
    at = 0
    while True:
        if not inside:
            if line.startswith('"', at):
                inside, at = True, at + 1
                continue
        else:
            close = line.find('"', at)
            if close < 0:
                return True
            if line.startswith('""', close):
                at = close + 2
                continue
            inside, at = False, close + 1
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def _lines(value: str) -> list[str]:
    """A line of the reader, which knows line feeds, as lines that end in any of \\r, \\n and both."""
    text = value + "\n"
    return [text] if "\r" not in value[:-1] else list(io.StringIO(text, newline=""))


def _blank(line: str) -> bool:
    return not line.strip("\r\n")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Lines of a batch by the split that they come from."""
    files, starts = batch.column(1).to_pylist(), batch.column(2).to_numpy()
    at = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or starts[i] != starts[at] or files[i] != files[at]:
            yield (files[at], int(starts[at])), batch.column(0).slice(at, i - at)
            at = i


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: the state behind it and how many records begin in it, for either first state."""
    key, state, count = None, [False, True], [0, 0]

    def told() -> pa.RecordBatch:
        values = [[x] for x in (*key, *state, *count)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["file", "start", "out_to", "in_to", "out_n", "in_n"])

    for batch in batches:
        for here, values in _runs(batch):
            if here != key:
                if key is not None:
                    yield told()
                key, state, count = here, [False, True], [0, 0]
            odd = np.asarray(pc.or_(pc.match_substring(values, '"'), pc.match_substring(values, "\r")))
            full = np.append(0, np.cumsum(~odd & (np.asarray(pc.binary_length(values)) > 0)))
            before = 0
            for i in [*np.flatnonzero(odd).tolist(), len(odd)]:
                for s in (0, 1):
                    count[s] += 0 if state[s] else int(full[i] - full[before])
                before = i
                for line in _lines(values[i].as_py()) if i < len(odd) else ():
                    for s in (0, 1):
                        count[s] += not state[s] and not _blank(line)
                        state[s] = ends_inside(line, state[s])
    if key is not None:
        yield told()


def _placed(table: pa.Table) -> pa.Table:
    """A file's splits with their first states and record numbers."""
    table = table.sort_by("start")
    state, row, first, rows, torn = False, 0, [], [], []
    for out_to, in_to, out_n, in_n in zip(*(table.column(c).to_pylist() for c in ("out_to", "in_to", "out_n", "in_n")), strict=True):
        first.append(state)
        rows.append(row)
        row, new = row + (in_n if state else out_n), in_to if state else out_to
        torn.append(state or new)
        state = new
    return pa.table([table.column("file"), table.column("start"), pa.array(first, pa.bool_()), pa.array(rows, pa.int64()), pa.array(torn, pa.bool_())], ["file", "start", "inside", "row", "torn"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, n = None, 0
    for batch in batches:
        numbers = []
        for here, values in _runs(batch):
            n = n if here == key else 0
            key = here
            numbers += range(n, n + len(values))
            n += len(values)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], ["value", "file", "start", "line"])


def _parser(whole: bool):
    """Of lines in order with their splits' first states and record numbers: whole records (file, row, fields), or the parts of others (file, row, start, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, torn, row, held, ready, size = None, False, False, 0, [], [], 0

        def made(first: int) -> pa.RecordBatch:
            records = csv_records("".join(ready))
            n = len(records)
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array(range(first - n, first), pa.int64()), pa.array(records, pa.list_(pa.string()))], ["file", "row", "fields"])

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([row - 1], pa.int64()), pa.array([key[1]], pa.int64()), pa.array(["".join(held)], pa.string())], ["file", "row", "start", "part"])

        for batch in batches:
            places, at = batch.select(["inside", "row"]).to_pylist(), 0
            for here, values in _runs(batch):
                if here != key:
                    if held and not whole:  # the beginning of a record, or the middle of one that began before
                        yield part()
                    key, inside, row = here, places[at]["inside"], places[at]["row"]
                    held, torn = [], inside  # torn: the record that is open began in a split before
                at += len(values)
                for value in values.to_pylist():
                    for line in _lines(value):
                        if not inside and _blank(line):
                            continue
                        row += not inside
                        held.append(line)
                        inside = ends_inside(line, inside)
                        if inside:
                            continue
                        if torn and not whole:
                            yield part()
                        elif not torn and whole:
                            ready += held
                            size += sum(map(len, held))
                        held, torn = [], False
                        if size >= PARSED:
                            yield made(row)
                            size = 0
                if ready:
                    yield made(row - (1 if held and not torn else 0))
                    size = 0
        if held and not whole:
            yield part()

    return run


def _joined(table: pa.Table) -> pa.Table:
    """A record from its parts."""
    table = table.sort_by("start")
    text = "".join(table.column("part").to_pylist())
    records = csv_records(text.removesuffix("\n")) or [[]]
    return pa.table([table.column("file").slice(0, 1), table.column("row").slice(0, 1), pa.array(records[:1], pa.list_(pa.string()))], ["file", "row", "fields"])


def csv_file_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, row (from 0), fields: all records of CSV files, each file by as many tasks as it has splits.

    Lines end in \\n, \\r\\n or \\r; empty lines are no records; records may differ in length. Files may lie wherever Spark reads from. An empty
    file gives no rows; quotes that are open at a file's end are closed there.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    states = lines.mapInArrow(_states, "file string, start bigint, out_to boolean, in_to boolean, out_n bigint, in_n bigint")
    placed = states.groupBy("file").applyInArrow(_placed, "file string, start bigint, inside boolean, row bigint, torn boolean").persist()
    if lines.rdd.getNumPartitions() + len(lines.inputFiles()) <= SPLITS:  # no fewer than splits are
        found = lines.join(F.broadcast(placed), ["file", "start"])
    else:  # lines are numbered, sent to their split's row, and put in order again
        numbered = lines.mapInArrow(_numbered, "value string, file string, start bigint, line bigint")
        found = numbered.join(placed.hint("merge"), ["file", "start"]).sortWithinPartitions("file", "start", "line")
    found = found.select("value", "file", "start", "inside", "row", "torn")
    whole = found.mapInArrow(_parser(True), _RECORDS)
    parts = found.filter("torn").mapInArrow(_parser(False), "file string, row bigint, start bigint, part string")
    return whole.unionByName(parts.groupBy("file", "row").applyInArrow(_joined, _RECORDS))
