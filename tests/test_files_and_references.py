"""CSV files in splits against whole files, and references against brute force."""

import os
import random

import pytest

from shapewright import NotColumnar, csv_file_records, csv_file_rows, dangling, reference_paths
from shapewright.sources import csv_files
from shapewright.sources.values import csv_records


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "128", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def random_csv(rng):
    out = []
    for _ in range(rng.randint(0, 30)):
        record = []
        for _ in range(rng.randint(1, 4)):
            text = "".join(rng.choice(["a", "b", ",", '"', "\n", "\r", "\r\n", "é", " "]) for _ in range(rng.choice([0, 1, 3, 8, 60])))
            if any(c in text for c in ',"\n\r') or rng.random() < 0.3:
                text = '"' + text.replace('"', '""') + '"'
            elif rng.random() < 0.1:
                text += '5" x'
            record.append(text)
        out.append(",".join(record) + rng.choice(["\n", "\r\n", "\n", "\n\n", "\r"]))
    return "".join(out)


@pytest.mark.parametrize("splits", [csv_files.SPLITS, 0])
def test_files_in_splits(spark, small_splits, tmp_path, monkeypatch, splits):
    monkeypatch.setattr(csv_files, "SPLITS", splits)
    rng = random.Random(3)
    want = {}
    for k in range(5):
        text = random_csv(rng) + ("" if k else "last,one")
        (tmp_path / f"f{k}.csv").write_text(text, newline="")
        want[f"f{k}.csv"] = csv_records(text)
    got = {}
    for r in csv_file_records(spark, str(tmp_path)).collect():
        assert got.setdefault(os.path.basename(r.file), {}).setdefault(r.row, r.fields) is r.fields
    assert {n: [v[i] for i in range(len(v))] for n, v in got.items()} == {n: v for n, v in want.items() if v}


def test_file_rows(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("n,t\n" + "".join(f'{i},"x\ny{i}"\n' for i in range(40)))
    rows = csv_file_rows(spark, str(tmp_path), 'file = [["n", "t"], * [0..29, tstr]]', has_header=True).orderBy("row").collect()
    assert [r.row for r in rows] == list(range(41)) and [r.valid for r in rows] == [True] * 31 + [False] * 10
    assert rows[3].fields == ["2", "x\ny2"]


def test_reference_paths():
    schema = 'd = { a: ref-x, b: [* ref-x / { c: ref-y }], ? e: g<ref-y>, h }\ng<t> = [t, int]\nh = (k: ref-x)\nref-x = int\nref-y = tstr'
    assert sorted(reference_paths(schema), key=repr) == sorted([(("a",), "x"), (("b", None), "x"), (("b", None, "c"), "y"), (("e", None), "y"), (("k",), "x")], key=repr)
    with pytest.raises(NotColumnar):
        reference_paths("d = { * tstr => ref-x }\nref-x = int")


def test_dangling(spark):
    docs = ['{"a":1,"b":[2,{"c":"q"},9]}', '{"a":7}', '{"a":null,"b":[]}', "[1]", "{", None, '{"a":7}', '{"a":"1","b":[null,{"c":null},{"c":"p"}]}'] + ['{"a":8}'] * 30
    df = spark.createDataFrame(list(enumerate(docs)), "location int, t string")  # a column whose name is one of the result's
    df = df.withColumnRenamed("location", "i")
    x, y = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k int"), spark.createDataFrame([("p",)], "k string")
    schema = "d = { a: ref-x, ? b: [* ref-x / { c: ref-y }] }\nref-x = int\nref-y = tstr"
    got = sorted((r.i, r.location, r.table, r.value) for r in dangling(df, schema, "t", {"x": (x, "k"), "y": (y, "k")}).collect())
    assert got == sorted([(0, "/b/1/c", "y", "q"), (0, "/b/2", "x", "9"), (1, "/a", "x", "7"), (6, "/a", "x", "7")] + [(8 + i, "/a", "x", "8") for i in range(30)])
    assert dangling(df.filter("false"), schema, "t", {"x": (x, "k"), "y": (y, "k")}).count() == 0
    with pytest.raises(ValueError, match="no tables"):
        dangling(df, schema, "t", {"x": (x, "k")})
