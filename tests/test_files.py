from __future__ import annotations

import csv
import glob
import io
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.dataset import records_from_table
from tamis.errors import (
    FileTooLarge,
    MixedTypes,
    NoSupportedFiles,
    PathNotFound,
    UnrepresentableValue,
    UnsupportedFormat,
)
from tamis.functions.canonical import canonical_text
from tamis.operators.equivalence import equivalent
from tamis.plans.path import analyze_path
from tamis.sinks import exports
from tamis.sinks.exports import export_records
from tamis.sources import json_array, parquet_files
from tamis.sources.ingest import read_records
from tamis.sources.json_array import array_elements
from tamis.sources.manifest import detect_format, list_files


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text("aé:;0", max_size=4),
    lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text("ab:0", max_size=2), v, max_size=3), max_leaves=6,
)


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        target = tmp_path / "in"
        target.mkdir(exist_ok=True)
        for name, content in files.items():
            data = content if isinstance(content, bytes) else content.encode("utf-8")
            (target / name.replace("__", ".")).write_bytes(data)
        return str(target)

    return write


def records(ds):
    rows = ds.df.select("rec_ord", "loc", ds.content.fields_json().alias("j")).orderBy("rec_ord")
    return [(r.loc, json.loads(r.j)) for r in rows.collect()]


def problems(ds):
    rows = ds.parse_issues.orderBy("issue_ord").collect()
    return [(r["loc"].line_number, r["loc"].array_index, r.field_name, r.detail) for r in rows]


# Listing


def test_formats():
    assert [detect_format(p) for p in ("a.JSON", "b.jsonl", "c.d.csv", "e.Parquet", "f.txt", ".json", "g")] == [
        "json", "jsonl", "csv", "parquet", None, None, None,
    ]


def test_listing(spark, folder, tmp_path):
    path = folder(b__csv="h\n1\n", a__jsonl="", c__txt="x", _d__json="[]")
    (tmp_path / "in" / "sub.json").mkdir()
    manifest = list_files(spark, path)
    assert [(f.name, f.status) for f in manifest.files] == [
        ("_d.json", "readable"), ("a.jsonl", "readable"), ("b.csv", "readable"), ("c.txt", "skipped"),
    ]
    assert manifest.files[2].path == f"{path}/b.csv"


def test_listing_errors(spark, folder, tmp_path):
    with pytest.raises(PathNotFound):
        list_files(spark, str(tmp_path / "none"))
    with pytest.raises(NoSupportedFiles):
        list_files(spark, folder(x__txt="x"))
    path = folder(big__csv="h\n" + "x" * (1 << 20), small__csv="h\n1\n")
    with pytest.raises(FileTooLarge) as caught:
        list_files(spark, f"{path}/big.csv", 1000)
    assert (caught.value.limit_bytes, caught.value.actual_bytes) == (1000, (1 << 20) + 2)
    ds = read_records(spark, path, 1000)
    (found,) = ds.parse_issues.collect()
    assert found.loc.source_file == f"{path}/big.csv" and "size limit" in found.detail
    assert read_records(spark, path).df.count() == 2  # no limit unless asked for
    assert (ds.oversize_files, ds.source_files) == ([f"{path}/big.csv"], [f"{path}/small.csv"])
    assert ds.df.count() == 1
    only = read_records(spark, f"{path}/x.txt")
    assert (only.skipped_files, only.df.count()) == ([f"{path}/x.txt"], 0)


def test_long_csv_fields(spark, folder):
    for quote in ("", '"'):
        path = folder(a__csv="h,k\n1,2\n" + f"{quote}{'x' * 140_000}{quote},4\n5,6\n7,8\n")
        rows = read_records(spark, path).df.orderBy("rec_ord").collect()
        got = [(len(r.fields[0].str), r.fields[1].str) for r in rows]
        assert got == [(1, "2"), (140_000, "4"), (1, "6"), (1, "8")]


# JSON


def test_json_array(spark, folder):
    path = folder(a__json='[{"a": 1, "b": {"z": 1, "y": [1.0, null]}}, 3, "s", [1], null, {"t": true}]',
                  b__json=" [ ] ", c__json='{"a": 1}', d__json="[1,", e__json=b'[{"a": "\xff"}]', f__json="")
    ds = read_records(spark, path)
    got = records(ds)
    assert [(loc.array_index, value) for loc, value in got] == [
        (0, {"a": 1, "b": {"z": 1, "y": [1.0, None]}}), (5, {"t": True}),
    ]
    assert [p[3] for p in problems(ds)] == [
        "JSON array element is not an object (found int)",
        "JSON array element is not an object (found str)",
        "JSON array element is not an object (found list)",
        "JSON array element is not an object (found NoneType)",
        "JSON top-level structure is not an array (found dict)",
        "Malformed JSON payload: Expecting value: line 1 column 4 (char 3)",
        "Malformed JSON payload: 'utf-8' codec can't decode byte 0xff in position 8: invalid start byte",
        "Malformed JSON payload: Expecting value: line 1 column 1 (char 0)",
    ]


@pytest.mark.parametrize("chunk", [1, 3, 17, 1 << 20])
def test_streamed_array_decoding_agrees_with_json(monkeypatch, chunk):
    monkeypatch.setattr("tamis.sources.decode.CHUNK", chunk)
    rng = random.Random(chunk)
    value = [{"k": "é😀\\\"\n", "n": [1, -2.5e10, None, True, "x" * 50]}, 12345, [], {}, "a,]"]
    good = json.dumps(value, ensure_ascii=False, indent=1)
    cases = ["[]", " [1 , 2]\n", good, json.dumps(value), "[NaN, -Infinity]", "[12", "[1 2]", "[1,2] x",
             "[nul]", "[\"abc", "[{\"a\":}]", "[\n{\"a\": 1},\n{\"b\" 2}]", "[", "[1,", "﻿[1]"]
    for _ in range(60):
        at = rng.randrange(1, len(good))
        cases += [good[:at], good[:at] + rng.choice(["x", "]", "}", ",", "\""]) + good[at:]]
    for text in cases:
        try:
            wanted = repr(json.loads(text))
        except ValueError as exc:
            wanted = str(exc)
        try:
            got = repr(list(array_elements(io.BytesIO(text.encode()))))
        except ValueError as exc:
            got = str(exc)
        except json_array._NotArray:
            continue
        if not wanted.startswith("Illegal trailing comma"):
            assert got == wanted, text
        else:
            assert got.startswith("Illegal trailing comma")


# JSONL


def test_jsonl(spark, folder):
    path = folder(
        a__jsonl='{"t": "one"}\r\n\n  \n{not json\n42\n[1, 2\n{"t": "  two"}\n{"d": 1, "d": 2}',
        b__jsonl=b'{"a": 1}\n{"b": "\xff"}\n',
        c__jsonl=b'\xef\xbb\xbf{"a": 1}\n{"a": 2}\n',
        _h__jsonl='{"hidden": 1}\n',
        e__jsonl="",
    )
    ds = read_records(spark, path)
    assert [(loc.source_file.rsplit("/")[-1], loc.line_number, v) for loc, v in records(ds)] == [
        ("_h.jsonl", 1, {"hidden": 1}),
        ("a.jsonl", 1, {"t": "one"}),
        ("a.jsonl", 7, {"t": "  two"}),
        ("a.jsonl", 8, {"d": 2}),
        ("c.jsonl", 2, {"a": 2}),
    ]
    assert problems(ds) == [
        (4, None, None, "Malformed JSON on line 4: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)"),
        (5, None, None, "JSONL line is not an object (found int)"),
        (6, None, None, "Malformed JSON on line 6: Expecting ',' delimiter: line 1 column 6 (char 5)"),
        (None, None, None, "Malformed JSONL payload: 'utf-8' codec can't decode byte 0xff in position 16: invalid start byte"),
        (1, None, None, "Malformed JSON on line 1: Unexpected UTF-8 BOM (decode using utf-8-sig): line 1 column 1 (char 0)"),
    ]


def test_line_numbers_over_many_splits(spark, folder):
    rng = random.Random(2)
    lines = {}
    files = {}
    for name in ("a__jsonl", "b__jsonl", "c__csv"):
        body = [f'{{"i": {i}, "x": "{"y" * rng.randint(0, 90)}"}}' if rng.random() < 0.9 else ""
                for i in range(1, 700)]
        if name.endswith("csv"):
            body = ["i"] + [str(i) if rng.random() < 0.9 else "" for i in range(2, 3000)]
        files[name] = "\n".join(body)
        lines[name.replace("__", ".")] = body
    path = folder(**files)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = records(read_records(spark, path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == sum(1 for n, b in lines.items() for x in b if x and x != "i")
    assert all(int(value["i"]) == loc.line_number for loc, value in got)


# CSV


def csv_expected(text: str):
    """What the csv module reads: ``[(line, row)]`` after the header."""
    reader = csv.reader(io.StringIO(text))
    header = next(reader)
    return [(reader.line_num, dict(zip(header, row))) for row in reader if row and len(row) == len(header)]


def test_csv_paths_agree_with_the_csv_module(spark, folder):
    rng = random.Random(3)
    cells = ["a", "", " b ", "x y", "é", "1.5", "\t"]
    texts = {"plain__csv": "h1,h2,h3\r\n" + "".join(
        ",".join(rng.choices(cells, k=rng.choice([3, 3, 3, 2, 4]))) + rng.choice(["\n", "\r\n", "\n\n"])
        for _ in range(200))}
    quoted = io.StringIO()
    writer = csv.writer(quoted)
    writer.writerow(["h1", "h2", "h3"])
    for _ in range(200):
        writer.writerow(rng.choices(cells + ['q"q', "new\nline", "com,ma", "\r"], k=3))
    texts["quoted__csv"] = quoted.getvalue()
    ds = read_records(spark, folder(**texts))
    for name, text in texts.items():
        own = [(loc.line_number, v) for loc, v in records(ds) if loc.source_file.endswith(name.replace("__", "."))]
        assert own == csv_expected(text)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def whole_file(text: str):
    """Good rows, wrong widths and the complaint of the csv module that reads the file as one."""
    reader = csv.reader(io.TextIOWrapper(io.BytesIO(text.encode()), "utf-8", newline="\n"))
    rows, widths, broken, header = [], [], None, None
    try:
        header = next(reader)
        for row in reader:
            if row:
                (rows if len(row) == len(header) else widths).append((reader.line_num, row))
    except csv.Error as exc:
        broken = (reader.line_num, f"Malformed CSV on line {reader.line_num}: {exc}")
    return header, rows, [n for n, _ in widths], broken


def test_quoted_csv_in_splits(spark, folder, small_splits):
    """Rows, line numbers and complaints of split files are those of files read as one."""
    rng = random.Random(5)
    texts = {
        "long__csv": 'h,k\n"' + "x\n" * 200 + '",1\n2,3\n"' + 'a""b\n\n' * 100 + '",9\n5,6',
        "open__csv": 'h,k\n1,2\n3,"' + "never closed\n" * 30, "open_end__csv": 'h,k\n1,2\n3,"' + "never closed\n" * 30 + "x",
        "header__csv": '"h\n' + "y\n" * 60 + '",k\n1,2\n', "in_header__csv": '"h" x\rz,k\n1,2\n' * 9,
        "wrong__csv": "h,k\n" + '1,"2"\n' * 20 + '"3\n4"\r5,6\n' + '1,"2"\n' * 20,
        "crlf__csv": 'h,k\r\n"1\r\n",2\r\n\r\n' * 20,
    }
    for n in range(5):
        parts = ['a', '"', '""', ',', '"x y"', '"\n"', '\n', '\n', 'b,c\n', '"d\ne",f\n'] + (['\r\n'] if n % 2 else [])
        texts[f"odd{n}__csv"] = "h,k\n" + "".join(rng.choices(parts, k=250)) + ('"' if n % 3 else "")
    path = folder(**texts)
    names = [f"{path}/{n.replace('__', '.')}" for n in texts]
    assert spark.read.text(names).rdd.getNumPartitions() > 25
    ds = read_records(spark, path)
    issues, found_rows = [r.asDict(recursive=True) for r in ds.parse_issues.collect()], records(ds)
    for name, text in texts.items():
        header, rows, widths, broken = whole_file(text)
        at = name.replace("__", ".")
        own = [(loc.line_number, v) for loc, v in found_rows if loc.source_file.endswith("/" + at)]
        assert own == [(n, dict(zip(header, row))) for n, row in rows], name
        found = [(i["loc"]["line_number"], i["detail"]) for i in issues if i["loc"]["source_file"].endswith("/" + at)]
        assert sorted(n for n, d in found if d.startswith("CSV row")) == widths, name
        assert [f for f in found if f[1].startswith("Malformed")] == ([broken] if broken else []), name
        assert any("no header" in d for _, d in found) == (header is None), name


def test_csv_defects(spark, folder):
    ds = read_records(
        spark,
        folder(
            a__csv="", b__csv="\na,b\n", c__csv="a,b,a\n1,2,3\n", d__csv='x,x,y,y\n"1",2,3,4\n',
            e__csv=b"a\n\xff\n", f__csv="a,b\n1,2\n", g__csv="t,l\nok,1\nshort\n1,2,3\n",
            h__csv="only,header\n", i__csv='t,l\n"quo\nted",1\nbad\n',
        ),
    )
    assert [(loc.source_file[-5:], loc.line_number, v) for loc, v in records(ds)] == [
        ("f.csv", 2, {"a": "1", "b": "2"}), ("g.csv", 2, {"t": "ok", "l": "1"}),
        ("i.csv", 3, {"t": "quo\nted", "l": "1"}),
    ]
    assert problems(ds) == [
        (None, None, None, "CSV file has no header row"),
        (None, None, None, "CSV file has no header row"),
        (1, None, "a", "CSV header contains duplicate field names: 'a'"),
        (1, None, "x", "CSV header contains duplicate field names: 'x', 'y'"),
        (None, None, None, "Malformed CSV payload: 'utf-8' codec can't decode byte 0xff in position 2: invalid start byte"),
        (3, None, None, "CSV row on line 3 has 1 fields but the header declares 2"),
        (4, None, None, "CSV row on line 4 has 3 fields but the header declares 2"),
        (4, None, None, "CSV row on line 4 has 1 fields but the header declares 2"),
    ]


# One content in several formats


def test_equal_records_of_all_formats_are_one_content(spark, folder):
    nested = {"s": 'é "q" \\u000b \x0b \n', "i": 7, "f": 0.1, "b": True, "n": None,
              "l": [1, 2, None], "d": [1e-7, 2.0, -0.0], "o": {"z": "x", "a": [{"k": "v", "j": None}], "m": 1.5}}
    moved = {k: nested[k] for k in reversed(nested)}
    moved["o"] = {k: nested["o"][k] for k in ("m", "z", "a")}
    other = {**nested, "i": 7.0}
    path = folder(
        a__jsonl="".join(json.dumps(r) + "\n" for r in (nested, moved, other)), b__json=json.dumps([moved]),
    )
    pq.write_table(pa.Table.from_pylist([nested, nested]), f"{path}/c.parquet")
    pq.write_table(pa.Table.from_pylist([moved]), f"{path}/d.parquet")
    pq.write_table(pa.Table.from_pylist([moved]), f"{path}/_hidden.parquet")
    ds = read_records(spark, path)
    keys = [bytes(r.k) for r in ds.df.select(ds.content.key().alias("k")).collect()]
    assert len(keys) == 8 and sorted(keys.count(k) for k in set(keys)) == [1, 7]
    typed = records_from_table(spark.read.parquet(f"{path}/c.parquet"), list(nested), F.monotonically_increasing_id())
    assert {bytes(r.k) for r in typed.df.select(typed.content.key().alias("k")).collect()} == {
        k for k in keys if keys.count(k) == 7
    }


@settings(deadline=None, max_examples=200)
@given(VALUES, VALUES)
def test_canonical_texts_tell_values_apart(a, b):
    same = json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
    assert (canonical_text(a) == canonical_text(b)) == same
    assert canonical_text([a, b]) != canonical_text([b, a]) or same


# Parquet


@pytest.mark.parametrize("limit", [0, 32_000_000])
def test_row_groups_are_found_by_search(spark, folder, monkeypatch, limit):
    """Uneven and empty groups, in files with one group and with many; no join compares ranges."""
    monkeypatch.setattr(parquet_files, "BROADCAST_BYTES", limit)
    path, expected = folder(), []
    for name, sizes in (("a", [3, 1, 5, 2, 7, 1, 1]), ("b", [4]), ("c", [0, 2, 3])):
        with pq.ParquetWriter(f"{path}/{name}.parquet", pa.schema([("v", pa.string())])) as writer:
            for group, size in enumerate(sizes):
                writer.write_table(pa.table({"v": pa.array([f"{name}{group}.{i}" for i in range(size)], pa.string())}))
    ds = read_records(spark, path)
    rows = ds.df.select("v", "loc.row_group", "loc.row_index").collect()
    assert len(rows) == 29
    for r in rows:
        group, index = r.v[1:].split(".")
        assert (r.row_group, r.row_index) == (int(group), int(index)), r
    plan = ds.df._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "_first" not in plan


def test_parquet_row_groups_and_corrupt_files(spark, folder, tmp_path):
    path = folder(bad__parquet=b"PAR1 not really")
    table = pa.table({"i": list(range(10)), "s": [None] + ["x"] * 9})
    pq.write_table(table, f"{path}/good.parquet", row_group_size=4)
    pq.write_table(table.select(["i"]), f"{path}/other.parquet")
    pq.write_table(table.slice(0, 2), f"{path}/_hidden.parquet")
    ds = read_records(spark, path)
    got = records(ds)
    assert [(loc.row_group, loc.row_index) for loc, _ in got[2:12]] == [
        (0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1),
    ]
    assert [v for _, v in got[2:4]] == [{"i": 0, "s": None}, {"i": 1, "s": "x"}]
    assert len(got) == 22 and got[0][0].source_file.endswith("_hidden.parquet")
    (problem,) = ds.parse_issues.collect()
    assert problem.detail.startswith("Malformed Parquet file: ")
    assert problem["loc"].source_file == f"{path}/bad.parquet" and problem["loc"].row_group is None


def test_unreadable_row_group(spark, folder):
    path = folder()
    file = f"{path}/x.parquet"
    pq.write_table(pa.table({"s": [f"value {i}" * 5 for i in range(300)]}), file, row_group_size=100,
                   compression="snappy", use_dictionary=False)
    start = pq.ParquetFile(file).metadata.row_group(1).column(0).data_page_offset
    data = bytearray(open(file, "rb").read())
    data[start : start + 40] = b"\xff" * 40
    open(file, "wb").write(bytes(data))
    pq.write_table(pa.table({"s": ["fine"] * 5}), f"{path}/y.parquet", row_group_size=2)
    ds = read_records(spark, path)
    assert [(r["loc"].source_file, r["loc"].row_group, r.detail[:31]) for r in ds.parse_issues.collect()] == [
        (file, 1, "Unreadable Parquet row group 1:")
    ]
    got = records(ds)
    assert [(loc.row_group, loc.row_index) for loc, _ in got[:200]] == [(g, i) for g in (0, 2) for i in range(100)]
    assert [v["s"] for _, v in got[:200]] == [f"value {i}" * 5 for i in range(300) if i // 100 != 1]
    assert [(loc.row_group, loc.row_index) for loc, _ in got[200:]] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert [r.detail[:31] for r in analyze_path(spark, path).analysis.issues.filter("category = 'parse_error'").collect()] == [
        "Unreadable Parquet row group 1:"]


def test_single_schema_parquet_stays_typed(spark, folder):
    path = folder()
    pq.write_table(pa.table({"i": [1, 2]}), f"{path}/a.parquet")
    pq.write_table(pa.table({"i": [3]}), f"{path}/b.parquet")
    ds = read_records(spark, path)
    assert ds.content.names == ("i",)
    assert [v for _, v in records(ds)] == [{"i": 1}, {"i": 2}, {"i": 3}]


# From path to report


def test_analyze_path(spark, folder):
    path = folder(
        a__jsonl='{"text": "A clean sample of some length."}\n{"text": "A clean sample of some length."}\nbroken\n'
        '{"text": "Mail a@b.org or call 555-123-4567 now"}\n',
        b__csv="text,label\nShort,1\n", c__txt="x",
    )
    done = analyze_path(spark, path)
    counts = {r.category: r.n_issues for r in done.report.counts.collect() if r.n_issues}
    assert counts == {"parse_error": 1, "duplicate": 1, "pii": 2, "low_quality_short": 1}
    rows = done.records.orderBy("index").collect()
    assert [r.n_issues for r in rows] == [0, 1, 2, 1]
    assert [r.redacted is not None for r in rows] == [False, False, True, False]
    assert done.report.totals().first() == (4, 5)
    with pytest.raises(UnsupportedFormat):
        analyze_path(spark, f"{path}/c.txt")


# Exports


VALUES = [
    {"s": "plain", "i": 1, "f": 1.0, "b": True, "n": None},
    {"s": "quo\"te, comma\nline\ttab \\ é😀  ", "i": -(2**60), "f": -0.0, "b": False, "n": None},
    {"s": "", "i": 0, "f": 1e-7, "b": True, "n": None},
]


@pytest.mark.parametrize("fmt", ["json", "jsonl", "parquet"])
def test_round_trip(spark, dataset, tmp_path, fmt):
    ds = dataset([{**v, "l": [1, {"k": "v"}]} if fmt != "parquet" else v for v in VALUES])
    export_records(ds, fmt, str(tmp_path / "out"))
    back = read_records(spark, str(tmp_path / "out"))
    wanted = ds if fmt != "parquet" else dataset([dict(v, n=None) for v in VALUES])
    assert equivalent(wanted, back)
    assert not equivalent(back, dataset(VALUES[:2]))
    assert not equivalent(back, dataset([VALUES[1], VALUES[0], VALUES[2]]))


def test_csv_export(spark, dataset, tmp_path):
    export_records(dataset([{"a": "x", "b": True}, {"c": 1.5, "a": None}, {"b": "q\"\r\n"}]), "csv", str(tmp_path / "o"))
    back = read_records(spark, str(tmp_path / "o"))
    assert [v for _, v in records(back)] == [
        {"a": "x", "b": "True", "c": ""}, {"a": "", "b": "", "c": "1.5"}, {"a": "", "b": 'q"\r\n', "c": ""},
    ]


def test_nested_parquet_export(spark, dataset, tmp_path):
    rows = [{"l": [1, 2], "o": {"a": "x", "b": 1.5}}, {"l": None, "o": {"a": "y", "b": 2.0}}]
    export_records(dataset(rows), "parquet", str(tmp_path / "o"))
    assert [v for _, v in records(read_records(spark, str(tmp_path / "o")))] == rows


def test_unrepresentable_values_stop_the_export(spark, dataset, tmp_path):
    out = str(tmp_path / "o")
    ds = dataset([{"a": "x"}, {"a": "y", "b": [float("inf")], "c": float("nan")}, {"b": {}}])
    for fmt, field in (("json", "b"), ("jsonl", "b"), ("csv", "b")):
        with pytest.raises(UnrepresentableValue) as caught:
            export_records(ds, fmt, out)
        assert (caught.value.record_index, caught.value.field_name) == (1, field)
    typed = records_from_table(
        spark.createDataFrame([(5, 1.0, [0.0]), (7, 2.0, [float("nan")])], "i long, d double, l array<double>"),
        ["d", "l"], "i",
    )
    with pytest.raises(UnrepresentableValue) as caught:
        export_records(typed, "json", out)
    assert (caught.value.record_index, caught.value.field_name) == (1, "l")
    with pytest.raises(MixedTypes):
        export_records(dataset([{"a": 1}, {"a": "x"}]), "parquet", out)
    with pytest.raises(UnsupportedFormat):
        export_records(ds, "xml", out)
    assert not glob.glob(out)


def test_empty_exports(spark, dataset, tmp_path):
    texts = {}
    for fmt in ("json", "jsonl", "csv"):
        files = export_records(dataset([]), fmt, str(tmp_path / fmt))
        texts[fmt] = "".join(open(f).read() for f in files).strip()
    assert texts == {"json": "[]", "jsonl": "", "csv": ""}


def test_numbers_and_text_of_typed_records(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.5, ["a", None], (2, "z"), [0.25], True)],
        "i long, n int, f float, l array<string>, o struct<x:int,y:string>, v array<float>, b boolean",
    ).withColumn("t", F.lit("2020-01-01").cast("timestamp")).withColumn("m", F.create_map(F.lit("k"), F.lit("v")))
    ds = records_from_table(df, ["n", "f", "l", "o", "v", "b", "t", "m"], "i")
    assert ds.df.select(ds.content.text()).first()[0] == "1 0.5 a 2 z 0.25"
    types = [(t.name, t.type) for t in ds.df.select(ds.content.field_types()).first()[0]]
    assert types == [("n", "integer"), ("f", "float"), ("l", "list"), ("o", "object"), ("v", "list"),
                     ("b", "boolean"), ("t", "object"), ("m", "list")]


def test_integers_beyond_64_bits_stop_a_parquet_export(spark, folder, tmp_path):
    path = folder(a__jsonl='{"n": 1}\n' + '{"n": %d}\n' % 2**70)
    target = str(tmp_path / "out")
    with pytest.raises(UnrepresentableValue) as caught:
        export_records(read_records(spark, path), "parquet", target)
    assert "'n'" in str(caught.value) and "index 1" in str(caught.value)
    assert not (tmp_path / "out").exists()


def test_parquet_export_finds_all_types_in_one_job(spark, dataset, tmp_path, monkeypatch):
    """Merged schemas of several nested fields come from one aggregate; the first wide integer is named."""
    seen = []
    own = exports._tagged_types
    monkeypatch.setattr(exports, "_tagged_types", lambda ds: seen.append(1) or own(ds))
    ds = dataset([
        {"a": {"x": 1}, "b": [1], "c": [[None]], "n": 1}, {"a": {"y": "q"}, "b": [2.5], "c": [["s"]], "n": None}, {"d": [{"k": True}]},
    ])
    export_records(ds, "parquet", str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    assert len(seen) == 1
    assert {f.name: f.dataType.simpleString() for f in back.schema} == {
        "a": "struct<x:bigint,y:string>", "b": "array<double>", "c": "array<array<string>>", "n": "bigint",
        "d": "array<struct<k:boolean>>",
    }
    with pytest.raises(MixedTypes):
        export_records(dataset([{"a": [1]}, {"a": ["x"]}]), "parquet", str(tmp_path / "p"))
    with pytest.raises(UnrepresentableValue, match="1"):
        export_records(dataset([{"m": 5, "n": 1}, {"n": 2**70}, {"m": 2**80}]), "parquet", str(tmp_path / "q"))


def test_jsonl_is_decoded_in_slices_of_text():
    """decoded values of a batch are never held all at once."""
    from tamis.sources.decode import text_slices

    batch = pa.RecordBatch.from_pydict({"value": ["a" * n for n in (5, 0, 30, 4, 4)] + [None, "b" * 9], "i": range(7)})
    parts = list(text_slices(batch, "value", 10))
    assert [p.num_rows for p in parts] == [2, 1, 3, 1]
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert list(text_slices(batch.slice(0, 0), "value", 10)) == []


def test_each_parse_error_is_a_row(spark, tmp_path):
    """one row for each line with its own detail, not a count of them."""
    from checks.spark_queries import parse_errors

    rows = [(i * 3, ["x", "  ", "name"][i % 3]) for i in range(40)] + [(500, None)]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    found = sorted((r.category, r.detail, r.n) for r in parse_errors(spark, str(tmp_path)).collect())
    right = [("parse_error", f"Malformed JSON on line {i + 1}: Expecting value: line 1 column 1 (char 0)", 1) for i in range(27)]
    assert found == sorted(right)


def test_more_orders_are_more_files_with_the_same_coordinates(spark, tmp_path, monkeypatch):
    """files do not grow with the table."""
    from checks import spark_queries

    monkeypatch.setattr(spark_queries, "ROWS_PER_FILE", 300)
    rows = [(i * 7, f"order {i} " * 30) for i in range(2000)]
    spark.createDataFrame(rows, "o_orderkey long, o_comment string").write.parquet(f"{tmp_path}/orders.parquet")
    sizes = []

    def counted(session, folder, run=spark_queries.read_records):
        files = session.read.parquet(folder).groupBy(F.col("_metadata.file_name")).count().collect()
        sizes.extend(r["count"] for r in files)
        return run(session, folder)

    monkeypatch.setattr(spark_queries, "read_records", counted)
    assert spark_queries.parquet_coordinates(spark, str(tmp_path)).collect() == [(2000, 2000, True)]
    assert max(sizes) < 600
