import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolytics.sources.catalog import catalog_list, dataset_profile, seed_users
from annolytics.sources.export import export_annotations
from annolytics.sources.readers import SourceError, detect_source, is_whole_line, json_shapes, load_dataset, scan_csv, scan_json
from annolytics.sources.records import states_after
from annolytics.sources.rowindex import ingest, with_row_index, with_row_index_parquet

UNSUPPORTED = "Unsupported format: .xml. Supported: .csv, .json, .jsonl, .parquet"


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("team-7/speech", ("huggingface", None, "team-7/speech", None)),
        ("file:///mnt/labels/week.12.jsonl", ("file", "json", "/mnt/labels/week.12.jsonl", None)),
        ("http://store.test/a/b/Rows.Parquet", ("http", "parquet", "http://store.test/a/b/Rows.Parquet", None)),
        ("file:///mnt/labels/old.xml", ("file", None, "/mnt/labels/old.xml", UNSUPPORTED)),
        ("https://store.test/votes.json?key=x.y", ("http", "json", "https://store.test/votes.json?key=x.y", None)),
        ("corpus", ("huggingface", None, "corpus", None)),
        ("https://store.test/t.csv", ("http", "csv", "https://store.test/t.csv", None)),
    ],
)
def test_detect_source(spark, source, expected):
    row = spark.createDataFrame([(source,)], "s string").select(detect_source(F.col("s")).alias("d")).first()["d"]
    assert (row["source_type"], row["format"], row["path"], row["error"]) == expected


def test_csv_types_and_quoting(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('text,label,day,at\n"hello, ""you""\nthere",0,2024-01-02,2024-01-02 03:04:05\nworld,1,2024-01-03,2024-01-02 00:00:00\n')
    df = scan_csv(spark, str(path), line_breaks=True)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "int", "string", "string"]
    assert df.collect()[0]["text"] == 'hello, "you"\nthere'
    assert df.collect()[1]["day"] == "2024-01-03"


def test_json_lines_and_arrays(spark, tmp_path):
    lines, array = tmp_path / "a.jsonl", tmp_path / "b.json"
    lines.write_text('{"a":1,"n":{"x":[1,2]}}\n{"a":2}\n')
    array.write_text(json.dumps([{"a": 3}, {"a": 4}], indent=1))
    assert [r["a"] for r in load_dataset(spark, f"file://{lines}").collect()] == [1, 2]
    assert [r["a"] for r in load_dataset(spark, str(array)).collect()] == [3, 4]
    assert scan_json(spark, str(lines)).select("n.x").first()["x"] == [1, 2]


def test_each_json_file_is_read_by_its_own_shape(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": i} for i in range(100)], indent=2))
    (tmp_path / "b.jsonl").write_text("".join(f'{{"a":{i}}}\n' for i in range(100, 150)))
    (tmp_path / "c.json").write_text(json.dumps([{"a": i} for i in range(150, 160)]))
    (tmp_path / "d.json").write_text('\n{"a": 160,\n "b": "x"}')
    (tmp_path / "e.json").write_text('{"a":161}\n{"a":162}\n')
    (tmp_path / "f.json").write_text("")
    assert sorted(r["a"] for r in load_dataset(spark, str(tmp_path)).collect()) == list(range(163))
    (tmp_path / "g.json").write_text('{"a":163}\n{"a":\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        load_dataset(spark, str(tmp_path)).collect()


@pytest.fixture
def split_size(spark):
    """Set the size that files are cut at."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, str(size))
    spark.conf.set(key, before)


SPLITS = ["128m", 150, 1000]


@pytest.mark.parametrize("split", SPLITS)
def test_json_values_over_several_lines(spark, tmp_path, split, split_size):
    """Objects one after another, arrays, and both, however files are cut."""
    value = lambda i: {"a": i, "s": "}]' \\\\\" {[, " * (i % 3), "n": [{"x": [i, i]}, {"x": []}]}
    files = {
        "array.json": json.dumps([value(i) for i in range(20)], indent=2) + "\n \n\n",
        "blank.json": "\n\n" + json.dumps([value(i) for i in range(20, 23)], indent=1),
        "objects.json": "\n".join(json.dumps(value(i), indent=1) for i in range(23, 30)),
        "then_lines.json": json.dumps(value(30), indent=1) + "\n" + json.dumps(value(31)) + "\n",
        "array_then.json": json.dumps([value(32), value(33)], indent=1) + "\n\n" + json.dumps(value(34)),
        "same_line.json": json.dumps(value(35), indent=1) + json.dumps(value(36)) + " " + json.dumps(value(37)),
        "close.json": "[" + json.dumps(value(38)) + ",\n" + json.dumps(value(39)) + ", " + json.dumps(value(40)) + "\n,\n" + json.dumps(value(41), indent=3) + "]",
        "two_arrays.json": json.dumps([value(42)], indent=1) + json.dumps([value(43)], indent=1) + "[]\n[\n]",
        "quotes.json": "{'a': 44,\n 's': '}\"', 'n': []}",
        "lines.json": json.dumps(value(45)) + "\n" + json.dumps(value(46)) + "\n",
        "empty.json": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    split_size(split)
    rows = load_dataset(spark, f"{tmp_path}/*.json").collect()
    assert sorted(r["a"] for r in rows) == list(range(47))
    for r in rows:
        if r["a"] != 44:
            assert (r["s"], [list(n["x"]) for n in r["n"]]) == (value(r["a"])["s"], [[r["a"], r["a"]], []])
    indexed = load_dataset(spark, f"{tmp_path}/*.json", row_index=True).collect()
    order = [int(a) for name in sorted(files) for a in re.findall(r"""["']a["']: (\d+)""", files[name])]
    assert [r["a"] for r in sorted(indexed, key=lambda r: r["row_index"])] == order
    assert sorted(r["row_index"] for r in indexed) == list(range(47))


@pytest.mark.parametrize("split", [9])
@pytest.mark.parametrize("text", ['{"a":\n1}\n}', '{"a":\n1', '[\n{"a":1},\n', '{"a":\n1} 3', '[\n1, 2]', '{"a":\n"x}\n', '[\n[{"a":1}]]', '[\n{"a":1} {"a":2}]', '{\n"a" 1}'])
def test_malformed_json_documents_are_errors(spark, tmp_path, split, text, split_size):
    (tmp_path / "good.json").write_text('{"a":\n1}')
    (tmp_path / "bad.json").write_text(text)
    split_size(split)
    with pytest.raises(Exception, match="(?i)malformed") as error:
        load_dataset(spark, f"{tmp_path}/*.json", "a bigint").collect()
    assert not isinstance(error.value, SourceError) or ("bad.json" in str(error.value) and "good.json" not in str(error.value))


@pytest.mark.parametrize("schema", [None, "a bigint"])
def test_bad_json_lines_are_errors(spark, tmp_path, schema):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n{"a":\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        load_dataset(spark, str(tmp_path / "a.jsonl"), schema).collect()


@pytest.mark.parametrize("folder", ["with blank", "per%20cent", "a[b]{c}", "plus+&=#"])
def test_names_with_special_characters(spark, tmp_path, folder):
    here = tmp_path / folder
    here.mkdir()
    (here / "one two.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    (here / "l.json").write_text('{"a":3}\n')
    (here / "t%41.csv").write_text('a,b\n1,"x\ny"\n')
    (here / "u.csv").write_text("a,b\n2,z\n")
    source = str(here).replace("[", "\\[").replace("{", "\\{").replace("]", "\\]").replace("}", "\\}")
    assert sorted(r["a"] for r in load_dataset(spark, f"{source}/*.json").collect()) == [1, 2, 3]
    assert sorted((r["a"], r["b"]) for r in load_dataset(spark, f"{source}/*.csv", "a int, b string").collect()) == [(1, "x\ny"), (2, "z")]


def test_shapes_need_the_listing_and_first_bytes_only(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": i} for i in range(100)], indent=2))
    (tmp_path / "b.json").write_text('{"a":1}\n' * 50)
    spark.sparkContext.setJobGroup("shapes", "")
    lines, documents = json_shapes(spark, str(tmp_path))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("shapes")
    spark.sparkContext.setJobGroup("other", "")
    assert [f.rsplit("/", 1)[1] for f in lines + documents] == ["b.json", "a.json"]
    for head, is_all, whole in [
        ('\n{"a":1}\n{', False, True), ("[\n", False, False), ('{"a":1} {"b":2}\n', True, False), ('{"a":"' + "x" * 100, False, True), ('{"a":', True, False), ("", True, True), ("3\n", True, True),
    ]:
        assert is_whole_line(head, is_all) == whole


FIELDS = ["", "x", "two words", "a,b", 'say ""hi""', "line\nbreak", "\n", ',\n"",', "é 日本", " lead", '""', "tail \n\n"]


def csv_text(n, end):
    """A table of quoted and plain fields, some with a quote in the middle that means nothing."""
    lines = ["id,text,note"]
    for i in range(n):
        field = FIELDS[i % len(FIELDS)] * (1 + i % 2)
        plain = ['5" pipe', "x", "", 'a"b"c'][i % 4]
        lines.append(f'{i},"{field}",{plain}' if field or i % 2 else f"{i},,{plain}")
        if i % 9 == 0:
            lines.append("")
    return end.join(lines) + end * (n % 2)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", SPLITS)
def test_csv_line_breaks_at_every_split(spark, tmp_path, split, end, split_size):
    with open(tmp_path / "a.csv", "w", newline="") as file:
        file.write(csv_text(151, end))
    (tmp_path / "b.csv").write_text("id,text,note\n900,plain,\n901,,z\n")
    with open(tmp_path / "c.csv", "w", newline="") as file:
        file.write(csv_text(40, end).replace("id,text,note", f'"id",text,"no{end}te"'))
    (tmp_path / "d.csv").write_text("id,text,note\n")
    (tmp_path / "e.csv").write_text("")
    schema = "id int, text string, note string"
    want = spark.read.options(header=True, multiLine=True, escape='"').schema(schema).csv(f"{tmp_path}/*.csv").collect()
    assert len(want) == 193
    split_size(split)
    got = load_dataset(spark, f"{tmp_path}/*.csv", schema)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)
    if split != "128m":
        assert got.rdd.getNumPartitions() > 1
    indexed = load_dataset(spark, f"{tmp_path}/*.csv", schema, row_index=True).collect()
    ordered = [tuple(r)[1:] for r in sorted(indexed, key=lambda r: r["row_index"])]
    per_file = [spark.read.options(header=True, multiLine=True, escape='"').schema(schema).csv(f"{tmp_path}/{n}.csv").collect() for n in "abcd"]
    assert ordered == [tuple(r) for rows in per_file for r in rows]
    assert sorted(r["row_index"] for r in indexed) == list(range(193))


def test_csv_types_of_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,x,"day",t\n1,1.5,2024-01-02,"a\nb"\n2,2,2024-01-03,\n')
    (tmp_path / "b.csv").write_text("n,x,day,t\n30000000000,7,,c\n")
    df = load_dataset(spark, f"{tmp_path}/*.csv")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [("n", "bigint"), ("x", "double"), ("day", "string"), ("t", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, 1.5, "2024-01-02", "a\nb"), (2, 2.0, "2024-01-03", None), (30000000000, 7.0, None, "c")]


@pytest.mark.parametrize("split", [9])
def test_unbalanced_quotes_name_the_file(spark, tmp_path, split, split_size):
    (tmp_path / "good.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "bad.csv").write_text('a,b\n1,"x\n2,y\n3,z\n')
    split_size(split)
    with pytest.raises(SourceError, match="Unbalanced quotes: .*bad.csv$") as error:
        load_dataset(spark, f"{tmp_path}/*.csv")
    assert "good.csv" not in str(error.value)


def test_states_over_lines():
    """Against a walk from line to line."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        out, inside = rng.random(n) < 0.4, rng.random(n) < 0.6
        for start in (False, True):
            state, want = start, []
            for a, b in zip(out, inside):
                state = bool(b if state else a)
                want.append(state)
            assert states_after(out, inside, start).tolist() == want


def test_directories_and_globs(spark, tmp_path):
    mixed, only_json, nested = (tmp_path / n for n in ("mixed", "json", "nested"))
    for d in (mixed, only_json, nested / "deeper"):
        d.mkdir(parents=True)
    (mixed / "x.csv").write_text("a\n1\n2\n")
    (mixed / "y.jsonl").write_text('{"a":9}\n')
    (only_json / "x.json").write_text('{"a":1}\n')
    (only_json / "y.jsonl").write_text('{"a":2}\n')
    (nested / "one.csv").write_text("a\n7\n")
    (nested / "deeper" / "two.csv").write_text("a\n8\n")
    values = lambda source: sorted(r["a"] for r in load_dataset(spark, source).collect())
    assert values(f"file://{mixed}") == [1, 2]
    assert values(str(only_json)) == [1, 2]
    assert values(str(nested)) == [7]
    (mixed / "z1.csv").write_text("a\n3\n")
    assert values(f"{mixed}/z?.csv") == [3]
    assert values(f"{mixed}/*.csv") == [1, 2, 3]
    for bad in (f"{mixed}/q*.csv", str(tmp_path / "mixed" / "x.xlsx"), "https://example.com/data.csv"):
        with pytest.raises(SourceError):
            load_dataset(spark, bad)
    (tmp_path / "empty").mkdir()
    with pytest.raises(SourceError):
        load_dataset(spark, str(tmp_path / "empty"))


@pytest.mark.parametrize("fmt", ["csv", "jsonl"])
def test_row_index_over_many_splits(spark, tmp_path, fmt):
    """Three files of different size, each cut into several splits."""
    expected = 0
    for name, rows in (("a", 3000), ("b", 10), ("c", 1700)):
        lines = [f"{expected + i},{'x' * (i % 50)}" if fmt == "csv" else json.dumps({"id": expected + i, "t": "x" * (i % 50)}) for i in range(rows)]
        (tmp_path / f"{name}.{fmt}").write_text("\n".join(["id,t"] * (fmt == "csv") + lines) + "\n")
        expected += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        reader = spark.read.schema("id bigint, t string")
        df = reader.option("header", True).csv(f"{tmp_path}/*.csv") if fmt == "csv" else reader.json(f"{tmp_path}/*.jsonl")
        assert df.select(F.spark_partition_id()).distinct().count() > 3
        rows = with_row_index(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r["row_index"] == r["id"] for r in rows)
    assert sorted(r["row_index"] for r in rows) == list(range(expected))


def test_row_index_parquet_and_ingest(spark, tmp_path):
    raw, stored = str(tmp_path / "raw"), str(tmp_path / "stored")
    spark.range(5000).repartitionByRange(3, "id").sortWithinPartitions("id").write.option("parquet.block.size", 4096).parquet(raw)
    df = spark.read.parquet(raw)
    assert with_row_index_parquet(df).where("row_index <> id").count() == 0
    ingest(df, stored, parquet=True)
    assert spark.read.parquet(stored).where("row_index = id").count() == 5000


def test_profile_and_catalog(spark):
    df = spark.createDataFrame([("a", [1.0], None)], "s string, v array<float>, n struct<x:int>")
    row = dataset_profile("d1", df).first()
    assert row["num_rows"] == 1
    assert [(c["name"], c["type"]) for c in row["columns"]] == [("s", "string"), ("v", "list<float32>"), ("n", "struct<x: int32>")]
    rows = [("d1", '[{"name":"a","type":"string"}]', "2024-01-01"), ("d2", "[]", "2024-02-01")]
    listed = catalog_list(spark.createDataFrame(rows, "dataset_id string, columns string, created_at string")).collect()
    assert [r["dataset_id"] for r in listed] == ["d2", "d1"]
    assert listed[1]["columns"][0]["name"] == "a"


def test_seed_users(spark, tmp_path):
    path = tmp_path / "users.json"
    users = [
        {"id": "alice", "name": "Alice", "global_role": "system_admin"},
        {"id": "bob", "name": "Bob", "global_role": "annotator", "project_roles": {"proj-1": "project_admin", "proj-2": "annotator"}},
        {"id": "bob", "name": "Second Bob", "global_role": "system_admin", "project_roles": {"proj-1": "annotator", "proj-3": "annotator"}},
    ]
    path.write_text(json.dumps({"users": users}, indent=2))
    people, permissions = seed_users(spark, str(path))
    assert {tuple(r) for r in people.collect()} == {("alice", "Alice", "system_admin"), ("bob", "Bob", "annotator")}
    assert {tuple(r) for r in permissions.collect()} == {
        ("bob", "proj-1", "project_admin"), ("bob", "proj-2", "annotator"), ("bob", "proj-3", "annotator"),
    }
    people, permissions = seed_users(spark, str(path), existing=people)
    assert people.count() == permissions.count() == 0


def test_export_formats(spark, tmp_path):
    schema = "project_id string, row_index bigint, user_id string, data string, created_at timestamp_ntz, updated_at timestamp_ntz"
    empty = spark.createDataFrame([], schema)
    export_annotations(empty, "p", str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).columns == ["row_index", "user_id", "data", "created_at", "updated_at"]
    with pytest.raises(ValueError, match="Unsupported export format: xml"):
        export_annotations(empty, "p", str(tmp_path / "x"), "xml")
