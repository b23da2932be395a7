import json
import os

import pytest

from annolytics.sources import ledger as lg
from annolytics.sources.readers import SourceError


def rows_of(spark, path, column="a"):
    return [r[column] for r in sorted(lg.read_ingested(spark, path).collect(), key=lambda r: r["row_index"])]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_new_files_get_the_next_numbers(spark, tmp_path, fmt):
    source, path = tmp_path / "in put", str(tmp_path / "stored")
    source.mkdir()

    def add(name, values):
        file = source / f"{name}.{fmt}"
        if fmt == "csv":
            file.write_text("a,t\n" + "".join(f'{v},"line\n{v}"\n' for v in values))
        elif fmt == "json":
            file.write_text(json.dumps([{"a": v, "t": f"line\n{v}"} for v in values], indent=1))
        else:
            import pandas as pd

            pd.DataFrame({"a": values, "t": [f"line\n{v}" for v in values]}).to_parquet(file)

    add("m", range(10, 15))
    add("p", range(20, 22))
    assert lg.ingest_files(spark, str(source), path) == 7
    assert rows_of(spark, path) == [10, 11, 12, 13, 14, 20, 21]
    assert lg.ingest_files(spark, str(source), path) == 0
    # Names before and between the known ones: numbers go on all the same.
    add("a", range(100, 103))
    add("n", range(200, 201))
    known = source / f"m.{fmt}"
    times = os.stat(known)
    known.write_bytes(b"\xff" * times.st_size)
    os.utime(known, ns=(times.st_atime_ns, times.st_mtime_ns))
    # A known file is not read again: what is in it now could not be.
    assert lg.ingest_files(spark, str(source), path) == 4
    assert rows_of(spark, path) == [10, 11, 12, 13, 14, 20, 21, 100, 101, 102, 200]
    assert sorted(r.row_index for r in lg.read_ingested(spark, path).collect()) == list(range(11))
    ledger = {r.file.rsplit("/", 1)[1].split(".")[0]: (r["first"], r["rows"]) for r in lg.read_ledger(spark, path).collect()}
    assert ledger == {"m": (0, 5), "p": (5, 2), "a": (7, 3), "n": (10, 1)}
    assert "_file" not in lg.read_ingested(spark, path).columns


def test_changed_and_lost_files_are_errors(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "stored")
    source.mkdir()
    (source / "a.jsonl").write_text('{"a":1}\n')
    (source / "b.jsonl").write_text('{"a":2}\n')
    (source / "empty.jsonl").write_text("")
    assert lg.ingest_files(spark, str(source), path) == 2
    (source / "b.jsonl").write_text('{"a":2}\n{"a":3}\n')
    (source / "c.jsonl").write_text('{"a":9}\n')
    with pytest.raises(SourceError, match="b.jsonl$"):
        lg.ingest_files(spark, str(source), path)
    os.remove(source / "b.jsonl")
    with pytest.raises(SourceError, match="gone.*b.jsonl$"):
        lg.ingest_files(spark, str(source), path)
    assert rows_of(spark, path) == [1, 2]


def test_a_run_that_dies_adds_nothing(spark, tmp_path, monkeypatch):
    source, path = tmp_path / "in", str(tmp_path / "stored")
    source.mkdir()
    (source / "a.jsonl").write_text('{"a":1}\n')
    monkeypatch.setattr(lg, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        lg.ingest_files(spark, str(source), path)
    monkeypatch.undo()
    with pytest.raises(SourceError, match="nothing"):
        lg.read_ingested(spark, path)
    assert lg.ingest_files(spark, str(source), path) == 1 and rows_of(spark, path) == [1]
