"""Records that run over several lines, put together by the tasks that read the lines.

A file is cut into splits anywhere, also inside a record. What a split does to the state of the reader is known for every
state it may start in; composed over the splits of a file, these give each split its true start. Tasks then own the
records that start in their split, and the few pieces of records that cross a border are joined afterwards.
Records stay text: Spark's own parsers read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolytics.session import settle
from annolytics.sources.rowindex import pin_splits


class SourceError(ValueError):
    """A source that cannot be read as a dataset."""


def file_paths(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files under a path, from its listing. Nothing is read; the listing's names are addresses, in which blanks and the like are escaped."""
    return sorted(plain_name(name) for name in spark.read.text(path).inputFiles())


def plain_name(address: str) -> str:
    """A file's name from its address, of which there are two spellings for local files."""
    return re.sub("^file:/+", "file:/", unquote(address))


def reader_path(file: str) -> str:
    """A file's name as a path in which no character is a wildcard."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", file)


def text_lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """``(value, file, at, split)``: the lines of files, in order within a split; ``split`` is a hash of file and place."""
    pin_splits(spark)
    lines = spark.read.option("lineSep", "\n").text([reader_path(f) for f in files])
    file, at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return lines.select("value", file.alias("file"), at.alias("at"), F.xxhash64(file, at).alias("split"))


def _known(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Lines with what is known of their split: one narrow row per split, sent to every task, which keeps the lines in order."""
    joined = lines.join(F.broadcast(splits.drop("file", "at")), "split", "left")
    first = [c for c in splits.columns if c not in ("file", "at", "split")][0]
    checked = F.coalesce(first, F.raise_error(F.lit("files were cut differently than when counted")).cast(splits.schema[first].dataType))
    return joined.withColumn(first, checked)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch of one split each."""
    split = batch.column("split").to_numpy()
    starts = np.flatnonzero(np.r_[True, split[1:] != split[:-1]]) if len(split) else []
    for start, end in zip(starts, [*starts[1:], len(split)]):
        yield int(split[start]), batch.slice(start, end - start)


RECORDS = "file string, at bigint, place bigint, piece bigint, record string"
_SCHEMA = pa.schema([("file", pa.string()), ("at", pa.int64()), ("place", pa.int64()), ("piece", pa.int64()), ("record", pa.string())])


def _rows(file: str, at: int, place: Sequence[int] | np.ndarray, piece: int | None, records: pa.Array) -> pa.RecordBatch:
    n = len(records)
    columns = [pa.array([file] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array(place, pa.int64()), pa.array([piece] * n, pa.int64()), records.cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def whole_records(parts: DataFrame) -> DataFrame:
    """``(file, at, place, record)``: records as they are, and those in pieces joined where they start.

    A record's pieces are one per split it touches; as a record is a row, so is their group.
    """
    pieces = parts.where("piece IS NOT NULL").groupBy("file", "at").agg(
        F.max("place").alias("place"), F.array_sort(F.collect_list(F.struct("piece", "record"))).alias("pieces")
    )
    joined = pieces.select("file", "at", "place", F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"))
    return parts.where("piece IS NULL").drop("piece").unionByName(joined)


def numbered(records: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Add ``row_index`` in file order: a count per split, summed up in order, and the record's place in its split."""
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    counted = settle(records.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("place").alias("first")), "record-counts")
    offsets = counted.select("file", "at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return records.join(offsets, ["file", "at"]).select((F.col("offset") + F.col("place")).cast("bigint").alias("row_index"), *columns)


# --- CSV --------------------------------------------------------------------------------------

# States of a reader of CSV that has just met a quote: before a field, in an unquoted one, in a quoted one, or behind a quote in it.
_BEFORE, _PLAIN, _QUOTED, _CLOSED = range(4)


def _ends_inside(line: Column, inside: bool) -> Column:
    """Whether a line of CSV ends inside quotes, if it starts outside or inside of them.

    A quote opens a field only where the field begins; doubled it stands for itself; elsewhere it is a character like any other.
    """

    def step(state: Column, text: Column) -> Column:
        opens = text.endswith(",") | ((state == _BEFORE) & (text == ""))
        return (
            F.when(state == _QUOTED, _CLOSED)
            .when((state == _CLOSED) & (text == ""), _QUOTED)
            .when(opens, _QUOTED)
            .otherwise(_PLAIN)
        )

    parts = F.split(line, '"', -1)
    ended = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(_QUOTED if inside else _BEFORE), step)
    return F.when(line.contains('"'), ended == _QUOTED).otherwise(F.lit(inside))


def _quote_flags(lines: DataFrame) -> DataFrame:
    value = F.col("value")
    blank = F.expr(r"trim(BOTH ' \t\r' FROM value) = ''")
    return lines.withColumns({"from_out": _ends_inside(value, False), "from_in": _ends_inside(value, True), "blank": blank})


def states_after(from_out: np.ndarray, from_in: np.ndarray, start: bool) -> np.ndarray:
    """Whether each line ends inside quotes, given where the first starts. Lines that end alike from either state make the past forgotten."""
    settled = from_out == from_in
    last = np.maximum.accumulate(np.where(settled, np.arange(len(settled)), -1))
    turns = np.cumsum(from_out & ~from_in)
    since = turns - np.where(last >= 0, turns[last], 0)
    base = np.where(last >= 0, from_out[last], start)
    return base ^ (since % 2 == 1)


def _csv_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split and start: whether it ends inside quotes, how many records start in it, and how many lines end inside quotes."""
    names = ["file", "at", "split", "crlf", "out_end", "in_end", "out_records", "in_records", "out_breaks", "in_breaks"]
    held: dict | None = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([held]).select(names)

    for batch in batches:
        for split, part in _runs(batch):
            if held is None or split != held["split"]:
                if held:
                    yield done()
                held = {"file": part.column("file")[0].as_py(), "at": part.column("at")[0].as_py(), "split": split}
                held |= {"crlf": part.column("crlf")[0].as_py(), "out_end": False, "in_end": True}
                held |= dict.fromkeys(("out_records", "in_records", "out_breaks", "in_breaks"), 0)
            flags = [part.column(c).to_numpy(zero_copy_only=False) for c in ("from_out", "from_in", "blank")]
            for name in ("out", "in"):
                start = held[f"{name}_end"]
                after = states_after(flags[0], flags[1], start)
                before = np.r_[start, after[:-1]]
                held[f"{name}_records"] += int((~before & ~flags[2]).sum())
                held[f"{name}_breaks"] += int(after.sum())
                held[f"{name}_end"] = bool(after[-1])
    if held:
        yield done()


def csv_splits(lines: DataFrame) -> DataFrame:
    """One stored row per split: ``inside`` (its true start), ``opener`` (where the record open at its start began), ``skip``, ``crlf``, ``breaks``, ``ends_inside``.

    ``skip`` is 1 where the split holds its file's first record, the header. Only flags of the lines reach Python.
    """
    flags = _quote_flags(lines).withColumn("crlf", F.col("value").endswith("\r")).drop("value")
    found = settle(
        flags.mapInArrow(
            _csv_summaries,
            "file string, at bigint, split bigint, crlf boolean, out_end boolean, in_end boolean, "
            "out_records bigint, in_records bigint, out_breaks bigint, in_breaks bigint",
        ),
        "csv-splits",
    )
    # The states of states_after, over the splits of each file.
    of_file = Window.partitionBy("file").orderBy("at")
    so_far, earlier = of_file.rowsBetween(Window.unboundedPreceding, 0), of_file.rowsBetween(Window.unboundedPreceding, -1)
    settled = F.col("out_end") == F.col("in_end")
    turns = found.withColumn("turns", F.sum((F.col("out_end") & ~F.col("in_end")).cast("int")).over(so_far))
    base = F.coalesce(F.last(F.when(settled, F.col("out_end")), True).over(so_far), F.lit(False))
    since = F.col("turns") - F.coalesce(F.last(F.when(settled, F.col("turns")), True).over(so_far), F.lit(0))
    ended = turns.withColumn("ends_inside", F.when(since % 2 == 1, ~base).otherwise(base))
    started = ended.withColumn("inside", F.coalesce(F.lag("ends_inside").over(of_file), F.lit(False)))
    pick = lambda name: F.when(F.col("inside"), F.col(f"in_{name}")).otherwise(F.col(f"out_{name}"))
    true = started.withColumns({"records": pick("records"), "breaks": pick("breaks")})
    before = F.coalesce(F.sum("records").over(earlier), F.lit(0))
    return settle(
        true.select(
            "file", "at", "split", "inside", "ends_inside", "breaks",
            F.last(F.when(F.col("records") > 0, F.col("at")), True).over(earlier).alias("opener"),
            ((before == 0) & (F.col("records") > 0)).cast("int").alias("skip"),
            F.first("crlf").over(so_far).alias("crlf"),
        ),
        "csv-starts",
    )


def _csv_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the lines of each record, batch by batch; what is open at the end of a batch waits for the next one."""
    split, file, at, opener, skip, state, place, waiting, led = None, "", 0, None, 0, False, 0, [], True

    def closed() -> Iterator[pa.RecordBatch]:
        """What waits when the next record, or the next split, begins."""
        nonlocal place, led, waiting
        if waiting and led:
            yield _rows(file, opener, [None], at, pa.array(["\n".join(waiting)], pa.string()))
        elif waiting:
            if place >= skip:
                yield _rows(file, at, [place], None, pa.array(["\n".join(waiting)], pa.string()))
            place += 1
        led, waiting = False, []

    def ended() -> Iterator[pa.RecordBatch]:
        if state and waiting and not led:
            # The record goes on in the next split. An open header has no place, and its pieces are left out below.
            yield _rows(file, at, [place if place >= skip else -1], at, pa.array(["\n".join(waiting)], pa.string()))
        else:
            yield from closed()

    for batch in batches:
        for key, part in _runs(batch):
            if key != split:
                if split is not None:
                    yield from ended()
                first = part.slice(0, 1).to_pylist()[0]
                split, file, at, opener, skip, state = key, first["file"], first["at"], first["opener"], first["skip"], first["inside"]
                place, waiting, led = 0, [], True
                if not state:
                    led = False
            flags = [part.column(c).to_numpy(zero_copy_only=False) for c in ("from_out", "from_in", "blank")]
            after = states_after(flags[0], flags[1], state)
            before = np.r_[state, after[:-1]]
            state = bool(after[-1])
            kept = np.flatnonzero(before | ~flags[2])
            values = part.column("value").take(pa.array(kept))
            starts = np.flatnonzero(~before[kept])
            head = values.slice(0, starts[0]) if len(starts) else values
            waiting += head.to_pylist()
            if not len(starts):
                continue
            yield from closed()
            # All but the last record are whole; the last may go on in the next batch.
            whole = starts[:-1]
            if len(whole):
                body = values.slice(starts[0], starts[-1] - starts[0])
                offsets = pa.array(np.r_[whole, starts[-1]] - starts[0], pa.int32())
                records = body if len(body) == len(whole) else pc.binary_join(pa.ListArray.from_arrays(offsets, body), "\n")
                drop = max(0, min(skip - place, len(records)))
                if len(records) > drop:
                    yield _rows(file, at, np.arange(place + drop, place + len(records)), None, records.slice(drop))
                place += len(records)
            waiting = values.slice(starts[-1]).to_pylist()
    if split is not None:
        yield from ended()


def csv_records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``(file, at, place, record)`` of all records but headers, stored once. ``splits`` are those of csv_splits."""
    value = F.col("value")
    cut = F.when(F.col("crlf") & value.endswith("\r"), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    known = _known(lines, splits.select("file", "at", "split", "inside", "opener", "skip", "crlf"))
    flagged = _quote_flags(known.withColumn("value", cut)).drop("crlf")
    parts = settle(flagged.mapInArrow(_csv_records, RECORDS), "csv-records")
    return whole_records(parts).where("place >= 0")


# --- JSON -------------------------------------------------------------------------------------

_TOKEN = re.compile(r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[\[\]{},]""")
_BRACKETS = re.compile(r"[\[\]{}]")
ARRAY = "["


def _structure(value: Column) -> Column:
    """A line of JSON without its strings, of which only brackets are kept, and any quote that is left over."""
    bare = F.replace(F.replace(F.replace(value, F.lit("\\\\")), F.lit('\\"')), F.lit("\\'"))
    return F.regexp_replace(F.regexp_replace(bare, """"[^"]*+"|'[^']*+'""", ""), """[^\\[\\]{}"']""", "")


def _json_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: the change of depth, the least depth, the bracket that opened last from there, and whether a string is open at the end of a line."""
    names = ["file", "at", "split", "depth", "least", "opened", "broken"]
    held: dict | None = None
    for batch in batches:
        for split, part in _runs(batch):
            if held is None or split != held["split"]:
                if held:
                    yield pa.RecordBatch.from_pylist([held]).select(names)
                held = {"file": part.column("file")[0].as_py(), "at": part.column("at")[0].as_py(), "split": split}
                held |= {"depth": 0, "least": 0, "opened": "", "broken": False}
            text = np.frombuffer("".join(part.column("brackets").to_pylist()).encode(), np.uint8)
            held["broken"] |= bool(np.isin(text, list(b"\"'")).any())
            steps = np.where(np.isin(text, list(b"[{")), 1, np.where(np.isin(text, list(b"]}")), -1, 0))
            if not len(steps):
                continue
            after = held["depth"] + np.cumsum(steps)
            least = min(held["least"], int(after.min()))
            opens = np.flatnonzero((steps > 0) & (after == least + 1))
            if len(opens):
                held["opened"] = chr(text[opens[-1]])
            elif least < held["least"]:
                held["opened"] = ""
            held["depth"], held["least"] = int(after[-1]), least
    if held:
        yield pa.RecordBatch.from_pylist([held]).select(names)


def json_splits(lines: DataFrame) -> DataFrame:
    """One stored row per split: ``depth`` at its start, ``outer`` (the bracket of the outermost value open there), ``opener``, and what is wrong.

    No string runs over a line, so a line always starts outside of one, and depths are sums. Strings are taken out of the lines in the JVM.
    """
    found = settle(
        lines.withColumn("brackets", _structure(F.col("value"))).drop("value").mapInArrow(
            _json_summaries, "file string, at bigint, split bigint, depth bigint, least bigint, opened string, broken boolean"
        ),
        "json-splits",
    )
    of_file = Window.partitionBy("file").orderBy("at")
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("depth").over(earlier), F.lit(0))
    known = found.select("file", "at", "split", "broken", "least", "opened", start.alias("start"), (start + F.col("depth")).alias("end"))
    # Where depth 0 is reached in a split, the last bracket opened from there is the outermost one from then on.
    opened = F.when((F.col("start") + F.col("least") == 0) & (F.col("opened") != ""), F.col("opened"))
    outer = F.coalesce(F.last(opened, True).over(earlier), F.lit(""))
    wrong = F.col("broken") | (F.col("start") + F.col("least") < 0)
    known = known.select("file", "at", "split", F.col("start").alias("depth"), "least", "end", outer.alias("outer"), wrong.alias("wrong"))
    return settle(known, "json-starts")


def brackets_end(line: str) -> int:
    """How often a line of JSON comes back to depth 0, 1 for a single value; 0 where it ends at another depth."""
    depth = ends = 0
    for token in _TOKEN.finditer(line):
        step = (line[token.start()] in "[{") - (line[token.start()] in "]}")
        depth += step
        ends += step < 0 and depth == 0
    return (ends or 1) if depth == 0 else 0


class JsonCutter:
    """Cuts the lines of a split into values: objects of their own, and the elements of outermost arrays.

    Gives ``(text, starts)`` of each value that ends, ``starts`` telling whether it began in this split.
    """

    def __init__(self, depth: int, outer: str):
        self.depth, self.outer = depth, outer
        self.parts: list[str] = []
        # What comes first goes on with an earlier split's piece, also between the elements of an array, where a comma may be due.
        self.is_own = depth == 0

    @property
    def level(self) -> int:
        """The depth at which values begin."""
        return 1 if self.outer == ARRAY and self.depth > 0 else 0

    def lines(self, values: Sequence[str]) -> Iterator[tuple[str, bool]]:
        for line in values:
            if self.depth > self.level and not _BRACKETS.search(line):
                self.parts.append(line)
            else:
                yield from self._line(line)
            self.parts.append("\n")

    def _line(self, line: str) -> Iterator[tuple[str, bool]]:
        kept = 0
        for token in _TOKEN.finditer(line):
            char = line[token.start()]
            if char in "\"'":
                continue
            if char == "," and self.depth == self.level:
                # Between elements; elsewhere a comma at this depth is an error that the parser finds.
                yield from self._end(line[kept : token.start()] if self.level else line[kept : token.end()])
                kept = token.end()
            elif char in "[{":
                if self.depth == 0:
                    yield from self._end(line[kept : token.start()])
                    self.outer = char
                    kept = token.end() if char == ARRAY else token.start()
                self.depth += 1
            elif char in "]}":
                if self.depth == 1:
                    cut = token.start() if self.outer == ARRAY else token.end()
                    self.depth = 0
                    yield from self._end(line[kept:cut])
                    kept, self.outer = token.end(), ""
                else:
                    self.depth -= 1
        self.parts.append(line[kept:])

    def _end(self, text: str) -> Iterator[tuple[str, bool]]:
        value, self.parts = "".join(self.parts) + text, []
        if value.strip() or not self.is_own:
            yield value, self.is_own
        self.is_own = True

    def rest(self) -> str:
        text, self.parts = "".join(self.parts), []
        return text


def _json_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of each split, and the pieces of those that cross its borders."""
    split, file, at, place, cutter = None, "", 0, 0, None

    def ended() -> Iterator[pa.RecordBatch]:
        text = cutter.rest()
        if not text.strip() and cutter.is_own and not cutter.level:
            return
        yield _rows(file, at, [place if cutter.is_own else None], at, pa.array([text.removesuffix("\n")], pa.string()))

    for batch in batches:
        for key, part in _runs(batch):
            if key != split:
                if split is not None:
                    yield from ended()
                first = part.slice(0, 1).to_pylist()[0]
                split, file, at, place = key, first["file"], first["at"], 0
                cutter = JsonCutter(first["depth"], first["outer"])
            texts = []
            for text, is_own in cutter.lines(part.column("value").to_pylist()):
                if is_own:
                    texts.append(text)
                else:
                    yield _rows(file, at, [None], at, pa.array([text], pa.string()))
            if texts:
                yield _rows(file, at, np.arange(place, place + len(texts)), None, pa.array(texts, pa.string()))
                place += len(texts)
    if split is not None:
        yield from ended()


def json_records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``(file, at, place, record)`` of all values, stored once. ``splits`` are those of json_splits."""
    known = _known(lines, splits.select("file", "at", "split", "depth", "outer"))
    parts = settle(known.mapInArrow(_json_records, RECORDS), "json-records")
    # A piece without a place goes on with the record that the last earlier piece with one began.
    pieces = parts.where("piece IS NOT NULL")
    began = F.last(F.when(F.col("place").isNotNull(), F.col("at")), True).over(
        Window.partitionBy("file").orderBy("piece", F.col("place").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    )
    pieces = pieces.withColumn("at", began)
    # Pieces that only hold what is between elements make an empty record, always the last of its split.
    return whole_records(parts.where("piece IS NULL").unionByName(pieces)).where(r"trim(BOTH ' \t\r\n' FROM record) <> ''")
