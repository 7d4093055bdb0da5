"""Records of CSV files whose quoted fields hold line breaks, read by many tasks per file.

Spark's own reader takes such a file in one task, as a line alone doesn't tell whether it begins inside a field.  Here
lines come from the splittable text reader, in file order within each block of a file:

1. Every block reports how it would end if it began outside, and if it began inside a quoted field: one small row.
2. The driver, which holds a row per block as it holds the list of files, chains these rows: now every block knows how it
   begins, and in which block a record that goes on in it began.
3. Blocks cut their lines into records.  What a block holds of a record that crosses its ends goes, keyed by where the
   record began, through a small shuffle and is joined up.

Records are parsed by Spark's ``from_csv``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
# Where a record began that is the first of its file and goes on beyond the first block.
FIRST = -1


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open after a line that began inside one or not.

    A field is quoted if its first character is a quote; in it a doubled quote is a character; what follows the closing
    quote up to the separator is plain."""
    at, n = 0, len(line)
    while True:
        if not inside:
            # the beginning of a field
            if line.startswith(QUOTE, at):
                inside, at = True, at + 1
            else:
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
        while True:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line.startswith(QUOTE, at + 1):
                at += 2
                continue
            break
        inside = False
        at = line.find(sep, at + 1)
        if at < 0 or at >= n:
            return False
        at += len(sep)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """File, block and lines of consecutive rows of one block."""
    for batch in batches:
        file, block = batch.column("file"), batch.column("block")
        n = len(batch)
        if not n:
            continue
        # few blocks meet in a batch: their borders, not rows, are looped over
        change = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1)))
        edges = [0, *[i + 1 for i, c in enumerate(change.to_pylist()) if c], n] if pc.any(change).as_py() else [0, n]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield file[a].as_py(), block[a].as_py(), batch.column("line").slice(a, b - a)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _starts(lines: DataFrame, sep: str) -> dict[tuple[str, int], tuple[bool, int]]:
    """For every block: whether it begins inside a quoted field, and the block where the record open there began."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by block, for both ways to begin: inside at the end, and whether any record ended
        state: dict[tuple[str, int], list[list[bool]]] = {}
        for file, block, rows in _blocks(batches):
            ways = state.setdefault((file, block), [[False, False], [True, False]])
            quoted = pc.match_substring(rows, QUOTE)
            plain = not pc.any(quoted).as_py()
            for way in ways:
                if plain:
                    way[1] |= not way[0]
                    continue
                for line, q in zip(rows.to_pylist(), quoted.to_pylist(), strict=True):
                    if q:
                        way[0] = inside_after(line, way[0], sep)
                    way[1] |= not way[0]
        keys = list(state)
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([k[0] for k in keys], pa.string()), "block": pa.array([k[1] for k in keys], pa.int64()),
            **{f"{name}{way}": pa.array([state[k][way][i] for k in keys], pa.bool_()) for way in (0, 1) for i, name in enumerate(("open", "ended"))}})

    found = lines.mapInArrow(work, "file string, block long, open0 boolean, ended0 boolean, open1 boolean, ended1 boolean").toArrow().to_pylist()
    starts: dict[tuple[str, int], tuple[bool, int]] = {}
    file = inside = origin = None
    for r in sorted(found, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, inside = r["file"], False
        origin = origin if inside else r["block"]
        starts[file, r["block"]] = (inside, origin)
        ended, inside = (r["ended1"], r["open1"]) if inside else (r["ended0"], r["open0"])
        # what is open at the end began here, unless it came in and never ended; a file's first record is told apart
        origin = r["block"] if ended else FIRST if r["block"] == 0 else origin
    return starts


def read_records(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """(record): the records of the files under ``path``, without empty ones and, with ``header``, each file's first."""
    lines = _lines(spark, path)
    starts = spark.sparkContext.broadcast(_starts(lines, sep))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = starts.value
        now, inside, origin, first, ended, open_ = None, False, 0, False, False, []

        def left() -> Iterator[pa.RecordBatch]:
            """What is open at a block's end, as a part of the record that goes on."""
            if open_:
                yield rows(["\n".join(open_)], [now[0]], [FIRST if now[1] == 0 and not ended else origin], [now[1]])

        def rows(text, file, began, block) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(file, pa.string()), pa.array(began, pa.int64()), pa.array(block, pa.int64())],
                                              names=["record", "file", "origin", "block"])

        for file, block, column in _blocks(batches):
            if (file, block) != now:
                yield from left()
                now, open_ = (file, block), []
                inside, origin = where[now]
                crossing, ended = inside, False  # whether the open record came in from an earlier block
                first = header and block == 0
            whole: list[str] = []
            quoted = pc.match_substring(column, QUOTE)
            if not inside and not open_ and not pc.any(quoted).as_py():
                whole, ended = column.to_pylist(), True
            else:
                for line, q in zip(column.to_pylist(), quoted.to_pylist(), strict=True):
                    open_.append(line)
                    if q:
                        inside = inside_after(line, inside, sep)
                    if not inside:
                        text = "\n".join(open_)
                        if crossing:
                            yield rows([text], [file], [origin], [block])
                            crossing = False
                        else:
                            whole.append(text)
                        open_, origin, ended = [], block, True
            while first and whole:
                # blank lines may stand before the header
                first = not whole.pop(0).strip("\r")
            if whole:
                yield rows(whole, [None] * len(whole), [None] * len(whole), [None] * len(whole))
        if now:
            yield from left()

    found = lines.mapInArrow(work, "record string, file string, origin long, block long")
    whole = found.where("file IS NULL").select("record")
    parts = found.where("file IS NOT NULL" + f" AND origin != {FIRST}" * header)
    parts = parts.groupBy("file", "origin").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"))
    joined = parts.select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    both = whole.unionByName(joined)
    text = F.regexp_replace("record", "\r$", "")
    return both.select(text.alias("record")).where(F.col("record") != "")


def parse_records(records: DataFrame, schema: T.StructType, options: dict, decode: Column | None = None) -> DataFrame:
    """Columns of records, by ``from_csv``."""
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    # line breaks in fields stay as they are
    parsed = records.select(F.from_csv(decode if decode is not None else F.col("record"), ddl, {**options, "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col("r")[f.name].alias(f.name) for f in schema])
