"""LOAD DATA, split loads, and sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.base import unquoted
from ..plans.sharding import ShardFunction
from .staging import numbered


def load_data(spark: SparkSession, path: str, schema: StructType | str, field: str = "\t", enclosed: str = "", charset: str = "UTF-8", line: str | None = None, ignore_lines: bool = False) -> DataFrame:
    """LOAD DATA INFILE: fields end with a tab and lines with a newline unless said otherwise; \\N is NULL."""
    reader = spark.read.schema(schema).option("sep", field).option("encoding", charset).option("nullValue", "\\N").option("header", ignore_lines)
    reader = reader.option("quote", enclosed)
    reader = reader.option("lineSep", line) if line else reader
    return reader.csv(path)


def split_load(df: DataFrame, column: str, function: ShardFunction, path: str, field: str = ",") -> None:
    """A file set a shard, as CSV."""
    df.withColumn("shard_id", function.shard(F.col(column))).write.partitionBy("shard_id").option("sep", field).option("nullValue", "\\N").csv(path)


INSERT = re.compile(r"(?is)\s*(?:(?:/\*.*?\*/|--[ \t][^\n]*|\#[^\n]*)\s*)*(?:INSERT|REPLACE)\s+(?:IGNORE\s+)?(?:INTO\s+)?(?:`?\w+`?\.)?`?(\w+)`?\s*(?:\([^)]*\)\s*)?VALUES\s*")
FIELD = re.compile(r"\s*(?:_binary\s*)?('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|[^\s,()'\"]+)\s*([,)])", re.S | re.I)
#: Where a dump is cut; what then isn't a whole statement goes on in the next piece.
END = ";\n"


def values_of(statement: str) -> tuple[str, list[list[str | None]]] | None:
    """The table and the rows of an INSERT ... VALUES; NULL is None, other fields are the texts they stand for. None for another statement; a row that can't be read is an error."""
    m = INSERT.match(statement)
    if not m:
        return None
    rows, at = [], m.end()
    while True:
        if not (head := re.compile(r"\s*\(").match(statement, at)):
            raise ValueError(f"no row of values at {statement[at : at + 40]!r}")
        row, at, more = [], head.end(), ","
        while more == ",":
            f = FIELD.match(statement, at)
            if not f:
                raise ValueError(f"can't read a value at {statement[at : at + 40]!r}")
            raw, more, at = f[1], f[2], f.end()
            row.append(unquoted(raw) if raw[0] in "'\"" else None if raw.upper() == "NULL" else raw)
        rows.append(row)
        rest = re.compile(r"\s*(,|;?\s*$)").match(statement, at)
        if not rest:
            raise ValueError(f"can't read on at {statement[at : at + 40]!r}")
        if rest[1] != ",":
            return m[1], rows
        at = rest.end()


def balanced(text: str) -> bool:
    """Whether no literal or comment is open at the end of a text."""
    return not re.sub(r"(?s)'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|/\*.*?\*/|--[ \t][^\n]*|[^'\"`/-]+|[/-]", "", text)


def split_dump(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """table_name, fields of every row that a dump's INSERT statements hold; `split_load` writes them by shard.

    Statements end with a semicolon at a line's end. Files are read in parts of any size; where a literal with such an end of line lies across two parts the read fails, and
    `whole_files` reads each file (of at most 2 GB then) in one piece. A row that can't be read is an error.
    """

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = None, None
        for b in batches:
            names, fields = [], []
            for name, value in zip(b["file"].to_pylist(), b["value"].to_pylist(), strict=True):
                if held is not None and name != file:
                    raise ValueError(f"a statement is open at the end of {file}")
                file = name
                for piece in value.split(END):
                    held = piece if held is None else held + END + piece
                    if balanced(held):
                        if found := values_of(held):
                            names += [found[0]] * len(found[1])
                            fields += found[1]
                        held = None
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(fields, pa.list_(pa.string()))], names=["table_name", "fields"])
        if held is not None:
            raise ValueError(f"a statement is open at the end of a part of {file}")

    pieces = spark.read.text(path, wholetext=True) if whole_files else spark.read.text(path, lineSep=END)
    return pieces.select(F.input_file_name().alias("file"), "value").mapInArrow(rows_of, "table_name string, fields array<string>")


def jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A backend table, read in ranges of a column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)


def sequence(df: DataFrame, name: str, order: list[str], start: int = 1) -> DataFrame:
    """Dense numbers in an order, from one counter."""
    return numbered(df, name, order, start)


def batched_sequence(df: DataFrame, name: str, batch: int = 100, start: int = 1) -> DataFrame:
    """Unique numbers from a counter that gives tasks `batch` numbers at a time: no order is kept and numbers that a task doesn't use are lost, but nothing is shuffled."""
    part, nth = _task_counter()
    turn = F.call_function("div", nth, F.lit(batch))
    return df.withColumn(name, (F.shiftleft(turn, 20) + part) * batch + F.pmod(nth, F.lit(batch)) + start)


def _task_counter() -> tuple[Column, Column]:
    """(the task's number, 0, 1, ... in it)."""
    nth = F.monotonically_increasing_id()
    return F.shiftright(nth, 33), nth.bitwiseAND(F.lit((1 << 33) - 1))


def time_sequence(instance: int = 0) -> Column:
    """Unique ids: 30 high bits of the milliseconds, 10 bits of the instance, 12 of a counter, 12 low bits of the milliseconds."""
    part, nth = _task_counter()
    # The clock stands still in a query; the counter moves it on, and tasks are as far apart as their counters can go.
    ms = F.unix_millis(F.current_timestamp()) + F.shiftleft(part, 21) + F.call_function("div", nth, F.lit(4096))
    return F.shiftleft(F.shiftright(ms, 12), 34) + F.lit((instance & 1023) << 24) + F.shiftleft(F.pmod(nth, F.lit(4096)), 12) + F.pmod(ms, F.lit(4096))


def distributed_sequence(instance: int = 0, since: int = 1288834974657) -> Column:
    """Unique ids: 9 bits of the task, 9 of the instance, 6 of a counter, 39 of the milliseconds since a start."""
    part, nth = _task_counter()
    ms = F.unix_millis(F.current_timestamp()) - F.lit(since) + F.shiftleft(F.shiftright(part, 9), 27) + F.call_function("div", nth, F.lit(64))
    return F.shiftleft(part.bitwiseAND(F.lit(511)), 54) + F.lit((instance & 511) << 45) + F.shiftleft(F.pmod(nth, F.lit(64)), 39) + ms.bitwiseAND(F.lit((1 << 39) - 1))
