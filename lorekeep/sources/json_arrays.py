"""Files that are one JSON array each, read in byte ranges by many tasks, element by element.

Whether a byte is inside a string, and how deep it lies, depends on all bytes before it. So ranges are looked at twice: first
each tells the parity of its quotes and by how much it goes down or up, for both cases of starting inside a string or
outside; a sum of these over a file's ranges gives each range's start. Then each range yields the elements that begin in it, and
reads on to the end of its last one. Neither the driver nor a task holds a file; what comes to the driver is a few numbers
for each range."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lorekeep.storage import file_system

#: Bytes of a range, and of each further look beyond its end.
RANGE, MORE = 8 << 20, 1 << 20
_BOM = b"\xef\xbb\xbf"
_SPACE = b" \t\r\n"


class Range(NamedTuple):
    path: str
    start: int
    stop: int
    inside: bool = False
    depth: int = 0


class _Planned(InputPartition):
    def __init__(self, at: Range):
        self.at = at


def _opened(path: str):
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _escaped(file, start: int) -> bool:
    """Whether an odd number of backslashes comes before a byte."""
    n, end = 0, start
    while end > 0:
        begin = max(0, end - 1024)
        block = file.read_at(end - begin, begin)
        bare = block.rstrip(b"\\")
        n += len(block) - len(bare)
        if bare:
            break
        end = begin
    return n % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Which bytes are quotes that begin or end a string. Backslashes are only in strings, where pairs of them are one."""
    slash = data == ord("\\")
    quote = data == ord('"')
    if not slash.any() and not escaped:
        return quote
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(slash, -1, at))  # of the bytes so far, the last that is no backslash
    before = np.append(-1, last[:-1])
    run = at - 1 - before
    run[before < 0] += escaped  # a run that goes on from before the block
    return quote & (run % 2 == 0)


def _turns(data: np.ndarray) -> np.ndarray:
    """1 for what opens an object or array, -1 for what closes one."""
    return ((data == ord("[")) | (data == ord("{"))).astype(np.int8) - ((data == ord("]")) | (data == ord("}"))).astype(np.int8)


def summed(data: bytes, escaped: bool) -> tuple[int, int, int]:
    """The parity of the quotes, and how much deeper the end lies, if the start is outside a string or inside."""
    x = np.frombuffer(data, np.uint8)
    inside = np.cumsum(_quotes(x, escaped)) % 2 == 1
    turns = _turns(x)
    return int(inside[-1]) if len(x) else 0, int(turns[~inside].sum()), int(turns[inside].sum())


def boundaries(data: bytes, escaped: bool, inside: bool, depth: int) -> tuple[np.ndarray, bool, int]:
    """Where elements of the outer array begin or end: at its opening, its commas and its closing. And the state at the end."""
    x = np.frombuffer(data, np.uint8)
    in_string = (np.cumsum(_quotes(x, escaped)) + inside) % 2 == 1
    turns = np.where(in_string, 0, _turns(x))
    deep = depth + np.cumsum(turns)
    found = ~in_string & ((deep == 1) & (x == ord(",")) | (deep == 1) & (turns == 1) | (deep == 0) & (turns == -1))
    return np.flatnonzero(found), bool(in_string[-1]) if len(x) else inside, int(deep[-1]) if len(x) else depth


def elements(at: Range) -> Iterator[tuple[str]]:
    """The elements that begin after a boundary in the range."""
    with _opened(at.path) as file:
        size, escaped = file.size(), _escaped(file, at.start)
        data = file.read_at(at.stop - at.start, at.start)
        found, inside, depth = boundaries(data, escaped, at.inside, at.depth)
        for a, b in zip(found, found[1:]):
            if (text := data[a + 1 : b].strip(_SPACE)) and data[a] != ord("]"):
                yield (text.decode(),)
        if not len(found) or data[found[-1]] == ord("]"):
            return
        parts, place = [data[found[-1] + 1 :]], at.stop
        while place < size:
            more = file.read_at(min(MORE, size - place), place)
            ends, inside, depth = boundaries(more, _escaped(file, place), inside, depth)
            parts.append(more[: ends[0]] if len(ends) else more)
            if len(ends):
                if text := b"".join(parts).strip(_SPACE):
                    yield (text.decode(),)
                return
            place += len(more)
        raise ValueError(f"an array breaks off: {at.path}")


def summary(at: Range) -> Iterator[tuple[str, int, int, int, int, int]]:
    with _opened(at.path) as file:
        data = file.read_at(at.stop - at.start, at.start)
        if at.start == 0 and data.removeprefix(_BOM).lstrip(_SPACE)[:1] != b"[":
            raise ValueError(f"the document is no array: {at.path}")
        yield (at.path, at.start, at.stop, *summed(data, _escaped(file, at.start)))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, read):
        self.options, self.read_one = options, read

    def partitions(self) -> list[InputPartition]:
        return [_Planned(Range(*x)) for x in json.loads(self.options["ranges"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.read_one(partition.at)


class JsonArray(DataSource):
    """Elements of planned ranges, as texts."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, elements)


class JsonArrayRanges(DataSource):
    """What each range adds to the state of the next."""

    @classmethod
    def name(cls) -> str:
        return "json_array_ranges"

    def schema(self) -> str:
        return "path string, start long, stop long, parity int, outside int, inside int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, summary)


def _ranges(spark: SparkSession, path: str, size: int) -> list[Range]:
    """The ranges of a file, or of all files in a folder that aren't hidden or empty."""
    store, where = file_system(spark, path)
    status = store.getFileStatus(where)
    files = [status]
    if status.isDirectory():
        files = [f for f in store.listStatus(where) if f.getLen() and not f.getPath().getName().startswith(("_", "."))]
    return [Range(f.getPath().toString(), a, min(a + size, f.getLen())) for f in files for a in range(0, max(f.getLen(), 1), size)]


def read_array(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """value: the text of each element of a JSON array in a file, or of those in a folder's files."""
    for source in (JsonArray, JsonArrayRanges):
        spark.dataSource.register(source)
    ranges = _ranges(spark, path, size)
    if not ranges:
        return spark.createDataFrame([], "value string")
    told = spark.read.format("json_array_ranges").option("ranges", json.dumps(ranges)).load().collect()
    starts, of, inside, depth = [], None, False, 0
    for r in sorted(told, key=lambda r: (r["path"], r["start"])):
        if r["path"] != of:
            if depth or inside:
                raise ValueError(f"an array breaks off: {of}")
            of, inside, depth = r["path"], False, 0
        starts.append(Range(r["path"], r["start"], r["stop"], inside, depth))
        depth += r["inside"] if inside else r["outside"]
        inside ^= bool(r["parity"])
    if depth or inside:
        raise ValueError(f"an array breaks off: {of}")
    return spark.read.format("json_array").option("ranges", json.dumps(starts)).load()


def write_array(rows: DataFrame, folder: str) -> None:
    """Writes texts of JSON as a folder of files, each of which is one array of a partition's rows."""

    def lines(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            texts = b.column(0).to_pylist()
            out = [("[" if first and i == 0 else ",") + x for i, x in enumerate(texts)]
            first = first and not texts
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], ["value"])

    rows.mapInArrow(lines, "value string").write.text(folder)
