"""A JSON file that is one object or one array, read by several tasks.

The source keeps its embeddings as one object of labels and vectors and its documents as one
array. Spark's JSON reader gives such a file to one task. This data source cuts the file into
byte ranges; a task finds the first entry that starts in its range and reads entries until one
starts beyond it. Rows are (key, value): the label (null in an array) and the entry's JSON text,
which ``from_json`` parses in the JVM.

Entry borders. Within a JSON string a quote is escaped, so an unescaped quote is always the edge
of a string. A candidate border is a comma between two entries, and counts only if a whole
non-empty entry follows that ends before a comma or the closing bracket; text that looks like a
border inside a string holds no unescaped quote and fails that test.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 32 << 20
_MORE = 1 << 20
_BORDER = {"map": re.compile(rb'\]\s*,\s*(?=")'), "array": re.compile(rb"\}\s*,\s*(?=\{)")}
_SPACE = re.compile(r"\s*")
_COLON = re.compile(r"\s*:\s*")
_DECODER = json.JSONDecoder()


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Incomplete(Exception):
    """The text ends within an entry."""


def entry_at(text: str, at: int, kind: str) -> tuple[str | None, str, int, bool]:
    """(key, value's JSON text, place of the next entry, is it the last one) of the entry at ``at``.

    Raises Incomplete if the text ends too early, ValueError if no entry is there.
    """
    key, value_at = None, at
    try:
        if kind == "map":
            key, end = _DECODER.raw_decode(text, at)
            colon = _COLON.match(text, end)
            if colon is None or not isinstance(key, str):
                if _SPACE.match(text, end).end() == len(text):
                    raise Incomplete
                raise ValueError("no key")
            value_at = colon.end()
        value, end = _DECODER.raw_decode(text, value_at)
    except json.JSONDecodeError as e:
        # an error at the very end (or a string that doesn't end) needs more text
        if e.pos >= len(text) - 8 or e.msg.startswith("Unterminated") or _open_end(text, value_at):
            raise Incomplete from e
        raise ValueError(str(e)) from e
    if kind == "array" and not value:
        raise ValueError("an empty entry is no border")
    after = _SPACE.match(text, end).end()
    if after == len(text):
        raise Incomplete
    if text[after] not in ",]}":
        raise ValueError("no border behind the entry")
    following = _SPACE.match(text, after + 1).end()
    return key, text[value_at:end], following, text[after] != ","


def _open_end(text: str, at: int) -> bool:
    """Is the value at ``at`` still open where the text ends? (An incomplete literal or number counts.)"""
    depth, i, n, inside = 0, at, len(text), False
    while i < n:
        c = text[i]
        if inside:
            if c == "\\":
                i += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth <= 0:
                return False
        i += 1
    return True


def entries(read, size: int, start: int, stop: int, kind: str) -> Iterator[tuple[str | None, str]]:
    """(key, JSON text) of the entries that start in [start, stop); ``read(at, n)`` gives bytes of the file."""
    # a border may lie across the range's start: look back over its white space
    base = max(0, start - 64)
    body = read(base, min(size, stop) - base)
    if start == 0:  # the first entry belongs to the first range, wherever it starts
        body = read(0, min(size, stop + _MORE))
        opening = re.compile(rb"\s*[\[{]\s*").match(body)
        if opening is None:
            raise ValueError("the file holds no object or array")
        starts = iter([opening.end()]) if body[opening.end() : opening.end() + 1] not in (b"", b"}", b"]") else iter([])
        stop = max(stop, opening.end() + 1)
    else:
        starts = (m.end() for m in _BORDER[kind].finditer(body) if base + m.end() >= start)
    for first in starts:
        at, text, begin = base + first, None, first
        sure = start == 0  # the first candidate of a later range is tested
        while at < stop:
            if text is None:
                text, place = body[begin:].decode("utf-8", "ignore"), 0
            try:
                key, value, following, last = entry_at(text, place, kind)
            except Incomplete:
                end = base + len(body)
                if end >= size:
                    if sure:
                        raise ValueError(f"the entry at byte {at} doesn't end") from None
                    break
                body += read(end, min(_MORE + len(body), size - end))
                text = body[at - base :].decode("utf-8", "ignore")
                place = 0
                continue
            except ValueError:
                if sure:
                    raise
                break
            sure = True
            yield key, value
            if last:
                return
            at += len(text[place:following].encode())
            place = following
        else:
            return
        if sure:
            return


class _Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, stop: int):
        self.path, self.size, self.start, self.stop = path, size, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        self._path, self._kind = options["path"], options.get("kind", "map")
        self._split = int(options.get("split_bytes", SPLIT_BYTES))
        if self._kind not in _BORDER:
            raise ValueError(f"kind is map or array, not {self._kind}")

    def partitions(self):
        fs, inside = _file_system(self._path)
        info = fs.get_file_info(inside)
        files = [info] if info.type == pafs.FileType.File else [
            f for f in fs.get_file_info(pafs.FileSelector(inside)) if f.type == pafs.FileType.File and f.base_name[0] not in "._" and f.size
        ]
        if not files:
            raise FileNotFoundError(f"no file at {self._path}")
        return [_Range(f.path, f.size, a, min(a + self._split, f.size)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self._split)]

    def read(self, partition: _Range):
        fs, _ = _file_system(self._path)
        with fs.open_input_file(partition.path) as source:
            yield from entries(lambda at, n: source.read_at(n, at), partition.size, partition.start, partition.stop, self._kind)


class JsonEntries(DataSource):
    """``spark.read.format("json_entries")``: options path, kind (map or array), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "json_entries"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_entries(spark: SparkSession, path: str, kind: str, split_bytes: int = SPLIT_BYTES):
    """key, value (JSON text) of every entry of the file, or of every file of the folder."""
    spark.dataSource.register(JsonEntries)
    return spark.read.format("json_entries").option("kind", kind).option("split_bytes", split_bytes).load(path)
