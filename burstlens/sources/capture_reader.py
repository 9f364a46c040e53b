"""Captures read by byte ranges, as a Python data source that pairs the lines of a packet where it reads them.

A file is cut into ranges of ``range_bytes``; small files, and ranges smaller than ``task_bytes``, share a task. A line belongs to the range in which it begins. A range looks back
for the clock lines directly before its first line (so that it knows which of them opens a packet) and reads one line beyond its end
for the address of its last packet: no line is exchanged between tasks, and every range can be read again alone. The header
reader takes the leading lines of each file and stops at the first line that is no header.

This reader runs in Python workers (Arrow batches; memory is a chunk and a line, whatever the range); ``captures.read_lines`` stays
inside the JVM and exchanges lines by block instead. Equality and prefix conditions on ``source_file`` choose files before anything is
read, when ``spark.sql.python.filterPushdown.enabled`` is set as the frame is made. Files are plain text: a compressed name is an error.

Defined results: lines end at ``\\n``, ``\\r\\n`` or ``\\r``; an empty file has no rows; bytes that are no UTF-8 become replacement signs; a
leading byte-order mark is dropped; no matching file is an error.
"""

from __future__ import annotations

import fnmatch
import re
import sys
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

# The reader travels with its code, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
RANGE_BYTES = 128 << 20
# Ranges of one task together, where a range is smaller.
TASK_BYTES = 16 << 20
CHUNK = 1 << 20
BACK = 1 << 12
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20

BREAK = re.compile(rb"\r\n|\n|\r")
BOM = b"\xef\xbb\xbf"
# A clock line and a header line, as in burstlens.functions.capture_text, over bytes.
CLOCK = re.compile(rb"[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+[ \t\n\x0b\f\r]+[Ii][Pp]6?(?![A-Za-z0-9_])")
HEADER = re.compile(rb"[Ll][Ll][Mm]_[Ii][Pp][ \t\n\x0b\f\r]+[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]+[^ \t\n\x0b\f\r]+")
BLANKS = b" \t\n\r\x0b\x0c"

PAIRS = "source_file string, block bigint, row bigint, value binary, address binary"
HEADS = "source_file string, block bigint, row bigint, value binary"


def is_clock(line: bytes) -> bool:
    m = CLOCK.match(line)
    if m is None:
        return False
    rest = line[m.end() : m.end() + 4]
    return not rest or rest[0] < 128 or re.match(r"\w", rest.decode("utf-8", "replace")) is None


def lines_from(f, at: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, line) from the line that begins at ``at`` to the end of the file; each byte is searched once.

    A reader that wants little behind ``end`` says so: the first chunk goes as far, the next ones grow.
    """
    f.seek(at)
    held, seen = bytearray(), 0
    step = CHUNK if end is None else min(CHUNK, max(1, end - at) + BACK)
    while chunk := f.read(step):
        step = min(CHUNK, 2 * step)
        held += chunk
        found, begin = [], 0
        for m in BREAK.finditer(held, seen):
            if m.end() == len(held) and m.group() == b"\r":  # its \n may follow in the next chunk
                break
            found.append((at + begin, bytes(held[begin : m.start()])))
            begin = m.end()
        m = None  # lets go of the buffer
        del held[:begin]
        at += begin
        seen = len(held) - (held[-1:] == b"\r")
        yield from found
    if held:
        yield at, bytes(held[:-1] if held[-1:] == b"\r" else held)


def first_line(f, start: int, end: int) -> int | None:
    """Where the first line that begins in the range begins, or None."""
    if start == 0:
        return 0
    f.seek(start - 1)
    around = f.read(2)
    if around == b"\r\n":
        return start + 1 if start + 1 < end else None
    if around[:1] in (b"\n", b"\r"):
        return start
    at, cut = start, False
    while at < end:
        f.seek(at)
        chunk = f.read(min(CHUNK, end - at))
        if not chunk:
            return None
        if cut:  # the chunk before ended with \r
            return at + 1 if chunk[:1] == b"\n" and at + 1 < end else at if chunk[:1] != b"\n" else None
        m = BREAK.search(chunk)
        if m and (m.end() < len(chunk) or m.group() != b"\r"):
            return at + m.end() if at + m.end() < end else None
        cut = m is not None
        at += len(chunk)
    return None


def clocks_before(f, at: int) -> int:
    """How many clock lines stand directly before the line that begins at ``at``."""
    count, low, held, step = 0, at, b"", BACK
    while low > 0:
        begin = max(0, low - step)
        f.seek(begin)
        held = f.read(low - begin) + held
        low = begin
        ends = [m.end() for m in BREAK.finditer(held)]
        starts = [0, *ends] if low == 0 else ends
        for a, b in zip(reversed(starts[:-1]), reversed(starts[1:])):
            line = held[a:b].rstrip(b"\r\n")
            if low + a == 0 and line.startswith(BOM):
                line = line[3:]
            if not is_clock(line):
                return count
            count += 1
        step = BACK if len(starts) > 1 else step * 2  # a long line is read in growing steps
        held = held[: starts[0]] if starts else held
    return count


def pairs_in(f, start: int, end: int, strict: bool) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(offset, clock line, address line) of the packets whose clock line begins in the range."""
    at = first_line(f, start, end)
    if at is None:
        return
    run = 0 if strict else clocks_before(f, at)
    opened = None
    for offset, line in lines_from(f, at, end):
        if offset == 0 and line.startswith(BOM):
            line = line[3:]
        clock = is_clock(line)
        if opened is not None:
            yield *opened, None if strict and clock else line
            opened = None
        if offset >= end:
            return
        run = run + 1 if clock else 0
        if clock and (strict or run % 2):
            opened = (offset, line)
    if opened is not None:
        yield *opened, None


def heads_in(f) -> Iterator[tuple[int, bytes]]:
    """The leading header lines; blank lines may stand between them."""
    for offset, line in lines_from(f, 0):
        text = (line[3:] if offset == 0 and line.startswith(BOM) else line).strip(BLANKS)
        if HEADER.fullmatch(text):
            yield offset, text
        elif text:
            return


class Ranges(InputPartition):
    """Ranges of files that one task reads: (path, start, end)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class CaptureReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.globs = options.get("globs", "capture*.txt").split("\n")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.strict = options.get("strict", "false").lower() == "true"
        self.heads = options.get("kind", "pairs") == "headers"
        self.size = max(1, int(options.get("range_bytes", RANGE_BYTES)))
        self.task = max(self.size, int(options.get("task_bytes", TASK_BYTES)))
        self.wanted: list[tuple[str, tuple[str, ...]]] = []

    def _chosen(self, name: str) -> bool:
        return all(name.startswith(v) if how == "prefix" else name in v for how, v in self.wanted)

    def files(self) -> list[tuple[str, int]]:
        """(name, bytes) of the matching files; hidden files and folders do not count."""
        system, root = opened(self.path)
        # Local names are bare, as in ``captures.local_path``; others keep their scheme and host.
        prefix = "" if isinstance(system, fs.LocalFileSystem) else self.path.rstrip("/").removesuffix(root.rstrip("/"))
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [found] if found.is_file else system.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        out = []
        for info in listed:
            below = info.path[len(root) :].strip("/").split("/")
            if info.is_file and not any(p[:1] == "." or p[:1] == "_" and "=" not in p for p in below) and any(fnmatch.fnmatchcase(info.base_name, g) for g in self.globs):
                if info.extension in ("gz", "bz2", "zst", "lz4", "snappy"):
                    raise ValueError(f"compressed capture: {info.path}")
                out.append((prefix + info.path, info.size))
        if not out:
            raise FileNotFoundError(f"no files matched {self.globs} in {self.path}")
        return sorted(out)

    def partitions(self) -> Sequence[InputPartition]:
        tasks: list[list[tuple[str, int, int]]] = [[]]
        room = self.task
        for name, size in self.files():
            if not self._chosen(name):
                continue
            # Of headers only the leading lines are read, a chunk a file.
            cuts = [(0, min(size, CHUNK))] if self.heads else [(a, min(a + self.size, size)) for a in range(0, size, self.size)]
            for a, b in cuts:
                if b - a > room and tasks[-1]:
                    tasks.append([])
                    room = self.task
                tasks[-1].append((name, a, b))
                room -= b - a
        return [Ranges(t) for t in tasks]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), *([] if self.heads else [pa.binary()])]
        names = ["source_file", "block", "row", "value", "address"][: len(kinds)]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for name, ranges in groupby(partition.ranges, key=lambda r: r[0]):
            system, path = opened(name)
            with system.open_input_file(path) as f:
                for _, start, end in ranges:
                    for at, *texts in heads_in(f) if self.heads else pairs_in(f, start, end, self.strict):
                        rows.append((name, start, at, *texts))
                        held += sum(len(t) for t in texts if t)
                        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()


class FilteringReader(CaptureReader):
    """Takes conditions on ``source_file``; Spark refuses such a reader where pushing down is off."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("source_file",):
                values = f.value if isinstance(f, In) else (f.value,)
                self.wanted.append(("prefix" if isinstance(f, StringStartsWith) else "name", tuple(v for v in values if v is not None)))
            else:
                yield f


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_ranges"

    def schema(self) -> str:
        return HEADS if self.options.get("kind") == "headers" else PAIRS

    def reader(self, schema) -> CaptureReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else CaptureReader)(self.options)


def _read(spark: SparkSession, path: str, glob: str | Sequence[str], recursive: bool, **options) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    globs = [glob] if isinstance(glob, str) else list(glob)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    path = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    reader = spark.read.format("capture_ranges").options(
        globs="\n".join(globs), recursive=recursive, pushdown=spark.conf.get(PUSHDOWN, "false"), **options)
    rows = reader.load(path)
    texts = [c for c in ("value", "address") if c in rows.columns]
    return rows.withColumns({c: F.make_valid_utf8(F.col(c).cast("string")) for c in texts})


def read_pairs(
    spark: SparkSession, path: str, *, glob: str | Sequence[str] = "capture*.txt", recursive: bool = False, strict: bool = False,
    range_bytes: int = RANGE_BYTES, task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Clock lines that open a packet with the line after them: source_file, block, row, value, address.

    ``block`` is where the range begins and ``row`` where the line does, in bytes; they order the packets of a file. However small the ranges
    are, the number of tasks grows with ``task_bytes``.
    """
    return _read(spark, path, glob, recursive, strict=strict, range_bytes=range_bytes, task_bytes=task_bytes)


def read_header_lines(
    spark: SparkSession, path: str, *, glob: str | Sequence[str] = "capture*.txt", recursive: bool = False
) -> DataFrame:
    """The leading header lines of each file: source_file, block, row, value."""
    return _read(spark, path, glob, recursive, kind="headers")
