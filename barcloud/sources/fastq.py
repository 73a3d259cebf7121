"""FASTQ as a Spark data source: ``spark.read.format("fastq")``.

Options: ``path`` (comma-separated), ``layout`` = ``pairs`` (interleaved, 8 lines per row) or
``records`` (4 lines per row), ``splitBytes``.  Uncompressed files are split in byte ranges that
resynchronise on record (and pair) boundaries, and block gzip in ranges of compressed bytes that do so after finding
a member; any other compressed file is one partition, with a warning where it is longer than a split.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barcloud.sources import blockgzip, files

PAIR_FIELDS = ["name", "r1", "q1", "name2", "r2", "q2"]
RECORD_FIELDS = ["name", "seq", "qual"]
_PAIR_LINES = [0, 1, 3, 4, 5, 7]
_RECORD_LINES = [0, 1, 3]
_BLOCK = 16 << 20
_BEYOND = 1 << 16  # read behind the end of a split for the rest of its last row
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
_BLOCK_GZIP = (".gz", ".bgz", ".bgzf")


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def _pairs(self) -> bool:
        layout = self.options.get("layout", "pairs")
        if layout not in ("pairs", "records"):
            raise ValueError(f"unknown FASTQ layout: {layout}")
        return layout == "pairs"

    def schema(self):
        fields = PAIR_FIELDS if self._pairs() else RECORD_FIELDS
        return "file_no int, split long, idx long, " + ", ".join(f"{f} string" for f in fields)

    def reader(self, schema):
        return FastqReader(self.options, self._pairs())


class Split(InputPartition):
    """Bytes [start, end) of a file of ``size`` bytes; without ``end`` a compressed file, and ``blocks`` for block gzip."""

    def __init__(self, file_no: int, path: str, start: int, end: int | None, size: int, blocks: bool = False):
        super().__init__((file_no, path, start, end, size, blocks))
        self.file_no, self.path, self.start, self.end, self.size, self.blocks = file_no, path, start, end, size, blocks


class FastqReader(DataSourceReader):
    def __init__(self, options, pairs: bool):
        self.paths = options["path"]
        self.step = int(options.get("splitBytes", 64 << 20))
        self.pairs = pairs

    def partitions(self):
        splits, found = [], files.expand(self.paths)
        step = files.split_bytes(sum(size for _, size in found), self.step)
        for number, (path, size) in enumerate(found):
            blocks = path.endswith(_BLOCK_GZIP) and _is_block_gzip(path)
            if path.endswith(_COMPRESSED) and not blocks:
                if size > step:
                    warnings.warn(f"{path} can't be split and is read by one task; block gzip can")
                splits.append(Split(number, path, 0, None, size))
            else:
                splits += [Split(number, path, a, b, size, blocks) for a, b in files.ranges(size, step)]
        return splits

    def read(self, split: Split | None):
        if split is None:  # no split at all: all files are empty
            return
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        wanted = _PAIR_LINES if self.pairs else _RECORD_LINES
        fields = PAIR_FIELDS if self.pairs else RECORD_FIELDS
        per_row = 8 if self.pairs else 4
        system, path = files.filesystem(split.path)
        end = lambda: split.end
        if split.end is None:
            stream, offset = system.open_input_stream(path), 0
        elif split.blocks:
            stream = system.open_input_file(path)
            first = blockgzip.first_member(stream, split.start, split.size)
            if first is None or first >= split.end:
                return
            stream = blockgzip.Blocks(stream, first, split.end)
            # the byte before a member isn't known: a row that begins with a member belongs to the split before
            offset = _first_record(stream, 0 if split.start == 0 else 1, self.pairs)
            end = lambda: None if stream.limit is None else stream.limit + 1
            if offset is None or (end() is not None and offset >= end()):
                return
            stream.seek(offset)
        else:
            stream = system.open_input_file(path)
            offset = _first_record(stream, split.start, self.pairs)
            if offset is None or offset >= split.end:
                return
            stream.seek(offset)
        seen = 0
        for data, breaks in _whole_rows(stream, offset, end, per_row):
            # all lines as one string array over the block, fields are strided takes of it
            bounds = np.concatenate(([0], breaks + 1)).astype(np.int64)
            lines = pa.LargeStringArray.from_buffers(len(breaks), pa.py_buffer(bounds), pa.py_buffer(data))
            rows = len(breaks) // per_row
            columns = {
                "file_no": pa.array(np.full(rows, split.file_no, np.int32)),
                "split": pa.array(np.full(rows, split.start, np.int64)),
                "idx": pa.array(np.arange(seen, seen + rows, dtype=np.int64)),
            }
            for field, line in zip(fields, wanted):
                picked = lines.take(pa.array(np.arange(line, rows * per_row, per_row)))
                columns[field] = pc.utf8_rtrim(picked, "\r\n").cast(pa.string())
            seen += rows
            if self.pairs:
                _check_mates(columns["name"], columns["name2"])
            yield pa.RecordBatch.from_pydict(columns)


def _is_block_gzip(path: str) -> bool:
    system, inner = files.filesystem(path)
    with system.open_input_file(inner) as stream:
        return blockgzip.is_block_gzip(stream)


def _whole_rows(stream, offset: int, limit, per_row: int):
    """(bytes, line break positions) of whole rows starting before ``limit()``, if it is known; bytes read without it lie before it."""
    import numpy as np

    rest = b""
    while True:
        end = limit()
        ahead = _BLOCK if end is None else max(end - offset - len(rest), 0) + _BEYOND
        block = stream.read(min(_BLOCK, ahead))
        end = limit()
        data = rest + block
        if not block and data and not data.endswith(b"\n"):
            data += b"\n"
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        rows = len(breaks) // per_row
        if rows:
            last = breaks[per_row - 1: rows * per_row: per_row]
            starts = offset + np.concatenate(([0], last[:-1] + 1))
            mine = rows if end is None else int(np.searchsorted(starts, end))
            if mine:
                yield data, breaks[: mine * per_row]
            if mine < rows:
                return
            used = int(last[-1]) + 1
            rest, offset = data[used:], offset + used
        else:
            rest = data
        if not block:
            if rest.strip():
                raise ValueError("truncated FASTQ record at the end of the input")
            return
        if end is not None and offset >= end:
            return


def _check_mates(first, second) -> None:
    import pyarrow.compute as pc

    one, two = (pc.replace_substring_regex(c, r"(/[12])?(\s.*)?$", "") for c in (first, second))
    wrong = pc.index(pc.not_equal(one, two), True).as_py()
    if wrong >= 0:
        raise ValueError(f"mates with different names: {first[wrong]} and {second[wrong]}")


def _read_name(line: bytes) -> bytes:
    return re.sub(rb"/[12]$", b"", line.split(None, 1)[0] if line.split() else b"")


def _first_record(stream, start: int, pairs: bool) -> int | None:
    """Offset of the first record (pair) that begins at or after ``start``.

    A header is a line starting with '@' two lines above a line starting with '+': sequence lines
    start with neither, so quality lines cannot be mistaken.  Mates share their name, so where two
    neighbouring records differ, and at the end of the file, a pair ends; which of the records before
    begin a pair follows by counting, however many pairs share one name.
    """
    if start == 0:
        return 0
    stream.seek(start - 1)
    lines = _lines(stream)
    position = start - 1 + next(lines, (b"", 0))[1]
    window: list[tuple[bytes, int]] = []
    for line, size in lines:
        window.append((line, size))
        if len(window) == 3:
            if window[0][0].startswith(b"@") and window[2][0].startswith(b"+"):
                break
            position += window.pop(0)[1]
    else:
        return None  # no record begins here
    if not pairs:
        return position
    name, size = _read_name(window[0][0]), sum(s for _, s in window)
    records, first_size, at = 0, 0, 3
    for line, length in lines:
        if at == 0:  # the next record's header
            records += 1
            if _read_name(line) != name:
                break
        size += length
        at = (at + 1) % 4
        if at == 0 and records == 0:
            first_size = size
    else:
        records += 1 if at == 0 and first_size else 0
    return position if records % 2 == 0 else position + first_size


def _lines(stream):
    """(line without its break, bytes with it) from where the stream is."""
    rest = b""
    while block := stream.read(1 << 16):
        *whole, rest = (rest + block).split(b"\n")
        yield from ((line, len(line) + 1) for line in whole)
    if rest:
        yield rest, len(rest)


def read_pairs(spark: SparkSession, paths: str, **options) -> DataFrame:
    """Interleaved FASTQ: one row per pair."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").options(layout="pairs", **options).load(paths)


def _numbered(spark: SparkSession, paths: str, options) -> DataFrame:
    """Records of separate mate files with their ordinal in the file."""
    spark.dataSource.register(FastqSource)
    records = spark.read.format("fastq").options(layout="records", **options).load(paths)
    # one row per split; a file has size / splitBytes of them
    before = Window.partitionBy("file_no").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = records.groupBy("file_no", "split").agg(F.count("*").alias("n")).select(
        "file_no", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return records.join(offsets, ["file_no", "split"]).withColumn("ordinal", F.col("offset") + F.col("idx"))


def read_mates(spark: SparkSession, first: str, second: str, **options) -> DataFrame:
    """Separate mate files, paired by their position; fails when one file is longer."""
    one = _numbered(spark, first, options).select(
        "file_no", "ordinal", "name", F.col("seq").alias("r1"), F.col("qual").alias("q1"))
    two = _numbered(spark, second, options).select(
        "file_no", "ordinal", F.col("name").alias("name2"), F.col("seq").alias("r2"), F.col("qual").alias("q2"))
    joined = one.join(two, ["file_no", "ordinal"], "full_outer")
    lonely = F.col("name").isNull() | F.col("name2").isNull()
    fail = F.raise_error(F.lit("mate files differ in length")).cast("string")
    return joined.withColumn("name", F.when(lonely, fail).otherwise(F.col("name")))
