"""Binary count files as Spark data sources, for exchange with existing count runs.

``barcode_counts``: little-endian int64 n, then n x (uint32 barcode, int64 count).
``key_counts``: blocks of int64 n, then n x (16 key bytes, int64 count).
Written directories hold self-contained files; readers take any number of files.
``mode("overwrite")`` replaces what a directory holds, ``append`` adds to it.
Inside Spark pipelines Parquet tables are the better choice.
"""

from __future__ import annotations

import uuid

from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
)

from barcloud.sources import files

_HEADER = 8
_BATCH = 1 << 18
#: A task's barcode counts are held up to this many (12 bytes each) and written as a file.
FILE_RECORDS = 1 << 20


class _Layout:
    """Record layout of one file kind."""

    def __init__(self, kind: str):
        import numpy as np

        self.kind = kind
        self.key = "bc" if kind == "barcode_counts" else "bc_key"
        code = "<u4" if kind == "barcode_counts" else "V16"
        self.dtype = np.dtype([("key", code), ("n", "<i8")])


class _Range(InputPartition):
    def __init__(self, path: str, start: int, records: int):
        super().__init__((path, start, records))
        self.path, self.start, self.records = path, start, records


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options):
        self.kind, self.paths = kind, options["path"]
        self.step = int(options.get("splitRecords", 4 << 20))

    def partitions(self):
        parts = []
        size = _Layout(self.kind).dtype.itemsize
        for path, length in files.expand(self.paths):
            system, inner = files.filesystem(path)
            with system.open_input_file(inner) as f:
                at = 0
                while at + _HEADER <= length:  # hop from block header to block header
                    f.seek(at)
                    n = int.from_bytes(f.read(_HEADER), "little", signed=True)
                    if n < 0 or at + _HEADER + n * size > length:
                        raise ValueError(f"corrupted count file: {path}")
                    parts += [_Range(path, at + _HEADER + a * size, b - a) for a, b in files.ranges(n, self.step)]
                    at += _HEADER + n * size
        return parts

    def read(self, part: _Range):
        import numpy as np
        import pyarrow as pa

        layout = _Layout(self.kind)
        system, inner = files.filesystem(part.path)
        with system.open_input_file(inner) as f:
            f.seek(part.start)
            for a, b in files.ranges(part.records, _BATCH):
                rows = np.frombuffer(f.read((b - a) * layout.dtype.itemsize), layout.dtype)
                if self.kind == "barcode_counts":
                    key = pa.array(rows["key"].astype(np.int64))
                else:
                    raw = np.ascontiguousarray(rows["key"]).tobytes()
                    key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), b - a, [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_pydict({layout.key: key, "n": pa.array(rows["n"].astype(np.int64))})


class _Writer(DataSourceArrowWriter):
    """Files under names of this run; an overwrite removes what was there once all of the new ones are in place."""

    def __init__(self, kind: str, options, overwrite: bool):
        self.kind, self.directory, self.overwrite = kind, options["path"], overwrite
        self.run = uuid.uuid4().hex
        self.suffix = "ncnt" if kind == "barcode_counts" else "fcnt"

    def write(self, iterator):
        import numpy as np
        from pyspark import TaskContext

        layout = _Layout(self.kind)
        out = files.TaskFiles(self.directory, f"part-{TaskContext.get().partitionId():05d}-{self.run}", self.suffix)

        def block(batch):
            rows = np.empty(batch.num_rows, layout.dtype)
            if self.kind == "barcode_counts":
                rows["key"] = batch.column(layout.key).to_numpy(zero_copy_only=False)
            else:
                rows["key"] = np.frombuffer(b"".join(batch.column(layout.key).to_pylist()), "V16")
            rows["n"] = batch.column("n").to_numpy(zero_copy_only=False)
            return rows

        blocks = (block(b) for b in iterator if b.num_rows)
        # a barcode count file has one header, so a task's rows become files of bounded size; the other kind has many blocks
        for group in _grouped(blocks) if self.kind == "barcode_counts" else [blocks]:
            with out.next() as stream:
                for rows in group:
                    stream.write(len(rows).to_bytes(_HEADER, "little", signed=True))
                    stream.write(rows.tobytes())
                    out.filled = True
        return out.written()

    def commit(self, messages):
        files.commit(self.directory, messages, self.overwrite)

    def abort(self, messages):
        files.abort(messages)


def _grouped(blocks):
    """Blocks joined to one of FILE_RECORDS rows or more, one at a time."""
    import numpy as np

    held, n = [], 0
    for rows in blocks:
        held.append(rows)
        n += len(rows)
        if n >= FILE_RECORDS:
            yield [np.concatenate(held)]
            held, n = [], 0
    if held:
        yield [np.concatenate(held)]


class BarcodeCounts(DataSource):
    @classmethod
    def name(cls):
        return "barcode_counts"

    def schema(self):
        return "bc long, n long"

    def reader(self, schema):
        return _Reader(self.name(), self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.name(), self.options, overwrite)


class KeyCounts(BarcodeCounts):
    @classmethod
    def name(cls):
        return "key_counts"

    def schema(self):
        return "bc_key binary, n long"


def register(spark):
    spark.dataSource.register(BarcodeCounts)
    spark.dataSource.register(KeyCounts)
    return spark
