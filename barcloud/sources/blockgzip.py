"""Block gzip: gzip files of many small members, each of which tells its compressed size.

``Blocks`` reads such a file from any compressed offset on; ``write`` makes one.  A member's header has an extra field ``BC``
with the member's size less one, and no member holds more than 65,280 bytes, so a reader finds the next member
within 64 KB of any offset.

``df.write.format("block_gzip_text")`` writes a column ``value`` as lines, a file for each task.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from barcloud.sources import files

MEMBER_BYTES = 65_280
_LONGEST = 1 << 16
_MAGIC = b"\x1f\x8b\x08\x04"
# Fixed value: the empty member that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def member_size(head: bytes) -> int | None:
    """Size of the member that ``head`` begins, or None if it begins no such member."""
    if len(head) < 18 or not head.startswith(_MAGIC):
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def unpack(member: bytes) -> bytes:
    """The bytes of a whole member; its checksum and length are tested."""
    extra = int.from_bytes(member[10:12], "little")
    data = zlib.decompress(member[12 + extra : -8], wbits=-15)
    if struct.unpack("<II", member[-8:]) != (zlib.crc32(data), len(data) & 0xFFFFFFFF):
        raise ValueError("corrupt block gzip member")
    return data


def member(data: bytes) -> bytes:
    """``data``, at most MEMBER_BYTES of it, as one member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    if len(body) + 26 > _LONGEST:  # bytes that don't compress
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
    head = _MAGIC + bytes(5) + b"\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def write(stream, chunks) -> None:
    """The bytes of ``chunks`` as members of ``stream``, with the end member."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while len(held) >= MEMBER_BYTES:
            stream.write(member(bytes(held[:MEMBER_BYTES])))
            del held[:MEMBER_BYTES]
    if held:
        stream.write(member(bytes(held)))
    stream.write(END)


def is_block_gzip(stream) -> bool:
    """Whether the stream, at its beginning, is block gzip."""
    return member_size(stream.read(1 << 10)) is not None


def first_member(stream, start: int, size: int) -> int | None:
    """Offset of the first member that begins at or after ``start``; None where no further one does.

    Compressed bytes may look like a header by chance, so a place counts only if the member there can be unpacked.
    """
    stream.seek(start)
    near = stream.read(3 * _LONGEST)
    at = near.find(_MAGIC)
    while 0 <= at < _LONGEST:
        length = member_size(near[at : at + (1 << 10)])
        if length is not None and at + length <= len(near):
            try:
                unpack(near[at : at + length])
                return start + at
            except (ValueError, zlib.error):
                pass
        at = near.find(_MAGIC, at + 1)
    if start + _LONGEST < size:
        raise ValueError(f"no block gzip member within 64 KB of byte {start}")
    return None


class Blocks:
    """The decompressed bytes from the member at ``start`` on; offsets count from its first byte.

    ``limit`` is the offset at which the members that begin at or after compressed byte ``end`` begin; None until the reader has come there.
    """

    def __init__(self, stream, start: int, end: int):
        self._stream, self._end = stream, end
        self._members, self._offsets = [start], [0]  # where members begin: compressed and decompressed
        self._at, self._rest, self.limit = 0, b"", None

    def seek(self, offset: int) -> None:
        """To an offset in the part that was read before, or its end."""
        self._at = bisect_right(self._offsets, offset) - 1
        self._rest = b""
        skip = offset - self._offsets[self._at]
        if skip:
            self._rest = self._next()[skip:]

    def _next(self) -> bytes:
        """The bytes of the member at ``_at``; empty at the end of the file."""
        place = self._members[self._at]
        if place >= self._end and self.limit is None:
            self.limit = self._offsets[self._at]
        self._stream.seek(place)
        packed = self._stream.read(_LONGEST)
        if not packed:
            return b""
        length = member_size(packed[: 1 << 10])
        if length is None or length > len(packed):
            raise ValueError(f"truncated block gzip at byte {place}")
        data = unpack(packed[:length])
        self._at += 1
        if self._at == len(self._members):
            self._members.append(place + length)
            self._offsets.append(self._offsets[-1] + len(data))
        return data

    def _some(self) -> bytes:
        """The next bytes there are; members may be empty in the middle of a file."""
        data, self._rest = self._rest, b""
        while not data:
            before = self._at
            data = self._next()
            if self._at == before:
                return b""
        return data

    def read(self, size: int) -> bytes:
        """``size`` bytes, or fewer once ``limit`` is known."""
        parts, held = [], 0
        while held < size and (data := self._some()):
            parts.append(data)
            held += len(data)
            if self.limit is not None:
                break
        data = b"".join(parts)
        data, self._rest = data[:size], data[size:]
        return data


class _LineWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.directory, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        out = files.TaskFiles(self.directory, f"part-{TaskContext.get().partitionId():05d}-{self.run}", "gz")

        def lines():
            for batch in iterator:
                for value in batch.column(0):
                    out.filled = True
                    yield (value.as_py() or "").encode() + b"\n"

        with out.next() as stream:
            write(stream, lines())
        return out.written()

    def commit(self, messages):
        files.commit(self.directory, messages, self.overwrite)

    def abort(self, messages):
        files.abort(messages)


class BlockGzipText(DataSource):
    @classmethod
    def name(cls):
        return "block_gzip_text"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return _LineWriter(self.options, overwrite)


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    """The column ``value`` of ``lines`` as block gzip files in ``path``; a null is an empty line."""
    lines.sparkSession.dataSource.register(BlockGzipText)
    lines.select("value").write.format("block_gzip_text").mode(mode).save(path)
