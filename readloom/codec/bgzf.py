"""Blocked gzip: block scan, inflate, deflate and ranged file access."""

from __future__ import annotations

import struct
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

from readloom import ship

ship(__name__)

#: Fixed values of the format: magic bytes, largest block, and the empty block that ends a file.
MAGIC = b"\x1f\x8b\x08\x04"
MAX_BLOCK = 1 << 16
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class Truncated(ValueError):
    """The file ends inside a block or a record."""


def block_size(buf: bytes, at: int) -> int | None:
    """Size of the block at `at`; None when its header isn't all there."""
    if len(buf) - at < 18:
        return None
    if buf[at:at + 4] != MAGIC:
        raise ValueError("not BGZF: a block does not start with its magic bytes")
    extra = struct.unpack_from("<H", buf, at + 10)[0]
    p, end = at + 12, at + 12 + extra
    if len(buf) < end:
        return None
    while p + 4 <= end:
        name, n = buf[p:p + 2], struct.unpack_from("<H", buf, p + 2)[0]
        if name == b"BC" and n == 2:
            return struct.unpack_from("<H", buf, p + 4)[0] + 1
        p += 4 + n
    raise ValueError("not BGZF: a block has no size field")


def inflate(buf: bytes, at: int, size: int) -> bytes:
    extra = struct.unpack_from("<H", buf, at + 10)[0]
    return zlib.decompress(buf[at + 12 + extra:at + size - 8], -15)


def blocks(source: Source, at: int = 0, window: int = 1 << 20, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(file offset, contents) of each block from `at` on, reading a window at a time.

    The end of a window that cuts a block is carried to the next one. `stop` is
    the first block offset that isn't wanted any more.
    """
    carry = b""
    window = max(window, MAX_BLOCK)
    while True:
        got = source.read(at + len(carry), window)
        buf = carry + got
        p = 0
        while (n := block_size(buf, p)) is not None and p + n <= len(buf):
            if stop is not None and at + p >= stop:
                return
            yield at + p, inflate(buf, p, n)
            p += n
        carry, at = buf[p:], at + p
        if stop is not None and at >= stop:
            return
        if len(got) < window:
            if carry:
                raise Truncated("file ends inside a BGZF block")
            return


#: Bytes that a stored block adds to its contents: gzip header and trailer, and the header of the stored part.
STORED = 26 + 5


def block_from(source: Source, at: int, chain: int = 3) -> int | None:
    """Where the first block at or after a byte begins; None if none does.

    A block is known by its magic bytes, and by as many blocks that follow one
    another from there (or the file's end), since contents may hold those bytes too.
    """
    window = (chain + 2) * MAX_BLOCK
    while buf := source.read(at, window):
        last = len(buf) < window
        p = buf.find(MAGIC)
        while 0 <= p < (len(buf) if last else MAX_BLOCK):
            q, n = p, 0
            while n < chain:
                try:
                    size = block_size(buf, q)
                    if size is None or q + size > len(buf):
                        break
                    inflate(buf, q, size)
                except (ValueError, zlib.error):
                    break
                q, n = q + size, n + 1
            if n == chain or (n and last and q == len(buf)):
                return at + p
            p = buf.find(MAGIC, p + 1)
        if last:
            return None
        at += MAX_BLOCK
    return None


def deflate(data: bytes, level: int = 6) -> bytes:
    """One block; at level 0 its contents are stored as they are, so its size is known beforehand."""
    if level:
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
    else:
        body = b"\1" + struct.pack("<HH", len(data), len(data) ^ 0xFFFF) + data
    head = MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class Source:
    """Ranged reads of a local path, an http(s) URL or any store that pyarrow knows."""

    def __init__(self, path: str) -> None:
        self.path = path
        self._file = None

    def _open(self):
        if self._file is None:
            path = self.path
            if "://" not in path or path.startswith("file:"):
                self._file = open(path.removeprefix("file://").removeprefix("file:"), "rb")  # noqa: SIM115
            else:
                from pyarrow import fs

                store, inner = fs.FileSystem.from_uri(path)
                self._file = store.open_input_file(inner)
        return self._file

    def read(self, at: int, n: int) -> bytes:
        if n <= 0:
            return b""
        if self.path.startswith(("http://", "https://")):
            ask = urllib.request.Request(self.path, headers={"Range": f"bytes={at}-{at + n - 1}"})
            try:
                with urllib.request.urlopen(ask) as r:
                    return r.read()
            except urllib.error.HTTPError as e:
                if e.code == 416:
                    return b""
                raise
        f = self._open()
        f.seek(at)
        return f.read(n)

    def chunks(self, size: int = 1 << 24) -> Iterator[bytes]:
        """The whole contents, so many bytes at a time."""
        at = 0
        while got := self.read(at, size):
            yield got
            at += len(got)

    def all(self) -> bytes:
        return b"".join(self.chunks())

    def _info(self):
        from pyarrow import fs

        local = "://" not in self.path or self.path.startswith("file:")
        store, inner = (fs.LocalFileSystem(), self.path.removeprefix("file://").removeprefix("file:")) if local else fs.FileSystem.from_uri(self.path)
        return store.get_file_info(inner)

    def _told(self, *names: str) -> list[str | None]:
        with urllib.request.urlopen(urllib.request.Request(self.path, method="HEAD")) as r:
            return [r.headers.get(n) for n in names]

    def state(self) -> str | None:
        """What changes when the file does, without reading it; None where the store doesn't tell."""
        if self.path.startswith(("http://", "https://")):
            told = self._told("ETag", "Last-Modified", "Content-Length")
            return repr(told) if any(told[:2]) else None
        info = self._info()
        return f"{info.size} {info.mtime_ns}" if info.mtime_ns else None

    def size(self) -> int | None:
        """The file's size in bytes; None where the store doesn't tell."""
        if self.path.startswith(("http://", "https://")):
            (told,) = self._told("Content-Length")
            return int(told) if told else None
        return self._info().size

    def exists(self) -> bool:
        try:
            self.read(0, 1)
        except (OSError, ValueError):
            return False
        return True


def sink(path: str):
    """A new file at a local path or in any store that pyarrow knows."""
    if "://" not in path or path.startswith("file:"):
        return open(path.removeprefix("file://").removeprefix("file:"), "wb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner)


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The contents of chunks that follow one another, a block or chunk at a time: blocks or plain gzip unpacked, anything else as it is."""
    rest, carry = iter(chunks), b""
    while len(carry) < 4 and (got := next(rest, b"")):
        carry += got
    if carry[:4] != MAGIC:
        gzip = zlib.decompressobj(31) if carry[:2] == b"\x1f\x8b" else None
        for c in chain([carry], rest):
            if gzip is None:
                yield c
            elif not gzip.eof:
                yield gzip.decompress(c)
        if gzip is not None and not gzip.eof:
            raise Truncated("file ends inside a gzip member")
        return
    for c in chain([b""], rest):
        carry, p = carry + c, 0
        while (n := block_size(carry, p)) is not None and p + n <= len(carry):
            yield inflate(carry, p, n)
            p += n
        carry = carry[p:]
    if carry:
        raise Truncated("file ends inside a BGZF block")


def inflate_all(data: bytes) -> bytes:
    """Every block of a buffer; a buffer that isn't blocked comes back as it is."""
    return b"".join(inflated([data]))
