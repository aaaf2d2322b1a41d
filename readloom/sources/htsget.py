"""Data source `htsget`: the same records, served by tickets over HTTP.

Options: url and id, or path as `url/id`; region `name:start-end`, or several with
`;` between them, or none for all records; `headers` as a
JSON object for every request; `replies`, a JSON object of url to file or data:
address, which stands in for the network in tests.
"""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom import ship
from readloom.codec import bam, bgzf
from readloom.sources.bam import overlapping, parse_region

ship(__name__)

#: Bytes of records that a task decodes at a time.
WINDOW = 1 << 20


def error_text(body: bytes) -> str:
    """`type: message` of an error reply, or the reply itself."""
    try:
        e = json.loads(body).get("htsget", {})
        return f"{e.get('error', 'error')}: {e.get('message', '')}"
    except (ValueError, AttributeError):
        return body.decode("utf-8", "replace")


class Client:
    def __init__(self, options: dict[str, str]) -> None:
        self.headers = json.loads(options.get("headers", "{}"))
        self.replies = json.loads(options.get("replies", "{}"))

    def chunks(self, url: str, headers: dict[str, str] | None = None, size: int = 1 << 20) -> Iterator[bytes]:
        """What an address has, so many bytes at a time."""
        url = self.replies.get(url, url)
        if url.startswith("data:"):
            head, _, data = url.partition(",")
            yield base64.b64decode(data) if head.endswith(";base64") else urllib.parse.unquote_to_bytes(data)
            return
        if not url.startswith(("http://", "https://")):
            yield from bgzf.Source(url).chunks(size)
            return
        sent = {k: v for k, v in {**self.headers, **(headers or {})}.items() if k.lower() != "referer"}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=sent)) as r:
                while got := r.read(size):
                    yield got
        except urllib.error.HTTPError as e:
            raise OSError(f"HTTP {e.code} for {url}: {error_text(e.read())}") from e

    def ticket(self, url: str) -> list[dict]:
        body = json.loads(b"".join(self.chunks(url)))
        if "htsget" not in body or "urls" not in body["htsget"]:
            raise OSError(f"no ticket from {url}: {error_text(json.dumps(body).encode())}")
        return body["htsget"]["urls"]

    def fetch(self, url: str) -> Iterator[bytes]:
        """The contents of the ticket's parts in its order, unpacked each for itself, a block or chunk at a time."""
        for u in self.ticket(url):
            yield from bgzf.inflated(self.chunks(u["url"], u.get("headers")))


def records_offset(data: bytes) -> int:
    """Where records begin: after a header if there is one, else at once."""
    if data[:4] != b"BAM\1":
        return 0
    size = int.from_bytes(data[4:8], "little")
    table = bam.parse_references(data, 8 + size) if len(data) >= 8 + size else None
    if table is None:
        raise bgzf.Truncated("the header is cut short")
    return table[1]


def first_bytes(parts: Iterator[bytes]) -> bytes:
    """As many parts as tell where records begin, in one; all if they don't."""
    held = bytearray()
    for p in parts:
        held += p
        if len(held) >= 4:
            try:
                records_offset(bytes(held))
            except bgzf.Truncated:
                continue
            break
    return bytes(held)


class HtsgetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "htsget"

    def schema(self) -> str:
        return bam.SQL_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HtsgetReader(dict(self.options))


class HtsgetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.base = options["path"] if "path" in options else f"{options['url'].rstrip('/')}/{options['id']}"
        head = first_bytes(Client(options).fetch(f"{self.base}?class=header&format=BAM"))
        if head[:4] != b"BAM\1":
            raise bgzf.Truncated("the header is cut short")
        records_offset(head)  # raises if the header isn't all there
        size = int.from_bytes(head[4:8], "little")
        self.header = bam.Header(head[8:8 + size].decode("utf-8", "replace"), bam.parse_references(head, 8 + size)[0], 0)

    def partitions(self) -> list[InputPartition]:
        ids = self.header.ids()
        regions = [parse_region(r) for r in self.options.get("region", "").split(";") if r]
        if not regions:
            return [InputPartition(())]  # everything
        known = [(n, s, e) for n, s, e in regions if n in ids]  # an unknown name asks for nothing
        return [InputPartition(r) for r in known] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        where = dict(zip(("referenceName", "start", "end"), partition.value))
        ask = urllib.parse.urlencode({**where, "format": "BAM"})
        parts = Client(self.options).fetch(f"{self.base}?{ask}")
        names, buf, base = [n for n, _ in self.header.references], first_bytes(parts), 0  # base: where the buffer begins in the reply
        at = records_offset(buf)
        while True:
            more = bytearray()
            while len(more) < WINDOW and (got := next(parts, None)) is not None:
                more += got
            buf += more
            starts, stop = bam.record_starts(buf, at)
            if starts:
                out = bam.batch(buf, starts, base + np.array(starts), names)
                if partition.value:
                    name, start, end = partition.value
                    out = out.filter(pa.array(overlapping(out, [(self.header.ids()[name], start, end)])))
                if out.num_rows:
                    yield out
            if not more:
                break
            buf, at, base = buf[stop:], 0, base + stop
        if stop < len(buf):
            raise bgzf.Truncated("reply ends inside a record")
