"""Auxiliary tags: the self-describing tail of a record.

The walk stops at a type it doesn't know, keeping what came before. Where a name
occurs twice the first one counts.
"""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

from readloom import ship

ship(__name__)

#: Fixed values of the format: how numbers of a type are stored.
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
ARRAYS = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}


def walk(raw: bytes):
    """(name, type, start of the value, end of the tag) one after another."""
    p = 0
    while p + 3 <= len(raw):
        name, kind = raw[p:p + 2].decode("latin-1"), chr(raw[p + 2])
        start = p + 3
        if kind == "A":
            end = start + 1
        elif kind in NUMBERS:
            end = start + struct.calcsize(NUMBERS[kind])
        elif kind in "ZH":
            nul = raw.find(b"\0", start)
            end = len(raw) if nul < 0 else nul + 1
        elif kind == "B" and start + 5 <= len(raw) and chr(raw[start]) in ARRAYS:
            end = start + 5 + int.from_bytes(raw[start + 1:start + 5], "little") * np.dtype(ARRAYS[chr(raw[start])]).itemsize
        else:
            return
        if end > len(raw):
            return
        yield name, kind, start, end
        p = end


def value(raw: bytes, kind: str, start: int, end: int) -> Any:
    if kind == "A":
        return chr(raw[start])
    if kind in NUMBERS:
        return struct.unpack_from("<" + NUMBERS[kind], raw, start)[0]
    if kind in "ZH":
        text = raw[start:end - (raw[end - 1] == 0)]
        return text.decode("utf-8", "replace")
    return np.frombuffer(raw[start + 5:end], ARRAYS[chr(raw[start])]).tolist()


def decode(raw: bytes | None) -> dict[str, dict[str, Any]]:
    """Name to {type, i, f, s, ai, af}, of which one besides the type is set."""
    out: dict[str, dict[str, Any]] = {}
    for name, kind, start, end in walk(raw or b""):
        if name in out:
            continue
        v = value(raw, kind, start, end)
        cell = {"type": kind, "i": None, "f": None, "s": None, "ai": None, "af": None}
        if kind == "B":
            sub = chr(raw[start])
            cell["type"] = "B" + sub
            cell["af" if sub == "f" else "ai"] = [float(x) if sub == "f" else int(x) for x in v]
        else:
            cell["f" if kind == "f" else "s" if kind in "AZH" else "i"] = v
        out[name] = cell
    return out


def find(raw: bytes | None, name: str) -> tuple[str, Any] | None:
    """The first tag of that name, without decoding the others."""
    for n, kind, start, end in walk(raw or b""):
        if n == name:
            return kind, value(raw, kind, start, end)
    return None


def find_raw(raw: bytes | None, name: str) -> bytes | None:
    """The bytes of a text tag."""
    for n, kind, start, end in walk(raw or b""):
        if n == name:
            return raw[start:end - (raw[end - 1] == 0)] if kind in "ZH" else None
    return None


def encode(name: str, kind: str, v: Any) -> bytes:
    head = name.encode("latin-1")
    if kind == "A":
        return head + b"A" + v.encode("latin-1")
    if kind in NUMBERS:
        return head + kind.encode() + struct.pack("<" + NUMBERS[kind], v)
    if kind in "ZH":
        return head + kind.encode() + v.encode("utf-8") + b"\0"
    sub = kind[1]
    a = np.array(v, ARRAYS[sub])
    return head + b"B" + sub.encode() + struct.pack("<I", len(a)) + a.tobytes()
