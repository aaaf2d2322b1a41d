"""Tags as columns: Arrow functions over the packed tail of records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom import ship
from readloom.codec import tags as codec

ship(__name__)

CELL = "struct<type:string,i:bigint,f:double,s:string,ai:array<bigint>,af:array<double>>"


def decode_tags(raw: Column | str) -> Column:
    """All tags of a record: name to typed value."""

    @F.pandas_udf(f"map<string,{CELL}>")
    def all_of(values: pd.Series) -> pd.Series:
        return values.map(codec.decode)

    return all_of(raw)


def get_tag(raw: Column, name: str, kind: str = "string") -> Column:
    """One tag, found without decoding the others; null where it is absent or of another kind."""

    @F.pandas_udf(kind)
    def one(values: pd.Series) -> pd.Series:
        wants = (str,) if kind == "string" else (list,) if kind.startswith("array") else (int, float)
        got = (codec.find(v, name) for v in values)
        return pd.Series([x[1] if x is not None and isinstance(x[1], wants) else None for x in got], dtype=object)

    return one(raw)


def get_tags(raw: Column, **kinds: str) -> Column:
    """Several tags in one walk, as a struct: name to `long`, `double`, `string`, an array of numbers, or `binary` for a text's bytes."""

    @F.pandas_udf(", ".join(f"`{n}` {k}" for n, k in kinds.items()))
    def all_of(values: pd.Series) -> pd.DataFrame:
        out = {n: [None] * len(values) for n in kinds}
        for i, v in enumerate(values):
            left = dict(kinds)
            for n, k, a, b in codec.walk(v or b""):
                if n in left:
                    kind = left.pop(n)
                    if kind == "binary":
                        out[n][i] = v[a:b - (v[b - 1] == 0)] if k in "ZH" else None
                    else:
                        x = codec.value(v, k, a, b)
                        out[n][i] = x if isinstance(x, (str,) if kind == "string" else (list,) if kind.startswith("array") else (int, float)) else None
                    if not left:
                        break
        return pd.DataFrame({n: pd.Series(x, dtype=object) for n, x in out.items()})

    return all_of(raw)


def get_tag_raw(raw: Column, name: str) -> Column:
    """Bytes of a text tag."""

    @F.pandas_udf("binary")
    def one(values: pd.Series) -> pd.Series:
        return pd.Series([codec.find_raw(v, name) for v in values], dtype=object)

    return one(raw)


def get_tag_alt(raw: Column, first: str, second: str, kind: str = "string") -> Column:
    """The first tag if it is there, else the second, in one walk."""

    @F.pandas_udf(kind)
    def one(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            found = {}
            for n, k, a, b in codec.walk(v or b""):
                if n in (first, second) and n not in found:
                    found[n] = codec.value(v, k, a, b)
                    if n == first:
                        break
            out.append(found.get(first, found.get(second)))
        return pd.Series(out, dtype=object)

    return one(raw)
