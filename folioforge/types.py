"""Types from their short names without a running session."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "binary": T.BinaryType(),
}


def _parts(s: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(s):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(s[at:i])
            at = i + 1
    return [*out, s[at:]]


def data_type(s: str) -> T.DataType:
    s = s.strip()
    if s.endswith(">"):
        kind, _, inner = s[:-1].partition("<")
        if kind == "array":
            return T.ArrayType(data_type(inner))
        if kind == "map":
            return T.MapType(*map(data_type, _parts(inner)))
        return struct(inner)
    return _SIMPLE[s]


def struct(s: str) -> T.StructType:
    """`name type, name type` (or `name: type`) as a struct."""
    fields = (p.strip().replace(":", " ", 1).split(None, 1) for p in _parts(s))
    return T.StructType([T.StructField(n, data_type(t)) for n, t in fields])
