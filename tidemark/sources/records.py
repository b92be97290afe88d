"""Small encoded records: directory blocks, declared dates, trash entries, names, origins, references.

They are Protobuf messages. Their fields are given below as plain text; a pandas function decodes a binary column into a
struct. Records of a layout that isn't known raise an error; an empty body is an empty record.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd

LAYOUT = 1
# Field numbers, names and kinds of each record. kinds: s text, b bytes, i integer, B boolean, t time, {x} a
# record within, [x] repeated; a map is a repeated record of key and value.
ENTRY = {1: ("name", "s"), 2: ("uuid", "s"), 3: ("type", "i")}
CHILD = {1: ("min_key", "s"), 2: ("uuid", "s")}
REFERRER = {1: ("referrer_key", "s"), 2: ("referrer_version", "s"), 3: ("pending", "B"), 4: ("target_version", "s")}
STUB = {1: ("layout", "i"), 2: ("key", "s"), 3: ("version_id", "s"), 4: ("size", "i"), 5: ("sha256", "b")}
WINDOWS = {1: ("sddl", "s"), 2: ("attributes", "i"), 3: ("reparse", "b"), 4: ("dir_symlink", "B")}
CHECKSUMS = {1: ("md5", "b"), 2: ("sha256", "b")}


def _map(value: object) -> list[dict]:
    return [{1: ("key", "s"), 2: ("value", value)}]


RECORDS = {
    "metadata": {
        1: ("mode", "i"), 2: ("uid", "i"), 3: ("gid", "i"), 4: ("nlink", "i"), 5: ("xattrs", _map("b")), 7: ("rdev", "i"), 10: ("mtime_override_etag", "s"), 11: ("streams", _map("i")), 12: ("next_stream_id", "i"),
        13: ("atime", "t"), 14: ("mtime_override", "t"), 15: ("btime_override", "t"), 16: ("ctime", "t"), 17: ("windows", WINDOWS), 18: ("posix_acl_access", "b"), 19: ("posix_acl_default", "b"), 20: ("app", _map("b")),
        21: ("layout", "i"), 22: ("checksums", _map(CHECKSUMS)), 23: ("dated", "B"), 24: ("refs", _map(STUB)),
    },
    "block": {1: ("kind", "i"), 2: ("entries", [ENTRY]), 3: ("children", [CHILD]), 4: ("high_key", "s"), 5: ("right", "s"), 6: ("layout", "i")},
    "trash": {1: ("entry_id", "s"), 2: ("item_id", "s"), 3: ("type", "i"), 4: ("name", "s"), 5: ("parent_id", "s"), 6: ("path", "s"), 7: ("deleted_at", "t"), 8: ("deleted_by", "s"), 9: ("size", "i"), 10: ("version", "s"), 11: ("batch", "s"), 12: ("origin", "b"), 13: ("pass", "s"), 14: ("layout", "i")},
    "name": {1: ("name", "s"), 2: ("time", "t"), 3: ("scope", "s"), 4: ("created_by", "s"), 5: ("created_at", "t"), 6: ("layout", "i")},
    "origin": {1: ("drive", "s"), 2: ("id", "s"), 3: ("item_id", "s"), 4: ("version", "s"), 5: ("path", "s"), 6: ("layout", "i"), 7: ("alias", "B")},
    "stub": STUB,
    "refs": {1: ("layout", "i"), 2: ("referrers", [REFERRER]), 3: ("retired", "B")},
    "dates": {1: ("dates", [{1: ("version_id", "s"), 2: ("at", "t")}]), 2: ("layout", "i")},
}
_SQL = {"s": "string", "b": "binary", "i": "bigint", "B": "boolean", "t": "timestamp"}


def ddl(spec: dict) -> str:
    """The struct that a record decodes to."""
    parts = []
    for name, kind in spec.values():
        parts.append(f"`{name}`: " + (f"array<struct<{ddl(kind[0])}>>" if isinstance(kind, list) else f"struct<{ddl(kind)}>" if isinstance(kind, dict) else _SQL[kind]))
    return ", ".join(parts)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 0x7F) << shift
        if data[at] < 0x80:
            return n, at + 1
        at, shift = at + 1, shift + 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field: integers for varints, bytes for what has a length."""
    at = 0
    while at < len(data):
        key, at = _read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _read_varint(data, at)
        elif kind == 2:
            size, at = _read_varint(data, at)
            if at + size > len(data):
                raise ValueError("record cut short")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = struct.unpack("<Q" if kind == 1 else "<I", data[at : at + size])[0], at + size
        else:
            raise ValueError("unknown wire type")
        yield key >> 3, value


def _time(data: bytes) -> int:
    """Microseconds since 1970; finer parts are cut."""
    got = dict(fields(data))
    seconds = got.get(1, 0)
    return (seconds - (1 << 64) if seconds >> 63 else seconds) * 1_000_000 + got.get(2, 0) // 1000


def decode(spec: dict, data: bytes) -> dict:
    empty = {"s": "", "b": b"", "i": 0, "B": False, "t": None}
    out = {name: [] if isinstance(kind, list) else None if isinstance(kind, dict) else empty[kind] for name, kind in spec.values()}
    for number, value in fields(data):
        if number not in spec:
            continue
        name, kind = spec[number]
        if isinstance(kind, list):
            out[name].append(decode(kind[0], value))
        elif isinstance(kind, dict):
            out[name] = decode(kind, value)
        elif kind == "s":
            out[name] = value.decode("utf-8", "replace")
        elif kind == "i":
            out[name] = value - (1 << 64) if value >> 63 else value
        elif kind == "B":
            out[name] = bool(value)
        elif kind == "t":
            out[name] = pd.Timestamp(_time(value), unit="us")
        else:
            out[name] = value
    return out


def encode(spec: dict, record: dict) -> bytes:
    out = b""
    for number, (name, kind) in spec.items():
        value = record.get(name)
        if isinstance(kind, dict):
            if value is not None:
                body = encode(kind, value)
                out += _varint(number << 3 | 2) + _varint(len(body)) + body
            continue
        if not value and value != 0 or value == 0 and not isinstance(kind, list):
            continue
        chunk = lambda b, number=number: _varint(number << 3 | 2) + _varint(len(b)) + b
        if isinstance(kind, list):
            out += b"".join(chunk(encode(kind[0], v)) for v in value)
        elif kind in "iB":
            out += _varint(number << 3) + _varint(int(value))
        elif kind == "t":
            us = int(pd.Timestamp(value).value // 1000)
            out += chunk(b"\x08" + _varint(us // 1_000_000) + (b"\x10" + _varint(us % 1_000_000 * 1000) if us % 1_000_000 else b""))
        else:
            out += chunk(value.encode() if kind == "s" else value)
    return out


def checked(kind: str, data: bytes | None) -> dict | None:
    """The record; None for a null body. An empty body has no layout to check."""
    if data is None:
        return None
    got = decode(RECORDS[kind], data)
    if data and got["layout"] != LAYOUT:
        raise ValueError(f"{kind} record of layout {got['layout']}")
    return got


def decoder(kind: str):
    """A pandas function from a binary column to the record's struct."""
    from pyspark.sql.pandas.functions import pandas_udf

    names = [name for name, _ in RECORDS[kind].values()]

    @pandas_udf(ddl(RECORDS[kind]).replace("`: ", "` "))
    def f(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([checked(kind, b) or dict.fromkeys(names) for b in bodies], columns=names)

    return f


def encoder(kind: str):
    """A pandas function from a struct column to the record's bytes."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("binary")
    def f(rows: pd.DataFrame) -> pd.Series:

        def plain(v):
            """Rows and arrays as dicts and lists, however deep."""
            if hasattr(v, "asDict"):
                v = v.asDict()
            if isinstance(v, dict):
                return {k: plain(x) for k, x in v.items()}
            return [plain(x) for x in v] if hasattr(v, "__len__") and not isinstance(v, (str, bytes, bytearray)) else v

        return pd.Series([encode(RECORDS[kind], {k: plain(v) for k, v in r.items()}) for r in rows.to_dict("records")], dtype=object)

    return f
