"""Other scalars: times, content types, part sizes, modes, text differences, POSIX access lists."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"
# Content types by ending.
CONTENT_TYPES = {"html": "text/html", "htm": "text/html", "txt": "text/plain", "css": "text/css", "js": "text/javascript", "json": "application/json", "xml": "text/xml", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "zip": "application/zip", "com": "application/octet-stream"}
TYPE_NAMES = {0: "file", 1: "dir", 2: "symlink", 3: "fifo", 4: "char-device", 5: "block-device", 6: "socket"}
FILETIME_EPOCH_S = 11644473600


def as_of_moment(text: Column) -> Column:
    """A time as people write it; a bare date means the end of that day: a microsecond before the next."""
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    end = F.timestamp_micros(F.unix_micros(day) + 86_400_000_000 - 1)
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm")
    return F.coalesce(F.when(text.rlike(r"\A\d{4}-\d\d-\d\d\z"), end), *[F.try_to_timestamp(text, F.lit(f)) for f in forms]).cast(NTZ)


def from_filetime(ticks: Column) -> Column:
    """Hundreds of nanoseconds since 1601."""
    since_1970 = ticks - F.lit(FILETIME_EPOCH_S * 10_000_000)  # first, so that the division is of a number that a double holds
    return F.timestamp_micros(F.floor(since_1970 / 10).cast("bigint")).cast(NTZ)


def to_filetime(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) + FILETIME_EPOCH_S * 1_000_000) * 10


def content_type(recorded: Column, name: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"\.([^./]+)\z", 1))
    table = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.when(recorded != "", recorded), F.element_at(table, ending), F.lit("application/octet-stream"))


def part_size(size: Column, least: int = 8 << 20, most_parts: int = 10_000, cap: int = 5 << 30) -> Column:
    """The least size doubled until the parts are few enough, at most cap."""
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / F.lit(least * most_parts)) - 1e-12))
    return F.least(F.lit(least) * F.pow(F.lit(2), doublings), F.lit(cap)).cast("bigint")


def relatime_due(atime: Column, mtime: Column, ctime: Column, now: Column) -> Column:
    old = F.unix_micros(now.cast("timestamp")) - F.unix_micros(atime.cast("timestamp")) >= 86_400_000_000
    return atime.isNull() | (atime <= mtime) | (atime <= ctime) | old


def mode_of_readonly(readonly: Column) -> Column:
    return F.when(readonly, 0o444).otherwise(0o644)


def dacl_of_mode(mode: Column) -> Column:
    """full, read or empty for everyone, by the owner's write bit and any read bit."""
    return F.when(mode.bitwiseAND(F.lit(0o200)) != 0, "full").when(mode.bitwiseAND(F.lit(0o444)) != 0, "read").otherwise("empty")


def type_name(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv]), code), F.lit("unknown"))


def unified_diff(context: int = 3):
    """A pandas function (old, new) -> difference, null where either side holds a NUL. Pairs are small next to the rows."""
    import difflib

    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        def one(a, b):
            if a is None or b is None or "\0" in a or "\0" in b:
                return None
            return "".join(difflib.unified_diff(a.splitlines(True), b.splitlines(True), "old", "new", n=context))

        return pd.Series([one(a, b) for a, b in zip(old, new)], dtype=object)

    return diff


def encode_posix_acl(entries: list[tuple[int, int, int]]) -> bytes:
    """Version 2 records of (tag, permissions, id), little-endian, sorted."""
    return struct.pack("<I", 2) + b"".join(struct.pack("<HHI", *e) for e in sorted(entries))


def decode_posix_acl(data: bytes) -> list[tuple[int, int, int]] | None:
    if len(data) < 4 or (len(data) - 4) % 8 or struct.unpack_from("<I", data)[0] != 2:
        return None
    return [struct.unpack_from("<HHI", data, i) for i in range(4, len(data), 8)]


def inode():
    """A pandas function: xxHash64 with seed 0 of a text, as a signed number."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("long")
    def f(keys: pd.Series) -> pd.Series:
        import xxhash

        signed = lambda h: h - (1 << 64) if h >> 63 else h
        return keys.map(lambda k: None if k is None else signed(xxhash.xxh64_intdigest(k)))

    return f


def gated(layout: Column, value: Column, known: int = 1) -> Column:
    """value where a record's layout is known; any other layout raises an error rather than being read."""
    return F.when(layout == known, value).otherwise(F.raise_error(F.concat(F.lit("unknown layout "), layout.cast("string"))))
