"""Names and paths: folding, validity, Windows spellings, base keys, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and characters that Windows reserves.
RESERVED_BASES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
RESERVED_CHARS = '<>:"/\\|?*'


def _upcase_pairs() -> tuple[str, str]:
    """Characters of the basic plane with a simple one-character upper case, and those: a rule, not a list.

    As on NTFS, a letter whose upper case is longer (sharp s), or in another plane, is left alone.
    """
    low = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) == 1 and chr(c).upper() != chr(c) and ord(chr(c).upper()) < 0x10000]
    return "".join(map(chr, range(97, 123))) + "".join(low), "".join(map(chr, range(65, 91))) + "".join(c.upper() for c in low)


def fold_key(name: Column) -> Column:
    """Upper case one character at a time; not upper(), which maps a sharp s to SS."""
    low, up = _upcase_pairs()
    return F.translate(name, low, up)


def fold_bytes(name: Column) -> Column:
    """The folded name as four big-endian bytes for each character, in hex: sorts by code point."""
    return F.hex(F.encode(fold_key(name), "UTF-32"))


def sync_key(path: Column, case_insensitive: bool = True) -> Column:
    return F.lower(path) if case_insensitive else path


def reserved(name: Column) -> Column:
    """Whether Windows refuses a name: empty, a control or reserved character, a final space or dot, a device's name."""
    odd = name.rlike(r'[\x00-\x1f<>:"/\\|?*]') | name.rlike(r"[ .]\z")
    return (name == "") | odd | F.upper(F.substring_index(name, ".", 1)).isin(*RESERVED_BASES)


def utf16_length(name: Column) -> Column:
    return (F.octet_length(F.encode(name, "UTF-16BE")) / 2).cast("long")


def too_long(name: Column, windows: bool) -> Column:
    return (utf16_length(name) if windows else F.octet_length(name)) > 255


def version_name_ok(name: Column) -> Column:
    """Letters, digits, dot, underscore, hyphen and space, up to 63, first a letter or digit, and not read as a time."""
    times = [F.try_to_timestamp(name, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss")]
    return name.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._ -]{0,62}\z") & F.coalesce(*times).isNull() & (name != "now")


def path_ok(path: Column) -> Column:
    """No component is empty, '.' or '..'; nothing is tidied."""
    return ~F.exists(F.split(F.regexp_replace(path, r"\A/", ""), "/"), lambda p: p.isin("", ".", ".."))


def app_key_ok(key: Column) -> Column:
    return key.rlike(r"\A[a-z0-9]+\.[A-Za-z0-9._-]+\z") & ~key.startswith("drive.")


def trash_cursor_ok(cursor: Column) -> Column:
    return (cursor == "") | cursor.rlike(r"\A[0-9]{19}-.+\z") | cursor.rlike(r"\A[0-9a-z]+\z")


def base_key(key: Column) -> Column:
    """A companion's key without its ending."""
    plain = F.regexp_replace(key, r"\.(metadata|lock|refs|version)\z", "")
    return F.when(plain != key, plain).when(key.contains(".ads."), F.regexp_extract(key, r"\A(.*)\.ads\.", 1)).otherwise(key)


def windows_shown(name: Column) -> Column:
    """Characters that Windows forbids, moved to the private area; a final space or dot likewise; private ones escaped."""
    escaped = F.regexp_replace(name, "([-])", "$1")
    forbidden = "".join(map(chr, range(1, 32))) + '<>:"\\|?*'
    moved = F.translate(escaped, forbidden, "".join(chr(0xF000 + ord(c)) for c in forbidden))
    return F.regexp_replace(F.regexp_replace(moved, r" \z", ""), r"\.\z", "")


def windows_stored(shown: Column) -> Column:
    """The inverse: a character after the escape stands for itself, another private one for the one it was moved from."""
    chars = F.split(shown, "")
    zero = F.struct(F.lit(False).alias("esc"), F.lit("").alias("out"))

    def step(acc, c):
        code = F.unhex(F.hex(F.encode(c, "UTF-16BE")))
        point = F.conv(F.hex(code), 16, 10).cast("int")
        back = F.when(acc["esc"], c).when((point > 0xF000) & (point < 0xF080), F.char(point - 0xF000)).otherwise(c)
        starts = ~acc["esc"] & (c == "")
        return F.struct(starts.alias("esc"), F.when(starts, acc["out"]).otherwise(F.concat(acc["out"], back)).alias("out"))

    return F.aggregate(chars, zero, step, lambda acc: acc["out"])


def windows_path(path: Column) -> Column:
    """windows_shown() on each component, joined by backslashes."""
    return F.array_join(F.transform(F.split(path, "/"), windows_shown), "\\")


def joined_path(root: Column, path: Column) -> Column:
    """path under root, without doubled or final slashes."""
    parts = F.filter(F.split(F.concat_ws("/", root, path), "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def stream_name(path: Column) -> Column:
    """(file, stream, refused) of a name with a stream after a colon; ::$DATA is the main one, other types are refused."""
    parts = F.split(F.substring_index(path, "\\", -1), ":")
    kind = F.coalesce(F.get(parts, F.lit(2)), F.lit("$DATA"))
    return F.struct(F.get(parts, F.lit(0)).alias("file"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("stream"), (F.upper(kind) != "$DATA").alias("refused"))


def uuid_time(key: Column) -> Column:
    """Creation time in a version-7 identifier, after an optional four-digit prefix; null for other versions."""
    digits = F.regexp_replace(F.regexp_replace(key, r"\A[0-9a-f]{4}-(?=[0-9a-f]{8}-)", ""), "-", "")
    ms = F.conv(F.substring(digits, 1, 12), 16, 10).cast("long")
    return F.when((F.length(digits) == 32) & (F.substring(digits, 13, 1) == "7"), F.timestamp_millis(ms).cast("timestamp_ntz"))


def trash_key(deleted_at: Column, entry: Column) -> Column:
    """Sorts newest first: the greatest number less the time in nanoseconds, on 19 digits, then the entry."""
    ns = F.unix_micros(deleted_at.cast("timestamp")) * 1000
    return F.concat(F.lpad((F.lit(9223372036854775807) - ns).cast("string"), 19, "0"), F.lit("-"), entry)


def filesystem_id(position: Column) -> Column:
    return F.lpad(F.lower(F.hex(position)), 4, "0")


def glob_regex(glob: str) -> str:
    """A path.Match pattern of one component as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 1)) > 0:
            out += "[" + glob[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += "\\" + glob[i] if not glob[i].isalnum() else glob[i]
        else:
            out += c if c.isalnum() or c in "_-" else "\\" + c
        i += 1
    return rf"\A{out}\z"


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether any component matches any pattern, both in lower case."""
    pattern = "|".join(glob_regex(g.lower()) for g in globs)
    return F.exists(F.split(F.lower(path), "/"), lambda p: p.rlike(pattern))
