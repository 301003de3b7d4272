"""Functions of other SQL dialects as Spark columns."""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Iterable, Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Text


def insert(s: Column, at: int, n: int, new: Column) -> Column:
    """``n`` characters from ``at`` (from 1) give way to ``new``; outside the text nothing changes."""
    return F.when((F.lit(at) < 1) | (F.lit(at) > F.length(s)), s).otherwise(F.overlay(s, new, F.lit(at), F.lit(n)))


def field(x: Column, *values: str) -> Column:
    """The place of ``x`` among the values, 0 if it is none of them."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), x), F.lit(0)).cast("int")


def make_set(bits: Column, *names: str) -> Column:
    """The names whose bits are set."""
    return F.array_join(F.array(*[F.when(bits.bitwiseAND(1 << k) != 0, F.lit(n)) for k, n in enumerate(names)]), ",")


def quote(s: Column) -> Column:
    escaped = F.regexp_replace(s, r"(['\\])", r"\\$1")
    return F.coalesce(F.concat(F.lit("'"), escaped, F.lit("'")), F.lit("NULL"))


def octal(x: Column) -> Column:
    return F.conv(x.cast("string"), 10, 8)


def charindex(sub: str, s: Column) -> Column:
    return F.locate(sub, s)


def sounds_like(a: Column, b: Column) -> Column:
    return F.soundex(a) == F.soundex(b)


def similar_to(s: Column, pattern: str) -> Column:
    """SIMILAR TO: the whole text matches, ``%`` and ``_`` are wild."""
    out = "".join(".*" if c == "%" else "." if c == "_" else "\\" + c if c in ".^$\\" else c for c in pattern)
    return s.rlike(f"(?s)^(?:{out})$")


# Numbers


def truncate(x: Column, digits: int) -> Column:
    scaled = x * 10**digits
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / 10**digits


def gcd(a: Column, b: Column) -> Column:
    """Euclid by a fold over more steps than 64-bit numbers can need."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0)).otherwise((F.abs(a.cast("long") * b) / gcd(a, b)).cast("long"))


def xor(a: Column, b: Column) -> Column:
    return a.cast("boolean") != b.cast("boolean")


def greatest_or_null(*xs: Column) -> Column:
    """GREATEST where any null makes null."""
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, F.greatest(*xs))


# Dates

#: Fixed pairs of format letters.
FORMATS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H", "%h": "hh", "%I": "hh", "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%T": "HH:mm:ss", "%%": "'%'"}


def pattern(text: str) -> str:
    out, k = "", 0
    while k < len(text):
        if text[k] == "%" and text[k : k + 2] in FORMATS:
            out, k = out + FORMATS[text[k : k + 2]], k + 2
        else:
            out, k = out + (f"'{text[k]}'" if text[k].isalpha() else text[k]), k + 1
    return out


def mysql_date_format(t: Column, text: str) -> Column:
    return F.date_format(t, pattern(text))


def str_to_date(s: Column, text: str) -> Column:
    return F.to_timestamp(s, pattern(text))


def yearweek(t: Column) -> Column:
    """Year times 100 plus the ISO week."""
    return F.year(t) * 100 + F.weekofyear(t)


def makedate(year: Column, day: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 1)


def to_days(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date")) + 719528


def from_days(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (n - 719528).cast("int"))


def period_add(period: Column, months: Column) -> Column:
    n = F.floor(period / 100) * 12 + period % 100 - 1 + months
    return (F.floor(n / 12) * 100 + n % 12 + 1).cast("int")


def period_diff(a: Column, b: Column) -> Column:
    count = lambda p: F.floor(p / 100) * 12 + p % 100
    return (count(a) - count(b)).cast("int")


def sec_to_time(n: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60)


def time_to_sec(s: Column) -> Column:
    parts = F.split(s, ":")
    return parts[0].cast("long") * 3600 + parts[1].cast("long") * 60 + parts[2].cast("long")


def maketime(hour: Column, minute: Column, second: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", hour, minute, second)


def addtime(a: Column, b: Column) -> Column:
    """The sum of two times of day or durations, both as ``hh:mm:ss``."""
    return sec_to_time(time_to_sec(a) + time_to_sec(b))


def subtime(a: Column, b: Column) -> Column:
    """``a`` less ``b``; also TIMEDIFF. The result has a sign if it is negative."""
    n = time_to_sec(a) - time_to_sec(b)
    return F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), sec_to_time(F.abs(n)))


#: Fixed values of GET_FORMAT: the patterns of each kind and standard.
GET_FORMATS = {
    "DATE": {"EUR": "%d.%m.%Y", "INTERNAL": "%Y%m%d", "ISO": "%Y-%m-%d", "JIS": "%Y-%m-%d", "USA": "%m.%d.%Y"},
    "TIME": {"EUR": "%H.%i.%s", "INTERNAL": "%H%i%s", "ISO": "%H:%i:%s", "JIS": "%H:%i:%s", "USA": "%h:%i:%s %p"},
    "DATETIME": {"EUR": "%Y-%m-%d %H.%i.%s", "INTERNAL": "%Y%m%d%H%i%s", "ISO": "%Y-%m-%d %H:%i:%s", "JIS": "%Y-%m-%d %H:%i:%s", "USA": "%Y-%m-%d %H.%i.%s"},
}


def get_format(kind: str, standard: str) -> str:
    """The pattern of a standard for ``mysql_date_format``; TIMESTAMP is as DATETIME."""
    return GET_FORMATS["DATETIME" if kind.upper() == "TIMESTAMP" else kind.upper()][standard.upper()]


def curtime() -> Column:
    """The session's time of day, also CURRENT_TIME and LOCALTIME."""
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def utc_timestamp() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())


def utc_time() -> Column:
    return F.date_format(utc_timestamp(), "HH:mm:ss")


def date_bin(width: str, t: Column) -> Column:
    return F.window(t, width)["start"]


# Networks and identifiers


def inet_aton(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return F.when(is_ipv4(ip), sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0)))


def inet_ntoa(n: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(n.cast("long"), 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)])


def is_ipv4(s: Column) -> Column:
    return s.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.|$)){4}$") & ~s.endswith(".")


def is_ipv6(s: Column) -> Column:
    full = r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"
    short = r"^(?=.*::)(?!.*::.*::)(([0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{0,4})?::?(([0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})?$"
    return s.rlike(full) | s.rlike(short)


def inet6_aton(ip: Column) -> Column:
    """The bytes of an IPv4 or IPv6 address; null for other texts."""

    @F.pandas_udf("binary")
    def packed(part: pd.Series) -> pd.Series:
        return part.map(_packed)

    return packed(ip)


def _packed(ip: str | None) -> bytes | None:
    try:
        return ipaddress.ip_address(ip).packed if ip is not None else None
    except ValueError:
        return None


def inet6_ntoa(packed: Column) -> Column:
    """The address of 4 or 16 bytes in its shortest form; null for other lengths."""

    @F.pandas_udf("string")
    def spelt(part: pd.Series) -> pd.Series:
        return part.map(lambda b: str(ipaddress.ip_address(bytes(b))) if b is not None and len(b) in (4, 16) else None)

    return spelt(packed)


def uuid_short() -> Column:
    """Numbers that are distinct within a query."""
    return F.monotonically_increasing_id()


def token(*keys: Column) -> Column:
    """A key's place on the ring of 64-bit hashes, by which token ranges cut a table."""
    return F.xxhash64(*keys)


#: A key-value store's letters of the types, by how a type's name begins.
ATTRIBUTE_TYPES = {"string": "S", "binary": "B", "boolean": "BOOL", "array": "L", "map": "M", "struct": "M", "void": "NULL"}


def attribute_type(c: Column) -> Column:
    """The type's letters in a key-value store: NULL for a null, N for numbers; times are texts there."""
    kind = F.typeof(c)
    out = F.when(c.isNull(), "NULL")
    for begin, letters in ATTRIBUTE_TYPES.items():
        out = out.when(kind.startswith(begin), letters)
    return out.when(kind.startswith("date") | kind.startswith("timestamp"), "S").otherwise("N")


def is_uuid(s: Column) -> Column:
    return s.rlike(r"^\{?[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}\}?$")


def uuid_to_bin(s: Column) -> Column:
    return F.unhex(F.regexp_replace(s, "-", ""))


def bin_to_uuid(b: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(b)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


# JSON


def _steps(path: str) -> list[str | int]:
    out: list[str | int] = []
    for part in path.removeprefix("$").replace("[", ".[").split("."):
        if part:
            out.append(int(part[1:-1]) if part[0] == "[" else part)
    return out


def _edit(doc: Column, path: str, value: Column | str | None, insert_: bool, replace: bool) -> Column:
    """A text ``value`` is the same for all rows; edits of edits with such values are one call of one Python process."""
    steps, remove = _steps(path), value is None

    def edits(docs: pd.Series, values: Iterable[str | None]) -> pd.Series:
        def one(text, new):
            if text is None:
                return None
            root = now = json.loads(text)
            for step in steps[:-1]:
                if isinstance(step, str) and isinstance(now, dict) and step not in now and insert_:
                    now[step] = {}
                try:
                    now = now[step]
                except (KeyError, IndexError, TypeError):
                    return json.dumps(root, separators=(",", ":"), ensure_ascii=False)
            last = steps[-1]
            there = last in now if isinstance(now, dict) else isinstance(now, list) and isinstance(last, int) and last < len(now)
            if remove:
                if there:
                    del now[last]
            elif (there and replace) or (not there and insert_ and isinstance(now, dict)):
                now[last] = json.loads(new)
            elif not there and insert_ and isinstance(now, list):
                now.append(json.loads(new))
            return json.dumps(root, separators=(",", ":"), ensure_ascii=False)

        return pd.Series([one(t, v) for t, v in zip(docs, values)])

    @F.pandas_udf("string")
    def edited(docs: pd.Series) -> pd.Series:
        return edits(docs, repeat(value))

    @F.pandas_udf("string")
    def edited_by(docs: pd.Series, values: pd.Series) -> pd.Series:
        return edits(docs, values)

    return edited_by(doc, value) if isinstance(value, Column) else edited(doc)


def json_set(doc: Column, path: str, value: Column | str) -> Column:
    """``value`` is JSON text; it replaces what the path leads to or is added there."""
    return _edit(doc, path, value, True, True)


def json_insert(doc: Column, path: str, value: Column | str) -> Column:
    return _edit(doc, path, value, True, False)


def json_replace(doc: Column, path: str, value: Column | str) -> Column:
    return _edit(doc, path, value, False, True)


def json_remove(doc: Column, path: str) -> Column:
    return _edit(doc, path, None, False, False)


def _contains(a, b) -> bool:
    if isinstance(a, dict):
        return isinstance(b, dict) and all(k in a and _contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(_contains(x, y) for x in a) for y in (b if isinstance(b, list) else [b]))
    return type(a) is type(b) and a == b


def json_contains(doc: Column, part: Column) -> Column:
    """Whether the JSON text ``part`` is contained: objects by their keys, arrays by their elements, others by value."""

    @F.pandas_udf("boolean")
    def contained(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _contains(json.loads(x), json.loads(y)) for x, y in zip(xs, ys)], dtype="boolean")

    return contained(doc, part)


def _found(node, text: str, path: str) -> Iterator[str]:
    if isinstance(node, str) and node == text:
        yield path
    elif isinstance(node, dict):
        for k, x in node.items():
            yield from _found(x, text, f"{path}.{k}")
    elif isinstance(node, list):
        for k, x in enumerate(node):
            yield from _found(x, text, f"{path}[{k}]")


def json_search(doc: Column, text: str) -> Column:
    """The paths of all strings that equal ``text``, in the document's order."""

    @F.pandas_udf("array<string>")
    def searched(docs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else list(_found(json.loads(x), text, "$")) for x in docs])

    return searched(doc)


def _merged(a, b, patch: bool):
    if isinstance(a, dict) and isinstance(b, dict):
        out = dict(a)
        for k, v in b.items():
            if patch and v is None:
                out.pop(k, None)
            else:
                out[k] = _merged(out[k], v, patch) if k in out else (_merged({}, v, True) if patch and isinstance(v, dict) else v)
        return out
    if patch:
        return b if not isinstance(b, dict) else _merged({}, b, True)
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def json_merge(a: Column, b: Column, patch: bool = False) -> Column:
    """JSON_MERGE_PRESERVE, or with ``patch`` JSON_MERGE_PATCH."""

    @F.pandas_udf("string")
    def merged(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else json.dumps(_merged(json.loads(x), json.loads(y), patch), separators=(",", ":"), ensure_ascii=False) for x, y in zip(xs, ys)])

    return merged(a, b)


def json_depth(doc: Column) -> Column:
    @F.pandas_udf("int")
    def depth(part: pd.Series) -> pd.Series:
        def of(x) -> int:
            return 1 + max((of(y) for y in (x.values() if isinstance(x, dict) else x)), default=0) if isinstance(x, (dict, list)) else 1

        return pd.Series([None if x is None else of(json.loads(x)) for x in part], dtype="Int32")

    return depth(doc)


def json_pretty(doc: Column) -> Column:
    @F.pandas_udf("string")
    def pretty(part: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else json.dumps(json.loads(x), indent=2, ensure_ascii=False) for x in part])

    return pretty(doc)


# Unicode and geography


def normalize(s: Column, form: str = "NFC") -> Column:
    @F.pandas_udf("string")
    def normal(part: pd.Series) -> pd.Series:
        return part.str.normalize(form)

    return normal(s)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere; the same for equal differences in degrees."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))
