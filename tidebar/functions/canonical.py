"""Canonical JSON of nested rows as column expressions: keys in order, no spaces, ASCII only, numbers in the fewest digits that give them back (of two such texts of 17 digits the runtime picks one). It is the text that a dump with sorted keys, the separators
"," and ":" and without NaN makes, byte for byte, so that hashes agree across systems.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType

#: The characters that have an escape of their own.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}
_PLAIN = r'^[\x20\x21\x23-\x5B\x5D-\x7E]*$'


def text(c: Column) -> Column:
    """A JSON string. Characters beyond ASCII are written as one or two UTF-16 units."""
    unit = lambda n: F.format_string("\\u%04x", n.cast("int"))

    def escaped(ch: Column) -> Column:
        point = F.ascii(ch)
        out = F.when((point >= 0x20) & (point < 0x7F), ch).when(point < 0x10000, unit(point))
        out = out.otherwise(F.concat(unit(0xD800 + F.floor((point - 0x10000) / 1024)), unit(0xDC00 + (point - 0x10000) % 1024)))
        for plain, escape in ESCAPES.items():
            out = F.when(ch == plain, escape).otherwise(out)
        return out

    whole = F.array_join(F.transform(F.split(c, ""), escaped), "")
    return F.concat(F.lit('"'), F.when(c.rlike(_PLAIN), c).otherwise(whole), F.lit('"'))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _mark(digits: Column, point: Column) -> Column:
    return F.struct(digits.alias("digits"), point.alias("point"))


def _read(shown: Column) -> Column:
    """Digits without zeros at either end, and where the point stands among them, of a double's text."""
    part = lambda k: F.regexp_extract(shown, r"^(\d+)\.(\d+)(?:E(-?\d+))?$", k)
    pieces = F.struct(F.concat(part(1), F.regexp_replace(part(2), "0+$", "")).alias("joined"), (F.length(part(1)) + F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))).alias("point"))

    def trimmed(x: Column) -> Column:
        digits = F.regexp_replace(x["joined"], "^0+", "")
        return _mark(F.regexp_replace(digits, "0+$", ""), x["point"] - F.length(x["joined"]) + F.length(digits))

    return _let(pieces, trimmed)


def _shorter(m: Column, size: Column, less: int) -> Column:
    """m with so many digits fewer, rounded, where that is read back as the same size; else null."""
    n = F.length(m["digits"]) - less
    cut = F.round(F.concat(F.substr(m["digits"], F.lit(1), n), F.lit("."), F.substr(m["digits"], n + 1)).cast("decimal(38,4)"), 0).cast("decimal(34,0)").cast("string")

    def tried(x: Column) -> Column:
        point = m["point"] + F.length(x) - n
        same = F.concat(F.lit("0."), x, F.lit("E"), point.cast("string")).cast("double") == size
        return F.when(same, _mark(F.regexp_replace(x, "0+$", ""), point))

    return F.when(n >= 1, _let(cut, tried))


def _written(m: Column) -> Column:
    digits, point = m["digits"], m["point"]
    size, e = F.length(digits), point - 1
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    fixed = F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits)).when(point >= size, F.concat(digits, zeros(point - size), F.lit(".0"))).otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    head = F.when(size > 1, F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(digits)
    power = F.abs(e).cast("string")
    wide = F.concat(head, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0")))
    return F.when((point <= -4) | (point > 16), wide).otherwise(fixed)


def number(c: Column) -> Column:
    """A double as the shortest decimal that is read back as it, with an exponent below 1e-4 and from 1e16 on; NaN and infinities are an error."""

    def shown(v: Column) -> Column:
        size = F.abs(v)
        # the runtime may print up to three digits too many
        marks = _let(_read(size.cast("string")), lambda m: F.coalesce(*(_shorter(m, size, less) for less in (3, 2, 1)), m))
        # the sign of a negative zero is in its text alone
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        bad = F.isnan(v) | (size == float("inf"))
        return F.when(bad, F.raise_error(F.lit("not a finite number")).cast("string")).when(v == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, _let(marks, _written)))

    return _let(c, shown)


def canonical(c: Column, kind: DataType) -> Column:
    """A value of any kind as canonical JSON; null is null. Keys of structs and maps are in order of their characters."""
    match kind:
        case StructType():
            parts = [F.concat(text(F.lit(f.name)), F.lit(":"), canonical(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
            out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        case ArrayType():
            out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
        case MapType(keyType=StringType()):
            entries = F.array_sort(F.map_entries(c))
            out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(text(e["key"]), F.lit(":"), canonical(e["value"], kind.valueType))), ","), F.lit("}"))
        case StringType():
            out = text(c)
        case BooleanType() | IntegralType():
            out = c.cast("string")
        case DoubleType() | FloatType():
            out = number(c.cast("double"))
        case _:
            raise TypeError(f"no JSON for {kind.simpleString()}")
    return F.when(c.isNull(), "null").otherwise(out)


def content_hash(c: Column, kind: StructType, own: str = "content_hash") -> Column:
    """sha256: of a row's canonical JSON without the field that holds the hash and those whose names begin with an underscore."""
    fields = [f for f in kind.fields if f.name != own and not f.name.startswith("_")]
    body = F.struct(*[c[f.name].alias(f.name) for f in fields])
    return F.concat(F.lit("sha256:"), F.sha2(canonical(body, StructType(fields)), 256))


def iso(seconds: Column) -> Column:
    """A time in epoch seconds as UTC, in ISO 8601 with its offset; whatever the session's zone."""
    day, second = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")), F.pmod(seconds, F.lit(86400))
    part = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), part(second / 3600), F.lit(":"), part(second % 3600 / 60), F.lit(":"), part(second % 60), F.lit("+00:00"))
