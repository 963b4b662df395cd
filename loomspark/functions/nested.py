"""Expressions made by a walk through a schema: the strings of a nested value, and its canonical JSON.

A walk gives one expression for the whole type, so what is nested in arrays, maps and structs is read in place: nothing is
exploded and no UDF runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FOUND = "array<struct<place:string,value:string>>"


def _none() -> Column:
    return F.array().cast(_FOUND)


def _below(name: str | Column, inner: Column) -> Column:
    """Places with a name in front."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.transform(inner, lambda x: F.struct(F.concat_ws(".", name, x["place"]).alias("place"), x["value"].alias("value")))


def _strings(value: Column, kind: T.DataType) -> Column | None:
    """What strings() gives, without a name in front; None where the type holds no string."""
    if isinstance(kind, T.StringType):
        # A string has no place of its own: concat_ws leaves a null out.
        return F.when(value.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("place"), value.alias("value"))))
    if isinstance(kind, T.StructType):
        parts = [(f.name, _strings(value.getField(f.name), f.dataType)) for f in kind.fields]
        parts = [F.coalesce(_below(n, p), _none()) for n, p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType):
        if _strings(value, kind.elementType) is None:
            return None
        each = F.transform(value, lambda x, i: F.coalesce(_below(i.cast("string"), _strings(x, kind.elementType)), _none()))
        return F.flatten(each)
    if isinstance(kind, T.MapType):
        entries = F.map_entries(value)
        keys, values = _strings(F.lit(None), kind.keyType), _strings(F.lit(None), kind.valueType)
        if keys is None and values is None:
            return None

        def both(e: Column, i: Column) -> Column:
            name = e["key"].cast("string") if isinstance(kind.keyType, T.AtomicType) else i.cast("string")
            own = [F.coalesce(_below(F.concat(F.lit("key "), name), _strings(e["key"], kind.keyType)), _none())] if keys is not None else []
            return F.concat(*own, *([F.coalesce(_below(name, _strings(e["value"], kind.valueType)), _none())] if values is not None else []))

        return F.flatten(F.transform(entries, both))
    return None


def strings(value: Column, kind: T.DataType, name: str) -> Column:
    """array<struct<place, value>>: every string of a value of a type, with the path to it below name; in the order of
    fields, indexes and map entries. Empty where there is none."""
    found = _strings(value, kind)
    return _none() if found is None else F.coalesce(_below(name, found), _none())


def _bound(x: Column, use) -> Column:
    """use(x), where x is computed once however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _digits(value: Column) -> Column:
    """struct<d, e>: the shortest digits of a positive double, and the power of ten of the first."""

    def parted(shown: Column) -> Column:
        mantissa = F.substring_index(shown, "E", 1)
        whole = F.substring_index(mantissa, ".", 1)
        every = F.concat(whole, F.substring_index(mantissa, ".", -1))
        power = F.coalesce(F.nullif(F.regexp_extract(shown, "E(.*)$", 1), F.lit("")).cast("int"), F.lit(0))
        d = F.rtrim(F.ltrim(every, F.lit("0")), F.lit("0"))
        return F.struct(d.alias("d"), (power + F.length(whole) - 1 - F.length(every) + F.length(F.ltrim(every, F.lit("0")))).alias("e"))

    def shorter(x: Column) -> Column:
        """One digit less, rounded down or up, where that still is the number: the JVM may write more than it takes."""
        down = F.substring(x["d"], F.lit(1), F.length(x["d"]) - 1)
        up = (down.try_cast("decimal(20,0)") + 1).cast("string")
        carried = x["e"] + F.length(up) - F.length(down)
        is_value = lambda d, e: F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, 2, 20), F.lit("E"), e.cast("string")).try_cast("double") == value
        of = lambda d, e: F.struct(F.rtrim(d, F.lit("0")).alias("d"), e.alias("e"))
        return F.when(F.length(x["d"]) < 16, x).when(is_value(down, x["e"]), of(down, x["e"])).when(is_value(up, carried), of(up, carried)).otherwise(x)

    return _bound(_bound(_bound(value.cast("string"), parted), shorter), shorter)


def number(value: Column) -> Column:
    """A double as JSON.stringify writes it: no `.0`, exponents from 1e21 up and below 1e-6, null for what is not finite."""

    def written(x: Column) -> Column:
        d, e, n = x["d"], x["e"], F.length(x["d"])
        power = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, 2, 20))).otherwise(""), F.lit("e"), F.when(e > 0, "+").otherwise(""), e.cast("string"))
        split = F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, n))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        return F.when((e >= 21) | (e < -6), power).when(e < 0, small).when(n <= e + 1, F.rpad(d, e + 1, F.lit("0"))).otherwise(split)

    plain = F.concat(F.when(value < 0, "-").otherwise(""), _bound(_digits(F.abs(value)), written))
    return F.when(F.isnan(value) | (F.abs(value) == math.inf), "null").when(value == 0, "0").otherwise(plain)


def text(value: Column) -> Column:
    """A string in quotes as JSON.stringify writes it: all but quotes, backslashes and control characters as it is."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(short))
    control = value.rlike(r"[\x00-\x1F\"\\]")
    return F.concat(F.lit('"'), F.when(control, out).otherwise(value), F.lit('"'))


def canonical(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a value of a type: keys sorted on every level, nulls kept, no white space, numbers and strings
    as JavaScript writes them. Map keys are written as text and sorted as such. Keys are sorted by code points (JavaScript
    sorts by UTF-16 units, which differs beyond U+FFFF only)."""
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        out = text(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number(value.cast("double"))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        out = value.cast("string")
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(text(F.lit(f.name)), F.lit(":"), canonical(value.getField(f.name), f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical(e["value"], kind.valueType).alias("v")))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(text(p["k"]), F.lit(":"), p["v"])), ","), F.lit("}"))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:  # dates, times, decimals: as text
        out = text(value.cast("string"))
    # concat_ws takes no notice of nulls, so a struct of none must be told.
    return F.when(value.isNull(), "null").otherwise(out)


def canonical_json(columns: dict[str, Column], schema: T.StructType) -> Column:
    """The canonical JSON of an object of columns, whose types the schema tells."""
    own = {f.name: f.dataType for f in schema.fields}
    parts = [F.concat(text(F.lit(k)), F.lit(":"), canonical(columns[k], own[k])) for k in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
