"""One canonical text per row.

``strict`` is injective. A value whose text cannot hold ``;`` (numbers, booleans, dates, timestamps,
hex of binary) is written as ``<text>;``, any other value as ``V<octets>:<text>``, a null as ``N;`` or
``N``. The other modes collide exactly where the engines they are named after do; use them only to
compare against such digests.

The expression is assembled as SQL text and parsed once: a wide table costs one call, not hundreds.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("strict", "pg", "mysql", "sqlite")

_PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _tagged(expr: str, dtype: T.DataType, names: count) -> list[str]:
    """Pieces of the injective form; kept apart so that a long text is copied once."""
    text = _text(expr, dtype, names)
    if isinstance(dtype, _PLAIN):
        return [f"coalesce({text}, 'N')", "';'"]
    return [f"coalesce(concat('V', octet_length({text}), ':'), 'N')", f"coalesce({text}, '')"]


def _text(expr: str, dtype: T.DataType, names: count) -> str:
    """Text of one value; null stays null. Members of nested values are tagged inside."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return expr
    if isinstance(dtype, T.BinaryType):
        return f"hex({expr})"
    if isinstance(dtype, T.TimestampType):
        return f"cast(unix_micros({expr}) AS string)"  # the instant itself, whatever the session's zone
    if isinstance(dtype, T.ArrayType):
        x = f"x{next(names)}"
        member = f"concat({', '.join(_tagged(x, dtype.elementType, names))})"
        return f"concat('[', array_join(transform({expr}, {x} -> {member}), ''), ']')"
    if isinstance(dtype, T.MapType):
        x = f"x{next(names)}"
        key = ", ".join(_tagged(f"{x}.key", dtype.keyType, names))
        value = ", ".join(_tagged(f"{x}.value", dtype.valueType, names))
        entries = f"array_sort(transform(map_entries({expr}), {x} -> concat({key}, {value})))"
        # entries are sorted as texts, so each needs its own length again
        y = f"x{next(names)}"
        return f"concat('{{', array_join(transform({entries}, {y} -> concat(octet_length({y}), ':', {y})), ''), '}}')"
    if isinstance(dtype, T.StructType):
        parts = [p for f in dtype.fields for p in _tagged(f"{expr}.{quoted(f.name)}", f.dataType, names)]
        return f"if({expr} IS NULL, NULL, concat('(', {', '.join(parts + [chr(39) + ')' + chr(39)])}))"
    return f"cast({expr} AS string)"


def _sqlite_quote(expr: str, dtype: T.DataType, names: count) -> str:
    text = _text(expr, dtype, names)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return f"coalesce({text}, 'NULL')"
    return f"coalesce(concat('\\'', replace({text}, '\\'', '\\'\\''), '\\''), 'NULL')"


def row_sql(schema: T.StructType, mode: str = "strict") -> str:
    """SQL text of the canonical row over the columns of ``schema``, in their order."""
    names = count()
    fields = [(quoted(f.name), f.dataType) for f in schema.fields]
    if mode == "strict":
        return f"concat({', '.join(p for c, t in fields for p in _tagged(c, t, names))})"
    if mode == "pg":
        return f"concat_ws('|', {', '.join(_text(c, t, names) for c, t in fields)})"
    if mode == "mysql":
        return f"concat_ws('|', {', '.join(f'coalesce({_text(c, t, names)}, {chr(39)}<NULL>{chr(39)})' for c, t in fields)})"
    if mode == "sqlite":
        return f"concat_ws(char(31), {', '.join(_sqlite_quote(c, t, names) for c, t in fields)})"
    raise ValueError(f"unknown mode {mode!r}; one of {MODES}")


def hashable_columns(schema: T.StructType) -> list[str]:
    """SQL of every column as a value one hash can take whole: nested values as their texts, in which
    inner nulls and borders are kept."""
    names = count()
    nested = (T.ArrayType, T.MapType, T.StructType)
    return [
        _text(quoted(f.name), f.dataType, names) if isinstance(f.dataType, nested) else quoted(f.name)
        for f in schema.fields
    ]


def _octets(expr: str, dtype: T.DataType, names: count) -> str | None:
    """Bytes of a value that can be cut: texts and binaries by their length, nested values by their members; None
    where every value of the type has one length."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        return f"coalesce(octet_length({expr}), 0)"
    if isinstance(dtype, T.ArrayType):
        x, a = f"x{next(names)}", f"a{next(names)}"
        inner = _octets(x, dtype.elementType, names)
        members = f" + coalesce(aggregate({expr}, 0L, ({a}, {x}) -> {a} + {inner}), 0L)" if inner else ""
        return f"(coalesce(size({expr}), 0){members})"
    if isinstance(dtype, T.MapType):
        keys = _octets(f"map_keys({expr})", T.ArrayType(dtype.keyType), names)
        return f"({keys} + {_octets(f'map_values({expr})', T.ArrayType(dtype.valueType), names)})"
    if isinstance(dtype, T.StructType):
        parts = [p for f in dtype.fields if (p := _octets(f"{expr}.{quoted(f.name)}", f.dataType, names))]
        return f"({' + '.join(parts)})" if parts else None
    return None


def octets_sql(schema: T.StructType) -> str:
    """SQL of a row's witness: how many bytes (members, for arrays) its values of varying length have."""
    names = count()
    parts = [p for f in schema.fields if (p := _octets(quoted(f.name), f.dataType, names))]
    return f"cast({' + '.join(parts)} AS bigint)" if parts else "0L"


def canonical_row(df: DataFrame, mode: str = "strict") -> Column:
    """Every column of ``df`` as one string column over it."""
    return F.expr(row_sql(df.schema, mode))


def row_separator(mode: str) -> str:
    return "\x1e" if mode == "sqlite" else "\n"
