"""Publication guards: no key and no per-name field may reach a published aggregate."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelflow.schema import BANNED_ANYWHERE, BANNED_EXACT


def leaked_keys(keys: DataFrame, published: DataFrame, text: str, row_id: str) -> DataFrame:
    """Keys found double-quoted in published rows, with the number of rows holding each.

    A quoted key is the text between two neighbouring quote marks, so splitting a row at its
    quotes lists every candidate once and an equi-join replaces the comparison of all keys with
    all rows. Keys hold no quote mark (the key normaliser's input never does).
    """
    parts = F.split(F.col(text), '"')
    inner = F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))
    tokens = published.select(row_id, F.explode(inner).alias("key"))
    return (
        tokens.join(keys.select("key").distinct(), "key", "left_semi")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def offenders(leaks: DataFrame, n: int = 10) -> DataFrame:
    """First offenders for the failure report."""
    return leaks.orderBy("key").limit(n)


def _names(schema: T.DataType) -> Iterator[str]:
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            yield f.name
            yield from _names(f.dataType)
    elif isinstance(schema, T.ArrayType):
        yield from _names(schema.elementType)
    elif isinstance(schema, T.MapType):
        yield from _names(schema.valueType)


def banned_names(df: DataFrame) -> list[str]:
    """Field names of the published schema, at any depth, that may not be published."""
    return sorted(
        {n for n in _names(df.schema) if n in BANNED_EXACT or any(b in n for b in BANNED_ANYWHERE)}
    )


def banned_text(published: DataFrame, text: str) -> DataFrame:
    """Rows of published JSON in which each banned marker occurs."""
    markers = [f'"{n}"' for n in BANNED_EXACT] + list(BANNED_ANYWHERE)
    cells = [
        F.struct(F.lit(m).alias("marker"), F.count_if(F.contains(F.col(text), F.lit(m))).alias("n_rows")) for m in markers
    ]
    return published.agg(F.array(*cells).alias("_m")).select(F.inline("_m"))


def _leaves(path: Column, value: Column, kind: T.DataType) -> Column:
    """Array of (path, role, text, number) of one value; nested types are walked by their schema, lists and maps by their entries."""
    if isinstance(kind, T.StructType):
        parts = [_leaves(F.concat(path, F.lit(f".{f.name}")), value.getField(f.name), f.dataType) for f in kind.fields]
        return F.concat(*parts) if parts else F.array().cast(LEAVES)
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda v, i: _leaves(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), v, kind.elementType))
        return F.coalesce(F.flatten(each), F.array().cast(LEAVES))
    if isinstance(kind, T.MapType):
        def entry(e: Column) -> Column:
            key = e.getField("key").cast("string")
            return F.concat(_leaf(path, "key", key), _leaves(F.concat(path, F.lit("."), key), e.getField("value"), kind.valueType))
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), entry)), F.array().cast(LEAVES))
    if isinstance(kind, T.NumericType):
        return _leaf(path, "value", F.lit(None), value)
    return _leaf(path, "value", value)


LEAVES = "array<struct<path:string,role:string,text:string,number:double>>"


def _leaf(path: Column, role: str, text: Column, number: Column | None = None) -> Column:
    number = F.lit(None) if number is None else number
    return F.array(F.struct(
        path.alias("path"), F.lit(role).alias("role"), text.cast("string").alias("text"), number.cast("double").alias("number"))).cast(LEAVES)


def leaves(document: DataFrame) -> DataFrame:
    """Every value and every map key of nested rows, at any depth: (path, role, text, number).

    Numbers are in `number`, all else in `text`; a null value keeps its row. A null list or map has no entries.
    """
    parts = [_leaves(F.lit(f.name), F.col(f"`{f.name}`"), f.dataType) for f in document.schema.fields]
    return document.select(F.inline(F.concat(*parts)))


def leaked_leaves(keys: DataFrame, found: DataFrame) -> DataFrame:
    """Paths at which a key of the panel stands as a whole text or as a map key, with the number of places."""
    names = keys.select(F.col("key").cast("string").alias("text")).where("text <> ''").distinct()
    return found.join(names, "text", "left_semi").groupBy("path", "role", F.col("text").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def banned_keys(found: DataFrame) -> DataFrame:
    """Map keys that may not be published; they are data, so the schema does not show them."""
    named = F.col("text").isin(BANNED_EXACT) | F.greatest(*[F.contains("text", F.lit(b)) for b in BANNED_ANYWHERE])
    return found.where((F.col("role") == "key") & named).select("path", F.col("text").alias("key")).distinct()


def refuse_document(keys: DataFrame, document: DataFrame) -> None:
    """Hard stop before nested rows are published: names of the schema, map keys and values are looked at, at every level."""
    found = leaves(document)
    banned = banned_names(document) + [r["key"] for r in offenders(banned_keys(found)).collect()]
    refuse_leaks(leaked_leaves(keys, found).select("key").distinct(), banned)


def refuse_leaks(leaks: DataFrame, banned: list[str]) -> None:
    """Hard stop before a publication."""
    found = [r["key"] for r in offenders(leaks).collect()]
    if found or banned:
        raise ValueError(f"publication refused: keys {found}, fields {banned}")
