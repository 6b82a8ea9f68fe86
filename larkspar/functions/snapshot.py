"""Access to nested snapshot documents held as VARIANT columns.

A path has three states: absent, present with null, present with a value.  VARIANT keeps
them apart: an absent path extracts to SQL NULL, a null to a variant null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """JSON text to VARIANT; malformed text gives NULL."""
    return F.try_parse_json(text)


class Cells:
    """Stands for a document while columns are built: each path and type becomes one column.

    A projection reads many paths several times.  Built over Cells it refers to columns that
    :meth:`read` adds first, so a document is searched once for each path.
    """

    def __init__(self, doc: str):
        self.doc, self.names = doc, {}

    def cell(self, path: str, kind: str) -> Column:
        return F.col(self.names.setdefault((path, kind), f"__cell{len(self.names)}"))

    def read(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[F.try_variant_get(F.col(self.doc), "$." + path, kind).alias(name) for (path, kind), name in self.names.items()])

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.names.values())


def add(df: DataFrame, doc: str, name: str, build: Callable[[Cells], Column]) -> DataFrame:
    """Adds the column that ``build`` makes of the document column ``doc``."""
    cells = Cells(doc)
    column = build(cells)
    return cells.drop(cells.read(df).withColumn(name, column))


def get(doc: Column | Cells, path: str, kind: str) -> Column:
    return doc.cell(path, kind) if isinstance(doc, Cells) else F.try_variant_get(doc, "$." + path, kind)


def node(doc: Column, path: str) -> Column:
    """The variant at a dotted path; SQL NULL if absent."""
    return get(doc, path, "variant")


def present(doc: Column, path: str) -> Column:
    """Whether the path exists, be its value null or not."""
    return node(doc, path).isNotNull()


def text(doc: Column, path: str) -> Column:
    return get(doc, path, "string")


def number(doc: Column, path: str) -> Column:
    return to_float(text(doc, path))


def dig(doc: Column, *paths: str) -> Column:
    """First path with a value other than null, as text."""
    return F.coalesce(*[text(doc, p) for p in paths])


def is_object(doc: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(node(doc, path)).startswith("OBJECT"), F.lit(False))


def is_list(doc: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(node(doc, path)).startswith("ARRAY"), F.lit(False))


def truthy(doc: Column, path: str) -> Column:
    """Whether the value counts as true: not absent, null, false, zero, or empty text, list or object."""
    value = text(doc, path)
    return F.coalesce(~value.isin("false", "0", "0.0", "-0.0", "", "[]", "{}"), F.lit(False))


def any_true(doc: Column, *paths: str) -> Column:
    """Falls through on every false value: true if any path is true."""
    out = F.lit(False)
    for p in paths:
        out = out | truthy(doc, p)
    return out


def first_non_null(doc: Column, *paths: str) -> Column:
    """Falls through on absent and null only: the truth of the first path that has a value."""
    return F.coalesce(*[F.when(text(doc, p).isNotNull(), truthy(doc, p)) for p in paths], F.lit(False))


def to_float(value: Column, default: float | None = None) -> Column:
    """Number of a text, or the default; true and false count as 1 and 0.

    A cast reads all numbers, but also suffixes such as '1d' and hexadecimal floats, which are no numbers here.
    """
    v = F.lower(F.trim(value.cast("string")))
    last = F.right(v, F.lit(1))
    odd = (last == "d") | (last == "f") & ~v.endswith("inf") | v.contains("x")
    parsed = F.coalesce(F.when(~odd, v.try_cast("double")), F.when(v == "true", 1.0).when(v == "false", 0.0))
    return F.coalesce(parsed, F.lit(default)) if default is not None else parsed


def to_int(value: Column, default: int = 0) -> Column:
    """Number rounded half to even, or the default."""
    x = to_float(value)
    return F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < 9e18), F.bround(x).cast("long")), F.lit(default).cast("long"))


def finite(value: Column, default: float) -> Column:
    x = to_float(value)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def int_text(value: Column) -> Column:
    """int() of a text: '3.7' is no integer and gives NULL; a number is truncated by the caller."""
    return value.try_cast("long")
