"""The result surface: filters, sort, views, pages and exports over contact records.

Each step is a frame-to-frame function; a request is their composition, one
lazy plan. Filters are a conjunction; absent or blank values filter nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlkit.functions.text import fold_accents

PER_PAGE = 25


def truthy(df: DataFrame, name: str) -> Column:
    """Non-empty list or text, non-zero number, true."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        found = F.size(c) > 0
    elif isinstance(kind, T.StringType):
        found = c != ""
    elif isinstance(kind, T.BooleanType):
        found = c
    elif isinstance(kind, T.NumericType):
        found = c != 0
    else:
        found = c.isNotNull()
    return F.coalesce(found, F.lit(False))


def condition(df: DataFrame, kind: str, name: str, value=None) -> Column | None:
    """One filter as a column; None where its value leaves it out."""
    c = F.col(name)
    if kind == "search":
        return F.coalesce(F.lower(c).contains(str(value).strip().lower()), F.lit(False)) if value and str(value).strip() else None
    if kind in ("min", "max"):
        return None if value is None else (c >= value if kind == "min" else c <= value)
    if kind == "any_of":
        return c.isin(*value) if value else None
    if kind == "equals":
        return None if value is None else c == value
    if value is False:
        return None  # a box that is not ticked
    table = {"is_true": lambda: c == True, "is_false": lambda: c == False, "is_null": c.isNull, "is_not_null": c.isNotNull, "truthy": lambda: truthy(df, name), "falsy": lambda: ~truthy(df, name)}  # noqa: E712
    return table[kind]()


def apply_filters(df: DataFrame, filters: list[tuple]) -> DataFrame:
    """Rows that pass all of ``filters``, each (kind, column) or (kind, column, value)."""
    found = [c for f in filters if (c := condition(df, *f)) is not None]
    return df.filter(reduce(lambda a, b: a & b, found)) if found else df


def apply_sort(df: DataFrame, sort: str | None = "domain", *tie: str) -> DataFrame:
    return df if sort in (None, "no_sort") else df.orderBy(F.asc_nulls_last(sort), *tie)


def joined(name: str, part: str = "value") -> Column:
    return F.array_join(F.transform(name, lambda x: x[part]), ", ").alias(name)


def overview(df: DataFrame) -> DataFrame:
    """Twelve columns, lists shown as text."""
    lists = "emails phones linkedins twitters instagrams facebooks youtubes githubs".split()
    return df.select("domain", "title", *map(joined, lists), joined("technologies", "name"), "error")


def email_list(df: DataFrame) -> DataFrame:
    """A row per address; sites without any are left out."""
    each = df.select("domain", F.explode("emails").alias("e"))
    return each.select("domain", F.col("e.value").alias("email"), F.col("e.is_likely_official").alias("is_likely_official"), F.array_join("e.sources", ", ").alias("sources"))


def expand(df: DataFrame, name: str, fields: dict[str, str], *keep: str) -> DataFrame:
    """A row per element of a list, its fields renamed by ``fields``."""
    each = df.select(*keep, F.explode(name).alias("_each"))
    return each.select(*keep, *(F.col(f"_each.{f}").alias(to) for f, to in fields.items()))


VIEWS = {"overview": overview, "email_list": email_list}


def apply_view(df: DataFrame, view: str | None, hidden: tuple[str, ...] = ()) -> DataFrame:
    """A named view, or all fields; hidden ones are dropped."""
    return (VIEWS[view](df) if view else df).drop(*hidden)


def page_count(rows: int, per_page: int = PER_PAGE) -> int:
    return -(-rows // per_page)


def apply_page(df: DataFrame, page: int, per_page: int = PER_PAGE, *order: str | Column) -> DataFrame:
    """The 1-based page; a page out of range is the first. Rows are numbered by ``order``, so pages are the same on every run."""
    total = page_count(df.count(), per_page)
    at = page if 1 <= page <= total else 1
    # the page's end bounds what is sorted: a top-k, not a sort of everything
    top = df.orderBy(*order).limit(at * per_page)
    place = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("_place", place).filter(F.col("_place") > (at - 1) * per_page).drop("_place")


def request(df: DataFrame, *, filters=(), sort=None, view=None, page=None, per_page: int = PER_PAGE, order: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Filter, sort, page, view. Pages are cut from the sorted rows; ``order`` settles ties and unsorted rows."""
    out = apply_filters(df, list(filters))
    by = [] if sort in (None, "no_sort") else [F.asc_nulls_last(sort)]
    if page is not None:
        out = apply_page(out, page, per_page, *by, *order)
    return apply_view(out.orderBy(*by, *order) if by else out, view)


def export_ready(df: DataFrame, english: bool = True) -> DataFrame:
    """Flat text columns for csv: lists joined, accents folded if asked."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            part = "value" if "value" in f.dataType.elementType.names else f.dataType.elementType.names[0]
            c = F.array_join(F.transform(c, lambda x: x[part]), ", ")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ", ")
        if english and isinstance(f.dataType, (T.StringType, T.ArrayType)):
            c = fold_accents(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def label(name: str) -> str:
    """A column's heading: its name in title case."""
    return " ".join(w[:1].upper() + w[1:] for w in name.replace("-", "_").split("_") if w)
