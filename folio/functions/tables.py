"""Cells, headers and renderings of extracted tables.

A table is `headers array<string>` with `rows array<array<string>>`, which keeps the
order of columns that a map would lose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Subjects looked for in captions.
CAPTION_TERMS = ["housing", "house", "price", "inflation", "interest", "rate", "credit", "loan", "mortgage", "gdp", "growth", "forecast", "employment", "wage", "debt", "income", "spending", "saving", "investment", "bank", "reserve", "cash", "financial", "economic", "market", "bond", "yield", "currency", "exchange", "dollar", "trade", "export", "import", "balance", "deficit"]

Cell = Column


def clean_cell(value: Cell) -> Column:
    """Null becomes empty; white space is trimmed and collapsed; NUL and replacement characters go."""
    v = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s\p{Z}]+", " ")), "^ | $", "")
    return F.translate(v, "\x00\ufffd", "")


def is_data_number(value: Cell) -> Column:
    """A decimal, a percentage or an integer below 100: data. Years and words are not."""
    digits = F.trim(F.translate(value, ".-%,+", ""))
    number = digits.rlike(r"^\d+$")
    small = F.length(F.regexp_replace(digits, "^0+", "")) <= 2
    return F.coalesce(number & (F.contains(value, F.lit(".")) | small), F.lit(False))


def is_number(value: Cell) -> Column:
    """Digits but for points, commas, signs and percent."""
    v = F.trim(value)
    return F.coalesce((v != "") & F.translate(v, ".-%,", "").rlike(r"^\d+$"), F.lit(False))


def has_numbers(rows: Column, share: float = 0.3) -> Column:
    """Whether at least this share of the cells of the first ten rows are numbers."""
    cells = F.flatten(F.slice(rows, 1, 10))
    return F.coalesce(F.size(F.filter(cells, is_number)) / F.nullif(F.size(cells), F.lit(0)) >= share, F.lit(False))


def header_place(grid: Column) -> Column:
    """The 1-based place of the header row: the last of the first four rows that reads like one; 0 if none does."""

    def header(row: Column) -> Column:
        trimmed = F.transform(row, lambda v: F.trim(F.coalesce(v, F.lit(""))))
        full = F.filter(trimmed, lambda v: v != "")
        text = F.size(F.filter(full, lambda v: ~is_data_number(v)))
        n, rest = F.size(full), F.size(row) - 1
        first = F.get(trimmed, F.lit(0)) == ""
        counts = F.struct(n.alias("n"), text.alias("text"), first.alias("first"), rest.alias("rest"))
        worded = lambda c: c["text"] >= F.greatest(F.lit(1.0), c["n"] * 0.7)
        return once(counts, lambda c: ((c["n"] >= (c["rest"] + 1) * 0.3) | (c["first"] & (c["n"] >= c["rest"] * 0.5))) & worded(c))

    marks = F.transform(F.slice(grid, 1, 4), lambda row, i: F.when(header(row), i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(marks), F.lit(0))


def column_names(row: Column) -> Column:
    """Names of columns from a header row: blanks are named by place, repeats numbered."""
    named = F.transform(row, lambda v, i: F.when(F.trim(v) != "", F.trim(v)).when(i == 0, F.lit("Item")).otherwise(F.concat(F.lit("Col_"), i.cast("string"))))

    def numbered(names: Column) -> Column:
        before = lambda v, i: F.size(F.filter(F.slice(names, F.lit(1), i), lambda w: w == v))
        return F.transform(names, lambda v, i: once(before(v, i), lambda n: F.when(n == 0, v).otherwise(F.concat(v, F.lit("_"), n.cast("string")))))

    return once(named, numbered)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value, which passes through a list of one, so that it is made once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_headers(grid: Column) -> Column:
    """struct(headers, rows) of a raw grid; without a header row columns are named by number."""
    numbers = F.transform(F.sequence(F.lit(0), F.size(F.get(grid, F.lit(0))) - 1), lambda i: i.cast("string"))

    def parted(place: Column) -> Column:
        return F.struct(
            F.when(place > 0, column_names(F.get(grid, place - 1))).otherwise(numbers).alias("headers"),
            F.slice(grid, place + 1, F.greatest(F.size(grid), F.lit(1))).alias("rows"),
        )

    return once(header_place(grid), parted)


def cut(value: Column, width: int) -> Column:
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width - 3), F.lit("..."))).otherwise(value)


def row_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown(headers: Column, rows: Column, caption: Column, width: int = 50) -> Column:
    """A table in Markdown, its cells trimmed and cut to a width."""
    titled = F.coalesce(F.length(caption), F.lit(0)) > 0
    intro = F.when(titled, F.concat(F.lit("Table: "), caption, F.lit("\n\n"))).otherwise(F.lit(""))
    top = row_line(F.transform(headers, lambda h: cut(h, width)))
    rule = row_line(F.transform(headers, lambda h: F.repeat(F.lit("-"), F.least(F.length(h), F.lit(width)))))
    body = F.transform(rows, lambda r: row_line(F.transform(headers, lambda h, i: cut(F.trim(F.coalesce(F.get(r, i), F.lit(""))), width))))
    table = F.array_join(F.concat(F.array(top, rule), body), "\n")
    none = F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, F.lit("(No data available)")).when(F.size(headers) < 1, F.lit("(No columns found)"))
    return F.concat(intro, F.coalesce(none, table))


def preview(headers: Column, rows: Column, most: int = 5) -> Column:
    """The first rows in columns of fixed width, each cut to 30 characters."""
    some = F.slice(rows, 1, most)
    cell = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
    widths = F.transform(headers, lambda h, i: F.greatest(F.length(h), F.coalesce(F.array_max(F.transform(some, lambda r: F.length(cell(r, i)))), F.lit(0))))
    pad = lambda v, i: F.substring(F.rpad(v, F.get(widths, i), F.lit(" ")), 1, 30)
    line = F.array_join(F.transform(headers, pad), " | ")
    body = F.transform(some, lambda r: F.concat(F.lit("  "), F.array_join(F.transform(headers, lambda h, i: pad(cell(r, i), i)), " | ")))
    more = F.when(F.size(rows) > most, F.concat(F.lit("\n  ... ("), (F.size(rows) - most).cast("string"), F.lit(" more rows)"))).otherwise(F.lit(""))
    rule = F.repeat(F.lit("-"), F.least(F.length(line), F.lit(120)))
    text = F.concat(F.lit("  "), line, F.lit("\n  "), rule, F.when(F.size(some) > 0, F.concat(F.lit("\n"), F.array_join(body, "\n"))).otherwise(F.lit("")), more)
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, F.lit("  (empty table)")).otherwise(text)


def semantic_text(headers: Column, rows: Column, caption: Column, page: Column, most: int = 20) -> Column:
    """A table as prose for retrieval: what it is about, its caption, and a line for each row."""
    title = F.trim(F.coalesce(caption, F.lit("")))
    terms = F.filter(F.array(*[F.lit(t) for t in CAPTION_TERMS]), lambda t: F.contains(F.lower(title), t))
    on = F.concat(F.lit(" (Page "), F.coalesce(page.cast("string"), F.lit("")), F.lit(")"))
    intro = (
        F.when(title == "", F.concat(F.lit("Table Data"), on))
        .when(F.size(terms) > 0, F.concat(F.lit("Table about "), F.array_join(F.slice(terms, 1, 5), ", "), on, F.lit("\nThis table contains data on: "), F.array_join(terms, ", "), F.lit("\n"), title))
        .otherwise(F.concat(F.lit("Financial/Economic Table"), on, F.lit("\n"), title))
    )
    cell = lambda r, i: F.trim(F.coalesce(F.get(r, i), F.lit("")))
    numeric = F.transform(headers, lambda h, i: F.exists(F.slice(rows, 1, 3), lambda r: F.coalesce(F.get(r, i), F.lit("")).rlike(r"[\p{Nd}%$]")))
    labels = F.filter(F.sequence(F.lit(0), F.size(headers) - 1), lambda i: ~F.get(numeric, i) & (F.length(F.get(headers, i)) > 3))
    label = F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit(0))
    values = F.filter(F.sequence(F.lit(0), F.size(headers) - 1), lambda i: F.when(F.size(labels) > 0, F.get(numeric, i) | (F.length(F.get(headers, i)) <= 3)).otherwise(i > 0))

    def line(r: Column) -> Column:
        shown = F.filter(values, lambda i: ~cell(r, i).isin("", "–", "—"))
        named = F.transform(
            shown,
            lambda i: F.concat(F.when(F.translate(F.trim(F.get(headers, i)), ".", "").rlike(r"^\d+$"), F.concat(F.lit("["), F.trim(F.get(headers, i)), F.lit("]"))).otherwise(F.trim(F.get(headers, i))), F.lit(": "), cell(r, i)),
        )
        name = cell(r, label)
        text = F.when(F.size(shown) > 0, F.concat(F.lit("  "), name, F.lit(" — "), F.array_join(named, ", "))).otherwise(F.concat(F.lit("  • "), name))
        return F.when(~name.isin("", "–", "—", "•"), text)

    lines = F.filter(F.transform(F.slice(rows, 1, most), line), lambda x: x.isNotNull())
    more = F.when(F.size(rows) > most, F.array(F.concat(F.lit("  ... ("), (F.size(rows) - most).cast("string"), F.lit(" more rows)")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, F.lit("")).otherwise(F.array_join(F.concat(F.array(intro), lines, more), "\n"))


def caption_line(text: Column) -> Column:
    """The first line of a block that reads like a caption, or null."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def caption(line: Column) -> Column:
        words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
        numbers = F.size(F.filter(words, lambda w: F.translate(w, ".,-%", "").rlike(r"^\d+$")))
        return F.startswith(F.lower(line), F.lit("table ")) | (F.size(words).between(2, 15) & (numbers / F.greatest(F.size(words), F.lit(1)) < 0.3))

    return F.get(F.filter(lines, caption), F.lit(0))


def as_variant(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Rows with the JSON of a column as VARIANT; null where it is none."""
    return rows.withColumn(name, F.try_parse_json(text)).drop(text) if name != text else rows.withColumn(name, F.try_parse_json(text))


def variant_columns(variant: str, paths: dict[str, tuple[str, str]]) -> list[Column]:
    """Columns of a VARIANT by path, each of its type; null where the path leads nowhere or to what has another type."""
    return [F.try_variant_get(variant, path, kind).alias(name) for name, (path, kind) in paths.items()]


def variant_map(variant: str) -> Column:
    """The top keys of a VARIANT object with their values; keys with a null value are among them."""
    return F.from_json(F.to_json(variant), "map<string, string>")
