"""Operators on grids (array<array<string>>), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.numbers import parse_number
from tablemill.functions.text import fold, let, slug, strip
from tablemill.sources import packs


def n_columns(grid: Column) -> Column:
    return F.coalesce(F.size(F.get(grid, F.lit(0))), F.lit(0))


def header_rows(grid: Column, most: int = 3) -> Column:
    """Leading rows that are not data: stops at a banner, a row with a number, or a sparse row below the first; 1 at least, 0 for no grid."""
    width = n_columns(grid)

    def step(state: Column, row: Column) -> Column:
        cells = F.filter(row, lambda c: strip(c) != "")
        n = F.size(cells)
        banner = (width > 1) & (n == width) & (F.size(F.array_distinct(cells)) == 1)
        data = F.exists(row, lambda c: parse_number(c).isNotNull()) & (n >= 2)
        sparse = (state["n"] >= 1) & (width >= 4) & (n <= 2)
        stop = state["stop"] | ((n > 0) & (banner | data | sparse))
        return F.struct(F.when(stop, state["n"]).otherwise(state["n"] + 1).alias("n"), stop.alias("stop"))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop"))
    found = F.aggregate(F.slice(grid, 1, most), start, step)["n"]
    return F.when(F.size(grid) > 0, F.greatest(found, F.lit(1))).otherwise(0)


def header_count(grid: Column, n_header: Column) -> Column:
    """Header rows as evidence and facts use them: one at least, one row of data left at least."""
    return F.greatest(F.lit(1), F.least(n_header, F.size(grid) - 1))


def _cell(row: Column, i: Column) -> Column:
    return F.coalesce(F.get(row, i), F.lit(""))


def column_tiers(grid: Column, n_header: Column) -> Column:
    """Per column the header's cells from above, repeats of the cell before left out, as one text."""

    def of(head: Column, c: Column) -> Column:
        cells = F.filter(F.transform(head, lambda r: strip(_cell(r, c))), lambda x: x != "")
        return let(cells, lambda own: F.array_join(F.filter(own, lambda x, i: (i == 0) | (x != F.get(own, i - 1))), " "))

    def tiers(head: Column, n: Column) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda c: of(head, c))).otherwise(F.array().cast("array<string>"))

    return let(grid, lambda g: let(F.slice(g, F.lit(1), F.greatest(n_header, F.lit(0))), lambda head: let(n_columns(g), lambda n: tiers(head, n))))


def flatten_header(grid: Column, n_header: Column) -> Column:
    """One name a column: the slug of its tiers, col_i without one; the second of a name gets _2, and so on."""

    def base(tiers: Column) -> Column:
        return F.transform(tiers, lambda t, i: let(slug(t), lambda s: F.when(s != "", s).otherwise(F.concat(F.lit("col_"), i.cast("string")))))

    return let(grid, lambda g: let(base(column_tiers(g, n_header)), number_repeats))


def number_repeats(names: Column) -> Column:
    def name(x: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda y: y == x))
        return F.when(before > 0, F.concat(x, F.lit("_"), (before + 1).cast("string"))).otherwise(x)

    return F.transform(names, name)


def header_text(grid: Column, n_header: Column) -> Column:
    return F.array_join(F.flatten(F.slice(grid, F.lit(1), n_header)), " ")


def column_headers(grid: Column, n_header: Column) -> Column:
    """Per column all header cells joined, as periods are read from."""
    head = F.slice(grid, F.lit(1), n_header)
    of = lambda c: F.array_join(F.transform(head, lambda r: _cell(r, c)), " ")
    return F.when(n_columns(grid) > 0, F.transform(F.sequence(F.lit(0), n_columns(grid) - 1), of)).otherwise(F.array().cast("array<string>"))


def body(grid: Column, n_header: Column) -> Column:
    return F.slice(grid, n_header + 1, F.greatest(F.size(grid), F.lit(1)))


def n_numeric_cells(grid: Column) -> Column:
    return F.size(F.filter(F.flatten(grid), lambda c: parse_number(c).isNotNull()))


def has_code_column(grid: Column, n_header: Column) -> Column:
    return F.contains(fold(header_text(grid, n_header)), F.lit("MA SO"))


def row_label(row: Column, code_column: Column | None = None) -> Column:
    """struct(label, label_col): the first of three cells that is text of three characters or more, not a number, not a line code."""
    cells = F.transform(F.slice(row, 1, 3), lambda c, i: F.struct(strip(c).alias("label"), i.alias("label_col")))

    def fits(x: Column) -> Column:
        ok = (F.length(x["label"]) >= 3) & parse_number(x["label"]).isNull() & ~x["label"].rlike(packs.LINE_CODE)
        return ok if code_column is None else ok & (x["label_col"] != code_column)

    return F.get(F.filter(cells, fits), F.lit(0))


def row_labels(grid: Column, n_header: Column, limit: int = 60) -> Column:
    """Labels of the data rows: the first of three cells with three characters or more that is not digits with separators."""
    plain = lambda c: F.regexp_replace(c, "[.,]", "")
    first = lambda r: F.get(F.filter(F.transform(F.slice(r, 1, 3), strip), lambda c: (F.length(c) >= 3) & ~plain(c).rlike(r"^\d+$")), F.lit(0))
    return F.slice(F.array_compact(F.transform(body(grid, n_header), first)), 1, limit)


def passage(ticker: Column, year: Column, stmt_type: Column, section: Column, unit_scale: Column, caption: Column, grid: Column, n_header: Column) -> Column:
    """The text that a table is found by: what it is, its unit, caption, header and row labels."""
    sections = F.create_map(*[F.lit(x) for kv in packs.SECTION_WORDS.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in packs.UNIT_WORDS.items() for x in kv])
    head = F.greatest(n_header, F.lit(1))
    header = F.array_join(F.filter(F.flatten(F.slice(grid, F.lit(1), head)), lambda c: strip(c) != ""), " ")
    word = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    first = F.concat_ws(" ", word(ticker), word(year), word(stmt_type), word(section), F.coalesce(F.try_element_at(sections, section), F.lit("")), F.coalesce(F.try_element_at(units, unit_scale), F.lit("")))
    return F.concat_ws("\n", first, word(caption), header, F.array_join(row_labels(grid, head), " ; "))


def code_column(grid: Column, n_header: Column, names: Column) -> Column:
    """The column of line codes, -1 if none: one whose name says so, else of the first four the one with most code-like cells (4 and 40 % of its cells at least)."""
    named = F.filter(F.transform(names, lambda x, i: F.when(F.contains(fold(F.translate(x, "_", " ")), F.lit("MA SO")), i)), lambda i: i.isNotNull())

    def count(c: Column) -> Column:
        cells = F.transform(body(grid, n_header), lambda r: strip(_cell(r, c)))
        hits = F.size(F.filter(cells, lambda v: v.rlike(packs.LINE_CODE)))
        enough = hits >= F.greatest(F.lit(4.0), 0.4 * F.size(F.filter(cells, lambda v: v != "")))
        return F.struct(F.when(enough, hits).otherwise(0).alias("hits"), (-c).alias("before"))

    first = F.sequence(F.lit(0), F.least(F.size(names), F.lit(4)) - 1)
    best = F.array_max(F.when(F.size(names) > 0, F.transform(first, count)))
    return F.coalesce(F.get(named, F.lit(0)), F.when(best["hits"] > 0, -best["before"]), F.lit(-1))


def numeric_columns(rows: Column, n_cols: Column) -> Column:
    """Indices of the columns with a cell, all of whose cells are numbers."""

    def all_numbers(c: Column) -> Column:
        cells = F.filter(F.transform(rows, lambda r: _cell(r, c)), lambda v: strip(v) != "")
        return (F.size(cells) > 0) & F.forall(cells, lambda v: parse_number(v).isNotNull())

    return F.when(n_cols > 0, F.filter(F.sequence(F.lit(0), n_cols - 1), all_numbers)).otherwise(F.array().cast("array<int>"))


def evidence_cell(cell: Column) -> Column:
    """A cell as evidence holds it: numbers as plain decimals, null marks as empty, other text unchanged."""
    number = parse_number(cell)
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    shown = F.when(whole, F.concat(number.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(number.cast("string"))
    return F.when(number.isNotNull(), shown).when(strip(cell).isin(*packs.NULL_CELLS), "").otherwise(cell)


def evidence_rows(grid: Column, n_header: Column) -> Column:
    """The data rows, each as long as the header, with every cell normalised for itself."""
    width = n_columns(grid)
    return F.transform(body(grid, n_header), lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda c: evidence_cell(_cell(r, c))))
