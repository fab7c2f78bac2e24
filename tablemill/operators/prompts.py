"""What a planner model is shown, and what it may return: previews, prompts within a budget, and a guard over generated code."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import label_score, strip, tokens
from tablemill.plans.ir import is_benign

HEAD_ROWS, LABEL_COLUMNS = 8, 2


def pick_rows(rows: DataFrame, budget: int) -> DataFrame:
    """Of each (qid, table) rows (row, label, query): all if they fit, else the first eight and the best by label; order is by `row` as before."""
    from pyspark.sql import Window

    own = Window.partitionBy("qid", "table")
    s = rows.withColumns({"_n": F.count("*").over(own), "_s": label_score(tokens(F.col("query")), F.col("label"))})
    head = F.col("row") < HEAD_ROWS
    place = F.row_number().over(own.orderBy(F.desc(F.when(head, 2.0).otherwise(F.col("_s"))), "row"))
    return s.withColumn("_p", place).where((F.col("_n") <= budget) | (F.col("_p") <= budget)).drop("_n", "_s", "_p")


def pick_columns(columns: Column, years: Column, budget: int | Column) -> Column:
    """The label columns, then those that name a year, then the others, as many as the budget allows."""
    rest = F.slice(columns, LABEL_COLUMNS + 1, F.greatest(F.size(columns), F.lit(1)))
    named = F.filter(rest, lambda c: F.exists(years, lambda y: F.contains(c, y.cast("string"))))
    ordered = F.concat(F.slice(columns, 1, LABEL_COLUMNS), named, F.filter(rest, lambda c: ~F.array_contains(named, c)))
    most = budget if isinstance(budget, Column) else F.lit(budget)
    return F.when(F.size(columns) <= most, columns).otherwise(F.slice(ordered, F.lit(1), most))


def preview(columns: Column, rows: Column, n_rows: Column, cell_chars: int = 60) -> Column:
    """CSV text of the chosen rows with cells cut, and a note if rows were left out."""
    line = lambda r: F.array_join(F.transform(r, lambda c: F.left(c, F.lit(cell_chars))), ",")
    text = F.array_join(F.concat(F.array(line(columns)), F.transform(rows, line)), "\n")
    return F.concat(text, F.when(F.size(rows) < n_rows, F.concat(F.lit("\n... "), F.size(rows).cast("string"), F.lit(" of "), n_rows.cast("string"), F.lit(" rows"))).otherwise(""))


#: What a prompt calls each kind of unit.
UNITS = {"vnd": "VND", "usd": "USD", "percent": "phần trăm (%)", "pp": "điểm phần trăm", "times": "số lần", "year": "năm", "count": "số lượng", "shares": "số cổ phiếu"}
#: Rows of a table that are tried one after another, rows of the only table that is left at last, columns of a table, and characters of a cell.
ROWS, LAST_ROWS, COLUMNS, CELL_CHARS = (30, 20, 14), 10, 12, 60

Count = Callable[[list[str]], list[int]]


def inputs(ir: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, head, years, tables): what assemble() wants, of parsed questions and their evidence (qid, place, file, columns, rows), a few tables a question.

    Each distinct question and row label is scored where the table is, by the words of the question's search.
    """
    money = (F.col("unit_kind") == "vnd") & (F.col("unit_scale") != 1.0)
    names = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    unit = F.when(money, F.concat(F.lit("ĐƠN VỊ ĐÁP ÁN: VND, chia cho "), F.format_number("unit_scale", 0))).otherwise(F.concat(F.lit("ĐƠN VỊ ĐÁP ÁN: "), F.coalesce(F.try_element_at(names, F.col("unit_kind")), F.lit("-"))))
    listed = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(F.transform(xs, lambda x: x.cast("string")), ", ")))
    scope = F.when(F.col("stmt_type") == "separate", "PHẠM VI: báo cáo riêng").when(F.col("stmt_type").isNotNull(), "PHẠM VI: báo cáo hợp nhất")
    head = F.array_compact(F.array(F.concat(F.lit("CÂU HỎI: "), F.coalesce("question", F.lit(""))), F.lit(""), unit, listed("CÔNG TY: ", F.col("tickers")), listed("NĂM: ", F.col("years")), scope, F.lit("")))
    q = ir.select("qid", head.alias("head"), "years", tokens(F.col("retrieval_query")).alias("_qt"))
    label = lambda r: F.coalesce(F.get(F.filter(F.slice(r, 1, LABEL_COLUMNS), lambda c: c.rlike(r"\p{L}")), F.lit(0)), F.lit(""))
    own = evidence.join(q.select("qid", "_qt"), "qid").withColumn("scores", F.transform("rows", lambda r: label_score(F.col("_qt"), label(r))))
    tables = own.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "file", "columns", "rows", "scores"))).alias("tables"))
    return q.drop("_qt").join(tables, "qid", "left").withColumn("tables", F.coalesce("tables", F.expr("cast(array() as array<struct<place:int,file:string,columns:array<string>,rows:array<array<string>>,scores:array<double>>>)")))


def csv_line(cells: list[str | None]) -> str:
    """Cells cut to CELL_CHARS, quoted where they hold a comma, a quote or a line break."""
    cut = [(c or "")[:CELL_CHARS] for c in cells]
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in cut)


def chosen_columns(columns: list[str], years: list[int]) -> list[int]:
    """Numbers of the columns that a preview shows: the label columns, then those that name a year, then others, COLUMNS at most."""
    if len(columns) <= COLUMNS:
        return list(range(len(columns)))
    rest = range(LABEL_COLUMNS, len(columns))
    named = [i for i in rest if any(str(y) in columns[i] for y in years)]
    return [*range(LABEL_COLUMNS), *named, *(i for i in rest if i not in named)][:COLUMNS]


class Preview:
    """A table's lines, each counted once; `cost(n)` and `lines(n)` show the n rows that matter most."""

    def __init__(self, number: int, table: dict, years: list[int], count: Count):
        columns, rows, scores = table["columns"], table["rows"], table["scores"]
        own = chosen_columns(columns, years)
        cell = lambda r, i: r[i] if i < len(r) else ""
        self.name, self.n = f"df{number}", len(rows)
        self.top = [f"### {self.name}   ({table['file']})", "```csv", csv_line([columns[i] for i in own])]
        self.body = [csv_line([cell(r, i) for i in own]) for r in rows]
        hidden = [c for i, c in enumerate(columns) if i not in set(own)]
        self.end = ([f"… {len(hidden)} more columns: {', '.join(hidden)}"] if hidden else []) + ["```"]
        order = sorted(range(self.n), key=lambda i: (i >= HEAD_ROWS, i if i < HEAD_ROWS else -scores[i], i))
        self.place = [0] * self.n
        for k, i in enumerate(order):
            self.place[i] = k
        each = count(self.body)
        self.fixed, self.sums = sum(count(self.top + self.end)), [0]
        for i in order:
            self.sums.append(self.sums[-1] + each[i])
        notes = [self.note(n) for n in (*ROWS, LAST_ROWS) if n < self.n]
        self.notes = dict(zip((n for n in (*ROWS, LAST_ROWS) if n < self.n), count(notes))) if notes else {}

    def note(self, n: int) -> str:
        return f"… {n} of {self.n} rows; {self.name} holds all of them"

    def cost(self, n: int) -> int:
        return self.fixed + self.sums[min(n, self.n)] + self.notes.get(n, 0)

    def lines(self, n: int) -> list[str]:
        return [*self.top, *(line for line, k in zip(self.body, self.place) if k < n), *([self.note(n)] if n < self.n else []), *self.end]


def more_tables(left: int) -> str:
    return f"({left} more tables are left out and can't be used)"


def fit(head: list[str], tables: list[dict], years: list[int], count: Count, budget: int) -> tuple[str, int, int, int]:
    """(prompt, tables, rows, tokens): the first prompt within the budget, with fewer rows a table, then fewer tables, at last one table with LAST_ROWS rows.

    A prompt's size is the sum of its lines' sizes, so each line is counted once and every trial is a look at prefix sums.
    """
    shown = [Preview(i, t, years, count) for i, t in enumerate(tables, 1)]
    start, everything = sum(count(head)), len(shown)

    def sums(n: int) -> list[int]:
        out = [start]
        for p in shown:
            out.append(out[-1] + p.cost(n))
        return out

    def made(k: int, n: int, size: int) -> tuple[str, int, int, int]:
        lines = head + [x for p in shown[:k] for x in p.lines(n)] + ([more_tables(everything - k)] if k < everything else [])
        return "\n".join(lines), k, n, size

    for n in ROWS:
        if (size := sums(n)[-1]) <= budget:
            return made(everything, n, size)
    least = sums(ROWS[-1])
    left_out = count([more_tables(everything - k) for k in range(1, everything)]) if everything > 1 else []
    for k in range(everything - 1, 0, -1):
        if (size := least[k] + left_out[k - 1]) <= budget:
            return made(k, ROWS[-1], size)
    k = min(1, everything)
    return made(k, LAST_ROWS, sums(LAST_ROWS)[k] + (left_out[0] if everything > 1 else 0))


def assemble(rows: DataFrame, model: Callable[[], Count], budget: int) -> DataFrame:
    """(qid, prompt, n_tables, n_rows, size) of every question of inputs(), in one job; model makes a counter of lines' tokens, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = model()
        for b in batches:
            out = [(q, *fit(head, tables, years or [], count, budget)) for q, head, years, tables in zip(*(b.column(c).to_pylist() for c in ("qid", "head", "years", "tables")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["qid", "prompt", "n_tables", "n_rows", "size"])

    return rows.select(F.col("qid").cast("long").alias("qid"), "head", "years", "tables").mapInArrow(run, "qid long, prompt string, n_tables int, n_rows int, size long")


def fenced(answer: Column) -> Column:
    """The first fenced block of a model's answer, else all of it."""
    pattern = r"(?s)```(?:\w+)?\s*\n(.*?)```"
    return strip(F.when(answer.rlike(pattern), F.regexp_extract(answer, pattern, 1)).otherwise(answer))


@dataclass
class Checked:
    ok: bool
    code: str
    form: str
    reason: str | None = None
    literals: tuple = ()


def check_code(code: str | None, strict: bool = True) -> Checked:
    """Whether generated code reads its numbers instead of stating them, reduced to one expression if it is one.

    Only the syntax tree is looked at; nothing is run. Digits inside strings do not count.
    """
    code = (code or "").strip()
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return Checked(False, code, "unparsable", f"syntax: {e.msg}")
    if not tree.body:
        return Checked(False, code, "unparsable", "no code")
    numbers = [n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and type(n.value) in (int, float)]
    if stated := tuple(v for v in numbers if not is_benign(v)):
        return Checked(False, code, "expr", f"numbers stated in the code: {list(stated[:4])}", stated)
    match tree.body:
        case [ast.Expr(value=e)]:
            return Checked(True, ast.unparse(e), "expr")
        case [ast.Assign(targets=[ast.Name(id="result")], value=e)]:
            return Checked(True, ast.unparse(e), "assign")
    return Checked(not strict, code, "multi", "more than one statement" if strict else None)
