"""Spreadsheet tables: a sheet is ``row_no, cells`` with row numbers from 1 and ragged cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a vocabulary table.
VOCAB = ("w", "Target_German", "Gender", "Native_Translation", "Hint_Disambiguation", "Theme_Context", "Example_Sentence", "Collocations", "Antonym", "Media", "Tags")


def parse_range(a1: str) -> tuple[int, int | None, int, int | None]:
    """First and last row and column (from 1) of a range as B2:D9, A:A or C4; open ends are None."""
    m = re.fullmatch(r"(?:.*!)?([A-Z]+)([0-9]*)(?::([A-Z]+)([0-9]*))?", a1)
    if not m:
        raise ValueError(f"not a range: {a1}")

    def number(letters: str) -> int:
        n = 0
        for c in letters:
            n = n * 26 + ord(c) - 64
        return n

    first, row, last, end = m.groups()
    if last is None:
        return int(row or 1), int(row) if row else None, number(first), number(first)
    return int(row or 1), int(end) if end else None, number(first), number(last)


def read_range(sheet: DataFrame, a1: str) -> DataFrame:
    """``row_no, cells`` of a range, rows in order."""
    top, bottom, left, right = parse_range(a1)
    rows = sheet.where(F.col("row_no") >= top)
    if bottom is not None:
        rows = rows.where(F.col("row_no") <= bottom)
    return rows.select("row_no", F.slice("cells", left, right - left + 1).alias("cells")).orderBy("row_no")


def read_cell(sheet: DataFrame, a1: str) -> Column | None:
    """The value of one cell, None where there is none."""
    found = read_range(sheet, a1).select(F.try_element_at("cells", F.lit(1)).alias("v")).first()
    return found["v"] if found else None


def read_batch(sheet: DataFrame, ranges: list[str]) -> DataFrame:
    """``range, row_no, cells`` of several ranges."""
    parts = [read_range(sheet, r).withColumn("range", F.lit(r)) for r in ranges]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("range", "row_no", "cells")


def padded(cells: Column, width: int) -> Column:
    return F.when(F.size(cells) >= width, cells).otherwise(F.concat(cells, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(width) - F.size(cells)))))


def entered(value, raw: bool = False) -> str:
    """What a cell holds: raw values as they are, entered ones as a sheet reads them (text after an apostrophe, TRUE and FALSE)."""
    if raw:
        return str(value)
    text = str(value)
    return text[1:] if text.startswith("'") else text.upper() if text.lower() in ("true", "false") else text


def write_range(sheet: DataFrame, a1: str, values: list[list[str]], raw: bool = False) -> DataFrame:
    """The sheet with cells of a range overwritten, rows appended where it ends before."""
    top, _, left, _ = parse_range(a1)
    spark = sheet.sparkSession
    new = spark.createDataFrame([(top + i, [entered(v, raw) for v in row]) for i, row in enumerate(values)], "row_no long, new array<string>")
    both = sheet.join(new, "row_no", "full_outer")
    before = padded(F.coalesce("cells", F.array().cast("array<string>")), left - 1)
    put = F.concat(F.slice(before, 1, left - 1) if left > 1 else F.array().cast("array<string>"), F.col("new"), F.slice(before, F.lit(left) + F.size("new"), F.greatest(F.size(before), F.lit(1))))
    return both.select("row_no", F.when(F.col("new").isNull(), F.col("cells")).otherwise(put).alias("cells"))


def write_batch(sheet: DataFrame, data: dict[str, list[list[str]]], raw: bool = False) -> DataFrame:
    """Several ranges overwritten, the later ones over the earlier."""
    for a1, values in data.items():
        sheet = write_range(sheet, a1, values, raw)
    return sheet


def append_rows(sheet: DataFrame, values: list[list[str]], raw: bool = False) -> DataFrame:
    """Rows put after the last one whose first cell holds something."""
    used = F.coalesce(F.try_element_at("cells", F.lit(1)), F.lit("")) != ""
    last = sheet.where(used).agg(F.coalesce(F.max("row_no"), F.lit(0)).alias("n")).first()["n"]
    return write_range(sheet, f"A{last + 1}", values, raw)


def write_verified(sheet: DataFrame, a1: str, values: list[list[str]], store=None, raw: bool = False) -> DataFrame:
    """Write, read back, compare the cells; a mismatch raises, the old stays.

    ``store`` writes the sheet and reads it back, and the comparison is of what it returns. Without
    it nothing is stored yet, and nothing is compared.
    """
    after = write_range(sheet, a1, values, raw)
    if store is None:
        return after
    after = store(after)
    top, _, left, _ = parse_range(a1)
    width = max(map(len, values), default=0)
    back = {r["row_no"]: r["cells"] for r in after.where(F.col("row_no").between(top, top + len(values) - 1)).select("row_no", F.slice("cells", left, max(1, width)).alias("cells")).collect()}
    for i, row in enumerate(values):  # as many rows as were given
        if (back.get(top + i) or [])[: len(row)] != [entered(v, raw) for v in row]:
            raise ValueError("write verification failed: the sheet read back differs; nothing was changed")
    return after


def vocab_rows(sheet: DataFrame) -> DataFrame:
    """A vocabulary sheet as columns: header row skipped, short rows padded."""
    cells = padded(F.col("cells"), len(VOCAB))
    body = sheet.where(~((F.col("row_no") == 1) & (F.try_element_at("cells", F.lit(1)) == "w")))
    return body.select("row_no", *(F.element_at(cells, i + 1).alias(name) for i, name in enumerate(VOCAB)))


def markdown_table(rows: DataFrame, order: str = "row_no", columns: tuple[str, ...] = VOCAB) -> DataFrame:
    """One row: the table as Markdown."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c, F.lit("")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join(["---"] * len(columns)) + " |"
    body = F.sort_array(F.collect_list(F.struct(order, line.alias("line"))))
    return rows.agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("markdown"))
