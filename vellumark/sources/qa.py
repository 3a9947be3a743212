"""Question and answer documents: csv, workbooks, markdown tables and archives of them, as rows for tables.qa_rows."""

from __future__ import annotations

import csv
import io
import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.errors import OUTCOME, SliceError, UnsupportedFormat
from vellumark.operators.kernels import is_separator
from vellumark.operators.rows import each_row
from vellumark.operators.tables import qa_rows
from vellumark.options import ParserLimits
from vellumark.sources.formats import _optional, decode, old_rows, package, sheets

Sheet = tuple[str, list[list[str]]]


def markdown_sheets(text: str, name: str) -> list[Sheet]:
    """`## ` names a sheet, pipe tables hold its rows; escapes of cells are undone."""
    out: list[Sheet] = []
    title = name
    for line in text.split("\n"):
        if line.startswith("## "):
            title = line[3:].strip()
        elif line.strip().startswith("|") and not is_separator(line):
            cells = [c.strip().replace("&#124;", "|").replace("<br>", "\n") for c in line.strip().strip("|").split("|")]
            if not out or out[-1][0] != title:
                out.append((title, []))
            out[-1][1].append(cells)
    return out


def read_sheets(content: bytes, name: str, limits: ParserLimits | None = None) -> list[Sheet]:
    limits, low = limits or ParserLimits(), name.lower()
    stem = posixpath.basename(name).rpartition(".")[0] or name
    if low.endswith(".csv"):
        return [(stem, list(csv.reader(io.StringIO(decode(content, limits), newline=""))))]
    if low.endswith((".xlsx", ".xlsm")):
        return [(stem if title == "Sheet1" else title, rows) for title, rows in sheets(content, limits)]
    if low.endswith((".xls", ".xlt")):
        return [(stem if s.name == "Sheet1" else s.name, old_rows(s)) for s in _optional("xlrd", name).open_workbook(file_contents=content, formatting_info=True).sheets()]
    if low.endswith((".md", ".markdown")):
        return markdown_sheets(decode(content, limits), stem)
    if low.endswith(".zip"):
        archive, out = package(content, limits), []
        for member in archive.namelist():
            if member.lower().endswith((".csv", ".xlsx", ".xls")) and not member.startswith("__MACOSX/"):
                try:
                    out += read_sheets(archive.read(member), posixpath.basename(member), limits)
                except SliceError:
                    continue
        return out
    raise UnsupportedFormat(f"no questions in {name}")


_ROWS = "rows array<struct<sheet:string,row_no:int,cells:array<string>>>"


def _read_column(name: Column, content: Column) -> Column:
    def run(n: str | None, c: bytes | None) -> tuple:
        try:
            found = read_sheets(c or b"", n or "")
            return True, None, None, None, [(f"{n}/{title}", k, list(row)) for title, own in found for k, row in enumerate(own)]
        except Exception as error:  # noqa: BLE001
            return False, type(error).__name__, getattr(error, "code", 500), str(error), None

    return each_row(run, f"{OUTCOME}, {_ROWS}", name, content)


def question_rows(documents: DataFrame) -> DataFrame:
    """documents (name, content) to name (`document/sheet`), row_no, title, content, problem_list; question_outcomes() tells which could not be read."""
    cells = documents.select(F.explode(_read_column(F.col("name"), F.col("content"))["rows"]).alias("r")).select(F.col("r.sheet").alias("name"), "r.row_no", "r.cells")
    return qa_rows(cells)


def question_outcomes(documents: DataFrame) -> DataFrame:
    """name, ok, error_type, error_code, error, n_rows of every document (name, content)."""
    read = documents.select("name", _read_column(F.col("name"), F.col("content")).alias("o"))
    return read.select("name", "o.ok", "o.error_type", "o.error_code", "o.error", F.size("o.rows").alias("n_rows"))
