"""Guide tables in workbooks (.xlsx), read from their XML with the standard library; the sheets are small, the files may be many."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from ledgerlight.operators import guidance
from ledgerlight.operators.guidance import COLUMNS

# The variable and the file name of the workbook, and the places where it is looked for; the setting of a session goes first.
SETTING, VARIABLE = "spark.ledgerlight.guides", "SUBSCRIPTION_CANCELLATION_XLSX"
NAME = "subscription_cancellation_process.xlsx"
PLACES = (".", "~/Downloads")
HEADER_ROWS, SKIPPED_SHEET = 25, "index"
# A column of the table and the headers that stand for it; the process is the first that holds the last word.
HEADERS = {
    "Provider": ["provider"], "Market Position": ["market position", "2026 market share"], "Price Range": ["price range"], "Billing Cycle": ["billing cycle"],
    "Website": ["website"], "additional resources": ["additional resources", "perplexity cancellation process"],
}
PROCESS, PROCESS_WORD = "Cancellation Process", "cancellation"
SCHEMA = f"path string, sheet string, {guidance.SCHEMA}"


def database_path(spark) -> str | None:
    """The workbook that is set, else one in the usual places."""
    given = spark.conf.get(SETTING, None) or os.environ.get(VARIABLE)
    places = [given] if given else [os.path.join(os.path.expanduser(p), NAME) for p in PLACES]
    return given if given and "://" in given else next((p for p in places if os.path.exists(p)), None)


def header(value: str | None) -> str:
    return re.sub(r"\s+", " ", (value or "").strip().lower())


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


def _texts(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _local(t) == "t")


def sheets(content: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """Each sheet's title and rows of cell texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_texts(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"):
            link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(f"xl/{targets[link]}")).iter() if _local(e) == "row"):
                cells: list[str | None] = []
                for n, cell in enumerate(row):
                    letters = re.match(r"[A-Z]*", cell.get("r") or "")[0]
                    place = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1 if letters else n
                    value = next((v.text for v in cell if _local(v) == "v"), None)
                    kind = cell.get("t")
                    text = shared[int(value)] if kind == "s" and value else _texts(cell) if kind == "inlineStr" else value
                    cells += [None] * (place + 1 - len(cells))
                    cells[place] = text
                rows.append(cells)
            yield sheet.get("name"), rows


def table_rows(rows: list[list[str | None]]) -> Iterator[dict]:
    """The rows under the header of a sheet as columns of the table; none for a sheet without one."""
    for k, row in enumerate(rows[:HEADER_ROWS]):
        found = [header(c) for c in row]
        process = next((n for n, c in enumerate(found) if PROCESS_WORD in c), None)
        if HEADERS["Provider"][0] not in found or process is None:
            continue
        place = {PROCESS: process} | {column: next((found.index(h) for h in names if h in found), None) for column, names in HEADERS.items()}
        number = found.index("#") if "#" in found else None
        for cells in rows[k + 1 :]:
            at = lambda n: cells[n] if n is not None and n < len(cells) else None  # noqa: E731, B023
            digits = at(number) or ""
            yield {"#": int(float(digits)) if re.fullmatch(r"\d+(\.0)?", digits) else None} | {c: at(n) or "" for c, n in place.items()}
        return


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = [
            {"path": path, "sheet": title, **row}
            for path, content in zip(frame["path"], frame["content"], strict=True)
            for title, rows in sheets(bytes(content))
            if title.lower() != SKIPPED_SHEET
            for row in table_rows(rows)
        ]
        columns = ["path", "sheet", *COLUMNS]  # no module here: what runs on executors travels by value
        df = pd.DataFrame(out, columns=columns)
        df["#"] = df["#"].astype("Int64")
        yield df


def read(spark, path: str) -> DataFrame:
    """The rows of the guide tables of all workbooks under the path: path, sheet and the eight columns."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_read, SCHEMA)


def guides(spark, path: str) -> DataFrame:
    """The guides of workbooks; the category is the title of the sheet."""
    rows = read(spark, path)
    return guidance.from_table(rows, rows["sheet"])
