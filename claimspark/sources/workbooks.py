"""XLSX workbooks as a data source: a partition a sheet, sheets in the order of the workbook's own list.

`spark.read.format("workbook").load(path)` gives (file, sheet, position, row_no, cells) of every sheet, or of the first with .option("sheets", "first"), or of one by its name.
`.option("columns", "B,G")` reads these columns of the sheet only, in that order. `.option("census", "true")` gives (file, sheet, position, state, cell_range, n_rows) without reading cells: the range is what the
sheet itself states in front of them, and null where it states none.

Files are opened by pyarrow's file systems (local, HDFS, S3, GCS by the path's scheme). Of a file only the members that are needed are read, and a
sheet is parsed as a stream, row by row. Defined cases: cells that are left out are empty; numbers are as the file has them; of rich texts all parts count, hints of
pronunciation don't; a file without sheets has no rows; a path with a * stands for all that match.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from typing import IO, NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .shared import send_code

#: Name spaces of the format (fixed values).
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ROWS = "file string, sheet string, position int, row_no bigint, cells array<string>"
CENSUS = "file string, sheet string, position int, state string, cell_range string, n_rows bigint"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
#: Characters that XML can't hold.
BAD = re.compile(r"[^\x09\x0A\x0D\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")
#: Rows of a batch.
BATCH = 4096


class Sheet(NamedTuple):
    name: str
    position: int
    state: str
    member: str


def opened(path: str) -> IO[bytes]:
    if "://" in path or path.startswith("file:"):
        files, at = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    else:
        files, at = pa.fs.LocalFileSystem(), path
    return files.open_input_file(at)


def paths_of(path: str) -> list[str]:
    """The files under a folder, that match a pattern, or the file itself, in order."""
    whole = re.sub(r"^file:/+", "file:///", path)
    files, at = pa.fs.FileSystem.from_uri(whole) if "://" in whole else (pa.fs.LocalFileSystem(), whole)
    scheme = whole[: whole.index("://") + 3] if "://" in whole else ""
    name = lambda p: f"{scheme}{p}" if scheme else p
    top = at if "*" not in at else posixpath.dirname(at[: at.index("*")] + "x")
    info = files.get_file_info(top)
    if info.type == pa.fs.FileType.File:
        return [name(at)]
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = files.get_file_info(pa.fs.FileSelector(top, recursive=True))
    wanted = lambda p: fnmatch(p, at) if "*" in at else p.lower().endswith((".xlsx", ".xlsm"))
    return sorted(name(f.path) for f in found if f.type == pa.fs.FileType.File and wanted(f.path) and not posixpath.basename(f.path).startswith(("~$", ".")))


def sheets(z: zipfile.ZipFile) -> list[Sheet]:
    """The sheets that the workbook lists, in its order, with the member that holds each; without a list those that it holds, by their numbers."""
    if "xl/workbook.xml" not in z.namelist():
        found = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        return [Sheet(f"sheet{k}", i, "visible", member) for i, (k, member) in enumerate(found)]
    targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    listed = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{MAIN}sheets")
    member = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"xl/{t}")
    held = set(z.namelist())
    every = [Sheet(s.get("name", ""), i, s.get("state", "visible"), member(targets.get(s.get(f"{LINKED}id"), ""))) for i, s in enumerate(listed if listed is not None else ())]
    return [s for s in every if s.member in held]


def column_number(reference: str) -> int:
    """From 0: of A1 0, of AA7 26; -1 without letters."""
    n = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        n = 26 * n + ord(letter) - 64
    return n - 1


def text_of(item: ElementTree.Element) -> str:
    """The text of a shared or inline string: its own, or that of its runs."""
    return "".join(t.text or "" for e in item if e.tag in (f"{MAIN}t", f"{MAIN}r") for t in ([e] if e.tag == f"{MAIN}t" else e.findall(f"{MAIN}t")))


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{MAIN}si":
                out.append(text_of(e))
                e.clear()
    return out


def rows_of(z: zipfile.ZipFile, sheet: Sheet, columns: list[int] | None = None) -> Iterator[tuple[int, list[str]]]:
    """(row number from 0, cells) of the rows that the sheet holds, as a stream; what is between filled cells is empty."""
    shared, last = shared_strings(z), -1
    wanted = None if columns is None else {c: i for i, c in enumerate(columns)}
    with z.open(sheet.member) as f:
        top = None
        for event, row in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                top = row if row.tag == f"{MAIN}sheetData" else top
                continue
            if row.tag != f"{MAIN}row":
                continue
            last = int(row.get("r")) - 1 if row.get("r") else last + 1
            cells: list[str] = [] if columns is None else [""] * len(columns)
            at = -1
            for c in row.iter(f"{MAIN}c"):
                at = column_number(c.get("r")) if c.get("r") else at + 1
                if wanted is not None and at not in wanted:
                    continue
                kind, value = c.get("t"), c.findtext(f"{MAIN}v") or ""
                inline = c.find(f"{MAIN}is")
                said = (text_of(inline) if inline is not None else "") if kind == "inlineStr" else shared[int(value)] if kind == "s" else value
                if wanted is None:
                    cells += [""] * (at - len(cells))
                    cells.append(said)
                else:
                    cells[wanted[at]] = said
            yield last, cells
            top.clear()  # what was read


def stated_range(z: zipfile.ZipFile, sheet: Sheet) -> str | None:
    """What the sheet states in front of its cells; null if nothing."""
    with z.open(sheet.member) as f:
        for event, e in ElementTree.iterparse(f, ("start",)):
            if e.tag == f"{MAIN}dimension":
                return e.get("ref")
            if e.tag == f"{MAIN}sheetData" or event != "start":
                return None
    return None


def rows_in(cell_range: str | None) -> int | None:
    """Rows of a range such as A1:G20; of one cell 1."""
    if not cell_range or not (numbers := [int(n) for n in re.findall(r"[A-Z]+\$?([0-9]+)", cell_range.replace("$", ""))]):
        return None
    return numbers[-1] - numbers[0] + 1


class _SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: Sheet | None):
        super().__init__(None)
        self.path, self.sheet = path, sheet


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.census = options["path"], options.get("census", "false").lower() == "true"
        self.wanted = options.get("sheets", "all")
        names = options.get("columns")
        self.columns = [column_number(c.strip().upper()) for c in names.split(",")] if names else None

    def partitions(self) -> list[InputPartition]:
        """A partition a file for a census, else a sheet: the workbook's list is read, no cells."""
        if self.census:
            return [_SheetPartition(p, None) for p in paths_of(self.path)]
        out: list[InputPartition] = []
        for p in paths_of(self.path):
            with opened(p) as f, zipfile.ZipFile(f) as z:
                every = sheets(z)
            out += [_SheetPartition(p, s) for s in (every[:1] if self.wanted == "first" else every if self.wanted == "all" else [s for s in every if s.name == self.wanted])]
        return out

    def read(self, partition: _SheetPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no sheet is wanted
            return
        name = posixpath.basename(partition.path)
        with opened(partition.path) as f, zipfile.ZipFile(f) as z:
            if self.census:
                found = [(name, s.name, s.position, s.state, r := stated_range(z, s), rows_in(r)) for s in sheets(z)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()))], names=["file", "sheet", "position", "state", "cell_range", "n_rows"])
                return
            s, held = partition.sheet, []
            for row in rows_of(z, s, self.columns):
                held.append(row)
                if len(held) == BATCH:
                    yield self._batch(name, s, held)
                    held = []
            if held:
                yield self._batch(name, s, held)

    def _batch(self, name: str, s: Sheet, held: list) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([s.name] * n), pa.array([s.position] * n, pa.int32()), pa.array([i for i, _ in held], pa.int64()), pa.array([c for _, c in held], pa.list_(pa.string()))], names=["file", "sheet", "position", "row_no", "cells"])


def column_letters(n: int) -> str:
    """Of 0 A, of 26 AA."""
    out = ""
    while n >= 0:
        n, k = n // 26 - 1, n % 26
        out = chr(65 + k) + out
    return out


class _Book:
    """A workbook being written, sheet by sheet and row by row, with cells as inline strings."""

    def __init__(self, f: IO[bytes]):
        self.z, self.names, self.open = zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED), [], None

    def sheet(self, name: str, cell_range: str | None) -> None:
        self._end()
        self.names.append(name)
        self.open, self.n = self.z.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True), 0
        said = f'<dimension ref="{cell_range}"/>' if cell_range else ""
        self.open.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}">{said}<sheetData>'.encode())

    def row(self, cells: list[str | None]) -> None:
        self.n += 1
        said = "".join(f'<c r="{column_letters(i)}{self.n}" t="inlineStr"><is><t xml:space="preserve">{escape(BAD.sub("", c))}</t></is></c>' for i, c in enumerate(cells) if c is not None)
        self.open.write(f'<row r="{self.n}">{said}</row>'.encode())

    def _end(self) -> None:
        if self.open:
            self.open.write(b"</sheetData></worksheet>")
            self.open.close()
            self.open = None

    def close(self) -> None:
        self._end()
        head, listed = '<?xml version="1.0" encoding="UTF-8"?>', list(enumerate(self.names, 1))
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        self.z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINKED[1:-1]}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in listed) + "</sheets></workbook>")
        self.z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="r{i}" Type="{LINKED[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in listed) + "</Relationships>")
        self.z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{LINKED[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i, _ in listed) + "</Types>")
        self.z.close()


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """Rows (file, sheet, cell_range, cells), of which each file's stand together and in order, one sheet behind the other."""

    def __init__(self, path: str):
        self.path = re.sub(r"^file:/+", "/", path)

    def _files(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pa.fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Files are written aside, under names of their own, so that a task that is tried again is in nobody's way."""
        files, top = self._files()
        made, at, book, f = [], (None, None), None, None
        files.create_dir(f"{top}/_aside", recursive=True)
        for r in rows:
            if r["file"] != at[0]:
                if book:
                    book.close()
                    f.close()
                made.append((f"{top}/_aside/{uuid.uuid4().hex}", f"{top}/{r['file']}"))
                f = files.open_output_stream(made[-1][0])
                book, at = _Book(f), (r["file"], None)
            if r["sheet"] != at[1]:
                book.sheet(r["sheet"], r["cell_range"])
                at = (r["file"], r["sheet"])
            book.row(r["cells"])
        if book:
            book.close()
            f.close()
        return _Written(made)

    def commit(self, messages: list) -> None:
        files, top = self._files()
        for aside, final in (x for m in messages if m for x in m.files):
            files.move(aside, final)
        if files.get_file_info(f"{top}/_aside").type == pa.fs.FileType.Directory:
            files.delete_dir(f"{top}/_aside")

    def abort(self, messages: list) -> None:
        files, top = self._files()
        if files.get_file_info(f"{top}/_aside").type == pa.fs.FileType.Directory:
            files.delete_dir(f"{top}/_aside")


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CENSUS if self.options.get("census", "false").lower() == "true" else ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The data source, registered if it isn't yet."""
    send_code(spark)
    spark.dataSource.register(Workbooks)
    return spark.read.format("workbook").options(**options).load(path)


def census(spark: SparkSession, path: str) -> DataFrame:
    """Names, places, states and ranges of all sheets of all workbooks under the path."""
    return read(spark, path, census="true")


def write(rows: DataFrame, path: str, file: str, sheet: str, columns: list[str], order: list[str]) -> None:
    """rows as XLSX files under the path: a file for each value of `file`, in it a sheet for each of `sheet`, in the order of names, with a header row and the rows in order.

    Each sheet states its range. A workbook is written by one task, row by row; the format itself ends a sheet at 1,048,576 rows.
    """
    spark = rows.sparkSession
    send_code(spark)
    spark.dataSource.register(Workbooks)
    n = F.count("*").over(Window.partitionBy(file, sheet))
    area = F.concat(F.lit(f"A1:{column_letters(len(columns) - 1)}"), (n + 1).cast("string"))
    cells = rows.select(F.col(file).alias("file"), F.col(sheet).alias("sheet"), area.alias("cell_range"), F.array(*[F.col(c).cast("string") for c in columns]).alias("cells"), F.lit(1).alias("is_row"), F.struct(*order).alias("place"))
    heads = rows.groupBy(F.col(file).alias("file"), F.col(sheet).alias("sheet")).agg(F.count("*").alias("n"))
    heads = heads.select("file", "sheet", F.concat(F.lit(f"A1:{column_letters(len(columns) - 1)}"), (F.col("n") + 1).cast("string")).alias("cell_range"), F.array(*[F.lit(c) for c in columns]).alias("cells"), F.lit(0).alias("is_row"), F.lit(None).cast(cells.schema["place"].dataType).alias("place"))
    dealt = cells.unionByName(heads).repartition("file").sortWithinPartitions("file", "sheet", "is_row", "place")
    dealt.select("file", "sheet", "cell_range", "cells").write.format("workbook").mode("append").save(path)
