"""Reading files: text tables of unsure encoding, sheets as cells, documents with digests."""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spooled

#: Tokens that mean no value, as tables export them.
NA_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>", "n/a", "#N/A")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, valid (UTF-8), place (order within a file) and line (as the bytes stand there) of text files, read once; files are split."""
    lines = spark.read.option("ignoreCorruptFiles", "true").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    read = lines.select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("valid"), place.alias("place"), F.col("value").cast("binary").alias("line"))
    return spooled(read, "lines")


def decoded(line: Column, valid: Column) -> Column:
    """As UTF-8 or Latin-1; a byte-order mark is no text."""
    text = F.when(valid, F.decode(line, "UTF-8")).otherwise(F.decode(line, "ISO-8859-1"))
    return F.when(F.startswith(text, F.lit("\ufeff")), F.substr(text, F.lit(2))).otherwise(text)


def text_files(lines: DataFrame) -> DataFrame:
    """path, valid, first (place of the header), header of each file of ``text_lines``. A file is UTF-8 if all its lines are."""
    files = lines.groupBy("path").agg(F.bool_and("valid").alias("valid"), F.min("place").alias("first"), F.min_by("line", "place").alias("header"))
    return files.withColumn("header", decoded(F.col("header"), F.col("valid")))


def header_names(header: str) -> list[str]:
    """Column names of a header line; a blank one is named by its place, a repeated one gets its place as a suffix."""
    names: list[str] = []
    for k, name in enumerate(next(csv.reader([header]), [])):
        name = name or f"_c{k}"
        names.append(name if name not in names else f"{name}{k}")
    return names


def read_text_table(spark: SparkSession, path: str, na_tokens: tuple[str, ...] = (), multi_line: bool = False) -> DataFrame:
    """All columns as text with source_file. Files whose lines are all valid UTF-8 are read so (a byte-order mark is dropped), others as
    Latin-1; lines whose fields don't match the file's header are left out. Every file is read once and may be split; columns of files
    with other headers are null. Only headers reach the driver, each different one once. ``multi_line`` allows line ends inside
    quotes, at the price of a task for each file and a second read. A folder without files has no column but source_file."""
    if multi_line:
        return _blank(_read_whole_files(spark, path), na_tokens)
    lines = text_lines(spark, path)
    files = spooled(text_files(lines), "files")
    rows = lines.drop("valid").join(files, "path").where(F.col("place") != F.col("first"))
    rows = rows.select("header", F.element_at(F.split("path", "/"), -1).alias("file"), decoded(F.col("line"), F.col("valid")).alias("line")).where(F.trim("line") != "")
    parts = []
    for header in sorted(r["header"] for r in files.select("header").distinct().collect()):
        names = header_names(header)
        bad = "_bad"
        while bad in names:
            bad += "_"
        fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, bad])
        row = F.from_csv("line", F.lit(fields), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "escape": '"'})
        part = rows.where(F.col("header") == header).select(row.alias("row"), "file").where(F.col("row")[bad].isNull())
        parts.append(part.select(*(F.col("row")[n].alias(n) for n in names), F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("source_file")))
    if not parts:
        return spark.createDataFrame([], "source_file string")
    return _blank(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), na_tokens)


def _blank(df: DataFrame, na_tokens: tuple[str, ...]) -> DataFrame:
    return blank_na(df, na_tokens) if na_tokens else df


def _read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Each group of files (UTF-8, Latin-1) as one scan by Spark's own reader."""
    files = spooled(text_files(text_lines(spark, path)).select("valid", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path")), "files")
    parts = []
    for valid, name in ((True, "UTF-8"), (False, "ISO-8859-1")):
        if not (where := sorted(r["path"] for r in files.where(F.col("valid") == valid).collect())):
            continue
        df = spark.read.csv(where, header=True, inferSchema=False, mode="DROPMALFORMED", encoding=name, multiLine=True, escape='"')
        df = df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")})
        parts.append(df.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], "source_file string")


def file_columns(spark: SparkSession, path: str) -> DataFrame:
    """folder, source_file, position, column_name: the headers of text files, parsed where they are read."""

    @F.pandas_udf("array<string>")
    def names(headers: pd.Series) -> pd.Series:
        return headers.map(header_names)

    files = text_files(text_lines(spark, path))
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("source_file"), F.posexplode(names("header")).alias("position", "column_name"))


def blank_na(df: DataFrame, tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """Text cells that are one of ``tokens`` become null."""
    return df.select(*(F.when(~F.trim(F.col(f"`{n}`")).isin(*tokens), F.col(f"`{n}`")).alias(n) if k == "string" else F.col(f"`{n}`") for n, k in df.dtypes))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet file, row, col, value) of the filled cells of an XLSX workbook; rows and columns from 0."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        words = []
        if "xl/sharedStrings.xml" in names:
            words = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for cell in ElementTree.fromstring(z.read(name)).iter(f"{_NS}c"):
                letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", "A1")).groups()
                col = 0
                for c in letters:
                    col = col * 26 + ord(c) - 64
                if cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                else:
                    v = cell.find(f"{_NS}v")
                    value = None if v is None else words[int(v.text)] if cell.get("t") == "s" else v.text
                if value is not None:
                    yield name.rpartition("/")[2], int(digits) - 1, col - 1, value


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """source_file, sheet, row, col, value of all workbooks; a file that can't be read gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [(name, *c) for c in sheet_cells(content)]
                except (zipfile.BadZipFile, ElementTree.ParseError):
                    continue
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("source_file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string())]))

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")
    return files.mapInArrow(run, "source_file string, sheet string, row int, col int, value string")


def workbook(rows: list[list[str | None]]) -> bytes:
    """An XLSX workbook of one sheet whose cells are text."""

    def letters(col: int) -> str:
        return (letters(col // 26 - 1) if col >= 26 else "") + chr(65 + col % 26)

    lines = []
    for r, row in enumerate(rows, 1):
        cells = (f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row) if v is not None)
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_NS[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def write_files(contents: DataFrame, folder: str) -> None:
    """One file below ``folder`` for each row of ``contents`` (name, content), written in executors; a task that runs again replaces its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                place = f"{root}/{name}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                draft = f"{place.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write(content)
                store.move(draft, place)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["name"])

    contents.select(F.col("name").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def discover_documents(spark: SparkSession, folder: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """path, doc_id (sha256 of the bytes), filename, category (the folder), size_bytes, modified_time of all files below, and their content
    if asked for. Spark's scans pass over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    parts = F.split("path", "/")
    return files.select("path", F.sha2("content", 256).alias("doc_id"), F.element_at(parts, -1).alias("filename"), F.try_element_at(parts, F.lit(-2)).alias("category"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_time"), *(["content"] if content else []))


def html_text(content: bytes) -> list[str]:
    """The default extractor: one page, without tags."""
    return [re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", content.decode(errors="replace"))).strip()]


def extract_pages(documents: DataFrame, extractor: Callable[[bytes], list[str]] = html_text) -> DataFrame:
    """doc_id, page (from 1), text, error of documents (doc_id, content); a document that can't be read has one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(doc, i, text or "", None) for i, text in enumerate(extractor(content or b""), 1)]
                except Exception as e:  # noqa: BLE001 - any document may be broken, the error is its result
                    rows.append((doc, 0, "", f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "page", "text", "error"])

    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "doc_id string, page int, text string, error string")
