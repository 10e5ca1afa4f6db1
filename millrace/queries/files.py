"""Sources that are files: rows of the tables are written to the shared folder as others would hand them in, and read from there."""

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import inspect as I
from ..sources import files as S
from .registry import query
from .storage import _place

_HEAD = r"[\x00-\x20\"\\,]+"


def _csv_folder(t):
    """Documents as CSV: those that Latin-1 can write in Latin-1, the others in UTF-8, and a file with lines of too many and too few fields."""
    root = _place(t, "text")
    head = F.trim(F.regexp_replace(F.substring("text", 1, 60), _HEAD, " "))
    rows = t("documents").select("doc_id", "lang", "source", "n_chars", F.nullif(head, F.lit("")).alias("head"))
    latin = F.coalesce(F.col("head"), F.lit("")).rlike(r"^[\x00-\x7f\xa0-\xff]*$")
    for name, encoding, some in (("latin", "ISO-8859-1", latin & (F.col("doc_id") % 2 == 0)), ("utf8", "UTF-8", ~(latin & (F.col("doc_id") % 2 == 0)))):
        rows.where(some).write.csv(f"{root}/{name}", header=True, encoding=encoding)
    bad = t("region").where("r_regionkey = 0").select(F.concat(F.lit("doc_id,lang,source,n_chars,head\n1,too,many,fields,in,this,line,"), "r_name", F.lit("\ntoo,few")).alias("value"))
    bad.write.text(f"{root}/bad")
    return f"{root}/*"


@query(rf"SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars, nullif(trim(regexp_replace(substr(text, 1, 60), '{_HEAD}', ' ', 'g')), '') AS head FROM documents")
def scan_text_columns(t):
    """Files of two encodings, split where they are large; bad lines are left out."""
    return S.read_text_table(t.spark, _csv_folder(t)).drop("source_file")


@query("SELECT source, regexp_extract(source, '([0-9]+)$', 1) AS number, count(*) AS n FROM documents GROUP BY source")
def scan_source_file(t):
    """One file a source, found again by its name."""
    root = _place(t, "sources")
    packed = t("documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    S.write_files(packed.where("name is not null").select(F.concat("name", F.lit(".csv")).alias("name"), F.concat(F.lit("n\n"), F.col("n").cast("string"), F.lit("\n")).alias("content")), root)
    rows = S.read_text_table(t.spark, f"{root}/*.csv").withColumn("source", F.regexp_replace("source_file", r"\.csv$", ""))
    return rows.select("source", F.regexp_extract("source", "([0-9]+)$", 1).alias("number"), F.col("n").cast("long").alias("n"))


def _workbooks(rows, key, name, lines):
    """A workbook for each value of ``key``, made where its rows are; ``lines`` makes a workbook's rows of cells from theirs."""

    def make(table: pa.Table) -> pa.Table:
        return pa.table({"name": [f"{name}_{table[key][0].as_py()}.xlsx"], "content": pa.array([S.workbook(lines(table.to_pylist()))], pa.binary())})

    return rows.groupBy(key).applyInArrow(make, "name string, content binary")


def _cells(t, root):
    cells = S.read_sheets(t.spark, f"{root}/*.xlsx")
    return cells.withColumn("sheet", F.regexp_extract("source_file", r"^(.*)\.xlsx$", 1))


def _regions(t):
    """Nations of a region, below as many title lines as its key, with a header of two levels."""

    def lines(rows):
        rows = sorted(rows, key=lambda r: r["n_nationkey"])
        titles = [[f"Report {k}"] for k in range(rows[0]["n_regionkey"])]
        return [*titles, [" S.No ", "Nation", "Keys", None], [None, None, "Nation  key", "Region key"], *([str(k), r["n_name"], str(r["n_nationkey"]), str(r["n_regionkey"])] for k, r in enumerate(rows, 1))]

    root = _place(t, "regions")
    S.write_files(_workbooks(t("nation"), "n_regionkey", "region", lines), root)
    return _cells(t, root)


def _event_books(t):
    """Events by the thousand, below up to two title lines."""

    def lines(rows):
        rows = sorted(rows, key=lambda r: r["event_id"])
        titles = [[f"Events {k}"] for k in range(rows[0]["book"] % 3)]
        return [*titles, ["event id", "event type", "value"], *([str(r["event_id"]), r["event_type"], None if r["value"] is None else repr(r["value"])] for r in rows)]

    root = _place(t, "events")
    books = t("events").select("event_id", "event_type", "value", F.floor(F.col("event_id") / 1000).cast("long").alias("book"))
    S.write_files(_workbooks(books, "book", "book", lines), root)
    return _cells(t, root)


_REGION = "'region_' || n_regionkey"


@query(f"SELECT {_REGION} AS sheet, CAST(n_regionkey AS INTEGER) AS header_row FROM nation GROUP BY n_regionkey")
def locate_header_row(t):
    return G.locate_header_row(_regions(t))


@query(f"SELECT {_REGION} AS sheet, CAST(n_regionkey AS INTEGER) AS header_row, CAST(n_regionkey + 2 AS INTEGER) AS data_row FROM nation GROUP BY n_regionkey")
def locate_data_row(t):
    cells = _regions(t)
    return G.locate_data_row(cells, G.locate_header_row(cells))


def _names(cells):
    band = cells.join(G.locate_data_row(cells, G.locate_header_row(cells)), "sheet").where("row >= header_row and row < data_row")
    band = band.select("sheet", (F.col("row") - F.col("header_row")).alias("level"), "col", "value")
    # a band is a grid: the cells that a workbook leaves out are empty
    places = band.groupBy("sheet").agg(F.max("level").alias("deep"), F.max("col").alias("wide"))
    grid = places.select("sheet", F.explode(F.sequence(F.lit(0), "deep")).alias("level"), "wide").select("sheet", "level", F.explode(F.sequence(F.lit(0), "wide")).alias("col"))
    return G.flatten_header(grid.join(band, ["sheet", "level", "col"], "left"))


@query(f"SELECT {_REGION} AS sheet, CAST(c.col AS INTEGER) AS col, c.name FROM (SELECT DISTINCT n_regionkey FROM nation) n, (VALUES (0, 'S.No'), (1, 'Nation'), (2, 'Keys | Nation key'), (3, 'Keys | Region key')) c(col, name)")
def flatten_header(t):
    return _names(_regions(t))


@query("SELECT 'region_' || n_regionkey AS sheet, n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation")
def sheet_records(t):
    """Rows of workbooks as typed columns, under the names that their headers give."""
    cells = _regions(t)
    found = G.records(cells, _names(cells), G.locate_data_row(cells, G.locate_header_row(cells)))
    return found.select("sheet", F.col("record")["Nation"].alias("n_name"), F.col("record")["Keys | Nation key"].cast("long").alias("n_nationkey"), F.col("record")["S.No"].cast("long").alias("n"))


_BOOKS = "(SELECT *, CAST(floor(event_id / 1000) AS BIGINT) AS book FROM events)"


@query(f"SELECT 'book_' || book AS sheet, CAST(book % 3 AS INTEGER) AS header_row FROM {_BOOKS} GROUP BY book")
def detect_header_row(t):
    return G.detect_header_row(_event_books(t))


@query(f"SELECT 'book_' || book AS sheet, any_value(book % 3) + 3 + 2 * count(*) + count(value) AS cells FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY event_id) AS r FROM {_BOOKS}) WHERE r <= 25 - 1 - book % 3 GROUP BY book")
def header_window(t):
    return G.header_window(_event_books(t)).groupBy("sheet").agg(F.count("*").alias("cells"))


@query(f"SELECT 'book_' || book AS sheet, count(*) AS n, sum(event_id) AS ids, round(sum(value), 3) AS total FROM {_BOOKS} GROUP BY book")
def grid_scan(t):
    """Cells of workbooks, summed by sheet below the header that is found."""
    cells = _event_books(t)
    below = cells.join(G.detect_header_row(cells), "sheet").where(F.col("row") > F.col("header_row"))
    of = lambda col, kind: F.when(F.col("col") == col, F.col("value").cast(kind))
    return below.groupBy("sheet").agg(F.count(of(0, "long")).alias("n"), F.sum(of(0, "long")).alias("ids"), F.round(F.sum(of(2, "double")), 3).alias("total"))


def _page_files(t):
    """Pages as files by folder, one without text and one that no extractor reads beside them."""
    root = _place(t, "pages")
    pages = t("pages").where("html is not null").select(F.concat(F.lit("site_"), F.pmod("page_id", F.lit(7)).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    odd = t("region").where("r_regionkey < 2").select(F.concat(F.lit("odd/"), "r_name", F.lit(".html")).alias("name"), F.when(F.col("r_regionkey") == 0, "<html></html>").otherwise("%PDF-1.7 broken").cast("binary").alias("content"))
    S.write_files(pages.union(odd), root)
    S.write_files(odd.select(F.lit("odd/notes.txt").alias("name"), "content").limit(1), root)
    return root


_FILES = "(SELECT 'site_' || (page_id % 7) AS category, page_id || '.html' AS filename, html FROM pages WHERE html IS NOT NULL UNION ALL SELECT 'odd', r_name || '.html', CASE WHEN r_regionkey = 0 THEN '<html></html>' ELSE '%PDF-1.7 broken' END FROM region WHERE r_regionkey < 2)"


@query(f"SELECT category, filename, sha256(html) AS doc_id, CAST(strlen(html) AS BIGINT) AS size_bytes FROM {_FILES}")
def discover_documents(t):
    return S.discover_documents(t.spark, _page_files(t), "*.html").select("category", "filename", "doc_id", "size_bytes")


def _page_text(content: bytes) -> list[str]:
    if content.startswith(b"%PDF"):
        raise ValueError("not a page")
    return S.html_text(content)


@query(rf"SELECT filename, CAST(html NOT LIKE '%PDF%' AS INTEGER) AS page, CASE WHEN html LIKE '%PDF%' THEN '' ELSE trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) END AS text, CASE WHEN html LIKE '%PDF%' THEN 'ValueError: not a page' END AS error FROM {_FILES}")
def extract_pages(t):
    """Each file by itself: one that can't be read is an error row, and no other suffers."""
    found = S.discover_documents(t.spark, _page_files(t), "*.html", content=True)
    return S.extract_pages(found.select(F.col("filename").alias("doc_id"), "content"), _page_text).withColumnRenamed("doc_id", "filename")


#: Tables that the queries below hand in as files, with the names that SQL knows.
_TABLES = ("customer", "supplier", "nation")
_COLUMNS = " UNION ALL ".join(f"SELECT '{x}' AS folder, column_name FROM (DESCRIBE {x})" for x in _TABLES)


def _schemas(t):
    """Columns of the tables' files, read from their headers; without the letter of their table."""
    root = _place(t, "schemas")
    for name in _TABLES:
        t(name).write.csv(f"{root}/{name}", header=True)
    return S.file_columns(t.spark, f"{root}/*").select("folder", "column_name").distinct()


def _short(t, *folders):
    found = _schemas(t).withColumn("column_name", F.regexp_replace("column_name", "^[a-z]_", ""))
    return tuple(found.where(F.col("folder") == f).select("column_name") for f in folders)


def _sql(op):
    one = "SELECT regexp_replace(column_name, '^[a-z]_', '') AS column_name FROM (DESCRIBE {})"
    return f"{one.format('customer')} {op} {one.format('supplier')}"


@query(_sql("UNION"))
def schema_union(t):
    a, b = _short(t, "customer", "supplier")
    return a.union(b).distinct()


@query(_sql("INTERSECT"))
def schema_intersect(t):
    a, b = _short(t, "customer", "supplier")
    return a.intersect(b)


@query(_sql("EXCEPT"))
def schema_except(t):
    a, b = _short(t, "customer", "supplier")
    return a.exceptAll(b)


@query("SELECT 'customer' AS section, 'c_acctbal' AS column_name, 'column missing' AS problem UNION ALL SELECT 'customer', 'c_balance', 'column unknown' UNION ALL SELECT 'nation', NULL, 'section repeated' UNION ALL SELECT 'supplier', NULL, 'section missing' UNION ALL SELECT 'supplier', column_name, 'column missing' FROM (DESCRIBE supplier)")
def doc_coverage(t):
    """A documentation that was written from the files' headers and then went out of date."""
    found = _schemas(t).withColumnRenamed("folder", "section")
    said = found.where("section <> 'supplier'").withColumn("column_name", F.when(F.col("column_name") == "c_acctbal", "c_balance").otherwise(F.col("column_name")))
    lines = said.select("section", F.lit(1).alias("level"), F.concat(F.lit("- "), "column_name").alias("line"))
    heads = said.select("section", F.lit(0).alias("level"), F.concat(F.lit("## "), "section").alias("line")).distinct()
    again = heads.where("section = 'nation'").withColumn("level", F.lit(2))
    lines = lines.unionByName(heads).unionByName(again).select(F.concat_ws(" ", "section", F.col("level").cast("string"), "line").alias("place"), "line")
    return I.documentation_gaps(lines, found)
