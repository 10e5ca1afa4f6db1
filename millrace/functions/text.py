"""Text cleaning and chunking as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Separators in the order in which a cut looks for them.
SEPARATORS = ("\n\n", ". ", ".\n", "\n", " ")


def _normal(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    return F.pandas_udf(_normal, StringType())(c)


#: Characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends; looks at no more than the ends."""
    return F.btrim(c, F.lit(WHITE))


def rules(c: Column) -> Column:
    """Line ends, words parted over lines, control characters, blanks, blank lines - in this order."""
    steps = (
        (r"\r\n?", "\n"),
        (r"(?U)(\w)-\n(\w)", "$1$2"),
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""),
        (r"[ \t ]+", " "),
        (r"[ \t]+\n", "\n"),
        (r"\n{3,}", "\n\n"),
    )
    return strip(reduce(lambda x, s: F.regexp_replace(x, *s), steps, F.coalesce(c, F.lit(""))))


def clean(df: DataFrame, column: str) -> DataFrame:
    """The column cleaned, in one scan. Spark has no NFKC, so that step is Python's; texts of ASCII alone need none and aren't sent."""
    c = F.col(column)
    beyond = F.when(F.octet_length(c) != F.length(c), c)
    return df.withColumn(column, rules(F.coalesce(nfkc(beyond), c)))


def chunks(df: DataFrame, column: str, size: int = 1000, overlap: int = 150, least: int = 50, gap_free: bool = False) -> DataFrame:
    """A row for each chunk: the columns but ``column``, then pos, chunk. Starts are size - overlap apart, so all chunks of a text
    follow from its length; a chunk ends after the last separator (of the first kind found) in its later half.
    ``gap_free`` lets a chunk begin where the one before was cut, if that is earlier.

    A text is cut once into segments from start to start, of which pieces are put together; no row holds more than its pieces."""
    step, half = size - overlap, size // 2
    keep = [c for c in df.columns if c != column]
    body = df.select(*keep, strip(F.coalesce(F.col(column), F.lit(""))).alias("_t")).where("_t <> ''")
    body = body.select(*keep, F.length("_t").alias("_n"), F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_s"))
    count = F.ceil(F.greatest(F.col("_n") - size, F.lit(0)) / step).cast("int")

    def piece(pos: Column) -> Column:
        return F.substring(F.array_join(F.slice("_s", pos + 1, F.lit(-(-size // step))), ""), 1, size)

    def struct_of(pos: Column) -> Column:
        before = [F.when(pos > 0, piece(pos - 1)).alias("before")] if gap_free else []
        return F.struct(pos.alias("pos"), piece(pos).alias("piece"), *before)

    rows = body.select(*keep, "_n", F.explode(F.transform(F.sequence(F.lit(0), count), struct_of)).alias("_p")).select(*keep, "_n", "_p.*")

    def cut(text: Column, pos: Column) -> Column:
        """Characters of a piece before its cut."""
        tail = F.reverse(F.substring(text, half + 1, size - half))
        found = [F.nullif(F.instr(tail, s[::-1]), F.lit(0)) for s in SEPARATORS]
        return F.when(pos * step + size >= F.col("_n"), F.length(text)).otherwise(F.coalesce(*(size - p + 1 for p in found), F.lit(size)))

    chunk = F.substring(F.col("piece"), F.lit(1), cut(F.col("piece"), F.col("pos")))
    if gap_free:
        end = cut(F.col("before"), F.col("pos") - 1)
        lead = F.when(end < step, F.substring(F.col("before"), end + 1, step - end))
        chunk = F.concat(F.coalesce(lead, F.lit("")), chunk)
    return rows.select(*keep, "pos", strip(chunk).alias("chunk")).where(F.length("chunk") >= least)


def section_hint(c: Column, most: int = 100) -> Column:
    """The first line that isn't blank."""
    return F.substring(F.trim(F.try_element_at(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), F.lit(1))), 1, most)


def chunk_records(pieces: DataFrame, doc: str, digest: str) -> DataFrame:
    """Adds chunk_index (running over the survivors of a document), chunk_id, char_count and section."""
    index = F.row_number().over(Window.partitionBy(doc).orderBy("page", "pos")) - 1
    out = pieces.withColumn("chunk_index", index.cast("long"))
    return out.withColumns({
        "chunk_id": F.format_string("%s_%05d", F.substring(digest, 1, 12), F.col("chunk_index")),
        "char_count": F.length("chunk").cast("long"),
        "section": section_hint(F.col("chunk")),
    })


def path_parts(c: Column) -> Column:
    """struct(category, filename, suffix) of a path."""
    parts = F.split(c, "/")
    return F.struct(F.try_element_at(parts, F.lit(-2)).alias("category"), F.element_at(parts, -1).alias("filename"), F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1)).alias("suffix"))


def extract_json(c: Column) -> Column:
    """The first JSON object in a text as JSON: fenced, plain, or from the first brace to the last, trailing commas repaired; else null."""
    def valid(x: Column) -> Column:
        return F.when(F.trim(x).startswith("{"), F.to_json(F.try_parse_json(x)))

    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(valid(fenced), valid(c), valid(braces), valid(F.regexp_replace(braces, r",\s*([}\]])", "$1")))


def clean_sql(c: Column) -> Column:
    """Without fences and trailing semicolons."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```(?:sql)?\s*", ""), r"\s*```$", "")
    return F.trim(F.regexp_replace(F.trim(bare), r"[;\s]+$", ""))


def nonempty(c: Column) -> Column:
    return F.coalesce(~F.trim(c).isin("", "{}", "[]", "null", "None"), F.lit(False))
