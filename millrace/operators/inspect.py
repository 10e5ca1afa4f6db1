"""What a table holds: types, nulls, duplicates, schemas of files, catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whole and real numbers as text.
INTEGER, REAL = r"^-?\d+$", r"^-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def infer_types(df: DataFrame) -> DataFrame:
    """column_name, type_name (INTEGER, REAL, TEXT) of text columns: one aggregate over all rows; blanks don't count."""
    tests = []
    for c in df.columns:
        v = F.nullif(F.trim(F.col(c)), F.lit(""))
        tests += [F.count(v).alias(f"{c} n"), F.count_if(v.rlike(INTEGER)).alias(f"{c} i"), F.count_if(v.rlike(REAL)).alias(f"{c} r")]
    seen = df.agg(*tests)
    kind = lambda c: F.when(F.col(f"`{c} n`") == 0, "TEXT").when(F.col(f"`{c} n`") == F.col(f"`{c} i`"), "INTEGER").when(F.col(f"`{c} n`") == F.col(f"`{c} r`"), "REAL").otherwise("TEXT")
    return seen.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), kind(c).alias("type_name")) for c in df.columns))))


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts by the inferred names; what a cast would lose is kept as JSON in ``_rescued``."""
    to = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string"}
    lost = F.map_filter(F.map_from_arrays(F.array(*(F.lit(c) for c in types)), F.array(*(F.when(F.col(c).isNotNull() & F.col(c).try_cast(to[k]).isNull(), F.col(c)) for c, k in types.items()))), lambda k, v: v.isNotNull())
    return df.select(*(F.col(c).try_cast(to[types[c]]).alias(c) if c in types else F.col(c) for c in df.columns), F.when(F.size(lost) > 0, F.to_json(lost)).alias("_rescued"))


def null_cells(df: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col(c).isNull()) for c in df.columns]
    return df.agg(sum(counts[1:], counts[0]).alias("null_cells"))


def reconcile(source: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row of checks between what was read and what was loaded."""
    facts = lambda df, p: df.agg(F.count("*").alias(f"{p}_rows"), sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull())).alias(f"{p}_nulls"))
    both = facts(source, "a").join(F.broadcast(facts(loaded, "b")))
    checks = both.select(F.col("b_rows").alias("n_rows"), F.lit(len(loaded.columns)).alias("n_columns"), (F.col("a_rows") == F.col("b_rows")).alias("rows_match"), F.lit(len(source.columns) == len(loaded.columns)).alias("columns_match"), (F.col("a_nulls") == F.col("b_nulls")).alias("nulls_match"))
    return checks.withColumn("status", F.when(F.col("rows_match") & F.col("columns_match") & F.col("nulls_match"), "PASS").otherwise("FAIL"))


def duplicate_report(df: DataFrame) -> DataFrame:
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after")).withColumn("duplicates", F.col("rows_before") - F.col("rows_after"))


def documentation_gaps(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """section, column_name, problem: what a documentation (place, line; sections ``## name``, columns ``- name``) says wrongly about
    ``columns`` (section, column_name): a section that isn't there exactly once, a column that is missing or unknown in its section. The
    lines are one document's."""
    heading, item = F.regexp_extract("line", r"^## +(\S+)\s*$", 1), F.regexp_extract("line", r"^- +(\S+)", 1)
    marked = lines.select(F.lit(0).alias("doc"), "place", F.nullif(heading, F.lit("")).alias("heading"), F.nullif(item, F.lit("")).alias("column_name"))
    inside = Window.partitionBy("doc").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("section", F.last("heading", ignorenulls=True).over(inside))
    counts = marked.where("heading is not null").groupBy("section").agg(F.count("*").alias("n"))
    sections = columns.select("section").distinct().join(counts, "section", "full").where(F.coalesce("n", F.lit(0)) != 1)
    sections = sections.select("section", F.lit(None).cast("string").alias("column_name"), F.when(F.col("n").isNull(), "section missing").otherwise("section repeated").alias("problem"))
    said = marked.where("column_name is not null").select("section", "column_name", F.lit(True).alias("said")).distinct()
    both = columns.select("section", "column_name", F.lit(True).alias("there")).distinct().join(said, ["section", "column_name"], "full")
    gaps = both.where(F.col("there").isNull() | F.col("said").isNull())
    return sections.unionByName(gaps.select("section", "column_name", F.when(F.col("there").isNull(), "column unknown").otherwise("column missing").alias("problem")))


def schema_variants(rows: DataFrame) -> DataFrame:
    """Columns that differ only by case and blanks: norm, variants (sorted)."""
    norm = F.lower(F.regexp_replace("column_name", r"[\s_]+", ""))
    return rows.groupBy(norm.alias("norm")).agg(F.array_sort(F.collect_set("column_name")).alias("variants")).where(F.size("variants") > 1)


def catalogue_profile(spark: SparkSession, names: list[str]) -> DataFrame:
    """table_name, n_columns, n_rows of registered views or tables."""
    parts = [spark.table(n).agg(F.lit(n).alias("table_name"), F.lit(len(spark.table(n).columns)).alias("n_columns"), F.count("*").alias("n_rows")) for n in names]
    return reduce(DataFrame.unionByName, parts)


#: Property in which a table names the columns of its key, and what is read of a table's description.
KEY_PROPERTY = "millrace.key"
_DESCRIPTION = "table_name string, columns array<struct<name string, type struct<name string>, nullable boolean>>, partition_columns array<string>, bucket_columns array<string>, sort_columns array<string>, table_properties map<string,string>"


def declare_key(spark: SparkSession, name: str, columns: list[str]) -> None:
    """Names a table's key; ``key_report`` tells whether its rows keep to it."""
    unknown = [c for c in columns if c not in spark.table(name).columns]
    if unknown or not columns:
        raise ValueError(f"{name} has no column {unknown}" if unknown else "a key has a column at least")
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{KEY_PROPERTY}' = '{','.join(columns)}')")


def reflect_columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """table_name, position (from 0), column_name, type_name, nullable, and what a column serves for as places from 0 or null: key_place,
    partition_place, bucket_place, sort_place. Read from the catalogue; no table is scanned. A table without a key has nulls there."""
    said = [spark.sql(f"DESCRIBE TABLE EXTENDED {n} AS JSON").select(F.from_json("json_metadata", _DESCRIPTION).alias("d")).select("d.*") for n in names]
    tables = reduce(DataFrame.unionByName, said).withColumn("key_columns", F.split(F.col("table_properties")[KEY_PROPERTY], ","))
    place = lambda among: F.nullif(F.array_position(among, F.col("column.name")), F.lit(0).cast("long")) - 1
    uses = ("key", "partition", "bucket", "sort")
    each = tables.select("table_name", *(f"{u}_columns" for u in uses), F.posexplode("columns").alias("position", "column"))
    return each.select("table_name", "position", F.col("column.name").alias("column_name"), F.col("column.type.name").alias("type_name"), "column.nullable", *(place(F.col(f"{u}_columns")).cast("int").alias(f"{u}_place") for u in uses))


def key_report(spark: SparkSession, names: list[str]) -> DataFrame:
    """table_name, key_columns, n_rows, n_null (rows with a null in the key), n_repeated (rows beyond the first of a key), is_key of each
    table; without a declared key only the rows are counted and is_key is null. One pass a table, of its key's columns; keys are
    combined before they move, and a key that very many rows hold is one row by then."""

    def one(name: str) -> DataFrame:
        df = spark.table(name)
        said = spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key") == KEY_PROPERTY).first()  # a table's properties, not its rows
        label = F.lit(name.rpartition(".")[2]).alias("table_name")
        if said is None:
            none = F.lit(None)
            return df.agg(label, none.cast("string").alias("key_columns"), F.count("*").alias("n_rows"), none.cast("long").alias("n_null"), none.cast("long").alias("n_repeated"), none.cast("boolean").alias("is_key"))
        key = said["value"].split(",")
        null = F.expr(" OR ".join(f"`{c}` IS NULL" for c in key))
        groups = df.groupBy(*key).agg(F.count("*").alias("_n")).select("_n", null.alias("_null"))
        total = lambda x: F.coalesce(F.sum(x), F.lit(0).cast("long"))
        facts = groups.agg(total("_n").alias("n_rows"), total(F.when(F.col("_null"), F.col("_n"))).alias("n_null"), total(F.when(~F.col("_null"), F.col("_n") - 1)).alias("n_repeated"))
        return facts.select(label, F.lit(",".join(key)).alias("key_columns"), "n_rows", "n_null", "n_repeated", ((F.col("n_null") == 0) & (F.col("n_repeated") == 0)).alias("is_key"))

    return reduce(DataFrame.unionByName, [one(n) for n in names])


def value_domains(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """column_name, n_values, values (sorted, as text; null if there are more than ``most``) of columns that hold few values. Distinct
    values are found in one pass over all columns, combined before they move; no more than ``most`` + 1 of a column are gathered."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("cell")).select("cell.*")
    found = cells.where("value is not null").distinct()
    first = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    some = found.withColumn("_first", first).where(F.col("_first") <= most + 1).groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("values"))
    sizes = found.groupBy("column_name").agg(F.count("*").alias("n_values"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    out = names.join(F.broadcast(sizes), "column_name", "left").join(F.broadcast(some), "column_name", "left")
    empty = F.array().cast("array<string>")
    return out.select("column_name", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.when(F.coalesce("n_values", F.lit(0)) <= most, F.coalesce("values", empty)).alias("values"))


def casing(df: DataFrame, column: str) -> DataFrame:
    """One row: does the column hold upper case only?"""
    c = F.col(column)
    return df.agg(F.when(F.coalesce(F.bool_and(c == F.upper(c)), F.lit(False)), "UPPERCASE").otherwise("MIXED").alias("casing"))
