"""Readers of row files: JSON lines, CSV by suffix, id lists, cluster tables, entry folders; and checks on schemas and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ordered
from ..storage import cut


def read_jsonl(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines of all paths together, columns by name; blank lines do not count. Give a schema to spare the inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return union_by_name(*(reader.json(p) for p in paths))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All frames together, columns by name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_jsonl_head(spark: SparkSession, path: str, lines: int, schema: T.StructType | str) -> DataFrame:
    """The rows on the first ``lines`` physical lines of one file, blank ones included in the count."""
    text = spark.read.text(path, wholetext=True)
    head = text.select(F.posexplode(F.slice(F.split("value", "\n"), 1, lines)).alias("line", "value")).filter("trim(value) <> ''")
    return head.select("line", F.from_json("value", schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).alias("r")).select("line", "r.*").orderBy("line").drop("line")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines or CSV with a header, by the path's suffix; another suffix is an error."""
    if path.endswith((".jsonl", ".json")):
        return spark.read.json(path)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"neither JSON lines nor CSV nor Parquet: {path}")


def clean_ids(rows: DataFrame, id_: Column, lengths: tuple[int, int] = (4, 4)) -> DataFrame:
    """The distinct ids (``id``), trimmed and lower-cased, of between ``lengths`` characters."""
    ids = rows.select(F.lower(F.trim(id_)).alias("id"))
    return ids.filter(F.length("id").between(*lengths)).distinct()


def harvest_ids(spark: SparkSession, folder: str, length: int = 4, pattern: str = "*.csv") -> DataFrame:
    """The distinct ids in the first column of all CSV files: trimmed, lower-cased, of ``length`` characters. Bad lines are skipped."""
    lines = spark.read.option("pathGlobFilter", pattern).text(folder)
    return clean_ids(lines, F.regexp_replace(F.trim(F.split("value", ",")[0]), '^"|"$', ""), (length, length))


def read_headerless(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]))


def filtered_ids(rows: DataFrame, column: str, value: str, id_: str) -> DataFrame:
    """Distinct ids of the rows whose column equals ``value`` without regard to case, in order."""
    return rows.filter(F.lower(F.trim(column)) == value).select(F.lower(F.trim(id_)).alias("id")).distinct().orderBy("id")


def read_entries(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """A row for each subfolder that has all of the named files, with their texts."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    part = raw.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("entry"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("content").cast("string").alias("text"))
    found = part.filter(F.col("name").isin(*names)).groupBy("entry").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("files"))
    return found.filter(F.size("files") == len(names)).select("entry", *(F.col("files")[n].alias(n.rsplit(".", 1)[0]) for n in names))


def resolve_paths(rows: DataFrame, present: DataFrame, candidates: list[Column]) -> DataFrame:
    """Adds ``resolved``: the first candidate name that ``present`` (name) has; null if none is there.

    The numbered rows are written before they are used on two sides, so a row that is computed again keeps its number.
    """
    keyed = cut(rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__c", F.array(*candidates)), "keyed")
    tried = keyed.select("__row", F.posexplode("__c").alias("i", "name")).join(present.select("name").distinct(), "name")
    best = tried.groupBy("__row").agg(F.min_by("name", "i").alias("resolved"))
    return keyed.join(best, "__row", "left").drop("__row", "__c")


def missing_ids(wanted: DataFrame, present: DataFrame, key: str = "id") -> DataFrame:
    """Ids still to be fetched; the fetching itself is outside the engine."""
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"there are no {what}")
    return df


def alias_chain(df: DataFrame, name: str, *candidates: str) -> DataFrame:
    """Column ``name`` from the first non-null of the candidates that the frame has."""
    there = [F.col(c) for c in candidates if c in df.columns]
    if not there:
        raise ValueError(f"none of {', '.join(candidates)} is there for {name}")
    return df.withColumn(name, F.coalesce(*there))


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    """Those of the columns that the frame has."""
    return df.select(*[n for n in names if n in df.columns])


def exactly_one(df: DataFrame, condition: Column) -> DataFrame:
    """The one row that meets the condition; an error for none or several."""
    found = df.filter(condition)
    n = len(found.limit(2).collect())
    if n != 1:
        raise ValueError("no row matches" if n == 0 else "more than one row matches")
    return found


def with_row_id(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """Positions from 0 in a declared order, without one task holding all rows."""
    return ordered.ranked(df, [], order, name).withColumn(name, F.col(name) - 1)


def split_rows(df: DataFrame, split: str, *sequences: str, column: str = "split") -> DataFrame:
    """The rows of one split whose sequences all are non-empty."""
    there = [F.coalesce(F.char_length(F.trim(s)), F.lit(0)) > 0 for s in sequences]
    return df.filter(reduce(lambda a, b: a & b, there, F.col(column) == split))


def entity_rows(df: DataFrame, entry: str, chains: dict[str, str] | None = None, column: str = "pdb_id") -> DataFrame:
    """The rows of an entry, without regard to case, and of the chains named by column; an empty name asks for any."""
    out = df.filter(F.lower(F.trim(column)) == entry.strip().lower())
    return reduce(lambda d, c: d.filter(F.col(c[0]) == c[1]), [(k, v) for k, v in (chains or {}).items() if v], out)


def require_same(df: DataFrame, *columns: str) -> DataFrame:
    """The frame, if all its rows agree in the columns; else an error that names the first that differs."""
    counts = df.agg(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in columns)).first()
    for c in columns:
        if counts[c] > 1:
            raise ValueError(f"rows differ in {c}")
    return df


def first_rows(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows by an order, all without a number. The limit is the feature."""
    return df if n is None else df.orderBy(*order).limit(n)


def read_index(spark: SparkSession, vectors: str, metadata: str, key: str = "id") -> DataFrame:
    """Vectors and their metadata, both Parquet with one row a ``key``, as one frame; a vector without metadata stays."""
    require_columns(spark.read.parquet(vectors), key)
    return spark.read.parquet(vectors).join(spark.read.parquet(metadata), key, "left")
