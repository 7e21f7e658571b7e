"""Writers: JSON lines, CSV, id lists, summaries, dead letters, FASTA, splits, key-value tracks and structure exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """With a header; quotes only where they are needed."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, quoteAll=False)


def write_names(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A summary of few rows as one JSON document a row, in one file."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def dead_letters(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and rows with their ``error``. Write both from one materialised frame."""
    tagged = df.withColumn("error", error)
    return tagged.filter("error is null").drop("error"), tagged.filter("error is not null")


def write_fasta(df: DataFrame, key: str, sequence: str, path: str) -> None:
    df.select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_tracks(df: DataFrame, key: str, track_a: list[str], track_b: list[str], path: str) -> None:
    """Two key-value tables of one key: flat records and ragged arrays. Repeated writes of a key leave the last one only."""
    for name, columns in (("track_a", track_a), ("track_b", track_b)):
        df.select(key, *columns).dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/{name}")


def pdb_lines(atoms: DataFrame, keys: list[str], order: list[Column], remarks: Column | None = None) -> DataFrame:
    """Per key, a structure's text: remarks, atom records with serial numbers, TER after each chain, END. A group is one export."""
    line = S.pdb_atom_line(F.lit(0), F.col("atom_name"), F.col("resname"), F.col("chain"), F.col("resseq"), F.col("icode"), F.col("x"), F.col("y"), F.col("z"), F.col("occupancy"), F.col("b_factor"), F.col("element"))
    listed = atoms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("chain").alias("chain"), line.alias("line")))).alias("a"), *([F.first(remarks).alias("r")] if remarks is not None else []))
    n = F.size("a")
    serial = F.transform("a", lambda x, i: F.concat(F.lit("ATOM  "), F.lpad((i + 1).cast("string"), 5, " "), F.substring(x["line"], 12, 200), F.when((i + 1 == n) | (F.element_at("a", F.least(i + 2, n))["chain"] != x["chain"]), F.lit("\nTER")).otherwise(F.lit(""))))
    body = F.array_join(serial, "\n")
    head = F.when(F.col("r").isNotNull(), F.concat("r", F.lit("\n"))).otherwise(F.lit("")) if remarks is not None else F.lit("")
    return listed.select(*keys, F.concat(head, body, F.lit("\nEND\n")).alias("text"))


def export_names(df: DataFrame, order: list[Column], pdb: str, receptor: str, peptide: str, key: str) -> DataFrame:
    """Adds ``file_name``: entry, two-digit position within the entry, both chains and the id's first twelve characters."""
    from ..operators.ordered import over

    i = F.lpad(F.row_number().over(over([pdb], order)).cast("string"), 2, "0")
    return df.withColumn("file_name", F.concat_ws("_", F.col(pdb), i, F.col(receptor), F.col(peptide), F.concat(F.substring(key, 1, 12), F.lit(".pdb"))))


def write_manifest(df: DataFrame, path: str, note: str) -> None:
    """An export's rows as JSON lines in ``manifest.jsonl`` and a note on what is in it in ``README.txt``, both folders of ``path``."""
    write_jsonl(df, f"{path}/manifest.jsonl")
    df.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/README.txt")
