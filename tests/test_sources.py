import json

import pytest
from pyspark.sql import functions as F

from latticeflow.sources import sinks, tables
from latticeflow.streaming import ingest


def test_jsonl_union_blank_lines_and_head(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2, "y": "b"}\n\n{"x": 3}\n')
    (tmp_path / "b.jsonl").write_text('{"x": 4}\n')
    both = tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl"))
    assert sorted((r["x"], r["y"]) for r in both.collect()) == [(1, None), (2, "b"), (3, None), (4, None)]
    head = tables.read_jsonl_head(spark, str(tmp_path / "a.jsonl"), 3, "x long")
    assert [r["x"] for r in head.collect()] == [1, 2]


def test_suffix_decides(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert tables.read_table(spark, str(tmp_path / "t.csv")).collect()[0][:] == (1, "x")
    with pytest.raises(ValueError):
        tables.read_table(spark, "t.xlsx")


def test_ids_are_harvested(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n 1ABC ,2\n\"2def\",3\ntoolong,1\n")
    (tmp_path / "b.csv").write_text("1abc\n\n")
    assert sorted(r["id"] for r in tables.harvest_ids(spark, str(tmp_path)).collect()) == ["1abc", "2def"]


def test_headerless_filter_and_entries(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1ABC\tPeptide\n2xyz\tlig\n1abc\tPEPTIDE\n")
    rows = tables.read_headerless(spark, str(tmp_path / "t.tsv"), ["pdb", "ligand"])
    assert [r["id"] for r in tables.filtered_ids(rows, "ligand", "peptide", "pdb").collect()] == ["1abc"]
    for entry, names in (("e1", ("peptide.pdb", "receptor.pdb")), ("e2", ("peptide.pdb",))):
        (tmp_path / "set" / entry).mkdir(parents=True)
        for n in names:
            (tmp_path / "set" / entry / n).write_text(f"{entry} {n}")
    got = tables.read_entries(spark, str(tmp_path / "set"), ("peptide.pdb", "receptor.pdb")).collect()
    assert [(r["entry"], r["peptide"], r["receptor"]) for r in got] == [("e1", "e1 peptide.pdb", "e1 receptor.pdb")]


def test_paths_resolve_in_order(spark):
    rows = spark.createDataFrame([("A.cif",), ("b.cif",), ("c.cif",)], "f string")
    present = spark.createDataFrame([("a.cif",), ("b.cif",), ("B.cif",)], "name string")
    got = tables.resolve_paths(rows, present, [F.col("f"), F.lower("f"), F.upper("f")])
    assert {r["f"]: r["resolved"] for r in got.collect()} == {"A.cif": "a.cif", "b.cif": "b.cif", "c.cif": None}


def test_checks(spark):
    df = spark.createDataFrame([(1, None, 3.0)], "a int, b double, c double")
    assert tables.alias_chain(df, "v", "missing", "b", "c").first()["v"] == 3.0
    assert tables.keep_columns(df, "c", "zzz", "a").columns == ["c", "a"]
    for bad in (lambda: tables.require_columns(df, "a", "q"), lambda: tables.require_rows(df.limit(0)), lambda: tables.alias_chain(df, "v", "q"), lambda: tables.exactly_one(df, F.col("a") == 2), lambda: tables.exactly_one(df.union(df), F.col("a") == 1)):
        with pytest.raises(ValueError):
            bad()


def test_row_ids_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(r["row_id"] == r["v"] for r in tables.with_row_id(df, [F.col("v")]).collect())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k1", "MK", "a"), ("k2", "GG", "b"), ("k2", "GG", "b")], "k string, s string, split string")
    sinks.write_fasta(df, "k", "s", str(tmp_path / "f"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "f"), lineSep="\n").collect()) == [">k1", ">k2", ">k2", "GG", "GG", "MK"]
    sinks.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = 'b'").count() == 2
    sinks.write_tracks(df, "k", ["s"], ["split"], str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "track_a")).count() == 2
    sinks.write_summary(df.groupBy().count(), str(tmp_path / "j"))
    assert json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect())) == {"count": 3}
    good, bad = sinks.dead_letters(df, F.when(F.col("s") == "GG", "repeated letter"))
    assert (good.count(), bad.count(), good.columns) == (1, 2, df.columns)
    named = sinks.export_names(df.withColumn("r", F.lit("A")), [F.col("k")], "split", "r", "r", "k")
    assert "a_01_A_A_k1.pdb" in [r["file_name"] for r in named.collect()]


def test_only_new_files_are_ingested(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"x": i}))
        ingest.ingest_new(spark, source, "x long", out, state)
        assert spark.read.parquet(out).count() == i + 1


def test_stages_resume_and_force(spark, tmp_path):
    ran = []

    def stage(name, n):
        def run(done):
            ran.append(name)
            return spark.range(n + sum(d.count() for d in done.values()))

        return name, run

    stages = [stage("a", 1), stage("b", 2), stage("c", 3)]
    assert ingest.run_stages(spark, stages, str(tmp_path))["c"].count() == 3 + 1 + 3
    ingest.run_stages(spark, stages, str(tmp_path))
    assert ran == ["a", "b", "c"]
    ingest.run_stages(spark, stages, str(tmp_path), force="b")
    assert ran == ["a", "b", "c", "b", "c"]
    with pytest.raises(ValueError):
        ingest.run_stages(spark, stages, str(tmp_path), resume="zzz")
    with pytest.raises(ValueError):
        ingest.run_stages(spark, stages, str(tmp_path / "new"), resume="b")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from latticeflow import storage

    conf = SimpleNamespace(get=lambda key, default=None: None, set=lambda *a: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        storage.shared_dir(session)
