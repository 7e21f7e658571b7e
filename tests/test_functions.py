import uuid

import pytest
from pyspark.sql import functions as F

from latticeflow.functions import scalars as S


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_lenient_double(spark):
    rows = [("1.5",), ("'2.5'",), ("3.25(7)",), ("?",), (".",), ("",), (None,), ("x",), (" 4 ",)]
    assert values(spark, S.lenient_double(F.col("t")), rows, "t string") == [1.5, 2.5, 3.25, None, None, None, None, None, 4.0]


def test_int_or_truncates(spark):
    assert values(spark, S.int_or(F.col("t"), 7), [("3.9",), ("-3.9",), ("x",), (None,)], "t string") == [3, -3, 7, 7]


@pytest.mark.parametrize("a, b, iou", [((0, 9), (0, 9), 1.0), ((0, 9), (5, 14), 5 / 15), ((0, 4), (5, 9), 0.0), ((2, 5), (0, 9), 0.4)])
def test_interval_iou(spark, a, b, iou):
    got = spark.range(1).select(S.interval_iou(F.lit(a[0]), F.lit(a[1]), F.lit(b[0]), F.lit(b[1]))).first()[0]
    assert got == pytest.approx(iou)


def test_positional_identity_and_ratio(spark):
    rows = [("ABCD", "ABXD", 0.75), ("ABCD", "AB", 0.5), ("ABCD", "BCDA", 0.0), ("", "A", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    assert all(r[0] == r[1] for r in df.select(S.positional_identity(F.col("a"), F.col("b")), "want").collect())


def test_kmers(spark):
    got = values(spark, S.kmers(F.col("t"), F.lit(3)), [("ABCABC",), ("AB",), ("",), ("AAAA",)], "t string")
    assert [sorted(x) for x in got] == [["ABC", "BCA", "CAB"], ["AB"], [], ["AAA"]]


def test_uuid5_equals_the_library(spark):
    names = ["a::b", "", "1adu::A__B::x", "é"]
    assert values(spark, S.uuid5(F.col("t")), [(n,) for n in names], "t string") == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_bins_are_left_closed(spark):
    got = values(spark, S.bin_label(F.col("x"), [-0.1, 8.0, 14.0, float("inf")]), [(7.99,), (8.0,), (14.0,), (1e9,), (-1.0,), (None,), (float("nan"),)], "x double")
    assert got == ["[-0.1, 8.0)", "[8.0, 14.0)", "[14.0, inf)", "[14.0, inf)", "nan", "nan", "nan"]


def test_group_key_falls_back(spark):
    rows = [("f", "p", "t"), (" ", "p", "t"), ("nan", None, "t"), (None, "", None)]
    got = values(spark, S.group_key([F.col("f")], F.col("p"), F.col("t")), rows, "f string, p string, t string")
    assert got == ["family:f", "target:p", "task:t", "unknown"]


def test_tokens_and_padding(spark):
    got = values(spark, S.padded(S.token_ids(F.col("t")), 4), [("aB z",), ("",), ("1",), ("ABCDEF",)], "t string")
    assert got == [[2, 3, 27, 0], [1, 0, 0, 0], [1, 0, 0, 0], [2, 3, 4, 5]]


def test_residue_names(spark):
    assert values(spark, S.one_letter(F.col("t")), [("ALA",), ("mse",), ("XYZ",)], "t string") == ["A", "M", "X"]
    assert spark.range(1).select(S.residue_id(F.lit(12), F.lit("A"), F.lit("GLY"))).first()[0] == "12A:GLY"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(S.norm(F.col("a")), S.cosine(F.col("a"), F.col("b")), S.unit(F.col("a"))).first()[:] == (5.0, 0.0, [0.6, 0.8])
    vectors = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)))
    assert spark.range(1).select(S.mean_pool(vectors, F.array(F.lit(True), F.lit(True)), 2)).first()[0] == [2.0, 4.0]


def test_heading(spark):
    given = ["1.2 Hello,  World!", "C++ & 中文", "", None, "  3) Straße ", "2024 report", "12. Données"]
    assert values(spark, S.heading(F.col("t")), [(x,) for x in given], "t string") == ["2 hello world", "c 中文", "", "", "strasse", "2024 report", "donn es"]


def test_sanitized(spark):
    given = ["  a b/c.pdb ", "__x-", "._-", "", None, "ok", "é"]
    assert values(spark, S.sanitized(F.col("t")), [(x,) for x in given], "t string") == ["a_b_c.pdb", "x", "unknown", "unknown", "unknown", "ok", "unknown"]


def test_group_key_takes_nan_in_lower_case_only_as_missing(spark):
    given = [("nan", "x", "t"), ("NaN", "x", "t"), (" ", "nan", "t"), (None, None, "nan")]
    key = S.group_key([F.col("a")], F.col("b"), F.col("c"))
    assert values(spark, key, given, "a string, b string, c string") == ["target:x", "family:NaN", "task:t", "unknown"]


def test_atom_line_has_fixed_columns(spark):
    line = spark.range(1).select(S.pdb_atom_line(F.lit(7), F.lit("CA"), F.lit("GLY"), F.lit("A"), F.lit(12), F.lit(""), F.lit(1.5), F.lit(-2.25), F.lit(10.0), F.lit(1.0), F.lit(20.0), F.lit("c"))).first()[0]
    assert line == "ATOM      7  CA  GLY A  12       1.500  -2.250  10.000  1.00 20.00           C"
