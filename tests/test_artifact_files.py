"""Files that differ in header, quotes and blanks."""

from pyspark.sql import functions as F

from rankloom.operators.cleaning import number
from rankloom.sources.artifacts import load_metric_files, read_tsv, write_tsv


def test_result_files_of_unequal_headers(spark, tmp_path):
    for name, text in (("a", "model,seed,hit\nm,1,0.5\n"), ("b", "seed,model,hit,ndcg\n2,n,0.25,0.75\n"), ("c", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.csv").write_text(text)
    rows = load_metric_files(spark, f"{tmp_path}/*/metrics.csv").orderBy("dataset").collect()
    assert [(r.dataset, r.model, r.seed, r.hit, r.ndcg) for r in rows] == [("a", "m", "1", "0.5", None), ("b", "n", "2", "0.25", "0.75")]


def test_tsv_keeps_quotes_and_blanks(spark, tmp_path):
    values = ['5" disk', "  led and trailed  ", 'a "b" c', "plain", "back\\slash"]
    write_tsv(spark.createDataFrame([(v,) for v in values], "v string"), f"{tmp_path}/t")
    assert sorted(r.v for r in read_tsv(spark, f"{tmp_path}/t").collect()) == sorted(values)


def test_numbers_take_no_type_suffix(spark):
    cases = {"12D": None, "7f": None, "1e3": 1000.0, " 4 ": 4.0, ".5": 0.5, "5.": 5.0, "-2": -2.0, "NaN": None, "x": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", number(F.col("v")).alias("n")).collect()
    assert {r.v: r.n for r in rows} == cases
