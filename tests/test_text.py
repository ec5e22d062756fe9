from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from quirework.functions import compress as C
from quirework.functions import refs as R
from quirework.functions import text as X
from quirework.plans import catalogue


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_compression(spark):
    light = lambda t: C.compress(t, "light")
    hard = lambda t: C.compress(t, "hard")
    assert one(spark, light, "The results are better than the baseline", "Furthermore, the model is small.", "It is not the case", "", None, "the, a", "we use $\\the a$ here") == ["Results better than baseline", "Model small.", "It not case", "", None, "", "We use $\\the a$ here"]
    assert one(spark, hard, "The effect of heat on the yield may be very large", "has been shown to be good") == ["Effect heat yield may large", "Good"]
    assert one(spark, light, "in order to fit, as well as test", "In this paper we show") == ["To fit, and test", "We show"]
    with pytest.raises(ValueError):
        C.level_of("most")
    assert C.level_of("off") is C.level_of(None) is None


def test_markers_and_numbers(spark):
    assert one(spark, X.list_marker, "• a", "1. a", "(iv) a", "a) b", "word b", "1.", "-a", "", None) == [False, True, True, True, None, None, None, None, None]
    assert one(spark, X.numbered_heading, "1 Introduction", "A Study", "A. Proofs", "IV. Data", "IIII. x", "1.2.3.4.5 x", "2020 was", "ON SETS", "3.", "1.5 2") == [True, False, True, True, False, False, False, False, False, False]
    assert one(spark, X.numbering_depth, "1 Intro", "2.3. Data", "A.1.2 Lemma", "none") == [1, 2, 3, None]
    assert one(spark, X.is_caption, "Figure 3: x", "Fig. x", "Table 12", "tables 1", "A table 1") == [True, False, True, True, False]


def test_every_roman_numeral(spark):
    numbers = spark.range(2, 40).select("id", X.to_roman(F.col("id")).alias("t")).select("id", X.roman_value(F.col("t")).alias("v"), X.is_roman(F.col("t")).alias("ok"), "t").collect()
    assert all(r.v == r.id for r in numbers)
    assert [r.id for r in numbers if not r.ok] == [5, 10]


def test_references(spark):
    parsed = one(spark, R.parse, "[1] A. Baker, C. Dole. On the persistence of things. 5(2):157-166, 1994.", "Fundamenta Arithm. 31 (2019), 1822–1840.", "see vol. 10. doi:10.1145/3292500. arXiv:0812.2078", "")
    assert (parsed[0].label, parsed[0].year, parsed[0].authors, parsed[0].title) == ("1", 1994, ["A. Baker", "C. Dole"], "On the persistence of things")
    assert parsed[1].year == 2019 and parsed[2].doi == "10.1145/3292500" and parsed[2].arxiv == "0812.2078" and parsed[2].year is None
    assert parsed[3].label is None and parsed[3].authors == []


def test_entries_are_split_by_labels_or_authors():
    assert R.entries_of("[1] One. [2] Two (2012). [3] Three [9]. x") == ["[1] One.", "[2] Two (2012).", "[3] Three [9]. x"]
    assert R.entries_of("1. One pp. 12. 2. Two") == ["1. One pp. 12.", "2. Two"]
    text = "Agergaard, S., C. Li, 2001, Phys. Rev. 3. Alpichshev, Z., 2010, Phys. 4. van Dyke, A., 2011, Proc. 5."
    assert R.entries_of(text) == ["Agergaard, S., C. Li, 2001, Phys. Rev. 3.", "Alpichshev, Z., 2010, Phys. 4.", "van Dyke, A., 2011, Proc. 5."]
    assert R.entries_of("  ") == R.entries_of(None) == [] and R.entries_of(" one ") == ["one"]


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = catalogue.QUERIES[name](spark, sf).toPandas(), con.execute(catalogue.SQL[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda df: sorted(tuple(round(float(x), 4) if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(a) == key(b)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
