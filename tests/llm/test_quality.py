from __future__ import annotations

from pyspark.sql import functions as F

from quirework.llm.quality import RULES, keep_good, quality_rules


def broken(spark, text):
    return quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0].broken


def test_each_rule_fires(spark):
    fine = "the cat sat on the mat and it was warm in the sun"
    assert broken(spark, fine) == []
    assert broken(spark, "") == ["too_short", "word_length"]
    assert broken(spark, "the ## == cat ## ==") == ["symbols"]
    assert "exclamation" in broken(spark, "the! cat! sat!")
    assert broken(spark, "THE CAT SAT ON THE MAT") == ["capitals"]
    assert broken(spark, "xyzzy plugh " * 60) == ["stop_words"]
    assert broken(spark, "the the the the cat sat") == ["stutter"]
    assert broken(spark, "the cat\n" * 5) == ["lines"]
    assert broken(spark, "the cat...\n on it…\nand so") == ["ellipses"]
    assert broken(spark, "  - the\n • cat\n- sat") == ["bullets"]
    assert "word_length" in broken(spark, "a" * 30)


def test_is_one_projection_without_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_awkward_rows(awkward, empty):
    got = quality_rules(awkward.withColumn("keep", F.lit("x")))
    assert got.columns == [*awkward.columns, "measures", "broken", "keep"]
    rows = got.collect()
    assert len(rows) == awkward.count() and not any(r.keep for r in rows if r.doc_id in (4, 5, 6))
    kept = keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.keep for r in rows)
    assert quality_rules(empty).count() == 0 and len(RULES) == len({r.name for r in RULES})
