"""Golden cases of text set to a width."""

from pyspark.sql import functions as F

from pageloom.functions.fitting import FitRule, advance, fit_size, fitted, with_tokens

WIDTH = lambda c: F.when(c == " ", 250.0).when(c == "?", F.lit(None)).otherwise(500.0)


def ask(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_advances(spark):
    wide = lambda t, s=10.0, **how: ask(spark, advance(F.lit(t), F.lit(s), WIDTH, **how))
    assert wide("ab c") == 17.5 and wide("ab c", char_spacing=1.0, word_spacing=2.0) == 23.5 and wide("") == 0.0 and wide("a?") is None


def test_two_measurements_give_the_size(spark):
    size = lambda s, full, half, want, share=0.45: tuple(ask(spark, fit_size(*map(F.lit, (float(s), full, half, float(want))), share)))
    assert size(10, 40.0, 20.0, 30) == (7.5, True)  # in proportion
    assert size(10, 50.0, 30.0, 40) == (7.5, True)  # ten of it are spacing, which doesn't shrink
    assert size(10, 40.0, 20.0, 40) == size(10, 40.0, 20.0, 99) == (10.0, True)  # never enlarged
    assert size(10, 40.0, 20.0, 18) == (4.5, True) and size(10, 40.0, 20.0, 17.9) == (4.5, False) and size(10, 40.0, 20.0, 4, 0.1) == (1.0, True)
    assert size(10, 40.0, 40.0, 30) == (10.0, False) and size(10, 40.0, 20.0, 0)[1] is False and size(0, 1.0, 1.0, 1)[1] is False


def test_a_rule_that_does_not_fit_undoes_itself_alone(spark):
    rows = spark.createDataFrame([("Ada met Ada Lovelace at Ada",), ("none",), ("",)], "text string")
    rules = [FitRule("Ada Lovelace", "[NAME]"), FitRule("met", "[ENCOUNTERED]"), FitRule("Ada", "[X]", 0.3), FitRule("at", "?"), FitRule("Lovelace", "never")]
    out = fitted(rows, rules, F.lit(10.0), WIDTH).withColumn("t", with_tokens(F.col("text"), F.col("placed"))).collect()
    assert [r.t for r in out] == ["[X] met [NAME] at [X]", "none", ""]
    assert [(p.lo, p.hi, p.token, p["size"]) for p in out[0].placed] == [(0, 3, "[X]", 10.0), (8, 20, "[NAME]", 10.0), (24, 27, "[X]", 10.0)]
    tight = fitted(rows, [FitRule("Ada", "[NAME]"), FitRule("at", "[PLACES]", 0.01)], F.lit(10.0), WIDTH).first().placed
    assert [(p.token, p["size"]) for p in tight] == [("[NAME]", 5.0), ("[NAME]", 5.0), ("[PLACES]", 2.5), ("[NAME]", 5.0)]


def test_texts_without_a_literal_are_not_measured(spark):
    rows = spark.createDataFrame([("nothing here",), ("",), (None,)], "text string")
    broken = lambda c: F.raise_error(F.concat(F.lit("measured "), c)).cast("double")
    out = fitted(rows, [FitRule("Ada", "[NAME]"), FitRule("at", "@")], F.lit(10.0), broken).collect()
    assert [r.placed or [] for r in out] == [[], [], []]
