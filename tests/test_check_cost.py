"""What check rules must not spend: a search for a fault that a print doesn't have, steps by line over a citation, classes of letters tried everywhere."""

import time

from pyspark.sql import functions as F

from galley.functions.scalars import compare_norm, emails, unbroken
from galley.operators import checks
from galley.plans.views import FAULTS, with_views


def test_faults_that_do_not_hold_are_not_looked_for():
    spark_sql, duck_sql = (with_views("SELECT * FROM v_check_print", d) for d in ("spark", "duckdb"))
    assert spark_sql.count("ELSE '' END") == len(FAULTS) and "ELSE '' END" not in duck_sql


def test_words_are_joined_in_time_that_grows_with_the_lines(spark):
    lines = ["\tа-", "б -", "-", "в-", "г", "", "_-", " 1- ", "-«", "ж-"]
    assert spark.range(1).select(unbroken(F.lit("\n".join(lines)))).first()[0] == "аб -\n-\nвг\n\n_1-\n-«\nж-"
    long = spark.range(1).select(unbroken(F.repeat(F.lit("слово\n"), F.lit(60_000))).alias("t")).select(F.length("t"))
    began = time.perf_counter()
    assert long.first()[0] == 360_000 and time.perf_counter() - began < 15


def test_prints_that_have_an_item_as_it_is_are_not_normalised(spark, monkeypatch):
    """The form is replaced by an error: only an item that doesn't stand in its print asks for it."""
    prints = spark.createDataFrame([("Цель. Слово один", ["Слово"]), (None, ["x"]), ("text", [None, "", " "])], "t string, items array<string>")
    monkeypatch.setattr(checks, "compare_norm", lambda c: F.raise_error(F.lit("normalised")).cast("string"))
    assert [r[0] for r in prints.select(checks.lost(F.col("t"), F.col("items"))).collect()] == [[], [], []]


def test_items_lost_are_those_whose_form_the_form_of_the_print_lacks(spark):
    texts = ["Решётки, сеть", "решетки", "сети\u0306 и", "и\u0306", "ﬁeld A\u0301x", "A\u0301x", "fiеld", "\u0301x", "№ 5", "", " "]
    pairs = spark.createDataFrame([(t, x) for t in texts for x in [*texts, "сети", "A", "и", "field", "no5", "5 "]], "t string, x string")
    old = ~F.contains(compare_norm(F.col("t")), compare_norm(F.col("x")))
    wrong = pairs.filter((F.size(checks.lost(F.col("t"), F.array("x"))) > 0) != old)
    assert wrong.collect() == []


def test_addresses_are_found_in_time_that_grows_with_the_text(spark):
    plain = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    rows = spark.createDataFrame([(x,) for x in ["1a@b.ru, c@d.ru1x@e.com", "a@b.ru1x@c.de\na@\nb.ru @c.de", "a@b.c x@y@z.org.", "a@b..de@f.gh-", "@", ""]], "t string")
    assert all(r.a == r.b for r in rows.select(emails(F.col("t")).alias("a"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("b")).collect())
    long = spark.range(1).select(emails(F.concat(F.repeat(F.lit("word"), F.lit(60_000)), F.lit(" a@b.ru"))).alias("m"))
    began = time.perf_counter()
    assert long.first()[0] == ["a@b.ru"] and time.perf_counter() - began < 10
