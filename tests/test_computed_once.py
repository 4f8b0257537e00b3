"""Sets of pairs, scores of pairs and decoded texts are computed once a row, as plans tell, and stay what they were."""

from pyspark.sql import functions as F

from galley import catalog
from galley.functions.scalars import bigram_dice, bigrams, homoglyph_fix
from galley.operators import joins, mining

from .conftest import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sets_of_pairs_are_made_once(spark):
    texts = spark.createDataFrame([("abab", "ba"), ("", "x"), (None, "xy"), ("a😀b", "😀b")], "a string, b string")
    made = texts.select(bigram_dice(F.col("a"), F.col("b")).alias("d"), bigrams(F.col("a")).alias("x"))
    assert [(r.d, r.x) for r in made.collect()] == [(2 / 3, ["ab", "ba"]), (0.0, []), (0.0, []), (2 / 3, ["a😀", "😀b"])]
    assert plan(texts.select(bigram_dice(F.col("a"), F.col("b")).alias("d"))).count("array_distinct") == 2


def test_scores_of_references_are_computed_once(spark):
    assert plan(catalog.queries()["align_references"](spark, DATA)).count("array_intersect") == 1
    ru, en = (spark.createDataFrame([(1, 1, t), (2, 1, "x")], "article_id int, pos int, text string") for t in ("Петров П.П. Труд. 1990", "Petrov P.P. Trud. 1990"))
    found = joins.align_references(ru, en.filter("article_id = 1")).collect()
    assert sorted((r.article_id, r.ru_pos, r.en_pos) for r in found) == [(1, 1, 1), (2, 1, None)]


def test_alphabets_are_told_without_cutting_texts(spark):
    words = spark.createDataFrame([("CтaTbя",), ("Сору",), ("АВС",), ("ёA",), (None,)], "w string").select(homoglyph_fix(F.col("w")).alias("w"))
    assert [r.w for r in words.collect()] == ["СтаТbя", "Copy", "ABC", "ёA", None]
    assert "regexp_replace" not in plan(words)


def test_one_text_of_a_file_is_moved(spark):
    for key in ("javaCharsets", "codingErrorAction"):
        spark.conf.set(f"spark.sql.legacy.{key}", "true")
    files = spark.createDataFrame([("a", "привет".encode("koi8-r")), ("b", b""), ("a", "привет всем".encode("cp1251"))], "name string, content binary")
    found = mining.best_charset(files)
    assert {r.name: (r.charset, r.text) for r in found.collect()} == {"a": ("windows-1251", "привет всем"), "b": ("UTF-8", "")}
    assert "explode" not in plan(found)
