"""The stored table of marked lines: the same rows as from the lines themselves, and no line is moved again."""

from pyspark.sql import functions as F

from galley.functions.scalars import homoglyph_fix
from galley.operators import mining as m
from galley.plans.views import Views
from galley.sources.text import manuscript_lines

from .conftest import DATA


def test_jobs_over_stored_lines_move_none(spark, tmp_path):
    lines = manuscript_lines(Views(spark, DATA).manuscript.filter("doc_id % 7 = 0"))
    m.store_lines(lines, "lines_of_test", f"file://{tmp_path}/lines", 5)
    stored = spark.table("lines_of_test")
    jobs = {"sections": m.section_texts, "authors": m.author_tokens, "references": m.split_references, "warnings": lambda x: m.parse_warnings(m.parsed_manuscripts(x)), "uploads": lambda x: m.classify_upload(m.parsed_manuscripts(x))}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, job in jobs.items():
            plan = job(stored)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for name, job in jobs.items():
        assert sorted(map(repr, job(stored).collect())) == sorted(map(repr, job(lines).collect())), name


def test_headings_are_those_of_the_whole_key(spark):
    """Shortcuts for headings as they are and for lines with digits change no heading; superscripts become digits in the whole text."""
    rows = ["Abstract", "ABSTRACT:", "Аннотация", "Анн0тация", "Kлючевые слова", "ключевые  слова.", "Key words", "referenses", "Список литературы", "Информация об автор́ах", "Введение¹", "Введ1111ение", "Список источников 2", "abstract ", "Для цитированиё", "References —", ""]
    lines = manuscript_lines(spark.createDataFrame([(1, "\n".join(rows) + "\n ⁰¹²³⁴⁵⁶⁷⁸⁹ x² ")], "doc_id int, text string"))
    key = F.regexp_replace(homoglyph_fix(F.lower("line")), "[^0-9a-zа-яё]+", "")
    assert lines.filter(m.heading_key(F.col("line")) != key).count() == 0
    assert {r.line_no: r.heading for r in m.canon_headings(lines).filter("heading IS NOT NULL").collect()} == {
        1: "abstract_en", 2: "abstract_en", 3: "abstract_ru", 4: "abstract_ru", 5: "keywords_ru", 6: "keywords_ru", 7: "keywords_en", 8: "refs_en", 9: "refs_ru", 10: "info_ru", 13: "refs_ru", 14: "abstract_en", 15: "citation_ru", 16: "refs_en",
    }
    assert [r.line for r in lines.orderBy("line_no").collect()][-1] == "0123456789 x2"
