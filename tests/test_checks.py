"""Rules that compare a record with its print, on literal cases."""

import pytest
from pyspark.sql import functions as F

from galley.operators import checks
from galley.operators.windows import numbered_list_size

from .conftest import DATA

REFS = ["Иванов И.И. Первый труд. М.: Наука, 2001.", "Петров П.П. Второй труд. М.: Наука, 2002.", "Сидоров С.С. Третий труд. М.: Наука, 2003."]
PRINT = "\n".join(["УДК 539.2", "Решётки", "Иванов И.И., Петров П.П.", "a@b.ru", "Для цитирования", "Иванов И.И., Пет-", "ров П.П. Решётки // Журнал.", "Список источников", *[f"{i + 1}. {r}" for i, r in enumerate(REFS)], "Информация об авторах"])
AUTHOR = "struct<surname_ru:string,surname_en:string,org_ru:string,org_en:string,orcid:string,spin:string,email:string>"
SCHEMA = f"article_id int, title_ru string, title_en string, pages string, abstract_ru string, abstract_en string, udk string, received string, accepted string, raw string, authors array<{AUTHOR}>, refs_ru array<string>, refs_en array<string>, keywords_ru array<string>, keywords_en array<string>"


def author(ru, mail=None):
    return (ru, None, "Институт", None, None, None, mail)


def found(spark, rule, printed=PRINT, n_pages=8, **record):
    row = {"article_id": 1, "title_ru": "Решётки", "authors": [author("Иванов", "a@b.ru"), author("Петров")], "refs_ru": REFS} | record
    names = [c.split()[0] for c in SCHEMA.replace(AUTHOR, "").split(", ")]
    prints = spark.createDataFrame([(1, printed, printed, n_pages)], "article_id int, page1 string, all_text string, n_pages int")
    out = checks.check_articles(spark.createDataFrame([tuple(row.get(n) for n in names)], SCHEMA), prints, [rule])
    return sorted((r.severity, r.detail) for r in out.collect())


def test_citation_of_the_print_is_counted_across_line_ends(spark):
    assert found(spark, "author_count") == []
    assert found(spark, "author_count", authors=[author("Иванов")]) == [("error", "1 / 2")]
    assert found(spark, "author_count", PRINT.replace("цитирования", "ссылок")) == [("note", "not countable")]


def test_references_are_looked_for_in_their_own_list(spark):
    lost = PRINT.replace("1. " + REFS[0] + "\n", "")
    assert found(spark, "references") == []
    assert found(spark, "references", REFS[0] + "\n" + lost) == [("error", REFS[0])]
    assert found(spark, "references", PRINT.replace("1. Иванов", "1. Uванов").replace("Список", "Cписок")) == []  # one sound end is enough


def test_sections(spark):
    assert found(spark, "reference_section", refs_en=[]) == [("error", "en: no list")]
    assert found(spark, "reference_section", PRINT.replace("Список", "Перечень"), refs_en=["A.", " ", None]) == [("error", "en: empty 2, 3"), ("note", "en: section not found"), ("note", "ru: section not found")]
    assert found(spark, "reference_count", refs_ru=REFS[:2]) == [("error", "ru: 2 / 3")]


@pytest.mark.parametrize("refs, tail, ok", [(REFS, "", True), (REFS[::-1], "", False), (REFS, "И ещё одна длинная строка после списка\n", False), (REFS, "Короткая\n", True)])
def test_unnumbered_list_is_in_order_without_more(spark, refs, tail, ok):
    printed = PRINT.replace("Информация", tail + "Информация")
    for i in range(3):
        printed = printed.replace(f"\n{i + 1}. ", "\n")
    assert found(spark, "unnumbered_list", printed, refs_ru=refs) == ([] if ok else [("note", "ru")])


def test_emails(spark):
    assert found(spark, "emails") == []
    assert found(spark, "emails", authors=[author("Иванов")]) == [("note", "a@b.ru"), ("note", "none recorded")]
    assert found(spark, "emails", PRINT.replace("a@b.ru", "1a@b.ru")) == []  # a footnote's number before the address
    assert found(spark, "emails", authors=[author("Иванов", "c@d.ru"), author("Петров", "A@B.ru")]) == [("error", "c@d.ru")]


def test_pages_and_page_one(spark):
    assert found(spark, "page_span", pages="5-12") == [] and found(spark, "page_span") == [("error", " / 8")]
    assert found(spark, "surnames", authors=[author("Сидоренко")]) == [("error", "no English surname: Сидоренко"), ("error", "Сидоренко")]
    assert found(spark, "udk", udk="539 . 2") == [] and found(spark, "udk", udk="621.3") == [("error", "621.3")]


def test_no_print_and_null_lists(spark):
    for rule in checks.RULES:
        assert all(detail is not None for _, detail in found(spark, rule, None, None, authors=None, refs_ru=None)), rule
    assert found(spark, "print_missing", None, None) == [("error", "not attached")]
    assert found(spark, "references", None, None) == [] and found(spark, "author_count", None, None) == []


def test_tails_of_addresses_take_a_number_without_counting(spark):
    text = "1. A\n2. URL: x\n3. _Rate\n4. B. P. 278-\n282.\n5.\nC\n9. D"
    assert spark.range(1).select(numbered_list_size(F.lit(text))).first()[0] == 4


def test_a_rule_asks_for_its_own_forms_only(spark):
    from galley import catalog

    assert "all_text" not in str(catalog.queries()["check_word_codes"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString())
