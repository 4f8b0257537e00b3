"""Author lines and lists of references as the reference's parser reads them: what a plain pattern would miss or take wrongly."""

from galley.operators import mining


def lines_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id int, text string")


def authors(spark, line, more=""):
    text = f"DOI 10.1/x\nЗаглавие А.А. Харкевича\n{line}\n{more}\nАннотация\nТекст."
    rows = mining.author_tokens(lines_of(spark, text)).orderBy("pos").collect()
    return [(r.initials, r.surname, r.indices) for r in rows]


def test_author_lines(spark):
    assert authors(spark, "М.А. Басараб1, Yu.A. Бобков2 1, 2 МГТУ им. Н.Э. Баумана (Москва, Россия)") == [("М.А.", "Басараб", [1]), ("Yu.A.", "Бобков", [2])]
    assert authors(spark, "Б. Балбашио3, И. Ньютона колледж") == [("Б.", "Балбашио", [3])]
    assert authors(spark, "Н.А Волков1, 2, Е.В. Роганова7 Б.С. Долговесов8") == [("Н.А.", "Волков", [1, 2]), ("Е.В.", "Роганова", [7]), ("Б.С.", "Долговесов", [8])]
    assert authors(spark, "1,2 N.O. Sitkov, Z.M. Yuldashev") == [("N.O.", "Sitkov", []), ("Z.M.", "Yuldashev", [])]
    assert authors(spark, "Али Султан Маея1, Аli Mayya2") == [("А.С.", "Маея", [1]), ("A.", "Mayya", [2])]
    assert authors(spark, "А.А. Иванов1–3, Соня Хилал3, Р. Ишуков5 3a@mail.ru") == [("А.А.", "Иванов", [1, 2, 3]), ("С.", "Хилал", [3]), ("Р.", "Ишуков", [5])]
    assert authors(spark, "И.А. Клещарь5,", "Л.Д. Щербаков6\nА.А. Леонова – Филиал") == [("И.А.", "Клещарь", [5]), ("Л.Д.", "Щербаков", [6])]


def references(spark, *lines):
    text = "\n".join(("Список источников", *lines, "Информация об авторах"))
    return [r.ref for r in mining.split_references(lines_of(spark, text)).orderBy("pos").collect()]


def test_references_without_numbers(spark):
    assert references(spark, "Иванов И.И. Волны. 2020. V. 82.", "P. 103985.", "Петров П.П. Среда") == ["Иванов И.И. Волны. 2020. V. 82. P. 103985.", "Петров П.П. Среда"]
    assert references(spark, "Патент / А.Г. Сайбель,", "П.А. Сидоров. 2008.", "[2] Second one", "1) Third") == ["Патент / А.Г. Сайбель, П.А. Сидоров. 2008.", "Second one", "Third"]
    assert references(spark, "S.P. Ong. Data https://a.b/Human_Resp", "_Rate (дата обращения: 1.1.2020)", "Kudrolli, Gollub J.P. Waves", "in a box") == ["S.P. Ong. Data https://a.b/Human_Resp_Rate (дата обращения: 1.1.2020)", "Kudrolli, Gollub J.P. Waves in a box"]
    assert references(spark, "One, doi 10.1234/ab", "Second without names", "Third doi 10.1234/DI_", "SellersnMarketplaces_2024 (x)") == ["One, doi 10.1234/ab", "Second without names Third doi 10.1234/DI_ SellersnMarketplaces_2024 (x)"]
    assert references(spark, "Первая.", "", "Вторая.", "Приложение", "1. Формула") == ["Первая.", "Вторая."]
    assert references(spark, "Первая,", "\u2028вторая.", "третья", "четвёртая") == ["Первая, вторая.", "третья", "четвёртая"]


def test_lines_and_texts_give_the_same(spark):
    from galley.plans.views import Views
    from galley.sources.text import manuscript_lines

    from .conftest import DATA

    docs = Views(spark, DATA).manuscript.filter("doc_id % 11 = 0").select("doc_id", "text").union(lines_of(spark, "DOI 10.1/x\nA\n\nReferences\nOne\n\u2028two\n_three\nDOI: 10.2/y\n© x\nB.B. Bb1\nIntro\nAbstract\n1. x\nОдобрена после рецензирования 03.02.2000", "", "x"))
    jobs = (mining.section_texts, mining.author_tokens, mining.split_references, mining.title_lines, mining.org_chunks, mining.milestone_dates, lambda x: mining.parsed_manuscripts(x))
    for job in jobs:
        assert sorted(map(repr, job(docs).collect())) == sorted(map(repr, job(manuscript_lines(docs)).collect()))


def test_surnames_compare_each_word_once(spark):
    """Equal words of an article are one, and a surname or a word that is null changes nothing for the others."""
    ru = spark.createDataFrame([(1, 1, "Иванов"), (1, 2, None), (1, 3, "Яша"), (2, 1, "Ли")], "article_id int, pos int, surname string")
    words = spark.createDataFrame([(1, x) for x in ("Institute", "Institute", "Ivanov", "ivanov", None, "Yasha")] + [(2, None)], "article_id int, word string")
    found = mining.surname_by_translit(ru, words)
    assert {(r.article_id, r.pos): r.word for r in found.collect()} == {(1, 1): "ivanov", (1, 2): "ivanov", (1, 3): "Yasha", (2, 1): None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein") == 1 and "collect_set" in plan
