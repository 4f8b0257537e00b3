"""N-gram joins, stored indexes, sketches and pages: the same rows as the plain way, and less read."""

import random

import pytest
from pyspark.sql import functions as F

from galley.operators import filters, grams, joins, sketches
from galley.sources import paging
from galley.sources.versions import Tables


def test_containing_is_all_pairs_that_contain(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("абвг ") for _ in range(n))
    texts = {i: word(rng.randrange(0, 30)) for i in range(300)} | {900: "", 901: None}
    needles = {i: word(rng.randrange(1, 7)) for i in range(80)} | {900: "", 901: "нет такого", 902: None}
    found = grams.containing(spark.createDataFrame(list(texts.items()), "text_id long, text string"), spark.createDataFrame(list(needles.items()), "needle_id long, needle string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {tuple(r) for r in found.collect()} == {(n, t) for n, needle in needles.items() for t, text in texts.items() if needle and text and needle in text}
    assert found.count() == found.distinct().count()


def test_no_nested_loops_between_journals(spark):
    old = spark.createDataFrame([(1, "Физика"), (2, "Журнал Физика и химия"), (3, "Хим"), (4, "")], "id long, name string")
    new = spark.createDataFrame([(10, "физика"), (11, "Химия"), (12, "Физика и химия")], "id long, name string")
    found = joins.map_legacy_journals(old, new)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 10, "exact"), (2, 12, "part"), (3, 11, "part"), (4, None, "new")]


@pytest.mark.parametrize("needle", ["Решёт", "ре", "я", "", "Иванов", "нигде", "Журнал Б", "тки. И"])
def test_indexed_search_finds_the_same(spark, tmp_path, needle):
    article = spark.createDataFrame([(i, f"Решетки {i}. Итог" if i % 3 else f"Поле {i}", f"И.И. Иванов{i % 7}", i % 2, None) for i in range(200)], "id long, title string, authors string, journal_id long, deleted_at timestamp")
    author = spark.createDataFrame([(i, f"Реброва {i}") for i in range(0, 200, 5)], "article_id long, full_name string")
    journal = spark.createDataFrame([(0, "Журнал А"), (1, "Журнал Б")], "id long, name string")
    tables = Tables(spark, f"file://{tmp_path}/index")
    grams.build_search_index(tables, article, author)
    plain = filters.search_all(article, author, journal, needle, 200).collect()
    assert grams.indexed_search(tables, article, author, journal, needle, 200).collect() == plain


def test_a_search_reads_the_parts_of_its_grams(spark, tmp_path):
    article = spark.createDataFrame([(i, f"title {i * 7919}", "", 1, None) for i in range(500)], "id long, title string, authors string, journal_id long, deleted_at timestamp")
    author, tables = spark.createDataFrame([], "article_id long, full_name string"), Tables(spark, f"file://{tmp_path}/index")
    grams.build_search_index(tables, article, author)
    parts = tables.parts_of("grams", spark.createDataFrame([("791",)], "g string"))
    assert len(parts) == 1 and len(tables.read("grams", parts=parts).inputFiles()) < len(tables.read("grams").inputFiles()) / 10


def test_sketches_of_issues_add_up(spark):
    article = spark.range(3000).selectExpr("id", "id % 60 AS issue_id")
    author = spark.range(30_000).selectExpr("id % 3000 AS article_id", "concat('Имя', id * 7919 % 20011) AS full_name")
    stored = sketches.author_sketches(author, article).withColumn("year", F.col("issue_id") % 6)
    own = author.join(article.withColumnRenamed("id", "article_id"), "article_id").withColumn("year", F.col("issue_id") % 6)
    for by in (["issue_id"], ["year"]):
        exact = own.groupBy(*by).agg(F.count_distinct("full_name").alias("n"))
        rows = sketches.compared(sketches.rolled_up(stored, by), exact, by).collect()
        assert len(rows) == (60 if by == ["issue_id"] else 6) and all(r["close"] for r in rows)
    total = stored.agg(F.hll_sketch_estimate(F.hll_union_agg("authors")).alias("n")).first()["n"]
    assert abs(total - 20011) < sketches.ERROR * 20011


def test_pages_open_their_ranges_only(spark, tmp_path):
    path = f"{tmp_path}/pages"
    t = spark.range(5000).selectExpr("id * 3 AS id", "concat('t', id) AS title")
    paging.store_pages(t, path, rows=300)
    pages = paging.Pages(spark, path)
    assert len(pages.sizes) > 10 and pages.total == 5000
    want = sorted((r["id"] for r in t.collect()), reverse=True)
    for number in (1, 2, 7, 50, 99, 100, 101):
        shown = pages.page(number, 50)
        assert [r["id"] for r in shown.collect()] == want[(number - 1) * 50 : number * 50]
        assert shown._jdf.queryExecution().executedPlan().toString().count("PartitionFilters") == 1
    assert pages.page(3, 50).first()["pages"] == 100
    read = [sum(n for no, n in pages.sizes if no in ranges) for ranges in ([0, 1], [len(pages.sizes) - 1])]
    assert max(read) < 1500  # rows of a page's ranges, of 5,000


def plain_chain(pairs):
    best = (0, ())
    for i, p in enumerate(sorted(pairs)):
        pass
    pairs = sorted(pairs)

    def walk(chain, total):
        nonlocal best
        key = (total, tuple((-r, -e) for r, e, _ in chain))
        best = max(best, key)
        for p in pairs:
            if not chain or p[0] > chain[-1][0] and p[1] > chain[-1][1]:
                walk([*chain, p], total + round(p[2] * 1_000_000))

    walk([], 0)
    return [(-r, -e) for r, e in best[1]]


@pytest.mark.parametrize("seed", range(30))
def test_chain_is_the_best_of_all(seed):
    rng = random.Random(seed)
    pairs = [(r, e, rng.choice([0.5, 0.6, 0.7, 1.0])) for r in range(1, 6) for e in range(1, 6) if rng.random() < 0.4]
    assert [(r, e) for r, e, _ in joins.best_chain(pairs)] == plain_chain(pairs)


def test_long_reference_lists(spark):
    import time

    ru = spark.range(1, 501).selectExpr("1L AS article_id", "cast(id AS int) AS pos", "concat('Петров', translate(cast(id AS string), '0123456789', 'абвгдежзик'), ' А.А. Труд ', id, '. doi 10.1/first 10.1000/x', id) AS text")
    en = spark.range(1, 501).selectExpr("1L AS article_id", "cast(id AS int) AS pos", "concat('Someone else. Work. 10.1000/x', id, ' and 10.2/y') AS text")
    began = time.perf_counter()
    rows = joins.align_references(ru, en).collect()
    assert time.perf_counter() - began < 60
    assert sorted((r["ru_pos"], r["en_pos"]) for r in rows) == [(i, i) for i in range(1, 501)]


def test_texts_are_cut_once_and_grams_are_not_moved_to_be_told_apart(spark, tmp_path):
    from pyspark.sql import functions as F

    from galley.operators import grams
    from galley.sources.versions import Tables

    rows = spark.createDataFrame([("абвг",), ("a😀b",), ("",), (None,)], "t string")
    cut = rows.select(grams.pieces(F.lower("t"), 1, 3).alias("p"))
    assert [r.p for r in cut.collect()] == [["а", "б", "в", "г", "абв", "бвг"], ["a", "😀", "b", "a😀b"], [], []]
    assert cut._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0].count("lower(") == 1
    tables = Tables(spark, str(tmp_path / "grams"))
    article = spark.createDataFrame([(1, "Ёж", "ёж"), (2, None, "")], "id int, title string, authors string")
    grams.build_search_index(tables, article, spark.createDataFrame([(1, "еж"), (2, "ж")], "article_id int, full_name string"))
    assert sorted((r.gram, r.id) for r in tables.read("grams").collect()) == [("е", 1), ("еж", 1), ("ж", 1), ("ж", 2)]
