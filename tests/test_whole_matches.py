"""Scores of whole strings and of all authors, not of prefixes and first authors."""

from types import SimpleNamespace

from galley import catalog
from galley.plans.registry import QUERIES

from .conftest import DATA


def test_bigram_dice_beyond_20_characters(spark):
    ref = spark.createDataFrame([(1, 1, "a" * 20 + "bcdefg", "a" * 20 + "tuvwxz"), (1, 2, "abcdef" * 5, "abcdef" * 5)], "article_id long, pos long, ru string, en string")
    dice = {r["pos"]: r["dice"] for r in QUERIES["bigram_dice"](SimpleNamespace(ref=ref)).collect()}
    assert dice[1] < 0.5 and dice[2] == 1.0  # their first 20 characters are equal


def test_surnames_of_all_authors(spark):
    found = catalog.queries()["surname_by_translit"](spark, DATA).collect()
    assert {r["pos"] for r in found} > {1} and len({(r["article_id"], r["pos"]) for r in found}) == len(found)
