"""compare_norm against Python's own NFKC, character by character and with combining marks."""

import re
import unicodedata

from pyspark.sql import functions as F

from galley.functions.scalars import compare_norm, usual_letters
from galley.plans.views import Views

from .conftest import DATA


def plain(text):
    return None if text is None else re.sub("[^0-9a-zа-я]", "", unicodedata.normalize("NFKC", text).lower().replace("ё", "е"))


def got(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", compare_norm(F.col("t")).alias("n")).collect()
    return [r["n"] for r in sorted(rows)]


def test_all_characters(spark):
    texts = [f"a{chr(i)}б" for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn" and not unicodedata.combining(chr(i))]
    wrong = [(t, n, plain(t)) for t, n in zip(texts, got(spark, texts), strict=True) if n != plain(t)]
    assert not wrong, wrong[:20]


def test_combining_marks(spark):
    texts = [f"{x}{chr(m)} 1" for x in "abcxyzAEOZабвгеикуэяАГЕИКУЯё" for m in range(0x300, 0x370)]
    wrong = [(t, n, plain(t)) for t, n in zip(texts, got(spark, texts), strict=True) if n != plain(t)]
    assert not wrong, [(ascii(t), n, p) for t, n, p in wrong[:20]]


def test_texts(spark):
    texts = ["Рентгеновский диффрактометр", "ﬁeld ﬂow, № 5 … 10 ㎏ and ½", "ＦＵＬＬ １２３ 𝐀𝐛𝟗 Ⅳ x²", "a,b:c", "", None, "café café", "ﬁ" * 10_000 + "й"]
    assert got(spark, texts) == [plain(t) for t in texts]


def test_texts_of_manuscripts_take_the_plain_path(spark):
    kept, rest = usual_letters()
    v = Views(spark, DATA)
    left = v.check_print.select(F.translate(F.lower(F.replace("all_text", F.lit("№"), F.lit("no"))), kept + rest + "ё", "").alias("left")).filter("left <> ''")
    assert left.count() == 0


def test_plain_path_gives_what_pieces_give(spark):
    texts = ["Ёж № 5 — «опыт», т. 1", "ﬁ № Ⅷ й", "", " \n\t", "Ёж́ №№", "K K № ½"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", compare_norm(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == {t: re.sub("[^0-9a-zа-я]", "", unicodedata.normalize("NFKC", t).lower().replace("ё", "е")) for t in texts}
