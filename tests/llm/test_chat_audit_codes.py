"""Chats from logs, divergence of sources, vector codes: literal cases and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from galley.llm import chat, divergence, vectors

LOG = "conv_id long, turn long, message_id string, seq long, kind string, role string, text string"


def formatted(spark, log):
    pieces = chat.format_log(spark.createDataFrame(log, LOG)).collect()
    out = defaultdict(str)
    for p in sorted(pieces, key=lambda p: (p["conv_id"], p["at"]["turn"], p["at"]["message_id"])):
        out[p["conv_id"]] += p["formatted"]
    return {c: chat.parsed(t) for c, t in out.items()}, out


def test_events_are_folded_by_message(spark):
    log = [
        (1, 0, "q", 1, "open", "user", None), (1, 0, "q", 2, "delta", None, "Helo"), (1, 0, "q", 9, "edit", None, "Hello"), (1, 0, "q", 10, "delta", None, "!"),
        (1, 1, "a", 3, "open", "assistant", None), (1, 1, "a", 5, "delta", None, "bad "), (1, 1, "a", 4, "delta", None, "A "), (1, 1, "a", 6, "regenerate", None, None),
        (1, 1, "a", 8, "delta", None, "there"), (1, 1, "a", 7, "delta", None, "Hi "), (1, 1, "a", 7, "delta", None, "Hi "),  # delivered twice
        (1, 2, "x", 1, "open", "user", None), (1, 2, "x", 2, "delta", None, "gone"), (1, 2, "x", 3, "delete", None, None), (1, 2, "x", 4, "delta", None, "still gone"),
        (1, 3, "n", 1, "delta", None, None), (1, 3, "n", 2, "typing", None, "ignored"), (1, 3, "n", None, None, None, "ignored"),
        (2, 0, "b", 1, "open", "user", None), (2, 0, "a", 1, "open", "system", None),
    ]
    random.Random(1).shuffle(log)
    assert formatted(spark, log)[0] == {1: [("user", "Hello!"), ("assistant", "Hi there"), ("", "")], 2: [("system", ""), ("user", "")]}


@pytest.mark.parametrize("seed", range(200))
def test_template_is_reversible(seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(["\\", "#", "##", "###", "<", "</turn>", "/turn>", ":", "\n", "### user:\n", "</", "é", "a", " "]) for _ in range(rng.randrange(12)))
    turns = [(text(), text()) for _ in range(4)]
    whole, spans = "", []
    for role, said in turns:
        made, start, end = chat.rendered(role, said)
        spans.append((len(whole) + start, len(whole) + end))
        whole += made
    assert chat.parsed(whole) == turns
    assert [chat.unescaped(whole[a:b]) for a, b in spans] == [t for _, t in turns]
    for _, said in turns:  # no control string of the template is left unescaped
        assert not chat.re.search(r"(?<!\\)(?:\\\\)*(###|</turn>)", chat.rendered("r", said)[0][len("### r:\n") : -len("</turn>\n")])


def test_damaged_output_is_noticed():
    made = chat.rendered("user", "text")[0]
    for damaged in (made[:-1], made[1:], made.replace("</turn>", ""), made + "x"):
        with pytest.raises(ValueError):
            chat.parsed(damaged)


def test_pieces_of_long_conversations(spark, monkeypatch):
    """Conversations cut into many pieces and dealt over many tasks, without AQE's help."""
    monkeypatch.setattr(chat, "PIECE_CHARS", 50)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), "word " * rng.randrange(9)) for c, n in ((1, 900), (2, 3), (3, 40), (4, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "13")):
        spark.conf.set(key, value)
    try:
        found = {r["conv_id"]: r for r in chat.round_trip(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for c in (1, 2, 3, 4):
        own = [r for r in rows if r[0] == c]
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        assert found[c]["n_turns"] == len(own) and found[c]["loss_chars"] == len(loss)
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        assert found[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert found[c]["formatted_chars"] == sum(len(chat.rendered(r, t)[0]) for _, _, r, t in own)


# ---- divergence of sources


def plain_audit(rows, least):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = (x or "" for x in (text, lang, source))
        found = Counter(divergence.TERM.findall(text.encode().lower()))
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(found.keys())
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def shares(sources, lang=lang, kept=kept):
            own = [sum(counts[lang, s][t] for s in sources) for t in kept]
            return [1 + 10**9 * (n + 5) // (sum(own) + 5 * len(kept)) for n in own]

        mine, all_of = shares([source]), shares([s for la, s in groups if la == lang])
        pairs = sorted((-sum(abs(p - q) for p, q in zip(mine, shares([o]), strict=True)), o) for la, o in groups if la == lang and o != source)
        terms = sorted((q - p, t.decode()) for t, p, q in zip(kept, mine, all_of, strict=True) if counts[lang, source][t] and p > q)[:50]
        out += [(lang, source, part, item, -value, i + 1) for part, listed in (("pair", pairs), ("term", terms)) for i, (value, item) in enumerate(listed)]
    return sorted(out)


@pytest.mark.parametrize("block_terms, chunk_sources", [(4, 3), (512, 32)])
def test_divergence_by_brute_force(spark, block_terms, chunk_sources):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "aAéÉß" for b in ("x", "Y", "zé", "漢")]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(30))) + ".,1", rng.choice(["en", "de", None]), f"s{rng.randrange(9)}") for _ in range(400)]
    rows += [(None, "en", "none"), ("", "en", "empty"), ("only here", "xx", "one"), ("only here", "xx", "two"), ("ax " * 5, "en", None)] + [("copy ax", "en", s) for s in ("c1", "c2")] * 20
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    found = divergence.divergence(df, least_documents=30, block_terms=block_terms, chunk_sources=chunk_sources)
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, 30)


def test_trees_share_equal_subtrees():
    grid = np.array([[1, 2, 0, 0, 1, 2, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0], [0] * 8, [1, 2, 0, 0, 3, 0, 0, 0]])
    trees = divergence.Trees(grid)
    assert len(set(trees.roots.tolist())) == 3  # equal rows have one root
    assert [len(left) for left, _ in trees.nodes] == [3, 3, 3]  # (1,2), (0,0), (3,0); and above them
    priced = []

    def price(kind, x, y):
        priced.append(len(x))
        return np.abs(x - y)

    a, b = np.triu_indices(4, 1)
    values = trees.priced(a, b, np.zeros(len(a), np.int64), price)
    assert values.tolist() == [int(np.abs(grid[i] - grid[j]).sum()) for i, j in zip(a, b, strict=True)]
    assert sum(priced) <= 8  # of 48 pairs of leaves


def test_shares_beyond_a_long():
    count, total = np.array([0, 2**62]), np.array([2**62 + 10, 2**62 + 10])
    assert divergence.shares(count, total).tolist() == [1 + 5 * 10**9 // (2**62 + 10), 1 + 10**9 * (2**62 + 5) // (2**62 + 10)]


# ---- vector codes


@pytest.mark.parametrize("spread, size", [(3, 4), (600, 16), (5, 2), (1, 1)])
def test_nearest_is_that_of_all_entries(spread, size):
    rng = np.random.default_rng(spread)
    points, q = (rng.integers(-spread, spread + 1, (n, size)).astype(float) for n in (256, 2000))
    square = ((q[:, None] - points[None]) ** 2).sum(axis=2)
    index, best = vectors.nearest(vectors.gnat(points), q)
    assert (index == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()  # of equal ones the lowest
    large = lambda x: np.array([[int(v) * 10**25 for v in row] for row in x], dtype=object)
    index, best = vectors.nearest(vectors.gnat(large(points)), large(q[:100]))
    assert (index == square[:100].argmin(axis=1)).all() and [int(x) for x in best] == [int(x) * 10**50 for x in square[:100].min(axis=1)]


def test_subtrees_are_left_out(monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.integers(-5000, 5000, (16, 8))
    points = (centres[np.arange(256) % 16] + rng.integers(-40, 40, (256, 8))).astype(float)
    q = (centres[rng.integers(0, 16, 500)] + rng.integers(-40, 40, (500, 8))).astype(float)
    tree, compared, squares = vectors.gnat(points), [], vectors.squares
    monkeypatch.setattr(vectors, "squares", lambda a, b: compared.append(len(a) * len(b)) or squares(a, b))
    vectors.nearest(tree, q)
    assert sum(compared) < 0.5 * 500 * 256


def plain_codes(rows, entries, rounds, parts=4):
    kept = sorted((i, [int(np.floor(1024 * np.float64(x))) for x in v], label) for i, v, label in rows)
    size = len(kept[0][1]) // parts
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((away(part(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                held[p, near(v, p)[1]].append(part(v, p))
        for (p, e), vs in held.items():
            books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    errors = Counter()
    coded = {i: [near(v, p) for p in range(parts)] for i, v, _ in kept}
    for i, _, label in kept:
        errors[label] += sum(d for d, _ in coded[i])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in coded[i]), sum(d for d, _ in coded[i]), errors[label], digest) for i, _, label in kept}


def test_codes_by_brute_force(spark):
    rng = random.Random(11)
    rows = [(i * 3 % 401, [float(np.float32(rng.gauss(0, 1) * (1 if i % 3 else 40))) for _ in range(8)], None if i % 5 == 0 else i % 7 if i % 2 else 1) for i in range(401)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        found = {r["vec_id"]: tuple(r)[1:] for r in vectors.compress(df, entries=20, rounds=3).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    assert found == plain_codes(rows, 20, 3)


def test_integers_beyond_floats():
    x = np.array([[1e30, -0.0001, 3.5], [-1e30, 2.0**60, 1e308]])
    whole = vectors.integers(x, 2.0**20)
    assert whole.tolist() == [[int(1e30) * 1024, -1, 3584], [-int(1e30) * 1024, 2**70, int(1e308) * 1024]]


def test_hot_keys_are_joined_apart(spark):
    from galley.llm.common import join_hot, stored

    rows = stored(spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'hot' ELSE concat('k', id) END AS key"), "rows")
    dim = rows.groupBy("key").agg(F.count("*").alias("n"))
    assert sorted((r["id"], r["n"]) for r in join_hot(rows, dim, "key").collect()) == [(i, 1 if i % 3 == 2 else 1667) for i in range(5000)]
    few = dim.filter("key = 'hot' OR key = 'k5'")
    found = {r["id"]: r["n"] for r in join_hot(rows, few, "key", "left").collect()}
    assert len(found) == 5000 and all(n == (1667 if i % 3 == 1 else 1 if i == 5 else None) for i, n in found.items())
    assert join_hot(rows.limit(0), few, "key", "left").count() == 0


def test_many_pages_of_one_payload(spark):
    from galley.llm import warc

    html = "<p>" + "x" * 200
    pages = spark.createDataFrame([(i, f"u{i}", html if i % 3 else html + str(i)) for i in range(2, 1500)] + [(-1, "e", None), (-2, "f", "")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["refers_to"], r["revisit"]) for r in warc.page_records(pages).collect()}
    assert got == {i: (2, True) if i > 2 and i % 3 else (None, False) for i in [*range(2, 1500), -1, -2]}
