"""Row-wise operators against plain re-statements, and literal cases."""

import base64
import gzip
import hashlib
import random
import re
import time
import urllib.parse
import zlib

import pytest

from galley.llm import bpe, html, queries, secrets, warc
from tests.conftest import DATA

# ---- byte-level BPE


@pytest.fixture(scope="module")
def enc():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.encoder(f.read(), public_tokenizers.PATTERN)[0]


@pytest.mark.parametrize("seed", range(30))
def test_pieces_do_not_change_ids(enc, seed):
    rng = random.Random(seed)
    t = "".join(rng.choice(["word", "é", " ", "  ", "\n", "\t", " ", "it's", "123", "...", "'s", "語", "\x1c", "a" * 50]) for _ in range(400))
    assert "".join(bpe.pieces(t, 40)) == t
    ids = bpe.encode(enc, t, 40)
    assert ids == enc.encode_ordinary(t)
    assert bpe.decode(enc, ids) == t.encode()


@pytest.mark.parametrize("seed", range(20))
def test_runs_of_white_space_do_not_change_ids(enc, seed):
    rng = random.Random(seed)
    blanks = lambda: "".join(rng.choice(" \t\n\u3000\r\x85") for _ in range(5)) * rng.choice([150, 199, 200, 400]) + rng.choice(["", " ", "\t"])
    t = "".join(rng.choice(["word", "é", " ", "'s", "1", "\x1c", "."]) if rng.random() < 0.6 else blanks() for _ in range(12))
    assert "".join(x for x, _ in bpe.runs(t)) == t
    assert bpe.encode(enc, t) == enc.encode_ordinary(t)


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \n"])
def test_a_million_blanks(enc, blank):
    for t in (f"a{blank * 1_000_000}b", blank * 1_000_000, f"x {blank * 1_000_000}"):
        assert bpe.decode(enc, bpe.encode(enc, t)) == t.encode()


def test_long_text_without_boundary(enc):
    t = "x" * 5000
    assert bpe.pieces(t, 100) == [t]
    assert bpe.encode(enc, t, 100) == enc.encode_ordinary(t)


# ---- secrets


def plain_base(text):
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    ):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


@pytest.mark.parametrize("seed", range(40))
def test_base_spans(seed):
    rng = random.Random(seed)
    t = "".join(rng.choice(["password", "Token", "API_key", "apikey", "secret", ":", "=", " ", '"', "'", "abcdef0123", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMN", "ſecret", "x" * 13, "\n", "é"]) for _ in range(60))
    assert secrets.find_secrets(t)[0] == plain_base(t)


SECRET = "token=abcdefghijklmnop"


def spans_of(text):
    return [(s, e, k) for s, e, k in secrets.find_secrets(text)[1]]


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: urllib.parse.quote(s, safe=""),
        lambda s: "".join(f"%{b:02X}" for b in s.encode()),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"&#{ord(c)};" for c in s),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
        lambda s: base64.b64encode(urllib.parse.quote(base64.b64encode(s.encode()).decode(), safe="").encode()).decode(),
        lambda s: "".join(f"%{b:02x}" for b in "".join(f"%{c:02x}" for c in s.encode()).encode()),
    ],
)
def test_layers_are_unwrapped_and_mapped(wrap):
    coded = wrap(SECRET)
    found = [x for x in spans_of(f"before {coded} after") if x[2] == "assign"]
    assert found
    for start, end, _ in found:
        assert 7 <= start < end <= 7 + len(coded)


def _b64(data):
    return base64.b64encode(data).decode()


@pytest.mark.parametrize(
    "coded",
    [
        _b64(gzip.compress(gzip.compress(SECRET.encode()))),
        _b64(gzip.compress(zlib.compress(SECRET.encode()))),
        _b64(gzip.compress(b"first") + gzip.compress(SECRET.encode())),
        *(glue + _b64(SECRET.encode()) for glue in ("https://h/path/", "key_", "ab", "abc", "abcde")),
        *(glue + _b64(zip_(SECRET.encode())) for glue in ("https://h/path/", "key_", "ab", "a/bc/", "name-x-") for zip_ in (gzip.compress, zlib.compress)),
        _b64(SECRET.encode()).rstrip("=") + "xyz"[: (1 - len(_b64(SECRET.encode()).rstrip("="))) % 4],
        _b64(b"\x00\x01" + SECRET.encode() + b"\xff\xfe"),
        _b64(b"x " + SECRET.encode()),
        _b64(gzip.compress(bytes(9000) + SECRET.encode()) + b"tail"),
        _b64(SECRET.encode("utf-16")),
        _b64(SECRET.encode("utf-16-be")),
        "data/x" + _b64(SECRET.encode("utf-16-le")),
        urllib.parse.quote(gzip.compress(SECRET.encode()), safe=""),
        urllib.parse.quote(zlib.compress(SECRET.encode()), safe=""),
        "".join(f"%{b:02X}" for b in gzip.compress(SECRET.encode())),
        "".join(f"\\x{b:02x}" for b in gzip.compress(SECRET.encode())),
        _b64(b"\xff" + _b64(gzip.compress(b"\x00" + SECRET.encode())).encode() + b"\x07"),
    ],
)
def test_layers_are_a_fixpoint(coded):
    found = [x for x in spans_of(f"before {coded} after") if x[2] == "assign"]
    assert found
    for start, end, _ in found:
        assert 7 <= start < end <= 7 + len(coded)


def test_exact_map_in_partly_binary_base64():
    assert spans_of("before " + _b64(b"\x00\xff\x01" + SECRET.encode() + b"\x00")) == [(11, 41, "assign")]


def test_exact_map_in_percent_text():
    t = "é pass%77ord=abcdefghijkl z"
    assert spans_of(t) == [(2, len(t) - 2, "assign")]


def test_bombs_and_long_lines_stay_small():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    bomb = _b64(gzip.compress(bytes(1 << 24) + b" " + SECRET.encode() + b"x " * (1 << 23)))
    nested = _b64(gzip.compress(_b64(gzip.compress(b"a b " * (1 << 22))).encode() * 20))
    assert [k for *_, k in spans_of(f"{bomb} {nested}")] == ["assign"]
    assert spans_of("x" * 2_000_000 + " %74oken=abcdefghijklmnop") == [(2_000_001, 2_000_025, "assign")]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_cycles_end():
    assert secrets.find_secrets("%25" * 2000)[0] == []
    assert secrets.find_secrets(None) == ([], [])


# ---- WARC


def test_members_and_damage():
    import io

    records = [warc.record(i, f"http://x/{i}", b"y" * (300 * i), None, False) for i in range(4)] + [warc.record(9, None, b"z" * 500, 3, True)]
    data = b"".join(map(warc.member, records))
    read = list(warc.members(io.BytesIO(data), 7))
    assert [m for _, m, _ in read] == records and not any(e for *_, e in read)
    parsed = [warc.parse(m) for _, m, _ in read]
    assert [p["page_id"] for p in parsed] == [0, 1, 2, 3, 9] and all(p["error"] is None for p in parsed)
    assert parsed[4]["payload_bytes"] == 500 and parsed[4]["refers_to"] == 3 and parsed[4]["payload_digest"] == hashlib.sha256(b"z" * 500).hexdigest()
    assert list(warc.members(io.BytesIO(data[:-5]), 64))[-1][2] == "cut off"
    broken = records[1].replace(b"yyyy", b"yyyx", 1)
    assert warc.parse(broken)["error"] == "block digest differs"
    assert warc.parse(records[1][:-1])["error"] == "content length does not frame the block"


def test_header_values_hold_no_line_ends():
    p = warc.parse(warc.record(1, "http://x/\r\nWARC-Type: revisit", b"", None, False))
    assert p["record_type"] == "response" and p["error"] is None


FOLDS = {"mail": "\r\n", "key": "\n    ", "escaped": "\\n", "escaped twice": "\\r\\n"}


def folded(data, width, fold):
    run = base64.b64encode(data).decode()
    return fold.join(run[i : i + width] for i in range(0, len(run), width))


@pytest.mark.parametrize("fold", FOLDS)
@pytest.mark.parametrize("width", [64, 76, 61])
def test_folded_base64_is_one_run(fold, width):
    prose = "".join(f"some plain words {i}, " for i in range(9))
    inner = f"{prose}password = {'q' * 40} {prose}"
    at = inner.index("password")
    text = f"Body: {folded(inner.encode(), width, FOLDS[fold])}\nBye"
    run = base64.b64encode(inner.encode()).decode()
    place = lambda k: 6 + k + k // width * len(FOLDS[fold])
    start, end = place(at // 3 * 4 + at % 3), place((at + 50) // 3 * 4 + (at + 50) % 3 + 1) + 1
    assert (start, end, "assign") in spans_of(text) and len(run) > 3 * width
    zipped = gzip.compress(inner.encode() + bytes(range(256)) * 2)
    text = f"Body:\n{folded(zipped, width, FOLDS[fold])}\nBye"
    assert any(k == "assign" and s == 6 for s, _, k in spans_of(text))


def test_long_runs_take_time_in_proportion():
    rng = random.Random(5)
    times = []
    for size in (200_000, 800_000):
        run = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=size))
        began = time.perf_counter()
        secrets.find_secrets(f"{run} {'eJ' * (size // 20)} {'H4sI' * (size // 40)}")
        times.append(time.perf_counter() - began)
    assert times[1] < 8 * times[0] + 2 and times[1] < 20


def test_query_by_value(spark):
    """What op6_secrets returns of a table, computed row by row."""
    rows = {r["doc_id"]: r for r in queries.op6_secrets(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        base = plain_base(d["text"] or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        found, r = secrets.find_secrets(d["text"])[1], rows[d["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b[2] == k for b in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for s, e, k in found) and set(base) <= set(found)


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>Head</title><script>var x="</p>";</script></head><body>
<header><p>Site header text here, long enough to look like prose.</p></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies. Accept them all, please, now.</p></div><aside><p>Side text, with words.</p></aside>
{body}
<div class="comments"><p>First! I liked this article very much, thank you.</p><p>Me too, it was a good one.</p></div>
<form><p>Subscribe to our letter.</p><input name=x></form><footer>&copy; us</footer></body></html>"""
PROSE = "This is a sentence of the article, and it goes on for a while. Then there is another one; it ends here."


def test_article_is_whole_and_alone():
    body = f"<article><h1>Title &amp; more</h1><p>{PROSE}<p>Short.</p><ul><li>item one</li><li>item two</ul><p>A  <b>bold</b>\n word<br>next &eacute;.</article>"
    assert html.main_text(PAGE.format(body=body)) == f"Title & more\n{PROSE}\nShort.\nitem one\nitem two\nA bold word next é."


LONG_PROSE = f"{PROSE} {PROSE} And a third one follows, as they do."
PARTS = {
    "<ul><li>Six words are in this one</li><li>And six are in that one</li></ul>": ["Six words are in this one", "And six are in that one"],
    "<table><tr><th>Year<th>Sum<tr><td>1999<td>12</table>": ["Year", "Sum", "1999", "12"],
    "<dl><dt>Term<dd>What it means.</dl>": ["Term", "What it means."],
    "<figure><img src=x><figcaption>What the picture shows</figcaption></figure>": ["What the picture shows"],
    "<ul><li><a href=/1>First link</a></li><li><a href=/2>Second link</a></li></ul>": ["First link", "Second link"],
    "<h2>Part</h2><pre>x = 1</pre><blockquote>So it was said.</blockquote>": ["Part", "x = 1", "So it was said."],
}


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("box", ["article", "main", "div class=x1"])
def test_short_parts_of_long_articles_stay(part, box):
    if "href" in part and box.startswith("div"):
        return  # links in an element that nothing tells to be the article may be a menu
    prose = "".join(f"<p>{LONG_PROSE} {i}.</p>" for i in range(4))
    body = f"<{box}><h1>Title</h1>{prose}{part}{prose}</{box.split()[0]}>"
    lines = [f"{LONG_PROSE} {i}." for i in range(4)]
    assert html.main_text(PAGE.format(body=body)).split("\n") == ["Title", *lines, *PARTS[part], *lines]


def test_headings_in_an_articles_header():
    prose = "".join(f"<p>{LONG_PROSE} {i}.</p>" for i in range(4))
    for head in ("<header><h1>Title</h1><p>By someone, today.</p></header>", "<div class='article-header'><h1>Title</h1><span>By someone</span></div>"):
        text = html.main_text(PAGE.format(body=f"<article>{head}{prose}<div class='share'>Share this, do.</div></article>")).split("\n")
        assert text == ["Title", *[f"{LONG_PROSE} {i}." for i in range(4)]]


def test_article_by_ratios_only():
    body = f"<div class=x1><div class=x2><p>{PROSE}</p><p>{PROSE} Again.</p><p>Tiny.</p></div></div>"
    assert html.main_text(PAGE.format(body=body)) == f"{PROSE}\n{PROSE} Again.\nTiny."


def test_names_are_only_a_weight():
    both = f"{PROSE}\n{PROSE} Again."
    prose = both.replace("\n", "</p><p>")
    meta = f"<div class='post-meta'>by X</div><div class=x1><p>{prose}</p></div>"
    assert both in html.main_text(f"<body>{meta}</body>")
    assert html.main_text(PAGE.format(body=meta)) in (both, f"by X\n{both}")
    article = f"<article><h1>Title</h1><p>{prose}</p></article>"
    for wrapper in ("div class='layout has-sidebar'", "div class='sidebar-layout'", "div id=page-header", "form", "div role=search"):
        assert html.main_text(PAGE.format(body=f"<{wrapper}>{article}</{wrapper.split()[0]}>")) == f"Title\n{both}", wrapper
    for wrapper in ("layout has-sidebar", "sidebar-layout", "content"):
        assert html.main_text(PAGE.format(body=f"<div class='{wrapper}'><div class=x1><p>{prose}</p></div></div>")) == both, wrapper
    assert html.main_text(f"<body><div hidden><p>{prose}</p></div><p>Seen, only this.</p></body>") == "Seen, only this."


def test_odd_pages():
    assert html.main_text(None) == "" and html.main_text("") == ""
    assert html.main_text("just text") == "just text"
    assert html.main_text("<article><p>cut off &amp") == "cut off &"
    assert html.main_text("<article>a<!-- <p>no</p> --><![CDATA[x]]>b</article>") == "ab"


def test_quotes_in_unquoted_values_and_deep_nesting():
    assert html.main_text("<article><p title=it's>First.</p><p>We don't lose this.</p></article>") == "First.\nWe don't lose this."
    assert html.main_text('<p title="a > b">One, two.</p><p class=x"y>Three, four.</p>') == "One, two.\nThree, four."
    began = time.perf_counter()
    assert html.main_text("<div>text, of a block. " * 20_000).count("text") > 10_000
    assert time.perf_counter() - began < 10


def test_ratios_find_articles_without_tags_and_names(spark):
    """With all telling tags made div and all names dropped, what is left to go by is ratios."""
    recall, precision = [], []
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        wanted = html.main_text(r["html"]).split("\n")
        bare = re.sub(r"<(/?)(article|main|nav|header|footer|aside|form)\b", r"<\1div", r["html"])
        got = html.main_text(re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", bare)).split("\n")
        both = sum(len(b) for b in wanted if b in got)
        recall.append(both / sum(map(len, wanted)))
        precision.append(both / sum(map(len, got)))
    assert sum(recall) / len(recall) > 0.95 and sum(precision) / len(precision) > 0.85


def test_generated_pages(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        import html as entities

        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert html.main_text(r["html"]) == "\n".join(b for b in blocks if b)

