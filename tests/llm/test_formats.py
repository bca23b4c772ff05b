"""Web archives, HTML text, chats and packing: round trips and brute force."""

import hashlib
import html as H
import io
import itertools
import json
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mediacat.llm import chat, html_text, packing, warc

PAGES = "page_id long, url string, html string, digest string, keeper long"


@pytest.mark.parametrize("zip64", [False, True])
def test_archive_round_trip(spark, zip64):
    big = "é" * 600
    rows = [(1, "u1", big), (3, "u3", big), (2, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "a\r\nb", "x" * 999), (None, "n", "y" * 2000), (3, "u3", big)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)
    got = sorted(map(str, (tuple(r) for r in warc.round_trip(df, zip64=zip64).drop("url").collect())))
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        again = h == big and p != 3
        want.append(str((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 3 if again else None)))
    assert got == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_agrees_with_zipfile(zip64):
    out = io.BytesIO()
    z = warc.StoredZipWriter(out, zip64)
    for name, data in (("a", [b"one", b"two"]), ("b/é", []), ("c", [b"PK\x05\x06" + b"0" * 30])):
        z.begin(name)
        for d in data:
            z.write(d)
        z.end()
    z.close()
    raw = out.getvalue()
    found = warc.zip_directory(lambda at, n: raw[at : at + n], len(raw))
    with zipfile.ZipFile(io.BytesIO(raw)) as f:
        assert f.testzip() is None and set(f.namelist()) == set(found)
        assert all(f.read(n) == raw[m.offset : m.offset + m.size] for n, m in found.items())
    with pytest.raises(ValueError):
        warc.zip_directory(lambda at, n: b"x" * n, 100)


def test_directory_of_a_foreign_package_with_comment():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as f:
        f.writestr("x", b"abc")
        f.comment = b"a comment with PK\x05\x06 inside it, long enough to look like a record"
    raw = out.getvalue()
    m = warc.zip_directory(lambda at, n: raw[at : at + n], len(raw))["x"]
    assert raw[m.offset : m.offset + m.size] == b"abc"


def test_records_of_several_archives():
    out = io.BytesIO()
    z = warc.StoredZipWriter(out)
    lines = []
    for name in ("a.warc.gz", "b.warc.gz"):
        z.begin(f"archive/{name}")
        for k in range(3):
            raw = f"{name}{k}".encode()
            lines.append(json.dumps({"filename": name, "offset": z.write(raw), "length": len(raw)}).encode())
        z.end()
    for k, part in enumerate((lines[:2], lines[2:])):
        z.begin(f"indexes/{k}.jsonl")
        z.write(b"\n".join(part))
        z.end()
    z.close()
    raw = out.getvalue()
    members = warc.zip_directory(lambda at, n: raw[at : at + n], len(raw))
    places = warc.record_places(members, lambda m: raw[m.offset : m.offset + m.size])
    assert [raw[a : a + n].decode() for a, n in places] == [f"{x}.warc.gz{k}" for x in "ab" for k in range(3)]
    with pytest.raises(ValueError):
        warc.record_places(members, lambda m: b'{"offset": 0, "length": 1}')


# ---------------------------------------------------------------- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p", ""),
        ("no markup &amp; 1 < 2", "no markup & 1 < 2"),
        ("<title>t</title><body><nav>menu</nav><article><h1>T&eacute;</h1><p>a\n <b>b</b>c<p>d<br>e</article><footer>f</footer>", "Té\na bc\nd e"),
        ("<div class='ad'>buy</div><div id=main><p>one two</p><ul><li>x<li>y</ul></div><section class='comments'><p>c</p></section>", "one two\nx\ny"),
        ("<header>site</header><main><header><h1>H</h1></header><p>body</p><form>f</form><aside>s</aside></main>", "H\nbody"),
        ("<article><p>a</p><script>var x='</p>'</script><style>p{}</style><p hidden>h</p><p>b</p>", "a\nb"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def article(page):
    """The text of a page of the driver's kind, by patterns."""
    s = re.sub(r"</?(?:p|h1)>", "\n", re.search(r"<article>(.*)</article>", page, re.S)[1])
    lines = (" ".join(H.unescape(re.sub(r"<br>|</?b>", lambda m: " " * (m[0] == "<br>"), x)).split()) for x in s.split("\n"))
    return "\n".join(x for x in lines if x)


def test_html_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(want) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_density_decides_without_declared_elements(monkeypatch):
    text = "This sentence belongs to the article and is long enough to be counted as text of it."
    links = "".join(f"<li><a href='/{k}'>Link number {k}</a></li>" for k in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><div><p>{text}</p><p>{text}</p><p>{text}</p></div><div><a href='/x'>Next story</a> <a href='/y'>Last story</a></div></div></body>"
    want = "\n".join([text] * 3)
    assert html_text.main_text(page) == want
    real = html_text.Page.densities

    def constant(self):
        density, sums = real(self)
        return [1.0] * len(density), [1.0 if s else 0.0 for s in sums]

    monkeypatch.setattr(html_text.Page, "densities", constant)
    assert html_text.main_text(page) != want


def test_pages_with_null_repeated_and_clashing_rows(spark):
    text = "Some words of an article that is long enough."
    page = f"<div><p>{text}</p></div>"
    df = spark.createDataFrame([(1, "u", page, "t", 9), (1, "u", page, "t", 9), (None, None, None, "t", 9), (2, "v", "<p>" + "word " * 200_000, "t", 9)], "page_id long, url string, html string, text string, n_chars long")
    rows = sorted(((r.page_id or 0, r.n_chars, len(r.text)) for r in html_text.extract(df).collect()))
    assert rows == [(0, 0, 0), (1, len(text), len(text)), (1, len(text), len(text)), (2, 999_999, 999_999)]


def test_hostile_pages_end():
    for page in ("<div>" * 20000 + "x", '<a href="' * 20000, "<" * 50000, "<p>" * 20000 + "x", "<!--" * 20000, "<b>" * 20000 + "</p>" * 20000):
        html_text.main_text(page)


# ---------------------------------------------------------------- chats

HOSTILE = st.text(alphabet="<|>\\\nian_dmstreé😀", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(HOSTILE, HOSTILE), min_size=1, max_size=5))
def test_turns_round_trip(turns):
    roles, texts = (pa.array(x, pa.large_string()) for x in zip(*turns, strict=True))
    data, offsets, starts = chat.assemble(chat.escape_roles(roles), chat.escape(texts))
    raw = data.tobytes()
    plain = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in zip(chat.escape_roles(roles).to_pylist(), chat.escape(texts).to_pylist(), strict=True))
    assert raw == plain.encode() and offsets[-1] == len(raw)
    parsed = chat.parse(raw)
    assert [(r.decode(), t.decode()) for r, t, _, _ in parsed] == turns
    assert [s for _, _, s, _ in parsed] == starts.tolist()


def test_blocks_do_not_change_the_bytes(monkeypatch):
    roles, texts = pa.array(["user", "assistant"] * 50, pa.large_string()), pa.array([str(k) * k for k in range(100)], pa.large_string())
    whole = chat.assemble(roles, texts)[0].tobytes()
    monkeypatch.setattr(chat, "BLOCK_BYTES", 64)
    assert chat.assemble(roles, texts)[0].tobytes() == whole


def test_chats_with_nulls_ties_and_long_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "assistant", "é<|im_end|>")] + [(9, k, "user", f"t{k}") for k in range(300)]
    df = spark.createDataFrame([(*r, "z", [1]) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss array<long>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 1, 9: 300}
    assert got[1].loss_chars == 2 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256("é<|im_end|>".encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


# ---------------------------------------------------------------- packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_are_optimal(lengths, buckets):
    values = sorted(set(lengths))
    pad = lambda bounds: sum(min(b for b in bounds if b >= x) - x for x in lengths)
    rows = np.array([lengths.count(v) for v in values], dtype=float)
    got = packing.optimal_boundaries(np.array(values, dtype=float), rows, rows * values, buckets)
    best = min(pad((*c, values[-1])) for k in range(buckets) for c in itertools.combinations(values[:-1], min(k, len(values) - 1)))
    assert len(got) <= buckets and got[-1] == values[-1] and pad(got) == best


def test_batches_hold_every_row_within_budget(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.pack(docs, buckets=8, budget=20_000).collect()
    want = {r.doc_id: len(r.text.encode()) + 1 for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in out} == want and len(out) == len(want)
    for _, rows in itertools.groupby(sorted(out, key=lambda r: r.batch), key=lambda r: r.batch):
        rows = list(rows)
        assert len({r.bucket for r in rows}) == 1 and all(r.batch_rows == len(rows) for r in rows)
        assert len(rows) == 1 or len(rows) * rows[0].bucket_tokens <= 20_000
        assert all(r.padding == r.bucket_tokens - r.n_tokens >= 0 for r in rows)


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "x" * 100_000, 1)], "doc_id long, text string, batch long")
    out = packing.pack(df).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 1, 100_001]
    assert packing.pack(df.limit(0)).count() == 0


def test_boundaries_with_one_very_long_text(spark):
    short = [100, 101, 103, 150, 152, 160, 300, 301, 399, 400] * 3
    df = spark.createDataFrame([(x,) for x in [*short, 20_000_000]], "n_tokens long")
    bounds = packing.bucket_boundaries(df, 5)
    pad = lambda bounds: sum(min(b for b in bounds if b >= x) - x for x in [*short, 20_000_000])
    assert pad(bounds) == min(pad((*c, 20_000_000)) for c in itertools.combinations(sorted(set(short)), 4))
    rng = np.random.default_rng(3)
    for _ in range(30):  # against a program that tries every start
        values = np.unique(np.concatenate([rng.integers(1, 400, 120), [10**7]])).astype(float)
        rows, k = rng.integers(1, 9, len(values)).astype(float), int(rng.integers(1, 9))
        cost = lambda i, j: float((rows[i:j] * (values[j - 1] - values[i:j])).sum())
        least = [cost(0, j) if j else 0.0 for j in range(len(values) + 1)]
        for _ in range(k - 1):
            least = [0.0, *(min(least[i] + cost(i, j) for i in range(j)) for j in range(1, len(values) + 1))]
        got = packing.optimal_boundaries(values, rows, rows * values, k)
        at = np.searchsorted(got, values)
        assert len(got) <= k and float((rows * (np.array(got)[at] - values)).sum()) == least[-1]


@pytest.mark.parametrize(
    "wrap",
    [f'<div {x}>%s</div>' for x in ("class='content with-sidebar'", "class='page has-ads'", "class='layout no-comments'", "class='side-by-side'", "id='notice-text'", "class='sidebar'")] + ["<form>%s<input value=x><button>Send</button></form>"],
)
@pytest.mark.parametrize("inner", ["<article>%s</article>", "<div>%s</div>"])
def test_layout_names_and_forms_keep_the_text(wrap, inner):
    text = "A long sentence of the article, with enough words to count as its text."
    assert html_text.main_text("<body>" + wrap % (inner % f"<p>{text}</p><p>{text}</p>") + "</body>") == f"{text}\n{text}"


def test_named_elements_beside_the_text_are_dropped():
    text = "A long sentence of the article, with enough words to count as its text."
    for extra in ("<div class='cookie-banner'>Cookies here</div>", "<div id=sidebar>Short</div>", "<form>Search here <input></form>"):
        assert html_text.main_text(f"<body>{extra}<div><p>{text}</p><p>{text}</p></div></body>") == f"{text}\n{text}"


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ('<div class="cookie-banner-wrapper"><p>We keep cookies on this site.</p></div>', '<div class="comments-area"><p>First! What a long and thoughtful reply this is.</p></div>'),
        ("", '<ol class="comment-list"><li><p>One reader writes a long reply.</p><p>And more of it.</p></li></ol>'),
        ("", '<section id="reader-comments"><article class="c"><p>A reply that is an article.</p></article><article class="c"><p>Another one.</p></article></section>'),
        ("", '<div class="site-footer"><p>All rights reserved by somebody or other.</p></div>'),
        ('<div class="newsletter-box"><p>Have our letter every week.</p></div>', '<div id="disqus_thread"><p>A thread of replies.</p></div>'),
    ],
)
@pytest.mark.parametrize("wrap", ["%s", "<article>%s</article>", '<div class="no-sidebar has-comments">%s</div>', '<div id="side">%s</div>', '<div class="promo-story">%s</div>'])
def test_compound_names_of_comments_and_notices(before, after, wrap):
    text = "The article tells at length what happened, and it does so in whole sentences."
    inner = f"<div><p>{text}</p><p>{text}</p><p>{text}</p></div>"
    assert html_text.main_text(f"<body>{before}{wrap % inner}{after}</body>") == "\n".join([text] * 3)
    if "article" in wrap:
        assert html_text.main_text(f"<body>{before}{wrap % (inner + after)}{after}</body>") == "\n".join([text] * 3)


def test_nothing_outside_a_declared_article():
    text = "The article tells at length what happened, and it does so in whole sentences."
    page = f"<body><div><p>{text} Not this.</p></div><article><p>{text}</p><p>{text}</p><p>{text}</p></article><div><p>{text} Nor this.</p></div></body>"
    assert html_text.main_text(page) == "\n".join([text] * 3)


def test_a_named_element_that_holds_most_of_the_page():
    assert html_text.main_text('<body><div id="side"><p>One two three four.</p><p>Five six seven.</p><p>Eight nine ten.</p></div><div>short footer text</div></body>').startswith("One two three four.\nFive six seven.\nEight nine ten.")
    # A thread longer than the article is still a thread.
    thread = "<p>I think that this is worth a long and wordy reply.</p>" * 20
    assert html_text.main_text(f'<body><div><p>The article is short.</p><p>It ends here.</p></div><div class="comments">{thread}</div></body>') == "The article is short.\nIt ends here."
    assert html_text.main_text('<body><div class="comment-list"><p>Only replies here.</p></div></body>') == "Only replies here."


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<p>The <label>word</label> stays.</p>", "The word stays."),
        ("<p>Before.</p><div><label>Name</label> <span><input></span></div>", "Before."),
        ("<p>Before.</p><div><label for=x>Name</label></div><div><input id=x></div>", "Before."),
        ("<p>Before.</p><label>Mail <input></label><p>After.</p>", "Before.\nAfter."),
    ],
)
def test_labels_go_with_their_controls(inner, text):
    assert html_text.main_text(f"<body><article>{inner}</article></body>") == text


def _pages_without_article(n, seed=3):
    """Pages whose classes tell nothing: paragraphs amid blocks of links and of short lines with links."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    for _ in range(n):
        link = lambda: f"<li><a href=x>{' '.join(rng.choices(words, k=rng.randrange(2, 6)))} nav</a></li>"
        box = lambda: f"<div><ul>{''.join(link() for _ in range(rng.randrange(5, 30)))}</ul></div>"
        teaser = lambda: f"<div>{''.join(f'<p><a href=y>{chr(32).join(rng.choices(words, k=4))} nav</a> nav</p>' for _ in range(rng.randrange(3, 9)))}</div>"
        text = [" ".join(rng.choices(words, k=rng.randrange(20, 90))) for _ in range(rng.randrange(3, 12))]
        body = "".join(f"<p>{t}</p>" for t in text)
        parts = [box() for _ in range(rng.randrange(1, 4))] + [f"<div><div>{body}</div></div>"] + [rng.choice((box, teaser))() for _ in range(rng.randrange(1, 4))]
        yield f"<html><body>{''.join(parts)}</body></html>", "\n".join(text)


def _precision_recall(pages):
    kept = right = wanted = 0
    for html, text in pages:
        got, want = Counter(html_text.main_text(html).split()), Counter(text.split())
        kept, wanted, right = kept + got.total(), wanted + want.total(), right + (got & want).total()
    return right / kept, right / wanted


def test_densities_decide_pages_without_article(monkeypatch):
    pages = list(_pages_without_article(120))
    precision, recall = _precision_recall(pages)
    assert precision >= 0.99 and recall >= 0.99
    plain = html_text.Page.densities

    def constant(page):
        density, sums = plain(page)
        return [float(x > 0) for x in density], [float(x > 0) for x in sums]

    monkeypatch.setattr(html_text.Page, "densities", constant)
    assert _precision_recall(pages)[0] < 0.7
