"""Token, text, URL and benchmark operators against libraries and brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontamination, html_text, token_counts, url_filter, wavelet_output
from tests.llm.conftest import BENCH, TEXTS, same

SF = "/root/testdata/sf0.001"
TIK, JSON, PIECES = (P.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TIK, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_the_library(spark, docs, no_docs, tik):
    def want(rows):
        for i, t in rows:
            ids = tik.encode_ordinary(t or "")
            yield i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    same(byte_bpe.round_trip(docs, TIK, P.PATTERN), list(want(TEXTS)), columns)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    same(byte_bpe.round_trip(table, TIK, P.PATTERN), list(want([(r.doc_id, r.text) for r in table.collect()])), columns)
    assert byte_bpe.round_trip(no_docs, TIK, P.PATTERN).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(docs, TIK, P.PATTERN), TIK, P.PATTERN)
    same(back, [(i, bytearray((t or "").encode())) for i, t in TEXTS], ["doc_id", "decoded"])


def test_byte_bpe_holds_few_chunks(tik):
    """The pipeline's last stage has little memory left: many distinct words in one batch do not all stay."""
    texts = [" ".join(f"{i:x}" for i in range(n, n + 100_000)) for n in range(100_000, 1_000_000, 100_000)]
    code = byte_bpe.Encoder(TIK, P.PATTERN)
    got = code.cache.encode(texts)
    assert [ids.tolist() for ids in got[-2:]] == [tik.encode(t, disallowed_special=()) for t in texts[-2:]]
    assert len(code.cache.known) < 900_000


def test_byte_bpe_random_texts(tik):
    order = random.Random(4)
    code = byte_bpe.Encoder(TIK, P.PATTERN)
    texts = ["".join(order.choice(" \n\tab'sé1!\u3000\xa0的") for _ in range(order.randint(0, 300))) for _ in range(500)] + ["ab" * 900, "é" * 500]
    assert [i.tolist() for i in code.cache.encode(texts)] == [tik.encode_ordinary(t) for t in texts]


def test_token_counts_are_the_library(spark, docs, no_docs):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    for df, rows in ((docs, TEXTS), (table, [(r.doc_id, r.text) for r in table.collect()])):
        n = [len(model.encode(t or "")) for _, t in rows]
        want = [(i, len((t or "").encode()), k, k > 4096) for (i, t), k in zip(rows, n)]
        same(token_counts.count_tokens(df, PIECES), want, columns)
        same(token_counts.count_tokens(df, PIECES, chunk=200, overlap=16), want, columns)
    assert token_counts.count_tokens(no_docs, PIECES).count() == 0


def test_token_counts_splice_random_texts():
    order = random.Random(2)
    texts = ["".join(order.choice([" ", "\n", "é", "的", "\u2581", "ab", " the", "  ", "."]) for _ in range(order.randint(0, 300))) for _ in range(500)]
    texts += ["", "a" * 3000, " " * 3000, "\u2581" * 2000, "a " * 2000]
    whole = token_counts.PieceCounter(PIECES, 10 ** 9, 1).count(texts)
    for chunk, overlap in ((16, 2), (50, 7), (64, 64)):
        assert token_counts.PieceCounter(PIECES, chunk, overlap).count(texts) == whole


def test_library_gets_many_chunks_as_one_text():
    """Chunks with marks and line ends inside too, and ids as the library gives them for whole texts."""
    order = random.Random(9)
    code = wavelet_output.LibraryEncoder(JSON)
    library, asked = code.library, []

    class Counted:
        def encode(self, text, **options):
            asked.append(text)
            return library.encode(text, **options)

        def encode_batch_fast(self, batch, **options):
            asked.extend(batch)
            return library.encode_batch_fast(batch, **options)

    code.library = Counted()
    lines = " ".join(f"w{i:x}.\nX{i}!?" for i in range(2000))
    odd = ["".join(order.choice(" \n\t\x1cab'sé1!\u3000\xa0\u200b的Ġ") for _ in range(order.randint(0, 200))) for _ in range(500)]
    got = code.encode_texts([lines])
    assert len(asked) < 100
    for t, ids in zip([lines, *odd, *odd], [*got, *code.encode_texts(odd), *code.encode_texts(odd)]):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_files(spark, docs, no_docs):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(JSON)
    table = spark.read.parquet(f"{SF}/documents.parquet")

    def want(rows):
        start = 0
        for i, t in rows:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
            yield i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    for options in ({}, {"shard_tokens": 3000}):
        same(wavelet_output.token_files(table, JSON, **options), list(want(rows)), columns)
    got = wavelet_output.token_files(docs, JSON).collect()  # ids repeat: their order is open, all else is not
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((repr(i), n, c) for i, _, n, c in want(TEXTS))
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]]
    assert wavelet_output.token_files(no_docs, JSON).count() == 0


def test_wavelet_matrix():
    order = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 70_000), (1300, 9), (5000, 50_257), (512, 2)):
        ids = order.integers(0, top, n)
        docs, lengths, m = wavelet_output.read_file(wavelet_output.write_file([5, None], [n, 0], ids))
        assert docs == [5, None] and lengths.tolist() == [n, 0] and m.all_ids().tolist() == ids.tolist()
        for at in range(0, n, 97):
            value = int(ids[at])
            assert m.access(at) == value and m.count(value) == (ids == value).sum() and m.count(value, at) == (ids[:at] == value).sum()
            assert m.occurrence(value, m.count(value, at)) == at
        assert m.count(1 << 40) == 0
        with pytest.raises(IndexError):
            m.occurrence(0, n)


def brute_windows(docs, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = {}
    for name, t in items:
        w = words(t)
        for i in range(max(0, len(w) - window) + 1 if w else 0):
            patterns.setdefault(tuple(w[i:i + window]), set()).add(str(name))
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(p) for p in patterns}:
            for a in range(len(w) - m + 1):
                who = patterns.get(tuple(w[a:a + m]))
                if who:
                    hit.update(range(a, a + m))
                    found |= who
        yield i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)


def test_decontamination(spark, docs, no_docs):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    items = [(1, BENCH), (1, BENCH), (22, "two words"), (3, None), (4, "..."), (None, "quick"), (5, "three"), (10, BENCH[4:])]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    want = list(brute_windows(TEXTS, [x for x in items if x[0] is not None]))
    same(decontamination.find_windows(docs, bench), want, columns)
    same(decontamination.find_windows(docs, bench, most_bytes=20), want, columns)  # in slices
    for most in (1 << 20, 20):
        kept = decontamination.drop_contaminated(docs, bench, most_bytes=most)
        assert kept.columns == docs.columns
        clean = [w[-1] for w in brute_windows(TEXTS, [x for x in items if x[0] is not None])]
        same(kept, [t for t, bad in zip(TEXTS, clean) if not bad], ["doc_id", "text"])
    assert decontamination.find_windows(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.find_windows(no_docs, bench).count() == 0
    table, real = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    want = list(brute_windows([(r.doc_id, r.text) for r in table.collect()], [(r.item_id, r.text) for r in real.collect()]))
    assert any(w[-1] for w in want)
    same(decontamination.find_windows(table, real), want, columns)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy this.</div><div id="cookie-notice">We use cookies.</div>
<article><h1>The title &amp; more</h1><p><b>First   part, of text.<br><p>Second <i>part</i>, &lt;longer&gt; than\nthe first &eacute;&#33;</p>
<aside>Side words.</aside><p>Third. And a last one, with more words in it.</article>
<section class="comments"><p>A reader, said this.</p></section><form><p>Your mail</p></form><footer>&copy; Foot</footer></body></html>"""


def test_html_text(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (None, "u", "plain &amp; words", 1), (4, "u", "<p>" * 500 + "deep. words", 1),
            (5, "u", "<script>never ends", 1), (1, "u", PAGE, 1), (6, "u", "<p>" + "long words, here. " * 20_000 + "</p>", 1), (7, "u", "<nav>x</nav>", 1)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    text = "The title & more\nFirst part, of text.\nSecond part, <longer> than the first é!\nThird. And a last one, with more words in it."
    texts = [text, "", "", "plain & words", "deep. words", "", text, ("long words, here. " * 20_000).strip(), ""]
    same(got, [(r[0], r[1], t, len(t)) for r, t in zip(rows, texts)], ["page_id", "url", "text", "n_chars"])
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_articles_of_the_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        parts = [re.sub(r"</?b>", "", p).replace("<br>", " ") for p in re.split(r"</?(?:p|h1)>", article)]
        import html
        want = "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        assert html_text.main_text(r.html) == want


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = []
    for rule, says in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, says))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/EN/", "x://notexample.net/en/",
            "http://www.example.com/de/1", "http://example.com/de", "https://a.org/fr/", "https://a.org/fr?x", "https://É.ÉRG/ä/#q", "http://?q", "://", "a://b://c/d",
            "http://x.net/?u=http://y.org/fr/", "https://www.casino-win.example.com/en/4", "https://blog.tionsh.example.com/en/4", "h://" + "a" * 9000 + "/" + "b" * 9000,
            "https://www.casino-win.example.com/en/4"]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(None, "http://a.net/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = url_filter.judge(pages)
    same(got, [(r[0], *brute_url(r[1])[:3]) for r in rows], ["page_id", "host", "path", "rule"])
    verdicts = {(r.page_id, r.rule): r.verdict for r in got.collect()}
    for r in rows:
        _, _, rule, says = brute_url(r[1])
        assert verdicts[r[0], rule] in ((says,) if says else ("allow", "block"))
    assert verdicts[16, None] == "block" and verdicts[17, None] == "allow"
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())
    assert url_filter.judge(pages.limit(0)).count() == 0
    nothing = spark.createDataFrame([("http://a.com/x", None), (None, 1)], "url string, label int")
    assert set(r.verdict for r in url_filter.judge(pages.filter("page_id > 15"), labelled=nothing).collect()) == {"allow"}


def test_url_model_on_unseen_names(spark):
    """Held out: names that the labelled table does not hold."""
    bad, good = ["casino-royal", "free-pills", "adult-video", "spam-links", "ads-click"], ["river-news", "old-library", "garden-maps", "tionthere", "city-history"]
    rows = [(k, f"https://{n}.example.com/en/{k}") for k, n in enumerate(bad + good)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=[]).collect()}
    assert sum(got[k] == ("block" if k < 5 else "allow") for k in range(10)) >= 8


def test_path_ratios_alone_leave_out_a_menu():
    page = "<div>" + "".join(f"<div><span>item {k}</span></div>" for k in range(30)) + "".join(f"<p>{'words and more words, here. ' * 9}</p>" for _ in range(8)) + "</div>"
    assert html_text.main_text(page).count("\n") == 7


@pytest.mark.parametrize("wrapper", ['class="overflow-hidden"', 'class="page has-sidebar"', 'class="with-sidebar"', 'class="no-comments"', 'class="layout-side"',
                                     'class="page-with-sidebar"', 'id="sidebar-right-page"', 'class="content widget-area"', 'data-note="hidden" title="not hidden"'])
def test_html_text_inside_wrappers(wrapper):
    article = [f"This is sentence {k}, and it says that the mill near the river stood empty for {k} years." for k in range(6)]
    page = (f'<html><body class="has-sidebar"><div {wrapper}><nav><a>Home, news</a></nav>' + "".join(f"<p>{a}</p>" for a in article)
            + '<div class="sidebar"><p>Our other pages, which nobody reads.</p></div><p hidden>Not seen by anyone, at all.</p>'
              '<p style="display: none">Nor is this, ever.</p><p aria-hidden="true">Nor this one.</p></div>'
              '<div class="post-comments">' + "<p>I do not agree, and I never will; this is wrong.</p>" * 40 + "</div></body></html>")
    assert html_text.main_text(page) == "\n".join(article)


def test_html_text_leaves_out_long_menus():
    article = "<p>A short article, about mills. It has two sentences.</p>"
    page = f'<body><div class="main-menu"><ul>{"<li>Some entry of a menu</li>" * 60}</ul></div><div>{article}</div></body>'
    assert html_text.main_text(page) == "A short article, about mills. It has two sentences."


PARAGRAPHS = [f"This is paragraph {k} of the story, and it says that the mill, which stood empty for {k} years, was sold; nobody knew why." for k in range(12)]
INSERTS = {
    "table": ("<table><tr><td>Alpha</td><td>12</td></tr><tr><td>Beta</td><td>34</td></tr><tr><td>Gamma</td><td>56</td></tr></table>", "Alpha 12 Beta 34 Gamma 56".split()),
    "code": ("<pre>a = 1</pre><pre>b = 2</pre><pre>c  =\n3</pre>", ["a = 1", "b = 2", "c = 3"]),
    "list": ("<ul><li>one</li><li>two</li><li>three</li><li>four</li><li>five</li></ul>", ["one", "two", "three", "four", "five"]),
    "button": ("<p>Press <button>Start</button> and fill <label>Name</label> in.</p>", ["Press Start and fill Name in."]),
    "unclosed": ("<p>Before.<svg><path d='x'></p><p>After the drawing.</p>", ["Before.", "After the drawing."]),
}


@pytest.mark.parametrize("kind", INSERTS)
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_html_text_keeps_the_article_whole(kind, around):
    html, lines = INSERTS[kind]
    paragraphs = [f"<p>{p}</p>" for p in PARAGRAPHS]
    page = f"<body><nav><a>Home</a></nav><{around}>{''.join(paragraphs[:6])}{html}{''.join(paragraphs[6:])}</{around}><footer>Foot</footer></body>"
    assert html_text.main_text(page) == "\n".join(PARAGRAPHS[:6] + lines + PARAGRAPHS[6:])


def test_html_text_keeps_the_headline():
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    for head in ("<article><header><h1>Mill sold</h1></header>", '<article><header class="entry-header"><h1>Mill sold</h1></header>', "<h1>Mill sold</h1><article>"):
        page = f"<body><header><p>Our paper, since 1901.</p></header>{head}{body}</article></body>"
        assert html_text.main_text(page) == "\n".join(["Mill sold", *PARAGRAPHS])


@pytest.mark.parametrize("tag", ["select", "svg", "object", "iframe"])
def test_html_text_goes_on_behind_what_never_ends(tag):
    assert html_text.main_text(f"<{tag}>" * 2000 + "<p>Words, after it.</p>") == "Words, after it."
