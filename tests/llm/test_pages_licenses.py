import random
import re

from riskloom.llm import html_text, licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_article_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy this fine thing today, all of you who read.</div>
    <article><header><h1>A &amp; B</h1></header><p><b>First.<br><p>Second <i>wor</i>d &lt;p&gt; 5&nbsp;&euro;  x.<!-- no --></p><ul><li><a href="/x">one</a></li></ul>
    <div class="newsletter"><p>Get our weekly letter with all that is new.</p></div><form><label>Your name</label><input><button>Go</button></form>
    <p hidden>unseen</p><p>A.</p></article><section id="comments"><p>What a read, I have never seen its like in all my days.</p></section>
    <aside>Most read</aside><footer>&copy; us</footer>"""
    assert html_text.main_text(page) == "A & B First. Second word <p> 5 € x. one A."


def test_page_without_marks():
    text = "This paragraph has words enough to be the main text of a page, one would think, and no links."
    page = f"<div><a href=1>Home</a> | <a href=2>News</a></div><h2>Our story</h2><p>{text}</p><p>{text}</p><ul><li><a href=3>Next</a><li><a href=4>More</a></ul>"
    assert html_text.main_text(page) == f"Our story {text} {text}"


def test_broken_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("<article>a < b <p title=\"x>y\">c &amp;lt; d") == "a < b c &lt; d"
    assert html_text.main_text("<article><p>a</div></p></nav>b<!-- open") == "a b"
    assert len(html_text.main_text("<article>" + "<p>word" * 200_000)) == 5 * 200_000 - 1
    assert html_text.main_text("<article>" + "<div>" * 5_000 + "deep") == "deep"


def test_unclosed_elements_end_with_their_container():
    after = "The text after it is long enough to be read as running text of the page."
    for name in ("button", "select", "video", "audio", "object", "map", "canvas", "svg", "iframe", "template", "noscript"):
        page = f"<article><p>Before.</p><div><{name} class=x>inside <div>deeper</div> <p>still</div><p>{after}</p></article>"
        assert html_text.main_text(page) == f"Before. {after}"
        closed = f"<article><p>Before.</p><div><{name}>in <div>deeper</div> it</{name}> Beside.</div><p>{after}</p></article>"
        assert html_text.main_text(closed) == f"Before. Beside. {after}"
    assert html_text.main_text(f"<article><p>Before.</p><div><script>x = '</div>'; y</script></div><p>{after}</p></article>") == f"Before. {after}"


def test_tree_fits_its_table():
    rows = html_text.labelled()
    assert (html_text.classify(rows[:, :-1]) == (rows[:, -1] == 1)).all()
    used = set()

    def walk(node):
        if not isinstance(node, bool):
            used.add(html_text.FEATURES[node[0]])
            walk(node[2]), walk(node[3])
    walk(html_text.tree())
    assert {"words", "link_density", "link_density_before", "link_density_after", "in_article", "marked", "beside"} <= used


def test_neighbours_decide_inside_an_article():
    text = "Running text of an article that is long enough to stand as a paragraph of its own, without links."
    link = "<li><a href=/x>Other page</a></li>"
    page = "<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{0}</p>{1}<p>{0}</p></article>"
    assert html_text.main_text(page.format(text, f"<ul>{link}</ul>")) == f"Title {text} Other page {text}"
    for n in (2, 3, 7):
        assert html_text.main_text(page.format(text, f"<ul>{link * n}</ul>")) == f"Title {text} {text}"
    # the same linked line between unlinked ones stays
    between = f"<ul><li>One word more.</li>{link}<li>And another.</li></ul>"
    assert html_text.main_text(page.format(text, between)) == f"Title {text} One word more. Other page And another. {text}"
    # unlinked items of a list whose neighbours are links stay
    assert html_text.main_text(page.format(text, f"<ul>{link}<li>Plain item.</li>{link}</ul>")).count("Plain item.") == 1


def test_tree_on_a_grid():
    import itertools

    import numpy as np
    rows = np.array(list(itertools.product((1, 4, 11, 25, 300), (0.0, 0.3, 0.9, 1.0), (0, 2, 50), (0.0, 0.3, 1.0), (0, 2, 50), (0.0, 0.3, 1.0),
                                           (1, 0), (0, 1), (0,), (0, 1))), float)
    rows = rows[rows[:, 6] + rows[:, 7] == 1]
    verdict = html_text.classify(rows)
    menu = (rows[:, 0] < 12) & (rows[:, 1] > 0.7) & ((rows[:, 3] > 0.7) | (rows[:, 5] > 0.7)) & (rows[:, 9] == 0)
    assert (verdict == ((rows[:, 6] == 1) & ~menu)).all()


def test_given_pages_by_another_parser(spark):
    """The standard library's parser; on these pages the text is what the article holds, cut at blocks."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.parts = False, []

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag not in html_text.INLINE:
                self.parts.append(" ")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag not in html_text.INLINE:
                self.parts.append(" ")

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data)

    def brute(page):
        parser = Article()
        parser.feed(page or "")
        parser.close()
        return " ".join("".join(parser.parts).split())
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(rows) == len(got) and all("<article" in (r.html or "<article") for r in rows)
    for r in rows:
        assert got[r.page_id].text == brute(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_pages_table(spark):
    rows = [(1, "u", "<article><p>é🙂 x"), (1, "u", "<article><p>é🙂 x"), (None, None, None), (2, "v", "")]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "é🙂 x", 4)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html_text.extract(df.where("false")).count() == 0


def brute_base(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k:k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places():
    rng = random.Random(1)
    pool = "gnu general public license apache mit cc by BY, MIT-License é x_y İ".split()
    for _ in range(300):
        text = rng.choice([" ", "\n", "/", "\x1c"]).join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        assert licenses.scan_text(text)[:5] == brute_base(text)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_notices_within_their_edits():
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for i, (label, notice) in enumerate(licenses.NOTICES):
        for _ in range(12):
            chars = list(notice)
            for _ in range(licenses.allowed(notice)):
                at = rng.randrange(1, len(chars) - 1)
                kind = rng.randrange(3)
                chars[at:at + (kind != 1)] = [] if kind == 2 else [rng.choice(letters)]
            near = " ".join("".join(chars).split())
            text = f" some words before {near} and after "
            found = [m for m in licenses.notice_spans(text) if m[0] == i]
            if edits(near, notice) <= licenses.allowed(notice):
                assert found, (notice, near)
            assert all(m[3] <= licenses.allowed(notice) for m in found)
    assert not licenses.notice_spans(" permission is never given to any person here to do so ")


def test_scan(make_docs, clashing, odd_rows):
    rows = [(1, "Relaesed under teh MIT License. All rights reserved", "s"), (2, "Licensed under CC BY-NC 4.0", "s")]
    got = {r.doc_id: r for r in licenses.scan(make_docs(rows)).collect()}
    assert got[1].base_labels == "mit" and got[1].labels == "mit,rights-reserved" and got[1].score == 1.0
    assert got[2].labels == "cc-by,cc-by-nc" and (got[2].first_word, got[2].last_word) == (2, 2)
    assert [(s.label, s.first_word, s.last_word) for s in got[2].spans] == [("cc-by-nc", 0, 6)]
    out = licenses.scan(clashing)
    assert sorted(((r.doc_id, r.n_words, r.n_base) for r in out.collect()), key=str) == sorted(((d, *brute_base(t)[:2]) for d, t, _ in odd_rows), key=str)
    assert licenses.scan(make_docs([])).count() == 0
