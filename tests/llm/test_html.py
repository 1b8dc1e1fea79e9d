import html
import re
import time

from tallyspark.llm.html import extract, main_text, op3_html_extraction, tree

from .common import TABLES

BODY = "<p>First, a long and wordy paragraph, with commas, that says quite a lot about nothing in particular.</p><p>Second &amp; last,\n  also   long enough, as paragraphs of articles tend to be, one would think.</p>"
TEXT = "First, a long and wordy paragraph, with commas, that says quite a lot about nothing in particular. Second & last, also long enough, as paragraphs of articles tend to be, one would think."
AROUND = "<html><head><title>t</title><style>p{margin:0}</style><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=1>Home</a></li></ul></nav>@<footer>&copy; nobody</footer></body></html>"


def around(body):
    return AROUND.replace("@", body)


def test_plain_article():
    assert main_text(around(f"<article><h1>Head</h1>{BODY}</article>")) == f"Head {TEXT}"
    assert main_text(around(f"<div class=content>{BODY}</div>")) == TEXT


def test_what_is_no_article_goes():
    junk = '<div class="ad">Buy, now, cheap</div><form><input value=1>Search</form><div id="comments"><p>I, for one, agree, strongly.</p></div><aside>Related, things</aside><div role="alert">Cookies, yes</div><div hidden>no</div>'
    assert main_text(around(f"{junk}<article>{BODY}{junk}</article>")) == TEXT


def sized(n, word):
    return "".join(f"<p>{word} {i}, a paragraph, with commas, that goes on, and on, and says, in the end, very little, one would think.</p>" for i in range(n))


def test_all_sections_of_an_article_stay():
    for n in (1, 5, 30, 200):
        for tag in ("article", "main"):
            page = f"<{tag}><header><h1>Title</h1></header><section>{sized(1, 'Intro')}</section><section>{sized(n, 'Middle')}</section><ul><li>Point</li></ul><table><tr><td>Cell</td></tr></table><figure><figcaption>Figure</figcaption></figure><section><p>The end.</p></section></{tag}>"
            got = main_text(around(page))
            assert got.startswith("Title Intro 0,") and got.endswith("Point Cell Figure The end.") and got.count("Middle") == n
        for a, b in (("<article>", "</article>"), ("<div>", "</div>"), ("", "")):
            got = main_text(around(f"{a}<div class=lead><p>The lead.</p></div><div class=text>{sized(n, 'Text')}</div><div><p>The end.</p></div>{b}"))
            assert got.startswith("The lead. Text 0,") and got.endswith("The end.") and got.count("Text") == n
    assert main_text(around(f"<main><h1>Title</h1><article>{BODY}</article></main>")) == f"Title {TEXT}"
    assert main_text(around(f"<h1>Title</h1><article>{BODY}</article><article><p>Part two.</p></article>")) == f"Title {TEXT} Part two."


def test_links_beside_the_text_go():
    links = "<div><p><a href=1>Home</a> <a href=2>News</a></p></div>"
    assert main_text(around(f"<div>{links}<div><div><p>The lead.</p></div><div>{BODY}</div></div>{links}</div>")) == f"The lead. {TEXT}"


def test_anchors_of_the_article_prune_nothing():
    for word in ("side-effects", "discussion", "related-work", "social-impact", "search-results", "legal", "comments", "tags", "notices", "search"):
        parts = f"<section id={word}><h2>Name</h2>{BODY}</section>", f"<div class=section id={word}><h2>Name</h2>{BODY}</div>", f"<section><h2 id={word}>Name</h2>{BODY}</section>"
        for part in parts:
            for page in (f"<article>{part}</article>", f"<main>{part}</main>", f"<div role=main>{part}</div>"):
                assert main_text(around(page)) == f"Name {TEXT}", (word, page[:80])
    assert main_text(f"<article><section id=discussion><p>Short.</p></section>{BODY}</article>") == f"Short. {TEXT}"
    assert main_text(f"<article><div class=header><h1 class=section-header>Head</h1></div>{BODY}</article>") == f"Head {TEXT}"
    assert main_text(f"<article>{BODY}<pre>x = 1 <span class=hljs-comment># one</span></pre></article>") == f"{TEXT} x = 1 # one"


def test_linked_lists_of_the_article_stay():
    links = "".join(f"<li><a href={i}>Source {i}</a></li>" for i in range(4))
    said = " ".join(f"Source {i}" for i in range(4))
    for tag in ("article", "main"):
        assert main_text(around(f"<{tag}>{BODY}<h2>References</h2><ol>{links}</ol></{tag}>")) == f"{TEXT} References {said}"
    assert main_text(around(f"<main><article>{BODY}<ol>{links}</ol></article><ul>{links}</ul></main>")) == f"{TEXT} {said}"
    assert main_text(around(f"<div>{BODY}<ul>{links}</ul></div>")) == TEXT


def test_comments_and_adverts_within_the_article_go():
    more = BODY * 3
    for junk in (
        f'<section id="post-comments"><h2>Name</h2>{more}</section>',
        f'<div class="comment-body">{more}</div>',
        f'<div class="content-ad">{more}</div>',
        f'<div id="main-sidebar">{more}</div>',
        f'<section id="comments"><h2>Name</h2><div class="comment">{more}</div></section>',
        '<div id="related-posts"><p><a href=1>One</a></p></div>',
        f'<div class="related">{more}</div>',
    ):
        for page in (f"<article>{BODY}{junk}</article>", f"<main><article>{BODY}</article>{junk}</main>", f"<div class=content>{BODY}{junk}</div>"):
            assert main_text(around(page)) == TEXT, junk[:60]
    assert main_text(around(f'<div class="hentry comments-open has-sidebar content">{BODY}</div>')) == TEXT


def test_class_words_of_the_article_prune_nothing():
    for part in ("<section class=related-work><h2>Name</h2><p>Short.</p></section>", "<div class=skip-ahead><h2>Name</h2><p>Short.</p></div>", "<h2>Name</h2><p class=side-note>Short.</p>", "<section class=discussion-of-results><h2>Name</h2><p>Short.</p></section>"):
        assert main_text(around(f"<article>{part}{BODY}</article>")) == f"Name Short. {TEXT}", part
    for name in ("discussion", "related", "legal"):
        assert main_text(around(f"<article><section class={name}><h2>Name</h2>{BODY}</section></article>")) == f"Name {TEXT}"
    assert main_text(f"<article>{BODY}<p>Use <code>x <span class=comment># one</span></code>, <label>a label</label>, <math><mi>n</mi></math>.</p></article>") == f"{TEXT} Use x # one, a label, n."
    for junk in ('<div class="share-buttons">Share this</div>', '<div class="related-posts"><h3>Related</h3><p>One, two.</p></div>', '<div class="related-stuff"><a href=1>One</a> <a href=2>Two</a></div>', '<div class="newsletter-signup-teaser"><p>Get our weekly news.</p></div>', "<label for=q>Search</label>", "<label>Name <input></label>"):
        assert main_text(around(f"<article>{BODY}{junk}</article>")) == TEXT, junk


def test_comments_named_by_their_heading_go():
    said = "<ol><li><p>I, for one, agree, strongly, and will say so at length, as readers do.</p></li></ol>"
    for head in ("Comments (2)", "2 Comments", "3 replies", "Leave a comment", "Kommentare (2)"):
        for page in (f"<div>{BODY}<div><h3>{head}</h3>{said}</div></div>", f"<div>{BODY}<h3>{head}</h3>{said}</div>", f"<article>{BODY}<section><header><h2>{head}</h2></header>{said}</section></article>", f"{BODY}<div><div><h3>{head}</h3></div>{said}</div>"):
            assert main_text(around(page)) == TEXT, page
    assert main_text(around(f"<div>{BODY}<h2>Comments</h2>{said}<h2>More</h2><p>The end.</p></div>")) == f"{TEXT} More The end."
    assert main_text(around(f"<article><h2>Comments</h2>{BODY}</article>")) == f"Comments {TEXT}"
    assert main_text(around(f"<div><h1>Head</h1><h4>3 comments</h4>{BODY}</div>")).endswith(TEXT)


def test_deep_and_long_pages_take_linear_time():
    for open_, shut in (("<div>", "</div>"), ("<p><button><div>", ""), ("<div><b>", "</b></div>"), ("<ul><li>", "")):
        started = time.perf_counter()
        tree(open_ * 100_000 + "x" + shut * 100_000)
        assert time.perf_counter() - started < 5
    assert main_text("<div>" * 20_000 + BODY) == TEXT
    assert main_text(f"<article>{BODY * 5_000}</article>") == " ".join([TEXT] * 5_000)


def test_equal_scores():
    a, b = (f"<section><p>{x}, and as long as it can be, give or take, with nothing said in the end at all, one would think, or so.</p></section>" for x in "ab")
    assert main_text(f"<div>{a}{b}</div>").startswith("a, and") and "b, and" in main_text(f"<div>{a}{b}</div>")


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<script>x") == ""
    assert main_text(f"<article>{BODY}") == TEXT
    assert main_text("<article><p>a<br>b <b>c</b></p><!-- x") == "a b c"
    assert main_text("just text, no tags & more < 3") == "just text, no tags & more < 3"
    assert main_text("<div>" * 3000 + BODY) == TEXT


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{BODY}</article>", "x"), (None, None, None, "y"), (1, "u", f"<article>{BODY}</article>", "z")], "page_id long, url string, html string, text string")
    got = sorted(extract(df).collect(), key=lambda r: r["n_chars"])
    assert [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got] == [(None, None, "", 0)] + [(1, "u", TEXT, len(TEXT))] * 2
    assert extract(df.limit(0)).count() == 0


def test_whole_tables(spark):
    """Every page of the two tables against the standard library's references and plain replacing: their articles hold
    headings, paragraphs, line breaks and bold text."""
    for tables in (TABLES, TABLES.replace("sf0.001", "sf0.1")):
        held = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
        rows = op3_html_extraction(spark, tables).collect()
        assert len(rows) == len(held)
        for r in rows:
            inside = re.search("<article>(.*)</article>", held[r["page_id"]], re.DOTALL)[1]
            plain = re.sub("</?(h1|p|br)>", " ", inside.replace("<b>", "").replace("</b>", ""))
            assert "<" not in plain and r["text"] == " ".join(html.unescape(plain).split()) and r["n_chars"] == len(r["text"])
