import time

from usagelens.llm import htmltext as ht
from usagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def main(html):
    return "\n\n".join(t for z, t in ht.blocks(html) if z == ht.MAIN)


def test_article_without_boilerplate():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
    <article><header><h1>Title &amp;amp; more</h1></header><p>One <b>two</b>,<br>three&nbsp;four<p>Five<script>x</script> six</p>
    <aside>Related</aside><div class="share-buttons">Share</div><form><input>Send</form><p hidden>no</p>
    <div id="comments"><div><p>First!</p></div></div><p>Last &lt;p&gt;</p></article><footer>&copy; me</footer></body></html>"""
    assert main(html) == "Title &amp; more\n\nOne two, three four\n\nFive six\n\nLast <p>"


def test_malformed_pages():
    assert main(None) == main("") == main("<article>") == ""
    assert main("<div class='ad'>never closed <article><p>text") == "text"
    assert main("<article><p>a<p class=notice>gone<p>b<ul><li>c<li class=ad>d<li>e</ul>") == "a\n\nb\n\nc\n\ne"
    assert main('<article><p title="a > b">x</p><p title="open>y</p></article>') == "x\n\ny"
    assert main("<ARTICLE><P>5 < 6 & 7 &#233; &eacute; &bogus;</P></ARTICLE>") == "5 < 6 & 7 é é &bogus;"
    assert main("<article><script>never closed <p>x") == ""
    assert main("<article>" + "<div>" * 3000 + "deep" + "<p>x " * 3000) .startswith("deep\n\nx")


def test_long_attributes_and_unclosed_quotes():
    for n in (3000, 5000, 100_000):
        for q in "\"'":
            assert main(f"<article><p data-state={q} > leaked {'b' * n}{q}>x</p><p>y</p></article>") == "x\n\ny"
    assert main("<article><p>x</p><p title=\"open>y</p><p title='z>z</p></article>") == "x\n\ny\n\nz"
    started = time.process_time()
    for hostile in ('<a ">"', "<a '>\"", "<a \"'>", '<a x=">', "<a ' >\" "):
        for tail in ("", '"', "'"):
            ht.blocks(hostile * 60_000 + tail)
    assert time.process_time() - started < 20


def test_unclosed_raw_elements_take_linear_time():
    started = time.process_time()
    for tag in ("button", "svg", "textarea", "select"):
        assert main(f"<article><p>x</p>{f'<{tag}>' * 40_000}") == "x"
    assert time.process_time() - started < 8
    assert main("<article><p>a<button>no</button> b<button> c</article>") == "a b c"


def test_names_inside_an_article_count_as_a_whole():
    kept = ("related-work", "social-science", "notice-board", "commentary", "share-of-votes", "adsorption", "section-login-history")
    gone = ("notice", "share-buttons", "related-posts", "ad-300x250", "newsletterSignup", "cookie-banner", "x related-links", "social_share_bar")
    for name in kept:
        assert main(f'<article><p>a</p><p class="{name}">b</p><p id="{name}">c</p></article>') == "a\n\nb\n\nc", name
    for name in gone:
        assert main(f'<article><p>a</p><div class="{name}">b</div></article>') == "a", name
    assert main("<article><p>Let <math><mi>x</mi><annotation>x</annotation></math> be <object data='a.svg'>a drawing</object>.</p></article>") == "Let x be a drawing."


def test_pages_of_the_table(spark):
    got = {r.page_id: r for r in QUERIES["op9_html_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    import html
    import re
    for p in pages:
        body = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if False else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"<br>", "\n", body))]
        assert got[p.page_id].text == "\n\n".join(x for x in want if x) and got[p.page_id].n_chars == len(got[p.page_id].text)


def page(i, body, host="h.example"):
    return (i, f"http://{host}/{i}", body, "x")


SHARED = "all rights reserved by the people who made this site long ago"


def test_host_suffix_array(spark):
    own = ["alpha beta gamma delta epsilon zeta eta theta iota kappa", "lamda mu nu xi omicron pi rho sigma tau upsilon", "one two three"]
    rows = [page(i, f"<div>{own[i]} {SHARED}</div><div>{SHARED}</div>") for i in range(2)]
    rows += [page(2, f"<p>{own[2]}</p>"), page(3, f"<div>{SHARED}</div>", "other.example"), page(4, f"<article>{SHARED}</article>"),
             page(5, "<p>same page twice and nothing else to be seen here</p>"), page(5, "<p>same page twice and nothing else to be seen here</p>"),
             (None, None, None, "x"), (7, None, "", "x"), page(8, f"<footer>{own[2]}</footer>", "third.example"), page(9, f"<p>{own[2]}</p>", "third.example")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in ht.extract(df).collect()), key=str)
    texts = [(0, own[0]), (1, own[1]), (2, own[2]), (3, SHARED), (4, SHARED), (5, "same page twice and nothing else to be seen here"),
             (5, "same page twice and nothing else to be seen here"), (None, ""), (7, ""), (8, ""), (9, "")]
    assert got == sorted([(i, t, len(t)) for i, t in texts], key=str)
    assert ht.extract(df.limit(0)).count() == 0


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    return {(r.page_id, r.url): r.text for r in ht.extract(df).collect()}


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_copies_under_other_ids_keep_their_text(spark):
    long, short = words("long", 60), "a short page that is here four times under other names"
    rows = [(i, f"http://h.example/{i}?utm={i}", f"<nav>menu {i}</nav><p>{long}</p>", "x") for i in range(20)]
    rows += [(i, f"https://h.example/{i}", f"<div>{short}</div><footer>{i} visits</footer>", "x") for i in range(20, 24)]
    assert texts(spark, rows) == {(r[0], r[1]): long if r[0] < 20 else short for r in rows}


def test_runs_go_only_if_long_and_on_several_contents(spark):
    notice, quoted, phrase = words("notice", 30), words("quoted", 40), words("phrase", ht.RUN - 1)
    body = [f"{words(f'own{i}x', 12)} {phrase} {words(f'then{i}x', 5)}" for i in range(16)]
    quotes = {2: f" {quoted}", 3: f" {quoted}"}
    rows = [page(i, f"<p>{body[i]}{quotes.get(i, '')}</p>" + (f"<div>{notice}</div>" if i < 4 else "")) for i in range(16)]
    assert {i: t for (i, _), t in texts(spark, rows).items()} == {i: body[i] + quotes.get(i, "") for i in range(16)}


def test_notices_inside_articles_go_by_the_host(spark):
    notice, quoted, short = words("notice", 30), words("quoted", 40), words("short", ht.RUN - 1)
    own = [words(f"own{i}x", 60) for i in range(32)]

    def article(i, host="h.example"):
        inside = [own[i]] + [notice] * (i < 8) + [quoted] * (8 <= i < 15) + [short] + [f"{notice} said {i}"] * (i == 20)
        return page(i, "<article>" + "".join(f"<p>{t}</p>" for t in inside) + "</article>", host), "\n\n".join(t for t in inside if t != notice)

    made = [article(i) for i in range(32)]
    assert {i: t for (i, _), t in texts(spark, [r for r, _ in made]).items()} == {r[0]: t for r, t in made}
    # page 20 counts as well: seven contents, or nine of 37, are too few
    few = [article(i)[0] for i in range(2, 32)]
    assert all((notice in t) == (i < 8 or i == 20) for (i, _), t in texts(spark, few).items())
    more = [r for r, _ in made] + [page(i, f"<article><p>another one {i}</p></article>") for i in range(90, 95)]
    assert all((notice in t) == (i < 8 or i == 20) for (i, _), t in texts(spark, more).items())


def test_near_copies_of_an_article_stay_whole(spark):
    told = [words("told", 50), words("then", 50), words("last", 30)]
    rows = [page(i, "<article>" + "".join(f"<p>{t}</p>" for t in [*told, words(f"mine{i}x", 40)]) + "</article>") for i in range(12)]
    assert {i: t for (i, _), t in texts(spark, rows).items()} == {i: "\n\n".join([*told, words(f"mine{i}x", 40)]) for i in range(12)}
