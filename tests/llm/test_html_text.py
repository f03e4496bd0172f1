"""Main text against hand-made pages and the pages' own template; the alignment against brute force."""

import html
import random
import re
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.llm import html_text as H


def lcs(a, b):
    @cache
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + best(i + 1, j + 1) if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))

    return best(0, 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14), st.sampled_from([4, 1 << 28]))
def test_common_is_a_longest_subsequence(a, b, bits):
    found = sorted(H.common(a, b, bits))
    assert len(found) == lcs(tuple(a), tuple(b))
    it = iter(b)
    assert all(a[i] in it for i in found)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/x>Menu</a></ul></nav><header><p>Site</p></header><!-- c --><div class="ad box">Buy</div><div id="cookie-notice">Ok?</div>
<article><h1>A &lt;b&gt; title</h1><p><b>First&nbsp; line<br>goes on<p>Second<i>!</i> <a>link</a></p><ul><li>one<li>two</ul><aside>More</aside><form><input value=q><button>Go</button></form>
<section class="comments"><p>Nice</p></section><pre>x
  y</pre></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def text(page, neighbour=None):
    """The text of a page compared with another one."""
    lines = H.lines_of(page)
    own = [line for _, line in lines]
    return "\n\n".join(H.article(lines) or (own if neighbour is None else H.differing(own, [line for _, line in H.lines_of(neighbour)])))


def test_structure():
    assert text(PAGE) == "A <b> title\n\nFirst line goes on\n\nSecond! link\n\none\n\ntwo\n\nx y"
    for bad in (None, "", "<", "<p", "<!--", "text only", "<article>open <b>end", "</div></p>x", "<p>" * 5000 + "deep", "&#0; &bogus; &am"):
        text(bad)
    assert text("text only") == "text only"


def test_what_surrounds_or_names_an_article():
    assert text('<div>top</div><div id="search-results"><article>found</article></div>') == "found"
    assert text('<div class="related"><article>other</article></div><article>own</article>') == "own"
    assert text('<article><p>a<p class="related work">b<p class="ad">c<div class="ad box">d</div><h2 id="related">e</h2></article>') == "a\n\nb\n\ne"
    assert text('<article>main</article><article class="comment">nice</article><ul class="comments"><li><article>too</article></ul><article class="comment-12 odd">x</article>') == "main"
    assert text('<article class="post comments-open"><header><h1>Title</h1><nav>n</nav></header>body<footer>f</footer></article>') == "Title\n\nbody"
    assert text("<header>site</header><main><p>m</main>") == "m"
    assert text('<div class="widget">w</div><p>plain') == "plain"


def brute(rows):
    """{page: text} by looking at every page of the host."""
    out, where = {}, {k: H.address(u) for k, u, _ in rows}
    for k, _, page in rows:
        lines = H.lines_of(page)
        own, kept = [x for _, x in lines], H.article(lines)
        host, path = where[k]
        place = lambda q, ls: (where[q][1], H.blake2b("\n\n".join(ls).encode(), digest_size=16).hexdigest())
        rest = [(place(q, ls), ls) for q, _, p in rows if where[q][0] == host and (ls := [x for _, x in H.lines_of(p)]) != own]
        before = max((r for r in rest if r[0] < place(k, own)), default=None)
        after = min((r for r in rest if r[0] > place(k, own)), default=None)
        alike = lambda r: next((i for i, (x, y) in enumerate(zip(path, r[0][0])) if x != y), min(len(path), len(r[0][0])))
        near = max((r for r in (before, after) if r), key=alike, default=None)
        out[k] = "\n\n".join(kept or (H.differing(own, near[1]) if near else own))
    return out


def test_bare_pages_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = []
    for k in range(240):
        host = "hot.example" if k % 3 else f"h{k % 7}.example"
        body = rng.choice(["copy", "copy", f"own {k}", f"shared {k % 5}"])
        page = f"<div>Top {k % 4}</div><div>{body}</div><p>{rng.choice('ab')}</p><div>All rights</div>"
        rows.append((k, f"http://{host}/{rng.choice('xyz')}/{rng.randrange(60)}", f"<article>{body}</article>" if k % 10 == 9 else page))
    rows += [(300 + k, f"http://hot.example/y/{k:03}", "<div>Top 1</div><div>same</div>") for k in range(80)] + [(400, None, "<p>a"), (401, None, "<p>b"), (402, "http://hot.example/y/1", "")]
    want = brute(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = {r["page_id"]: r["text"] for r in H.extract(df.repartition(3)).collect()}
            assert got == want, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_pages_of_one_host_lose_what_they_share(spark):
    page = lambda body: f"<div>Top bar</div><p>{body}</p><div>All rights</div>"
    rows = [(1, "http://a.b/x/1", page("alpha"), 0), (2, "http://a.b/x/2?q=1", page("beta"), 0), (3, "http://a.b/y", "<div>Top bar</div><p>only</p>", 0), (4, "http://c.d/", page("alone"), 0), (5, None, None, 0), (5, None, None, 0), (6, "junk", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").coalesce(1)
    got = {r["page_id"]: r for r in H.extract(df.repartition(1)).collect()}
    one = {r["page_id"]: r["text"] for r in got.values()}
    assert set(one) == {1, 2, 3, 4, 5, 6} and one[4] == "Top bar\n\nalone\n\nAll rights" and one[5] == ""
    assert text(rows[0][2], rows[1][2]) == one[1] == "alpha" and one[3] == "only"
    assert H.extract(df).count() == 7 and H.extract(df.limit(0)).count() == 0


def test_template_of_the_test_pages(spark):
    sf = "/root/testdata/sf0.01"
    src = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in H.query(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", src[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"<h1>|</h1>|<p>|</p>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><body><article><p>Hello there</article>", "Hello there"),
        ("<html><head><title>t</title><meta charset=utf-8><link rel=x><p>Bare page", "Bare page"),
        ("<head><title>t</title>\n<script>x</script> text of no tag", "text of no tag"),
        ("<body><form action=x><header>h</header><article><h1>T</h1><p>Wrapped</article><button>go</button></form>", "T\n\nWrapped"),
        ("<body><form><div><p>A page in a form</p><input name=q><select><option>x</select></div></form>", "A page in a form"),
        ("<body><form><input name=q><label>User</label></form></body>", ""),
        ("<article><p>Main</p><form><p>Sign up</form></article>", "Main"),
        ("<main><div class='search-results-page'><p>Body</p></div></main>", "Body"),
        ("<article><div class='share-price'>1</div><div class='side-effects'>2</div><p class='related-work'>3</p><h2 id='search'>4</h2><section id='notice'>5</section></article>", "1\n\n2\n\n3\n\n4\n\n5"),
        ("<article><p>Main</p><div class='related-posts'>no</div><div class=ad>no</div><div id=comments>no</div><section id=comments>no</section><ul class='social share'><li>no</ul><div class='share-buttons'>no</div></article>", "Main"),
        ("<article class='related'>no</article><article><p>yes</article><article class='card teaser'>no</article>", "yes"),
        ("<article class='card'>only one</article>", "only one"),
        ("<main><article class='teaser'>x</article><p>Main</main>", "Main"),
    ],
)
def test_pages_by_structure(spark, page, text):
    assert H.extract(spark.createDataFrame([(1, None, page)], "page_id long, url string, html string")).first()["text"] == text


def test_clashing_names(spark):
    rows = [(i, f"http://a/{i % 3}", f"<div>menu</div><p>text {i}") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("host", "path", "digest", "blob", "part", "other", "sub", "text")})
    assert sorted((r["page_id"], r["text"]) for r in H.extract(df).collect()) == [(i, f"text {i}") for i in range(6)]
