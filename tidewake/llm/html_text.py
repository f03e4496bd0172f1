"""Main text of web pages: differences to the page with the nearest URL, then an exact check by structure.

A page is parsed into lines (blocks of text), each marked by where it stands: in the
article, in an article inside of something that its class names as no main text (used
only if there is no other), in something that is never main text (menus, headers,
footers, sidebars, notices, adverts, forms, comments), or in neither. Every page is
differenced: the pages of a host stand in the order of their paths, a page is paired with the
nearer by path of the pages before and after it whose lines differ from its own, both are
aligned by a longest common subsequence of lines, and shared lines go. The check by structure
follows: if a page has an article, the shared lines of the article come back, as articles are copied
and quote each other, and lines beside it go; of a bare page differencing alone decides.

Pages are parsed twice: at first for the names of their lines alone, which are aligned in place
of the lines, then for the texts, which move once, packed, to what was found. Neighbours are found among addresses and
digests of lines, in ranges that hand their first and last pages on to each other, so they
don't depend on how pages lie in partitions; names meet by digest, those of very many pairs by a broadcast, and copies are compared once.

Defined results: null html is empty; a null url is an address of its own, without host; a
page without main text has the text ''; the first and last page of a host have one
neighbour or none, and a page without neighbours shares no lines; pages with equal lines
are no neighbours of each other but share the nearest pages that differ; of two neighbours
equally near the one before counts, and of several versions of one address the order is
that of their digests; a very long page is parsed and aligned whole; equal rows each give
a row; an empty table gives an empty table; other columns play no part. A task holds the
names of the lines of two pages at a time. Names have 64 bits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import met, partitions, small_batches, table, tidily, with_ids, written

NEVER, LOOSE, MAIN, SECOND, MARKED_PART = 0, 1, 2, 3, 4
#: Tags that belong to the head of a page; any other ends it.
OF_HEAD = {"head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
#: Tags whose content is never main text.
AWAY = {"head", "title", "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "menu", "dialog"}
RAW = {"script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
#: Words that may stand beside a mark in the name of a part of an article that is no main text, as in "share-buttons".
BESIDE = re.compile(r"(?:box|block|list|links?|bar|buttons?|container|wrapper|wrap|section|area|items?|slot|unit|inner|outer|content|top|bottom|left|right|posts?|articles?|stories|form|icons?|panel|inline|\d+)", re.I)
#: Class names of articles that only point at others.
POINTER = re.compile(r"(?:teaser|card|related|recommend\w*|promo\w*|sponsor\w*|preview|ads?|advert\w*)", re.I)
#: Words in a class, id or role that mark what is not main text.
MARKED = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|side|footer|masthead|ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|replies|breadcrumbs?|pagination|pager|widget|login|signup|contentinfo|complementary|search|skip)(?:$|[\s_-])", re.I)
#: Words that mark reader comments, also on an article.
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|reply|replies)(?:$|[\s_-])", re.I)
#: The same as a class of an article.
COMMENT_ARTICLE = re.compile(r"(?:comments?|reply|replies|respond)(?:[_-](?:body|item|content|\d+))?", re.I)
#: Tags that hold text rather than parts of a page: each of their class names must be a mark, as in "ad" but not in "related work".
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "span", "a", "b", "i", "em", "strong", "dd", "dt", "figcaption", "figure", "caption", "code"}
#: Tags whose id is the target of a link rather than a name of what they are.
ANCHORS = TEXT_TAGS | {"section", "article", "main"}
FORM, PARAGRAPH = re.compile(r"<form[\s>]", re.I), re.compile(r"<(?:p|article|main)[\s>]", re.I)
ENDS_P = BLOCK - {"body", "html"}
WHITE = re.compile(r"\s+")
#: Bytes of the name of a line.
NAME = 8


class Lines(HTMLParser):
    """(mark, line) of the blocks of a page, in page order.

    wrapped: forms are containers like others, as on pages that are one form as a whole.
    """

    def __init__(self, wrapped: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.wrapped = wrapped
        self.open: list[tuple[str, int]] = []
        self.mark = LOOSE
        self.lines: list[tuple[int, str]] = []
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            line = WHITE.sub(" ", "".join(self.parts)).strip()
            if line:
                self.lines.append((self.mark, line))
            self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        self.end_head(tag)
        if tag in VOID:
            return
        if tag in ENDS_P:  # a paragraph ends where the next block begins
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in BLOCK:
                    if self.open[k][0] == "p":
                        self.mark = self.open[k][1]
                        del self.open[k:]
                    break
        self.open.append((tag, self.mark))
        if self.mark == NEVER:
            return
        found = dict(attrs)
        names = [found.get(k) or "" for k in ("class", "id", "role")]
        classes = [x for k in (names[0], names[2]) for x in k.split()]
        inside = self.mark in (MAIN, SECOND)
        article = tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articleBody"
        if tag == "header" and inside:  # the article's own: its title
            return
        if tag == "article":
            comment = any(COMMENT_ARTICLE.fullmatch(x) for n in names for x in n.split())
        else:
            comment = tag not in ("body", "html", "main") and any(map(COMMENT.search, names)) and (tag not in TEXT_TAGS or marked(names))
        parts = classes if tag in ANCHORS else " ".join(names).split()
        apart = comment or inside and bool(parts) and (all if tag in TEXT_TAGS else any)(map(whole_mark, parts))
        if tag in AWAY and not (tag == "form" and self.wrapped) or "hidden" in found or found.get("aria-hidden") == "true" or apart:
            self.enter(NEVER)
        elif tag == "article" and any(map(POINTER.fullmatch, classes)):
            self.enter(NEVER if inside else SECOND)
        elif article:
            self.enter(SECOND if self.mark in (MARKED_PART, SECOND) else MAIN)
        elif not inside and tag not in ("body", "html") and (marked(names) if tag in TEXT_TAGS else any(map(MARKED.search, names))):
            self.enter(MARKED_PART)

    def end_head(self, tag: str | None) -> None:
        """A head without an end tag ends with the first tag, or text, that isn't of it."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == "head" and tag not in OF_HEAD and (tag is not None or k == len(self.open) - 1):
                self.enter(self.open[k][1])
                del self.open[k:]
                return

    def enter(self, mark: int) -> None:
        self.flush()
        self.mark = mark

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if self.open[k][1] != self.mark:
                    self.enter(self.open[k][1])
                del self.open[k:]
                return
            if tag not in BLOCK and self.open[k][0] in BLOCK:
                return  # a stray end of an inline tag ends no block

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self.end_head(None)
        if self.mark not in (NEVER, MARKED_PART):
            self.parts.append(data)


def marked(names: list[str]) -> bool:
    """Whether there are names and each of them is a mark."""
    every = [x for n in names for x in n.split()]
    return bool(every) and all(map(MARKED.search, every))


def whole_mark(name: str) -> bool:
    """Whether a name is made of marks, and of words that go with them."""
    words = [x for x in re.split(r"[_-]+", name) if x]
    marks = [bool(MARKED.fullmatch(x)) for x in words]
    return any(marks) and all(m or BESIDE.fullmatch(x) for m, x in zip(marks, words))


def lines_of(html: str | None) -> list[tuple[int, str]]:
    """The lines of a page that are not surely outside of its main text; of a page that would have none, those in forms, if one of them holds an article or paragraphs."""
    for wrapped in (False, True):
        parser = Lines(wrapped)
        parser.feed(html or "")
        parser.close()
        parser.flush()
        if parser.lines or not html or not FORM.search(html) or not PARAGRAPH.search(html):
            break
    return parser.lines


def common(a: list[str], b: list[str], most_bits: int = 1 << 28) -> set[int]:
    """Numbers of the lines of a that are in a longest common subsequence with b.

    One row of the dynamic program is one integer; long pages are cut in two (Hirschberg) so that the rows kept stay small.
    """
    lo = next((i for i in count() if i >= min(len(a), len(b)) or a[i] != b[i]), 0)
    hi = next((i for i in count() if i >= min(len(a), len(b)) - lo or a[-1 - i] != b[-1 - i]), 0)
    found = {*range(lo), *range(len(a) - hi, len(a))}
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return found
    if len(a) * len(b) > most_bits and len(b) > 1:
        middle = len(b) // 2
        left, right = lengths(a, b[:middle]), lengths(a[::-1], b[middle:][::-1])
        cut = max(range(len(a) + 1), key=lambda i: left[i] + right[len(a) - i])
        found |= {lo + i for i in common(a[:cut], b[:middle], most_bits)}
        return found | {lo + cut + i for i in common(a[cut:], b[middle:], most_bits)}
    rows = table_of(a, b)
    row, col = len(b), len(a)
    while row and col:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
            continue
        row -= 1
        if not row or rows[row - 1] >> (col - 1) & 1:
            col -= 1
            found.add(lo + col)
    return found


def table_of(a: list[str], b: list[str], keep: bool = True) -> list[int]:
    """For each line of b the row of the dynamic program over a: bit i is 0 where line i adds one; only the last if not keep."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def lengths(a: list[str], b: list[str]) -> list[int]:
    """The lengths of the longest common subsequences of b and each beginning of a."""
    (v,) = table_of(a, b, keep=False)
    out = [0]
    for bit in reversed(f"{v:0{len(a)}b}"):
        out.append(out[-1] + (bit == "0"))
    return out


def article(page: list[tuple[int, str]]) -> list[str] | None:
    """The lines of the page's article; None: it has none."""
    for mark in (MAIN, SECOND):
        if kept := [line for own, line in page if own == mark]:
            return kept
    return None


def sharing(page: list, neighbour: list) -> list[bool]:
    """Of each line of a page, whether it shares it with the page it is compared with."""
    shared = common(page, neighbour)
    return [i in shared for i in range(len(page))]


def differing(page: list[str], neighbour: list[str]) -> list[str]:
    """The lines of a page that it doesn't share with the page it is compared with."""
    return [line for line, shared in zip(page, sharing(page, neighbour)) if not shared]


def address(url: str | None) -> tuple[str, str]:
    """Host and path of an address."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


def parsed(pages: DataFrame, whole: bool) -> DataFrame:
    """(page_id, url, host, path, digest) of every row, digest: of all its lines; also, if whole, bare, whether it has no article, and blob, the packed lines of its article or else all; else names, of NAME bytes, of all its lines."""
    more = {"bare": "boolean", "blob": "binary"} if whole else {"names": "binary"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[str, list] = {c: [] for c in ("digest", *more)}
            for html in pdf["html"]:
                page = lines_of(html)
                lines = [line for _, line in page]
                found["digest"].append(blake2b("\n\n".join(lines).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
                if whole:
                    kept = article(page)
                    found["bare"].append(not kept)
                    found["blob"].append(zlib.compress("\n\n".join(kept or lines).encode("utf-8", "surrogatepass"), 1))
                else:
                    found["names"].append(b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=NAME).digest() for x in lines))
            where = [address(u) for u in pdf["url"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "host": [w[0] for w in where], "path": [w[1] for w in where]} | found)

    kinds = "page_id long, url string, host string, path string, digest string" + "".join(f", {c} {kind}" for c, kind in more.items())
    # parts of the rows of one address, so that many equal rows are spread
    return with_ids(pages.select("page_id", "url", "html"), tidily(run), kinds).withColumn("sub", F.pmod(F.xxhash64("page_id"), F.lit(64)).cast("int"))


def carried(edges: list) -> list[tuple]:
    """(host, part, the nearest page before the part, the nearest before whose lines differ from that one's, and the same two behind it), of (host, part, first, second, last, second to last) sorted; second: the next whose lines differ."""
    out: dict[tuple, list] = {(e[0], e[1]): [e[0], e[1], None, None, None, None] for e in edges}
    for order, near, far, at in ((edges, 4, 5, 2), (edges[::-1], 2, 3, 4)):
        host, one, two = None, None, None
        for e in order:
            if e[0] != host:
                host, one, two = e[0], None, None
            out[e[0], e[1]][at : at + 2] = [one, two]
            if e[far] is not None:
                two = e[far]
            elif one is not None and one["digest"] != e[near]["digest"]:
                two = one  # all of this part has the same lines
            one = e[near]
    return [tuple(x) for x in out.values()]


PAGE = "struct<path:string,digest:string>"


def neighbours(pages: DataFrame) -> DataFrame:
    """(host, path, digest, other): of each distinct address and its lines the digest of the nearest page by path whose lines differ."""
    spark = pages.sparkSession
    keys = pages.select("host", "path", "digest").distinct()
    keys = written(keys.repartitionByRange(partitions(spark), "host", "path", "digest").withColumn("part", F.spark_partition_id()), "addresses")
    own = F.struct("path", "digest")

    def side(order: list[Column]) -> Column:
        w = Window.partitionBy("host", "part").orderBy(*order)
        beside = F.lag(own).over(w)
        return F.last(F.when(beside["digest"] != F.col("digest"), beside), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    rows = keys.withColumn("before", side([F.col("path"), F.col("digest")])).withColumn("after", side([F.col("path").desc(), F.col("digest").desc()]))
    rows = written(rows, "beside")
    edges = rows.groupBy("host", "part").agg(F.min(own).alias("first"), F.min_by("after", own).alias("second"), F.max(own).alias("last"), F.max_by("before", own).alias("next_to_last"))
    split = edges.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("host")
    # hosts that lie in several ranges: twice as many rows as ranges at most
    edges = sorted(edges.join(split, "host").select("host", "part", "first", "second", "last", "next_to_last").collect(), key=lambda e: (e[0], e[1]))
    carry = spark.createDataFrame(carried(edges), f"host string, part int, before_1 {PAGE}, before_2 {PAGE}, after_1 {PAGE}, after_2 {PAGE}")
    rows = rows.join(F.broadcast(carry), ["host", "part"], "left")
    for name in ("before", "after"):
        one = F.col(f"{name}_1")
        rows = rows.withColumn(name, F.coalesce(name, F.when(one["digest"] != F.col("digest"), one).otherwise(F.col(f"{name}_2"))))

    def alike(x: Column) -> Column:
        """How many characters the paths share from the start."""
        return F.size(F.filter(F.sequence(F.lit(0), F.least(F.length("path"), F.length(x["path"]))), lambda n: F.substring("path", 1, n) == F.substring(x["path"], F.lit(1), n)))

    before = F.col("after").isNull() | F.col("before").isNotNull() & (alike(F.col("before")) >= alike(F.col("after")))
    return rows.select("host", "path", "digest", F.when(before, F.col("before")["digest"]).otherwise(F.col("after")["digest"]).alias("other"))


def differenced(pages: DataFrame) -> DataFrame:
    """(host, path, digest, sub, shared) of each address, its lines and sub in pages: of each line, whether the nearest page has it too; null without neighbours."""
    near = written(neighbours(pages), "neighbours")
    pairs = written(near.where("other is not null").groupBy("digest", "other").agg(F.count(F.lit(1)).alias("n")), "pairs")
    uses = pairs.select("digest").unionAll(pairs.select(F.col("other").alias("digest"))).groupBy("digest").agg(F.count(F.lit(1)).alias("weight"))
    names = written(pages.groupBy("digest").agg(F.first("names").alias("names")).join(uses, "digest"), "names")
    total = 2 * pairs.count()
    sides = written(met(pairs, names, ["digest"], total), "sides")
    sides = met(sides, names.select(F.col("digest").alias("other"), F.col("names").alias("other_names"), "weight"), ["other"], total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def apart(names: bytes) -> list[bytes]:
            return [names[i : i + NAME] for i in range(0, len(names), NAME)]

        for pdf in batches:
            shared = [sharing(apart(a), apart(b)) for a, b in zip(pdf["names"], pdf["other_names"])]
            yield pd.DataFrame({"digest": pdf["digest"], "other": pdf["other"], "weight": pdf["n"], "shared": shared})

    shared = sides.select("digest", "other", "n", "names", "other_names").mapInPandas(tidily(run), "digest string, other string, weight long, shared array<boolean>")
    shared = written(shared, "differences")
    wanted = pages.select("host", "path", "digest", "sub").distinct().join(near, ["host", "path", "digest"])
    return met(wanted, shared, ["digest", "other"], near.count(), "left").drop("other")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row of pages; n_shared: how many of its lines the page it was compared with has too."""
    small_batches(pages.sparkSession)
    found = written(differenced(written(parsed(pages, False).drop("page_id", "url"), "parsed")), "shared")
    rows = parsed(pages, True).join(found, ["host", "path", "digest", "sub"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for bare, blob, shared in zip(pdf["bare"], pdf["blob"], pdf["shared"]):
                text = zlib.decompress(blob).decode("utf-8", "surrogatepass")
                if bare and shared is not None:
                    text = "\n\n".join(line for line, gone in zip(text.split("\n\n"), shared) if not gone)
                texts.append(text)
            n_shared = [0 if x is None else int(sum(x)) for x in pdf["shared"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_shared": n_shared})

    out = with_ids(rows.select("page_id", "url", "bare", "blob", "shared"), tidily(run), "page_id long, url string, text string, n_shared long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
