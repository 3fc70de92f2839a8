"""The main text of web pages, by container paths that a host's pages agree on.

1. Each page scores its containers: characters of prose less characters of links
   and of parts marked as something else, a little more for containers marked as
   the article. The scores, as thousandths of the page's prose, are its votes.
2. Votes go to generalised paths: tags with their classes, digits taken out, from
   the root down. A task adds up its own votes, Spark those of a host; the path
   with most votes wins, the deeper one of equals.
3. Each page is read again with its host's winner. Where a page has no such
   container, its own best one serves.

A block is what block tags enclose; <br> is white space. In the winning container
the blocks of menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments go, told by tag, role, class or id; a header that holds
the article's heading stays, inside an article element or named as the article's. A part marked by its class or id alone that holds most
of a page's text is no such part, reader comments excepted. Where the winner is no
article or main element, parts that read the same on all of a host's pages (five at
least, while the winner's text differs) go too.

Defined cases: a null or empty page has an empty text; a null url, or one without a
host, belongs to the host of no name; pages that repeat vote each and give a row
each; an empty table gives no row; other columns are not read. Broken markup is
closed as browsers do in the common cases; a page's tree is held in memory, one page
at a time.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import lean, prepare, written

# The element names of HTML, and words that mark parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text but are never the container of an article.
LEAVES = HEADINGS | frozenset("p li ul ol dl dt dd pre table thead tbody tfoot tr th figure figcaption caption address details summary header #head".split())
#: An element on the left ends those on the right that are open above the nearest of BOUNDS.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
BOUNDS = frozenset("ul ol dl table #root".split())
NOISE_TAGS = frozenset("nav footer aside form button select textarea dialog menu noscript template svg object canvas iframe #head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adbox adsense adsbygoogle adslot advert adverts advertisement advertising sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login search searchbox widget widgets pagination pager skip paywall disclaimer form".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
ARTICLE_WORDS = frozenset("article content entry post story main text body".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
#: Of an element: by its tag, by its class or id, by a class or id of reader comments, as a header, as an article's header.
BY_TAG, BY_CLASS, BY_COMMENT, HEADER, OWN_HEADER = 1, 2, 4, 8, 16
PLAIN, MARKED, ARTICLE = 100, 110, 125
#: Pages of a host from which a part that never changes is the host's, not the article's.
SAME_PAGES = 5
VOTES = "host string, path long, label string, depth int, article boolean, votes long, pages long, own_low long, own_high long, low long, high long, heading boolean"


def _words(name: str) -> set[str]:
    found = {w.lower() for w in re.split(r"[-_\s]+", name)}
    found |= {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)}
    return found


@lru_cache(maxsize=20_000)
def described(tag: str, attributes: str) -> tuple[str, int, int]:
    """(generalised part of a path, marks, weight) of an element."""
    found = {a.lower(): entities.unescape(x or y or z) for a, x, y, z in reversed(ATTRIBUTE.findall(attributes))} if "=" in attributes else {}
    classes = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").split()})
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    words = set().union(*(_words(n) for n in names if not re.match(r"(has|with|no|without)[-_]", n))) if names else set()
    role = found.get("role", "").lower()
    marks = BY_TAG * (tag in NOISE_TAGS or role in NOISE_ROLES)
    if words & COMMENT_WORDS and tag not in ("html", "body", "main"):
        marks |= BY_COMMENT
    elif words & NOISE_WORDS and tag not in ("html", "body", "main", "article"):
        marks |= BY_CLASS
    if (tag == "header" or "header" in words) and tag not in ("html", "body", "main", "article"):
        marks |= OWN_HEADER if words & ARTICLE_WORDS - {"main", "body"} else HEADER
    weight = ARTICLE if tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" else MARKED if words & ARTICLE_WORDS else PLAIN
    return ".".join([tag, *classes]), marks, weight


class Page:
    """Elements in page order (parents before children) and blocks of text.

    ``blocks`` holds (element, text, characters inside links).
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.key, self.label, self.depth, self.marks, self.weight = [], [], [], [], [], [], []
        self.blocks: list[tuple[int, str, int]] = []
        self.links: dict[int, int] = {}
        self.headed: set[int] = set()
        self._stack: list[int] = []
        self._pieces: list[tuple[str, bool]] = []
        self._in_link = False
        self._open("#root", "")
        self._read(html)
        self._flush()
        self._judge()

    # Reading ---------------------------------------------------------------

    def _open(self, tag: str, attributes: str) -> None:
        part, marks, weight = described(tag, attributes)
        above = self._stack[-1] if self._stack else -1
        self.parent.append(above)
        self.tag.append(tag)
        self.key.append(xxhash.xxh64_intdigest(part, seed=self.key[above] & (1 << 64) - 1 if above >= 0 else 0) - (1 << 63))
        self.label.append(part)
        self.depth.append(self.depth[above] + 1 if above >= 0 else 0)
        self.marks.append(marks)
        self.weight.append(weight)
        self._stack.append(len(self.tag) - 1)

    def _flush(self) -> None:
        if not self._pieces:
            return
        raw = "".join(t for t, _ in self._pieces)
        text = " ".join(entities.unescape(raw).split())
        if text:
            linked = " ".join(entities.unescape("".join(t for t, a in self._pieces if a)).split())
            self.blocks.append((self._stack[-1], text, len(linked)))
        self._pieces = []

    def _text(self, text: str) -> None:
        if self.tag[self._stack[-1]] == "#head" and not text.isspace():
            self._close("#head")
        self._pieces.append((text, self._in_link))

    def _close(self, tag: str, within: frozenset | None = None) -> None:
        """Close up to the nearest open ``tag``, where there is one inside ``within``."""
        for k in range(len(self._stack) - 1, 0, -1):
            open_tag = self.tag[self._stack[k]]
            if open_tag == tag:
                self._flush()
                del self._stack[k:]
                return
            if within and open_tag in within:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if self.tag[self._stack[-1]] == "#head" and tag not in HEAD:
            self._close("#head")
        if tag == "br":
            self._pieces.append((" ", self._in_link))
            return
        if tag == "a":
            self._in_link = True
            self.links[self._stack[-1]] = self.links.get(self._stack[-1], 0) + 1
        if tag in INLINE:
            if "=" in attributes and described(tag, attributes)[1]:
                self._flush()
                self._open(tag, attributes)
            return
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        self._flush()
        if tag in ("html", "body") and tag in (self.tag[e] for e in self._stack):
            return
        self._close("p", BOUNDS)
        for other in ENDS.get(tag, ()):
            self._close(other, BOUNDS)
        if tag in HEADINGS:
            for e in self._stack:
                self.headed.add(e)
        self._open("#head" if tag == "head" else tag, attributes)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._in_link = False
        if tag == "br":
            self._pieces.append((" ", self._in_link))
        elif tag in INLINE:
            self._close(tag)
        elif tag not in ("html", "body"):  # what follows them belongs to them still
            self._flush()
            self._close("#head" if tag == "head" else tag, None if tag in ("table", "ul", "ol", "dl") else BOUNDS if tag in ENDS or tag == "p" else None)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            to = html.find("<", at)
            if to < 0:
                self._text(html[at:])
                return
            if to > at:
                self._text(html[at:to])
            after = html[to + 1 : to + 2]
            if html.startswith("<!--", to):
                end = html.find("-->", to + 2)
                at = n if end < 0 else end + 3
            elif after in ("!", "?"):
                end = html.find(">", to)
                at = n if end < 0 else end + 1
            elif m := TAG.match(html, to):
                closes, tag, attributes, at = m[1], m[2].lower(), m[3], m.end()
                if closes:
                    self._end(tag)
                    continue
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                    at = html.find(">", end.end()) + 1 or n if end else n
                    if tag in ("xmp", "noembed"):
                        self._flush()
                    continue
                self._start(tag, attributes)
                if attributes.endswith("/") and tag == "svg":
                    self._end(tag)
            elif after.isascii() and after.isalpha() or html.startswith("</", to):
                end = html.find(">", to)  # no tag: a bogus comment, or cut off
                at = n if end < 0 else end + 1
            else:
                self._text("<")
                at = to + 1

    # Judging ---------------------------------------------------------------

    def _judge(self) -> None:
        n = len(self.tag)
        chars, linked = [0] * n, [0] * n
        for e, text, inside in self.blocks:
            chars[e] += len(text)
            linked[e] += inside
        links = [self.links.get(e, 0) for e in range(n)]
        for e in range(n - 1, 0, -1):
            for sums in (chars, linked, links):
                sums[self.parent[e]] += sums[e]
        self.noisy, in_article = [False] * n, [False] * n
        for e in range(n):
            above = self.parent[e]
            tag, marks = self.tag[e], self.marks[e]
            if above >= 0:
                in_article[e] = in_article[above] or self.tag[above] in ("article", "main")
            own = bool(marks & BY_COMMENT) or bool(marks & (BY_CLASS | BY_TAG)) and not (2 * chars[e] > chars[0] and (not marks & BY_TAG or tag == "form"))
            if marks & (HEADER | OWN_HEADER):  # an article's own header holds its heading
                own = own or not (e in self.headed and (in_article[e] or marks & OWN_HEADER))
            if tag in ("ul", "ol", "dl"):  # a menu by its make: links alone
                own = own or links[e] >= 3 and linked[e] >= chars[e]
            self.noisy[e] = own or above >= 0 and self.noisy[above]
        self.prose, self.value = [0] * n, [0] * n
        for e, text, inside in self.blocks:
            if self.noisy[e] or 2 * inside >= len(text):
                self.value[e] -= len(text)
            else:
                self.prose[e] += len(text)
                self.value[e] += len(text)
        for e in range(n - 1, 0, -1):
            self.prose[self.parent[e]] += self.prose[e]
            self.value[self.parent[e]] += self.value[e]

    def containers(self) -> Iterator[int]:
        return (e for e in range(len(self.tag)) if self.prose[e] > 0 and not self.noisy[e] and self.tag[e] not in LEAVES and self.tag[e] not in INLINE)

    def score(self, e: int) -> int:
        return self.value[e] * (self.weight[e] if self.value[e] > 0 else 100)

    def best(self) -> int | None:
        return max(self.containers(), key=lambda e: (self.score(e), self.depth[e], -e), default=None)

    def votes(self) -> dict[int, list]:
        """By path: label, depth, whether marked as the article, votes, and fingerprints of own text and of all text."""
        found: dict[int, list] = {}
        own: dict[int, list[str]] = {}
        for e, text, _ in self.blocks:
            if not self.noisy[e]:
                own.setdefault(self.key[e], []).append(text)
                if self.key[e] not in found:
                    found[self.key[e]] = [self.label[e], self.depth[e], self.weight[e] == ARTICLE, 0, self.tag[e] in HEADINGS]
        for e in self.containers():
            row = found.setdefault(self.key[e], [self.label[e], self.depth[e], self.weight[e] == ARTICLE, 0, False])
            row[3] += max(0, 10 * self.score(e) // self.prose[0])
        # All text of the page stands for the text of its containers: it differs where theirs does.
        whole = xxhash.xxh64_intdigest("\n".join(t for e, t, _ in self.blocks if not self.noisy[e])) - (1 << 63)
        return {key: [*row, xxhash.xxh64_intdigest("\n".join(own.get(key, ()))) - (1 << 63), whole] for key, row in found.items()}

    def text(self, winner: int | None = None, same: frozenset = frozenset()) -> str:
        """The blocks of the winning containers, or else of this page's best one."""
        chosen = {e for e in self.containers() if self.key[e] == winner} if winner is not None else set()
        if not chosen:
            best = self.best()
            chosen, same = ({best} if best is not None else set()), frozenset()
        inside = [False] * len(self.tag)
        for e in range(len(self.tag)):
            above = self.parent[e]
            inside[e] = e in chosen or above >= 0 and inside[above]
        return "\n\n".join(t for e, t, _ in self.blocks if inside[e] and not self.noisy[e] and self.key[e] not in same)


def host(url: Column) -> Column:
    """The host of a url, lower-cased, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


@lean
def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in VOTES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in VOTES.split(", ")])
    held: dict[tuple[str, int], list] = {}

    def sums() -> pa.RecordBatch:
        rows = [(h, key, *row) for (h, key), row in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(zip(*rows), names)], schema=schema)

    for b in batches:
        for where, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            if not page:
                continue
            for key, (label, depth, article, votes, heading, own, whole) in Page(page).votes().items():
                row = held.get((where, key))
                if row is None:
                    held[where, key] = [label, depth, article, votes, 1, own, own, whole, whole, heading]
                else:
                    row[3] += votes
                    row[4] += 1
                    row[5], row[6], row[7], row[8] = min(row[5], own), max(row[6], own), min(row[7], whole), max(row[8], whole)
        if len(held) >= 20_000:
            yield sums()
            held.clear()
    if held:
        yield sums()


def winners(pages: DataFrame) -> DataFrame:
    """One row per host: host, path, label, votes, pages, and ``same``, the paths that never change."""
    prepare(pages.sparkSession)
    rows = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    sums = rows.mapInArrow(_vote, VOTES).groupBy("host", "path").agg(
        F.max("label").alias("label"), F.max("depth").alias("depth"), F.max("article").alias("article"), F.sum("votes").alias("votes"), F.sum("pages").alias("pages"),
        F.min("own_low").alias("own_low"), F.max("own_high").alias("own_high"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("heading").alias("heading"),
    )
    never = (F.col("own_low") == F.col("own_high")) & (F.col("low") != F.col("high")) & (F.col("pages") >= SAME_PAGES) & ~F.col("heading")
    best = F.max(F.struct("votes", "depth", "path", "label", "article", "pages")).alias("best")
    found = sums.groupBy("host").agg(best, F.collect_set(F.when(never, F.col("path"))).alias("same"))
    kept = F.when(F.col("best.article"), F.array().cast("array<long>")).otherwise(F.col("same"))
    return found.where("best.votes > 0").select("host", "best.path", "best.label", "best.votes", "best.pages", kept.alias("same"))


@lean
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("html", "path", "same"))
        found = [Page(page).text(path, frozenset(same or ())) if page else "" for page, path, same in zip(*columns)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), b.column("label")], ["page_id", "url", "text", "label"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, label) of every page; ``label`` is the last part of its host's winning path.

    Winners are written first, so Spark knows their size: a small table is broadcast,
    a large one joined by host, where it splits hot hosts.
    """
    found = written(winners(pages), "main-text-winners")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    joined = rows.join(found.select("host", "path", "label", "same"), "host", "left").select("page_id", "url", "html", "path", "label", "same")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, label string")
