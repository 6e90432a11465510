"""Main text of pages by consensus host paths.

Each page is parsed once to score its containers: a block of text counts for the containers around it,
less with each step outwards, and less the more of it is links. The best containers vote, with their
share of the page's score, for their path of tags and classes (digits blotted out). Spark adds the votes
up per host; the path with most votes wins. In a second pass a page's text is taken from the containers
on its host's winning path, or from its own best container where the page has none.
"""

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm import words

# ---- fixed values: element names and common class words
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
PARAGRAPHS = frozenset("p li dd dt td th pre blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body head main article section div header footer nav aside form fieldset ul ol dl table thead tbody "
    "tfoot tr figure address details dialog menu center hgroup search legend option optgroup noscript "
    "template iframe object video audio canvas svg select button".split())
#: Elements whose content is never main text.
BARRED = frozenset("head nav footer aside form noscript template iframe object svg canvas select button dialog "
                   "menu search script style textarea title xmp noframes option".split())
#: Class, id and role words of what surrounds an article.
BARRED_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer contentinfo sidebar "
    "aside complementary widget widgets ad ads advert adverts advertisement adsense sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay newsletter "
    "subscribe subscription signup login search searchbox form share sharing social comment comments commentlist "
    "respond reply replies discussion disqus related recommended recommendations pagination pager skip "
    "toolbar toc copyright legal disclaimer".split())
GOOD_WORDS = frozenset("article post entry story content main body text page".split())
#: A new element of the first kind ends an open one of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr")}
ATTRIBUTES = frozenset("class id role hidden aria-hidden style".split())
SCOPES = frozenset("table ul ol dl body html select button".split())

# a quote opens a value only after "=", and one that is never closed does not; so each kind is sought in vain once
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What a block counts for the containers around it, from the nearest outwards.
DECAY = (1.0, 0.7, 0.5, 0.35)
#: Innermost steps that make a path, and elements that may be open at once; what is nested deeper counts
#: for the innermost of these, as in browsers.
STEPS = 8
DEPTH = 512
#: Candidates of a page that vote.
VOTES = 3
#: A barred class on an element with more than this share of the page's text is a layout's, not barred.
LAYOUT_SHARE = 0.6
#: Share of its own best container's score that a page's containers on the winning path need.
LEAST_SHARE = 0.3


class Page:
    """Elements and text blocks of a page."""

    def __init__(self, html: str):
        self.parent, self.tag, self.step, self.barred, self.good = [-1], ["#"], ["#"], [False], [False]
        self.hard = [False]  # barred by its element name or hidden
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of links
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]  # open elements
        text: list[str] = []
        links, linked, at = 0, 0, 0

        def flush():
            nonlocal linked
            if text:
                words_ = unescape("".join(text)).split()
                if words_:
                    joined = " ".join(words_)
                    self.blocks.append((stack[-1][1], joined, min(linked, len(joined))))
                text.clear()
            linked = 0

        def close(index: int) -> None:
            """End the open elements from ``index`` on."""
            nonlocal links
            if any(name in BLOCKS for name, _ in stack[index:]):
                flush()
            links -= sum(name == "a" for name, _ in stack[index:])
            del stack[index:]

        def last(names: tuple[str, ...], scopes: frozenset) -> int:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    return i
                if stack[i][0] in scopes:
                    break
            return 0

        length = len(html)
        while at < length:
            found = _TOKEN.search(html, at)
            stop = found.start() if found else length
            if stop > at:
                piece = html[at:stop]
                text.append(piece)
                if links:
                    linked += len(piece)
            if not found:
                break
            at = found.end()
            name = found["tag"]
            if name is None:
                if found.group().startswith("<![CDATA["):
                    text.append(found.group()[9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if found["end"]:
                if name == "p" and not last(("p",), SCOPES):
                    flush()
                elif index := last((name,), frozenset(("table",)) if name not in BLOCKS else frozenset()):
                    close(index)
                continue
            if name == "br" or name == "hr":
                flush()
                continue
            if name in VOID:
                continue
            rest = found["rest"]
            if name in RAW:  # its content is no markup
                end = re.compile(f"</{name}[^>]*>", re.I).search(html, at)
                at = end.end() if end else length
                continue
            if name in BLOCKS:
                flush()
                if index := last(("p",), SCOPES):
                    close(index)
                if name in CLOSES and (index := last(CLOSES[name], SCOPES)):
                    close(index)
            if rest.endswith("/") and name not in BLOCKS and "=" not in rest:
                continue
            inside = stack[-1][1]
            if name in BLOCKS or rest.strip():
                inside = self._element(name, rest, inside)
                if name not in BLOCKS and not self.barred[inside]:
                    inside = stack[-1][1]  # inline elements matter only if they are barred
                elif name not in BLOCKS:
                    at = self._inline_end(html, at, name)
                    continue
            if len(stack) < DEPTH:
                links += name == "a"
                stack.append((name, inside))
        flush()

    @staticmethod
    def _inline_end(html: str, at: int, name: str) -> int:
        """Where a barred inline element ends: at its closing tag."""
        depth = 1
        for found in re.compile(f"<(/?){re.escape(name)}\\b[^>]*>", re.I).finditer(html, at):
            depth += -1 if found[1] else 1
            if not depth:
                return found.end()
        return at

    def _element(self, name: str, rest: str, parent: int) -> int:
        classes, terms, hidden = "", set(), False
        if rest.strip():
            for found in _ATTRIBUTE.finditer(rest):
                key = found[1].lower()
                if key not in ATTRIBUTES:
                    continue
                value = (found[2] or found[3] or found[4] or "")
                if key == "style":
                    hidden |= bool(_HIDDEN.search(value))
                elif key == "hidden" or key == "aria-hidden":
                    hidden |= key == "hidden" or value.lower() == "true"
                else:
                    terms.update(_WORD.findall(value.lower()))
                    if key == "class":
                        classes = ".".join(sorted({_DIGITS.sub("#", x) for x in value.lower().split()}))
        self.parent.append(parent)
        self.tag.append(name)
        self.step.append(f"{name}.{classes}" if classes else name)
        # a header inside an article holds its title
        header = name == "header" and not self._within(parent, "article")
        self.hard.append(name in BARRED or header or hidden)
        words_ = bool(terms & BARRED_WORDS) and name not in ("html", "body", "main", "article")
        if words_ and name == "header" and not header:
            words_ = bool(terms & BARRED_WORDS - {"header"})
        comment = name == "article" and bool(terms & {"comment", "comments", "reply", "related", "ad", "sponsored", "promo"})
        self.barred.append(self.hard[-1] or words_ or comment)
        self.good.append(name in ("article", "main") or bool(terms & GOOD_WORDS))
        return len(self.tag) - 1

    def _within(self, element: int, name: str) -> bool:
        while element > 0:
            if self.tag[element] == name:
                return True
            element = self.parent[element]
        return False

    def path(self, element: int) -> str:
        """Tags and classes of an element and those around it, ``STEPS`` at most."""
        steps = []
        while element >= 0 and len(steps) < STEPS:
            steps.append(self.step[element])
            element = self.parent[element]
        return ">".join(reversed(steps))

    def settle(self) -> None:
        """Which elements are out, with all that is in them, and the score of each container."""
        n = len(self.tag)
        size = [0] * n
        for element, text, _ in self.blocks:
            size[element] += len(text)
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        self.out = [False] * n
        for i in range(1, n):
            layout = self.barred[i] and not self.hard[i] and size[i] > LAYOUT_SHARE * size[0]
            self.out[i] = self.out[self.parent[i]] or (self.barred[i] and not layout)
        self.score = [0.0] * n
        for element, text, linked in self.blocks:
            if self.out[element]:
                continue
            value = len(text) - linked
            at = self.parent[element] if self.tag[element] in PARAGRAPHS else element
            for weight in DECAY:
                while at > 0 and self.tag[at] in PARAGRAPHS:
                    at = self.parent[at]
                if at < 0:
                    break
                self.score[at] += weight * value
                at = self.parent[at]
        for i in range(1, n):
            if self.tag[i] == "article":
                self.score[i] *= 2.0
            elif self.good[i] and self.tag[i] != "body":
                self.score[i] *= 1.5

    def candidates(self) -> list[tuple[str, float]]:
        """Paths of the best containers with their share of the page's score."""
        by_path: dict[str, float] = {}
        for i, score in enumerate(self.score):
            if score > 0:
                path = self.path(i)
                by_path[path] = by_path.get(path, 0.0) + score
        total = sum(by_path.values())
        best = sorted(by_path.items(), key=lambda x: (-x[1], x[0]))[:VOTES]
        return [(path, score / total) for path, score in best]

    def text(self, winner: str | None) -> tuple[str, str]:
        """Text and path of the containers on ``winner``, or of the page's own best."""
        if not any(self.score):
            return "", ""
        best = max(range(len(self.score)), key=lambda i: (self.score[i], -i))
        paths = {i: self.path(i) for i, score in enumerate(self.score) if score > 0}
        on = [i for i, p in paths.items() if p == winner]
        if sum(self.score[i] for i in on) < LEAST_SHARE * self.score[best]:
            on = [i for i, p in paths.items() if p == paths[best]]
        inside = [False] * len(self.tag)
        for i in on:
            inside[i] = True
        for i in range(1, len(self.tag)):
            inside[i] = inside[i] or inside[self.parent[i]]
        return " ".join(t for e, t, _ in self.blocks if inside[e] and not self.out[e]), paths[on[0]]


def _vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.pieces(batches, "html"):
        votes: dict[tuple[str, str], float] = {}
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html or "")
            page.settle()
            for path, share in page.candidates():
                votes[host, path] = votes.get((host, path), 0.0) + share
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()),
             pa.array(list(votes.values()), pa.float64())], ["host", "path", "votes"])


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.pieces(batches, "html"):
        texts, paths = [], []
        for html, winner in zip(batch.column("html").to_pylist(), batch.column("winner").to_pylist()):
            page = Page(html or "")
            page.settle()
            text, path = page.text(winner)
            texts.append(text)
            paths.append(path)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(paths, pa.string())],
            ["page_id", "url", "text", "path"])


def extract_texts(pages: DataFrame) -> DataFrame:
    """Main text of each page, from its whole html.

    Returns one row per input row: page_id, url, text (blocks in page order, joined by one space), path (of
    the container it comes from, empty if none). A null html counts as empty and has an empty text. Pages
    of a null address, or one without ``://``, have no host: they neither vote nor follow a winner. Ties of
    votes go to the path that sorts last. Repeated rows stay; other columns are left out.
    """
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
                         F.when(host != "", host).alias("host"))
    votes = (pages.where("host IS NOT NULL").select("host", "html").mapInArrow(_vote, "host string, path string, votes double")
             .groupBy("host", "path").agg(F.sum("votes").alias("votes")))
    winners = words.stored(
        votes.groupBy(F.col("host").alias("_host")).agg(F.max_by("path", F.struct("votes", "path")).alias("winner")), "paths")
    return (pages.join(winners, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "winner")
            .mapInArrow(_extract, "page_id long, url string, text string, path string"))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
