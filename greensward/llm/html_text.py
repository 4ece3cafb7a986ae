"""Main text of web pages by removing what a site repeats.

Every page is parsed into a flat tree. Each element subtree is hashed from its tag, classes and content; Spark counts
the pages of a host on which a hash occurs, and subtrees that recur on eight or more (least_pages) are deleted, along with parts
that HTML itself marks as no main text (nav, footer, forms, scripts, adverts, comments, ...). Of what is left the articles are
read, else the main element, else the body. Prose blocks of an article (paragraphs, headings, quotes, list
items) are never deleted as a template: many pages may quote the same passage.

Text: character references decoded, white space inside a block one space, trimmed, blocks in page order joined by one
newline. Defined results: null and empty pages, and pages without text, give an empty string; pages without a url
share one host; tags, comments and quotes that nothing closes reach to the end of the page and are dropped with it; repeated rows are counted and
returned each. Pages are parsed in time linear in their length, however malformed.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: A comment; a tag with its attributes, where only a quote right after = opens a quoted value; or a declaration. Each part is taken once and
#: never given back, so a page is read in one pass; what isn't closed ends with the page.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|[^=>]++)*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
TOLD = re.compile(r"class|id|role|hidden|style", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s]*+))?""")
KEYS = frozenset("class id role hidden style aria-hidden".split())
CHROME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|footer|masthead|site-?header|page-?header|ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*"
    r"|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|sign-up|share|sharing|social|related|recommend\w*|read-?more|comments?|commentlist|respond|replies|reply|disqus"
    r"|widget|pagination|pager|toolbar|skip-?link|login|search)(?:$|[\s_-])",
    re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
OFF = frozenset("head nav footer aside form script style noscript template iframe textarea title select button svg canvas object audio video dialog menu datalist".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr code em strong b i a span sup sub q cite article main body html".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
ENDS_P = BLOCK - {"body", "html", "legend", "summary", "caption", "tbody", "tfoot", "thead", "tr"}
BREAKS_P = BLOCK - {"p"} | {"td", "th", "button"}  # an open p outside one of these isn't ended by what stands in it
WALLS = frozenset("article td th table".split())  # an end tag doesn't reach out of these, unless it is one of the next
THROUGH_WALLS = frozenset("article main body html table tr section div".split())
#: A start tag of the first ends an open element of the second, unless one of the third stands between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}


class Page:
    """Elements in page order: tag, parent, marks (their classes and the like), whether HTML marks them as off; and the texts in order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.marks, self.off = ["#root"], [-1], [""], [False]
        self.texts: list[tuple[int, str]] = []  # node and its text; an empty text is a break between blocks
        self.items: list[tuple[int, int]] = []  # in page order: (node, -1) for an element, (node, k) for texts[k]
        self._parse(source)

    def _text(self, node: int, text: str) -> None:
        if text:
            self.items.append((node, len(self.texts)))
            self.texts.append((node, text))

    def _parse(self, source: str) -> None:
        stack, at, tag = [0], 0, self.tag
        places: dict[str, list[int]] = defaultdict(list)  # of open elements: by name, where they are in the stack
        walls: list[int] = []  # of WALLS
        blocks: list[int] = []  # of BREAKS_P

        def close(k: int) -> None:
            """Take all from place k on off the stack."""
            while len(stack) > k:
                name = tag[stack.pop()]
                places[name].pop()
                if name in WALLS:
                    walls.pop()
                if name in BREAKS_P:
                    blocks.pop()

        last = lambda name: places[name][-1] if places.get(name) else 0
        find = TOKEN.search
        while m := find(source, at):
            if m.start() > at:
                self._text(stack[-1], source[at : m.start()])
            at = m.end()
            if not m[2] or not m[4]:
                continue
            name = m[2].lower()
            if m[1]:
                k = last(name)
                if k and (name in THROUGH_WALLS or not walls or k >= walls[-1]):
                    close(k)
                continue
            if name in ENDS_P and last("p") > (blocks[-1] if blocks else 0):
                close(last("p"))
            if name in SIBLINGS:
                ended, within = SIBLINGS[name]
                outer = max(map(last, within))
                inner = [held[k] for held in (places[e] for e in ended if e in places) if (k := bisect(held, outer)) < len(held)]
                if inner:
                    close(min(inner))
            node = len(tag)
            marks, hidden, role = "", False, ""
            if len(m[3]) > 2 and TOLD.search(m[3]):
                for key, value in ATTRIBUTE.findall(m[3]):
                    key = key.lower()
                    if key not in KEYS:
                        continue
                    value = value.strip("\"'")
                    if key in ("class", "id"):
                        marks += " " + value
                    elif key == "role":
                        role = value.lower()
                    elif key == "style":
                        hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                    else:
                        hidden |= key == "hidden" or value.lower() == "true"
            tag.append(name)
            self.parent.append(stack[-1])
            self.marks.append(marks)
            named = bool(marks) and name not in ("article", "main", "body", "html") and CHROME.search(marks) is not None
            self.off.append(hidden or name in OFF or role in OFF_ROLES or named or (name == "header" and not last("article")))
            self.items.append((node, -1))
            if name in VOID:
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                self._text(node, source[at : end.start() if end else len(source)])
                at = end.end() if end else len(source)
            elif not m[3].endswith("/"):
                places[name].append(len(stack))
                if name in WALLS:
                    walls.append(len(stack))
                if name in BREAKS_P:
                    blocks.append(len(stack))
                stack.append(node)
        self._text(stack[-1], source[at:])

    def subtree_hashes(self) -> list[int]:
        """Of each element: 64 bits from its tag, marks, and texts and elements inside, 0 where it holds no text."""
        inside: list[list[str]] = [[] for _ in self.tag]
        held, out = [False] * len(self.tag), [0] * len(self.tag)
        for node, k in reversed(self.items):
            if k >= 0:
                text = " ".join(self.texts[k][1].split())
                if text:
                    inside[node].append(text)
                    held[node] = True
            else:
                h = xxhash.xxh3_64_intdigest("\x01".join([self.tag[node], self.marks[node], *reversed(inside[node])]))
                inside[node].clear()
                inside[self.parent[node]].append(f"\x02{h:x}")
                if held[node]:
                    held[self.parent[node]] = True
                    out[node] = h - 2**63
        return out

    def inside(self, name: str) -> list[bool]:
        """Whether each element is of this name or inside one that isn't off."""
        out = [False] * len(self.tag)
        for i in range(1, len(out)):
            out[i] = out[self.parent[i]] or (self.tag[i] == name and not self.off[i])
        return out

    def repeatable(self) -> list[int]:
        """Distinct hashes of subtrees that may be a template: all with text, but for prose of articles."""
        article = self.inside("article")
        return sorted({h for i, h in enumerate(self.subtree_hashes()) if h and self.tag[i] not in ("html", "body", "head") and not (article[i] and self.tag[i] in PROSE)})

    def main_text(self, template: set[int], marked: bool = True) -> str:
        """Text of what is left without templates and, if `marked`, without what tags, classes and roles mark as no main text."""
        n = len(self.tag)
        off = self.off if marked else [t in RAW or t == "head" for t in self.tag]
        article, main = self.inside("article"), self.inside("main")
        hashes = self.subtree_hashes() if template else [0] * n
        gone = [False] * n
        for i in range(1, n):
            prose = article[i] and self.tag[i] in PROSE
            gone[i] = gone[self.parent[i]] or off[i] or (hashes[i] in template and not prose)
        region = next((r for r in (article, main) if any(a and not g for a, g in zip(r, gone))), [True] * n)
        blocks, line = [], []
        block_of, last = [0] * n, 0
        for i in range(1, n):
            block_of[i] = i if self.tag[i] in BLOCK else block_of[self.parent[i]]
        for node, k in self.items:
            if block_of[node] != last:
                last = block_of[node]
                blocks.append(line)
                line = []
            if k >= 0:
                if region[node] and not gone[node]:
                    line.append(html.unescape(self.texts[k][1]))
            elif self.tag[node] in ("br", "td", "th", "img", "wbr"):
                line.append(" " if self.tag[node] != "wbr" else "")
        blocks.append(line)
        return "\n".join(b for b in (" ".join("".join(x).split()) for x in blocks) if b)


HOST = "lower(coalesce(regexp_extract({0}, '^[^:]*://([^/?#]*)', 1), ''))"


def page_templates(rows: DataFrame, least_pages: int) -> DataFrame:
    """(k1, k2, template): of each page, by the keys of `rows`, the hashes inside it that occur on at least so many pages of its host. A page's
    array is bounded by its elements; templates meet pages as single (host, hash) rows, however many a host has."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(h).repeatable() if h else [] for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["k1", "k2", "host", "hashes"])

    seen = rows.select("k1", "k2", "host", "html").mapInArrow(hashes, "k1 long, k2 int, host string, hashes array<long>").select("k1", "k2", "host", F.explode("hashes").alias("h"))
    templates = staged(seen.groupBy("host", "h").agg(F.count("*").alias("n")).where(f"n >= {least_pages}").select("host", "h"), "templates")
    return seen.join(templates, ["host", "h"]).groupBy("k1", "k2").agg(F.collect_set("h").alias("template"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 8, marked: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; marked: tags, classes and roles that mark chrome count besides templates."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.expr(HOST.format(url_col)).alias("host"))
    rows = rows.select("*", F.xxhash64("host", "html").alias("k1"), F.hash("host", "html").alias("k2"))  # pages of a host with the same source share their templates
    joined = rows.join(page_templates(rows, least_pages), ["k1", "k2"], "left").select("page_id", "url", "html", "template")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, templates = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = [Page(h).main_text(set(t or ()), marked) if h else "" for h, t in zip(sources, templates)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
