"""HTML extraction with a site style tree: pages of one host are merged, and branches of low importance are removed.

Every block of a page (an element such as ``div``, ``li`` or ``p``) is a node of its host's style tree, named by a digest
of the path of tags, ids and classes that leads to it; a second tree merges the pages of all hosts. For each node the tree
counts over the distinct pages that have it (copies of a page count once) how their presentation (the tags below) and
their content (the sequences of three words in the text right below it) are spread. The importance of either is
exp(entropy) / pages, the share of pages that still differ: one if no two pages have anything in common, and near zero for
menus, notices and legal lines that come again and again. A host with few pages of a node backs off to the tree of all
hosts; of both, the lower importance counts.

Tags, roles, names and the place on the page only seed the importance, by a factor (see ``SEEDS``): text is removed where
factor times importance is under THRESHOLD. So a block named ``legal`` stays if its text differs on every page, and one
without any name goes if it repeats. Only where no tree knows a node (on fewer than LEAST_PAGES pages) does the seed decide
alone. Reader comments differ on every page by nature, so their factor is zero. The article's own text, as far as the page
marks it, has importance one; scripts, styles, forms and what a browser doesn't show are no text at all.

Character references are decoded; white space inside a block becomes one space; blocks are joined by one space. A null
or empty page has an empty text. Rows with a null id are kept; repeated rows each give a row (and count once in the tree).
Urls without a host share one tree. Texts of any length are read whole. Further columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import stored, table

#: Distinct pages that must have a node, the importance under which it is removed, the weight of content, words of a feature.
LEAST_PAGES, THRESHOLD, CONTENT, FEATURE = 5, 0.5, 0.7, 3
#: Factors of importance: by what a block is seeded.
SEEDS = {"comment": 0.0, "tag": 0.5, "outside": 0.6, "name": 0.7, "none": 1.0}

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template head title form button input select textarea option iframe svg canvas object applet audio video map math".split())
BESIDE = frozenset("nav footer aside dialog menu".split())
CLOSES_P = BLOCKS - frozenset("option title caption legend summary td th tr tbody thead tfoot html head body".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "p": ("p", ("article", "main", "section", "div", "body", "td", "li", "blockquote"))}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in ids and classes by which sites name what mostly isn't the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banners?|sponsor\w*|promo\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|footer|header|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|widgets?|toolbar|pagination|pager|skip|copyright|legal|disclaimer|tags?|byline|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:-?(?:body|content|text))?(?:$|[\s])", re.IGNORECASE)
HEADS = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.IGNORECASE)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|comment-?\w*|respond|replies|reply|disqus)(?:$|[\s_-])", re.IGNORECASE)
FOREIGN = re.compile(r"comment|repl(?:y|ies)|respond|related|recommend|sponsor|advert|promo|teaser", re.IGNORECASE)
WHOLE = frozenset(("html", "body", "main"))


class Node:
    """An element: ``block`` is the path of the block that its text belongs to, ``seed`` the factor of its importance
    (None: what lies in it is no text), ``rank`` says how clearly it marks the article (0: not at all), ``inside`` that it
    lies in an ``article``."""

    __slots__ = ("tag", "name", "path", "block", "seed", "rank", "children", "inside")

    def __init__(self, tag: str, name: str = "", path: int = 0, block: int = 0, seed: float | None = 1.0, rank: int = 0, inside: bool = False):
        self.tag, self.name, self.path, self.block, self.seed, self.rank, self.inside = tag, name, path, block, seed, rank, inside
        self.children: list = []


def number(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


class Page(HTMLParser):
    """A page as a tree of nodes and texts, made to stand unclosed and misplaced tags."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.stack = [self.root]
        self.feed(html.replace("\0", "\ufffd"))
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        stack = self.stack
        if tag in SIBLINGS or tag in CLOSES_P:
            ends, stops = SIBLINGS.get(tag, ("p", ()))
            ends = ends.split()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends or (stack[i].tag == "p" and tag in CLOSES_P):
                    del stack[i:]
                    break
                if stack[i].tag in stops or stack[i].tag in ("table", "td", "th", "article", "div", "section", "body"):
                    break
        up = stack[-1]
        values = dict(attrs)
        name = " ".join(filter(None, (values.get("id"), values.get("class"))))
        path = number(f"{up.path}/{tag}.{re.sub('[0-9]+', '0', name)}")
        role = (values.get("role") or "").lower()
        seed = up.seed
        if seed is not None:
            if tag in HIDDEN or "hidden" in values:
                seed = None
            else:
                seed = min(seed, self.seed(tag, name, role, up.inside))
        rank = 0
        if seed == 1.0 and not up.inside:
            rank = 3 if tag == "article" or values.get("itemprop") == "articleBody" else 2 if tag == "main" or role in ("main", "article") else 1 if name and tag in ("div", "section") and MAIN_NAMES.search(name) else 0
        node = Node(tag, name, path, path if tag in BLOCKS else up.block, seed, rank, up.inside or rank == 3)
        up.children.append(node)
        if tag not in VOID:
            stack.append(node)

    def seed(self, tag: str, name: str, role: str, inside: bool) -> float:
        """The factor that an element gives to all that it holds."""
        if name and tag not in WHOLE and COMMENTS.search(name):
            return SEEDS["comment"]
        if tag in BESIDE or role in ROLES or (tag == "header" and not inside):
            return SEEDS["tag"]
        if tag in ("article", "main"):
            if FOREIGN.search(name):
                return SEEDS["name"]
            # a wrapper that is named after something beside the article holds it all the same
            if all(n.seed is not None and n.seed >= SEEDS["name"] and not FOREIGN.search(n.name) for n in self.stack):
                for n in self.stack:
                    n.seed = SEEDS["none"]
            return SEEDS["none"]
        if name and tag not in WHOLE and not MAIN_NAMES.search(name) and NAMES.search(HEADS.sub(" ", name) if inside else name):
            return SEEDS["name"]
        return SEEDS["none"]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing on an HTML element

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
        if tag == "br":
            self.stack[-1].children.append(Node("br"))

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)

    def mark(self) -> int:
        """The clearest kind of mark that holds at least a third as much text as any other kind; 0 without marks."""
        held, work = {0: 0}, [(self.root, 0)]
        while work:
            node, under = work.pop()
            under |= 1 << node.rank
            for c in node.children:
                if isinstance(c, Node):
                    work.append((c, under))
                elif node.seed == 1.0:
                    for rank in (1, 2, 3):
                        if under >> rank & 1:
                            held[rank] = held.get(rank, 0) + len(c)
        return max(rank for rank, n in held.items() if rank == 0 or 3 * n >= max(held.values()))

    def pieces(self) -> Iterator[tuple[str, int, float, bool]]:
        """The texts in page order: text, block, factor, whether it lies in the marked article; at each border of a block
        a null character, at each line break a space (of the factor one, in the article)."""
        wanted = self.mark()
        work: list = [(self.root, self.root, not wanted)]
        marked = wanted > 0
        while work:
            x, up, on = work.pop()
            if isinstance(x, str):
                if x == "\0" or up.seed is not None:
                    yield x, up.block, 1.0 if x == "\0" else up.seed if on else min(up.seed, SEEDS["outside"]), on and marked
                continue
            on = on or (marked and x.rank == wanted)
            if x.tag in BLOCKS:
                yield "\0", x.block, 1.0, True
                work.append(("\0", x, on))
            elif x.tag == "br":
                yield " ", x.block, 1.0, True
            if x.seed is not None:
                work.extend((c, x, on) for c in reversed(x.children))


def kept(factor: float, article: bool, importance: float | None) -> bool:
    """Whether a block's text stays, by its seed and its importance (None: no tree knows it)."""
    if article and factor == SEEDS["none"]:
        return True
    if importance is None:
        return factor == SEEDS["none"] or (article and factor == SEEDS["name"])
    return factor * importance >= THRESHOLD


def main_text(html: str | None, tree: dict[int, float] | None = None) -> str:
    """The article of a page; ``tree`` has the importance of blocks by path. Without a tree all text stays."""
    if not html:
        return ""
    pieces = Page(html).pieces()
    text = "".join(x for x, block, factor, article in pieces if tree is None or kept(factor, article, tree.get(block)))
    return " ".join(b for b in (" ".join(block.split()) for block in text.split("\0")) if b)


def features(html: str | None) -> tuple[int, list[tuple[int, int, list[int]]]] | None:
    """A digest of what the page shows, and for each block outside of the marked article's own text: its path, its
    presentation (a hash of the tags below it, of all such blocks of the page) and the distinct features of its text."""
    if not html:
        return None
    page = Page(html)
    words: dict[int, list[str]] = {}
    shown = []
    for text, block, factor, article in page.pieces():
        if text != "\0":
            shown.append(text)
            if not (article and factor == SEEDS["none"]) and factor > 0 and text.strip():
                words.setdefault(block, []).extend(text.split())
    shapes: dict[int, list[str]] = {b: [] for b in words}
    work = [page.root]
    while work:
        node = work.pop()
        if node.path in shapes:
            shapes[node.path].append(" ".join(c.tag for c in node.children if isinstance(c, Node)))
        work.extend(c for c in node.children if isinstance(c, Node))
    out = []
    for block, w in words.items():
        grams = {number("\0".join(w[i : i + FEATURE])) for i in range(max(1, len(w) - FEATURE + 1))}
        out.append((block, number("\0".join(shapes[block])), sorted(grams)))
    return number(repr((" ".join("".join(shown).split()), [x[:2] for x in out]))), out


def hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def style_tree(pages: DataFrame) -> DataFrame:
    """For each host and path: distinct pages on the host and on all hosts, and the importance (null if neither tree has
    enough pages) from the entropies of presentation and content."""
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            hosts, digests, ends, out = [], [], [0], ([], [], [])
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = features(html.as_py())
                if page and page[1]:
                    for column, values in zip(out, zip(*page[1], strict=True), strict=True):
                        column.extend(values)
                    hosts.append(host)
                    digests.append(page[0])
                    ends.append(len(out[0]))
            nodes = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["path", "shape", "grams"])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes)], ["host", "page", "nodes"])

    found = pages.select("host", "html").mapInArrow(run, "host string, page bigint, nodes array<struct<path: bigint, shape: bigint, grams: array<bigint>>>")
    nodes = found.groupBy("host", "page").agg(F.first("nodes").alias("nodes")).select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    # the presentation has the place null beside the features
    values = nodes.select("host", "path", F.explode(F.concat(F.array(F.struct(F.lit(False).alias("text"), F.col("shape").alias("v"))), F.transform("grams", lambda g: F.struct(F.lit(True).alias("text"), g.alias("v"))))).alias("x"))
    counts = values.groupBy("host", "path", "x.text", "x.v").agg(F.count(F.lit(1)).alias("n"))

    def importance(counts: DataFrame, *keys: str) -> DataFrame:
        """Of each node: exp of the negative mean logarithm of how many pages have the same; exp(entropy) / pages."""
        mean = lambda text: F.sum(F.when(F.col("text") == text, F.col("n") * F.log("n"))) / F.sum(F.when(F.col("text") == text, F.col("n")))
        return counts.groupBy(*keys).agg(F.sum(F.when(~F.col("text"), F.col("n"))).alias("n"), (CONTENT * F.exp(-mean(True)) + (1 - CONTENT) * F.exp(-mean(False))).alias("i"))

    own = importance(counts, "host", "path")
    every = importance(counts.groupBy("path", "text", "v").agg(F.sum("n").alias("n")), "path").select("path", F.col("n").alias("n_all"), F.col("i").alias("i_all"))
    enough = lambda n, i: F.when(F.col(n) >= LEAST_PAGES, F.col(i))
    return own.join(every, "path").select("host", "path", F.col("n").alias("n_pages"), "n_all", F.least(enough("n", "i"), enough("n_all", "i_all")).alias("importance"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""
    pages = hosted(pages)
    # The list of known nodes, of known size once it is stored, is broadcast if small; else Spark splits large hosts.
    tree = style_tree(pages).where("importance IS NOT NULL").groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("tree"))
    tree = stored(tree)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, dict[int, float]] = {}
        for batch in rows:
            found = []
            for host, html, nodes in zip(batch.column(4).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if host not in trees:
                    if len(trees) >= 64:
                        trees.clear()
                    trees[host] = {x["path"]: x["importance"] for x in nodes.as_py() or ()}
                found.append(main_text(html.as_py(), trees[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.join(tree, "host", "left").select("page_id", "url", "html", "tree", "host").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))
