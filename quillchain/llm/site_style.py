"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element node is known by its place (its
parent, the parent's style and its position there), a style is the sequence of an
element's children.  How much the styles of a node vary over the host's pages, and how
much its texts and links do, gives its importance by entropy; branches of low importance
are a site's template and go.  Elements that declare themselves (article, nav, footer,
comment lists ...) need no statistics: declared content is kept and declared furniture
goes, so that a host of one page is served as well.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slim_batches, written
from .url_filter import host_of

GAMMA = 0.9  # part of the content in a node's importance, to the power of its styles
LEAST_IMPORTANCE = 0.5
LEAST_PAGES = 4  # a branch seen on fewer pages is not judged

# Fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSE_P = BLOCKS - frozenset("body caption dd dt html legend li noscript optgroup option tbody td tfoot th thead tr".split()) | frozenset(("dd", "dt", "li"))
CLOSES = {  # start tag: (elements that it ends, elements beyond which it doesn't look)
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
REPEATED = frozenset("dd dt li option p td th tr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())

# What pages call their parts.
FURNITURE_TAGS = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noembed noframes noscript object optgroup option script search select style svg template textarea title audio video map".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner billboard nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar rail footer masthead topbar toolbar"
    " comment comments disqus respond replies cookie cookies consent gdpr notice notices alert alerts notification notifications popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " recommendations widget widgets pagination pager legal disclaimer copyright skip hidden".split()
)
UNSEEN_TAGS = frozenset("datalist head iframe noembed noframes noscript script style template textarea title".split())
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article articlebody content entry maincontent post postcontent story".split())

NEUTRAL, CONTENT, FURNITURE = 0, 1, 2
TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<(?P<cut>/?[A-Za-z][^>]*)\Z",
    re.S,
)
ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMED = re.compile(r"(?i)\b(?:class|id|role|hidden|href|style|aria-hidden)\b")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")


class Node:
    """An element.  ``told``: what it declares itself to be; ``role``: what it counts as,
    with regard to what it stands in."""

    __slots__ = ("tag", "label", "parent", "kids", "told", "words", "role", "texts", "links", "id", "held")

    def __init__(self, tag: str, label: str, parent: Node | None, told: int, words: frozenset):
        self.tag, self.label, self.parent, self.told, self.words = tag, label, parent, told, words
        self.kids, self.texts, self.links, self.role, self.id, self.held = [], [], [], NEUTRAL, 0, None
        if parent is not None:
            parent.kids.append(self)


def _attributes(text: str) -> dict[str, str]:
    if not NAMED.search(text):
        return {}
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _declared(tag: str, attrs: dict[str, str]) -> tuple[int, frozenset]:
    """What an element's tag, role, class and id say."""
    words = frozenset(w.lower() for k in ("class", "id") for w in WORDS.findall(attrs.get(k, "")))
    if tag in FURNITURE_TAGS or attrs.get("role", "").lower() in FURNITURE_ROLES:
        return FURNITURE, words
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"(?i)display\s*:\s*none", attrs.get("style", "")):
        return FURNITURE, words
    if tag not in ("html", "body") and words & FURNITURE_WORDS and (words & COMMENT_WORDS or not words & CONTENT_WORDS):
        return FURNITURE, words
    if tag in CONTENT_TAGS or attrs.get("role") == "main":
        return CONTENT, words
    return NEUTRAL, words


@lru_cache(maxsize=4096)
def _known(tag: str, text: str) -> tuple[int, frozenset, str | None]:
    """(what the element declares itself to be, its class and id words, its link)."""
    attrs = _attributes(text)
    return *_declared(tag, attrs), attrs.get("href")


class Page:
    """One parsed page: a tree of block elements with their direct texts.

    ``blocks`` are the texts in page order as (node, text): inline elements belong to the
    block around them, and a block that is interrupted by another one counts as two.
    """

    def __init__(self, source: str):
        self.root = top = Node("#", "#", None, NEUTRAL, frozenset())
        self.nodes: list[Node] = [top]
        self.blocks: list[tuple[Node, str]] = []
        self.text: list[str] = []
        self.where = top  # the innermost open block or furniture element
        self.open: list[tuple[str, Node]] = [("#", top)]  # open elements, inline ones with their block
        at = 0
        while True:
            m = TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            self._text(source[at : m.start()])
            at = m.end()
            name = m["name"] or m["name2"]
            if name is None:
                continue
            tag = name.lower()
            if m["end"] or m["end2"]:
                self._close(tag)
                continue
            attrs = m["attrs"] if m["name"] is not None else m["attrs2"]
            self._open(tag, attrs)
            if tag in RAW:  # its content is no markup; without an end tag it is the rest
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._close(tag)
        self._pop_to(1)
        self._flush()

    def _text(self, text: str) -> None:
        if text:
            self.text.append(text)

    def _flush(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            self.text = []
            if text:
                self.where.texts.append(text)
                self.blocks.append((self.where, text))

    def _pop_to(self, k: int) -> None:
        """Closes the open elements from the ``k``-th on."""
        while len(self.open) > k:
            _, node = self.open.pop()
            if node is not self.open[-1][1]:
                self._flush()
                self.where = self.open[-1][1]
                if node.held is not None:  # the text that inline furniture interrupted
                    self.text, node.held = node.held, None

    def _find(self, tags, stops) -> int:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k][0]
            if tag in tags:
                return k
            if tag in stops:
                return 0
        return 0

    def _open(self, tag: str, text: str) -> None:
        if tag in CLOSE_P and (k := self._find(("p",), ("table", "td", "th", "caption", "button", "object", "template"))):
            self._pop_to(k)
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            while k := self._find(ends, stops):
                self._pop_to(k)
        if tag == "br":
            self.text.append(" ")
            return
        told, words, link = _known(tag, text) if len(text) < 200 else _known.__wrapped__(tag, text)
        if link is not None:
            self.where.links.append(link)
        if tag in VOID:
            if tag in BLOCKS:
                self._flush()
            return
        if tag in ("html", "body") and any(t == tag for t, _ in self.open):
            return
        if tag in BLOCKS or told == FURNITURE:
            held = None
            if tag in BLOCKS:
                self._flush()
            else:
                held, self.text = self.text, []
            label = tag if not words else f"{tag}.{'.'.join(sorted(words))}"
            self.where = Node(tag, label, self.where, told, words)
            self.where.held = held
            self.nodes.append(self.where)
        self.open.append((tag, self.where))

    def _close(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            return
        for k in range(len(self.open) - 1, 0, -1):
            name, node = self.open[k]
            if name == tag:
                self._pop_to(k)
                return
            if tag not in BLOCKS and name in BLOCKS:
                return  # an inline end tag does not end a block
        return

    def judge(self, declared: bool = True) -> None:
        """Sets every node's role; without ``declared`` only what no reader sees has one.  A class that sounds like furniture doesn't count if it
        alone hides all of the page's declared content, as in a wrapper ``with-sidebar``;
        reader comments stay furniture."""
        if not declared:
            for node in self.nodes:
                node.told = FURNITURE if node.tag in UNSEEN_TAGS else NEUTRAL
                node.role = FURNITURE if node.parent is not None and FURNITURE in (node.parent.role, node.told) else NEUTRAL
            return
        held = self._roles(frozenset())
        if not held:
            wrappers = set()
            for node in self.nodes:
                if node.tag in CONTENT_TAGS and node.told == CONTENT:
                    up, chain = node.parent, []
                    while up is not None:
                        if up.told == FURNITURE:
                            chain.append(up)
                        up = up.parent
                    if all(x.tag not in FURNITURE_TAGS and not x.words & COMMENT_WORDS and x.words & FURNITURE_WORDS for x in chain):
                        wrappers.update(map(id, chain))
            if wrappers:
                held = self._roles(frozenset(wrappers))
        if not held:  # no article and no main: classes and ids that sound like content
            for node in self.nodes:
                if node.told == NEUTRAL and node.tag not in ("html", "body") and node.words & CONTENT_WORDS:
                    node.told = CONTENT
            self._roles(frozenset())

    def _roles(self, excused: frozenset) -> bool:
        held = False
        for node in self.nodes:
            up = node.parent
            told = NEUTRAL if id(node) in excused else node.told
            if up is None:
                node.role = NEUTRAL
            elif up.role == FURNITURE or told == FURNITURE:
                node.role = FURNITURE
            elif node.tag == "header" and up.role != CONTENT:
                node.role = FURNITURE  # a page's header; an article's own holds its title
            elif up.role == CONTENT or told == CONTENT:
                node.role = CONTENT
                held = True
            else:
                node.role = NEUTRAL
        return held

    def content(self) -> str | None:
        """The declared content's text; None if the page declares none."""
        if not any(n.role == CONTENT for n in self.nodes):
            return None
        return "\n".join(t for n, t in self.blocks if n.role == CONTENT)

    def name_nodes(self) -> None:
        """Ids for all nodes: equal on two pages where the way from the root is equal."""
        for node in self.nodes:
            style, places = _style(node)
            node.links = [f"href {x}" for x in node.links]
            mine = f"{node.id}/{style}"
            for kid, place in zip(node.kids, places, strict=True):
                kid.id = _hash(f"{mine}/{place}")

    def statistics(self) -> list[tuple[int, int, int]]:
        """(node, kind, value): each outer node's presence (0), style (1), and each of its
        branch's texts and links (2), once a page.  Declared content is left out."""
        out = set()
        for node in self.nodes[1:]:
            if node.role == CONTENT or node.tag in ("html", "head", "script", "style", "title"):
                continue
            out.add((node.id, 0, 0))
            out.add((node.id, 1, _hash(_style(node)[0])))
            for feature in (*node.texts, *node.links):
                value, up = _hash(feature), node
                while up is not None and up.tag not in ("html", "#"):
                    out.add((up.id, 2, value))
                    up = up.parent
        return sorted(out)

    def open_blocks(self) -> list[tuple[str, list[int]]]:
        """(text, ids of its node and those around it) of what is neither declared content
        nor declared furniture."""
        out = []
        for node, text in self.blocks:
            if node.role == NEUTRAL:
                chain, up = [], node
                while up is not None and up.tag not in ("html", "body", "#"):
                    chain.append(up.id)
                    up = up.parent
                out.append((text, chain))
        return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _style(node: Node) -> tuple[str, list[int]]:
    """The sequence of a node's children, and where in it each child stands.  Runs of equal
    paragraphs, list items, rows or cells are one place, however many they are."""
    runs, places, last = [], [], None
    for kid in node.kids:
        if kid.label != last or kid.tag not in REPEATED:
            runs.append(kid.label)
        places.append(len(runs) - 1)
        last = kid.label
    return " ".join(runs), places


PARSED = "page_id {0}, url string, host string, print long, text string, open array<struct<text string, chain array<long>>>, nodes array<struct<node long, kind int, value long>>"
_OPEN = pa.list_(pa.struct([("text", pa.string()), ("chain", pa.list_(pa.int64()))]))
_NODES = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())]))
BATCH_CHARS = 4 << 20


def _parser(declared: bool):
    def parse(batches):
        """(page_id, url, host, html) to PARSED: ``text`` is set where the page itself declares
        its content, ``open`` has the blocks that the site's tree must judge."""
        for batch in batches:
            begin, size, rows = 0, 0, []
            for k in range(len(batch)):
                source = batch.column(3)[k].as_py() or ""
                page = Page(source)
                page.judge(declared)
                page.name_nodes()
                text = page.content()
                rows.append((_hash(source), text, None if text is not None else page.open_blocks(), page.statistics()))
                size += len(source)
                if size >= BATCH_CHARS or k == len(batch) - 1:
                    yield _parsed(batch.slice(begin, k + 1 - begin), rows)
                    begin, size, rows = k + 1, 0, []

    return parse


def _parsed(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    prints, texts, opened, nodes = zip(*rows)
    opened = [None if x is None else [{"text": t, "chain": c} for t, c in x] for x in opened]
    nodes = [[{"node": n, "kind": k, "value": v} for n, k, v in x] for x in nodes]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(prints, pa.int64()), pa.array(texts, pa.string()), pa.array(opened, _OPEN), pa.array(nodes, _NODES)], names=["page_id", "url", "host", "print", "text", "open", "nodes"])


def parsed_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", declared: bool = True) -> DataFrame:
    """One row per page, see PARSED; a narrow step."""
    slim_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    return rows.mapInArrow(_parser(declared), PARSED.format(rows.schema["page_id"].dataType.simpleString()))


def importance(parsed: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, node, pages, styles, importance) of the sites' merged trees.

    With m pages that have a node, l styles, style shares p and texts or links a that
    df(a) of the pages have: presentation is -sum(p log_m p), content the mean of
    1 - log_m df(a) over the branch, and importance their sum, content weighted by
    gamma**l; a node of one page has importance 1.  Identical pages of a host count once.
    All sums are by (host, node, ...) with partial aggregation, so a host with a third of
    all pages is no single task's.
    """
    seen = parsed.select("host", "print", F.explode("nodes").alias("x")).select("host", "print", "x.*")
    once = seen.groupBy("host", "node", "kind", "value", "print").agg(F.lit(1).alias("one"))
    df = once.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("df"))
    m = F.max(F.when(F.col("kind") == 0, F.col("df")))
    # sums from which both entropies follow once m is known
    log_df = F.when(F.col("kind") == 2, F.log("df"))
    styled = F.when(F.col("kind") == 1, F.col("df"))
    sums = df.groupBy("host", "node").agg(
        m.alias("pages"), F.count(styled).alias("styles"), F.sum(styled).alias("styled"), F.sum(styled * F.log("df")).alias("style_log"), F.count(log_df).alias("features"), F.sum(log_df).alias("feature_log")
    )
    log_m = F.log("pages")
    presentation = F.when(F.col("styled") > 0, (F.log("styled") - F.col("style_log") / F.col("styled")) / log_m).otherwise(0.0)
    content = F.when(F.col("features") > 0, 1 - F.col("feature_log") / F.col("features") / log_m).otherwise(0.0)
    weight = F.pow(F.lit(gamma), F.col("styles"))
    whole = (1 - weight) * F.least(F.lit(1.0), presentation) + weight * content
    return sums.select("host", "node", "pages", "styles", F.when(F.col("pages") > 1, whole).otherwise(1.0).alias("importance"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES, declared: bool = True) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_cut.

    ``text`` is the page's declared content (article, main, or elements called so) without
    the furniture inside it.  On pages that declare none, blocks outside declared furniture
    are kept unless they stand in a branch of the host's style tree with importance below
    ``least`` on ``least_pages`` pages or more; ``n_cut`` counts blocks that went that way.
    Without ``declared`` no tag, class or id counts and the tree alone decides on all that
    a reader sees.
    Blocks are joined by one newline, white space inside a block (and br) is one space,
    character references are decoded; nothing is cut short.  Null and empty html give an
    empty text; null urls and urls without ``://`` share the empty host; repeated rows give
    equal rows; null ids are passed on; pages of any length are read whole; further columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    parsed = written(parsed_pages(pages, page_id, url, html, declared).withColumn("row", F.monotonically_increasing_id()), "html-parsed")
    settled = parsed.where("text is not null").select("page_id", "url", "text", F.lit(0).alias("n_cut"))
    unsettled = parsed.where("text is null").select("row", "page_id", "url", "host", "open")
    low = importance(parsed).where((F.col("importance") < least) & (F.col("pages") >= least_pages)).select("host", "node")
    asked = unsettled.select("row", "host", F.posexplode("open").alias("at", "b")).select("row", "host", "at", F.explode("b.chain").alias("node"))
    cut = asked.join(low, ["host", "node"], "left_semi").select("row", "at").distinct().groupBy("row").agg(F.collect_set("at").alias("cut"))
    judged = unsettled.join(cut, "row", "left").withColumn("cut", F.coalesce("cut", F.array().cast("array<int>")))
    kept = F.filter("open", lambda b, k: ~F.array_contains(F.col("cut"), k))
    judged = judged.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"), F.size("cut").alias("n_cut"))
    both = settled.unionByName(judged)
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_cut")


def op6_site_style(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
