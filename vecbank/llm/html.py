"""HTML extraction by site template removal.

Pass 1 parses each page and hashes the subtrees of its containers (``nav``, ``div``, ``footer``, ...). Spark counts the
different texts of each host beside which a subtree occurs; subtrees with a share of all of them are templates, while
what comes along with copies of one text is not, nor anything inside an article or with most of a page's text. Pass 2
parses the page again, deletes its templates first and then whatever markup says is no article (menus, forms, scripts, adverts,
comments of readers), and joins the text blocks of the rest. Counting aggregates before the shuffle, so a host with a
third of all pages does not meet in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecbank.llm.batches import columns, pieces, record, text_bytes
from vecbank.session import materialize

#: A subtree is a template of its host if it occurs beside so many different texts and beside this share of them.
TEMPLATE_PAGES = 3
TEMPLATE_SHARE = 0.25

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
DROPPED = frozenset(
    "script style textarea title noscript template iframe noframes head nav footer aside form button select option menu dialog svg canvas object audio video map".split()
)
CONTAINERS = frozenset("nav div footer header aside section form ul ol dl table menu dialog article main figure".split())
BLOCKS = CONTAINERS | frozenset(
    "html body p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd tr caption thead tbody tfoot address details summary fieldset figcaption hr center hgroup legend".split()
)
CELLS = frozenset(("td", "th", "br"))
MAIN = frozenset(("article", "main"))
#: An open element of the first kind ends when one of the second begins.
ENDS_AT = {
    "p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"},
}
LISTS = frozenset(("ul", "ol", "dl", "table", "menu"))
#: Words in class or role of elements outside articles that hold no article text.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|"
    r"sidebar|side-bar|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|pagination|pager|toolbar|share|sharing|social|related|recommended|"
    r"comments?|comment-list|disqus|respond|replies|search|login|signup|skip|hidden|contentinfo|complementary|dialog|alert)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Articles are not the page's own beneath or with a name of such words, besides words that boxes are made of
#: (``comment-list``, but not ``category-sidebar``).
ASIDE_WORD = re.compile(r"ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|sidebar|nav|navigation|menu|footer|related|recommended|teasers?|comments?|disqus|respond|repl(?:y|ies)")
BOX_WORD = re.compile(r"\d*|list|area|box|section|wrap|wrapper|container|body|block|widget|posts?|articles?|items?|links?|buttons?|bar|thread|form|slot|unit")
#: The same for what is dropped within an article (``comments-area``, but not ``social-history``).
NOISE_WORD = re.compile(
    r"ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|sidebar|"
    r"nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|pagination|pager|toolbar|share|sharing|social|related|recommended|comments?|disqus|respond|"
    r"replies|search|login|signup|skip|hidden|contentinfo|complementary|dialog|alert"
)
#: Names that never stand around most of a page's own text; others (``has-sidebar``) may, and then do not make it noise.
NEVER_OWN = re.compile(r"comments?|disqus|respond|repl(?:y|ies)|cookies?|consent|gdpr|popup|modal|newsletter|subscribe", re.IGNORECASE)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption blockquote pre".split())
ASIDE = DROPPED - {"form"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SPACE = re.compile(r"\s+")


class Node:
    """An element: tag, attributes as text, and children (strings and nodes) in page order."""

    __slots__ = ("tag", "attributes", "children", "digest")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.digest = tag, attributes, [], 0


def parse(html: str) -> Node:
    """A forgiving tree: what is left open ends with its parent, stray end tags are ignored, cut-off pages end there."""
    root = Node("#root")
    stack = [root]
    at, size = 0, len(html)
    while at < size:
        found = TOKEN.search(html, at)
        if not found:
            stack[-1].children.append(html[at:])
            break
        if found.start() > at:
            stack[-1].children.append(html[at : found.start()])
        at = found.end()
        ending, tag, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)  # the latter: an open quote
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                # An inline end tag does not close the block around it, nor does anything close an article but itself.
                if stack[depth].tag in CONTAINERS and tag not in BLOCKS:
                    break
            continue
        for depth in range(len(stack) - 1, 0, -1):
            if tag in ENDS_AT.get(stack[depth].tag, ()):
                del stack[depth:]
                break
            if stack[depth].tag in CONTAINERS or stack[depth].tag in ("body", "blockquote"):
                break
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS | RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.IGNORECASE).search(html, at)
            node.children.append(html[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        stack.append(node)
    return root


def walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every node twice, before and after its children, without recursion: (node, whether it is left)."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        yield node, leaving
        if not leaving:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children) if isinstance(c, Node))


def hash_subtrees(root: Node) -> None:
    """Give each element a 64-bit digest of its tag, attributes, text (white space folded) and children."""
    for node, leaving in walk(root):
        if not leaving:
            continue
        own = hashlib.blake2b(f"{node.tag}\0{SPACE.sub(' ', node.attributes).strip()}".encode("utf-8", "replace"), digest_size=8)
        for child in node.children:
            if isinstance(child, Node):
                own.update(b"\1" + child.digest.to_bytes(8, "little", signed=True))
            elif text := SPACE.sub(" ", child).strip():
                own.update(b"\2" + text.encode("utf-8", "replace"))
        node.digest = int.from_bytes(own.digest(), "little", signed=True)


def is_main(node: Node) -> bool:
    """A main element, or one that says it has that role."""
    return node.tag == "main" or bool(node.attributes) and "main" in attribute(node, "role").lower().split()


def attribute(node: Node, wanted: str) -> str:
    return next((unescape(v.strip("\"'")) for n, v in ATTRIBUTE.findall(node.attributes) if n.lower() == wanted), "")


def text_sizes(root: Node) -> dict[int, int]:
    """Characters of text in each element, by its id; scripts, styles and the like have none."""
    size: dict[int, int] = {}
    for node, leaving in walk(root):
        if leaving:
            own = 0 if node.tag in RAW else sum(len(SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str))
            size[id(node)] = own + sum(size[id(c)] for c in node.children if isinstance(c, Node))
    return size


def holds_the_page(node: Node, sizes: dict[int, int], total: int) -> bool:
    """Whether an element that its name or a form tag makes noise holds most of the page's text, so that it is only a frame."""
    if 2 * sizes[id(node)] <= total or node.tag in DROPPED - {"form"}:
        return False
    return not any(NEVER_OWN.search(attribute(node, n)) for n in ("class", "role", "id"))


def named(token: str, kind: re.Pattern) -> bool:
    """Whether a whole name consists of words of a kind, besides words of boxes."""
    words = re.split(r"[-_]+", token.lower())
    return any(kind.fullmatch(w) for w in words) and all(kind.fullmatch(w) or BOX_WORD.fullmatch(w) for w in words)


def is_aside(node: Node) -> bool:
    """Whether an element around or of an article says that it is not the page's own: by its tag or a whole name."""
    if node.tag in ASIDE:
        return True
    if not node.attributes or node.tag in ("html", "body") or is_main(node):
        return False
    names = {name.lower(): unescape(value.strip("\"'")) for name, value in ATTRIBUTE.findall(node.attributes)}
    tokens = [t for name in ("class", "role") for t in names.get(name, "").split()] + [names.get("id", "")] * (node.tag != "article")
    return any(named(t, ASIDE_WORD) for t in tokens)


def main_parts(root: Node) -> tuple[list[Node], list[Node]]:
    """The elements whose text counts (none: all of the page), and the articles among or in them, where nothing is a template.

    Articles that are asides or lie in one (comments, related) do not count, nor do articles within others. Where a main
    element holds text of its own beside its articles, it counts as a whole.
    """
    order: list[tuple[Node, Node | None]] = []  # mains and articles with the main around them
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        node, main = stack.pop()
        if node is not root and is_aside(node):
            continue
        opens = node.tag != "article" and main is None and is_main(node)
        if node.tag == "article" or opens:
            order.append((node, main))
        if node.tag != "article":
            inner = node if opens else main
            stack.extend((c, inner) for c in reversed(node.children) if isinstance(c, Node))
    articles = [n for n, _ in order if n.tag == "article"]
    if not articles:
        mains = [n for n, _ in order]
        return mains, mains
    whole = {id(n) for n, _ in order if n.tag != "article" and own_text(n)}
    return [n for n, main in order if (id(main) not in whole if n.tag == "article" else id(n) in whole)], articles


def own_text(main: Node) -> bool:
    """Whether a main element has text outside its articles and of what is noise."""
    stack = [main]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, str):
                if unescape(child).strip():
                    return True
            elif child.tag != "article" and not is_noise(child, True):
                stack.append(child)
    return False


def inside(nodes: Iterable[Node]) -> set[int]:
    """Ids of the elements of some subtrees."""
    return {id(n) for top in nodes for n, leaving in walk(top) if leaving}


def candidates(root: Node) -> set[int]:
    """Digests of the containers that may be templates: those with text that neither hold an article nor lie in one, nor hold
    most of the page's text; never paragraphs or headings themselves. Menus and footers count as well as boxes without a name."""
    tops, articles = main_parts(root)
    above = inside(articles) | {id(t) for t in tops}
    sizes = text_sizes(root)
    found: dict[int, int] = {}
    for node, leaving in walk(root):
        if not leaving:
            continue
        if node.tag in ("html", "body", "#root") or any(isinstance(c, Node) and id(c) in above for c in node.children):
            above.add(id(node))
        elif node.tag in CONTAINERS and id(node) not in above and node.children:
            found[node.digest] = sizes[id(node)]
    return {digest for digest, n in found.items() if 0 < 2 * n <= sizes[id(root)]}


def text_digest(root: Node) -> int:
    """Digest of the page's text by markup alone, so copies under several urls count once."""
    return int.from_bytes(hashlib.blake2b(extract(root).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def is_noise(node: Node, in_main: bool) -> bool:
    """Whether markup alone says that an element is no part of an article.

    Ids are often made from headings: within an article they say nothing, nor do names of headings, paragraphs and other
    text elements, and the names of containers count as whole names. Elsewhere an id counts as a whole name.
    """
    if node.tag in DROPPED or node.tag == "header" and not in_main:
        return True
    if node.tag == "article" and is_aside(node):
        return True
    if not node.attributes or node.tag in MAIN or node.tag in ("html", "body") or is_main(node):
        return False
    for name, value in ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "role"):
            if not in_main and NOISE.search(value):
                return True
            if in_main and node.tag in CONTAINERS and any(named(t, NOISE_WORD) for t in value.split()):
                return True
        if name == "id" and not in_main and node.tag not in TEXTUAL and named(value, NOISE_WORD):
            return True
        if name == "style" and HIDDEN.search(value):
            return True
    return False


def extract(root: Node, templates: set[int] | frozenset[int] = frozenset()) -> str:
    """Text blocks of what is left, joined by blank lines. With an article (or main) element of the page's own only its text counts."""
    tops, articles = main_parts(root)
    protected = inside(articles) if templates else set()
    sizes = {} if tops else text_sizes(root)
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        if text := SPACE.sub(" ", unescape("".join(held))).strip():
            blocks.append(text)
        held.clear()

    def drops(node: Node, top: Node, in_main: bool) -> bool:
        if node is top and in_main or not is_noise(node, in_main):
            return False
        return in_main or not holds_the_page(node, sizes, sizes[id(root)])

    def read(top: Node, in_main: bool) -> None:
        stack: list = [iter((top,))]
        opened: list[Node | None] = [None]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                node = opened.pop()
                if node is not None and node.tag in BLOCKS:
                    close()
                elif node is not None and node.tag in CELLS:
                    held.append(" ")
                continue
            if isinstance(child, str):
                held.append(child)
                continue
            if child.digest in templates and child is not top and id(child) not in protected or drops(child, top, in_main):
                if child.tag in BLOCKS:
                    close()
                continue
            if child.tag in BLOCKS:
                close()
            elif child.tag in CELLS:
                held.append(" ")
            stack.append(iter(child.children))
            opened.append(child)
        close()

    if tops:
        for node in tops:
            read(node, True)
    else:
        read(root, False)
    return "\n\n".join(blocks)


def host_hash(url: Column) -> Column:
    """64-bit hash of the host in lower case, without user and port; a missing url counts as a host of its own."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.xxhash64(host)


def template_hashes(pages: DataFrame, least: int = TEMPLATE_PAGES, share: float = TEMPLATE_SHARE) -> DataFrame:
    """``page_id, templates``: digests of subtrees of the page that occur beside at least ``least`` different texts of its
    host, and beside ``share`` of them. Pages without a template have no row.
    """
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.int64()), ("main", pa.int64()), ("digest", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            out: dict[str, list] = {name: [] for name in schema.names}
            for page_id, host, html in zip(*columns(batch, "page_id", "host", "html"), strict=True):
                hash_subtrees(root := parse(html.decode("utf-8", "replace")))
                found = [None, *candidates(root)]  # the row without digest counts the texts of the host
                out["page_id"] += [page_id] * len(found)
                out["main"] += [text_digest(root)] * len(found)
                out["host"] += [host] * len(found)
                out["digest"] += found
            yield record(schema, out)

    subtrees = pages.select("page_id", host_hash(F.col("url")).alias("host"), text_bytes("html")).mapInArrow(run, "page_id long, host long, main long, digest long")
    subtrees = materialize(subtrees, "html_subtrees")  # read twice, parsed once
    counts = subtrees.groupBy("host", "digest").agg(F.count_distinct("main").alias("n"))
    counts = materialize(counts.filter(F.isnull("digest") | (F.col("n") >= least)), "html_counts")
    texts = counts.filter(F.isnull("digest")).select("host", F.col("n").alias("texts"))
    often = counts.filter(F.isnotnull("digest")).join(texts, "host").filter(F.col("n") >= share * F.col("texts")).select("host", "digest")
    return subtrees.drop("main").join(often, ["host", "digest"]).groupBy("page_id").agg(F.collect_set("digest").alias("templates"))


def extract_pages(pages: DataFrame, least: int = TEMPLATE_PAGES) -> DataFrame:
    """One row per row of ``pages`` (``page_id, url, html``): ``page_id, url, text, n_chars``.

    A null or empty page gives the empty text. Pages are read whole, also when they are cut off. Rows that repeat a
    page_id share their templates; a null page_id has none of its own to look up and relies on markup alone. Further
    columns of ``pages`` are not looked at. An empty table gives an empty result.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            ids, urls, htmls, templates = columns(batch, "page_id", "url", "html", "templates")
            texts = []
            for html, own in zip(htmls, templates, strict=True):
                root = parse(html.decode("utf-8", "replace"))
                if own:
                    hash_subtrees(root)
                texts.append(extract(root, frozenset(own or ())).encode("utf-8", "replace").decode())
            yield record(schema, {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select("page_id", "url", text_bytes("html")).join(template_hashes(pages, least), "page_id", "left")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
