"""Main text of web pages: structure rules, then removal of each site's template.

A page is parsed into a tree (a small tolerant parser: void and raw-text elements, implied ends of
paragraphs, list items and table parts, unclosed and stray tags). Elements that never hold article text
go by their tag, role, class or id. The content root is the ``article`` element or elements, else the
main element, else the body. Block elements of the root give blocks of text; character references are
decoded and white space in a block becomes one space.

What structure does not tell is learnt from the site: every element subtree that could be part of a
template is hashed (tags and text), each host's pages are counted for each hash, and subtrees found on
``min_pages`` pages of a host or more, and on more than ``min_share`` of its pages or on more than
``max_pages``, are deleted. Inside an ``article`` only containers can be such subtrees, not single
paragraphs or headings. Pages count under the hash of their whole text, those with a subtree and those
of the host alike, so that copies of a page neither make it a template nor hide one.

Pages of any depth are parsed and walked without recursion, and broken tags cost time in proportion
to the page. A null html gives the empty text; a null or odd url is the host ''; null and repeated page ids are rows
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import Batches, prepared, tidied, written

MIN_PAGES = 3
MIN_SHARE = 0.3
#: A subtree on more distinct pages of its host than this is of a template, whatever share they are.
MAX_PAGES = 1_000
#: Template subtrees that are sent to every task; where there are more, pages are joined with theirs.
SENT_SUBTREES = 200_000
#: Pages that a task works on at a time.
ROWS = 256

_NAME = re.compile(r"/?[a-zA-Z][^\s>/]*+")
_QUOTE = re.compile("[\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

# Element names of HTML by what the extraction does with them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_SKIP = frozenset(
    "head script style noscript template iframe svg math canvas object embed applet audio video map nav header footer aside form button select option textarea input label fieldset dialog menu title noembed noframes".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr caption figcaption".split())
_ENDS_P = _BLOCK - frozenset("body html caption legend summary li dd dt td th tr tbody thead tfoot".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner promo promoted promotion sponsor sponsored sponsors commercial "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer foot bottombar colophon copyright legal "
    "sidebar aside rail widget widgets recommended recommendations "
    "cookie cookies consent gdpr notice notices alert popup modal overlay paywall "
    "newsletter subscribe subscription signup login register form search "
    "share sharing social follow "
    "comment comments commentlist respond replies reply disqus discussion".split()
)
#: Such names are kept apart even though one of the words above is part of them.
_KEEP = frozenset("content main article body post entry story text".split())
#: A header with one of these names is the head of an article; any other is the site's.
_HEADED = frozenset("article entry post story".split())
#: Words that tell furniture only when nothing but these and numbers stands beside them: related-posts, but not related-work.
_LISTED = frozenset("related posts post articles article stories story links items news more box block list grid section container wrapper inner content reading topics videos".split())


class Node:
    __slots__ = ("tag", "kids", "skip", "main")

    def __init__(self, tag: str, skip: bool = False, main: bool = False):
        self.tag, self.kids, self.skip, self.main = tag, [], skip, main


def _names(value: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()))


def _marked(tag: str, attributes: str) -> tuple[bool, bool]:
    """(holds no article text, is a main element) by tag and attributes."""
    skip, main = tag in _SKIP, tag == "main"
    if attributes and tag not in ("body", "html"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                words = _names(value)
                if tag not in ("article", "main") or words & {"comment", "comments", "reply"}:
                    own = words & (_HEADED if "header" in words else _KEEP) and not words & {"comment", "comments", "ad", "ads", "sidebar", "footer", "nav"}
                    if words & _WORDS and not own:
                        skip = True
                    elif "related" in words and all(w in _LISTED or not w or w.isdigit() for w in words):
                        skip = True
            elif name == "role":
                skip, main = skip or value.lower() in _ROLES, main or value.lower() == "main"
            elif name == "itemprop":
                main = main or value == "articleBody"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                skip = True
    return skip, main


class _Open:
    """The stack of open elements, with the places of each tag, so that any question to it takes one step."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, at: int) -> None:
        """Close the elements from a place on."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost open element with one of the tags, 0 without one."""
        return max((x[-1] for t in tags if (x := self.places.get(t))), default=0)


def _ended(stack: _Open, tag: str) -> None:
    """What an end tag does."""
    top = stack.nodes[-1].kids
    if tag == "br":
        top.append("\n")
    elif not (at := stack.last(tag)):
        if tag == "p":
            top.append(Node("p"))
    elif tag in _BLOCK or at >= stack.last("article", "table", "body"):
        stack.close(at)


class _Quotes:
    """Where tags end: at the first ``>`` outside of quotes; where quotes don't close, at the first one anywhere.

    What follows a quote that opens is worked out once for each quote of the page and remembered, so all
    tags of a page, however long and broken, take time in proportion to it.
    """

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def end(self, at: int, plain: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends before ``at``; ``plain`` is the first one from there on."""
        opens = _QUOTE.search(self.page, at, plain)
        found = self._after(opens.start()) if opens else plain
        return plain if found < 0 else found

    def _after(self, at: int) -> int:
        """The first ``>`` outside of quotes after the quote that opens at a place; -1 if there is none."""
        page, known, met = self.page, self.known, []
        while (found := known.get(at)) is None:
            met.append(at)
            close = page.find(page[at], at + 1)
            if close < 0:
                found = -1
                break
            opens = _QUOTE.search(page, close + 1)
            found = page.find(">", close + 1, opens.start() if opens else len(page))
            if found >= 0 or opens is None:
                break
            at = opens.start()
        for x in met:
            known[x] = found
        return found


def _next_tag(page: str, at: int, quotes: _Quotes) -> tuple[int, str, str, int] | None:
    """(start, name with a slash before an end tag's, attributes, end) of the next tag; comments and declarations have no name.

    Every character is looked at a bounded number of times.
    """
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return at, "", "", len(page) if end < 0 else end + 3
        name = _NAME.match(page, at + 1)
        if name or page.startswith(("<!", "<?"), at):
            plain = page.find(">", at)
            if plain < 0:  # no tag ends any more
                return None
            if name is None or name[0][0] == "/":
                return at, name[0].lower() if name else "", "", plain + 1
            end = quotes.end(name.end(), plain)
            return at, name[0].lower(), page[name.end() : end], end + 1
        at += 1
    return None


def parse(page: str) -> Node:
    """The tree of a page; strings among ``kids`` are decoded text."""
    root = Node("html")
    stack, at, size, quotes = _Open(root), 0, len(page), _Quotes(page)
    while (found := _next_tag(page, at, quotes)) is not None:
        start, tag, attributes, end = found
        if start > at:
            stack.nodes[-1].kids.append(entities.unescape(page[at:start]))
        at = end
        if tag[:1] == "/":
            _ended(stack, tag[1:])
            continue
        if tag in ("", "html"):
            continue
        if stack.nodes[-1].tag == "head" and tag != "head" and (tag == "body" or tag in _BLOCK):
            stack.close(len(stack.nodes) - 1)
        if tag in _ENDS_P and stack.blocks and stack.nodes[stack.blocks[-1]].tag == "p":
            stack.close(stack.blocks[-1])
        if tag in _CLOSES and (inner := stack.last(*_CLOSES[tag][0])) > stack.last(*_CLOSES[tag][1]):
            stack.close(inner)
        if tag == "br":
            stack.nodes[-1].kids.append("\n")
            continue
        node = Node(tag, *_marked(tag, attributes))
        stack.nodes[-1].kids.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(page, at)
            stop = close.start() if close else size
            if not node.skip:
                node.kids.append(entities.unescape(page[at:stop]))
            over = page.find(">", stop)
            at = size if over < 0 else over + 1
        elif tag not in _VOID and not attributes.rstrip().endswith("/") or tag in _BLOCK:
            stack.push(node)
    if at < size:
        stack.nodes[-1].kids.append(entities.unescape(page[at:]))
    return root


def _roots(tree: Node, kind: str) -> list[Node]:
    """The outermost article (or main) elements in page order."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if node is not tree and ((node.tag == "article") if kind == "article" else node.main):
            out.append(node)
        else:
            todo += [x for x in reversed(node.kids) if isinstance(x, Node) and not x.skip]
    return out


def _flat(text: str) -> str:
    return " ".join(text.split())


def _digest(root: Node, found: dict[int, int]) -> None:
    """Hashes of a subtree and all its subtrees, without what is skipped, by the nodes' identity."""
    open_ = [(root, iter(root.kids), [root.tag])]
    while open_:
        node, kids, parts = open_[-1]
        for x in kids:
            if isinstance(x, str):
                if flat := _flat(x):
                    parts.append(flat)
            elif not x.skip:
                open_.append((x, iter(x.kids), [x.tag]))
                break
        else:
            open_.pop()
            value = xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))
            found[id(node)] = value - (1 << 64) if value >= 1 << 63 else value
            if open_:
                open_[-1][2].append(str(found[id(node)]))


def _text_blocks(root: Node, gone: frozenset | set, hashes: dict[int, int], out: list[list[str]]) -> None:
    if root.tag in _BLOCK:
        out.append([])
    open_ = [(root, iter(root.kids))]
    while open_:
        node, kids = open_[-1]
        for x in kids:
            if isinstance(x, str):
                out[-1].append(x)
            elif not x.skip and hashes.get(id(x)) not in gone:
                if x.tag in _BLOCK:
                    out.append([])
                open_.append((x, iter(x.kids)))
                break
        else:
            open_.pop()
            if node.tag in _BLOCK:
                out.append([])


def content(page: str) -> list[Node]:
    """The elements that the main text is taken from."""
    tree = parse(page)
    return _roots(tree, "article") or _roots(tree, "main") or [tree]


def blocks(page: str, gone: set[int] | frozenset = frozenset()) -> list[str]:
    """Text of each block in page order, without subtrees whose hash is in ``gone``."""
    out: list[list[str]] = [[]]
    for root in content(page):
        hashes: dict[int, int] = {}
        if gone:
            _digest(root, hashes)
        _text_blocks(root, gone, {k: v for k, v in hashes.items() if k != id(root)} if root.tag in ("article", "html") else hashes, out)
        out.append([])
    return [x for x in (_flat("".join(parts)) for parts in out) if x]


def template_hashes(page: str) -> tuple[list[int], int]:
    """(hashes of the subtrees that may belong to a template, hash of the page's whole text)."""
    found: set[int] = set()
    whole: list[str] = []
    for root in content(page):
        hashes: dict[int, int] = {}
        _digest(root, hashes)
        inside = root.tag == "article"
        todo = [root]
        while todo:
            node = todo.pop()
            for x in node.kids:
                if isinstance(x, str):
                    whole.append(x)
                elif not x.skip:
                    todo.append(x)
                    if x.tag in _BLOCK and not (inside and x.tag in _PARAGRAPH) and x.tag != "body":
                        found.add(hashes[id(x)])
    value = xxhash.xxh64_intdigest(_flat(" ".join(whole)).encode("utf-8", "surrogatepass"))
    return list(found), value - (1 << 64) if value >= 1 << 63 else value


def _marked_subtrees(batches: Batches) -> Batches:
    """(host, mark, key) of each subtree that may be template, and one row a page without a key."""
    for batch in batches:
        hosts, marks, keys = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own, mark = template_hashes(page)
            own.append(None)  # the page itself
            hosts += [host] * len(own)
            marks += [mark] * len(own)
            keys += own
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(marks, pa.int64()), pa.array(keys, pa.int64())], names=["host", "mark", "key"])


def _keyed(batches: Batches) -> Batches:
    for batch in batches:
        keys = [template_hashes(page)[0] for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["row", "host", "keys"])


def _texts(ids: pa.Array, urls: pa.Array, found: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["id", "url", "text", "n_chars"])


def _extracted(batches: Batches) -> Batches:
    for batch in batches:
        yield _texts(batch.column(0), batch.column(1), [" ".join(blocks(page, set(gone or ()))) for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])


def _extracted_with(template: dict[int, frozenset]):
    def run(batches: Batches) -> Batches:
        nothing = frozenset()
        for batch in batches:
            yield _texts(batch.column(0), batch.column(1), [" ".join(blocks(page, template.get(host, nothing))) for page, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])

    return run


def host_of(url):
    """Host of a url in lower case, without port and a leading www; '' if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", ""), F.lit(""))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, max_pages: int = MAX_PAGES) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    prepared(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.xxhash64(host_of(F.col("url"))))
    marks = rows.select("host", "html").mapInArrow(tidied(_marked_subtrees, ROWS), "host bigint, mark bigint, key bigint").distinct()
    seen = written(marks.groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("key").isNull() | (F.col("pages") >= min_pages)), "subtrees")
    sites = seen.where("key IS NULL").select("host", F.col("pages").alias("site_pages"))
    template = seen.where("key IS NOT NULL").join(sites, "host").where((F.col("pages") > F.col("site_pages") * min_share) | (F.col("pages") > max_pages)).select("host", "key")
    out = f"id {kind}, url string, text string, n_chars bigint"
    few = template.limit(SENT_SUBTREES + 1).toArrow()
    if few.num_rows <= SENT_SUBTREES:
        sent: dict[int, set] = {}
        for host, key in zip(few["host"].to_pylist(), few["key"].to_pylist()):
            sent.setdefault(host, set()).add(key)
        found = rows.select("id", "url", "html", "host").mapInArrow(tidied(_extracted_with({k: frozenset(x) for k, x in sent.items()}), ROWS), out)
        return found.withColumnRenamed("id", id_col)
    row = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), "html")
    keyed = written(rows.select(row.alias("row"), "host", "html").mapInArrow(tidied(_keyed, ROWS), "row bigint, host bigint, keys array<bigint>"), "keys")
    held = keyed.select("row", "host", F.explode("keys").alias("key")).join(template, ["host", "key"])
    gone = held.groupBy(F.col("row").alias("gone_row")).agg(F.collect_set("key").alias("gone"))
    joined = rows.withColumn("row", row).join(gone, F.col("row") == F.col("gone_row"), "left").select("id", "url", "html", "gone")
    return joined.mapInArrow(tidied(_extracted, ROWS), out).withColumnRenamed("id", id_col)
