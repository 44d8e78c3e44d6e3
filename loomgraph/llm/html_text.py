"""Main text of web pages: site template removal over hashed element subtrees.

Pass 1 parses every page and hashes the subtree of each element (tag, names, text of all it holds): block elements,
form controls, and inline elements that carry a class, id or role. Spark counts, per host, the different pages that hold
each subtree. What recurs decides:

* A container on ``MIN_PAGES`` pages or more and on ``SHARE`` of the host's pages is the site's template, inside articles one on
  ``INNER_SHARE`` of them.
* A place (path of tags and names) outside articles is template if ``PLACE_SHARE`` of the subtrees seen there are: the menu
  of a page goes then even if its entries are its own.
* A paragraph, heading, item, cell or inline element may be a passage that articles share, so it is template only if it is on
  ``2 * MIN_PAGES`` pages and on ``LEAF_SHARE`` of the host's pages.

Pages with the same text count once, so copies of a page don't turn its article into a template. Pass 2 asks for a page's
own subtrees and places only: in a set of all template marks while they are few, else in what a join of page and template
marks leaves for the page. It deletes what is template, and then, as most hosts of a crawl have too few pages for
recurrence to tell, what marks itself by tag, role, class or id as menu, header, footer, sidebar, notice, advert, form,
comments and the like. Names are bound:

* One class, id or role is one name, and its last part that isn't a general one decides (``main-nav``, ``ad-slot-2``, not ``has-sidebar``,
  ``header-fixed``, ``related-work``).
* What holds the page's article stays: a main element, the articles where no article lies free of such names and no more text does,
  and without such elements what holds most of the text, unless it says comments or the like or is mostly links.
* Inside the article only adverts go whatever they are; other inline elements, headings, paragraphs, items and cells stay, and what is
  called menu, share, related and the like goes if half its text is links.

Of what is left the text in article elements counts if there is any, else that in main elements, else all.
``cues=False`` leaves all names aside: recurrence alone decides. A page without article and main elements that consists of
template only is judged by names alone, since a page isn't all template.

Character references are decoded, white space in a block becomes one space, blocks are joined by a line feed.
A line break element is white space. A null or empty page has the empty text; a null url has the empty host.
Rows are kept one for one, repeated rows and null ids included. Columns named like ``text`` (in any case) are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import _sizes, _steps
from .common import but, col, cut, packed, spread, table, unpacked
from .url_filter import host_and_path

MIN_PAGES, SHARE, INNER_SHARE, PLACE_SHARE, LEAF_SHARE = 4, 0.02, 0.25, 0.5, 0.5
#: Template marks of all hosts that go to every worker; more are joined to the pages' own by a shuffle.
MOST_MARKS = 1 << 19
#: Fixed values of HTML: elements that end a paragraph when they begin, that are blocks, whose text is raw, that have no end.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math canvas object audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTROLS = frozenset("button label output meter progress datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that begins ends an open one of these kinds, unless one of the others lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
#: Elements, and words in class, id or role, that say a part isn't the article.
DROP_TAGS = frozenset("head nav header footer aside form menu dialog search select option optgroup fieldset legend".split()) | CONTROLS
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup comment comments commentlist respond disqus reply replies share sharing social related recommended recommendations footer header masthead topbar popup modal overlay widget widgets toolbar pagination pager copyright login search searchbox form complementary contentinfo".split()
)
HEADER_WORDS = frozenset({"header", "masthead"})
ASIDE_ARTICLES = frozenset("comment comments ad advert related sponsored promo".split())
#: Names of adverts; names that may also be an article's own; tags that may wrap a whole page; parts of names that say nothing
#: about what is named, and those that say that it isn't.
ADS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored".split())
SOFT = frozenset("menu menus notice notices alert share sharing social related recommended recommendations copyright search form login header masthead banner subscribe subscription signup widget widgets overlay modal toolbar promo promotion reply replies".split())
LINKED = SOFT - {"notice", "notices", "alert", "banner", "overlay", "modal", "promo", "promotion"}
WRAPPERS = frozenset("form header fieldset".split())
GENERAL = frozenset("area bar bottom box block btn button buttons container content item items inner left link links list main outer panel primary region right row secondary section site slot top unit wrap wrapper zone".split())
NOT_NAMES = frozenset("has no not with without is hide hides show shows js".split())
#: Elements whose text articles may share with each other.
LEAVES = HEADINGS | frozenset("p li dt dd td th tr tbody blockquote pre caption figcaption".split())
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NAMED = re.compile("class|id|role", re.I)


def names_of(attributes: str) -> str:
    """The values of class, id and role, lower-cased; other attributes, such as data-id, don't count."""
    if not _NAMED.search(attributes):
        return ""
    return " ".join(v for name, a, b, c in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role") and (v := a or b or c)).lower()


def said_by(names: str) -> set[str]:
    """The words of ``DROP_WORDS`` that names (separated by spaces) stand for."""
    out = set()
    for name in names.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if len(parts) > 1 and parts[0] in NOT_NAMES:
            continue
        while len(parts) > 1 and (parts[-1] in GENERAL or parts[-1].isdigit()):
            parts.pop()
        if parts and parts[-1] in DROP_WORDS:
            out.add(parts[-1])
    return out


class Node:
    __slots__ = ("tag", "drop", "said", "kids", "names", "digest", "filled", "wordy", "size", "linked", "place", "inline")

    def __init__(self, tag: str, names: str = "", place: str = "", inline: bool = False) -> None:
        self.tag, self.names, self.place, self.inline, self.kids, self.digest, self.filled = tag, names, place, inline, [], 0, False
        #: whether the text has a letter or a digit, its characters, and how many of these are links
        self.wordy, self.size, self.linked = False, 0, 0
        said = said_by(names) if names else set()
        self.said = said if tag not in ("html", "body", "article", "main") else said & ASIDE_ARTICLES if tag == "article" else set()
        #: 0: may be the article; 1: isn't; 2: is a header, which may hold the article's heading
        self.drop = 0 if tag not in DROP_TAGS and not self.said else 2 if tag == "header" or tag not in DROP_TAGS and self.said <= HEADER_WORDS else 1

    def close(self) -> None:
        """Hash the subtree from its children's hashes, and add up its text."""
        parts = [self.tag, self.names]
        for k in self.kids:
            if isinstance(k, str):
                if own := " ".join(k.split()):
                    parts.append("_" + own)
                    self.filled = True
                    self.size += len(own)
                    self.wordy = self.wordy or any(map(str.isalnum, own))
            else:
                parts.append(f"#{k.digest:x}")
                self.filled |= k.filled
                self.wordy |= k.wordy
                self.size += k.size
                self.linked += k.linked
        self.digest = _digest("\x00".join(parts))

    def firm(self) -> bool:
        """Whether it can't be the article, however much it holds."""
        return self.tag in DROP_TAGS and self.tag not in WRAPPERS or not self.said <= SOFT

    def goes(self, inside: bool) -> bool:
        """Whether its tag or names say that it isn't part of the article. inside: it lies in the article."""
        if not self.drop or inside and self.drop == 2 and self.heading():
            return False
        if not inside or self.tag in DROP_TAGS or self.said & ADS:
            return True
        if self.inline or self.tag in LEAVES:
            return False
        return not self.said <= LINKED or 2 * self.linked >= self.size

    def heading(self) -> bool:
        """Whether it is or holds a heading."""
        todo = [self]
        while todo:
            node = todo.pop()
            if node.tag in HEADINGS:
                return True
            todo.extend(k for k in node.kids if not isinstance(k, str))
        return False


def _digest(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


class _Template:
    """The template marks of one host, in a set of several hosts' marks (mark xor the host's hash)."""

    __slots__ = ("host", "marks")

    def __init__(self, host: str, marks: frozenset[int]) -> None:
        self.host, self.marks = _digest(host), marks

    def __contains__(self, digest: int) -> bool:
        return digest ^ self.host in self.marks


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of elements that can go, and all of them as they end. Plain inline elements only pass their text on."""
    root = Node("#root")
    stack, ended, at, end, link = [root], [], 0, page.rfind(">") + 1, False

    def shut(to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            node.close()
            ended.append(node)

    def text(raw: str) -> None:
        if raw:
            own = entities.unescape(raw) if "&" in raw else raw
            stack[-1].kids.append(own)
            if link:
                stack[-1].linked += len(" ".join(own.split()))

    def block() -> int:
        """The place in the stack of the innermost block."""
        i = len(stack) - 1
        while stack[i].inline:
            i -= 1
        return i

    def open_(tag: str, names: str, inline: bool) -> None:
        above = stack[-1]
        inside = above.place is None or tag in ("article", "main")
        node = Node(tag, names, None if inside else f"{above.place}/{tag}.{names}", inline)
        above.kids.append(node)
        stack.append(node)

    while m := _TOKEN.search(page, at, end):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "a":
            link = not m[1]
        if m[1]:
            low = 0 if tag in BLOCKS else block()
            for i in range(len(stack) - 1, low, -1):
                if stack[i].tag == tag:
                    shut(i)
                    break
            continue
        if tag == "br":
            stack[-1].kids.append("\n")
        elif tag in RAW:
            if not m[3].endswith("/") or tag in ("script", "style", "title", "textarea"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
        elif tag in BLOCKS:
            kinds, walls = ENDS.get(tag, ((), ()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in kinds:
                    shut(i)
                    break
                if stack[i].tag in walls:
                    break
            if stack[i := block()].tag == "p":
                shut(i)
            if tag in VOID:
                stack[-1].kids.append(Node(tag))
            else:
                open_(tag, names_of(m[3]) if m[3] else "", False)
        elif tag not in VOID:
            names = names_of(m[3]) if m[3] else ""
            # a plain element is only opened inside one of its kind, so that its end doesn't end that
            if names or tag in CONTROLS or stack[-1].inline and any(x.tag == tag for x in stack[block() + 1 :]):
                open_(tag, names, True)
    text(page[max(at, 0) :])
    shut(0)
    return root, ended


def main_text(page: str | None, template: set[int] | _Template, cues: bool = True) -> str:
    if not page:
        return ""
    tree, ended = parse(page)
    text, cleared = _left(tree, template, cues)
    if cleared and not text and not any(n.tag in ("article", "main") for n in ended):
        text, _ = _left(tree, frozenset(), cues)
    return text


def _kept(tree: Node) -> tuple[set[int], bool]:
    """Ids of nodes that no name deletes, as they hold the article; whether the page has an article element with text."""
    free, bound, path = [], [], []  # article and main elements, and those under something that isn't the article, with their paths
    outside = 0  # text free of names
    todo: list = [(tree, False, False)]
    while todo:
        node, under, after = todo.pop()
        if after:
            path.pop()
            continue
        path.append(node)
        todo.append((node, under, True))
        under = under or node.goes(False)
        if node.tag in ("article", "main") and node.wordy and not node.said:
            (bound if under else free).append((node, list(path)))
        for k in node.kids:
            if not isinstance(k, str):
                todo.append((k, under, False))
            elif not under:
                outside += len(" ".join(k.split()))
    articles = any(n.tag == "article" for n, _ in (free or bound))
    if free:
        return set(), articles
    if bound:
        most = max(n.size for n, _ in bound)
        held = [way for n, way in bound if n.tag == "main" or 2 * n.size >= most]
        return ({id(x) for way in held for x in way} if most >= outside or any(n.tag == "main" for n, _ in bound) else set()), articles
    keep, node = set(), tree
    while node is not None:  # down to where most of the text is
        if not node.firm() and 2 * node.linked < node.size:
            keep.add(id(node))
        node = next((k for k in node.kids if not isinstance(k, str) and 2 * k.size > tree.size), None)
    return keep, False


def _left(tree: Node, template: set[int] | _Template | frozenset[int], cues: bool) -> tuple[str, bool]:
    """The text of what isn't template and, with cues, doesn't say that it isn't the article; whether any was template."""
    blocks: tuple[list[str], ...] = ([], [], [])  # elsewhere, in a main element, in an article
    order: list[tuple[int, str]] = []
    line: list[str] = []
    cleared = False
    keep, articles = _kept(tree) if cues else (set(), False)

    def flush(scope: int) -> None:
        if own := " ".join("".join(line).split()):
            blocks[scope].append(own)
            order.append((scope, own))
        line.clear()

    todo: list = [(tree, 0, False)]
    while todo:
        node, scope, after = todo.pop()
        if after:
            flush(scope)
        elif isinstance(node, str):
            line.append(node)
        else:
            if node.tag not in ("#root", "html", "body", "article", "main") and (node.digest in template or node.place and _place(node.place) in template):
                cleared = True
            elif not (cues and id(node) not in keep and node.goes(scope == 2 or scope == 1 and not articles)):
                inner = scope if not cues else 2 if node.tag == "article" else max(scope, 1) if node.tag == "main" else scope
                if not node.inline:
                    flush(scope)
                    todo.append((node, inner, True))
                todo.extend((k, inner, False) for k in reversed(node.kids))
                continue
            if not node.inline:
                flush(scope)
    wordy = [any(any(map(str.isalnum, own)) for own in b) for b in blocks]
    least = 2 if wordy[2] else 1 if wordy[1] else 0
    return "\n".join(own for scope, own in order if scope >= least), cleared


def _place(path: str) -> int:
    return _digest("place\x00" + path)


#: Kinds of marks: a page of the host, a container, an element that articles may share.
PAGE, CONTAINER, LEAF = 0, 1, 2


def subtrees(page: str | None) -> tuple[int, dict[int, tuple[int, int]]]:
    """A fingerprint of the page's text, and its subtrees with text: hash to (kind, place; 0 inside articles)."""
    if not page:
        return 0, {}
    root, ended = parse(page)
    marks = {n.digest: (LEAF if n.tag in LEAVES or n.inline else CONTAINER, _place(n.place) if n.place and n.tag not in LEAVES and not n.inline else 0) for n in ended if n.filled and n.tag not in ("#root", "html", "head", "body", "article", "main")}
    return root.digest, marks


_MARKED = "page bigint, host bigint, mark bigint, kind int, place bigint"


def marked(pages: DataFrame, key: str | None = None) -> DataFrame:
    """(page, host, mark, kind, place) of rows (host, html), a row for each subtree with text and one for the page itself;
    page is the text's fingerprint or the column ``key``, host a hash, marks and places are xor-ed with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, _sizes("html")):
            out: tuple[list, ...] = ([], [], [], [], [])
            names = batch.column(key).to_pylist() if key else [None] * batch.num_rows
            for h, text, name in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), names, strict=True):
                own, marks = subtrees(text)
                host = _digest(h)
                for mark, kind, place in ((host, PAGE, 0), *((m ^ host, k, p ^ host if p else 0) for m, (k, p) in marks.items())):
                    for column, value in zip(out, (name if key else own, host, mark, kind, place), strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["page", "host", "mark", "kind", "place"])

    return pages.select("host", "html", *([key] if key else [])).mapInArrow(run, _MARKED)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, place_share: float = PLACE_SHARE, leaf_share: float = LEAF_SHARE, share: float = SHARE, inner_share: float = INNER_SHARE) -> DataFrame:
    """(mark) of rows (host, html): the hosts' template subtrees and places; written."""
    counted = cut(marked(pages).distinct().groupBy("host", "mark", "kind", "place").agg(F.count("*").alias("n")).where((F.col("n") >= min_pages) | (F.col("kind") == PAGE) | (F.col("place") != 0)))
    many = F.col("n") >= min_pages
    pages_ = counted.where(F.col("kind") == PAGE).select("host", F.col("n").alias("pages"))
    least = F.when(F.col("kind") == LEAF, F.lit(leaf_share)).when(F.col("place") == 0, F.lit(inner_share)).otherwise(F.lit(share))
    often = counted.where((F.col("kind") == CONTAINER) & many | (F.col("kind") == LEAF) & (F.col("n") >= 2 * min_pages))
    held = often.join(pages_, "host").where(F.col("n") >= least * F.col("pages")).select("mark")
    places = counted.where(F.col("place") != 0).groupBy("place").agg(F.sum("n").alias("seen"), F.sum(F.when(many, F.col("n")).otherwise(0)).alias("again"))
    places = places.where((F.col("again") >= 2 * min_pages) & (F.col("again") >= place_share * F.col("seen"))).select(F.col("place").alias("mark"))
    return cut(held.unionByName(places).distinct())


def extract(pages: DataFrame, html: str = "html", url: str = "url", text: str = "text", cues: bool = True, min_pages: int = MIN_PAGES, place_share: float = PLACE_SHARE, leaf_share: float = LEAF_SHARE) -> DataFrame:
    """``pages`` without its html, with ``text``."""
    kept = but(pages, html, text)
    plain = spread(pages.select(F.coalesce(host_and_path(col(url))[0], F.lit("")).alias("host"), col(html).alias("html"), packed(pages, kept).alias("kept")))
    known = templates(plain.select("host", "html"), min_pages, place_share, leaf_share)
    few = known.count() <= MOST_MARKS
    if few:
        every = pages.sparkSession.sparkContext.broadcast(known.toArrow()["mark"].to_numpy())
        rows = plain
    else:
        key = F.xxhash64("host", "html")
        own = marked(plain.select("host", "html", key.alias("key")), "key")
        own = own.select("page", "mark").unionByName(own.where("place <> 0").select("page", F.col("place").alias("mark"))).distinct()
        own = own.join(known, "mark", "left_semi").groupBy(F.col("page").alias("key")).agg(F.collect_list("mark").alias("marks"))
        rows = plain.withColumn("key", key).join(own, "key", "left").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_marks = frozenset(every.value.tolist()) if few else None
        for batch in _steps(batches, _sizes("html")):
            marks = [all_marks] * batch.num_rows if few else [frozenset(m or ()) for m in batch.column("marks").to_pylist()]
            found = [main_text(page, _Template(h, m), cues) for h, page, m in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), marks, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(found, pa.string())], names=["kept", "found"])

    schema = T.StructType([plain.schema["kept"], T.StructField("found", T.StringType())])
    return rows.mapInArrow(run, schema).select(*unpacked("kept", kept), F.col("found").alias(text))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
