"""Main text of web pages by removal of site templates (operator 2).

A page becomes a tree of elements. Each subtree has a hash of its tags and text; Spark counts the hashes over the distinct
texts of a host's pages, so that copies of a page make nothing a template, and subtrees that recur in a large share of
them are the host's template. On a page without an article they are deleted, so what is left is its own text; of a main element
only containers go so, not lists, tables or paragraphs. Of several articles those that are template are not chosen, and nothing
is deleted inside a chosen one for recurring. Elements
that by name, role or class are no article text (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts,
styles) go on every page. Parsing takes time in proportion to the page, however it is nested or broken.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import cut, in_arrow

# Fixed values of HTML: elements by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these open elements, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
DROPPED = frozenset("head nav aside footer form script style noscript iframe template svg math canvas button select textarea object audio video dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Parts of a class or id that mark what is no article text.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored sponsors promo promotion banner sidebar menu nav navbar navigation breadcrumb"
    " breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share"
    " sharing social related recommended comment comments disqus replies respond pagination pager widget toolbar skip".split()
)
#: Parts that say nothing by themselves: a class of marks and these is a mark ("ad-slot"), one with another word is not ("share-price").
NEUTRAL = frozenset(
    "box bar list block wrapper wrap container section area inner outer content slot unit top bottom left right main page site global primary secondary"
    " links link buttons button btn items item form thread post posts article articles entry text image images icon icons fixed sticky mobile desktop panel"
    " pane col column row group small large header title body js the to my your our and of for by on in"
    " user users reader readers google mpu story stories media latest more".split()
)
#: Elements whose recurring text inside a main element is still its text.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption summary ul ol dl table thead tbody tfoot tr figure".split())
TAG = re.compile(r"""<!--.*?(?P<closed>-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)""", re.S)
#: What follows a tag's name, to its end: quotes hide a >; and the plainer reading of a page whose quotes do not close.
REST, PLAIN_REST = re.compile(r"""((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>"""), re.compile(r"([^>]*+)>")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")

#: A subtree is template if it is in at least PAGES distinct texts of the host and in this share of them.
PAGES, SHARE = 4, 0.3
#: Pages that a task remembers as seen.
HELD = 200_000
#: A host with a larger share of all pages than this is dealt to several tasks.
FAIR = 1 / 4096


class Node:
    __slots__ = ("children", "dropped", "hash", "name")

    def __init__(self, name: str, dropped: bool = False):
        self.name, self.dropped, self.children, self.hash = name, dropped, [], 0


def _dropped(name: str, rest: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not rest or name in ("body", "html", "main", "article"):
        return False
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES):
            return True
        if key == "style" and HIDDEN_STYLE.search(value):
            return True
        if key in ("class", "id") and any(map(_marked, value.split())):
            return True
    return False


def _marked(name: str) -> bool:
    """Whether a class or id is made of marks, with neutral parts and numbers between."""
    own = [x.lower() for x in SPLIT.split(name) if x and not x.isdigit()]
    return not MARKS.isdisjoint(own) and all(x in MARKS or x in NEUTRAL for x in own)


def parse(page: str) -> Node:
    """The tree of a page's elements. Each open element is known by its place in the stack, so no step looks through it."""
    root = Node("#root")
    stack, open_, at = [root], {}, 0
    last = page.rfind(">")  # no tag ends after it
    rest = REST

    def nearest(names) -> int:
        return max((open_[n][-1] for n in names if open_.get(n)), default=0)

    def close(k: int) -> None:
        while len(stack) > k:
            open_[stack.pop().name].pop()

    while m := TAG.search(page, at):
        start = m.start()
        if m["name"]:
            found = rest.match(page, m.end()) if start < last else None
            if found is None and start < last and rest is REST:
                rest = PLAIN_REST  # a quote never closes: from here on tags end at the next >
                found = rest.match(page, m.end())
            if found is None:  # an unfinished tag: what is left is text
                break
        if start > at:
            stack[-1].children.append(html.unescape(page[at:start]))
        if not m["name"]:
            at = m.end()
            if m["cdata"]:
                stack[-1].children.append(m["cdata"])
            continue
        at, name, attributes = found.end(), m["name"].lower(), found[1]
        if m["end"]:
            k = nearest((name,))
            if k and (name in BLOCK or k >= nearest(("table", "article", "body"))):
                close(k)
            elif not k and name == "p":
                stack[-1].children.append(Node("p"))
            continue
        if name in BLOCK and (k := nearest(("p",))) > nearest(("table", "button", "article", "body")):
            close(k)
        if name in ENDS:
            shut, until = ENDS[name]
            limit = nearest(until)
            inside = [own[bisect_right(own, limit)] for n in shut if (own := open_.get(n)) and own[-1] > limit]
            if inside:
                close(min(inside))
        in_article = bool(open_.get("article") or open_.get("main"))
        node = Node(name, _dropped(name, attributes, in_article))
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
        elif name not in VOID and not attributes.endswith("/"):
            open_.setdefault(name, []).append(len(stack))
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(html.unescape(page[at:]))
    return root


def hashed(node: Node) -> int:
    """Sets the hash of every subtree, from the bottom (without recursion: pages may be nested very deep)."""
    order, todo = [], [node]
    while todo:
        order.append(one := todo.pop())
        todo += [x for x in one.children if isinstance(x, Node)]
    for one in reversed(order):
        own = xxhash.xxh3_64(one.name)
        for x in one.children:
            own.update(x.hash.to_bytes(8, "little") if isinstance(x, Node) else " ".join(x.split()))
        one.hash = own.intdigest()
    return node.hash


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def countable(root: Node) -> set[int]:
    """Hashes of the subtrees that a template could be made of: block elements that no rule drops already."""
    out, todo = set(), [root]
    while todo:
        for x in todo.pop().children:
            if isinstance(x, Node) and not x.dropped:
                if x.name in BLOCK and x.children:
                    out.add(signed(x.hash))
                todo.append(x)
    return out


def _topmost(root: Node, name: str) -> list[Node]:
    """Elements of a name outside of dropped parts and of each other, in their order."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.name == name:
            out.append(x)
        else:
            todo += [y for y in reversed(x.children) if isinstance(y, Node) and not y.dropped]
    return out


def main_nodes(root: Node) -> list[Node]:
    """The articles inside the main elements, or those elements if they hold none; without a main all articles."""
    mains = _topmost(root, "main")
    return [y for x in mains for y in _topmost(x, "article")] or mains or _topmost(root, "article")


def blocks(root: Node, template: set[int] | frozenset[int] = frozenset()) -> str:
    """The text of the main parts, blocks joined by an empty line, or of the page without any; but in articles, without the
    subtrees whose hash is template. A main part that is template goes as a whole, if another one stays."""
    mains = main_nodes(root)
    mains = [x for x in mains if signed(x.hash) not in template] or mains
    top = set(map(id, mains))
    whole = BLOCK if not mains else BLOCK - TEXT if mains[0].name == "main" else frozenset()
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    todo: list = mains[::-1] or [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.dropped or (x.name in whole and id(x) not in top and x.children and signed(x.hash) in template):
            if x.name in BLOCK:
                flush()
        elif x.name == "br":
            held.append(" ")
        else:
            if x.name in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return "\n\n".join(out)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port and user; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _subtrees(pages: DataFrame) -> DataFrame:
    """host, mark, hashes: for each page a hash of its whole text, and its countable subtrees in order; a page that a task sees
    again (an equal text and subtrees) is passed on once, as far as the task holds it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashed(root := parse(page.as_py()))
                found = sorted(countable(root))
                mark = signed(xxhash.xxh3_64_intdigest(blocks(root)))
                one = (host, mark, xxhash.xxh3_64_intdigest(repr(found)))
                if one not in seen:
                    seen.add(one)
                    rows.append((host, mark, found))
            if len(seen) > HELD:
                seen.clear()
            if rows:
                kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "mark", "hashes"])

    return in_arrow(pages.select("host", "html"), scan, "host string, mark long, hashes array<long>")


def _shares(pages: DataFrame) -> DataFrame:
    """host, shares for the hosts that hold more than FAIR of all pages: how many tasks such a host's pages are dealt to, so that
    none takes more than about FAIR of them. Reads urls only; fewer than 1 / FAIR rows."""
    rows = pages.groupBy("host").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total)).where(F.col("n") > FAIR * F.col("total")).select("host", F.ceil(F.col("n") / (FAIR * F.col("total"))).cast("int").alias("shares"))


def main_text(pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    A null page is empty and has an empty text; a null url, or one without a host, belongs to the host "". Pages of one
    text count once, so repeated rows change nothing and get equal texts. Very long, deeply nested and broken pages are read
    whole, in time in proportion to them. An empty table gives an empty result. Other columns are ignored. The pages of a host
    with very many are dealt to many tasks.
    """
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    texts = _subtrees(given).groupBy("host", "mark").agg(F.array_distinct(F.flatten(F.collect_set("hashes"))).alias("hashes"))
    # h null: distinct texts in all
    counts = texts.select("host", F.explode(F.concat("hashes", F.array(F.lit(None).cast("long")))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    counts = cut(counts.where(F.col("h").isNull() | (F.col("n") >= least)))
    total = counts.where("h is null").select("host", F.col("n").alias("n_texts"))
    # at most (mean subtrees of a page) / share hashes a host: bounded whatever the number of its pages
    template = counts.where("h is not null").join(total, "host").where(F.col("n") >= share * F.col("n_texts"))
    template = template.groupBy("host").agg(F.collect_list("h").alias("template"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, frozenset[int]] = (None, frozenset())
        for batch in batches:
            texts = []
            for page, host, template in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if host != last[0]:
                    last = host, frozenset(template.as_py() or ())
                root = parse(page.as_py())
                if last[1]:
                    hashed(root)
                texts.append(blocks(root, last[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = given.schema["page_id"].dataType.simpleString()
    shares = _shares(given)  # broadcast: at most 1 / FAIR of the hosts' rows can pass its bound
    dealt = given.join(F.broadcast(shares), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("shares", F.lit(1))))
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1).cast("array<long>"))
    copied = template.join(F.broadcast(shares), "host", "left").select("host", "template", salts.alias("salt"))
    joined = dealt.join(copied, ["host", "salt"], "left").select("page_id", "url", "html", "host", "template")
    return in_arrow(joined, scan, f"page_id {kind}, url string, text string, n_chars long")
