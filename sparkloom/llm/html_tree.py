"""HTML extraction by site style trees.

The pages of a host are merged into one tree of presentation nodes: an element's place is
the chain of block elements above it with their names and class words.  Over the distinct
pages of the host each node gets an importance from the entropy of what it shows and of how
its children are laid out: menus, adverts and notices show the same few things on many
pages, articles something else on every page.  The tree of all hosts is the prior: it counts
like ``PRIOR_PAGES`` pages of the host itself, and what all places of one name show is in
turn the prior of a place.  Branches of low importance are cut from each page.  Mark-up
alone takes away what the HTML standard says is no text (scripts, forms, navigation and the
like), what is hidden, and reader comments, which differ from page to page as articles do.

Pages are parsed once, into blocks and nodes.  Only counts by (host, node, content) are
shuffled; the cuts, a short list for each host, are broadcast if they are few, else joined
with pages that are dealt by salt.

Defined cases
  * null html counts as empty and gives an empty text, as does a page without text;
  * a block is what no block element's start or end divides; a line break is white space;
  * pages of a host with the same longest block are one page for the importance, whatever
    stands around it; null and odd URLs share one host;
  * a page that would lose all its text to importance keeps what mark-up alone leaves, and
    one whose text is all within a form keeps that; a form that holds an article is a wrapper;
  * an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, text, written

LAYOUT_PART = 0.1  # of a node's importance; the rest is the content's
#: A node is cut under this importance; within an article only if it is nearly always the same.
LOW, LOW_IN_ARTICLE = 0.9, 0.3
PRIOR_PAGES = 8
BROADCAST_CUTS = 200_000
SALTS = 64
RESULT = "page_id long, url string, text string, n_chars long"

#: Elements of the HTML standard by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head script style template noscript nav footer aside form button select textarea input iframe object embed svg canvas audio video map menu dialog search noembed noframes".split())
ENDS_P = BLOCK - frozenset("option optgroup caption tbody td tfoot th thead tr legend".split())
#: A start tag that ends an open element of these names, up to the given ancestors.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Class words of reader comments, and words that say that a class is about something else.
COMMENT = frozenset("comment comments disqus replies respond".split())
WITH = frozenset("has with without no".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _marks(attributes: str) -> tuple[str, bool, bool]:
    """Class and id words; whether they are of reader comments; whether the element is hidden
    or its role says no text."""
    if not attributes or attributes.isspace():
        return "", False, False
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            names += [words for x in value.split() if (words := [w.lower() for w in _WORDS.findall(x)])]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name == "role" and value.strip().lower() in ROLES:
            hidden = True
    comment = any(not COMMENT.isdisjoint(words) and WITH.isdisjoint(words) for words in names)
    return ".".join(w for words in names for w in words), comment, hidden


#: Why an element's text goes: it never is text, or it is in a form that may be a wrapper.
GONE, IN_FORM = 1, 2


class Element:
    __slots__ = ("name", "path", "dropped", "article", "node")

    def __init__(self, name, path, dropped, article, node):
        self.name, self.path, self.dropped, self.article, self.node = name, path, dropped, article, node


class Node:
    """A presentation node of one page: hashes of what it shows and of its children's order."""

    __slots__ = ("place", "label", "article", "content", "layout")

    def __init__(self, place, label, article):
        self.place, self.label, self.article, self.content, self.layout = place, label, article, 0, 0


def parse(source: str) -> tuple[list[tuple[str, list[int]]], dict[int, Node]]:
    """The page's text blocks, each with the places (in order) of the nodes that hold it, and
    the nodes by the hash of their path."""
    top = Element("", "", 0, False, 0)
    stack, buffer, blocks, formed = [top], [], [], []
    nodes: dict[int, Node] = {}

    def put(text: str) -> None:
        if stack[-1].dropped != GONE:
            buffer.append(text)

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                if next(e for e in reversed(stack) if e is top or e.name in BLOCK).dropped == IN_FORM:
                    formed.append((text, []))
                    return
                chain = [nodes[e.node] for e in stack if e.node]
                blocks.append((text, [n.place for n in chain]))
                h = _hash(text)
                for n in chain:
                    n.content += h

    def close(at: int) -> None:
        flush()
        del stack[at:]

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            put(source[at:])
            break
        if m.start() > at:
            put(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                put(m[0][9:-3].replace("&", "&amp;"))
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name == "br":
                put(" ")
            elif name == "p" and not any(e.name == "p" for e in stack):
                flush()
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        if name in BLOCK:
                            close(k)
                        else:
                            del stack[k]
                        break
                    if stack[k].name in BLOCK and name not in BLOCK:
                        break  # an inline element's end does not reach over a block
            continue
        attributes = m[3] if m[2] else m[6]
        if name == "br" or name == "wbr":
            put(" " if name == "br" else "")
            continue
        words, comment, hidden = _marks(attributes)
        block = name in BLOCK
        if block:
            flush()
            if name in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        close(k)
                        break
                    if stack[k].name in BLOCK:
                        break
            if name in CLOSES:
                ended, limit = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ended:
                        close(k)
                        break
                    if stack[k].name in limit:
                        break
        if name in VOID:
            continue
        parent = stack[-1]
        if name in ("html", "body", "main"):
            comment = False
        gone = parent.dropped == GONE or hidden or comment or name in DROPPED and name != "form" or name == "header" and not parent.article
        main = not gone and name in ("article", "main")
        dropped = GONE if gone else 0 if main else IN_FORM if name == "form" else parent.dropped
        article = parent.article or main
        if name in RAW:
            close_at = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
            if close_at is None:
                break
            after = source.find(">", close_at.end())
            at = end if after < 0 else after + 1
            continue
        if not block:
            # inline elements are transparent, but their end tag must find them
            stack.append(Element(name, parent.path, dropped, article, 0))
            continue
        flush()
        label = f"{name}.{words}" if words else name
        path = f"{parent.path}/{label}"
        node = _hash(path) if not dropped and name not in ("html", "body") else 0
        if node:
            nodes.setdefault(node, Node(len(nodes), _hash(label), article))
            holder = next((e for e in reversed(stack) if e.node), None)
            if holder is not None:
                nodes[holder.node].layout = (nodes[holder.node].layout * 31 + _hash(label)) & (2**63 - 1)
        stack.append(Element(name, path, dropped, article, node))
    flush()
    return blocks or formed, nodes


def _signed(h: int) -> int:
    return ((h + 2**63) & (2**64 - 1)) - 2**63


_NODE = "struct<node:bigint,label:bigint,article:boolean,content:bigint,layout:bigint>"
_BLOCK = "struct<text:string,chain:array<int>>"
_PARSED = f"page_id long, url string, host long, page long, nodes array<{_NODE}>, blocks array<{_BLOCK}>"
_NODE_TYPE = pa.struct([("node", pa.int64()), ("label", pa.int64()), ("article", pa.bool_()), ("content", pa.int64()), ("layout", pa.int64())])
_BLOCK_TYPE = pa.struct([("text", pa.string()), ("chain", pa.list_(pa.int32()))])


def _parsed(batches):
    """Pages (page_id, url, host, html) to _PARSED; ``page`` tells a host's pages apart."""
    for batch in batches:
        for part in pieces(batch, 3, 1 << 20):
            pages, all_nodes, all_blocks = [], [], []
            for source in part.column(3).to_pylist():
                blocks, nodes = parse(source)
                pages.append(_hash(max((t for t, _ in blocks), key=len, default="")))
                all_nodes.append([{"node": k, "label": n.label, "article": n.article, "content": _signed(n.content), "layout": n.layout} for k, n in nodes.items()])
                all_blocks.append([{"text": t, "chain": c} for t, c in blocks])
            columns = [*(part.column(k) for k in range(3)), pa.array(pages, pa.int64()), pa.array(all_nodes, pa.list_(_NODE_TYPE)), pa.array(all_blocks, pa.list_(_BLOCK_TYPE))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "page", "nodes", "blocks"])


def sameness(counts: DataFrame, *keys: str) -> DataFrame:
    """For the nodes of the trees told apart by ``keys``: whether in an article, pages, and how
    much content and layout repeat, each as (same, most): the sum of n log n over what is
    shown, and the value of that sum if all pages showed the same."""
    n = F.sum("n").alias("n")
    spread = F.sum(F.col("n") * F.log("n"))
    content = counts.groupBy(*keys, "article", "content").agg(n).groupBy(*keys).agg(F.sum("n").alias("pages"), spread.alias("content"), F.max("article").alias("article"))
    layout = counts.groupBy(*keys, "layout").agg(n).groupBy(*keys).agg(spread.alias("layout"))
    same = F.lit(1 - LAYOUT_PART) * F.col("content") + F.lit(LAYOUT_PART) * F.when(F.col("content") > 0, F.col("layout")).otherwise(0.0)
    return content.join(layout, list(keys)).select(*keys, "article", "pages", same.alias("same"), (F.col("pages") * F.log("pages")).alias("most"))


def importance(counts: DataFrame) -> DataFrame:
    """host, node, article, pages and importance: one less the share of the greatest possible
    sameness, where the tree of all hosts counts like some pages of the host."""
    weight = F.lit(PRIOR_PAGES * math.log(PRIOR_PAGES))
    label = sameness(counts, "label").select("label", (F.col("same") / (F.col("most") + weight)).alias("of_label"))
    place = sameness(counts, "node", "label").join(label, "label")
    place = place.select("node", ((F.col("same") + weight * F.col("of_label")) / (F.col("most") + weight)).alias("of_place"))
    own = sameness(counts, "host", "node").join(place, "node")
    return own.select("host", "node", "article", "pages", (1 - (F.col("same") + weight * F.col("of_place")) / (F.col("most") + weight)).alias("importance"))


def low_branches(parsed: DataFrame) -> DataFrame:
    """host and cut (array of node hashes): what each host's pages lose."""
    found = parsed.select("host", "page", F.inline("nodes")).where("content <> 0")  # nodes that show text
    # equal pages of a host count once
    once = found.groupBy("host", "node", "label", "article", "content", "layout", "page").agg(F.lit(1).alias("one"))
    counts = written(once.groupBy("host", "node", "label", "article", "content", "layout").agg(F.count(F.lit(1)).alias("n")), "style-nodes")
    low = F.col("importance") < F.when(F.col("article"), LOW_IN_ARTICLE).otherwise(LOW)
    return written(importance(counts).where(low).groupBy("host").agg(F.collect_list("node").alias("cut")), "style-cuts")


def cleaned(parsed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Parsed pages without the cut branches (RESULT)."""
    few = (cuts.agg(F.sum(F.size("cut"))).first()[0] or 0) <= BROADCAST_CUTS
    if few:
        joined = parsed.join(F.broadcast(cuts), "host", "left")
    else:
        salted = parsed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        spread = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(spread, ["host", "salt"], "left")
    gone = F.transform("nodes", lambda n: F.array_contains(F.coalesce("cut", F.array().cast("array<bigint>")), n["node"]))
    marked = joined.select("page_id", "url", "blocks", gone.alias("gone"))
    left = F.filter("blocks", lambda b: ~F.exists(b["chain"], lambda k: F.get("gone", k)))
    text = marked.select("page_id", "url", F.array_join(F.transform(F.when(F.size(left) > 0, left).otherwise(F.col("blocks")), lambda b: b["text"]), "\n\n").alias("text"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def page_text(source: str, cut: set[int] = frozenset()) -> str:
    """One page's text by itself: without the nodes whose hashes are ``cut``."""
    blocks, nodes = parse(source)
    gone = {n.place for k, n in nodes.items() if k in cut}
    left = [t for t, chain in blocks if gone.isdisjoint(chain)]
    return "\n\n".join(left or [t for t, _ in blocks])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page (RESULT)."""
    bounded_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.trim(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.xxhash64(host).alias("host"), text(html_col).alias("html"))
    parsed = written(rows.mapInArrow(_parsed, _PARSED), "parsed-pages")
    return cleaned(parsed, low_branches(parsed))


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
