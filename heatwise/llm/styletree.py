"""Main text of web pages by site style trees.

The pages of a host are merged by presentation: a node of the tree is a path of tags with their classes. A node with text has the importance of
its contents: one less their mean entropy (a content that all pages share has entropy 1, one of a single page 0), as far as the number
of pages is evidence. What an author says a node is for is a feature of it: boilerplate names (menus, adverts, forms, ...) weigh its importance down
unless the branch is long, an article or main element vouches for a little of it, so neither decides alone. The importance of a branch is composed of its nodes' importance by
length of text, and of the variety of its presentation. Branches of low importance are removed from each page. Only what is never
text (scripts, styles, comments, controls) goes by name alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small

LEAST_IMPORTANCE = 0.3
#: Weight of content against presentation in a branch, of a boilerplate name, and how far an article is judged by its contents.
CONTENT, BOILERPLATE, ARTICLE = 0.9, 0.25, 0.9
#: Characters a page from which on a branch with a boilerplate name holds too much to be judged by it, and up to which its name loses all weight.
BRIEF, LONG = 600, 2400
MAX_NOISE_ROWS = 200_000

# Element names of HTML by what they are for.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript template button select iframe svg canvas object audio video title head textarea xmp noembed noframes".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "li", "caption", "head", "title", "tbody", "tfoot", "thead"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPE = frozenset("article aside body dialog div dl fieldset footer form header html main nav ol section table td th ul".split())
BOILERPLATE_WORDS = frozenset("ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead cookie cookies consent notice notices gdpr popup modal newsletter subscribe share sharing social related recommended comment comments disqus reply replies respond login signup search widget toolbar pager pagination skip copyright legal disclaimer hidden".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?=/?[A-Za-z])[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
PARTS = re.compile(r"[A-Za-z]+")
PLAIN = str.maketrans("/!", "__")


def _label(name: str, rest: str) -> str:
    """A node's name with its classes, and a ! if its name, class, id or role says boilerplate."""
    marked = name in BOILERPLATE_TAGS or "hidden" in rest.split()
    if "=" not in rest:
        return f"{name}!" if marked else name
    at = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)}
    # Bodies and articles carry marks like has-sidebar, which speak of what is in them.
    if name not in ("body", "html", "article", "main"):
        words = {w.lower() for w in PARTS.findall(f"{at.get('class', '')} {at.get('id', '')}")}
        marked = marked or bool(words & BOILERPLATE_WORDS) or at.get("role", "").lower() in BOILERPLATE_ROLES or at.get("aria-hidden", "").lower() == "true"
    styled = ".".join([name, *sorted(at.get("class", "").translate(PLAIN).split())])
    return f"{styled}!" if marked else styled


def blocks(html: str) -> list[tuple[str, str]]:
    """Text pieces in page order: path and decoded text, with a space at each edge of a block."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool]] = []  # name, path, whether it is no text
    path, silent = "", False

    def text(a: int, b: int) -> None:
        if b > a and not silent:
            out.append((path, unescape(html[a:b])))

    def pop(n: int) -> None:
        nonlocal path, silent
        del stack[n:]
        path, silent = stack[-1][1:] if stack else ("", False)

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK and not silent:
            out.append((path, " "))
        if m[1]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == name:
                    pop(n)
                    break
                if stack[n][0] in SCOPE and name not in SCOPE:
                    break
        elif name not in VOID:
            closed = ("p",) if name in CLOSES_P and name != "p" else SIBLINGS.get(name, ())
            if closed:
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] in closed:
                        pop(n)
                        break
                    if stack[n][0] in SCOPE and not (name == "tr" and stack[n][0] in ("td", "th")):
                        break
            if not (m[3] or "").endswith("/") or name in BLOCK:
                stack.append((name, f"{path}/{_label(name, m[3] or '')}", silent or name in NO_TEXT))
                path, silent = stack[-1][1:]
            if name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = stop.start() if stop else end
    return out


def leaves(html: str) -> dict[str, str]:
    """The contents of each path of a page, put together."""
    held: dict[str, list[str]] = {}
    for path, text in blocks(html):
        if not text.isspace():
            held.setdefault(path, []).append(" ".join(text.split()))
    return {k: " ".join(v) for k, v in held.items()}


def _host(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _number(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance): the merged trees of all hosts. Pages of a host with the same leaves count once, so that copies of a page do not look shared. Contents and styles are counted by hash."""

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, html in slices(batches, "html"):
            seen: dict[tuple[str, bytes], list[dict]] = {}
            for url, page in zip(batch.column(0).to_pylist(), html.to_pylist(), strict=True):
                host, own = _host(url), leaves(page)
                key = host, blake2b(repr(list(own.items())).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if key in seen:
                    continue
                children: dict[str, list[str]] = {}
                nodes = dict.fromkeys(p for leaf in own for p in _prefixes(leaf))
                for node in nodes:
                    children.setdefault(node.rpartition("/")[0], []).append(node.rpartition("/")[2])
                seen[key] = [{"path": n, "length": len(t), "v": _number(t)} for n, t in own.items()] + [{"path": n, "length": -1, "v": _number("/".join(children.get(n, [])))} for n in nodes]
            node = pa.struct([("path", pa.string()), ("length", pa.int64()), ("v", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.binary()), pa.array(list(seen.values()), pa.list_(node))], names=["host", "page", "nodes"])

    rows = pages.select("url", "html").mapInArrow(on, "host string, page binary, nodes array<struct<path: string, length: long, v: long>>")
    rows = rows.dropDuplicates(["host", "page"]).select("host", F.explode("nodes").alias("node")).select("host", "node.*")
    each = rows.groupBy("host", "path", "length", "v").agg(F.count("*").alias("n"))
    content = F.col("length") >= 0
    # With m pages: entropy of a content on k pages is log_m(k); variety of styles with shares n / m is -sum(n/m * log_m(n/m)).
    node = each.groupBy("host", "path").agg(
        F.sum(F.when(~content, F.col("n"))).alias("pages"),
        F.avg(F.when(content, F.log("n"))).alias("shared"),
        F.sum(F.when(content, F.col("length") * F.col("n"))).alias("length"),
        F.sum(F.when(~content, F.col("n") * F.log("n"))).alias("plogp"),
    )
    node = cut(node, "style-nodes")
    m = F.log("pages")
    judged = F.when(F.col("path").rlike("/(article|main)[./]|/(article|main)$"), ARTICLE).otherwise(1.0)
    # A boilerplate name weighs less the more text its branch has on a page: menus and adverts are brief.
    named = F.regexp_extract("path", "^(.*?/[^/]*!)(?:/|$)", 1)
    sizes = node.where(named != "").groupBy("host", named.alias("named")).agg((F.sum("length") / F.max("pages")).alias("size"))
    node = node.withColumn("named", named).join(sizes, ["host", "named"], "left")
    freed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.coalesce("size", F.lit(0.0)) - BRIEF) / (LONG - BRIEF)))
    marked = F.when(F.col("named") != "", BOILERPLATE + (1 - BOILERPLATE) * freed).otherwise(1.0)
    # The fewer pages, the less a shared content says: (m - 1) / m of its entropy counts.
    entropy = F.when(F.col("pages") > 1, F.least(F.lit(1.0), F.col("shared") / m) * (1 - 1 / F.col("pages"))).otherwise(0.0)
    leaf = node.where("shared is not null").select("host", "path", "length", (marked * (1 - judged * entropy)).alias("own"))
    # A leaf counts in each of its branches: the leading parts of its path.
    parts = F.split(F.expr("substring(path, 2)"), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    branch = leaf.select("host", F.explode(up).alias("path"), "length", "own").groupBy("host", "path").agg((F.sum(F.col("own") * F.col("length")) / F.sum("length")).alias("within"), F.count("*").alias("leaves"))
    styles = F.when(F.col("pages") > 1, (m - F.col("plogp") / F.col("pages")) / m).otherwise(1.0)
    both = node.join(branch, ["host", "path"])
    plain = both["shared"].isNotNull() & (F.col("leaves") == 1)
    return both.select("host", "path", "pages", F.when(plain, F.col("within")).otherwise(CONTENT * F.col("within") + (1 - CONTENT) * styles * marked).alias("importance"))


def _prefixes(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:n]) for n in range(2, len(parts) + 1)]


def main_text(pages: DataFrame, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text: the article of each page.

    pages: page_id, url, html; one row per input row. White space inside a block becomes one space, blocks are joined by one space.
    Null and empty html give an empty text; pages without a host (null url included) form a host of their own; a text of any length
    is one piece of work; repeated rows give the same text; other columns are not looked at; an empty table gives an empty result.
    """
    pages = pages.select("page_id", "url", "html")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    tree = style_tree(pages).where(F.col("importance") < least_importance)
    low = cut(tree.groupBy("host").agg(F.collect_list("path").alias("paths")), "style-noise")
    rows = pages.withColumn("host", host).join(small(low, MAX_NOISE_ROWS), "host", "left").select("page_id", "url", "html", "paths")

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, html in slices(batches, "html"):
            texts = []
            for page, paths in zip(html.to_pylist(), batch.column(3).to_pylist(), strict=True):
                low, kept = frozenset(paths or ()), {}
                out = []
                for path, text in blocks(page):
                    if path not in kept:
                        kept[path] = low.isdisjoint(_prefixes(path))
                    if kept[path] or text == " ":
                        out.append(text)
                texts.append(" ".join("".join(out).split()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(on, f"page_id {kind}, url string, text string")
