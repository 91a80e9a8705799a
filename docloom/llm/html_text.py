"""HTML extraction with removal of site templates.

Each page is read into a tree. Elements that never hold article text (scripts, menus, footers, forms, ...) and elements
whose class, id or role names such a part are left out. For what is left, the subtree of every element with text is hashed;
Spark counts on how many different articles of a host each subtree occurs, and subtrees that recur on at least MIN_PAGES of them and on
a share of MIN_SHARE or more are deleted when the text is put together. Copies of one article on a host count once, so an
article isn't taken for a template because its page was crawled often.

Because of MIN_SHARE a host has at most 1 / MIN_SHARE times as many template hashes as a page has elements, which bounds the list kept
for a host. An element that only the words of its class or id call a menu, notice and the like goes, unless nothing would be left.
Repeated rows are read each for itself but count once; an empty table gives an empty result; columns named text or n_chars give way. Null or empty pages give an empty text. Pages without a host in their url lose no templates. Tags that are cut off at the end
of a page are dropped, unclosed elements end with their parent.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import lookup_join, map_texts, stored

MIN_PAGES, MIN_SHARE = 5, 0.2

# Element names and the words of class, id and role that mark parts which aren't article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav footer aside button select textarea input iframe svg canvas object embed video audio dialog menu title map math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div main td th".split())
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertisements adbox adslot adsense banner banners breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus discussion footer gdpr menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related respond share sharing sidebar sidebars skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
HEADER_NAMES = frozenset("header masthead topbar".split())
#: A class name that holds one of these only says what surrounds an element.
STATE_WORDS = frozenset("no not non has with without is show hide enabled disabled open closed allowed".split())
#: These name a part wherever they stand in a class name; the other words of NOT_ARTICLE do so for sure at its end only.
ALWAYS = frozenset("comment comments commentlist cookie cookies consent discussion disqus footer gdpr modal nav navbar navigation newsletter popup respond sidebar sidebars subscribe".split())
#: Kinds of doubt: by the end of a name, by a word inside it, a form.
NAMED, LOOSE, FORM = 2, 3, 4
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|style|hidden)(?=[\s=/]|\Z)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAMES = re.compile(r"[A-Za-z]+")
_SPLIT_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parts", "dropped", "doubtful", "area")

    def __init__(self, tag: str, dropped: bool, area: str, doubtful: int = 0):
        self.tag, self.dropped, self.doubtful, self.area, self.parts = tag, dropped, doubtful, area, []


def unwanted(tag: str, attributes: str, area: str) -> int:
    """Whether an element holds no article text: 1 surely, NAMED or LOOSE by the words of its class or id only, FORM for a form. area: "article" or "main" inside such an element, else empty."""
    if tag in DROPPED or tag == "header" and not area:
        return 1
    doubt = FORM if tag == "form" else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return doubt
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if tag in ("body", "html", "main"):
                continue
            for name in value.split():
                words = [x.lower() for x in _NAMES.findall(_SPLIT_CAMEL.sub(" ", name))]
                if doubt == FORM or not STATE_WORDS.isdisjoint(words):
                    continue
                wanted = NOT_ARTICLE if area else NOT_ARTICLE | HEADER_NAMES
                if words and (words[-1] in wanted or not ALWAYS.isdisjoint(words)):
                    doubt = NAMED
                elif not doubt and not wanted.isdisjoint(words):
                    doubt = LOOSE
        elif name == "role" and value.lower() in NOT_ARTICLE_ROLES and tag not in ("body", "html", "main", "article"):
            return 1
        elif name == "aria-hidden" and value.lower() == "true" or name == "hidden":
            return 1
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 1
    return doubt


def parse(page: str) -> Node:
    """The tree of a page. Parts of a node are texts (character references decoded) and nodes, in page order."""
    root = Node("", False, "")
    stack, at, size = [root], 0, len(page)
    opened: dict[str, int] = {}  # open elements by tag, so that an end tag without one costs nothing
    doubtful = False

    def pop_to(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    search, unescape = _TOKEN.search, html.unescape
    while at < size:
        token = search(page, at)
        end = token.start() if token else size
        if end > at and not stack[-1].dropped:
            text = page[at:end]
            stack[-1].parts.append(unescape(text) if "&" in text else text)
        if not token:
            break
        at = token.end()
        closing, tag, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
        if not tag or page[at - 1] != ">":
            continue
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    pop_to(k)
                    break
            continue
        top = stack[-1]
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag not in INLINE:
                    break
            top = stack[-1]
        elif tag in CLOSES_LIKE:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES_LIKE[tag]:
                    pop_to(k)
                    if tag not in ("tr",):
                        break
                elif stack[k].tag in SCOPES:
                    break
            top = stack[-1]
        if tag in VOID:
            top.parts.append(" " if tag in ("br", "hr") else "")
            continue
        area = "main" if tag == "main" else "article" if tag == "article" else top.area
        kind = 1 if top.dropped else unwanted(tag, attributes, top.area)
        node = Node(tag, kind == 1, area, kind if kind > 1 else 0)
        doubtful |= kind > 1
        if not node.dropped:
            top.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if not attributes.endswith("/") or tag not in ("path", "circle", "rect", "line", "polygon", "use"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return settled(root) if doubtful else root


def weigh(root: Node) -> None:
    """Clears the doubt of loosely named elements and forms that are the page itself, in one pass over the tree.

    Weights are words outside links and outside elements that are surely named otherwise; those of a form count in paragraphs only.
    """
    order, queue = [], [(root, None, False, False)]
    while queue:
        node, above, link, paragraph = queue.pop()
        link, paragraph = link or node.tag == "a", paragraph or node.tag == "p"
        order.append((node, above, link, paragraph))
        queue += [(x, node, link, paragraph) for x in node.parts if isinstance(x, Node)]
    sums: dict[int, list[int]] = {id(node): [0, 0, 0, 0] for node, *_ in order}  # words, in paragraphs, main elements, other heads
    for node, above, link, paragraph in reversed(order):
        own = sums[id(node)]
        n = 0 if link else sum(len(x.split()) for x in node.parts if isinstance(x, str))
        own[0] += n
        own[1] += n * paragraph
        own[2] += node.tag == "main"
        own[3] += node.tag in ("article", "h1")
        if above is not None and node.doubtful != NAMED:
            for k, x in enumerate(own):
                sums[id(above)][k] += x
    total = sums[id(root)][0]
    for node, *_ in order:
        words, in_paragraphs, mains, heads = sums[id(node)]
        if node.doubtful == LOOSE and (mains or 2 * words > total) or node.doubtful == FORM and (mains or heads or 2 * in_paragraphs > total):
            node.doubtful = 0


def settled(root: Node) -> Node:
    """root without doubtful elements; where no text is left outside them, the outermost named one with most text stays, and so on inside it."""
    weigh(root)
    while True:
        queue, found, outside = [root], [], False
        while queue:
            node = queue.pop()
            for part in node.parts:
                if isinstance(part, str):
                    outside |= bool(part.strip())
                elif part.doubtful:
                    found.append((node, part))
                else:
                    queue.append(part)
        best, most = None, 0
        for _, part in found if not outside else ():
            if part.doubtful == FORM:
                continue
            out: list[str] = []
            render(part, out, frozenset(), None)
            n = len("".join(out).split())
            if n > most:
                best, most = part, n
        gone = {id(part) for _, part in found if part is not best}
        for node in {id(node): node for node, _ in found}.values():
            node.parts = [x for x in node.parts if id(x) not in gone]
        if best is None:
            return root
        best.doubtful = 0


def render(node: Node, out: list[str], gone: frozenset[int], hashes: dict[int, None] | None) -> int:
    """Appends the text below node to out unless its hash is in gone; notes hashes of subtrees with text. Gives the hash, 0 without text.

    Works on an explicit stack, so that deep nesting can't exhaust Python's.
    """
    done: list[tuple[Node, int, int, list[bytes], bool]] = [(node, 0, len(out), [node.tag.encode()], False)]
    value = 0
    while done:
        this, k, mark, digest, full = done.pop()
        parts = this.parts
        if k == 0 and this.tag not in INLINE:
            out.append(" ")
        while k < len(parts) and isinstance(parts[k], str):
            words = parts[k].split()
            out.append(parts[k])
            if words:
                full = True
                digest.append(" ".join(words).encode("utf-8", "surrogatepass"))
            k += 1
        if k < len(parts):
            done.append((this, k + 1, mark, digest, full))
            done.append((parts[k], 0, len(out), [parts[k].tag.encode()], False))
            continue
        value = xxhash.xxh64_intdigest(b"\x00".join(digest)) - (1 << 63) if full else 0
        if full and hashes is not None:
            hashes[value] = None
        if full and value in gone:
            del out[mark:]
            out.append(" ")
        elif this.tag not in INLINE:
            out.append(" ")
        if done and full:
            above = done[-1]
            above[3].append(value.to_bytes(8, "little", signed=True))
            done[-1] = (*above[:4], True)
    return value


def areas(root: Node) -> list[Node]:
    """The outermost main and article elements that hold text, and the h1 elements outside them, in page order; without main and article, the whole page."""
    found, queue = [], [root]
    while queue:
        node = queue.pop()
        if node.tag in ("main", "article", "h1"):
            found.append(node)
        else:
            queue += [x for x in reversed(node.parts) if isinstance(x, Node)]
    found = [x for x in found if render(x, [], frozenset(), None)]
    return found if any(x.tag != "h1" for x in found) else [root]


def extract(page: str, gone: frozenset[int] = frozenset()) -> str:
    out: list[str] = []
    for node in areas(parse(page)) if page else []:
        render(node, out, gone, None)
        out.append(" ")
    return " ".join("".join(out).split())


def subtree_hashes(page: str) -> tuple[int, list[int]]:
    """(hash of the article text, hashes of the subtrees with text)."""
    hashes: dict[int, None] = {}
    out: list[str] = []
    for node in areas(parse(page)) if page else []:
        render(node, out, frozenset(), hashes)
        out.append(" ")
    text = " ".join("".join(out).split())
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), list(hashes)


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """pages(page_id, url, html, ...) -> the same rows without html, with text and n_chars."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    hosted = pages.withColumn("__host", host)

    def survey():
        def run(texts):
            found = [subtree_hashes(t or "") for t in texts.to_pylist()]
            return [pa.array([a for a, _ in found], pa.int64()), pa.array([h for _, h in found], pa.list_(pa.int64()))]

        return run

    seen = map_texts(hosted.select("__host", "html"), survey, "article bigint, hashes array<bigint>", "html", keep_text=False)
    seen = stored(seen.where("__host <> ''"))
    # A subtree counts once for each article that it is on, however many copies of that article there are.
    n_articles = seen.groupBy("__host", "article").agg(F.lit(1).alias("one")).groupBy("__host").agg(F.count("*").alias("n"))
    pairs = seen.select("__host", "article", F.explode("hashes").alias("hash")).distinct()
    counts = pairs.groupBy("__host", "hash").agg(F.count("*").alias("k")).where(F.col("k") >= min_pages)
    often = counts.join(n_articles.hint("shuffle_merge"), "__host").where(F.col("k") >= F.col("n") * min_share)
    gone = stored(often.groupBy("__host").agg(F.sort_array(F.collect_list("hash")).alias("__gone")))
    joined = lookup_join(hosted, gone, ["__host"], F.xxhash64("page_id", "url"), "left").drop("__host")
    return _texts(joined)


def _texts(df: DataFrame) -> DataFrame:
    from pyspark.sql.types import StructType

    names = df.columns
    html_at, gone_at = names.index("html"), names.index("__gone")
    kept = [k for k, name in enumerate(names) if k not in (html_at, gone_at) and name not in ("text", "n_chars")]
    schema = StructType([df.schema.fields[k] for k in kept] + StructType.fromDDL("text string, n_chars bigint").fields)

    def run(batches):
        for batch in batches:
            gone = batch.column(gone_at).to_pylist()
            texts = [extract(p or "", frozenset(g or ())) for p, g in zip(batch.column(html_at).to_pylist(), gone)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return df.mapInArrow(run, schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op5_html_text": op5_html_text}
