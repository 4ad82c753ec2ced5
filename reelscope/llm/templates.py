"""Main text of web pages by equivalence classes of template tokens.

A page's tokens are its elements, each named by its path of structural elements with class and id. Over the pages of one host a
token has an occurrence vector, how often it stands on each page; tokens with the same vector form an equivalence class. Vectors are
never gathered: two sums of page hashes, weighed by the counts, stand for one, so a host of any size is summed by partial
aggregation. The class of what stands once on each page is the root's, other valid classes are those of layouts; what stands k times
on each page of a class, such as the items of a list, is in it. What lies under a template token is a slot.

The classes decide what belongs to the template: a slot with one text on all pages of its class, or, outside article and main
elements, one whose few texts take turns while the host's main slot, the one of most distinct text, varies. The slots of one
container go or stay together. No tree of classes is built and no optional or repeated part is aligned between pages: containment
of paths gives the nesting.

Names and tags only break ties, for slots that vary or of which too few pages tell: menus, asides, forms and the like are told by
their tag, names in class, id or role count as whole words, and within an article or main element only adverts, comments and
related lists are told by their names, and no paragraph, heading or list item is. A page of a host without a template falls back on
its own article or main element, then on its body.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_arrow, scratch, table, written

#: Pages that a token of the template stands on, at least: the support of the method. Fewer pages tell nothing.
SUPPORT = 3
#: A slot whose texts are so many times rarer, by its pages, than those of the main slot takes turns.
TURNS = 2
#: Elements at the end of a path that are part of what their container tells.
FLOW = r"(>(p|h[1-6]|li|td|pre|blockquote)([.#][^>]*)?)+$"
_FLOWING = frozenset("p h1 h2 h3 h4 h5 h6 li td th pre blockquote".split())

#: Names longer than this mark nothing.
LONGEST = 60

#: Elements nested deeper than this have the path of the last one above; their text is extracted all the same.
DEEPEST = 100

#: Fixed values of the HTML vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript iframe textarea title".split())
#: Elements that hold no text of the page; one without an end tag holds nothing.
FOREIGN = frozenset("svg math object canvas select template".split())
HARD = frozenset("head button".split()) | RAW | FOREIGN
SKIPPED = frozenset("nav footer aside form dialog menu".split())
#: Elements that are not skipped for their names.
WHOLE = frozenset("html body article main".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol dl table article section div body main td th blockquote figure".split()) | FOREIGN
#: Names in class, id or role that mark what is no article, whole or joined with each other or with names of places.
_PLACES = r"site|main|global|page|post|posts|entry|article|articles|top|bottom|left|right|primary|secondary|area|list|box|wrapper|container|section|block|inner|outer|bar|links?|items?|icons?|buttons?|form"
_MARKS = (
    r"ads?|advert\w*?|sponsor\w*?|promo\w*?|banner|nav\w*?|menu\w*?|breadcrumbs?|sidebar|side|widget\w*?|related|recommended|comments?|commentlist|disqus\w*?|replies|reply|respond"
    r"|cookies?|consent|gdpr|notice\w*?|alert|popup|modal|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|footer|masthead|pagination|pager|skip|toolbar|complementary|contentinfo|navigation"
)


def _whole_names(marks: str, places: str) -> re.Pattern[str]:
    return re.compile(rf"(?:(?:{places})[0-9]*[_-]+)*(?:{marks})[0-9]*(?:[_-]+(?:{marks}|{places}|[0-9]+)[0-9]*)*", re.I)


BOILER = _whole_names(_MARKS, _PLACES)
#: Those that count within an article or main element.
INNER = _whole_names(r"ads?|advert\w*?|sponsor\w*?|promo\w*?|sidebar|breadcrumbs?|related|recommended|comments?|commentlist|disqus\w*?|replies|respond|newsletter", _PLACES)
HEADER = _whole_names("header|banner|masthead|topbar", "site|global|top|primary|secondary|area|wrapper|container|inner|outer|bar")

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>|<[a-zA-Z/!?][^>]*$|[^<]+|<""",
    re.S,
)
#: Comments, and start and end tags whose pairs are looked for.
_PAIRED = re.compile(rf"""<!--.*?(?:-->|$)|<(?P<end>/?)(?P<tag>{"|".join(sorted(FOREIGN | RAW))})(?=[\s/>])[^<>]*>?""", re.I | re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


#: Why an element is skipped, the strongest reason last.
KEPT, BY_NAME, BY_TAG, NO_TEXT = range(4)


def _plain(name: str) -> str:
    """A name without digits, and without the sign that parts paths."""
    return re.sub(r"[0-9>]+", "", name)


class Node:
    """An element: skipped is the strongest reason to skip it or one around it, form the form around it."""

    __slots__ = ("tag", "path", "skipped", "main", "form")

    def __init__(self, tag: str, path: str, skipped: int, main: bool, form: Node | None):
        self.tag, self.path, self.skipped, self.main, self.form = tag, path, skipped, main, form


def blocks(html: str) -> list[tuple[str | None, Node]]:
    """In page order: (None, element) for each element that opens, (text, innermost element) for each block of text.

    A form is skipped unless it holds half of the page's text that nothing else skips.
    """
    found = list(_parsed(html))
    held: Counter[Node | None] = Counter()
    for text, node in found:
        if text is not None and node.skipped == KEPT:
            held[node.form] += len(text)
    whole = held.total()
    for _, node in found:
        if node.form is not None and 2 * held[node.form] < max(whole, 1):
            node.skipped = max(node.skipped, BY_TAG)
    return found


def _closed_elements(html: str) -> set[int]:
    """Where start tags of FOREIGN and RAW elements stand that an end tag closes: it closes the last one before it that is open."""
    waiting: dict[str, list[int]] = {}
    closed = set()
    for m in _PAIRED.finditer(html):
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if not m["end"]:
            if tag not in ("svg", "math") or not m[0].endswith("/>"):
                waiting.setdefault(tag, []).append(m.start())
        elif waiting.get(tag):
            closed.add(waiting[tag].pop())
    return closed


def _parsed(html: str) -> Iterator[tuple[str | None, Node]]:
    stack = [Node("", "", KEPT, False, None)]
    closed = _closed_elements(html)
    is_open: Counter[str] = Counter()
    pieces: list[str] = []
    at, end = 0, len(html)

    def close(k: int) -> None:
        is_open.subtract(node.tag for node in stack[k:])
        del stack[k:]

    def flush() -> str:
        text = " ".join(markup.unescape("".join(pieces)).split())
        pieces.clear()
        return text

    while at < end:
        start = at
        m = _TOKEN.match(html, at)
        at = m.end()
        tag, rest = m["tag"] or m["tag2"], m["rest"] or m["rest2"] or ""
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                pieces.append(m[0])
            elif m[0].startswith("<![CDATA["):
                pieces.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            continue
        if text := flush():
            yield text, stack[-1]
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1) if is_open[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("body", "html"):
                    break
            continue
        ends = ("p", *CLOSES.get(tag, ()))
        for k in range(len(stack) - 1, 0, -1) if any(is_open[x] > 0 for x in ends) else ():
            if stack[k].tag in ends:
                close(k)
            elif stack[k].tag in LIMITS:
                break
        top = stack[-1]
        names = {k.lower(): v.strip("\"'") for k, v in _NAMES.findall(rest)} if "=" in rest else {}
        labels = [] if tag in WHOLE else [x for v in names.values() for x in v.split()]
        main = top.main or tag in ("article", "main") or names.get("role", "").lower() in ("main", "article")
        form = top.form
        if tag in HARD:
            skipped = NO_TEXT
        elif tag in SKIPPED and tag != "form" or (tag == "header" and not top.main):
            skipped = BY_TAG
        else:
            marked = top.main and tag not in _FLOWING and any(INNER.fullmatch(x) for x in labels if len(x) <= LONGEST)
            marked = marked or (not top.main and any(BOILER.fullmatch(x) or HEADER.fullmatch(x) for x in labels if len(x) <= LONGEST))
            skipped = BY_NAME if marked else KEPT
        name = tag + "".join(f".{_plain(x)}" for x in names.get("class", "").split()[:2]) + (f"#{_plain(names['id'])}" if names.get("id") else "")
        node = Node(tag, f"{top.path}>{name}" if len(stack) <= DEEPEST else top.path, max(top.skipped, skipped), main, form)
        if tag == "form" and form is None:
            node.form = node
        yield None, node
        if tag in RAW:
            if start in closed or (tag in ("script", "style") and not rest.endswith("/")):
                ended = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = ended.end() if ended else end
        elif tag not in VOID and (tag not in FOREIGN or start in closed):
            stack.append(node)
            is_open[tag] += 1
    if text := flush():
        yield text, stack[-1]


def host_of(url: str = "url") -> F.Column:
    """The host of a URL in lower case, without www.; what has none is of the host of no name."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\[\]\s]*)", 1)
    return F.regexp_replace(F.lower(found), r"^www\.", "")


_SUMS = ("pages", "count", "v1", "v2", "chars")


def token_vectors(pages: DataFrame) -> DataFrame:
    """host, path, pages, count, v1, v2 (the vector's sums), chars, texts (how many differ), named (skipped by name or tag), main, by host and path.

    What holds no text of the page, as scripts, is left out.
    """
    names = ["host", "path", "digest", *_SUMS, "named", "main"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str, int], list[int]] = {}

        def emit() -> pa.RecordBatch:
            rows = list(seen.items())
            seen.clear()
            kinds = [pa.string(), pa.string(), *[pa.int64()] * (len(names) - 2)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(k + tuple(v) for k, v in rows), strict=True), kinds, strict=True)], names)

        for batch in batches:
            for page, url, host, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host")), batch.column("html"), strict=True):
                own: dict[str, list[int]] = {"": [1, 0, -1, 0, 0]}
                for text, node in blocks(html.as_py() or ""):
                    if node.skipped == NO_TEXT:
                        continue
                    found = own.setdefault(node.path, [0, 0, -1, 0, int(node.main)])
                    found[3] |= node.skipped != KEPT
                    if text is None:
                        found[0] += 1
                    else:
                        found[1] += len(text)
                        found[2] = xxhash.xxh3_64_intdigest(text.encode(), found[2] & 0xFFFFFFFF) >> 1
                mark = xxhash.xxh3_64_intdigest(f"{page}/{url}")
                for path, (count, chars, digest, named, main) in own.items():
                    into = seen.setdefault((host, path, digest), [0, 0, 0, 0, 0, named, main])
                    for k, more in enumerate((1, count, (mark >> 33) * count, (mark & 0x7FFFFFFF) * count, chars)):
                        into[k] += more
                    into[5] |= named
                if len(seen) > 50_000:
                    yield emit()
        if seen:
            yield emit()

    rows = in_arrow(pages.select("page_id", "url", host_of().alias("host"), "html"), run, ", ".join(f"{c} {'string' if c in ('host', 'path') else 'long'}" for c in names))
    more = [F.max(c).alias(c) for c in ("named", "main")]
    by_text = rows.groupBy("host", "path", "digest").agg(*(F.sum(c).alias(c) for c in _SUMS), *more)
    return by_text.groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in _SUMS), F.count(F.when(F.col("digest") >= 0, 1)).alias("texts"), *more)


def templates(pages: DataFrame) -> DataFrame:
    """host and fixed, the paths of its template's own text, for each host of SUPPORT pages whose texts vary.

    A token that stands equally often, once or more, on each page of a class belongs to it. A class is valid if all pages of the host
    share it or if texts that no name or tag marks vary within one of its tokens: the class of a layout. A slot of a valid class
    belongs to the template if it has one text on all of its pages or if few texts take turns on them, and if so does all else that
    is told in its container. The host's main slot, by most distinct text among those that no name or tag marks, never does.
    """
    vectors = written(token_vectors(pages), "tokens")
    totals = vectors.filter("path = ''").select("host", F.col("pages").alias("total")).filter(F.col("total") >= SUPPORT)
    told = vectors.filter("chars > 0").join(totals, "host")
    weight = F.col("chars") * F.col("texts") / F.col("pages")
    main = told.filter("named = 0").groupBy("host").agg(F.max_by(F.struct("path", "texts", "pages"), F.struct(weight, "path")).alias("of_main"))
    parts = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ">"))
    around = lambda slots: slots.select("host", F.explode(above).alias("container")).distinct()
    of_class = ["host", "pages", "c1", "c2"]
    varied = around(told.filter("named = 0 and texts > 1"))
    valid = vectors.filter("named = 0 and count = pages").join(varied.withColumnRenamed("container", "path"), ["host", "path"])
    valid = valid.select("host", "pages", F.col("v1").alias("c1"), F.col("v2").alias("c2")).distinct().withColumn("valid", F.lit(True))
    even = F.when((F.col("count") > 0) & (F.col("count") % F.col("pages") == 0), F.expr("count div pages"))
    placed = told.withColumn("c1", F.when(F.col("v1") % even == 0, F.expr("v1 div (count div pages)"))).withColumn("c2", F.when(F.col("v2") % even == 0, F.expr("v2 div (count div pages)"))).join(valid, of_class, "left")
    known = (F.col("pages") >= SUPPORT) & ((F.col("pages") == F.col("total")) | F.coalesce("valid", F.lit(False)))
    turns = (F.col("main") == 0) & (TURNS * F.col("texts") * F.col("of_main.pages") <= F.col("of_main.texts") * F.col("pages"))
    placed = placed.join(main, "host").withColumn("poor", known & ((F.col("texts") == 1) | turns) & (F.col("path") != F.col("of_main.path")))
    rich = around(placed.filter(~F.col("poor")))
    fixed = placed.filter("poor").select("host", "path", F.regexp_replace("path", FLOW, "").alias("container")).join(rich, ["host", "container"], "left_anti")
    fixed = fixed.groupBy("host").agg(F.collect_list("path").alias("fixed"))
    return varied.filter("container = ''").select("host").join(fixed, "host", "left").select("host", F.coalesce("fixed", F.array().cast("array<string>")).alias("fixed"))


def main_text(html: str, fixed: frozenset[str] | None = None) -> str:
    """The blocks of a page's slots, joined by newlines; fixed comes from the host's template, if it has one.

    Where all is the template's, it is told after all; where all is skipped, what names skip is, or else what tags skip.
    """
    found = [(text, node) for text, node in blocks(html) if text is not None and node.skipped < NO_TEXT]
    own = [text for text, node in found if node.skipped == KEPT and fixed is not None and node.path not in fixed]
    told = [(text, node) for text, node in found if node.skipped == KEPT]
    for reason in (BY_NAME, BY_TAG):
        told = told or [(text, node) for text, node in found if node.skipped <= reason]
    return "\n".join(own or [text for text, node in told if node.main] or [text for text, _ in told])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Null or empty html gives an empty text. Rows that repeat are extracted again; a null url is of the host of no name. An empty
    table gives an empty result; other columns are not looked at.
    """
    with scratch() as kept:
        found = written(templates(pages), "templates")
        kept.append(found)
    placed = pages.select("page_id", "url", "html", host_of().alias("host")).join(found, "host", "left").select("page_id", "url", "html", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", None if f is None else frozenset(f)) for h, f in zip(batch.column("html"), batch.column("fixed").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return in_arrow(placed, run, f"page_id {kind}, url string, text string, n_chars long")


def op10_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null or empty html gives an empty text; rows that repeat are rows of their own; an empty table gives no row."""
    return extracted(table(spark, sf_dir, "pages"))
