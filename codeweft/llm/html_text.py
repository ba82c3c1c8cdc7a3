"""Main text of web pages by structure and by site template removal.

A page is parsed into a tree; every element subtree has a hash of its tag, its text and its children. Subtrees outside the
article (and containers inside it) are counted per host, in distinct pages (pages of equal text before this removal are one, however
often they are repeated and under whatever url); those on many pages of a host are that site's template and are deleted, together with what markup names as navigation, header, footer, sidebar, notice, advert, form, script,
style or reader comments. What is left of the article is written block by block.

Pages that differ in a headline or a date only are different pages, and what they share is no template but their story. So an
article never loses half of its text or more to templates: then it keeps all of it. A page without an article keeps a subtree of
running text that is half of the page, unless half of the host's pages hold it. Neither guards less than FEW_WORDS words.

Copies are merged inside each task before (host, hash, text) shuffles, and counts before (host, hash) does, so a host with a third
of all pages is spread over tasks by its subtrees and pages. Templates go back to the pages as a broadcast only if they measure small; otherwise pages join them by host,
which adaptive execution can split. Pages are parsed twice, which is cheaper than shuffling them.

Defined results: null and empty pages have no text; broken markup is closed as browsers do; a page without article or main
element is its whole body without the deleted parts; pages without host have no template; repeated rows each get their text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.url_rules import host_of
from codeweft.llm.words import kept_names
from codeweft.llm.words import kept_names
from codeweft.session import cut

#: A subtree is template from so many pages of a host on, if they are also this share of the host's pages.
LEAST_PAGES = 4
LEAST_SHARE = 0.2
#: Containers outside articles are template from so many pages on, whatever their share of the host's pages is.
MANY_PAGES = 50
#: A subtree on this share of a host's pages is template even if it is most of a page without an article.
SURE_SHARE = 0.5
#: Less than that is a box, not a story.
FEW_WORDS = 8
#: Template subtrees that may be broadcast (8 bytes each and a host's name).
BROADCAST_ROWS = 500_000
#: Levels of nesting kept, as browsers keep some hundreds; no text is lost by it.
DEEPEST = 256

#: Element kinds of HTML, and the words by which class, id and role name what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("html body caption tbody td tfoot th thead tr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead caption figcaption summary b i em strong a span code br img".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input label map menu nav noscript object option script select style svg template textarea title video".split()
)
NAMED = frozenset(
    "ad ads adv advert advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice overlay pagination paywall popup promo promoted related replies search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that may stand beside one of the former in a name of the same meaning: ``site-header``, ``share-buttons``.
BESIDE = frozenset(
    "area bar block bottom box button buttons container desktop fixed global group holder icon icons inner item items left link links list lower main mobile page panel primary right row "
    "secondary section side site sticky top unit upper wrap wrapper zone".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Which open elements a start tag closes, up to which enclosing one.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(page: str) -> Element:
    root = Element("#page")
    stack, at = [root], 0
    while True:
        found = _TAG.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at:
            stack[-1].children.append(page[at:stop])
        if not found:
            return root
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            _close(stack, tag)
            continue
        if tag in ENDS_PARAGRAPH:
            _end_open(stack, {"p"}, {"button", "table", "td", "th", "caption", "article", "section", "div"} - {tag})
        if tag in CLOSES:
            _end_open(stack, *CLOSES[tag])
        element = Element(tag, found[3])
        stack[-1].children.append(element)
        if tag in VOID or found[3].endswith("/") and tag in ("path", "use"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        # As in browsers, what is nested deeper lies side by side.
        if len(stack) < DEEPEST:
            stack.append(element)


def _end_open(stack: list[Element], closes: set[str], until: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in closes:
            del stack[i:]
            # Rows hold cells and sections hold rows: one end may close several.
            if closes & {e.tag for e in stack[1:]} and stack[-1].tag in closes:
                _end_open(stack, closes, until)
            return
        if stack[i].tag in until:
            return


def _close(stack: list[Element], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        # An inline end tag does not close the block around it.
        if stack[i].tag in BLOCK and tag not in BLOCK:
            return


def _named_away(element: Element, in_article: bool) -> bool:
    """Whether markup says that this is not the article's text."""
    if element.tag in DROPPED:
        return True
    if element.tag == "header":
        return not (in_article and _has_heading(element))
    if not element.attributes or element.tag in ("html", "body", "article", "main"):
        return element.tag == "article" and in_article and any({"comment", "comments", "reply"} & set(parts) for parts in _names(element))
    for name, *values in _ATTRIBUTE.findall(element.attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and set(value.split()) & ROLES:
            return True
    for parts in _names(element):
        if set(parts) & NAMED and set(parts) <= NAMED | BESIDE:
            return True
        # ``share-price`` may be anything; it is what its first or last word says if it is a list of links.
        if (parts[0] in NAMED or parts[-1] in NAMED) and _linked(element):
            return True
    return False


def _names(element: Element) -> list[list[str]]:
    """The words of every class and id; a name that describes the layout of content (``has-sidebar``) is none."""
    out = []
    for name, *values in _ATTRIBUTE.findall(element.attributes):
        if name.lower() in ("class", "id"):
            for value in "".join(values).split():
                parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())
                if parts and parts[0] not in ("has", "with", "no", "without", "is"):
                    out.append(parts)
    return out


def _linked(element: Element) -> bool:
    """Whether most words are those of links."""
    words, links = _sizes(element)
    return words > 0 and 2 * links >= words


def _sizes(element: Element, link: bool = False) -> tuple[int, int]:
    """Number of words, and of those in links."""
    words = links = 0
    for child in element.children:
        if isinstance(child, str):
            n = len(child.split())
            words, links = words + n, links + (n if link else 0)
        else:
            a, b = _sizes(child, link or child.tag == "a")
            words, links = words + a, links + b
    return words, links


def _has_heading(element: Element) -> bool:
    return any(not isinstance(c, str) and (re.fullmatch("h[1-6]", c.tag) or _has_heading(c)) for c in element.children)


def _articles(element: Element, tags: tuple[str, ...]) -> list[Element]:
    out = []
    for child in element.children:
        if isinstance(child, str) or _named_away(child, False):
            continue
        if child.tag in tags or "main" in tags and re.search(r"\brole\s*=\s*[\"']?main\b", child.attributes):
            out.append(child)
        else:
            out.extend(_articles(child, tags))
    return out


def main_parts(root: Element) -> list[Element]:
    """The article elements (not inside one another), else the main ones, else the page."""
    return _articles(root, ("article",)) or _articles(root, ("main",)) or [root]


def subtree_hashes(root: Element) -> dict[int, int]:
    """Hash of every subtree that template removal may delete, by ``id`` of the element.

    Outside the article any element; inside it only containers, since a paragraph that recurs on other pages is still text.
    The lowest bit tells containers outside of articles.
    """
    parts = {id(p) for p in main_parts(root) if p is not root}
    out: dict[int, int] = {}

    def walk(element: Element, inside: bool) -> tuple[str, bool]:
        pieces, holds = [element.tag], id(element) in parts
        for child in element.children:
            if isinstance(child, str):
                pieces.append(" ".join(child.split()))
            else:
                inner, held = walk(child, inside or id(element) in parts)
                pieces.append(inner)
                holds |= held
        name = xxhash.xxh64_intdigest("\x00".join(pieces))
        free = not (inside and element.tag in TEXT_BLOCKS) and element.tag not in ("#page", "html", "head", "body", "main", "article")
        if free and not holds:
            out[id(element)] = (name & ~1 | (not inside and element.tag not in TEXT_BLOCKS)) - (1 << 63)
        return format(name, "x"), holds

    walk(root, False)
    return out


def _deleted(part: Element, hashes: dict[int, int], template: frozenset | set, sure: frozenset | set) -> set[int]:
    """Which subtrees of an article, or of a page without one, are template (by ``id``); see above for what is kept."""
    article = part.tag != "#page"
    hits: list[tuple[Element, int, int]] = []

    def walk(element: Element) -> int:
        """Words of what is not named away, template included."""
        words = 0
        for child in element.children:
            if isinstance(child, str):
                words += len(child.split())
            elif not _named_away(child, article):
                if hashes.get(id(child)) in template:
                    sizes = _sizes(child)
                    hits.append((child, *sizes))
                    words += sizes[0]
                else:
                    words += walk(child)
        return words

    total = walk(part)
    if article:
        gone = sum(words for _, words, _ in hits)
        return set() if gone >= FEW_WORDS and 2 * gone >= total else {id(e) for e, _, _ in hits}
    return {id(e) for e, words, links in hits if hashes[id(e)] in sure or words < FEW_WORDS or 2 * words < total or 2 * links >= words}


def main_text(root: Element, template: frozenset | set = frozenset(), sure: frozenset | set = frozenset()) -> str:
    parts = main_parts(root)
    hashes = subtree_hashes(root) if template else {}
    deleted = set().union(*(_deleted(part, hashes, template, sure) for part in parts)) if template else set()
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    def walk(element: Element, in_article: bool) -> None:
        for child in element.children:
            if isinstance(child, str):
                run.append(child)
            elif child.tag == "br":
                run.append(" ")
            elif child.tag == "img" or _named_away(child, in_article) or id(child) in deleted:
                if child.tag in BLOCK:
                    flush()
            elif child.tag in BLOCK:
                flush()
                walk(child, in_article)
                flush()
            else:
                walk(child, in_article)

    for part in parts:
        flush()
        walk(part, part.tag != "#page")
        flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` without ``html_col``, with ``main_text`` (in place of a column of that name)."""
    kept = [c for c in kept_names(pages, "main_text") if c != html_col]
    rows = pages.select(F.struct(*[pages[c] for c in kept]).alias("row"), host_of(pages[url_col]).alias("host"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("page"))
    # What a host's pages hold, once for every different page: its copies add nothing.
    counted = rows.select("host", "page").mapInArrow(_count, "host string, hash long, text long").distinct()
    sums = counted.groupBy("host", "hash").agg(F.count("*").alias("n"))
    sums = cut(sums.filter(F.col("hash").isNull() | (F.col("n") >= LEAST_PAGES)))
    totals = sums.filter("hash is null").select("host", F.col("n").alias("pages"))
    many = (F.col("n") >= MANY_PAGES) & (F.col("hash").bitwiseAND(F.lit(1)) == 1)
    template = cut(sums.filter("hash is not null").join(totals, "host").filter((F.col("n") >= F.col("pages") * LEAST_SHARE) | many).select("host", "hash", (F.col("n") >= F.col("pages") * SURE_SHARE).alias("sure")))
    schema = rows.select("row").schema.add("text", "string")
    if template.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found: dict[str, tuple[set, set]] = {}
        for host, hash_, sure in template.toLocalIterator():
            own = found.setdefault(host, (set(), set()))
            for kept_ in own if sure else own[:1]:
                kept_.add(hash_)
        shared = rows.sparkSession.sparkContext.broadcast(found)
        done = rows.mapInArrow(lambda it: _extract(it, shared), schema)
    else:
        lists = template.groupBy("host").agg(F.collect_list("hash").alias("hashes"), F.collect_list(F.when(F.col("sure"), F.col("hash"))).alias("sure"))
        done = rows.join(lists, "host", "left").mapInArrow(lambda it: _extract(it, None), schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("text").alias("main_text"))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple] = set()
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if host:
                root = parse(page)
                text = xxhash.xxh64_intdigest(main_text(root)) - (1 << 63)
                seen.add((host, None, text))
                seen.update((host, h, text) for h in subtree_hashes(root).values())
            if len(seen) > 1 << 18:
                yield _rows(seen)
                seen.clear()
    yield _rows(seen)


def _rows(seen: set[tuple]) -> pa.RecordBatch:
    columns = list(zip(*seen, strict=True)) or [(), (), ()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "hash", "text"])


def _extract(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    for batch in batches:
        hosts, pages = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "page"))
        if shared:
            own = [shared.value.get(h, (frozenset(), frozenset())) for h in hosts]
        else:
            lists = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hashes", "sure"))
            own = [(frozenset(x or ()), frozenset(y or ())) for x, y in zip(*lists, strict=True)]
        texts = [main_text(parse(p), *t) for p, t in zip(pages, own, strict=True)]
        yield pa.record_batch([batch.column(batch.schema.get_field_index("row")), pa.array(texts, pa.string())], ["row", "text"])
