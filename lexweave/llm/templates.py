"""The main text of web pages, by deducing each host's template from the pages of the host.

A token is an element by its path, or a stretch of text at a path. Tokens of a host whose numbers of
occurrences are the same in every page (one occurrence vector) form a class. A class is valid if it
occurs in at least half of the host's pages and has two tokens or more; its elements, which are
nested by their paths, are the template, and its texts are the template's own words, the same on all
those pages. What is left between them are slots. The slot that holds most of the host's prose is
the article; a page that hasn't got that slot, or whose host shows no template, is judged by its own
elements. The roles that markup states (navigation, forms, comments and so on) are never prose.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, released, slices
from .urls import url_host

#: A slot or element holds the article if it has this share of the prose.
SHARE = 0.6
#: A text is the template's if it is on at least this many pages of the host.
LEAST_PAGES = 3
#: Where more of a host's prose than this is the same on half of its pages, its pages are copies, and nothing of them is a template's.
MOST_FIXED = 0.3
#: Templates of all hosts up to this many bytes are sent to all tasks; larger ones are joined by host.
MOST_SENT = 32 << 20
#: Tokens that a task holds before it passes their counts on.
MOST_HELD = 100_000

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
NOT_PROSE = frozenset("aside button canvas datalist dialog fieldset footer form head iframe input menu nav noscript object option search select style script svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption details summary address hgroup".split())
CLOSED_BY = {"li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("table", "tr"))), "th": ("td th", frozenset(("table", "tr"))), "option": ("option", frozenset(("select",)))}
# Words in class and id that state a role other than the article's.
HINTS = re.compile(
    r"(?:^|[^a-z])(?:ads?|adbox|adslot|adunit|adv|nav|menu|topbar|header|masthead|banner|side|aside|rail|widgets?|promos?|sponsor(?:ed|s)?|cookies?|consent|gdpr|notices?|alerts?|toast|popup|modal|overlay|signup|login|search|share|sharing|social|related|recommended|respond|reply|replies|discussion|feedback|pager|pagination|copyright|legal|disclaimer|skip|hidden)(?:[^a-z]|$)"
    r"|navbar|navigation|breadcrumb|sidebar|footer|advert|newsletter|subscri|comment(?!ar)|disqus"
)
COMMENT_HINTS = re.compile(r"comment(?!ar)|repl(?:y|ies)")
#: Where a class has one of these words too, a header is the article's own.
OWN_HEADER = re.compile(r"article|post|entry|story|content|title")

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
#: A page's own number in a class or id, which doesn't tell elements of a template apart.
_NUMBER = re.compile(r"\d{3,}")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What a class says that an element stands beside, not that it is it.
_BESIDE = re.compile(r"\b(?:with|without|has|no|show|hide)[-_][a-z]+(?:[-_](?:open|visible|hidden|active|left|right))?|\b[a-z]+[-_](?:open|visible|active)\b")


class Element(NamedTuple):
    """An open element: its name, whether it is a block, its path, whether its text is prose, and the path of the outermost article or main it is in."""

    name: str
    block: bool
    path: str
    prose: bool
    inside: str


class Block(NamedTuple):
    """A block's text, with its path (that of the element), and how much of it is in links."""

    path: str
    name: str
    text: str
    linked: int
    inside: str


class Page(NamedTuple):
    """The blocks of a page that may be prose, and the paths of all block elements in order, with whether each can hold an article and the article or main it is in."""

    blocks: list[Block]
    elements: list[tuple[str, bool, str]]


@functools.lru_cache(maxsize=4096)
def _key_and_role(name: str, attributes: str, by_class: bool) -> tuple[str, bool, bool]:
    """An element's part of a path; whether its text is prose, by its name and roles and, if asked, its class; whether it is a header of its page, which an article's own isn't."""
    held = {}
    for k, a, b, c, flag in _ATTRIBUTE.findall(attributes):
        held.setdefault((k or flag).lower(), html.unescape(a or b or c))
    names = f"{held.get('class', '')} {held.get('id', '')}"
    key = name
    if name not in ("html", "body"):
        key += "".join("." + _NUMBER.sub("#", x) for x in sorted(held.get("class", "").split()))
        key += "@" + _NUMBER.sub("#", held["id"]) if held.get("id") else ""
    if held.get("role", "").lower() == "main" and name not in ("main", "article"):
        key += "[main]"
    words = _BESIDE.sub(" ", _CAMEL.sub("-", names).lower())
    if name in ("html", "body", "main") or not by_class:
        hinted = False
    elif name == "article":
        hinted = bool(COMMENT_HINTS.search(words))
    else:
        hints = HINTS.sub(lambda m: m.group() if "header" not in m.group() else " ", words)
        hinted = bool(HINTS.search(hints)) or ("header" in words and not OWN_HEADER.search(words))
    hidden = "hidden" in held or held.get("aria-hidden", "").lower() == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
    no_prose = name in NOT_PROSE or hinted or hidden or held.get("role", "").lower() in ROLES
    return key.replace("/", ""), not no_prose, name == "header"


def parse(source: str, by_class: bool = True) -> Page:
    """The blocks and elements of a page. Tags that are missing, doubled or crossed are taken as browsers take them, as far as blocks go. A page whose classes leave no prose is taken without them."""
    page = _parse(source, by_class)
    return page if page.blocks or not by_class else _parse(source, False)


def _parse(source: str, by_class: bool) -> Page:
    stack = [Element("", True, "", True, "")]
    blocks: list[Block] = []
    elements: list[tuple[str, bool, str]] = []
    parts: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                e = next(e for e in reversed(stack) if e.block)
                blocks.append(Block(e.path, e.name, text, linked, e.inside))
            parts.clear()
        linked = 0

    def close_to(k: int) -> None:
        if any(e.block for e in stack[k:]):
            end_block()
        del stack[k:]

    def add(text: str) -> None:
        nonlocal linked
        if text and stack[-1].prose:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if any(e.name == "a" for e in stack[-3:]):
                linked += len(text)

    def close_open(names: tuple[str, ...] | list[str], scope: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                return close_to(k)
            if stack[k].name in scope:
                return None
        return None

    at = 0
    while (m := _TAG.search(source, at)) is not None:
        add(source[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if k and not (name in INLINE and any(e.block for e in stack[k + 1 :])):
                close_to(k)
            continue
        if name in VOID:
            if name == "br":
                add(" ")
            elif name == "hr":
                end_block()
            continue
        block = name not in INLINE
        if name in CLOSES_P:
            close_open(("p",), frozenset(("button", "table", "td", "th", "object")))
            if name[0] == "h" and name[1:].isdigit() and stack[-1].name[:1] == "h" and stack[-1].name[1:].isdigit():
                close_to(len(stack) - 1)
        if name in CLOSED_BY:
            closed, scope = CLOSED_BY[name]
            close_open(closed.split(), scope)
        if block:
            end_block()
        key, prose, header = _key_and_role(name, m.group(3), by_class)
        over = stack[-1]
        # an article in a menu or header, or a main part anywhere but in code, is there since a tag hasn't been closed
        astray = not over.prose and (name == "main" or (name == "article" and next(e.name for e in stack if not e.prose) in ("nav", "header", "menu")))
        prose = (over.prose or astray) and prose and not (header and not over.inside)
        path = f"{over.path}/{key}" if block else over.path
        inside = over.inside or (path if prose and block and (name in ("article", "main") or key.endswith("[main]")) else "")
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else len(source)
        if block:
            elements.append((path, prose and name not in TEXT_BLOCKS, inside if prose else ""))
        stack.append(Element(name, block, path, prose, inside))
    add(source[at:])
    end_block()
    return Page(blocks, elements)


def holds(container: str, path: str) -> bool:
    return path == container or path.startswith(container + "/")


def prose_chars(page: Page) -> dict[str, int]:
    """The characters of prose outside links below each path; "" is the whole page."""
    out: dict[str, int] = {"": 0}
    for b in page.blocks:
        n = max(0, len(b.text) - b.linked)
        path = b.path
        while path:
            out[path] = out.get(path, 0) + n
            path = path.rpartition("/")[0]
        out[""] += n
    return out


def own_container(page: Page) -> str:
    """The element that holds the article by the page alone: the article or main with most prose, or else the deepest that has SHARE of it."""
    chars = prose_chars(page)
    named = {inside for _, _, inside in page.elements if inside and chars.get(inside)}
    if named:
        return max(named, key=lambda p: (chars[p], p))
    able = {p for p, ok, _ in page.elements if ok and chars.get(p, 0) > 0 and chars[p] >= SHARE * chars[""]}
    return max(able, key=lambda p: (p.count("/"), chars[p], p), default="")


def text_of(page: Page, container: str, fixed: set[int]) -> str:
    """The blocks of prose below container, and a heading h1 beside it that comes first, without the template's own texts, one a line."""
    inner = [k for k, b in enumerate(page.blocks) if holds(container, b.path)]
    first = inner[0] if inner else 0
    titles = [k for k, b in enumerate(page.blocks[:first]) if b.name == "h1" and holds(b.path.rpartition("/")[0], container)]
    kept = (page.blocks[k] for k in titles + inner)
    return "\n".join(b.text for b in kept if not fixed or run_token(b.path, b.text) not in fixed)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def element_token(path: str) -> int:
    return _signed(xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass"), 1))


def run_token(path: str, text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass"), 2))


def page_tokens(source: str, url: str) -> dict[int, list]:
    """token -> [pages, vector, chars, depth, kind]: what one page adds to its host's counts. kind: 0 the page itself, 1 element, 2 element that can hold an article, 3 an outermost article or main, 4 text."""
    page = parse(source)
    chars, counts = prose_chars(page), {"": [1, 0]}
    named = {inside for _, _, inside in page.elements if inside and chars.get(inside)}
    for path, able, _ in page.elements:
        held = counts.setdefault(path, [0, 1])
        held[0] += 1
        held[1] = max(held[1], 3 if path in named else 2 if able else 1)
    seed = xxhash.xxh64_intdigest(url.encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass")))
    mark = lambda n: _signed(xxhash.xxh64_intdigest(n.to_bytes(4, "little"), seed))
    out = {element_token(p): [1, mark(n), chars.get(p, 0), p.count("/"), kind] for p, (n, kind) in counts.items()}
    texts: dict[int, list] = {}
    for b in page.blocks:
        held = texts.setdefault(run_token(b.path, b.text), [0, len(b.text)])
        held[0] += 1
    for token, (n, size) in texts.items():
        out[token] = [1, mark(n), n * size, 0, 4]
    return out


_COUNTS = "host string, token long, pages long, vector long, chars long, depth int, kind int"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of page_tokens by host, summed over what a task has read so far."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def packed() -> pa.RecordBatch:
        rows = list(held.items())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), *(pa.array([x[c] for _, x in rows], t) for c, t in enumerate(types))], ["host", "token", "pages", "vector", "chars", "depth", "kind"])

    held: dict[tuple[str, int], list] = {}
    for batch in batches:
        for host, url, source in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            for token, new in page_tokens(source or "", url or "").items():
                old = held.get((host, token))
                if old is None:
                    held[host, token] = new
                else:
                    old[0] += 1
                    old[1] ^= new[1]
                    old[2] += new[2]
                    old[4] = max(old[4], new[4])
            if len(held) > MOST_HELD:
                yield packed()
                held.clear()
    if held:
        yield packed()


def deduce_templates(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, container, fixed) for every host: the token of the slot that holds the article (null if none stands out) and those of the template's own texts (array).

    Occurrence vectors are compared by the exclusive or of a 64-bit hash of each page and the
    token's number in it, so counting combines before the shuffle, and no task holds a host's pages.
    A row that is repeated cancels out in all vectors of its host alike.
    """
    rows = pages.select(url_host(pages[url_column]).alias("host"), pages[url_column].alias("url"), pages[html_column].alias("html"))
    tokens = rows.mapInArrow(released(_count), _COUNTS).groupBy("host", "token")
    tokens = tokens.agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("chars").alias("chars"), F.max("depth").alias("depth"), F.max("kind").alias("kind"))
    tokens = checkpointed(tokens.where(f"kind < 4 or pages >= {LEAST_PAGES}"))
    hosts = tokens.where("kind = 0").select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    frequent = checkpointed(tokens.where("kind > 0").join(hosts, "host").where("2 * pages >= all_pages"))
    classes = frequent.groupBy("host", "vector").count().where("count >= 2").drop("count")
    valid = frequent.join(classes, ["host", "vector"])
    named = F.max(F.when(F.expr("kind = 3 and chars > 0"), F.struct("chars", "token")))
    able = F.max(F.when((F.col("kind").isin(2, 3)) & (F.col("chars") > 0) & (F.col("chars") >= SHARE * F.col("all_chars")), F.struct("depth", "chars", "token")))
    slots = valid.where("kind < 4").groupBy("host").agg(F.coalesce(named["token"], able["token"]).alias("container"))
    # in half of the host's pages each: twice a page's texts at most
    own = valid.where("kind = 4").groupBy("host").agg(F.collect_list("token").alias("fixed"), F.sum("chars").alias("fixed_chars"), F.max("all_chars").alias("all_chars"))
    own = own.where(F.col("fixed_chars") <= MOST_FIXED * F.col("all_chars")).select("host", "fixed")
    return hosts.select("host").join(slots, "host", "left").join(own, "host", "left")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end in slices(batch.column(2)):
            part = batch.slice(start, end - start)
            texts = []
            for source, container, fixed in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                page = parse(source or "")
                path = next((p for p, _, _ in page.elements if element_token(p) == container), None) if container is not None else None
                if path is None or not any(holds(path, b.path) for b in page.blocks):
                    path = own_container(page)
                texts.append(text_of(page, path, set(fixed or ())).encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "url", "text"])


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text) for every row of pages: the article's text, a block a line.

    A null or empty page has an empty text, as has one without prose. A null url, or one without
    ://, has the empty host, whose pages are taken together like any other's. Repeated rows stay and
    get the same text; further columns are not read, whatever their names. A page is worked on whole,
    whatever its length, and tags that are never closed end with the page. Equal shares go to the
    larger hash. No rows give no rows.
    """
    kind = pages.schema[id_column].dataType.simpleString()
    templates = checkpointed(deduce_templates(pages, url_column, html_column).where("container is not null or fixed is not null"))
    size = templates.agg(F.sum(F.length("host") + 40 + 8 * F.coalesce(F.size("fixed"), F.lit(0)))).first()[0] or 0
    rows = pages.select(pages[id_column].alias("id"), pages[url_column].alias("url"), pages[html_column].alias("html"), url_host(pages[url_column]).alias("host"))
    sent = F.broadcast(templates) if size <= MOST_SENT else templates
    rows = rows.join(sent, "host", "left").select("id", "url", "html", "container", "fixed")
    return rows.mapInArrow(released(_extract), f"id {kind}, url string, text string").withColumnRenamed("id", id_column).withColumnRenamed("url", url_column)
