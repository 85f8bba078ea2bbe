"""HTML extraction by equivalence-class template deduction.

A page's tokens are its elements, told apart by their path from the root (tags with all their classes and their id),
and the texts they hold. A token's occurrence vector has its count on every page of the host; vectors are compared through
an order-free sum of hashes (page and count), so no list of pages is ever gathered. Tokens with equal vectors form a class.
Classes whose tokens stand once on each of their pages, on at least half (`FREQUENT`) of the host's pages, are valid:
nested by path they are the host's template, and what lies between their tokens are its slots.

The slots' content decides what is extracted, no name does. The inner text of every template element is compared across
pages: where it has few different values the slot is boilerplate. The article's element is the deepest that holds most
(`MOST`) of the text that varies, widened to the parts before it, to varying parts behind it whose text is in elements like the article's
(closing sections), and to an `article` or `main` element around it. Of what is
inside, template elements whose text does not vary, small lists that every page has behind the main text (repeated parts that have
parts themselves, as reader comments do, or mostly links), and blocks of texts that stand at one place on all pages belong to the template.
All else is the page's text. Elements that HTML sets apart (menus, footers, scripts) have none; a form, and comments and side parts by
their usual class or id (`BESIDE`), are apart unless they hold most of the page's text and no `article` or `main` stands outside.

Copies of a page count once. Two passes over the pages: one sends each token's counts, summed before and after the shuffle; the other reads the
templates, which are broadcast up to a size that is checked and joined by salted host beyond it. Paths are 64-bit
hashes chained from the root, so depth is not bounded and every step is constant work.

Defined results: a null or empty page has an empty text; a page without markup is one block; a null or odd url is a
host of its own (the empty one); a page that lacks its host's article element, and a host with fewer than `LEAST` different
pages, are read by HTML's own elements: `article` or `main`, else the body, without navigation, forms and the like;
comments, scripts and styles hold no text; unclosed elements end with their parent or where HTML ends them; a tag whose
quote or bracket never closes ends at the next bracket, or is text; repeated pages get the same text; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Elements within a block; all others, unknown ones too, start and end a block of text.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br button canvas cite code data datalist del dfn em embed font i img input ins kbd label map mark meter nobr object output "
    "picture progress q rb rp rt rtc ruby s samp script select slot small source span strike strong style sub sup svg template time track tt u var video wbr".split()
)
#: Elements that end an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p "
    "pre search section summary table ul li dt dd".split()
)
#: Elements that an opening tag ends, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Elements that by HTML's own meaning hold no article text.
APART = frozenset("nav footer aside script style noscript template iframe svg button select textarea menu dialog head title object canvas input".split())
#: Reader comments and side parts by whole class or id. They and forms are apart, unless one holds most of the page's text (see `read`).
BESIDE = frozenset(
    "comment comments comment-list commentlist comment-section comments-section comments-area disqus_thread replies sidebar advert adverts ads newsletter related-posts cookie-notice".split()
)
#: Elements whose repetition makes no list of remarks: parts of tables and lists.
ROWS = frozenset("table tr td th tbody thead tfoot ul ol dl li dt dd figure blockquote p".split())
#: Share of a host's pages that makes a token frequent; share of the varying text that the article's element holds; different
#: texts a page from which a slot varies; different pages from which a host has a template, and from which its parts are dropped.
FREQUENT, MOST, VARIES, LEAST, ENOUGH = 0.5, 0.6, 0.3, 3, 6
#: A part behind the main text is small below this share of the article's text.
SMALL = 0.25
#: Bytes of all templates up to which they are broadcast; parts that each host is dealt to beyond it.
BROADCAST_BYTES, SALT = 32 << 20, 32
#: Groups of copies up to which their hashes are broadcast.
COPIES = 500_000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTES = re.compile(r"""[\s/"'](class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_STOP = re.compile(r"[>\"']")
_hash = xxhash.xxh64_intdigest


class Element:
    __slots__ = ("apart", "hard", "link", "path", "soft", "step", "tag")

    def __init__(self, tag: str, path: int, step: str, apart: bool, link: bool, soft: int = -1, hard: bool = False):
        self.tag, self.path, self.step, self.apart, self.link = tag, path, step, apart, link
        self.soft, self.hard = soft, hard  # the innermost form or part beside the text that it is in (or is); apart by its own meaning


class Soft:
    """The forms and parts beside the text of a page: how much of its text each holds."""

    __slots__ = ("around", "outside", "sizes", "total")

    def __init__(self):
        self.around, self.sizes, self.total, self.outside = [], [], 0, False

    def main(self) -> frozenset[int]:
        """Those that hold most of the text, if no `article` or `main` element stands outside."""
        return frozenset() if self.outside else frozenset(k for k, n in enumerate(self.sizes) if 2 * n > self.total)


class Tags:
    """Where tags end: quotes are respected if they and the tag close, in linear time over the page."""

    def __init__(self, html: str):
        self.html, self.failed, self.closed = html, set(), html.rfind(">")

    def end(self, at: int) -> int:
        """The place behind the tag that starts there, or -1: no bracket follows."""
        if at > self.closed:
            return -1
        html, seen, place = self.html, [], at
        while True:
            m = _STOP.search(html, place)
            if m is None:
                break
            if m.group() == ">":
                return m.end()
            if m.start() in self.failed:
                break
            seen.append(m.start())
            place = html.find(m.group(), m.end()) + 1
            if not place:
                break
        self.failed.update(seen)  # no scan from these quotes closes a tag
        return html.find(">", at) + 1 or -1


def events(html: str, soft: Soft, main: frozenset[int] = frozenset()):
    """(kind, element, text) in page order: open and close of elements, text within them; main: soft elements that are not apart."""
    root = Element("", 0, "", False, False)
    stack, open_at, tags = [root], defaultdict(list), Tags(html)
    inner_block = [0]  # by depth: the place of the nearest element that is no inline one
    at, n = 0, len(html)

    def pop():
        element = stack.pop()
        inner_block.pop()
        open_at[element.tag].pop()
        return "close", element, ""

    def last(names) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    while at < n:
        start = html.find("<", at)
        if start != at:
            element, text = stack[-1], html[at : start if start >= 0 else n]
            if not element.hard:
                size = len(text.strip())
                soft.total += size
                k = element.soft
                while k >= 0:
                    soft.sizes[k] += size
                    k = soft.around[k]
            yield "text", element, text
            if start < 0:
                break
        mark = html[start + 1 : start + 2]
        if mark in ("!", "?") and mark:
            closing = "-->" if html.startswith("<!--", start) else "]]>" if html.startswith("<![CDATA[", start) else ">"
            end = html.find(closing, start + 2)
            at = end + len(closing) if end >= 0 else n
            continue
        name = _NAME.match(html, start + 1 + (mark == "/"))
        end = tags.end(name.end()) if name else -1
        if end < 0:
            yield "text", stack[-1], "<"
            at = start + 1
            continue
        at, tag = end, name.group().lower()
        if mark == "/":
            if open_at.get(tag):
                while stack[-1].tag != tag:
                    yield pop()
                yield pop()
            elif tag not in INLINE:
                yield "close", Element(tag, 0, tag, False, False), ""
            continue
        if tag in CLOSES_P and stack[inner_block[-1]].tag == "p":
            for _ in range(len(stack) - inner_block[-1]):
                yield pop()
        if tag in ENDS:
            ends, until = ENDS[tag]
            k = last(ends)
            if k > last(until):
                for _ in range(len(stack) - k):
                    yield pop()
        parent = stack[-1]
        names = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTES.findall(html, name.end(), end)} if end - name.end() > 5 else {}
        step = " ".join([tag, *sorted(set(names.get("class", "").split())), *(["#" + names["id"]] if names.get("id") else [])])
        hard = parent.hard or tag in APART
        element = Element(tag, _hash(step.encode(), parent.path), step, parent.apart or hard, parent.link or tag == "a", parent.soft, hard)
        if tag == "form" or names and (names.get("id") in BESIDE or not BESIDE.isdisjoint(names.get("class", "").lower().split())):
            element.soft = len(soft.sizes)
            soft.sizes.append(0)
            soft.around.append(parent.soft)
            element.apart = element.apart or element.soft not in main
        elif element.soft < 0 and (tag == "article" or tag == "main"):
            soft.outside = True
        yield "open", element, ""
        if tag in VOID or html[end - 2] == "/" and tag in INLINE:
            yield "close", element, ""
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            yield "close", element, ""
            at = closing.end() if closing else n
            continue
        open_at[tag].append(len(stack))
        inner_block.append(inner_block[-1] if tag in INLINE else len(stack))
        stack.append(element)
    while len(stack) > 1:
        yield pop()


def read(html: str, take):
    """What take makes of the page's events. Forms and parts beside the text are apart, but for one that holds most of the page's text.

    (A page may stand in a form as a whole.) Such pages are few, and read a second time.
    """
    soft = Soft()
    found = take(events(html, soft))
    main = soft.main()
    return take(events(html, Soft(), main)) if main else found


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\\]*)", url or "")
    return m.group(1).rpartition("@")[2].lower() if m else ""


class Seen:
    """A page's elements of one path: count, first place, parent, tag, inner text (size, size in links, place-weighted, hash)."""

    __slots__ = ("apart", "count", "hash", "link", "parent", "place", "size", "tag", "weight")

    def __init__(self, place: int, parent: int, element: Element):
        self.count, self.place, self.parent, self.tag, self.apart = 0, place, parent, element.tag, element.apart
        self.size = self.link = self.weight = self.hash = 0


def page_tokens(html: str) -> tuple[dict[int, Seen], dict[tuple[int, int], int]]:
    """A page's paths with their inner text, and its texts' sizes by (path, hash)."""
    return read(html, _tokens)


def _tokens(page) -> tuple[dict[int, Seen], dict[tuple[int, int], int]]:
    paths: dict[int, Seen] = {0: Seen(0, 0, Element("", 0, "", False, False))}
    paths[0].count = 1
    texts: dict[tuple[int, int], int] = {}
    # Inner text is summed up as elements close: one frame an open element.
    frames = [[0, 0, 0, 0, 0]]

    def close():
        path, size, link, weight, digest = frames.pop()
        seen = paths[path]
        seen.size += size
        seen.link += link
        seen.weight += weight
        seen.hash = _hash(digest.to_bytes(8, "little"), seen.hash)
        outer = frames[-1] if frames else None
        if outer is not None:
            outer[1] += size
            outer[2] += link
            outer[3] += weight
            outer[4] = _hash(digest.to_bytes(8, "little"), outer[4])

    for place, (kind, element, text) in enumerate(page, 1):
        if kind == "open":
            seen = paths.get(element.path)
            if seen is None:
                seen = paths[element.path] = Seen(place, frames[-1][0], element)
            seen.count += 1
            frames.append([element.path, 0, 0, 0, 0])
        elif kind == "close":
            if frames[-1][0] == element.path and len(frames) > 1:
                close()
        elif not text.isspace():
            own = " ".join(text.split()).encode()
            frame, digest = frames[-1], _hash(own)
            frame[1] += len(text)
            frame[2] += len(text) * element.link
            frame[3] += len(text) * place
            frame[4] = _hash(digest.to_bytes(8, "little"), frame[4])
            texts[element.path, digest] = len(text)
    while frames:
        close()
    return paths, texts


TOKENS = (
    "host string, path bigint, value bigint, parent bigint, tag string, apart boolean, pages bigint, total bigint, vector bigint, "
    "place bigint, size bigint, link bigint, weight bigint"
)
_FIELDS = [x.split()[0] for x in TOKENS.split(", ")]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tally(batch: pa.RecordBatch) -> dict:
    """Each host's tokens in a batch: elements (kind in value: 0), inner texts of elements that stand once, own texts.

    A value of 0 stands for the element itself; inner texts and own texts have their hash, own ones under their path's
    complement, so that the three are told apart.
    """
    found: dict[tuple[str, int, int], list] = {}

    def add(host, path, value, parent, tag, apart, total, vector, place, size, link, weight):
        row = found.get((host, path, value))
        if row is None:
            found[host, path, value] = [parent, tag, apart, 1, total, vector, place, size, link, weight]
            return
        row[3] += 1
        row[4] += total
        row[5] ^= vector
        row[6] += place
        row[7] += size
        row[8] += link
        row[9] += weight

    for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
        host = host_of(url)
        paths, texts = page_tokens(html or "")
        page = _hash(f"{i}\n{html}".encode())
        for path, s in paths.items():
            vector = _signed(_hash(s.count.to_bytes(8, "little"), page))
            add(host, _signed(path), 0, _signed(s.parent), s.tag, s.apart, s.count, vector, s.place, s.size, s.link, s.weight)
            if s.count == 1 and s.tag not in INLINE:
                add(host, _signed(path), _signed(s.hash or 1), 0, "", False, 1, 0, 0, 0, 0, 0)
        for (path, digest), size in texts.items():
            add(host, ~_signed(path), _signed(digest or 1), 0, "", False, 1, 0, 0, size, 0, 0)
    columns = list(zip(*((*k, *row) for k, row in found.items()), strict=True)) or [()] * len(_FIELDS)
    return dict(zip(_FIELDS, columns, strict=True))


NODE = ["path", "parent", "tag", "apart", "pages", "vector", "once", "place", "size", "link", "weight", "different"]


def _host():
    """The same as `host_of`, as a column."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#\\\\]*@)?([^/?#\\\\]*)", 1))


def without_copies(pages: DataFrame) -> DataFrame:
    """One page (the smallest page_id) of each group of copies on a host: copies must not make a token frequent.

    The groups of two and more, as hashes, are broadcast up to `COPIES`; beyond it the pages are joined to them.
    """
    keyed = pages.select("page_id", "url", "html", F.xxhash64(_host(), F.coalesce("html", F.lit(""))).alias("copy"))
    groups = runtime.checkpoint(keyed.groupBy("copy").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    if groups.count() <= COPIES:
        kept = runtime.join_split(keyed, F.broadcast(groups.select("copy", "first")), "copy", groups.limit(0), "left")
    else:
        kept = runtime.join_split(keyed, groups.select("copy", "first"), "copy", groups.select("copy", "n"), "left")
    return kept.where(F.col("first").isNull() | (F.col("page_id") == F.col("first"))).select("page_id", "url", "html")


def deduce(pages: DataFrame) -> DataFrame:
    """host, all_pages, all_different, nodes (its frequent elements), constant (texts on all its pages), of every host."""
    tally = runtime.per_batch(without_copies(pages), TOKENS, _tally, ["page_id", "url", "html"])
    summed = [F.sum(c).alias(c) for c in ("pages", "total", "place", "size", "link", "weight")]
    sums = tally.groupBy("host", "path", "value").agg(F.max("parent").alias("parent"), F.max("tag").alias("tag"), F.max("apart").alias("apart"), F.bit_xor("vector").alias("vector"), *summed)
    sums = runtime.checkpoint(sums)  # read several times below; the pages are parsed once
    # The number of different values of a path: the rows of the table itself, so texts of a large host meet in no one task.
    different = sums.where("value <> 0").groupBy("host", "path").agg(F.count("*").alias("different"), F.sum("size").alias("own"))
    hosts = sums.where("path = 0 and value = 0").select("host", F.col("pages").alias("all_pages"))
    hosts = runtime.checkpoint(hosts.join(different.where("path = 0").select("host", F.col("different").alias("all_different")), "host"))
    of_host = hosts.select("host", F.col("all_pages").alias("n"))
    elements = sums.where("value = 0 and pages > 1").join(different.drop("own"), ["host", "path"], "left")
    frequent = runtime.join_split(elements, hosts, "host", of_host).where(F.col("pages") >= FREQUENT * F.col("all_pages"))
    node = F.struct(
        "path", "parent", "tag", "apart", "pages", "vector", (F.col("total") == F.col("pages")).alias("once"), (F.col("place") / F.col("pages")).alias("place"),
        (F.col("size") / F.col("pages")).alias("size"), (F.col("link") / F.col("pages")).alias("link"), (F.col("weight") / F.greatest("size", F.lit(1))).alias("weight"),
        F.coalesce("different", F.lit(0)).alias("different"),
    )
    nodes = frequent.groupBy("host", "all_pages", "all_different").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    # Texts at one path on all pages. Where few others stand beside them, or they are most of the text, the pages are near copies.
    texts = sums.where(F.col("value") != 0).where(f"pages >= {ENOUGH}").select("host", "path", "value", "pages", "size")
    constant = runtime.join_split(texts, hosts, "host", of_host).where((F.col("pages") == F.col("all_pages")) & (F.col("all_different") >= ENOUGH))
    constant = constant.groupBy("host", "path", "all_different").agg(F.collect_list("value").alias("values"), F.sum("size").alias("same"))
    constant = constant.join(different, ["host", "path"]).where((F.col("different") >= VARIES * F.col("all_different")) & (F.col("same") <= SMALL * F.col("own")))
    constant = constant.select("host", F.bitwise_not("path").alias("path"), F.explode("values").alias("value"))
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "value"))).alias("constant"))
    return nodes.join(constant, "host", "left")


def classes(nodes: list) -> dict[tuple[int, int], list]:
    """Equivalence classes of a host's frequent elements: equal occurrence vectors, in page order."""
    found = defaultdict(list)
    for t in nodes:
        found[t["pages"], t["vector"]].append(t)
    return {k: sorted(v, key=lambda t: t["place"]) for k, v in found.items()}


def template(all_different: int, nodes: list) -> tuple[int, list[int]] | None:
    """The article's element and the elements within it that belong to the template; None: no template, or no slot varies."""
    if all_different < LEAST:
        return None
    every = {t["path"]: t for t in nodes}
    # Valid classes: their tokens stand once on each of their pages.
    valid = {t["path"]: t for own in classes(nodes).values() for t in own if t["once"] and t["tag"] not in INLINE and t["path"]}

    def around(path: int) -> int:
        """The nearest template element around an element; 0: the page."""
        while path and path in every:
            path = every[path]["parent"]
            if path in valid:
                return path
        return 0

    outer = {p: around(p) for p in valid}
    varies = {p: t["different"] >= VARIES * all_different * t["pages"] / max(1, every[0]["pages"]) and t["different"] > 1 for p, t in valid.items()}
    mass = {p: (t["size"] - 0.5 * t["link"]) if varies[p] and not t["apart"] else 0.0 for p, t in valid.items()}
    inner = defaultdict(list)
    for p, o in outer.items():
        inner[o].append(p)
    total = sum(mass[p] for p in inner[0])
    if total <= 0:
        return None
    best, held = 0, total
    while True:  # down to the deepest element that holds most of what varies
        deeper = max(inner[best], key=lambda p: (mass[p], -valid[p]["place"]), default=None)
        if deeper is None or mass[deeper] < MOST * total or not mass[deeper]:
            break
        best, held = deeper, mass[deeper]
    if not best:
        return None
    ancestors, at = [best], best
    while outer[at]:
        at = outer[at]
        ancestors.append(at)
    repeated = {p for p, t in every.items() if not t["once"] and t["tag"] not in INLINE and t["tag"] not in ROWS}
    repeated &= {t["parent"] for t in nodes if t["tag"] not in INLINE}
    lists = set()  # template elements with repeated parts that have parts themselves, as lists of remarks do
    for p in repeated:
        at = around(p)
        while at and at not in lists:
            lists.add(at)
            at = outer[at]
    below = defaultdict(list)
    for t in nodes:
        if t["tag"] not in INLINE:
            below[t["parent"]].append(t["path"])

    def leaves(path: int) -> set[str]:
        """The elements that hold the text of an element."""
        tags, todo = set(), [path]
        while todo:
            p = todo.pop()
            if below[p]:
                todo += below[p]
            else:
                tags.add(every[p]["tag"])
        return tags

    dropped: list[int] = []
    named = next((p for p in ancestors if valid[p]["tag"] == "article"), None) or next((p for p in ancestors if valid[p]["tag"] == "main"), None)
    if named is not None:
        best = named
    else:  # wider: to what follows and is kin to the article, or as long as nothing that varies follows
        words, place = leaves(best), valid[best]["place"]
        for child, p in zip(ancestors, ancestors[1:]):
            beside = [q for q in inner[p] if q != child]
            varying = [q for q in beside if mass[q] > 0 and valid[q]["place"] > place]
            kin = {q for q in varying if q not in lists and 2 * valid[q]["link"] < valid[q]["size"] and not words.isdisjoint(leaves(q))}
            whole = valid[p]["tag"] in ("body", "html")
            if not kin and (varying or whole):
                break
            best = p
            dropped += [q for q in (beside if whole else varying) if q not in kin]
            if whole:
                break
    if all_different >= ENOUGH:
        todo = [p for p in inner[best] if p not in dropped]
        while todo:
            p = todo.pop()
            t = valid[p]
            behind = t["place"] > valid[best]["weight"] and t["size"] < SMALL * held and t["pages"] >= 0.9 * every[best]["pages"]
            listed = p in lists or 2 * t["link"] >= t["size"] > 0
            if not varies[p] and t["size"] > 0 or behind and listed:
                dropped.append(p)
            else:
                todo += inner[p]
    return best, sorted(dropped)


def article(html: str, slot: int | None = None, dropped: frozenset[int] = frozenset(), constant: frozenset[tuple[int, int]] = frozenset()) -> str:
    """A page's text: blocks in page order, white space in a block as one space."""
    found = None
    if slot:
        found = _blocks(html, lambda e: e.path == slot, dropped, constant)
    for tag in ("article", "main", "body"):
        if found is None:
            found = _blocks(html, lambda e, tag=tag: e.tag == tag)
    if found is None:
        found = _blocks(html, None)
    return "\n".join(found)


def _blocks(html: str, starts, dropped: frozenset[int] = frozenset(), constant: frozenset[tuple[int, int]] = frozenset()) -> list[str] | None:
    """The blocks within the elements that start a slot (None: the whole page); None if there is none."""
    return read(html, lambda page: _blocks_of(page, starts, dropped, constant))


def _blocks_of(page, starts, dropped: frozenset[int], constant: frozenset[tuple[int, int]]) -> list[str] | None:
    blocks, current, own, seen = [], [], [], starts is None
    inside = 1 if starts is None else 0
    out = 0  # open elements of the template within the slot
    marks = []  # by open element: (starts a slot, is dropped)

    def flush():
        text = " ".join(unescape("".join(current)).split())
        if text and any(own):  # a block of the template's texts alone is the template's
            blocks.append(text)
        current.clear()
        own.clear()

    for kind, element, text in page:
        if kind == "text":
            if inside and not out and not element.apart:
                current.append(text)
                if not text.isspace():
                    own.append(not constant or (element.path, _hash(" ".join(text.split()).encode()) or 1) not in constant)
            continue
        if kind == "open":
            begins, gone = starts is not None and starts(element), element.path in dropped
            marks.append((element, begins, gone))
            if element.tag not in INLINE:
                flush()
            inside += begins
            seen = seen or begins
            out += gone
        else:
            if element.tag not in INLINE:
                flush()
            if marks and marks[-1][0] is element:
                _, begins, gone = marks.pop()
                inside -= begins
                out -= gone
        if element.tag == "br":
            current.append(" ")
    flush()
    return blocks if seen else None


TEMPLATES = "host string, slot bigint, dropped array<bigint>, constant array<struct<path:bigint,value:bigint>>"


def templates(pages: DataFrame) -> DataFrame:
    """host, slot, dropped, constant: the deduced template of every host that has one."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = []
        for host, n, nodes, constant in zip(*(batch.column(c).to_pylist() for c in ("host", "all_different", "nodes", "constant")), strict=True):
            found = template(n, nodes)
            if found:
                rows.append((host, *found, constant or []))
        return dict(zip(("host", "slot", "dropped", "constant"), zip(*rows, strict=True) if rows else [()] * 4, strict=True))

    return runtime.per_batch(deduce(pages), TEMPLATES, work, ["host", "all_different", "nodes", "constant"])


def _known(slot, dropped, constant) -> tuple:
    unsigned = (1 << 64) - 1
    return slot & unsigned, frozenset(x & unsigned for x in dropped), frozenset((c["path"] & unsigned, c["value"] & unsigned) for c in constant)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    spark = pages.sparkSession
    found = runtime.checkpoint(templates(pages))
    size = found.agg(F.sum(F.octet_length("host") + 16 + 8 * F.size("dropped") + 16 * F.size("constant"))).first()[0] or 0
    schema = "page_id bigint, url string, text string"
    pages = pages.select("page_id", "url", "html")
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: _known(r["slot"], r["dropped"], r["constant"]) for r in found.collect()})

        def work(batch: pa.RecordBatch) -> dict:
            urls = batch.column("url").to_pylist()
            texts = [article(h or "", *shared.value.get(host_of(u), ())) for u, h in zip(urls, batch.column("html").to_pylist(), strict=True)]
            return {"page_id": batch.column("page_id"), "url": urls, "text": texts}

        return runtime.per_batch(pages, schema, work, ["page_id", "url", "html"])
    host = _host()
    left = pages.withColumn("host", host).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)))
    right = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")))
    joined = left.join(right, ["host", "salt"], "left")

    def work_joined(batch: pa.RecordBatch) -> dict:
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "slot", "dropped", "constant")), strict=True)
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": [article(h or "", *(_known(*t) if t[0] is not None else ())) for h, *t in rows]}

    return runtime.per_batch(joined, schema, work_joined, ["page_id", "url", "html", "slot", "dropped", "constant"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
