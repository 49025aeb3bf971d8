"""Main text of web pages: blocks of text, page differencing against the nearest URL of the host, and page structure."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import groupby
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm import rows

_DECLARED = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
_HEAD = r"|<(/?)([a-zA-Z][^\s/>]*+)"
_MARKUP = re.compile(
    _DECLARED + _HEAD + r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""" + _HEAD + r"([^>]*+)>", re.S)
_STARTS = re.compile(_DECLARED + _HEAD, re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANKS = re.compile(r"\s+")

#: Elements by what they do to the text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template textarea noscript iframe object svg math canvas select title audio video".split())
_DROPPED = frozenset("head nav aside footer form button menu dialog".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADINGS | frozenset("p li dd dt blockquote pre td th caption figcaption".split())
#: An open element on the left ends where an element on the right starts, unless one of _WALLS is open in between.
_ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
_WALLS = frozenset("ul ol dl table article section main nav aside body".split())
#: Words of class and id names, and roles, that mark what is not the article.
_READERS = frozenset("comment comments commentlist disqus replies reply respond responses reactions feedback discussion".split())
_COMMENTS = frozenset("comment comments commentlist".split())  # so named even where other words tell of a text
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox banner promo promotion sponsor "
                     "sponsored sponsors related recommended recommendations outbrain taboola".split())
_FRAME = frozenset(
    "alert breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr hidden login menu menus masthead modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination paywall popup privacy searchbar searchbox searchform share sharebar sharing "
    "sidebar sidebars signup skip social subscribe subscription toolbar topbar widget widgets".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_ARTICLES = frozenset("article articlebody postbody entry post story content main maincontent".split())
#: Parts of longer words, as in sitefooter or commentbox, that mark the same.
_READERS_PART = re.compile("comment(?!ar)")
_ADVERTS_PART = re.compile("advert|sponsor|banner")
_FRAME_PART = re.compile("sidebar|footer|navbar|menu|cookie|consent|newsletter|subscri|breadcrumb|masthead|popup|(?:site|page)header")
_NOT = frozenset("has no with without is".split())


@dataclass
class Line:
    """A block of text. inside: it is in an article; prose: in an element that holds running text there; dropped: the
    structure of the page says that it is not of the article; linked: characters of it in links."""

    text: str
    inside: bool
    prose: bool
    dropped: bool
    linked: int


@dataclass
class _Open:
    tag: str
    dropped: bool
    inside: bool
    heading_only: bool = False
    final: bool = False  # an article below does not lift dropped
    heading: bool = False  # in a heading, in an element of prose: as far up as the article or its header
    prose: bool = False


@dataclass
class _Page:
    lines: list[Line] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, False)])
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    open_tags: Counter[str] = field(default_factory=Counter)

    def flush(self) -> None:
        if not self.parts:
            return
        text = _BLANKS.sub(" ", "".join(self.parts)).strip()
        if text:
            top = self.stack[-1]
            self.lines.append(Line(
                text, top.inside, top.prose, top.dropped or top.heading_only and not top.heading, self.linked))
        self.parts.clear()
        self.linked = 0

    def text(self, raw: str) -> None:
        if raw:
            value = html.unescape(raw) if "&" in raw else raw
            self.parts.append(value)
            if self.open_tags["a"]:
                self.linked += len(value.strip())

    def open(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS:
            self.flush()
            self._imply(tag)
        if tag in _VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        top = self.stack[-1]
        names, ids, role, hidden = _marks(attributes)
        if tag in _HEADINGS:
            names, ids = set(), set()  # what they are about, not what they are
        elif tag in ("article", "main"):
            names, ids = names & (_ARTICLES | _COMMENTS), ids & (_ARTICLES | _COMMENTS)
        elif tag == "section" and top.inside:
            ids = ids & _COMMENTS
        names = names | ids
        article = tag in ("article", "main") or role in ("article", "main") or tag != "a" and bool(names & _ARTICLES) and (
            tag in ("div", "section"))
        reader, advert, framed = _means(names)
        frame = (tag in _DROPPED or role in _ROLES or framed) and tag not in ("html", "body")
        dropped = tag not in ("html", "body") and (reader or advert or hidden) or frame and tag not in ("article", "main")
        header = tag == "header" or "header" in names and tag not in ("html", "body")
        lifted = tag in ("article", "main") and not dropped and not top.final
        heading_only = top.heading_only and not lifted or header and top.inside
        ends = heading_only or tag in ("article", "main")
        self.open_tags[tag] += 1
        self.stack.append(_Open(
            tag, dropped or top.dropped and not lifted or header and not (top.inside or article),
            not dropped and (top.inside or article), heading_only,
            top.final or reader or advert or hidden or tag in ("nav", "aside", "footer"),
            tag in _HEADINGS or top.heading and not ends, tag in _PROSE or top.prose and not ends))

    def _imply(self, tag: str) -> None:
        if tag != "head":
            self._until("head", frozenset(["body"]))
        if tag not in ("option", "tr", "td", "th", "tbody", "thead", "tfoot") and self.open_tags["p"]:
            self._until("p", _WALLS | {"td", "th", "li", "div"})
        for name, starts in _ENDS.items():
            if tag in starts:
                self._until(name, _WALLS - {name} | ({"tr"} if name in ("td", "th") and tag in ("td", "th") else set()))

    def _until(self, tag: str, walls: frozenset[str] | set[str]) -> None:
        """Closes the innermost open element of that name, if no wall is open inside it."""
        if not self.open_tags[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.open_tags.subtract(x.tag for x in self.stack[k:])
                del self.stack[k:]
                return
            if self.stack[k].tag in walls:
                return

    def close(self, tag: str) -> None:
        """Ends the innermost open element of that name and all inside it; an end without a start is nothing."""
        if tag in _BLOCKS:
            self.flush()
        self._until(tag, frozenset(["body"]) if tag in _BLOCKS and tag not in ("p", "li") else _WALLS - {tag})


def _means(names: set[str]) -> tuple[bool, bool, bool]:
    """Whether words of class and id stand for readers' comments, for adverts, for the frame of the page."""
    if not names:
        return False, False, False
    joined = " ".join(names)
    return (bool(names & _READERS or _READERS_PART.search(joined)), bool(names & _ADVERTS or _ADVERTS_PART.search(joined)),
            bool(names & _FRAME or _FRAME_PART.search(joined)))


def _marks(attributes: str) -> tuple[set[str], set[str], str, bool]:
    """Words of class, words of id, the role, and whether the element is hidden."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return set(), set(), "", False
    classes, ids, role, hidden = set(), set(), "", False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id", "itemprop"):
            for name in value.split():
                words = re.split(r"[^a-z]+", name)
                if not _NOT & set(words):
                    names = ids if key == "id" else classes
                    names.update(words)
                    names.add("".join(words) if "body" in words or "main" in words else words[0])
        elif key == "role":
            role = value.strip()
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return classes, ids, role, hidden


@cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(f"</{re.escape(tag)}[^>]*>", re.I)


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of quotes and of > in a page, and, for a tag that is outside of quotes there, where it ends (-1: nowhere)."""
    places = [m.start() for m in re.finditer("[>\"']", page)]
    ends = [-1] * (len(places) + 1)
    following = {'"': len(places), "'": len(places)}
    for k in range(len(places) - 1, -1, -1):
        mark = page[places[k]]
        if mark == ">":
            ends[k] = places[k]
        else:
            ends[k] = ends[min(following[mark] + 1, len(places))]
            following[mark] = k
    return places, ends


def blocks(page: str) -> list[Line]:
    """All blocks of text of a page in order, white space made single blanks, references decoded. Markup that ends
    nowhere is read as far as it goes; a lone < is text.

    A tag with a quote that is never closed ends at the next >. At the first of them the ends of all tags are looked up in
    one pass, so that thousands take time in proportion to the page. Behind the last > there are no tags.
    """
    out, at, n = _Page(), 0, len(page)
    last, ends, endless = page.rfind(">") + 1, None, set()
    while at < last:
        found = (_MARKUP if ends is None else _STARTS).search(page, at, last)
        if found is None:
            break
        out.text(page[at:found.start()])
        at = found.end()
        if ends is not None:
            slash, tag, rest = found[1], found[2], ""
            if tag:
                end = ends[1][bisect_left(ends[0], at)]
                end = end if end >= 0 else page.find(">", at)
                rest, at = page[at:end], end + 1
        elif found[5]:
            slash, tag, rest = found[4], found[5], found[6]
            ends = _tag_ends(page)
        else:
            slash, tag, rest = found[1], found[2], found[3]
        if not tag:
            start = found.start()
            if page.startswith("<![CDATA[", start):
                at = at if page.endswith("]]>", start + 9, at) else n
                out.parts.append(page[start + 9:at].removesuffix("]]>"))
            elif page.startswith("<!--", start) and not page.endswith("-->", start + 4, at):
                at = n
            continue
        tag = tag.lower()
        if slash:
            out.close(tag)
        elif tag in _RAW:
            if not rest.endswith("/") and tag not in endless:
                end = _raw_end(tag).search(page, at)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else n if tag in ("script", "style") else at
        else:
            out.open(tag, rest)
    rest = page[at:]
    start = re.search("<[!?]", rest)
    if start is None:
        out.text(rest)
    else:
        out.text(rest[:start.start()])
        if rest.startswith("<![CDATA[", start.start()):
            out.parts.append(rest[start.start() + 9:])
    out.flush()
    return out.lines


def common(a: list[int], b: list[int], cells: int = 1 << 26) -> list[int]:
    """Places in a of a longest common subsequence with b.

    Rows of the table are kept as the bits of numbers; where they would take more than cells bits, a is halved at the
    place of b that a longest subsequence can be split at, so memory stays bounded for any length.
    """
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    head, tail = list(range(low)), list(range(len(a) - high, len(a)))
    x, y = a[low:len(a) - high], b[low:len(b) - high]
    if not x or not y:
        return head + tail
    if len(x) * len(y) > cells and len(x) > 1:
        half = len(x) // 2
        before = _lengths(x[:half], y)
        after = _lengths(x[half:][::-1], y[::-1])[::-1]
        split = int(np.argmax(before + after))
        inner = common(x[:half], y[:split], cells) + [half + k for k in common(x[half:], y[split:], cells)]
    else:
        states = _states(x, y)
        inner, j = [], len(y)
        for i in range(len(x) - 1, -1, -1):
            # a bit that is 0 marks a place of y where the subsequence grows
            now, before = states[i + 1], states[i]
            while j and now >> j - 1 & 1:
                j -= 1
            if not j:
                break
            if before >> j - 1 & 1 or _zeros(before, j) < _zeros(now, j):
                inner.append(i)
                j -= 1
        inner.reverse()
    return head + [low + k for k in inner] + tail


def _zeros(state: int, j: int) -> int:
    return j - (state & (1 << j) - 1).bit_count()


def _states(x: list[int], y: list[int]) -> list[int]:
    places: dict[int, int] = {}
    for k, value in enumerate(y):
        places[value] = places.get(value, 0) | 1 << k
    whole = (1 << len(y)) - 1
    out = [whole]
    for value in x:
        state = out[-1]
        hit = state & places.get(value, 0)
        out.append((state + hit | state - hit) & whole)
    return out


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of x and each beginning of y."""
    places: dict[int, int] = {}
    for k, value in enumerate(y):
        places[value] = places.get(value, 0) | 1 << k
    state = whole = (1 << len(y)) - 1
    for value in x:
        hit = state & places.get(value, 0)
        state = (state + hit | state - hit) & whole
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(y)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def main_text(lines: list[Line], shared: list[int], framed: list[int] = (), sure: bool = False) -> str:
    """The lines that stay, joined by line feeds. shared: places of the lines that the nearest page of the host has too;
    framed: those of them that the pages around it show to be of the frame of the host; sure: by many pages.

    Shared lines go, except prose inside an article, which goes only if it surely is of the frame: there the structure
    proves what it is, and pages may repeat each other's paragraphs. Where shared lines are over half of what is left, the
    nearest page may be a copy, and those of the frame go alone. Of the rest, what the structure of the page drops goes,
    and, without an article, lines that are mostly links. If all is gone that way, nothing is left.
    """
    left = [(k, x) for k, x in enumerate(lines) if not x.dropped]
    frame = set(framed)
    if any(x.inside for _, x in left):
        left = [(k, x) for k, x in left if x.inside]
        gone = {k for k in shared if not lines[k].prose or sure and k in frame}
    else:
        left = [(k, x) for k, x in left if 2 * x.linked <= len(x.text)]
        gone = set(shared)
    size = sum(len(x.text) for _, x in left)
    if 2 * sum(len(x.text) for k, x in left if k in gone) > size:
        gone &= frame
    return "\n".join(x.text for k, x in left if k not in gone)


def _hashes(lines: list[Line]) -> list[int]:
    return [zlib.crc32(x.text.encode("utf-8", "surrogatepass")) << 20 | len(x.text) & 0xFFFFF for x in lines]


def _address(url: str | None) -> tuple[str, str]:
    """Host and path, both in lower case; empty where there is none."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").lower(), parts.path.lower().rstrip("/")
    except ValueError:
        return "", (url or "").lower()


def _nearness(a: str, b: str) -> tuple[int, int]:
    """Common folders, then common characters."""
    x, y = a.split("/"), b.split("/")
    folders = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    return folders, next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


_GROUP = 64
#: Pages that must be at hand to tell the frame of a host, and to tell it surely.
_SOME, _MANY = 4, 8


def _frame(pages: list[list[int]]) -> tuple[set[int], Counter[int]]:
    """Lines that at least 95 % of some different pages of a host have, and how many pages have each line."""
    have = Counter(x for lines in pages for x in set(lines))
    return {x for x, n in have.items() if 100 * n >= 95 * len(pages)} if len(pages) >= _SOME else set(), have


def _is_text(rest: list[int], have: Counter[int], n: int) -> bool:
    """Whether the lines of a page beside those of the frame are its own: on average (by characters) under a quarter of
    the other pages have them. Of near copies most have what one of them has changed, so their common text is no frame."""
    size = sum(x & 0xFFFFF for x in rest)
    return size > 0 and 4 * sum((x & 0xFFFFF) * (have[x] - 1) for x in rest) < size * (n - 1)


def _differences(cell: list[dict]) -> Iterator[dict]:
    """cell: pages next to each other by pos. Each page whose own cell it is, against the nearer of its neighbours."""
    for host, group in groupby(cell, key=lambda x: x["host"]):
        near = list(group)
        frame, have = _frame([x["lines"] for x in near])
        for k, row in enumerate(near):
            if row["cell"] != row["pos"] // _GROUP:
                continue
            others = [near[j] for j in (k - 1, k + 1) if 0 <= j < len(near)] if host else []
            shared, framed, lines = [], [], row["lines"]
            if others:
                partner = max(others, key=lambda x: (_nearness(row["path"], x["path"]), -x["pos"]))
                shared = common(lines, partner["lines"])
                if _is_text([x for x in lines if x not in frame], have, len(near)):
                    framed = [j for j in shared if lines[j] in frame]
            yield {"content": row["content"], "shared": shared, "framed": framed, "sure": len(near) >= _MANY}


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell and pos; a cell, which is about _GROUP pages, is held until it is whole."""
    schema = pa.schema([("content", pa.binary()), ("shared", pa.list_(pa.int32())), ("framed", pa.list_(pa.int32())),
                        ("sure", pa.bool_())])
    held: list[dict] = []
    for batch in rows.pieces(batches):
        out = []
        for row in batch.to_pylist():
            if held and held[0]["cell"] != row["cell"]:
                out += _differences(held)
                held = []
            held.append(row)
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(list(_differences(held)), schema)


def _content(host: str, lines: list[int]) -> bytes:
    """Tells pages of a host with different lines apart."""
    return hashlib.md5(host.encode() + b"\0" + np.array(lines, "<i8").tobytes()).digest()


def extracted(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """row (struct of all columns of pages) and text: the main text of every page, empty for null and empty pages.

    Pages of a host with equal lines are taken as one, at the first of their paths, so that no page is compared with a
    copy of itself. They are numbered in the order of host and path. Each is paired with the one before or after it that
    shares more of its path, the one before if both share alike, on the same host; the hashes of their lines are aligned,
    and lines in a longest common subsequence are taken out as main_text() says, with the pages of its group of 64 to tell
    the frame of the host. Only hashes of lines are sorted and paired, 64 pages to a group with the two next to it, so
    that a host with many pages is spread evenly; each page is shuffled once, compressed, to its result. Repeated rows
    give equal results. A page without a host or a neighbour has no shared lines.
    """
    keyed = pages.select(
        F.struct("*").alias("row"), F.col(url).alias("u"), F.coalesce(F.col(page), F.lit("")).alias("t"))

    def signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.pieces(batches):
            where = [_address(x) for x in batch.column("u").to_pylist()]
            lines = [_hashes(blocks(x.decode())) for x in rows.texts(batch.column("t"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_content(h, x) for (h, _), x in zip(where, lines, strict=True)], pa.binary()),
                 pa.array([h for h, _ in where], pa.string()), pa.array([p for _, p in where], pa.string()),
                 pa.array(lines, pa.list_(pa.int64()))], names=["content", "host", "path", "lines"])

    small = rows.map_arrow(keyed.select("u", "t"), signature, "content binary, host string, path string, lines array<long>")
    one = small.filter(F.size("lines") > 0).groupBy("content").agg(
        F.first("host").alias("host"), F.min("path").alias("path"), F.first("lines").alias("lines"))
    numbered = rows.numbered(one, "host", "path", "content")
    cell = F.floor(F.col("pos") / _GROUP)
    spread = numbered.select("*", F.explode(F.array_distinct(F.array(
        cell, F.floor((F.col("pos") - 1) / _GROUP), F.floor((F.col("pos") + 1) / _GROUP)))).alias("cell"))
    shared = rows.map_arrow(
        spread.repartition("cell").sortWithinPartitions("cell", "pos"), _shared,
        "content binary, shared array<int>, framed array<int>, sure boolean")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.pieces(batches):
            made, contents = [], []
            for address, x in zip(batch.column("u").to_pylist(), rows.texts(batch.column("t")), strict=True):
                lines = blocks(x.decode())
                flags = bytes(k.inside | k.prose << 1 | k.dropped << 2 | (2 * k.linked > len(k.text)) << 3 for k in lines)
                kept = "\n".join("" if k.dropped else k.text for k in lines).encode("utf-8", "surrogatepass")
                made.append(zlib.compress(len(flags).to_bytes(8, "little") + flags + kept, 6))
                contents.append(_content(_address(address)[0], _hashes(lines)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(contents, pa.binary()), pa.array(made, pa.binary())],
                names=["row", "content", "pack"])

    light = [c for c in pages.columns if c != page]
    row = F.struct(*[F.col("row")[c].alias(c) for c in light]).alias("row")
    inner = keyed.select(row, "u", "t")
    whole = rows.map_arrow(inner, packed, T.StructType([
        inner.schema["row"], T.StructField("content", T.BinaryType()), T.StructField("pack", T.BinaryType())]))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.pieces(batches):
            out = []
            found = (batch.column(c).to_pylist() for c in ("pack", "shared", "framed", "sure"))
            for pack, gone, framed, sure in zip(*found, strict=True):
                raw = zlib.decompress(pack)
                n = int.from_bytes(raw[:8], "little")
                flags, kept = raw[8:8 + n], raw[8 + n:].decode("utf-8", "surrogatepass").split("\n")
                lines = [Line(t, bool(f & 1), bool(f & 2), bool(f & 4), len(t) if f & 8 else 0)
                         for t, f in zip(kept, flags, strict=False)]
                out.append(main_text(lines, gone or [], framed or [], bool(sure)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])

    met = whole.join(shared, "content", "left").select("row", "pack", "shared", "framed", "sure")
    return rows.map_arrow(met, finished, T.StructType([inner.schema["row"], T.StructField("text", T.StringType())]))
