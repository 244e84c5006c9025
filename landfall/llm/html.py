"""Main text of web pages with wrappers inferred for each host.

The pages of a host are token streams of tags and text slots. Folding turns what repeats side by side into
one repeated group; aligning the folded streams of a host, one after the other, turns what does not match
into optional groups, which leaves one union-free expression, the wrapper. A slot's kind, that is whether
it lies in an article, beside one or in neither, is part of the stream, so that only slots of one kind
align. A page is parsed against its host's wrapper and gives the texts of the article's slots. On pages
without an article the slots of neither kind are taken, less what stands on every page of the host before
the first and after the last slot in which pages differ.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import count
from math import isqrt

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Elements without content, elements that end a block, and elements that are never article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
IN_LINE = frozenset("p b i em strong span a font u".split())
ITEMS, LISTS = frozenset("li dt dd tr td th".split()), ("ul", "ol", "dl", "table", "menu")
BESIDE = frozenset("aside button canvas datalist dialog footer form head header iframe input label math menu nav noscript object option select svg template textarea title".split())
NAMES = (
    r"ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|form|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promo|related|replies|reply|respond|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|tags|toc|toolbar|widgets?"
)
#: Outside an article a part of a name will do, inside it takes the whole name.
BESIDE_NAMES, BESIDE_WHOLE_NAMES = re.compile(rf"(?:^|[\s_-])(?:{NAMES})(?:$|[\s_-])", re.I), re.compile(rf"(?:{NAMES})\Z", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BESIDE_ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|alert|dialog|form|menu)$", re.I)

#: A text can be of the template if at least so many pages that differ have its slot: fewer do not show what differs.
TEMPLATE_PAGES = 2
#: Symbols that a repeated group spans at most.
FOLD = 24
#: Streams of a host that are aligned in about one task; the order of alignment is the same for any value from 2.
PART = 256
#: Characters of wrappers that are broadcast at most; beyond, they are joined by shuffle.
BROADCAST_CHARS = 32_000_000
SLOTS_TYPE = pa.list_(pa.int64())
BLOCKS_TYPE = pa.list_(pa.struct([("symbol", pa.int32()), ("slot", pa.int32()), ("text", pa.string())]))
#: Kinds of slots.
ARTICLE, BESIDE_IT, OTHER = "a", "-", "o"

HEAD = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.S | re.I)
REST = re.compile(r"(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>=]++|=)*+>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")
SLOT = re.compile(r"#(.)")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _beside(name: str, attributes: str, inside: bool) -> int:
    """2 if the element stands beside the article, 1 if it is the article's own header, whose headings count, 0 otherwise."""
    if name in BESIDE:
        return 1 if inside and name == "header" else 2
    level = 0
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and inside and name != "main":
            found = [] if key == "id" and name in HEADINGS else [t.lower() for t in value.split() if BESIDE_WHOLE_NAMES.match(t)]
            level = max(level, 2 if set(found) - {"header"} else len(found[:1]))
        elif key in ("class", "id") and BESIDE_NAMES.search(value) or key == "role" and BESIDE_ROLES.match(value) or key == "hidden" or key == "aria-hidden" and value == "true":
            return 0 if name in ("html", "body", "main") else 2
    return level


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name (empty for comments, scripts and the like), whether closing, and attributes of each piece of markup.

    Every character is looked at a bounded number of times: what is no tag is text, and once a quoted value
    is found to reach beyond the last bracket of the page, tags end at the next one, whatever the quotes.
    """
    at, last, quoted = 0, page.rfind(">"), True
    while m := HEAD.search(page, at):
        if not m[3]:
            yield m.start(), m.end(), "", False, ""
            at = m.end()
            continue
        if m.end() > last:
            return
        found = REST.match(page, m.end()) if quoted else None
        quoted = found is not None
        stop = found.end() if found else page.index(">", m.end()) + 1
        yield m.start(), stop, m[3].lower(), bool(m[2]), page[m.end() : stop - 1]
        at = stop


def parse(page: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The page's symbols, and its blocks: text and kind of slot.

    Open elements that a closing tag passes over end with it; p and li end where the next block or item
    starts; what stands beside stays so until its element ends, but for headings in an article's own header.
    """
    stack: list[tuple[str, int, bool]] = []
    opened: Counter[str] = Counter()
    symbols: list[str] = []
    blocks: list[tuple[str, str]] = []
    words: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(words)).strip()
        words.clear()
        if text:
            kind = BESIDE_IT if stack and stack[-1][1] else ARTICLE if stack and stack[-1][2] else OTHER
            blocks.append((text, kind))
            symbols.append(f"#{kind}")

    def close(name: str, until: tuple[str, ...] = ()) -> None:
        """End the innermost such element, if none of ``until`` is opened within it."""
        if not opened[name]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                break
            if stack[k][0] in until:
                return
        while len(stack) > k:
            if stack[-1][0] in BLOCKS or stack[-1][1]:
                flush()
            ended = stack.pop()[0]
            opened[ended] -= 1
            if ended in BLOCKS:
                symbols.append(f"/{ended}")

    at = 0
    for start, stop, name, closing, attributes in tags(page):
        if start > at:
            words.append(entities.unescape(page[at:start]))
        at = stop
        if not name:
            continue
        if closing:
            close(name)
            continue
        if name in VOID:
            if name == "br":
                words.append(" ")
            elif name == "hr":
                flush()
            continue
        if name in BLOCKS:
            flush()
            if opened["p"] and stack[-1][0] in IN_LINE:
                close("p")
            if name in ITEMS:
                close(name, LISTS)
        beside, inside = stack[-1][1:] if stack else (0, False)
        inside = inside or name in ("article", "main")
        if beside < 2:
            own = _beside(name, attributes, inside)
            if own > beside:
                flush()
            beside = (own if own > 1 else 0) if name in HEADINGS else max(beside, own)
        stack.append((name, beside, inside))
        opened[name] += 1
        if name in BLOCKS:
            symbols.append(name)
    if at < len(page):
        words.append(entities.unescape(page[at:]))
    flush()
    return symbols, blocks


#: A symbol and, for each of its text slots in order, what fills it: numbers of blocks, say.
Item = tuple[str, list[list]]


def folded(symbols: list[str]) -> list[Item]:
    """Side-by-side repeats as one group, the shortest first; a group's slots hold the blocks of all its repeats."""
    blocks = count()
    items: list[Item] = [(s, [[next(blocks)]] if s[0] == "#" else []) for s in symbols]
    for width in range(1, FOLD + 1):
        names = [s for s, _ in items]
        out: list[Item] = []
        at = 0
        while at < len(items):
            group, n = names[at : at + width], 1
            while names[at + n * width : at + (n + 1) * width] == group:
                n += 1
            if n > 1 and len(group) == width:
                repeats = [[slot for _, slots in items[k : k + width] for slot in slots] for k in range(at, at + n * width, width)]
                out.append((f"({' '.join(group)})+" if width > 1 or not group[0].endswith("+") else group[0], [sum(same, []) for same in zip(*repeats)]))
                at += n * width
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def fold(symbols: list[str]) -> list[str]:
    return [s for s, _ in folded(symbols)]


def _required(symbol: str) -> str:
    return symbol[1:-2] if symbol.startswith("(") and symbol.endswith(")?") else symbol


def _once(symbol: str) -> str:
    return symbol[1:-2] if symbol.startswith("(") and symbol.endswith(")+") else symbol


def _core(symbol: str) -> str:
    return _once(_required(symbol))


def _groups(symbols: list[str]) -> set[str]:
    return {_core(s) for s in symbols if _required(s).endswith(")+") and " " in s}


def _grouped(items: list[Item], groups: set[str]) -> list[Item]:
    """What stands once and is a group elsewhere becomes that group, the longest first."""
    if not groups:
        return items
    out: list[Item] = []
    names = [_required(s) for s, _ in items]
    longest = max(g.count(" ") for g in groups) + 1
    at = 0
    while at < len(items):
        for width in range(min(longest, len(items) - at), 1, -1):
            if (group := " ".join(names[at : at + width])) in groups:
                part = items[at : at + width]
                out.append((f"(({group})+)?" if any(s != _required(s) for s, _ in part) else f"({group})+", [slot for _, slots in part for slot in slots]))
                at += width
                break
        else:
            out.append(items[at])
            at += 1
    return out


def _matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of the cores, whatever the lengths.

    Rows of the length table are kept as bits (0 where it grows); of about the root of all rows, the ones
    between are made again on the way back.
    """
    masks: dict[str, int] = {}
    for j, s in enumerate(b):
        core = _core(s)
        masks[core] = masks.get(core, 0) | 1 << j
    found = [masks.get(_core(s), 0) for s in a]
    full = (1 << len(b)) - 1

    def rows(start: int, first: int, stop: int) -> Iterator[int]:
        for mask in found[first:stop]:
            both = start & mask
            start = (start + both | start - both) & full
            yield start

    width = isqrt(len(a)) + 1
    starts = [full]
    for first in range(0, len(a), width):
        for last in rows(starts[-1], first, first + width):
            pass
        starts.append(last)
    pairs, j = [], len(b) - 1
    for k in range(len(starts) - 2, -1, -1):
        block = [starts[k], *rows(starts[k], k * width, (k + 1) * width)]
        i = len(block) - 1
        while i and j >= 0:
            if block[i] >> j & 1:
                j -= 1
                continue
            i -= 1
            if block[i] >> j & 1:
                pairs.append((k * width + i, j))
                j -= 1
    return pairs[::-1]


def align(wrapper: list[str], stream: list[str]) -> list[str]:
    """The wrapper made wide enough for another stream: a group and its single form become the group, what one side lacks becomes optional."""
    both = _groups(wrapper) | _groups(stream)
    wrapper, stream = ([s for s, _ in _grouped([(s, []) for s in side], both)] for side in (wrapper, stream))
    out: list[str] = []
    a0 = b0 = 0
    for i, j in [*_matched(wrapper, stream), (len(wrapper), len(stream))]:
        out += [s if s != _required(s) else f"({s})?" for s in [*wrapper[a0:i], *stream[b0:j]]]
        for x, y in zip(wrapper[i : i + 1], stream[j : j + 1]):
            grown = f"({_core(x)})+" if ")+" in (_required(x)[-2:], _required(y)[-2:]) else _core(x)
            out.append(f"({grown})?" if x != _required(x) or y != _required(y) else grown)
        a0, b0 = i + 1, j + 1
    return out


@lru_cache(512)
def places(wrapper: str, stream: str) -> dict[tuple[int, int], tuple[int, str]]:
    """For each slot of a folded stream, as symbol and slot within it, the wrapper's slot that it is, as number and kind; those that do not align are left out."""
    to = wrapper.split("\x1f")
    numbers = count()
    slots = [[(next(numbers), kind) for kind in SLOT.findall(s)] for s in to]
    items = _grouped([(s, [[(k, j)] for j in range(s.count("#"))]) for k, s in enumerate(stream.split("\x1f"))], _groups(to))
    out = {}
    for a, b in _matched(to, [s for s, _ in items]):
        out |= {place: slots[a][j] for j, slot in enumerate(items[b][1]) for place in slot}
    return out


def read(page: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The page's folded stream, and its blocks: text, and symbol and slot in the stream."""
    symbols, blocks = parse(page)
    items = folded(symbols)
    at = {n: (k, j) for k, (_, slots) in enumerate(items) for j, slot in enumerate(slots) for n in slot}
    return "\x1f".join(s for s, _ in items), [(t, *at[n]) for n, (t, _) in enumerate(blocks)]


def placed(wrapper: str, stream: str, blocks: list[tuple[str, int, int]]) -> list[tuple[str, int | None, str]]:
    """Text, slot of the wrapper and its kind for each block; one that does not align has no slot, and the kind it has in the stream."""
    to = places(wrapper, stream)
    symbols = stream.split("\x1f")
    return [(t, *(to[k, j] if (k, j) in to else (None, SLOT.findall(symbols[k])[j]))) for t, k, j in blocks]


def _key(slot: int, text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(f"{slot} {text}".encode()) - (1 << 63)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        streams, blocks = [], []
        for page in batch.column("html").to_pylist():
            stream, found = read(page or "")
            streams.append(stream)
            blocks.append([{"symbol": k, "slot": j, "text": t} for t, k, j in found])
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(streams, pa.string()), pa.array(blocks, BLOCKS_TYPE)], names=["page_id", "url", "host", "stream", "blocks"])


def _others(batch: pa.RecordBatch) -> Iterator[list[tuple[str, int | None]]]:
    """Text and slot of what a page without an article has in slots of neither kind, for each page; nothing for pages with one."""
    for wrapper, stream, blocks in zip(*(batch.column(n).to_pylist() for n in ("wrapper", "stream", "blocks"))):
        found = placed(wrapper, stream, [(b["text"], b["symbol"], b["slot"]) for b in blocks])
        yield [] if any(kind == ARTICLE for _, _, kind in found) else [(t, slot) for t, slot, kind in found if kind == OTHER]


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page without an article fills: slots alone (slot 0) and slots with their texts; pages are told apart by their texts."""
    for batch in batches:
        hosts, pages, slots, texts = [], [], [], []
        for host, found in zip(batch.column("host").to_pylist(), _others(batch)):
            if found:
                pairs = sorted({(_key(slot, None), _key(slot, text)) for text, slot in found if slot is not None})
                hosts.append(host)
                pages.append(_key(0, "\n".join(t for t, _ in found)))
                slots.append([a for a, _ in pairs])
                texts.append([b for _, b in pairs])
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(slots, SLOTS_TYPE), pa.array(texts, SLOTS_TYPE)], names=["host", "page", "slots", "texts"])


def _merged(items: list[tuple[int, str]], bit: int = 63) -> list[str]:
    """The wrapper of streams or wrappers, each with the code of its stream: those of equal leading bits are aligned first."""
    if len(items) == 1 or bit < 0:
        return reduce(align, (s.split("\x1f") for _, s in sorted(items)))
    sides = [[x for x in items if x[0] >> bit & 1 == side] for side in (0, 1)]
    return reduce(align, (_merged(side, bit - 1) for side in sides if side))


def _aligned(group: pd.DataFrame) -> pd.DataFrame:
    wrapper = _merged([(code, s) for code, s in zip(group["code"].tolist(), group["stream"])])
    return pd.DataFrame({"host": [group["host"].iloc[0]], "stream": ["\x1f".join(wrapper)], "n": [int(group["n"].sum())], "code": [group["code"].iloc[0]]})


def _few(df: DataFrame, *texts: str) -> DataFrame:
    """df for a broadcast if its rows and the characters of these columns are few."""
    chars = df.agg(F.coalesce(F.sum(sum((F.length(t) for t in texts), F.lit(100))), F.lit(0))).first()[0]
    return F.broadcast(df) if chars <= BROADCAST_CHARS else df


def read_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, host, stream (the folded stream, its symbols parted by U+001F) and blocks (symbol and slot in the stream, text) of every page."""
    source = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), host_of(F.col(f"`{url}`")).alias("host"))
    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(_read, f"page_id {kind}, url string, host string, stream string, blocks array<struct<symbol: int, slot: int, text: string>>")


def wrappers(seen: DataFrame) -> DataFrame:
    """host, wrapper (the expression, its symbols parted by U+001F), n (pages) from read pages.

    Equal folded streams are counted before they move. About PART of a host's are aligned in one task,
    then the wrappers of the parts, and so on until one is left, so a host with many pages meets in no task.
    Streams are aligned along the tree of their hashes' bits and parts are subtrees, so the wrapper is the
    same however many parts there are.
    """
    shapes = stored(seen.groupBy("host", "stream").agg(F.count("*").alias("n")).withColumn("code", F.xxhash64("stream")), "shapes")
    while True:
        most = shapes.groupBy("host").agg(F.count("*").alias("streams"))
        largest = most.agg(F.max("streams")).first()[0] or 1
        part = F.expr(f"if(streams <= {PART}, 0L, shiftrightunsigned(code, 64 - cast(ceil(log2(streams / {PART})) as int)))")
        grouped = shapes.join(most, "host").withColumn("part", part).groupBy("host", "part")
        shapes = stored(grouped.applyInPandas(_aligned, "host string, stream string, n bigint, code bigint"), "wrappers")
        if largest <= PART:
            return shapes.select("host", F.col("stream").alias("wrapper"), "n")


def templates(seen: DataFrame, known: DataFrame) -> DataFrame:
    """host, template: hashes of slot and text for what all pages without an article that have the slot have there, from read pages and their wrappers. Pages that repeat count once."""
    without = seen.filter(~F.contains("stream", F.lit(f"#{ARTICLE}"))).select("host", "stream", "blocks")
    parsed = without.join(known.select("host", "wrapper"), "host").mapInArrow(_filled, "host string, page bigint, slots array<bigint>, texts array<bigint>")
    pairs = parsed.select("host", "page", F.explode(F.arrays_zip("slots", "texts")).alias("p")).select("host", "page", F.col("p.slots").alias("slot"), F.col("p.texts").alias("text"))
    pairs = stored(pairs.distinct(), "fills")
    held = pairs.select("host", "page", "slot").distinct().groupBy("host", "slot").agg(F.count("*").alias("held")).filter(f"held >= {TEMPLATE_PAGES}")
    times = pairs.groupBy("host", "slot", "text").agg(F.count("*").alias("times"))
    return times.join(held, ["host", "slot"]).filter("times = held").groupBy("host").agg(F.collect_set("text").alias("template"))


def main_text(wrapper: str, stream: str, blocks: list[tuple[str, int, int]], template: frozenset[int] = frozenset()) -> str:
    """The texts of the article's slots, or without an article those of slots of neither kind, from the first to the last that is not of the template (all, if all are)."""
    found = placed(wrapper, stream, blocks)
    kept = [t for t, _, kind in found if kind == ARTICLE]
    if not kept:
        others = [(t, slot is None or _key(slot, t) not in template) for t, slot, kind in found if kind == OTHER]
        own = [k for k, (_, differs) in enumerate(others) if differs] or [0, len(others) - 1]
        kept = [t for t, _ in others[own[0] : own[-1] + 1]]
    return "\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of pages.

    A null or empty html gives the empty text; a null or odd url belongs to the host with the empty name;
    repeated rows give repeated rows; an empty table gives no rows; other columns are not read. Long pages
    and deep nesting take time in proportion to their length. Within an article nothing is dropped but
    what tags, names and roles say stands beside it.
    """
    seen = stored(read_pages(pages, key, url, html), "pages")
    known = wrappers(seen)
    fixed = stored(templates(seen, known), "templates")
    whole = stored(known.join(fixed, "host", "left").select("host", "wrapper", "template"), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("wrapper", "stream", "blocks", "template")))
            texts = [main_text(wrapper, stream, [(b["text"], b["symbol"], b["slot"]) for b in blocks], frozenset(template or ())) for wrapper, stream, blocks, template in rows]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = seen.schema["page_id"].dataType.simpleString()
    joined = seen.join(_few(whole, "wrapper"), "host").select("page_id", "url", "stream", "blocks", "wrapper", "template")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
