"""Main text of pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and texts. A text that stands once on nearly all pages of its host, copies counted once, is part of the
template: it is a constant token like a tag. All others are slots. Adjacent equal runs of the stream fold into repeated groups,
which gives the page's expression; a host's distinct expressions are then aligned, some at a time, in rounds. Where
two differ, the parts become optional groups, or join a repeated group that matches them. Expressions that have too little in common make
wrappers of their own. A wrapper accepts its pages; matched against a page it gives the main region (an article or main element, else
the body), and from it the blocks of all slots are read off: constant texts are left out, and elements that hold nothing but
constants go with them.

Which parts of the region aren't the article although they vary (menus, adverts and the like) is told by element, class, id and role.
Constants and wrappers are few; they are broadcast while their measured size allows, else joined by host.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm.common import stage, stage_alone, table

# Element names and class words by their role.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title"}
DROPPED = RAW | {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"}
DROPPED_WORDS = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer login menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe widget".split())
#: Words that say nothing by themselves: a name is a dropped one if it has a dropped word and otherwise these alone.
NEUTRAL_WORDS = set("area bar block body bottom box button buttons container content footer form group header icons inner item items left link links list main outer panel post posts right section slot text title top unit widget widgets wrap wrapper".split())
BLOCKS = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that no class name drops.
KEPT = HEADINGS | {"article", "main", "body", "html"}
IN_HEAD = {"base", "link", "meta"} | RAW

# Elements whose end tag may be missing, with the elements that an earlier open one is not sought beyond.
CLOSED_BY = {
    "p": {"article", "aside", "body", "div", "footer", "form", "header", "li", "main", "nav", "section", "td", "th"},
    "li": {"ol", "ul", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
}
SIBLINGS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

#: Quotes count only after an equals sign. All steps are possessive, so an unfinished tag costs one pass.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|(?>=\s*+(?>\"[^\"]*\"|'[^']*'|[^\s>]*+)))*+)>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PART = re.compile("[a-z0-9]+")
END_OF = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: A text is a constant of its host if it stands once on this share of its different pages, and on so many.
CONSTANT_SHARE, CONSTANT_PAGES = 0.95, 8
#: Constants and wrappers of up to this many bytes in all are broadcast.
BROADCAST_BYTES = 32 << 20
#: Expressions that one task aligns in a round, about; the least share of tokens that two must have in common; from so many wrappers of a host
#: down, rounds end. All that are left are used.
TOGETHER, ALIKE, MOST_WRAPPERS = 16, 0.5, 16

Token = tuple[str, str]  # (item, text): the item of a text is "#", or "=" and its hash for a constant


def tokens(page: str, constants: frozenset[int] = frozenset()) -> list[Token]:
    """A well-formed stream of block elements and texts.

    Items are <name>, <name!> (dropped by class, id or role), </name>, # for a text and =hash for a constant one. Inline tags join the text around
    them, unless their names drop them, and br is a blank; comments and raw elements go. Missing end tags are supplied and stray ones ignored; a raw element that
    never ends, or ends in its own tag, is but a tag, unless it is a script or style, which runs to the page's end.
    """
    out: list[Token] = []
    opened: list[str] = []

    def text_item(text: str) -> None:
        if opened and opened[-1] == "head" and text.strip():
            close("head")
        if out and out[-1][0] == "#":
            out[-1] = ("#", out[-1][1] + text)
        elif text.strip():
            out.append(("#", text))

    def close(name: str, stop: set[str] = frozenset()) -> None:
        """Closes the innermost such element and all within it, if one is open inside the stop elements."""
        for i in range(len(opened) - 1, -1, -1):
            if opened[i] == name:
                out.extend((f"</{x}>", "") for x in reversed(opened[i:]))
                del opened[i:]
                return
            if opened[i] in stop:
                return

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        if m is None:  # an unfinished tag: the rest is text
            text_item(page[at:])
            break
        at = m.end()
        shut, name, attributes, text = m[1], (m[2] or "").lower(), m[3], m[4]
        if text is not None:
            text_item(text)
        elif not name:
            pass
        elif name == "br":
            text_item(" ")
        elif name in RAW:
            if not shut and not attributes.endswith("/"):
                if found := END_OF[name].search(page, at):
                    at = found.end()
                elif name in ("script", "style"):
                    at = end
        else:
            if opened and opened[-1] == "head" and not shut and name not in IN_HEAD and name != "head":
                close("head")  # its end tag may be missing
            block = name in BLOCKS or name in DROPPED
            # an inline element that its name drops counts as a block; so does the end of one that is open
            if block or (name in opened if shut else attributes and not attributes.endswith("/") and dropped_by(attributes)):
                if shut:
                    close(name)
                elif not attributes.endswith("/") or name not in VOID_LIKE:
                    if block:
                        close("p", CLOSED_BY.get("p"))
                    if name in CLOSED_BY:
                        for other in SIBLINGS.get(name, (name,)):
                            close(other, CLOSED_BY[name])
                    out.append((f"<{name}{'!' if name not in KEPT and attributes and dropped_by(attributes) else ''}>", ""))
                    opened.append(name)
    out.extend((f"</{x}>", "") for x in reversed(opened))
    if constants:
        out = [(f"={h:016x}", t) if item == "#" and (h := text_key(t)) in constants else (item, t) for item, t in out]
    return out


#: Elements that a closing slash ends at once where pages write them so.
VOID_LIKE = {"button", "select", "menu"}


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(plain(text))


def plain(text: str) -> str:
    return " ".join(html.unescape(text).split())


def dropped_by(attributes: str) -> bool:
    """Does a name of class, id or role stand for a dropped part: one dropped word at least, and neutral ones?"""
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = NAME_PART.findall(name)
            if any(p in DROPPED_WORDS for p in parts) and all(p in DROPPED_WORDS or p in NEUTRAL_WORDS or p.isdigit() for p in parts):
                return True
    return False


# Expressions: a string is an item, ("+", parts) a repeated group, ("?", parts) an optional one.


def repeated_sizes(items: list, least: int) -> Iterator[int]:
    """The sizes, from least on, of runs that stand twice in a row somewhere."""
    numbers: dict = {}
    a = np.array([numbers.setdefault(x, len(numbers)) for x in items])
    for size in range(least, len(a) // 2 + 1):
        same = a[:-size] == a[size:]
        if size == 1:
            if same.any():
                yield size
        elif np.count_nonzero(same) >= size:
            sums = np.cumsum(same)
            if ((sums[size - 1 :] - np.concatenate([[0], sums[:-size]])) == size).any():
                yield size


def fold(items: list) -> list:
    """Adjacent equal runs become one repeated group; shorter runs first, until none is left."""
    least = 1
    while (size := next(repeated_sizes(items, least), None)) is not None:
        out, i, changed = [], 0, False
        while i < len(items):
            unit = items[i : i + size]
            j = i + size
            while len(unit) == size and items[j : j + size] == unit:
                j += size
            if j > i + size:
                out.append(unit[0] if size == 1 and unit[0][0] == "+" else ("+", tuple(unit)))
                i, changed = j, True
            elif size == 1 and out and out[-1] == ("+", (items[i],)):
                i, changed = i + 1, True
            else:
                out.append(items[i])
                i += 1
        items = out
        least = 1 if changed else size + 1
    return items


def bare(node) -> tuple:
    """What a node stands for once its own optional and repeated marks are off."""
    while isinstance(node, tuple):
        if len(node[1]) != 1:
            return tuple(node[1])
        node = node[1][0]
    return (node,)


def cost(node) -> int:
    return sum(map(cost, node[1])) if isinstance(node, tuple) else 1


def unify(a, b):
    """One node for both, or None if they are of different shape."""
    if a == b:
        return a
    if not isinstance(a, tuple) and not isinstance(b, tuple):
        return None
    x, y = bare(a), bare(b)
    if x[0] != y[0] and bare(x[0]) != bare(y[0]):
        return None
    inner = align(list(x), list(y)) if x != y else list(x)
    if all(isinstance(n, tuple) and n[0] == "?" for n in inner):
        return None
    kinds = {n[0] for n in (a, b) if isinstance(n, tuple)}
    out = ("+", tuple(inner)) if "+" in kinds else inner[0] if len(inner) == 1 else ("+", tuple(inner))
    return ("?", (out,)) if "?" in kinds else out


def optional(nodes: list) -> list:
    if not nodes:
        return []
    if len(nodes) == 1 and isinstance(nodes[0], tuple) and nodes[0][0] == "?":
        return nodes
    if all(isinstance(n, tuple) and n[0] == "?" for n in nodes):
        return nodes
    return [("?", tuple(nodes))]


def align(a: list, b: list) -> list:
    """An expression that accepts whatever a or b accepts: a least-cost alignment whose gaps become optional."""
    n, m = len(a), len(b)
    joint = {}
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            if best[i][j] < best[i + 1][j + 1] + cost(a[i]) + cost(b[j]) and (u := unify(a[i], b[j])) is not None:
                joint[i, j] = u
                best[i][j] = max(best[i][j], best[i + 1][j + 1] + min(cost(a[i]), cost(b[j])) * 2)
    out, i, j = [], 0, 0
    left, right = [], []
    while i < n or j < m:
        if (i, j) in joint and best[i][j] == best[i + 1][j + 1] + min(cost(a[i]), cost(b[j])) * 2:
            out += optional(left) + optional(right) + [joint[i, j]]
            left, right = [], []
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i][j] == best[i + 1][j]):
            left.append(a[i])
            i += 1
        else:
            right.append(b[j])
            j += 1
    return out + optional(left) + optional(right)


def grouped(items: list, units: set[tuple]) -> list:
    """Runs that are one turn of a known repeated group become that group."""
    for unit in sorted(units, key=lambda u: (-len(u), repr(u))):
        out, i = [], 0
        while i < len(items):
            if tuple(items[i : i + len(unit)]) == unit:
                out.append(("+", unit))
                i += len(unit)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def units_of(nodes) -> set[tuple]:
    """The units of all repeated groups within."""
    out: set[tuple] = set()
    for n in nodes:
        if isinstance(n, tuple):
            out |= units_of(n[1]) | ({n[1]} if n[0] == "+" else set())
    return out


def flat_items(nodes) -> Counter:
    """The items of an expression, and how often each."""
    out: Counter = Counter()
    for n in nodes:
        if isinstance(n, tuple):
            out += flat_items(n[1])
        else:
            out[n] += 1
    return out


def alike(a: Counter, b: Counter) -> float:
    """The share of items in common, of the smaller one's."""
    return sum((a & b).values()) / max(1, min(sum(a.values()), sum(b.values())))


def merge(expressions: list[list]) -> list[list]:
    """The wrappers of some expressions: each is aligned with the first earlier result that it is like, once both have their repeated groups in common."""
    wrappers: list[tuple[list, Counter]] = []
    for e in sorted(expressions, key=lambda e: (-len(e), repr(e))):
        items = flat_items(e)
        for k, (wrapper, known) in enumerate(wrappers):
            if e == wrapper:
                break
            if alike(items, known) >= ALIKE and len(wrapper) * len(e) < MOST_CELLS:
                units = units_of(wrapper) | units_of(e)
                both = align(fold(grouped(wrapper, units)), fold(grouped(e, units)))
                wrappers[k] = both, flat_items(both)
                break
        else:
            wrappers.append((e, items))
    return [w for w, _ in wrappers]


#: Two expressions are aligned if their lengths' product is under this; longer ones stay apart.
MOST_CELLS = 4_000_000


def write(nodes) -> str:
    """An expression as text: items apart by blanks, groups as ( ... )+ and ( ... )?."""
    return " ".join(n if isinstance(n, str) else f"( {write(n[1])} ){n[0]}" for n in nodes)


def read(text: str) -> list:
    stack: list[list] = [[]]
    for part in text.split(" "):
        if part == "(":
            stack.append([])
        elif part[:1] == ")":
            group = stack.pop()
            stack[-1].append((part[1], tuple(group)))
        elif part:
            stack[-1].append(part)
    return stack[0]


def expression(page: str, constants: frozenset[int] = frozenset()) -> str:
    return write(fold([item for item, _ in tokens(page, constants)]))


def main_region(stream: list[str], weights: list[int]) -> tuple[int, int] | None:
    """[a, b) of the main region in a list of items or nodes: the article or main element with the most text by the weights, else the body."""
    for name in ("article", "main", "body"):
        found, opened = [], []
        for i, n in enumerate(stream):
            if n == f"<{name}>":
                opened.append(i)
            elif n == f"</{name}>" and opened:
                start = opened.pop()
                if not opened:  # an element within another of its name is a part of it
                    found.append((start, i + 1))
        if found:
            return max(found, key=lambda r: (sum(weights[r[0] : r[1]]), -r[0]))
    return None


def weight(item: str, text: str) -> int:
    return len(text) if item == "#" else 0


class Wrapper:
    """An expression compiled to a pattern over one character for each token.

    Groups are possessive, so matching takes one pass: a page that needs a choice taken back isn't accepted.
    """

    def __init__(self, text: str):
        self.letters: dict[str, str] = {}
        self.pattern = re.compile(self.compiled(read(text)), re.S)

    def letter(self, item: str) -> str:
        n = len(self.letters)
        return self.letters.setdefault(item, chr(0xE000 + n if n < 0x1900 else 0xF0000 + n))

    def compiled(self, nodes) -> str:
        return "".join(self.letter(n) if isinstance(n, str) else f"(?:{self.compiled(n[1])}){n[0]}+" for n in nodes)

    def accepts(self, stream: list[Token]) -> bool:
        return self.pattern.fullmatch("".join(self.letters.get(item, "\0") for item, _ in stream)) is not None


def blocks(stream: list[Token]) -> list[str]:
    """The text blocks of a region without constants and dropped elements; of a header the headings are kept."""
    out: list[str] = []
    opened: list[tuple[str, bool]] = []  # open elements, and whether each is out
    for item, text in stream:
        if item == "#":
            if not (opened and opened[-1][1]) and (block := plain(text)):
                out.append(block)
        elif item[0] == "=":
            pass
        elif item[1] == "/":
            if opened:
                opened.pop()
        else:
            name, outside = item.strip("<!>"), bool(opened) and opened[-1][1]
            if outside and name in HEADINGS and [n for n, gone in opened if gone][0] == "header" and opened[0][0] in ("article", "main"):
                gone = False
            else:
                gone = outside or item.endswith("!>") or name in DROPPED
            opened.append((name, gone))
    return out


def main_text(page: str | None, wrappers: list[Wrapper] = (), constants: frozenset[int] = frozenset()) -> str:
    """The text of a page. If a wrapper of its host accepts it, constants are left out; else the page's own elements decide, and all texts count."""
    if not page:
        return ""
    stream = tokens(page, constants)
    if constants and not any(w.accepts(stream) for w in wrappers):
        stream = [("#" if item[0] == "=" else item, text) for item, text in stream]
    region = main_region([item for item, _ in stream], [weight(*t) for t in stream]) or (0, len(stream))
    return "\n".join(blocks(stream[region[0] : region[1]]))


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def with_host(pages: DataFrame, known: DataFrame) -> DataFrame:
    """pages with what is known of their host: broadcast while its measured size allows."""
    sizes = [F.coalesce(F.size(c) * 8 if known.schema[c].dataType.simpleString() == "array<bigint>" else F.aggregate(c, F.lit(0), lambda a, x: a + F.octet_length(x)), F.lit(0)) for c in known.columns if c != "host"]
    size = known.agg(F.sum(sum(sizes, F.octet_length("host")))).first()[0] or 0
    return pages.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")


def find_constants(pages: DataFrame) -> DataFrame:
    """(host, constants): the keys of texts that stand once on nearly all different pages of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = [], []
            for page in batch.column("html"):
                value = page.as_py() or ""
                keys.append(xxhash.xxh3_64_intdigest(value) >> 1)
                times = Counter(text_key(t) for item, t in tokens(value) if item == "#")
                texts.append([signed(h) for h, n in times.items() if n == 1])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(keys, pa.int64()), pa.array(texts, pa.list_(pa.int64()))], names=["host", "page", "texts"])

    different = pages.mapInArrow(run, "host string, page long, texts array<long>").groupBy("host", "page").agg(F.first("texts").alias("texts"))
    different = stage_alone(different, "html-texts")
    sizes = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= CONSTANT_PAGES)
    counted = different.select("host", F.explode("texts").alias("text")).groupBy("host", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CONSTANT_PAGES)
    # a host has no more constants than its pages have texts, over CONSTANT_SHARE
    return counted.join(sizes, "host").where(F.col("n") >= F.col("pages") * CONSTANT_SHARE).groupBy("host").agg(F.array_sort(F.collect_list("text")).alias("constants"))


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def constant_set(values: list[int] | None, known: dict) -> frozenset[int]:
    if not values:
        return frozenset()
    key = tuple(values)
    if key not in known:
        if len(known) > 1000:
            known.clear()
        known[key] = frozenset(v & (2**64 - 1) for v in values)
    return known[key]


def infer_wrappers(pages: DataFrame, constants: DataFrame) -> DataFrame:
    """(host, wrappers) over all pages (host, html): expressions are aligned about TOGETHER at a time, round after round, until no host has more than one group."""

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            seen = {(host.as_py(), expression(page.as_py() or "", constant_set(own.as_py(), known))) for host, page, own in zip(batch.column("host"), batch.column("html"), batch.column("constants"), strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([e for _, e in seen], pa.string())], names=["host", "wrapper"])

    def merged(key: tuple, group: pa.Table) -> pa.Table:
        found = merge([read(e) for e in sorted(set(group.column("wrapper").to_pylist()))])
        return pa.table({"host": pa.array([key[0].as_py()] * len(found), pa.string()), "wrapper": pa.array([write(w) for w in found], pa.string())})

    rows = with_host(pages, constants).select("host", "html", "constants")
    now = stage_alone(rows.mapInArrow(skeletons, "host string, wrapper string").where("wrapper <> ''").distinct(), "html-expressions")
    while True:
        sizes = now.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (most := sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        groups = F.ceil(F.col("n") / TOGETHER)
        dealt = now.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper"), groups))
        now = stage_alone(dealt.groupBy("host", "salt").applyInArrow(merged, "host string, wrapper string").distinct(), "html-expressions")
        left = now.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if left <= MOST_WRAPPERS or left >= most:  # what is left has too little in common
            break
    return now.groupBy("host").agg(F.array_sort(F.collect_set("wrapper")).alias("wrappers"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text, n_chars.

    Null or empty html gives empty text; a null url has the host ''. Repeated rows give a row each, ids are carried as they are; pages of any length are read whole.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    constants = stage(find_constants(rows.select("host", "html")), "html-constants")
    wrappers = infer_wrappers(rows.select("host", "html"), constants)
    known = stage(wrappers.join(constants, "host", "left"), "html-wrappers")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, Wrapper] = {}
        sets: dict = {}
        for batch in batches:
            texts = []
            for page, own, fixed in zip(batch.column("html"), batch.column("wrappers"), batch.column("constants"), strict=True):
                wanted = constant_set(fixed.as_py(), sets)
                found = []
                for w in (own.as_py() or []) if wanted else []:  # without constants a wrapper has nothing to leave out
                    if w not in compiled:
                        if len(compiled) > 1000:
                            compiled.clear()
                        compiled[w] = Wrapper(w)
                    found.append(compiled[w])
                texts.append(main_text(page.as_py(), found, wanted))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, "url", "text", "n_chars"],
            )

    joined = with_host(rows, known)
    return joined.select("id", "url", "html", "wrappers", "constants").mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
