"""Main text of web pages by union-free expressions (wrappers) that the pages of a host are aligned to.

A page is a row of tokens: tags of blocks, with their names, and slots of text. An expression has no alternatives:
items stand one after another, each once, optional, repeated or both; an item is a text slot or a tag with an
expression inside; a repeated group holds several items. Two expressions are aligned item by item. What both have is
aligned inside, what only one has becomes optional, neighbours that say the same become one repeated item.

One task never sees a whole host. Pages are first reduced to the expressions of single pages, and equal ones of a host
are counted as one; these are aligned in buckets, then the results in fewer buckets, until a host has one wrapper.
Tasks go through a bucket row by row and hold one expression. What the slots of a wrapper are is decided once a
host, from the names around them, their share of links, and whether their text ever changes. Extraction aligns each
page to its host's wrapper and writes the blocks that come to lie in its content slots.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm._common import Scratch, bounded_batches, hot_join, tidy, written
from lexframe.llm.urlfilter import url_host

# ---- pages as trees of blocks

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title)\b[^<>]*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/<>]*)(?P<more>(?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|</?[A-Za-z][^<>]*>|<[!?][^<>]*>""",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Tags whose start and end part blocks of text.
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption article section main nav header footer aside form fieldset "
    "blockquote pre figure figcaption address details summary hr menu dialog center search hgroup".split()
)
#: A start tag ends the open one of these kinds, if none of the stops is between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_ALONE = frozenset(["hr"])
#: Inline tags that belong to forms; what they hold is no text of a block.
_CONTROLS = frozenset(["button", "label", "option", "legend"])
#: Deeper tags count as children of the one at this depth, so that recursion stays shallow. Texts stay.
_DEPTH = 60
#: Items side by side, after repeats are folded; more become one repeated group of all kinds that occur.
_WIDTH = 64

#: An item is [label, times, inside]: times is a sum of OPTIONAL and REPEATED, inside a list of items or a slot's value.
OPTIONAL, REPEATED = 1, 2
SLOT, ANY = "#", "(*"
Item = list


def _label(tag: str, more: str) -> str:
    """A tag with its names, digits as 0: what two tokens must share to be aligned."""
    if "=" not in more:
        return tag
    names = [f"{a.lower()[0]}:{re.sub(r'[0-9]+', '0', b or c or d)[:80].lower()}" for a, b, c, d in _NAMES.findall(more)]
    return f"{tag} {' '.join(sorted(names))}" if names else tag


class Page:
    """A page's blocks of text, in order, and its items, whose slots hold the numbers of blocks."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.linked: list[int] = []
        self._parts: list[str] = []
        self._links = self._in_link = self._skip = 0
        self._stack: list[tuple[str, list]] = [("", [])]
        self._skipped = ""
        at = 0
        for token in _TOKEN.finditer(source):
            if token.start() > at:
                self._text(source[at : token.start()])
            at = token.end()
            if tag := token["tag"]:
                self._tag(tag.lower(), bool(token["close"]), token["more"])
        self._text(source[at:])
        self._flush()
        self.items = fold(self._stack[0][1], list.__add__)

    def _text(self, part: str) -> None:
        if not self._skip:
            self._parts.append(part)
            if self._in_link:
                self._links += len(part)

    def _flush(self) -> None:
        if self._parts:
            raw = "".join(self._parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                self._stack[-1][1].append([SLOT, 0, [len(self.texts)]])
                self.texts.append(text)
                self.linked.append(min(self._links, len(text)))
            self._parts = []
        self._links = 0

    def _tag(self, tag: str, closes: bool, more: str) -> None:
        if self._skip:  # inside an inline part that is no text
            if tag == self._skipped:
                self._skip += -1 if closes else not more.endswith("/")
            elif tag in BLOCKS:
                self._skip = 0
            if not self._skip:
                self._parts.append(" ")
            if tag not in BLOCKS:
                return
        if tag not in BLOCKS:
            if tag == "a":
                self._in_link = 0 if closes else 1
            elif tag in ("br", "img", "wbr", "input"):
                self._parts.append(" " if tag == "br" else "")
            elif not closes and not more.endswith("/") and (tag in _CONTROLS or ("=" in more and not _label(tag, more) == tag and is_aside(_label(tag, more)))):
                self._skip, self._skipped = 1, tag
            return
        self._flush()
        open_tags = [t for t, _ in self._stack]
        if closes:
            if tag in open_tags:
                del self._stack[len(open_tags) - 1 - open_tags[::-1].index(tag) :]
            return
        kinds, stops = _ENDS.get(tag, ((), ()))
        for i in range(len(open_tags) - 1, 0, -1):
            if open_tags[i] == "p" or open_tags[i] in kinds:
                del self._stack[i:]
                if open_tags[i] != "p":
                    break
            elif open_tags[i] in stops or not kinds:
                break
        item = [_label(tag, more), 0, []]
        if len(self._stack) <= _DEPTH:
            self._stack[-1][1].append(item)
            if tag not in _ALONE:
                self._stack.append((tag, item[2]))
        elif tag not in _ALONE:
            self._stack.append((tag, self._stack[-1][1]))


# ---- expressions

Join = Callable[[list, list], list]


def merged(a: Item, b: Item, join: Join) -> Item:
    """One item for two with the same label."""
    inside = join(a[2], b[2]) if a[0] == SLOT else aligned(a[2], b[2], join)
    return [a[0], a[1] | b[1], inside]


def fold(items: list[Item], join: Join) -> list[Item]:
    """Neighbours that repeat, of up to four items, as one repeated item or group; inside first."""
    for item in items:
        if item[0] != SLOT and item[2]:
            item[2] = fold(item[2], join)
    for width in range(1, 5):
        out: list[Item] = []
        for item in items:
            out.append(item)
            labels = [x[0] for x in out[-2 * width :]]
            if width > 1 and len(out) > width and out[-width - 1][0] == _group_label(out[-width:]) and not out[-width - 1][0].startswith(ANY):
                group, rest = out[-width - 1], out[-width:]
                del out[-width:]
                group[2] = [merged(a, b, join) for a, b in zip(group[2], rest, strict=True)] if len(group[2]) == width else aligned(group[2], rest, join)
            elif len(labels) == 2 * width and labels[:width] == labels[width:]:
                pairs = [merged(a, b, join) for a, b in zip(out[-2 * width : -width], out[-width:], strict=True)]
                del out[-2 * width :]
                out.append([pairs[0][0], pairs[0][1] | REPEATED, pairs[0][2]] if width == 1 else [_group_label(pairs), REPEATED, pairs])
        items = out
    return _narrow(items, join)


def _group_label(items: list[Item]) -> str:
    return "(" + "|".join(x[0] for x in items)


def _narrow(items: list[Item], join: Join) -> list[Item]:
    return [_any(items, join)] if len(items) > _WIDTH else items


def _any(items: list[Item], join: Join) -> Item:
    """A repeated group of all kinds that occur, each optional, in the order of their first places.

    If the names make more kinds than stand side by side at most, tags count without them.
    """
    flat: list[Item] = []
    for x in items:
        flat += x[2] if x[0].startswith("(") else [x]
    if len({x[0] for x in flat}) > _WIDTH:
        flat = [[x[0].split(" ")[0], *x[1:]] for x in flat]
    kinds: dict[str, Item] = {}
    for x in flat:
        kinds[x[0]] = merged(kinds[x[0]], x, join) if x[0] in kinds else x
    return [ANY, OPTIONAL | REPEATED, [[a, b | OPTIONAL, c] for a, b, c in kinds.values()]]


def _grouped(items: list[Item], other: list[Item]) -> list[Item]:
    """items with those runs as groups that are groups in the other expression."""
    for group in other:
        if group[0].startswith("(") and not group[0].startswith(ANY):
            width, out = len(group[2]), []
            for item in items:
                out.append(item)
                if _group_label(out[-width:]) == group[0]:
                    out[-width:] = [[group[0], 0, out[-width:]]]
            items = out
    return items


def aligned(xs: list[Item], ys: list[Item], join: Join) -> list[Item]:
    """The expression that both fit: the longest common row of labels is aligned, all else is optional."""
    xs, ys = _grouped(xs, ys), _grouped(ys, xs)
    if [x[0] for x in xs] == [y[0] for y in ys]:
        return [merged(x, y, join) for x, y in zip(xs, ys, strict=True)]
    if any(x[0] == ANY for x in (*xs, *ys)):
        return [_any([*xs, *ys], join)]
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i in range(len(xs) - 1, -1, -1):
        for j in range(len(ys) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if xs[i][0] == ys[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(xs) or j < len(ys):
        if i < len(xs) and j < len(ys) and xs[i][0] == ys[j][0]:
            out.append(merged(xs[i], ys[j], join))
            i, j = i + 1, j + 1
        elif j == len(ys) or (i < len(xs) and best[i + 1][j] >= best[i][j + 1]):
            out.append([xs[i][0], xs[i][1] | OPTIONAL, xs[i][2]])
            i += 1
        else:
            out.append([ys[j][0], ys[j][1] | OPTIONAL, ys[j][2]])
            j += 1
    return fold(out, join)


def slots(items: list[Item], above: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Item]]:
    """(labels above, slot) of each slot, in order."""
    for item in items:
        if item[0] == SLOT:
            yield above, item
        else:
            yield from slots(item[2], above if item[0].startswith("(") else (*above, item[0]))


def pattern(items: list[Item]) -> str:
    """An expression to read: tags with what is inside, # for text, and ? + * behind what is optional, repeated or both."""
    out = []
    for label, times, inside in items:
        body = SLOT if label == SLOT else f"({pattern(inside)})" if label.startswith("(") else f"{label}{{{pattern(inside)}}}"
        out.append(body + ("", "?", "+", "*")[times])
    return " ".join(out)


# ---- what slots are

#: Fixed: tags that hold none of a page's main text.
ASIDE_TAGS = frozenset(["nav", "aside", "footer", "form", "menu", "dialog", "search"])
#: Fixed: words in the names of parts that hold none of it: menus, headers and footers, sidebars, notices, adverts, forms, comments.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu toolbar topbar breadcrumb breadcrumbs crumbs pagination pager skip "
    "masthead footer footnotes colophon copyright contentinfo "
    "sidebar aside complementary related recommended recommendations trending popular widget widgets share sharing social "
    "notice notices notification alert cookie cookies consent gdpr banner popup modal overlay announcement disclaimer "
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promotion promoted "
    "login signup subscribe subscription newsletter search searchbox form "
    "comment comments commentlist commentary respond responses reply replies disqus discussion".split()
)
#: Fixed: words that a header outside an article goes by, and those of the part that holds the main text.
_HEADER_WORDS, _MAIN_WORDS = frozenset(["header", "head", "hero"]), frozenset(["article", "articlebody", "post", "entry", "story", "content", "main"])
_BUT = frozenset(["with", "has", "no", "without", "hide"])
DROPPED, BODY, NAMED, MAIN, ARTICLE = range(-1, 4)


def _words(label: str) -> list[str]:
    """The words of a tag's names, without those after a word such as `with`."""
    names = [x for x in re.split(r"[^a-z]+", " ".join(x[2:] if x[1:2] == ":" else x for x in label.split(" ")[1:])) if x]
    return [x for i, x in enumerate(names) if i == 0 or names[i - 1] not in _BUT]


_ASIDES: dict[str, bool] = {}


def is_aside(label: str) -> bool:
    """Whether a tag and its names say that what it holds is no main text."""
    if label not in _ASIDES:
        if len(_ASIDES) > 50_000:
            _ASIDES.clear()
        tag = label.split(" ")[0]
        _ASIDES[label] = tag in ASIDE_TAGS or (tag not in ("html", "body", "main") and not ASIDE_WORDS.isdisjoint(_words(label)))
    return _ASIDES[label]


def _rank(above: tuple[str, ...]) -> int:
    """What the tags around a slot say."""
    rank = BODY
    for label in above:
        tag, words = label.split(" ")[0], set(_words(label))
        heads = tag == "header" or (tag != "article" and words & _HEADER_WORDS and not words & _MAIN_WORDS)
        if is_aside(label) or (rank < ARTICLE and heads):
            return DROPPED
        if tag == "article" or "articlebody" in words:
            rank = max(rank, ARTICLE)
        elif tag == "main" or ("main" in words and "r:main" in label):
            rank = max(rank, MAIN)
        elif tag == "h1" or (tag in ("div", "section", "td") and words & _MAIN_WORDS):
            rank = max(rank, NAMED)
    return rank


#: A slot without an own place in an article is a menu if over so much of its text is in links.
_LINKED = 0.5
#: Pages from which text that never changes is taken for the site's own.
_ENOUGH_PAGES = 3
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption".split())


def ranked(items: list[Item]) -> list[Item]:
    """A host's wrapper with a rank in each slot in place of its sums (pages, chars, linked, least and greatest text hash).

    Text that is the same on all pages belongs to the site and not to the article, if it is not marked up as prose and
    other text of the same rank does change. Of what is left, slots of mostly links are menus, but in an article.
    """
    found = [(item, _rank(above), above) for above, item in slots(items)]
    sums = {id(item): item[2] for item, _, _ in found}
    moving = {rank for item, rank, _ in found if item[2][3] != item[2][4]}
    for item, rank, above in found:
        pages, chars, linked, least, most = sums[id(item)]
        plain = above and above[-1].split(" ")[0] in _PROSE
        if rank >= BODY and pages >= _ENOUGH_PAGES and least == most and rank in moving and not plain:
            rank = DROPPED
        if BODY <= rank < ARTICLE and linked > _LINKED * chars:
            rank = DROPPED
        item[2] = rank
    return items


def _joined_sums(a: list, b: list) -> list:
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])]


def _with_ranks(a: object, b: object) -> object:
    """Slots of a wrapper (a rank) and of a page (block numbers) as (rank, blocks); both may be missing or joined before."""
    one, two = (x if isinstance(x, tuple) else (x, []) if isinstance(x, int) else (None, x) for x in (a, b))
    ranks = [x for x in (one[0], two[0]) if x is not None]
    return (max(ranks) if ranks else None, one[1] + two[1])


def page_ranks(wrapper: list[Item], items: list[Item]) -> list[int]:
    """The rank of each slot of a page's folded expression, by aligning it to the wrapper of its host.

    The page's own items are numbered; one that the wrapper lacks is judged by the names around it.
    """
    own = list(slots(items))
    for i, (_, item) in enumerate(own):
        item[2] = [i]
    ranks: list[int] = [_rank(above) for above, _ in own]
    for _, item in slots(aligned(wrapper, items, _with_ranks)):
        if isinstance(item[2], tuple) and item[2][0] is not None:
            for i in item[2][1]:
                ranks[i] = item[2][0]
    return ranks


# ---- on Spark


def _skeletons(pages: DataFrame) -> DataFrame:
    """_host, expr (of one page), at (slot), pages, chars, linked, least, most: summed over pages of one expression."""
    schema = "_host string, expr string, at int, pages long, chars long, linked long, least long, most long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, source in zip(batch.column("_host").to_pylist(), batch.column("_html").to_pylist(), strict=True):
                page = Page(source or "")
                values = []
                for i, (_, item) in enumerate(slots(page.items)):
                    texts = [page.texts[k] for k in item[2]]
                    mark = crc32("\n".join(texts).encode(errors="replace"))
                    values.append([1, sum(map(len, texts)), sum(page.linked[k] for k in item[2]), mark, mark])
                    item[2] = i
                expr = json.dumps(page.items, separators=(",", ":"))
                for i, value in enumerate(values):
                    key = (host, expr, i)
                    sums[key] = _joined_sums(sums[key], value) if key in sums else value
            rows = [(*key, *value) for key, value in sums.items()]
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])
        tidy()

    each = pages.select("_host", "_html").mapInArrow(run, schema)
    sums = [F.sum(x).alias(x) for x in ("pages", "chars", "linked")]
    every = each.groupBy("_host", "expr", "at").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"))
    # One row for an expression; it has no more slots than a page has tags side by side and inside each other.
    values = F.struct("at", F.array("pages", "chars", "linked", "least", "most").alias("sums"))
    return every.groupBy("_host", "expr").agg(F.transform(F.array_sort(F.collect_list(values)), lambda x: x["sums"]).alias("sums"))


def _read(expr: str, sums: list | None) -> list[Item]:
    items = json.loads(expr)
    if sums is not None:
        for (_, item), value in zip(slots(items), sums, strict=True):
            item[2] = value
    return items


#: Expressions of a host that one task aligns, on average, before the results go on to fewer buckets.
_BUCKET = 64


def infer_wrappers(df: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """host, wrapper (JSON: items of [label, times, inside], a slot's inside is its rank), pattern (to read) of each host."""
    return _wrappers(df.select(url_host(df[url].cast("string")).alias("_host"), df[html].cast("string").alias("_html")))


def _wrappers(pages: DataFrame) -> DataFrame:
    bounded_batches(pages.sparkSession)
    held = Scratch(pages.sparkSession)
    level = held.written(_skeletons(pages).withColumn("key", F.xxhash64("expr")), "html-skeletons")
    most = level.groupBy("_host").count().agg(F.max("count")).first()[0] or 0
    buckets = 1
    while buckets * _BUCKET < most:
        buckets *= _BUCKET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, items = None, []

        def made() -> pa.RecordBatch:
            values = [item[2] for _, item in slots(items)]
            for i, (_, item) in enumerate(slots(items)):
                item[2] = i
            columns = [pa.array([place[0]]), pa.array([json.dumps(items, separators=(",", ":"))]), pa.array([values], pa.list_(pa.list_(pa.int64()))), pa.array([place[2]], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["_host", "expr", "sums", "key"])

        for batch in batches:
            for host, expr, sums, key, bucket in zip(*(batch.column(x).to_pylist() for x in ("_host", "expr", "sums", "key", "bucket")), strict=True):
                new = _read(expr, sums)
                if place is not None and place[:2] == (host, bucket):
                    items = aligned(items, new, _joined_sums)
                else:
                    if place is not None:
                        yield made()
                    place, items = (host, bucket, key), new
        if place is not None:
            yield made()

    while True:
        dealt = level.withColumn("bucket", F.pmod("key", F.lit(buckets)))
        ordered = dealt.repartition("_host", "bucket").sortWithinPartitions("_host", "bucket", "expr")
        level = ordered.mapInArrow(run, level.schema)
        if buckets == 1:
            break
        level = held.written(level, "html-level")
        buckets //= _BUCKET

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ranked(_read(expr, sums)) for expr, sums in zip(batch.column("expr").to_pylist(), batch.column("sums").to_pylist(), strict=True)]
            columns = [pa.array([json.dumps(x, separators=(",", ":")) for x in found], pa.string()), pa.array([pattern(x) for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("_host"), *columns], ["host", "wrapper", "pattern"])

    out = written(level.mapInArrow(judged, "host string, wrapper string, pattern string"), "html-wrappers")
    held.clear()
    return out


#: Wrappers are sent to all tasks up to so many bytes; more are joined by host.
BROADCAST_BYTES = 8 << 20


def extract_text(df: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """df with main_text and n_chars (its code points): the main text of each page, its blocks joined by newlines.

    Blocks are what the tags of blocks part; a line break in a block is white space. Character references are decoded, white
    space becomes one space. A wrapper is inferred from all pages of a host; a host of one page has that page's. The text
    is in the slots of the highest rank that a page has text for: an article, else main, else a part named so, else what
    the page has besides menus, headers, footers, sidebars, notices, adverts, forms and comments. Null and empty html give an
    empty text; rows without a host have one wrapper; repeated rows come out each; other columns go through (main_text and
    n_chars are replaced); an empty table gives none.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in ("main_text", "n_chars")]
    pages = df.select(F.struct(*rest).alias("_row"), url_host(df[url].cast("string")).alias("_host"), df[html].cast("string").alias("_html"))
    wrappers = _wrappers(pages.select("_host", "_html")).withColumnRenamed("host", "_host").select("_host", "wrapper")
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("_host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        known = pages.join(F.broadcast(wrappers), "_host", "left")
    else:
        counts = pages.groupBy("_host").agg(F.count("*").alias("_n"))
        known = hot_join(pages, wrappers.join(counts, "_host"), "_host", pages.count(), "left")

    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ranks: dict[tuple, list[int]] = {}
        for sources, found in batches:
            out = []
            for source, wrapper in zip(sources.to_pylist(), found.to_pylist(), strict=True):
                page = Page(source or "")
                places = list(slots(page.items))
                blocks = [item[2] for _, item in places]
                for i, (_, item) in enumerate(places):
                    item[2] = [i]
                key = (wrapper, json.dumps(page.items))
                if key not in ranks:
                    if len(ranks) >= 5000:
                        ranks.clear()
                    ranks[key] = page_ranks(json.loads(wrapper or "[]"), page.items)
                best = max(ranks[key], default=DROPPED)
                kept = sorted(k for rank, some in zip(ranks[key], blocks, strict=True) if rank == best > DROPPED for k in some)
                out.append("\n".join(page.texts[k] for k in kept))
            yield pa.array(out, pa.string())
        tidy()

    found = known.select("_row", text("_html", "wrapper").alias("main_text"))
    return found.select(*(F.col("_row")[c].alias(c) for c in rest), "main_text", F.char_length("main_text").cast("long").alias("n_chars"))
