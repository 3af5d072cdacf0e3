"""Main text of web pages by union-free regular expressions inferred per host.

A page becomes a balanced token stream (block elements, text; inline elements are transparent), kept
as a tree.  Neighbouring blocks of one kind fold to a repeated group.  Streams of one host are then
aligned again and again: text against text is a slot (constant while all pages agree), a block that
only one side has becomes optional, one block against several a repeated group.  The result is the
host's wrapper, an expression of sequence, optional and repeated groups without unions.  Its slots
are labelled: 0 boilerplate, else by where they stand: 3 inside an article element, 2 inside a block so named, 1 other
content.  Boilerplate are menus, forms, notices, comments and the like by their tags and names, and slots that
different pages hold unchanged (copies of a page count as one page) where their place speaks for the template too.
Inside an article or main block that takes ``MANY`` different pages, a slot that no page lacks, a place before the
first or behind the last slot that varies, and an element that is not prose (heading, paragraph, quote, table and the
like): a constant headline, a quote that all articles share or a short host's repeated words stay.  Outside, two
pages do for other elements, and ``FEW`` for prose before or behind all that varies; prose between varying slots stays.  A page's text is
what its slots above 0 hold; those of a higher label alone if they hold at least as much as those of each lower
label, so a card in an article element does not stand for the story beside it.

Scale: pages reduce to distinct (host, stream) pairs in the scan; wrappers grow over *all* streams of a
host by a tree: groups of about ``FAN`` streams are merged, then groups of the results, each round cut to the shared folder,
so no task sees more than a group, however many streams a host has.  A wrapper goes once to each group of
streams that it labels.  Labels come back as one short string per (host, stream), and texts
are cut out in a second scan that shuffles no text where the label table is small (checked).

Defined cases: null or empty html gives an empty text; a null address is a host of its own; unclosed
elements close where the next block demands it, unclosed comments and scripts run to the end; elements
nested deeper than ``DEPTH`` count as their ancestor; repeated rows get equal results; pages of any length are read
whole; of labels that hold equally much the higher one counts; an empty table gives no rows.  Only the three named
columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut

FAN, DEPTH, TANDEM, BROADCAST_BYTES = 64, 200, 4, 32 << 20
#: Different pages that must agree on a slot: on prose outside articles, and on a slot in an article.
FEW, MANY = 3, 8

# HTML element classes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object select xmp noembed noframes".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
BOILER_TAGS = frozenset("head nav footer aside form menu button dialog fieldset header".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre table figure figcaption dl address details".split())
# Words of class, id and role names.
BOILER_WORDS = frozenset("ad ads advert advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr "
                         "notice alert popup modal overlay comment comments disqus reply replies respond sidebar side aside "
                         "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related "
                         "recommended newsletter subscribe subscription signup login search widget toolbar pagination pager "
                         "skip copyright legal disclaimer hidden complementary contentinfo".split())
ARTICLE_WORDS = frozenset("article main".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^>"']|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")


class Item:
    """A block (sig, children) or a text slot (sig '#') with its repetition flags."""

    __slots__ = ("sig", "children", "opt", "rep", "pieces", "pages", "const")

    def __init__(self, sig: str, children: list | None = None, opt: bool = False, rep: bool = False):
        self.sig, self.children, self.opt, self.rep = sig, children if children is not None else [], opt, rep
        self.pieces: list[int] = []  # of slots: numbers of the text pieces of a page
        self.pages: tuple[str, ...] = ()  # of slots: page contents that have it (the least MANY)
        self.const: str | None = None  # of slots: the text all pages share


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def signature(name: str, tag: str) -> str:
    """Element name with the telling words of its class, id and role."""
    if "=" not in tag:
        return name
    words = set()
    for m in MARKS.finditer(tag):
        words.update(NAME_PART.findall((m[1] or m[2] or m[3] or "").lower()))
    told = sorted(words & BOILER_WORDS | words & ARTICLE_WORDS)
    return f"{name}.{'.'.join(told)}" if told else name


def parse(page: str) -> tuple[Item, list[str]]:
    """The folded tree of a page and its text pieces; a piece that begins a block starts with a blank."""
    root = Item("^")
    stack, pieces, at, n = [root], [], 0, len(page)

    def text(raw: str) -> None:
        said = entities.unescape(raw) if "&" in raw else raw
        flat = " ".join(said.split())
        top = stack[-1].children
        slot = top[-1] if top and top[-1].sig == "#" else None
        if not flat:
            if slot and said:
                pieces.append(" ")
                slot.pieces.append(len(pieces) - 1)
            return
        lead, tail = said[0].isspace() or slot is None, said[-1].isspace()
        if slot is None:
            slot = Item("#")
            top.append(slot)
        pieces.append((" " if lead else "") + flat + (" " if tail else ""))
        slot.pieces.append(len(pieces) - 1)

    def close() -> None:
        item = stack.pop()
        item.children = fold(item.children)

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at, tag = m.end(), m[0]
        named = NAME.match(tag)
        if not named:
            continue
        name = named[1].lower()
        if tag[1] == "/":
            if name == "br":
                text(" ")
            elif any(x.sig.partition(".")[0] == name for x in stack):
                while stack[-1].sig.partition(".")[0] != name:
                    close()
                close()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                text(" ")
            continue
        if name in RAW:
            if not tag.endswith("/>") or name in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        sig = signature(name, tag)
        if (name in INLINE and sig == name) or len(stack) > DEPTH:
            continue
        closing = CLOSED_BY.get(name, ())
        while len(stack) > 1 and (stack[-1].sig.partition(".")[0] in closing or stack[-1].sig.partition(".")[0] == "p" and name not in INLINE):
            close()
        item = Item(sig)
        stack[-1].children.append(item)
        if not tag.endswith("/>"):
            stack.append(item)
    while stack:
        close()
    return root, pieces


def merge(a: Item, b: Item) -> Item:
    """The expression that both items of one kind match."""
    out = Item(a.sig, None, a.opt or b.opt, a.rep or b.rep)
    if a.sig == "#":
        out.pieces = a.pieces + b.pieces
        out.pages = a.pages if a.pages == b.pages else tuple(sorted({*a.pages, *b.pages})[:MANY])
        out.const = a.const if a.const == b.const else None
    else:
        out.children = align(a.children, b.children)
    return out


def fold(items: list[Item]) -> list[Item]:
    """Neighbouring blocks of one kind become a repeated block, neighbouring runs a repeated group."""
    out: list[Item] = []
    for x in items:
        if out and x.sig != "#" and out[-1].sig == x.sig:
            out[-1] = merge(out[-1], x)
            out[-1].rep = True
        else:
            out.append(x)
    for size in range(2, TANDEM + 1):
        k = 0
        while k + 2 * size <= len(out):
            sigs = [x.sig for x in out[k:k + size]]
            runs = 1
            while [x.sig for x in out[k + runs * size:k + (runs + 1) * size]] == sigs:
                runs += 1
            if runs > 1:
                group = Item("()", out[k:k + size], rep=True)
                for r in range(1, runs):
                    group = merge(group, Item("()", out[k + r * size:k + (r + 1) * size], rep=True))
                out[k:k + runs * size] = [group]
            k += 1
    return out


def align(xs: list[Item], ys: list[Item]) -> list[Item]:
    """Longest common alignment of two sequences; what one side lacks is optional."""
    head = 0
    while head < len(xs) and head < len(ys) and xs[head].sig == ys[head].sig:
        head += 1
    tail = 0
    while tail < len(xs) - head and tail < len(ys) - head and xs[-1 - tail].sig == ys[-1 - tail].sig:
        tail += 1
    a, b = xs[head:len(xs) - tail], ys[head:len(ys) - tail]
    middle: list[Item] = []
    if a and b:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i].sig == b[j].sig else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i].sig == b[j].sig:
                middle.append(merge(a[i], b[j]))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                middle.append(optional(a[i]))
                i += 1
            else:
                middle.append(optional(b[j]))
                j += 1
        a, b = a[i:], b[j:]
    middle += [optional(x) for x in a] + [optional(y) for y in b]
    return ([merge(x, y) for x, y in zip(xs[:head], ys[:head])] + middle
            + [merge(x, y) for x, y in zip(xs[len(xs) - tail:], ys[len(ys) - tail:])])


def optional(x: Item) -> Item:
    out = Item(x.sig, x.children, True, x.rep)
    out.pieces, out.pages, out.const = x.pieces, x.pages, x.const
    return out


def slots(item: Item) -> list[Item]:
    if item.sig == "#":
        return [item]
    return [s for c in item.children for s in slots(c)]


def expression(item: Item) -> str:
    """The expression as text: ``name(...)`` with ``+`` and ``?``; slots are ``#``."""
    inner = "#" if item.sig == "#" else f"{item.sig}({' '.join(map(expression, item.children))})"
    return inner + ("+" if item.rep else "") + ("?" if item.opt else "")


def dump(item: Item) -> list:
    if item.sig == "#":
        return ["#", int(item.opt), item.pages, item.const]
    return [item.sig, int(item.opt), int(item.rep), [dump(c) for c in item.children]]


def load(data: list) -> Item:
    if data[0] == "#":
        out = Item("#", opt=bool(data[1]))
        out.pages, out.const = tuple(data[2]), data[3]
        return out
    return Item(data[0], [load(c) for c in data[3]], bool(data[1]), bool(data[2]))


def _digest(said: str) -> str:
    return hashlib.md5(said.encode("utf-8", "surrogatepass")).hexdigest()[:12]


def from_page(page: str) -> tuple[Item, list[str], list[int]]:
    """Tree, pieces and, per piece, the number of the slot that holds it (slots in order)."""
    root, pieces = parse(page)
    where = [0] * len(pieces)
    shown = sorted(p for place in placed(root) if not place.boiler for p in place.slot.pieces)
    page_id = _digest("".join(pieces[p] for p in shown))  # reposts with other menus or adverts are copies
    for k, s in enumerate(slots(root)):
        for p in s.pieces:
            where[p] = k
        s.pages, s.const = (page_id,), _digest("".join(pieces[p] for p in sorted(s.pieces)))
    return root, pieces, where


class Place(NamedTuple):
    """Where a slot stands: its level (3 in an article element, 2 in a block named so, else 0), whether in boilerplate,
    the outermost article it is in (or none), and whether prose holds it and a page may lack it there."""

    slot: Item
    level: int
    boiler: bool
    region: int
    prose: bool
    lacking: bool


def placed(root: Item) -> Iterator[Place]:
    """The slots of a tree, in order, with their places."""
    def walk(item: Item, at: Place) -> Iterator[Place]:
        at = at._replace(lacking=at.lacking or item.opt)
        if item.sig == "#":
            yield at._replace(slot=item)
            return
        name, *words = item.sig.split(".")
        level = at.level
        if name == "article":
            level = 3
        elif name == "main" or name in ("div", "section", "td") and any(w in ARTICLE_WORDS for w in words):
            level = max(level, 2)
        # the header of an article is part of it
        told = {name} & BOILER_TAGS | set(words) & BOILER_WORDS if name not in ("html", "body", "article", "main") else set(words) & {"comment", "comments", "sidebar"}
        boiler = at.boiler or bool(told - {"header"} if level else told)
        enters = bool(level) and not at.level  # what lacks in a whole article tells nothing about its parts
        at = at._replace(level=level, boiler=boiler, region=id(item) if enters else at.region, prose=at.prose or name in PROSE,
                         lacking=at.lacking and not enters)
        for c in item.children:
            yield from walk(c, at)

    return walk(root, Place(root, 0, False, 0, False, False))


def labels(wrapper: Item) -> dict[int, int]:
    """Label of each slot of a wrapper by its id(): 3 in an article element, 2 in a block named so,
    1 other content, 0 boilerplate or fixed."""
    out: dict[int, int] = {}
    regions: dict[int, list[Place]] = {}
    for place in placed(wrapper):
        out[id(place.slot)] = 0 if place.boiler else place.level or 1
        if not place.boiler:
            regions.setdefault(place.region, []).append(place)
    for region, places in regions.items():
        varies = [k for k, x in enumerate(places) if x.slot.const is None or len(x.slot.pages) < 2]
        if not varies and (region or len(regions) == 1):
            continue  # the pages do not tell text from template
        first, last = (varies[0], varies[-1]) if varies else (len(places), -1)
        for k, x in enumerate(places):
            outer = k < first or k > last
            agree = len(x.slot.pages) if x.slot.const is not None else 0
            if region:
                fixed = agree >= MANY and outer and not x.prose and not x.lacking
            else:
                fixed = agree >= FEW and outer if x.prose else agree >= 2
            if fixed:
                out[id(x.slot)] = 0
    return out


def label_stream(wrapper: Item, stream: Item) -> str:
    """The labels of a stream's slots, one digit each, by aligning it with its host's wrapper."""
    mine = slots(stream)
    for k, s in enumerate(mine):
        s.pieces = [k]
    for s in slots(wrapper):
        s.pieces = []
    whole = merge(wrapper, stream)
    given = labels(whole)
    out = {p: given[id(s)] for s in slots(whole) for p in s.pieces}
    return "".join(str(out[k]) for k in range(len(mine)))


def _sample_text(column: pa.Array, i: int) -> str:
    return column[i].as_py() or ""


STREAM = "host string, key string, stream string"


def streams(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, key and stream of the distinct streams, merged over the pages of a batch."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        for b in batches:
            seen: dict[tuple[str, str], Item] = {}
            for i in range(b.num_rows):
                root, _, _ = from_page(_sample_text(b.column(1), i))
                at = (host_of(b.column(0)[i].as_py()), expression(root))
                seen[at] = merge(seen[at], root) if at in seen else root
            yield pa.RecordBatch.from_arrays([
                pa.array([h for h, _ in seen], pa.string()), pa.array([_key(e) for _, e in seen], pa.string()),
                pa.array([json.dumps(dump(x)) for x in seen.values()], pa.string())], names=["host", "key", "stream"])

    return pages.select(col(url_col).cast("string"), col(html_col).cast("string")).mapInArrow(task, STREAM)


def _key(expr: str) -> str:
    return hashlib.md5(expr.encode("utf-8", "surrogatepass")).hexdigest()


def _merged(rows: list[str]) -> str:
    sys.setrecursionlimit(20_000)
    whole = None
    for r in rows:
        item = load(json.loads(r))
        whole = item if whole is None else merge(whole, item)
    return json.dumps(dump(whole))


def _dealt(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the number of a group of about ``FAN`` rows of their host (by the hash of column ``name``), and
    the number of groups of each host."""
    groups = rows.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("groups"))
    return rows.join(groups, "host").withColumn("part", F.pmod(F.xxhash64(name), F.col("groups"))), groups


def infer(found: DataFrame) -> DataFrame:
    """host, wrapper: the streams of a host aligned in groups of about ``FAN``, then the groups' results, until one is left."""
    def merged(keys, f):
        import pandas as pd
        order = f.sort_values(["key", "stream"])
        return pd.DataFrame({"host": [keys[0]], "key": [str(keys[1])], "stream": [_merged(order["stream"].tolist())]})

    while True:
        dealt, groups = _dealt(found.select("host", "key", "stream"), "key")
        found = cut(dealt.groupBy("host", "part").applyInPandas(merged, STREAM))
        if groups.where("groups > 1").isEmpty():
            return found.select("host", F.col("stream").alias("wrapper"))


def label_table(found: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, key, labels of every distinct stream."""
    def task(keys, streams_of, wrapper):
        import pandas as pd
        sys.setrecursionlimit(20_000)
        out = [label_stream(load(json.loads(wrapper["wrapper"].iloc[0])), load(json.loads(s))) for s in streams_of["stream"]]
        return pd.DataFrame({"host": streams_of["host"], "key": streams_of["key"], "labels": out})

    dealt, groups = _dealt(found.groupBy("host", "key").agg(F.min("stream").alias("stream")), "key")
    sent = wrappers.join(groups, "host").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    filled = sent.join(dealt.select("host", "part").distinct(), ["host", "part"], "left_semi")  # a hash may leave a group empty
    return (dealt.select("host", "part", "key", "stream").groupBy("host", "part")
            .cogroup(filled.select("host", "part", "wrapper").groupBy("host", "part"))
            .applyInPandas(task, "host string, key string, labels string"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    found = cut(streams(pages, url_col, html_col))
    table = cut(label_table(found, infer(found)))
    if (table.agg(F.sum(F.octet_length("host") + F.octet_length("labels") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        table = F.broadcast(table)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(20_000)
        piece = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))
        for b in batches:
            hosts, keys, said = [], [], []
            for i in range(b.num_rows):
                root, pieces, where = from_page(_sample_text(b.column(2), i))
                hosts.append(host_of(b.column(1)[i].as_py()))
                keys.append(_key(expression(root)))
                said.append([{"slot": s, "text": p} for s, p in zip(where, pieces)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array(keys, pa.string()),
                                              pa.array(said, piece)], names=["page_id", "url", "host", "key", "said"])

    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    read = rows.mapInArrow(task, "page_id long, url string, host string, key string, said array<struct<slot:int,text:string>>")
    marked = F.transform("said", lambda p: F.struct(F.substring(F.col("labels"), p["slot"] + 1, F.lit(1)).alias("label"), p["text"].alias("text")))

    def chars(label: str) -> Column:
        return F.aggregate("said", F.lit(0), lambda n, p: n + F.when(p["label"] == label, F.char_length(p["text"])).otherwise(0))

    three, two, one = (F.col("n")[k] for k in range(3))
    want = (F.when((three > 0) & (three >= two) & (three >= one), "3").when((three + two > 0) & (three + two >= one), "2").otherwise("1"))
    kept = F.filter("said", lambda p: p["label"] >= F.col("want"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda p: p["text"]), ""), " +", " "))
    return (read.join(table, ["host", "key"], "left").withColumn("said", marked).withColumn("n", F.array(*map(chars, "321")))
            .withColumn("want", want).select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")))
