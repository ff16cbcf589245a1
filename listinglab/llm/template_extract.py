"""Main texts of pages, by the templates that pages of a host have in common.

Tokens of a page are its tags and its blocks of text, each told apart by the path of elements it
stands in. Tokens of a host's pages with the same occurrence vector (how often each page has
them) form an equivalence class. A class is kept if it stands on nearly all pages, has several
tokens, has them in one order on each page, again and again if they repeat, and always in the
same slot between the tokens of the host's largest class that stands once on each page: so the
classes nest. They are the host's template; what it leaves over are slots. Texts of the
template are no content. Among the slots, those within navigation, headers, footers, forms and
the like aren't either; of the others, those in an article (or main part, or content element) are
the text, else those in the element that holds most of the host's unlinked text.

Vectors are never gathered: a hash of (page, count) is xor-ed over pages, so that equal sums
mean equal vectors, and Spark sums them up before and after the shuffle.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import BLOCK, VOID, Elements, attributes, events
from ..sources.shared import dropped, stored
from .common import small_batches

# Elements, roles, and words of class names that are no content.
NO_CONTENT = frozenset("aside audio button canvas dialog footer form head header iframe input menu nav noscript object script search select style svg template textarea title video".split())
NO_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted related recommended reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tagcloud teaser toolbar tooltip topbar widget widgets".split()
)
HEADER = frozenset(("header", "masthead"))
CONTENT = frozenset("article articlebody content entry main post story".split())
NOT_IF = frozenset(("with", "without", "has", "no", "not", "is"))
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

KEEP, SOFT, HEADINGS, HARD = range(4)  # whether an element's text is content
REST, CONTENT_CLASS, MAIN, ARTICLE = range(4)  # how surely it is


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed & (2**64 - 1))


def _words(names: str) -> list[list[str]]:
    parts = [re.split(r"[-_:]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", n).lower()) for n in names.split()]
    return [p for p in parts if not NOT_IF.intersection(p)]


def _standing(name: str, attrs: dict[str, str], above: tuple[int, int]) -> tuple[int, int]:
    """Whether, and how surely, the text of an element is content."""
    drop, level = above
    if drop == HARD:
        return above
    words = _words(attrs.get("class", "") + " " + attrs.get("id", ""))
    role, page = attrs.get("role", "").lower(), name in ("html", "body", "main")
    noise = not page and any(p[0] in NOISE or p[-1] in NOISE for p in words) and not any(p in (["article"], ["content"], ["main"]) for p in words)
    header = name == "header" or not page and name != "article" and any(p[-1] in HEADER for p in words)
    if drop == HEADINGS and name in HEADING:
        drop = KEEP
    if header and role != "search":
        return (HEADINGS if level >= MAIN else HARD), level
    if noise or role in NO_ROLE or "hidden" in attrs or name in NO_CONTENT:
        return (SOFT if name in ("form", "nav") and not noise else HARD), level
    if name == "article" or "articlebody" in attrs.get("itemprop", "").lower():
        return (KEEP if drop == SOFT else drop), ARTICLE
    if name == "main" or role == "main":
        return (KEEP if drop == SOFT else drop), max(level, MAIN)
    if any(p[0] in CONTENT or p[-1] in CONTENT for p in words):
        return drop, max(level, CONTENT_CLASS)
    return drop, level


class Page:
    """A page's blocks of text that may be content, and its tokens, in order.

    blocks: (text, frame, level, unlinked characters); tokens: hashes; at: for each token the
    number of its block, -1 for a tag; frames: (path, frame above, depth) of each element."""

    def __init__(self, page: str) -> None:
        self.blocks: list[tuple[str, int, int, int]] = []
        self.tokens: list[int] = []
        self.at: list[int] = []
        self.frames: list[tuple[int, int, int]] = [(0, -1, 0)]
        state, inline = [(KEEP, REST)], set()
        stack, top, held, links, linked = Elements(), 0, [], 0, 0

        def flush() -> None:
            nonlocal held, linked
            text = " ".join("".join(held).split())
            if text:
                line = top
                while line in inline:
                    line = self.frames[line][1]
                self.tokens.append(_hash(text, self.frames[line][0] + 1))
                self.at.append(len(self.blocks))
                self.blocks.append((text, line, state[line][1], max(0, len(text) - linked)))
            held, linked = [], 0

        for kind, name, more in events(page):
            if kind == "text":
                if state[top][0] == KEEP:
                    held.append(name)
                    linked += len(name) if links else 0
            elif name == "br":
                held.append(" ")
            elif kind == "open":
                links += name == "a"
                if name in BLOCK:
                    flush()
                for was in stack.implied(name):
                    top = self.frames[was][1]
                attrs = attributes(more) if more.strip(" /") else {}
                stands = _standing(name, attrs, state[top])
                if name in VOID or name not in BLOCK and stands[0] == state[top][0]:
                    continue
                named = attrs.get("id", "")
                path = _hash(f"{name}.{attrs.get('class', '')}#{'' if re.search('[0-9]', named) else named}", self.frames[top][0])
                self.tokens.append(path)
                self.at.append(-1)
                if name not in BLOCK:  # within a line, and no content
                    inline.add(len(self.frames))
                    stands = stands[0], state[top][1]
                self.frames.append((path, top, self.frames[top][2] + 1))
                state.append(stands)
                top = len(self.frames) - 1
                stack.push(name, top)
            else:
                links = max(0, links - (name == "a"))
                if name in BLOCK:
                    flush()
                for was in stack.close(name):
                    top = self.frames[was][1]
        flush()
        self.level = max((b[2] for b in self.blocks), default=REST)

    def region(self) -> list[int]:
        """The blocks that stand where content most surely is."""
        return [k for k, b in enumerate(self.blocks) if b[2] == self.level]

    def mass(self) -> list[int]:
        """Unlinked characters in each element; none if some part is marked as content."""
        out = [0] * len(self.frames)
        if self.level == REST:
            for _, frame, _, chars in self.blocks:
                out[frame] += chars
            for k in range(len(out) - 1, 0, -1):
                out[self.frames[k][1]] += out[k]
        return out

    def text(self, template: frozenset[int], main: int | None, share: float) -> str:
        """The content: blocks of the region that are not of the template."""
        keep = self.region()
        if self.level == REST and keep:
            mass = self.mass()
            within = [False] * len(self.frames)
            if main is None or all(f[0] != main for f in self.frames):
                k = max((f[2], mass[k], -k) for k, f in enumerate(self.frames) if mass[k] >= share * mass[0])
                main = self.frames[-k[2]][0]
            for k, (path, above, _) in enumerate(self.frames):
                within[k] = path == main or above >= 0 and within[above]
            keep = [k for k in keep if within[self.blocks[k][1]]]
        if template:
            of = {k: t for t, k in zip(self.tokens, self.at, strict=True) if k >= 0}
            keep = [k for k in keep if of[k] not in template]
        return "\n".join(self.blocks[k][0] for k in keep)


# -- workers ---------------------------------------------------------------------------------

PROFILE = "host string, page long, tokens array<long>, chars array<int>, uniq array<long>, times array<int>, mass array<struct<path:long,depth:int,chars:long>>"


def _longs(values: list[int]) -> list[int]:
    return np.array(values, np.uint64).view(np.int64).tolist()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the templates are made of: each page's tokens, with the characters of its region's
    blocks, and the text in its larger elements."""
    mass_type = pa.list_(pa.struct([("path", pa.int64()), ("depth", pa.int32()), ("chars", pa.int64())]))
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), mass_type)
    names = [c.split()[0] for c in PROFILE.split(", ")]
    for b in batches:
        out = []
        for host, page, html in zip(*(b.column(k).to_pylist() for k in ("host", "page", "html")), strict=True):
            p = Page(html)
            if not p.tokens:
                continue
            region = set(p.region())
            counts = Counter(p.tokens)
            mass, big = p.mass(), {}
            for (path, _, depth), chars in zip(p.frames, mass, strict=True):
                if chars and 10 * chars >= mass[0]:
                    big[path, depth] = big.get((path, depth), 0) + chars
            out.append((host, page, _longs(p.tokens), [len(p.blocks[k][0]) if k in region else 0 for k in p.at], _longs(list(counts)), list(counts.values()), [{"path": x, "depth": d, "chars": c} for x, d, c in zip(_longs([k[0] for k in big]), [k[1] for k in big], big.values(), strict=True)]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


ORDER = "host string, class long, least long, most long, taken long, whole long"


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each class stands on pages: a hash of its order and slot (0: none), and the region's
    characters that it takes; class null: of the whole region."""
    for b in batches:
        out: dict = {}
        for host, tokens, chars, classes in zip(*(b.column(k).to_pylist() for k in ("host", "tokens", "chars", "classes")), strict=True):
            of = {t: k for k, c in enumerate(classes) for t in c["tokens"]}
            once = [(len(c["tokens"]), -k) for k, c in enumerate(classes) if c["once"]]
            root = -max(once)[1] if once else -1
            rounds: list[list[list]] = [[] for _ in classes]
            slot, taken = 0, [0] * len(classes)
            for t, n in zip(tokens, chars, strict=True):
                k = of.get(t)
                if k is None:
                    continue
                taken[k] += n
                slot += k == root
                if not rounds[k] or t == rounds[k][-1][0][0]:
                    rounds[k].append([])
                rounds[k][-1].append((t, -1 if k == root else slot))
            for k, c in enumerate(classes):
                kinds = {(tuple(t for t, _ in r), r[0][1], r[-1][1]) for r in rounds[k]}
                if not kinds:
                    continue
                order, first, last = next(iter(kinds))
                fine = len(kinds) == 1 and first == last and len(order) == len(c["tokens"])
                sign = (_hash(repr((order, first)), 0) >> 1) | 1 if fine else 0
                least, most, chars_k = out.get((host, c["id"]), (sign, sign, 0))
                out[host, c["id"]] = min(least, sign), max(most, sign), chars_k + taken[k]
            out[host, None] = 0, 0, out.get((host, None), (0, 0, 0))[2] + sum(chars)
        rows = [(h, c, a, z, n if c is not None else 0, n if c is None else 0) for (h, c), (a, z, n) in out.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), *[pa.int64()] * 5))], [c.split()[0] for c in ORDER.split(", ")])


def _texts(share: float):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset[int], int | None]] = {}
        for b in batches:
            out = []
            for host, html, drop, main in zip(*(b.column(k).to_pylist() for k in ("host", "html", "drop", "main")), strict=True):
                if host not in known:
                    known = {} if len(known) > 1000 else known
                    known[host] = frozenset(x & (2**64 - 1) for x in drop or ()), None if main is None else main & (2**64 - 1)
                out.append(Page(html).text(*known[host], share))
            text = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text, pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return texts


# -- the operator ----------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end; else empty."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, least: int = 5, support: float = 0.9, most: float = 0.5, share: float = 0.6) -> DataFrame:
    """The templates of `pages` (page_id, url, html) by host: (host, drop, main).

    drop: hashes of the tokens of valid classes; main: path of the deepest element that holds
    `share` of the host's unlinked text, null where pages mark their content. Hosts with fewer
    than `least` pages that hold anything have no template, as chance makes any vectors equal.
    support: the share of a host's pages that a class must stand on, once or more. Where all
    valid classes together would take more than `most` of the region's text, pages are copies
    of each other rather than of one template: then drop is empty.

    A host's classes have no more tokens than one of its pages. A host of many pages is summed
    up before the shuffle, and its pages are dealt out by the adaptive skew join."""
    spark = pages.sparkSession
    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("page"), F.coalesce("html", F.lit("")).alias("html"))
    with small_batches(spark):
        seen = stored(rows.mapInArrow(_profiles, PROFILE), "profiles")
    hosts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    counted = seen.select("host", "page", F.explode(F.arrays_zip("uniq", "times")).alias("x")).groupBy("host", F.col("x.uniq").alias("token"))
    vectors = counted.agg(F.count(F.lit(1)).alias("pages"), F.sum("x.times").alias("total"), F.bit_xor(F.xxhash64("page", "x.times")).alias("vector")).where(F.col("pages") >= least)
    vectors = vectors.join(hosts, "host").where(F.col("pages") >= support * F.col("n"))
    classes = vectors.groupBy("host", "vector", "pages", "total").agg(F.sort_array(F.collect_list("token")).alias("tokens")).where(F.size("tokens") > 1)
    classes = stored(classes.select("host", F.col("tokens")[0].alias("id"), "tokens", (F.col("pages") == F.col("total")).alias("once")), "classes")
    of_host = classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("id", "tokens", "once"))).alias("classes"))
    with small_batches(spark):
        stands = seen.select("host", "tokens", "chars").join(of_host, "host").mapInArrow(_orders, ORDER)
        judged = stored(stands.groupBy("host", "class").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("taken").alias("taken"), F.sum("whole").alias("whole")), "judged")
    valid = judged.where("class is not null and least = most and least <> 0")
    fits = valid.groupBy("host").agg(F.sum("taken").alias("taken")).join(judged.where("class is null").select("host", "whole"), "host").where(F.col("taken") <= most * F.col("whole")).select("host")
    drop = classes.join(valid.select("host", F.col("class").alias("id")), ["host", "id"]).join(fits, "host").groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("drop"))
    mass = seen.select("host", F.explode("mass").alias("m")).groupBy("host", "m.path").agg(F.max("m.depth").alias("depth"), F.sum("m.chars").alias("chars")).join(hosts.select("host"), "host")
    large = mass.join(mass.where("depth = 0").select("host", F.col("chars").alias("whole")), "host").where(F.col("chars") >= share * F.col("whole"))
    main = large.groupBy("host").agg(F.max_by("path", F.struct("depth", "chars", "path")).alias("main"))
    out = stored(drop.join(main, "host", "full"), "templates")
    dropped(seen, classes, judged)
    return out


def extract(pages: DataFrame, share: float = 0.6, **how) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of `pages` (page_id, url, html).

    Blocks of the text are joined by one newline; in a block, white space is one space, and
    character references are decoded. A null page is empty, and an empty page has an empty text;
    a null url, or one without `://`, belongs to the host "". Repeated rows stay, other columns
    are left out. Nothing of the content is cut off. `how`: see `templates`."""
    known = templates(pages, share=share, **how)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).join(known, "host", "left")
    with small_batches(pages.sparkSession):
        out = stored(rows.select("page_id", "url", "host", "html", "drop", "main").mapInArrow(_texts(share), "page_id long, url string, text string, n_chars long"), "texts")
    dropped(known)
    return out
