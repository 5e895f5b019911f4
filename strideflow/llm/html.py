"""HTML extraction by nearest-URL page differencing.

A page becomes text lines, one for each block, with the zone that each stands in: the article, boilerplate (menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, by tag, role, class or id), or neither. Pages are ordered by host and URL
path; each is paired with the neighbour whose path shares the longer prefix with its own (the page before it on equal length). The
lines of the two are aligned by their longest common subsequence, and lines that both hold are deleted, unless they stand in the
article of both: that is content which two pages carry. What is left of the article is the main text; a page without an article
element gives what is left outside the boilerplate, and if nothing is left there, as on a copy of its neighbour, what stood there.

Pages are dealt by ranges of (host, path, page_id), so a host with a third of all pages is spread over many tasks; the first and last page of a
range also go to the range beside it, so every page has both its neighbours and the result does not depend on the ranges. Bounds come from a hash
sample of addresses and the edges from an aggregate, both of at most a few rows a range. Markup is parsed once, and only texts are shuffled.

Null and empty html give the empty text, a null url has the empty
host. Repeated rows each get their own result; rows with equal url and page_id are ordered by their lines. An element that is not closed ends with
the one around it. A long page is handled whole: aligning n and m lines takes memory for n + m. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.llm.storage import shuffle_partitions, tidy

OUTSIDE, ARTICLE, BOILERPLATE = 0, 1, 2

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<closed>noscript|template|svg|math|iframe|object|canvas|audio|video)\b[^>]*>.*?</(?P=closed)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button search select datalist".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
_OWN_PARTS = frozenset("article content entry page post story".split())  # whose header in an article is the article's own
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


def _zone(tag: str, attributes: str, in_article: bool) -> int:
    if tag in _BOILERPLATE_TAGS or tag == "header" and not in_article:
        return BOILERPLATE
    zone = ARTICLE if tag in ("article", "main") else OUTSIDE
    if attributes:
        for kind, *value in _NAME.findall(attributes):
            value = "".join(value).lower()
            if kind.lower() == "role":
                if value in _BOILERPLATE_ROLES:
                    return BOILERPLATE
                zone = ARTICLE if value in ("main", "article") else zone
            elif tag not in ("html", "body", "main") and not (tag == "header" and in_article):
                names = _BOILERPLATE_NAMES.intersection(parts := _PART.findall(value))
                if names and not (in_article and names == {"header"} and not _OWN_PARTS.isdisjoint(parts)):
                    return BOILERPLATE
    return zone


def page_lines(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of each block of a page that has text."""
    if not page:
        return []
    lines: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that have a zone, or may be closed out of order
    depth = [0, 0, 0]

    def flush() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        if text:
            lines.append((text, BOILERPLATE if depth[BOILERPLATE] else ARTICLE if depth[ARTICLE] else OUTSIDE))
        buffer.clear()

    def pop() -> str:
        tag, zone = stack.pop()
        depth[zone] -= 1
        return tag

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        block = tag in _BLOCKS
        if block or tag == "br":
            if block:
                flush()
            else:
                buffer.append(" ")
        if tag in _VOID or m["attributes"].endswith("/"):
            continue
        if m["end"]:
            if any(t == tag for t, _ in stack):
                flush()
                while pop() != tag:
                    pass
            continue
        if block and stack and stack[-1][0] == "p":
            pop()
        zone = _zone(tag, m["attributes"], depth[ARTICLE] > 0)
        if zone == BOILERPLATE or block:
            if zone == BOILERPLATE:
                flush()
            stack.append((tag, zone))
            depth[zone] += 1
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return lines


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a and each beginning of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return row


def _align(a: np.ndarray, b: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, shifted by (i, j), in space linear in both: a is halved, and b where the halves' lengths add up to most."""
    if not len(a) or not len(b):
        return []
    if len(a) == 1:
        found = np.flatnonzero(b == a[0])
        return [(i, j + int(found[0]))] if len(found) else []
    half = len(a) // 2
    k = int((_last_row(a[:half], b) + _last_row(a[half:][::-1], b[::-1])[::-1]).argmax())
    return _align(a[:half], b[:k], i, j) + _align(a[half:], b[k:], i + half, j + k)


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence: equal ends first, then an alignment of the lines that both hold."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    pairs = [(k, k) for k in range(low)]
    both = {line: k for k, line in enumerate(sorted(set(a[low : len(a) - high]) & set(b[low : len(b) - high])))}
    if both:
        x = [k for k in range(low, len(a) - high) if a[k] in both]
        y = [k for k in range(low, len(b) - high) if b[k] in both]
        pairs += [(x[i], y[j]) for i, j in _align(np.array([both[a[k]] for k in x]), np.array([both[b[k]] for k in y]), 0, 0)]
    return pairs + [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]


def main_text(lines: list[tuple[str, int]], other: list[tuple[str, int]] | None) -> str:
    """The main text of a page, given its neighbour's lines."""
    shared = set()
    if other:
        pairs = common_lines([t for t, _ in lines], [t for t, _ in other])
        shared = {i for i, j in pairs if not lines[i][1] == other[j][1] == ARTICLE}
    wanted = ARTICLE if any(z == ARTICLE for _, z in lines) else OUTSIDE
    kept = [t for i, (t, z) in enumerate(lines) if z == wanted and i not in shared]
    return " ".join(kept or [t for t, z in lines if z == wanted])


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lines = [page_lines(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([[t for t, _ in x] for x in lines], pa.list_(pa.string())), pa.array([[z for _, z in x] for x in lines], pa.list_(pa.int8()))],
                    ["page_id", "url", "texts", "zones"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64).to_pydict()
                    for row in zip(*(part[k] for k in ("page_id", "url", "host", "path", "texts", "zones", "part", "guest")), strict=True):
                        yield (*row[:4], list(zip(row[4], row[5], strict=True)), *row[6:])
            yield None

        out: list[tuple] = []
        before, this = None, None
        for after in rows():
            if this is not None and not this[6]:
                near = [(_shared_prefix(this[3], n[3]), k, n[4]) for k, n in ((1, before), (0, after)) if n is not None and n[2] == this[2] and n[5] == this[5]]
                out.append((this[0], this[1], main_text(this[4], max(near, key=lambda n: n[:2])[2] if near else None)))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=result)
                    out = []
            before, this = this, after
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=result)

    result = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    lines = rows.mapInArrow(tidy(parse), "page_id long, url string, texts array<string>, zones array<tinyint>")
    n = shuffle_partitions(pages.sparkSession)
    addresses = rows.select(_address("url", "page_id").alias("address"))
    drawn = addresses.distinct().orderBy(F.xxhash64("address"), "address").limit(32 * n).collect()  # decides speed alone
    bounds = sorted((tuple(r.address) for r in drawn), key=_order)[::4]  # 8 ranges a task, so that tasks are even
    part = _part(bounds)
    ends = addresses.groupBy(part(F.col("address")).alias("part")).agg(F.min("address").alias("low"), F.max("address").alias("high")).orderBy("part").collect()  # one row for each range
    guests = [(tuple(r.high), after.part) for r, after in zip(ends, ends[1:], strict=False)] + [(tuple(r.low), before.part) for before, r in zip(ends, ends[1:], strict=False)]
    extra = pages.sparkSession.createDataFrame([(a, p) for a, p in guests], f"address {ADDRESS}, guest_part int")
    own = F.struct(part(_address("url", "page_id")).alias("part"), F.lit(False).alias("guest"))
    placed = lines.select("page_id", "url", "texts", "zones", own.alias("own"), _address("url", "page_id").alias("a")).select("*", "a.host", "a.path")
    by_page = extra.groupBy("address").agg(F.collect_list(F.struct(F.col("guest_part").alias("part"), F.lit(True).alias("guest"))).alias("guests"))
    by_page = by_page.select(F.col("address.host").alias("g_host"), F.col("address.path").alias("g_path"), F.col("address.page_id").alias("g_page"), "guests")
    same = (F.col("host") == F.col("g_host")) & (F.col("path") == F.col("g_path")) & F.col("page_id").eqNullSafe(F.col("g_page"))
    dealt = placed.join(F.broadcast(by_page), same, "left")  # at most two rows a range
    dealt = dealt.select("page_id", "url", "host", "path", "texts", "zones", F.explode(F.concat(F.array("own"), F.coalesce("guests", F.array().cast("array<struct<part:int,guest:boolean>>")))).alias("to"))
    dealt = dealt.select("page_id", "url", "host", "path", "texts", "zones", "to.part", "to.guest")
    ordered = dealt.repartition(n, "part").sortWithinPartitions("part", "host", "path", "page_id", F.xxhash64("texts"), "guest")
    return ordered.mapInArrow(tidy(compare), "page_id long, url string, text string")


ADDRESS = "struct<host:string,path:string,page_id:bigint>"


def _address(url: str, page_id: str) -> Column:
    """Where a page stands in the order."""
    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.struct(host.alias("host"), path.alias("path"), F.col(page_id).alias("page_id"))


def _order(address: tuple) -> tuple:
    """Spark's order: strings by bytes, null first."""
    return address[0].encode(), address[1].encode(), address[2] is not None, address[2] or 0


def _part(bounds: list[tuple]) -> Callable[[Column], Column]:
    """The number of bounds that are less than an address."""
    if not bounds:
        return lambda address: F.lit(0)
    table = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(i).cast("long").alias("page_id")) for h, p, i in bounds])
    between = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))

    def halve(s: Column, address: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        return F.when(s["low"] >= s["high"], s).when(F.get(table, middle) < address, between(middle + 1, s["high"])).otherwise(between(s["low"], middle))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return lambda address: F.aggregate(steps, between(F.lit(0), F.lit(len(bounds))), lambda s, _: halve(s, address))["low"]
