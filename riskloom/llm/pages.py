"""Main text of web pages by differencing against the page of the nearest URL.

Versions of pages (equal lines under one path are one) lie in the order of host, URL path and digest; each is paired with the neighbour
in that order, of the same host and other lines, that shares the longer beginning of the path. Both become lines (one per block); the longest common subsequence of the
two line lists is what the site repeats, and those lines are deleted. This is done for every page.

Differencing alone cannot give right results: articles share passages, and adverts differ from page to page. So an exact check of
the markup follows: deleted blocks inside article or main come back, and of those left, blocks inside menus, headers, footers,
sidebars, notices, adverts, forms and comments (by tag, class, id or role) go, on a page that has an article also blocks
outside it. ``n_restored`` and ``n_rejected`` tell how often the check spoke against differencing, which deleted ``n_shared`` of ``n_blocks``.

Lines are compared by 64 bits of a hash, so only these and not the texts meet their neighbours; texts are shuffled once, to their decision.

Defined results: null or empty html, and pages of boilerplate alone, give the empty text; copies of a page under other URLs
are skipped as neighbours, since they would delete everything; repeated rows give repeated results; tags may be unclosed.
"""

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b, md5
from html import unescape
from math import isqrt
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import discard, in_parts, kind_of, written

UNKNOWN, CONTENT, BOILERPLATE = 0, 1, 2
KEY, COUNTS = ["host", "path", "digest"], ["n_blocks", "n_shared", "n_restored", "n_rejected"]
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|select|button|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_OUT = frozenset("nav footer aside form head menu dialog fieldset".split())
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_OUT_WORDS = frozenset("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer form header hidden login menu modal nav navbar navigation newsletter notice popup promo related replies reply responses search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
_WORD = re.compile(r"[a-z]+")


def _state(tag: str, marks: str, outer: int) -> int:
    if outer == BOILERPLATE or tag in _OUT or (tag == "header" and outer != CONTENT):
        return BOILERPLATE
    if marks:
        words = {w for found in _MARK.findall(marks) for w in _WORD.findall("".join(found).lower())}
        if words & _OUT_WORDS and tag not in ("html", "body", "article", "main"):
            return BOILERPLATE
        if "main" in words or "article" in words:
            return CONTENT
    return CONTENT if tag in ("article", "main") else outer


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order with their states; white space inside a block is one space."""
    html = html or ""
    out, texts, stack, at = [], [], [], 0

    def end_block() -> None:
        line = " ".join(unescape("".join(texts)).split())
        texts.clear()
        if line:
            out.append((line, stack[-1][1] if stack else UNKNOWN))

    for token in _TOKEN.finditer(html):
        if token.start() > at:
            texts.append(html[at : token.start()])
        at = token.end()
        tag = (token[3] or "").lower()
        if tag == "br":
            texts.append(" ")
        elif tag in _BLOCKS:
            end_block()
            if token[2]:
                if any(x[0] == tag for x in stack):
                    while stack.pop()[0] != tag:
                        pass
            elif tag != "hr" and not (token[4] or "").rstrip().endswith("/"):
                if tag == "body":
                    stack = [x for x in stack if x[0] not in ("head", "title")]
                if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
                    stack.pop()
                stack.append((tag, _state(tag, token[4], stack[-1][1] if stack else UNKNOWN)))
    texts.append(html[at:])
    end_block()
    return out


def common(a: list, b: list) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    A row of the table of lengths is one number whose bits tell where the length does not grow; a row follows from the one above by
    an addition. Every so many rows one is kept, and the way back makes those between anew, so n lines against m take about
    n * m / 64 steps and sqrt(n) * m / 4 bytes, however many of them are equal.
    """
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]))) if x != y), min(len(a), len(b)) - head)
    out = {*range(head), *range(len(a) - tail, len(a))}
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    masks = {line: _bits(where, len(b)) for line, where in places.items()}
    full, step = (1 << len(b)) - 1, isqrt(len(a)) + 1

    def below(row: int, line: str | bytes) -> int:
        shared = row & masks.get(line, 0)
        return ((row + shared) | (row - shared)) & full

    kept, row = [full], full
    for i, line in enumerate(a, 1):
        row = below(row, line)
        if i % step == 0:
            kept.append(row)
    i, j = len(a), len(b)
    while i and j:
        first = (i - 1) // step * step
        rows = [kept[first // step]]
        for line in a[first:i]:
            rows.append(below(rows[-1], line))
        raw = [x.to_bytes(len(b) // 8 + 1, "little") for x in rows]
        grows = lambda k, j: not raw[k - first][(j - 1) >> 3] >> ((j - 1) & 7) & 1  # noqa: B023, E731
        while i > first and j:
            if not grows(i, j):
                j -= 1
            elif grows(i - 1, j):
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.add(head + i)
    return out


def _bits(places: list[int], size: int) -> int:
    raw = bytearray(size // 8 + 1)
    for j in places:
        raw[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(raw, "little")


def decided(states: list[int], shared: set[int]) -> list[bool]:
    """Which blocks are the text: those that differencing leaves, after the check of the markup."""
    article = CONTENT in states
    return [state == CONTENT or (state == UNKNOWN and not article and i not in shared) for i, state in enumerate(states)]


def differenced(page: list[tuple[str, int]], neighbour: list[tuple[str, int]] | None) -> str:
    """The text of a page beside its neighbour."""
    shared = common([x for x, _ in page], [x for x, _ in neighbour]) if neighbour else set()
    return "\n\n".join(line for (line, _), kept in zip(page, decided([x for _, x in page], shared)) if kept)


def _shared(path: str, other: str | None) -> int:
    return -1 if other is None else len(commonprefix([path, other]))


def _versions(lined: DataFrame) -> DataFrame:
    """host, path, digest and ``other``: the digest of the neighbour, the one before on a tie, null on a host of one version.

    Versions lie in the order of host, path and digest; a version's neighbours are the last one of other lines before it and the first one
    after it. Ranges of that order are looked through in Spark, and each range's edge goes on to the next, so neither the number
    of ranges nor a run of copies changes a neighbour."""
    order = KEY
    dealt = lined.select(order).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    out = held = written(dealt, "versions")
    key = F.struct("host", "path", "digest")
    for name, way in (("before", 1), ("after", -1)):
        within = Window.partitionBy("part").orderBy(*(F.asc(c) if way == 1 else F.desc(c) for c in order))
        parts = Window.orderBy(F.asc("part") if way == 1 else F.desc("part"))  # a row for each range, not for each page
        # the version next to it in the order, over the range's edge too
        edge = held.groupBy("part").agg((F.max(key) if way == 1 else F.min(key)).alias("edge"))
        near = held.join(F.broadcast(edge.select("part", F.lag("edge").over(parts).alias("edge"))), "part")
        near = near.select("part", *order, F.coalesce(F.lag(key).over(within), "edge").alias("near"))
        # where that has other lines, it is the neighbour of the whole run of copies that begins there
        begins = (F.col("near.host") != F.col("host")) | (F.col("near.digest") != F.col("digest")) | F.col("near").isNull()
        begun = near.select("part", *order, F.when(begins, F.struct(F.when(F.col("near.host") == F.col("host"), F.col("near")).alias("near"))).alias("start"))
        last = begun.groupBy("part").agg(F.max_by("start", F.when(F.col("start").isNotNull(), key)) if way == 1 else F.min_by("start", F.when(F.col("start").isNotNull(), key))).toDF("part", "last")
        carried = last.select("part", F.last("last", True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
        told = F.coalesce(F.last("start", True).over(within.rowsBetween(Window.unboundedPreceding, 0)), "carried")["near"]
        out = out.join(begun.join(F.broadcast(carried), "part").select(*order, told.alias(name)), order)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            other = [r["d1"] if _shared(r["path"], r["p1"]) >= _shared(r["path"], r["p2"]) else r["d2"] for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(other, pa.binary())], names=[*order, "other"])

    pairs = out.select(*order, *(F.col(f"{side}.{c}").alias(f"{c[0]}{i}") for i, side in ((1, "before"), (2, "after")) for c in ("path", "digest")))
    return pairs.mapInArrow(chosen, "host string, path string, digest binary, other binary")


def _differences(lined: DataFrame) -> DataFrame:
    """host, path, digest, which blocks of each version are ``kept``, and the counts."""
    lines = lined.groupBy("digest").agg(F.min("lines").alias("lines"))
    both = _versions(lined).join(lines, "digest").join(lines.toDF("other", "beside"), "other", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for own, beside in zip(*(batch.column(x).to_pylist() for x in ("lines", "beside"))):
                (hashes, states), (others, _) = _unpacked(own), _unpacked(beside or b"")
                shared = common(hashes, others)
                kept = decided(states, shared)
                told.append((kept, len(states), len(shared), sum(kept[i] for i in shared), len(states) - len(shared) - sum(k and i not in shared for i, k in enumerate(kept))))
            columns = [pa.array([x[i] for x in told], t) for i, t in enumerate([pa.list_(pa.bool_()), *[pa.int64()] * 4])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), *columns], names=[*KEY, "kept", *COUNTS])

    return both.mapInArrow(run, f"host string, path string, digest binary, kept array<boolean>, {', '.join(f'{c} bigint' for c in COUNTS)}")


def _packed(page: list[tuple[str, int]]) -> bytes:
    """Eight bytes of a hash of each line, then a byte for each state."""
    return b"".join(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest() for line, _ in page) + bytes(state for _, state in page)


def _unpacked(packed: bytes) -> tuple[list[bytes], list[int]]:
    n = len(packed) // 9
    return [packed[i : i + 8] for i in range(0, 8 * n, 8)], list(packed[8 * n :])


def extract(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, ``text`` and the counts of blocks of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), "^[a-zA-Z]*:?//([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce(url_col, F.lit("")), "^(?:[a-zA-Z]*:?//[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))

    def parsed(others: int, name: str, made: Callable[[list[tuple[str, int]]], object], kind: pa.DataType) -> Callable:
        """Reads the html behind so many other columns: its digest and what is made of its lines take its place."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in in_parts(batch, others, 2_000_000):
                    found = [lines_of(x) for x in part.column(others).to_pylist()]
                    digests = [md5(repr(x).encode("utf-8", "surrogatepass")).digest() for x in found]
                    columns = [*part.columns[:others], pa.array(digests, pa.binary()), pa.array([made(x) for x in found], kind)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:others], "digest", name])

        return run

    def blocks_of(page: list[tuple[str, int]]) -> list[str | None]:
        """The blocks that may be in the text, whatever differencing says; nulls hold the places of the others."""
        return [line if may else None for (line, _), may in zip(page, decided([x for _, x in page], set()))]

    lined = rows.select("host", "path", "html").mapInArrow(parsed(2, "lines", _packed, pa.binary()), "host string, path string, digest binary, lines binary")
    lined = written(lined.dropDuplicates(KEY), "lines")
    told = written(_differences(lined), "told")
    discard(lined)
    kinds = f"id {kind_of(pages, id_col)}, url string, host string, path string, digest binary, blocks array<string>"
    blocks = rows.mapInArrow(parsed(4, "blocks", blocks_of, pa.list_(pa.string())), kinds)
    text = F.array_join(F.zip_with("blocks", "kept", lambda block, kept: F.when(kept, block)), "\n\n")
    return blocks.join(told, KEY).select("id", "url", text, *COUNTS).toDF(id_col, url_col, "text", *COUNTS)
