"""Benchmark decontamination by Wu-Manber search for many patterns.

Texts become lists of words; a pattern is a window of 13 consecutive words of a benchmark item, or the whole of a shorter
item. Patterns of one length share a scanner: the last two words under it name a block, the shift table says how far the
scanner may jump, and where it may not jump the bucket of that suffix block, then the first word, select the patterns that a
direct comparison confirms.

The patterns of one pass are bounded: items are dealt to as many passes as their text needs at ``PASS_BYTES`` each. Where one
pass does not do, the texts are written once, each row with a number; a pass reads them and writes only the rows that it hits,
which meet by number in the end, so each row gives one row whatever its id. Defined results: null text has no words and no hits;
an item without words has no pattern; repeated items all count; items without an id count as one item, a null at the end of
``items``; ``contaminated`` needs a hit and a twentieth of the words hit.
"""

from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import beside, discard, fresh, in_parts, kept, kind_of, written

WINDOW, PASS_BYTES = 13, 4_000_000
#: A-Z become a-z; digits, letters and all bytes from 128 on stay; the rest separates words.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Scanner:
    """Wu-Manber tables for the windows of one length in some items (id, words); a window is kept as a place in its item's words."""

    def __init__(self, length: int, items: list[tuple[str | None, list[bytes]]]):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list] = {}
        for item, words in items:
            own = frozenset((item,))
            for end in range(self.block, len(words) + 1):
                block = tuple(words[end - self.block : end])
                self.shift[block] = min(self.shift.get(block, self.jump), max(0, length - end))
                if end >= length:
                    self._add(words, end - length, own)

    def _add(self, words: list[bytes], begin: int, own: frozenset) -> None:
        entries, window = self.bucket.setdefault((*words[begin + self.length - self.block : begin + self.length], words[begin]), []), words[begin : begin + self.length]
        for entry in entries:
            if entry[0][entry[1] : entry[1] + self.length] == window:
                entry[2] = entry[2] | own
                return
        entries.append([words, begin, own])

    def scan(self, words: list[bytes], hit: set[int], found: set[str | None]) -> None:
        """Adds the positions under occurrences and the items that occur."""
        m, block, jump, shift, at, n = self.length, self.block, self.jump, self.shift.get, self.length - 1, len(words)
        while at < n:
            here = (words[at - 1], words[at]) if block == 2 else (words[at],)
            if step := shift(here, jump):
                at += step
                continue
            begin = at - m + 1
            for source, start, items in self.bucket.get((*here, words[begin]), ()):
                if words[begin : at + 1] == source[start : start + m]:
                    hit.update(range(begin, at + 1))
                    found |= items
            at += 1


def scanners(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Scanner]:
    by_length: dict[int, list] = {}
    known: dict[bytes, bytes] = {}
    for item, text in items:
        if words := [known.setdefault(w, w) for w in words_of(text)]:
            by_length.setdefault(min(window, len(words)), []).append((item, words))
    return [Scanner(length, own) for length, own in by_length.items()]


def _pass(rows: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, Broadcast]:
    """rows: some columns, then the text; returns these columns with ``n_words``, ``hits`` and ``items``, and what was sent to the tasks."""
    sent = rows.sparkSession.sparkContext.broadcast((uuid4().hex, [tuple(r) for r in items.collect()]))
    *others, text = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own_items = sent.value
        tables = kept(name, lambda: scanners(own_items, window))  # built once in a worker
        for batch in batches:
            for part in in_parts(batch, len(others), 4_000_000):
                sizes, hits, names = [], [], []
                for own in part.column(len(others)).to_pylist():
                    words, hit, found = words_of(own), set(), set()
                    for table in tables:
                        table.scan(words, hit, found)
                    sizes.append(len(words)), hits.append(sorted(hit)), names.append(sorted(found - {None}) + [None] * (None in found))
                told = [pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *told], names=[*others, "n_words", "hits", "items"])

    shape = [*(f"{c} {kind_of(rows, c)}" for c in others), "n_words bigint", "hits array<int>", "items array<string>"]
    return rows.mapInArrow(run, ", ".join(shape)), sent


def find_items(docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """id, ``n_words``, ``hits`` (positions of hit words) and ``items`` (ids of occurring items) of every row of documents."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    passes = 1 + int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // pass_bytes
    own, text = F.col(id_col).alias("_id"), F.col(text_col).alias("_text")
    if passes == 1:
        found = _pass(docs.select(own, text), items, window)[0]
    else:
        texts = written(docs.select(own, F.monotonically_increasing_id().alias("_row"), text), "texts")
        deal = F.pmod(F.xxhash64("item", F.when(F.col("item").isNull(), F.col("text"))), F.lit(passes))
        parts = []
        for k in range(passes):  # driver and tasks hold the patterns of one pass at a time
            made, sent = _pass(texts if k == 0 else texts.select("_row", "_text"), items.where(deal == k), window)
            parts.append(written(made if k == 0 else made.where(F.size("hits") > 0).drop("n_words"), "pass"))
            sent.destroy()
        discard(texts)
        more = reduce(DataFrame.unionAll, parts[1:]).groupBy("_row").agg(*(F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("hits", "items")))
        told = (F.array_sort(F.array_distinct(F.when(F.col(f"more_{c}").isNull(), F.col(c)).otherwise(F.concat(c, f"more_{c}")))).alias(c) for c in ("hits", "items"))
        found = parts[0].join(more, "_row", "left").select("_id", "n_words", *told)
    return found.select(F.col("_id").alias(id_col), "n_words", "hits", "items")


def is_contaminated() -> Column:
    return (F.size("hits") > 0) & (F.size("hits") * 20 >= F.col("n_words"))


def digest(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(
        id_col,
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """The rows of documents that are not contaminated; each row is judged by its own text, also where ids repeat or are null."""
    h = fresh(docs, "h")
    named = docs.withColumn(h, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    found = find_items(named, h, text_col, benchmark, item_col, item_text_col)
    return beside(named, written(found.where(is_contaminated()).select(h).distinct(), "contaminated"), [h], "left_anti").select(docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least({WINDOW}, len(ws)) AS m, array_to_string(ws[i : i + least({WINDOW}, len(ws)) - 1], ' ') AS win
        FROM b, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) t(i) WHERE len(ws) > 0),
occ AS (SELECT doc_id, i, m, array_to_string(ws[i : i + m - 1], ' ') AS win FROM d, (SELECT DISTINCT m FROM win) s, unnest(range(1, len(ws) - m + 2)) t(i)),
hit AS (SELECT doc_id, i, m, item_id FROM occ JOIN win USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
