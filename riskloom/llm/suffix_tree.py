"""Language-model scores from a probabilistic suffix tree over words.

Tokens are lower-cased words and one end per document. The tree's states are contexts of up to two words. A context, and a word
after it, enters from ``LEAST`` training occurrences on, a bar that does not move with the input, so the tree grows with the
corpus; a context is retained when its next-word distribution diverges from that of the context without its first word:
count * KL >= ``DIVERGENCE``. Next-word distributions are smoothed by absolute discounting: what the discount frees goes to
the shorter context in proportion to its own distribution, down to the words' own frequencies (add a half). A text is scored
word by word in the state of its longest retained suffix.

The log of that probability is a sum over the word, its pair and its triple: log base(c) + rest(b) + gain(b, c) + rest(a, b) +
gain(a, b, c), each part 0 where the tree has none. All but the last word of a document are followed by one, so a document's
score is its base score plus a sum of times * value over its own n-grams. The values are a table in Spark, one per n-gram. N-grams
are counted, and meet their values, in buckets of their keys (about ``ROOM`` n-grams each, so their number grows with the input):
tasks count what they read, Spark shuffles packed slices to the buckets, and numpy merges one bucket at a time. About ``HOT`` of the
most frequent n-grams (and ``MOST`` words) are also sent to the tasks, which only spares them the shuffle, and a filter of at most
``BITS`` bits keeps most n-grams with a part that occurs less than ``LEAST`` times, or without a value, out of the shuffles; what it
lets through wrongly is dropped by count or lookup, so no result depends on those bounds. Words outside that table are known by 63
bits of their hash.

Corpus counts cover all training documents. Counts of words outside the bounded table of frequent ones reach the documents by a
join, so every count is exact. Defined results: null text is the empty text, which has the end as its only token; without
training documents all probabilities are uniform over one unseen word; each row is scored by its own text, also where ids repeat
or are null; repeated texts count each time.
"""

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskloom.llm.common import discard, giving_back, in_parts, kind_of, release, written

LEAST, MOST, HOT, BITS, ROOM, DISCOUNT, DIVERGENCE = 2, 200_000, 500_000, 1 << 28, 1_000_000, 0.5, 8.0
P1, P2 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F
SLICE, STATS = ["bucket", "kind", "keys", "own"], ["id", "row", "n_tokens", "hot", "base", "full", "rare"]
LOWER, END = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256)), b"\x00"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, then the end (a byte that no word consists of alone is its sign)."""
    return [w + b" " if w == END else w for w in (text or "").encode().translate(LOWER).split()] + [END]


_LOW, _VALUE = np.frombuffer(LOWER, np.uint8), np.random.default_rng(9).integers(1, 1 << 64, 256, np.uint64)


def _powers(size: int, held: list[np.ndarray] = [np.ones(1, np.uint64)] * 2) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd number and of its inverse modulo 2^64, kept in the worker."""
    if len(held[0]) < size:
        size = max(size, 1 << 20)
        held[:] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, x, np.uint64))) for x in (P1, pow(P1, -1, 1 << 64))]
    return held[0][:size], held[1][:size]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each run of bytes: a polynomial over random values of the bytes, from differences of running sums, then mixed."""
    up, down = _powers(len(data) + 1)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)]))
    out = (sums[end] - sums[start]) * down[start]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(P2)
    return out ^ (out >> np.uint64(32))


def hashes_of(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.array([len(x) for x in words], np.int64))
    return word_hashes(np.frombuffer(b"".join(words), np.uint8), np.append(np.zeros(1, np.int64), ends[:-1])[: len(words)], ends)


class Lines:
    """All words of some texts, each text with its end: ``hash`` of each, its text (``owner``) and ``place`` there; ``word(i)`` gives the bytes."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        low = _LOW[np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]]
        bounds = bounds - bounds[0]
        space = (low == 32) | ((low >= 9) & (low <= 13))
        edge = np.zeros(len(low) + 1, bool)
        edge[bounds] = True
        before, after = edge.copy(), edge.copy()
        before[1:] |= space
        after[:-1] |= space
        start = np.flatnonzero(~space & before[:-1])
        end = np.flatnonzero(~space & after[1:]) + 1
        of = np.searchsorted(bounds[1:], start, "right")
        hashes = word_hashes(low, start, end)
        signs = hashes_of([END, END + b" "])
        lone = (end - start == 1) & (low[start] == 0)
        hashes[lone] = signs[1]
        self.sizes = np.bincount(of, minlength=len(texts)) + 1
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.hash = np.full(len(self.owner), signs[0])
        self._low, self._start, self._end = low, np.full(len(self.owner), -1), np.zeros(len(self.owner), np.int64)
        at = np.arange(len(start)) + of
        self.hash[at], self._start[at], self._end[at] = hashes, start, end

    def words(self, which: np.ndarray) -> list[bytes]:
        """The bytes of the words at some places of the list."""
        low = self._low.tobytes()
        own = (END if i < 0 else low[i:j] for i, j in zip(self._start[which].tolist(), self._end[which].tolist()))
        return [END + b" " if i >= 0 and w == END else w for w, i in zip(own, self._start[which].tolist())]


def _counts(docs: DataFrame, text_col: str) -> DataFrame:
    """word, n: partial counts per task, then one shuffle by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 0, 1_000_000):
                lines = Lines(part.column(0))
                first, n = _distinct(lines.hash)[1:]
                yield pa.RecordBatch.from_arrays([pa.array(lines.words(first), pa.binary()), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select(text_col).mapInArrow(giving_back(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Numbers:
    """Numbers of words from their hashes: places in the table of frequent ones, and negative hashes for others."""

    def __init__(self, known: dict[bytes, int]):
        hashes = hashes_of(list(known))
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], np.array(list(known.values()), np.int64)[order]

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "places": self.places}

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash and its place for each slot of the low bits: of several the lowest place, others are searched. Each worker makes its own."""
        order = np.argsort(-self.places, kind="stable")
        size = 1 << (2 * len(self.hashes)).bit_length()
        at = (self.hashes[order] & np.uint64(size - 1)).view(np.int64)
        hashes, places = np.full(size, self.hashes[0]), np.full(size, self.places[0], np.int32)
        hashes[at], places[at] = self.hashes[order], self.places[order]
        return hashes, places

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return (hashes | np.uint64(1 << 63)).view(np.int64)
        kept, places = self.slots
        at = (hashes & np.uint64(len(kept) - 1)).view(np.int64)
        out, missed = places[at].astype(np.int64), np.flatnonzero(kept[at] != hashes)
        others = hashes[missed]
        at = np.minimum(np.searchsorted(self.hashes, others), len(self.hashes) - 1)
        out[missed] = np.where(self.hashes[at] == others, self.places[at], (others | np.uint64(1 << 63)).view(np.int64))
        return out


def hashed(*columns: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Spark's xxhash64 of bigint columns; ``first`` is that of columns before these."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    out = np.full(len(columns[0]), 42, np.uint64) if first is None else first.view(np.uint64)
    for column in columns:
        out = (out + p5 + np.uint64(8)) ^ (turned(column.view(np.uint64) * p2, 31) * p1)
        out = turned(out, 27) * p1 + p4
        for shift, by in ((33, p2), (29, p3)):
            out = (out ^ (out >> np.uint64(shift))) * by
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _lists(rows: DataFrame, text_col: str, sent) -> DataFrame:
    """sizes, ids: the numbers of all words of some texts, packed; a row for about a million bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, 0, 1_000_000):
                lines = Lines(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([_planes(x)], pa.binary()) for x in (lines.sizes, sent.value(lines.hash))], names=["sizes", "ids"])

    return rows.select(text_col).mapInArrow(giving_back(run), "sizes binary, ids binary")


def _planes(numbers: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, and so on: small or sorted numbers leave runs that compress."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _numbers(planes: bytes, kind: type = np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _order(keys: np.ndarray) -> np.ndarray:
    """The places of unsigned keys in rising order, of equal ones the earlier first. Numpy sorts numbers much faster than it finds their
    order, so places are sorted behind the keys' leading bits; the rest is in order but for the few keys that only differ further on."""
    low = np.uint64(max(len(keys) - 1, 1).bit_length())
    order = (np.sort(keys >> low << low | np.arange(len(keys), dtype=np.uint64)) & (np.uint64(1) << low) - np.uint64(1)).view(np.int64)
    sorted_keys = keys[order]
    return order if (sorted_keys[1:] >= sorted_keys[:-1]).all() else order[np.argsort(sorted_keys, kind="stable")]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in rising order, the first place of each and how often it occurs."""
    order = _order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[starts], order[starts], np.diff(np.append(starts, len(keys)))


def _slices(keys: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple]:
    """The bucket of each run of sorted keys (unsigned), and that run of all columns as planes of bytes."""
    to = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(to)]):
        yield int(to[i]), *(_planes(x[..., i:j]) for x in columns)


def _joined(held: list[np.ndarray]) -> np.ndarray:
    """Arrays of equal first dimension side by side; the list is emptied on the way, so they are held about once."""
    out, at = np.empty((held[0].shape[0], sum(x.shape[1] for x in held)), held[0].dtype), 0
    held.reverse()
    while held:
        own = held.pop()
        out[:, at : at + own.shape[1]] = own
        at += own.shape[1]
    return out


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of some MB: a batch is held by the worker and the executor at once."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds.values())], names=list(kinds))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds.values())], names=list(kinds))


def _filter(keys: DataFrame) -> np.ndarray:
    """Bits that are set at two places of every key: all keys pass ``_passes``, and few others while the bits suffice."""
    bits = 1 << 16
    wanted = 8 * keys.count()
    while bits < min(wanted, BITS):
        bits *= 2

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            waiting += batch.num_rows
            if waiting > 500_000:
                yield pages(np.concatenate(held))
                held, waiting = [], 0
        if waiting:
            yield pages(np.concatenate(held))

    def pages(keys: np.ndarray) -> pa.RecordBatch:
        places = np.sort(np.concatenate([(keys >> np.uint64(x)) & np.uint64(bits - 1) for x in (0, 32)]).astype(np.int64))
        page, places = places >> 16, (places & 0xFFFF).astype(np.uint16)
        starts = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(page[starts]), pa.array([x.tobytes() for x in np.split(places, starts[1:])], pa.binary())], names=["page", "places"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, np.zeros(1 << 16, bool)
        for batch in batches:
            for page, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page != at:
                    if at >= 0:
                        yield made(at, held)
                    at, held = page, np.zeros(1 << 16, bool)
                held[np.frombuffer(places, np.uint16)] = True
        if at >= 0:
            yield made(at, held)

    def made(page: int, held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["page", "bits"])

    places = keys.mapInArrow(dealt, "page bigint, places binary").repartition("page").sortWithinPartitions("page")
    out = np.zeros((bits >> 16, 1 << 13), np.uint8)
    for row in places.mapInArrow(packed, "page bigint, bits binary").toArrow().to_pylist():
        out[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


_BIT = np.array([128 >> i for i in range(8)], np.uint8)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out, room = np.zeros(len(keys), bool), len(bits) * 8 - 1
    at = keys & room
    left = np.flatnonzero(bits[at >> 3] & _BIT[at & 7])
    at = keys[left] >> 32 & room  # the second place, where the first is set
    out[left] = bits[at >> 3] & _BIT[at & 7] > 0
    return out


def _grams(lists: DataFrame, total: int, allowed, order: int) -> DataFrame:
    """b, c, n (order 1) or a, b, c, n (order 2): word pairs or triples that occur ``LEAST`` times or more, of those whose words or pairs pass the filter."""
    buckets = total // ROOM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for sizes, ids in zip(*(x.to_pylist() for x in batch.columns)):
                sizes, ids = _numbers(sizes), _numbers(ids)
                place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                at = np.flatnonzero(place >= 1)
                if order == 1:
                    kept = ids >= 0
                    rare = np.flatnonzero(~kept)
                    kept[rare] = _passes(allowed.value, hashed(ids[rare]))
                else:
                    kept = np.zeros(len(ids), bool)
                    kept[at] = _passes(allowed.value, hashed(ids[at - 1], ids[at]))
                    at = at[place[at] >= 2]
                at = at[kept[at] & kept[at - 1]]
                held.append(np.stack([ids[at - k] for k in reversed(range(order + 1))]))
                waiting += len(at)
                if waiting > 1_000_000:
                    yield from dealt(held)
                    waiting = 0
        if waiting:
            yield from dealt(held)

    def dealt(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words = _joined(held)
        keys, first, counts = _distinct(hashed(*words).view(np.uint64))
        words, counts = words[:, first], counts.astype(np.int32)
        del first
        yield from _batches(_slices(keys, buckets, words, counts), {"bucket": pa.int64(), "words": pa.binary(), "times": pa.binary()})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, own = None, [], []
        for batch in batches:
            for bucket, words, times in zip(*batch.columns):
                if held and bucket.as_py() != at:
                    yield from counted(held, own)
                at = bucket.as_py()
                held.append(_numbers(words.as_buffer()).reshape(order + 1, -1))
                own.append(_numbers(times.as_buffer(), np.int32).reshape(1, -1))
        if held:
            yield from counted(held, own)

    def counted(held: list[np.ndarray], own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, times = _joined(held), _joined(own)[0]
        keys = hashed(*words).view(np.uint64)
        turn = _order(keys)
        keys = keys[turn]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        del keys
        n = np.add.reduceat(times[turn], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        words, n = words[:, turn[starts[n >= LEAST]]], n[n >= LEAST]
        del turn, starts, times
        for i in range(0, len(n), 50_000):
            yield pa.RecordBatch.from_arrays([*(pa.array(x[i : i + 50_000]) for x in words), pa.array(n[i : i + 50_000])], names=[*names, "n"])

    names = ["a", "b", "c"][2 - order :]
    dealt_out = lists.mapInArrow(giving_back(run), "bucket bigint, words binary, times binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt_out.mapInArrow(giving_back(merged), ", ".join(f"{x} bigint" for x in [*names, "n"]))


def _states(grams: DataFrame, context: list[str]) -> DataFrame:
    """The diverging contexts with ``rest``, log10 of what they leave to other words; grams: context, count, share, lower."""
    own = grams.groupBy(*context).agg(
        F.first("count").alias("count"), F.sum(F.expr("share * (ln(share) - lower * ln(10))")).alias("gain"),
        F.greatest(1 - F.sum("share"), F.lit(1e-9)).alias("left"), F.greatest(1 - F.sum(F.pow(F.lit(10.0), "lower")), F.lit(1e-9)).alias("room"))
    return own.where(F.col("gain") * F.col("count") >= DIVERGENCE).select(*context, "count", F.log10(F.col("left") / F.col("room")).alias("rest"))


class Tree:
    """Level 0 are the words. ``parts`` are the other levels as tables: contexts with their rest, and n-grams with their gain."""

    def __init__(self, known: dict[bytes, int], counts: np.ndarray, total: int, distinct: int):
        self.known, self.counts, self.total, self.distinct = known, counts, total, distinct
        self.size, self.base = max(len(known), 1), np.log10((counts + 0.5) / self.scale) if len(known) else np.zeros(0)
        self.parts: list[DataFrame] = []
        self.tables: list[DataFrame] = []

    @property
    def scale(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def grow(self, pairs: DataFrame, triples: DataFrame, words: DataFrame) -> None:
        """From pairs (b, c, n), triples (a, b, c, n) and words (w, n)."""
        share, ten = (F.col("n") - DISCOUNT) / F.col("count"), F.log10("share")
        # the at most MOST frequent words are sent along; only pairs with another word meet their counts in a shuffle
        hot, both = words.where("w >= 0"), F.expr("b >= 0 and c >= 0")
        parts = []
        # keys of the side that is looked up are distinct and dealt by their hash, so a hash table of a partition spares sorting both sides
        for some, few in ((pairs.where(both), F.broadcast(hot)), (pairs.where(~both), words.hint("shuffle_hash"))):
            counted = some.join(few.select(F.col("w").alias("c"), F.log10((F.col("n") + 0.5) / F.lit(self.scale)).alias("lower")), "c")
            parts.append(counted.join(few.select(F.col("w").alias("b"), F.col("n").alias("count")), "b").select("b", "c", "n", "lower", "count"))
        pairs = written(parts[0].unionAll(parts[1]).withColumn("share", share), "pairs")
        one = written(_states(pairs, ["b"]), "contexts")
        self.tables = [one, pairs]
        counted, pairs, rests = pairs, pairs.drop("count"), one.drop("count")
        pairs = pairs.where("b >= 0").join(F.broadcast(rests.where("b >= 0")), "b", "left").unionAll(pairs.where("b < 0").join(rests.where("b < 0").hint("shuffle_hash"), "b", "left"))
        now = F.when(F.col("rest").isNull(), F.col("lower")).otherwise(ten)
        triples = triples.join(pairs.select("b", "c", now.alias("lower")).hint("shuffle_hash"), ["b", "c"])
        triples = triples.join(counted.select(F.col("b").alias("a"), F.col("c").alias("b"), F.col("n").alias("count")).hint("shuffle_hash"), ["a", "b"])
        # the triples of a context lie together after this join; a context's few sums need no further shuffle
        own = Window.partitionBy("a", "b")
        told = {"gain": F.sum(F.expr("share * (ln(share) - lower * ln(10))")), "left": F.sum("share"), "room": F.sum(F.pow(F.lit(10.0), "lower")), "first": F.min("c")}
        triples = triples.withColumn("share", share).select("*", *(x.over(own).alias(k) for k, x in told.items())).where(F.col("gain") * F.col("count") >= DIVERGENCE)
        rest = F.log10(F.greatest(1 - F.col("left"), F.lit(1e-9)) / F.greatest(1 - F.col("room"), F.lit(1e-9)))
        triples = written(triples.select("a", "b", "c", "n", "count", rest.alias("rest"), (ten - F.col("lower") - rest).alias("value"), (F.col("c") == F.col("first")).alias("first")), "states")
        gain = (ten - F.col("lower") - F.col("rest")).alias("value")
        self.tables.append(triples)
        self.parts = [
            one.select("b", F.col("rest").alias("value"), F.col("count").alias("n")), pairs.where("rest is not null").select("b", "c", gain, "n"),
            triples.where("first").select("a", "b", F.col("rest").alias("value"), F.col("count").alias("n")), triples.select("a", "b", "c", "value", "n")]

    @cached_property
    def values(self) -> DataFrame:
        """key, value, n: what each n-gram adds to a document's score at every occurrence; a pair that is a context too has two rows of one n."""
        keyed = [x.select(F.xxhash64(*(c for c in x.columns if c in "abc")).alias("key"), "value", "n") for x in self.parts]
        return written(reduce(DataFrame.unionAll, keyed), "tree")

    def condense(self) -> None:
        """Writes the values, all that scoring needs, and deletes the tables of the levels."""
        self.values.limit(0).collect()
        discard(*self.tables)
        self.tables, self.parts = [], []

    @cached_property
    def held(self) -> list[dict]:
        """The parts on the driver, to look into a small tree."""
        return [{tuple(r)[:-2]: r.value for r in x.collect()} for x in self.parts]

    @property
    def levels(self) -> list[tuple[np.ndarray]]:
        """The retained contexts of frequent words, as numbers."""
        inner = [[k for k in x if min(k) >= 0] for x in self.held[::2]]
        return [(np.array([sum(w * self.size**i for i, w in enumerate(reversed(k))) for k in x], np.int64),) for x in inner]

    def below(self, level: int, states: np.ndarray, following: np.ndarray) -> np.ndarray:
        """log10 P(next | state) of frequent words by the levels up to ``level``; states are contexts' numbers."""
        out = self.base[following].copy()
        for i, (state, c) in enumerate(zip(states.tolist(), following.tolist())):
            for depth in range(1, level + 1):
                context = tuple(state // self.size**k % self.size for k in reversed(range(depth)))
                out[i] += self.held[2 * depth - 2].get(context, 0) + self.held[2 * depth - 1].get((*context, c), 0)
        return out


class Hot:
    """Values of the most frequent n-grams. The keys and values are sent; each worker makes its own table of them."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, own = np.unique(keys, return_inverse=True)
        self.values = np.bincount(own, values, len(self.keys)) if len(keys) else np.zeros(0)

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "values": self.values}

    @cached_property
    def slots(self) -> np.ndarray:
        """A key for each slot of the low bits: of several, one stays and the others are looked up in their buckets."""
        slots = np.zeros((2, 1 << (4 * len(self.keys)).bit_length()), np.int64)
        slots[0] = self.keys[0]
        slots[:, self.keys & slots.shape[1] - 1] = self.keys, self.values.view(np.int64)
        slots[1, slots[0] == self.keys[0]] = self.values[:1].view(np.int64)
        return slots

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are met, and the values of those."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(0)
        at = keys & self.slots.shape[1] - 1
        met = self.slots[0][at] == keys
        return met, self.slots[1][at[met]].view(np.float64)


def fit(docs: DataFrame, text_col: str) -> tuple[Tree, DataFrame]:
    """The tree, and the exact counts (word, n) of all training words."""
    spark = docs.sparkSession
    counts = written(_counts(docs, text_col), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(MOST).select("word", "n").toArrow()
    tree = Tree({w: i for i, w in enumerate(frequent.column("word").to_pylist())}, frequent.column("n").to_numpy().astype(np.float64), total, distinct)
    sent = spark.sparkContext.broadcast(Numbers(tree.known))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sent.value(hashes_of(batch.column(0).to_pylist()))), batch.column(1)], names=["w", "n"])

    words = counts.where(F.col("n") >= LEAST).mapInArrow(numbered, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    words = written(words, "numbers")
    lists = written(_lists(docs, text_col, sent), "lists")
    allowed = spark.sparkContext.broadcast(_filter(words.where("w < 0").select(F.xxhash64("w").alias("key"))))
    pairs = written(_grams(lists, total, allowed, 1), "pairs", 4)
    allowed.destroy()
    release(spark)
    allowed = spark.sparkContext.broadcast(_filter(pairs.select(F.xxhash64("b", "c").alias("key"))))
    triples = written(_grams(lists, total, allowed, 2), "triples", 4)
    allowed.destroy()
    sent.destroy()
    discard(lists)
    release(spark)
    tree.grow(pairs, triples, words)
    discard(pairs, triples, words)
    release(spark)
    return tree, counts


def score(docs: DataFrame, id_col: str, text_col: str, model: tuple[Tree, DataFrame]) -> DataFrame:
    """id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every document.

    A text's row and what it asks for go through one shuffle, tied by the task's number and the row's place in the task: a task
    that runs again must meet its rows in the same order, as scans of files do (write other tables first)."""
    tree, counts = model
    context = docs.sparkSession.sparkContext
    # frequent n-grams by classes of their count, from the highest class on while they fit
    classes = tree.values.groupBy(F.floor(F.log2("n") * 8).alias("class")).agg(F.count("*").alias("size")).orderBy(F.desc("class")).collect()
    fits, least = 0, float("inf")
    for c in classes:
        fits += c["size"]
        if fits > HOT:
            break
        least = c["class"]
    hot = tree.values.where(F.floor(F.log2("n") * 8) >= least).select("key", "value").toArrow()
    size = sum(c["size"] for c in classes)
    release(docs.sparkSession)
    sent = context.broadcast((Numbers(tree.known), tree.base, Hot(hot.column("key").to_numpy(), hot.column("value").to_numpy()), _filter(tree.values.select("key"))))
    buckets = size // ROOM + context.defaultParallelism

    def places(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each text (kind 2), and the keys that are to be looked up with the rows that ask for them (kind 1)."""
        numbers, base, hot, bits = sent.value
        row, asked, waiting = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            for part in in_parts(batch, 1, 1_000_000):
                lines, texts = Lines(part.column(1)), range(part.num_rows)
                ids, owner, place = numbers(lines.hash), lines.owner, lines.place
                one, two = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
                # each n-gram's hash goes on from that of its beginning
                words, pairs = hashed(ids), np.zeros(len(ids), np.int64)
                pairs[one] = hashed(ids[one], first=words[one - 1])
                keys = np.concatenate([words, pairs[one], hashed(ids[two], first=pairs[two - 1])])
                of = np.concatenate([owner, owner[one], owner[two]])
                passed = np.flatnonzero(_passes(bits, keys))
                keys, of = keys[passed], of[passed]
                met, values = hot(keys)
                full = np.bincount(of[met], values, len(texts)) if met.any() else np.zeros(len(texts))
                asked.append((keys[~met], row + of[~met]))
                waiting += len(asked[-1][0])
                sizes, frequent = lines.sizes, ids >= 0
                tails: list[dict[bytes, int]] = [{} for _ in texts]
                rare = np.flatnonzero(~frequent)
                for word, k in zip(lines.words(rare), owner[rare].tolist()):
                    tails[k][word] = tails[k].get(word, 0) + 1
                own = np.arange(row, row + len(texts))
                columns = [
                    pa.array(own % buckets),
                    pa.array(np.full(len(texts), 2)),
                    *(pa.nulls(len(texts), pa.binary()) for _ in range(2)),
                    part.column(0),
                    pa.array(own),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(np.bincount(owner, frequent, len(texts)).astype(np.int64)),
                    pa.array(np.bincount(owner[frequent], base[ids[frequent]] if len(base) else None, len(texts)).astype(np.float64)),
                    pa.array(full),
                    pa.array([list(x.items()) for x in tails], pa.map_(pa.binary(), pa.int64())),
                ]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=[*SLICE, *STATS])
                if waiting > 1_000_000:
                    yield from packed(asked, 1)
                    waiting = 0
        if waiting:
            yield from packed(asked, 1)

    def packed(held: list[tuple[np.ndarray, np.ndarray]], kind: int) -> Iterator[pa.RecordBatch]:
        """Slices by bucket: keys with the rows that ask for them (kind 1), or with their values (kind 0)."""
        keys, own = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = _order(keys.view(np.uint64))
        keys, own = keys.view(np.uint64)[order], own[order]
        del order
        for batch in _batches(_slices(keys, buckets, keys, own), {"bucket": pa.int64(), "keys": pa.binary(), "own": pa.binary()}):
            n = batch.num_rows
            empty = [pa.nulls(n, id_type), *(pa.nulls(n, pa.int64()) for _ in range(3)), *(pa.nulls(n, pa.float64()) for _ in range(2)), pa.nulls(n, pa.map_(pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kind] * n, pa.int64()), *batch.columns[1:], *empty], names=[*SLICE, *STATS])

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            waiting += batch.num_rows
            if waiting > 1_000_000:
                yield from packed(held, 0)
                waiting = 0
        if waiting:
            yield from packed(held, 0)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of texts as they are, and for rows that ask in a bucket the sum of what they get there (``more``)."""
        at, keys, values, fresh = None, np.zeros(0, np.int64), np.zeros(0), []
        for batch in batches:
            texts = batch.filter(pc.equal(batch.column(1), 2)).select(STATS)
            if texts.num_rows:
                yield texts.append_column("more", pa.nulls(texts.num_rows, pa.float64()))
            slices = batch.filter(pc.less(batch.column(1), 2)).select(SLICE)
            for bucket, kind, asked, own in zip(*(x.to_pylist() for x in slices.columns)):
                if bucket != at:
                    at, keys, values, fresh = bucket, np.zeros(0, np.int64), np.zeros(0), []
                asked = _numbers(asked)
                if kind == 0:
                    fresh.append((asked, _numbers(own, np.float64)))
                    continue
                if fresh:
                    keys, values = (np.concatenate(x) for x in zip(*fresh))
                    keys, same = np.unique(keys, return_inverse=True)
                    values, fresh = np.bincount(same, values), []
                place, met = places(keys, asked)
                rows, own = np.unique(_numbers(own)[met], return_inverse=True)
                n = len(rows)
                more = np.bincount(own, values[place[met]], n) if n else np.zeros(0)
                empty = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.map_(pa.binary(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.array(rows), *empty, pa.array(more)], names=[*STATS, "more"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    kinds = f"id {kind_of(docs, id_col)}, row bigint, n_tokens bigint, hot bigint, base double, full double, rare map<binary,bigint>"
    shape = f"bucket bigint, kind bigint, keys binary, own binary, {kinds}"
    known = tree.values.select("key", "value").mapInArrow(giving_back(valued), shape)
    told = rows.mapInArrow(giving_back(run), shape).unionAll(known).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(giving_back(answered), f"{kinds}, more double")
    told = written(told, "scores")
    sent.destroy()
    release(docs.sparkSession)
    held, added = told.where("n_tokens is not null").drop("more"), told.where("n_tokens is null").groupBy("row").agg(F.sum("more").alias("more"))
    rare = held.select("row", F.explode("rare").alias("word", "times")).join(counts.hint("shuffle_hash"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    base = F.log10((F.col("n") + 0.5) / F.lit(float(tree.scale)))
    tail = rare.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("tail_known"), F.sum(F.col("times") * base).alias("tail_base"))
    both = held.drop("rare").join(tail, "row", "left").join(added, "row", "left").na.fill(0, ["tail_known", "tail_base", "more"])
    total = F.col("base") + F.col("tail_base")
    return both.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("hot") + F.col("tail_known")).cast("long").alias("n_known"), F.lit(int(tree.total)).cast("long").alias("train_tokens"),
        total.alias("base_score"), (total + F.col("full") + F.col("more")).alias("score"))
