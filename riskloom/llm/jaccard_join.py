"""Size-aware join of documents by the Jaccard similarity of their word n-gram sets, and the groups it forms.

A set's distinct members are 64-bit hashes of shingles (four words, similar at 85 percent, unless told otherwise). Documents with equal sets form a class at once; the join
runs between class representatives. Two sets with a and b members are similar when they share c(a, b) or more.

* Light sets, up to a boundary, list every subset of the sizes c that a light partner may need (few members are left out);
  two light sets are candidates when they list the same subset.
* Heavy sets, and the light ones near the boundary, scan inverted lists of their rarest members: sets that are similar meet
  in the first n - ceil(share * n) + 1 members under one order of all members. Members that are frequent in a bounded sample
  come last in that order; the order changes the cost, never the result.
* The boundary is the largest size whose subsets cost less than scanning its lists: a list costs one, and each set that is
  met there, as often as in the sample, costs as much as ``VERIFY`` lists.

Both give lists (key, set). Copies in their thousands must not be paired with each other, so each list first has a pivot (the set
that shares most of its own lists; in the second round one that is in no group yet), and a set is paired with the pivot that most of its lists share; verified links merge groups, and lists whose sets are in one group
are done. The rest pairs only sets of different groups. Every candidate meets an exact upper bound from counts of hash ranges
first; those that remain are verified on whole sets, made anew from their texts and sent once to each cell of pairs that needs
them. No list, candidate or partner is dropped or capped. Tables of a round go when the next no longer reads them.

Defined results: no words or null text gives the empty set, which links with nothing; fewer words than a shingle has make one;
rows with a null id stay, count their shingles and link with nothing; each row is a document, also where rows share an id with equal or different
texts, and equal texts are one set; other columns of documents may have any names.
"""

from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import beside, discard, forget, fresh, in_parts, in_share, kind_of, release, sample_share, written
from riskloom.llm.graph import components

WORDS, PERCENT, SAMPLE, FREQUENT, LIGHTEST, LIGHT_MOST, VERIFY, STARS, BLOCK = 4, 85, 10_000, 8, 6, 20, 20, 2, 256
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles; keeps the hashes of words that it has met, up to a bound."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.known = words, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 150_000:
            self.known.clear()
        got = list(map(self.known.get, words))
        if None in got:
            for word in (w for w in set(words) if w not in self.known):
                self.known[word] = xxhash.xxh3_64_intdigest(word)
            got = list(map(self.known.__getitem__, words))
        return np.array(got, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes."""
        words = self.hashes((text or "").encode().translate(LOWER).split())
        if not len(words):
            return words
        n = min(self.words, len(words))
        total = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            total = total * _ODD[0] + mixed(words[i : len(words) - n + 1 + i] + _ODD[i % len(_ODD)])
        return np.unique(mixed(total))


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Shared members that make sets of a and b members similar."""
    return -(-percent * (a + b) // (100 + percent))


def similar(shared: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def at_least(a: int, percent: int = PERCENT) -> int:
    """Shared members that any partner needs; also the size of the smallest partner."""
    return -(-percent * a // 100)


def subset_sizes(a: int, most: int, percent: int = PERCENT) -> list[int]:
    return sorted({needed(a, b, percent) for b in range(at_least(a, percent), min(a * 100 // percent, most) + 1)})


def boundary(list_length: float, percent: int = PERCENT) -> int:
    """The largest light size: listing its subsets costs less than scanning lists of this length."""
    light = LIGHTEST
    for a in range(LIGHTEST + 1, LIGHT_MOST + 1):
        if sum(comb(a, c) for c in subset_sizes(a, a, percent)) > (a - at_least(a, percent) + 1) * (1 + VERIFY * list_length):
            break
        light = a
    return light


def lists_of(members: np.ndarray, light: int, frequent: dict[int, int], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The lists that a set is in (subsets of a light set; rarest members of a heavy set or of a light one near the boundary), and how
    many members it can share at most with a set whose first common list is that one: those that come before are not shared."""
    n, out, rest = len(members), [], []
    if 0 < n <= light:
        for c in subset_sizes(n, light, percent):
            sums = [members[list(kept)].sum(dtype=np.uint64) for kept in combinations(range(n), c)]
            out.append(mixed(np.array(sums, np.uint64) + np.array([c], np.uint64) * _ODD[1]))
            rest.append(np.full(len(sums), n))
    if n >= at_least(light + 1, percent):
        counts = np.array([frequent.get(x, 0) for x in members.tolist()]) if frequent else np.zeros(n, int)
        out.append(members[np.lexsort((members, counts))[: n - at_least(n, percent) + 1]])
        rest.append(n - np.arange(len(out[-1])))
    return (np.concatenate(out), np.concatenate(rest)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def keys(members: np.ndarray, light: int, frequent: dict[int, int], percent: int = PERCENT) -> np.ndarray:
    return lists_of(members, light, frequent, percent)[0]


def _frequent(docs: DataFrame, text_col: str, share: float, words: int) -> tuple[dict[int, int], float]:
    """Members met in FREQUENT or more documents of a sample; the list length that a member meets on average besides those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in in_parts(batch, 0, 1_000_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingler.shingles(x) for x in part.column(0).to_pylist()] or [np.zeros(0, np.uint64)]).view(np.int64))], names=["member"])

    counted = docs.select(text_col).distinct().mapInArrow(run, "member bigint").groupBy("member").count()
    counted = written(counted.groupBy("count", F.when(F.col("count") >= FREQUENT, F.col("member")).alias("member")).agg(F.count("*").alias("times")), "members")
    rare, all_ = F.when(F.col("member").isNull(), F.col("count") * (F.col("count") - 1) * F.col("times")), F.col("count") * F.col("times")
    squares = counted.agg(F.coalesce(F.sum(rare), F.lit(0)), F.coalesce(F.sum(all_), F.lit(0))).first()
    often = counted.where("member is not null").select("member", "count").toArrow()
    found = dict(zip(often.column("member").to_numpy().view(np.uint64).tolist(), often.column("count").to_pylist()))
    return found, squares[0] / max(squares[1], 1) / share


def sets_of(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``id``, the text's digest ``h``, ``n``, the set's name ``set`` (128 bits), its ``sketch``, and its lists.

    ``keys`` are the lists of rare members and of subsets, ``often`` those of members that are frequent in the sample, each with its ``rest``."""
    share = sample_share(docs.count(), SAMPLE)
    frequent, length = _frequent(docs.where(in_share(id_col, share, 31)), text_col, share, words)
    sent = docs.sparkSession.sparkContext.broadcast((boundary(length, percent), frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        (light, frequent), shingler = sent.value, Shingler(words)
        for batch in batches:
            for part in in_parts(batch, 1, 1_000_000):
                texts = part.column(1).to_pylist()
                whole = [shingler.shingles(x) for x in texts]
                sets = [x if known else x[:0] for x, known in zip(whole, part.column(0).is_valid().to_pylist())]
                lists = [lists_of(x, light, frequent, percent) for x in sets]
                many = [np.fromiter((k in frequent for k in x.tolist()), bool, len(x)) for x, _ in lists]
                parted = [pa.array([z[m == often].astype(np.int64, copy=False) if k else z[m == often].view(np.int64) for z, m in zip((x[k] for x in lists), many)], kind) for often in (False, True) for k, kind in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.int32())))]
                columns = [
                    pa.array([digest(x) for x in texts], pa.binary()),
                    pa.array([len(x) for x in whole], pa.int64()),
                    pa.array([name(x) for x in sets], pa.binary()),
                    pa.array([sketch(x) for x in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *parted], names=["id", "h", "n", "set", "sketch", "keys", "keys_rest", "often", "often_rest"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind_of(docs, id_col)}, h binary, n bigint, set binary, sketch binary, keys array<bigint>, keys_rest array<int>, often array<bigint>, often_rest array<int>")


def digest(text: str | None) -> bytes | None:
    return None if text is None else md5(text.encode()).digest()


def name(members: np.ndarray) -> bytes | None:
    """128 bits from the members; none for the empty set."""
    return np.array([members.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(members + _ODD[2]))], np.uint64).tobytes() if len(members) else None


def sketch(members: np.ndarray) -> bytes:
    """Members in each of 64 or more equal ranges of the hash, about 8 to 16 in a range; 255 stands for any larger count and gives no bound."""
    bits = max(6, (len(members) // 16).bit_length())
    return np.minimum(np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def possible(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sketches allow enough shared members: range by range, no more than the smaller count; a range that is saturated in both allows all. sets: rep, n, sketch."""
    one = pairs.join(sets.select(F.col("rep").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("s1")), "a")
    two = one.join(sets.select(F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("s2")), "b").select("a", "b", "n1", "n2", "s1", "s2")

    def folded(column: pa.Array, at: np.ndarray, size: int, to: int) -> np.ndarray:
        counts = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, size).astype(np.int64)
        return np.where(counts == 255, 1 << 40, counts).reshape(len(at), to, -1).sum(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(4), batch.column(5)
            sizes = np.stack([pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (one, two)], 1).astype(np.int64)
            most = np.zeros(batch.num_rows, np.int64)
            for x, y in np.unique(sizes, axis=0).tolist():
                own, to = np.flatnonzero((sizes == (x, y)).all(1)), min(x, y)
                for at in np.array_split(own, 1 + len(own) * max(x, y) // 4_000_000):
                    most[at] = np.minimum(folded(one, at, x, to), folded(two, at, y, to)).sum(1)
            least = needed(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(most >= least))

    return two.mapInArrow(run, f"a {kind_of(pairs, 'a')}, b {kind_of(pairs, 'b')}")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def _blocks(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """rep, block: the ends of pairs in blocks of about ``BLOCK`` sets. Sets that met the same pivot (near: rep, pivot) share blocks, a large group several."""
    ends = _ends(pairs).join(near, "rep", "left").withColumn("pivot", F.coalesce("pivot", "rep"))
    sizes = ends.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    return ends.join(sizes, "pivot").select("rep", F.xxhash64("pivot", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"))


def links(pairs: DataFrame, near: DataFrame, texts: DataFrame, sets: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are similar. texts: id, text; sets: rep, id, h; near: see ``_blocks``.

    A cell holds the pairs between two blocks. The sets are made anew from the texts of the sets in question, all 64 bits of a
    member, and each goes once to every cell that needs it, not once with every pair."""
    total = 1 + _ends(pairs).count() // BLOCK
    blocks = written(_blocks(pairs, near).withColumn("block", F.pmod("block", F.lit(total))), "blocks")
    both = pairs.join(blocks.withColumnRenamed("rep", "a"), "a").withColumnRenamed("block", "x").join(blocks.withColumnRenamed("rep", "b"), "b")
    celled = written(both.select(F.xxhash64(F.least("x", "block"), F.greatest("x", "block")).alias("cell"), "a", "b"), "cells")
    needs = celled.select("cell", F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.collect_set("cell").alias("cells"))
    needs = written(needs.join(sets.select("rep", "id", "h"), "rep"), "needs")
    found = beside(texts, needs, ["id"], "inner").select("text", "h", "rep", "cells")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in in_parts(batch, 0, 1_000_000):
                for text, h, rep, cells in zip(*(c.to_pylist() for c in part.columns)):
                    if digest(text) == h:
                        own, n = shingler.shingles(text).tobytes(), len(cells)
                        for k in range(0, n, 16):
                            m = min(16, n - k)
                            yield pa.RecordBatch.from_arrays([pa.array(cells[k : k + m], pa.int64()), pa.array([rep] * m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([own] * m, pa.binary())], names=["cell", "a", "b", "members"])

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            kept = []
            for cell, a, b, members in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != at:
                    at, held = cell, {}
                if members is not None:
                    held[a] = np.frombuffer(members, np.uint64)
                elif similar(len(np.intersect1d(x := held[a], y := held[b], assume_unique=True)), len(x), len(y), percent):
                    kept.append((a, b))
            a, b = zip(*kept) if kept else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sent = found.mapInArrow(made, "cell bigint, a bigint, b bigint, members binary").unionByName(celled.withColumn("members", F.lit(None).cast("binary")))
    out = written(sent.repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first()).mapInArrow(tested, "a bigint, b bigint"), "links")
    discard(blocks, celled, needs)
    return out


def _fit(a: str, b: str, rest_a: str, rest_b: str, percent: int) -> Column:
    """Two sets that meet in a list may be similar by their sizes and by what their first common list leaves to share."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.least(rest_a, rest_b).cast("long") * (100 + percent) >= (F.col(a).cast("long") + F.col(b)) * percent)


def _grouped(lists: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Lists with the group of every set; without the lists whose sets are all in one group."""
    if groups is None:
        return lists.withColumn("grp", F.col("rep"))
    now = lists.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("grp", F.coalesce("component", "rep")).drop("component")
    mixed_keys = now.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("key")
    return now.join(mixed_keys, "key", "left_semi")


def _lists(sets: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """key, rep, n, rest, fame: the lists of one set of each class, and the share of its lists that other sets are in: of near copies, the text that others are made from has the most.

    A list of one set is left out where that is cheap to see; lists of frequent members may be long, so no task gathers them."""
    own = beside(sets.select("rep", F.col("n").cast("int").alias("n"), "keys", "keys_rest", "often", "often_rest"), classes.select("rep"), ["rep"], "left_semi")
    rare, often = (own.select(F.explode(F.arrays_zip(F.col(x).alias("key"), F.col(f"{x}_rest").alias("rest"))).alias("e"), "rep", "n").select("e.key", "rep", "n", "e.rest") for x in ("keys", "often"))
    rare = rare.withColumn("many", F.count("*").over(Window.partitionBy("key"))).where("many > 1").drop("many")
    lists = written(rare.unionByName(often), "entries")
    fame = F.count("*") / (F.first("n") - F.ceil(F.first("n") * percent / 100) + 1)
    return lists, lists.join(lists.groupBy("rep").agg(fame.alias("fame")), "rep").select("key", "rep", "n", "rest", F.col("fame").cast("float").alias("fame"))


def join(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h, n, set, ...) of all documents, and for each set its group: (set, grp), where ``grp`` is a number."""
    sets = written(sets_of(docs, id_col, text_col, words, percent).withColumn("rep", F.monotonically_increasing_id()), "sets")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    classes = written(sets.where("set IS NOT NULL").groupBy("set").agg(F.min("rep").alias("rep")), "classes")
    entries, lists = _lists(sets, classes, percent)
    lists = written(lists, "lists")
    discard(entries)
    tests, found, groups, near = [], [], None, None
    for star in range(STARS + 1):
        now = _grouped(lists, groups)
        if star < STARS:
            loose = (F.col("grp") == F.col("rep")).cast("int") if star else F.lit(0)
            first = now.groupBy("key").agg(F.max(F.struct(loose, "fame", F.xxhash64("rep"), "rep", "n", "rest", "grp")).alias("p"))
            met = now.join(first, "key").where((F.col("grp") != F.col("p.grp")) & _fit("n", "p.n", "rest", "p.rest", percent)).groupBy("rep", F.col("p.rep").alias("pivot")).agg(F.count("*").alias("lists"))
            best = written(met.groupBy("rep").agg(F.max(F.struct("lists", "pivot"))["pivot"].alias("pivot")), "best")
            near = near or best
            pairs = best.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
        else:
            best, now = near, written(now, "mixed")
            other = now.select("key", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("rest").alias("left"), F.col("grp").alias("h"))
            pairs = now.withColumnRenamed("rep", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.col("grp") != F.col("h")) & _fit("n", "m", "rest", "left", percent)).select("a", "b")
        pairs = pairs.distinct()
        for tested in tests:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        named = written(_ends(pairs), "named")
        likely = written(possible(pairs, beside(sets.select("rep", "n", "sketch"), named, ["rep"], "left_semi"), percent), "likely")
        tests.append(pairs)
        found.append(links(likely, best, texts, sets, words, percent))
        discard(named, likely, *([now] if star == STARS else [best] if star else []))
        groups = components(reduce(DataFrame.unionAll, found))
        release(docs.sparkSession)
    discard(lists, near, *tests, *found)
    return sets, classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("set", F.coalesce("component", "rep").alias("grp"))


def _told(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h, n, grp), and for each group its smallest (id, h) as ``best``."""
    sets, groups = join(docs, id_col, text_col, words, percent)
    rows = written(sets.select("id", "h", "n", "set").join(groups, "set", "left").drop("set"), "grouped")
    return rows, rows.where("grp is not null").groupBy("grp").agg(F.min(F.struct("id", "h")).alias("best"))


def group(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of documents: id, ``n_shingles`` and ``component_id``, the smallest id that links reach."""
    rows, best = _told(docs, id_col, text_col, words, percent)
    return rows.join(best, "grp", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("best.id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group, the one of the smallest id (then the smallest digest); rows without id or words stay."""
    rows, best = _told(docs, id_col, text_col, words, percent)
    h, on = fresh(docs, "h"), [id_col, "h"]
    own = rows.where("grp is not null").select(F.col("id").alias(id_col), "h", "grp")
    extra = written(own.join(best, "grp").where((F.col("best.id") != F.col(id_col)) | (F.col("best.h") != F.col("h"))).select(id_col, F.col("h").alias(h)), "extra")
    again = written(own.groupBy(on).count().where("count > 1").select(id_col, F.col("h").alias(h)), "again")
    named = docs.withColumn(h, F.unhex(F.md5(F.col(text_col).cast("binary"))))
    kept = beside(named, extra, [id_col, h], "left_anti")
    if not again.isEmpty():  # repeats of one id and text
        kept = beside(kept, again, [id_col, h], "left_anti").unionByName(beside(kept, again, [id_col, h], "left_semi").dropDuplicates([id_col, h]))
    return kept.select(docs.columns)


_SETS = """d AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ') AS ws FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(ws[i : i + least(4, len(ws)) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) t(i) WHERE ws <> ['']),
z AS (SELECT r, count(*) AS n FROM s GROUP BY r)"""
ORACLE = f"""
WITH RECURSIVE {_SETS},
k AS (SELECT * FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM k a JOIN k b USING (g) WHERE a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.r = a JOIN z y ON y.r = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
c AS (SELECT r, doc_id AS c FROM d UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.r),
m AS (SELECT r, min(c) AS component_id FROM c GROUP BY r)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN z USING (r) LEFT JOIN m USING (r)
"""
