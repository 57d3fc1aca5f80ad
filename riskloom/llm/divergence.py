"""How far the sources of a language differ in their terms, in whole numbers.

Tasks count the terms of their documents; Spark adds the counts up by language, term and source and keeps the terms that enough
documents of the language have. What remains of a term is a row of its nonzero counts in the order of the sources. The sum over
all terms that the audit asks for a pair of sources is that of two sources with no occurrence anywhere, corrected where a source
has some: by what one count alone changes, and by what two counts of a row change beyond that. Equal rows are one row with a
multiplicity; the rows are then dealt by ranges and inserted, sorted, into frequent-pattern trees, a node for each shared beginning.
A node corrects its source's pair with the source of each of its ancestors once, for all rows below it. A tree that a range or
a batch cuts off holds the same rows in two nodes, whose sums are the same.

Null language, source and text count as empty texts; an empty text, or one without letters, makes its group known and adds no
term. Repeated rows and ids count as often as they occur. Languages without kept terms give pairs of value 0; one source alone
gives no pair. Texts are read in slices of about a million bytes. Other columns do not enter. Empty tables give no rows. A term's
row, and what a task adds up for pairs, has the size of the sources or of their pairs, which the result has too.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import beside, in_parts, written

#: Fixed values of the contract: documents that have a kept term, the scale of shares, and the ranks of the term part.
LEAST, SCALE, TOP = 10, 1_000_000_000, 10
#: Distinct words that a task counts before it hands them on; cells of a batch of rows.
HELD, CELLS = 200_000, 1_000_000

_OTHER = [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Bytes: A-Z to a-z, all that are in no term to a space.
_FOLD = bytes(0x20 if b in _OTHER else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in slices that end between terms."""
    folded, begin = raw.translate(_FOLD), 0
    while begin < len(folded):
        end = folded.find(b" ", begin + 1_000_000)
        end = len(folded) if end < 0 else end
        yield folded[begin:end].split()
        begin = end


def counted(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up within tasks only; a null term for each group met."""
    kept = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, within) in held.items():
            m = len(n) + 1
            columns = [pa.array([lang]).take(pa.array(np.zeros(m, np.int32))), pa.array([source]).take(pa.array(np.zeros(m, np.int32))), pa.array([None, *n], pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(within.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for part in in_parts(batch, 2, 4_000_000):
                for lang, source, raw in zip(*(c.to_pylist() for c in part.columns)):
                    n, within = held.setdefault((lang, source), (Counter(), Counter()))
                    own: set[bytes] = set()
                    for found in words(raw):
                        n.update(found)
                        own.update(found)
                    within.update(own)
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    return kept.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(count: str, total: str, terms: str) -> str:
    """SQL of 1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact for any longs; null where the divisor is 0."""
    wide = lambda c: f"CAST({c} AS DECIMAL(20,0))"
    return f"1 + ({SCALE} * ({wide(count)} + 2)) DIV nullif({wide(total)} + 2 * {wide(terms)}, 0)"


def distance(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so longs hold it."""
    return f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})"


def term_rows(docs: DataFrame, lang_col: str, source_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """(lang, term, total, items) of the kept terms, items being (source, n) in the order of the sources, and for each language
    a row with a null term and all its sources. One shuffle brings the rows of a term together."""
    met = counted(docs, lang_col, source_col, text_col).repartition("lang", "term")
    each = met.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = each.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("items"))
    return rows.where(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs")


def groups_of(rows: DataFrame) -> DataFrame:
    """(lang, source, total, terms): every group met, its occurrences of kept terms and how many terms its language keeps."""
    cells = rows.select("lang", "term", F.explode("items").alias("i")).select("lang", "term", "i.source", "i.n")
    each = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    return each.join(rows.groupBy("lang").agg(F.count("term").alias("terms")), "lang")


def corrections(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: what the occurrences add to the sum of a pair without any."""
    known: dict[str, tuple] = {}
    for g in groups.orderBy("lang", "source").collect():  # the result has a row for each two of these
        names, totals, terms = known.setdefault(g.lang, ([], [], g.terms))
        names.append(g.source)
        totals.append(g.total)
    same = rows.where("term IS NOT NULL").groupBy("lang", "items").agg(F.count("*").alias("m"))
    dealt = same.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, own in _runs(langs):
                names, totals, terms = known[langs[first]]
                for at, source, n, size in _cells(batch.column(1).slice(first, own), pa.array(names)):
                    a, b, value = tree_sums(source, n, size, batch.column(2).slice(first + at, len(size)).to_numpy(), totals, terms)
                    text = pa.array(names)
                    yield pa.RecordBatch.from_arrays([pa.array([langs[first]] * len(a), pa.string()), text.take(pa.array(a)), text.take(pa.array(b)), pa.array(value)], names=["lang", "a", "b", "value"])

    parts = dealt.select("lang", "items", "m").mapInArrow(run, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first place, length) of the runs of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    yield from zip(begin.tolist(), np.diff(begin, append=len(values)).tolist())


def _cells(items: pa.Array, names: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows of items: (place of the first row, numbers of the sources and counts as rows filled up with -1, sizes), in blocks of bounded area."""
    offsets = items.offsets.to_numpy()
    flat = items.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    source, n = pc.index_in(flat.field(0), value_set=names).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    begin, size = offsets[:-1] - offsets[0], np.diff(offsets)
    step = max(1, CELLS // int(size.max(initial=1)))
    for i in range(0, len(size), step):
        own, wide = size[i : i + step], int(size[i : i + step].max())
        full = np.arange(wide) < own[:, None]
        at = (begin[i : i + step, None] + np.arange(wide))[full]
        out = np.full((2, *full.shape), -1, np.int64)
        out[0][full], out[1][full] = source[at], n[at]
        yield i, out[0], out[1], own


def shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)); Python's numbers where 64 bits would not do."""
    below = np.maximum(total + 2 * terms, 1)
    if n.max(initial=0) > 9_000_000_000:
        n, below = n.astype(object), below.astype(object)
    return (1 + SCALE * (n + 2) // below).astype(np.int64)


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tree_sums(source: np.ndarray, n: np.ndarray, size: np.ndarray, m: np.ndarray, totals: list[int], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum) for pairs of source numbers, a < b, of the tree of sorted rows with their multiplicities.

    A node is the first row of those that share its path, at the path's depth. Its multiplicity is the sum over these rows.
    """
    total = np.array(totals, np.int64)
    none = shares(np.zeros(len(total), np.int64), total, terms)
    p = np.where(source >= 0, shares(n, total[source], terms), 0)
    many, (rows, wide) = len(total), source.shape
    # rows share a beginning as far as both source and count agree
    agree = np.cumprod((source[1:] == source[:-1]) & (n[1:] == n[:-1]) & (source[1:] >= 0), axis=1).sum(1) if rows > 1 else np.empty(0, np.int64)
    shared = np.concatenate([[0], agree])
    keys, sums = [], []

    def add(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        key, at = np.unique(np.minimum(a, b) * many + np.maximum(a, b), return_inverse=True)
        got = np.zeros(len(key), np.int64)
        np.add.at(got, at, value)
        keys.append(key)
        sums.append(got)

    for k in range(wide):
        node = np.flatnonzero((shared <= k) & (size > k))
        if not len(node):
            continue
        weight = np.add.reduceat(np.where(size > k, m, 0), node)
        b, q = source[node, k], p[node, k]
        # what one count changes, against each other source without any
        item, at = np.unique(np.stack([b, q]), axis=1, return_inverse=True)
        own = np.zeros(item.shape[1], np.int64)
        np.add.at(own, at.ravel(), weight)
        for i in range(0, many, max(1, CELLS // max(item.shape[1], 1))):
            other = np.arange(i, min(many, i + max(1, CELLS // max(item.shape[1], 1))))
            changed = (far(item[1][:, None], none[other]) - far(none[item[0]][:, None], none[other])) * own[:, None]
            apart = item[0][:, None] != other
            add(np.broadcast_to(item[0][:, None], apart.shape)[apart], np.broadcast_to(other, apart.shape)[apart], changed[apart])
        # what a node and its ancestors change beyond that, once each
        step = max(1, CELLS // max(k, 1))
        for i in range(0, len(node) if k else 0, step):
            above, mine = node[i : i + step], slice(i, i + step)
            a, pa_, qb, b_ = source[above, :k], p[above, :k], q[mine, None], b[mine, None]
            beyond = far(pa_, qb) - far(pa_, none[b_]) - far(none[a], qb) + far(none[a], none[b_])
            add(a.ravel(), np.broadcast_to(b_, a.shape).ravel(), (beyond * weight[mine, None]).ravel())
    if not keys:
        return (np.empty(0, np.int64),) * 3
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    got = np.zeros(len(key), np.int64)
    np.add.at(got, at, np.concatenate(sums))
    return key // many, key % many, got


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance to every other source of the language, and the terms that it uses most beyond the language."""
    rows = written(term_rows(docs, lang_col, source_col, text_col, least), "terms")
    groups = written(groups_of(rows), "groups")
    a, b = (groups.select("lang", F.col("source").alias(n), F.expr(share("0", "total", "terms")).alias(f"p{n}"), "terms") for n in "ab")
    pairs = a.join(b.drop("terms"), "lang").where("a < b").join(corrections(rows, groups), ["lang", "a", "b"], "left")
    value = F.coalesce(F.expr(f"terms * ({distance('pa', 'pb')})"), F.lit(0)) + F.coalesce("value", F.lit(0))
    ways = pairs.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w"))
    pair = ways.select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(own))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    cells = rows.where("term IS NOT NULL").select("lang", F.col("term").cast("string").alias("item"), F.col("total").alias("everywhere"), F.explode("items").alias("i")).select("lang", "item", "everywhere", "i.source", "i.n")
    met = beside(cells, groups.join(whole, "lang"), ["lang", "source"], "inner")
    told = met.withColumns({"p": F.expr(share("n", "total", "terms")), "q": F.expr(share("everywhere", "all", "terms"))}).where("n > 0 AND p > q")
    term = told.select("lang", "source", F.lit("term").alias("part"), "item", F.expr(distance("p", "q")).alias("value"))
    term = term.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    return pair.unionByName(term)


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS everywhere FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(everywhere) AS everything FROM k GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN t USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2)) // (g.total + 2 * v.v) AS p, 1 + (1000000000 * (CAST(k.everywhere AS HUGEINT) + 2)) // (v.everything + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM z WHERE part = 'pair' OR rank <= 10
"""
