"""Byte-level BPE encoding and decoding.

The merge ranks become one constant: a table of pairs of ids, which a scalar subquery puts into the expression, since a literal of
its size is printed into every description of a plan that the driver keeps. Every word that a text has is encoded by Spark's
higher-order functions: a fold over its byte ids that applies the pair of the lowest rank, leftmost first, until none is left.
``encode`` numbers the words of a task as it meets them and sends each to the fold once; texts are then put together from the
folded words. Only words of more than ``LONG`` bytes take the same merges from a heap, since a fold's time grows with the square of the length.
``decode`` concatenates the binary pieces of the ids.

Defined results: null text is the empty text; an empty text has no ids; a word of any length is encoded exactly (long
words use a heap, O(n log n)); ids outside the table decode to nothing; other columns pass through unless they carry an
output's name, in which case the output replaces them.
"""

import base64
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import forget, fresh, in_parts, kind_of

#: Elements of the fold from here on are pairs without a rank.
NONE = 1 << 32
#: Bytes up to which a word is folded, words that a task numbers before it begins anew.
LONG, NUMBERED = 256, 500_000


def pattern() -> str:
    r"""The splitting pattern; ``\s`` is spelled as the Unicode property, which differs on four control characters."""
    return public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Piece to rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def merges(table: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Every pair of pieces whose concatenation is a piece."""
    found = {}
    for piece, rank in table.items():
        for cut in range(1, len(piece)):
            left, right = table.get(piece[:cut]), table.get(piece[cut:])
            if left is not None and right is not None:
                found[left, right] = rank
    return found


@lru_cache(maxsize=2)
def rank_table(path: str) -> dict[str, np.ndarray]:
    """The ranks of pairs: the ids that may follow an id stand in ``s`` from its place in ``d`` on, with the id itself as owner, and the rows of
    all ids are laid into each other's gaps. ``q`` has the elements of the fold for two bytes; byte 256 and the id after the last are the end of a word."""
    table, rows, slots = ranks(path), {}, {}
    end = max(table.values()) + 1
    for (a, b), rank in merges(table).items():
        rows.setdefault(a, []).append((b, rank))
    shifts, used = np.zeros(end + 1, np.int64), 0
    for a, own in sorted(rows.items(), key=lambda item: -len(item[1])):
        taken = mask = 0
        for b, _ in own:
            taken |= used >> b
            mask |= 1 << b
        at = (~taken & (taken + 1)).bit_length() - 1  # the first place where all are free
        shifts[a], used = at, used | mask << at
        slots.update((at + b, a << 32 | rank << 16) for b, rank in own)
    filled = np.full(int(shifts.max()) + end + 1, 65535 << 32, np.int64)
    filled[list(slots)] = list(slots.values())
    one = np.array([*(table[bytes([i])] for i in range(256)), end])
    return {"s": filled, "d": shifts, "q": (filled[shifts[one[:256]][:, None] + one] ^ one[:256, None] * (NONE + 1)).ravel()}


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _element(a: str, b: str) -> str:
    """An id and the rank of the pair it begins: rank * 65536 + id, ``NONE`` or more where the pair has none."""
    return f"s[d[{a}] + {b}] ^ ({a} * {NONE + 1}L)"


def rank_map(spark: SparkSession, path: str) -> Column:
    """The rank map as a scalar subquery."""
    return spark.createDataFrame(pa.table({k: pa.array([v], pa.list_(pa.int64())) for k, v in rank_table(path).items()})).select(F.struct("s", "d", "q")).scalar()


def fold_expression(word: str, end: int) -> str:
    """SQL text: the ids of a word, an array of bytes, by a fold of ranked merges over its byte ids. An element of the fold is an id with the rank
    of the pair it begins, so the least one is the next merge, leftmost first; ``end`` stands before the first and after the last."""
    left, right = _element("(e[i - 2] & 65535L)", "shiftright(e[i - 1], 16)"), _element("shiftright(e[i - 1], 16)", "(e[i + 1] & 65535L)")
    merged = f"if(e[i - 1] >= {NONE}L, e, flatten(array(slice(e, 1, i - 2), array({left}, {right}), slice(e, i + 2, size(e)))))"
    step = f"aggregate(array(cast(array_position(e, array_min(e)) as int)), e, (o, i) -> {merged})"
    first = f"flatten(array(array({NONE + end}L), zip_with({word}, slice({word}, 2, size({word})), (x, y) -> q[x * 257 + coalesce(y, 256)]), array({NONE + end}L)))"
    return f"aggregate(slice({word}, 2, size({word})), {first}, (e, x) -> {step}, e -> transform(slice(e, 2, size(e) - 2), x -> cast(x & 65535L as int)))"


def folded(df: DataFrame, words: str, path: str) -> DataFrame:
    """Turns an array of words, arrays of bytes, into an array of their ids."""
    table = fresh(df, "_ranks")
    body = f"transform(`{words}`, w -> {fold_expression('w', max(ranks(path).values()) + 1)})"
    for part in "sdq":
        body = _let(f"t.{part}", part, body)
    # one mention of the map, so that it stays a constant of the expression and is never copied into a row
    return df.withColumn(table, rank_map(df.sparkSession, path)).withColumn(words, F.expr(_let(table, "t", body))).drop(table)


def fold_words(words: DataFrame, word: str, path: str) -> DataFrame:
    """Adds ``ids`` to distinct, non-empty words."""
    tail = "128 + ({} & 63)".format
    raw = f"""flatten(transform(transform(split(`{word}`, ''), x -> ascii(x)), c -> case when c < 128 then array(c)
        when c < 2048 then array(192 + shiftright(c, 6), {tail('c')})
        when c < 65536 then array(224 + shiftright(c, 12), {tail('shiftright(c, 6)')}, {tail('c')})
        else array(240 + shiftright(c, 18), {tail('shiftright(c, 12)')}, {tail('shiftright(c, 6)')}, {tail('c')}) end))"""
    return folded(words.withColumn("ids", F.expr(f"array({raw})")), "ids", path).withColumn("ids", F.element_at("ids", 1))


class Words:
    """The same merges outside Spark: by a heap, for words too long to fold, and of many words at once, which the tests hold the fold against."""

    def __init__(self, path: str, known: dict[str, tuple[int, ...]] | None = None):
        self.table, self.path, self.known = ranks(path), path, known or {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of pairs by the same table as the fold; ids below 0 have none."""
        held = rank_table(self.path)
        got = held["s"][held["d"][a] + b] ^ (a * (NONE + 1))
        return np.where((a >= 0) & (b >= 0) & (got < NONE), got >> 16, NONE)

    def folded(self, raws: list[bytes]) -> list[np.ndarray]:
        """The fold of ranked merges over many short words at once: a round merges the best pair of every word."""
        sizes = np.array([len(x) for x in raws])
        wide = int(sizes.max())
        parts = np.full((len(raws), wide + 1), -1, np.int64)
        parts[np.arange(wide + 1) < sizes[:, None]] = np.array([self.table[bytes([x])] for x in b"".join(raws)])
        left, live, column = self.rank(parts[:, :-1], parts[:, 1:]), np.arange(len(raws)), np.arange(wide + 1)
        while len(live):
            best = left[live].argmin(1)
            rank = left[live, best]
            live, best, rank = (x[rank < NONE] for x in (live, best, rank))
            if not len(live):
                break
            after = np.minimum(column + (column > best[:, None]), wide)
            now = np.take_along_axis(parts[live], after, 1)
            now[:, -1] = -1
            now[np.arange(len(live)), best] = rank
            got = np.take_along_axis(left[live], np.minimum(column[:-1] + (column[:-1] > best[:, None]), wide - 1), 1)
            got[:, -1] = NONE
            row = np.arange(len(live))
            got[row, best] = self.rank(now[row, best], now[row, best + 1])
            prior = np.maximum(best - 1, 0)
            got[row, prior] = np.where(best > 0, self.rank(now[row, prior], now[row, prior + 1]), got[row, prior])
            parts[live], left[live] = now, got
        return [x[x >= 0].astype(np.int32) for x in parts]

    def long(self, raw: bytes) -> list[int]:
        """The same merges by a heap, for a word of any length."""
        if raw in self.table:
            return [self.table[raw]]
        table, n = self.table, len(raw)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := table.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := table.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := table.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [table[raw[i : end[i]]] for i in range(n) if alive[i]]


def _numbered(split: str, names: list[str], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text: how many words of the task have numbers before it, the numbers of its words, and the words that it has first, as
    bytes; those too long to fold stand apart and leave an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        find, seen = regex.compile(split).findall, defaultdict()
        seen.default_factory = seen.__len__
        for batch in batches:
            for part in in_parts(batch, 1, 1_500_000):
                if len(seen) > most:
                    seen.clear()
                before, words = len(seen), [find(text or "") for text in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, words)])
                numbers = np.fromiter(map(seen.__getitem__, chain.from_iterable(words)), "<i4", ends[-1])
                after = np.maximum(np.maximum.accumulate(np.append(before - 1, numbers))[ends] + 1, before)
                raws = [x.encode() for x in islice(reversed(seen), len(seen) - before)][::-1]
                fits = np.array([len(x) <= LONG for x in raws], bool)
                short = [x if own else b"" for x, own in zip(raws, fits)]
                own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, short)]), pa.int32()), pa.array(np.frombuffer(b"".join(short), np.uint8).astype(np.int16)))
                longs = np.append(0, np.cumsum(~fits))[after - before]
                columns = [
                    part.column(0),
                    pa.array(after[:-1], pa.int32()),
                    pa.array([numbers[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(longs, pa.int32()), pa.array([x for x in raws if len(x) > LONG], pa.binary())),
                    pa.ListArray.from_arrays(pa.array(after - before, pa.int32()), own),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


class Folded:
    """Ids of a task's words by their numbers, in one flat array."""

    def __init__(self, path: str):
        self.long = Words(path).long
        self.reset()

    def reset(self) -> None:
        self.n, self.flat, self.ends = 0, np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def add(self, words: pa.ListArray, longs: list[bytes]) -> None:
        """The next words; one without ids is the next of those too long to fold."""
        size, ids = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), words.flatten().to_numpy(zero_copy_only=False)
        if longs:
            at, own = np.flatnonzero(size == 0), [np.array(self.long(x), np.int32) for x in longs]
            ids = np.insert(ids, np.repeat(np.cumsum(size)[at], [len(x) for x in own]), np.concatenate(own))
            size[at] = [len(x) for x in own]
        ends = np.cumsum(size) + self.ends[self.n]
        stop = self.n + len(size)
        while len(self.flat) < self.ends[self.n] + len(ids):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.ends) <= stop:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.ends[self.n] : self.ends[self.n] + len(ids)] = ids
        self.ends[self.n + 1 : stop + 1] = ends
        self.n = stop

    def ids(self, numbers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts in one array, and where each text ends."""
        which = np.frombuffer(b"".join(numbers), "<i4")
        begin, size = self.ends[which], self.ends[which + 1] - self.ends[which]
        stop = np.append(0, np.cumsum(size))
        return self.flat[np.repeat(begin - stop[:-1], size) + np.arange(stop[-1])], stop[np.cumsum([0, *(len(x) // 4 for x in numbers)])]


def encode(docs: DataFrame, id_col: str, text_col: str, path: str, decoded_col: str | None = None, numbered: int = NUMBERED) -> DataFrame:
    """One row per document: its id column, ``ids``, the tokens of its whole text without special tokens, and ``ids_le``,
    the ids as little-endian unsigned 32-bit integers. With ``decoded_col`` the same pass decodes what it has encoded.

    A task splits its texts and numbers their words, Spark folds each word in the row of the text that has it first, and the rows, in the
    same order and task, become ids by the numbers; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        table, pieces = Folded(path), None
        for batch in batches:
            for part in in_parts(batch, 2, 1_200_000):
                begun = np.flatnonzero(part.column(1).to_numpy(zero_copy_only=False) == 0)  # where numbers begin anew
                for i, j in zip([0, *begun], [*begun, len(part)]):
                    if i == j:
                        continue
                    if part.column(1)[int(i)].as_py() == 0:
                        table.reset()
                    own = part.slice(int(i), int(j - i))
                    table.add(own.column(4).flatten(), own.column(3).flatten().to_pylist())
                    ids, ends = table.ids(own.column(2).to_pylist())
                    packed = [ids[x:y].astype("<u4").tobytes() for x, y in zip(ends, ends[1:])]
                    columns = [own.column(0), pa.ListArray.from_arrays(ends.astype(np.int32), ids), pa.array(packed, pa.binary())]
                    if decoded_col:
                        pieces = pieces or piece_list(path)
                        columns.append(pa.array([joined(pieces, np.frombuffer(x, "<u4")) for x in packed], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "ids", "ids_le", *([decoded_col] if decoded_col else [])]
    rows, own = docs.select(id_col, text_col), f"`{id_col}` {kind_of(docs, id_col)}"
    known, numbers, longs, words = (fresh(docs.select(id_col), x) for x in ("known", "numbers", "longs", "words"))
    split = rows.mapInArrow(_numbered(pattern(), [id_col, known, numbers, longs, words], numbered), f"{own}, {known} int, {numbers} binary, {longs} array<binary>, {words} array<array<smallint>>")
    return folded(split, words, path).mapInArrow(run, f"{own}, ids array<int>, ids_le binary" + (f", `{decoded_col}` binary" if decoded_col else ""))


def piece_list(path: str) -> list[bytes]:
    """The binary pieces by id."""
    table = ranks(path)
    pieces = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        pieces[rank] = piece
    return pieces


def joined(pieces: list[bytes], ids: np.ndarray) -> bytes:
    """The concatenated pieces; ids outside the table have none."""
    return b"".join([pieces[i] for i in ids.tolist() if 0 <= i < len(pieces)])


def decode(encoded: DataFrame, ids_col: str, path: str, out_col: str = "decoded") -> DataFrame:
    """Adds the concatenated binary pieces of an array of ids."""
    kept = [c for c in encoded.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_list(path)
        for batch in batches:
            texts = [joined(pieces, x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(texts, pa.binary())], names=[*kept, out_col])

    schema = ", ".join(f"`{c}` {kind_of(encoded, c)}" for c in kept)
    return encoded.select(kept).mapInArrow(run, f"{schema}, `{out_col}` binary")


def digest(encoded: DataFrame, id_col: str) -> DataFrame:
    """Of rows with ``ids``, ``ids_le`` and ``decoded``: per document the number of ids, the SHA-256 of the ids and of the bytes they decode to."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
