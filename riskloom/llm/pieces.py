"""Subword pieces of a sentencepiece model: merges in vectorised rounds, and the way back.

The symbols of many texts lie in one flat array. A word is a longest run in which every two neighbouring characters also stand
side by side in some piece; no merge can cross its edges, so words are merged apart and equal words of a batch once. A round
finds the best (least) rank among the pairs of each word by a segmented minimum, merges its leftmost occurrences in all words
at once and closes the gaps, until no pair remains. Occurrences of one rank are merged together unless the merged piece is part
of a piece of the same or a better rank, in which case the new pair has to be seen before the next occurrence: then only the
leftmost one is merged. Words of more than ``LONG`` characters, for which rounds would be too many, take the same merges from a heap.

Normalisation is that of the model's kind: no character mapping, one space put before a text that is not empty, white space
kept. Null texts count as empty; an empty text has no pieces but the end id. A text is cut between words into slices of about
a million characters, so memory is bounded for any text but one whose single word is longer. Repeated rows and ids give a row
each; further columns do not enter. Empty tables give no rows.
"""

import codecs
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import in_parts, kept, kind_of

NONE = np.iinfo(np.int32).max
#: Codes from here on are characters that are in no piece.
OTHER = 1 << 16
#: Characters of a word that is still merged in rounds, and of a slice of a text.
LONG, SLICE = 400, 1_000_000
SPACE, REPLACEMENT = "▁", "�"
_BITS = 20


class Pieces:
    """Tables of one model: codes of characters and pieces, which of them may stand side by side, and the rank of each pair."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(size)]
        bare = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(size)]
        if any(model.is_unused(i) for i in range(size)) or not any(model.is_byte(i) for i in range(size)):
            raise ValueError("the model needs byte pieces and no unused ones")
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.byte_of = {i: int(t[3:5], 16) for i, t in enumerate(texts) if model.is_byte(i)}
        self.byte_id = np.zeros(256, np.int32)
        self.byte_id[list(self.byte_of.values())] = list(self.byte_of)
        self.is_byte = np.zeros(size, bool)
        self.is_byte[list(self.byte_of)] = True
        self.surface = ["" if model.is_control(i) else " ⁇ " if model.is_unknown(i) else t.replace(SPACE, " ") for i, t in enumerate(texts)]

        own = {t: i for i, t in enumerate(texts) if not bare[i]}
        letters = sorted({c for t in own for c in t})
        self.codes = {t: i for i, t in enumerate([*letters, *(t for t in own if len(t) > 1)])}
        if len(self.codes) >= OTHER:
            raise ValueError("the model has too many pieces")
        self.ids = np.array([own.get(t, -1) for t in self.codes], np.int32)  # -1: a character that is only part of pieces
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letter[ord(" ")] = self.letter[ord(SPACE)]
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)  # the last row and column are for all others
        for t in own:
            for a, b in zip(t, t[1:]):
                self.beside[self.codes[a], self.codes[b]] = True

        scores = sorted({model.get_score(i) for i in own.values()}, reverse=True)
        place = {s: i for i, s in enumerate(scores)}
        rank = {t: place[model.get_score(i)] for t, i in own.items()}
        pairs = [(self.codes[t[:k]], self.codes[t[k:]], self.codes[t], rank[t]) for t in own for k in range(1, len(t)) if t[:k] in self.codes and t[k:] in self.codes]
        left, right, self.made, self.rank = (np.array(x, np.int64) for x in zip(*pairs))
        #: Ranks of which no two occurrences may be merged at once.
        self.alone = np.zeros(len(scores), bool)
        for t, r in rank.items():
            for part in {t[:k] for k in range(2, len(t))} | {t[k:] for k in range(1, len(t) - 1)}:
                if part in rank and r <= rank[part]:
                    self.alone[rank[part]] = True
        many = np.bincount([r for t, r in rank.items() if len(t) > 1], minlength=len(scores))
        self.alone[many > 1] = True

        key = left << 16 | right
        self.slots = np.full(1 << _BITS, -1, np.int64)
        self.which = np.zeros(1 << _BITS, np.int32)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.slots[at[todo]] < 0
            self.slots[at[todo[free]]] = key[todo[free]]  # of several the last stays
            placed = self.slots[at[todo]] == key[todo]
            self.which[at[todo[placed]]] = todo[placed]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & ((1 << _BITS) - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair in ``made`` and ``rank``, or -1."""
        key = left.astype(np.int64) << 16 | right
        at, found, todo = self._slot(key), np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(todo):
            held = self.slots[at[todo]]
            hit = held == key[todo]
            found[todo[hit]] = self.which[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << _BITS) - 1)
        return found

    def merged(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words that begin at ``starts`` after all merges, and where each word begins then."""
        word = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(codes)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        codes, pair, rank = codes.copy(), np.full(len(codes), -1, np.int64), np.full(len(codes), NONE, np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self.pair(codes[inner], codes[inner + 1])
        rank[pair >= 0] = self.rank[pair[pair >= 0]]
        while len(codes):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(first, append=len(word))
            over = np.repeat(least == NONE, sizes)
            if over.any():
                done.append((word[over], codes[over]))
                word, codes, pair, rank = (x[~over] for x in (word, codes, pair, rank))
                sizes, least = sizes[least < NONE], least[least < NONE]
                if not len(codes):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # leftmost occurrences: every other one of those that overlap, and only the first one of a word where the rank asks for it
            run = np.diff(at, prepend=-2) != 1
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - begin) % 2 == 0
            take &= ~self.alone[rank[at]] | (np.diff(word[at], prepend=-1) != 0)
            at = at[take]
            codes[at] = self.made[pair[at]]
            gone = np.zeros(len(codes), bool)
            gone[at + 1] = True
            shift = np.cumsum(gone)
            now = at - shift[at]
            word, codes, pair, rank = (x[~gone] for x in (word, codes, pair, rank))
            touched = np.unique(np.concatenate([now, now - 1]))
            touched = touched[touched >= 0]
            pair[touched], rank[touched] = -1, NONE
            inner = touched[touched + 1 < len(word)]
            inner = inner[word[inner] == word[inner + 1]]
            pair[inner] = self.pair(codes[inner], codes[inner + 1])
            known = inner[pair[inner] >= 0]
            rank[known] = self.rank[pair[known]]
        words, out = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(words, kind="stable")
        return out[order], np.searchsorted(words[order], np.arange(len(starts)))

    def long(self, codes: list[int]) -> list[int]:
        """The same merges of one word from a heap."""
        n, heap = len(codes), []
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        seen: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0:
                key = (codes[i], codes[j])
                if key not in seen:
                    seen[key] = int(self.pair(np.array([key[0]]), np.array([key[1]]))[0])
                if (p := seen[key]) >= 0:
                    heapq.heappush(heap, (int(self.rank[p]), i, p, *key))

        for i in range(n):
            push(i)
        while heap:
            _, i, p, a, b = heapq.heappop(heap)
            if codes[i] != a or (j := after[i]) < 0 or codes[j] != b:
                continue
            codes[i], codes[j], after[i] = int(self.made[p]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [c for c in codes if c >= 0]

    def slices(self, text: str) -> Iterator[str]:
        """Parts of a text of about ``SLICE`` characters, cut between words."""
        begin = 0
        while len(text) - begin > SLICE:
            points = np.frombuffer(text[begin : begin + 2 * SLICE].encode("utf-32-le"), np.uint32)
            near = self.letter[points]
            cuts = np.flatnonzero(~self.beside[near[SLICE // 2 : -1], near[SLICE // 2 + 1 :]])
            reach = SLICE
            while not len(cuts) and begin + 2 * reach < len(text):  # one word of more than a slice
                reach *= 2
                near = self.letter[np.frombuffer(text[begin : begin + 2 * reach].encode("utf-32-le"), np.uint32)]
                cuts = np.flatnonzero(~self.beside[near[SLICE // 2 : -1], near[SLICE // 2 + 1 :]])
            stop = begin + SLICE // 2 + 1 + int(cuts[np.searchsorted(cuts, min(SLICE // 2, cuts[-1]))]) if len(cuts) else len(text)
            yield text[begin:stop]
            begin = stop
        yield text[begin:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text ends; texts are taken as they are, without a space before."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        codes = self.letter[points]
        edge = np.ones(len(codes), bool)
        edge[1:] = ~self.beside[codes[:-1], codes[1:]]
        edge[ends[ends < len(codes)]] = True
        codes = np.where(codes < 0, points.astype(np.int64) + OTHER, codes)
        starts = np.flatnonzero(edge)
        sizes = np.diff(starts, append=len(codes))
        # equal words once: by a 64-bit sum, and any that differ from the first of their sum apart
        inside = np.arange(len(codes)) - np.repeat(starts, sizes)
        powers = np.cumprod(np.full(int(sizes.max()), 0x2545F4914F6CDD1D, np.uint64))
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        sums = np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * powers[inside], starts) + sizes.astype(np.uint64)
        _, rep, kind = np.unique(sums, return_index=True, return_inverse=True)
        like = rep[kind]
        same = sizes == sizes[like]
        there = np.repeat(starts[like], sizes) + np.minimum(inside, np.repeat(sizes[like], sizes) - 1)
        same &= np.logical_and.reduceat(codes[there] == codes, starts)
        odd = np.flatnonzero(~same)
        kind[odd] = len(rep) + np.arange(len(odd))
        rep = np.concatenate([rep, odd])
        flat, begin = self._words(codes, starts[rep], sizes[rep])
        # each word's ids in the order of the texts
        count = np.diff(begin)[kind]
        stop = np.cumsum(count)
        ids = flat[np.repeat(begin[kind] - (stop - count), count) + np.arange(stop[-1])]
        upto = np.searchsorted(starts, ends)  # words before the end of each text
        return ids, np.concatenate([[0], stop])[upto]

    def _words(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words given, flat, and where each begins (one more than words)."""
        short = np.flatnonzero(sizes <= LONG)
        upto = np.cumsum(sizes[short])
        at = np.repeat(starts[short] - (upto - sizes[short]), sizes[short]) + np.arange(upto[-1] if len(upto) else 0)
        if len(short):
            got, begin = self.merged(codes[at], upto - sizes[short])
            count = np.diff(begin, append=len(got))
        else:
            got, count = np.empty(0, np.int64), np.empty(0, np.int64)
        held = [got]
        place = np.zeros(len(starts), np.int64)
        many = np.zeros(len(starts), np.int64)
        place[short], many[short] = np.cumsum(count) - count, count
        for i in np.flatnonzero(sizes > LONG):
            own = np.array(self.long(codes[starts[i] : starts[i] + sizes[i]].tolist()), np.int64)
            place[i], many[i] = sum(map(len, held)), len(own)
            held.append(own)
        flat = np.concatenate(held)
        upto = np.cumsum(many)
        flat = flat[np.repeat(place - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]
        return self._ids(flat, np.concatenate([[0], upto]))

    def _ids(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of codes: those without a piece of their own as the bytes of their character."""
        ids = np.where(codes < OTHER, self.ids[np.minimum(codes, len(self.ids) - 1)], -1)
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids.astype(np.int32), begin
        letters = list(self.codes)
        raw = [(chr(c - OTHER) if c >= OTHER else letters[c]).encode() for c in codes[bare].tolist()]
        count = np.ones(len(codes), np.int64)
        count[bare] = [len(x) for x in raw]
        stop = np.cumsum(count)
        out = np.repeat(ids, count)
        out[np.repeat(stop[bare] - np.cumsum(count[bare]), count[bare]) + np.arange(count[bare].sum())] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype(np.int32), np.concatenate([[0], stop])[begin]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: runs of byte pieces as UTF-8, each byte that is none as the replacement character; control ids vanish, and the space put before a text with them."""
        if not self.is_byte[ids].any():
            text = "".join([self.surface[i] for i in ids.tolist()])
            return text[1:] if text.startswith(" ") and self._spaced(ids) else text
        out, raw, full, bare = [], bytearray(), False, True
        for i in [*ids.tolist(), -1]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(utf8(bytes(raw)))
                full, raw = True, bytearray()
            if i >= 0:
                text, bare = self.surface[i], bare and not full
                if bare and i != self.unknown and text.startswith(" "):
                    text, bare = text[1:], False
                full = full or bool(text)
                out.append(text)
        return "".join(out)

    def _spaced(self, ids: np.ndarray) -> bool:
        """Whether the first piece with a text is an ordinary one."""
        return next((i for i in ids.tolist() if self.surface[i]), self.unknown) != self.unknown


codecs.register_error("each byte", lambda bad: (REPLACEMENT, bad.start + 1))


def utf8(raw: bytes) -> str:
    """Bytes as text, with a replacement character for each byte that belongs to no character."""
    return raw.decode(errors="each byte")


def tables(path: str) -> Pieces:
    """The tables of a model, read once in a Python worker."""
    return kept(f"pieces {path}", lambda: Pieces(path))


def encoded(pieces: Pieces, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts with the end id behind each, and where each begins (one more than texts)."""
    spaced = [" " + t if t else "" for t in texts]
    parts, owner = [], []
    for i, text in enumerate(spaced):
        for part in pieces.slices(text):
            parts.append(part)
            owner.append(i)
    held, sizes, batch, room = [], np.ones(len(texts), np.int64), [], 0
    for k, part in enumerate([*parts, None]):
        if batch and (part is None or room + len(part) > SLICE):
            ids, ends = pieces.encode(batch)
            held.append(ids)
            np.add.at(sizes, owner[k - len(batch) : k], np.diff(ends, prepend=0))
            batch, room = [], 0
        if part is not None:
            batch.append(part)
            room += len(part)
    stop = np.cumsum(sizes)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
    last = np.zeros(len(out), bool)
    last[stop - 1] = True
    out[last] = pieces.end
    out[~last] = np.concatenate([np.empty(0, np.int32), *held])
    return out, np.concatenate([[0], stop])


def encode(docs: DataFrame, id_col: str, text_col: str, path: str, decoded_col: str | None = None) -> DataFrame:
    """One row per row of docs: its id column and ``ids``, the pieces of its whole text with the end id behind. With
    ``decoded_col`` the same pass decodes what it has encoded. The model file must be at ``path`` on every host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tables(path)
        for batch in batches:
            for part in in_parts(batch, 1, 1_500_000):
                ids, begin = encoded(pieces, part.column(1).to_pylist())
                columns = [part.column(0), pa.ListArray.from_arrays(begin.astype(np.int32), ids)]
                if decoded_col:
                    columns.append(pa.array([pieces.decode(ids[i:j]) for i, j in zip(begin, begin[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "ids", *([decoded_col] if decoded_col else [])]
    schema = f"`{id_col}` {kind_of(docs, id_col)}, ids array<int>" + (f", `{decoded_col}` string" if decoded_col else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str, path: str, out_col: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids; null stays null."""
    kept = [c for c in rows.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tables(path)
        for batch in batches:
            texts = [pieces.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(texts, pa.string())], names=[*kept, out_col])

    schema = ", ".join(f"`{c}` {kind_of(rows, c)}" for c in kept)
    return rows.select(kept).mapInArrow(run, f"{schema}, `{out_col}` string")


def digest(rows: DataFrame, id_col: str) -> DataFrame:
    """Of rows with ``ids`` and ``decoded``: the number of ids, the SHA-256 of the ids as decimals and of the text."""
    return rows.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
