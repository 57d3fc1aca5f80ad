"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram of three letters is bound by multiplying
the vectors, the first permuted twice and the second once; the n-grams of a text are bundled by addition, and a language's
prototype bundles its documents at unit length. A text gets the language whose prototype has the largest cosine.

``fit`` learns from at most about ``BOUND`` documents of each language, chosen by a hash of the id, so that the prototypes
cost the same at any size. Defined results: null text, or text without a letter, gives ``und`` with score 0, as does a
model without languages; ties go to the first language in sorted order; the score is the cosine, cut to 0 to 1.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import forget, fresh, in_parts, in_share, kind_of, sample_share

WIDTH, SEED, BOUND, CACHED, GROUP, UNKNOWN = 512, 7, 4_000, 60_000, 128, "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point to the code point of its lower case, 0 for all but letters."""
    table = np.zeros(0x110000, np.int64)
    for point in range(0x110000):
        if chr(point).isalpha():
            table[point] = ord(chr(point).lower()[0])
    return table


@lru_cache(maxsize=100_000)
def letter_vector(point: int) -> np.ndarray:
    return (np.random.default_rng([SEED, point]).integers(0, 2, WIDTH, np.int8) * 2 - 1).astype(np.int8)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed letter trigrams of all texts, and for each the number of its text; words meet a boundary on both sides."""
    points = [letters()[np.frombuffer((" " + (x or "") + " ").encode("utf-32-le", "surrogatepass"), np.uint32)] for x in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in points])
    line = np.concatenate(points)
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] > 0) | (line[:-1] > 0) | (owner[1:] != owner[:-1])
    line, owner = line[keep], owner[keep]
    inside = (owner[2:] == owner[:-2]) & ((line[:-2] > 0) | (line[1:-1] > 0) | (line[2:] > 0))
    return (line[:-2] << 42 | line[1:-1] << 21 | line[2:])[inside], owner[2:][inside]


class Bundler:
    """Bundles texts; keeps the vectors of n-grams that it has met, up to a bound."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.vectors = np.zeros((4096, WIDTH), np.int8)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        if len(self.at) > CACHED:
            self.at, self.vectors = {}, np.zeros((4096, WIDTH), np.int8)
        for code in codes.tolist():
            if code not in self.at:
                n = self.at[code] = len(self.at)
                if n >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                a, b, c = (letter_vector(code >> k & 0x1FFFFF) for k in (42, 21, 0))
                self.vectors[n] = np.roll(a, 2) * np.roll(b, 1) * c
        return self.vectors[[self.at[x] for x in codes.tolist()]]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, of unit length; zero where it has no letter."""
        if len(texts) > GROUP:
            return np.concatenate([self.bundle(texts[k : k + GROUP]) for k in range(0, len(texts), GROUP)])
        codes, owner = grams(texts)
        out = np.zeros((len(texts), WIDTH), np.float32)
        if len(codes):
            unique, which = np.unique(codes, return_inverse=True)
            counts = np.bincount(owner * len(unique) + which, minlength=len(texts) * len(unique)).reshape(len(texts), -1)
            out = counts.astype(np.float32) @ self.rows(unique).astype(np.float32)
            size = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, size, out=np.zeros_like(out), where=size > 0)
        return out


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, bound: int = BOUND) -> tuple[list[str], np.ndarray]:
    """Languages in sorted order and their prototypes, a unit row each."""
    known = labelled.where(F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    share = {row[0]: sample_share(row[1], bound) for row in known.groupBy(lang_col).count().collect()}
    if not share:
        return [], np.zeros((0, WIDTH), np.float32)
    chosen = F.lit(False)
    for lang, part in share.items():
        chosen = chosen | ((F.col(lang_col) == lang) & in_share(id_col, part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums, bundler = {}, Bundler()
        for batch in batches:
            for part in in_parts(batch, 0, 300_000):
                langs, vectors = part.column(1).to_pylist(), bundler.bundle(part.column(0).to_pylist()).astype(np.float64)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[[x == lang for x in langs]].sum(0)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * WIDTH, "k": np.arange(WIDTH, dtype=np.int32), "v": total.round(6)})

    summed = known.where(chosen).select(text_col, lang_col).mapInArrow(run, "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect()
    langs = sorted(share)
    prototypes = np.zeros((len(langs), WIDTH))
    for row in summed:
        prototypes[langs.index(row.lang), row.k] = row.v
    size = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return langs, np.divide(prototypes, size, out=np.zeros_like(prototypes), where=size > 0).astype(np.float32)


def predict(docs: DataFrame, text_col: str, model: tuple[list[str], np.ndarray], keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` with the prediction and its score under the given names, which replace columns of those names."""
    langs, prototypes = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, prototypes))
    others = [c for c in keep if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        (langs, prototypes), bundler = sent.value, Bundler()
        for batch in batches:
            for part in in_parts(batch, 0, 300_000):
                vectors = bundler.bundle(part.column(0).to_pylist())
                found, best, score = np.abs(vectors).sum(1) > 0, np.zeros(len(vectors), int), np.zeros(len(vectors))
                if langs:
                    cosine = (vectors @ prototypes.T).astype(np.float64).round(6)
                    best, score = cosine.argmax(1), cosine.max(1).clip(0, 1)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([langs[b] if f and langs else UNKNOWN for b, f in zip(best, found)], pa.string()), pa.array(np.where(found, score, 0.0))], names=[*others, *names])

    schema = "".join(f"`{c}` {kind_of(docs, c)}, " for c in others)
    return docs.select(F.col(text_col).alias(fresh(docs, "_text")), *others).mapInArrow(run, f"{schema}`{names[0]}` string, `{names[1]}` double")
