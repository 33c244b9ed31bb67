"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import id_remainder, sub_batches

#: Dimensions of a vector, letters of an n-gram (a non-letter is a blank), seed of the letter vectors.
DIM, NGRAM, SEED = 512, 3, 20_240_613
#: N-gram vectors that a worker keeps.
KEPT = 1 << 15
#: A text of G distinct n-grams is rejected if its best cosine is under LEAST * G / (G + HALF).
LEAST, HALF = 0.5, 170


class Space:
    """The vector space: random +1/-1 letter vectors, bound by permutation and product into n-gram vectors."""

    def __init__(self, dim: int = DIM, n: int = NGRAM, seed: int = SEED):
        self.dim, self.n, self.seed = dim, n, seed
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, dtype=bool)
        self.is_letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        self.buffer = np.empty((1024, dim), dtype=np.float32)
        self.forget()

    def forget(self) -> None:
        self.codes, self.at, self.used = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
        self.rows = np.empty((KEPT, self.dim), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = (np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the lower-cased text as numbers of 21 bits a letter, and their counts. The text stands
        between blanks; n-grams of blanks alone don't count."""
        points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4").astype(np.int64)
        points[~self.is_letter[points]] = 0
        points = np.concatenate([[0], points, [0] * (self.n - 1)])
        code = np.zeros(len(points) - self.n + 1, dtype=np.int64)
        for k in range(self.n):
            code = (code << 21) | points[k : len(points) - self.n + 1 + k]
        return np.unique(code[code != 0], return_counts=True)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """The n-gram vectors: the letter at distance k from the last is rotated by k places, and all are multiplied."""
        out = np.ones((len(codes), self.dim), dtype=np.int8)
        for k in range(self.n):
            points, at = np.unique(codes >> (21 * k) & 0x1FFFFF, return_inverse=True)
            out *= np.roll(np.stack([self.letter(int(p)) for p in points]), k, axis=1)[at]
        return out

    def keep(self, codes: np.ndarray) -> None:
        """Have the vectors of these n-grams at hand as long as they fit."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new) + self.used > KEPT:
            self.forget()
            new = codes
        if 0 < len(new) <= KEPT:
            self.rows[self.used : self.used + len(new)] = self.bind(new)
            at = np.concatenate([self.at, np.arange(self.used, self.used + len(new))])
            all_codes = np.concatenate([self.codes, new])
            order = np.argsort(all_codes)
            self.codes, self.at, self.used = all_codes[order], at[order], self.used + len(new)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        if len(self.codes) == 0 or at[-1] == len(self.codes) or (self.codes[at] != codes).any():
            return self.bind(codes).astype(np.float32)
        out = self.buffer[: len(codes)]
        out[:] = np.take(self.rows, self.at[at], axis=0)
        return out

    def profiles(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int] | None]:
        """The vector of each text and the number of its distinct n-grams, None where it is null or has no letter."""
        grams = [self.grams(t) if t else None for t in texts]
        if seen := [g[0] for g in grams if g is not None]:
            self.keep(np.unique(np.concatenate(seen)))
        for g in grams:
            yield (self.bundle(*g), len(g[0])) if g is not None and len(g[0]) else None

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of n-gram vectors, each weighted by log(1 + its count), so that a passage repeated over and over doesn't
        outweigh the rest of its document."""
        total = np.zeros(self.dim)
        for k in range(0, len(codes), 1024):
            total += np.log1p(counts[k : k + 1024]).astype(np.float32) @ self.vectors(codes[k : k + 1024])
        return total


def _space(dim: int, n: int, seed: int, made: dict = {}) -> Space:  # noqa: B006  one space for each worker
    if (dim, n, seed) not in made:
        made[dim, n, seed] = Space(dim, n, seed)
    return made[dim, n, seed]


def language_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """``lang, dim, value``: the prototype of each language, the bundle of all its documents, each document scaled to
    length 1 so that a long one counts as one. Rows whose text or language is null, or whose text has no letter,
    teach nothing. Each task bundles what it reads; only languages times dimensions rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = _space(dim, n, seed), {}
        for b in sub_batches(batches):
            for profile, lang in zip(space.profiles(b.column(0).to_pylist()), b.column(1).to_pylist(), strict=True):
                if profile is not None:
                    v = profile[0]
                    sums.setdefault(lang, np.zeros(dim))[:] += v / (np.linalg.norm(v) or 1.0)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "dim", "value"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def collect_profiles(profiles: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Language names in order and their unit prototypes; a model of one vector a language."""
    pdf = profiles.toPandas()
    names = sorted(pdf["lang"].unique())
    m = np.zeros((len(names), dim))
    m[[names.index(x) for x in pdf["lang"]], pdf["dim"]] = pdf["value"]
    return names, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def best_language(space: Space, texts: list[str | None], names: list[str], prototypes: np.ndarray) -> Iterator[tuple[str, float, int]]:
    """Of each text the language whose prototype has the largest cosine with it (the first by name of equal ones), that
    cosine, 0 at least, and the number of the text's distinct n-grams; ``und``, 0 and 0 where there is nothing to tell."""
    for profile in space.profiles(texts if names else [None] * len(texts)):
        if profile is None:
            yield "und", 0.0, 0
            continue
        v, n = profile
        cos = prototypes @ v / (np.linalg.norm(v) or 1.0)
        k = int(cos.argmax())
        yield names[k], float(min(max(cos[k], 0.0), 1.0)), n


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row and whole text: the best language and its cosine. A text that is
    null or has no letter is ``und`` with score 0, as is every text if no language was learned; equal cosines go to the
    first language by name. Rows are independent: null and repeated ids come out as they went in, an empty table gives
    an empty result and other columns are ignored."""
    dim = prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _space(dim, n, seed)
        for b in sub_batches(batches):
            found = list(best_language(space, b.column(1).to_pylist(), names, prototypes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict_language(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from documents whose id's crc32 modulo 3 is not 1."""
    held = id_remainder("doc_id", 3) == 1
    names, prototypes = collect_profiles(language_profiles(docs.where(~held)))
    return identify(docs, names, prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def least_score(grams: int, least: float = LEAST, half: int = HALF) -> float:
    """The cosine that a text of so many distinct n-grams needs: it rises smoothly with what the text tells, towards
    ``least``, as do the cosines of texts in a learned language."""
    return least * grams / (grams + half)


def known_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", least: float = LEAST, half: int = HALF) -> DataFrame:
    """The documents in some language that the table's own labels teach, with all their columns: those with a letter
    whose best cosine reaches :func:`least_score`. Texts that are null or have no letter go, and all do where no
    language is learned; null and repeated ids are rows like any other; an empty table gives an empty one.

    Rows are independent, so they pass through one scan and nothing is shuffled."""
    names, prototypes = collect_profiles(language_profiles(docs.where(id_remainder(id_col, 3) != 1), text_col, lang_col))
    at, dim = docs.columns.index(text_col), prototypes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _space(dim, NGRAM, SEED)
        for b in sub_batches(batches, text_col):
            found = best_language(space, b.column(at).to_pylist(), names, prototypes)
            yield b.filter(pa.array([n > 0 and score >= least_score(n, least, half) for _, score, n in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id has another remainder than 1."""
    return predict_language(spark.read.parquet(f"{sf_dir}/documents.parquet"))
