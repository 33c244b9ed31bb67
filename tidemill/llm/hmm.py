"""Language-model scores by a hidden Markov model trained with Baum-Welch."""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import id_remainder, materialize, sub_batches

#: Latent states, symbols without the end, rounds of training, seed.
STATES, SYMBOLS, ROUNDS, SEED = 8, 4096, 4, 11
#: Bytes of text of a block of documents, which shares one table of words; of a piece of a text that is split at once.
BLOCK, SPLIT = 16_000_000, 1 << 20
#: Bytes of symbols that a task trains on at once, and tokens whose values it holds for that.
TRAIN, PIECE = 3_000_000, 1_500_000

SPACE = re.compile(rb"[\x20\x09-\x0D]")


def symbol(word: str = "word") -> Column:
    """Short words are told apart by themselves, longer ones by their last three bytes; hashed to SYMBOLS values. The
    empty word, the end of a text, is a symbol of its own."""
    w = F.col(word)
    seen = F.when(F.length(w) <= 4, w).otherwise(F.concat(F.lit(b"~"), F.substring(w, -3, 3)))
    return F.when(F.length(w) == 0, SYMBOLS).otherwise(F.pmod(F.crc32(seen), F.lit(SYMBOLS))).cast("int")


def word_pieces(text: str | None, size: int = SPLIT) -> Iterator[list[bytes]]:
    """The lower-cased words of the text and its end, in lists of about ``size`` bytes of text, cut at white space."""
    raw, at = (text or "").encode().lower(), 0
    while True:
        gap = SPACE.search(raw, at + size)
        stop = gap.start() if gap else len(raw)
        words, at = raw[at:stop].split(), stop
        yield words if gap else [*words, b""]
        if not gap:
            return


def blocks(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as numbers: rows of kind 0 are documents (``doc_id, held, seq``: places of the tokens in the block's
    table of words as compressed 32-bit integers), rows of kind 1 the words of a block (``place, word, n``: tokens in training
    documents). A block is a run of documents of one task with about BLOCK bytes of text; its name is the partition
    and a number. Each token is a byte string of a lower-cased word, the end of a text is the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, b in enumerate(sub_batches(batches, chars=BLOCK, rows=1 << 30)):
            texts, held = b.column(1).to_pylist(), b.column(2).to_pylist()
            # Places in the order of first use: a token costs one look-up.
            place: defaultdict[bytes, int] = defaultdict(count().__next__)
            ids = []
            for t in texts:
                ids.append(np.concatenate([np.fromiter(map(place.__getitem__, words), dtype="<i4", count=len(words)) for words in word_pieces(t)]))
            taught = [x for x, h in zip(ids, held, strict=True) if not h]
            counts = np.bincount(np.concatenate(taught), minlength=len(place)) if taught else np.zeros(len(place), dtype=np.int64)
            names, seqs = list(place), [zlib.compress(x.tobytes(), 1) for x in ids]
            name = part << 32 | k
            d, w = b.num_rows, len(names)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(d, np.int32)), pa.array(np.full(d, name)), b.column(0), b.column(2), pa.array(seqs, pa.binary()), pa.nulls(d, pa.int32()), pa.nulls(d, pa.binary()), pa.nulls(d, pa.int64())], NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(w, np.int32)), pa.array(np.full(w, name)), pa.nulls(w, pa.string()), pa.nulls(w, pa.bool_()), pa.nulls(w, pa.binary()), pa.array(np.arange(w, dtype=np.int32)), pa.array(names, pa.binary()), pa.array(counts, pa.int64())], NAMES)

    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.col(held_out).alias("held"))
    return narrow.mapInArrow(run, "kind int, block long, doc_id string, held boolean, seq binary, place int, word binary, n long")


NAMES = ["kind", "block", "doc_id", "held", "seq", "place", "word", "n"]


def coded_block(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """Documents of a block with what the word counts say: ``doc_id, held, n_tokens, n_known, logs`` (sum of
    log10(c + 1)) and ``syms`` (symbols as 16-bit integers, the end is SYMBOLS)."""
    words = words.sort_values("place")
    c = words["c"].to_numpy()
    log = np.log10(c + 1.0)
    sym = words["sym"].to_numpy().astype("<u2")
    seqs = [np.frombuffer(zlib.decompress(s), dtype="<i4") for s in docs["seq"]]
    return pd.DataFrame({"doc_id": docs["doc_id"], "held": docs["held"], "n_tokens": [len(s) for s in seqs], "n_known": [int((c[s] > 0).sum()) for s in seqs], "logs": [float(log[s].sum()) for s in seqs], "syms": [sym[s].tobytes() for s in seqs]})


def begin(states: int = STATES, symbols: int = SYMBOLS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission probabilities to train from: states that tend to stay, random emissions."""
    rng = np.random.default_rng(seed)
    a = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(a, 0.9)
    b = rng.gamma(2.0, size=(states, symbols + 1))
    return np.full(states, 1.0 / states), a / a.sum(axis=1, keepdims=True), b / b.sum(axis=1, keepdims=True)


def time_cuts(size: np.ndarray, piece: int) -> list[int]:
    """Times, from 0 to that of the longest of the sequences, between which lie ``piece`` tokens at most, or one time."""
    cuts = [0]
    while cuts[-1] < size.max(initial=0):
        goal = np.minimum(size, cuts[-1]).sum() + piece
        low, high = cuts[-1] + 1, int(size.max())
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if np.minimum(size, middle).sum() <= goal else (low, middle - 1)
        cuts.append(low)
    return cuts


def expected_counts(seqs: list[np.ndarray], start: np.ndarray, a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of whole sequences, and their log10 likelihood.

    Scaled forward-backward, all sequences in step: at each time the values of those that go on, longest first, lie side
    by side. A sequence of any length is one sequence, but values are held for one piece of ``piece`` tokens only: the
    forward pass keeps what each piece begins with, and the backward pass computes the values of the pieces before the
    last again."""
    k = len(start)
    emit, a32 = np.ascontiguousarray(b.T.astype(np.float32)), a.astype(np.float32)
    seqs = sorted((s for s in seqs if len(s)), key=len, reverse=True)
    size = np.array([len(s) for s in seqs], dtype=np.int64)
    cuts = time_cuts(size, piece)

    def forward(p: int, before: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Places, symbols, emissions, scaled forward values and scales of piece ``p``, given the values it begins with."""
        times = np.arange(cuts[p], cuts[p + 1])
        off = np.concatenate([[0], np.cumsum(len(seqs) - np.searchsorted(size[::-1], times, side="right"))])
        obs = np.empty(int(off[-1]), dtype=np.int64)
        for i in range(int(off[1])):
            s = seqs[i][cuts[p] : cuts[p + 1]]
            obs[off[: len(s)] + i] = s
        e = emit[obs]
        alpha, scale = np.empty_like(e), np.empty(len(obs), dtype=np.float32)
        for t, m in enumerate(np.diff(off).tolist()):
            now = slice(off[t], off[t] + m)
            if t:
                before = alpha[off[t - 1] : off[t]]
            x = (start.astype(np.float32)[None, :] if before is None else before[:m] @ a32) * e[now]
            scale[now] = s = x.sum(axis=1)
            np.divide(x, s[:, None], out=alpha[now])
        return off, obs, e, alpha, scale

    begins, held, likelihood = [None], None, 0.0
    for p in range(len(cuts) - 1):
        held = None
        held = forward(p, begins[-1])
        begins.append(held[3][held[0][-2] :].copy())
        likelihood += float(np.log10(held[4]).sum(dtype=np.float64))
    n_start, n_a, n_b = np.zeros(k), np.zeros((k, k)), np.zeros((k, b.shape[1]))
    beta = np.ones((len(seqs), k), dtype=np.float32)
    for p in range(len(cuts) - 2, -1, -1):
        off, obs, e, alpha, scale = held or forward(p, begins[p])
        held = None
        for t in range(len(off) - 2, -1, -1):
            m = int(off[t + 1] - off[t])
            now = slice(off[t], off[t] + m)
            y = beta[:m] * e[now]
            y /= scale[now, None]
            np.multiply(alpha[now], beta[:m], out=e[now])  # from here on e holds the states' probabilities
            before = alpha[off[t - 1] : off[t]] if t else begins[p]
            if before is not None:
                n_a += before[:m].T @ y
                np.matmul(y, a32.T, out=beta[:m])
        n_b += np.stack([np.bincount(obs, weights=e[:, s], minlength=b.shape[1]) for s in range(k)])
        if p == 0:
            n_start = e[: len(seqs)].sum(axis=0, dtype=np.float64)
        off = obs = e = alpha = scale = None
    return n_start, n_a * a, n_b, likelihood


def log_likelihoods(seqs: list[np.ndarray], start: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact log10 likelihood of whole sequences by the scaled forward recursion, many in step."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    out, emit = np.zeros(len(seqs)), np.ascontiguousarray(b.T)
    size = np.array([len(seqs[i]) for i in order])
    x = None
    for t0 in range(0, int(size[0]) if len(size) else 0, 256):
        m0 = int(np.searchsorted(-size, -t0, side="left"))
        obs = np.zeros((256, m0), dtype=np.int64)
        for i in range(m0):
            piece = seqs[order[i]][t0 : t0 + 256]
            obs[: len(piece), i] = piece
        for t in range(t0, min(t0 + 256, int(size[0]))):
            m = int(np.searchsorted(-size, -t, side="left"))
            x = (x[:m] @ a if t else start[None, :]) * emit[obs[t - t0, :m]]
            s = x.sum(axis=1)
            out[order[:m]] += np.log10(s)
            x /= s[:, None]
    return out


def train(coded: DataFrame, rounds: int = ROUNDS, states: int = STATES, seed: int = SEED) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[float]]:
    """Baum-Welch on ``syms`` of the rows of ``coded``, and the log10 likelihood of each round's model before it: each
    task sums the expected counts of what it reads, and one row per task and state of (start, transitions, emissions)
    is added up by Spark. The model has a fixed size."""
    start, a, b = begin(states, seed=seed)
    width, likelihoods = 1 + states + b.shape[1], []
    for _ in range(rounds):
        model = (start, a, b)

        def run(frames: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in sub_batches(frames, "syms", chars=TRAIN, rows=1 << 30):
                got = expected_counts([np.frombuffer(s, dtype="<u2") for s in batch.column(0).to_pylist()], *model)
                total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
            if total is not None:
                flat = np.append(np.concatenate([total[0][:, None], total[1], total[2]], axis=1).ravel(), total[3])
                at = np.nonzero(flat)[0]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "value"])

        sums = coded.select("syms").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        flat = np.zeros(states * width + 1)
        flat[sums["at"]] = sums["value"]
        likelihoods.append(float(flat[-1]))
        flat = flat[:-1].reshape(states, width)
        start = (flat[:, 0] + 1) / (flat[:, 0] + 1).sum()
        a = flat[:, 1 : 1 + states] + 0.1
        b = flat[:, 1 + states :] + 0.01
        a, b = a / a.sum(axis=1, keepdims=True), b / b.sum(axis=1, keepdims=True)
    return (start, a, b), likelihoods


def score_texts(docs: DataFrame, held: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; documents with
    ``held`` false are learned from.

    The base score is the add-one unigram one. ``score`` is the log10 probability of the whole text, its end
    included, under the model: a hidden Markov chain emits symbols (classes of words), and a symbol emits one of its
    words, or an unseen one, by add-one counts. Null and empty texts are the end alone. With nothing to learn from,
    the untrained chain scores.

    Word counts cover all training documents and are exact. What is shuffled for them are the distinct words of each
    block of documents, not the tokens: counts are summed by word and come back to the blocks, where each document's
    sums are made. Blocks are bounded in size, or one document; a document of any length
    takes a few numbers of eight bytes a token at a time, and training holds its values by pieces. Rows with null or repeated ids are scored like any other,
    each on its own; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = materialize(blocks(docs, held, id_col, text_col), partition_by="kind")
    words = table.where("kind = 1").select("block", "place", "word", "n")
    counts = materialize(words.groupBy("word").agg(F.sum("n").alias("c")))
    sizes = counts.where("c > 0").groupBy(symbol().alias("sym")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # a row per symbol
    total, distinct = int(sizes["n"].sum()), int(sizes["v"].sum())
    back = words.drop("n").join(counts, "word").select((F.col("block") + 0).alias("of"), "place", symbol().alias("sym"), "c")
    rows = table.where("kind = 0").select("block", "doc_id", "held", "seq")
    schema = "doc_id string, held boolean, n_tokens long, n_known long, logs double, syms binary"
    # A task has one or two blocks, however many there are.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.select("block").distinct().count() // 2))
    rows, back = rows.repartition(tasks, "block"), back.repartition(tasks, "of")
    coded = materialize(rows.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(coded_block, schema))
    model, _ = train(coded.where("not held"), rounds)
    room = np.zeros(SYMBOLS + 1)
    for s, n, v in sizes[["sym", "n", "v"]].itertuples(index=False):
        room[int(s)] = math.log10(n + v + 1)

    unit = math.log10(total + distinct + 1)
    schema = "doc_id string, held boolean, n_tokens long, n_known long, logs double, score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "syms", chars=2_000_000):
            seqs = [np.frombuffer(s, dtype="<u2") for s in b.column(5).to_pylist()]
            score = log_likelihoods(seqs, *model) - np.array([room[s].sum() for s in seqs]) + b.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(score)], ["doc_id", "held", "n_tokens", "n_known", "logs", "score"])

    out = coded.mapInArrow(scored, schema)
    base = F.col("logs") - F.col("n_tokens") * F.lit(unit)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose id has another remainder than 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs.withColumn("held", id_remainder("doc_id", 7) == 2), "held")
