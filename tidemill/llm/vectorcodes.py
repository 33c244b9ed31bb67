"""Compression of vectors to codes of their parts; nearest codebook entries are found by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import finite_vectors, materialize, packed_rows, unpacked_rows

#: Parts of a vector, entries of a part's codebook, rounds of training, integer steps of a component's unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are searched side by side.
BATCH = 4096


class Codebook:
    """Entries of one part with, for each entry, all entries by growing distance (ties: lower index first)."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(np.float64)
        norms = np.einsum("ij,ij->i", self.entries, self.entries)
        between = norms[:, None] + norms - 2 * self.entries @ self.entries.T  # whole numbers, exact
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, axis=1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of ``q`` (ties: lowest index) and its squared distance.

        Each row walks the list of its best entry so far, skips entries that it has visited, jumps to the head of the
        list of an entry that is better, and stops where the list is beyond twice its distance: by the triangle
        inequality, nothing from there on is nearer or as near. Rows advance side by side, one place of their list a step.
        """
        m, k = len(q), len(self.entries)
        best, place = np.zeros(m, np.int64), np.zeros(m, np.int64)
        visited = np.zeros((m, k), bool)
        visited[:, 0] = True
        least = ((q - self.entries[0]) ** 2).sum(axis=1)
        going = np.arange(m)
        while len(going):
            going = going[place[going] < k]
            b, p = best[going], place[going]
            near = self.between[b, p] <= 4 * least[going]
            going, b, p = going[near], b[near], p[near]
            entry = self.order[b, p]
            place[going] += 1
            new = ~visited[going, entry]
            at, entry = going[new], entry[new]
            visited[at, entry] = True
            gap = q[at] - self.entries[entry]
            d = np.einsum("ij,ij->i", gap, gap)
            better = (d < least[at]) | ((d == least[at]) & (entry < best[at]))
            at = at[better]
            best[at], least[at], place[at] = entry[better], d[better], 0
        return best, least


def part_slices(dim: int, parts: int) -> list[slice]:
    n = dim // parts
    return [slice(p * n, (p + 1) * n) for p in range(parts)]


def _searched(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of batches with their integer vectors, codes and squared distances, both by part."""
    searchers = [Codebook(b) for b in books]
    cuts = part_slices(sum(b.shape[1] for b in books), len(books))
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            batch = whole.slice(start, BATCH)
            x = unpacked_rows(batch.column(batch.schema.get_field_index("x")))
            found = [s.nearest(x[:, cut]) for s, cut in zip(searchers, cuts, strict=True)]
            yield batch, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _moved(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after a round: each entry the floor of the mean of the parts nearest to it; unused ones stay.

    A task adds up its rows and sends one row an entry, so that neither the shuffle nor the result grows with the table."""
    n = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for _, x, codes, _ in _searched(batches, books):
            for p, cut in enumerate(part_slices(x.shape[1], len(books))):
                counts[p] += np.bincount(codes[:, p], minlength=len(counts[p]))
                np.add.at(sums[p], codes[:, p], x[:, cut].astype(np.int64))
        for p, c in enumerate(counts):
            used = np.nonzero(c)[0]
            total = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * n), pa.array(sums[p][used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(c[used]), total], ["part", "entry", "n", "total"])

    per_task = vectors.select("x").mapInArrow(run, "part int, entry int, n long, total array<long>")
    whole = per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(n)]).alias("total"))
    moved = [b.copy() for b in books]
    for r in whole.collect():  # one row an entry at most
        moved[r.part][r.entry] = [t // r.n for t in r.total]
    return moved


def _coded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, codes, errors in _searched(batches, books):
            text = pa.array(["".join(f"{c:02x}" for c in row) for row in codes.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(errors.sum(axis=1).astype(np.int64))], ["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def integer_vectors(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, dim, x``: components as integers, without rows whose vector is null or not finite throughout."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in finite_vectors(batch.column(2), scale):
                own = [batch.column(k).take(pa.array(at)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(at), x.shape[1], np.int32)), packed_rows(x)], ["vec_id", "label", "dim", "x"])

    return rows.where("v is not null").mapInArrow(run, f"vec_id long, label {label}, dim int, x binary")


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of :func:`integer_vectors`, one matrix a part: the parts of the rows with the smallest ids (then
    by their components), moved ``rounds`` times. An empty table has none. Vectors have to be of one length here."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return []
    seeds = np.stack([np.frombuffer(r.x, dtype="<i4") for r in first]).astype(np.int64)
    if seeds.shape[1] % parts or not seeds.shape[1]:
        raise ValueError(f"vectors of {seeds.shape[1]} components have no {parts} equal parts")
    books = [seeds[:, cut].copy() for cut in part_slices(seeds.shape[1], parts)]
    for _ in range(rounds):
        books = _moved(vectors, books)
    return books


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, code, error, label_error, codebooks_sha256``.

    Vectors that are null or hold a null or non-finite component are dropped, and so are those without components or of
    another length than the one with the smallest id, which no codebook fits. Every part of the others gets the index of the nearest entry
    of its codebook (two hex digits a part), by :meth:`Codebook.nearest`; ``error`` is the squared distance that is
    left, ``label_error`` its sum over the rows of the label (null labels together), and the digest that of all
    entries. Null ids come last, rows that share an id are ordered by their components, and every row is coded,
    repeated ones too. Other columns are ignored; an empty table gives an empty result.

    The vectors are written once as integers; each round reads them once. The driver holds the codebooks only, and the
    tasks get them with the code: ``entries`` times the length of a vector, whatever the table's size.
    """
    rows = materialize(integer_vectors(vectors, scale, id_col, vector_col, label_col))
    first = rows.where("dim > 0").orderBy(F.col("vec_id").asc_nulls_last(), "x").select("dim").head()
    rows = rows.where(F.col("dim") == (first.dim if first else -1)).select("vec_id", "label", "x")
    books = train_codebooks(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    coded = materialize(_coded(rows, books or [np.zeros((1, 1), np.int64)] * parts))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 4 parts, 256 entries, 4 rounds, components in steps of 1/1024."""
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op12_sql() -> str:
    distance = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.v, c.v)])"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
    SELECT x.vec_id, x.label, x.p, x.v, min({distance} * {ENTRIES} + c.e) AS m
    FROM x JOIN c{r} c ON x.p = c.p GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (
    SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v
    FROM (SELECT p, m % {ENTRIES} AS e, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, len(v) + 1)) AS u(i) GROUP BY ALL)
    GROUP BY p, e)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.p = m.p AND c.e = m.e)")
    return f"""
WITH k AS (
    SELECT vec_id, label, [CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
x AS MATERIALIZED (
    SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) AS r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x QUALIFY e < {ENTRIES}),
{", ".join(steps)},
d AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}),
o AS (
    SELECT vec_id, label, string_agg(lower(printf('%02x', m % {ENTRIES})), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error
    FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, d"""


OP12_SQL = _op12_sql()
