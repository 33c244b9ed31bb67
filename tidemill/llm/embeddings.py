"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors and exact recomputation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import materialize, tiled, whole_groups
from tidemill.llm.components import components
from tidemill.llm.simhash import group_ranges, near_in_groups, spanning

#: Least cosine of a link, chance that a pair at that cosine shares no bucket, width of the confidence bounds in
#: standard errors, vectors of one tile, seed of the rotations.
COSINE, MISS, SIGMAS, TILE, SEED = 0.93, 1e-4, 6.0, 512, 7
#: Bits of the signs that rows carry into their buckets, and the logarithm of the rows of a bucket of unlike vectors.
SIGNS, BUCKET_BITS = 256, 8


def rotation(dim: int, k: int, seed: int = SEED) -> np.ndarray:
    """The k-th random orthogonal matrix of a dimension, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def key_plan(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket's key, growing with the logarithm of the rows, so that buckets of unlike vectors stay as they
    are, and the number of keys so that a pair at ``cosine`` misses all of them with probability ``miss`` at most."""
    bits = min(max(math.ceil(math.log2(max(rows, 2))) - BUCKET_BITS, 4), 48)
    hit = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - hit))


def sign_radius(cosine: float = COSINE, sigmas: float = SIGMAS) -> int:
    """Differing signs of SIGNS random directions up to which a pair may have the cosine: the angle's share of a half
    turn is their expected share, and ``sigmas`` standard errors are added."""
    p = math.acos(cosine) / math.pi
    return int(SIGNS * p + sigmas * math.sqrt(SIGNS * p * (1 - p)))


def unit_vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors (doubles) of the valid rows, by length; null, empty and zero vectors and those with a
    null or non-finite component have none."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    for dim in np.unique(size[size > 0]).tolist():
        at = np.nonzero(size == dim)[0]
        x = flat[ends[at][:, None] + np.arange(dim)].astype(np.float64)
        big = np.abs(x).max(axis=1)
        good = np.isfinite(big) & (big > 0)
        x, at = x[good] / big[good, None], at[good]
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(vectors: DataFrame, bits: int, keys: int, seed: int = SEED) -> DataFrame:
    """``rep, weight, label, dim, x, code, factor, signs, keys``: the unit vector as doubles, the sign bits of its
    rotation, the correction factor <o, code> stored with them, signs of further rotations, and the bucket keys from
    others. Rows without a valid vector don't come out."""
    names = ["rep", "weight", "label", "dim", "x", "code", "factor", "signs", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[tuple[int, int], np.ndarray] = {}

        def turn(dim: int, k: int) -> np.ndarray:
            if (dim, k) not in turns:
                turns[dim, k] = rotation(dim, k, seed)
            return turns[dim, k]

        def packed(bits: np.ndarray) -> pa.Array:
            return pa.array([r.tobytes() for r in np.packbits(bits, axis=1, bitorder="little")], pa.binary())

        power = 1 << np.arange(bits, dtype=np.int64)
        need = keys * bits + SIGNS
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                for at, x in unit_vectors(batch.column(3)):
                    if not len(at):
                        continue
                    dim = x.shape[1]
                    turned = x @ turn(dim, 0)
                    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
                    signs = np.concatenate([x @ turn(dim, k) for k in range(1, 1 + -(-need // dim))], axis=1)[:, :need] > 0
                    key = (signs[:, : keys * bits].reshape(len(x), keys, bits) * power).sum(axis=2)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, keys, dtype=np.int32)), pa.array(key.ravel()))
                    take = pa.array(at)
                    own = [batch.column(k).take(take) for k in range(3)]
                    exact = pa.array([r.tobytes() for r in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(at), dim, np.int32)), exact, packed(turned > 0), pa.array(factor), packed(signs[:, keys * bits :]), lists], names)

    rows = vectors.select("rep", "weight", F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "rep long, weight long, label string, dim int, x binary, code binary, factor double, signs binary, keys array<long>")


def estimate(code_a: np.ndarray, factor_a: np.ndarray, turned_b: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded unit vectors with exact rotated ones, and the standard error
    of each: with the code c scaled to a unit vector, <c, q> / <c, o> estimates <o, q>."""
    c = (code_a * 2.0 - 1.0) / math.sqrt(dim)
    error = np.sqrt(np.maximum(1 - factor_a**2, 0) / factor_a**2 / max(dim - 1, 1))
    return (c @ turned_b.T) / factor_a[:, None], error[:, None]


def _with_company(limit: int) -> Callable:
    """Rows of a group that have another one within the radius of their signs."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, y = group_ranges(pdf)
        signs = np.frombuffer(b"".join(pdf["signs"]), dtype="<u8").reshape(len(pdf), -1)
        a, b = near_in_groups(signs, x, y, limit)
        return pdf.loc[np.unique(np.concatenate([a, b])), ["key", "i", "j", "own", "rep"]]

    return whole_groups(solve, ["key", "i", "j"])


def _links(cosine: float, sigmas: float, seed: int) -> Callable:
    turns: dict[int, np.ndarray] = {}

    def group_links(g: pd.DataFrame) -> tuple[np.ndarray, ...]:
        i, j, t, dim = (int(g[c].iat[0]) for c in ("i", "j", "t", "dim"))
        own = g["own"].to_numpy()
        p, q = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        rep, weight = g["rep"].to_numpy(), g["weight"].to_numpy()
        x = np.stack([np.frombuffer(v) for v in g["x"]])
        code = np.unpackbits(np.stack([np.frombuffer(v, dtype=np.uint8) for v in g["code"]]), axis=1, bitorder="little")[:, :dim]
        if dim not in turns:
            turns[dim] = rotation(dim, 0, seed)
        guess, error = estimate(code[p], g["factor"].to_numpy()[p], x[q] @ turns[dim], dim)
        a, b = np.nonzero(guess + sigmas * error >= cosine)  # the others are out by their upper bound
        if i == j:
            a, b = a[p[a] < q[b]], b[p[a] < q[b]]
        a, b = p[a], q[b]
        if t:  # those that met in an earlier table are counted there
            keys = np.stack(g["keys"].to_numpy())[:, :t]
            new = ~(keys[a] == keys[b]).any(axis=1)
            a, b = a[new], b[new]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        a, b = a[near], b[near]
        return rep[a], rep[b], weight[a], weight[b]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [group_links(g) for _, g in pdf.groupby(["key", "i", "j", "label", "dim"], sort=False)]
        a, b, wa, wb = (np.concatenate(c) for c in zip(*found, strict=True))
        rep, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        links = np.bincount(at, weights=np.concatenate([wb, wa]), minlength=len(rep)).astype(np.int64)
        a, b = spanning(a, b)
        return pd.DataFrame({"a": np.concatenate([rep, a]), "b": np.concatenate([rep, b]), "links": np.concatenate([links, np.zeros(len(a), np.int64)])})

    return whole_groups(solve, ["key", "i", "j"])


def embedding_groups(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, sigmas: float = SIGMAS, tile: int = TILE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors of equal, non-null labels and of the same length link at a cosine of ``cosine`` or more, in double
    precision; vectors that are null, empty, zero or hold null or non-finite components link with nothing. Equal
    vectors of a label become one node with a weight first, so copies are never paired. Rows with equal or null ids
    are rows like any other; a null id is a component's only where all its ids are. Other columns are ignored and an
    empty table gives an empty result.

    Nodes meet in buckets of sign bits of random rotations, in so many tables that a pair at the threshold is missed
    with probability ``miss``, a nearer one with less. Into the buckets go SIGNS further sign bits alone; only rows
    with another one within :func:`sign_radius` of them there are joined with their vectors. Of these, pairs
    whose upper confidence bound (``sigmas`` standard errors over the estimate from the binary code and its
    factor) is under the threshold end; the others' cosines are computed exactly, in the first table in which they
    meet. A bucket of more than ``tile`` nodes is dealt into tiles and each pair of tiles is a group of its own. What
    leaves a group are counts per node and links that span it, not pairs.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    # 128 bits that stand for the label and the vector.
    v = v.withColumns({"h": F.xxhash64("label", "embedding"), "h2": F.xxhash64("embedding", "label")})
    first = [F.first(c).alias(c) for c in ("label", "embedding")]
    classes = v.where("label is not null and embedding is not null").groupBy("h", "h2").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"), *first,
    )
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))
    bits, keys = key_plan(classes.count(), cosine, miss)
    nodes = materialize(coded(classes, bits, keys, seed))
    each = nodes.select("rep", "label", "dim", "signs", F.posexplode("keys").alias("t", "k"))
    rows = each.select("rep", "signs", F.xxhash64("label", "dim", "t", "k").alias("key"))
    place = ["key", "i", "j"]
    near = materialize(tiled(rows, ["key"], tile).mapInPandas(_with_company(sign_radius(cosine, sigmas)), "key long, i int, j int, own int, rep long"))
    full = near.join(nodes.drop("signs"), "rep").withColumn(
        "t", F.expr("array_position(transform(keys, (k, t) -> xxhash64(label, dim, t, k)), key) - 1"),
    )
    found = full.repartition(*place).sortWithinPartitions(*place).mapInPandas(_links(cosine, sigmas, seed), "a long, b long, links long")
    found = materialize(found)
    comps = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    valid = nodes.select("rep", F.lit(True).alias("valid"))
    per = classes.select("rep", "h", "h2", "weight", "low").join(valid, "rep").join(links, "rep", "left").join(comps, "rep", "left")
    per = per.select("h", "h2", "low", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("c")).where("n_links > 0")
    per = materialize(per)
    linked = per.join(per.groupBy("c").agg(F.min("low").alias("component_id")), "c").select("h", "h2", "n_links", "component_id")
    joined = v.select("vec_id", "h", "h2").join(materialize(linked), ["h", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings at a cosine of 0.93 or more."""
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
