"""Near duplicates by SimHash with bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import materialize, sub_batches, tiled, whole_groups
from tidemill.llm.components import components

#: Words of a shingle, radius in bits, fingerprints of one tile.
SHINGLE, RADIUS, TILE = 3, 2, 512
#: 64-bit words of counters that are updated at once, and bit planes that are laid out at once.
LANES, SLAB = 1 << 14, 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 values (seed 42) of the shingles of one text in order; fewer words than a shingle are one."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, 42)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def widened(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` hashes of 64 bits for each of ``h``: itself, then finalised sums with multiples of an odd constant."""
    out = np.empty((len(h), words), dtype="<u8")
    for k in range(words):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        if k:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        out[:, k] = x
    return out


def simhash(h: np.ndarray, words: int = 1) -> np.ndarray:
    """SimHash of hashed shingles in ``words`` 64-bit words: a bit is 1 if set in over half of them; 0 without any."""
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(h), 100_000):
        part = widened(h[at : at + 100_000], words)
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        lanes = bits.view(np.uint64)  # eight byte-wide counters in a word: 255 rows can't overflow them
        for k in range(0, len(lanes), 255):
            counts += np.add.reduce(lanes[k : k + 255], axis=0).view(np.uint8)
    return np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text."""
    return int(simhash(shingle_hashes(text, shingle))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row; null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


class Distances:
    """Distances of many pairs at once as bit slices: slice k holds bit k of every pair's sum. Two planes of new bits
    and a slice go through one carry-save adder, whose carry waits for a second one at the next slice. Sums begin so
    high that radius + 1 differences overflow the last slice; what overflows is over for good."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        width = (radius + 1).bit_length()
        start = (1 << width) - (radius + 1)
        full = ~np.uint64(0)
        self.sums = [np.full(shape, full if start >> i & 1 else np.uint64(0)) for i in range(width)]
        self.waiting: list[np.ndarray | None] = [None] * width
        self.over = np.zeros(shape, dtype=np.uint64)

    def add(self, plane: np.ndarray, level: int = 0) -> None:
        if level == len(self.sums):
            self.over |= plane
            return
        first, self.waiting[level] = self.waiting[level], None
        if first is None:
            self.waiting[level] = plane
            return
        s = self.sums[level]
        odd = s ^ first
        first &= s  # the planes belong to the counters: reused for the carry
        s[...] = odd ^ plane
        plane &= odd
        first |= plane
        self.add(first, level + 1)

    def settle(self) -> None:
        """Add what still waits for a partner."""
        for level in range(len(self.sums)):
            if self.waiting[level] is not None:
                self.add(np.zeros_like(self.over), level)

    def all_over(self) -> bool:
        return bool((self.over == ~np.uint64(0)).all())


def near_in_groups(fp: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with rows i and j of ``fp`` (n, words) at ``radius`` bits or fewer, for many groups at once:
    group g compares each row of ``x[g] = (start, length)`` with each of ``y[g]``; i < j where both are the same range.

    Bit planes of the y are vertical (a word has one bit of 64 rows), those of the x are spread to whole words.
    Groups of like sizes share a block, and a block ends once each of its pairs is over the radius."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    bits = np.ascontiguousarray(bits.T)
    order = np.lexsort((x[:, 1], -(-y[:, 1] // 64)))
    at = 0
    while at < len(order):
        wide = -(-int(y[order[at], 1]) // 64)
        end = min(len(order), at + max(1, LANES // (wide * max(1, int(x[order[at], 1])))))
        part = order[at:end]
        part = part[(-(-y[part, 1] // 64) == wide) & (x[part, 1] <= max(4, 2 * int(x[order[at], 1])))]
        at += len(part)
        tall = int(x[part, 1].max())
        if wide == 0 or tall == 0:
            continue
        rows = x[part, 0][:, None] + np.minimum(np.arange(tall), np.maximum(x[part, 1], 1)[:, None] - 1)
        cols = y[part, 0][:, None] + np.minimum(np.arange(64 * wide), y[part, 1][:, None] - 1)
        # What pads a group is over from the start.
        inside = np.ascontiguousarray(np.packbits(np.arange(64 * wide) < y[part, 1][:, None], axis=1, bitorder="little")).view(np.uint64)
        state = Distances((len(part), tall, wide), radius)
        state.over |= ~inside[:, None, :]
        state.over[np.arange(tall) >= x[part, 1][:, None]] = ~np.uint64(0)
        for slab in range(0, len(bits), SLAB):
            planes = np.ascontiguousarray(np.packbits(bits[slab : slab + SLAB, cols], axis=2, bitorder="little")).view(np.uint64)
            ones = np.ascontiguousarray(bits[slab : slab + SLAB, rows]) * ~np.uint64(0)
            for plane, one in zip(planes, ones, strict=True):
                state.add(plane[:, None, :] ^ one[:, :, None])
            if state.all_over():
                break
        else:
            state.settle()
        g, i, w = np.nonzero(~state.over)
        hit, bit = np.nonzero(np.unpackbits((~state.over[g, i, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = rows[g[hit], i[hit]], cols[g[hit], w[hit] * 64 + bit]
        same = (x[part] == y[part]).all(axis=1)[g[hit]]
        keep = ~same | (a < b)
        left.append(a[keep])
        right.append(b[keep])
    return np.concatenate(left), np.concatenate(right)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: every node of a link to the smallest node that it reaches here."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            keep = low != np.arange(len(nodes))
            return nodes[keep], nodes[low[keep]]
        low = new


def group_ranges(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows in the order of their groups (``key, i, j``, then ``own``) and the two ranges of each group: the rows of
    tile i, and those of tile j."""
    pdf = pdf.sort_values(["key", "i", "j", "own"], kind="stable", ignore_index=True)
    key, i, j, own = (pdf[c].to_numpy() for c in ("key", "i", "j", "own"))
    new = np.ones(len(pdf), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    start = np.nonzero(new)[0]
    size = np.diff([*start, len(pdf)])
    group = np.cumsum(new) - 1
    first = np.bincount(group[own == i], minlength=len(start))
    same = i[start] == j[start]
    x = np.stack([start, first], axis=1)
    y = np.stack([np.where(same, start, start + first), np.where(same, first, size - first)], axis=1)
    return pdf, x, y


def _links(radius: int) -> Callable:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, y = group_ranges(pdf)
        rep = pdf["rep"].to_numpy()
        a, b = near_in_groups(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64)[:, None], x, y, radius)
        a, b = spanning(rep[a], rep[b])
        return pd.DataFrame({"a": a, "b": b})

    return whole_groups(solve, ["key", "i", "j"])


def part_keys(fp: str | Column, radius: int, parts: int) -> Column:
    """Bucket keys of a fingerprint, one for each choice of ``parts - radius`` of its equal parts."""
    width = 64 // parts
    piece = lambda k: F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1))
    tables = enumerate(combinations(range(parts), parts - radius))
    return F.array(*[F.xxhash64(F.lit(t), *[piece(k) for k in c]) for t, c in tables])


def linked_fingerprints(nodes: DataFrame, radius: int = RADIUS, parts: int = 4, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` between the ids ``rep`` of distinct fingerprints ``fp`` at ``radius`` bits or fewer: as many
    as join the same components, not each pair.

    The 64 bits are cut into ``parts`` equal parts. Two fingerprints within the radius agree in at least
    ``parts - radius`` of them, so every choice of that many parts is a table whose buckets are compared in full;
    no pair is missed. A bucket with more than ``tile`` rows is dealt by hash into tiles, and each pair of tiles
    is a task's group of its own, so no bucket is gathered in one place.
    """
    rows = nodes.select("rep", "fp", F.explode(part_keys("fp", radius, parts)).alias("key"))
    return tiled(rows, ["key"], tile).mapInPandas(_links(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    reachable over links of ``radius`` bits or fewer.

    Null, empty and blank texts have fingerprint zero and link like any other; a text of fewer words than a
    shingle is one shingle. Rows that repeat an id come out once each. A null id is a row like any other but no
    component's id, unless all ids of a component are null. Equal fingerprints become one node first, so exact copies
    are never paired. An empty table gives an empty result; other columns are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    # Numbers of their own, as ids can be null or repeated.
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = materialize(nodes.select("fp", "low", F.monotonically_increasing_id().alias("rep")))
    comps = components(linked_fingerprints(nodes, radius)).withColumnRenamed("node", "rep")
    named = nodes.join(comps, "rep", "left").select("fp", "low", F.coalesce("component", "rep").alias("c"))
    lows = named.groupBy("c").agg(F.min("low").alias("component_id"))
    classes = named.join(lows, "c").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(classes, "fp").select("doc_id", hexed, "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and their groups at two differing bits."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
