"""Near-duplicate lines by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import SPACES, marked, materialize, slot_map, sub_batches, tiled, whole_groups
from tidemill.llm.components import components

#: Largest edit distance of a link, code points of a line for each edit that it may differ by, lines of one tile.
DISTANCE, PER_EDIT, TILE = 2, 10, 128
#: Slots of the bit map of keys that lines share.
SLOTS = 1 << 24


def radius(n: int, distance: int = DISTANCE, per_edit: int = PER_EDIT) -> int:
    """Edits by which a line of n code points may differ from a longer one: one for each ``per_edit`` code points (0: always
    ``distance``), ``distance`` at most, so that what is let through grows with what a line tells."""
    return min(distance, n // per_edit) if per_edit else distance


def segments(n: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Start and length of the distance + 1 segments of a line of n code points; the longer ones come last."""
    parts = distance + 1
    short, longer = n // parts, n % parts
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


@lru_cache(maxsize=4096)
def key_places(n: int, distance: int, per_edit: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(seed, start, end) of the segments under which a line of n code points is filed, and of those under which it
    looks for lines that are as long or shorter. A seed stands for a length and a segment's number. The shorter line's
    radius holds for a pair and sets the number of segments, one more than the edits, so one segment is left whole, and by
    the multi-match-aware choice it stands at one of these starts."""
    seed = lambda m, i: m * (distance + 1) + i
    own = [(seed(n, i), p, p + size) for i, (p, size) in enumerate(segments(n, radius(n, distance, per_edit)))]
    look = []
    for m in range(max(n - distance, 1), n + 1):
        more, edits = n - m, radius(m, distance, per_edit)
        if more > edits or m <= edits:
            continue
        for i, (p, size) in enumerate(segments(m, edits)):
            first = max(p - i, p + more - (edits - i), 0)
            last = min(p + i, p + more + (edits - i), n - size)
            look += [(seed(m, i), q, q + size) for q in range(first, last + 1) if (more, q) != (0, p)]
    return own, look


def line_keys(line: str, distance: int = DISTANCE, per_edit: int = 0) -> tuple[list[int], list[int]]:
    """Hashes of the segments of :func:`key_places`: those under which a line is filed, and those it looks under."""
    own, look = key_places(len(line), distance, per_edit)
    digest = xxhash.xxh64_intdigest
    cut = line.encode() if line.isascii() else line  # the same bytes either way
    return [digest(cut[p:q], k) for k, p, q in own], [digest(cut[p:q], k) for k, p, q in look]


def within(a: str, b: str, distance: int = DISTANCE) -> bool:
    """Whether the edit distance is ``distance`` at most, by bit vectors of the 2 * distance + 1 cells around the
    diagonal. Bit d of ``reach[e]`` tells that, with e edits, the cell d - distance off the diagonal is reached."""
    if abs(len(a) - len(b)) > distance:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    while hi > lo and a[len(a) - 1 - (min(len(a), len(b)) - hi)] == b[len(b) - 1 - (min(len(a), len(b)) - hi)]:
        hi -= 1
    tail = min(len(a), len(b)) - hi
    a, b = a[lo : len(a) - tail], b[lo : len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    width = 2 * distance + 1
    full = (1 << width) - 1
    bits: dict[str, int] = {}
    for j, c in enumerate(b):
        bits[c] = bits.get(c, 0) | 1 << (j + distance)
    reach, x = [], 0
    for e in range(distance + 1):
        x |= 1 << (distance + e)  # e characters of b inserted before the first of a
        reach.append(x)
    for i, c in enumerate(a):
        same = bits.get(c, 0) >> i & full
        new = []
        for e in range(distance + 1):
            y = reach[e] & same  # the characters agree
            if e:
                # changed; deleted (one place down the diagonals); inserted (one place up, in this row)
                y |= reach[e - 1] | reach[e - 1] >> 1 | new[e - 1] << 1
            new.append(y & full)
        if not new[distance]:
            return False
        reach = new
    off = len(b) - len(a) + distance
    return bool(reach[distance] >> off & 1)


def lines_of(text: str | None) -> list[str]:
    """Lines of a text, without the white space around each; a null or empty text has none."""
    return [x.strip(SPACES) for x in text.split("\n")] if text else []


#: A document in these tables: its id and a hash of its text.
IDENTITY = ["doc_id", "h"]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def first_places(docs: DataFrame) -> DataFrame:
    """``line, doc_id, h, pos`` from ``doc_id, h, text``: each non-empty line once for each batch of documents, at its
    first place there (smallest id, null last, then hash, then line number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches):
            first: dict[str, tuple] = {}
            for i, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for pos, line in enumerate(lines_of(t)):
                    if line and (line not in first or (i is None, i or 0, h, pos) < first[line]):
                        first[line] = i is None, i or 0, h, pos
            ids = pa.array([None if none else i for none, i, _, _ in first.values()], pa.int64())
            hs, places = (pa.array([x[k] for x in first.values()], kind) for k, kind in ((2, pa.int64()), (3, pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), ids, hs, places], ["line", *IDENTITY, "pos"])

    return docs.mapInArrow(run, "line string, doc_id long, h long, pos int")


def line_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, h, n_lines, empty``: the number of lines of each row and the numbers of the empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches):
            lines = [lines_of(t) for t in b.column(2).to_pylist()]
            empty = [[pos for pos, x in enumerate(ls) if not x] for ls in lines]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(ls) for ls in lines], pa.int64()), pa.array(empty, pa.list_(pa.int32()))], [*IDENTITY, "n_lines", "empty"])

    return docs.mapInArrow(run, "doc_id long, h long, n_lines long, empty array<int>")


def keyed(lines: DataFrame, distance: int = DISTANCE, per_edit: int = PER_EDIT) -> DataFrame:
    """``rep, key, filed`` for every key of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "line", chars=1_000_000):
            keys: list[int] = []
            ends, owns = [0], []
            for s in b.column(1).to_pylist():
                own, look = line_keys(s, distance, per_edit)
                keys += own
                keys += look
                ends.append(len(keys))
                owns.append(len(own))
            flat = np.array(keys, dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(owns, pa.int32()), lists], ["rep", "own", "keys"])

    each = lines.select("rep", "line").mapInArrow(run, "rep long, own int, keys array<long>").select("rep", "own", F.posexplode("keys").alias("k", "key"))
    return each.select("rep", "key", (F.col("k") < F.col("own")).alias("filed"))


def _verify(distance: int, per_edit: int) -> Callable:
    def group_links(g: pd.DataFrame, a: list[int], b: list[int]) -> None:
        i, j = g["i"].iat[0], g["j"].iat[0]
        own, filed, ids, lines = (g[c].to_numpy() for c in ("own", "filed", "rep", "line"))
        p, q = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        root = list(range(len(g)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x in p.tolist():
            for y in q.tolist():
                if (i != j or x < y) and (filed[x] or filed[y]) and ids[x] != ids[y]:
                    r, s = find(x), find(y)
                    if r != s and within(lines[x], lines[y], radius(min(len(lines[x]), len(lines[y])), distance, per_edit)):  # joined ones need no further link
                        root[s] = r
                        a.append(ids[x])
                        b.append(ids[y])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a: list[int] = []
        b: list[int] = []
        for _, g in pdf.groupby(["key", "i", "j"], sort=False):
            group_links(g, a, b)
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return whole_groups(solve, ["key", "i", "j"])


def line_links(lines: DataFrame, distance: int = DISTANCE, per_edit: int = PER_EDIT, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` between distinct lines (``rep, line``) within the shorter one's :func:`radius`, as many as join the
    same groups. Lines that share a key meet; keys under which nothing is filed or one line stands alone end before any text
    moves, and a key with more than ``tile`` lines is dealt into tiles, each pair of them a group of its own."""
    live = keyed(lines, distance, per_edit).groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("filed").alias("filed")).where("filed and c > 1")
    # A bit map of fixed size drops most of the dead keys where they are made.
    slot = F.pmod("key", F.lit(SLOTS))
    slots = materialize(slot_map(live.select(slot.alias("slot"))))
    rows = marked(keyed(lines, distance, per_edit), slot, slots).where("__marked").select("rep", "key", "filed")
    rows = materialize(rows)
    # Another one lets only lines with a live key be shuffled.
    own = F.pmod(F.xxhash64("rep"), F.lit(SLOTS))
    some = marked(lines.select("rep", "line"), own, slot_map(rows.select(own.alias("slot")))).where("__marked").select("rep", "line")
    rows = rows.join(some, "rep")
    return tiled(rows, ["key"], tile).mapInPandas(_verify(distance, per_edit), "a long, b long")


def line_dedup(docs: DataFrame, distance: int = DISTANCE, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, h, row, n_lines, kept_lines`` (numbers of the lines that stay, from 0, in
    order); ``h`` is the hash of the text and ``row`` a number of this row alone.

    Lines are compared without the white space around them. Equal lines are one group, and lines join others at as many
    edits as the shorter one's :func:`radius`: one for each ``per_edit`` code points, ``distance`` at most (an edit makes
    another word of a line that is one short word).
    Of each group the first occurrence (smallest id, null last, then text hash and line number; for a line that rows
    of the same id share, in any one of them) stays; empty lines
    always stay. Null and empty texts have no lines. Rows with equal or null ids are documents of their own; of rows
    that repeat id and text one keeps the lines. Other columns are ignored; an empty table gives an empty result.

    Equal lines become one before anything is compared (combined before the shuffle), so a line that stands in a
    third of all documents is one row.
    """
    rows = identified(docs, id_col, text_col)
    per = materialize(line_counts(rows).withColumn("row", F.monotonically_increasing_id()))
    # Plain numbers, so that Spark combines them by hashing; a null id comes last.
    none = F.lit((1 << 63) - 1)
    # Hash and line number as one number, so that both come from one place where rows share an id.
    both = F.expr("cast(h as decimal(20, 0)) * cast(2147483648 as decimal(10, 0)) + pos")
    places = first_places(rows).select("line", F.coalesce("doc_id", none).alias("i"), both.alias("hp"))
    distinct = places.groupBy("line").agg(F.min("i").alias("i"), F.min_by("hp", "i").alias("hp")).withColumn("pos", F.expr("pmod(hp, 2147483648)"))
    distinct = distinct.select("line", "i", F.expr("(hp - pos) div 2147483648").alias("h"), F.col("pos").cast("int").alias("pos"))
    first = F.struct((F.col("i") == none).alias("o"), F.nullif("i", none).alias("doc_id"), "h", "pos")
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("rep"), "line", first.alias("first")))
    # Lines whose radius is 0 have no others than their equals.
    comps = components(line_links(distinct.where(F.length("line") >= per_edit), distance, per_edit))
    groups = distinct.select("rep", "first").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    first = groups.groupBy(F.coalesce("component", "rep").alias("g")).agg(F.min("first").alias("first"))
    kept = first.groupBy("first.doc_id", "first.h").agg(F.collect_list("first.pos").alias("firsts")).alias("k")
    ones = per.groupBy(*IDENTITY).agg(F.min("row").alias("row")).alias("p")
    same = F.col("k.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("k.h") == F.col("p.h"))
    kept = kept.join(ones, same).select("row", "firsts")
    joined = per.join(kept, "row", "left")
    numbers = F.array_sort(F.concat("empty", F.coalesce("firsts", F.array().cast("array<int>"))))
    return joined.select("doc_id", "h", "row", "n_lines", numbers.alias("kept_lines"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents: an edit for each ten code points of the shorter line, two at most."""
    kept = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    numbers = F.array_join(F.col("kept_lines").cast("array<string>"), ",")
    return kept.select("doc_id", "n_lines", F.size("kept_lines").cast("long").alias("n_kept"), numbers.alias("kept_lines"))
