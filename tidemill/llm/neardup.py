"""The near-dedup stage: wide SimHash fingerprints find candidates, whole shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import marked, materialize, slot_map, sub_batches, tiled, whole_groups
from tidemill.llm.components import components
from tidemill.llm.simhash import TILE, group_ranges, near_in_groups, shingle_hashes, simhash

#: Words of a shingle and least Jaccard similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint, and of the longer one for groups of many near texts.
WORDS, LONG_WORDS = 4, 32
#: Standard errors between the mean distance of a pair at the similarity and the radius; chance that such a pair
#: shares no bucket.
SIGMAS, MISS = 3.0, 0.01
#: Logarithm of the rows of a bucket of unlike fingerprints.
BUCKET_BITS = 8
#: Pairs within the radius for each row of a bucket, over which the bucket is searched in two steps.
THICK = 2
#: Pairs that meet a copy of the set of the row they share.
HUB_PAIRS = 256
#: Slots of the bit maps that tell scans which texts matter.
SLOTS = 1 << 25
SEED = 7


def differing(similarity: float) -> float:
    """Share of differing bits of two SimHashes: the angle between indicator vectors of sets with that similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(bits: int, similarity: float = SIMILARITY, sigmas: float = SIGMAS) -> int:
    p = differing(similarity)
    return int(bits * p + sigmas * math.sqrt(bits * p * (1 - p)))


def table_plan(rows: int, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket's key, growing with the logarithm of the rows so that buckets of unlike texts stay as they
    are, and the number of tables so that a pair at the similarity shares no bucket with probability ``miss``."""
    bits = min(max(math.ceil(math.log2(max(rows, 2))) - BUCKET_BITS, 6), 48)
    return bits, math.ceil(math.log(miss) / math.log(1 - (1 - differing(similarity)) ** bits))


def text_key(text_col: str) -> Column:
    """MD5 of the text as 16 bytes: what texts are called by in joins; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id, tid, digest, fp``: the text's key, a hash of its set of shingles, and that set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in b.column(2).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            fps = [simhash(s, WORDS).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(fps, pa.binary())], ["doc_id", "tid", "digest", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tid"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, tid binary, digest binary, fp binary")


def shingle_sets(docs: DataFrame, named: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """The columns of ``named``, which has a row for each ``tid``, and ``shingles`` of the texts that it names. A bit map of
    fixed size drops other texts in the scan."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches):
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in b.column(b.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], arrays], [*b.schema.names[:-1], "shingles"])

    slot = F.pmod(F.xxhash64("tid"), F.lit(SLOTS))
    texts = docs.select(text_key(text_col).alias("tid"), F.col(text_col).alias("text"))
    near = marked(texts, slot, slot_map(named.select(slot.alias("slot")))).where("__marked").select("tid", "text")
    one = near.join(named, "tid").groupBy(*named.columns).agg(F.first("text").alias("text"))
    return materialize(one.mapInArrow(run, f"{kinds}, shingles array<long>"))


def keyed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``rep, fp, key``: a row for each table, whose key hashes the table's number and its choice of the bits of the
    fingerprint."""
    places = np.stack([np.random.default_rng([SEED, t]).choice(64 * WORDS, bits, replace=False) for t in range(tables)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                fp = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
                own = np.unpackbits(fp, axis=1, bitorder="little").astype(np.int64)
                keys = np.stack([own[:, p] @ power for p in places], axis=1) * len(places) + np.arange(len(places))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(places), dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["rep", "fp", "keys"])

    each = nodes.select("rep", "fp").mapInArrow(run, "rep long, fp binary, keys array<long>")
    return each.select("rep", "fp", F.explode("keys").alias("key"))


def words_of(fp: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(fp), dtype="<u8").reshape(len(fp), -1)


def pairs_frame(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> pd.DataFrame:
    """Distinct pairs ``a < b``, and rows with a ``key`` alone."""
    ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    pad = [None] * len(key)
    return pd.DataFrame({"a": pd.array([*ab[:, 0].tolist(), *pad], "Int64"), "b": pd.array([*ab[:, 1].tolist(), *pad], "Int64"), "key": pd.array([*[None] * len(ab), *key.tolist()], "Int64")})


def _first_step(limit: int) -> Callable:
    """Pairs within the radius; of a thick bucket, or a tile of a split one, those with its middle row only, and its
    key. The middle row is the one nearest to the majority of the bucket's bits."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, _ = group_ranges(pdf)
        fp, rep, key, tiles = words_of(pdf["fp"]), pdf["rep"].to_numpy(), pdf["key"].to_numpy(), pdf["split"].to_numpy()
        a, b = near_in_groups(fp, x, x, limit)
        group = np.repeat(np.arange(len(x)), x[:, 1])
        thick = (np.bincount(group[a], minlength=len(x)) > THICK * x[:, 1]) | tiles[x[:, 0]]
        out_a, out_b = [a[~thick[group[a]]]], [b[~thick[group[a]]]]
        for start, size in x[thick].tolist():
            own = fp[start : start + size]
            bits = np.unpackbits(np.ascontiguousarray(own).view(np.uint8), axis=1, bitorder="little")
            middle = np.packbits(bits.sum(axis=0) * 2 > size, bitorder="little").view("<u8")
            hub = start + int(np.bitwise_count(own ^ middle).sum(axis=1).argmin())
            p, q = near_in_groups(fp, np.array([[hub, 1]]), np.array([[start, size]]), limit)
            out_a.append(p[p != q])
            out_b.append(q[p != q])
        return pairs_frame(rep[np.concatenate(out_a)], rep[np.concatenate(out_b)], np.unique(key[x[thick, 0]]))

    return whole_groups(solve, ["key", "i", "j"])


def _second_step(limit: int) -> Callable:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, y = group_ranges(pdf)
        rep, comp = pdf["rep"].to_numpy(), pdf["component"].to_numpy()
        a, b = near_in_groups(words_of(pdf["fp"]), x, y, limit)
        apart = comp[a] != comp[b]
        return pairs_frame(rep[a[apart]], rep[b[apart]], np.empty(0, dtype=np.int64))

    return whole_groups(solve, ["key", "i", "j"])


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float, hub_pairs: int = HUB_PAIRS) -> DataFrame:
    """Those of the distinct ``a, b`` whose whole sets of shingles have the similarity.

    A pair takes the set of its end with fewer pairs to the set of the other end, its hub. A hub's set is copied once for
    each ``hub_pairs`` of its pairs, among which they are dealt: what moves is a set a pair, however many share a hub, and
    no task gets all of them."""
    degrees = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("deg")))
    ends = pairs.join(degrees.select(F.col("rep").alias("a"), F.struct("deg", "rep").alias("of_a")), "a").join(
        degrees.select(F.col("rep").alias("b"), F.struct("deg", "rep").alias("of_b")), "b",
    )
    ends = ends.select(F.least("of_a", "of_b")["rep"].alias("leaf"), F.greatest("of_a", "of_b").alias("hub"))
    parts = F.ceil(F.col("hub.deg") / hub_pairs).cast("int")
    ends = materialize(ends.select("leaf", "hub.rep", parts.alias("parts")).withColumnRenamed("rep", "hub"))
    roles = ends.select(F.col("leaf").alias("rep"), F.lit(True).alias("leaf"), F.lit(0).alias("parts")).unionByName(
        ends.select(F.col("hub").alias("rep"), F.lit(False).alias("leaf"), "parts"),
    )
    roles = roles.groupBy("rep").agg(F.max("leaf").alias("leaf"), F.max("parts").alias("parts"))
    named = materialize(nodes.select("rep", "tid").join(roles, "rep"))
    sets = shingle_sets(docs, named, text_col, shingle)
    sent = ends.join(sets.where("leaf").select(F.col("rep").alias("leaf"), F.col("shingles").alias("x")), "leaf")
    sent = sent.withColumn("part", F.pmod(F.xxhash64("leaf"), F.col("parts")).cast("int")).drop("parts")
    hubs = sets.where("parts > 0").select(F.col("rep").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("y"))
    both = sent.join(hubs, ["hub", "part"])
    both = both.select("leaf", "hub", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("shared"))
    near = both.where(F.col("shared") >= similarity * (F.col("n") - F.col("shared")))
    return near.select(F.least("leaf", "hub").alias("a"), F.greatest("leaf", "hub").alias("b"))


def long_fingerprints(nodes: DataFrame, docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``rep, fp`` with LONG_WORDS words, of the sets of ``nodes`` (``rep, tid``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(np.array(s, dtype=np.int64).view(np.uint64), LONG_WORDS).tobytes() for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], ["rep", "fp"])

    return shingle_sets(docs, nodes, text_col, shingle).select("rep", "shingles").mapInArrow(run, "rep long, fp binary")


def apart_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """``rows`` (``rep, component, fp, key``) dealt into tiles such that rows of different components of each key meet:
    those of a key's largest component are tiles of their own that don't meet each other, so a large group of near
    texts costs as many rows as it has, times the tiles of the rows outside it. Keys of one component end here."""
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    parts = parts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("all"))
    tiles = lambda c: F.ceil(c / tile).cast("int")
    parts = parts.where("all > most.c").select(
        "key", F.col("most.component").alias("main"), tiles(F.col("most.c")).alias("m"),
        tiles(F.col("all") - F.col("most.c")).alias("o"),
    )
    dealt = rows.join(materialize(parts), "key").withColumn("h", F.xxhash64("rep"))
    inside = F.col("component") == F.col("main")
    dealt = dealt.withColumn("own", F.when(inside, F.pmod("h", "m")).otherwise(F.col("m") + F.pmod("h", "o")).cast("int"))
    other = F.explode(F.sequence(F.when(inside, F.col("m")).otherwise(F.lit(0)), F.col("m") + F.col("o") - 1))
    dealt = dealt.withColumn("other", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    dealt = dealt.select("key", "i", "j", "own", "rep", "component", "fp")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE, miss: float = MISS) -> tuple[DataFrame, DataFrame]:
    """``doc_id, tid, digest`` of each row of ``docs``, and ``digest, component, c, first`` of each distinct set of
    shingles: its class, and the number of its rows and the least of their (id is null, id, tid).

    A class is what links between sets of a Jaccard similarity of ``similarity`` or more join. Equal sets are one node
    from the start. Nodes meet in buckets of chosen bits of a wide SimHash, in so many tables that a pair at the
    similarity misses all with probability ``miss``; in a bucket the bit-sliced distances under a radius that all but
    about 0.2 % of such pairs keep are candidates, and their whole sets decide. Where a bucket is thick with near
    texts, all meet its middle row first; those still apart then meet each other under a longer fingerprint, so
    that a large group costs about as many comparisons of sets as it has rows.
    """
    marks = materialize(signatures(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("id"), "tid"))
    nodes = marks.groupBy("digest").agg(F.min("tid").alias("tid"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("c"), first.alias("first"))
    nodes = materialize(nodes.withColumn("rep", F.monotonically_increasing_id()))
    bits, tables = table_plan(nodes.count(), similarity, miss)
    rows = keyed(nodes, bits, tables)
    schema = "a long, b long, key long"
    dealt = tiled(rows, ["key"], tile, alone=True)
    found = materialize(dealt.mapInPandas(_first_step(radius(64 * WORDS, similarity)), schema))
    pairs = lambda df: materialize(df.where("a is not null").select("a", "b").distinct())
    links = materialize(similar(pairs(found), nodes, docs, text_col, shingle, similarity))
    thick = found.where("key is not null").select("key").distinct()
    if not thick.isEmpty():
        comps = components(links).withColumnRenamed("node", "rep")
        more = rows.join(thick, "key", "left_semi").select("rep", "key")
        more = materialize(more.join(comps, "rep", "left").select("rep", "key", F.coalesce("component", "rep").alias("component")))
        long = long_fingerprints(nodes.select("rep", "tid").join(more.select("rep").distinct(), "rep"), docs, text_col, shingle)
        dealt = apart_tiles(more.join(materialize(long), "rep"), tile)
        again = materialize(dealt.mapInPandas(_second_step(radius(64 * LONG_WORDS, similarity)), schema))
        links = links.unionByName(similar(pairs(again), nodes, docs, text_col, shingle, similarity))
    comps = components(links).withColumnRenamed("node", "rep")
    classes = nodes.join(comps, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"), "c", "first")
    return marks.select("doc_id", "tid", "digest"), materialize(classes)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class of near duplicates (:func:`similar_classes`) the document with the smallest id (null last), with
    all its columns; one of rows that repeat it. Null, empty and blank texts are one class; an empty table gives an
    empty one.

    Rows of classes of one row, which a bit map of fixed size tells, pass without a shuffle.
    """
    marks, classes = similar_classes(docs, id_col, text_col)
    many = classes.groupBy("component").agg(F.sum("c").alias("n"), F.min("first").alias("first")).where("n > 1").drop("n")
    touched = marks.join(classes.select("digest", "component").join(many, "component"), "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("tid") == F.col("first.tid"))
    touched = materialize(touched.select("doc_id", "tid", stays.alias("stays")).distinct())
    slot = lambda: F.pmod(F.xxhash64("__id", "__tid"), F.lit(SLOTS))
    named = touched.select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid"), "stays")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("__id"), text_key(text_col).alias("__tid"))
    rows = marked(rows, slot(), slot_map(named.select(slot().alias("slot"))))
    free = rows.where("not __marked").select("row.*")
    held = rows.where("__marked").alias("x").join(
        named.alias("y"), F.col("x.__id").eqNullSafe(F.col("y.__id")) & (F.col("x.__tid") == F.col("y.__tid")), "left",
    )
    held = held.select("row", F.col("x.__id").alias("__id"), F.col("x.__tid").alias("__tid"), "stays")
    other = held.where("stays is null").select("row.*")
    one = held.where("stays").groupBy("__id", "__tid").agg(F.first("row").alias("row")).select("row.*")
    return free.unionByName(other).unionByName(one).select(*docs.columns)
