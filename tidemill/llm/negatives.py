"""Hard negatives: exact scores only where bounds along a spanning tree of the anchors leave a doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import finite_vectors, materialize, packed_rows, unpacked_rows

#: Integer steps of a component's unit, positives of an anchor, negatives of a positive, the negatives' window in
#: hundredths of the positive's score.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Candidates that a task holds at most, candidates scored side by side (a group's least size), anchors of one tree.
GROUP, SIDE, TREE = 65_536, 1024, 512


def spanning_tree(a: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The minimum spanning tree of the rows by Euclidean distance: an order with parents first, the parents (-1 for
    the root) and the lengths of the edges to them."""
    n = len(a)
    norms = np.einsum("ij,ij->i", a, a)
    far = norms[:, None] + norms - 2 * a @ a.T
    parent, near = np.full(n, -1), far[0].copy()
    parent[1:] = 0
    left = np.ones(n, bool)
    order = []
    for _ in range(n):
        at = 0 if not order else int(np.argmin(np.where(left, near, np.inf)))
        order.append(at)
        left[at] = False
        closer = left & (far[at] < near)
        near[closer], parent[closer] = far[at][closer], at
    return order, parent, np.sqrt(np.where(parent < 0, 0, near))


class _Group:
    """Candidates of one task's group and, for the anchors handed to it, the best of them in each window."""

    def __init__(self, same: bool, top: int) -> None:
        self.same, self.top = same, top
        self.parts: list[tuple] = []
        self.codes: dict = {}
        self.rows: tuple | None = None

    def add(self, x: np.ndarray, rid: np.ndarray, ids: pa.Array, labels: list) -> None:
        label = np.array([self.codes.setdefault(v, len(self.codes)) for v in labels], np.int64)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.parts.append((x, rid, np.where(known, ids.fill_null(0).to_numpy(), 0), known, label))

    def best(self, x: np.ndarray, rid: np.ndarray, labels: list, windows: list[np.ndarray]) -> Iterator[tuple]:
        """``anchor's place, window, candidates' ids, row numbers, scores`` of the ``top`` best in each window."""
        if not self.parts:
            return
        if self.rows is None:
            self.rows = tuple(np.concatenate(c) for c in zip(*self.parts, strict=True))
        cx, crid, cid, known, clabel = self.rows
        norm = np.sqrt(np.einsum("ij,ij->i", cx, cx))
        order, parent, edge = spanning_tree(x)
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for start in range(0, len(cx), SIDE):
            part = slice(start, start + SIDE)
            c, r, i, k = cx[part], crid[part], cid[part], known[part]
            low, high = np.empty((len(x), len(c))), np.empty((len(x), len(c)))
            for a in order:
                open_to = ((clabel[part] == self.codes.get(labels[a], -1)) == self.same) & (r != rid[a])
                # What is in a window and not under the last of its best so far may still come in.
                last = [found[a, j][0][-1] if (a, j) in found and len(found[a, j][0]) == self.top else -np.inf for j in range(len(windows[a]))]
                floor = np.maximum(windows[a][:, 0], last)
                if parent[a] < 0:
                    low[a] = high[a] = c @ x[a]
                else:
                    reach = edge[a] * norm[part] * (1 + 1e-9) + 1e-6
                    low[a], high[a] = low[parent[a]] - reach, high[parent[a]] + reach
                    overlap = np.zeros(len(c), bool)
                    for f, w in zip(floor, windows[a], strict=True):
                        overlap |= (high[a] >= f) & (low[a] <= w[1])
                    again = np.nonzero(overlap & open_to)[0]
                    low[a, again] = high[a, again] = c[again] @ x[a] if 2 * len(again) < len(c) else (c @ x[a])[again]
                    open_to &= overlap
                score = low[a]
                for j, (f, w) in enumerate(zip(floor, windows[a], strict=True)):
                    took = np.nonzero(open_to & (score >= f) & (score <= w[1]))[0]
                    if not len(took):
                        continue
                    mine = [score[took], i[took], k[took], r[took]]
                    if (a, j) in found:
                        mine = [np.concatenate(p) for p in zip(found[a, j], mine, strict=True)]
                    first = np.lexsort((mine[3], mine[1], ~mine[2], -mine[0]))[: self.top]
                    found[a, j] = [m[first] for m in mine]
        for (a, j), (score, i, k, r) in found.items():
            yield a, j, np.where(k, i, 0), k, r, score


def _windows(scores: list | None, low: int, high: int) -> np.ndarray:
    """The windows ``low * s <= 100 * t <= high * s`` of an anchor's scores s as whole numbers t; without scores, one of all."""
    if scores is None:
        return np.array([[-np.inf, np.inf]])
    s = np.array(scores, np.int64)
    return np.stack([-((-low * s) // 100), (high * s) // 100], axis=1).astype(np.float64)


def _search(rows: DataFrame, anchors: DataFrame, groups: int, same: bool, top: int, low: int, high: int) -> DataFrame:
    """``rid, w, crid, cid, score, place``: for each anchor and window the ``top`` best rows of its label (``same``) or of other ones.

    The rows are dealt once by a hash of their row number into groups that a task can hold; every anchor goes to each
    group, the anchors after the rows, and is let go when its tree has been searched. A group of one task is bounded
    whatever the labels, copies or ids are."""
    deal = F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int")
    held = rows.select("dim", deal.alias("c"), F.lit(0).alias("kind"), "label", "turn", "rid", "vec_id", "x", F.lit(None).cast("array<long>").alias("scores"))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    asked = anchors.select("dim", every.alias("c"), F.lit(1).alias("kind"), "label", "turn", "rid", "vec_id", "x", "scores")
    names = ["rid", "w", "crid", "cid", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, waiting = None, None, []

        def answer() -> Iterator[pa.RecordBatch]:
            if waiting:
                x, rid = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
                labels = [v for w in waiting for v in w[2]]
                windows = [_windows(s, low, high) for w in waiting for s in w[3]]
                waiting.clear()
                for s in range(0, len(x), TREE):
                    t = slice(s, s + TREE)
                    out = list(group.best(x[t], rid[t], labels[t], windows[t]))
                    if out:
                        size = [len(o[2]) for o in out]
                        cid = pa.array(np.concatenate([o[2] for o in out]), mask=~np.concatenate([o[3] for o in out]))
                        columns = [np.repeat([rid[s + o[0]] for o in out], size), np.repeat([o[1] for o in out], size).astype(np.int32), np.concatenate([o[4] for o in out])]
                        score = np.concatenate([o[5] for o in out]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), cid, pa.array(score)], names)

        for batch in batches:
            dims, cs, kinds = (batch.column(n).to_numpy() for n in ("dim", "c", "kind"))
            changes = np.nonzero((np.diff(dims) != 0) | (np.diff(cs) != 0) | (np.diff(kinds) != 0))[0] + 1
            for s, e in zip([0, *changes], [*changes, len(dims)], strict=True):
                if s == e:
                    continue
                if (int(dims[s]), int(cs[s])) != key:
                    yield from answer()
                    key, group = (int(dims[s]), int(cs[s])), _Group(same, top)
                part = batch.slice(s, e - s)
                x, rid, labels = unpacked_rows(part.column("x")), part.column("rid").to_numpy(), part.column("label").to_pylist()
                if kinds[s] == 0:
                    group.add(x, rid, part.column("vec_id"), labels)
                else:
                    waiting.append((x, rid, labels, part.column("scores").to_pylist()))
                    if sum(len(w[1]) for w in waiting) >= TREE:
                        yield from answer()
        yield from answer()

    place = ["dim", "c"]
    dealt = held.unionByName(asked).repartition(groups, *place).sortWithinPartitions(*place, "kind", "label", "turn", "rid")
    found = dealt.mapInArrow(run, "rid long, w int, crid long, cid long, score long")
    first = Window.partitionBy("rid", "w").orderBy(F.desc("score"), F.col("cid").asc_nulls_last(), "crid")
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= top)


def hard_negatives(
    vectors: DataFrame, anchor: Column | str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row where ``anchor`` holds,
    its ``positives`` best rows of the same label, and for each of them the ``negatives`` best rows of other labels whose
    score is from ``low`` to ``high`` hundredths of the positive's.

    Scores are inner products of the components ``floor(scale * x)``, exact integers; ties go to the smaller id, null
    ids last. Rows with a null label or a vector that is null or not finite take no part, and vectors of another length
    are never compared. Rows with equal or null ids are rows like any other (a null id makes no anchor unless the
    condition says so). Other columns are ignored; an empty table gives an empty result.

    Anchors come in trees of TREE neighbours in the order of labels and signs. The root's scores with a block of
    candidates are exact; a child's are within the edge's length times the candidate's norm of its parent's, and only
    candidates whose bounds overlap a window (and reach the last of its best so far) are scored again. The work is that
    of all anchors against all rows, as the search asks for; no pair leaves a task but the best of each window.
    """
    condition = F.expr(anchor) if isinstance(anchor, str) else anchor
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.coalesce(condition, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in finite_vectors(batch.column(3), scale):
                mine = [batch.column(k).take(pa.array(at)) for k in range(3)]
                signs = x[:, :32] > 0
                turn = (signs * (1 << np.arange(signs.shape[1], dtype=np.int64)[::-1])).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*mine, pa.array(np.full(len(at), x.shape[1], np.int32)), packed_rows(x), pa.array(turn)], ["vec_id", "label", "anchor", "dim", "x", "turn"])

    whole = own.where("label is not null and v is not null").mapInArrow(run, "vec_id long, label string, anchor boolean, dim int, x binary, turn long")
    rows = materialize(whole.withColumn("rid", F.monotonically_increasing_id()))
    n, tasks = rows.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-n // GROUP), min(tasks, -(-n // SIDE)), 1)
    anchors = rows.where("anchor")
    best = materialize(_search(rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")), groups, True, positives, low, high))
    per = best.groupBy("rid").agg(F.expr("transform(array_sort(collect_list(struct(place, score))), s -> s.score)").alias("scores"))
    found = _search(rows, anchors.join(per, "rid"), groups, False, negatives, low, high)
    of = best.select("rid", (F.col("place") - 1).alias("w"), F.col("cid").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.join(of, ["rid", "w"]).join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return named.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("cid").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every fiftieth vector against all others; each seventh has another label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")), "vec_id % 50 = 0")


OP13_SQL = f"""
WITH k AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor({SCALE} * CAST(c AS DOUBLE)) for c in embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, k.vec_id, a.label = k.label AS same, CAST(list_inner_product(a.v, k.v) AS BIGINT) AS score
    FROM k AS a JOIN k ON a.vec_id <> k.vec_id WHERE a.vec_id % 50 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}"""
