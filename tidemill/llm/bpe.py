"""Byte-level BPE with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import sub_batches

#: The rank of a pair that can't be merged.
NONE = 1 << 24
#: Bytes of a piece up to which pieces are merged together, many at a time; longer ones one by one.
BATCH_BYTES = 64
#: Pieces of a generation; a worker keeps the ids of this one and of the one before.
CACHE = 150_000
#: Fixed value: the pattern that splits text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: visible Latin-1 characters stand for
    themselves, the others for the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def check_settings(spec: dict) -> None:
    """Raises on a vocabulary file whose settings aren't those that this module follows."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("normalizer", "post_processor") if spec.get(k)]
    wrong += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        wrong.append("pre_tokenizer")
    for token in spec["added_tokens"]:
        wrong += [k for k in ("single_word", "lstrip", "rstrip", "normalized") if token.get(k)]
    if wrong:
        raise ValueError(f"unsupported settings of a vocabulary: {', '.join(dict.fromkeys(wrong))}")


class Merges:
    """The merge table of a vocabulary file and its segment trees."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_settings(spec)
        stand = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(stand[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in stand.items():
            self.of_byte[b] = vocab[c]
        pairs = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.setdefault((vocab[a] << 32) | vocab[b], (rank, vocab[a + b]))
        self._build(pairs)
        self.pairs = pairs

    def _build(self, pairs: dict[int, tuple[int, int]]) -> None:
        """A cuckoo table: each pair is at one of two places, so a look-up is two reads."""
        self.bits = max(10, (4 * len(pairs) + 1).bit_length())
        slots: list[dict[int, int]] = [{}, {}]
        for key in pairs:
            side = 0
            for _ in range(10_000):
                at = int(self._slots(np.array([key]))[side][0])
                key, slots[side][at] = slots[side].get(at), key
                if key is None:
                    break
                side = 1 - side
            else:
                raise ValueError("the merge table can't be placed")
        size = 1 << self.bits
        self.keys, self.ranks, self.merged = np.full(2 * size, -1), np.full(2 * size + 1, NONE, dtype=np.int32), np.zeros(2 * size + 1, dtype=np.int32)
        for side in (0, 1):
            for at, key in slots[side].items():
                self.keys[side * size + at] = key
                self.ranks[side * size + at], self.merged[side * size + at] = pairs[key]

    def _slots(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        shift = np.uint64(64 - self.bits)
        return (mixed >> shift).astype(np.int64), ((mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of the merge table for each pair, the last (rank NONE) if there is none."""
        key = (left.astype(np.int64) << 32) | right
        one, two = self._slots(key)
        two += 1 << self.bits
        return np.where(self.keys[one] == key, one, np.where(self.keys[two] == key, two, len(self.keys)))

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of at most BATCH_BYTES bytes. Each has a tree of its own, all updated in step: a leaf is
        rank * leaves + place of a pair, so the root is the leftmost pair of the lowest rank."""
        size = np.array([len(p) for p in pieces])
        leaves = 1 << max(1, int(size.max() - 1).bit_length())
        n, wide, none = len(pieces), leaves + 1, NONE * leaves
        raw = np.frombuffer(b"".join([p.ljust(wide, b"\0") for p in pieces]), dtype=np.uint8)
        ids = self.of_byte[raw].astype(np.int32)
        place = np.arange(wide, dtype=np.int32)
        after, before = np.tile(place + 1, n), np.tile(place - 1, n)
        alive = (place < size[:, None]).ravel()
        tree = np.full((n, 2 * leaves), none, dtype=np.int64)
        grid = ids.reshape(n, wide)
        rank = self.ranks[self.look_up(grid[:, :-1], grid[:, 1:])].astype(np.int64)
        tree[:, leaves:] = np.where((rank < NONE) & (place[1:] < size[:, None]), rank * leaves + place[:-1], none)
        at = leaves
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2
        tree = tree.ravel()
        row = np.arange(n)
        while True:
            root = tree[row * (2 * leaves) + 1]
            go = root < none
            row, root = row[go], root[go]
            if not len(row):
                break
            base, top = row * wide, row * (2 * leaves)
            i = root % leaves
            j = after[base + i]
            k, h = after[base + j], before[base + i]
            new = self.merged[self.look_up(ids[base + i], ids[base + j])]
            ids[base + i] = new
            alive[base + j] = False
            after[base + i] = k
            inside = k < size[row]
            before[(base + k)[inside]] = i[inside]
            # Three leaves change: the pair that went, the one on the right, the one on the left.
            right = self.ranks[self.look_up(new, ids[base + np.minimum(k, leaves)])]
            tree[top + leaves + np.minimum(j, leaves - 1)] = none  # the last symbol starts no pair: its leaf is empty already
            tree[top + leaves + i] = np.where(inside & (right < NONE), right.astype(np.int64) * leaves + i, none)
            some = h >= 0
            h, there = h[some], base[some]
            left = self.ranks[self.look_up(ids[there + h], new[some])]
            tree[top[some] + leaves + h] = np.where(left < NONE, left.astype(np.int64) * leaves + h, none)
            node = np.concatenate([np.minimum(j, leaves - 1), i, h]) + leaves
            tops = np.concatenate([top, top, top[some]])
            while node[0] > 1:
                node >>= 1
                low = tops + 2 * node
                tree[tops + node] = np.minimum(tree[low], tree[low + 1])
        out = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.reshape(n, wide).sum(axis=1) * 4).tolist()
        return [out[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_long(self, piece: bytes) -> bytes:
        """Ids of one piece of any length, with one tree."""
        n, none, pairs = len(piece), (1 << 60, 0), self.pairs
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        leaves = 1 << max(1, (n - 1).bit_length())
        tree = [none] * (2 * leaves)
        rank = lambda i, j: (pairs[key][0], i) if (key := (ids[i] << 32) | ids[j]) in pairs else none
        tree[leaves : leaves + n - 1] = [rank(i, i + 1) for i in range(n - 1)]
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, value: tuple[int, int]) -> None:
            k = leaf + leaves
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < none:
            i = tree[1][1]
            j = after[i]
            ids[i] = pairs[(ids[i] << 32) | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < leaves:
                put(j, none)
            if k < n:
                before[k] = i
                put(i, rank(i, k))
            else:
                put(i, none)
            if before[i] >= 0:
                put(before[i], rank(before[i], i))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()


class Encoder:
    """Text to ids and back for one vocabulary file, with a bounded store of pieces seen."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        low = [chr(c) for c in range(0x250)]
        of = lambda kind: "".join(map(re.escape, (c for c in low if unicodedata.category(c)[0] == kind)))
        blank = r"\t-\r \x85\xa0"
        self.common = re.compile(SPLIT.format(L=f"[{of('L')}]", N=f"[{of('N')}]", l=of("L"), n=of("N"), S=blank))
        self.rare = re.compile("[^\x00-ɏ]")
        self.any = regex.compile(SPLIT.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}", S=r"\p{White_Space}"))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None

    def pieces(self, text: str) -> list[str]:
        """Pieces before the merges; a special token is a piece of its own."""
        find = self.any.findall if self.rare.search(text) else self.common.findall
        if self.cut is None or not self.cut.search(text):
            return find(text)
        special = self.merges.special
        return [p for part in self.cut.split(text) for p in ([part] if part in special else find(part))]

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        known, special, older = self.known, self.merges.special, self.older
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces.difference(known):
            if p in older:
                known[p] = older[p]
            elif p in special:
                known[p] = np.array([special[p]], dtype="<u4").tobytes()
            else:
                b = p.encode()
                by_size.setdefault((len(b) - 1).bit_length() if len(b) <= BATCH_BYTES else -1, []).append((p, b))
        for width, group in by_size.items():
            step = 1 << 17 - max(width, 0)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                ids = [self.merges.encode_long(b) for _, b in part] if width < 0 else self.merges.encode_many([b for _, b in part])
                known.update(zip((p for p, _ in part), ids, strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.merges.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit integers as binary) of every row, for the byte-level
    vocabulary file ``path`` (a file that every executor can open).

    A text is split by the vocabulary's pattern; each piece is merged by a segment tree over the ranks of its
    adjacent pairs: the root names the leftmost pair of the lowest rank, and a merge changes three leaves. A
    special token written in a text becomes its id. Null and empty texts have no ids; there is no limit on a
    text's or a piece's length. Rows are independent, so nothing is shuffled: null and repeated ids come out as they went
    in, other columns are ignored and an empty table gives an empty result. A file with settings other than those
    followed here raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in sub_batches(batches, chars=1_000_000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e.encode_batch(b.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text`` from ``doc_id, ids``; bytes that are no UTF-8 become U+FFFD. A null counts as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in sub_batches(batches, "ids", chars=4_000_000):
            texts = [e.decode(i or b"") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, text``: what ``bpe_decode`` makes of ``bpe_encode``, in one pass, so that each core runs one worker
    with one copy of the vocabulary rather than two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in sub_batches(batches, chars=1_000_000):
            ids = e.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([e.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "text"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary, text string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document's ids and of the text decoded from them."""
    path = path or vocabulary()
    back = bpe_round_trip(docs, path)
    return back.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return encoded_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
