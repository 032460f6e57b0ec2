"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 3-word shingles of the text with A-Z lower-cased, words being runs of
[^\\x20\\x09-\\x0D]; each shingle's XXH64 (seed 42) votes for its 64 bits, a bit is set if
more than half of the votes are.

Links: equal fingerprints are reduced to one row first. If two fingerprints differ in at most
k bits, at least two of k + 2 blocks of their bits are equal, so each distinct fingerprint goes
to a bucket for each pair of blocks (six for k = 2, by 32 shared bits). A bucket of more than
SPLIT members is dealt once more by the pairs of k + 2 blocks of its other bits, and so on
until at most FREE bits are open; a bucket then has at most 2 ** FREE members, whatever the
corpus. In each bucket the fingerprints, sorted by Gray rank, form a tree: a node keeps the
bits that all below it share and its ancestors don't keep already. Searching adds up differing
bits on the way down and drops a whole subtree once there are too many. A bucket emits a
spanning forest of its links, not the links, so a group of thousands of neighbours costs one
row per member; components are then found over the forest.

Defined results: null and empty texts, and texts without words, have fingerprint zero,
linked like any other; fewer words than a shingle: the whole sequence is the one shingle;
repeated rows share a fingerprint; rows whose doc_id is null get the smallest doc_id of
their component like others (null if it has none); extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import similar
from tidewater.llm.common import fresh, settle, ship, spread
from tidewater.llm.components import components

MAX_BITS = 2
#: Members above which a bucket is dealt out by further bits, as long as more than FREE bits are open.
SPLIT, FREE = 8192, 16
#: Children of a node, and fingerprints of a leaf.
FAN = 8
#: Pairs of a query and a node that a walk down the tree holds at most.
WALK = 1 << 22
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The hashes of a UTF-8 text's shingles, repeated ones too."""
    parts = text.translate(_LOWER).split() if text else []
    line = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(line, 42)] if parts else []
    else:
        ends, at = [], -1
        for p in parts:
            at += len(p) + 1
            ends.append(at)
        begins = [0, *(e + 1 for e in ends[:-1])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[b:e], 42) for b, e in zip(begins, ends[words - 1 :])]
    return np.array(hashes, dtype="<u8")


def _voted(bits: np.ndarray) -> int:
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(bits), 1 << 16):
        votes += np.unpackbits(bits[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(bits), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of a UTF-8 text."""
    return _voted(shingles(text, words))


def _with_fp(docs: DataFrame, words: int) -> DataFrame:
    """docs with the fingerprint fp (a signed long) in place of the text."""
    ship(docs.sparkSession)
    names = [n for n in docs.columns if n != "text"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.array([fingerprint(x.as_py(), words) for x in texts], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fps)], [*names, "fp"])

    return spread(docs).mapInArrow(run, T.StructType([*(docs.schema[n] for n in names), T.StructField("fp", T.LongType())]))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each document."""
    return _with_fp(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), words)


# --- the tree of one bucket -------------------------------------------------------------


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the reflected Gray code."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """A hierarchical index of distinct fingerprints in Gray order."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        ones, any_ = self.fps, self.fps
        levels = []
        while True:
            cuts = np.arange(0, len(ones), FAN)
            ones, any_ = np.bitwise_and.reduceat(ones, cuts), np.bitwise_or.reduceat(any_, cuts)
            levels.append([~(ones ^ any_), ones])  # the bits all below share, and their values
            if len(ones) == 1:
                break
        self.levels = levels[::-1]
        above = np.zeros(1, dtype=np.uint64)
        for level in self.levels:  # each node leaves out what its parent has
            shared = level[0]
            parents = above if len(above) == len(shared) == 1 else np.repeat(above, FAN)[: len(shared)]
            level[0] = shared & ~parents
            above = shared
        self.rest = ~np.repeat(above, FAN)[: len(self.fps)]

    def search(self, queries: np.ndarray, most: int = MAX_BITS):
        """Yields (query places, found places) for all pairs that differ in at most so many bits."""
        step = max(1, WALK // (FAN * len(self.fps)))
        for first in range(0, len(queries), step):
            part = queries[first : first + step]
            who, node, off = np.arange(len(part)), np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.uint8)
            for depth, (mask, bits) in enumerate(self.levels):
                off = off + np.bitwise_count((part[who] ^ bits[node]) & mask[node])
                keep = off <= most
                who, node, off = who[keep], node[keep], off[keep]
                below = len(self.levels[depth + 1][0]) if depth + 1 < len(self.levels) else len(self.fps)
                who, off = np.repeat(who, FAN), np.repeat(off, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < below
                who, node, off = who[there], node[there], off[there]
            off = off + np.bitwise_count((part[who] ^ self.fps[node]) & self.rest[node])
            keep = off <= most
            yield first + who[keep], node[keep]


def forest(fps: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fingerprints: members and their roots, roots left out."""
    tree = GrayTree(fps)
    label = np.arange(len(fps))
    for who, found in tree.search(tree.fps, most):
        while True:  # hooks the larger root under the smaller, until both ends of all links agree
            a, b = label[who], label[found]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if not (apart := low != high).any():
                break
            np.minimum.at(label, high[apart], low[apart])
            while (label != (up := label[label])).any():
                label = up
    moved = label != np.arange(len(fps))
    return tree.fps[moved], tree.fps[label[moved]]


# --- buckets over the cluster -----------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(above: int, most: int) -> list[int]:
    """What a bucket with the shared bits `above` is dealt by: above and each pair of most + 2 blocks of the other bits."""
    other = [i for i in range(64) if not above >> i & 1]
    cuts = [len(other) * i // (most + 2) for i in range(most + 3)]
    blocks = [sum(1 << i for i in other[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [above | x | y for x, y in combinations(blocks, 2)]


def links(distinct: DataFrame, most: int = MAX_BITS, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp whose components are those of all links."""
    spark = distinct.sparkSession
    ship(spark)
    level = masks(0, most)
    dealt = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in level))).alias("mask"))
    ready = None
    while True:
        keyed = dealt.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")
        sizes = keyed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sizes = settle(sizes, "sizes")  # as a table, both sides of the join are plain shuffles, and AQE can split a large bucket
        shared = settle(keyed.join(sizes.hint("merge"), ["mask", "bits"]), "buckets")
        last = 64 - min(m.bit_count() for m in level) <= FREE
        done = shared if last else shared.where(F.col("size") <= split)
        ready = done if ready is None else ready.unionByName(done)
        if last or shared.where(F.col("size") > split).isEmpty():
            break
        children = [(_signed(m), _signed(n)) for m in level for n in masks(m, most)]
        level = sorted({n & ((1 << 64) - 1) for _, n in children})
        # As many rows as there are pairs of masks, whatever the corpus.
        child = spark.createDataFrame(children, "mask long, child long")
        large = shared.where(F.col("size") > split).select("mask", "fp")
        dealt = large.join(F.broadcast(child), "mask").select("fp", F.col("child").alias("mask")).distinct()
    rows = ready.select("mask", "bits", "fp").repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return rows.mapInArrow(_bucket_forests(most), "a long, b long")


def _bucket_forests(most: int):
    def edges(marks, fps):
        """The forests of whole buckets; marks tell them apart."""
        starts = np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)))
        sizes = np.diff(np.append(starts, len(fps)))
        a, b = [], []
        small = sizes <= FAN  # a bucket that is one leaf: its members are compared directly, all such buckets at once
        of = np.repeat(np.arange(len(starts)), sizes)
        for step in range(1, FAN):
            same = np.flatnonzero((of[step:] == of[:-step]) & small[of[step:]])
            near = same[np.bitwise_count(fps[same] ^ fps[same + step]) <= most]
            a.append(fps[near])
            b.append(fps[near + step])
        for n in np.flatnonzero(~small).tolist():
            x, y = forest(fps[starts[n] : starts[n] + sizes[n]], most)
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches):
        """Rows come sorted by bucket; one that goes on in the next batch is carried over."""
        marks, fps = np.zeros((2, 0), dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            marks = np.concatenate([marks, np.stack([np.asarray(batch.column(n)) for n in ("mask", "bits")])], axis=1)
            fps = np.concatenate([fps, np.asarray(batch.column("fp")).view(np.uint64)])
            if len(fps):
                whole = np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)))[-1]
                if whole:
                    yield edges(marks[:, :whole], fps[:whole])
                marks, fps = marks[:, whole:], fps[whole:]
        if len(fps):
            yield edges(marks, fps)

    return run


def near_duplicates(docs: DataFrame, words: int = 3, most: int = MAX_BITS, split: int = SPLIT) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits) and component_id of each document."""
    marked = settle(fingerprints(docs, words), "fingerprints")
    distinct = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(distinct.select("fp"), most, split)).withColumnRenamed("node", "fp")
    placed = distinct.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    fate = settle(placed.join(least, "label").select("fp", "component_id"), "fate")
    return marked.join(fate.hint("merge"), "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 5, most: int = MAX_BITS, similarity: float | None = None) -> DataFrame:
    """docs, of each component the row with the smallest doc_id; all columns are kept.

    With a similarity, documents whose shingle sets are at least so similar are linked as well,
    however many bits their fingerprints differ in.

    Rows without an id are kept only where their component has no id at all, and then, as
    where the smallest id repeats, one of them stays: the first in the order of the input.
    """
    spark = docs.sparkSession
    place = fresh(docs, "place")
    numbered = settle(docs.withColumn(place, F.monotonically_increasing_id()), "numbered")  # written, as the numbers of a second scan could differ
    ship(spark)
    texts = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(place).alias("row"))
    marked = settle(_with_fp(texts, words) if similarity is None else similar.signed(texts, words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    distinct = settle(marked.groupBy("fp").agg(first), "distinct")
    edges = links(distinct.select("fp"), most)
    if similarity is not None:
        edges = edges.unionByName(similar.links(marked, texts.select("row", "text"), words, similarity))
    labels = components(edges).withColumnRenamed("node", "fp")
    groups = distinct.join(labels, "fp", "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("first").alias("first"))
    stays = settle(groups.select(F.col("first.row").alias(place)), "stays")
    return numbered.join(stays.hint("merge"), place, "left_semi").drop(place)
