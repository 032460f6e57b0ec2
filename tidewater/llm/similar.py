"""Links between documents whose sets of shingles reach a Jaccard similarity.

MinHash proposes pairs, the exact similarity of the two sets decides. A set's BANDS * ROWS least
hashes make BANDS keys; two sets meet if a key is equal, which at a similarity of 0.8 fails for
3 pairs in a million, and for fewer above. Shingles are those of the fingerprints.

Equal sets are reduced to one first. In each key all members are compared with its first member, so n
members give n pairs, and what is linked is one component. In keys whose members are in several components
then, all members of different ones are compared with each other: exactly, no member, pair or key is left out. Two bounds that
are never wrong come before the comparison of sets: their sizes, and the parities of their hashes in SKETCH
cells, of which no more can differ than the sets have hashes that aren't in both. So a pair costs a row only if it may be similar.
A key of more than LARGE members is compared in blocks of about so many, each pair of blocks by itself. Before, and only to save
such rows, there are up to ROUNDS rounds in which DRAWS members of it outside the first one's component, drawn by
hashes, are compared with all others; what they link is one component from then on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import simhash
from tidewater.llm.common import settle, spread
from tidewater.llm.components import components

BANDS, ROWS, ROUNDS, DRAWS = 24, 4, 3, 3
#: Members above which a key is dealt into blocks; cells of a sketch, a power of two and a multiple of 64.
LARGE, SKETCH = 4096, 1024
_DRAWN = np.random.default_rng(0x51A1).integers(0, 1 << 64, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def keys(own: np.ndarray) -> list[int]:
    """The keys of a set of hashes, by band."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(own), 1 << 10):
        least = np.minimum(least, ((own[i : i + (1 << 10)] ^ _FLIP) * _TIMES).min(axis=1))
    return [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in least.reshape(BANDS, ROWS)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> np.ndarray:
    """The parities of the numbers of hashes in each cell, 64 to a word: those of two sets differ in no more bits than the sets in hashes."""
    cells = (own >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """docs with fp, mark (a hash of the set), size (of the set) and keys in place of the text; no mark for texts without words."""
    names = [n for n in docs.columns if n != "text"]

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").cast(pa.binary()):
                hashes = simhash.shingles(text.as_py(), words)
                own = np.unique(hashes)
                out.append((simhash._signed(simhash._voted(hashes)), *((xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63), len(own), keys(own)) if len(own) else (None, 0, None))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], [*names, "fp", "mark", "size", "keys"])

    added = [T.StructField(n, T.LongType()) for n in ("fp", "mark", "size")] + [T.StructField("keys", T.ArrayType(T.LongType()))]
    return spread(docs).mapInArrow(run, T.StructType([*(docs.schema[n] for n in names), *added]))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """row, own (the hashes of its set, ascending, as bytes) and s0, s1, ... (the words of its sketch)."""
    parts = [f"s{k}" for k in range(SKETCH // 64)]

    def run(batches):
        for batch in batches:
            own = [np.unique(simhash.shingles(t.as_py(), words)) for t in batch.column("text").cast(pa.binary())]
            cells = np.array([sketch(x) for x in own], dtype=np.int64).reshape(-1, len(parts))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x.tobytes() for x in own], pa.binary()), *map(pa.array, cells.T.copy())], ["row", "own", *parts])

    return texts.select("row", "text").mapInArrow(run, "row long, own binary, " + ", ".join(f"{n} long" for n in parts))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (x, y: rows; with what else they carry) whose sets are similar enough."""
    names = pairs.columns
    both = pairs.join(sets.select(F.col("row").alias("x"), F.col("own").alias("one")).hint("merge"), "x")
    both = both.join(sets.select(F.col("row").alias("y"), F.col("own").alias("other")).hint("merge"), "y").select(*names, "one", "other")

    def run(batches):
        for batch in batches:
            sides = zip(*(batch.column(n) for n in ("one", "other")))
            keep = [jaccard(*(np.frombuffer(t.as_py(), dtype=np.uint64) for t in two)) >= least for two in sides]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return settle(both.mapInArrow(run, pairs.schema), "similar")


def _differ(members: DataFrame, sets: DataFrame, least: float, large: int) -> DataFrame:
    """Pairs (x, y: rows, a, b: fingerprints) of members (band, key, row, fp, size, label) of a key with different labels, all that may be similar enough."""
    marks, parts = ["band", "key", "low", "high"], [f"s{k}" for k in range(SKETCH // 64)]
    counts = members.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / large).alias("blocks"))
    dealt = members.join(settle(counts, "counts").hint("merge"), ["band", "key"]).join(sets.select("row", *parts).hint("merge"), "row")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dealt = settle(dealt.select(*marks, "block", "row", "fp", "size", "label", *parts), "dealt")
    one, two = (dealt.select(*marks, *(F.col(n).alias(n + end) for n in ("block", "row", "fp", "size", "label", *parts))) for end in ("_1", "_2"))
    # Each pair once: of two blocks a member of each, of a block by itself all.
    apart = (F.col("row_1") < F.col("row_2")) & (F.col("label_1") != F.col("label_2")) & ((F.col("low") == F.col("high")) | (F.col("block_1") != F.col("block_2")))
    bits = sum((F.bit_count(F.col(f"{n}_1").bitwiseXOR(F.col(f"{n}_2"))) for n in parts[1:]), F.bit_count(F.col(f"{parts[0]}_1").bitwiseXOR(F.col(f"{parts[0]}_2"))))
    # Sets of m and n hashes that are so similar differ in at most (m + n) * (1 - least) / (1 + least); the bound is wider by rounding.
    may = bits * F.lit(1 + least) <= (F.col("size_1") + F.col("size_2")) * F.lit(1 - least) + F.lit(1e-6)
    pairs = one.join(two.hint("merge"), marks).where(apart & _near("size_1", "size_2", least) & may)
    return pairs.select(F.col("row_1").alias("x"), F.col("row_2").alias("y"), F.col("fp_1").alias("a"), F.col("fp_2").alias("b")).distinct()


def _near(m: str, n: str, least: float):
    """Whether sets of these sizes can be so similar."""
    return F.least(m, n) >= F.lit(least) * F.greatest(m, n)


def links(marked: DataFrame, texts: DataFrame, words: int, least: float, rounds: int = ROUNDS, large: int = LARGE) -> DataFrame:
    """Edges (a, b) between the fingerprints of documents of at least that similarity; marked is signed(), texts has row and text."""
    one = marked.where("mark IS NOT NULL").groupBy("mark").agg(F.min(F.struct("row", "fp", "size", "keys")).alias("one")).select("mark", "one.*")
    one = settle(one, "sets")
    equal = marked.where("mark IS NOT NULL").select("mark", F.col("fp").alias("a")).distinct()
    equal = equal.join(one.select("mark", F.col("fp").alias("b")).hint("merge"), "mark").where("a <> b").select("a", "b")

    members = one.select("row", "fp", "size", F.posexplode("keys").alias("band", "key"))
    firsts = members.groupBy("band", "key").agg(F.min(F.struct("row", "fp", "size")).alias("first"), F.max("row").alias("last")).where("first.row < last").drop("last")
    firsts = settle(firsts, "firsts")  # as a table, both sides of the join are plain shuffles, and AQE can split a large key
    shared = settle(members.join(firsts.hint("merge"), ["band", "key"]), "shared")
    sets = settle(_sets(texts.join(shared.select("row").distinct().hint("merge"), "row"), words), "hashes")

    pairs = shared.where((F.col("row") > F.col("first.row")) & _near("size", "first.size", least))
    found = _similar(pairs.select(F.col("first.row").alias("x"), F.col("row").alias("y"), F.col("first.fp").alias("a"), F.col("fp").alias("b")).distinct(), sets, least)
    out = equal.unionByName(found.select("a", "b"))

    labels = components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    placed = shared.drop("first").join(labels.withColumnRenamed("node", "row").hint("merge"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    for turn in range(rounds + 1):
        placed = settle(placed, "placed")
        several = placed.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "row").alias("home"), F.count(F.lit(1)).alias("members")).where("low < high")
        several = settle(several.select("band", "key", "home", "members"), "several")
        big = several.where(F.col("members") > large)
        if turn == rounds or big.isEmpty():
            break
        rest = settle(placed.join(big.hint("merge"), ["band", "key"]), "rest")
        drawn = lambda k, c: F.min_by(c, F.xxhash64(F.lit(turn), F.lit(k), "row")).alias(f"{c}{k}")  # noqa: E731, B023
        parts = ("row", "fp", "size", "label")
        centres = rest.where("label <> home").groupBy("band", "key").agg(*(drawn(k, c) for k in range(DRAWS) for c in parts))
        each = F.explode(F.array_distinct(F.array(*(F.struct(*(F.col(f"{c}{k}").alias(f"its_{c}") for c in parts)) for k in range(DRAWS)))))
        centres = centres.select("band", "key", each.alias("centre")).select("band", "key", "centre.*")
        pairs = rest.join(settle(centres, "centres").hint("merge"), ["band", "key"]).where((F.col("label") != F.col("its_label")) & _near("size", "its_size", least))
        pairs = pairs.select(F.least("row", "its_row").alias("x"), F.greatest("row", "its_row").alias("y"), *(F.col(n).alias(m) for n, m in (("fp", "a"), ("its_fp", "b"), ("label", "p"), ("its_label", "q"))))
        found = _similar(pairs.dropDuplicates(["x", "y"]), sets, least)
        out = out.unionByName(found.select("a", "b"))
        onward = components(found.select(F.col("p").alias("a"), F.col("q").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("onward"))
        placed = placed.join(onward.hint("merge"), "label", "left").withColumn("label", F.coalesce("onward", "label")).drop("onward")
    members = settle(placed.join(several.select("band", "key").hint("merge"), ["band", "key"]), "members")
    return out.unionByName(_similar(_differ(members, sets, least, large), sets, least).select("a", "b")).where("a <> b")
