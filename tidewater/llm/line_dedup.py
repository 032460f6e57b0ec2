"""Line deduplication by pairwise alignment.

A run is a shortest sequence of consecutive lines that holds at least WORDS words; each line begins
one and ends one, so a block of equal lines with so many words consists of runs, and a line
of so many words is a run by itself, and so are two such lines with nothing but blank lines
between them. Documents overlap if they share the hash of a run. Each shared run
links its holders to its first holder (the smallest doc_id), so a run with n holders gives n pairs,
not n * n, however frequent it is, and no run that an earlier document holds is missed: every
one of them is in some pair.

A pair is aligned by patience diff over the lines that it shares: lines that occur once in both, in
their longest increasing order, are the fixed points, and equal lines next to them join the block.
Shared runs that the alignment leaves, because they cross it or occur several times, are moved blocks.
All these blocks are deleted from the later document; its earlier partner is left alone. So what
goes is each line in a block of at least WORDS words that an earlier document holds as well.

Nothing but hashes and places of runs meets in joins, never whole documents, so a long document
that many others share a line with costs no more than a short one.

Defined results: null and empty texts have no lines and stay; lines are compared without the spaces,
tabs and returns around them; a word is what stands between spaces, and a line has a word for
each LETTERS characters at least, so that text without spaces counts; blank lines belong to a block but
neither begin nor end a run; documents of fewer than WORDS words in all prove nothing and stay; rows that share an
id are one document and not compared with each other; each such row is cut by its own text; a
null id comes after all others, and rows without one are one document; a document may end up
empty, and stays as a row; very long texts are compared whole; extra columns are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import fresh, held, settle, ship, spread

WORDS, LETTERS = 8, 12
NO_ID = (1 << 63) - 1
SPACE = " \t\r\v\f"
BLOCKS = "id long, version long, first long, start int, end int, source_start int, moved boolean"


def places(text: str, words: int = WORDS) -> tuple[list[int], list[int], list[int]]:
    """Hash, first line and number of lines of each run of a text."""
    lines = [x.strip(SPACE) for x in text.split("\n")]
    digest = xxhash.xxh3_64_intdigest
    hashes = [digest(x.encode()) for x in lines]
    upto = np.array([0, *accumulate(max(len(x.split()), len(x) // LETTERS) for x in lines)])
    if upto[-1] < words:
        return [], [], []
    own = np.flatnonzero(np.diff(upto))  # lines that aren't blank
    begins = own[upto[own] <= upto[-1] - words]
    ends = own[upto[own + 1] >= words] + 1
    long = np.diff(upto)[own] >= words
    gaps = np.flatnonzero(long[:-1] & long[1:] & (np.diff(own) > 1))  # blank lines between two runs of a line each
    spans = [(begins, np.searchsorted(upto, upto[begins] + words)), (np.searchsorted(upto, upto[ends] - words, side="right") - 1, ends), (own[gaps], own[gaps + 1] + 1)]
    both = np.unique(np.concatenate([a * (len(lines) + 1) + b for a, b in spans]))
    start, end = np.divmod(both, len(lines) + 1)
    sizes = (end - start).tolist()
    raw = np.array(hashes, dtype=np.uint64).tobytes()
    start = start.tolist()
    return [hashes[a] if n == 1 else digest(raw[8 * a : 8 * (a + n)]) for a, n in zip(start, sizes)], start, sizes


def runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id, version (a hash of the text), key, at and n (first line and number of lines) of each run of each document."""
    ship(docs.sparkSession)
    texts = docs.where("text IS NOT NULL AND text <> ''").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text")
    )

    def run(batches):
        held()
        for batch in batches:
            keys, starts, sizes, many = [], [], [], []
            for text in batch.column("text"):
                k, a, n = places(text.as_py(), words)
                keys += k
                starts += a
                sizes += n
                many.append(len(k))
            of = [pa.array(np.repeat(np.asarray(batch.column(c)), many), pa.int64()) for c in ("id", "version")]
            key = pa.array(np.array(keys, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*of, key, pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], ["id", "version", "key", "at", "n"])

    return spread(texts).mapInArrow(run, "id long, version long, key long, at int, n int")


def patience(a, b) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of equal lines, both increasing."""
    found: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where: dict = {}
        for i in range(a0, a1):
            where[a[i]] = -1 if a[i] in where else i
        seen: dict = {}
        for j in range(b0, b1):
            seen[b[j]] = -1 if b[j] in seen else j
        once = [(where[x], j) for x, j in seen.items() if j >= 0 and where.get(x, -1) >= 0]  # in b's order
        tops, ends, before = [], [], [None] * len(once)
        for n, (i, _) in enumerate(once):
            p = bisect_left(tops, i)
            before[n] = ends[p - 1] if p else None
            if p == len(tops):
                tops.append(i)
                ends.append(n)
            else:
                tops[p], ends[p] = i, n
        n = ends[-1] if ends else None
        right = (a1, b1)
        while n is not None:
            i, j = once[n]
            found.append((i, j))
            work.append((i + 1, right[0], j + 1, right[1]))
            right = (i, j)
            n = before[n]
        if ends:
            work.append((a0, right[0], b0, right[1]))
    return sorted(found)


def blocks(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """The blocks of a pair, given its shared runs (first line in the later, in the earlier document, number of lines): start and end in the later document, start in the earlier one, and whether the block crosses the alignment."""
    points = sorted({(j + k, i + k) for j, i, n in matches for k in range(n)})
    later, earlier = sorted({j for j, _ in points}), sorted({i for _, i in points})
    first: dict[int, int] = {}
    for j, i in points:
        first.setdefault(j, i)
    aligned = {(later[y], earlier[x]) for x, y in patience(earlier, [first[j] for j in later])}
    out = []
    for moved, part in ((False, sorted(aligned)), (True, [p for p in points if p not in aligned])):
        by_diagonal = sorted(part, key=lambda p: (p[0] - p[1], p[0]))
        for n, (j, i) in enumerate(by_diagonal):
            if n and by_diagonal[n - 1] == (j - 1, i - 1):
                out[-1][1] = j + 1
            else:
                out.append([j, j + 1, i, moved])
    return [tuple(x) for x in out]


def overlaps(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """A row per block to delete: id, version of the later document, first (the id of the earlier one), start and end (lines of the later document), source_start, moved."""
    own = settle(runs(docs, words), "runs")
    firsts = own.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("at", "id").alias("there")).where("first < last")
    firsts = settle(firsts.select("key", "first", "there"), "firsts")  # as a table, both sides of the join are plain shuffles, and AQE can split a frequent key
    shared = settle(own.join(firsts.hint("merge"), "key").where("id > first").select("id", "version", "first", "at", "there", "n"), "shared")
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def align(batches):
        """Rows come sorted by pair; one that goes on in the next batch is carried over."""
        pair, matches, out = None, [], []

        def close():
            if pair:
                out.extend((*pair, *b) for b in blocks(matches))

        for batch in batches:
            for i, v, first, at, there, n in zip(*(batch.column(c).to_pylist() for c in ("id", "version", "first", "at", "there", "n"))):
                if (i, v, first) != pair:
                    close()
                    pair, matches = (i, v, first), []
                matches.append((at, there, n))
            yield _batch(out, names)
            out.clear()
        close()
        yield _batch(out, names)

    return shared.repartition("id", "version", "first").sortWithinPartitions("id", "version", "first").mapInArrow(align, BLOCKS)


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def line_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents without the lines deleted; adds deleted (places, null if none), and sources."""
    docs = docs.drop("deleted", "sources")
    lines = F.flatten(F.collect_list(F.sequence("start", F.col("end") - 1)))
    fate = settle(overlaps(docs, words).groupBy("id", "version").agg(F.sort_array(F.array_distinct(lines)).alias("deleted"), F.sort_array(F.collect_set("first")).alias("sources")), "deleted")
    i, v = fresh(docs, "line_id"), fresh(docs, "line_version")
    keyed = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(v, F.xxhash64("text"))
    joined = keyed.join(fate.select(F.col("id").alias(i), F.col("version").alias(v), "deleted", "sources").hint("merge"), [i, v], "left")
    joined = joined.select(*[keyed[n] for n in docs.columns], "deleted", "sources")
    names = joined.columns

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            gone = batch.column("deleted")
            hit = np.flatnonzero(np.asarray(gone.is_valid()))
            if len(hit):
                values = text.to_pylist()
                for n in hit.tolist():
                    drop = set(gone[n].as_py())
                    values[n] = "\n".join(x for k, x in enumerate(values[n].split("\n")) if k not in drop)
                text = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in names], names)

    return joined.mapInArrow(run, joined.schema)
