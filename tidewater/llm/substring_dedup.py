"""Repeated passages by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of each text; a chunk ends where the top bits of the
hash are zero, at least LEAST and at most MOST bytes after the last end, between characters.
The hash depends on the last 16 bytes only, so inserting text moves the ends near it and no
others. A chunk belongs to the smallest doc_id that holds its digest (128 bits); in other
documents it is a repeat.

Adjacent repeats that are adjacent in one owner as well are a stretch. A repeated passage begins and ends inside chunks
that aren't repeated, so each stretch of CANDIDATE bytes or more is extended on both sides, byte by
byte, as far as it agrees with its owner's text, CONTEXT bytes at most. What the extended stretches, and the repeats between
them, cover without a gap is a passage; those of at least RUN bytes are reported, and can be cut. Shorter ones are left:
common phrases and single lines repeat by chance.

Digests are counted by a map-side combined aggregation (least and greatest holder), and chunks meet the
owners of repeated digests in a join that AQE can split. Of an owner's text only the bytes around
the places that are asked for move on, each place once, however many documents repeat it.

Defined results: null and empty texts have no chunks; repeats inside one document don't count;
rows that share an id are one document, each with passages by its own text, and cut by them; a null
id is greater than all others, and documents without one are one document; very long texts are
chunked whole; extra columns are kept by cut() and not read by repeats().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import fresh, release, settle, ship, spread

LEAST, MOST, BITS, RUN = 16, 256, 4, 200
#: Bytes of a stretch that is extended, and bytes by which one side of it can grow.
CANDIDATE, CONTEXT = 48, 512
NO_ID = (1 << 63) - 1
_GEAR = np.random.default_rng(0x6EA2).integers(0, 1 << 16, size=256, dtype=np.uint16)


def ends(data: bytes) -> list[int]:
    """Where the chunks of a text end."""
    if not data:
        return []
    raw = np.frombuffer(data, dtype=np.uint8)
    rolled = _GEAR[raw]
    for step in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 bytes: sum of gear[byte k back] << k
        more = rolled.copy()
        more[step:] += rolled[:-step] << np.uint16(step)
        rolled = more
    found = np.flatnonzero(rolled >> np.uint16(16 - BITS) == 0) + 1
    inside = np.append(raw & 0xC0 == 0x80, False)  # before a continuation byte
    out, last = [], 0
    for at in [*found[~inside[found]].tolist(), len(data)]:
        while at - last > MOST:
            cut = last + MOST
            while inside[cut]:
                cut -= 1
            out.append(cut)
            last = cut
        if at - last >= LEAST or at == len(data) > last:
            out.append(at)
            last = at
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """id, version (a hash of the text) and text of each document with text."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    return keyed.withColumn("version", F.xxhash64("text"))


def chunks(docs: DataFrame) -> DataFrame:
    """id, version, h1 and h2 (the digest), at (start << 16 | bytes) of each chunk."""
    ship(docs.sparkSession)
    names = ["id", "version", "h1", "h2", "at"]

    def run(batches):
        for batch in batches:
            digests, places, sizes = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                data = text.as_py()
                cuts = ends(data)
                starts = [0, *cuts[:-1]]
                digests += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts, cuts)]
                places += [a << 16 | b - a for a, b in zip(starts, cuts)]
                sizes.append(len(cuts))
            digest = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            of = [np.repeat(np.asarray(batch.column(n)), sizes) for n in ("id", "version")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*of, digest[:, 0], digest[:, 1], np.array(places, dtype=np.int64))], names)

    return spread(_texts(docs)).mapInArrow(run, "id long, version long, h1 long, h2 long, at long")


STRETCHES = "id long, version long, start int, end int, first long, first_version long, there int"


def _stretches(batches):
    """Rows come sorted by document and place; a stretch that goes on in the next batch is carried over."""
    names = [f.split()[0] for f in STRETCHES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
    open_row = None
    for batch in batches:
        out = []
        for i, v, at, first, fv, there in zip(*(batch.column(n).to_pylist() for n in ("id", "version", "at", "first", "first_version", "there"))):
            start, end, there = at >> 16, (at >> 16) + (at & 0xFFFF), there >> 16
            o = open_row
            if o and o[3] == start and o[0] == i and o[1] == v and o[4] == first and o[5] == fv and o[6] + start - o[2] == there:
                o[3] = end
            else:
                if o:
                    out.append(o)
                open_row = [i, v, start, end, first, fv, there]
        yield batch_of(out)
    if open_row:
        yield batch_of([open_row])


def _around(batches):
    """The bytes before and behind each place (start, end) of a text."""
    names = ["first", "first_version", "there", "till", "left", "right"]
    for batch in batches:
        rows = []
        for i, v, text, places in zip(batch.column("id").to_pylist(), batch.column("version").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("places")):
            data = text.as_py()
            for p in places.as_py():
                rows.append((i, v, p["there"], p["till"], data[max(0, p["there"] - CONTEXT) : p["there"]], data[p["till"] : p["till"] + CONTEXT]))
                if len(rows) == 4096:
                    yield _sides(rows, names)
                    rows = []
        yield _sides(rows, names)


def _sides(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def same_end(a: bytes, b: bytes) -> int:
    """How many bytes two strings end with alike."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[-1 - n] == b[-1 - n]:
        n += 1
    return n


def same_begin(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with alike."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    return n


def passages(data: bytes, stretches: list[tuple[int, int, int, bytes | None, bytes | None]], least: int) -> list[tuple[int, int, list[int]]]:
    """start, end and owners of what stretches (start, end, owner, the owner's bytes before and behind, or None) of a text cover without a gap, extended."""
    spans = []
    for start, end, first, left, right in stretches:
        if left is not None:
            start -= same_end(data[max(0, start - CONTEXT) : start], left)
            end += same_begin(data[end : end + CONTEXT], right)
        while start < end and data[start] & 0xC0 == 0x80:  # between characters
            start += 1
        while start < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        spans.append((start, end, first))
    out: list[tuple[int, int, set[int]]] = []
    for start, end, first in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2] | {first})
        else:
            out.append((start, end, {first}))
    return [(a, b, sorted(x)) for a, b, x in out if b - a >= least]


def _passages(docs: DataFrame, least: int) -> DataFrame:
    """id, version, start, end, first_ids of each repeated passage."""
    found = settle(chunks(docs), "chunks")
    owners = found.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("version", "id").alias("first_version"), F.min_by("at", "id").alias("there"))
    owners = settle(owners.where("first < last").drop("last"), "owners")  # as a table, both sides of the join are plain shuffles, and AQE can split a frequent digest
    repeated = settle(found.join(owners.hint("merge"), ["h1", "h2"]).where("id > first").select("id", "version", "at", "first", "first_version", "there"), "repeats")
    release(found)  # by far the largest table
    release(owners)
    stretches = repeated.distinct().repartition("id", "version").sortWithinPartitions("id", "version", "at").mapInArrow(_stretches, STRETCHES)
    stretches = settle(stretches.withColumn("till", F.col("there") + F.col("end") - F.col("start")), "stretches")
    release(repeated)

    place, texts = ["first", "first_version", "there", "till"], _texts(docs)
    asked = stretches.where(F.col("end") - F.col("start") >= CANDIDATE).select(*place).distinct()
    asked = asked.groupBy(F.col("first").alias("id"), F.col("first_version").alias("version")).agg(F.collect_list(F.struct("there", "till")).alias("places"))
    held = texts.join(settle(asked, "asked").hint("merge"), ["id", "version"]).select("id", "version", "text", "places")
    sides = settle(held.mapInArrow(_around, "first long, first_version long, there int, till int, left binary, right binary").dropDuplicates(place), "sides")

    told = stretches.join(sides.hint("merge"), place, "left").groupBy("id", "version").agg(F.collect_list(F.struct("start", "end", "first", "left", "right")).alias("stretches"))
    both = texts.join(settle(told, "told").hint("merge"), ["id", "version"]).select("id", "version", "text", "stretches")

    def extend(batches):
        for batch in batches:
            rows = []
            for i, v, text, own in zip(batch.column("id").to_pylist(), batch.column("version").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("stretches")):
                rows += [(i, v, *x) for x in passages(text.as_py(), [tuple(s.values()) for s in own.as_py()], least)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", "version", "start", "end", "first_ids"])

    return both.mapInArrow(extend, "id long, version long, start int, end int, first_ids array<long>").distinct()


def repeats(docs: DataFrame, least: int = RUN) -> DataFrame:
    """A row per repeated passage: doc_id, start and end (bytes of the UTF-8 text), first_ids (the documents that it comes from)."""
    return _passages(docs, least).select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "start", "end", "first_ids")


def cut(docs: DataFrame, least: int = RUN) -> DataFrame:
    """The documents with their repeated passages cut out; all columns are kept."""
    names, i, v, held = docs.columns, fresh(docs, "span_id"), fresh(docs, "span_version"), fresh(docs, "spans")
    spans = _passages(docs, least).groupBy(F.col("id").alias(i), F.col("version").alias(v)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(held))
    spans = settle(spans, "spans")

    def run(batches):
        for batch in batches:
            out = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column(held).to_pylist()):
                if places:
                    data, last, kept = text.encode(), 0, []
                    for p in places:
                        kept.append(data[last : p["start"]])
                        last = p["end"]
                    text = b"".join([*kept, data[last:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    keyed = docs.withColumn(i, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(v, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(spans.hint("merge"), [i, v], "left").select(*[keyed[n] for n in names], held).mapInArrow(run, docs.schema)
