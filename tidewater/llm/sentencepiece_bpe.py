"""SentencePiece encoding and decoding of BPE models, by backtracking.

A text is cut where no piece of the vocabulary can reach across (before each run of the word
mark that follows something else). Each chunk is encoded by itself: Aho-Corasick finds the
longest piece at every position, it is tried first, a piece is taken if it and its left
neighbour stay apart when their joint text is merged anew, and positions from which no encoding
goes on are marked in a bitfield and never tried again. That gives exactly what the merge loop
gives as long as no two pieces share a merge score; chunks that hold a piece with a shared score
(in common models the runs of word marks) go through the merge loop itself. A character that no
piece holds stays apart from everything and becomes its bytes.

The different new chunks of a batch of rows are encoded side by side: each step takes one piece,
or one step back, in all chunks that aren't done. Chunks of more than WIDE characters are encoded
one by one, with a bitfield as long as they are. A worker remembers the ids of up to CHUNKS
chunks and PAIRS pairs of pieces; the memory is bounded whatever the input.

Defined results: null and empty texts have no ids and decode to the empty text; repeated
rows are each encoded; very long texts are encoded whole; extra columns are kept, and a
column named as an output is replaced.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import held, ship, spread

MARK = "▁"
#: Chunks and pairs of pieces that one worker remembers.
CHUNKS, PAIRS = 400_000, 200_000
#: Rows and bytes of text coded at a time (a longer text alone).
ROWS, BYTES = 1024, 2 << 20
#: Chunks encoded side by side, and their characters at most: the bits of a field of failed positions.
BESIDE, WIDE = 1 << 15, 62
#: The table of pairs holds 2 ** SLOTS of them; a pair takes the place of another with the same slot.
SLOTS = 20
#: In place of a token's number: the longest one from there isn't known yet.
ASK = -2
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


# Field numbers of a SentencePiece model, and numbers of its kinds.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_KIND, MODEL_KIND, MARK_BEHIND = 3, 3, 24
CHARACTER_MAP, DUMMY_PREFIX, FEWER_SPACES, MARKED_SPACES = 2, 3, 4, 5
BPE, USER_DEFINED = 2, 4


def only_marks_spaces(model: bytes) -> bool:
    """Whether the model's normaliser only puts a mark in front and in place of each space. Raises for models that aren't plain BPE."""
    trainer, normalizer = {}, {}
    for field, value in _fields(model):
        if field == TRAINER:
            trainer |= dict(_fields(value))
        elif field == NORMALIZER:
            normalizer |= dict(_fields(value))
        elif field == PIECE and dict(_fields(value)).get(PIECE_KIND) == USER_DEFINED:
            raise ValueError("the model has user-defined pieces")
    if trainer.get(MODEL_KIND) != BPE:
        raise ValueError("not a BPE model")
    if trainer.get(MARK_BEHIND):
        raise ValueError("the model puts word marks behind words")
    return not normalizer.get(CHARACTER_MAP) and bool(normalizer.get(DUMMY_PREFIX, 1)) and not normalizer.get(FEWER_SPACES, 1) and bool(normalizer.get(MARKED_SPACES, 1))


class Encoder(dict):
    """Encodes texts; as a dict it holds the ids (int32 bytes) of chunks seen, by what follows their first mark."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        super().__init__()
        self.plain = only_marks_spaces(model)
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [(i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {piece: i for i, piece in pieces}
        self.cost = {piece: -sp.get_score(i) for i, piece in pieces}
        times: dict[float, int] = {}
        for piece, cost in self.cost.items():
            if len(piece) > 1:
                times[cost] = times.get(cost, 0) + 1
        tied = {piece for piece, cost in self.cost.items() if len(piece) > 1 and times[cost] > 1}
        if any(MARK in piece.lstrip(MARK) for _, piece in pieces):
            raise ValueError("a piece holds a word mark after other characters")
        self.letters = {c for piece in self.ids for c in piece}
        self.gap = next(c for c in map(chr, range(1 << 16)) if c not in self.letters)
        # Cheap pieces first: the automaton tries the ways on from a node in the order in which they were added.
        self.names = [*sorted(self.ids, key=self.cost.__getitem__), *sorted(self.letters - set(self.ids))]
        self.coded = {token: self.id_bytes(token) for token in self.names}
        self.trie = ahocorasick.Automaton()
        for n, token in enumerate(self.names):
            self.trie.add_word(token, n)
        self.trie.make_automaton()
        any_tied = re.compile("|".join(map(re.escape, sorted(tied))) or r"(?!)")
        self.holds_tied, self.all_tied = any_tied.search, any_tied.finditer
        self.shortened: dict[str, str | None] = {}
        self.steps: dict[str, tuple[list, list] | None] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        #: What the memory held when it was last full.
        self.chunks: dict[str, bytes] = {}
        # By number of the token; the last is any character that no piece holds.
        number = {token: n for n, token in enumerate(self.names)}
        self.sizes = np.array([*map(len, self.names), 1])
        self.shorter_of = np.array([*(number.get(self.shorter(t), -1) for t in self.names), -1])
        self.in_piece = np.zeros(0x110000, dtype=bool)
        self.in_piece[[*map(ord, self.letters)]] = True
        self.id_of = np.array([*(self.ids.get(t, -1) for t in self.names), -1], dtype=np.int32)
        self.pairs, self.pair_apart = np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, dtype=bool)

    def merges(self, text: str) -> tuple[list[str], list[tuple[float, int, str]]]:
        """The merge loop (the cheapest adjacent pair first, the leftmost of equals): the parts left, and (cost, place, joint) of each merge."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []
        done = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (cost := self.cost.get(joint := parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (cost, i, j, joint))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            cost, i, j, joint = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != joint:
                continue
            done.append((cost, i, joint))
            parts[i], parts[j] = joint, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None], done

    def edges(self, token: str) -> tuple[list, list] | None:
        """How the first and the last part of a token grow as it is merged: (cost of the merge, part after it); None if the merge loop doesn't make the token."""
        if token not in self.steps:
            parts, done = self.merges(token)
            first, last = token[0], token[-1]
            left, right = [(0.0, first)], [(0.0, last)]
            for cost, i, joint in done:
                first = joint if i == 0 else first
                last = joint if i + len(joint) == len(token) else last
                left.append((cost, first))
                right.append((cost, last))
            end = (float("inf"), "")
            self.steps[token] = ([*left, end], [*right, end]) if len(parts) == 1 else None
        return self.steps[token]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether the two remain neighbours when their joint text is merged anew.

        Only a merge across the border could change either, so the merges of both run side
        by side, in the loop's order, and at each step the parts at the border are tried.
        """
        if (known := self.apart.get((left, right))) is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            known = self.apart[left, right] = self._remerged(self.edges(left)[1], self.edges(right)[0])
        return known

    def _remerged(self, ends: list, begins: list) -> bool:
        i = j = 0
        price = self.cost.get
        while True:
            next_left, next_right = ends[i + 1][0], begins[j + 1][0]
            across = price(ends[i][1] + begins[j][1])
            if across is not None and across < next_left and across <= next_right:
                return False
            if next_left == next_right == float("inf"):
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def shorter(self, token: str) -> str | None:
        """The longest piece (or letter) that a token begins with, other than itself."""
        if token not in self.shortened:
            self.shortened[token] = next((p for n in range(len(token) - 1, 0, -1) if (p := token[:n]) in self.coded), None)
        return self.shortened[token]

    def tokens(self, text: str) -> list[str]:
        """The tokens of a chunk of known characters, by backtracking."""
        if self.holds_tied(text):
            return self.merges(text)[0]
        found: list[str] = []
        at, left, size = 0, None, len(text)
        longest: list[str] = [""] * size
        for end, n in self.trie.iter(text):  # of those with one beginning, the longest comes last
            token = self.names[n]
            longest[end + 1 - len(token)] = token
        open_at = (1 << (size + 1)) - 1  # a set bit: not known to fail from there
        token = longest[0]
        while at < size:
            while token is not None:
                end = at + len(token)
                if open_at >> end & 1 and self.edges(token) and (left is None or self.stay_apart(left, token)):
                    break
                token = self.shorter(token)
            if token is not None:
                found.append(token)
                at, left = end, token
                if at < size:
                    token = longest[at]
            else:
                open_at &= ~(1 << at)
                at -= len(left)
                token = self.shorter(found.pop())
                left = found[-1] if found else None
        return found

    def id_bytes(self, token: str) -> bytes:
        """The id of a piece, or those of the bytes of any other character."""
        known = self.ids.get(token)
        return array("i", [known] if known is not None else [self.processor.piece_to_id(f"<0x{b:02X}>") for b in token.encode()]).tobytes()

    def encode_chunk(self, chunk: str) -> bytes:
        """The ids of a chunk by itself."""
        runs = (("".join(run), known) for known, run in groupby(chunk, self.letters.__contains__))
        return b"".join(b"".join(map(self.coded.__getitem__, self.tokens(run)) if known else map(self.id_bytes, run)) for run, known in runs)

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether tokens stay apart, by number; left is -1 where there is none."""
        unknown = len(self.names)
        keys = (left + 1) * (unknown + 1) + right
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.pair_apart[slots]
        if len(new := np.flatnonzero(self.pairs[slots] != keys)):
            fresh, place = np.unique(keys[new], return_inverse=True)
            told = []
            for key in fresh.tolist():
                a, b = divmod(key, unknown + 1)
                one, other = self.names[a - 1] if 0 < a <= unknown else None, self.names[b] if b < unknown else None
                told.append(other is None or bool(self.edges(other) and (one is None or self._remerged(self.edges(one)[1], self.edges(other)[0]))))
            told = np.array(told)[place]
            out[new] = told
            self.pairs[slots[new]], self.pair_apart[slots[new]] = keys[new], told  # of several with one slot the last stays, in both
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, encoded side by side."""
        out: list[bytes] = [b""] * len(chunks)
        short = []
        for n, chunk in enumerate(chunks):
            if len(chunk) <= WIDE:
                short.append(n)
            else:
                out[n] = self.encode_chunk(chunk)
        for first in range(0, len(short), BESIDE):
            part = short[first : first + BESIDE]
            for n, ids in zip(part, self._beside([chunks[n] for n in part])):
                out[n] = ids
        return out

    def _beside(self, chunks: list[str]) -> list[bytes]:
        unknown = len(self.names)
        size = np.array([len(c) for c in chunks])
        base = np.cumsum(size + 1) - size - 1
        joined = self.gap.join([*chunks, ""])
        longest = np.where(self.in_piece[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")], ASK, unknown)
        matches = np.fromiter(chain.from_iterable(self.trie.iter_long(joined)), dtype=np.int64).reshape(-1, 2)
        longest[matches[:, 0] + 1 - self.sizes[matches[:, 1]]] = matches[:, 1]  # along the way of the longest pieces
        tied = np.unique(np.searchsorted(base, [m.start() for m in self.all_tied(joined)], side="right") - 1)

        taken = np.zeros((len(chunks), WIDE), dtype=np.int64)
        many = np.zeros(len(chunks), dtype=np.int64)
        who = np.arange(len(chunks))
        if len(tied):
            who = np.delete(who, tied)
        who = who[size[who] > 0]
        at, left, failed = np.zeros(len(who), dtype=np.int64), np.full(len(who), -1), np.zeros(len(who), dtype=np.uint64)
        token = longest[base[who]]
        one = np.uint64(1)
        while len(who):
            end = at + self.sizes[token]
            good = failed >> end.astype(np.uint64) & one == 0
            good[good] = self.fit(left[good], token[good])
            n = np.flatnonzero(good)
            taken[who[n], many[who[n]]] = token[n]
            many[who[n]] += 1
            at[n], left[n] = end[n], token[n]
            place = base[who] + at
            if len(n := np.flatnonzero(good & (longest[place] == ASK) & (at < size[who]))):  # off that way
                longest[place[n]] = [next(self.trie.iter_long(chunks[w], i))[1] for w, i in zip(who[n].tolist(), at[n].tolist())]
            token = np.where(good, longest[place], self.shorter_of[token])
            while len(n := np.flatnonzero(token < 0)):  # no piece goes on from there: one step back
                failed[n] |= one << at[n].astype(np.uint64)
                w = who[n]
                many[w] -= 1
                last = taken[w, many[w]]
                at[n] -= self.sizes[last]
                token[n] = self.shorter_of[last]
                left[n] = np.where(many[w] > 0, taken[w, many[w] - 1], -1)
            on = at < size[who]
            who, at, left, failed, token = who[on], at[on], left[on], failed[on], token[on]

        filled = taken[np.arange(WIDE) < many[:, None]]
        ids, ends = self.id_of[filled], np.cumsum(many)
        data, to = ids.tobytes(), (ends * 4).tolist()
        out = [data[a:b] for a, b in zip([0, *to], to)]
        spelt = set(np.searchsorted(ends, np.flatnonzero(ids < 0), side="right").tolist())
        for n in spelt:
            parts, at = [], 0
            for t in taken[n, : many[n]].tolist():
                parts.append(self.coded[self.names[t]] if t < unknown else self.id_bytes(chunks[n][at]))
                at += int(self.sizes[t])
            out[n] = b"".join(parts)
        for n in tied.tolist():
            out[n] = self.encode_chunk(chunks[n])
        return out

    def cut(self, text: str | None) -> tuple[bytes, list[str]]:
        """The ids of what stands before the first mark, and the chunks of a text, each without its first mark."""
        if not text:
            return b"", []
        if self.plain:
            words = (text.replace(MARK, " ") if MARK in text else text).split(" ")
            if "" not in words:
                return b"", words
            text = MARK + MARK.join(words)
        else:
            text = self.processor.normalize(text)
        runs = _RUNS.findall(text)
        before = self.encode_chunk(runs.pop(0)) if runs and runs[0][0] != MARK else b""
        return before, [x[1:] for x in runs]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts as int32 bytes."""
        rows = [self.cut(x) for x in texts]
        new = set().union(*(words for _, words in rows)).difference(self)
        if self.chunks:
            for word in (again := new.intersection(self.chunks)):
                self[word] = self.chunks[word]
            new -= again
        if new:
            words = list(new)
            self.update(zip(words, self.encode_chunks([MARK + w for w in words])))
        out = [before + b"".join(map(self.__getitem__, words)) for before, words in rows]
        if len(self) > CHUNKS // 2:
            self.chunks = dict(self) if len(self) <= CHUNKS else {}
            self.clear()
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as int32 bytes."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


def encoder(model: bytes) -> Encoder:
    """The encoder that this process keeps."""
    return held(("sentencepiece", model), lambda: Encoder(model))


def _put(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != name]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [column], [n for n, _ in kept] + [name])


def _pieces(batches, text: str) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ROWS rows, and BYTES bytes of text if more than one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = min(first + ROWS, max(first + 1, int(np.searchsorted(ends, before + BYTES, side="right"))))
            yield batch.slice(first, last - first)
            first = last


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids of each text, without begin or end ids; and, if a name is given for it, the text that they decode to."""
    ship(docs.sparkSession)
    schema = _schema(docs, ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = T.StructType([f for f in schema.fields if f.name != decoded] + [T.StructField(decoded, T.StringType())])

    def run(batches):
        code = encoder(model)
        for batch in _pieces(batches, text):
            parts = code.encode_all(batch.column(text).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in parts)])
            flat = b"".join(parts)
            values = pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)])
            batch = _put(batch, ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
            if decoded:
                batch = _put(batch, decoded, pa.array([code.decode(memoryview(x).cast("i").tolist()) for x in parts], pa.string()))
            yield batch

    return spread(docs).mapInArrow(run, schema)


def decode(docs: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each list of ids; null counts as no ids."""
    ship(docs.sparkSession)

    def run(batches):
        code = encoder(model)
        for batch in batches:
            yield _put(batch, text, pa.array([code.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string()))

    return docs.mapInArrow(run, _schema(docs, text, T.StringType()))


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """doc_id, more columns, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded documents."""
    return coded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
