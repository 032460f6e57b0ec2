"""Finds benchmark items in documents, up to edits, by pigeonhole pieces and Myers' distance.

Texts are compared as sequences of lower-cased words. An item of n words may differ from the
text by k = n * (1 - SIMILARITY), rounded down, inserted, deleted or changed words. It is split
into k + 1 pieces; whatever k edits do, one piece stays whole, so each match holds an exact
piece hit. An Aho-Corasick automaton finds the pieces of all items in one pass over a document;
the stretch around each hit (as long as the item and its budget allow) is verified with Myers'
bit-parallel distance, words being the symbols.

A word is a run of letters and digits; in scripts that don't put spaces between words (Chinese,
Japanese, Thai, Lao, Burmese, Khmer) each character is a word, so an item is found inside a longer run.

The automaton is sent to the executors, so the benchmark is taken in blocks of about
BLOCK_BYTES of text, one after another: where there are several, what one block gives is written
before the next is sent. A worker builds the automaton of a block once. Documents are not shuffled.

Defined results: null and empty documents have no matches; null items and items without a word
are never matched; items of under 1 / (1 - SIMILARITY) words are matched exactly; repeated
documents, items and occurrences give a row each; a null item_id or doc_id is given as null;
find_items() reads no extra columns. decontaminate() decides each row by its own text, whatever its id:
null and empty texts stay, rows that share an id or have none stay or go one by one, and all columns are kept.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import held, settle, ship, spread

SIMILARITY = 0.8
BLOCK_BYTES = 8 << 20
# Thai and Lao, Burmese, Khmer, kana, and Chinese characters (Unicode blocks).
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W_{_SINGLE}]+|[{_SINGLE}]")
SCHEMA = "doc_id long, item_id long, distance int, item_words int, start int, end int"


def lowered(text: str) -> str:
    """Lower case, character for character."""
    return text.replace("İ", "I").lower()


class Pattern:
    """A sequence of words to be found up to a number of edits."""

    def __init__(self, words: list[str], budget: int):
        self.size, self.budget = len(words), budget
        self.forward, self.backward = {}, {}
        for i, w in enumerate(words):
            self.forward[w] = self.forward.get(w, 0) | 1 << i
            self.backward[w] = self.backward.get(w, 0) | 1 << (self.size - 1 - i)

    def distances(self, words, peq: dict[str, int], anchored: bool):
        """Yields the least distance of the pattern to a stretch that ends with each word (anchored: and begins with the first)."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = full, 0, self.size
        for w in words:
            same = peq.get(w, 0)
            vertical = same | down
            horizontal = (((same & up) + up) ^ up) | same
            plus, minus = down | (~(horizontal | up) & full), up & horizontal
            score += (plus & top != 0) - (minus & top != 0)
            plus, minus = (plus << 1 | anchored) & full, (minus << 1) & full
            up, down = minus | (~(vertical | plus) & full), plus & vertical
            yield score

    def matches(self, words: list[str]):
        """Yields (distance, first word, word after the last): the best end of each run of ends within the budget."""
        scores = [*self.distances(words, self.forward, False), self.budget + 1]
        best = None
        for end, score in enumerate(scores):
            if score <= self.budget:
                if best is None or score < scores[best]:
                    best = end
            elif best is not None:
                back = list(self.distances(words[best::-1], self.backward, True))
                length = min(range(len(back)), key=lambda i: (back[i], abs(i + 1 - self.size))) + 1
                yield scores[best], best + 1 - length, best + 1
                best = None


class Matcher:
    """The pieces and patterns of a block of items [(item id, text)]."""

    def __init__(self, items, similarity: float = SIMILARITY):
        import ahocorasick

        self.patterns, pieces = [], {}
        for item, text in items:
            words = _WORD.findall(lowered(text or ""))
            if not words:
                continue
            budget = int(len(words) * (1 - similarity) + 1e-9)
            cuts = [len(words) * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(f" {' '.join(words[a:b])} ", []).append((len(self.patterns), a, b - a))
            self.patterns.append((item, Pattern(words, budget)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None):
        """(item id, distance, words of the item, first character, character after the last) of each match."""
        if not text or not self.patterns:
            return []
        low = lowered(text)
        words = _WORD.findall(low)
        line = f" {' '.join(words)} "
        windows: dict[int, list[list[int]]] = {}
        seen = at = 0
        for end, (size, uses) in self.automaton.iter(line):
            begin = end + 1 - size
            at += line.count(" ", seen, begin) if begin >= seen else -line.count(" ", begin, seen)
            seen = begin
            for n, offset, _ in uses:
                pattern = self.patterns[n][1]
                first = max(0, at - offset - pattern.budget)
                windows.setdefault(n, []).append([first, at - offset + pattern.size + pattern.budget])
        if not windows:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        found = []
        for n, parts in windows.items():
            item, pattern = self.patterns[n]
            parts.sort()
            joined = [parts[0]]
            for a, b in parts[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            for a, b in joined:
                for distance, i, j in pattern.matches(words[a:b]):
                    found.append((item, distance, pattern.size, spans[a + i][0], spans[a + j - 1][1]))
        return found


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each occurrence of an item: doc_id, item_id, distance in words, item_words, start and end (characters of the text)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(spread)
    blocks, out = _blocks(benchmark, block_bytes), None
    for part in blocks:
        found = texts.mapInArrow(_searcher(sent := _sent(part), similarity), SCHEMA)
        if len(blocks) > 1:
            found = settle(found, "found")
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in parts of about block_bytes of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes))
    return [items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) for block in range(blocks)]


def _sent(part: DataFrame):
    """One block of items, sent to the executors."""
    return part.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])


def _searcher(sent, similarity: float):
    key = uuid.uuid4().hex

    def run(batches):
        matcher = held(("decontaminate", key), lambda: Matcher(sent.value, similarity))
        for batch in batches:
            rows = [(i.as_py(), *m) for i, t in zip(batch.column("doc_id"), batch.column("text")) for m in matcher.find(t.as_py())]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "distance", "item_words", "start", "end"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose own text holds no item, with all their columns."""
    ship(docs.sparkSession)
    out, blocks = docs.transform(spread), _blocks(benchmark, block_bytes)
    for part in blocks:
        out = out.mapInArrow(_cleaner(sent := _sent(part), similarity), docs.schema)
        if len(blocks) > 1:
            out = settle(out, "cleaned")
            sent.unpersist()
    return out


def _cleaner(sent, similarity: float):
    key = uuid.uuid4().hex

    def run(batches):
        matcher = held(("decontaminate", key), lambda: Matcher(sent.value, similarity))
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column("text").cast(pa.string())], pa.bool_()))

    return run
