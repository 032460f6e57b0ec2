"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels.

A document is toxic if any of its sentences is: P(doc) = 1 - prod(1 - p(sentence)), and p(sentence)
is the logistic function of a bias plus the weights of its different words. A word's weight is the sum of
the weights of its features, character n-grams of the word with its borders and the word
itself. Only labels of documents are seen; the weights say which sentences offend.

Noisy-or over more sentences than documents of the training have would grow with mere length. So the
model learns how many sentences (reach) 90 % of them have at most, and a longer document's probability
is the greatest among its stretches of that many consecutive sentences, wherever they begin. A part
without a mark of its end is cut after at most WIDEST characters, between words where there are some.

Training takes a bounded sample of labelled rows (at most `positive` toxic and `negative` other ones,
those whose hashed id comes first, of texts up to `longest` bytes; parameters of train()) to the driver. Scoring covers every
whole text, without a shuffle; a worker remembers the weights of up to WORDS words.

Defined results: null, empty and blank texts have no sentence and score 0; no labelled toxic row:
every document scores 0; repeated rows score alike; rows without an id are scored, never learnt
from; several labels of one id: toxic if one is; labels that are null don't count; extra columns
are kept, and columns named toxicity or offending are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import held, ship, spread

POSITIVE, NEGATIVE, LONGEST = 1500, 3000, 1 << 16
GRAMS = (3, 4, 5)
SURE, LEAST = 4.5, 5
WORDS, WIDEST = 400_000, 1000
OFFENDING = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_WIDE = re.compile(rf"(?s).{{1,{WIDEST}}}\Z|.{{1,{WIDEST - 1}}}\s|.{{1,{WIDEST}}}")
_PLAIN = re.compile(r"[\W_]+")


def sentences(text: str) -> list[str]:
    """Consecutive parts that make up the text, each up to a full stop, mark or line end, or of WIDEST characters."""
    found = _SENTENCE.findall(text)
    return [p for s in found for p in ([s] if len(s) <= WIDEST else _WIDE.findall(s))]


def features(word: str) -> list[str]:
    """The n-grams of a word in lower case, without marks around or in it."""
    bare = _PLAIN.sub("", word.lower())
    if not bare:
        return []
    edged = f"^{bare}$"
    return list(dict.fromkeys([edged, *(edged[i : i + n] for n in GRAMS for i in range(len(edged) - n + 1))]))


@dataclass
class Model:
    """Weights of the n-grams that tell; as many as the training rows hold at most."""

    weights: dict[str, float]
    bias: float
    #: Sentences over which noisy-or goes.
    reach: int = 1

    def key(self) -> str:
        return hashlib.sha256(repr((sorted(self.weights.items()), self.bias, self.reach)).encode()).hexdigest()


def fit(texts: list[str], labels: list[int], turns: int = 200, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Noisy-or likelihood of the document labels, by gradient descent (Adam).

    Only features that toxic documents hold more, or less, often than chance explains (SURE
    standard deviations, LEAST occurrences) get a weight; the others would learn the names
    in single documents.
    """
    if not any(labels):
        return Model({}, -50.0)
    vocabulary: dict[str, int] = {}
    word_of, sentence_of, doc_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in sentences(text):
            if words := dict.fromkeys(s.split()):
                sentence_of.extend([len(doc_of)] * len(words))
                word_of.extend([vocabulary.setdefault(w, len(vocabulary)) for w in words])
                doc_of.append(d)
    reach = int(np.percentile(np.bincount(np.array(doc_of, dtype=np.int32)), 90)) if doc_of else 1
    number: dict[str, int] = {}
    grams, sizes = array("i"), array("i")
    for w in vocabulary:
        own = features(w)
        sizes.append(len(own))
        grams.extend([number.setdefault(g, len(number)) for g in own])
    sizes, gram, words = np.array(sizes), np.frombuffer(grams, dtype=np.int32), len(vocabulary)
    owner = np.repeat(np.arange(words, dtype=np.int32), sizes)
    size = np.sqrt(np.maximum(1, sizes))
    word_of, sentence_of, doc_of, y = (np.array(x, dtype=np.int32) for x in (word_of, sentence_of, doc_of, labels))

    held = np.unique(doc_of[sentence_of].astype(np.int64) * words + word_of)  # each word once a document
    in_toxic = y[held // words] == 1
    many = [np.bincount(held[mask] % words, minlength=words) for mask in (in_toxic, ~in_toxic)]
    toxic, other = np.zeros(len(number)), np.zeros(len(number))
    for i in range(0, len(gram), 1 << 20):  # in parts, for the driver's memory
        part, of = gram[i : i + (1 << 20)], owner[i : i + (1 << 20)]
        for total, n in ((toxic, many[0]), (other, many[1])):
            total += np.bincount(part, n[of], minlength=len(number))
    share = in_toxic.mean()
    chance = (toxic + other) * share
    chosen = (np.abs(toxic - chance) > SURE * np.sqrt(chance * (1 - share) + 0.25)) & (toxic + other >= LEAST)
    owner, gram = owner[chosen[gram]], gram[chosen[gram]]
    kinds, gram = np.unique(gram, return_inverse=True)
    scale = 1 / size[owner]

    weights, bias = np.zeros(len(kinds)), -4.0
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    used = np.zeros(words, dtype=bool)
    used[owner] = True
    told = used[word_of]  # the other words add nothing to a sentence
    word_of, sentence_of = word_of[told], sentence_of[told]
    for turn in range(1, turns + 1):
        of_word = np.bincount(owner, weights[gram] * scale, minlength=words)
        z = np.bincount(sentence_of, of_word[word_of], minlength=len(doc_of)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        total = np.bincount(doc_of, np.logaddexp(0, z), minlength=len(texts))
        by_doc = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 40)), 1.0)
        by_sentence = by_doc[doc_of] * p
        by_word = np.bincount(word_of, by_sentence[sentence_of], minlength=words)
        slope = np.bincount(gram, by_word[owner] * scale, minlength=len(kinds)) / len(texts) + ridge * weights
        slope_b = by_sentence.sum() / len(texts)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        mb, vb = 0.9 * mb + 0.1 * slope_b, 0.99 * vb + 0.01 * slope_b**2
        weights = weights - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**turn)) / (math.sqrt(vb / (1 - 0.99**turn)) + 1e-8)
    names = list(number)
    return Model({names[k]: float(w) for k, w in zip(kinds, weights)}, float(bias), max(1, reach))


class Scorer(dict):
    """Scores texts; as a dict it holds the weights of words seen."""

    def __init__(self, model: Model):
        super().__init__()
        self.weights, self.bias, self.reach = model.weights, model.bias, model.reach

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS:
            self.clear()
        own, known = features(word), self.weights
        self[word] = value = sum([known[g] for g in own if g in known]) / math.sqrt(len(own) or 1)
        return value

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """The document's probability, and place and probability of each sentence at 0.5 or more."""
        total, most, at, found = 0.0, 0.0, 0, []
        stretch: deque[float] = deque()
        weight = self.__getitem__
        for s in sentences(text) if text else []:
            if words := dict.fromkeys(s.split()):
                z = self.bias + sum(map(weight, words))
                stretch.append(math.log1p(math.exp(z)) if z < 30 else z)
                total += stretch[-1]
                if len(stretch) > self.reach:
                    total -= stretch.popleft()
                most = max(most, total)
                if z >= 0:
                    found.append({"start": at, "end": at + len(s), "score": 1 / (1 + math.exp(-z))})
            at += len(s)
        return -math.expm1(-most), found


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE, longest: int = LONGEST) -> Model:
    """Learns from at most positive + negative labelled rows that are not held out.

    longest bounds the bytes of a text that is learnt from, so that the driver holds at most
    (positive + negative) * longest bytes. A row with a longer text gives no example; the
    ids are chosen first, so none takes its place. Scores cover texts of any length.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit(9), "doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(positive).unionByName(known.where("toxic <> 1").orderBy(*order).limit(negative))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= longest)
    # At most positive + negative ids are broadcast and as many rows collected; copies of an id are taken once.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [int(r["toxic"] == 1) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxicity (0 to 1) and offending: start, end and score of the sentences at 0.5 or more."""
    spark = docs.sparkSession
    ship(spark)
    sent, key = spark.sparkContext.broadcast(model), model.key()
    docs = docs.drop("toxicity", "offending")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("offending", OFFENDING)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        use = held(("toxicity", key), lambda: Scorer(sent.value))
        for batch in batches:
            found = [use.score(t.as_py()) for t in batch.column("text")]
            columns = [*batch.columns, pa.array([p for p, _ in found], pa.float64()), pa.array([x for _, x in found], kind)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "toxicity", "offending"])

    return spread(docs).mapInArrow(run, schema)
