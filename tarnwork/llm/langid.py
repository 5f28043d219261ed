"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's letters, lower-cased, form words; a word's character n-grams with its boundaries are hashed to rows of an embedding
table; the average of a text's rows goes through a linear layer and a softmax. Training takes windows of words from a bounded
sample of labelled rows (MAX_ROWS for each language; of a longer text a stretch of MAX_CHARS at a place drawn by a hash), with a part held back to fit a temperature, so
that scores are calibrated, and the score under which a prediction counts as rejected. As all is linear up to the softmax,
prediction folds table and layer into one row of logits for each hash, and sums whole texts.

A text that is null or has no letter gets `und` with score 0, and so does every text if nothing could be learned. Repeated
rows are learned from once, and other columns, whatever their names, have no influence; equal scores go to the language that sorts
first. Rows without an id are not held out. An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.bpe import Numbered
from tarnwork.llm.common import id_text, per_text

UNKNOWN = "und"
#: The bound of the training sample: rows for each language, and characters of a text that is taken.
MAX_ROWS, MAX_CHARS = 1000, 20_000
BUCKETS, DIM, GRAMS = 1 << 16, 16, (1, 2, 3, 4)
EPOCHS, MIN_STEPS, BATCH, RATE, WINDOW, SEED = 6, 400, 64, 0.5, 40, 7
#: Share of wrong predictions that acceptance may let through on the held-back part.
MAX_WRONG = 0.005
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    reject_under: float = 0.0

    def scores(self, sums: np.ndarray, grams: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(grams, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams, word after word; how many each word has). Words without a letter have none."""
    text = "".join(f"<{w}>" if w.isalpha() or any(map(str.isalpha, w)) else "" for w in words)
    size = np.array([len(w) + 2 if w.isalpha() or any(map(str.isalpha, w)) else 0 for w in words], np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.cumsum(size)[owner] - np.arange(len(c)) if len(c) else np.empty(0, np.int64)
    found, own, h = [], [], np.zeros(len(c), np.uint64)
    for n in GRAMS:
        part = np.zeros(len(c), np.uint64)
        part[: max(0, len(c) - n + 1)] = c[n - 1 :]
        h = h * np.uint64(0x100000001B3) ^ part
        at = np.flatnonzero(left >= n)
        x = (h[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((x >> np.uint64(64 - 16)).astype(np.int64) & (BUCKETS - 1))
        own.append(owner[at])
    own, found = np.concatenate(own), np.concatenate(found)
    return found[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(words))


def train(texts: list[str], labels: list[str], seed: int = SEED) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    vocabulary, coded = Numbered(), []
    for t in texts:
        own = WORD.findall(t.lower())
        coded.append(np.fromiter(map(vocabulary.__getitem__, own), np.int32, len(own)))
    vocabulary = list(vocabulary)
    table = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    layer, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    rows = rng.permutation([i for i, w in enumerate(coded) if len(w)])
    held = rows[: len(rows) // 5] if len(rows) >= 50 else rows
    rows = rows[len(rows) // 5 :] if len(rows) >= 50 else rows

    def examples(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of a window of words of each row, how many each has)."""
        parts = []
        for i in own:
            at = rng.integers(0, max(1, len(coded[i]) - WINDOW + 1))
            parts.append(coded[i][at : at + int(rng.integers(3, WINDOW + 1))])
        flat, count = grams([vocabulary[k] for w in parts for k in w])
        return flat, np.add.reduceat(count, np.cumsum([0, *map(len, parts[:-1])]))

    turn = max(1, -(-len(rows) // BATCH))
    epochs, done = max(EPOCHS, -(-MIN_STEPS // turn)), 0
    steps = epochs * turn
    for _ in range(epochs):
        for own in np.array_split(rng.permutation(rows), -(-len(rows) // BATCH)) if len(rows) else []:
            f, size = examples(own)
            own, size = own[size > 0], size[size > 0]
            done += 1
            if not len(own):
                continue
            rate = RATE * (1 - (done - 1) / steps)
            hidden = np.add.reduceat(table[f], np.cumsum(size) - size) / size[:, None]
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            back = p @ layer.T
            layer -= rate * hidden.T @ p / len(own) * 8
            bias -= rate * p.mean(axis=0)
            at, where = np.unique(f, return_inverse=True)
            push = np.zeros((len(at), DIM))
            np.add.at(push, where, np.repeat(back / size[:, None], size, axis=0))
            table[at] -= rate * push
    model = Model(languages, (table @ layer).astype(np.float32), bias)
    held = np.repeat(held, 2)
    flat, n = examples(held) if len(held) else (np.empty(0, np.int64), np.empty(0, np.int64))
    truth, owner = y[held], np.repeat(np.arange(len(held)), n)
    sums = np.stack([np.bincount(owner, model.logits[flat, k], len(held)) for k in range(len(languages))], axis=1)
    if len(languages) > 1 and len(held):
        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(np.maximum(model.scores(sums, n)[np.arange(len(truth)), truth], 1e-12)).mean()

        model.temperature = min(2.0 ** np.arange(-5, 4.25, 0.25), key=loss)
        p = model.scores(sums, n)
        best, wrong = p.max(axis=1), p.argmax(axis=1) != truth
        order = np.argsort(-best)
        share = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share <= MAX_WRONG)
        model.reject_under = float(best[order][good[-1]]) if len(good) else 1.0
    return model


def sample(labelled: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[list[str], list[str]]:
    """Texts and languages of at most max_rows rows (id, text, lang) of each language, chosen by a hash of the id."""
    room = F.greatest(F.length("text") - max_chars, F.lit(0)) + 1
    stretch = F.substring("text", F.pmod(F.xxhash64("id", F.lit(1)), room).cast("int") + 1, F.lit(max_chars))
    fit = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("draw", F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(1 << 30)))
    share = {r["lang"]: min(1.0, 1.2 * max_rows / r["count"]) for r in fit.groupBy("lang").count().collect()}
    if not share:
        return [], []
    under = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(int(v * (1 << 30)))) for k, v in share.items()))
    drawn = fit.where(F.col("draw") < under[F.col("lang")]).select("lang", "draw", "id", stretch.alias("text")).distinct()  # combined before the shuffle
    rows = sorted(drawn.collect(), key=lambda r: (r["lang"], r["draw"], r["id"] is not None, r["id"] or 0, r["text"]))
    kept = [r for _, own in itertools.groupby(rows, key=lambda r: r["lang"]) for r in itertools.islice(own, max_rows)]
    return [r["text"] for r in kept], [r["lang"] for r in kept]


class Predictor:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, texts: list[str]) -> list:
        m = self.model
        words = [WORD.findall(t.lower()) for t in texts]
        size, known = np.array([len(w) for w in words], np.int64), Numbered()
        at = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(size.sum()))
        flat, count = grams(list(known))
        owner = np.repeat(np.arange(len(known)), count)
        by_word = np.stack([np.bincount(owner, m.logits[flat, k], len(known)) for k in range(len(m.languages))], axis=1) if m.languages else np.zeros((len(known), 0))
        text = np.repeat(np.arange(len(texts)), size)
        n = np.bincount(text, count[at], len(texts))
        if not m.languages:
            return [[UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)]
        p = m.scores(np.stack([np.bincount(text, by_word[at, k], len(texts)) for k in range(len(m.languages))], axis=1), n)
        best, score = p.argmax(axis=1), np.where(n > 0, p.max(axis=1), 0.0)
        return [[m.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], score, score < np.where(n > 0, m.reject_under, 2)]


def fit(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> Model:
    labelled = docs.where(learn_from).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return train(*sample(labelled, **bounds))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred string, score double, rejected boolean) for each row; only the text is an input."""
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.string(), pa.float64(), pa.bool_()]
    out = id_text(docs, id_col, text_col).mapInArrow(per_text(Predictor(model), types), f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learned from the rows outside the held-out fold, predicted for all."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit(docs, fold != held_fold)
    return predict(docs, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
