"""Quality rules from a suffix array of words.

Every text becomes a sequence of word numbers. The suffixes of many texts are sorted at once by prefix doubling, in which only
suffixes that still share their prefix are sorted again; a suffix never runs past its text. Neighbours' common prefixes follow
from the ranks of the doubling rounds, and the widest LCP interval around a suffix tells the longest substring that starts
there and occurs elsewhere in the text. These maximal repeats give the covered words and the longest repeat, on which the
verdict depends; the three-word windows of the base rule are the repeats of three words or more.

Null and empty texts have no words and fail the base rule. Ties, repeated rows, rows without an id and other columns (whatever
their names) have no influence: a row's result depends on its text alone. An empty table gives an empty one. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwork.llm.bpe import Numbered
from tarnwork.llm.common import id_text, per_text, pieces

WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Defaults of the verdict: words that make a repeat, the share of words that repeats may cover, and the longest repeat's share.
REPEAT_WORDS, MAX_COVERED, MAX_LONGEST = 8, 0.3, 0.25
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "n_longest", "base_failed", "kept")
TYPES = [pa.int64()] * 7 + [pa.bool_()] * 2


def repeats(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """words: numbers >= 0 of all texts, one text after the other; size: words per text. Per position: how many words from there on occur elsewhere in the same text."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(size)), size)
    end = np.cumsum(size)[text]
    _, rank = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True)
    rank = rank.astype(np.int64)
    start_of = np.concatenate([[0], np.cumsum(np.bincount(rank))])
    rank, count = start_of[rank], np.diff(start_of)[rank]  # a group's rank is its first place in the suffix array
    place, levels, step = np.empty(n, np.int64), [rank], 1
    place[rank] = np.arange(n)
    todo = np.flatnonzero(count > 1)
    while len(todo):
        ahead = todo + step
        behind = np.where(ahead < end[todo], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[todo] * (n + 2) + behind
        order = np.argsort(key, kind="stable")
        key, todo = key[order], todo[order]
        old = rank[todo]
        new = np.concatenate([[True], key[1:] != key[:-1]])  # first of its new group
        first = np.concatenate([[True], old[1:] != old[:-1]])  # first of its old group
        at = np.arange(len(todo))
        begun = np.maximum.accumulate(np.where(first, at, 0))
        place[old + at - begun] = todo
        rank = rank.copy()
        rank[todo] = old + np.maximum.accumulate(np.where(new, at, 0)) - begun
        levels.append(rank)
        step *= 2
        alone = new & np.append(new[1:], True)
        todo = todo[~alone]
    a, b = place[:-1], place[1:]
    own = np.flatnonzero(levels[0][a] == levels[0][b])  # the others share nothing
    a, b = a[own], b[own]
    shared, at_a, at_b = np.zeros(len(own), np.int64), a.copy(), b.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (at_a < end[a]) & (at_b < end[b])
        same = inside & (levels[k][np.minimum(at_a, n - 1)] == levels[k][np.minimum(at_b, n - 1)])
        shared += same << k
        at_a += same << k
        at_b += same << k
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, shared)
    np.maximum.at(out, b, shared)
    return out


def covered(length: np.ndarray, least: int, span: int | None = None) -> np.ndarray:
    """Positions inside a repeat of `least` words or more (or inside the first `span` words of it)."""
    at = np.flatnonzero(length >= least)
    edge = np.zeros(len(length) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (length[at] if span is None else span), -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str], repeat_words: int = REPEAT_WORDS, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> list:
    """One list or array for each of COLUMNS."""
    cut = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at ASCII white space only
    size = np.array([len(x) for x in cut], np.int64)
    words = np.fromiter(map(Numbered().__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(size.sum()))
    length = repeats(words, size)
    starts = np.cumsum(size) - size

    def per(values: np.ndarray, how=np.add) -> np.ndarray:
        out = np.zeros(len(size), np.int64)
        if (size > 0).any():
            out[size > 0] = how.reduceat(values.astype(np.int64), starts[size > 0])
        return out

    n_repeat, n_covered, n_longest = per(covered(length, 3, 3)), per(covered(length, repeat_words)), per(length, np.maximum)
    lines = [[x for x in t.split("\n") if x.strip(WHITE)] for t in texts]
    base = (size < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * size)
    good = (n_covered <= max_covered * size) & (n_longest <= max_longest * size)
    return [
        size,
        [len(t) - sum(map(t.count, WHITE)) for t in texts],
        [sum(map(t.count, SYMBOLS)) for t in texts],
        [len(x) - len(set(x)) for x in lines],
        n_repeat,
        n_covered,
        n_longest,
        base,
        ~base & good,
    ]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(id, COLUMNS...) for each row. limits: repeat_words, max_covered, max_longest."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} {'boolean' if t == pa.bool_() else 'long'}" for c, t in zip(COLUMNS, TYPES, strict=True))
    out = id_text(docs, id_col, text_col).mapInArrow(per_text(lambda texts: measure(texts, **limits), TYPES), schema)
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows whose text passes, with all their columns, in one pass."""

    def run(batches):
        for batch in batches:
            text = batch.column(text_col)
            for at, n in pieces(text):
                ok = measure([t or "" for t in text.slice(at, n).to_pylist()], **limits)[-1]
                yield batch.slice(at, n).filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
