"""Test items that leaked into a corpus, wholly, in part or reworded.

Passages are runs of words, half overlapping, so that any run of up to half a
passage stands whole in one of them. They are weighted by TF-IDF with document
frequencies of the whole corpus and compared in the latent space of a
randomised SVD of the items' passages. What comes close to an item is compared
with it word by word: longest common run, longest common subsequence, answer.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import mail, svd
from strandloom.runtime import materialize

PASSAGE, STRIDE = 24, 12
RUN = 12
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


class Items:
    """A block of test items as numbers of the vocabulary of all items."""

    def __init__(self, rows, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.words = [np.array([vocabulary[x] for x in w], np.int32) for _, w in rows]
        self.answers = [self._answer(w) for _, w in rows]
        self.passages, self.owner = [], []
        for k, w in enumerate(self.words):
            for a in range(0, max(1, len(w) - RUN + 1), STRIDE):
                self.passages.append(w[a:a + PASSAGE])
                self.owner.append(k)

    def _answer(self, w: list[str]) -> tuple[int, ...]:
        """The words after the last ``answer`` of an item, if it gives one."""
        at = len(w) - 1 - w[::-1].index("answer") if "answer" in w else len(w)
        return tuple(self.vocabulary[x] for x in w[at + 1:])


def _passages(flat: np.ndarray, lengths: np.ndarray, least: int):
    """Starts and ends of the passages with at least ``least`` words of the vocabulary."""
    ends = np.cumsum(lengths)
    count = np.maximum(1, -(-(lengths - RUN + 1) // STRIDE)) * (lengths >= RUN)
    part = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    a = (ends - lengths)[part] + k * STRIDE
    b = np.minimum(a + PASSAGE, ends[part])
    known = np.concatenate([[0], np.cumsum(flat >= 0)])
    keep = known[b] - known[a] >= least
    return part[keep], a[keep], b[keep], (k * STRIDE)[keep]


def _corpus_rows(vocabulary: dict[str, int], decode):
    """Passages (kind 0) and, for each batch, its document frequencies (kind 1), from one decoding of each text."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            flat, lengths, owner = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for p in decode(text):
                    w = words(p)
                    flat += [vocabulary.get(x, -1) for x in w]
                    lengths.append(len(w))
                    owner.append(i)
            flat, lengths, owner = np.array(flat, np.int32), np.array(lengths, np.int64), np.array(owner, np.int64)
            kept = flat >= 0
            pair = np.unique(np.repeat(owner, lengths)[kept] * (len(vocabulary) + 1) + flat[kept])
            seen, n = np.unique(pair % (len(vocabulary) + 1), return_counts=True)
            part, a, b, _ = _passages(flat, lengths, RUN)
            texts = pa.array([flat[x:y] for x, y in zip(a, b)] + [seen.astype(np.int32)], pa.list_(pa.int32()))
            m = len(part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * m + [1], pa.int8()),
                    pa.concat_arrays([ids.take(pa.array(owner[part])).cast(pa.int64()), pa.array([None], pa.int64())]),
                    texts,
                    pa.array([None] * m + [n.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([0] * m + [batch.num_rows], pa.int64()),
                ],
                names=["kind", "doc", "words", "counts", "docs"],
            )

    return run


def _common_subsequence(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows; -1 fits nothing."""
    n, w = x.shape
    best = np.zeros((n, y.shape[1] + 1), np.int16)
    for i in range(w):
        hit = (y == x[:, i:i + 1]) & (x[:, i:i + 1] >= 0)
        new = np.zeros_like(best)
        new[:, 1:] = np.maximum(best[:, 1:], np.where(hit, best[:, :-1] + 1, 0))
        best = np.maximum.accumulate(new, axis=1)
    return best[:, -1]


def _longest_run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common run of each pair of rows."""
    ends = np.zeros((len(x), y.shape[1] + 1), np.int16)
    longest = np.zeros(len(x), np.int16)
    for i in range(x.shape[1]):
        hit = (y == x[:, i:i + 1]) & (x[:, i:i + 1] >= 0)
        new = np.zeros_like(ends)
        new[:, 1:] = np.where(hit, ends[:, :-1] + 1, 0)
        ends = new
        np.maximum(longest, ends.max(axis=1), out=longest)
    return longest


class Search:
    """Candidates by cosine in the latent space or by an equal run of 12 words, checked word by word."""

    def __init__(self, items: Items, idf: np.ndarray, basis: np.ndarray, cosine: float):
        self.cosine, self.ids = cosine, items.ids
        self.basis = (basis * idf[:, None]).astype(np.float32)
        latent = np.stack([self.basis[p].sum(axis=0) for p in items.passages]) if items.passages else np.zeros((0, basis.shape[1]), np.float32)
        order = np.argsort(items.owner, kind="stable")
        self.latent = self._unit(latent)[order]
        owner = np.array(items.owner, np.int64)[order]
        self.first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
        longest = max((len(w) for w in items.words), default=1)
        self.texts = np.full((len(items.words), longest), -2, np.int32)
        for k, w in enumerate(items.words):
            self.texts[k, : len(w)] = w
        # the words of each item as sorted numbers of item and word: as many as the items have words
        self.width = len(idf) + 1
        self.holds = np.unique(np.concatenate([k * self.width + np.unique(w).astype(np.int64) for k, w in enumerate(items.words)]))
        self.answers = items.answers
        self.powers = np.cumprod(np.full(RUN, 0x9E3779B97F4A7C15, np.uint64))
        runs = sorted({(int(h), k) for k, w in enumerate(items.words) for h in self._run_hashes(np.array([w], np.int64))[0]})
        self.run_hash = np.array([h for h, _ in runs], np.uint64)
        self.run_item = np.array([k for _, k in runs], np.int64)

    def _run_hashes(self, grid: np.ndarray) -> np.ndarray:
        """Of every 12 consecutive words of each row; equal runs agree, others are told apart by the check that follows."""
        if grid.shape[1] < RUN:
            return np.zeros((len(grid), 0), np.uint64)
        return np.lib.stride_tricks.sliding_window_view((grid + 2).astype(np.uint64), RUN, axis=1) @ self.powers

    @staticmethod
    def _unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def batch(self, lists) -> tuple[np.ndarray, ...]:
        """Row number, item number, run, subsequence and whether the answer is there."""
        n = len(lists)
        grid = np.full((n, PASSAGE), -1, np.int32)
        for row, x in zip(grid, lists):
            row[: len(x)] = x
        latent = np.zeros((n, self.basis.shape[1]), np.float32)
        for k in range(PASSAGE):
            known = grid[:, k] >= 0
            latent[known] += self.basis[grid[known, k]]
        # the best passage of each item, items being side by side
        near = np.maximum.reduceat(self._unit(latent) @ self.latent.T, self.first, axis=1) >= self.cosine
        h = self._run_hashes(grid)
        first, last = np.searchsorted(self.run_hash, h, "left"), np.searchsorted(self.run_hash, h, "right")
        for row, at in zip(*np.nonzero(last > first)):
            near[row, self.run_item[first[row, at] : last[row, at]]] = True
        row, item = np.nonzero(near)
        shared = np.zeros(len(row), np.int16)
        for k in range(PASSAGE):
            word = grid[row, k].astype(np.int64)
            asked = item * self.width + np.where(word < 0, self.width - 1, word)  # the last column, which no item has
            shared += self.holds[np.minimum(np.searchsorted(self.holds, asked), len(self.holds) - 1)] == asked
        row, item = row[shared >= RUN], item[shared >= RUN]
        x, y = grid[row], self.texts[item]
        answered = [bool(a) and self._holds(x[i], a) for i, a in enumerate(self.answers[k] for k in item)]
        return row, item, _longest_run(x, y), _common_subsequence(x, y), np.array(answered, bool)

    @staticmethod
    def _holds(x: np.ndarray, answer: tuple[int, ...]) -> bool:
        m = len(answer)
        return any(tuple(x[i:i + m]) == answer for i in range(len(x) - m + 1))


def _search_rows(search: Search):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                row, item, longest, common, answered = search.batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(search.ids[item]), pa.array(longest.astype(np.int32)), pa.array(common.astype(np.int32)), pa.array(answered)],
                    names=["doc", "item", "run", "common", "answered"],
                )

    return run


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, rank: int = 256, cosine: float = 0.5, reworded: int = 18, block: int = 5000, decode=mail.plain_parts) -> DataFrame:
    """Columns ``doc_id``, ``item_id``, ``run``, ``common`` and ``answered``.

    One row for each document and item of which a passage of 24 words of the
    document holds at least 12 consecutive words of the item, or at least
    ``reworded`` words in the item's order. ``run`` is the longest common run of
    words within a passage, ``common`` the longest common subsequence,
    ``answered`` whether a passage also gives the item's answer.

    Runs are found whatever their cosine, rewordings from ``cosine`` on. Every
    document and every passage of it is compared; only passages with fewer
    than 12 words of the items' vocabulary are left out, which can't hold such a
    subsequence. ``items`` is the query set: texts are decoded and cut into
    passages once for all items, and the items go to the tasks in blocks of about
    ``block``, each with a latent space of its own. Their vocabulary, a row for each
    word that any item has, is held whole. Null texts and ids,
    empty texts and items of fewer than 12 words match nothing. Repeated items
    all match. Other columns aren't read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sound = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).dropna()
    told = sound.mapInArrow(_item_words, "item long, words array<string>")
    known = materialize(told.filter(F.size("words") >= RUN), "items")
    vocabulary = {r.w: k for k, r in enumerate(known.select(F.explode("words").alias("w")).distinct().orderBy("w").collect())}
    if not vocabulary:
        return spark.createDataFrame([], "doc_id long, item_id long, run int, common int, answered boolean")
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).alias("text")).filter(F.col("doc").isNotNull())
    schema = "kind byte, doc long, words array<int>, counts array<int>, docs long"
    rows = materialize(corpus.mapInArrow(_corpus_rows(vocabulary, decode), schema), "passages")
    idf = _inverse_frequencies(rows.filter("kind = 1"), len(vocabulary))
    n = max(1, math.ceil(known.count() / block))
    best = None
    for k in range(n):
        own = known.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        one = Items([(r.item, r.words) for r in own.orderBy("item").collect()], vocabulary)
        if len(one.ids):
            hits = _block_hits(rows.filter("kind = 0").select("doc", "words"), own, one, idf, rank, cosine)
            best = hits if best is None else best.unionByName(hits)
    kept = best.filter((F.col("run") >= RUN) | (F.col("common") >= reworded)).groupBy("doc", "item")
    return kept.agg(F.max("run").alias("run"), F.max("common").alias("common"), F.max("answered").alias("answered")).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "run", "common", "answered")


def _item_words(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["item", "words"])


def _inverse_frequencies(stats: DataFrame, n_words: int) -> np.ndarray:
    n_docs = stats.agg(F.sum("docs")).first()[0] or 0
    frequency = np.zeros(n_words)
    per_word = stats.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("x.words").agg(F.sum("x.counts"))
    for w, n in per_word.collect():  # at most one row for each word of the items
        frequency[w] = n
    return np.log((n_docs + 1) / (frequency + 0.5)).clip(min=1e-3)


def _weighted_rows(vocabulary: dict[str, int], idf: np.ndarray):
    """The passages of each item as sparse TF-IDF rows of length 1."""

    def run(batches):
        for b in batches:
            features, weights = [], []
            for w in b.column(0).to_pylist():
                numbers = np.array([vocabulary[x] for x in w], np.int32)
                for a in range(0, max(1, len(w) - RUN + 1), STRIDE):
                    f, n = np.unique(numbers[a:a + PASSAGE], return_counts=True)
                    x = n * idf[f]
                    features.append(f)
                    weights.append((x / np.linalg.norm(x)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], names=["features", "weights"])

    return run


def _block_hits(passages: DataFrame, items: DataFrame, block: Items, idf: np.ndarray, rank: int, cosine: float) -> DataFrame:
    fit = items.select("words").mapInArrow(_weighted_rows(block.vocabulary, idf), "features array<int>, weights array<float>")
    search = Search(block, idf, svd.right_vectors(fit, len(idf), rank), cosine)
    return passages.mapInArrow(_search_rows(search), "doc long, item long, run int, common int, answered boolean")
