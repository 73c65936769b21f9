"""Toxicity: a recurrent network over all overlapping windows of each whole text.

The network is trained on the driver from a bounded sample of labelled rows; the trained arrays,
whose size the network's shape fixes, go to the executors, which score every window of every text.
A text's logit is that of its worst window, scaled so that it estimates the label's probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, chunks, tidied
from .gru import LONGEST_WORD, Adam, Shape, every_window_logits, gradients, new_parameters, projected, window_logits, windows_of, word_features

#: Windows of the training sample that are scored together.
BATCH = 768
#: Bits of a hash by which texts with a word, or with a gram, are counted.
COUNT_BITS = 18
#: Words whose inputs are made together.
SOME = 8192


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learned from: CRC-32 of the id as text is divisible by 5. Null: false."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def text_words(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, in lists from about CHUNK bytes each; long words in pieces."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end] > 0x20:
            end += 1
        words = text[at:end].lower().split()
        if words and max(map(len, words)) > LONGEST_WORD:
            words = [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
        yield words
        at = end


class Scorer:
    """Scores texts; the inputs of up to ``remember`` distinct words are kept between calls."""

    def __init__(self, model: dict, remember: int = 100_000):
        self.model, self.remember = model, remember
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.tables = [np.empty((1024, self.model["net"]["bias"].size // 2), np.float32) for _ in range(2)]
        self._learn([b""])  # stands for a text without words

    def _learn(self, words: list[bytes]) -> None:
        n, more = len(self.index), len(words)
        if n + more > len(self.tables[0]):
            self.tables = [np.concatenate([t, np.empty((max(more, len(t)), t.shape[1]), np.float32)]) for t in self.tables]
        for i in range(0, more, SOME):
            some = words[i : i + SOME]
            features = word_features(some)
            for table, half in zip(self.tables, projected(self.model["net"], *features, counted(self.model["excess"], *features))):
                table[n + i : n + i + len(some)] = half
        self.index.update(zip(words, range(n, n + more)))

    def _ids(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.index.get, words))
        if None in found:
            self._learn(list(dict.fromkeys(w for w, i in zip(words, found) if i is None)))
            found = list(map(self.index.get, words))
        return np.array(found, np.int32)

    def logits(self, texts: list[bytes]) -> list[float]:
        """The largest logit of each text's windows, of which one starts at every word that has a whole window."""
        out: list[float] = []
        for a, b in chunks(texts):
            if len(self.index) > self.remember:
                self._forget()
            split = [list(chain.from_iterable(text_words(t))) for t in texts[a:b]]
            flat = self._ids(list(chain.from_iterable(split)))
            window = self.model["window"]
            cuts = np.cumsum([0, *map(len, split)])
            own = [np.resize(flat[i:j], window) if 0 < j - i < window else flat[i:j] if j > i else np.zeros(window, np.int32) for i, j in zip(cuts, cuts[1:])]
            last = np.cumsum([len(ids) for ids in own])
            # Windows that reach into the next text are passed over: every other span between the bounds.
            scores = every_window_logits(self.model["net"], *self.tables, np.concatenate(own), window)
            bounds = np.stack([np.concatenate([[0], last[:-1]]), last - window + 1], 1).reshape(-1)
            out += np.maximum.reduceat(scores, bounds[:-1])[::2].tolist()
        return out


def counted(excess: np.ndarray, hashes: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word its excess among texts of label 1, and the greatest excess of its grams."""
    own = excess[0, (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    return np.stack([own, np.maximum.reduceat(excess[1, (grams >> np.uint32(32 - COUNT_BITS)).astype(np.int64)], starts[:-1])], 1)


class _Words:
    """Hashes of the sample's words, and what counts say of them."""

    def __init__(self, words: list[bytes], of_text: list[np.ndarray], labels: np.ndarray):
        parts = [word_features(words[i : i + SOME]) for i in range(0, len(words), SOME)]
        self.hashes = np.concatenate([h for h, _, _ in parts])
        self.grams = np.concatenate([g for _, g, _ in parts])
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(s) for _, _, s in parts]))])
        seen = np.zeros((2, 2, 1 << COUNT_BITS), np.float32)  # label, word or gram, bucket
        for ids, y in zip(of_text, labels):
            hashes, grams, _ = self.of(np.unique(ids))
            seen[y, 0, np.unique(hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] += 1
            seen[y, 1, np.unique(grams >> np.uint32(32 - COUNT_BITS)).astype(np.int64)] += 1
        n = np.bincount(labels, minlength=2).astype(np.float32)
        self.excess = _excess(seen[0], seen[1], n[0], n[1])
        # A text that is learned from must not find itself in the counts: without it, they are these.
        every = (self.hashes, self.grams, self.starts)
        self.without = [counted(_excess(np.maximum(seen[0] - 1, 0), seen[1], n[0] - 1, n[1]), *every), counted(_excess(seen[0], np.maximum(seen[1] - 1, 0), n[0], n[1] - 1), *every)]

    def of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = self.starts[some + 1] - self.starts[some]
        cuts = np.concatenate([[0], np.cumsum(length)])
        return self.hashes[some], self.grams[np.arange(cuts[-1]) + np.repeat(self.starts[some] - cuts[:-1], length)], cuts


def _excess(clean: np.ndarray, toxic: np.ndarray, n_clean: float, n_toxic: float) -> np.ndarray:
    """A quarter of the logarithm of how much more often texts of label 1 have a bucket; 0 if none has it."""
    share = max(n_toxic, 1) / max(n_clean + n_toxic, 1)
    ratio = (toxic / np.float32(share) + 1) / (clean / np.float32(max(1 - share, 1e-3)) + 1)
    return (np.log(ratio) / 4).astype(np.float32)


def _fit(model: dict, texts: list[bytes], labels: np.ndarray, stride: int, steps: int, rounds: int, batch: int, seed: int) -> None:
    """The windows to blame for a text's label 1 are learned, against windows of label 0 laid ``stride`` apart.

    Those are first the ones with the most suspicious word, later the ones that score highest;
    of label 0, windows that score high are learned more often than others.
    """
    net, window = model["net"], model["window"]
    draw = np.random.default_rng(seed)
    index: dict[bytes, int] = {b"": 0}
    of_text = [np.array([index.setdefault(w, len(index)) for w in chain.from_iterable(text_words(t))] or [0], np.int32) for t in texts]
    words = _Words(list(index), of_text, labels)
    total = len(index)
    del index
    model["excess"] = words.excess
    # Windows of label 1 are laid closely, so that a word to blame is seen at many places.
    of_window = [windows_of(ids, window, window // 8 if y else stride) for ids, y in zip(of_text, labels)]
    rows = np.concatenate(of_window)
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in of_window])
    first = np.searchsorted(owner, np.arange(len(texts)))
    of_label = labels[owner]
    every_negative = np.flatnonzero(of_label == 0)
    del of_text, of_window
    optimizer = Adam(net, 0.01, 1.0)
    steps = min(steps, max(30, int(labels.sum()) // 3))  # few texts are soon known by heart

    def train(positive: np.ndarray, negative: np.ndarray) -> None:
        target = (np.arange(batch) < batch // 3).astype(np.float32)
        for _ in range(steps):
            chosen = np.concatenate([draw.choice(positive, batch // 3), draw.choice(negative, batch - batch // 3)])
            # A word of texts of both labels has an input for each.
            present, windows = np.unique(rows[chosen].T.astype(np.int64) * 2 + of_label[chosen], return_inverse=True)
            inputs = np.where((present % 2 == 1)[:, None], words.without[1][present // 2], words.without[0][present // 2])
            optimizer.step(gradients(net, (*words.of(present // 2), inputs), windows.reshape(window, batch), target, np.ones(batch, np.float32)))

    def place(scores: np.ndarray) -> np.ndarray:
        """Of each window among its text's, the highest score first."""
        order = np.lexsort((-scores, owner))
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order))
        return out - first[owner]

    doubt = words.without[1].max(1)
    at = place(np.concatenate([doubt[rows[i : i + 4096]].max(1) for i in range(0, len(rows), 4096)]))
    train(np.flatnonzero((of_label == 1) & (at < 4)), every_negative)
    for _ in range(rounds):
        scores = np.empty(len(rows), np.float32)
        for y in (0, 1):
            halves = [projected(net, *words.of(np.arange(i, min(i + SOME, total))), words.without[y][i : i + SOME]) for i in range(0, total, SOME)]
            tables = [np.concatenate(h) for h in zip(*halves)]
            own = np.flatnonzero(of_label == y)
            for i in range(0, len(own), BATCH):
                scores[own[i : i + BATCH]] = window_logits(net, *tables, rows[own[i : i + BATCH]].T)
        at = place(scores)
        hardest = np.flatnonzero((of_label == 0) & (at < 2))
        train(np.flatnonzero((of_label == 1) & (at < 3)), np.concatenate([hardest, draw.choice(every_negative, len(hardest))]))


def _scale(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the labels on the logits."""
    x, slope, offset = np.asarray(logits, np.float64), 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        d, c = (p - labels) * weight, p * (1 - p) * weight + 1e-9
        # A small pull to slope 1, offset 0 keeps separable labels finite.
        g = np.array([(d * x).sum() + 0.5 * (slope - 1), d.sum() + 0.5 * offset])
        hess = np.array([[(c * x * x).sum() + 0.5, (c * x).sum()], [(c * x).sum(), c.sum() + 0.5]])
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        slope, offset = slope - move[0], offset - move[1]
        if abs(move).max() < 1e-6:
            break
    return max(slope, 0.05), offset


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1200, longest: int = 20_000, window: int = 16, stride: int = 16, steps: int = 100, rounds: int = 2, batch: int = 192, seed: int = 7, shape: Shape | None = None) -> dict:
    """A model for score_toxicity, learned from labels of ids that are not held out.

    The sample is bounded: at most ``per_class`` ids of each label, in the order of a hash of the
    id, and of those the texts of at most ``longest`` characters. An id with several labels counts
    as 1 if one of them is, an id with several texts gives one of them; null labels and ids are passed over. ``stride`` only spaces the windows of
    label 0 that are learned from; scoring takes them all. Without labelled texts of both
    kinds the model gives every text the share of 1 among them (0 if there are none).
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    rated = usable.groupBy(F.col(id_col).alias("rated_id")).agg(F.max(label_col).alias("y"))
    totals = {r.y: r.n for r in rated.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    picked = [rated.filter(F.col("y") == y).orderBy(F.xxhash64("rated_id"), "rated_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # twice per_class rows at most
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text")).filter(F.length("own_text") <= longest)
    matched = texts.join(sample, F.col("own_id") == F.col("rated_id"))
    # One text for each id, so that the rows are bounded as the ids are, however often one is repeated.
    found = matched.groupBy("rated_id", "y").agg(F.min_by("own_text", F.struct(F.xxhash64("own_text"), "own_text")).alias("own_text")).select("rated_id", "own_text", "y")
    rows = sorted(found.collect(), key=lambda r: (str(r[0]), r[1]))
    y = np.array([r.y for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.0}
    raw = [r[1].encode() for r in rows]
    shape = shape or Shape()
    model = {"net": new_parameters(shape, seed), "window": window}
    aside = np.arange(len(y)) % 6 == 0  # to scale by
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    _fit(model, [t for t, a in zip(raw, aside) if not a], y[~aside], stride, steps, rounds, batch, seed)
    judged = aside if aside.any() else ~aside
    logits = np.array(Scorer(model).logits([t for t, j in zip(raw, judged) if j]))
    share = np.array([totals.get(k, 0) / max(1, (y[judged] == k).sum()) for k in (0, 1)])
    weight = share[y[judged]]
    model["slope"], model["offset"] = _scale(logits, y[judged], weight * len(weight) / weight.sum())
    return model


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 if score >= 0.5): one row for each row.

    All overlapping windows of the whole text are scored, one from each word on, and the worst counts. Null text counts as
    empty; an empty text is scored as one empty word. Very long texts are read piece by piece.
    Repeated rows get equal scores. Ids are only carried along, other columns not looked at. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    if "constant" in model:
        score = F.lit(model["constant"])
        return docs.select(F.col(id_col), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    shipped = spark.sparkContext.broadcast(model)  # its size is that of the network's shape
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shipped.value, Scorer(shipped.value)
        for batch in batches:
            logits = np.array(scorer.logits(batch.column("text").cast(pa.binary()).to_pylist()), np.float64)
            score = 1 / (1 + np.exp(-np.clip(model["slope"] * logits + model["offset"], -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInArrow(tidied(run), f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that the model does not reject, with all their columns.

    The rows travel through the scoring as one struct, so no join is needed and no name can clash.
    """
    model = train_toxicity(docs, labels, id_col, text_col, **options)
    whole = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return score_toxicity(whole, model, "row", "text").filter("predicted = 0").select("row.*")
