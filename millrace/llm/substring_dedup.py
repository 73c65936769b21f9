"""Substring dedup with prefix-partitioned suffix trees over words.

A word is removed if a window of ``window`` consecutive words that covers it occurs more than once.
Equal windows have their least hashed ``prefix``-gram at the same place, so only suffixes that start
at such an anchor need to be looked at: about one word in fourteen. Anchors whose gram occurs once
are dropped by a count. The rest are reduced to distinct contexts, the words that any window over
the anchor can have, and are dealt out by a prefix that grows until a group fits a tree: it begins as
the gram, which all windows over the anchor share. A group of more than ``tree_size`` contexts is
split in two by how many words of the window lie left of the anchor; the windows of either half share
more words, and these are its longer prefix. After at most five splits it is a whole window.

A tree holds the contexts' suffixes to the right of their anchors; another holds the words to the
left, backwards. Both are kept as sorted suffixes with the lengths of their common prefixes, which
is a suffix tree without its pointers: a node at depth d is a run in which those reach d. A window
with o words to the left of its anchor occurs again if another suffix shares both its node at depth
window - o and its node at depth o in the tree of the left sides. A group whose prefix is a whole
window is one node: it occurs as often as its contexts do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, chunks, spread_join, staged, unstage

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE_CODES = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
BASES = {"bytes": 0x9E3779B97F4A7C15 | 1, "words": 0xC2B2AE3D27D4EB4F | 1}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i up to n."""
    if kind not in _powers or len(_powers[kind][0]) <= n:
        size = max(CHUNK + 4096, n + 1)
        base = BASES[kind]
        _powers[kind] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[kind]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of several texts: hashes, the text of each, and hashes of any run of words."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        space = SPACE[data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
        start, end = edge[0::2], edge[1::2]
        power, inverse = _power("bytes", len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * power[: len(data)])])
        self.hash = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(start, text_ends)])  # of each text, and one more
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.n)
        power, self.inverse = _power("words", len(start))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * power[: len(start)])])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words from start to before end, for each pair."""
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def anchors_of(words: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which an anchor starts, in order, and their grams' hashes."""
    total = len(words.hash)
    if total < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(total - prefix + 1)
    grams = words.runs(at, at + prefix)
    starts = np.flatnonzero(words.text[: total - window + 1] == words.text[window - 1 :])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - prefix + 1)
    found = np.unique(starts + views[starts].argmin(1)) if len(starts) < total // 2 else np.unique(starts + views.argmin(1)[starts])
    return found, grams[found]


def repeated_windows(grams: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, count: np.ndarray, window: int, low: np.ndarray | int = 0, high: np.ndarray | int = 64) -> np.ndarray:
    """For each context a bit mask: bit o if the window with o words left of the anchor occurs again.

    left: words before the anchor, nearest first; right: from the anchor on; zero beyond a text's
    ends. count: how often the context occurs. Contexts are distinct for a gram, or any other prefix
    that stands for their group. low, high: the least and greatest o that is looked at.
    """

    def tree(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted suffixes' order and the length that each shares with the one before."""
        flat = np.ascontiguousarray(sides.astype(">u8")).view(f"S{sides.shape[1] * 8}")[:, 0]
        order = np.argsort(flat, kind="stable")
        ranked = sides[order]
        same = np.logical_and.accumulate(ranked[1:] == ranked[:-1], axis=1).sum(1)
        return order, np.concatenate([[0], same])

    def nodes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(shared < depth)
        return node

    by_right, by_left = tree(right), tree(np.concatenate([grams[:, None], left], 1))
    mask = np.zeros(len(grams), np.int64)
    for o in range(left.shape[1] + 1):
        fits = (n_left >= o) & (n_right >= window - o) & (low <= o) & (o <= high)
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        pair = nodes(*by_right, window - o)[at] * (len(grams) + 1) + nodes(*by_left, o + 1)[at]
        _, inverse = np.unique(pair, return_inverse=True)
        often = np.bincount(inverse, weights=count[at]) > 1
        mask[at[often[inverse]]] |= 1 << o
    return mask


def _keyed(text: Column) -> list[Column]:
    """Two hashes of a text, 128 bits together, that stand for it."""
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def covered_words(docs: DataFrame, window: int = 35, prefix: int = 8, tree_size: int = 20_000, text_col: str = "text") -> DataFrame:
    """k1, k2, spans (array of start, mask): what is repeated in each distinct text that has repeats."""
    reach = window - prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(*_keyed(text), text.alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                at, grams = anchors_of(words, window, prefix)
                of = words.text[at]
                first, last = words.first[of], words.first[of + 1]
                begin, end = np.maximum(first, at - reach), np.minimum(last, at + window)
                context = _mix(words.runs(begin, end) + (at - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([_signed(grams), _signed(context), pa.array(k1[a:b][of]), pa.array(k2[a:b][of]), pa.array((at - first).astype(np.int32))], ["gram", "context", "k1", "k2", "pos"])

    anchors = staged(keyed.mapInArrow(find, "gram long, context long, k1 long, k2 long, pos int"), "anchors")
    often = staged(anchors.groupBy("gram").count().filter("count > 1"), "repeated-grams")
    found = spread_join(anchors, often.select("gram"), ["gram"], counts=often).groupBy("gram", "context", "k1", "k2", "pos").agg(F.count(F.lit(1)).alias("n"))
    found = staged(found, "repeated-anchors")
    unstage(anchors)

    contexts = staged(found.groupBy("gram", "context").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("one"), F.count(F.lit(1)).alias("places")), "contexts")
    variants = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("variants"))
    varied = spread_join(contexts, variants, ["gram"])
    every = (1 << (reach + 1)) - 1
    alone = varied.filter("variants = 1").select("gram", "context", F.lit(every).cast("long").alias("mask"))

    wanted = varied.filter("variants > 1").groupBy(F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2")).agg(F.collect_list(F.struct("gram", "context", "n", F.col("one.pos").alias("pos"), (F.col("variants") > tree_size).alias("crowded"))).alias("wanted"))
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    shape = "prefix long, low int, high int, gram long, context long, n long, crowded boolean, n_left int, n_right int, left binary, right binary"
    names = [part.split()[0] for part in shape.split(", ")]
    pack = lambda x: pa.array([r.tobytes() for r in x], pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words around each wanted anchor."""
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for i, t in enumerate(texts):
                words = Words([t])
                asked = batch.column("wanted")[i].values
                at = asked.field("pos").to_numpy().astype(np.int64)
                total = len(words.hash)
                padded = np.concatenate([np.zeros(reach, np.uint64), words.hash, np.zeros(window, np.uint64)])
                left = padded[(at + reach - 1)[:, None] - np.arange(reach)]
                right = padded[(at + reach)[:, None] + np.arange(window)]
                n_left, n_right = np.minimum(at, reach), np.minimum(total - at, window)
                whole = [pa.array(np.full(len(at), x, np.int32)) for x in (0, reach)]
                yield pa.RecordBatch.from_arrays([asked.field("gram"), *whole, *(asked.field(c) for c in ("gram", "context", "n", "crowded")), pa.array(n_left.astype(np.int32)), pa.array(n_right.astype(np.int32)), pack(left), pack(right)], names)

    def sides(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, w) for c, w in (("left", reach), ("right", window)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each context in either half of its windows, if it has all words that those share."""
        power = _power("words", reach + window)[0]
        for batch in batches:
            low, high = (batch.column(c).to_numpy() for c in ("low", "high"))
            n_left, n_right = (batch.column(c).to_numpy() for c in ("n_left", "n_right"))
            left, right = sides(batch)
            line = np.concatenate([left[:, ::-1], right], 1)
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                own = np.flatnonzero((n_left >= a) & (n_right >= window - b))
                a, b = a[own], b[own]
                at = np.arange(reach + window)
                shared = (at >= (reach - a)[:, None]) & (at < (reach + window - b)[:, None])
                prefix = _mix((np.where(shared, line[own], np.uint64(0)) * power[: reach + window]).sum(1, dtype=np.uint64) + (a * 64 + b).astype(np.uint64))
                rest = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([_signed(prefix), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *(rest.column(c) for c in names[3:])], names)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees over whole groups: a batch's last group waits for the next batch."""
        rest: pa.Table | None = None

        def solve(t: pa.Table) -> pa.RecordBatch:
            number = lambda c: t.column(c).to_numpy()
            mask = repeated_windows(number("prefix").view(np.uint64), *sides(t), number("n_left"), number("n_right"), number("n"), window, number("low"), number("high"))
            return pa.RecordBatch.from_arrays([pa.array(number("gram")), pa.array(number("context")), pa.array(mask)], ["gram", "context", "mask"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            prefix = table.column("prefix").to_numpy()
            whole = int(np.searchsorted(prefix, prefix[-1])) if len(prefix) else 0
            if whole:
                yield solve(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and len(rest):
            yield solve(rest)

    groups = staged(texts.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(cut, shape), "contexts-by-prefix")
    used, masks = [groups], alone
    while True:
        trees = groups.filter("NOT crowded").repartition("prefix").sortWithinPartitions("prefix")
        masks = masks.unionByName(trees.mapInArrow(grow, "gram long, context long, mask long"))
        crowded = groups.filter("crowded")
        if crowded.isEmpty():
            break
        halves = staged(crowded.mapInArrow(split, shape).drop("crowded"), "split-contexts")
        sizes = halves.groupBy("prefix").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("all"))
        sized = spread_join(halves, sizes, ["prefix"])
        # A prefix that is a whole window needs no tree, however many contexts have it.
        whole = F.col("low") == F.col("high")
        masks = masks.unionByName(sized.filter(whole & (F.col("all") > 1)).select("gram", "context", F.expr("shiftleft(1L, low)").alias("mask")))
        groups = staged(sized.filter(~whole & (F.col("all") > 1)).withColumn("crowded", F.col("contexts") > tree_size).select(*names), "contexts-by-prefix")
        used += [halves, groups]

    masks = staged(masks.groupBy("gram", "context").agg(F.bit_or("mask").alias("mask")).filter("mask <> 0"), "repeated-windows")
    places = contexts.select("gram", "context", F.col("places").alias("count"))
    spans = staged(spread_join(found, masks, ["gram", "context"], counts=places).groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "mask")).alias("spans")), "repeated-spans")
    for done in (*used, found, contexts, often, masks):
        unstage(done)
    return spans


def removed_words(n_words: int, pos: np.ndarray, mask: np.ndarray, window: int, reach: int) -> np.ndarray:
    """Which words the repeated windows cover; windows that would leave the text do not exist."""
    edge = np.zeros(n_words + 1, np.int64)
    o = np.arange(reach + 1)
    start = pos[:, None].astype(np.int64) - o
    there = ((mask[:, None] >> o) & 1).astype(bool) & (start >= 0) & (start + window <= n_words)
    starts = np.unique(start[there])
    edge[starts] += 1
    edge[starts + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def drop_repeats(docs: DataFrame, window: int = 35, prefix: int = 8, tree_size: int = 20_000, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text): one row for each input row.

    Every word covered by a window of ``window`` words that also starts elsewhere, in the same text
    or another, is removed; windows are judged on the input. Kept words are joined by one space.
    Null and empty texts have no words. Repeated rows and copies are elsewhere to each other. Ids are
    only carried along; other columns are not looked at. An empty table gives an empty result.
    """
    reach = window - prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(*_keyed(text), text.alias("text"))
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    spans = covered_words(docs, window, prefix, tree_size, text_col)
    kinds = "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, t in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = t.split()
                kept = words
                if batch.column("spans")[i].is_valid:
                    asked = batch.column("spans")[i].values
                    gone = removed_words(len(words), asked.field("pos").to_numpy(), asked.field("mask").to_numpy(), window, reach)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                line = b" ".join(kept)
                for column, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(), line.decode("utf-8", "replace") if with_text else None)):
                    column.append(value)
            columns = [batch.column("k1"), batch.column("k2"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            names = ["k1", "k2", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(out[3], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    judged = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "text", "spans").mapInArrow(judge, kinds)
    rows = staged(docs.select(F.col(id_col).alias("id"), *_keyed(text)), "row-keys")
    result = spread_join(rows, judged, ["k1", "k2"])
    return result.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text)
