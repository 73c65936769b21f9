"""HTML extraction with host suffix arrays.

Each page is read into two streams of words: those of its marked main text (its article, or else its
marked content), and all others. The streams of a host's pages are concatenated; suffix arrays over shards of them, built by prefix doubling to the depth of a long
substring, give the nodes at that depth: substrings with the pages they occur on. Shards' nodes are
merged by their words.

On a page that marks no main text, a substring that two distinct pages of the host have is
boilerplate: blocks mostly covered by such repeats go, unique runs stay. In marked main text a
passage that some pages share may well be theirs (a licence, a quotation, a copied paragraph); there
only substrings on most of the host's distinct texts are boilerplate: notices, slogans and footers
that templates put into the article itself. Menus, forms, notices and the like that markup names go
even if they are unique. Pages are read again for their texts, which costs less than to keep these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, staged, unstage
from .html_blocks import ARTICLE, CONTENT, NEUTRAL, blocks
from .url_filter import url_host

#: Words of a stream that go to a suffix array at once; longer streams are cut with an overlap.
PIECE = 1 << 16
#: The two streams of a page.
OUTSIDE, INSIDE = 0, 1


def kept_level(found: list[tuple[str, int]]) -> int:
    """The zone of the main text: the article if it is marked and no shorter than content around it, else the content."""
    words = {ARTICLE: 0, CONTENT: 0}
    for text, zone in found:
        if zone in words:
            words[zone] += len(text.split())
    return max(words, key=lambda z: (words[z], z)) if any(words.values()) else NEUTRAL


def word_codes(texts: list[str]) -> np.ndarray:
    """A 16-bit hash of each word; substrings of eight words are compared, which have 128 bits together."""
    return np.array([xxhash.xxh32_intdigest(w) & 0xFFFF for t in texts for w in t.split()], np.uint16)


def nodes(tokens: np.ndarray, page: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the suffixes with ``length`` words left on their page, and the nodes' starts in it.

    Prefix doubling: ranks of the first words, of the first two, four and so on up to length.
    """
    rank = np.unique(tokens, return_inverse=True)[1]
    have = 1
    while have < length:
        step = min(have, length - have)
        second = np.zeros_like(rank)
        second[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 1) + second, return_inverse=True)[1]
        have += step
    whole = np.flatnonzero(page[: len(page) - length + 1] == page[length - 1 :]) if len(page) >= length else np.zeros(0, np.int64)
    order = whole[np.argsort(rank[whole], kind="stable")]
    starts = np.flatnonzero(np.diff(rank[order], prepend=-1))
    return order, starts


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str, streams: bool) -> DataFrame:
    """id, url, host, marked, key, blocks, counts, inside, outside, page: one row for each page.

    blocks are those of the main text, or of a page that marks none those that nothing marks (empty
    where a dropped block stood); counts are their words. key stands for the text that is judged:
    equal texts of a host are one. Either the streams are there, once in a task for each text, or
    the blocks.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), F.xxhash64(html).alias("page"), html.alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int, int]] = set()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("marked", "key", "blocks", "counts", "inside", "outside")}
            for html, host, page in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), batch.column("page").to_pylist()):
                found = blocks(html)
                level = kept_level(found)
                marked = level >= CONTENT
                main = [text for text, zone in found if zone == level] if marked else []
                rest = [(text, zone) for text, zone in found if zone < CONTENT]
                key = xxhash.xxh64_intdigest("\n".join(main)) - (1 << 63) if marked else page
                judged = main if marked else [text if zone == NEUTRAL else "" for text, zone in rest]
                counted = main if marked else [text for text, _ in rest]
                codes: list[bytes | None] = [None, None]
                for kind, own, texts in ((INSIDE, key, main), (OUTSIDE, page, [text for text, _ in rest])) if streams else ():
                    if texts and (host, kind, own) not in seen:
                        seen.add((host, kind, own))
                        codes[kind] = word_codes(texts).tobytes()
                if streams:
                    judged, counted = [], []
                for c, value in zip(out, (marked, key, judged, [len(t.split()) for t in counted], codes[INSIDE], codes[OUTSIDE])):
                    out[c].append(value)
            kinds = (pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "url", "host", "page")), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], ["id", "url", "host", "page", *out])

    return rows.mapInArrow(read, f"id {id_type}, url string, host string, page long, marked boolean, key long, blocks array<string>, counts array<int>, inside binary, outside binary")


def repeats(parsed: DataFrame, length: int, shard_words: int, most: float, least_texts: int) -> DataFrame:
    """host, marked, key, at (array): where a boilerplate substring of length words starts in a judged text.

    Outside, that is a substring of two distinct pages; inside main texts, one of ``most`` of the
    host's distinct texts, ``least_texts`` at least. A hot host is dealt into shards of about
    shard_words words. A substring on enough of its texts is, in some shard, on the part of them that
    the shard's share of the host's pieces makes; those of each shard that are become candidates, which
    all the host's shards are then searched for, so they are counted everywhere.
    """
    # Streams outside matter only on hosts with a page that marks nothing.
    unmarked = parsed.filter("NOT marked").select("host").distinct().withColumn("asked", F.lit(True))
    few = unmarked.count() <= 100_000
    sides = parsed.select("host", F.lit(INSIDE).alias("kind"), "key", F.col("inside").alias("words")).union(parsed.join(F.broadcast(unmarked) if few else unmarked, "host", "left_semi").select("host", F.lit(OUTSIDE), "page", "outside"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, starts, parts = [], [], []
            for i, words in enumerate(batch.column("words")):
                codes = np.frombuffer(words.as_buffer(), np.uint16)
                for a in range(0, len(codes) - length + 1, PIECE):
                    of.append(i)
                    starts.append(a)
                    parts.append(codes[a : a + PIECE + length - 1].tobytes())
            taken = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in ("host", "kind", "key")), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], ["host", "kind", "key", "start", "words"])

    pieces = sides.filter("words IS NOT NULL").mapInArrow(cut, "host string, kind int, key long, start long, words binary")
    own = sides.filter("words IS NOT NULL").groupBy("host", "kind", "key").agg(F.sum(F.length("words")).alias("bytes"), F.max(F.length("words") / F.lit(2)).cast("long").alias("n"))
    main = F.col("kind") == INSIDE
    cuts = F.when(main & (F.col("n") >= length), F.floor((F.col("n") - length) / F.lit(PIECE)) + 1).otherwise(0)
    sizes = own.groupBy("host").agg((F.sum("bytes") / F.lit(2 * shard_words)).cast("int").alias("more"), F.sum(main.cast("long")).alias("all_texts"), F.sum(cuts).alias("pieces"))
    sizes = staged(sizes, "host-words")
    few_hosts = sizes.count() <= 100_000
    dealt = pieces.join(F.broadcast(sizes) if few_hosts else sizes, "host").withColumn("shard", F.pmod(F.xxhash64("key", "start"), F.col("more") + 1))

    def node_of(window: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(window.tobytes()) - (1 << 63)

    def kinds_of(group: pd.DataFrame) -> Iterator[tuple]:
        """kind, pieces, nodes' starts, their texts, words, and the keys and places of all their occurrences."""
        for kind, rows in group.drop_duplicates(["kind", "key", "start"]).groupby("kind"):  # copies of a text
            parts = [np.frombuffer(w, np.uint16) for w in rows["words"]]
            counts = np.array([len(p) for p in parts])
            tokens, piece = np.concatenate(parts), np.repeat(np.arange(len(parts)), counts)
            order, starts = nodes(tokens, piece, length)
            if not len(starts):
                continue
            key = rows["key"].to_numpy()[piece[order]]
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            at = order - first[piece[order]] + rows["start"].to_numpy()[piece[order]]
            node = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
            by_key = np.lexsort((key, node))
            new = (np.diff(node[by_key], prepend=-1) != 0) | (np.diff(key[by_key], prepend=0) != 0)
            texts = np.bincount(node[by_key][new], minlength=len(starts))
            yield kind, len(parts), np.append(starts, len(order)), texts, np.lib.stride_tricks.sliding_window_view(tokens, length)[order[starts]], key, at

    def frame(group: pd.DataFrame, found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=["kind", "node", "whole", "keys", "at"])
        out.insert(0, "host", pd.Series([group["host"].iloc[0]] * len(out), dtype=object))
        return out

    def build(group: pd.DataFrame) -> pd.DataFrame:
        more, all_texts, pieces = (int(group[c].iloc[0]) for c in ("more", "all_texts", "pieces"))
        found = []
        for kind, n, starts, texts, windows, key, at in kinds_of(group):
            if kind == INSIDE:  # the rounding of a product never costs a candidate
                wanted = np.flatnonzero(texts * pieces >= max(least_texts, all_texts * most) * n * (1 - 1e-9))
            else:
                # A host of one shard is judged here; nodes of one page may go on in other shards else.
                wanted = np.flatnonzero(texts > 1) if more == 0 else np.arange(len(starts) - 1)
            none = np.zeros(0, np.int64)
            named = kind == INSIDE and more > 0  # its places are looked up in all shards
            found += [(kind, node_of(windows[i]), more == 0, none if named else key[starts[i] : starts[i + 1]], none if named else at[starts[i] : starts[i + 1]]) for i in wanted]
        return frame(group, found)

    def search(group: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        asked, found = set(candidates["node"].tolist()), []
        for kind, _, starts, _, windows, key, at in kinds_of(group) if asked and len(group) else ():
            for i, window in enumerate(windows):
                if (node := node_of(window)) in asked:
                    found.append((kind, node, False, key[starts[i] : starts[i + 1]], at[starts[i] : starts[i + 1]]))
        return frame(group if len(group) else candidates, found)

    shape = "host string, kind int, node long, whole boolean, keys array<long>, at array<long>"
    shards = staged(dealt.groupBy("host", "shard").applyInPandas(build, shape), "suffix-nodes")
    candidates = staged(shards.filter((F.col("kind") == INSIDE) & ~F.col("whole")).select("host", "node").distinct(), "candidates")
    known = shards.filter(F.size("keys") > 0)
    if not candidates.isEmpty():
        asked = candidates.join(sizes, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("shard"), "node")
        hosts = candidates.select("host").distinct()
        texts = dealt.filter(main).join(F.broadcast(hosts) if few_hosts else hosts, "host", "left_semi")
        looked_up = staged(texts.groupBy("host", "shard").cogroup(asked.groupBy("host", "shard")).applyInPandas(search, shape), "candidate-places")
        known = known.unionByName(looked_up)
    node = ["host", "kind", "node"]
    # Pieces of one text may lie in several shards: texts are counted by their keys.
    inside = known.filter(main).select(*node, F.explode(F.array_distinct("keys")).alias("key")).distinct().groupBy(*node).agg(F.count(F.lit(1)).alias("texts"))
    inside = inside.join(sizes, "host").filter(F.col("texts") >= F.greatest(F.lit(least_texts), F.col("all_texts") * most)).select(*node)
    outside = known.filter(~main).groupBy(*node).agg(F.min(F.array_min("keys")).alias("x"), F.max(F.array_max("keys")).alias("y")).filter("x <> y").select(*node)
    places = known.join(inside.unionByName(outside), node).select("host", main.alias("marked"), F.explode(F.arrays_zip("keys", "at")).alias("p"))
    spans = places.groupBy("host", "marked", F.col("p.keys").alias("key")).agg(F.collect_list("p.at").alias("at"))
    judged = parsed.filter("NOT marked").select("host", "marked", "key").distinct()
    out = staged(spans.filter("marked").unionByName(spans.filter("NOT marked").join(judged, ["host", "marked", "key"], "left_semi")), "page-repeats")
    for done in (shards, sizes, *([] if candidates.isEmpty() else [looked_up]), candidates):
        unstage(done)
    return out


def covered_words(total: int, starts: np.ndarray | None, length: int) -> np.ndarray:
    """Which of a stream's words the repeats cover."""
    edge = np.zeros(total + 1, np.int64)
    if starts is not None:
        starts = np.unique(starts)
        edge[starts] += 1
        np.subtract.at(edge, np.minimum(starts + length, total), 1)
    return np.cumsum(edge)[:-1] > 0


def extract_main_text(pages: DataFrame, length: int = 8, share: float = 0.5, most: float = 0.5, least_texts: int = 8, shard_words: int = 1 << 17, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars, n_removed: one row for each page.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by a line feed. Kept are the blocks of the article, of marked content, or of a page that
    marks neither all that no markup drops, but for those that boilerplate covers by ``share`` of
    their words: on unmarked pages substrings of ``length`` words on two distinct pages of the host, in
    marked main text those of more than ``most`` of its distinct texts and of ``least_texts``.
    n_removed counts words of blocks that went for that. Null html is an empty page with an empty
    text; pages without a host share the empty one. Repeated rows and copies of a text on a host count
    once. Very long pages are cut into pieces that overlap. Ids are only carried along, other columns
    not looked at. An empty table gives an empty result.
    """
    found = staged(parsed_pages(pages, id_col, url_col, html_col, True).select("host", "page", "marked", "key", "inside", "outside"), "page-streams", "zstd")
    spans = repeats(found, length, shard_words, most, least_texts)
    unstage(found)
    rows = parsed_pages(pages, id_col, url_col, html_col, False).select("id", "url", "host", "marked", "key", "blocks", "counts")
    id_type = rows.schema["id"].dataType.simpleString()
    # The spans of few pages are looked up where the page is; more of them meet by a shuffle.
    words = spans.agg(F.coalesce(F.sum(F.size("at") + 8), F.lit(0))).first()[0]
    keys = ["host", "marked", "key"]
    joined = rows.join(F.broadcast(spans), keys, "left") if words <= 1_000_000 else spread_join(staged(rows, "page-blocks", "zstd"), spans, keys, "left")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for own, counts, at in zip(batch.column("blocks").to_pylist(), batch.column("counts").to_pylist(), batch.column("at")):
                gone = 0
                if at.is_valid:
                    hit = covered_words(sum(counts), at.values.to_numpy(), length)
                    ends = np.cumsum([0, *counts])
                    covered = [bool(t) and hit[a:b].mean() >= share for t, a, b in zip(own, ends, ends[1:])]
                    gone = sum(n for n, c in zip(counts, covered) if c)
                    own = [t for t, c in zip(own, covered) if not c]
                texts.append("\n".join(t for t in own if t))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64())], ["id", "url", "text", "n_chars", "n_removed"])

    found = joined.select("id", "url", "blocks", "counts", "at").mapInArrow(judge, f"id {id_type}, url string, text string, n_chars long, n_removed long")
    return found.toDF(id_col, "url", "text", "n_chars", "n_removed")
