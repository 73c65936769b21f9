"""SimHash near-dedup with BK-trees.

Each text's word shingles are hashed and each bit of its fingerprint is the majority of theirs.
Distinct fingerprints are dealt into shards that agree on chosen bits, each shard's BK-tree (children
keyed by their Hamming distance to the parent) is searched within the radius, and the links found
join fingerprints to components.

Fingerprints only estimate how many shingles two texts have in common. ``similar_texts`` therefore
takes what its trees find as candidates, and a link is a pair whose sets of shingles are as similar
as asked for.

Trees of all fingerprints would grow with the corpus, so they are not broadcast: a shuffle brings
each shard's fingerprints to its tree. With ``exact_shards`` two fingerprints within the radius meet
in a shard for certain, by the pigeonhole principle; ``sampled_shards`` serve radii too wide for that.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, spread_join, staged, tidied, unstage

SEED = 42
#: Odd multipliers that turn one shingle hash into further independent ones (fixed values).
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of a lower-cased text; of the whole text if it has fewer words."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    at = [0, *accumulate(len(w) + 1 for w in found)]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(at, at[words:])]), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray, width: int = 64) -> bytes:
    """A bit is set if more than half of the hashes have it; highest bit first. No hashes: zero."""
    n = len(hashes)
    if not n:
        return bytes(width // 8)
    wide = [hashes]
    for m in MULTIPLIERS[: width // 64 - 1]:
        x = (hashes ^ (hashes >> np.uint64(29)) ^ m) * m
        x = (x ^ (x >> np.uint64(32))) * MULTIPLIERS[1]
        wide.append(x ^ (x >> np.uint64(29)))
    raw = np.stack(wide, 1).astype(">u8").view(np.uint8)
    # Bits become bytes, and eight byte counters are added at once; 255 rows cannot overflow one.
    rows = -(-n // 255) * 255
    bits = np.zeros((rows, width), np.uint8)
    bits[:n] = np.unpackbits(raw, axis=1)
    parts = bits.view(np.uint64).reshape(rows // 255, 255, width // 8).sum(1)
    counts = parts.view(np.uint8).reshape(-1, width).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def exact_shards(width: int, radius: int) -> list[list[int]]:
    """Bits of pairs of blocks, of which at least one pair agrees within the radius."""
    edges = [round(i * width / (radius + 2)) for i in range(radius + 3)]
    blocks = [list(range(a, b)) for a, b in zip(edges, edges[1:])]
    return [a + b for a, b in combinations(blocks, 2)]


def sampled_shards(width: int, bits: int, shards: int, seed: int = 1) -> list[list[int]]:
    """Random choices of bits; two fingerprints at distance d meet in one with chance (1 - d / width) ** bits."""
    draw = random.Random(seed)
    return [draw.sample(range(width), bits) for _ in range(shards)]


class BKTree:
    """Integers by Hamming distance."""

    def __init__(self, root: int):
        self.root, self.children = root, {root: {}}

    def add(self, x: int) -> None:
        v = self.root
        while d := (v ^ x).bit_count():
            kids = self.children[v]
            if d not in kids:
                kids[d] = x
                self.children[x] = {}
                return
            v = kids[d]

    def near(self, x: int, radius: int) -> Iterator[tuple[int, int]]:
        """(distance, member) of each member within the radius."""
        stack = [self.root]
        while stack:
            v = stack.pop()
            d = (v ^ x).bit_count()
            if d <= radius:
                yield d, v
            for k, kid in self.children[v].items():
                if d - radius <= k <= d + radius:
                    stack.append(kid)

    def within(self, x: int, radius: int) -> Iterator[int]:
        return (v for _, v in self.near(x, radius))


class Clusters:
    """Components of the integers added, linked within the radius.

    Unlinked ones share a tree; each larger component has its own, and a search of it ends at the
    first hit, so a dense group of near copies costs about one comparison for each.
    """

    def __init__(self, radius: int):
        self.radius, self.loose, self.gone, self.groups = radius, None, set(), []

    def add(self, x: int, keep: bool = True) -> None:
        """keep: whether later ones are to be compared with x."""
        hits = [g for g in self.groups if next(g.within(x, self.radius), None) is not None]
        near = [v for v in self.loose.within(x, self.radius) if v not in self.gone] if self.loose else []
        if not hits and not near:
            if keep and self.loose:
                self.loose.add(x)
            elif keep:
                self.loose = BKTree(x)
            return
        home = max(hits, key=lambda g: len(g.children)) if hits else BKTree(x)
        for other in hits:
            if other is not home:
                for v in other.children:
                    home.add(v)
                self.groups.remove(other)
        if not hits:
            self.groups.append(home)
        for v in near:
            home.add(v)
            self.gone.add(v)
        home.add(x)

    def stars(self) -> Iterator[tuple[int, int]]:
        """Each member of a component with its smallest member."""
        for g in self.groups:
            least = min(g.children)
            for v in g.children:
                if v != least:
                    yield v, least


def fingerprints(docs: DataFrame, words: int, width: int, id_col: str, text_col: str, sets: bool = False) -> DataFrame:
    """doc_id, text_hash, fingerprint (binary) of each row; with sets also shingles, sorted 32-bit hashes."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in chunks(texts):
                hashes = [shingle_hashes(t, words) for t in texts[a:b]]
                columns = [batch.column("doc_id")[a:b], batch.column("text_hash")[a:b], pa.array([fingerprint(h, width) for h in hashes], pa.binary())]
                if sets:
                    columns.append(pa.array([np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in hashes], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fingerprint", "shingles"][: len(columns)])

    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return read.mapInArrow(tidied(run), f"doc_id {id_type}, text_hash long, fingerprint binary" + ", shingles binary" * sets)


def near_links(prints: DataFrame, width: int, radius: int, shards: list[list[int]], tree_size: int = 100_000) -> DataFrame:
    """a, b: links that join all distinct fingerprints within the radius that meet in a shard.

    A shard gives at most one link for each of its fingerprints, which joins the same components as
    all its pairs would. A shard of more than tree_size fingerprints is split into trees of about
    that size, and all its fingerprints are searched for in each of them.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fingerprint")
            bits = np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width // 8), axis=1).astype(np.int64)
            for i, mask in enumerate(shards):
                key = bits[:, mask] @ (np.int64(1) << np.arange(len(mask), dtype=np.int64)) + (np.int64(i) << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key), column], ["shard", "fingerprint"])

    dealt = prints.select("fingerprint").distinct().mapInArrow(keys, "shard long, fingerprint binary")
    hot = dealt.groupBy("shard").count().filter(F.col("count") > tree_size).select("shard", F.ceil(F.col("count") / tree_size).cast("int").alias("trees"))
    hot = staged(hot, "hot-shards")
    if hot.isEmpty():
        placed = dealt.select("shard", F.lit(0).alias("tree"), F.lit(True).alias("member"), "fingerprint")
    else:
        split = dealt.join(hot, "shard", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
        home = F.pmod(F.xxhash64("fingerprint"), F.col("trees"))
        placed = split.select("shard", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), home.alias("home"), "fingerprint").select("shard", "tree", (F.col("tree") == F.col("home")).alias("member"), "fingerprint")
    grouped = placed.repartition("shard", "tree").sortWithinPartitions("shard", "tree", F.desc("member"))

    def solve(group: list[tuple[bytes, bool]]) -> list[tuple[bytes, bytes]]:
        found = Clusters(radius)
        for raw, member in group:
            found.add(int.from_bytes(raw, "big"), member)
        return [(a.to_bytes(width // 8, "big"), b.to_bytes(width // 8, "big")) for a, b in found.stars()]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            links: list[tuple[bytes, bytes]] = []
            shard, tree = batch.column("shard").to_numpy(), batch.column("tree").to_numpy()
            cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (tree[1:] != tree[:-1])) + 1).tolist(), len(shard)]
            raw, member = batch.column("fingerprint").to_pylist(), batch.column("member").to_pylist()
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key = (shard[a], tree[a])
                if key != now:
                    if len(group) > 1:
                        links += solve(group)
                    now, group = key, []
                group += zip(raw[a:b], member[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], ["a", "b"])
        if len(group) > 1:
            links = solve(group)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], ["a", "b"])

    return grouped.mapInArrow(tidied(link), "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches. Alternates large and small stars.

    Each round joins an edge to the least neighbour of its end; minima are pre-aggregated, and a hot
    end's edges are only ever joined with one row, so no group has to fit one task.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("x"), F.col("m").alias("y")).union(least.select("u", "m"))
        small = small.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
        now = staged(small, "stars")
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        unstage(edges)
        edges = now
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, words: int = 3, width: int = 64, radius: int = 2, shards: list[list[int]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fingerprint, component_id: one row for each input row.

    component_id is the smallest id among the rows reachable over links of at most radius differing
    bits; null ids count last, and a component of null ids alone has null. Texts without words, null
    ones too, have fingerprint zero and are linked like any other. Equal texts share a fingerprint,
    so copies, repeated rows among them, meet before any tree is built. An empty table gives an
    empty result; other columns are not looked at.
    """
    prints = staged(fingerprints(docs, words, width, id_col, text_col), "fingerprints")
    return _components_of(prints, components(near_links(prints, width, radius, shards or exact_shards(width, radius))))


def _components_of(prints: DataFrame, found: DataFrame) -> DataFrame:
    """prints with component_id, from the root of each linked fingerprint."""
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"))
    rooted = staged(least.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")), "fingerprint-roots")
    of_root = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = spread_join(rooted, of_root, ["root"]).select("fingerprint", "component_id")
    return spread_join(prints.select("doc_id", "text_hash", "fingerprint"), classes, ["fingerprint"]).select("doc_id", "text_hash", "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of each component's keeper, with all columns.

    The keeper has the smallest id, then the smallest text hash. Rows with one id and one text are
    one document: they stay or go together. Components without any id keep one text.
    """
    return _keepers(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)


def _keepers(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # Null ids form components by their roots' fingerprints only if no id is there to name them.
    marked = staged(marked.withColumn("no_id", F.when(F.col("component_id").isNull(), F.col("fingerprint"))).withColumn("group", F.xxhash64(F.coalesce(F.col("component_id").cast("string"), F.lit("")), "no_id")), "near-classes")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    found = marked.groupBy("group", F.col("component_id").alias("c"), F.col("no_id").alias("f")).agg(F.min(place).alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keepers = found.select(F.struct("c", "f", F.col("keeper").getField("doc_id").alias("keep_id"), F.col("keeper").getField("text_hash").alias("keep_hash")).alias("keeper"), "group")
    # Groups are joined by a hash; those of one hash are told apart afterwards.
    keepers = keepers.groupBy("group").agg(F.collect_list("keeper").alias("keepers"))
    joined = spread_join(marked, keepers, ["group"])
    own = F.element_at(F.filter("keepers", lambda k: k["c"].eqNullSafe(F.col("component_id")) & k["f"].eqNullSafe(F.col("no_id"))), 1)
    judged = joined.select("doc_id", "text_hash", F.when(F.size("keepers") == 1, F.col("keepers")[0]).otherwise(own).alias("k"))
    dropped = judged.filter(~(F.col("doc_id").eqNullSafe(F.col("k.keep_id")) & (F.col("text_hash") == F.col("k.keep_hash"))))
    dropped = dropped.select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_hash"))
    on = F.col("row_id").eqNullSafe(F.col("drop_id")) & (F.col("row_hash") == F.col("drop_hash"))
    return rows.join(dropped, on, "left_anti").select("row.*")


def similar_radius(similarity: float, width: int, deviations: float = 0.0) -> int:
    """Differing bits that texts with this share of common shingles (Jaccard) have on average, and
    so many standard deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(width * share + deviations * math.sqrt(width * share * (1 - share)))


def _places(links: DataFrame) -> DataFrame:
    """node, root: as components(links), for links that many shards repeat between the members of one group.

    One link of each fingerprint joins most of a group, and the others are then links between classes.
    """
    links = staged(links, "near-links")
    first = staged(components(links.groupBy("a").agg(F.min("b").alias("b"))), "near-roots")
    ends = links
    for end in ("a", "b"):
        ends = spread_join(ends, first.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), [end], "left")
        ends = staged(ends.withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root").filter("a <> b").distinct(), "root-links")
    found = components(ends.union(first.select("node", "root")))
    unstage(links)
    return found


def _dealt(members: DataFrame, turn: int, most: int, most_bytes: int, whole: bool) -> DataFrame:
    """place, x, y, block, fingerprint, root, shingles: members dealt into cells (place, x, y).

    members: place, fingerprint, root, shingles. A place of more than ``most`` members or ``most_bytes``
    of shingles is split into blocks, which ``turn`` draws. Without ``whole`` each block is a cell. With
    it there is a cell for any two blocks, so that any two members meet; only those of the largest
    class, whose blocks have negative numbers, do not meet each other.
    """
    of_class = members.groupBy("place", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("size"))
    of_place = of_class.groupBy("place").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("home"))
    parts = lambda n, size: F.greatest(F.ceil(F.greatest(n / most, size / most_bytes)), F.lit(1)).cast("int")
    several = of_place.filter("classes > 1").select("place", F.col("home.root").alias("home"), parts(F.col("n"), F.col("size")).alias("all"), parts(F.col("home.n"), F.col("home.size")).alias("homes"), parts(F.col("n") - F.col("home.n"), F.col("size") - F.col("home.size")).alias("others"))
    rows = spread_join(members, several, ["place"])
    draw = F.xxhash64(F.lit(turn), "fingerprint")
    if not whole:
        block = F.pmod(draw, F.col("all")).cast("int")
        return rows.select("place", block.alias("x"), block.alias("y"), block.alias("block"), "fingerprint", "root", "shingles")
    one, at_home = F.col("all") == 1, F.col("root") == F.col("home")
    rows = rows.withColumn("block", F.when(one, 0).when(at_home, -1 - F.pmod(draw, F.col("homes"))).otherwise(F.pmod(draw, F.col("others"))).cast("int"))
    first = F.when(one, F.lit(0)).when(at_home, F.lit(0)).otherwise(-F.col("homes"))
    last = F.when(one, F.lit(0)).otherwise(F.col("others") - 1)
    met = rows.withColumn("met", F.explode(F.sequence(first, last)))
    return met.select("place", F.least("block", "met").alias("x"), F.greatest("block", "met").alias("y"), "block", "fingerprint", "root", "shingles")


def similar_links(dealt: DataFrame, similarity: float, radius: int) -> DataFrame:
    """a, b: links that join all members of a cell whose fingerprints are within the radius and whose
    sets of shingles have the share ``similarity`` of all their shingles in common.

    dealt: as _dealt gives it. Members of one block are compared in the cell of that block alone.
    """

    def judge(cell: pa.Table) -> pa.Table:
        raw = cell.column("fingerprint").to_pylist()
        bits = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)
        sets = [np.frombuffer(s, np.uint32) for s in cell.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        of = np.unique(np.array(cell.column("root").to_pylist(), object), return_inverse=True)[1]
        block = cell.column("block").to_numpy()
        alone = cell.column("x")[0].as_py() == cell.column("y")[0].as_py()
        found = []
        for i in range(1, len(raw)):
            near = np.bitwise_count(bits[:i] ^ bits[i]).sum(1) <= radius
            near &= (of[:i] != of[i]) & (np.minimum(sizes[:i], sizes[i]) >= similarity * np.maximum(sizes[:i], sizes[i]))
            for j in np.flatnonzero(near if alone else near & (block[:i] != block[i])).tolist():
                if of[j] != of[i]:
                    common = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                    if common > 0 and common >= similarity * (sizes[i] + sizes[j] - common):
                        found.append((raw[j], raw[i]))
                        of[of == of[j]] = of[i]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return dealt.groupBy("place", "x", "y").applyInArrow(judge, "a binary, b binary")


def similar_texts(docs: DataFrame, similarity: float = 0.8, words: int = 5, width: int = 256, deviations: float = 2.0, key_bits: int = 18, shards: int = 64, id_col: str = "doc_id", text_col: str = "text", most: int = 64, most_bytes: int = 1 << 23) -> DataFrame:
    """doc_id, text_hash, fingerprint, component_id: as near_duplicates, with links by the texts' shingles.

    A link is a pair with at least ``similarity`` of its word shingles in common (Jaccard). Candidates
    are fingerprints within the bits that such texts have on average and ``deviations`` more, which
    meet in one of ``shards`` shards: at distance d with chance 1 - (1 - (1 - d / width) ** key_bits) **
    shards. Candidates, joined to components, make places, and all pairs within the radius in a place
    are judged: in two deals of its members into cells of about ``most``, which join dense groups to
    classes, and then between all cells for what is of different classes yet. So pairs are never rows.
    Larger corpora need longer keys, and more shards to keep that chance. Empty texts are equal.
    """
    radius, masks = similar_radius(similarity, width, deviations), sampled_shards(width, key_bits, shards)
    prints = staged(fingerprints(docs, words, width, id_col, text_col, sets=True), "fingerprints")
    near = _places(near_links(prints, width, radius, masks))
    near = staged(near.union(near.select("root", "root").distinct()).select(F.col("node").alias("fingerprint"), F.col("root").alias("place")), "places")
    few = near.count() <= 1_000_000
    wanted = prints.select("fingerprint", "shingles").join(F.broadcast(near.select("fingerprint")) if few else near.select("fingerprint"), "fingerprint", "left_semi")  # at most 32 bytes for each
    sets = wanted.groupBy("fingerprint").agg(F.min("shingles").alias("shingles"))
    members = staged(near.join(sets, "fingerprint").select("place", "fingerprint", "shingles"), "near-members")
    unstage(near)
    roots = None
    for turn, whole in enumerate((False, False, True)):
        root = F.col("fingerprint").alias("root")
        classes = members.select("*", root) if roots is None else members.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("place", "fingerprint", "shingles", F.coalesce("root", "fingerprint").alias("root"))
        classes = staged(classes, "near-members")
        links = staged(similar_links(_dealt(classes, turn, most, most_bytes, whole), similarity, radius), "similar-links")
        if roots is None or not links.isEmpty():
            roots = components(links if roots is None else links.union(roots.select("node", "root")))
        unstage(classes)
        unstage(links)
    unstage(members)
    return _components_of(prints, roots)


def drop_similar(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """drop_near_duplicates with the components of similar_texts."""
    return _keepers(docs, similar_texts(docs, similarity, id_col=id_col, text_col=text_col, **options), id_col, text_col)
