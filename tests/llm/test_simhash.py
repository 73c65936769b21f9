import random
import re

import pytest
import xxhash
from helpers import edge_docs, edge_texts, prose, words

from millrace.llm.simhash import BKTree, components, drop_near_duplicates, drop_similar, near_duplicates, near_links, similar_radius, similar_texts


def own_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    prints = [own_fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    of = roots(len(rows), linked)
    least = {}
    for (d, _), r in zip(rows, of):
        least[r] = min(x for x in (least.get(r), d) if x is not None) if (least.get(r), d) != (None, None) else None
    return sorted(((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, of)), key=str)


def result(df):
    return sorted(((r.doc_id, bytes(r.fingerprint).hex(), r.component_id) for r in near_duplicates(df).collect()), key=str)


def test_edges(spark):
    docs = edge_docs(spark)
    assert result(docs) == brute(edge_texts())
    assert near_duplicates(docs.limit(0)).count() == 0
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert drop_near_duplicates(docs.limit(0)).count() == 0


def test_chains_of_copies(spark):
    rows = []
    for g in range(6):
        w = prose(g, 300).split()
        for i in range(25):
            w[(i * 11) % 300] = f"edit{i}"
            rows.append((g * 100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert result(df) == want
    assert sorted(r.doc_id for r in drop_near_duplicates(df).collect()) == sorted({c for *_, c in want})


@pytest.mark.parametrize("tree_size", [3, 1000])
def test_links_join_all_within_radius(spark, tree_size):
    draw = random.Random(4)
    values = set()
    for _ in range(15):
        x = draw.getrandbits(64)
        for _ in range(12):
            values.add(x)
            x ^= 1 << draw.randrange(64)
    values = sorted(values)
    prints = spark.createDataFrame([(v.to_bytes(8, "big"),) for v in values], "fingerprint binary")
    from millrace.llm.simhash import exact_shards

    got = [(values.index(int.from_bytes(r.a, "big")), values.index(int.from_bytes(r.b, "big"))) for r in near_links(prints, 64, 2, exact_shards(64, 2), tree_size).collect()]
    want = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    assert roots(len(values), got) == roots(len(values), want)


def test_bk_tree():
    draw = random.Random(9)
    values = [draw.getrandbits(12) for _ in range(300)]
    tree = BKTree(values[0])
    for v in values[1:]:
        tree.add(v)
    for r in (0, 2, 4):
        assert set(tree.within(values[5], r)) == {v for v in values if (v ^ values[5]).bit_count() <= r}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500


def test_similar_texts_go_and_others_stay(spark):
    base = [prose(100 + g, 400).split() for g in range(20)]
    rows = []
    for g, w in enumerate(base):
        rows.append((g * 10, " ".join(w)))
        near, far = list(w), list(w)
        for k in range(3):
            near[50 + 100 * k] = "changed"
        for k in range(0, 400, 8):
            far[k] = f"new{g}x{k}"
        rows += [(g * 10 + 1, " ".join(near)), (g * 10 + 2, " ".join(far))]
    kept = {r.doc_id for r in drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {g * 10 for g in range(20)} | {g * 10 + 2 for g in range(20)}
    assert similar_radius(1.0, 256) == 0 and similar_radius(0.8, 256) == 39


def test_similar_pairs_are_linked_and_others_are_not(spark):
    """Pairs of known similarity: at least 0.9 of those above 0.8 by themselves, none below."""
    draw, rows, similar = random.Random(3), [], {}
    for g in range(240):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(150, 400))]
        other = list(words)
        for k in draw.sample(range(len(words)), max(1, round(len(words) * draw.choice([0.01, 0.015, 0.02, 0.03, 0.04])))):
            other[k] = f"x{draw.randrange(5000)}"
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (words, other))
        similar[g] = len(a & b) / len(a | b)
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {g: got[2 * g + 1] == 2 * g for g in similar}
    assert not any(linked[g] for g, s in similar.items() if s < 0.8)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        some = [linked[g] for g, s in similar.items() if low <= s < high]
        assert len(some) >= 15 and sum(some) >= 0.9 * len(some), (low, len(some), sum(some))


def test_dense_groups_are_one_component(spark):
    rows = []
    for g in range(3):
        base = prose(300 + g, 300).split()
        for i in range(80):
            w = list(base)
            w[(i * 7) % 300], w[(i * 13 + 5) % 300] = f"a{i}", f"b{i}"
            rows.append((1000 * g + i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), shards=16).collect()}
    assert all(c == d // 1000 * 1000 for d, c in got.items())


def test_similar_edges(spark):
    docs = edge_docs(spark)
    kept = drop_similar(docs, shards=4)
    assert kept.columns == docs.columns and drop_similar(docs.limit(0), shards=4).count() == 0
    got = sorted(((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect() if r.text != prose(1, 20_000)), key=str)
    assert [x for x in got if x[0] in (15, 16, 17)] == [(15, prose(2, 60))]
    assert kept.filter("doc_id = 11").count() == 1 and kept.filter("doc_id = 12").count() == 0


def test_dense_groups_give_few_pairs(spark, monkeypatch):
    """Copies further from each other than those that count as one, so that most of them lead."""
    from millrace.llm import simhash

    asked, judge = [], simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda pairs, *rest: asked.append(pairs.count()) or judge(pairs, *rest))
    rows, base = [], [f"w{k}" for k in range(140)]
    for i in range(132):
        w = list(base)
        w[4 + i] = f"a{i}"
        rows.append((i, " ".join(w)))
    got = [r.component_id for r in similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(got) == {0} and sum(asked) < 20 * len(rows), asked


def test_dense_groups_below_the_similarity_give_few_rows(spark, monkeypatch):
    """Copies of which all are candidates of each other, and none as similar as asked for."""
    from millrace.llm import simhash

    asked, judge = [], simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda rows, *rest: asked.append(rows.count()) or judge(rows, *rest))
    draw, rows, base = random.Random(4), [], [f"w{k}" for k in range(400)]
    for i in range(200):
        w = list(base)
        for k in draw.sample(range(0, 400, 5), 7):
            w[k] = f"a{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 200, 50)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {i: i for i, _ in rows}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = want[i], want[j]
                want = {k: min(old, new) if v in (old, new) else v for k, v in want.items()}
    got = {r.doc_id: r.component_id for r in similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) > 100 and got == want
    assert sum(asked) < 20 * len(rows), asked
