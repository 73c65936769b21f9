from collections import defaultdict

from helpers import edge_docs, edge_texts, prose, words

from millrace.llm.mixing import mixed_rows, pareto_mix


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing until no source is above its ceiling."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    full, total = set(), sum(sizes.values())
    while True:
        left, share = total - sum(most * sizes[s] for s in full), sum(weight[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / share for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def corpus(counts):
    return [(10_000 * k + i, s, prose(k * 1000 + i, 1 + (i * 37) % 60)) for k, (s, n) in enumerate(counts) for i in range(n)]


def check(spark, counts):
    rows = corpus(counts)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = pareto_mix(df).collect()
    sizes = defaultdict(int)
    for _, s, t in sorted(rows, key=lambda r: (r[1] is None, r[1] or "")):
        sizes[s] += len(words(t))
    want = fill(sizes)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and r.copies <= 3
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 61 / 2 + 1
    assert sorted(map(tuple, pareto_mix(df.repartition(3)).collect())) == sorted(map(tuple, got))
    copies = {r.doc_id: r.copies for r in got}
    mixed = defaultdict(int)
    for r in mixed_rows(df).collect():
        mixed[r.doc_id] += 1
    assert mixed == {d: n for d, n in copies.items() if n}


def test_equal_sources(spark):
    check(spark, [("a", 60), ("b", 60), ("c", 60)])


def test_small_sources_fill_up(spark):
    check(spark, [("a", 4), ("b", 200), ("c", 2), ("d", 3), ("e", 90)])


def test_one_hot_source_and_null(spark):
    check(spark, [("a", 300), ("b", 20), (None, 50)])


def test_single_source(spark):
    check(spark, [("only", 30)])


def test_edges(spark):
    docs = edge_docs(spark)
    got = pareto_mix(docs)
    assert got.count() == len(edge_texts())
    assert mixed_rows(docs).columns == docs.columns
    assert pareto_mix(docs.limit(0)).count() == mixed_rows(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, None, " ")], "doc_id long, source string, text string")
    assert {(r.size, r.target, r.taken) for r in pareto_mix(empty).collect()} == {(0, 0.0, 0)}


def test_long_documents_are_taken_more_often(spark):
    """Inclusion rates over many seeds are the expected copies, which differ by document."""
    rows = [(i, "a" if i < 240 else "b", " ".join(["w"] * (1 << (i % 8)))) for i in range(480)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1)
    n, mean, expected = 8, defaultdict(float), {}
    for seed in range(n):
        for r in pareto_mix(df, weights=(1, 3), seed=f"s{seed}").collect():
            mean[r.source, r.size] += r.copies / n / 30
            expected[r.source, r.size] = r.expected
    assert len(set(expected.values())) == len(expected) and max(expected.values()) > 1 > min(expected.values())
    assert all(abs(mean[k] - e) < 0.12 for k, e in expected.items()), (mean, expected)
    assert all(expected[s, 1 << k] < expected[s, 2 << k] for s in "ab" for k in range(7))


def test_expected_words_are_the_target(spark):
    from millrace.llm.mixing import expected_copies

    rows = [(s, n, n.bit_length()) for s, n in [("a", 1)] * 50 + [("a", 900)] * 3 + [("b", 5)] * 400 + [("c", 70)] * 40 + [(None, 3)] * 20 + [("c", 1)]]
    sized = spark.createDataFrame(rows, "source string, size long, digits int")
    plan = {(r.plan_source, r.plan_digits): r for r in expected_copies(sized).collect()}
    words, target = defaultdict(float), {}
    for s, n, k in rows:
        r = plan[s, k]
        words[s] += (r.whole + r.chance) * n
        target[s] = r.target
        assert r.whole + r.chance <= 3
    assert all(abs(words[s] - t) < 1e-6 for s, t in target.items())
