import hashlib
from collections import Counter

import pytest
from helpers import edge_docs, edge_texts, prose, words

from millrace.llm.substring_dedup import drop_repeats


def brute(rows, window):
    texts = [(d, words(t)) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    return sorted((tuple(r) for r in drop_repeats(df, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("tree_size", [2, 20_000])
def test_against_brute_force(spark, tree_size):
    passage, other = prose(900, 40), prose(901, 36)
    rows = [(i, f"{prose(i, 30)} {passage if i % 3 == 0 else other if i % 3 == 1 else ''} {prose(i + 500, 20)}") for i in range(60)]
    rows += [(100, f"{passage} {passage}"), (101, "same " * 80), (102, prose(900, 34)), (103, prose(900, 35))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, tree_size=tree_size) == brute(rows, 35)


def test_edges(spark):
    docs = edge_docs(spark)
    assert result(docs) == brute(edge_texts(), 35)
    assert drop_repeats(docs.limit(0)).count() == 0


def test_texts(spark):
    rows = [(1, "a " + prose(3, 35) + " b"), (2, "c " + prose(3, 35))]
    got = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True)
    assert {(r.doc_id, r.kept_text) for r in got.collect()} == {(1, "a b"), (2, "c")}
