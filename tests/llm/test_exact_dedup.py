import hashlib
import re
from collections import defaultdict

from helpers import edge_docs, edge_texts

from millrace.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    return sorted(((d, min(g)[3], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for *_, d in g), key=str)


def test_edges(spark):
    got = exact_duplicates(edge_docs(spark))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=str) == brute(edge_texts())


def test_hot_texts_are_spread_and_keep_one(spark):
    rows = [(i, " same text" + " " * (i % 7)) for i in range(400)] + [(1000 + i, f"own {i}") for i in range(50)] + [(2000 + i % 5, "") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_duplicates(df, hot_least=20, salts=7)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=str) == brute(rows)
    assert got.filter("kept").count() == 52
    kept = drop_exact_duplicates(df, hot_least=20, salts=7)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([6, 2000, *range(1000, 1050)])


def test_columns_and_empty_table(spark):
    docs = edge_docs(spark)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({h for *_, h in brute(edge_texts())})
    assert kept.filter("row <> 'clash'").count() == 0
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_long_common_beginnings(spark):
    rows = [(i, "z" * 100 + str(i % 3)) for i in range(30)]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=str) == brute(rows)
