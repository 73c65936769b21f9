"""The pipeline stage by stage on a small corpus with planted cases."""

from collections import Counter

import pytest
from helpers import edge_docs, prose, words

import __spark_entry__ as driver
import corpus_pipeline

TABLES = "documents labels".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = [], []
    for i in range(240):
        w = prose(i, 60 + i % 100).split()
        if i % 6 == 0:
            w[i % len(w)] = w[i % 7 + 20] = "vileword"
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(1000 + i, docs[i][1] + " ", "en", "s0", 0) for i in range(1, 240, 10) if i % 6]
    docs += [(2000 + i, docs[i][1] + " added", "en", "s1", 0) for i in range(2, 240, 20) if i % 6]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    clean = {r.doc_id for r in kept["toxicity"]}
    toxic = {d for d, t in before.items() if "vileword" in t}
    assert len(toxic & clean) <= 2 and len(set(before) - toxic - clean) <= 2
    exact = {r.doc_id for r in kept["exact_dedup"]}
    assert {d for d in exact if d >= 2000} == {d for d in clean if d >= 2000}
    texts = Counter("".join(words(before[d])) for d in exact)
    assert set(texts.values()) == {1}
    near = {r.doc_id for r in kept["near_dedup"]}
    assert not {d for d in near if d >= 2000 and (d - 2000 in near or d - 1000 in near)}
    mixed = Counter(r.doc_id for r in kept["mixing"])
    assert set(mixed) <= near and max(mixed.values()) <= 3
    packed = Counter((r.doc_id, r.start) for r in kept["packing"])
    assert {d for d, _ in packed} == set(mixed) and all(packed[d, 0] == n for d, n in mixed.items())


def test_run_and_edges(spark, folder, monkeypatch):
    # Training is covered by test_stages; here every text passes.
    monkeypatch.setattr("millrace.llm.toxicity.train_toxicity", lambda *tables, **options: {"constant": 0.0})
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = out.cache()
            assert docs.count() > 0


def test_queries_are_registered():
    found = driver.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
    assert "pipeline" in found
