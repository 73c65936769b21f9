"""The registered queries over whole small tables, against SQL, the tokenizer and plain loops."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_simhash import brute as simhash_brute
from test_substring_dedup import brute as substring_brute

from millrace.llm.queries import ORACLE_SQL, QUERIES, pictures
from millrace.llm.tokenizing import public_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda rows: sorted((tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)
    assert plain(map(tuple, got.select(want.columns).collect())) == plain(want.fetchall())


def test_substrings(spark, documents):
    got = QUERIES["op5_substring_dedup"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == substring_brute(documents, 35)


def test_fingerprints(spark, documents):
    got = QUERIES["op10_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == simhash_brute(documents)


def test_tokens_and_sequences(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_path())
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in documents}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    start, want = 0, []
    for d in sorted(ids):
        want.append((d, start, len(ids[d]), crc(ids[d])))
        start += len(ids[d])
    got = QUERIES["op2_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
    pieces = QUERIES["op7_packing"](spark, SF).collect()
    of, inside = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == crc(ids[p.doc_id][p.start : p.start + p.length]) and p.doc_tokens == len(ids[p.doc_id])
        of[p.doc_id].append((p.start, p.length))
        inside[p.sequence_id].append((p.offset, p.length))
    assert set(of) == set(ids)
    for d, spans in of.items():
        ends = np.cumsum([0, *(n for _, n in sorted(spans))])
        assert [a for a, _ in sorted(spans)] == ends[:-1].tolist() and ends[-1] == len(ids[d])
    for spans in inside.values():
        ends = np.cumsum([0, *(n for _, n in sorted(spans))])
        assert [a for a, _ in sorted(spans)] == ends[:-1].tolist() and ends[-1] <= 4096
    assert len(inside) <= -(-start // 4096) * 1.1 + 1


def test_pictures(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0], "x"), (21, [1.0, 2.0], "y"), (None, [0.5], "z"), (40, None, "w"), (60, [], "v")], "vec_id long, embedding array<float>, edited string")
    got = pictures(df).collect()
    assert sorted((r.id, r.edited) for r in got if r.id is not None) == [(20, False), (20, True), (21, False), (40, False), (40, True), (60, False), (60, True)]
    by = {(r.id, r.edited): r.image for r in got}
    assert by[20, False] == by[21, False] != by[20, True] and by[40, False] is None and by[60, True] is None and by[None, False]
    assert pictures(df.limit(0)).count() == 0
