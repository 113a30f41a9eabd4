"""The registered queries over the smallest tables: against their SQL, or against a plain version."""

import hashlib

import duckdb
import numpy as np
import pytest
from test_llm_operators import plain_groups

import __spark_entry__ as entry_points
from plumbline.llm import bpe
from plumbline.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(names)
    assert sorted(repr(tuple(r[n] for n in names)) for r in result.collect()) == sorted(map(repr, cursor.fetchall()))


def test_every_document_has_its_row(spark, duck):
    docs = duck.execute("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()
    ids = [i for i, _ in docs]
    prints = {r.doc_id: r for r in QUERIES["op2_document_fingerprints"](spark, SF).collect()}
    scores = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, SF).collect()}
    assert sorted(prints) == sorted(scores) == ids
    assert all(prints[i].n_chars == len(t) for i, t in docs) and all(0 <= r.score <= 1 for r in scores.values())
    assert all(r.predicted == (r.score >= 0.5) for r in scores.values())
    groups = plain_groups([t for _, t in docs], 4)
    near = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op10_minhash_near_dedup"](spark, SF).collect()}
    assert near == {i: (groups[k][0], ids[groups[k][1]], groups[k][1] == k) for k, i in enumerate(ids)}


def test_encodings_are_the_librarys(spark, duck):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_bpe_coding"](spark, SF).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for i, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_neighbours_reach_nine_tenths(spark, duck):
    found = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall()
    ids = np.array([i for i, _ in found])
    x = np.array([v for _, v in found], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = QUERIES["op4_nearest_neighbours"](spark, SF).collect()
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[q]
        scores[q] = -9
        exact = ids[np.argsort(-scores)[:5]].tolist()
        hit += len({r.vec_id for r in rows if r.query_id == ids[q]} & set(exact))
        total += 5
    assert len(rows) == total and hit >= 0.9 * total


def test_repeats_point_at_equal_text(spark, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op1_substring_dedup"](spark, SF).collect()
    assert rows
    for r in rows:
        words = texts[r.doc_id][r.start : r.end].lower().split()
        assert texts[r.kept_doc_id][r.kept_start :].lower().split()[: len(words)] == words and (r.kept_doc_id, r.kept_start) < (r.doc_id, r.start)
