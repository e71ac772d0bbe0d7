"""The registered queries over the smallest tables, against SQL or brute force."""

import glob
import os

import duckdb
import numpy as np
import pytest

from arborq.llm import near_dedup, queries

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, TABLES).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    plain = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values))
    assert plain(got) == plain(want) and len(got)


def test_learned_scores(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").toPandas()
    for name, label in (("op1_toxicity", "toxic"), ("op6_quality", "quality")):
        got = queries.QUERIES[name](spark, TABLES).toPandas()
        both = got.merge(labels, on="doc_id")
        assert len(got) == 200 and got["score"].between(0, 1).all()
        assert (both["predicted"] == both[label]).mean() >= 0.85


def test_bpe_round_trip(spark):
    got = queries.QUERIES["op3_byte_bpe"](spark, TABLES).toPandas().set_index("doc_id")
    import hashlib

    for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect():
        assert got.loc[r["doc_id"], "decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_links_of_vectors(spark):
    got = queries.QUERIES["op8_embedding_dedup"](spark, TABLES).toPandas().set_index("vec_id").sort_index()
    e = spark.read.parquet(f"{TABLES}/embeddings.parquet").toPandas().set_index("vec_id").sort_index()
    x = np.vstack(e["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93) & (e["label"].to_numpy()[:, None] == e["label"].to_numpy()[None, :])
    np.fill_diagonal(near, False)
    assert got["n_links"].sum() >= 0.9 * near.sum() and (got["n_links"] <= near.sum(1)).all()


def test_near_duplicates_of_documents(spark):
    got = queries.QUERIES["op4_near_dedup"](spark, TABLES).toPandas().set_index("doc_id")["class_id"]
    words = {r["doc_id"]: near_dedup.words_of(r["text"] or "") for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    ids = sorted(grams)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                assert got[a] == got[b]
            elif got[a] == got[b]:
                assert grams[a] & grams[b] or len(words[a]) < 20
