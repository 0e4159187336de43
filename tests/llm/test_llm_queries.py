"""Queries of the training-data operators that SQL can express, against DuckDB."""

import os
import random

import duckdb
import pytest

from dissona.llm import queries

DATA = "/root/testdata"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("planted", [False, True])
def test_query(spark, name, planted, tmp_path):
    sf = f"{DATA}/sf0.001"
    if planted:  # what base rules must tell apart
        texts = ["Token: abcdef api_Key='x1-y2=z' secret = short", "AKIA" + "Z9" * 9 + " " + "0f" * 13, "a@b.co, c.d@e-f.gh.i @x.y", "1.2.3.4 256.1.1.1 007.010.0.255.9", "4111 1111-1111 1111 and 4111111111111112", "+1 (555) 123-4567 +12", "w " * 30, "\n".join(["same line"] * 4 + [" ", "x#$%"]), "", None, "a b c d e f g h " * 4 + "i\u00a0j"]
        sf = str(tmp_path)
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{sf}/documents.parquet")
        rng = random.Random(1)
        vectors = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.randrange(3)) for i in range(300)]
        odd = [(300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [float("nan"), 0.0, 0.0, 0.0], 1), (303, [float("inf"), 0.0, 0.0, 0.0], 2), (304, vectors[0][1], None), (350, vectors[1][1], 1), (351, vectors[1][1], 1), (352, vectors[1][1], 2)]
        spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{sf}/embeddings.parquet")
    got = queries.QUERIES[name](spark, sf).toPandas()
    source = f"{sf}/documents.parquet/*.parquet" if os.path.isdir(f"{sf}/documents.parquet") else f"{sf}/documents.parquet"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{source}'")
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'" if not planted else f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet'")
    want = c.sql(queries.ORACLE_SQL[name]).df()
    key = lambda df: sorted(tuple(r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want) and len(got)
