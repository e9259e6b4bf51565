"""Operators against the SQL that states the same results."""

import os
import random

import pytest
from pyspark.sql import functions as F

from visitprep.llm import queries, sql

TABLES = "/root/testdata/sf0.001"


def compared(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {table} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    df = queries.queries()[name](spark, folder)
    cursor = con.execute(sql.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(r) for r in df.select(*names).collect())
    assert got == sorted(cursor.fetchall())
    return got


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_whole_tables(spark, name):
    assert compared(spark, TABLES, name)


@pytest.mark.parametrize("name", ["op5_suffix_array", "op6_ngram_jaccard", "op10_suffix_trees"])
def test_awkward_documents(spark, awkward, tmp_path, name):
    rows = awkward.filter("doc_id is not null").dropDuplicates(["doc_id"])
    # Copies next to each other, at the start and at the end, and a window that overlaps itself.
    rng = random.Random(9)
    words = [f"v{rng.randrange(50)}" for _ in range(120)]
    more = [" ".join(words), " ".join(words[:60] + ["x"] + words[60:]), " ".join(["same"] * 200), " ".join(["same"] * 130) + " end", "Four Words  in\tall", "four words in ALL", "aé" * 40, "é" + "aé" * 40]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    rows.select("doc_id", "text").union(more).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = compared(spark, str(tmp_path), name)
    assert len(got) == rows.count() + 8


def test_linked_embeddings(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for group in range(40):
        centre = [rng.gauss(0, 1) for _ in range(16)]
        rows += [(len(rows) + i, [x + rng.gauss(0, 0.02) for x in centre], None if group == 7 else group % 3) for i in range(rng.randrange(1, 6))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, [float("inf")] * 16, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("embedding", F.expr("cast(embedding as array<float>)")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = compared(spark, str(tmp_path), "op9_lattice_embeddings")
    assert sum(r[1] for r in got) > 20


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(sql.BASE))
def test_columns_without_a_model(spark, tmp_path, name):
    """On the tables and on odd texts: numbers that fail, phrases at the ends, null sources."""
    duckdb = pytest.importorskip("duckdb")
    odd = ["4111 1111-1111 1111 and 4111 1111 1111 1112", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8", "+49 (30) 1234-5678, +1 2", "a@b.c, x.y+z@q-r.s.t @ a@b", "CC BY general public license all rights reserved", "all rights reserved. cc-by cc BY", None, ""]
    more = spark.createDataFrame([(10**6 + i, t, None if i % 3 else "odd") for i, t in enumerate(odd)], "doc_id long, text string, source string")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    docs.select("doc_id", "text", "source").union(more).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(sql.BASE[name])
    names = [c[0] for c in cursor.description]
    got = queries.queries()[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cursor.fetchall()))
