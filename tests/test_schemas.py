"""Declared schemas, rejected rows, numbers in groups of any size."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.numbering import numbered
from tessera.sources import registry, schemas

SF = "/root/testdata/sf0.001"


def test_tables_keep_their_schemas(spark):
    for name, contract in schemas.TABLES.items():
        df = registry.table(spark, SF, name)
        assert df.columns == list(contract.columns)
        with pytest.raises(TypeError, match=name):
            schemas.conformed(df.drop(df.columns[0]), name)
        assert schemas.split_rows(df, name)[1].count() == 0, name
    edges = registry.table(spark, SF, "doc_edge")
    with pytest.raises(TypeError, match="valid_from_seq: string for bigint"):
        schemas.conformed(edges.withColumn("valid_from_seq", F.lit("x")), "doc_edge")


def test_rejected_rows_have_reasons(spark):
    rows = [
        ("a", "b", "calls", "linker", "EXTRACTED", None, 1, None), ("a", "b", "calls", "linker", "EXTRACTED", "later", 1, None), (None, "b", "calls", "x", "EXTRACTED", None, 1, 2),
        (None, "b", "calls", "x", "EXTRACTED", None, 1, 2), ("a", "c", "likes", "x", "EXTRACTED", None, 1, None), ("a", "d", "tests", "x", "SURE", None, 1, None), ("a", "e", "tests", "x", None, None, 3, 2), ("a", "f", "tests", "x", None, None, 2, 2),
    ]
    good, bad = schemas.split_rows(spark.createDataFrame(rows, schemas.TABLES["doc_edge"].schema), "doc_edge")
    assert sorted((r["to_artifact_id"], r["evidence"]) for r in good.collect()) == [("b", None), ("f", None)]
    assert sorted((r["to_artifact_id"], r["reason"]) for r in bad.collect()) == [("b", "null_key"), ("b", "null_key"), ("b", "repeated_key"), ("c", "unknown_edge_type"), ("d", "unknown_trust_class"), ("e", "invalidated_at_seq_before_valid_from_seq")]


def test_registry_is_read_with_declared_schemas(spark):
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in schemas.TABLES:
        registry.table(spark, SF, name).limit(3).write.parquet(f"{where}/{name}.parquet")
    read = schemas.read_registry(spark, where)
    assert set(read) == set(schemas.TABLES)
    assert all(read[n].schema.simpleString() == c.schema.simpleString() and read[n].count() == 3 for n, c in schemas.TABLES.items())


def test_numbers_of_a_hot_group(spark):
    rows = [("hot", f"{i:05}") for i in range(3000)] + [(f"g{i % 40}", f"{i:05}") for i in range(200)] + [(None, "b"), (None, "a")]
    df = spark.createDataFrame(rows, "g string, v string").repartition(7)
    got = {(r["g"], r["v"]): r["r"] for r in numbered(df, "g", "v").collect()}
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    assert got == {(g, v): i for g, vs in by.items() for i, v in enumerate(sorted(vs), 1)}
