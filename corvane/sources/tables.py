"""Loading of the parquet tables, and the relations of the code-knowledge model bound to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Relations over the tables, in SQL that Spark and DuckDB read alike.
RELATIONS = {
    "units": "SELECT doc_id AS id, text, source, lang, n_chars, CAST(floor(n_chars / CAST(3.6 AS DOUBLE)) AS BIGINT) + 1 AS tokens FROM documents",
    "comp": "SELECT p_partkey AS pk, concat(p_brand, '/', p_type, '::', CAST(p_partkey AS STRING)) AS id, concat(p_brand, '/', p_type) AS path, p_brand AS dir, p_type AS kind, p_name AS name, CAST(p_size AS BIGINT) AS tokens FROM part",
    "edge": (
        "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst"
        " FROM lineitem WHERE l_quantity >= 45) e WHERE dst IS NOT NULL AND src <> dst"
    ),
    "module": "SELECT r_name AS parent, n_name AS name, n_nationkey AS mk, r_regionkey AS pk, concat(r_name, '/', n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey",
    "owned": "SELECT n_nationkey AS mk, concat('s', CAST(s_suppkey AS STRING)) AS cid, s_acctbal AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey, concat('c', CAST(c_custkey AS STRING)), c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "ledger": "SELECT event_id AS id, event_type AS phase, user_id AS target, value AS seconds, ts FROM events",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the tables and of the relations over them."""
    for name in TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, sql in RELATIONS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def with_relations(sql: str) -> str:
    """The SQL for an engine that has the tables only: relations as common table expressions."""
    body = sql.strip()
    head = ", ".join(f"{n} AS ({s})" for n, s in RELATIONS.items())
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"
