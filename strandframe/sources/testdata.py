"""Alignments derived from lineitem and supplier, by SQL that Spark and DuckDB both read.

One target in ten has no alignments; every CIGAR operation but P occurs; MD is missing for one return
flag; NM is wrong on purpose where MD exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REFS_SQL = """
  SELECT CAST(s_suppkey AS INT) AS tid, s_name AS rname, s_nationkey AS genome_id,
         CAST(1000 + 37 * (s_suppkey % 50) AS BIGINT) AS tlen
  FROM {supplier}"""

ALIGNMENTS_SQL = """
  SELECT concat('q', CAST(l_orderkey AS VARCHAR(20))) AS qname, l_orderkey * 1000 + rn AS ord,
         CAST(CASE WHEN l_suppkey % 10 = 0 THEN 4
              ELSE (CASE WHEN l_orderkey % 3 = 0 THEN 0 WHEN l_partkey % 2 = 0 THEN 65 ELSE 129 END)
                 + (CASE WHEN rn > 1 THEN 256 ELSE 0 END)
                 + (CASE WHEN l_quantity = 50 THEN 2048 ELSE 0 END) END AS INT) AS flag,
         CAST(CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_suppkey END AS INT) AS tid,
         CAST(CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE (l_partkey * 7) % 850 END AS BIGINT) AS pos0,
         CASE WHEN l_suppkey % 10 = 0 THEN '*' ELSE
           CASE t WHEN 1 THEN '10S90M' WHEN 2 THEN '50M1D50M' WHEN 3 THEN '50M2I48M'
                  WHEN 4 THEN '49=1X50=' WHEN 5 THEN '30M5N65M5H' WHEN 6 THEN '20S60M20S'
                  WHEN 7 THEN '60M' WHEN 8 THEN '60S140M' ELSE '100M' END END AS cigar,
         CAST(l_quantity AS INT) AS as_score,
         d + CASE t WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END
           + CASE WHEN l_returnflag = 'N' THEN 0 ELSE 5 END AS nm,
         CASE WHEN l_returnflag = 'N' THEN NULL
              WHEN t = 2 THEN concat(repeat('1A', d), CAST(50 - 2 * d AS VARCHAR(5)), '^C50')
              ELSE concat(repeat('1A', d), CAST(40 AS VARCHAR(5))) END AS md
  FROM (SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, l_returnflag,
               CAST(round(l_tax * 100) AS INT) AS t, CAST(round(l_discount * 100) AS INT) AS d,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
        FROM {lineitem}) li"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, rname, genome_id, tlen."""
    return spark.sql(REFS_SQL, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ALIGNMENTS_SQL, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A genome definition: one nation's suppliers are a genome."""
    return refs(spark, sf_dir).selectExpr("CAST(genome_id AS BIGINT) * 1000000 + tid AS line_no", "concat('genome', genome_id) AS genome", "rname")
