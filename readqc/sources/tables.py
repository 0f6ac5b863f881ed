"""Reads made of ordinary tables, by SQL text that Spark and other engines run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readqc.operators.profiles import spread

#: Records in the canonical schema from a lineitem table.
READS_SQL = """
SELECT 'lineitem' AS file, rid AS read_id, flag, mapq,
  translate(substring(concat(md5(concat(rid, 'a')), md5(concat(rid, 'b')), md5(concat(rid, 'c'))), 1, n), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq,
  translate(substring(concat(md5(concat(rid, 'd')), md5(concat(rid, 'e')), md5(concat(rid, 'f'))), 1, n), '0123456789abcdef', '#%(+.147:=@BDFHK') AS qual,
  CASE k WHEN 0 THEN concat(n, 'M') WHEN 1 THEN concat('5S', n - 5, 'M') WHEN 2 THEN concat('20M2I', n - 22, 'M')
    WHEN 3 THEN concat('15M3D', n - 15, 'M') WHEN 4 THEN concat('3S10M1I4D', n - 17, 'M3S') ELSE concat('2H', n, 'M') END AS cigar,
  CASE k WHEN 0 THEN concat('10A', n - 11) WHEN 1 THEN concat('', n - 5) WHEN 2 THEN concat('7C', n - 10)
    WHEN 3 THEN concat('15^ACG', n - 15) WHEN 4 THEN concat('10^ACGT', n - 17) ELSE concat('0T', n - 1) END AS md,
  true AS is_aligned,
  CAST(CASE WHEN mapq = 7 THEN NULL ELSE CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 5 ELSE 1 END + CASE WHEN n % 19 = 0 THEN 1 ELSE 0 END END AS int) AS nm
FROM (
  SELECT concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS rid, CAST(40 + l_partkey % 57 AS int) AS n, CAST(l_suppkey % 6 AS int) AS k,
    CAST(l_quantity AS int) AS mapq,
    CAST(1 + CASE WHEN l_returnflag = 'A' THEN 2 ELSE 0 END + CASE WHEN l_discount = 0 THEN 4 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END
      + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END AS int) AS flag
  FROM {table}) AS t
"""


def reads_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"))
    return spark.sql(READS_SQL.replace("{table}", "{lines}"), lines=lines)


def reads_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences without qualities or alignments; three files by length: short, middle, long."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "CASE WHEN length(text) < 250 THEN 'short' WHEN length(text) < 1000 THEN 'middle' ELSE 'long' END AS file",
        "cast(doc_id AS string) AS read_id",
        "cast(NULL AS int) AS flag",
        "cast(NULL AS int) AS mapq",
        "cast(NULL AS string) AS cigar",
        "text AS seq",
        "cast(NULL AS string) AS qual",
        "cast(NULL AS string) AS md",
        "false AS is_aligned",
    )
