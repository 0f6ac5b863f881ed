"""The registered queries on reads, and the same in plain SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc.functions import reads as R
from readqc.operators import derive as D
from readqc.operators import profiles as P
from readqc.operators.reads import derive
from readqc.sources.tables import READS_SQL, reads_of_documents, reads_of_lineitem

QUERIES: dict = {}
ORACLES: dict = {}

_LABELS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(R.MAPQ_LABELS))

#: The derived reads in plain SQL.
_READS = f"""
WITH raw AS ({READS_SQL.replace("{table}", "lineitem")}),
r AS (
  SELECT *, (flag & 16) <> 0 AS rev, (flag & 4) = 0 AS mapped,
    CASE WHEN (flag & 64) = 0 AND (flag & 128) <> 0 THEN 2 ELSE 1 END AS read_no,
    CASE WHEN (flag & 4) <> 0 THEN 3 WHEN mapq < 10 THEN 2 WHEN mapq < 30 THEN 1 ELSE 0 END AS mapq_bin,
    CASE WHEN (flag & 4) <> 0 THEN 0 ELSE coalesce(try_cast(regexp_extract(cigar, '^(?:[0-9]+H)?([0-9]+)S', 1) AS int), 0) END AS a5,
    CASE WHEN (flag & 4) <> 0 THEN 0 ELSE coalesce(try_cast(regexp_extract(cigar, '([0-9]+)S(?:[0-9]+H)?$', 1) AS int), 0) END AS a3
  FROM raw WHERE (flag & 256) = 0),
d AS (
  SELECT *, length(seq) AS n, CASE WHEN rev THEN a3 ELSE a5 END AS clip5, CASE WHEN rev THEN a5 ELSE a3 END AS clip3,
    CASE WHEN rev THEN reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) ELSE seq END AS seq_o,
    CASE WHEN rev THEN reverse(qual) ELSE qual END AS qual_o
  FROM r),
reads AS (SELECT *, greatest(n - clip5 - clip3, 0) AS n_clipped, substring(seq_o, clip5 + 1, greatest(n - clip5 - clip3, 0)) AS s_f, substring(qual_o, clip5 + 1, greatest(n - clip5 - clip3, 0)) AS q_f FROM d)
"""
_BASE = "CASE upper(ch) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END"
_QUALITY = "greatest(least(ascii(ch) - 33, 41), 0)"


def _cells(text: str, series: str, pos: str = "i", source: str = "reads", key: str = "read_no, mapq_bin") -> str:
    """Counts by position and series of one text; i: place from 0, t: length."""
    return f"""SELECT {key}, {pos} AS pos, {series} AS series, count(*) AS n FROM (
  SELECT {key}, t, i, substring(s, i + 1, 1) AS ch FROM (SELECT {key}, length(s) AS t, s, unnest(range(0, length(s)))::INT AS i FROM (SELECT {key}, {text} AS s FROM {source}))) GROUP BY ALL"""


#: Operations of mapped reads with running sums, and runs of equal kinds.
_OPS = f"""{_READS},
o AS (SELECT read_id, read_no, mapq_bin, rev, seq, md, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS x, unnest(range(0, len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')))) AS k FROM reads WHERE mapped),
ops AS (SELECT * EXCLUDE (x), right(x, 1) AS op, left(x, length(x) - 1)::INT AS len FROM o),
sums AS (
  SELECT *, coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'I') THEN len END) OVER w, 0) AS rp, coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'D') THEN len END) OVER w, 0) AS col,
    coalesce(sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'S') THEN len END) OVER w, 0) AS q, sum(CASE WHEN op IN ('M', '=', 'X', 'I') THEN len ELSE 0 END) OVER (PARTITION BY read_id) AS total
  FROM ops WINDOW w AS (PARTITION BY read_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shown AS (SELECT *, CASE WHEN op IN ('=', 'X') THEN 'M' ELSE op END AS kind FROM sums WHERE op IN ('M', '=', 'X', 'I', 'D') AND len > 0),
marked AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY read_id ORDER BY k) THEN 0 ELSE 1 END AS head FROM shown),
numbered AS (SELECT *, sum(head) OVER (PARTITION BY read_id ORDER BY k) AS run FROM marked),
runs AS (SELECT read_id, read_no, mapq_bin, rev, kind, run, min(rp) AS c, sum(len) AS len, any_value(total) AS total FROM numbered GROUP BY ALL)
"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(reads_of_lineitem(spark, sf_dir))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(reads_of_documents(spark, sf_dir))


_TABLE = f"""c AS (SELECT read_no, mapq_bin, count(*) AS n FROM {{source}} GROUP BY ALL),
b AS (SELECT read_no, label AS class, n FROM c JOIN (VALUES {_LABELS}) AS l(bin, label) ON bin = mapq_bin UNION ALL SELECT read_no, 'Total', sum(n)::BIGINT FROM c GROUP BY read_no)
SELECT read_no, class, n, round(n::DOUBLE / max(n) OVER (PARTITION BY read_no), 5) AS fraction FROM b"""


@query(_READS + ", " + _TABLE.format(source="reads"))
def mapping_stats(spark, sf_dir):
    return D.mapping_table(P.read_counts(_reads(spark, sf_dir)))


@query(
    _READS
    + """SELECT *, format('{:.1f}', round(n_paired * 100.0 / total, 1)) AS pct_paired, format('{:.1f}', round(n_proper * 100.0 / n_paired, 1)) AS pct_proper FROM (
  SELECT count(*) AS total, count(*) FILTER (read_no = 1) AS n_read1, count(*) FILTER (read_no = 2) AS n_read2, count(*) FILTER (flag & 1 <> 0) AS n_paired, count(*) FILTER (flag & 3 = 3) AS n_proper FROM reads)"""
)
def pair_stats(spark, sf_dir):
    return P.pair_counts(_reads(spark, sf_dir))


@query(_READS + "SELECT read_no, mapq_bin, n_clipped::INT AS len, count(*) AS n FROM reads GROUP BY ALL")
def length_distribution(spark, sf_dir):
    return P.lengths(_reads(spark, sf_dir))


_DOCS = "WITH docs AS (SELECT CASE WHEN length(text) < 250 THEN 'short' WHEN length(text) < 1000 THEN 'middle' ELSE 'long' END AS file, text FROM documents WHERE text IS NOT NULL)"


@query(_DOCS + "SELECT *, max(len) OVER (PARTITION BY file) AS longest FROM (SELECT file, length(text)::INT AS len, count(*) AS n FROM docs GROUP BY ALL)")
def length_distribution_docs(spark, sf_dir):
    counts = D.once(P.lengths(_docs(spark, sf_dir), by=["file"]))
    longest = counts.groupBy("file").agg(F.max("len").alias("longest"))
    return counts.join(longest, "file")


@query(_READS + _cells("s_f", _BASE))
def base_composition(spark, sf_dir):
    return P.bases(_reads(spark, sf_dir))


@query(_DOCS + _cells("text", _BASE, source="docs", key="file"))
def base_composition_docs(spark, sf_dir):
    return P.bases(_docs(spark, sf_dir), by=["file"])


@query(_READS + _cells("q_f", _QUALITY))
def quality_composition(spark, sf_dir):
    return P.qualities(_reads(spark, sf_dir))


_MEANS = f""", q AS ({_cells("q_f", _QUALITY)}), m AS (SELECT read_no, mapq_bin, pos, sum(n)::BIGINT AS n, sum(series * n)::DOUBLE / sum(n) AS mean FROM q GROUP BY ALL)"""


@query(
    _READS
    + _MEANS
    + """SELECT read_no, mapq_bin, pos, m.n, round(mean, 6) AS mean, round(sqrt(sum(q.n * (mean - series) * (mean - series)) / m.n) / sqrt(m.n), 6) AS std_err
FROM q JOIN m USING (read_no, mapq_bin, pos) GROUP BY read_no, mapq_bin, pos, m.n, mean"""
)
def mean_quality(spark, sf_dir):
    means = D.mean_quality(P.qualities(_reads(spark, sf_dir)))
    return means.withColumns({"mean": F.round("mean", 6), "std_err": F.round("std_err", 6)})


@query(_READS + _MEANS + "SELECT read_no, mapq_bin, pos, n, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY read_no, mapq_bin ORDER BY pos) AS k FROM m) WHERE k = pos + 1")
def mean_quality_until_gap(spark, sf_dir):
    means = D.until_first_gap(D.mean_quality(P.qualities(_reads(spark, sf_dir))))
    return means.select("read_no", "mapq_bin", "pos", "n", F.round("mean", 6).alias("mean"))


@query(_READS + _cells("reverse(seq_o)", _BASE))
def end_base_composition(spark, sf_dir):
    return P.bases_from_end(_reads(spark, sf_dir))


@query(_READS + _cells("reverse(qual_o)", _QUALITY))
def end_quality(spark, sf_dir):
    return P.qualities_from_end(_reads(spark, sf_dir))


_HUNDREDTH = "floor(i::DOUBLE / t * 100.0::DOUBLE)::INT"


@query(_READS + _cells("s_f", _BASE, _HUNDREDTH))
def norm_base_composition(spark, sf_dir):
    return P.bases_normalised(_reads(spark, sf_dir))


@query(_READS + _cells("q_f", _QUALITY, _HUNDREDTH))
def norm_quality(spark, sf_dir):
    return P.qualities_normalised(_reads(spark, sf_dir))


@query(_OPS + "SELECT read_no, mapq_bin, (CASE WHEN rev THEN total - c - len ELSE c END)::INT AS pos, count(*) AS n FROM runs WHERE kind = 'I' GROUP BY ALL")
def insertion_profile(spark, sf_dir):
    return P.insertions(_reads(spark, sf_dir))


@query(_OPS + "SELECT read_no, mapq_bin, (CASE WHEN rev THEN total - c ELSE c END)::INT AS pos, count(*) AS n FROM runs WHERE kind = 'D' GROUP BY ALL")
def deletion_profile(spark, sf_dir):
    return P.deletions(_reads(spark, sf_dir))


_MISMATCHES = r""",
tokens AS (SELECT read_id, unnest(regexp_extract_all(md, '[0-9]+|\^[A-Za-z]+|[A-Za-z]')) AS t, unnest(range(0, len(regexp_extract_all(md, '[0-9]+|\^[A-Za-z]+|[A-Za-z]')))) AS k FROM reads WHERE mapped),
placed AS (SELECT read_id, t, coalesce(sum(CASE WHEN regexp_matches(t, '^[0-9]') THEN t::INT WHEN t LIKE '^%' THEN length(t) - 1 ELSE 1 END) OVER (PARTITION BY read_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM tokens),
letters AS (SELECT read_id, t, place FROM placed WHERE regexp_matches(t, '^[A-Za-z]$')),
pairs AS (
  SELECT read_id, read_no, mapq_bin, rev, total, rp + place - col AS rp, substring(seq, (q + place - col + 1)::INT, 1) AS base, t
  FROM letters JOIN sums USING (read_id) WHERE op IN ('M', '=', 'X') AND place >= col AND place < col + len),
mis AS (SELECT read_id, read_no, mapq_bin, (CASE WHEN rev THEN total - 1 - rp ELSE rp END)::INT AS pos, CASE WHEN rev THEN translate(base, 'ACGTacgt', 'TGCAtgca') ELSE base END AS ch FROM pairs WHERE base <> t AND base <> '')
"""


@query(_OPS + _MISMATCHES + f"SELECT read_no, mapq_bin, pos, {_BASE} AS series, count(*) AS n FROM mis GROUP BY ALL")
def mismatch_profile(spark, sf_dir):
    return P.mismatches(_reads(spark, sf_dir))


@query(
    _OPS
    + _MISMATCHES
    + """SELECT read_no, mapq_bin, coalesce(a.n, 0) AS n_mis, coalesce(b.n, 0) AS n_ins, coalesce(c.n, 0) AS n_del FROM (SELECT DISTINCT read_no, mapq_bin FROM reads)
LEFT JOIN (SELECT read_no, mapq_bin, count(*) AS n FROM mis GROUP BY ALL) a USING (read_no, mapq_bin)
LEFT JOIN (SELECT read_no, mapq_bin, count(*) AS n FROM runs WHERE kind = 'I' GROUP BY ALL) b USING (read_no, mapq_bin)
LEFT JOIN (SELECT read_no, mapq_bin, count(*) AS n FROM runs WHERE kind = 'D' GROUP BY ALL) c USING (read_no, mapq_bin)"""
)
def error_totals(spark, sf_dir):
    return P.error_totals(_reads(spark, sf_dir))


_CLUSTERS = """, l AS (SELECT file, greatest(250, max(length(text)) + 1) AS l FROM docs GROUP BY file),
p AS (SELECT l.file, l, unnest(range(0, l)) AS pos FROM l),
w AS (SELECT *, CASE WHEN pos <= 250 THEN NULL WHEN l <= 1000 THEN 5 WHEN pos < 2000 THEN 10 WHEN pos < 5000 THEN 50 WHEN pos < 10000 THEN 100 ELSE 500 END AS width FROM p),
closing AS (SELECT *, CASE WHEN l <= 250 OR pos <= 250 OR (pos - 250) % width = 0 THEN 1 ELSE 0 END AS closed FROM w),
map AS (SELECT file, l, pos, coalesce(sum(closed) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS cluster FROM closing),
sized AS (SELECT file, l, cluster, count(*) AS size, min(pos) AS a, max(pos) AS b FROM map GROUP BY ALL),
cells AS ({cells})
SELECT file, series, cluster, CASE WHEN l <= 250 THEN (a + 1)::VARCHAR WHEN a = b THEN a::VARCHAR ELSE concat(a, '-', b) END AS label, round(sum(n)::DOUBLE / size)::BIGINT AS n
FROM cells JOIN map USING (file, pos) JOIN sized USING (file, l, cluster) GROUP BY file, series, cluster, l, a, b, size"""


@query(_DOCS + _CLUSTERS.replace("{cells}", _cells("text", _BASE, source="docs", key="file")))
def clustered_composition(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    counts = P.bases(docs, by=["file"])
    files = docs.groupBy("file").agg(F.max("n").alias("longest"))
    lengths = files.select("file", R.matrix_length(F.col("longest")).alias("l"))
    return D.clustered_by_file(counts.join(lengths, "file"), by=["file"])


@query(_READS + "SELECT clip5::INT AS clip5, clip3::INT AS clip3, count(*) AS n FROM reads GROUP BY ALL")
def clip_bounds(spark, sf_dir):
    return _reads(spark, sf_dir).groupBy("clip5", "clip3").agg(F.count("*").alias("n"))


@query(_OPS + "SELECT op, count(*) AS n_ops, sum(len)::BIGINT AS bases FROM ops GROUP BY ALL")
def cigar_ops(spark, sf_dir):
    ops = _reads(spark, sf_dir).select(F.explode("ops").alias("x"))
    return ops.groupBy("x.op").agg(F.count("*").alias("n_ops"), F.sum("x.len").alias("bases"))


@query(_READS + "SELECT read_id, seq_o, qual_o, n_clipped::INT AS n_clipped, CASE WHEN mapped THEN cigar ELSE '' END AS cigar FROM reads")
def orient_reads(spark, sf_dir):
    return _reads(spark, sf_dir).select("read_id", "seq_o", "qual_o", "n_clipped", R.cigar_text(F.col("ops")).alias("cigar"))


@query(_OPS + "SELECT read_id, sum(CASE WHEN op IN ('M', '=', 'X', 'I', 'D') THEN len ELSE 0 END)::INT AS columns, sum(CASE WHEN op IN ('M', '=', 'X', 'I') THEN len ELSE 0 END)::INT AS bases FROM ops GROUP BY read_id")
def aligned_lengths(spark, sf_dir):
    mapped = _reads(spark, sf_dir).where(F.size("ops") > 0)
    return mapped.select("read_id", R.aln_len(F.col("ops")).alias("columns"), R.sum_ops(F.col("ops"), "M=XI").alias("bases"))


@query(_READS + f", c AS ({_cells('s_f', _BASE)}), e AS (SELECT read_no, mapq_bin, max(pos) + 1 AS extent, sum(n)::BIGINT AS n FROM c GROUP BY ALL) SELECT *, mapq_bin = min(mapq_bin) OVER (PARTITION BY read_no) AS visible FROM e")
def visible_groups(spark, sf_dir):
    return D.extents(P.bases(_reads(spark, sf_dir)))


@query(_READS + f", c AS ({_cells('s_f', _BASE)}), e AS (SELECT read_no, mapq_bin, max(pos) AS m FROM c GROUP BY ALL), g AS (SELECT read_no, mapq_bin, unnest(range(0, m + 1))::INT AS pos FROM e) SELECT read_no, mapq_bin, pos, series, coalesce(n, 0) AS n FROM g CROSS JOIN range(0, 5) AS s(series) LEFT JOIN c USING (read_no, mapq_bin, pos, series)")
def dense_base_composition(spark, sf_dir):
    return D.zero_filled(P.bases(_reads(spark, sf_dir)), len(R.BASES)).withColumn("series", F.col("series").cast("long"))


@query(
    """SELECT k AS n, CASE WHEN k < 1000 THEN k::VARCHAR WHEN k < 1000000 THEN concat(round(k / 1000.0)::BIGINT, 'K') WHEN k < 1000000000 THEN concat(round(k / 1000000.0)::BIGINT, 'M') ELSE concat(round(k / 1000000000.0)::BIGINT, 'G') END AS text
FROM (SELECT o_orderkey * o_orderkey AS k FROM orders)"""
)
def human_counts(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * F.col("o_orderkey")).alias("n"))
    return n.withColumn("text", R.human_count(F.col("n")))


@query(_READS.replace("WHERE (flag & 256) = 0", "WHERE (flag & 256) = 0 ORDER BY read_id LIMIT 5000") + ", " + _TABLE.format(source="reads"))
def peek_mapping_stats(spark, sf_dir):
    """The first 5000 kept records; a table has no order of its own, so the read's name is it."""
    return D.mapping_table(P.read_counts(_reads(spark, sf_dir).orderBy("read_id").limit(5_000)))


@query(_READS + "SELECT read_no, min(n)::INT AS min_len, max(n)::INT AS max_len FROM reads GROUP BY ALL")
def length_range(spark, sf_dir):
    return P.length_range(_reads(spark, sf_dir))


@query(
    _READS
    + """SELECT read_no, mapq_bin, kind, len, count(*) AS n FROM (SELECT read_no, mapq_bin, 'raw' AS kind, n::INT AS len FROM reads
UNION ALL SELECT read_no, mapq_bin, 'mapped', n_clipped::INT FROM reads WHERE clip5 + clip3 > 0) GROUP BY ALL"""
)
def raw_and_mapped_lengths(spark, sf_dir):
    return P.raw_and_mapped_lengths(_reads(spark, sf_dir))


@query(_READS + _cells("substring(s_f, 1, 30)", _BASE))
def first_bases(spark, sf_dir):
    """Base composition of the first 30 positions only (the older report length)."""
    return P.bases(_reads(spark, sf_dir), most=30)


@query(_READS + "SELECT read_no, max(n)::INT AS max_len, max(n) > 2 * 40 AS is_long FROM reads GROUP BY ALL")
def long_reads(spark, sf_dir):
    return P.length_range(_reads(spark, sf_dir)).select("read_no", "max_len", (F.col("max_len") > 2 * 40).alias("is_long"))


_DENSITY = f""",
c AS (SELECT read_no, mapq_bin, n_clipped::INT AS len, count(*) AS n FROM reads GROUP BY ALL),
w AS (SELECT *, sum(n) OVER g AS total, n / sum(n) OVER g AS share, count(*) OVER g AS k FROM c WINDOW g AS (PARTITION BY read_no, mapq_bin)),
q AS (SELECT *, sum(share) OVER (PARTITION BY read_no, mapq_bin ORDER BY len) AS upto FROM w),
q2 AS (SELECT *, lead(upto) OVER g AS upto2, lead(len) OVER g AS len2 FROM q WINDOW g AS (PARTITION BY read_no, mapq_bin ORDER BY len)),
quarters AS (SELECT read_no, mapq_bin, any_value(total) AS total, sum(share * len) AS mean, sum(share * len * len) AS square,
  {", ".join(f"coalesce(max(CASE WHEN upto <= {p} AND upto2 > {p} THEN (len2 - len) / (upto2 - upto) * ({p} - upto) + len END), CASE WHEN min(upto) > {p} THEN min(len) ELSE max(len) END) AS {name}" for p, name in ((0.25, "low"), (0.75, "high")))}
  FROM q2 GROUP BY read_no, mapq_bin),
scaled AS (SELECT *, sqrt(greatest(square - mean * mean, 0)) AS spread FROM quarters),
width AS (SELECT read_no, mapq_bin, 0.9 * CASE WHEN high > low THEN least(spread, (high - low) / 1.349) ELSE spread END * pow(total, -0.2) AS h FROM scaled)
SELECT a.read_no, a.mapq_bin, a.len, round(CASE WHEN any_value(a.k) = 1 THEN 1.0 ELSE sum(exp(-0.5 * pow((a.len - b.len) / h, 2)) * b.share) / any_value(h * sqrt(2 * pi())) END, 9) AS density
FROM w a JOIN w b USING (read_no, mapq_bin) JOIN width USING (read_no, mapq_bin) GROUP BY a.read_no, a.mapq_bin, a.len"""


@query(_READS + _DENSITY)
def length_density(spark, sf_dir):
    found = D.length_density(P.lengths(_reads(spark, sf_dir)))
    return found.withColumn("density", F.round("density", 9))


@query(
    _READS
    + """SELECT read_no, mapq_bin, count(*) AS n FROM (
  SELECT read_no, mapq_bin, round(0.25 * count(*) OVER ()) AS wanted, row_number() OVER (ORDER BY ('0x' || substring(md5(concat(read_id, ':11')), 1, 15))::BIGINT, read_id, flag, seq, qual) AS k FROM reads)
WHERE k <= wanted GROUP BY ALL"""
)
def subsample_counts(spark, sf_dir):
    """Counts of a quarter of the reads, taken exactly."""
    return P.read_counts(P.subsample(_reads(spark, sf_dir), 0.25, seed=11))


_OLD = "#%(+.147:=@BDFHK"
_NEW = "".join(chr(ord(c) + 31) for c in _OLD)


@query(
    _READS
    + f""", two AS (SELECT CASE WHEN read_no = 1 THEN 'on 64' ELSE 'on 33' END AS file, CASE WHEN read_no = 1 THEN translate(q_f, '{_OLD}', '{_NEW}') ELSE q_f END AS q FROM reads),
codes AS ({_cells("q", "ascii(ch)", source="two", key="file")}),
o AS (SELECT file, CASE WHEN min(series) >= 59 AND max(series) > 74 THEN 64 ELSE 33 END AS quality_offset FROM codes GROUP BY file)
SELECT file, quality_offset, pos, greatest(least(series - quality_offset, 41), 0) AS series, sum(n)::BIGINT AS n FROM codes JOIN o USING (file) GROUP BY ALL"""
)
def detected_quality_offsets(spark, sf_dir):
    """First mates written with qualities on 64, as older files have them: each file's offset is found from its counts of codes."""
    first = F.col("read_no") == 1
    reads = _reads(spark, sf_dir).withColumns({"file": F.when(first, "on 64").otherwise("on 33"), "qual_o": F.when(first, F.translate("qual_o", _OLD, _NEW)).otherwise(F.col("qual_o"))})
    codes = D.once(P.qualities(reads, by=["file"], offset=None))
    offsets = D.quality_offsets(codes)
    return D.shifted(codes, offsets, ["file", "pos"]).join(offsets, "file")


@query(
    _READS
    + r""", f AS (SELECT read_no, mapq_bin, nm, length(regexp_replace(md, '\^[A-Za-z]+|[0-9]+', '', 'g')) + coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[ID]', 1), lambda x: x::INT)), 0) AS found FROM reads WHERE mapped AND cigar <> '*')
SELECT read_no, mapq_bin, CASE WHEN nm IS NULL THEN 'no_nm' WHEN found IS NULL THEN 'no_md' WHEN nm = found THEN 'agrees' ELSE 'differs' END AS verdict, count(*) AS n, sum(nm)::BIGINT AS nm_sum, sum(found)::BIGINT AS found_sum FROM f GROUP BY ALL"""
)
def difference_agreement(spark, sf_dir):
    return P.difference_counts(_reads(spark, sf_dir))
