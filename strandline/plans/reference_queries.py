"""The engine's queries over the driver's tables, each with its DuckDB twin.

The tables become sequence-shaped by projections that both engines share: letters of texts to
bases, line items to observations, orders to mates, events to scores.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import filters, scalars
from strandline.operators import align, intervals, kernels, merge, planning, report, sketch, stats
from strandline.sources import records

from . import store
from .registry import query

# ------------------------------------------------------------------ shared projections
_TO, _FROM = "ACGTACGTACGTACGTACGTACGTAC", "abcdefghijklmnopqrstuvwxyz"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seqs(spark: SparkSession, d: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return _t(spark, d, table).select(F.col(key).alias("id"), F.translate(letters, _FROM, _TO).alias("bases"))


def proteins(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.upper(F.regexp_replace(F.lower("text"), "[^a-z]", "")).alias("bases"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    base = lambda i: F.substr(F.lit("ACGT"), i.cast("int") + 1, F.lit(1))
    one = li.select(
        F.col("l_partkey").cast("int").alias("position"),
        base(F.col("l_linenumber") % 4).alias("ref_base"),
        base((F.col("l_linenumber") + 1 + F.col("l_suppkey") % 3) % 4).alias("alt"),
        q.alias("q"),
        F.round(1 - F.col("l_discount"), 4).alias("confidence"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("provenance"),
        (F.col("l_suppkey") % 4).cast("int").alias("file_ord"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_ord"),
        (F.col("l_returnflag") == "R").alias("in_tandem_repeat"),
    )
    return one.select(
        "position", "ref_base", "provenance", "confidence", "file_ord", "row_ord", "in_tandem_repeat",
        F.create_map("ref_base", 50 - F.col("q"), "alt", "q").alias("all_alleles"),
        F.col("q").cast("smallint").alias("mapq"),
        F.concat(F.col("q").cast("string"), F.lit("M1X2I1D")).alias("cigar"),
        (F.col("q") % 7).alias("edit_distance"),
        F.array(F.col("q") % 30, F.col("q") % 13).alias("local_coverage"),
        (F.col("q") % 2).alias("coverage_window_variant_offset"),
        (F.col("q") * F.lit(0.5)).alias("avg_base_quality"),
        F.when(F.col("q") % 3 == 0, "deletion").when(F.col("q") % 3 == 1, "insertion").otherwise("snp").alias("variant_type"),
        F.when(F.col("q") % 2 == 0, 1.0).otherwise(0.5).alias("kmer_uniqueness"),
        (F.col("q") % 5).alias("total_paired_count"),
        F.least(F.col("q") % 5, F.col("q") % 4).alias("proper_pair_count"),
        (F.col("q") * 20).cast("bigint").alias("insert_size_sum"),
        (F.col("q") % 6).alias("insert_size_count"),
        F.when(F.col("q") % 4 == 0, F.lit(None)).otherwise(F.struct((F.col("q") % 4 == 1).alias("mate_mapped"))).alias("mate_info"),
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    insert = F.floor("o_totalprice").cast("int") % 1000 - 500
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("read_idx"), insert.alias("insert_size"), (F.col("o_orderstatus") == "F").alias("proper_pair"))


def placements(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("pos"), F.round(1 - F.col("l_discount"), 4).alias("score"), (F.col("l_suppkey") % 3).alias("space"))


SEQS = f"seqs AS (SELECT doc_id AS id, translate(regexp_replace(lower(text),'[^a-z]','','g'),'{_FROM}','{_TO}') AS bases FROM documents)"
ITEMS = f"items AS (SELECT item_id AS id, translate(regexp_replace(lower(text),'[^a-z]','','g'),'{_FROM}','{_TO}') AS bases FROM benchmark)"
OBS = """o AS (SELECT l_partkey::INT AS position, substr('ACGT', l_linenumber % 4 + 1, 1) AS ref_base,
  substr('ACGT', ((l_linenumber + 1 + l_suppkey % 3) % 4)::INT + 1, 1) AS alt, l_quantity::INT AS q, round(1 - l_discount, 4) AS confidence,
  l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR AS provenance, (l_suppkey % 4)::INT AS file_ord, l_orderkey * 10 + l_linenumber AS row_ord,
  l_returnflag = 'R' AS in_tandem_repeat FROM lineitem),
obs AS (SELECT *, q AS mapq, q::VARCHAR || 'M1X2I1D' AS cigar, q % 7 AS edit_distance, CASE WHEN q % 2 = 0 THEN q % 30 ELSE q % 13 END AS cov, q % 30 AS cov0,
  q * 0.5::DOUBLE AS avg_base_quality, CASE WHEN q % 3 = 0 THEN 'deletion' WHEN q % 3 = 1 THEN 'insertion' ELSE 'snp' END AS variant_type,
  CASE WHEN q % 2 = 0 THEN 1.0 ELSE 0.5 END AS kmer_uniqueness, q / 50.0::DOUBLE AS af,
  (least(q % 5, q % 4)::DOUBLE / nullif(q % 5, 0)) AS ppf, ((q * 20)::DOUBLE / nullif(q % 6, 0)) AS insert_mean,
  CASE WHEN ref_base < alt THEN ref_base || ':' || (50 - q)::VARCHAR || ',' || alt || ':' || q::VARCHAR ELSE alt || ':' || q::VARCHAR || ',' || ref_base || ':' || (50 - q)::VARCHAR END AS alleles FROM o)"""
PLACED = "placed AS (SELECT l_orderkey AS query_id, l_partkey AS pos, round(1 - l_discount, 4) AS score, l_suppkey % 3 AS space FROM lineitem)"
PAIRS = "pairs AS (SELECT o_orderkey AS read_idx, floor(o_totalprice)::INT % 1000 - 500 AS insert_size, o_orderstatus = 'F' AS proper_pair FROM orders)"


def _mins(source: str, name: str, k: int, w: int, canonical: bool = True) -> str:
    mer = "md5(least(f, reverse(translate(f,'ACGT','TGCA'))))" if canonical else "md5(f)"
    return f"""{name}_k AS (SELECT id, i - 1 AS pos, substr(bases, i, {k}) AS f FROM (SELECT id, bases, unnest(generate_series(1, length(bases) - {k - 1})) AS i FROM {source} WHERE length(bases) >= {k + w - 1})),
{name}_w AS (SELECT id, min({{'v': {mer}, 'pos': pos}}) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS m,
  count(*) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS n FROM {name}_k),
{name} AS (SELECT DISTINCT id AS seq_id, m.v AS hash, m.pos::INT AS pos FROM {name}_w WHERE n = {w})"""


# ------------------------------------------------------------------ scalars (F)
@query(f"WITH {SEQS} SELECT id, reverse(translate(bases,'ACGTacgt','TGCAtgca')) AS rc FROM seqs")
def f_reverse_complement(spark, d):
    return seqs(spark, d).select("id", scalars.reverse_complement(F.col("bases")).alias("rc"))


@query("SELECT item_id AS id, CASE WHEN regexp_matches(upper(regexp_replace(lower(text),'[^a-z]','','g')), '[EFILPQ]') THEN 'protein' ELSE 'dna' END AS alphabet FROM benchmark")
def f_detect_alphabet(spark, d):
    return proteins(spark, d).select("id", scalars.detect_alphabet(F.col("bases")).alias("alphabet"))


@query("""SELECT event_id, (v + 2) // 5 * 5 AS q_window, least((v + 2) // 5 * 5, 255) AS q_track, CASE WHEN v % 3 < 2 THEN (v + v % 3) / 2.0 END AS avg_q, CASE WHEN v % 3 = 1 THEN v END AS q_at
FROM (SELECT event_id, floor(value)::INT AS v FROM events)""")
def f_quantize_quality(spark, d):
    v = _t(spark, d, "events").select("event_id", F.floor("value").cast("int").alias("v"))
    quality = F.when(F.col("v") % 3 < 2, F.array(F.col("v"), F.col("v") % 3))
    return v.select("event_id", scalars.quantize(F.col("v"), None).alias("q_window"), scalars.quantize(F.col("v")).alias("q_track"), scalars.avg_quality(quality).alias("avg_q"), F.when(F.col("v") % 3 == 1, scalars.quality_at(quality, F.lit(0))).alias("q_at"))


@query(f"WITH {OBS} SELECT provenance, cov AS coverage, ppf AS proper_fraction, insert_mean, q * 20 <> 0 AND abs(abs(q * 20) - 500) > 150 * 2 AS discordant, af AS alt_frequency, (50 - q) / 50.0 AS ref_frequency, af AS max_alt FROM obs")
def f_observation_scalars(spark, d):
    o = observations(spark, d)
    alt = F.filter(F.map_keys("all_alleles"), lambda k: k != F.col("ref_base"))[0]
    return o.select(
        "provenance",
        scalars.coverage_at_variant(F.col("local_coverage"), F.col("coverage_window_variant_offset")).alias("coverage"),
        scalars.proper_pair_fraction(F.col("proper_pair_count"), F.col("total_paired_count")).alias("proper_fraction"),
        scalars.mean_insert_size(F.col("insert_size_sum"), F.col("insert_size_count")).alias("insert_mean"),
        scalars.is_discordant(F.col("insert_size_sum"), F.lit(500), F.lit(150), 2.0).alias("discordant"),
        scalars.allele_frequency(F.col("all_alleles"), alt).alias("alt_frequency"),
        scalars.allele_frequency(F.col("all_alleles"), F.col("ref_base")).alias("ref_frequency"),
        scalars.max_alt_frequency(F.col("all_alleles"), F.col("ref_base")).alias("max_alt"),
    )


@query(f"WITH {OBS} SELECT provenance, 3 AS mid_ops, 4 AS edits, 2 AS indel_runs, 4 AS n_ops, q AS first_len, 1.0 - (q % 7)::DOUBLE / greatest(q, 1) AS identity, CASE WHEN q % 2 = 0 THEN 1.0 ELSE 0.0 END * (1.0 - (q % 7)::DOUBLE / greatest(q, 1)) AS composite FROM obs")
def f_cigar(spark, d):
    o = observations(spark, d)
    c = F.col("cigar")
    ident = scalars.identity(F.col("edit_distance"), F.col("mapq").cast("int"))
    return o.select(
        "provenance", scalars.extract_cigar_ops(c).alias("mid_ops"), scalars.levenshtein_from_cigar(c).alias("edits"), scalars.indel_runs(c).alias("indel_runs"),
        F.size(scalars.parse_cigar(c)).alias("n_ops"), scalars.parse_cigar(c)[0]["len"].alias("first_len"), ident.alias("identity"),
        scalars.composite_confidence(F.col("kmer_uniqueness") == 1.0, ident).alias("composite"),
    )


@query(f"WITH {SEQS} SELECT id, sha256(bases) AS content_hash, CASE WHEN id % 2 = 0 THEN 'sp_' || id::VARCHAR ELSE substr(sha256(bases), 1, 16) END AS label FROM seqs")
def f_content_hash(spark, d):
    s = seqs(spark, d)
    h = scalars.content_hash(F.col("bases"))
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("sp/"), F.col("id").cast("string")))
    return s.select("id", h.alias("content_hash"), scalars.space_label(name, h).alias("label"))


@query("""SELECT o_orderkey, 'r' || o_orderkey::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN '/2' ELSE '/1' END AS mate,
CASE WHEN o_orderkey % 3 > 0 THEN 'chr' || (o_custkey % 5)::VARCHAR END AS contig, CASE WHEN o_orderkey % 3 > 0 THEN least(o_custkey, o_orderkey) END AS lo, CASE WHEN o_orderkey % 3 > 0 THEN greatest(o_custkey, o_orderkey) END AS hi FROM orders""")
def f_read_names(spark, d):
    o = _t(spark, d, "orders")
    first = F.col("o_orderkey") % 2 == 0
    name = F.concat(F.lit("r"), F.col("o_orderkey").cast("string"), F.when(first, "/1").otherwise("/2"))
    # every third read was placed at random and has no truth
    start = F.when(F.col("o_orderkey") % 3 == 0, "rand_chr").otherwise("chr")
    truth = scalars.truth_of_name(F.concat(start, (F.col("o_custkey") % 5).cast("string"), F.lit("_"), F.col("o_custkey").cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit("_x/1")))
    return o.select("o_orderkey", scalars.mate_id(name, first).alias("mate"), truth["contig"].alias("contig"), truth["lo"].alias("lo"), truth["hi"].alias("hi"))


@query(f"WITH {OBS} SELECT provenance, greatest(position - 5, 0) AS lo, least(position + 6, 1000) AS hi, position - greatest(position - 5, 0) AS off, (q + 4) // 4 AS copies, q * 8 / 100.0 AS ratio FROM obs")
def f_windows_ratios(spark, d):
    w = scalars.local_window(F.col("position"), 5, F.lit(1000))
    q = F.col("mapq").cast("int")
    return observations(spark, d).select("provenance", w["lo"].alias("lo"), w["hi"].alias("hi"), w["offset"].alias("off"), scalars.repeat_count(F.lit(1), q + 4, F.lit(4)).alias("copies"), scalars.compression_ratio(q, F.lit(100)).alias("ratio"))


@query("""SELECT a.p_partkey AS id, coalesce((SELECT min(i) - 1 FROM unnest(generate_series(1, least(length(a.p_name), length(b.p_name)))) t(i) WHERE substr(a.p_name, i, 1) <> substr(b.p_name, i, 1)), least(length(a.p_name), length(b.p_name)))::INT AS prefix
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def f_matching_prefix(spark, d):
    p = _t(spark, d, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(b, "p_partkey").select(F.col("p_partkey").alias("id"), scalars.matching_prefix(F.col("p_name"), F.col("other")).alias("prefix"))


# ------------------------------------------------------------------ predicates (P)
def _passing(t: filters.Thresholds):
    def run(spark, d):
        return filters.apply(observations(spark, d), t).select("provenance", "position")

    return run


def _filter_query(name: str, where: str, t: filters.Thresholds) -> None:
    f = _passing(t)
    f.__name__ = name
    query(f"WITH {OBS} SELECT provenance, position FROM obs WHERE {where}")(f)


_filter_query("p_coverage", "cov >= 5 AND cov <= 20", filters.preset(min_coverage=5, max_coverage=20))
_filter_query("p_mapq", "mapq BETWEEN 10 AND 40", filters.preset(min_mapq=10, max_mapq=40))
_filter_query("p_base_quality", "avg_base_quality >= 12.5", filters.preset(min_base_quality=12.5))
_filter_query("p_allele_frequency", "af >= 0.5", filters.preset(min_allele_frequency=0.5))
_filter_query("p_uniqueness", "kmer_uniqueness >= 0.75", filters.preset(min_kmer_uniqueness=0.75))
_filter_query("p_strict", "cov >= 10 AND mapq >= 30 AND af >= 0.1 AND NOT in_tandem_repeat", filters.preset("strict"))
_filter_query("p_tolerant", "cov >= 3 AND mapq >= 20 AND af >= 0.02", filters.preset("tolerant"))
_filter_query("p_preset_override", "cov >= 10 AND mapq >= 45 AND af >= 0.1 AND NOT in_tandem_repeat", filters.preset("strict", min_mapq=45))
_filter_query("p_proper_pairs", "coalesce(ppf >= 0.6, false)", filters.preset(require_proper_pairs=60.0))
_filter_query("p_discordant", "coalesce(insert_mean <= 200 + 3.0 * 30, true)", filters.preset(exclude_discordant_pairs=(200, 30, 3.0)))
_filter_query("p_insert_size", "coalesce(round(insert_mean) >= 50, true) AND coalesce(round(insert_mean) <= 400, true)", filters.preset(min_insert_size=50, max_insert_size=400))
_filter_query("p_mates_mapped", "q % 4 = 1", filters.preset(require_both_mates_mapped=True))


@query(f"WITH {OBS} SELECT provenance FROM obs WHERE (mapq >= 30 AND NOT (cov < 5 OR in_tandem_repeat)) OR (af > 0.9 AND confidence != 1 AND edit_distance <= 3)")
def p_expression(spark, d):
    e = filters.parse_expression("mapq >= 30 && !(coverage < 5 || in_tandem_repeat == 1) || allele_frequency > 0.9 && confidence != 1 && edit_distance <= 3")
    return observations(spark, d).filter(e).select("provenance")


@query(f"""WITH {OBS} SELECT outcome, count(*) AS reads FROM (SELECT CASE WHEN q % 10 = 0 THEN 'no_alignment' WHEN (q % 7)::DOUBLE / greatest(q, 1) > 0.20 THEN 'fast_cutoff'
  WHEN 1.0 - (q % 7)::DOUBLE / greatest(q, 1) >= 0.95 THEN 'placed' WHEN q % 9 = 0 THEN 'no_seed' ELSE 'below_threshold' END AS outcome FROM obs) GROUP BY 1""")
def p_outcomes(spark, d):
    q = F.col("mapq").cast("int")
    edit = F.when(q % 10 != 0, F.col("edit_distance"))
    return stats.outcomes(observations(spark, d).select(filters.outcome(F.when(q % 9 == 0, 0).otherwise(1), edit, q, filters.FAST_DIVERGENCE).alias("outcome")))


@query(f"""WITH {OBS} SELECT outcome, count(*) AS reads FROM (SELECT CASE WHEN 1.0 - (q % 7)::DOUBLE / greatest(q, 1) >= 0.95 THEN 'placed' WHEN q % 9 = 0 THEN 'no_seed' ELSE 'below_threshold' END AS outcome FROM obs) GROUP BY 1""")
def p_outcomes_balanced(spark, d):
    """Without a cutoff, a placed read may have come from the fallback anchor."""
    q = F.col("mapq").cast("int")
    return stats.outcomes(observations(spark, d).select(filters.outcome(F.when(q % 9 != 0, q), F.col("edit_distance"), q).alias("outcome")))


@query(f"WITH {OBS} SELECT provenance FROM obs WHERE (q % 7)::DOUBLE / greatest(q, 1) <= 0.20")
def p_divergence_cutoff(spark, d):
    return observations(spark, d).filter(filters.within_divergence(F.col("edit_distance"), F.col("mapq").cast("int"))).select("provenance")


@query(f"WITH {SEQS} SELECT CASE WHEN length(bases) >= 5000 THEN 'contig' ELSE 'read' END AS kind, count(*) AS n FROM seqs GROUP BY 1")
def p_read_or_contig(spark, d):
    return seqs(spark, d).groupBy(filters.read_or_contig(F.col("bases")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, (f & 1) <> 0 AS paired, (f & 2) <> 0 AS proper, (f & 8) <> 0 AS mate_unmapped, (f & 64) <> 0 AS first FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT % 256 AS f FROM orders)")
def p_sam_flags(spark, d):
    f = F.floor("o_totalprice").cast("bigint") % 256
    return _t(spark, d, "orders").select("o_orderkey", filters.flag(f, "paired").alias("paired"), filters.flag(f, "proper_pair").alias("proper"), filters.flag(f, "mate_unmapped").alias("mate_unmapped"), filters.flag(f, "first").alias("first"))


@query(f"WITH {OBS}, r AS (SELECT file_ord, position, provenance, edit_distance AS e, 50 AS l, row_number() OVER (PARTITION BY position ORDER BY edit_distance, provenance) AS rn, min(edit_distance) OVER (PARTITION BY position) AS best FROM obs) SELECT provenance, rn = 1 AS is_primary FROM r WHERE rn = 1 OR (1 - e / 50.0) / (1 - best / 50.0) >= 0.95")
def p_retention(spark, d):
    o = observations(spark, d)
    rank = F.row_number().over(Window.partitionBy("position").orderBy("provenance"))
    a = o.select(F.col("position").cast("string").alias("query_id"), F.lit("+").alias("strand"), rank.alias("rank"), "edit_distance", F.lit(50).alias("query_length"), "provenance")
    return align.score(a).select("provenance", "is_primary")


# ------------------------------------------------------------------ sketches and joins
@query(f"WITH {SEQS}, {_mins('seqs', 'm', 21, 11)} SELECT seq_id, hash, pos FROM m")
def w_minimizers(spark, d):
    return sketch.deduplicate(sketch.sketch(seqs(spark, d), order="md5"))


@query(f"WITH prot AS (SELECT item_id AS id, upper(regexp_replace(lower(text),'[^a-z]','','g')) AS bases FROM benchmark), {_mins('prot', 'm', 6, 5, False)} SELECT seq_id, hash, pos FROM m")
def w_minimizers_protein(spark, d):
    return sketch.sketch(proteins(spark, d), alphabet="protein", order="md5")


@query(f"WITH {ITEMS}, {_mins('items', 'm', 21, 5)}, {_mins('items', 'u', 21, 11)} SELECT m.seq_id, m.hash, m.pos, u.hash IS NOT NULL AS usual FROM m LEFT JOIN u ON u.seq_id = m.seq_id AND u.hash = m.hash AND u.pos = m.pos")
def w_dense_membership(spark, d):
    return sketch.dense_membership(seqs(spark, d, "benchmark", "item_id"), order="md5")


_SEED_SQL = f"""WITH {SEQS}, {ITEMS}, {_mins('items', 'q', 21, 11)}, {_mins('seqs', 't', 21, 11)},
n AS (SELECT seq_id, hash, count(*) AS occ FROM t GROUP BY 1, 2),
c AS (SELECT seq_id, greatest(256, 8 * list_sort(list(occ))[len(list(occ)) // 2 + 1]) AS cap FROM n GROUP BY 1)"""


@query(_SEED_SQL + " SELECT q.seq_id AS query_id, t.seq_id AS target_id, q.pos AS query_pos, t.pos AS target_pos, t.hash FROM q JOIN t USING (hash) JOIN n ON n.seq_id = t.seq_id AND n.hash = t.hash JOIN c ON c.seq_id = t.seq_id WHERE occ <= cap")
def j_seeds_capped(spark, d):
    return sketch.seeds_of(seqs(spark, d, "benchmark", "item_id"), seqs(spark, d), order="md5")


@query(f"WITH {SEQS}, {ITEMS}, {_mins('items', 'q', 21, 11)}, {_mins('seqs', 't', 21, 11)} SELECT q.seq_id AS query_id, t.seq_id AS target_id, q.pos AS query_pos, t.pos AS target_pos, t.hash FROM q JOIN t USING (hash)")
def j_seeds_uncapped(spark, d):
    return sketch.seeds_of(seqs(spark, d, "benchmark", "item_id"), seqs(spark, d), order="md5", floor=None)


@query(f"WITH {SEQS}, {ITEMS}, {_mins('items', 'q', 21, 11)}, {_mins('seqs', 't', 21, 11)} SELECT id_a, id_b, count(*) AS common FROM (SELECT DISTINCT seq_id AS id_a, hash FROM q) JOIN (SELECT DISTINCT seq_id AS id_b, hash FROM t) USING (hash) GROUP BY 1, 2")
def j_shared_minimizers(spark, d):
    return sketch.shared(sketch.sketch(seqs(spark, d, "benchmark", "item_id"), order="md5"), sketch.sketch(seqs(spark, d), order="md5"))


@query(_SEED_SQL + " SELECT seq_id AS target_id, cap::BIGINT AS cap FROM c")
def j_occurrence_cap(spark, d):
    return sketch.occurrence_cap(sketch.sketch(seqs(spark, d), order="md5"))


_JACCARD_SQL = f"""WITH {ITEMS}, {_mins('items', 'm', 21, 11)}, h AS (SELECT DISTINCT seq_id, hash FROM m), n AS (SELECT seq_id, count(*) AS n FROM h GROUP BY 1),
j AS (SELECT a.seq_id AS id_a, b.seq_id AS id_b, count(*) AS common FROM h a JOIN h b USING (hash) GROUP BY 1, 2),
s AS (SELECT id_a, id_b, common, common::DOUBLE / (x.n + y.n - common) AS jaccard FROM j JOIN n x ON x.seq_id = id_a JOIN n y ON y.seq_id = id_b)"""


@query(_JACCARD_SQL + " SELECT id_a, id_b, common, jaccard FROM s")
def a_jaccard(spark, d):
    s = sketch.sketch(seqs(spark, d, "benchmark", "item_id"), order="md5")
    return sketch.jaccard(s, s)


@query(_JACCARD_SQL + """ SELECT a.id AS id_a, b.id AS id_b, coalesce(s.common, 0) AS common, CASE WHEN x.n IS NULL AND y.n IS NULL THEN 1.0 ELSE coalesce(s.jaccard, 0) END AS jaccard
FROM items a JOIN items b ON a.id < b.id LEFT JOIN s ON s.id_a = a.id AND s.id_b = b.id LEFT JOIN n x ON x.seq_id = a.id LEFT JOIN n y ON y.seq_id = b.id""")
def a_jaccard_all(spark, d):
    items = seqs(spark, d, "benchmark", "item_id")
    pairs = planning.tasks_all_pairs(items.select("id", F.col("id").alias("idx"))).select(F.col("query_id").alias("id_a"), F.col("target_id").alias("id_b"))
    return sketch.jaccard_all(sketch.sketch(items, order="md5"), pairs)


@query(_JACCARD_SQL + """, i AS (SELECT id, id AS idx FROM items), p AS (SELECT a.id, a.idx, median(coalesce(s.jaccard, 0)) AS med FROM i a JOIN i b ON a.idx <> b.idx LEFT JOIN s ON s.id_a = a.id AND s.id_b = b.id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY med, idx) AS r, count(*) OVER () AS n FROM p) SELECT id, idx, round(med, 9) AS median FROM r WHERE r = n // 2 + 1""")
def a_centroid(spark, d):
    items = seqs(spark, d, "benchmark", "item_id")
    return sketch.select_centroid(sketch.sketch(items, order="md5"), items.select("id", F.col("id").alias("idx"))).withColumn("median", F.round("median", 9))


@query(f"WITH {SEQS}, {_mins('seqs', 'm', 21, 11)}, n AS (SELECT hash, pos, count(*) AS n FROM m GROUP BY 1, 2) SELECT pos, min(1.0::DOUBLE / n) AS uniqueness FROM n GROUP BY 1")
def a_kmer_uniqueness(spark, d):
    return sketch.kmer_uniqueness(sketch.sketch(seqs(spark, d), order="md5"))


_HOT = "h AS (SELECT user_id AS pos, 1.0 / count(*) AS score FROM events GROUP BY 1), l AS (SELECT DISTINCT pos FROM h WHERE score < 0.015), i AS (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM l), spots AS (SELECT min(pos) AS start, max(pos) AS \"end\" FROM i GROUP BY g)"


def _hotspots(spark, d):
    scores = _t(spark, d, "events").groupBy(F.col("user_id").alias("pos")).agg((F.lit(1.0) / F.count("*")).alias("score"))
    return intervals.hotspots(scores, 0.015)


@query(f'WITH {_HOT} SELECT start, "end" FROM spots')
def w_hotspots(spark, d):
    return _hotspots(spark, d)


@query(f'WITH {_HOT} SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM spots WHERE l_partkey >= start AND l_partkey < "end") AS in_hotspot FROM lineitem')
def j_hotspot_range(spark, d):
    points = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return intervals.in_interval(points, _hotspots(spark, d), "in_hotspot", 64, "l_partkey").select("l_orderkey", "l_linenumber", "in_hotspot")


@query("""SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM (SELECT DISTINCT p_partkey * 7 AS start, p_partkey * 7 + p_size % 5 AS "end" FROM part) WHERE l_partkey >= start AND l_partkey < "end") AS in_repeat FROM lineitem""")
def j_repeat_range(spark, d):
    points = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    regions = _t(spark, d, "part").select((F.col("p_partkey") * 7).alias("start"), (F.col("p_partkey") * 7 + F.col("p_size") % 5).alias("end"))
    return intervals.in_interval(points, regions, "in_repeat", 64, "l_partkey").select("l_orderkey", "l_linenumber", "in_repeat")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus = 'F' AS mate_mapped FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) ON o_orderkey = l_orderkey")
def j_mate_lookup(spark, d):
    mates = _t(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").alias("mate_mapped"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(mates, "l_orderkey", "left")


@query(f"WITH {SEQS} SELECT s.id, coalesce(a.k, b.k, length(s.bases)) AS sketch_key FROM seqs s LEFT JOIN (SELECT id, id * 2 AS k FROM seqs WHERE id % 5 = 0) a ON a.id = s.id LEFT JOIN (SELECT id, id * 3 AS k FROM seqs WHERE id % 3 = 0) b ON b.id = s.id")
def j_fallback_lookup(spark, d):
    s = seqs(spark, d)
    stored = s.filter("id % 5 = 0").select("id", (F.col("id") * 2).alias("a"))
    dense = s.filter("id % 3 = 0").select("id", (F.col("id") * 3).alias("b"))
    return s.join(stored, "id", "left").join(dense, "id", "left").select("id", F.coalesce("a", "b", F.length("bases").cast("bigint")).alias("sketch_key"))


@query(f"WITH {SEQS}, p AS (SELECT DISTINCT sha256(bases) AS h FROM seqs WHERE id % 10 = 0) SELECT id FROM seqs WHERE sha256(bases) NOT IN (SELECT h FROM p)")
def j_read_pool_anti(spark, d):
    s = seqs(spark, d)
    palette = s.filter("id % 10 = 0").select(scalars.content_hash(F.col("bases")).alias("content_hash"))
    return planning.read_pool(s, palette).select("id")


@query(f"WITH {SEQS}, p AS (SELECT DISTINCT sha256(bases) AS h FROM seqs WHERE id % 10 = 0) SELECT id, sha256(bases) IN (SELECT h FROM p) AS hit FROM seqs")
def j_palette_resolution(spark, d):
    s = seqs(spark, d).withColumn("content_hash", scalars.content_hash(F.col("bases")))
    return planning.resolve_palette(s, s.filter("id % 10 = 0")).select("id", "hit")


@query(f"WITH {SEQS}, {ITEMS}, {_mins('items', 'q', 21, 11)}, {_mins('seqs', 't', 21, 11)} SELECT q.seq_id AS query_id, t.seq_id % 4 AS space, t.pos - q.pos AS diagonal, count(*) AS votes FROM q JOIN t USING (hash) GROUP BY 1, 2, 3")
def j_palette_spaces(spark, d):
    q = sketch.sketch(seqs(spark, d, "benchmark", "item_id"), order="md5")
    t = sketch.sketch(seqs(spark, d), order="md5").select((F.col("seq_id") % 4).alias("space"), "hash", "pos")
    return planning.placements_by_space(q, t)


@query("SELECT a.item_id AS query_idx, b.item_id AS target_idx FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id")
def u_tasks_all_pairs(spark, d):
    i = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("item_id").alias("idx"))
    return planning.tasks_all_pairs(i).select("query_idx", "target_idx")


@query("SELECT item_id AS query_idx, 3::BIGINT AS target_idx FROM benchmark WHERE item_id <> 3")
def u_tasks_centroid(spark, d):
    i = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("item_id").alias("idx"))
    return planning.tasks_to_centroid(i, i.filter("idx = 3")).select("query_idx", "target_idx")


@query("SELECT item_id AS query_idx, 0::BIGINT AS target_idx FROM benchmark")
def u_tasks_reference(spark, d):
    i = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("item_id").alias("idx"))
    return planning.tasks_to_reference(i, i.filter("idx = 0")).select("query_idx", "target_idx")


_INPUTS = "i AS (SELECT length(bases) AS n, g FROM seqs, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS g) WHERE g < 3 AND id % 3 <= g OR g = 3 AND id < 1 OR g = 4 AND length(bases) >= 5000 OR g = 5 AND id < 9)"


@query(f"""WITH {SEQS}, {_INPUTS}, f AS (SELECT g, count(*) AS n, CASE WHEN g < 3 THEN g + 1 ELSE 1 END AS files, min((n >= 5000)::INT) AS long FROM i GROUP BY g)
SELECT g AS input, CASE WHEN files > 1 THEN 3 WHEN n > 1 THEN 4 ELSE 1 END AS alone, CASE WHEN long = 1 THEN 4 ELSE 2 END AS on_reference FROM f""")
def u_use_case(spark, d):
    """One, two and three files; one sequence; long ones alone; several short ones: each with and without a reference."""
    s = seqs(spark, d)
    chosen = [(s.filter(F.col("id") % 3 <= g), F.col("id") % 3) for g in range(3)]
    chosen += [(s.filter("id < 1"), F.lit(0)), (s.filter("length(bases) >= 5000"), F.lit(0)), (s.filter("id < 9"), F.lit(0))]
    out = None
    for g, (rows, file) in enumerate(chosen):
        rows = rows.select(file.alias("file_idx"), "bases")
        one = planning.use_case(rows, False).withColumnRenamed("use_case", "alone").join(F.broadcast(planning.use_case(rows, True).withColumnRenamed("use_case", "on_reference"))).withColumn("input", F.lit(g))
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(s.agg(F.max(F.length("bases")).alias("longest")))).filter("input <> 4 OR longest >= 5000").drop("longest")


# ------------------------------------------------------------------ merge and report
@query(f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY position, alleles, provenance ORDER BY file_ord, row_ord) AS rn FROM obs) SELECT position, alleles, provenance, file_ord FROM r WHERE rn = 1")
def u_merge_dedup(spark, d):
    o = observations(spark, d)
    twice = o.unionByName(o.filter("mapq > 25").withColumn("file_ord", F.col("file_ord") + 10))
    return merge.deduplicate(twice).select("position", report.alleles_text(F.col("all_alleles")).alias("alleles"), "provenance", "file_ord")


@query(f"WITH {OBS} SELECT provenance, count(*) OVER (PARTITION BY position)::INT AS depth, sum(q % 5) OVER (PARTITION BY position)::BIGINT AS total_paired_count, sum(q * 20) OVER (PARTITION BY position)::BIGINT AS insert_size_sum FROM (SELECT DISTINCT * FROM obs)")
def a_merge_totals(spark, d):
    return merge.merge(observations(spark, d)).select("provenance", F.get("local_coverage", F.lit(0)).alias("depth"), "total_paired_count", "insert_size_sum")


_VCF = f"""{OBS}, f AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY file_ord, row_ord) AS rn FROM obs),
a AS (SELECT position, array_to_string(list_sort(list(DISTINCT alt)), '') AS alts FROM obs GROUP BY 1),
v AS (SELECT 'ref' AS chrom, (position + 1)::BIGINT AS pos, CASE WHEN variant_type = 'insertion' THEN '.' ELSE ref_base END AS ref,
  CASE variant_type WHEN 'deletion' THEN '.' WHEN 'insertion' THEN CASE WHEN ref_base < alt THEN ref_base || alt ELSE alt || ref_base END ELSE alts END AS alt,
  round_even(confidence * 100, 0)::BIGINT AS qual, 'PASS' AS filter, 'DP=' || cov::VARCHAR || ';MQ=' || mapq::VARCHAR || ';CIGAR=' || cigar || ';ED=' || edit_distance::VARCHAR AS info, '0/1:' || floor(confidence * 100)::BIGINT::VARCHAR AS sample
FROM f JOIN a USING (position) WHERE rn = 1)"""


@query(f"WITH {_VCF} SELECT * FROM v")
def k_vcf_rows(spark, d):
    return report.vcf_rows(observations(spark, d))


@query("""SELECT * FROM (VALUES (0, '##fileformat=VCFv4.2'), (1, '##contig=<ID=ref,length=1000>'), (2, '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total depth">'),
(3, '##INFO=<ID=MQ,Number=1,Type=Integer,Description="Mapping quality">'), (4, '##INFO=<ID=CIGAR,Number=1,Type=String,Description="CIGAR string">'), (5, '##INFO=<ID=ED,Number=1,Type=Integer,Description="Edit distance">'),
(6, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'), (7, '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">'),
(8, '#CHROM' || chr(9) || 'POS' || chr(9) || 'ID' || chr(9) || 'REF' || chr(9) || 'ALT' || chr(9) || 'QUAL' || chr(9) || 'FILTER' || chr(9) || 'INFO' || chr(9) || 'FORMAT' || chr(9) || 'SAMPLE')) t(n, line)""")
def k_vcf_header(spark, d):
    return spark.createDataFrame(list(enumerate(report.vcf_header("ref", 1000))), "n int, line string")


@query(f"""WITH {_VCF} SELECT pos, chrom || t || pos::VARCHAR || t || '.' || t || ref || t || alt || t || qual::VARCHAR || t || filter || t || info || t || 'GT:GQ' || t || sample AS line FROM v, (SELECT chr(9) AS t)""")
def k_vcf_file(spark, d):
    """The body of a written file, read again; its header goes by itself."""
    path = f"{store.scratch(spark)}/vcf"
    report.write_vcf(observations(spark, d), path, "ref", 1000)
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    return lines.select(F.split("value", "\t")[1].cast("bigint").alias("pos"), F.col("value").alias("line"))


@query(f"WITH {OBS} SELECT position::VARCHAR AS position, ref_base AS ref, alt, cov::VARCHAR AS coverage, mapq::VARCHAR AS mapq, edit_distance::VARCHAR AS edit_distance, provenance FROM obs")
def k_tsv_library(spark, d):
    return report.tsv_library(observations(spark, d), ("position", "ref", "alt", "coverage", "mapq", "edit_distance", "provenance"))


@query(f"WITH {OBS} SELECT avg_base_quality AS quality, confidence, provenance FROM obs")
def k_tsv_library_numbers(spark, d):
    return report.tsv_library(observations(spark, d), ("quality", "confidence", "provenance")).select(F.col("quality").cast("double").alias("quality"), F.col("confidence").cast("double").alias("confidence"), "provenance")


@query("SELECT event_id, replace(replace(event_type || chr(9) || props || chr(10) || 'x', chr(9), '\\t'), chr(10), '\\n') AS escaped FROM events")
def k_tsv_escapes(spark, d):
    return _t(spark, d, "events").select("event_id", report.escape_tsv(F.concat("event_type", F.lit("\t"), "props", F.lit("\nx"))).alias("escaped"))


@query(f"WITH {OBS} SELECT position::VARCHAR || chr(9) || ref_base || chr(9) || alleles || chr(9) || mapq::VARCHAR AS line FROM obs")
def k_tsv_file(spark, d):
    """A written table of four columns, read again without its header."""
    path = f"{store.scratch(spark)}/tsv"
    report.write_tsv(report.tsv_cli(observations(spark, d)).select("position", "ref_base", "alleles", "mapq"), path)
    return spark.read.text(path).filter("value <> 'position\tref_base\talleles\tmapq'").select(F.col("value").alias("line"))


@query(f"WITH {OBS} SELECT position, ref_base, alleles, confidence, cigar, mapq::SMALLINT AS mapq, edit_distance, cov0 AS coverage, avg_base_quality, provenance FROM obs")
def k_tsv_cli(spark, d):
    return report.tsv_cli(observations(spark, d)).withColumn("alleles", report.normalise_alleles(F.col("alleles")))


@query(f"WITH {PLACED} SELECT query_id, pos, score FROM placed WHERE score >= 0.95")
def k_query_index(spark, d):
    return store.query_index(placements(spark, d)).select("query_id", "pos", "score")


@query(f"WITH {PLACED} SELECT query_id, space, pos, score AS identity FROM placed WHERE score >= 0.95")
def k_cross_space_index(spark, d):
    return store.cross_space_index(placements(spark, d).withColumnRenamed("score", "identity")).select("query_id", "space", "pos", "identity")


@query(f"WITH {PLACED} SELECT query_id, pos, score FROM placed WHERE score >= 0.95")
def s_query_index(spark, d):
    """An index written and read again."""
    path = f"{store.scratch(spark)}/queries"
    store.write_queries(store.query_index(placements(spark, d)).select("query_id", "pos", "score"), path)
    return store.read_queries(spark, path)


@query(f"WITH {PLACED} SELECT query_id, space, pos, score AS identity FROM placed WHERE score >= 0.95")
def s_cross_space_index(spark, d):
    path = f"{store.scratch(spark)}/spaces"
    store.write_queries(store.cross_space_index(placements(spark, d).withColumnRenamed("score", "identity")).select("query_id", "space", "pos", "identity"), path)
    return store.read_cross_space_queries(spark, path)


@query("SELECT doc_id AS id, (doc_id % 3)::INT AS chunk_id, n_chars FROM documents WHERE doc_id % 3 = 1")
def s_plan(spark, d):
    """One worker's chunk of a written plan."""
    path = f"{store.scratch(spark)}/plan"
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).cast("int").alias("chunk_id"), "n_chars")
    store.write_plan(path, {"tasks": docs, "spare": docs.select("id")}, {"k": 21})
    assert store.read_contents(spark, path)["tables"] == ["spare", "tasks"]
    return store.read_plan(spark, path, worker=1, only=("tasks",))[1]["tasks"].select("id", "chunk_id", "n_chars")


@query(f"WITH {OBS} SELECT provenance, 1000 AS reference_length, 's1' AS sample_id, '2020-01-01T00:00:00+00:00' AS timestamp, (SELECT count(*) FROM obs WHERE q = 7) AS coverage_rows FROM obs WHERE mapq >= 30")
def s_observations(spark, d):
    """Observations written, filtered into another file, and read again with what the first one said."""
    path, out = (f"{store.scratch(spark)}/{x}" for x in ("observations", "filtered"))
    o = observations(spark, d)
    store.write_observations(o, o.filter("mapq = 7").select("position"), path, 1000, "s1", "2020-01-01T00:00:00+00:00")
    store.write_filtered(spark, path, filters.condition(filters.preset(min_mapq=30)), out)
    meta, kept, coverage = store.read_observations(spark, out)
    said = [F.lit(meta["reference_length"]).alias("reference_length"), F.lit(meta["sample_id"]).alias("sample_id"), F.lit(meta["timestamp"]).alias("timestamp"), F.lit(coverage.count()).alias("coverage_rows")]
    return kept.select("provenance", *said)


@query("SELECT a.item_id::VARCHAR AS query_id, b.item_id::VARCHAR AS target_id FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id")
def k_task_list(spark, d):
    i = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("item_id").alias("idx"))
    path = f"{store.scratch(spark)}/tasks"
    store.write_tasks(planning.tasks_all_pairs(i), path)
    return spark.read.option("sep", "\t").option("header", True).schema("query_id string, target_id string").csv(path)


@query(f"WITH {SEQS} SELECT id::VARCHAR AS id, 'doc of ' || id::VARCHAR AS description, bases FROM seqs")
def s_fasta(spark, d):
    """Sequences written as FASTA in lines, and read again as splittable text."""
    path = f"{store.scratch(spark)}/fasta"
    lines = F.regexp_replace("bases", "(.{60})(?=.)", "$1\n")
    seqs(spark, d).select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit(" doc of "), F.col("id").cast("string"), F.lit("\n"), lines)).write.mode("overwrite").option("compression", "gzip").text(path)
    return records.read_fasta_text(spark, path)


@query(f"WITH {ITEMS} SELECT id::VARCHAR AS id, bases, length(bases)::INT AS n_quality, 73::INT AS quality, 0 AS seq_idx FROM items WHERE bases <> ''")
def s_fastq(spark, d):
    """One gzipped FASTQ file a passage, sniffed by its first byte."""
    path = f"{store.scratch(spark)}/fastq"
    rows = seqs(spark, d, "benchmark", "item_id").filter("bases <> ''")
    rows.select(F.concat(F.lit("@"), F.col("id").cast("string"), F.lit("\n"), "bases", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("bases"))).alias("value"), "id").repartition("id").write.mode("overwrite").partitionBy("id").option("compression", "gzip").text(path)
    read = records.read_sequences(spark, f"{path}/*/*.gz")
    return read.select("id", "bases", F.size("quality").alias("n_quality"), F.array_max("quality").cast("int").alias("quality"), F.col("seq_idx").cast("int").alias("seq_idx"))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents) SELECT least(idx // ceil(n / 7)::BIGINT, 6)::INT AS chunk_id, count(*) AS items FROM r GROUP BY 1")
def k_chunks(spark, d):
    n = _t(spark, d, "documents").count()
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("idx"))
    return planning.chunk_sizes(docs, 7) if n else docs.select(F.lit(0).alias("chunk_id"), F.lit(0).cast("bigint").alias("items"))


@query("WITH c AS (SELECT l_suppkey % 6 AS file_idx, count(*) AS items FROM lineitem GROUP BY 1) SELECT file_idx, coalesce(sum(items) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, items FROM c WHERE file_idx > 0")
def w_global_to_local(spark, d):
    return planning.global_to_local(_t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 6).alias("file_idx")).agg(F.count("*").alias("items")))


@query("SELECT 'out.' || s_suppkey::VARCHAR || '.tsv' AS path FROM supplier WHERE s_suppkey % 4 <> 1")
def u_missing_outputs(spark, d):
    s = _t(spark, d, "supplier")
    path = planning.worker_path("out.{worker}.tsv", F.col("s_suppkey"))
    return planning.missing_outputs(s.select(path.alias("path")), s.filter("s_suppkey % 4 = 1").select(path.alias("path")))


# ------------------------------------------------------------------ coverage
_SWEEP = """ev AS (SELECT l_suppkey % 4 AS ref_id, l_partkey AS pos, 1 AS d FROM lineitem UNION ALL SELECT l_suppkey % 4, l_partkey + l_quantity::INT, -1 FROM lineitem),
pt AS (SELECT ref_id, pos, sum(d) AS d FROM ev GROUP BY 1, 2),
sw AS (SELECT ref_id, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w::BIGINT AS depth FROM pt WINDOW w AS (PARTITION BY ref_id ORDER BY pos))"""


@query(f'WITH {_SWEEP.replace("OVER w::BIGINT", "OVER w")} SELECT ref_id, start, "end", depth::BIGINT AS depth FROM sw WHERE "end" IS NOT NULL AND depth <> 0')
def a_coverage_sweep(spark, d):
    li = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("ref_id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("int")).alias("end"))
    return intervals.coverage_sweep(li)


_POINTS = "p AS (SELECT 0 AS ref_id, l_partkey AS pos, least((count(*) + 2) // 5 * 5, 255)::INT AS v FROM lineitem GROUP BY 2), b AS (SELECT *, coalesce(v <> lag(v) OVER w OR pos <> lag(pos) OVER w + 1, true)::INT AS new FROM p WINDOW w AS (ORDER BY pos)), g AS (SELECT *, sum(new) OVER (ORDER BY pos) AS run FROM b)"


def _points(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.lit(0).alias("ref_id"), F.col("l_partkey").alias("pos")).agg(F.count("*").alias("value"))


@query(f"WITH {_POINTS} SELECT ref_id, min(pos) AS start, count(*)::INT AS length, v AS value FROM g GROUP BY ref_id, run, v")
def w_rle_encode(spark, d):
    return intervals.rle_encode(_points(spark, d))


@query(f"WITH {_POINTS} SELECT ref_id, pos, v AS value FROM p")
def w_rle_decode(spark, d):
    return intervals.rle_decode(intervals.rle_encode(_points(spark, d)))


@query(f"WITH {_POINTS} SELECT p_partkey, p_size, v AS value FROM part LEFT JOIN p ON pos = p_partkey + p_size")
def w_coverage_at(spark, d):
    points = _t(spark, d, "part").select(F.lit(0).alias("ref_id"), (F.col("p_partkey") + F.col("p_size")).alias("pos"), "p_partkey", "p_size")
    return intervals.coverage_at(intervals.rle_encode(_points(spark, d)), points).select("p_partkey", "p_size", "value")


@query("""WITH r AS (SELECT l_suppkey % 2 AS ref_id, l_partkey AS start, l_quantity::INT AS length, l_linenumber * 5 AS v FROM lineitem),
ev AS (SELECT ref_id, start AS pos, v AS d FROM r UNION ALL SELECT ref_id, start + length, -v FROM r), pt AS (SELECT ref_id, pos, sum(d) AS d FROM ev GROUP BY 1, 2),
sw AS (SELECT ref_id, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w AS depth FROM pt WINDOW w AS (PARTITION BY ref_id ORDER BY pos))
SELECT ref_id, start, "end", least((depth::BIGINT + 2) // 5 * 5, 255)::INT AS value FROM sw WHERE "end" IS NOT NULL AND depth <> 0""")
def a_coverage_merge(spark, d):
    li = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 2).alias("ref_id"), F.col("l_partkey").alias("start"), F.col("l_quantity").cast("int").alias("length"), (F.col("l_linenumber") * 5).alias("value"))
    return intervals.merge_coverage(li)


# ------------------------------------------------------------------ statistics
@query(f"""WITH {PAIRS}, s AS (SELECT insert_size::BIGINT AS x FROM pairs WHERE proper_pair AND insert_size <> 0 ORDER BY read_idx LIMIT 10000),
a AS (SELECT count(*) AS n, sum(x) AS s, sum(x * x) AS s2 FROM s), b AS (SELECT *, trunc(s / n)::BIGINT AS m FROM a)
SELECT m::INT AS mean, floor(sqrt((s2 - 2 * m * s + n * m * m)::DOUBLE / n))::INT AS std_dev, 'FR' AS orientation, n::INT AS sample_size FROM b WHERE n >= 100""")
def a_insert_sizes(spark, d):
    return stats.insert_size_distribution(stats.insert_size_sample(pairs(spark, d)))


@query(f"WITH {PLACED}, n AS (SELECT query_id, count(*) AS n FROM placed GROUP BY 1) SELECT pos, round(avg((n > 1)::INT), 9) AS fraction FROM (SELECT DISTINCT query_id, pos FROM placed) JOIN n USING (query_id) GROUP BY 1")
def a_multi_map_fraction(spark, d):
    return stats.multi_map_fraction(placements(spark, d)).withColumn("fraction", F.round("fraction", 9))


_BEST = "best AS (SELECT query_id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r FROM placed) WHERE r = 1)"


@query(f"WITH {PLACED}, {_BEST} SELECT query_id, pos, score FROM best")
def t_best_placement(spark, d):
    return stats.best_placement(placements(spark, d))


_SHARES = "count(*) AS mapped, count(ok) AS evaluated, count(*) FILTER (ok) AS correct, coalesce(round((count(*) FILTER (ok))::DOUBLE / nullif(count(ok), 0), 9), 0) AS accuracy, greatest(70000 - count(*), 0) AS unaligned, round(greatest(70000 - count(*), 0)::DOUBLE / 70000, 9) AS unaligned_fraction"


@query(f"""WITH {PLACED}, {_BEST}, t AS (SELECT o_orderkey AS query_id, o_custkey AS lo, o_custkey + 300 AS hi FROM orders WHERE o_orderkey % 4 <> 0),
j AS (SELECT abs(pos - lo) <= 10 OR abs(pos - hi) <= 10 OR abs(pos - (hi - 149)) <= 10 AS ok FROM best LEFT JOIN t USING (query_id)) SELECT {_SHARES} FROM j""")
def a_placement_accuracy(spark, d):
    """Over placed reads that have a truth; a quarter has none."""
    t = _t(spark, d, "orders").filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("lo"), (F.col("o_custkey") + 300).alias("hi"), F.lit(150).alias("read_length"))
    return _rounded(stats.placement_accuracy(placements(spark, d), t, total=70_000))


@query(f"WITH {PLACED}, {_BEST}, j AS (SELECT abs(pos - o_custkey) <= 3 AS ok FROM best LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) ON query_id = o_orderkey) SELECT {_SHARES} FROM j")
def a_start_accuracy(spark, d):
    t = _t(spark, d, "orders").filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("start"))
    named = placements(spark, d).withColumn("query_id", F.concat(F.col("query_id").cast("string"), F.lit(" a header")))
    return _rounded(stats.start_accuracy(named, t, total=70_000))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c, kind in df.dtypes if kind == "double"})


@query(f"WITH {OBS} SELECT count(*) AS reads, sum((q % 4 = 2)::INT)::BIGINT AS concordant, round(sum((q % 4 = 2)::INT)::DOUBLE / count(*), 9) AS iec FROM (SELECT provenance, min(q) AS q FROM obs GROUP BY 1) WHERE q % 4 > 0")
def a_indel_concordance(spark, d):
    o = observations(spark, d).groupBy(F.col("provenance").alias("query_id")).agg(F.min(F.col("mapq").cast("int")).alias("q")).withColumn("cigar", F.lit("5M1X2I1D"))
    return stats.indel_concordance(o.select("query_id", "cigar"), o.select("query_id", (F.col("q") % 4).alias("n_events"))).withColumn("iec", F.round("iec", 9))


@query("WITH r AS (SELECT event_type AS target, count(*) AS reps, avg(value) AS m, coalesce(stddev_samp(value), 0) AS sd FROM events GROUP BY 1) SELECT target, reps, round(m, 6) AS mean_wall, round(sd / nullif(m, 0), 6) AS cv, sd / nullif(m, 0) > 0.05 AS noisy FROM r")
def a_replicates(spark, d):
    r = stats.replicates(_t(spark, d, "events").select(F.col("event_type").alias("target"), F.col("value").alias("wall")))
    return r.withColumns({"mean_wall": F.round("mean_wall", 6), "cv": F.round("cv", 6)})


@query("""WITH r AS (SELECT l_suppkey % 7 AS target, count(*) AS reps, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd, max(l_linenumber) AS total_reads, avg(l_tax) AS rss, avg(l_discount) FILTER (l_discount > 0) AS u FROM lineitem GROUP BY 1)
SELECT target, reps, round(m, 6) AS mean_wall, round(sd / m, 6) AS cv, sd / m > 0.05 AS noisy, round(rss, 3) AS peak_rss_gb, round(u, 4) AS unaligned_frac, total_reads, round(total_reads / (m * 8 * 20.0 / 1000), 4) AS rnt FROM r""")
def a_replicates_more(spark, d):
    r = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("target"), F.col("l_quantity").alias("wall"), F.col("l_tax").alias("peak_rss_gb"), F.col("l_discount").alias("unaligned_frac"), F.col("l_linenumber").alias("total_reads"))
    return stats.replicates(r, triad_gbps=20.0).withColumns({"mean_wall": F.round("mean_wall", 6), "cv": F.round("cv", 6)})


@query("SELECT count(DISTINCT l_orderkey) AS aligned FROM lineitem")
def a_aligned_queries(spark, d):
    return stats.aligned_queries(placements(spark, d))


# ------------------------------------------------------------------ alignment
def _units() -> str:
    """Every unit of four, then of three, then of two bases, three times or more: the pattern that
    an engine with back references states in one line."""
    units = [""]
    by_length = {}
    for n in range(1, 5):
        units = [u + b for u in units for b in "ACGT"]
        by_length[n] = units
    return "|".join(f"(?:{u}){{3,}}" for n in (4, 3, 2) for u in by_length[n])


@query(f"""WITH {SEQS}, m AS (SELECT id, regexp_extract_all(bases, '{_units()}') AS hits, string_split_regex(bases, '{_units()}') AS gaps FROM seqs),
r AS (SELECT id, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM m)),
p AS (SELECT *, CASE WHEN hit = repeat(hit[1:4], length(hit) // 4) AND length(hit) >= 12 AND length(hit) % 4 = 0 THEN 4 WHEN hit = repeat(hit[1:3], length(hit) // 3) AND length(hit) % 3 = 0 AND length(hit) >= 9 THEN 3 ELSE 2 END AS period FROM r)
SELECT id::VARCHAR AS seq_id, start::INT AS start, (start + length(hit) - 1)::INT AS "end", period, hit[1:period] AS unit FROM p""")
def w_tandem_repeats(spark, d):
    return intervals.tandem_repeats(seqs(spark, d))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts with that of the next part: short pairs to align."""
    p = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"))
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")


def _distances(pairs: DataFrame, kernel, **how) -> DataFrame:
    def run(batches):
        for b in batches:
            made = [kernel(x.encode(), y.encode(), **how) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            edits = [sum(c != "M" for c in kernels.expand(m.cigar)) for m in made]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.edit_distance for m in made], pa.int32()), pa.array(edits, pa.int32()), pa.array([m.target_end for m in made], pa.int32())], names=["p_partkey", "distance", "edits", "target_end"])

    return pairs.select("p_partkey", "a", "b").mapInArrow(run, "p_partkey bigint, distance int, edits int, target_end int")


_PAIRED = "pairs AS (SELECT x.p_partkey, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"


@query(f"WITH {_PAIRED} SELECT p_partkey, levenshtein(a, b)::INT AS distance, levenshtein(a, b)::INT AS edits, length(b)::INT AS target_end FROM pairs")
def x_wavefront(spark, d):
    """Distance, and the edits that the path counts, with both ends fixed."""
    return _distances(_neighbours(spark, d), kernels.align_wavefront, fitting=False)


_FITTING = f"{_PAIRED}, e AS (SELECT p_partkey, j, levenshtein(a, b[1:j]) AS v FROM (SELECT *, unnest(generate_series(0, length(b))) AS j FROM pairs)), l AS (SELECT p_partkey, min(v) AS v FROM e GROUP BY 1)"


@query(f"WITH {_FITTING} SELECT p_partkey, l.v::INT AS distance, l.v::INT AS edits, min(j)::INT AS target_end FROM l JOIN e USING (p_partkey) WHERE e.v = l.v GROUP BY 1, 2, 3")
def x_bit_vectors(spark, d):
    """With the target's end free: the least distance to a beginning of it, and the first such end."""
    return _distances(_neighbours(spark, d), kernels.align_bits)


@query(f"WITH {_FITTING} SELECT p_partkey, l.v::INT AS distance, l.v::INT AS edits, max(j)::INT AS target_end FROM l JOIN e USING (p_partkey) WHERE e.v = l.v GROUP BY 1, 2, 3")
def x_wavefront_fitting(spark, d):
    return _distances(_neighbours(spark, d), kernels.align_wavefront)


@query(f"""WITH {SEQS}, s AS (SELECT id, bases[1:40] AS t, reverse(bases[1:40]) AS q FROM seqs WHERE length(bases) >= 40)
SELECT id, 15 AS position, 'snp' AS kind, t[16:16] AS ref, q[16:16] || ':1' AS alleles FROM s UNION ALL SELECT id, 16, 'snp', t[17:17], q[17:17] || ':1' FROM s
UNION ALL SELECT id, 20, 'deletion', t[21:21], '.:1' FROM s
UNION ALL SELECT id, 26, 'insertion', '.', array_to_string(list_transform(list_sort(list_distinct(string_split(q[24:27], ''))), lambda b: b || ':' || (4 - length(replace(q[24:27], b, '')))::VARCHAR), ',') FROM s""")
def x_cigar_variants(spark, d):
    """A path of every kind of step over the first 40 bases of documents, from target 10 and query 5 on."""
    pairs = seqs(spark, d).filter("length(bases) >= 40").select("id", F.substring("bases", 1, 40).alias("t"))

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                q = t[::-1]
                for p, kind, ref, alleles in kernels.variants_of("5M2X3M3I3M4D2M", 10, q[10:], t):
                    rows.append((i, p, kind, ref, ",".join(f"{c}:{n}" for c, n in sorted(alleles.items()))))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "position", "kind", "ref", "alleles"])

    return pairs.mapInArrow(run, "id bigint, position int, kind string, ref string, alleles string")


@query()
def x_align_reads(spark, d):
    """Every benchmark passage placed on all documents it shares seeds with, both strands, with
    outcomes; a passage without a seed anywhere has one row without a target."""
    placed = align.place_all(seqs(spark, d, "benchmark", "item_id").filter("bases <> ''"), seqs(spark, d))
    return align.with_outcome(align.score(placed)).select("query_id", "target_id", "strand", "rank", "target_start", "target_end", "cigar", "edit_distance", "is_primary", "outcome")


_CONTAINED = "SELECT i.id::VARCHAR AS query_id, s.id::VARCHAR AS target_id, {strand} AS strand, 0 AS edit_distance, 'placed' AS outcome FROM items i JOIN seqs s ON length(i.bases) >= 31 AND contains(s.bases, i.bases)"


def _whole(placed: DataFrame, spark, d) -> DataFrame:
    """Placements without an edit, in tiles or not; native levenshtein must agree with each."""
    found = align.with_outcome(align.score(placed)).filter("edit_distance = 0 AND is_primary")
    return found.select("query_id", "target_id", "strand", "edit_distance", "outcome").distinct()


@query(f"WITH {SEQS}, {ITEMS} {_CONTAINED.format(strand=chr(39) + '+' + chr(39))}")
def x_exact_placements(spark, d):
    """Passages that stand in a document word for word are placed on it without an edit."""
    return _whole(align.place_all(seqs(spark, d, "benchmark", "item_id").filter("bases <> ''"), seqs(spark, d)), spark, d)


@query(f"WITH {SEQS}, {ITEMS} {_CONTAINED.format(strand=chr(39) + '-' + chr(39))}")
def x_reverse_placements(spark, d):
    """The same for their reverse complements, on documents in tiles of 2,000 bases: the other strand."""
    reads = seqs(spark, d, "benchmark", "item_id").filter("bases <> ''").withColumn("bases", scalars.reverse_complement(F.col("bases")))
    return _whole(align.place_tiled(reads, seqs(spark, d), size=2000, overlap=1500), spark, d)


@query("SELECT true AS agrees, count(*) > 0 AS some FROM benchmark")
def x_distances_agree(spark, d):
    """The distance of every forward placement is what native levenshtein finds for its span."""
    reads, documents = seqs(spark, d, "benchmark", "item_id").filter("bases <> ''"), seqs(spark, d)
    placed = align.place_all(reads, documents).filter("target_id IS NOT NULL AND strand = '+'")
    j = placed.join(reads.select(F.col("id").cast("string").alias("query_id"), F.col("bases").alias("q")), "query_id").join(documents.select(F.col("id").cast("string").alias("target_id"), F.col("bases").alias("t")), "target_id")
    native = F.levenshtein("q", F.substr("t", F.col("target_start") + 1, F.col("target_end") - F.col("target_start")))
    return j.agg(F.bool_and(native == F.col("edit_distance")).alias("agrees"), (F.count("*") > 0).alias("some"))


@query(f"""WITH {SEQS}, {ITEMS} SELECT i.id::VARCHAR AS query_id, s.id::VARCHAR AS target_id, (strpos(s.bases, i.bases) + 59)::INT AS position, 'snp' AS variant_type, i.bases[61:61] AS ref_base,
translate(i.bases[61:61], 'ACGT', 'CGTA') || ':1' AS alleles, 1 AS edit_distance FROM items i JOIN seqs s ON length(i.bases) >= 121 AND contains(s.bases, i.bases)""")
def x_variants(spark, d):
    """Passages with their 61st base changed, on the documents that hold them as they were."""
    changed = F.concat(F.substr("bases", F.lit(1), F.lit(60)), F.translate(F.substr("bases", F.lit(61), F.lit(1)), "ACGT", "CGTA"), F.expr("substring(bases, 62)"))
    reads, documents = seqs(spark, d, "benchmark", "item_id").filter("length(bases) >= 121").withColumn("bases", changed), seqs(spark, d)
    found = align.variants_all(align.score(align.place_all(reads, documents)).filter("edit_distance <= 1"), reads, documents)
    return found.select("query_id", "target_id", "position", "variant_type", "ref_base", report.alleles_text(F.col("all_alleles")).alias("alleles"), "edit_distance")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Passages against documents: minimizers, capped seed join, diagonal votes, best document."""
    seeds = sketch.find_seeds(sketch.sketch(seqs(spark, d, "benchmark", "item_id")), sketch.sketch(seqs(spark, d)))
    votes = seeds.groupBy("query_id", "target_id", F.floor((F.col("target_pos") - F.col("query_pos")) / 16).alias("band")).agg(F.count("*").alias("votes"), F.min(F.col("target_pos") - F.col("query_pos")).alias("pos"))
    w = Window.partitionBy("query_id").orderBy(F.col("votes").desc(), "target_id", "pos")
    return votes.withColumn("r", F.row_number().over(w)).filter("r = 1").select("query_id", "target_id", "pos", "votes")
