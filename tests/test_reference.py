"""Filters, planning and laws on small tables, in Spark."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import filters, scalars
from strandline.operators import align, intervals, merge, planning, sketch, stats
from strandline.plans import reference_queries, store
from strandline.sources import records, synthetic


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.reverse_complement(F.lit("ACgtN")).alias("rc"),
        F.transform(F.array(*[F.lit(x) for x in (0, 2, 3, 7, 8, 12, 300)]), lambda v: scalars.quantize(v)).alias("q"),
        scalars.levenshtein_from_cigar(F.lit("3M2XI")).alias("lev"),
        scalars.matching_prefix(F.lit("abc"), F.lit("abd")).alias("p"),
        scalars.mate_id(F.lit("r/2/1"), F.lit(False)).alias("m"),
    ).first()
    assert (r.rc, r.q, r.lev, r.p, r.m) == ("NacGT", [0, 0, 5, 5, 10, 10, 255], 3, 2, "r/1")


def test_expression_errors():
    for text, error in (("nope > 1", filters.UnknownField), ("mapq > ", filters.MissingOperand), ("(mapq > 1", filters.UnmatchedParen), ("mapq > 1)", filters.UnmatchedParen), ("mapq 3", filters.MalformedExpression), ("", filters.MissingOperand), ("&& mapq > 1", filters.MissingOperand)):
        with pytest.raises(error):
            filters.parse_expression(text, _fields())


def _fields():
    from unittest.mock import MagicMock

    return {"mapq": MagicMock()}


def test_presets():
    assert filters.preset("strict", min_mapq=5).min_mapq == 5
    assert filters.pair_fraction(60) == 0.6
    for bad in (lambda: filters.preset("x"), lambda: filters.pair_fraction(-1), lambda: filters.preset(nope=1)):
        with pytest.raises(ValueError):
            bad()


def test_merge_is_commutative_and_idempotent(spark):
    rows = [(p, {"A": a}, f"r{p % 3}", 1, 1, 10, 1, i) for i, (p, a) in enumerate([(1, 2), (1, 3), (2, 2), (1, 2)])]
    cols = "position int, all_alleles map<string,int>, provenance string, total_paired_count int, proper_pair_count int, insert_size_sum bigint, insert_size_count int, row_ord bigint"
    a, b = spark.createDataFrame(rows[:2], cols), spark.createDataFrame(rows[1:], cols)
    key = lambda df: sorted((r.position, sorted(r.all_alleles.items()), r.local_coverage, r.insert_size_sum) for r in df.collect())
    one = key(merge.merge(merge.union_samples([a, b])))
    assert one == key(merge.merge(merge.union_samples([b, a]))) == key(merge.merge(merge.union_samples([a, b, a])))
    with pytest.raises(ValueError):
        merge.union_samples([])
    with pytest.raises(ValueError):
        merge.union_samples([a, b], [5, 6])


def test_intervals(spark):
    spots = spark.createDataFrame([(3, 5), (9, 9)], "start long, end long")
    points = spark.createDataFrame([(i,) for i in range(12)], "pos long")
    hit = {r.pos for r in intervals.in_interval(points, spots, "hit", 4).collect() if r.hit}
    assert hit == {3, 4}
    runs = intervals.rle_encode(spark.createDataFrame([("x", i, v) for i, v in enumerate([0, 1, 5, 6, 6, 20])], "ref_id string, pos int, value int"))
    assert sorted((r.start, r.length, r.value) for r in runs.collect()) == [(0, 2, 0), (2, 3, 5), (5, 1, 20)]
    assert intervals.rle_decode(runs).count() == 6


def test_align_recovers_reads(spark):
    ref = synthetic.reference(spark, 20_000, seed=3)
    target = ref.first()["bases"]
    reads = synthetic.reads(ref, 60, divergence=0.01, seed=5)
    placed = align.score(align.place(reads, "ref", target))
    best = placed.filter("is_primary").select("query_id", F.col("target_start").alias("pos"), (-F.col("edit_distance")).alias("score"))
    acc = stats.start_accuracy(best, reads.select(F.col("id").alias("query_id"), "start")).first()
    assert acc.evaluated == 60 and acc.accuracy >= 0.9
    found = align.variants(placed, reads, target)
    assert abs(found.filter("variant_type = 'snp'").count() - reads.agg(F.sum("n_subs")).first()[0]) <= 12


def test_align_reads_on_all_documents(spark, tmp_path):
    import random

    rnd = random.Random(4)
    say = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passages, spoilt = [say(120) for _ in range(4)], say(120)
    flip = spoilt[:60] + ("b" if spoilt[60] in "aeimquy" else "a") + spoilt[61:]
    texts = [say(900), say(50) + passages[0] + say(80), passages[1] + say(30) + passages[0], say(70) + flip + say(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, passages[0]), (11, passages[1]), (12, spoilt), (13, passages[3]), (14, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = reference_queries.x_align_reads(spark, str(tmp_path)).collect()
    placed = {(r.query_id, r.target_id, r.target_start, r.edit_distance) for r in got if r.is_primary and r.outcome == "placed"}
    assert placed == {("10", "1", 50, 0), ("10", "2", 150, 0), ("11", "2", 0, 0), ("12", "3", 70, 1)}
    assert [(r.query_id, r.target_id, r.outcome) for r in got if r.target_id is None] == [("13", None, "no_seed")]
    reads, documents = reference_queries.seqs(spark, str(tmp_path), "benchmark", "item_id").filter("bases <> ''"), reference_queries.seqs(spark, str(tmp_path))
    found = align.variants_all(align.score(align.place_all(reads, documents)), reads, documents).collect()
    assert [(r.query_id, r.target_id, r.position, r.variant_type) for r in found] == [("12", "3", 130, "snp")]


def test_capped_by_row(spark):
    texts = ["ACGTTGCATCGATCGGATTACAGGCATCAGGACT" * 400 + "TTGACCAGTAGGACCATTAGCACCAGATTTACCAGGGACATAT" * k for k in (1, 5, 300)]
    seqs = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "id string, bases string")
    every = sketch.sketch(seqs)
    got = sketch.find_seeds(every, sketch.sketch(seqs, floor=256), capped=False)
    want = sketch.find_seeds(every, every)
    assert got.count() == want.count() < sketch.find_seeds(every, every, capped=False).count() and got.exceptAll(want).count() == 0


def test_planning_rules(spark):
    for bad in ({"reference": True, "worker": True}, {"sealed": True}, {"gap_model": "affine"}, {"alphabet": "rna"}):
        with pytest.raises(ValueError):
            planning.validate(**bad)
    with pytest.raises(ValueError):
        planning.check_worker_paths("out.tsv", 2)
    got = spark.range(10).select(planning.chunk_of(F.col("id"), 10, 3).alias("c")).groupBy("c").count().collect()
    assert sorted(r["count"] for r in got) == [2, 4, 4]


def test_store_and_sources(spark, tmp_path):
    tasks = spark.createDataFrame([(i % 2, f"q{i}") for i in range(6)], "chunk_id int, query_id string")
    store.write_plan(str(tmp_path / "plan"), {"tasks": tasks}, {"k": 21})
    meta, tables = store.read_plan(spark, str(tmp_path / "plan"), worker=1)
    assert meta["k"] == 21 and tables["tasks"].count() == 3
    (tmp_path / "seq").mkdir()
    (tmp_path / "seq" / "a.fa").write_text(">a d\nAC\nGT\n>b\nTT\n")
    (tmp_path / "seq" / "b.fq").write_text("@r\nAC\n+\nII\n")
    assert sorted((r.id, r.bases) for r in records.read_sequences(spark, str(tmp_path / "seq")).collect()) == [("a", "ACGT"), ("b", "TT"), ("r", "AC")]
    assert sorted((r.id, r.description, r.bases) for r in records.read_fasta_text(spark, str(tmp_path / "seq" / "a.fa")).collect()) == [("a", "d", "ACGT"), ("b", None, "TT")]


def test_tiles_give_what_whole_targets_do(spark):
    targets = synthetic.reference(spark, 30_000, seed=4, name="a\tb").unionByName(synthetic.reference(spark, 9_000, seed=5, name="c"))
    one = targets.filter("id <> 'c'")
    reads = synthetic.reads(one, 80, divergence=0.02, seed=6, indel_rate=0.01).unionByName(synthetic.reads(targets.filter("id = 'c'"), 30, seed=7).withColumn("id", F.concat(F.lit("c"), "id")))
    key = lambda df: {(r.query_id, r.target_id, r.strand, r.target_start, r.target_end, r.edit_distance) for r in align.score(df).filter("is_primary").collect()}
    whole, tiled = key(align.place_all(reads, targets)), key(align.place_tiled(reads, targets, size=4_000, overlap=1_000))
    assert whole == tiled and len(whole) >= 110
    assert {t for _, t, *_ in whole} == {"a\tb", "c"}


def test_outcomes_of_the_fast_strategy(spark):
    rows = [("near", 1, 100, 3), ("far", 30, 100, 3), ("mid", 10, 100, 3), ("blind", 10, 100, 0), ("lucky", 0, 100, 0), ("gone", None, 100, 3)]
    df = spark.createDataFrame(rows, "query_id string, edit_distance int, query_length int, seeds int").withColumn("is_primary", F.lit(True))
    got = lambda s: {r.query_id: r.outcome for r in align.with_outcome(df, s).collect()}
    assert got("fast") == {"near": "placed", "far": "fast_cutoff", "mid": "below_threshold", "blind": "no_seed", "lucky": "placed", "gone": "no_alignment"}
    assert got("balanced") == got("fast") | {"far": "below_threshold"}
    assert {r.query_id for r in align.within_cutoff(df, "fast").collect()} == {"near", "mid", "blind", "lucky", "gone"}
    assert align.within_cutoff(df, "balanced").count() == 6


def test_synthetic_truth(spark):
    ref = synthetic.reference(spark, 5_000, seed=2)
    made = synthetic.reads(ref, 200, divergence=0.02, seed=3, indel_rate=0.02, indel_max=3).collect()
    text = ref.first()["bases"]
    for r in made:
        fragment, out = text[r.start : r.start + 150], len(r.bases)
        events = [e.split(":") for e in r.indel_events.split(";") if e]
        assert out == 150 + sum(int(n) * (1 if op == "I" else -1) for _, op, n in events)
        assert all(0 <= int(at) < 150 and 1 <= int(n) <= 3 for at, _, n in events)
        if not events:
            own = r.bases if r.strand == "+" else r.bases[::-1].translate(str.maketrans("ACGT", "TGCA"))
            assert sum(a != b for a, b in zip(own, fragment)) == r.n_subs
    assert sum(bool(r.indel_events) for r in made) > 100
    proteins = synthetic.proteome(spark, 20, seed=4)
    queries = synthetic.protein_queries(proteins, 50, length=60, divergence=0.0)
    j = queries.join(proteins.withColumnRenamed("bases", "whole").withColumnRenamed("id", "source_protein"), "source_protein").collect()
    assert len(j) == 50 and all(r.whole[r.start : r.start + 60] == r.bases for r in j)


def test_indels_are_recovered(spark):
    ref = synthetic.reference(spark, 20_000, seed=8)
    reads = synthetic.reads(ref, 60, divergence=0.0, seed=9, indel_rate=0.004, indel_max=3)
    placed = align.score(align.place(reads, "ref", ref.first()["bases"], "sensitive", "affine")).filter("is_primary")
    events = reads.select(F.col("id").alias("query_id"), F.regexp_count("indel_events", F.lit(";")).alias("n_events"))
    got = stats.indel_concordance(placed.select("query_id", "cigar"), events).first()
    assert got.reads > 15 and got.iec >= 0.6


def test_accuracy_leaves_out_what_cannot_be_judged(spark):
    placed = spark.createDataFrame([("chr_100_400_x/1", 100, 1.0), ("chr_100_400_x/2", 251, 1.0), ("chr_900_400_y", 5, 1.0), ("rand_chr_1_2_z", 1, 1.0), ("plain", 7, 1.0)], "query_id string, pos int, score double")
    reads = placed.select(F.col("query_id").alias("id"), F.repeat(F.lit("A"), F.lit(150)).alias("bases")).union(spark.createDataFrame([("chr_5_9_unplaced", "A")], "id string, bases string"))
    got = stats.placement_accuracy(placed, stats.truth_from_names(reads), total=10).first()
    assert tuple(got) == (5, 3, 2, 2 / 3, 5, 0.5)
    none = stats.placement_accuracy(placed.limit(0), stats.truth_from_names(reads)).first()
    assert tuple(none) == (0, 0, 0, 0.0, 0, 0.0)


@pytest.mark.parametrize("files,seqs,long,alone,on_reference", [(1, 1, False, 1, 2), (1, 5, False, 4, 2), (2, 2, False, 3, 2), (2, 4, True, 3, 4), (1, 1, True, 1, 4), (0, 0, False, 1, 2)])
def test_use_cases(spark, files, seqs, long, alone, on_reference):
    rows = [(i % max(files, 1), "A" * (5000 if long else 100)) for i in range(seqs)]
    df = spark.createDataFrame(rows, "file_idx int, bases string")
    assert planning.use_case(df, False).first()[0] == alone and planning.use_case(df, True).first()[0] == on_reference


def test_sweeps_by_bins(spark):
    """Runs that cross, fill and touch bins come out as from one bin."""
    import random

    rnd = random.Random(2)
    spans = [("x", s, s + rnd.randint(0, 60)) for s in (rnd.randint(0, 300) for _ in range(80))] + [("y", 0, 1000), ("y", 64, 128)]
    df = spark.createDataFrame(spans, "ref_id string, start int, end int")
    depth = {}
    for r, a, b in spans:
        for p in range(a, b):
            depth[r, p] = depth.get((r, p), 0) + 1
    for size in (7, 64, 1 << 20):
        runs = intervals.coverage_sweep(df, bin_size=size).collect()
        assert {(r.ref_id, p): r.depth for r in runs for p in range(r.start, r.end)} == depth
    points = spark.createDataFrame([("x", p, v * 5) for p, v in enumerate([1, 1, 1, 2, 2, 1, 1, 1, 1, 1, 1, 3])] + [("x", 20, 5), ("z", 3, 5)], "ref_id string, pos int, value int")
    want = sorted(tuple(r) for r in intervals.rle_encode(points).collect())
    low = points.filter("value = 5").select("pos", F.lit(0.1).alias("score"))
    islands = sorted(tuple(r) for r in intervals.hotspots(low).collect())
    assert ("x", 5, 6, 5) in want and (5, 10) in islands
    for size in (1, 2, 3, 5):
        assert sorted(tuple(r) for r in intervals.rle_encode(points, bin_size=size).collect()) == want
        assert sorted(tuple(r) for r in intervals.hotspots(low, bin_size=size).collect()) == islands
    at = intervals.coverage_at(intervals.rle_encode(points), spark.createDataFrame([("x", 6), ("x", 15), ("q", 1)], "ref_id string, pos int"), bin_size=4)
    assert sorted(map(str, (tuple(r) for r in at.select("ref_id", "pos", "value").collect()))) == sorted(map(str, [("x", 6, 5), ("x", 15, None), ("q", 1, None)]))


def test_vcf_and_tsv_files(spark, tmp_path):
    from strandline.operators import report

    rows = [(9, "A", {"C": 2, "A": 1}, 0.5, 0, 0, "snp"), (9, "A", {"T": 2, ".": 1}, 0.9, 1, 0, "snp"), (3, ".", {"G": 1, "C": 2}, 0.905, 0, 1, "insertion"), (5, "T", {".": 1}, 1.0, 0, 2, "deletion")]
    obs = spark.createDataFrame([(*r, [4, 7], 1, 60, "3M", 1) for r in rows], "position int, ref_base string, all_alleles map<string,int>, confidence double, file_ord int, row_ord int, variant_type string, local_coverage array<int>, coverage_window_variant_offset int, mapq int, cigar string, edit_distance int")
    path = str(tmp_path / "vcf")
    report.write_vcf(obs, path, "chr", 100)
    lines = [r.value for r in spark.read.text(path).withColumn("f", F.input_file_name()).orderBy("f").collect()]
    assert lines[:9] == report.vcf_header("chr", 100)
    assert lines[9:] == [
        "chr\t4\t.\t.\tCG\t90\tPASS\tDP=7;MQ=60;CIGAR=3M;ED=1\tGT:GQ\t0/1:90",
        "chr\t6\t.\tT\t.\t100\tPASS\tDP=7;MQ=60;CIGAR=3M;ED=1\tGT:GQ\t0/1:100",
        "chr\t10\t.\tA\t.CT\t50\tPASS\tDP=7;MQ=60;CIGAR=3M;ED=1\tGT:GQ\t0/1:50",
    ]


def test_index_readers_refuse_other_files(spark, tmp_path):
    path = str(tmp_path / "q")
    store.write_queries(store.query_index(spark.createDataFrame([("a", 1, 0.99), ("a", 0, 0.97), ("b", 2, 0.5)], "query_id string, pos int, score double")), path)
    assert [(r.query_id, r.pos) for r in store.read_queries(spark, path).collect()] == [("a", 0), ("a", 1)]
    with pytest.raises(ValueError):
        store.read_cross_space_queries(spark, path)
    existing = spark.createDataFrame([("p1",)], "path string")
    planning.require_all(existing, existing)
    with pytest.raises(FileNotFoundError):
        planning.require_all(spark.createDataFrame([("p1",), ("p2",)], "path string"), existing)
    assert store.timestamp("2020") == "2020"


def test_stream_merges_files_as_they_arrive(spark, tmp_path):
    from strandline.streaming import merge_stream

    schema = "position int, all_alleles map<string,int>, provenance string, ts timestamp"
    rows = lambda *ps: spark.createDataFrame([(p, {"A": 1, "C": 2}, "r", None) for p in ps], schema).withColumn("ts", F.lit("2024-01-01 00:30:00").cast("timestamp"))
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for batch in ((1, 2), (2, 3)):
        rows(*batch).write.mode("append").parquet(src)
        q = merge_stream.write_merged(merge_stream.stream_observations(spark, src, schema, "ts"), out, check)
        q.awaitTermination(120)
    assert sorted(r.position for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    depth = merge_stream.windowed_depth(spark.readStream.schema(schema).parquet(src), "ts")
    q = depth.writeStream.format("memory").queryName("depth").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.position: r.depth for r in spark.table("depth").collect()} == {1: 1, 2: 2, 3: 1}


def test_merged_spaces_are_the_union(spark):
    q = spark.createDataFrame([("r", 5, 0), ("r", 6, 3)], "seq_id string, hash long, pos int")
    spaces = spark.createDataFrame([("A", 5, 10), ("A", 6, 13), ("B", 6, 40)], "space string, hash long, pos int")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    both = key(planning.placements_by_space(q, spaces))
    assert both == key(planning.placements_by_space(q, spaces.filter("space = 'A'"))) + key(planning.placements_by_space(q, spaces.filter("space = 'B'")))
    assert both == [("r", "A", 10, 2), ("r", "B", 37, 1)]
    wanted = spark.createDataFrame([("x",)], "content_hash string")
    assert planning.resolve_palette(wanted, wanted, sealed=True).first().hit
    with pytest.raises(Exception, match="sealed palette"):
        planning.resolve_palette(wanted, wanted.limit(0), sealed=True).collect()
