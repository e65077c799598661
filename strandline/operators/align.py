"""Placing reads on a target: seeds, chains, extension, strands, retention, variants.

Relational steps are joins and windows; one grouped Arrow function chains and extends the
reads of one task. One target is a broadcast value, its size checked first; many targets stay
a table, and placements take pieces of them along.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .sketch import seeds_of
from strandline.functions.filters import FAST_DIVERGENCE, outcome, within_divergence
from strandline.functions.scalars import reverse_complement

#: Chains extended per read by strategy; reads up to this long use rows.
CHAINS = {"fast": 1, "balanced": 2, "sensitive": 50}
SHORT_QUERY = 500
#: Targets up to so many bases travel with the tasks; longer ones are cut by `tiles`.
MAX_TARGET = 64_000_000

ALIGNMENT = "query_id string, strand string, rank int, score bigint, target_start int, target_end int, cigar string, edit_distance int, query_length int, seeds int"


def tiles(target: DataFrame, size: int = 1_000_000, overlap: int = 50_000) -> DataFrame:
    """A long target in overlapping pieces: (id, offset, bases), each fit to be placed on."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("bases"), F.lit(1)), F.lit(size))
    cut = target.select("id", "bases", F.explode(starts).alias("s"))
    return cut.select("id", (F.col("s") - 1).alias("offset"), F.substr("bases", F.col("s"), F.lit(size + overlap)).alias("bases"))


def _stranded(reads: DataFrame, alphabet: str) -> DataFrame:
    """(id, bases, strand, key) of reads in all orientations; key names one of them."""
    both = reads.select(F.col("id").cast("string").alias("id"), "bases", F.lit("+").alias("strand"))
    if alphabet == "dna":
        both = both.union(both.select("id", reverse_complement(F.col("bases")), F.lit("-")))
    return both.withColumn("key", F.concat("id", F.lit("\t"), "strand"))


def _extend(q: bytes, window: bytes, strategy: str, gap_model: str) -> kernels.Alignment | None:
    if gap_model == "affine":
        return kernels.align_affine(q, window)
    if strategy != "sensitive" and len(q) <= SHORT_QUERY:
        return kernels.align_bits(q, window)
    return kernels.align_wavefront(q, window, fitting=len(window) > len(q) + len(q) // 2 + 10)


def place(reads: DataFrame, target_id: str, target: str, strategy: str = "balanced", gap_model: str = "linear", alphabet: str = "dna") -> DataFrame:
    """All extended chains of reads (id, bases) on both strands: ALIGNMENT.

    Where one orientation has chains and the other none, only that one is extended; without
    any chain both start at 0. Proteins have one orientation. seeds: of all orientations.
    """
    if len(target) > MAX_TARGET:
        raise ValueError(f"a target of {len(target)} bases; cut it by tiles()")
    if gap_model == "affine" and strategy != "sensitive":
        raise ValueError("affine gaps need the sensitive strategy")
    spark = reads.sparkSession
    both = _stranded(reads, alphabet)
    t = spark.createDataFrame([(target_id, target)], "id string, bases string")
    seeds = seeds_of(both.select(F.col("key").alias("id"), "bases"), t, alphabet)
    hits = seeds.groupBy(F.col("query_id").alias("key")).agg(F.collect_list(F.struct("query_pos", "target_pos")).alias("seeds"))
    keyed = both.join(hits, "key", "left").select("id", "strand", "bases", "seeds")
    cap, params = CHAINS[strategy], kernels.ChainParams()
    whole = target.encode()

    def extend(t: pa.Table) -> pa.Table:
        found: dict[str, list] = {}
        for i, strand, bases, seeds in zip(*(t.column(c).to_pylist() for c in ("id", "strand", "bases", "seeds")), strict=True):
            chains = kernels.chain_seeds([(s["query_pos"], s["target_pos"]) for s in seeds or ()], params)
            found.setdefault(i, []).append((strand, (bases or "").encode(), chains, len(seeds or ())))
        rows = []
        for i, sides in found.items():
            some, n_seeds = any(x[2] for x in sides), sum(x[3] for x in sides)
            for strand, q, chains, _ in sorted(sides, key=lambda x: x[0]):
                if some and not chains:
                    continue
                anchors = [(c, kernels.target_start(path)) for c, path in chains[:cap]] or [(0, 0)]
                for rank, (score, start) in enumerate(anchors):
                    a = _extend(q, whole[start : start + 2 * len(q)], strategy, gap_model)
                    if a is not None:
                        rows.append((i, strand, rank, score, start, start + a.target_end, a.cigar, a.edit_distance, len(q), n_seeds))
        names = [x.split()[0] for x in ALIGNMENT.split(", ")]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.table({n: pa.array(c, kd) for n, c, kd in zip(names, cols, kinds, strict=True)})

    # many reads a group: a group's cost is mostly its start
    slot = F.pmod(F.xxhash64("id"), F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    return keyed.withColumn("slot", slot).groupBy("slot").applyInArrow(extend, ALIGNMENT)


PLACED = "query_id string, target_id string, strand string, rank int, score bigint, target_start int, target_end int, cigar string, edit_distance int, query_length int, seeds int"


def place_all(reads: DataFrame, targets: DataFrame, strategy: str = "balanced", gap_model: str = "linear", alphabet: str = "dna") -> DataFrame:
    """All extended chains of reads (id, bases) on every target (id, bases) they share a seed with: PLACED.

    Each pair of a read and a target is treated as by `place`. A read without a seed in any
    target has one row, whose score is 0 and whose target and alignment are null. Chains are made
    from positions alone; then each anchor takes only its piece of the target along.
    """
    if gap_model == "affine" and strategy != "sensitive":
        raise ValueError("affine gaps need the sensitive strategy")
    spark = reads.sparkSession
    both = _stranded(reads, alphabet)
    targets = targets.select(F.col("id").cast("string").alias("id"), "bases")
    # a target is one row, so its occurrence cap needs no exchange
    seeds = seeds_of(both.select(F.col("key").alias("id"), "bases"), targets, alphabet)
    # ids may hold tabs; the strand is what follows the last one
    seeds = seeds.select(F.expr("left(query_id, length(query_id) - 2)").alias("id"), F.expr("right(query_id, 1)").alias("strand"), "target_id", "query_pos", "target_pos")
    hits = seeds.groupBy("id", "target_id").agg(F.collect_list(F.struct("strand", "query_pos", "target_pos")).alias("seeds"))
    cap, params, strands = CHAINS[strategy], kernels.ChainParams(), "+-" if alphabet == "dna" else "+"

    def chain(batches):
        for b in batches:
            rows = []
            for i, target_id, seeds in zip(*(b.column(c).to_pylist() for c in ("id", "target_id", "seeds")), strict=True):
                sides = [(st, kernels.chain_seeds([(s["query_pos"], s["target_pos"]) for s in seeds if s["strand"] == st], params)) for st in strands]
                some = any(chains for _, chains in sides)
                for strand, chains in sides:
                    if some and not chains:
                        continue
                    anchors = [(c, kernels.target_start(path)) for c, path in chains[:cap]] or [(0, 0)]
                    rows += [(i, target_id, strand, rank, score, start, len(seeds)) for rank, (score, start) in enumerate(anchors)]
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                names = ("id", "target_id", "strand", "rank", "score", "start", "seeds")
                yield pa.RecordBatch.from_arrays([pa.array(c, kd) for c, kd in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    anchors = hits.mapInArrow(chain, "id string, target_id string, strand string, rank int, score bigint, start int, seeds int")
    # reads without anchors stay, each by a key of its own
    placed = both.filter("strand = '+'").select("id", "bases").join(anchors, "id", "left")
    placed = placed.select("id", "target_id", "strand", "rank", "score", "start", "seeds", F.when(F.col("strand") == "-", reverse_complement(F.col("bases"))).otherwise(F.col("bases")).alias("q"), F.coalesce(F.concat(F.lit("t"), "target_id"), F.concat(F.lit("r"), "id")).alias("key"))
    pieces = (
        placed.join(targets.select(F.concat(F.lit("t"), "id").alias("key"), "bases"), "key", "left")
        .select("id", "target_id", "strand", "rank", "score", "start", "seeds", "q", F.substr("bases", F.col("start") + 1, 2 * F.length("q")).alias("piece"))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "id", "target_id", "strand", "rank")
    )

    def extend(batches):
        for b in batches:
            rows = []
            for i, target_id, strand, rank, score, start, seeds, q, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if target_id is None:
                    rows.append((i, None, None, None, 0, None, None, None, None, len(q), 0))
                    continue
                a = _extend(q.encode(), piece.encode(), strategy, gap_model)
                if a is not None:
                    rows.append((i, target_id, strand, rank, score, start, start + a.target_end, a.cigar, a.edit_distance, len(q), seeds))
            if rows:
                names = [x.split()[0] for x in PLACED.split(", ")]
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, kd) for c, kd in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pieces.mapInArrow(extend, PLACED)


def place_tiled(reads: DataFrame, targets: DataFrame, strategy: str = "balanced", gap_model: str = "linear", alphabet: str = "dna", size: int = 1_000_000, overlap: int = 50_000) -> DataFrame:
    """`place_all` on targets of any length: PLACED, in the targets' own positions.

    Each target is placed on in pieces that overlap, so that a task holds a piece and no target.
    What two pieces both find is one placement; an alignment that its piece cut short yields to
    that of the next piece, which holds all of it as long as reads are shorter than half the
    overlap. Ranks are numbered anew by score.
    """
    pieces = tiles(targets, size, overlap).select(F.concat(F.col("id").cast("string"), F.lit("\t"), F.col("offset").cast("string")).alias("id"), "bases")
    found = place_all(reads, pieces, strategy, gap_model, alphabet)
    offset = F.substring_index("target_id", "\t", -1).cast("int")
    moved = found.withColumns({
        "target_start": F.col("target_start") + offset,
        "target_end": F.col("target_end") + offset,
        "target_id": F.expr("left(target_id, length(target_id) - length(substring_index(target_id, '\t', -1)) - 1)"),
    })
    # chains of one diagonal in two pieces: the better one is that of the piece that holds it whole
    same = Window.partitionBy("query_id", "target_id", "strand", "target_start").orderBy("edit_distance", F.col("score").desc(), "rank")
    placed = moved.filter("target_id IS NOT NULL").withColumn("__n", F.row_number().over(same)).filter("__n = 1").drop("__n")
    order = Window.partitionBy("query_id", "target_id", "strand").orderBy(F.col("score").desc(), "target_start")
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < CHAINS[strategy])
    return ranked.unionByName(moved.filter("target_id IS NULL"))


def score(alignments: DataFrame, retain: float = 0.95) -> DataFrame:
    """Primary and retained alternates of each read, or of each read on each target where rows
    have a target_id: least edits first, then the forward strand, then the chain's rank. An
    alternate stays within ``retain`` of the primary's identity; where that is not defined
    (empty reads, nothing in common) it does not."""
    task = [c for c in ("query_id", "target_id") if c in alignments.columns]
    strand = Window.partitionBy(*task).orderBy("edit_distance", "strand", "rank")
    best = alignments.withColumn("__r", F.row_number().over(strand)).withColumn("__strand", F.first("strand").over(strand)).withColumn("__edit", F.first("edit_distance").over(strand))
    top = 1 - F.col("__edit") / F.nullif(F.col("query_length"), F.lit(0))
    ratio = (1 - F.col("edit_distance") / F.nullif(F.col("query_length"), F.lit(0))) / F.nullif(top, F.lit(0.0))
    kept = best.withColumn("is_primary", F.col("__r") == 1).filter(F.col("is_primary") | ((F.col("strand") == F.col("__strand")) & F.coalesce(ratio >= retain, F.lit(False))))
    return kept.drop("__r", "__strand", "__edit")


def with_outcome(scored: DataFrame, strategy: str = "balanced") -> DataFrame:
    """Adds the outcome; a read that no target was tried for, as it shares no seed with any, is no_seed."""
    made = outcome(F.col("seeds"), F.col("edit_distance"), F.col("query_length"), FAST_DIVERGENCE if strategy == "fast" else None)
    if "target_id" in scored.columns:
        made = F.when(F.col("target_id").isNull(), "no_seed").otherwise(made)
    return scored.withColumn("outcome", made)


def within_cutoff(scored: DataFrame, strategy: str) -> DataFrame:
    """Without the reads whose primary is past the fast strategy's divergence, alternates and all."""
    if strategy != "fast":
        return scored
    task = [c for c in ("query_id", "target_id") if c in scored.columns]
    far = scored.filter("is_primary").filter(~within_divergence(F.col("edit_distance"), F.col("query_length"))).select(*task)
    return scored.join(far, task, "left_anti")


VARIANTS = "query_id string, position int, variant_type string, ref_base string, all_alleles map<string,int>, strand string, cigar string, edit_distance int"


def variants(primary: DataFrame, reads: DataFrame, target: str, strategy: str = "balanced") -> DataFrame:
    """Observations of primary alignments, joined with their reads' bases; the fast strategy's
    without those past its cutoff."""
    primary = within_cutoff(primary, strategy)
    oriented = reads.select(F.col("id").cast("string").alias("query_id"), "bases")
    j = primary.filter("is_primary").join(oriented, "query_id").select("query_id", "cigar", "target_start", "strand", "edit_distance", F.when(F.col("strand") == "-", reverse_complement(F.col("bases"))).otherwise(F.col("bases")).alias("bases"))

    def run(batches):
        for b in batches:
            rows = []
            for i, cigar, start, strand, edit, bases in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(i, p, kind, ref, list(al.items()), strand, cigar, edit) for p, kind, ref, al in kernels.variants_of(cigar, start, bases, target)]
            if rows:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.int32()), pa.string(), pa.string(), pa.int32())
                names = [x.split()[0] for x in VARIANTS.replace("string,int", "").split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return j.mapInArrow(run, VARIANTS)


def variants_all(primary: DataFrame, reads: DataFrame, targets: DataFrame, strategy: str = "balanced") -> DataFrame:
    """Observations of the primary alignments of place_all: VARIANTS with a target_id."""
    primary = within_cutoff(primary, strategy)
    oriented = reads.select(F.col("id").cast("string").alias("query_id"), "bases")
    found = targets.select(F.col("id").cast("string").alias("target_id"), F.col("bases").alias("target"))
    j = primary.filter("is_primary AND target_id IS NOT NULL").join(oriented, "query_id").join(found, "target_id").select(
        "query_id", "target_id", "cigar", "target_start", "strand", "edit_distance",
        F.when(F.col("strand") == "-", reverse_complement(F.col("bases"))).otherwise(F.col("bases")).alias("bases"),
        F.substr("target", F.col("target_start") + 1, F.col("target_end") - F.col("target_start")).alias("piece"),
    )

    def run(batches):
        for b in batches:
            rows = []
            for i, t, cigar, start, strand, edit, bases, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(i, t, start + p, kind, ref, list(al.items()), strand, cigar, edit) for p, kind, ref, al in kernels.variants_of(cigar, 0, bases, piece)]
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.int32()), pa.string(), pa.string(), pa.int32())
                names = ("query_id", "target_id", *[x.split()[0] for x in VARIANTS.replace("string,int", "").split(", ")][1:])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return j.mapInArrow(run, VARIANTS.replace("query_id string", "query_id string, target_id string"))
