"""Reports of observations: VCF and TSV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import coverage_at_variant

VCF_COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE")


def vcf_header(contig: str, length: int) -> list[str]:
    """The header lines of VCF 4.2 for one contig."""
    return [
        "##fileformat=VCFv4.2",
        f"##contig=<ID={contig},length={length}>",
        '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total depth">',
        '##INFO=<ID=MQ,Number=1,Type=Integer,Description="Mapping quality">',
        '##INFO=<ID=CIGAR,Number=1,Type=String,Description="CIGAR string">',
        '##INFO=<ID=ED,Number=1,Type=Integer,Description="Edit distance">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">',
        "#" + "\t".join(VCF_COLUMNS),
    ]


def alt_bases(alleles: Column, ref: Column) -> Column:
    return F.array_sort(F.filter(F.map_keys(alleles), lambda k: (k != ref) & (k != ".")))


def vcf_rows(obs: DataFrame, contig: str = "ref", spec_compliant: bool = False) -> DataFrame:
    """One row a position, told by its first observation by (file_ord, row_ord).

    Its kind decides: a substitution's alternatives are those of all observations there, each
    against its own reference base, sorted; an insertion's are its own bases, sorted; a deletion
    has none. They are concatenated, or with spec_compliant joined by commas. DP is the
    coverage at the variant's place in the window, 0 without one.
    """
    depth = F.coalesce(coverage_at_variant(F.col("local_coverage"), F.col("coverage_window_variant_offset")), F.lit(0))
    own = F.array_sort(F.filter(F.map_keys("all_alleles"), lambda k: k != "."))
    one = obs.select("*", depth.alias("depth"), own.alias("own"), F.filter(F.map_keys("all_alleles"), lambda k: k != F.col("ref_base")).alias("alt"))
    first = F.min_by(F.struct("ref_base", "variant_type", "confidence", "mapq", "cigar", "edit_distance", "depth", "own"), F.struct("file_ord", "row_ord"))
    g = one.groupBy("position").agg(first.alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("alt")))).alias("alts"))
    kind, sep = F.col("f.variant_type"), "," if spec_compliant else ""
    alt = F.when(kind == "deletion", "").when(kind == "insertion", F.array_join("f.own", sep)).otherwise(F.array_join("alts", sep))
    return g.select(
        F.lit(contig).alias("chrom"),
        (F.col("position") + 1).cast("bigint").alias("pos"),
        F.when(kind == "insertion", ".").otherwise(F.substring("f.ref_base", 1, 1)).alias("ref"),
        F.when(alt == "", ".").otherwise(alt).alias("alt"),
        F.bround(F.col("f.confidence") * 100, 0).cast("bigint").alias("qual"),
        F.lit("PASS").alias("filter"),
        F.concat_ws(";", F.concat(F.lit("DP="), F.col("f.depth")), F.concat(F.lit("MQ="), F.col("f.mapq")), F.concat(F.lit("CIGAR="), F.col("f.cigar")), F.concat(F.lit("ED="), F.col("f.edit_distance"))).alias("info"),
        F.concat(F.lit("0/1:"), F.floor(F.col("f.confidence") * 100).cast("string")).alias("sample"),
    )


def vcf_lines(rows: DataFrame) -> DataFrame:
    """Rows of `vcf_rows` as lines of the body: (pos, line)."""
    cells = [F.col("chrom"), F.col("pos"), F.lit("."), F.col("ref"), F.col("alt"), F.col("qual"), F.col("filter"), F.col("info"), F.lit("GT:GQ"), F.col("sample")]
    return rows.select("pos", F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("line"))


def write_vcf(obs: DataFrame, path: str, contig: str, length: int, spec_compliant: bool = False) -> None:
    """A folder whose part files, in the order of their names, are the file: the header in the
    first, the records by position. Sorting is Spark's range sort; nothing is gathered."""
    spark = obs.sparkSession
    head = spark.createDataFrame([(i, line) for i, line in enumerate(vcf_header(contig, length))], "pos bigint, line string")
    body = vcf_lines(vcf_rows(obs, contig, spec_compliant))
    rows = head.withColumn("part", F.lit(0)).unionByName(body.withColumn("part", F.lit(1)))
    rows.orderBy("part", "pos").select("line").write.mode("overwrite").text(path)


def write_tsv(rows: DataFrame, path: str, order: str = "position") -> None:
    """Rows of `tsv_library` or `tsv_cli` as text with a header line, like `write_vcf`."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, None, "\t".join(rows.columns))], "part int, at bigint, line string")
    body = rows.select(F.lit(1).alias("part"), F.col(order).cast("bigint").alias("at"), F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))
    head.unionByName(body).orderBy("part", "at", "line").select("line").write.mode("overwrite").text(path)


def escape_tsv(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def alleles_text(alleles: Column) -> Column:
    """``A:3,C:1`` in the order of the bases."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(alleles)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")


def tsv_library(obs: DataFrame, columns: tuple[str, ...] = ("position", "ref", "alt", "coverage", "mapq", "quality", "confidence", "edit_distance", "provenance")) -> DataFrame:
    """Chosen columns as text; coverage is that at the variant's place in its window."""
    alts = F.array_join(alt_bases(F.col("all_alleles"), F.col("ref_base")), "")
    known = {
        "position": F.col("position").cast("string"),
        "ref": F.col("ref_base"),
        "alt": F.when(alts == "", ".").otherwise(alts),
        "coverage": F.coalesce(F.get("local_coverage", F.col("coverage_window_variant_offset")).cast("string"), F.lit(".")),
        "mapq": F.col("mapq").cast("string"),
        "quality": F.col("avg_base_quality").cast("string"),
        "confidence": F.col("confidence").cast("string"),
        "edit_distance": F.col("edit_distance").cast("string"),
        "provenance": F.col("provenance"),
    }
    unknown = set(columns) - set(known)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return obs.select(*[escape_tsv(known[c]).alias(c) for c in columns])


def tsv_cli(obs: DataFrame) -> DataFrame:
    """The ten fixed columns; coverage is the first of the window."""
    return obs.select(
        "position", "ref_base", alleles_text(F.col("all_alleles")).alias("alleles"), "confidence", "cigar", "mapq", "edit_distance",
        F.coalesce(F.get("local_coverage", F.lit(0)), F.lit(0)).alias("coverage"), "avg_base_quality", "provenance",
    )


def normalise_alleles(text: Column) -> Column:
    """Sorts the tokens of ``B:n,...`` so that equal rows hash alike."""
    return F.array_join(F.array_sort(F.split(text, ",")), ",")
