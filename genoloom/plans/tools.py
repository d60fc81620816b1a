"""The eight tools: arguments as data classes, each run one DataFrame plan from sources to sinks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.operators import cluster, groups, matrix, merge, pairs, variants
from genoloom.operators import reads as R
from genoloom.sources import bam, sinks, text, vcf


def _site() -> Column:
    """One key of contig and position."""
    return F.concat_ws(":", "contig", F.col("pos").cast("string"))



@dataclass
class CellReads:
    """Reads per barcode, with histograms."""

    input: str
    output: str
    sample_tag: str = "CB"
    intervals: str | None = None

    def run(self, spark: SparkSession) -> DataFrame:
        reads = text.aligned(spark, self.input)
        if self.intervals:
            reads = R.overlapping(reads.withColumnRenamed("pos", "start"), text.regions(spark, self.intervals))
        counts = R.reads_per_barcode(reads.select(F.col("tags")[self.sample_tag].alias("barcode"), "dup"))
        sinks.table(counts, f"{self.output}/{self.sample_tag}.tsv", ["barcode"])
        sinks.histogram(R.histogram(counts, "umi"), f"{self.output}/{self.sample_tag}.histogram.tsv")
        sinks.histogram(R.histogram(counts, "read"), f"{self.output}/{self.sample_tag}.histogram.duplicates.tsv")
        return counts


@dataclass
class CellVariantcaller:
    """Pileup of cells' reads, variant calls, filters; VCF of raw and filtered calls."""

    input: str
    reference: str
    correct_cells: str
    output: str | None = None
    sample_tag: str = "CB"
    umi_tag: str | None = None
    seq_error: float = 0.005
    cutoffs: variants.Cutoffs = field(default_factory=variants.Cutoffs)
    intervals: str | None = None
    partitions: int = 200

    def calls(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(raw variants, raw observations, filtered variants, filtered observations), all with a site; piles the reads up at once."""
        cells = text.cell_list(spark, self.correct_cells)
        reads = text.aligned(spark, self.input).withColumns({"barcode": F.col("tags")[self.sample_tag], "umi": F.col("tags")[self.umi_tag] if self.umi_tag else F.lit(None).cast("string"), "ord": F.struct("pos", "name", "flag")})
        reads = R.known_cells(reads, cells)
        bases = R.cigar_bases(reads, ["contig", "cell", "umi", "forward", "dup", "ord"]).withColumnRenamed("position", "pos")
        bases = bases.filter(F.coalesce(R.mean_quality(F.col("quals")) >= self.cutoffs.min_base_quality, F.lit(False)))
        if self.intervals:
            bases = R.covered_positions(bases, text.regions(spark, self.intervals))
        keyed = bases.withColumns({"site": F.struct("contig", "pos"), "allele": F.struct("allele", "del_bases")})
        # reads without a UMI count by their duplicate flag
        raw = R.pileup_umi(keyed, ["ord"]) if self.umi_tag else R.pileup(keyed)
        # all that follows reads the counts several times: the reads are piled up once
        alleles = cluster.checkpointed(raw.select("site.contig", "site.pos", "cell", "allele.allele", "allele.del_bases", *variants.COUNTS))
        calls, obs = R.site_calls(R.site_alleles(alleles, text.fasta(spark, self.reference)))
        calls, obs = calls.withColumn("site", _site()), variants.filtered(obs.withColumn("site", _site()), self.cutoffs)
        clean = variants.zero_improbable(obs, self.seq_error, self.cutoffs.max_p_value)
        good = variants.filtered(variants.cleaned(clean), self.cutoffs)
        # alternative alleles that no cell keeps leave the variant too
        alive = clean.groupBy("site").agg(F.sort_array(F.collect_set(F.when((F.col("allele") > 0) & (variants.depth() > 0), F.col("allele")))).alias("alive"))
        kept = calls.join(alive, "site").join(good.select("site").distinct(), "site", "left_semi").withColumn("alts", F.transform("alive", lambda i: F.get("alts", i - 1))).drop("alive")
        return calls.join(obs.select("site").distinct(), "site", "left_semi"), obs, kept, good

    def run(self, spark: SparkSession) -> DataFrame:
        calls, raw, kept, good = self.calls(spark)
        if self.output:
            names = [r[0] for r in text.cell_list(spark, self.correct_cells).orderBy("cell").select("barcode").collect()]  # the header's columns
            for v, o, name in ((calls, raw, "raw"), (kept, good, "filter")):
                vcf.write(vcf.lines(v.drop("site"), o.drop("site"), names, self.seq_error), f"{self.output}/{name}-vcf", names, partitions=self.partitions)
        return good


def load_calls(spark: SparkSession, path: str, cells: DataFrame, correct_cells: str, reference: str | None) -> DataFrame:
    """Observations with a site, from a text of reads, or a VCF file or folder."""
    if path.rstrip("/").endswith((".sam", ".sam.gz", ".bam")):
        if not reference:
            raise ValueError("Reads need a reference")
        return CellVariantcaller(path, reference, correct_cells).calls(spark)[3]
    if path.endswith((".vcf", ".vcf.gz")) or "." not in path.rstrip("/").rsplit("/", 1)[-1] or path.endswith("-vcf"):
        return vcf.read(spark, path, cells)[1].withColumn("site", _site())
    raise ValueError(f"Input is neither reads, VCF nor a folder: {path}")


@dataclass
class CalculateDistance:
    """Distances of all pairs of cells by one or more methods, in one pass over the pairs."""

    input: str
    output: str
    correct_cells: str
    reference: str | None = None
    method: str = "pow4"
    additional_methods: tuple[str, ...] = ()
    min_total_alt_ratio: float = 0.01
    min_allele_coverage: int = 5
    write_scatters: bool = False

    def run(self, spark: SparkSession) -> DataFrame:
        cells = text.cell_list(spark, self.correct_cells)
        obs = variants.alt_ratio_at_least(load_calls(spark, self.input, cells, self.correct_cells, self.reference), self.min_total_alt_ratio)
        names = sorted({self.method, *self.additional_methods})
        dist = pairs.distances(obs, names, self.min_allele_coverage).persist()
        for name in names:
            sinks.matrix(dist, cells, f"{self.output}/distance.{name}.csv", name)
        sinks.matrix(dist, cells, f"{self.output}/count.positions.csv", "positions")
        if self.write_scatters:
            sinks.scatters(pairs.scatter(obs, self.min_allele_coverage), f"{self.output}/scatters")
        return dist


@dataclass
class GroupDistance:
    """Clusters of a distance matrix: bisecting k-means, then re-clustering."""

    distance_matrix: str
    output: str
    correct_cells: str
    num_clusters: int
    num_iterations: int = 20
    seed: int = 0
    skip_kmeans: bool = False
    count_matrix: str | None = None

    def run(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        dist, cells = text.matrix(spark, self.distance_matrix, self.count_matrix)
        dist = cluster.checkpointed(dist)
        assign, trash = cluster.one_group(cells, dist) if self.skip_kmeans else cluster.bisecting_kmeans(dist, cells, self.num_clusters, self.seed)
        save = lambda i, a, t: sinks.clusters(a, t, cells, f"{self.output}/iterations/{i}.tsv")
        assign, trash = cluster.recluster(dist, assign, trash, self.num_clusters, self.num_iterations, save)
        sinks.clusters(assign, trash, cells, f"{self.output}/clusters.tsv")
        return assign, trash


@dataclass
class EvalSubGroups:
    """Precision and recall against known lists; histograms of distances in and between groups."""

    groups: str
    output: str
    known: dict[str, str] = field(default_factory=dict)
    distance_matrix: str | None = None

    def run(self, spark: SparkSession) -> DataFrame | None:
        found, result = text.clusters(spark, self.groups), None
        if self.known:
            result = groups.precision_recall(text.known_lists(spark, self.known), found)
            sinks.table(result, f"{self.output}/compare-groups.tsv", ["known", "grp"])
            sinks.stats(result, f"{self.output}/compare-groups")
            for name in ("precision", "recall"):
                wide = result.groupBy("known").pivot("grp").agg(F.first(name))
                sinks.table(wide, f"{self.output}/{name}.tsv", ["known"])
        if self.distance_matrix:
            dist, cells = text.matrix(spark, self.distance_matrix)
            sinks.histogram(matrix.histogram(dist), f"{self.output}/histogram.tsv")
            sinks.histogram(matrix.binned(matrix.histogram(dist)), f"{self.output}/histogram.binned.tsv")
            each = matrix.subgroup_histogram(dist, found.join(cells, "barcode").select("cell", "grp"))
            sinks.table(each, f"{self.output}/subgroup.histograms.tsv", ["g1", "g2", "value"])
        return result


@dataclass
class ExtractGroupVariants:
    """Calls of cells merged to groups, with genotypes; VCF of all and of informative sites."""

    input: str
    groups: str
    correct_cells: str
    output: str
    reference: str | None = None
    min_sample_depth: int = 50
    ploidy: int = 2
    partitions: int = 200

    def run(self, spark: SparkSession) -> DataFrame:
        cells = text.cell_list(spark, self.correct_cells)
        calls, obs = vcf.read(spark, self.input, cells)
        obs = obs.withColumn("site", _site())
        listed = text.clusters(spark, self.groups)
        names = sorted(r[0] for r in listed.select("grp").distinct().collect())  # the header's columns
        ids = spark.createDataFrame(list(enumerate(names)), "g int, grp string")
        member = listed.join(cells, "barcode", "left")
        ok = F.when(F.col("cell").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("Unknown barcode: "), F.col("barcode"))).cast("boolean"))
        member = member.filter(ok).join(ids, "grp").select("cell", F.col("g").alias("grp"))
        genotyped = groups.group_genotypes(obs, member, ploidy=self.ploidy)
        good = groups.informative_sites(genotyped, self.min_sample_depth)
        merged, _ = groups.group_calls(obs, member)
        place = calls.withColumn("site", _site())
        rows = merged.join(place.select("site", "contig", "pos"), "site").withColumnRenamed("grp", "cell")
        called = genotyped.join(place.select("site", "contig", "pos"), "site").select("contig", "pos", F.col("grp").alias("cell"), "genotype", "cn")
        every = vcf.lines(calls, rows.drop("site"), names, None, called).withColumn("site", _site())
        vcf.write(every.drop("site"), f"{self.output}/output-vcf", names, partitions=self.partitions)
        vcf.write(every.join(good, "site", "left_semi").drop("site"), f"{self.output}/output-filter-vcf", names, partitions=self.partitions)
        return genotyped


@dataclass
class ExtractCellFastqs:
    """Reads of each listed cell as FASTQ."""

    input: str
    output: str
    correct_cells: str
    sample_tag: str = "CB"
    skip_duplicates: bool = False

    def run(self, spark: SparkSession) -> DataFrame:
        reads = text.aligned(spark, self.input).withColumn("barcode", F.col("tags")[self.sample_tag])
        fragments = merge.fastq_reads(reads, text.cell_list(spark, self.correct_cells), skip_duplicates=self.skip_duplicates)
        sinks.fastq(fragments, self.output)
        return fragments


@dataclass
class MergeRuns:
    """Pooled runs as one, with prefixed barcodes, simulated doublets and downsampling."""

    inputs: dict[str, str]
    barcodes: dict[str, str]
    output: str
    output_barcodes: str
    sample_tag: str = "CB"
    umi_tag: str = "UB"
    downsample_fraction: float = 1.0
    doublets: int = 0
    seed: int = 12345

    def run(self, spark: SparkSession) -> DataFrame:
        if len(self.inputs) < 2:
            raise ValueError("At least two inputs are needed")
        runs = {k: text.aligned(spark, p).withColumns({"barcode": F.col("tags")[self.sample_tag], "umi": F.col("tags")[self.umi_tag], "ord": F.monotonically_increasing_id()}) for k, p in self.inputs.items()}
        listed = text.sample_barcodes(spark, self.barcodes).select("barcode")
        pairs_ = merge.doublet_pairs(listed, self.doublets, self.seed)
        reads = merge.with_doublets(merge.merged(runs), pairs_) if self.doublets else merge.merged(runs)
        reads = merge.downsampled(reads, self.downsample_fraction, ["sample", "barcode", "umi", "name", "flag", "pos"], self.seed)
        own = F.map_from_entries(F.filter(F.array(F.struct(F.lit(self.sample_tag).alias("k"), F.col("barcode").alias("v")), F.struct(F.lit(self.umi_tag).alias("k"), F.col("umi").alias("v"))), lambda x: x["v"].isNotNull()))
        rest = F.map_filter("tags", lambda k, _: ~k.isin(self.sample_tag, self.umi_tag))
        reads = reads.withColumn("tags", F.map_concat(rest, own))
        contigs: dict[str, int] = {}  # in the order of the headers
        for path in self.inputs.values():
            for name, length in text.contigs(spark, path):
                contigs.setdefault(name, length)
        rank = F.create_map(*(F.lit(x) for k, c in enumerate(contigs) for x in (c, k)))[F.col("contig")] if contigs else F.lit(None).cast("int")
        out = merge.coordinate_sorted(reads.withColumn("contig_rank", rank)).drop("contig_rank")
        if self.output.endswith(".bam"):
            bam.write(out, self.output, list(contigs.items()))
        else:
            sinks.sam(out, self.output, ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{c}\tLN:{n}" for c, n in contigs.items())])
        names = listed.select(F.lit(0).alias("late"), "barcode")
        if self.doublets:  # behind all barcodes
            names = names.union(pairs_.select(F.lit(1), "doublet").distinct())
        sinks.write_lines(names.select("late", F.col("barcode").alias("value")), self.output_barcodes, ["late", "value"])
        return out


TOOLS = {t.__name__: t for t in (CellReads, CellVariantcaller, CalculateDistance, GroupDistance, EvalSubGroups, ExtractGroupVariants, ExtractCellFastqs, MergeRuns)}
