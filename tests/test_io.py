from __future__ import annotations

import glob
import gzip
import random

import pytest
from pyspark.sql import functions as F

from genoloom import cli
from genoloom.operators import variants
from genoloom.plans import tools
from genoloom.sources import bam, sinks, text, vcf


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(path, content):
    path.write_text(content)
    return str(path)


@pytest.fixture
def cells_file(tmp_path):
    return put(tmp_path / "cells.txt", "s1\ns2\ns3\n")


def test_cell_list(spark, tmp_path, cells_file):
    assert rows(text.cell_list(spark, cells_file)) == [(0, "s1"), (1, "s2"), (2, "s3")]
    with pytest.raises(ValueError, match="Duplicate barcode: a"):
        text.cell_list(spark, put(tmp_path / "bad.txt", "a\nb\na\n"))


def test_clusters(spark, tmp_path):
    good = put(tmp_path / "g.tsv", "#barcode\tcluster\ns1\tc1\ns2\tc2\n")
    assert rows(text.clusters(spark, good)) == [("s1", "c1"), ("s2", "c2")]
    with pytest.raises(Exception, match="Not two columns"):
        text.clusters(spark, put(tmp_path / "b.tsv", "s1\n")).collect()


def test_matrix_round_trip(spark, tmp_path, cells_file):
    cells = text.cell_list(spark, cells_file)
    dist = spark.createDataFrame([(0, 1, 0.25), (1, 2, 1.5)], "s1 int, s2 int, d double")
    path = str(tmp_path / "m.tsv")
    sinks.matrix(dist, cells, path)
    assert open(path).read() == "Sample\ts1\ts2\ts3\ns1\t.\t0.25\t.\ns2\t.\t.\t1.5\ns3\t.\t.\t.\n"
    got, names = text.matrix(spark, path, check_order=True)
    assert rows(got) == rows(dist) and rows(names) == rows(cells)
    counts = spark.createDataFrame([(0, 1, 5)], "s1 int, s2 int, d int")
    sinks.matrix(counts, cells, str(tmp_path / "n.tsv"))
    assert rows(text.matrix(spark, path, str(tmp_path / "n.tsv"))[0]) == [(0, 1, 0.05)]


def test_fasta_and_regions(spark, tmp_path):
    fa = text.fasta(spark, put(tmp_path / "r.fa", ">c1 x\nACGT\nAC\n>c2\nTT\n"))
    assert rows(fa) == [("c1", "ACGTAC"), ("c2", "TT")]
    assert text.reference_window(fa, "c1", 2, 4).first()["seq"] == "CGT"
    assert rows(text.regions(spark, put(tmp_path / "r.bed", "#x\nc1\t1\t5\n"))) == [("c1", 1, 5)]


@pytest.fixture
def observed(spark):
    variants = spark.createDataFrame([("c1", 1000, "A", ["G"])], "contig string, pos bigint, ref string, alts array<string>")
    data = [("c1", 1000, c, a, n, 0, n, 0) for c, ns in enumerate([(10, 0), (10, 0), (0, 10)]) for a, n in enumerate(ns)]
    obs = spark.createDataFrame(data, "contig string, pos bigint, cell int, allele int, f_umi bigint, r_umi bigint, f_reads bigint, r_reads bigint")
    return variants, obs


def test_vcf_round_trip(spark, tmp_path, observed, cells_file):
    calls, obs = observed
    path = str(tmp_path / "x-vcf")
    vcf.write(vcf.lines(calls, obs, ["s1", "s2", "s3"]), path, ["s1", "s2", "s3"], partitions=1)
    v, o = vcf.read(spark, path, text.cell_list(spark, cells_file))
    assert rows(v) == rows(calls) and rows(o) == rows(obs)
    with pytest.raises(ValueError, match="Unknown sample"):
        vcf.read(spark, path, spark.createDataFrame([(0, "s1")], "cell int, barcode string"))


def test_distance_to_groups(spark, tmp_path, observed, cells_file):
    sites, obs = observed
    calls = str(tmp_path / "x-vcf")
    vcf.write(vcf.lines(sites, obs, ["s1", "s2", "s3"]), calls, ["s1", "s2", "s3"], partitions=1)
    out = str(tmp_path / "dist")
    tools.CalculateDistance(calls, out, cells_file, write_scatters=True).run(spark)
    body = open(f"{out}/distance.pow4.csv").read().splitlines()
    assert body[1] == "s1\t.\t0.0\t0.5000000000000001" and body[2] == "s2\t.\t.\t0.5000000000000001"
    tools.GroupDistance(f"{out}/distance.pow4.csv", str(tmp_path / "grp"), cells_file, 2, num_iterations=3).run(spark)
    found = {}
    for b, g in text.clusters(spark, str(tmp_path / "grp/clusters.tsv")).collect():
        found.setdefault(g, set()).add(b)
    assert sorted(map(sorted, found.values())) == [["s1", "s2"], ["s3"]]
    groups = put(tmp_path / "g.tsv", "s1\tcluster_1\ns2\tcluster_1\ns3\tcluster_2\n")
    got = tools.ExtractGroupVariants(calls, groups, cells_file, str(tmp_path / "ev"), min_sample_depth=5, partitions=1).run(spark)
    assert {r["grp"]: r["ad"] for r in got.collect()} == {0: [20, 0], 1: [0, 10]}
    lines = spark.read.text(str(tmp_path / "ev/output-filter-vcf")).filter("value not like '#%'").collect()
    assert len(lines) == 1 and "0/0:2" in lines[0][0] and "1/1:1" in lines[0][0]
    result = tools.EvalSubGroups(groups, str(tmp_path / "eval"), {"a": put(tmp_path / "a.txt", "s1\ns2\n"), "b": put(tmp_path / "b.txt", "s3\n")}, f"{out}/distance.pow4.csv").run(spark)
    assert {(r["known"], r["grp"]): r["precision"] for r in result.collect()}[("a", "cluster_1")] == 1.0
    assert open(tmp_path / "eval/compare-groups/a-cluster_1.stats").read() == "Overlap\t2\nMissed\t0\nWrong\t0\nPrecision\t1.0\nRecall\t1.0\n"


SAM = "@HD\tVN:1\n" + "".join(f"r{i}\t{f}\tc1\t{p}\t60\t10M\t*\t0\t0\t{s}\tIIIIIIIIII\tSM:Z:{c}\tUB:Z:{u}\n" for i, (f, p, s, c, u) in enumerate([(0, 1, "AAAACAAAAA", "s1", "U1"), (0, 1, "AAAACAAAAA", "s1", "U1"), (0, 1, "AAAACAAAAA", "s1", "U2"), (1024, 1, "AAAAAAAAAA", "s2", "U3"), (16, 1, "AAAAAAAAAA", "s2", "U4"), (0, 1, "AAAAAAAAAA", "nobody", "U5")]))


def test_reads_tools(spark, tmp_path, cells_file):
    sam = put(tmp_path / "x.sam", SAM)
    reference = put(tmp_path / "r.fa", ">c1\n" + "A" * 30 + "\n")
    counts = tools.CellReads(sam, str(tmp_path / "cr"), "SM").run(spark)
    assert rows(counts) == [("nobody", 1, 1), ("s1", 3, 3), ("s2", 1, 2)]
    caller = tools.CellVariantcaller(sam, reference, cells_file, str(tmp_path / "cv"), "SM", "UB", cutoffs=variants.Cutoffs(min_total_depth=2), partitions=1)
    good = caller.run(spark)
    # position 5: C in s1 by two UMIs of three reads; s2 has the reference
    assert caller.calls(spark)[0].select("contig", "pos", "ref", "alts").collect() == [("c1", 5, "A", ["C"])]
    counts = {(r["pos"], r["cell"], r["allele"]): (r["f_umi"], r["r_umi"], r["f_reads"], r["r_reads"]) for r in good.collect()}
    assert counts == {(5, 0, 1): (2, 0, 3, 0), (5, 1, 0): (1, 1, 1, 1)}
    fragments = tools.ExtractCellFastqs(sam, str(tmp_path / "fq"), cells_file, "SM").run(spark)
    assert fragments.count() == 5
    merged = tools.MergeRuns({"a": sam, "b": sam}, {"a": cells_file, "b": cells_file}, str(tmp_path / "m"), str(tmp_path / "m.txt"), "SM", doublets=1).run(spark)
    assert merged.filter("barcode like 'a-%' and barcode not like '%\\_%'").count() == 6
    assert len(open(tmp_path / "m.txt").read().split()) == 7


def test_binary_reads(spark, tmp_path):
    """Records over block borders, ranges smaller than a record, and fields that are missing."""
    rnd = random.Random(5)
    data = []
    for i in range(400):
        n = 70000 if i % 90 == 7 else rnd.choice([0, 1, 5, 50, 151])
        bases, quals = "".join(rnd.choice("ACGTN") for _ in range(n)), "".join(chr(34 + rnd.randrange(40)) for _ in range(n))
        data.append((f"r{i}", rnd.choice([0, 16, 1024, 4]), rnd.choice(["c1", "c2", None]), rnd.randrange(100000), rnd.randrange(256), f"{n}M" if n else "*", bases or "*", quals or "*", {"CB": f"b{i % 7}", "UB": "x" * rnd.randrange(9)}))
    path, contigs = str(tmp_path / "x.bam"), [("c1", 1000000), ("c2", 50)]
    bam.write(spark.createDataFrame(data, bam.ROW_DDL).repartition(2), path, contigs)
    assert bam.contigs(spark, path) == contigs
    files = sorted(glob.glob(f"{path}/*.bam"))
    assert [f.rsplit("/", 1)[1] for f in files] == ["0.bam", "1.bam"]
    for f in files:
        body, blocks = open(f, "rb").read(), gzip.open(f).read()
        assert body.endswith(bam.EOF_BLOCK) and blocks[:4] == b"BAM\x01"
        whole = [r for c in bam._range(f, 0, len(body), 64) for r in c]
        for step in (50000, 2500):
            assert [r for a in range(0, len(body), step) for c in bam._range(f, a, min(a + step, len(body)), 64) for r in c] == whole
        cut = str(tmp_path / "cut.bam")
        with open(cut, "wb") as out:
            out.write(body[: len(body) // 2])
        with pytest.raises(ValueError, match="No block|cut off"):
            list(bam._range(cut, 0, len(body) // 2, 64))
    key = lambda r: tuple(sorted(r[8].items())) + tuple(map(str, r[:8]))
    for size in (1 << 26, 40000):
        assert sorted(map(key, bam.bam(spark, path, size).collect())) == sorted(map(key, data))
    with pytest.raises(Exception, match="not in the header"):
        bam.write(spark.createDataFrame(data, bam.ROW_DDL), str(tmp_path / "y.bam"), contigs[:1])
    empty = str(tmp_path / "e.bam")
    bam.write(spark.createDataFrame([], bam.ROW_DDL).coalesce(1), empty, contigs)
    assert not glob.glob(f"{empty}/*.bam") or bam.bam(spark, empty).isEmpty()


def test_tags_of_all_types():
    """Against bytes laid out by hand."""
    raw = b"XAAq" + b"Xcc\xff" + b"XSS\x01\x02" + b"XiI\xff\xff\xff\xff" + b"Xff\x00\x00\xc0\x3f" + b"XZZa:b\x00" + b"XBBs\x02\x00\x00\x00\x01\x00\xff\xff"
    assert bam._tags(bytearray(raw), 0, len(raw)) == [("XA", "q"), ("Xc", "-1"), ("XS", "513"), ("Xi", "4294967295"), ("Xf", "1.5"), ("XZ", "a:b"), ("XB", "s,1,-1")]
    for n in (1, 2, 3):
        with pytest.raises(ValueError, match="tag"):
            bam._tags(bytearray(raw), 0, len(raw) - n)


def test_binary_reads_through_tools(spark, tmp_path, cells_file):
    sam = put(tmp_path / "x.sam", SAM.replace("@HD\tVN:1\n", "@HD\tVN:1\n@SQ\tSN:c1\tLN:30\n"))
    out = str(tmp_path / "m.bam")
    merged = tools.MergeRuns({"a": sam, "b": sam}, {"a": cells_file, "b": cells_file}, out, str(tmp_path / "m.txt"), "SM", doublets=1).run(spark)
    assert bam.contigs(spark, out) == [("c1", 30)]
    key = ["name", "flag", "contig", "pos", "cigar", "seq", "qual", F.array_sort(F.map_entries("tags"))]
    assert rows(text.aligned(spark, out).select(key)) == rows(merged.select(key)) == rows(text.sam(spark, _as_text(spark, merged, tmp_path)).select(key))
    names = open(tmp_path / "m.txt").read().split()
    assert names[:6] == sorted(names[:6]) and "_" in names[6] and len(names) == 7
    one = str(tmp_path / "one.bam")
    bam.write(text.sam(spark, sam).coalesce(1), one, [("c1", 30)])
    reference = put(tmp_path / "r.fa", ">c1\n" + "A" * 30 + "\n")
    cells = text.cell_list(spark, cells_file)
    call = lambda p: rows(tools.CellVariantcaller(p, reference, cells_file, None, "SM", "UB", cutoffs=variants.Cutoffs(min_total_depth=2)).calls(spark)[3])
    assert call(one) == call(sam) != []
    assert rows(tools.load_calls(spark, one, cells, cells_file, reference)) == rows(tools.load_calls(spark, sam, cells, cells_file, reference))


def _as_text(spark, reads, tmp_path):
    path = str(tmp_path / "as-text")
    sinks.sam(reads, path)
    return path


def test_reads_by_intervals(spark, tmp_path, cells_file):
    sam, bed = put(tmp_path / "x.sam", SAM + SAM.splitlines()[1].replace("\tc1\t1\t", "\tc1\t500\t") + "\n"), put(tmp_path / "r.bed", "c1\t3\t6\nc1\t8\t12\n")
    reference = put(tmp_path / "r.fa", ">c1\n" + "A" * 600 + "\n")
    assert rows(tools.CellReads(sam, str(tmp_path / "cr"), "SM", bed).run(spark)) == [("nobody", 1, 1), ("s1", 3, 3), ("s2", 1, 2)]
    caller = tools.CellVariantcaller(sam, reference, cells_file, None, "SM", "UB", cutoffs=variants.Cutoffs(min_total_depth=2), intervals=bed)
    assert [r["pos"] for r in caller.calls(spark)[0].collect()] == [5]


def test_arguments():
    tool = cli.parsed(tools.CalculateDistance, ["--input", "x", "--output", "y", "--correct-cells", "z", "--additional-methods", "chi2", "--additional-methods", "pow2", "--write-scatters"])
    assert (tool.method, tool.additional_methods, tool.write_scatters, tool.min_allele_coverage) == ("pow4", ("chi2", "pow2"), True, 5)
    tool = cli.parsed(tools.EvalSubGroups, ["--groups", "g", "--output", "o", "--known", "a=x", "--known", "b=y"])
    assert tool.known == {"a": "x", "b": "y"}
    with pytest.raises(SystemExit):
        cli.parsed(tools.GroupDistance, ["--output", "o"])
    assert cli.main(["nothing"]) == 2


@pytest.mark.parametrize("numbers", [range(9), range(5, 50, 5)])
def test_matrix_in_parts(spark, tmp_path, monkeypatch, numbers):
    """A folder of parts is the matrix in order; lines of two matrices meet without a row a value, and a count of 0 gives null."""
    import glob
    import gzip

    numbers = list(numbers)
    monkeypatch.setattr(sinks, "PART_BYTES", 100)
    cells = spark.createDataFrame([(c, f"b{i}") for i, c in enumerate(numbers)], "cell int, barcode string")
    pairs = [(a, b) for a in numbers for b in numbers if a < b and (a + b) % 4]
    dist = spark.createDataFrame([(a, b, a + b / 8, (a * b) % 3) for a, b in pairs], "s1 int, s2 int, d double, positions bigint")
    one, d, n = (str(tmp_path / x) for x in ("one.tsv", "d", "n"))
    sinks.matrix(dist, cells, one)
    sinks.matrix(dist, cells, d, single=False)
    sinks.matrix(dist, cells, n, "positions", single=False)
    files = sorted(glob.glob(f"{d}/*.tsv.gz"), key=lambda f: int(f.split("/")[-1].split(".")[0]))
    assert len(files) > 2 and "".join(gzip.open(f, "rt").read() for f in files) == open(one).read()
    place = {c: i for i, c in enumerate(numbers)}
    assert sorted(map(tuple, text.matrix(spark, d)[0].collect())) == sorted((place[a], place[b], a + b / 8) for a, b in pairs)
    by, names = text.matrix(spark, d, n)
    want = [(place[a], place[b], (a + b / 8) / (a * b % 3) if a * b % 3 else None) for a, b in pairs]
    assert sorted(map(tuple, by.collect()), key=str) == sorted(want, key=str) and names.count() == 9
    assert "Generate" not in by._jdf.queryExecution().executedPlan().toString()
