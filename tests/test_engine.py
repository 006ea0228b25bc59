"""Functions, sources, sinks and plans of the engine."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def one(spark, sql):
    return spark.sql(f"SELECT {sql}").collect()[0][0]


def test_list_functions(spark):
    from helixframe.functions import cohort as c

    df = spark.sql("SELECT array(1, null, 3) AS a, cast(null AS array<int>) AS n, array(cast(null AS int)) AS z, array(true, null, false, true) AS p, array(null, null, true) AS q")
    r = df.select(
        c.list_avg("a").alias("avg"), c.list_avg("n").alias("none"), c.list_avg("z").alias("nulls"), c.list_gte("a", 2).alias("gte"), c.list_lte("a", F.lit(None).cast("int")).alias("unknown"), c.list_and("p", "q").alias("both"), c.list_and("p", F.lit(None).cast("array<boolean>")).alias("gone")
    ).collect()[0]
    assert (r["avg"], r["none"], r["nulls"]) == (2.0, None, None)
    assert r["gte"] == [False, None, True] and r["unknown"] == [None, None, None]
    assert r["both"] == [None, None, False] and r["gone"] is None


def test_genotype_functions(spark):
    from helixframe.functions import cohort as c

    df = spark.createDataFrame([(["0/1", "0/1", "1/1"], [True, False, None]), (["./.", ".", None], [True]), (["2|1", "./1"], None), (None, [True]), ([], [])], "gt array<string>, m array<boolean>")
    got = df.select(c.vcf_an("gt").alias("an"), c.vcf_ac("gt").alias("ac"), c.vcf_ac("gt", F.lit("A|T")).alias("ac2"), c.vcf_af("gt", F.lit("A|T")).alias("af"), c.vcf_set_gts("gt", "m").alias("set")).collect()
    assert [r["an"] for r in got] == [6, 0, 3, None, 0]
    assert [r["ac"] for r in got] == [[4], [], [2, 1], None, []]
    assert [r["ac2"] for r in got] == [[4, 0], [0, 0], [2, 1], None, [0, 0]]
    assert got[0]["af"] == [4 / 6, 0] and got[1]["af"] == [None, None] and got[3]["af"] is None
    assert [r["set"] for r in got] == [["0/1", "./.", "1/1"], ["./.", ".", None], ["2|1", "./1"], None, []]
    c.register_functions(spark)
    df.createOrReplaceTempView("gts")
    same = spark.sql("SELECT vcf_an(gt) AS an, vcf_ac(gt) AS ac, vcf_ac(gt, 'A|T') AS ac2, vcf_af(gt, 'A|T') AS af, vcf_set_gts(gt, m) AS set FROM gts").collect()
    assert same == got


def test_long_view(spark):
    from helixframe.operators.views import long_view, register_long_view

    df = spark.sql("SELECT 'c' AS chrom, 1 AS start, named_struct('GT', array('0/1'), 'DP', array(5, 6)) AS genotypes, 9 AS info")
    got = [tuple(r) for r in long_view(df, ["it's", "S2"], ["GT", "DP"]).collect()]
    assert got == [("c", 1, "it's", "0/1", 5), ("c", 1, "S2", None, 6)]
    assert long_view(df, [], ["GT"]) is df and not register_long_view(df.drop("genotypes"), "t")
    assert register_long_view(df, "t", ["a", "b"]) and spark.table("t_long").count() == 2


def test_cigar_and_tags(spark):
    from helixframe.functions.alignment import binary_to_cigar, cigar_to_binary, nm_md

    df = spark.createDataFrame([("10M2I3D",), ("*",), (None,)], "c string")
    r = df.select(cigar_to_binary("c").alias("b"), "c").select("b", binary_to_cigar("b").alias("back")).collect()
    assert bytes(r[0]["b"]) == b"".join((n << 4 | k).to_bytes(4, "little") for n, k in ((10, 0), (2, 1), (3, 2)))
    assert [x["back"] for x in r] == ["10M2I3D", "*", None]
    with pytest.raises(Exception, match="zero"):
        spark.createDataFrame([("0M",)], "c string").select(cigar_to_binary("c")).collect()
    assert nm_md("4M", "ACGT", "ACCT") == (1, "2C1")
    assert nm_md("2M2D2M", "ACGT", "ACTTGT") == (2, "2^TT2")
    assert nm_md("2M1I1M", "ACTG", "ACG") == (1, "3")
    assert nm_md("2M1I1X", "ACTG", None) == (2, None) and nm_md("*", "A", "A") == (None, None)


def test_vcf(spark, tmp_path):
    from helixframe.sinks.lines import write_vcf
    from helixframe.sources.text import describe_vcf, read_vcf

    text = """##fileformat=VCFv4.3
##INFO=<ID=DP,Number=1,Type=Integer,Description="a, b">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=DB,Number=0,Type=Flag,Description="k">
##INFO=<ID=END,Number=1,Type=Integer,Description="e">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="d">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
c1\t10\t.\tA\tG\t9.5\tPASS\tDP=3;DB;AF=0.5\tGT:DP\t0/1:4\t1|0
c1\t20\trs1\tAT\tA,G\t.\t.\tDP\tGT:AD\t./.:1,2,.\t0/0
c2\t30\t.\tN\t<DEL>\t1\tq10;s5\tEND=50;AF=.,0.25\tGT\t1/1\t.
"""
    path = tmp_path / "a.vcf.gz"
    half = text.index("c1\t20")
    path.write_bytes(gzip.compress(text[:half].encode()) + gzip.compress(text[half:].encode()))  # two members
    got = read_vcf(spark, str(path)).collect()
    assert [(r["start"], r["end"], r["id"], r["alt"], r["qual"], r["filter"]) for r in got] == [(9, 10, "", "G", 9.5, "PASS"), (19, 21, "rs1", "A|G", None, ""), (29, 50, "", "<DEL>", 1.0, "q10;s5")]
    assert [(r["DP"], r["DB"]) for r in got] == [(3, True), (None, False), (None, False)]
    assert [r["AF"] for r in got] == [[0.5], None, [None, 0.25]]
    g = [r["genotypes"] for r in got]
    assert g[0]["GT"] == ["0/1", "1|0"] and g[0]["DP"] == [4, None] and g[1]["AD"] == [[1, 2, None], None]
    assert read_vcf(spark, str(path), samples=["S2"]).collect()[0]["genotypes"]["GT"] == ["1|0"]
    with pytest.raises(ValueError, match="no such sample"):
        read_vcf(spark, str(path), samples=["S9"])
    assert read_vcf(spark, str(path), info_fields=[], format_fields=[], zero_based=False).columns == ["chrom", "start", "end", "id", "ref", "alt", "qual", "filter"]
    out = tmp_path / "b.vcf"
    write_vcf(read_vcf(spark, str(path)), str(out), formats={"GT": {"number": "1", "type": "String", "description": "g"}})
    body = [x for x in out.read_text().splitlines() if not x.startswith("#")]
    assert body[0] == "c1\t10\t.\tA\tG\t9.50\tPASS\tDP=3;AF=0.5;DB\tGT\t0/1\t1|0"
    assert read_vcf(spark, str(out)).select("start", "AF").collect() == read_vcf(spark, str(path)).select("start", "AF").collect()
    assert describe_vcf(spark, str(path)).where("name = 'AD'").collect()[0]["data_type"] == "array<int>"
    with pytest.raises(ValueError):
        write_vcf(read_vcf(spark, str(out)), "x.bcf")
    plan = read_vcf(spark, str(path)).select("chrom")._jdf.queryExecution().optimizedPlan().toString()
    assert "DP" not in plan  # unused fields are not parsed


def test_flag_with_value_is_an_error(spark, tmp_path):
    from helixframe.sources.text import read_vcf

    p = tmp_path / "f.vcf"
    p.write_text('##INFO=<ID=DB,Number=0,Type=Flag,Description="k">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t1\t.\tA\tC\t.\t.\tDB=1\n')
    with pytest.raises(Exception, match="flag"):
        read_vcf(spark, str(p)).collect()


def test_gff_gtf_bed_pairs(spark, tmp_path):
    from helixframe.sources import text as t

    (tmp_path / "a.gff").write_text('##gff-version 3\nc\ts\tgene\t5\t9\t.\t+\t.\tID=g;N=a%2Cb%20;Q="x"\nc\ts\texon\t1\t2\t0.5\t-\t2\t.\n')
    g = t.read_gff(spark, str(tmp_path / "a.gff")).collect()
    assert [tuple(x) for x in g[0]["attributes"]] == [("ID", "g"), ("N", "a,b%20"), ("Q", "x")] and g[1]["attributes"] == []
    assert (g[0]["start"], g[0]["end"], g[1]["score"], g[1]["phase"]) == (4, 9, 0.5, 2)
    flat = t.read_gff(spark, str(tmp_path / "a.gff"), ["ID", "attributes"], zero_based=False)
    assert flat.columns[-2:] == ["ID", "attributes"] and flat.where("start = 5").count() == 1 and flat.where("phase = 2").count() == 1
    (tmp_path / "a.gtf").write_text('c\ts\tgene\t5\t9\tx\t+\t.\tgene_id "G"; tag "a"; tag "b"; n 1\n')
    r = t.read_gtf(spark, str(tmp_path / "a.gtf"), ["gene_id", "tag", "n", "none"]).collect()[0]
    assert (r["gene_id"], r["tag"], r["n"], r["none"], r["score"]) == ("G", "a,b", "1", None, None)
    (tmp_path / "bad.gtf").write_text("c\ts\n")
    with pytest.raises(Exception, match="9"):
        t.read_gtf(spark, str(tmp_path / "bad.gtf"), ["x"]).collect()
    (tmp_path / "a.bed").write_text("track x\nc\t1\t5\tn\t7\t-\nc\t2\t6\n")
    assert [tuple(r) for r in t.read_bed(spark, str(tmp_path / "a.bed"), 6).collect()] == [("c", 1, 5, "n", 7.0, "-"), ("c", 2, 6, None, None, None)]
    (tmp_path / "a.pairs").write_text("## pairs\n#columns: readID chr1 pos1 chr2 pos2 strand1 strand2 mapq1 x\nr\ta\t1\tb\t2\t+\t-\t30\tq\n")
    p = t.read_pairs(spark, str(tmp_path / "a.pairs")).collect()[0]
    assert (p["pos1"], p["mapq1"], p["x"]) == (1, 30, "q")


def reads(spark, n):
    rng = random.Random(n)
    rows = [(f"r{i}", "d x" if i % 2 else None, "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 80)))) for i in range(n)]
    return spark.createDataFrame([(a, b, s, "@" * len(s)) for a, b, s in rows], "name string, description string, sequence string, quality_scores string")


@pytest.mark.parametrize("suffix", ["fastq", "fastq.gz", "fastq.bgz"])
def test_fastq(spark, tmp_path, suffix):
    from helixframe.sinks.lines import write_fastq
    from helixframe.sources.text import read_fastq

    df, path = reads(spark, 3000), str(tmp_path / f"a.{suffix}")
    write_fastq(df, path)
    want = sorted(map(tuple, df.collect()))
    for size in (1 << 30, 50_000, 7_001):
        assert sorted(map(tuple, read_fastq(spark, path, size).collect())) == want  # qualities are all '@'
    assert read_fastq(spark, path, 7_001).where("name = 'r5'").count() == 1


def test_fasta(spark, tmp_path):
    from helixframe.sinks.lines import write_fasta
    from helixframe.sources.text import read_fasta

    df, path = reads(spark, 50).drop("quality_scores"), str(tmp_path / "a.fa.gz")
    write_fasta(df, path, width=10)
    assert sorted(map(tuple, read_fasta(spark, path).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def documents(spark, folder, texts):
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_whole_reads(spark, tmp_path):
    """Every document in full length, whatever its language and characters; records longer than a byte range."""
    from helixframe.catalog import QUERIES

    rng = random.Random(5)
    texts = ["".join(rng.choice("abz ABZ.,\n\t0é漢😀İ") for _ in range(n)) for n in (1, 59, 60, 61, 300, 301, 5_000, 300_000, 700_000)] + ["", None, "x" * 601]
    d = documents(spark, tmp_path, texts)
    base = {c: "ACGT"[k % 4] for k, c in enumerate("abcdefghijklmnopqrstuvwxyz .,\n")}
    base |= {c.upper(): x for c, x in base.items()}
    want = sorted((f"s{i}", "some read", "".join(base.get(c, "N") for c in t or "")) for i, t in enumerate(texts))
    for name in ("fasta_read", "fastq_read"):
        assert sorted(map(tuple, QUERIES[name](spark, d).collect())) == want, name
    total = (len(want), sum(len(x) for _, _, x in want))
    assert sorted(map(tuple, QUERIES["fastq_partition_invariance"](spark, d).collect())) == [(k, *total) for k in range(4)]


def test_whole_md(spark):
    """MD of every alignment, short and long, against mismatches counted by hand."""
    from helixframe.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    want = {}
    for (n,) in spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("int")).collect():
        off = [k for k in range(n) if k % 4 == 0]  # the reference is CAAA over and over, the read all A
        gaps = [b - a - 1 for a, b in zip([-1, *off], [*off, n])]
        md = "C".join(map(str, gaps))
        want[n, md] = want.get((n, md), 0) + 1
    got = {(r["q"], r["md"]): r["n"] for r in QUERIES["md_tag"](spark, d).collect()}
    assert got == want and max(q for q, _ in got) == 50


@pytest.mark.parametrize("name, source", [("describe_vcf", "orders"), ("describe_sam", "lineitem")])
def test_described_files_are_whole(spark, monkeypatch, name, source):
    """The file described has a record of every order or line item."""
    from helixframe import queries

    d, paths, scratch = "/root/testdata/sf0.001", [], queries._scratch
    monkeypatch.setattr(queries, "_scratch", lambda *a: paths.append(scratch(*a)) or paths[-1])
    assert queries.QUERIES[name](spark, d).count() > 0
    keys = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey")
    want = keys.distinct().count() if source == "orders" else keys.count()
    records = spark.read.text(paths[0]).where(~F.col("value").rlike("^#|^@[A-Z][A-Z]\t"))
    assert records.count() == want


def test_bam_and_sam(spark, tmp_path):
    from helixframe.sinks.lines import write_sam
    from helixframe.sources.alignments import infer_tags, write_bam
    from helixframe.sources.binary import register
    from helixframe.sources.text import read_sam

    rng = random.Random(1)
    rows = [(f"q{i}", rng.choice(["c1", "c2", None]), i * 3, i * 3 + 5, i % 4096, "5M1I", 60, "c1" if i % 3 else None, i if i % 3 else None, "ACGTNA", "IIIII!", -i, i, f"z{i}", [1, i]) for i in range(4000)]
    rows = [r if r[1] else (*r[:2], None, None, *r[4:]) for r in rows]
    names = "name string, chrom string, start long, end long, flags long, cigar string, mapping_quality long, mate_chrom string, mate_start long, sequence string, quality_scores string, template_length int, NM int, RG string, ZB array<int>"
    df = spark.createDataFrame(rows, names)
    kinds, refs = {"NM": "i", "RG": "Z", "ZB": "B:i"}, {"c1": 1 << 20, "c2": 1 << 20}
    want = sorted(map(str, df.collect()))
    path = str(tmp_path / "a.bam")
    write_bam(df, path, refs, kinds)
    register(spark)
    for size in (1 << 30, 20_000):
        got = spark.read.format("bam").option("tags", "NM=i,RG=Z,ZB=B:i").option("splitBytes", size).load(path)
        assert sorted(map(str, got.collect())) == want
    assert infer_tags(path) == kinds
    assert spark.read.format("bam").option("columns", "name,start").load(path).columns == ["name", "start"]
    write_sam(df, str(tmp_path / "a.sam"), refs, kinds)
    assert sorted(map(str, read_sam(spark, str(tmp_path / "a.sam"), kinds).collect())) == want
    write_bam(df, path, refs, sort=True)
    order = [(r[0] is None, r[0] or "", r[1] or 0) for r in spark.read.format("bam").load(path).select("chrom", "start").collect()]
    assert order == sorted(order)


def test_bgen_bits(spark, tmp_path):
    from helixframe import render
    from helixframe.sources.genotypes import Bgen

    rows = [("c", 5, "i", "r", ["A", "C"], [0, 1, 2, None])]
    for compression in (0, 1, 2):
        for bits in (1, 3, 8, 13, 16, 32):
            f = Bgen(render.bgen(str(tmp_path / f"{compression}{bits}.bgen"), rows, list("abcd"), compression, bits))
            v = next(f.catalogue())
            phased, b, ploidy, probs = f.probabilities(v[5], v[6], 2)
            assert (phased, b, ploidy.tolist(), probs[3]) == (False, bits, [2] * 4, None)
            assert np.allclose(np.stack(probs[:3]), np.eye(3))


def test_regions_and_partitions():
    from pyspark.sql import datasource as ds

    from helixframe.plans.regions import Region, Sized, balance, coalesce, extract_regions, fnv1a

    c, s, e = ("chrom",), ("start",), ("end",)
    assert extract_regions([ds.EqualTo(c, "a"), ds.GreaterThanOrEqual(s, 9), ds.LessThan(e, 50)], True) == [Region("a", 10, 49)]
    assert extract_regions([ds.In(c, ("b", None, "a")), ds.GreaterThan(s, 9)], False) == [Region("a", 10), Region("b", 10)]
    assert extract_regions([ds.EqualTo(c, "a"), ds.EqualTo(s, 5), ds.GreaterThan(s, 5)], True) == []
    assert extract_regions([ds.GreaterThan(e, 5)], True) is None
    parts = balance([Sized(Region("a"), 1000, 1_000_000), Sized(Region("b"), 10, 100), Sized(Region("e"), 0)], 4)
    assert len(parts) == 4 and parts[0][0].start == 1 and {"a", "b", "e"} == {r.chrom for p in parts for r in p}
    pieces = [r for p in parts for r in p if r.chrom == "a"]
    assert all(x.end + 1 == y.start for x, y in zip(pieces, pieces[1:], strict=False)) and pieces[-1].end is None
    assert coalesce([(0, 10), (12, 20), (100, 110)], gap=5) == [(0, 20), (100, 110)]
    assert fnv1a(b"") == "cbf29ce484222325" and fnv1a(b"a") == "af63dc4c8601ec8c"


def test_interval_join(spark):
    from helixframe.operators.intervals import interval_join

    rng = random.Random(2)
    rows = [(rng.choice("ab"), s, s + rng.choice([1, 50, 5000, 400_000]), i) for i in range(200) for s in [rng.randrange(500_000)]]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, id int")
    got = sorted((r["l_id"], r["r_id"]) for r in interval_join(df, df, size=100).collect())
    assert got == sorted((a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 22
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_text_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "helixframe", tmp_path / "helixframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'cohort_pipeline' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


def test_indexed_vcf(spark, tmp_path):
    from helixframe.sinks.lines import BGZF_END, compress
    from helixframe.sources.indexes import build_tbi
    from helixframe.sources.text import read_vcf

    rng = random.Random(3)
    rows = []
    for c in ("c1", "c2", "c3"):
        pos = 1
        for _ in range(4000):
            pos += rng.randint(1, 60)
            rows.append((c, pos, "A" * rng.choice([1, 1, 1, 30])))
    text = '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n'
    text += "".join(f"{c}\t{p}\t.\t{r}\tC\t.\tPASS\tDP={p % 50}\n" for c, p, r in rows)
    path = str(tmp_path / "a.vcf.gz")
    (tmp_path / "a.vcf.gz").write_bytes(b"".join(compress(text[k : k + 3000].encode(), "bgzf") for k in range(0, len(text), 3000)) + BGZF_END)
    build_tbi(path)
    for regions in (["c2:5000-9000"], ["c1:1-2000", "c1:1500-2500", "c3:100000-"], ["c9:1-5"], ["c1:1-", "c2:1-", "c3:1-"], ["c2:20010-20012", "c2:20020-20022"]):
        spans = [(x.rpartition(":")[0], *x.rpartition(":")[2].split("-")) for x in regions]
        want = sorted((c, p) for c, p, r in rows if any(c == a and p <= int(e or 1 << 30) and p + len(r) - 1 >= int(s) for a, s, e in spans))
        for n in (1, 5):
            got = sorted((r[0], r[1]) for r in read_vcf(spark, path, zero_based=False, regions=regions, partitions=n).select("chrom", "start").collect())
            assert got == want, (regions, n)
    assert read_vcf(spark, path, regions=[]).count() == 0


def test_bgzf_lines_by_ranges(spark, tmp_path):
    """Every split of a BGZF file gives the same lines: short ones, empty ones, and lines of several blocks."""
    from helixframe.sinks.lines import BGZF_END, bgzf_block
    from helixframe.sources.binary import BgzfLinesReader

    lines = [f"line {k}" for k in range(3000)] + ["x" * 200_000, "", "ä" * 70_000, "end\r"] + [str(k) for k in range(5000)]
    for last in ("\n", ""):
        data = ("\n".join(lines) + last).encode()
        for size in (777, 60_000):
            path = str(tmp_path / f"l{len(last)}{size}.gz")
            with open(path, "wb") as f:
                for a in range(0, len(data), size):
                    f.write(bgzf_block(data[a : a + size]))
                f.write(BGZF_END)
            for step in (1500, 40_000, 1 << 30):
                if size == 777 and step == 1500 or size > 777 or step > 1500:
                    r = BgzfLinesReader({"path": path, "splitBytes": str(step)}, type("S", (), {"names": ["value"]}))
                    got = [x for p in r.partitions() for b in r.read(p) for x in b.column(0).to_pylist()]
                    assert got == [x.rstrip("\r") for x in lines], (last, size, step)


def test_bam_ranges_tags_and_pruning(spark, tmp_path):
    """All tag types, odd lengths, absent values and long records, whatever the split; an index keeps to its region."""
    from helixframe.sources.alignments import write_bam
    from helixframe.sources.binary import register
    from helixframe.sources.indexes import build_bai

    rows = []
    for k in range(4000):
        n = 30_000 if k % 1000 == 7 else k % 9
        rows.append((f"r{k}", "c1" if k % 3 else None, k * 40 if k % 3 else None, k % 4096, f"{n}M" if n else "", k % 255, None, None, "ACGTN"[k % 5] * n, "" if k % 4 == 0 else chr(40 + k % 30) * n, k - 5, k if k % 2 else None, f"z{k}" if k % 5 else "", "Q", float(k) / 2, [k, 2 * k, -1] if k % 7 == 0 else None))
    schema = "name string, chrom string, start long, flags long, cigar string, mapping_quality long, mate_chrom string, mate_start long, sequence string, quality_scores string, template_length int, NM int, RG string, XA string, XF float, XB array<int>"
    df = spark.createDataFrame(rows, schema).withColumn("end", F.lit(None).cast("long"))
    path, tags = str(tmp_path / "t.bam"), {"NM": "i", "RG": "Z", "XA": "A", "XF": "f", "XB": "B:i"}
    write_bam(df.repartition(3), path, {"c0": 1 << 28, "c1": 1 << 28}, tags, sort=True)
    register(spark)
    bam = spark.read.format("bam").option("tags", ",".join(f"{a}={b}" for a, b in tags.items()))
    want = {r[0]: r for r in rows}
    for step in (3000, 1 << 26):
        got = bam.option("splitBytes", step).load(path).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r["name"]]
            n = len(w[8])
            assert (r["chrom"], r["start"], r["flags"], r["cigar"], r["mapping_quality"], r["sequence"], r["template_length"]) == (w[1], w[2], w[3], w[4], w[5], w[8], w[10])
            assert r["quality_scores"] == (w[9] if n and w[9] else "") and r["end"] == (None if w[2] is None else w[2] + max(n, 1))
            assert (r["NM"], r["RG"], r["XA"], r["XF"], r["XB"]) == (w[11], w[12], w[13], w[14], w[15])
    build_bai(path)
    part = bam.load(path).where("chrom = 'c1' and start >= 20000 and start < 24000")
    assert sorted(r["start"] for r in part.collect()) == sorted(r[2] for r in rows if r[2] is not None and 20000 <= r[2] < 24000)


def test_bcf_by_ranges(spark, tmp_path):
    """The same records whatever the split."""
    from helixframe import render
    from helixframe.sources.binary import register

    rng = random.Random(4)
    rows = [(f"c{k % 3}", 10 * k + 1, f"v{rng.randrange(10**9)}", "A", "C", k, [rng.choice(["0/0", "0/1", "1/1", "./."]) for _ in range(20)]) for k in range(20_000)]
    path = render.bcf(str(tmp_path / "t.bcf"), rows, [f"S{k}" for k in range(20)], ["c0", "c1", "c2"])
    register(spark)
    for step in (20_000, 1 << 26):
        df = spark.read.format("bcf").option("splitBytes", step).load(path)
        assert (df.rdd.getNumPartitions() > 5) == (step == 20_000)
        got = df.select("chrom", "start", "id", "DP", "genotypes.GT").collect()
        assert sorted(map(tuple, got), key=lambda r: r[3]) == [(r[0], r[1] - 1, r[2], r[5], r[6]) for r in rows]


def test_matrix_in_blocks(spark, tmp_path):
    from helixframe import render
    from helixframe.operators.matrix import read_matrix

    rows = [("c", 10 * k + 1, f"v{k}", "A", "C", [None if (k + i) % 4 == 3 else (k + i) % 4 for i in range(5)]) for k in range(700)]
    got = read_matrix(spark, render.pgen(str(tmp_path / "m.pgen"), rows, [f"S{k}" for k in range(5)]))
    assert got.tolist() == [[-1 if g is None else g for g in r[5]] for r in rows]


def test_md_of_odd_bases():
    """The spans of an operation against base by base."""
    from helixframe.functions.alignment import nm_md

    rng = random.Random(6)
    for _ in range(300):
        ops = [(rng.randint(1, 9), "M"), *((rng.randint(1, 9), rng.choice("MIDNS=X")) for _ in range(rng.randint(0, 5)))]
        q = "".join(rng.choice("ACGTNacgt=") for _ in range(sum(n for n, o in ops if o in "MIS=X")))
        ref = "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 40)))
        nm, i, r, same, md = 0, 0, 0, 0, ""
        for n, o in ops:
            for _ in range(n if o in "M=X" else 0):
                b = ref[r] if r < len(ref) else "N"
                if q[i].upper() == b and b in "ACGTU":
                    same += 1
                else:
                    nm, md, same = nm + 1, f"{md}{same}{b}", 0
                i, r = i + 1, r + 1
            if o == "I":
                nm, i = nm + n, i + n
            elif o == "D":
                nm, md, same, r = nm + n, f"{md}{same}^{ref[r : r + n]}", 0, r + n
            elif o == "N":
                r += n
            elif o == "S":
                i += n
        assert nm_md("".join(f"{n}{o}" for n, o in ops), q, ref) == (nm, md + str(same))


def test_aggregates_apart(spark, tmp_path):
    """No key of the distinct count carries the buffers of a percentile; nulls and an empty table as before."""
    from helixframe.catalog import QUERIES

    df = QUERIES["approx_aggregates"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if "keys=[l_orderkey" in x and "percentile" in x]
    assert df.collect() == [(True, True)]
    for k, (rows, want) in enumerate((([(1, 5.0), (None, None), (2, None)], (True, True)), ([(1, None)], (True, None)), ([], (True, None)))):
        d = str(tmp_path / str(k))
        spark.createDataFrame(rows, "l_orderkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
        assert QUERIES["approx_aggregates"](spark, d).collect() == [want]


def test_cigar_is_parsed_once(spark):
    """However many operations a CIGAR has, its text is parsed once on the way there and back; odd ones are still errors."""
    from helixframe.functions.alignment import binary_to_cigar, cigar_to_binary

    assert str(binary_to_cigar(cigar_to_binary("c"))).count("regexp_") == 1
    texts = ["1M", "3M4I5D6N7S8H9P1=2X", "99999999M", "007M", "", "*", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(texts)], "i int, c string")
    got = df.select("i", cigar_to_binary("c").alias("b")).select("i", "b", binary_to_cigar("b").alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == ["1M", "3M4I5D6N7S8H9P1=2X", "99999999M", "7M", "*", "*", None]
    assert [None if r["b"] is None else len(r["b"]) for r in got] == [4, 36, 4, 4, 0, 0, None]
    for c in ("0M", "3", "M", "3M 4I", "3M4", "-3M"):
        with pytest.raises(Exception, match="CIGAR"):
            spark.createDataFrame([(c,)], "c string").select(cigar_to_binary("c")).collect()


def test_bai_by_ranges(spark, tmp_path):
    """An index whose ranges are read by tasks is the index of one pass, record by record."""
    from helixframe.sources import alignments, bgzf
    from helixframe.sources.indexes import build_bai, load

    rows = [(f"r{k}", f"c{k % 3}" if k % 50 else None, k * 7 if k % 50 else None, 0, f"{1 + k % 90}M" if k % 7 else "400000M", 9, None, None, "A" * (k % 90), "", 0) for k in range(60_000)]
    schema = "name string, chrom string, start long, flags long, cigar string, mapping_quality long, mate_chrom string, mate_start long, sequence string, quality_scores string, template_length int"
    path = str(tmp_path / "t.bam")
    alignments.write_bam(spark.createDataFrame(rows, schema).repartition(5), path, {f"c{k}": 1 << 28 for k in range(3)}, sort=True)
    with open(build_bai(path), "rb") as f:
        serial = f.read()
    with open(build_bai(path, spark), "rb") as f:
        assert f.read() == serial
    assert bgzf.size_of(path) > 1 << 18  # more than one range
    index = load(f"{path}.bai", ["c0", "c1", "c2"])
    for c in range(3):
        mine = sorted((r[2], int(r[4][:-1])) for r in rows if r[1] == f"c{c}")
        reach = max(s + n - 1 >> 14 for s, n in mine)
        assert len(index.linear[c]) == reach + 1 and index.linear[c] == sorted(index.linear[c]) and index.bins[c]


def test_bam_order_across_tasks(spark, tmp_path, monkeypatch):
    """Disorder within a task's part of the file and at the edges of parts is counted, as one pass over the file counts it."""
    from helixframe import binary_queries
    from helixframe.sources.alignments import write_bam

    rng = random.Random(2)
    rows = [(f"r{k}", f"c{k % 2}", k * 3 if rng.random() > 0.2 else rng.randrange(90_000), 0, "9M", 9, None, None, "ACGTACGTA", "", 0) for k in range(30_000)]
    schema = "name string, chrom string, start long, flags long, cigar string, mapping_quality long, mate_chrom string, mate_start long, sequence string, quality_scores string, template_length int"
    path = str(tmp_path / "t.bam")
    write_bam(spark.createDataFrame(rows, schema).coalesce(1), path, {"c0": 1 << 28, "c1": 1 << 28})
    monkeypatch.setattr(binary_queries, "_sorted_bam", lambda *a: path)
    reader = spark.read
    for step in (1 << 20, 30_000):
        monkeypatch.setattr(type(reader), "option", lambda self, k, v, f=type(reader).option, step=step: f(self, k, step if k == "splitBytes" else v))
        df = binary_queries.bam_sorted(spark, None)
        monkeypatch.undo()
        monkeypatch.setattr(binary_queries, "_sorted_bam", lambda *a: path)
        want = []
        for c in ("c0", "c1"):
            starts = [r[2] for r in rows if r[1] == c]
            want.append((c, len(starts), sum(a > b for a, b in zip(starts, starts[1:]))))
        assert sorted(map(tuple, df.collect())) == want
        assert "Window" not in "".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "monotonically" in x)


def test_bam_encoded_in_batches(spark):
    """Odd values record by record: absent, beyond ASCII, of different lengths; what does not fit is an error."""
    import struct

    import pyarrow as pa

    from helixframe.sources.alignments import bam_records, encode

    def batch(**x):
        base = {"name": "r", "chrom": "c", "start": 5, "flags": 1, "cigar": "2M1I", "mapping_quality": 7, "mate_chrom": "=", "mate_start": 9, "sequence": "ACg", "quality_scores": "!+5", "template_length": -1, "NM": 3, "RG": "z"} | x
        kinds = {"start": pa.int64(), "flags": pa.int64(), "mapping_quality": pa.int64(), "mate_start": pa.int64(), "template_length": pa.int32(), "NM": pa.int64()}
        return {k: pa.array([v], kinds.get(k, pa.string())) for k, v in base.items()}

    def record(**x):
        return encode(batch(**x), ["c"], {"NM": "i", "RG": "Z"}, True)

    head = struct.pack("<iiBBHHHiiii", 0, 5, 2, 7, 4681, 2, 1, 3, 0, 9, -1)
    body = head + b"r\0" + struct.pack("<II", 2 << 4, 1 << 4 | 1) + bytes((0x12, 0x40, 0, 10, 20)) + b"NMi" + struct.pack("<i", 3) + b"RGZz\0"
    assert record() == struct.pack("<i", len(body)) + body
    assert record(sequence="éC", quality_scores="!", cigar=None, NM=None, RG=None, name=None)[36:] == b"*\0\xf2\xff\xff"
    assert record(start=None, chrom="?", mate_start=None, mate_chrom=None)[4:12] == b"\xff" * 8
    for bad in ({"flags": 65536}, {"flags": None}, {"start": 1 << 31}, {"mapping_quality": 256}, {"name": "x" * 255}, {"cigar": "268435456M"}, {"NM": 1 << 31}):
        with pytest.raises(ValueError):
            record(**bad)
    schema = "name string, chrom string, start long, flags long, cigar string, mapping_quality long, mate_chrom string, mate_start long, sequence string, quality_scores string, template_length int"
    df = spark.createDataFrame([("r", "c", k, 0, "1M", 1, None, None, "A", "I", 0) for k in range(3000)], schema).coalesce(1)
    assert bam_records(df, {"c": 1 << 20}).count() < 10  # not one Python row a record


def test_vcf_lines_are_split_once(spark, tmp_path):
    """A line's fields are split once for all columns, in a plan that reads samples, INFO and FORMAT; odd lines as before."""
    from helixframe.sources.text import read_vcf

    head = '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">\n##INFO=<ID=AF,Number=A,Type=Float,Description="d">\n##INFO=<ID=DB,Number=0,Type=Flag,Description="d">\n##FORMAT=<ID=GT,Number=1,Type=String,Description="d">\n##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n'
    (tmp_path / "a.vcf").write_text(head + "c\t5\t.\tA\tC\t.\tPASS\tAF=0.5,.;DB\tDP:GT\t3:0/1\t.\nc\t6\tx\tA\tC\t1\t.\tDP=4;AF=.\tGT\t0/0\t1/1\n")
    v = read_vcf(spark, str(tmp_path / "a.vcf"))
    assert v._jdf.queryExecution().optimizedPlan().toString().count("split(value") == 1
    got = [(r["DP"], r["AF"], r["DB"], r["genotypes"]["GT"], r["genotypes"]["DP"]) for r in v.orderBy("start").collect()]
    assert got == [(None, [0.5, None], True, ["0/1", None], [3, None]), (4, None, False, ["0/0", "1/1"], [None, None])]
    (tmp_path / "b.vcf").write_text("".join(x.rpartition("\t")[0] + "\n" if x[:2] != "##" else x + "\n" for x in (tmp_path / "a.vcf").read_text().splitlines()))
    one = read_vcf(spark, str(tmp_path / "b.vcf")).orderBy("start").collect()
    assert [(r["GT"], r["fmt_DP"]) for r in one] == [("0/1", 3), ("0/0", None)]


def test_small_ranges_share_tasks():
    """However large a file is, small ranges make a bounded number of tasks until these hold 64 MB; all ranges are there, in order."""
    from helixframe.sources.binary import dealt

    for size, step, most in ((0, 1 << 18, 1), (1 << 20, 1 << 18, 4), (10 << 30, 1 << 18, 260), (60 << 30, 1 << 18, 960), (10 << 30, 64 << 20, 160)):
        tasks = dealt(size, step)
        ranges = [(r.start, r.end) for t in tasks for r in t.ranges]
        assert len(tasks) <= most and len(ranges) == max(-(-size // step), 1)
        assert ranges[0][0] == 0 and ranges[-1][1] == size and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_sink_joins_lines(spark, tmp_path):
    """Lines go to the file as batches; a line that is null is an error, not an empty line."""
    from helixframe.sinks.lines import joined, write_parts

    import pyarrow as pa

    assert joined(pa.array(["a", "", "é"]), b"\n") == "a\n\né\n".encode() and joined(pa.array([b"x", b"y"]), b"") == b"xy"
    df = spark.range(3000, numPartitions=2).selectExpr("concat('l', id) AS value")
    write_parts(df, str(tmp_path / "t.txt"), "#h\n")
    assert (tmp_path / "t.txt").read_text() == "#h\n" + "".join(f"l{k}\n" for k in range(3000))
    with pytest.raises(Exception, match="null"):
        write_parts(spark.sql("SELECT cast(null AS string) AS value"), str(tmp_path / "n.txt"))
