import gzip

import pytest

from strandframe.functions import sequence as S
from strandframe.sources import sinks, text


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_fastx_records_and_broken_files(spark, tmp_path):
    fasta = put(tmp_path, "a.fasta", ">x one\r\nACGT\r\nAC\r\n>y\r\n\r\n")
    fastq = put(tmp_path, "b.fastq.gz", gzip.compress(b"@r1/1 c\nACGT\n+\nIIII\n@r2/1\nAC\n+r2\nII\n"))
    assert [(r["name"], r["seq"], r["qual"]) for r in text.read_fastx(spark, fasta).orderBy("ord").collect()] == [("x one", "ACGTAC", None), ("y", "", None)]
    rows = text.read_fastx(spark, fastq).selectExpr("ord", f"{text.read_id('name')} AS id", f"{text.locus_name('path')} AS locus").orderBy("ord").collect()
    assert [(r["id"], r["locus"]) for r in rows] == [("r1", "b"), ("r2", "b")]
    for bad in (b"@r\nACGT\n+\n", b"@r\nACGT\n+\nII\n", b"ACGT\n", b"@r\nACGT\nIIII\n+\n"):
        with pytest.raises(ValueError):
            list(text.parse_fastx(bad))


def test_files_are_read_by_splits(spark, tmp_path):
    reads = [(f"r{i} x", "ACGT" * (i % 7), "I" * (4 * (i % 7))) for i in range(700)]
    seqs = [(f"s{i}", "ACGTN" * (i % 50)) for i in range(300)]
    folder = tmp_path / "many"
    folder.mkdir()
    put(folder, "a.fastq", "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in reads) + "\n\n")
    put(folder, "b.fasta", "".join(f">{n}\n" + "".join(f"{s[i : i + 60]}\n" for i in range(0, len(s), 60)) for n, s in seqs))
    put(folder, "c.fq.gz", gzip.compress(b"@z\nAC\n+\nII\n"))
    put(folder, "hidden", gzip.compress(b"@h\nGT\n+\nII\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = text.read_fastx(spark, str(folder)).selectExpr(f"{text.locus_name('path')} AS f", "ord", "name", "seq", "qual").orderBy("f", "ord").collect()
        assert spark.read.text(str(folder / "a.fastq")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r)[1:] for r in got if r["f"] == "a"] == [(i, *r) for i, r in enumerate(reads)]
    assert [tuple(r)[1:] for r in got if r["f"] == "b"] == [(i, *r, None) for i, r in enumerate(seqs)]
    assert [r["name"] for r in got if r["f"] in ("c", "hidden")] == ["z", "h"]
    assert text.fastq_records(spark, str(folder / "c.fq.gz")) == 1
    for bad in ("@r\nACGT\n+\n", "@r\nACGT\n+\nII\n", "ACGT\n", "@r\nACGT\nIIII\n+\n"):
        with pytest.raises(Exception, match="broken"):
            text.read_fastx(spark, put(tmp_path, "bad.fq", bad)).collect()


def test_folders_of_mates_pair_by_file(spark, tmp_path):
    for side in (1, 2):
        folder = tmp_path / str(side)
        folder.mkdir()
        for f in "ab":
            put(folder, f"{f}.fq", "".join(f"@{f}{i}/{side}\nA{'CG'[side - 1]}\n+\nII\n" for i in range(3)))
    got = text.read_pairs(spark, str(tmp_path / "1"), str(tmp_path / "2")).collect()
    assert sorted((r["name1"], r["name2"]) for r in got) == [(f"{f}{i}/1", f"{f}{i}/2") for f in "ab" for i in range(3)]


def test_pairs_must_agree(spark, tmp_path):
    one = put(tmp_path, "1.fq", "@a/1\nAC\n+\nII\n@b/1\nGT\n+\nII\n")
    two = put(tmp_path, "2.fq", "@a/2\nCC\n+\nII\n@b/2\nTT\n+\nII\n")
    other = put(tmp_path, "3.fq", "@a/2\nCC\n+\nII\n")
    assert [(r["fragment"], r["seq1"], r["seq2"]) for r in text.read_pairs(spark, one, two).orderBy("fragment").collect()] == [(0, "AC", "CC"), (1, "GT", "TT")]
    with pytest.raises(Exception, match="mates differ"):
        text.read_pairs(spark, one, other).collect()
    mixed = text.interleaved_pairs(text.read_fastx(spark, one)).first()
    assert (mixed["seq1"], mixed["seq2"], mixed["mates"]) == ("AC", "GT", 2)


def test_alignment_and_variant_files(spark, tmp_path):
    sam = put(tmp_path, "a.sam", "@HD\tVN:1\n@SQ\tSN:ref1\tLN:99\nr1\t0\tref1\t5\t60\t3M1D2M\t*\t0\t0\tACGTA\tIIIII\n")
    row = text.read_sam(spark, sam).first()
    assert (row["qname"], row["pos"], row["cigar"], row["seq"]) == ("r1", 5, "3M1D2M", "ACGTA")
    assert text.read_sam_references(spark, sam).first()["length"] == 99
    vcf = put(tmp_path, "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nc\t7\t.\tA\tG\t50\t.\t.\tGT:DP:GQ\t0/1:9:40\t./.:.:.\n")
    got = [(r["sample"], r["gt"], r["dp"], r["gq"]) for r in text.read_vcf(spark, vcf).orderBy("sample").collect()]
    assert got == [(0, "0/1", 9, 40), (1, "./.", None, None)]


def test_graph_files_round_trip(spark, tmp_path):
    gfa = put(tmp_path, "a.gfa", "S\t1\tACGT\nS\t2\tGTAA\nL\t1\t+\t2\t+\t2M\nL\t2\t+\t1\t-\t1M1I\n")
    segments, links = text.read_gfa(spark, gfa)
    assert segments.count() == 2 and links.count() == 1
    assert [r["value"] for r in sinks.gfa_lines(segments, links).collect()] == ["S\t1\tACGT", "S\t2\tGTAA", "L\t1\t+\t2\t+\t2M"]


def test_small_formats(spark, tmp_path):
    loci = put(tmp_path, "a.loci", "s1  ACNNNGT\ns2  ACNNNGA\n//  |0|\ns1  TT\n// |1|\n")
    assert sorted((r["block"], r["sample"]) for r in text.read_loci(spark, loci).collect()) == [(0, "s1"), (0, "s2"), (1, "s1")]
    assert text.clades("((a:1,b:2)x:1,(c,d));") == [("a", "b"), ("a", "b", "c", "d"), ("c", "d")]
    with pytest.raises(ValueError):
        text.parse_newick("((a,b)")
    gb = put(tmp_path, "a.gb", 'LOCUS x\nFEATURES             Location/Qualifiers\n     gene            complement(5..20)\n                     /gene="cox1"\n     CDS             join(1..3,7..9)\n                     /gene="nad"\nORIGIN\n        1 acgt\n//\n')
    rows = [(r["kind"], r["start"], r["end"], r["strand"], r["gene"]) for r in text.read_genbank(spark, gb).collect()]
    assert rows == [("gene", 4, 20, -1, "cox1"), ("CDS", 0, 3, 1, "nad"), ("CDS", 6, 9, 1, "nad")]
    good = put(tmp_path, "m.tsv", "# c\nA b\tx.fq\nB\ty1.fq\ty2.fq\n")
    assert sorted(tuple(r) for r in text.read_manifest(spark, good).collect()) == [("A_b", "x.fq", "x.fq"), ("B", "y1.fq", "y2.fq")]
    with pytest.raises(Exception, match="manifest"):
        text.read_manifest(spark, put(tmp_path, "n.tsv", "A\tx\nA\ty\n")).collect()
    flag = spark.createDataFrame([("10 + 0 in total (QC)",), ("7 + 0 mapped (70%)",), ("1 + 0 mapped to x",)], "value string")
    assert tuple(text.parse_flagstat(flag).first()) == (10, 7)
    gff = put(tmp_path, "a.gff", "##gff\nc\t.\tCDS\t2\t5\t.\t+\t0\tID=x;Parent=y\n")
    assert tuple(text.read_gff(spark, gff).first()) == ("c", "CDS", 1, 5, "+", "x", "y")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 2, "ACGT" * 30), ("s", 1, 1, "")], "sample string, locus int, fragment int, seq string")
    sinks.write_by_locus(df, str(tmp_path / "out"))
    assert [r["fragment"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1, 2]
    line = sinks.fasta_lines(df, "fragment").where("value LIKE '>2%'").first()["value"]
    assert line == ">2\n" + "ACGT" * 20 + "\n" + "ACGT" * 10
    same = sinks.manifest({"a": df, "b": df.repartition(3)}).collect()
    assert same[0]["checksum"] == same[1]["checksum"] and same[0]["rows"] == 2


def test_scalar_expressions(spark):
    one = lambda e: spark.sql(f"SELECT {e} AS x").first()["x"]
    assert one(S.iupac_reverse_complement("'ACRYn'")) == "nRYGT"
    assert one(S.halves_quartile("array(1, 2, 3, 4)", 1)) == 1.5 and one(S.halves_quartile("array(1, 2, 3, 4)", 3)) == 3.5
    assert one(S.back_translated("'M-K'", "'ATGAAA'")) == "ATG---AAA"
    assert one(S.period("'ACACACAC'")) == 2 and one(S.canonical_motif("'GT'")) == "AC"
    assert one(S.diagonal("'ACGT'", "'GTAC'", "2")) == 1.0
    assert one(S.two_bit("'ACGT'")) == 27 and one(S.from_two_bit("27L", 4)) == "ACGT"
    assert one(S.called("'0/.'")) is False and one(S.called("'0|1'")) is True
    assert one(S.minimizers("'ACG'", 5, 3)) is not None
