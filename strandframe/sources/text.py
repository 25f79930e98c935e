"""Readers of sequence files and tables; every one has a fixed schema."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FASTX_SCHEMA = "path string, ord long, name string, seq string, qual string"


def parse_fastx(data: bytes) -> Iterator[tuple[str, str, str | None]]:
    """Records of a FASTA or FASTQ file, CRLF or not, FASTA over several lines; a broken record is an error."""
    lines = data.decode().replace("\r\n", "\n").split("\n")
    while lines and not lines[-1]:
        lines.pop()
    at = 0
    while at < len(lines):
        head = lines[at]
        if not head:
            at += 1
        elif head[0] == ">":
            end = at + 1
            while end < len(lines) and not lines[end].startswith(">"):
                end += 1
            yield head[1:], "".join(x.strip() for x in lines[at + 1 : end]), None
            at = end
        elif head[0] == "@":
            if at + 3 >= len(lines) or not lines[at + 2].startswith("+"):
                raise ValueError(f"line {at + 1}: a FASTQ record is cut off or has no + line")
            if len(lines[at + 1]) != len(lines[at + 3]):
                raise ValueError(f"line {at + 1}: sequence and quality differ in length")
            yield head[1:], lines[at + 1], lines[at + 3]
            at += 4
        else:
            raise ValueError(f"line {at + 1}: neither > nor @")


#: Extensions that say how a file is stored; of other files the first two bytes are looked at.
KNOWN = (".gz", ".fa", ".fas", ".fasta", ".fq", ".fastq", ".fna", ".ffn")


def _hidden_gzip(spark: SparkSession, files: list[str]) -> list[str]:
    """The files that are gzip by their magic, though their names don't say so."""
    found = []
    for f in files:
        if not f.lower().endswith(KNOWN):
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
            if stream.read() == 0x1F and stream.read() == 0x8B:
                found.append(f)
            stream.close()
    return found


def _whole_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Records of gzip files whose names hide it: each is one task's, which Spark's text reader cannot open."""
    import gzip

    def kernel(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(p, i, *r) for i, r in enumerate(parse_fastx(gzip.decompress(data)))], columns=["path", "ord", "name", "seq", "qual"], dtype=object)

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(kernel, FASTX_SCHEMA)


def numbered_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """Rows (path, line, value): the lines of text files with their numbers from 0, read by splits.

    A split's lines follow one another in its task, so a line's number is the lines of the splits before, and its distance
    from the first of its own; only one row for each split is looked at to know these.
    """
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("r"), "value")
    blocks = lines.groupBy("path", "block").agg(F.min("r").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.withColumn("before", before).drop("n"), ["path", "block"]).select("path", (F.col("before") + F.col("r") - F.col("first")).alias("line"), "value")


def read_fastx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each record of FASTA or FASTQ files; ord counts from 0 in each file.

    Plain files are read by splits, gzip as a stream; no task holds a whole file. A broken record is an error when it is
    read. Blank lines after the last record are left out.
    """
    files = list(spark.read.text(path).inputFiles())
    hidden = _hidden_gzip(spark, files)
    open_files = [f for f in files if f not in hidden]
    out = _whole_files(spark, hidden) if hidden else None
    if not open_files:
        return out if out is not None else spark.createDataFrame([], FASTX_SCHEMA)
    lines = numbered_lines(spark, open_files)
    kinds = lines.where("value <> ''").groupBy("path").agg(F.min_by(F.substring("value", 1, 1), "line").alias("mark"))
    marked = lines.join(kinds, "path")
    four = marked.where("mark <> '>'").groupBy("path", F.expr("line div 4").alias("ord")).agg(*[F.max(F.when(F.expr(f"line % 4 = {i}"), F.col("value"))).alias(c) for i, c in enumerate(("head", "seq", "plus", "qual"))])
    wrong = "NOT startswith(head, '@') OR plus IS NULL OR NOT startswith(plus, '+') OR qual IS NULL OR length(seq) <> length(qual)"
    fastq = four.where("concat_ws('', head, seq, plus, qual) <> ''").selectExpr("path", "ord", f"CASE WHEN {wrong} THEN raise_error(concat('record ', ord, ' of ', path, ' is broken')) ELSE substring(head, 2) END AS name", "seq", "qual")
    # a record's number is the heads up to its line: those of the parts of lines before, and those before it in its own part
    body = marked.where("mark = '>'").withColumn("head", F.startswith("value", F.lit(">"))).withColumn("part", F.expr("line div 65536"))
    heads = body.groupBy("path", "part").agg(F.count_if("head").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = body.join(heads.withColumn("before", before).drop("n"), ["path", "part"])
    numbered = placed.withColumn("ord", F.col("before") + F.sum(F.col("head").cast("long")).over(Window.partitionBy("path", "part").orderBy("line")) - 1)
    records = numbered.groupBy("path", "ord").agg(F.max(F.when(F.col("head"), F.substring("value", 2, 1 << 30))).alias("name"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line", F.trim("value").alias("t"))))).alias("p"))
    fasta = records.where("name IS NOT NULL").select("path", "ord", "name", F.array_join("p.t", "").alias("seq"), F.lit(None).cast("string").alias("qual"))
    found = fastq.unionByName(fasta)
    return found if out is None else found.unionByName(out)


def fastq_records(spark: SparkSession, path: str) -> int:
    """The records of FASTQ files, by their lines."""
    return spark.read.text(path).count() // 4


def locus_name(path: str) -> str:
    """The file's stem, as an expression."""
    return f"regexp_extract({path}, '([^/]+?)([.](gz|fa|fas|fasta|fq|fastq))*$', 1)"


def read_id(header: str) -> str:
    """A read's name without mate and comment, as an expression."""
    return f"regexp_replace({header}, '(/[12])?([ \\t].*)?$', '')"


def read_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Two files in lock-step, or two folders whose files are mates in the order of their names; a missing mate or another name is an error when it is read."""

    def side(path: str, n: int) -> DataFrame:
        reads = read_fastx(spark, path)
        files = reads.select("path").distinct().withColumn("file", F.row_number().over(Window.orderBy("path")))
        return reads.join(files, "path").select("file", "ord", *[F.col(c).alias(f"{c}{n}") for c in ("name", "seq", "qual")])

    wrong = f"name1 IS NULL OR name2 IS NULL OR {read_id('name1')} <> {read_id('name2')}"
    return side(first, 1).join(side(second, 2), ["file", "ord"], "full").withColumn("name1", F.expr(f"CASE WHEN {wrong} THEN raise_error(concat('mates differ at record ', ord)) ELSE name1 END")).withColumnRenamed("ord", "fragment")


def interleaved_pairs(reads: DataFrame) -> DataFrame:
    """Records two by two as mates."""
    return reads.groupBy("path", F.expr("ord div 2").alias("fragment")).agg(F.min_by("seq", "ord").alias("seq1"), F.max_by("seq", "ord").alias("seq2"), F.min_by("name", "ord").alias("name1"), F.max_by("name", "ord").alias("name2"), F.count("*").alias("mates"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The alignment lines, headers left out; gzip by its extension."""
    f = F.split("value", "\t")
    names = ("qname", "flag", "ref", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    kinds = {"flag": "int", "pos": "int", "mapq": "int", "pnext": "int", "tlen": "int"}
    return spark.read.text(path).where("NOT startswith(value, '@')").select(*[F.get(f, F.lit(i)).cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(names)])


def read_sam_references(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("startswith(value, '@SQ')").selectExpr("regexp_extract(value, '\\tSN:([^\\t]+)', 1) AS ref", "cast(regexp_extract(value, '\\tLN:([0-9]+)', 1) AS int) AS length")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Genotypes in long form; samples are numbered in the order of the header line."""
    body = spark.read.text(path).where("NOT startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    rows = body.selectExpr("f[0] AS chrom", "cast(f[1] AS int) AS site", "f[3] AS ref", "f[4] AS alt", "try_cast(f[5] AS double) AS qual", "split(f[8], ':') AS fmt", "posexplode(slice(f, 10, size(f))) AS (sample, call)")
    part = lambda name: f"get(split(call, ':'), cast(array_position(fmt, '{name}') AS int) - 1)"
    return rows.selectExpr("chrom", "site", "ref", "alt", "qual", "sample", f"{part('GT')} AS gt", f"try_cast({part('DP')} AS int) AS dp", f"try_cast({part('GQ')} AS int) AS gq")


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments and links; only overlaps of plain matches are taken."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    links = f.where("f[0] = 'L' AND f[5] RLIKE '^[0-9]+M$'").selectExpr("f[1] AS a", "f[2] AS a_strand", "f[3] AS b", "f[4] AS b_strand", "cast(regexp_extract(f[5], '[0-9]+', 0) AS int) AS overlap")
    return f.where("f[0] = 'S'").selectExpr("f[1] AS id", "f[2] AS seq"), links


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a .loci file, each closed by a line of //; the block is the number of separators before."""

    def kernel(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                rows, block = [], 0
                for line in data.decode().splitlines():
                    if line.startswith("//"):
                        block += 1
                    elif line.strip():
                        name, seq = line.split(None, 1)
                        rows.append((p, block, name, seq.strip()))
                yield pd.DataFrame(rows, columns=["path", "block", "sample", "seq"], dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(kernel, "path string, block int, sample string, seq string")


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float | None]]:
    """Nodes (id, parent, label, length) in the order they are opened."""
    nodes: list[list] = [[0, None, None, None]]
    here, at = 0, 0
    text = text.strip().rstrip(";")
    while at < len(text):
        c = text[at]
        if c == "(" or c == ",":
            parent = here if c == "(" else nodes[here][1]
            if parent is None:
                raise ValueError("a comma outside brackets")
            nodes.append([len(nodes), parent, None, None])
            here, at = len(nodes) - 1, at + 1
        elif c == ")":
            here, at = nodes[here][1], at + 1
            if here is None:
                raise ValueError("a bracket is closed that was not opened")
        else:
            end = at
            while end < len(text) and text[end] not in "(),":
                end += 1
            label, _, length = text[at:end].partition(":")
            nodes[here][2], nodes[here][3] = label.strip() or None, float(length) if length else None
            at = end
    if here != 0:
        raise ValueError("a bracket is not closed")
    return [tuple(n) for n in nodes]


def clades(text: str) -> list[tuple[str, ...]]:
    """The leaves below each inner node, sorted."""
    nodes = parse_newick(text)
    below: dict[int, list[str]] = {n[0]: [] for n in nodes}
    parents = {n[1] for n in nodes}
    for i, _, label, _ in nodes:
        if i not in parents and label:
            up = nodes[i][1]
            while up is not None:
                below[up].append(label)
                up = nodes[up][1]
    return sorted(tuple(sorted(x)) for x in below.values() if x)


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Features as (path, kind, start, end, strand, gene) with half-open spans, one row for each part of a join."""
    import re

    def features(text: str) -> Iterator[tuple]:
        for m in re.finditer(r"^ {5}(\S+) +(\S+(?:\n {21}[^/\s]\S*)*)((?:\n {21}.*)*)", text.split("ORIGIN")[0], re.M):
            strand = -1 if "complement" in m[2] else 1
            gene = re.search(r'/gene="([^"]*)"', m[3])
            for a, b in re.findall(r"<?(\d+)(?:\.\.>?(\d+))?", m[2]):
                yield m[1], int(a) - 1, int(b or a), strand, gene[1] if gene else None

    def kernel(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(p, *f) for f in features(data.decode())], columns=["path", "kind", "start", "end", "strand", "gene"], dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(kernel, "path string, kind string, start int, end int, strand int, gene string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sample manifests: two or three columns, # and blank lines skipped; one file of reads stands for both mates; a name twice is an error."""
    f = spark.read.text(path).where("NOT startswith(value, '#') AND trim(value) <> ''").select(F.split("value", "\t").alias("f"))
    rows = f.selectExpr("regexp_replace(trim(f[0]), '[^A-Za-z0-9._-]+', '_') AS sample", "trim(f[1]) AS r1", "coalesce(nullif(trim(get(f, 2)), ''), trim(f[1])) AS r2", "size(f) AS n")
    twice = rows.groupBy("sample").agg(F.count("*").alias("c"))
    return rows.join(twice, "sample").selectExpr("CASE WHEN c > 1 OR n NOT IN (2, 3) THEN raise_error(concat('manifest: ', sample)) ELSE sample END AS sample", "r1", "r2")


def parse_flagstat(lines: DataFrame) -> DataFrame:
    """Total and mapped reads of flagstat lines."""
    n = "cast(regexp_extract(value, '^([0-9]+)', 1) AS long)"
    return lines.agg(F.max(F.expr(f"CASE WHEN value LIKE '%in total%' THEN {n} END")).alias("total"), F.max(F.expr(f"CASE WHEN value RLIKE '^[0-9]+ [+] [0-9]+ mapped ' THEN {n} END")).alias("mapped"))


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Columns by header."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, enforceSchema=False)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Features with half-open spans."""
    f = spark.read.text(path).where("NOT startswith(value, '#')").select(F.split("value", "\t").alias("f")).where("size(f) >= 9")
    return f.selectExpr("f[0] AS seqid", "f[2] AS kind", "cast(f[3] AS int) - 1 AS start", "cast(f[4] AS int) AS end", "f[6] AS strand", "regexp_extract(f[8], 'ID=([^;]+)', 1) AS id", "regexp_extract(f[8], 'Parent=([^;]+)', 1) AS parent")
