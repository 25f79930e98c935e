"""Sequence functions as SQL expressions; each takes and gives the text of an expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The IUPAC codes and their complements, the sets of bases that the codes stand for, and the standard genetic code by base order TCAG.
IUPAC = "ACGTUNRYSWKMBVDHacgtunryswkmbvdh"
IUPAC_COMPLEMENT = "TGCAANYRSWMKVBHDtgcaanyrswmkvbhd"
IUPAC_SETS = {"A": "A", "C": "C", "G": "G", "T": "T", "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M", "CGT": "B", "AGT": "D", "ACT": "H", "ACG": "V", "ACGT": "N"}
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codons() -> dict[str, str]:
    return {a + b + c: GENETIC_CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def reverse_complement(s: str) -> str:
    """other characters stay as they are."""
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def iupac_reverse_complement(s: str) -> str:
    return f"reverse(translate({s}, '{IUPAC}', '{IUPAC_COMPLEMENT}'))"


def canonical(s: str) -> str:
    """F3."""
    return f"least({s}, {reverse_complement(s)})"


def windows(s: str, k: int) -> str:
    """Every window of k characters; none for shorter text. For short text: long text goes through kmers()."""
    return f"CASE WHEN length({s}) >= {k} THEN transform(sequence(1, length({s}) - {k - 1}), i -> substring({s}, i, {k})) ELSE cast(array() AS array<string>) END"


def valid_runs(s: str) -> str:
    """the stretches without ambiguous bases."""
    return f"filter(split({s}, '[^ACGT]+'), x -> x <> '')"


def central_slice(s: str, n: str) -> str:
    """F7."""
    return f"substring({s}, (length({s}) - ({n})) div 2 + 1, {n})"


def two_bit(s: str) -> str:
    """up to 31 bases as a number, A=0, C=1, G=2, T=3."""
    return f"aggregate(split({s}, ''), 0L, (n, b) -> n * 4 + CASE b WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END)"


def from_two_bit(n: str, k: int | str) -> str:
    return f"array_join(transform(sequence(({k}) - 1, 0, -1), i -> substring('ACGT', cast(shiftright({n}, 2 * i) & 3 AS int) + 1, 1)), '')"


def let(value: str, name: str, body: str) -> str:
    """body with value under a name, so that it is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def minimizers(s: str, k: int, w: int) -> str:
    """The distinct least canonical k-mers of every w windows in a row, sorted."""
    code = f"transform({windows(s, k)}, x -> {canonical('x')})"
    return let(code, "c", f"array_sort(array_distinct(transform(sequence(1, greatest(1, size(c) - {w - 1})), j -> array_min(slice(c, j, {w})))))")


def bottom_sketch(s: str, k: int, n: int) -> str:
    """the n least canonical k-mers."""
    return f"slice(array_sort(array_distinct(transform({windows(s, k)}, x -> {canonical('x')}))), 1, {n})"


def jaccard(a: str, b: str) -> str:
    """0 for two empty sets."""
    return f"CASE WHEN size(array_union({a}, {b})) = 0 THEN 0D ELSE size(array_intersect({a}, {b})) / size(array_union({a}, {b})) END"


def period(s: str, share: float = 0.85) -> str:
    """the least p up to half the length with the share of characters equal to those p after the begin, cyclically; else null."""
    same = f"size(filter(sequence(1, length({s})), i -> substring({s}, i, 1) = substring({s}, (i - 1) % p + 1, 1)))"
    return f"CASE WHEN length({s}) >= 2 THEN get(filter(sequence(1, length({s}) div 2), p -> {same} >= {share} * length({s})), 0) END"


def rotations(s: str) -> str:
    return f"transform(sequence(0, length({s}) - 1), i -> concat(substring({s}, i + 1), substring({s}, 1, i)))"


def canonical_motif(s: str) -> str:
    """the least rotation of either strand."""
    return f"CASE WHEN {s} = '' THEN '' ELSE least(array_min({rotations(s)}), array_min({rotations(reverse_complement(s))})) END"


def pair_entropy(s: str) -> str:
    """F16: the entropy, in bits, of the pairs of neighbouring bases; 0 for fewer than two."""
    shares = "transform(array_distinct(c), d -> size(filter(c, x -> x = d)) / size(c))"
    return f"CASE WHEN length({s}) < 2 THEN 0D ELSE {let(windows(s, 2), 'c', f'-aggregate({shares}, 0D, (h, p) -> h + p * log2(p))')} END"


def identity(a: str, b: str) -> str:
    """The share of equal places of two texts over the length of the shorter; 0 where one is empty."""
    n = f"least(length({a}), length({b}))"
    return f"CASE WHEN {n} = 0 THEN 0D ELSE size(filter(sequence(1, {n}), i -> substring({a}, i, 1) = substring({b}, i, 1))) / {n} END"


def inverted_repeat_identity(s: str) -> str:
    """F17."""
    return identity(s, reverse_complement(s))


def diagonal(a: str, b: str, offset: str) -> str:
    """identity of a and of b moved on by offset."""
    return identity(f"substring({a}, greatest(0, {offset}) + 1)", f"substring({b}, greatest(0, -({offset})) + 1)")


def cigar_operations(c: str) -> str:
    """structs (n, op)."""
    return f"transform(regexp_extract_all({c}, '[0-9]+[MIDNSHPX=]', 0), x -> struct(cast(substring(x, 1, length(x) - 1) AS int) AS n, right(x, 1) AS op))"


def protein(s: str) -> str:
    """codons outside the code give X; one or two bases at the end are left out."""
    table = "map(" + ", ".join(f"'{c}', '{a}'" for c, a in codons().items()) + ")"
    return f"CASE WHEN length({s}) < 3 THEN '' ELSE array_join(transform(sequence(1, length({s}) - 2, 3), i -> coalesce(try_element_at({table}, substring({s}, i, 3)), 'X')), '') END"


def back_translated(aligned: str, dna: str) -> str:
    """the codons of dna under an aligned protein, three gaps for each of its gaps."""
    return f"""aggregate(split({aligned}, ''), named_struct('o', '', 'i', 1), (s, a) -> named_struct('o', concat(s.o, CASE WHEN a = '-' THEN '---' ELSE substring({dna}, s.i, 3) END), 'i', s.i + CASE WHEN a = '-' THEN 0 ELSE 3 END), s -> s.o)"""


def arms(s: str) -> str:
    """the two sides of the first run of NNN and what of N and - follows it; the second is empty without one."""
    return f"struct(regexp_extract({s}, '^(.*?)(?:[Nn]{{3}}[Nn-]*(.*))?$', 1) AS left, regexp_extract({s}, '^(.*?)(?:[Nn]{{3}}[Nn-]*(.*))?$', 2) AS right)"


def overhang_trimmed(s: str, overhang: str, least: int) -> str:
    """s without its overhang, or null unless it begins with it, holds only ACGT and is long enough."""
    n = len(overhang)
    return f"CASE WHEN startswith({s}, '{overhang}') AND substring({s}, {n + 1}) RLIKE '^[ACGT]+$' AND length({s}) - {n} >= {least} THEN substring({s}, {n + 1}) END"


def halves_quartile(sorted_array: str, which: int) -> str:
    """the median of the lower or upper half, the median itself left out of an odd number."""
    n = f"size({sorted_array})"
    half = f"slice({sorted_array}, 1, {n} div 2)" if which == 1 else f"slice({sorted_array}, {n} - {n} div 2 + 1, {n} div 2)"
    return f"CASE WHEN {n} = 1 THEN cast({sorted_array}[0] AS double) ELSE {middle(half)} END"


def middle(sorted_array: str) -> str:
    """of an even number the mean of the middle two."""
    return f"CASE WHEN size({sorted_array}) = 0 THEN NULL ELSE ({sorted_array}[(size({sorted_array}) - 1) div 2] + {sorted_array}[size({sorted_array}) div 2]) / 2D END"


def upper_median(sorted_array: str) -> str:
    """F28."""
    return f"{sorted_array}[size({sorted_array}) div 2]"


def called(gt: str) -> str:
    """F30."""
    return f"forall(split({gt}, '[/|]'), a -> a <> '' AND a <> '.')"


def safe_name(s: str) -> str:
    """letters, digits, dot, dash and underscore; other runs become one underscore."""
    return f"regexp_replace({s}, '[^A-Za-z0-9._-]+', '_')"


def circular_slice(s: str, start: str, n: str) -> str:
    """n characters from a 0-based start that may be negative or beyond the end."""
    return f"substring(concat({s}, {s}, {s}), pmod({start}, length({s})) + 1, {n})"


def effective_length(longest: str, sequences: str) -> str:
    """F34."""
    return f"cast(floor({longest} * (log10({sequences}) + 1)) AS long)"


def short_number(x: str) -> str:
    """three decimals, without zeros at the end."""
    return f"regexp_replace(regexp_replace(format_string('%.3f', cast({x} AS double)), '0+$', ''), '[.]$', '')"


def kmers(df: DataFrame, k: int, seq: str = "seq", piece: int = 192) -> DataFrame:
    """df with (pos, kmer) for every window of k unambiguous bases of its sequences, pos from 0.

    Long sequences are cut into overlapping pieces first: taking a window costs what stands before it. Numbers are
    exploded, not windows, so that each window is cut in generated code and dropped again where no join keeps it.
    """
    piece = max(piece, 2 * k)
    cut = df.where(f"length({seq}) >= {k}").select("*", F.explode(F.expr(f"transform(sequence(1, length({seq}) - {k - 1}, {piece - k + 1}), i -> struct(i AS at, substring({seq}, i, {piece}) AS part))")).alias("_p")).drop(seq)
    cut = cut.select(*[c for c in cut.columns if c != "_p"], F.col("_p.at").alias("_at"), F.col("_p.part").alias("_part"), F.expr("_p.part RLIKE '^[ACGT]*$'").alias("_clean"))
    out = cut.select("*", F.explode(F.expr(f"sequence(1, length(_part) - {k - 1})")).alias("_i")).withColumn("kmer", F.expr(f"substring(_part, _i, {k})"))
    return out.withColumn("pos", F.expr("_at + _i - 2")).where(f"_clean OR kmer RLIKE '^[ACGT]{{{k}}}$'").drop("_at", "_part", "_clean", "_i")
