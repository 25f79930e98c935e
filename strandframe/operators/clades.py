"""Trees of families and the single-copy clades in them, whichever way a tree is rooted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources.text import parse_newick


def shared_windows(sequences: DataFrame, k: int) -> DataFrame:
    """rows (family, a, b, distance): one less the Jaccard share of distinct canonical k-mers, for every two leaves of a family (family, leaf, seq) that share any."""
    own = S.kmers(sequences, k).select("family", "leaf", F.expr(S.canonical("kmer")).alias("kmer")).distinct()
    size = own.groupBy("family", "leaf").agg(F.count("*").alias("n"))
    both = own.select("family", "kmer", F.col("leaf").alias("a")).join(own.select("family", "kmer", F.col("leaf").alias("b")), ["family", "kmer"]).where("a < b").groupBy("family", "a", "b").agg(F.count("*").alias("c"))
    sized = both.join(size.select("family", F.col("leaf").alias("a"), F.col("n").alias("_a")), ["family", "a"]).join(size.select("family", F.col("leaf").alias("b"), F.col("n").alias("_b")), ["family", "b"])
    return sized.select("family", "a", "b", (1 - F.col("c") / (F.col("_a") + F.col("_b") - F.col("c"))).alias("distance"))


def joined_tree(leaves: list[str], distance: dict[tuple[str, str], float]) -> str:
    """A Newick text by average linkage: the two nearest groups join first, ties to the names of their first leaves; leaves without a distance are 1 apart."""
    groups = {x: (1, x) for x in sorted(leaves)}
    far = {(a, b): distance.get((a, b), 1.0) for a in groups for b in groups if a < b}
    while len(groups) > 1:
        a, b = min(far, key=lambda p: (round(far[p], 12), p))
        (m, one), (n, two) = groups.pop(a), groups.pop(b)
        pair = lambda x, y: far.pop((min(x, y), max(x, y)))
        pair(a, b)
        new = {c: (m * pair(a, c) + n * pair(b, c)) / (m + n) for c in groups}
        far |= {(min(a, c), max(a, c)): d for c, d in new.items()}
        groups[a] = (m + n, f"({one},{two})")
    return next((text for _, text in groups.values()), "") + ";"


def family_trees(sequences: DataFrame, k: int = 7) -> DataFrame:
    """Rows (family, newick) of the leaves (family, leaf, seq); a family is one gene's candidates, which one task joins."""
    near = shared_windows(sequences, k).groupBy("family").agg(F.collect_list(F.struct("a", "b", "distance")).alias("near"))
    rows = sequences.groupBy("family").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")).join(near, "family", "left")

    def kernel(batches):
        for pdf in batches:
            trees = [joined_tree(list(own), {(r["a"], r["b"]): r["distance"] for r in (near if near is not None else [])}) for own, near in zip(pdf["leaves"], pdf["near"], strict=True)]
            yield pd.DataFrame({"family": pdf["family"], "newick": trees})

    return rows.mapInPandas(kernel, f"family {sequences.schema['family'].dataType.simpleString()}, newick string")


def directed_edges(nodes: list[tuple[int, int | None, str | None, float | None]]) -> list[tuple[int, int | None, frozenset[str]]]:
    """The leaves beyond every directed edge as (node, from, leaves), and those of the whole tree as (root, null, leaves).

    One pass up joins what is below each node, one pass down what is beyond its parent: the parent's own beyond and the other
    children's below. Leaves without a name are no leaves.
    """
    children: dict[int, list[int]] = {n[0]: [] for n in nodes}
    for i, parent, _, _ in nodes:
        if parent is not None:
            children[parent].append(i)
    below: dict[int, frozenset[str]] = {}
    for i, _, label, _ in reversed(nodes):  # a child is opened after its parent
        below[i] = frozenset().union(*(below[c] for c in children[i])) if children[i] else frozenset([label] if label else [])
    beyond: dict[int, frozenset[str]] = {nodes[0][0]: frozenset()}
    out: list[tuple[int, int | None, frozenset[str]]] = [(nodes[0][0], None, below[nodes[0][0]])]
    for i, _, _, _ in nodes:
        before = [beyond[i]]
        for c in children[i]:  # what stands before each child, and then what stands after it
            before.append(before[-1] | below[c])
        after: frozenset[str] = frozenset()
        for c, left in reversed(list(zip(children[i], before, strict=False))):
            beyond[c] = left | after
            after = after | below[c]
        out += [x for c in children[i] for x in ((c, i, below[c]), (i, c, beyond[c]))]
    return out


def chosen_clades(newick: str, least: int, outgroups: frozenset[str] = frozenset()) -> tuple[str | None, list[tuple[tuple[str, ...], tuple[str, ...]]]]:
    """(error, clades as (leaves, samples)): the largest clades beyond any directed edge in which no sample (the part of a leaf before |) stands twice, disjoint, ties to the leaves that sort first.

    With outgroups one edge alone must part them from the rest, and clades hold none of them.
    """
    edges = directed_edges(parse_newick(newick))
    sample = lambda x: x.split("|")[0]
    sides = [(frozenset(map(sample, own)), own, origin) for _, origin, own in edges]
    if outgroups:
        whole = sides[0][1]
        parted = {min(tuple(sorted(own)), tuple(sorted(whole - own))) for names, own, origin in sides if origin is not None and names == outgroups}
        if len(parted) != 1:
            return "outgroup_missing_or_not_monophyletic", []
    good = {tuple(sorted(own)): names for names, own, origin in sides if len(names) == len(own) >= least and not names & outgroups and (origin is not None or not outgroups)}
    taken: set[str] = set()
    out = []
    for leaves in sorted(good, key=lambda x: (-len(x), x)):
        if taken.isdisjoint(leaves):
            taken.update(leaves)
            out.append((leaves, tuple(sorted(good[leaves]))))
    return None, out


def single_copy(trees: DataFrame, least: int = 4, outgroups: tuple[str, ...] = ()) -> DataFrame:
    """Rows (family, clade, leaves, samples, n, error) of trees (family, newick): the chosen clades of each, from 0; a tree that cannot be read or whose outgroup is torn has one row with the error."""
    apart = frozenset(outgroups)

    def kernel(batches):
        for pdf in batches:
            rows = []
            for family, newick in zip(pdf["family"], pdf["newick"], strict=True):
                try:
                    error, found = chosen_clades(newick or "", least, apart)
                except ValueError as e:
                    error, found = str(e), []
                rows += [(family, None, None, None, None, error)] if error else [(family, i, list(x), list(y), len(x), None) for i, (x, y) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["family", "clade", "leaves", "samples", "n", "error"], dtype=object)

    return trees.select("family", "newick").mapInPandas(kernel, f"family {trees.schema['family'].dataType.simpleString()}, clade int, leaves array<string>, samples array<string>, n int, error string")
