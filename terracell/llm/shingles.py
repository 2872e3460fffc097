"""Near-duplicates by exact word-shingle Jaccard similarity: a prefix-filtered set join.

A text is the set of its word shingles. Put every set in one order, rarest shingle
first: two sets of n and m shingles at similarity t or more share at least one of
their first n - ceil(t n) + 1 and m - ceil(t m) + 1 (Chaudhuri et al., 2006; Xiao
et al., 2008). Any order is right; this one, by counts of hashed shingles, keeps
common passages out of the prefixes. Equal sets are one node. Where groups are given
from elsewhere, by fingerprints, each node is first compared with its group's least;
what no such group reaches is left to the shingles. In a few rounds every
node is compared with one other: of the nodes that own one of its prefix shingles
(each round another node of all that have it) the one that shares most with it. That
joins up large groups with one pair a node and round. Then those still apart are
compared with one another, where sizes, the places of a shared shingle and bitmaps
of the whole sets (Sandes et al., 2020) allow the similarity at all. Every
candidate is verified on whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.llm.base import LOWER, map_rows, texts
from terracell.plans.components import connected_components
from terracell.plans.durable import discard, durable

#: Cells that shingles are counted in to order them, and cells of a row of counts.
COUNTED, PART = 1 << 20, 1 << 14
#: Longs of a set's bitmap: bit h is the parity of its shingles that hash to h, so sets differ in as many shingles at least as their bitmaps in bits.
SKETCH = 8
#: Bits that say which texts are wanted; a false yes costs a set that is dropped by the next join.
BITS = 1 << 23
#: Keeps a product with a similarity that is an integer from being rounded up.
TINY = 1e-9
#: Rounds in which a node meets one other before all that are still apart meet.
ROUNDS = 2
_STEP = 0x9E3779B97F4A7C15


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all word shingles, or of all words where there are fewer; empty without a word."""
    import xxhash

    split = text.translate(LOWER).split()
    if not split:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w, 42) for w in split), np.uint64, len(split))
    n = min(words, len(split))
    total = np.full(len(each) - n + 1, n, np.uint64)
    for k in range(n):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(_STEP) + each[k : len(each) - n + 1 + k]
    return np.unique((total ^ (total >> np.uint64(32))) * np.uint64(_STEP))


def _digest(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).astype(np.int64))


def _sketch(found: np.ndarray) -> np.ndarray:
    odd = np.bincount((found >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - TINY) + 1 if n else 0


def _measured(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, digest, mark, sketch) of every row, ``mark`` a hash of the text; besides, rows of ``part`` and ``counts``: how many sets of a task have a shingle of each cell."""
    kind = docs.schema[key].dataType

    def run(batches):
        counts, of = np.zeros(COUNTED, np.int32), None
        names = ["key", "mark", "digest", "sketch", "part", "counts"]
        for b in batches:
            digests, sketches, of = [], [], b.column(0).type
            for t in texts(b.column(1)):
                found = shingle_set(t, words)
                digests.append(_digest(found))
                sketches.append(_sketch(found))
                np.add.at(counts, (found % np.uint64(COUNTED)).astype(np.int64), 1)
            rest = [pa.array(digests, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.nulls(len(digests), pa.int32()), pa.nulls(len(digests), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *rest], names=names)
        if of is not None:
            n = COUNTED // PART
            rows = pa.array([counts[k * PART : (k + 1) * PART].tobytes() for k in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, of), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array(range(n), pa.int32()), rows], names=names)

    return map_rows(docs.select(key, text, F.xxhash64(text).alias("_mark")), run, f"key {kind.simpleString()}, mark long, digest long, sketch array<long>, part int, counts binary")


def _frequencies(measured: DataFrame) -> np.ndarray:
    """Counts by cell, summed by Spark as they stream in: COUNTED numbers, whatever the input and its tasks."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.setdefault(part, np.zeros(PART, np.int64))
                total[part] += np.frombuffer(x, np.int32)
        rows = [np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rows, pa.binary())], names=["part", "counts"])

    out = np.zeros(COUNTED, np.int32)
    for r in map_rows(measured.where("part is not null").select("part", "counts").repartition("part"), add, "part int, counts binary").collect():
        out[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts, np.int32)
    return out


def _prefixes(docs: DataFrame, text: str, words: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """(shingle, digest, n, at): the prefix of every row's set; ``at`` is the place in its order."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        often = shared.value
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for t in texts(b.column(0)):
                found = shingle_set(t, words)
                n = _prefix(len(found), similarity)
                first = found[np.lexsort((found, often[(found % np.uint64(COUNTED)).astype(np.int64)]))[:n]]
                for col, x in zip(cols, (first.view(np.int64), np.full(n, _digest(found)), np.full(n, len(found), np.int32), np.arange(n, dtype=np.int32)), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["shingle", "digest", "n", "at"])

    return map_rows(docs.select(text), run, "shingle long, digest long, n int, at int")


def _wanted(marks: DataFrame) -> np.ndarray:
    """A bit set for every mark: BITS bits, whatever the input."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(8 * PART, np.uint8)
        bits[rows.bit.to_numpy() % (8 * PART)] = 1
        return pd.DataFrame({"part": [rows.part.iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    bits = marks.select(F.pmod("mark", F.lit(BITS)).alias("bit")).distinct().withColumn("part", F.floor(F.col("bit") / (8 * PART)).cast("int"))
    out = np.zeros(BITS, bool)
    for r in bits.groupBy("part").applyInPandas(pack, "part int, bits binary").collect():
        out[r.part * 8 * PART : (r.part + 1) * 8 * PART] = np.unpackbits(np.frombuffer(r.bits, np.uint8))
    return np.packbits(out)


def _sets(docs: DataFrame, text: str, words: int, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(digest, shingles) of the nodes in ``pairs``, durable; texts stay where they are."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_wanted(met.join(nodes, "digest").select("mark")))

    def run(batches):
        bits = np.unpackbits(shared.value)
        for b in batches:
            chosen = b.filter(pa.array(bits[b.column(1).to_numpy() % BITS] > 0))
            found = [shingle_set(t, words) for t in texts(chosen.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(f) for f in found], pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["digest", "shingles"])

    found = map_rows(docs.select(text, F.xxhash64(text).alias("mark")), run, "digest long, shingles array<long>")
    return durable(found.dropDuplicates(["digest"]))


def _reaches(similarity: float, overlap: str) -> Column:
    """Whether sets of n and m shingles that have ``overlap`` of them in common at most can reach the similarity."""
    return F.expr(overlap) >= F.expr("n + m") * (similarity / (1 + similarity)) - TINY


#: What sets can share at most that both have the shingle at places i and j.
_AT_PLACES = "least(i, j) + 1 + least(n - 1 - i, m - 1 - j)"

#: The same, if p and q of those before are shared with any other root.
_AFTER_SHARED = "least(p, q) + 1 + least(n - 1 - i, m - 1 - j)"


#: The same, by the bits in which bitmaps x and y differ.
_BY_SKETCHES = f"(n + m - ({' + '.join(f'bit_count(x[{k}] ^ y[{k}])' for k in range(SKETCH))})) / 2"


def _size_class(n: Column, similarity: float) -> Column:
    """Rises with the size; a class is as wide as the similarity."""
    return F.floor(F.log(n) / math.log(1 / similarity)).cast("int") if similarity < 1 else n.cast("int")


def _partner_classes(similarity: float) -> Column:
    """Classes of the sizes that a partner can have by a shingle at place ``at`` of a set of n, ``before`` of those before it being shared with any other root.

    At most n - (at - before) shingles are common, and similar sets of n and m share (n + m) t / (1 + t) and t n at least.
    """
    least = F.ceil(F.col("n") * similarity - TINY)
    most = F.floor((F.col("n") - F.col("at") + F.col("before")) * ((1 + similarity) / similarity) - F.col("n") + TINY)
    return F.sequence(_size_class(least, similarity), _size_class(F.greatest(most, least), similarity))


def _possible(shared: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, c) that can reach the similarity, of (a, b, n, m, i, j): sizes, and places of a shingle that both prefixes have; c is how many they share.

    Up to the last such shingle the sets have just those in common, and beyond it at most what the shorter rest holds.
    """
    met = shared.groupBy("a", "b").agg(F.count("*").alias("c"), *(F.max(x).alias(x) for x in "nmij"))
    return met.where(_reaches(similarity, "c + least(n - 1 - i, m - 1 - j)")).select("a", "b", "c")


def _one_each(placed: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(a, b): for each node at most one owner of its shingles, of another root.

    First shingles are owned by the node that shares most shingles with most others, which is what copies have in common; in later turns by a hash.
    """
    first = F.xxhash64("digest", F.lit(turn)) if turn else -F.col("degree")
    node = F.struct(first.alias("o"), "digest", "n", "at", "root")
    owned = placed.withColumn("owner", F.min(node).over(Window.partitionBy("shingle"))).where("root <> owner.root")
    met = owned.selectExpr("digest a", "owner.digest b", "n", "owner.n m", "at i", "owner.at j").where(_reaches(similarity, _AT_PLACES))
    return _possible(met, similarity).groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    x, y = (sets.select(F.col("digest").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(x, "a").join(y, "b").where(both >= similarity * (F.size("of_a") + F.size("of_b") - both) - TINY).select("a", "b")


def _with_least(base: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): each node of a group (key, group) and the group's least node, one pair a node at most."""
    of = groups.groupBy("key").agg(F.min("group").alias("group"))
    members = durable(base.select("key", "digest").distinct().join(of, "key").select("group", "digest").distinct())
    least = members.groupBy("group").agg(F.min("digest").alias("b")).join(members, "group").where("digest <> b")
    return least.select(F.col("digest").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, groups: DataFrame | None = None) -> DataFrame:
    """(key, component), one row for each row of ``docs``: component is the least key reachable over
    pairs of texts whose sets of ``words``-word shingles have the Jaccard similarity or more.

    ASCII case and spacing don't count. Null and empty texts are equal. ``docs`` is read again for each step.
    ``groups`` (key, group) may name keys that are worth comparing first; a group links nothing by itself.
    """
    measured = durable(_measured(docs, key, text, words))
    base = measured.where("part is null")
    nodes = durable(base.groupBy("digest").agg(F.min("key").alias("least"), F.min("mark").alias("mark"), F.min("sketch").alias("sketch")))

    ends = {f: getattr(F, f)("digest").over(Window.partitionBy("shingle")) for f in ("min", "max")}
    shared = _prefixes(docs, text, words, similarity, _frequencies(measured)).withColumns(ends).where("min < max")
    of_shingle = F.count("*").over(Window.partitionBy("shingle"))
    shared = shared.select("shingle", "digest", "n", "at").distinct().withColumn("has", of_shingle)
    prefixes = durable(shared.withColumn("degree", F.sum("has").over(Window.partitionBy("digest"))).drop("has"))
    links, placed = None, prefixes.withColumn("root", F.col("digest"))

    def verified(pairs: DataFrame) -> DataFrame:
        sets = _sets(docs, text, words, nodes, pairs)
        found = durable(_verified(pairs, sets, similarity))
        discard(pairs, sets)
        return found

    def placed_by(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        roots = durable(connected_components(found))
        return roots, prefixes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))

    if groups is not None:
        links = verified(durable(_with_least(base, groups)))
        roots, placed = placed_by(links)
    for turn in range(ROUNDS):
        found = verified(durable(_one_each(placed, turn, similarity)))
        links = found if links is None else durable(links.unionByName(found))
        roots, placed = placed_by(links)
        if found.isEmpty():
            break
    ends = {f: getattr(F, f)("root").over(Window.partitionBy("shingle")) for f in ("min", "max")}
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("at")) - 1
    apart = durable(placed.withColumns(ends).where("min < max").select("shingle", "digest", "n", "at", "root", nth.alias("before")).join(nodes.select("digest", "sketch"), "digest"))
    sides = [apart.withColumn("size", _size_class(F.col("n"), similarity)), apart.withColumn("size", F.explode(_partner_classes(similarity)))]
    names = ("shingle", "size", "digest", "n", "at", "root", "before", "sketch")
    l, r = (x.select(*(F.col(c).alias(to) for c, to in zip(names, own, strict=True))) for x, own in zip(sides, (("shingle", "size", "a", "n", "i", "ra", "p", "x"), ("s2", "z2", "b", "m", "j", "rb", "q", "y")), strict=True))  # noqa: E741
    both = l.hint("merge").join(r, (F.col("shingle") == F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _reaches(similarity, _AFTER_SHARED) & _reaches(similarity, _BY_SKETCHES))
    pairs = durable(_possible(both.select("a", "b", "n", "m", "i", "j"), similarity).select("a", "b"))
    links = durable(links.unionByName(verified(pairs)))
    roots = durable(connected_components(links))
    named = durable(nodes.join(roots, nodes.digest == roots.node, "left").select("digest", "least", F.coalesce("root", "digest").alias("root")))
    component = durable(named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("digest", "component"))
    discard(nodes, prefixes, apart, links, roots, named)
    return base.join(component, "digest").select("key", "component")
