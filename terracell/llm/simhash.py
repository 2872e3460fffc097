"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two bits, eight to a quarter. The
vector of segment popcounts embeds it in a grid where the Manhattan distance never
exceeds the Hamming distance. Of two fingerprints that differ in at most three
bits some quarter is equal while the next one (the first follows the last) differs
in at most one bit: of four quarters one at least is equal, and if the one after
it differs in two bits or more, only one bit is left for the other two, so one of
these is equal as well and followed by a quarter that differs in one bit at most.
There the popcount vectors are equal or one step apart along one axis: a grid
range-join on (equal quarter, vector of the next) meets every such pair, and the
exact Hamming distance then verifies it. Equal fingerprints are one node, so
copies are never expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm import shingles
from terracell.llm.base import LOWER, Forest, map_rows, texts
from terracell.plans.components import connected_components
from terracell.plans.durable import discard, durable

MAX_BITS = 3
#: Fingerprints of a cell beyond which the cell is dealt out as pairs of blocks of this size.
CELL_ROWS = 1024
#: Hashes whose bits are counted at once.
CHUNK = 1 << 14


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, repeats included; 0 without a word."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        hashes = np.array([digest(s, 42) for s in shingles[at : at + CHUNK]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each whole text; null and empty texts have 0."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle_words) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fp long")


def _quarter(k: int) -> Column:
    return F.shiftrightunsigned("fp", 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))


def _vector(quarter: Column) -> Column:
    """The eight popcounts of a quarter's two-bit segments, packed in 16 bits."""
    odd = F.lit(0x5555)
    return quarter.bitwiseAND(odd) + F.shiftrightunsigned(quarter, 1).bitwiseAND(odd)


def _cells(fps: DataFrame) -> DataFrame:
    """(fp, key, vec): a row for each quarter, key naming it and its bits, vec the popcounts of the next."""
    rows = F.array(*(F.struct((_quarter(k) + F.lit(k << 16)).cast("long").alias("key"), _vector(_quarter(k + 1)).alias("vec")) for k in range(4)))
    return fps.select("fp", F.explode(rows).alias("c")).select("fp", "c.key", "c.vec")


def _cell(key: str, vec: Column) -> Column:
    return F.shiftleft(F.col(key), 16).bitwiseOR(vec)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): connected exactly as distinct fingerprints at MAX_BITS or fewer differing bits are.

    ``fps`` holds distinct, durable fingerprints. Cells of up to CELL_ROWS emit
    their links; larger cells are compared block by block and emit a spanning
    forest, so no group is expanded into all its pairs.
    """
    cells = _cells(fps)
    home = cells.select("fp", _cell("key", F.col("vec")).alias("cell"))
    # Segment i has count < 2 where its high bit is clear: a step up stays in the grid.
    steps = [F.when(F.col("vec").bitwiseAND(F.lit(2 << 2 * i)) == 0, F.col("vec") + F.lit(1 << 2 * i)) for i in range(8)]
    reach = (
        cells.select("fp", "key", F.posexplode(F.array(F.col("vec"), *steps)).alias("step", "to"))
        .where("to is not null")
        .select("fp", _cell("key", F.col("to")).alias("cell"), (F.col("step") > 0).alias("moved"))
    )
    hot = durable(home.groupBy("cell").count().where(F.col("count") > CELL_ROWS))
    crowded = not hot.isEmpty()
    left, right = (reach.join(hot, "cell", "left_anti"), home.join(hot, "cell", "left_anti")) if crowded else (reach, home)
    # Size estimates don't count the rows that explode adds: without the hint `left` would be broadcast when it is far too large.
    found = (
        left.alias("l")
        .hint("merge")
        .join(right.alias("r"), F.col("l.cell") == F.col("r.cell"))
        .where((F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= MAX_BITS) & (F.col("l.moved") | (F.col("l.fp") < F.col("r.fp"))))
        .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    )
    return found.unionByName(_crowded_links(reach, home, hot)) if crowded else found


def _crowded_links(reach: DataFrame, home: DataFrame, hot: DataFrame) -> DataFrame:
    k = F.ceil(F.col("count") / CELL_ROWS).cast("long")
    block = F.pmod(F.xxhash64("fp"), k)
    all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
    lefts = reach.join(hot, "cell").select("cell", "fp", block.alias("i"), all_blocks.alias("j"), F.lit(0).alias("side"))
    rights = home.join(hot, "cell").select("cell", "fp", all_blocks.alias("i"), block.alias("j"), F.lit(1).alias("side"))

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        fp, side = rows.fp.to_numpy(np.int64), rows.side.to_numpy()
        both = np.unique(fp)
        x, y = (np.searchsorted(both, np.unique(fp[side == s])) for s in (0, 1))
        bits, own = both.view(np.uint64), Forest(len(both))
        for at in range(0, len(x), 256):
            r, c = np.nonzero(np.bitwise_count(bits[x[at : at + 256], None] ^ bits[None, y]) <= MAX_BITS)
            own.union(x[at : at + 256][r], y[c])
        root = own.roots()
        linked = root != np.arange(len(both))
        return pd.DataFrame({"a": both[linked], "b": both[root[linked]]})

    return lefts.unionByName(rights).groupBy("cell", "i", "j").applyInPandas(forest, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    component_id is the smallest id reachable over links, its own included. Null
    and empty texts have fingerprint zero and link with each other. A null id
    stays null and is never a component's smallest id unless all its ids are
    null. Repeated rows each return a row. Other columns are ignored.
    """
    base = durable(fingerprints(docs, id_col, text_col, shingle_words))
    nodes = durable(base.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = durable(connected_components(links(nodes.select("fp"))))
    named = durable(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = durable(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of_fp = durable(named.join(smallest, "root").select("fp", "component_id"))
    discard(nodes, roots, named, smallest)
    return base.join(of_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near duplicates: exactly one row of each group stays.

    Groups are texts whose word shingles reach the Jaccard similarity. The first candidates are the components
    of fingerprints of as many words, by the grid join; they are checked exactly, as near fingerprints can be of
    less similar texts. No radius of a 64-bit fingerprint that can be searched reaches all groups, so what
    the fingerprints leave apart is completed by rare shingles, none left out.
    The one that stays is the one with the smallest id; a row without an id stays only where its whole group has none.
    Equal ids are told apart by their texts, so rows of other groups never count as repeats.
    """
    key = "_key"
    keyed = docs.withColumn(key, _row_key(id_col, text_col))
    groups = near_duplicates(keyed, key, text_col, shingle_words).select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    found = shingles.near_duplicates(keyed, key, text_col, shingle_words, similarity, groups)
    keys = durable(found.where(F.col("key") == F.col("component")).groupBy(F.col("key").alias(key)).count())
    # Kept keys grow with the corpus, so they are never broadcast; hashing them spares a sort of the texts.
    kept = keyed.join(keys.where("count = 1").select(key).hint("shuffle_hash"), key, "left_semi")
    again = keys.where("count > 1").select(key)
    if not again.isEmpty():
        kept = kept.unionByName(keyed.join(again, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)


def _row_key(id_col: str, text_col: str) -> Column:
    """Orders rows by id, those without one last, then by text; only rows of one id and one text share it."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
