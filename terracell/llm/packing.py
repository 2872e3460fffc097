"""Best-fit packing in bulk-synchronous steps.

Lengths are whole numbers up to the sequence length, so the sorted lists of
documents and gaps are run-length classes, however many documents there are. A
step takes the longest class not yet placed, sweeps the gaps upward from the
least that holds it (its successors), settles which members get which gap by
rank, updates the gaps, and opens sequences for the rest; steps repeat until no
class is left. The steps decide on class counts; every document then finds its
place by its rank in its class, which is counted in hashed buckets so that a
class with a third of all documents is ranked by many tasks.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracell.llm.base import map_rows
from terracell.plans.durable import durable

SEQUENCE, END_ID = 2048, 0
BUCKETS = 1024
CACHE = 400_000

_CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space that some splitter may treat otherwise: texts with any are encoded whole.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


class Encoder(dict):
    """Ids of texts as little-endian 32-bit bytes, as ``tokenizers`` gives them; remembers up to CACHE chunks.

    Byte-level BPE never joins across a change from other characters to white
    space, so a text's ids are its chunks' ids, joined. Texts that hold the string
    of an added token go to ``tokenizers`` whole, which gives that token's id.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.whole = re.compile("|".join([_ODD_SPACE.pattern, *map(re.escape, added)]))
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self[chunk] = np.array(self.fast.encode_ordinary(chunk), "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        if self.whole.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))


def pieces(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and END_ID, cut only if longer than ``size``.

    The first piece of a cut document takes what doesn't fill a sequence. Null
    and empty texts are one piece of one id.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(vocabulary, ranks)
        for b in batches:
            out = []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                first = n % size or min(n, size)
                cuts = [0, *range(first, n + 1, size)]
                for p, (a, z) in enumerate(pairwise(cuts)):
                    part = ids[4 * a : 4 * z]
                    out.append((k, p, a, z - a, zlib.crc32(part), part))
            at, *columns = zip(*out, strict=True) if out else [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in columns[4]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


@dataclass
class Plan:
    """Members of class ``length`` of rank first[k] to first[k + 1] lie at ``offset`` of sequences from ``sequence`` on."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int


def best_fit(counts: dict[int, int], size: int = SEQUENCE) -> Plan:
    """Place classes of lengths (1 to ``size``) with the given counts. Work depends on the classes, not on the counts."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences that have it
    order: list[int] = []  # heap of gaps, for the sweep
    runs: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    opened = 0

    def add(gap: int, lo: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((lo, n))

    def fill(length: int, rank: int, gap: int, lo: int, n: int, each: int) -> int:
        """``each`` members into each of n sequences with this gap, layer by layer."""
        for layer in range(each if n else 0):
            runs.append((length, rank, lo, size - gap + layer * length))
            rank += n
        add(gap - each * length, lo, n)
        return rank

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        order = [g for g in gaps if g >= length]
        heapq.heapify(order)
        while left and order:
            gap = heapq.heappop(order)
            each = gap // length
            ranges, gaps[gap] = gaps[gap], []
            for lo, n in ranges:
                full = min(n, left // each)
                rank, left = fill(length, rank, gap, lo, full, each), left - full * each
                if full < n and left and left < each:
                    rank, left, full = fill(length, rank, gap, lo + full, 1, left), 0, full + 1
                add(gap, lo + full, n - full)
            if not gaps[gap]:
                del gaps[gap]
        if left:
            each = size // length
            full = left // each
            rank, left = fill(length, rank, size, opened, full, each), left - full * each
            opened += full
            if left:
                fill(length, rank, size, opened, 1, left)
                opened += 1
    runs.sort()
    table = np.array(runs, np.int64).reshape(len(runs), 4)
    return Plan((table[:, 0] << 48) + table[:, 1], np.column_stack([table[:, 2], table[:, 1]]), table[:, 3], opened)


def place(parts: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``parts`` (durable, with ``length``) with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    counts = {r.length: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `size` rows
    plan = spark.sparkContext.broadcast(best_fit(counts, size))
    own = [c for c in parts.columns if c != "uid"]
    bucketed = parts.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(BUCKETS)))
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bucketed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("uid")
    ranked = bucketed.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "bucket"]).select(*own, (F.col("before") + F.col("rank")).alias("rank"))
    at = own.index("length")

    def run(batches):
        p = plan.value
        for b in batches:
            length, rank = b.column(at).to_numpy(), b.column(len(own)).to_numpy()
            k = np.searchsorted(p.key, (length << 48) + rank, side="right") - 1
            sequence = p.sequence[k, 0] + rank - p.sequence[k, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], pa.array(sequence, pa.int64()), pa.array(p.offset[k], pa.int64())], names=[*own, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([parts.schema[c] for c in own]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), a row a piece.

    Rows that repeat an id, or have none, are packed as documents of their own. An
    empty table gives no sequences. Other columns are ignored.
    """
    cut = pieces(docs, size, vocabulary, ranks, with_ids).withColumn("uid", F.monotonically_increasing_id())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return place(durable(cut), size).select(*columns, *["ids"] * with_ids)
