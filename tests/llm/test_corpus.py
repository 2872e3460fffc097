"""Sharding, mixing, packing and the pipeline."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terracell.llm import mixing, packing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_table(names, slots):
    import xxhash

    order = []
    for n in names:
        offset, stride = xxhash.xxh64_intdigest(n.encode(), 1) % slots, xxhash.xxh64_intdigest(n.encode(), 2) % (slots - 1) + 1
        order.append([(offset + j * stride) % slots for j in range(slots)])
    owner, turn = {}, 0
    while len(owner) < slots:
        k = turn % len(names)
        owner[next(s for s in order[k] if s not in owner)] = k
        turn += 1
    return [owner[s] for s in range(slots)]


def test_lookup_table():
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 1009)
    assert table.tolist() == plain_table(names, 1009)
    sizes = np.bincount(table, minlength=7)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = (table != fewer)[table != 6].mean()
    assert moved < 0.15
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_assign_shards(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("slot")).unionByName(spark.createDataFrame([(None, "n"), (7, "again")], "doc_id long, slot string"))
    out = sharding.assign_shards(df).toPandas()
    assert len(out) == 5002 and out.shard.notna().all()
    assert out[out.doc_id == 7].shard.nunique() == 1
    assert out.groupby("shard").size().max() < 60
    sharding.write_shards(df.drop("slot"), str(tmp_path / "out"), names=["a", "b"], slots=211)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 5002 and {r.shard for r in back.select("shard").distinct().collect()} == {"a", "b"}
    assert sharding.assign_shards(df.limit(0)).count() == 0


def test_rows_are_placed_by_the_hash_of_their_key(spark, tmp_path):
    import struct

    import xxhash

    names = [f"shard-{k:05d}" for k in range(256)]
    owner = plain_table(names, 65_537)
    rows = spark.range(0, 4000, 7).toDF("slot").withColumn("v", F.lit("x"))
    got = sharding.assign_shards(rows.withColumn("k", F.col("slot")), "slot")
    assert got.columns == ["v", "k", "slot", "shard"]
    for r in got.collect():
        h = xxhash.xxh64_intdigest(struct.pack("<q", r.k), 42)
        slot = (h - (1 << 64) if h >> 63 else h) % 65_537
        assert (r.slot, r.shard) == (slot, names[owner[slot]])
    hot = spark.range(4000).select(F.lit("").alias("doc_id"), F.col("id").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        sharding.write_shards(hot, str(tmp_path / "hot"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = spark.read.parquet(str(tmp_path / "hot")).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 4000 and max(r["count"] for r in files) < 3000


def test_temperature():
    tokens = {"big": 900_000, "b": 50_000, "c": 30_000, "d": 20_000, "none": 0}
    m = mixing.temperature(tokens, target_entropy=0.8, max_repeats=1000)
    assert mixing.entropy(m.weights) == pytest.approx(0.8 * math.log(4), rel=1e-9)
    m = mixing.temperature(tokens, target_entropy=1.0, max_repeats=3)
    assert max(m.weights[s] * m.budget / n for s, n in tokens.items() if n) == pytest.approx(3, rel=1e-9)
    assert mixing.temperature({"a": 5}).alpha == 1 and mixing.temperature({}).weights == {}


def plain_alpha(tokens, budget, target_entropy, max_repeats):
    """By a fine scan and halving, without the library."""
    live = np.array([n for n in tokens.values() if n > 0], float)
    if len(live) < 2:
        return 1.0

    def weights(a):
        w = (live / live.sum()) ** a
        return w / w.sum()

    def fits(a):
        w = weights(a)
        return -(w * np.log(w)).sum() <= target_entropy * math.log(len(live)) + 1e-12 and (w * budget / live).max() <= max_repeats + 1e-12

    natural = weights(1.0)
    if -(natural * np.log(natural)).sum() >= target_entropy * math.log(len(live)):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


@pytest.mark.parametrize("few", [100_000, 2])
def test_mixing_meets_quotas_exactly(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "MAX_SOURCES", few)
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 40)), None, "big" if k % 3 else rng.choice(["a", "b", None]), 1) for k in range(3000)]
    rows += [(9000, None, None, "empty", 0), (9001, "", None, "a", 0)]
    rows += [(5, rows[5][1], None, "a", 1)] * 400 + [(None, "w w w", None, "b", 1)] * 300  # repeated and null ids
    df = spark.createDataFrame(rows, DOCS).withColumn("epoch", F.lit("clash"))
    out = mixing.mix(df, target_entropy=0.98, max_repeats=2.5).withColumn("n", mixing.word_count(F.col("text"))).toPandas()
    tokens: dict = {}
    longest: dict = {}
    for _, text, _, s, _ in rows:
        n = len((text or "").split())
        tokens[s], longest[s] = tokens.get(s, 0) + n, max(longest.get(s, 0), n)
    budget = sum(tokens.values())
    alpha = plain_alpha(tokens, budget, 0.98, 2.5)
    raised = {s: (n / budget) ** alpha if n else 0.0 for s, n in tokens.items()}
    assert alpha < 1
    for s, n in tokens.items():
        own = out[out.source.isna()] if s is None else out[out.source == s]
        quota = raised[s] / sum(raised.values()) * budget
        if n:
            assert quota - longest[s] - 1 < own.n.sum() <= quota + 1e-3
            assert own.repeats.iloc[0] == pytest.approx(quota / n)
            rows_of = sum(r[3] == s for r in rows)
            whole = int(quota // n)
            for e in range(whole):
                assert (own.epoch == e).sum() == rows_of
            assert own.epoch.max() <= whole
    assert (out.source == "empty").sum() == 1
    assert out.mix_key.between(0, 1, inclusive="left").all()
    for s in ("big", "a", "b"):
        own = out[out.source == s]
        assert 0.4 < own[own.mix_key < 0.5].n.sum() / own.n.sum() < 0.6
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixture_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 40)), None, rng.choice("abc"), 1) for k in range(900)]
    rows += [rows[7]] * 700 + [(None, "w w w", None, "b", 1)] * 60 + [(None, None, None, None, None)] * 9
    df = spark.createDataFrame(rows, DOCS).withColumn("nth", F.lit("clash")).withColumn("count", F.lit(3))
    found = []
    for parts, seed in ((1, 0), (5, 1), (13, 2)):
        dealt = df.orderBy(F.rand(seed)).repartition(parts)
        out = mixing.mix(dealt, budget=9000, target_entropy=0.99)
        assert out.columns == [*df.columns, "epoch", "repeats", "mix_key"]
        found.append(sorted(map(str, out.collect())))
    assert found[0] == found[1] == found[2]
    copies = [r.mix_key for r in out.where("doc_id = 7").collect() if r.mix_key < math.nextafter(1.0, 0.0)]
    assert len(copies) > 50 and len(set(copies)) == len(copies)  # equal rows have places of their own


def test_blocks_are_permuted(spark):
    n = 1 << mixing.BLOCK_BITS
    blocks = spark.range(n).crossJoin(spark.range(5).select(F.xxhash64("id").alias("key")))
    rows = blocks.select("id", "key", mixing._permuted(F.col("id"), F.col("key")).alias("to")).toPandas()
    orders = [tuple(own.sort_values("id").to) for _, own in rows.groupby("key")]
    assert all(sorted(o) == list(range(n)) for o in orders) and len(set(orders)) == 5
    assert all(abs(np.corrcoef(range(n), o)[0, 1]) < 0.2 for o in orders)


def plain_best_fit(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in range(len(gaps)) if gaps[g] >= n), key=lambda g: gaps[g], default=None)
        if fit is None:
            gaps.append(size - n)
        else:
            gaps[fit] -= n
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_steps(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, 64, rng.randrange(1, 65), rng.randrange(1, 20)]) for _ in range(rng.randrange(1, 700))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit(counts, 64)
    rank, place = dict.fromkeys(counts, 0), []
    for n in lengths:
        k = int(np.searchsorted(plan.key, (n << 48) + rank[n], side="right")) - 1
        assert plan.key[k] >> 48 == n
        place.append((int(plan.sequence[k, 0]) + rank[n] - int(plan.sequence[k, 1]), int(plan.offset[k]), n))
        rank[n] += 1
    at: dict = {}
    for s, o, n in sorted(place):
        assert o == at.get(s, 0) and o + n <= 64
        at[s] = o + n
    assert len(at) == plan.n_sequences == plain_best_fit(lengths, 64)


ENCODED = st.lists(st.sampled_from(["the ", "don't", "  ", "\n\n", "\x1c", "é", "漢字", "<|endoftext|>", "<|endoftext", "|>", "3.14", " ", "\u3000", "a", "'", "!!", "\t"]), max_size=25).map("".join)
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = packing.Encoder()


@settings(max_examples=500, deadline=None)
@given(ENCODED)
def test_ids_are_those_of_the_tokenizer(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    rng = random.Random(4)
    words = "the of hello wörld 漢字 a's it'll 3.14 -- <|endoftext|>   don't x\x1cy".split(" ")
    texts = [None, "", "\n\n  ", "a  b\t\tc \r\n d", "x    y", "end   z "] + [rng.choice(["\n", " ", "  "]).join(rng.choice(words) for _ in range(rng.choice([3, 30, 300, 4000]))) for _ in range(60)]
    rows = [(k, t, None, None, 0) for k, t in enumerate(texts)] + [(0, None, None, None, 0)]
    out = packing.pack(spark.createDataFrame(rows, DOCS), with_ids=True).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    want = {k: [*t.encode(x or "", add_special_tokens=False).ids, 0] for k, x in enumerate(texts)}
    assert (out.doc_id == 0).sum() == 2
    for k, own in out[out.doc_id != 0].groupby("doc_id"):
        own = own.sort_values("piece")
        assert list(own.piece) == list(range(len(own)))
        assert [i for p in own.ids for i in p] == want[k]
        assert list(own.start) == [0, *np.cumsum(own.length)[:-1]]
        assert (own.length.iloc[1:] == 2048).all() and own.length.max() <= 2048
        assert (len(own) == 1) == (len(want[k]) <= 2048)
        for p, c in zip(own.ids, own.ids_crc32, strict=True):
            assert zlib.crc32(np.array(p, "<u4").tobytes()) == c
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    assert out.sequence_id.nunique() == plain_best_fit(list(out.length), 2048)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_without_ids_and_with_clashing_columns(spark):
    rows = spark.createDataFrame([(None, "a b", 1, "x"), (None, "a b", 2, "y"), (3, "word " * 9000, 3, "z")], "doc_id long, text string, length int, uid string")
    out = packing.pack(rows).toPandas()
    assert out.doc_id.isna().sum() == 2 and list(out.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out[out.doc_id == 3].length.sum() == 9002 and out.sequence_id.nunique() == 5


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    docs, labels = [], []
    pool = ["".join(rng.choice("the an or in re st on".split()) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    for k in range(600):
        words = [rng.choice(pool) for _ in range(rng.randrange(20, 60))]
        toxic, low = k % 6 == 1, k % 6 == 2
        if toxic:
            words[3] = "idiot"
        docs.append((k, " | ".join(words) if low else " ".join(words), "en", f"s{k % 3}", 0))
        labels.append((k, int(not low), int(toxic)))
    docs += [(1000 + k, docs[3][1].upper(), "en", "s0", 0) for k in range(50)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        table = stage(spark, table, str(tmp_path))
        path = str(tmp_path / f"stage{k}")
        table.write.parquet(path)
        table = spark.read.parquet(path)
        kept.append((name, table))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert table.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for _, t in kept]
    clean = {k for k in range(600) if k % 6 not in (1, 2)}
    assert len(ids[0] & {k for k in range(600) if k % 6 == 1}) <= 2 and clean <= ids[0]
    assert not ids[1] & {k for k in range(600) if k % 6 == 2} and clean <= ids[1]
    assert clean == ids[2]  # 1000.. are copies of 3
    assert ids[3] <= ids[2] and ids[4] == ids[3]
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(out.doc_id) == sorted(r.doc_id for r in kept[-1][1].collect())


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_matches_brute_force(spark, tmp_path):
    """The models' verdicts text by text, then near-dedup, mixing and packing by plain Python."""
    import corpus_pipeline
    from terracell.llm import quality_model, toxicity

    rng = random.Random(9)
    pool = ["".join(rng.choice("the an or in re st on".split()) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for k in range(420):
        words = [rng.choice(pool) for _ in range(rng.randrange(20, 90))]
        toxic, low = k % 6 == 1, k % 6 == 2
        if toxic:
            words[3] = rng.choice(["idiot", "m0ron"])
        docs.append((k, " | ".join(words) if low else " ".join(words), "en", f"s{k % 5 and k % 3}", 0))
        labels.append((k, int(not low), int(toxic)))
        if k % 9 == 0:  # copies and near copies, the ids of some repeated or null
            near = words[:]
            near[5] = "other"
            docs += [(1000 + k, " ".join(words).upper(), None, "s1", None), (k, " ".join(near), "en", None, 0), (None, " ".join(words), "en", "s0", 0)]
    docs += [(5000, None, None, None, None), (5001, "", "en", "s0", 0), (5002, " ".join(rng.choice(pool) for _ in range(5000)), "en", "s2", 0), (None, "a text without id " + " ".join(rng.choice(pool) for _ in range(40)), "en", "s2", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table, known = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))

    scorer = toxicity.train(table, known)
    scores = scorer.of([(d[1] or "").encode() for d in docs], toxicity.Restorer(scorer.language), {})
    left = [d for d, s in zip(docs, scores, strict=True) if s < 0.5]
    model = quality_model.train(spark.createDataFrame(left, DOCS), known)
    good = model.score(quality_model._measured([(d[1] or "").encode() for d in left])) >= 0.5
    left = [d for d, g in zip(left, good, strict=True) if g]
    sets = [plain_shingles(d[1]) for d in left]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    members: dict = {}
    for d, g in zip(left, group, strict=True):
        members.setdefault(g, []).append(d)
    least = {g: min((d[0] for d in own if d[0] is not None), default=None) for g, own in members.items()}
    assert len(members) < len(left)

    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    uses = out[out.piece == 0].doc_id.astype(object).where(out[out.piece == 0].doc_id.notna(), None)
    assert {None if u is None else int(u) for u in uses} <= set(least.values())
    stages = table
    for _, stage in corpus_pipeline.STAGES[:3]:
        stages = stage(spark, stages, str(tmp_path))
    kept = stages.collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted(least.values(), key=str)
    assert {r.text for r in kept} <= {d[1] for d in left}
    tokens: dict = {}
    for r in kept:
        tokens[r.source] = tokens.get(r.source, 0) + len((r.text or "").split())
    budget = sum(tokens.values())
    alpha = plain_alpha(tokens, budget, mixing.ENTROPY, mixing.REPEATS)
    raised = {s: (n / budget) ** alpha for s, n in tokens.items() if n}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in kept:
        ids.setdefault(zlib.crc32(np.array(([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])[:2048], "<u4").tobytes()), []).append(r)
    mixed = {s: 0 for s in raised}
    for r in out[(out.piece == 0) & (out.length < 2048)].itertuples():
        (own,) = ids[r.ids_crc32]
        if own.source in mixed:
            mixed[own.source] += len((own.text or "").split())
    for s in raised:
        longest = max(len((r.text or "").split()) for r in kept if r.source == s)
        quota = raised[s] / sum(raised.values()) * budget
        if longest < 2000:
            assert quota - longest - 1 < mixed[s] <= quota + 1e-6
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    assert out.sequence_id.nunique() == plain_best_fit(list(out.length), 2048)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS + ", score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
