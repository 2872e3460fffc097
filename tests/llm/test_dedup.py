"""SimHash and embedding near-dedup against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from terracell.llm import embedding_dedup, shingles, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words, now = [], ""
    for c in (text or "").translate({k: k + 32 for k in range(65, 91)}):
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    words += [now] if now else []
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "One", "one", "Two words", "é ñ 漢 字 漢 字 " * 3, "x " * 5000]
    for _ in range(n):
        words = [rng.choice("the of and to in that it was for on are with as be by at from this".split()) + str(rng.randrange(30)) for _ in range(rng.randrange(3, 200))]
        texts.append(" ".join(words))
        if rng.random() < 0.6:
            near = words[:]
            near[rng.randrange(len(near))] = "changed"
            texts += [" ".join(near), " ".join(words).upper()]
    return texts


def test_simhash_matches_brute_force(spark):
    texts = corpus()
    rows = [(1000 - k, t, None, None, None) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_components(len(texts), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    for k in range(len(texts)):
        assert got[1000 - k].fingerprint == f"{fps[k]:016x}"
        assert got[1000 - k].component_id == min(1000 - j for j in range(len(texts)) if roots[j] == roots[k])


def _links_of(spark, fps):
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from terracell.plans.components import connected_components
    from terracell.plans.durable import durable

    return {(r.node & ((1 << 64) - 1)): r.root & ((1 << 64) - 1) for r in connected_components(simhash.links(durable(df))).collect()}


def test_grid_join_finds_every_near_fingerprint(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 5))) for b in base for _ in range(12)})
    roots = plain_components(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    want = {frozenset(fps[j] for j in range(len(fps)) if roots[j] == r) for r in set(roots)}

    def groups(found):
        by = {}
        for f in fps:
            by.setdefault(found.get(f, f), set()).add(f)
        return {frozenset(v) for v in by.values()}

    assert groups(_links_of(spark, fps)) == want
    monkeypatch.setattr(simhash, "CELL_ROWS", 3)  # crowded cells go block by block
    assert groups(_links_of(spark, fps)) == want


def test_some_quarter_is_equal_and_the_next_nearly():
    import itertools

    for bits in range(4):
        for at in itertools.combinations_with_replacement(range(4), bits):
            d = [at.count(k) for k in range(4)]
            assert any(d[k] == 0 and d[(k + 1) % 4] <= 1 for k in range(4)), d


def test_keep_one_keeps_one_of_each_group_and_all_columns(spark):
    rows = [(5, "a b c d e", "en", "s", 1), (2, "A B C D E", "en", "s", 1), (2, "A B C D E", "en", "s", 1), (9, "", None, None, None), (7, None, "x", "y", 0), (8, "quite another text here", "en", "s", 1)]
    out = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in out.collect()) == [2, 7, 8]
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_keep_one_tells_null_and_repeated_ids_apart(spark):
    one, two, three = ("the quick brown fox jumps high", "some wholly other text stands here", "a third text of no relation at all")
    rows = [(None, one), (None, two), (None, two), (None, three), (4, three), (6, "first of two texts under six"), (6, "nothing in common with that one there"), (6, "nothing in common with that one there")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(out.collect(), key=str) == sorted([(None, one), (None, two), (4, three), (6, rows[5][1]), (6, rows[6][1])], key=str)


def test_keep_one_matches_brute_force_jaccard(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "one two", "ONE  two", "x " * 900]
    for k in range(50):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 160))] + "one common line that many of the documents here do have".split() * (k % 2)
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            near = words[:]
            for _ in range(rng.randrange(1, 2 + len(words) // 40)):
                near[rng.randrange(len(near))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(near))

    def plain(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [plain(t) for t in texts]
    linked = lambda i, j: sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) > 0
    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and linked(i, j)]
    fps = [plain_fingerprint(t) for t in texts]
    assert sum(bin(fps[i] ^ fps[j]).count("1") > 3 for i, j in near) > 10  # beyond operator 1's radius
    want = sorted(set(plain_components(len(texts), linked)))
    out = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == want
    assert simhash.keep_one(out.limit(0)).collect() == []


def test_keep_one_where_most_of_a_text_is_a_common_passage(spark):
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(80)]
    texts = []
    for k in range(90):
        own = [f"own{k}x{j}" for j in range(rng.choice((0, 1, 3, 6, 9, 12, 18, 25)))]
        cut = rng.randrange(0, 12)
        texts.append(" ".join(own + passage[cut:] if k % 2 else passage[: 80 - cut] + own))

    def plain(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    sets = [plain(t) for t in texts]
    # Texts that link by a passage alone and texts that only almost do.
    linked = lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    want = sorted(set(plain_components(len(texts), linked)))
    assert 5 < len(want) < 80
    out = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == want


def test_keep_one_starts_from_fingerprints_and_checks_them(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    bits = lambda a, b: bin((simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)) & (1 << 64) - 1).count("1")
    near = next(t for k in range(400) if 0 < bits(" ".join(words), t := " ".join([*words[:k], "other", *words[k + 1 :]])) <= 3)
    # One passage so often that it alone makes the fingerprint: an equal one, but most of the differing shingles are others.
    passage, loud = "a b c d e f g".split() * 200, [[f"{c}{k}" for k in range(30)] for c in "xyz"]
    texts = [" ".join(words), near, *(" ".join([*passage, *own]) for own in loud), " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))]
    assert bits(texts[2], texts[3]) <= 3 < bits(texts[0], texts[5])
    seen = []
    started = shingles._with_least

    def spied(base, groups):
        pairs = started(base, groups)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(shingles, "_with_least", spied)
    out = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4, 5]
    assert seen and seen[0] >= 2  # 0 with 1, and at least one of the loud ones, which the check takes apart


def test_simhash_of_an_empty_table_and_clashing_columns(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = spark.createDataFrame([(1, "a b", 3, 4), (None, "a b", 5, 6)], "doc_id long, text string, fp long, component_id long")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(rows).collect()) == [(0, 1), (1, 1)]


def plain_embeddings(rows, threshold):
    """(vec_id, n_links, component_id, kept) of each row, in order of the rows."""
    unit = []
    for _, e, label in rows:
        ok = e and None not in e and np.isfinite(np.array(e, float)).all() and np.any(np.array(e, float)) and label is not None
        unit.append(np.array(e, float) / np.linalg.norm(np.array(e, float)) if ok else None)

    def linked(i, j):
        if unit[i] is None or unit[j] is None or len(unit[i]) != len(unit[j]) or rows[i][2] != rows[j][2]:
            return False
        return rows[i][1] == rows[j][1] or float(unit[i] @ unit[j]) >= threshold

    roots, out = plain_components(len(rows), linked), []
    for i, (vec, _, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None), default=None)
        out.append((vec, sum(linked(i, j) for j in range(len(rows)) if j != i), least, vec == least))
    return out


def embeddings_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def hard_vectors(seed=5):
    rng = np.random.default_rng(seed)
    rows = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 15 + [float("inf")], 2), (904, [1.0] * 16, None), (905, [None] * 16, 2), (906, [], 2), (907, [1.0, 2.0], 2), (908, [2.0, 4.0], 2)]
    rows += [(909, [1.0, 2.0, None], 2), (910, [1.0, None, 2.0], 2), (911, [1.0, 2.0], 2), (None, [1.0, 2.0], 2), (912, [0.0, 1.0], 2), (913, [-0.0, 1.0], 2), (None, None, None)]
    for k in range(60):
        v = rng.normal(size=16)
        for j in range(rng.integers(1, 5)):
            rows.append((k * 10 + int(j), [float(np.float32(x)) for x in v + rng.normal(size=16) * 0.1], int(k % 3)))
    # Copies, under other ids, under the same id and without one; ids that repeat with other vectors and labels.
    rows += [(5000 + k, rows[40][1], rows[40][2]) for k in range(7)] + [rows[41]] * 3 + [(None, rows[41][1], rows[41][2])]
    rows += [(rows[42][0], rows[60][1], rows[60][2]), (rows[42][0], rows[42][1], (rows[42][2] + 1) % 3)]
    return rows


def test_embeddings_match_brute_force(spark, monkeypatch):
    rows = hard_vectors()
    want = sorted(plain_embeddings(rows, 0.98), key=str)
    for size in (8192, 40, 5):  # one block; several axes; many blocks a cell
        monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", size)
        got = embedding_dedup.near_duplicates(embeddings_of(spark, rows)).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert any(n for _, n, _, _ in want)


def test_embeddings_match_their_sql(spark):
    import duckdb

    from terracell.llm import queries

    rows = hard_vectors(6)
    con = duckdb.connect()
    con.register("embeddings", embeddings_of(spark, rows).toArrow())
    want = con.execute(queries.ORACLE["op2_embedding_dedup"]).fetchall()
    got = embedding_dedup.near_duplicates(embeddings_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_embeddings_at_the_threshold_and_of_many_lengths(spark):
    # Cosines of exactly 0.6 and 0.8, and of every length its own vectors.
    rows = [(1, [1.0, 0.0], 0), (2, [3.0, 4.0], 0), (3, [0.0, -2.0], 0), (4, [3.0, -4.0], 0)]
    rows += [(10 * d + k, [1.0] * d + [float(k)], 0) for d in range(3, 40) for k in (0, 0.01, 9)]
    rows = [(int(i), v, label) for i, v, label in rows]
    for threshold in (0.6, 0.8, 1.0):
        got = embedding_dedup.near_duplicates(embeddings_of(spark, rows, "double"), threshold).collect()
        assert sorted(map(tuple, got)) == sorted(plain_embeddings(rows, threshold))


def test_large_groups_of_equal_and_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre, other = rng.normal(size=32), rng.normal(size=32)
    near = [[float(np.float32(x)) for x in centre + 0.02 * rng.normal(size=32)] for _ in range(5000)]
    same = [float(np.float32(x)) for x in other]
    rows = [(k, v, 1) for k, v in enumerate(near)] + [(k, same, 1) for k in range(5000, 10000)] + [(20000, same, 2)]
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 1500)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(embeddings_of(spark, rows)).collect()}
    x = np.array(near)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert [got[k].n_links for k in range(5000)] == want.tolist()
    assert want.min() > 0 and {got[k].component_id for k in range(5000)} == {0}
    assert {got[k][1:3] for k in range(5000, 10000)} == {(4999, 5000)} and got[20000][1:] == (0, 20000, True)


def test_embeddings_ignore_columns_of_their_own_names(spark):
    rows = embeddings_of(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)]).withColumns({n: F.lit("x") for n in ("uid", "h", "w", "cell", "n_links", "component_id")})
    assert sorted(map(tuple, embedding_dedup.near_duplicates(rows).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_pruning_loses_no_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 32))
    x[150:] = x[:150] + rng.normal(size=(150, 32)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    found = {(int(i), int(j)) for a, b, _ in embedding_dedup.tile_links(x @ axes, x @ axes, 0.97) for i, j in zip(a, b, strict=True)}
    near = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.97 + 1e-9), strict=True)}
    assert near <= found and len(near) > 300
    assert all(x[i] @ x[j] >= 0.97 - 2e-9 for i, j in found)


def test_embeddings_of_an_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(5)
    for n, own in ((0, 1), (40, 3), (300, 30), (5000, 400)):
        common = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        x, y = (np.union1d(common, rng.integers(0, 2**63, own, dtype=np.uint64)) for _ in range(2))
        bits = np.bitwise_count((shingles._sketch(x) ^ shingles._sketch(y)).view(np.uint64)).sum()  # of signed numbers it counts the magnitude
        assert shingles._sketch(x).shape == (shingles.SKETCH,)
        assert bits <= len(np.setxor1d(x, y)) and (own not in (3, 30) or bits > own / 2)
