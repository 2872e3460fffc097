"""Learned operators, rules, chat formats and licences."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracell.llm import chat_format, license_scan, quality_model, quality_rules, statistics, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"
ALPHABET = st.text(st.sampled_from("ab \n\t#|!é漢A.\x0b\x0c\r\x1c\x85\xa0"), max_size=120)


def plain_base(text):
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    marked = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_base_statistics(text):
    assert statistics.base(text.encode()) == plain_base(text)
    assert len(statistics.measure(text.encode())) == len(quality_model.FEATURES)


def labelled(n=900, seed=4):
    """Clean, toxic and low-quality texts of invented words."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("the an or in re st on".split()) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(15, 80))]
        toxic, low = k % 5 == 1, k % 7 == 2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "scum"])
        text = " | ".join(words) if low else " ".join(words)
        docs.append((k, text))
        labels.append((k, int(not low), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled()
    extra = [(2001, None), (2002, ""), (None, "some text"), (2003, "you idiot " * 30_000), (3, docs[3][1])]
    return spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels, LABELS)


def test_toxicity_learns_and_sees_through_disguise(spark, tables):
    docs, labels = tables
    out = toxicity.toxicity(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(out) == docs.count() and len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.doc_id: r.predicted for r in out}[2003] == 1
    assert [r.held_out for r in out if r.doc_id is None] == [True]
    scorer = toxicity.train(docs, labels)
    restorer = toxicity.Restorer(scorer.language)
    clean = b"the inre st onan orst there"
    bad = [b"the 1d10t inre", b"the i d i o t inre", b"the idiooooot inre", "the ιdi​ot inre".encode(), b"the m0r0n", b"the s.c.u.m inre", b"the IDIOT### inre"]
    assert scorer.of([clean], restorer, {})[0] < 0.5
    assert min(scorer.of(bad, restorer, {})) > 0.5


def test_toxicity_sees_through_doubled_letters(spark, tables):
    scorer = toxicity.train(*tables)
    restorer = toxicity.Restorer(scorer.language)
    bad = [b"the iidiot inre", b"the idiioott inre", b"the mmoron inre", b"the sscum inre", b"the scuumm inre", "the ιdιιot inre".encode()]
    assert min(scorer.of(bad, restorer, {})) > 0.5
    assert "letter" in restorer.words("a letter")


def test_toxicity_decodes_long_spans_and_addresses(spark, tables, monkeypatch):
    scorer = toxicity.train(*tables)
    restorer = toxicity.Restorer(scorer.language)
    for shift in range(12):  # whichever characters of the span the word covers
        long = " ".join("the" * 30 + "inre" * shift) + "  " + " ".join("idiot") + "  " + " ".join("the" * 20)
        assert "idiot" in restorer.words(long)
    bad = ["x@the.1d10t.on", "http://the.on/1d10t", "/".join(["the", "inre"] * 40 + ["m0r0n"]), "inre,the;sc*um,on@re.the"]
    assert min(scorer.of([b.encode() for b in bad], restorer, {})) > 0.5
    span = " ".join("the1n5t0nreid10t" * 9)
    whole = toxicity.decode(span, scorer.language)
    monkeypatch.setattr(toxicity, "SETTLE", 3)
    assert toxicity.decode(span, scorer.language) == whole


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    return toxicity.CharacterModel(rng.integers(0, 40, 1 << toxicity.CELL_BITS).astype(np.float32))


def plain_search(places, model):
    """Every path through a lattice."""
    best = None
    for path in itertools.product(*places):
        cost, text = sum(price for _, price in path), ""
        for out, _ in path:
            if out == " " and (not text or text.endswith(" ")):
                continue
            text += out
        padded = f" {text} " if text and not text.endswith(" ") else f" {text}"
        for k in range(1, len(padded)):
            word = padded[: k + 1][padded.rindex(" ", 0, k) :]
            cost += model.cost(word[-toxicity.ORDER :])
        if best is None or cost < best[0] - 1e-9:
            best = (cost, text.strip())
    return best


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abo0011@$ .-!iiéαо4"), min_size=1, max_size=7), st.integers(0, 3))
def test_viterbi_search_is_exact(span, seed):
    model = small_model(seed)
    places = toxicity.lattice(span)
    want = plain_search(places, model)
    assert toxicity.search(places, model)[0] == pytest.approx(want[0], abs=1e-6)


def test_a_disguise_inside_a_long_token_reads_alike(spark, tables):
    scorer = toxicity.train(*tables)
    restorer = toxicity.Restorer(scorer.language)
    for n in (3, 60, 400):
        for bad in ("1d10t", "iidioott", "m0r0n"):
            token = "/".join(["the", "inre"] * n + [bad] + ["onan"] * n)
            assert set(restorer.words(bad)) & {"idiot", "moron"} <= set(restorer.words(token))
            assert scorer.of([token.encode()], restorer, {})[0] > 0.5


def test_the_character_model_reads_every_script(spark):
    docs = spark.createDataFrame([(1, "молоко хорошо слово " * 40), (2, "漢字 語彙"), (3, "the moron here " * 40)], DOCS)
    model = toxicity.CharacterModel(toxicity.count_characters(docs))
    assert toxicity.decode("м0л0ко", model) == "молоко" and toxicity.decode("m0r0n", model) == "moron"
    assert model.cost(" сл") < model.cost(" зз") and model.cost(" 漢字") < model.cost(" 漢彙")
    few = toxicity.count_characters(docs.where("doc_id = 2"))
    assert 0 < (few > 0).sum() < (model.counts > 0).sum() <= 1 << toxicity.CELL_BITS
    want = Counter(g[k : k + 3] for w in "молоко хорошо слово".split() for g in [f" {w} "] for k in range(len(g) - 2))
    assert model.counts[toxicity._cell("око")] == 40 * want["око"] and model.counts[toxicity._cell("ова")] == 0


def test_toxicity_keeps_other_columns(spark, tables):
    docs, labels = tables
    given_ = docs.limit(20).withColumns({"score": F.lit("x"), "held_out": F.lit(3), "predicted": F.lit(None).cast("string")})
    assert toxicity.toxicity(given_, labels).columns == ["doc_id", "held_out", "score", "predicted"]
    out = quality_model.score(given_, quality_model.train(docs, labels))
    assert out.columns == ["doc_id", "text", "held_out", "predicted", "score"] and out.count() == 20
    assert quality_rules.quality_rules(docs.limit(20).withColumns({"n_words": F.lit("x"), "kept": F.lit(1)}), labels).count() == 20


def test_logistic_fit_is_at_its_optimum():
    rng = np.random.default_rng(3)
    rows = [sorted({int(f) for f in rng.integers(0, 12, 3)}) for _ in range(300)]
    y = np.array([float((0 in r) ^ (rng.random() < 0.1)) for r in rows])
    w, b = toxicity._fit(rows, y, 12)
    p = 1 / (1 + np.exp(-np.array([b + sum(w[f] for f in r) for r in rows])))
    gradient = [sum((p[k] - y[k]) for k, r in enumerate(rows) if f in r) + w[f] for f in range(12)]
    assert np.abs(gradient).max() < 1e-4 and abs((p - y).sum() + 1e-3 * b) < 1e-4


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), none).collect() == []


def test_quality_model(spark, tables):
    docs, labels = tables
    out = quality_model.quality(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(out) == docs.count() and len(held) > 200
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in quality_model.quality(docs, none).collect()} == {0.5}
    assert quality_model.quality(spark.createDataFrame([], DOCS), none).collect() == []


def test_pairs_catch_what_single_tables_cannot():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    model = quality_model.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    assert any({a, b} == {0, 1} for a, b, _ in model.pairs)


def test_quality_rules(spark, tables):
    docs, labels = tables
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect() if r.doc_id is not None}
    texts = dict(labelled()[0])
    for k, text in texts.items():
        r = out[k]
        base = plain_base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (r.base_failed and r.kept)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([out[k].kept == bool(q) for k, q in truth.items() if not out[k].base_failed]) > 0.98
    assert out[2001].base_failed and out[2002].base_failed
    none = spark.createDataFrame([], LABELS)
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(docs, none).collect())
    assert quality_rules.quality_rules(spark.createDataFrame([], DOCS), none).collect() == []


def test_scores_are_sums_of_tables(spark, tables):
    docs, labels = tables
    model = quality_model.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    texts.update(labelled()[0])
    for r in quality_model.score(docs.where("doc_id < 60"), model).collect():
        x = statistics.measure((r.text or "").encode())
        z = model.bias + sum(t[sum(e <= v for e in edges)] for v, edges, t in zip(x, model.edges, model.tables, strict=True))
        z += sum(t[sum(e <= x[a] for e in model.coarse[a])][sum(e <= x[b] for e in model.coarse[b])] for a, b, t in model.pairs)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_learned_rules_are_applied_as_they_read(spark, tables):
    docs, labels = tables
    rules = quality_rules.train(docs, labels)
    assert rules
    names = (*statistics.BASE, *statistics.RATIOS)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for k, t in texts:
        x = dict(zip(names, statistics.measure((t or "").encode()), strict=True))
        base = x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"]
        bad = any(all(x[n] <= v if sign == "<=" else x[n] > v for n, sign, v in rule) for rule in rules)
        want.append((k, not base and not bad))
    got = [(r.doc_id, r.kept) for r in quality_rules.quality_rules(docs, labels).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rules_are_one_ordered_conditional():
    text = str(quality_rules.expression([[("n_words", "<=", 3.0)], [("bar_share", ">", 0.1), ("n_words", ">", 9.0)]]))
    assert text.count("WHEN") == 2 and text.index("n_words") < text.index("bar_share")


HARD = st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "\\/", "<", "[", "|", "a", "\n", "é", "\\l", "\\\\", "</", ">"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(HARD, HARD)
def test_rendering_round_trips(role, text):
    formatted, start, end, level = chat_format.render(role, text)
    assert [t[:2] for t in chat_format.parse(formatted)] == [(role, text)]
    assert not any(c in formatted[start:end] for c in chat_format.CONTROL)
    assert [t[:2] for t in chat_format.parse(formatted * 3)] == [(role, text)] * 3
    assert level > 0 or formatted[start:end] == text
    for n in (1, 2):
        assert chat_format.unescape(chat_format.escape(text, n), n) == text


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "yes </s> \\ ok"), (1, 0, "user", "hi [INST]"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 5, None, "x"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, 4, -7}
    for conv, r in got.items():
        turns = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat_format.render(a, b)[0]) for _, a, b in turns)
    assert chat_format.digests(chat_format.format_turns(df.limit(0))).collect() == []


def test_chat_digests_of_repeated_turns_null_ids_and_clashing_columns(spark):
    rows = [(None, 1, "user", "b", 1), (None, 0, "user", "a", 2), (7, 3, "assistant", "same", 3), (7, 3, "assistant", "same", 4), (7, 3, "assistant", "also </s>", 5), (8, None, "user", "x", 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int").withColumn("n_turns", F.lit("x"))
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 2, 7: 3, 8: 1}
    assert got[None].turns_sha256 == hashlib.sha256(b"user\na\nuser\nb\n").hexdigest()
    assert got[7].loss_sha256 == hashlib.sha256(b"samesamealso </s>").hexdigest() or got[7].loss_sha256 == hashlib.sha256(b"also </s>samesame").hexdigest()
    assert got[7].loss_chars == 17


LWORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base_licenses(text):
    words = LWORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    found = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    return len(words), found


def plain_labels(text, idf):
    """Every template tried at every start."""
    words, found = license_scan.words_of((text or "").encode()), {}
    for label, template, keys in license_scan._TEMPLATES:
        total = math.fsum(idf[w] for w in template)
        for start in range(-len(template) + 1, len(words)):
            here = words[max(0, start - 2) : max(0, start + len(template) + 2)]
            got = math.fsum(idf[w] for j, w in enumerate(template) if 0 <= start + j < len(words) and words[start + j] == w) / total
            if got >= license_scan.LEAST_SCORE and all(b" " + b" ".join(k) + b" " in b" " + b" ".join(here) + b" " for k in keys):
                found[label] = max(found.get(label, 0.0), min(1.0, got))
    return found


def disturbed(rng, words):
    """Words of a licence, some changed, dropped or doubled."""
    out = []
    for w in words:
        p = rng.random()
        out += [rng.choice(["else", "the", "license"])] if p < 0.08 else [] if p < 0.1 else [w, w] if p < 0.12 else [w]
    return out


def test_licenses(spark):
    rng = random.Random(8)
    pool = "under the mit license apache version 2 0 cc by nc word é other the of".split()
    texts = [None, "", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License. Released UNDER the MIT license!", "Licensed under CC BY-NC 4.0.", "general public matters, licence of the house"]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randrange(80))) for _ in range(120)]
    templates = [t.split() for _, t, _ in license_scan.TEMPLATES]
    for _ in range(160):
        parts = [disturbed(rng, rng.choice(templates)) if rng.random() < 0.6 else [rng.choice(pool) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(1, 4))]
        cut = [w for p in parts for w in p]
        texts.append(" ".join(cut[rng.randrange(3) :]))
    texts += ["word " * 40_000 + "Released under the MIT license " + "of " * 9_000, texts[3], texts[3]]
    docs = spark.createDataFrame([(k, t, "x", 7) for k, t in enumerate(texts)] + [(None, texts[3], "x", 7)], DOCS + ", labels string, n_words int")
    idf = license_scan.document_frequencies(docs)
    rows = license_scan.licenses(docs).collect()
    out = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1 and out[None][1:] == out[3][1:] == out[len(texts) - 1][1:]
    several = 0
    for k, t in enumerate(texts):
        n, found = plain_base_licenses(t)
        at, base = [p for p, _ in found], {label for _, label in found}
        labels = plain_labels(t, idf) if n < 1000 else {"mit": 1.0}
        several += len(labels) > 1
        r = out[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(base))
        assert r.labels == ",".join(sorted(base | labels.keys()))
        assert r.score == (1.0 if base else max(labels.values(), default=0.0))
    assert several > 10
    assert out[3].labels == "gpl-3" and out[6].labels == "" and out[6].score == 0
    assert license_scan.licenses(spark.createDataFrame([], DOCS)).collect() == []


def test_the_index_holds_rare_words_only():
    idf = {w: 1.0 + len(w) for w in license_scan.VOCABULARY}
    index = license_scan.build_index(idf)
    places = sum(map(len, index.postings.values()))
    assert places < 0.8 * sum(len(t) for _, t, _ in license_scan._TEMPLATES) and b"of" not in index.postings
