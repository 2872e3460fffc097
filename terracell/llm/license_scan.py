"""Licence scans by a positional rare-token index.

Template words are rated by inverse document frequency over all documents. The
index holds, of every template, its rarest places only: so many that a text in
which at least LEAST_SCORE of the template's IDF stands in place must hold two of
them at the right distance (one, where the template is too short for two). Each
file's rare licence words are looked up in the postings, all templates at once;
postings are intersected by relative position, and a start on which enough of
them agree is verified: the whole template's IDF in place, and its mandatory key
phrases word by word. Base phrases are found wherever their words stand
consecutively, from their rarest word.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from terracell.llm.base import map_rows, texts

#: Phrases and labels of the base.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Passages of public licences and their usual notices; in brackets the key phrases that must stand there.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("the mit license",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("on an as is basis without warranties or conditions",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("attribution noncommercial sharealike",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2")),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license",)),
    ("lgpl", "this library is licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
)
#: Share of a template's IDF that must stand in place.
LEAST_SCORE = 0.6
#: Words beside a template's place in which its key phrases may still stand.
MARGIN = 2

#: Word bytes keep their value, A to Z are lowered, all else becomes a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


_TEMPLATES = [(label, words_of(t.encode()), [words_of(k.encode()) for k in keys]) for label, t, keys in TEMPLATES]
_PHRASES = {tuple(words_of(p.encode())): label for p, label in BASE.items()}
VOCABULARY = sorted({w for _, t, _ in _TEMPLATES for w in t} | {w for p in _PHRASES for w in p})
def document_frequencies(docs: DataFrame) -> dict[bytes, float]:
    """IDF of each template word over all documents; each task sends one row a word."""
    known = frozenset(VOCABULARY)

    def run(batches):
        tally, n = Counter(), 0
        for b in batches:
            for t in texts(b.column(0)):
                tally.update(known.intersection(words_of(t)))
                n += 1
        names = [*tally, b""]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([*tally.values(), n], pa.int64())], names=["word", "n"])

    rows = {bytes(r.word): r.n for r in map_rows(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = rows.get(b"", 0)
    return {w: math.log((total + 1) / (rows.get(w, 0) + 1)) + 1 for w in VOCABULARY}


@dataclass(frozen=True)
class Index:
    """Postings (template, place) of rare template words, how many of a template's must agree, and the word each base phrase is looked up by."""

    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]]
    agreeing: list[int]
    phrases: dict[bytes, list[tuple[tuple, int, str]]]


def build_index(idf: dict[bytes, float]) -> Index:
    """Rarest places of each template until the words that may be missing can't be all of them, nor all but one."""
    postings: dict[bytes, list[tuple[int, int]]] = {}
    agreeing = []
    for t, (_, template, _) in enumerate(_TEMPLATES):
        places = sorted(range(len(template)), key=lambda i, w=template: (-idf[w[i]], i))
        missing = (1 - LEAST_SCORE) * math.fsum(idf[w] for w in template) + 1e-9
        held, need, n = 0.0, missing + idf[template[places[0]]], 0
        while n < len(places) and held <= need:
            held, n = held + idf[template[places[n]]], n + 1
        agreeing.append(2 if held > need else 1)
        for i in places[:n]:
            postings.setdefault(template[i], []).append((t, i))
    phrases: dict[bytes, list[tuple[tuple, int, str]]] = {}
    for phrase, label in _PHRASES.items():
        at = max(range(len(phrase)), key=lambda i, p=phrase: (idf[p[i]], -i))
        phrases.setdefault(phrase[at], []).append((phrase, at, label))
    return Index(idf, postings, agreeing, phrases)


def standing(words: list[bytes], t: int, start: int, idf: dict[bytes, float]) -> float:
    """The share of template t's IDF that stands in place from ``start``, which may lie before the text; 0 without its key phrases or under LEAST_SCORE."""
    _, template, keys = _TEMPLATES[t]
    here = words[max(0, start - MARGIN) : max(0, start + len(template) + MARGIN)]
    if not all(any(here[x : x + len(key)] == key for x in range(len(here) - len(key) + 1)) for key in keys):
        return 0.0
    got = math.fsum(idf[w] for j, w in enumerate(template) if 0 <= start + j < len(words) and words[start + j] == w)
    got /= math.fsum(idf[w] for w in template)
    return min(1.0, got) if got >= LEAST_SCORE else 0.0


def scan(words: list[bytes], index: Index) -> tuple[list[tuple[int, str]], dict[str, float]]:
    """Base places, and the score of each label that the index finds."""
    own = set(words)
    rare, asked = own & index.postings.keys(), own & index.phrases.keys()
    if not rare and not asked:
        return [], {}
    at: dict[bytes, list[int]] = {w: [] for w in rare | asked}
    for i, w in enumerate(words):
        if w in at:
            at[w].append(i)
    base = [
        (i - k, label)
        for w in asked
        for phrase, k, label in index.phrases[w]
        for i in at[w]
        if i >= k and tuple(words[i - k : i - k + len(phrase)]) == phrase
    ]
    votes = Counter((t, i - j) for w in rare for t, j in index.postings[w] for i in at[w])
    labels: dict[str, float] = {}
    for (t, start), n in votes.items():
        if n >= index.agreeing[t] and (got := standing(words, t, start, index.idf)):
            label = _TEMPLATES[t][0]
            labels[label] = max(labels.get(label, 0.0), got)
    return base, labels


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of ``docs``.

    Null and empty texts have no words, null places, empty labels and score 0. The
    score is the share of a template's IDF that stands in place, of the best
    template, and 1 where a base phrase stands. Repeated rows and rows without an
    id each return a row. Texts are scanned whole, however long. Other columns are
    ignored.
    """
    index = build_index(document_frequencies(docs))
    source = docs.select("doc_id", "text")
    schema = StructType([source.schema["doc_id"]])
    for name, kind in (("n_words", LongType()), ("n_base", LongType()), ("first_word", LongType()), ("last_word", LongType()), ("base_labels", StringType()), ("labels", StringType()), ("score", DoubleType())):
        schema = schema.add(name, kind)
    kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())

    def run(batches):
        for b in batches:
            out = []
            for t in texts(b.column(1)):
                words = words_of(t)
                places, found = scan(words, index)
                starts, base = [p for p, _ in places], {label for _, label in places}
                score = 1.0 if base else min(1.0, max(found.values(), default=0.0))
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.fieldNames())

    return map_rows(source, run, schema)
