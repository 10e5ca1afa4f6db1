"""Licence scan with a positional rare-token index.

Templates are word sequences: the phrases of the base rule, short notices, and passages of licence
bodies, each with a mandatory key phrase. Postings say at which places of which key phrases a word
stands. A file's licence words are looked up from the highest inverse document frequency (counted
over all files) down. The first word of a template proposes starts, its place in the file less its
place in the template; each further one keeps the proposals that it agrees with, until ``rare``
places of the key phrase have been intersected. What is left has to hold the key phrase whole; then
the rest of the template is compared there, word by word. A template of which the file lacks a word
of the key phrase is not looked at, and no proposal is dropped otherwise, so no match is lost.

Defined cases: a null or empty text has no words, no places and no labels and scores 0; places of
different phrases and overlapping places all count; repeated rows give repeated rows; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

# The phrases of the base rule with their labels.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Label, notice, mandatory key phrase (all lower case, words separated by blanks).
NOTICES = (
    ("mit", "released under the mit license", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person obtaining a copy"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc0-1.0", "released under cc0 1 0 universal", "cc0 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "to deal in the software without restriction",
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice this list of conditions",
    ),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "http www apache org licenses license 2 0",
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 3",
    ),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 2",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "gnu lesser general public license as published by the free software foundation",
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "gnu affero general public license as published by the free software foundation",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ),
    (
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "to any person or organization obtaining a copy of the software and accompanying documentation",
    ),
)

#: Bytes that separate words: ASCII without letters and digits, after lower-casing.
_SEPARATORS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
_TO_BLANK = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_TO_BLANK).split()


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of files, and of files that hold each word of the vocabulary (a bounded list), counted over all of them."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[bytes, int] = defaultdict(int)
        texts = batch.column(0).to_pylist()
        for text in texts:
            for w in vocabulary.intersection(words_of(text)):
                found[w] += 1
        names = ["", *(w.decode() for w in found)]
        return pa.RecordBatch.from_pydict({"word": names, "n": pa.array([len(texts), *found.values()], pa.int64())})

    rows = map_batches(docs.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop("", 0), {w.encode(): n for w, n in counts.items()}


class Index:
    """Positional postings of the key phrases' words and weights of all words of the templates. Small: it travels in the closure."""

    def __init__(self, n_files: int, df: dict[bytes, int], notices=NOTICES, phrases=BASE_PHRASES, rare: int = 2):
        idf = lambda w: math.log((n_files + 1) / (df.get(w, 0) + 1)) + 1
        self.templates = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for kind, rows in (("base", [(label, p, p) for p, label in phrases]), ("notice", notices)):
            for label, notice, key in rows:
                words, must = notice.encode().split(), key.encode().split()
                key_at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
                for i, w in enumerate(must):
                    self.postings[w].append((len(self.templates), key_at + i))
                self.templates.append((kind, label, words, [idf(w) for w in words], key_at, must))
        self.by_idf = sorted(self.postings, key=lambda w: (-idf(w), w))
        self.needed = [frozenset(t[-1]) for t in self.templates]
        self.rare = rare

    def proposals(self, words: list[bytes]) -> dict[int, set[int]]:
        """For each template whose key words the file has, the starts that ``rare`` places of its key phrase agree on."""
        at: dict[bytes, list[int]] = {}
        for p, w in enumerate(words):
            if w in self.postings:
                at.setdefault(w, []).append(p)
        open_ = {t: self.rare for t, needed in enumerate(self.needed) if needed <= at.keys()}
        starts: dict[int, set[int]] = {}
        for w in self.by_idf if open_ else ():
            if w not in at:
                continue
            for t, o in self.postings[w]:
                if open_.get(t, 0):
                    open_[t] -= 1
                    own = {p - o for p in at[w]}
                    starts[t] = starts[t] & own if t in starts else own
        return starts

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], dict[str, float]]:
        """Base places (label, start) and, for each label of the method, the largest weighted share of a notice that stands."""
        base, labels = [], {}
        for t, found in self.proposals(words).items():
            kind, label, template, weights, key_at, must = self.templates[t]
            for start in found:
                first = start + key_at
                if first < 0 or words[first : first + len(must)] != must:
                    continue
                if kind == "base":
                    base.append((label, start))
                    continue
                same = sum(x for i, x in enumerate(weights) if 0 <= start + i < len(words) and words[start + i] == template[i])
                labels[label] = max(same / sum(weights), labels.get(label, 0.0))
        return base, labels


LICENCE_SCHEMA = "doc_id long, n_words long, base_places array<struct<label:string,start:long>>, found array<struct<label:string,share:double>>"


def scan_licenses(docs: DataFrame, notices=NOTICES, phrases=BASE_PHRASES, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, base_places (label, start) and found (label, share of the notice), for each row of ``docs``."""
    vocabulary = {w for text in [p for p, _ in phrases] + [n for _, n, _ in notices] for w in text.encode().split()}
    n_files, df = document_frequencies(docs, vocabulary)
    index = Index(n_files, df, notices, phrases)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, base, found = [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            places, labels = index.scan(words)
            n.append(len(words))
            base.append([{"label": x, "start": p} for x, p in sorted(places, key=lambda x: (x[1], x[0]))])
            found.append([{"label": x, "share": s} for x, s in sorted(labels.items()) if s >= least])
        places_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        found_type = pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, places_type), pa.array(found, found_type)], names=["doc_id", "n_words", "base_places", "found"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, LICENCE_SCHEMA)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("base_places", lambda x: x["start"])
    base = F.array_sort(F.array_distinct(F.transform("base_places", lambda x: x["label"])))
    own = F.transform("found", lambda x: x["label"])
    share = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(F.when(F.size("base_places") > 0, 0.5).otherwise(0.0), F.least(share, F.lit(1.0))).alias("score"),
    )
