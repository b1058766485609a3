"""License scans by a positional rare-token index, in DataFrame functions only.

Templates are known licence wordings. For each template whose mandatory key phrase a file may hold
(it has all of its words), the words of the phrase with the highest inverse document frequency in
the corpus are looked up in an index of the phrases' words and places; places that agree on where
the template would start are votes for an alignment, and an alignment that has all its votes is a
match if the key phrase stands there word for word. So each place of each key phrase is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The characters between words, and the base phrases with their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Label, licence wording, mandatory key phrase in it.
TEMPLATES = (
    ("gpl", "gnu general public license", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license", "gnu library general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("gfdl", "gnu free documentation license", "gnu free documentation license"),
    ("apache", "apache license", "apache license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing software"),
    ("mit", "mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "to any person obtaining a copy of this software"),
    ("bsl", "boost software license", "boost software license"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("bsd", "bsd 2 clause license", "bsd 2 clause"),
    ("bsd", "bsd 3 clause license", "bsd 3 clause"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form is subject to the terms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify"),
    ("isc", "isc license", "isc license"),
    ("cc-by", "cc by", "cc by"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc0", "creative commons zero", "creative commons zero"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable for any damages"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("eupl", "european union public licence", "european union public licence"),
    ("cddl", "common development and distribution license", "common development and distribution license"),
    ("artistic", "artistic license", "artistic license"),
    ("ofl", "sil open font license", "sil open font license"),
    ("psf", "python software foundation license", "python software foundation license"),
)


#: The words of the key phrases; the base phrases are among these.
PHRASES = tuple(dict.fromkeys(phrase for _, _, phrase in TEMPLATES))
VOCABULARY = sorted({w for phrase in PHRASES for w in phrase.split()})
#: Words of a template's key phrase that are looked up, rarest first; fewer would be exact too.
LOOKED_UP = 2


def words(text: Column) -> Column:
    """Words of ``text`` with A-Z lower-cased; other letters stay as they are."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def places(phrase: str, array: str = "w") -> Column:
    """Starts (from 0) of the phrase's words standing consecutively."""
    want = phrase.split()
    starts = F.transform(F.col(array), lambda w, i: F.when(w == want[0], i))
    follow = lambda i: [F.get(F.col(array), i + k) == want[k] for k in range(1, len(want))]

    def holds(i):
        out = i.isNotNull()
        for c in follow(i):
            out = out & F.coalesce(c, F.lit(False))
        return out

    return F.filter(starts, holds)


def _strings(words) -> Column:
    return F.array(*(F.lit(w) for w in words)).cast("array<string>")


def whole_phrases() -> Column:
    """Numbers of the phrases of which the text holds every word (``seen``)."""
    wanted = F.array(*(_strings(sorted(set(p.split()))) for p in PHRASES))
    numbers = F.array(*(F.lit(k) for k in range(len(PHRASES))))
    return F.filter(numbers, lambda k: F.size(F.array_except(F.get(wanted, k), F.col("seen"))) == 0)


def base_scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``rid``, the id, ``n_words``, the base columns, the key phrases' words it holds
    (``seen``), the phrases it holds all words of, and all its words if there are any (else null)."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    rows = rows.select("rid", "doc_id", "w", F.array_distinct(F.filter("w", lambda w: w.isin(VOCABULARY))).alias("seen"))
    rows = rows.select("rid", "doc_id", "w", "seen", whole_phrases().alias("phrases"))
    found = [F.when(F.array_contains("phrases", PHRASES.index(p)), places(p)).otherwise(F.array().cast("array<int>")).alias(f"p{k}") for k, (p, _) in enumerate(BASE)]
    rows = rows.select("rid", "doc_id", "w", "seen", "phrases", *found)
    every = F.flatten(F.array(*(F.col(f"p{k}") for k in range(len(BASE)))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE))))
    return rows.select(
        "rid",
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels.alias("base"),
        "seen",
        "phrases",
        F.when(F.size("phrases") > 0, F.col("w")).alias("w"),
    )


def document_frequencies(scanned: DataFrame) -> dict[str, int]:
    """In how many rows each word of the key phrases occurs; the vocabulary bounds the result."""
    counts = scanned.select(F.explode("seen").alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}


def _index(frequency: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """The rarest words of the templates' key phrases: word, template, place in the template, and
    the votes that the phrase gives where it stands."""
    out = []
    for t, (_, wording, phrase) in enumerate(TEMPLATES):
        key, offset = phrase.split(), _find(wording.split(), phrase.split())
        rarest = sorted(set(key), key=lambda w: (frequency.get(w, 0), w))[:LOOKED_UP]
        at = [(w, k) for k, w in enumerate(key) if w in rarest]
        out += [(w, t, offset + k, len(at)) for w, k in at]
    return out


def matches(scanned: DataFrame) -> DataFrame:
    """Verified alignments: ``rid``, ``label``, ``start`` (word from 0), ``score`` (share of the
    template's words that stand in place; short names count as at least eight words)."""
    index = _index(document_frequencies(scanned))
    rare = F.array(*(_strings(sorted({w for w, t, _, _ in index if TEMPLATES[t][2] == phrase})) for phrase in PHRASES))
    held = scanned.where(F.col("w").isNotNull()).select("rid", "w", F.array_distinct(F.flatten(F.transform("phrases", lambda k: F.get(rare, k)))).alias("rarest"))
    at = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("place"), w.alias("word"))), lambda x: F.array_contains("rarest", x["word"]))
    hits = held.select("rid", F.explode(at).alias("hit")).select("rid", "hit.place", "hit.word")
    places_of = scanned.sparkSession.createDataFrame(index, "word string, template int, at int, need int")
    votes = (
        hits.join(F.broadcast(places_of), "word")  # some dozen rows
        .groupBy("rid", "template", "need", (F.col("place") - F.col("at")).alias("start"))
        .agg(F.count("*").alias("votes"))
    )
    wording = F.array(*(F.array(*(F.lit(w) for w in t.split())) for _, t, _ in TEMPLATES))
    key = F.array(*(F.array(*(F.lit(w) for w in k.split())) for _, _, k in TEMPLATES))
    offset = F.array(*(F.lit(_find(t.split(), k.split())) for _, t, k in TEMPLATES))
    label = F.array(*(F.lit(name) for name, _, _ in TEMPLATES))
    of = lambda a: F.element_at(a, F.col("template") + 1)
    enough = votes.where((F.col("start") + of(offset) >= 0) & (F.col("votes") == F.col("need")))
    aligned = enough.join(held.select("rid", "w"), "rid")
    aligned = aligned.where(F.slice("w", F.col("start") + of(offset) + 1, F.size(of(key))) == of(key))
    in_place = F.size(F.filter(F.transform(of(wording), lambda t, i: F.coalesce(F.when(F.col("start") + i >= 0, F.get(F.col("w"), F.col("start") + i) == t), F.lit(False))), lambda x: x))
    return aligned.select("rid", of(label).alias("label"), "start", (in_place / F.greatest(F.size(of(wording)), F.lit(8))).alias("score"))


def _find(words: list[str], key: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence labels of every row of ``docs``.

    A null text is empty: no words, no places, null ``first_word`` and ``last_word``, empty labels
    and a score of 0. Repeated rows are scanned one by one; other columns are not carried. An
    empty table gives an empty result.
    """
    scanned = materialize(base_scan(docs, id_col, text_col), "license-scan")
    best = matches(scanned).groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))
    joined = scanned.select("rid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").join(best, "rid", "left")
    text = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("doc_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        text(F.col("base")).alias("base_labels"),
        text(F.concat("base", F.coalesce("found", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
