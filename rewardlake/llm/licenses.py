"""License scan with a positional index of rare licence words.

Templates are short licence texts with mandatory key phrases.  One pass over
all documents counts in how many each licence word occurs.  A template is
then posted under the ``RARE`` words of its key phrase with the highest IDF;
in each file the positions of those words are looked up, shifted by the
word's place in the template and intersected, which leaves the places where
the rare words stand right relative to each other.  At each place every word
of the key phrase is verified, and the IDF weight of the template words that
stand right gives the score.

Column expressions only; each document is read once per pass and nothing is
shuffled but the word counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rare words a template is posted under
RARE = 3

#: what separates words, after lower-casing A-Z
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words``: the template text; ``key``: the mandatory phrase in it."""
    label: str
    words: str
    key: str
    base: bool = False


TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy",
             "hereby granted free of charge to any person"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "copy modify and or distribute this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification",
             "use in source and binary forms"),
    Template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3",
             "general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    Template("unlicense", "free and unencumbered software released into the public domain",
             "unencumbered software released into the public domain"),
)


def license_words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased.  The Kelvin sign is the only other
    character whose lower case is an ASCII letter; it is kept from that."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(plain, GAP), "")


def word_weights(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the licence words over all documents.  One row per licence word
    reaches the driver."""
    found = docs.select(F.array_distinct(F.filter(license_words(F.col("text")), lambda w: w.isin(vocabulary))).alias("w"))
    counts = found.select(F.explode_outer("w").alias("w"), F.lit(1).alias("one"))
    rows = {r["w"]: r["n"] for r in counts.groupBy("w").agg(F.count("one").alias("n")).collect()}
    total = docs.count()
    return {w: math.log((total + 1) / (rows.get(w, 0) + 0.5)) for w in vocabulary}


def _offset(phrase: list[str], inside: list[str]) -> int:
    for i in range(len(inside) - len(phrase) + 1):
        if inside[i:i + len(phrase)] == phrase:
            return i
    raise ValueError(f"key phrase {' '.join(phrase)!r} is not in its template")


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE) -> DataFrame:
    """Columns: those of ``docs`` but ``text``, then ``n_words``, ``places``
    (array of label, base, start: every verified place of every key phrase,
    by start) and ``score`` (0 to 1: the largest share of a found template's
    IDF weight that stands right around a place).

    Defined cases: null text counts as empty; overlapping and repeated
    places all count; files without places have score 0; input columns
    named like an output are replaced.
    """
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    idf = word_weights(docs, vocabulary)
    posted: list[tuple[Template, int, list[int]]] = []
    for t in templates:
        key, words = t.key.split(), t.words.split()
        ranked = sorted(range(len(key)), key=lambda i: (-idf[key[i]], i))
        posted.append((t, _offset(key, words), ranked[:rare]))
    looked_up = sorted({t.key.split()[i] for t, _, best in posted for i in best})

    rest = [c for c in docs.columns if c not in ("text", "n_words", "places", "score")]
    d = docs.select(F.struct(F.lit(None).alias("_none"), *rest).alias("row"), license_words(F.col("text")).alias("_words"))
    d = d.withColumn("n_words", F.size("_words").cast("bigint"))
    words = F.col("_words")
    d = d.withColumn("_pos", F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(looked_up), i))))
    for n, (t, at, best) in enumerate(posted):
        d = d.withColumn(f"_c{n}", _candidates(words, F.col("_pos"), t.key.split(), best))
    for n, (t, at, best) in enumerate(posted):
        d = d.withColumn(f"_p{n}", _verified(words, F.col(f"_c{n}"), t.key.split()))
    shares = [_best_share(words, F.col(f"_p{n}"), t.words.split(), at, idf) for n, (t, at, _) in enumerate(posted)]
    lists = [_labelled(F.col(f"_p{n}"), t) for n, (t, _, _) in enumerate(posted)]
    d = d.withColumn("places", F.sort_array(F.concat(*lists))).withColumn("score", F.greatest(*shares))
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "n_words", "places", "score")


def _candidates(words: Column, pos: Column, key: list[str], best: list[int]) -> Column:
    """Starts at which all posted words of a key phrase stand right."""
    def shifted(i: int) -> Column:
        return F.transform(F.filter(pos, lambda p: F.get(words, p) == key[i]), lambda p: p - i)
    out = shifted(best[0])
    for i in best[1:]:
        out = F.array_intersect(out, shifted(i))
    return out


def _labelled(starts: Column, t: Template) -> Column:
    return F.transform(starts, lambda s: F.struct(
        s.cast("bigint").alias("start"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base")))


def _verified(words: Column, starts: Column, key: list[str]) -> Column:
    def whole(s: Column) -> Column:
        ok = s >= 0
        for i, w in enumerate(key):
            ok = ok & F.coalesce(F.get(words, s + i) == w, F.lit(False))
        return ok
    return F.filter(starts, whole)


def _best_share(words: Column, places: Column, template: list[str], at: int, idf: dict[str, float]) -> Column:
    total = sum(idf[w] for w in template) or 1.0

    def share(s: Column) -> Column:
        got = F.lit(0.0)
        for i, w in enumerate(template):
            got = got + F.when(F.get(words, s + (i - at)) == w, F.lit(idf[w] / total)).otherwise(F.lit(0.0))
        return F.least(got, F.lit(1.0))
    return F.coalesce(F.array_max(F.transform(places, share)), F.lit(0.0))


def labels_of(places: Column, base_only: bool) -> Column:
    """Distinct labels, sorted, comma-joined."""
    kept = F.filter(places, lambda p: p["base"]) if base_only else places
    return F.array_join(F.sort_array(F.array_distinct(F.transform(kept, lambda p: p["label"]))), ",")
