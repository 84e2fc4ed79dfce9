"""License scans by a positional index of rare words, with DataFrame functions only.

Of each template, the words of its mandatory phrases that are rarest in the corpus (highest IDF) are indexed with their
positions. A file's places of those words, shifted by the position in the template, are the starts at which the
template may stand; only starts that all its indexed words agree on are looked at, and there every mandatory phrase
must stand word for word. Files without any template's rarest word are done after one lookup.
"""
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Phrases that count as base places, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, wording, and the phrases of the wording that must be there.
WORDINGS = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", ("permission is hereby granted", "obtaining a copy of this software")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("redistribution and use in source and binary forms", "permitted")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "is hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("unencumbered software", "public domain")),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
INDEXED = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]  # (position in words, words) of each mandatory phrase
    base: bool

    def indexed(self, df: dict[str, int]) -> list[tuple[str, int]]:
        """Rarest words of the mandatory phrases, with their first position there."""
        places: dict[str, int] = {}
        for at, phrase in self.phrases:
            for k, word in enumerate(phrase):
                places.setdefault(word, at + k)
        return sorted(places.items(), key=lambda x: (df.get(x[0], 0), x[0]))[:INDEXED]


def _template(label: str, wording: str, phrases: tuple[str, ...], base: bool) -> Template:
    words = tuple(wording.split())
    placed = []
    for phrase in phrases:
        own = tuple(phrase.split())
        placed.append((next(k for k in range(len(words)) if words[k:k + len(own)] == own), own))
    return Template(label, words, tuple(placed), base)


TEMPLATES = (*(_template(label, phrase, (phrase,), True) for phrase, label in BASE),
             *(_template(*row, False) for row in WORDINGS))


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lowered; empty for NULL."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS, " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def document_frequencies(words: DataFrame, templates: tuple[Template, ...]) -> dict[str, int]:
    """In how many rows each word of the templates' mandatory phrases stands: one number per such word."""
    vocabulary = sorted({w for t in templates for _, phrase in t.phrases for w in phrase})
    rows = words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in rows.collect()}


def _starts(template: Template, df: dict[str, int]) -> Column:
    """Verified starts of a template, from the file's places of index words and its words."""
    def shifted(word: str, position: int) -> Column:
        return F.transform(F.filter("places", lambda p: p["word"] == word), lambda p: p["at"] - position)

    agreed = reduce(F.array_intersect, [shifted(*entry) for entry in template.indexed(df)])

    def stands(start: Column) -> Column:
        found = F.lit(True)
        for at, phrase in template.phrases:
            found = found & F.when(start + at >= 0, F.slice("words", start + at + 1, len(phrase)) == _strings(phrase)).otherwise(False)
        return found

    return F.filter(agreed, stands)


def _share(template: Template) -> Column:
    """Largest share of the template's words that stand where it has them, over its starts; 0 without a start."""
    wording, starts = _strings(template.words), F.col("starts").getField(template.label)
    if template.base:  # a base wording is its own mandatory phrase
        return F.when(F.size(starts) > 0, 1.0).otherwise(0.0)

    def share(start: Column) -> Column:
        same = F.filter(F.sequence(F.lit(0), F.lit(len(template.words) - 1)),
                        lambda k: F.when(start + k >= 0, F.get(F.col("words"), start + k) == F.get(wording, k)))
        return F.size(same) / F.lit(float(len(template.words)))

    return F.coalesce(F.array_max(F.transform(starts, share)), F.lit(0.0))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of `docs`.

    Base places are all starts of a base template. score is the largest share of a template's words that stand in place
    around a verified start, 1 for any base place and 0 without a start. NULL and empty texts have no words, no places
    and empty labels; repeated rows are scanned each; extra columns are not read.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("words"))
    df = document_frequencies(words, templates)
    rarest = sorted({t.indexed(df)[0][0] for t in templates})
    index = _strings(sorted({w for t in templates for w, _ in t.indexed(df)}))
    places = F.when(F.arrays_overlap("words", _strings(rarest)), F.filter(
        F.transform("words", lambda w, k: F.struct(w.alias("word"), k.alias("at"))), lambda p: F.array_contains(index, p["word"])))
    placed = words.withColumn("places", places).withColumn("starts", F.when(
        F.col("places").isNotNull(), F.struct(*[_starts(t, df).alias(t.label) for t in templates])))
    base, own = [t for t in templates if t.base], list(templates)
    base_starts = F.flatten(F.array(*[F.col("starts").getField(t.label) for t in base]))
    found = F.col("starts").isNotNull()

    def labels(of: list[Template]) -> Column:
        named = F.array(*[F.when(F.size(F.col("starts").getField(t.label)) > 0, t.label) for t in of])
        return F.when(found, F.array_join(F.array_sort(F.array_distinct(F.array_compact(named))), ",")).otherwise("")

    return placed.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.when(found, F.size(base_starts)).otherwise(0).cast("long").alias("n_base"),
        F.when(found, F.array_min(base_starts)).cast("long").alias("first_word"),
        F.when(found, F.array_max(base_starts)).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(own).alias("labels"), F.when(found, F.greatest(*map(_share, own))).otherwise(0.0).alias("score"))


def oracle() -> str:
    """The same result in DuckDB SQL over `documents`: every template tried at every place of every text."""
    def quoted(words) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    def starts(t: Template) -> str:
        (first, _), *_ = t.phrases
        checks = " AND ".join(f"i - {first} + {at} >= 0 AND words[i - {first} + {at} + 1:i - {first} + {at} + {len(p)}] = {quoted(p)}"
                              for at, p in t.phrases)
        every = quoted(dict.fromkeys(w for _, p in t.phrases for w in p))
        return (f"CASE WHEN list_has_all(words, {every}) THEN list_transform(list_filter(range(0, n), lambda i: {checks}), "
                f"lambda i: i - {first}) ELSE [] END AS \"{t.label}\"")

    def share(t: Template) -> str:
        if t.base:
            return f"CASE WHEN len(\"{t.label}\") > 0 THEN 1.0 ELSE 0.0 END"
        same = " + ".join(f"(CASE WHEN s + {k} >= 0 AND words[s + {k} + 1] = '{w}' THEN 1 ELSE 0 END)" for k, w in enumerate(t.words))
        return f"coalesce(list_max(list_transform(\"{t.label}\", lambda s: ({same}) / {len(t.words)}.0::DOUBLE)), 0.0)"

    def labels(of) -> str:
        named = ", ".join(f"CASE WHEN len(\"{t.label}\") > 0 THEN '{t.label}' END" for t in of)
        return f"array_to_string(list_sort(list_distinct(list_filter([{named}], lambda x: x IS NOT NULL))), ',')"

    base = [t for t in TEMPLATES if t.base]
    every = "flatten([" + ", ".join(f'"{t.label}"' for t in base) + "])"
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}') AS words FROM documents),
counted AS (SELECT doc_id, words, len(words) AS n FROM split),
found AS (SELECT doc_id, words, n, {", ".join(starts(t) for t in TEMPLATES)} FROM counted)
SELECT doc_id, n::BIGINT AS n_words, len({every})::BIGINT AS n_base, list_min({every})::BIGINT AS first_word,
  list_max({every})::BIGINT AS last_word, {labels(base)} AS base_labels, {labels(TEMPLATES)} AS labels,
  greatest({", ".join(share(t) for t in TEMPLATES)})::DOUBLE AS score
FROM found"""
