from collections import Counter

import numpy as np
import pyarrow as pa
from edges import TEXTS, documents, nothing
from pyspark.sql import functions as F

from refreshgate.llm import language_id
from refreshgate.llm.batches import id_remainder

SF = "/root/testdata/sf0.001"


def plain_grams(text):
    letters = "".join(c for c in f" {text.lower()} ").encode()
    clean = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in letters)
    return [int.from_bytes(clean[i:i + 4]) for i in range(len(clean) - 3) if b"  " not in clean[i:i + 4]]


def test_grams_match_a_plain_loop():
    texts = [t or "" for t in TEXTS] + ["don't  stop"]
    key, edges = language_id.grams(pa.array(texts))
    for k, text in enumerate(texts):
        assert key[edges[k]:edges[k + 1]].tolist() == plain_grams(text), text[:40]


def test_held_out_accuracy_and_exact_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.where(id_remainder(F.col("doc_id"), 4) != 2)
    model = language_id.fit(train)
    found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    held = docs.where(id_remainder(F.col("doc_id"), 4) == 2).collect()
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and 0 <= r["known"] <= 1 for r in found.values())

    # the same decision from exact sets instead of filters
    counts = {}
    for r in train.collect():
        counts.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items() if n / sum(c.values()) >= 2e-5} for lang, c in counts.items()}
    top = Counter()
    for own in share.values():
        for g, s in own.items():
            top[g] = max(top[g], s)
    sets = {lang: {g for g, s in own.items() if s >= 0.25 * top[g]} for lang, own in share.items()}
    agree = 0
    rows = docs.collect()
    for r in rows:
        grams = plain_grams(r["text"])
        hits = {lang: sum(g in own for g in grams) for lang, own in sorted(sets.items())}
        agree += not grams or hits[found[r["doc_id"]]["lang_pred"]] >= 0.98 * max(hits.values())
    assert agree == len(rows)


def test_edges(spark):
    docs = documents(spark)
    model = language_id.fit(docs)
    found = language_id.identify(docs, model).collect()
    assert len(found) == docs.count()
    assert {r["lang_pred"] for r in found if r["doc_id"] in (None, 0, 1, 2)} == {"und"}
    assert {r["lang_pred"] for r in found if r["doc_id"] in (4, 5)} <= {"en", "fr"}
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({None, 0, 1, 2})
    assert language_id.identify(nothing(spark), model).count() == 0
    unlearned = language_id.fit(nothing(spark))
    assert {r["lang_pred"] for r in language_id.identify(docs, unlearned).collect()} == {"und"}


def test_more_languages_than_bits_in_a_word(spark):
    words = [f"{chr(97 + a)}{chr(97 + b)}" for a in range(9) for b in range(9)]
    docs = spark.createDataFrame([(k, f"{w}q{w}z {w}{w}" * 3, f"l{k:02d}") for k, w in enumerate(words)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.slots.shape[1] == 2
    assert all(r["lang_pred"] == f"l{r['doc_id']:02d}" for r in language_id.identify(docs, model).collect())
