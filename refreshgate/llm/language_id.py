"""Language identification by bit-sliced Bloom filters of n-grams.

One array of slots serves all languages: bit j of a slot belongs to language j. Looking an n-gram up reads k slots and
ANDs them, which gives the bitmask of every language that (probably) contains the n-gram. A text's score for a language
is the number of its n-grams with that bit, corrected for the false positives expected at that bit's fill.

N-grams are runs of GRAM bytes of the lower-cased text in which everything but letters is a blank, each text standing
between two blanks.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from refreshgate.llm.batches import id_and_text, map_batches, segment_sums, text_slices, utf8_bytes
from refreshgate.session import cut_lineage

GRAM = 4
UNDETERMINED = "und"
LETTER = r"\p{L}"
#: Odd multipliers of the multiply-shift hashes, one per Bloom probe. Fixed values.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
FLUSH_ENTRIES = 1 << 20
BLANK = np.full(256, 32, np.uint8)
BLANK[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
BLANK[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    """languages[j] owns bit j % 64 of word j // 64 of every slot; false_positive[j] is the chance of a wrong hit."""
    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray
    prior: int


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as integers, and the places where each text's begin and end."""
    padded = pc.binary_join_element_wise(" ", pc.utf8_lower(texts), " ", "")
    raw, ends = utf8_bytes(padded)
    letters = BLANK[raw]
    if len(letters) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
    n = len(letters) - GRAM + 1
    key = np.zeros(n, np.uint32)
    for k in range(GRAM):
        key = (key << np.uint32(8)) | letters[k:k + n]
    blank = letters == 32
    two = blank[:-1] & blank[1:]
    keep = ~(two[:n] | two[1:n + 1] | two[2:n + 2])
    for k in range(1, GRAM):  # grams that would run into the next text
        last = ends[1:-1] - k
        keep[last[(last >= 0) & (last < n)]] = False
    kept = np.concatenate(([0], np.cumsum(keep)))
    return key[keep], kept[np.minimum(ends, n)]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language and n-gram, its count in this task; emitted early when the table of a task grows large."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (key, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)),
                                              pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    for batch in batches:
        for part in text_slices(batch):
            key, edges = grams(part.column("text"))
            codes = part.column("lang").dictionary_encode()
            which = np.repeat(codes.indices.to_numpy(), np.diff(edges))
            for j, lang in enumerate(codes.dictionary.to_pylist()):
                found, n = np.unique(key[which == j], return_counts=True)
                if lang in held:
                    old, old_n = held[lang]
                    found, place = np.unique(np.concatenate((old, found)), return_inverse=True)
                    n = np.bincount(place, np.concatenate((old_n, n)), len(found)).astype(np.int64)
                held[lang] = found, n
        if sum(len(k) for k, _ in held.values()) > FLUSH_ENTRIES:
            yield from rows()
            held.clear()
    yield from rows()


def fit(docs: DataFrame, min_share: float = 2e-5, ratio: float = 0.25, bits: int = 20) -> LanguageModel:
    """Learn from every row with a text and a `lang`.

    An n-gram enters the filter of each language where it makes up at least `min_share` of all n-grams, and at least
    `ratio` of its share in the language where it is most common. A language has at most 1 / min_share such n-grams,
    so what reaches the driver is bounded by the number of languages, not by the corpus; 2 ** bits slots are kept.
    """
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    counts = map_batches(known, _count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(
        F.col("share") >= min_share)
    chosen = share.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("by")).select(
        "gram", F.explode(F.filter("by", lambda x: x["share"] >= F.col("top") * ratio)).alias("hit")).select("gram", "hit.lang")
    sizes = {r["lang"]: r["total"] for r in totals.collect()}
    rows = chosen.toPandas()
    languages = sorted(sizes)
    slots = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
    code = rows["lang"].map({lang: j for j, lang in enumerate(languages)}).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    for probe in _probes(rows["gram"].to_numpy(np.uint64), bits):
        np.bitwise_or.at(slots, (probe, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
    fill = np.array([((slots[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(languages))])
    if len(languages) <= 8:  # a smaller array of slots stays in the processor's cache
        slots = slots.astype(np.uint8)
    prior = languages.index(max(languages, key=lambda x: sizes[x])) if languages else -1
    return LanguageModel(languages, slots, fill ** len(MULTIPLIERS), prior)


def _probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    keys = keys.astype(np.uint64)
    for m in MULTIPLIERS:
        yield ((keys * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64)


def predict(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per text: language, its share of all languages' hits, the share of n-grams its language knows, their number."""
    filled = pc.fill_null(texts, "")
    key, edges = grams(filled)
    total = np.diff(edges)
    bits = (len(model.slots) - 1).bit_length()
    hit = None
    for probe in _probes(key, bits):
        hit = model.slots[probe] if hit is None else hit & model.slots[probe]
    width = model.slots.dtype.type
    found = np.zeros((len(texts), len(model.languages)))
    for j, wrong in enumerate(model.false_positive):
        n = segment_sums((hit[:, j // 64] >> width(j % 64)) & width(1), edges)
        found[:, j] = np.maximum(0, (n - total * wrong) / (1 - wrong))
    lettered = pc.match_substring_regex(filled, LETTER).to_numpy(zero_copy_only=False)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), total
    top = found.max(1)
    best = np.where(top > 0, found.argmax(1), model.prior)
    score = np.where(lettered & (top > 0), top / np.maximum(found.sum(1), 1e-12), 0.0)
    known = np.where(lettered, np.minimum(1.0, top / np.maximum(total, 1)), 0.0)
    return [model.languages[j] if ok else UNDETERMINED for j, ok in zip(best, lettered)], score, known, total


def _shared(spark: SparkSession, model: LanguageModel):
    return spark.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), known (0 to 1) of every row; extra columns are not read.

    A NULL text, or one without a letter, is `und` with score 0. A text with none of the model's n-grams gets the most
    common learned language with score 0; ties go to the first language by name. Without learned languages all is `und`.
    """
    shared = _shared(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                lang, score, known, _ = predict(shared.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(known)],
                                                 ["doc_id", "lang_pred", "score", "known"])

    return map_batches(id_and_text(docs), run, "doc_id long, lang_pred string, score double, known double")


def keep_identified(docs: DataFrame, model: LanguageModel, min_known: float = 0.05, min_grams: int = 20) -> DataFrame:
    """The rows of `docs`, unchanged, less those without a language.

    A text goes if it is `und`, or if it has `min_grams` n-grams or more and its best language knows less than
    `min_known` of them (letters in no learned language). Shorter texts give too few n-grams to go by and stay.
    """
    shared = _shared(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                lang, _, known, total = predict(shared.value, part.column("text"))
                stays = (np.array(lang, object) != UNDETERMINED) & ((known >= min_known) | (total < min_grams))
                yield part.filter(pa.array(stays.astype(bool)))

    return map_batches(docs, run, docs.schema)
