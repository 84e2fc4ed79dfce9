import itertools
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from edges import TEXTS, documents, nothing

from refreshgate.llm import quality_rules as rules

SF = "/root/testdata/sf0.001"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None and len(t) < 5000]
                         + ["a b c d e a b c d e", "a b c d e f a b c d e", "x x x x x x x x", "# *|<>\n\n#\n #\n# *|<>", "\x1c\x85\xa0 é"])
def test_base_counts(text):
    assert rules.base_counts(text) == plain_counts(text)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(40):
        crf = rules.LineCrf(np.zeros(1), rng.normal(size=2), rng.normal(size=(2, 2)))
        emission = rng.normal(size=rng.integers(1, 8)).tolist()

        def worth(path):
            return (crf.start[path[0]] + sum(crf.moves[a][b] for a, b in zip(path, path[1:])) + sum(e for e, s in zip(emission, path) if s))

        best = max(itertools.product((0, 1), repeat=len(emission)), key=worth)
        assert rules.decode(crf, emission) == list(best)


def test_training_follows_the_likelihood():
    """A step of training must not lower the exact likelihood, summed over all paths."""
    rng = np.random.default_rng(5)
    samples = [(int(k % 2), rng.normal(size=(rng.integers(1, 5), len(rules.FEATURES))) + (k % 2)) for k in range(30)]

    def likelihood(crf):
        total = 0
        for label, x in samples:
            e = x @ crf.weights

            def worth(path):
                return crf.start[path[0]] + sum(crf.moves[a][b] for a, b in zip(path, path[1:])) + sum(v for v, s in zip(e, path) if s)

            every = [worth(p) for p in itertools.product((0, 1), repeat=len(e))]
            total += worth((label,) * len(e)) - np.logaddexp.reduce(every)
        return total

    steps = [likelihood(rules.train(samples, rounds=n)) for n in (1, 5, 20, 80)]
    assert steps == sorted(steps)


def test_labels_are_recovered(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    crf = rules.fit(docs, labels)
    found = {r["doc_id"]: r for r in rules.judge(docs, crf).collect()}
    assert len(found) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, r in found.items():
        if len(texts[i]) < 20000:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(texts[i])
    judged = [(r["quality"], found[r["doc_id"]]) for r in labels.collect() if not found[r["doc_id"]]["base_failed"]]
    assert np.mean([f["kept"] == (q == 1) for q, f in judged]) > 0.95


def test_edges(spark):
    docs, labels = documents(spark), spark.createDataFrame([(4, 1), (5, None), (None, 0), (5, 0)], "doc_id long, quality int")
    crf = rules.fit(docs, labels)
    found = rules.judge(docs, crf).collect()
    assert len(found) == docs.count()
    for r in found:
        if r["doc_id"] in (None, 0, 1):
            assert (r["n_words"], r["kept"], r["base_failed"], r["content_share"]) == (0, False, True, 0.0)
    assert sum(r["n_words"] > 20000 for r in found) == 2
    untaught = rules.fit(docs, labels.where("false"))
    assert all(r["content_share"] in (0.0, 1.0) for r in rules.judge(docs, untaught).collect())
    kept = rules.keep_content(docs, untaught)
    assert kept.columns == docs.columns
    assert rules.judge(nothing(spark), crf).count() == 0 and rules.keep_content(nothing(spark), crf).count() == 0


def labelled(part):
    """(quality, text) of every fifth labelled document, or of the others."""
    texts = {i: t or "" for i, t in zip(*(pq.read_table("/root/testdata/sf0.01/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")))}
    rows = zip(*(pq.read_table("/root/testdata/sf0.01/labels.parquet").column(c).to_pylist() for c in ("doc_id", "quality")))
    return [(q, texts[i]) for i, q in rows if (i % 5 == 0) == (part == "held out")]


def learnt():
    made = [(q, *rules.line_features(t)) for q, t in labelled("learn")]
    return rules.learn([(q, np.array(x), np.array(n, float)) for q, x, n in made if x])


def test_lines_are_labelled():
    """Texts made of a good and a bad document get the good one's share; documents may be part content, part boilerplate."""
    crf, held = learnt(), [(q, t) for q, t in labelled("held out") if len(t.split()) >= 10]
    kept = {c: np.mean([rules.content_shares(crf, [t])[0] >= rules.MIN_CONTENT for q, t in held if q == c]) for c in (0, 1)}
    assert kept[1] > 0.98 and kept[0] < 0.1
    good, bad = ([t for q, t in held if q == c] for c in (1, 0))
    misses = []
    for k in range(60):
        two = (good[k % len(good)], bad[k % len(bad)])
        share = len(two[0].split()) / sum(len(t.split()) for t in two)
        misses.append(abs(rules.content_shares(crf, ["\n".join(two if k % 2 else two[::-1])])[0] - share))
    assert np.mean(misses) < 0.05
    shares = [rules.content_shares(crf, [t])[0] for _, t in labelled("learn") + labelled("held out")]
    assert sum(0 < s < 1 for s in shares) >= 5


def test_states_of_lines_are_latent():
    """A boilerplate line inside good documents, and a content line inside bad ones, are found."""
    plain = "The quick brown fox number {} jumps over the lazy dog and goes home."
    junk = "BUY!! NOW!! #{} $$$ *** click !!"
    good = ["\n".join([plain.format(k), plain.format(-k), *([junk.format(k)] if k % 4 == 0 else []), plain.format(2 * k)]) for k in range(80)]
    bad = ["\n".join([junk.format(k), junk.format(k + 1), *([plain.format(k)] if k % 4 == 0 else []), junk.format(-k), junk.format(3 * k)]) for k in range(80)]
    made = [(q, *rules.line_features(t)) for q, texts in ((1, good), (0, bad)) for t in texts]
    crf = rules.learn([(q, np.array(x), np.array(n, float)) for q, x, n in made])

    def states(text):
        return rules.decode(crf, (np.array(rules.line_features(text)[0]) @ crf.weights).tolist())

    assert states(good[4]) == [1, 1, 0, 1] and states(bad[4]) == [0, 0, 1, 0, 0] and states(good[1]) == [1, 1, 1]
