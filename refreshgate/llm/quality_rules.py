"""Quality rules: counts over words and lines, and a linear-chain CRF that tells content lines from boilerplate.

Each line of a text is an observation with features in 0..1; the CRF has two states. Viterbi decoding labels the lines
of a text together, and the share of words in content lines decides whether the text stays.

Labels are of whole documents, the states of their lines are not known. Training begins with every line labelled as its
document, on documents alone and on a good and a bad one joined, so that the state has to change within a sequence. Then
every line is judged by its own features, and where the share of content in a document agrees with its label, these
states are what the next round learns from: content lines inside bad documents, boilerplate inside good ones.
"""
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from refreshgate.llm.batches import id_and_text, map_batches, text_slices
from refreshgate.session import cut_lineage

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CONTENT = 0.5
FEATURES = ("bias", "symbols", "bars", "exclamations", "capitals", "echoes", "repeats", "digits", "duplicate", "short",
            "unfinished")


@dataclass
class LineCrf:
    """State 1 is content. weights: of each feature for content; start and moves: of the first state and each step."""
    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that stand in the text twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    count, covered, end = Counter(windows), 0, 0
    for place, window in enumerate(windows):
        if count[window] > 1:
            covered += place + WINDOW - max(place, end)
            end = place + WINDOW
    return covered


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII blanks only
    seen: set[bytes] = set()
    n_dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n_dup += 1
        elif line.strip():
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), n_dup, repeated_words(words))


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def line_features(text: str) -> tuple[list[list[float]], list[int]]:
    """Features and word count of every line that has a word."""
    rows, sizes, seen = [], [], set()
    for line in text.encode().split(b"\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        rows.append([
            1.0, min(1.0, 2 * sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">"))) / n), min(1.0, 2 * line.count(b"|") / n),
            min(1.0, line.count(b"!") / n), sum(map(bytes.isupper, words)) / n, sum(map(eq, words, words[1:])) / n,
            1 - len(set(words)) / n, min(1.0, sum(map(bytes.isdigit, words)) * 2 / n), float(line in seen), float(n < 4),
            float(words[-1][-1:] not in b".!?:;\"')")])
        sizes.append(n)
        seen.add(line)
    return rows, sizes


def training_lines(docs: DataFrame, labels: DataFrame, max_docs: int, max_lines: int) -> list[tuple[int, np.ndarray]]:
    """(quality, rows of features and number of words of all lines) of a sample of labelled documents.

    Ids are chosen by their hash; a row that repeats an id and its text counts once. Of the rows, `max_docs` by a hash of
    id and text, whatever their label; of each label, whole texts in that order until they have half of `max_lines` lines.
    A text of more lines than that half is passed over, so the sample has at most 2 * `max_lines`.
    """
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.col("quality").cast("int")).alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                made = [[[*row, n] for row, n in zip(*line_features(t or ""))] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "mark", "quality")), pa.array([len(x) for x in made], pa.int64()),
                     pa.array([np.asarray(x, np.float32).tobytes() for x in made], pa.binary())],
                    ["doc_id", "mark", "quality", "n", "features"])

    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("mark"), "quality", "text")
    made = map_batches(rows, run, "doc_id long, mark long, quality int, n long, features binary").dropDuplicates(["doc_id", "mark"])
    order = [F.xxhash64("doc_id", "mark"), F.col("doc_id"), F.col("mark")]
    made = cut_lineage(made.orderBy(*order).limit(max_docs))
    chosen_rows, before = [], {}
    for r in made.select("doc_id", "mark", "quality", "n").orderBy(*order).collect():  # at most max_docs short rows
        if before.get(r["quality"], 0) < max_lines / 2 and r["n"] <= max_lines / 2:
            before[r["quality"]] = before.get(r["quality"], 0) + r["n"]
            chosen_rows.append((r["doc_id"], r["mark"]))
    fit_in = made.sparkSession.createDataFrame(chosen_rows, "doc_id long, mark long")
    taken = made.join(F.broadcast(fit_in), ["doc_id", "mark"]).select("quality", "features").orderBy("quality", "features").collect()
    return [(r["quality"], np.frombuffer(r["features"], np.float32).reshape(-1, len(FEATURES) + 1).astype(float)) for r in taken]


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_lines: int = 200_000) -> LineCrf:
    """Learn from all lines of at most `max_docs` labelled documents.

    Documents are whole; there are fewer where they have more than `max_lines` lines together. Both bounds are of the
    training sample alone; every line of every text is decoded. Without labelled lines, the CRF calls every line content.
    """
    return learn([(q, x[:, :-1], x[:, -1]) for q, x in training_lines(docs, labels, max_docs, max_lines) if len(x)])


def learn(documents: list[tuple[int, np.ndarray, np.ndarray]], passes: int = 3) -> LineCrf:
    """A CRF from (quality, features of the lines, words of the lines) of documents whose lines bear no labels."""
    states = [np.full(len(x), int(q == 1)) for q, x, _ in documents]
    crf = train([])
    for _ in range(passes):
        crf = train(_joined(documents, states))
        for k, (q, x, n_words) in enumerate(documents):
            found = (x @ crf.weights >= 0).astype(int)  # line by line: the steps between states are still those of the labels
            if ((found @ n_words >= MIN_CONTENT * n_words.sum()) == (q == 1)):
                states[k] = found
    return crf


def _joined(documents: list[tuple[int, np.ndarray, np.ndarray]], states: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every document as a sequence, and pairs of a good and a bad one, in turns the one or the other first."""
    alone = [(s, x) for s, (_, x, _) in zip(states, documents)]
    order = np.random.default_rng(0).permutation(len(documents))
    good, bad = ([alone[k] for k in order if (documents[k][0] == 1) == is_good] for is_good in (True, False))
    pairs = []
    for k in range(max(len(good), len(bad)) if good and bad else 0):
        two = (good[k % len(good)], bad[k % len(bad)])
        pairs.append(tuple(np.concatenate(c) for c in zip(*(two if k % 2 else two[::-1]))))
    return alone + pairs


def train(samples: list[tuple[int | np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.3, shrink: float = 0.02) -> LineCrf:
    """Gradient ascent on the shrunken conditional log-likelihood of sequences (states, features), all in step.

    The states are one number for all lines, or one for each. Sequences count the same, but for those of one state
    throughout, of which both states count the same.
    """
    weights, start, moves = np.zeros(len(FEATURES)), np.zeros(2), np.zeros((2, 2))
    weights[0] = 0.5
    if not samples:
        return LineCrf(weights, start, moves)
    samples = sorted(samples, key=lambda s: -len(s[1]))
    size = np.array([len(x) for _, x in samples])
    n, longest = len(size), int(size[0])
    states = [np.broadcast_to(np.asarray(s) == 1, len(rows)).astype(int) for s, rows in samples]
    kind = np.array([int(s[0]) if (s == s[0]).all() else 2 for s in states])
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]  # sequences longer than t
    first = np.concatenate(([0], np.cumsum(live)))  # where the lines of each step begin: those of a step stand together
    x, owner = np.zeros((first[-1], len(FEATURES))), np.concatenate([np.arange(k) for k in live])
    label = np.zeros(first[-1], int)
    for i, (_, rows) in enumerate(samples):
        x[first[:len(rows)] + i] = rows
        label[first[:len(rows)] + i] = states[i]
    later = np.arange(n, first[-1])  # lines with one before them
    previous = later - np.repeat(live[:-1], live[1:]) if longest > 1 else later
    mixed = (kind == 2).mean()
    share = np.array([*((1 - mixed) * 0.5 / max(1, (kind == c).sum()) for c in (0, 1)), 1 / n])[kind] / size
    speed = [np.zeros_like(p) for p in (weights, start, moves)]
    for _ in range(rounds):
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ weights
        ahead, back = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        ahead[:n] = start + emit[:n]
        for t in range(1, longest):
            k, at, to = live[t], first[t], first[t - 1]
            ahead[at:at + k] = emit[at:at + k] + np.logaddexp(ahead[to:to + k, :1] + moves[0], ahead[to:to + k, 1:] + moves[1])
        for t in range(longest - 2, -1, -1):
            k, at = live[t + 1], first[t]
            to = emit[first[t + 1]:first[t + 2]] + back[first[t + 1]:first[t + 2]]
            back[at:at + k] = np.logaddexp(moves[:, 0] + to[:, :1], moves[:, 1] + to[:, 1:])
        last = first[size - 1] + np.arange(n)
        total = np.logaddexp(ahead[last, 0], ahead[last, 1])[owner]
        miss = (label - np.exp(ahead[:, 1] + back[:, 1] - total)) * share[owner]
        grad_w, grad_s, grad_m = miss @ x, np.array([-miss[:n].sum(), miss[:n].sum()]), np.zeros((2, 2))
        to, own = emit[later] + back[later], owner[later]
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(ahead[previous, a] + moves[a, b] + to[:, b] - total[later])
                grad_m[a, b] = (((label[previous] == a) & (label[later] == b)) - p) @ share[own]
        for p, g, v in zip((weights, start, moves), (grad_w, grad_s, grad_m), speed):
            v *= 0.9
            v += g - shrink * 0.1 * p
            p += rate * v
    return LineCrf(weights, start, moves)


def decode(crf: LineCrf, emission: list[float]) -> list[int]:
    """The likeliest states (Viterbi); ties go to content."""
    (stay0, to1), (to0, stay1) = crf.moves.tolist()
    bad, good = crf.start.tolist()
    back = []
    for t, e in enumerate(emission):
        if t:
            from_good_bad, from_good = good + to0 > bad + stay0, good + stay1 >= bad + to1
            bad, good = (good + to0 if from_good_bad else bad + stay0), (good + stay1 if from_good else bad + to1)
            back.append((int(from_good_bad), int(from_good)))
        good += e
    state = int(good >= bad)
    states = [state]
    for step in reversed(back):
        state = step[state]
        states.append(state)
    return states[::-1]


def content_shares(crf: LineCrf, texts: list[str]) -> list[float]:
    """Share of each text's words in lines decoded as content; 0 without words."""
    made = [line_features(t) for t in texts]
    flat = [row for rows, _ in made for row in rows]
    scores = (np.array(flat) @ crf.weights).tolist() if flat else []
    shares, at = [], 0
    for rows, sizes in made:
        states = decode(crf, scores[at:at + len(rows)]) if rows else []
        at += len(rows)
        shares.append(sum(n for n, s in zip(sizes, states) if s) / sum(sizes) if sizes else 0.0)
    return shares


def _judged(crf: LineCrf, batches: Iterator[pa.RecordBatch], min_content: float):
    for batch in batches:
        for part in text_slices(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            base = [base_counts(t) for t in texts]
            failed = [base_fails(b[0], b[4]) for b in base]
            shares = content_shares(crf, texts)
            yield part, base, failed, shares, [not f and s >= min_content for f, s in zip(failed, shares)]


def judge(docs: DataFrame, crf: LineCrf, min_content: float = MIN_CONTENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept of every row.

    A NULL or empty text has no words: all counts are 0 and it fails. Repeated rows are judged each; extra columns are
    not read. The whole text counts, however long.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for part, base, failed, shares, kept in _judged(crf, batches, min_content):
            counts = np.array(base, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(names))), pa.array(failed, pa.bool_()),
                 pa.array(shares, pa.float64()), pa.array(kept, pa.bool_())],
                ["doc_id", *names, "base_failed", "content_share", "kept"])

    return map_batches(id_and_text(docs), run, "doc_id long, " + ", ".join(f"{n} long" for n in names)
                       + ", base_failed boolean, content_share double, kept boolean")


def keep_content(docs: DataFrame, crf: LineCrf, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of `docs`, unchanged, that `judge` keeps."""
    def run(batches):
        for part, _, _, _, kept in _judged(crf, batches, min_content):
            yield part.filter(pa.array(kept, pa.bool_()))

    return map_batches(docs, run, docs.schema)
