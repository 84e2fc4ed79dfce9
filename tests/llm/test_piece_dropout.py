import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from edges import TEXTS, documents, nothing
from sentencepiece import SentencePieceProcessor

from refreshgate.llm import piece_dropout as pd_

PATH = public_tokenizers.path("piece_bpe_32k.model")
SAMPLES = [t or "" for t in TEXTS if len(t or "") < 5000] + ["  the  thing", "inter" * 30, "naïve café\tand\r\nmore", "▁ literal ▁▁", "a▁b"]


def slow(model, text, key, rate):
    """Merges by looking at every adjacent pair again and again."""
    if not text:
        return []
    chars = " " + text
    parts = [(int(model.of_char[ord(c)]), k, k + 1) for k, c in enumerate(chars)]
    skipped = set()
    while True:
        best = None
        for k in range(len(parts) - 1):
            (a, start, middle), (b, _, end) = parts[k], parts[k + 1]
            joined = int(model.merged(np.array([a]), np.array([b]))[0])
            if joined < 0 or (start, middle, end) in skipped:
                continue
            if best is None or (model.rank[joined], start) < best[0]:
                best = (model.rank[joined], start), k, joined, (start, middle, end)
        if best is None:
            break
        _, k, joined, place = best
        if pd_.dropped(np.array([key]), *(np.array([p]) for p in place), rate)[0]:
            skipped.add(place)
            continue
        parts[k:k + 2] = [(joined, place[0], place[2])]
    out = []
    for symbol, start, _ in parts:
        out += [symbol] if symbol >= 0 else [int(model.byte_ids[b]) for b in chars[start].encode()]
    return out


def test_without_dropout_it_is_the_library():
    model, library = pd_.pieces(PATH), SentencePieceProcessor(model_file=PATH)
    texts = [t for t in SAMPLES if "▁" not in t]
    found = pd_.encode(model, texts, pd_.document_keys(list(range(len(texts))), 1), 0.0)
    assert [f.tolist() for f in found] == library.encode(texts, num_threads=1)


@pytest.mark.parametrize("long_chunk", [0, 48, 10 ** 9])
@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_agenda_against_a_slow_loop(rate, long_chunk, monkeypatch):
    monkeypatch.setattr(pd_, "LONG_CHUNK", long_chunk)
    model = pd_.pieces(PATH)
    texts = [t for t in SAMPLES if len(t) < 200]
    keys = pd_.document_keys(list(range(len(texts))), 3)
    found = pd_.encode(model, texts, keys, rate)
    assert [f.tolist() for f in found] == [slow(model, t, k, rate) for t, k in zip(texts, keys)]


def test_pairs_are_looked_up_once_and_then_beside_each_merge(monkeypatch):
    model, looked, merged = pd_.pieces(PATH), [], pd_.Pieces.merged
    monkeypatch.setattr(pd_.Pieces, "merged", lambda self, left, right: looked.append(len(left)) or merged(self, left, right))
    texts = ["internationalization of characteristics " * 50]
    ids, = pd_.encode(model, texts, pd_.document_keys([1], 3), 0.1)
    chars = len(texts[0]) + 1
    assert sum(looked) <= chars + 2 * (chars - len(ids))


def test_lists_are_decoded_as_one_by_one():
    model = pd_.pieces(PATH)
    ids = [i.tolist() for i in pd_.encode(model, SAMPLES, pd_.document_keys([None] * len(SAMPLES), 1), 0.3)]
    ids += [[], [int(model.byte_ids[0xC3])] * 2, None]
    lists = pa.array([[1], *ids], pa.list_(pa.int32()))[1:]
    assert pd_.decode_all(model, lists).to_pylist() == [pd_.decode(model, i or []) for i in ids]
    assert pd_.decode_all(model, lists[:len(SAMPLES)]).to_pylist() == SAMPLES


def test_lossless_and_varied():
    model = pd_.pieces(PATH)
    seen = set()
    for seed in range(6):
        ids = pd_.encode(model, SAMPLES, pd_.document_keys([None] * len(SAMPLES), seed), 0.3)
        assert [pd_.decode(model, i.tolist()) for i in ids] == SAMPLES
        seen.add(tuple(map(tuple, ids)))
    assert len(seen) == 6


def test_edges(spark):
    docs = documents(spark)
    coded = pd_.encoded(docs, PATH, seed=17)
    rows = pd_.decoded(coded, PATH).collect()
    assert len(rows) == docs.count() and all(r["decoded"] == (r["text"] or "") for r in rows)
    again = {(r["doc_id"], r["text"]): r["ids"] for r in pd_.encoded(docs.repartition(7), PATH, seed=17).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["ids"] for r in rows)
    assert pd_.decoded(pd_.encoded(nothing(spark), PATH, seed=1), PATH).count() == 0
