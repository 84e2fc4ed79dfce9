import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from edges import documents, nothing
from tokenizers import Tokenizer

from refreshgate.llm import packing
from refreshgate.llm.tokens import Encoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def laid_out(runs):
    bins = defaultdict(list)
    for length, own in runs.items():
        for a, b, first, each, offset in own:
            for k in range(b - a):
                bins[first + k // each].append((offset + k % each * length, length))
    return bins


def first_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        for k, left in enumerate(room):
            if left >= n:
                room[k] -= n
                break
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
@pytest.mark.parametrize("seed", range(8))
def test_plan(capacity, seed):
    rng = random.Random(seed)
    counts = {n: rng.choice([0, 1, 2, 5, 40]) for n in rng.sample(range(1, capacity + 1), min(capacity, rng.choice([3, 20, 60])))}
    runs = packing.plan(counts, capacity)
    bins = laid_out(runs)
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2
    for length, n in counts.items():
        covered = sorted((a, b) for a, b, *_ in runs.get(length, []))
        assert [a for a, _ in covered] + [n] == [0] * (n > 0) + [b for _, b in covered] if n else not covered
    lengths = [n for n, k in counts.items() for _ in range(k)]
    assert len(bins) <= first_fit(lengths, capacity) + 1


@pytest.mark.parametrize("n, pieces", [(5, [5]), (8, [8]), (9, [1, 8]), (16, [8, 8]), (19, [3, 8, 8])])
def test_cut(n, pieces):
    assert [length for _, length in packing.cut(n, 8)] == pieces


def test_encoder_is_the_tokenizer():
    texts = ["", " ", "a  b", "x \n y", " lead", "trail ", "it's 'tis 3,4", "é  b", "<|endoftext|> a", "a\x1c b", "w" * 200 + " ww,", "ab. ab! ab."]
    plain = Tokenizer.from_file(PATH)
    for _ in range(2):
        assert [x.tolist() for x in encoder(PATH).encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_lines_and_words_are_encoded_apart():
    texts = ["one two.\nThree, four\nfive\n\nsix\r\nseven 8\n9", "\n", "\na\n", "a\n b", "é\u00a0b à\nà ü\u00a0 \u00a0", "x\u2028y z\x1c\nw", ".\n. ,\n!"]
    plain, own = Tokenizer.from_file(PATH), Encoder(PATH)
    for some in (texts, texts[::-1], ["", *texts, "a\n<|endoftext|> b"], []):
        assert [x.tolist() for x in own.encode(some)] == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]


def test_words_at_line_breaks_are_learned_once():
    words = ["".join(random.Random(k).choices("abcdefgh", k=6)) for k in range(40)]
    own = Encoder(PATH)
    own.encode([" ".join(words), "\n".join(words[:1] + words)])
    before = len(own.known)
    own.encode([f"x {a}\n{b}" for a in words for b in words])
    assert len(own.known) <= before + 1


def test_pack(spark):
    docs = documents(spark)
    rows = packing.pack(docs, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted(((r["doc_id"], plain.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()), key=repr)
    whole = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        whole[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, ids in want:
        if [d for d, _ in want].count(doc) == 1:
            parts = sorted(whole[doc])
            assert [p[1] for p in parts] == np.cumsum([0] + [len(p[2]) for p in parts])[:-1].tolist()
            assert [x for p in parts for x in p[2]] == ids
    assert sum(len(p[2]) for own in whole.values() for p in own) == sum(len(ids) for _, ids in want)
    assert len(bins) <= first_fit([r["length"] for r in rows], 2048)
    assert packing.pack(nothing(spark), PATH, keep_ids=False).count() == 0
