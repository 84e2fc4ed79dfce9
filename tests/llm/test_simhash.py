import numpy as np
import pytest
import xxhash
from edges import documents, nothing

from refreshgate.llm import simhash
from refreshgate.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    marks = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return marks, group


def plain_classes(rows):
    marks, group = plain_groups(rows)
    return [(d, marks[i] - (1 << 64) * (marks[i] >> 63), min((e for (e, _), g in zip(rows, group) if g == group[i] and e is not None), default=None))
            for i, (d, _) in enumerate(rows)]


def test_against_brute_force(spark):
    base = [f"w{k}" for k in range(400)]
    rng = np.random.default_rng(1)
    rows = [(100 + k, " ".join(base[:200] + [f"x{k}"] * (k % 3))) for k in range(40)]
    rows += [(k, " ".join(rng.choice(base, 60))) for k in range(60)] + [(500, None), (501, ""), (None, "Alpha beta"), (502, "alpha BETA")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.classes(docs).collect()), key=repr) == sorted(plain_classes(rows), key=repr)


def test_edges(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, simhash.classes(docs).collect()), key=repr) == sorted(plain_classes(rows), key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = plain_classes(rows)
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(plain_groups(rows)[1])) and set(ids) == {c for _, _, c in want}
    assert simhash.classes(nothing(spark)).count() == 0 and simhash.keep_one(nothing(spark)).count() == 0


@pytest.mark.parametrize("spread", [0xFFFFFF, 0xFF0F33, 0x3F])
@pytest.mark.parametrize("lookup", [False, True])
def test_spanning_links(spread, lookup, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 0 if lookup else 4096)
    rng = np.random.default_rng(spread)
    fps = np.unique(np.uint64(rng.integers(0, 2 ** 63)) ^ (rng.integers(0, 2 ** 24, 300).astype(np.uint64) & np.uint64(spread)))
    rng.shuffle(fps)

    def grouped(pairs):
        group = list(range(len(fps)))
        for i, j in pairs:
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
        return {frozenset(k for k, g in enumerate(group) if g == x) for x in group}

    near = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    links = simhash.spanning_links(fps)
    assert grouped(links) == grouped(near) and len(links) < len(fps)


def test_every_near_pair_meets_in_a_list():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = int(rng.integers(0, 2 ** 63))
        b = a ^ sum(1 << int(x) for x in rng.choice(64, 3, replace=False))
        lists, fps = simhash.postings(np.array([a, b], np.uint64))
        assert set(lists[fps == a]) & set(lists[fps == b])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 150) if k != 70] + [(5, 5), (3, 2)], "a long, b long")
    found = dict(map(tuple, components(edges).collect()))
    assert found == {k: 0 if k <= 70 else 71 for k in range(151)}
    assert components(edges.where("a < 0")).count() == 0


def test_the_count_drops_pairs():
    """Pairs that meet by four bytes and share no fifth are dropped by their tally, before their bits are looked at."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2 ** 63, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([base ^ (rng.integers(0, 2 ** 32, 40).astype(np.uint64)) for _ in range(6)]))
    lists, members = simhash.postings(fps)
    order = np.argsort(lists, kind="stable")
    groups = np.split(members[order], np.flatnonzero(np.diff(lists[order])) + 1)
    met = {(int(a), int(b)) for g in groups if len(g) > 1 for a in g for b in g if a < b}
    tally = {p: sum((p[0] >> 8 * k & 255) == (p[1] >> 8 * k & 255) for k in range(8)) for p in met}
    assert min(tally.values()) == 4 and sum(t < simhash.min_matches(3) for t in tally.values()) > 0.5 * len(tally)
    ends = np.array(sorted(met), np.uint64)
    assert simhash.near(ends[:, 0], ends[:, 1]).tolist() == [(a ^ b).bit_count() <= 3 for a, b in sorted(met)]
