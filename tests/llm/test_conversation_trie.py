import random
import zlib
from hashlib import sha256

import pytest

from refreshgate.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, parent_conv_id long, key string"


def plain_trie(convs):
    """Nodes of {conv_id: [(role, text), ...]}, each with all of its members and all nodes under it."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = dict.fromkeys(members, 0)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, own in members.items():
        cost = (len(own) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += cost
    out = []
    for path, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(path))))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), children[path], leaves[path], saved[path],
                    sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))

    def place(t):
        turn, role, text = t
        return turn is not None, turn or 0, sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()

    return {c: [(r, x) for _, r, x in sorted(own, key=place)] for c, own in convs.items()}


def plain_family(rows):
    convs = ordered(rows)
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    return {c: convs.get(c - c % 5, [])[:h[c]] + own[h[c]:] for c, own in convs.items()}


def made(seed, n=60, words=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), n):
        for turn in range(rng.choice([1, 2, 3, longest])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long text"][:words])))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA).repartition(parts)


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width, block, seed", [(64, 4096, 1), (2, 4096, 2), (3, 5, 3), (1, 2, 4)])
def test_against_all_prefixes(spark, width, block, seed):
    rows = made(seed, longest=7 + 5 * (seed % 3)) + [(900 + k, t, "user", "same") for k in range(30) for t in range(4 + 4 * (k % 2))]
    given = frame(spark, rows)
    assert nodes(ct.prefix_trie(given, width, block)) == plain_trie(ordered(rows))
    assert nodes(ct.family_trie(given, width, block)) == plain_trie(plain_family(rows))


def test_one_conversation_holds_most_turns(spark):
    rows = made(7) + [(c, t, "user", f"t{t % 11}") for c in (500, 501, 505) for t in range(300 if c != 505 else 200)]
    given = frame(spark, rows, 8)
    got = nodes(ct.prefix_trie(given))
    want = plain_trie(ordered(rows))
    assert got == want
    assert nodes(ct.family_trie(given)) == plain_trie(plain_family(rows))


def test_edges(spark):
    rows = [(0, None, "user", "first"), (0, 0, None, None), (0, 0, None, None), (0, 0, "z", ""), (0, -4, "é", "漢字"), (None, 0, "user", "nobody"),
            (3, 5, "", ""), (3, 5, "", ""), (3, None, None, None), (7, 1, "1:u", "ser"), (8, 1, "1", ":user"), (-3, 1, "user", "x"), (-5, 1, "user", "y" * 100_000)]
    given = frame(spark, rows)
    assert nodes(ct.prefix_trie(given)) == plain_trie(ordered(rows))
    got = ct.family_trie(given)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    base = {c: int(c / 5) * 5 for c in (0, 3, 7, 8, -3, -5)}  # % takes the sign of the id
    convs = ordered(rows)
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    assert nodes(got) == plain_trie({c: convs.get(base[c], [])[:h[c]] + own[h[c]:] for c, own in convs.items()})
    assert ct.family_trie(given.where("conv_id < -100")).count() == 0
    assert nodes(ct.prefix_trie(frame(spark, [(4, 1, "user", "x")]))) == plain_trie({4: [("user", "x")]})
