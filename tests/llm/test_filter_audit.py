import re
from itertools import permutations

from edges import documents, nothing

from refreshgate.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int, part string"


def plain_masks(rows):
    """part, failed letters and id of each row."""
    made = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 bool(set(text) & set("#$%&*|")), copy)
        made.append((lang or "", {f for f, x in zip("ABCDE", fails) if x}, doc_id))
    return made


def plain(rows, labels):
    good, toxic = ({d for d, *q in labels if q[k] == 1 and d is not None} for k in (0, 1))
    masks, out = plain_masks(rows), []
    for part in {p for p, _, _ in masks}:
        own = [(m, d) for p, m, d in masks if p == part]
        cells, shares = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                shares[f] += len(gone)
                earlier = sum(f in m and bool(m & set(order[:step - 1])) for m, _ in own)
                cells.append((part, "".join(order), step, len(left), len(gone), earlier, sum(m == {f} for m, _ in own),
                              sum(d in good for _, d in gone), sum(d in toxic for _, d in gone), f))
        out += [(*c[:-1], shares[c[-1]]) for c in cells]
    return sorted(out)


def test_against_every_order(spark):
    long = " ".join(f"w{k}" for k in range(250))
    texts = [long, long + " #", "A B", long, "same " * 250, "SAME " * 250 + "|", None, "", long.upper(), long.upper() + " *", long + " x", "é\u00a0 É" * 90]
    rows = [(k, texts[k % len(texts)], ["en", "de", None, ""][k % 4]) for k in range(40)] + [(3, texts[3], "en"), (0, long, "de"), (None, long, "en"), (None, None, "fr")]
    labels = [(k, k % 2, k % 3 == 0, "z") for k in range(0, 40, 2)] + [(4, 1, 1, "z"), (None, 1, 1, "z"), (5, None, None, "z"), (999, 1, 1, "z")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, part string").repartition(3)
    got = fa.audit(docs, spark.createDataFrame([(d, q, None if t is None else int(t), p) for d, q, t, p in labels], LABELS))
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)


def test_edges(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    none = spark.createDataFrame([], LABELS)
    assert sorted(map(tuple, fa.audit(docs, none).collect())) == plain(rows, [])
    assert fa.audit(nothing(spark), none).count() == 0


def test_intervals():
    """Every mask and order has exactly one step, the first filter that it fails."""
    orders = list(permutations(range(4)))
    assert [fa.lehmer_rank(o) for o in orders] == list(range(24))
    steps = {}
    for mask, step, first, after in fa.removal_intervals(4):
        for rank in range(first, after):
            assert (mask, rank) not in steps
            steps[mask, rank] = step
    assert steps == {(m, k): next(s for s, f in enumerate(o, 1) if m >> f & 1) for m in range(1, 16) for k, o in enumerate(orders)}
