import re

from edges import documents, nothing

from refreshgate.llm import license_scan as scan


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts = {t.label: [] for t in scan.TEMPLATES}
    score = 0.0
    for t in scan.TEMPLATES:
        for s in range(-len(t.words), len(words)):
            if all(s + at >= 0 and tuple(words[s + at:s + at + len(p)]) == p for at, p in t.phrases):
                starts[t.label].append(s)
                same = sum(0 <= s + k < len(words) and words[s + k] == w for k, w in enumerate(t.words))
                score = max(score, same / len(t.words))
    base = sorted(s for t in scan.TEMPLATES if t.base for s in starts[t.label])
    named = [sorted({t.label for t in scan.TEMPLATES if starts[t.label] and (t.base or every)}) for every in (False, True)]
    return (len(words), len(base), base[0] if base else None, base[-1] if base else None, *map(",".join, named), score)


TEXTS = ["MIT License mit license", "License", "the gnu general public license, VERSION 3!", "General Public License version 3",
         "cc by", "cc-by-nc 4.0", "CC BY-SA", "by cc", "apache licence", "Licensed under the Apache License, Version 2.0.",
         "All rights reserved. all rights", "permission is hereby granted, free of charge, to any person obtaining a copy of this software",
         "permission is hereby granted to nobody", "é cc by é", "gnu gnu general public license license", "mit\x00license", "mitélicense",
         "redistribution and use in source and binary forms, with or without modification, are permitted"]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = sorted(map(tuple, scan.scan(docs).collect()))
    assert found == [(i, *brute(t)) for i, t in enumerate(TEXTS)]


def test_edges(spark):
    docs = documents(spark)
    found = sorted(map(tuple, scan.scan(docs).collect()), key=repr)
    assert found == sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=repr)
    assert scan.scan(nothing(spark)).count() == 0


def test_plan_has_no_python(spark):
    plan = scan.scan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan.split("Repartition")[0][:200]
