import random

import pytest

from refreshgate.llm import url_filters as uf

RULES = [uf.rule(uf.BLOCK, "net/"), uf.rule(uf.ALLOW, "example.net/en/"), uf.rule(uf.BLOCK, "a.b/x/y"), uf.rule(uf.ALLOW, "b/x/"), uf.rule(uf.BLOCK, "b"),
         uf.rule(uf.ALLOW, "b/x/yz/"), uf.rule(uf.BLOCK, "c/t"), uf.rule(uf.ALLOW, "c/t"), uf.rule(uf.ALLOW, "q.c/"), uf.rule(uf.BLOCK, "c/t//")]


def plain(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    place = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = "".join(c.lower() if c in uf.UPPER else c for c in rest[:place]), rest[place:]
    path = path[:next((k for k, c in enumerate(path) if c in "?#"), len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


def urls():
    rng = random.Random(3)
    made = [None, "", "no scheme", "://", "http://", "http://NET", "http://net/", "HTTP://Example.NET/en/1?x=/de/#t", "http://xnet/", "http://.net/a",
            "http://net./a", "http://net:80/", "http://a.b/x/y", "http://a.b/x/yz/", "http://a.b/x/yz", "http://c/t", "http://c/t//", "http://q.c/tt",
            "http://É.net/\n/x", "a://b://c/x", "http://net?/en/", "http://net#/", "http://b/x\n/y", "x" * 5000 + "://b/" + "x/" * 300]
    for _ in range(300):
        host = ".".join(rng.choice(["a", "b", "net", "example", "c", "q", ""]) for _ in range(rng.randint(1, 4)))
        made.append(f"http://{host}/" + "/".join(rng.choice(["x", "y", "yz", "en", "t", ""]) for _ in range(rng.randint(0, 4))))
    return made


def pages(spark):
    rows = [(k, u, "h", "r") for k, u in enumerate(urls())] + [(None, "http://net/", None, None), (0, "http://b/x/", "h", "r"), (0, "http://b/x/", "h", "r")]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3)


@pytest.mark.parametrize("default", [uf.ALLOW, uf.BLOCK])
@pytest.mark.parametrize("bound", [uf.MAX_TRIE_BYTES, 0])
def test_against_every_rule_on_every_url(spark, default, bound, monkeypatch):
    monkeypatch.setattr(uf, "MAX_TRIE_BYTES", bound)
    given = pages(spark)
    rows = given.collect()
    want = [(r["page_id"], *plain(r["url"], RULES, default)) for r in rows]
    got = uf.judge(given, RULES, default)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    kept = uf.keep_allowed(given, RULES, default)
    assert kept.schema == given.schema
    assert sorted(kept.collect(), key=repr) == sorted((r for r, w in zip(rows, want) if w[-1] == uf.ALLOW), key=repr)


def test_nothing(spark):
    none = pages(spark).where("page_id < 0")
    assert uf.judge(none, RULES).count() == 0 and uf.keep_allowed(none, RULES).count() == 0
    assert {r["verdict"] for r in uf.judge(pages(spark), []).collect()} == {uf.ALLOW}


def test_rules():
    assert uf.rule(uf.BLOCK, "A.net") == uf.Rule(uf.BLOCK, "a.net", "/")
    with pytest.raises(ValueError):
        uf.rule("maybe", "a.net/")
    with pytest.raises(ValueError):
        uf.rule(uf.BLOCK, "/x")
