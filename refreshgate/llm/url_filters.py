"""URL filters: allow and block entries in one trie over reversed host labels and path segments; the longest match decides.

An entry is a host and the beginning of a path, like `example.net/en/`. Its host labels lead down the trie from the right,
then the whole segments of its path; the rest after the path's last slash hangs at the node reached. A URL walks the trie
once along its host, and along its path below each host that has entries.

The trie is broadcast, so its entries have a bound in bytes. Beyond it, `match_by_join` gives the same answer: every URL
looks up its host suffixes and path stems, no more than it has labels and segments, by an equi join.
"""
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from refreshgate.llm.batches import map_batches

ALLOW, BLOCK = "allow", "block"
MAX_TRIE_BYTES = 16 << 20  # of entry text; a trie takes a small multiple of it in every worker
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`verdict` for `host` and its subdomains where the URL's path starts with `path`, which begins with a slash."""
    verdict: str
    host: str
    path: str

    def __post_init__(self):
        if self.verdict not in (ALLOW, BLOCK) or not self.path.startswith("/") or not self.host:
            raise ValueError(f"not a rule: {self}")

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, entry: str) -> Rule:
    """An entry as text: the host up to the first slash, then the path; without a slash, the whole host."""
    host, slash, path = entry.partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), f"/{path}" if slash else "/")


def precedence(own: Rule) -> tuple:
    """Longer entries first, then longer hosts; of one entry in both lists, the block."""
    return len(own.text), len(own.host), own.verdict == BLOCK


@dataclass
class Trie:
    """Flat: `steps` leads from (node, mark + label) to a node; `ends` has the entries at a node as (rest, precedence, rule)."""
    steps: dict[tuple[int, str], int] = field(default_factory=dict)
    ends: dict[int, list[tuple[str, tuple, Rule]]] = field(default_factory=dict)
    roots: set[int] = field(default_factory=set)  # host nodes with paths below

    def _step(self, node: int, label: str) -> int:
        return self.steps.setdefault((node, label), len(self.steps) + 1)

    def add(self, own: Rule) -> None:
        node = 0
        for label in reversed(own.host.split(".")):
            node = self._step(node, f".{label}")
        self.roots.add(node)
        *whole, rest = own.path[1:].split("/")
        for segment in whole:
            node = self._step(node, f"/{segment}")
        self.ends.setdefault(node, []).append((rest, precedence(own), own))

    def longest(self, host: str, path: str) -> Rule | None:
        """The entry that decides for a URL, or None."""
        best, place, node = None, (-1,), 0
        if not path.startswith("/"):
            return None  # every entry's path begins with a slash
        segments = path[1:].split("/")
        for label in reversed(host.split(".")):
            node = self.steps.get((node, f".{label}"))
            if node is None:
                break
            if node in self.roots:
                at = node
                for segment in segments:
                    for rest, rank, own in self.ends.get(at, ()):
                        if rank > place and segment.startswith(rest):
                            best, place = own, rank
                    at = self.steps.get((at, f"/{segment}"))
                    if at is None:
                        break
        return best


def build(rules: list[Rule]) -> Trie:
    trie = Trie()
    for own in rules:
        trie.add(own)
    return trie


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end.

    Both are empty for NULL and for a URL without `://`.
    """
    text = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(text, "://") > 0, F.substr(text, F.instr(text, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _split(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))


def match_by_trie(pages: DataFrame, rules: list[Rule], default: str = ALLOW) -> DataFrame:
    """`judge` by the broadcast trie, for entries of up to MAX_TRIE_BYTES."""
    shared = pages.sparkSession.sparkContext.broadcast(build(rules))

    def run(batches):
        trie = shared.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [trie.longest(h, p) for h, p in zip(hosts, paths)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([None if r is None else r.text for r in found], pa.string()),
                 pa.array([default if r is None else r.verdict for r in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])

    return map_batches(_split(pages), run, "page_id long, host string, path string, rule string, verdict string")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


def match_by_join(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """`judge` for any number of entries (verdict, host, path).

    Of every distinct host and path, the (host suffix, path stem) keys are looked up; a stem is the path up to and with
    one of its slashes, and an entry lies under the stem that ends with its last slash. One entry per key and rest
    remains, so a key meets no more entries than differ behind the slash.
    """
    own = _split(pages)
    return own.join(_best_entries(own, rules), ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _best_entries(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, best (rule, verdict) of every distinct host and path of `urls` that an entry fits."""
    keys = urls.select("host", "path").where(F.col("path").startswith("/")).distinct()
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    stems = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    asked = keys.select("host", "path", F.explode(suffixes).alias("suffix")).select("*", F.explode(stems).alias("stem"))
    entries = rules.groupBy(F.col("host").alias("suffix"), F.col("path").alias("begins")).agg(
        F.max("verdict").alias("verdict")).withColumn("stem", F.regexp_extract("begins", r"(?s)^.*/", 0))
    hits = asked.join(entries, ["suffix", "stem"]).where(F.expr("startswith(path, begins)"))
    return hits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("suffix") + F.length("begins")).alias("n"), F.length("suffix").alias("h"),
        F.concat("suffix", "begins").alias("rule"), "verdict")).alias("best"))


def judge(pages: DataFrame, rules: list[Rule], default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages` (page_id, url).

    The longest entry that fits decides, `default` where none does. A NULL url, or one without `://`, has an empty host
    and path and fits no entry, and neither does an empty path, since entries' paths begin with a slash. Of entries of
    one length, that with the longer host decides; of one entry in both lists, the block. Repeated rows are judged
    each; other columns are not read; an empty table gives none.
    """
    if _fits_in_trie(rules):
        return match_by_trie(pages, rules, default)
    return match_by_join(pages, rule_table(pages.sparkSession, rules), default)


def _fits_in_trie(rules: list[Rule]) -> bool:
    return sum(len(r.text.encode()) for r in rules) <= MAX_TRIE_BYTES


def keep_allowed(pages: DataFrame, rules: list[Rule], default: str = ALLOW) -> DataFrame:
    """The rows of `pages`, unchanged, that `judge` does not block."""
    width = max(map(len, pages.columns), default=0)
    names = [f"{name}_of_url" + "_" * width for name in ("host", "path")]
    urls = pages.withColumns(dict(zip(names, host_and_path(F.col("url")))))
    if not _fits_in_trie(rules):
        best = _best_entries(urls.select(*(F.col(n).alias(k) for n, k in zip(names, ("host", "path")))),
                             rule_table(pages.sparkSession, rules))
        wrong = best.where(F.col("best.verdict") != default).select(*(F.col(k).alias(n) for n, k in zip(names, ("host", "path"))))
        return urls.join(wrong, names, "left_semi" if default == BLOCK else "left_anti").select(*pages.columns)
    shared = pages.sparkSession.sparkContext.broadcast(build(rules))

    def run(batches):
        trie = shared.value
        for batch in batches:
            found = [trie.longest(h, p) for h, p in zip(*(batch.column(n).to_pylist() for n in names))]
            kept = pa.array([(default if r is None else r.verdict) == ALLOW for r in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], batch.schema.names[:-2]).filter(kept)

    return map_batches(urls, run, pages.schema)


#: The entries of the registered query. Fixed values.
PAGE_RULES = [rule(BLOCK, "net/"), rule(ALLOW, "example.net/en/"), rule(BLOCK, "example.com/de/"), rule(ALLOW, "org/fr/")]


def oracle(rules: list[Rule], default: str = ALLOW) -> str:
    """DuckDB SQL that tries every entry on every URL."""
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    return f"""
WITH rules(verdict, host, path) AS (VALUES {values}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT s.page_id, s.host, s.path, r.rule, coalesce(r.verdict, '{default}') AS verdict
FROM split s LEFT JOIN LATERAL (
  SELECT r.host || r.path AS rule, r.verdict FROM rules r
  WHERE (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC LIMIT 1) r ON true"""
