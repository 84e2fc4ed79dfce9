"""SentencePiece merges with seeded dropout, and their lossless decoding.

A merge-type model joins, again and again, the adjacent pair whose piece ranks best, the leftmost of equals. With
dropout a candidate (two adjacent symbols, by where they begin and end) is skipped for good if a hash keyed by the seed,
the document's id and the candidate falls below the rate, so a document's segmentation varies with the seed but is
always the same for one seed, on any machine and in any batch.

No piece has a blank after another character, so each run of blanks and what follows it up to the next blank is merged
by itself. The agendas of all such chunks of a batch are processed together, one merge of each chunk a round, after which
only the two pairs beside the merged symbol are judged anew; chunks longer than LONG_CHUNK have an agenda (a heap) of
their own.
"""
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from refreshgate.llm.batches import map_batches, text_slices

BLANK = "▁"
SLICE = 1 << 20
LONG_CHUNK = 48
NO_RANK = np.int64(1) << 40
NO_PAIR = np.iinfo(np.int64).max
UNKNOWN = -1
#: Odd constants of a 64-bit mixing function. Fixed values.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h):
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def _places(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """What the hashes of all candidates that begin at `start` have in common."""
    with np.errstate(over="ignore"):
        return _mixed(key + start.astype(np.uint64) * MIX[0])


def _dropped_at(place: np.ndarray, first: np.ndarray, whole: np.ndarray, rate: float) -> np.ndarray:
    """Whether candidates are skipped, by their place and the characters in their first symbol and in both."""
    if rate <= 0:
        return np.zeros(len(place), bool)
    with np.errstate(over="ignore"):
        hashed = _mixed(place + first.astype(np.uint64) * MIX[1] + whole.astype(np.uint64) * MIX[2])
    return (hashed >> np.uint64(11)) < np.uint64(math.ceil(rate * 2.0 ** 53))


def dropped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidates joining [start, middle) and [middle, end) are skipped."""
    return _dropped_at(_places(key, start), middle - start, end - start, rate)


def document_keys(ids: list, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        own = np.array([0 if i is None else (i * 2 + 1) & (2 ** 64 - 1) for i in ids], np.uint64)
        return _mixed(own * MIX[0] + _mixed(np.array([seed & (2 ** 64 - 1)], np.uint64)))


@dataclass
class Pieces:
    """The model's tables: symbols of single characters, and the merged symbol and its rank of each pair that has one."""
    of_char: np.ndarray
    pair_keys: np.ndarray
    pair_symbols: np.ndarray
    rank: np.ndarray
    byte_ids: np.ndarray
    text: list[bytes]

    @classmethod
    def read(cls, path: str) -> "Pieces":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        symbol = {name: i for i, name in enumerate(names) if not special[i]}
        order = sorted(symbol.values(), key=lambda i: (-model.get_score(i), i))
        rank = np.full(size, NO_RANK)
        rank[order] = np.arange(len(order))
        of_char = np.full(0x110000, UNKNOWN, np.int32)
        for name, i in symbol.items():
            if len(name) == 1:
                of_char[ord(name)] = i
        of_char[ord(" ")], of_char[ord(BLANK)] = of_char[ord(BLANK)], UNKNOWN
        splits = {((symbol[n[:k]] + 1) * (size + 1) + symbol[n[k:]] + 1): i for n, i in symbol.items() for k in range(1, len(n))
                  if n[:k] in symbol and n[k:] in symbol}
        bits = (4 * len(splits)).bit_length()
        keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for key, value in splits.items():
            place = (key * int(MIX[0]) % 2 ** 64) >> (64 - bits)
            while keys[place] >= 0:
                place = (place + 1) % len(keys)
            keys[place], values[place] = key, value
        byte_ids = np.zeros(256, np.int32)
        text = [b"" if s else n.replace(BLANK, " ").encode() for n, s in zip(names, special)]
        for i in range(size):
            if model.is_byte(i):
                byte_ids[int(names[i][3:5], 16)] = i
                text[i] = bytes([int(names[i][3:5], 16)])
        return cls(of_char, keys, values, rank, byte_ids, text)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair of symbols joins to, UNKNOWN if none."""
        key = (left.astype(np.int64) + 1) * (len(self.text) + 1) + right + 1  # no pair has a key with UNKNOWN in it
        bits = (len(self.pair_keys) - 1).bit_length()
        with np.errstate(over="ignore"):
            place = ((key.view(np.uint64) * MIX[0]) >> np.uint64(64 - bits)).view(np.int64)
        found = self.pair_keys.take(place)
        out = np.where(found == key, self.pair_symbols.take(place), np.int32(UNKNOWN))
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) % len(self.pair_keys)
            found = self.pair_keys[place[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.pair_symbols[place[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's tables for a model file, read once."""
    if path not in _pieces:
        _pieces[path] = Pieces.read(path)
    return _pieces[path]


def _one_agenda(model: Pieces, symbols: list[int], key: np.uint64, first: int, rate: float) -> list[tuple[int, int]]:
    """(symbol, place) after all merges of one chunk whose first character stands at `first`, by a heap."""
    n = len(symbols)
    begin, after, before, alive = list(range(n)), [*range(1, n), n], list(range(-1, n - 1)), [True] * n
    stop = list(range(1, n + 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def propose(lefts: list[int]) -> None:
        lefts = [a for a in lefts if a >= 0 and after[a] < n]
        if not lefts:
            return
        rights = [after[a] for a in lefts]
        joined = model.merged(np.array([symbols[a] for a in lefts]), np.array([symbols[b] for b in rights]))
        skip = dropped(np.full(len(lefts), key), np.array([begin[a] + first for a in lefts]),
                       np.array([begin[b] + first for b in rights]), np.array([stop[b] + first for b in rights]), rate)
        for a, b, symbol, out in zip(lefts, rights, joined.tolist(), skip.tolist()):
            if symbol >= 0 and not out:
                heapq.heappush(agenda, (int(model.rank[symbol]), a, b, stop[b], symbol))

    propose(list(range(n)))
    while agenda:
        _, a, b, end, symbol = heapq.heappop(agenda)
        if alive[a] and b < n and alive[b] and after[a] == b and stop[b] == end and stop[a] == begin[b]:
            symbols[a], stop[a], alive[b], after[a] = symbol, stop[b], False, after[b]
            if after[a] < n:
                before[after[a]] = a
            propose([before[a], a])
    return [(symbols[a], a + first) for a in range(n) if alive[a]]


def encode(model: Pieces, texts: list[str], keys: np.ndarray, rate: float) -> list[np.ndarray]:
    """Ids of each text. A text is preceded by a blank; characters without a piece become bytes."""
    chars = [np.frombuffer(f" {t}".encode("utf-32-le"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
    size = np.array([len(c) for c in chars], np.int64)
    edges = np.concatenate(([0], np.cumsum(size)))
    cp = np.concatenate(chars) if chars else np.zeros(0, np.uint32)
    total = len(cp)
    if not total:
        return [np.zeros(0, np.int32) for _ in texts]
    doc = np.repeat(np.arange(len(texts)), size)
    blank = cp == 32
    opens = blank.copy()
    opens[1:] &= ~blank[:-1]
    opens[edges[:-1][size > 0]] = True
    chunk = np.cumsum(opens) - 1
    final = np.full(total, -2, np.int32)  # symbol beginning at each character; -2: none begins
    symbol, begin = model.of_char[cp], np.arange(total)
    stop = begin + 1
    origin, key = edges[:-1][doc], keys[doc]
    lengths = np.bincount(chunk)
    for one in np.flatnonzero(lengths > LONG_CHUNK):
        a = int(np.searchsorted(chunk, one))
        first = a - int(origin[a])
        for s, at in _one_agenda(model, symbol[a:a + lengths[one]].tolist(), key[a], first, rate):
            final[at + origin[a]] = s
    live = np.flatnonzero(lengths[chunk] <= LONG_CHUNK)
    place = _places(key, begin - origin)
    symbol, begin, stop, chunk = symbol[live], begin[live], stop[live], chunk[live]
    joined = np.full(len(live), UNKNOWN, np.int32)  # the symbol that each one and the next join to
    order = np.full(len(live), NO_PAIR)  # rank of that symbol, then place: the least of a chunk is merged next

    def judge(left: np.ndarray) -> None:
        """Enter the pairs of `left` and what follows, which are in one chunk."""
        into = model.merged(symbol.take(left), symbol.take(left + 1))
        order[left] = NO_PAIR
        can = np.flatnonzero(into >= 0)
        left, into = left.take(can), into.take(can)
        at = begin.take(left)
        can = np.flatnonzero(~_dropped_at(place.take(at), stop.take(left) - at, stop.take(left + 1) - at, rate))
        left, into = left.take(can), into.take(can)
        joined[left], order[left] = into, (model.rank.take(into) << np.int64(31)) + at.take(can)

    if len(live):
        judge(np.flatnonzero(chunk[1:] == chunk[:-1]))
    first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))) if len(live) else live
    count = np.diff(np.append(first, len(live)))
    while len(symbol):
        best = np.minimum.reduceat(order, first)
        best_of = np.repeat(best, count)
        rest = best_of == NO_PAIR
        final[begin[rest]] = symbol[rest]
        a = np.flatnonzero((order == best_of) & ~rest)
        symbol[a], stop[a] = joined[a], stop[a + 1]
        keep = ~rest
        keep[a + 1] = False
        now = np.cumsum(keep) - 1  # where each kept one moves to
        a, kept = now[a], np.flatnonzero(keep)
        symbol, begin, stop, joined, order = (x.take(kept) for x in (symbol, begin, stop, joined, order))
        busy = best < NO_PAIR
        count = count[busy] - 1
        ends = np.cumsum(count)
        first = ends - count
        order[a] = NO_PAIR
        judge(np.concatenate((a[a + 1 < ends], a[a > first] - 1)))
    return _with_bytes(model, cp, final, edges)


def _with_bytes(model: Pieces, cp: np.ndarray, final: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    places = np.flatnonzero(final > -2)
    ids, strange = final[places], np.flatnonzero(final[places] == UNKNOWN)
    chars, which = np.unique(cp[places[strange]], return_inverse=True)
    spelled = [chr(c).encode() for c in chars]
    sizes = np.array([len(b) for b in spelled], np.int64)
    width = np.ones(len(ids), np.int64)
    width[strange] = sizes[which]
    out = np.repeat(ids, width)
    starts = np.cumsum(width) - width
    for k in range(4):
        long = np.flatnonzero(sizes[which] > k)
        own = np.array([model.byte_ids[b[k]] if len(b) > k else 0 for b in spelled], np.int32)
        out[starts[strange[long]] + k] = own[which[long]]
    ends = np.concatenate(([0], np.cumsum(width)))[np.searchsorted(places, edges)]
    return [out[a:b] for a, b in zip(ends, ends[1:])]


def decode(model: Pieces, ids: list[int]) -> str:
    """The text of ids that `encode` gave: pieces and bytes in a row, without the blank put before the text."""
    return b"".join(map(model.text.__getitem__, ids))[1:].decode("utf-8", "replace")


def decode_all(model: Pieces, ids: pa.ListArray) -> pa.Array:
    """`decode` of every list; NULL gives an empty text."""
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    _, offsets, data = pa.array(model.text, pa.large_binary()).take(ids.flatten()).buffers()
    edges = np.frombuffer(offsets, np.int64)[np.concatenate(([0], np.cumsum(sizes)))]
    data, some = np.frombuffer(data, np.uint8)[:edges[-1]], edges[1:] > edges[:-1]
    data = np.delete(data, edges[:-1][some])  # without the blank put before each text
    edges = edges - np.concatenate(([0], np.cumsum(some)))
    found = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(edges), pa.py_buffer(data)])
    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:  # ids that spell no text
        return pa.array([b.decode("utf-8", "replace") for b in found.to_pylist()], pa.string())


def encoded(docs: DataFrame, path: str, seed: int, rate: float = 0.1) -> DataFrame:
    """doc_id, text, ids of every row of `docs` (doc_id, text); a NULL or empty text has no ids.

    Rows with a NULL id share one key. Repeated rows have equal ids. With rate 0 the ids are those of the plain model,
    but for a literal U+2581 in a text, which is spelled in bytes so that it is not decoded as a blank.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                keys = document_keys(part.column("doc_id").to_pylist(), seed)
                ids = encode(model, [t or "" for t in part.column("text").to_pylist()], keys, rate)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(ids, pa.list_(pa.int32()))],
                                                 ["doc_id", "text", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, text string, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """`rows`, which have `ids`, with the text that they decode to as `decoded`; NULL ids decode to an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            yield batch.append_column("decoded", decode_all(model, batch.column("ids")))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_batches(rows, run, f"{schema}, decoded string")
