"""Token ids by a public tokenizer file, with a memory of the chunks that it has encoded.

Between two characters that are not blank, a single space always begins a new pre-token and a single line feed is one, so
the ids of a text are those of its chunks in a row. A chunk is encoded once and then remembered; natural text repeats most
of them. New words are merged many at a time: no token holds a blank and what stands before it, so none spans two of them.
"""
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

ODD_SPACE = re.compile(r" (?:(?<=\s )|(?=\s))")  # a space beside another blank
LINE_FEED = re.compile(r"\n(?<=\S\n)(?=\S)")  # between characters that are not blank
REMEMBERED = 600_000  # chunks kept by a worker; beyond that, the memory starts anew
LONGEST_REMEMBERED = 48
MARKS = ".,;:!?"
#: Byte-level tokenizer files name a byte by its own character if that is visible, else by the next one from 256 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: b for b in VISIBLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in VISIBLE)}
OPENING = tuple(chr(BYTE_NAMES[b]) for b in b" \n")
#: A token that would join a word to the space or line feed after it, or a line feed to the word after it.
SPANNING = re.compile("[^{0}{1}][{0}{1}]|{1}[^{0}{1}]".format(*OPENING))
JOINED = 1024  # words merged at once


def _of_words(name: str) -> bool:
    """Whether the token may stand in words of letters with spaces and line feeds between them."""
    text = name.translate({named: b for b, named in BYTE_NAMES.items()}).encode("latin-1").decode(errors="replace")
    return all(c.isalpha() or c in " \n\ufffd" for c in text)


class Encoder:
    def __init__(self, path: str, specials_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.model = self.tokenizer.model
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens = {i for name, i in names.items() if name.startswith(OPENING)}
        self.words_apart = not any(SPANNING.search(name) and _of_words(name) for name in names)
        self.mark_ids = dict(zip(MARKS, self._ids(list(MARKS))))
        self.known: dict[str, bytes] = {}  # of chunks that follow a space, which their ids include, or begin with a line feed

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each with the space before it or its line feed: the merges of the model alone."""
        texts = [w if w[0] == "\n" else f" {w}" for w in words]
        if not self.words_apart:
            return self._ids(texts)
        found = []
        for k in range(0, len(texts), JOINED):
            named = "".join(texts[k:k + JOINED]).encode().decode("latin-1").translate(BYTE_NAMES)
            ids = [t.id for t in self.model.tokenize(named)]
            data, edges = np.array(ids, "<u4").tobytes(), [4 * at for at, i in enumerate(ids) if i in self.opens]
            found += [data[a:b] for a, b in zip(edges, [*edges[1:], len(data)])]
        return found

    def _learn(self, chunks: list[str]) -> None:
        words, marked, other = set(), [], []
        for chunk in chunks:
            letters = chunk[1:] if chunk[0] == "\n" else chunk
            if letters.isalpha():
                words.add(chunk)
            elif letters[-1:] in self.mark_ids and letters[:-1].isalpha():
                marked.append(chunk)
            else:
                other.append(chunk)
        words.update(c[:-1] for c in marked)
        new = list(words.difference(self.known))
        self.known.update(zip(new, self._words(new)))
        self.known.update((c, self.known[c[:-1]] + self.mark_ids[c[-1]]) for c in marked)
        self.known.update(zip(other, self._ids([c if c[0] == "\n" else f" {c}" for c in other])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plain = [LINE_FEED.sub(" \n", t) if t[:1] != " " and t[-1:] != " " and not ODD_SPACE.search(t) else None for t in texts]
        lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        count = lists.value_lengths().fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64)
        chunks, own = lists.flatten(), np.array([t is not None for t in plain], bool)
        begin = np.cumsum(count[own]) - count[own]
        leading = chunks.take(pa.array(begin)).to_pylist()[::-1]
        first = self._ids([t if p is None else leading.pop() for t, p in zip(texts, plain)])
        later = np.ones(len(chunks), bool)
        later[begin] = False
        chunks = chunks.filter(pa.array(later)).dictionary_encode()  # each once
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = [*map(self.known.get, names)]
        missing = [k for k, ids in enumerate(parts) if ids is None]
        if len(self.known) + len(missing) > REMEMBERED:
            self.known = {}
        new = [names[k] for k in missing]
        self._learn(new)
        for k, chunk in zip(missing, new):
            parts[k] = self.known[chunk]
            if len(chunk) > LONGEST_REMEMBERED:
                del self.known[chunk]
        parts += first
        part = np.empty(count.sum(), np.int64)  # of each chunk of all texts
        heads = np.zeros(len(part), bool)
        heads[np.cumsum(count) - count] = True
        part[heads], part[~heads] = np.arange(len(names), len(parts)), chunks.indices.to_numpy()
        size = np.array([*map(len, parts)], np.int64) // 4
        ends, places = np.cumsum(size[part]), (np.cumsum(size) - size)[part]
        ids = np.frombuffer(b"".join(parts), "<u4")
        ids = ids[np.repeat(places - ends + size[part], size[part]) + np.arange(size[part].sum())]
        edges = [0, *ends[np.cumsum(count) - 1].tolist()]
        return [ids[a:b] for a, b in zip(edges, edges[1:])]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, specials_as_text: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file, read once."""
    key = path, specials_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
