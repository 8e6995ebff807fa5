"""Token ids of whole texts by a public tokenizer, one call for many new words.

The tokenizer lowers case, drops white space and never merges across it, so a text's ids are
the ids of its chunks (what stands between ASCII white space), one after another.
Chunks repeat; an encoder keeps the ids of those it has met, up to a bound, and asks the
tokenizers library for all new ones of a slice of texts in a few calls:
* plain words (Latin letters only) are one piece each, joined by spaces; the
  last token of each is one that ends a word;
* a plain word and one mark after it are the ids of the two;
* other chunks are separated by a special token;
* chunks of texts that hold a special token's beginning are encoded alone.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np

SEPARATOR = "<|startoftext|>"
#: Chunks remembered per Python worker; beyond it the store starts anew, which costs time but changes no result.
KEPT_CHUNKS = 500_000
MARKS = b".,;:!?"


class Encoder:
    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kept = kept
        self.ends_word = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.marks = {m: int(self.plain(chr(m))[0]) for m in MARKS}
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.flat = np.zeros(8192, np.int32)
        self.used = 0

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def store(self, names: list[bytes], start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Put ids at the end of the store; start counts within ids."""
        n, at = len(self.place), self.used
        while n + len(names) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[n : n + len(names)] = start + at
        self.length[n : n + len(names)] = length
        self.flat[at : at + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(names, range(n, n + len(names)), strict=True))

    def gathered(self, at: np.ndarray) -> np.ndarray:
        """The ids of stored chunks, one after another."""
        n = self.length[at]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def learn(self, chunks: set[bytes]) -> None:
        """Ask for chunks not met before."""
        words, marked, others, alone = [], [], [], []
        for c in chunks:
            if c.isalpha() or plain_word(c):
                words.append(c)
            elif c[-1] in MARKS and plain_word(c[:-1]):
                marked.append(c)
            elif b"<|" in c:
                alone.append(c)
            else:
                others.append(c)
        words += {c[:-1] for c in marked} - self.place.keys() - set(words)
        if words:
            ids = self.plain(b" ".join(words).decode())
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(words):
                raise RuntimeError("a word has more than one last token")
            self.store(words, ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0), ids)
        if marked:
            at = np.fromiter((self.place[c[:-1]] for c in marked), np.int64, len(marked))
            n = self.length[at]
            ends = np.cumsum(n + 1)
            ids = np.empty(int(ends[-1]), np.int32)
            last = np.zeros(len(ids), bool)
            last[ends - 1] = True
            ids[~last] = self.gathered(at)
            ids[last] = [self.marks[c[-1]] for c in marked]
            self.store(marked, ends - n - 1, n + 1, ids)
        if others:
            ids = self.plain(f" {SEPARATOR} ".join(c.decode() for c in others))
            cuts = np.flatnonzero(ids == self.separator)
            start = np.concatenate([[0], cuts + 1])
            self.store(others, start, np.append(cuts, len(ids)) - start, ids)
        for c in alone:
            ids = self.plain(c.decode())
            self.store([c], np.array([0]), np.array([len(ids)]), ids)

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text; null is an empty text."""
        if len(self.place) > self.kept:
            self.clear()
        # special tokens are told by their case; all else is alike in lower case
        chunks = [((t if b"<|" in t else t.lower()) if t else b"").split() for t in texts]
        get = self.place.get
        found = [np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)) for words in chunks]
        missed = [np.flatnonzero(at < 0) for at in found]
        new = {words[i] for words, gaps in zip(chunks, missed, strict=True) for i in gaps.tolist()}
        if new:
            self.learn(new)
            for words, at, gaps in zip(chunks, found, missed, strict=True):
                if len(gaps):
                    at[gaps] = [get(words[i]) for i in gaps.tolist()]
        return [self.gathered(at) for at in found]


def plain_word(chunk: bytes) -> bool:
    """Latin letters only, none of which changes under normalization or becomes more than one letter in lower case."""
    if chunk.isascii():
        return chunk.isalpha()
    s = chunk.decode()
    return s.isalpha() and max(s) < "\u0180" and "\u0130" not in s


class Held:
    """An encoder made where it is first asked for.

    Sent as a broadcast, it is one for each Python worker, and the worker drops it with the first task that doesn't use the broadcast.
    """

    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        self.path, self.kept = path, kept
        self.made: Encoder | None = None

    def __reduce__(self):
        return Held, (self.path, self.kept)

    def get(self) -> Encoder:
        if self.made is None:
            self.made = Encoder(self.path, self.kept)
        return self.made


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
