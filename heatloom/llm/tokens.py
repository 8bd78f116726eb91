"""Token ids of whole texts, with the tokenizers library inside tasks.

A vocabulary that drops white space and splits at it before anything else gives a text the ids of its
chunks between spaces and line ends, in order. For such a vocabulary each worker keeps the ids of the
chunks that it has met (at most MAX_CHUNKS, or as many as it is told, then it starts anew), so that most of a text is looked
up. A chunk of Latin letters, perhaps with one mark after it, goes to the library's model directly,
in lower case and spelt in its byte alphabet; any other chunk goes through the whole tokenizer, and
so do whole texts where the vocabulary is of another kind.
"""

from __future__ import annotations

import json
import re
from itertools import repeat

import numpy as np

MAX_CHUNKS = 250_000
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")


def byte_alphabet() -> dict[int, str]:
    """How a byte-level vocabulary spells a Latin letter: each UTF-8 byte as itself if it is a visible
    Latin-1 character, else as the next free character from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    spell = {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}
    return {c: "".join(spell[b] for b in chr(c).encode()) for c in range(192, 256)}


class Encoder:
    """Ids of texts by a tokenizer file; one for each worker process."""

    _own: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, most: int = MAX_CHUNKS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        first = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.chunked = steps == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed" and first.get("invert") is True
        self.spell, self.most = byte_alphabet(), most
        self._start_anew()

    @classmethod
    def of(cls, path: str, most: int = MAX_CHUNKS) -> Encoder:
        if (path, most) not in cls._own:
            cls._own[path, most] = cls(path, most)
        return cls._own[path, most]

    def _start_anew(self) -> None:
        self.place: dict[str, int] = {"": 0}  # chunk -> its number
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, chunks: list[str]) -> None:
        """Ids of chunks that are new."""
        model, spell, sizes, ids = self.tokenizer.model.tokenize, self.spell, [], []
        marks = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,;:!?"}
        for chunk in chunks:
            n = len(ids)
            if m := PLAIN.fullmatch(chunk):
                word = m[1].lower()
                ids += [x.id for x in model(word if word.isascii() else word.translate(spell))]
                if m[2]:
                    ids += marks[m[2]]
            else:
                ids += self.tokenizer.encode(chunk, add_special_tokens=False).ids
            sizes.append(len(ids) - n)
        count, new, size = len(self.place), len(chunks), np.array(sizes, np.int32)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while count + new > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[count : count + new] = self.used + np.cumsum(size) - size
        self.size[count : count + new] = size
        self.used += len(ids)
        self.place.update(zip(chunks, range(count, count + new), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array (uint32), and where each text's begin (one more than texts)."""
        if not self.chunked:
            each = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            return np.array([x for ids in each for x in ids], np.uint32), np.cumsum([0, *map(len, each)])
        if len(self.place) > self.most:
            self._start_anew()
        chunks: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                chunks += t.replace("\n", " ").split(" ")
            ends[i + 1] = len(chunks)
        at = np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))
        if (new := np.flatnonzero(at < 0)).size:
            self._learn(list(dict.fromkeys(chunks[i] for i in new)))
            at[new] = [self.place[chunks[i]] for i in new]
        size = self.size[at]
        stop = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        where = np.arange(stop[-1]) + np.repeat(self.begin[at] - stop[:-1], size)
        return self.flat[where], stop[ends]
