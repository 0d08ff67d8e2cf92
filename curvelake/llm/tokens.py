"""Token ids of whole texts with a public byte-level BPE, as little-endian unsigned 32-bit integers."""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np

from curvelake.llm.common import kept

#: White space of the tokenizer's splitting pattern (the Unicode property).
SPACE = "\t-\r \x85\xa0  -     　"
#: Some of the letters; all of these ranges are letters to the pattern.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: The pattern never joins what stands on two sides of these cuts: a word takes one space before it along, and a
#: word of plain letters ends where a mark follows it.
PIECE = re.compile(f" ?[{LETTERS}]+(?=[.,;:!?{SPACE}]|\\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Pieces in each of the two generations of the memory: the older one is dropped when the newer one is full.
REMEMBERED = 300_000
#: Unknown pieces are encoded many at a time, with a line feed between them, which stays a token of its own.
JOINED = 512
WORD = re.compile(f" ?[{LETTERS}]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the
    others numbered from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes by pieces and remembers the ids of recent pieces, which are the same as those of the whole text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.letters = byte_letters()
        probe = "Ünder water"
        self.by_model = self._model_ids(probe[:5]) + self._model_ids(probe[5:]) == self._encode([probe])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model_ids(self, word: str) -> bytes:
        """Ids of one word of letters, which the splitting pattern leaves whole: straight from the merges."""
        spelled = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _learn(self, new: list[str]) -> None:
        if self.by_model:
            rest = []
            for p in new:
                if WORD.fullmatch(p):
                    self.known[p] = self._model_ids(p)
                else:
                    rest.append(p)
            new = rest
        words = [p for p in new if not p.isspace()] if len(self.feed) == 1 else []
        others = [p for p in new if p.isspace()] if words else new
        self.known.update(zip(others, self._encode(others)))
        for start in range(0, len(words), JOINED):
            some = words[start : start + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.nonzero(ids == self.feed[0])[0]
            if len(ends) != len(some) - 1:
                self.known.update(zip(some, self._encode(some)))
                continue
            raw, bounds = ids.tobytes(), (4 * ends).tolist()
            self.known.update(zip(some, (raw[a:b] for a, b in zip([0, *(x + 4 for x in bounds)], [*bounds, len(raw)]))))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        pieces = [None if t and any(s in t for s in self.special) else PIECE.findall(t or "") for t in texts]
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = set(chain.from_iterable(ps for ps in pieces if ps)).difference(known)
        back = {p: older[p] for p in new if p in older}
        known.update(back)
        self._learn([p for p in new if p not in back])
        ids = known.__getitem__
        return [b"".join(map(ids, ps)) if ps is not None else self._encode([t])[0] for ps, t in zip(pieces, texts)]


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder for each worker process."""
    return kept(("encoder", path, remembered), lambda: Encoder(path, remembered))
