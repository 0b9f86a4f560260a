"""Token ids of many texts with the tokenizers library, each distinct piece of text encoded once.

A vocabulary splits text into words before anything else. Texts are cut here only at places where
every such split cuts too: at white space, and before or after a full stop, comma or line break that
stands alone. So the ids of the pieces, one after the other, are those of the whole text. Texts with
anything unusual there (two signs in a row, two spaces, signs or white space outside ASCII, control
characters) are cut at white space only, or not at all.

`cut="space"` is for vocabularies that drop white space and case, `cut="lead"` for byte-level ones that
keep a space with the word after it.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Text that one call of `encode` should get: new pieces that are not remembered are encoded once a call.
STEP_BYTES = 1 << 20
#: Distinct pieces that a task remembers; further ones are encoded again when they come again.
REMEMBERED = 750_000
#: Longer pieces (bytes) are texts that could not be cut; they hardly come again, and they and their ids fill the memory.
LONG = 64
_CLASS = bytes(b"."[0] if b < 128 and not chr(b).isalnum() and not chr(b).isspace() else b" "[0] if b in b"\t\n\v\f\r " else b"a"[0] for b in range(256))
_CONTROL = bytes([*range(9), *range(14, 32), 127])
_ODD = re.compile(r"[^\w\x00-\x7f]")
_WORD = re.compile(rb" ?[^ \t\n\v\f\r]+")


def _plain(text: str, raw: bytes, kinds: bytes) -> bool:
    """Signs stand alone, and all signs and white space are ASCII."""
    return b".." not in kinds and (text.isascii() or not _ODD.search(text)) and len(raw.translate(None, _CONTROL)) == len(raw)


class _Numbers(dict):
    """Numbers of pieces; a new piece gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class Encoder:
    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # special tokens' strings in a text are ordinary text
        self.cut = cut
        #: Stands between pieces that are encoded in one call; pieces that hold it are encoded alone.
        self.between = b" | " if cut == "space" else b"\n"
        own = self._ids([self.between])[0]
        self.mark = own[0] if len(own) == 1 else None
        self.numbers = _Numbers()
        self.whole: set[bytes] = set()  # texts that were not cut, since the last call
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), dtype=np.uint32)])
        while len(self.numbers) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(len(self.start), dtype=np.int64)])
            self.size = np.concatenate([self.size, np.zeros(len(self.size), dtype=np.int64)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[numbers] = self.used + np.cumsum(size) - size
        self.size[numbers] = size
        self.used += len(ids)

    def _alone(self, pieces: list[bytes]) -> list[int]:
        """Which pieces cannot stand in a row with others: these are one word, at most one space before it, no mark inside."""
        if self.mark is None:
            return list(range(len(pieces)))
        if self.cut == "space":  # always one word
            return [i for i, p in enumerate(pieces) if b"|" in p]
        word, whole = _WORD.fullmatch, self.whole
        return [i for i, p in enumerate(pieces) if not word(p) or p in whole]

    def _learn(self) -> None:
        """Ids of the new pieces."""
        new, first = self.numbers.new, len(self.numbers) - len(self.numbers.new)
        alone = self._alone(new)
        together = np.delete(np.arange(len(new)), alone)
        for at in range(0, len(together), 20_000):
            some = together[at : at + 20_000].tolist()
            lists = self._ids([self.between.join([*[new[i] for i in some[k : k + 50]], b""]) for k in range(0, len(some), 50)])
            ids = np.concatenate([np.array(own, dtype=np.uint32) for own in lists])
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some):
                raise ValueError("this vocabulary does not split text where it is cut here")
            self._keep(first + np.array(some), ids[ids != self.mark], np.diff(cuts, prepend=-1) - 1)
        own = self._ids([new[i] for i in alone])
        self._keep(first + np.array(alone, dtype=np.int64), np.array([x for ids in own for x in ids], dtype=np.uint32), np.array([len(ids) for ids in own], dtype=np.int64))

    def pieces(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        kinds = raw.translate(_CLASS)
        plain = _plain(text, raw, kinds)
        if self.cut == "space":
            return raw.lower().replace(b".", b" . ").replace(b",", b" , ").split() if plain else raw.split()
        if not plain or b"  " in kinds:
            self.whole.add(raw)
            return [raw]
        if not raw:
            return []
        signs = raw.replace(b".", b"\0.").replace(b",", b"\0,")
        if b" ." in kinds:  # a sign takes the space before it along
            signs = signs.replace(b" \0", b" ")
        return signs.replace(b"\n", b"\0\n\0").replace(b" ", b"\0 ").split(b"\0")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        chunks: list[bytes] = []
        counts = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, text in enumerate(texts):
            chunks += self.pieces(text)
            counts[i + 1] = len(chunks)
        at = np.fromiter(map(self.numbers.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        if self.numbers.new:
            self._learn()
        start, size = self.start[at], self.size[at]
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(start - before, size) + np.arange(int(size.sum()))]
        reach = np.concatenate([[0], before + size])
        self._forget()
        return ids, np.diff(reach[counts])

    def _forget(self) -> None:
        """Drops what is too long of the new pieces, then the newest ones beyond REMEMBERED."""
        new, first = self.numbers.new, len(self.numbers) - len(self.numbers.new)
        fits = [i for i, p in enumerate(new) if len(p) <= LONG][: max(0, REMEMBERED - first)]
        if len(fits) < len(new):
            for piece in new:
                del self.numbers[piece]
            self.numbers.update(zip([new[i] for i in fits], range(first, first + len(fits)), strict=True))
            kept = first + np.array(fits, dtype=np.int64)
            start, size = self.start[kept], self.size[kept]
            before = np.cumsum(size) - size
            ids = self.ids[np.repeat(start - before, size) + np.arange(int(size.sum()))]
            self.used = int((self.start[:first] + self.size[:first]).max(initial=0))
            self._keep(first + np.arange(len(fits)), ids, size)
        self.numbers.new, self.whole = [], set()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, cut: str) -> Encoder:
    """The encoder of this Python worker; it outlives a task."""
    if (path, cut) not in _encoders:
        _encoders[path, cut] = Encoder(path, cut)
    return _encoders[path, cut]
