"""Encoding with the tokenizers library at a bounded cost for each distinct piece.

Both BPE vocabularies used here split a text into pieces first and encode each piece by itself. For texts of
plain Latin letters, ASCII and line breaks the split is a short regular expression, so each distinct piece goes
through the library once while it stays in a bounded table. All other texts, and those with a special token's
string, go through the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import dropped_by_others

_LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ɏ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTERS}]*")
#: The split patterns of the two vocabularies, over the plain characters above.
_SPLIT = {
    "byte": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+",
    "word": rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+",
}
#: Pieces kept; the table starts anew beyond it.
PIECES = 800_000


class Encoder:
    """ids of whole texts; kind "byte" keeps white space and case, "word" folds both."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size()
        self.lower = kind == "word"
        self.split = re.compile(_SPLIT[kind]).findall
        self.special = [str(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.joins = re.compile(rf"{'' if self.lower else ' '}[{_LETTERS}]+").fullmatch
        self.glue = " " if self.lower else ""
        self.known: dict[str, bytes] = {}

    def encode(self, text: str | None) -> np.ndarray:
        """uint32 ids of a text, null as empty."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None], chars: int = 500_000):
        """uint32 ids of each text in turn; new pieces are encoded together, for about ``chars`` characters of text at once."""
        begin = 0
        while begin < len(texts):
            end, room = begin, chars
            while end < len(texts) and (end == begin or room > 0):
                room -= len(texts[end] or "")
                end += 1
            yield from self._block([t or "" for t in texts[begin:end]])
            begin = end

    def _block(self, texts: list[str]):
        if len(self.known) > PIECES:
            self.known.clear()
        known, split = self.known, self.split
        cut = [split(t.lower() if self.lower else t) if _PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        # One look at the table for each piece; those that it lacks are learned together and filled in.
        found = [None if c is None else list(map(known.get, c)) for c in cut]
        gaps = [[i for i, x in enumerate(f) if x is None] if f is not None and None in f else () for f in found]
        new = {c[i] for c, g in zip(cut, gaps, strict=True) for i in g}
        if new:
            self._learn(sorted(new))
        for t, c, f, g in zip(texts, cut, found, gaps, strict=True):
            if f is None:
                yield np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype="<u4")
            else:
                for i in g:
                    f[i] = known[c[i]]
                yield np.frombuffer(b"".join(f), dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        """Encode new pieces: words that a text splits into again go as one text, the others each by itself."""
        words = [p for p in new if self.joins(p)]
        if words:
            done = self.whole.encode(self.glue.join(words), add_special_tokens=False)
            ids = np.array(done.ids, dtype="<u4").tobytes()
            cuts = [0, *(4 * (np.flatnonzero(np.diff(np.array(done.word_ids, dtype=np.int64))) + 1)).tolist(), len(ids)]
            self.known.update(zip(words, (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        rest = [p for p in new if not self.joins(p)]
        for p, e in zip(rest, self.whole.encode_batch(rest, add_special_tokens=False) if rest else [], strict=True):
            self.known[p] = np.array(e.ids, dtype="<u4").tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}
dropped_by_others(_encoders.clear)


def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
