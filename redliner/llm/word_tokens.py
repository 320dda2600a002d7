"""Ids of the word tokenizer for whole texts, computed once per distinct word.

The tokenizer drops white space and never lets a piece cross it, so a text's ids
are those of its white-space-free runs in order. ASCII capitals are lowered
first, as its normaliser does anyway. Runs of plain Latin letters, digits and
ASCII punctuation go straight to the library's BPE model; all others go through
its full pipeline. Runs that hold the exact string of a special token go through
it as they are, capitals included, and get the id of that token there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

NAME = "word_bpe_49k.json"
#: runs remembered by a worker; then the memory starts anew
REMEMBERED = 250_000

_PLAIN = re.compile(r"[a-z0-9ß-öø-ÿ!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~-]+")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(223, 256)}


class _Memory(dict):
    """Ids by run; a run that is not there yet is encoded when it is asked for."""

    def __init__(self, make: Callable[[bytes], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, run: bytes) -> bytes:
        ids = self[run] = self.make(run)
        return ids


class WordTokenizer:
    """Encodes texts to little-endian 16-bit ids with a bounded memory of runs."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # a special token's string is one only as it is written, not where lowering has made it
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.ordinary = Tokenizer.from_file(path)
        self.ordinary.encode_special_tokens = True
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.model = self.library.model
        self.latin = _byte_letters()
        self.remembered = remembered
        self.memory = _Memory(self._run)
        # words are often met with other marks around them
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.translate(self.latin)
        found = self.pieces[piece] = b"".join([t.id.to_bytes(2, "little") for t in self.model.tokenize(letters)])
        return found

    def _run(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text):
            known, parts = self.pieces, _PIECE.findall(text)
            return b"".join([known.get(p) or self._piece(p) for p in parts])
        return np.array(self.ordinary.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _with_special(self, text: bytes) -> bytes:
        """Ids of a text with strings of special tokens."""
        whole = lambda run: np.array(self.library.encode(run.decode(), add_special_tokens=False).ids, "<u2").tobytes()
        return b"".join([whole(run) if any(s in run for s in self.special) else self.memory[run.lower()] for run in text.split()])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; a null text is empty."""
        if len(self.memory) > self.remembered:
            self.memory.clear()
        if len(self.pieces) > self.remembered:
            self.pieces.clear()
        ids, special = self.memory.__getitem__, self.special
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        return [self._with_special(t) if any(s in t for s in special) else b"".join(map(ids, t.lower().split())) for t in raw]


_OPEN: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, remembered: int = REMEMBERED) -> WordTokenizer:
    """The tokenizer of this worker process."""
    if (path, remembered) not in _OPEN:
        _OPEN[path, remembered] = WordTokenizer(path, remembered)
    return _OPEN[path, remembered]


def vocabulary_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
