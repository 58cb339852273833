"""Token ids of whole texts by the ``tokenizers`` library.

A byte-level BPE merges inside pre-tokens only.  So a text of plain
characters is split into pre-tokens here, and the library's model gives the
ids of each distinct pre-token once; a worker keeps them.  Texts with other
characters or with a special token's string are encoded whole by the library,
and so are all texts of a tokenizer of another kind.
"""

from __future__ import annotations

import json
import re

MAX_KEPT = 400_000     # pre-tokens that a worker keeps; beyond, it starts anew
LONG = 40              # characters; longer pre-tokens are not kept
WHOLE_CHARS = 1 << 20  # characters of the texts encoded whole in one call

# Characters on whose class (letter, digit, space, other) all regular
# expression libraries agree: ASCII, Latin letters, common punctuation.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_ODD = re.compile(rf"[^\t\n\r -~{_LETTERS[6:]}–—‘’“”…€«»¿¡°·]")
# Fixed value: the byte-level pre-token pattern, its classes spelled out.
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_ENCODERS: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters stand for themselves, the others for the
    characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Kept(dict):
    """Ids by pre-token; asks the model for those that it lacks."""

    def __init__(self, model):
        self.model = model
        self.letters = _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
        if len(piece) <= LONG:
            if len(self) >= MAX_KEPT:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        conf = json.loads(spec)
        pre, model = conf.get("pre_tokenizer") or {}, conf.get("model") or {}
        self.special = [t["content"] for t in conf.get("added_tokens") or []]
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                         and not pre.get("add_prefix_space") and not conf.get("normalizer")
                         and model.get("type") == "BPE" and not model.get("dropout"))
        self.kept = Kept(self.tok.model)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        import numpy as np
        out: list[bytes] = [b""] * len(texts)
        rest, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.by_piece and not _ODD.search(t) and not any(s in t for s in self.special):
                out[i] = b"".join(map(self.kept.__getitem__, _PIECES.findall(t)))
                continue
            rest.append(i)
            size += len(t)
            if size >= WHOLE_CHARS or i == len(texts) - 1:
                self._whole(texts, rest, out, np)
                rest, size = [], 0
        self._whole(texts, rest, out, np)
        return out

    def _whole(self, texts, which, out, np) -> None:
        for i, e in zip(which, self.tok.encode_batch_fast([texts[i] for i in which], add_special_tokens=False)):
            out[i] = np.asarray(e.ids, dtype="<u4").tobytes()


def encoder(spec: str) -> Encoder:
    """The worker's encoder of a tokenizer file's content, made once."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = Encoder(spec)
    return _ENCODERS[spec]


def forget() -> None:
    """Drops the worker's encoder.  A worker lives on after its task, so stages
    that encode nothing call this, or they run beside its kept pre-tokens."""
    _ENCODERS.clear()
