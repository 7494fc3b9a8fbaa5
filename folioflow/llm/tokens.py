"""Token ids of the public tokenizers, fast enough to encode a corpus.

``PieceEncoder`` gives exactly the ids of ``Tokenizer.encode``. Byte-pair encoders treat the pieces that
their splitting pattern cuts from a text one by one, so the ids of a piece are remembered and the library is
asked once for each new piece. Texts that hold an added token of the vocabulary, or characters whose class or case
may differ between Unicode versions, are handed to the library whole.
"""

from __future__ import annotations

import array
import re

CACHE_PIECES = 400_000  # pieces remembered by one Python worker before it starts anew
CACHE_CHARS = 48  # longer pieces are not remembered

# The patterns by which the two vocabularies split a text, for plain texts as below.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
SPLIT_BYTES = re.compile(rf"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
SPLIT_WORDS = re.compile(rf"{_SHORT}|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
# Beyond blanks, printable ASCII, Latin letters and common punctuation a text isn't plain.
_OTHER = re.compile(r"[^\n\r\t\x20-\x7E\xA1-\xAC\xAE-įı-ɏ–-„•…€]")


def _byte_letters() -> dict[int, str]:
    """What a byte-level vocabulary writes for each byte: itself if visible, else the next free letter."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """Piece to ids; a new piece is encoded by the library and remembered."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids of whole texts as little-endian bytes of ``width`` bytes each (2 or 4)."""

    def __init__(self, path: str, width: int = 4):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.pattern = SPLIT_WORDS if self.lowers else SPLIT_BYTES
        self.code = {2: "H", 4: "I"}[width]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known = _Known(self.piece)

    def whole(self, text: str) -> bytes:
        """The ids as the library gives them for the text as it is."""
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return array.array(self.code, found.ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of one piece of a plain text: the merges alone, without the steps before them."""
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array.array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode(self, text: str) -> bytes:
        plain = text.lower() if self.lowers else text
        if _OTHER.search(text) or any(token in text or token in plain for token in self.added):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, self.pattern.findall(plain)))


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, width: int = 4) -> PieceEncoder:
    """One encoder per Python worker, file and width."""
    key = (path, width)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, width)
    return _ENCODERS[key]
