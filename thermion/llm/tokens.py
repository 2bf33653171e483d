"""Token ids of whole texts with a public tokenizer file, word by word.

Some tokenizers never join characters across a space, lower-case letters, and keep letters, digits and
marks apart. Then a text's ids are those of its pieces between white space, and a piece's those of its
words and marks; each is worked out once and kept. This holds only for files whose normalizer and
pre-tokenizer are those of RULES, which is checked when the file is loaded; texts of any other file are
encoded whole by the tokenizers library. The file's own model, run by that library, encodes every word;
pieces with characters beyond PLAIN, or with the beginning of a special token, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import public_tokenizers

DEFAULT = "word_bpe_49k.json"
#: About how many pieces a Python worker keeps in each of two generations, and the longest kept: bounds the memory, not the result.
KEEP, KEEP_BYTES = 500_000, 48
#: The normalizer and pre-tokenizer for which pieces and parts are as below, as tokenizer files state them (fixed values).
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Marks that end a word without being part of it.
MARKS = frozenset(b".,!?;:")
#: Pieces of characters that no normal form changes, and the pattern's parts of them.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


def item_size(path: str, end_id: int | None) -> int:
    """Bytes that hold any id of the file's vocabulary, and end_id: 2 or 4."""
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), end_id or 0]
    return 2 if max(ids) < 1 << 16 else 4


def _by_pieces(path: str) -> bool:
    """Whether a text's ids are those of its pieces."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    added = said.get("added_tokens") or []
    apart = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
    return apart and all(said.get(k) == v for k, v in RULES.items()) and said["model"]["type"] == "BPE" and not said.get("truncation") and not said.get("padding")


class _Known(dict):
    """ids by piece; a piece that is not there is encoded."""

    def __init__(self, encode, before: dict):
        super().__init__({b"": b""})
        self.encode, self.before = encode, before

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= KEEP_BYTES:
            self[piece] = ids
        return ids


class PieceEncoder:
    """encode_batch(texts): each text's ids as little-endian 32-bit integers in one bytes object."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.bytes = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_pieces = _by_pieces(path)
        self.known = _Known(self._piece, {})

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        if piece.isalpha():  # ASCII letters alone: one word
            return self._word(piece.lower().decode())
        if piece[:-1].isalpha() and piece[-1] in MARKS:
            return self.known[piece[:-1]] + self.known[piece[-1:]]
        text = piece.decode()
        if b"<|" in piece or not PLAIN.fullmatch(text):
            return self._whole(text)
        parts = PART.findall(text.lower())
        if len(parts) > 1:
            return b"".join([self.known[p.encode()] for p in parts])
        word = parts[0] if parts[0].isascii() else self.bytes.pre_tokenize_str(parts[0])[0][0]
        return self._word(word)

    def _text(self, text: str | None) -> bytes:
        data = (text or "").encode()
        if b"<|" not in data:
            data = data.lower()
        if b"\n" in data or b"\t" in data or b"\r" in data:
            data = data.translate(BLANK)
        return b"".join(map(self.known.__getitem__, data.split(b" ")))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_pieces:
            return [self._whole(t or "") for t in texts]
        if len(self.known) > KEEP:
            self.known = _Known(self._piece, dict(self.known))
        return [self._text(t) for t in texts]


#: Bytes with tabs and line breaks as spaces.
BLANK = bytes.maketrans(b"\n\t\r", b"   ")
_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This Python worker's encoder: workers live on from task to task, and what they know with them."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encoded(texts: list[str | None], path: str, chars: int = 1 << 20):
    """The ids of each text, in order, encoding about so many characters at a time."""
    tok, batch, held = encoder(path), [], 0
    for text in texts:
        batch.append(text)
        held += len(text or "")
        if held >= chars:
            yield from tok.encode_batch(batch)
            batch, held = [], 0
    yield from tok.encode_batch(batch)
