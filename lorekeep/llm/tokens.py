"""Token ids of whole texts with a public tokenizer, words encoded once per worker.

For a tokenizer that lower-cases and drops white space, the ids of a text are the ids of its words one after another, and
of a word that is letters and then marks, those of the two. So each worker keeps the ids of words it has met, and the
library encodes only new ones. Of many texts together, Arrow tells the words apart first. For any other tokenizer, whole
texts go to the library.
"""

from __future__ import annotations

import array
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps; further ones are encoded each time they come.
MOST_WORDS = 1 << 20
#: Longer words aren't kept.
LONGEST = 64
#: Letters up to this one are Latin.
LAST_LATIN = "\u024f"
#: Marks that, after letters, are a piece of their own to the tokenizer.
MARKS = b",.;:!?&#%*$|"
#: Bytes of text whose words are told apart together, but for a longer text.
TOGETHER = 1 << 23


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as they are and the others, in order, from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_words(path: str) -> bool:
    with open(path) as f:
        config = json.load(f)
    normal = (config.get("normalizer") or {}).get("normalizers") or []
    split, *bytewise = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = (split.get("pattern") or {}).get("Regex", "")
    return (
        [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
        and split.get("type") == "Split"
        and (split["behavior"], split["invert"]) == ("Removed", True)
        and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in bytewise] == [("ByteLevel", False, False)]
        and config.get("post_processor") is None
    )


class Encoder(dict):
    """Words to their ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.by_words = Tokenizer.from_file(path), _by_words(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.model, self.signs = self.library.model, {b: c for c, b in byte_of_sign().items()}

    def _ids(self, text: str) -> bytes:
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a word of Latin letters: one piece to the tokenizer, lower-cased and no other in NFC, so that the
        library's model can have it without the steps before."""
        return array.array("I", [x.id for x in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # letters of ASCII only, whose signs in the vocabulary are themselves
            ids = self._piece(word.lower().decode())
        elif (stem := word.rstrip(MARKS)) and len(stem) < len(word) and (stem.isalpha() or stem.decode().lower().isalpha()):
            ids = self[stem] + self[word[len(stem) :]]
        elif (text := word.decode()).isalpha() and max(text) <= LAST_LATIN and "İ" not in text:
            ids = self._piece(text.lower().encode().decode("latin-1").translate(self.signs))
        else:
            ids = self._ids(text)
        if len(self) < MOST_WORDS and len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text; none for null."""
        if not text:
            return b""
        if not self.by_words:
            return self._ids(text)
        raw = text.encode()
        # the strings of special tokens are told by their case
        return b"".join(map(self.__getitem__, (raw if b"<|" in raw else raw.lower()).split()))

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        """The ids of all texts and the number of ids before each. Arrow splits the texts and tells their words apart, so
        that a word that is in them often is looked up once."""
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        ends, words = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        if not len(words):
            return np.zeros(0, "<u4"), [0] * len(ends)
        ids = pa.array([self[x] for x in words.dictionary.cast(pa.large_binary()).to_pylist()], pa.large_binary()).take(words.indices)
        before = np.frombuffer(ids.buffers()[1], "<i8")[ends] // 4
        return np.frombuffer(ids.buffers()[2] if before[-1] else b"", "<u4"), before.tolist()

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as `encode` has them."""
        if not self.by_words:
            for text in texts:
                yield np.frombuffer(self.encode(text.as_py()), "<u4")
            return
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // TOGETHER)) + 1).tolist(), len(texts)]
        for first, last in zip(cuts, cuts[1:]):
            ids, before = self._together(texts.slice(first, last - first))
            for start, stop in zip(before, before[1:]):
                yield ids[start:stop]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, with the words it has met so far."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
