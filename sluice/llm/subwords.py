"""Token ids of whole texts by a public vocabulary, word by word with a bounded cache."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Words, give_back, ragged

VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers; others are encoded anew in each slice.
CACHED_WORDS = 450_000
_state: dict[str, tuple] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _loaded(path: str):
    if path not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _state[path] = (Tokenizer.from_file(path), {})
    return _state[path]


def forget() -> None:
    """Drop what a worker remembers of vocabularies and words: later steps need the memory."""
    if _state:
        _state.clear()
        give_back()


def _ids(words: list[str], tokenizer, cache: dict[str, bytes], most: int) -> list[bytes]:
    known = list(map(cache.get, words))
    new = [i for i, x in enumerate(known) if x is None]
    for at in range(0, len(new), 50_000):
        some = new[at : at + 50_000]
        for i, e in zip(some, tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
            known[i] = array("I", e.ids).tobytes()
            if len(cache) < most:
                cache[words[i]] = known[i]
    return known


#: ASCII punctuation that may close a word; the apostrophe opens contractions and is left out.
CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _bytes_of(words: pa.Array) -> np.ndarray:
    """The bytes of all strings one after another, as they lie in Arrow's own memory; no nulls."""
    _, ends, data = words.buffers()
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_string(words.type) else np.int32)
    return np.frombuffer(data, np.uint8)[at[words.offset] : at[words.offset + len(words)]] if data else np.zeros(0, np.uint8)


def _stem_and_close(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each word's stem and closing punctuation, where the stem ends in a letter; else the word and
    nothing."""
    stem = pc.utf8_rtrim(words, characters=CLOSING)
    stem = pc.if_else(pc.utf8_is_alpha(pc.utf8_slice_codeunits(stem, -1)), stem, words)
    whole, kept = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, stem))
    rest = whole - kept
    joined = _bytes_of(words)
    tails = joined[ragged(np.cumsum(whole) - rest, rest)]
    offsets = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
    return stem, pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(tails.tobytes())])


class Encoded:
    """The ids of texts: how many each has, and on demand the ids one after another.

    The vocabulary lower-cases, drops white space and never joins what ASCII white space divides,
    nor a letter with the punctuation after it. So each text is cut into words, a word into its
    stem and its closing ASCII punctuation, and each distinct part is encoded once in a slice.
    Texts with "<|", which may spell special tokens, keep their case and their words whole."""

    def __init__(self, text: pa.Array, path: str, remember: int = CACHED_WORDS):
        tokenizer, cache = _loaded(path)
        text = pc.fill_null(text, "")
        special = pc.any(pc.match_substring(text, "<|")).as_py()
        self.words = words = Words(text, lower=not special)
        parts = [words.distinct] if special or not len(words.distinct) else list(_stem_and_close(words.distinct))
        lengths, flats, starts, at = [], [], [], 0
        for part in parts:
            coded = part.dictionary_encode()
            known = _ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), tokenizer, cache, remember)
            n = np.fromiter(map(len, known), np.int64, len(known)) // 4
            codes = coded.indices.to_numpy(zero_copy_only=False)
            lengths.append(n[codes])
            starts.append((at + np.cumsum(n) - n)[codes])
            flats.append(np.frombuffer(b"".join(known), np.uint32))
            at += len(flats[-1])
        self._parts = np.concatenate(flats), np.stack(starts, 1), np.stack(lengths, 1)
        self._of_distinct = self._parts[2].sum(1)
        self.counts = words.per_text(self._of_distinct[words.codes])

    def ids(self) -> np.ndarray:
        flat, starts, lengths = self._parts
        flat = flat[ragged(starts.ravel(), lengths.ravel())]
        start = np.cumsum(self._of_distinct) - self._of_distinct
        codes = self.words.codes
        return flat[ragged(start[codes], self._of_distinct[codes])]


def encode(text: pa.Array, path: str, remember: int = CACHED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and ids per text."""
    found = Encoded(text, path, remember)
    return found.ids(), found.counts
