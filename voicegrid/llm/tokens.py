"""Exact token ids of a public word-level BPE tokenizer, with the ids of each distinct word kept.

The tokenizer cuts at white space and into words, and encodes each word by itself. So some megabytes of text
at a time are cut into chunks between ASCII white space, each distinct chunk is looked up once, chunks that are
new are put together from their words, and only new words are encoded. Memory is bounded: a full table of
chunks goes but for the last ones; a full table of words becomes the old one, of which words that come again are
taken over, and the old one before it goes.
"""

from __future__ import annotations

import functools
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voicegrid.llm.common import text_buffers

# Characters beyond ASCII that the tokenizer's normaliser changes in simple case only. All but two are letters.
_LATIN = "\xc0-\u012f\u0131\u0134-\u017f"
PLAIN = re.compile(f"[\x21-\x7e\xa1-\xac\xae-\xbf{_LATIN}]*")
# The word pattern that the tokenizer file names, for such characters after lower-casing.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u012f\u0131\u0134-\u017f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
SIGNS = string.punctuation.encode()
# Texts that may hold an added token, or marks that join the letter before them in one case only.
ODD = r"<\||\p{M}"
# Signs between a letter and white space are a word of their own.
SIGNS_BEHIND = rf"([{_LETTER}])([!-/:-@\[-`{{-~]+\s)"
STEP_BYTES = 2 << 20  # of text that callers should pass at once
TABLE_BYTES = 8 << 20
KEPT_CHUNKS = 80_000
LONGEST_KEPT = 64  # bytes; longer words are encoded each time


def _byte_characters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


BYTE_CHARACTERS = dict(enumerate(_byte_characters()))


class _Kept(dict):
    """Word, or chunk, to its ids, packed; at most two tables of ``KEPT_CHUNKS``, the newer one being this."""

    def __init__(self, library):
        super().__init__()
        self.library, self.pieces = library, library.model.tokenize
        self.old: dict[bytes, bytes] = {}
        self.code = "H" if library.get_vocab_size() <= 1 << 16 else "I"

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return array(self.code, [p.id for p in self.pieces(shown)]).tobytes()

    def new(self, chunk: bytes) -> bytes:
        stem = chunk.rstrip(SIGNS)
        text = stem.decode()
        if text.isalpha() and (text.isascii() or PLAIN.fullmatch(text)):  # letters, and signs behind them, are words of their own
            if len(stem) < len(chunk):
                return self[stem] + self[chunk[len(stem):]]
            low = text.lower()
            return self.word(text) if low == text else self[low.encode()]
        text = chunk.decode()
        if b"<|" in chunk or not (text.isascii() and text.isprintable() or PLAIN.fullmatch(text)):
            return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        words = WORD.findall(text.lower())
        if len(words) == 1 and words[0] == text:
            return self.word(text)
        return b"".join([self[w.encode()] if w != text else self.word(w) for w in words])

    def __missing__(self, chunk: bytes) -> bytes:
        packed = self.old.get(chunk)
        if packed is None:
            packed = self.new(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= KEPT_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = packed
        return packed


@functools.lru_cache(maxsize=2)
def _library(path: str):
    """The library's tokenizer for a file, loaded once in each worker process."""
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class WordTokenizer:
    """``encode`` gives the same ids as the library's own ``encode(text, add_special_tokens=False)``.

    Make one for each task and close it, so an idle worker process holds no tables.
    """

    def __init__(self, path: str):
        self.library = _library(path)
        self.close()
        self.type = np.dtype("<u2" if self.kept.code == "H" else "<u4")

    def close(self) -> None:
        """Empty the tables, and give back the memory that Arrow holds in reserve."""
        self.kept = _Kept(self.library)
        self.chunks, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        pa.default_memory_pool().release_unused()

    def encode(self, text: bytes | None) -> bytes:
        """The ids of a UTF-8 text, packed as ``type``; null counts as empty."""
        return self.encode_all(pa.array([text], pa.large_string()))[0].as_py()

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """The ids of each of some texts, packed as ``type``; null counts as empty."""
        raw, begins = text_buffers(texts)  # as large strings that begin at 0, which Arrow's functions on slices need
        texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(begins), pa.py_buffer(raw)])
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=SIGNS_BEHIND, replacement=r"\1 \2")
        odd = pc.match_substring_regex(texts, ODD)
        cut = pc.ascii_split_whitespace(pc.if_else(odd, texts, plain) if pc.any(odd).as_py() else plain)
        found = cut.flatten().dictionary_encode()
        ids = self._looked_up(found.dictionary).take(found.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[:len(ids) + 1]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends[cut.offsets.to_numpy()]), ids.buffers()[2]])

    def _looked_up(self, distinct: pa.Array) -> pa.Array:
        """The ids of distinct chunks, in order; new ones join the table."""
        at = pc.index_in(distinct, self.chunks)
        new = distinct.filter(at.is_null())
        packed = pa.array([self.kept.new(c) for c in new.cast(pa.large_binary()).to_pylist()], pa.large_binary())
        number = at.to_numpy(zero_copy_only=False)
        number = np.where(np.isnan(number), len(self.chunks) - 1 + np.cumsum(np.isnan(number)), number).astype(np.int64)
        chunks, ids = pa.concat_arrays([self.chunks, new]), pa.concat_arrays([self.ids, packed])
        own = ids.take(pa.array(number))
        if chunks.nbytes + ids.nbytes > TABLE_BYTES:
            chunks, ids = distinct, own
        if chunks.nbytes + ids.nbytes > TABLE_BYTES:
            chunks, ids = pa.array([], chunks.type), pa.array([], ids.type)
        self.chunks, self.ids = chunks, ids
        return own


def default_tokenizer() -> str:
    """The path of the public tokenizer file that the registered queries use."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
