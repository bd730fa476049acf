"""Dense features of texts, computed for many texts at once on their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from voicegrid.llm import bytewords as B
from voicegrid.llm.common import text_buffers

# Common insults and slurs against a person, as single words; a parameter of the toxicity operator.
INSULTS = ("arschloch asshole bastard bitch clown connard crétin cretin degenerate disgusting dumb dumbass dummkopf estúpido "
           "fool freak fuck fucking garbage hässlich hate idiot idiota idiote idioten imbecile imbécil imbécile jerk kill "
           "loser losers maldito merde mierda moron morons pathetic pendejo pig puta pute retard retarded salaud scheiße "
           "scum shit shut sick slut stupid stupide trash trottel ugly vermin worthless wretch").split()
SEVERE = "arschloch asshole bastard bitch connard fuck fucking kill pendejo puta pute retard retarded salaud slut".split()
SECOND_PERSON = ("you your yours yourself yourselves u ur youre du dich dir dein deine deiner deinem deinen euch euer eure ihr "
                 "tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tuyo tuya").split()
FUNCTION_WORDS = ("the of and to in is that it for was with as this from by be on an are at or der die das und zu von ist mit ein "
                  "eine den dem im auf für le la les de des et un une que qui dans pour est du au sur el los las del en y se por con "
                  "para su como más").split()
_SYMBOLS = b"#$%&*@|~^<>{}[]\\=+_"
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())

# Letters that digits and signs are written for; separators inside words are left out before the comparison.
_LEET = dict(zip(b"013457@$", b"oieastas", strict=True))
_DROPPED = b".-*_!'`~"


def _mask(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_UPPER, _LOWER, _DIGIT = (_mask(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
_PUNCT, _SYMBOL, _GONE = _mask(_PUNCTUATION), _mask(_SYMBOLS), _mask(_DROPPED)
_READ = B.LOWER.copy()
_READ[list(_LEET)] = list(_LEET.values())


def word_hashes(words: list[str]) -> np.ndarray:
    """The sorted hashes that these words have in texts."""
    data = [w.encode() for w in words]
    raw, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(w) for w in data])
    return np.unique(B.hashes(B.Words(raw, ends - [len(w) for w in data], ends, np.zeros(len(data), int), np.array([0, len(data)]))))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[place] == h


def _near(hits: np.ndarray, others: np.ndarray, doc: np.ndarray, within: int) -> np.ndarray:
    """Which hits have one of ``others`` (both positions of words, ascending) within so many words of their text."""
    if not len(hits) or not len(others):
        return np.zeros(len(hits), bool)
    at = np.searchsorted(others, hits)
    out = np.zeros(len(hits), bool)
    for k in (np.maximum(at - 1, 0), np.minimum(at, len(others) - 1)):
        out |= (np.abs(others[k] - hits) <= within) & (doc[others[k]] == doc[hits])
    return out


BEGINNINGS = (4, 5, 6)  # bytes of a word that are taken for its stem


def term_hashes(words: B.Words, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words themselves and of their beginnings, each with the words' positions."""
    yield h, np.arange(len(h))
    for size in BEGINNINGS:
        at = np.flatnonzero(words.end - words.start > size)
        start = words.start[at]
        part = B.Words(words.data, start, start + size, words.doc[at], words.first)
        yield B.mix(B.hashes(part) + np.uint64(size)), at


def distinct_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different terms of each text, and the number of their text."""
    raw, begins = text_buffers(column)
    words = B.cut(B.LOWER[raw], begins, B.LETTER_OR_DIGIT)
    found = [(h, words.doc[at]) for h, at in term_hashes(words, B.hashes(words))]
    terms, docs = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.lexsort((terms, docs))
    terms, docs = terms[order], docs[order]
    new = np.r_[True, (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])] if len(terms) else np.zeros(0, bool)
    return terms[new], docs[new]


@dataclass
class Terms:
    """Ascending hashes of terms (see ``term_hashes``), and their weights."""

    hashes: np.ndarray
    weights: np.ndarray


class Features:
    """``names`` and, called with a text array, a row of values for each text. Null and empty texts have zeros."""

    names = ["log_words", "word_length", "insults", "insult_kinds", "severe", "hidden_insults", "second_person", "insults_near_you",
             "capitals", "capital_words", "exclamations", "punctuation", "same_signs", "symbols", "digits", "mixed_words",
             "same_words", "distinct_words", "function_words", "line_words", "distinct_lines", "lone_signs",
             "learned", "learned_kinds", "learned_near_you", "learned_most"]

    def __init__(self, insults: list[str] = INSULTS, near: int = 5, learned: Terms | None = None):
        self.learned = learned or Terms(np.zeros(0, np.uint64), np.zeros(0))
        self.insults, self.severe = word_hashes(insults), word_hashes(SEVERE)
        self.you, self.function = word_hashes(SECOND_PERSON), word_hashes(FUNCTION_WORDS)
        self.near = near

    def __call__(self, column: pa.Array) -> np.ndarray:
        raw, begins = text_buffers(column)
        n, low = len(column), B.LOWER[raw]
        chunks, letters = B.cut(low, begins, B.NOT_SPACE), B.cut(low, begins, B.LETTER_OR_DIGIT)
        h, c = B.hashes(letters), B.hashes(chunks)
        count = np.maximum(letters.counts, 1)
        size = np.maximum(np.diff(begins), 1)

        def of_bytes(mask: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(mask, out=sums[1:])
            return sums

        def per_text(sums: np.ndarray) -> np.ndarray:
            return sums[begins[1:]] - sums[begins[:-1]]

        def per_doc(doc: np.ndarray) -> np.ndarray:
            return np.bincount(doc, minlength=n).astype(float)

        def kinds(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
            return per_doc(doc[np.unique(B.mix(values + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]])

        upper, lower, digit = (of_bytes(m[raw]) for m in (_UPPER, _LOWER, _DIGIT))
        hit = np.flatnonzero(_among(h, self.insults))
        you = np.flatnonzero(_among(h, self.you))
        # What is read once signs stand for letters and separators inside words are gone.
        stay = ~_GONE[raw]
        kept = np.r_[0, np.cumsum(stay)]
        plain = B.cut(_READ[raw[stay]], kept[begins], B.LETTER_OR_DIGIT)
        seen = per_doc(plain.doc[_among(B.hashes(plain), self.insults)])
        hits = per_doc(letters.doc[hit])
        weight = np.zeros(len(h))
        if len(self.learned.hashes):
            for term, at in term_hashes(letters, h):
                hits_at = _among(term, self.learned.hashes)
                place = np.searchsorted(self.learned.hashes, term[hits_at])
                weight[at[hits_at]] = np.maximum(weight[at[hits_at]], self.learned.weights[place])
        told = np.flatnonzero(weight)
        strongest = np.zeros(n)
        np.maximum.at(strongest, letters.doc[told], weight[told])
        capital = (upper[letters.end] - upper[letters.start] >= 2) & (lower[letters.end] == lower[letters.start])
        mixed = (digit[letters.end] > digit[letters.start]) & (lower[letters.end] + upper[letters.end] > lower[letters.start] + upper[letters.start])
        sign = _PUNCT[raw]
        same = np.zeros(len(raw), bool)
        same[1:] = sign[1:] & (raw[1:] == raw[:-1])
        again = np.flatnonzero((h[1:] == h[:-1]) & (letters.doc[1:] == letters.doc[:-1])) + 1 if len(h) else np.zeros(0, int)
        lone = (chunks.end - chunks.start == 1) & sign[chunks.start] if len(c) else np.zeros(0, bool)
        lines = B.cut(raw, begins, B.NOT_LINE_END)
        some = np.maximum(lines.counts, 1)
        cased = per_text(upper) + per_text(lower)
        return np.stack([
            np.log1p(letters.counts), np.minimum(per_sum(letters) / count, 40),
            hits / count, np.log1p(kinds(h[hit], letters.doc[hit])), per_doc(letters.doc[_among(h, self.severe)]) / count,
            np.maximum(seen - hits, 0) / count, per_doc(letters.doc[you]) / count,
            per_doc(letters.doc[hit[_near(hit, you, letters.doc, self.near)]]) / count,
            per_text(upper) / np.maximum(cased, 1), per_doc(letters.doc[capital]) / count, per_text(of_bytes(raw == 33)) / size,
            per_text(of_bytes(sign)) / size, per_text(of_bytes(same)) / size, per_text(of_bytes(_SYMBOL[raw])) / size,
            per_text(digit) / size, per_doc(letters.doc[mixed]) / count, per_doc(letters.doc[again]) / count,
            kinds(h, letters.doc) / count, per_doc(letters.doc[_among(h, self.function)]) / count,
            np.log1p(letters.counts / some), kinds(B.hashes(lines), lines.doc) / some, per_doc(chunks.doc[lone]) / np.maximum(chunks.counts, 1),
            per_doc(letters.doc[told]) / count, np.log1p(kinds(h[told], letters.doc[told])),
            per_doc(letters.doc[told[_near(told, you, letters.doc, self.near)]]) / count, strongest,
        ], 1).astype(np.float64)


def per_sum(words: B.Words) -> np.ndarray:
    """Bytes in the words of each text."""
    sums = np.r_[0, np.cumsum(words.end - words.start)]
    return (sums[words.first[1:]] - sums[words.first[:-1]]).astype(float)


def feature_arrays(make: Features, column: pa.Array) -> list[pa.Array]:
    """One list of doubles for each text."""
    values = make(column)
    at = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return [pa.ListArray.from_arrays(at, pa.array(values.reshape(-1)))]
