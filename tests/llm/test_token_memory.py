"""Memory of the word tables."""

import numpy as np
import pyarrow as pa

from voicegrid.llm import tokens
from voicegrid.llm.tokens import WordTokenizer, default_tokenizer


def test_word_tables_stay_small_and_ids_the_same():
    words = WordTokenizer(default_tokenizer())
    text = b" ".join(b"w%d" % i for i in range(170_000))
    first = words.encode(text)
    assert len(words.kept) + len(words.kept.old) <= 160_000
    assert words.encode(text) == first


def _words(n: int) -> list[str]:
    return ["".join(chr(97 + i // 26 ** k % 26) for k in range(4)) for i in range(n)]


def test_each_word_is_encoded_once():
    own, some = WordTokenizer(default_tokenizer()), _words(100_000)
    pieces, met = own.kept.pieces, []
    own.kept.pieces = lambda word: met.append(word) or pieces(word)
    forms = ("{}", "{},", "{}.###", "{}")
    got = own.encode(" ".join(form.format(w if k < 3 else w.title()) for k, form in enumerate(forms) for w in some).encode())
    assert len(met) <= len(some) + len(forms)
    text = " ".join(form.format(w) for form in forms for w in some[-50:])
    assert np.frombuffer(own.encode(text.encode()), own.type).tolist() == own.library.encode(text, add_special_tokens=False).ids
    assert len(got) > 4 * len(text)
    own.close()
    assert not (own.kept or own.kept.old or len(own.chunks) or len(own.ids))


def test_table_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_BYTES", 1 << 16)
    own, some = WordTokenizer(default_tokenizer()), _words(6_000)
    for texts in (some[:1000], some, some[500:1500], some[:1000]):
        got = own.encode_all(pa.array(texts, pa.string())).to_pylist()
        assert own.chunks.nbytes + own.ids.nbytes <= 1 << 16 and len(own.chunks) == len(own.ids)
        assert [np.frombuffer(x, own.type).tolist() for x in got] == [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]


def test_many_texts_at_once():
    own = WordTokenizer(default_tokenizer())
    texts = ["left out", None, "", " \n", "H̱A ẗT, W̊. J̌ ǰ", "<|startoftext|> A <|STARTOFTEXT|>, b<|endoftext|>.", "Don't, IT'S. dogs' , x'.\t",
             "KÅ, İI. ÉTÉ!! “So” – a B,\x0bc", "abc.,;  12,3 (A) 'S", None]
    part = pa.array(texts, pa.string()).slice(1)
    want = [own.library.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
    assert [np.frombuffer(x, own.type).tolist() for x in own.encode_all(part).to_pylist()] == want
    assert own.encode_all(part.slice(0, 0)).to_pylist() == [] and own.encode(None) == own.encode(b"") == b""
