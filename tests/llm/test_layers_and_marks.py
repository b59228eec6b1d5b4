"""Wrapped base64 of any width, all of zlib's headers, further escapes; ids where a mark follows what isn't a letter."""

import base64
import gzip
import random
import urllib.parse
import zlib

import numpy as np
import pytest

pytest.importorskip("sievework.llm")
public = pytest.importorskip("public_tokenizers")

from sievework.llm import huffman_ids, secret_scan  # noqa: E402

SECRET = "token=abcdef0123456789ZZ"
RNG = random.Random(3)
TEXT = " ".join("".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RNG.randrange(2, 9))) for _ in range(30)) + f" {SECRET} x"


def found(text):
    return any(k == "assign" and 4 <= s < e <= len(text) + 4 for s, k, e in secret_scan.scan(f"see {text} end")[1])


@pytest.mark.parametrize("width", [16, 20, 56, 60, 64, 76])
@pytest.mark.parametrize("gap", ["\n", "\r\n", "\n  ", "\n\t", "\\n", "\\r\\n", "\\\n"])
def test_wrapped_lines(width, gap):
    whole = base64.b64encode(gzip.compress(TEXT.encode())).decode()
    assert found("\n" + gap.join(whole[k : k + width] for k in range(0, len(whole), width)) + "\n")


@pytest.mark.parametrize("window", range(9, 16))
@pytest.mark.parametrize("level", [0, 1, 6, 9])
def test_zlib_headers(window, level):
    c = zlib.compressobj(level, 8, window)
    data = c.compress(TEXT.encode()) + c.flush()
    assert data[:2] in secret_scan.ZLIB
    for text in (base64.b64encode(data).decode(), urllib.parse.quote(data), urllib.parse.quote(data, safe="")):
        assert found(text)


@pytest.mark.parametrize("text", ["token&equals;abcdef0123456789ZZ", r"\164\157\153\145\156=abcdef0123456789ZZ", "line one then\\ntoken&#61;abcdef0123456789ZZ"])
def test_other_escapes(text):
    assert found(text)


def test_single_line_before_a_shorter_one():
    assert found(base64.b64encode(SECRET.encode()).decode() + "\nend")


def test_ids_behind_marks():
    """A capital I with a dot normalises to a letter and a mark, which goes with the punctuation behind it."""
    from tokenizers import Tokenizer

    file = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    library.no_truncation()
    library.no_padding()
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = ["GELDİ.", "bİ;", "İ.", "İa."] + [f"{head}{m}{end}" for head in "aİéж" for m in marks for end in ".,;:!?"]
    rng = random.Random(5)
    some = [*"abcABCİıßéÉΣσς中ﬁǅ1ª.,;:!? -'", *marks]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 12))) for _ in range(5000)]
    with open(file, "rb") as f:
        got = huffman_ids.Encoder(f.read()).encode(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_symbols_behind_a_letter_are_cut_off():
    """Runs of symbols need no normaliser behind a letter; ids are the library's for any mixture, special tokens and contractions too."""
    from tokenizers import Tokenizer

    file = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    library.no_truncation()
    library.no_padding()
    rng = random.Random(9)
    pieces = [*"ab'sté\u0130\u01c5\u0301\u0338ß9٣_-.,!$%&*#<>|@\"\\^`~\u2026", "ll", "***", ".%%%", "'re", "<|endoftext|>", "<|startoftext|>", "AB", "中", "\u1e9e"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    texts += [" ".join(texts[k : k + 7]) for k in range(0, 7_000, 7)]
    with open(file, "rb") as f:
        encoder = huffman_ids.Encoder(f.read())
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    asked, whole = [], encoder.whole
    encoder.whole = lambda s: asked.append(s) or whole(s)
    encoder.encode([f"word{chr(97 + a)}{chr(97 + b)}{tail}" for a in range(26) for b in range(26) for tail in ("$$$", ".%%%", ",***", "!!", "&&&")])
    assert len(asked) <= 5
