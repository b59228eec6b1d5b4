"""Compressed layers: depth, size, members, damage and cycles."""

import base64
import bz2
import gzip
import lzma
import random

import pytest
import zstandard

from sievework.llm import secret_scan

SECRET = b"password=abcdefghijklmnop"


def wrapped(data: bytes) -> str:
    return "see " + base64.b64encode(data).decode() + " end"


def found(data: bytes) -> bool:
    text = wrapped(data)
    _, more, _ = secret_scan.scan(text)
    return any(kind == "assign" and start <= 4 and end >= len(text) - 4 for start, kind, end in more)


def test_depth_is_no_recursion():
    data = SECRET
    for _ in range(1500):
        data = gzip.compress(data, 9)
    assert found(data)


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_stream_within_a_stream_larger_than_what_is_held(pack):
    inner = b"\0" * (2 * secret_scan.KEEP) + b" " + SECRET
    assert found(pack(inner))
    assert found(gzip.compress(pack(inner)))


def test_large_stream_at_a_place_within_a_large_stream():
    inner = gzip.compress(b"\1" * (2 * secret_scan.KEEP) + bz2.compress(SECRET))
    assert found(gzip.compress(b"x y " * secret_scan.KEEP + inner))


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_members_in_a_row(pack):
    assert found(pack(b"hello") + pack(b"world") + pack(SECRET))


def test_a_secret_that_two_members_share():
    assert found(gzip.compress(SECRET[:12]) + gzip.compress(SECRET[12:]))


def test_damaged_and_cut_streams_are_read_as_far_as_they_go():
    noise = random.Random(1).randbytes(60_000)
    whole = gzip.compress(SECRET * 3 + noise)
    assert found(whole[:30_000])
    assert found(whole[:30_000] + b"??????" + whole[30_006:])


class _Same:
    """A decompressor whose content is its input."""

    def __init__(self):
        self.eof, self.unused_data = False, b""

    def decompress(self, data: bytes, most: int) -> bytes:
        return data


@pytest.mark.parametrize("size", [100, secret_scan.KEEP + 1000])
def test_a_stream_that_holds_itself_ends(monkeypatch, size):
    monkeypatch.setattr(secret_scan, "_opened", lambda head: _Same() if head.startswith(b"\x1f\x8b") else None)
    data = b"\x1f\x8b" + b" " * size + SECRET
    _, more, n = secret_scan.scan(wrapped(data))
    assert more and n < 100


@pytest.mark.parametrize("code", ["utf-16", "utf-16-le", "utf-16-be"])
def test_utf16_in_base64_and_in_streams(code):
    data = SECRET.decode().encode(code)
    assert secret_scan.scan(wrapped(data))[1]
    assert found(gzip.compress(data))


def test_one_bad_byte_does_not_void_a_layer():
    for data in (SECRET + b"\0", b"\xe9 " + SECRET, SECRET + b"\xff\xfe\x01"):
        assert secret_scan.scan(wrapped(data))[1]
    assert secret_scan.scan("a %E9%70assword%3dabcdefghijklmnop b")[1]


def test_spans_of_runs_are_places_in_the_document():
    text = wrapped(b"\x00\x01" + SECRET + b"\x02")
    (span,) = secret_scan.scan(text)[1]
    first, last = 2 * 8 // 6, ((2 + len(SECRET)) * 8 - 1) // 6  # the base64 characters that hold bytes of the secret
    assert (span[0], span[2]) == (4 + first, 4 + last + 1)


LETTERS = bytes(random.Random(4).choices(b"ghijklmnop qrs", k=60_000))
DAMAGED = gzip.compress(SECRET * 3 + LETTERS)[:20_000]
assert SECRET not in DAMAGED
PARTS = [
    b"a damaged stream " + DAMAGED + random.Random(1).randbytes(3000) + b" behind it",
    b"a short damaged stream " + DAMAGED[:300] + b"?" * 300 + b" behind it",
    b"two words: secret=token:abcdefghijklm and more",
    b"plain words only\n\nand more of them",
    bz2.compress(b"some words " * 600 + SECRET),
    b"p\0a\0s\0s\0w\0d\0=\0a\0b\0c\0d\0e\0f\0g\0h\0i\0j\0k\0l\0m\0",
    base64.encodebytes(b"xx yy " * 30 + SECRET),
    "token%3D abcdefghijklmnop und für alle".encode(),
]


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("fill", [b"some plain words ", b"\0", b"x, y; z.\n"])
def test_large_contents_give_what_small_ones_give(monkeypatch, part, fill):
    """Windows cut where they may, at every place of the part: kinds and spans are those of a reading as a whole."""
    sizes = (5000, 5010, 5023)
    texts = [wrapped(bz2.compress(fill * (size // len(fill)) + part + fill * (9000 // len(fill)))) for size in sizes]
    whole = [set(secret_scan.scan(t)[1]) for t in texts]
    monkeypatch.setattr(secret_scan, "KEEP", 4096)
    monkeypatch.setattr(secret_scan, "WINDOW", 1024)
    monkeypatch.setattr(secret_scan, "OVERLAP", 512)
    assert [set(secret_scan.scan(t)[1]) for t in texts] == whole


def test_a_damaged_stream_in_a_content_larger_than_what_is_held():
    inner = b"x y " * secret_scan.KEEP + PARTS[0]
    assert found(bz2.compress(inner)) and found(bz2.compress(PARTS[0]))  # bz2 leaves nothing as it is


def test_no_window_begins_inside_a_word():
    """`secret=token` takes the word that would else begin an assignment, wherever windows end."""
    line = b"secret=token:abcdefghijklm "
    data = line * (secret_scan.KEEP // 20)
    assert not found(gzip.compress(line)) and not found(gzip.compress(data))
