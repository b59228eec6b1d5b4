"""Secrets in layers that aren't clean text, or that begin inside a run."""

import base64
import bz2
import gzip
import lzma
import zlib

import pytest

pytest.importorskip("sievework.llm")

from sievework.llm import secret_scan  # noqa: E402

SECRET = "token=abcdef0123456789ZZ"
B64 = lambda b: base64.b64encode(b).decode()


@pytest.mark.parametrize(
    "text",
    [
        B64(b"\x00\x07" + SECRET.encode() + b" \x00\x01"),
        B64(SECRET.encode() + " caf\xe9".encode("latin-1")),
        *("/api/v1/callback/" + "x" * k + B64(SECRET.encode()) for k in range(4)),
        "/api/v1/callback/" + B64(gzip.compress(SECRET.encode())),
        "%E9" + "".join(f"%{b:02x}" for b in SECRET.encode()),
        *(B64(f(b"first member") + f(SECRET.encode())) for f in (gzip.compress, zlib.compress, bz2.compress, lzma.compress)),
    ],
)
def test_secrets_in_odd_places(text):
    text = "see " + text + " end"
    _, more, _ = secret_scan.scan(text)
    assert any(k == "assign" and 4 <= s < e <= len(text) - 4 for s, k, e in more)
    out = secret_scan.redact(text, "[secret]")
    assert not secret_scan.scan(out)[1] and out.startswith("see ") and out.endswith(" end")
