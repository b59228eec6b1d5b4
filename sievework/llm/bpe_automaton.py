"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the sequences that BPE makes. It starts as one state with a loop for each
byte; each merge (u, v) -> w, in order, adds a gadget (Berglund, Martens and van der Merwe, 2024): the state that u leads to
is copied without its arc for v, u's arcs are led to the copy, and every state that had an arc for u gets one for w, which
leads to where v led. All arcs with one label lead to one state, so the state behind a sequence is that of its last token.

Texts are bytes, so this automaton is compiled into a deterministic one over bytes. Every string has one accepted sequence,
and so has each of its prefixes. A byte state is the set of labels that the bytes so far may be in the midst of, each
with the token before it; its next byte moves on all labels, and of those that end there exactly one has an arc from the
token before it: that is the last token of the prefix. The byte automaton's rows are made when they are first used, as its
states are those that texts reach, and kept in a bounded table. Encoding a pre-split word is then one look-up per byte, and
the last tokens, read from the end of the word, are its ids; nothing is searched. Decoding emits the arcs' labels.

Text is first split by the vocabulary's public pattern; stretches between single spaces are split and encoded once and
then kept in a bounded table.

Cases: null is an empty text, which has no ids; special tokens in a text are themselves (as the tokenizers library does by
default); a vocabulary in which two merges make one token is refused when it is read, and a byte that it lacks when it
comes (ValueError; byte-level vocabularies have neither); repeated rows each get a result; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sievework.llm.common import columns_only, local_file, map_rows

#: The public pattern of byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Marks that end a stretch often; behind a letter each is a word of the pattern.
_MARKS = frozenset(",.;:!?")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable, else the next code from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


class Automaton:
    """The states and arcs that the merges make, and the byte automaton over them; tokens are the file's ids.

    A token's arcs and state change as merges are added. The copies of the state behind u are: one for each gadget (u, v),
    in order; before u was made by (a, b), those that b's state had by then; and so on down u's right spine. The newest copy is
    the state behind u. Likewise an arc for a token goes back to its left side, where its state was copied after the token's
    merge. So there is no arc for T behind u exactly if some gadget (x, t), x on u's right spine and t on T's left spine,
    fell into the time in which both x's state and t's arc were the ones that count.
    """

    #: States of the byte automaton that are kept; beyond that the table starts anew.
    MOST = 250_000

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = {i: t for t, i in vocabulary.items()}
        always = 1 << 60
        self.right: dict[int, tuple] = {}  # token: its right spine, each with the time until which that state counts
        self.left: dict[int, tuple] = {}  # token: its left spine, each with the time until which that arc counts
        self.gadget: dict[tuple[int, int], int] = {}  # (u, v): the time at which the state behind u lost its arc for v
        for b in range(256):
            if (i := vocabulary.get(bytes([b]))) is not None:
                self.right[i] = self.left[i] = ((i, always),)
        for time, (a, b) in enumerate(merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if w in self.left:
                raise ValueError("two merges make one token")
            if u not in self.left or v not in self.left or not self.arc(u, v):
                continue  # u and v never stand side by side: no gadget, and no arc for w
            self.gadget[u, v] = time
            self.right[w] = ((w, always), *((x, min(time, until)) for x, until in self.right[v]))
            self.left[w] = ((w, always), *((t, min(time, until)) for t, until in self.left[u]))
        self.ids = {t: i for t, i in vocabulary.items() if i in self.left}
        # A trie of the labels: (node, byte) to node, and the token that ends at a node.
        self.next: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for label, i in self.ids.items():
            node = 0
            for byte in label:
                node = self.next.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = i
        self.inner = {key >> 8 for key in self.next}  # nodes with labels below them
        self.forget()

    def forget(self) -> None:
        """Starts the byte automaton anew."""
        start = ((0, -1),)
        self.state = {start: 0}
        self.inside: list[tuple] = [start]  # the (trie node, token before) pairs of each state
        self.rows: list[dict[int, int]] = [{}]
        self.last, self.back = [-1], [0]  # the last token of the bytes so far, and its number of bytes

    def arc(self, u: int, t: int) -> bool:
        """Whether the state behind token u has an arc for token t."""
        gadget = self.gadget
        for x, until in self.right[u]:
            for y, last in self.left[t]:
                if (m := gadget.get((x, y))) is not None and m < until and m <= last:
                    return False
        return True

    def step(self, s: int, byte: int) -> int:
        """Makes the transition of a state for a byte."""
        onward, ends, moved, token = self.next, self.ends, [], -1
        for at, before in self.inside[s]:
            if (node := onward.get(at << 8 | byte)) is not None:
                if node in self.inner:
                    moved.append((node, before))
                if token < 0 and (t := ends[node]) >= 0 and (before < 0 or self.arc(before, t)):
                    token = t
        if token < 0:
            raise ValueError("a byte of the text is not in the vocabulary")
        pairs = (*moved, (0, token))
        if (to := self.state.get(pairs)) is None:
            to = self.state[pairs] = len(self.rows)
            self.inside.append(pairs)
            self.rows.append({})
            self.last.append(token)
            self.back.append(len(self.label[token]))
        self.rows[s][byte] = to
        return to

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted sequence whose labels join to the word."""
        if (whole := self.ids.get(word)) is not None:
            return [whole]
        if len(self.rows) > self.MOST:
            self.forget()
        rows, s, path = self.rows, 0, []
        for byte in word:
            s = rows[s].get(byte) or self.step(s, byte)
            path.append(s)
        out, last, back, n = [], self.last, self.back, len(word)
        while n:
            s = path[n - 1]
            out.append(last[s])
            n -= back[s]
        return out[::-1]


class Kept(dict):
    """A table that is filled on look-up, from an older table or by `make`."""

    def __init__(self, make, older: Kept | None = None):
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, key):
        value = None if self.older is None else self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def bounded(self, most: int) -> Kept:
        """This table, or a new one over it when it is full; what wasn't looked up for two turns is gone."""
        if len(self) < most:
            return self
        self.older = None
        return Kept(self.make, self)


class Codec:
    """Encoder and decoder for one vocabulary file in the tokenizers library's format (byte-level BPE)."""

    def __init__(self, file: bytes, keep: int):
        """keep: stretches of text whose ids are kept, up to twice as many for a while, and half as many words."""
        self.keep = keep
        data = json.loads(file)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.automaton = Automaton({raw(t): i for t, i in data["model"]["vocab"].items()}, [(raw(a), raw(b)) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(PATTERN)
        self.labels = self.automaton.label | {i: t.encode() for t, i in self.special.items()}
        self.words = Kept(lambda w: tuple(self.automaton.encode_word(w.encode("utf-8", "surrogatepass"))))
        self.stretches = Kept(self._ids)
        self.decimal = {i: str(i) for i in self.labels}

    def forget(self) -> None:
        """Frees what was kept of texts."""
        self.words, self.stretches = Kept(self.words.make), Kept(self.stretches.make)
        self.automaton.forget()

    def _ids(self, text: str) -> tuple[int, ...]:
        if (text[1:] if text[:1] == " " else text).isalpha():  # one word of the pattern
            return self.words.make(text)
        if text[-1:] in _MARKS and text[1:-1].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.stretches[text[:-1]] + self.words[text[-1]]
        return tuple(chain.from_iterable(map(self.words.__getitem__, self.split.findall(text))))

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or "\0" in text:
            return [self._ids(text)]
        # A single space between other characters always starts a word of the pattern, so stretches are independent.
        return [*map(self.stretches.__getitem__, text.replace(" ", "\0 ").split("\0"))]

    def encode(self, text: str | None) -> list[int]:
        text = text or ""
        self.words, self.stretches = self.words.bounded(self.keep // 2), self.stretches.bounded(self.keep)
        if self.split_special is None or not any(s in text for s in self.special):
            done = self._plain(text)
        else:
            done = []
            for p in self.split_special.split(text):
                done += [(self.special[p],)] if p in self.special else self._plain(p)
        return [*chain.from_iterable(done)]

    def joined(self, ids: list[int]) -> str:
        """The ids as decimals, comma-joined."""
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The labels' bytes as UTF-8; bytes that aren't become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _codec(digest: bytes, file: bytes) -> Codec:
    return Codec(file, 0)


def codec(file: bytes, keep: int = 240_000) -> Codec:
    """One codec per worker process and vocabulary."""
    out = _codec(hashlib.sha256(file).digest(), file)
    out.keep = keep
    return out


def encode(docs: DataFrame, vocabulary: str, keep: int = 80_000) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text. keep: see Codec; a larger table is faster and takes more memory."""
    file = docs.sparkSession.sparkContext.broadcast(local_file(vocabulary))

    def rows(it):
        c = codec(file.value, keep)
        for doc_id, text in it:
            yield doc_id, c.encode(text)
        c.forget()

    return map_rows(columns_only(docs, "doc_id", "text"), rows, "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text)."""
    file = encoded.sparkSession.sparkContext.broadcast(local_file(vocabulary))

    def rows(it):
        c = codec(file.value)
        for doc_id, ids in it:
            yield doc_id, c.decode(ids or [])

    return map_rows(columns_only(encoded, "doc_id", "ids"), rows, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes and decodes every whole text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    file = docs.sparkSession.sparkContext.broadcast(local_file(vocabulary))

    def rows(it):
        c = codec(file.value)
        for doc_id, text in it:
            ids = c.encode(text)
            joined, decoded = c.joined(ids), c.decode(ids)
            yield doc_id, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return map_rows(columns_only(docs, "doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", schema)
