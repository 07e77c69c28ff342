"""BPE encoding and decoding by a prefix-sharing trie traversal.

The last token of the encoding of each prefix decides the whole encoding: take it away and what
is left is the encoding of a shorter prefix. Distinct words are put in order, which is the
depth-first order of their trie; a word keeps the last-token states of the prefix that it shares
with its predecessor and computes only the rest, so that shared prefixes are encoded once.

Cases: a null text counts as empty (no ids, empty decoded text); special tokens written in a text
become their ids, as in the tokenizers library; the vocabulary file is a parameter and is read
from where the library of public tokenizers keeps it, on each executor; rows that repeat, and rows
with null or repeated ids, are encoded each for itself; a very long text is encoded whole by one task,
its pre-tokens hashed in blocks; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import BYTE, is_in, pieces, text_arrays, word_hashes

#: The pre-tokenizer's pattern of byte-level BPE files that use the usual regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept between batches by a Python worker; beyond it the store starts anew.
KEPT_WORDS = 600_000
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of all bytes: visible Latin-1 characters stand for themselves, others
    for the next free characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library, and ids of whole texts by a store of
    pre-tokens; learn() gives the ids of pre-tokens that the store lacks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(alphabet[c] for c in token)
        self.id_of = {token: i for i, token in enumerate(self.bytes_of) if token}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.merges = [tuple(pair if isinstance(pair, list) else pair.split(" ")) for pair in spec["model"]["merges"]]
        self.vocab = vocab
        self.cut = regex.compile(PATTERN)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[bytes, bytes] = {}
        self.forget()
        digits = [f"{i},".encode() for i in range(len(self.bytes_of))]
        self.digits, self.digit_mask = table(digits)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.at = self.size.cumsum() - self.size

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        raise NotImplementedError

    def _ids(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) > KEPT_WORDS:
                known.clear()
                new = list(set(words))
            known.update(self.learn(new))
        return list(map(known.__getitem__, words))

    def _slow(self, text: str) -> np.ndarray:
        """Ids of a text with special tokens or with characters that need the full pattern."""
        body = []
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            body += [array("I", [self.special[part]]).tobytes()] if k % 2 else self._ids([w.encode() for w in self.cut.findall(part)])
        return np.frombuffer(b"".join(body), np.uint32)

    def _places(self, hashes: np.ndarray, words: Callable[[np.ndarray], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Place and size in self.store of the ids of each word, by sorted distinct hashes; words()
        gives the bytes of those at some indices."""
        if len(self.hashes) > KEPT_WORDS:
            self.forget()
        missing = ~is_in(self.hashes, hashes)
        if missing.any():
            which = np.flatnonzero(missing)
            own = words(which)
            learnt = self.learn(own)
            found = [learnt[w] for w in own]
            size = np.array([len(f) for f in found], np.int64) // 4
            fresh = np.frombuffer(b"".join(found), np.uint32)
            to = np.searchsorted(self.hashes, hashes[which])
            self.places = np.insert(self.places, to, len(self.store) + size.cumsum() - size)
            self.sizes = np.insert(self.sizes, to, size)
            self.hashes = np.insert(self.hashes, to, hashes[which])
            self.store = np.concatenate([self.store, fresh])
        at = np.searchsorted(self.hashes, hashes)
        return self.places[at], self.sizes[at]

    def forget(self) -> None:
        self.hashes, self.places, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Pre-tokens are cut and told apart in numpy; only distinct ones are
        looked up, and those not met before are encoded together."""
        data, offsets = text_arrays(column)
        start, slow = pre_tokens(data, offsets)
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            slow = slow | np.array([any(s.encode() in raw[a:b] for s in self.special) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        end = np.append(start[1:], len(data))
        hashes, first, which = np.unique(word_hashes(data, start, end, BYTE), return_index=True, return_inverse=True)
        at, size = self._places(hashes, lambda k: [raw[i:j] for i, j in zip(start[first[k]].tolist(), end[first[k]].tolist(), strict=True)])
        each = size[which]
        total = np.concatenate([[0], each.cumsum()])
        ids = self.store[np.repeat(at[which] - total[:-1], each) + np.arange(total[-1])]
        of_row = total[np.searchsorted(start, offsets)].tolist()
        out = [ids[i:j] for i, j in zip(of_row[:-1], of_row[1:], strict=True)]
        for k in np.flatnonzero(slow).tolist():
            out[k] = self._slow(raw[offsets[k] : offsets[k + 1]].decode())
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become replacement marks."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        at = np.repeat(self.at[ids] - (size.cumsum() - size), size)
        return self.flat[at + np.arange(len(at))].tobytes().decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.digits[ids][self.digit_mask[ids]].tobytes()[:-1]


#: Classes of bytes for pre_tokens: other, letter (with all bytes beyond ASCII), digit, white space.
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
KIND[[32, *range(9, 14)]] = 3


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of PATTERN begin, for texts whose characters beyond ASCII are Latin
    letters from U+00C0 to U+024F, and which texts hold others (their cuts don't count)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, bool)
    kind = KIND[data]
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    begin = row[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # a run other than white space: the white space before it, if any, stands alone or, as a space, joins it
    runs = np.flatnonzero(begin & (kind != 3) & ~row[:n])
    runs = runs[kind[runs - 1] == 3]
    begin[runs - 1] = True
    begin[runs[data[runs - 1] == 32]] = False
    # contractions: an apostrophe that begins a token, then one of a few endings
    mark = np.flatnonzero((data == 39) & begin)
    mark = mark[(mark + 1 < n)]
    mark = mark[~row[mark + 1]]
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    inside = ~np.concatenate([row, np.ones(3, bool)])
    one = np.isin(padded[mark + 1], list(b"stmd"))
    two = np.zeros(len(mark), bool)
    for a, b in (b"re", b"ve", b"ll"):
        two |= (padded[mark + 1] == a) & (padded[mark + 2] == b) & inside[mark + 2]
    for these, size in ((mark[one], 2), (mark[two], 3)):
        begin[these + 1] = False
        after = these + size
        after = after[(after < n) & inside[after]]
        begin[after[kind[after] == 1]] = True
    # characters that need the full pattern
    high = np.flatnonzero(data >= 128)
    odd = np.zeros(len(offsets) - 1, bool)
    if len(high):
        lead, follow = data[high], padded[high + 1]
        fine = (lead < 0xC0) | (lead == 0xC3) & (follow != 0x97) & (follow != 0xB7) | (lead > 0xC3) & (lead < 0xC9) | (lead == 0xC9) & (follow < 0x90)
        odd[np.searchsorted(offsets, high[~fine], "right") - 1] = True
    return np.flatnonzero(begin), odd


def table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, and which of its cells they fill."""
    width = max(map(len, values))
    cells = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)
    return cells, np.arange(width) < np.array([len(v) for v in values])[:, None]


class Codec(Vocabulary):
    """The trie encoder. An automaton of all tokens names, after each byte, the tokens that end
    there, longest first; the one that stays apart from the last token before it is the last token."""

    def __init__(self, path: str):
        super().__init__(path)
        raw = {t: self.bytes_of[i] for t, i in self.vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for k, (left, right) in enumerate(self.merges):
            joined = self.id_of[raw[left] + raw[right]]
            self.rank[self.vocab[left], self.vocab[right]] = k
            self.parts.setdefault(joined, (self.vocab[left], self.vocab[right]))
            self.made.setdefault(joined, k)
        self.fits: dict[int, bool] = {}
        self._automaton()

    def _automaton(self) -> None:
        step: dict[int, int] = {}
        ends: list[tuple[int, int] | None] = [None]
        level: list[tuple[int, int, int]] = []
        for token, i in self.id_of.items():
            node = 0
            for byte in token:
                node = step.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(None)
            ends[node] = (i, len(token))
        children: list[list[tuple[int, int]]] = [[] for _ in ends]
        for key, node in step.items():
            children[key >> 8].append((key & 255, node))
        back = [0] * len(ends)
        tokens: list[tuple] = [()] * len(ends)  # tokens that end in a node's string, longest first
        level = [(0, byte, node) for byte, node in children[0]]
        while level:
            below = []
            for parent, byte, node in level:
                at = back[parent]
                while parent and at and (at << 8 | byte) not in step:
                    at = back[at]
                back[node] = step.get(at << 8 | byte, 0) if parent else 0
                tokens[node] = ((ends[node],) if ends[node] else ()) + tokens[back[node]]
                below += [(node, b, n) for b, n in children[node]]
            level = below
        self.step, self.back, self.tokens = step, back, tokens

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart when their bytes stand side by side.

        Merges run in order of rank. The last merge inside either token is undone step by step;
        at each step the two pieces that meet at the border must not have a merge that would have
        come before the one undone last (at the same rank, the left one comes first)."""
        a, b, before = left, right, len(self.merges) + 1
        while self.rank.get((a, b), before) >= before:
            ra, rb = self.made.get(a, -1), self.made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, self.parts[a][1]
            else:
                before, b = rb + 1, self.parts[b][0]
        return False

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (unsigned 32-bit, little-endian) of each word, by a depth-first walk of their trie."""
        out: dict[bytes, bytes] = {}
        fits, step, back, tokens, stays = self.fits, self.step, self.back, self.tokens, self.stays
        if len(fits) > 1_000_000:
            fits.clear()
        last: list[int] = [-1]  # by length of the prefix: its last token, that token's length, the automaton's node
        size: list[int] = [0]
        nodes: list[int] = [0]
        before = b""
        for word in sorted(words):
            n, most = 0, min(len(before), len(word))
            while n < most and before[n] == word[n]:
                n += 1
            del last[n + 1 :], size[n + 1 :], nodes[n + 1 :]
            node, end = nodes[n], n
            for byte in word[n:]:
                end += 1
                after = step.get(node << 8 | byte)
                while after is None:
                    if not node:
                        raise ValueError("a byte is missing in the vocabulary")
                    node = back[node]
                    after = step.get(node << 8 | byte)
                node = after
                for token, length in tokens[node]:
                    prior = last[end - length]
                    if prior < 0:
                        break
                    pair = prior << 32 | token
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = stays(prior, token)
                    if ok:
                        break
                last.append(token)
                size.append(length)
                nodes.append(node)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[word] = array("I", ids).tobytes()
            before = word
        return out


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, outputs: Iterable[str] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the chosen columns of OUTPUTS for each row of docs (doc_id, text); other columns
    of docs play no part. A row is encoded where it lies, without a shuffle."""
    outputs = list(outputs)

    def rows(batches):
        own = codec(path)
        for batch in pieces(batches):
            out: dict[str, list] = {k: [] for k in outputs}
            for ids in own.encode(batch.column("text")):
                text = own.decode(ids) if {"decoded", "decoded_sha256"} & out.keys() else ""
                for k, values in out.items():
                    if k == "n_tokens":
                        values.append(len(ids))
                    elif k == "ids":
                        values.append(ids.astype(np.int32))
                    elif k == "decoded":
                        values.append(text)
                    else:
                        values.append(hashlib.sha256(own.decimal(ids) if k == "ids_sha256" else text.encode()).hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k], kinds.get(k, pa.string())) for k in outputs)], names=["doc_id", *outputs])

    return docs.select("doc_id", "text").mapInArrow(rows, ", ".join(["doc_id long", *(f"{k} {OUTPUTS[k]}" for k in outputs)]))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and of decoded texts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))
