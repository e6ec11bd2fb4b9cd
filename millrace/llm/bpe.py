"""Byte-level BPE by a segment tree over byte positions.

A leaf holds the rank of the pair that begins at its position (with the position below it, so the
smallest value is the leftmost pair of least rank); inner nodes hold the minimum of their children.
A merge takes the root, joins two live neighbours and updates the leaves of the joined part, of the
part before it and of the part that went, each along one path to the root.

Pieces of up to 64 bytes are merged many at a time, one numpy column a piece; longer ones, of any
length, by the same tree one at a time, in time n log n. Ids of pieces are kept in a dictionary of
bounded size in each Python worker.

Defined cases: a null text is an empty one and has no ids; repeated rows are encoded alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import regex
from pyspark.sql import DataFrame

from millrace.llm.batches import map_texts

#: Pieces whose ids a worker keeps; when there are more, it starts anew.
KEPT_PIECES = 200_000
_NONE = np.int32(2**31 - 1)

#: Characters for which the plain patterns below split as the given one does.
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
#: The pattern for which the short cut holds; with any other one, that pattern is used throughout.
_KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


class Vocabulary:
    """Ranks from a file of base64 tokens; pairs: which two tokens make which third."""

    def __init__(self, path: str):
        self.rank = {base64.b64decode(token): int(number) for token, number in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, number in self.rank.items():
            self.token[number] = token
        self.size = len(self.token)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, number in self.rank.items():
            for k in range(1, len(token)):
                left, right = self.rank.get(token[:k]), self.rank.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = number
        self.pair_rank = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where two tokens make none."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], np.int32(-1))

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one piece by its own segment tree."""
        n = len(piece)
        leaves = 1 << max(0, n - 1).bit_length()
        ids, after, before = [int(self.byte[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        none = (self.size * leaves, 0)
        tree, pairs, size = [none[0]] * (2 * leaves), self.pair_rank, self.size

        def value(p: int) -> int:
            r = after[p]
            rank = pairs.get(ids[p] * size + ids[r]) if r < n else None
            return none[0] if rank is None else rank * leaves + p

        for p in range(n):
            tree[leaves + p] = value(p)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(p: int, new: int) -> None:
            node = leaves + p
            tree[node] = new
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        alive = [True] * n
        while tree[1] < none[0]:
            rank, p = divmod(tree[1], leaves)
            gone = after[p]
            ids[p], alive[gone] = rank, False
            after[p] = after[gone]
            if after[p] < n:
                before[after[p]] = p
            put(gone, none[0])
            put(p, value(p))
            if before[p] >= 0:
                put(before[p], value(before[p]))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def merge_many(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """The ids, as bytes, of pieces of 2 to `leaves` bytes each; one column of the trees a piece."""
        m, bits = len(pieces), leaves.bit_length() - 1
        lengths = np.fromiter(map(len, pieces), np.int32, m)
        raw = np.frombuffer(b"".join(x.ljust(leaves, b"\0") for x in pieces), np.uint8).reshape(m, leaves)
        ids = np.ascontiguousarray(self.byte[raw].T)  # position, piece
        inside = np.arange(leaves, dtype=np.int32)[:, None]
        alive = inside < lengths[None, :]
        after = np.repeat(inside + 1, m, axis=1)
        before = np.repeat(inside - 1, m, axis=1)
        tree = np.full((2 * leaves, m), _NONE, np.int32)
        rank = self.ranks_of(ids[:-1], ids[1:])
        tree[leaves : 2 * leaves - 1] = np.where((rank >= 0) & alive[1:], (rank << bits) | inside[:-1], _NONE)
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
        live = np.flatnonzero(tree[1] < _NONE)
        while len(live):
            root = tree[1, live]
            p, new = root & (leaves - 1), root >> bits
            gone = after[p, live]
            ids[p, live] = new
            alive[gone, live] = False
            following = after[gone, live]
            after[p, live] = following
            ended = following >= lengths[live]
            inner = np.minimum(following, leaves - 1)
            before[inner[~ended], live[~ended]] = p[~ended]
            tree[leaves + gone, live] = _NONE
            rank = np.where(ended, np.int32(-1), self.ranks_of(new, ids[inner, live]))
            tree[leaves + p, live] = np.where(rank >= 0, (rank << bits) | p, _NONE)
            previous = before[p, live]
            has = previous >= 0
            q, own = previous[has], live[has]
            rank = self.ranks_of(ids[q, own], new[has])
            tree[leaves + q, own] = np.where(rank >= 0, (rank << bits) | q, _NONE)
            for leaf, column in ((gone, live), (p, live), (q, own)):
                node = (leaf + leaves) >> 1
                for _ in range(bits):
                    tree[node, column] = np.minimum(tree[2 * node, column], tree[2 * node + 1, column])
                    node = node >> 1
            live = live[tree[1, live] < _NONE]
        flat = ids.T[alive.T].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=0))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Texts to ids and back."""

    def __init__(self, path: str, pattern: str):
        self.words = Vocabulary(path)
        self.pattern = regex.compile(pattern)
        self.plain = pattern == _KNOWN
        self.kept: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return (_SPLIT if self.plain and _PLAIN.fullmatch(text) else self.pattern).findall(text)

    def _learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces into kept."""
        sized: dict[int, list[str]] = {}
        for piece in pieces:
            raw = piece.encode()
            number = self.words.rank.get(raw)
            if number is not None:
                self.kept[piece] = number.to_bytes(4, "little")
            elif len(raw) > 64:
                self.kept[piece] = np.array(self.words.merge_long(raw), "<u4").tobytes()
            else:
                sized.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append(piece)
        for leaves, some in sized.items():
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                self.kept.update(zip(part, self.words.merge_many([x.encode() for x in part], leaves), strict=True))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        if len(self.kept) > KEPT_PIECES:
            self.kept = {}
        missing = set().union(*split).difference(self.kept)
        if missing:
            self._learn(missing)
        get = self.kept.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: the number of ids, the digests of ids and of the decoded bytes; with_ids: the ids too.

    path is that of the rank file on the executors, where the vocabulary is installed as on the driver.
    """

    def per_slice(ids: list, texts: list[bytes | None]) -> dict[str, list]:
        own = encoder(path, pattern)
        coded = own.encode_many([(t or b"").decode() for t in texts])
        out = {
            "doc_id": ids,
            "n_tokens": [len(c) // 4 for c in coded],
            "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded],
            "decoded_sha256": [hashlib.sha256(own.decode(c)).hexdigest() for c in coded],
        }
        return out | ({"ids": [np.frombuffer(c, "<u4").astype(np.int32) for c in coded]} if with_ids else {})

    return map_texts(docs, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, per_slice)
