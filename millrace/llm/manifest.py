"""A Merkle manifest of a table as a tree of SHA-256 midstates.

Every row is a leaf: the hash of its fields, each `-` if null, else its UTF-8 byte count, a colon and its
value. Leaves of one group (a language) ascend by id; every `fanout` consecutive nodes (the last run may be
shorter, even one node) become the hash of their digests, written as hex, until one is left, the group's
subroot. Subroots, ordered by group (null first), give the root in the same way.

A digest as hex fills one block of SHA-256, so the hash state before each child of a parent is a midstate of
32 bytes. Parents keep copies of these states. To fold a changed leaf, each parent on its way resumes the
state before the leaf's slot, takes the replacement and the siblings right of it, and is closed by the
padding; the siblings left of it aren't read again. States are plain numbers (numpy, all nodes of a level at
once), so they are written to tables and resumed by other tasks.

Positions come from one range partitioning by group and id; runs of some thousand leaves (CHUNK) are
one task's unit, their roots the nodes of the next round, so no group, whatever its size, is gathered,
and rounds grow with the logarithm of the rows.

Defined cases: a null id comes first in its group and is never changed; rows of one id are ordered by
their leaf, and wholly equal rows are leaves of their own; a null group is a group; null and empty texts
differ (`-` and `0:`); an empty table gives an empty result; columns that aren't fields are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rows import with_row_index
from millrace.session import discard, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves in one unit of work, at most.
CHUNK = 4096


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root(x: int, power: int) -> int:
    """The whole part of the power-th root of x."""
    low, high = 0, 1 << (x.bit_length() // power + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**power <= x else (low, mid - 1)
    return low


#: The first 32 bits behind the point of the square roots of the first 8 primes, and of the cube roots of the first 64, as SHA-256 defines them.
START = np.array([_root(p << 64, 2) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUND = np.array([_root(p << 96, 3) & 0xFFFFFFFF for p in _primes(64)], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (n x 8) after one block (n x 16 words each); either may have one row for all."""
    w = [np.ascontiguousarray(block[:, k]) for k in range(16)]
    first = [np.ascontiguousarray(state[:, k]) for k in range(8)]
    a, b, c, d, e, f, g, h = first
    for t in range(64):
        if t >= 16:
            x, y = w[(t - 15) % 16], w[(t - 2) % 16]
            w[t % 16] = w[t % 16] + w[(t - 7) % 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10)))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + _ROUND[t] + w[t % 16]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([x + y for x, y in zip(first, np.broadcast_arrays(a, b, c, d, e, f, g, h), strict=True)], axis=1)


def _as_hex(digests: np.ndarray) -> np.ndarray:
    """n x 64 characters of n digests."""
    return np.frombuffer(digests.astype(">u4").tobytes().hex().encode(), np.uint8).reshape(-1, 64)


def _block(digests: np.ndarray) -> np.ndarray:
    """The block that a digest as hex fills."""
    return _as_hex(digests).view(">u4").astype(np.uint32)


def _closed(state: np.ndarray, children: int) -> np.ndarray:
    """The digests of states that have taken so many children."""
    last = np.zeros((1, 16), np.uint32)
    last[0, 0], last[0, 14], last[0, 15] = 0x80000000, (512 * children) >> 32, (512 * children) & 0xFFFFFFFF
    return compress(state, last)


def digests_of(texts) -> np.ndarray:
    """n x 8 words from n digests as hex."""
    return np.frombuffer(bytes.fromhex("".join(texts)), ">u4").astype(np.uint32).reshape(-1, 8)


def hex_of(digests: np.ndarray) -> list[str]:
    flat = digests.astype(">u4").tobytes().hex()
    return [flat[k : k + 64] for k in range(0, len(flat), 64)]


class Level:
    """The nodes of a level and, for every run of them, the states before its slots."""

    def __init__(self, nodes: np.ndarray, fanout: int, states: np.ndarray | None = None):
        self.nodes, self.fanout, self.runs = nodes, fanout, -(-len(nodes) // fanout)
        self.widths = np.minimum(fanout, len(nodes) - fanout * np.arange(self.runs))
        if states is None:
            states = np.zeros((self.runs, fanout, 8), np.uint32)
            states[:, 0] = START
            for slot in range(1, fanout):
                has = self.widths > slot - 1
                states[has, slot] = compress(states[has, slot - 1], _block(nodes[slot - 1 :: fanout]))
        self.states = states

    def parents(self) -> np.ndarray:
        out = np.zeros((self.runs, 8), np.uint32)
        last = self.widths - 1
        taken = compress(self.states[np.arange(self.runs), last], _block(self.nodes[np.arange(self.runs) * self.fanout + last]))
        for width in np.unique(self.widths):
            out[self.widths == width] = _closed(taken[self.widths == width], int(width))
        return out

    def others(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For nodes: the places of the other children of their runs, left to right, and which of them exist."""
        slot = at % self.fanout
        other = np.arange(self.fanout - 1)[None, :]
        place = (at - slot)[:, None] + other + (other >= slot[:, None])
        return place, place < len(self.nodes)

    def fold(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The parents' digests with values in place of the nodes at these places: the states before them resumed, then what is right of them."""
        run, slot = at // self.fanout, at % self.fanout
        state = compress(self.states[run, slot], _block(values))
        width = self.widths[run]
        for k in range(1, self.fanout):
            has = slot + k < width
            if has.any():
                state[has] = compress(state[has], _block(self.nodes[at[has] + k]))
        out = np.zeros_like(state)
        for w in np.unique(width):
            out[width == w] = _closed(state[width == w], int(w))
        return out


class Tree:
    """Levels from the nodes of a chunk up to the node that stands for it in the next round."""

    def __init__(self, nodes: np.ndarray, depth: int, fanout: int):
        self.fanout, self.levels = fanout, []
        for _ in range(depth):
            self.levels.append(Level(nodes, fanout))
            nodes = self.levels[-1].parents()
        self.top = nodes[0]

    def pack(self) -> bytes:
        """Nodes and kept states of every level; the state before a first slot is always the same."""
        return b"".join(x.nodes.astype("<u4").tobytes() + np.ascontiguousarray(x.states[:, 1:]).astype("<u4").tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes, n: int, depth: int, fanout: int) -> Tree:
        out, at = cls.__new__(cls), 0
        out.fanout, out.levels = fanout, []
        for _ in range(depth):
            runs = -(-n // fanout)
            nodes = np.frombuffer(data, "<u4", n * 8, at).astype(np.uint32).reshape(n, 8)
            at += n * 32
            kept = np.frombuffer(data, "<u4", runs * (fanout - 1) * 8, at).astype(np.uint32).reshape(runs, fanout - 1, 8)
            at += runs * (fanout - 1) * 32
            states = np.concatenate([np.broadcast_to(START, (runs, 1, 8)), kept], axis=1)
            out.levels.append(Level(nodes, fanout, states))
            n = runs
        return out

    def steps(self, at: int) -> list[tuple[int, int, bytes, list[str]]]:
        """The way up from a node: its slot, the children of its run, the state before it and its siblings."""
        out = []
        for level in self.levels:
            run, slot = divmod(at, self.fanout)
            place, there = level.others(np.array([at]))
            out.append((slot, int(level.widths[run]), level.states[run, slot].astype("<u4").tobytes(), hex_of(level.nodes[place[0][there[0]]])))
            at = run
        return out


def _resume(values: np.ndarray, slot: int, width: int, state: bytes, siblings: list[str]) -> np.ndarray:
    """As Level.fold, for values that share one place above their chunk."""
    out = compress(np.frombuffer(state, "<u4").astype(np.uint32).reshape(1, 8), _block(values))
    for right in siblings[slot:]:
        out = compress(out, _block(digests_of([right])))
    return _closed(out, width)


def _depth(n: int, most: int, fanout: int) -> int:
    """Levels until one of n nodes is left, or as many as a chunk has."""
    depth = 0
    while n > 1 and depth < most:
        n, depth = -(-n // fanout), depth + 1
    return depth


def _after(n: int, depth: int, fanout: int) -> int:
    for _ in range(depth):
        n = -(-n // fanout)
    return n


_NODES = "key string, pos long, n long, digest string, size int, depth int, tree binary"
_STEPS = "slots array<int>, widths array<int>, states array<binary>, siblings array<array<string>>"


def _rounds(nodes: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Rounds of chunks, until one node of each key is left. nodes: key, pos, n (nodes of the key), digest."""
    most = int(math.log(CHUNK, fanout) + 1e-9)
    width, out = fanout**most, []

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n = int(pdf["n"].iloc[0])
        depth = _depth(n, most, fanout)
        tree = Tree(digests_of(pdf["digest"]), depth, fanout)
        row = (pdf["key"].iloc[0], int(pdf["chunk"].iloc[0]), _after(n, depth, fanout), hex_of(tree.top[None, :])[0], len(pdf), depth, tree.pack())
        return pd.DataFrame([row], columns=["key", "pos", "n", "digest", "size", "depth", "tree"])

    while True:
        out.append(materialize(nodes.select("key", "pos", "n", "digest", F.expr(f"pos div {width}").alias("chunk")).groupBy("key", "chunk").applyInPandas(build, _NODES), name))
        if (out[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return out
        nodes = out[-1]


def _ways_down(rounds: list[DataFrame], ways: DataFrame, fanout: int) -> DataFrame:
    """key, pos and the steps up to the root of every node that the first of these rounds was given. ways: the same of what the last one left."""
    width = fanout ** int(math.log(CHUNK, fanout) + 1e-9)
    given = ["key", "pos", "size", "depth", "tree", "slots", "widths", "states", "siblings"]

    def spread(frames):
        for pdf in frames:
            for key, chunk, size, depth, tree, *above in pdf[given].itertuples(index=False):
                known, rows = Tree.unpack(tree, size, depth, fanout), []
                for k in range(size):
                    own = list(zip(*known.steps(k), strict=True)) or [()] * 4
                    rows.append((key, chunk * width + k, *[[*a, *map(_plain, b)] for a, b in zip(own, above, strict=True)]))
                yield pd.DataFrame(rows, columns=["key", "pos", "slots", "widths", "states", "siblings"])

    for nodes in reversed(rounds):
        ways = nodes.join(ways, ["key", "pos"]).select(*given).mapInPandas(spread, f"key string, pos long, {_STEPS}")
    return ways


def _plain(x):
    return list(x) if isinstance(x, np.ndarray) else x


def field(c: Column) -> Column:
    """A field of a leaf: `-` if null, else byte count, colon and value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def merkle_manifest(
    docs: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None, fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2,
) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root and verified.

    proof_sha256 hashes the siblings (as hex) from the leaf's level up through the subroot's to the root's,
    left to right within a run. folded_root is the root recomputed from the row's leaf, or, for rows
    where `when` is true, from the leaf that its fields give with `changed` in place; the siblings are
    the tree's. verified: whether that is the root.
    """
    if fanout < 2:
        raise ValueError("a parent has two children at least")
    own = {f: F.col(f"`{f}`") for f in fields}
    other = F.when(when, leaf([(changed or {}).get(f, own[f]) for f in fields])) if when is not None else F.lit(None).cast("string")
    key = F.when(F.col(f"`{group_col}`").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(f"`{group_col}`").cast("string")))
    leaves = materialize(docs.select(key.alias("key"), F.col(f"`{id_col}`").alias("id"), leaf(list(own.values())).alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("row")), "leaves")
    order = [F.col("key"), F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")]
    placed = materialize(leaves.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "id", "digest", "other", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")), "placed")
    spans = placed.groupBy("part", "key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    by_key = Window.partitionBy("key")  # a row for each part that a key has rows in
    before = F.coalesce(F.sum("rows").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("part", "key", (before - F.col("first")).alias("shift"), F.sum("rows").over(by_key).alias("n"))
    nodes = placed.join(spans, ["part", "key"]).select("key", "id", "digest", "other", (F.col("at") + F.col("shift")).alias("pos"), "n")

    rounds = _rounds(nodes, fanout, "chunks")
    subroots = rounds[-1].select(F.col("key").alias("name"), F.col("digest").alias("subroot"))
    ranked = with_row_index(subroots, "name", "pos")
    tops = _rounds(ranked.select(F.lit("").alias("key"), "pos", F.lit(ranked.count()).cast("long").alias("n"), F.col("subroot").alias("digest")), fanout, "tops")
    root = (tops[-1].select("digest").first() or [None])[0]
    start = docs.sparkSession.createDataFrame([("", 0, [], [], [], [])], f"key string, pos long, {_STEPS}")
    above = ranked.join(_ways_down(tops, start, fanout).drop("key"), "pos").select(F.col("name").alias("key"), F.lit(0).cast("long").alias("pos"), "subroot", "slots", "widths", "states", "siblings")
    above = materialize(above, "above")
    ways = _ways_down(rounds[1:], above.drop("subroot"), fanout).join(above.select("key", "subroot"), "key")
    chunks = rounds[0].join(ways, ["key", "pos"]).select("key", F.col("pos").alias("chunk"), "size", "depth", "tree", "subroot", "slots", "widths", "states", "siblings")

    def fold(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows, c = rows.sort_values("pos"), known.iloc[0]
        tree = Tree.unpack(c["tree"], int(c["size"]), int(c["depth"]), fanout)
        at = np.arange(len(rows))
        stored = tree.levels[0].nodes if tree.levels else digests_of(rows["digest"])
        values = np.array(stored)
        swapped = np.flatnonzero(rows["other"].notna().to_numpy())
        if len(swapped):
            values[swapped] = digests_of(rows["other"].iloc[swapped])
        parts, there = [], []
        for level in tree.levels:
            values = level.fold(at, values)
            place, exists = level.others(at)
            shown = _as_hex(level.nodes)
            parts += [shown[np.minimum(place[:, k], len(level.nodes) - 1)] for k in range(fanout - 1)]
            there.append(exists)
            at = at // fanout
        for slot, width, state, siblings in zip(c["slots"], c["widths"], c["states"], c["siblings"], strict=True):
            values = _resume(values, int(slot), int(width), state, list(siblings))
        rest = "".join(x for level in c["siblings"] for x in level).encode()
        if parts:
            text, exists = np.stack(parts, axis=1), np.concatenate(there, axis=1)
            whole = exists.all(axis=1)
            proofs = [hashlib.sha256((text[k] if whole[k] else text[k][exists[k]]).tobytes() + rest).hexdigest() for k in range(len(rows))]
        else:
            proofs = [hashlib.sha256(rest).hexdigest()] * len(rows)
        folded = hex_of(values)
        return pd.DataFrame({"id": rows["id"], "leaf": hex_of(stored), "subroot": c["subroot"], "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    width = fanout ** int(math.log(CHUNK, fanout) + 1e-9)
    dealt = nodes.select("key", F.expr(f"pos div {width}").alias("chunk"), F.col("id").cast("string").alias("id"), "pos", "digest", "other").groupBy("key", "chunk")
    out = dealt.cogroup(chunks.groupBy("key", "chunk")).applyInPandas(fold, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    discard(leaves)
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
