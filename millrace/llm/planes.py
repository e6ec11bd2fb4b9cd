"""Token ids in binary files: blocks of ids transposed into bit or byte planes, each plane compressed by zstandard.

A file holds the ids of documents in ascending order of their ids, end to end. They are cut into blocks of
a fixed number of ids, wherever documents end; plane k of a block holds bit (or byte) k of each of its
ids. High planes, in which ids hardly differ, shrink to nearly nothing. Behind the blocks stand the ids and
lengths of the documents, transposed in the same way, and then the chunk index: for each block its
place, its ids and the lengths of its planes; magic, index and its length end the file, as in Parquet, so
a reader gets from a file's end to the blocks it needs. A manifest beside the files gives each file's
first document and first id in the whole.

Writing: one range partitioning by document id, then a file a partition through a Spark data source; tasks
write to a staging folder, and the commit moves the files of the attempts that count and writes the
manifest, which holds one line a file. Reading: a partition for each part of a file, cut at documents by
the chunk index; memory is one block and one document.

Defined cases: a null or empty text has the end id alone; rows of one id are ordered by a hash of their text; a null id
comes first; an empty table gives a manifest without files, which reads as no rows; ids up to 2^32 - 1.
"""

from __future__ import annotations

import json
import os
import string
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from millrace.llm.batches import slices

MAGIC = b"IDPLANE1"
#: Ids in a block, and blocks in a partition of a read.
BLOCK, READ_BLOCKS = 65_536, 64


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of unsigned integers, lowest first."""
    octets = np.ascontiguousarray(ids.view(np.uint8).reshape(len(ids), ids.itemsize).T)
    if kind == "byte":
        return [row.tobytes() for row in octets]
    return [np.packbits((row >> bit) & 1, bitorder="little").tobytes() for row in octets for bit in range(8)]


def join_planes(planes: list[bytes], n: int, kind: str, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    octets = np.zeros((size, n), np.uint8)
    for k, plane in enumerate(planes):
        if kind == "byte":
            octets[k] = np.frombuffer(plane, np.uint8)
        else:
            octets[k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << np.uint8(k % 8)
    return np.ascontiguousarray(octets.T).reshape(-1).view(dtype)


class PlaneWriter:
    """One file: ids in, blocks out as they fill."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 3):
        if kind not in ("bit", "byte"):
            raise ValueError(f"unknown planes {kind!r}")
        self.out, self.kind, self.block, self.press = out, kind, block, zstandard.ZstdCompressor(level=level)
        self.at, self.n_ids, self.blocks, self.waiting, self.held = len(MAGIC), 0, [], [], 0
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(np.asarray(ids, "<u4"))
        self.held += len(ids)
        if self.held >= self.block:
            every = np.concatenate(self.waiting)
            whole = self.held - self.held % self.block
            for k in range(0, whole, self.block):
                self.blocks.append(self._put(every[k : k + self.block]))
            self.waiting, self.held = [every[whole:]], self.held - whole

    def _put(self, values: np.ndarray) -> dict:
        planes = [self.press.compress(p) for p in split_planes(values, self.kind)]
        entry = {"at": self.at, "n": len(values), "planes": [len(p) for p in planes]}
        for p in planes:
            self.out.write(p)
            self.at += len(p)
        return entry

    def close(self) -> None:
        if self.held:
            self.blocks.append(self._put(np.concatenate(self.waiting)))
        known = [k for k, d in enumerate(self.docs) if d is not None]
        index = {
            "planes": self.kind, "block": self.block, "ids": self.n_ids, "docs": len(self.docs), "nulls": [k for k, d in enumerate(self.docs) if d is None], "blocks": self.blocks,
            "doc_ids": self._put(np.array([self.docs[k] for k in known], "<i8").view("<u8")), "sizes": self._put(np.array(self.sizes, "<u8")),
        }
        body = self.press.compress(json.dumps(index).encode())
        self.out.write(body + struct.pack("<Q", len(body)) + MAGIC)


class PlaneFile:
    """A file opened for reading: its index, documents, and ids by block."""

    def __init__(self, source):
        self.source, self.expand = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        tail = self._read(max(0, end - 16), 16)
        if len(tail) < 16 or tail[8:] != MAGIC:
            raise ValueError("not a file of id planes, or one cut short")
        size = struct.unpack("<Q", tail[:8])[0]
        self.index = json.loads(self.expand.decompress(self._read(end - 16 - size, size)))
        self.kind = self.index["planes"]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _get(self, entry: dict, dtype: str) -> np.ndarray:
        data, at, planes = self._read(entry["at"], sum(entry["planes"])), 0, []
        for n in entry["planes"]:
            planes.append(self.expand.decompress(data[at : at + n]) if n else b"")
            at += n
        return join_planes(planes, entry["n"], self.kind, dtype)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents and their lengths in order."""
        out = self._get(self.index["doc_ids"], "<u8").view("<i8").tolist()
        for k in self.index["nulls"]:
            out.insert(k, None)
        return out, self._get(self.index["sizes"], "<u8").astype(np.int64)

    def ids(self, start: int, n: int, kept: dict[int, np.ndarray]) -> np.ndarray:
        """Ids from a place in the file; kept holds the block last read."""
        block, parts = self.index["block"], []
        for b in range(start // block, -(-(start + n) // block)):
            if b not in kept:
                kept.clear()
                kept[b] = self._get(self.index["blocks"][b], "<u4")
            parts.append(kept[b][max(0, start - b * block) : start + n - b * block])
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    part: int
    docs: int
    ids: int


class IdPlanesWriter(DataSourceArrowWriter):
    """A file a task, of rows (part, doc_id, ids as little-endian 32-bit integers); published when the job commits."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("planes", "byte")
        self.block, self.level = int(options.get("block", BLOCK)), int(options.get("level", 3))
        self.staging = f"_staging-{options['job']}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, place = _store(self.path)
        name, out, writer, part = f"ids-{uuid.uuid4().hex}.planes", None, None, 0
        for batch in batches:
            if batch.num_rows and writer is None:
                store.create_dir(f"{place}/{self.staging}", recursive=True)
                out = store.open_output_stream(f"{place}/{self.staging}/{name}")
                writer, part = PlaneWriter(out, self.kind, self.block, self.level), batch.column(0)[0].as_py()
            for doc_id, ids in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                writer.add(doc_id, np.frombuffer(ids, "<u4"))
        if writer is None:
            return Written(None, 0, 0, 0)
        writer.close()
        out.close()
        return Written(name, part, len(writer.docs), writer.n_ids)

    def commit(self, messages: list) -> None:
        store, place = _store(self.path)
        store.create_dir(place, recursive=True)
        files, first_doc, first_id = [], 0, 0
        for m in sorted((m for m in messages if m is not None and m.file is not None), key=lambda m: m.part):
            name = f"ids-{m.part:06d}.planes"
            store.move(f"{place}/{self.staging}/{m.file}", f"{place}/{name}")
            files.append({"file": name, "docs": m.docs, "ids": m.ids, "first_doc": first_doc, "first_id": first_id})
            first_doc, first_id = first_doc + m.docs, first_id + m.ids
        with store.open_output_stream(f"{place}/manifest.json") as out:
            out.write(json.dumps({"planes": self.kind, "block": self.block, "files": files, "docs": first_doc, "ids": first_id}).encode())
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, place = _store(self.path)
        if store.get_file_info(f"{place}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{place}/{self.staging}")


class FilePart(InputPartition):
    """Part k of n of a file's documents, dealt by where their ids begin."""

    def __init__(self, file: str, first_id: int, part: int, parts: int):
        self.file, self.first_id, self.part, self.parts = file, first_id, part, parts


class IdPlanesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.read_blocks = options["path"], int(options.get("readblocks", READ_BLOCKS))

    def partitions(self) -> list[FilePart]:
        store, place = _store(self.path)
        with store.open_input_file(f"{place}/manifest.json") as source:
            manifest = json.loads(source.read())
        out = []
        for f in manifest["files"]:
            parts = max(1, -(-f["ids"] // (manifest["block"] * self.read_blocks)))
            out += [FilePart(f["file"], f["first_id"], k, parts) for k in range(parts)]
        return out

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, FilePart):  # a manifest without files: Spark asks once, without a partition
            return
        store, place = _store(self.path)
        with store.open_input_file(f"{place}/{part.file}") as source:
            file = PlaneFile(source)
            docs, sizes = file.documents()
            starts = np.cumsum(sizes) - sizes
            share = -(-file.index["ids"] // part.parts)
            low, high = np.searchsorted(starts, [part.part * share, (part.part + 1) * share])
            if part.part == part.parts - 1:
                high = len(docs)
            kept: dict[int, np.ndarray] = {}
            rows, held = [], 0
            for k in range(low, high):
                ids = file.ids(int(starts[k]), int(sizes[k]), kept)
                rows.append((docs[k], part.first_id + int(starts[k]), int(sizes[k]), ids.tobytes()))
                held += len(ids)
                if held > 1_000_000 or len(rows) == 1000 or k == high - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])
                    rows, held = [], 0


class IdPlanes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "id_planes"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def writer(self, schema, overwrite: bool) -> IdPlanesWriter:
        return IdPlanesWriter(self.options)

    def reader(self, schema) -> IdPlanesReader:
        return IdPlanesReader(self.options)


#: Units of text whose ids a worker keeps, and units that are encoded in one call.
KEPT_UNITS, UNITS_AT_ONCE = 600_000, 5_000
#: Texts, and bytes of text, that are encoded together.
BATCH_ROWS, BATCH_BYTES = 4_000, 8_000_000


class Encoder:
    """A tokenizer of the tokenizers library. Strings of special tokens in a text are ordinary text.

    Where the tokenizer is byte-level BPE with its usual splitting and no normalizer, no piece goes on from a
    character that is no white space to white space. Texts are then cut at such places before a
    space, and the library encodes each distinct unit once; for other tokenizers it gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.made = Tokenizer.from_file(path)
        self.made.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = said.get("pre_tokenizer") or {}
        self.by_units = (
            said.get("normalizer") is None and said.get("post_processor") is None and said["model"].get("type") == "BPE" and not said["model"].get("dropout")
            and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and all(x["special"] for x in said["added_tokens"])
        )
        line = self.made.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.kept: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.bare = Tokenizer(self.made.model)
        # byte-level BPE writes a byte that can be printed as its own character, the others as those from 256 on
        hidden = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173)]
        self.shown = {b: chr(256 + k) for k, b in enumerate(hidden) if b != 10}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.made.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set[str]) -> None:
        """Keeps the ids of units, which a space precedes.

        Letters are one piece and the ASCII marks behind them another, so the model alone encodes the letters,
        many at once, and marks are looked up. Other units without white space are encoded many in one text, a line each.
        """
        if len(self.kept) > KEPT_UNITS:
            self.kept.clear()
        letters, marked, other = set(), [], []
        for u in missing:
            core = u.rstrip(string.punctuation)
            if not core.isalpha():
                other.append(u)
                continue
            if core not in self.kept:
                letters.add(core)
            if len(core) < len(u):
                marked.append((u, core, u[len(core) :]))
        self.kept.update(self._encode_words(list(letters)))
        if unknown := list({m for _, _, m in marked}.difference(self.marks)):
            self.marks.update(zip(unknown, self._encode(unknown), strict=True))
        self.kept.update([(u, self.kept[core] + self.marks[m]) for u, core, m in marked])
        plain = [u for u in other if u.split() == [u]] if self.line is not None else []
        parts = [plain[k : k + UNITS_AT_ONCE] for k in range(0, len(plain), UNITS_AT_ONCE)]
        for part, data in zip(parts, self._encode([" " + "\n ".join(part) for part in parts]), strict=True):
            cuts = (4 * np.flatnonzero(np.frombuffer(data, "<u4") == self.line)).tolist()
            self.kept.update(zip(part, [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)], strict=True))
        rest = list(set(other).difference(plain))
        self.kept.update(zip(rest, self._encode([" " + u for u in rest]), strict=True))

    def _encode_words(self, words: list[str]) -> list[tuple[str, bytes]]:
        """Words of letters, and the ids of each behind a space: one piece each, so the model gets them as its byte characters."""
        out: list[tuple[str, bytes]] = []
        words.sort(key=str.isascii)
        for at in range(0, len(words), UNITS_AT_ONCE):
            part = words[at : at + UNITS_AT_ONCE]
            text = " " + "\n ".join(part)
            text = text.replace(" ", self.shown[32]) if text.isascii() else text.encode().decode("latin1").translate(self.shown)
            found = self.bare.encode_batch([text.split("\n")], is_pretokenized=True, add_special_tokens=False)[0]
            ends = 4 * np.cumsum(np.bincount(np.array(found.word_ids), minlength=len(part)))
            data, ends = np.array(found.ids, "<u4").tobytes(), ends.tolist()
            out += zip(part, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True)
        return out

    def _known(self, wanted: list[str]) -> list[bytes]:
        """The ids of units, in their order."""
        found = list(map(self.kept.get, wanted))
        if None in found:
            self._learn({u for u, x in zip(wanted, found, strict=True) if x is None})
            found = [self.kept[u] if x is None else x for u, x in zip(wanted, found, strict=True)]
        return found

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        plain = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_units:
            return self._encode(plain.to_pylist())
        parts = pc.split_pattern(plain, " ")
        begin = parts.offsets.to_numpy()
        words = parts.flatten().dictionary_encode()
        coded = pa.array(self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        place, data = np.frombuffer(coded.buffers()[1], np.int64)[: len(coded) + 1], memoryview(coded.buffers()[2] or b"")
        begin = begin - begin[0]
        # the first part has no space before it; where white space stands before a space, parts belong together
        heads = self._encode(pc.list_element(parts, 0).to_pylist())
        out = [head + bytes(data[place[a + 1] : place[b]]) for head, a, b in zip(heads, begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        for k in np.flatnonzero(pc.match_substring_regex(plain, _WIDE).to_numpy(zero_copy_only=False)):
            head, *rest = units(plain[int(k)].as_py())
            out[k] = self._encode([head])[0] + b"".join(self._known(rest))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: White space, of any script, before a space, or a space at the beginning.
_WIDE = r"(?:^|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]) "


def units(text: str) -> list[str]:
    """The text cut at every space that follows a character other than white space; these spaces are left out."""
    out = [""]
    for k, part in enumerate(text.split(" ")):
        if k == 0:
            out[0] = part
        elif out[-1] and not out[-1][-1].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, doc_id and ids (little-endian 32-bit integers) of every document, range-partitioned by id and sorted in each part."""
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("hash"), F.monotonically_increasing_id().alias("row"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for piece in slices(batch, "text", BATCH_ROWS, BATCH_BYTES):
                made = [x + end for x in own(piece.column("text"))]
                yield pa.RecordBatch.from_arrays([piece.column("part"), piece.column("doc_id"), pa.array(made, pa.binary())], names=["part", "doc_id", "ids"])

    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return placed.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, "part int, doc_id long, ids binary")


def write_ids(encoded: DataFrame, path: str, planes: str = "byte", block: int = BLOCK, level: int = 3) -> None:
    """Rows of encode() as files of planes and a manifest under a path that holds no such files yet."""
    spark = encoded.sparkSession
    spark.dataSource.register(IdPlanes)
    encoded.write.format("id_planes").mode("append").option("job", uuid.uuid4().hex).option("path", path).option("planes", planes).option("block", block).option("level", level).save()


def read_ids(spark: SparkSession, path: str, read_blocks: int = READ_BLOCKS) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the files."""
    spark.dataSource.register(IdPlanes)
    return spark.read.format("id_planes").option("path", path).option("readblocks", read_blocks).load()
