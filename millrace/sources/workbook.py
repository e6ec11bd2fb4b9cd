"""Workbooks: one sheet is one table. The tasks that read files only inflate their parts and cut them into blocks of
whole rows; blocks are dealt over all tasks, which parse them. Shared strings are cut and parsed likewise, and meet the
blocks that use them by a join on their index. Types come from the whole sheet.

Defined cases: a sheet without rows, a workbook without shared strings and empty cells give no rows, no texts and nulls;
error cells are null; rows shorter than the header have nulls at their end; cells past the header are left out. A sheet that no workbook has gives
no rows. A part that isn't well-formed is an error. Rows count from 0 as they stand in the part, whatever number they carry.
"""

from __future__ import annotations

import codecs
import datetime
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import discard, materialize, ship
from millrace.types import quoted

#: Name spaces, and built-in number formats that are dates.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_EPOCH = datetime.datetime(1899, 12, 30)

_BLOCK_BYTES = 1 << 18
_BLOCKS = "path string, sheet string, block int, first int, xml binary, uses array<int>, dates array<int>"
_NAME = rb"(?:[\w.-]+:)?"
_USE = re.compile(rb"""\bt=["']s["'](?:[^<]|<(?!/?""" + _NAME + rb"c[\s/>]))*?<" + _NAME + rb"v[^>]*>\s*(\d+)")


class _Kind:
    """How one kind of part is cut: its root, the element that holds the items, and an item."""

    def __init__(self, root: bytes, holder: bytes, item: bytes):
        self.root = re.compile(rb"<(" + _NAME + root + rb")(?:\s[^>]*)?>")
        self.open = re.compile(rb"<" + _NAME + holder + rb"(?:\s[^>]*)?>")
        self.close = re.compile(rb"</" + _NAME + holder + rb"\s*>")
        self.item = re.compile(rb"<" + _NAME + item + rb"[\s/>]")
        self.end = re.compile(rb"</" + _NAME + item + rb"\s*>")


_ROWS, _STRINGS = _Kind(b"worksheet", b"sheetData", b"row"), _Kind(b"sst", b"sst", b"si")


def _pieces(part, size: int) -> Iterator[bytes]:
    """A part as UTF-8, in pieces of some size bytes."""
    start = part.read(256)
    declared = re.search(rb"""<\?xml[^>]*encoding=["']([\w.-]+)""", start)
    name = "utf-16" if start[:2] in (b"\xff\xfe", b"\xfe\xff") else declared[1].decode() if declared else "utf-8"
    decode = codecs.getincrementaldecoder("utf-8-sig" if codecs.lookup(name).name == "utf-8" else name)()
    while start:
        yield decode.decode(start).encode()
        start = part.read(size)


def _cut(part, kind: _Kind, block_bytes: int) -> Iterator[tuple[int, bytes]]:
    """(number of its first item, XML document of whole items) of each block; at most a block and an item are held."""
    held, head, tail, first, least = b"", None, b"", 0, block_bytes
    pieces = _pieces(part, min(max(block_bytes, 256), _BLOCK_BYTES))  # a piece longer than a block would be cut off as one
    for piece in pieces:
        held += piece
        if head is None:
            root, begin = kind.root.search(held), kind.open.search(held)
            if not root or not begin:
                continue
            if begin[0].endswith(b"/>"):
                return
            head, tail, held = root[0], b"</" + root[1] + b">", held[begin.end() :]
        stop = kind.close.search(held)
        if not stop and len(held) < least:
            continue
        at = stop.start() if stop else max((m.end() for m in kind.end.finditer(held)), default=0)
        if at and (n := len(kind.item.findall(held, 0, at))):
            yield first, head + held[:at] + tail
            first += n
        if stop:
            return
        held = held[at:]
        least = block_bytes if at else 2 * len(held)
    raise ValueError("a part ends before its last element")


class Workbook:
    """The small parts of a workbook: names of sheets and which styles are dates."""

    def __init__(self, data):
        self.zip = zipfile.ZipFile(pa.BufferReader(data) if isinstance(data, pa.Buffer) else io.BytesIO(data))
        relations = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): relations[s.get(f"{_REL}id")].lstrip("/") for s in book.iter(f"{_MAIN}sheet")}
        self.dates: set[int] = set()
        if "xl/styles.xml" in self.zip.namelist():
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
            formats = styles.find(f"{_MAIN}cellXfs")
            self.dates = {k for k, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in own | _DATE_FORMATS}

    def blocks(self, sheet: str | None, block_bytes: int) -> Iterator[tuple]:
        """(sheet, block, first, xml, uses, dates) of the shared strings (sheet null) and of one sheet or all."""
        if "xl/sharedStrings.xml" in self.zip.namelist():
            with self.zip.open("xl/sharedStrings.xml") as part:
                for k, (first, xml) in enumerate(_cut(part, _STRINGS, block_bytes)):
                    yield None, k, first, xml, [], []
        for name, target in self.sheets.items():
            if sheet is None or name == sheet:
                with self.zip.open(target if target.startswith("xl/") else f"xl/{target}") as part:
                    for k, (first, xml) in enumerate(_cut(part, _ROWS, block_bytes)):
                        yield name, k, first, xml, sorted({int(u) for u in _USE.findall(xml)}), sorted(self.dates)


def _place(reference: str) -> int:
    column = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        column = 26 * column + ord(c) - 64
    return column - 1


def _text(element) -> str:
    """The text of a string or its runs, without phonetic readings."""
    own = [t for child in element if child.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in child.iter(f"{_MAIN}t")]
    return "".join(t.text or "" for t in own)


def _cell(cell, texts: dict[int, str], dates: set[int]) -> str | None:
    """A cell as text: numbers in plain digits, dates in ISO form, truth values as true and false."""
    kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(_text(s) for s in cell.iter(f"{_MAIN}is"))
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return texts[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    if kind in (None, "n") and int(cell.get("s", 0)) in dates:
        moment = _EPOCH + datetime.timedelta(seconds=round(float(v.text) * 86400))
        return moment.isoformat(sep=" ") if moment.time() != datetime.time() else moment.date().isoformat()
    return v.text


def _each(df: DataFrame, work, schema: str) -> DataFrame:
    """Rows that work gives for each row of df, row by row, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held, size = [], 0
                for row in work({n: batch.column(n)[k] for n in batch.schema.names}):
                    held.append(row)
                    size += sum(len(v) for v in row if isinstance(v, (bytes, str, list)))
                    if size > 1 << 22 or len(held) == 5000:
                        yield pack(held)
                        held, size = [], 0
                yield pack(held)

    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(T._parse_datatype_string(schema))

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(wanted)], schema=wanted)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet of all workbooks under a path, from their small parts alone."""
    return _each(_files(spark, path), lambda r: [(r["path"].as_py(), s) for s in Workbook(r["content"].as_buffer()).sheets], "path string, sheet string")


def read_cells(spark: SparkSession, path: str, sheet: str | None = None, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """path, sheet, row (from 0), cells (text by position) of all workbooks under a path; blocks of some block_bytes are parsed apart."""

    def cut(r) -> Iterator[tuple]:
        place = r["path"].as_py()
        return ((place, *block) for block in Workbook(r["content"].as_buffer()).blocks(sheet, block_bytes))

    def strings(r) -> Iterator[tuple]:
        place, first = r["path"].as_py(), r["first"].as_py()
        return ((place, first + k, _text(si)) for k, si in enumerate(ElementTree.fromstring(r["xml"].as_py()).iter(f"{_MAIN}si")))

    def rows(r) -> Iterator[tuple]:
        place, name, first = r["path"].as_py(), r["sheet"].as_py(), r["first"].as_py()
        texts, dates = dict(r["texts"].as_py() or []), set(r["dates"].as_py())
        for k, row in enumerate(ElementTree.fromstring(r["xml"].as_py()).iter(f"{_MAIN}row")):
            found, at = {}, 0
            for cell in row.iter(f"{_MAIN}c"):
                at = _place(cell.get("r")) if cell.get("r") else at
                found[at] = _cell(cell, texts, dates)
                at += 1
            last = max((c for c, v in found.items() if v is not None), default=-1)
            yield place, name, first + k, [found.get(c) for c in range(last + 1)]

    key = ["path", "sheet", "block"]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = materialize(_each(_files(spark, path), cut, _BLOCKS), "blocks")
    shared = _each(blocks.where("sheet IS NULL").select("path", "first", "xml").repartition(tasks, "path", "first"), strings, "path string, index int, text string")
    sheets = blocks.where("sheet IS NOT NULL")
    # a block names each string it uses once, so that a string in every row meets as many rows as there are blocks
    used = sheets.select(*key, F.explode("uses").alias("index")).join(shared, ["path", "index"])
    texts = used.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("index", "text"))).alias("texts"))
    return _each(sheets.repartition(tasks, *key).join(texts, key, "left").select("path", "sheet", "first", "xml", "dates", "texts"), rows, "path string, sheet string, row int, cells array<string>")


def read_workbook(spark: SparkSession, path: str, sheet: str, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """One sheet of each workbook under a path: names from the first row, types that fit every cell of a column."""
    cells = materialize(read_cells(spark, path, sheet, block_bytes), "cells")
    header = cells.where("row = 0").orderBy("path").first()
    names = [c or f"column_{k + 1}" for k, c in enumerate(header["cells"] if header else [])]
    text = cells.where("row > 0").select(*[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])
    kinds = ("long", "double", "boolean", "date", "timestamp_ntz")
    if not names:
        discard(cells)
        return spark.createDataFrame([], T.StructType([]))

    def fit(n: str, k: str):
        # a time of day is no part of a date
        fits = F.col(quoted(n)).try_cast(k).isNotNull()
        return (fits & ~F.contains(F.col(quoted(n)), F.lit(":")) if k == "date" else fits) | F.col(quoted(n)).isNull()

    checks = [F.bool_and(fit(n, k)).alias(f"{i}_{k}") for i, n in enumerate(names) for k in kinds] + [F.count(F.col(quoted(n))).alias(f"{i}_n") for i, n in enumerate(names)]
    fits = text.agg(*checks).first()
    chosen = [next((k for k in kinds if fits[f"{i}_n"] and fits[f"{i}_{k}"]), "string") for i in range(len(names))]
    return text.select(*[F.col(quoted(n)).cast(k).alias(n) for n, k in zip(names, chosen, strict=True)])


def _column(place: int) -> str:
    name = ""
    while place >= 0:
        place, letter = divmod(place, 26)
        name, place = chr(65 + letter) + name, place - 1
    return name


class _Sheet:
    """A workbook of one sheet, written as its rows come; the first texts are shared, the others stand in their cells."""

    def __init__(self, out, sheet: str, names: list[str], most_shared: int):
        self.zip, self.shared, self.most, self.rows = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), {}, most_shared, 0
        main, rel = _MAIN[1:-1], _REL[1:-1]
        types = "http://schemas.openxmlformats.org/package/2006/content-types"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        parts = {"workbook": "sheet.main", "worksheets/sheet1": "worksheet", "sharedStrings": "sharedStrings", "styles": "styles"}
        named = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{kind}{k}+xml"/>' for p, k in parts.items())
        put = self.zip.writestr
        put("[Content_Types].xml", f'<Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{named}</Types>')
        links = "http://schemas.openxmlformats.org/package/2006/relationships"
        put("_rels/.rels", f'<Relationships xmlns="{links}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        targets = [("worksheet", "worksheets/sheet1.xml"), ("sharedStrings", "sharedStrings.xml"), ("styles", "styles.xml")]
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{links}">' + "".join(f'<Relationship Id="rId{k + 1}" Type="{rel}/{t}" Target="{p}"/>' for k, (t, p) in enumerate(targets)) + "</Relationships>")
        put("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        self.part = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.part.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
        self.add(names)

    def add(self, row: list) -> None:
        self.rows += 1
        cells = "".join(self._cell(f"{_column(k)}{self.rows}", v) for k, v in enumerate(row) if v is not None)
        self.part.write(f'<row r="{self.rows}">{cells}</row>'.encode())

    def _cell(self, at: str, value) -> str:
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, datetime.datetime):
            return f'<c r="{at}" s="2"><v>{(value - _EPOCH) / datetime.timedelta(days=1)!r}</v></c>'
        if isinstance(value, datetime.date):
            return f'<c r="{at}" s="1"><v>{(value - _EPOCH.date()).days}</v></c>'
        if not isinstance(value, str):
            return f'<c r="{at}"><v>{value}</v></c>'
        if value not in self.shared and len(self.shared) >= self.most:
            return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_escaped(value)}</t></is></c>'
        return f'<c r="{at}" t="s"><v>{self.shared.setdefault(value, len(self.shared))}</v></c>'

    def close(self) -> None:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()
        with self.zip.open("xl/sharedStrings.xml", "w", force_zip64=True) as part:
            part.write(f'<sst xmlns="{_MAIN[1:-1]}">'.encode())
            for text in self.shared:
                part.write(f'<si><t xml:space="preserve">{_escaped(text)}</t></si>'.encode())
            part.write(b"</sst>")
        self.zip.close()


def _escaped(text: str) -> str:
    """Text as XML has it; characters that XML can't hold become U+FFFD."""
    return escape(re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "�", text), {"\r": "&#13;"})


def write_workbook(df: DataFrame, path: str, sheet: str, max_rows: int = 1_048_575, most_shared: int = 100_000) -> DataFrame:
    """Workbooks of one sheet under a path, at most max_rows below each header; file and rows of each.

    A task writes the rows of its partition, one file or more, as they come. Files appear only once all tasks are done: what
    lost or repeated tasks wrote stays in a staging folder and goes with it. Arrays, maps, structs and binary aren't cells and are an error.
    """
    from millrace.sources.arrow_ipc import _store

    wrong = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))]
    if wrong or len(df.columns) > 16_384:
        raise ValueError(f"not cells: {wrong or 'more than 16,384 columns'}")
    names, staging = df.columns, f"_staging-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(path)
        store.create_dir(f"{place}/{staging}", recursive=True)
        done, book, out = [], None, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if book is None:
                    name = f"part-{uuid.uuid4().hex}.xlsx"
                    out = store.open_output_stream(f"{place}/{staging}/{name}")
                    book = _Sheet(out, sheet, names, most_shared)
                book.add(row)
                if book.rows > max_rows:
                    book.close()
                    out.close()
                    done.append((name, book.rows - 1))
                    book = None
        if book is not None:
            book.close()
            out.close()
            done.append((name, book.rows - 1))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file", "rows"])

    ship(df.sparkSession)
    plain = df.select(*[F.col(quoted(f.name)).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(quoted(f.name)) for f in df.schema])
    written = plain.mapInArrow(run, "file string, rows long").collect()  # one row a file
    store, place = _store(path)
    for r in written:
        store.move(f"{place}/{staging}/{r.file}", f"{place}/{r.file}")
    if written:
        store.delete_dir(f"{place}/{staging}")
    return df.sparkSession.createDataFrame([tuple(r) for r in written], "file string, rows long")
