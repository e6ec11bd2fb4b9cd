"""Manifest, id planes and collocations against brute force, and on odd rows."""

import hashlib
import io
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import collocations, manifest, planes, queries
from millrace.session import shared_dir
from tests.conftest import SF

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in manifest.FIELDS)))


def plain_manifest(rows, fanout=2):
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def way(tree, i):
        for level in tree[:-1]:
            yield i % fanout, level[i - i % fanout :][:fanout]
            i //= fanout

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for rows in groups.values():
        rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {x: levels([leaf(r) for r in groups[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for g, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            steps = [*way(trees[lang], i), *way(top, g)]
            hit = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            value = leaf(r | {"n_chars": r["n_chars"] + 1} if hit else r)
            for slot, run in steps:
                value = digest(*run[:slot], value, *run[slot + 1 :])
            proof = digest(*(x for slot, run in steps for k, x in enumerate(run) if k != slot))
            out.append((r["doc_id"], leaf(r), trees[lang][-1][0], top[-1][0], proof, value, value == top[-1][0]))
    return sorted(out, key=repr)


def own_manifest(df, **kind):
    out = manifest.merkle_manifest(df, {"n_chars": F.col("n_chars") + 1}, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, **kind)
    assert out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    return sorted(map(tuple, out.collect()), key=repr)


def test_midstates_equal_hashlib():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**32, (70, 8)).astype(np.uint32)
    names = manifest.hex_of(words)
    assert (manifest.digests_of(names) == words).all()
    for fanout in (2, 3, 5):
        level = manifest.Level(words, fanout)
        runs = [names[i : i + fanout] for i in range(0, 70, fanout)]
        assert manifest.hex_of(level.parents()) == [digest(*r) for r in runs]
        folded = manifest.hex_of(level.fold(np.arange(70), words[::-1].copy()))
        for i, got in enumerate(folded):
            run = list(runs[i // fanout])
            run[i % fanout] = names[69 - i]
            assert got == digest(*run)


@pytest.mark.parametrize("chunk,fanout", [(4096, 2), (16, 2), (30, 3)])
def test_manifest_equals_plain_hashing(spark, monkeypatch, chunk, fanout):
    monkeypatch.setattr(manifest, "CHUNK", chunk)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert own_manifest(df, fanout=fanout) == plain_manifest([r.asDict() for r in df.collect()], fanout)


def test_manifest_of_odd_rows(spark):
    rows = [(None, "a", None, "t", None, 1), (None, "a", None, "t", None, 1), (3, None, 5, None, "x", 1), (3, None, 5, "", "x", 2), (2**62 + 1, "é", None, "b", "é", 3), (9, "s", 1, "x" * 300_000, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars int, text string, lang string, key int")
    for part in (df, df.limit(1)):
        assert own_manifest(part) == plain_manifest([r.asDict() for r in part.collect()])
    assert own_manifest(df.limit(0)) == []
    with pytest.raises(ValueError):
        manifest.merkle_manifest(df, fanout=1)


# id planes


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_plane_files_round_trip(kind, block):
    rng = random.Random(block)
    docs = [(rng.choice([None, k, -k]), np.array([rng.randrange(2 ** rng.choice([3, 17, 32])) for _ in range(rng.choice([0, 1, 40]))], "<u4")) for k in range(30)]
    out = io.BytesIO()
    writer = planes.PlaneWriter(out, kind, block)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    file = planes.PlaneFile(io.BytesIO(out.getvalue()))
    names, sizes = file.documents()
    assert names == [d for d, _ in docs] and sizes.tolist() == [len(x) for _, x in docs]
    at, kept = 0, {}
    for _, ids in docs:
        assert file.ids(at, len(ids), kept).tolist() == ids.tolist()
        at += len(ids)
    with pytest.raises(ValueError):
        planes.PlaneFile(io.BytesIO(out.getvalue()[:-1]))


def test_encoder_equals_the_library():
    own, plain = planes.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    assert own.by_units and not planes.Encoder(public_tokenizers.path("word_bpe_49k.json")).by_units
    rng = random.Random(3)
    alphabet = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "a", "b", "'s", "é", "日本", "1", ".", "<|endoftext|>", "​", "🙂"]
    texts = ["", " ", " a", "a ", "a  b", "\n a", "　 a", None, *("".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(5000))]
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for at in range(0, len(texts), 700):
        assert own(pa.array(texts[at : at + 700], pa.string())) == want[at : at + 700]


def planes_of(df, read_blocks=planes.READ_BLOCKS, **kind):
    path = f"{shared_dir(df.sparkSession)}/ids-{uuid.uuid4().hex}"
    planes.write_ids(planes.encode(df, TOKENIZER, 2), path, **kind)
    return planes.read_ids(df.sparkSession, path, read_blocks)


@pytest.mark.parametrize("kind", [{}, {"planes": "bit", "block": 5000, "read_blocks": 2}])
def test_ids_read_back_are_those_of_the_library(spark, kind):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("part"), F.lit("x").alias("ids"))
    plain, start, want = Tokenizer.from_file(TOKENIZER), 0, []
    for doc_id, text in sorted((r.doc_id, r.text) for r in df.collect()):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in planes_of(df, **kind).collect()) == want


def test_ids_of_odd_rows(spark):
    df = spark.createDataFrame([(5, None), (None, "b"), (4, ""), (2**62, "a b"), (4, "")], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.n_tokens) for r in planes_of(df).orderBy("start").collect()] == [(None, 0, 2), (4, 2, 1), (4, 3, 1), (5, 4, 1), (2**62, 5, 3)]
    assert planes_of(df.limit(0)).collect() == []


# collocations


def plain_collocations(rows, least=30, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        wanted, longer = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, Counter()
        for p, a in wanted.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in wanted.items():
            if not longer[p] or 100 * longer[p] < 80 * a:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


ODD = [(None, "a b c d a b c d\te.a b"), ("und", "A B. é é é = = %20 == ."), ("x y=%", None), ("x y=%", "a b a b a b"), ("x y=%", ""), ("q", "\x0ba b;\x0c a  b\x0ba b\ta b"), ("q", "x" * 90_000)]


@pytest.mark.parametrize("kind", [{}, {"dictionary": 40}, {"dictionary": 0, "buffer": 5000}])
def test_collocations_equal_plain_counting(spark, kind):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, "lang string, text string").withColumn("key", F.lit("k"))
    for df, least, top in ((docs, 6, 25), (odd, 2, 100)):
        found = collocations.collocations(df, least, top, **kind).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, found.collect())) == plain_collocations([tuple(r) for r in df.select("lang", "text").collect()], least, top)


def test_collocations_of_a_common_pair_and_of_nothing(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame([("en", " ".join(f"of the w{rng.randrange(200)} v{rng.randrange(9)}" for _ in range(400))) for _ in range(20)], "lang string, text string").repartition(5)
    monkeypatch.setattr(collocations, "SALTS", 3)
    found = collocations.collocations(df, 30, 500, buffer=1000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == plain_collocations([tuple(r) for r in df.collect()], 30, 500)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_scores_past_64_bits(spark):
    one = spark.range(1).select(F.lit(9_000_000_000_000_000).alias("a"), F.lit(9_000_000_000_000_001).alias("l"))
    exact = one.select(F.floor((collocations._exact(F.lit(2_000_000)) * collocations._exact(F.col("a")) - F.pmod(collocations._exact(F.lit(2_000_000)) * collocations._exact(F.col("a")), collocations._exact(F.col("l")) + 0)) / collocations._exact(F.col("l"))).cast("long"))
    assert exact.first()[0] == 2_000_000 * 9_000_000_000_000_000 // 9_000_000_000_000_001


def test_new_queries_are_registered():
    assert {"op11_merkle_midstates", "op12_id_planes", "op13_collocations"} <= set(queries.QUERIES)
    assert "op11_merkle_midstates" in queries.ORACLES and "op13_collocations" in queries.ORACLES
