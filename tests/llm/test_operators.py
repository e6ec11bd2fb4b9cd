"""The operators on hand-made rows: nulls, empty tables, repeated rows, clashing columns, and brute force."""

import base64
import collections
import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from millrace.llm import automaton, bpe, decontaminate, jaccard, licenses, pseudonyms, quality, repeats, secrets, toxicity, wrapper
from millrace.llm.components import components
from tests.llm import induction

ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "x" * 20000), (5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l"), (None, "é à ñ 日本 text")]
CLASH = "doc_id long, text string, id string, h long, n int, lang string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", 7, 1, "en", "s") for i, t in rows], CLASH)


OPERATORS = {
    "quality": quality.host_quality,
    "secrets": secrets.secret_spans,
    "bpe": lambda d: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "licenses": licenses.license_notices,
    "jaccard": jaccard.jaccard_components,
    "pseudonyms": lambda d: pseudonyms.pseudonymize(d, b"k"),
    "toxicity": lambda d: toxicity.score_documents(d, toxicity.fit(["bad idiot"] * 9 + ["good day"] * 9, [1] * 9 + [0] * 9)),
    "repeats": repeats.remove_repeats,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    out = OPERATORS[name](frame(spark, ODD)).collect()
    assert len(out) == len(ODD)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((i is None, i or 0) for i, _ in ODD)
    assert OPERATORS[name](frame(spark, [])).count() == 0


def test_leaks_and_pages_on_odd_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (4, "a b c d e f g h i j k l"), (None, "m n o p q r s t u v w x y z")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_matched, r.doc_start, r.doc_end) for r in decontaminate.find_leaks(frame(spark, ODD), bench).collect()}
    assert found == {(5, 4, 12, 0, 12)}
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(frame(spark, ODD), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame(spark, ODD), bench, block_chars=10).count() == 2
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://a.example/x", "", "x"), (3, "nonsense", "<p>Hi <b>there<p>you", "x")], "page_id long, url string, html string, host string")
    assert {r.page_id: r.text for r in wrapper.extract_main_text(pages).collect()} == {1: "", 2: "", 3: "Hi there\nyou"}
    assert wrapper.extract_main_text(pages.limit(0)).count() == 0


def test_automaton_equals_regular_expressions():
    rules = [("assign", re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")), ("access", re.compile(rb"AKIA[A-Z0-9]+")), ("hex", re.compile(rb"[0-9a-f]+"))]
    least = {"access": 20, "hex": 24}
    rnd = random.Random(4)
    parts = ["token", "TOKEN", "password", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "a", "abcdef0123456789", "AKIA", "ABCDEFGHIJ0123456789", "0", "f", "é", "-", "x", "\n"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        raw, wanted = text.encode(), []
        for k, (name, pattern) in enumerate(rules):
            for m in pattern.finditer(raw):
                if (len(m[1]) >= 6) if name == "assign" else len(m[0]) >= least[name]:
                    wanted.append((len(raw[: m.start()].decode()), k, len(raw[: m.end()].decode())))
        assert [x for x in secrets.find_secrets(raw) if x[1] < 3] == sorted(wanted), text


def test_automaton_minimises_and_parses():
    one = automaton.RuleScanner(["(ab|cb)+", "x{2,3}", r"\d\d[^0-9]"])
    assert one.scan(b"zabcbxxxx12a") == [(1, 0, 5), (5, 1, 8), (9, 2, 12)]
    assert automaton.Dfa([automaton._Parser("aa|ba").parse()], False).states == automaton.Dfa([automaton._Parser("[ab]a").parse()], False).states
    with pytest.raises(ValueError):
        automaton._Parser("a)").parse()


def test_bpe_equals_tiktoken_and_round_trips():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.encoder(path, public_tokenizers.PATTERN)
    rnd = random.Random(3)
    parts = ["a", "the", "é", "ñ", " ", "  ", "\n", "\t", "'s", "'ll", "9", "½", "²", "\x1c", "\x85", "\xa0", " ", "日本", "_", "#", "😀", "́", "x" * 70, "ab" * 200, " " * 90, "　", "ǅ", "Ⅷ", "٣", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        ids = own.encode_many([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_notices_with_edits_are_found():
    finder, rnd = licenses.finder(), random.Random(1)
    for _ in range(500):
        notice, _, most = finder.notices[rnd.randrange(len(finder.notices))]
        chars = list(notice)
        for _ in range(rnd.randint(0, most)):
            at = rnd.randrange(len(chars))
            chars[at] = rnd.choice("abcxyz")
        found = finder.find(f"qwzx jjkk qwzx {''.join(chars)} zzkj wqqw")
        assert found and found[0][0] < 20, "".join(chars)
    row = licenses.scan("Licensed under CC-BY;\nthe GNU General Public License. All rights  reserved!".encode())
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"], row["n_words"]) == (3, 2, 9, "cc-by,gpl,reserved", 12)


def test_neighbouring_notices_are_all_found():
    worse, best = "released undxr the mit license", "released under the mit license"
    for parts in ([worse, best], [best, worse], [worse, worse, best, worse], [worse, "of x", best, worse, best]):
        row, at, wanted = licenses.scan(" ".join(parts).encode()), 0, []
        for part in parts:
            n = part.count(" ") + 1
            if n == 5:
                wanted.append(f"mit:{at}:{at + n}:{int(part == worse)}")
            at += n
        assert row["notices"] == ",".join(wanted), parts


def _sets(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return frozenset([tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [tuple(words)] if words else [])


@pytest.mark.parametrize("block", [1_000_000, 3000, 300])
def test_jaccard_equals_brute_force(spark, block):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randint(20, 90))] for _ in range(8)]
    texts = []
    for _ in range(150):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["", None, "one two", "one two", "One two", "a b c d", "a b c e"]
    sets = [_sets(t, 4) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 85 * (len(a) + len(sets[j]) - both) and both:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, enumerate(texts)), block_members=block).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_jaccard_of_texts_without_ids_and_of_repeated_ids(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, near), (None, near + " more"), (7, "other words that are not alike at all here"), (3, near + " 1 2"), (3, near + " 1 2 3"), (3, near + " 1 2"), (9, near + " 1 2"), (None, near + " 1 2")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).where("doc_id is not null").collect())
    assert got == [(3, 3)] * 3 + [(7, 7), (9, 3)]
    assert {r.component_id for r in jaccard.jaccard_components(frame(spark, rows)).where("doc_id is null").collect()} == {3}
    assert {r.component_id for r in jaccard.jaccard_components(frame(spark, rows[:2])).collect()} == {None}
    kept = jaccard.keep_one(frame(spark, [*rows, (4, ""), (4, ""), (5, None)]))
    assert sorted((r.doc_id, r.text and r.text[:1]) for r in kept.collect()) == [(3, "a"), (4, ""), (4, ""), (5, None), (7, "o")] and kept.columns == CLASH.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_nested_sets_of_all_sizes(spark, size, percent):
    texts = [" ".join(f"n{n}w{k}" for k in range(n + extra)) for n in range(1, 61) for extra in range(0, 13)]
    sets, wanted = [_sets(t, size) for t in texts], {}
    for g in range(0, len(texts), 13):
        parent = list(range(13))
        for i in range(13):
            for j in range(i):
                both = len(sets[g + i] & sets[g + j])
                if 100 * both >= percent * (len(sets[g + i]) + len(sets[g + j]) - both):
                    low, high = sorted((parent[i], parent[j]))
                    parent = [low if x == high else x for x in parent]
        wanted |= {g + i: g + parent[i] for i in range(13)}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, enumerate(texts)), size=size, percent=percent, block_members=700).collect()}
    assert got == wanted


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_small_sets_link_to_their_extensions(spark, size, percent):
    texts = []
    for n in range(1, 13):
        for before, after in ((0, 1), (1, 0), (1, 1)):
            words = [f"t{len(texts)}x{k}" for k in range(n)]
            texts += [" ".join(words), " ".join(["new"] * before + words + ["more"] * after)]
    sets = [_sets(t, size) for t in texts]
    wanted = {}
    for i, (a, b) in enumerate(zip(sets[::2], sets[1::2], strict=True)):
        linked = 100 * len(a & b) >= percent * len(a | b)
        wanted |= {2 * i: (len(a), 2 * i), 2 * i + 1: (len(b), 2 * i if linked else 2 * i + 1)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, enumerate(texts)), size=size, percent=percent).collect()}
    assert got == wanted
    kept = {r.doc_id for r in jaccard.keep_one(frame(spark, enumerate(texts)), size=size, percent=percent).collect()}
    assert kept == {i for i, (_, c) in wanted.items() if i == c}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}


def test_feistel_is_a_permutation_and_keeps_formats():
    f = pseudonyms.Feistel(b"key")
    for n in (1, 2, 7, 100, 730):
        assert sorted(f.within(i, n, b"t") for i in range(n)) == list(range(n))
        assert all(f.within(f.within(i, n, b"t"), n, b"t", True) == i for i in range(n))
    for s in ("a", "9", "Ab9", "zz.99", "123456789"):
        assert f.symbols(f.symbols(s, b"q"), b"q", True) == s
    p = pseudonyms.pseudonymizer(b"key")
    text = "mail a.b+1@x.example.com, +1 (487) 555-7209 4845168114407329 on 2024-02-29 ip 10.0.0.1 ssn 123-45-6789 DE89 3704 0044 0532 0130 00"
    new, spans = p.replace(text)
    assert [k for *_, k, _ in spans] == ["email", "phone", "card", "date", "ip", "ssn", "iban"]
    assert all(text[a:b] not in new for a, b, *_ in spans)
    assert [k for *_, k, _ in p.replace(new)[1]] == [k for *_, k, _ in spans]
    assert p.replace(text)[0] == new and pseudonyms.pseudonymizer(b"other").replace(text)[0] != new
    for kept in ("1234567812345678", "999.1.1.1", "2023-02-30", "a @ b", "v1.2.3.4.5", "12345"):
        assert p.replace(kept) == (kept, [])


def test_cards_beside_numbers_and_dates_in_timestamps():
    p = pseudonyms.pseudonymizer(b"key")
    for card in ("4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "3782 822463 10005", "4222222222222"):
        new = p.card(card)
        for before, after in (("", " 12/25"), ("", " 123"), ("", " 2, 3"), ("", " 12/25 123"), ("", "-7"), ("12 ", ""), ("7 ", " 12/25"), ("12 34 ", " 5 6 7"), ("on 2024-01-15 ", " 10")):
            got, spans = p.replace(f"{before}{card}{after}")
            assert (card not in got) and [(k, got[a:b]) for a, b, k, _ in spans if k == "card"] == [("card", new)], (before, card, after)
    for text in ("2024-01-15T10:00:00Z", "2024-01-15T10:00", "at 2024-01-15t10:00:00.5+02:00."):
        got, spans = p.replace(text)
        at = text.index("2024")
        assert [(a, b, k) for a, b, k, _ in spans] == [(at, at + 10, "date")] and got == text.replace("2024-01-15", p.date("2024-01-15"))
    for kept in ("2024-01-15Total", "2024-01-15x", "1234567812345678 12", "4111111111111112 2"):
        assert p.replace(kept) == (kept, [])


def test_substituted_benchmark_passages_are_found():
    rnd = random.Random(5)
    items = [" ".join(f"t{rnd.randrange(5000)}" for _ in range(rnd.randint(15, 50))) for _ in range(40)]
    index = decontaminate.Index.of(list(range(40)), [i.encode() for i in items])
    for k, item in enumerate(items):
        words = item.split()
        for at in rnd.sample(range(len(words)), len(words) // 6):
            words[at] = "zzzz"
        noise = " ".join(f"u{rnd.randrange(5000)}" for _ in range(100))
        assert [x[1] for x in index.leaks([f"{noise} {' '.join(words)} {noise}".encode()])] == [k]
        assert index.leaks([noise.encode(), None]) == []


def test_repeats_equal_brute_force(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abc é") for _ in range(120)) for _ in range(6)]
    texts = ["".join(rnd.choice(base)[rnd.randint(0, 40) : rnd.randint(60, 120)] + "".join(rnd.choice("abc é") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 5))) for _ in range(80)]
    texts += ["a" * 200, "ab" * 90, "x" + "abc d" * 60 + "y", "z" * 41, "", texts[5], texts[5]]
    raw = [t.encode() for t in texts]
    seen = collections.Counter(b[i : i + 40] for b in raw for i in range(len(b) - 39))
    wanted = {}
    for k, b in enumerate(raw):
        marks = bytearray(len(b))
        for i in range(len(b) - 39):
            if seen[b[i : i + 40]] > 1:
                marks[i : i + 40] = b"\1" * 40
        runs = sum(1 for i in range(len(b)) if marks[i] and (i == 0 or not marks[i - 1]))
        left = bytes(c for c, m in zip(b, marks) if not m)
        wanted[k] = (len(b), sum(marks), runs, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore"))
    for rows in (5000, 3):
        got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(frame(spark, enumerate(texts)), length=40, gram=8, group_rows=rows).collect()}
        assert got == wanted


def test_repeats_split_a_common_gram(spark, monkeypatch):
    """Many kinds of one gram are joined by several tasks, at the start and where a large group is split; the rows stay those of few tasks."""
    rnd = random.Random(5)
    piece = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    core, tail = piece(24), piece(50)
    rows = [(k, piece(60) + core + piece(60) + (tail if k % 3 == 0 else "")) for k in range(400)]
    plain = sorted(tuple(r) for r in repeats.remove_repeats(frame(spark, rows), length=40, gram=8).collect())
    assert sum(r[2] for r in plain) >= 134 * len(tail)
    contexts, written, asked = repeats._contexts, repeats.materialize, []
    monkeypatch.setattr(repeats, "_contexts", lambda texts, length: asked.append(texts) or contexts(texts, length))
    monkeypatch.setattr(repeats, "materialize", lambda df, name: (name == "blocks" and asked.append(df)) or written(df, name))
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        assert sorted(tuple(r) for r in repeats.remove_repeats(frame(spark, rows), length=40, gram=8, group_rows=50).collect()) == plain
        for df in asked[:2]:
            df.collect()
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("memory", [40, 1 << 18])
def test_suffix_order(tmp_path, memory):
    rnd = random.Random(8)
    for size in (0, 1, 2, 9, 300):
        for letters in (1, 2, 5, 200):
            text = [rnd.randrange(letters) for _ in range(size)]
            assert list(induction.suffix_order(reversed(text), size, tmp_path, memory)) == sorted(range(size), key=lambda i: text[i:])


def test_repeats_equal_suffix_order(spark, tmp_path):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abc é") for _ in range(900)) for _ in range(4)]
    texts = [rnd.choice(base)[rnd.randint(0, 300) : rnd.randint(500, 900)] + str(k) for k in range(30)] + ["ab" * 300, "", "a" * 399, "b" * 401]
    raw = [t.encode() for t in texts]
    starts = [(k, i) for k, b in enumerate(raw) for i in range(len(b) + 1)]
    symbols = [c for k, b in enumerate(raw) for c in (*(len(raw) + x for x in b), k)]
    marks, last = [bytearray(len(b)) for b in raw], (None, 0, 0)
    for at in induction.suffix_order(reversed(symbols), len(symbols), tmp_path, 2000):
        k, i = starts[at]
        window = raw[k][i : i + 400]
        if len(window) == 400 and window == last[0]:
            for d, a in (last[1:], (k, i)):
                marks[d][a : a + 400] = b"\1" * 400
        last = (window, k, i)
    got = {r.doc_id: r.kept_sha256 for r in repeats.remove_repeats(frame(spark, enumerate(texts))).collect()}
    assert sum(map(sum, marks)) > 0
    assert got == {k: hashlib.sha256(bytes(c for c, m in zip(b, marks[k]) if not m)).hexdigest() for k, b in enumerate(raw)}


def test_toxic_spans_held_out():
    rnd = random.Random(8)
    plain = [f"word{i}" for i in range(300)]

    def text(bad):
        words = [rnd.choice(plain) for _ in range(60)]
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(60), rnd.choice(["idiot", "moron,", "scumbag"]))
        return " ".join(words)

    model = toxicity.fit([text(i % 3 == 0) for i in range(300)], [int(i % 3 == 0) for i in range(300)])
    scorer = toxicity.Scorer(model)
    for i in range(60):
        t = text(i % 2)
        score, spans = scorer(t.encode())
        assert (score >= 0.5) == bool(i % 2)
        found = [t[int(a) : int(b)] for a, b in (s.split(":") for s in spans)]
        assert found == [w for w in t.split() if w.strip(",") in ("idiot", "moron", "scumbag")]
    odds = [model.odds(w) for w in text(1).lower().split()] * 4
    assert np.allclose(toxicity.marginals(odds, model.jump), toxicity.marginals(odds, model.jump, model.plain), atol=1e-12)
    assert toxicity.Scorer(toxicity.fit([], []))(b"x") == (0.0, [])


def test_wrapper_finds_constant_nodes(spark):
    pages = [(i, f"http://h.example/{i}", f"<html><body><div class=top>Welcome to Site</div><div class=body><p>Story {i} begins &amp; goes</p><p>more {i * 7}</p></div><div>All content is ours</div></body></html>") for i in range(12)]
    out = {r.page_id: r.text for r in wrapper.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Story {i} begins & goes\nmore {i * 7}" for i in range(12)}
    tree = wrapper.parse("<nav>menu</nav><article><header><h1>T</h1></header><p>a<br>b <i>c</i><script>var x='</p>'</script><aside>no</aside></article><footer>f")
    assert wrapper.main_text(tree) == "T\na b c"


def test_repeated_words_and_host_prior(spark):
    rows = [(i, "a b c d e f g h i j a b c d e x", "good") for i in range(30)] + [(100 + i, "x " * 40, "bad") for i in range(30)] + [(200, "k l m n o p q r s t u v", None)]
    out = {r.doc_id: r for r in quality.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (out[0].n_repeat_words, out[0].n_words, out[0].base_failed) == (10, 16, True)
    assert out[100].n_repeat_words == 40 and not out[100].kept
    assert out[200].kept and out[200].host_rate is None


def _best_run(same):
    """All runs of a diagonal by brute force: the matching words of the best (1 a match, -2 a substitution)."""
    best = (0, 0)
    for a in range(len(same)):
        for b in range(a + 1, len(same) + 1):
            hits = sum(same[a:b])
            best = max(best, (hits - 2 * (b - a - hits), hits))
    return best[0]


def test_leaks_equal_brute_force():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    items = [[rnd.choice(words) for _ in range(rnd.randint(12, 24))] for _ in range(8)] + [["same"] * 15]
    docs = []
    for _ in range(40):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 2)):
            part = list(rnd.choice(items))
            for at in rnd.sample(range(len(part)), rnd.randint(0, 3)):
                part[at] = "zz"
            text += part[rnd.randint(0, 3) :] + [rnd.choice(words) for _ in range(rnd.randint(0, 5))]
        docs.append(text)
    docs += [["same"] * 40, []]
    found = {(t, i): n for t, i, n, *_ in decontaminate.Index.of(list(range(len(items))), [" ".join(i).encode() for i in items]).leaks([" ".join(d).encode() for d in docs])}
    for t, doc in enumerate(docs):
        for i, item in enumerate(items):
            score = 0
            for d in range(-len(item) + 1, len(doc)):
                a, b = max(0, -d), min(len(item), len(doc) - d)
                same = [item[k] == doc[k + d] for k in range(a, b)]
                if sum(same) >= min(decontaminate.LEAST_WORDS, decontaminate.LEAST_SHARE * len(item)):
                    score = max(score, _best_run(same))
            if score >= decontaminate.LEAST_WORDS:  # a run of so many more matches than substitutions weigh
                assert found.get((t, i), 0) >= decontaminate.LEAST_WORDS, (t, i, score)
            if not score:
                assert (t, i) not in found


def test_repeated_words_on_both_sides_and_scripts_without_spaces():
    index = decontaminate.Index.of([1, 2], [b"the " * 3000, "日本語の試験問題です。次の文章を読んで答えなさい".encode()])
    assert index.leaks([b"the " * 3000])[0][:3] == (0, 0, 3000)
    assert [x[:2] for x in index.leaks(["前の文。日本語の試験問題です。次の文章を読んで答えなさいそして".encode(), "無関係の文章".encode()])] == [(0, 1)]


def test_marginals_equal_all_label_paths():
    rnd = random.Random(5)
    for n in range(1, 9):
        odds = [rnd.choice([0.01, 0.3, 4.0, 50.0]) for _ in range(n)]
        jump = tuple(tuple(rnd.uniform(0.2, 3) for _ in range(2)) for _ in range(2))
        total, toxic = 0.0, [0.0] * n
        for path in range(2**n):
            labels = [path >> k & 1 for k in range(n)]
            weight = 1.0
            for k, y in enumerate(labels):
                weight *= (odds[k] if y else 1.0) * (jump[labels[k - 1]][y] if k else 1.0)
            total += weight
            toxic = [t + weight * y for t, y in zip(toxic, labels)]
        assert np.allclose(toxicity.marginals(odds, jump), [t / total for t in toxic])


def test_long_tokens_have_features():
    model = toxicity.fit(["bad idiot here"] * 9 + ["good day here"] * 9, [1] * 9 + [0] * 9)
    scorer, token = toxicity.Scorer(model), "x-" * 60 + "idiot" + "-y" * 60
    assert "idiot" in "".join(toxicity.features_of(token)) and scorer.odds(token) == pytest.approx(model.odds(token)) and scorer.odds(token) > scorer.plain


def test_toxic_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 5, f"bad idiot {k}" if k % 5 < 2 else f"good day {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 2)) for k in range(5)], "doc_id long, toxic int")
    seen = []
    old, toxicity.fit = toxicity.fit, lambda texts, y: seen.append(len(texts))
    try:
        toxicity.fit_on(docs, labels, sample_rows=30)
        toxicity.fit_on(docs, labels, sample_bytes=100)
    finally:
        toxicity.fit = old
    assert seen[0] == 30 and 1 <= seen[1] <= 10


def test_lists_are_matched_as_by_brute_force(monkeypatch):
    rnd = random.Random(3)

    def tags(n, depth=2):
        return "".join(f"<{t}>{tags(rnd.randint(0, 3), depth - 1) if depth and t == 'div' else rnd.choice('xyz')}</{t}>" for t in (rnd.choice(["p", "div", "b"]) for _ in range(n)))

    def best(left, right):
        if not left or not right:
            return 0
        x, y = left[0], right[0]
        pair = (1.5 if x.text == y.text else 1.0) + best(x.kids, y.kids) + best(left[1:], right[1:]) if x.label == y.label else 0
        return max(pair, best(left[1:], right), best(left, right[1:]))

    for _ in range(80):
        a, b = wrapper.parse(tags(rnd.randint(0, 5))), wrapper.parse(tags(rnd.randint(0, 5)))
        wrapper.number(a), wrapper.number(b)
        wanted = best(a.kids, b.kids)
        for product in (40_000, 0):
            monkeypatch.setattr(wrapper, "PRODUCT", product)
            score, pairs = wrapper._match_lists(a.kids, b.kids)
            assert score == pytest.approx(wanted) and sum(1.5 if x.text == y.text else 1.0 for x, y in wrapper.pairs_of(pairs)) == pytest.approx(wanted)


def test_pages_of_any_depth_and_names_that_mark_nothing():
    deep = wrapper.parse("<div>" * 3000 + "<nav>MENU</nav><p>hi</p>")
    assert wrapper.main_text(deep) == "hi"
    wrapper.number(deep)
    assert len(list(wrapper.pairs_of(wrapper.match(deep, deep)[1]))) == len(wrapper.number(deep))
    inside = "<div class='share-price'>a</div><div class=register>b</div><p class='login-guide'>c</p>"
    dropped = "<div class='share-buttons'>x</div><div class=comments>y</div><div id=cookieBanner>z</div><div class='ad'>w</div>"
    assert wrapper.main_text(wrapper.parse(f"<article>{inside}{dropped}</article>")) == "a\nb\nc"
    assert wrapper.main_text(wrapper.parse("<div><a>one</a><a>two</a><a>three</a></div><div>some text with <a>a link</a></div>")) == "some text with a link"


def test_pages_under_salts_equal_those_sent_to_workers(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://{'h' if i % 3 else 'g'}.example/{i}", f"<div>Same top</div><div><p>Story {i}</p></div><div>Same end</div>") for i in range(40)], "page_id long, url string, html string")
    one = {r.page_id: r.text for r in wrapper.extract_main_text(pages).collect()}
    monkeypatch.setattr(wrapper, "BROADCAST_CHARS", 10)
    assert {r.page_id: r.text for r in wrapper.extract_main_text(pages).collect()} == one == {i: f"Story {i}" for i in range(40)}


def test_phones_keep_their_country_and_dates_never_meet():
    p = pseudonyms.pseudonymizer(b"key")
    for text, country in (("+44 20 7946 0958", "+44 "), ("+353 1 234 5678", "+353 "), ("+1 (487) 555-7209", "+1 "), ("+49 30 901820", "+49 ")):
        new = p.phone(text)
        assert new.startswith(country) and new != text and re.sub(r"[0-9]", "9", new[len(country) :]) == re.sub(r"[0-9]", "9", text[len(country) :])
    made, first = {}, 693596  # 1900-01-01
    import datetime

    for day in range(first, first + 73049, 5):
        d = datetime.date.fromordinal(day)
        for text in {f"{d.month}/{d.day}/{d.year}", f"{d.day}/{d.month}/{d.year}"}:
            made.setdefault(text, p.date(text))
    assert len(set(made.values())) == len(made)


def test_notices_equal_brute_force():
    """Every place where a notice stands with no more edits than it may have is covered by a reported notice."""
    finder, rnd = licenses.finder(), random.Random(6)
    for _ in range(60):
        parts, places, at = [], [], 0
        for _ in range(rnd.randint(1, 4)):
            notice, _, most = rnd.choice(finder.notices)
            chars = list(notice)
            for _ in range(rnd.randint(0, most)):
                chars[rnd.randrange(len(chars))] = rnd.choice("abxyz")
            filler = " ".join(rnd.choice(["qwzx", "jjkk", "zzkj"]) for _ in range(rnd.randint(1, 4)))
            parts += [filler, "".join(chars)]
            places.append((at + len(filler) + 1, at + len(filler) + 1 + len(chars)))
            at += len(filler) + len(chars) + 2
        found = finder.find(" ".join(parts))
        assert all(any(a < end and start < b for a, b, *_ in found) for start, end in places)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


@pytest.mark.parametrize("attributes", ['data-id="sidebar"', 'data-role="banner"', 'title="class=ad"', "title='id=footer'", 'alt="x class=\'ad\'"', "data-class=ad"])
def test_only_whole_attribute_names_count(attributes):
    page = f"<article><p>first words</p><div {attributes}>kept words</div></article>"
    assert wrapper.main_text(wrapper.parse(page)) == "first words\nkept words"
    assert wrapper.main_text(wrapper.parse("<article><p>first words</p><div ID = 'sidebar'>gone</div><div data-id=a class=ad>gone</div></article>")) == "first words"


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "deep words", "<p>words</p>" + "<div>" * 15_000 + "</section>" * 15_000 + "deep words", "<article>" + "<div><a href=x>l</a>" * 10_000 + "deep words"])
def test_deep_pages_end_soon(page):
    began = time.time()
    root = wrapper.parse(page)
    wrapper.number(root)
    assert len(list(wrapper.pairs_of(wrapper.match(root, root)[1]))) > 10_000
    assert "deep words" in wrapper.main_text(root)
    assert time.time() - began < 5


def test_deep_pages_through_the_operator(spark):
    rows = [(k, f"http://deep.example/{k}", "<div>" * 3000 + f"<p>words {k}</p>") for k in range(10)]
    out = wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), least_pages=2)
    assert {r.page_id: r.text for r in out.collect()} == {k: f"words {k}" for k in range(10)}


@pytest.mark.parametrize("bitmaps", [1, 3])
def test_texts_of_candidates_are_found_without_moving_texts(spark, bitmaps):
    rows = [(k, f"text {k}") for k in range(4000)] + [(None, "no id"), (9, "another of this id"), (10, None)]
    docs = frame(spark, rows).repartition(3)
    keys = docs.where("doc_id % 40 = 0 or doc_id is null or text = 'another of this id'").selectExpr("doc_id", "xxhash64(text) AS tx")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = jaccard._may_hold(docs, keys, "doc_id", "text", bitmaps)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
    assert {(k, t) for k, t in rows if k is None or k % 40 == 0 or t == "another of this id"} <= set(got) and len(got) < 200


@pytest.fixture
def no_small_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [jaccard.MOST_SPARED, -1])
def test_near_copies_are_dropped_without_moving_texts(spark, no_small_broadcasts, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MOST_SPARED", most)
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(k, f"{near} {k // 2}" if k < 1000 else " ".join(f"w{k}x{i}" for i in range(7))) for k in range(2000)] + [(None, f"{near} 1"), (None, "no id and no copy"), (5000, None), (5001, ""), (5002, " ")]
    docs = frame(spark, rows).selectExpr("*", "7 AS _bitmap").repartition(3)
    left = jaccard.keep_one(docs)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (most < 0)
    got = left.collect()
    assert left.columns == docs.columns and {r["_bitmap"] for r in got} == {7}
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got) == sorted([(0, rows[0][1]), *((k, t or "") for k, t in rows[1000:] if k is not None), (-1, "no id and no copy")])


def test_rows_that_pass_the_bitmaps_of_dropped_ones_stay(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BITMAP", 64)  # full bitmaps: all rows pass
    monkeypatch.setattr(jaccard, "MOST_BITMAPS", 1)
    docs = frame(spark, [(k, f"text {k}") for k in range(600)] + [(3, "another of this id"), (None, "no id"), (9, None)])
    rows = docs.selectExpr("doc_id", "CASE WHEN text IS NOT NULL THEN xxhash64(text) END AS tx")
    left = jaccard._without(docs, rows.where("doc_id % 2 = 0"), rows, "doc_id", "text")
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == sorted([*((k, f"text {k}") for k in range(1, 600, 2)), (3, "another of this id"), (-1, "no id"), (9, "")])


def test_members_of_sets_are_moved_once(spark, no_small_broadcasts):
    sets = jaccard.describe(frame(spark, [(k, " ".join(f"w{k // 2}x{i}" for i in range(20 + k % 2))) for k in range(40)]), "doc_id", "text", 4, 85)
    found = jaccard.prefixes(sets, 85)
    assert found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0].count("hashpartitioning(h#") == 1
    assert found.count() == 40
