"""Token id files, the conversation trie and phrase collocations against plain versions, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import common, huffman, phrases, prefix_trie

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string"


# token ids


def test_code_lengths_are_optimal_and_limited():
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 40, 300):
        counts = np.array([int(1.4 ** rng.randrange(60)) + 1 for _ in range(n)])
        free = huffman.code_lengths(counts, 40)
        heap = sorted(counts.tolist())
        cost = 0
        while len(heap) > 1:
            a, b = heap.pop(0), heap.pop(0)
            cost += a + b
            heap.append(a + b)
            heap.sort()
        if n > 1:
            assert int((counts * free).sum()) == cost and sum(2.0 ** -int(x) for x in free) == 1
        limit = max(1, (n - 1).bit_length())
        tight = huffman.code_lengths(counts, limit + 1)
        assert tight.max() <= limit + 1 and (n == 1 or sum(2.0 ** -int(x) for x in tight) == 1)
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5), 2)


def test_code_is_canonical_and_blocks_decode():
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.3, 5000) % 700
    known, counts = np.unique(ids, return_counts=True)
    code = huffman.Code(known, huffman.code_lengths(counts, 12))
    shown = sorted((int(code.bits[i]), int(i), format(int(code.code[i]), f"0{code.bits[i]}b")) for i in known)
    assert [s[2] for s in shown] == sorted(s[2] for s in shown)  # in this order codes grow
    for n in (0, 1, 255, 256, 257, 5000):
        raw, points = code.encode(ids[:n])
        bits = "".join(format(int(code.code[i]), f"0{code.bits[i]}b") for i in ids[:n])
        assert raw == int(bits.ljust(-(-len(bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bits) // 8), "big")
        assert (code.decode(raw, points, n) == ids[:n]).all()
    with pytest.raises(ValueError):
        code.encode(np.array([int(known[0]), 699 if 699 not in known else 701]))


def plain_ids(rows):
    """(doc_id, n, crc) in order of doc_id, from the tokenizer itself."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    out = []
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, len(ids), zlib.crc32(ids.tobytes())))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def read_back(spark, docs, **options):
    path = common.table_path(spark, "ids")
    huffman.encode(docs, TOKENIZER, path, max_mb=options.pop("max_mb", 128))
    pieces = huffman.load(spark, path, **options)
    return path, pieces, sorted(map(tuple, huffman.digests(pieces).collect()), key=lambda r: (r[1], r[0] is not None))


def test_ids_of_documents(spark):
    got = sorted(map(tuple, huffman.op11_token_ids(spark, SF).collect()))
    rows = [tuple(r) for r in common.documents(spark, SF).select("doc_id", "text").collect()]
    start, want = 0, []
    for doc, n, crc in plain_ids(rows):
        want.append((doc, start, n, crc))
        start += n
    assert got == want


def test_ids_edges(spark, monkeypatch):
    """Nulls, empty texts, repeated ids and rows, clashing names, a text over many blocks and files, an empty table."""
    rows = [(7, "a b c"), (None, "first"), (3, None), (3, ""), (3, ""), (5, "The <|endoftext|> it's 12 \x1c odd İΣ"), (-4, "x" * 900), (9, "word é and more. " * 150_000), (8, "zz")]
    docs = spark.createDataFrame([(*r, b"x", 1, 2) for r in rows], f"{DOC}, ids binary, seen long, tie long").repartition(3)
    path, pieces, got = read_back(spark, docs, max_mb=0, split_mb=0.05)
    assert pieces.rdd.getNumPartitions() > 2 and pieces.where("doc_id = 9").count() > 2
    assert [r[0] for r in got] == [None, -4, 3, 3, 3, 5, 7, 8, 9]
    assert [r[1] for r in got] == list(np.cumsum([0, *(r[2] for r in got[:-1])]))
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(d), n, c) for d, n, c in plain_ids(rows))
    with pytest.raises(Exception, match="holds a dataset"):
        huffman.encode(docs, TOKENIZER, path)
    assert read_back(spark, docs.where("false"))[2] == []


def test_ids_damaged_block_is_refused(spark):
    from pyarrow import fs as pafs

    path, pieces, _ = read_back(spark, spark.createDataFrame([(i, "some words here " * 50) for i in range(20)], DOC).coalesce(1))
    fs, root = pafs.FileSystem.from_uri(path)
    name = next(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".ids"))
    with fs.open_input_stream(name) as f:
        raw = bytearray(f.read())
    raw[40] ^= 1
    with fs.open_output_stream(name) as f:
        f.write(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        pieces.collect()


# conversation trie


def plain_trie(sequences):
    """sequences: conv -> list of (role, text). Rows of the contract, node by node."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in convs if len(sequences[c]) == len(path))
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        childless = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), sum(len(p) == len(path) + 1 for p in under), len(childless),
            sum((len(members[p]) - 1) * words(p) for p in under), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def by_conv(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in out.items()}


def test_trie_of_random_conversations(spark):
    rng = random.Random(8)
    rows = []
    for c in range(60):
        for t in range(rng.choice((1, 2, 3, 5, 9, 17))):
            rows.append((c - 5, t, rng.choice(("user", "assistant")) if t % 4 else "user", rng.choice(("a", "b c", " d\x0be\x1cf ")) if t < 3 or rng.random() < 0.2 else "same words"))
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(by_conv(rows))


def test_trie_query_matches_a_plain_rebuild(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    original = by_conv(rows)
    again = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        again[c] = original.get(c - c % 20, [])[:h] + turns[h:]
    assert sorted(map(tuple, prefix_trie.op12_prefix_trie(spark, SF).collect()), key=str) == plain_trie(again)


def test_trie_edges(spark, monkeypatch):
    """Nulls, ties, repeated rows, turnless and long conversations, clashing names, no rows."""
    monkeypatch.setattr(prefix_trie, "SPAN", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rows = [(1, None, None, "x"), (1, 0, "user", None), (1, 0, "user", None), (2, 5, "", "x"), (2, None, "", "x"), (None, 1, "user", "x"), (3, 1, "b", "t"), (3, 1, "a", "t")]
    rows += [(c, t, "user", "long way") for c in (10, 11, 12, 13, 14) for t in range(70)] + [(15, t, "user", "long way") for t in range(33)]
    schema = "conv_id long, turn long, role string, text string, node long, depth int, name string"
    table = spark.createDataFrame([(*r, 1, 2, "n") for r in rows], schema).repartition(4)
    assert sorted(map(tuple, prefix_trie.conversation_trie(table).collect()), key=str) == plain_trie(by_conv(rows))
    assert prefix_trie.conversation_trie(table.where("false")).collect() == []
    turns = prefix_trie.numbered(prefix_trie.as_turns(table))
    nobody = prefix_trie.trie(turns.where("false"), turns.select("conv")).collect()
    assert [tuple(r)[:7] for r in nobody] == [(1, 0, None, 9, 0, 1, 0)]
    assert nobody[0].ends_sha256 == hashlib.sha256(b"1,2,3,10,11,12,13,14,15").hexdigest()


def test_names_are_dense(spark):
    names = prefix_trie.named(spark.range(1000).select((F.col("id") % 137).alias("key")).repartition(7)).collect()
    assert sorted(r.name for r in names) == list(range(137)) and len({r.key for r in names}) == 137


# phrases


def plain_phrases(rows, min_count=10, max_words=3, covered=50):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    longer = Counter()
    for p, a in cand.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                sub = (p[0], *p[i : i + k])
                longer[sub] = max(longer[sub], a)
    out = []
    for p, a in cand.items():
        if 100 * longer[p] < covered * a or not longer[p]:
            cuts = [(1000000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
            score, _, left, right = min(cuts)
            out.append((p[0], " ".join(p[1:]), a, left, right, n[p[0]], score))
    return sorted(out)


def test_phrases_of_documents(spark):
    rows = [(r.lang, r.text) for r in common.documents(spark, SF).select("lang", "text").collect()]
    want = plain_phrases(rows)
    # small shards cut texts, and a filter of 64 bits lets everything pass
    for options in ({}, {"shard_bytes": 700, "filter_bits": 6}):
        got = phrases.collocations(common.documents(spark, SF), **options)
        assert sorted(map(tuple, got.collect())) == want
    first = phrases.best(common.documents(spark, SF), 50).collect()
    for lang in {w[0] for w in want}:
        some = sorted((w for w in want if w[0] == lang), key=lambda w: (-w[6], -w[2], w[1].encode()))[:50]
        assert [(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in sorted(first, key=lambda r: r["rank"]) if r.lang == lang] == some


def test_longer_phrases(spark):
    rng = random.Random(2)
    rows = [(rng.choice(("en", None)), " ".join(rng.choice("abcdef") + rng.choice(("", "", ".", ",")) for _ in range(rng.randrange(60)))) for _ in range(80)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases.collocations(docs, max_words=5, min_count=6, covered=80, shard_bytes=300)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 6, 5, 80)


def test_phrases_edges(spark):
    """Nulls, empty texts, repeated rows, control characters, overlaps, a long text without an end, one long word, clashing names, no rows."""
    rows = [
        ("en", None), ("en", ""), (None, "a b"), ("en", " \t.;\n"), ("x", "Été ÉTÉ o\x00k\x1cz a b,"), ("en", "go go go go go go go go go go go go go"), ("en", "w" * 2_000_000 + " end"),
        ("en", "New York " * 40_000), ("fr", "tab\there\rnew\vline\fpage"), *[("und", "A B c! a b C")] * 12,
    ]
    docs = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "lang string, text string, a long, phrase string, n long").repartition(4)
    got = phrases.collocations(docs, shard_bytes=100_000)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows)
    assert phrases.best(docs.where("false")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    """The products of large counts."""
    a, left, right = 900_000_000_001, 900_000_000_007, 1_800_000_000_003
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(f"{phrases.SCORE} as score").first()
    assert row.score == 1000000 * a * a // (left * right)
