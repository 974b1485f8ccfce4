"""Training-data operators against brute force, round trips and edge cases, on small tables."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import common, components, embed_dedup, html_extract, langid, media, minhash, mixing, packing, quality, suffix_dedup, url_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
#: Nulls, empty and short texts, repeated rows and ids, control characters, a long text.
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (5, "one two"), (6, "ONE two"), (None, "one two"), (None, None),
    (7, "a b c d e f g h " * 40), (8, "x" * 700), (9, "é" * 300), (10, "zz" + "é" * 300), (11, "<|endoftext|> it's 12 \x1c odd \u0130\u03a3 words"), (12, "word " * 30_000),
]


def edge(spark, kind="documents"):
    """EDGE with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(*r, "x", 1.0, b"y", 1) for r in EDGE], f"{DOC}, n string, score double, digest binary, tag int")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# components


def test_components_match_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    for x in linked - {find(x) for x in linked}:
        assert got[x] == find(x)
    assert all(find(k) == v for k, v in got.items())


def test_components_of_nothing_and_of_a_long_chain(spark):
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert {r.component_id for r in components.components(chain).collect()} == {0}


# quality and language


def test_quality_held_out_accuracy_and_edges(spark):
    got = quality.op1_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    docs = edge(spark)
    labels = spark.createDataFrame([(5, 1), (5, 1), (7, 0), (99, 1), (4, None), (None, 1)], "doc_id long, label int")
    w = quality.train(docs, labels)
    out = quality.score(docs, w, ["doc_id", "n"], name="score").collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    none = quality.train(docs, labels.where("false"))
    assert not none.any()
    assert quality.score(docs.where("false"), none, ["doc_id"]).count() == 0


def test_ftrl_learns_a_separable_set():
    rows = [(np.array([i % 2, 2]), np.array([1.0, 1.0]), i % 2) for i in range(200)]
    w = quality.ftrl(rows, 4, alpha=0.5, beta=1.0, l1=0.01, l2=0.01, epochs=3)
    assert w[1] > 0 > w[0]


def test_language_held_out_accuracy_and_edges(spark):
    d = "/root/testdata/sf0.01"
    got = langid.op9_langid(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    docs = table(spark, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    out = langid.identify(edge(spark), model, chunk=500).collect()
    assert len(out) == len(EDGE)
    by = {r.doc_id: r for r in out}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[4].lang_pred != "und"
    assert langid.identify(spark.createDataFrame([(1, "12 34 !?")], DOC), model).first().lang_pred == "und"
    nothing = langid.train(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    one = langid.train(docs.select("doc_id", "text", F.lit("xx").alias("lang")))
    assert {r.lang_pred for r in langid.identify(docs.limit(5), one).collect()} <= {"xx", "und"}


def test_language_pieces_give_the_same_sums(spark):
    model = langid.train(table(spark, "documents").select("doc_id", "text", "lang"))
    docs = table(spark, "documents")
    a = {r.doc_id: r.score for r in langid.identify(docs, model).collect()}
    b = {r.doc_id: r.score for r in langid.identify(docs, model, chunk=100).collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


@pytest.mark.parametrize("k", [2, 3, 4, 6, 9])
def test_codewords_are_apart(k):
    c = langid.codewords(k)
    assert len({tuple(r) for r in c}) == k
    assert min((a != b).sum() for i, a in enumerate(c) for b in c[:i]) >= max(1, c.shape[1] // 4)


# MinHash


def jaccard_classes(rows, size, percent):
    """Smallest ids reachable over exact links (None where there are none), and sizes of sets, by brute force."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    least = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in root], [len(x) for x in sets]


def near_copies(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    out = []
    for i in range(n):
        w = base[:] if i % 3 else [rng.choice(words) for _ in range(150)]
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_matches_brute_force(spark, size):
    rows = [*near_copies(90), *((r[0] + 1000 if r[0] else None, r[1]) for r in EDGE)]
    got = minhash.near_documents(spark.createDataFrame([(*r, 1) for r in rows], f"{DOC}, rep int"), size=size).collect()
    comp, n = jaccard_classes(rows, size, 80)
    want = Counter((i, k, c) for (i, _), k, c in zip(rows, n, comp))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_asks_for_each_text_once_across_buckets(spark, monkeypatch):
    """Near copies meet in many buckets; rows that get a text must not grow with those, and blocks of a few documents lose no link."""
    rows, wanted, cut = near_copies(150, seed=5), [], minhash.cut

    def counted(df, name):
        out = cut(df, name)
        if name == "wanted":
            wanted.append(out.count())
        return out

    monkeypatch.setattr(minhash, "cut", counted)
    monkeypatch.setattr(minhash, "across", functools.partial(minhash.across, block=8))
    got = minhash.near_documents(spark.createDataFrame(rows, DOC), size=5).collect()
    comp, n = jaccard_classes(rows, 5, 80)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, k, c) for (i, _), k, c in zip(rows, n, comp))
    assert len(wanted) == 2 and wanted[1] <= len(rows)


def test_minhash_tells_texts_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (None, c), (None, c + " z"), (None, "only here"), (5, a), (5, a)]
    for n in (1, 6):
        got = minhash.near_documents(spark.createDataFrame(rows, DOC).repartition(n)).collect()
        comp, k = jaccard_classes(rows, 5, 80)
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter((i, x, m, i == m) for (i, _), x, m in zip(rows, k, comp))


def test_signatures_keep_the_low_bits():
    m = np.arange(256, dtype=np.uint32) * np.uint32(2654435761)
    words = minhash.Signer.packed(m).view(np.uint64)
    assert [int(words[i // 32] >> np.uint64(2 * (i % 32)) & np.uint64(3)) for i in range(256)] == [int(x) & 3 for x in m]


def test_minhash_of_nothing(spark):
    assert minhash.near_documents(spark.createDataFrame([], DOC)).count() == 0


def test_packed_signatures_estimate_similarity(spark):
    rng = np.random.default_rng(1)
    s = minhash.Signer()
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    rows = spark.createDataFrame([(s.packed(s.minima(a)).tolist(), s.packed(s.minima(b)).tolist())], "a array<long>, b array<long>")
    assert abs(rows.select(minhash.estimate(F.col("a"), F.col("b"))).first()[0] - 900 / 1100) < 0.15
    assert rows.select(minhash.estimate(F.col("a"), F.col("a"))).first()[0] == 1.0


# mixing


def test_mixing_meets_its_limits(spark):
    docs = table(spark, "documents")
    out = mixing.mix(docs, max_passes=2.0, block_docs=3).toPandas()
    assert len(out) == docs.count() and out.mix_copies.min() >= 1 and out.mix_copies.max() <= 3
    t = out.assign(m=out.mix_tokens * out.mix_copies).groupby("source").agg(t=("mix_tokens", "sum"), m=("m", "sum"))
    assert ((t.m / t.t) <= 2 + 1e-9).all()
    assert mixing.realise(docs, max_passes=2.0, block_docs=3).count() == out.mix_copies.sum()
    lim = mixing.mix(docs, budget=5000.0, target_entropy=2.0).toPandas()
    assert (lim.mix_tokens * lim.mix_copies).sum() <= 5000
    with pytest.raises(ValueError):
        mixing.mix(docs, max_passes=2.0, max_sources=1)


@pytest.mark.parametrize("size", [1, 3])
def test_mixing_realises_the_permutation(spark, size):
    """Each source's partial pass is the longest run of its permutation within the budget, by a plain version."""
    docs = table(spark, "documents").select("doc_id", "text", "source")
    rows = mixing.mix(docs, max_passes=1.5, block_docs=size).toPandas()
    tokens = rows.groupby("source").mix_tokens.sum()
    names = list(tokens.index)
    x = mixing.plan_weights([float(t) for t in tokens], None, 1.5)
    times = dict(zip(names, mixing.passes([float(t) for t in tokens], x, None)))
    partial = 0
    for s, g in rows.groupby("source"):
        g = g.sort_values(["mix_order", "mix_block", "mix_place", "doc_id"])
        whole = int(times[s] + 1e-9)
        left = int((times[s] - whole) * tokens[s] + 1e-6)
        before, expect = 0, {}
        for (bo, b), t in g.groupby(["mix_order", "mix_block"], sort=True).mix_tokens.sum().items():
            some = g[(g.mix_order == bo) & (g.mix_block == b)]
            expect |= dict(zip(some.doc_id, (some.mix_tokens.cumsum() + before <= left).astype(int))) if left and before <= left else dict.fromkeys(some.doc_id, 0)
            before += t
        assert dict(zip(g.doc_id, g.mix_copies - whole)) == expect
        partial += sum(expect.values())
    assert partial


def test_mixing_edges(spark):
    docs = edge(spark).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.lit("a")).cast("string"))
    out = mixing.mix(docs, max_passes=2.0)
    assert out.count() == len(EDGE) and set(docs.columns) < set(out.columns)
    assert mixing.mix(docs.where("false"), max_passes=2.0).count() == 0
    assert mixing.mix(docs.where("doc_id in (1, 2, 3)"), max_passes=2.0).select(F.sum("mix_copies")).first()[0] == 3
    clash = docs.withColumns({"mix_tokens": F.lit(1), "mix_note": F.lit("own"), "key": F.lit(2), "row": F.lit(3), "mix_copies": F.lit(9)})
    names = mixing.names_for(clash.columns)
    assert names["tokens"] == "mix_tokens_" and names["place"] == "mix_place"
    got = mixing.mix(clash, max_passes=2.0).collect()
    assert len(got) == len(EDGE) and {(r.mix_tokens, r.mix_note, r.key, r.row, r.mix_copies) for r in got} == {(1, "own", 2, 3, 9)} and {r.mix_copies_ for r in got} <= {1, 2}
    back = mixing.realise(clash, max_passes=2.0)
    assert back.columns == clash.columns and back.count() == sum(r.mix_copies_ for r in got)
    # rows without ids are spread over blocks by their texts
    many = spark.range(200).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"), F.lit("a").alias("source"))
    assert mixing.mix(many, max_passes=2.0, block_docs=10).select("mix_block").distinct().count() > 10
    with pytest.raises(ValueError):
        mixing.plan_weights([1.0, 2.0])


# packing


def check_packing(rows, pieces, size):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want[(i, len(ids))] += len(ids)
    got = Counter()
    for p in pieces:
        got[(p.doc_id, p.doc_tokens)] += p.length
    assert got == want
    texts = {}
    for i, text in rows:
        texts.setdefault((i, len(ids := np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))), []).append(ids)
    for p in pieces:
        assert any(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in texts[(p.doc_id, p.doc_tokens)])
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, sum(map(sum, ([n for _, n in s] for s in by.values())))


@pytest.mark.parametrize("size,open_windows", [(2048, 64), (64, 2), (128, 1)])
def test_packing_holds_each_token_once(spark, size, open_windows):
    import public_tokenizers

    rows = EDGE + [tuple(r) for r in table(spark, "documents").select("doc_id", "text").collect()]
    docs = spark.createDataFrame([(*r, 0) for r in rows], f"{DOC}, length int").repartition(5)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=size, open_windows=open_windows, merge_every=2).collect()
    padding, total = check_packing(rows, pieces, size)
    assert padding <= 0.25 * total if size < 2048 else padding <= 0.02 * total
    assert packing.pack(docs.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_word_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, w = Tokenizer.from_file(path), packing.WordTokens(path)
    rng = random.Random(3)
    alphabet = "abcdefgzAZ'.,-!<|>0123éÈßñÿµªº²Σςİıſ\u0301\u200b\u00a0\u2003\x1c\t\n  漢字😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["don't we'll I'VE they're it's", "<|startoftext|>x<|endoftext|>y", "e\u0301tude \u212b"]
    for text in texts:
        assert w.of(text, 1).tolist() == t.encode(text, add_special_tokens=False).ids + [1], repr(text)


# HTML


LONG = "the cat and the dog of the house is in the garden with a bird. " * 5


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("plain &amp; &lt;simple&gt; &#233;", "plain & <simple> é"),
        ("<nav>a</nav><article><h1>T</h1><p>x\n y<b>z</b></article><footer>f</footer>", "T x yz"),
        ("<script>var a='<article>no';</script><main>yes<!-- no --> <br>on<style>p{}</style></main>", "yes on"),
        ("<article>a<aside>b</aside>c<form>d<input></form>e<div class='comments'>f</div></article>g", "a c e"),
        ("<article><header><h1>H</h1></header><p>b</p><footer>f</footer></article>", "H b"),
        (f"<div class='menu'>m</div><h2>Head</h2><p>{LONG}</p><p>short</p><p>{LONG}</p><div><a href=x>all link text here</a></div>", f"Head {LONG}short {LONG}".strip()),
        ("<article><p>a < b <i x='", "a < b"), ("<article>x<br/>y</article><div role=banner>z</div>", "x y"),
        ("<article><p hidden>no<p>yes<div style='display: none'>no</div></article>", "yes"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_pages(spark):
    import re
    from html import unescape

    pages = table(spark, "pages").withColumn("text", F.lit(1))
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        t = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        t = " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", t))).split())
        assert got[r.page_id].text == t and got[r.page_id].n_chars == len(t)
    odd = spark.createDataFrame([(1, "u", None), (None, None, "<p>a</p>"), (1, "u", None)], "page_id long, url string, html string")
    assert html_extract.extract(odd).count() == 3 and html_extract.extract(odd.where("false")).count() == 0


# suffix array


def repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[j : j + length] for b in data for j in range(len(b) - length + 1))
    out = Counter()
    for (i, _), b in zip(rows, data):
        cut = np.zeros(len(b) + 1, int)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                cut[j] += 1
                cut[j + length] -= 1
        gone = np.cumsum(cut)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[(i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def passages(seed=5):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdef ghij") for _ in range(n))
    shared = [text(n) for n in (90, 199, 200, 201, 230, 400, 900)]
    rows = []
    for i in range(60):
        rows.append((i, text(rng.randrange(300)) + rng.choice(shared) + text(rng.randrange(300)) + rng.choice(shared)[rng.randrange(40) :] + text(rng.randrange(50))))
    return rows


@pytest.mark.parametrize("length", [200, 64, 256])
def test_repeated_strings_match_brute_force(spark, length):
    rows = passages() + [r for r in EDGE if r[0] != 12]
    docs = spark.createDataFrame([(*r, 1) for r in rows], f"{DOC}, span int").repartition(4)
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs, length).collect())
    assert got == repeats(rows, length)


def test_long_texts_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1_000)
    rows = passages(6)[:20] + [(100, "".join(t for _, t in passages(7)[:30]))]
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOC)).collect())
    assert got == repeats(rows, 200)


def test_multikey_quicksort_sorts_bytes():
    rng = random.Random(9)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(1500)] + [b"q" * 50] * 200 + [b""] * 3
    order = suffix_dedup.multikey(suffix_dedup.symbols(strings, 60))
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
    first, then = suffix_dedup.symbols([s[:8] for s in strings], 8), suffix_dedup.symbols(strings[::-1], 60)
    order = suffix_dedup.multikey(first, then)
    assert [(strings[i][:8], strings[-1 - i]) for i in order] == sorted((s[:8], t) for s, t in zip(strings, strings[::-1]))


def test_boundaries_of_many_small_buckets(spark, monkeypatch):
    """Buckets of two or three rows: most neighbours are in different buckets, and ends go through several levels."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", 3)
    rows = passages(8)[:25]
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOC)).collect())
    assert got == repeats(rows, 200)


def test_repeats_match_brute_force_on_documents(spark):
    rows = [tuple(r) for r in table(spark, "documents").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in suffix_dedup.op6_suffix_dedup(spark, SF).collect())
    assert got == repeats(rows, 200)


def test_repeated_rows_are_repeats(spark):
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(500))
    rows = [(1, text)] * 5 + [(None, text[100:])] * 2 + [(2, text[:150] + "-" + text[300:])]
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOC)).collect())
    assert got == repeats(rows, 200)


def test_repeats_rewrite_texts(spark):
    rows = [(1, "q" + "é" * 150 + "tail"), (2, "zz" + "é" * 150), (3, None), (None, "short")]
    docs = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], f"{DOC}, tag int, `raw.x` int")
    out = {r.others.tag: (r.others.doc_id, r.text, r.removed) for r in suffix_dedup.without_repeats(docs).collect()}
    assert out == {0: (1, "qtail", 300), 1: (2, "zz", 300), 2: (3, None, 0), 3: (None, "short", 0)}
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0


# media


def test_media_round_trip(spark):
    docs = edge(spark)
    path = common.table_path(spark, "media")
    media.store(docs, path)
    back = media.load(spark, path).collect()
    want = Counter()
    for i, t in EDGE:
        raw = (t or "").encode()
        want[(i, raw + b"\xff" * (-len(raw) % 576 if raw else 576))] += 1
    assert Counter((r.key, media.from_png(bytes(r.media))) for r in back) == want
    got = Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in media.features(media.load(spark, path)).collect())
    assert got == Counter({(i, len(p.rstrip(b"\xff")), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])): n for (i, p), n in want.items()})


def test_media_ranges_and_damage(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    media.store(table(spark, "documents"), path)
    reader = media.MediaReader(path, 1, 1, 2)
    reader.split = 5_000  # many ranges
    parts = reader.partitions()
    keys = [k for p in parts for b in reader.read(p) for k in b.column("key").to_pylist()]
    assert len(parts) > 3 and sorted(keys) == sorted(r.doc_id for r in table(spark, "documents").collect())
    reader.most = 2
    few = reader.partitions()
    assert len(few) < len(parts) and sorted(k for p in few for b in reader.read(p) for k in b.column("key").to_pylist()) == sorted(keys)
    name = f"{tmp_path}/m/{parts[0].ranges[0][0]}"
    raw = bytearray(open(name, "rb").read())
    raw[60] ^= 1
    open(name, "wb").write(raw)
    with pytest.raises(OSError):
        list(reader.read(parts[0]))
    with pytest.raises(ValueError):
        media.from_png(b"no")
    empty = common.table_path(spark, "media")
    media.store(edge(spark).where("false"), empty)
    assert media.load(spark, empty).count() == 0


def test_media_appends_and_overwrites(spark):
    path = common.table_path(spark, "media")
    one, two, three = (spark.createDataFrame([(i, f"text {i}")], DOC) for i in (1, 2, 3))
    media.store(one, path)
    media.store(two, path)
    assert sorted(r.key for r in media.load(spark, path).collect()) == [1, 2]
    rows = three.mapInArrow(media._payloads, "key long, payload binary")
    rows.write.format("media_archive").mode("overwrite").save(path)
    assert [r.key for r in media.load(spark, path).collect()] == [3]


def test_media_fetches_a_member_again(spark, tmp_path, monkeypatch):
    """The first reads of a run fail, come short or are damaged; members are then fetched one by one by their offsets."""
    from pyarrow import fs as pafs

    media.store(table(spark, "documents").limit(12).coalesce(1), f"file://{tmp_path}/m")
    local, calls = pafs.LocalFileSystem(), Counter()

    class Flaky:
        def open_input_stream(self, p):
            return local.open_input_stream(p)

        def get_file_info(self, s):
            return local.get_file_info(s)

        def open_input_file(self, p):
            f = local.open_input_file(p)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *a):
                    f.close()

                def read_at(self, n, offset):
                    calls[(n, offset)] += 1
                    raw = f.read_at(n, offset)
                    if offset and raw[-24:-16] == media.MAGIC:
                        return raw
                    if calls[(n, offset)] == 1:  # every first read goes wrong
                        if len(calls) % 3 == 0:
                            raise OSError("lost")
                        return raw[: n // 2] if len(calls) % 3 == 1 else b"\0" * n
                    return raw

            return File()

    monkeypatch.setattr(media, "_fs", lambda path: (Flaky(), f"{tmp_path}/m"))
    reader = media.MediaReader(f"file://{tmp_path}/m", 1, 1, 4)
    got = [(k, media.from_png(m)) for p in reader.partitions() for b in reader.read(p) for k, m in zip(*(c.to_pylist() for c in b.columns))]
    monkeypatch.undo()
    assert len(got) == 12 and max(calls.values()) > 1
    assert sorted(got) == sorted((r.key, media.from_png(bytes(r.media))) for r in media.load(spark, f"file://{tmp_path}/m").collect())


def test_media_features_by_a_plain_version(spark):
    """Every column from the text alone, with zlib and plain loops."""
    import struct

    rows = [r for r in EDGE if r[0] != 12]
    path = common.table_path(spark, "media")
    media.store(spark.createDataFrame(rows, DOC), path)
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        lines = [p[k : k + 576] for k in range(0, len(p), 576)]
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 576, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines), 1)) + chunk(b"IEND", b"")
        hist = [sum(x >> 5 == k for x in p) for k in range(8)]
        edges = sum(abs(a - b) for x in lines for a, b in zip(x, x[1:]))
        feature = f"576x{len(lines)};sum={sum(p)};edges={edges};hist={','.join(map(str, hist))}"
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature)] += 1
    assert Counter(tuple(r) for r in media.features(media.load(spark, path)).collect()) == want


# embeddings


def vector_rows():
    rng = np.random.default_rng(8)
    rows = []
    for i in range(260):
        v = rng.standard_normal(8) if i % 2 else rng.standard_normal(8) * 0.15 + np.arange(8)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3))
    rows += [(300 + i, rows[0][1], 0) for i in range(30)] + [(400, None, 0), (401, [], 0), (402, [0.0] * 8, 0), (403, [float("nan")] * 8, 0), (404, [1.0, None], 0), (405, rows[0][1], None), (406, [1.0, 2.0], 0), (406, [1.0, 2.0], 0)]
    # ids that are null or held by different vectors
    return rows + [(None, rows[0][1], 0), (None, rows[1][1], 1), (None, [5.0, -3.0], 2), (None, [5.0, -3.0], 2), (1, rows[4][1], 1), (1, [1.0, 0.0, 7.0], 0), (1, [-9.0, 0.5, 0.25], 0), (1, None, 0), (None, None, None)]


def vector_classes(rows):
    """(n_links, component_id) of each row by brute force."""
    n, root, links = [0] * len(rows), list(range(len(rows))), []
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            _, b, lb = rows[j]
            if la is None or la != lb or not a or not b or len(a) != len(b) or None in a or None in b:
                continue
            x, y = np.array(a), np.array(b)
            with np.errstate(all="ignore"):
                c = x @ y / np.sqrt((x @ x) * (y @ y))
            if np.isfinite(c) and c >= 0.93:
                n[i] += 1
                n[j] += 1
                links.append((i, j))
    for _ in rows:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    least = {}
    for r, (i, *_) in zip(root, rows):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(k, least.get(r)) for k, r in zip(n, root)]


@pytest.mark.parametrize("kind,block", [("float", 16), ("double", 512)])
def test_vectors_match_brute_force(spark, kind, block):
    rows = vector_rows()
    vectors = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, rep string").repartition(3)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(vectors, block=block).collect())
    assert got == Counter((i, n, c, i == c) for (i, *_), (n, c) in zip(rows, vector_classes(rows)))
    assert embed_dedup.near_vectors(vectors.where("false")).count() == 0


def test_vectors_of_many_tables_and_text_labels(spark):
    """Enough vectors of one label for several bits and tables; every link is found."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(12).astype(np.float32)], "a/b") for i in range(900)]
    for i in range(900, 1100):
        rows.append((i, [float(x) for x in (np.array(rows[i % 60][1]) + rng.standard_normal(12) * 0.12).astype(np.float32)], "a/b"))
    assert embed_dedup.plan_tables(len(rows), 0.93, 1e-5)[0] >= 5
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), block=64).collect())
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.93
    np.fill_diagonal(close, False)
    root = np.arange(len(rows))
    while True:
        new = np.minimum(root, np.where(close, root[None, :], len(rows)).min(axis=1))
        if (new == root).all():
            break
        root = new
    assert close.sum() > 300 and got == Counter(zip(range(len(rows)), close.sum(axis=1).tolist(), root.tolist()))


def test_table_plan_grows_slowly():
    plans = [embed_dedup.plan_tables(n, 0.93, 1e-5) for n in (2, 10**3, 10**6, 10**9, 10**12)]
    assert [b for b, *_ in plans] == [1, 5, 15, 25, 35]  # no bound: buckets stay at the same size
    assert all(t < 1200 for _, t, _ in plans) and {m for *_, m in plans} == {plans[0][2]}


# URLs


def test_url_rules_and_list(spark):
    urls = [
        ("http://a.NET/x", "a.net", "/x", "net/", "block"), ("http://www.example.net/en/1?x#y", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("x://b.org/fr/?q", "b.org", "/fr/", "org/fr/", "allow"),
        ("http://nonet/x", "nonet", "/x", None, "allow"), ("http://a.net?x", "a.net", "", None, "allow"), (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"),
        ("http://www.Listed.de/p.html?x", "www.listed.de", "/p.html", None, "block"), ("http://listed.de/q", "listed.de", "/q", None, "allow"), ("http://ÉA.org/fr", "Éa.org", "/fr", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)], "page_id long, url string, block string")
    listed = spark.createDataFrame([("listed.de/p",), (None,), ("listed.de/p",)], "canonical string")
    for blocks in (1, 65_536):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed, blocks=blocks).collect()}
        assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages, listed.where("false")).where("listed or maybe_listed").count() == 0
    assert url_filter.filter_urls(pages.where("false"), listed).count() == 0
    by_join = url_filter.filter_urls(pages, listed, broadcast_blocks=0)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in by_join.collect()} == {i: u[1:] for i, u in enumerate(urls)}
    assert [url_filter.blocks_for(n) for n in (0, 1000, 10**7)] == [64, 256, 1 << 22]


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"))
    out = url_filter.filter_urls(pages, keys, rules=(), blocks=1024)
    assert out.where("listed").count() == 3000 and out.where("listed and not maybe_listed").count() == 0
    assert out.where("maybe_listed and not listed").count() < 600
