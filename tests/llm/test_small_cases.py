"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelake.llm import common, decontaminate, embedding_dedup, jaccard_join, line_quality, lm_score, mixing, sharding, suffix_array, suffix_dedup, token_counts, token_files
from wavelake.llm.common import components, gram_hashes, word_hashes
from wavelake.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id long, batch int, key int"
RNG = np.random.default_rng(7)
VOCAB = ["wo" + "".join(RNG.choice(list("abcdeé"), 4)) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


def edited(text, places, word="changed"):
    w = text.split(" ")
    for p in places:
        w[p] = word + str(p)
    return " ".join(w)


BASE = prose(120, 1)
TEXTS = [
    (1, BASE), (2, BASE), (3, edited(BASE, [60])), (4, edited(BASE, [10, 110])), (5, edited(BASE, [5, 30, 55, 80, 105])), (6, None), (7, ""), (8, "  \n\t "), (9, "one"), (10, "One"),
    (11, "a b c"), (12, "a b c"), (13, "a b c d"), (14, prose(3000, 2)), (15, "x" * 3000), (16, "x" * 500), (17, prose(40, 3) + "\n" + prose(60, 4)), (18, prose(60, 4)), (None, BASE), (19, prose(30, 5)), (19, prose(30, 5)),
    (19, prose(30, 6)), (20, "tab\there  double  space \n end "), (21, "<|endoftext|> it's they'll 123 4567 ... ▁ 日本語 😀"), (22, edited(BASE, [60])),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", None if d == 9 else f"s{(d or 0) % 3}", len(t or ""), 1, 5, 6, 7) for d, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def test_token_counts(docs, empty):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    t = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    want = sorted((d or 0, len(t.encode(x, add_special_tokens=False).ids) if x else 0) for d, x in TEXTS)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.token_counts(docs, path).collect()) == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_count_ties():
    c = token_counts.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("b", -3.0), ("ab", -4.0)])
    assert c.segment("▁aa") == 2  # equal scores: the longer piece
    assert c.segment("▁aab") == 3
    assert c.segment("▁é") == 3  # unknown: its two bytes


def brute_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out, start = [], 0
    for d, x in sorted(((d, x or "") for d, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).view(np.int64))):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(docs, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    assert sorted((tuple(r) for r in token_files.token_digest(docs, path).collect()), key=str) == sorted(brute_tokens(TEXTS), key=str)
    assert docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    assert token_files.token_digest(empty, path).count() == 0


@given(st.lists(st.text(alphabet="ab é.\n\t'1 ", max_size=30), max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_library(texts):
    enc = token_files.encoder(tokenizer_path("byte_bpe_50k.json"))
    for x in texts:
        assert enc.encode(x) == enc._whole(x)


@pytest.mark.parametrize("width", [1, 5, 8, 11, 16, 17, 32])
def test_packing(width):
    import io

    ids = np.random.default_rng(width).integers(0, 2**width, 10_001, dtype=np.uint64).astype(np.uint32)
    assert np.array_equal(token_files.unpack(token_files.pack(ids, width), len(ids), width), ids)
    out = io.BytesIO()
    w = token_files.Writer(out, 2**width)
    w.add(np.array([3, 9]), np.array([4000, 0], np.uint64), ids[:4000])
    w.add(np.array([11]), np.array([6001], np.uint64), ids[4000:])
    assert w.close() == (3, 10_001)
    r = token_files.Reader(out.getvalue())
    assert np.array_equal(r.document(0), ids[:4000]) and len(r.document(1)) == 0 and np.array_equal(r.document(2), ids[4000:]) and np.array_equal(r.span(4090, 8200), ids[4090:8200])


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    size, target, taken = Counter(), {}, Counter()
    source = {d: None if d == 9 else f"s{(d or 0) % 3}" for d, _ in TEXTS}
    for r in rows:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert sum(size.values()) == sum(len(words(t)) for _, t in TEXTS)
    assert all(abs(taken[s] - target[s]) <= 0.5 and target[s] <= 3 * size[s] for s in size)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows))
    assert mixing.mix(empty).count() == 0
    got = mixing.take(docs)
    assert got.columns == docs.columns and got.count() > 0


def brute_mix(spark, docs, rows, quality, seed=11):
    """rows: (doc_id, source, text). Words taken of each row, as a sorted list of (doc_id, size, taken, epochs)."""
    hashed = docs.select("doc_id", "source", F.xxhash64("text").alias("hash"), mixing.draw(F.struct("doc_id", F.xxhash64("text").alias("hash")), seed).alias("u")).distinct().collect()
    u = {(r["doc_id"], r["source"], r["hash"]): r["u"] for r in hashed}
    text = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    units = [(d, s, text(t), len(words(t))) for d, s, t in rows]
    sizes = Counter()
    for _, s, _, n in units:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = mixing.targets(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(names)})
    out = []
    for s in names:
        budget = round(target[s])
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        mine = sorted((x for x in units if x[1] == s), key=lambda x: (-math.log(u[x[:3]]) / quality.get(x[0], 1.0), x[0] is not None, x[0] or 0, x[2]))
        for d, _, _, n in mine:
            part = min(n, rest)
            rest -= part
            out.append((d, n, epochs * n + part, epochs))
    return sorted(out, key=str)


def test_mixing_against_brute_force(spark, docs):
    extra = [(None, prose(9, 70 + i % 3), "en", "s1", 0, 1, 5, 6, 7) for i in range(40)] + [(50, prose(30, 80), "en", "s0", 0, 1, 5, 6, 7)] * 30
    df = docs.union(spark.createDataFrame(extra, SCHEMA))
    rows = [(r["doc_id"], r["source"], r["text"]) for r in df.collect()]
    quality = {d: 0.5 + (d % 4) for d in range(1, 23)}
    table = spark.createDataFrame([(d, w) for d, w in quality.items()] + [(5, 0.1), (7, -3.0), (None, 9.0)], "doc_id long, weight double")
    quality[7] = max(quality[7], -3.0)
    want = brute_mix(spark, df, rows, quality)
    for each in (50_000, 3):
        got = mixing.mix(df, quality=table, rows_per_bucket=each).collect()
        assert sorted(((r["doc_id"], r["size"], r["taken"], r["epochs"]) for r in got), key=str) == want
    # the stage repeats rows: whole texts, an epoch each and one more where the rest reaches them; rows without words stay
    times = Counter()
    for d, n, taken, epochs in want:
        times[d] += 1 if n == 0 else epochs + (taken > epochs * n)
    kept = mixing.take(df, quality=table)
    got = Counter(r["doc_id"] for r in kept.collect())
    assert kept.dtypes == df.dtypes and got == Counter({d: k for d, k in times.items() if k})


def test_targets_are_shared_again():
    assert mixing.targets({"a": 100, "b": 1, "c": 1}, {"a": 1, "b": 2, "c": 3}) == {"a": 96.0, "b": 3.0, "c": 3.0}
    assert mixing.targets({}, {}) == {}
    assert sorted(["b", None, "a", "é"], key=mixing.by_code_point) == ["a", "b", "é", None]


def weighted(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def shingled(w):
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute_leaks(rows, items):
    out = set()
    for d, t in rows:
        for i, x in items:
            w, v = words(t), words(x)
            if v and any(weighted(shingled(w[a : a + len(v)]), shingled(v)) >= 0.75 for a in range(len(w) - len(v) + 1)):
                out.add((d, i))
    return out


def test_decontamination(spark, docs, empty):
    item = " ".join(BASE.split(" ")[30:75])
    items = [(1, item), (2, edited(item, [22])), (3, "a b c"), (4, None), (5, ""), (6, prose(25, 9)), (7, item.upper()), (8, item), (9, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(TEXTS, items)
    for block in (8 << 20, 400):
        got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, bench, block_bytes=block).collect()]
        assert set(got) == want
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).count() == 0
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and not {d for d, _ in want if d} & {r["doc_id"] for r in kept.collect()}


def test_decontamination_of_texts_shorter_than_the_item(spark):
    items = [(1, prose(38, 21)), (2, prose(59, 22)), (3, "a b c d e f")]
    one, two = items[0][1].split(" "), items[1][1].split(" ")
    cuts = [one[:-1], one[:-3], one[3:], one[:19] + one[20:], one[:31], one[:30], one[:20], two[:30] + two[31:], two[:48], two[:40], ["a", "b", "c", "d", "e"], ["x", *one[:-2]], one[:4], prose(37, 23).split(" ")]
    rows = [(d, " ".join(w)) for d, w in enumerate(cuts)]
    want = {(d, i): weighted(shingled(words(t)), shingled(words(x))) for d, t in rows for i, x in items if len(words(t)) < len(words(x))}
    want = {at: v for at, v in want.items() if v >= 0.75}
    assert {d for d, _ in want} >= {0, 1, 2, 3, 7, 8, 11} and not {d for d, _ in want} & {6, 9, 10, 12, 13}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == set(want)
    assert all(r["similarity"] == pytest.approx(want[r["doc_id"], r["item_id"]]) and r["first_word"] == 0 and r["n_words"] == len(cuts[r["doc_id"]]) for r in found)
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(len(cuts))) - {d for d, _ in want}


def test_clean_judges_rows_without_or_with_repeated_ids(spark):
    item, rest = prose(45, 31), prose(50, 32)
    rows = [(None, rest + " " + item), (None, rest), (1, item), (1, rest), (2, None), (3, ""), (4, prose(45, 33))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(1, item), (2, prose(45, 33)), (3, prose(30, 34))], "item_id long, text string")
    for block in (8 << 20, 400):
        kept = decontaminate.clean(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(None, rest), (1, rest), (2, None), (3, "")]))
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows) and decontaminate.clean(docs.limit(0), bench).count() == 0


def test_multi_index_holds_all_within_radius():
    g = decontaminate.Items(10, 5)
    for _ in range(200):
        g.add(1, RNG.integers(0, 2**63, 6).astype(np.uint64))
    g.close()
    prints = g.prints.T[:50].copy()
    for i in range(50):
        for bit in RNG.choice(256, 2 * i, replace=False):
            prints[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
    far = np.bitwise_count(prints[:, None] ^ g.prints.T[None]).sum(axis=2)
    for cells in (1 << 20, 300):
        got = set(zip(*(v.tolist() for v in g.candidates(prints, cells)), strict=True))
        assert got == set(zip(*(v.tolist() for v in np.nonzero(far <= decontaminate.RADIUS)), strict=True))
    assert all((i, i) in got for i in range(40))


def test_fingerprints_of_windows_at_the_threshold():
    """Multisets of 35 shingles that share 30 are just similar; their fingerprints lie well inside the radius."""
    far = []
    for i in range(200):
        h = np.random.default_rng(i).integers(0, 2**63, 40).astype(np.uint64)
        a, b = (decontaminate.simhash(decontaminate.signs(x).sum(axis=0, keepdims=True))[0] for x in (h[:35], h[5:]))
        far.append(int(np.bitwise_count(a ^ b).sum()))
    assert 36 < np.mean(far) < 52 and max(far) <= decontaminate.RADIUS - 10


def brute_scores(rows, alpha=0.4):
    w = [(d, words(t)) for d, t in rows]
    one, two = Counter(x for _, v in w for x in v), Counter(p for _, v in w for p in itertools.pairwise(v))
    n, out = sum(one.values()), []
    for d, v in w:
        s = 0.0
        for i, x in enumerate(v):
            s += math.log(two[v[i - 1], x] / one[v[i - 1]]) if i and two[v[i - 1], x] >= 2 else math.log(one[x] / n) + (math.log(alpha) if i else 0)
        out.append((d or 0, len(v), round(s, 6)))
    return sorted(out)


def test_backoff(docs, empty):
    got = sorted((r["doc_id"] or 0, r["n_words"], round(r["log_score"], 6)) for r in lm_score.backoff_scores(docs).collect())
    assert got == brute_scores(TEXTS)
    assert lm_score.backoff_scores(empty).count() == 0
    assert lm_score.backoff_scores(docs, order=3).count() == len(TEXTS)


def brute_components(rows, num=75, den=100):
    sets = [(d, set(shingled(words(t)))) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and den * len(s & t) >= num * len(s | t) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in root}


def test_jaccard(docs, empty):
    got = jaccard_join.jaccard_components(docs).collect()
    want = brute_components(TEXTS)
    assert len(got) == len(TEXTS)
    assert all(r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got}[14] == len(set(shingled(words(TEXTS[13][1]))))
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.keep_one(docs)
    # the row without an id holds text 1, so it goes; of the three rows with id 19 two are equal
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*set(want.values()), 19])


def test_jaccard_clusters_around_the_threshold(spark):
    rng, base, rows = np.random.default_rng(2), prose(60, 20), []
    for i in range(150):
        rows.append((i, edited(base, rng.choice(60, rng.integers(1, 5), replace=False), f"e{i % 40}x")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_jaccard_keeps_one_row_of_each_group_without_ids(spark):
    one, two = prose(60, 40), prose(60, 41)
    rows = [(None, one, "b"), (None, edited(one, [5]), "a"), (None, one, "a"), (7, two, "a"), (7, one, "c"), (7, two, "b"), (None, None, "x"), (None, "", "x"), (3, edited(two, [50]), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted(map(tuple, jaccard_join.keep_one(docs).collect()), key=str)
    assert got == sorted([(7, one, "c"), (3, edited(two, [50]), "z"), (None, None, "x"), (None, "", "x")], key=str)
    out = jaccard_join.jaccard_components(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in out) == [(0, 0)] * 5 + [(3, 3), (7, 3), (7, 3), (7, 7)]


def shared_passages(n, seed=5):
    """n documents of 5 out of 40 passages in any order, and every 50th once more with another word."""
    rng = np.random.default_rng(seed)
    parts = [prose(40, 1000 + i) for i in range(40)]
    rows = [(i, " ".join(parts[p] for p in rng.choice(40, 5, replace=False))) for i in range(n)]
    return rows + [(n + i, edited(t, [77])) for i, t in rows[::50]]


def test_jaccard_index_of_shared_passages_grows_with_the_documents(spark):
    size = {}
    for n in (300, 1200):
        rows = shared_passages(n)
        sets = [np.unique(jaccard_join.token_set(t.encode())).view(np.int64).tolist() for _, t in rows]
        df = spark.createDataFrame([(d, d, len(s), s, [1] * len(s)) for (d, _), s in zip(rows, sets, strict=True)], "node long, component long, n long, held array<long>, cuts array<int>")
        found, links = jaccard_join.candidates(common.saved(jaccard_join.classed(df, 75, 100), "classes"), 75, 100, 4, 4)
        size[n] = sum(t.count() for t in found)
        pairs = {(r["a"], r["b"]) for t in [*found, *links] for r in t.collect()}
        assert all((d, n + d) in pairs or (n + d, d) in pairs for d, _ in rows[:n:50])
    assert size[1200] <= 6 * size[300] + 50
    rows = shared_passages(300)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_extends_keys_that_many_hold(spark):
    """Half of every text is one of three common passages, so keys have to be extended to tell near copies apart."""
    rng, rows = np.random.default_rng(8), []
    common, some = [prose(60, 2000 + i) for i in range(3)], [prose(20, 2100 + i) for i in range(12)]
    for i in range(200):
        rows.append((i, common[i % 3] + " " + " ".join(some[p] for p in rng.choice(12, 2, replace=False)) + " " + prose(int(rng.integers(1, 12)), 3000 + i)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), rare=2).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize(("fan", "gather"), [(8, 256), (2, 3), (1, 2)])
def test_corpus_counts_over_several_digits(spark, fan, gather):
    rng = np.random.default_rng(fan)
    rows = [(i, " ".join(map(str, rng.integers(0, 60, 30)))) for i in range(120)]
    texts, batches, _ = common.batched(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 0.002)
    assert batches > 4

    def keys(raw):
        return np.concatenate([np.zeros(0, np.uint64), *[word_hashes(t) for t in raw]])

    def read(table, back):
        found = keys(table["text"].to_pylist())
        unique, _, inverse = common.key_layout(found, 5, 32)
        held = common.told_counts(unique, 5, 32, back, fan)[inverse]
        return pa.table({"key": pa.array(found.view(np.int64)), "n": pa.array(held.astype(np.int64))})

    counts = common.corpus_counts(texts, batches, keys, 5, 32, fan, gather)
    got = {(r["key"], r["n"]) for r in texts.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(read, "key long, n long").collect()}
    real = Counter(int(h.view(np.int64)) for _, t in rows for h in word_hashes(t.encode()))
    assert got == set(real.items())


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 90 for i in (90, 95, 100))


def test_line_quality(spark, empty):
    rows = [(i, "\n".join(prose(12, 50 + i * 5 + k) for k in range(4)) if i % 3 else "\n".join("*** !!! " + "*** ".join(prose(8, i).upper().split(" ")) for _ in range(4))) for i in range(150)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, prose(4000, 8))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    model = line_quality.train(docs, labels)
    out = {r["doc_id"]: r for r in line_quality.quality(docs, model).collect()}
    held = [i for i in range(150) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i in range(150) if out[i]["held_out"]] == held
    assert np.mean([out[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values()) and len(out) == 153
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = {r["doc_id"]: r["score"] for r in line_quality.quality(docs, line_quality.train(docs, flipped)).collect()}
    assert all(abs(other[i] - out[i]["score"]) < 1e-9 for i in held)  # held-out labels don't matter
    assert line_quality.train(docs, labels.limit(0)) is None and {r["score"] for r in line_quality.quality(docs, None).collect()} == {0.5}
    assert line_quality.quality(empty, model).count() == 0
    assert line_quality.keep_good(docs, model).columns == docs.columns


def test_line_quality_of_conflicting_labels_repeated_rows_and_other_columns(spark):
    rows = [(i, prose(30, i) if i % 2 else "*** !!! ### " * 12, "x", 0.5) for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:20], (None, prose(30, 3), "x", 0.1), (None, None, None, None)], "doc_id long, text string, held_out string, score double")
    good = [(i, i % 2) for i in range(60)]
    labels = spark.createDataFrame([*good, *good[:9], (0, 1), (4, 5), (None, 1)], "doc_id long, quality int")
    reverse = spark.createDataFrame([(None, 1), (4, 5), (0, 1), *good[::-1], *good[:9]], "doc_id long, quality int")
    models = [line_quality.train(docs, x) for x in (labels, reverse, labels.filter("doc_id <> 0"))]
    scores = [sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 9)) for r in line_quality.quality(docs, m).collect()) for m in models]
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 82
    kept = line_quality.keep_good(docs, models[0])
    assert kept.dtypes == docs.dtypes and kept.count() == sum(s >= 0.5 for _, s in scores[0])


def test_line_quality_score_against_its_definition():
    """A document's score from the model's numbers, with marginals over all labellings."""
    rng = np.random.default_rng(3)
    model = line_quality.LineField(rng.normal(size=15), rng.uniform(0.5, 2, 15), rng.normal(size=46) / 4, rng.normal(size=(2, 2)), 1.3, 0.2)
    texts = [b"One line.", b"A first line!\n\n*** | 12 ***", b"", b"same line\nsame line\nOTHER, line\n"]
    for t, got in zip(texts, model.score(texts, chunk=8), strict=True):
        x, length, per_text = line_quality.line_features([t])
        z, n = (x - model.mean) / model.scale, len(x)
        rows = [np.r_[z[i], z[i - 1] if i else 0 * z[i], z[i + 1] if i + 1 < n else 0 * z[i], 1.0] @ model.weights for i in range(n)]
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(r * v for r, v in zip(rows, y, strict=True)) + sum(model.step[a, b] for a, b in itertools.pairwise(y)))
            total += p
            good += p * np.array(y)
        s = np.clip(((length + 1) * good / total).sum() / (length + 1).sum(), 1e-4, 1 - 1e-4)
        assert got == pytest.approx(1 / (1 + math.exp(-(1.3 * math.log(s / (1 - s)) + 0.2))))


def test_marginals_of_very_many_lines_stay_small():
    n = np.r_[np.full(255, 2), 50_000]
    assert sum(len(b) * n[b].max() for b in line_quality.blocks_of(n, 100_000)) < 2 * n.sum()
    emit = np.random.default_rng(2).normal(size=n.sum())
    good, pairs, _ = line_quality.marginals(emit, np.zeros((2, 2)), n)
    assert np.allclose(good, 1 / (1 + np.exp(-emit))) and pairs.sum() == pytest.approx(n.sum() - len(n))


def test_chain_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    n = np.array([4, 1, 3])
    emit, step = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, z = line_quality.marginals(emit, step, n)
    at, want_pairs, want_z = 0, np.zeros((2, 2)), 0.0
    for k in n:
        total, p, q = 0.0, np.zeros(k), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(k)):
            s = math.exp(sum(emit[at + i] * v for i, v in enumerate(y)) + sum(step[a, b] for a, b in itertools.pairwise(y)))
            total += s
            p += s * np.array(y)
            for a, b in itertools.pairwise(y):
                q[a, b] += s
        assert np.allclose(good[at : at + k], p / total)
        want_pairs += q / total
        want_z += math.log(total)
        at += k
    assert np.allclose(pairs, want_pairs) and abs(z - want_z) < 1e-9


def test_embeddings(spark, empty):
    rng, rows = np.random.default_rng(4), []
    centres = rng.normal(size=(6, 16))
    for i in range(300):
        rows.append((i, [float(v) for v in centres[i % 6] + rng.normal(size=16) * 0.12], i % 2))
    rows += [(400 + i, rows[0][1], 0) for i in range(40)] + [(500, [2 * v for v in rows[0][1]], 0), (501, None, 0), (502, [0.0] * 16, 0), (503, [float("nan")] * 16, 0), (504, rows[0][1], None), (505, [1.0], 0), (506, [3.0], 0), (400, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("links", F.lit(1))
    got = {}
    for r in embedding_dedup.embedding_components(df, block=64).collect():
        got[r["vec_id"]] = r
    real = {}
    for v, e, k in rows:
        if e is not None and k is not None and np.isfinite(e).all() and np.any(e):
            x = np.array(np.array(e, np.float32), float)
            real[v] = (k, x / np.linalg.norm(x))
    root = {v: v for v in got}
    links = Counter()
    for a, b in itertools.combinations(real, 2):
        if real[a][0] == real[b][0] and len(real[a][1]) == len(real[b][1]) and real[a][1] @ real[b][1] >= 0.98:
            links[a] += 1
            links[b] += 1
            x, y = a, b
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
    for v, r in got.items():
        x = v
        while root[x] != x:
            x = root[x]
        assert (r["n_links"], r["component_id"], r["kept"]) == (links[v], x, x == v)
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def brute_links(rows, least=0.98):
    """rows: (vec_id, vector, label). Linked pairs by all comparisons."""
    out = set()
    for k in {k for *_, k in rows}:
        mine = [(v, np.array(e, float)) for v, e, l in rows if l == k]
        x = np.stack([e / np.linalg.norm(e) for _, e in mine])
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            out.add((mine[i][0], mine[j][0]))
    return out


@pytest.mark.parametrize("directions", [64, 8, 2])
def test_embedding_recall_in_64_dimensions(spark, directions):
    rng = np.random.default_rng(directions)
    basis = np.linalg.qr(rng.normal(size=(64, directions)))[0].T
    base = rng.normal(size=(400, directions))
    steps = rng.normal(size=(1200, directions))
    steps *= (rng.uniform(0.05, 0.25, 1200) * np.linalg.norm(base[np.arange(1200) % 400], axis=1) / np.linalg.norm(steps, axis=1))[:, None]
    x = np.r_[base, base[np.arange(1200) % 400] + steps] @ basis
    rows = [(i, [float(v) for v in e], i % 400 % 3) for i, e in enumerate(x)]
    real = brute_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for recall, size, floor in ((0.9999, 16, 0.9), (0.9999, 64, 0.9), (1.0, 16, 1.0)):
        links = sum(r["n_links"] for r in embedding_dedup.embedding_components(df, recall=recall, size=size).select("n_links").collect())
        assert floor * 2 * len(real) <= links <= 2 * len(real)
    assert len(real) > 300


def test_embeddings_without_ids_and_of_many_lengths(spark):
    rows = [(None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (3, [5.0, 5.1], 0)]
    rows += [(100 + 2 * n + k, [1.0 + (i + k) % 2 * 0.01 for i in range(n)], 1) for n in range(1, 90) for k in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in embedding_dedup.embedding_components(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[None] == [(0, None, True)] * 2 and got[1] == [(1, 1, True)] and got[2] == [(1, 1, False)] and got[3] == [(0, 3, True)]
    assert all(got[100 + 2 * n + k] == [(1, 100 + 2 * n, k == 0)] for n in range(1, 90) for k in (0, 1))
    assert embedding_dedup.book_size(1000) == 16 and embedding_dedup.book_size(10**7) == 198 and embedding_dedup.book_size(10**12) == 1024


def brute_repeats(rows, window=100):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - window + 1):
            x = raw[a : a + window]
            if x in seen:
                gone[a : a + window] = True
            seen.add(x)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((d or 0, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(docs, empty):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(suffix_dedup.repeated_spans(docs)).collect())
    assert got == brute_repeats(TEXTS)
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_repeats_of_periodic_and_long_texts(spark):
    rows = [(1, "ab" * 400), (2, "abc" * 70 + prose(20, 1)), (3, "\n".join([prose(15, 30)] * 4)), (4, "ba" * 90), (5, prose(30_000, 31) + prose(40, 32)), (6, prose(40, 32))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.digest(suffix_dedup.repeated_spans(df, batch_mb=0.01)).collect())
    assert got == brute_repeats(rows)


def test_repeats_around_a_line_that_many_texts_share(spark):
    """The line is shorter than the strings sought; some texts also repeat what stands around it."""
    line, rows = prose(12, 60).replace("é", "f")[:80], []
    for i in range(150):
        rows.append((i, prose(14, 7000 + i % 70) + "\n" + line + "\n" + prose(14, 8000 + i % 90)))
    rows += [(200 + i, prose(3, 7100 + i)[-4:] + line + prose(3, 8100 + i)[:15]) for i in range(40)] + [(300, line), (301, line * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (suffix_dedup.HOT, 20, 1):
        got = sorted(tuple(r) for r in suffix_dedup.digest(suffix_dedup.repeated_spans(df, batch_mb=0.01, hot=hot)).collect())
        assert got == brute_repeats(rows)
    # the split runs of different contexts go to different shards
    raws = [t.encode() for _, t in rows]
    runs = suffix_dedup.text_runs(raws, 100)
    key, count = np.unique(runs[0], return_counts=True)
    most = runs[0] == key[count.argmax()]
    parts = suffix_dedup.split_runs(raws, tuple(x[most] for x in runs), 100)
    assert count.max() > 100 and np.unique(parts[0], return_counts=True)[1].max() < count.max() / 5
    assert parts[3].sum() == runs[3][most].sum() and parts[3].max() <= suffix_dedup.GROUP


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_array(values):
    text = np.array([*values, 0], np.int16)
    order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix_array.suffix_array(text, 4).tolist() == order
    raw = text.astype(np.uint8)
    prefix = suffix_array.common_prefixes(raw, np.array(order), 20)
    for a, b in itertools.pairwise(order):
        n = 0
        while n < 20 and a + n < len(raw) and b + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert prefix[b] == n


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs).collect()
    slots = defaultdict(list)
    by_id = {d: t for d, t in TEXTS}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 and r["law"] == "key"
        if r["doc_id"] != 19:
            raw = (by_id[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    assert len(rows) == len(TEXTS) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(empty).count() == 0


def test_tree_weights(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "k")
    count = {r["s"]: r["count"] for r in sharding.Tree(9, weights={0: 3.0, 8: 0.0}).add_to(ids, F.col("k"), "s").groupBy("s").count().collect()}
    assert 8 not in count and abs(count[0] / 40_000 - 3 / 10) < 0.01 and all(abs(count[i] / 40_000 - 1 / 10) < 0.01 for i in range(1, 8))
    with pytest.raises(ValueError):
        sharding.Tree(0)
    assert len(gram_hashes(word_hashes(b"a b"), 3)) == 0
