"""The pipeline against a brute-force version of all its stages, and its edge cases."""

import math
import struct
from collections import Counter

import numpy as np
import pytest
import test_small_cases as small
import xxhash

import corpus_pipeline
from wavelake.llm import line_quality, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, shard string"


def spark_hash(*values):
    """xxhash64 of columns: ints as (value, bytes), strings; null leaves the hash as it is."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q" if v[1] == 8 else "<i", v[0])
            h = xxhash.xxh64_intdigest(raw, h)
    return h


def brute_shard(doc_id, shards, per_rack=4, per_region=2, seed=17):
    """Descend the tree of equal shards: at each level the smallest -ln(u) / weight."""
    key = None if doc_id is None else (doc_id, 8)
    racks = -(-shards // per_rack)
    regions = -(-shards // (per_rack * per_region))
    weight = {
        "shard": [float(i < shards) for i in range(regions * per_rack * per_region)], "rack": [float(max(0, min(per_rack, shards - i * per_rack))) for i in range(max(racks, regions * per_region))],
        "region": [float(max(0, min(per_rack * per_region, shards - i * per_rack * per_region))) for i in range(regions)],
    }
    at = None
    for level, fan in (("region", regions), ("rack", per_region), ("shard", per_rack)):
        nodes = range(fan) if at is None else range(at * fan, at * fan + fan)
        draws = []
        for n in nodes:
            u = ((spark_hash(key, f"{level}{seed}", (n, 4)) >> 11) + 0.5) / 2**53
            draws.append((-math.log(u) / weight[level][n] if weight[level][n] > 0 else math.inf, n))
        at = min(draws)[1] if fan > 1 else draws[0][1]
    return at


def test_tree_against_brute_force(spark):
    ids = [None, -5, 0, *range(1, 400, 3), 2**40]
    df = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    for r in sharding.shard_documents(df).collect():
        assert (r["shard"], r["grown_shard"]) == (brute_shard(r["doc_id"], 24), brute_shard(r["doc_id"], 25))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, passages of the benchmark, junk, nulls and repeated ids; columns with clashing names."""
    path = str(tmp_path_factory.mktemp("corpus"))
    item = small.prose(40, 900)
    rows = []
    for i in range(1, 91):
        good = "\n".join(small.prose(14, 5000 + 7 * i + k) for k in range(4))
        rows.append((i, good if i % 3 else "\n".join("*** !!! " + "*** ".join(small.prose(8, i).upper().split(" ")) for _ in range(4))))
    text = dict(rows)
    rows += [(101, text[1]), (102, small.edited(text[2], [9])), (103, text[4] + "\n" + item), (104, item), (None, text[5]), (None, small.prose(60, 77)), (7, small.prose(60, 78)), (7, text[7]), (105, None), (106, ""), (None, None), (107, small.edited(item, [20]))]
    docs = spark.createDataFrame([(d, t, "en", None if d == 8 else f"s{(d or 0) % 2}", len(t or ""), "c", "s", "h") for d, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(1, 91)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, small.prose(30, 901))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    # 1: one text at a time
    model = line_quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = [r for r in rows if model.score([(r[2] or "").encode()])[0] >= 0.5]
    assert all(r[0] is None or r[0] > 90 or r[0] % 3 for r in good) and len(good) > 60
    # 2: one row of each group of linked texts; the smallest id, rows without one last
    kept, groups = [r for r in good if not small.words(r[2])], []
    for r in good:
        s = set(small.shingled(small.words(r[2])))
        if s:
            met = [g for g in groups if any(100 * len(s & t) >= 75 * len(s | t) for _, t in g)]
            groups = [g for g in groups if g not in met] + [[(r, s), *[x for g in met for x in g]]]
    kept += [min((r for r, _ in g), key=lambda r: (r[0] is None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest(r[2].encode(), 42)).view(np.int64))) for g in groups]
    # 3: no passage of the benchmark
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = [r for r in kept if not any(small.words(x) and similar(r[2], x) for _, x in items)]
    assert not {103, 104, 107} & {r[0] for r in clean} and {r[0] for r in clean} >= {4}
    # 4: as often as the mix takes them
    left = spark.createDataFrame([(d, s, t) for d, s, t in clean], "doc_id long, source string, text string")
    want = small.brute_mix(spark, left, clean, {i: 1.5 if i % 3 else 0.5 for i in range(1, 91)})
    times = Counter()
    for d, n, taken, epochs in want:
        times[d] += 1 if n == 0 else epochs + (taken > epochs * n)
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in out) == Counter({d: k for d, k in times.items() if k})
    # 5: shards by id, slots without gaps
    assert all(r["shard"] == brute_shard(r["doc_id"], 24) for r in out)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def similar(text, item):
    w, v = small.words(text), small.words(item)
    spans = [w] if len(w) < len(v) else [w[a : a + len(v)] for a in range(len(w) - len(v) + 1)]
    return any(x and small.weighted(small.shingled(x), small.shingled(v)) >= 0.75 for x in spans)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes, name


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{folder}/documents.parquet").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")  # without labels nothing is rejected, without items nothing is a leak
    for _, stage in corpus_pipeline.STAGES[:3]:
        at = spark.createDataFrame(stage(spark, at, str(tmp_path)).collect(), at.schema)
    assert {r["doc_id"] for r in at.collect()} >= {3, 103, 104} and mixing.mix(at.limit(0)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
