"""Parts that several operators share: folders, words, batches, corpus counts, components and distributed running sums."""

from __future__ import annotations

import atexit
import functools
import operator
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java regex of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_LIVE: set[str] = set()
#: Where a saved() table lies, by its DataFrame.
_PATH: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own, but only in local mode, where all is one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wavelake-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one. It lives until the session ends, as lazy results still read it."""
    path = f"{shared_dir(spark)}/wavelake-{name}-{uuid.uuid4().hex[:12]}"
    if not _LIVE:
        atexit.register(_remove_all)
    _LIVE.add(path)
    return path


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for path in _LIVE:
            _remove(spark, path)
    except Exception:  # the JVM is gone; the folder is the cluster's scratch space
        return


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: written as Parquet to the shared folder and read back, so that a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _PATH[out] = path
    return out


def forget(df: DataFrame) -> None:
    """Remove a saved() table that nothing needs any more."""
    path = _PATH.pop(df, None)
    if path:
        _remove(df.sparkSession, path)
        _LIVE.discard(path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words: bytes.split() knows exactly the white space of WORD."""
    return text.lower().split()


def word_hashes(text: bytes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a combined hash are even."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; empty where there are fewer."""
    if len(h) < n:
        return h[:0]
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of a text's k-word shingles, with repeats; with fewer words the whole sequence is one; none without words."""
    return gram_hashes(h, min(k, len(h))) if len(h) else h


def binary(text: Column) -> Column:
    """The UTF-8 bytes of a text, none for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def tasks_for(spark: SparkSession, batches: int, each: int = 4) -> int:
    """Partitions for so many batches: some batches a task, never fewer partitions than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-batches // each), 100_000))


def batched(docs: DataFrame, doc_id: str, text: str, batch_mb: float = 4) -> tuple[DataFrame, int, int]:
    """(doc_id, text as bytes, batch) with about batch_mb of text in a batch, dealt to as many tasks as the batches need; number of batches; bytes of all
    texts. A row's id and text decide its batch, so rows that share an id, or have none, are spread by their texts."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)) + F.lit(64)).alias("b")).first()["b"] or 0
    n = max(1, int(total / (batch_mb * 2**20)) + 1)
    batch = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(n)).cast("long")
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), binary(F.col(text)).alias("text"), batch.alias("batch"))
    return df.repartition(tasks_for(docs.sparkSession, n), "batch"), n, total


def _lists(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


COUNT_SCHEMA = "batch long, bucket long, seen binary, totals binary"
#: A row goes to at most 2^FAN buckets at a time, however many there are; GATHER batches are merged before the next digit of the bucket is told apart.
FAN, GATHER = 8, 256


def key_layout(keys: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys (bucket in the top bits, then width bits), how often each occurs and where each key went."""
    cut = keys >> np.uint64(64 - bits - width)
    unique, inverse, count = np.unique(cut, return_inverse=True, return_counts=True)
    return unique, count, inverse


def to_raw(low: np.ndarray, width: int) -> bytes:
    """Keys of 32 bits or more: all low halves, then all fifth bytes and so on."""
    raw = [low.astype(np.uint32).tobytes()]
    raw += [(low >> np.uint64(at)).astype(np.uint8).tobytes() for at in range(32, width, 8)]
    return b"".join(raw)


def from_raw(raw: bytes, width: int) -> np.ndarray:
    more = range(32, width, 8)
    n = len(raw) // (4 + len(more))
    out = np.frombuffer(raw, np.uint32, n).astype(np.uint64)
    for i, at in enumerate(more):
        out |= np.frombuffer(raw, np.uint8, n, offset=(4 + i) * n).astype(np.uint64) << np.uint64(at)
    return out


def sent_counts(batch: int, unique: np.ndarray, count: np.ndarray, width: int, above: int = 0) -> pa.Table:
    """One row for each bucket of a batch: its keys' low bits and counts, as plain arrays. above: the bucket's higher digits."""
    bucket = (unique >> np.uint64(width)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(bucket)] if len(cuts) else cuts
    low = unique & np.uint64((1 << width) - 1)
    count = count.astype(np.uint32)
    return pa.table({
        "batch": pa.array(np.full(len(cuts), batch), pa.int64()),
        "bucket": pa.array(bucket[cuts] + above, pa.int64()),
        "seen": _lists([to_raw(low[a:b], width) for a, b in zip(cuts, ends, strict=True)]),
        "totals": _lists([count[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]),
    })


def merged(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of rows with keys of one bucket: distinct keys, their counts, where each row's keys went, and how many each row has."""
    keys = [from_raw(x, width) for x in table["seen"].to_pylist()]
    counts = [np.frombuffer(x, np.uint32) for x in table["totals"].to_pylist()]
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.uint64), inverse, [len(k) for k in keys]


def answers(table: pa.Table, total: np.ndarray, sizes: list[int]) -> pa.Table:
    """For each row that came: places of the keys whose count over the corpus is not 1, and those counts."""
    seen, totals, at = [], [], 0
    for n in sizes:
        t = total[at : at + n]
        at += n
        more = t > 1
        seen.append(np.packbits(more).tobytes())
        totals.append(t[more].tobytes())
    return pa.table({"batch": table["batch"].combine_chunks(), "bucket": table["bucket"].combine_chunks(), "seen": _lists(seen), "totals": _lists(totals)})


def counts_of(unique: np.ndarray, width: int, back: pa.Table, first: int | None = None) -> np.ndarray:
    """The corpus counts of distinct keys, from the answers to them. first: bits of the digit that told their buckets apart, if there are more digits above."""
    out = np.ones(len(unique), np.uint64)
    bucket = unique >> np.uint64(width)
    for b, seen, totals in zip(back["bucket"].to_pylist(), back["seen"].to_pylist(), back["totals"].to_pylist(), strict=True):
        start = np.searchsorted(bucket, np.uint64(b if first is None else b & ((1 << first) - 1)))
        out[start + np.flatnonzero(np.unpackbits(np.frombuffer(seen, np.uint8)))] = np.frombuffer(totals, np.uint64)
    return out


def bucket_bits(keys: int, per_bucket: int = 1_000_000) -> int:
    """Bits of the bucket number: a bucket holds about per_bucket keys, whatever the corpus."""
    return max(4, int(np.ceil(np.log2(max(1, keys / per_bucket)))))


def _totals(sent: DataFrame, rest: int, width: int, fan: int, gather: int) -> DataFrame:
    """Answers to rows whose keys have rest bits of the bucket yet to be told apart, and width bits beyond."""
    spark = sent.sparkSession
    if rest == 0:

        def last(table):
            _, total, inverse, sizes = merged(table, width)
            return answers(table, total[inverse], sizes)

        return sent.groupBy("bucket").applyInArrow(last, COUNT_SCHEMA)
    digit = min(fan, rest)
    below = rest - digit + width
    sent = saved(sent, "counts")
    groups = int(sent.agg(F.max("batch")).first()[0] or 0) // gather + 1
    mine = sent.withColumn("meet", F.col("bucket") * groups + F.floor(F.col("batch") / gather))

    def on(key, table):
        unique, total, _, _ = merged(table, rest + width)
        return sent_counts(key[0].as_py(), unique, total, below, table["bucket"][0].as_py() << digit)

    def back(table, found):
        unique, _, inverse, sizes = merged(table, rest + width)
        return answers(table, counts_of(unique, below, found, digit)[inverse], sizes)

    further = _totals(mine.groupBy("meet").applyInArrow(on, COUNT_SCHEMA), rest - digit, width, fan, gather)
    n = tasks_for(spark, groups << digit)
    return mine.repartition(n, "meet").groupBy("meet").cogroup(further.repartition(n, "batch").groupBy("batch")).applyInArrow(back, COUNT_SCHEMA)


def corpus_counts(texts: DataFrame, batches: int, keys_of, bits: int, width: int, fan: int = FAN, gather: int = GATHER) -> DataFrame:
    """Count keys over all batches. keys_of(list of texts) gives a batch's keys (uint64, repeats count). A batch sends each distinct key once, with its
    count, so a frequent key costs a batch one entry; the result has each batch's counts in the order of its own sorted keys, in as many tasks as texts.

    A batch sends at most 2^fan rows. With more buckets than that, gather batches' rows of one digit are merged and dealt by the next digit, and answers come
    back the same way; so rows grow with the number of batches, not with batches times buckets."""
    first = min(fan, bits)

    def send(key, table):
        unique, count, _ = key_layout(keys_of(table["text"].to_pylist()), bits, width)
        return sent_counts(key[0].as_py(), unique, count, bits - first + width)

    sent = texts.groupBy("batch").applyInArrow(send, COUNT_SCHEMA)
    return _totals(sent, bits - first, width, fan, gather).repartition(tasks_for(texts.sparkSession, batches), "batch")


def told_counts(unique: np.ndarray, bits: int, width: int, back: pa.Table | None, fan: int = FAN) -> np.ndarray:
    """The counts of a batch's key_layout() from its rows of corpus_counts()."""
    if back is None or not back.num_rows:
        return np.ones(len(unique), np.uint64)
    return counts_of(unique, bits - min(fan, bits) + width, back)


def salted(rows: DataFrame, by: str, salts: int) -> DataFrame:
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def met(rows: DataFrame, totals: DataFrame, key: str, by: str, salts: int) -> DataFrame:
    """rows joined to totals, one row for each key. A key's rows are cut by a hash of the column by, so that no key, however frequent, meets in one task."""
    rows = salted(rows, by, salts)
    told = rows.select(key, "__salt").distinct().join(totals, key)
    return rows.join(told, [key, "__salt"]).drop("__salt")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): (node, component = smallest node). Label spreading with pointer jumping; each round's table is written to the
    shared folder. A hub's edges meet only in partial minima and in joins that Spark can split."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both, name)
    label = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), name)
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        new = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = saved(new.join(jump, "component").select("node", "old", F.col("further").alias("component")), name)
        done = new.filter("old <> component").isEmpty()
        forget(label)
        if done:
            forget(both)
            return new.select("node", "component")
        label = new.select("node", "component")
        _PATH[label] = _PATH.pop(new)


def running(df: DataFrame, group: list[str], bucket: str, order: list, what: dict[str, Column]) -> DataFrame:
    """Exclusive running sums within group, in the order of bucket and then order. Only a bucket's rows meet in a task, and a second window runs over the
    buckets' sums, so a group may be as large as it likes."""
    sums = df.groupBy(*group, bucket).agg(*[F.sum(v).alias(f"{k}__all") for k, v in what.items()])
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*group, bucket, *[F.coalesce(F.sum(f"{k}__all").over(over), F.lit(0)).alias(f"{k}__before") for k in what])
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"{k}__in") for k, v in what.items()])
    same = functools.reduce(operator.and_, [inside[c].eqNullSafe(before[c]) for c in [*group, bucket]])
    out = inside.join(before, same, "inner").select(*[inside[c] for c in inside.columns], *[F.col(f"{k}__before") for k in what])
    return out.select(*df.columns, *[(F.col(f"{k}__before") + F.col(f"{k}__in")).alias(k) for k in what])
