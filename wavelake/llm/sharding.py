"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running


class Tree:
    """Shards below racks below regions. A node weighs what its shards weigh; by default each shard weighs 1.

    Shards fill racks of per_rack and regions of per_region racks in order of their number. At each level a row draws -ln(u) / weight for every child, u
    from a hash of the key and the child's path, and follows the smallest: the classical weighted draw, in which a child gets rows in proportion to its
    weight, and a child whose weight grows takes rows only into itself. So rows move only into or out of subtrees whose weights change. A shard that opens
    a new region takes rows only into itself.
    """

    def __init__(self, shards: int, per_rack: int = 4, per_region: int = 2, weights: dict[int, float] | None = None, seed: int = 17):
        if shards < 1:
            raise ValueError("a tree needs a shard at least")
        self.per_rack, self.per_region, self.seed = per_rack, per_region, seed
        w = [float((weights or {}).get(i, 1.0)) for i in range(shards)]
        if min(w) < 0 or max(w) <= 0:
            raise ValueError("weights must not be negative, and one must be positive")
        wide = per_rack * per_region
        self.regions = -(-shards // wide)
        self.leaf = w + [0.0] * (self.regions * wide - shards)
        self.rack = [sum(self.leaf[i : i + per_rack]) for i in range(0, len(self.leaf), per_rack)]
        self.region = [sum(self.leaf[i : i + wide]) for i in range(0, len(self.leaf), wide)]

    def _descend(self, key: Column, level: str, parent: Column | None, fan: int, weights: list[float]) -> Column:
        """The chosen child's number over the whole level."""
        table = F.array(*[F.lit(x) for x in weights])
        draws = []
        for c in range(fan):
            node = F.lit(c) if parent is None else parent * fan + c
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}{self.seed}"), node.cast("int")), 11).cast("double") + 0.5) / float(2**53)
            weight = F.lit(weights[c]) if parent is None else F.element_at(table, (node + 1).cast("int"))
            draws.append(F.struct(F.when(weight > 0, -F.ln(u) / weight).otherwise(F.lit(float("inf"))).alias("draw"), node.cast("int").alias("node")))
        return F.array_min(F.array(*draws))["node"] if fan > 1 else draws[0]["node"]

    def add_to(self, df: DataFrame, key: Column, out: str) -> DataFrame:
        """df with the shard of key in column out; helper columns go level by level, so that no hash is written out twice."""
        a, b = f"__{out}_region", f"__{out}_rack"
        df = df.withColumn(a, self._descend(key, "region", None, self.regions, self.region))
        df = df.withColumn(b, self._descend(key, "rack", F.col(a), self.per_region, self.rack))
        return df.withColumn(out, self._descend(key, "shard", F.col(b), self.per_rack, self.leaf)).drop(a, b)


def shard_documents(docs: DataFrame, shards: int = 24, grown: int | None = 25, rows_per_bucket: int = 100_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs with its shard.

    Law 'key': the document's id and the number of shards decide. Columns: doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot (0, 1, ... within
    the shard), grown_shard (with one more shard). Null ids hash like any value; null texts have no bytes; repeated rows go to one shard, each with a slot
    of its own; an empty table gives no rows; other columns are ignored. DataFrame functions only.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    df = Tree(shards).add_to(df, F.col("doc_id"), "shard")
    df = Tree(grown).add_to(df, F.col("doc_id"), "grown_shard") if grown else df.withColumn("grown_shard", F.lit(None).cast("int"))
    spread = max(16, -(-docs.count() // (shards * rows_per_bucket)))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(spread)).cast("int"))
    df = running(df, ["shard"], "__bucket", ["doc_id", "text_crc32", "size"], {"slot": F.lit(1).cast("long")})
    return df.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
