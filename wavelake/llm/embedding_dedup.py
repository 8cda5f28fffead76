"""Near-duplicate embeddings by an inverted multi-index.

Vectors are scaled to length 1 and cut into halves, each with its own codebook; the product grid of the two codebooks is the index. A pair with cosine c or
more is at most r = sqrt(2 - 2c) apart. A neighbour lies in another cell only if the step to it crosses the bisectors between that cell's centres and the
query's nearest ones, so the squared distances to both bisectors bound its cost. The traversal visits cells by the sum of both halves' bounds, the smallest
first. The share of a step of length r in any two directions of n dimensions, squared and summed, exceeds s with probability exp(-s n / 2 r^2) for random
steps, so it stops at s = min(r^2, r^2 ln(1 / (1 - recall)) 2 / n): at r^2 no neighbour can be missed. Cells' vectors are then compared exactly, in double
precision. Of two cells only the one with the smaller number asks the other, so both ends of a pair know the same.

Codebooks grow with the square root of the number of vectors, so that a cell holds about as many however many there are.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved

#: The codebooks are fitted on at most this many vectors, of all lengths together; every vector is indexed.
SAMPLE = 20_000
#: Centres of a half: at least and at most; the books go to every executor, so they are bounded.
LEAST_SIZE, MOST_SIZE = 16, 1024


def codebook(x: np.ndarray, size: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centres, started from random rows; an empty cluster keeps its centre."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(size, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return np.unique(centres, axis=0)


class Grid:
    def __init__(self, sample: np.ndarray, size: int, seed: int = 5):
        half = sample.shape[1] // 2
        self.half, self.books = half, [codebook(sample[:, :half], size, seed), codebook(sample[:, half:], size, seed + 1)]
        rest = np.concatenate([part - book[((book**2).sum(1)[None] - 2 * part @ book.T).argmin(axis=1)] for part, book in zip((sample[:, :half], sample[:, half:]), self.books, strict=True)], axis=1)
        spread = rest.T @ rest
        #: In how many directions vectors differ from their centres: the participation ratio of the covariance's eigenvalues.
        self.dimensions = float(max(1.0, np.trace(spread) ** 2 / max((spread**2).sum(), 1e-300)))
        self.apart = [np.sqrt(np.maximum(((b[:, None] - b[None]) ** 2).sum(-1), 0)) for b in self.books]

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: nearest centre, and squared lower bounds of the distance to every centre's cell."""
        out = []
        for part, book, apart in zip((x[:, : self.half], x[:, self.half :]), self.books, self.apart, strict=True):
            d = np.maximum((part**2).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * part @ book.T, 0)
            near = d.argmin(axis=1)
            gap = apart[near]
            low = np.where(gap > 0, (d - d[np.arange(len(d)), near][:, None]) / np.maximum(2 * gap, 1e-300), 0)
            out.append((near, np.maximum(low, 0) ** 2))
        return out

    def cells(self, a: np.ndarray, b: np.ndarray, most: float) -> list[int]:
        """Multi-sequence traversal: grid cells by the sum of the halves' bounds, until the sum exceeds most."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, seen, out = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}, []
        while heap:
            total, p, q = heapq.heappop(heap)
            if total > most:
                break
            out.append(int(i[p]) * len(b) + int(j[q]))
            for r, s in ((p + 1, q), (p, q + 1)):
                if r < len(a) and s < len(b) and (r, s) not in seen:
                    seen.add((r, s))
                    heapq.heappush(heap, (a[i[r]] + b[j[s]], r, s))
        return out


def book_size(vectors: int, each: int = 256) -> int:
    """Centres of a half for about each vectors in a cell of the product grid."""
    return int(min(MOST_SIZE, max(LEAST_SIZE, math.ceil(math.sqrt(vectors / each)))))


def reach(least: float, recall: float, n: float) -> float:
    """The sum of squared bounds up to which cells are visited: r^2 for recall 1, less where random steps in n dimensions hardly go that far in two of them.
    n is measured, see Grid."""
    radius = (2 - 2 * least) * (1 + 1e-9) + 1e-9
    return radius if recall >= 1 else radius * min(1.0, math.log(1 / (1 - recall)) * 2 / n)


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # else squares of tiny or huge numbers are lost
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def block_links(table: pa.Table, least: float) -> pa.Table:
    """Queries of the cell itself (role 1) and of others (role 2) against a cell's vectors (role 0): how many vectors each links with, and a spanning forest
    of the links. A pair inside a cell is met from both ends, a pair of two cells from one, which then counts for both."""
    role, ids, weight = table["role"].to_numpy(), table["vec_id"].to_numpy(), table["held"].to_numpy()
    x = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(len(ids), -1)
    q, d = np.flatnonzero(role > 0), np.flatnonzero(role == 0)
    if not len(q) or not len(d):
        return pa.table({"vec_id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    met = (x[q] @ x[d].T >= least) & (ids[q][:, None] != ids[d][None, :])
    links, other = met @ weight[d], weight[q] * (role[q] == 2) @ met
    left, right = ids[q].copy(), ids[d].copy()
    top = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(met, right[None, :], top).min(axis=1))
        new_right = np.minimum(right, np.where(met, new_left[:, None], top).min(axis=0))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    rows = [(ids[q], links, left)]
    rows.append((ids[d], other, right))
    v, n, r = (np.concatenate(c) for c in zip(*rows, strict=True))
    some = (n > 0) | (v != r)
    return pa.table({"vec_id": pa.array(v[some], pa.int64()), "links": pa.array(n[some], pa.int64()), "root": pa.array(r[some], pa.int64())})


def embedding_components(df: DataFrame, least: float = 0.98, recall: float = 0.9999, size: int | None = None, block: int = 1024, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, for links of equal non-null labels with cosine >= least.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing; so do rows with a null label. Vectors of different
    length never link, and neither do rows without a vec_id. Equal vectors of a label are one class, which is compared once and counts as many as it holds.
    Repeated rows of one vec_id and vector are one vector and give a row each; an empty table gives no rows; other columns are ignored. size: centres of a
    half, by default from the number of vectors. recall: the traversal's target for steps random in all dimensions; 1 visits all cells that can matter.
    """
    spark = df.sparkSession
    e = F.col(embedding).cast("array<double>")
    fine = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    base = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), e.alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    base = base.withColumn("h1", F.when(F.col("fine"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("fine"), F.xxhash64(F.lit(7), "embedding")))
    key = ["label", "h1", "h2"]
    members = base.filter("fine").select("vec_id", *key).distinct()
    classes = saved(members.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("held")), "classes")
    reps = base.filter("fine").join(classes.withColumnRenamed("rep", "vec_id"), ["vec_id", *key]).dropDuplicates(["vec_id", *key])
    reps = saved(reps.select("vec_id", F.concat_ws(":", "label", F.size("embedding").cast("string")).alias("label"), "embedding", "held"), "reps")
    size = size or book_size(reps.count())
    sample: dict[int, list] = {}
    for r in reps.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("embedding").collect():
        sample.setdefault(len(r[0]), []).append(r[0])
    # vectors of a length too rare for the sample have one cell, as have single numbers
    grids = {n: Grid(unit(v), size) for n, v in sample.items() if n > 1}
    send = spark.sparkContext.broadcast(grids)

    def place(batches):
        for whole, a in ((w, a) for w in batches for a in range(0, w.num_rows, 512)):
            batch = whole.slice(a, 512)
            ids, labels, held = batch["vec_id"].to_pylist(), batch["label"].to_pylist(), batch["held"].to_pylist()
            vectors = batch["embedding"].to_pylist()
            rows = {c: [] for c in ("vec_id", "label", "cell", "role", "held", "unit")}
            for n in {len(v) for v in vectors}:
                mine = [i for i, v in enumerate(vectors) if len(v) == n]
                x, grid = unit([vectors[i] for i in mine]), send.value.get(n)
                halves = grid.bounds(x) if grid else None
                most = reach(least, recall, grid.dimensions) if grid else 0.0
                for k, i in enumerate(mine):
                    own, visited = 0, [0]
                    if grid:
                        (na, a), (nb, b) = halves
                        own, visited = int(na[k]) * b.shape[1] + int(nb[k]), grid.cells(a[k], b[k], most)
                    for cell, role in [(own, 0), (own, 1), *[(c, 2) for c in visited if c > own]]:
                        for c, v in zip(rows, (ids[i], labels[i], cell, role, held[i], x[k].tobytes()), strict=True):
                            rows[c].append(v)
            kinds = {"vec_id": pa.int64(), "label": pa.string(), "cell": pa.int64(), "role": pa.int32(), "held": pa.int64(), "unit": pa.binary()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in rows.items()})

    placed = saved(reps.mapInArrow(place, "vec_id long, label string, cell long, role int, held long, unit binary"), "placed")
    count = placed.groupBy("label", "cell").agg(*[F.ceil(F.greatest(F.lit(1), F.sum((F.least("role", F.lit(1)) == r).cast("long"))) / block).cast("int").alias(f"n{r}") for r in (0, 1)], F.max((F.col("role") == 0).cast("int")).alias("any")).filter("any = 1").drop("any")
    mine = F.pmod(F.xxhash64("vec_id"), F.when(F.col("role") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int")
    dealt = placed.join(count, ["label", "cell"]).withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("n1")).otherwise(F.col("n0")) - 1)))
    dealt = dealt.select("vec_id", "label", "cell", "role", "held", "unit", F.when(F.col("role") == 0, F.col("mine")).otherwise(F.col("other")).alias("block"), F.when(F.col("role") > 0, F.col("mine")).otherwise(F.col("other")).alias("queries"))
    found = saved(dealt.groupBy("label", "cell", "block", "queries").applyInArrow(lambda t: block_links(t, least), "vec_id long, links long, root long"), "links")
    parts = components(found.filter("vec_id <> root").select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = classes.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select(*key, (F.coalesce("links", F.lit(0)) + F.col("held") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = base.select("vec_id", *key).join(named, key, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
