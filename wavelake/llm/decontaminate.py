"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mixed, word_hashes

#: 256 bits in four blocks. Fingerprints of multisets with weighted Jaccard similarity 0.75 differ in 44 bits on average, with a deviation of 6, so beyond 79
#: is one in 10^8; those of unrelated ones differ in 128, with a deviation of 8.
WORDS, RADIUS = 4, 79


def simhash(bit_sums: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of +1 and -1 over all bits: rows of four 64-bit blocks."""
    return np.packbits(bit_sums > 0, axis=1, bitorder="little").view("<u8")


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of a hash, which is mixed anew for every block."""
    blocks = np.stack([mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) for k in range(WORDS)], axis=1)
    bits = np.unpackbits(blocks.astype("<u8").view(np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


class Items:
    """Benchmark items of one length in words, with the multi-index over their fingerprints.

    If two fingerprints differ in at most RADIUS bits, then in one of the four blocks they differ in at most RADIUS // 4 (19 of 64), so the union over blocks
    holds every item within the radius. Of unrelated fingerprints 0.3 % pass a block, and none to speak of the whole distance.
    """

    def __init__(self, length: int, k: int):
        self.length, self.k, self.ids, self.unique, self.count, self.prints = length, min(k, length), [], [], [], []

    def add(self, item_id: int, grams: np.ndarray) -> None:
        unique, count = np.unique(grams, return_counts=True)
        self.ids.append(item_id)
        self.unique.append(unique)
        self.count.append(count)
        self.prints.append(simhash(signs(grams).sum(axis=0, keepdims=True))[0])

    def close(self) -> None:
        self.prints = np.ascontiguousarray(np.array(self.prints, np.uint64).reshape(-1, WORDS).T)

    def candidates(self, prints: np.ndarray, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of prints, item) within the radius; about cells pairs are looked at a time, and only those that pass are kept."""
        rows, items, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], max(1, cells // max(1, len(self.ids)))
        for a in range(0, len(prints), step):
            part = prints[a : a + step]
            near = np.zeros((len(part), len(self.ids)), bool)
            for w in range(WORDS):
                near |= np.bitwise_count(part[:, w, None] ^ self.prints[w][None]) <= RADIUS // WORDS
            i, j = np.nonzero(near)
            whole = sum(np.bitwise_count(part[i, w] ^ self.prints[w][j]).astype(np.int32) for w in range(WORDS)) <= RADIUS
            rows.append(i[whole] + a)
            items.append(j[whole])
        return np.concatenate(rows), np.concatenate(items)


class Index:
    """A block of benchmark items: by length, and all their shingles, which a window must share one of to be similar at all."""

    def __init__(self, items: list[tuple[int, bytes]], k: int = 5, bits: int = 20):
        self.k, self.groups = k, {}
        for item_id, text in items:
            h = word_hashes(text)
            if len(h):
                self.groups.setdefault(len(h), Items(len(h), k)).add(item_id, gram_hashes(h, min(k, len(h))))
        self.shingles, self.mask = {}, np.uint64((1 << bits) - 1)
        for g in self.groups.values():
            g.close()
            self.shingles.setdefault(g.k, []).append(g)
        for size, groups in self.shingles.items():
            known = np.unique(np.concatenate([u for g in groups for u in g.unique]))
            seen = np.zeros(1 << bits, bool)
            seen[known & self.mask] = True
            self.shingles[size] = (known, seen, groups)

    def search(self, text: bytes, least: float) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of each item's best window with at least that similarity."""
        h, out = word_hashes(text), []
        for size, (known, seen, groups) in self.shingles.items():
            grams = gram_hashes(h, size)
            at = np.flatnonzero(seen[grams & self.mask])
            if not len(at):
                continue
            at = at[known[np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)] == grams[at]]
            if len(at):
                for g in groups:
                    out += self._windows(g, grams, at, least)
        return out

    def _windows(self, g: Items, grams: np.ndarray, anchors: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
        whole = g.length - g.k + 1  # shingles of the item
        s = min(whole, len(grams))  # shingles of a window: a text shorter than the item is one window
        if s < least * whole - 1e-9:  # too short to be similar at all
            return []
        last = len(grams) - s
        mark = np.zeros(len(grams) + 1, np.int32)
        np.add.at(mark, np.clip(anchors - s + 1, 0, None), 1)
        np.add.at(mark, anchors + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark[: last + 1]) > 0)
        # of what both multisets hold, similarity asks for this many shingles
        most = int(np.ceil(least * (s + whole) / (1 + least) - 1e-9))
        hits = np.zeros(len(grams) + 1, np.int64)
        hits[anchors + 1] = 1
        hits = np.cumsum(hits)
        starts = starts[hits[starts + s] - hits[starts] >= most]
        found: dict[int, tuple[float, int]] = {}
        for a in range(0, len(starts), 4096):
            part = starts[a : a + 4096]
            lo, hi = part[0], part[-1] + s
            if hi - lo > 4 * (len(part) + s):  # apart: one by one
                sums = np.stack([signs(grams[x : x + s]).sum(axis=0) for x in part])
            else:
                sums = np.concatenate([np.zeros((1, 64 * WORDS), np.int32), np.cumsum(signs(grams[lo:hi]), axis=0, dtype=np.int32)])
                sums = sums[part - lo + s] - sums[part - lo]
            for r, i in zip(*(v.tolist() for v in g.candidates(simhash(sums))), strict=True):
                x = part[r]
                best = found.get(i, (0.0, 0))
                if best[0] < 1 and (similar := self._similarity(g, i, grams[x : x + s])) >= least and similar > best[0]:
                    found[i] = (similar, int(x))
        return [(g.ids[i], x, s + g.k - 1, similar) for i, (similar, x) in found.items()]

    @staticmethod
    def _similarity(g: Items, i: int, window: np.ndarray) -> float:
        unique, count = g.unique[i], g.count[i]
        at = np.minimum(np.searchsorted(unique, window), len(unique) - 1)
        both = np.minimum(np.bincount(at[unique[at] == window], minlength=len(unique)), count).sum()
        return float(both) / float(len(window) + count.sum() - both)


def indexes(benchmark: DataFrame, k: int, block_bytes: int, item_id: str, item_text: str) -> Iterator[Broadcast]:
    """The benchmark's items as broadcast indexes of about block_bytes of text each; one at least."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 32).alias("b")).first()["b"] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], bytes(r["text"])) for r in part], k))


SCHEMA = "doc_id long, item_id long, first_word long, n_words int, similarity double"


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, k: int = 5, block_bytes: int = 8 << 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, first_word, n_words, similarity (best window, the first on ties); clean documents give no row.

    Windows as long as the item slide over every whole text, and a text with fewer words than the item is one window (n_words is the window's); weights are how
    often a shingle occurs, similarity is sum of minima over sum of maxima. Items go in blocks of about block_bytes, each a pass over the documents, so what a pass sends to the executors is bounded. Null and empty texts or items match
    nothing; equal items and repeated rows give a row each; empty tables give none.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).filter("text is not null")
    out = None
    for index in indexes(benchmark, k, block_bytes, item_id, item_text):

        def search(batches, index=index):
            ix = index.value
            for batch in batches:
                found = [(d, *hit) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for hit in ix.search(t, least)]
                if found:
                    d, i, x, n, s = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "item_id": pa.array(i, pa.int64()), "first_word": pa.array(x, pa.int64()), "n_words": pa.array(n, pa.int32()), "similarity": pa.array(s, pa.float64())})

        found = rows.mapInArrow(search, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, k: int = 5, block_bytes: int = 8 << 20, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item: the pipeline's stage. Each row is judged by its own text, in place, so ids may be null or repeated."""
    out = docs
    for index in indexes(benchmark, k, block_bytes, item_id, item_text):

        def keep(batches, index=index):
            ix = index.value
            for batch in batches:
                part = batch.filter(pa.array([t is None or not ix.search(t, least) for t in batch[text].cast(pa.binary()).to_pylist()], pa.bool_()))
                if part.num_rows:
                    yield part

        out = out.mapInArrow(keep, docs.schema)
    return out
