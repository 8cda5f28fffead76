"""Language-model scores by stupid backoff: counts of n-grams by hash, joined back to the documents' n-grams and summed.

Counts come from the whole corpus. A batch of documents sends each distinct n-gram once to the hash's bucket, where its count table is summed; each bucket
sends back, to each batch, the counts of that batch's own n-grams. So no n-gram is hot, and what moves grows with the corpus, not with its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, bucket_bits, corpus_counts, gram_hashes, key_layout, told_counts, word_hashes

SCHEMA = "doc_id long, n_words long, log_score double, mean_log_score double"


def grams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all n-grams up to order, text after text and order after order; words of each text."""
    out, size = [], []
    for t in texts:
        h = word_hashes(t)
        size.append(len(h))
        out += [gram_hashes(h, n) for n in range(1, order + 1)]
    return out, np.array(size, np.int64)


def score_text(counts: list[np.ndarray], words: int, total: int, least: int, alpha: float) -> float:
    """Sum of log scores of a text's words. counts: of its n-grams, by order. From the longest n-gram that ends at a word to the shortest: the first that
    the corpus holds least times gives count / count of its beginning, times alpha for each step down; a single word gives count / total."""
    if not words:
        return 0.0
    out = np.log(counts[0] / total)
    for n in range(2, len(counts) + 1):
        if words < n:
            break
        at = slice(n - 1, None)
        known = counts[n - 1] >= least
        out[at] = np.where(known, np.log(counts[n - 1] / counts[n - 2][: words - n + 1]), np.log(alpha) + out[at])
    return float(out.sum())


def backoff_scores(docs: DataFrame, order: int = 2, least: int = 2, alpha: float = 0.4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, log_score (sum over its words), mean_log_score (null without words).

    Words are lower-cased (A-Z) runs of non-white space of whole texts. n-grams that the corpus holds less than least times are backed off from; counts are
    over all documents, repeated rows included. Null and empty texts score 0 with no words; null ids stay null; other columns are ignored.
    """
    texts, batches, size = batched(docs, doc_id, text, 8)
    bits, width = bucket_bits(size // 8), 40
    spark = docs.sparkSession
    total = texts.select(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0

    def keys(raw: list) -> np.ndarray:
        return np.concatenate([*grams(raw, order)[0], np.zeros(0, np.uint64)])

    def score(table, back):
        found, size = grams(table["text"].to_pylist(), order)
        unique, _, inverse = key_layout(np.concatenate([*found, np.zeros(0, np.uint64)]), bits, width)
        held = told_counts(unique, bits, width, back).astype(np.float64)[inverse]
        ends = np.cumsum([len(x) for x in found])
        parts = np.split(held, ends[:-1]) if len(ends) else []
        logs = [score_text(parts[order * i : order * (i + 1)], int(n), total, least, alpha) for i, n in enumerate(size)]
        mean = [s / n if n else None for s, n in zip(logs, size.tolist(), strict=True)]
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(size, pa.int64()), "log_score": pa.array(logs, pa.float64()), "mean_log_score": pa.array(mean, pa.float64())})

    counts = corpus_counts(texts, batches, keys, bits, width)
    return texts.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(score, SCHEMA)
