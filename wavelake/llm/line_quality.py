"""Quality classifier: a linear-chain conditional random field labels lines good or bad; marginals, weighted by length, make a document's score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The classifier is fitted on at most this many labelled documents of each class, whole texts.
SAMPLE_PER_CLASS = 2_000

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "point": b".,;:?'\"-()", "bang": b"!", "pipe": b"|",
    "mark": b"*&%$#@~^_=<>/\\+[]{}`", "wide": bytes(range(0xC0, 256)), "blank": b" \t\r\x0b\x0c",
}
_KIND = np.zeros(256, np.uint8)
for _i, _chars in enumerate(_KINDS.values()):
    _KIND[list(_chars)] = _i + 1
FEATURES = 15
_CODE = np.random.default_rng(3).integers(1, 1 << 62, 256, dtype=np.int64)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, the lines' lengths in bytes, and how many lines each text has (an empty text has one, empty)."""
    rows = [t.split(b"\n") for t in texts]
    per_text = np.array([len(r) for r in rows], np.int64)
    lines = [x for r in rows for x in r]
    raw = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.r_[0, ends[:-1] + 1]
    length = (ends - starts).astype(np.float64)
    kind = _KIND[raw]
    count = {name: np.add.reduceat(kind == i + 1, starts, dtype=np.int64).astype(np.float64) for i, name in enumerate(_KINDS)}
    blank = (kind == len(_KINDS)) | (raw == 10)
    first = ~blank & np.r_[True, blank[:-1]]
    words = np.maximum(np.add.reduceat(first, starts, dtype=np.int64), 0).astype(np.float64)
    marked = np.isin(kind, (5, 6, 7)) & np.r_[blank[1:], True]
    odd_words = np.add.reduceat(marked, starts, dtype=np.int64).astype(np.float64)
    same = np.r_[False, (raw[1:] == raw[:-1]) & (kind[1:] != 2) & (raw[1:] != 10)]
    runs = np.add.reduceat(same, starts, dtype=np.int64).astype(np.float64)
    # how many words are the word before them, by the sum of their bytes' codes
    at_word = np.flatnonzero(first)
    code = np.add.reduceat(np.where(blank, 0, _CODE[raw]), at_word) if len(at_word) else np.zeros(0, np.int64)
    echo = np.zeros(len(raw), bool)
    text = np.searchsorted(starts[np.cumsum(per_text) - per_text], at_word, side="right")
    echo[at_word[1:][(code[1:] == code[:-1]) & (text[1:] == text[:-1])]] = True
    echoes = np.add.reduceat(echo, starts, dtype=np.int64).astype(np.float64)
    again, at = np.zeros(len(lines)), 0
    for r in rows:
        if len(r) > 1:
            seen: set[int] = set()
            for i, x in enumerate(r):
                if len(x) > 3:
                    h = xxhash.xxh3_64_intdigest(x)
                    again[at + i] = h in seen
                    seen.add(h)
        at += len(r)
    size, n = np.maximum(length, 1), np.maximum(words, 1)
    letters = np.maximum(count["upper"] + count["lower"], 1)
    out = np.stack([
        np.log1p(length), count["upper"] / letters, count["digit"] / size, count["mark"] / size, count["bang"] / n, count["pipe"] / n, count["wide"] / size, count["point"] / size,
        np.minimum(size / n, 40) / 10, odd_words / n, runs / size, again, (words == 0).astype(float), np.log1p(words), echoes / n,
    ], axis=1)
    return out, length, per_text


def _ends(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each text."""
    after = np.cumsum(per_text)
    return after - per_text, after - 1


def with_neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and of the line after (zeros at a text's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    first, last = _ends(per_text)
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def blocks_of(per_text: np.ndarray, cells: int) -> list[np.ndarray]:
    """Texts in blocks of alike length, so that longest text times texts stays below cells, or one text alone."""
    order, out, a = np.argsort(per_text, kind="stable"), [], 0
    size = per_text[order]
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * size[b] <= cells:
            b += 1
        out.append(order[a:b])
        a = b
    return out


def marginals(emit: np.ndarray, step: np.ndarray, per_text: np.ndarray, cells: int = 100_000) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once. emit: score of 'good' against 'bad' for each line; step: 2 x 2 transition scores.

    Gives P(good) of each line, the expected transitions summed over all chains, and the log-normaliser's sum. Texts go in blocks of alike length, so that
    memory follows the lines there are and not the longest text."""
    good, pairs, total = np.zeros(len(emit)), np.zeros((2, 2)), 0.0
    first = np.cumsum(per_text) - per_text
    for part in blocks_of(per_text, cells):
        n, at = per_text[part], first[part]
        longest, k = int(n.max()), len(part)
        e = np.zeros((longest, k, 2))
        for t in range(longest):
            live = n > t
            e[t, live, 1] = emit[at[live] + t]
        alpha = np.zeros((longest, k, 2))
        alpha[0] = e[0]
        for t in range(1, longest):
            live = (n > t)[:, None]
            came = np.logaddexp(alpha[t - 1][:, :1] + step[0], alpha[t - 1][:, 1:] + step[1]) + e[t]
            alpha[t] = np.where(live, came, alpha[t - 1])
        z = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        total += z.sum()
        beta = np.zeros((k, 2))
        for t in range(longest - 1, -1, -1):
            live = n > t
            p = np.exp(alpha[t] + beta - z[:, None])
            good[at[live] + t] = p[live, 1]
            if t:
                ahead = e[t] + beta
                joint = np.exp(alpha[t - 1][:, :, None] + step[None] + ahead[:, None, :] - z[:, None, None])
                pairs += joint[live].sum(axis=0)
                new = np.logaddexp(step[:, 0][None] + ahead[:, :1], step[:, 1][None] + ahead[:, 1:])
                beta = np.where(live[:, None], new, beta)
    return good, pairs, total


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 15) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(h, g)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


class LineField:
    """The fitted model: feature scaling, line weights, transitions, and the two numbers that turn a share of good text into a score."""

    def __init__(self, mean, scale, weights, step, slope, offset):
        self.mean, self.scale, self.weights, self.step, self.slope, self.offset = mean, scale, weights, step, slope, offset

    @staticmethod
    def share(good: np.ndarray, length: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted mean of the lines' P(good)."""
        first = np.cumsum(per_text) - per_text
        weight = length + 1
        s = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        s = np.clip(s, 1e-4, 1 - 1e-4)
        return np.log(s / (1 - s))

    def _emit(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """with_neighbours(x) @ weights, without the wide table."""
        own, before, after = self.weights[:-1].reshape(3, -1)
        z = (x - self.mean) / self.scale
        out = z @ own + self.weights[-1]
        first, last = _ends(per_text)
        left, right = z @ before, z @ after
        left[last], right[first] = 0, 0
        out[1:] += left[:-1]
        out[:-1] += right[1:]
        return out

    def score(self, texts: list[bytes], chunk: int = 4 << 20) -> np.ndarray:
        """One score for each text; about chunk bytes of texts at a time, or one text."""
        size = np.cumsum([len(t) for t in texts], dtype=np.int64) // chunk
        cuts = np.flatnonzero(np.diff(size, prepend=-1)) if len(texts) else []
        return np.concatenate([np.zeros(0), *[self._score(texts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True)]])

    def _score(self, texts: list[bytes]) -> np.ndarray:
        x, length, per_text = line_features(texts)
        good, _, _ = marginals(self._emit(x, per_text), self.step, per_text)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.share(good, length, per_text) + self.offset, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, length: np.ndarray, per_text: np.ndarray, label: np.ndarray, prior: dict[int, float], rounds: int = 60) -> LineField:
        """label: one for each text. Only texts have labels, so lines of bad texts are told apart by the model itself: those it finds bad, at least the
        worst, are bad, and again with the weights so learnt. prior: by class, how many labelled texts stand for one of the sample."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = with_neighbours((x - mean) / scale, per_text)
        text = np.repeat(np.arange(len(per_text)), per_text)
        bad_text = label[text] == 0
        share = np.minimum(1 / per_text[text], 0.2)
        y = 1.0 - bad_text
        ends = np.cumsum(per_text)
        for _ in range(3):
            w = logistic(z, y, share, 1e-2)
            p = z @ w
            y = np.where(bad_text & (p < 0), 0.0, 1.0)
            worst = np.array([a + int(np.argmin(p[a:b])) for a, b in zip(ends - per_text, ends, strict=True)])
            y[worst[label == 0]] = 0.0
        # the chain: gradient steps on the conditional likelihood of the line labels, from the single-line weights
        step, weights = np.zeros((2, 2)), w.copy()
        inside = np.ones(len(y), bool)
        inside[ends - per_text] = False
        now = y.astype(int)
        pair = np.zeros((2, 2))
        np.add.at(pair, (now[np.flatnonzero(inside) - 1], now[inside]), 1)
        both = np.r_[weights, step.ravel()]
        m, v = np.zeros_like(both), np.zeros_like(both)
        for t in range(1, rounds + 1):
            good, expected, _ = marginals(z @ both[:-4], both[-4:].reshape(2, 2), per_text)
            g = np.r_[z.T @ (y - good) - 1e-2 * both[:-4], (pair - expected).ravel() - 1e-2 * both[-4:]] / len(y)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
            both = both + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        weights, step = both[:-4], both[-4:].reshape(2, 2)
        good, _, _ = marginals(z @ weights, step, per_text)
        s = cls.share(good, length, per_text)
        slope, offset = logistic(np.stack([s, np.ones(len(s))], axis=1), label.astype(float), np.array([prior[int(k)] for k in label]), 1e-2)
        return cls(mean, scale, weights, step, float(max(slope, 0.0)), float(offset))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> LineField | None:
    """Fit on at most per_class labelled documents of each class (by hash of the id) out of those whose crc32(doc_id) mod 3 is not 1; None without any.
    Documents that labels contradict each other about are left out, as are labels other than 0 and 1; of rows that share a doc_id each is fitted on."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null").filter(fold != 1)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    chosen = {}
    for q in sizes:  # bounded by per_class
        chosen |= {r["doc_id"]: q for r in known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()}
    pick = F.broadcast(spark.createDataFrame([(k,) for k in chosen], "doc_id long"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).join(pick, "doc_id")

    def features(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                x, length, per_text = line_features(part["text"].to_pylist())
                ends = np.cumsum(per_text)
                both = np.concatenate([x, length[:, None]], axis=1).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "x": pa.array([both[e - n : e].tobytes() for e, n in zip(ends, per_text, strict=True)], pa.binary())})

    got = sorted((r["doc_id"], bytes(r["x"])) for r in rows.mapInArrow(features, "doc_id long, x binary").collect())
    if len({chosen[d] for d, _ in got}) < 2:
        return None
    parts = [np.frombuffer(x, np.float32).reshape(-1, FEATURES + 1).astype(np.float64) for _, x in got]
    label = np.array([chosen[d] for d, _ in got])
    taken = np.bincount(label, minlength=2)
    x = np.concatenate(parts)
    return LineField.fit(x[:, :-1], x[:, -1], np.array([len(p) for p in parts]), label, {q: sizes[q] / taken[q] for q in sizes})


def quality(docs: DataFrame, model: LineField | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out (crc32(doc_id) mod 3 is 1), score (0 to 1; 1: good), predicted (1 if score >= 0.5).

    Whole texts; null and empty texts are one empty line and get its score; without a model (no labels of both classes) the score is 0.5. Null ids are not
    held out. Repeated rows get equal scores. Labels and ids don't enter the score; other columns are ignored.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)  # some dozens of numbers
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    ids = F.col(doc_id).cast("long")
    held = F.coalesce(F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))

    def score(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part["text"].to_pylist()
                s = np.full(len(texts), 0.5) if send.value is None else send.value.score(texts)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())})

    return docs.select(ids.alias("doc_id"), held.alias("held_out"), raw.alias("text")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: LineField | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose text the model doesn't reject: the pipeline's stage. Scored in place, without a join."""
    send = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                if send.value is not None:
                    texts = [(t or "").encode() for t in part[text].to_pylist()]
                    part = part.filter(pa.array(send.value.score(texts) >= 0.5))
                if part.num_rows:
                    yield part

    return docs.mapInArrow(keep, docs.schema)
