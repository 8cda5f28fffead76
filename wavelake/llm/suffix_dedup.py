"""Removal of repeated 100-byte strings with sharded suffix arrays.

Which strings can repeat at all is told by their minimizers: of the 69 runs of 32 bytes in a 100-byte string, the one with the smallest hash. Equal strings
have equal minimizers at the same place, so windows are cut into runs that share a minimizer, and only runs whose minimizer the corpus holds more than once
go on. Runs go to shards by minimizer; a shard's suffix array puts equal strings side by side wherever they came from, so shards need no merging.

A minimizer that very many runs share, such as one inside a common line that is shorter than the strings sought, would bring them all to one shard. Its runs
are split by where it stands in the windows: nine windows that follow each other share 92 bytes around it, and equal windows share them too, so those bytes
decide the shard instead. Only strings that repeat almost whole still meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, bucket_bits, corpus_counts, key_layout, mixed, tasks_for, told_counts
from .suffix_array import common_prefixes, suffix_array

RUN = 32
_PLACE = 18  # bits of a place inside a stretch
_CODE = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


#: From so many occurrences on a minimizer's runs are split, into groups of so many windows.
HOT, GROUP = 2_000, 9


def minimizer_runs(raw: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, start, number of windows and the minimizer's place of each run of windows with one minimizer, in at most 2^18 bytes."""
    h, span, power = _CODE[raw], 1, _BASE
    while span < RUN:
        h = h[:-span] * np.uint64(power) + h[span:]
        span, power = 2 * span, power * power % (1 << 64)
    h = (mixed(h) >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    size = window - RUN + 1
    span = 1
    while 2 * span <= size:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < size:
        h = np.minimum(h[: len(h) - (size - span)], h[size - span :])
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    place = (h[starts] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    return mixed(h[starts] >> np.uint64(_PLACE)), starts, np.diff(np.r_[starts, len(h)]), place


def text_runs(raws: list[bytes], window: int, stretch: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: key, text's number, start, number of windows and the minimizer's place of each run. Long texts go stretch by stretch, short ones many at
    once."""
    out = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))]

    def flush(part: list[tuple[int, int, bytes]]) -> None:
        size = np.array([len(x) for _, _, x in part])
        first = np.cumsum(size) - size
        key, start, n, place = minimizer_runs(np.frombuffer(b"".join(x for _, _, x in part), np.uint8), window)
        # windows that reach over a text's end are none: runs are cut there
        ok = first + size - window + 1
        a = np.searchsorted(first, start, side="right") - 1
        b = np.searchsorted(first, start + n - 1, side="right") - 1
        wide = b > a
        if wide.any():
            keys, starts, ends, owner, places = [key[~wide]], [start[~wide]], [(start + n)[~wide]], [a[~wide]], [place[~wide]]
            for i in np.flatnonzero(wide):
                own = np.arange(a[i], b[i] + 1)
                keys.append(np.full(len(own), key[i]))
                starts.append(np.maximum(start[i], first[own]))
                ends.append(np.minimum(start[i] + n[i], first[own] + size[own]))
                owner.append(own)
                places.append(np.full(len(own), place[i]))
            key, start, end, a, place = (np.concatenate(x) for x in (keys, starts, ends, owner, places))
        else:
            end = start + n
        end = np.minimum(end, ok[a])
        keep = end > start
        key, start, end, a, place = key[keep], start[keep], end[keep], a[keep], place[keep]
        number, base = np.array([i for i, _, _ in part]), np.array([x for _, x, _ in part])
        move = base[a] - first[a]
        out.append((key, number[a], start + move, end - start, place + move))

    part, held = [], 0
    for i, raw in enumerate(raws):
        for at in range(0, max(0, len(raw) - window + 1), stretch):
            x = raw[at : at + stretch + window - 1]
            if held and held + len(x) > stretch + window:
                flush(part)
                part, held = [], 0
            part.append((i, at, x))
            held += len(x)
    if part:
        flush(part)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def in_order(table: pa.Table) -> tuple[list[int | None], np.ndarray, list[bytes]]:
    """A batch's rows by doc_id (null first), then a hash of the text: ids, hashes, texts. Rows with both equal are equal, and in one batch."""
    rows = sorted((d is not None, d or 0, xxhash.xxh3_64_intdigest(t) >> 1, t) for d, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    return [d if known else None for known, d, _, _ in rows], np.array([h for _, _, h, _ in rows], np.int64), [t for *_, t in rows]


SENT = "shard long, batch long, at binary, size binary, text binary, marks binary"
MARKS = "batch long, marks binary"
_AT = np.dtype([("doc", "<i8"), ("copy", "<i8"), ("row", "<i4"), ("start", "<i8")])
_MARK = np.dtype([("row", "<i4"), ("n", "<i4"), ("start", "<i8")])
_NONE = np.iinfo(np.int64).min


def split_runs(raws: list[bytes], runs: tuple[np.ndarray, ...], window: int) -> tuple[np.ndarray, ...]:
    """Runs cut into groups of windows by the place of the minimizer in them; the bytes that a group's windows share are its key."""
    out = []
    for key, text, start, n, place in zip(*(x.tolist() for x in runs), strict=True):
        at, end = start, start + n
        while at < end:
            group = (place - at) // GROUP  # this window's minimizer lies group * GROUP or up to GROUP - 1 more bytes after its start
            stop = min(end, place - group * GROUP + 1)
            shared = raws[text][place - group * GROUP : place - group * GROUP + window - GROUP + 1]
            out.append((xxhash.xxh3_64_intdigest(shared, (key + group) % 2**64), text, at, stop - at))
            at = stop
    cols = zip(*out, strict=True) if out else ([], [], [], [])
    return tuple(np.array(c, np.uint64 if i == 0 else np.int64) for i, c in enumerate(cols))


def send_runs(batch: int, table: pa.Table, back: pa.Table, bits: int, width: int, shards: int, window: int, hot: int) -> pa.Table:
    """A batch's runs that may repeat, by shard. Of runs with equal bytes only the first goes; the others are repeats for sure and are marked at once."""
    ids, copy, raws = in_order(table)
    runs = text_runs(raws, window)
    unique, _, inverse = key_layout(runs[0], bits, width)
    held = told_counts(unique, bits, width, back)[inverse] if len(runs[0]) else np.zeros(0, np.uint64)
    often = split_runs(raws, tuple(x[held > hot] for x in runs), window)
    mild = (held > 1) & (held <= hot)
    key, text, start, n = (np.concatenate([x[mild], y]) for x, y in zip(runs[:4], often, strict=True))
    some = np.arange(len(key))
    order = some[np.lexsort((start[some], text[some]))]
    first: dict[bytes, int] = {}
    go, marks = [], []
    for i, t, a, m in zip(order.tolist(), text[order].tolist(), start[order].tolist(), n[order].tolist(), strict=True):
        x = raws[t][a : a + m + window - 1]
        if x in first:
            marks.append((t, m, a))
        else:
            first[x] = i
            go.append((i, x))
    at = np.zeros(len(go), _AT)
    index = np.array([i for i, _ in go], np.int64)
    rows = text[index] if len(go) else index
    at["row"], at["start"] = rows, start[index]
    at["doc"], at["copy"] = np.array([_NONE if d is None else d for d in ids], np.int64)[rows] if len(go) else [], copy[rows] if len(go) else []
    shard = (key[index] % np.uint64(shards)).astype(np.int64)
    out = {c: [] for c in ("shard", "at", "size", "text", "marks")}
    for s in np.unique(shard):
        mine = np.flatnonzero(shard == s)
        texts = [go[i][1] for i in mine]
        for c, v in (("shard", int(s)), ("at", at[mine].tobytes()), ("size", np.array([len(x) for x in texts], "<u4").tobytes()), ("text", b"".join(texts)), ("marks", b"")):
            out[c].append(v)
    if marks:
        for c, v in (("shard", batch % shards), ("at", b""), ("size", b""), ("text", b""), ("marks", np.array(marks, _MARK).tobytes())):
            out[c].append(v)
    b = pa.binary()
    return pa.table({"shard": pa.array(out["shard"], pa.int64()), "batch": pa.array([batch] * len(out["shard"]), pa.int64()), "at": pa.array(out["at"], b), "size": pa.array(out["size"], b), "text": pa.array(out["text"], b), "marks": pa.array(out["marks"], b)})


def repeated_windows(texts: list[bytes], windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of distinct texts that occur more than once: text, offset, number of the group of equal windows."""
    size = np.array([len(x) for x in texts])
    first = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(b"\x00".join(texts) + b"\x00\x00", np.uint8)
    symbol = raw.astype(np.int16) + 2
    symbol[first + size] = 1
    symbol[-1] = 0
    order = suffix_array(symbol, 258, window)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    owner = np.r_[owner, len(texts)]
    offset = np.arange(len(raw)) - np.r_[first, len(raw) - 1][owner]
    begins = offset < np.r_[windows, 0][owner]
    order = order[begins[order]]
    prefix = common_prefixes(raw, order, window)[order]
    new = np.r_[True, prefix[1:] < window] if len(order) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(group) else new
    return owner[order[many]], offset[order[many]], group[many]


def mark_shard(table: pa.Table, window: int) -> pa.Table:
    """Which windows of a shard's runs occur before: marks by batch."""
    parts: dict[int, list[np.ndarray]] = {}
    at, owner, texts = [], [], []
    for batch, a, size, text, marks in zip(*(table[c].to_pylist() for c in ("batch", "at", "size", "text", "marks")), strict=True):
        if marks:
            parts.setdefault(batch, []).append(np.frombuffer(marks, _MARK))
        if a:
            at.append(np.frombuffer(a, _AT))
            owner.append(np.full(len(at[-1]), batch))
            ends = np.cumsum(np.frombuffer(size, "<u4")).tolist()
            texts += [text[x:y] for x, y in zip([0, *ends], ends, strict=False)]
    if at:
        at, owner = np.concatenate(at), np.concatenate(owner)
        order = np.lexsort((at["start"], at["row"], at["copy"], at["doc"]))
        n = np.array([len(x) for x in texts]) - window + 1
        first: dict[bytes, int] = {}
        later = []
        for i in order.tolist():
            if first.setdefault(texts[i], i) != i:
                later.append(i)
        found = [(np.array(later, np.int64), at["start"][later], n[later])]
        kept = np.array(list(first.values()), np.int64)
        which, offset, group = repeated_windows([texts[i] for i in kept], n[kept], window)
        if len(which):
            own = kept[which]
            place = at["start"][own] + offset
            rank = np.lexsort((place, at["row"][own], at["copy"][own], at["doc"][own], group))
            g = group[rank]
            again = np.r_[False, g[1:] == g[:-1]]
            found.append((own[rank][again], place[rank][again], np.ones(int(again.sum()), np.int64)))
        index, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
        batches = owner[index]
        for b in np.unique(batches):
            mine = batches == b
            m = np.zeros(int(mine.sum()), _MARK)
            m["row"], m["start"], m["n"] = at["row"][index[mine]], start[mine], count[mine]
            parts.setdefault(int(b), []).append(m)
    return pa.table({"batch": pa.array(list(parts), pa.int64()), "marks": pa.array([np.concatenate(p).tobytes() for p in parts.values()], pa.binary())})


def spans_of(marks: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that marked windows of one text cover."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(zip(marks["start"].tolist(), marks["n"].tolist(), strict=True)):
        b = a + n + window - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, window: int = 100, doc_id: str = "doc_id", text: str = "text", batch_mb: float = 4, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (array of [start, end) in bytes, maximal, in order), kept (the remaining bytes).

    A byte goes if a string of window bytes that also starts earlier covers it (smaller doc_id, or earlier in the same document); strings never cross
    documents, overlaps count, and the input decides, not what is left. Rows of one doc_id go by a hash of the text; null ids come first; null texts are empty and lose
    nothing; texts shorter than window neither; an empty table gives no rows; other columns are ignored.
    """
    if window < RUN + 1:
        raise ValueError(f"strings must be longer than {RUN} bytes")
    texts, batches, total = batched(docs, doc_id, text, batch_mb)
    bits, width = bucket_bits(total // 30), 32
    counts = corpus_counts(texts, batches, lambda raw: text_runs(raw, window)[0], bits, width)

    def send(key, table, back):
        return send_runs(key[0].as_py(), table, back, bits, width, batches, window, hot)

    def finish(table, back):
        ids, _, raws = in_order(table)
        marks = np.concatenate([np.zeros(0, _MARK), *[np.frombuffer(m, _MARK) for m in back["marks"].to_pylist()]])
        marks = marks[np.argsort(marks["row"], kind="stable")]
        cuts = np.searchsorted(marks["row"], np.arange(len(raws) + 1))
        spans, kept = [], []
        for i, raw in enumerate(raws):
            s = spans_of(marks[cuts[i] : cuts[i + 1]], window) if cuts[i + 1] > cuts[i] else []
            spans.append(s)
            ends = [0, *[b for _, b in s]]
            kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*[a for a, _ in s], len(raw)], strict=True)))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(r) for r in raws], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
        })

    sent = texts.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(send, SENT).repartition(tasks_for(docs.sparkSession, batches), "shard")
    marks = sent.groupBy("shard").applyInArrow(lambda t: mark_shard(t, window), MARKS).repartition(tasks_for(docs.sparkSession, batches), "batch")
    return texts.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digest(spans: DataFrame) -> DataFrame:
    """The digest of repeated_spans(): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
