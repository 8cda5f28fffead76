"""N-gram Jaccard join with token-combination prefixes.

Tokens are hashes of shingles. Tokens that the same sets hold form a token class: whoever holds one of them holds all, so a set is a list of classes with
weights, in one order for all sets (rarest first). Sets of n and m tokens with similarity t or more share o >= ceil(t * max(n, m)) tokens. So their first
common class lies where the classes from there on still weigh o (the prefix); and given their first k common classes, the next one, if they share more, lies
where the weight of those k and of all classes from there on is still o (the extended prefix).

The index starts with single classes of the prefix. A key that few sets hold gives its pairs. A key that many hold is extended: each holder goes on with the
combinations of the key's classes and one more class of its extended prefix, until keys are rare. Common text that half the corpus holds is one class, so a
combination of k classes is k passages, not k words of one passage, and keys get rare quickly. Sets that share a frequent key and nothing else share exactly
the key's weight: those that this links are tied to the key's smallest set, which links all of them that it links to each other. All pairs are verified.
Sets that share most of their text in ever different parts have very many combinations that are no rarer than their classes; where a key's holders outside
its largest component are fewer than a multiple of the extensions that a holder would add, the holders are compared at once instead, in blocks. So what is
compared for a key is at most a multiple of what extending it would write.

Equal sets are one node from the start, and nodes that share a minimum hash are first held against one of them, which links most of a group of near copies
with one comparison a member; holders of a key are then held against one holder, another one for each key. The index only holds classes and keys that
different components share. Tokens and keys of any frequency are cut by a hash of the holder before they meet their counts. Past the first step sets travel
as lists of classes: classes within one component can't add to what sets of different components share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, batched, bucket_bits, components, corpus_counts, key_layout, met, mixed, saved, shingles, told_counts, word_hashes

SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
SET_SCHEMA = "doc_id long, text_hash long, n long, node long, keys array<long>, held array<long>, cuts array<int>"
#: An index entry costs as much as so many comparisons of two lists of classes in a matrix product, at least.
ENTRY_COST = 64
ENTRY_SCHEMA = "key long, node long, component long, n long, acc long, place int, more long"


def token_set(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingles(word_hashes(text), words))


def needed(n: int, num: int, den: int) -> int:
    """The least overlap with any set that links to one of n tokens."""
    return -(-num * n // den)


def _lists(values: list) -> pa.Array:
    return pa.array(values, pa.list_(pa.int64()))


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, at = flat.values.to_numpy(), flat.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at, at[1:], strict=False)]


def describe(table: pa.Table, back: pa.Table | None, bits: int, width: int, words: int, num: int, den: int, each: int = 10_000) -> pa.Table:
    """A batch's documents: size and hash of the set; for those that share enough tokens with any other document, minimum hashes and the shared tokens, with
    the number of parts that a token's holders are cut into."""
    raws = table["text"].to_pylist()
    sets = [token_set(t, words) for t in raws]
    all_tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
    unique, _, inverse = key_layout(all_tokens, bits, width)
    held = told_counts(unique, bits, width, back)[inverse]
    nodes, keys, shared, cuts, at = [], [], [], [], 0
    for tokens in sets:
        n = len(tokens)
        df = held[at : at + n]
        at += n
        nodes.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())))) if n else None)
        some = tokens[df > 1]
        if n and len(some) >= needed(n, num, den):
            keys.append([int(mixed(some ^ np.uint64(s)).min().view(np.int64)) for s in SEEDS])
            shared.append(some.view(np.int64))
            cuts.append((1 + df[df > 1] // np.uint64(each)).astype(np.int32))
        else:
            keys.append(None)
            shared.append(None)
            cuts.append(None)
    long = pa.int64()
    hashes = np.array([xxhash.xxh64_intdigest(t, 42) for t in raws], np.uint64).view(np.int64)
    return pa.table({
        "doc_id": table["doc_id"].combine_chunks(), "text_hash": pa.array(hashes, long), "n": pa.array([len(x) for x in sets], long), "node": pa.array(nodes, long), "keys": _lists(keys), "held": _lists(shared),
        "cuts": pa.array(cuts, pa.list_(pa.int32())),
    })


def _weighed(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each set's names in order, and their weights."""
    out = []
    for names, weights in zip(_arrays(table["names"]), _arrays(table["weights"]), strict=True):
        order = np.argsort(names)
        out.append((names[order], weights[order]))
    return out


def compare(table: pa.Table, num: int, den: int) -> pa.Table:
    """One set (role 0) against others: those that link."""
    role, nodes, sizes, sets = table["role"].to_pylist(), table["node"].to_pylist(), table["n"].to_pylist(), _weighed(table)
    hub = role.index(0)
    (left, weight), n, found = sets[hub], sizes[hub], []
    for r, node, m, (right, _) in zip(role, nodes, sizes, sets, strict=True):
        if r:
            at = np.minimum(np.searchsorted(left, right), len(left) - 1)
            both = int(weight[at[left[at] == right]].sum())
            if den * both >= num * (n + m - both):
                found.append(node)
    return pa.table({"a": pa.array([nodes[hub]] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, chunk: int = 128) -> DataFrame:
    """Those of the distinct pairs (a, b) that link. sets: node, n, names, weights. A hub's partners are cut into chunks, each with its own copy of the hub's
    set."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))
    hubs = sizes.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"))
    rows = dealt.select(F.col("b").alias("node"), "a", "chunk", F.lit(1).alias("role")).union(hubs).join(sets.select("node", "n", "names", "weights"), "node")
    return rows.groupBy("a", "chunk").applyInArrow(lambda t: compare(t, num, den), "a long, b long")


def near(n: Column, m: Column, num: int, den: int) -> Column:
    """Whether sets of n and m tokens can link at all."""
    return F.greatest(n, m) * num <= F.least(n, m) * den


def index_pairs(items: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components, near enough in size, that share a rare key."""
    other = items.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "component", "n")])
    apart = F.col("component") < F.col("component2")
    return items.join(other, "key").filter(near(F.col("n"), F.col("n2"), num, den) & apart).select(F.col("node").alias("a"), F.col("node2").alias("b"))


def classed(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Sets as lists of token classes, rarest first: node, component, n, classes (holders, class, weight); only classes that different components hold, and
    only sets that such classes can link. A class is told by how many sets hold a token and by two sums of hashes of the sets that do."""
    tokens = sets.select("node", "component", "n", F.explode(F.arrays_zip("held", "cuts")).alias("t"))
    tokens = tokens.select("node", "component", "n", F.col("t.held").alias("token"), F.pmod(F.xxhash64("node"), F.col("t.cuts")).cast("int").alias("part")).repartition("token", "part")
    sums = {"c": F.count("*"), "x": F.bit_xor(F.xxhash64("node", F.lit(1))), "y": F.bit_xor(F.xxhash64("node", F.lit(2))), "lo": F.min("component"), "hi": F.max("component"), "size": F.max("n")}
    cells = tokens.groupBy("token", "part").agg(*[v.alias(k) for k, v in sums.items()])
    over = Window.partitionBy("token")
    again = {"c": F.sum("c"), "x": F.bit_xor("x"), "y": F.bit_xor("y"), "lo": F.min("lo"), "hi": F.max("hi"), "size": F.max("size")}
    told = cells.select("token", "part", *[v.over(over).alias(k) for k, v in again.items()]).filter("lo < hi and size > 0")
    wide = tokens.join(told.select("token", "part", "c", F.xxhash64("c", "x", "y").alias("class")), ["token", "part"])
    weighed = wide.groupBy("node", "component", "n", "c", "class").agg(F.count("*").alias("w"))
    out = weighed.groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("c", "class", "w"))).alias("classes"), F.sum("w").alias("all"))
    return out.filter(F.col("all") * den >= F.col("n") * num).drop("all")


def extend(batches, num: int, den: int, first: bool):
    """Index entries of sets (node, component, n, classes): keys of one class (first), or of a given entry (key, acc, place) and one more class. more: how
    many extensions an entry has."""
    for batch in batches:
        out = {c: [] for c in ("key", "node", "component", "n", "acc", "place", "more")}
        kinds, starts = batch["classes"], batch["classes"].offsets.to_numpy()
        name, weight = kinds.values.field("class").to_numpy().view(np.uint64), kinds.values.field("w").to_numpy()
        node, part, size = batch["node"].to_pylist(), batch["component"].to_pylist(), batch["n"].to_pylist()
        given = None if first else (batch["key"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), batch["acc"].to_pylist(), batch["place"].to_pylist())
        for i in range(batch.num_rows):
            names, w = name[starts[i] : starts[i + 1]], weight[starts[i] : starts[i + 1]]
            rest, need = np.cumsum(w[::-1]), needed(size[i], num, den)  # weight of the last 1, 2, ... classes
            acc, from_ = (0, 0) if first else (given[1][i], given[2][i] + 1)
            at = np.arange(from_, len(w) - np.searchsorted(rest, need - acc))
            if not len(at):
                continue
            key = names[at] if first else mixed(given[0][i : i + 1] + names[at])
            out["key"].append(key.view(np.int64))
            out["acc"].append(acc + w[at])
            out["place"].append(at)
            out["more"].append(np.maximum(len(w) - np.searchsorted(rest, need - acc - w[at]) - at - 1, 0))
            for c, v in (("node", node[i]), ("component", part[i]), ("n", size[i])):
                out[c].append(np.full(len(at), v, np.int64))
        if out["key"]:
            cols = {c: np.concatenate(v) for c, v in out.items()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "place" else pa.int64()) for c, v in cols.items()})


def overlaps(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], width: int = 2048) -> np.ndarray:
    """How many tokens each of the left sets shares with each of the right, by matrix products over stretches of the classes that both sides hold."""
    flat = [np.concatenate([names for names, _ in side]) for side in (left, right)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)))
    if not len(both):
        return out
    sides = []
    for sets, names in zip((left, right), flat, strict=True):
        at = np.minimum(np.searchsorted(both, names), len(both) - 1)
        known = both[at] == names
        weight = np.concatenate([w for _, w in sets]) if sets is left else np.ones(len(names))
        sides.append((np.repeat(np.arange(len(sets)), [len(v) for v, _ in sets])[known], at[known], weight[known], len(sets)))
    for start in range(0, len(both), width):
        parts = []
        for row, at, weight, size in sides:
            mine = (at >= start) & (at < start + width)
            m = np.zeros((size, min(width, len(both) - start)))
            m[row[mine], at[mine] - start] = weight[mine]
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def block_links(table: pa.Table, num: int, den: int) -> pa.Table:
    """Sets outside a key's largest component (role 0) against a block of its holders (role 1): links between different components, as a spanning forest."""
    role, node, part, n = (table[c].to_numpy() for c in ("role", "node", "component", "n"))
    sets = _weighed(table)
    left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    a, b = [], []
    if len(left) and len(right):
        both = overlaps([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
        met = (den * both >= num * (n[left][:, None] + n[right][None] - both)) & (part[left][:, None] != part[right][None])
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        for i, j in zip(*np.nonzero(met), strict=True):
            p, q = find(int(part[left[i]])), find(int(part[right[j]]))
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(node[left[i]])
                b.append(node[right[j]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def compared(held: DataFrame, sets: DataFrame, num: int, den: int, block: int = 1024) -> DataFrame:
    """Links between holders of the same key in different components. held: (key, node, component, c, main); blocks of those outside the key's largest
    component meet blocks of all."""
    size = F.lit(float(block))
    minor = F.col("component") != F.col("main.component")
    rows = held.withColumns({"blocks": F.ceil(F.col("c") / size).cast("int"), "minors": F.ceil((F.col("c") - F.col("main.k")) / size).cast("int")})
    meet = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    one = rows.select("key", "node", F.lit(1).alias("role"), own("blocks").alias("x"), F.explode(meet("minors")).alias("y"))
    two = rows.filter(minor).select("key", "node", F.lit(0).alias("role"), F.explode(meet("blocks")).alias("x"), own("minors").alias("y"))
    full = one.union(two).join(sets.select("node", "component", "n", "names", "weights"), "node")
    return full.groupBy("key", "x", "y").applyInArrow(lambda t: block_links(t, num, den), "a long, b long")


def named(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"names": F.col("classes.class"), "weights": F.col("classes.w")})


def shared_keys(entries: DataFrame, salts: int) -> DataFrame:
    """Entries of keys that different components hold, with c holders of the key, main (its largest component, k holders), least (its smallest set), any (one
    of its sets) and all_more (the extensions of all holders)."""
    some = F.struct(F.xxhash64("key", "node").alias("order"), "node", "component", "n")
    cells = entries.groupBy("key", "component").agg(F.count("*").alias("k"), F.min(F.struct("n", "node", "component")).alias("least"), F.min(some).alias("any"), F.sum("more").alias("more"))
    over = cells.groupBy("key").agg(F.sum("k").alias("c"), F.max(F.struct("k", "component")).alias("main"), F.min("least").alias("least"), F.min("any").alias("any"), F.sum("more").alias("all_more"), F.count("*").alias("parts"))
    return met(entries, over.filter("parts > 1"), "key", "node", salts)


def tied(sets: DataFrame, num: int, den: int, salts: int, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """Links of sets that share a minimum hash with one of the key's holders, and components. Every round takes another holder of each key, and only keys
    that different components still hold. sets: node, n, keys, names, weights."""
    keyed, links, parts = sets.select("node", F.explode("keys").alias("key")), None, None
    for r in range(rounds):
        now = keyed.withColumn("component", F.col("node")) if parts is None else keyed.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        over = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "node", F.lit(r)).alias("order"), "node", "component")).alias("any"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        apart = met(now, over.filter("lo < hi"), "key", "node", salts).filter(F.col("component") != F.col("any.component"))
        pairs = saved(apart.select(F.col("any.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
        if r and pairs.isEmpty():
            break
        new = saved(verified(pairs, sets, num, den), "links")
        links = new if links is None else links.union(new)
        parts = components(links)
    return links, parts


def first_met(docs: DataFrame, num: int, den: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """Links of each key's holders with one of them; docs with the components that these links leave."""
    held = shared_keys(docs.mapInArrow(lambda b: extend(b, num, den, True), ENTRY_SCHEMA), salts)
    apart = (F.col("component") != F.col("any.component")) & near(F.col("n"), F.col("any.n"), num, den)
    pairs = saved(held.filter(apart).select(F.col("any.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = saved(verified(pairs, named(docs), num, den), "links")
    part = docs.select("node", "component")
    ends = links.join(part.toDF("a", "pa"), "a").join(part.toDF("b", "pb"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
    new = components(ends).select(F.col("node").alias("component"), F.col("component").alias("new"))
    return links, saved(docs.join(new, "component", "left").select("node", F.coalesce("new", "component").alias("component"), "n", "classes"), "classes")


def candidates(docs: DataFrame, num: int, den: int, rare: int, salts: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of classed() sets: pairs (a, b) to be verified and links, which hold every link between different components, up to what the links themselves connect;
    a table of each for each length of the keys."""
    entries, found, links, most = docs.mapInArrow(lambda b: extend(b, num, den, True), ENTRY_SCHEMA), [], [], ENTRY_COST
    while True:
        held = saved(shared_keys(saved(entries, "entries"), salts), "index")
        pairs = index_pairs(held.filter(F.col("c") <= rare), num, den)
        often = held.filter(F.col("c") > rare)
        tied = often.filter((F.col("acc") * den >= (F.col("n") + F.col("least.n") - F.col("acc")) * num) & (F.col("component") != F.col("least.component")))
        found.append(saved(pairs.union(tied.select(F.col("least.node").alias("a"), F.col("node").alias("b"))).distinct(), "pairs"))
        few = F.col("c") * (F.col("c") - F.col("main.k")) <= F.col("all_more") * most
        links.append(saved(compared(often.filter((F.col("all_more") > 0) & few), named(docs), num, den), "links"))
        often = often.filter(~few)
        if often.isEmpty():
            return found, links
        most *= 8
        more = often.select("key", "node", "acc", "place").join(docs, "node")
        entries = more.mapInArrow(lambda b: extend(b, num, den, False), ENTRY_SCHEMA)


def labelled(docs: DataFrame, words: int, num: int, den: int, rare: int, doc_id: str, text: str) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n, node (its set; null for an empty one), part (its component's smallest node), component_id."""
    texts, batches, total = batched(docs, doc_id, text)
    bits, width = bucket_bits(total // 6), 32

    def keys(raw: list) -> np.ndarray:
        return np.concatenate([*[token_set(t, words) for t in raw], np.zeros(0, np.uint64)])

    counts = corpus_counts(texts, batches, keys, bits, width)
    told = saved(texts.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(lambda t, back: describe(t, back, bits, width, words, num, den), SET_SCHEMA), "sets")
    known = saved(told.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("rows")), "nodes")
    # of equal sets the one with the smallest id stands for all
    mine = told.filter("held is not null").join(known, "node").filter(F.col("doc_id").eqNullSafe(F.col("smallest")))
    sets = saved(mine.select("node", "n", "keys", "held", "cuts").dropDuplicates(["node"]), "sets")
    salts = 4 + sets.count() // 10_000

    raw = sets.select("node", "n", "keys", F.col("held").alias("names"), F.transform("held", lambda _: F.lit(1).cast("long")).alias("weights"))
    links, parts = tied(raw, num, den, salts)
    now = sets.select("node", "n", "held", "cuts").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more, docs = first_met(saved(classed(now, num, den), "classes"), num, den, salts)
    pairs, others = candidates(docs, num, den, rare, salts)
    for table in [more, *[verified(p, named(docs), num, den) for p in pairs], *others]:
        links = links.union(table)
    parts = components(saved(links, "links"))
    linked = parts.join(known, "node")
    linked = linked.join(linked.groupBy("component").agg(F.min("smallest").alias("linked")), "component").select("node", "component", "linked")
    told_parts = known.filter("rows > 1").join(linked, "node", "full")
    told_parts = told_parts.select("node", F.coalesce("component", "node").alias("part"), F.coalesce("linked", "smallest").alias("component_id"))
    out = told.select("doc_id", "text_hash", "n", "node").join(told_parts, "node", "left")
    return out.select("doc_id", "text_hash", "n", "node", F.coalesce("part", "node").alias("part"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 75, den: int = 100, rare: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links with den * intersection >= num * union).

    Words are lower-cased (A-Z) runs of non-white space; a set holds the distinct shingles, the whole sequence where words are fewer. Null and empty texts
    have empty sets and link to nothing. Rows without a doc_id link like others but keep component null. Repeated rows give a row each; rows with one
    doc_id and different texts each go by their own text. Equal texts link. Other columns are ignored; an empty table gives no rows.
    """
    out = labelled(docs, words, num, den, rare, doc_id, text)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 75, den: int = 100, rare: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each group of linked texts, the pipeline's stage: that of the smallest doc_id (rows without an id come last), then of the smallest
    hash of the text; of rows that share both, the smallest by all columns. Rows without words link with nothing and stay, all of them."""
    found = labelled(docs, words, num, den, rare, doc_id, text).filter("n > 0")
    first = found.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("__kept_id"), F.col("k.text_hash").alias("__kept_hash"))
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    own = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.filter(~wordless).groupBy(F.col(doc_id).cast("long").alias("__id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__hash")).agg(F.min(own).alias("__row"))
    kept = rows.join(first, rows["__id"].eqNullSafe(first["__kept_id"]) & (rows["__hash"] == first["__kept_hash"]), "left_semi")
    return kept.select(*[F.col("__row")[c].alias(c) for c in docs.columns]).union(docs.filter(wordless))
