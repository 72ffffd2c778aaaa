"""Near copies by SimHash, verified and completed by the exact Jaccard similarity of five-word shingle sets.

Two texts are near copies when their sets share at least ``SIMILARITY`` of their union.  The SimHash
method of ``simhash`` comes first: 64-bit fingerprints of the sets, one-wildcard variants, candidates
within ``RADIUS`` bits, each verified by the sets.  That links what differs little, groups of thousands
included, but near copies of that similarity differ by 8 bits on average, so fingerprints alone lose
most of them.  An exact join finds the rest; pairs that are connected already need no comparison:

1. Prefixes: in any fixed order of all shingles, two sets of that similarity share one of the first
   ``n - ceil(0.8 n) + 1`` shingles of either.  The order begins with shingles of rare words and ends with
   those that are frequent themselves, both by a sample of the documents.  Shingles that more than
   ``CROWD`` prefixes hold all the same (a passage that the sample missed) are then moved behind the rare ones by their exact
   counts, and the texts whose prefix held one get a new one.  The order moves cost only, never a result.
2. Parities: a bit for each bucket of shingles, set if the bucket holds an odd number.  Two sets
   differ in at least as many shingles as in bits, and near copies in a ninth of their sizes at most.
3. What remains is compared by the sets themselves.

A prefix shingle of more than ``SMALL`` sets doesn't emit pairs: its sets are dealt in pairs of
blocks and linked to spanning forests, as fingerprints are in ``simhash``.

Defined cases: words are those of ``simhash`` (ASCII lower case); a text of fewer words than a
shingle is one shingle; null and empty texts are copies of each other; rows are told apart by id and
text, so a null or reused id never decides for another text.  Of each component stays the row of
smallest id (an id before none), and of rows equal in id and text one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, bitmap, discard, materialize, sliced, small_side, tested, text_of, without_rows
from .simhash import _LOWER, _WORD, SEED, candidate_links, components
from .windows import BASE, mix

SHINGLE = 5
#: The similarity as a fraction: 4 of 5.
NUM, DEN = 4, 5
#: Bits by which candidates of the fingerprints may differ, the most that three segments cover.
RADIUS = 5
SMALL = 64
BLOCK = 1024
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
SAMPLE = 20_000
MAX_FREQUENT = 500_000
MAX_WORDS = 100_000
#: A shingle of more prefixes is moved back in the order, in so many rounds at most.
CROWD = 16
ROUNDS = 2
MAX_BROADCAST_ROWS = 1_000_000


def word_hashes(text: bytes) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in _WORD.findall(text.translate(_LOWER))], np.uint64)


def shingle_hashes(w: np.ndarray) -> np.ndarray:
    """The hash of each shingle of words of these hashes."""
    if not len(w):
        return w
    last = max(len(w) - SHINGLE + 1, 1)
    h = np.zeros(last, np.uint64)
    for k in range(min(SHINGLE, len(w))):
        h = mix(h * np.uint64(BASE) + w[k : k + last])
    return h


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(word_hashes(text)))


def parities(sh: np.ndarray) -> bytes:
    """A bit for each of so many buckets as the set has shingles, rounded up to a power of two, 256 at least."""
    size = max(256, 1 << max(len(sh) - 1, 0).bit_length())
    odd = np.bincount((sh & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def set_print(sh: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(sh), CHUNK):
        ones += np.unpackbits(sh[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(sh), bitorder="little").tobytes(), "little")


def _may_be_near(p: bytes, q: bytes, total: int) -> bool:
    """Can sets of ``total`` shingles together and these parities be near?  Longer parities fold to shorter ones."""
    x, y = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return (DEN + NUM) * int(np.bitwise_count(x ^ y).sum()) <= (DEN - NUM) * total


def row_key() -> Column:
    """A row by its id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_of("text"))


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.astype(np.uint64).view(np.int64))


class Order:
    """An order of all shingles: by the frequency of their words (``words`` with ``counts``), then those of ``crowded``, then those of ``late``, rarest first."""

    def __init__(self, late: np.ndarray, words: np.ndarray, counts: np.ndarray, crowded: np.ndarray | None = None):
        self.given = late, words, counts
        self.crowded = late[:0] if crowded is None else crowded
        last = np.concatenate((self.crowded, late))
        self.rank = np.argsort(last)
        self.late = last[self.rank]
        place = np.argsort(words)
        self.words, self.weight = words[place], np.round(16 * np.log2(counts[place])).astype(np.int64)

    def later(self, more: np.ndarray) -> Order:
        """With the shingles ``more``, of which it holds none among the last, between ``crowded`` and ``late``: a prefix without any of them stays as it is."""
        return Order(*self.given, np.concatenate((self.crowded, more)))

    def prefix(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct shingles of words of these hashes, and the first of them by this order that any near set must meet."""
        sh, at = np.unique(shingle_hashes(w), return_index=True)
        n, key = len(sh), np.zeros(len(sh), np.int64)
        if n and len(self.words):
            place = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
            weight = np.where(self.words[place] == w, self.weight[place], 0)
            for k in range(min(SHINGLE, len(w))):
                key += weight[at + k]
        if n and len(self.late):
            place = np.minimum(np.searchsorted(self.late, sh), len(self.late) - 1)
            key = np.where(self.late[place] == sh, (1 << 32) + self.rank[place], key)
        return sh, sh[np.argsort(key, kind="stable")[: n - -(-NUM * n // DEN) + 1]]


def order_of(docs: DataFrame) -> Order:
    """The order by the shingles and words that a sample of the documents holds three times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            held = []
            for t in b.column(0):
                w = word_hashes(t.as_py())
                sh = np.unique(shingle_hashes(w))
                held.append(np.unique(w))
                yield pa.RecordBatch.from_arrays([_signed(sh), pa.array(np.ones(len(sh), np.int64)), pa.array(np.zeros(len(sh), bool))], ["h", "n", "word"])
            if held:
                w, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(w), pa.array(n.astype(np.int64)), pa.array(np.ones(len(w), bool))], ["h", "n", "word"])

    n = docs.count()
    step = max(n // SAMPLE, 1)
    some = docs.where(F.pmod(row_key(), F.lit(step)) == 0).select(text_of("text").cast("binary").alias("text")).distinct()
    counts = materialize(some.mapInArrow(run, "h long, n long, word boolean").groupBy("word", "h").agg(F.sum("n").alias("n")).where("n > 2"), "overlap-order")
    top = lambda word, most: counts.where(F.col("word") == word).orderBy(F.desc("n"), "h").limit(most).toArrow()
    late, words = top(False, MAX_FREQUENT), top(True, MAX_WORDS)
    discard(counts)
    hashes = lambda t: t["h"].to_numpy().view(np.uint64)
    return Order(hashes(late)[::-1], hashes(words), words["n"].to_numpy())


def sets_of(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """(row, id, node, n, fp, parity, prefix) for each row of ``docs``; ``node`` is a hash of the whole set, ``fp`` its SimHash."""
    known = docs.sparkSession.sparkContext.broadcast(order or order_of(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        order = known.value
        for b in sliced(batches):
            node, size, prints, parity, prefix = [], [], [], [], []
            for t in b.column(2):
                sh, first = order.prefix(word_hashes(t.as_py()))
                node.append(xxhash.xxh64_intdigest(sh.tobytes(), SEED))
                size.append(len(sh))
                prints.append(set_print(sh))
                parity.append(parities(sh))
                prefix.append(first.view(np.int64))
            arrays = [b.column(0), b.column(1), _signed(np.array(node, np.uint64)), pa.array(size, pa.int32()), _signed(np.array(prints, np.uint64)), pa.array(parity, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "node", "n", "fp", "parity", "prefix"])

    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("id"), text_of("text").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, "row long, id long, node long, n int, fp long, parity binary, prefix array<long>"), "overlap-rows")


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row of ``rows`` (as from ``sets_of``) for each set, the empty one left out; only rows of sets that a bitmap of the repeated ones marks are shuffled."""
    sets = rows.where("n > 0").drop("id")
    repeated = sets.groupBy("node").agg(F.count("*").alias("times")).where("times > 1")
    maps = bitmap(repeated, "node")
    maybe, once = tested(sets, "node", maps)
    one = maybe.groupBy("node").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "fp", "parity", "prefix")])
    nodes = materialize(once.unionByName(one), "overlap-nodes")
    discard(maps)
    return nodes


def spread(docs: DataFrame, nodes: DataFrame, order: Order) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with prefixes by an order that puts crowded shingles last, and (key, m): the shingles that several prefixes hold; tables, ``nodes`` goes."""
    spark = docs.sparkSession
    for left in range(ROUNDS, -1, -1):
        counts = nodes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        shared = materialize(counts, "overlap-keys")
        top = shared.where(F.col("m") > CROWD).orderBy(F.desc("m"), "key").limit(MAX_FREQUENT).toArrow() if left else None
        more = top["key"].to_numpy().view(np.uint64)[::-1] if left else np.empty(0, np.uint64)
        more = more[~np.isin(more, order.late)]
        if not len(more):
            return nodes, shared
        order = order.later(more)
        keys = materialize(spark.createDataFrame(pa.table({"key": _signed(more)})), "overlap-crowded")
        touched = materialize(met(nodes.select("node", "row", F.explode("prefix").alias("key")), keys, "key").select("node", "row").distinct(), "overlap-touched")
        moved = materialize(_prefixes(docs, touched, order), "overlap-moved")
        maps = bitmap(moved, "node")
        maybe, same = tested(nodes, "node", maps)
        again = maybe.join(moved.withColumnRenamed("prefix", "new"), "node", "left").withColumn("prefix", F.coalesce("new", "prefix")).drop("new")
        before, nodes = nodes, materialize(same.unionByName(again), "overlap-nodes")
        discard(before, shared, keys, touched, moved, maps)
    raise AssertionError("the last round returns")


def _prefixes(docs: DataFrame, wanted: DataFrame, order: Order) -> DataFrame:
    """(node, prefix) of the (materialised) ``wanted`` (node, row) by ``order``."""
    known = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            prefix = [known.value.prefix(word_hashes(t.as_py()))[1].view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prefix, pa.list_(pa.int64()))], ["node", "prefix"])

    texts = docs.select(row_key().alias("row"), text_of("text").cast("binary").alias("text"))
    return met(texts, wanted, "row").select("node", "text").mapInArrow(run, "node long, prefix array<long>").dropDuplicates(["node"])


def _sieved(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of (a, b, n, p, q) whose parities allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ok = [_may_be_near(p, q, n) for n, p, q in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _near(root: np.ndarray, values: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(root, values), len(root) - 1)
    both = np.bincount(owner[root[at] == values], minlength=len(sizes))
    return DEN * both >= NUM * (sizes + len(root) - both)


def forest(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what near pairs of ``sets`` connect."""
    left, edges = np.arange(len(sets)), []
    sizes = np.array([len(s) for s in sets])
    while len(left) > 1:
        root, left = left[0], left[1:]
        edge = [root]
        while edge and len(left):
            now = edge.pop()
            near = _near(sets[now], np.concatenate([sets[i] for i in left]), np.repeat(np.arange(len(left)), sizes[left]), sizes[left])
            found, left = left[near], left[~near]
            edges += [(nodes[root], nodes[i]) for i in found]
            edge += found.tolist()
    return edges


def _forests(rows: DataFrame) -> DataFrame:
    """Edges of the groups (key, x, y) of ``rows`` (key, x, y, node, sh)."""

    def out(group: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        edges = forest([n for n, _ in group], [s for _, s in group])
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for b in sliced(batches):
            for k, x, y, n, s in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                if (k, x, y) != key:
                    if len(group) > 1:
                        yield out(group)
                    key, group = (k, x, y), []
                group.append((n, np.sort(s.values.to_numpy().view(np.uint64))))
        if len(group) > 1:
            yield out(group)

    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long")


def met(rows: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """``rows`` joined with the (materialised) ``side`` by ``column``; beyond the bound only rows that a bitmap marks are shuffled."""
    if side.count() <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(side), column)
    return tested(rows, column, bitmap(side, column))[0].join(side, column)


def sets_for(docs: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    """(node, sh): the shingles of the (materialised) ``wanted`` (node, row)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], ["node", "sh"])

    texts = docs.select(row_key().alias("row"), text_of("text").cast("binary").alias("text"))
    texts = met(texts, wanted, "row")
    return materialize(texts.select("node", "text").dropDuplicates(["node"]).mapInArrow(sets, "node long, sh array<long>"), label)


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The near ones of ``pairs`` (a, b), by the sets in ``found``."""
    compared = pairs.join(found.select(F.col("node").alias("a"), F.col("sh").alias("s")), "a").join(found.select(F.col("node").alias("b"), F.col("sh").alias("t")), "b")
    inter = F.size(F.array_intersect("s", "t"))
    return compared.where(DEN * inter >= NUM * (F.size("s") + F.size("t") - inter)).select("a", "b")


def _wanted(nodes: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return materialize(nodes.join(ends, "node", "left_semi").select("node", "row"), label)


def fingerprint_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between near copies that the SimHash method proposes, a table."""
    near = materialize(candidate_links(nodes.select("node", "fp"), RADIUS), "overlap-alike")
    wanted = _wanted(nodes, near, "overlap-alike-wanted")
    found = sets_for(docs, wanted, "overlap-alike-sets")
    edges = materialize(verified(near, found), "overlap-alike-edges")
    discard(near, wanted, found)
    return edges


def links(docs: DataFrame, nodes: DataFrame, order: Order) -> DataFrame:
    """Edges (a, b) between nodes with the components of all near pairs; ``nodes`` as from ``nodes_of`` with prefixes by ``order``, deleted at the end."""
    alike = fingerprint_links(docs, nodes)
    joined = components(alike)

    nodes, shared = spread(docs, nodes, order)
    keyed = nodes.select("node", "n", F.explode("prefix").alias("key"))
    held = materialize(met(keyed, shared, "key"), "overlap-shared")

    one = held.where(F.col("m") <= SMALL)
    other = one.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"))
    fits = (F.col("a") < F.col("b")) & (DEN * F.least("n", "n_b") >= NUM * F.greatest("n", "n_b"))
    pairs = materialize(one.withColumnRenamed("node", "a").join(other, "key").where(fits).select("a", "b").distinct(), "overlap-pairs")
    rooted = nodes.select("node", "n", "parity").join(small_side(joined, MAX_BROADCAST_ROWS), "node", "left").withColumn("root", F.coalesce("root", "node"))
    side = lambda c, p: rooted.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("root").alias(f"root_{c}"), F.col("parity").alias(p))
    both = pairs.join(side("a", "p"), "a").join(side("b", "q"), "b").where("root_a <> root_b")  # the others are connected
    proposed, pairs = pairs, materialize(_sieved(both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "p", "q")), "overlap-sieved")
    discard(proposed)

    large = held.where(F.col("m") > SMALL)
    wanted = _wanted(nodes, pairs.union(large.select(F.col("node").alias("a"), F.col("node").alias("b"))), "overlap-wanted")
    found = sets_for(docs, wanted, "overlap-sets")
    near = verified(pairs, found)

    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    dealt = large.select("key", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("mine"))
    dealt = dealt.select("key", "node", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "node")
    forests = _forests(dealt.join(found, "node").select("key", "x", "y", "node", "sh"))
    edges = materialize(alike.union(near).union(forests).distinct(), "overlap-edges")
    discard(nodes, shared, held, pairs, wanted, found, alike)
    return edges


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of near copies; columns unchanged."""
    order = order_of(docs)
    sets = sets_of(docs, order)
    rows, nodes = materialize(sets.select("row", "id", "node"), "overlap-ids"), nodes_of(sets)
    discard(sets)
    roots = components(links(docs, nodes, order)).select("node", "root")
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named.groupBy("root", "row").agg(F.min("id").alias("id"), F.count("*").alias("times")), "overlap-named")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")).select(F.col("m.row").alias("row"))
    first = materialize(first, "overlap-first")
    gone = materialize(named.select("row").join(first, "row", "left_anti"), "overlap-gone")
    again = materialize(named.where("times > 1").select("row").join(first, "row", "left_semi"), "overlap-again")
    return without_rows(docs, [row_key()], gone, again, MAX_BROADCAST_ROWS)
