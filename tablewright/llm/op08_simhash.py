"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Every pair of fingerprints at `radius` (3) or fewer differing bits is linked,
with no cap on partners. The plan:

1. one scan makes (doc_id, fingerprint); this small table is staged;
2. equal fingerprints collapse, so a group of exact copies is one node however
   large it is;
3. each distinct fingerprint goes to 16 index partitions: some 16-bit block of
   four must be equal in a linked pair, and then some 12-bit block of the four
   in the other 48 bits. That is a pigeonhole guarantee, not a sample;
4. inside a partition the members are sorted by Gray rank and a tree is built
   over them. A node holds the bits on which all of its members agree and its
   ancestors don't already; a search adds up the differences from the root and
   drops the whole group when they exceed the radius. Groups that are already
   connected to the query are passed over, so a dense group costs links, not
   pairs: what leaves a partition is a spanning forest;
5. components by alternating large-star and small-star rounds, each staged.

Nulls and odd input: a null text is an empty one (fingerprint zero, linked like
any other); rows with a null doc_id take part and get the smallest non-null
doc_id of their component, or null; repeated rows stay; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, discard, keyed, stage, without

SEED = 42
LEAF = 32
MOST_OF_A_KEY = 1_000_000  # fingerprints of an index partition that one task holds: 8 MB, and about 100 MB of tree and labels
FAN = 4


def fingerprint(data: bytes, size: int = 3) -> int:
    """64-bit SimHash of a text's word shingles; see the module's head."""
    words = data.lower().split()  # bytes: lowers A-Z and splits on ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        hashes = digest(joined, SEED)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-size].tolist()]
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())])
    n = len(hashes) // 8
    over = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(np.frombuffer(hashes[8 * at : 8 * (at + (1 << 14))], np.uint8).reshape(-1, 8), axis=1)
        over += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(over * 2 > n).tobytes(), "big")


def _fingerprints(batches):
    for b in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):  # what a worker holds at a time
        fp = np.array([fingerprint(t) for t in byte_texts(b.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order: codes next to each other in this order differ in few bits."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Tree over codes in Gray order; each node keeps the bits its members share beyond those of its ancestors."""

    def __init__(self, codes: np.ndarray) -> None:
        """codes: uint64, sorted by Gray rank."""
        self.codes = codes
        level = [(i, min(i + LEAF, len(codes)), ()) for i in range(0, len(codes), LEAF)]
        while len(level) > 1:
            level = [(level[i][0], level[min(i + FAN, len(level)) - 1][1], tuple(level[i : i + FAN])) for i in range(0, len(level), FAN)]
        self.root = self._node(level[0], np.uint64(0)) if level else None

    def _node(self, at, above: np.uint64):
        lo, hi, below = at
        part = self.codes[lo:hi]
        same = ~(np.bitwise_or.reduce(part) ^ np.bitwise_and.reduce(part))
        return lo, hi, same & ~above, part[0] & same & ~above, [self._node(x, same) for x in below]

    def search(self, queries: np.ndarray, radius: int, visit) -> None:
        """Call visit(numbers of queries, lo, hi) for each leaf that a query can't be kept out of."""
        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries), np.uint8))] if self.root else []
        while todo:
            (lo, hi, mask, pattern, below), who, far = todo.pop()
            far = far + np.bitwise_count((queries[who] ^ pattern) & mask)
            near = far <= radius
            who, far = who[near], far[near]
            if len(who):
                if below:
                    todo += [(x, who, far) for x in below]
                else:
                    visit(who, lo, hi)


def forest(codes: np.ndarray, radius: int = 3) -> list[tuple[int, int]]:
    """Links that connect what the pairs within `radius` connect, at most one for each code. codes: distinct uint64."""
    n = len(codes)
    if n == 2:
        return [(int(codes[0]), int(codes[1]))] if int(np.bitwise_count(codes[0] ^ codes[1])) <= radius else []
    codes = codes[np.argsort(gray_rank(codes))]
    label, links = np.arange(n), []
    members = {i: [i] for i in range(n)}

    def visit(who, lo, hi):
        lows = label[lo:hi]
        if (lows == lows[0]).all():  # one component already: only queries outside it matter
            who = who[label[who] != lows[0]]
        who = who[who > lo]  # each pair once
        for k in range(0, len(who), 4096):
            q = who[k : k + 4096]
            near = np.bitwise_count(codes[q][:, None] ^ codes[None, lo:hi]) <= radius
            while True:
                open_ = near & (label[q][:, None] != label[None, lo:hi])
                hit = open_.any(axis=1)
                if not hit.any():
                    break
                first = np.flatnonzero(hit)
                for i, j in zip(first.tolist(), open_[first].argmax(axis=1).tolist()):
                    a, b = int(label[q[i]]), int(label[lo + j])
                    if a != b:
                        links.append((int(codes[q[i]]), int(codes[lo + j])))
                        if len(members[a]) < len(members[b]):
                            a, b = b, a
                        gone = members.pop(b)  # the smaller side is renamed, so a code is renamed at most log2(n) times
                        label[gone] = a
                        members[a] += gone

    GrayIndex(codes).search(codes, radius, visit)
    return links


def _forests(radius):
    def run(batches):
        held_key, held = None, np.empty(0, np.uint64)

        def out(links):
            a = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], names=["a", "b"])

        for batch in batches:  # sorted by key; the last key of a batch may go on in the next
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            runs = list(zip([0, *cut.tolist()], [*cut.tolist(), len(key)]))
            links = []
            for lo, hi in runs:
                if key[lo] == held_key:
                    held = np.concatenate((held, fp[lo:hi]))
                else:
                    if len(held) > 1:
                        links += forest(held, radius)
                    held_key, held = key[lo], fp[lo:hi]
            yield out(links)
        if len(held) > 1:
            yield out(forest(held, radius))

    return run


def _parts(bits, width: int, sizes: list[int]) -> list:
    """(block, the other bits put together) for each block of a number of `width` bits, from the lowest on."""
    out, at = [], 0
    for n in sizes:
        block = F.shiftrightunsigned(bits, at).bitwiseAND((1 << n) - 1)
        low = bits.bitwiseAND((1 << at) - 1) if at else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(bits, at + n), at) if at + n < width else F.lit(0).cast("long")
        out.append((block, high.bitwiseOR(low)))
        at += n
    return out


def _keys(fp) -> list:
    """(key, the 36 bits that aren't in it) of the 16 partitions of a fingerprint; a key is the number of the two blocks, then their bits."""
    out = []
    for i, (block, rest) in enumerate(_parts(fp, 64, [16] * 4)):
        for j, (sub, left) in enumerate(_parts(rest, 48, [12] * 4)):
            out.append((F.lit((4 * i + j) << 28).cast("long") + F.shiftleft(block, 12) + sub, left))
    return out


def _crowded(keyed: DataFrame, most: int) -> DataFrame | None:
    """(key) of the partitions with more than `most` fingerprints, staged; None if there are none."""
    hot = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"), "simhash-crowded")
    return hot if hot.limit(1).count() else None


def links(distinct_fp: DataFrame, radius: int = 3, most: int = MOST_OF_A_KEY) -> DataFrame:
    """(a, b): a spanning forest, per index partition, of all pairs of fingerprints within `radius` (at most 3).

    A partition with more than `most` fingerprints is cut up by the same guarantee: of the bits that aren't in
    its key, one block of four must be equal in a linked pair; and so on, until no partition is that large.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the four-block partitions guarantee radii 0 to 3")
    rows = distinct_fp.select(F.explode(F.array(*[k for k, _ in _keys(F.col("fp"))])).alias("key"), "fp")
    # no partition has more than the 16-bit block that its key begins with; there are few such blocks to count
    blocks = distinct_fp.select(F.explode(F.array(*[F.lit(i << 16) + b for i, (b, _) in enumerate(_parts(F.col("fp"), 64, [16] * 4))])).alias("key"))
    if _crowded(blocks, most) is not None and (hot := _crowded(rows, most)) is not None:
        both = F.explode(F.array(*[F.struct(k.alias("key"), r.alias("rest")) for k, r in _keys(F.col("fp"))]))
        large = distinct_fp.select(both.alias("k"), "fp").select("k.key", "k.rest", "fp").join(hot, "key", "left_semi")
        rows, width = rows.join(hot, "key", "left_anti"), 36
        while hot is not None:
            sizes = [width // 4 + (k < width % 4) for k in range(4)]
            both = F.explode(F.array(*[F.struct(F.xxhash64("key", F.lit(p), block).alias("key"), rest.alias("rest")) for p, (block, rest) in enumerate(_parts(F.col("rest"), width, sizes))]))
            large = stage(large.select(both.alias("k"), "fp").select("k.key", "k.rest", "fp"), "simhash-large")
            width -= width // 4
            hot = _crowded(large, most) if 1 << width > most and width >= 4 else None
            rows = rows.unionByName((large if hot is None else large.join(hot, "key", "left_anti")).select("key", "fp"))
            large = large if hot is None else large.join(hot, "key", "left_semi")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_forests(radius), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of the component.

    Alternating large-star and small-star rounds: edges never multiply, and a
    round's table is staged. Neighbours are aggregated with a map-side minimum,
    and the join of a node with its minimum is one that Spark can split, so a hub
    doesn't gather its neighbours in one task.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        on = both.join(low, both.a == low.n)
        if large:
            new = on.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = on.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return new.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = stage(edges.where("a != b").distinct(), name)
    before = state(now)
    for _ in range(most_rounds):
        old, now = now, stage(star(star(now, True), False), name)
        discard(old)
        after = state(now)
        if tuple(after) == tuple(before):
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = after
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    fps = stage(fingerprints(docs, id_col, text_col), "simhash-fp")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    comp = components(links(distinct, radius), "simhash-cc")
    named = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = stage(named.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """docs with exactly one row of each near-duplicate group.

    It is the row with the smallest doc_id (a null comes last); among those, the
    smallest hash of the text and then of the whole row, so that the choice
    doesn't depend on partitions.
    """
    rows, key = keyed(docs, "simhash-rows")
    groups = near_duplicates(rows, key, text_col, radius).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    hashed = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    order = rows.select(F.col(key).alias("own"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.xxhash64(*hashed).alias("rh"))
    members = stage(groups.join(order, F.col("row") == F.col("own")).select("group", F.struct(F.col("id").isNull().alias("none"), "id", "th", "rh", "row").alias("m")), "simhash-members")
    kept = members.groupBy("group").agg(F.min("m").alias("m")).select("m.row")
    gone = members.select("m.row").join(kept, "row", "left_anti")
    return without(rows, key, gone).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
