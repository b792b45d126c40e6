"""Benchmark decontamination by SimHash of item-sized windows.

A word is a lower-cased run of letters and digits of any script; a letter of a
script that is written without spaces (ideographs, kana, Thai and its like) is a
word of its own. A shingle is five words (all of them in an item that has fewer). For each benchmark item of L words, the
windows are the runs of L words of a document, or the whole document where it is shorter. A window's fingerprint is the
64-bit SimHash of its words; a window is a candidate of an item where the
two fingerprints differ in at most `radius` bits. A multi-index over the items has four blocks of 16 bits: of two fingerprints within the
radius, one block differs in radius / 4 bits at most (whole bits), so looking up every value that near in each
block misses none, and few others are met. Candidates are
verified exactly: weighted Jaccard similarity of the two multisets of shingles,
a shingle's weight falling with the number of items of the whole benchmark that
share it, at least `threshold`. Those numbers are counted first, by an aggregation;
only shingles of two items or more are sent to all blocks (12 bytes each), as one
of a single item weighs as much as one of none.

Two savings that lose nothing: the similarity is at most the weight of the item's shingles that the
window has over the weight of all of them, so only windows are fingerprinted where that bound reaches the threshold
for some item; and running sums over a text's words give each fingerprint
without adding its words again.

What the radius loses (a window as similar as the threshold, with fingerprints further apart) is measured by
tests against brute force on edited passages; short items differ in most bits for each word, which the radius is chosen for.

Each document is judged on its own whole text, so no key can be hot. The
benchmark is sent to the executors in blocks of at most `block_items` items and
`block_chars` characters, one pass over the documents for each block; that and
the shared shingles' counts are the bound of what is broadcast. Blocks don't
change a result.

Nulls and odd input: null or empty texts match nothing; a null item text is
left out; items with equal texts are each reported; a null doc_id is
carried along; an empty table on either side gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEED_A, WordHasher, gram_hashes, keyed, mixed, share, spans_of, stage, without

SHINGLE = 5
RADIUS = 19
BLOCK_BITS = 16
THRESHOLD = 0.8
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32_000_000
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, bits int, similarity double"


#: Scripts written without spaces between words.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"


def word_classes() -> np.ndarray:
    """For every code point: 0 outside of words, 1 a letter or digit, 2 a letter that is a word of its own."""
    out = np.zeros(0x110000, np.uint8)
    codes = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    text = "".join(map(chr, codes.tolist()))
    for kind, pattern in ((1, r"[\p{L}\p{N}]+"), (2, rf"(?:(?=\p{{L}}|\p{{N}}){UNSPACED})+")):
        for m in regex.finditer(pattern, text):
            out[codes[m.start() : m.end()]] = kind
    return out


class CodePointHasher(WordHasher):
    """Hashes of words as this module cuts them, over code points instead of bytes."""

    def __init__(self) -> None:
        super().__init__()
        self.lut = word_classes()

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, number of its text, its start, its end); offsets in the lower-cased, joined code points."""
        parts = [t.lower() for t in texts]
        data = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(data)
        self._grow(n + 1)
        kind = self.lut[data]
        edge = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start = np.flatnonzero(np.concatenate(([True], edge)) & (kind > 0))
        end = np.flatnonzero(edge & (kind[:-1] > 0)) + 1  # the last code point is a separator
        run = np.empty(n + 1, np.uint64)
        run[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=run[1:])
        h = (run[end] - run[start]) * self.inverses[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(SEED_A)
        h ^= h >> np.uint64(32)
        at = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")
        return h, at, start, end


def _planes(h: np.ndarray) -> np.ndarray:
    """64 columns of -1 and 1 for each word hash."""
    bits = np.unpackbits(np.ascontiguousarray(mixed(h)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def word_simhash(h: np.ndarray) -> np.uint64:
    return _pack(_planes(h).sum(axis=0, keepdims=True))[0]


def flips(bits: int) -> np.ndarray:
    """All block values of at most `bits` bits."""
    every = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
    return every[np.bitwise_count(every) <= bits]


class Items:
    """The benchmark's shingles, fingerprints and multi-index."""

    def __init__(self, rows: list[tuple[int, str]], radius: int, hasher: CodePointHasher | None = None, shared: tuple | None = None) -> None:
        """`shared`: what `shared_shingles` gives for the whole benchmark; without it these rows are the benchmark."""
        self.radius = radius
        self.hasher = hasher = hasher or CodePointHasher()
        self.ids, self.lengths, self.fps, self.bags = [], [], [], []
        by_gram, df = defaultdict(set), Counter()
        for item_id, text in rows:
            h = hasher.words([text])[0]
            if not len(h):
                continue
            k = len(self.ids)
            size = min(SHINGLE, len(h))
            bag = Counter(gram_hashes(h, size).tolist())
            self.ids.append(item_id)
            self.lengths.append(len(h))
            self.fps.append(word_simhash(h))
            self.bags.append(bag)
            df.update(bag.keys())
            for g in bag:
                by_gram[size, g].add(k)
        if shared is None:
            often = sorted((g, n) for g, n in df.items() if n > 1)
            shared = len(self.ids), np.array([g for g, _ in often], np.uint64), np.array([n for _, n in often], np.int32)
        self.n_items, self.often, self.often_n = shared
        self.total = [float((self.weights(np.array(list(bag), np.uint64)) * list(bag.values())).sum()) for bag in self.bags]
        self.sizes = sorted({s for s, _ in by_gram})
        self.grams, self.sieves, self.owners = {}, {}, {}
        for s in self.sizes:
            own = {g: sorted(v) for (size, g), v in by_gram.items() if size == s}
            self.owners[s] = own
            self.grams[s] = np.array(sorted(own), np.uint64)
            self.sieves[s] = np.zeros(1 << 18, bool)
            self.sieves[s][(self.grams[s] >> np.uint64(46)).astype(np.int64)] = True
        self.flips = flips(radius * BLOCK_BITS // 64)
        self.index = {}  # item's length -> for each block, its values in order and the items that have them
        by_length = defaultdict(list)
        for k, length in enumerate(self.lengths):
            by_length[length].append(k)
        for length, own in by_length.items():
            own, fps = np.array(own), np.array([self.fps[k] for k in own], np.uint64)
            self.index[length] = []
            for shift in range(0, 64, BLOCK_BITS):
                values = (fps >> np.uint64(shift)) & np.uint64((1 << BLOCK_BITS) - 1)
                order = np.argsort(values, kind="stable")
                self.index[length].append((np.uint64(shift), values[order], own[order]))

    def near(self, length: int, fps: np.ndarray) -> list[tuple[int, int, int]]:
        """(number of the window, item, differing bits) for all windows within the radius of an item of this length."""
        pairs = set()
        for shift, values, own in self.index.get(length, ()):
            for at in range(0, len(fps), 64):
                asked = (((fps[at : at + 64] >> shift) & np.uint64((1 << BLOCK_BITS) - 1))[:, None] ^ self.flips[None, :]).ravel()
                low, high = np.searchsorted(values, asked), np.searchsorted(values, asked, side="right")
                for j in np.flatnonzero(high > low).tolist():
                    pairs.update((at + j // len(self.flips), k) for k in own[low[j] : high[j]].tolist())
        out = []
        for i, k in pairs:
            bits = int(np.bitwise_count(fps[i] ^ self.fps[k]))
            if bits <= self.radius:
                out.append((i, k, bits))
        return out

    def weights(self, grams: np.ndarray) -> np.ndarray:
        """Falling with the number of the benchmark's items that hold the shingle; one that none holds weighs as much as one of a single item."""
        n = np.ones(len(grams))
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, grams), len(self.often) - 1)
            n = np.where(self.often[at] == grams, self.often_n[at], n)
        return np.log((1 + self.n_items) / n) + 1

    def similarity(self, k: int, grams: list[int]) -> float:
        """Weighted Jaccard similarity of an item's shingles and a window's, both with repeats."""
        bag, own = Counter(grams), self.bags[k]
        both = either = 0.0
        every = sorted(bag.keys() | own.keys())
        for g, w in zip(every, self.weights(np.array(every, np.uint64)).tolist()):
            both += w * min(bag[g], own[g])
            either += w * max(bag[g], own[g])
        return both / either

    def starts(self, h: np.ndarray, threshold: float) -> dict[tuple[int, int], set[int]]:
        """(item's length, window's length) -> first words of the windows whose shared shingles weigh enough for some item of that length."""
        n, hits = len(h), defaultdict(list)  # item -> (place, weight) of the shingles it shares
        for s in self.sizes:
            g = gram_hashes(h, s)
            at = np.flatnonzero(self.sieves[s][(g >> np.uint64(46)).astype(np.int64)])
            for p, v, w in zip(at.tolist(), g[at].tolist(), self.weights(g[at]).tolist()):
                for k in self.owners[s].get(v, ()):
                    hits[k].append((p, w))
        out = defaultdict(set)
        for k, own in hits.items():
            length, size = self.lengths[k], min(SHINGLE, self.lengths[k])
            window = min(length, n)
            places = np.array([p for p, _ in own])
            sums = np.concatenate(([0.0], np.cumsum([w for _, w in own])))
            low, high = np.maximum(places - (window - size), 0), np.minimum(places, n - window)  # first and last window over each
            low[1:] = np.maximum(low[1:], high[:-1] + 1)
            count = np.maximum(high - low + 1, 0)
            first = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            weight = sums[np.searchsorted(places, first + window - size, side="right")] - sums[np.searchsorted(places, first)]
            out[length, window].update(first[weight >= threshold * self.total[k] * (1 - 1e-9)].tolist())
        return out

    def search(self, h: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int, float]]:
        """(item, first word, bits, similarity) for a document's word hashes: for each item its most similar window, where the similarity can reach the threshold."""
        best = {}
        for (length, window), starts in self.starts(h, threshold).items():
            at = np.array(sorted(starts), np.int64)
            cut = np.flatnonzero(np.diff(at) > window) + 1
            for part in np.split(at, cut) if len(at) else ():  # neighbouring windows share their running sums
                for k in range(0, len(part), 4096):
                    some = part[k : k + 4096]
                    lo = int(some[0])
                    sums = np.zeros((int(some[-1]) + window - lo + 1, 64), np.int32)
                    np.cumsum(_planes(h[lo : int(some[-1]) + window]), axis=0, out=sums[1:])
                    fps = _pack(sums[some - lo + window] - sums[some - lo])
                    for i, item, bits in self.near(length, fps):
                        start = int(some[i])
                        grams = gram_hashes(h[start : start + window], min(SHINGLE, length)).tolist()
                        sim = self.similarity(item, grams)
                        if item not in best or (-sim, start) < (-best[item][2], best[item][0]):
                            best[item] = (start, bits, sim)
        return [(k, start, bits, sim) for k, (start, bits, sim) in sorted(best.items())]


def _scan(items_bc, threshold):
    def run(batches):
        items = items_bc()
        hasher = items.hasher
        for b in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):  # what a worker holds at a time
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            out = []
            for lo, hi in spans_of([len(t) for t in texts], 250_000):
                h, at, _, _ = hasher.words(texts[lo:hi])
                cuts = np.searchsorted(at, np.arange(hi - lo + 1))
                near = np.zeros(hi - lo, bool)
                for s in items.sizes:  # texts that share a shingle with an item, all of the batch at once
                    g = gram_hashes(h, s)
                    p = np.flatnonzero(items.sieves[s][(g >> np.uint64(46)).astype(np.int64)])
                    p = p[np.isin(g[p], items.grams[s])]
                    near[at[p]] = True
                for i in np.flatnonzero(near).tolist():
                    for k, start, bits, sim in items.search(h[cuts[i] : cuts[i + 1]], threshold):
                        if sim >= threshold:
                            out.append((ids[lo + i], items.ids[k], start, min(items.lengths[k], int(cuts[i + 1] - cuts[i])), bits, sim))
            names = ["doc_id", "item_id", "start_word", "n_words", "bits", "similarity"]
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(6)], names=names)

    return run


def _grams(hasher_bc):
    def run(batches):
        hasher = hasher_bc()
        for b in batches:
            for t in b.column(0).to_pylist():
                h = hasher.words([t])[0]
                if len(h):
                    own = np.unique(gram_hashes(h, min(SHINGLE, len(h)))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([None, *own.tolist()], pa.int64())], names=["gram"])

    return run


def shared_shingles(bench: DataFrame, hasher: CodePointHasher) -> tuple[int, np.ndarray, np.ndarray]:
    """(items that have a word, hashes of the shingles of two items or more in order, the number of their items) over the whole benchmark."""
    grams = bench.select("text").mapInArrow(_grams(share(bench.sparkSession, hasher)), "gram long")
    counts = stage(grams.groupBy("gram").agg(F.count("*").alias("n")), "decontam-shingles")  # a null stands for an item
    n = counts.where("gram is null").first()
    often = counts.where("gram is not null and n > 1").toArrow()
    g, k = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    at = np.argsort(g)
    return n.n if n else 0, g[at], k[at].astype(np.int32)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, bits, similarity): for each document and item the most similar window, where it reaches the threshold."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, held, chars = None, [], 0
    hasher = CodePointHasher()

    def block(held):
        bc = share(spark, Items(held, radius, hasher, shared))
        out = rows.mapInArrow(_scan(bc, threshold), SCHEMA)
        return out if found is None else found.union(out)

    bench = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    shared = shared_shingles(bench, hasher)
    for r in bench.orderBy("item_id", "text").toLocalIterator():  # one partition at a time; never the whole benchmark where it is large
        if held and (len(held) >= block_items or chars + len(r.text) > block_chars):
            found, held, chars = block(held), [], 0
        held.append((r.item_id, r.text))
        chars += len(r.text)
    return block(held)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows in which a benchmark item was found; each row is judged by its own text, whatever its id."""
    rows, key = keyed(docs, "decontam-rows")
    return without(rows, key, contaminated(rows, benchmark, key, **options).select("doc_id")).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
