"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel counts the common subsequences of `order` characters of two short
strings, each damped by `decay` for every character it spans, so gaps and
inserted characters lower a likeness without ending it; it is scaled to 1 for
equal strings. The strings are units: the words of a sentence, lower-cased, with
the signs inside taken out (`i.d-i*o t` is one unit, as are letters spelt out
with spaces).

Training is on labelled sentences, each a bag of units: those of the toxic documents of a bounded sample are positive, those of
the clean ones negative. A machine f on units makes one on sentences, f(S) = the largest f of its units: a
sentence is toxic if one of its units is (a multiple-instance support vector machine). For a negative sentence that
asks all units to be below the margin, so its units are examples themselves. For a positive sentence it
asks one of them, its witness, to be above: first the unit of best odds, then the one of largest f, round by
round until no witness changes. Since a document's label says little about each of its sentences, a
positive sentence none of whose units speaks for toxicity by its odds has no witness.
Landmarks of the toxic side with a character put in are examples too. The machine is solved by working sets: it starts with the clean units most like the landmarks,
and with evenly spaced ones, and clean units that are over the margin by more than SLACK join, JOIN in a round, until there are none.
Landmarks are the units most typical of either label; kernel values against them, whitened
by the inverse root of the landmarks' own kernel matrix, are the Nystrom features. A document's amount is what its different
notable units have above the floor, divided by the root of its length; isotonic regression on the sample makes it a score.

Scoring: the distinct units of all documents are gathered once (a set per batch,
then a distinct) and each distinct unit meets the landmarks once; those above `floor` are notable. A filter of
fixed size (FILTER_BITS bits) with their hashes is all that is broadcast. A second pass over the texts
keeps, for each document, its length and its different units that pass the filter; these few meet the
notable units by a join, whose amounts are added up for each document. Nothing else goes through the driver, and a filter that
fills up costs time, not results. Whole texts are read; no key can be hot, as amounts are aggregated before they meet their documents.

Bounds, all of the fit and none of scoring: `sample_rows` labelled rows; LANDMARKS units of the toxic side and half as many of the clean one;
SLACK of the margin, and ROUNDS of choosing witnesses. LIKEST, SPREAD and JOIN only say in which order clean units join.

Nulls and odd input: a null or empty text has the score of a text without a
notable unit; null labels are left out; without labels of both kinds every
score is 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, crc_mod, share, stage
from .op04_quality import sample

ORDER, DECAY = 3, 0.6
LANDMARKS = 64  # of toxic units; half as many of clean ones
SAMPLE_ROWS = 4000
COST = 20.0
POWER = 3  # of the scaled kernel; a power of a kernel is one, and a higher power is more local
FILTER_BITS, BLOCK_UNITS = 1 << 26, 500_000
POSITIVE, INSERTED = 4.0, 0.3  # weights of witnesses and of variants, against 1 of a clean unit
LIKEST, SPREAD = 3000, 2000  # clean units to begin with: those most like the toxic landmarks, and evenly spaced ones
JOIN = 3000  # clean units that join in a round
SLACK = 0.2  # by which a clean unit may be over the margin (-1) without joining
ROUNDS = 2  # of choosing witnesses
FLOOR = -0.6
THRESHOLD = 0.7
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPELT = re.compile(rb"(?<!\S)(?:[a-z0-9] ){2,}[a-z0-9](?!\S)")
_PIECE, _STEP = 24, 12


def units(data: bytes) -> list[bytes]:
    """Units of a text or sentence, in UTF-8, with repeats."""
    data = data.lower() if data.isascii() else data.decode("utf-8", "replace").lower().encode()
    bare = data.translate(None, _SIGNS)
    out = bare.split()
    spelt = _SPELT.findall(bare)
    return out + [s.replace(b" ", b"") for s in spelt] if spelt else out


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of rows of a (n, la) against b (n or 1, k, lb): (n, k)."""
    n, la = a.shape
    k, lb = b.shape[1], b.shape[2]
    d, d2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    prefix = [np.ones((lb + 1, n, k), np.float32)] + [np.zeros((lb + 1, n, k), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros((n, k), np.float32)
    for i in range(la):
        same = [(a[:, i, None] == b[:, :, j]) * d2 for j in range(lb)]
        for j in range(lb):
            total += same[j] * prefix[-1][j]
        for o in range(ORDER - 1, 0, -1):
            run = np.zeros((n, k), np.float32)
            for j in range(lb):
                run *= d
                run += same[j] * prefix[o - 1][j]
                prefix[o][j + 1] *= d
                prefix[o][j + 1] += run
    return total


def _by_length(strings: list[str]):
    """(places, code array) for the strings of each length."""
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        groups.setdefault(len(s), []).append(i)
    for length, places in groups.items():
        if length >= ORDER:
            codes = np.frombuffer("".join(strings[i] for i in places).encode("utf-32-le", "replace"), np.uint32)
            codes = codes.reshape(len(places), length).astype(np.int32)
            yield np.array(places), np.column_stack((np.full(len(places), 2, np.int32), codes))  # 2 marks the start


class Landmarks:
    """Scaled kernel values of strings against fixed landmark strings."""

    def __init__(self, strings: list[str]) -> None:
        self.strings = strings
        self.blocks = []
        for places, codes in _by_length(strings):
            self.blocks.append((places, codes[None], np.sqrt(_kernel(codes, codes[:, None, :])[:, 0])))

    def __call__(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(self.strings)), np.float32)
        for places, codes in _by_length(strings):
            for at in range(0, len(places), 512):
                some, who = codes[at : at + 512], places[at : at + 512]
                own = np.sqrt(_kernel(some, some[:, None, :])[:, 0])
                for marks, b, norm in self.blocks:
                    out[who[:, None], marks[None, :]] = (_kernel(some, b) / (own[:, None] * norm[None, :])) ** POWER
        return out


def svm(x: np.ndarray, y: np.ndarray, top: np.ndarray, alpha: np.ndarray | None = None, rounds: int = 40, tolerance: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """(weights, duals) of a linear support vector machine (hinge loss, costs `top`) by dual coordinate descent from `alpha` on; the last weight is the intercept."""
    z = np.column_stack((x, np.ones(len(x)))).astype(np.float64)
    alpha = np.zeros(len(z)) if alpha is None else alpha.copy()
    q, w = (z * z).sum(axis=1), (alpha * y) @ z
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        gradient = y * (z @ w) - 1
        off = np.where(alpha <= 0, np.minimum(gradient, 0), np.where(alpha >= top, np.maximum(gradient, 0), gradient))
        live = np.flatnonzero(np.abs(off) > tolerance)
        if not len(live):
            break
        live = np.flatnonzero((gradient < 0.1) | (alpha > 0))
        for i in rng.permutation(live).tolist():
            new = min(max(alpha[i] - (y[i] * (z[i] @ w) - 1) / q[i], 0.0), top[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * z[i]
                alpha[i] = new
    return w, alpha


def working_set_svm(plus: np.ndarray, top: np.ndarray, minus: np.ndarray, first: np.ndarray, join: int = JOIN, slack: float = SLACK) -> np.ndarray:
    """Weights (the last is the intercept) of the machine with all of `plus` (costs `top`) and all of `minus` (the cost of one weight): rows of `minus` that are over the margin by more than `slack` join the ones at places `first`, the worst `join` of them in a round, until there are none."""
    chosen, alpha = np.unique(first), None
    held = np.zeros(len(minus), bool)
    held[chosen] = True
    while True:
        y = np.concatenate((np.ones(len(plus)), -np.ones(len(chosen))))
        w, alpha = svm(np.concatenate((plus, minus[chosen])), y, np.concatenate((top, np.full(len(chosen), COST))), alpha)
        margin = minus @ w[:-1].astype(minus.dtype) + w[-1]
        wrong = np.flatnonzero((margin > -1 + slack) & ~held)
        if not len(wrong):
            return w
        more = wrong[np.argsort(-margin[wrong], kind="stable")[:join]]
        held[more] = True
        chosen, alpha = np.concatenate((chosen, more)), np.concatenate((alpha, np.zeros(len(more))))


def variants(unit: str) -> list[str]:
    """The unit with one character put in."""
    return [unit[:i] + c + unit[i:] for i in range(1, len(unit)) for c in "xe"]


class Model:
    def __init__(self, texts: list[str], labels: list[int]) -> None:
        self.marks, self.weights, self.bias, self.curve, self.floor = Landmarks([]), np.zeros(0, np.float32), -1.0, [(0.0, 0.0)], FLOOR
        y = np.array(labels)
        if not (y == 1).any() or not (y == 0).any():
            return
        number: dict[bytes, int] = {}
        split = re.compile(r"[.!?\n]+")
        # support is counted over different sentences: a copied document speaks once
        apart: list[set[tuple[int, ...]]] = [set(), set()]
        bags = []
        for t, v in zip(texts, labels):
            bag: set[int] = set()
            for sentence in split.split(t):
                own = {number.setdefault(u, len(number)) for u in units(sentence.encode())}
                if own:
                    apart[int(v == 1)].add(tuple(sorted(own)))
                    bag |= own
            bags.append(np.fromiter(bag, np.int32, len(bag)) if v == 1 else None)
        names = [u.decode("utf-8", "replace") for u in number]
        del number
        seen = np.zeros((2, len(names)), np.int64)
        for k in (0, 1):
            for own in apart[k]:
                seen[k, list(own)] += 1
        n = [len(a) for a in apart]
        usable = np.array([ORDER <= len(u) <= _PIECE for u in names])
        odds = np.log((seen[1] + 0.1) / (n[1] + 1)) - np.log((seen[0] + 0.1) / (n[0] + 1))
        typical = np.where((seen[1] < 2) | ~usable | (odds <= np.log(4)), 0.0, odds)
        bad = [names[i] for i in self._cover([set(b[typical[b] > 0].tolist()) for b in bags if b is not None], typical)]
        del bags
        if not bad:
            return
        taken = set(bad)
        common = [names[i] for i in np.lexsort((np.arange(len(names)), -seen[0] * usable))[: LANDMARKS // 2 + len(bad)].tolist() if usable[i] and names[i] not in taken][: LANDMARKS // 2]
        self.marks = Landmarks(bad + common)
        value, vector = np.linalg.eigh(self.marks(bad + common).astype(np.float64))
        root = (vector @ np.diag(1 / np.sqrt(np.maximum(value, 2e-3))) @ vector.T).astype(np.float32)
        where = np.flatnonzero(usable)
        pool = [names[i] for i in where.tolist()]
        x, like = np.empty((len(pool), len(bad) + len(common)), np.float32), np.empty(len(pool), np.float32)
        for at in range(0, len(pool), 20_000):
            k = self.marks(pool[at : at + 20_000])
            x[at : at + 20_000], like[at : at + 20_000] = k @ root, k[:, : len(bad)].max(axis=1)
        place = np.full(len(names), -1, np.int64)
        place[where] = np.arange(len(where))
        # units that can be witnesses: they speak for toxicity by their odds, with some support
        speaks = ((typical * np.sqrt(seen[1]) > 4.0) & (seen[1] * n[0] >= 8 * seen[0] * n[1]))[where]
        said = (typical * np.sqrt(seen[1]))[where]
        candidates = [own for own in ([i for i in place[list(s)].tolist() if i >= 0 and speaks[i]] for s in sorted(apart[1])) if own]
        clean = (seen[0] * n[1] > seen[1] * n[0])[where]
        del apart
        minus = np.flatnonzero(clean)
        first = np.unique(np.concatenate((np.argsort(-like[minus], kind="stable")[:LIKEST], np.arange(0, len(minus), max(1, len(minus) // SPREAD)))))
        wider = sorted({v for u in bad for v in variants(u)} - set(names))
        x_wider = self.marks(wider) @ root
        witness: set[int] = set()
        for _ in range(ROUNDS):
            new = {max(own, key=lambda i: (said[i], -i)) for own in candidates}
            if not new or new == witness:
                break
            witness = new
            plus = np.array(sorted(witness), np.int64)
            rows = np.concatenate((x[plus], x_wider))
            apart_from = minus[~np.isin(minus, plus)]
            w = working_set_svm(rows, np.concatenate((np.full(len(plus), COST * POSITIVE), np.full(len(wider), COST * INSERTED))), x[apart_from], np.searchsorted(apart_from, np.setdiff1d(minus[first], plus)))
            said = x @ w[:-1].astype(np.float32) + w[-1]  # a sentence's next witness is the unit of largest margin
        if not witness:
            return
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), float(w[-1])
        del x
        # the amounts that the curve is fitted to are counted as in scoring: over all units, long ones by their pieces
        margin = np.full(len(names), -np.inf)
        margin[where] = said
        long = [i for i, u in enumerate(names) if len(u) > _PIECE]
        for at in range(0, len(long), 5000):
            margin[long[at : at + 5000]] = self.margins([names[i] for i in long[at : at + 5000]])
        named = {names[i].encode(): float(margin[i]) for i in np.flatnonzero(margin > self.floor).tolist()}
        amounts = [self.amount(named.keys() & own, named, len(own)) for own in (units(t.encode()) for t in texts)]
        self.curve = self._monotone(np.array(amounts), y)

    def amount(self, own: set[bytes], notable: dict[bytes, float], n_units: int) -> float:
        """What the different notable units of a text add up to above the floor, against the root of its length."""
        return sum(notable[u] - self.floor for u in sorted(own)) / (n_units + 30) ** 0.5

    @staticmethod
    def _cover(bags: list[set[int]], odds: np.ndarray) -> list[int]:
        """Units that speak for as many toxic documents as can be: each choice leaves the documents it is in with less to say."""
        inside: dict[int, list[int]] = {}
        for d, b in enumerate(bags):
            for u in b:
                inside.setdefault(u, []).append(d)
        rest, out = np.ones(len(bags)), []
        left = {u: odds[u] * rest[d].sum() for u, d in inside.items() if len(d) > 1}
        while left and len(out) < LANDMARKS:
            best = min(left, key=lambda u: (-left[u], u))
            if left[best] < 1.0:
                break
            out.append(best)
            del left[best]
            rest[inside[best]] *= 0.5
            left = {u: odds[u] * rest[inside[u]].sum() for u in left}
        return out

    @staticmethod
    def _monotone(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
        """Isotonic regression of the labels on the margin, as corner points of a rising line."""
        blocks: list[tuple[float, ...]] = []  # rows, positive rows, smallest and largest margin
        for i in np.argsort(x, kind="stable").tolist():
            blocks.append((1.0, float(y[i]), float(x[i]), float(x[i])))
            while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]):
                n, k, _, top = blocks.pop()
                m, j, low, _ = blocks.pop()
                blocks.append((m + n, j + k, low, top))
        return [(at, (k + 0.1) / (n + 0.2)) for n, k, low, top in blocks for at in dict.fromkeys((low, top))]

    def margins(self, strings: list[str]) -> np.ndarray:
        """Margin of each unit; a long unit has the largest of its overlapping pieces."""
        if not len(self.weights):
            return np.full(len(strings), self.bias)
        pieces, owner = [], []
        for i, s in enumerate(strings):
            parts = [s] if len(s) <= _PIECE else [s[a : a + _PIECE] for a in range(0, len(s) - _STEP, _STEP)]
            pieces += parts
            owner += [i] * len(parts)
        out = np.full(len(strings), -np.inf)
        np.maximum.at(out, np.array(owner, np.int64), self.marks(pieces) @ self.weights + self.bias)
        return out


def _gather(batches):
    held: set[bytes] = set()

    def out():
        return pa.RecordBatch.from_arrays([pa.array([u.decode("utf-8", "replace") for u in held], pa.string())], names=["unit"])

    for b in batches:
        for t in byte_texts(b.column(0)):
            held.update(units(t))
            if len(held) > 400_000:
                yield out()
                held.clear()
    yield out()


def _margins(shared):
    def run(batches):
        model = shared()
        for b in batches:
            strings = b.column(0).to_pylist()
            m = model.margins(strings)
            keep = m > model.floor
            yield pa.RecordBatch.from_arrays([pa.array([s for s, k in zip(strings, keep) if k], pa.string()), pa.array(m[keep], pa.float64())], names=["unit", "margin"])

    return run


_CHUNK_BITS = 1 << 16


def _slots(batches):
    """Bits of one chunk after the other, from (chunk, bit) rows sorted by chunk."""
    now, bits = None, np.zeros(_CHUNK_BITS, bool)
    names = ["chunk", "bits"]

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=names)

    for b in batches:
        chunk, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
        for c in np.unique(chunk).tolist():
            if now is not None and c != now:
                yield out()
                bits[:] = False
            now = c
            bits[bit[chunk == c]] = True
    if now is not None:
        yield out()


def hash_filter(notable: DataFrame, bits: int) -> np.ndarray:
    """A table of `bits` places, true where the hash of a notable unit falls: at most bits / 8 bytes on the driver, whatever the corpus."""
    slot = F.pmod(F.xxhash64("unit"), F.lit(bits))
    rows = notable.select((slot / _CHUNK_BITS).cast("int").alias("chunk"), F.pmod(slot, F.lit(_CHUNK_BITS)).cast("int").alias("bit")).distinct()
    out = np.zeros(bits, bool)
    for r in rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_slots, "chunk int, bits binary").toLocalIterator():
        out[r.chunk * _CHUNK_BITS : (r.chunk + 1) * _CHUNK_BITS] |= np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)[: bits - r.chunk * _CHUNK_BITS]
    return np.packbits(out)


def _candidates(filter_, bits: int, block_units: int):
    def run(batches):
        import xxhash

        table, digest, known = np.unpackbits(filter_()).astype(bool), xxhash.xxh64_intdigest, {}
        for b in batches:
            sizes, found = [], []
            for t in byte_texts(b.column(0)):
                own = units(t)
                some = []
                for u in set(own):
                    hit = known.get(u)
                    if hit is None:
                        h = digest(u, 42)  # as Spark's xxhash64
                        hit = known[u] = bool(table[(h - (h >> 63 << 64)) % bits])
                    if hit:
                        some.append(u.decode("utf-8", "replace"))
                sizes.append(len(own))
                found.append(some)
                if len(known) > block_units:
                    known = {}
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "held_out", "n_units", "some"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out=None, filter_bits: int = FILTER_BITS, block_units: int = BLOCK_UNITS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. A task remembers what the filter says of at most about block_units units at a time."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("text")
    distinct = docs.select(text).mapInArrow(_gather, "unit string").distinct()
    notable = stage(distinct.mapInArrow(_margins(share(spark, model)), "unit string, margin double"), "toxicity-units")
    rows = docs.select(text, F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    met = rows.mapInArrow(_candidates(share(spark, hash_filter(notable, filter_bits)), filter_bits, block_units), "doc_id long, held_out boolean, n_units long, some array<string>")
    met = stage(met.withColumn("row", F.monotonically_increasing_id()), "toxicity-candidates")
    added = met.select("row", F.explode("some").alias("unit")).join(notable, "unit").groupBy("row").agg(F.sum(F.col("margin") - model.floor).alias("above"))
    amount = F.coalesce("above", F.lit(0.0)) / F.sqrt(F.col("n_units") + 30)
    rows = met.select("row", "doc_id", "held_out", "n_units").join(added, "row", "left").select("doc_id", "held_out", amount.alias("amount"))
    m, first, last = F.col("amount"), model.curve[0], model.curve[-1]
    score = F.when(m <= first[0], F.lit(first[1]))
    for (x0, p0), (x1, p1) in zip(model.curve, model.curve[1:]):
        score = score.when(m <= x1, p0 + (m - x0) * ((p1 - p0) / (x1 - x0)))
    score = score.otherwise(F.lit(last[1]))
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    return Model(*sample(docs, labels, "toxic", sample_rows))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = fit(docs, table(spark, sf_dir, "labels").where(~held))
    return predict(docs, model, held_out=held)
