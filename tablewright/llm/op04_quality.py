"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed counts of what it looks like: 1- to 4-grams of character
classes (lower-case, upper-case, digit, space, line end; other signs stay
themselves), 2-grams of its lower-cased characters, and how often a word, or a
pair of words, repeats what came shortly before. The counts are damped, weighted
by inverse document frequency and scaled to length one; a truncated singular
value decomposition of the labelled sample projects them to `rank` latent
dimensions. The labelled vectors are broadcast, every document is multiplied
with all of them in blocks, exactly, and the `neighbours` most similar ones vote
with a power of their similarity.

The classifier is fitted on a bounded sample: at most `sample_rows` labelled
rows, chosen by a hash of the id. What is broadcast is sample_rows x rank +
dims x rank floats, whatever the corpus. Scoring reads whole texts, row by row:
no key, so nothing can be hot.

Nulls and odd input: a null text is an empty one and has a score; labels that
are null are left out, and so are ids whose labels differ; an id that several documents have stands for the
smallest of their texts; without any label all scores are 0.5; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, bounded_ids, crc_mod, fresh, share, spans_of

DIMS = 4096
RANK = 64
SAMPLE_ROWS = 6000
NEIGHBOURS = 24
THRESHOLD = 0.3
CHUNK_CHARS, BATCH_ROWS = 200_000, 512  # what a worker holds at a time
_REPEATS = 8  # the last columns: counts of repetition


def _classes() -> np.ndarray:
    out = np.full(0x3000, ord("x"), np.uint32)
    for c in range(0x3000):
        s = chr(c)
        out[c] = ord("a") if s.islower() else ord("A") if s.isupper() else ord("0") if s.isdigit() else ord("\n") if s in "\r\n" else ord(" ") if s.isspace() else ord("a") if s.isalpha() else c
    return out


class Looks:
    """Counts of what texts look like, many texts at once."""

    def __init__(self, dims: int = DIMS) -> None:
        self.dims, self.classes, self.hasher = dims, _classes(), WordHasher()

    def counts(self, texts: list[str]) -> np.ndarray:
        n = len(texts)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
        at = np.repeat(np.arange(n), sizes)
        code = np.where(raw < 0x3000, self.classes[np.minimum(raw, 0x2FFF)], np.uint32(ord("a"))).astype(np.uint64)
        small = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
        rows = at * self.dims
        half = (self.dims - _REPEATS) // 2
        total = np.zeros(n * self.dims, np.int64)
        for base, width, orders, chars in ((0, half, (1, 2, 3, 4), code), (half, half, (2,), small)):
            h = np.zeros(len(chars), np.uint64)
            for k in range(1, max(orders) + 1):
                m = len(chars) - k + 1
                if m <= 0:
                    break
                h = h[:m] * np.uint64(0x100000001B3) + chars[k - 1 :] + np.uint64(k)
                if k in orders:
                    slot = ((((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) * np.uint64(width)) >> np.uint64(24)).astype(np.int64)
                    slot += rows[:m] + base
                    total += np.bincount(slot[at[:m] == at[k - 1 :]], minlength=len(total))
        total = total.reshape(n, self.dims)
        h, own, _, _ = self.hasher.words(texts)
        words = np.maximum(np.bincount(own, minlength=n), 1)
        for j, gap in enumerate((1, 2, 3)):  # a word that was there 1, 2 or 3 words before
            if len(h) > gap:
                same = (h[gap:] == h[:-gap]) & (own[gap:] == own[:-gap])
                total[:, self.dims - _REPEATS + j] = 4 * np.bincount(own[gap:][same], minlength=n)
        if len(h) > 1:  # pairs of words that the text has more than once
            pair = (h[:-1] * np.uint64(3) + h[1:])[own[1:] == own[:-1]]
            who = own[1:][own[1:] == own[:-1]]
            key = pair ^ (who.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            order = np.argsort(key)
            again = np.zeros(len(key), bool)
            again[order[1:]] = key[order][1:] == key[order][:-1]
            more = np.bincount(who[again], minlength=n)
            total[:, self.dims - _REPEATS + 3] = 4 * more
            for j, share in enumerate((0.3, 0.5, 0.7)):
                total[:, self.dims - _REPEATS + 4 + j] = (more > share * words) * words
        return total


class Model:
    def __init__(self, texts: list[str], labels: list[int], dims: int = DIMS, rank: int = RANK, neighbours: int = NEIGHBOURS) -> None:
        self.looks, self.neighbours = Looks(dims), neighbours
        self.y = np.array(labels, np.float32)
        counts = np.zeros((len(texts), dims), np.float32)  # sample_rows x dims floats, the largest thing on the driver; weighted in place
        for lo, hi in spans_of([len(t) + 2000 for t in texts], 400_000):
            counts[lo:hi] = self.looks.counts(texts[lo:hi])
        self.idf = (np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))) + 0.2).astype(np.float32)
        self.basis = np.zeros((dims, 1), np.float32)
        x = self._weighted(counts)
        if len(x):
            rng = np.random.default_rng(7)
            q = np.linalg.qr(x.T @ (x @ rng.standard_normal((dims, min(rank + 16, *x.shape))).astype(np.float32)))[0]
            for _ in range(3):  # power rounds sharpen the basis
                q = np.linalg.qr(x.T @ (x @ q))[0]
            _, _, v = np.linalg.svd(x @ q, full_matrices=False)
            self.basis = np.ascontiguousarray((q @ v.T)[:, :rank])
        self.vectors = self._latent(x)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        """Changes float32 counts in place."""
        x = np.sqrt(counts, dtype=np.float32, out=counts if counts.dtype == np.float32 else None)
        x *= self.idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
        return x

    def _latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        return z

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), 0.5)
        if not len(self.y):
            return out
        k = min(self.neighbours, len(self.y))
        for lo, hi in spans_of([len(t) + 2000 for t in texts], CHUNK_CHARS):
            near = self._latent(self._weighted(self.looks.counts(texts[lo:hi]))) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.clip(np.take_along_axis(near, top, axis=1), 1e-6, 1) ** 8
            out[lo:hi] = (w * self.y[top]).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0, 1)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text"):
    """At most `rows` labelled (text, label) rows on the driver."""
    own = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y is not null")
    own = own.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("i", "y")
    ids = bounded_ids(own, "i", rows)
    met = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(ids), "i")  # `ids` has at most `rows` rows
    got = met.groupBy("i").agg(F.min("t").alias("t"), F.min("y").alias("y")).collect()  # one row for each id, however often the documents repeat it
    got.sort(key=lambda r: (r.i, r.t or ""))
    return [r.t or "" for r in got], [r.y for r in got]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> Model:
    return Model(*sample(docs, labels, "quality", sample_rows), **options)


def _score(shared, text_at: int, names):
    def run(batches):
        model = shared()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                b = batch.slice(at, BATCH_ROWS)
                s = model.score([t or "" for t in b.column(text_at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=names)

    return run


def with_score(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """docs with one more column: the score, 0 to 1, higher where label 1 is likelier."""
    from pyspark.sql import types as T

    shared = share(docs.sparkSession, model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_score(shared, docs.columns.index(text_col), [*docs.columns, name]), schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs without the rows whose score is below the threshold."""
    (name,) = fresh(docs, "quality_score")
    model = fit(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0), **options)
    return with_score(docs, model, name).where(F.col(name) >= threshold).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels").where(~held))
    rows = with_score(docs.withColumn("held_out", held), model, "score")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
