"""Language identification by nearest centroid over TF-IDF character n-grams.

A text is lower-cased and everything but letters becomes one space; its 1-, 2-
and 3-grams are hashed into `dims` counts, damped, weighted by inverse document
frequency and scaled to length one. Each language has up to `per_language`
centroids from spherical k-means, so a language of several registers keeps them
apart. A text goes to the language of the centroid of largest cosine. Where even
that cosine is below the language's floor (fitted as a low quantile of its own
training texts, less a margin), `rejected` is set: the text is unlike all that
was learned.

The classifier is fitted on a bounded sample: at most `sample_rows` labelled
rows for each language, or `all_rows` / languages if that is less (one at least), chosen
by a hash of the id and the text. Every language in the labels is learned, however many
there are and however rare. Inverse document frequencies are counted on that sample too,
as part of the fit. Prediction reads whole texts, row by row: no key, so nothing can be hot. The
model's size is (languages x per_language + 1) x dims floats whatever the corpus.

Nulls and odd input: a null text, or one without a letter, is `und` with score
0; rows with a null language teach nothing, and rows of equal id, text and language teach once; without any
labelled row all texts are `und`; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, share, spans_of

DIMS = 4096
SAMPLE_ROWS = 1500
ALL_ROWS = 20_000
PER_LANGUAGE = 8


def _letters() -> np.ndarray:
    """For each code point: itself where it is a letter, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c
    return out


class Grams:
    """Hashed n-gram counts of many texts at once."""

    def __init__(self, dims: int = DIMS) -> None:
        self.dims, self.letters = dims, _letters()

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x dims counts, number of letters of each)."""
        parts = [t.lower() for t in texts]
        sizes = np.array([len(p) + 2 for p in parts], np.int64)
        code = np.frombuffer((" " + "  ".join(parts) + " ").encode("utf-32-le", "replace"), np.uint32)
        code = self.letters[code]
        at = np.repeat(np.arange(len(parts)), sizes)
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (at[1:] != at[:-1])
        code, at = code[keep].astype(np.uint64), at[keep]
        rows = at * self.dims
        shift = np.uint64(64 - int(self.dims).bit_length() + 1)
        total = np.zeros(len(parts) * self.dims, np.int64)
        h = np.zeros(len(code), np.uint64)
        for n in (1, 2, 3):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
            slot = ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64) + rows[:m]
            same = at[:m] == at[n - 1 :]
            total += np.bincount(slot[same], minlength=len(total))
        letters = np.bincount(at[code != 32], minlength=len(parts))
        return total.reshape(len(parts), self.dims), letters


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Changes float32 counts in place."""
    x = np.sqrt(counts, dtype=np.float32, out=counts if counts.dtype == np.float32 else None)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x


def _spherical(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by cosine; starts from texts that are far from each other."""
    centre = [x.mean(axis=0)]
    centre[0] /= max(np.linalg.norm(centre[0]), 1e-9)
    best = x @ centre[0]
    for _ in range(min(k, len(x)) - 1):
        centre.append(x[int(best.argmin())])
        best = np.maximum(best, x @ centre[-1])
    c = np.array(centre)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


class Model:
    def __init__(self, texts: list[str], langs: list[str], dims: int = DIMS, per_language: int = PER_LANGUAGE) -> None:
        self.grams = Grams(dims)
        self.names = sorted(set(langs))
        counts = np.zeros((len(texts), dims), np.float32)  # the sample's rows x dims floats, weighted in place
        for lo, hi in spans_of([len(t) + 2000 for t in texts], 400_000):
            counts[lo:hi] = self.grams.counts(texts[lo:hi])[0]
        self.idf = (np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))) + 0.1).astype(np.float32)
        x, y = weighted(counts, self.idf), np.array(langs)
        centres, owner, floors = [], [], []
        for k, name in enumerate(self.names):
            own = x[y == name]
            c = _spherical(own, per_language)
            centres.append(c)
            owner += [k] * len(c)
            floors.append(float(np.quantile((own @ c.T).max(axis=1), 0.01)) - 0.1)
        self.centres = np.concatenate(centres).astype(np.float32) if centres else np.zeros((0, dims), np.float32)
        self.owner, self.floors = np.array(owner, np.int64), np.array(floors)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score 0 to 1, rejected) of each text."""
        names, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.names:
            return names, scores, rejected
        for lo, hi in spans_of([len(t) + 2000 for t in texts], 1_000_000):
            counts, letters = self.grams.counts(texts[lo:hi])
            near = weighted(counts, self.idf) @ self.centres.T
            by = np.stack([near[:, self.owner == k].max(axis=1) for k in range(len(self.names))], axis=1)
            best = by.argmax(axis=1)
            top = by[np.arange(len(best)), best]
            share = np.exp(20 * (by - top[:, None]))
            for i in np.flatnonzero(letters).tolist():
                names[lo + i] = self.names[best[i]]
                scores[lo + i] = float(np.clip(1 / share[i].sum(), 0, 1))
                rejected[lo + i] = bool(top[i] < self.floors[best[i]])
        return names, scores, rejected


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, all_rows: int = ALL_ROWS, dims: int = DIMS, per_language: int = PER_LANGUAGE) -> Model:
    """labelled: rows to learn from. Of each language at most min(sample_rows, all_rows / languages) rows reach the driver, one at least."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"), F.col(id_col).cast("string").alias("i")).where("l is not null and t is not null")
    rows = rows.select("l", "t", F.xxhash64("i", "t").alias("h"))
    n = rows.groupBy("l").agg(F.count("*").alias("n"))
    names = n.count()
    most = max(1, min(sample_rows, all_rows // max(1, names)))
    # a threshold on the hash leaves about twice the bound, so that no window ever sees a large language whole; few rows stay whole
    cut = n.select("l", F.when(F.col("n") <= 4 * most + 200, F.lit(1.0)).otherwise((2.0 * most + 200) / F.col("n")).alias("cut"))
    cut = F.broadcast(cut) if names <= 100_000 else cut
    near = rows.join(cut, "l").where((F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)) < F.col("cut"))
    once = near.groupBy("l", "h").agg(F.min("t").alias("t"))  # equal rows are one before they move
    top = once.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("n") <= most)
    got = sorted((r.l, r.t) for r in top.select("l", "t").collect())
    return Model([t for _, t in got], [name for name, _ in got], dims, per_language)


def _predict(shared):
    def run(batches):
        model = shared()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            names, scores, rejected = model.predict(texts)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, rejected."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    shared = share(docs.sparkSession, model)
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 3) == 1
    return predict(docs, fit(docs.where(~held)), held_out=held)
