"""What several operators share: staging, sampling, batches and token hashing."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED_A = 0x9E3779B97F4A7C15
SEED_B = 0xC2B2AE3D27D4EB4F
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where that is unset and everything runs in one place."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("tablewright.shared.dir", None)
    if folder is None:
        if not re.match(r"local(\[[^-,]*(,\d+)?\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.conf.set("tablewright.shared.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    The lineage ends here: a lost executor costs only the tasks it was running,
    and a costly scan that several branches read runs once. The files are
    removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    for paths in _RECORDS:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


_RECORDS: list[list[str]] = []


@contextlib.contextmanager
def recorded():
    """Gives a list of the paths that are staged inside."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def discard_paths(spark: SparkSession, paths: list[str]) -> None:
    """Removes staged tables that nothing reads any more."""
    for path in paths:
        _remove(spark, path)


def discard(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more."""
    _remove(df.sparkSession, df.staged_at)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage and so return the heap that they don't use to the system; else a heap stays as large as it once was, beside the Python workers of whatever comes next. As many tasks as there are cores."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def share(spark: SparkSession, thing):
    """Broadcasts an object; the function returned gives it back in a task. The object's class travels along, so executors need no copy of this package."""
    from pyspark import cloudpickle

    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    def get():
        import pickle

        return pickle.loads(sent.value)

    return get


MOST_IDS = 1_000_000


def keyed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df staged with a key for each row, and the key's column: ids may be null or repeat, so decisions about rows go by this key."""
    (key,) = fresh(df, "row_key")
    return stage(df.withColumn(key, F.monotonically_increasing_id()), name), key


def without(df: DataFrame, id_col: str, ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """df without the rows whose key (see `keyed`) is in `ids` (one column of longs). Up to `most` keys (counted) are broadcast, so that texts needn't move; beyond that the join shuffles."""
    (name,) = fresh(df, "gone_id")
    gone = stage(ids.toDF(name).where(F.col(name).isNotNull()).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= most else gone
    return df.join(side, F.col(id_col).cast("long") == F.col(name), "left_anti").select(*df.columns)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; its folder goes with it
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near `names` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def crc_mod(column, n: int):
    """crc32 of the text form of an id, modulo n; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")


def bounded_ids(labels: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most `limit` rows, chosen by a hash of the id, so the choice doesn't depend on partitions or order."""
    return labels.orderBy(F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)).limit(limit)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def spans_of(sizes: list[int], most: int):
    """Consecutive ranges of items of at most `most` in total; an item above that is a range of its own."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def arrow_type(spark_schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


class WordHasher:
    """64-bit hashes of all the words of many texts at once.

    A word is a run of ASCII letters and digits and of bytes above 0x7F, after
    lower-casing. Hashes come from one running polynomial over the bytes
    modulo 2^64, so no word is ever made into an object of its own.
    """

    MULT = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2^64

    def __init__(self) -> None:
        lut = np.zeros(256, bool)
        lut[ord("0") : ord("9") + 1] = lut[ord("a") : ord("z") + 1] = lut[ord("A") : ord("Z") + 1] = True
        lut[128:] = True
        self.lut = lut
        self.inverse = pow(self.MULT, -1, 1 << 64)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.MULT), ("inverses", self.inverse)):
                p = np.full(n, np.uint64(base))
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, number of its text, its start byte, its end byte); offsets in the lower-cased, joined bytes."""
        parts = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        n = len(data)
        self._grow(n + 1)
        inside = self.lut[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]  # the last byte is a separator
        run = np.empty(n + 1, np.uint64)
        run[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=run[1:])
        h = (run[end] - run[start]) * self.inverses[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(SEED_A)
        h ^= h >> np.uint64(32)
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        at = np.searchsorted(np.cumsum(sizes), start, side="right")
        return h, at, start, end


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position; the caller leaves out runs that cross from one text into the next."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(SEED_B) + h[k : k + n]
    return mixed(out)
