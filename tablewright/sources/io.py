"""Where tables are read from and written to."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.meta import SchemaError, SchemaMeta, TableMeta


class FileSystem:
    """Small files and renames on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf, self.gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Through a new file and one overwriting rename, so that a reader sees the old text or the new one, and a crash leaves one of them."""
        tmp, fs = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        p, _ = self._at(path)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(tmp), fs.makeQualified(p), how)

    def size(self, path: str) -> int:
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength()

    def rename(self, a: str, b: str) -> None:
        p, fs = self._at(a)
        if not fs.rename(p, self._at(b)[0]):
            raise OSError(f"can't rename {a} to {b}")

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and everything runs in one place."""
    import tempfile

    for key in ("spark.checkpoint.dir", "tablewright.scratch.dir"):
        if folder := spark.conf.get(key, None):
            return folder
    if not re.match(r"local(\[[^-,]*(,\d+)?\])?$", spark.sparkContext.master):
        raise SchemaError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tablewright-")
    spark.conf.set("tablewright.scratch.dir", folder)
    return folder


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here, and a lost executor costs only its running tasks."""
    import atexit

    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs = FileSystem(spark)

    def clean() -> None:
        try:
            fs.delete(path)
        except Exception:  # the session has ended
            pass

    atexit.register(clean)
    return spark.read.schema(df.schema).parquet(path)


class Source:
    """Tables by name. scan() reads only the columns asked for."""

    def tables(self) -> list[str]:
        raise NotImplementedError

    def table(self, name: str) -> DataFrame:
        raise NotImplementedError

    def scan(self, t: TableMeta, columns: list[str] | None = None, condition: str | None = None) -> DataFrame:
        df = self.table(t.qualified)
        if condition:
            df = df.where(condition)
        names = [c.name for c in t.columns] if columns is None else columns
        return df.select(*[f"`{c}`" for c in names if c in df.columns])


class ParquetSource(Source):
    """A folder of <table>.parquet; a schema's name may stand before the table's."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def tables(self) -> list[str]:
        p, fs = FileSystem(self.spark)._at(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))

    def table(self, name: str) -> DataFrame:
        bare = name.rpartition(".")[2]
        fs = FileSystem(self.spark)
        for path in (f"{self.folder}/{name}.parquet", f"{self.folder}/{bare}.parquet"):
            if fs.exists(path):
                return self.spark.read.parquet(path)
        raise SchemaError(f"no table {name} in {self.folder}")


class FrameSource(Source):
    """DataFrames held by the caller."""

    def __init__(self, frames: dict[str, DataFrame]) -> None:
        self.frames = frames

    def tables(self) -> list[str]:
        return sorted(self.frames)

    def table(self, name: str) -> DataFrame:
        for n in (name, name.rpartition(".")[2], f"public.{name}"):
            if n in self.frames:
                return self.frames[n]
        raise SchemaError(f"no table {name}")


class JdbcSource(Source):
    """A database over JDBC. Options are Spark's own (user, password, sslmode, fetchsize, partitionColumn ...); verified TLS is the driver's matter."""

    def __init__(self, spark: SparkSession, url: str, **options: str) -> None:
        self.spark, self.url, self.options = spark, url, options

    def describe(self) -> str:
        """The URL without its password."""
        return re.sub(r"(password=)[^&;]*", r"\1***", re.sub(r"(//[^:/@]+):[^@]*@", r"\1:***@", self.url), flags=re.I)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=quoted(name), **self.options).load()

    def tables(self) -> list[str]:
        query = "(SELECT n.nspname || '.' || c.relname AS t FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p') AND NOT c.relispartition AND n.nspname NOT IN ('pg_catalog', 'information_schema')) q"
        return sorted(r.t for r in self.spark.read.format("jdbc").options(url=self.url, dbtable=query, **self.options).load().collect())


def write_parquet(frames: dict[str, DataFrame], folder: str, mode: str = "errorifexists", **options: str) -> None:
    for name, df in frames.items():
        df.write.mode(mode).options(**options).parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> str:
    """A table's name with its parts quoted; a bracketed query stays."""
    return name if name.startswith("(") else ".".join('"' + part.replace('"', '""') + '"' for part in name.split("."))


def jdbc_url(url: str) -> str:
    """postgres://user:pass@host/db as JDBC has it; a JDBC URL stays."""
    if url.startswith("jdbc:"):
        return url
    m = re.match(r"^postgres(?:ql)?://(?:(?P<user>[^:@/]*)(?::(?P<password>[^@]*))?@)?(?P<rest>.*)$", url)
    if not m:
        raise SchemaError(f"not a database URL: {url.partition('://')[0]}")
    own = [f"{k}={m[k]}" for k in ("user", "password") if m[k]]
    return f"jdbc:postgresql://{m['rest']}" + ("&" if "?" in m["rest"] else "?") * bool(own) + "&".join(own)


def is_url(place: str | None) -> bool:
    return bool(place) and place.startswith(("jdbc:", "postgres://", "postgresql://"))


def execute(spark: SparkSession, url: str, statements: list[str]) -> None:
    """SQL statements in one transaction, by the JVM's driver."""
    conn = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(jdbc_url(url))
    try:
        conn.setAutoCommit(False)
        for text in statements:
            s = conn.createStatement()
            s.execute(text)
            s.close()
        conn.commit()
    finally:
        conn.close()


def write_jdbc(frames: dict[str, DataFrame], url: str, order: list[str], batchsize: int = 5000, **options: str) -> None:
    """In plan order, parents first."""
    for name in order:
        if name in frames:
            frames[name].write.format("jdbc").mode("append").options(url=jdbc_url(url), dbtable=quoted(name), batchsize=str(batchsize), **options).save()


def update_jdbc(df: DataFrame, url: str, table: str, key: list[str], columns: list[str], **options: str) -> None:
    """Sets `columns` of the table's rows to what df has for their key: df goes to a table beside it, then one statement in a transaction takes the values over."""
    spark, side = df.sparkSession, f"{table}_{uuid.uuid4().hex[:12]}"
    names = [*key, *columns]
    df.select(*[F.col(f"`{c}`") for c in names]).write.format("jdbc").options(url=jdbc_url(url), dbtable=quoted(side), **options).save()
    at = lambda t, c: f'{t}."{c}"'
    same = " AND ".join(f"{at('s', c)} = {at(quoted(table), c)}" for c in key)
    sets = ", ".join(f'"{c}" = (SELECT {at("s", c)} FROM {quoted(side)} s WHERE {same})' for c in columns)
    try:
        execute(spark, url, [f"UPDATE {quoted(table)} SET {sets} WHERE EXISTS (SELECT 1 FROM {quoted(side)} s WHERE {same})"])
    finally:
        execute(spark, url, [f"DROP TABLE {quoted(side)}"])


def sequence_statements(values: dict[str, dict[str, int]]) -> list[str]:
    """SQL that lets each sequence go on behind the rows written; values as `next_values` gives them."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    return [f"SELECT setval(pg_get_serial_sequence({lit(quoted(t))}, {lit(c)}), {n}, false)" for t, own in sorted(values.items()) for c, n in sorted(own.items())]


def write_copy_text(df: DataFrame, path: str) -> None:
    """Text that COPY ... FROM reads: tabs, \\N for null, backslash escapes."""
    def field(c):
        x = F.col(f"`{c}`").cast("string")
        for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return F.coalesce(x, F.lit("\\N"))

    df.select(F.concat_ws("\t", *[field(c) for c in df.columns]).alias("value")).write.text(path)


def load_schema(spark: SparkSession, path: str) -> SchemaMeta:
    """From a YAML sidecar (.yaml, .yml) or DDL text (anything else)."""
    from ..plans.ddl import parse_ddl

    text = FileSystem(spark).read(path)
    return SchemaMeta.from_yaml(text) if path.endswith((".yaml", ".yml")) else parse_ddl(text)


def next_values(frames: dict[str, DataFrame], schema: SchemaMeta) -> str:
    """JSON of the value with which each sequence goes on after the rows written."""
    out = {}
    for name, df in sorted(frames.items()):
        cols = [c.name for c in schema[name].columns if c.sequence_backed and c.name in df.columns]
        if cols:
            row = df.agg(*[F.max(f"`{c}`").alias(c) for c in cols]).first()
            out[name] = {c: (row[c] or 0) + 1 for c in cols}
    return json.dumps(out, sort_keys=True)
