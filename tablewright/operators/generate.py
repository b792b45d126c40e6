"""Synthetic rows that satisfy a schema's constraints: keys first, references second.

Every value is an expression over a row's identity, so nothing is drawn in
order. A row's identity is its index; where a unique constraint makes it draw again,
`#retry<k>` is put behind it. Parents have a dense index, and a reference is
`hash % parents`, joined on that index, or no join at all where the parent's key is
its index.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import generators
from ..functions.hashing import h, pick, u, uniform01
from ..plans.config import Config, rows_for
from ..plans.graph import SELF, check_deferred, plan_insertion
from ..plans.meta import ForeignKeyMeta, SchemaError, SchemaMeta, TableMeta
from ..sources.io import settle
from .profile import Profile

RID, RETRY, IDX, DEALT = "__rid", "__retry", "__idx", "__dealt"
RETRIES = 50


def dense_index(df: DataFrame, keys: list[str], name: str = IDX) -> DataFrame:
    """df with a dense index from 0 in the order of the keys.

    Rows are dealt by key range and numbered inside their range; the ranges' sizes,
    one number for each partition, give the offsets. No task sees all rows.
    """
    spread = settle(df.repartitionByRange(*[F.col(f"`{k}`") for k in keys]).withColumn("__part", F.spark_partition_id()), "index")
    sizes = sorted((r["__part"], r["n"]) for r in spread.groupBy("__part").agg(F.count("*").alias("n")).collect())
    start, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, start))
        start += n
    side = df.sparkSession.createDataFrame(offsets, "__part int, __start long")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*[F.col(f"`{k}`") for k in keys])) - 1
    numbered = spread.withColumn("__own", own).join(F.broadcast(side), "__part")  # one row for each partition
    return numbered.withColumn(name, F.col("__start") + F.col("__own")).drop("__part", "__own", "__start")


@dataclass
class Pool:
    """Keys that children can refer to: frame has IDX (dense, from 0) and the key columns."""

    frame: DataFrame
    size: int
    serial: str | None = None  # the column that is index + 1


def identity(rid: Column, retry: Column | None = None) -> Column:
    text = rid.cast("string")
    return text if retry is None else F.when(retry > 0, F.concat(text, F.lit("#retry"), retry.cast("string"))).otherwise(text)


def whole(a: Column, b: int) -> Column:
    """a divided by b without a remainder, in whole numbers of any size."""
    return F.call_function("div", a, F.lit(b).cast("long"))


BINS = 1024


def draw_count(parents: DataFrame, hashed: Column, histogram: list[tuple[int, int]], name: str) -> DataFrame:
    """parents with a column `name`: the number of children, drawn by the histogram's weights; an empty histogram gives 0.

    A draw meets the histogram by a range join: both sides are cut into at most BINS + 1 bins of the draws' range, which
    is an equal join with a small side, and the bounds decide inside a bin. The side is the histogram, one row
    for each different count and bin, so it's as large as the profile and not as the table.
    """
    total = sum(w for _, w in histogram)
    if not total:
        return parents.withColumn(name, F.lit(0).cast("long"))
    width, at, rows = -(-total // BINS), 0, []
    for n, w in histogram:
        rows += [(k, at, at + w, n) for k in range(at // width, (at + w - 1) // width + 1)] if w else []
        at += w
    side = parents.sparkSession.createDataFrame(rows, f"__bin long, __low long, __high long, `{name}` long")
    drawn = parents.withColumn("__draw", pick(hashed, total)).withColumn("__bin", whole(F.col("__draw"), width))
    met = drawn.join(F.broadcast(side) if len(rows) <= 1_000_000 else side, "__bin").where("__draw >= __low AND __draw < __high")
    return met.drop("__bin", "__draw", "__low", "__high")


def by_cardinality(parents: DataFrame, key: list[str], own: list[str], histogram: list[tuple[int, int]], seed: str, table: str, fk: str) -> DataFrame:
    """(RID, own columns): each parent draws its number of children; row indexes run on across parents in the order of their index."""
    named = parents.select(IDX, *[F.col(f"`{k}`").alias(o) for k, o in zip(key, own)])
    counted = draw_count(named, h(seed, table, fk, F.col(IDX).cast("string"), "cardinality"), histogram, "__n")
    children = counted.where("__n > 0").select(IDX, *own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__pos"))
    return dense_index(children, [IDX, "__pos"], RID).select(RID, *own)


class Generator:
    def __init__(self, spark: SparkSession, schema: SchemaMeta, config: Config, profile: Profile | None = None, parents: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.schema, self.config, self.profile = spark, schema, config, profile or Profile()
        self.pools: dict[tuple[str, tuple[str, ...]], Pool] = {}
        self.frames: dict[str, DataFrame] = {}  # with RID
        self.given = parents or {}
        self.spots: dict[tuple[str, str], Column] = {}  # (table, foreign key) -> parent's index by a bijection, where a unique constraint needs one

    # ------------------------------------------------------------- references
    def pool(self, fk: ForeignKeyMeta) -> Pool | None:
        parent = self.schema.find(fk.ref_table)
        if parent is None:
            return None
        key = (parent.qualified, tuple(fk.ref_columns))
        if key not in self.pools:
            if parent.qualified in self.frames:
                rows = self.frames[parent.qualified]
                names = [F.col(f"`{c}`") for c in fk.ref_columns]
                whole = all(not parent.column(c).nullable for c in fk.ref_columns)
                size = rows.count()
                serial = fk.ref_columns[0] if len(fk.ref_columns) == 1 and parent.column(fk.ref_columns[0]).sequence_backed and whole else None
                frame = rows.select(F.col(RID).alias(IDX), *names)
                if not whole:  # rows with a null in the key can't be referred to
                    frame = dense_index(frame.drop(IDX).dropna(), fk.ref_columns)
                    size = frame.count()
                self.pools[key] = Pool(frame, size, serial)
            elif parent.qualified in self.given:
                frame = settle(dense_index(self.given[parent.qualified].select(*[F.col(f"`{c}`") for c in fk.ref_columns]).dropna(), fk.ref_columns), "pool")
                self.pools[key] = Pool(frame, frame.count())
            else:
                return None
        return self.pools[key]

    def attach(self, rows: DataFrame, t: TableMeta, fk: ForeignKeyMeta, rid: Column, taken: set[str]) -> DataFrame:
        """rows with the columns of fk. Columns in `taken` were set by an earlier key, and the parent must agree with them."""
        pool, kinds = self.pool(fk), {}
        parent = self.schema.find(fk.ref_table)
        optional = all(t.column(c).nullable for c in fk.columns)
        new = [(o, r) for o, r in zip(fk.columns, fk.ref_columns) if o not in taken]
        if parent is None:  # outside the schema: ordinary values
            return rows.withColumns({o: generators.value(t.column(o), self.config.seed, t.qualified, rid) for o, _ in new})
        if pool is None or not pool.size:
            if not optional:
                raise SchemaError(f"{t.qualified}.{fk.name} needs at least one row in {parent.qualified}")
            kinds = dict(pool.frame.dtypes) if pool else {}
            return rows.withColumns({o: F.lit(None).cast(kinds.get(r, "string")) for o, r in new})
        x = h(self.config.seed, t.qualified, fk.name, rid)
        pins = [(o, r) for o, r in zip(fk.columns, fk.ref_columns) if o in taken]
        spot = self.spots.get((t.qualified, fk.name), pick(x, pool.size))
        if not pins and pool.serial:
            kind = dict(pool.frame.dtypes)[pool.serial]
            return rows.withColumn(fk.columns[0], (spot + 1).cast(kind))
        if not pins:
            keys = pool.frame.select(F.col(IDX).alias("__at"), *[F.col(f"`{r}`").alias(o) for o, r in new])
            return rows.withColumn("__at", spot).join(keys, "__at").drop("__at")
        # a dense index over (pin, key) and each pin's first index and size: no window sees a pin whole
        pin_names, own_names = [f"__p{i}" for i in range(len(pins))], [f"__v{i}" for i in range(len(new))]
        named = pool.frame.select(*[F.col(f"`{r}`").alias(n) for n, (_, r) in zip(pin_names, pins)], *[F.col(f"`{r}`").alias(n) for n, (_, r) in zip(own_names, new)])
        numbered = settle(dense_index(named, pin_names + own_names, "__at"), "pinned")
        sizes = numbered.groupBy(*pin_names).agg(F.count("*").alias("__size"), F.min("__at").alias("__first"))
        on = [F.col(f"`{o}`") == F.col(p) for (o, _), p in zip(pins, pin_names)]
        sized = rows.join(sizes, on, "left").drop(*pin_names).withColumn("__want", F.when(F.col("__size") > 0, F.col("__first") + pick(x, F.col("__size"))))
        if not optional and sized.where("__size IS NULL").limit(1).count():
            raise SchemaError(f"{t.qualified}.{fk.name}: no row of {parent.qualified} agrees with {', '.join(o for o, _ in pins)}, which an earlier foreign key has set")
        met = sized.join(numbered.select("__at", *own_names), F.col("__want") == F.col("__at"), "left")
        return met.withColumns({o: F.col(n) for n, (o, _) in zip(own_names, new)}).drop("__size", "__first", "__want", "__at", *own_names)

    # -------------------------------------------------------------------- rows
    def own_values(self, rows: DataFrame, t: TableMeta, rid: Column, skip: set[str], dealt: str | None = None) -> DataFrame:
        """All columns that no foreign key sets, in one select. dealt: the column whose value is DEALT's, where that has one."""
        out, nulls = {}, self.profile.nulls.get(t.qualified, {})
        for c in t.columns:
            if c.name in skip or c.stored_generated is not None:
                continue
            if c.sequence_backed:
                kind = {"int2": "smallint", "int4": "int"}.get(c.type, "bigint")
                out[c.name] = (F.col(RID) + 1).cast(kind)
                continue
            own = self.config.column(t.qualified, c.name)
            made = generators.value(c, self.config.seed, t.qualified, rid, own.generator)
            share = nulls.get(c.name, 0.0)
            if c.nullable and share > 0:
                coin = uniform01(h(self.config.seed, t.qualified, c.name, rid, "null"))
                made = F.when(coin >= share, made)
            out[c.name] = F.coalesce(F.col(DEALT), made).cast({"int2": "smallint", "int4": "int"}.get(c.domain_of or c.type, "bigint")) if c.name == dealt else made
        rows = rows.withColumns(out) if out else rows
        late = {c.name: F.expr(c.stored_generated) for c in t.columns if c.stored_generated is not None}
        return rows.withColumns(late) if late else rows

    def build(self, t: TableMeta, base: DataFrame, later: set[str], driven: ForeignKeyMeta | None = None, dealt: str | None = None) -> DataFrame:
        """base: RID, RETRY, the driving key's columns and, for the column `dealt`, DEALT. `later`: names of foreign keys that are attached afterwards."""
        rid = identity(F.col(RID), F.col(RETRY))
        taken: set[str] = set(driven.columns) if driven else set()
        rows = base
        for fk in t.foreign_keys:
            if fk.name in later or driven is not None and fk.name == driven.name:
                continue
            if self.schema.find(fk.ref_table) is t:
                rows = self.self_reference(rows, t, fk, rid)
            elif set(fk.columns) - taken:
                rows = self.attach(rows, t, fk, rid, taken)
            taken |= set(fk.columns)
        skip = taken | {c for fk in t.foreign_keys if fk.name in later for c in fk.columns}
        return self.own_values(rows, t, rid, skip, dealt)

    def self_reference(self, rows: DataFrame, t: TableMeta, fk: ForeignKeyMeta, rid: Column) -> DataFrame:
        """Row i refers to one of the rows 0 to i; the key is the index plus one, so there's no join."""
        x = h(self.config.seed, t.qualified, fk.name, rid)
        return rows.withColumns({o: (pick(x, F.col(RID) + 1) + 1).cast({"int2": "smallint", "int4": "int"}.get(t.column(r).type, "bigint")) for o, r in zip(fk.columns, fk.ref_columns)})

    def unique_sets(self, t: TableMeta, later: set[str]) -> list[tuple[str, list[str]]]:
        """Sets that can collide: all columns are made here, none by a key attached later, and not one is a sequence."""
        held = {c for fk in t.foreign_keys if fk.name in later for c in fk.columns}
        return [(n, cols) for n, cols in t.unique_sets() if not held & set(cols) and not any(t.column(c).sequence_backed for c in cols)]

    def bijections(self, t: TableMeta, base: DataFrame, later: set[str], driven: ForeignKeyMeta | None) -> None:
        """A unique set made up of whole foreign keys takes a different combination of parents for each row, by construction."""
        for name, cols in self.unique_sets(t, later):
            fks = [fk for fk in t.foreign_keys if set(fk.columns) <= set(cols)]
            covered = [c for fk in fks for c in fk.columns]
            if sorted(covered) != sorted(cols) or any(fk is driven or fk.name in later or self.schema.find(fk.ref_table) in (None, t) or (t.qualified, fk.name) in self.spots for fk in fks):
                continue
            pools = [self.pool(fk) for fk in fks]
            if any(p is None or not p.size for p in pools):
                continue
            n, size = base.count(), min(math.prod(p.size for p in pools), 1 << 62)  # combinations beyond that aren't needed
            if n > size:
                raise SchemaError(self.exhausted(t, [(name, cols)]))
            at = mixed_index(F.col(RID), n, size, self.config.seed, f"{t.qualified}{name}")
            for fk, p in zip(fks, pools):
                self.spots[t.qualified, fk.name] = F.pmod(at, F.lit(p.size))
                at = whole(at, p.size)

    def unique_rows(self, t: TableMeta, base: DataFrame, later: set[str], driven: ForeignKeyMeta | None) -> DataFrame:
        """All rows of base, none with a key that another row has. What RETRIES more draws don't settle, as where a domain is nearly full, takes the domain's free values, if its values are known."""
        self.bijections(t, base, later, driven)
        made = {c for (q, k) in self.spots if q == t.qualified for fk in t.foreign_keys if fk.name == k for c in fk.columns}
        sets = [(n, cols) for n, cols in self.unique_sets(t, later) if not set(cols) <= made]
        if not sets:
            return self.build(t, base, later, driven)
        for one in sets:
            if (span := self.domain(t, one[1])) and not t.column(one[1][0]).nullable and base.count() > span[1] - span[0] + 1:
                raise SchemaError(self.exhausted(t, [one]))
        held, lost = self.rounds(t, base, sets, RETRIES + 1, later, driven)
        keep = list(base.columns)
        if lost is None:
            return self.build(t, held.select(*keep), later, driven)
        span = self.domain(t, sets[0][1]) if len(sets) == 1 else None
        if span is None:
            raise SchemaError(self.exhausted(t, sets))
        name = sets[0][1][0]
        had = held.where(F.col("__key0").isNotNull()).select(F.col("__key0").getField(name).cast("long").alias("__had"))
        free = dense_index(self.spark.range(span[0], span[1] + 1).select(F.col("id").alias(DEALT)).join(had, F.col(DEALT) == F.col("__had"), "left_anti"), [DEALT], "__at")
        dealt = settle(dense_index(lost, [RID], "__at").join(free, "__at").drop("__at"), "dealt")
        if dealt.count() < lost.count():
            raise SchemaError(self.exhausted(t, sets))
        return self.build(t, held.select(*keep, F.lit(None).cast("long").alias(DEALT)).unionByName(dealt), later, driven, name)

    def domain(self, t: TableMeta, cols: list[str]) -> tuple[int, int] | None:
        """Least and greatest value of a set that is one column of whole numbers with its type's own generator."""
        c = t.column(cols[0])
        plain = len(cols) == 1 and not any(c.name in fk.columns for fk in t.foreign_keys) and c.stored_generated is None
        plain = plain and self.config.column(t.qualified, c.name).generator is None and not (c.check_allowed or c.check_null_escape or c.check_like_prefix)
        return generators.int_range(c) if plain and (c.domain_of or c.type) in ("int2", "int4", "int8") else None

    def rounds(self, t: TableMeta, base: DataFrame, sets: list[tuple[str, list[str]]], most: int, later: set[str] = frozenset(), driven: ForeignKeyMeta | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(rows that at most `most` rounds settle, with their keys; the rest, or None). In a round, of the rows that draw, those that
        are the first of their keys by index, and whose keys no earlier round has, are settled; the others draw again. Only indexes and
        keys are kept from round to round, a round costs as many rows as draw in it, and the other columns are made once, at the end. A null key never collides."""
        keep, keys = list(base.columns), [f"__key{i}" for i in range(len(sets))]
        key = lambda cols: F.when(reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in cols]), F.struct(*[F.col(f"`{c}`") for c in cols]))
        state, held = base, None
        for _ in range(most):
            rows = self.build(t, state, later, driven)
            drawn = settle(rows.select(*keep, *[key(cols).alias(k) for k, (_, cols) in zip(keys, sets)]), "unique")
            won = drawn
            for k in keys:
                # the first of each key: a map-side minimum, so a key that many rows draw doesn't gather them
                first = drawn.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(RID).alias(RID))
                if held is not None:
                    first = first.join(held.select(F.col(k).alias("__old")), F.col(k) == F.col("__old"), "left_anti")
                won = won.join(drawn.where(F.col(k).isNull()).select(RID).union(first.select(RID)), RID, "left_semi")
            won = settle(won.select(*keep, *keys), "unique")
            held = won if held is None else held.union(won)
            if won.count() == drawn.count():
                return held, None
            lost = drawn.select(*keep).join(won.select(RID), RID, "left_anti")
            state = lost.select(*[F.col(c) if c != RETRY else (F.col(RETRY) + 1).alias(RETRY) for c in keep])
        return held, state

    def first_rounds(self, name: str, most: int) -> DataFrame:
        """The rows of a table without foreign keys that its first `most` rounds settle, and no others: for SQL that spells so many rounds out. `run` gives all rows."""
        t = self.schema[name]
        base = self.spark.range(rows_for(self.config, self.profile.rows, t.qualified)).select(F.col("id").alias(RID), F.lit(0).alias(RETRY))
        held, _ = self.rounds(t, base, self.unique_sets(t, set()), most)
        return self.plain(t, self.build(t, held.select(RID, RETRY), set()))

    def exhausted(self, t: TableMeta, sets: list[tuple[str, list[str]]]) -> str:
        name, cols = sets[0]
        fks = [fk for fk in t.foreign_keys if set(fk.columns) & set(cols)]
        if fks:
            sizes = ", ".join(f"{fk.ref_table} has {p.size if (p := self.pool(fk)) else 0}" for fk in fks)
            return f"{t.qualified}: {name} ({', '.join(cols)}) can't be made unique: too few parent rows ({sizes})"
        return f"{t.qualified}: {name} ({', '.join(cols)}) can't be made unique: its own domain has too few values for the rows asked for"

    def table(self, t: TableMeta, later: set[str] = frozenset()) -> DataFrame:
        hists = self.profile.children.get(t.qualified, {})
        driven = next((fk for fk in t.foreign_keys if fk.name in hists and fk.name not in later and self.pool(fk) is not None and self.schema.find(fk.ref_table) is not t), None)
        if driven is not None:  # the children per parent decide; the table's `rows` doesn't
            base = by_cardinality(self.pool(driven).frame, driven.ref_columns, driven.columns, hists[driven.name], self.config.seed, t.qualified, driven.name)
            base = settle(base, "children")
        else:
            n = rows_for(self.config, self.profile.rows, t.qualified)
            base = self.spark.range(n).select(F.col("id").alias(RID))
        return self.unique_rows(t, base.withColumn(RETRY, F.lit(0)), set(later), driven)

    def run(self, only: set[str] | None = None) -> dict[str, DataFrame]:
        """{qualified table: rows}. only: the tables to generate; others come from `parents`."""
        for group in plan_insertion(self.schema):
            names = [n for n in group.tables if only is None or n in only]
            if not names:
                continue
            tables = [self.schema[n] for n in names]
            later = {t.qualified: {fk.name for fk in t.foreign_keys if (p := self.schema.find(fk.ref_table)) is not None and p.qualified in names and (len(names) > 1 or group.kind not in (SELF,) and not all(p.column(c).sequence_backed for c in fk.ref_columns))} for t in tables}
            if group.kind == "Deferred":
                check_deferred(self.schema, names)
            for t in tables:  # all keys first, without the references inside the cycle
                rows = self.table(t, later[t.qualified])
                self.frames[t.qualified] = settle(rows, "rows") if any(later.values()) else rows
            done = {}
            for t in tables:
                rows, rid = self.frames[t.qualified], identity(F.col(RID), F.col(RETRY))
                for fk in t.foreign_keys:
                    if fk.name in later[t.qualified]:
                        rows = self.attach(rows, t, fk, rid, set())
                done[t.qualified] = rows
            for t in tables:
                self.frames[t.qualified] = settle(done[t.qualified], "rows")
            self.pools = {k: v for k, v in self.pools.items() if k[0] not in names}
        return {n: self.plain(self.schema[n], df) for n, df in self.frames.items()}

    def plain(self, t: TableMeta, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c.name}`") for c in t.columns if c.name in df.columns])


def generate(spark: SparkSession, schema: SchemaMeta, config: Config, profile: Profile | None = None, check: bool = True) -> dict[str, DataFrame]:
    from .constraints import enforce

    frames = Generator(spark, schema, config, profile).run()
    if check:
        enforce(frames, schema)
    return frames


def mixed_index(rid: Column, n: int, size: int, seed: str, name: str) -> Column:
    """A different number below `size` for each of the n <= size row indexes: a step that shares no factor with size, and an offset."""
    most = max(1, (1 << 62) // max(n, 1))
    step = next((s for s in range(min(size // 2 + 1, most), 0, -1) if math.gcd(s, size) == 1), 1)
    return F.pmod(rid * step + u(h(seed, name, "pairs", F.lit("0"))) % size, F.lit(size))
