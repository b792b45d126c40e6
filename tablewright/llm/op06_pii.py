"""Information-theoretic sanitisation of personal data, in DataFrame expressions only.

Detection: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers
by regular expressions, leftmost and non-overlapping; matches that fail a kind's
test are dropped. Spans come from the lengths of the pieces between matches.

Disclosure: each different value found is a protected entity. The words of the
documents that hold it, mentions left out, are candidate terms. Over all documents,
with N their number, df(t) and df(e) those that hold the term and the entity and
c(e,t) those that hold both,

    PMI(e, t) = log2(c(e,t) N / (df(e) df(t)))        bits that t tells about e
    IC(e)     = log2(N / df(e))                       bits that name e

A term gives its entity away with PMI >= `share` * IC(e) and c(e,t) >= `support`, or
c(e,t) = df(e) where the entity is in fewer documents than that. Wherever it stands in
a document that holds the entity, it is removed if it occurs nowhere else (PMI =
IC(e) or more), and is generalised otherwise: a number to [NUMBER], a word to [TERM].
It stays in other documents. Mentions themselves are replaced by their kind.

Plan: one scan of the texts detects and stages the mentions, and the texts that have
any with their mentions blanked, under a key for each row. Entities that exactly the same rows
hold have the same statistics, so they are one class (their number of rows and two
hashes of the set of rows): a text with 100,000 addresses of its own has one class, not 100,000.
Classes and terms are paired row by row and aggregated with
map-side counts; one more scan counts df(t), for the terms that have enough support: a
join with that set, broadcast only after its rows were counted, else after the count
of all terms, so that no word of a text is shuffled by itself. An entity or a term that
a third of all rows share is one pre-aggregated row per task. Rows without a mention
are never moved; the others are only where the terms told of them are too many to broadcast.

Long texts: places come from running sums over pieces of bounded length, terms are looked up in
a table of hashed slots, and new texts are joined from an array of pieces, so the time for a text is in
proportion to its length, however many mentions and terms it has.

Nulls and odd input: a null text is an empty one; ids may be null or repeat, as rows
go by their own key; an empty table gives an empty result; other columns are carried by `sanitise` and not
read by `find`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SUPPORT = 3
SHARE = 0.9
MOST_BROADCAST = 100_000

_EMAIL = r"[A-Za-z0-9._%+-]"
_PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: kind, what a text must contain, expression. Possessive forms of the plain expressions: they match the same and never backtrack over a long run.
KINDS = [
    ("email", "@", rf"(?:\G|(?<!{_EMAIL})){_EMAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", None, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
_WORD = r"[\p{L}\p{N}]++"
#: What stands for each code point of a mention in a blanked text, and the whole words that touch no mention there.
_BLANK = "\ufdd0"
_OUTSIDE = rf"(?<![\p{{L}}\p{{N}}{_BLANK}])[\p{{L}}\p{{N}}]++(?!{_BLANK})"
_CHUNK = 128
_PIECE = 1024  # code points; a power of two
_SHIFT = 10
_CLASS = ["df_e", "x", "y"]


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once; lambdas would compute it for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values: Column, join) -> Column:
    """Running totals of an array<int> of numbers from 0 on, by `join` (a sum or a maximum): in chunks, as each step copies what it has."""

    def small(part):
        step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(join(acc["at"], x))).alias("all"))
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step)

    def of(a):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _CHUNK).cast("int")), lambda k: small(F.slice(a, k * _CHUNK + 1, _CHUNK)))
        step = lambda acc, c: F.struct(join(acc["at"], c["at"]).alias("at"), F.concat(acc["all"], F.array(F.transform(c["all"], lambda v: join(v, acc["at"])))).alias("all"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all"))
        return F.flatten(F.aggregate(chunks, start, step, lambda acc: acc["all"]))

    return _let(values, lambda a: F.when(F.size(a) > 0, of(a)).otherwise(F.array().cast("array<int>")))


def _sums(sizes: Column) -> Column:
    return _running(sizes, lambda a, b: a + b)


def _cut(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text that was cut into pieces; looks only at the pieces it needs."""
    first = F.shiftright(a, _SHIFT)
    some = F.slice(pieces, first + 1, F.greatest(F.shiftright(b - 1, _SHIFT) - first + 1, F.lit(0)))
    return F.substring(F.array_join(some, ""), a - F.shiftleft(first, _SHIFT) + 1, b - a)


def _spliced(text: Column, spans: Column, new) -> Column:
    """text joined anew: new(span, at, cut) for each of the sorted spans, `at` being where the spans before it end and cut(a, b) the
    text from a to b, and the rest of the text."""
    held = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)).alias("pieces"), spans.alias("spans"))

    def of(z):
        cut = lambda a, b: _cut(z["pieces"], a, b)
        ends = F.concat(F.array(F.lit(0)), _running(F.transform(z["spans"], lambda x: x["e"]), F.greatest))
        # there is one end more than there are spans
        one = lambda x, at: F.when(x["e"].isNull(), cut(at, F.length(text))).otherwise(new(x, at, cut))
        return F.array_join(F.zip_with(z["spans"], ends, one), "")

    return _let(held, of)


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of all matches, offsets in code points."""
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    ends = _let(said, lambda m: _sums(F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: g + F.length(x))))
    return F.zip_with(ends, said, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(c, i):
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), "(?!$)"), add), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


_MENTION = "array<struct<kind:int,s:int,e:int,m:string>>"


def _kept(text: Column, k: int, kind: str, pattern: str) -> Column:
    kept = F.filter(_spans(text, pattern), lambda x: _holds(kind, x["m"]))
    return F.transform(kept, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))


def mentions(text: Column) -> Column:
    """array<struct<kind, s, e, m>> of the base spans, by kind and then start."""
    parts = []
    for k, (kind, needs, pattern) in enumerate(KINDS):
        some = text.rlike(pattern) if needs is None else F.contains(text, F.lit(needs)) & text.rlike(pattern)
        parts.append(F.when(some, _kept(text, k, kind, pattern)).otherwise(F.array().cast(_MENTION)))
    return F.concat(*parts)


def _entity(kind: Column, m: Column) -> Column:
    """Different spellings of a value are one entity."""
    return F.concat(kind.cast("string"), F.lit(":"), F.when(kind == 0, F.lower(m)).when(kind == 1, m).otherwise(_digits(m)))


def _entities(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: _entity(x["kind"], x["m"])))


def _blanked(text: Column, found: Column) -> Column:
    """text, as long as before, with every code point of a mention blanked."""

    def new(x, at, cut):
        start = F.greatest(x["s"], at)
        return F.when(x["e"] > at, F.concat(cut(at, start), F.repeat(F.lit(_BLANK), x["e"] - start))).otherwise("")

    return _spliced(text, F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))), new)


def _terms(blanked: Column) -> Column:
    """array<string> of the different words outside mentions."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(blanked, F.lit(_OUTSIDE), F.lit(0)), F.lower))
    return F.filter(words, lambda t: F.length(t) > 2)


def _places(blanked: Column, told: Column) -> Column:
    """array<struct<s, e, removed, number>>: wherever a told term (struct<term, removed>) stands. Terms are looked up by two hashes, in a table with about as many slots as there are terms."""
    slot = lambda term, n, k: F.pmod(F.xxhash64(term, F.lit(k)), n).cast("int")

    def table(t):
        n = F.ceil(F.sqrt(F.size(t) / 8)).cast("int") + 1
        deal = lambda part, n, k: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.filter(part, lambda x: slot(x["term"], n, k) == j))
        return _let(n, lambda n: F.struct(n.alias("n"), F.transform(deal(t, n, 0), lambda part: deal(part, n, 1)).alias("all")))

    def of(z):
        def removed(term):
            return _let(term, lambda t: F.get(F.filter(F.get(F.get(z["all"], slot(t, z["n"], 0)), slot(t, z["n"], 1)), lambda x: x["term"] == t), 0)["removed"])

        return F.transform(_spans(blanked, _OUTSIDE), lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), removed(F.lower(w["m"])).alias("removed"), w["m"].alias("m")))

    hits = F.filter(_let(_let(told, table), of), lambda x: x["removed"].isNotNull())
    return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["removed"].alias("removed"), x["m"].rlike(r"^\p{N}+$").alias("number")))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Staged, for every row: row (its key), doc_id, found (base mentions); of texts with mentions, blanked and terms (its words); if asked for, doc (the row itself)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *own)
    rows = rows.withColumn("found", mentions(F.col("text")))
    rows = rows.withColumn("blanked", F.when(F.size("found") > 0, _blanked(F.translate("text", _BLANK, " "), F.col("found")))).drop("text")
    return stage(rows.withColumns({"terms": _terms(F.col("blanked")), "row": F.monotonically_increasing_id()}), "pii-found")


def _small(df: DataFrame, most: int) -> DataFrame:
    """A staged table, marked for a broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def classes(found: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Staged: (row, df_e, x, y), the classes of the entities that each row holds. df_e is the number of rows that hold the class, x and y are hashes of their set."""
    said = found.where(F.size("found") > 0).select("row", F.explode(_entities(F.col("found"))).alias("entity"))
    own = said.groupBy("entity").agg(F.count("*").alias("df_e"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    own = _small(stage(own, "pii-entities"), most_broadcast)
    return stage(said.join(own, "entity").select("row", *_CLASS).distinct(), "pii-classes")


def _pairs(found: DataFrame, of: DataFrame, most_broadcast: int) -> DataFrame:
    """(row, df_e, x, y, term) for the classes and the terms of each row."""
    held = found.where(F.size("found") > 0).select("row", "terms")
    return held.join(_small(of, most_broadcast), "row").select("row", *_CLASS, F.explode("terms").alias("term"))


def disclosing(found: DataFrame, of: DataFrame, docs: DataFrame, text_col: str = "text", support: int = SUPPORT, share: float = SHARE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(df_e, x, y, term, removed): the terms that give the entities of a class away."""
    n = F.lit(float(found.count()))
    both = _pairs(found, of, most_broadcast).groupBy(*_CLASS, "term").agg(F.count("*").alias("c")).where(F.col("c") >= F.least(F.lit(support), F.col("df_e")))
    # a term is in at least as many documents as hold it beside some entity: pairs that this bound rules out already needn't be counted in all texts
    seen = found.where(F.size("found") > 0).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("least"))
    ic = F.log2(n / F.col("df_e"))
    pmi = lambda df_t: F.log2(F.col("c") * n / (F.col("df_e") * F.col(df_t)))
    both = stage(both.join(seen, "term").where((ic > 0) & (pmi("least") >= share * ic)), "pii-pairs")
    wanted = stage(both.select("term").distinct(), "pii-terms")
    n_terms = wanted.count()
    if not n_terms:
        return both.select(*_CLASS, "term", F.lit(False).alias("removed")).limit(0)
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(_WORD), F.lit(0)), F.lower))).alias("term"))
    if n_terms <= most_broadcast:
        words = words.join(F.broadcast(wanted), "term", "left_semi")
    counted = words.groupBy("term").agg(F.count("*").alias("df_t"))
    told = both.join(counted, "term")
    return told.where(pmi("df_t") >= share * ic).select(*_CLASS, "term", (pmi("df_t") >= ic).alias("removed"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, most_broadcast: int = MOST_BROADCAST, **options) -> DataFrame:
    """doc_id, found, terms (array<struct<s, e, removed, number>> or null) and, if asked for, doc, for every row of docs."""
    found = detect(docs, id_col, text_col, whole)
    of = classes(found, most_broadcast)
    tells = stage(disclosing(found, of, docs, text_col, most_broadcast=most_broadcast, **options), "pii-tells")
    told = _pairs(found, of, most_broadcast).join(_small(tells, most_broadcast), [*_CLASS, "term"]).groupBy("row", "term").agg(F.max("removed").alias("removed"))
    told = stage(told.groupBy("row").agg(F.collect_list(F.struct("term", "removed")).alias("told")), "pii-told")
    rows, terms = told.agg(F.count("*"), F.coalesce(F.sum(F.size("told")), F.lit(0))).first()
    side = F.broadcast(told) if rows <= most_broadcast and terms <= 10 * most_broadcast else told
    own = ["doc_id", "found", *["doc"] * whole]
    met = found.where(F.size("found") > 0).join(side, "row", "left")
    met = met.select(*own, F.when(F.col("told").isNotNull(), _places(F.col("blanked"), F.col("told"))).alias("terms"))
    return met.unionByName(found.where(F.size("found") == 0).select(*own, F.lit(None).cast(met.schema["terms"].dataType).alias("terms")))


def _joined(kinds_and_spans: Column) -> Column:
    return F.array_join(kinds_and_spans, ",")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from what `find` gives."""
    name = F.array(*[F.lit(k) for k, _, _ in KINDS])
    base = F.transform("found", lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["s"], x["e"]))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<s:int,e:int,removed:boolean,number:boolean>>")), lambda x: F.concat_ws(":", F.lit("term"), x["s"], x["e"]))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, (kind, _, _) in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, terms)).alias("spans"))


def _rewrite(text: Column, spans: Column) -> Column:
    """text with each of the sorted spans replaced by its `r`; spans that overlap go together under the first one's."""
    return _spliced(text, spans, lambda x, at, cut: F.when(x["s"] >= at, F.concat(cut(at, x["s"]), x["r"])).otherwise(""))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with mentions and disclosing terms replaced in the text; every row and column is kept."""
    found = find(docs, id_col, text_col, whole=True, **options)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k, _, _ in KINDS])
    base = F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.get(marks, x["kind"]).alias("r")))
    general = lambda x: F.when(x["removed"], F.lit("")).when(x["number"], F.lit("[NUMBER]")).otherwise(F.lit("[TERM]"))
    terms = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), general(x).alias("r")))
    spans = F.array_sort(F.concat(base, F.coalesce(terms, F.array().cast("array<struct<s:int,e:int,r:string>>"))))
    old = F.col("doc").getField(text_col)
    new = F.when(F.size("found") > 0, _rewrite(old.cast("string"), spans)).otherwise(old.cast("string"))
    return found.select(*[(new.cast(docs.schema[c].dataType) if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return digest(find(table(spark, sf_dir, "documents")))
