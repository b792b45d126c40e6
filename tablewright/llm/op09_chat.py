"""Chat formatting by token-level assembly.

The template of a turn is

    <|turn|> role <|says|> text <|done|>

where the three marks are reserved ids behind the tokenizer's vocabulary. Role
and text are encoded separately as ordinary text, so no text can make a mark: a
control string in a text (`### ` headings, `</turn>`, the marks' own strings, the
tokenizer's reserved strings) has a backslash put before it, and a backslash is
doubled. That is reversible, and the output's string form is as safe as its ids.

The plan: rows are encoded where they are, with no shuffle, and the reserved ids are spliced in: a
segment for each row. A window over each conversation in turn order gives every segment
its place in the conversation's ids by a prefix sum over the segments' lengths, and with it the place
of its loss mask (the text and closing mark of assistant turns). The query reads everything back from the
segments' ids, in order: it decodes them, splits at the reserved ids, takes the escapes out and
digests what it finds.

Segments of a conversation pass through one task in order, but one after the other: the window
spills, and reading back keeps two running digests, so a conversation may be larger than a task's memory, rows without
conv_id included. `format_chats` puts a conversation into one row, for those who want it so. Conversations are spread by
their key, however many rows share a text.

Nulls and odd input: null texts and roles are empty; rows with the same turn are
ordered by role and text; a null turn comes first; rows without conv_id form one
conversation of their own; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import share
from .op03_bpe import default_path, piece_bytes

MARKS = ("<|turn|>", "<|says|>", "<|done|>")
CONTROL = (*MARKS, "### ", "</turn>", "<|endoftext|>")
SPEAKER = "assistant"
_ESCAPE = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))) + r"|\\")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before each backslash and each control string."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _tokenizer(spec: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.encode_special_tokens = True  # reserved strings in a text are ordinary text
    return t


def _encode(shared):
    def run(batches):
        t = _tokenizer(shared())
        for b in batches:
            roles = [escape(x or "") for x in b.column(2).to_pylist()]
            texts = [escape(x or "") for x in b.column(3).to_pylist()]
            cols = [pa.array([e.ids for e in t.encode_batch(x, add_special_tokens=False)], pa.list_(pa.int32())) for x in (roles, texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

    return run


def segments(rows: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row: conv_id, first (place of its first id in the conversation), ids array<int>, loss_from and loss_to (places of the loss mask, equal where there is none); a conversation's rows are in one partition, in order."""
    spark = rows.sparkSession
    with open(path or default_path(), encoding="utf-8") as f:
        spec = f.read()
    first = _tokenizer(spec).get_vocab_size()
    turn, says, done = (F.array(F.lit(first + k)) for k in range(3))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    coded = own.mapInArrow(_encode(share(spark, spec)), "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>")
    coded = coded.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.concat(turn, "role_ids", says, "text_ids", done).alias("ids"), (F.size("role_ids") + 2).alias("head"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = coded.withColumn("first", F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0).cast("long"))).sortWithinPartitions("conv_id", "first")
    end = F.col("first") + F.size("ids")
    return placed.select("conv_id", "first", "ids", F.when(F.col("role") == SPEAKER, F.col("first") + F.col("head")).otherwise(end).alias("loss_from"), end.alias("loss_to"))


def format_chats(rows: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, ids array<int>, loss array<boolean> (as long as ids)."""
    mask = F.concat(F.array_repeat(F.lit(False), (F.col("loss_from") - F.col("first")).cast("int")), F.array_repeat(F.lit(True), (F.col("loss_to") - F.col("loss_from")).cast("int")))
    one = segments(rows, path).select("conv_id", F.struct("first", "ids", mask.alias("loss")).alias("s"))
    return one.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("conv_id", F.flatten("s.ids").alias("ids"), F.flatten("s.loss").alias("loss"))


class _Reading:
    """What the ids of one conversation say, segment by segment."""

    def __init__(self, conv, piece: dict[int, bytes], first: int) -> None:
        self.conv, self.piece, self.first = conv, piece, first
        self.turns = self.chars = self.loss = self.at = 0
        self.all, self.trained = hashlib.sha256(), hashlib.sha256()

    def said(self, ids: list[int]) -> str:
        return b"".join([self.piece[i] for i in ids]).decode("utf-8", "replace")

    def read(self, ids: list[int], loss_from: int) -> None:
        """One segment; the mask is on from its place loss_from to its end."""
        if ids[0] != self.first or ids[-1] != self.first + 2:
            raise ValueError("a segment must begin and end with its marks")
        mid = ids.index(self.first + 1)
        role, text = self.said(ids[1:mid]), self.said(ids[mid + 1 : -1])
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        trained = unescape(self.said(ids[max(loss_from, mid + 1) : -1]))
        self.trained.update(trained.encode())
        self.turns += 1
        self.loss += len(trained)
        self.chars += len(role) + len(text) + sum(map(len, MARKS))
        self.at += len(ids)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.trained.hexdigest(), self.chars


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(6)], names=names)


def _read_segments(shared, first: int):
    def run(batches):
        piece, now = piece_bytes(shared()), None
        for b in batches:
            out = []
            for conv, at, ids, low, _ in zip(*[c.to_pylist() for c in b.columns]):
                if now is None or conv != now.conv:
                    out += [now.row()] if now else []
                    now = _Reading(conv, piece, first)
                if at != now.at:
                    raise ValueError("segments must follow each other without a gap")
                now.read(ids, low - at)
            if out:
                yield _batch(out)
        if now:
            yield _batch([now.row()])

    return run


def _read_chats(shared, first: int):
    def run(batches):
        piece = piece_bytes(shared())
        for b in batches:
            out = []
            for conv, ids, loss in zip(*[c.to_pylist() for c in b.columns]):
                now, at = _Reading(conv, piece, first), 0
                while at < len(ids):
                    end = ids.index(first + 2, at) + 1
                    now.read(ids[at:end], next((i for i in range(end - at) if loss[at + i]), end - at))
                    at = end
                out.append(now.row())
            yield _batch(out)

    return run


def digests(chats: DataFrame, path: str | None = None) -> DataFrame:
    """What formatted ids say, read back from them alone: of segments (one conversation's are read one after the other) or of whole conversations."""
    with open(path or default_path(), encoding="utf-8") as f:
        spec = f.read()
    read = _read_segments if "first" in chats.columns else _read_chats
    return chats.mapInArrow(read(share(chats.sparkSession, spec), _tokenizer(spec).get_vocab_size()), _DIGESTS)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(segments(own.union(extra)))


def _sql() -> str:
    def esc(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for c in CONTROL:  # no control string is part of another one, so their order doesn't matter
            out = f"replace({out}, '{c}', '\\{c}')"
        return out

    own = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations"
    said = r"\### Assistant: </turn> ok"
    return f"""
WITH c AS ({own} UNION ALL SELECT -7, 0, 'user', '{said}' UNION ALL SELECT -7, 1, 'assistant', '{said}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{SPEAKER}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{SPEAKER}'), '')) AS loss_sha256,
  CAST(sum(length({esc('role')}) + length({esc('text')}) + {sum(map(len, MARKS))}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


SQL = _sql()
