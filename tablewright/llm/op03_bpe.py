"""BPE encoding and decoding through a table of distinct words.

The tokenizer's merges never cross the words of its own splitting rule, so the
ids of a text are the ids of its words in a row. The plan:

1. one scan splits the texts into words, all texts of a chunk at once. For every
   block of some `block_chars` characters it gives the block's different words, dealt
   into `buckets` by a hash of the word, and each text's words as positions
   among them. Both go through one exchange, which steps 2 and 3 share;
2. a bucket's words of all blocks meet in one task: that is one part of the table of distinct
   words. Each distinct word is encoded once and its ids go back to the blocks by position;
3. each block joins its positions with the ids, puts its texts' ids together, and
   decodes them by a join with the id-to-piece table (as large as the vocabulary, so it
   is broadcast); both digests are taken over whole texts. `decode` is the same join as a
   DataFrame operator.

A word occurs once in a block however often its texts say it, so a word that
is a third of the corpus is one entry per block. Buckets are as even as a hash; their
number follows spark.sql.shuffle.partitions.

Words are told apart inside a block by two 64-bit hashes; where those disagree, the
block is done once more by the words themselves. Reserved strings of the tokenizer file
are words of their own, as the library has it. Characters are classed as the library
does: the library itself is asked about those that Python's own table doesn't assign, as tables of Unicode differ in age.

Nulls and odd input: a null text is an empty one: no ids, the digests of
nothing; ids may be null or repeat; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import share, spans_of

BLOCK_CHARS = 6_000_000
CHUNK_CHARS = 250_000
#: The splitting rule of byte-level BPE: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIGN, LETTER, NUMBER, SPACE, END = range(5)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level pieces: itself where it is printable Latin-1, else the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    """Class of every code point."""
    from tokenizers.pre_tokenizers import ByteLevel

    out = np.zeros(0x110000, np.uint8)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, every))
    codes = np.array(every)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[codes[m.start() : m.end()]] = kind
    whole = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in every:
        if out[c] != SIGN and unicodedata.category(chr(c)) == "Cn":
            # it makes one word with a character of its own class
            out[c] = LETTER if len(whole("a" + chr(c))) == 1 else NUMBER if len(whole("1" + chr(c))) == 1 else SIGN
    return out


class Splitter:
    """Words of many texts at once, as the tokenizer splits them."""

    A, B = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F  # odd, so both have inverses modulo 2^64

    def __init__(self, spec: str) -> None:
        self.classes = character_classes()
        added = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.marks = added
        self.reserved = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def parts(self, texts: list[str]) -> tuple[list[str], list[int], list[bool]]:
        """Texts cut at reserved strings: (part, number of its text, is it reserved)."""
        out, owner, whole = [], [], []
        for i, t in enumerate(texts):
            if self.reserved and any(m in t for m in self.marks):
                for k, part in enumerate(self.reserved.split(t)):
                    if part:
                        out.append(part)
                        owner.append(i)
                        whole.append(k % 2 == 1)
            elif t:
                out.append(t)
                owner.append(i)
                whole.append(False)
        return out, owner, whole

    def split(self, texts: list[str]):
        """(joined text, start and end of each word in it, number of its text)."""
        parts, owner, whole = self.parts(texts)
        joined = "\n".join(parts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        ends = np.cumsum(sizes) - 1  # places of the marks between parts
        if not len(parts):
            none = np.zeros(0, np.int64)
            return joined, none, none, none, code
        kind = self.classes[code]
        kind[ends] = END
        before = np.empty_like(kind)
        before[0], before[1:] = END, kind[:-1]
        after = np.empty_like(kind)
        after[-1], after[:-1] = END, kind[1:]
        blank = code == 32
        blank &= kind == SPACE
        led = np.zeros(len(code), bool)  # a blank stands right before
        led[1:] = blank[:-1]
        start = kind != before
        start &= ~(led & (kind < SPACE))
        # the last of several spaces before a word stands apart: a blank leads the word, another space is a word
        start |= (kind == SPACE) & (after < SPACE)
        quote = np.flatnonzero((code == 39) & start & (after == LETTER))
        if len(quote):
            more = np.concatenate((code, np.zeros(3, np.uint32)))
            x, y = more[quote + 1], more[quote + 2]
            one = np.isin(x, [ord(c) for c in "stmd"])
            two = ~one & (((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
            start[quote[one | two] + 1] = False
            for some, n in ((quote[one], 2), (quote[two], 3)):
                start[some + n] |= (kind[some + n] != SPACE) & (kind[some + n] != END) | start[some + n]
        for k in np.flatnonzero(whole).tolist():  # a reserved string is one word
            start[ends[k] - sizes[k] + 2 : ends[k]] = False
            start[ends[k] - sizes[k] + 1] = True
        start[ends] = True
        at = np.flatnonzero(start)
        stop = np.append(at[1:], len(code))
        word = kind[at] != END
        at, stop = at[word], stop[word]
        return joined, at, stop, np.array(owner, np.int64)[np.searchsorted(ends, at)], code

    def hashes(self, code: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        x = code.astype(np.uint64) + np.uint64(1)
        for base in (self.A, self.B):
            p = np.full(len(code) + 1, np.uint64(base))
            p[0] = 1
            np.cumprod(p, out=p)
            run = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(x * p[:-1], out=run[1:])
            # the inverse of p at the word's place, from the powers of the inverse
            p[:] = np.uint64(pow(base, -1, 1 << 64))
            p[0] = 1
            np.cumprod(p, out=p)
            h = (run[stop] - run[at]) * p[at]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
            out.append(h ^ (h >> np.uint64(29)))
        return out[0], out[1]


def _pack(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers as planes of bytes, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def _unpack(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


_SPLIT = "k long, block long, first int, doc_ids array<long>, sizes array<long>, places binary, numbers binary"


class _Block:
    """Words of one block, gathered chunk by chunk."""

    def __init__(self, splitter: Splitter) -> None:
        self.splitter = splitter
        self.h, self.g = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # distinct so far, by h
        self.words: list[str] = []
        self.runs: list[np.ndarray] = []  # hash of each word said
        self.ids: list = []
        self.sizes: list[int] = []

    def add(self, ids: list, texts: list[str]) -> None:
        joined, at, stop, owner, code = self.splitter.split(texts)
        h, g = self.splitter.hashes(code, at, stop)
        some, first = np.unique(h, return_index=True)
        if not (g[first][np.searchsorted(some, h)] == g).all():
            raise _Collision
        place = np.minimum(np.searchsorted(self.h, some), max(len(self.h) - 1, 0))
        old = self.h[place] == some if len(self.h) else np.zeros(len(some), bool)
        if not (self.g[place[old]] == g[first][old]).all():
            raise _Collision
        new = first[~old]
        words = self.words + [joined[a:b] for a, b in zip(at[new].tolist(), stop[new].tolist())]
        hs, gs = np.concatenate((self.h, h[new])), np.concatenate((self.g, g[new]))
        order = np.argsort(hs, kind="stable")
        self.h, self.g = hs[order], gs[order]
        self.words = [words[i] for i in order.tolist()]
        self.runs.append(h)
        self.ids += ids
        self.sizes += np.bincount(owner, minlength=len(texts)).tolist()

    def rows(self, name: int, buckets: int) -> pa.RecordBatch:
        """One row with the texts, under the block's name, and one for each bucket with its words, under a negative number. Words are in the order of their hash, so a bucket is a stretch of them."""
        flat = np.searchsorted(self.h, np.concatenate(self.runs)) if self.runs else np.zeros(0, np.int64)
        common = np.argsort(-np.bincount(flat, minlength=len(self.h)), kind="stable")  # frequent words get small numbers, which compress well
        small = np.empty(len(self.h), np.uint32)
        small[common] = np.arange(len(self.h))
        out = [(name, name, 0, self.ids, self.sizes, _pack(common), _pack(small[flat]))]
        of = ((self.h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(of, np.arange(buckets + 1))
        for k in range(buckets):
            lo, hi = int(cut[k]), int(cut[k + 1])
            if lo < hi:
                said = [w.encode("utf-8", "surrogatepass") for w in self.words[lo:hi]]
                out.append((-1 - k, name, lo, None, None, _pack(np.array([len(w) for w in said])), zlib.compress(b"".join(said), 1)))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = ["k", "block", "first", "doc_ids", "sizes", "places", "numbers"]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(7)], names=names)


class _Collision(Exception):
    """Two words of a block with one hash; the chance is about 1 in 10^9 for a block."""


def _split_all(shared, block_chars: int, buckets: int):
    def run(batches):
        from pyspark import TaskContext

        splitter, task, serial = shared(), TaskContext.get().partitionId(), 0
        block, chars = _Block(splitter), 0

        def close():
            nonlocal block, chars, serial
            out = block.rows((task << 24) + serial, buckets)
            block, chars, serial = _Block(splitter), 0, serial + 1
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                for lo, hi in spans_of([len(t) for t in texts], CHUNK_CHARS):
                    size = sum(map(len, texts[lo:hi]))
                    if block.ids and chars + size > block_chars:
                        yield close()
                    try:
                        block.add(ids[lo:hi], texts[lo:hi])
                    except _Collision:  # other hashes for the next block
                        if block.ids:
                            yield close()
                        splitter.A, splitter.B = splitter.B, splitter.A * 5 + 2 | 1
                        block = _Block(splitter)
                        block.add(ids[lo:hi], texts[lo:hi])
                    chars += size
        if block.ids:
            yield close()

    return run


def _encode_all(spec_bc):
    """Rows of one partition: each distinct word of a bucket is encoded once. Until then the words stay compressed."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        held: dict[int, list] = {}
        for b in batches:
            for i, k in enumerate(b.column(0).to_pylist()):
                if k < 0:
                    held.setdefault(k, []).append([b.column(c)[i].as_py() for c in (1, 2, 5, 6)])
        tokenizer = Tokenizer.from_str(spec_bc()) if held else None
        kinds, names = [pa.int64(), pa.int32(), pa.binary(), pa.binary()], ["k", "first", "n", "ids"]
        for bucket in sorted(held):
            known: dict[bytes, int] = {}
            each = []
            for block, first, places, numbers in held.pop(bucket):
                data, at, own = zlib.decompress(numbers), 0, []
                for e in np.cumsum(_unpack(places)).tolist():
                    own.append(known.setdefault(data[at:e], len(known)))
                    at = e
                each.append((block, first, np.array(own, np.int64)))
            words, sizes, parts = [w.decode("utf-8", "surrogatepass") for w in known], [], []
            for at in range(0, len(words), 1000):  # the library's results are large
                coded = [e.ids for e in tokenizer.encode_batch_fast(words[at : at + 1000], add_special_tokens=False)]
                sizes += [len(x) for x in coded]
                parts.append(np.array([i for x in coded for i in x], np.uint32))
            size, flat = np.array(sizes, np.int64), np.concatenate(parts)
            start = np.cumsum(size) - size
            out = []
            for block, first, own in each:
                n = size[own]
                ids = flat[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                out.append((block, first, _pack(n), _pack(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(4)], names=names)

    return run


def pieces(spark, spec: str) -> DataFrame:
    """(id, piece): the vocabulary, in the byte-level alphabet; reserved strings are turned into it too. Its size is the vocabulary's."""
    body, alphabet = json.loads(spec), byte_alphabet()
    rows = {i: p for p, i in body["model"]["vocab"].items()}
    rows |= {t["id"]: "".join(alphabet[b] for b in t["content"].encode()) for t in body.get("added_tokens", [])}
    return spark.createDataFrame(pd.DataFrame({"id": list(rows), "piece": list(rows.values())}), "id int, piece string")


def _assemble(table_bc, keep_ids: bool):
    held: list = []

    def run(key, texts: pa.Table, words: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if keep_ids else 4]
        if key[0].as_py() < 0:
            return pa.table([pa.array([], kinds[c]) for c in range(len(names))], names=names)
        if not held:
            held.append(table_bc())
        table = held[0]
        rows = sorted(zip(words.column("first").to_pylist(), words.column("n").to_pylist(), words.column("ids").to_pylist()))
        size = np.concatenate([_unpack(n) for _, n, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
        flat = np.concatenate([_unpack(x) for _, _, x in rows]) if rows else np.zeros(0, np.uint32)
        start = np.cumsum(size) - size
        # the pieces of each id of the block's words, by the id-to-piece table, joined word by word
        pieces = [table[i] for i in flat.tolist()]
        said = [b"".join(pieces[a : a + n]) for a, n in zip(start.tolist(), size.tolist())]
        out = []
        for ids, sizes, places, numbers in zip(*[texts.column(c).to_pylist() for c in ("doc_ids", "sizes", "places", "numbers")]):
            common, all_words = _unpack(places).astype(np.int64), _unpack(numbers)
            at = 0
            for doc, n in zip(ids, sizes):
                own = common[all_words[at : at + n]]
                at += n
                count = size[own]
                total = int(count.sum())
                packed = flat[np.repeat(start[own] - (np.cumsum(count) - count), count) + np.arange(total)].astype("<u4").tobytes()
                text = b"".join([said[k] for k in own.tolist()])
                try:
                    text.decode("utf-8")
                except UnicodeDecodeError:
                    text = text.decode("utf-8", "replace").encode()
                out.append((doc, total, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text).hexdigest(), packed if keep_ids else None))
        return pa.table([pa.array([o[c] for o in out], kinds[c]) for c in range(len(names))], names=names)

    return run


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, buckets: int | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (little-endian 32-bit numbers)."""
    spark = docs.sparkSession
    with open(path or default_path(), encoding="utf-8") as f:
        spec = f.read()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(48, 4 * partitions)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    both = rows.mapInArrow(_split_all(share(spark, Splitter(spec)), block_chars, buckets), _SPLIT).repartition(partitions, "k")
    # both sides read every column of `both`, so Spark makes its exchange once; a bucket's groups have no texts and give nothing
    coded = both.mapInArrow(_encode_all(share(spark, spec)), "k long, first int, n binary, ids binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return both.groupBy("k").cogroup(coded.groupBy("k")).applyInArrow(_assemble(share(spark, piece_bytes(spec)), keep_ids), schema)


def piece_bytes(spec: str) -> dict[int, bytes]:
    """id -> bytes, for the whole vocabulary."""
    body, back = json.loads(spec), {ord(c): chr(b) for b, c in byte_alphabet().items()}
    out = {i: p.translate(back).encode("latin-1") for p, i in body["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in body.get("added_tokens", [])}


def decode(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """rows: (key, ids array<int>), keys distinct. Gives (key, ids, pieces in the byte-level alphabet): each id meets its piece by a join, and the pieces go back in a row by position. Keys without ids are left out."""
    one = rows.select("key", "ids", F.posexplode("ids").alias("at", "id"))
    met = one.join(F.broadcast(vocabulary), "id")  # the vocabulary's size is fixed
    said = met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "id", "piece"))).alias("all"))
    return said.select("key", F.col("all.id").alias("ids"), F.array_join(F.col("all.piece"), "").alias("pieces"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode_decode(table(spark, sf_dir, "documents"))
