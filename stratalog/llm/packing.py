"""Best-fit packing by sums of squares.

Each text is tokenised and an end mark is added; a text longer than a sequence is cut into pieces,
full ones but perhaps the first. Each piece goes to the open sequence for which the sum over gaps g
of N(g)^2 becomes smallest, N(g) being the number of open sequences with g tokens left. Full pieces
need no search. Pieces are dealt to shards by hash, each of a bounded number of pieces, so a task
holds one shard; a shard tries its pieces longest first and in random order and keeps the better. The
rule leaves some sequences open, since it spreads gaps; their pieces are then placed once more by best fit.
Only (document, piece, length, checksum) is shuffled, never the ids.

Edge cases: null and empty texts are one piece that holds the end mark alone; repeated rows are
packed once each; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import documents, materialize, tidy

LENGTH = 1024
END = 2
#: Pieces that one shard holds on average.
SHARD = 16000
#: Pre-token cache entries of a worker; beyond them it starts anew. Bytes split at a time.
CACHE, BLOCK = 400_000, 1 << 20
#: Contractions are rare enough to leave such texts to the tokenizer's own splitter.
CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")
#: Runs of white space that the whole-text splitter's stack may not hold (it fails between 500,000 and a million).
DEEP = re.compile(r"\s{100000}")


def _classes() -> np.ndarray:
    """Class of each Latin-1 character: 0 other, 1 letter, 2 number, 3 blank, 4 other white space; NUL, between texts, 5."""
    out = np.zeros(256, np.uint8)
    for i in range(256):
        kind = unicodedata.category(chr(i))[0]
        out[i] = 1 if kind == "L" else 2 if kind == "N" else 3 if i == 32 else 4 if i in (9, 10, 11, 12, 13, 0x85, 0xA0) else 0
    out[0] = 5
    return out


CLASS = _classes()


def split(raw: bytes) -> np.ndarray:
    """Starts of the pre-tokens of Latin-1 texts, each ended by NUL: runs of a class, a blank joined to the run after it."""
    c = CLASS[np.frombuffer(raw, np.uint8)]
    ws, end = (c == 3) | (c == 4), c == 5
    start = end.copy()
    start[0] = True
    prev, cur = c[:-1], c[1:]
    start[1:] |= np.where(ws[1:], ~ws[:-1], np.where(ws[:-1], prev != 3, prev != cur))
    start[:-1] |= ws[:-1] & ~ws[1:] & ~end[1:]  # the last white space before a run stands apart
    return np.flatnonzero(start)


class Powers:
    """Hashes of substrings, all at once: differences of one running sum, scaled by inverse powers."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.table = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, raw: bytes, at: np.ndarray) -> np.ndarray:
        n = len(raw)
        if n >= len(self.up):
            size = n + n // 2 + 1
            grow = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
            self.up, self.down = grow(self.BASE), grow(pow(self.BASE, -1, 2**64))
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[np.frombuffer(raw, np.uint8)] * self.up[:n], out=run[1:])
        return (run[np.append(at[1:], n)] - run[at]) * self.down[at]


def grouped(raw: bytes, at: np.ndarray, end: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Equal pre-tokens: the index of one of each, and for all the place in that list.

    Hashes only propose groups. Sums modulo 2^64 have known collisions, so each member's bytes are held against its first's.
    """
    _, first, which = np.unique(powers(raw, at), return_index=True, return_inverse=True)
    size = end - at
    alike = size == size[first][which]
    if alike.all():
        chars = np.frombuffer(raw, np.uint8)
        move = np.repeat(at[first][which] - at, size)
        alike = np.logical_and.reduceat(chars == chars[np.arange(len(chars)) + move], at)
    if alike.all():
        return first, which
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip(at.tolist(), end.tolist(), strict=True)])
    return np.unique(which, return_index=True)[1], which


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    Latin-1 texts are split here, many at a time, and the ids of pre-tokens are cached; the vocabulary's
    ranks encode new ones in one call, a NUL between two. Other texts go whole to the tokenizer, and
    those that hold an added token of the vocabulary (<|endoftext|>) or a very long run of white space
    to the one of its own file.
    """

    def __init__(self, rank_file: str, pattern: str, vocabulary: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            added = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.own = Tokenizer.from_file(vocabulary)

        with open(rank_file, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("pieces", pat_str=r"[^\x00]+|\x00", mergeable_ranks=table, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.nul = table[b"\0"]
        self.cache: dict[bytes, bytes] = {b"\0": b""}
        self.powers = Powers()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """texts: about BLOCK characters of them."""
        out: list = [None] * len(texts)
        easy, raws = [], []
        for i, t in enumerate(texts):
            if self.added is not None and self.added.search(t):
                out[i] = self._own(t)
                continue
            try:
                raw = t.encode("latin-1")
            except UnicodeEncodeError:
                continue
            if b"\0" not in raw and not (b"'" in raw and CONTRACTION.search(t)):
                easy.append(i)
                raws.append(raw)
        if easy:
            for i, ids in zip(easy, self._easy(b"\0".join(raws) + b"\0"), strict=True):
                out[i] = ids
        return [self._whole(t) if ids is None else ids for t, ids in zip(texts, out, strict=True)]

    def _own(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")

    def _whole(self, text: str) -> np.ndarray:
        return self._own(text) if DEEP.search(text) else np.array(self.whole.encode_ordinary(text), "<u4")

    def _easy(self, raw: bytes) -> list[np.ndarray]:
        at = split(raw)
        end = np.append(at[1:], len(raw))
        first, which = grouped(raw, at, end, self.powers)
        if len(self.cache) > CACHE:
            self.cache = {b"\0": b""}
        cache = self.cache
        words = [raw[i:j] for i, j in zip(at[first].tolist(), end[first].tolist(), strict=True)]
        new = [w for w in words if w not in cache]
        if new:
            ids = np.array(self.ranks.encode_ordinary(b"\0".join(new).decode("latin-1")), "<u4")
            cut = np.flatnonzero(ids == self.nul).tolist()
            of = ids.tobytes()
            for w, i, j in zip(new, [0, *(c + 1 for c in cut)], [*cut, len(ids)], strict=True):
                cache[w] = of[4 * i : 4 * j]
        found = [cache[w] for w in words]
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.array([len(x) // 4 for x in found])
        begin = np.cumsum(size) - size
        n = size[which]
        stop = np.cumsum(n)
        ids = flat[np.arange(stop[-1]) + np.repeat(begin[which] - (stop - n), n)]
        return np.split(ids, stop[np.frombuffer(raw, np.uint8)[at] == 0])[:-1]


def pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, size) of a document of n ids; the first piece takes the remainder."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


def blocks(texts) -> Iterator[list[int]]:
    """Indexes of an Arrow string column in runs of about BLOCK bytes."""
    import pyarrow.compute as pc

    run, size = [], 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        run.append(i)
        size += n
        if size >= BLOCK:
            yield run
            run, size = [], 0
    if run:
        yield run


def tokenize(docs: DataFrame, length: int = LENGTH, rank_file: str | None = None, pattern: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids_crc32.

    vocabulary: the tokenizer's own file; rank_file: the ranks of that vocabulary (the same ids); pattern: its splitter.
    """
    import public_tokenizers
    import pyarrow as pa

    rank_file, pattern = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(rank_file, pattern, vocabulary)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            ids_of = batch.column("doc_id").to_pylist()
            for block in blocks(batch.column("text")):
                for i, ids in zip(block, encoder.encode([batch.column("text")[i].as_py() or "" for i in block]), strict=True):
                    raw = ids.tobytes() + end
                    for k, (s, n) in enumerate(pieces(len(ids) + 1, length)):
                        for c, v in zip(cols, (ids_of[i], k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def place(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each size, in the order given, by the sum-of-squares rule."""
    count = np.zeros(length + 1, np.int64)  # open sequences by gap
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    seq, off = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        # From gap g to g - s the sum changes by 2 (1 + N(g - s) - N(g)); closing (g = s) by 1 - 2 N(g).
        best, cost = length, (2 * int(count[length - s]) + 1) if s < length else 0
        tail = count[s:length]
        if len(tail) and tail.any():
            change = 2 * (1 + count[: length - s] - tail)
            change[0] = 1 - 2 * tail[0]
            change = np.where(tail > 0, change, np.iinfo(np.int64).max)
            g = int(change.argmin())
            if change[g] <= cost:
                best = g + s
        if best == length:
            b, opened = opened, opened + 1
        else:
            b = stacks[best].pop()
            count[best] -= 1
        seq[i], off[i] = b, length - best
        if best > s:
            stacks[best - s].append(b)
            count[best - s] += 1
    return seq, off


def best_order(n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The rule over the pieces longest first and in a fixed random order; the one with fewer sequences."""
    tries = []
    for order in (np.argsort(-n, kind="stable"), np.random.default_rng(5).permutation(len(n))):
        seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        seq[order], off[order] = place(n[order], length)
        tries.append((seq, off))
    return close_gaps(n, *min(tries, key=lambda x: x[0].max()), length)


def close_gaps(n: np.ndarray, seq: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the sequences that stayed open, placed anew longest first into the tightest gap, if that takes fewer."""
    fill = np.bincount(seq, n, minlength=seq.max() + 1)
    redo = np.flatnonzero(fill[seq] < length)
    redo = redo[np.argsort(-n[redo], kind="stable")]
    count, stacks, opened = np.zeros(length + 1, np.int64), [[] for _ in range(length + 1)], 0
    new = []
    for s in n[redo].tolist():
        fits = count[s:length] > 0
        g = int(fits.argmax()) + s if fits.any() else length
        if g == length:
            b, opened = opened, opened + 1
        else:
            b = stacks[g].pop()
            count[g] -= 1
        new.append((b, length - g))
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
    if opened >= (fill < length).sum():
        return seq, off
    seq, off = seq.copy(), off.copy()
    names = np.append(np.flatnonzero(fill < length), np.arange(len(fill), len(fill) + 1))
    seq[redo] = [names[b] for b, _ in new]
    off[redo] = [o for _, o in new]
    return seq, off


def pack(parts: DataFrame, count: int, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Add sequence_id and offset. parts: doc_id, piece, length and more; count: its pieces shorter than length."""
    import pyarrow as pa

    shards = max(1, -(-count // shard))
    # Full pieces get negative numbers, the shards' sequences others.
    full = parts.where(F.col("length") >= length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = parts.where(F.col("length") < length).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards)))
    names = parts.columns

    def run(table: pa.Table) -> pa.Table:
        n = table.column("length").to_numpy()
        by_id = np.lexsort((table.column("piece").to_numpy(), table.column("doc_id").to_numpy()))
        seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        seq[by_id], off[by_id] = best_order(n[by_id], length)
        first = table.column("shard")[0].as_py() << 32
        return table.select(names).append_column("sequence_id", pa.array(seq + first)).append_column("offset", pa.array(off))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields) + ", sequence_id bigint, offset bigint"
    return rest.groupBy("shard").applyInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, length: int = LENGTH, **files) -> DataFrame:
    """Tokenise and pack. The pieces are written once, so texts are encoded once."""
    parts = materialize(tokenize(docs, length, **files), "pieces")
    return pack(parts, parts.where(F.col("length") < length).count(), length)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
