"""Language-model scores by context-tree weighting over bytes.

Every byte is coded as eight binary decisions.  For each context of 0 to
``DEPTH`` preceding bytes and each decision (the bits already known) the
training texts give two counts, hence a Krichevsky-Trofimov probability; the
context tree weights stopping at a context against going one byte deeper by
the probability that either gave the training data.  A text is scored with
these fixed counts and weights: per decision the estimates of all depths are
mixed, down to the deepest context that training has seen.

Nothing of the model is broadcast but its two top levels, at most 256 x 256
numbers.  Documents are packed into blocks; a block asks for its distinct
words and byte strings only, and the counts of a word or of a two-byte
context live in one of ``buckets`` groups that answer all blocks:

1. blocks are written once, and each sends its distinct keys with training
   counts to the buckets;
2. the buckets sum the counts and report the top of the tree;
3. the buckets answer each block, key by key, and the blocks add up.

What is gathered is one entry per block and distinct key, so it grows with
the corpus; a frequent word is one entry per block.
"""
from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstats.llm.common import UPPER, cut, remainder

#: Bytes of context.
DEPTH = 5
#: Bytes of text in a block (a longer text is a block of its own).
BLOCK_BYTES = 10 << 20
#: Blocks answered by a bucket, and the least number of buckets.
BLOCKS_PER_BUCKET, BUCKETS = 4, 64
#: Rows whose remainder is 0 are held out.
FOLDS = 10
FOLD = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
END = xxhash.xxh3_64_intdigest(b"")                     # no word is empty
WORDS, GRAMS = 0, 1


def _pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size, first = [], 0, None

    def packed():
        blob = zstandard.ZstdCompressor(level=3).compress(pickle.dumps(rows))
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([blob], pa.binary())],
                                          ["block", "blob"])
    for batch in batches:
        for row, doc, held, text in zip(*(batch.column(c) for c in ("row", "doc_id", "held_out", "text"))):
            b = (text.as_py() or "").encode().translate(FOLD)
            first = row.as_py() if first is None else first
            rows.append((doc.as_py(), held.as_py(), b))
            size += len(b) + 64
            if size >= BLOCK_BYTES:
                yield packed()
                rows, size, first = [], 0, None
    if rows:
        yield packed()


def unpack(blob: bytes) -> list[tuple]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def press(values: np.ndarray, rising: bool = False) -> bytes:
    """An array as compressed bytes, equal bytes of neighbours side by side; rising values as differences."""
    v = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    return zstandard.ZstdCompressor(level=1).compress(
        v.view(np.uint8).reshape(-1, v.dtype.itemsize).T.tobytes()) if len(v) else b""


def expand(data: bytes, kind, rising: bool = False) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    v = np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(v, dtype=kind) if rising else v


def grams(text: bytes) -> np.ndarray:
    """``DEPTH`` preceding bytes and the byte, for every byte and the end (0), as numbers."""
    b = np.zeros(len(text) + DEPTH + 1, np.int64)
    b[DEPTH:-1] = np.frombuffer(text, np.uint8)
    code = np.zeros(len(text) + 1, np.int64)
    for i in range(DEPTH + 1):
        code = code << 8 | b[i:i + len(code)]
    return code


def distinct(parts: Iterator[np.ndarray], step: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with counts, from many short arrays, in bounded memory."""
    keys, counts, held, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merge():
        x = np.concatenate(held)
        held.clear()
        x.sort()
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        u, c = x[at], np.diff(at, append=len(x))
        return summed(np.concatenate([keys, u]), np.concatenate([counts, c])) if len(keys) else (u, c)
    for p in parts:
        held.append(p)
        n += len(p)
        if n >= step:
            (keys, counts), held, n = merge(), [], 0
    return merge() if held else (keys, counts)


def summed(keys: np.ndarray, *values: np.ndarray):
    """Sorted distinct keys with the sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at], *(np.add.reduceat(v[order], at) for v in values))


def vocabulary(rows: list[tuple]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a block and the end, with their hashes."""
    every = {b""}
    for _, _, b in rows:
        every.update(b.split())
    names = list(every)
    return names, hashed(names)


def hashed(names: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64).view(np.int64)


def asked(rows: list[tuple]):
    """What a block asks for: per kind the sorted distinct keys and their training counts."""
    train, other = Counter(), {b""}
    for _, held, b in rows:
        if held:
            other.update(b.split())
        else:
            train.update(b.split())
            train[b""] += 1
    names = list(other.union(train))
    words = summed(hashed(names), np.array([train[w] for w in names], np.int64))
    # a bit beside each string tells whether its text is held out, so that one sort counts both
    marked, n = distinct(grams(b) << 1 | bool(held) for _, held, b in rows)
    if not len(marked):
        return words, (marked, n)
    at = np.flatnonzero(np.concatenate([[True], marked[1:] >> 1 != marked[:-1] >> 1]))
    return words, (marked[at] >> 1, np.where(marked[at] & 1, 0, n[at]))


#: Byte strings added up at once; their places take the bits that a string's number leaves free.
PIECE = 1 << 16


def totals(texts: list[bytes], codes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sum of ``p`` over the byte strings of each text; ``codes`` are all strings, sorted.

    A piece of strings is sorted with its places, so that equal strings are
    looked up once and in order.
    """
    out, held, owner, n = np.zeros(len(texts)), [], [], 0

    def add():
        g, of = np.concatenate(held), np.concatenate(owner)
        for a in range(0, len(g), PIECE):
            part = g[a:a + PIECE]
            placed = np.sort(part.view(np.uint64) << np.uint64(16) | np.arange(len(part), dtype=np.uint64))
            code = (placed >> np.uint64(16)).view(np.int64)
            at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            value = np.empty(len(part))
            value[(placed & np.uint64(PIECE - 1)).view(np.int64)] = np.repeat(
                p[np.searchsorted(codes, code[at])], np.diff(at, append=len(code)))
            out[:] += np.bincount(of[a:a + PIECE], value, len(texts))
    for i, b in enumerate(texts):
        held.append(grams(b))
        owner.append(np.full(len(held[-1]), i))
        n += len(held[-1])
        if n >= 16 * PIECE:
            add()
            held, owner, n = [], [], 0
    if held:
        add()
    return out


def bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Words by their hash, byte strings by the last two bytes of context."""
    x = keys.view(np.uint64) if kind == WORDS else (keys >> 8 & 0xFFFF).astype(np.uint64)
    return ((x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(kind: int, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has keys, with their places in order."""
    b = bucket_of(kind, keys, buckets).astype(np.min_scalar_type(buckets))
    order = np.argsort(b, kind="stable")
    names, start = np.unique(b[order], return_index=True)
    return zip(names.tolist(), np.split(order, start[1:]))


def _ask_task(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block"), batch.column("blob")):
                for kind, (keys, counts) in enumerate(asked(unpack(blob.as_py()))):
                    out = [(i, block.as_py(), kind, press(keys[m], True), press(counts[m]), int(counts[m].sum()))
                           for i, m in by_bucket(kind, keys, buckets)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary(),
                                                                    pa.binary(), pa.int64()))],
                        ["bucket", "block", "kind", "keys", "counts", "n"])
    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    u, i = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in u.tolist()])[i] if len(u) else np.zeros(0)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def weigh(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes and the weight of stopping there; ``below``: the children's sum."""
    kt = log_kt(a, b)
    if below is None:
        return kt, np.ones(len(a))
    whole = math.log(0.5) + np.logaddexp(kt, below)
    return whole, np.exp(math.log(0.5) + kt - whole)


def tree(keys: np.ndarray, counts: np.ndarray):
    """Levels ``DEPTH`` to 2 as ``(depth, node keys, zeros, ones, stop weight)``, and the children's sums for level 1.

    A node key is the context's bytes, then the bits of the next byte known
    so far with a leading 1.
    """
    keys, counts = keys[counts > 0], counts[counts > 0].astype(float)
    node, zero, one = [], [], []
    for j in range(8):
        bit = keys >> (7 - j) & 1
        node.append((keys >> 8) << 8 | 1 << j | (keys & 255) >> (8 - j))
        zero.append(np.where(bit == 0, counts, 0.0))
        one.append(np.where(bit == 1, counts, 0.0))
    node, zero, one = summed(np.concatenate(node), np.concatenate(zero), np.concatenate(one))
    levels, below = [], None
    for depth in range(DEPTH, 1, -1):
        whole, stop = weigh(zero, one, below)
        levels.append((depth, node, zero, one, stop))
        parent = node & (1 << 8 * depth) - 1                  # the oldest byte of context goes
        node, zero, one, below = summed(parent, zero, one, whole)
    return levels, (node, zero, one, below)


def _merged(table: pa.Table, kind: int, step: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all blocks with their counts, added up as soon as ``step`` entries are expanded."""
    keys, counts, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i, k in enumerate(table.column("kind").to_pylist()):
        if k == kind:
            keys.append(expand(table.column("keys")[i].as_py(), np.int64, True))
            counts.append(expand(table.column("counts")[i].as_py(), np.int64))
            n += len(keys[-1])
            if n >= max(step, 2 * len(keys[0])):
                x, c = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, n = [x], [c], len(x)
    return summed(np.concatenate(keys), np.concatenate(counts))


def _top_task(table: pa.Table) -> pa.Table:
    _, (node, zero, one, below) = tree(*_merged(table, GRAMS))
    return pa.table({"node": node, "zero": zero, "one": one, "below": below})


def top_levels(rows) -> tuple[np.ndarray, ...]:
    """Dense zeros, ones and stop weights of levels 1 (context byte, bits) and 0 (bits)."""
    z, o, below = np.zeros(65536), np.zeros(65536), np.zeros(65536)
    for r in rows:
        z[r["node"]], o[r["node"]], below[r["node"]] = r["zero"], r["one"], r["below"]
    whole, stop = weigh(z, o, below)
    seen = z + o > 0
    whole = np.where(seen, whole, 0.0).reshape(256, 256)
    z0, o0 = z.reshape(256, 256).sum(axis=0), o.reshape(256, 256).sum(axis=0)
    _, stop0 = weigh(z0, o0, whole.sum(axis=0))
    return z, o, stop, z0, o0, stop0


def log10_p(keys: np.ndarray, levels, top) -> np.ndarray:
    """Log10 probability of each key's last byte after its context."""
    z1, o1, stop1, z0, o0, stop0 = top
    out = np.zeros(len(keys))
    for j in range(8):
        bit = keys >> (7 - j) & 1
        bits = 1 << j | (keys & 255) >> (8 - j)
        p, known = np.full(len(keys), 0.5), np.zeros(len(keys), bool)

        def mix(found, zero, one, stop):
            kt = (np.where(bit == 0, zero, one) + 0.5) / (zero + one + 1.0)
            return np.where(found, np.where(known, stop * kt + (1 - stop) * p, kt), p), known | found
        for depth, node, zero, one, stop in levels:
            if not len(node):
                continue
            want = (keys >> 8 & (1 << 8 * depth) - 1) << 8 | bits
            at = np.minimum(np.searchsorted(node, want), len(node) - 1)
            p, known = mix(node[at] == want, zero[at], one[at], stop[at])
        i = (keys >> 8 & 255) << 8 | bits
        p, known = mix(z1[i] + o1[i] > 0, z1[i], o1[i], stop1[i])
        p, known = mix(z0[bits] + o0[bits] > 0, z0[bits], o0[bits], stop0[bits])
        out += np.log10(p)
    return out


def _answer_task(top):
    def run(table: pa.Table) -> pa.Table:
        words, n = _merged(table, WORDS)
        keys, counts = _merged(table, GRAMS)
        p = log10_p(keys, tree(keys, counts)[0], top).astype(np.float32)
        bucket = table.column("bucket")[0].as_py()
        out, kinds = [], int((n > 0).sum())                       # distinct training words, told to one block
        for block, kind, k in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "keys"))):
            k = expand(k, np.int64, True)
            got = n[np.searchsorted(words, k)] if kind == WORDS else p[np.searchsorted(keys, k)]
            out.append((block, bucket, kind, 0 if out else kinds, press(got)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                                                                    pa.binary()))],
                        names=["block", "bucket", "kind", "v", "answer"])
    return run


def _score_task(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = [(None, None, None, sum(right.column("v").to_pylist()), None, None, None)]
        for blob in left.column("blob").to_pylist():
            rows = unpack(blob)
            answers = {(k, b): a for k, b, a in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "answer")))}
            names, hashes = vocabulary(rows)
            value = []
            for kind, keys in enumerate((np.unique(hashes), distinct(grams(b) for _, _, b in rows)[0])):
                v = np.zeros(len(keys))
                for i, m in by_bucket(kind, keys, buckets):
                    v[m] = expand(answers[kind, i], np.int64 if kind == WORDS else np.float32)
                value.append((keys, v))
            (words, count), (codes, p) = value
            logs = np.log10(count + 0.1)
            index = dict(zip(names, np.searchsorted(words, hashes).tolist()))
            for (doc, held, b), coded in zip(rows, totals([b for _, _, b in rows], codes, p).tolist()):
                w = b.split()
                i = np.fromiter(map(index.__getitem__, [*w, b""]), np.int64, len(w) + 1)
                out.append((doc, held, len(i), int((count[i] > 0).sum()), float(logs[i].sum()), coded, len(b)))
        types = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        cols = list(zip(*out)) if out else [()] * 7
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes"])
    return run


def score(docs: DataFrame) -> DataFrame:
    """Scores of every whole text under a model of the texts that are not held out.

    ``docs`` needs ``doc_id, text``; other columns are ignored.  Returns one
    row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte``.

    ``score`` is the log10 probability of the lower-cased (A-Z) text's bytes
    and of its end; ``bits_per_byte`` is its code length over bytes and end.
    ``base_score`` is that of the smoothed word counts.  Null counts as empty
    (one token, the end).  A null ``doc_id`` hashes as empty text and is held
    out.  Repeated rows count and are scored each.  Without training rows
    every bit has probability 1/2.  An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    blocks = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string"),
                             (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "text")
                 .mapInArrow(_pack_task, "block long, blob binary"), "blocks")
    n_blocks = blocks.count()
    buckets = max(BUCKETS, n_blocks // BLOCKS_PER_BUCKET)
    # a task per block: by bytes several would share one
    spread = blocks.repartition(max(1, n_blocks), "block")
    asks = cut(spread.mapInArrow(_ask_task(buckets), "bucket long, block long, kind int, keys binary, counts binary, "
                                 "n long"), "asks")
    total = asks.where(F.col("kind") == WORDS).agg(F.sum("n")).first()[0] or 0
    top = (asks.where((F.col("kind") == GRAMS) & (F.col("n") > 0)).select("bucket", "kind", "keys", "counts")
           .groupBy("bucket").applyInArrow(_top_task, "node long, zero double, one double, below double")
           .groupBy("node").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("below").alias("below")))
    levels = top_levels(top.collect())                        # at most 256 x 255 rows
    answers = asks.drop("n").groupBy("bucket").applyInArrow(
        _answer_task(levels), "block long, bucket long, kind int, v long, answer binary")
    scored = cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score_task(buckets), "doc_id string, held_out boolean, n_tokens long, n_known long, logs double, score double, "
        "n_bytes long"), "scores")
    kinds = scored.where("n_tokens is null").agg(F.sum("n_known")).first()[0] or 0
    scored = scored.where("n_tokens is not null")
    smooth = math.log10(total + 0.1 * (kinds + 1))
    return scored.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                         (F.col("logs") - F.col("n_tokens") * F.lit(smooth)).alias("base_score"), "score",
                         (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
