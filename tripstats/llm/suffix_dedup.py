"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that starts elsewhere
too.  Three steps find those strings exactly:

1. *Parse.*  Every window of ``LENGTH`` bytes has an anchor, the 48-byte
   string inside it with the smallest hash.  Equal windows have equal anchors
   at equal offsets, so a text becomes a short list of runs of windows with
   one anchor.  A run whose whole span of bytes occurs twice is repeated as a
   whole; only spans that share an anchor but differ need a closer look.
   They are the dictionary, a small part of the text.
2. *Suffix order.*  The dictionary is dealt by anchor, in chunks of at most
   ``CHUNK`` spans, so no task depends on how often an anchor occurs.  A task
   sorts the suffixes of a chunk that start in its runs by their first
   ``LENGTH`` bytes, takes the common prefixes of neighbours, and from the
   previous and next smaller text positions in that order gets the longest
   previous factor of every suffix (with the order of positions turned
   round: the longest following one).
3. *Between chunks* of one anchor, the first suffix of each class goes on as
   a 128-bit digest and meets its like in a grouped count.

With ``keep_first`` only suffixes with a previous factor are removed, so the
first copy stays; else every copy goes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstats.llm.common import cut, small

#: Bytes of a repeated string.
LENGTH = 400
#: Bytes of an anchor.
ANCHOR = 48
#: Spans of one anchor that are sorted together.
CHUNK = 64
#: Suffixes that a task sorts at a time (whole chunks; at least one).
BATCH = 40_000
BASE = 0x9E3779B97F4A7C15


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}       # of this task


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    if bits in _POWERS:
        return _POWERS[bits]
    n = 1 << bits
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    _POWERS[bits] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[bits]


def rolling(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` bytes."""
    up, down = _powers(max(16, int(len(b)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64),
                           np.cumsum((b.astype(np.uint64) + np.uint64(1)) * down[:len(b)], dtype=np.uint64)])
    h = (sums[k:] - sums[:-k]) * up[:len(b) - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def parse(text: bytes, length: int = LENGTH, anchor: int = ANCHOR):
    """Runs of windows with one anchor: ``(anchor hash, span hash, first start, last start)`` arrays."""
    n = len(text)
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    h, w = rolling(np.frombuffer(text, np.uint8), anchor), length - anchor + 1
    m, blocks = len(h), -(-len(h) // w)
    v = np.full(blocks * w, np.iinfo(np.uint64).max)
    v[:m] = (h & np.uint64(0xFFFFFFFF << 32)) | np.arange(m, dtype=np.uint64)    # the leftmost of equals
    v = v.reshape(blocks, w)
    before = np.minimum.accumulate(v, axis=1).ravel()
    after = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    at = (np.minimum(after[:starts], before[w - 1:w - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [starts]]) - 1
    spans = np.array([int.from_bytes(hashlib.blake2b(text[i:j + length], digest_size=8).digest(), "little", signed=True)
                      for i, j in zip(first.tolist(), last.tolist())], np.int64)
    return h[at[first]].view(np.int64), spans, first, last


def previous_factors(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, in suffix order.

    ``position`` holds the text positions in suffix order, ``lcp[i]`` the
    common prefix of suffixes ``i - 1`` and ``i`` (``lcp[0]`` is 0).  The
    longest earlier match of a suffix is with the previous or the next
    smaller position in suffix order.
    """
    best = np.zeros(len(position), np.int64)
    for turn in (1, -1):
        pos = position[::turn]
        low = (lcp if turn == 1 else np.concatenate([[0], lcp[:0:-1]])).astype(np.int64)
        to = np.arange(len(pos)) - 1
        while True:                                     # follow the links of larger positions
            i = np.flatnonzero((to >= 0) & (low > 0))
            i = i[pos[to[i]] > pos[i]]
            if not len(i):
                break
            low[i], to[i] = np.minimum(low[i], low[to[i]]), to[to[i]]
        low[to < 0] = 0
        best = np.maximum(best, low[::turn])
    return best


def _sort_windows(spans: list[tuple], length: int, keep_first: bool):
    """``spans``: (chunk no, chunks of its anchor, anchor, order, text id, first, last, bytes)."""
    windows, group, owner, start = [], [], [], []
    rank = {o: i for i, o in enumerate(sorted({x[3] for x in spans}))}
    for no, x in enumerate(spans):
        view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(x[7], np.uint8), length)
        windows.append(view)
        group.append(np.full(len(view), x[0], np.uint32))
        owner.append(np.full(len(view), no, np.int64))
        start.append(np.arange(x[5], x[5] + len(view), dtype=np.int64))
    group, owner, start = np.concatenate(group), np.concatenate(owner), np.concatenate(start)
    key = np.empty((len(group), length + 4), np.uint8)
    key[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    np.concatenate(windows, out=key[:, 4:])
    order = np.argsort(key.view(f"S{length + 4}").ravel(), kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    lcp = np.concatenate([[0], np.where(same.all(axis=1), length + 4, same.argmin(axis=1)) - 4])
    lcp = np.maximum(lcp, 0)
    text = np.array([rank[x[3]] for x in spans], np.int64)[owner]
    position = ((text << 32) | start)[order]
    earlier = previous_factors(position, lcp) >= length
    gone = earlier if keep_first else earlier | (previous_factors(-position, lcp) >= length)

    flag = np.zeros(len(order), bool)
    flag[order] = gone
    out = []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):     # runs of removed starts, cut between spans
        cuts = [a, *(np.flatnonzero(owner[a + 1:b] != owner[a:b - 1]) + a + 1).tolist(), b]
        out += [(spans[owner[i]][4], int(start[i]), int(start[j - 1]) + length, None, None, None, None)
                for i, j in zip(cuts, cuts[1:])]
    many = np.array([x[1] > 1 for x in spans])
    for i in np.flatnonzero(~earlier & many[owner[order]]).tolist():          # the first of its class here
        x, s = spans[owner[order[i]]], int(start[order[i]])
        d = hashlib.blake2b(key[i, 4:].tobytes(), digest_size=16).digest()
        out.append((x[4], s, s + length, x[2], d, x[3][1], x[3][0]))
    return out


FOUND = "text long, start int, end int, anchor long, digest binary, doc_id {}, no_id boolean"


def _suffix_task(length: int, keep_first: bool):
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, last, no = [], 0, None, 0

        def flush():
            rows = _sort_windows(held, length, keep_first) if held else []
            for i in range(0, len(rows), 100_000):
                part = list(zip(*rows[i:i + 100_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types)], names)

        for batch in batches:
            types[5] = batch.schema.field("doc_id").type
            for r in batch.to_pylist():
                if (r["anchor"], r["chunk"]) != last:
                    if count >= BATCH:
                        yield from flush()
                        held, count = [], 0
                    last, no = (r["anchor"], r["chunk"]), no + 1
                o = (r["no_id"], r["doc_id"] if r["doc_id"] is not None else 0, r["text"])
                held.append((no, r["chunks"], r["anchor"], o, r["text"], r["first"], r["last"], r["span"]))
                count += r["last"] - r["first"] + 1
        yield from flush()
    return run


def _parse_task(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            cols: list[list] = [[] for _ in range(7)]
            for t in text:
                b = t.as_py() or b""
                for c, v in zip(cols, (hashlib.md5(b).digest(), len(b), hashlib.sha256(b).hexdigest(),
                                       *parse(b, length))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(cols[0], pa.binary()),
                 pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int64())),
                 pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32())),
                 pa.array([x.astype(np.int32) for x in cols[6]], pa.list_(pa.int32()))],
                ["row", "doc_id", "key", "n_bytes", "sha256", "anchors", "spans", "firsts", "lasts"])
    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for key, text, spans in zip(batch.column("row"), batch.column("text"), batch.column("spans")):
            b, gone = text.as_py() or b"", merged([(x["start"], x["end"]) for x in spans.as_py()])
            sha, at = hashlib.sha256(), 0
            for i, j in gone:
                sha.update(b[at:i])
                at = j
            sha.update(b[at:])
            rows.append((key.as_py(), sum(j - i for i, j in gone), len(gone), sha.hexdigest(),
                         [{"start": i, "end": j} for i, j in gone]))
        k, n, m, s, g = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(s, pa.string()),
             pa.array(g, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            ["row", "n_removed", "n_spans", "kept_sha256", "removed"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """Repeated strings of ``length`` bytes in the UTF-8 texts of ``docs``.

    ``docs`` needs ``doc_id, text``; other columns are ignored.  Returns one
    row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    removed`` (the maximal removed byte ranges as ``[start, end)``).

    Matches may overlap, may lie in one text, and never cross texts; they
    are judged on the input.  Null counts as empty; texts shorter than
    ``length`` keep all.  Equal texts and repeated rows are copies of each
    other.  With ``keep_first`` the earliest copy in the order of ``doc_id``
    (null last), then of byte position, stays; of equal texts the one with
    the smallest id counts as first and the others lose every byte.
    An empty table gives an empty result.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    text = F.col("text").cast("binary").alias("text")
    kind = dict(docs.dtypes)["doc_id"]
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text).mapInArrow(
        _parse_task(length), f"row long, doc_id {kind}, key binary, n_bytes long, sha256 string, anchors array<long>, "
        "spans array<long>, firsts array<int>, lasts array<int>"), "runs")
    id_order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    texts = cut(rows.groupBy("key").agg(F.min(id_order).alias("first"), F.count("*").alias("copies"),
                                        *[F.first(c).alias(c) for c in ("anchors", "spans", "firsts", "lasts")]),
                "texts")
    runs = texts.select("first.*", "copies", F.inline(F.arrays_zip(
        F.col("anchors").alias("anchor"), F.col("spans").alias("span"), F.col("firsts").alias("begin"),
        F.col("lasts").alias("last")))).toDF("no_id", "doc_id", "row", "copies", "anchor", "span", "begin", "last")
    place = F.struct("no_id", "doc_id", "row", "begin")
    spans = cut(runs.groupBy("anchor", "span").agg(F.sum("copies").alias("n"), F.min(place).alias("place")), "spans")
    shared = spans.groupBy("anchor").agg(F.count("*").alias("d")).where("d > 1")

    # 1. runs repeated as a whole, and those that share an anchor only
    asked = cut(spans.join(shared, "anchor", "left").where("n > 1 or d is not null")
                .select("anchor", "span", "n", "d", F.col("place.row").alias("at_row"),
                        F.col("place.begin").alias("at_begin")), "asked")
    is_place = (F.col("row") == F.col("at_row")) & (F.col("begin") == F.col("at_begin"))
    near = cut(runs.select("anchor", "span", "row", "begin", "last").join(asked, ["anchor", "span"])
               .select("anchor", "span", "row", "begin", "last", "n", "d", is_place.alias("is_place")), "near")
    whole = near.where(F.col("n") > 1)
    if keep_first:
        whole = whole.where(~F.col("is_place"))
    whole = whole.select(F.col("row").alias("text"), F.col("begin").alias("start"),
                         (F.col("last") + length).alias("end"))

    # the texts that matter, once each; all later steps read this part only
    keys = cut(near.select("row").distinct().join(texts.select("key", F.col("first.row").alias("row"),
                                                               F.col("first.doc_id").alias("first_id")), "row"), "keys")
    source = docs.select("doc_id",
                         F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    source = (source.withColumn("key", F.unhex(F.md5("text"))).join(small(keys, keys.count(), 64), "key")
              .where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("row", "doc_id", "text"))
    source = cut(source, "candidates")

    # 2. the dictionary: one span of each kind, with its bytes, in suffix order
    chunks = F.ceil(F.col("d") / CHUNK).cast("int")
    kinds = near.where(F.col("is_place") & F.col("d").isNotNull()).select(
        "anchor", "row", "begin", "last", chunks.alias("chunks"),
        F.pmod(F.xxhash64("span"), chunks).cast("int").alias("chunk"))
    need = kinds.groupBy("row").agg(F.collect_list(F.struct("anchor", "begin", "last", "chunk", "chunks")).alias("spans"))
    pieces = (source.join(need, "row").select("row", "doc_id", "text", F.inline("spans"))
              .select(F.col("row").alias("text_id"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "anchor",
                      F.col("begin").alias("first"), "last", "chunk", "chunks",
                      F.expr(f"substring(text, begin + 1, last - begin + {length})").alias("span"))
              .withColumnRenamed("text_id", "text"))
    # rows repeated with the same id and text bring the same piece again: one stays
    pieces = pieces.repartition("anchor", "chunk").dropDuplicates(["anchor", "chunk", "text", "first"])
    found = cut(pieces.sortWithinPartitions("anchor", "chunk").mapInArrow(
        _suffix_task(length, keep_first), FOUND.format(kind)),
                "factors")
    local = found.where("digest is null").select("text", "start", "end")

    # 3. classes that occur in several chunks of an anchor
    rep = found.where("digest is not null")
    order = F.struct("no_id", "doc_id", "text", "start")
    many = rep.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(order).alias("earliest")).where("n > 1")
    across = rep.join(many, ["anchor", "digest"])
    if keep_first:
        across = across.where(order != F.col("earliest"))
    across = across.select("text", "start", "end")

    gone = (whole.union(local).union(across).groupBy("text")
            .agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnRenamed("text", "row"))
    done = cut(source.join(gone, "row").select("row", "text", "spans").mapInArrow(
        _cut_task, "row long, n_removed long, n_spans long, kept_sha256 string, "
        "removed array<struct<start:int,end:int>>").dropDuplicates(["row"])
        .join(texts.select("key", F.col("first.row").alias("row")), "row").drop("row"), "removed")
    out = (rows.select("row", "doc_id", "key", "n_bytes", "sha256")
           .join(done, "key", "left").join(texts.select(F.col("first.row").alias("row"), F.lit(True).alias("is_first")),
                                           "row", "left") if keep_first else
           rows.select("doc_id", "key", "n_bytes", "sha256").join(done, "key", "left"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    result = out.select("doc_id", "n_bytes", *([] if not keep_first else ["is_first"]),
                        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
                        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
                        F.coalesce("removed", none).alias("removed"))
    if not keep_first:
        return result
    later = F.col("is_first").isNull() & (F.col("n_bytes") >= length)     # a copy of an earlier text goes whole
    empty = F.sha2(F.lit(b""), 256)
    return result.select(
        "doc_id", "n_bytes", F.when(later, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(later, empty).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(later, F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end"))))
        .otherwise(F.col("removed")).alias("removed"))
