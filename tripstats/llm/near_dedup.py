"""Near duplicates by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its 5-word shingles.  BagMinHash draws, for every
shingle, points of a Poisson process over (component, weight): the weights
are cut at 1, 2, 4, ... and each piece has a process of its own, so two texts
that hold a shingle 3 and 5 times share exactly the points below weight 3.
The signature of a text is, per component, the smallest point at a weight it
reaches; two signatures agree in a component with the probability of the
weighted Jaccard similarity.  Points come in rising order and a process stops
once it passes the largest value still in the signature, so a text costs
about ``n + m log m`` points and not ``n m``.

Bands of the signature are buckets.  In a bucket all members are compared
with one centre, on their whole multisets, and what agrees is linked.  Where
the other members of a bucket still lie in several components, those outside
its largest component meet the rest in blocks of bounded size.  There, counts
of hashed shingles bound each overlap from above; pairs that can reach the
similarity are verified on whole multisets, likeliest first, unless links
found before have joined the two already.  A block thus emits fewer links
than it has members, and every bucket is settled exactly, without a cap.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstats.llm.common import UPPER, cut, id_key, pick, small
from tripstats.llm.components import components

#: Words of a shingle.
SHINGLE = 5
#: Weighted Jaccard similarity from which texts are near duplicates.
SIMILARITY = 0.8
#: Bands and rows of a band; a pair at similarity 0.8 shares a band with probability 0.99995.
BANDS, ROWS = 25, 5
#: Cells of the hashed counts that bound an overlap.
CELLS = 256
#: Members of a bucket, and shingles of theirs, that meet as many others in one block.
CHUNK, CHUNK_SHINGLES = 256, 1 << 20
#: Points drawn together: a block of documents with about so many shingles.
BLOCK = 200_000
#: Bytes of texts hashed together.
TEXT_BLOCK = 1 << 18
#: Points drawn at once for few open processes.
DRAW = 1 << 13
FOLD = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: The lower-cased byte of bytes that make words, 0 for the others.
LOWER = np.array([FOLD[i] if WORD.match(FOLD[i:i + 1]) else 0 for i in range(256)], np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and the number of words of each.

    A word hashes to the mixed sum of its mixed (place, byte) pairs.
    """
    held = LOWER[np.frombuffer(b"\0".join(texts), np.uint8)]
    edges = np.flatnonzero(np.diff(held != 0, prepend=False, append=False))
    start, length = edges[::2], edges[1::2] - edges[::2]
    bound = np.cumsum([0] + [len(t) + 1 for t in texts])
    words = np.diff(np.searchsorted(start, bound))
    if not len(start):
        return np.zeros(0, np.uint64), words
    held = held[held != 0].astype(np.uint64)
    first = np.cumsum(length) - length
    place = np.arange(len(held)) - np.repeat(first, length)
    return mix64(np.add.reduceat(mix64(held | place.astype(np.uint64) << np.uint64(8)), first)), words


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    h = np.full(max(len(words) - k + 1, 0), k, np.uint64)
    for i in range(k):
        h = mix64(h ^ words[i:i + len(h)])
    return h


def multisets(texts: list[bytes], shingle: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its sorted shingle hashes and their counts; a text of fewer words is one shingle, one of none is empty."""
    w, words = word_hashes(texts)
    every, out = _shingles(w, shingle), []
    for begin, n in zip((np.cumsum(words) - words).tolist(), words.tolist()):
        h = np.sort(every[begin:begin + n - shingle + 1] if n >= shingle else
                    _shingles(w[begin:begin + n], n) if n else w[:0])
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if n else np.zeros(0, np.int64)
        out.append((h[first], np.diff(first, append=len(h))))
    return out


def multiset(text: bytes, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    return multisets([text], shingle)[0]


def _multisets_of(column, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Multisets of a text column, some texts at a time."""
    held, n = [], 0
    for text in column:
        held.append((text.as_py() or "").encode())
        n += len(held[-1])
        if n > TEXT_BLOCK:
            yield from multisets(held, shingle)
            held, n = [], 0
    if held:
        yield from multisets(held, shingle)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash: per set and component the bits of the smallest point (0 for empty sets)."""
    best = np.full((len(sets), m), np.inf)
    flat = best.ravel()
    owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    if not len(owner):
        return np.zeros((len(sets), m), np.uint64)
    item = np.concatenate([h for h, _ in sets])
    count = np.concatenate([c for _, c in sets]).astype(np.int64)
    level, limit = 0, np.empty(len(sets))
    while len(item):                                    # the piece of weights [low, low + width)
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        go = np.flatnonzero(count > low)
        item, count, owner = item[go], count[go], owner[go]
        if not len(item):
            break
        seed = mix64(item ^ np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        it, ct, own, t, x = seed, count, owner, 0, np.zeros(len(item))
        while len(it):
            k = max(1, min(64, DRAW // len(it)))        # of few open processes several points; those past the limit change nothing
            draw = np.arange(t, t + k, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
            r = mix64(it[:, None] + draw)
            step = -np.log(((r >> np.uint64(11)).astype(float) + 1) / 2.0 ** 53) / (m * width)
            step[:, 0] += x
            x = np.cumsum(step, axis=1) if k > 1 else step
            r = mix64(r)
            cell = own[:, None] * m + (r % np.uint64(m)).astype(np.int64)
            weight = low + ((r >> np.uint64(40)).astype(np.int64) * width >> 24)
            ok = weight < ct[:, None]                   # points above the text's own weight are not its own
            np.minimum.at(flat, cell[ok], x[ok])
            open_sets = own[np.r_[True, own[1:] != own[:-1]]]       # ``own`` is sorted
            limit[open_sets] = best[open_sets].max(axis=1)
            x, t = x[:, -1], t + k
            alive = x < limit[own]
            it, ct, own, x = it[alive], ct[alive], own[alive], x[alive]
        level += 1
    return np.where(np.isinf(best), 0.0, best).view(np.uint64)


def _sign_task(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, keys, size, bands = [], [], [], []

            def flush(held):
                sig = signatures(held).reshape(len(held), BANDS, ROWS)
                h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(held), BANDS)).copy()
                for i in range(ROWS):
                    h = mix64(h ^ sig[:, :, i])
                bands.extend(h.view(np.int64)[i] if len(s[0]) else np.zeros(0, np.int64) for i, s in enumerate(held))
            n = 0
            for s in _multisets_of(batch.column("text"), shingle):
                keys.append(hashlib.blake2b(s[0].tobytes() + s[1].tobytes(), digest_size=16).digest()
                            if len(s[0]) else None)
                size.append(int(s[1].sum()))
                sets.append(s)
                n += len(s[0])
                if n > BLOCK:
                    flush(sets)
                    sets, n = [], 0
            flush(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", "doc_id", "sha")] +
                [pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["row", "doc_id", "sha", "key", "size", "bands"])
    return run


def cells_of(items: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts of the shingles per hashed cell: one byte each, or four where one does not do."""
    n = np.bincount((items >> np.uint64(32)).astype(np.int64) % CELLS, counts, CELLS).astype(np.int64)
    return np.minimum(n, 2 ** 32 - 1).astype(np.uint8 if n.max() < 256 else np.uint32).tobytes()


def _set_task(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_multisets_of(batch.column("text"), shingle))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([h.tobytes() for h, _ in sets], pa.binary()),
                 pa.array([np.minimum(c, 2 ** 31 - 1).astype(np.int32).tobytes() if (c > 1).any() else b""
                           for _, c in sets], pa.binary()),
                 pa.array([int(c.sum()) for _, c in sets], pa.int64()),
                 pa.array([cells_of(*s) for s in sets], pa.binary())], ["key", "items", "counts", "size", "cells"])
    return run


def bounds(cells: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the similarity of one multiset with others."""
    both = np.minimum(cells, others).sum(axis=1, dtype=np.int64)
    return both / np.maximum(size + sizes - both, 1)


def _cells(column) -> np.ndarray:
    rows = [c.as_py() for c in column]
    wide = any(len(r) > CELLS for r in rows)
    if not wide:
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), CELLS)
    return np.stack([np.frombuffer(r, np.uint32 if len(r) > CELLS else np.uint8).astype(np.uint32) for r in rows])


def _bound_task(similarity: float):
    """Pairs whose cells allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            if batch.num_rows:
                x, y = _cells(batch.column("cells_a")), _cells(batch.column("cells_b"))
                both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                every = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy() - both
                out = out.filter(pa.array(both / np.maximum(every, 1) >= similarity))
            yield out
    return run


def overlap(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
    """Exact weighted Jaccard similarity of two packed multisets."""
    (x, p), (y, q) = ((np.frombuffer(i, np.uint64), np.frombuffer(c, np.int32) if c else
                       np.ones(len(i) // 8, np.int32)) for i, c in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(p[i], q[j]).sum(dtype=np.int64)
    every = p.sum(dtype=np.int64) + q.sum(dtype=np.int64) - both
    return float(both / every) if every else 0.0


def _block_task(similarity: float):
    """Links that join the components of one block: verified pairs, at most one less than there are members."""
    def run(block: pa.Table) -> pa.Table:
        first = block.column("first").to_numpy(zero_copy_only=False)
        key, items, counts = (block.column(c).to_pylist() for c in ("key", "items", "counts"))
        root = np.unique(np.array([r.hex() for r in block.column("root").to_pylist()]), return_inverse=True)[1]
        cells, size = _cells(block.column("cells").combine_chunks()), block.column("size").to_numpy()
        # a block of two chunks pairs the first with the second, a block of one pairs all its members
        left, pairs = np.flatnonzero(first) if not first.all() else np.arange(len(first)), []
        for i in left:
            j = np.flatnonzero(~first) if not first.all() else np.arange(i + 1, len(first))
            j = j[(root[j] != root[i]) & (np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]))]
            up = bounds(cells[i], size[i], cells[j], size[j])
            pairs.append(np.stack([np.full(len(j), i), j, up], axis=1)[up >= similarity])
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 3))
        links = []
        for i, j in pairs[np.lexsort((pairs[:, 1], pairs[:, 0], -pairs[:, 2])), :2].astype(int).tolist():
            if root[i] != root[j] and overlap((items[i], counts[i]), (items[j], counts[j])) >= similarity:
                links.append(sorted((key[i], key[j])))
                root[root == root[j]] = root[i]
        return pa.table([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])
    return run


def _verify_task(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("items_a", "counts_a", "items_b", "counts_b")]
            ok = [overlap((x.as_py(), p.as_py()), (y.as_py(), q.as_py())) >= similarity for x, p, y, q in zip(*cols)]
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            yield out.filter(pa.array(ok, pa.bool_()))
    return run


def apart(labelled: DataFrame, full: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links ``(a, b)`` between different components of a bucket.

    ``labelled`` is ``(bucket, key, size, root)``; the centres of ``full`` have met
    their buckets.  Members outside the largest component of a bucket meet
    each other and its members, chunk by chunk.
    """
    met = full.select("bucket", F.col("centre.key").alias("key"))
    open_ = cut(labelled.join(met, ["bucket", "key"], "left_anti"), "open")
    parts = open_.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "root", "size")).alias("main"), F.sum("n").alias("n"),
                                        F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1")

    def chunks(n, size):
        return F.greatest(F.ceil(n / CHUNK), F.ceil(size / CHUNK_SHINGLES)).cast("int")

    mixed = mixed.select("bucket", F.col("main.root").alias("main_root"), chunks(F.col("main.n"), F.col("main.size")).alias("mains"),
                         chunks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("others"))
    spot = F.xxhash64("key")
    rows = open_.join(mixed, "bucket").withColumn("is_main", F.col("root") == F.col("main_root"))
    rows = rows.withColumn("chunk", F.pmod(spot, F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))
    to = lambda n: F.sequence(F.lit(0), n - 1)          # noqa: E731
    chunk = F.col("chunk").cast("int")
    block = lambda x, y, kind, first: F.struct(          # noqa: E731
        x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"), first.alias("first"))
    with_main = F.transform(to(F.col("mains")), lambda j: block(chunk, j, "main", F.lit(True)))
    with_rest = F.transform(to(F.col("others")), lambda j: block(
        F.least(chunk, j), F.greatest(chunk, j), "rest", chunk <= j))
    as_main = F.transform(to(F.col("others")), lambda i: block(i, chunk, "main", F.lit(False)))
    placed = rows.drop("size").select("bucket", "key", "root", F.inline(
        F.when(F.col("is_main"), as_main).otherwise(F.concat(with_main, with_rest))))
    return (placed.join(sets.select("key", "size", "cells", "items", "counts"), "key")
            .groupBy("bucket", "kind", "x", "y").applyInArrow(_block_task(similarity), "a binary, b binary"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The near-duplicate class of every document.

    ``docs`` needs ``doc_id, text``; other columns are ignored.  Returns one
    row per input row: ``doc_id, class_id, class_size, kept, text_sha256``.

    Classes are the connected components of "weighted Jaccard similarity of
    the shingle multisets is at least ``similarity``" over all pairs that
    share a band.  ``class_id`` is the smallest ``doc_id`` of the class (null
    ids last); one row of a class has ``kept`` true, that of the smallest id
    (of rows repeated with it, one).  Texts with equal multisets are one
    node.  Null, empty and wordless texts resemble nothing and are classes
    of their own; a text of fewer words than a shingle is one shingle.
    An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", sha.alias("sha"), "text").mapInArrow(
        _sign_task(shingle), f"row long, doc_id {kind}, sha string, key binary, size long, bands array<long>"),
        "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "sha"))
    nodes = cut(rows.where("key is not null").groupBy("key")
                .agg(first.alias("first"), F.count("*").alias("n"), F.first("size").alias("size"),
                     F.first("bands").alias("bands")), "nodes")

    banded = nodes.select("key", "size", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("key", "size")).alias("centre"))
    full = cut(full.where("n > 1"), "buckets")
    members = cut(banded.join(full.select("bucket"), "bucket"), "members")

    wanted = cut(members.select("key").distinct().join(nodes.select("key", "first"), "key").select(
        "key", id_key(F.col("first.doc_id")).alias("id"), F.unhex("first.sha").alias("sha")), "wanted")
    ask = wanted.agg(F.count("*").alias("n"), F.max(F.length("id")).alias("b")).first()
    sets = cut(docs.select(id_key(F.col("doc_id")).alias("id"), F.unhex(sha).alias("sha"), "text")
               .join(small(wanted, ask["n"], (ask["b"] or 0) + 96), ["id", "sha"])
               .select("key", "text").mapInArrow(
                   _set_task(shingle), "key binary, items binary, counts binary, size long, cells binary")
               .dropDuplicates(["key"]), "multisets")

    def both(pairs: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]),
                               side)
        return pairs

    def links_of(pairs: DataFrame) -> DataFrame:
        return both(pairs.select("a", "b"), ["items", "counts"]).mapInArrow(
            _verify_task(similarity), "a binary, b binary")

    def label(keys: DataFrame, roots: DataFrame) -> DataFrame:
        roots = roots.select(F.col("node").alias("key"), "root")
        return keys.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))

    near = F.least("size", "centre.size") >= similarity * F.greatest("size", "centre.size")
    star = members.join(full, "bucket").where((F.col("key") != F.col("centre.key")) & near).select(
        F.col("key").alias("a"), F.col("centre.key").alias("b")).distinct()
    star = cut(both(star, ["cells", "size"]).mapInArrow(_bound_task(similarity), "a binary, b binary"), "star")
    links = cut(links_of(star), "near-links")

    between = cut(apart(label(members, components(links)), full, sets, similarity), "near-links")
    roots = components(links.union(between)).select(F.col("node").alias("key"), "root")

    named = nodes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = named.groupBy("root").agg(F.min("first").alias("head"), F.sum("n").alias("class_size"))
    of = cut(named.select("key", "root").join(classes, "root").select("key", "head", "class_size"), "classes")
    out = rows.select("row", "doc_id", "sha", "key").join(of, "key", "left")
    return out.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
                      .alias("class_id"),
                      F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                      (F.col("key").isNull() | (F.col("row") == F.col("head.row"))).alias("kept"),
                      F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One document of each class, all its columns unchanged (of rows repeated with equal id and text, one)."""
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    return pick(docs, near_duplicates(docs, similarity, shingle).where("kept"), sha, "left_semi")
