"""Prefix trie of conversations by burst tries.

A turn gets an id, 16 bytes of the SHA-256 of its role and text; a
conversation is the sequence of its turns' ids.  Equal conversations are one
*representative* (their smallest id) with a weight, found by a 128-bit digest
of (place, id), summed per task, and the hash of a group's ids is taken over
its ids in chunks, so a huge group of copies is never gathered.

A container holds the conversations below one trie head, as rows of turns.
A container of more than ``CONTAINER`` turns bursts: its members go to one
head per next turn id, all containers of a depth in one grouped pass, in
which a hot turn is summed map-side.  What stays small is dealt to shards by
head, sorted, and swept into nodes, one container at a time.  A container of
one conversation is a chain and needs no sweep: its turns are its nodes.
Subtree totals of burst heads are summed from the deepest upwards.

A head is named by its smallest member, which no other node of its depth has.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripstats.llm.common import SPACE_WORD, cut
from tripstats.llm.order import numbered

#: Turns that a container holds at most before it bursts.
CONTAINER = 4096
#: Width, in ids, of the chunks in which a group's ids are hashed.
CHUNK = 4096

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(turns: DataFrame) -> DataFrame:
    """``(conv_id, p, tid, words)``: the turns of each conversation, numbered from 1.

    Ordered by turn, null first; turns of equal number follow by their id.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    narrow = cut(turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)).alias("tid"),
        F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row")), "turns")
    placed = numbered(narrow, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tid"), F.col("row")], "turn-order")
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return cut(placed.join(first, "conv_id").select(
        "conv_id", (F.col("at") - F.col("first") + 1).alias("p"), "tid", "words"), "turn-places")


def branched(rows: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations rebuilt as branches: conversation c starts with the first
    h turns of c - c % every and goes on with its own after the h-th, h being
    the unsigned crc32 of its decimal id modulo ``most + 1`` (a negative c has
    SQL's remainder, so bases lie towards 0).

    Returns ``(conv_id, p, tid, words)`` with one row of ``p`` 0 and no id per
    conversation, turnless ones included.  A base has at most ``every``
    branches, which copy at most ``most`` of its turns each.
    """
    c = F.col("conv_id")
    convs = rows.groupBy(c).agg(F.max("p").alias("n"))
    bases = convs.where(c % every == 0).select(c.alias("base"), F.col("n").alias("n_base"))
    convs = cut(convs.withColumns({"h": F.crc32(c.cast("string").cast("binary")) % (most + 1), "base": c - c % every})
                .join(bases, "base", "left")
                .select("conv_id", "base", "h", F.least(F.col("h"), F.coalesce("n_base", F.lit(0).cast("long"))).alias("k")),
                "branches")
    own = (rows.join(convs.select("conv_id", "h", "k"), "conv_id").where("p > h")
           .select("conv_id", (F.col("p") - F.col("h") + F.col("k")).alias("p"), "tid", "words"))
    heads = rows.where((F.col("p") <= most) & (c % every == 0)).select(c.alias("base"), "p", "tid", "words")
    copied = (convs.where("k > 0").select("conv_id", "base", "k").join(heads, "base").where("p <= k")
              .select("conv_id", "p", "tid", "words"))
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("p"), F.lit(b"").alias("tid"),
                         F.lit(0).cast("long").alias("words"))
    return cut(own.union(copied).union(roots), "branched")


def _hash_ids(batches):
    """Chunks ``(a, b, len, ids)`` in order, group by group, to one row per group."""
    key, h, first, n = None, None, 0, 0
    out: list[tuple] = []

    def table():
        got = pa.RecordBatch.from_pylist(
            [dict(zip(("rep", "w", "len", "ends"), r)) for r in out],
            schema=pa.schema([("rep", pa.int64()), ("w", pa.int64()), ("len", pa.int64()), ("ends", pa.string())]))
        out.clear()
        return got

    for batch in batches:
        for a, b, length, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (a, b, length) != key:
                if key is not None:
                    out.append((first, n, key[2], h.hexdigest()))
                key, h, first, n = (a, b, length), hashlib.sha256(), ids[0], 0
            h.update((b"," if n else b"") + ",".join(map(str, ids)).encode())
            n += len(ids)
        if len(out) >= 4096:
            yield table()
    if key is not None:
        out.append((first, n, key[2], h.hexdigest()))
    yield table()


def representatives(rows: DataFrame) -> DataFrame:
    """``(rep, w, len, ends)``: each distinct conversation by its smallest id, with the number of
    its copies, its turns and the hash of its copies' ids."""
    a, b = F.xxhash64("p", "tid"), F.xxhash64(F.lit("second"), "tid", "p")
    made = rows.groupBy("conv_id").agg(F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"), F.max("p").alias("len"))
    chunks = (made.groupBy("a", "b", "len", F.floor(F.col("conv_id") / CHUNK).alias("chunk"))
              .agg(F.sort_array(F.collect_list("conv_id")).alias("ids")))
    return cut(chunks.repartition("a", "b", "len").sortWithinPartitions("a", "b", "len", "chunk")
               .select("a", "b", "len", "ids").mapInArrow(_hash_ids, "rep long, w long, len long, ends string"),
               "representatives")


def sweep(members: list[tuple[int, int, str | None, list[bytes], list[int]]], depth: int) -> list[tuple]:
    """Nodes of one container, from its members in order of their suffixes.

    A member is ``(rep, w, ends, tids, words)``, its turns from the head's
    own on.  The members are sorted; those nodes stay open that the next
    member shares, the others are closed and added to their parents.
    Returns rows of ``NODE``; the head's parent is left null.
    """
    nodes: list[list] = []                    # conv, depth, parent node, convs, children, leaves, saved, ends, words
    path: list[int] = []
    before: list[bytes] = []
    for rep, w, ends, tids, words in sorted(members, key=lambda m: (m[3], m[0])):
        shared = 0
        while shared < min(len(before), len(tids)) and before[shared] == tids[shared]:
            shared += 1
        del path[shared:]
        for i in range(shared, len(tids)):
            nodes.append([rep, depth + i, path[-1] if path else -1, 0, 0, 0, 0, NO_ENDS, words[i]])
            path.append(len(nodes) - 1)
        for i in path:
            nodes[i][0] = min(nodes[i][0], rep)
            nodes[i][3] += w
        nodes[path[-1]][7] = ends
        before = tids
    for node in reversed(nodes):              # children come after their parents
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * node[8]
        if node[2] >= 0:
            up = nodes[node[2]]
            up[4] += 1
            up[5] += node[5]
            up[6] += node[6]
    return [(n[0], n[1], nodes[n[2]][0] if n[2] >= 0 else None, *n[3:8]) for n in nodes]


def _sweep_all(batches):
    """Containers, one after the other: rows ``(head, depth, parent, rep, w, p, tid, words, ends)``
    in order of head, rep and p."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                        ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                        ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
    head, parent, members, out = None, None, [], []

    def closed():
        if head is not None:
            nodes = sweep(members, head[0])
            out.extend((parent if r[2] is None else r[2]) if i == 2 else r[i] for r in nodes for i in range(8))

    def table():
        got = pa.RecordBatch.from_arrays([pa.array(out[i::8], f.type) for i, f in enumerate(schema)], schema=schema)
        out.clear()
        return got

    for batch in batches:
        for at, depth, above, rep, w, p, tid, words, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, at) != head:
                closed()
                head, parent, members = (depth, at), above, []
            if not members or members[-1][0] != rep:
                members.append([rep, w, None, [], []])
            m = members[-1]
            m[2] = ends if ends is not None else m[2]
            m[3].append(tid)
            m[4].append(words)
        if len(out) >= 8 * 8192:
            yield table()
    closed()
    yield table()


def build(rows: DataFrame, container: int = CONTAINER) -> DataFrame:
    """Nodes of the trie over ``rows(conv_id, p, tid, words)`` (``p`` 0 is the root's row of each).

    One row per node: ``NODE``.  Each burst is one pass over the members of
    the oversized containers, written once; there are as many as the depth
    at which conversations part that share more than ``container`` turns.
    """
    reps = representatives(rows)
    turns = cut(rows.join(reps, rows["conv_id"] == reps["rep"]).select(
        "rep", "w", "len", "p", "tid", "words", F.when(F.col("p") == F.col("len"), F.col("ends")).alias("ends")), "rep-turns")
    root, m, held = reps.agg(F.min("rep"), F.count("*"), F.sum(F.col("len") + 1)).first()
    if root is None:
        return rows.sparkSession.createDataFrame([], NODE)

    # members of live heads: rep, w, len, head, depth, parent, and their head's members and turns
    sized = reps.select("rep", "w", "len", F.lit(root).cast("long").alias("head"), F.lit(0).cast("long").alias("depth"),
                        F.lit(None).cast("long").alias("parent"), F.lit(m).alias("m"), F.lit(held).alias("turns"))
    swept, chains, burst, depth = [], [], [], 0
    while True:
        sized = cut(sized, "members")
        big = (F.col("m") > 1) & (F.col("turns") > container)
        chains.append(sized.where("m = 1").drop("m", "turns"))
        swept.append(sized.where((F.col("m") > 1) & ~big).drop("m", "turns"))
        members = sized.where(big).drop("m", "turns")
        if not members.limit(1).count():
            break
        below = members.where(F.col("len") > F.col("depth")).join(
            turns.where(F.col("p") == depth + 1).select("rep", F.col("tid").alias("next")), "rep")
        below = cut(below.select("rep", "w", "len", "head", "next"), "burst")
        groups = cut(below.groupBy("head", "next").agg(F.min("rep").alias("new"), F.count("*").alias("m"),
                                                       F.sum(F.col("len") - depth).alias("turns")), "burst-groups")
        own = turns.where(F.col("p") == depth).select("rep", F.col("words").alias("own"), "ends")
        burst.append(cut(members.join(own, "rep").groupBy("head", "parent").agg(
            F.sum("w").alias("n_convs"), F.max("own").alias("own"), F.max("ends").alias("ends")).join(
            groups.groupBy("head").agg(F.count("*").alias("n_children")), "head", "left"), "burst-heads"))
        depth += 1
        sized = below.join(groups, ["head", "next"]).select(
            "rep", "w", "len", F.col("new").alias("head"), F.lit(depth).cast("long").alias("depth"),
            F.col("head").alias("parent"), "m", "turns")

    nodes = cut(_swept(swept, turns).union(_chained(chains, turns)), "trie-nodes")
    out = [nodes]
    tops = nodes.where(F.col("depth") <= depth)
    for d in range(depth - 1, -1, -1):        # totals of burst heads, from the deepest upwards
        sums = tops.where(F.col("depth") == d + 1).groupBy(F.col("parent_conv_id").alias("head")).agg(
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        heads = cut(burst[d].join(sums, "head", "left").select(
            F.col("head").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
            "n_convs", "n_children", "n_leaves",
            (F.col("below") + (F.col("n_convs") - 1) * F.col("own")).alias("saved_tokens"),
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")), "trie-heads")
        out.append(heads)
        tops = tops.union(heads)
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _swept(frames: list[DataFrame], turns: DataFrame) -> DataFrame:
    """Containers dealt to shards by head, sorted and swept there."""
    held = _all(frames).select("rep", "head", "depth", "parent").join(turns, "rep").where(F.col("p") >= F.col("depth"))
    return (held.select("head", "depth", "parent", "rep", "w", "p", "tid", "words", "ends")
            .repartition("depth", "head").sortWithinPartitions("depth", "head", "rep", "p")
            .mapInArrow(_sweep_all, NODE))


def _chained(frames: list[DataFrame], turns: DataFrame) -> DataFrame:
    """Containers of one conversation: each turn from the head's on is a node with one child at most.

    The sum of saved tokens over the rest of a chain is needed only for
    conversations with copies; Spark's window spills for a long one.
    """
    held = _all(frames).select("rep", "head", "depth", "parent").join(turns, "rep").where(F.col("p") >= F.col("depth"))
    rest = Window.partitionBy("rep").orderBy(F.col("p").desc())
    none = F.lit(0).cast("long")
    saved = held.where("w > 1").withColumn("saved", (F.col("w") - 1) * F.sum("words").over(rest))
    return held.where("w = 1").withColumn("saved", none).unionByName(saved).select(
        F.col("rep").alias("conv_id"), F.col("p").alias("depth"),
        F.when(F.col("p") == F.col("depth"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"), (F.col("p") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, every: int = 20, container: int = CONTAINER) -> DataFrame:
    """The prefix trie of ``turns(conv_id, turn, role, text)`` after branching (``branched``).

    Returns one row per node: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.

    Null role or text counts as empty; rows without a conversation id take
    no part; turns of equal number follow by their content and repeated rows
    are turns of their own; other columns are ignored; no rows give no
    nodes.  A text of any length is read once, for its hash and its words.
    """
    return build(branched(turn_rows(turns), every), container)
