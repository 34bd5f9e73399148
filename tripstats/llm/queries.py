"""The registered ``opN_*`` queries: each applies one operator to its whole table."""
from __future__ import annotations

from pyspark.sql import functions as F

from tripstats.llm import (ann, chaining, ctw, decontaminate, exact_dedup, licenses, merkle, mixing, near_dedup, prefix_trie,
                           quality, suffix_dedup, warc)
from tripstats.llm.common import table


def op1_entropy_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_bagminhash(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_sha256")


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_ctw(spark, sf_dir):
    return ctw.score(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(
        "text_sha256")


def op7_chaining(spark, sf_dir):
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    return licenses.label_documents(table(spark, sf_dir, "documents"))


def op9_quality_knn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_warc(spark, sf_dir):
    return (warc.archive_pages(table(spark, sf_dir, "pages")).where("last")
            .select("page_id", "payload_bytes", F.when(F.col("record_type") == "revisit", F.col("payload_digest"))
                    .otherwise(F.col("digest_so_far")).alias("payload_digest"), "record_type", "refers_to"))


def op11_burst_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_kmeans_tree(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=merkle.tampered())


QUERIES = {"op1_entropy_mix": op1_entropy_mix, "op2_bagminhash": op2_bagminhash,
           "op3_suffix_dedup": op3_suffix_dedup, "op4_exact_dedup": op4_exact_dedup,
           "op5_ctw": op5_ctw, "op6_decontaminate": op6_decontaminate, "op7_chaining": op7_chaining,
           "op8_license_scan": op8_license_scan,
           "op9_quality_knn": op9_quality_knn, "op10_warc": op10_warc, "op11_burst_trie": op11_burst_trie,
           "op12_kmeans_tree": op12_kmeans_tree, "op13_merkle_manifest": op13_merkle_manifest}

def crc32_sql(x: str) -> str:
    """The unsigned crc32 of ASCII text ``x``, bit by bit (DuckDB has no such function)."""
    byte = ("list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
            "lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)")
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({x}) + 1), "
            f"lambda i: ord(substr({x}, i::INTEGER, 1))::BIGINT)), lambda a, b: {byte}), 4294967295::BIGINT)")


def _field_sql(x: str) -> str:
    return f"coalesce(strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """All levels over ``leaves(tree, pos, n, hash)`` and the sides of each node's run."""
    return f"""
        {name} AS (
          SELECT tree, 0::BIGINT AS level, pos, n, hash FROM {leaves}
          UNION ALL
          SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos))
          FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 16, n),
        {name}_sides AS (
          SELECT a.tree, a.level, a.pos, a.n, a.hash,
                 coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
                 coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
          FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 16 = b.pos // 16
          GROUP BY ALL)"""


MERKLE_SQL = f"""
        WITH RECURSIVE d AS (
          SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
                 CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0
                      THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                 END AS other FROM documents),
        p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
                     row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                     count(*) OVER (PARTITION BY source) AS n FROM d),
        low AS (SELECT tree, pos, n, leaf AS hash FROM p),{_tree_sql("lv", "low")},
        tops AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, hash FROM lv WHERE n = 1),{_tree_sql("tv", "tops")},
        walk AS (
          SELECT tree, pos AS me, 0::BIGINT AS level, pos, coalesce(other, leaf) AS h, '' AS proof FROM p
          UNION ALL
          SELECT w.tree, me, w.level + 1, w.pos // 16, sha256(s.l || h || s.r), proof || s.l || s.r
          FROM walk w JOIN lv_sides s ON w.tree = s.tree AND w.level = s.level AND w.pos = s.pos WHERE s.n > 1),
        low_end AS (SELECT DISTINCT ON (tree, me) tree, me, h, proof FROM walk ORDER BY tree, me, level DESC),
        climb AS (
          SELECT tree, me, 0::BIGINT AS level, tree AS pos, h, proof FROM low_end
          UNION ALL
          SELECT w.tree, me, w.level + 1, w.pos // 16, sha256(s.l || h || s.r), proof || s.l || s.r
          FROM climb w JOIN tv_sides s ON w.level = s.level AND w.pos = s.pos WHERE s.n > 1),
        ends AS (SELECT DISTINCT ON (tree, me) tree, me, h, proof FROM climb ORDER BY tree, me, level DESC)
        SELECT doc_id, leaf, t.hash AS subroot, g.hash AS root, sha256(proof) AS proof_sha256, h AS folded_root,
               h = g.hash AS verified
        FROM p JOIN ends e ON p.tree = e.tree AND p.pos = e.me JOIN tops t ON t.pos = p.tree
             JOIN tv g ON g.n = 1"""

TRIE_SQL = f"""
        WITH t AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations
          WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, list(struct_pack(role, text) ORDER BY turn NULLS FIRST,
                     substr(sha256(strlen(role) || ':' || role || text), 1, 32)) AS s FROM t GROUP BY conv_id),
        h AS (SELECT conv_id, s, ({crc32_sql("conv_id::VARCHAR")} % 4)::BIGINT AS h FROM o),
        r AS (SELECT h.conv_id, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s
              FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
        m AS (SELECT conv_id, len(s) AS len, unnest(range(len(s) + 1)) AS depth, s FROM r),
        n AS (SELECT depth, s[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends
              FROM m GROUP BY depth, s[1:depth]),
        k AS (SELECT n.*, p.conv_id AS parent_conv_id,
                     CASE WHEN n.depth = 0 THEN 0
                          ELSE len(regexp_extract_all(n.path[n.depth].text, '[^\x20\x09-\x0D]+')) END AS words,
                     (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path) AS n_children
              FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1])
        SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children,
               count(*) FILTER (b.n_children = 0) AS n_leaves,
               sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens, a.ends AS ends_sha256
        FROM k a JOIN k b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path
        GROUP BY a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends"""

ORACLE = {
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
                   FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op6_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             i AS (SELECT item_id, w, least(len(w), 13) AS n,
                          unnest(range(len(w) - least(len(w), 13) + 1)) AS s FROM b WHERE len(w) > 0),
             win AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS t FROM i),
             l AS (SELECT DISTINCT n FROM win),
             g AS (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS s FROM d, l WHERE len(w) >= n),
             h AS (SELECT DISTINCT g.doc_id, g.s, g.n, win.item_id FROM g JOIN win
                   ON win.n = g.n AND win.t = array_to_string(g.w[g.s + 1:g.s + g.n], ' ')),
             p AS (SELECT doc_id, count(DISTINCT q) AS n_hit
                   FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM h) GROUP BY doc_id),
             m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                   FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
                          min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END
                   AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM d""",
    "op11_burst_trie": TRIE_SQL,
    "op13_merkle_manifest": MERKLE_SQL,
}
