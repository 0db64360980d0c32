"""The registered queries: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aislewise.llm import collocations, decision_lists, decontaminate, embeddings, html_text, lengths, licenses, merkle, pieces, quality, simhash, toxicity, warc
from aislewise.llm.common import table
from aislewise.llm.sampling import remainder


def op1_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(lengths.token_lengths(table(spark, sf_dir, "documents"))))


def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(4) != 2)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


def op8_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.tag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(5) != 0)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "spans")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


def op10_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.vocabulary())


def op11_top_order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decision_lists.sift(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(4) != 2)
    return found.select("doc_id", *decision_lists.COUNTS, "base_failed", "kept")


def op13_postorder_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"), remainder(5) == 0)


_OPERATORS = (
    op1_best_region,
    op2_length_histogram,
    op3_simhash_anchors,
    op4_conditional_compression,
    op5_rotation_codes,
    op6_positional_index,
    op7_quality_ftrl,
    op8_toxic_spans,
    op9_warc_revisits,
    op10_nbest_pieces,
    op11_top_order_rollup,
    op12_decision_list,
    op13_postorder_log,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

# Words as the contract cuts them; a backslash reaches the regular expression as written.
_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

# Unsigned CRC-32 of the id written in digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


def _framed(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _tree_sql(name: str, levels: int = 6) -> str:
    """Nodes of the trees whose leaves are ``name_0(tree, seq, size, digest)``, and each node's neighbours in its run.

    ``name_way(tree, seq, left0, right0, ...)`` has the digests before and after a leaf and the nodes above it; null above the root.
    """
    nodes = "".join(
        f"""{name}_{k + 1} AS (
            SELECT tree, seq // 16 AS seq, any_value(size) AS size, sha256(string_agg(digest, '' ORDER BY seq)) AS digest
            FROM {name}_{k} WHERE size > {16**k} GROUP BY tree, seq // 16
        ),
        {name}_run{k} AS (
            SELECT a.tree, a.seq, coalesce(string_agg(b.digest, '' ORDER BY b.seq) FILTER (b.seq < a.seq), '') AS before,
                coalesce(string_agg(b.digest, '' ORDER BY b.seq) FILTER (b.seq > a.seq), '') AS after
            FROM {name}_{k} a JOIN {name}_{k} b ON a.tree = b.tree AND a.seq // 16 = b.seq // 16 WHERE a.size > {16**k} GROUP BY a.tree, a.seq
        ),
        """
        for k in range(levels)
    )
    columns = ", ".join(f"r{k}.before AS before{k}, r{k}.after AS after{k}" for k in range(levels))
    joins = " ".join(f"LEFT JOIN {name}_run{k} r{k} ON r{k}.tree = l.tree AND r{k}.seq = l.seq // {16**k}" for k in range(levels))
    roots = " UNION ALL ".join(
        f"SELECT tree, digest FROM {name}_{k} WHERE size <= {16**k}" + (f" AND size > {16 ** (k - 1)}" if k else "") for k in range(levels + 1)
    )
    return f"{nodes}{name}_way AS (SELECT l.tree, l.seq, {columns} FROM {name}_0 l {joins}), {name}_root AS ({roots})"


_OTHERS = " || ".join(f"coalesce({way}.before{k} || {way}.after{k}, '')" for way in ("own", "over") for k in range(6))
_LEAF = " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# One step of the way up at a time: nested in one expression each digest would be written out twice.
_STEPS = ", ".join(
    f"""step{k + 1} AS (SELECT * REPLACE (CASE WHEN {way}_before{k % 6} IS NULL THEN node ELSE sha256({way}_before{k % 6} || node || {way}_after{k % 6}) END AS node)
        FROM step{k})"""
    for k, way in enumerate(["own"] * 6 + ["over"] * 6)
)
_SIDES = ", ".join(f"{way}.{side}{k} AS {way}_{side}{k}" for way in ("own", "over") for side in ("before", "after") for k in range(6))

ORACLE = {
    "op11_top_order_rollup": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        places AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM w, (VALUES (1), (2), (3)) AS s(size)),
        f AS (SELECT lang, size, w[k : k + size - 1] AS gram, count(*) AS n FROM places GROUP BY ALL),
        cuts AS (
            SELECT c.lang, c.size, c.gram, c.n AS a, k, x.n AS l, y.n AS r, (1000000::HUGEINT * c.n * c.n) // (x.n::HUGEINT * y.n) AS score
            FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1 AND n >= 10) c
            JOIN f x ON x.lang = c.lang AND x.gram = c.gram[1 : k] JOIN f y ON y.lang = c.lang AND y.gram = c.gram[k + 1 :]
        ),
        weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1),
        kept AS (
            SELECT * FROM weakest s WHERE NOT EXISTS (
                SELECT 1 FROM weakest t WHERE t.lang = s.lang AND t.size = 3 AND s.size = 2 AND (t.gram[1:2] = s.gram OR t.gram[2:3] = s.gram) AND 100 * t.a >= 50 * s.a
            )
        ),
        ranked AS (SELECT *, array_to_string(gram, ' ') AS phrase FROM kept)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang) USING (lang)
        QUALIFY rank <= 2000
    """,
    "op13_postorder_log": f"""
        WITH rows AS (
            SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_LEAF} || {_framed("text")}) AS leaf,
                CASE WHEN {_CRC} % 5 = 0 THEN sha256({_LEAF} || {_framed(_LOWER)}) END AS other
            FROM documents
        ),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS seq, count(*) OVER (PARTITION BY tree) AS size FROM rows
        ),
        s_0 AS (SELECT tree, seq, size, leaf AS digest FROM placed), {_tree_sql("s")},
        t_0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS seq, count(*) OVER () AS size, digest, tree AS source FROM s_root), {_tree_sql("t")},
        step0 AS (
            SELECT doc_id, leaf, t_0.digest AS subroot, t_root.digest AS root, sha256({_OTHERS}) AS proof_sha256, coalesce(other, leaf) AS node, {_SIDES}
            FROM placed JOIN s_way own ON own.tree = placed.tree AND own.seq = placed.seq JOIN t_0 ON t_0.source = placed.tree
                JOIN t_way AS over ON over.seq = t_0.seq CROSS JOIN t_root
        ),
        {_STEPS}
        SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM step12
    """,
    "op5_rotation_codes": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ),
        reached(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN l ON r.b = l.a)
        SELECT a AS vec_id, (SELECT count(*) FROM l WHERE l.a = reached.a) AS n_links, min(b) AS component_id, a = min(b) AS kept
        FROM reached GROUP BY a
    """,
    "op6_positional_index": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, w[k : k + 12] AS phrase
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)
        ),
        sizes AS (SELECT DISTINCT len(phrase) AS size FROM win),
        places AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes),
        found AS (
            SELECT doc_id, p, size, item_id FROM (SELECT doc_id, p, size, w[p : p + size - 1] AS phrase FROM places) JOIN win USING (phrase)
        ),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS k FROM found) GROUP BY doc_id),
        owners AS (
            SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)
    """,
    "op9_warc_revisits": """
        WITH p AS (
            SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (SELECT payload_digest, min(page_id) AS source FROM p GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id > source THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id > source THEN source END AS refers_to,
            replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url
        FROM p JOIN f USING (payload_digest)
    """,
}
