"""The registered queries of this subpackage and the SQL of those that SQL can express.

Every query reads its whole table and applies one operator with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.llm import chat, language
from rootweave.llm.common import table
from rootweave.llm.decontam import contaminated
from rootweave.llm.fingerprints import hashes, likeness, printed, printed_positions, winnow, with_next
from rootweave.llm.jaccard_join import jaccard_components
from rootweave.llm.line_runs import dedup_lines
from rootweave.llm.near_dups import near_duplicates
from rootweave.llm.packing import pack
from rootweave.llm.prefix_trie import prefix_trie
from rootweave.llm.run_index import without_repeats
from rootweave.llm.token_counts import token_counts
from rootweave.llm.token_files import write_token_files
from rootweave.llm.vector_codes import vector_codes
from rootweave.llm.vocab import default_vocabulary


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of the text whose last third gives way to the next document's start."""
    found = with_next(table(spark, sf_dir, "documents"))
    n = F.char_length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    found = found.withColumn("n_chars", n).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), (n - third).cast("int")), F.substring("next_text", F.lit(1), third))
    )
    found = found.withColumn("edited_fingerprint", winnow(F.col("edited")))
    own, new, later = (hashes(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("fingerprint")).alias("fingerprint"), printed(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"), likeness(own, later).alias("near_next"), printed_positions(F.col("fingerprint")).alias("positions"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_vocabulary("word_bpe_49k.json"), 2048)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"), 400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from raw transcripts of all conversations; learned where crc32(conv_id) mod 4 is not 2."""
    blocks = chat.ordered(chat.raw_blocks(table(spark, sf_dir, "conversations")))
    held = language.held_out(F.col("conv_id"))
    found = chat.parse_transcripts(blocks, chat.fit(blocks, ~held))
    return found.select(
        "conv_id", held.alias("held_out"), "turn", "line", "role", "n_lines",
        F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"),
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_token_files(table(spark, sf_dir, "documents"), default_vocabulary("byte_bpe_50k.json"), 0).index()


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"), 20, 3)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.fit_any(docs, ~held)
    return language.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary("word_bpe_49k.json"), 1, 2048)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_near_dups": r"""
            WITH RECURSIVE words AS (
                SELECT doc_id, regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x20\x09-\x0D]+') AS w
                FROM documents),
            shingles AS (
                SELECT doc_id, unnest(CASE WHEN len(w) >= 2
                    THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                    WHEN len(w) = 1 THEN w ELSE [] END) AS s
                FROM words),
            sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
            shared AS (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
                FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
            links AS (
                SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
                WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
            edge AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            reach(doc_id, other) AS (
                SELECT doc_id, doc_id FROM documents
                UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other),
            least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
            FROM least LEFT JOIN sizes USING (doc_id)""",
        "op7_line_dedup": r"""
            WITH lines AS (
                SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
                FROM documents),
            keyed AS (
                SELECT doc_id, pos, line,
                       translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
                FROM lines),
            common AS (
                SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
                GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
            marked AS (
                SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS lost
                FROM keyed LEFT JOIN common USING (key))
            SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
            FROM marked GROUP BY doc_id""",
        "op11_jaccard_join": r"""
            WITH RECURSIVE words AS (
                SELECT doc_id, regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x20\x09-\x0D]+') AS w
                FROM documents),
            shingles AS (
                SELECT doc_id, unnest(CASE WHEN len(w) >= 4
                    THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
                FROM words),
            sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
            shared AS (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
                FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
            links AS (
                SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
                WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
            edge AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            reach(doc_id, other) AS (
                SELECT doc_id, doc_id FROM documents
                UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id
            FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n""",
        "op12_vector_codes": r"""
            WITH kept AS (
                SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            cut AS (SELECT vec_id, label, p, v[p * 4 + 1 : p * 4 + 4] AS s FROM kept, range(16) t(p)),
            book0 AS (
                SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s FROM cut QUALIFY e < 64),
            near0 AS (
                SELECT cut.p, vec_id, cut.s, min({'d': list_sum(list_transform(list_zip(cut.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS m
                FROM cut JOIN book0 b ON b.p = cut.p GROUP BY ALL),
            mean1 AS (
                SELECT p, m.e AS e, list_transform([sum(s[1]), sum(s[2]), sum(s[3]), sum(s[4])], lambda x: CAST(floor(x / count(*)) AS BIGINT)) AS s
                FROM near0 GROUP BY p, m.e),
            book1 AS (SELECT p, e, coalesce(mean1.s, book0.s) AS s FROM book0 LEFT JOIN mean1 USING (p, e)),
            near1 AS (
                SELECT cut.p, vec_id, cut.s, min({'d': list_sum(list_transform(list_zip(cut.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS m
                FROM cut JOIN book1 b ON b.p = cut.p GROUP BY ALL),
            mean2 AS (
                SELECT p, m.e AS e, list_transform([sum(s[1]), sum(s[2]), sum(s[3]), sum(s[4])], lambda x: CAST(floor(x / count(*)) AS BIGINT)) AS s
                FROM near1 GROUP BY p, m.e),
            book2 AS (SELECT p, e, coalesce(mean2.s, book1.s) AS s FROM book1 LEFT JOIN mean2 USING (p, e)),
            near2 AS (
                SELECT cut.p, vec_id, label, min({'d': list_sum(list_transform(list_zip(cut.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS m
                FROM cut JOIN book2 b ON b.p = cut.p GROUP BY ALL),
            coded AS (
                SELECT vec_id, label, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
                FROM near2 GROUP BY vec_id, label),
            digest AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
            FROM coded, digest""",
        "op13_prefix_trie": r"""
            WITH turns AS (
                SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
                FROM conversations WHERE conv_id IS NOT NULL),
            lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS ts FROM turns GROUP BY conv_id),
            hashed AS (
                SELECT conv_id, ts, CAST(xor(list_reduce([4294967295]::BIGINT[] || list_transform(
                        range(0, 9 * length(CAST(conv_id AS VARCHAR))),
                        lambda i: CASE WHEN i % 9 = 0 THEN ascii(substr(CAST(conv_id AS VARCHAR), CAST(i // 9 + 1 AS INT), 1)) ELSE -1 END),
                    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295) % 4 AS INT) AS h
                FROM lists),
            rebuilt AS (
                SELECT c.conv_id, list_concat(coalesce(b.ts, [])[1 : c.h], c.ts[c.h + 1 :]) AS ts
                FROM hashed c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 20),
            prefixes AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS depth FROM rebuilt),
            nodes AS (
                SELECT ts[1 : depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                       sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(ts) = depth), '')) AS ends_sha256
                FROM prefixes GROUP BY ALL),
            valued AS (
                SELECT *, p[1 : depth - 1] AS up,
                       CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(p[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
                FROM nodes),
            families AS (SELECT up AS p, depth - 1 AS depth, count(*) AS n_children FROM valued WHERE depth > 0 GROUP BY ALL),
            whole AS (SELECT valued.*, coalesce(n_children, 0) AS n_children FROM valued LEFT JOIN families USING (p, depth)),
            subtree AS (
                SELECT a.p, a.depth, sum(b.saved) AS saved_tokens, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves
                FROM whole a JOIN whole b ON b.depth >= a.depth AND b.p[1 : a.depth] = a.p GROUP BY a.p, a.depth)
            SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves,
                   CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
            FROM whole w JOIN subtree s ON s.p = w.p AND s.depth = w.depth
                LEFT JOIN nodes u ON w.depth > 0 AND u.depth = w.depth - 1 AND u.p = w.up""",
    }
