"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import conversations, cuckoo, fim, langid, licenses, mixing, neardup, quality_rff, quality_rules, secrets_ledger, sentencepiece_codec, store, topk, warc

#: Fixed value: how the byte-level vocabulary's public definition cuts text before merging.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file: under $EVIDENTIA_TOKENIZERS, or that of the installed package."""
    folder = os.environ.get("EVIDENTIA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), "url", F.col("html").cast("binary").alias("payload"))
    folder = store.new_path(spark, "warc")
    warc.write_archives(pages, folder)
    back = warc.read_archives(spark, folder, with_payload=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets_ledger.scan_history(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets_ledger.BASE))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, secrets_ledger.BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = store.table(quality_rff.measure(read(spark, sf_dir, "documents")), "statistics")
    model = quality_rff.fit(measured, read(spark, sf_dir, "labels"))
    scored = measured.select("doc_id", quality_rff.held_out(F.col("doc_id")).alias("held_out"), quality_rff.scorer(model)("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("families", ",").alias("families"), "n_candidates", "n_unknown", "probability")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_documents(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cuckoo.deduplicate(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", hex_of(F.col("digest")).alias("text_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = {
        "piece": (quality_rules.PieceVocabulary, (vocabulary("piece_bpe_32k.model"),)),
        "byte": (quality_rules.ByteVocabulary, (vocabulary("byte_bpe_50k.tiktoken"), WORD_PARTS)),
    }
    names = list(vocabularies)
    measured = store.table(quality_rules.measure(read(spark, sf_dir, "documents"), vocabularies), "measures")
    judged = quality_rules.judge(measured, quality_rules.bands(measured, names), names)
    columns = [name for name, _ in quality_rules.measured_columns(names)]
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "fertility_failed", *columns[len(quality_rules.COUNTS) :])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(read(spark, sf_dir, "documents"))
    hashed = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (fim.restore(F.col("output"), F.col("form")), "restored_sha256"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    found = conversations.repair(conversations.damage(rows))
    report, hashes = found.report.withColumnRenamed("conv", "_r"), conversations.digests(found.turns).withColumnRenamed("conv", "_h")
    every = rows.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("_r")), "left")
    every = every.join(hashes, F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(read(spark, sf_dir, "embeddings"), 20, "id % 20 = 0")
    return found.select("query_id", "rank", "vec_id", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_source_mixing": op3_source_mixing,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_license_scan": op7_license_scan,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_topk_search": op13_topk_search,
}

def _repair_sql() -> str:
    """The repair as a table of states, filled from the last row; values are costs of ten digits followed by the audit, X: none.  No cheapest repair inserts rows at these costs."""

    def more(value: str, cost: str, letter: str) -> str:
        return f"CASE WHEN {value} = 'X' THEN 'X' ELSE lpad(CAST(CAST({value}[1:10] AS BIGINT) + {cost} AS VARCHAR), 10, '0') || '{letter}' || {value}[11:] END"

    def said(role: str, rest: str) -> str:
        cut = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
        other = "'X'" if role == "s" else more(f"b.{rest}", f"1 + {cut}", "R")
        return f"CASE WHEN fault IN ('blank', 'duplicate') THEN 'X' WHEN role[1:1] = '{role}' THEN {more(f'b.{rest}', cut, 'K')} ELSE {other} END"

    sql = REPAIR_SQL
    for state in "eaus":
        sql = sql.replace(f"DELETED_{state}", more(f"b.{state}", "2", "D"))
    for role, rest in ("ae", "au", "ua", "su"):
        sql = sql.replace(f"SAID_{role}_{rest}", said(role, rest))
    return sql


REPAIR_SQL = r"""
        WITH RECURSIVE coded AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
            FROM conversations
        ), crc AS (
            SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(name)), lambda i: CAST(ascii(substr(name, i + 1, 1)) AS BIGINT))),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS kind
            FROM coded
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM crc JOIN range(2) AS r(copy) ON copy < CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unhex(sha256(text))) AS i,
                   regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
            FROM damaged
        ), judged AS (
            SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                           WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                   lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair
            FROM placed
        ), totals AS (
            SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
            FROM judged GROUP BY conv_id
        ), best AS (
            -- the least (cost, audit) of rows i and later, by what the repaired rest begins with: nothing, assistant, user or system
            SELECT conv_id, n + 1 AS i, '0000000000' AS e, 'X' AS a, 'X' AS u, 'X' AS s FROM totals
            UNION ALL
            SELECT b.conv_id, b.i - 1 AS i, DELETED_e AS e, least(DELETED_a, SAID_a_e, SAID_a_u) AS a, least(DELETED_u, SAID_u_a) AS u, least(DELETED_s, SAID_s_u) AS s
            FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i - 1
        ), chosen AS (
            SELECT t.*, least(b.e, b.u, b.s) AS found FROM totals t JOIN best b ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 1
        ), edited AS (
            SELECT j.*, found[10 + j.i:10 + j.i] AS edit FROM judged j JOIN chosen c ON j.conv_id IS NOT DISTINCT FROM c.conv_id
        ), said AS (
            SELECT conv_id, i, text, edit, role,
                   row_number() OVER (PARTITION BY conv_id ORDER BY i) - max(CASE WHEN edit = 'K' AND role[1:1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS k
            FROM edited WHERE edit <> 'D'
        ), repaired AS (
            SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS rows
            FROM said GROUP BY conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(CAST(found[1:10] AS BIGINT), 0) AS cost, coalesce(found[11:], '') AS audit, sha256(coalesce(rows, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN chosen c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
            LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
            SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
                   list_aggregate(list_transform(range(32), lambda i:
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda j:
                           (((strpos('0123456789abcdef', h[CAST((5 * i + j) // 4 + 1 AS INT)]) - 1) >> CAST(3 - (5 * i + j) % 4 AS INT)) & 1)
                           << CAST(4 - j AS INT))) AS INT), 1)), 'string_agg', '') AS payload_digest
            FROM p
        ), f AS (SELECT payload_digest, payload_bytes, min(page_id) AS first_id FROM d GROUP BY ALL)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM d JOIN f USING (payload_digest, payload_bytes)
    """,
    "op3_source_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
        ), ranked AS (
            SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM sources
        ), filled AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                       - coalesce(sum(2 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                      / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
            FROM ranked WINDOW f AS (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source NULLS LAST)
        ), targets AS (
            SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), max(lvl) OVER () * w) AS target FROM filled
        ), placed AS (
            SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
                   coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        ), epochs AS (
            SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS e FROM placed
        )
        SELECT doc_id, size, source_size, target,
               CAST(e * size + greatest(0, least(size, budget - e * source_size - before)) AS BIGINT) AS taken
        FROM epochs
    """,
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(list_zip(w, w[2:], w[3:], w[4:], w[5:], true), lambda z: concat_ws(' ', z[1], z[2], z[3], z[4], z[5]))) END AS g
            FROM d
        ), classes AS (SELECT min(doc_id) AS rep, list_sort(g) AS g FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
        x AS (SELECT rep, len(g) AS n, unnest(g) AS h FROM classes),
        pairs AS (
            SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep
                AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
        reach(node, root) AS (
            SELECT rep, rep FROM classes
            UNION
            SELECT l.b, r.root FROM reach r JOIN links l ON r.node = l.a AND r.root < l.b
        ), labels AS (SELECT node, min(root) AS label FROM reach GROUP BY node)
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(l.label, s.doc_id) AS component_id,
               coalesce(l.label, s.doc_id) = s.doc_id AS kept
        FROM s LEFT JOIN classes c ON list_sort(s.g) = c.g LEFT JOIN labels l ON l.node = c.rep
    """,
    "op9_exact_dedup": """
        WITH n AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        ), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
    """,
    "op11_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
                   list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), i, 8) AS BIGINT)) AS h
            FROM documents
        ), c AS (
            SELECT *, CAST(len(w) AS BIGINT) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                        WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), p AS (
            SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
               sha256(prefix || middle || suffix) AS restored_sha256
        FROM p
    """,
    "op12_conversation_repair": _repair_sql(),
    "op13_topk_search": """
        WITH v AS (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.rid AS q, q.vec_id AS query_id, v.rid, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
            FROM v q JOIN v ON q.rid <> v.rid AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, rid) AS INT) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
}
