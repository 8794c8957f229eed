"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, jaccard_join, line_dedup, mixing, packing, personal_data, sharding, spelling, token_counts, tool_calls, toxicity, vector_join
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_report(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.linked_vectors(table(spark, sf_dir, "embeddings"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_from_turns(table(spark, sf_dir, "conversations"))
    linked = tool_calls.link_calls(calls, results, tool_calls.TURN_SCHEMAS)
    return linked.select(F.col("conv").alias("conv_id"), F.col("call").alias("call_id"), "turn", "level", "position", "status", "problems", "json")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in personal_data.KINDS]
    digest = F.sha2(personal_data.span_text("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, personal_data.span_text("spans").alias("spans"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_vector_join": op3_vector_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_tool_calls": op5_tool_calls,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_personal_data": op11_personal_data,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op3_vector_join": """
        WITH RECURSIVE sound AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
              AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1) USING (vec_id)
        LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)
    """,
    "op4_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op6_mixing": """
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
        keyed AS (
            SELECT *, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size), 1, 15))::BIGINT AS key FROM sized),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
        weighed AS (
            SELECT *, 2.0::DOUBLE * source_size AS bound, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
            FROM sources),
        rated AS (
            SELECT *, bound / w AS ratio,
                   (1.5::DOUBLE * sum(source_size) OVER ()
                    - coalesce(sum(bound) OVER (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                   / sum(w) OVER (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
            FROM weighed),
        aimed AS (
            SELECT source, source_size, coalesce(least(bound, (SELECT arg_min(rate, ratio) FROM rated WHERE rate <= ratio) * w), bound) AS target FROM rated),
        plan AS (
            SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM aimed),
        placed AS (
            SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, floor(p.target - p.epochs * p.source_size)::BIGINT AS rest,
                   coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES)
                            - k.size, 0) AS start
            FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM placed
    """,
    "op9_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i::BIGINT, i::BIGINT + 4), ' ')) AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT doc_id, coalesce(n, 0) AS n_links, component_id, doc_id = component_id AS kept
        FROM documents JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
        LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY 1) USING (doc_id)
    """,
    "op10_line_dedup": """
        WITH split AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
            FROM documents),
        lines AS (SELECT doc_id, line_no, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM split),
        firsts AS (SELECT line, length(line) AS n, min({'d': doc_id, 'l': line_no}) AS first FROM lines WHERE line <> '' GROUP BY line),
        sides AS (
            SELECT line, n, first, n + m AS c, ((n + m - 1) // 2) AS half FROM firsts, (VALUES (0), (1)) AS t (m)),
        keys AS (
            SELECT *, 'l' || left(line, half) AS key FROM sides UNION ALL SELECT *, 'r' || right(line, half) FROM sides),
        pairs AS (
            SELECT DISTINCT a.line AS line, b.line AS other, a.n AS n, b.n AS m, b.first AS near
            FROM keys a JOIN keys b ON a.c = b.c AND a.key = b.key AND b.first < a.first AND abs(a.n - b.n) <= 1),
        close AS (
            SELECT line, min(near) AS near FROM pairs
            WHERE len(list_filter(range(greatest(n, m)), lambda i: left(line, i) = left(other, i)
                AND right(line, n - i - CASE WHEN n >= m THEN 1 ELSE 0 END) = right(other, m - i - CASE WHEN m >= n THEN 1 ELSE 0 END)
                AND n - i - CASE WHEN n >= m THEN 1 ELSE 0 END >= 0 AND m - i - CASE WHEN m >= n THEN 1 ELSE 0 END >= 0)) > 0
            GROUP BY line),
        kept AS (SELECT line, coalesce(least(near, first), first) AS keep FROM firsts LEFT JOIN close USING (line)),
        placed AS (
            SELECT doc_id, line_no, CASE WHEN line = '' THEN {'d': doc_id, 'l': line_no} ELSE keep END AS keep
            FROM lines LEFT JOIN kept USING (line))
        SELECT doc_id, line_no::INT AS line_no, keep.d AS keep_id, keep.l::INT AS keep_no,
               keep.d = doc_id AND keep.l = line_no AS kept
        FROM placed
    """,
    "op12_spelling_variants": """
        WITH RECURSIVE checksums AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) AS r (i)),
        runs AS (
            SELECT coalesce(doc_id::VARCHAR, 'null') AS id,
                   unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
            FROM documents),
        counted AS (SELECT run, hex(encode(id || ':' || run)) AS bytes, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
        summed AS (
            SELECT run, k, xor(4294967295, list_reduce(
                       list_prepend(4294967295, list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
            FROM counted, checksums),
        spelled AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM summed),
        words AS (SELECT word, sum(k)::BIGINT AS n FROM spelled WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
        without AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        pairs AS (
            SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM without a JOIN words b ON a.v = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM without a JOIN words b ON a.v = b.word),
        best AS (
            SELECT word, any_value(n) AS n, count(*) AS n_near, min({'n': -near_n, 'w': near}) AS b FROM pairs GROUP BY 1),
        forms AS (SELECT word, b.w AS form, -b.n AS form_n FROM best WHERE -b.n >= 5 * n),
        chain AS (
            SELECT word, form AS root FROM forms
            UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word)
        SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
        FROM words LEFT JOIN (SELECT word, n_near FROM best) USING (word) LEFT JOIN forms USING (word)
        LEFT JOIN (SELECT * FROM chain WHERE root NOT IN (SELECT word FROM forms)) USING (word)
    """,
    "op13_hard_negatives": """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        negatives AS (
            SELECT p.*, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
            FROM positives p JOIN scored s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
    """,
}
