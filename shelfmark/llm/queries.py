"""The registered queries of the operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    alignment, byte_bpe, collocations, decontaminate, near_dup, packing, pii, quality, rules, secrets, token_counts, topk,
    toxicity,
)
from shelfmark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    counts = [
        F.size(F.filter("spans", _of_kind(kind))).cast("long").alias(f"n_{kind}")
        for kind in secrets.BASE
    ]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.span_list(base), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    counts = [
        F.size(F.filter("spans", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE
    ]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select(
        "doc_id", *counts, F.sha2(secrets.span_list(base), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"), scores.alias("scores"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
    )
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN, digest=True,
    )
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", decontaminate.hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), F.array_join("items", ",").alias("items"),
    )


def queries() -> dict[str, Query]:
    made = (
        op1_secrets, op2_pii, op3_byte_bpe, op4_topk, op5_rules, op6_toxicity, op7_quality,
        op8_near_dup, op9_packing, op10_token_counts, op11_alignment,
        op12_collocations, op13_decontaminate,
    )
    return {q.__name__: q for q in made}


_TOPK = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT query_id, vec_id, score,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


# Words are lower-cased runs of digits, letters and characters beyond ASCII.
_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_DECONTAMINATE = f"""
WITH items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL
), sized AS (
    SELECT item, w, least(10, len(w)) AS size FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
    FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i FROM sized)
), texts AS (
    SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents
), phrases AS (
    SELECT rn, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
    FROM (
        SELECT rn, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
        FROM texts, (SELECT DISTINCT size FROM sized) WHERE len(w) >= size
    )
), met AS (
    SELECT rn, i, size, item FROM phrases JOIN windows USING (size, phrase)
), hit AS (
    SELECT rn, count(DISTINCT word) AS n_hit
    FROM (SELECT rn, unnest(generate_series(i, i + size - 1)) AS word FROM met) GROUP BY rn
), found AS (
    SELECT rn, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
    FROM met GROUP BY rn
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
    coalesce(items, '') AS items
FROM texts LEFT JOIN hit USING (rn) LEFT JOIN found USING (rn)
"""


_COLLOCATIONS = r"""
WITH pieces AS (
    SELECT lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^\x20\x09]+') AS w
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
        FROM documents
    )
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang
), grams AS (
    SELECT lang, list_slice(w, i, i + k - 1) AS p
    FROM (
        SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k
    )
), counts AS (
    SELECT lang, p, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, p HAVING count(*) >= 100
), held AS (
    SELECT lang, list_slice(p, i, i + len(p) - 2) AS p, max(f) AS f
    FROM (SELECT lang, p, f, unnest([1, 2]) AS i FROM counts WHERE len(p) > 2) GROUP BY 1, 2
), candidates AS (
    SELECT c.lang, c.p, c.f FROM counts c LEFT JOIN held h ON h.lang = c.lang AND h.p = c.p
    WHERE len(c.p) > 1 AND coalesce(100 * h.f < 100 * c.f, true)
), cuts AS (
    SELECT lang, p, f, k, list_slice(p, 1, k) AS lp, list_slice(p, k + 1, len(p)) AS rp
    FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM candidates)
), scores AS (
    SELECT c.lang, c.p, c.f AS a, x.f AS l, y.f AS r, t.n, c.k, 1000 * c.f * t.n // (x.f * y.f) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.lp JOIN counts y ON y.lang = c.lang AND y.p = c.rp
    JOIN totals t ON t.lang = c.lang
), best AS (
    SELECT *, array_to_string(p, ' ') AS phrase FROM scores
    QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
    CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


def oracles() -> dict[str, str]:
    return {"op4_topk": _TOPK, "op12_collocations": _COLLOCATIONS, "op13_decontaminate": _DECONTAMINATE}
