"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urltree import Rule, judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), [Rule.parse(line) for line in RULES])


def op2_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY), with_ids=False)


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .preference import branched, format_turns, spans_as_text

    pairs = format_turns(branched(table(spark, sf_dir, "conversations")))
    return pairs.withColumn("chosen_mask", spans_as_text(pairs.chosen_mask)).withColumn("rejected_mask", spans_as_text(pairs.rejected_mask))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langmix import identify

    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "languages", "proportions")


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), radius=4, words=4)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .puquality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixhash import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


def op9_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import grade_toxicity

    return grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bestfit import pack_best_fit

    return pack_best_fit(table(spark, sf_dir, "documents"), vocabulary_path(WORD_VOCABULARY), with_ids=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hardneg import mine, mixed_labels

    return mine(mixed_labels(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_url_templates, op2_ffd_packing, op3_preference_pairs, op4_language_mixture, op5_simhash_bktree,
            op6_token_counts, op7_pu_quality, op8_prefix_hashes, op9_fm_decontamination, op10_ordinal_toxicity,
            op11_tsqr_whitening, op12_best_fit_packing, op13_hard_negatives,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_preference_pairs": OP3_SQL, "op9_fm_decontamination": OP9_SQL, "op13_hard_negatives": OP13_SQL}


OP3_SQL = """
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT conv_id, n FROM c WHERE pos = 1),
cuts AS (
  SELECT a.conv_id, CAST('0x' || substr(md5(CAST(a.conv_id AS VARCHAR)), 1, 8) AS BIGINT) % greatest(least(a.n, b.n) - 1, 1) + 1 AS keep
  FROM lengths a LEFT JOIN lengths b ON b.conv_id = xor(a.conv_id, 1)),
t AS (
  SELECT conv_id AS pair_id, 0 AS side, role, text, pos FROM c
  UNION ALL SELECT conv_id, 1, role, text, pos FROM c JOIN cuts USING (conv_id) WHERE pos <= keep
  UNION ALL SELECT cuts.conv_id, 1, role, text, row_number() OVER (PARTITION BY cuts.conv_id ORDER BY pos) + keep FROM c JOIN cuts ON cuts.conv_id = xor(c.conv_id, 1) WHERE pos > keep),
ids AS (SELECT DISTINCT pair_id FROM t),
diff AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.pos, b.pos)) AS pos
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos
  WHERE a.pos IS NULL OR b.pos IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY 1),
longest AS (SELECT pair_id, max(pos) AS pos FROM t GROUP BY 1),
common AS (SELECT ids.pair_id, coalesce(diff.pos - 1, longest.pos) AS n FROM ids JOIN longest USING (pair_id) LEFT JOIN diff USING (pair_id)),
r AS (
  SELECT pair_id, side, pos, role, pos <= n AS shared, role || ': ' || text || chr(10) AS line, length(role) + 2 AS head,
         sum(length(role || ': ' || text || chr(10))) OVER (PARTITION BY pair_id, side, pos <= n ORDER BY pos) AS upto
  FROM t JOIN common USING (pair_id))
SELECT common.pair_id, CAST(any_value(common.n) AS INTEGER) AS n_common,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (shared AND side = 0), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (NOT shared AND side = 0), '') AS chosen,
  coalesce(string_agg((upto - length(line) + head) || '-' || upto, ',' ORDER BY pos) FILTER (NOT shared AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(line, '' ORDER BY pos) FILTER (NOT shared AND side = 1), '') AS rejected,
  coalesce(string_agg((upto - length(line) + head) || '-' || upto, ',' ORDER BY pos) FILTER (NOT shared AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM common LEFT JOIN r ON r.pair_id = common.pair_id GROUP BY common.pair_id
"""

_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (SELECT row_, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
found AS (
  SELECT row_, i, p.k, item_id FROM (SELECT row_, i, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM places) p
  JOIN windows ON windows.phrase = p.phrase AND windows.k = p.k),
hits AS (SELECT row_, count(DISTINCT at_) AS n_hit FROM (SELECT row_, unnest(range(i, i + k)) AS at_ FROM found) GROUP BY 1),
items AS (SELECT row_, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row_) LEFT JOIN items USING (row_)
"""

OP13_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS row_, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.row_ AS anchor, a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM e a JOIN e ON a.vec_id % 100 = 0 AND e.vec_id <> a.vec_id),
p AS (SELECT anchor, anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
