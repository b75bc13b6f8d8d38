"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import ann, chat, hard_negatives, line_dedup, main_text, media, merkle, mixing, packing, pii, quality, suffix_dedup
from querent.llm.common import table
from querent.llm.ngram_join import ngram_components


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have Jaccard >= 0.9."""
    return ngram_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with Feistel pseudonyms for personal values."""
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key="demo1key").select("doc_id", "text", "pii", "n_pii")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks and features of all documents, read back from progressive JPEG."""
    return media.digest(media.store(table(spark, sf_dir, "documents")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines of recurring templates."""
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_dropped")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth one."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from the perspective of each participant."""
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "window", "part", "participant", F.col("n_messages").cast("long"), F.col("n_trained").cast("long"), "text", mask.alias("mask"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn by temperature-mixed source weights of at most 1.5 passes."""
    return mixing.mix(table(spark, sf_dir, "documents"), max_repeats=1.5).select("doc_id", "source", "mix_pass", "mix_tokens", "mix_order")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated strings of 400 bytes, and how many of its words repeat in passages of over 50."""
    docs = table(spark, sf_dir, "documents")
    passages = suffix_dedup.repeated_passages(docs, words=51).select(F.col("doc_id").alias("id"), F.col("row").alias("key"), "n_words")
    kept = suffix_dedup.remove_repeats(docs, length=400)
    kept = kept.select("doc_id", "row", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    joined = kept.join(passages, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("key")), "left")
    return joined.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_passage_words"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 hardest negatives of each of the 5 positives of every hundredth vector."""
    emb = table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(emb.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots, proofs and verification of all documents, half of them tampered with."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_quality, op3_pii, op4_packing, op5_media, op6_line_dedup, op7_ann, op8_chat, op9_mixing, op10_suffix_dedup, op11_negatives, op12_main_text, op13_merkle)
}

_ORDER = "turn NULLS FIRST, name, content"
_PLACE = f"own, {_ORDER}"

ORACLE_SQL: dict[str, str] = {
    "op8_chat": f"""
WITH r AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS name, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
w AS (SELECT *, coalesce(CAST(floor(turn / 64) AS BIGINT), -1) AS win FROM r),
p AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY conv_id, win ORDER BY {_ORDER}) - 1) / 64) AS BIGINT) AS part FROM w),
f AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY win, part) AS place, bool_or(name <> 'system') OVER (PARTITION BY conv_id, win, part ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS spoken FROM p),
whole AS (SELECT conv_id, win, part, turn, name, content, 1 AS own FROM f UNION ALL
  SELECT later.conv_id, later.win, later.part, f.turn, f.name, f.content, 0 FROM f JOIN (SELECT DISTINCT conv_id, win, part FROM f WHERE place > 1) AS later ON f.conv_id IS NOT DISTINCT FROM later.conv_id WHERE f.place = 1 AND NOT f.spoken),
who AS (SELECT DISTINCT conv_id, name AS participant FROM p WHERE name <> 'system'),
m AS (SELECT whole.*, participant, name = participant AS train, '<|' || CASE WHEN name = 'system' THEN 'system' WHEN name = participant THEN 'assistant' ELSE 'user name=' || name END || '|>' || chr(10) AS head FROM whole JOIN who ON whole.conv_id IS NOT DISTINCT FROM who.conv_id),
s AS (SELECT *, coalesce(sum(length(head || content) + 8) OVER (PARTITION BY conv_id, win, part, participant ORDER BY {_PLACE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins FROM m)
SELECT conv_id, win AS "window", part, participant, count(*) AS n_messages, count(*) FILTER (train) AS n_trained,
  string_agg(head || content || '<|end|>' || chr(10), '' ORDER BY {_PLACE}) AS text,
  coalesce(string_agg(CASE WHEN train THEN CAST(begins AS BIGINT) || ':' || CAST(begins + length(content) + 7 AS BIGINT) END, ',' ORDER BY {_PLACE}), '') AS mask
FROM s GROUP BY conv_id, win, part, participant""",
    "op11_negatives": """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    # the pages of the tables hold their main text in one article, which SQL can cut out
    "op12_main_text": r"""
WITH b AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages),
d AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39))) AS parts FROM b),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))) AS parts FROM d),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM t""",
    "op13_merkle": """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, *, (list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) & 1) = 1 AS changed FROM documents),
f AS (SELECT *, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
  CASE WHEN changed THEN replace(text, chr(10), '') ELSE text END AS rest FROM d),
l AS (SELECT k, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(rest) || ':' || rest, '-')) AS fold FROM f),
r AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS total FROM l),
low AS (SELECT tree, 0 AS level, place, total AS left_over, leaf AS digest FROM r UNION ALL
  SELECT tree, level + 1, place // 3, (left_over + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM low WHERE left_over > 1 GROUP BY tree, level, place // 3, left_over),
subs AS (SELECT tree, digest AS subroot, count(*) OVER () AS total FROM low WHERE left_over = 1),
high AS (SELECT 0 AS level, tree AS place, total AS left_over, subroot AS digest FROM subs UNION ALL
  SELECT level + 1, place // 3, (left_over + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM high WHERE left_over > 1 GROUP BY level, place // 3, left_over),
runs AS (SELECT a.tree, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM low a JOIN low b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.left_over > 1 GROUP BY a.tree, a.level, a.place),
tops AS (SELECT a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM high a JOIN high b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.left_over > 1 GROUP BY a.level, a.place),
up AS (SELECT k, tree, 0 AS level, place, fold, '' AS proof FROM r UNION ALL
  SELECT k, tree, up.level + 1, up.place // 3, sha256(before || fold || after), proof || before || after FROM up JOIN runs USING (tree, level, place)),
mid AS (SELECT k, tree, max_by(fold, level) AS fold, max_by(proof, level) AS proof FROM up GROUP BY k, tree),
over AS (SELECT k, 0 AS level, tree AS place, fold, proof FROM mid UNION ALL
  SELECT k, over.level + 1, over.place // 3, sha256(before || fold || after), proof || before || after FROM over JOIN tops USING (level, place)),
done AS (SELECT k, max_by(fold, level) AS folded_root, max_by(proof, level) AS proof FROM over GROUP BY k)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM r JOIN subs USING (tree) JOIN done USING (k) CROSS JOIN (SELECT digest AS root FROM high WHERE left_over = 1)""",
}
