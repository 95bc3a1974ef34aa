"""The queries of this subpackage, for the entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, bpe, chat, filter_audit, language_model, merkle, nearest, ngram_join, packing, pii, quality_classifier, quality_rules, substring_dedup
from .common import documents


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*(F.col(c) for c in ("conv_id", "turn", "role", "text")))
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.read_back(chat.format_windows(told.unionByName(tricky)))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(documents(spark, sf_dir))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.detect(docs, keep_text=False)
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(pii.BASE_KINDS)),
        F.sha2(pii.named(base), 256).alias("base_sha256"),
        pii.named(F.col("spans")).alias("spans"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_path() -> str:
    """The default tokenizer file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir), tokenizer_path())


def op7_nearest_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(documents(spark, sf_dir), byte_tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_windows, op2_ngram_jaccard, op3_pii_spans, op4_quality_classifier, op5_quality_rules, op6_bpe_automaton, op7_nearest_graph, op8_packing, op9_substring_dedup, op10_language_model, op11_filter_audit, op12_merkle_manifest, op13_best_fit)}


_SPLIT = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL2 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
 r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) ON a = d.doc_id"""


def _sql5() -> str:
    """The rules of the table as SQL, over counts that SQL makes its own way."""
    parts = []
    for _, numerator, denominator, comparison, threshold in quality_rules.RULES:
        parts.append(f"{numerator} {comparison} {threshold}" if denominator is None else f"{numerator} * 100 {comparison} {denominator} * {round(threshold * 100)}")
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_SPLIT.format("text")} AS w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
 p AS (SELECT doc_id, i, array_to_string(w[i : i + 4], chr(1)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
 r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p), range(5) t(k) WHERE c > 1 GROUP BY 1),
 m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
 CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, ({" AND ".join(parts)}) AS kept FROM m"""


_SQL9 = f"""WITH d AS (SELECT doc_id, {_SPLIT.format("text")} AS w FROM documents),
 p AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
 x AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM p) WHERE r > 1),
 c AS (SELECT DISTINCT doc_id, i + k AS i FROM x, range(20) t(k)),
 u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
 k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, i) GROUP BY 1)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


_SQL11 = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_SPLIT.format("text")} AS w FROM documents),
 l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY 1),
 m AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT
 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask, coalesce(good, false) AS good, coalesce(bad, false) AS bad FROM d LEFT JOIN l USING (doc_id)),
 g AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(bad) AS bad FROM m GROUP BY ALL),
 f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
 o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
 s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, CAST(list_sum(bits[1 : step - 1]) AS INT) AS earlier FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
 c AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN mask & (bit | coalesce(earlier, 0)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
 CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
 CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
 CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
 CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
 CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(earlier, 0) = 0 THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost FROM g CROSS JOIN s GROUP BY ALL)
 SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM c"""

#: Runs of a level as the digests of its nodes, with a star at a leaf's own place: the star is replaced, or left out for the proof.
_SQL12 = """WITH RECURSIVE v AS (SELECT doc_id, lang, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
 || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS meta, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
 list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
 d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS tree, sha256(meta || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
 CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(meta || coalesce(strlen(small) || ':' || small, '-')) ELSE sha256(meta || coalesce(strlen(text) || ':' || text, '-')) END AS other FROM v),
 p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
 a AS (SELECT 0 AS level, tree, pos, leaf AS h, n FROM p UNION ALL SELECT any_value(level) + 1, tree, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM a WHERE n > 1 GROUP BY tree, pos // 8),
 t AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
 b AS (SELECT 0 AS level, pos, subroot AS h, n FROM t UNION ALL SELECT any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM b WHERE n > 1 GROUP BY pos // 8),
 k AS (SELECT p.doc_id, p.tree, p.leaf, p.other, p.pos, a.level, string_agg(CASE WHEN a.pos = p.pos // (8 ** a.level)::BIGINT THEN '*' ELSE a.h END, '' ORDER BY a.pos) AS run
  FROM p JOIN a ON a.tree = p.tree AND a.n > 1 AND a.pos // 8 = p.pos // (8 ** (a.level + 1))::BIGINT GROUP BY ALL),
 w AS (SELECT p.tree, p.pos, coalesce(list(run ORDER BY level) FILTER (run IS NOT NULL), []) AS runs FROM p LEFT JOIN k USING (tree, pos) GROUP BY ALL),
 x AS (SELECT t.tree, b.level, string_agg(CASE WHEN b.pos = t.pos // (8 ** b.level)::BIGINT THEN '*' ELSE b.h END, '' ORDER BY b.pos) AS run
  FROM t JOIN b ON b.n > 1 AND b.pos // 8 = t.pos // (8 ** (b.level + 1))::BIGINT GROUP BY ALL),
 y AS (SELECT t.tree, t.subroot, coalesce(list(run ORDER BY level) FILTER (run IS NOT NULL), []) AS runs FROM t LEFT JOIN x USING (tree) GROUP BY ALL),
 z AS (SELECT p.doc_id, p.leaf, p.other, y.subroot, (SELECT h FROM b WHERE n = 1) AS root, w.runs || y.runs AS runs FROM p JOIN w USING (tree, pos) JOIN y USING (tree)),
 r AS (SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(runs, ''), '*', '')) AS proof_sha256, list_reduce(list_prepend(other, runs), lambda h, run: sha256(replace(run, '*', h))) AS folded_root FROM z)
 SELECT *, folded_root = root AS verified FROM r"""


def oracle_sql() -> dict[str, str]:
    """Where SQL states the whole result; the others are tested against brute force."""
    return {"op2_ngram_jaccard": _SQL2, "op5_quality_rules": _sql5(), "op9_substring_dedup": _SQL9, "op11_filter_audit": _SQL11, "op12_merkle_manifest": _SQL12}
