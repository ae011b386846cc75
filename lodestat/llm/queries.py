"""Queries of this subpackage: name to function, and SQL twins where SQL can express the operator."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm import infill, jaccard, language, manifest, packing, pages, pieces, quality, repeats, rules, secret_scan, topk, toxicity
from lodestat.llm.exchange import held_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels, "quality", usable=~held_out(5, 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES["op1_quality_classifier"] = op1_quality_classifier


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


QUERIES["op2_best_fit_packing"] = op2_best_fit_packing


def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


QUERIES["op3_exact_top_k"] = op3_exact_top_k
ORACLES["op3_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    model = language.train(spark.read.parquet(f"{folder}/documents.parquet"), usable=~held_out(5, 0))
    found = language.identify(documents(spark, folder), model)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


QUERIES["op4_language_id"] = op4_language_id


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link(documents(spark, folder), k=3, part=90, whole=100)


QUERIES["op5_ngram_jaccard_join"] = op5_ngram_jaccard_join


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(documents(spark, folder)).select("doc_id", *rules.BASE, "base_failed", "kept", "quality")


QUERIES["op6_quality_rules"] = op6_quality_rules


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels, "toxic", usable=~held_out(3, 1))
    scored = toxicity.score(docs, model)
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans")
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), spans)


QUERIES["op7_toxicity"] = op7_toxicity


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find(documents(spark, folder))

    def of(*kinds: str):
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    base, counts = of("assign", "access", "hex"), [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.as_text(base).cast("binary"), 256).alias("base_sha256"), secret_scan.as_text(F.col("secrets")).alias("spans")
    )


QUERIES["op8_secret_scan"] = op8_secret_scan


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.remove_repeats(documents(spark, folder), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES["op9_substring_dedup"] = op9_substring_dedup
ORACLES["op9_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, s, md5(list_aggregate(w[s : s + 19], 'string_agg', ' ')) AS h FROM starts),
firsts AS (SELECT h, min((doc_id, s)) AS f FROM windows GROUP BY h),
hits AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 20)))) AS cut
         FROM windows JOIN firsts USING (h) WHERE (doc_id, s) > f GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n_words, coalesce(len(cut), 0) AS n_removed,
                CASE WHEN cut IS NULL THEN w
                     ELSE list_filter(w, lambda x, i : NOT list_contains(cut, i)) END AS k
         FROM words LEFT JOIN hits USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    done = pieces.round_trip(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))
    same = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return done.select("doc_id", "n_ids", "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), same)


QUERIES["op10_sentencepiece"] = op10_sentencepiece


def op11_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return pages.extract(table, pages.train(table)).select("page_id", "url", "text", "n_chars")


QUERIES["op11_html_extraction"] = op11_html_extraction


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digests(infill.transform(documents(spark, folder)))


QUERIES["op12_fill_in_middle"] = op12_fill_in_middle
ORACLES["op12_fill_in_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (SELECT *, list_transform(range(4), lambda k : ('0x' || substr(h, 8 * k + 1, 8))::BIGINT) AS d FROM units),
formed AS (
  SELECT *, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
         WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (
  SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s FROM formed)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(coalesce(p, '')) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(coalesce(m, '')) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || coalesce(p, '') || '<S>' || coalesce(s, '') || '<M>' || coalesce(m, '')
              ELSE '<S>' || coalesce(s, '') || '<P>' || coalesce(p, '') || '<M>' || coalesce(m, '') END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*manifest.FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    made = manifest.manifest(docs, tampered={"n_chars": F.col("n_chars") + F.when(hit, 1).otherwise(0)})
    return made.drop("proof")


QUERIES["op13_merkle_manifest"] = op13_merkle_manifest


def _leaf_sql(n_chars: str) -> str:
    texts = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE hit AS (
  SELECT *, n_chars + CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda ch : list_concat([ascii(ch)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
      lambda c, o : CASE WHEN o >= 0 THEN xor(c, o) WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295) % 7 = 0
    THEN 1 ELSE 0 END AS shown
  FROM (SELECT *, coalesce('1' || lang, '0') AS tree FROM documents)),
parts AS (
  SELECT tree, doc_id, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('shown')} AS other FROM hit),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM parts),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, max(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE tree IN (SELECT tree FROM nodes GROUP BY tree HAVING count(*) > 1) GROUP BY tree, pos // 2),
tops AS (SELECT tree, level AS top, h FROM nodes QUALIFY row_number() OVER (PARTITION BY tree ORDER BY level DESC) = 1),
subroots AS (SELECT *, row_number() OVER (ORDER BY tree::BLOB) - 1 AS place FROM tops),
above AS (
  SELECT 0 AS level, place AS pos, h FROM subroots
  UNION ALL
  SELECT max(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM above WHERE (SELECT count(*) FROM above) > 1 GROUP BY pos // 2),
root AS (SELECT level AS top, h AS root FROM above ORDER BY level DESC LIMIT 1),
inside AS (
  SELECT tree, pos AS leaf_at, 0 AS level, pos, other AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT i.tree, leaf_at, i.level + 1, i.pos // 2, sha256(CASE WHEN i.pos % 2 = 1 THEN coalesce(n.h, '') || node ELSE node || coalesce(n.h, '') END),
    proof || coalesce(n.h, '')
  FROM inside i JOIN subroots s ON i.tree = s.tree AND i.level < s.top
  LEFT JOIN nodes n ON n.tree = i.tree AND n.level = i.level AND n.pos = xor(i.pos, 1)),
over_all AS (
  SELECT i.tree, leaf_at, 0 AS level, s.place AS pos, node, proof FROM inside i JOIN subroots s ON i.tree = s.tree AND i.level = s.top
  UNION ALL
  SELECT o.tree, leaf_at, o.level + 1, o.pos // 2, sha256(CASE WHEN o.pos % 2 = 1 THEN coalesce(n.h, '') || node ELSE node || coalesce(n.h, '') END),
    proof || coalesce(n.h, '')
  FROM over_all o JOIN root ON o.level < root.top LEFT JOIN above n ON n.level = o.level AND n.pos = xor(o.pos, 1))
SELECT l.doc_id, l.leaf, s.h AS subroot, root.root, sha256(proof) AS proof_sha256, node AS folded_root, node = root.root AS verified
FROM over_all o JOIN root ON o.level = root.top JOIN leaves l ON l.tree = o.tree AND l.pos = o.leaf_at JOIN subroots s ON s.tree = l.tree
"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
