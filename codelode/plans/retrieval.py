"""Queries of vector, lexical and hybrid retrieval and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import retrieval
from .projection import cte
from .registry import Registry, Tables
from .structure import rounded

R = Registry()
QUERY = "the erthere on and tion"
#: A fixed query vector: every third component is 1, the others -0.5.
VECTOR = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]


def vectors(t: Tables) -> DataFrame:
    return t.base("embeddings").select(F.concat(F.lit("doc:"), F.col("vec_id").cast("string")).alias("stable_key"), F.col("embedding").alias("vector"))


_TOP = f"""v AS (SELECT 'doc:' || vec_id AS stable_key, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT list_transform(range(64), lambda i: CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END::DOUBLE) AS q),
sem AS (SELECT stable_key, list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))) AS score FROM v, q)"""
R.add("g07_cosine_top_k", lambda t: rounded(retrieval.cosine_top_k(vectors(t), VECTOR, 50, 0.0)), f"WITH {_TOP} SELECT stable_key, round(score, 9) AS score FROM sem WHERE score >= 0 ORDER BY sem.score DESC, stable_key LIMIT 50")
R.add("s11_cosine", lambda t: rounded(t.base("embeddings").select("vec_id", text.cosine(F.transform("embedding", lambda x: x.cast("double")), F.array(*[F.lit(x) for x in VECTOR])).alias("score"))),
      f"WITH {_TOP} SELECT substr(stable_key, 5)::BIGINT AS vec_id, round(score, 9) AS score FROM sem")
R.add("s01_token_estimate", lambda t: t.base("documents").select("doc_id", text.token_estimate("text").alias("tokens")), "SELECT doc_id, ceil(strlen(text) / 4.0)::INTEGER AS tokens FROM documents")
_NORMAL = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
R.add("s09_normalized_text", lambda t: t.base("documents").select("doc_id", F.md5(text.normalized_text("text")).alias("digest")), f"SELECT doc_id, md5({_NORMAL.format('text')}) AS digest FROM documents")
_TERMS = "['the', 'erthere', 'on', 'and', 'tion']"
_LEX = f"""lex AS (SELECT *, least(1.0, len(list_filter({_TERMS}, lambda w: list_contains(string_split(norm, ' '), w))) / 5.0::DOUBLE + CASE WHEN contains(norm, '{QUERY}') THEN 0.25 ELSE 0 END) AS lexical
  FROM (SELECT *, {_NORMAL.format('content')} AS norm FROM semantic_documents))"""
R.add("s08_lexical_score", lambda t: rounded(t.semantic_documents.select("stable_key", text.lexical_score(F.col("content"), QUERY).alias("score"))), f"{cte('semantic_documents')}, {_LEX} SELECT stable_key, round(lexical, 9) AS score FROM lex")
R.add("n04_lexical_baseline", lambda t: rounded(retrieval.lexical_baseline(t.semantic_documents, QUERY, 100)), f"{cte('semantic_documents')}, {_LEX} SELECT stable_key, round(lexical, 9) AS score FROM lex WHERE lexical > 0 ORDER BY lexical DESC, stable_key LIMIT 100")


def hybrid(t: Tables, semantic: bool) -> DataFrame:
    probe = retrieval.cosine_top_k(vectors(t), VECTOR, 500) if semantic else None
    return retrieval.hybrid_search(t.semantic_index, None, QUERY, 50, probe, degrees=t.degrees)


_HYBRID = f"""{cte('semantic_documents', 'relationships')}, {_LEX}, {_TOP}, probe AS (SELECT * FROM sem ORDER BY score DESC, stable_key LIMIT 500),
deg AS (SELECT s AS source_id, count(*) AS degree FROM (SELECT source_id AS s FROM relationships UNION ALL SELECT target_id FROM relationships WHERE target_id IS NOT NULL) GROUP BY s),
sig AS (SELECT lex.stable_key, lex.kind, lex.lexical, CASE WHEN kind = 'SYMBOL' THEN coalesce(degree, 0) / (SELECT max(degree) FROM deg)::DOUBLE ELSE 0 END AS graph, coalesce(probe.score, 0) AS semantic FROM lex LEFT JOIN deg ON deg.source_id = lex.source_id LEFT JOIN probe ON probe.stable_key = lex.stable_key)"""
_SHOWN = ["stable_key", "kind", "score", "lexical", "graph"]
R.add("n03_hybrid_search", lambda t: rounded(hybrid(t, True).select(*_SHOWN, "semantic"), 8),
      f"{_HYBRID} SELECT stable_key, kind, round(score, 8) AS score, round(lexical, 8) AS lexical, round(graph, 8) AS graph, round(semantic, 8) AS semantic FROM (SELECT *, least(1, greatest(0, 0.5::DOUBLE * greatest(0, least(1, semantic)) + 0.35::DOUBLE * lexical + 0.15::DOUBLE * graph)) AS score FROM sig WHERE lexical > 0 OR semantic > 0) w ORDER BY w.score DESC, stable_key LIMIT 50")
R.add("d11_hybrid_fallback", lambda t: rounded(hybrid(t, False).select(*_SHOWN), 8),
      f"{_HYBRID} SELECT stable_key, kind, round(score, 8) AS score, round(lexical, 8) AS lexical, round(graph, 8) AS graph FROM (SELECT *, least(1, greatest(0, 0.7::DOUBLE * lexical + 0.3::DOUBLE * graph)) AS score FROM sig WHERE lexical > 0) w ORDER BY w.score DESC, stable_key LIMIT 50")


_SCORE = "least(1, greatest(0, 0.5::DOUBLE * greatest(0, least(1, semantic)) + 0.35::DOUBLE * lexical + 0.15::DOUBLE * graph))"


def budget_sql(by: str, documents: int, tokens: int, share: int) -> str:
    """Recursive expressions that take documents (by, k, stable_key, size) in the order of k while a budget of theirs lasts."""
    return f"""f AS (
      SELECT {by}, 0::BIGINT AS k, 32 AS used, 0 AS n, false AS stopped, NULL::VARCHAR AS stable_key, 0 AS tokens, 0 AS size FROM (SELECT DISTINCT {by} FROM r)
      UNION ALL
      SELECT {by}, r.k, used + CASE WHEN go THEN least(r.size, room) ELSE 0 END, n + go::INTEGER, stop, r.stable_key, CASE WHEN go THEN least(r.size, room) ELSE 0 END, r.size
      FROM (SELECT f.{by}, f.k + 1 AS k, f.used, f.n, f.stopped OR f.n >= {documents} OR least({share}, {tokens} - f.used) <= 0 AS stop, least({share}, {tokens} - f.used) AS room FROM f) s JOIN r USING ({by}, k), LATERAL (SELECT NOT stop AND r.size > 0 AS go))
    SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY k)::INTEGER AS position, stable_key, tokens, tokens < size AS truncated FROM f WHERE tokens > 0"""


_SHOWN_CONTEXT = ["position", "stable_key", "tokens", "truncated"]
R.add("n05_hybrid_context", lambda t: retrieval.hybrid_context(hybrid(t, True), 10, 2048, 512).select(*_SHOWN_CONTEXT),
      f"""{_HYBRID.replace('WITH', 'WITH RECURSIVE', 1)}, r AS (SELECT 1 AS q, row_number() OVER (ORDER BY {_SCORE} DESC, stable_key) AS k, stable_key, ceil(strlen(content) / 4.0)::INTEGER AS size FROM sig JOIN (SELECT stable_key, content FROM lex) USING (stable_key) WHERE lexical > 0 OR semantic > 0 QUALIFY k <= 30), {budget_sql('q', 10, 2048, 512).replace('SELECT q, row_number()', 'SELECT row_number()')}""")
R.add("n05_source_contexts", lambda t: retrieval.hybrid_contexts(t.base("documents").select("source", F.col("doc_id").cast("string").alias("stable_key"), F.col("text").alias("content"), text.lexical_score(F.col("text"), QUERY).alias("score")), ["source"], 12, 4096, 400).select("source", *_SHOWN_CONTEXT),
      f"""WITH RECURSIVE scored AS (SELECT source, doc_id, text, least(1.0, len(list_filter({_TERMS}, lambda w: list_contains(string_split(norm, ' '), w))) / 5.0::DOUBLE + CASE WHEN contains(norm, '{QUERY}') THEN 0.25 ELSE 0 END) AS score FROM (SELECT *, {_NORMAL.format('text')} AS norm FROM documents)),
      r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id::VARCHAR) AS k, doc_id::VARCHAR AS stable_key, ceil(strlen(text) / 4.0)::INTEGER AS size FROM scored QUALIFY k <= 36), {budget_sql('source', 12, 4096, 400)}""")
R.add("n01_semantic_documents", lambda t: retrieval.semantic_documents(t.symbols).select("stable_key", "kind", "tokens", "checksum"),
      f"""{cte('symbols')}, own AS (SELECT *, kind || ' ' || coalesce(qualified_name, name) || coalesce(' ' || signature, '') AS line FROM symbols WHERE NOT external),
      made AS (SELECT 'symbol:' || id AS stable_key, 'SYMBOL' AS kind, substr(line, 1, 3072) AS content FROM own UNION ALL SELECT 'chunk:' || id || ':' || start_line || ':' || end_line, 'CHUNK', substr(line, 1, 3072) FROM own UNION ALL SELECT 'file:' || file_id, 'FILE', substr(string_agg(line, chr(10) ORDER BY line), 1, 8192) FROM own GROUP BY file_id)
      SELECT stable_key, kind, ceil(strlen(content) / 4.0)::INTEGER AS tokens, sha256(content) AS checksum FROM made""")
_INDEXED = "SELECT stable_key, CASE WHEN length(content) % 11 = 0 THEN sha256(content || '!') ELSE checksum END AS checksum FROM semantic_documents WHERE length(content) % 13 <> 5"
R.add("d10_vector_reuse", lambda t: retrieval.reuse_vectors(t.semantic_documents.filter("length(content) % 17 <> 3"), t.semantic_documents.filter("length(content) % 13 <> 5").withColumn("checksum", F.when(F.length("content") % 11 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("checksum")))),
      f"{cte('semantic_documents')}, old AS ({_INDEXED}), new AS (SELECT stable_key, checksum FROM semantic_documents WHERE length(content) % 17 <> 3) SELECT coalesce(new.stable_key, old.stable_key) AS stable_key, CASE WHEN new.checksum IS NULL THEN 'REMOVED' WHEN old.checksum IS NULL THEN 'ADDED' WHEN new.checksum = old.checksum THEN 'REUSED' ELSE 'CHANGED' END AS status FROM new FULL JOIN old ON new.stable_key = old.stable_key")
R.add("h04_set_difference", lambda t: t.semantic_documents.select("stable_key").subtract(vectors(t).select("stable_key")), f"{cte('semantic_documents')} SELECT stable_key FROM semantic_documents EXCEPT SELECT 'doc:' || vec_id FROM embeddings")
R.add("e26_index_size", lambda t: retrieval.index_size(t.semantic_documents, 64), f"{cte('semantic_documents')} SELECT sum(strlen(content) + 256)::BIGINT AS bytes, count(*) AS documents FROM semantic_documents")


def judged(t: Tables, worse: bool = False) -> DataFrame:
    """Ten bounded result lists, one a label: the first 200 vectors by one component among those of the label and the next; the label's own are relevant."""
    e = t.base("embeddings").select(F.col("label").alias("query_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("key"), F.element_at("embedding", 2 if worse else 1).cast("double").alias("score"))
    seen = e.select(F.explode(F.array(F.col("query_id"), F.col("query_id") - 1)).alias("query_id"), "key", "score").join(F.broadcast(e.select("query_id").distinct()), "query_id", "left_semi")
    return retrieval.retrieval_metrics(retrieval.rank_rows(seen, most=200), e.select("query_id", "key"), 10)


def _judged(name: str, place: int) -> str:
    return f"""e{name} AS (SELECT label AS query_id, 'v' || vec_id AS key, embedding[{place}]::DOUBLE AS score FROM embeddings),
n{name} AS (SELECT query_id, count(DISTINCT key) AS relevant FROM e{name} GROUP BY query_id),
r{name} AS (SELECT * FROM (SELECT l.query_id, e.key, e.query_id = l.query_id AS hit, row_number() OVER (PARTITION BY l.query_id ORDER BY e.score DESC, e.key) AS rank FROM (SELECT DISTINCT query_id FROM e{name}) l JOIN e{name} e ON e.query_id IN (l.query_id, l.query_id + 1)) WHERE rank <= 200),
s{name} AS (SELECT query_id, count_if(hit AND rank <= 10)::BIGINT AS found, 1.0::DOUBLE / min(rank) FILTER (WHERE hit) AS mrr, sum(CASE WHEN hit AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r{name} GROUP BY query_id),
m{name} AS (SELECT n{name}.query_id, relevant, coalesce(found, 0) AS found, coalesce(found, 0) / relevant::DOUBLE AS recall, coalesce(mrr, 0) AS mrr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, relevant) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM n{name} LEFT JOIN s{name} USING (query_id))"""


R.add("e19_retrieval_metrics", lambda t: rounded(judged(t)), f"WITH {_judged('a', 1)} SELECT query_id, relevant, found, round(recall, 9) AS recall, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg FROM ma")
R.add("e20_metric_gain", lambda t: rounded(retrieval.metric_gain(judged(t), judged(t, True))),
      f"WITH {_judged('a', 1)}, {_judged('b', 2)} SELECT " + ", ".join(f"round((SELECT avg({c}) FROM mb) - (SELECT avg({c}) FROM ma), 9) AS {c}_gain" for c in ("recall", "mrr", "ndcg")))
