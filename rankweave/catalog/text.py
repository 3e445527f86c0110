"""Text, vocabulary and lexical retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import q6, query, r6, spread, table
from rankweave.functions.text import explode_tokens, tokenize_alnum
from rankweave.operators import lexical as lx
from rankweave.operators import text as tx

SQL_ALNUM = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
SQL_SPACE = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
SQL_STOP = "[" + ", ".join(f"'{w}'" for w in lx.STOP_WORDS) + "]"
SQL_WORDS = r"list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains(" + SQL_STOP + ", w))"


def documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def benchmark(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("T1_tokenize_alnum", f"SELECT doc_id, len({SQL_ALNUM}) AS n_tokens, md5(array_to_string({SQL_ALNUM}, ' ')) AS tokens_md5 FROM documents")
def tokenize(spark, sf):
    tokens = documents(spark, sf).select("doc_id", tokenize_alnum(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def sql_vocab(min_freq, max_size):
    return f"""toks AS (SELECT doc_id, unnest({SQL_ALNUM}) AS token, generate_subscripts({SQL_ALNUM}, 1) - 1 AS pos FROM documents),
vocab AS (SELECT token, freq, 1 + row_number() OVER (ORDER BY freq DESC, token) AS id FROM (SELECT token, count(*) AS freq FROM toks GROUP BY 1) WHERE freq >= {min_freq} QUALIFY id < {max_size})"""


@query("T2_build_vocabulary", f"WITH {sql_vocab(2, 20000)} SELECT token, freq, id FROM vocab")
def vocabulary(spark, sf):
    return tx.build_vocabulary(documents(spark, sf), tokenize_alnum(F.col("text")), min_freq=2)


def encoded(spark, sf, max_size):
    docs = documents(spark, sf)
    tokens = tokenize_alnum(F.col("text"))
    return tx.encode_pad(docs, "doc_id", tokens, tx.build_vocabulary(docs, tokens, 2, max_size))


SQL_ENCODED = """enc AS (SELECT d.doc_id, s.pos, CASE WHEN t.token IS NULL THEN 0 ELSE coalesce(v.id, 1) END AS id
 FROM documents d CROSS JOIN (SELECT unnest(range(16)) AS pos) s LEFT JOIN toks t ON t.doc_id = d.doc_id AND t.pos = s.pos LEFT JOIN vocab v ON v.token = t.token)"""


@query("T3_encode_pad", f"WITH {sql_vocab(2, 20000)}, {SQL_ENCODED} SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM enc GROUP BY 1")
def encode(spark, sf):
    return encoded(spark, sf, 20000).select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("T4_mean_pool", f"""WITH {sql_vocab(2, 20000)}, {SQL_ENCODED},
v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
p AS (SELECT doc_id, dim, avg(CAST(x AS DOUBLE)) AS value FROM enc JOIN v ON v.vec_id = enc.id WHERE id <> 0 GROUP BY 1, 2)
SELECT d.doc_id, CAST(s.dim AS INTEGER) AS dim, {q6('coalesce(value, 0)')} AS value FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS dim) s LEFT JOIN p ON p.doc_id = d.doc_id AND p.dim = s.dim""")
def mean_pool(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pooled = tx.mean_pool(encoded(spark, sf, 20000), "doc_id", vectors, 64)
    return pooled.select("doc_id", F.posexplode("vector").alias("dim", "v")).select("doc_id", "dim", r6("v").alias("value"))


SQL_BM25 = f"""
dt AS (SELECT doc_id, {SQL_WORDS.format(t='text')} AS toks FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(toks)) AS mean_length FROM dt),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(toks) AS length, unnest(toks) AS term FROM dt) GROUP BY 1, 2),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, corpus GROUP BY 1),
post AS (SELECT doc_id, tf.term, idf * tf / (tf + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * length / mean_length)) AS weight FROM tf JOIN idf USING (term), corpus),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({SQL_WORDS.format(t='text')}) AS term FROM benchmark),
bm AS (SELECT query_id, doc_id, sum(weight) AS score FROM qt JOIN post USING (term) GROUP BY 1, 2),
bm_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
"""


@query("T5_bm25_index", f"WITH {SQL_BM25} SELECT doc_id, term, {q6('weight')} AS weight FROM post")
def bm25_index(spark, sf):
    return lx.bm25_index(documents(spark, sf), "text").weighted().withColumn("weight", r6("weight"))


def bm25_ranking(spark, sf, k):
    return lx.bm25_search_docs(documents(spark, sf), benchmark(spark, sf), "text", k)


@query("T6_bm25_search", f"WITH {SQL_BM25} SELECT query_id, doc_id, {q6('score')} AS score, rank FROM bm_ranked WHERE rank <= 10")
def bm25_search(spark, sf):
    return bm25_ranking(spark, sf, 10).select("query_id", "doc_id", r6("score").alias("score"), "rank")


def parts(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("description"))


def part_queries(spark, sf):
    """One query per distinct part name, with a type word that hits the description field."""
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("query_id")).agg(
        F.concat_ws(" ", F.col("p_name"), F.lower(F.min("p_type"))).alias("long"), F.first("p_name").alias("text"))


def _field(name, expr, boost):
    return f"""
{name}_d AS (SELECT p_partkey AS doc_id, {SQL_WORDS.format(t=expr)} AS toks FROM part),
{name}_c AS (SELECT count(*) AS n, avg(len(toks)) AS mean_length FROM {name}_d),
{name}_tf AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(toks) AS length, unnest(toks) AS term FROM {name}_d) GROUP BY 1, 2),
{name}_idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {name}_tf, {name}_c GROUP BY 1),
{name}_s AS (SELECT query_id, doc_id, {boost} * idf * tf / (tf + CAST(1.2 AS DOUBLE) * (0.25 + 0.75 * length / mean_length)) AS s FROM {name}_tf JOIN {name}_idf USING (term) JOIN pq_t USING (term), {name}_c)"""


@query("T7_fielded_bm25", f"""
WITH pq AS (SELECT p_name AS query_id, p_name || ' ' || lower(min(p_type)) AS text FROM part GROUP BY 1),
pq_t AS (SELECT DISTINCT query_id, unnest({SQL_WORDS.format(t='text')}) AS term FROM pq),
{_field('fn', 'p_name', '2.0')}, {_field('fd', "p_brand || ' ' || p_type", '1.0')},
s AS (SELECT query_id, doc_id, sum(s) AS score FROM (SELECT * FROM fn_s UNION ALL SELECT * FROM fd_s) GROUP BY 1, 2)
SELECT query_id, doc_id, {q6('score')} AS score, 0 AS is_exact, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
FROM s QUALIFY rank <= 10""")
def fielded(spark, sf):
    queries = part_queries(spark, sf).select("query_id", F.col("long").alias("text"))
    return lx.fielded_bm25(parts(spark, sf), {"name": 2.0, "description": 1.0}, queries, "text", "name", 10).select(
        "query_id", "doc_id", r6("score").alias("score"), "is_exact", "rank")


@query("T7_exact_name_first", f"""
WITH pq AS (SELECT p_name AS query_id, p_name AS text FROM part GROUP BY 1),
pq_t AS (SELECT DISTINCT query_id, unnest({SQL_WORDS.format(t='text')}) AS term FROM pq),
{_field('fn', 'p_name', '2.0')},
s AS (SELECT query_id, doc_id, sum(s) AS score FROM fn_s GROUP BY 1, 2)
SELECT query_id, doc_id, {q6('score')} AS score, CAST(p_name = query_id AS INTEGER) AS is_exact,
  row_number() OVER (PARTITION BY query_id ORDER BY CAST(p_name = query_id AS INTEGER) DESC, round(score, 9) DESC, doc_id) AS rank
FROM s JOIN part ON p_partkey = doc_id QUALIFY rank <= 10""")
def exact_first(spark, sf):
    return lx.fielded_bm25(parts(spark, sf), {"name": 2.0}, part_queries(spark, sf).select("query_id", "text"), "text", "name", 10).select(
        "query_id", "doc_id", r6("score").alias("score"), "is_exact", "rank")


@query("T8_keyword_overlap_retrieve", f"""
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({SQL_SPACE}) AS term FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({SQL_SPACE}) AS term FROM documents)
SELECT query_id, doc_id, count(*) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank FROM q JOIN d USING (term) GROUP BY 1, 2 QUALIFY rank <= 10""")
def overlap(spark, sf):
    return lx.overlap_topk(benchmark(spark, sf), documents(spark, sf), "text", 10)


@query("T9_substring_search", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'page=2') OR contains(lower(html), 'theheou')")
def substring(spark, sf):
    pages = table(spark, sf, "pages")
    hits = tx.substring_search(pages, " Page=2", ["url"]).select("page_id", "url")
    return hits.union(tx.substring_search(pages, "THEHEOU", ["html"]).select("page_id", "url")).distinct()


KNOWLEDGE = {"tion the": "nouns", "ing": "verbs", "eau": "water", "ung": "german"}


@query("T10_keyword_lookup", """
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'tion the') THEN 'nouns' WHEN contains(lower(text), 'ing') THEN 'verbs' WHEN contains(lower(text), 'eau') THEN 'water'
 WHEN contains(lower(text), 'ung') THEN 'german' ELSE 'nothing known about <' || text || '>, ask for: tion the | ing | eau | ung' END AS answer FROM conversations""")
def lookup(spark, sf):
    return tx.keyword_lookup(table(spark, sf, "conversations"), "text", KNOWLEDGE).select("conv_id", "turn", "answer")


@query("T11_text_profile", f"SELECT doc_id, len({SQL_SPACE}) AS words, length(text) AS characters FROM documents")
def profile(spark, sf):
    return tx.text_profile(documents(spark, sf), "text").select("doc_id", "words", "characters")


@query("T11_corpus_summary", f"SELECT lang, count(*) AS texts, CAST(sum(len({SQL_SPACE})) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS characters, {q6(f'avg(len({SQL_SPACE}))')} AS mean_words FROM documents GROUP BY 1")
def corpus(spark, sf):
    out = tx.corpus_summary(tx.text_profile(table(spark, sf, "documents"), "text"), "lang")
    return out.withColumn("mean_words", r6("mean_words"))


POSITIVE, NEGATIVE = ["the", "is", "and", "le", "la", "der"], ["of", "to", "des", "un", "die", "he"]


def _hits(words):
    return "len(list_intersect(list_distinct(" + SQL_SPACE + "), [" + ", ".join(f"'{w}'" for w in words) + "]))"


SQL_SENT = f"""WITH s AS (SELECT doc_id, {_hits(POSITIVE)} AS p, {_hits(NEGATIVE)} AS n FROM documents),
r AS (SELECT doc_id, p AS n_positive, n AS n_negative, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN p = n THEN 0.5 ELSE CAST(greatest(p, n) AS DOUBLE) / (p + n) END AS confidence FROM s)"""


@query("T12_lexicon_sentiment", f"{SQL_SENT} SELECT doc_id, n_positive, n_negative, sentiment, {q6('confidence')} AS confidence FROM r")
def sentiment(spark, sf):
    return tx.sentiment(documents(spark, sf), "text", POSITIVE, NEGATIVE).drop("text").withColumn("confidence", r6("confidence"))


@query("T12_sentiment_routes", f"{SQL_SENT} SELECT sentiment, count(*) AS texts FROM r GROUP BY 1")
def routes(spark, sf):
    return tx.sentiment(documents(spark, sf), "text", POSITIVE, NEGATIVE).groupBy("sentiment").agg(F.count(F.lit(1)).alias("texts"))


@query("T13_validate_normalize_log", r"""
SELECT conv_id, turn, 'clean> ' || upper(regexp_replace(replace(text, 'ß', 'ss'), '^\s+|\s+$', '', 'g')) AS cleaned, CAST(CASE WHEN length(text) > 0 THEN 0 ELSE 1 END AS INTEGER) AS error_count,
 CASE WHEN length(text) > 0 THEN 'input ok' ELSE 'input empty' END || '; trimmed, upper case; prefix ''clean> ''' AS log FROM conversations""")
def clean(spark, sf):
    out = tx.validate_and_clean(table(spark, sf, "conversations"), "text")
    return out.select("conv_id", "turn", "cleaned", "error_count", F.array_join("log", "; ").alias("log"))


@query("T14_sparse_retrieve", f"""
WITH {SQL_BM25}, qc AS (SELECT query_id, term, ln(1 + count(*)) AS w FROM (SELECT item_id AS query_id, unnest({SQL_WORDS.format(t='text')}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, sum(w * ln(1 + tf)) AS score FROM qc JOIN tf USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, {q6('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def sparse(spark, sf):
    def weights(df, key, out):
        flat = explode_tokens(df, [key], lx.content_tokens(F.col("text")))
        return flat.groupBy(key, "term").agg(F.log1p(F.count(F.lit(1))).alias(out))

    ranked = lx.sparse_topk(weights(benchmark(spark, sf), "query_id", "q_weight"), weights(documents(spark, sf), "doc_id", "d_weight"), 10)
    return ranked.select("query_id", "doc_id", r6("score").alias("score"), "rank")


ASSISTANT = "Answer the user."


@query("T16_instruction_format", f"""
WITH p AS (SELECT u.conv_id, u.turn, coalesce(s.text, '{ASSISTANT}') AS instruction, u.text AS input, a.text AS output
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
 LEFT JOIN (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY 1) s ON s.conv_id = u.conv_id WHERE u.role = 'user'),
f AS (SELECT conv_id, turn, output, '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) ||
 CASE WHEN turn % 2 = 0 THEN 'Query: ' || input || chr(10) || 'Items:' || chr(10) || 'A: ' || output || chr(10) || 'B: none' ELSE input END || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM p)
SELECT conv_id, turn, prompt, prompt || output AS full_text, length(prompt) AS prompt_length FROM f""")
def instructions(spark, sf):
    conv = table(spark, sf, "conversations")
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    reply = conv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    system = conv.where(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system"))
    rows = user.join(reply, ["conv_id", "turn"]).join(system, "conv_id", "left").withColumns({
        "instruction": F.coalesce("system", F.lit(ASSISTANT)),
        "query": F.col("input"),
        "items": F.when(F.col("turn") % 2 == 0, F.array(F.concat(F.lit("A: "), "output"), F.lit("B: none"))),
    })
    return tx.instruction_format(rows).select("conv_id", "turn", "prompt", "full_text", "prompt_length")


@query("T17_join_key_lookup", """
SELECT p_partkey, CASE WHEN k IS NULL THEN 'error' ELSE 'success' END AS status, CASE WHEN k IS NULL THEN 'no entry for ''' || p_name || '''' ELSE CAST(v AS VARCHAR) END AS report
FROM part LEFT JOIN (SELECT lower(upper(p_name)) AS k, min(p_brand) AS v FROM part WHERE p_size > 45 GROUP BY 1) ON k = lower(p_name)""")
def key_lookup(spark, sf):
    dim = table(spark, sf, "part").where(F.col("p_size") > 45).select(F.upper("p_name").alias("name"), "p_brand")
    return tx.status_lookup(table(spark, sf, "part"), "p_name", dim, "name", "p_brand").select("p_partkey", "status", "report")
