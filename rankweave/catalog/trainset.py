"""Training-set construction queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rankweave.catalog.base import query, sql_hash, sql_md5, table
from rankweave.catalog.retrieval import SQL_HASH_TOKENS, SQL_V, sql_hash_vectors, vectors
from rankweave.catalog.text import SQL_BM25, SQL_SPACE, bm25_ranking
from rankweave.functions.hooks import encode_texts
from rankweave.operators import lexical as lx
from rankweave.operators import trainset as ts


def faq(spark, sf):
    questions = F.when(F.col("p_size") > 40, F.array().cast("array<string>")).when(F.col("p_size") < 5, F.lit(None)).otherwise(F.array("p_name", "p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("articleID"), F.concat_ws(" ", "p_brand", "p_type").alias("content"), questions.alias("similar_questions"))


@query("N1_faq_anchor", "SELECT p_partkey AS \"articleID\", p_brand || ' ' || p_type AS content, p_name AS anchor FROM part WHERE p_size BETWEEN 5 AND 40")
def anchors(spark, sf):
    return ts.faq_anchors(faq(spark, sf)).select("articleID", "content", "anchor")


def vector_faq(spark, sf):
    v = vectors(spark, sf)
    n = v.agg(F.count(F.lit(1))).scalar()
    right = v.select(F.col("id").alias("next"), F.col("vec").alias("positive_vec"))
    left = v.select("id", F.col("label").alias("article_id"), F.col("vec").alias("anchor_vec")).withColumn("next", (F.col("id") + 1) % n)
    return left.join(right, "next").drop("next")


SQL_MINED = f"""{SQL_V}, f AS (SELECT a.id, a.label AS article_id, a.vec AS av, b.vec AS pv FROM v a JOIN v b ON b.id = (a.id + 1) % a.n),
s AS (SELECT q.id, c.id AS item, c.article_id AS ca, q.article_id AS qa, list_dot_product(q.av, c.pv) AS score, list_dot_product(q.av, q.pv) AS own FROM f q, f c),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, item) AS r FROM s QUALIFY r <= 20),
h AS (SELECT id, item, row_number() OVER (PARTITION BY id ORDER BY r) AS o FROM t WHERE ca <> qa AND round(score, 9) > round(own, 9) QUALIFY o <= 5)"""


@query("N2_mine_hard_negatives", f"WITH {SQL_MINED} SELECT f.id, coalesce(string_agg(CAST(item AS VARCHAR), ',' ORDER BY o), '') AS negatives FROM f LEFT JOIN h ON h.id = f.id GROUP BY 1")
def mined(spark, sf):
    out = ts.mine_hard_negatives(vector_faq(spark, sf))
    return out.select("id", F.array_join(F.transform("negatives", lambda x: x.cast("string")), ",").alias("negatives"))


def text_faq(spark, sf):
    """The FAQ rows of ``vector_faq`` with texts: a document's first words ask for it, its whole text answers."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    n = vectors(spark, sf).agg(F.count(F.lit(1))).scalar()
    asked = texts.select("id", F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("anchor"))
    answer = texts.select(F.col("id").alias("next"), F.col("text").alias("positive"))
    rows = vector_faq(spark, sf).withColumn("next", (F.col("id") + 1) % n)
    blank = F.lit("")
    return rows.join(asked, "id", "left").join(answer, "next", "left").drop("next").withColumns({c: F.coalesce(c, blank) for c in ("anchor", "positive")})


@query("N2_hard_negative_rows", f"""WITH {SQL_MINED}, t2 AS (SELECT f.id, coalesce(a.text, '') AS qt, coalesce(b.text, '') AS pt FROM f LEFT JOIN documents a ON a.doc_id = f.id LEFT JOIN documents b ON b.doc_id = (f.id + 1) % (SELECT count(*) FROM v))
SELECT t2.id, array_to_string(list_slice(string_split(qt, ' '), 1, 5), ' ') AS anchor, t2.pt AS positive, coalesce(string_agg(n.pt, chr(31) ORDER BY o), '') AS negatives
FROM t2 LEFT JOIN (SELECT h.id, o, x.pt FROM h JOIN t2 x ON x.id = h.item) n ON n.id = t2.id GROUP BY t2.id, qt, t2.pt""")
def mined_rows(spark, sf):
    out = ts.hard_negative_rows(text_faq(spark, sf))
    return out.select("id", "anchor", "positive", F.array_join("negatives", "\x1f").alias("negatives"))


def listed(spark, sf):
    """Rows with 0 to 3 negatives taken from the row's own columns."""
    p = table(spark, sf, "part")
    few = F.slice(F.array("p_name", "p_type", "p_brand"), F.lit(1), F.pmod("p_partkey", F.lit(4)).cast("int"))
    return p.select("p_partkey", F.col("p_name").alias("anchor"), F.col("p_type").alias("positive"), few.alias("negatives"))


@query("N3_pad_negatives", """
WITH r AS (SELECT p_partkey, p_type, list_slice([p_name, p_type, p_brand], 1, p_partkey % 4) AS neg FROM part)
SELECT p_partkey, array_to_string(list_transform(range(5), lambda i: CASE WHEN len(neg) = 0 THEN p_type ELSE neg[i % greatest(len(neg), 1) + 1] END), '|') AS negatives FROM r""")
def padded(spark, sf):
    return ts.pad_negatives(listed(spark, sf), 5).select("p_partkey", F.array_join("negatives", "|").alias("negatives"))


@query("N4_triplet_zip_cycle", """
WITH r AS (SELECT p_partkey, [p_name, p_brand, p_type] AS pos, list_slice([p_name, p_type], 1, p_partkey % 3) AS neg FROM part), e AS (SELECT *, unnest(range(3)) AS i FROM r WHERE len(neg) > 0)
SELECT p_partkey, CAST(i AS INTEGER) AS i, pos[i + 1] AS positive, neg[i % len(neg) + 1] AS negative FROM e""")
def zipped(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.array("p_name", "p_brand", "p_type").alias("pos"), F.slice(F.array("p_name", "p_type"), F.lit(1), F.pmod("p_partkey", F.lit(3)).cast("int")).alias("neg"))
    return ts.zip_cycle(p, "pos", "neg")


@query("N5_passage_to_triplets", """
WITH l AS (SELECT l_orderkey AS query, p_name || ' #' || l_linenumber AS passage, l_returnflag = 'R' AS sel, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_linenumber, p_name || ' #' || l_linenumber) AS r FROM lineitem JOIN part ON p_partkey = l_partkey),
w AS (SELECT query, max(passage) FILTER (sel AND r = 1) AS positive, max(passage) FILTER (NOT sel AND r = 1) AS negative_1, max(passage) FILTER (NOT sel AND r = 2) AS negative_2, max(passage) FILTER (NOT sel AND r = 3) AS negative_3,
 max(passage) FILTER (NOT sel AND r = 4) AS negative_4, max(passage) FILTER (NOT sel AND r = 5) AS negative_5 FROM l GROUP BY 1)
SELECT * FROM w WHERE positive IS NOT NULL AND negative_5 IS NOT NULL""")
def passages(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = lines.join(names, "l_partkey").select(
        F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("idx"), (F.col("l_returnflag") == "R").cast("int").alias("is_selected"),
        F.concat("p_name", F.lit(" #"), F.col("l_linenumber").cast("string")).alias("passage"))
    return ts.passage_triplets(rows)


def _pick(size, picks, draw):
    low, high = f"(j * {size} // {picks})", f"((j + 1) * {size} // {picks})"
    return f"CASE WHEN {size} >= {picks} THEN {low} + {draw} % greatest({high} - {low}, 1) ELSE {draw} % greatest({size}, 1) END"


@query("N6_class_triplets", f"""
WITH p AS (SELECT DISTINCT p_type AS class, p_brand || ' ' || p_name AS text FROM part),
t AS (SELECT text, row_number() OVER (ORDER BY {sql_md5(7, 'text')}) - 1 AS g FROM (SELECT DISTINCT text FROM p)),
c AS (SELECT DISTINCT class FROM p),
o AS (SELECT c.class, t.text, t.g, p.text IS NOT NULL AS inside FROM c CROSS JOIN t LEFT JOIN p ON p.class = c.class AND p.text = t.text),
pos AS (SELECT class, text, row_number() OVER (PARTITION BY class ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY class) AS n FROM o WHERE inside),
neg AS (SELECT class, text, row_number() OVER (PARTITION BY class ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY class) AS n FROM o WHERE NOT inside),
rows AS (SELECT p_partkey, p_type AS class, p_brand || ' ' || p_name AS text FROM part),
pd AS (SELECT *, {sql_hash('7positive', 'class', 'p_partkey', 'j')} AS draw FROM (SELECT rows.p_partkey, pos.*, unnest(range(5)) AS j FROM pos JOIN rows USING (class, text))),
pa AS (SELECT p_partkey, class, text AS anchor, j, CASE WHEN n = 1 THEN i ELSE {_pick('(n - 1)', 5, 'draw')} + CAST({_pick('(n - 1)', 5, 'draw')} >= i AS BIGINT) END AS at FROM pd),
nd AS (SELECT a.*, {sql_hash('7negative', 'class', 'p_partkey', 'j')} AS draw FROM (SELECT rows.p_partkey, rows.class, rows.text, unnest(range(20)) AS j, m.n AS n FROM rows JOIN (SELECT class, any_value(n) AS n FROM neg GROUP BY 1) m ON m.class = rows.class) a),
na AS (SELECT p_partkey, class, text AS anchor, j, {_pick('n', 20, 'draw')} AS at FROM nd)
SELECT p_partkey, pa.class, anchor, 'positive' AS kind, j, pos.text FROM pa JOIN pos ON pos.class = pa.class AND pos.i = pa.at
UNION ALL SELECT p_partkey, na.class, anchor, 'negative', j, neg.text FROM na JOIN neg ON neg.class = na.class AND neg.i = na.at""")
def class_triplets(spark, sf):
    rows = table(spark, sf, "part").withColumn("text", F.concat_ws(" ", "p_brand", "p_name"))
    return ts.class_triplets(rows, "text", "p_type", key="p_partkey")


def _clock(seed):
    """Exponential clock of offer (x, y) of w items for draw g."""
    digits = "CAST(CAST('0x' || substr(" + sql_md5(seed, "x", "y") + ", CAST(8 * g + 1 AS BIGINT), 8) AS BIGINT) AS DOUBLE)"
    return f"-ln(({digits} + 1) / 4294967296) / w"


SQL_CHOSEN = "arg_min(struct_pack(y := y, w := w), struct_pack(c := {c}, y := y)) AS b"


@query("N7_tag_overlap_triplets", f"""
WITH k AS (SELECT p_partkey AS item_id, list_sort(list_distinct(list_concat([p_brand, p_type], string_split(p_name, ' ')))) AS tags FROM part),
sets AS MATERIALIZED (SELECT tags, len(tags) AS n, count(*) AS m, row_number() OVER (ORDER BY md5(array_to_string(tags, chr(1)))) AS s FROM k GROUP BY tags),
e AS MATERIALIZED (SELECT s, n, m, unnest(tags) AS t FROM sets),
cov AS MATERIALIZED (SELECT a.s AS x, b.s AS y, any_value(a.n) AS n, any_value(b.m) AS m, count(*) AS c FROM e a JOIN e b ON a.t = b.t GROUP BY 1, 2 HAVING 2 * count(*) >= any_value(a.n)),
mem AS MATERIALIZED (SELECT item_id, s, row_number() OVER (PARTITION BY s ORDER BY {sql_md5(7, 'item_id')}) - 1 AS o, {sql_hash('7g', 'item_id')} % 4 AS g FROM k JOIN sets USING (tags)),
dr AS (SELECT DISTINCT s AS x, g FROM mem),
po AS (SELECT x, g, y, m - CAST(x = y AS BIGINT) AS w FROM cov JOIN dr USING (x) WHERE 2 * c > n),
pc AS (SELECT x, g, {SQL_CHOSEN.format(c=_clock('7p'))} FROM po WHERE w > 0 GROUP BY 1, 2),
pa AS (SELECT a.item_id AS anchor, a.s AS x, a.g, a.o AS ao, b.y AS py, {sql_hash('7p', 'a.item_id')} % b.w AS r FROM mem a JOIN pc ON pc.x = a.s AND pc.g = a.g),
pp AS MATERIALIZED (SELECT pa.*, mem.item_id AS positive, mem.o AS po FROM pa JOIN mem ON mem.s = py AND mem.o = r + CAST(x = py AND r >= ao AS BIGINT)),
no AS (SELECT d.x, d.g, d.py, cov.y, cov.m - CAST(d.x = cov.y AS BIGINT) - CAST(d.py = cov.y AS BIGINT) AS w FROM (SELECT DISTINCT x, g, py FROM pp) d JOIN cov ON cov.x = d.py WHERE c >= 0.5 * n),
nc AS (SELECT x, g, py, {SQL_CHOSEN.format(c=_clock('7n'))} FROM no WHERE w > 0 GROUP BY 1, 2, 3),
na AS (SELECT pp.*, b.y AS ny, {sql_hash('7n', 'anchor')} % b.w AS q FROM pp JOIN nc ON nc.x = pp.x AND nc.g = pp.g AND nc.py = pp.py),
n1 AS (SELECT *, least(CASE WHEN x = ny THEN ao END, CASE WHEN py = ny THEN po END) AS t1, CASE WHEN x = ny AND py = ny THEN greatest(ao, po) END AS t2 FROM na),
n2 AS (SELECT *, q + CAST(coalesce(q >= t1, false) AS BIGINT) AS q1 FROM n1)
SELECT anchor, positive, mem.item_id AS negative FROM n2 JOIN mem ON mem.s = ny AND mem.o = q1 + CAST(coalesce(q1 >= t2, false) AS BIGINT)""")
def overlap(spark, sf):
    tags = F.array_distinct(F.concat(F.array("p_brand", "p_type"), F.split("p_name", " ")))
    return ts.overlap_triplets(table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), tags.alias("tags")))


@query("N8_to_query_pos_neg", "SELECT p_name AS query, p_type AS pos, array_to_string(list_slice([p_name, p_type, p_brand], 1, p_partkey % 4), '|') AS neg FROM part")
def qpn(spark, sf):
    return ts.to_query_pos_neg(listed(spark, sf)).select("query", F.array_join("pos", "|").alias("pos"), F.array_join("neg", "|").alias("neg"))


@query("N9_query_prefix", "SELECT p_partkey, 'Find the part: ' || p_name AS anchor FROM part")
def prefixed(spark, sf):
    return ts.query_prefix(listed(spark, sf), "Find the part: ").select("p_partkey", "anchor")


@query("N10_similarity_band_augment", f"""WITH {SQL_V}, a AS (SELECT id, vec, list_transform(vec, lambda x, i: CASE WHEN i <= 10 THEN 0.0::DOUBLE ELSE x END) AS aug FROM v),
t AS (SELECT q.id AS query, p.id AS positive, g.id AS negative, round(list_cosine_similarity(p.vec, p.aug), 9) AS ps, round(list_cosine_similarity(g.vec, g.aug), 9) AS ns
 FROM v q JOIN a p ON p.id = (q.id + 1) % q.n JOIN a g ON g.id = (q.id + 2) % q.n)
SELECT query, 'd' || positive AS positive, 'd' || negative AS negative, 'original' AS meta FROM t
UNION ALL SELECT query, 'd' || positive || '*', 'd' || negative, 'aug_pos' FROM t WHERE ps > 0.8 AND ps < 0.95 UNION ALL SELECT query, 'd' || positive, 'd' || negative || '*', 'aug_neg' FROM t WHERE ns > 0.8 AND ns < 0.95""")
def augmented(spark, sf):
    v = vectors(spark, sf).select("id", "vec")
    n = v.agg(F.count(F.lit(1))).scalar()
    aug = F.transform("vec", lambda x, i: F.when(i < 10, 0.0).otherwise(x.cast("double")))

    def side(name):
        text = F.concat(F.lit("d"), F.col("id").cast("string"))
        return v.select(F.col("id").alias(f"{name}_id"), text.alias(name), F.concat(text, F.lit("*")).alias(f"aug_{name}"), F.col("vec").alias(f"{name}_vec"), aug.alias(f"aug_{name}_vec"))

    rows = v.select(F.col("id").alias("query"), ((F.col("id") + 1) % n).alias("positive_id"), ((F.col("id") + 2) % n).alias("negative_id"))
    return ts.similarity_band_augment(rows.join(side("positive"), "positive_id").join(side("negative"), "negative_id"))


@query("N11_train_test_split", f"SELECT doc_id, CASE WHEN {sql_hash(7, 'doc_id')} % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM documents")
def split(spark, sf):
    return ts.train_test_split(table(spark, sf, "documents"), "doc_id").select("doc_id", "split")


@query("N12_encode_labels", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS id FROM part")
def labels(spark, sf):
    parts = table(spark, sf, "part")
    return parts.join(ts.encode_labels(parts, "p_type"), "p_type").select("p_partkey", "id")


@query("N13_rename_columns", "SELECT p_name AS text, p_type AS label FROM part")
def renamed(spark, sf):
    return ts.rename_columns(table(spark, sf, "part").select("p_name", "p_type"), {"p_name": "text", "p_type": "label"})


def candidate_questions(spark, sf):
    """Each benchmark passage with the 20 documents that BM25 finds for it."""
    found = bm25_ranking(spark, sf, 20).groupBy("query_id").agg(F.collect_list("doc_id").alias("list_of_articleId"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")).join(found, "query_id")


def articles(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), "text")


SQL_JUDGED = f"""{SQL_BM25}, judged AS (SELECT b.text AS question, doc_id AS article_id, contains(d.text, b.text) AS is_relevant FROM bm_ranked JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 20)"""


@query("N14_group_relevance", f"WITH {SQL_JUDGED} SELECT question, article_id, is_relevant FROM judged JOIN documents ON doc_id = article_id WHERE lang <> 'en'")
def relevance(spark, sf):
    asked = candidate_questions(spark, sf)
    # an earlier run has already judged the English documents
    english = table(spark, sf, "documents").where(F.col("lang") == "en").select(F.col("doc_id").alias("article_id"))
    done = asked.select("question", F.explode("list_of_articleId").alias("article_id")).join(english, "article_id")
    return ts.group_relevance(asked, articles(spark, sf), lambda pairs: [q in t for q, t in pairs], done)


@query("N15_consolidate_relevance", f"WITH {SQL_JUDGED} SELECT question, 0 AS part, coalesce(string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY article_id) FILTER (is_relevant), '') AS gt_docs FROM judged GROUP BY 1")
def consolidated(spark, sf):
    asked = candidate_questions(spark, sf)
    judged = ts.group_relevance(asked, articles(spark, sf), F.contains(F.col("text"), F.col("question")))
    out = ts.consolidate_relevance(asked, judged)
    return out.withColumn("gt_docs", F.array_join(F.transform("gt_docs", lambda x: x.cast("string")), ","))


def numbered_questions(rows):
    """Stand-in generator: two numbered questions and one plain line per chunk."""
    return [f"1. What follows {c.split()[0]}?\n12. What ends with {c.split()[-1]}?\n\nHow long is it?" for c, _ in rows]


STRATEGIES = ["deepening", "reasoning", "concretizing"]


@query("N16_question_expand", rf"""
WITH w AS (SELECT conv_id || '_' || turn AS chunk_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM conversations),
b AS (SELECT chunk_id, unnest(['What follows ' || ws[1] || '?', 'What ends with ' || ws[-1] || '?', 'How long is it?']) AS question FROM w),
s AS (SELECT *, ['deepening', 'reasoning', 'concretizing'][CAST({sql_hash(7, 'chunk_id', 'question')} % 3 + 1 AS INTEGER)] AS strategy FROM b)
SELECT chunk_id, 'base_question' AS type, question, NULL AS parent_question FROM s UNION ALL SELECT chunk_id, 'evolved_' || strategy, strategy || ': ' || question, question FROM s""")
def expanded(spark, sf):
    chunks = table(spark, sf, "conversations").select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("text").alias("chunk_content"), F.col("role").alias("chunk_context"))
    return ts.question_expand(chunks, numbered_questions, lambda rows: [f"{s}: {q}" for q, s in rows], STRATEGIES, STRATEGIES)


def tag_lists(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.concat(F.array("p_brand"), F.split("p_name", " ")).alias("similar_tags"), F.array("p_type").alias("negative_tags"))


@query("N17_unique_corpus_relevance", f"""
WITH c AS (SELECT tag, row_number() OVER (ORDER BY {sql_md5(0, 'tag')}) - 1 AS id FROM (SELECT DISTINCT unnest(list_concat([p_brand, p_type], string_split(p_name, ' '))) AS tag FROM part)),
r AS (SELECT DISTINCT p_partkey, unnest(list_concat([p_brand], string_split(p_name, ' '))) AS tag FROM part) SELECT p_partkey, tag AS text, id FROM r JOIN c USING (tag)""")
def corpus(spark, sf):
    rows = tag_lists(spark, sf)
    texts = ts.unique_corpus(rows, ["similar_tags", "negative_tags"])
    return ts.corpus_relevance(rows, texts, "p_partkey", "similar_tags").join(texts, "id").select("p_partkey", "text", "id")


@query("N18_batch_no_duplicates", f"""
WITH a AS (SELECT p_partkey, p_name AS anchor, p_brand AS positive, row_number() OVER (PARTITION BY p_name ORDER BY {sql_md5('7a', 'p_partkey')}) AS oa, row_number() OVER (PARTITION BY p_brand ORDER BY {sql_md5('7p', 'p_partkey')}) AS op FROM part)
SELECT p_partkey, oa || '-' || op AS round, (row_number() OVER (PARTITION BY oa, op ORDER BY {sql_md5('7b', 'p_partkey')}) - 1) // 4 AS batch FROM a""")
def batches(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("anchor"), F.col("p_brand").alias("positive"))
    return ts.batch_no_duplicates(rows, 4, "p_partkey").select("p_partkey", "round", "batch")


@query("N19_catalogue_enrich", "SELECT p_partkey, p_type || ' goods by ' || p_brand AS description, lower(p_type) || ',' || lower(p_brand) AS tags FROM part")
def enriched(spark, sf):
    def describe(rows):
        return ["```json\n" + json.dumps({"description": f"{t} goods by {b}", "tags": [t.lower(), b.lower()]}) + "\n```" for b, t in rows]

    out = ts.catalogue_enrich(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], describe)
    return out.select("p_partkey", "description", F.array_join("tags", ",").alias("tags"))


@query("N20_query_generate", """
WITH g AS (SELECT p_partkey, list_distinct([p_name, p_name || ' ' || p_type, 'where can I buy a ' || p_name, 'best ' || lower(p_type) || ' offers', p_name]) AS qs FROM part) SELECT p_partkey, unnest(qs) AS query FROM g""")
def generated(spark, sf):
    def variants(rows):
        return [[n, f"{n} {t}", f"where can I buy a {n}", f"best {t.lower()} offers", n] for n, t in rows]

    return ts.query_generate(table(spark, sf, "part"), "p_partkey", ["p_name", "p_type"], variants)


@query("N21_intent_triplets", f"""
WITH i AS (SELECT DISTINCT p_type || '/' || p_name AS doc_id, p_name || ' for ' || p_type AS text, p_type AS intent FROM part),
q AS (SELECT DISTINCT p_type || '?' || p_name AS query_id, 'buy ' || p_type || ' ' || p_name AS text, p_type AS intent FROM part),
{sql_hash_vectors('iv', 'i', 'doc_id', SQL_HASH_TOKENS.format(t='text'), 32)}, {sql_hash_vectors('qv', 'q', 'query_id', SQL_HASH_TOKENS.format(t='text'), 32)},
it AS (SELECT DISTINCT doc_id, intent, unnest({SQL_SPACE}) AS term FROM i), qt AS (SELECT DISTINCT query_id, intent, unnest({SQL_SPACE}) AS term FROM q),
r AS (SELECT query_id, doc_id, any_value(qt.intent) AS qi, any_value(it.intent) AS ii, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank FROM qt JOIN it USING (term) GROUP BY 1, 2 QUALIFY rank <= 30),
d AS (SELECT qv.id AS query_id, iv.id AS doc_id, sum(qv.x * iv.x) AS s FROM qv JOIN iv USING (dim) GROUP BY 1, 2),
j AS (SELECT r.*, round(coalesce(s, 0), 9) AS s FROM r LEFT JOIN d ON d.query_id = r.query_id AND d.doc_id = r.doc_id),
p AS (SELECT query_id, doc_id AS positive FROM j WHERE qi = ii QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1),
n AS (SELECT query_id, doc_id AS negative FROM j WHERE qi <> ii QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s, rank) = 1)
SELECT query_id, positive, negative FROM p JOIN n USING (query_id)""")
def intents(spark, sf):
    p = table(spark, sf, "part").select("p_type", "p_name").distinct()
    items = p.select(F.concat_ws("/", "p_type", "p_name").alias("doc_id"), F.concat("p_name", F.lit(" for "), "p_type").alias("text"), F.col("p_type").alias("intent"))
    asked = p.select(F.concat_ws("?", "p_type", "p_name").alias("query_id"), F.concat(F.lit("buy "), "p_type", F.lit(" "), "p_name").alias("text"), F.col("p_type").alias("intent"))
    return ts.intent_triplets(encode_texts(asked, "text", None, dims=32), encode_texts(items, "text", None, dims=32), lambda q, d: lx.overlap_topk(q, d, "text", 30))


@query("N22_chunk_documents", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(range(1 + greatest(0, CAST(ceil((len(ws) - 50) / 40.0) AS BIGINT)))) AS n FROM w WHERE len(ws) > 0)
SELECT doc_id, doc_id || '_' || n AS chunk_id, CAST(n AS INTEGER) AS chunk_no, array_to_string(list_slice(ws, n * 40 + 1, n * 40 + 50), ' ') AS chunk_content,
 CASE WHEN n = 0 THEN '' ELSE array_to_string(list_slice(ws, (n - 1) * 40 + 1, (n - 1) * 40 + 50), ' ') END AS chunk_context FROM c""")
def chunks(spark, sf):
    return ts.chunk_documents(table(spark, sf, "documents"), "text", 50, 10)
