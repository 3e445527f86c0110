"""Tag, clustering and taxonomy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.catalog.base import q6, query, r6, sql_hash, sql_md5, table
from rankweave.catalog.retrieval import SQL_HASH_TOKENS, SQL_V, sql_hash_vectors, vectors
from rankweave.operators import graph, knn
from rankweave.operators import tags as tg

SQL_TAG = "CASE id % 4 WHEN 0 THEN 'Tag ' WHEN 1 THEN 'tag ' WHEN 2 THEN 'Long Tag ' ELSE 'tAg ' END || id"


def raw_tags(spark, sf):
    """Tags with their vectors; spelled in several ways, padded, and repeated with another padding."""
    v = vectors(spark, sf)
    kind = F.col("id") % 4
    tag = F.concat(F.when(kind == 0, "Tag ").when(kind == 1, "tag ").when(kind == 2, "Long Tag ").otherwise("tAg "), F.col("id").cast("string"))
    return v.select(tag.alias("tag"), "vec")


def dirty(tags):
    first = tags.select(F.concat(F.lit("  "), "tag").alias("tag"))
    return first.union(tags.select(F.concat("tag", F.lit(" \t")).alias("tag"))).union(tags.select(F.lit("  ").alias("tag")))


@query("C1_clean_tags", f"WITH {SQL_V} SELECT {SQL_TAG} AS tag FROM v")
def clean(spark, sf):
    return tg.clean_tags(dirty(raw_tags(spark, sf)))


def sql_components(threshold):
    return f"""{SQL_V}, pairs AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE round(list_cosine_similarity(a.vec, b.vec), 9) > {threshold}),
reach AS (SELECT id AS root, id FROM v UNION SELECT root, b FROM reach JOIN pairs ON a = reach.id), comp AS (SELECT id, min(root) AS component FROM reach GROUP BY 1)"""


@query("C2_connected_components", f"WITH RECURSIVE {sql_components(0.4)} SELECT id, component FROM comp")
def components(spark, sf):
    v = vectors(spark, sf)
    return graph.connected_components(v, knn.similar_pairs(v, 0.4, spanning=True))


SQL_CANON = f"""{sql_components(0.4)}, t AS (SELECT component, {SQL_TAG} AS tag FROM comp),
c AS (SELECT component, first(tag ORDER BY CASE WHEN tag LIKE 'Tag%' OR tag LIKE 'Long%' THEN 0 ELSE 1 END, length(tag), tag) AS canonical FROM t GROUP BY 1)"""


@query("C3_canonical_label", f"WITH RECURSIVE {SQL_CANON} SELECT min(tag) AS first_tag, canonical FROM c JOIN t USING (component) GROUP BY canonical")
def labels(spark, sf):
    out = tg.canonicalize(raw_tags(spark, sf), 0.4, vectors=raw_tags(spark, sf)).mapping
    return out.groupBy("canonical").agg(F.min("tag").alias("first_tag"))


@query("C4_canonicalize_tags", f"WITH RECURSIVE {SQL_CANON} SELECT tag, canonical FROM t JOIN c USING (component)")
def canonical_map(spark, sf):
    tags = raw_tags(spark, sf)
    return tg.canonicalize(dirty(tags), 0.4, vectors=tags).mapping


@query("C4_canonical_stats", f"WITH RECURSIVE {SQL_CANON} SELECT (SELECT count(*) FROM t) AS input_unique, count(*) AS output_unique, {q6('(1 - count(*) / (SELECT count(*) FROM t)) * 100')} AS reduction_pct FROM c")
def canonical_stats(spark, sf):
    tags = raw_tags(spark, sf)
    return tg.canonicalize(dirty(tags), 0.4, vectors=tags).stats.withColumn("reduction_pct", r6("reduction_pct"))


def sql_density(similarity, least):
    return f"""{SQL_V}, pr AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE round(list_cosine_similarity(a.vec, b.vec), 9) >= {similarity}),
core AS (SELECT v.id FROM v LEFT JOIN pr ON a = v.id GROUP BY 1 HAVING 1 + count(b) >= {least}),
ce AS (SELECT a, b FROM pr WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS root, id FROM core UNION SELECT root, b FROM reach JOIN ce ON a = reach.id), cc AS (SELECT id, min(root) AS label FROM reach GROUP BY 1),
bd AS (SELECT a AS id, min(b) AS nb FROM pr WHERE b IN (SELECT id FROM core) AND a NOT IN (SELECT id FROM core) GROUP BY 1),
lab AS (SELECT v.id, coalesce(cc.label, c2.label, -1) AS label FROM v LEFT JOIN cc ON cc.id = v.id LEFT JOIN bd ON bd.id = v.id LEFT JOIN cc c2 ON c2.id = bd.nb)"""


SQL_SIL = """un AS (SELECT id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS u FROM v),
pp AS (SELECT l.id, l.label, o.label AS other, 1 - list_dot_product(a.u, b.u) AS d FROM lab l JOIN lab o ON l.id <> o.id AND l.label <> -1 AND o.label <> -1 JOIN un a ON a.id = l.id JOIN un b ON b.id = o.id),
pc AS (SELECT id, label, other, avg(d) AS d FROM pp GROUP BY 1, 2, 3),
ab AS (SELECT l.id, l.label, (SELECT d FROM pc WHERE pc.id = l.id AND pc.other = l.label) AS a, (SELECT min(d) FROM pc WHERE pc.id = l.id AND pc.other <> l.label) AS b FROM lab l WHERE l.label <> -1)"""
SQL_SIL_ROW = "count(*) AS n, count(DISTINCT label) AS clusters, " + q6("CASE WHEN count(DISTINCT label) >= 2 THEN avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) END") + " AS silhouette"


@query("C5_density_cluster", f"WITH RECURSIVE {sql_density(0.35, 3)} SELECT id, label FROM lab")
def density(spark, sf):
    return tg.density_cluster(vectors(spark, sf), 0.35, 3)


GRID = [(s, m) for s in (0.3, 0.35, 0.4) for m in (2, 3)]
_rows = " UNION ALL ".join(
    f"SELECT * FROM (WITH RECURSIVE {sql_density(s, m)}, {SQL_SIL} SELECT {i} AS setting, CAST({s} AS DOUBLE) AS min_similarity, {m} AS min_points, {SQL_SIL_ROW} FROM ab)" for i, (s, m) in enumerate(GRID))


@query("C6_cluster_grid_search", f"WITH g AS ({_rows}) SELECT *, coalesce(setting = (SELECT setting FROM g WHERE silhouette IS NOT NULL ORDER BY silhouette DESC, setting LIMIT 1), false) AS is_best FROM g")
def grid(spark, sf):
    return tg.cluster_grid(vectors(spark, sf), (0.3, 0.35, 0.4), (2, 3)).withColumn("silhouette", r6("silhouette"))


@query("C7_cosine_silhouette", f"WITH {SQL_V}, lab AS (SELECT id, label FROM v), {SQL_SIL} SELECT {SQL_SIL_ROW} FROM ab")
def silhouette(spark, sf):
    v = vectors(spark, sf)
    return tg.cosine_silhouette(v, v.select("id", F.col("label").cast("long").alias("label"))).withColumn("silhouette", r6("silhouette"))


@query("C8_cluster_report", f"WITH RECURSIVE {sql_density(0.35, 3)} SELECT count(DISTINCT label) FILTER (label <> -1) AS clusters, count(*) FILTER (label = -1) AS noise, count(*) AS points FROM lab")
def report(spark, sf):
    return tg.cluster_report(tg.density_cluster(vectors(spark, sf), 0.35, 3))


@query("C8_cluster_members", f"WITH RECURSIVE {sql_density(0.35, 3)} SELECT label, count(*) AS members, min(id) AS first_id FROM lab GROUP BY 1")
def sizes(spark, sf):
    return tg.cluster_sizes(tg.density_cluster(vectors(spark, sf), 0.35, 3))


def part_nodes(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("L0_"), F.col("p_partkey").cast("string")).alias("id"), F.lit(0).alias("level"), F.col("p_name").alias("name"), F.col("p_name").alias("description"), (F.col("p_size") % 7 - 1).cast("long").alias("label"))


def first_name(rows):
    return [(min(names), f"level {level}") for names, level in rows]


@query("C9_taxonomy_layer", """
WITH n AS (SELECT 'L0_' || p_partkey AS id, p_name AS name, p_size % 7 - 1 AS label FROM part), s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '7', id))) AS r FROM n),
p AS (SELECT label, CASE WHEN label = -1 THEN 'Miscellaneous Level 0' ELSE min(name) FILTER (r <= 40) END AS name, CASE WHEN label = -1 THEN 'Items that did not fit well into dense clusters at this level.' ELSE 'level 0' END AS description FROM s GROUP BY 1)
SELECT 'L1_C' || n.label AS parent_id, id AS child_id, p.name, p.description FROM n JOIN p USING (label)""")
def layer(spark, sf):
    nodes = part_nodes(spark, sf)
    parents, edges = tg.taxonomy_layer(nodes.drop("label"), nodes.select("id", "label"), 0, first_name)
    return edges.join(parents.select(F.col("id").alias("parent_id"), "name", "description"), "parent_id")


def part_taxonomy(spark, sf):
    tags = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("tag")).distinct()
    return tg.taxonomy_build(tags, 0.6)


LAYERS = 6


def _sql_layer(i):
    """Layer ``i`` + 1 from layer ``i``: components of similar texts, one parent each, one for those that are like no other."""
    more = f"(SELECT count(*) FROM n{i}) >= 20" + (f" AND (SELECT count(*) FROM n{i}) < (SELECT count(*) FROM n{i - 1})" if i else "")
    text = SQL_HASH_TOKENS.format(t="CASE WHEN length(description) > 0 THEN description ELSE name END")
    return f"""g{i} AS MATERIALIZED (SELECT * FROM n{i} WHERE {more}), {sql_hash_vectors(f'h{i}', f'g{i}', 'id', text, 64)},
p{i} AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM h{i} a JOIN h{i} b ON b.dim = a.dim AND b.id <> a.id GROUP BY 1, 2 HAVING round(sum(a.x * b.x), 9) >= 0.6),
r{i} AS (SELECT a AS id, b AS root FROM p{i} UNION SELECT r.id, p.b FROM r{i} r JOIN p{i} p ON p.a = r.root),
l{i} AS (SELECT id, md5(least(id, min(root))) AS label FROM r{i} GROUP BY id),
e{i} AS MATERIALIZED (SELECT g.id, g.name, 'L{i + 1}_C' || coalesce(label, '-1') AS parent_id, label IS NULL AS is_noise FROM g{i} g LEFT JOIN l{i} l ON l.id = g.id),
n{i + 1} AS MATERIALIZED (SELECT parent_id AS id, CASE WHEN is_noise THEN 'Miscellaneous Level {i}' ELSE arg_min(name, (length(name), name)) || ' group' END AS name,
 CASE WHEN is_noise THEN '{tg.NOISE_DESCRIPTION}' ELSE arg_min(name, (length(name), name)) || ' and related entries at level {i}' END AS description FROM e{i} GROUP BY parent_id, is_noise)"""


@query("C10_taxonomy_build", f"""WITH RECURSIVE n0 AS MATERIALIZED (SELECT DISTINCT 'L0_' || md5(p_name || ' ' || p_type) AS id, p_name || ' ' || p_type AS name, p_name || ' ' || p_type AS description FROM part),
{', '.join(_sql_layer(i) for i in range(LAYERS))},
c AS (SELECT parent_id, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT parent_id FROM e{i}' for i in range(LAYERS))}) GROUP BY 1)
SELECT id, level, name, description, coalesce(n, 0) AS children FROM ({' UNION ALL '.join(f'SELECT id, {i} AS level, name, description FROM n{i}' for i in range(LAYERS + 1))}) LEFT JOIN c ON parent_id = id""")
def build(spark, sf):
    nodes, edges = part_taxonomy(spark, sf)
    children = edges.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return nodes.join(children, "id", "left").select("id", "level", "name", "description", F.coalesce("children", F.lit(0)).alias("children"))


@query("C11_taxonomy_tag", f"""
WITH n AS (SELECT DISTINCT p_name AS id, p_name || ': ' || p_name || ' parts' AS text FROM part), q AS (SELECT DISTINCT p_type || ' ' || p_name AS id FROM part),
{sql_hash_vectors('nv', 'n', 'id', SQL_HASH_TOKENS.format(t='text'), 64)}, {sql_hash_vectors('qv', 'q', 'id', SQL_HASH_TOKENS.format(t='id'), 64)},
s AS (SELECT q.id AS query_id, n.id AS item_id, coalesce(d.s, 0) AS score FROM q CROSS JOIN n LEFT JOIN (SELECT qv.id AS q, nv.id AS n, sum(qv.x * nv.x) AS s FROM qv JOIN nv USING (dim) GROUP BY 1, 2) d ON d.q = q.id AND d.n = n.id)
SELECT query_id, item_id, {q6('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s QUALIFY rank <= 3""")
def tag(spark, sf):
    p = table(spark, sf, "part")
    leaf = p.select(F.col("p_name").alias("id"), F.lit(1).alias("level"), F.col("p_name").alias("name"), F.concat("p_name", F.lit(" parts")).alias("description")).distinct()
    other = p.select(F.concat("p_type", F.lit("/top")).alias("id"), F.lit(2).alias("level"), F.col("p_type").alias("name"), F.lit("").alias("description")).distinct()
    asked = p.select(F.concat_ws(" ", "p_type", "p_name").alias("id")).distinct().withColumn("text", F.col("id"))
    return tg.taxonomy_tag(asked, leaf.unionByName(other), 3, level=1).withColumn("score", r6("score"))


def label_means(spark, sf):
    """One centroid per vector label."""
    v = vectors(spark, sf).select("label", F.posexplode("vec").alias("d", "x"))
    per = v.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per.groupBy(F.col("label").cast("long").alias("cluster")).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vec"))


SQL_Q = f"""{SQL_V}, cd AS (SELECT label AS cluster, d, avg(x) AS x FROM (SELECT label, unnest(vec) AS x, unnest(range(len(vec))) AS d FROM v) GROUP BY 1, 2),
ct AS (SELECT cluster, list(x ORDER BY d) AS c FROM cd GROUP BY 1),
w AS (SELECT id, cluster, 1 / (1 + pow(list_distance(vec, c), 2)) AS w FROM v, ct),
q AS (SELECT id, cluster, w / sum(w) OVER (PARTITION BY id) AS q FROM w)"""


@query("C12_soft_assignment", f"WITH {SQL_Q} SELECT id, CAST(cluster AS INTEGER) AS cluster, {q6('q')} AS q, (SELECT arg_max(cluster, q2.q) FROM q q2 WHERE q2.id = q.id)::BIGINT AS label FROM q")
def soft(spark, sf):
    out = tg.soft_assign(vectors(spark, sf), label_means(spark, sf))
    return out.select("id", F.posexplode("q").alias("cluster", "q"), "label").select("id", "cluster", r6("q").alias("q"), "label")


@query("C13_target_distribution", f"WITH {SQL_Q}, t AS (SELECT id, cluster, q * q / sum(q) OVER (PARTITION BY cluster) AS t FROM q) SELECT id, CAST(cluster AS INTEGER) AS cluster, {q6('t / sum(t) OVER (PARTITION BY id)')} AS p FROM t")
def target(spark, sf):
    centroids = label_means(spark, sf)
    assigned = tg.soft_assign(vectors(spark, sf), centroids)
    out = tg.target_distribution(assigned)
    return out.select("id", F.posexplode("p").alias("cluster", "p")).select("id", "cluster", r6("p").alias("p"))


SEEDS, CENTRES, ROUNDS = [1, 7, 6], 14, 10


def _sql_nearest(name, centres):
    """(id, cluster, d): the nearest of the centres so far."""
    return f"""{name} AS MATERIALIZED (
 SELECT id, arg_min(cluster, struct_pack(r := round(d, 9), c := cluster)) AS cluster, arg_min(d, struct_pack(r := round(d, 9), c := cluster)) AS d
 FROM (SELECT v.id, c.cluster, pow(list_distance(v.vec, c.vec), 2) AS d FROM v, {centres} c) GROUP BY id)"""


def _sql_kmeans():
    steps = [f"s0 AS MATERIALIZED (SELECT 0::BIGINT AS cluster, vec FROM v ORDER BY {sql_md5('7c0', 'id')}, id LIMIT 1)"]
    for turn, n in enumerate(SEEDS[1:], 1):
        clock = f"-ln((CAST({sql_hash(f'7c{turn}', 'id')} AS DOUBLE) + 1) / pow(CAST(2 AS DOUBLE), 60)) / d"
        at = sum(SEEDS[:turn])
        steps += [_sql_nearest(f"f{turn}", f"s{turn - 1}"),
                  f"d{turn} AS (SELECT id, row_number() OVER (ORDER BY {clock}, id) - 1 + {at} AS cluster FROM f{turn} WHERE round(d, 9) > 0 ORDER BY {clock}, id LIMIT {n})",
                  f"s{turn} AS MATERIALIZED (SELECT * FROM s{turn - 1} UNION ALL SELECT cluster, vec FROM d{turn} JOIN v USING (id))"]
    last = f"s{len(SEEDS) - 1}"
    for i in range(ROUNDS):
        steps += [_sql_nearest(f"n{i}", last), f"""m{i} AS MATERIALIZED (SELECT c.cluster, CASE WHEN w.vec IS NULL THEN c.vec ELSE w.vec END AS vec FROM {last} c LEFT JOIN (
 SELECT cluster, list(x ORDER BY dim) AS vec FROM (SELECT n.cluster, u.dim, avg(u.x) AS x FROM n{i} n JOIN u USING (id) GROUP BY 1, 2) GROUP BY 1) w USING (cluster))"""]
        last = f"m{i}"
    return f"WITH {SQL_V}, u AS (SELECT id, unnest(vec) AS x, unnest(range(64)) AS dim FROM v), {', '.join(steps)} SELECT cluster, CAST(unnest(range(64)) AS INTEGER) AS dim, unnest(list_transform(vec, lambda x: {q6('x')})) AS value FROM {last}"


@query("C14_kmeans_init", _sql_kmeans())
def kmeans(spark, sf):
    return tg.kmeans_centroids(vectors(spark, sf), CENTRES, rounds=ROUNDS).select("cluster", F.posexplode("vec").alias("dim", "x")).select("cluster", "dim", r6("x").alias("value"))
