"""Source, sink, hook and scalar-function queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rankweave.catalog.base import SQL_EXAMPLES, q6, query, r6, session_log, sql_hash, table
from rankweave.catalog.features import SQL_MONTHLY, monthly
from rankweave.catalog.retrieval import SQL_HASH_TOKENS, sql_hash_vectors
from rankweave.functions import scalar as sc
from rankweave.functions import vectors as vc
from rankweave.functions.hooks import encode_texts, map_batch
from rankweave.functions.sampling import bucket
from rankweave.operators import trainset as ts
from rankweave.sources import readers, writers
from rankweave.session import shared_folder
from rankweave.streaming.clickstream import label_session_files


@query("S1_read_json_array", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_array(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    files = max(1, math.ceil(rows.count() / 500))
    arrays = rows.groupBy(F.pmod(F.xxhash64("c_custkey"), F.lit(files)).alias("file")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    path = shared_folder(spark, "json-array")
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json_array(spark, path, rows.schema)


@query("S2_read_jsonl_tolerant", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'")
def jsonl(spark, sf):
    orders = table(spark, sf, "orders")
    line = F.to_json(F.struct("o_orderkey", "o_totalprice"))
    broken = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("{\"o_orderkey\": oops "), line)).otherwise(line)
    path = shared_folder(spark, "jsonl")
    orders.select(broken.alias("value")).write.text(path)
    return readers.read_jsonl(spark, path, "o_orderkey bigint, o_totalprice double").select("o_orderkey", "o_totalprice")


@query("S3_read_wide_csv", f"{SQL_MONTHLY} SELECT CAST(user_id AS VARCHAR) AS user_id, month, {q6('CASE WHEN f1 = 1 THEN 0 ELSE f1 END')} AS f1, {q6('f2', 2)} AS f2, {q6('CASE WHEN f1 > 1 THEN 0 ELSE f4 END', 2)} AS f4 FROM m WHERE month <> '1998-01'")
def wide_csv(spark, sf):
    rows = monthly(spark, sf).select(
        F.col("user_id").cast("string").alias("user_id"), F.when(F.col("month") == "1998-01", " ").otherwise(F.col("month")).alias("month"),
        F.when(F.col("f1") > 1, F.col("f1").cast("string")).otherwise("n/a").alias("f1"), F.col("f2").cast("string").alias("f2"),
        F.when(F.col("f1") > 1, "").otherwise(F.col("f4").cast("string")).alias("f4"))
    path = shared_folder(spark, "wide-csv")
    rows.write.option("header", True).csv(path)
    out = readers.read_wide_csv(spark, path, ["user_id", "month"])
    return out.withColumns({"f2": r6("f2", 2), "f4": r6("f4", 2)})


@query("S4_read_parquet", "SELECT doc_id, lang, n_chars FROM documents")
def parquet(spark, sf):
    return readers.read_parquet(spark, f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")


@query("S5_read_parquet_glob", "SELECT doc_id, quality, toxic FROM labels")
def glob(spark, sf):
    path = shared_folder(spark, "glob")
    table(spark, sf, "labels").repartition(4).write.parquet(path)
    return readers.read_parquet_glob(spark, f"{path}/part-*.parquet")


@query("S6_require_columns", "SELECT doc_id, source FROM documents")
def require(spark, sf):
    return readers.require_columns(table(spark, sf, "documents"), ["doc_id", "text", "source"]).select("doc_id", "source")


@query("K1_write_jsonl", "SELECT doc_id, text, 1 AS has_null FROM documents")
def write_jsonl(spark, sf):
    path = shared_folder(spark, "write-jsonl")
    writers.write_jsonl(table(spark, sf, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("note")), path)
    lines = spark.read.text(path).select(F.from_json("value", "doc_id bigint, text string").alias("r"), F.contains("value", F.lit('"note":null')).cast("int").alias("has_null"))
    return lines.select("r.doc_id", "r.text", "has_null")


@query("K2_write_parquet", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def write_parquet(spark, sf):
    path = shared_folder(spark, "write-parquet")
    writers.write_parquet(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), path)
    return spark.read.parquet(path)


@query("K3_write_sharded_parquet", f"SELECT CASE WHEN {sql_hash(7, 'doc_id')} % 100 < 80 THEN 'train' ELSE 'test' END AS split, count(*) AS n, 0 AS files_over_limit FROM documents GROUP BY 1")
def sharded(spark, sf):
    path = shared_folder(spark, "sharded")
    writers.write_sharded_parquet(ts.train_test_split(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id"), path, 100)
    per_file = spark.read.parquet(path).groupBy("split", F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("split").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 100).cast("int").alias("files_over_limit"))


@query("K4_append_resume", "SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS run FROM documents")
def resume(spark, sf):
    path = shared_folder(spark, "resume")
    tasks = table(spark, sf, "documents").select("doc_id", "lang")
    writers.append_resume(tasks.where(F.col("lang") == "en"), path, ["doc_id"], lambda t: t.withColumn("run", F.lit("first")))
    writers.append_resume(tasks, path, ["doc_id"], lambda t: t.withColumn("run", F.lit("second")))
    return spark.read.parquet(path)


@query("K5_write_metrics", f"SELECT 1 AS epoch, 10 AS step, 'mean_quality' AS metric, {q6('avg(quality)')} AS value FROM labels UNION ALL SELECT 2, 20, 'mean_toxic', {q6('avg(toxic)')} FROM labels")
def metrics(spark, sf):
    path = shared_folder(spark, "metrics")
    means = table(spark, sf, "labels").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t")).first()
    writers.append_metrics(spark, path, {"mean_quality": means["q"]}, 1, 10)
    writers.append_metrics(spark, path, {"mean_toxic": means["t"]}, 2, 20)
    return spark.read.parquet(path).withColumn("value", r6("value"))


@query("K6_taxonomy_round_trip", "SELECT 'L0_' || p_partkey AS id, 0 AS level, p_name AS name, p_type AS description, true AS embedding_is_null FROM part")
def taxonomy(spark, sf):
    nodes = table(spark, sf, "part").select(
        F.concat(F.lit("L0_"), F.col("p_partkey").cast("string")).alias("id"), F.lit(0).alias("level"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array(F.lit(1.0)).alias("embedding"))
    path = shared_folder(spark, "taxonomy")
    writers.save_taxonomy(nodes, path)
    return writers.load_taxonomy(spark, path).select("id", "level", "name", "description", F.col("embedding").isNull().alias("embedding_is_null"))


@query("L8_incremental_file_stream", f"""WITH {SQL_EXAMPLES}, logged AS (SELECT * FROM weighted WHERE skip_type IS NULL OR skip_type = 'impression')
SELECT type, session_id, nav_link, position, {q6('ips_weight * count(*) OVER (PARTITION BY session_id) / sum(ips_weight) OVER (PARTITION BY session_id)')} AS snips_weight FROM logged""")
def stream(spark, sf):
    base = shared_folder(spark, "stream")
    log = session_log(spark, sf)
    log.repartition(4, "session_id").write.json(f"{base}/in")
    label_session_files(spark, f"{base}/in", log.schema, f"{base}/out", f"{base}/state", files_per_batch=2).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("type", "session_id", "nav_link", "position", r6("snips_weight").alias("snips_weight"))


@query("F2_encode_texts", f"WITH {sql_hash_vectors('dv', 'documents', 'doc_id', SQL_HASH_TOKENS.format(t='text'), 32)} SELECT id AS doc_id, CAST(dim AS INTEGER) AS dim, {q6('x')} AS x FROM dv WHERE round(x, 6) <> 0")
def encode(spark, sf):
    out = encode_texts(table(spark, sf, "documents").select("doc_id", "text"), "text", None, dims=32)
    return out.select("doc_id", F.posexplode("vec").alias("dim", "v")).select("doc_id", "dim", r6("v").alias("x")).where(F.col("x") != 0)


@query("F4_translate_batch", "SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE reverse(text) END AS translated FROM conversations")
def translate(spark, sf):
    def backwards(rows):
        if any(len(t) % 7 == 0 for (t,) in rows):
            raise ValueError("cannot translate")
        return [t[::-1] for (t,) in rows]

    return map_batch(table(spark, sf, "conversations"), ["text"], backwards, "translated", "string").select("conv_id", "turn", "translated")


# ---- scalar functions ----


def one_of(name):
    return F.concat(F.lit(name), F.col("p_partkey").cast("string"))


@query("X1_first_present_alias", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'b' || p_partkey WHEN 2 THEN 'c' || p_partkey ELSE 'none' END AS value FROM part")
def alias(spark, sf):
    kind = F.col("p_partkey") % 4
    record = (
        F.when(kind == 0, F.create_map(F.lit("url"), F.lit(None).cast("string"), F.lit("link"), one_of("c")))
        .when(kind == 1, F.create_map(F.lit("url"), one_of("b"), F.lit("link"), one_of("c")))
        .when(kind == 2, F.create_map(F.lit("link"), one_of("c")))
        .otherwise(F.create_map(F.lit("other"), one_of("d"))))
    return table(spark, sf, "part").select("p_partkey", sc.first_present(record, ["nav_link", "url", "link"], F.lit("none")).alias("value"))


_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {f} = 0 THEN '' ELSE '.' || lpad(CAST({f} AS VARCHAR), 6, '0') END || '+00:00'"


@query("X2_time_to_iso", f"""SELECT event_id, {_ISO.format(f='epoch_us(ts) % 1000000')} AS from_time, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS from_seconds,
 {_ISO.format(f='(epoch_us(ts) // 1000 % 1000) * 1000')} AS from_millis, 'at ' || event_id AS from_text FROM events""")
def iso(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", sc.timestamp_to_iso(F.col("ts")).alias("from_time"), sc.to_iso(F.unix_seconds("ts").cast("string")).alias("from_seconds"),
        sc.to_iso(F.unix_millis("ts").cast("string")).alias("from_millis"), sc.to_iso(F.concat(F.lit("at "), F.col("event_id").cast("string"))).alias("from_text"))


@query("X3_round_half_even", "SELECT p_partkey, round_even(p_partkey / 2.0, 0)::DOUBLE AS rounded FROM part")
def half_even(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.bround(F.col("p_partkey") / 2.0).alias("rounded"))


@query("X4_math", f"SELECT p_partkey, {q6('pow(p_size, 0.5)')} AS power, {q6('log2(p_size)')} AS log2, {q6('exp(-p_size / 10.0)')} AS exp, {q6('ln(p_retailprice)')} AS ln, {q6('sin(p_size)')} AS sin, {q6('cos(p_size)')} AS cos, {q6('greatest(0.2, least(0.8, p_size / 50.0))')} AS clipped FROM part")
def maths(spark, sf):
    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").select(
        "p_partkey", r6(F.pow(size, F.lit(0.5))).alias("power"), r6(F.log2(size)).alias("log2"), r6(F.exp(-size / 10)).alias("exp"), r6(F.ln("p_retailprice")).alias("ln"),
        r6(F.sin(size)).alias("sin"), r6(F.cos(size)).alias("cos"), r6(sc.clip(size / 50, 0.2, 0.8)).alias("clipped"))


@query("X5_date_parts", f"SELECT event_id, {q6('(epoch_us(TIMESTAMP $$2024-02-01 00:00:00$$) - epoch_us(ts)) / 86400000000.0')} AS days, CAST(floor((epoch_us(TIMESTAMP $$2024-02-01 00:00:00$$) - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS whole_days, hour(ts) AS hour, isodow(ts) - 1 AS weekday FROM events")
def dates(spark, sf):
    days = sc.days_between(F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ts"))
    return table(spark, sf, "events").select("event_id", r6(days).alias("days"), F.floor(days).alias("whole_days"), F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))


@query("X6_strings", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, replace(p_name, ' ', '-') AS replaced, array_to_string(string_split(p_name, ' '), '+') AS joined, instr(p_name, 'ring') AS found, CAST(regexp_matches(p_brand, '^[0-9]') AS INTEGER) AS starts_with_digit FROM part")
def strings(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("replaced"), F.array_join(F.split("p_name", " "), "+").alias("joined"),
        F.instr("p_name", "ring").alias("found"), F.col("p_brand").rlike(r"^\d").cast("int").alias("starts_with_digit"))


@query("X7_title_case", "SELECT p_partkey, p_partkey % 2 = 0 AS is_title FROM part")
def title(spark, sf):
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.lower("p_name"))
    return table(spark, sf, "part").select("p_partkey", sc.is_title_case(spelled).alias("is_title"))


@query("X8_last_digits", "SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS legacy, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS parsed FROM orders")
def last_digits(spark, sf):
    month = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, sf, "orders").select("o_orderkey", sc.last_digits(month).alias("legacy"), sc.year_month(month).alias("parsed"))


@query("X9_arrays", "WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS x, [p_type, split_part(p_name, ' ', 1)] AS y FROM part) SELECT p_partkey, array_to_string(list_slice(x, 2, 3), ',') AS sliced, array_to_string(list_concat(x, y), ',') AS joined, list_contains(x, 'ring') AS has_ring, array_to_string(list_intersect(x, y), ',') AS shared, x[p_partkey % 2 + 1] AS nth FROM a")
def arrays(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("x"), F.array("p_type", F.split_part("p_name", F.lit(" "), F.lit(1))).alias("y"))
    return rows.select(
        "p_partkey", F.array_join(F.slice("x", 2, 2), ",").alias("sliced"), F.array_join(F.concat("x", "y"), ",").alias("joined"), F.array_contains("x", "ring").alias("has_ring"),
        F.array_join(F.array_intersect("x", "y"), ",").alias("shared"), F.element_at("x", (F.col("p_partkey") % 2 + 1).cast("int")).alias("nth"))


@query("X10_map_lookup", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 1.5::DOUBLE WHEN 'PROMO' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS factor FROM part")
def map_lookup(spark, sf):
    factors = F.create_map(F.lit("ECONOMY"), F.lit(1.5), F.lit("PROMO"), F.lit(2.0))
    return table(spark, sf, "part").select("p_partkey", sc.lookup(factors, F.col("p_type"), F.lit(0.5)).alias("factor"))


@query("X11_json", "SELECT p_partkey, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part")
def json_round_trip(spark, sf):
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))), F.lit("\n```"))
    parsed = F.from_json(sc.strip_code_fence(F.col("fenced")), "name string, size bigint")
    return table(spark, sf, "part").select("p_partkey", fenced.alias("fenced")).select("p_partkey", parsed.alias("r")).select("p_partkey", "r.name", "r.size")


@query("X12_vector_math", f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, {q6('list_dot_product(e, list_reverse(e))')} AS dot, {q6('sqrt(list_dot_product(e, e))')} AS norm, {q6('pow(list_distance(e, list_reverse(e)), 2)')} AS sq, {q6('list_avg(e)')} AS mean, list_position(e, list_max(e)) AS best FROM v")
def vector_math(spark, sf):
    e, back = F.col("embedding"), F.reverse("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", r6(vc.dot(e, back)).alias("dot"), r6(vc.norm(e)).alias("norm"), r6(vc.squared_distance(e, back)).alias("sq"), r6(vc.vector_mean(F.transform(e, lambda x: x.cast("double")))).alias("mean"), vc.argmax(e).alias("best"))


@query("X13_softmax_losses", f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, {q6('exp(e[1]) / list_sum(list_transform(e, lambda x: exp(x)))')} AS softmax_1, {q6('-ln(1 + exp(-e[2] * 10))')} AS log_sigmoid, {q6('CASE WHEN abs(e[3] * 20) < 1 THEN 0.5 * pow(e[3] * 20, 2) ELSE abs(e[3] * 20) - 0.5 END')} AS smooth_l1 FROM v")
def softmax_losses(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select(
        "vec_id", r6(sc.softmax(e)[0]).alias("softmax_1"), r6(sc.log_sigmoid(e[1] * 10)).alias("log_sigmoid"), r6(sc.smooth_l1(e[2] * 20, F.lit(0.0))).alias("smooth_l1"))


@query("X_md5_bucket", f"SELECT doc_id, {sql_hash(3, 'doc_id')} % 1000 AS bucket FROM documents")
def md5_bucket(spark, sf):
    return table(spark, sf, "documents").select("doc_id", bucket(3, 1000, "doc_id").alias("bucket"))
