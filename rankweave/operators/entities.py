"""Entity spans: template expansion, BIO tags, dictionary tagging and scoring."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave import skew
from rankweave.functions.sampling import bucket
from rankweave.functions.text import explode_tokens
from rankweave.functions.vectors import let
from rankweave.session import cut_lineage

# The query templates; the first slot is a merchant, the second a location.
TEMPLATES = [
    "nearest {} deals to {}", "{} near {}", "{} near me", "{} deals", "offers for {} in {}", "{} in {}",
    "{} discounts", "deals for {}", "{}", "discounts for {}", "{} offers", "offers for {}",
]
IGNORED = "-100"  # fixed value: label of a token that is not scored
SPANS = "array<struct<start:int,end:int,label:string>>"


def gazetteer_clean(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.trim(F.lower(column)).alias("value")).where(F.length(F.col(column)) > 4).distinct()


def template_expand(examples: DataFrame, templates: Sequence[str] = TEMPLATES, seed: int = 7) -> DataFrame:
    """(id, text, entities) from (id, merchant, location): one template per id, chosen by hash.

    Span offsets follow from the template text, not from a search in the result.
    """
    pick = bucket(seed, len(templates), "id")
    pieces = F.element_at(F.array(*[F.array(*[F.lit(p) for p in t.split("{}")]) for t in templates]), (pick + 1).cast("int"))
    staged = examples.withColumn("p", pieces)
    slots = F.size("p") - 1
    first, second, third = F.element_at("p", 1), F.try_element_at("p", F.lit(2)), F.coalesce(F.try_element_at("p", F.lit(3)), F.lit(""))
    m, loc = F.lower("merchant"), F.lower("location")
    end1 = F.length(first) + F.length(m)
    start2 = end1 + F.length(second)
    text = F.when(slots == 2, F.concat(first, m, second, loc, third)).otherwise(F.concat(first, m, second))
    merchant = F.struct(F.length(first).alias("start"), end1.alias("end"), F.lit("MERCHANT").alias("label"))
    place = F.struct(start2.alias("start"), (start2 + F.length(loc)).alias("end"), F.lit("LOCATION").alias("label"))
    return staged.select("id", F.lower(text).alias("text"), F.when(slots == 2, F.array(merchant, place)).otherwise(F.array(merchant)).alias("entities"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _bio_tags(tokens: pa.Array, entities: pa.Array) -> pa.Array:
    """Tags of all tokens of a batch: span edges are looked up among the token edges, which are running sums of lengths."""
    n = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    edge = np.concatenate([[0], np.cumsum(n)])
    length = pc.utf8_length(tokens.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    passed = np.concatenate([[0], np.cumsum(length + 1)])
    start = passed[:-1] - passed[edge[row]]
    spans, m = entities.flatten(), pc.fill_null(pc.list_value_length(entities), 0).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(m)), m) << 32
    starts, ends = (row << 32) + start, (row << 32) + start + length
    low, high = (own + pc.fill_null(spans.field(f), -1).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "end"))
    first, last = np.searchsorted(starts, low), np.searchsorted(ends, high)
    good = np.flatnonzero((first < len(row)) & (last < len(row)))
    good = good[(starts[first[good]] == low[good]) & (ends[last[good]] == high[good]) & (first[good] <= last[good])]
    span_of = np.full(len(row), -1, np.int64)
    if len(good):
        size = last[good] - first[good] + 1
        inside = np.repeat(first[good] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        np.maximum.at(span_of, inside, np.repeat(good, size))  # a later span wins
    tagged = np.flatnonzero(span_of >= 0)
    labels = spans.field("label").take(pa.array(span_of[tagged]))
    opens = np.where(first[span_of[tagged]] == tagged, "B-", "I-").tolist()
    tags = np.full(len(row), "O", dtype=object)
    tags[tagged] = [o + label if label is not None else None for o, label in zip(opens, labels.to_pylist(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(tags, pa.string()))


def spans_to_bio(df: DataFrame) -> DataFrame:
    """Adds tokens and ner_tags. A span counts when its edges are token edges; a later span wins."""
    tokens = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return df.withColumn("tokens", tokens).withColumn("ner_tags", _bio_tags(F.coalesce("tokens", F.array().cast("array<string>")), F.col("entities")))


def bio_label_ids(df: DataFrame, tags: str = "ner_tags") -> DataFrame:
    """(label, id): O is 0, the others follow in order; numbered by ranges, so any number of labels will do."""
    labels = explode_tokens(df, [], F.col(tags), "label").where(F.col("label").isNotNull() & (F.col("label") != "O")).distinct()
    numbered = skew.numbered(labels, [F.col("label")], "id")
    outside = df.sparkSession.range(1).select(F.lit("O").alias("label"), F.lit(0).cast("long").alias("id"))
    return numbered.select("label", F.col("id").cast("long")).unionByName(outside)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _with_ratios(counts: DataFrame) -> DataFrame:
    p = _ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives"))
    r = _ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_negatives"))
    out = counts.withColumns({"precision": p, "recall": r})
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1_score", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0)))


def entity_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Exact-span scores per label and overall; both sides are rows (id, start, end, label)."""
    keys = ["id", "start", "end", "label"]
    both = predicted.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("t")))
    merged = both.groupBy(*keys).agg(F.sum("p").alias("np"), F.sum("t").alias("nt"))
    counts = merged.rollup("label").agg(
        F.count_if((F.col("np") > 0) & (F.col("nt") > 0)).alias("true_positives"),
        F.count_if((F.col("np") > 0) & (F.col("nt") == 0)).alias("false_positives"),
        F.count_if((F.col("np") == 0) & (F.col("nt") > 0)).alias("false_negatives"),
        F.sum("np").alias("total_predictions"),
        F.sum("nt").alias("total_ground_truth"),
    )
    return _with_ratios(counts.withColumn("label", F.coalesce("label", F.lit("overall"))))


def entity_errors(predicted: DataFrame, truth: DataFrame, limit: int | None = None) -> DataFrame:
    """Examples whose span sets differ, with the extra and the missing spans; ``limit`` asks for a short report."""
    p = predicted.select("id", F.col("entities").alias("predicted"))
    both = truth.select("id", "text", F.col("entities").alias("truth")).join(p, "id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast(SPANS)))
    out = both.withColumns({"false_positives": F.array_except("predicted", "truth"), "false_negatives": F.array_except("truth", "predicted")})
    out = out.where((F.size("false_positives") > 0) | (F.size("false_negatives") > 0))
    return out if limit is None else out.orderBy("id").limit(limit)


def bio_spans(tags: Column) -> Column:
    """Spans (start, end, label) over token positions: B- opens, I- of the same type goes on, anything else closes.

    A token opens a span or goes on with that of the token before, and is the last of it if the next one does not go on, so the
    i-th opening token and the i-th last one belong together.
    """
    kind = lambda t: F.substr(t, F.lit(3))

    def goes_on(before: Column, tag: Column) -> Column:
        return F.coalesce(F.startswith(tag, F.lit("I-")) & (before != "O") & (kind(before) == kind(tag)), F.lit(False))

    def mark(all_tags: Column) -> Column:
        return F.transform(all_tags, lambda t, i: F.struct(
            i.alias("at"), kind(t).alias("label"), ((t != "O") & ~goes_on(F.get(all_tags, i - 1), t)).alias("first"),
            ((t != "O") & ~goes_on(t, F.get(all_tags, i + 1))).alias("last")))

    def spans(marks: Column) -> Column:
        opened, closed = F.filter(marks, lambda m: m["first"]), F.filter(marks, lambda m: m["last"])
        return F.zip_with(opened, closed, lambda a, z: F.struct(a["at"].alias("start"), (z["at"] + 1).alias("end"), a["label"].alias("label")))

    return let(let(tags, mark), spans)


def bio_metrics(df: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """One row: span precision, recall, F1 over all labels, and token accuracy, ignoring tokens marked -100."""
    pairs = F.filter(F.arrays_zip(F.col(predicted).alias("p"), F.col(truth).alias("t")), lambda x: x["t"] != IGNORED)
    kept = df.withColumn("pairs", pairs).select(
        F.transform("pairs", lambda x: x["p"]).alias("p"), F.transform("pairs", lambda x: x["t"]).alias("t"),
        F.size("pairs").alias("tokens"), F.size(F.filter("pairs", lambda x: x["p"] == x["t"])).alias("same"))
    spans = kept.select("tokens", "same", bio_spans(F.col("p")).alias("p"), bio_spans(F.col("t")).alias("t"))
    hits = F.size(F.array_intersect("p", "t"))
    counts = spans.agg(
        F.sum(hits).alias("true_positives"), F.sum(F.size("p") - hits).alias("false_positives"), F.sum(F.size("t") - hits).alias("false_negatives"),
        _ratio(F.sum("same"), F.sum("tokens")).alias("accuracy"))
    return _with_ratios(counts)


def dictionary_words(text: Column) -> Column:
    """Words as texts and dictionary values are compared: lower case, parted by anything but letters, digits and # & ' -."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}#&'-]+"), lambda w: w != "")


#: bytes of dictionary keys that one automaton holds
KEY_BYTES = 8 << 20
#: texts that are scanned at once
TEXT_ROWS = 256


def _matcher(shared):
    """(id, label, value, pos) of a batch of texts, each a string of its words with a blank around every word."""
    def run(batches):
        import ahocorasick

        entries = shared.value
        automaton = ahocorasick.Automaton()
        for i, (key, *_) in enumerate(entries):
            automaton.add_word(f" {key} ", i)
        automaton.make_automaton()
        for batch in (b.slice(low, TEXT_ROWS) for b in batches for low in range(0, b.num_rows, TEXT_ROWS)):
            row, entry, place = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                first: dict[int, int] = {}
                for end, found in automaton.iter(text or ""):
                    first.setdefault(found, end)
                if first:
                    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
                    row += [i] * len(first)
                    entry += first
                    place += np.searchsorted(blanks, [end - len(entries[found][0]) - 1 for found, end in first.items()]).tolist()
            values = [[(r, v, label, p) for v, label in entries[e][1]] for r, e, p in zip(row, entry, place, strict=True)]
            flat = [x for own in values for x in own]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([x[0] for x in flat], pa.int64())), pa.array([x[2] for x in flat], pa.string()),
                pa.array([x[1] for x in flat], pa.string()), pa.array([x[3] for x in flat], pa.int32())], names=["id", "label", "value", "pos"])

    return run


def tag_with_dictionary(texts: DataFrame, gazetteer: DataFrame, max_words: int | None = None, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(id, label, value, pos): every dictionary value that occurs as whole words in a text, first position each.

    ``texts`` has id, text; ``gazetteer`` value and label. Both sides are cut into words alike, so a value with
    punctuation is found where its words follow each other, and is returned as the dictionary writes it. All values are
    matched in one pass over a text by an automaton, however long they are. A dictionary beyond ``key_bytes`` (measured) is cut
    into groups of that size by a hash, with a pass over the texts each. ``max_words`` leaves out longer values.
    """
    known = gazetteer.select("value", "label", dictionary_words(F.col("value")).alias("gw")).where(F.size("gw") > 0)
    if max_words is not None:
        known = known.where(F.size("gw") <= max_words)
    pairs = known.select(F.array_join("gw", " ").alias("key"), "value", "label").distinct()
    keyed = cut_lineage(pairs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("value", "label"))).alias("values")))
    size = keyed.agg(F.sum(F.octet_length("key") + F.aggregate("values", F.lit(0), lambda a, v: a + F.octet_length(v["value"])))).first()[0] or 0
    spaced = texts.select("id", F.concat(F.lit(" "), F.array_join(dictionary_words(F.col("text")), " "), F.lit(" ")).alias("t"))
    fields = {"id": texts.schema["id"].dataType, "label": T.StringType(), "value": T.StringType(), "pos": T.IntegerType()}
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
    groups, out = max(1, -(-size // key_bytes)), None
    for group in range(groups):
        part = keyed.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == group).collect()  # about key_bytes
        entries = sorted((r["key"], [(v["value"], v["label"]) for v in r["values"]]) for r in part)
        if entries:
            found = spaced.mapInArrow(_matcher(texts.sparkSession.sparkContext.broadcast(entries)), schema)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)


def extract_entities(texts: DataFrame, gazetteer: DataFrame, max_words: int | None = None, size: int = 1000) -> DataFrame:
    """(id, label, part, values): distinct values by label in order of appearance, in bounded parts."""
    found = tag_with_dictionary(texts, gazetteer, max_words)
    return skew.pack_ranged(found, ["id", "label"], F.col("value"), [F.col("pos"), F.col("value")], "values", size)


def understand_queries(queries: DataFrame, gazetteer: DataFrame, max_words: int | None = None) -> DataFrame:
    """(query_id, label, value): entities of a query, to be used as filters."""
    found = tag_with_dictionary(queries.select(F.col("query_id").alias("id"), "text"), gazetteer, max_words)
    return found.select(F.col("id").alias("query_id"), "label", "value")


def filter_candidates(candidates: DataFrame, entities: DataFrame, item_values: DataFrame) -> DataFrame:
    """Keep (query_id, item_id) rows whose item has a matching value for every label the query names.

    Only the given candidates are looked at; queries and items that share a value are never paired up.
    """
    asked = entities.select("query_id", "label", "value").distinct()
    wanted = asked.groupBy("query_id").agg(F.countDistinct("label").alias("n_labels"))
    held = item_values.select("item_id", "label", "value").distinct()
    met = (
        candidates.select("query_id", "item_id").distinct().join(asked, "query_id").join(held, ["item_id", "label", "value"], "left_semi")
        .groupBy("query_id", "item_id").agg(F.countDistinct("label").alias("n_met"))
    )
    return (
        candidates.join(wanted, "query_id", "left").join(met, ["query_id", "item_id"], "left")
        .where(F.coalesce("n_met", F.lit(0)) >= F.coalesce("n_labels", F.lit(0)))
        .select(candidates.columns)
    )


def entity_sets(entities: DataFrame) -> DataFrame:
    """(query_id, entities): what a query names, as sorted (label, value) pairs; queries that name the same share one set."""
    return entities.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("label", "value"))).alias("entities"))


def matching_items(sets: DataFrame, item_values: DataFrame) -> DataFrame:
    """(entities, item_id) for distinct sets of entities: the items with a matching value for every label that is named.

    The items come from the label whose values the fewest items have, by an equi-join on (label, value); the
    other labels are then checked for these items only. A value that very many items share is joined only for
    sets that name nothing rarer.
    """
    held = cut_lineage(item_values.select("item_id", "label", "value").where(F.col("value").isNotNull()).distinct())
    counts = held.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))
    distinct = sets.select("entities").distinct().withColumn("set", F.xxhash64("entities"))
    flat = cut_lineage(distinct.select("entities", "set", F.explode("entities").alias("e")).select("entities", "set", "e.label", "e.value").join(counts, ["label", "value"], "left"))
    offers = flat.groupBy("entities", "set", "label").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rarest = cut_lineage(offers.groupBy("entities", "set").agg(F.min(F.struct("n", "label")).alias("r"), F.count(F.lit(1)).alias("n_labels")).select("entities", "set", F.col("r.label").alias("label"), "n_labels"))
    keys = ["entities", "set"]
    offered = flat.join(rarest, [*keys, "label"]).join(held, ["label", "value"]).select(*keys, "n_labels", "item_id").distinct()
    others = flat.join(rarest.drop("n_labels"), [*keys, "label"], "left_anti").select(*keys, "label", "value")
    single = offered.where(F.col("n_labels") == 1).select("entities", "item_id")
    several = offered.where(F.col("n_labels") > 1).join(others, keys).join(held, ["item_id", "label", "value"], "left_semi")
    met = several.groupBy(*keys, "item_id", "n_labels").agg(F.count_distinct("label").alias("n_met")).where(F.col("n_met") == F.col("n_labels") - 1)
    return single.unionByName(met.select("entities", "item_id"))
