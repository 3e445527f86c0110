"""Vocabulary, encoding, lookups, profiles and prompt formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.text import explode_tokens, tokenize_space

PAD, UNK = 0, 1

# The sentiment word lists.
POSITIVE_WORDS = ["great", "love", "amazing", "excellent", "best", "wonderful", "fantastic", "perfect"]
NEGATIVE_WORDS = ["bad", "terrible", "awful", "hate", "worst", "horrible", "poor", "disappointing"]


def build_vocabulary(df: DataFrame, tokens: Column, min_freq: int = 1, max_size: int = 20000) -> DataFrame:
    """(token, freq, id): most frequent first, ties by token, ids from 2; ids 0 and 1 are PAD and UNK.

    The window numbers only the rows kept by the limit, so it is bounded by ``max_size``.
    """
    counts = explode_tokens(df, [], tokens, "token").groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    kept = counts.where(F.col("freq") >= min_freq).orderBy(F.col("freq").desc(), "token").limit(max_size - 2)
    order = Window.orderBy(F.col("freq").desc(), "token")
    return kept.withColumn("id", F.row_number().over(order) + 1)


def encode_pad(df: DataFrame, key: str, tokens: Column, vocabulary: DataFrame, length: int = 16) -> DataFrame:
    """(key, ids): the first ``length`` tokens as ids, UNK for unknown ones, PAD at the end.

    The planner broadcasts the vocabulary if its size allows that.
    """
    head = df.select(key, F.slice(tokens, 1, length).alias("t"))
    flat = head.select(key, F.posexplode_outer("t").alias("pos", "token"))
    coded = flat.join(vocabulary.select("token", "id"), "token", "left")
    filled = F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(UNK)))
    packed = coded.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", filled.alias("id"))))).alias("l"))
    ids = F.transform("l", lambda s: s["id"])
    return packed.select(key, F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(length) - F.size("l"))).alias("ids"))


def mean_pool(encoded: DataFrame, key: str, table: DataFrame, dims: int) -> DataFrame:
    """Mean vector of the non-PAD ids that ``table`` (id, vector) knows; a zero vector when there is none."""
    flat = encoded.select(key, F.explode("ids").alias("id")).where(F.col("id") != PAD)
    zero = F.array_repeat(F.lit(0.0), dims)
    # a running mean per key: the vectors of a long text are never gathered
    vectors = table.select("id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("v"))
    summed = flat.join(vectors, "id").groupBy(key).agg(Summarizer.mean(F.col("v")).alias("m"))
    # the zero vector takes the place of a missing mean before the conversion, which takes no nulls
    return encoded.select(key).join(summed, key, "left").select(key, vector_to_array(F.coalesce("m", array_to_vector(zero))).alias("vector"))


def substring_search(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the query in one of the columns, ignoring case; an empty query keeps every row."""
    if not query.strip():
        return df
    needle = query.strip().lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(needle))
    return df.where(hit)


def keyword_lookup(df: DataFrame, text: str, knowledge: Mapping[str, str], out: str = "answer", missing: str = "nothing known about <{}>") -> DataFrame:
    """Value of the first key, in mapping order, that the text contains; else ``missing`` around the text and the keys to ask for."""
    before, after = missing.split("{}", 1)
    answer = F.concat(F.lit(before), F.col(text), F.lit(f"{after}, ask for: {' | '.join(knowledge)}"))
    for key, value in reversed(list(knowledge.items())):
        answer = F.when(F.contains(F.lower(F.col(text)), F.lit(key)), F.lit(value)).otherwise(answer)
    return df.withColumn(out, answer)


def text_profile(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns({"words": F.size(tokenize_space(F.col(text))), "characters": F.length(text)})


def corpus_summary(profiled: DataFrame, by: str) -> DataFrame:
    return profiled.groupBy(by).agg(
        F.count(F.lit(1)).alias("texts"), F.sum("words").alias("words"), F.sum("characters").alias("characters"), F.avg("words").alias("mean_words"))


def sentiment(df: DataFrame, text: str, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS) -> DataFrame:
    """Label and confidence from the distinct lexicon words in the text."""
    words = tokenize_space(F.col(text))

    def distinct_hits(lexicon: Sequence[str]) -> Column:
        return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in lexicon])))

    staged = df.withColumns({"n_positive": distinct_hits(positive), "n_negative": distinct_hits(negative)})
    pos, neg = F.col("n_positive"), F.col("n_negative")
    return staged.withColumns({
        "sentiment": F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral"),
        "confidence": F.when(pos == neg, F.lit(0.5)).otherwise(F.greatest(pos, neg) / (pos + neg)),
    })


def validate_and_clean(df: DataFrame, text: str, prefix: str = "clean> ") -> DataFrame:
    """Flag empty input, trim and upper-case, add a prefix; ``log`` has one entry a step, in order."""
    filled = F.length(text) > 0
    steps = [F.when(filled, "input ok").otherwise("input empty"), F.lit("trimmed, upper case"), F.lit(f"prefix '{prefix}'")]
    return df.withColumns({
        "cleaned": F.concat(F.lit(prefix), F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))),
        "error_count": F.when(filled, 0).otherwise(1),
        "log": F.array(*steps),
    })


def instruction_format(df: DataFrame, instruction: str = "instruction", plain: str = "input", query: str = "query", items: str = "items", output: str = "output") -> DataFrame:
    """Prompt, full text and the length of the prompt, which is not a training target (the headings are fixed values).

    The input is ``query`` with ``items`` where ``items`` is not null, else the plain input.
    """
    listed = F.concat(F.lit("Query: "), F.col(query), F.lit("\nItems:\n"), F.array_join(items, "\n"))
    body = F.when(F.col(items).isNotNull(), listed).otherwise(F.col(plain))
    prompt = F.concat(F.lit("### Instruction:\n"), F.col(instruction), F.lit("\n\n### Input:\n"), body, F.lit("\n\n### Response:\n"))
    return df.withColumn("prompt", prompt).withColumns({
        "full_text": F.concat("prompt", F.col(output)), "prompt_length": F.length("prompt")})


def status_lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, dim_value: str) -> DataFrame:
    """Equi lookup ignoring case, with status and either the value or a message."""
    right = dim.groupBy(F.lower(dim_key).alias("__key")).agg(F.min(dim_value).alias("__value"))
    found = F.col("__key").isNotNull()
    return df.withColumn("__low", F.lower(key)).join(right, F.col("__low") == F.col("__key"), "left").withColumns({
        "status": F.when(found, "success").otherwise("error"),
        "report": F.when(found, F.col("__value").cast("string")).otherwise(F.concat(F.lit("no entry for '"), F.col(key), F.lit("'"))),
    }).drop("__low", "__key", "__value")
