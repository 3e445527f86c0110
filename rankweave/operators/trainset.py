"""Training pairs, triplets and batches for retrieval models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave import skew
from rankweave.functions.hooks import Batch, map_batch
from rankweave.functions.sampling import bucket, md5_key, md5_long
from rankweave.functions.vectors import cosine, dot, let
from rankweave.operators import knn
from rankweave.operators.lexical import top_k
from rankweave.session import cut_lineage


def faq_anchors(faq: DataFrame, questions: str = "similar_questions") -> DataFrame:
    """Rows with at least one question; the anchor is the first."""
    return faq.where(F.col(questions).isNotNull() & (F.size(questions) > 0)).withColumn("anchor", F.element_at(questions, 1))


def mine_hard_negatives(rows: DataFrame, k: int = 20, n: int = 5) -> DataFrame:
    """(id, negatives): passages of other articles that score above the row's own positive.

    ``rows`` has unique id, article_id, anchor_vec and positive_vec (unit vectors). Of the ``k``
    nearest passages the first ``n`` in score order stay; rows with none keep an empty list.
    """
    asked = rows.select("id", F.col("anchor_vec").alias("vec"))
    corpus = rows.select("id", F.col("positive_vec").alias("vec"))
    own = rows.select(F.col("id").alias("query_id"), F.col("article_id").alias("own_article"), dot(F.col("anchor_vec"), F.col("positive_vec")).alias("own_score"))
    articles = rows.select(F.col("id").alias("item_id"), "article_id")
    found = knn.exact_topk(asked, corpus, k).drop("rank").join(articles, "item_id").join(own, "query_id")
    harder = found.where((F.col("article_id") != F.col("own_article")) & (F.round("score", 9) > F.round("own_score", 9)))
    kept = top_k(harder, n, item="item_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    packed = kept.select(F.col("query_id").alias("id"), F.transform("l", lambda s: s["item_id"]).alias("negatives"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id").join(packed, "id", "left").select("id", F.coalesce("negatives", F.array().cast(f"array<{kind}>")).alias("negatives"))


def hard_negative_rows(rows: DataFrame, k: int = 20, n: int = 5) -> DataFrame:
    """(id, anchor, positive, negatives) with the texts themselves; see ``mine_hard_negatives``.

    ``rows`` has the texts anchor and positive as well. A negative is the positive text of the row that was mined.
    """
    mined = mine_hard_negatives(rows, k, n)
    flat = mined.select("id", F.posexplode("negatives").alias("place", "item_id"))
    texts = rows.select(F.col("id").alias("item_id"), F.col("positive").alias("text"))
    listed = flat.join(texts, "item_id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("l"))
    negatives = F.coalesce(F.transform("l", lambda s: s["text"]), F.array().cast("array<string>"))
    return rows.select("id", "anchor", "positive").join(listed, "id", "left").select("id", "anchor", "positive", negatives.alias("negatives"))


def pad_negatives(df: DataFrame, k: int, positive: str = "positive", negatives: str = "negatives") -> DataFrame:
    """Exactly ``k`` negatives: cycled or cut; without any, the positive repeated."""
    have = F.size(negatives) > 0
    cycled = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(negatives, (i % F.size(negatives) + 1).cast("int")))
    return df.withColumn(negatives, F.when(have, cycled).otherwise(F.array_repeat(F.col(positive), k)))


def zip_cycle(df: DataFrame, positives: str, negatives: str) -> DataFrame:
    """One row per positive with negative number ``i mod n``; rows missing either list are skipped."""
    usable = df.where((F.size(positives) > 0) & (F.size(negatives) > 0))
    flat = usable.select("*", F.posexplode(positives).alias("i", "positive"))
    return flat.withColumn("negative", F.element_at(negatives, (F.col("i") % F.size(negatives) + 1).cast("int"))).drop(positives, negatives)


def explode_passages(df: DataFrame) -> DataFrame:
    """(query, idx, is_selected, passage) from a struct of two aligned arrays."""
    zipped = F.arrays_zip(F.col("passages.is_selected").alias("is_selected"), F.col("passages.passage_text").alias("passage"))
    return df.select("query", F.posexplode(zipped).alias("idx", "p")).select("query", "idx", "p.is_selected", "p.passage")


def passage_triplets(passages: DataFrame, n: int = 5) -> DataFrame:
    """First selected passage as positive and the first ``n`` unselected as negative_1..n; fewer drop the query."""
    flagged = passages.withColumn("is_selected", F.col("is_selected") == 1)
    order = Window.partitionBy("query", "is_selected").orderBy("idx", "passage")
    kept = flagged.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    pick = lambda selected, r: F.max(F.when((F.col("is_selected") == selected) & (F.col("r") == r), F.col("passage")))
    wide = kept.groupBy("query").agg(pick(True, 1).alias("positive"), *[pick(False, i).alias(f"negative_{i}") for i in range(1, n + 1)])
    return wide.where(F.col("positive").isNotNull() & F.col(f"negative_{n}").isNotNull())


def _stratum_pick(size: Column, picks: int, j: Column, draw: Column) -> Column:
    """Index in [0, size): one from each of ``picks`` equal strata, or any when there are fewer rows than picks."""
    low, high = F.floor(j * size / picks), F.floor((j + 1) * size / picks)
    return F.when(size >= picks, low + F.pmod(draw, F.greatest(high - low, F.lit(1)))).otherwise(F.pmod(draw, F.greatest(size, F.lit(1))))


def class_triplets(df: DataFrame, text: str, label: str, n_pos: int = 5, n_neg: int = 20, seed: int = 7, key: str | None = None) -> DataFrame:
    """(class, anchor, kind, j, text): positives of the anchor's class, negatives with texts that class never uses.

    Works on distinct texts, so copies neither repeat nor crowd a class. With ``key`` (unique) every row is an anchor of its
    own, copies included, with draws of its own, and ``key`` leads the columns. Picks are made by index: texts are numbered once over all and once
    per class, and every pick is an equi-join on a number. One text per stratum makes picks distinct;
    a short pool repeats, and a class of one text uses itself.
    """
    pairs = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("class"), F.col(text).alias("text")).distinct()
    if len(pairs.select("class").distinct().limit(2).collect()) < 2:
        raise ValueError("need at least two classes")
    texts = skew.shuffled_ordinal(pairs.select("text").distinct(), [], md5_key(seed, "text"), "g").withColumn("g", F.col("g") - 1)
    members = skew.ordinal(pairs.join(texts, "text"), ["class"], [F.col("g")], F.floor(F.col("g") / 1000), "i").withColumn("i", F.col("i") - 1)
    members = cut_lineage(members)  # numbered once, read by every draw and look-up below
    texts = members.groupBy("g").agg(F.first("text").alias("text"))
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n_class"))
    total = members.agg(F.max("g") + 1).scalar()
    who = [] if key is None else ["__key"]
    asked = members if key is None else df.select(F.col(key).alias("__key"), F.col(label).alias("class"), F.col(text).alias("text")).join(members, ["class", "text"])
    anchors = skew.attach(asked, sizes, ["class"]).withColumn("n_all", total)

    def draws(kind: str, picks: int) -> DataFrame:
        flat = anchors.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(picks - 1))))
        return flat.withColumns({"kind": F.lit(kind), "draw": md5_long(f"{seed}{kind}", "class", who[0] if who else "text", "j")})

    pos = draws("positive", n_pos).withColumn("pool", F.col("n_class") - 1)
    pos = pos.withColumn("r", _stratum_pick(F.col("pool"), n_pos, F.col("j"), F.col("draw")))
    pos = pos.withColumn("at", F.when(F.col("pool") == 0, F.col("i")).otherwise(F.col("r") + (F.col("r") >= F.col("i")).cast("int")))
    positives = pos.select(*who, "class", F.col("text").alias("anchor"), "kind", "j", F.col("at").alias("i")).join(members.select("class", "i", "text"), ["class", "i"])

    neg = draws("negative", n_neg).withColumn("pool", F.col("n_all") - F.col("n_class")).where(F.col("pool") > 0)
    neg = neg.select(*who, "class", F.col("text").alias("anchor"), "kind", "j", _stratum_pick(F.col("pool"), n_neg, F.col("j"), F.col("draw")).alias("r"))
    # the r-th text outside a class is number r plus the members that lie before it
    marks = members.select("class", (F.col("g") - F.col("i")).alias("r"), F.lit(True).alias("is_member")).unionByName(
        neg.select(*who, "class", "r", F.lit(False).alias("is_member"), "anchor", "kind", "j"), allowMissingColumns=True)
    counted = skew.running_count(marks, ["class"], [F.col("r"), F.col("is_member").desc()], F.floor(F.col("r") / 1000), F.col("is_member"), "before")
    wanted = counted.where(~F.col("is_member")).select(*who, "class", "anchor", "kind", "j", (F.col("r") + F.col("before")).alias("g"))
    negatives = wanted.join(texts.select("g", "text"), "g")
    columns = [*who, "class", "anchor", "kind", "j", "text"]
    out = positives.select(columns).unionByName(negatives.select(columns))
    return out if key is None else out.withColumnRenamed("__key", key)


def coded_sets(keyed: DataFrame) -> DataFrame:
    """(set_id, set_key, codes, m) from (item_id, set_key, tags): one row per distinct tag set.

    A code is a unique number of a tag that grows with the number of sets holding it, so sorted codes
    list the rarest tags first. Set ids follow the digest of the set.
    """
    sets = keyed.groupBy("set_key").agg(F.first("tags").alias("tags"), F.count(F.lit(1)).alias("m"))
    sets = cut_lineage(skew.shuffled_ordinal(sets, [], F.md5("set_key"), "set_id"))
    flat = sets.select("set_id", F.explode("tags").alias("tag"))
    tags = skew.shuffled_ordinal(flat.groupBy("tag").agg(F.count(F.lit(1)).alias("df")), [], F.md5("tag"), "n")
    # 28 bits of frequency above 35 bits of number
    codes = flat.join(tags.select("tag", F.shiftleft("df", 35).bitwiseOR(F.col("n")).alias("code")), "tag")
    lists = codes.groupBy("set_id").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return cut_lineage(sets.select("set_id", "set_key", "m").join(lists, "set_id"))


def covering_sets(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """``asked`` x (y, m of y): the sets that share at least ``need`` of the tags ``x_codes`` of a row of ``asked``.

    If x and y share that many tags, their rarest shared tag is among the ``|x| - need + 1`` rarest of
    x. Only those are joined, and a pair is kept at its rarest shared tag, so frequent tags are hardly
    joined and no pair appears twice.
    """
    x = asked.withColumn("code", F.explode(F.slice("x_codes", F.lit(1), F.size("x_codes") - F.col("need") + 1)))
    y = sets.select(F.col("set_id").alias("y"), "m", F.col("codes").alias("y_codes"), F.explode("codes").alias("code"))
    shared = F.array_intersect("x_codes", "y_codes")
    return x.join(y, "code").where((F.size(shared) >= F.col("need")) & (F.element_at(shared, 1) == F.col("code"))).drop("code", "x_codes", "need", "y_codes")


#: draws of one tag set; its members are dealt over them by a hash
DRAWS = 4


def draw_clock(seed: str, weight: Column, g: Column, *key: str) -> Column:
    """Exponential clock of a candidate for draw ``g``: the least one is ``weight``-proportionally chosen.

    The chance is a slice of 8 hex digits of one md5, so all draws of a candidate take one hash.
    """
    digits = F.conv(F.substring(md5_key(seed, *key), (8 * g + 1).cast("int"), F.lit(8)), 16, 10).cast("double")
    return -F.log((digits + 1.0) / 2.0**32) / weight


def overlap_triplets(items: DataFrame, threshold: float = 0.5, seed: int = 7) -> DataFrame:
    """(anchor, positive, negative) from (item_id, tags).

    The positive is drawn among items that hold more than half of the anchor's tags, the negative
    among items, other than the two, that hold at least ``threshold`` of the positive's tags.
    Items with equal tag sets are one set and only sets are compared. A draw runs a clock for every qualifying set,
    faster the more items it offers, and keeps the least while the sets are joined: no pair is stored or laid
    out. The members of a set are dealt over DRAWS draws of it, and each picks an item of the drawn set by a hash of its own.
    """
    keyed = items.select("item_id", F.array_sort(F.array_distinct("tags")).alias("tags")).where(F.size("tags") > 0)
    keyed = keyed.withColumn("set_key", F.array_join("tags", "\u0001"))
    sets = coded_sets(keyed)
    placed = keyed.select("item_id", "set_key").join(sets.select("set_key", "set_id", "m"), "set_key").drop("set_key")
    members = skew.shuffled_ordinal(placed, ["set_id"], md5_key(seed, "item_id"), "o").withColumn("o", F.col("o") - 1)
    members = cut_lineage(members.withColumn("g", bucket(f"{seed}g", DRAWS, "item_id")))
    size = F.size("codes")

    def chosen(offers: DataFrame, tag: str, keys: Sequence[str]) -> DataFrame:
        """(keys, y, w) with the least clock; ``offers`` has x, g, y and w, the number of items that y offers."""
        clock = draw_clock(f"{seed}{tag}", F.col("w"), F.col("g"), "x", "y")
        best = offers.where(F.col("w") > 0).groupBy(*keys).agg(F.min(F.struct(clock.alias("c"), "y", "w")).alias("b"))
        return best.select(*keys, "b.y", "b.w")

    def pick(asked: DataFrame, tag: str, taken: Sequence[tuple[str, str]], found: str) -> DataFrame:
        """An item of set y for each anchor, by number among those not taken: ``taken`` names (set, place) columns."""
        at = F.pmod(md5_long(f"{seed}{tag}", "anchor"), F.col("w"))
        # places of y that are taken, in order; a place at or after one moves up by one
        held = F.array_sort(F.array_compact(F.array(*[F.when(F.col(s) == F.col("y"), F.col(o)) for s, o in taken])))
        staged = asked.withColumns({"at": at, "held": held})
        place = F.aggregate("held", F.col("at"), lambda acc, h: acc + (acc >= h).cast("long"))
        who = members.select(F.col("set_id").alias("y"), F.col("o").alias("at"), F.col("item_id").alias(found))
        return staged.withColumn("at", place).join(who, ["y", "at"]).drop("held", "w")

    draws = members.groupBy(F.col("set_id").alias("x"), "g").agg(F.lit(1).alias("one")).drop("one")
    asked = sets.select(F.col("set_id").alias("x"), F.col("codes").alias("x_codes"), (F.floor(size / 2) + 1).cast("int").alias("need")).join(draws, "x")
    offers = covering_sets(asked, sets).withColumn("w", F.col("m") - (F.col("x") == F.col("y")).cast("long"))
    anchors = members.select(F.col("set_id").alias("x"), "g", F.col("item_id").alias("anchor"), F.col("o").alias("anchor_o"))
    first = pick(anchors.join(chosen(offers, "p", ["x", "g"]), ["x", "g"]), "p", [("x", "anchor_o")], "positive")
    first = cut_lineage(first.withColumnsRenamed({"y": "py", "at": "positive_o"}))

    wanted = F.greatest(F.ceil(F.lit(float(threshold)) * size), F.lit(1)).cast("int")
    tags_of = sets.select(F.col("set_id").alias("py"), F.col("codes").alias("x_codes"), wanted.alias("need"))
    offers = covering_sets(first.select("x", "g", "py").distinct().join(tags_of, "py"), sets)
    offers = offers.withColumn("w", F.col("m") - (F.col("x") == F.col("y")).cast("long") - (F.col("py") == F.col("y")).cast("long"))
    second = pick(first.join(chosen(offers, "n", ["x", "g", "py"]), ["x", "g", "py"]), "n", [("x", "anchor_o"), ("py", "positive_o")], "negative")
    return second.select("anchor", "positive", "negative")


def to_query_pos_neg(df: DataFrame) -> DataFrame:
    return df.select(F.col("anchor").alias("query"), F.array("positive").alias("pos"), F.col("negatives").alias("neg"))


def query_prefix(df: DataFrame, prefix: str, column: str = "anchor") -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column)))


def similarity_band_augment(df: DataFrame, low: float = 0.8, high: float = 0.95) -> DataFrame:
    """Originals, plus rows whose augmented positive or negative is close to, but not the same as, its source.

    Needs query, positive, negative, aug_positive, aug_negative and vectors *_vec of the last four.
    """
    def in_band(a: str, b: str) -> Column:
        score = F.round(cosine(F.col(a), F.col(b)), 9)
        return (score > low) & (score < high)

    original = df.select("query", "positive", "negative", F.lit("original").alias("meta"))
    new_pos = df.where(in_band("positive_vec", "aug_positive_vec")).select("query", F.col("aug_positive").alias("positive"), "negative", F.lit("aug_pos").alias("meta"))
    new_neg = df.where(in_band("negative_vec", "aug_negative_vec")).select("query", "positive", F.col("aug_negative").alias("negative"), F.lit("aug_neg").alias("meta"))
    return original.unionByName(new_pos).unionByName(new_neg)


def train_test_split(df: DataFrame, key: str, train_percent: int = 80, seed: int = 7) -> DataFrame:
    """``split`` column from a hash of the key: the same on every read."""
    return df.withColumn("split", F.when(bucket(seed, 100, key) < train_percent, "train").otherwise("test"))


def named_split(splits: Mapping[str, DataFrame], key: str, seed: int = 7) -> DataFrame:
    """Use a ``dev`` table as test where one is given, else split the train table by key."""
    if "dev" in splits:
        return splits["train"].withColumn("split", F.lit("train")).unionByName(splits["dev"].withColumn("split", F.lit("test")))
    return train_test_split(splits["train"], key, seed=seed)


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """(label, id) in sorted order from 0, for any number of distinct labels: they are numbered by ranges."""
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    return skew.numbered(labels, [F.col(label)], "id").withColumn("id", F.col("id") - 1)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def group_relevance(questions: DataFrame, articles: DataFrame, judge: Column | Batch, done: DataFrame | None = None) -> DataFrame:
    """One judged row per (question, existing candidate article); pairs in ``done`` are skipped before judging.

    A batch judge gets (question, text) pairs; a pair it fails on is not relevant.
    """
    pairs = questions.select("question", F.explode("list_of_articleId").alias("article_id")).distinct()
    if done is not None:
        pairs = pairs.join(done.select("question", "article_id"), ["question", "article_id"], "left_anti")
    joined = pairs.join(articles, "article_id")
    if isinstance(judge, Column):
        judged = joined.withColumn("is_relevant", F.coalesce(judge, F.lit(False)))
    else:
        judged = map_batch(joined, ["question", "text"], judge, "is_relevant", "boolean", fallback=False)
    return judged.select("question", "article_id", "is_relevant")


def consolidate_relevance(questions: DataFrame, judged: DataFrame, size: int = 1000) -> DataFrame:
    """(question, part, gt_docs): sorted relevant ids, in parts of at most ``size``; one empty list when there are none."""
    relevant = judged.where("is_relevant").select("question", "article_id").distinct()
    packed = skew.pack_ranged(relevant, ["question"], F.col("article_id"), [F.col("article_id")], "gt_docs", size)
    kind = judged.schema["article_id"].dataType.simpleString()
    return questions.select("question").distinct().join(packed, "question", "left").select(
        "question", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("gt_docs", F.array().cast(f"array<{kind}>")).alias("gt_docs"))


def parse_numbered_list(text: Column) -> Column:
    """Lines of a reply without their number; unnumbered lines are kept, blank ones dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.trim(F.regexp_replace(x, r"^\d+\.", "")))


def question_expand(chunks: DataFrame, generate: Batch, evolve: Batch, strategies: Sequence[str], known: Sequence[str], seed: int = 7) -> DataFrame:
    """Base questions of each chunk and one evolved question per base question, with their lineage.

    ``generate`` gets (content, context), ``evolve`` gets (question, strategy).
    """
    unknown = sorted(set(strategies) - set(known))
    if unknown:
        raise ValueError(f"unknown strategy: {unknown}")
    replies = map_batch(chunks.select("chunk_id", "chunk_content", "chunk_context"), ["chunk_content", "chunk_context"], generate, "reply", "string", fallback="")
    base = replies.select("chunk_id", F.explode(parse_numbered_list(F.col("reply"))).alias("question"))
    options = F.array(*[F.lit(s) for s in strategies])
    chosen = F.element_at(options, (bucket(seed, len(strategies), "chunk_id", "question") + 1).cast("int"))
    evolved = map_batch(base.withColumn("strategy", chosen), ["question", "strategy"], evolve, "evolved", "string")
    rows = F.array(
        F.struct(F.lit("base_question").alias("type"), F.col("question").alias("question"), F.lit(None).cast("string").alias("parent_question")),
        F.struct(F.concat(F.lit("evolved_"), "strategy").alias("type"), F.trim("evolved").alias("question"), F.col("question").alias("parent_question")),
    )
    return evolved.select("chunk_id", F.explode(rows).alias("r")).select("chunk_id", "r.*")


def unique_corpus(df: DataFrame, lists: Sequence[str]) -> DataFrame:
    """(id, text): distinct texts over several list columns, numbered from 0 in md5 order."""
    flat = df.select(F.explode(F.concat(*lists)).alias("text")).where(F.col("text").isNotNull()).distinct()
    return skew.shuffled_ordinal(flat, [], md5_key(0, "text"), "id").select((F.col("id") - 1).alias("id"), "text")


def corpus_relevance(df: DataFrame, corpus: DataFrame, key: str, relevant: str) -> DataFrame:
    """(key, text id) for every distinct relevant text of a query."""
    return df.select(key, F.explode(F.array_distinct(relevant)).alias("text")).join(corpus, "text").select(key, "id")


def batch_no_duplicates(df: DataFrame, size: int, key: str, anchor: str = "anchor", positive: str = "positive", seed: int = 7) -> DataFrame:
    """``round`` and ``batch`` numbers such that no batch holds an anchor or a positive twice.

    A round is the pair (occurrence of the anchor, occurrence of the positive), so its rows differ in
    both columns; a batch is a run of ``size`` rows of one round.
    """
    once = skew.shuffled_ordinal(df, [anchor], md5_key(f"{seed}a", key), "oa")
    twice = skew.shuffled_ordinal(once, [positive], md5_key(f"{seed}p", key), "op")
    rows = skew.shuffled_ordinal(twice, ["oa", "op"], md5_key(f"{seed}b", key), "i")
    return rows.withColumn("round", F.concat_ws("-", F.col("oa").cast("string"), F.col("op").cast("string"))).withColumn(
        "batch", F.floor((F.col("i") - 1) / size)).drop("oa", "op", "i")


def catalogue_enrich(items: DataFrame, keys: Sequence[str], generate: Batch) -> DataFrame:
    """One generated description and tag list per distinct key, joined back onto the items.

    ``generate`` gets key tuples and returns JSON {"description": ..., "tags": [...]}.
    """
    distinct = items.select(*keys).distinct()
    replies = map_batch(distinct, keys, generate, "reply", "string")
    parsed = replies.withColumn("r", F.from_json(F.regexp_replace("reply", r"```(json)?", ""), "description string, tags array<string>"))
    return items.join(parsed.select(*keys, "r.description", "r.tags"), list(keys), "left")


def query_generate(items: DataFrame, key: str, inputs: Sequence[str], generate: Batch) -> DataFrame:
    """(key, query): distinct generated query variants per item; ``generate`` returns a list per item."""
    replies = map_batch(items.select(key, *[c for c in inputs if c != key]), inputs, generate, "queries", "array<string>")
    return replies.select(key, F.explode(F.array_distinct("queries")).alias("query"))


def intent_triplets(queries: DataFrame, items: DataFrame, lexical: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(query_id, positive, negative) by intent.

    ``queries`` has query_id, text, intent, vec; ``items`` has doc_id, text, intent, vec. ``lexical``
    ranks items per query by shared words. The positive is the best ranked item of the same intent,
    the negative the ranked item of another intent with the lowest cosine.
    """
    ranked = lexical(queries.select("query_id", "text"), items.select("doc_id", "text")).select("query_id", "doc_id", "rank")
    q = queries.select("query_id", F.col("intent").alias("q_intent"), F.col("vec").alias("q_vec"))
    d = items.select("doc_id", "intent", "vec")
    joined = ranked.join(q, "query_id").join(d, "doc_id").withColumn("score", F.round(dot(F.col("q_vec"), F.col("vec")), 9))
    same = F.col("intent") == F.col("q_intent")
    picked = joined.groupBy("query_id").agg(
        F.min(F.when(same, F.struct("rank", "doc_id")))["doc_id"].alias("positive"),
        F.min(F.when(~same, F.struct("score", "rank", "doc_id")))["doc_id"].alias("negative"),
    )
    return picked.where(F.col("positive").isNotNull() & F.col("negative").isNotNull())


def chunk_documents(docs: DataFrame, text: str = "text", size: int = 200, overlap: int = 20) -> DataFrame:
    """Word chunks (doc_id, chunk_id, chunk_no, chunk_content, chunk_context) covering the whole text.

    The context is the chunk before. Every window start is kept as long as it adds new words.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))

    # outer explode and an emptied first chunk instead of a filter on the words: the text is split once
    def with_context(chunks: Column) -> Column:
        return F.transform(chunks, lambda c, i: F.struct(c.alias("content"), F.coalesce(F.get(chunks, i - 1), F.lit("")).alias("context")))

    staged = docs.select("doc_id", let(let(words, cut), with_context).alias("chunks"))
    flat = staged.select("doc_id", F.posexplode_outer("chunks").alias("chunk_no", "c")).select("doc_id", "chunk_no", F.col("c.content").alias("chunk_content"), F.col("c.context").alias("chunk_context"))
    return flat.where(F.col("chunk_content") != "").select(
        "doc_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "chunk_no", "chunk_content", "chunk_context")
