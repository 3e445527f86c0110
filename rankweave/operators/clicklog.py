"""Search-session logs to labelled, debiased training examples.

Sessions arrive nested (lists of item maps) or already flat. All labelling works on the flat
*items* form: one row per clicked, shown or candidate item, with its session columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave import skew
from rankweave.functions.sampling import md5_key
from rankweave.functions.scalar import clip, first_present, to_iso
from rankweave.functions.text import explode_tokens
from rankweave.session import cut_lineage

# Key names under which a session log may carry each field.
LINK_KEYS = ["nav_link", "url", "link"]
POSITION_KEYS = ["position", "rank"]
CLICK_TIME_KEYS = ["click_time", "click_timestamp", "timestamp"]
DWELL_KEYS = ["dwell_time", "dwell_seconds", "dwell", "time_on_page"]
SHOWN_TIME_KEYS = ["shown_time", "impression_time", "timestamp", "time"]
ROLE_COLUMNS = {
    "clicked": ["clicked_links", "clicks"],
    "shown": ["shown_but_not_clicked", "impressions"],
    "candidate": ["candidates", "all_nav_links"],
}

SESSION_KEYS = ["session_id", "id"]
SESSION_TIME_KEYS = ["timestamp", "session_time", "start_time"]

#: ``record`` tells log records without a session id apart; it is null where there is an id
SESSION_COLUMNS = ["session_id", "user_id", "query", "session_time", "record"]


@dataclass(frozen=True)
class LabelConfig:
    propensity_model: str = "power_law"
    gamma: float = 0.5
    min_propensity: float = 0.05
    position_map: Mapping[int, float] | None = None
    epsilon: float = 1e-6
    n_factor: bool = True
    sample_negatives: bool = True
    negatives_per_positive: float = 3
    hard_fraction: float = 0.7
    hard_low: int = 101
    hard_high: int = 1000
    seed: int = 7
    target_policy: Callable[[], Column] | None = None


def _session(df: DataFrame) -> Column:
    """A key that is never null: the session id, else the record, else one key for all rows without either."""
    record = F.col("record") if "record" in df.columns else F.lit(None).cast("string")
    return F.coalesce(F.concat(F.lit("s"), F.col("session_id").cast("string")), F.concat(F.lit("r"), record), F.lit("n"))


def _with_record(items: DataFrame) -> DataFrame:
    return items if "record" in items.columns else items.withColumn("record", F.lit(None).cast("string"))


def _rank(raw: Column) -> Column:
    """A rank as int: null if missing, the first place if it is no finite number, the nearest int if it is too large."""
    number = raw.try_cast("double")
    odd = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    bounded = F.least(F.lit(2147483647.0), F.greatest(F.lit(-2147483648.0), number))
    return F.when(raw.isNull(), F.lit(None).cast("int")).when(odd, F.lit(1)).otherwise(bounded.cast("int"))


def unnest_sessions(sessions: DataFrame, roles: Sequence[str] = tuple(ROLE_COLUMNS)) -> DataFrame:
    """Nested sessions to flat items of the given roles; a missing or null list gives no item.

    ``place`` is the order of the items in the record's lists. A record without a session id is a session of its own.
    """
    present = set(sessions.columns)

    def first_column(names: Sequence[str]) -> Column:
        found = [F.col(n).cast("string") for n in names if n in present]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def tag(role: str, lists: list[Column]) -> Column:
        maps = F.coalesce(*lists, F.array().cast("array<map<string,string>>"))
        return F.transform(maps, lambda m: F.struct(F.lit(role).alias("role"), m.alias("m")))

    tagged = [
        tag(role, [F.col(name) for name in names if name in present])
        for role, names in ROLE_COLUMNS.items()
        if role in roles and present.intersection(names)
    ]
    session = first_column(SESSION_KEYS)
    whole = F.md5(F.to_json(F.struct(*[F.col(c) for c in sessions.columns])).cast("binary"))
    flat = sessions.select(
        session.alias("session_id"),
        first_column(["user_id"]).alias("user_id"),
        first_column(["query"]).alias("query"),
        to_iso(first_column(SESSION_TIME_KEYS)).alias("session_time"),
        F.when(session.isNull(), whole).alias("record"),
        F.posexplode_outer(F.concat(*tagged)).alias("place", "item"),  # outer: see explode_tokens
    ).where(F.col("item").isNotNull())
    m, role = F.col("item.m"), F.col("item.role")
    named = flat.select(
        *SESSION_COLUMNS,
        "place",
        role.alias("role"),
        first_present(m, LINK_KEYS).alias("link"),
        _rank(first_present(m, POSITION_KEYS)).alias("position"),
        F.when(role == "clicked", first_present(m, CLICK_TIME_KEYS)).otherwise(first_present(m, SHOWN_TIME_KEYS)).alias("event_time"),
        F.when(role == "clicked", first_present(m, DWELL_KEYS)).try_cast("double").alias("dwell"),
        F.when(role == "shown", first_present(m, ["skip_type"], F.lit("impression"))).alias("skip_type"),
    )
    return named.withColumn("event_time", to_iso(F.col("event_time")))


def propensity(position: Column, config: LabelConfig = LabelConfig()) -> Column:
    """Chance that a position is examined, clipped to [min_propensity, 1]."""
    if config.position_map is not None:
        table = F.create_map(*[F.lit(x) for pair in sorted(config.position_map.items()) for x in (int(pair[0]), float(pair[1]))])
        raw = F.coalesce(F.try_element_at(table, position.cast("int")), F.lit(config.min_propensity))
    else:
        place = F.greatest(F.lit(1), position.cast("int")).cast("double")
        if config.propensity_model == "inverse_log":
            raw = 1.0 / F.log2(place + 1.0)
        elif config.propensity_model == "power_law":
            raw = 1.0 / F.pow(place + 1.0, F.lit(float(config.gamma)))
        else:
            raise ValueError(f"unknown propensity model {config.propensity_model!r}")
    unknown = F.lit(float(max(0.2, config.min_propensity)))
    return F.when(position.isNull(), unknown).otherwise(clip(raw, config.min_propensity, 1.0))


def ips_weight(prop: Column, config: LabelConfig = LabelConfig()) -> Column:
    target = F.lit(1.0) if config.target_policy is None else F.coalesce(config.target_policy().cast("double"), F.lit(1.0))
    return target / F.greatest(prop, F.lit(config.epsilon))


def with_weights(examples: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    return examples.withColumn("propensity", propensity(F.col("position"), config)).withColumn(
        "ips_weight", ips_weight(F.col("propensity"), config)
    )


def snips(examples: DataFrame, by: str = "session_id") -> DataFrame:
    """Self-normalized weights within ``by``: ``snips_weight`` (w * N / sum) and ``weight_share`` (w / sum).

    Both are 1.0 where the group has no usable weight. Rows without a session are grouped by record (see ``_session``).
    """
    keyed = examples.withColumn("__g", _session(examples) if by == "session_id" else F.coalesce(F.concat(F.lit("s"), F.col(by).cast("string")), F.lit("n")))
    sums = keyed.groupBy("__g").agg(F.sum("ips_weight").alias("__s"), F.count("ips_weight").alias("__n"))
    usable = (F.col("__s") > 0) & F.col("ips_weight").isNotNull()
    share = F.col("ips_weight") / F.col("__s")
    return skew.attach(keyed, sums, ["__g"]).withColumns({
        "snips_weight": F.when(usable, share * F.col("__n")).otherwise(F.lit(1.0)),
        "weight_share": F.when(usable, share).otherwise(F.lit(1.0)),
    }).drop("__g", "__s", "__n")


def label_positives(items: DataFrame) -> DataFrame:
    return _with_record(items).where(F.col("role") == "clicked").select(
        F.lit("positive").alias("type"),
        F.lit(1).alias("label"),
        *SESSION_COLUMNS,
        F.col("link").alias("nav_link"),
        "position",
        F.col("event_time").alias("click_time"),
        F.col("dwell").alias("dwell_time"),
    )


def _clicked_links(items: DataFrame) -> DataFrame:
    """(__s, __l): session key and link."""
    return items.where((F.col("role") == "clicked") & F.col("link").isNotNull()).select(_session(items).alias("__s"), F.col("link").alias("__l")).distinct()


def label_negatives(items: DataFrame) -> DataFrame:
    """Shown items whose link was not clicked in the same session."""
    items = _with_record(items)
    shown = items.where((F.col("role") == "shown") & F.col("link").isNotNull()).select(
        _session(items).alias("__s"),
        F.lit("negative").alias("type"),
        F.lit(0).alias("label"),
        *SESSION_COLUMNS,
        F.col("link").alias("nav_link"),
        "position",
        F.col("event_time").alias("shown_time"),
        F.col("skip_type"),
    )
    clicked = _clicked_links(items).withColumnRenamed("__l", "nav_link")
    return shown.join(clicked, ["__s", "nav_link"], "left_anti").select([c for c in shown.columns if c != "__s"])


def label_logged(items: DataFrame) -> DataFrame:
    """``label_positives`` and ``label_negatives`` together, in one pass over the log: the logged items are stored."""
    items = _with_record(items)
    logged = items = cut_lineage(items.where((F.col("role") == "clicked") | ((F.col("role") == "shown") & F.col("link").isNotNull())))
    was_clicked = _clicked_links(items).withColumn("__clicked", F.lit(True))
    is_click = F.col("role") == "clicked"
    keyed = logged.withColumns({"__s": _session(logged), "__l": F.col("link")})
    joined = keyed.join(was_clicked, ["__s", "__l"], "left")
    return joined.where(is_click | F.col("__clicked").isNull()).select(
        F.when(is_click, "positive").otherwise("negative").alias("type"),
        is_click.cast("int").alias("label"),
        *SESSION_COLUMNS,
        F.col("link").alias("nav_link"),
        "position",
        F.when(is_click, F.col("event_time")).alias("click_time"),
        F.col("dwell").alias("dwell_time"),
        F.when(~is_click, F.col("event_time")).alias("shown_time"),
        "skip_type",
    )


def best_candidates(items: DataFrame) -> DataFrame:
    """One row per session and candidate link with its lowest known position."""
    pool = _with_record(items).where((F.col("role") == "candidate") & F.col("link").isNotNull())
    return pool.groupBy(*SESSION_COLUMNS, F.col("link").alias("nav_link")).agg(F.min("position").alias("position"))


#: sessions of more candidate links are numbered in pieces
WINDOW_ROWS = 100_000


def _drawn_by_window(pool: DataFrame, seed: int) -> DataFrame:
    """Both draws of sessions that fit into a task: one shuffle by session, sorted twice."""
    hard = Window.partitionBy("__s", "is_hard").orderBy(md5_key(f"{seed}h", "session_id", "nav_link"))
    rest = Window.partitionBy("__s", "is_taken").orderBy(md5_key(f"{seed}r", "session_id", "nav_link"))
    marked = pool.repartition("__s").withColumn("is_taken", F.col("is_hard") & (F.row_number().over(hard) <= F.col("hard_k")))
    return marked.withColumn("draw", F.row_number().over(rest))


def _drawn_in_pieces(pool: DataFrame, seed: int) -> DataFrame:
    """The same for sessions of any size: members are numbered with ``skew.shuffled_ordinal``."""
    first = skew.shuffled_ordinal(pool, ["__s", "is_hard"], md5_key(f"{seed}h", "session_id", "nav_link"), "draw")
    marked = cut_lineage(first.withColumn("is_taken", F.col("is_hard") & (F.col("draw") <= F.col("hard_k"))).drop("draw"))
    return skew.shuffled_ordinal(marked, ["__s", "is_taken"], md5_key(f"{seed}r", "session_id", "nav_link"), "draw")


def sample_negatives(items: DataFrame, config: LabelConfig = LabelConfig(), window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Seeded mix of hard and random candidates per session, in md5 order.

    Draw sizes differ per session. Sessions of at most ``window_rows`` candidates are numbered by windows, larger ones in
    pieces, with the same result.
    """
    links = (
        _with_record(items).where(F.col("link").isNotNull())
        # session columns are constant in a session: as keys they keep this a hash aggregate
        .groupBy(*SESSION_COLUMNS, F.col("link").alias("nav_link"))
        .agg(
            F.bool_or(F.col("role") == "clicked").alias("clicked"),
            F.bool_or(F.col("role") == "shown").alias("shown"),
            F.bool_or(F.col("role") == "candidate").alias("candidate"),
            F.min(F.when(F.col("role") == "candidate", F.col("position"))).alias("position"),
        )
    )
    hard = F.coalesce(F.col("position").between(config.hard_low, config.hard_high), F.lit(False))
    pool_row = F.col("candidate") & ~F.col("clicked") & ~F.col("shown")
    # read by the quotas and by the draws
    links = cut_lineage(links.select("*", _session(links).alias("__s"), pool_row.alias("pooled"), hard.alias("is_hard")).drop("shown", "candidate"))
    quota = (
        links.groupBy("__s")
        .agg(F.count_if(F.col("pooled") & F.col("is_hard")).alias("n_hard"), F.count_if("clicked").alias("n_pos"), F.count_if("pooled").alias("__n"))
        .withColumn("k", F.bround(F.lit(float(config.negatives_per_positive)) * F.greatest(F.lit(1), F.col("n_pos"))).cast("long"))
        .withColumn("hard_k", F.least(F.col("n_hard"), F.bround(F.lit(float(config.hard_fraction)) * F.col("k")).cast("long")))
        .withColumn("rand_k", F.greatest(F.lit(0), F.col("k") - F.col("hard_k")))
        .select("__s", "hard_k", "rand_k", "__n")
    )
    quota = cut_lineage(quota)
    pool = skew.attach(links.where("pooled").drop("clicked", "pooled"), quota, ["__s"])
    small = F.col("__n") <= window_rows
    drawn = _drawn_by_window(pool.where(small).drop("__n"), config.seed)
    if (quota.agg(F.max("__n")).first()[0] or 0) > window_rows:
        drawn = drawn.unionByName(_drawn_in_pieces(cut_lineage(pool.where(~small).drop("__n")), config.seed))
    return drawn.where(F.col("is_taken") | (F.col("draw") <= F.col("rand_k"))).select(
        F.lit("negative").alias("type"),
        F.lit(0).alias("label"),
        *SESSION_COLUMNS,
        "nav_link",
        "position",
        F.col("session_time").alias("shown_time"),
        F.when(F.col("is_taken"), "sampled_hard").otherwise("sampled_random").alias("skip_type"),
    )


def build_dataset(items: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """Positives, logged and sampled negatives with propensity, IPS and SNIPS weights."""
    examples = label_logged(items)
    if config.sample_negatives:
        # stored, because the per-session sums and the examples both read the draw
        examples = examples.unionByName(cut_lineage(sample_negatives(items, config)), allowMissingColumns=True)
    weighted = snips(with_weights(examples, config), "session_id")
    if not config.n_factor:
        weighted = weighted.withColumn("snips_weight", F.col("weight_share"))
    return weighted.drop("weight_share")


def engagement_labels(examples: DataFrame) -> DataFrame:
    dwell = F.coalesce(F.col("dwell_time"), F.lit(0.0))
    return examples.withColumns(
        {
            "user_id": F.coalesce("user_id", F.lit("unknown")),
            "clicked": F.col("label").cast("double"),
            "dwell_time": dwell,
            "completed": F.when((F.col("label") > 0.5) & (dwell >= 60.0), 1.0).otherwise(0.0),
            "crosssell": F.lit(0.0),
            "propensity": F.coalesce(F.nullif(F.col("propensity"), F.lit(0.0)), F.lit(0.5)),
            "position": F.coalesce(F.nullif(F.col("position").cast("double"), F.lit(0.0)), F.lit(1.0)),
        }
    )


def ranker_features(examples: DataFrame) -> DataFrame:
    return examples.withColumns(
        {
            "pos_norm": (F.col("position") - 1.0) / 9.0,
            "prop": F.col("propensity"),
            "dwell_norm": clip(F.col("dwell_time") / 180.0, 0.0, 1.0),
        }
    )


def bpr_pairs(items: DataFrame) -> DataFrame:
    """First click against first impression for sessions that have both.

    "First" follows the order of the record's lists; items without a place go by the lowest (position, link).
    """
    items = _with_record(items)
    place = F.col("place") if "place" in items.columns else F.lit(0)

    def first(role: str) -> Column:
        return F.min(F.when(F.col("role") == role, F.struct(place.alias("place"), "position", "link")))["link"]

    return (
        items.where(F.col("role").isin("clicked", "shown"))
        .groupBy("session_id", "user_id", "query", "record")
        .agg(first("clicked").alias("pos_link"), first("shown").alias("neg_link"), F.count_if(F.col("role") == "clicked").alias("nc"), F.count_if(F.col("role") == "shown").alias("ns"))
        .where((F.col("nc") > 0) & (F.col("ns") > 0))
        .drop("nc", "ns", "record")
    )


def bce(pred: Column, target: Column) -> Column:
    """Binary cross-entropy with the usual floor of -100 on each log."""
    def safe_log(x: Column) -> Column:
        return F.when(x <= 0, F.lit(-100.0)).otherwise(F.greatest(F.ln(x), F.lit(-100.0)))

    return -(target * safe_log(pred) + (1.0 - target) * safe_log(1.0 - pred))


def weighted_losses(scored: DataFrame, weights: tuple[float, float, float] = (1.0, 0.5, 0.3)) -> DataFrame:
    """SNIPS click loss, completion loss on clicked rows, IPS cross-sell loss and their mix.

    Needs clicked, completed, crosssell, propensity and p_click, p_completion, p_crosssell.
    """
    w = 1.0 / F.greatest(F.col("propensity"), F.lit(1e-3))
    parts = scored.agg(
        (F.sum(w * bce(F.col("p_click"), F.col("clicked"))) / F.greatest(F.sum(w), F.lit(1e-6))).alias("ctr_loss"),
        F.coalesce(F.avg(F.when(F.col("clicked") >= 0.5, bce(F.col("p_completion"), F.col("completed")))), F.lit(0.0)).alias("completion_loss"),
        F.avg(w * bce(F.col("p_crosssell"), F.col("crosssell"))).alias("crosssell_loss"),
    )
    a, b, c = weights
    return parts.withColumn("total_loss", a * F.col("ctr_loss") + b * F.col("completion_loss") + c * F.col("crosssell_loss"))


def dataset_summary(examples: DataFrame, query_tokens: Column, item_tokens: Column) -> DataFrame:
    """Example, user and vocabulary sizes; both vocabularies count PAD and UNK."""
    def tag(side: str, value: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), value.alias("value"))

    values = F.concat(
        F.array(tag("user", F.col("user_id"))),
        F.transform(query_tokens, lambda t: tag("query", t)),
        F.transform(item_tokens, lambda t: tag("item", t)),
    )
    side = F.col("side")
    return (
        explode_tokens(examples, [], values, "v")
        .groupBy("v.side", "v.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum(F.when(side == "user", F.col("n"))).alias("examples"),
            F.count_if((side == "user") & F.col("value").isNotNull()).alias("users"),
            (F.count_if(side == "query") + 2).alias("query_vocab"),
            (F.count_if(side == "item") + 2).alias("item_vocab"),
        )
    )
