"""Sparse retrieval: BM25, fielded BM25, word overlap and given term weights.

All of them are one plan: a document is one row of distinct terms and counts, the (smaller) query terms are shipped to the
documents, and each task returns k documents per query (see ``postings``). Document frequencies and mean lengths are
aggregates of the same stored rows, so a text is tokenised once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.text import explode_tokens, tokenize_space, tokenize_words
from rankweave.operators import postings as ps
from rankweave.session import cut_lineage

# The default English stop words of the lexical index.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def content_tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    words = tokenize_words(text)
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def frequencies(lists: DataFrame) -> DataFrame:
    """(term, df) of stored term lists."""
    return explode_tokens(lists, [], F.col("terms")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_size(lists: DataFrame, fields: int = 1) -> tuple[int, list[float]]:
    """Number of documents and the mean length of every field."""
    n, *means = lists.agg(F.count(F.lit(1)), *[F.avg(F.col("lengths")[i]) for i in range(fields)]).first()
    return n, [m or 1.0 for m in means]


def idf(n: int) -> Column:
    df = F.col("df").cast("double")
    return F.log1p((F.lit(float(n)) - df + 0.5) / (df + 0.5))


@dataclass(frozen=True)
class Bm25Index:
    """``lists``: one row a document (see ``postings.term_lists``); ``terms``: (term, df, idf)."""

    lists: DataFrame
    terms: DataFrame
    mean_length: float
    k1: float
    b: float

    @property
    def weigh(self) -> ps.Weigh:
        return ps.bm25_weigh([self.mean_length], self.k1, self.b)

    @property
    def postings(self) -> DataFrame:
        """(doc_id, term, saturation: the weight without idf), one row a posting."""
        flat = self.lists.select("doc_id", F.col("lengths")[0].alias("length"), F.explode(F.arrays_zip("terms", "counts")).alias("p"))
        tf = F.col("p.counts").cast("double")
        share = tf / (tf + F.lit(self.k1) * (F.lit(1.0 - self.b) + F.lit(self.b) * F.col("length") / F.lit(self.mean_length)))
        return flat.select("doc_id", F.col("p.terms").alias("term"), share.alias("saturation"))

    def weighted(self) -> DataFrame:
        return self.postings.join(self.terms, "term").select("doc_id", "term", (F.col("idf") * F.col("saturation")).alias("weight"))


def bm25_index(docs: DataFrame, text: str, k1: float = 1.2, b: float = 0.75, stop_words: Sequence[str] = STOP_WORDS) -> Bm25Index:
    """Index ``docs`` (doc_id, text) in one pass over the texts; document ids must be unique."""
    return bm25_of(cut_lineage(ps.term_lists(docs, {"": tokenize_words(F.col(text))}, stop_words)), k1, b)


def bm25_of(lists: DataFrame, k1: float = 1.2, b: float = 0.75) -> Bm25Index:
    """The index over stored term lists of one field."""
    n, (mean_length,) = corpus_size(lists)
    return Bm25Index(lists, frequencies(lists).select("term", "df", idf(n).alias("idf")), mean_length, k1, b)


def query_terms(queries: DataFrame, text: str, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(query_id, term), each distinct term once."""
    return explode_tokens(queries, ["query_id"], F.array_distinct(content_tokens(F.col(text), stop_words)))


def top_k(scored: DataFrame, k: int, score: str = "score", query: str = "query_id", item: str = "doc_id", first: Sequence[Column] = ()) -> DataFrame:
    """Best ``k`` per query with ``rank`` from 1; equal scores (to 9 places) go by id."""
    order = Window.partitionBy(query).orderBy(*first, F.round(score, 9).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sparse_topk(terms: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """Best ``k`` by the dot product over shared terms of (query_id, term, q_weight) and (doc_id, term, d_weight)."""
    terms = cut_lineage(terms)
    asked = postings.join(terms.select("term").distinct(), "term", "left_semi")
    return top_k(ps.best_documents(ps.given_weights(asked), terms, k), k)


def bm25_search(index: Bm25Index, queries: DataFrame, text: str, k: int, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """idf travels with the few query terms, so postings are never joined with the whole vocabulary."""
    terms = query_terms(queries, text, stop_words).join(index.terms, "term").select("query_id", "term", F.col("idf").alias("q_weight"))
    return top_k(ps.best_documents(index.lists, terms, k, index.weigh), k)


def per_distinct_text(queries: DataFrame, text: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``search`` once per distinct query text and give every copy of a query its result."""
    groups = queries.where(F.col(text).isNotNull()).groupBy(text).agg(F.min("query_id").alias("__rep"))
    reps = cut_lineage(groups.select(F.col("__rep").alias("query_id"), text))
    found = search(reps).withColumnRenamed("query_id", "__rep")
    copies = queries.select("query_id", text).join(reps.withColumnRenamed("query_id", "__rep"), text).select("query_id", "__rep")
    return copies.join(found, "__rep").drop("__rep")


def bm25_search_docs(docs: DataFrame, queries: DataFrame, text: str, k: int, k1: float = 1.2, b: float = 0.75, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Search without a stored index, for a batch of queries; equal query texts are searched once.

    One pass over the texts counts the words that some query asks for (all words, if those asked for are too many to be shipped)
    and measures the documents. Document frequencies, mean length and scores come from these rows.
    """
    def search(asked: DataFrame) -> DataFrame:
        terms = cut_lineage(query_terms(asked, text, stop_words))
        lists = cut_lineage(ps.term_lists(docs, {"": tokenize_words(F.col(text))}, stop_words, ps.distinct_terms(terms)))
        return bm25_search_terms(bm25_of(lists, k1, b), terms, k)

    return per_distinct_text(queries, text, search)


def bm25_search_terms(index: Bm25Index, terms: DataFrame, k: int) -> DataFrame:
    weighted = terms.join(index.terms, "term").select("query_id", "term", F.col("idf").alias("q_weight"))
    return top_k(ps.best_documents(index.lists, weighted, k, index.weigh), k)


def fielded_bm25(docs: DataFrame, boosts: Mapping[str, float], queries: DataFrame, text: str, exact_field: str, k: int, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Boosted sum of one BM25 score per field; documents whose ``exact_field`` equals the query come first.

    The name of a document is one more field of a single term. Exact matches are searched on their own, as documents that
    hold the query's name, so they surface however little they score.
    """
    name = lambda c: F.lower(F.trim(c))
    marks = {f"{field}:": tokenize_words(F.col(field)) for field in boosts}
    lists = cut_lineage(ps.term_lists(docs, {**marks, "=": F.array_compact(F.array(name(exact_field)))}, stop_words, whole=["="]))
    n, means = corpus_size(lists, len(marks) + 1)
    known = frequencies(lists.select(F.filter("terms", lambda t: ~F.startswith(t, F.lit("="))).alias("terms"))).select("term", idf(n).alias("idf"))
    words = query_terms(queries, text, stop_words)
    terms = None
    for field, boost in boosts.items():
        own = words.select("query_id", F.concat(F.lit(f"{field}:"), F.col("term")).alias("term")).join(known, "term").select(
            "query_id", "term", (F.col("idf") * F.lit(float(boost))).alias("q_weight"))
        terms = own if terms is None else terms.unionByName(own)
    weigh = ps.bm25_weigh(means, 1.2, 0.75)
    scored = ps.best_documents(lists, terms, k, weigh)
    asked = queries.where(F.col(text).isNotNull()).select("query_id", F.concat(F.lit("="), name(text)).alias("term"), F.lit(0.0).alias("q_weight"), F.lit(True).alias("required"))
    exact = ps.best_documents(lists, terms.withColumn("required", F.lit(False)).unionByName(asked), k, weigh)
    both = scored.withColumn("is_exact", F.lit(0)).unionByName(exact.withColumn("is_exact", F.lit(1)))
    merged = both.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.max("is_exact").alias("is_exact"))
    return top_k(merged, k, first=[F.col("is_exact").desc()])


def overlap_topk(queries: DataFrame, docs: DataFrame, text: str, k: int) -> DataFrame:
    """Number of shared distinct whitespace words."""
    words = tokenize_space(F.col(text))

    def search(asked: DataFrame) -> DataFrame:
        q = cut_lineage(explode_tokens(asked, ["query_id"], F.array_distinct(words)).withColumn("q_weight", F.lit(1.0)))
        lists = ps.term_lists(docs, {"": words}, only=ps.distinct_terms(q))
        found = ps.best_documents(lists, q, k, lambda counts, lengths, sizes: (counts > 0).astype(float))
        return top_k(found.withColumn("score", F.col("score").cast("long")), k)

    return per_distinct_text(queries, text, search)
