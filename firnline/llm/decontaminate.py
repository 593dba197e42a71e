"""Benchmark decontamination by a positional inverted index, with DataFrame operations alone.

Training texts become postings (text, term, position) of the terms that test items use, written to the shared folder.
Each window of test words is looked up from its rarest term: the postings of that term give places in texts, shifted
by the term's place in the item, which are then intersected with the shifted postings of the rarest term at another
place of the window, and the words around what is left are compared. Places are (text, item, shift), so
all windows of an item that lie on one shift share one comparison.

Texts are keyed by two 64-bit hashes of their content: copies share their result, whatever their ids. Null and empty
texts have no words and no hits; an empty benchmark leaves every count 0; repeated items and items with null texts
are harmless; a null item_id takes part and is listed as an empty string. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import storage

#: All characters that end a word; texts are lower-cased first.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cases A-Z and cuts a text into words; an empty array for null."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.array_remove(F.split(low, SEPARATORS), ""), F.array().cast("array<string>"))


def _key(docs: DataFrame) -> DataFrame:
    """doc_id, words and the key of the text."""
    return docs.select("doc_id", F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2"), words_of(F.col("text")).alias("words"))


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """item (a hash of its id and words), item_id, w (its words), span (its windows' length)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    return items.distinct().select(F.xxhash64("item_id", F.to_json("w")).alias("item"), "item_id", "w", F.least(F.lit(window), F.size("w")).alias("span"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (k1, k2, term, p) for every place p (from 0) of every term of terms(term, word) in every text."""
    rows = _key(docs).select("k1", "k2", F.posexplode("words").alias("p", "word"))
    return rows.join(terms, "word").select("k1", "k2", "term", "p")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """Exact phrase matches: (keyed docs, places), places with one row for each maximal stretch of hit words:
    k1, k2, item_id, low, high (words low to high - 1 are hit by that item)."""
    items = storage.keep(_items(benchmark, window), "items")
    words = items.select(F.explode("w").alias("word")).distinct()
    terms = storage.keep(words.select("word", F.xxhash64("word").alias("term")), "terms")
    n_terms, length = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    fit = lambda df: storage.broadcast_if_small(df, n_terms, 64 + 4 * length // max(1, n_terms))
    index = storage.keep(postings(docs, fit(terms)), "postings")
    often = index.groupBy("term").agg(F.count("*").alias("often"))
    counted = fit(terms.join(often, "term").select("word", "term", "often"))

    # the terms of every window, rarest first; a window with a term that no text has is nowhere
    at = items.select("item", "span", F.size("w").alias("n"), F.posexplode("w").alias("a", "word")).join(counted, "word", "left")
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("a") - F.col("span") + 1), F.least(F.col("a"), F.col("n") - F.col("span")))).alias("start")
    by = W.partitionBy("item", "start")
    ranked = at.select("item", "span", "a", "term", "often", starts).withColumn("known", F.count("term").over(by)).where(F.col("known") == F.col("span"))
    ranked = ranked.withColumn("rank", F.row_number().over(by.orderBy("often", "term", "a"))).where("rank <= 2")
    anchors = ranked.groupBy("item", "start").agg(F.min_by(F.struct("term", "a"), "rank").alias("one"), F.max_by(F.struct("term", "a"), "rank").alias("two"))
    anchors = storage.keep(anchors.select("item", F.col("one.term").alias("t1"), F.col("one.a").alias("a1"), F.col("two.term").alias("t2"), F.col("two.a").alias("a2")).distinct(), "anchors")

    rare = index.join(fit(anchors.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()), "term")
    first = rare.join(anchors.withColumnRenamed("t1", "term"), "term").select("k1", "k2", "item", (F.col("p") - F.col("a1")).alias("shift"), "t2", "a2")
    second = rare.select("k1", "k2", F.col("term").alias("t2"), F.col("p").alias("p2"))
    met = first.join(second, (first.k1 == second.k1) & (first.k2 == second.k2) & (first.t2 == second.t2) & (second.p2 == first["shift"] + first.a2)).select(first.k1, first.k2, "item", "shift")
    places = storage.keep(met.distinct(), "places")

    # the words of the texts that some place names, once for each text
    named = places.select("k1", "k2").distinct()
    keyed = _key(docs)
    there = keyed.join(named, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("words").alias("words"))
    both = places.join(there, ["k1", "k2"]).join(items, "item")
    low, skip = F.greatest(F.col("shift"), F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    n = F.least(F.size("words") - low, F.size("w") - skip)
    same = F.zip_with(F.slice("words", low + 1, n), F.slice("w", skip + 1, n), lambda x, y: x == y)
    # stretches of equal words as long as a window: ends of stretches, found from the places that differ
    breaks = F.filter(F.transform(same, lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(-1)), breaks, F.array(F.size(same)))
    both = both.select("k1", "k2", "item_id", "span", low.alias("from"), edges.alias("e")).select("k1", "k2", "item_id", "span", "from", F.explode(F.arrays_zip(F.slice("e", 1, F.size("e") - 1).alias("x"), F.slice("e", 2, F.size("e")).alias("y"))).alias("z"))
    hits = both.where(F.col("z.y") - F.col("z.x") - 1 >= F.col("span"))
    return keyed, storage.keep(hits.select("k1", "k2", "item_id", (F.col("from") + F.col("z.x") + 1).alias("low"), (F.col("from") + F.col("z.y")).alias("high")).distinct(), "hits")


def proximity(docs: DataFrame, benchmark: DataFrame, apart: int = 50, window: int = 10) -> DataFrame:
    """doc_id, item_id: documents in which two exact matches of one item, over different words, lie within `apart` words."""
    keyed, hits = find_leaks(docs, benchmark, window)
    other = hits.select("k1", "k2", "item_id", F.col("low").alias("low2"))
    near = hits.join(other, ["k1", "k2", "item_id"]).where((F.col("low2") >= F.col("high")) & (F.col("low2") - F.col("high") <= apart))
    return keyed.select("doc_id", "k1", "k2").join(near.select("k1", "k2", "item_id").distinct(), ["k1", "k2"]).select("doc_id", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each document."""
    keyed, hits = find_leaks(docs, benchmark, window)
    # union of each text's stretches: what each adds beyond the furthest end before it
    by = W.partitionBy("k1", "k2").orderBy("low", "high").rowsBetween(W.unboundedPreceding, -1)
    spans = hits.select("k1", "k2", "low", "high").distinct().withColumn("past", F.coalesce(F.max("high").over(by), F.lit(0)))
    n_hit = spans.groupBy("k1", "k2").agg(F.sum(F.greatest(F.lit(0), F.col("high") - F.greatest("low", "past"))).alias("n_hit"))
    listed = hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = n_hit.join(listed, ["k1", "k2"]).select("k1", "k2", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    n, none = found.count(), F.sha2(F.lit(""), 256)
    out = keyed.select("doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words")).join(storage.broadcast_if_small(found, n, 160), ["k1", "k2"], "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs whose texts hold no window of the benchmark; columns and rows stay as they are otherwise."""
    _, hits = find_leaks(docs, benchmark, window)
    bad = storage.keep(hits.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct(), "leaks")
    bad = storage.broadcast_if_small(bad, bad.count(), 48)
    names = [f"`{c}`" for c in docs.columns]
    return docs.select(*names, F.xxhash64(F.lit(1), "text").alias("_k1"), F.xxhash64(F.lit(2), "text").alias("_k2")).join(bad, ["_k1", "_k2"], "left_anti").select(*names)
