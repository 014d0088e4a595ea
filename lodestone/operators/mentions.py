"""Documents that a query names, found through an index of their names instead of comparing every pair.

A query is resolved by scores of at least FLOOR only: one document is clear at SINGLE with MARGIN before the next,
several at SEVERAL, and all that lies below SINGLE - MARGIN changes neither. A pair can reach FLOOR in four ways, and each
has an equality join of its own:

* query and name are equal;
* the query holds the name, or a part of it that no other document has: the phrase is indexed under its rarest gram of
  GRAM characters (a shorter phrase under itself), and a query asks with its grams;
* the name holds the query: the same with the sides exchanged;
* they share words: by the weights that needs a word of at most two documents, or at least COMMON words; such a pair
  shares one of the rarest words of either side, all but the COMMON - 1 most frequent ones.

All is per area. Each distinct query text is resolved once. Names, queries and what each of the four ways finds are
written once: one plan over all of them held 250 MB of the driver's heap, however few rows there were.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import once

# Scores of a match and what a resolution needs (fixed values).
EXACT, HOLDS_NAME, HOLDS_PART, NAME_HOLDS, SHARED, SHARE, GENERIC = 1.0, 0.96, 0.94, 0.86, 0.42, 0.18, 0.55
#: Hundredths that a shared word of one, two and more documents adds, and most of them together (fixed values).
ONE, TWO, MORE, BONUS = 12, 6, 1, 30
CLEAR, AHEAD, SINGLE, MARGIN, SEVERAL, TOP = 0.9, 0.05, 0.8, 0.12, 0.8, 5
#: Scores below are of no consequence.
FLOOR = 0.68
#: Shared words of three or more documents that reach FLOOR: 42 + 18 + n >= 68.
COMMON = 8
GRAM, SHORT = 8, 3


def grams(c: Column) -> Column:
    """Distinct pieces of GRAM characters; of shorter texts none."""
    n = F.length(c) - GRAM + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(n > 0, F.substring(c, i, F.lit(GRAM)))))


def pieces(c: Column) -> Column:
    """Distinct pieces of SHORT to GRAM - 1 characters that may be a phrase: specific, no space at either end."""

    def of(size: int) -> Column:
        n = F.length(c) - size + 1
        return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(n > 0, F.substring(c, i, F.lit(size))))

    return F.array_distinct(F.filter(F.concat(*[of(size) for size in range(SHORT, GRAM)]), lambda x: (F.trim(x) == x) & text.specific_phrase(x)))


def generic_only(tokens: Column) -> Column:
    """No word of four characters or more."""
    return ~F.exists(tokens, lambda t: F.length(t) >= 4)


def canonical(documents: DataFrame) -> DataFrame:
    """documents (area_id, document_id, file_name) with name, parts (of the name between - _ /) and tokens."""
    stem = F.regexp_replace("file_name", r"(?<=.)\.[^./\\]+$", "")
    parts = F.array_distinct(F.filter(F.transform(F.split(stem, r"[-_/]+"), text.document_name), lambda x: x != ""))
    out = documents.select("area_id", "document_id", "file_name", text.document_name(F.col("file_name")).alias("name"), parts.alias("parts"))
    return out.withColumn("tokens", text.without_generic(text.query_tokens(F.col("name")))).where("area_id is not null and name <> ''")


def asked(queries: DataFrame) -> DataFrame:
    """The distinct (area_id, q) of queries (query_id, area_id, query_text) with the words of q."""
    q = queries.where("area_id is not null").select("area_id", text.fold(text.reference_query(F.col("query_text"))).alias("q")).where("q <> ''").distinct()
    return q.withColumn("tokens", text.without_generic(text.query_tokens(F.col("q"))))


def _rarest(rows: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """rows (keys, area_id, gram) down to the gram of each key that fewest texts of the area have; grams that none has come first."""
    held = rows.join(counts, ["area_id", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return held.groupBy(*keys).agg(F.min(F.struct("n", "gram")).alias("m")).select(*keys, F.col("m.n").alias("n"), F.col("m.gram").alias("gram"))


def phrases(names: DataFrame) -> DataFrame:
    """(area_id, document_id, phrase, score): specific names, and specific parts of names that one document alone has."""
    whole = names.where(text.specific_phrase(F.col("name"))).select("area_id", "document_id", F.col("name").alias("phrase"), F.lit(HOLDS_NAME).alias("score"))
    parts = names.select("area_id", "document_id", F.explode("parts").alias("phrase")).where(text.specific_phrase(F.col("phrase")))
    owned = parts.groupBy("area_id", "phrase").agg(F.min("document_id").alias("document_id"), F.max("document_id").alias("other")).where("document_id = other")
    return whole.unionByName(owned.select("area_id", "document_id", "phrase", F.lit(HOLDS_PART).alias("score")))


def holding(queries: DataFrame, held: DataFrame) -> DataFrame:
    """(area_id, q, document_id, score) of the phrases that a query holds."""
    short, long = held.where(F.length("phrase") < GRAM), held.where(F.length("phrase") >= GRAM)
    own = long.select("area_id", "document_id", "phrase", "score", F.explode(grams(F.col("phrase"))).alias("gram"))
    counts = own.groupBy("area_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    index = _rarest(own, ["area_id", "document_id", "phrase", "score"], counts).drop("n").unionByName(short.withColumn("gram", F.col("phrase")))
    asks = queries.select("area_id", "q", F.explode(F.array_union(grams(F.col("q")), pieces(F.col("q")))).alias("gram")).where("gram is not null")
    met = asks.join(index, ["area_id", "gram"]).where(F.contains("q", F.col("phrase")))
    return met.select("area_id", "q", "document_id", "score")


def held_by(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(area_id, q, document_id, score) of the names that hold a specific query."""
    specific = queries.where(text.specific_phrase(F.col("q"))).select("area_id", "q")
    rows = names.select("area_id", "document_id", "name", F.explode(F.array_union(grams(F.col("name")), pieces(F.col("name")))).alias("gram")).where("gram is not null")
    counts = rows.where(F.length("gram") == GRAM).groupBy("area_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    long = specific.where(F.length("q") >= GRAM)
    keys = _rarest(long.select("area_id", "q", F.explode(grams(F.col("q"))).alias("gram")), ["area_id", "q"], counts).where("n > 0").drop("n")
    keys = keys.unionByName(specific.where(F.length("q") < GRAM).withColumn("gram", F.col("q")))
    met = keys.join(rows, ["area_id", "gram"]).where(F.contains("name", F.col("q")))
    return met.select("area_id", "q", "document_id", F.lit(NAME_HOLDS).alias("score"))


def sharing(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(area_id, q, document_id, score) of pairs whose shared words may reach FLOOR."""
    words = names.select("area_id", "document_id", F.size("tokens").alias("n_words"), F.explode("tokens").alias("token"))
    frequency = words.groupBy("area_id", "token").agg(F.count(F.lit(1)).alias("df"))
    mine = words.join(frequency, ["area_id", "token"])
    theirs = queries.select("area_id", "q", F.size("tokens").alias("q_words"), F.explode("tokens").alias("token")).join(frequency, ["area_id", "token"])

    def leading(rows: DataFrame, key: str) -> DataFrame:
        """Words by which a pair must meet: those of at most two documents, and the rarest ones of a text of COMMON words or more."""
        w = Window.partitionBy("area_id", key).orderBy("df", "token")
        placed = rows.withColumn("at", F.row_number().over(w)).withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("area_id", key)))
        return placed.where((F.col("df") <= 2) | (F.col("at") <= F.col("known") - (COMMON - 1))).select("area_id", key, "token")

    pairs = leading(theirs, "q").join(leading(mine, "document_id"), ["area_id", "token"]).select("area_id", "q", "document_id").distinct()
    both = pairs.join(theirs.select("area_id", "q", "q_words", "token", "df"), ["area_id", "q"]).join(mine.select("area_id", "document_id", "n_words", "token"), ["area_id", "document_id", "token"])
    weight = F.when(F.col("df") == 1, ONE).when(F.col("df") == 2, TWO).otherwise(MORE)
    sums = both.groupBy("area_id", "q", "document_id", "q_words", "n_words").agg(F.count(F.lit(1)).alias("shared"), F.sum(weight).alias("bonus"))
    score = SHARED + SHARE * F.col("shared") / F.least("q_words", "n_words") + F.least("bonus", F.lit(BONUS)) / 100
    return sums.select("area_id", "q", "document_id", F.least(score, F.lit(1.0)).alias("score"))


def mention_scores(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, document_id, file_name, score, strong) of all documents of a query's area whose name scores FLOOR or more.

    queries: query_id, area_id, query_text; documents: area_id, document_id, file_name. strong: the query is the name, or holds
    the name or a part of its own. A query of generic words alone scores at most GENERIC unless it is the name. Null areas
    and empty queries or names give no rows.
    """
    names, q = once(canonical(documents), "names"), once(asked(queries), "asked")
    exact = q.join(names, (q.area_id == names.area_id) & (q.q == names.name)).select(q.area_id, "q", "document_id", F.lit(EXACT).alias("score"), F.lit(True).alias("strong"))
    telling = q.where(~generic_only(F.col("tokens")))
    held = once(phrases(names), "phrases")
    ways = {"exact": exact, "holding": holding(telling, held).withColumn("strong", F.lit(True))}
    ways |= {"held_by": held_by(telling, names).withColumn("strong", F.lit(False)), "sharing": sharing(telling, names).withColumn("strong", F.lit(False))}
    found = functools.reduce(DataFrame.unionByName, [once(rows, name) for name, rows in ways.items()])
    best = found.groupBy("area_id", "q", "document_id").agg(F.round(F.max("score"), 12).alias("score"), F.max("strong").alias("strong")).where(F.col("score") >= FLOOR)
    order = [F.desc("score"), text.fold(F.col("file_name")), "document_id"]
    rows = best.join(documents.select("area_id", "document_id", "file_name"), ["area_id", "document_id"])
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy("area_id", "q").orderBy(*order))).where(F.col("place") <= TOP)
    return queries.select("query_id", "area_id", text.fold(text.reference_query(F.col("query_text"))).alias("q")).join(top, ["area_id", "q"]).select("query_id", "document_id", "file_name", "score", "strong", "place")


def resolve_mentions(scores: DataFrame) -> DataFrame:
    """(query_id, resolved, confidence) of mention_scores(): one clear document, else all strong ones if several, else none.

    At most TOP rows a query are gathered; queries without any row are not in the result.
    """
    row = F.struct("place", "document_id", "score", "strong")
    lists = scores.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("c"))
    first, second = F.element_at("c", 1), F.try_element_at("c", F.lit(2))
    behind = F.coalesce(second["score"], F.lit(0.0))
    clear = (first["score"] >= CLEAR) & first["strong"] & (second.isNull() | (~second["strong"] & (F.round(first["score"] - behind, 12) >= AHEAD)))
    several = F.filter("c", lambda s: s["score"] >= SEVERAL)
    single = (first["score"] >= SINGLE) & (F.round(first["score"] - behind, 12) >= MARGIN)
    pick = F.when(clear, F.slice("c", 1, 1)).when(F.size(several) >= 2, several).when(single, F.slice("c", 1, 1)).otherwise(F.slice("c", 1, 0))
    return lists.select("query_id", F.transform(pick, lambda s: s["document_id"]).alias("resolved"), first["score"].alias("confidence"))
