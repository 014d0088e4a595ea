"""Review of benchmark items: which items to show, windows of the document to show with them, chosen quotes to spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text

#: Characters of a window, windows of an item, least characters of an answer or hint that is looked up, characters by
#: which windows are told apart (fixed values).
WINDOW_CHARS, WINDOWS, LEAST_ANSWER, SAME_CHARS = 1400, 12, 3, 240
#: Added to a window that holds the answer, a hint, a phrase of the question (fixed values).
ANSWER_BONUS, HINT_BONUS, PHRASE_BONUS = 0.35, 0.25, 0.45
#: Phrases that are in any question (fixed values).
COMMON_PHRASES = ["what is the", "what was the", "how much did", "in which year"]
#: Words of a phrase, phrases of a question (fixed values).
PHRASE_WORDS, PHRASES = (6, 3), 12


def reviewable(query: Column, answer: Column) -> Column:
    """There is a question and an answer other than yes or no."""
    q, a = text.strip(F.coalesce(query, F.lit(""))), F.lower(text.strip(F.coalesce(answer, F.lit(""))))
    return (q != "") & ~a.isin("", "yes", "no")


def tokens(c: Column) -> Column:
    """Distinct coarse tokens: runs of letters, digits, Han and the marks of figures."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[A-Za-z0-9%$.,/\x{4e00}-\x{9fff}-]+"), F.lit(0)))


def compact(c: Column) -> Column:
    """Lower case without white space and the marks of figures."""
    return F.regexp_replace(F.lower(c), r"[\s,.$()%/-]+", "")


def phrases(query: Column) -> Column:
    """Runs of six down to three words of the question in lower case, each once, the first twelve."""
    words = F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    most, least = PHRASE_WORDS

    def runs(n: int) -> Column:
        all_of = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, all_of).otherwise(F.array().cast("array<string>"))

    held = [runs(n) for n in range(most, least - 1, -1)]
    return F.slice(F.array_distinct(F.filter(F.concat(*held), lambda p: ~p.isin(COMMON_PHRASES))), 1, PHRASES)


def windows(items: DataFrame) -> DataFrame:
    """items (item_id, display_text, query_text, answer_text, evidence_texts) to their best windows: item_id, window_id,
    start_offset, end_offset, window_text, score.

    Blocks between blank lines, cut to WINDOW_CHARS, score by the overlap of their tokens with question, answer and hints,
    and by holding the answer, a hint or a phrase. Those above zero stay, of such as begin alike the best, the WINDOWS
    best in all; an item without any gets the beginning of its text. item_id is unique; null texts are empty. Texts are
    scored where they are read; one shuffle, by item, moves the windows alone. A block's start is where the block begins,
    white space included.
    """
    whole, query, answer = (F.coalesce(c, F.lit("")) for c in ("display_text", "query_text", "answer_text"))
    hints = F.filter(F.transform(F.coalesce("evidence_texts", F.array().cast("array<string>")), text.strip), lambda h: h != "")
    signal = F.array_join(F.filter(F.concat(F.array(text.strip(query), text.strip(answer)), hints), lambda p: p != ""), " ")
    pieces = F.split(whole, r"(?<=\n\n)(?!\n)")  # every block with the newlines behind it
    known = items.select(
        "item_id",
        F.concat(pieces, F.array(F.substring(whole, 1, WINDOW_CHARS))).alias("pieces"),
        tokens(signal).alias("asked"),
        text.strip(answer).alias("answer"),
        F.filter(hints, lambda h: F.length(h) >= LEAST_ANSWER).alias("hints"),
        phrases(query).alias("phrases"),
    )
    cut = known.select("*", F.size("pieces").alias("n"), F.posexplode("pieces").alias("place", "piece")).drop("pieces")
    spare = F.col("place") == F.col("n") - 1
    cut = cut.withColumn("spare", spare).withColumn("window_text", F.when(spare, F.col("piece")).otherwise(F.substring(text.strip(F.col("piece")), 1, WINDOW_CHARS)))
    low, packed = F.lower("window_text"), compact(F.col("window_text"))
    score = (
        scoring.jaccard(F.col("asked"), tokens(F.col("window_text")))
        + F.when((F.length("answer") >= LEAST_ANSWER) & F.contains(packed, compact(F.col("answer"))), ANSWER_BONUS).otherwise(0.0)
        + F.when(F.exists("hints", lambda h: F.contains(packed, compact(h))), HINT_BONUS).otherwise(0.0)
        + F.when(F.exists("phrases", lambda p: F.contains(low, p)), PHRASE_BONUS).otherwise(0.0)
    )
    rows = cut.select("item_id", "place", "spare", "window_text", F.length("piece").alias("chars"), F.when(F.col("spare"), 0.0).otherwise(F.round(score, 6)).alias("score"))
    rows = rows.withColumn("filled", (F.col("window_text") != "") & ~F.col("spare"))
    by_item = Window.partitionBy("item_id")
    running = by_item.orderBy("place")
    start = F.sum("chars").over(running) - F.col("chars")
    number = F.sum(F.col("filled").cast("int")).over(running)
    rows = rows.withColumn("start_offset", F.when(F.col("spare"), 0).otherwise(start).cast("int")).withColumn("window_id", F.when(F.col("spare"), "W1").otherwise(F.concat(F.lit("W"), number.cast("string"))))
    rows = rows.where("spare or (filled and score > 0)")
    best = [F.col("spare"), F.desc("score"), F.col("start_offset")]
    alike = text.strip(F.substring("window_text", 1, SAME_CHARS))
    rows = rows.withColumn("alike", F.row_number().over(Window.partitionBy("item_id", alike).orderBy(*best))).where("alike = 1")
    rows = rows.withColumn("rank", F.row_number().over(by_item.orderBy(*best))).where(f"(spare and rank = 1) or (not spare and rank <= {WINDOWS})")
    return rows.select("item_id", "window_id", "start_offset", (F.col("start_offset") + F.length("window_text")).alias("end_offset"), "window_text", "score")


def quoted_spans(shown: DataFrame, snippets: DataFrame) -> DataFrame:
    """snippets (item_id, window_id, quote) to the spans of the document that they quote: item_id, start_offset,
    end_offset, each once; empty quotes, unknown windows and quotes that are not in their window give none."""
    j = snippets.withColumn("quote", text.strip(F.col("quote"))).where("quote <> ''").join(shown, ["item_id", "window_id"])
    at = F.instr("window_text", F.col("quote"))
    start = F.col("start_offset") + at - 1
    return j.where(at > 0).select("item_id", start.alias("start_offset"), (start + F.length("quote")).alias("end_offset")).distinct()
