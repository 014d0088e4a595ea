"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, occurrences, white_tokens


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if b is null or either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(b.isNull() | (norm == 0), 1.0).otherwise(1 - dot(a, b) / norm)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0 if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def confidence(similarity: Column) -> Column:
    return F.least(F.greatest((similarity + 1) / 2, F.lit(0.0)), F.lit(1.0))


def fts_score(tokens: Column, content: Column) -> Column:
    """Occurrences of all tokens (repeats count again) in the lower-cased content."""
    low = F.lower(content)
    return F.aggregate(tokens, F.lit(0), lambda s, t: s + occurrences(low, t))


def rrf(*ranks: Column, k: int = 60) -> Column:
    """Reciprocal rank fusion over the ranks that are not null."""
    return sum((F.coalesce(F.lit(1.0) / (F.lit(k) + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def best_rank(*ranks: Column) -> Column:
    return F.coalesce(F.least(*ranks), F.lit(1_000_000))


def token_hits(tokens: Column, text: Column) -> Column:
    """How many of the tokens the text contains."""
    return F.size(F.filter(tokens, lambda t: F.contains(text, t)))


def policy_score(rrf_score: Column, query: Column, tokens: Column, heading: Column, content: Column) -> Column:
    """RRF score with the heading, content and table-of-contents terms (fixed weights)."""
    q, h, c = F.lower(F.trim(query)), F.lower(F.coalesce(heading, F.lit(""))), F.lower(content)
    in_heading = (F.length(q) > 0) & F.contains(h, q)
    contents = F.contains(content, F.repeat(F.lit("."), F.lit(64)))
    return (
        rrf_score
        + F.when((F.length(q) > 0) & F.contains(c, q), 0.08).otherwise(0.0)
        + F.when(in_heading, 0.12).otherwise(0.0)
        + F.least(token_hits(tokens, h), F.lit(4)) * 0.025
        + F.least(token_hits(tokens, c), F.lit(6)) * 0.008
        - F.when(contents, F.when(in_heading, 0.09).otherwise(0.12)).otherwise(0.0)
    )


def anchor_score(query: Column, tokens: Column, heading: Column, content: Column) -> Column:
    """How well a child anchors a context (fixed weights)."""
    q, h, c = fold(F.trim(query)), fold(F.coalesce(heading, F.lit(""))), fold(content)
    return (
        F.when((F.length(q) > 0) & F.contains(h, q), 10).otherwise(0)
        + F.when((F.length(q) > 0) & F.contains(c, q), 8).otherwise(0)
        + 2 * F.least(token_hits(tokens, h), F.lit(6))
        + F.least(token_hits(tokens, c), F.lit(12))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the smaller set."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def ordered_coverage(query: Column, name: Column) -> Column:
    """Tokens of the name met in order within the query, over the smaller list."""
    found = F.aggregate(
        name,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")),
        lambda s, t: F.when(
            F.array_position(F.slice(query, s["at"] + 1, F.greatest(F.size(query), F.lit(1))), t) > 0,
            F.struct((s["at"] + F.array_position(F.slice(query, s["at"] + 1, F.greatest(F.size(query), F.lit(1))), t).cast("int")).alias("at"), (s["n"] + 1).alias("n")),
        ).otherwise(s),
    )
    least = F.least(F.size(query), F.size(name))
    return F.when(least > 0, found["n"] / least).otherwise(0.0)


def stable_fraction(*parts: Column) -> Column:
    """A fraction from 0 to 1 by the first eight bytes of SHA-256 over the parts, null-separated."""
    digest = F.sha2(F.concat_ws("\u0000", *parts), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64 - 1))


def deterministic_rerank(query: Column, candidate_id: Column, text: Column) -> Column:
    """Occurrences of the query's words between white space, repeats counted again, plus the stable fraction."""
    low = F.lower(text)
    hits = F.aggregate(white_tokens(query), F.lit(0), lambda s, t: s + occurrences(low, t))
    return hits + stable_fraction(query, candidate_id, text)


def deterministic_embedding(text: Column, dimensions: int = 1536) -> Column:
    """A unit vector from SHA-256 in counter mode: eight 32-bit numbers a digest, mapped to -1..1."""

    def number(i: Column) -> Column:
        digest = F.sha2(F.concat(text, F.lit("\u0000"), F.floor(i / 8).cast("string")), 256)
        return F.conv(F.substring(digest, (F.pmod(i, F.lit(8)) * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") / F.lit(4294967295.0) * 2 - 1

    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), number)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / norm)


def padded(vector: Column, dimensions: int) -> Column:
    """Shorter vectors filled with zeros; longer ones are an error."""
    fill = F.array_repeat(F.lit(0.0), F.greatest(F.lit(dimensions) - F.size(vector), F.lit(0)))
    too_long = F.raise_error(F.lit(f"vector longer than {dimensions}"))
    return F.when(F.size(vector) <= dimensions, F.concat(vector.cast("array<double>"), fill)).otherwise(too_long.cast("array<double>"))
