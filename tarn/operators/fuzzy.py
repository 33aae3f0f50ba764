"""F15 for many words at once: a deletion-neighbourhood index of a vocabulary, met by equal keys, distances verified after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that must be equal at the start, and letters after them of which deletions are made: 56 keys of a word at most.
LOCKED = 2
REACH = 10


def allowed_edits(word: Column) -> Column:
    """None to 3 letters, one to 6, else two."""
    n = F.length(word)
    return F.when(n <= 3, 0).when(n <= 6, 1).otherwise(2)


def _shorter(words: Column) -> Column:
    """All words of an array with one letter less."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), less)))


def deletion_keys(word: Column) -> Column:
    """The locked letters with every remainder of the next ``REACH`` letters after up to two deletions.

    Two words of a common start at two edits or less share a key: each loses at most two letters of its reach until what an alignment keeps in both
    is left, and letters that an insertion pushes out of reach are among them. So keys stay few however long a word is.
    """
    start, rest = F.substring(word, 1, LOCKED), F.array(F.substring(word, LOCKED + 1, REACH))
    one = _shorter(rest)
    keys = F.array_distinct(F.concat(rest, one, _shorter(one)))
    return F.transform(keys, lambda k: F.concat(start, F.lit("\x01"), k))


def deletion_index(vocabulary: DataFrame, term: str) -> DataFrame:
    """``key, term`` of the distinct words of a vocabulary, to be written once and read for every set of queries."""
    words = vocabulary.where(F.col(term).isNotNull()).select(F.col(term).alias("term")).distinct()
    return words.select(F.explode(deletion_keys(F.col("term"))).alias("key"), "term")


def fuzzy_terms(index: DataFrame, queries: DataFrame, word: str) -> DataFrame:
    """``word, term, distance``: for each distinct query word the terms within its edits, whose first two letters are its own; a word of up to 3 letters finds itself alone."""
    asked = queries.where(F.col(word).isNotNull()).select(F.lower(word).alias("word")).distinct()
    keys = asked.select("word", F.explode(F.when(F.length("word") > 3, deletion_keys(F.col("word"))).otherwise(F.slice(deletion_keys(F.col("word")), 1, 1))).alias("key"))
    pairs = keys.join(index, "key").where(F.substring("word", 1, LOCKED) == F.substring("term", 1, LOCKED))
    distance = F.when(F.col("word") == F.col("term"), 0).otherwise(F.levenshtein("word", "term", 2))
    near = pairs.select("word", "term", distance.alias("distance")).where((F.col("distance") >= 0) & (F.col("distance") <= allowed_edits(F.col("word"))))
    return near.distinct()
