"""Words near one another by edits, joined on what is left of them after deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 12  # letters of a word that deletions are made in: 79 forms at most for two edits, however long the word


def _shorter(word: Column) -> Column:
    """The word without each one of its letters."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, F.length(word))))


def deletions(word: Column, within: int) -> Column:
    """The distinct forms of a word's first letters with up to so many of them deleted.

    Words within so many edits share a form: of their first letters in common order, at most that many are missing on either side.
    """
    forms = every = F.array(F.left(word, F.lit(PREFIX)))
    for _ in range(within):
        forms = F.array_distinct(F.flatten(F.transform(F.filter(forms, lambda w: F.length(w) > 0), _shorter)))
        every = F.concat(every, forms)
    return F.array_distinct(every)


def nearest(words: DataFrame, vocabulary: DataFrame, within: int = 2) -> DataFrame:
    """(word, near, distance): for each distinct word of words (word) the nearest of vocabulary (ord, word) within so many edits, by lower
    case; of equals the one with the least ord. Words with none near have no row; nulls are no words.

    An equi-join on forms after deletions, then the exact distance: the cost follows the words, not words times vocabulary.
    """
    form = lambda df: df.withColumn("low", F.lower("word")).withColumn("form", F.explode(deletions(F.col("low"), within)))
    asked = form(words.where("word is not null").select("word").distinct())
    known = form(vocabulary.where("word is not null").select("ord", "word")).select("ord", F.col("word").alias("near"), F.col("low").alias("other"), "form")
    met = asked.join(known, "form").where(F.abs(F.length("low") - F.length("other")) <= within)
    met = met.withColumn("distance", F.levenshtein("low", "other", within)).where("distance >= 0")
    return met.groupBy("word").agg(F.min(F.struct("distance", "ord", "near")).alias("m")).select("word", "m.near", "m.distance")
