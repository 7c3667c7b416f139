"""Searches of many questions in many texts at once, by indexes that are joined by equality and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.reports import let
from ledgerloom.operators.selection import first_rows
from ledgerloom.sources import files

GRAM = 3
#: Needles are found by a run of one of these lengths: long runs are rare where short ones, such as those of numbers, are not.
RUNS = (3, 8)
#: Slices of the titles, by their place in the order, that are looked at one after the other.
SLICES = (0.001, 0.03, 1.0)


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of ``size`` characters of ``text``; none if it is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def runs_of(text: Column) -> Column:
    return F.concat(*[grams(text, n) for n in RUNS])


def first_containing(needles: DataFrame, titles: DataFrame) -> DataFrame:
    """``asked, ord``: for each distinct ``asked`` of ``needles`` the smallest ``ord`` of the titles (ord, title; both in one case) that contain it.

    An inverted index of runs of three and eight characters: up to three characters are answered by the first title of each run; a longer needle looks at
    the postings of its rarest run, and each candidate is checked. Titles come slice by slice in their order: what the first slice answers, as it does for
    needles that most titles contain, doesn't meet the others, so that common runs make no long lists of candidates.
    """
    spark = needles.sparkSession
    asked = needles.select("asked").where("asked is not null").distinct()
    known = titles.where("title is not null and ord is not null").select("ord", "title")
    short = known.select("ord", F.explode(F.flatten(F.array(F.array(F.lit("")), *[grams(F.col("title"), n) for n in range(1, GRAM + 1)]))).alias("asked")).groupBy("asked").agg(F.min("ord").alias("ord"))
    found = asked.where(F.length("asked") <= GRAM).join(short, "asked")

    long = asked.where(F.length("asked") > GRAM).select("asked", F.explode(runs_of(F.col("asked"))).alias("gram"))
    counts = known.select(F.explode(runs_of(F.col("title"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A needle with a run that no title has gets no row for it; the check below then finds nothing.
    rarest = long.join(counts, "gram", "left").groupBy("asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("asked", "r.gram")
    path = files.scratch(spark, "needles")
    rarest.write.parquet(f"{path}/0")
    cuts = known.approxQuantile("ord", list(SLICES[:-1]), 0.0005) or [0.0] * (len(SLICES) - 1)
    results = [found]
    left = spark.read.schema("asked string, gram string").parquet(f"{path}/0")
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        within = known.where((F.lit(low is None) | (F.col("ord") > F.lit(low))) & (F.lit(high is None) | (F.col("ord") <= F.lit(high))))
        postings = within.select("ord", "title", F.explode(runs_of(F.col("title"))).alias("gram"))
        answered = left.join(postings, "gram").where(F.contains("title", "asked")).groupBy("asked").agg(F.min("ord").alias("ord"))
        answered.write.parquet(f"{path}/answers-{k}")
        answered = spark.read.schema(answered.schema).parquet(f"{path}/answers-{k}")
        results.append(answered)
        left = left.join(answered.select("asked"), "asked", "left_anti")
    whole = results[0]
    for part in results[1:]:
        whole = whole.unionByName(part)
    return whole


#: Scores of a query's word and a word of a row: equal, begin, within, and off by one or two edits. A row's score is the mean of the best of each query word.
EQUAL, BEGINS, WITHIN, EDITED = 1.0, 0.9, 0.7, (0.6, 0.4)
#: Characters of a word whose deletions are indexed: words that are within two edits share one of those already.
PREFIX, EDITS = 7, 2


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def deletions(word: Column) -> Column:
    """The first ``PREFIX`` characters of ``word`` with none, one and two of them left out."""
    head = F.substring(word, 1, PREFIX)
    without = lambda text: F.transform(F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.lit(PREFIX))))
    once = without(head)
    return F.array_distinct(F.concat(F.array(head), once, F.flatten(F.transform(once, without))))


def word_score(asked: Column, word: Column) -> Column:
    """How well a word answers an asked one; null if not at all. Edits count for words of four characters or more."""
    near = F.when(F.least(F.length(asked), F.length(word)) >= 4, let(F.levenshtein(asked, word, EDITS), lambda edits: F.when(edits == 1, EDITED[0]).when(edits == 2, EDITED[1])))
    return F.when(asked == word, EQUAL).when(word.startswith(asked), BEGINS).when(word.contains(asked), WITHIN).otherwise(near)


def sets_of_words(rows: DataFrame, key: str, columns: list[str], most: int) -> DataFrame:
    """``number, words, first, keys``: the distinct sets of words of the rows, with the first ``most`` keys of each, written once. Rows with one key are one row."""
    spark = rows.sparkSession
    own = rows.select(F.struct(F.col(key).alias("key")).alias("key"), words_of(F.concat_ws(" ", *columns)).alias("words")).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))
    sets = first_rows(own.where("size(words) > 0"), ["words"], [F.col("key")], most).groupBy("words").agg(F.min("key").alias("first"), F.collect_list("key").alias("keys"))
    path = files.scratch(spark, "words")
    numbered = sets.select(F.monotonically_increasing_id().alias("number"), "words", "first", "keys")
    numbered.write.parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def ranked_search(queries: DataFrame, rows: DataFrame, key: str, columns: list[str], most: int = 10) -> DataFrame:
    """``query, key, score, place``: the best ``most`` rows for each distinct query, ties by ``key``. A row must answer every word of the query.

    Rows with the same words have the same score: sets of words are what is searched, and of each the first ``most`` keys are enough. The vocabulary of the
    sets tells which words answer a query's word: words that contain it are found by its rarest trigram (short ones by their own run), words
    within two edits by deletions that both have. A query looks at the sets that answer its rarest word only, and scores its other words in them.
    """
    asked = queries.select("query").where("query is not null").distinct().withColumn("words", words_of(F.col("query"))).where("size(words) > 0")
    wanted = asked.select("query", F.explode("words").alias("asked"))
    sets = sets_of_words(rows, key, columns, most)
    postings = sets.select("number", F.explode("words").alias("word"))
    vocabulary = postings.groupBy("word").agg(F.count(F.lit(1)).alias("sets"))
    parts = wanted.select("asked").distinct()

    runs = vocabulary.select("word", F.explode(F.flatten(F.array(*[grams(F.col("word"), n) for n in range(1, GRAM + 1)]))).alias("run"))
    counts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("asked") <= GRAM, F.array("asked")).otherwise(grams(F.col("asked")))
    rarest = parts.select("asked", F.explode(own).alias("run")).join(counts, "run", "left").groupBy("asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r")).where("r.n > 0").select("asked", "r.run")
    containing = rarest.join(runs, "run").where(F.contains("word", "asked")).select("asked", "word")
    spelled = lambda df, name: df.where(F.length(name) >= 4).select(name, F.explode(deletions(F.col(name))).alias("deleted"))
    similar = spelled(parts, "asked").join(spelled(vocabulary, "word"), "deleted").select("asked", "word").distinct()
    answers = containing.union(similar).distinct().where(word_score(F.col("asked"), F.col("word")).isNotNull())

    sizes = answers.join(vocabulary, "word").groupBy("asked").agg(F.sum("sets").alias("sets"))
    # A query with a word that nothing answers has no hits.
    through = wanted.join(sizes, "asked", "left").groupBy("query").agg(F.min(F.struct("sets", "asked")).alias("r"), F.every(F.col("sets").isNotNull()).alias("all")).where("all").select("query", "r.asked")
    reached = answers.join(through.select("asked").distinct(), "asked", "left_semi").join(postings, "word").select("asked", "number").distinct().join(sets.select("number", "words", "first"), "number")
    best = lambda a: F.array_max(F.transform("words", lambda w: word_score(a, w)))
    total = F.aggregate(F.transform("asked_words", best), F.lit(0.0), lambda sum_, s: sum_ + s)  # null if a word has no answer
    hits = through.join(asked.withColumnRenamed("words", "asked_words"), "query").join(reached, "asked").select("query", "number", "first", F.round(total / F.size("asked_words"), 6).alias("score"))
    # As many sets as rows are wanted, those with the smallest keys on ties, hold them all.
    top = first_rows(hits, ["query"], [F.col("score").desc_nulls_last(), F.col("first")], most).where("score is not null").select("query", "number", "score")
    found = top.join(sets.select("number", F.explode("keys").alias("k")), "number").select("query", F.col("k.key").alias("key"), "score")
    return first_rows(found, ["query"], [F.col("score").desc(), F.col("key")], most)
