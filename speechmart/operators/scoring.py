"""External scores: texts heard under a segment, name matches, merges and request batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmart.functions.text import scoring_prompt, word_similarity
from speechmart.operators.ranking import positions
from speechmart.sources.shared import materialize

#: Letters that may be left out of a word or piece for it to meet another.
WRONG = 2


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float, slack: float = 0.0) -> DataFrame:
    """Pairs of rows whose [start, end] ranges overlap by more than a point, widened by ``slack``.

    Columns besides the keys carry the prefixes l_ and r_. Both sides are spread over the time cells
    they touch; of the cells a pair shares, the first one reports it.
    """

    def spread(df: DataFrame, p: str, s: float) -> DataFrame:
        cells = F.sequence(F.floor((F.col("start") - s) / cell), F.floor((F.col("end") + s) / cell))
        return df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys], F.explode(cells).alias("_cell"))

    a, b = spread(left, "l", slack), spread(right, "r", 0.0)
    meets = (F.col("r_start") < F.col("l_end") + slack) & (F.col("r_end") > F.col("l_start") - slack)
    first = F.col("_cell") == F.greatest(F.floor((F.col("l_start") - slack) / cell), F.floor(F.col("r_start") / cell))
    return a.join(b, [*keys, "_cell"]).filter(meets & first).drop("_cell")


def overlap_text(segments: DataFrame, chunks: DataFrame, cell: float = 10.0, stem: str = "audio_stem", segment: str = "segment_id") -> DataFrame:
    """Texts of the chunks under every segment, in chunk order; segments without any are dropped."""
    pairs = interval_join(segments.select(stem, segment, "start", "end"), chunks.select(stem, "chunk_idx", "start", "end", "text"), [stem], cell)
    g = pairs.groupBy(stem, F.col(f"l_{segment}").alias(segment)).agg(F.sort_array(F.collect_list(F.struct("r_chunk_idx", "r_text"))).alias("ts"))
    out = g.select(stem, segment, F.array_join(F.transform("ts", lambda t: t["r_text"]), " ").alias("asr_text"))
    return out.filter(F.trim("asr_text") != "")


def words_in_range(pairs: DataFrame, words: DataFrame, slack: float = 0.5, cell: float = 10.0, stem: str = "audio_stem") -> DataFrame:
    """Words that lie inside a pair's range, ``slack`` seconds wider on both sides."""
    hit = interval_join(pairs, words, [stem], cell, slack)
    return hit.filter((F.col("r_start") >= F.col("l_start") - slack) & (F.col("r_end") <= F.col("l_end") + slack))


def folded_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "_", ""))


def _lengths(texts: DataFrame, text: str) -> list[int]:
    """The distinct lengths of a column, as few as its longest text has characters."""
    return sorted(r[0] for r in texts.select(F.length(text)).distinct().collect() if r[0] is not None)


def _pieces(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """The rows once for every substring of ``key`` of the given lengths, which takes its place.

    Lengths and starts become rows one after the other, so no array grows with the square of a name.
    """
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(key))
    sized = rows.withColumn("_n", F.explode(fits))
    placed = sized.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(key) - F.col("_n") + 1)))
    return placed.withColumn(key, F.substring(F.col(key), F.col("_at"), F.col("_n"))).drop("_n", "_at")


def fuzzy_name_join(names: DataFrame, others: DataFrame, name: str, other: str, max_other_names: int | None = None) -> DataFrame:
    """The first other name, in name order, that contains a name or is contained in it.

    The shorter of two such names equals a substring of the longer one, so both directions are joins on
    an equal key: substrings of the lengths that the other side has. Every key keeps its first other
    name only, so a common substring makes no more rows than there are names. With ``max_other_names``
    the join refuses a larger list of other names.
    """
    if max_other_names is not None and (n := others.select(other).distinct().count()) > max_other_names:
        raise ValueError(f"{n} distinct names, more than {max_other_names}")
    a = names.select(F.col(name).alias("_name"), folded_name(F.col(name)).alias("_key")).filter("_key is not null").distinct()
    b = others.select(F.col(other).alias("_other"), folded_name(F.col(other)).alias("_key")).filter("_key is not null")
    b = b.groupBy("_key").agg(F.min("_other").alias("_other"))
    held = _pieces(a, "_key", _lengths(b, "_key")).join(b, "_key")
    holding = _pieces(b, "_key", _lengths(a, "_key")).groupBy("_key").agg(F.min("_other").alias("_other"))
    pairs = held.select("_name", "_other").unionAll(a.join(holding, "_key").select("_name", "_other"))
    return pairs.groupBy(F.col("_name").alias(name)).agg(F.min("_other").alias(other))


def _cuts(length: Column, pieces: Column) -> Column:
    """(start, length) of as many pieces of nearly equal length."""
    base, longer = F.floor(length / pieces).cast("int"), length % pieces
    from_end = pieces - longer  # pieces before this one have the base length
    one = lambda i: F.struct(
        i.alias("i"),
        (i * base + F.greatest(F.lit(0), i - from_end)).cast("int").alias("at"),
        (base + F.when(i >= from_end, 1).otherwise(0)).cast("int").alias("n"),
    )
    return F.transform(F.sequence(F.lit(0), pieces - 1), one)


def _without(rows: DataFrame, text: str, letters: Column) -> DataFrame:
    """The rows once for every distinct form of ``text`` with at most so many (up to ``WRONG``) letters left out."""

    def fewer(x: Column) -> Column:
        places = F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.concat(F.substring(x, F.lit(1), p - 1), F.substring(x, p + 1, F.length(x))))

    rows = rows.withColumn("_forms", F.array(text))
    for n in range(WRONG):
        more = F.array_distinct(F.concat("_forms", F.flatten(F.transform("_forms", fewer))))
        rows = rows.withColumn("_forms", F.when(letters > n, more).otherwise(F.col("_forms")))
    return rows.withColumn(text, F.explode("_forms")).drop("_forms")


def similar_words(words: DataFrame, word: str, least: float = 0.8) -> DataFrame:
    """All ordered pairs (a, b, similarity) of distinct words whose ``word_similarity`` reaches ``least``.

    No pair is lost: words that a sound change makes equal meet in their changed form, for each of the
    three changes. All others may differ in d = (1 - least) of the longer one's letters at most. Two words
    that differ in d letters are equal without some d of them or fewer, so up to ``WRONG`` they meet in all
    their forms with so many letters left out. Beyond that the shorter one is cut into pieces, of which
    some piece differs in ``WRONG`` letters at most from a part of the longer one that begins no more than
    d places off; these meet in the same way. ``least`` is above 0.5. Words are
    compared trimmed and in lower case; null and blank words have no pairs.
    """
    share = 1 - least + 1e-9
    w = words.select(F.trim(F.lower(F.col(word))).alias("w")).filter("w <> ''").distinct()
    w = materialize(w.repartition("w"), "words")  # read once for every way in which words may meet
    folds = [F.regexp_replace("w", x, y) for x, y in (("k", "t"), ("ng", "n"), ("r", "l"))]
    folded = w.select("w", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), f.alias("f")) for k, f in enumerate(folds)])).alias("key"))
    n, longer, d = F.length("w"), F.col("longer"), F.floor(F.col("longer") * share).cast("int")
    short = w.select("w", n.alias("shorter"), F.explode(F.sequence(n, F.floor(n / (1 - share)).cast("int"))).alias("longer")).withColumn("d", d).filter("d > 0 and longer - shorter <= d")
    long_ = w.withColumn("longer", n).withColumn("d", d).filter("d > 0")
    # few letters: the whole words meet
    near = [F.col("d") <= WRONG, F.col("d") > WRONG]
    whole = [x.filter(near[0]).select("w", "d", F.col("w").alias("piece")).distinct() for x in (short, long_)]
    whole = [_without(x, "piece", F.col("d")).select("w", F.struct("d", "piece").alias("key")) for x in whole]
    # many letters: one of the pieces meets a part of the longer word
    pieces, wrong = F.floor(F.col("d") / (WRONG + 1)).cast("int") + 1, F.floor(F.col("d") / (F.floor(F.col("d") / (WRONG + 1)) + 1)).cast("int")
    few = [short.filter(near[1]), long_.filter(near[1]).withColumn("shorter", F.explode(F.sequence(F.greatest(F.lit(1), longer - F.col("d")), longer)))]
    few = [x.select("*", wrong.alias("wrong"), F.explode(_cuts(F.col("shorter"), pieces)).alias("c")).select("*", "c.i", "c.at", "c.n").drop("c") for x in few]
    few[0] = few[0].withColumn("piece", F.substring("w", F.col("at") + 1, F.col("n")))
    few[1] = few[1].withColumn("begin", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("d")), F.least(F.col("at") + F.col("d"), longer))))
    few[1] = few[1].withColumn("size", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - F.col("wrong")), F.col("n") + F.col("wrong"))))
    few[1] = few[1].filter(F.col("begin") + F.col("size") <= longer).withColumn("piece", F.substring("w", F.col("begin") + 1, F.col("size")))
    few = [_without(x, "piece", F.col("wrong")).select("w", F.struct("shorter", "longer", "i", "piece").alias("key")).distinct() for x in few]

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        # Spark takes the forms to be as small as the words, and would gather them in the driver to broadcast them
        pairs = x.select("key", F.col("w").alias("x")).join(y.select("key", F.col("w").alias("y")).hint("merge"), "key").filter("x <> y")
        return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))

    pairs = met(folded, folded).unionAll(met(*whole)).unionAll(met(*few)).distinct()
    both = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("p")).select("p.a", "p.b")
    return both.withColumn("similarity", F.round(word_similarity(F.col("a"), F.col("b")), 6)).filter(F.col("similarity") >= least)


def merge_scores(segments: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """``llm_score`` of every segment: the score of the last file, else align_score, else 0.5.

    ``scores`` has the key, score, file and row_idx.
    """
    last = scores.groupBy(key).agg(F.max_by("score", F.struct("file", "row_idx")).alias("score"))
    return segments.join(last, key, "left").withColumn("llm_score", F.coalesce("score", "align_score", F.lit(0.5))).drop("score")


def merge_scores_by_position(segments: DataFrame, scores: DataFrame, order: list[str], partition: str | None = None) -> DataFrame:
    """Scores whose id is the segment's 0-based position; the old confidence is kept beside the new one.

    With ``partition`` positions are counted, and scores keyed, within that column.
    """
    keys = [partition, "id"] if partition else ["id"]
    placed = positions(segments, keys[:-1], order, "id")
    merged = placed.join(scores.select(*keys, "llm_confidence"), keys, "left").withColumn("sequence_confidence", F.col("confidence"))
    return merged.withColumn("confidence", F.coalesce("llm_confidence", "confidence"))


def combined_confidence(align: Column, llm: Column) -> Column:
    """0.4 of the alignment's and 0.6 of the semantic score, three decimals, ties to even."""
    return F.bround(0.4 * align + 0.6 * llm, 3)


def batches(rows: DataFrame, order: list[str], size: int = 50, partition: str | None = None) -> DataFrame:
    """Rows with batch_idx, ``size`` rows each in order."""
    placed = positions(rows, [partition] if partition else [], order, "_at")
    return placed.withColumn("batch_idx", F.floor(F.col("_at") / size)).drop("_at")


def batch_requests(rows: DataFrame, head: str = "Rate how well each pair matches, 0 to 1.\n", key: str = "id") -> DataFrame:
    """batch_idx, segments and prompt of rows with batch_idx, key, mms_text and text."""
    one = scoring_prompt(F.col(key).cast("string"), F.col("mms_text"), F.col("text"))
    g = rows.groupBy("batch_idx").agg(F.sort_array(F.collect_list(F.struct(F.col(key), "mms_text", "text", one.alias("block")))).alias("segments"))
    return g.select("batch_idx", "segments", F.concat(F.lit(head), F.array_join(F.transform("segments", lambda s: s["block"]), "\n")).alias("prompt"))
