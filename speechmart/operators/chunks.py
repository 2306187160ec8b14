"""Chunks of transcripts: words with estimated times, grids, overlaps and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmart.functions.text import WHITE, words
from speechmart.operators.folds import limited_groups
from speechmart.operators.ranking import numbered_runs, running_total


def chunk_words(chunks: DataFrame, stem: str = "audio_stem", rounded: bool = True) -> DataFrame:
    """Words spread evenly over their chunk: stem, chunk_idx, pos, word, start, end."""
    # counted below the explode; beside it, the whole text would be split again for every word
    split = chunks.select(stem, "chunk_idx", "start", "end", words(F.lower("text")).alias("_ws")).withColumn("n", F.size("_ws"))
    each = split.select(stem, "chunk_idx", F.posexplode("_ws").alias("pos", "word"), "start", "end", "n")
    step = (F.col("end") - F.col("start")) / F.col("n")
    start, end = F.col("start") + F.col("pos") * step, F.col("start") + (F.col("pos") + 1) * step
    if rounded:
        start, end = F.bround(start, 3), F.bround(end, 3)
    return each.select(stem, "chunk_idx", "pos", "word", start.alias("start"), end.alias("end"))


def transcript_words(paragraphs: DataFrame, source: str, order: str, text: str = "text", first: DataFrame | None = None) -> DataFrame:
    """source, word_idx (0-based over all paragraphs of a source), word.

    ``first`` (source, n) tells how many words of a source are wanted, if not all; paragraphs that begin
    behind them, and those of sources it lacks, are left out before they are split.

    Only the paragraphs' word counts are summed along a source, range by range, so a long source is not
    one task's work.
    """
    ws = words(F.trim(text))
    placed = running_total(paragraphs.select(source, order, text), [source], [order], F.size(ws), "base")
    if first is not None:
        wanted = first.select(F.col(f"`{source}`").alias("_source"), F.col("n").alias("_n"))
        placed = placed.join(wanted, F.col(f"`{source}`") == F.col("_source")).filter(F.col("base") < F.col("_n"))
        each = placed.select(source, "base", "_n", F.posexplode(ws).alias("p", "word")).filter(F.col("base") + F.col("p") < F.col("_n"))
    else:
        each = placed.select(source, "base", F.posexplode(ws).alias("p", "word"))
    return each.select(source, (F.col("base") + F.col("p")).alias("word_idx"), "word")


def long_paragraphs(paragraphs: DataFrame, text: str = "text", more_than: int = 10) -> DataFrame:
    return paragraphs.filter(F.length(F.trim(text)) > more_than)


def wordy_paragraphs(paragraphs: DataFrame, text: str = "text", at_least: int = 3) -> DataFrame:
    return paragraphs.filter(F.size(words(F.col(text))) >= at_least)


def full_text(paragraphs: DataFrame, source: str, order: str, text: str = "text", joiner: str = " ") -> DataFrame:
    """One text per source, its non-blank paragraphs in order."""
    kept = paragraphs.filter(F.trim(text) != "").groupBy(source).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("ps"))
    return kept.select(source, F.array_join(F.transform("ps", lambda p: p[text]), joiner).alias("text"))


def head_paragraphs(paragraphs: DataFrame, source: str, order: str, text: str = "text", n: int = 51, width: int = 100) -> DataFrame:
    """The first non-blank paragraphs of a source, shortened."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return paragraphs.filter(F.trim(text) != "").withColumn("rank", rank).filter(F.col("rank") <= n).select(source, "rank", F.substring(text, 1, width).alias("text"))


def day_sections(paragraphs: DataFrame, source: str, order: str, text: str = "text", header: str = r"(?i)(day\s*\d+|^\d{1,2}/\d{1,2}/\d{2,4})") -> DataFrame:
    """Text by header: what stands before the first header is dropped, a repeated header starts anew.

    A source without headers is one section ``all``.
    """
    t = F.trim(text)
    marked = paragraphs.filter(t != "").select(source, order, t.alias("t"), (t.rlike(header) & (F.length(t) < 50)).alias("is_header"))
    so_far = Window.partitionBy(source).orderBy(order)
    whole = Window.partitionBy(source)
    head = F.struct(F.col(order).alias("o"), F.col("t").alias("name"))
    placed = marked.withColumn("head", F.last(F.when(F.col("is_header"), head), ignorenulls=True).over(so_far)).withColumn("headed", F.max("is_header").over(whole))
    body = placed.filter(~F.col("is_header") & (~F.col("headed") | F.col("head").isNotNull()))
    body = body.select(source, order, "t", F.coalesce(F.col("head.name"), F.lit("all")).alias("section"), F.coalesce(F.col("head.o"), F.lit(-1)).alias("at"))
    heads = placed.filter("is_header").select(source, F.col("t").alias("section"), F.col(order).alias("at"))
    joined = body.groupBy(source, "section", "at").agg(F.sort_array(F.collect_list(F.struct(order, "t"))).alias("ps"))
    joined = joined.select(source, "section", "at", F.array_join(F.transform("ps", lambda p: p["t"]), " ").alias("text"))
    every = joined.unionByName(heads.join(joined, [source, "section", "at"], "left_anti").withColumn("text", F.lit("")))
    return every.groupBy(source, "section").agg(F.max_by("text", "at").alias("text"))


def accumulate_chunks(segments: DataFrame, size: float = 10.0, stem: str = "audio_stem") -> DataFrame:
    """Segments of one file appended while they start within ``size`` of the chunk's start.

    A chunk begins with a segment that has text. A segment that starts ``size`` or more after the one
    before it always begins a chunk; between such ones the chunks are chains that
    ``folds.limited_groups`` follows. A null text counts as empty; segments of equal times are ordered by
    their text.
    """
    text = F.coalesce(F.btrim("text", F.lit(WHITE)), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{stem}`").cast("string")), F.lit("-"))
    order = ["start", "end", "text"]
    rows = segments.select(key.alias("_f"), F.col(f"`{stem}`").alias("_stem"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), text.alias("text"))
    runs = numbered_runs(rows, ["_f"], order, ["start"], lambda own, before: own("start") - before("start") >= size, "_r")
    groups = limited_groups(runs, ["_f", "_r"], order, "start", "start", size, inclusive=True, begins=F.col("text") != "").filter("_head is not null")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda r: r["text"]), " ")
    g = groups.groupBy("_f", "_r", "_head").agg(F.first("_stem").alias(stem), F.min("start").alias("start"), F.max_by("end", F.struct(*order)).alias("end"), joined.alias("text"))
    return g.select(stem, "start", "end", "text")


def regrid(chunks: DataFrame, size: float = 10.0, stem: str = "audio_stem") -> DataFrame:
    """Chunks moved to a grid of ``size`` seconds; those of one cell are joined in order."""
    cell = (F.floor(F.col("start") / size) * size).cast("double")
    g = chunks.groupBy(stem, cell.alias("grid")).agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("ts"), F.max("end").alias("last"))
    return g.select(stem, F.col("grid").alias("start"), F.greatest(F.col("grid") + size, "last").alias("end"), F.array_join(F.transform("ts", lambda t: t["text"]), " ").alias("text"))


def fixed_chunks(files: DataFrame, size: float = 30.0, overlap: float = 0.0, least: float = 0.1, stem: str = "audio_stem", duration: str = "duration") -> DataFrame:
    """Chunk times of every file; the first chunk shorter than ``least`` ends the file."""
    step = size - overlap
    n = F.ceil(F.col(duration) / step).cast("int")
    each = files.select(stem, duration, F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("chunk_idx"))
    start = F.col("chunk_idx") * step
    out = each.select(stem, "chunk_idx", start.alias("start"), F.least(start + size, duration).alias("end"))
    return out.filter((F.col("end") - F.col("start") >= least) & (F.col("end") > F.col("start")))


def words_of_chunks(words_df: DataFrame, chunks: DataFrame, stem: str = "audio_stem", cell: float = 30.0) -> DataFrame:
    """Words (stem, start, ...) with every chunk (stem, chunk_idx, chunk_start, chunk_end) in whose time they begin.

    Chunks are spread over the time cells they touch and a word looks up its own cell, so a word meets the
    few chunks of its time and a file of any length is neither one key nor a product of its words and chunks.
    """
    cells = F.sequence(F.floor(F.col("chunk_start") / cell), F.floor(F.col("chunk_end") / cell))
    spread = chunks.withColumn("_cell", F.explode(cells))
    met = words_df.withColumn("_cell", F.floor(F.col("start") / cell)).join(spread, [stem, "_cell"]).drop("_cell")
    return met.filter((F.col("start") >= F.col("chunk_start")) & (F.col("start") < F.col("chunk_end")))


def resolve_overlap(chunk_words: DataFrame, stem: str = "audio_stem") -> DataFrame:
    """Words (stem, chunk_idx, chunk_start, start, end, ...) of overlapping chunks.

    A word stays if it ends before the next chunk that has words begins.
    """
    starts = chunk_words.groupBy(stem, "chunk_idx").agg(F.min("chunk_start").alias("s"))
    following = starts.withColumn("next_start", F.lead("s").over(Window.partitionBy(stem).orderBy("chunk_idx"))).drop("s")
    kept = chunk_words.join(following, [stem, "chunk_idx"])
    return kept.filter(F.col("next_start").isNull() | (F.col("end") < F.col("next_start"))).drop("next_start")


def text_blocks(words_df: DataFrame, source: str, duration: Column, block: int = 50) -> DataFrame:
    """Blocks of ``block`` words with a proportional share of the duration: source, block, n_words, start, end."""
    placed = words_df.withColumn("_block", F.floor(F.col("word_idx") / block)).withColumn("_d", duration)
    counts = placed.groupBy(source, F.col("_block").alias("block")).agg(F.count("*").alias("n_words"), F.max("_d").alias("_d"))
    totals = counts.groupBy(F.col(f"`{source}`").alias("_source")).agg(F.sum("n_words").alias("_n"), F.max("_d").alias("_whole"))
    per = F.col("_whole") / F.ceil(F.col("_n") / block)
    spread = counts.join(totals, F.col(f"`{source}`").eqNullSafe(F.col("_source")))
    return spread.select(source, "block", "n_words", (F.col("block") * per).alias("start"), ((F.col("block") + 1) * per).alias("end"))
