"""Chains of operators: from chunks to segments, to scored tiers, to splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmart.operators import anchors as A
from speechmart.operators import chunks as C
from speechmart.operators import dtw, scoring, segments, sequences, splits, tiers
from speechmart.sources.shared import materialize


def anchors_of(chunks: DataFrame, native: list[str], english: list[str], equivalents: dict[str, str] | None = None) -> DataFrame:
    """Merged anchors of chunks of two sources (source ``mms`` or another)."""
    left = A.anchor_hits(chunks.filter("source = 'mms'"), native, "mms")
    right = A.anchor_hits(chunks.filter("source <> 'mms'"), english, "whisper_en")
    return A.merge_anchors(left, right, equivalents=equivalents)


def segments_of(anchors: DataFrame, files: DataFrame, transcript: DataFrame, keywords: list[str], least: float = 0.45) -> DataFrame:
    """Segments of every file: anchors, candidates, sequences, scores, pairs.

    ``files`` has audio_stem, session, duration, total_words, day, take; ``transcript`` has session,
    word_idx and word. Every pair brings the words of its own range, which are joined by position;
    pairs outside the pace of ``pair_segments`` bring none. Anchors and sequences are written once,
    since several steps read them.
    """
    hinted = sequences.position_hints(files).select("audio_stem", "session", "hint_start", "hint_end")
    blocks = materialize(sequences.posting_blocks(transcript, keywords, "session"), "postings")
    placed = materialize(anchors.join(hinted, "audio_stem"), "placed")
    enough = placed.groupBy("audio_stem").agg(F.count("*").alias("n")).filter(F.col("n") >= sequences.LEAST_LENGTH)
    placed = placed.join(enough.select("audio_stem"), "audio_stem", "left_semi")
    seq = materialize(sequences.matched_sequences(sequences.band_candidates(placed, blocks, "session")), "sequences")
    good = sequences.scored_sequences(seq).filter(F.col("confidence") >= least).select("audio_stem", F.col("confidence").alias("seq_conf"))
    pairs = segments.anchor_pairs(seq).join(good, "audio_stem").join(placed.select("audio_stem", "session").distinct(), "audio_stem")
    pace = (F.col("word_end") - F.col("word_start") + 1) / (F.col("end") - F.col("start"))
    pairs = materialize(pairs.filter(pace.between(*segments.PACE)), "pairs")
    spans = pairs.select("audio_stem", "pos", "session", F.explode(F.sequence("word_start", "word_end")).alias("word_idx"))
    own = spans.join(transcript, ["session", "word_idx"]).groupBy("audio_stem", "pos").agg(F.sort_array(F.collect_list(F.struct("word_idx", "word"))).alias("own"))
    own = own.select("audio_stem", "pos", F.transform("own", lambda w: w["word"]).alias("own"))
    rebased = pairs.join(own, ["audio_stem", "pos"]).withColumns({"word_start": F.lit(0), "word_end": F.col("word_end") - F.col("word_start")})
    return segments.pair_segments(rebased, F.col("own"), F.col("seq_conf"))


def word_aligned(pairs: DataFrame, chunks: DataFrame, transcript: DataFrame) -> DataFrame:
    """Candidate segments by time warping: ``pairs`` has audio_stem, session, pair_id, start, end, word_start, word_end."""
    heard = scoring.words_in_range(pairs.select("audio_stem", "pair_id", "start", "end"), C.chunk_words(chunks))
    heard = heard.groupBy(F.col("l_pair_id").alias("pair_id")).agg(F.sort_array(F.collect_list(F.struct("r_start", "r_end", "r_word"))).alias("h"))
    heard = heard.select("pair_id", F.transform("h", lambda w: F.struct(w["r_word"].alias("word"), w["r_start"].alias("start"), w["r_end"].alias("end"))).alias("heard"))
    spans = pairs.select("pair_id", "session", F.explode(F.sequence("word_start", "word_end")).alias("word_idx"))
    written = spans.join(transcript, ["session", "word_idx"]).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("word_idx", "word"))).alias("w"))
    written = written.select("pair_id", F.transform("w", lambda w: w["word"]).alias("written"))
    return dtw.word_segments(pairs.join(heard, "pair_id").join(written, "pair_id"))


def dataset(segments_df: DataFrame, order: list[str], ids: list[str], audio: str = "audio_path", bridge: float = 0.6) -> DataFrame:
    """Tiered, filtered and split rows."""
    taken = tiers.assign(segments_df, order, bridge, audio=audio).filter("included")
    return splits.split_stratified(taken, ids)
