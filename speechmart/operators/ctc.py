"""Labels of frames: forced alignment of a known text, and frame labels to words with window functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmart.functions.text import acoustic_text, words
from speechmart.operators.ranking import spread

#: Cells whose back pointers are held at once; longer tables are cut in time.
TABLE_CELLS = 1 << 22
#: States of a clip that are held at once where clips are solved side by side, and the frames of those clips.
WINDOW, FRAMES_AT_ONCE = 64, 1 << 17


def _advance(alpha: np.ndarray, line: np.ndarray, ids: np.ndarray, jump: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The next frame's scores of the states lo..hi, and how many states each came forward; of equals the fewest."""
    stay = alpha[lo:hi]
    one, two = np.full(hi - lo, -np.inf), np.full(hi - lo, -np.inf)
    one[max(0, 1 - lo) :] = alpha[max(lo, 1) - 1 : hi - 1]
    two[max(0, 2 - lo) :] = alpha[max(lo, 2) - 2 : max(hi - 2, 0)]
    two[~jump[lo:hi]] = -np.inf
    best, step = stay.copy(), np.zeros(hi - lo, np.int8)
    for n, other in ((1, one), (2, two)):
        more = other > best
        best[more], step[more] = other[more], n
    return best + line[ids[lo:hi]], step


def viterbi_states(emissions: np.ndarray, ids: np.ndarray, cells: int = TABLE_CELLS) -> np.ndarray | None:
    """The state of every frame on the best path through blank-interleaved label ids, or None if none fits.

    A frame stays in its state or goes on by one; it may skip the blank between two different labels. Of
    equal ways the shortest step counts, and of equal ends the last label. Only states that can be reached
    and can still reach the end are computed. Where the back pointers of all frames would take more than
    ``cells`` bytes, they are not kept: every state passes on the state that its path had in the middle
    frame, and both halves are then solved between known states. So memory grows with frames and labels,
    not with their product, at twice the work.
    """
    frames, states = len(emissions), len(ids)
    jump = np.zeros(states, bool)
    jump[3::2] = ids[3::2] != ids[1:-2:2]
    out = np.zeros(frames, np.int64)
    start = np.full(states, -np.inf)
    start[:2] = emissions[0, ids[:2]]
    work = [(0, frames - 1, 0, states - 1, start, 1, 1)]  # it may begin in either of two states and end in either of two
    while work:
        t0, t1, first, last, begin, spread, free = work.pop()
        middle = (t0 + t1) // 2 if (t1 - t0) * (last - first + 1) > cells and t1 - t0 > 1 else None
        alpha, back, via, kept = begin, [], np.arange(states), begin
        for t in range(t0 + 1, t1 + 1):
            lo, hi = max(first, last - free - 2 * (t1 - t)), min(last, first + spread + 2 * (t - t0)) + 1
            if lo >= hi:
                return None
            best, step = _advance(alpha, emissions[t], ids, jump, lo, hi)
            alpha = np.full(states, -np.inf)
            alpha[lo:hi] = best
            if middle is None:
                back.append((lo, step))
            elif t == middle:
                kept, via = alpha, np.arange(states)
            elif t > middle:
                then = via.copy()
                then[lo:hi] = via[np.arange(lo, hi) - step]
                via = then
        end = last - 1 if free and last and not alpha[last] > alpha[last - 1] else last
        if not alpha[end] > -np.inf:
            return None
        if middle is not None:
            between = int(via[end])
            point = np.full(states, -np.inf)
            point[between] = kept[between]
            work += [(middle, t1, between, end, point, 0, 0), (t0, middle, first, between, begin, spread, 0)]
            continue
        for t in range(t1, t0 - 1, -1):
            out[t] = end
            if t > t0:
                lo, step = back[t - t0 - 1]
                end -= int(step[end - lo])
    return out


def windowed_states(clips: list[tuple[np.ndarray, np.ndarray]], window: int = WINDOW) -> list[np.ndarray | None]:
    """As ``viterbi_states`` for many clips (emissions, ids) side by side, or None where the path is not proven.

    A clip's states are held in a window that moves on with its best one. A path that leaves the window is
    at some frame in a state that is let go, where it scores no more than that state and the greatest
    log-probability of every later frame. If all those bounds lie below the path found, no best path has
    left the window, and the path is the one of the whole table, ties included.
    """
    order = sorted(range(len(clips)), key=lambda k: -len(clips[k][0]))
    count, kinds = len(order), max(clips[k][0].shape[1] for k in order)
    frames, states = np.array([len(clips[k][0]) for k in order]), np.array([len(clips[k][1]) for k in order])
    base = np.cumsum(frames) - frames
    lines = np.full((int(frames.sum()), kinds + 1), -np.inf)
    later = np.zeros(len(lines))
    wide = int(states.max()) + window + 4
    ids, jump = np.full((count, wide), kinds), np.full((count, wide), -np.inf)
    for n, k in enumerate(order):
        emissions, own = clips[k]
        part = slice(base[n], base[n] + frames[n])
        lines[part, : emissions.shape[1]] = emissions
        best = emissions.max(axis=1)
        later[part] = np.cumsum(best[::-1])[::-1] - best
        ids[n, : len(own)] = own
        jump[n, 3 : len(own) : 2][own[3::2] != own[1:-2:2]] = 0.0
    flat, flat_ids, flat_jump = lines.reshape(-1), ids.reshape(-1), jump.reshape(-1)
    columns, middle, rows = np.arange(window + 2), window // 2, np.arange(count)
    held = np.full((count, window + 4), -np.inf)  # the window between two states on both sides
    held[:, 2:4] = flat[base[:, None] * (kinds + 1) + ids[:, :2]]
    first, lost = np.zeros(count, np.int64), np.full(count, -np.inf)
    steps, firsts = [np.zeros((count, window), np.int8)], [first.copy()]
    for t in range(1, int(frames[0])):
        k = int(np.searchsorted(-frames, -t, "left"))
        at = (rows[:k] * wide + first[:k])[:, None] + columns
        stay, one, two = held[:k, 2:], held[:k, 1:-1], held[:k, :-2] + flat_jump[at]
        by_one = one > stay
        best = np.where(by_one, one, stay)
        by_two = two > best
        best = np.where(by_two, two, best) + flat[((base[:k] + t) * (kinds + 1))[:, None] + flat_ids[at]]
        dead = states[:k] - 2 - 2 * (frames[:k] - 1 - t) - first[:k]
        if (dead > 0).any():
            best[columns < dead[:, None]] = -np.inf
        shift = np.clip(best.argmax(axis=1) - middle, 0, 2)
        gone = np.where(shift == 0, np.maximum(best[:, window], best[:, window + 1]), np.where(shift == 1, np.maximum(best[:, 0], best[:, window + 1]), np.maximum(best[:, 0], best[:, 1])))
        lost[:k] = np.maximum(lost[:k], gone + later[base[:k] + t])
        kept = shift[:, None] + columns[:window]
        held[:k, 2:-2] = np.take_along_axis(best, kept, axis=1)
        first[:k] += shift
        steps.append(np.take_along_axis(np.where(by_two, 2, by_one).astype(np.int8), kept, axis=1))
        firsts.append(first[:k].copy())
    padded = np.concatenate([held[:, 2:-2], np.full((count, 1), -np.inf)], axis=1)
    score = lambda s: padded[rows, np.where((s >= first) & (s < first + window), s - first, window)]
    last, before = score(states - 1), np.where(states > 1, score(states - 2), -np.inf)
    state = np.where((states > 1) & ~(last > before), states - 2, states - 1)
    found = np.maximum(last, before)
    proven = np.isfinite(found) & (lost < found - 1e-6 - 1e-9 * np.abs(found))
    state = np.clip(state, first, first + window - 1)  # those out of the window are not proven
    path = np.zeros(len(lines), np.int64)
    for t in range(int(frames[0]) - 1, -1, -1):
        k = len(firsts[t])
        path[base[:k] + t] = state[:k]
        if t:
            state[:k] -= steps[t][rows[:k], np.clip(state[:k] - firsts[t], 0, window - 1)]
    out: list[np.ndarray | None] = [None] * count
    for n, k in enumerate(order):
        if proven[n]:
            out[k] = path[base[n] : base[n] + frames[n]]
    return out


def _interleaved(labels: list[int], blank: int) -> np.ndarray:
    ids = np.full(2 * len(labels) + 1, blank)
    ids[1::2] = labels
    return ids


def forced_clips(clips: list[tuple[np.ndarray, list[int]]], blank: int = 0) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """``forced_frames`` of many clips (emissions, labels): side by side in narrow windows, and whole where that proves nothing."""
    ids = [_interleaved(labels, blank) for _, labels in clips]
    paths: list[np.ndarray | None] = [None] * len(clips)
    for window in (WINDOW, 4 * WINDOW):
        open_ = [k for k, (lines, _) in enumerate(clips) if paths[k] is None and len(lines)]
        if open_:
            for k, path in zip(open_, windowed_states([(clips[k][0], ids[k]) for k in open_], window), strict=True):
                paths[k] = path
    out = []
    for (lines, labels), own, path in zip(clips, ids, paths, strict=True):
        out.append(forced_frames(lines, labels, blank) if path is None else (own[path], lines[np.arange(len(lines)), own[path]]))
    return out


def forced_frames(emissions: np.ndarray, labels: list[int], blank: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
    """The label of every frame and its log-probability, for log-probabilities (frames, labels); None if the labels do not fit."""
    if not len(emissions):
        return None
    ids = _interleaved(labels, blank)
    path = viterbi_states(emissions, ids)
    if path is None:
        return None
    return ids[path], emissions[np.arange(len(emissions)), ids[path]]


def label_ids(text: Column, known: dict[str, int], separator: str = "|") -> Column:
    """Ids of the letters of the acoustic form of a text, spaces as separators; unknown letters are left out."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    spaced = F.translate(F.trim(F.regexp_replace(acoustic_text(text), r"(?U)\s+", " ")), " ", separator)
    return F.filter(F.transform(F.split(spaced, ""), lambda c: F.try_element_at(table, c)), lambda i: i.isNotNull())


def forced_align(
    clips: DataFrame,
    make_emitter: Callable[[], Callable[[list[np.ndarray]], list[np.ndarray]]],
    key: str = "audio_path",
    samples: str = "samples",
    labels: str = "labels",
    blank: int = 0,
    least_labels: int = 3,
    at_once: int = 8,
) -> DataFrame:
    """key, frame, label, score of every clip, its known labels laid on its frames.

    The model, made once per task, turns waveforms into log-probabilities (frames, labels), which never
    leave the task. Clips with fewer than ``least_labels`` labels, or with more than fit their frames, give
    no rows, nor do clips without samples or labels.
    """
    kind = clips.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        emit = make_emitter()
        for pdf in batches:
            for at in range(0, len(pdf), at_once):
                part = pdf.iloc[at : at + at_once]
                out = []
                for k, known, lines in zip(part[key], part[labels], emit([np.asarray(x, np.float32) for x in part[samples]]), strict=True):
                    found = forced_frames(np.asarray(lines, np.float64), list(known), blank)
                    if found is not None:
                        out.append(pd.DataFrame({key: k, "frame": np.arange(len(found[0])), "label": found[0], "score": found[1]}))
                if out:
                    yield pd.concat(out)

    need = clips.select(key, samples, labels).filter(F.col(samples).isNotNull() & (F.size(labels) >= least_labels))
    return need.mapInPandas(run, f"`{key}` {kind}, frame int, label int, score double")


def align_words(
    clips: DataFrame,
    make_emitter: Callable[[], Callable[[list[np.ndarray]], list[np.ndarray]]],
    separator_id: int,
    key: str = "audio_path",
    samples: str = "samples",
    labels: str = "labels",
    text: str = "text",
    rate: float = 50.0,
    blank: int = 0,
    least_labels: int = 3,
    at_once: int = 8,
) -> DataFrame:
    """``forced_words`` of ``forced_align`` without a row for every frame: key, word_idx, word, start, end, score.

    Frames stay in the task that aligns them. Clips are aligned side by side, ``FRAMES_AT_ONCE`` frames
    together, or one by one if they are longer.
    """
    kind = clips.schema[key].dataType.simpleString()

    def spans(k: object, named: list[str], found: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        label, score = found
        kept = np.flatnonzero(label != separator_id)
        part = np.cumsum(label == separator_id)[kept]
        a = np.flatnonzero(np.diff(part, prepend=-1)) if len(kept) else kept
        b = np.append(a[1:], len(kept))[: len(a)]
        n = min(len(a), len(named))
        mean = np.add.reduceat(score[kept], a) / (b - a) if len(a) else np.zeros(0)
        return pd.DataFrame({key: k, "word_idx": np.arange(n), "word": named[:n], "start": kept[a[:n]] / rate, "end": (kept[b[:n] - 1] + 1) / rate, "score": mean[:n]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        emit = make_emitter()

        def solved(held: list[tuple]) -> Iterator[pd.DataFrame]:
            found = forced_clips([(lines, known) for _, _, known, lines in held], blank)
            out = [spans(k, named, f) for (k, named, _, _), f in zip(held, found, strict=True) if f is not None]
            if out:
                yield pd.concat(out)

        held, frames = [], 0
        for pdf in batches:
            for at in range(0, len(pdf), at_once):
                part = pdf.iloc[at : at + at_once]
                for k, named, known, lines in zip(part[key], part["_named"], part[labels], emit([np.asarray(x, np.float32) for x in part[samples]]), strict=True):
                    held.append((k, list(named), list(known), np.asarray(lines, np.float64)))
                    frames += len(lines)
                    if frames >= FRAMES_AT_ONCE:
                        yield from solved(held)
                        held, frames = [], 0
        if held:
            yield from solved(held)

    need = clips.filter(F.col(samples).isNotNull() & (F.size(labels) >= least_labels) & F.col(text).isNotNull())
    need = spread(need.select(key, samples, labels, words(F.lower(text)).alias("_named")), key)
    return need.mapInPandas(run, f"`{key}` {kind}, word_idx int, word string, start double, end double, score double")


def forced_words(frames: DataFrame, clips: DataFrame, separator_id: int, key: str = "audio_path", text: str = "text", rate: float = 50.0) -> DataFrame:
    """key, word_idx, word, start, end, score: aligned frames grouped at separators, with the words of the clips' texts."""
    spans = aligned_words(frames.select(key, "frame", F.col("label").cast("string").alias("token"), "score"), key, str(separator_id), rate)
    named = clips.select(key, F.posexplode(words(F.lower(text))).alias("word_idx", "word"))
    return spans.join(named, [key, "word_idx"]).select(key, "word_idx", "word", "start", "end", "score")


def collapse_frames(frames: DataFrame, key: str = "audio_stem", blank: str = "<pad>", separator: str = "|", special: tuple[str, ...] = ("<s>", "</s>", "<unk>"), frame: float = 0.02) -> DataFrame:
    """Words of greedily decoded frames (key, frame, token): key, word_idx, word, start, end.

    A token counts where it differs from the frame before; blanks in between let it count again.
    ``separator`` closes a word, and a word ends with the frame of its last new character.
    """
    along = Window.partitionBy(key).orderBy("frame")
    new = F.lag("token").over(along).isNull() | (F.lag("token").over(along) != F.col("token"))
    closed = F.sum(F.when(F.col("token") == separator, 1).otherwise(0)).over(along)
    kept = frames.withColumn("new", new).withColumn("part", closed)
    kept = kept.filter(F.col("new") & ~F.col("token").isin(blank, separator, *special))
    g = kept.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct("frame", "token"))).alias("cs"), F.min("frame").alias("a"), F.max("frame").alias("b"))
    idx = F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1
    return g.select(
        key,
        idx.alias("word_idx"),
        F.array_join(F.transform("cs", lambda c: c["token"]), "").alias("word"),
        F.bround(F.col("a") * frame, 3).alias("start"),
        F.bround(F.col("b") * frame, 3).alias("end"),
    )


def aligned_words(frames: DataFrame, key: str = "audio_path", separator: str = "|", rate: float = 50.0) -> DataFrame:
    """Words of forced-aligned frames (key, frame, token, score): all frames between separators, mean score."""
    along = Window.partitionBy(key).orderBy("frame")
    parts = frames.withColumn("part", F.sum(F.when(F.col("token") == separator, 1).otherwise(0)).over(along)).filter(F.col("token") != separator)
    g = parts.groupBy(key, "part").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.avg("score").alias("score"))
    idx = F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1
    return g.select(key, idx.alias("word_idx"), (F.col("a") / rate).alias("start"), ((F.col("b") + 1) / rate).alias("end"), "score")


def mean_confidence(chunks: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Mean of each frame's highest probability, from arrays of them."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda s, x: s + x)
    return chunks.withColumn("confidence", F.try_divide(total, F.size(probabilities)))
