"""Language identification by error-correcting output codes.

Every language has a codeword. One binary n-gram classifier per bit predicts that bit, and the
language whose codeword has the least summed logistic loss against the bits' margins is chosen; a
small lead over the runner-up is flagged as ambiguous. Classifiers see hashed letter 1- to 3-grams of
the whole lower-cased text, by relative frequency.

Fitting reads a bounded sample of labelled rows: about ``per_language`` rows of each language, and
``SAMPLE_ROWS`` rows of all languages together, chosen by a hash of the id. Everything else covers all
rows and whole texts. A column with very many languages has codewords of a length that grows with the
logarithm of their number.

Texts that are null, empty or without letters are ``und`` with score 0; with no labelled rows every
text is ``und``. Rows without an id or a language do not take part in fitting but are predicted.
Repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, slices

BUCKETS = 1 << 15
PER_LANGUAGE = 600
SAMPLE_ROWS = 20_000
#: Bytes of n-gram frequencies that the driver fits on at most; beyond that fewer labelled rows are taken, never shorter texts.
SAMPLE_BYTES = 128 << 20
#: Up to so many languages each has a bit of its own besides the random ones.
OWN_BITS = 64
AMBIGUOUS = 0.6
UNKNOWN = "und"
_BLOCK = 1 << 16


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting: crc32 of the id's decimals leaves 1 by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_blocks(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, block by block; runs of other characters count as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    a = np.where(letter, codes, 0)[keep].astype(np.uint64)
    a = np.concatenate([np.zeros(1, np.uint64), a])
    for n in (1, 2, 3):
        for at in range(0, len(a) - n + 1, _BLOCK):
            part = a[at : at + _BLOCK + n - 1]
            if len(part) < n:
                break
            h = np.full(len(part) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ part[k : len(part) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def codewords(n_classes: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 per class: all two-way partitions for few classes, else random ones."""
    if n_classes < 2:
        return np.ones((n_classes, 1))
    if n_classes <= 6:
        bits = [[1 if b >> k & 1 else -1 for k in range(n_classes)] for b in range(1, 1 << (n_classes - 1))]
        return np.array(bits, dtype=float).T
    rng = np.random.default_rng(seed)
    n = 12 * int(np.ceil(np.log2(n_classes)))
    own = 2 * np.eye(n_classes) - 1 if n_classes <= OWN_BITS else np.ones((n_classes, 0))
    return np.concatenate([own, rng.choice([-1.0, 1.0], size=(n_classes, n))], axis=1)


class EcocModel:
    """Languages, their codewords and the weights of the bits' classifiers."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.languages, self.code = languages, code
        self.weights, self.bias = weights.astype(np.float32), bias

    def margins(self, text: str) -> np.ndarray | None:
        """One margin per bit; none for a text without letters."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for h in ngram_blocks(text):
            total += self.weights[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / n + self.bias if n else None

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the decision is ambiguous."""
        m = self.margins(text) if self.languages else None
        if m is None:
            return UNKNOWN, 0.0, True
        loss = np.logaddexp(0, -self.code * m).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmin(loss))
        return self.languages[best], float(p[best]), bool(p[best] < AMBIGUOUS)


def fit_model(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 40.0) -> EcocModel:
    """Fits all bits' logistic classifiers by AdaGrad over (language, n-gram ids, frequencies)."""
    languages = sorted({r[0] for r in rows})
    code = codewords(len(languages))
    weights, bias = np.zeros((BUCKETS, code.shape[1])), np.zeros(code.shape[1])
    if len(languages) < 2:
        return EcocModel(languages, code, weights, bias)
    place = {x: k for k, x in enumerate(languages)}
    seen, rng = np.full_like(weights, 1e-6), np.random.default_rng(1)
    share = np.array([sum(r[0] == x for r in rows) for x in languages], dtype=float)
    balance = share.sum() / (len(languages) * share)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            language, at, freq = rows[k]
            bits = code[place[language]]
            m = freq @ weights[at] + bias
            g = -bits / (1 + np.exp(bits * m)) * balance[place[language]]
            step = freq[:, None] * g
            seen[at] += step * step
            weights[at] -= rate / 40 * step / np.sqrt(seen[at])
            bias -= 0.01 * g
    return EcocModel(languages, code, weights, bias)


def sample_rows(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """N-gram frequencies of about ``per_language`` labelled rows of each language, in ``most_bytes`` at most.

    Rows of equal language and n-grams, as of copies, count once, so that a hash of them can thin out the
    rest to the room there is.
    """
    train = pick(docs, [id_col, text_col, lang_col]).toDF("i", "t", "l").filter(F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    counts = materialize(train.groupBy("l").agg(F.count("*").alias("n")), "language-counts")
    each = min(per_language, SAMPLE_ROWS / max(1, counts.count()))
    scale = 1 << 30
    limit = (F.least(F.lit(1.0), F.lit(each) / F.col("n")) * scale).cast("long") + 1
    chosen = train.join(counts.select("l", limit.alias("limit")), "l").filter(F.pmod(F.xxhash64("i"), F.lit(scale)) < F.col("limit"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            langs, ids, freqs = [], [], []
            for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count = np.zeros(BUCKETS)
                for h in ngram_blocks(text):
                    count += np.bincount(h, minlength=BUCKETS)
                at = np.flatnonzero(count)
                if len(at):
                    langs.append(language)
                    ids.append(at.astype("<i4").tobytes())
                    freqs.append((count[at] / count.sum()).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.binary()), pa.array(freqs, pa.binary())], names=["l", "ids", "freqs"])

    found = chosen.select("t", "l").mapInArrow(features, "l string, ids binary, freqs binary").withColumn("h", F.xxhash64("l", "ids", "freqs"))
    found = materialize(found, "language-features").dropDuplicates(["l", "ids", "freqs"])
    size = F.octet_length("ids") + F.octet_length("freqs")
    total = found.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total > most_bytes:
        # half of the room on average, and the least hashes as far as the room goes
        least = F.pmod(F.col("h"), F.lit(scale)) < int(0.5 * most_bytes / total * scale) + 1
        found = found.filter(least & (size <= most_bytes // 2))
    got, room = [], most_bytes
    for r in found.select("l", "ids", "freqs").orderBy("h").toLocalIterator():
        room -= len(r["ids"]) + len(r["freqs"])
        if room < 0:
            break
        got.append(r)
    rows = [(r["l"], np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["freqs"], "<f4").astype(float)) for r in got]
    return sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, ambiguous."""
    scored = score_rows(docs, per_language, id_col, text_col, lang_col, [id_col, text_col])
    named = [F.col(f"_ecoc_{c}").alias(c) for c in ("lang_pred", "score", "ambiguous")]
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), *named)


def keep_identified(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language: not ``und``, and one language likelier than all others together.

    Null, empty and letterless texts go; null ids and languages do not matter; repeated rows share their
    fate; an empty table, or one without labelled rows, gives an empty one. All columns are passed on.
    """
    scored = score_rows(docs, per_language, id_col, text_col, lang_col, docs.columns)
    return scored.filter((F.col("_ecoc_lang_pred") != UNKNOWN) & (F.col("_ecoc_score") >= least_score)).select(*[F.col(f"`{c}`") for c in docs.columns])


def score_rows(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str, columns: list[str]) -> DataFrame:
    """The named columns (the text among them) of every row, with _ecoc_lang_pred, _ecoc_score and _ecoc_ambiguous."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit_model(sample_rows(docs, per_language, id_col, text_col, lang_col)))
    d = pick(docs, columns)
    at = columns.index(text_col)
    added = ["_ecoc_lang_pred", "_ecoc_score", "_ecoc_ambiguous"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [model.value.predict(t or "") for t in batch.column(at).to_pylist()]
            extra = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*columns, *added])

    fields = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in columns)
    return d.mapInArrow(predict, f"{fields}, {added[0]} string, {added[1]} double, {added[2]} boolean")
