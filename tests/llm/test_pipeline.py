"""The pipeline and its stages against brute force, on odd rows and on an empty table."""

from __future__ import annotations

import itertools
import math
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from speechmart.llm import html_extract, language_id, near_dedup, queries

from .conftest import SCHEMA
from .test_models import brute_components
from .test_texts import SECRET, brute_spans, masked

PARTS = {"en": "the and tion ing er ha on re".split(), "de": "schen keit ung der ein zu pf lich".split(), "es": "cion mente ado que los ez rr ja".split()}
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SF_DIR = "/root/testdata/sf0.001"


def text(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 4))) for _ in range(n))


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def corpus():
    """Texts of three languages with exact and near copies, secrets, very long, empty and null ones."""
    rng, rows = random.Random(14), []
    for k in range(150):
        lang = list(PARTS)[k % 3]
        rows.append((lang, text(rng, lang, rng.randint(30, 160))))
    for k in range(25):
        lang, t = rows[k]
        rows.append((lang, t.upper() if k % 2 else t))
        w = t.split()
        w[len(w) // 2] = "changed" + str(k)
        rows.append((None if k % 5 == 0 else lang, " ".join(w)))
    rows += [("en", text(rng, "en", 40) + f' token = "abcdefgh{k}1234" and id ABCD1234EFGH5678 next to {SECRET} {text(rng, "en", 20)}') for k in range(6)]
    rows += [("en", None), ("de", ""), (None, "12 34 !!"), ("es", text(rng, "es", 9000)), ("de", text(rng, "de", 3000) + " <|endoftext|>")]
    out = [(k, t, lang, "s", len(t or ""), *[1] * 3, 0.5, 4, "x", 5) for k, (lang, t) in enumerate(rows)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


def test_run_equals_brute_force(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = defaultdict(list)
    windows = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    rows = {r[0]: r[1] for r in corpus()}
    left = {k: t for k, t in rows.items() if t and any(c.isalpha() for c in t)}
    assert len(left) == len(rows) - 3
    owner = {}
    for k, t in left.items():
        owner[fold(t)] = max(k, owner.get(fold(t), -1))
    left = {k: left[k] for k in owner.values()}
    root = brute_components(list(left.items()), percent=80)
    left = {k: t for k, t in left.items() if root[k][1] == k}
    left = {k: masked(t, brute_spans(t)) for k, t in left.items()}
    assert sum("[secret]" in t for t in left.values()) == 6
    assert got.keys() == left.keys()
    for k, t in left.items():
        ids = [*LIBRARY.encode(t, add_special_tokens=False).ids, 0]
        raw, at = np.array(ids, "<u4").tobytes(), 0
        for r in sorted(got[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids)
    for parts in windows.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 1024


def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    """All stages but the last keep the columns, among them some with names that operators use themselves."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, "")
        assert out.columns == odd_docs.columns, name
        assert out.count() <= odd_docs.count()
        assert stage(spark, no_docs, "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, "").count() == 0
    assert corpus_pipeline.mask_secrets(spark, odd_docs, "").count() == odd_docs.count()
    assert corpus_pipeline.drop_copies(spark, odd_docs, "").count() == len({fold(r["text"]) for r in odd_docs.collect()})
    # nothing is like another but 6, 7, 8 and 14; rows without words or id stay
    stay = sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, odd_docs, "").collect())
    assert stay == sorted(str(r["doc_id"]) for r in odd_docs.collect() if r["doc_id"] not in (7, 8, 14))
    pieces = corpus_pipeline.pack(spark, odd_docs, "").collect()
    assert sum(r["length"] for r in pieces) == sum(len(LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd_docs.collect())


def test_language_query_equals_exhaustive_decoding(docs):
    """Every row's language and score from a search over all codewords, in plain Python."""
    model = language_id.fit_model(language_id.sample_rows(docs, language_id.PER_LANGUAGE, "doc_id", "text", "lang"))
    assert model.languages == sorted(PARTS)
    right = total = 0
    for r, (k, t, lang) in zip(sorted(language_id.identify(docs).collect()), sorted((r["doc_id"], r["text"], r["lang"]) for r in docs.collect()), strict=True):
        assert r["doc_id"] == k and r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
        if not t or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        m = model.margins(t)
        loss = [sum(math.log1p(math.exp(-bit * x)) for bit, x in zip(code, m)) for code in model.code]
        best = min(range(3), key=lambda c: loss[c])
        p = 1 / sum(math.exp(loss[best] - x) for x in loss)
        assert r["lang_pred"] == model.languages[best] and r["score"] == pytest.approx(p)
        assert r["ambiguous"] == (p < language_id.AMBIGUOUS)
        if r["held_out"] and lang:
            right, total = right + (r["lang_pred"] == lang), total + 1
    assert total > 40 and right / total > 0.97


def test_many_languages_have_short_codewords():
    assert language_id.codewords(1000).shape == (1000, 120) and len({tuple(r) for r in language_id.codewords(1000)}) == 1000


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_page_query_equals_exhaustive_search(spark):
    """Pages with few blocks: the query keeps the blocks of the best of all label sequences."""
    model, seen = html_extract.trained(), 0
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in queries.op8_crf_extract(spark, SF_DIR).collect():
        blocks = html_extract.leaf_blocks(pages[r["page_id"]] or "")
        if not 0 < len(blocks) <= 13:
            continue
        seen += 1
        e = model.scores(html_extract.block_features(blocks))
        value = lambda p: sum(e[k, s] for k, s in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
        assert r["text"] == "\n".join(b[0] for b, s in zip(blocks, best, strict=True) if s)
    assert seen >= 10


def test_near_copies_of_the_stage_at_its_similarity(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k, cut in enumerate((24, 28, 29, 30, 34), 1):
        other = list(base)
        other[100 : 100 + cut] = [f"n{k}x{j}" for j in range(cut)]
        rows.append((k, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, (_, c) in brute_components(rows, percent=80).items() if c == i}
    assert {r["doc_id"] for r in near_dedup.keep_representatives(df, percent=80).collect()} == want
