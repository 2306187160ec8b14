from __future__ import annotations

import random
import re
import time
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from speechmart.llm import html_extract, language_id, near_dedup

from .conftest import prose


def test_language_codes_and_rejects(spark):
    parts = {"aa": "the and tion ing er ha on re".split(), "bb": "schen keit ung der ein zu pf lich".split(), "cc": "cion mente ado que los ez rr ja".split()}
    rng = random.Random(2)

    def text(lang, n):
        return " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(n))

    rows = [(k, text(lang, rng.randint(3, 80)), lang) for k, lang in enumerate(list(parts) * 60)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !!", "bb"), (None, text("cc", 30), None)]
    df = spark.createDataFrame([(*r, 0.1, True) for r in rows], "doc_id long, text string, lang string, score double, ambiguous boolean")
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    held = [got[k] for k, _, _ in rows[:180] if got[k]["held_out"]]
    truth = {k: lang for k, _, lang in rows}
    assert len(held) > 30 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1000, 1001, 1002)) and got[None]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 181


def test_language_without_rows_or_labels(spark, no_docs, odd_docs):
    assert language_id.identify(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_labelled_sample_stays_in_its_room(spark):
    texts = [(k, " ".join(f"{chr(97 + (k * i) % 26)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)), "ab"[k % 2]) for k in range(300)]
    df = spark.createDataFrame(texts + [(3, texts[3][1], "b")] * 500, "doc_id long, text string, lang string")
    whole = language_id.sample_rows(df, 600, "doc_id", "text", "lang")
    size = lambda rows: sum(4 * len(r[1]) + 4 * len(r[2]) for r in rows)
    assert len({(r[0], r[1].tobytes(), r[2].tobytes()) for r in whole}) == len(whole) > 10
    few = language_id.sample_rows(df, 600, "doc_id", "text", "lang", most_bytes=size(whole) // 5)
    assert 0 < len(few) < len(whole) and size(few) <= size(whole) // 5 and {r[0] for r in few} == {"a", "b"}


def test_kept_rows_may_have_any_column(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, "other", 9)], "doc_id long, text string, _gone int")
    assert {r["doc_id"] for r in near_dedup.keep_representatives(df).collect()} == {1, 3}


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 40):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code}) == n


def brute_components(rows, percent=85):
    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rng, rows = random.Random(7), []
    for family in range(12):
        base = prose(100 + family, rng.randint(30, 200)).split()
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = f"edit{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b c"), (1004, "A b\tc"), (1005, "a b c d e"), (1006, "a b c d")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, bands string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    want = brute_components(rows)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    kept = near_dedup.keep_representatives(df)
    assert kept.columns == df.columns and kept.count() == sum(c == i for i, (_, c) in want.items())


def test_links_between_clusters_of_one_bucket(spark):
    base = prose(55, 300).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 9):  # a chain: each text is near the one before, the ends are not near each other
        base = list(base)
        base[k * 30 : k * 30 + 4] = [f"new{k}{j}" for j in range(4)]
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(df).collect()} == {0}


def test_pipeline_stage_links_from_four_fifths_on(spark):
    base = prose(77, 300).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 9):  # neighbours are at 0.82, the ends far apart
        base = list(base)
        base[k * 30 : k * 30 + 25] = [f"new{k}{j}" for j in range(25)]
        rows.append((k, " ".join(base)))
    sets = [set(near_dedup.shingle_set(t).tolist()) for _, t in rows]
    assert all(0.8 <= len(a & b) / len(a | b) < 0.83 for a, b in zip(sets, sets[1:], strict=False))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()] == [0]


def test_limits_follow_from_the_similarity():
    assert (near_dedup.max_xor(85), near_dedup.max_fine_xor(85)) == (72, 400)
    rng, ones = np.random.default_rng(4), []
    for _ in range(40):
        one = rng.integers(0, 1 << 62, 900, dtype=np.uint64)
        two = np.concatenate([one[100:], rng.integers(0, 1 << 62, 100, dtype=np.uint64)])  # 800 of 1000
        low = [near_dedup.samples(s, 0, near_dedup.SAMPLES + near_dedup.FINE_SAMPLES) for s in (one, two)]
        fine = [near_dedup.odd_sketch(x[near_dedup.SAMPLES :], near_dedup.FINE_BITS) for x in low]
        coarse = [near_dedup.odd_sketch(x[: near_dedup.SAMPLES]) for x in low]
        ones.append([sum(int(v).bit_count() for v in (x[0] ^ x[1]).view(np.uint64)) for x in (coarse, fine)])
    assert max(x for _, x in ones) > near_dedup.MAX_FINE_XOR
    assert all(c <= near_dedup.max_xor(80) and f <= near_dedup.max_fine_xor(80) for c, f in ones)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = near_dedup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[14]["component_id"] == 6 and by[7]["component_id"] == 6 and by[1]["kept"] and by[1]["n_shingles"] == 0
    assert by[None]["component_id"] is None and near_dedup.near_duplicates(no_docs).count() == 0


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (105, 101), (200, 150)]
    got = {r["id"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[105] == got[101] == 100 and got[200] == 150


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    one = np.unique(rng.integers(0, 1 << 62, 1000, dtype=np.uint64))
    for share in (0.95, 0.9, 0.85):
        new = int(1000 * (1 - share) / (1 + share))
        two = np.unique(np.concatenate([one[new:], rng.integers(0, 1 << 62, new, dtype=np.uint64)]))
        fine = [near_dedup.odd_sketch(near_dedup.samples(s, near_dedup.SAMPLES, near_dedup.FINE_SAMPLES), near_dedup.FINE_BITS) for s in (one, two)]
        ones = sum(int(x).bit_count() for x in (fine[0] ^ fine[1]).view(np.uint64))
        assert ones <= near_dedup.MAX_FINE_XOR
        coarse = [near_dedup.odd_sketch(near_dedup.samples(s)) for s in (one, two)]
        x = sum(int(v).bit_count() for v in (coarse[0] ^ coarse[1]).view(np.uint64))
        assert x <= near_dedup.MAX_XOR and abs(near_dedup.similarity(x) - share) < 0.15


def test_pages_held_out_accuracy():
    model, wrong, total = html_extract.trained(), 0, 0
    for blocks, labels in html_extract.labelled_pages(150, seed=77):
        states = model.decode(html_extract.block_features(blocks))
        wrong += sum(a != b for a, b in zip(states, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.03


def test_pages_with_odd_markup(spark):
    model = html_extract.trained()
    page = "<html><head><title>T</title><script>var x='<p>no</p>'</script></head><BODY><nav><ul><li><a href=/a>Home</a></ul></nav><article><h1>One &amp; two</h1><p>First\n  line <b>bold<br><p>Second&nbsp;para &lt;x&gt;.<!-- no --><p>Third one here.</article><footer>&copy; me</footer><div class=ad>Buy"
    assert html_extract.main_text(page, model) == "One & two\nFirst line bold\nSecond para <x>.\nThird one here."
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p"), (5, "u", "<<<>>>"), (1, "u", page)]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract_pages(df).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got) and [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_viterbi_is_the_best_path():
    model, rng = html_extract.Crf(), np.random.default_rng(1)
    model.index, model.emit, model.step = {f"f{k}": k for k in range(5)}, rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    features = [[f"f{rng.integers(5)}"] for _ in range(7)]
    e = model.scores(features)

    def score(p):
        return sum(e[k, s] for k, s in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:]))

    paths = defaultdict(list)
    for code in range(1 << 7):
        p = [code >> k & 1 for k in range(7)]
        paths[score(p)].append(p)
    assert model.decode(features) in paths[max(paths)]


def loose_family(seed, n, words, most_edits):
    """Texts of one origin with a few words changed each, so pairs lie around the least similarity."""
    rng, base = random.Random(seed), prose(seed, words).split()
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(words), rng.randint(0, most_edits)):
            w[at] = f"edit{rng.randint(0, 10**9)}"
        yield " ".join(w)


def test_loose_families_equal_brute_force(spark, monkeypatch):
    """Several hundred texts at 0.7 to 0.95, in blocks small enough that buckets need many cells."""
    monkeypatch.setattr(near_dedup, "BLOCK_LEAST", 40)
    texts = [*loose_family(31, 260, 220, 4), *loose_family(32, 120, 150, 4), *loose_family(33, 60, 400, 9)]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) > 20 and got == want


def test_rows_of_a_loose_family_stay_linear(spark):
    """What both visits of the cells send on grows with the members and not with their pairs."""
    sent = []
    for n in (100, 200):
        df = spark.createDataFrame(list(enumerate(loose_family(41, n, 220, 9))), "doc_id long, text string")
        rows = near_dedup.signatures(df, "doc_id", "text").withColumnsRenamed({"doc_id": "rep", "n_shingles": "n"})
        members = rows.select("rep", "n", F.explode("bands").alias("key"))
        cells = near_dedup._open_cells(members, spark.createDataFrame([], "id long, root long"))
        sent.append(cells.count())
    assert sent[1] < 2.6 * sent[0]


def test_recall_near_the_least_similarity(spark):
    """Planted pairs at 0.85 to 0.87: at least 999 of 1000 are linked."""
    rng, rows, planted = random.Random(12), [], 0
    while planted < 2000:
        base = [f"w{rng.randrange(10**9)}" for _ in range(240)]
        two, cut = list(base), rng.randint(13, 15)
        two[100 : 100 + cut] = [f"x{rng.randrange(10**9)}" for _ in range(cut)]
        same, all_ = 236 - (cut + 4), 236 + cut + 4
        if 85 <= 100 * same / all_ <= 87:
            rows += [(2 * planted, " ".join(base)), (2 * planted + 1, " ".join(two))]
            planted += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    linked = near_dedup.near_duplicates(df).filter("not kept").count()
    assert linked >= 0.999 * planted


HOSTILE = {
    "quotes": "<a " * 330_000 + '"',
    "deep": "<div>x" * 170_000,
    "unmatched ends": "<div>" * 100_000 + "</span>x" * 60_000,
    "starts under inline": "<p><body>" + "<span>" * 80_000 + "<h1>x</h1>" * 50_000,
    "deep names": "".join(f"<div class={chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}>x" for i in range(50_000)),
    "open quotes": '<p title="' * 90_000,
    "brackets": "<" * 1_000_000,
    "comments": "<!-" * 300_000,
    "entities": "&#" * 400_000,
}


def test_hostile_pages_take_linear_time():
    model = html_extract.trained()
    for name, page in HOSTILE.items():
        began = time.process_time()
        html_extract.main_text(page, model)
        assert time.process_time() - began < 5, name


def test_nothing_but_markup_and_scripts_is_dropped():
    model = html_extract.trained()
    cases = {
        '<article><p>One.</p><script src="a.js"/>var a=1;</script><p>Two.</p></article>': "One.\nTwo.",
        "<article><p>Area is <math><mi>x</mi></math> metres.</p></article>": "Area is x metres.",
        "<article><p>Shown <object>instead</object> and <canvas>drawn</canvas> here.</p></article>": "Shown instead and drawn here.",
        "<article><p title=it's>I don't know <b>it's</b> so.</p><p>Next one.</p></article>": "I don't know it's so.\nNext one.",
        '<article><p data-x="a > b">Quoted bracket.</p></article>': "Quoted bracket.",
    }
    for page, want in cases.items():
        assert html_extract.main_text(page, model) == want


#: Pages of layouts that the generator does not make, each text block labelled by hand (* for the article).
LAYOUTS = [
    '<body><div id="top"><a href=/>Daily Courier</a></div><table><tr><td><ul class="nav"><li><a href=1>News</a><li><a href=2>Sport</a></ul></td><td><div class="story"><h1>*River rises after storm</h1><p>*The river rose by two metres during the night, officials said.</p><p>*Several roads were closed in the morning.</p></div></td></tr></table><div class="footer">&copy; Daily Courier</div></body>',
    '<body><header><h2>My blog</h2><nav><a href=/a>About</a> <a href=/c>Contact</a></nav></header><main><article><h2>*On making bread</h2><p>*Flour, water and salt are all that is needed for a loaf.</p><ol><li>*Mix the flour with water.</li><li>*Wait until the dough has doubled.</li></ol><p>*Bake it in a hot oven for forty minutes.</p></article><section id="comments"><h3>2 comments</h3><div class="comment"><p>Great recipe, thanks a lot!</p></div><div class="comment"><p>Mine fell flat.</p></div></section></main><footer><p>All rights reserved</p></footer></body>',
    '<body><div class="cookie-banner"><p>We use cookies to make this site better.</p><button>Accept</button></div><div class="wrapper"><div class="sidebar"><h3>Related</h3><ul><li><a href=x>Another story</a></li></ul></div><div class="entry-content"><h1>*A short history of clocks</h1><p>*Water clocks were used long before gears were cut.</p><blockquote>*Time is what a clock reads.</blockquote><p>*Pendulums came much later.</p></div></div><form><label>Search</label><input></form></body>',
    '<html><head><title>Garden notes</title><style>p{}</style></head><body><nav><ul><li><a href=1>Home</a></li><li><a href=2>Archive</a></li></ul></nav><section class="post"><h1>*Pruning roses</h1><figure><img src=r.jpg><figcaption>*A rose after pruning</figcaption></figure><p>*Cut above an outward facing bud.</p><pre>*step one   step two</pre></section><aside class="ad"><p>Buy our new secateurs today!</p></aside></body></html>',
]


def test_pages_of_other_layouts():
    model, wrong, total = html_extract.trained(), 0, 0
    for page in LAYOUTS:
        blocks = [(b[0].lstrip("*"), *b[1:]) for b in html_extract.leaf_blocks(page)]
        labels = [int(b[0].startswith("*")) for b in html_extract.leaf_blocks(page)]
        states = model.decode(html_extract.block_features(blocks))
        wrong += sum(a != b for a, b in zip(states, labels, strict=True))
        total += len(labels)
    assert total > 30 and wrong / total <= 0.1
