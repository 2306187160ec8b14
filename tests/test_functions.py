from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from speechmart import dims
from speechmart.functions import grammar, metrics
from speechmart.functions import text as T

DICT = {"tulaga": "tūlaga", "latou": "lātou"}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("ā ē ī ō ū Ā Ē Ī Ō Ū", "a e i o u A E I O U"), ("", ""), ("fāgogo", "fagogo")],
)
def test_to_plain(spark, given, want):
    assert one(spark, T.to_plain(F.lit(given))) == want


def test_to_macron(spark):
    assert one(spark, T.to_macron(F.lit("tulaga latou"))) == "tulaga latou"
    assert one(spark, T.to_macron(F.lit("Tulaga  LATOU, (tulaga)"), DICT)) == "Tūlaga LĀTOU, (tūlaga)"
    assert one(spark, T.to_macron(F.lit(None).cast("string"), DICT)) is None


def test_detection(spark):
    assert one(spark, T.detect_system(F.lit(""))) == "system6"
    assert one(spark, T.detect_system(F.lit("tūlaga"))) == "system4"
    assert one(spark, T.count_macrons(F.lit("tūlāgā"))) == 3


def test_normalize(spark):
    assert one(spark, T.normalize(F.lit("E FĀ`NAU  Mai!!"))) == "e fa'nau mai"
    assert one(spark, T.normalize(F.lit("Mai’s"))) == "mai s"
    assert one(spark, T.normalize(F.lit("Mai’s"), fix_curly=True)) == "mai's"
    assert one(spark, T.normalize(F.lit("Tulaga!"), "system4", DICT)) == "tūlaga"
    with pytest.raises(ValueError, match="orthography"):
        T.normalize(F.lit("x"), "system5")


def test_normalizers_differ(spark):
    assert one(spark, T.whitelist_training(F.lit("Fa`nau  e-lua|1"))) == "fa'nau elua|"
    assert one(spark, T.whitelist_scoring(F.lit("Fa`nau  e-lua|1"))) == "fanau elua"
    assert one(spark, T.alignment_words(F.lit("Fa'nau, é!"))) == ["fanau", "é"]
    assert one(spark, T.acoustic_text(F.lit("Bād Jōy"))) == "pat tōi"
    assert one(spark, T.voiced_text(F.lit("two words"))) is None


def test_word_similarity(spark):
    cases = [("katoa", "tatoa", 1.0), ("", "a", 0.0), ("Fono ", "fono", 1.0), ("rima", "lima", 0.9), ("lima", "rima", 0.75), ("tanga", "tana", 1.0)]
    for a, b, want in cases:
        assert one(spark, T.word_similarity(F.lit(a), F.lit(b))) == pytest.approx(want), (a, b)


def test_jaccard_and_repetition(spark):
    assert one(spark, T.jaccard(F.lit("a b"), F.lit("b c"))) == pytest.approx(1 / 3)
    assert one(spark, T.jaccard(F.lit(""), F.lit("a"))) == 0
    assert one(spark, T.is_repetitive(F.lit("no no no no no"))) and not one(spark, T.is_repetitive(F.lit("no no no")))


def test_names(spark):
    assert one(spark, T.session_of(F.lit("x_24-06-24.wav"))) == "june"
    assert one(spark, T.session_of(F.lit("x_09-12-24.wav"))) == "december"
    assert one(spark, T.session_of(F.lit("x.wav"))) == "unknown"
    assert tuple(one(spark, T.day_take(F.lit("Day_2_Take_1.wav")))) == (2, 1)
    assert tuple(one(spark, T.day_take(F.lit("x.wav")))) == (0, 0)
    assert one(spark, T.clip_name(F.lit("june"), F.lit(7))) == "june_00007"
    assert one(spark, T.segment_key(F.lit(0.25), F.lit(1.35))) == f"{0.25:.1f}-{1.35:.1f}"


def test_truncation_and_labels(spark):
    assert one(spark, T.proportional_truncate(F.lit("one two three four"), F.lit(200), 100)) == "one two"
    assert one(spark, T.proportional_truncate(F.lit("one two"), F.lit(50), 100)) == "one two"
    ids = T.label_ids(F.lit("Ab c"), {"a": 5, "b": 6, "|": 4})
    assert one(spark, ids) == [5, 6, 4, 3]
    assert one(spark, T.pad_labels(ids, F.lit(6))) == [5, 6, 4, 3, -100, -100]


def test_validation(spark):
    v = one(spark, grammar.validate(F.lit("tangat"), "strict"))
    assert [i["message"] for i in v["issues"] if "vowel" in i["message"]] == ["word does not end in a vowel: tangat"] and not v["is_valid"]
    m = one(spark, grammar.validate(F.lit("radio"), "moderate"))
    assert [(i["position"], i["severity"]) for i in m["issues"]] == [(0, "warning"), (2, "warning")] and m["is_valid"]
    assert one(spark, grammar.character_issues(F.lit("radio"), "permissive")) == []


def test_lookups(spark):
    for word, want in (("meakai", "a"), (" Vae", "o"), ("xyzabc", "?")):
        assert one(spark, grammar.possessive_class(F.lit(word))) == want
    assert one(spark, grammar.conjugate(F.lit("o tuku"), F.lit("present"))) == "e tuku"
    assert one(spark, grammar.conjugate(F.lit("o tuku"), F.lit("past"), negative=True)) == "seki tuku"
    assert one(spark, grammar.conjugate(F.lit("tuku"), F.lit("never"))).startswith("Unknown tense 'never'. Available: present")
    assert one(spark, grammar.alliterate(F.lit("seai"), F.lit("toku"))) == "soku"
    assert one(spark, grammar.alliterate(F.lit("fale"), F.lit("toku"))) == "toku"
    assert [one(spark, grammar.number_for_people(F.lit(n))) for n in (1, 2, 3, 99)] == ["tokotasi", "tokolua", "tokotolu", "toko99"]
    assert one(spark, grammar.possessive_pronoun(F.lit("1"), F.lit("singular"), F.lit("a"), F.lit("singular"))) == "taku"
    assert one(spark, grammar.possessive_pronoun(F.lit("2"), F.lit("plural"), F.lit("?"), F.lit("singular"))) == "to??"
    assert all(df.count() for df in dims.lookups(spark).values())


def test_located_words(spark):
    text = ("ka fano au, " * 300).strip()
    got = one(spark, grammar.located_words(F.lit(text)))
    assert len(got) == 900 and all(text[t["position"] : t["position"] + len(t["word"])] == t["word"] for t in got)
    a = one(spark, grammar.analyze(F.lit("Ka fano au")))
    assert [v["sense"] for v in a["verb_phrases"]] == ["future"] and a["pronouns"][0]["position"] == 8


HEARD = (
    "e fānau mai ia tino katoa i te saolotoga kae pao te lotou tulaga fakaaloalogina mo te lotou aiā ne tuku atu kia latou "
    "a te mafaofao mo te lotolagona te lalā e tauogalue fakatasi a latou e pei la mene taina"
)
MACRON = (
    "E fā'nau mai a tino katoa i te saolotoga kae e 'pau telotolo tūlaga fakaaloalogina mo telotolo aiā. Ne tuku atu ki a lātou "
    "a te mafaufau mo te loto lagona, tēlā lā, e 'tau o gā'lue fakatasi lātou e pēlā me ne taina."
)


def test_published_error_rates(spark):
    plain = MACRON.translate(str.maketrans(dims.MACRONS, dims.PLAIN))
    e = one(spark, metrics.dual_orthography(F.lit(HEARD), F.lit(MACRON), F.lit(plain)))
    assert e["wer_system4"] == pytest.approx(24 / 44) and e["wer_system6"] == pytest.approx(21 / 44)
    assert e["cer_system4"] == pytest.approx(35 / 211) and e["cer_system6"] == pytest.approx(27 / 211)


def test_error_rate_guards(spark):
    for ref, hyp, want in ((" ", "", 0.0), ("", "x", 1.0), ("a b", " ", 1.0), ("a b", "a c", 0.5)):
        assert one(spark, metrics.wer(F.lit(ref), F.lit(hyp))) == want
    assert one(spark, metrics.positional_wer(F.lit("a b c"), F.lit("a c"))) == pytest.approx(2 / 3)
    pairs = spark.createDataFrame([("a b", "a"), ("", "x"), ("c", "c")], "r string, h string")
    row = metrics.corpus_rates(pairs, "r", "h").first()
    assert (row["wer"], row["pairs"]) == (pytest.approx(1 / 3), 2)
