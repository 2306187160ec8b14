"""Fixed values of the domain, as plain tables.

The values below are fixed: results depend on them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Vowels with and without macron, in the same order.
MACRONS = "āēīōūĀĒĪŌŪ"
PLAIN = "aeiouAEIOU"

# Characters folded for acoustic alignment, from and to.
FOLD_FROM = "bcdjqwxyzāēīū"
FOLD_TO = "pkttkukisaeiu"

# Keywords of the first transcript source.
NATIVE_ANCHORS = [
    "funafuti", "nukufetau", "nanumea", "vaitupu", "nukulaelae", "niutao", "nui",
    "tatou", "tenei", "latou", "mafai", "fenua", "tulaga", "tuvalu",
    "penei", "tausaga", "matou", "tulafono", "vaega", "fesili",
    "fakatasi", "kiloga", "talia", "manako", "fakatokaga", "fakafetai",
    "galuega", "manakoga", "kiluga", "atufenua", "mataupu",
    "palamene", "komiti", "minista", "minisita", "miliona", "pili",
    "ofisa", "pasene", "fono",
]

# Keywords of the second transcript source.
ENGLISH_ANCHORS = [
    "parliament", "minister", "speaker", "budget", "government",
    "committee", "bill", "policy", "public", "member", "motion",
    "report", "general", "national", "private", "prime",
    "climate", "project", "development", "economic", "financial",
    "teo", "kofe", "telavi", "sopoaga", "tausi", "enele",
    "honourable", "honorable",
]

# Keywords of one source and their counterparts in the other.
ANCHOR_EQUIVALENTS = {
    "palamene": "parliament",
    "parliament": "palamene",
    "minista": "minister",
    "minisita": "minister",
    "minister": "minista",
    "komiti": "committee",
    "committee": "komiti",
}

# Letters that the traditional alphabet lacks and validation flags.
FOREIGN_LETTERS = "bcdjqrwxyz"
CLUSTER_CONSONANTS = "fhklmnpstv"

# Nouns by possessive class and category.
A_CLASS = {
    "food": ["meakai", "ika", "popo", "pi", "vai"],
    "children": ["tama", "tamaliki", "tamafafine", "tamatangata"],
    "actions_states": ["ngaluenga", "faifainga", "tongafiti", "olonga", "omamainga", "teleatunga", "fangongo", "lakau", "fatu", "toki"],
}
O_CLASS = {
    "body_parts": ["vae", "lima", "mata", "ulu", "nifo", "tua", "manava", "isu", "taliga", "loto"],
    "feelings": ["manatu", "alofa", "ita", "fiafia", "mataku"],
    "possessions": ["fale", "vaka", "paopao", "manafa", "fenua", "umanga", "pulou", "taka", "moenga"],
    "relations_except_children": ["tamana", "tina", "matua", "tupuna", "avanga", "taina", "tuangane"],
}

# Tense and negative particles: key, particle, description.
TENSES = [
    ("present", "e", "Current action or state"),
    ("future", "ka", "Future action"),
    ("past", "ne", "Completed action"),
    ("future_conditional", "ma", "If someone should do"),
    ("consequential", "ke", "That someone may do / let someone do"),
    ("perfect_conditional", "moi", "If someone had done"),
    ("precautionary", "mana", "Lest someone should do"),
]
NEGATIVES = [
    ("present", "se", "Does not / is not"),
    ("past", "seki", "Did not"),
    ("imperative", "sa", "Don't!"),
]

# Names and examples of the particles.
PARTICLE_RECORDS = {
    "e": ("Present Indicative", "E tuku ne au - I give"),
    "ka": ("Future Indicative", "Ka tuku ne au - I shall give"),
    "ne": ("Past Indicative", "Ne tuku ne au - I gave"),
    "ma": ("Future Contingent", "Ma tuku ne au - If I should give"),
    "ke": ("Future Consequential", "Ke tuku ne au - That I may give"),
    "moi": ("Perfect Conditional", "Moi tuku ne au - If I had given"),
    "mana": ("Future Precautionary", "Mana tuku ne au - Lest I should give"),
    "se": ("Negative Present", "Se tuku ne au - I do not give"),
    "seki": ("Negative Past", "Seki tuku ne au - I did not give"),
    "sa": ("Negative Imperative", "Sa tuku - Don't give"),
}

# Pronouns: word, person, number, gloss.
PRONOUNS = [
    ("au", 1, "singular", "I, me"),
    ("koe", 2, "singular", "you (singular)"),
    ("ia", 3, "singular", "he, she, him, her"),
    ("taua", 1, "dual_inclusive", "we two (you and I)"),
    ("maua", 1, "dual_exclusive", "we two (he/she and I)"),
    ("koulua", 2, "dual", "you two"),
    ("laua", 3, "dual", "they two"),
    ("tatou", 1, "plural_inclusive", "we all (you and I)"),
    ("matou", 1, "plural_exclusive", "we all (they and I)"),
    ("koutou", 2, "plural", "you all"),
    ("latou", 3, "plural", "they all"),
]

# Articles: word, type, number, gloss.
ARTICLES = [
    ("te", "definite", "singular", "the"),
    ("se", "indefinite", "singular", "a, an"),
    ("a", "personal", "singular", "before names/pronouns"),
    ("ni", "partitive", "plural", "some"),
    ("ne", "partitive", "plural", "some (variant)"),
]

# Cardinal numbers.
CARDINALS = {
    1: "tasi", 2: "lua", 3: "tolu", 4: "fa", 5: "lima", 6: "ono", 7: "fitu", 8: "valu", 9: "iva", 10: "angafulu",
    11: "angafulu ma tasi", 20: "lua ngafulu", 100: "se lau", 1000: "afe",
}

# Sibling terms, alliterated pronouns and exclamations.
SIBLINGS = [
    ("taina", "same-sex sibling (brother's brother or sister's sister)"),
    ("tuangane", "opposite-sex sibling (brother's sister or sister's brother)"),
]
ALLITERATION = {"toku": "soku", "taku": "saku", "tou": "sou", "tau": "sau", "tona": "sona", "tena": "sena"}
EXCLAMATIONS = [
    ("e", "hey, there"),
    ("tapa", "astonishment"),
    ("tape", "surprise and satisfaction"),
    ("aue", "satisfaction, awe"),
    ("ai aue", "disappointment, sadness"),
    ("mea", "surprise and resentment"),
    ("ko foki", "surprise and delight"),
    ("tafanga loa", "excellent!"),
    ("kiloke", "behold! I say!"),
    ("te", "nonsense"),
]


def noun_classes(spark: SparkSession) -> DataFrame:
    """word, class, category of the listed nouns."""
    rows = [(w, "a", c) for c, ws in A_CLASS.items() for w in ws] + [(w, "o", c) for c, ws in O_CLASS.items() for w in ws]
    return spark.createDataFrame(rows, "word string, class string, category string")


def particles(spark: SparkSession) -> DataFrame:
    """particle, tense, description, name, example; the tenses of negatives carry the prefix ``neg_``."""
    rows = [(p, t, d, *PARTICLE_RECORDS[p]) for t, p, d in TENSES] + [(p, f"neg_{t}", d, *PARTICLE_RECORDS[p]) for t, p, d in NEGATIVES]
    return spark.createDataFrame(rows, "particle string, tense string, description string, name string, example string")


def pronouns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRONOUNS, "pronoun string, person int, number string, gloss string")


def lookups(spark: SparkSession) -> dict[str, DataFrame]:
    """All reference tables by name."""
    return {
        "noun_classes": noun_classes(spark),
        "particles": particles(spark),
        "pronouns": pronouns(spark),
        "articles": spark.createDataFrame(ARTICLES, "article string, type string, number string, gloss string"),
        "cardinals": spark.createDataFrame(list(CARDINALS.items()), "n int, word string"),
        "siblings": spark.createDataFrame(SIBLINGS, "term string, meaning string"),
        "alliteration": spark.createDataFrame(list(ALLITERATION.items()), "pronoun string, changed string"),
        "exclamations": spark.createDataFrame(EXCLAMATIONS, "word string, meaning string"),
    }
