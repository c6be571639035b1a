"""Stems beside a plain version, on listed words and on all words of the documents."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import stems as S
from corvane.functions.text import tokens
from corvane.operators import retrieval


def endings(x):
    return sorted(x if isinstance(x, list) else x.split("|"), key=len, reverse=True)


def longest(word, some):
    return next((e for e in endings(some) if word.endswith(e)), None)


def plain_russian(word):
    word = word.replace("ё", "е")
    v = S.RUSSIAN_VOWELS
    pv = next((i + 1 for i, c in enumerate(word) if c in v), len(word))
    at, want, seen = 0, [True, False, True, False], []
    p2 = len(word)
    for i, c in enumerate(word):
        if want and (c in v) == want[0]:
            want.pop(0)
            if not want:
                p2 = i + 1
    head, rv = word[:pv], word[pv:]

    def grouped(text, one, two):
        e = longest(text, endings(one) + endings(two))
        if e is None or (e in endings(one) and e not in endings(two) and not text[: -len(e)].endswith(("а", "я"))):
            return None
        return text[: -len(e)]

    found = grouped(rv, S.GERUND_1, S.GERUND_2)
    if found is None:
        e = longest(rv, S.REFLEXIVE)
        rv = rv[: -len(e)] if e else rv
        e = longest(rv, S.ADJECTIVE)
        if e:
            found = rv[: -len(e)]
            inner = grouped(found, S.PARTICIPLE_1, S.PARTICIPLE_2)
            found = found if inner is None else inner
        else:
            found = grouped(rv, S.VERB_1, S.VERB_2)
            if found is None:
                e = longest(rv, S.NOUN)
                found = rv[: -len(e)] if e else rv
    rv = found[:-1] if found.endswith("и") else found
    for e in ("ость", "ост"):
        if rv.endswith(e):
            rv = rv[: -len(e)] if len(head + rv) - len(e) >= p2 else rv
            break
    e = longest(rv, ["ейше", "ейш"])
    if e:
        rv = rv[: -len(e)]
        rv = rv[:-1] if rv.endswith("нн") else rv
    elif rv.endswith("нн") or rv.endswith("ь"):
        rv = rv[:-1]
    return head + rv


def plain_english(word):
    if len(word) < 3:
        return word
    if word in S.ENGLISH_WHOLE:
        return S.ENGLISH_WHOLE[word]
    w = word.removeprefix("'")
    letters = []
    for i, c in enumerate(w):
        letters.append("Y" if c == "y" and (not i or letters[-1] in "aeiouy") else c)
    w = "".join(letters)
    vowel = lambda c: c in "aeiouy"

    def after(start):
        seen = False
        for i in range(start, len(w)):
            if vowel(w[i]):
                seen = True
            elif seen:
                return i + 1
        return len(w)

    p1 = next((len(p) for p in S.ENGLISH_REGION.split("|") if w.startswith(p)), None) or after(0)
    p2 = after(p1)

    def short(x):
        if len(x) == 2:
            return vowel(x[0]) and not vowel(x[1])
        return len(x) > 2 and not vowel(x[-3]) and vowel(x[-2]) and not vowel(x[-1]) and x[-1] not in "wxY"

    e = longest(w, ["'s'", "'s", "'"])
    w = w[: -len(e)] if e else w
    e = longest(w, "sses|ied|ies|us|ss|s")
    if e == "sses":
        w = w[:-2]
    elif e in ("ied", "ies"):
        w = w[:-3] + ("i" if len(w) > 4 else "ie")
    elif e == "s" and any(map(vowel, w[:-2])):
        w = w[:-1]
    if w in S.ENGLISH_AFTER_PLURALS:
        return w
    e = longest(w, "eed|eedly|ed|edly|ing|ingly")
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= p1:
            w = w[: -len(e)] + "ee"
    elif e and any(map(vowel, w[: -len(e)])):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif longest(w, S.DOUBLES):
            w = w[:-1]
        elif p1 >= len(w) and short(w):
            w += "e"
    if w[-1] in "yY" and len(w) > 2 and not vowel(w[-2]):
        w = w[:-1] + "i"
    e = longest(w, list(S.STEP_2))
    if e and len(w) - len(e) >= p1:
        before = w[: -len(e)]
        if not (e == "ogi" and not before.endswith("l")) and not (e == "li" and not before.endswith(tuple("cdeghkmnrt"))):
            w = before + S.STEP_2[e]
    e = longest(w, list(S.STEP_3))
    if e and len(w) - len(e) >= p1 and (e != "ative" or len(w) - len(e) >= p2):
        w = w[: -len(e)] + S.STEP_3[e]
    e = longest(w, S.STEP_4)
    if e and len(w) - len(e) >= p2 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= p2 or (len(w) - 1 >= p1 and not short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= p2:
        w = w[:-1]
    return w.replace("Y", "y")


ENGLISH = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consistency": "consist", "consistently": "consist", "consolation": "consol", "consolatory": "consolatori", "console": "consol",
    "knack": "knack", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead", "knightly": "knight", "generously": "generous", "skies": "sky", "dying": "die", "hopping": "hop", "hoping": "hope", "cries": "cri", "ties": "tie", "gas": "gas", "this": "this",
    "caresses": "caress", "say": "say", "cry": "cri", "by": "by", "sayings": "say", "rational": "ration", "vietnamization": "vietnam", "communism": "communism", "proceed": "proceed", "bed": "bed", "feed": "feed", "agreed": "agre", "bled": "bled", "yes": "yes", "controlling": "control",
}
RUSSIAN = {
    "в": "в", "вавиловка": "вавиловк", "важная": "важн", "важнее": "важн", "важнейшие": "важн", "важничал": "важнича", "важность": "важност", "вагона": "вагон", "валяется": "валя", "вальс": "вальс", "падение": "паден", "падают": "пада", "павшие": "павш", "п": "п", "пакет": "пакет", "палкой": "палк", "промышленности": "промышлен", "производства": "производств", "ещё": "ещ",
}


def run(spark, words, language):
    df = spark.createDataFrame([(w,) for w in words], "word string")
    return {r.word: r.s for r in df.withColumn("s", S.stemmed(F.col("word"), language)).collect()}


def test_known_stems(spark):
    assert run(spark, ENGLISH, "english") == ENGLISH == {w: plain_english(w) for w in ENGLISH}
    assert run(spark, RUSSIAN, "russian") == RUSSIAN == {w: plain_russian(w) for w in RUSSIAN}


def test_made_words(spark):
    """Random words with the endings of all steps, and what isn't a word."""
    rng = random.Random(9)
    ends = [*S.STEP_2, *S.STEP_3, *S.STEP_4, "ed", "edly", "ing", "ingly", "eed", "s", "ies", "sses", "y", "e", "ll", "'s", ""]
    words = {"".join(rng.choice("abdeilnorstuwxy'") for _ in range(rng.randrange(9))) + rng.choice(ends) + rng.choice(["", "", "s", "ly"]) for _ in range(4000)}
    words |= {"", "a", "'", "yy", "yyy", "123", "été", "straße", "y's", "generations", "arsenal", "communities"}
    got = run(spark, words, "english")
    assert got == {w: plain_english(w) if len(w) > 2 else w for w in words}
    ends = [x for t in (S.GERUND_1, S.GERUND_2, S.REFLEXIVE, S.ADJECTIVE, S.PARTICIPLE_1, S.PARTICIPLE_2, S.VERB_1, S.VERB_2, S.NOUN) for x in t.split("|")] + ["ость", "ост", "ейше", "ейш", "нн", "ь", "и"]
    words = {"".join(rng.choice("абвегиклнорстыьюяё") for _ in range(rng.randrange(7))) + "".join(rng.choice(ends) for _ in range(rng.randrange(4))) for _ in range(6000)} | {"abc", ""}
    got = run(spark, words, "russian")
    assert got == {w: plain_russian(w) for w in words}
    null = spark.createDataFrame([(None,)], "word string")
    assert all(null.withColumn("s", S.stemmed(F.col("word"), x)).first().s is None for x in S.LANGUAGES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_all_words_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = docs.select(F.explode(tokens(F.col("text"))).alias("word")).distinct()
    for language, plain in (("english", plain_english), ("russian", plain_russian)):
        rows = words.withColumn("s", S.stemmed(F.col("word"), language)).collect()
        assert len(rows) > 5000 and [r for r in rows if r.s != plain(r.word)] == []


def test_stemmed_search(spark):
    """Inflected words find each other, and scores are those of a search over stemmed texts."""
    docs = [(1, "the cats were jumping over walls"), (2, "a cat jumps"), (3, "walled gardens"), (4, None), (5, "nothing here"), (6, "cat cat catting")]
    queries = [(1, "cat jumped"), (2, "walling"), (3, "")]
    df, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "item_id bigint, text string")
    stemmed = lambda rows: [(i, " ".join(plain_english(w) for w in (t or "").split() if len(w) > 1)) for i, t in rows]
    want = retrieval.bm25(spark.createDataFrame(stemmed(docs), df.schema), spark.createDataFrame(stemmed(queries), q.schema), "doc_id", "item_id")
    got = retrieval.bm25(df, q, "doc_id", "item_id", stem="english")
    rows = lambda x: sorted((r.item_id, r.doc_id, round(r.score, 9)) for r in x.collect())
    assert rows(got) == rows(want) and {(i, d) for i, d, _ in rows(got)} == {(1, 1), (1, 2), (1, 6), (2, 1), (2, 3)}


def test_english_words_without_an_ending(spark):
    """A word that no step takes an ending of is left alone; one with an apostrophe or a capital y is not."""
    words = ["isverschsch", "etourémentau", "12", "a'b", "'a", "yYo", "inkd", "ayo", "привет", "boy's", "eau", "cost", "aio", "costs", "biliti", "ogi"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r[0]: r[1] for r in df.select("w", S.stemmed(F.col("w"), "english")).collect() if "Y" not in r[0]} == {w: plain_english(w) for w in words if "Y" not in w}
    assert df.where("w = 'yYo'").select(S.stemmed(F.col("w"), "english")).first()[0] == "yyo"
    assert df.where(~F.col("w").rlike(S.ENDED)).count() == 9
