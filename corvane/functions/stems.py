"""Snowball stems of English and Russian words, as column expressions.

A word's regions are found once (their offsets don't change, as only ends are cut); a step takes the longest ending of its
list, and acts if the ending lies in the step's region and what stands before it fits. Each step's result has a name inside the
expression (a lambda over an array of one), so that the expression doesn't grow with the number of steps wherever the optimizer
moves it. It is interpreted: stem distinct words and join the stems back, as a corpus has far fewer of them than words
(``retrieval.bm25`` does so).

Words are taken as they come from ``text.tokens``: lower case. Null stays null; a word without a vowel, or of another
alphabet, stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published stemming algorithms: endings, replacements, exceptions.
RUSSIAN_VOWELS = "аеиоуыэюя"
GERUND_1, GERUND_2 = "в|вши|вшись", "ив|ивши|ившись|ыв|ывши|ывшись"
REFLEXIVE = "ся|сь"
ADJECTIVE = "ее|ие|ые|ое|ими|ыми|ей|ий|ый|ой|ем|им|ым|ом|его|ого|ему|ому|их|ых|ую|юю|ая|яя|ою|ею"
PARTICIPLE_1, PARTICIPLE_2 = "ем|нн|вш|ющ|щ", "ивш|ывш|ующ"
VERB_1 = "ла|на|ете|йте|ли|й|л|ем|н|ло|но|ет|ют|ны|ть|ешь|нно"
VERB_2 = "ила|ыла|ена|ейте|уйте|ите|или|ыли|ей|уй|ил|ыл|им|ым|ен|ило|ыло|ено|ят|ует|уют|ит|ыт|ены|ить|ыть|ишь|ую|ю"
NOUN = "а|ев|ов|ие|ье|е|иями|ями|ами|еи|ии|и|ией|ей|ой|ий|й|иям|ям|ием|ем|ам|ом|о|у|ах|иях|ях|ы|ь|ию|ью|ю|ия|ья|я"
DERIVATIONAL, SUPERLATIVE = "ость?", "ейше?"

ENGLISH_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
ENGLISH_AFTER_PLURALS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
ENGLISH_REGION = "gener|commun|arsen"
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
PLURALS, PARTICIPLES = "sses|ied|ies|us|ss|s", "eed|eedly|ed|edly|ing|ingly"
#: What a step needs: a word without it stays as it is.
ENDED = f"['Y]|(?:{'|'.join([PLURALS, PARTICIPLES, *STEP_2, *STEP_3, *STEP_4])}|[yel])$"
DOUBLES, LI_BEFORE = "bb|dd|ff|gg|mm|nn|pp|rr|tt", "[cdeghkmnrt]"
#: Consonants, with Y for a y that is none of a vowel; ends of short syllables.
V, C, SHORT = "[aeiouy]", "[^aeiouy]", "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chain(value: Column, *steps: Callable[[Column], Column]) -> Column:
    return _let(value, lambda x: _chain(steps[0](x), *steps[1:])) if steps else value


def _left(word: Column, n: Column) -> Column:
    return F.substring(word, F.lit(1), n)


def _without(word: Column, pattern: str) -> Column:
    return F.regexp_replace(word, f"(?:{pattern})$", "")


def _at_end(endings: str, act: Callable[[Column, Column, Column], Column]) -> Callable[[Column], Column]:
    """A step: ``act`` gets the word, its longest ending of the list and what stands before it; no ending, no change. With an end
    anchor the leftmost match is the longest."""

    def step(word: Column) -> Column:
        found = F.regexp_extract(word, f"(?:{endings})$", 0)
        return _let(found, lambda e: F.when(e == "", word).otherwise(_let(_left(word, F.length(word) - F.length(e)), lambda cut: act(word, e, cut))))

    return step


def _from(table: dict[str, str], ending: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), ending), F.lit(""))


def russian(word: Column) -> Column:
    """The stem of a Russian word."""
    v, c = f"[{RUSSIAN_VOWELS}]", f"[^{RUSSIAN_VOWELS}]"
    gerund = f"(?<=[ая])(?:{GERUND_1})|{GERUND_2}"
    participle, verb = f"(?<=[ая])(?:{PARTICIPLE_1})|{PARTICIPLE_2}", f"(?<=[ая])(?:{VERB_1})|{VERB_2}"

    def inflection(rv: Column) -> Column:
        other = lambda x: F.when(x.rlike(f"(?:{ADJECTIVE})$"), _without(_without(x, ADJECTIVE), participle)).when(x.rlike(f"(?:{verb})$"), _without(x, verb)).otherwise(_without(x, NOUN))
        return F.when(rv.rlike(f"(?:{gerund})$"), _without(rv, gerund)).otherwise(_let(_without(rv, REFLEXIVE), other))

    def whole(w: Column) -> Column:
        second = F.length(F.regexp_extract(w, f"^{c}*{v}+{c}+{v}+{c}", 0))  # 0: there is no second region
        # what lies up to the first vowel is never cut
        first = F.regexp_extract(w, f"^{c}*{v}", 0)

        def behind(head: Column) -> Column:
            derived = _at_end(DERIVATIONAL, lambda x, _, cut: F.when((second > 0) & (F.length(head) + F.length(cut) >= second), cut).otherwise(x))
            last = lambda x: _without(x, f"(?:(?<=н)н)?{SUPERLATIVE}|(?<=н)н|ь")
            rest = F.substring(w, F.length(head) + 1, F.length(w))
            return F.concat(head, _chain(rest, inflection, lambda x: _without(x, "и"), derived, last))

        return F.when(first == "", w).otherwise(_let(first, behind))

    return _let(F.translate(word, "ё", "е"), whole)


def english(word: Column) -> Column:
    """The stem of an English word."""
    region = f"^{C}*{V}+{C}"

    def stemmed(w: Column, p1: Column, p2: Column) -> Column:
        in_r1, in_r2 = lambda cut: F.length(cut) >= p1, lambda cut: F.length(cut) >= p2

        def plural(x: Column, e: Column, cut: Column) -> Column:
            ies = F.concat(cut, F.when(F.length(cut) > 1, "i").otherwise("ie"))
            return F.when(e == "sses", F.concat(cut, F.lit("ss"))).when(e.isin("ied", "ies"), ies).when((e == "s") & cut.rlike(f"{V}.+$"), cut).otherwise(x)

        def participle(x: Column, e: Column, cut: Column) -> Column:
            short = (p1 >= F.length(cut)) & cut.rlike(SHORT)
            mended = F.when(cut.rlike("(?:at|bl|iz)$") | (~cut.rlike(f"(?:{DOUBLES})$") & short), F.concat(cut, F.lit("e"))).when(cut.rlike(f"(?:{DOUBLES})$"), _left(cut, F.length(cut) - 1)).otherwise(cut)
            found = F.when(e.isin("eed", "eedly"), F.when(in_r1(cut), F.concat(cut, F.lit("ee"))).otherwise(x)).when(cut.rlike(V), mended).otherwise(x)
            return F.when(x.isin(ENGLISH_AFTER_PLURALS), x).otherwise(found)

        def second(x: Column, e: Column, cut: Column) -> Column:
            fits = in_r1(cut) & F.when(e == "ogi", cut.rlike("l$")).when(e == "li", cut.rlike(f"{LI_BEFORE}$")).otherwise(True)
            return F.when(fits, F.concat(cut, _from(STEP_2, e))).otherwise(x)

        def third(x: Column, e: Column, cut: Column) -> Column:
            return F.when(in_r1(cut) & F.when(e == "ative", in_r2(cut)).otherwise(True), F.concat(cut, _from(STEP_3, e))).otherwise(x)

        def fourth(x: Column, e: Column, cut: Column) -> Column:
            return F.when(in_r2(cut) & F.when(e == "ion", cut.rlike("[st]$")).otherwise(True), cut).otherwise(x)

        def fifth(x: Column, e: Column, cut: Column) -> Column:
            return F.when(F.when(e == "e", in_r2(cut) | (in_r1(cut) & ~cut.rlike(SHORT))).otherwise(in_r2(cut) & cut.rlike("l$")), cut).otherwise(x)

        steps = [
            _at_end("'s'|'s|'", lambda x, e, cut: cut),
            _at_end(PLURALS, plural),
            _at_end(PARTICIPLES, participle),
            _at_end("[yY]", lambda x, e, cut: F.when(cut.rlike(f".{C}$"), F.concat(cut, F.lit("i"))).otherwise(x)),
            _at_end("|".join(STEP_2), second),
            _at_end("|".join(STEP_3), third),
            _at_end("|".join(STEP_4), fourth),
            _at_end("[el]", fifth),
        ]
        return F.translate(_chain(w, *steps), "Y", "y")

    def with_regions(w: Column) -> Column:
        size = F.length(w)
        listed = F.length(F.regexp_extract(w, f"^(?:{ENGLISH_REGION})", 0))
        p1 = F.coalesce(F.nullif(listed, F.lit(0)), F.nullif(F.length(F.regexp_extract(w, region, 0)), F.lit(0)), size)
        more = lambda p1: F.length(F.regexp_extract(F.substring(w, p1 + 1, size), region, 0))
        return _let(p1, lambda p1: _let(F.coalesce(p1 + F.nullif(more(p1), F.lit(0)), size), lambda p2: stemmed(w, p1, p2)))

    # a y at the start or behind a vowel is no vowel; of several in a row every second one
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "^'", ""), "^y", "Y"), f"({V})y", "$1Y")
    listed = F.try_element_at(F.create_map(*[F.lit(x) for pair in ENGLISH_WHOLE.items() for x in pair]), word)
    return F.coalesce(listed, F.when((F.length(word) < 3) | ~word.rlike(ENDED), word).otherwise(_let(marked, with_regions)))


LANGUAGES = {"english": english, "russian": russian}


def stemmed(word: Column, language: str) -> Column:
    return LANGUAGES[language](word)
