"""Checks on texts: personal data with check digits, claims against a context, coverage by n-grams, simple routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the check digits.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)

# Patterns of sensitive data, in the order in which kinds are reported. Those with words are for lower-case text.
_W, _END = r"[\p{L}\d_]*", r"(?:[^\p{L}\d_]|$)"
RESTRICTED = rf"совершенно\s+секретно|(?:^|[^\p{{L}}\d_])(?:секретно|дсп){_END}|для\s+служебного\s+пользования|(?:коммерческ|служебн|государственн)[\p{{L}}\d_]+\s+тайн[\p{{L}}\d_]+"
PASSPORT = rf"паспорт{_W}[^0-9]{{0,20}}\d{{4}}\s?\d{{6}}\b"
SNILS = r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{3}[\s\-]?\d{2}\b"
INN_PERSON = r"\b\d{12}\b"
CARD = r"\b(?:\d[ \-]?){13,19}\b"
PHONE = rf"\+\d{{1,3}}[ -]?\(?\d{{3}}\)?[ -]?\d{{3}}[ -]?\d{{2}}[ -]?\d{{2}}|\+7[\s\-()]*\d[\d\s\-()]{{8,14}}\d|\b8[\s\-]*\(\d{{3,5}}\)[\s\-]*\d[\d\s\-]{{4,10}}\d|(?:тел|телефон|моб|звон|whats|viber|вайбер){_W}[^0-9+]{{0,12}}\+?[78][\d\s\-()]{{9,16}}\d"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ADDRESS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
#: What every text with any of these kinds has; it spares the others all further patterns.
SUSPICIOUS = r"@|\d(?:[\d ()\-\s]{5,}|[\d.]{5,})\d|(?:секретно|дсп|служебного|тайн)"
#: Kinds that block a text; the others only warn.
BLOCKING = ("restricted", "passport", "snils", "inn_person", "card")


def _weighted(digits: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + w * F.substring(digits, i + 1, 1).cast("int")
    return total


def _digit(digits: Column, place: int) -> Column:
    return F.substring(digits, place, 1).cast("int")


def inn_valid(text: Column) -> Column:
    """Tax numbers of ten or twelve digits by their check digits; anything else is not valid."""
    ten = _weighted(text, INN10) % 11 % 10 == _digit(text, 10)
    twelve = (_weighted(text, INN11) % 11 % 10 == _digit(text, 11)) & (_weighted(text, INN12) % 11 % 10 == _digit(text, 12))
    return F.coalesce(F.when(text.rlike(r"^\d{10}$"), ten).when(text.rlike(r"^\d{12}$"), twelve), F.lit(False))


def snils_valid(text: Column) -> Column:
    """Insurance numbers of eleven digits: a weighted sum modulo 101 (100 counts as 0); nine equal first digits are not valid."""
    digits = F.regexp_replace(text, r"[ -]", "")
    check = _weighted(digits, tuple(range(9, 0, -1))) % 101 % 100
    good = (check == F.substring(digits, 10, 2).cast("int")) & ~digits.rlike(r"^(\d)\1{8}")
    return F.coalesce(F.when(digits.rlike(r"^\d{11}$"), good), F.lit(False))


def card_valid(text: Column) -> Column:
    """Card numbers of 13 to 19 digits by the Luhn sum."""
    digits = F.regexp_replace(text, r"[ -]", "")
    return F.coalesce(F.when(digits.rlike(r"^\d{13,19}$"), F.expr("true") & F.call_function("luhn_check", digits)), F.lit(False))


def sensitive_kinds(text: Column) -> Column:
    """The kinds of sensitive data in a text, in fixed order."""
    some = lambda pattern, good: F.exists(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), good)
    found = {
        "restricted": F.lower(text).rlike(RESTRICTED),
        "passport": F.lower(text).rlike(PASSPORT),
        "snils": some(SNILS, lambda x: snils_valid(F.regexp_replace(x, r"\s", ""))),
        "inn_person": some(INN_PERSON, inn_valid),
        "card": some(CARD, card_valid),
        "phone": F.lower(text).rlike(PHONE),
        "email": text.rlike(EMAIL),
        "address": text.rlike(ADDRESS),
    }
    return F.array_compact(F.array(*[F.when(test, kind) for kind, test in found.items()]))


def unverified(answer: Column, context: Column, question: Column) -> Column:
    """Numbers of an answer that neither its context nor its question has, each once, in order."""
    from corvane.functions.text import numbers

    return F.array_except(F.array_distinct(numbers(answer)), F.concat(numbers(context), numbers(question)))


def echoed(answer: Column, context: Column, question: Column) -> Column:
    """Numbers of an answer that only the question has."""
    from corvane.functions.text import numbers

    return F.array_intersect(F.array_except(numbers(answer), numbers(context)), numbers(question))


def coverage(grams: Column, known: Column) -> Column:
    """Share of distinct n-grams that another text has too; 1 where there are none."""
    own = F.array_distinct(grams)
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.array_intersect(own, known)) / F.size(own))


def first_topic(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule (name, pattern) that matches, from narrow to wide."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out


def best_topic(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The rule with most matches; null if none matches or several have as many."""
    counts = F.array(*[F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(name).alias("name")) for name, p in rules])
    top = F.array_max(F.transform(counts, lambda c: c["n"]))
    best = F.filter(counts, lambda c: c["n"] == top)
    return F.when((top > 0) & (F.size(best) == 1), F.try_element_at(best, F.lit(1))["name"])


def cleaned(text: Column) -> tuple[Column, Column]:
    """Text without emoji and foreign ideographs, full-width signs made plain; and how many ideographs were removed."""
    plain = F.translate(text, "，。：；！？（）", ",.:;!?()")
    plain = F.regexp_replace(plain, r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", "")
    foreign = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"
    return F.regexp_replace(plain, foreign, ""), F.regexp_count(plain, F.lit(foreign))
