"""Rules on texts: where a turn goes, what it mentions and where, which scope it cites, how names are bent for tests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One line of a routing table: it fits if a pattern of ``some`` (or any text, if there is none) is found, all of
    ``every`` are, none of ``never`` is, and the text has at most ``most`` characters."""

    result: str
    some: Sequence[str] = ()
    every: Sequence[str] = ()
    never: Sequence[str] = ()
    most: int | None = None


def fits(text: Column, rule: Rule) -> Column:
    out = F.lit(True)
    if rule.some:
        out = out & text.rlike("|".join(f"(?:{p})" for p in rule.some))
    for pattern in rule.every:
        out = out & text.rlike(pattern)
    if rule.never:
        out = out & ~text.rlike("|".join(f"(?:{p})" for p in rule.never))
    return out if rule.most is None else out & (F.char_length(F.trim(text)) <= rule.most)


def routed(text: Column, rules: Sequence[Rule], otherwise: str | None = None) -> Column:
    """The result of the first rule that fits a text; null texts count as empty."""
    text, out = F.coalesce(text, F.lit("")), None
    for rule in rules:
        out = F.when(fits(text, rule), rule.result) if out is None else out.when(fits(text, rule), rule.result)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def branch(corpus: Column, kinds: Column, text: Column, rules: Sequence[Rule], prefixes: dict[str, str], otherwise: str) -> Column:
    """The branch of an answer: by its corpus (text before the first bar; by prefix, else ``rules[0].result``), or the kinds
    of its sources, or the rules on the question."""
    used = F.substring_index(F.coalesce(corpus, F.lit("")), "|", 1)
    by_corpus = F.lit(rules[0].result)
    for prefix, result in prefixes.items():
        by_corpus = F.when(F.startswith(used, F.lit(prefix)), result).otherwise(by_corpus)
    known = F.filter(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: k.isNotNull())
    by_kind = F.when(F.array_contains(known, "item"), otherwise).when(F.array_contains(known, "rule"), rules[0].result)
    return F.when(used != "", by_corpus).otherwise(F.coalesce(by_kind, routed(text, rules)))


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern (without groups) with their places: array of (value, start, stop), from 0 on."""
    found, rest = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.split(text, pattern)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,start:int,stop:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = (s["at"] + F.char_length(x["rest"])).cast("int")
        stop = (start + F.char_length(x["value"])).cast("int")
        return F.struct(stop.alias("at"), F.concat(s["out"], F.array(F.struct(x["value"].alias("value"), start.alias("start"), stop.alias("stop")))).alias("out"))

    pairs = F.arrays_zip(found.alias("value"), F.slice(rest, F.lit(1), F.size(found)).alias("rest"))
    return F.aggregate(pairs, begin, step)["out"]


def spaced_code(text: Column, code: str, cue: str, act: str, money: str, gap: int = 40) -> Column:
    """The code written with blanks that a text names, its blanks as points; null if there is none.

    A candidate needs a cue word within ``gap`` characters before it; those right after an act's number sign or right
    before a money word are dropped. The one nearest to its cue wins, unless a money word stands between; ties keep the
    first.
    """
    cues = located(text, cue)

    def judged(c: Column) -> Column:
        before, after = F.substring(text, F.lit(1), c["start"]), F.substring(text, c["stop"] + 1, F.lit(20))
        gaps = F.filter(F.transform(cues, lambda q: F.struct((c["start"] - q["stop"]).alias("gap"))), lambda g: (g["gap"] >= 0) & (g["gap"] <= gap))
        nearest = F.array_min(F.transform(gaps, lambda g: g["gap"]))
        shadow = F.substring(text, c["start"] - nearest + 1, nearest).rlike(money)
        good = nearest.isNotNull() & ~before.rlike(f"(?:{act})\\s*$") & ~after.rlike(f"^\\s*(?:{money})")
        return F.when(good, F.struct(shadow.cast("int").alias("shadow"), nearest.alias("gap"), c["start"].alias("start"), F.regexp_replace(c["value"], r"\s+", ".").alias("code")))

    best = F.array_min(F.array_compact(F.transform(located(text, code), judged)))
    return best["code"]


def unknown_mentions(text: Column, known: str, unknown: str, strong: str, weak: str, before: str, window: int = 80) -> Column:
    """Mentions of what doesn't exist, in lower case and each once, less those that a text denies.

    Known phrases are taken out first. A mention is denied by a strong word within the window, by a weak one in its own
    sentence (within the window), or by a phrase right before it.
    """
    plain = F.regexp_replace(text, known, " ")

    def asserted(m: Column) -> Column:
        left = F.substring(plain, F.greatest(m["start"] - window, F.lit(0)) + 1, F.least(m["start"], F.lit(window)))
        right = F.substring(plain, m["stop"] + 1, F.lit(window))
        sentence = F.concat(F.regexp_extract(left, r"([^.;!?\n]*)$", 1), m["value"], F.regexp_extract(right, r"^([^.;!?\n]*)", 1))
        return ~(F.concat(left, m["value"], right).rlike(strong) | sentence.rlike(weak) | left.rlike(f"(?:{before})\\s*$"))

    return F.array_distinct(F.transform(F.filter(located(plain, unknown), asserted), lambda m: F.lower(F.regexp_replace(m["value"], r"\s+", " "))))


def cited_scope(claim: Column, n_hits: Column) -> Column:
    """hits, rules or both: whether the numbers in brackets go up to ``n_hits``, beyond it, or both; hits without numbers."""
    numbers = F.transform(F.regexp_extract_all(claim, F.lit(r"\[\s*(\d+)\s*\]"), 1), lambda n: n.cast("int"))
    beyond = lambda n: n > n_hits
    return F.when((F.size(numbers) > 0) & F.forall(numbers, beyond), "rules").when(F.exists(numbers, beyond), "both").otherwise("hits")


def unverified_deadlines(answer: Column, context: Column, question: Column, pattern: str = r"(\d+(?:[.,]\d+)?)\s*(?:working|calendar)\s+days?") -> Column:
    """Terms in days that an answer claims and neither its context nor its question has as a number, each once, in order."""
    from corvane.functions.text import numbers

    claims = F.transform(F.regexp_extract_all(answer, F.lit(pattern), 1), lambda n: F.translate(n, ",", "."))
    return F.array_except(F.array_distinct(claims), F.concat(numbers(context), numbers(question)))


def latest_amendment(text: Column) -> Column:
    """The latest amendment "DD.MM.YYYY N n" of a text by date, then number: struct of y, m, d, number; null without any."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{2}\.\d{2}\.\d{4}\s+N\s*\d+)"), 1)
    part = lambda x, i: F.regexp_extract(x, r"(\d{2})\.(\d{2})\.(\d{4})\s+N\s*(\d+)", i).cast("int")
    return F.array_max(F.transform(found, lambda x: F.struct(part(x, 3).alias("y"), part(x, 2).alias("m"), part(x, 1).alias("d"), part(x, 4).alias("number"))))


def anchor_label(anchor: Column) -> Column:
    """"Section III, item 12" in short; null for anchors of another form."""
    section, item = (F.regexp_extract(anchor, r"Section\s+([IVXLC]+),\s*item\s+(\d+)", i) for i in (1, 2))
    return F.when(item != "", F.concat(F.lit("Sec. "), section, F.lit(", item "), item))


def abbreviated(text: Column, short: dict[str, str]) -> Column:
    """Words that begin with a stem of ``short`` (lower case) give way to its abbreviation; where none does, the longest
    word of six letters or more is cut to four and a point."""
    out = text
    for stem, mark in short.items():
        out = F.regexp_replace(out, rf"(?i)(?<![\p{{L}}\p{{N}}_]){stem}[\p{{L}}\p{{N}}_]*", mark)
    words = F.array_sort(F.regexp_extract_all(text, F.lit(r"(\p{L}{6,})"), 1))
    longest = F.try_element_at(F.filter(words, lambda w: F.char_length(w) == F.array_max(F.transform(words, lambda v: F.char_length(v)))), F.lit(1))
    at = F.instr(text, F.coalesce(longest, F.lit("")))
    cut = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(longest, 1, 4), F.lit("."), F.substring(text, at + F.char_length(longest), F.char_length(text)))
    return F.when(out != text, out).when(longest.isNotNull(), cut).otherwise(text)


def with_typo(text: Column, pick: Column, near: tuple[str, str] = ("abcdefghijklmnopqrstuvwxyz", "svnfrdgjkohklbmipqwerytzxa")) -> Column:
    """A text with one slip at a letter that ``pick`` chooses: two letters swapped, one left out, doubled or replaced by its
    neighbour (``near``: letters and what stands beside them). Texts of under three letters stay as they are."""
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)).rlike(r"\p{L}"))
    i = F.try_element_at(spots, (F.pmod(pick, F.greatest(F.size(spots), F.lit(1))) + 1).cast("int"))
    head, tail = F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.char_length(text))
    letter, following = F.substring(text, i, F.lit(1)), F.substring(text, i + 1, F.lit(1))
    kind = F.pmod(F.floor(pick / 7), F.lit(4))
    swap = F.concat(head, following, letter, F.substring(text, i + 2, F.char_length(text)))
    out = F.when(kind == 0, swap).when(kind == 1, F.concat(head, tail)).when(kind == 2, F.concat(head, letter, letter, tail)).otherwise(F.concat(head, F.translate(letter, *near), tail))
    return F.when(F.size(spots) < 3, text).otherwise(out)


def stemmed(words: Column, endings: Sequence[str], least: int = 3) -> Column:
    """Words without the longest of the given endings, where at least so many letters stay."""
    pattern = rf"^(.{{{least},}}?)(?:{'|'.join(sorted(endings, key=len, reverse=True))})$"
    return F.transform(words, lambda w: F.regexp_replace(w, pattern, "$1"))
