"""Text functions as column expressions: tokens, noise, headings, sentences, excerpts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions import rules


def strip(text: Column) -> Column:
    """White space as Unicode has it, and the four separators that Python counts too."""
    return F.btrim(text, F.lit(rules.WHITE_SPACE))


def collapse(text: Column) -> Column:
    """Each run of white space becomes a space; runs that are one already aren't touched."""
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+", " "))


def tidied(line: Column) -> Column:
    """Runs of blanks and tabs become a space."""
    return strip(F.when(line.contains("  ") | line.contains("\t"), F.regexp_replace(line, "[ \t]+", " ")).otherwise(line))


def tokens(text: Column) -> Column:
    """Words that start with a letter, and numbers; in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(rules.TOKEN_PATTERN), F.lit(0)), F.lower)


def words(text: Column) -> Column:
    """Words that start with a letter; in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(rules.WORD_PATTERN), F.lit(0)), F.lower)


def has_any(terms: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, vocabulary)))


def is_noise(line: Column) -> Column:
    """Patterns are tried only where a part stands that each of their matches holds."""
    longest = max(map(len, rules.NOISE_PREFIXES))
    begins = F.lower(F.substring(line, 1, longest)).rlike(f"^(?:{'|'.join(rules.NOISE_PREFIXES)})")
    doi = line.contains("10.") & line.rlike(rules.DOI)
    web = (line.contains("://") | F.lower(line).contains("www.")) & line.rlike(rules.WEB_ADDRESS)
    return line.rlike(rules.PAGE_NUMBER) | doi | web | begins


def without_colons(line: Column) -> Column:
    return F.btrim(strip(line), F.lit(":"))


def is_reference_heading(line: Column) -> Column:
    may_be = reduce(lambda a, b: a | b, [F.lower(line).contains(name) for name in rules.REFERENCE_HEADINGS])
    return may_be & F.lower(without_colons(line)).isin(*rules.REFERENCE_HEADINGS)


def is_upper(text: Column) -> Column:
    return text.rlike(r"(?U)[\p{Lu}\p{Lt}]") & ~text.rlike(r"(?U)[\p{Ll}\p{Lt}]")


def title_case(text: Column) -> Column:
    """Each run of letters gets a capital, whatever stands between the runs."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def heading(line: Column) -> Column:
    """The normalised heading that a line is, else null. Each part is worked out once, and for lines that may be headings only."""
    return let(without_colons(line), lambda c: F.when(F.length(c).between(3, 110), let(F.regexp_extract_all(c, F.lit(rules.WORD_RUN), F.lit(0)), lambda parts: _heading_of(line, c, parts))))


def _heading_of(line: Column, candidate: Column, parts: Column) -> Column:
    n = F.size(parts)
    known = F.lower(candidate).isin(*rules.SECTION_HEADINGS)
    capitals = F.size(F.filter(parts, lambda w: w.rlike(r"(?U)^[\p{Lu}]")))
    fits = (n <= 12) & (~candidate.endswith(".") | known)
    titled = (n >= 2) & (capitals >= 0.75 * n) & ~candidate.rlike("[.;()]")
    says = known | candidate.rlike(rules.NUMBERED_HEADING) | (line.endswith(":") & (n <= 10)) | (n.between(1, 10) & is_upper(candidate)) | titled
    clean = F.regexp_replace(F.regexp_replace(candidate, rules.LEADING_NUMBER, ""), "^[ :-]+|[ :-]+$", "")
    named = let(clean, lambda x: F.when(is_upper(x), title_case(x)).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))))
    return F.when(fits & says, let(named, lambda x: F.when(x != "", x)))


def lines_to_text(lines: Column) -> Column:
    joined = F.regexp_replace(F.array_join(lines, " "), r"(?U)[\s\x1c-\x1f]+([,.;:?!])", "$1")
    return collapse(joined)


def sentences(text: Column) -> Column:
    """Split before a capital, digit or bracket that follows the end of a sentence. All white space is single spaces by then."""
    return F.filter(F.split(collapse(text), rules.SENTENCE_BOUNDARY), lambda s: s != "")


def cut_to(text: Column, limit: int) -> Column:
    """At most ``limit`` characters and '...' instead of a word that would be parted."""
    head = F.substring(text, 1, limit - 1)
    whole = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(strip(whole), F.lit("...")))


def citation_excerpt(text: Column) -> Column:
    return cut_to(collapse(text), rules.CITATION_CHARS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def best_excerpt(text: Column, question: Column, limit: int = rules.EXCERPT_CHARS) -> Column:
    """The three sentences that share most words with the question, shorter ones first among equals, in their order in the text."""
    parts = F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"), strip), lambda s: s != "")
    asked = F.array_distinct(words(question))
    return let(F.struct(parts.alias("parts"), asked.alias("asked"), text.alias("text")), lambda x: _excerpt_of(x["parts"], x["asked"], x["text"], limit))


def _excerpt_of(parts: Column, asked: Column, text: Column, limit: int) -> Column:
    scored = F.transform(parts, lambda s, i: F.struct((-F.size(F.array_intersect(F.array_distinct(words(s)), asked))).alias("a"), F.length(s).alias("b"), i.alias("c"), s.alias("s")))
    best = F.slice(F.array_sort(scored), 1, rules.EXCERPT_SENTENCES)
    start = F.struct(F.array().cast("array<string>").alias("chosen"), F.lit(0).alias("n"))

    def take(state: Column, one: Column) -> Column:
        n = state["n"] + one["b"] + 1
        fits = (state["n"] < limit) & ((n <= limit) | (F.size(state["chosen"]) == 0))
        return F.when(fits, F.struct(F.array_append(state["chosen"], one["s"]).alias("chosen"), n.cast("int").alias("n"))).otherwise(state)

    chosen = F.aggregate(best, start, take)["chosen"]
    text_of = let(chosen, lambda c: F.array_join(F.filter(parts, lambda s: F.array_contains(c, s)), " "))
    return F.when(F.size(parts) == 0, strip(F.substring(text, 1, limit))).otherwise(let(text_of, lambda t: cut_to(t, limit)))
