"""Normalisers, tokenisers and prompt texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers that are a verdict and never a node.
PREDICATE_ANSWERS = ("yes", "no")
#: ASCII punctuation, dropped from answers.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
#: Signs that count as spaces when a relation is looked up in its sentence.
SENTENCE_SIGNS = ",.;:()\"'"


def strip(col: Column) -> Column:
    """Without leading and trailing white space of any kind (`trim` takes spaces only)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def normalize(col: Column) -> Column:
    """Lower case, stripped: the form in which labels are compared."""
    return F.lower(strip(col))


def tokens(col: Column) -> Column:
    """Distinct white-space tokens, in order of appearance."""
    return F.array_distinct(F.filter(F.split(strip(col), r"(?U)\s+"), lambda t: t != ""))


def normalize_answer(col: Column) -> Column:
    """Lower case, without punctuation and articles, single spaces."""
    bare = F.translate(F.lower(col), PUNCTUATION, "")
    return strip(F.regexp_replace(F.regexp_replace(bare, rf"(?U)\b({'|'.join(ARTICLES)})\b", " "), r"(?U)\s+", " "))


def answer_tokens(col: Column) -> Column:
    """Tokens of a normalised answer, repeats kept."""
    return F.filter(F.split(normalize_answer(col), " "), lambda t: t != "")


def is_predicate(answer: Column) -> Column:
    return normalize(answer).isin(*PREDICATE_ANSWERS)


def quoted(needle: Column) -> Column:
    """A pattern that matches the text literally."""
    return F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def grounded(answer: Column, sentences: Column) -> Column:
    """Whether the answer stands between word boundaries in one of the sentences; false for empty and predicate answers."""
    needle = normalize(answer)
    pattern = F.concat(F.lit(r"(?U)\b"), quoted(needle), F.lit(r"\b"))
    found = F.exists(sentences, lambda s: F.regexp_like(F.lower(s), pattern))
    return F.coalesce((needle != "") & ~needle.isin(*PREDICATE_ANSWERS) & found, F.lit(False))


def content_key(sentences: Column) -> Column:
    """md5 of the sentences with a NUL between them, so that their borders count."""
    return F.md5(F.array_join(sentences, "\0"))


def relation_tokens(relation: Column) -> Column:
    """Parts of a relation name that are long enough to look for in a sentence."""
    return F.array_distinct(F.filter(F.split(F.lower(relation), "_"), lambda t: F.length(t) > 2))


def sentence_tokens(sentence: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(sentence), SENTENCE_SIGNS, " " * len(SENTENCE_SIGNS)), r"(?U)\s+"), lambda t: t != "")


def verbalize(entities: Column, relation: Column) -> Column:
    """A fact as text: an arrow between two entities, else the relation with a list."""
    name = F.replace(relation, F.lit("_"), F.lit(" "))
    pair = F.concat(F.get(entities, 0), F.lit(" --["), name, F.lit("]--> "), F.get(entities, 1))
    return F.when(F.size(entities) == 2, pair).otherwise(F.concat(name, F.lit("("), F.array_join(entities, ", "), F.lit(")")))


def numbered(sentences: Column) -> Column:
    """One line a sentence, `[i] sentence`."""
    return F.array_join(F.transform(sentences, lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s)), "\n")


def extraction_prompt(sentences: Column) -> Column:
    return F.concat(F.lit("Extract the facts of these sentences.\n\n"), numbered(sentences))


def repair_prompt(sentences: Column, src: Column, dst: Column, goal: Column) -> Column:
    """A question for the facts that link src and dst; the goal line is left out when blank."""
    aim = F.when(F.coalesce(strip(goal), F.lit("")) != "", F.concat(F.lit("Goal: "), strip(goal), F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("Source: "), src, F.lit("\nTarget: "), dst, F.lit("\n"), aim,
        F.lit("Find facts that link source and target in this passage.\n\n"), numbered(sentences),
    )


def answer_prompt(question: Column, facts: Column) -> Column:
    """The facts as a bulleted list above the question; without facts the question alone."""
    bullets = F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n")
    asked = F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))
    return F.when(F.size(facts) > 0, F.concat(F.lit("Facts:\n"), bullets, F.lit("\n\n"), asked)).otherwise(asked)


def first_line(col: Column) -> Column:
    return strip(F.split_part(strip(col), F.lit("\n"), F.lit(1)))


def file_name(chunk_id: Column) -> Column:
    """A chunk id as a file name: what isn't a letter, digit, - or _ becomes _."""
    return F.regexp_replace(chunk_id, r"(?U)[^\w-]", "_")
