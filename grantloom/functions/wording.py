"""Cleaning, lemmatizing and counting words and delimited terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantloom.functions.names import entries

# Grant-language terms removed before text features are built.
STOP_TERMS = (
    "project", "research", "study", "grant", "core", "program", "center", "development", "training", "support",
    "service", "year", "years", "aim", "specific", "aims", "proposed", "proposal", "application", "data",
    "analysis", "method", "approach", "technique", "tool", "system", "model", "process", "investigation",
    "evaluation", "health", "disease", "patient", "clinical", "treatment", "therapy", "human", "tissue", "cell",
    "protein", "gene", "molecular",
)
# The longer list, for lemmas.
STOP_LEMMAS = (
    "project", "research", "study", "grant", "core", "program", "center", "development", "training", "support",
    "service", "year", "years", "aim", "specific", "aims", "proposed", "proposal", "application", "data",
    "analysis", "method", "approach", "technique", "tool", "system", "model", "process", "investigation",
    "evaluation", "health", "disease", "patient", "clinical", "treatment", "therapy", "human", "tissue", "cell",
    "cells", "protein", "proteins", "gene", "genes", "molecular", "biology", "structure", "function", "medicine",
    "new", "novel", "important", "major", "basic", "translational",
)
# Generic terms skipped in labels.
GENERIC_TERMS = (
    "cell", "cells", "protein", "proteins", "gene", "genes", "expression", "function", "regulation", "activity",
    "level", "development", "role", "mechanism", "process", "system", "study", "studies", "research", "analysis",
    "method", "data", "model", "disease", "human", "patient", "clinical", "work", "testing", "base", "goals",
    "test",
)
GENERIC_DOMAIN_TERMS = (*GENERIC_TERMS, "measure")
# Irregular noun plurals.
IRREGULAR = {
    "mice": "mouse", "children": "child", "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth",
    "bacteria": "bacterium", "criteria": "criterion", "phenomena": "phenomenon", "analyses": "analysis",
    "hypotheses": "hypothesis", "matrices": "matrix", "vertebrae": "vertebra", "nuclei": "nucleus", "fungi": "fungus",
}
SHORTEST_TERM = 4


def lowered_terms(text: Column) -> Column:
    return F.transform(entries(text), lambda term: F.lower(term))


def words_in(values) -> Column:
    return F.array(*[F.lit(value) for value in values])


def kept_terms(terms: Column, stop=STOP_TERMS) -> Column:
    """Terms of at least four letters that are not on the stop list."""
    stops = words_in(stop)
    return F.filter(terms, lambda term: ~F.array_contains(stops, term) & (F.length(term) >= SHORTEST_TERM))


def cleaned_terms(text: Column, stop=STOP_TERMS) -> Column:
    return F.array_join(kept_terms(lowered_terms(text), stop), " ")


def lemma(word: Column) -> Column:
    """Singular form of a noun: irregular nouns first, then plural endings."""
    known = F.create_map(*[F.lit(text) for pair in IRREGULAR.items() for text in pair])
    chopped = (
        F.when(word.rlike("[a-z]{2,}ies$"), F.concat(F.regexp_extract(word, "^(.*)ies$", 1), F.lit("y")))
        .when(word.rlike("(ss|x|z|ch|sh)es$"), F.regexp_extract(word, "^(.*)es$", 1))
        .when(word.rlike("[^su i]s$") & (F.length(word) > 3), F.regexp_extract(word, "^(.*)s$", 1))
        .otherwise(word)
    )
    return F.coalesce(F.try_element_at(known, word), chopped)


def lemmatized(terms: Column) -> Column:
    """Each word of each term in its singular form."""
    return F.transform(
        terms, lambda term: F.array_join(F.transform(F.split(term, r"\s+"), lemma), " ")
    )


def lemmatized_text(text: Column) -> Column:
    return F.array_join(kept_terms(lemmatized(lowered_terms(text)), STOP_LEMMAS), " ")


def kept_science(terms: Column, keep: Column) -> Column:
    """Terms with at least one word on the keep list (an array column or literal)."""
    return F.filter(terms, lambda term: F.arrays_overlap(F.split(term, r"\s+"), keep))


def plain_words(text: Column) -> Column:
    """Lower-case letters only, other characters as blanks, blanks squeezed."""
    letters = F.regexp_replace(F.lower(text), r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def tokens(text: Column, shortest: int = 4) -> Column:
    """Whole words of at least ``shortest`` plain letters; words with other letters are left out."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda word: word.rlike(f"^[a-z]{{{shortest},}}$"))


def ngrams(words: Column, longest: int) -> Column:
    """All runs of one to ``longest`` neighbouring words.

    Longer runs are zipped from shorter ones and the shifted words, so the cost is linear in the text.
    """
    runs = [words]
    for size in range(2, longest + 1):
        count = F.greatest(F.size(words) - (size - 1), F.lit(0))
        heads = F.slice(runs[-1], F.lit(1), count)
        runs.append(F.zip_with(heads, F.slice(words, F.lit(size), count), _pair))
    return F.concat(*runs)


def _pair(head: Column, word: Column) -> Column:
    return F.concat(head, F.lit(" "), word)


def titled(text: Column) -> Column:
    return F.initcap(text)
