"""Tokenizers, predicates and cleaners as Column expressions; no UDF anywhere.

Java's ``(?U)`` makes ``\\s``, ``\\w`` and ``\\b`` Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ASCII punctuation that the stripping tokenizer deletes (all but - and _).
PUNCTUATION = "!\"#$%&'()*+,./:;<=>?@[\\]^`{|}~"

#: Fixed value: stopwords of the vocabulary and of query words.
STOPWORDS = sorted(set(
    "a an the and or but if because as what which this that these those then just so than such both through about "
    "against between into throughout during before after above below to from up upon down in out on off over under "
    "again further once here there when where why how all any each few more most other some no nor not only own same "
    "too very s t can will don should now is are was were be been being have has had having do does did doing "
    "b c d e f g h i j".split()
))

#: Fixed value: what marks a line as a citation.
CITATION = r"(?i)\[\d{1,3}\]|\b\d{4}[a-z]?\)|\bet\s+al\.?|arXiv:\d|\bdoi[:/]|\bpp\.\s*\d|\bvol\.\s*\d|\bISSN\b|\bISBN\b"


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased, split at white space; punctuation stays."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def plain_tokens(text: Column) -> Column:
    """Split at white space, case kept: the word-level tokenizer of the chunker."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def stripped_tokens(text: Column) -> Column:
    """Lower-cased, punctuation but ``-`` and ``_`` deleted, words of two characters or more."""
    return F.filter(F.split(F.translate(F.lower(text), PUNCTUATION, ""), r"(?U)\s+"), lambda t: F.length(t) >= 2)


def word_tokens(text: Column) -> Column:
    """Runs of word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def alpha_tokens(text: Column) -> Column:
    """Lower-cased white-space tokens of two letters or more and nothing else, no stopwords."""
    return F.filter(whitespace_tokens(text), lambda t: t.rlike(r"^\p{L}+$") & (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def query_words(query: Column) -> Column:
    """Distinct lower-cased words of two characters or more, in order, without stopwords."""
    found = F.regexp_extract_all(query, F.lit(r"(?U)\b[a-zA-Z0-9\-_]{2,}\b"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda w: ~w.isin(STOPWORDS)))


def entities(query: Column) -> Column:
    """Acronyms, hyphenated terms and quoted phrases; in this order, each by position."""
    acronyms = F.regexp_extract_all(query, F.lit(r"(?U)\b[A-Z]{2,}\b"), F.lit(0))
    hyphens = F.regexp_extract_all(query, F.lit(r"(?U)\b[A-Za-z0-9\.]+(?:-[A-Za-z0-9\.]+)+\b"), F.lit(0))
    quotes = F.regexp_extract_all(query, F.lit(r'"([^"]+)"'), F.lit(1))
    return F.array_distinct(F.concat(acronyms, hyphens, quotes))


def _capitalised(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"), F.lit(0))


def names(query: Column) -> Column:
    """Runs of capitalised words, lower-cased, distinct."""
    return F.array_distinct(F.transform(_capitalised(query), F.lower))


def wide_entities(query: Column) -> Column:
    """Also runs of capitalised words and single quotes; trimmed, lower-cased, distinct."""
    single = F.regexp_extract_all(query, F.lit(r"'([^']+)'"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(entities(query), _capitalised(query), single), lambda x: F.lower(strip(x))), lambda x: x != ""))


def non_entity_words(query: Column) -> Column:
    return F.array_except(query_words(query), F.transform(entities(query), F.lower))


def without_stopwords(query: Column) -> Column:
    """The query's tokens without stopwords, joined; the query itself if none is left."""
    left = F.filter(whitespace_tokens(query), lambda t: ~t.isin(STOPWORDS))
    return F.when(F.size(left) > 0, F.array_join(left, " ")).otherwise(query)


def citation_ratio(text: Column) -> Column:
    """Share of lines with words that look like citations; zero without lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.rlike(CITATION))) / F.size(lines)).otherwise(0.0)


def is_reference_block(text: Column, threshold: float = 0.3) -> Column:
    return citation_ratio(text) > threshold


def sentences(text: Column) -> Column:
    """Split behind a full stop, exclamation or question mark and white space."""
    return F.split(text, r"(?<=[.!?])(?U)\s+")


def first_chars(text: Column, n: int = 2000) -> Column:
    return F.substring(text, 1, n)


def first_words(text: Column, n: int = 250) -> Column:
    """The first n words and an ellipsis, or the text if it has no more."""
    return bind(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""), lambda w: F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))).otherwise(text))


def normalised(text: Column) -> Column:
    """Lower-cased, white space collapsed to single spaces."""
    return F.array_join(whitespace_tokens(text), " ")


def unfenced(text: Column) -> Column:
    """Model output without a Markdown code fence."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def json_part(text: Column) -> Column:
    """The JSON of model output: thoughts dropped, then the fenced block, then the widest array or object."""
    thought = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    pick = lambda p, g: F.nullif(F.regexp_extract(thought, p, g), F.lit(""))
    return strip(F.coalesce(pick(r"(?s)```(?:json)?\s*(.*?)```", 1), pick(r"(?s)\[.*\]", 0), pick(r"(?s)\{.*\}", 0), thought))


def json_object(text: Column) -> Column:
    """The JSON object of model output: thoughts dropped, then the fenced block, then the widest object."""
    thought = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    pick = lambda p, g: F.nullif(F.regexp_extract(thought, p, g), F.lit(""))
    return strip(F.coalesce(pick(r"(?s)```(?:json)?\s*(.*?)```", 1), pick(r"(?s)\{.*\}", 0), thought))


def parent_block(chunk_id: Column, parent_id: Column | None = None) -> Column:
    """Parent of a chunk or bridge id: what precedes its last ``_chunk`` or ``_bridge``."""
    part = lambda p: F.nullif(F.regexp_extract(chunk_id, p, 1), F.lit(""))
    other = [] if parent_id is None else [parent_id]
    return F.coalesce(part("^(.*)_chunk"), part("^(.*)_bridge"), *other)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; zero if there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def with_acronyms(query: Column) -> Column:
    """The query's tokens without stopwords; acronyms stay though a stopword spells like them."""
    left = F.filter(plain_tokens(query), lambda t: ~F.lower(t).isin(STOPWORDS) | t.rlike("^[A-Z]{2,}$"))
    return F.when(F.size(left) > 0, F.array_join(left, " ")).otherwise(query)


def overlap_label(overlap: Column) -> Column:
    """How far a paraphrase is from its original; null, a failed paraphrase, counts as overlap 1."""
    return F.when(overlap.isNull(), "failed").when(overlap > 0.8, "low_gap").when(overlap < 0.2, "high_gap").otherwise("good")


def repeated_tokens(term: Column, reps: Column) -> Column:
    """A term's tokens, repeated."""
    return F.flatten(F.array_repeat(F.filter(F.split(term, r"(?U)\s+"), lambda t: t != ""), reps.cast("int")))


def round_half(value: Column, digits: int) -> Column:
    """A double rounded as DuckDB's ``round`` does: its product with the power of ten, halves away from zero."""
    return F.round(value * float(10**digits), 0) / float(10**digits)


def round_binary(value: Column, digits: int = 2) -> Column:
    """A double in [0, 1] rounded by its binary value, ties to even, as Python's ``round`` does.

    ``bround`` rounds the shortest decimal that prints the number: 0.175 is below the tie.
    """
    whole = F.lit(1 << 60).cast("decimal(20,0)")
    scaled = (value * F.lit(float(1 << 60))).cast("long").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(4,0)")
    low = F.floor(scaled / whole).cast("decimal(20,0)")
    twice = (scaled - low * whole) * F.lit(2).cast("decimal(2,0)")
    up = (twice > whole) | ((twice == whole) & (low % 2 == 1))
    return (low.cast("double") + F.when(up, 1.0).otherwise(0.0)) / float(10**digits)
