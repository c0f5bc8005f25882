"""Text expressions. Each one is a composition of built-in Spark functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that separate words, and those that end a line.
GAP_CHARACTERS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_GAP = f"[{GAP_CHARACTERS}]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# A BM25 term is a run of letters and digits.
TERM = r"[\p{L}\p{N}]+"

# LIKE must treat a backslash as plain text, so the escape is a character no text holds.
_NO_ESCAPE = "\u0000"


def trim_gaps(text: Column) -> Column:
    """Strip separators of every kind at both ends."""
    return F.regexp_replace(text, f"^{WORD_GAP}|{WORD_GAP}$", "")


def query_tokens(text: Column) -> Column:
    """Lower-cased words in order; a repeated word stays repeated."""
    return F.array_remove(F.split(F.lower(text), WORD_GAP), "")


def token_count(text: Column) -> Column:
    """Number of words; 0 for NULL and for blank text."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    return F.when(text.isNull(), 0).otherwise(F.size(words))


def score_log(tokens: Column) -> Column:
    """Readme score that reaches 1.0 at 400 words on a log scale."""
    return F.when(
        tokens > 0, F.least(F.lit(1.0), F.log1p(tokens) / F.log1p(F.lit(400)))
    ).otherwise(F.lit(0.0))


def score_linear(tokens: Column) -> Column:
    """Readme score that reaches 1.0 at 50 words on a straight line."""
    return F.when(tokens > 0, F.least(F.lit(1.0), tokens / F.lit(50.0))).otherwise(F.lit(0.0))


def readme_headings(text: Column) -> Column:
    """``struct(title, description)`` found by walking the lines of a readme.

    The description is the first line that is no heading. The title is the latest
    heading (NULL when it is only ``#`` signs); the walk ends at the first
    non-heading line that has a title above it.
    """
    lines = F.filter(
        F.transform(F.split(text, LINE_END), trim_gaps), lambda line: line != ""
    )
    start = F.struct(
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.lit(False).alias("done"),
    )

    def step(seen: Column, line: Column) -> Column:
        is_heading = line.startswith("#")
        heading = F.nullif(trim_gaps(F.regexp_replace(line, "^#+", "")), F.lit(""))
        return F.when(seen["done"], seen).otherwise(
            F.struct(
                F.when(is_heading, heading).otherwise(seen["title"]).alias("title"),
                F.when(is_heading, seen["description"])
                .otherwise(F.coalesce(seen["description"], line))
                .alias("description"),
                (~is_heading & seen["title"].isNotNull()).alias("done"),
            )
        )

    folded = F.aggregate(lines, start, step)
    return F.struct(
        folded["title"].alias("title"), folded["description"].alias("description")
    )


def fingerprint(
    source: Column,
    ns_local_id: Column,
    readme_sha: Column,
    last_modified: Column,
    size_class: Column,
    license_class: Column,
) -> Column:
    """SHA-256 over six identifying values; a NULL counts as empty text."""
    parts = (source, ns_local_id, readme_sha, last_modified, size_class, license_class)
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def json_text_list(values: Column) -> Column:
    """A list as JSON text with ``", "`` between items; NULL stays NULL."""
    def quoted(item: Column) -> Column:
        one = F.to_json(F.array(item))
        return F.substring(one, F.lit(2), F.length(one) - 2)

    return F.concat(F.lit("["), F.array_join(F.transform(values, quoted), ", "), F.lit("]"))


def json_parse_list(text: Column) -> Column:
    """JSON text back to a list; bad or empty text gives NULL."""
    return F.from_json(text, "array<string>")


def search_content(df: DataFrame) -> Column:
    """The lower-cased text a dataset is searched by; missing parts stay as gaps."""
    parts = [F.col(c) for c in ("title", "description", "readme_text")]
    parts += [json_text_list(F.col(c)) for c in ("tags", "modalities", "languages")]
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def has_wildcard(token: str) -> bool:
    return "%" in token or "_" in token


def matches_literal(content: Column, token: str) -> Column:
    """Substring test for a token known while planning; ``%`` and ``_`` are wildcards."""
    if has_wildcard(token):
        return F.like(content, F.lit(f"%{token}%"), F.lit(_NO_ESCAPE))
    return F.contains(content, F.lit(token))


def matches_column(content: Column, token: Column) -> Column:
    """Substring test for a token held in a column, same wildcard rule."""
    return F.like(content, F.concat(F.lit("%"), token, F.lit("%")), F.lit(_NO_ESCAPE))


def match_score(content: Column, tokens: list[str]) -> Column:
    """How many tokens match; a token given twice counts twice."""
    hits = [
        F.when(matches_literal(content, t), tokens.count(t)).otherwise(0)
        for t in dict.fromkeys(tokens)
    ]
    return reduce(lambda a, b: a + b, hits)


def why_tokens(tokens: Column, content: Column) -> Column:
    """Tokens that literally occur in the text, in query order, repeats kept.

    The text is bound once, so it is not put together again for every token.
    """
    found = F.transform(
        F.array(content), lambda text: F.filter(tokens, lambda token: F.contains(text, token))
    )
    return F.get(found, F.lit(0))


def sorted_terms(content: Column) -> Column:
    """All BM25 terms of a text in sorted order, repeats kept."""
    return F.sort_array(F.regexp_extract_all(content, F.lit(TERM), F.lit(0)))

