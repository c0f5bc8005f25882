"""Building blocks of catalog search: documents, substring matching, BM25 postings."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text

# Up to this many distinct tokens are tested in one pass over the documents.
INLINE_TOKENS = 256
_SALTS = 32
_GRAM = 24  # a longer token is looked for by its first characters
_PIECE = 64
_BROADCAST_ROWS, _BROADCAST_BYTES = 100_000, 8 * 2**20
_K1, _B = 1.2, 0.75  # the usual BM25 parameters


def build_search_docs(datasets: DataFrame) -> DataFrame:
    """``(dataset_id, content)``: the text every dataset is searched by."""
    return datasets.select(
        F.col("id").alias("dataset_id"), text.search_content(datasets).alias("content")
    )


def salted_join(many: DataFrame, few: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Inner join on ``key`` where one key may hold a large share of ``many``.

    Rows of a key in ``many`` are spread over 32 parts by another column and ``few`` is
    repeated once per part, so a hot key is worked on by 32 tasks.
    """
    parts = F.sequence(F.lit(0), F.lit(_SALTS - 1))
    spread = many.withColumn("_part", F.pmod(F.hash(spread_by), F.lit(_SALTS)))
    return spread.join(few.withColumn("_part", F.explode(parts)), [key, "_part"]).drop("_part")


def is_short(table: DataFrame) -> bool:
    """Measured: at most 100,000 rows and 8 MB in all columns, so fit to be broadcast."""
    row_bytes = F.octet_length(F.to_json(F.struct(*table.columns)))
    size = (
        table.limit(_BROADCAST_ROWS + 1)
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes).alias("bytes"))
        .first()
    )
    return size["rows"] <= _BROADCAST_ROWS and (size["bytes"] or 0) <= _BROADCAST_BYTES


def keyed_join(many: DataFrame, few: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Inner join on a text ``key`` with a side that is usually short.

    A short side is broadcast and ``many`` stays where it is; else the salted join moves
    both.
    """
    if is_short(few):
        return many.join(F.broadcast(few), key)
    return salted_join(many, few, key, spread_by)


def _grams(content: Column, *sizes: int) -> Column:
    """Runs of ``sizes`` characters without gaps, repeats kept; size 0 gives the empty run.

    Runs lie within words, so the distinct words of a text are cut up instead of the text. Long
    words are cut into overlapping pieces first, so the work grows with the text only.
    """
    lengths = sorted(n for n in sizes if n)
    found = [F.array(F.lit(""))] if 0 in sizes else []
    if lengths:
        word = f"[^{text.GAP_CHARACTERS}]"
        piece = f"(?=({word}{{1,{_PIECE + lengths[-1] - 1}}})){word}{{1,{_PIECE}}}"
        pieces = F.array_distinct(F.regexp_extract_all(content, F.lit(piece), F.lit(1)))

        def runs(of: Column, size: int) -> Column:
            starts = F.sequence(F.lit(1), F.length(of) - (size - 1))
            cut = F.transform(starts, lambda i: F.substring(of, i, F.lit(size)))
            return F.when(F.length(of) >= size, cut).otherwise(F.array().cast("array<string>"))

        cuts = F.transform(pieces, lambda of: F.concat(*[runs(of, n) for n in lengths]))
        found.append(F.flatten(cuts))
    return F.concat(*found)


def _anchors(tokens: DataFrame) -> DataFrame:
    """Tokens with ``gram``: up to 24 characters any matching text must contain.

    They come from the longest run without wildcards and gaps; a token of those only has an
    empty gram, which every text contains. A token is ``exact`` if it is its gram, so that a
    text with the gram matches it.
    """
    runs = F.split("token", f"[%_{text.GAP_CHARACTERS}]")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    wild = F.like("token", F.lit("%\\%%")) | F.like("token", F.lit("%\\_%"))
    found = tokens.withColumn("gram", F.substring(longest["run"], 1, _GRAM))
    return found.withColumn("exact", ~wild & (F.col("gram") == F.col("token")) & (F.col("token") != ""))


def like_join_by_grams(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``like_join`` for any number of tokens.

    Texts meet tokens on a shared character run. A token that is such a run is found by that;
    for others, longer or with wildcards, the candidates, which include every true match, are
    then checked against the whole text. With a short list of tokens, each document is cut to
    the runs that are asked for inside its own row and the texts are not moved; a longer list
    is joined by shuffles.
    """
    anchors = _anchors(tokens.select("token").distinct())
    kinds = anchors.select("exact", F.length("gram")).distinct().collect()  # at most 2 * 25
    sizes = {exact: [n for kind, n in kinds if kind == exact] for exact, _ in kinds}
    short = is_short(anchors)
    content = F.col("content")
    parts = []
    if True in sizes:
        exact = anchors.filter("exact").select("token")
        grams = _grams(content, *sizes[True])
        if short:
            asked = exact.agg(F.collect_set("token").alias("tokens")).scalar()
            parts.append(docs.select(F.explode(F.array_intersect(grams, asked)).alias("token"), "dataset_id"))
        else:
            met = salted_join(docs.select(F.explode(F.array_distinct(grams)).alias("token"), "dataset_id"), exact, "token", "dataset_id")
            parts.append(met.select("token", "dataset_id"))
    if False in sizes:
        rest = anchors.filter("not exact").select("token", "gram")
        grams = _grams(content, *sizes[False])
        if short:
            asked = rest.agg(F.collect_set("gram").alias("grams")).scalar()
            found = docs.select(
                "dataset_id", "content", F.explode(F.array_intersect(grams, asked)).alias("gram")
            ).join(F.broadcast(rest), "gram")
        else:
            met = salted_join(docs.select("dataset_id", F.explode(F.array_distinct(grams)).alias("gram")), rest, "gram", "dataset_id")
            found = met.select("token", "dataset_id").distinct().join(docs, "dataset_id")
        parts.append(found.filter(text.matches_column(content, F.col("token"))).select("token", "dataset_id"))
    if not parts:
        return docs.select(F.lit("").alias("token"), "dataset_id").limit(0)
    return reduce(DataFrame.unionByName, parts)


def like_join_inline(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """``like_join`` for a short list of tokens: one pass over the documents, no join."""
    found = [F.when(text.matches_literal(F.col("content"), t), F.lit(t)) for t in tokens]
    return docs.select(
        F.explode(F.array_compact(F.array(*found))).alias("token"), "dataset_id"
    )


def like_join(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(token, dataset_id)`` for every distinct token that occurs in a document.

    The number of distinct tokens is looked at first: a short list is tested in one pass
    over the documents, a longer one goes through the gram join. Both give all matches.
    """
    head = tokens.select("token").distinct().limit(INLINE_TOKENS + 1).collect()
    if len(head) > INLINE_TOKENS:
        return like_join_by_grams(docs, tokens)
    if not head:
        return docs.select(F.lit("").alias("token"), "dataset_id").limit(0)
    return like_join_inline(docs, sorted(r["token"] for r in head))


class Index(NamedTuple):
    """A BM25 index.

    ``postings(term, dataset_id, tf, dl)``, ``terms(term, df)``, and one row
    ``corpus(docs, avgdl)``; ``buckets`` is set for a stored index, whose postings and
    terms lie in folders by a hash of the term.
    """

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    buckets: int | None = None


def postings_rows(docs: DataFrame) -> DataFrame:
    """``(term, dataset_id, tf, dl)``.

    A document's terms are sorted inside its row and run lengths give the term counts, so
    no shuffle is needed; the document length is repeated in each row, so scoring needs no
    second join.
    """
    termed = docs.select("dataset_id", text.sorted_terms(F.col("content")).alias("terms"))
    sized = termed.withColumn("dl", F.size("terms"))
    # Positions where a new term starts; the distance to the next one is its count.
    positions = F.when(F.col("dl") > 0, F.sequence(F.lit(1), F.col("dl")))
    starts = F.filter(
        positions,
        lambda i: (i == 1) | (F.get("terms", i - 1) != F.get("terms", i - 2)),
    )
    runs = sized.withColumn("starts", starts)
    counted = F.transform(
        F.col("starts"),
        lambda s, i: F.struct(
            F.get("terms", s - 1).alias("term"),
            (F.coalesce(F.get("starts", i + 1), F.col("dl") + 1) - s).alias("tf"),
        ),
    )
    return runs.select("dataset_id", "dl", F.explode(counted).alias("p")).select(
        "p.term", "dataset_id", "p.tf", "dl"
    )


def corpus_counts(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: the number of documents and of all their terms."""
    counted = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    terms = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("terms"))
    return terms.select(counted.alias("docs"), "terms")


def averages(counts: DataFrame) -> DataFrame:
    return counts.select("docs", F.try_divide("terms", "docs").alias("avgdl"))


def term_frequencies(postings: DataFrame) -> DataFrame:
    """In how many documents each term occurs."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def build_inverted_index(docs: DataFrame) -> Index:
    """The index of search documents ``(dataset_id, content)``, computed when it is used."""
    postings = postings_rows(docs)
    return Index(postings, term_frequencies(postings), averages(corpus_counts(docs, postings)))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _only(table: DataFrame, index: Index, terms: list[str]) -> DataFrame:
    found = table.filter(F.col("term").isin(terms))
    if index.buckets:
        folders = [bucket_of(F.lit(t), index.buckets) for t in terms]
        found = found.filter(F.col("bucket").isin(folders)).drop("bucket")
    return found


def postings_of(index: Index, terms: list[str]) -> DataFrame:
    """Postings of a few terms with their ``df``; a stored index is read by folder."""
    frequencies = _only(index.terms, index, terms)  # at most one row per asked term
    return _only(index.postings, index, terms).join(F.broadcast(frequencies), "term")


def _in_folders(table: DataFrame, index: Index, terms: DataFrame) -> DataFrame:
    if not index.buckets:
        return table
    # No more numbers than there are buckets; as literals they prune the folders to read.
    folders = terms.select(bucket_of(F.col("term"), index.buckets).alias("bucket")).distinct()
    numbers = sorted(row["bucket"] for row in folders.collect())
    return table.filter(F.col("bucket").isin(numbers)).drop("bucket")


def postings_join(index: Index, terms: DataFrame) -> DataFrame:
    """Postings of the given terms, with every other column of ``terms``.

    Postings of a stored index are cut down to the folders the terms are in.
    """
    postings = _in_folders(index.postings, index, terms)
    return keyed_join(postings, terms, "term", "dataset_id")


def bm25_part(tf: Column, df: Column, dl: Column, docs: Column, avgdl: Column) -> Column:
    """The share of one term in a BM25 score."""
    idf = F.log(1 + (docs - df + 0.5) / (df + 0.5))
    return idf * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * dl / avgdl))


def with_bm25_share(postings: DataFrame, index: Index) -> DataFrame:
    """Adds ``share``, what a posting with its ``df`` adds to the score."""
    totals = index.corpus.select(F.struct("docs", "avgdl").alias("totals")).scalar()
    share = bm25_part(
        F.col("tf"), F.col("df"), F.col("dl"), F.col("totals.docs"), F.col("totals.avgdl")
    )
    return postings.withColumn("totals", totals).withColumn("share", share)


def bm25_scores(index: Index, query_terms: DataFrame) -> DataFrame:
    """``(query_id, id, score)`` for ``query_terms(query_id, term)`` without repeats.

    Scores are rounded to 6 places before anything is ranked by them, so the order in
    which shares were added cannot change a ranking.
    """
    weighted = query_terms.join(_in_folders(index.terms, index, query_terms), "term")
    return (
        with_bm25_share(postings_join(index, weighted), index)
        .groupBy("query_id", F.col("dataset_id").alias("id"))
        .agg(F.round(F.sum("share"), 6).alias("score"))
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term)``: the distinct BM25 terms of each query."""
    terms = F.array_distinct(text.sorted_terms(F.lower("query")))
    return queries.select("query_id", F.explode(terms).alias("term"))


def query_words(queries: DataFrame) -> DataFrame:
    """``(query_id, token, weight)``: the words of each query and how often it has them."""
    words = queries.select("query_id", F.explode(text.query_tokens(F.col("query"))).alias("token"))
    return words.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("weight"))
