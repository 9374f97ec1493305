"""Operator 11: benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

Every word of a document that some test text uses is stored as a posting (term, document, position), sorted by
term inside the files its tasks write; postings never pass a shuffle on the way into the index. A test text is cut
into windows. The terms of a window are ordered by their number of postings; the list of the rarest term, moved back
by the term's place in the window, gives the starts that are possible. The second list, moved likewise, is
intersected with them, and what is left with the remaining lists, which by then are read for few documents. A
start that all lists agree on is an exact phrase; with ``slack`` a term may also stand that many words off its
place, and the match says how far it strays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableproof.llm.common import LOWER, UPPER, settled

#: What separates words: ASCII but for digits and lower-case letters, once A-Z are lower-cased.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in order; a null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def tokens_of(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``tid, k0.., n_words, words``: one row for each row of ``docs``, under a number of its own."""
    rows = docs.select(F.monotonically_increasing_id().alias("tid"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                       words_of(F.col(f"`{text}`")).alias("words"))
    return settled(rows.withColumn("n_words", F.size("words").cast("long")), "tokens")


def windows_of(items: DataFrame, item_id: str, text: str, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct windows ``w, n, words``, their items ``w, item``, and the vocabulary ``word, term``.

    Windows are ``width`` consecutive words; a text of fewer words, but not none, is one window."""
    rows = items.select(F.col(f"`{item_id}`").alias("item"), words_of(F.col(f"`{text}`")).alias("words")).filter(F.size("words") > 0)
    starts = rows.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("s"))
    cut = settled(starts.select("item", F.slice("words", F.col("s") + 1, width).alias("words")), "cut")
    windows = settled(cut.select("words").distinct().select(
        F.monotonically_increasing_id().alias("w"), F.size("words").alias("n"), "words"), "windows")
    pairs = cut.join(windows, "words").select("w", "item").distinct()
    words = windows.select(F.explode("words").alias("word")).distinct()
    return windows, settled(pairs, "window-items"), settled(words.select("word", F.monotonically_increasing_id().alias("term")), "vocabulary")


def positional_index(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings ``term, tid, pos`` of the vocabulary's words, in files sorted by term."""
    places = tokens.select("tid", F.posexplode("words").alias("pos", "word")).join(vocabulary, "word")
    return settled(places.select("term", "tid", "pos").sortWithinPartitions("term", "tid", "pos"), "postings")


def ranked_terms(windows: DataFrame, vocabulary: DataFrame, postings: DataFrame) -> DataFrame:
    """``w, n, rank, off, term``: a window's terms, the rarest first; windows with a term that has no posting are gone."""
    lengths = settled(postings.groupBy("term").agg(F.count("*").alias("postings")), "lengths")
    terms = windows.select("w", "n", F.posexplode("words").alias("off", "word")).join(vocabulary, "word").join(lengths, "term", "left")
    by = Window.partitionBy("w")
    rows = terms.withColumn("whole", F.count("postings").over(by) == F.col("n")).filter("whole")
    order = by.orderBy("postings", "off")
    return settled(rows.select("w", "n", F.row_number().over(order).alias("rank"), "off", "term"), "ranked")


def intersected(found: DataFrame, terms: DataFrame, postings: DataFrame, slack: int) -> DataFrame:
    """Starts ``tid, w, n, start, distance`` of ``found`` that all lists of ``terms`` agree on.

    ``terms`` has some ranks of each window; a window that has none of them passes as it is."""
    probes = found.join(terms.select("w", "rank", "off", "term"), "w")
    shifts = F.explode(F.sequence(F.lit(-slack), F.lit(slack))) if slack else F.lit(0)
    probes = probes.select("tid", "w", "n", "start", "distance", "rank", "term", "off", shifts.alias("shift"))
    probes = probes.withColumn("pos", F.col("start") + F.col("off") + F.col("shift"))
    met = probes.join(postings, ["tid", "pos", "term"], "left_semi")
    if slack:
        met = met.groupBy("tid", "w", "n", "start", "distance", "rank").agg(F.min(F.abs("shift")).alias("shift"))
    agreed = met.groupBy("tid", "w", "n", "start", "distance").agg(F.count("*").alias("lists"), F.max("shift").alias("most"))
    wanted = terms.groupBy("w").agg(F.count("*").alias("wanted"))
    kept = agreed.join(wanted, "w").filter(F.col("lists") == F.col("wanted")).select(
        "tid", "w", "n", "start", F.greatest("distance", "most").alias("distance"))
    return kept.unionByName(found.join(wanted, "w", "left_anti").select(kept.columns))


def matches(postings: DataFrame, ranked: DataFrame, slack: int = 0) -> DataFrame:
    """``tid, w, n, start, distance``: where the windows of ``ranked`` occur.

    ``distance`` 0 is an exact phrase starting at word ``start``; up to ``slack``, each word stands within that many
    words of its place, the rarest one on it."""
    first = ranked.filter("rank = 1").select("w", "n", "off", "term")
    found = postings.join(first, "term").select("tid", "w", "n", (F.col("pos") - F.col("off")).alias("start"), F.lit(0).alias("distance"))
    found = settled(found if slack else found.filter("start >= 0"), "starts")
    for ranks in ("rank = 2", "rank > 2"):
        terms = ranked.filter(ranks)
        # only lists that are asked for, of documents that are still in question; the terms are written first, so that
        # where they are too many to be broadcast both sides are dealt anew and a long list can be split
        lists = postings.join(settled(terms.select("term").distinct(), "terms"), "term", "left_semi")
        if ranks != "rank = 2":
            left = settled(found.select("tid").distinct(), "documents-left")
            lists = lists.join(left, "tid", "left_semi")
        found = settled(intersected(found, terms, lists, slack), "intersected")
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", width: int = 10, slack: int = 0) -> tuple[DataFrame, DataFrame]:
    """Documents ``doc_id, n_words, n_hit, items, n_near`` and matches ``tid, doc_id, item, start, n, distance``.

    ``n_hit`` counts the words covered by an exact occurrence of a window, ``items`` lists the test items with an
    exact occurrence, ``n_near`` counts those that occur only nearly (within ``slack``).

    Null and empty texts have no words and no hits; very long texts are cut into postings as any other. Repeated rows
    and rows that share an id are judged by themselves; repeated items and windows are searched once. An item without an
    id hits words but is not listed. Either table may be empty. Further columns are not read, so names may clash."""
    tokens = tokens_of(docs, text, [doc_id])
    windows, pairs, vocabulary = windows_of(benchmark, item_id, item_text, width)
    postings = positional_index(tokens, vocabulary)
    found = matches(postings, ranked_terms(windows, vocabulary, postings), slack)
    exact = found.filter("distance = 0")
    covered = exact.select("tid", "start", "n").distinct().select("tid", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos"))
    hits = covered.distinct().groupBy("tid").agg(F.count("*").alias("n_hit"))
    near = found.select("tid", "w", (F.col("distance") == 0).alias("is_exact")).distinct().join(pairs, "w")
    by_item = near.filter("item IS NOT NULL").groupBy("tid", "item").agg(F.max("is_exact").alias("is_exact"))
    items = by_item.groupBy("tid").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_exact"), F.col("item").cast("string")))).alias("items"),
        F.count_if(~F.col("is_exact")).alias("n_near"))
    rows = tokens.select("tid", "k0", "n_words").join(hits, "tid", "left").join(items, "tid", "left")
    out = rows.select(F.col("k0").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    placed = found.join(pairs, "w").join(tokens.select("tid", F.col("k0").alias(doc_id)), "tid").select(
        "tid", doc_id, "item", "start", "n", "distance")
    return out, placed
