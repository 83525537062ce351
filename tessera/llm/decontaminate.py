"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Words are runs of ASCII letters and digits (A-Z lowered) and of all other non-ASCII characters. A benchmark item gives
its windows of 13 consecutive words, a shorter one a single item-sized window. Windows and texts are compared as sets of
positioned word shingles. Every shingle of the benchmark is counted over all documents; a window's necessary prefix is
its rarest shingle, since a text that holds the window holds that one too. Documents meet windows on that token alone;
the position of the match gives the only possible start, which must lie inside the text by its length. A candidate is
verified exactly, word for word, by the shingles that tile the window at their own positions.

Defined cases: null and empty texts have no words; empty tables give no hits; item_ids that are null still mark words
but are not listed; repeated items count once; repeated documents each get their row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.staging import staged

#: What lies between words; splitting at it is many times faster than extracting words by a pattern.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, SHINGLE = 13, 5
#: A token set of at most so many rows (about 50 MB) is sent to all executors; a larger one is joined by shuffling.
BROADCAST_TOKENS = 500_000
#: Each document also gives one mark (a blank and a number; no shingle starts with a blank) that carries its word count.
MARKS = 4096


def ascii_lower(text: Column) -> Column:
    """Lowers A-Z only; the fast built-in serves texts without other letters."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _tiles(words: Column, size: int) -> Column:
    """All runs of so many consecutive words, joined by a space (no word holds one)."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(items: item_id, win) and (windows: win, n_win, k, shingles), each distinct."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    sized = words.withColumn("n_win", F.least(F.size("words"), F.lit(window)))
    cut = sized.select("item_id", F.explode(F.expr("transform(sequence(1, size(words) - n_win + 1), i -> slice(words, i, n_win))")).alias("w"))
    cut = staged(cut.select("item_id", F.array_join("w", " ").alias("win"), "w").distinct(), "windows")
    windows = cut.select("win", "w").dropDuplicates(["win"]).select("win", F.size("w").alias("n_win"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w")
    windows = windows.withColumn("shingles", F.expr("transform(sequence(1, n_win - k + 1), i -> array_join(slice(w, i, k), ' '))")).drop("w")
    return cut.select("item_id", "win"), windows


def _matches(docs: DataFrame, tokens: Callable[[DataFrame], DataFrame], sizes: list[int]) -> DataFrame:
    """Positions in the documents of every benchmark shingle, and a mark of every document: the one pass over the texts."""
    held = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("words"))
    mark = F.array(F.concat(F.lit(" "), F.pmod(F.xxhash64("id", "th"), F.lit(MARKS)).cast("string")))
    if len(sizes) == 1:
        rows = held.select("id", "th", F.size("words").alias("n"), F.posexplode(F.concat(_tiles(F.col("words"), sizes[0]), mark)).alias("pos", "shingle"))
    else:  # the shingles of all sizes, from one array of words
        placed = lambda tiles: F.transform(tiles, lambda x, i: F.struct(i.alias("pos"), x.alias("shingle")))
        rows = held.select("id", "th", F.size("words").alias("n"), F.explode(F.concat(*[placed(_tiles(F.col("words"), k)) for k in sizes], placed(mark))).alias("s")).select("id", "th", "n", "s.*")
    marks = docs.sparkSession.range(MARKS).select(F.concat(F.lit(" "), F.col("id").cast("string")).alias("shingle"))
    return rows.join(tokens(marks), "shingle", "left_semi")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(hits: id, th (hash of the text), n (words), n_hit and items (sorted item_ids) of each distinct document with a hit; rows: id, th and n of every row)."""
    items, windows = item_windows(benchmark, window)
    windows = staged(windows, "prefixes")
    tiles = windows.select("win", "n_win", "k", F.posexplode("shingles").alias("off", "shingle"))
    tokens = tiles.select("shingle").distinct()
    sizes = sorted(r[0] for r in windows.select("k").distinct().collect()) or [SHINGLE]
    small = tokens.count() <= BROADCAST_TOKENS
    passed = staged(_matches(docs, lambda marks: F.broadcast(tokens.union(marks)) if small else tokens.union(marks), sizes), "matches")
    is_mark = F.col("shingle").startswith(" ")
    found = passed.filter(~is_mark)

    counts = found.groupBy("shingle").agg(F.count("*").alias("seen"))
    ranked = tiles.join(counts, "shingle", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    prefix = ranked.groupBy("win", "n_win", "k").agg(F.min(F.struct("seen", "shingle", "off")).alias("p"))
    prefix = prefix.filter(F.col("p.seen") > 0).select("win", "n_win", "k", F.col("p.shingle").alias("shingle"), F.col("p.off").alias("off"))

    start = F.col("pos") - F.col("off")
    tried = found.join(prefix, "shingle").filter((start >= 0) & (start + F.col("n_win") <= F.col("n"))).select("id", "th", "n", start.alias("start"), "win", "n_win", "k").distinct()
    # the shingles at 0, k, 2k, ... and at the end tile the window: all of its words are compared
    offsets = F.expr("array_distinct(concat(sequence(0, n_win - k, k), array(n_win - k)))")
    wanted = tried.select("*", F.size(offsets).alias("need"), F.explode(offsets).alias("off")).withColumn("pos", F.col("start") + F.col("off"))
    wanted = wanted.join(tiles.select("win", "off", "shingle"), ["win", "off"])
    there = found.select(F.col("id").alias("m_id"), F.col("th").alias("m_th"), F.col("pos").alias("m_pos"), F.col("shingle").alias("m_shingle")).distinct()
    same = wanted.id.eqNullSafe(there.m_id) & (wanted.th == there.m_th) & (wanted.pos == there.m_pos) & (wanted.shingle == there.m_shingle)
    verified = wanted.join(there, same, "left_semi").groupBy("id", "th", "n", "start", "win", "n_win", "need").agg(F.count("*").alias("got")).filter("got = need")
    verified = staged(verified.select("id", "th", "n", "start", "win", "n_win"), "contained")

    spans = verified.groupBy("id", "th", "n", "start").agg((F.col("start") + F.max("n_win")).alias("stop"))
    before = Window.partitionBy("id", "th").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("seen", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hits = fresh.groupBy("id", "th", "n").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "seen"))).cast("long").alias("n_hit"))
    named = verified.select("id", "th", "win").distinct().join(items, "win").groupBy("id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    named = named.select(F.col("id").alias("i_id"), F.col("th").alias("i_th"), "items")
    hits = hits.join(named, hits.id.eqNullSafe(named.i_id) & (hits.th == named.i_th), "left").select("id", "th", "n", "n_hit", "items")
    return hits, passed.filter(is_mark).select(F.col("id").alias("doc_id"), F.col("th").alias("d_th"), F.col("n").cast("long").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (array of item_ids), contaminated."""
    hits, rows = contamination(docs, benchmark, window)
    joined = rows.join(hits, rows.doc_id.eqNullSafe(hits.id) & (rows.d_th == hits.th), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", F.col("d_th").alias("text_hash"), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows, columns as they were."""
    hits, _ = contamination(docs, benchmark)
    hits = hits.select(F.col("id").alias("__id"), F.col("th").alias("__h_th"), F.col("n").alias("__n"), F.col("n_hit").alias("__hit"))
    marked = docs.withColumn("__th", F.xxhash64("text"))
    joined = marked.join(hits, marked["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h_th")), "left")
    clean = F.col("__hit").isNull() | (20 * F.col("__hit") < F.col("__n"))
    return joined.filter(clean).select(*[marked[f"`{c}`"] for c in docs.columns])
