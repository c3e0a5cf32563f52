"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is 13 consecutive words of an item (a shorter item is one window). Windows and documents are sets of positioned
shingles of five words (of the window's length, if shorter). A window lies in a document only if all its shingles do, so
one shingle is a sufficient prefix: the rarest by how often it occurs in the documents. Only occurrences of that shingle
make candidates; they are held to the positional and length bounds, and then the words themselves are compared.

Cases: null or wordless texts have no words and are never contaminated; wordless items have no windows. Rows that agree
in doc_id and text get the same result; rows that share only the doc_id are judged one by one. An item without id still
marks words as hit but is not listed. With an empty benchmark nothing is hit. Columns the caller brings are untouched.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import cut_lineage
from .common import broadcast_if_small, packed

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 5


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else. `lower` does just that unless there are other capitals."""
    others = text.rlike(r"[\p{Lu}\p{Lt}\p{IsUppercase}&&[^A-Z]]")
    return F.when(others, F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def shingle(tokens: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(tokens, at + j) for j in range(length)])


def shingles(tokens: Column, length: int) -> Column:
    """Hashes of all runs of `length` words, in order; empty for shorter texts."""
    return F.when(F.size(tokens) >= length, F.transform(
        F.sequence(F.lit(0), F.size(tokens) - length), lambda i: shingle(tokens, i, length))).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """item, window (its words, joined by a space), len."""
    cut = items.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return (cut.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(width)))).alias("w"))
            .select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("len")).distinct())


def occurrences(docs: DataFrame, items: DataFrame, width: int = WINDOW, length: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Per (_id, _t) of a document the verified windows in it, as `found` (array of start, len, window); and the item windows."""
    pairs = cut_lineage(item_windows(items, width))
    windows = pairs.select("window", "len").distinct()
    lengths = sorted({min(r[0], length) for r in windows.select("len").distinct().where(F.col("len") < length).collect()} | {length})

    tokens = windows.select("window", "len", F.split("window", " ").alias("w"))
    parts = [tokens.where(F.least("len", F.lit(length)) == k).select("window", "len", F.posexplode(shingles(F.col("w"), k)).alias("o", "token"))
             for k in lengths]
    tokens = parts[0]
    for more in parts[1:]:
        tokens = tokens.unionByName(more)
    tokens = cut_lineage(tokens)

    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"), F.col("text").alias("_text"))
    split = keyed.select("_id", "_t", words(F.col("_text")).alias("w"))
    wanted = broadcast_if_small(cut_lineage(tokens.select("token").distinct()))
    probes = [split.select("_id", "_t", F.size("w").alias("n"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "token")).join(wanted, "token")
              for k in lengths]
    hits = probes[0]
    for more in probes[1:]:
        hits = hits.unionByName(more)
    hits = cut_lineage(hits)

    # Rarity is counted over all documents; a window with a shingle that never occurs cannot occur itself.
    seen = hits.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    ordered = tokens.join(seen, "token", "left")
    prefix = (ordered.groupBy("window", "len").agg(F.min(F.coalesce("times", F.lit(0))).alias("least"),
                                                   F.min_by(F.struct("token", "o"), F.struct("times", "token", "o")).alias("p"))
              .where("least > 0").select("window", "len", "p.token", "p.o"))
    prefix = broadcast_if_small(cut_lineage(prefix))

    start = F.col("pos") - F.col("o")
    candidates = (hits.join(prefix, "token").where((start >= 0) & (start + F.col("len") <= F.col("n")))
                  .groupBy("_id", "_t").agg(F.collect_set(F.struct(start.alias("start"), "len", "window")).alias("c")))
    texts = keyed.withColumnsRenamed({"_id": "_i", "_t": "_u"})
    met = candidates.join(texts, candidates["_id"].eqNullSafe(texts["_i"]) & (candidates["_t"] == texts["_u"]))
    met = met.select("_id", "_t", "c", words(F.col("_text")).alias("w"))
    exact = F.filter("c", lambda x: F.array_join(F.slice("w", x["start"] + 1, x["len"]), " ") == x["window"])
    found = met.select("_id", "_t", exact.alias("found")).where(F.size("found") > 0).dropDuplicates(["_id", "_t"])
    return cut_lineage(found), pairs


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc (the caller's columns), n_words, n_hit, items (ids as sorted strings), contaminated."""
    found, pairs = occurrences(docs, items, width)
    hit = F.array_distinct(F.flatten(F.transform("found", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    marked = found.select("_id", "_t", F.size(hit).cast("long").alias("_hit"))
    named = (found.select("_id", "_t", F.explode(F.array_distinct(F.transform("found", lambda x: x["window"]))).alias("window"))
             .join(broadcast_if_small(pairs), "window").groupBy("_id", "_t")
             .agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("_items")))
    named = named.withColumnsRenamed({"_id": "_i", "_t": "_u"})
    judged = marked.join(named, marked["_id"].eqNullSafe(named["_i"]) & (marked["_t"] == named["_u"])).select("_id", "_t", "_hit", "_items")

    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(packed(docs).alias("doc"), F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_u"), count.alias("n_words"))
    joined = rows.join(judged, rows["_i"].eqNullSafe(judged["_id"]) & (rows["_u"] == judged["_t"]), "left")
    n_hit = F.coalesce("_hit", F.lit(0)).cast("long")
    return joined.select("doc", "n_words", n_hit.alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
                         ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with the caller's columns."""
    return contamination(docs, items, width).where(~F.col("contaminated")).select("doc.*")
