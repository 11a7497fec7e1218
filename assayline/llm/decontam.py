"""Benchmark decontamination over a distributed positional inverted index of the training documents.

Test phrases and training documents meet as tables.  How often each test term is in the
whole training set is counted first, which gives each phrase its rarest and its second
rarest term.  Then the index is written: postings (term, document, block of positions,
positions) of the rarest terms, and of the test terms within reach of one, for no
phrase reaches further.  Each posting of a phrase's rarest term proposes a place for the
phrase; its second rarest term is looked up there with the offset between them
subtracted (exact phrases) or near it (proximity), and the other terms of what is left
are intersected by their offsets in the same way.

A document in the index is a text, by its MD5: copies are one.  Lists are cut into
blocks of ``SPAN`` positions, so neither a long text nor a frequent term makes a long
list, and all joins are on (document, term, block).  Terms are told apart by 64-bit
hashes.  The test set is never gathered: its terms filter the tokens in the tasks if there
are at most ``broadcast_terms`` of them; with more, all tokens go into the same joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from assayline.llm.common import ALNUM, map_texts, pin, unpin

#: A word of a lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Positions of a text that one posting list covers.
SPAN = 256
#: Test terms that filter tokens in the tasks (about a hundred bytes each), and found texts that are broadcast.
BROADCAST_TERMS, BROADCAST_TEXTS = 500_000, 100_000
#: Bytes of text whose words a task looks at together; words it counts before it passes counts on.
CHUNK_BYTES, COUNTED = 4 << 20, 1 << 20
RESULTS = ("n_words", "n_hit", "items", "near_items", "contaminated")


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters (lower-cased) and non-ASCII bytes."""
    return (text or b"").translate(ALNUM).split()


def term_hash(word: bytes) -> int:
    """What ``F.xxhash64`` gives for the word."""
    h = xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of some megabytes of text (the last column) or one row."""
    for batch in batches:
        sizes = np.cumsum([0, *(len(t) if (t := x.as_buffer()) is not None else 0 for x in batch.column(batch.num_columns - 1))])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def phrases_of(items: DataFrame, item_id: str, item_text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (phrase, terms as hashes) and the items (phrase, name) that have them."""
    lower = F.translate(F.coalesce(F.col(item_text).cast("string"), F.lit("")), UPPER, LOWER)
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w"))
    start = F.explode(F.sequence(F.lit(1), F.size("w") - F.least(F.size("w"), F.lit(window)) + 1))
    each = own.where(F.size("w") > 0).select("name", "w", start.alias("i")).select("name", F.slice("w", F.col("i"), F.least(F.size("w"), F.lit(window))).alias("w"))
    each = pin(each.select(F.unhex(F.md5(F.array_join("w", " "))).alias("phrase"), F.transform("w", lambda t: F.xxhash64(t)).alias("terms"), "w", "name").distinct())
    return each, each.select("phrase", "name")


def term_counts(texts: DataFrame, terms: DataFrame, filtered: bool) -> DataFrame:
    """(term, n) for ``terms`` (term, word): how often each is in all ``texts`` (key, text)."""
    only = {bytes(r["word"].encode()) for r in terms.collect()} if filtered else None
    shared = texts.sparkSession.sparkContext.broadcast(only)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = shared.value, {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([term_hash(w) for w in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

        for chunk in chunks(batches):
            for text in chunk.column(1).to_pylist():
                for w in words(text) if own is None else filter(own.__contains__, words(text)):
                    found[w] = found.get(w, 0) + 1
            if len(found) >= COUNTED:
                yield rows()
                found = {}
        if found:
            yield rows()

    counted = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counted if filtered else counted.join(terms.select("term").distinct(), "term", "left_semi")


def postings(texts: DataFrame, rare: DataFrame, terms: DataFrame, reach: int, filtered: bool) -> DataFrame:
    """The index: (key, term, block, at) of ``rare`` terms (term) and of ``terms`` within ``reach`` words of one, ``at`` being positions."""
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast({r["word"].encode(): r["term"] for r in terms.collect()} if filtered else None)
    seeds = spark.sparkContext.broadcast(np.sort(np.array([r["term"] for r in rare.collect()], np.int64)) if filtered else None)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            each = [words(t) for t in chunk.column(1).to_pylist()]
            n = np.array([len(w) for w in each], np.int64)
            begin = np.cumsum(n) - n
            flat = [w for ws in each for w in ws]
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(flat)) - begin[row]
            if filtered:
                own, some = known.value, seeds.value
                absent = -(1 << 63)
                term = np.fromiter(map(own.get, flat, repeat(absent)), np.int64, len(flat))
                is_term = term != absent
                place = np.minimum(np.searchsorted(some, term), len(some) - 1) if len(some) else np.zeros(len(term), np.int64)
                seed = np.flatnonzero(is_term & (some[place] == term)) if len(some) else np.empty(0, np.int64)
                near = np.zeros(len(flat) + 1, np.int64)
                np.add.at(near, np.maximum(seed - reach, begin[row[seed]]), 1)
                np.add.at(near, np.minimum(seed + reach + 1, begin[row[seed]] + n[row[seed]]), -1)
                take = np.flatnonzero(is_term & (np.cumsum(near[:-1]) > 0))
            else:
                term = np.fromiter(map(term_hash, flat), np.int64, len(flat))
                take = np.arange(len(flat))
            if not len(take):
                continue
            order = take[np.lexsort((at[take], at[take] // SPAN, term[take], row[take]))]
            code = np.stack([row[order], term[order], at[order] // SPAN], 1)
            first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]).any(1))))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(at[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0).take(pa.array(row[order[first]])), pa.array(term[order[first]]), pa.array((at[order[first]] // SPAN).astype(np.int32)), lists], ["key", "term", "block", "at"]
            )

    made = texts.mapInArrow(make, "key binary, term long, block int, at array<int>")
    return pin(made.dropDuplicates(["key", "term", "block"]))


def block_of(position: Column) -> Column:
    return F.floor(position / SPAN).cast("int")


def _broadcast_if_few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def judge_documents(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    share: int = 20,
    slop: int = 3,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """Per row of ``docs``: the columns of ``keep``, n_words, n_hit, items, near_items, contaminated.

    A phrase is ``window`` consecutive words of an item; an item with fewer words, but
    not none, is one phrase.  A word inside any occurrence of a phrase is hit.  items
    are the ids (as strings, sorted) of the items with an occurring phrase;
    near_items those with none, of which a phrase's two rarest terms are in the text
    within ``slop`` words of their distance, wherever the phrase would start or end.  contaminated: n_hit > 0 and share * n_hit >= n_words.

    Null or empty texts have no words.  Items with null text have no phrase; a null
    item id is the empty string; items that share an id count once.  Repeated rows are
    judged alike.  No documents give no rows, no items no hits.  A kept column named like
    a result is replaced by it.
    """
    texts = docs.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("key"), F.col(text).cast("binary").alias("text"))
    each, phrase_items = phrases_of(items, item_id, item_text, window)
    terms = pin(each.select(F.explode(F.arrays_zip("terms", "w")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.w").alias("word")).distinct())
    filtered = terms.count() <= broadcast_terms
    counts = term_counts(texts, terms, filtered)
    # By phrase: its terms from the rarest on, as (count, offset, term).
    spread = each.select("phrase", "terms").dropDuplicates(["phrase"]).select("phrase", "terms", F.posexplode("terms").alias("j", "term"))
    ranked = spread.join(counts, "term", "left").groupBy("phrase", "terms").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "j", "term"))).alias("rank"))
    first, second = F.get("rank", F.lit(0)), F.coalesce(F.get("rank", F.lit(1)), F.get("rank", F.lit(0)))
    phrases = pin(ranked.select("phrase", "terms", F.size("terms").alias("size"), first["term"].alias("term"), first["j"].alias("off"), second["term"].alias("next"), second["j"].alias("next_off")))
    index = postings(texts, phrases.select("term").distinct(), terms, window + slop, filtered)
    # Each posting of a rarest term proposes a start; the second rarest is looked up around its place.
    rare = index.join(phrases, "term").select("key", "phrase", "size", "next", "next_off", F.explode("at").alias("pos"), "off").withColumn("start", F.col("pos") - F.col("off"))
    spot = F.col("start") + F.col("next_off")
    rare = rare.withColumn("block", F.explode(F.array_distinct(F.array(block_of(spot - slop), block_of(spot + slop)))))
    other = index.select("key", F.col("term").alias("next"), "block", "at")
    met = rare.join(other, ["key", "next", "block"])
    # One posting is not two terms: a repeated term needs another place.
    close = F.exists("at", lambda p: (F.abs(p - spot) <= slop) & ((p != F.col("pos")) | (F.col("size") == 1)))
    met = pin(met.select("key", "phrase", "size", "start", close.alias("near"), (F.array_contains("at", spot) & (F.col("start") >= 0)).alias("fits")).where("near OR fits"))
    # What is left is intersected with all other terms of its phrase.
    wanted = met.where("fits").select("key", "phrase", "size", "start").distinct().join(phrases.select("phrase", "terms"), "phrase")
    wanted = wanted.select("key", "phrase", "size", "start", F.posexplode("terms").alias("j", "term")).withColumn("pos", F.col("start") + F.col("j")).withColumn("block", block_of(F.col("pos")))
    stand = wanted.join(index, ["key", "term", "block"]).where(F.array_contains("at", F.col("pos")))
    exact = pin(stand.groupBy("key", "phrase", "size", "start").agg(F.count(F.lit(1)).alias("n")).where("n = size").drop("n"))
    hit = exact.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    found = exact.select("key", "phrase").distinct().join(phrase_items, "phrase").select("key", "name").distinct()
    nearby = met.where("near").select("key", "phrase").distinct().join(phrase_items, "phrase").select("key", "name").distinct().join(found, ["key", "name"], "left_anti")
    names = lambda df, c: df.groupBy("key").agg(F.sort_array(F.collect_list("name")).alias(c))
    judged = pin(hit.join(names(found, "items"), "key", "left").join(names(nearby, "near_items"), "key", "full"))
    unpin(met, exact, index, phrases, terms, each)
    own = {c: f"_keep{i}" for i, c in enumerate(keep) if c not in RESULTS}
    none = F.array().cast("array<string>")
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.unhex(F.md5(F.col(text).cast("binary"))).alias("_key"), F.col(text).alias("_text"))
    rows = map_texts(rows, lambda texts: {"n_words": pa.array([len(words(t)) for t in texts], pa.int64())}, "n_words long", "_text", (*own.values(), "_key"))
    out = rows.join(_broadcast_if_few(judged, BROADCAST_TEXTS).withColumnRenamed("key", "_key"), "_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        *[F.col(n).alias(c) for c, n in own.items()], "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
