"""Held-out items whose passages occur in a corpus, by a prefix-filtered join on word sequences.

A passage counts as leaked when ``window`` consecutive words of an item's question stand in a text in the same order
without other words between them; case, punctuation, spacing, markup and ё/е are no matter.

1. *Index.* The items are a stated query set. They are taken in blocks of bounded size, so that what is sent to the
   executors has a proven bound (items and characters); every shingle (``k`` words) of every item and its place goes into the index.
2. *Scan.* One pass over the corpus yields, for each text, the places where indexed shingles stand (texts shorter than
   the window, items shorter than the window and all other shingles fall away here). Only these rows go on.
3. *Prefix.* Frequencies over the whole corpus order the shingles by rarity. A window holds
   ``window - k + 1`` shingles and needs all of them, so its rarest one is a necessary prefix: of each window only that
   shingle opens candidates, and a text that lacks it is never looked at again for that window.
4. *Bounds and verification.* Candidates are (text, item, place difference). Only they are expanded, to the places of
   their item within its length; those where the text has the same shingle are kept, by text and place, so that a shingle
   met everywhere is no hot key. A candidate needs ``window - k + 1`` of them in a row; runs are counted exactly.

Defined cases: null, blank and short texts or questions give nothing; a text leaks an item once, however often it
repeats it; repeated items and repeated rows give one row each key; a null key is kept as a key; other columns are not
read; with no items the result is empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskmill.llm import words as W
from deskmill.session import materialise

BLOCK_CHARS = 8_000_000
HITS = "doc_id BIGINT, shingle BIGINT, pos INT"


def _item_shingles(items: list[tuple], window: int, k: int) -> pd.DataFrame:
    lists = [(i, ws) for i, q in items if len(ws := W.words(q, fold_yo=True, drop_tags=True)) >= window]
    hashes, offsets = W.hash_batch([ws for _, ws in lists])
    mixed = W.mix(hashes, k).view(np.int64)
    rows = [(i, int(mixed[a + p]), p) for (i, _), a, b in zip(lists, offsets, offsets[1:]) for p in range(b - a - k + 1)]
    return pd.DataFrame(rows, columns=["item_id", "shingle", "item_pos"]).drop_duplicates()


def _scan(docs: DataFrame, shingles: np.ndarray, window: int, k: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(shingles))

    def run(batches):
        known = shared.value
        for batch in batches:
            lists = [W.words(t, fold_yo=True, drop_tags=True) for t in batch["text"]]
            hashes, offsets = W.hash_batch(lists)
            mixed = W.mix(hashes, k).view(np.int64)
            at = np.searchsorted(known, mixed)
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == mixed) if len(known) else np.empty(0, dtype=np.int64)
            doc = np.searchsorted(offsets, hit, side="right") - 1
            long = np.diff(offsets)[doc] >= window if len(hit) else np.empty(0, dtype=bool)
            hit, doc = hit[long], doc[long]
            inside = hit + k <= offsets[doc + 1]
            hit, doc = hit[inside], doc[inside]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[doc], "shingle": mixed[hit], "pos": (hit - offsets[doc]).astype(np.int32)})

    return docs.mapInPandas(run, HITS)


def _block(docs: DataFrame, items: list[tuple], window: int, k: int) -> DataFrame | None:
    index = _item_shingles(items, window, k)
    if not len(index):
        return None
    spark, need = docs.sparkSession, window - k + 1
    hits = materialise(_scan(docs, index["shingle"].to_numpy(), window, k), "leak-hits")
    places = spark.createDataFrame(index, "item_id BIGINT, shingle BIGINT, item_pos INT")

    # rarity over all texts, then each window's necessary prefix
    df = hits.groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = places.join(df, "shingle", "left").fillna(0, ["df"])
    ahead = Window.partitionBy("item_id").orderBy("item_pos").rangeBetween(0, need - 1)
    windows = ranked.withColumn("best", F.min(F.struct("df", "shingle", "item_pos")).over(ahead)).withColumn("n", F.size(F.collect_set("item_pos").over(ahead)))
    prefix = windows.filter(F.col("n") >= need).select("item_id", F.col("best.shingle").alias("shingle"), F.col("best.item_pos").alias("item_pos")).distinct()
    candidates = hits.join(prefix, "shingle").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()

    # the places of a candidate's item, where its text has the same shingle on the diagonal; runs of neighbours are islands of pos - row_number
    of = candidates.withColumnRenamed("item_id", "of_item")
    due = of.join(places, F.col("of_item").eqNullSafe(F.col("item_id"))).select("doc_id", "item_id", "diagonal", "shingle", (F.col("diagonal") + F.col("item_pos")).alias("pos"))
    stands = hits.select(F.col("doc_id").alias("in_doc"), F.col("pos").alias("in_pos"), F.col("shingle").alias("in_shingle"))
    same = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("pos") == F.col("in_pos")) & (F.col("shingle") == F.col("in_shingle"))
    # an inner join, so that the smaller side may be the one that is sent: the due places, unless they are many
    kept = due.join(stands, same).select("doc_id", "item_id", "diagonal", "pos").distinct()
    line = Window.partitionBy("doc_id", "item_id", "diagonal").orderBy("pos")
    islands = kept.withColumn("island", F.col("pos") - F.row_number().over(line))
    runs = islands.groupBy("doc_id", "item_id", "diagonal", "island").agg(F.count("*").alias("n")).filter(F.col("n") >= need)
    return runs.groupBy("doc_id", "item_id").agg((F.max("n") + k - 1).cast("int").alias("words"))


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "question", window: int = 13, k: int = 5, block: int = 5000) -> DataFrame:
    """(doc_id, item_id, words): affected texts, the item leaked and the length of its longest passage in words.

    ``block``: items held by the driver and each executor at a time, of ``BLOCK_CHARS`` characters together at most (one
    longer item is a block of its own); further items are handled in further passes.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    keyed = items.select(F.col(item_col).alias("item_id"), F.col(question_col).alias("question")).filter(F.length("question") >= 2 * window - 1)
    ordered = keyed.withColumn("_key", F.struct(F.col("item_id").cast("bigint"), F.xxhash64("question")))
    as_key = lambda k: F.struct(*(F.lit(x).cast("bigint") for x in k))
    parts, low, out = 0, None, None
    while True:
        page = ordered if low is None else ordered.filter(F.col("_key") > as_key(low))
        sizes = page.select("_key", F.length("question").alias("chars")).distinct().orderBy("_key").limit(block).collect()
        if not sizes:
            break
        fits = max(1, int(np.searchsorted(np.cumsum([r.chars for r in sizes]), BLOCK_CHARS, side="right")))
        low = sizes[min(fits, len(sizes)) - 1]["_key"]
        rows = page.filter(F.col("_key") <= as_key(low)).select("item_id", "question").distinct().collect()
        found = _block(corpus, [(r.item_id, r.question) for r in rows], window, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
            parts += 1
        if fits >= len(sizes) < block:
            break
    if out is None:
        return spark.createDataFrame([], "doc_id BIGINT, item_id BIGINT, words INT")
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words")) if parts > 1 else out
