"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Of every window of ``WINDOW`` words the k-gram with the least hash is kept (the last of equals). A
window that a document and a benchmark item share selects the same k-gram at the same place in both,
so joining the kept k-grams finds every shared window. A hit is then extended: each of the windows that
hold the k-gram is looked up among the benchmark's, and the words of the document inside those found
are marked. Items shorter than a window are windows of their own length, and all runs of that many words
are looked up; such runs are made only for lengths that some item has. Words are compared, not just hashes.

Documents are read once and never shuffled: a map emits a row for each document and for each window
found, and of these narrow rows those with a window are grouped. Each distinct k-gram, window and set of
items is one row of the benchmark's tables, so a passage of many items costs a document no more than
another; what a document has is a number for its set of items, and only distinct sets are ever spelled
out. The benchmark's tables are broadcast up to ``BROADCAST_ROWS`` rows (about 300 bytes each); a larger
benchmark is joined by shuffling both sides, when what is shuffled is 15 words for each kept k-gram.

Defined cases: a null or wordless text has no words and no hits; an item without words matches nothing;
an item without id marks words but isn't listed; repeated documents get a row each, repeated items count
once; very long texts only make more fingerprints; of other columns of either table none is read, so their
names may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.storage import materialise

WINDOW = 10
K = 5
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs are joined on the upper half of a hash; what it lets through is told apart by its words.
HIGH = -4294967296


def lowered(text: Column) -> Column:
    """A-Z in lower case; where all is ASCII the quicker function says the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), GAP), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, which a lambda's body would otherwise repeat."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _run_hashes(hashes: Column, n: int, more: list[Column]) -> Column:
    """For each word the hash of the run of ``n`` words that starts there, as far as one does."""
    runs = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, n)], *more).bitwiseAND(F.lit(HIGH)))
    return F.slice(runs, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))


def _probes(ws: Column, lengths: list[Column | int], window: int, k: int) -> Column:
    """Run hashes of the words by the length that they are for: of k words for ``window``, else of all.

    ``lengths`` are the shorter lengths. Each list ends with a null, which stands for no run.
    """
    null = F.array(F.lit(None).cast("bigint"))

    def of(hashes: Column) -> Column:
        # The length in the hash tells a short item's run from a k-gram.
        runs = [(window, _run_hashes(hashes, k, [])), *[(n, _run_hashes(hashes, n, [F.lit(n)])) for n in lengths]]
        return F.array(*[F.struct(F.lit(n).alias("n"), F.concat(r, null).alias("runs")) for n, r in runs])

    return _let(F.transform(ws, lambda w: F.xxhash64(w)), of)


def _kept(rows: DataFrame, window: int, k: int) -> DataFrame:
    """Rows with ``probes`` -> one for each run that is kept, (n, at, e), and those without a run.

    A k-gram is kept if one of the windows around it has none less, and none equal after it: if the
    k-grams to both sides that it beats, without a gap, make up a window with it.
    """
    reach = window - k
    rows = rows.select("*", F.explode_outer("probes").alias("probe")).drop("probes").select("*", "probe.n", "probe.runs").drop("probe")
    rows = rows.select("*", F.posexplode_outer("runs").alias("at", "e"))

    def beaten(step: int) -> Column:
        count = F.lit(reach)
        for j in range(reach, 0, -1):
            other = F.get("runs", F.col("at") + step * j)
            count = F.when(F.coalesce(other > F.col("e") if step > 0 else other >= F.col("e"), F.lit(False)), count).otherwise(F.lit(j - 1))
        return count

    return rows.filter(F.col("e").isNull() | (F.col("n") < window) | (beaten(-1) + beaten(1) >= reach)).drop("runs")


def benchmark_tables(benchmark: DataFrame, window: int = WINDOW, k: int = K, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: (key, n) of the k-grams that windows keep, (window_hash, run, set_id) of the windows, (set_id, items)."""
    item = F.col(item_col).cast("string").alias("item")
    hashed = benchmark.select(item, words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    kept = _kept(hashed.select(F.size("ws").alias("size"), _probes(F.col("ws"), list(range(1, window)), window, k).alias("probes")), window, k)
    own = F.col("e").isNotNull() & (F.col("n") == F.least(F.col("size"), F.lit(window)))
    keys = kept.filter(own).select(F.col("e").alias("key"), "n").distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    windows = hashed.select("item", "ws", F.explode(starts).alias("s")).select("item", F.slice("ws", F.col("s"), F.least(F.size("ws"), F.lit(window))).alias("run"))
    windows = windows.groupBy("run").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = materialise(windows.select(F.xxhash64("run").alias("window_hash"), "run", F.md5(F.to_json(F.struct("items"))).alias("set_id"), "items"), "windows")
    sets = windows.groupBy("set_id").agg(F.first("items").alias("items"))
    return materialise(keys, "keys"), windows.drop("items"), sets


def hits(docs: DataFrame, keys: DataFrame, windows: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, n_words, first, last, set_id): for each document a row with ``n_words`` and a row for each window found."""
    lengths = sorted(r[0] for r in keys.filter(F.col("n") < window).select("n").distinct().collect())  # fewer than `window`
    none = F.lit(None)
    text = F.col(text_col)
    split = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words(text).alias("ws"))
    rows = _kept(split.select("doc_id", "text_hash", "ws", F.size("ws").alias("n_words"), _probes(F.col("ws"), lengths, window, k).alias("probes")), window, k)
    # Of the rows without a run one stands for the document itself.
    rows = rows.filter(F.col("e").isNotNull() | (F.col("n") == window)).withColumnRenamed("n", "kind")
    small = keys.count() <= broadcast_rows and windows.count() <= broadcast_rows
    # Both bounds are counted just above; a word list stays in its row until a key is met.
    near = F.broadcast if small else (lambda df: df)
    rows = rows.withColumn("low", F.greatest(F.col("at") - (window - k), F.lit(0)))
    if not small:
        around = F.slice("ws", F.col("low") + 1, 2 * window - k)
        rows = rows.withColumn("ws", F.when(F.col("e").isNotNull(), around)).repartition(F.coalesce("e", F.xxhash64("doc_id", "text_hash")))
    met = rows.join(near(keys), (F.col("e") == F.col("key")) & (F.col("kind") == F.col("n")), "left").filter(F.col("e").isNull() | F.col("n").isNotNull())
    starts = F.when(F.col("e").isNull(), F.array(none.cast("int"))).when(F.col("n") < window, F.array("at")).otherwise(F.sequence("low", F.least(F.col("at"), F.col("n_words") - window)))
    met = met.select("doc_id", "text_hash", "n_words", "ws", "low", "n", F.explode_outer(starts).alias("s"))
    first = F.col("s") + 1 - (F.lit(0) if small else F.col("low"))
    met = met.select("doc_id", "text_hash", F.when(F.col("s").isNull(), F.col("n_words")).cast("long").alias("n_words"), F.col("s").alias("first"), (F.col("s") + F.col("n") - 1).alias("last"), F.slice("ws", first, F.col("n")).alias("words"))
    same = (F.xxhash64("words") == F.col("window_hash")) & (F.col("words") == F.col("run"))
    met = met.join(near(windows), same, "left").filter(F.col("first").isNull() | F.col("window_hash").isNotNull())
    return met.select("doc_id", "text_hash", "n_words", "first", "last", "set_id")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_words, n_hit, all_items), a row per document, and (all_items, items), a row per distinct set.

    ``all_items`` is null where nothing is hit.
    """
    keys, windows, sets = benchmark_tables(benchmark, window, k, item_col, text_col)
    found = materialise(hits(docs, keys, windows, window, k, id_col, text_col, broadcast_rows), "hits")
    marks = found.filter(F.col("first").isNotNull()).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("runs"), F.sort_array(F.collect_set("set_id")).alias("set_ids"))
    covered = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(acc["end"], r["first"] - 1))).cast("long").alias("n"), F.greatest(acc["end"], r["last"]).alias("end")),
        lambda acc: acc["n"],
    )
    marks = materialise(marks.select("doc_id", "text_hash", covered.alias("n_hit"), F.md5(F.array_join("set_ids", "")).alias("all_items"), "set_ids"), "marks")
    spelled = marks.groupBy("all_items").agg(F.first("set_ids").alias("set_ids")).select("all_items", F.explode("set_ids").alias("set_id")).join(sets, "set_id")
    spelled = spelled.groupBy("all_items").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    whole = found.filter(F.col("first").isNull()).select("doc_id", "text_hash", "n_words")
    mark = marks.select(F.col("doc_id").alias("marked_id"), F.col("text_hash").alias("marked_hash"), "n_hit", "all_items")
    same = F.col("doc_id").eqNullSafe(F.col("marked_id")) & (F.col("text_hash") == F.col("marked_hash"))
    rows = whole.join(mark, same, "left").select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "all_items")
    return rows, spelled


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` -> (id, text_hash, n_words, n_hit, items, contaminated), one row per input row.

    ``items`` are the ids, as strings in their order, of items of which a window occurs in the text.
    """
    rows, spelled = matches(docs, benchmark, window, k, id_col, text_col, item_col, broadcast_rows)
    out = rows.join(spelled, "all_items", "left")
    return out.select(F.col("doc_id").alias(id_col), "text_hash", "n_words", "n_hit", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), (F.col("n_hit") > 0).alias("contaminated"))
