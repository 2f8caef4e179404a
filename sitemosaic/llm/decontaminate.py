"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words of the lower-cased text; a k-gram's hash is taken at every word, and of every w consecutive hashes the least is kept. A span of
k + w - 1 = 13 words that document and item share has the same least hash in both, so every shared 13-word window is found by a join
of the kept hashes. Documents that share one are extended: the 13-word windows that their hashes share with an item are looked up and
compared word by word. Items of fewer words than a window are one window of their own length; where such items exist, the documents'
grams of just those lengths are joined.

Equal texts are extended once (told apart by 128 hash bits) and joined to every row that has them, so copies and a passage that a third
of the documents share cost little. Null texts have no words: such documents are kept and hit nothing, such items occur nowhere. Rows
are kept one for one: repeated and null keys too. Only key and text of either table are read, so further columns cannot clash. An empty
table on either side gives documents without hits.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint

WINDOW = 13
K = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word is a run of digits, Latin letters or anything from code point 128 on.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SMALL_ROWS = 500_000  # 16-byte rows that are broadcast; more are joined by a shuffle


def words(text: Column) -> Column:
    """Words of the text with A-Z lowered; null: none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _pair(a: Column, shift: int, both, rest: Column | None = None) -> Column:
    """both(a[i], rest[i + shift]) for all i where both exist."""
    rest = a if rest is None else rest
    n = F.greatest(F.least(F.size(a), F.size(rest) - shift), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(rest, F.lit(shift + 1), n), both)


def grams(df: DataFrame, source: str, n: int, out: str) -> DataFrame:
    """Adds out: hashes of the n-word grams at all positions of the word-hash array source. Doubling: a step or two per bit of n."""
    join = lambda x, y: F.xxhash64(x, y)
    size, name = 1, source
    for bit in bin(n)[3:]:
        df = df.withColumn(f"_{out}{2 * size}", _pair(F.col(name), size, join))
        size, name = 2 * size, f"_{out}{2 * size}"
        if bit == "1":
            df = df.withColumn(f"_{out}{size + 1}", _pair(F.col(name), size, join, F.col(source)))
            size, name = size + 1, f"_{out}{size + 1}"
    return df.withColumn(out, F.col(name))


def kept(df: DataFrame, source: str, w: int, out: str) -> DataFrame:
    """Adds out: the distinct least values of every w consecutive values of the array source; none if there are fewer."""
    least = lambda x, y: F.least(x, y)
    size, name = 1, source
    while 2 * size <= w:
        df = df.withColumn(f"_{out}{2 * size}", _pair(F.col(name), size, least))
        size, name = 2 * size, f"_{out}{2 * size}"
    if size < w:
        df = df.withColumn(f"_{out}w", _pair(F.col(name), w - size, least))
        name = f"_{out}w"
    return df.withColumn(out, F.array_distinct(F.col(name)))


def hashed(df: DataFrame, text: str, *keys) -> DataFrame:
    """keys, words, h (hash of each word)."""
    return df.select(*keys, words(F.col(text)).alias("words")).withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))


def marks(df: DataFrame, k: int, window: int) -> DataFrame:
    """Adds kept: the winnowed hashes. Texts shorter than a window have none."""
    return kept(grams(df, "h", k, "g"), "g", window - k + 1, "kept")


def exploded(df: DataFrame, columns: list, array, name: str, pos: bool = False) -> DataFrame:
    """columns, (pos,) and a row for every element. The outer form: the optimizer would push an inner one's non-empty test down
    through all the steps that make the array, and so make it twice."""
    made = F.posexplode_outer(array).alias("pos", name) if pos else F.explode_outer(array).alias(name)
    return df.select(*columns, made).filter(F.col(name).isNotNull())


def small(df: DataFrame) -> DataFrame:
    """A checkpointed table of few narrow rows is broadcast, a larger one is not."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def item_windows(items: DataFrame, key: str, text: str, window: int) -> tuple[DataFrame, list[int]]:
    """n, gram, item, window (its words) of every item, and the lengths below the window that occur (at most window - 1 numbers)."""
    base = checkpoint(hashed(items, text, F.col(key).cast("string").alias("item")).filter(F.size("words") > 0))
    short = sorted(r[0] for r in base.filter(F.size("words") < window).select(F.size("words")).distinct().collect())
    out = None
    for n in [*short, window]:
        part = base.filter(F.size("words") == n if n < window else F.size("words") >= window)
        part = exploded(grams(part, "h", n, "grams"), ["item", "words"], "grams", "gram", pos=True)
        part = part.select(F.lit(n).alias("n"), "gram", "item", F.slice("words", F.col("pos") + 1, F.lit(n)).alias("window"))
        out = part if out is None else out.unionByName(part)
    return checkpoint(out.distinct()), short


def merged(runs: Column) -> Column:
    """Sorted (pos, to) runs that touch or overlap become one."""
    last = lambda acc: F.element_at(acc, -1)
    join = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["pos"].alias("pos"), F.greatest(last(acc)["to"], x["to"]).alias("to"))))
    return F.aggregate(runs, F.array().cast("array<struct<pos:int,to:int>>"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(last(acc)["to"] >= x["pos"], join(acc, x)).otherwise(F.concat(acc, F.array(x))))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, k: int = K) -> DataFrame:
    """key, n_words, n_hit, n_items, items (their keys as strings, sorted), spans (array of first word and number of words of the hit runs)."""
    if not 1 <= k <= window:
        raise ValueError("k must be between 1 and the window")
    windows, short = item_windows(items, item_key, item_text, window)
    listed = checkpoint(exploded(marks(hashed(items, item_text), k, window), [], "kept", "mark").distinct())
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).withColumns({"t1": F.xxhash64("body"), "t2": F.xxhash64(F.lit(1), "body")})

    # which texts share a kept hash (or a short item's gram)
    own = hashed(named, "body", "t1", "t2")
    seen = exploded(marks(own, k, window), ["t1", "t2"], "kept", "mark").join(small(listed), "mark", "left_semi").select("t1", "t2")
    for n in short:
        exact = exploded(grams(own, "h", n, "grams"), ["t1", "t2"], F.array_distinct("grams"), "gram")
        seen = seen.unionByName(exact.join(windows.filter(F.col("n") == n).select("gram").distinct(), "gram", "left_semi").select("t1", "t2"))
    seen = checkpoint(seen.distinct())

    # their windows, extended word by word
    texts = checkpoint(hashed(named.join(small(seen), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]), "body", "t1", "t2"))
    at = None
    for n in [*short, window]:
        part = exploded(grams(texts, "h", n, "grams"), ["t1", "t2", F.lit(n).alias("n")], "grams", "gram", pos=True)
        at = part if at is None else at.unionByName(part)
    at = at.join(windows.select("n", "gram").distinct(), ["n", "gram"], "left_semi")
    found = at.join(texts.select("t1", "t2", "words"), ["t1", "t2"]).select("t1", "t2", "n", "pos", "gram", F.slice("words", F.col("pos") + 1, F.col("n")).alias("window"))
    found = checkpoint(found.join(windows.select("n", "gram", "window").distinct(), ["n", "gram", "window"], "left_semi"))

    runs = found.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("pos", (F.col("pos") + F.col("n")).alias("to")))).alias("runs"))
    where = found.select("t1", "t2", "n", "gram", "window").distinct().join(windows, ["n", "gram", "window"])
    where = where.groupBy("t1", "t2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    facts = runs.select("t1", "t2", merged(F.col("runs")).alias("runs")).join(where, ["t1", "t2"])
    out = named.select("key", "t1", "t2", F.size(words(F.col("body"))).cast("long").alias("n_words")).join(facts, ["t1", "t2"], "left")
    length = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, x: acc + (x["to"] - x["pos"]))
    return out.select(
        F.col("key").alias(key), "n_words", F.coalesce(length, F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.transform("runs", lambda x: F.struct(x["pos"].alias("first"), (x["to"] - x["pos"]).alias("words"))), F.array().cast("array<struct<first:int,words:int>>")).alias("spans"))


def contaminated(share: int = 20) -> Column:
    """At least one word in so many is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
