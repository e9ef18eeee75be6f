"""Benchmark decontamination by template windows.

Texts become templates: numbers, units behind numbers and names (capitalised words
inside a sentence) are typed placeholders, other words are lower-cased. Windows of
``width`` template words of the documents are hash-joined with those of the
benchmark's items. A document holds an item if it has at least ``share`` of the
item's windows and the placeholders are filled consistently: wherever the item
repeats a value, so does the document, either over the first places of all windows or
along one alignment of document and item. That also finds questions with other numbers
or names. Without consistent slots, the windows without placeholders must do.

Windows with more placeholders than other words say little as templates; they match
by their words, lower-cased. An item of fewer than ``width`` words is one window of its
own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, save

#: Units that become a placeholder behind a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "percent", "mile", "miles", "inch", "inches", "feet", "kmh", "mph", "w", "kw", "v", "hz")
#: ASCII but for letters, digits and . , ! ?
SEPARATORS = r"[\x00-\x20\x22-\x2B\x2D\x2F\x3A-\x3E\x40\x5B-\x60\x7B-\x7F]+"
#: A benchmark with at most so many windows is broadcast (some 40 MB); a larger one is joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000


def _tokens(text: Column) -> Column:
    """Words as they stand, with the punctuation . , ! ? that follows them."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _template(tokens: str) -> Column:
    """The template words of a column of tokens."""
    units = F.array(*map(F.lit, UNITS))

    def word(t: Column, i: Column) -> Column:
        bare = F.rtrim(t, F.lit(".,!?"))
        before = F.get(tokens, i - 1)
        digit = lambda x: (x >= "0") & (x < ":")  # noqa: E731  by the first character
        low = F.lower(bare)
        plain = F.when(F.array_contains(units, low) & digit(before), F.lit("<unit>")).otherwise(low)
        inside = ~F.rtrim(before, F.lit(".!?")).eqNullSafe(before)
        name = (low != bare) & (F.upper(bare) != bare) & before.isNotNull() & ~inside
        return F.when(digit(bare), F.lit("<num>")).when(name, F.lit("<name>")).otherwise(plain)

    return F.transform(tokens, word)


def _slot(word: Column) -> Column:
    return F.startswith(word, F.lit("<"))


def _low(token: Column) -> Column:
    return F.lower(F.rtrim(token, F.lit(".,!?")))


def _is_heavy(at: Column, width: Column) -> Column:
    """Whether a window of the column words has more placeholders than other words."""
    return 2 * F.size(F.filter(F.slice("words", at + 1, width), _slot)) > width


def _hash(at: Column, width: Column, by_words: Column) -> Column:
    """A window's hash: of its words if by_words, else of its template."""
    said = F.xxhash64(F.lit("words"), F.transform(F.slice("raw", at + 1, width), _low))
    return F.when(by_words, said).otherwise(F.xxhash64(F.slice("words", at + 1, width)))


def _windows(width: int, heavy: bool) -> Column:
    """The windows of ``width`` words of a document's columns raw and words: at, first, hash; null if it has fewer words.

    Where a placeholder comes first because of what stands before it, the window
    comes a second time, with first, as if nothing stood there: so an item begins.
    heavy: some item has a window that matches by its words.
    """
    n = F.lit(width)
    places = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n))
    by_words = (lambda i: _is_heavy(i, n)) if heavy else (lambda i: F.lit(False))
    each = F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(False).alias("first"), _hash(i, n, by_words(i)).alias("hash")))
    named = F.filter(places, lambda i: F.get("words", i).isin("<name>", "<unit>"))
    begins = lambda i: F.xxhash64(F.concat(F.array(_low(F.get("raw", i))), F.slice("words", i + 2, F.lit(width - 1))))
    return F.concat(each, F.transform(named, lambda i: F.struct(i.alias("at"), F.lit(True).alias("first"), begins(i).alias("hash"))))


def leaked_items(docs: DataFrame, benchmark: DataFrame, width: int = 6, share: float = 0.5, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, n_windows, n_matched, n_plain, consistent.

    n_windows counts the item's distinct windows, n_matched those that the document
    has, n_plain those of them without placeholders or matched by their words. The
    share is asked of all windows or of those that match as templates, so a
    question with other numbers needn't have the windows that are mostly numbers.
    An item shorter than width has one window. Null and empty items aren't found.
    Null, empty and very long texts are allowed; rows that share a doc_id
    count as one document, whose values are read within a row, rows with a null doc_id as none. Items that share an
    item_id count as one. Tables without rows give none.
    """
    # Rows of one doc_id with different texts are told apart by a hash of the text.
    own = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null").withColumn("row", F.xxhash64("t"))
    items = benchmark.select(F.col(item).alias("item"), _tokens(F.col(item_text)).alias("raw")).where("item is not null").withColumn("words", _template("raw"))
    index = items.where("size(words) > 0").withColumn("width", F.least(F.size("words"), F.lit(width)))
    index = index.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))).alias("place"))
    index = index.withColumn("heavy", _is_heavy(F.col("place"), F.col("width"))).withColumn("hash", _hash(F.col("place"), F.col("width"), F.col("heavy")))
    slotted = F.exists(F.slice("words", F.col("place") + 1, F.col("width")), _slot) & ~F.col("heavy")
    index = save(index.select("item", "place", "width", "hash", "heavy", slotted.alias("slotted")), "windows")
    of_item = index.select("item", "hash", "heavy").distinct().groupBy("item").agg(F.count("*").alias("n_windows"), F.sum(1 - F.col("heavy").cast("int")).alias("n_templates"))
    small = index.count() <= BROADCAST_WINDOWS
    # At most width lengths, each with whether some window matches by its words.
    lengths = {r["width"]: r["heavy"] for r in index.groupBy("width").agg(F.max("heavy").alias("heavy")).collect()} or {width: False}

    made = own.select("id", "row", _tokens(F.col("t")).alias("raw")).withColumn("words", _template("raw"))
    made = made.select("id", "row", *[_windows(n, heavy).alias(f"w{n}") for n, heavy in sorted(lengths.items())])
    none = F.array().cast("array<struct<at int, first boolean, hash bigint>>")
    made = made.select("id", "row", (F.concat(*[F.coalesce(f"w{n}", none) for n in sorted(lengths)]) if len(lengths) > 1 else F.col(f"w{min(lengths)}")).alias("all"))
    # The outer form: for the other, Catalyst adds a filter that works out the whole array once more.
    each = made.select("id", "row", F.explode_outer("all").alias("w")).select("id", "row", "w.*")
    hits = each.join(F.broadcast(index) if small else index.hint("shuffle_hash"), "hash").where("not first or place = 0")
    hits = save(hits.select("id", "row", "item", "hash", "heavy", "slotted", "place", "at"), "hits")
    # A document's repeated windows count once, at their first place.
    once = hits.groupBy("id", "item", "hash", "heavy", "slotted").agg(F.min(F.struct("row", "at", "place")).alias("first"))
    once = save(once.select("id", "item", "hash", "heavy", "slotted", "first.*"), "once")
    slots, said = F.col("slotted").cast("int"), F.col("heavy").cast("int")
    pairs = once.groupBy("id", "item").agg(F.count("*").alias("n_matched"), F.sum(1 - slots).alias("n_plain"), F.sum(slots).alias("n_slotted"), F.sum(said).alias("n_said"))

    def enough(n: Column) -> Column:
        """Whether n windows, with those by their words, are the share of all windows or of the templates."""
        return (n >= share * F.col("n_windows")) | ((F.col("n_templates") > 0) & (n - F.col("n_said") >= share * F.col("n_templates")))

    pairs = save(pairs.join(of_item, "item").where(enough(F.col("n_matched"))), "pairs")

    # Values in the slots of the windows that match, for the few documents with any.
    open_pairs = pairs.where("n_slotted > 0").select("id", "item")
    chosen = save(open_pairs.select("id").distinct(), "slotted")
    texts = by_ids(own, chosen, "id").select("id", "row", _tokens(F.col("t")).alias("doc_raw")).dropDuplicates(["id", "row"])
    bare = lambda x: F.rtrim(x, F.lit(".,!?"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(_slot(F.get("words", F.col("place") + k)), F.struct(F.get("words", F.col("place") + k).alias("kind"), bare(F.get("raw", F.col("place") + k)).alias("asked"), bare(F.get("doc_raw", F.col("at") + k)).alias("found"))))

    def steady(found: DataFrame, *by: str) -> DataFrame:
        """Per document, item and by: the most values that one value of the item has become."""
        both = found.join(texts, ["id", "row"]).join(items.select("item", "raw", "words"), "item")
        values = both.select("id", "item", *by, F.explode_outer(F.filter(filled, lambda x: x.isNotNull())).alias("s")).select("id", "item", *by, "s.*").distinct()
        return values.groupBy("id", "item", *by, "kind", "asked").count().groupBy("id", "item", *by).agg(F.max("count").alias("most"))

    first = steady(once.where("slotted").join(open_pairs, ["id", "item"]))
    pairs = save(pairs.join(first, ["id", "item"], "left").withColumn("steady", F.coalesce(F.col("most") == 1, F.lit(True))), "judged")
    # Where first places disagree, each alignment of document and item is judged by itself, with the windows that need no values.
    left = pairs.where("not steady").select("id", "item", "n_plain", "n_said", "n_windows", "n_templates")
    along = hits.where("slotted").join(left, ["id", "item"]).withColumn("shift", F.col("at") - F.col("place"))
    alone = along.groupBy("id", "item", "row", "shift", "n_plain", "n_said", "n_windows", "n_templates").agg(F.countDistinct("hash").alias("n"))
    alone = save(alone.where(enough(F.col("n") + F.col("n_plain"))).select("id", "item", "row", "shift"), "alone")
    held = steady(along.join(alone, ["id", "item", "row", "shift"]), "row", "shift").where("most = 1").select("id", "item", F.lit(True).alias("aligned")).distinct()
    out = pairs.join(held, ["id", "item"], "left").withColumn("consistent", F.col("steady") | F.coalesce("aligned", F.lit(False)))
    out = out.where(F.col("consistent") | enough(F.col("n_plain")))
    return out.select(F.col("id").alias(key), F.col("item").alias(item), F.col("n_windows").cast("long"), F.col("n_matched").cast("long"), F.col("n_plain").cast("long"), "consistent")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs without those that hold an item of the benchmark; rows with a null key stay."""
    ids = save(leaked_items(docs, benchmark, key=key, **options).select(key).distinct(), "leaks")
    return by_ids(docs, ids, key, "left_anti")
