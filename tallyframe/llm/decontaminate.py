"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question asked again with other values keeps its
template. Hashed windows of template words are joined with those of the benchmark, and so are windows that keep their
names, as a copy may write them in any case. The values in the slots of aligned windows must then agree: each name of the
item stands for one name of the document, and the other way round; numbers and units agree by place and type, as new
values may be equal by chance. Every alignment of an item with a document is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import BROADCAST_ROWS, bounded, cut, without

#: Template words of a window; an item of fewer words is one window.
WINDOW = 8
#: A document holds an item if it matches this share of the item's windows, or so many of them.
COVERAGE, LONG_RUN = 0.5, 13
#: Words that are units after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles "
    "inch inches foot feet gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres degree degrees "
    "dollar dollars euro euros cent cents rupee rupees percent kmh mph hz khz mhz ghz kb mb gb tb v w kw j kj cal kcal"
).split()
#: Marks before a name, a number and a unit: letters of no living script.
NAME, NUMBER, UNIT = "ꝸ", "ꝷ", "ꝶ"
#: What a window keeps of its words: neither names nor values, names, or all.
TEMPLATE, NAMED, EXACT = "template", "named", "exact"


def marked_words(text: Column) -> Column:
    """Lower-case words without punctuation; a mark stands before names, before each number, and before units after a number.

    A name begins with a capital inside a sentence. Signs inside numbers are no part of a word.
    """
    strange = F.contains(text, F.lit(NAME)) | F.contains(text, F.lit(NUMBER)) | F.contains(text, F.lit(UNIT))
    clean = F.when(strange, F.regexp_replace(text, f"[{UNIT}-{NAME}]", " ")).otherwise(text)
    named = F.regexp_replace(clean, r"(?<=\s)(?=\p{Lu})(?<=[^.!?:\s].)", NAME)
    numbered = F.regexp_replace(named, r"([0-9]+(?:[.,:/][0-9]+)*)", f"{NUMBER}$1")
    bare = F.lower(F.regexp_replace(numbered, r"[^\p{L}\p{N}\s]+", ""))
    units = rf"({NUMBER}[0-9]+\s+){NAME}?(?=(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?:\s|$))"
    return F.array_remove(F.split(F.regexp_replace(bare, units, f"$1{UNIT}"), r"\s+"), "")


def value(word: Column) -> Column:
    """A word without marks."""
    return F.when(word.rlike(f"[{UNIT}-{NAME}]"), F.regexp_replace(word, f"[{UNIT}-{NAME}]", "")).otherwise(word)


def _kept(word: Column, kind: str) -> Column:
    """What a window of a kind keeps of a marked word, as a hash."""
    if kind == EXACT:
        return F.xxhash64(value(word))
    named = F.xxhash64(F.lit(NAME)) if kind == TEMPLATE else F.xxhash64(F.regexp_replace(F.substring(word, 2, 1 << 30), f"{NUMBER}[0-9]+", "0"))
    numbered = F.xxhash64(F.regexp_replace(word, f"{NUMBER}[0-9]+", "0"))
    return F.when(word.startswith(NAME), named).when(word.startswith(UNIT), F.xxhash64(F.lit(UNIT))).when(word.contains(NUMBER), numbered).otherwise(F.xxhash64(word))


def _is_slot(word: Column) -> Column:
    return word.startswith(NAME) | word.startswith(UNIT) | word.rlike(f"^{NUMBER}[0-9]+$")


def _with_keys(df: DataFrame, hashes: str, length: int, name: str) -> DataFrame:
    """df with the hash of each window of so many words; none where there are fewer. Hashes of spans are joined pairwise while that doubles them."""
    span, at = 1, f"_{name}"
    df = df.withColumn(at, F.col(hashes))
    while span * 2 <= length:
        df = df.withColumn(at, F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - span, F.lit(0))), F.slice(at, span + 1, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        span *= 2
    if span < length:  # the last span overlaps
        df = df.withColumn(at, F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - (length - span), F.lit(0))), F.slice(at, length - span + 1, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    return df.withColumn(name, F.col(at)).drop(at)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, kind, length, item_at, window, windows) of the windows that stand for each item; windows counts its places.

    Those are its windows that are at most half slots, as templates and with names; an item that has none is
    found by its exact words.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), marked_words(F.col("text").cast("string")).alias("words")).where("item_id is not null and size(words) > 0")
    sized = cut(items.withColumn("length", F.least(F.size("words"), F.lit(WINDOW))))
    lengths = [r.length for r in sized.select("length").distinct().collect()] or [WINDOW]  # at most WINDOW
    kinds = (TEMPLATE, NAMED, EXACT)
    for kind in kinds:
        sized = sized.withColumn(f"h_{kind}", F.transform("words", lambda w: _kept(w, kind)))
    for kind in kinds:
        for n in lengths:
            sized = _with_keys(sized, f"h_{kind}", n, f"k_{kind}_{n}")
    keys = {kind: F.coalesce(*(F.when(F.col("length") == n, F.col(f"k_{kind}_{n}")) for n in lengths)) for kind in kinds}
    sets = sized.select("item_id", "words", "length", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), keys[k].alias("keys")) for k in kinds))))
    every = sets.select("item_id", "kind", "words", "length", F.posexplode("keys").alias("item_at", "window"))
    every = every.select("item_id", "kind", "length", "item_at", "window", F.size(F.filter(F.slice("words", F.col("item_at") + 1, F.col("length")), _is_slot)).alias("slots")).distinct()
    open_items = every.where("slots * 2 <= length").select("item_id").distinct().withColumn("open", F.lit(True))
    told = every.join(open_items, "item_id", "left").where(F.expr(f"if(open, kind <> '{EXACT}' and slots * 2 <= length, kind = '{EXACT}')"))
    return told.drop("open", "slots").join(told.groupBy("item_id").agg(F.countDistinct("item_at").alias("windows")), "item_id")


def _document_windows(docs: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, at, window) of every window of docs of the kinds and lengths that the benchmark has."""
    words = docs.select("doc_id", marked_words(F.col("text")).alias("words"))
    names = F.exists("words", lambda w: w.startswith(NAME))
    for kind in sorted({k for k, _ in kinds}):
        hashes = F.transform("words", lambda w: _kept(w, kind))
        # without names, templates are the windows with names
        words = words.withColumn(f"h_{kind}", F.when(names, hashes) if kind == NAMED and {n for k, n in kinds if k == NAMED} <= {n for k, n in kinds if k == TEMPLATE} else hashes)
    parts = []
    for kind, length in kinds:
        words = _with_keys(words, f"h_{kind}", length, f"k_{kind}_{length}")
        placed = F.transform(f"k_{kind}_{length}", lambda x, i: F.struct(i.alias("at"), x.alias("window")))
        parts.append(F.coalesce(placed, F.array().cast("array<struct<at:int,window:bigint>>")))
    return words.select("doc_id", F.explode(F.concat(*parts)).alias("w")).select("doc_id", "w.at", "w.window")


def _cutouts(sides: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """(key, at, name): the words of a window at each of the places of a row of sides."""
    cutouts = F.transform("places", lambda p: F.struct(p.alias(at), F.slice("words", p + 1, F.lit(WINDOW)).alias(name)))
    return sides.select(key, F.inline(cutouts)).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage, kind) of each document and benchmark item that it holds.

    kind is exact where one alignment has all of the item's windows with the item's values, partial where it has some of
    them with these values, else reparameterised. matched counts the item's windows found. An item of fewer words than a window
    is one window; one without words matches nothing. Null texts hold nothing; rows with a null id take no part; rows that
    share an id are judged together. An empty benchmark gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    wanted = cut(benchmark_windows(benchmark))
    # at most a kind for each of the lengths up to WINDOW
    kinds = sorted((r.kind, r.length) for r in wanted.select("kind", "length").distinct().collect())
    if not kinds:
        return spark.createDataFrame([], "doc_id long, item_id long, matched long, windows long, coverage double, kind string")
    hits = _document_windows(slim, kinds).join(bounded(wanted.select("item_id", "item_at", "window", "windows"), BROADCAST_ROWS), "window")
    # readings: every alignment of the item with the document; and the first place of each window, for items with words put between
    places = hits.groupBy("doc_id", "item_id", "windows", "item_at").agg(F.collect_set("at").alias("all_at"))  # equal windows with and without names count once
    shifted = F.transform("all_at", lambda at: F.struct(at.alias("at"), (at - F.col("item_at")).alias("shift")))
    first = F.array(F.struct(F.array_min("all_at").alias("at"), F.lit(None).cast("int").alias("shift")))
    placed = places.select("doc_id", "item_id", "windows", "item_at", F.inline(F.concat(shifted, first)))
    held = placed.groupBy("doc_id", "item_id", "windows", "shift").agg(F.count("*").alias("matched"), F.collect_list(F.struct("item_at", "at")).alias("places"))
    held = cut(held.where((F.col("matched") >= F.col("windows") * COVERAGE) | (F.col("matched") >= LONG_RUN)))

    # each place is a row and meets the window's words by its number: no row holds the words of a whole text
    aligned = held.select("doc_id", "item_id", "shift", F.inline("places"))
    needed = aligned.groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    texts = slim.join(bounded(held.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", marked_words(F.col("text")).alias("words"))
    found = _cutouts(texts.join(needed, "doc_id"), "doc_id", "at", "found")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), marked_words(F.col("text").cast("string")).alias("words"))
    asked = _cutouts(items.join(wanted.groupBy("item_id").agg(F.collect_set("item_at").alias("places")), "item_id"), "item_id", "item_at", "asked")
    sides = aligned.join(bounded(asked, BROADCAST_ROWS), ["item_id", "item_at"]).join(found, ["doc_id", "at"])
    slots = F.filter(F.arrays_zip("asked", "found"), lambda b: _is_slot(b["asked"]))
    pairs = sides.select("doc_id", "item_id", "shift", F.explode(slots).alias("b"))
    pairs = pairs.select("doc_id", "item_id", "shift", F.col("b.asked").startswith(NAME).alias("named"), value(F.col("b.asked")).alias("asked"), value(F.col("b.found")).alias("found")).distinct()
    one_to_one = lambda side: F.countDistinct(F.when(F.col("named"), F.struct("asked", "found"))) == F.countDistinct(F.when(F.col("named"), F.col(side)))
    judged = pairs.groupBy("doc_id", "item_id", "shift").agg(one_to_one("asked").alias("one_found"), one_to_one("found").alias("one_asked"), F.bool_and(F.col("asked").eqNullSafe(F.col("found"))).alias("equal"))
    judged = judged.withColumnsRenamed({"doc_id": "d", "item_id": "i", "shift": "s"})
    same = (F.col("doc_id") == F.col("d")) & (F.col("item_id") == F.col("i")) & F.col("shift").eqNullSafe(F.col("s"))
    good = held.join(judged, same, "left").where("equal is null or equal or (one_found and one_asked)")
    equal = F.coalesce("equal", F.lit(True))
    out = good.groupBy("doc_id", "item_id", "windows").agg(F.max("matched").alias("matched"), F.max(equal).alias("equal"), F.max(equal & (F.col("matched") == F.col("windows"))).alias("whole"))
    kind = F.when(F.col("whole"), "exact").when(F.col("equal"), "partial").otherwise("reparameterised")
    return out.select("doc_id", "item_id", "matched", "windows", (F.col("matched") / F.col("windows")).alias("coverage"), kind.alias("kind"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the documents that hold an item of the benchmark; null ids stay."""
    return without(docs, cut(contaminated(docs, benchmark).select("doc_id").distinct()))
