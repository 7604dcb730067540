"""Benchmark decontamination by template windows.

Texts are put into a canonical form in which names, numbers and units are typed
placeholders, so a question asked again with other parameters keeps its template.
Windows of five canonical words are hash-joined with those of the benchmark.  Windows
that line up are then held together by their slots: the same value of the item must
always stand for the same value of the document, and the other way round.

All documents pass a first step that hashes windows and does nothing else.  Only those
that hold enough windows of one item go on to have their slots worked out.

A capital makes a name, so a copy in other case has another template.  Windows of plain
words in lower case are therefore looked for as well.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import content_key
from tidemill.session import stage

WORDS = 5
SHARE = 0.8
#: Words in a row, at least, that are a leak whatever share of the item they are.
RUN = 13
#: Words of a window that must not be placeholders.
LITERALS = 3
#: Items of fewer words than two windows side by side are also looked for as a whole, down
#: to these many words; what is shorter says nothing.
WHOLE, LEAST = 2 * WORDS - 2, 3
#: Benchmark windows up to this many (some 100 bytes each) are sent to every executor;
#: more are joined by shuffling both sides.
BROADCAST_WINDOWS = 200_000

# Units of measure.
UNITS = (
    "km m cm mm mi ft in yd kg g mg t lb lbs oz l ml gal s sec min h hr hrs kmh mph hz khz mhz ghz b kb mb gb tb"
    " v w kw kwh a j kj cal kcal usd eur gbp dollars dollar euros euro pounds pound cents cent metres meters miles"
    " feet inches kilometres kilometers grams kilograms litres liters seconds minutes hours days weeks months years"
    " percent degrees"
).split()
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
MARKS = f"[{NAME}{NUMBER}{UNIT}]"
#: Before a name that begins a sentence; what holds the words of a name, and the parts of a number, together.
OPENER, JOIN = "\x04", "\x05"
#: A word is a run of letters, their marks, and digits; whatever stands between two words doesn't count.
BETWEEN = rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{NUMBER}{UNIT}{OPENER}{JOIN}]+"
#: Scripts without spaces, of which every letter is a word.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: All of these and of the marks lie in here, and hardly anything that texts of other scripts have.
FAR = rf"[{NAME}-{JOIN}\u0E00-\u1FFF\u2E80-\x{{3FFFF}}]"
CAPITALISED = r"\p{Lu}\p{Ll}\p{L}*"
_NO_WORD_BEFORE = r"(?<![\p{L}\p{N}])"
_UNIT_NAME = rf"(?i:({'|'.join(UNITS)}))(?![\p{{L}}\p{{N}}])"


def _spaced(text: Column) -> Column:
    """A text without the characters used as marks, and with letters of unspaced scripts apart."""
    marks = f"[{NAME}{NUMBER}{UNIT}{OPENER}{JOIN}]"
    apart = F.regexp_replace(F.regexp_replace(text, marks, " "), f"([{UNSPACED}])", " $1 ")
    return F.when(text.rlike(FAR), apart).otherwise(text)


def _split(text: Column, ends: bool = True) -> Column:
    """Words of a text; with ``ends``, texts that begin or end between words give no empty ones."""
    return F.split(F.regexp_replace(text, f"^{BETWEEN}|{BETWEEN}$", "") if ends else text, BETWEEN, -1)


def literal_words(text: Column, ends: bool = True) -> Column:
    """The words in lower case."""
    return _split(F.lower(_spaced(text)), ends)


def template_words(text: Column, ends: bool = True) -> Column:
    """The words in lower case with placeholders: ``canonical_words`` of ``raw_words``.

    The same in fewer steps, for all documents.
    """
    # What stands before a name is looked at after its capital, so that few places are.
    name = rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}]\p{{Lu}})\p{{Ll}}\p{{L}}*+(?: {CAPITALISED}+)*+"
    t = F.regexp_replace(_spaced(text), name, NAME)
    n = F.regexp_replace(t, rf"[0-9](?:[0-9]|(?<=[0-9])[.,](?=[0-9]))* ?{_UNIT_NAME}", f"{NUMBER} {UNIT}")
    n = F.regexp_replace(n, r"[0-9](?:[0-9]|[.,](?=[0-9]))*", NUMBER)
    return _split(F.lower(F.when(t.rlike("[0-9]"), n).otherwise(t)), ends)


def raw_words(text: Column) -> Column:
    """The words as they stand, those that make one placeholder as one word behind its mark.

    A name is a run of capitalised words.  One that begins a sentence may be a name or not
    and is marked as an opener.  A number is a run of digits with its separators; a unit
    is a listed word after a number.
    """
    t = F.regexp_replace(_spaced(text), rf"{_NO_WORD_BEFORE}({CAPITALISED})", f"{NAME}$1")
    t = F.regexp_replace(t, rf"({NAME}\p{{L}}+) (?={NAME})", f"$1{JOIN}")
    t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}},;] )(?<!{JOIN}){NAME}", OPENER)
    n = F.regexp_replace(t, "(?<=[0-9])[.,](?=[0-9])", JOIN)
    n = F.regexp_replace(n, rf"([0-9]) ?{_UNIT_NAME}", f"$1 {UNIT}$2")
    return _split(F.when(t.rlike("[0-9]"), n).otherwise(t))


def canonical_words(raw: Column) -> Column:
    """``raw_words`` in lower case, with placeholders; an opener is the same as a name."""
    t = F.regexp_replace(F.array_join(raw, " "), rf"[{NAME}{OPENER}][\p{{L}}{NAME}{JOIN}]+", NAME)
    t = F.lower(F.regexp_replace(t, rf"{UNIT}\p{{L}}+", UNIT))
    t = F.when(t.rlike("[0-9]"), F.regexp_replace(t, f"[0-9]+(?:{JOIN}[0-9]+)*", NUMBER)).otherwise(t)
    return F.split(t, " ", -1)


def _in_a_row(words: str, n: int) -> Column:
    """An array of structs with the fields 0 to n - 1: every ``n`` words in a row, and shorter ends."""
    parts = [F.slice(F.col(words), k + 1, F.greatest(F.size(words), F.lit(1))) for k in range(n)]
    return F.arrays_zip(*parts)


def _hash(window: str, n: int = WORDS) -> Column:
    return F.xxhash64(*[F.col(f"{window}.{k}") for k in range(n)])


def _windows(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, _pos, _h and _slots for every template window of ``text``.

    ``_slots`` has the raw words of a window with placeholders and is null for others.
    """
    words = texts.select(*keep, raw_words(F.col("text")).alias("_r"))
    words = words.select(*keep, canonical_words(F.col("_r")).alias("_c"), "_r")
    rows = words.select(*keep, "_r", F.posexplode(_in_a_row("_c", WORDS)).alias("_at", "_x")).where(f"_x.`{WORDS - 1}` IS NOT NULL")
    marked = F.concat_ws(" ", *[F.col(f"_x.{k}") for k in range(WORDS)]).rlike(MARKS)
    slots = F.when(marked, F.array_join(F.slice("_r", F.col("_at") + 1, WORDS), " "))
    return rows.select(*keep, (F.col("_at") + 1).alias("_pos"), _hash("_x").alias("_h"), slots.alias("_slots"))


def _literal_windows(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, _pos and _h for every window of plain words of ``text``."""
    words = texts.select(*keep, literal_words(F.col("text")).alias("_w"))
    rows = words.select(*keep, F.posexplode(_in_a_row("_w", WORDS)).alias("_at", "_x")).where(f"_x.`{WORDS - 1}` IS NOT NULL")
    return rows.select(*keep, (F.col("_at") + 1).alias("_pos"), _hash("_x").alias("_h"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, text and _item, which tells them apart."""
    name = F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("_item")
    return benchmark.select("item_id", "text").distinct().select("*", name)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, _item, _n, _nth, _ipos, _h and _kinds and _values (of a window with placeholders) of the windows that count.

    Windows of an item that are nearly all placeholders fit anything and don't count.
    """
    items = _items(benchmark)
    raw = raw_words(F.col("text"))
    kinds = items.select("_item", F.posexplode(F.arrays_zip(canonical_words(raw).alias("c"), raw.alias("r"))).alias("_at", "_k"))
    kinds = kinds.select("_item", "_at", F.when(F.col("_k.r").startswith(OPENER), OPENER).otherwise(F.regexp_extract("_k.c", MARKS, 0)).alias("_k"))
    rows = _windows(items, "item_id", "_item").withColumn("_at", F.explode(F.sequence(F.col("_pos") - 1, F.col("_pos") + WORDS - 2)))
    rows = rows.join(kinds, ["_item", "_at"]).groupBy("item_id", "_item", "_pos", "_h", "_slots").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_k"))), lambda x: x["_k"]).alias("_kinds")
    )
    # An opener may be a name, but need not be: it takes no literal away.
    certain = F.size(F.filter("_kinds", lambda k: ~k.isin("", OPENER)))
    marks = F.size(F.filter("_kinds", lambda k: k != ""))
    kinds = F.transform("_kinds", lambda k: F.when(k == OPENER, NAME).otherwise(k))
    return _numbered(rows.where(certain <= WORDS - LITERALS)).select(
        "_nth", "item_id", "_item", "_n", F.col("_pos").alias("_ipos"), "_h",
        F.when(marks > 0, kinds).alias("_kinds"), F.when(marks > 0, F.col("_slots")).alias("_values"),
    )


def _numbered(windows: DataFrame) -> DataFrame:
    """With _nth, a window's number among its item's, and _n, how many those are."""
    item = Window.partitionBy("_item")
    return windows.withColumns({"_nth": F.row_number().over(item.orderBy("_pos")), "_n": F.count("*").over(item)})


def literal_item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, _item, _n, _nth, _ipos and _h of an item's windows of plain words."""
    rows = _numbered(_literal_windows(_items(benchmark), "item_id", "_item"))
    return rows.select("_nth", "item_id", "_item", "_n", F.col("_pos").alias("_ipos"), "_h")


def short_items(benchmark: DataFrame) -> DataFrame:
    """item_id, _item, _words and the hash of their first words, of items of LEAST to WHOLE words."""
    items = _items(benchmark).select("item_id", "_item", literal_words(F.col("text")).alias("_words"))
    items = items.where(F.size("_words").between(LEAST, WHOLE))
    return items.withColumn("_h", F.xxhash64(*[F.element_at("_words", k + 1) for k in range(LEAST)]))


def _sent(items: DataFrame) -> DataFrame:
    """Broadcast what is proven small."""
    return F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items


class _Benchmark:
    """What of a benchmark documents are looked through for, written once."""

    def __init__(self, benchmark: DataFrame):
        self.templates = _sent(stage(item_windows(benchmark), "benchmark-windows"))
        self.literals = _sent(stage(literal_item_windows(benchmark), "benchmark-literals"))
        short = stage(short_items(benchmark), "benchmark-short")
        self.short = _sent(short) if short.take(1) else None


def suspects(keyed: DataFrame, items: _Benchmark, share: float) -> DataFrame:
    """_k1 and _k2 of documents that may hold an item; ``keyed`` has these and text.

    By templates: enough windows of one item, whatever their slots.  By plain words: one
    of every fifth window of the document, of which nine words in a row hold a whole one.
    By short items: their first words.
    """
    key = ["_k1", "_k2"]
    # Places don't count here, so an empty word at either end does no harm.
    rows = keyed.select(*key, template_words(F.col("text"), ends=False).alias("_c"))
    rows = rows.select(*key, F.explode(_in_a_row("_c", WORDS)).alias("_x")).where(f"_x.`{WORDS - 1}` IS NOT NULL")
    hits = rows.select(*key, _hash("_x").alias("_h")).join(items.templates.select("_h", "_item", "_ipos", "_n"), "_h")
    counted = hits.groupBy(*key, "_item", "_n").agg(F.count_distinct("_ipos").alias("_c"))
    found = [counted.where((F.col("_c") >= share * F.col("_n")) | (F.col("_c") > RUN - WORDS)).select(*key)]

    words = keyed.select(*key, literal_words(F.col("text"), ends=False).alias("_w"))
    every = words.select(*key, F.posexplode(_in_a_row("_w", WORDS)).alias("_at", "_x"))
    fifth = every.where(f"_at % {WORDS} = 0 AND _x.`{WORDS - 1}` IS NOT NULL").select(*key, _hash("_x").alias("_h"))
    found.append(fifth.join(items.literals.select("_h"), "_h", "left_semi").select(*key))

    if items.short is not None:
        first = words.select(*key, F.explode(_in_a_row("_w", LEAST)).alias("_x")).where(f"_x.`{LEAST - 1}` IS NOT NULL")
        found.append(first.select(*key, _hash("_x", LEAST).alias("_h")).join(items.short.select("_h"), "_h", "left_semi").select(*key))
    return reduce(DataFrame.unionByName, found).distinct()


def consistent(found: DataFrame) -> DataFrame:
    """Matches without those whose slots contradict the rest of the passage.

    A slot pairs a value of the item with one of the document.  Within a passage
    (document, item and offset) each value keeps its most frequent partner; windows with
    any other pair are left out.
    """
    found = found.withColumn("_diag", F.col("_pos") - F.col("_ipos"))
    passage = ["_k1", "_k2", "_item", "_diag"]
    plain = found.where("_values IS NULL").select(*passage, "doc_id", "item_id", "_n", "_nth", "_ipos")
    split = lambda c: F.split(F.lower(F.regexp_replace(c, f"[{NAME}{UNIT}{OPENER}]", "")), " ")
    slot = F.explode(F.arrays_zip("_kinds", split("_values").alias("_i"), split("_slots").alias("_d"))).alias("_z")
    pair = (
        found.where("_values IS NOT NULL")
        .select(*passage, "doc_id", "item_id", "_n", "_nth", "_ipos", slot)
        .select(*passage, "doc_id", "item_id", "_n", "_nth", "_ipos", F.col("_z._kinds").alias("_kind"), "_z._i", "_z._d")
        .where("_kind <> ''")
    )
    counted = pair.groupBy(*passage, "_kind", "_i", "_d").agg(F.count("*").alias("_c"))
    best = lambda side, other: Window.partitionBy(*passage, "_kind", side).orderBy(F.desc("_c"), other)
    good = (
        counted.withColumn("_r1", F.row_number().over(best("_i", "_d")))
        .withColumn("_r2", F.row_number().over(best("_d", "_i")))
        .where("_r1 = 1 AND _r2 = 1")
        .select(*passage, "_kind", "_i", "_d", F.lit(True).alias("_ok"))
    )
    held = (
        pair.join(good, [*passage, "_kind", "_i", "_d"], "left")
        .groupBy(*passage, "doc_id", "item_id", "_n", "_nth", "_ipos")
        .agg(F.every(F.coalesce("_ok", F.lit(False))).alias("_all"))
        .where("_all")
    )
    return plain.unionByName(held.drop("_all"))


def _scored(rows: DataFrame, share: float) -> DataFrame:
    """Per document and item the windows that match, where they are enough or enough in a row."""
    passage = ["_k1", "_k2", "_item", "_diag"]
    # Windows in a row have the same difference of their number and their rank.
    rank = F.row_number().over(Window.partitionBy(*passage).orderBy("_nth"))
    rows = rows.withColumn("_block", F.col("_nth") - rank)
    rows = rows.withColumn("_run", F.count("*").over(Window.partitionBy(*passage, "_block")))
    return (
        rows.groupBy("_k1", "_k2", "doc_id", "item_id", "_item", "_n", "_ipos").agg(F.max("_run").alias("_run"))
        .groupBy("_k1", "_k2", "doc_id", "item_id", "_item", "_n").agg(F.count("*").alias("n_matched"), F.max("_run").alias("_run"))
        .where((F.col("n_matched") >= share * F.col("_n")) | (F.col("_run") > RUN - WORDS))
        .select("_k1", "_k2", "doc_id", "item_id", "_item", F.col("_n").alias("n_windows"), "n_matched")
    )


def _leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``leaks`` of all items, those with a null id included."""
    items = _Benchmark(benchmark)
    keyed = docs.select("doc_id", *content_key("doc_id", "text"), "text")
    may = stage(suspects(keyed.select("_k1", "_k2", "text"), items, share), "template-suspects")
    few = stage(keyed.join(may, ["_k1", "_k2"], "left_semi").distinct(), "template-texts")
    key = ["doc_id", "_k1", "_k2"]

    matched = _windows(few, *key).join(items.templates, "_h").drop("_h")
    found = [_scored(consistent(stage(matched, "template-matches")), share).withColumn("_by", F.lit(3))]
    plain = _literal_windows(few, *key).join(items.literals, "_h")
    plain = plain.withColumn("_diag", F.col("_pos") - F.col("_ipos"))
    found.append(_scored(plain, share).withColumn("_by", F.lit(2)))
    if items.short is not None:
        words = few.select(*key, literal_words(F.col("text")).alias("_w"))
        at = words.select(*key, "_w", F.posexplode(_in_a_row("_w", LEAST)).alias("_at", "_x")).where(f"_x.`{LEAST - 1}` IS NOT NULL")
        at = at.withColumn("_h", _hash("_x", LEAST)).join(items.short, "_h")
        whole = at.where(F.slice("_w", F.col("_at") + 1, F.size("_words")) == F.col("_words"))
        one = F.lit(1).cast("long")
        found.append(
            whole.select(*key, "item_id", "_item", one.alias("n_windows"), one.alias("n_matched"), F.lit(1).alias("_by")).distinct()
        )
    rows = reduce(DataFrame.unionByName, found).withColumn("similarity", F.col("n_matched") / F.col("n_windows"))
    best = F.max(F.struct("similarity", "_by", "n_windows", "n_matched")).alias("_best")
    return rows.groupBy("_k1", "_k2", "doc_id", "item_id", "_item").agg(best).select(
        "doc_id", "item_id", "_best.n_windows", "_best.n_matched", "_best.similarity", "_k1", "_k2"
    )


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched and similarity of every leaked item.

    An item has leaked into a document that holds at least ``share`` of its windows,
    counted by place, or the windows of RUN words in a row; template windows with slots
    that agree, or windows of plain words in any case, whichever are the larger share.
    Plain words are looked for where nine in a row agree.  An item of LEAST to WHOLE words
    has also leaked where it stands as a whole, as one window; shorter items give nothing.
    In scripts without spaces every letter is a word.

    Null and empty texts match nothing.  Windows that are nearly all placeholders match
    nothing as templates.  Rows alike in id and text give one result, as do items.  Every
    text of a repeated id is looked for and gives its own row; items with a null id give
    none, see ``clean``.  Empty tables give an empty result; other columns are ignored.
    """
    return _leaks(docs, benchmark.where("item_id IS NOT NULL"), share)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without documents into which an item has leaked, with or without an id."""
    # Written, so that Spark knows its size when it picks the join.
    gone = stage(_leaks(docs, benchmark).select("_k1", "_k2").distinct(), "leaked-documents")
    keyed = docs.select("*", *content_key("doc_id", "text"))
    return keyed.join(gone, ["_k1", "_k2"], "left_anti").select(docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    found = leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("_k1", "_k2")
