"""Personal data: patterns, and terms that give away who is meant.

E-mail addresses, IP addresses, card and phone numbers are found by pattern and check
digits.  They are the protected entities.  Co-occurrence in whole documents then tells how
much of an entity's information a term carries: a term t discloses an entity e when
PMI(t, e) >= ALPHA * IC(e), with IC(e) = -log2 p(e), which is to say when
p(e | t) >= p(e) ** (1 - ALPHA).  Such terms are spans as well wherever they stand, in
documents without an entity too, and are generalised.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import content_key
from tidemill.session import stage

#: Characters on each side of an entity that tell one context from another.
NEAR = 80
#: Words that do so for a term, the term in the middle.
AROUND = 5
#: Different contexts in which a term and an entity must meet.
SUPPORT = 3
#: Share of an entity's information from which a term discloses it.
ALPHA = 0.9
#: Disclosing terms up to this many are sent to every executor; more are joined by
#: shuffling the words of all documents.
BROADCAST_TERMS = 200_000
#: Spans of a text are put together in parts of this many, since an array that grows one by
#: one is copied each time.
PART = 128

# The kinds in their order and the patterns that find them.  Possessive
# forms and the look-behind change nothing in what is found: they only keep long runs of
# digits or letters from being tried again at every place.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have before a pattern is tried on it.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: A term ends with a letter or digit, so that quotes and dashes around it are no part of it.
_TERM = r"\p{L}[\p{L}\p{N}'-]+[\p{L}\p{N}]"
#: Addresses come first, so that their parts are no words.
_TOKEN = f"{PATTERNS['email']}|{_TERM}"
_SPAN = "struct<s:int,e:int,k:int,v:string,l:string,r:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, which a lambda otherwise does at each mention."""
    return F.get(F.transform(F.array(value), use), 0)


def in_parts(items: Column) -> Column:
    """An array cut into arrays of PART items, in order; an empty one gives one empty part."""
    many = lambda a: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / PART).cast("int") - 1, F.lit(0)))
    return let(items, lambda a: F.transform(many(a), lambda k: F.slice(a, k * PART + 1, PART)))


def walk(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The spans found on a way over ``items``: ``step`` gives the next state and an array of new spans."""
    none = F.array().cast(f"array<{_SPAN}>")

    def one(acc: Column, x: Column) -> Column:
        after, new = step(acc["p"], x)
        return F.struct(after.alias("p"), F.concat(acc["o"], new).alias("o"))

    def part(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["p"].alias("p"), none.alias("o")), one)
        return let(done, lambda d: F.struct(d["p"].alias("p"), F.concat(acc["o"], F.array(d["o"])).alias("o")))

    start = F.struct(state.alias("p"), F.array().cast(f"array<array<{_SPAN}>>").alias("o"))
    return F.aggregate(in_parts(items), start, part, lambda acc: F.flatten(acc["o"]))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _hinted(kind: str, text: Column) -> Column:
    return text.contains("@") if kind == "email" else text.rlike(HINTS[kind])


def _spans(kind: str, text: Column) -> Column:
    """Valid matches as an array of (start, end, kind, value, left, right).

    The text between matches and the matches themselves take turns, so their lengths add
    up to the places.
    """
    between, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    none = F.array().cast(f"array<{_SPAN}>")
    order = KINDS.index(kind)
    # Each match with the text before and after it.
    turns = let(F.struct(between.alias("b"), found.alias("f")), lambda t: F.arrays_zip(
        t["f"].alias("f"), F.slice(t["b"], F.lit(1), F.size(t["f"])).alias("b"), F.slice(t["b"], F.lit(2), F.size(t["f"])).alias("a"),
    ))

    def step(at: Column, z: Column) -> tuple[Column, Column]:
        start = at + F.length(z["b"])
        end = start + F.length(z["f"])
        span = F.struct(
            start.alias("s"), end.alias("e"), F.lit(order).alias("k"), z["f"].alias("v"),
            F.right(z["b"], F.lit(NEAR)).alias("l"), F.left(z["a"], F.lit(NEAR)).alias("r"),
        )
        return end, F.when(valid(kind, z["f"]), F.array(span)).otherwise(none)

    # Nested, so that nothing but the hint is worked out for texts without one.
    return F.when(_hinted(kind, text), F.when(F.size(found) > 0, walk(turns, F.lit(0), step)))


def words(text: Column) -> Column:
    """The words of a text in lower case, in order; the parts of e-mail addresses are none."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    found = F.when(text.contains("@"), F.filter(every(_TOKEN), lambda w: ~w.contains("@"))).otherwise(every(_TERM))
    return F.transform(found, F.lower)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, _k1, _k2, one column of spans per kind, null where there are none, and _words where there are some."""
    keyed = docs.select("doc_id", "text", *content_key("doc_id", "text"))
    spans = keyed.select("doc_id", "_k1", "_k2", *[_spans(k, F.col("text")).alias(k) for k in KINDS[:4]], "text")
    some = reduce(lambda a, b: a | b, [F.coalesce(F.size(k) > 0, F.lit(False)) for k in KINDS[:4]])
    return spans.withColumn("_words", F.when(some, words(F.col("text")))).drop("text")


def _entities(found: DataFrame) -> DataFrame:
    """_k1, _k2, entity and its first context, once for every document that has it."""
    none = F.array().cast(f"array<{_SPAN}>")
    every = F.concat(*[F.coalesce(F.col(k), none) for k in KINDS[:4]])
    return (
        found.select("_k1", "_k2", F.explode(every).alias("x"))
        .groupBy("_k1", "_k2", F.concat_ws(":", "x.k", F.lower("x.v")).alias("entity"))
        .agg(F.min_by(F.xxhash64("x.l", "x.r"), "x.s").alias("context"))
    )


def _near_terms(found: DataFrame) -> DataFrame:
    """entity, context and term of every term near an entity."""
    every = F.concat(*[F.coalesce(F.col(k), F.array().cast(f"array<{_SPAN}>")) for k in KINDS[:4]])
    span = found.select("_k1", "_k2", F.explode(every).alias("x")).select(
        "_k1", "_k2", F.concat_ws(":", "x.k", F.lower("x.v")).alias("entity"), "x.s", "x.e", "x.l", "x.r",
        F.xxhash64("x.l", "x.r").alias("context"),
    )
    sides = F.explode(
        F.array(
            F.struct((F.col("s") - F.length("l")).alias("at"), F.col("l").alias("t"), F.lit(True).alias("left")),
            F.struct(F.col("e").alias("at"), F.col("r").alias("t"), F.lit(False).alias("left")),
        )
    )
    side = span.select("_k1", "_k2", "entity", "context", sides.alias("y"))
    # A word cut by the edge of the context, or joined to the entity, is no term.
    text = F.concat(F.when(F.col("y.left"), F.lit("\x01")).otherwise(F.lit("\x02")), F.col("y.t"),
                    F.when(F.col("y.left"), F.lit("\x02")).otherwise(F.lit("\x01")))
    side = side.select("_k1", "_k2", "entity", "context", "y.at", text.alias("t"))
    words = F.transform(
        F.arrays_zip(F.split("t", _TERM, -1).alias("b"), F.regexp_extract_all("t", F.lit(_TERM), F.lit(0)).alias("f")),
        lambda z, i: F.struct(i.alias("i"), z["b"].alias("b"), z["f"].alias("f")),
    )
    in_side = Window.partitionBy("_k1", "_k2", "entity", "context", "at").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum(F.length("b") + F.coalesce(F.length("f"), F.lit(0))).over(in_side), F.lit(0))
    return (
        side.distinct()
        .select("_k1", "_k2", "entity", "context", "at", "t", F.explode(words).alias("w"))
        .select("_k1", "_k2", "entity", "context", "at", "t", "w.*")
        .withColumn("from", upto + F.length("b"))
        .where("f IS NOT NULL")
        .withColumn("before", F.substring(F.col("t"), F.col("from").cast("int"), F.lit(1)))
        .withColumn("after", F.substring(F.col("t"), (F.col("from") + F.length("f") + 1).cast("int"), F.lit(1)))
        .where("before NOT IN ('\x01', '\x02') AND after NOT IN ('\x01', '\x02')")
        .select("entity", "context", F.lower("f").alias("term"))
    )


def _counts(docs: DataFrame) -> DataFrame:
    """term and n_t, the documents whose text has the term, combined before the shuffle."""
    distinct = F.array_distinct(words(F.col("text")))
    return docs.select(F.explode(distinct).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """entity and term of the pairs above the disclosure threshold.

    A pair meets in every document that has both, however far apart.  It needs ``support``
    different contexts, of the entity or of the term, one to a document, or as many
    contexts of the entity that have the term in them.
    """
    n = docs.count()
    held = found.where("_words IS NOT NULL")
    entities = stage(_entities(held), "pii-entities")
    holders = entities.groupBy("entity").agg(F.count("*").alias("n_e"))
    close = (
        _near_terms(held).select("entity", "term", "context").distinct()
        .groupBy("entity", "term").agg(F.count("*").alias("_c")).where(F.col("_c") >= support)
    )
    close = stage(close.select("entity", "term"), "pii-close")
    # Other entities cannot reach the support.
    usable = holders.where(F.col("n_e") >= support).select("entity").union(close.select("entity")).distinct()
    usable = stage(entities.join(usable, "entity"), "pii-usable")
    around = F.transform("_words", lambda w, i: F.struct(
        w.alias("term"), i.alias("i"), F.xxhash64(F.slice("_words", F.greatest(i + 1 - AROUND // 2, F.lit(1)), AROUND)).alias("c")
    ))
    terms = (
        held.select("_k1", "_k2", "_words").dropDuplicates(["_k1", "_k2"])
        .join(usable.select("_k1", "_k2").distinct(), ["_k1", "_k2"], "left_semi")
        .select("_k1", "_k2", F.explode(around).alias("x"))
        .groupBy("_k1", "_k2", "x.term").agg(F.min_by("x.c", "x.i").alias("_around"))
    )
    meet = usable.join(terms, ["_k1", "_k2"]).groupBy("entity", "term").agg(
        F.count("*").alias("n_te"), F.greatest(F.count_distinct("context"), F.count_distinct("_around")).alias("_contexts")
    )
    meet = meet.join(close.withColumn("_close", F.lit(True)), ["entity", "term"], "left")
    meet = meet.where((F.col("_contexts") >= support) | F.col("_close")).select("entity", "term", "n_te")
    p_e = F.col("n_e") / F.lit(float(max(n, 1)))
    return (
        stage(meet, "pii-meetings").join(holders, "entity")
        .join(_counts(docs), "term")
        .where(F.least(F.lit(1.0), F.col("n_te") / F.col("n_t")) >= F.pow(p_e, F.lit(1 - alpha)))
        .select("entity", "term")
    )


def _places(text: Column, terms: Column) -> Column:
    """The places in ``text`` of the words in ``terms``, as spans."""
    turns = F.arrays_zip(F.split(text, _TOKEN, -1).alias("b"), F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)).alias("f"))
    none = F.lit(None).cast("string")

    def step(at: Column, z: Column) -> tuple[Column, Column]:
        start = at + F.length(z["b"])
        end = start + F.length(z["f"])
        word = F.lower(z["f"])
        span = F.struct(start.alias("s"), end.alias("e"), F.lit(4).alias("k"), word.alias("v"), none.alias("l"), none.alias("r"))
        return end, F.when(F.array_contains(terms, word), F.array(span)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return walk(turns, F.lit(0), step)


def _apart() -> Column:
    """The spans of column term that touch none of the other kinds.

    In one pass: entities by start and terms by end, in order, so that at each term the
    greatest end so far belongs to an entity that starts in time to touch it.
    """
    none = F.array().cast(f"array<{_SPAN}>")
    event = lambda at, is_term: lambda x: F.struct(x[at].alias("at"), F.lit(is_term).alias("t"), x.alias("x"))
    every = F.concat(F.transform("term", event("e", 1)), *[F.transform(F.coalesce(F.col(k), none), event("s", 0)) for k in KINDS[:4]])

    def step(reach: Column, v: Column) -> tuple[Column, Column]:
        stays = (v["t"] == 1) & (reach < v["x"]["s"])
        return F.when(v["t"] == 0, F.greatest(reach, v["x"]["e"])).otherwise(reach), F.when(stays, F.array(v["x"])).otherwise(none)

    return F.when(F.size("term") > 0, walk(F.array_sort(every), F.lit(-1), step))


def _term_spans(docs: DataFrame, told: DataFrame) -> DataFrame:
    """_k1, _k2 and all places of disclosing terms, of every document that has one."""
    terms = stage(told.select("term").distinct(), "pii-terms")
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    keyed = docs.select("text", *content_key("doc_id", "text"))
    holds = keyed.select("_k1", "_k2", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    holds = holds.join(terms, "term").groupBy("_k1", "_k2").agg(F.collect_set("term").alias("_terms"))
    # Written, so that Spark knows its size when it picks the join with the texts.
    placed = keyed.join(stage(holds, "pii-holders"), ["_k1", "_k2"])
    return placed.select("_k1", "_k2", _places(F.col("text"), F.col("_terms")).alias("term")).dropDuplicates(["_k1", "_k2"])


def find(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """doc_id, _k1, _k2 and the arrays email, ip, card, phone, term for every row of ``docs``.

    Null and empty texts have no spans.  Rows alike in id and text get the same spans and
    count once among a pair's meetings.  A term that touches an entity is part of it and no
    span.  An empty table gives an empty result; other columns are ignored.
    """
    plain = docs.select("doc_id", "text")
    found = stage(base_spans(plain), "pii-spans")
    spans = stage(_term_spans(plain, disclosing(plain, found, support, alpha)), "pii-term-spans")
    return found.drop("_words").join(spans, ["_k1", "_k2"], "left").withColumn("term", _apart())


def _joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind, joined by commas."""
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")
    every = F.concat(*[
        F.coalesce(F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))), empty)
        for k in kinds
    ])
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, such as <EMAIL>; overlapping spans by the first."""
    found = find(docs)
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")
    every = F.array_sort(F.concat(*[
        F.coalesce(F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))), empty)
        for k in KINDS
    ]))
    spans = found.select("_k1", "_k2", every.alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["_k1", "_k2"])
    # Written, so that Spark knows its size when it picks the join with the texts.
    spans = stage(spans, "pii-masks")
    keyed = docs.select("*", *content_key("doc_id", "text"))
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        skip = x["e"] <= acc["p"]
        # A span that begins inside the one before it only removes what is left of it.
        start = F.greatest(x["s"], acc["p"])
        new = F.concat(acc["o"], F.array(
            F.substring(acc["t"], acc["p"] - acc["z"] + 1, start - acc["p"]), F.when(x["s"] < acc["p"], "").otherwise(F.get(marks, x["k"])),
        ))
        return F.struct(
            F.when(skip, acc["p"]).otherwise(x["e"]).alias("p"), F.when(skip, acc["o"]).otherwise(new).alias("o"), acc["t"].alias("t"), acc["z"].alias("z")
        )

    def part(acc: Column, xs: Column) -> Column:
        # The text of a part is cut out first: finding a place takes a pass over all before it.
        last = F.greatest(acc["p"], F.array_max(F.transform(xs, lambda x: x["e"])))
        piece = F.substring(F.col("text"), acc["p"] + 1, last - acc["p"])
        start = F.struct(acc["p"].alias("p"), F.array().cast("array<string>").alias("o"), piece.alias("t"), acc["p"].alias("z"))
        done = F.aggregate(xs, start, step, lambda d: F.struct(d["p"].alias("p"), F.array_join(d["o"], "").alias("o")))
        return let(done, lambda d: F.struct(d["p"].alias("p"), F.concat(acc["o"], F.array(d["o"])).alias("o")))

    zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("o"))
    tail = lambda acc: F.concat(F.array_join(acc["o"], ""), F.substring("text", acc["p"] + 1, F.length("text")))
    changed = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.aggregate(in_parts(F.col("_spans")), zero, part, tail))
    return keyed.join(spans, ["_k1", "_k2"], "left").select(
        *[changed.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    )


def op2(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    found = find(read_table(spark, sf_dir, "documents"))
    n = lambda k: F.when(F.col(k).isNull(), F.lit(0)).otherwise(F.size(k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[n(k) for k in KINDS], F.sha2(_joined(KINDS[:4]), 256).alias("base_sha256"), _joined(KINDS).alias("spans")
    )
