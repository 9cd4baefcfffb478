"""PII: fixed patterns for protected entities, and information-theoretic sanitisation of what reveals them.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. The words of every text
that names an entity, wherever they stand in it, are candidate terms. With N distinct texts, n(e) of them
naming entity e, n(t) holding term t and n(t, e) holding both, a term tells PMI(t; e) =
log2(n(t, e) N / (n(t) n(e))) bits of the IC(e) = -log2(n(e) / N) bits that naming e would tell.

n(t) of a rare word says little about how rare it is, so a term is judged by the lower bound of its PMI,
with the upper confidence limit of n(t) for n(t). It is sanitised where that bound's share of IC exceeds
the disclosure threshold: removed where its PMI itself tells nearly everything, generalised to a class
otherwise. No number of texts is asked for, so entities that are named once are judged like others.

All counts cover the whole corpus; texts are told apart by 64-bit hashes. Terms that cannot reach the
threshold even if they occurred nowhere else are dropped before the corpus is counted, which loses none.

Defined results: null text is the empty text; a text without spans keeps its words; repeated rows
and null ids are treated row by row, and equal texts count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm import spans as sp
from sluiceway.llm.common import LOCATOR, WHOLE, located, stored

# The base patterns. A match can only begin where a run begins or the last match ended, which keeps scans linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
#: Candidate terms: runs of letters and digits that hold no ASCII mark.
TERM, NOT_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHORTEST = 3  # characters of a term
DISCLOSED, TOTAL = 0.7, 0.95
LIMIT = 1.96  # standard deviations to the upper limit of a count: 97.5 % one-sided
_ADDED = "array<struct<s: int, o: int, e: int, kind: string, by: string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    right = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(right, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Matches of each kind, without those that fail their test."""
    card_digits = lambda m: _digits(m["x"])
    n_card = lambda m: F.length(card_digits(m))
    digit = text.rlike("[0-9]")
    return {
        "email": sp.matches(text, EMAIL, when=F.contains(text, F.lit("@"))),
        "ip": F.filter(sp.matches(text, IP, when=digit), lambda m: F.forall(F.split(m["x"], r"\."), lambda p: p.rlike(OCTET))),
        "card": F.filter(sp.matches(text, CARD, when=digit), lambda m: F.when((n_card(m) >= 12) & (n_card(m) <= 19), luhn(card_digits(m))).otherwise(F.lit(False))),
        "phone": F.filter(sp.matches(text, PHONE, when=F.contains(text, F.lit("+"))), lambda m: n_card(m).between(9, 15)),
    }


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the characters of spans sorted by s, so that all others keep their places."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, m: Column) -> Column:
        start = F.greatest(a["at"], m["s"])
        piece = F.concat(F.substring(text, a["at"] + 1, start - a["at"]), F.repeat(F.lit(" "), F.greatest(m["e"] - start, F.lit(0))))
        return F.struct(F.greatest(a["at"], m["e"]).alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))

    return F.aggregate(spans, first, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def is_term(word: Column) -> Column:
    """Digits aren't terms: they belong to further entities."""
    return (F.length(word) >= SHORTEST) & ~word.rlike("^[0-9]+$")


def held_terms(rows: DataFrame, text: str) -> DataFrame:
    """(id, term) for the terms of each row, each once."""
    each = rows.select("id", F.explode(F.array_distinct(F.split(F.lower(text), NOT_TERM))).alias("term"))
    return each.where(is_term(F.col("term")))


def upper_limit(n: Column) -> Column:
    """Upper confidence limit of a Poisson count (Wilson and Hilferty)."""
    m = n + F.lit(1.0)
    return m * F.pow(1 - 1 / (9 * m) + LIMIT / (3 * F.sqrt(m)), F.lit(3.0))


def sized_entities(named: DataFrame, n: int) -> DataFrame:
    """(id, entity, n_e) of the entities that not all of the n texts name.

    What a term tells of an entity that one text alone names depends on the term only; so these entities of a
    text are one.
    """
    n_e = named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") < n)
    one = F.when(F.col("n_e") == 1, F.concat(F.lit("only in "), F.col("id").cast("string"))).otherwise(F.col("entity"))
    return named.join(n_e, "entity").select("id", one.alias("entity"), "n_e").distinct()


def revealing(rows: DataFrame, sized: DataFrame, holds: DataFrame, n: int, disclosed: float) -> DataFrame:
    """(term, entity, share): the share of the entity's information that the term tells, where its lower bound exceeds ``disclosed``.

    ``rows`` are (id, text) of the corpus, ``sized`` (id, entity, n_e) and ``holds`` (id, term) of the texts with entities.
    """
    total = F.lit(float(n))
    bits = lambda n_te, n_t, n_e: F.log2(n_te * total / (n_t * n_e))
    n_near = holds.groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    # at best a term stands in every text that names the text's least informative entity
    least = sized.groupBy("id").agg(F.max("n_e").alias("top"))
    could = F.log2(total / upper_limit(F.col("n_near"))) >= disclosed * F.log2(total / F.col("top"))
    kept = holds.join(least, "id").join(n_near, "term").where(could).drop("top")
    pairs = kept.join(sized, "id").groupBy("term", "entity").agg(
        F.count(F.lit(1)).alias("n_te"), F.first("n_near").alias("n_near"), F.first("n_e").alias("n_e"))
    told = lambda n_t: bits(F.col("n_te"), n_t, F.col("n_e")) / F.log2(total / F.col("n_e"))
    possible = stored(pairs.where(told(upper_limit(F.col("n_near"))) >= disclosed), "pii-terms")
    # each distinct text once, its terms once: counts are combined within each task before they are shuffled
    n_t = held_terms(rows.dropDuplicates(["id"]), "text").groupBy("term").agg(F.count(F.lit(1)).alias("n_all"))
    judged = possible.join(n_t, "term").withColumn("n_t", F.greatest("n_all", "n_near"))
    return judged.where(told(upper_limit(F.col("n_t"))) >= disclosed).select("term", "entity", told(F.col("n_t")).alias("share"))


def find(docs: DataFrame, disclosed: float = DISCLOSED) -> DataFrame:
    """One row per row of ``docs``: doc_id, LOCATOR, base and added spans as arrays of struct<s, o, e, kind[, by]>."""
    return found_in(located(docs, "doc_id", "text"), disclosed)


def found_in(rows: DataFrame, disclosed: float = DISCLOSED) -> DataFrame:
    """``find`` of located rows."""
    rows = rows.select("doc_id", *LOCATOR, F.coalesce("text", F.lit("")).alias("text"))
    kinds = base_spans(F.col("text"))

    def tagged(spans: Column, kind: str, order: int) -> Column:
        return F.transform(spans, lambda v: F.struct(
            v["s"].alias("s"), F.lit(order).alias("o"), v["e"].alias("e"), F.lit(kind).alias("kind"), v["x"].alias("x")))

    each = F.concat(*[tagged(m, kind, order) for order, (kind, m) in enumerate(kinds.items())])
    spanned = rows.select("doc_id", *LOCATOR, "text", F.array_sort(each).alias("base"))
    # a word inside a base span is part of that entity, not a term
    rest = F.when(F.size("base") > 0, blanked(F.col("text"), F.col("base")))
    found = stored(spanned.select("doc_id", *LOCATOR, F.xxhash64("text").alias("id"), "base", rest.alias("rest")), "pii-spans", "zstd")
    n = found.select("id").distinct().count()
    near = found.where(F.col("rest").isNotNull())
    entity = F.concat_ws(":", "b.kind", F.lower("b.x")).alias("entity")
    named = stored(near.select("id", F.explode("base").alias("b")).select("id", entity).distinct(), "pii-entities")
    sized = stored(sized_entities(named, n), "pii-sized")
    holds = stored(held_terms(near, "rest").distinct(), "pii-holds", "zstd")
    told = revealing(rows.select(F.xxhash64("text").alias("id"), "text"), sized, holds, n, disclosed)
    told = holds.join(told, "term").join(sized.select("id", "entity"), ["id", "entity"]).groupBy("id", "term").agg(F.max("share").alias("share"))
    told = told.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("share") >= TOTAL))).alias("told"))
    # few texts, much work on each: dealt out evenly rather than by their bytes
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    word = near.join(told, "id").repartition(parts, *LOCATOR).select(*LOCATOR, "told", F.explode(sp.matches(F.col("rest"), TERM)).alias("t"))
    word = word.where(is_term(F.col("t.x"))).select(*LOCATOR, "t.s", "t.e", "t.x", F.col("told")[F.lower("t.x")].alias("whole")).where("whole is not null")
    by = F.when(F.col("whole"), "").when(F.col("x").rlike(r"^[A-Z]"), "[NAME]").otherwise("[TERM]")
    added = word.select(*LOCATOR, F.struct("s", F.lit(4).alias("o"), "e", F.lit("term").alias("kind"), by.alias("by")).alias("v"))
    added = added.groupBy(*LOCATOR).agg(F.collect_list("v").alias("added"))
    return found.drop("rest", "id").join(added, list(LOCATOR), "left").withColumn("added", F.coalesce("added", F.array().cast(_ADDED)))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, LOCATOR of rows of ``find``."""
    plain = lambda c: F.transform(c, lambda m: F.struct(m["s"].alias("s"), m["o"].alias("o"), m["e"].alias("e"), m["kind"].alias("kind")))
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(sp.described(plain("base")), 256).alias("base_sha256"),
        sp.described(F.concat(plain("base"), plain("added"))).alias("spans"), F.size("added").cast("long").alias("n_terms"), *LOCATOR,
    )


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with base spans replaced by their kind, and revealing terms removed or generalised."""
    rows = located(docs, "doc_id", "text", whole=True)
    found = found_in(rows.drop(WHOLE), **options)
    base = F.transform("base", lambda m: F.struct(m["s"].alias("s"), m["o"].alias("o"), m["e"].alias("e"), m["kind"].alias("kind"), F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]")).alias("by")))
    spans = found.where((F.size("base") > 0) | (F.size("added") > 0)).select(*LOCATOR, F.array_sort(F.concat(base, "added")).alias("__spans"))
    joined = rows.select("text", WHOLE, *LOCATOR).join(spans, list(LOCATOR), "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(sp.replaced(F.col("text"), F.col("__spans")))
    return joined.select(*[text.alias("text") if c == "text" else F.col(WHOLE).getField(c).alias(c) for c in docs.columns])
