"""Secret scans: three fixed patterns, and a randomness battery for every token.

Base spans are the matches of assign, access and hex. Every run of letters, digits and ``+/_-`` is a
token; each distinct token is put through three tests over the alphabet of its inferred encoding, all
with the null hypothesis that its symbols are drawn uniformly: chi-squared of the symbols' counts,
the runs above and below the alphabet's middle, and the lag-one serial correlation. Fisher's method
combines the three p-values into one.

The combined value is then judged by what text that isn't random would give at that length: the
symbols of all tokens of the corpus give, for each alphabet, the mean and the variance that
chi-squared has in natural text of n symbols. For the combined statistic to be as small as seen,
chi-squared alone must be so small, and the chance of that in natural text is the token's
evidence. Short tokens, on which the tests have little power, get weak evidence by this. Evidence
passes Benjamini-Hochberg control within each class of lengths, so that the share of natural tokens
among those taken for secrets is bounded in every class.

Evidence is binned for the control and symbols are counted by character, so bounded tables are all
that is gathered. Tokens within base spans are tested like others; one that is a base span as it
stands isn't named again.

Defined results: null text is the empty text; a text without matches has empty spans and the hash
of the empty string; repeated rows and null ids are scanned row by row; equal tokens are one
hypothesis; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm import spans as sp
from sluiceway.llm.common import LOCATOR, located, stored

# Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
TOKEN, NOT_TOKEN = r"[A-Za-z0-9+/_-]++", r"[^A-Za-z0-9+/_-]+"

# Alphabets of the encodings, in the order in which they are tried (fixed values).
_D, _U, _L = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [
    ("decimal", "^[0-9]+$", _D),
    ("hex", "^[0-9a-f]+$", _D + _L[:6]),
    ("upper_hex", "^[0-9A-F]+$", _D + _U[:6]),
    ("lower", "^[a-z]+$", _L),
    ("upper", "^[A-Z]+$", _U),
    ("base32", "^[A-Z2-7]+$", _U + _D[2:8]),
    ("lower36", "^[a-z0-9]+$", _L + _D),
    ("upper36", "^[A-Z0-9]+$", _U + _D),
    ("alnum", "^[A-Za-z0-9]+$", _U + _L + _D),
    ("base64", "^[A-Za-z0-9+/]+$", _U + _L + _D + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", _U + _L + _D + "-_"),
    ("mixed", "^", _U + _L + _D + "+/-_"),
]
FALSE_DISCOVERIES = 0.05
CLASSES = (8, 12, 16, 20, 24, 32, 48, 64, 128)
BINS_PER_DECADE, MAX_BIN = 20, 600
BROADCAST_TOKENS = 200_000


def normal_tail(z: Column) -> Column:
    """Share of a standard normal above z (rational approximation of the error function, error under 2e-7, floored at 1e-30)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = F.greatest(0.5 * poly * F.exp(-x * x), F.lit(1e-30))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def normal_point(p: Column) -> Column:
    """The z above which a share p of a standard normal lies (rational approximation, error under 5e-4)."""
    small = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(F.greatest(small, F.lit(1e-300))))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return F.when(p <= 0.5, z).otherwise(-z)


def encoding_of(token: Column) -> Column:
    """The place in ENCODINGS of the first alphabet that a token fits."""
    out = F.lit(len(ENCODINGS) - 1)
    for i in reversed(range(len(ENCODINGS) - 1)):
        out = F.when(token.rlike(ENCODINGS[i][1]), i).otherwise(out)
    return out


def symbol_counts(tokens: DataFrame) -> dict[str, int]:
    """How often each symbol occurs in the tokens (token, times): a row for each of 66 characters at most."""
    symbols = tokens.select("times", F.explode(F.split("token", "")).alias("c")).where("c <> ''")
    return {r["c"]: r["k"] for r in symbols.groupBy("c").agg(F.sum("times").alias("k")).collect()}


def coincidences(counts: dict[str, int]) -> list[tuple[float, float]]:
    """For each encoding, the sums of squares and of cubes of its symbols' shares in natural text.

    A token in one case is a word in that case: there, both cases of a letter count together.
    """
    out = []
    for _, _, alphabet in ENCODINGS:
        one_case = not (set(alphabet) & set(_U) and set(alphabet) & set(_L))
        seen = [counts.get(c, 0) + (counts.get(c.swapcase(), 0) if one_case and c.isalpha() else 0) for c in alphabet]
        total = sum(seen) or len(seen)
        shares = [k / total for k in seen] if sum(seen) else [1 / len(seen)] * len(seen)
        out.append((sum(q**2 for q in shares), sum(q**3 for q in shares)))
    return out


def battery(tokens: DataFrame, natural: list[tuple[float, float]]) -> DataFrame:
    """Adds encoding, n, chi, p_chi, p_runs, p_serial, fisher, p_random and p_natural to rows with ``token``."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("e") + 1)
    rows = tokens.withColumn("e", encoding_of(F.col("token")))
    rows = rows.withColumn("alphabet", pick([x for _, _, x in ENCODINGS])).withColumn("n", F.length("token"))
    codes = F.transform(F.filter(F.split("token", ""), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c) - 1)
    rows = rows.withColumn("codes", codes).withColumn("a", F.length("alphabet").cast("double"))
    zero = F.struct(*[F.lit(v).alias(k) for k, v in (("sum", 0.0), ("squares", 0.0), ("lagged", 0.0), ("high", 0.0), ("runs", 0.0), ("last", -1.0))])

    def step(acc: Column, c: Column) -> Column:
        x, half = c.cast("double"), F.col("a") / 2
        first = acc["last"] < 0
        return F.struct(
            (acc["sum"] + x).alias("sum"), (acc["squares"] + x * x).alias("squares"),
            (acc["lagged"] + F.when(first, 0.0).otherwise(acc["last"] * x)).alias("lagged"),
            (acc["high"] + F.when(x >= half, 1.0).otherwise(0.0)).alias("high"),
            (acc["runs"] + F.when(first | ((acc["last"] >= half) != (x >= half)), 1.0).otherwise(0.0)).alias("runs"),
            x.alias("last"),
        )

    # sorted symbols: the lengths of their runs are the symbols' counts
    tally = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def count(acc: Column, c: Column) -> Column:
        same = acc["last"] == c
        return F.struct(c.alias("last"), F.when(same, acc["run"] + 1).otherwise(1.0).alias("run"),
                        F.when(same, acc["sum"]).otherwise(acc["sum"] + acc["run"] * acc["run"]).alias("sum"))

    squares = F.aggregate(F.array_sort("codes"), tally, count, lambda acc: acc["sum"] + acc["run"] * acc["run"])
    rows = rows.withColumn("squares", squares).withColumn("m", F.aggregate("codes", zero, step))
    # each step names what the next ones use more than once: plans then hold every expression once
    m, nd, a, dof = F.col("m"), F.col("n").cast("double"), F.col("a"), F.col("a") - 1
    first = F.get("codes", F.lit(0)).cast("double")
    rows = rows.withColumn("chi", F.greatest(F.col("squares") * a / nd - nd, F.lit(0.0))).withColumn("mean", m["sum"] / nd)
    mean, hi = F.col("mean"), m["high"]
    rows = rows.withColumn("var", m["squares"] - nd * mean * mean).withColumn("mu", 2 * hi * (nd - hi) / nd + 1)
    cov = m["lagged"] - mean * (2 * m["sum"] - first - m["last"]) + (nd - 1) * mean * mean
    rows = rows.withColumn("spread", (F.col("mu") - 1) * (F.col("mu") - 2) / F.greatest(nd - 1, F.lit(1.0)))
    # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is near to normal
    rows = rows.withColumn("z_chi", (F.cbrt(F.col("chi") / dof) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof)))
    rows = rows.withColumn("z_serial", F.abs(F.when(F.col("var") > 1e-9, (cov / F.col("var") + 1 / nd) * F.sqrt(nd)).otherwise(99.0)))
    rows = rows.withColumn("z_runs", F.abs(F.when(F.col("spread") > 1e-9, (m["runs"] - F.col("mu")) / F.sqrt("spread")).otherwise(99.0)))
    both_tails = lambda z: F.least(2 * normal_tail(F.col(z)), F.lit(1.0))
    rows = rows.withColumn("p_chi", normal_tail(F.col("z_chi"))).withColumn("p_runs", both_tails("z_runs")).withColumn("p_serial", both_tails("z_serial"))
    rows = rows.withColumn("fisher", -2 * (F.log("p_chi") + F.log("p_runs") + F.log("p_serial")))
    x = F.col("fisher")
    # natural text gives a combined value as small as this only where its chi-squared is below ``most``
    rows = rows.withColumn("point", normal_point(F.exp(-x / 2)))
    most = dof * F.pow(F.greatest(1 - 2 / (9 * dof) + F.col("point") * F.sqrt(2 / (9 * dof)), F.lit(0.0)), F.lit(3.0))
    rows = rows.withColumn("k2", pick([v[0] for v in natural])).withColumn("k3", pick([v[1] for v in natural]))
    k2, k3 = F.col("k2"), F.col("k3")
    spread = 2 * nd * (nd - 1) * (k2 + 2 * (nd - 2) * k3 - (2 * nd - 3) * k2 * k2) * a * a / (nd * nd)
    z_natural = (dof + (nd - 1) * (a * k2 - 1) - most) / F.sqrt(F.greatest(spread, 2 * dof * (nd - 1) / nd))
    enough = (F.col("n") >= 2) & (hi > 0) & (hi < nd)
    rows = rows.withColumn("z_natural", F.when(enough, z_natural))
    return rows.select(
        *tokens.columns, pick([x for x, _, _ in ENCODINGS]).alias("encoding"), "n", "chi", "p_chi", "p_runs", "p_serial", "fisher",
        (F.exp(-x / 2) * (1 + x / 2 + x * x / 8)).alias("p_random"),  # six degrees of freedom
        F.when(F.col("z_natural").isNull(), 1.0).otherwise(normal_tail(F.col("z_natural"))).alias("p_natural"),
    )


def discoveries(tested: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Rows of ``battery``, each a distinct token, that are taken for random secrets."""
    size_class = F.lit(0)
    for edge in CLASSES:
        size_class = size_class + (F.col("n") >= edge).cast("int")
    binned = F.least(F.floor(-F.log10("p_natural") * BINS_PER_DECADE).cast("int"), F.lit(MAX_BIN))
    rows = tested.withColumn("class", size_class).withColumn("bin", F.greatest(binned, F.lit(0)))
    sizes = rows.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("k"))  # at most 10 x 601 rows
    low = Window.partitionBy("class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    steps = sizes.withColumn("found", F.sum("k").over(low)).withColumn("all", F.sum("k").over(Window.partitionBy("class")))
    passed = steps.where(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= rate * F.col("found") / F.col("all"))
    least = passed.groupBy("class").agg(F.min("bin").alias("least"))  # at most one row a class
    return rows.join(F.broadcast(least), "class").where(F.col("bin") >= F.col("least"))


def random_tokens(rows: DataFrame) -> DataFrame:
    """The tokens of all texts of ``rows`` that are taken for random secrets, with their tests; stored."""
    each = rows.select(F.explode(F.split(F.coalesce("text", F.lit("")), NOT_TOKEN)).alias("token")).where("token <> ''")
    tokens = stored(each.groupBy("token").agg(F.count(F.lit(1)).alias("times")), "secret-tokens")
    tested = stored(battery(tokens, coincidences(symbol_counts(tokens))), "secret-tests")
    return stored(discoveries(tested), "secret-random")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, LOCATOR."""
    rows = located(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    assign = F.filter(sp.matches(text, ASSIGN, 2), lambda m: F.length(m["g"]) >= 8)
    base = F.concat(
        sp.of_kind(assign, "assign", 0),
        sp.of_kind(sp.matches(text, ACCESS, when=F.contains(text, F.lit("AKIA"))), "access", 1),
        sp.of_kind(sp.matches(text, HEX), "hex", 2),
    )
    found = stored(rows.select("doc_id", *LOCATOR, base.alias("base")), "secret-spans")
    random = random_tokens(rows)
    size = random.agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least")).first()
    random = random.select("token")
    random = F.broadcast(random) if size["n"] <= BROADCAST_TOKENS else random
    # texts that hold such a token; shorter tokens needn't be looked up
    long = F.filter(F.split(text, NOT_TOKEN), lambda t: F.length(t) >= F.lit(size["least"] or 1))
    holds = rows.select(*LOCATOR, F.explode(F.array_distinct(long)).alias("token")).join(random, "token")
    holds = holds.groupBy(*LOCATOR).agg(F.collect_set("token").alias("random"))
    placed = rows.join(holds, list(LOCATOR)).select(*LOCATOR, "random", sp.matches(F.col("text"), TOKEN).alias("tokens"))
    placed = placed.select(*LOCATOR, F.filter("tokens", lambda t: F.array_contains("random", t["x"])).alias("tokens"))
    both = found.join(placed, list(LOCATOR), "left")
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["s"] == t["s"]) & (t["e"] == b["e"])))
    added = F.coalesce(sp.of_kind(apart, "random", 3), F.array().cast("array<struct<s: int, o: int, e: int, kind: string>>"))
    both = both.select("doc_id", *LOCATOR, "base", added.alias("added"))
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return both.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(sp.described(F.col("base")), 256).alias("base_sha256"),
        sp.described(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_random"), *LOCATOR,
    )
