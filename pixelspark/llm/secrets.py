"""Secrets by pattern, and random strings by a battery of randomness tests.

Base spans come from three patterns. The method looks at every run of MIN_RUN or more characters of the usual encodings that
holds a digit and a letter. Its encoding is inferred (hex, base 32, else base 64), its characters become numbers, and
three tests are made against chance: chi-squared uniformity over the alphabet, runs above and below the middle, and serial
correlation of neighbours; the run may not fail them. The test against text is the likelihood ratio of equal chances to a
text's transitions from character to character: that a text reaches a ratio of r has a chance of 1 / r at most, at every
length. The transitions are counted over all runs of all documents but those that already look random beside PRIOR
(so secrets, however many, do not make the text), and backed by PRIOR where counts are few. By encoding and length class
the false-discovery rate of these p-values is held at `rate` (Benjamini-Hochberg on counts by p-value bin). A run above
its class's bar that passes the other tests is a span.

The first pass only adds up a table of transitions, the second one of (class, bin) counts, both of a fixed size; the third is
map-only, with one bar per class.
Everything is DataFrame expressions.

Defined results: null and empty text have no spans (counts 0, empty strings, the hash of the empty string); a null
doc_id stays null; repeated rows get equal results, one row each; an empty table gives no rows. redact() keeps all
columns. Spans are whole matches in code points, end exclusive; of overlapping spans of the method and of a base
pattern the latter stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns of the contract. Hexadecimal runs are greedy, so asking for 32 at once drops no other.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

BLOCK = 256
MIN_RUN = 24
RUN = f"[A-Za-z0-9+/_-]{{{MIN_RUN},}}"
#: The alphabets in the order of their digits.
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE16 = "0123456789abcdef"
CODES = BASE64 + "-_"  # a character's code is its place
KIND_OF = [0] * 26 + [1] * 26 + [2] * 10 + [3] * 4  # upper, lower, digit, sign
#: The chances of each kind after each kind, and first, in the joined words of names, paths and addresses.
PRIOR = ((0.40, 0.50, 0.05, 0.05), (0.02, 0.93, 0.02, 0.03), (0.03, 0.07, 0.80, 0.10), (0.10, 0.60, 0.25, 0.05), (0.20, 0.60, 0.10, 0.10))
PRIOR_N, BACK_N = 200, 50  # counts that PRIOR, and the kinds beside the characters, stand for
ENCODINGS = 4  # among which the best one is taken: hex of either case, base 32, base 64
CHANCE = 0.001  # below this, chance is rejected
BINS_PER_TEN, MAX_BIN = 10, 300  # of -log10 p


def placed(text: str, pattern: str, kind: int, keep) -> Column:
    """array<struct<at, kind, end>>: the matches of a pattern, leftmost and non-overlapping, that keep(matches, i) holds for.

    The pieces between the matches give the places. `text` names a column.
    """
    pieces, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(pieces, found, lambda a, b: F.struct(F.length(a).alias("skip"), F.length(b).alias("long"), b.alias("match")))
    lengths = F.filter(lengths, lambda x: x["long"].isNotNull())
    empty = F.array().cast("array<struct<at:int,kind:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + x["skip"]
        span = F.struct(at.alias("at"), F.lit(kind).alias("kind"), (at + x["long"]).alias("end"))
        return F.struct((at + x["long"]).alias("pos"), F.when(keep(x["match"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc["pos"].alias("pos"), empty.alias("out")), step)
        return F.element_at(F.transform(F.array(own), lambda o: F.struct(o["pos"].alias("pos"), F.concat(acc["out"], F.array(o["out"])).alias("out"))), 1)

    # a text's matches a block at a time: an array that grows by one is copied each time
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<array<struct<at:int,kind:int,end:int>>>").alias("out"))
    return F.aggregate(in_blocks(lengths), start, block, lambda acc: F.flatten(acc["out"]))


def in_blocks(values: Column) -> Column:
    """An array as an array of arrays of BLOCK values."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
    return F.element_at(F.transform(F.array(values), lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.array())), 1)


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds _base: the base spans, by start. The patterns only run on texts that have one of their words."""
    low = F.lower(text)
    named = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    value = lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}", 2)) >= 8
    none = F.array().cast("array<struct<at:int,kind:int,end:int>>")
    assign = F.when(named, placed(text, ASSIGN, 0, value)).otherwise(none)
    access = F.when(F.contains(F.col(text), F.lit("AKIA")), placed(text, ACCESS, 1, lambda m: F.length(m) >= 16)).otherwise(none)
    hexes = F.when(F.col(text).rlike(HEX), placed(text, HEX, 2, lambda m: F.lit(True))).otherwise(none)
    return df.withColumn("_assign", assign).withColumn("_access", access).withColumn("_hex", hexes).withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))


def _phi(z: Column) -> Column:
    """Nearly the normal distribution function, increasing everywhere."""
    bounded = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return 1 / (1 + F.exp(-(1.5976 * bounded + 0.07056 * F.pow(bounded, F.lit(3)))))


def steps(run: Column) -> Column:
    """The transitions of a run: its characters' codes, each with that of the character before it (or none)."""
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(CODES), c) - 1)
    step = lambda x: F.transform(x, lambda c, i: F.coalesce(F.get(x, i - 1), F.lit(len(CODES))) * len(CODES) + c)
    return F.element_at(F.transform(F.array(codes), step), 1)


def costs(counts: dict[int, int]) -> list[float]:
    """-log of the chance of each transition in a text, by step: characters backed by kinds, and kinds by PRIOR."""
    size, kinds = len(CODES), [*KIND_OF, 4]
    moves, chars = [[0] * 4 for _ in range(5)], [0] * size
    for step, n in counts.items():
        moves[kinds[step // size]][kinds[step % size]] += n
        chars[step % size] += n
    of_kind = [KIND_OF.count(k) for k in range(4)]
    total = [sum(n for n, k in zip(chars, KIND_OF, strict=True) if k == j) for j in range(4)]
    share = [(chars[c] + PRIOR_N / of_kind[k]) / (total[k] + PRIOR_N) for c, k in enumerate(KIND_OF)]
    move = [[(moves[a][b] + PRIOR_N * PRIOR[a][b]) / (sum(moves[a]) + PRIOR_N) for b in range(4)] for a in range(5)]
    out = []
    for a in range(size + 1):
        row = [counts.get(a * size + c, 0) for c in range(size)]
        out += [-math.log((n + BACK_N * move[kinds[a]][KIND_OF[c]] * share[c]) / (sum(row) + BACK_N)) for c, n in enumerate(row)]
    return out


def tested(run: Column, cost: list[float]) -> Column:
    """struct<stratum, bin, chance> of one run: its class, its -log10 p-value against text in bins, and whether chance stands.

    Nested transforms over one-element arrays keep each intermediate value from being worked out twice.
    """
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def of(core: Column) -> Column:
        is16 = core.rlike("^([0-9a-f]+|[0-9A-F]+)$")
        is32 = core.rlike("^[A-Z2-7]+$")
        size = F.when(is16, F.lit(16)).when(is32, F.lit(32)).otherwise(F.lit(64))
        letters = F.when(is16, F.lit(BASE16)).when(is32, F.lit(BASE32)).otherwise(F.lit(BASE64))
        shown = F.when(is16, F.lower(core)).otherwise(F.translate(core, "-_", "+/"))
        table = F.split(F.lit(" ".join(f"{c:.3f}" for c in cost)), " ").cast("array<double>")  # folded to one literal
        text = F.aggregate(steps(core), F.lit(0.0), lambda a, s: a + F.get(table, s))
        return let(F.struct(size.alias("k"), text.alias("text"), F.transform(F.split(shown, ""), lambda c: F.instr(letters, c) - 1).alias("x")), battery)

    def battery(v: Column) -> Column:
        x, k = v["x"], v["k"].cast("double")
        n = F.size(x).cast("double")
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x, lambda y: y == c)).cast("double"), F.lit(2.0)))
        high = F.transform(x, lambda y: (y >= k / 2).cast("int"))
        ones = F.aggregate(high, F.lit(0), lambda a, y: a + y).cast("double")
        changes = F.aggregate(high, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("runs")), lambda a, y: F.struct(y.alias("last"), (a["runs"] + (y != a["last"]).cast("int")).alias("runs")), lambda a: a["runs"]).cast("double")
        middle = (k - 1) / 2
        pairs = F.aggregate(x, F.struct(middle.alias("last"), F.lit(0.0).alias("sum"), F.lit(1e-9).alias("all")), lambda a, y: F.struct(y.cast("double").alias("last"), (a["sum"] + (a["last"] - middle) * (y - middle)).alias("sum"), (a["all"] + F.pow(y - middle, F.lit(2.0))).alias("all")), lambda a: a["sum"] / a["all"])
        return let(F.struct(k.alias("k"), n.alias("n"), v["text"].alias("text"), squares.alias("sq"), ones.alias("ones"), changes.alias("runs"), pairs.alias("serial")), verdict)

    def verdict(s: Column) -> Column:
        k, n = s["k"], s["n"]
        chi = (k / n * s["sq"] - n - (k - 1)) / F.sqrt(2 * (k - 1))
        ones, zeros = s["ones"], n - s["ones"]
        mean = 2 * ones * zeros / n + 1
        spread = F.sqrt(F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (n - 1)))
        runs, serial = F.abs(s["runs"] - mean) / spread, F.abs(s["serial"]) * F.sqrt(n)
        chance = F.least(_phi(-chi), 2 * _phi(-runs), 2 * _phi(-serial)) * 3 >= CHANCE
        ratio = (s["text"] - n * F.log(k) - math.log(ENCODINGS)) / math.log(10)
        return F.struct(
            (F.log2(k) * 100 + F.least(F.floor(2 * F.log2(n)), F.lit(40))).cast("int").alias("stratum"),
            F.least(F.lit(MAX_BIN), F.floor(F.greatest(F.lit(0.0), ratio) * BINS_PER_TEN)).cast("int").alias("bin"),
            chance.alias("chance"),
        )

    return let(run, of)


def is_candidate(run: Column) -> Column:
    return run.rlike("[0-9]") & run.rlike("[A-Za-z]")


def runs_of(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).rlike(RUN)).select(F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))


def text_costs(df: DataFrame, text: str) -> list[float]:
    """The transitions of all runs but those that equal chances explain better than PRIOR."""
    runs = runs_of(df, text).withColumn("t", F.when(is_candidate(F.col("run")), tested(F.col("run"), costs({}))))
    moves = runs.where(F.coalesce(F.col("t.bin"), F.lit(0)) == 0).select(F.explode(steps(F.col("run"))).alias("step"))
    return costs({r.step: r["count"] for r in moves.groupBy("step").count().collect()})  # at most 67 x 66 rows


def bars(df: DataFrame, text: str, rate: float, cost: list[float]) -> dict[int, int]:
    """The least bin of each class that holds the false-discovery rate over all runs of all documents."""
    runs = runs_of(df, text)
    tests = runs.where(is_candidate(F.col("run"))).select(tested(F.col("run"), cost).alias("t"))
    table = tests.groupBy("t.stratum", "t.bin").count().collect()  # at most 3 x 41 classes x MAX_BIN + 1 bins
    found: dict[int, int] = {}
    for stratum in {r.stratum for r in table}:
        counts = {r.bin: r["count"] for r in table if r.stratum == stratum}
        total, above, bar = sum(counts.values()), 0, MAX_BIN + 1
        for b in sorted(counts, reverse=True):
            above += counts[b]
            if 10 ** (-b / BINS_PER_TEN) <= rate * above / total:
                bar = b
        found[stratum] = bar
    return found


def with_spans(docs: DataFrame, rate: float = 0.01, text: str = "text") -> DataFrame:
    """docs with _text (never null), _base and _all (base and random spans) added."""
    df = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    texts = docs.select(F.coalesce(text, F.lit("")).alias("_text"))
    cost = text_costs(texts, "_text")
    least = bars(texts, "_text", rate, cost)
    df = with_base(df, "_text")
    none = F.array().cast("array<struct<at:int,kind:int,end:int>>")
    if least:
        bar_of = F.create_map(*(F.lit(x) for pair in sorted(least.items()) for x in pair))

        def holds(run: Column) -> Column:
            ok = lambda t: t["chance"] & (t["bin"] >= F.coalesce(F.try_element_at(bar_of, t["stratum"]), F.lit(MAX_BIN + 1)))
            return F.when(is_candidate(run), F.element_at(F.transform(F.array(tested(run, cost)), ok), 1)).otherwise(F.lit(False))

        found = F.when(F.col("_text").rlike(RUN), placed("_text", RUN, 3, holds)).otherwise(none)
        df = df.withColumn("_random", found)
        apart = F.filter("_random", lambda r: ~F.exists("_base", lambda b: (b["at"] < r["end"]) & (r["at"] < b["end"])))
    else:
        apart = none
    return df.withColumn("_all", F.array_sort(F.concat("_base", apart)))


def named(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["at"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    df = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rate)
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return df.select("doc_id", *counts, F.sha2(named("_base"), 256).alias("base_sha256"), named("_all").alias("spans"))


def redact(docs: DataFrame, rate: float = 0.01, mask: str = "[SECRET]") -> DataFrame:
    """The same columns, with every span of every text replaced by the mask (overlapping spans by one)."""
    names = docs.columns
    clash = {c: f"_own{k}" for k, c in enumerate(names)}  # the helpers' names may not meet those of the table
    df = with_spans(docs.toDF(*clash.values()), rate, clash["text"])
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        cut = F.concat(F.substring(F.col("_text"), acc["pos"] + 1, s["at"] - acc["pos"]), F.lit(mask))
        covered = s["at"] < acc["pos"]
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(cut))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc["pos"].alias("pos"), none.alias("out")), step)
        return F.element_at(F.transform(F.array(own), lambda o: F.struct(o["pos"].alias("pos"), F.concat(acc["out"], F.array(F.array_join(o["out"], ""))).alias("out"))), 1)

    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
    clean = F.aggregate(in_blocks(F.col("_all")), start, block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("_text"), acc["pos"] + 1, F.length("_text"))))
    kept = F.when(F.size("_all") > 0, clean).otherwise(F.col(clash["text"]))
    size = lambda own: F.when(F.size("_all") > 0, F.length(kept).cast("long")).otherwise(F.col(own))
    out = [(kept if c == "text" else size(own) if c == "n_chars" else F.col(own)).alias(c) for c, own in clash.items()]
    return df.select(*out)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
