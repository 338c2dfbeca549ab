"""Quality rules: counts of each document, and lines that many documents of one host share.

Every line is normalised (lower case, runs of white space to one space, trimmed) and hashed. For each host (the
source column) and line the documents that hold it are counted. A line in more than `percent` per cent of the host's documents, and
in more than `least` of them, is common and counts as removed; a document of which less than `min_left` of its words would
be left is depleted and not kept. clean() gives the texts without their common lines. Everything is DataFrame expressions.

Shuffles carry hashes only. A document sends each of its lines once, and partial counts are added up per (host, line),
so a line that a third of all documents has is no hot key. The few lines above the limit meet the documents' lines in an
equi-join that Spark may broadcast by size or split where skewed.

Defined results: null text has no words, all counts 0, and fails the base rule; a null source is a host of its own;
a null doc_id stays null; repeated rows are documents of their own and get equal results, one row each; a line in exactly the
limit's number of documents stays, and so does a document with exactly min_left of its words; a very long text is taken
whole, its lines and windows being arrays in one row; an empty table gives no rows; other columns are ignored, and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def with_repeats(df: DataFrame, words: str = "words") -> DataFrame:
    """Adds n_repeat_words: words in windows of WINDOW words that the text has twice or more.

    Almost no text repeats a window, which one pass over a hash set tells; only for the others are the windows sorted.
    """
    df = df.withColumn("_hash", F.transform(words, lambda w: F.xxhash64(w)))
    rolled = F.transform("_hash", lambda x, i: F.xxhash64(x, *(F.get("_hash", i + k) for k in range(1, WINDOW))))
    df = df.withColumn("_windows", F.slice(rolled, 1, F.greatest(F.size("_hash") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda e, j: F.coalesce(e["h"] == F.get("_sorted", j)["h"], F.lit(False))
    df = df.withColumn("_starts", F.array_sort(F.transform(F.filter("_sorted", lambda e, j: twin(e, j - 1) | twin(e, j + 1)), lambda e: e["i"])))
    covered = F.transform("_starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_hash", "_windows", "_sorted", "_starts")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host, same (hash of the text) and the base columns of every document. Map only."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select("doc_id", "host", F.xxhash64("_text").alias("same"), F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), words_of(F.col("_text")).alias("words"), lines.alias("_lines"))
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = with_repeats(df).drop("words")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def normal_lines(text: Column) -> Column:
    """The text's lines, lower-cased, with one space between words and none around them."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[\\x20\\x09\\x0B-\\x0D]+", " ")), " ?\n ?")


def lines_of(docs: DataFrame) -> DataFrame:
    """host, line, same, doc_id, at, n: the words of each document's lines, by normalised line."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.xxhash64(text).alias("same"), F.posexplode(normal_lines(text)).alias("at", "_line")).where("_line <> ''")
    n = F.length("_line") - F.length(F.replace(F.col("_line"), F.lit(" "), F.lit(""))) + 1
    return df.select("host", F.xxhash64("_line").alias("line"), "same", "doc_id", "at", n.alias("n"))


def common_lines(docs: DataFrame, percent: int, least: int) -> DataFrame:
    """host, line, n_docs: lines in more than `percent` per cent of one host's documents, and in more than `least`."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("source").cast("string").alias("host"), text.alias("_text"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"))
    lines = F.array_distinct(F.array_remove(normal_lines(F.col("_text")), ""))
    once = rows.select("host", F.explode(lines).alias("_line")).select("host", F.xxhash64("_line").alias("line"))
    found = once.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > least)
    of = hosts.select(F.col("host").alias("_host"), F.xxhash64("host").alias("_key"), "docs")
    # the join is on a hash too, so that both sides are dealt for it and a host with a third of all lines may be split
    same = (F.xxhash64("host") == F.col("_key")) & F.col("host").eqNullSafe(F.col("_host"))
    return found.join(of, same).where(F.col("n_docs") * 100 > F.col("docs") * percent).select("host", "line", "n_docs")


KEY = ("doc_id", "host", "same")  # rows that agree in it have the same text, and get the same verdict


def judge(docs: DataFrame, percent: int = 1, least: int = 10, min_left: float = 0.3) -> DataFrame:
    """The base columns of every document, removed (words in common lines), gone (their numbers, from 0) and kept."""
    common = common_lines(docs, percent, least).withColumnRenamed("host", "_host").withColumnRenamed("line", "_line")
    hits = lines_of(docs).join(common, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")))
    removed = hits.groupBy(*KEY, "at").agg(F.max("n").alias("n")).groupBy(*KEY).agg(F.sum("n").alias("removed"), F.sort_array(F.collect_list("at")).alias("gone"))
    same = F.col("b.doc_id").eqNullSafe(F.col("r.doc_id")) & F.col("b.host").eqNullSafe(F.col("r.host")) & (F.col("b.same") == F.col("r.same"))
    joined = base_counts(docs).alias("b").join(removed.alias("r"), same, "left").select("b.*", F.coalesce("r.removed", F.lit(0).cast("long")).alias("removed"), "r.gone")
    left = F.col("n_words") - F.col("removed")
    return joined.withColumn("kept", ~F.col("base_failed") & (left >= F.lit(min_left) * F.col("n_words")))


def clean(docs: DataFrame, percent: int = 1, least: int = 10, min_left: float = 0.3) -> DataFrame:
    """The kept documents with their columns, their texts without the common lines (n_chars, if there is one, follows)."""
    names = docs.columns
    own = {c: f"_own{k}" for k, c in enumerate(names)}  # the helpers' names may not meet those of the table
    verdicts = judge(docs.select("doc_id", "text", "source"), percent, least, min_left)
    # only what changes travels: documents that go, and those that lose lines
    changed = verdicts.where("not kept or gone is not null").groupBy(*KEY).agg(F.first("gone").alias("gone"), F.first("kept").alias("kept"))
    text = F.coalesce(own["text"], F.lit(""))
    same = F.col(own["doc_id"]).cast("long").eqNullSafe(F.col("doc_id")) & F.col(own["source"]).cast("string").eqNullSafe(F.col("host")) & (F.xxhash64(text) == F.col("same"))
    df = docs.toDF(*own.values()).join(changed, same, "left").where(F.coalesce("kept", F.lit(True)))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    new = {"text": F.when(F.col("gone").isNotNull(), left).otherwise(F.col(own["text"]))}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("gone").isNotNull(), F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))
    return df.select(*(new.get(c, F.col(own[c])).alias(c) for c in names))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


#: The same rows in DuckDB.
OP3_SQL = r"""
with d as (select row_number() over () rid, doc_id, source host, coalesce(text, '') t from documents),
w as (select rid, doc_id, host, t, [x for x in string_split_regex(t, '[ \t\n\x0B\f\r]+') if x <> ''] ws,
  [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^ \t\n\x0B\f\r]')] ls from d),
win as (select rid, i, array_to_string(ws[i:i + 7], chr(1)) s from (select rid, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)),
rep as (select rid, i from win qualify count(*) over (partition by rid, s) > 1),
cov as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + 8)) p from rep) group by rid),
ln as (select rid, doc_id, host, t, [x for x in string_split_regex(l, '[ \t\n\x0B\f\r]+') if x <> ''] lw from (select rid, doc_id, host, t, unnest(string_split(lower(t), chr(10))) l from d)),
l2 as (select rid, host, t, array_to_string(lw, ' ') line, len(lw) n from ln where len(lw) > 0),
ho as (select host, count(*) docs from d group by host),
com as (select l2.host, line from l2 join ho on l2.host is not distinct from ho.host group by l2.host, line, docs having count(distinct rid) > 10 and count(distinct rid) * 100 > docs),
rem as (select rid, sum(n) removed from l2 join com on l2.line = com.line and l2.host is not distinct from com.host group by rid),
b as (select w.rid, doc_id, len(ws)::bigint n_words, coalesce(length(array_to_string(ws, '')), 0)::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words, coalesce(rem.removed, 0)::bigint removed
  from w left join cov using (rid) left join rem using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) base_failed,
  (not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - removed >= 0.3 * n_words) kept from b
"""
