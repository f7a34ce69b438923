"""Line dedup by a fixed-depth template tree; DataFrame functions only.

The tree's first level is a line's token count, the next its leading tokens. Below that, tokens with digits are variable
fields from the start, and in a longer line a quarter of the rest may be another one: such a line fits four templates, and
belongs to the one that most lines fit. A template whose lines stand in several documents recurs. Its first document keeps
its lines, the others lose theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import NO_ID, materialized, spare

SPACE = r"[\x20\x09\x0B-\x0D]+"
FIELD = "<*>"
QUARTERS = 4
LONG = 8  # tokens after the leading ones that a line must have for a quarter of them to be variable
LEAF = ["k", "j"]


def _plain(text: Column) -> Column:
    """The text with single spaces inside lines and none around them.

    Whole texts are rewritten before they are cut into lines, and only those that need it, so that each expression is
    evaluated once a text.
    """
    odd = F.lit(False)
    for sign in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(text, F.lit(sign))
    spaced = F.when(odd, F.regexp_replace(text, SPACE, " ")).otherwise(text)
    return F.trim(F.replace(F.replace(spaced, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))


def _templates(line: Column, masked: Column, n: Column, depth: int, min_tokens: int) -> Column:
    """Array of (variant, head, tail): the constant parts of a line's templates.

    A short line, and one that would be more than half fields, has its own words as its only template.
    """
    first = lambda k: F.call_function("substring_index", masked, F.lit(" "), k)  # noqa: E731  the first k tokens, or the last -k
    cut = lambda i: F.lit(depth) + F.floor((n - depth) * i / QUARTERS).cast("int")
    fields = (F.length(masked) - F.length(F.replace(masked, F.lit(FIELD), F.lit("")))) / len(FIELD)
    whole = lambda x: F.array(F.struct(F.lit(0).alias("variant"), x.alias("head"), F.lit("").alias("tail")))
    parts = F.array(*[F.struct(F.lit(1 + i).alias("variant"), first(cut(i)).alias("head"), first(cut(i + 1) - n).alias("tail")) for i in range(QUARTERS)])
    return F.when((n < min_tokens) | (fields * 2 > n), whole(line)).when(n - depth >= LONG, parts).otherwise(whole(masked))


def lines_of(docs: DataFrame, depth: int = 3, min_tokens: int = 6, shortest: int = 3) -> DataFrame:
    """id, copy, line_no, short, variant, k, j: a row for each line with at least ``shortest`` tokens and each template it fits.

    copy tells texts with the same id apart. k and j are two 64-bit hashes of the template; short: fewer than min_tokens tokens.
    """
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", r"(^| )[^ 0-9]*+[0-9][^ ]*+", "$1" + FIELD)).otherwise(F.col("line"))
    counted = F.struct("line", masked.alias("masked"), F.size(F.split("line", " ")).alias("n"))
    return (
        docs.where(F.col("text").isNotNull())
        .select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("copy"), F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line_no", "line"))
        .select("id", "copy", "line_no", F.inline(F.array(counted)))  # a generator's output is evaluated once, however often n is used
        .where(F.col("n") >= shortest)
        .select("id", "copy", "line_no", "n", F.inline(_templates(F.col("line"), F.col("masked"), F.col("n"), depth, min_tokens)))
        .select("id", "copy", "line_no", (F.col("n") < min_tokens).alias("short"), "variant", F.xxhash64("n", "variant", "head", "tail").alias("k"), F.xxhash64("tail", "head", "variant", "n").alias("j"))
    )


def _first_documents(lines: DataFrame, least: int) -> DataFrame:
    """k, j, first: the templates that at least ``least`` documents hold, and the smallest of these."""
    if least > 2:
        found = lines.select(*LEAF, "id").distinct().groupBy(*LEAF).agg(F.count("*").alias("docs"), F.min("id").alias("first")).where(F.col("docs") >= least)
    else:
        found = lines.groupBy(*LEAF).agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.lit(least < 2) | (F.col("first") < F.col("last")))
    return found.select(*LEAF, "first")


def recurring_lines(docs: DataFrame, min_docs: int = 2, depth: int = 3, min_tokens: int = 6, short_docs: int = 10) -> DataFrame:
    """id, copy, dropped (sorted line numbers): what each document loses. Documents that lose nothing have no row."""
    keyed = materialized(lines_of(docs, depth, min_tokens), "line-templates")
    # Written first: Spark splits a template's many lines over tasks only where both sides of the join come from an exchange.
    met = keyed.groupBy("k").agg(F.count("*").alias("lines"), F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    met = materialized(met.select("k", "lines"), "line-templates-met")
    choice = F.max(F.struct("lines", (-F.col("variant")).alias("order"), *LEAF, "short")).alias("best")
    chosen = materialized(keyed.join(met, "k").groupBy("id", "copy", "line_no").agg(choice).select("id", "copy", "line_no", "best.k", "best.j", "best.short"), "line-templates-chosen")
    recurring = materialized(_first_documents(chosen.where("NOT short"), min_docs).unionByName(_first_documents(chosen.where("short"), short_docs)), "recurring-templates")
    lost = chosen.join(recurring, LEAF).where(F.col("id") > F.col("first")).groupBy("id", "copy").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))
    return materialized(lost, "lines-lost")


def drop_recurring_lines(docs: DataFrame, min_docs: int = 2, depth: int = 3, min_tokens: int = 6, short_docs: int = 10) -> DataFrame:
    """docs with the lines of recurring templates taken out of text (n_chars, if there, follows), plus n_lines, n_dropped.

    Each line belongs to one template, so equal lines to the same. A template recurs if at least min_docs documents hold a
    line of it; the document with the smallest doc_id (null: last) keeps its lines, all others drop theirs: for each line
    dropped there is one that stays and agrees with it in length, leading tokens and all but the fields, which are tokens
    with digits and at most a quarter of the tokens in one place. Lines of three tokens or more but fewer than min_tokens,
    and those that are mostly fields, have only equal lines in their template; the short ones recur from short_docs
    documents on. Lines of one or two tokens stay.

    A null text stays null, with no lines; an empty one has one line. Repeated rows have the same doc_id and count as one
    document, as do all rows without doc_id. Templates within one document only are left alone. Every row stays, if need
    be with an empty text. Other columns pass through, whatever their names; n_lines and n_dropped replace columns of
    these names.
    """
    key, copy, gone = (spare(docs, c) for c in ("key_", "copy_", "gone_"))
    lost = recurring_lines(docs, min_docs, depth, min_tokens, short_docs).select(F.col("id").alias(f"{key}r"), F.col("copy").alias(f"{copy}r"), F.col("dropped").alias(gone))
    keep, lines, dropped = docs.columns, F.split("text", "\n"), F.col(gone)
    # For each dropped line the kept ones before it and itself, so that the flags run along the lines; what is beyond stays.
    flags = F.flatten(F.transform(dropped, lambda at, i: F.concat(F.array_repeat(F.lit(False), (at - F.when(i > 0, F.get(dropped, i - 1)).otherwise(-1) - 1).cast("int")), F.array(F.lit(True)))))
    left = F.array_join(F.zip_with(lines, flags, lambda line, out: F.when(out, F.lit(None)).otherwise(line)), "\n")
    out = (
        docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
        .withColumn(copy, F.xxhash64("text"))
        .join(lost, (F.col(key) == F.col(f"{key}r")) & (F.col(copy) == F.col(f"{copy}r")), "left")
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(dropped), F.lit(0)).cast("long"))
        .withColumn("text", F.when(dropped.isNull(), F.col("text")).otherwise(left))
    )
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.when(dropped.isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*[c for c in keep if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
