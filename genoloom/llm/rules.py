"""Quality rules with cross-document line frequency, in DataFrame functions only.

A line is normalised (lower case, runs of white space as one space, none at its ends) and hashed.
For each host the distinct texts that hold a line are counted; exact copies of a text count once. A
line is *boilerplate* on its host when it stands in more than ``max_docs`` distinct texts, however
large the host is. A document is rejected when it fails the base rules or when its boilerplate lines
leave it less than ``min_left`` of its lines' characters (it is depleted).

The hashes of all lines are written once as a table of rows. Counts come from it by partial sums, and
boilerplate lines meet it again by host and line with salted keys, as one host or line may hold a
third of all rows; what a document loses is a list of its own lines' places, never a host's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import WS, documents, salted_join, stored

SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda x: x != "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.btrim(F.regexp_replace(line, WS, " "))))


def host_key(host: Column) -> Column:
    return F.when(host.isNull(), F.lit("n")).otherwise(F.concat(F.lit("h"), host))


def features(docs: DataFrame) -> DataFrame:
    """Adds the base counts to rows with ``__text``; every step is one column, so that none is computed twice."""
    w5 = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(5))))
    out = docs.withColumn("__text", F.coalesce("__text", F.lit("")))
    out = out.withColumns({"__words": words_of(F.col("__text")), "__lines": lines_of(F.col("__text"))})
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "__joined": F.array_join("__words", ""),
            "__w5": F.when(F.size("__words") > 4, w5(F.col("__words"))).otherwise(F.array().cast("array<bigint>")),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_line_chars": F.aggregate("__lines", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)),
        }
    )
    out = out.withColumns(
        {
            "word_chars": F.length("__joined").cast("bigint"),
            "n_symbols": F.length(F.regexp_replace("__joined", rf"[^{SYMBOLS}]+", "")).cast("bigint"),
            # windows by hash; only texts that repeat one are sorted
            "__sorted": F.when(
                F.size(F.array_distinct("__w5")) < F.size("__w5"),
                F.sort_array(F.transform("__w5", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
        }
    )
    twice = lambda x, i: (x["h"] == F.try_element_at(F.col("__sorted"), i + 2)["h"]) | ((i > 0) & (x["h"] == F.try_element_at(F.col("__sorted"), F.greatest(i, F.lit(1)))["h"]))
    out = out.withColumn("__starts", F.sort_array(F.transform(F.filter("__sorted", lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["i"])))
    # a start covers the words up to the next start, five at most; the last covers five
    return out.withColumn(
        "n_repeat_words",
        F.aggregate(
            "__starts",
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-5).alias("at")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["at"])).alias("n"), i.alias("at")),
            lambda a: a["n"],
        ),
    ).withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            # a filter that uses this column is not pushed below: there its conditions would be copies of whole feature expressions
            "__row": F.monotonically_increasing_id(),
        }
    )


def row_key(host: Column, id_: Column, text: Column) -> Column:
    """Of a row's host, id and text: rows equal in all three have one fate."""
    return F.xxhash64(host, F.coalesce(id_.cast("string"), F.lit("\x00")), text)


def line_rows(docs: DataFrame) -> DataFrame:
    """__host, __line (hash), __content (of the whole text), __key, __at (place among the text's lines), __n (characters): a row a line that holds a word."""
    sized = F.transform(F.split("__text", "\n"), lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.struct(line_hash(x).alias("h"), F.length(x).alias("n"))))
    rows = docs.select("__host", F.xxhash64("__text").alias("__content"), row_key(F.col("__host"), F.col("__id"), F.col("__text")).alias("__key"), F.posexplode(sized).alias("__at", "__x"))
    return rows.filter("__x is not null").select("__host", F.col("__x.h").alias("__line"), "__content", "__key", "__at", F.col("__x.n").alias("__n"))


def boilerplate(lines: DataFrame, max_docs: int) -> DataFrame:
    """__host, __line of the lines that stand in more than ``max_docs`` distinct texts of a host."""
    return lines.groupBy("__host", "__line").agg(F.countDistinct("__content").alias("__docs")).filter(F.col("__docs") > max_docs).select("__host", "__line")


def judged(docs: DataFrame, max_docs: int, min_left: float) -> DataFrame:
    """``docs`` (__text, __host, __id, ...) with the base counts, __gone (places of its boilerplate lines), n_common_chars, kept."""
    docs = docs.withColumn("__text", F.coalesce("__text", F.lit("")))
    lines = stored(line_rows(docs))
    hit = salted_join(lines.select("__host", "__line", "__key", "__at", "__n"), boilerplate(lines, max_docs), ["__host", "__line"], F.col("__key"))
    gone = hit.groupBy("__key").agg(F.collect_set(F.struct(F.col("__at").alias("i"), F.col("__n").alias("n"))).alias("__gone"))
    gone = gone.select("__key", F.transform("__gone", lambda x: x["i"]).alias("__gone"), F.aggregate("__gone", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("__chars"))
    out = features(docs.withColumn("__key", row_key(F.col("__host"), F.col("__id"), F.col("__text")))).join(gone, "__key", "left")
    out = out.withColumn("n_common_chars", F.coalesce("__chars", F.lit(0).cast("bigint")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_line_chars") - F.col("n_common_chars") >= min_left * F.col("n_line_chars")))


def quality_rules(docs: DataFrame, max_docs: int = 20, min_left: float = 0.3, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, n_common_chars, kept.

    Null text: no words, so base_failed. Null hosts form one host. Null and repeated ids are carried
    through, row for row; other columns are ignored; an empty table gives an empty result.
    """
    own = documents(docs, id_col, text_col, host=host_col).withColumn("__host", host_key(F.col("__host")))
    return judged(own, max_docs, min_left).select(
        F.col("__id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_chars", "kept"
    )


def clean(docs: DataFrame, max_docs: int = 20, min_left: float = 0.3, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """The kept documents, all their columns, their boilerplate lines removed and ``length_col`` (where there is one) set anew.

    Null and empty texts fail the base rules and go. Rows repeated in full are judged alike and all stay
    or go; null hosts form one host; an empty table gives an empty result.
    """
    own = docs.select(*(docs[c].alias(f"__in_{i}") for i, c in enumerate(docs.columns)), docs[id_col].alias("__id"), docs[text_col].alias("__text"), host_key(docs[host_col]).alias("__host"))
    rows = judged(own, max_docs, min_left).filter(F.col("kept") & (F.col("__row") >= 0))
    lines = F.split("__text", "\n")
    # places that stay, in order: both steps are linear in the number of lines
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i))
    rows = rows.withColumn("__left", F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(left, "\n")))
    new = {text_col: F.col("__left"), length_col: F.length("__left").cast("bigint")}
    return rows.select(*(new.get(c, F.col(f"__in_{i}")).alias(c) for i, c in enumerate(docs.columns)))


#: Under DuckDB, for the default parameters.
OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('h' || source, 'n') AS host FROM documents),
w AS (
  SELECT rid, doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (
  SELECT rid, doc_id, host, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, ws, ls FROM w),
five AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, n_words - 3)) AS i FROM b WHERE n_words >= 5)),
rep AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM five), (SELECT unnest(range(5)) AS j)
  WHERE c > 1 GROUP BY rid),
l AS (
  SELECT rid, host, t, x, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
  FROM (SELECT rid, host, t, unnest(ls) AS x FROM b)),
f AS (
  SELECT host, line FROM l GROUP BY 1, 2 HAVING count(DISTINCT t) > 20),
gone AS (SELECT rid, sum(length(x)) AS n FROM l JOIN f USING (host, line) GROUP BY rid),
a AS (SELECT rid, sum(length(x)) AS n FROM l GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       coalesce(rep.n, 0)::BIGINT AS n_repeat_words, n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words AS base_failed,
       coalesce(gone.n, 0)::BIGINT AS n_common_chars,
       NOT (n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words) AND coalesce(a.n, 0) - coalesce(gone.n, 0) >= 0.3 * coalesce(a.n, 0) AS kept
FROM b LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid) LEFT JOIN a USING (rid)
"""
