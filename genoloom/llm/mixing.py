"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with share p of the rows and target weight w is repeated at the mean rate r = w / p (times
``epochs``). Each document gets a uniform number from a seeded hash of its id and text and is
copied k times, k being the quantile of the Poisson distribution with mean r at that number. The
distribution of each source is tabulated once, as far as doubles carry; its length is about the
rate, so reading it costs no more than writing the copies.

The table of sources is counted first: up to ``broadcast_sources`` sources it is broadcast, beyond
that it is joined with salted keys. Documents without a copy are dropped and no table stays on a row
when the copies are dealt to partitions, and ordered within them, by a hash of seed, document and
copy number: a global random order from one exchange of the texts, with no source and no document in
one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import parallelism, salted_join

BITS = 52


def uniform(seed: int, *parts: Column) -> Column:
    """A number from (0, 1) with 52 bits, from the md5 of the parts."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    return (F.conv(F.substring(text, 1, BITS // 4), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << BITS)


def document_hash(id_: Column, text: Column) -> Column:
    """Null and repeated ids differ by their text; null parts have a mark of their own."""
    return F.concat_ws("|", F.coalesce(id_.cast("string"), F.lit("null")), F.coalesce(F.md5(text.cast("binary")), F.lit("null")))


def cumulative(rate: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... as an array; logarithms keep large rates from underflow."""
    top = (rate + 12 * F.sqrt(rate) + 30).cast("int")
    return F.aggregate(
        F.sequence(F.lit(0), top),
        F.struct(F.lit(0.0).alias("ln"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out")),
        lambda a, k: F.struct(
            (a["ln"] + F.when(k > 0, F.ln(rate / k)).otherwise(0.0)).alias("ln"),
            (a["sum"] + F.exp(a["ln"] + F.when(k > 0, F.ln(rate / k)).otherwise(0.0) - rate)).alias("sum"),
            F.concat(a["out"], F.array(a["sum"] + F.exp(a["ln"] + F.when(k > 0, F.ln(rate / k)).otherwise(0.0) - rate))).alias("out"),
        ),
        lambda a: a["out"],
    )


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, epochs: float) -> tuple[DataFrame, int, int]:
    """(__source, __rate, __cdf of each source; how many sources and rows there are); sources without a weight get 1, a weight of 0 drops a source."""
    if bad := [w for w in [*(weights or {}).values(), epochs] if not 0 <= w < float("inf")]:
        raise ValueError(f"Weights and epochs are finite and not negative: {bad[0]}")
    sizes = docs.groupBy(F.coalesce(F.concat(F.lit("s"), source_col), F.lit("n")).alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("__source") == f"s{name}", F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("__w", weight)
    n_sources, n_rows, mass = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0)), F.sum("__w")).first()
    rate = F.col("__w") / F.lit(float(mass)) * F.lit(float(n_rows)) / F.col("__n") * F.lit(float(epochs)) if mass else F.lit(0.0)
    return sizes.select("__source", rate.alias("__rate")).withColumn("__cdf", cumulative(F.col("__rate"))), n_sources, n_rows


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 17, broadcast_sources: int = 1000, partition_rows: int = 100_000,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The input's columns, then ``copy`` (1, 2, ...) and ``mix_rate``, in a global random order.

    A null source is a source of its own. Null ids are told apart by their texts; rows equal in id
    and text get the same count each; null and empty texts are copied like any other. An empty table
    gives an empty result, and so do weights that are all 0; negative weights are an error. An input
    column named ``copy`` or ``mix_rate`` is replaced. The result has a partition for ``partition_rows``
    expected copies, and as many as the session's shuffles at least.
    """
    own = docs.drop("copy", "mix_rate")
    keyed = own.withColumns({"__source": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")), "__doc": document_hash(F.col(id_col), F.col(text_col))})
    keyed = keyed.withColumn("__u", uniform(seed, F.col("__doc")))
    table, n_sources, n_rows = rates(docs, source_col, weights, epochs)
    rows = keyed.join(F.broadcast(table), "__source") if n_sources <= broadcast_sources else salted_join(keyed, table, ["__source"], F.col("__doc"))
    # entries of the table below u: the number of copies
    rows = rows.withColumn("__k", F.size(F.filter("__cdf", lambda p: p < F.col("__u"))))
    rows = rows.select(*own.columns, "__doc", F.col("__rate").alias("mix_rate"), "__k").filter("__k > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__k"))))
    rows = rows.select(*own.columns, "copy", "mix_rate", F.xxhash64(F.lit(seed), "__doc", "copy").alias("__order"))
    n = max(parallelism(docs.sparkSession), -int(-n_rows * epochs // partition_rows))
    return rows.repartition(n, "__order").sortWithinPartitions("__order").drop("__order")


#: Under DuckDB, for uniform weights over sources, one epoch and seed 17.
OP5_SQL = r"""
WITH RECURSIVE s AS (
  SELECT coalesce('s' || source, 'n') AS src, count(*) AS n FROM documents GROUP BY 1),
r AS (
  SELECT src, (1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM s)) * (SELECT sum(n)::DOUBLE FROM s) / n::DOUBLE AS rate FROM s),
c AS (
  SELECT src, rate, 0 AS k, 0.0::DOUBLE AS ln, exp(-rate) AS p FROM r
  UNION ALL
  SELECT src, rate, k + 1, ln + ln(rate / (k + 1)), p + exp(ln + ln(rate / (k + 1)) - rate) FROM c WHERE k + 1 <= floor(rate + 12 * sqrt(rate) + 30)),
t AS (SELECT src, rate, list(p ORDER BY k) AS cdf FROM c GROUP BY 1, 2),
d AS (
  SELECT documents.*, coalesce('s' || source, 'n') AS src,
         (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT d.*, rate, len(list_filter(cdf, lambda p: p < u)) AS n_copies FROM d JOIN t USING (src))
SELECT doc_id, n_chars, source, md5(text) AS text_md5, copy::INT AS copy, round(rate, 9) AS mix_rate
FROM (SELECT k.*, unnest(range(1, n_copies + 1)) AS copy FROM k)
"""
