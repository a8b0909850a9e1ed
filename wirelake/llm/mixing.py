"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source gets a mean repetition rate, target share * target size / documents of the source. A
document's count inverts the Poisson distribution at a number in [0, 1) hashed from its id and the
seed; the document is exploded by the count, and all copies are dealt out by a hash of (id, copy, seed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm.common import table

#: Rates of up to this many bytes in all, as measured, are broadcast; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Uniform numbers have this many bits, from 13 hexadecimal digits of an MD5.
UNIT = float(1 << 52)


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) hashed from the parts."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(UNIT)


def poisson_terms(rate: float | Column) -> Column:
    """How many values to tabulate: the tail beyond the mean by ten deviations and 20 is under 2^-52."""
    return F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array. Works in logarithms, so large rates don't underflow."""
    step = F.transform(
        F.sequence(F.lit(0), poisson_terms(rate)),
        lambda k: F.when(k == 0, -rate).otherwise(F.log(rate) - F.log(k.cast("double"))),
    )
    start = F.struct(F.lit(0.0).alias("log_p"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("cdf"))

    def add(acc: Column, x: Column) -> Column:
        log_p = acc["log_p"] + x
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(step, start, add, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, rate, cdf): rates that bring each source to its share of epochs * all documents.

    weights gives target shares (normalised here; sources it doesn't name get none). Without it a
    source's share goes with its number of documents to the power temperature. A null source is a source.
    """
    counts = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        raw = F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature)))
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("mix_source") == name, F.lit(float(weight))).otherwise(raw)
    totals = counts.withColumn("raw", raw)
    raw_sum, all_docs = totals.agg(F.sum("raw"), F.sum("n_docs")).first()  # two numbers
    if not raw_sum:
        raw_sum, all_docs = 1.0, 0
    rate = F.lit(float(all_docs * epochs / raw_sum)) * F.col("raw") / F.col("n_docs")
    return totals.select("mix_source", "n_docs", rate.alias("rate")).withColumn(
        "cdf", F.when(F.col("rate") > 0, poisson_cdf(F.col("rate"))).otherwise(F.array(F.lit(1.0)))
    )


ADDED = ("rate", "n_copies", "copy", "shuffle_key")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: docs' columns, then rate, n_copies, copy (from 0) and shuffle_key, in shuffled order.

    Rows of one id, repeated or not, get the same count and keys, so the order among them is not defined. Null ids hash like the word null; texts
    of any length are carried as they are, nulls included; a null source is a source. Columns of docs that bear an added name are replaced. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    rates = source_rates(docs, weights, temperature, epochs)
    few = (rates.agg(F.sum(8 * F.size("cdf") + F.coalesce(F.octet_length("mix_source"), F.lit(0)) + 64)).first()[0] or 0) <= BROADCAST_BYTES
    packed = docs.select(F.struct(*kept).alias("doc"))  # one column, so no name of docs meets one of these
    joined = packed.join(F.broadcast(rates) if few else rates, F.col("doc.source").eqNullSafe(F.col("mix_source")))
    counted = joined.withColumn("u", unit_hash(F.lit(seed), F.col("doc.doc_id"))).withColumn("n_copies", F.size(F.filter("cdf", lambda p: p <= F.col("u"))).cast("int"))
    copies = counted.where("n_copies > 0").select("doc", "rate", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    out = copies.withColumn("shuffle_key", unit_hash(F.lit(seed + 1), F.col("doc.doc_id"), "copy"))
    # the key is a hash of 52 bits, so its own hash deals out equal shares to any number of partitions: no sampling pass, no hot range
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = out.repartition(parts, F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
    return dealt.select("doc.*", *ADDED)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = {
    "op2_mix_sources": """
with recursive counts as (
  select source, count(*) as n_docs from documents group by source),
rates as (
  select source, sqrt(n_docs) / (select sum(sqrt(n_docs)) from counts) * (select sum(n_docs) from counts) / n_docs as rate
  from counts),
cdf(source, rate, k, log_p, total) as (
  select source, rate, 0, -rate, exp(-rate) from rates
  union all
  select source, rate, k + 1, log_p + ln(rate) - ln(k + 1.0::double), total + exp(log_p + ln(rate) - ln(k + 1.0::double))
  from cdf where k < ceil(rate + 10 * sqrt(rate) + 20)),
drawn as (
  select d.*, ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0::double as u
  from documents d),
counted as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, any_value(c.rate) as rate, count(*) filter (c.total <= d.u)::int as n_copies
  from drawn d join cdf c on d.source is not distinct from c.source
  group by all),
copies as (
  select *, unnest(range(n_copies))::int as copy from counted)
select *, ('0x' || substr(md5('18:' || coalesce(doc_id::varchar, 'null') || ':' || copy), 1, 13))::bigint / 4503599627370496.0::double as shuffle_key
from copies
"""
}
QUERIES = {"op2_mix_sources": op2_mix_sources}
