"""The queries p5, p7, p8 and p9 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import nearest_time as nt
from tidemill.llm import packing, spam, tokenize
from tidemill.operators.history import stretch_of
from tidemill.operators.redelivery import latest_rows
from tidemill.operators.rolling import FIRST_YEAR
from tidemill.session import table

TOLERANCE_NS = 90 * 10**9


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leg: side, entity, time and id; NULL where unusable."""
    raw = table(spark, sf_dir, "ledger_legs")
    held = latest_rows(raw, "leg_id", "loaded_at", ["leg_side", "wallet_phone", "posted_date__date_part", "posted_date__fraction_ns"])
    wallet = nt.plain_entity("wallet_phone")
    return held.select(F.when(F.col("leg_side").isin("D", "C"), F.concat("leg_side", wallet)).alias("entity"),
                       nt.instant_ns("posted_date__date_part", "posted_date__fraction_ns").alias("ns"), F.col("leg_id").alias("id"))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per transaction, of its source and of its destination."""
    raw = table(spark, sf_dir, "transactions")
    held = latest_rows(raw, "transaction_code", "loaded_at",
                       ["transaction_date__date_part", "transaction_date__fraction_ns", "source_phone", "destination_phone"])
    ns = nt.instant_ns("transaction_date__date_part", "transaction_date__fraction_ns").alias("ns")
    one = held.select(ns, F.col("transaction_code").alias("id"), F.concat(F.lit("D"), nt.plain_entity("source_phone")).alias("d"),
                      F.concat(F.lit("C"), nt.plain_entity("destination_phone")).alias("c"))
    return one.filter(F.col("ns").isNotNull()).select("ns", "id", F.explode(F.array("d", "c")).alias("entity"))


def _stretch_ns(spark: SparkSession, sf_dir: str) -> int:
    """Stretches of six hours, or shorter ones where a wallet of a third of all rows would crowd them."""
    dated = table(spark, sf_dir, "transactions").select("transaction_date").filter(F.year("transaction_date") >= FIRST_YEAR)
    return max(4 * TOLERANCE_NS, min(nt.STRETCH_NS, 1_000 * stretch_of(dated, "transaction_date")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nt.nearest(_legs(spark, sf_dir), _sides(spark, sf_dir), TOLERANCE_NS, _stretch_ns(spark, sf_dir))
    return (pairs.filter(F.col("right_id").isNotNull())
            .select(F.col("left_id").alias("leg_id"), F.col("right_id").alias("transaction_code")))


def p5_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leg with the transaction nearest in time, or with none."""
    legs = _legs(spark, sf_dir)
    pairs = nt.nearest(legs, _sides(spark, sf_dir), TOLERANCE_NS, _stretch_ns(spark, sf_dir))
    unusable = legs.filter(F.col("entity").isNull() | F.col("ns").isNull() | F.col("id").isNull())
    none = F.lit(None).cast("bigint")
    return (pairs.select(F.col("left_id").alias("leg_id"), F.col("right_id").alias("transaction_code"), "gap_ns")
            .unionByName(unusable.select(F.col("id").alias("leg_id"), none.alias("transaction_code"), none.alias("gap_ns"))))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_containers(tokenize.token_counts(table(spark, sf_dir, "documents")))


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_summary(p8_containers(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


def _ns(prefix: str) -> str:
    d = f"{prefix}__date_part"
    return (f"epoch_us(CASE WHEN regexp_full_match({d}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}} ([01][0-9]|2[0-3]):[0-9]{{2}}:[0-9]{{2}}') THEN "
            f"try_cast(concat('20', {d}[7:8], '-', {d}[4:5], '-', {d}[1:2], {d}[9:]) AS TIMESTAMP) END) * 1000 + coalesce({prefix}__fraction_ns, 0)")


def _bare(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '[\\s\\pZ]+', '', 'g')), '')"


_PAIRS_SQL = f"""WITH legs AS (SELECT leg_id, any_value(concat(leg_side, {_bare('wallet_phone')})) AS entity, any_value({_ns('posted_date')}) AS ns
  FROM ledger_legs WHERE leg_side IN ('D', 'C') AND {_bare('wallet_phone')} IS NOT NULL GROUP BY leg_id),
held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_code ORDER BY loaded_at DESC) AS rn FROM transactions) WHERE rn = 1),
tx AS (SELECT {_ns('transaction_date')} AS ns, transaction_code, unnest([concat('D', {_bare('source_phone')}), 'C' || {_bare('destination_phone')}]) AS entity FROM held),
near AS (SELECT leg_id, transaction_code, tx.ns - legs.ns AS gap_ns,
    row_number() OVER (PARTITION BY leg_id ORDER BY abs(tx.ns - legs.ns), tx.ns, transaction_code) AS rn
  FROM legs JOIN tx ON tx.entity = legs.entity AND tx.ns BETWEEN legs.ns - {TOLERANCE_NS} AND legs.ns + {TOLERANCE_NS})"""

QUERIES = {f.__name__: f for f in (p5_found, p5_legs, p7_ids, p8_containers, p8_summary, p9_found)}
SQL = {
    "p5_found": f"{_PAIRS_SQL} SELECT leg_id, transaction_code FROM near WHERE rn = 1",
    "p5_legs": f"{_PAIRS_SQL} SELECT l.leg_id, transaction_code, gap_ns FROM (SELECT DISTINCT leg_id FROM ledger_legs) l LEFT JOIN (SELECT * FROM near WHERE rn = 1) USING (leg_id)",
}
