"""The driver's star schema seen as a register, a processor's legs and a bank statement; the same in SQL for DuckDB.

A settlement is a supplier's month. k = supplier * 31 + month * 7 (months from January 1995) decides what is wrong with
it: k mod 10 = 0 no reference; 1 credited 50 paise short; 2 half credited; 3 late and without reference; 6 its
reference in the utr column. k mod 50 = 4 has a clone with its net; k mod 20 = 5 repeats a leg (settled if k mod 40 = 5);
k mod 30 = 7 lacks an order id, 8 has a chargeback of an unknown order, 9 a refund; k mod 60 = 11 has a debit line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import pct_of
from tallyframe.operators.lineage import stored
from tallyframe.types import FEE_BPS, TAX_BPS

_LINE = ["l_orderkey", "l_linenumber"]
_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment legs as numbers, with what their settlement (a supplier's month) adds up to, stored in order of settlements; ids are spelled by readers.

    The line key isn't unique, so a row number within it completes it. A settlement is (sup, mon), both null where one is.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    number = F.row_number().over(Window.partitionBy(*_LINE).orderBy(*_REST))
    on = F.col("l_shipdate").cast("date")
    month = (F.year(on) - 1995) * 12 + F.month(on)
    legs = items.select(
        *_LINE, number.alias("number"), F.col("l_shipdate").cast("timestamp_ntz").alias("captured_at"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"),
        F.when(month.isNotNull(), F.col("l_suppkey")).alias("sup"), F.when(F.col("l_suppkey").isNotNull(), month).alias("mon"),
    )
    own = Window.partitionBy("sup", "mon")
    # dealt out before ids are spelled, so that only numbers are shuffled
    return legs.repartition("sup", "mon").withColumns({
        "first": F.row_number().over(own.orderBy(_txn_id())) == 1, "gross": F.sum("amount").over(own), "last_capture": F.max("captured_at").over(own),
    })


def _txn_id() -> Column:
    return F.concat_ws("_", F.lit("pay"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("number"))


def _spelled(base: DataFrame) -> DataFrame:
    return base.select(
        _txn_id().alias("txn_id"), F.lit("payment").alias("txn_type"), F.concat(F.lit("ORD-"), F.col("l_orderkey")).alias("order_id"), "captured_at", "amount",
        F.concat(F.lit("setl_"), F.col("sup"), F.lit("x"), F.col("mon")).alias("settlement_id"), (F.col("sup") * 31 + F.col("mon") * 7).cast("long").alias("k"),
        F.date_add(F.col("last_capture").cast("date"), 2).alias("settled_at"), "first", "gross", "last_capture",
    )


def base_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(payments, settlements), computed once for all that is made of them."""
    paid = _spelled(stored(_base(spark, sf_dir)))
    return paid, stored(paid.where("first").select("settlement_id", "k", "gross", "settled_at", "last_capture"))


_COLUMNS = ("txn_id", "txn_type", "order_id", "captured_at", "amount", "settlement_id", "settled_at")


def psp(spark: SparkSession, sf_dir: str, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    paid, made = tables or base_tables(spark, sf_dir)
    mod = lambda n: F.pmod(F.col("k"), F.lit(n))
    full, first = paid.where("settlement_id is not null"), F.col("first")
    full = full.withColumn("order_id", F.when(~((mod(30) == 7) & first), F.col("order_id")))
    copies = full.where(first & (mod(20) == 5) & F.col("order_id").isNotNull()).withColumns({
        "txn_id": F.concat("txn_id", F.lit("_d")), "settlement_id": F.when(mod(40) == 5, F.col("settlement_id")), "settled_at": F.when(mod(40) == 5, F.col("settled_at")),
    })
    fee = pct_of(F.col("gross"), FEE_BPS)
    leg = lambda name, kind, amount, order=None: made.withColumns({
        "txn_id": F.concat(F.lit(f"{name}_"), "settlement_id"), "txn_type": F.lit(kind), "order_id": order if order is not None else F.lit(None).cast("string"), "captured_at": F.col("last_capture"), "amount": amount,
    })
    fees, taxes = leg("fee", "fee", -fee), leg("tax", "tax", -pct_of(fee, TAX_BPS))
    holds = leg("cb", "chargeback", F.lit(-100_000).cast("long"), F.concat(F.lit("ORD-X"), "settlement_id")).where(mod(30) == 8)
    refunds = leg("rfnd", "refund", F.lit(-50_000).cast("long"), F.concat(F.lit("ORD-Y"), "settlement_id")).where(mod(30) == 9)
    base = full.select(*_COLUMNS)
    for part in (copies, fees, taxes, holds, refunds):
        base = base.unionByName(part.select(*_COLUMNS))
    net = F.col("gross") - fee - pct_of(fee, TAX_BPS)
    clones = made.where(mod(50) == 4).select(
        F.concat(F.lit("clone_"), "settlement_id").alias("txn_id"), F.lit("payment").alias("txn_type"), F.lit(None).cast("string").alias("order_id"), F.col("last_capture").alias("captured_at"),
        _net(net, mod).alias("amount"), F.concat("settlement_id", F.lit("c")).alias("settlement_id"), "settled_at",
    )
    return base.unionByName(clones)


def _net(net, mod):
    return net - F.when(mod(30) == 8, 100_000).when(mod(30) == 9, 50_000).otherwise(0).cast("long")


def bank(spark: SparkSession, sf_dir: str, tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    _, made = tables or base_tables(spark, sf_dir)
    mod = lambda n: F.pmod(F.col("k"), F.lit(n))
    fee = pct_of(F.col("gross"), FEE_BPS)
    net = _net(F.col("gross") - fee - pct_of(fee, TAX_BPS), mod)
    credit = F.when(mod(10) == 1, net - 50).when(mod(10) == 2, ((net - F.pmod(net, F.lit(2))) / 2).cast("long")).otherwise(net)
    posted = F.when(mod(10) == 3, F.date_add("settled_at", 6)).otherwise(F.date_add("settled_at", 1))
    named = F.concat(F.lit("NEFT CR  PROCESSOR SETL "), F.col("settlement_id"))
    narration = F.when(mod(50) == 4, "NEFT CR   PAYOUT").when(mod(10) == 0, F.when(mod(20) == 0, "RZPX*ACME  RET PL").otherwise("NEFT CR  PAYOUT")).when(mod(10).isin(3, 6), "BY TRANSFER").otherwise(named)
    line = made.select(
        F.concat(F.lit("BL-"), "settlement_id").alias("line_id"), posted.alias("txn_date"), narration.alias("narration"), credit.alias("credit"), F.lit(None).cast("long").alias("debit"),
        F.when(mod(10) == 6, F.col("settlement_id")).alias("utr"), "k", "settled_at",
    )
    clones = line.where(mod(50) == 4).withColumn("line_id", F.concat("line_id", F.lit("c")))
    debits = line.where(mod(60) == 11).withColumns({"line_id": F.concat("line_id", F.lit("d")), "debit": F.lit(11_800).cast("long"), "credit": F.lit(None).cast("long"), "narration": F.lit("CHARGES"), "utr": F.lit(None).cast("string")})
    return line.unionByName(clones).unionByName(debits).select("line_id", "txn_date", "narration", "credit", "debit", F.lit(0).cast("long").alias("balance"), "utr")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered orders: the gross is that of all legs of the order."""
    amount = F.round(F.col("l_extendedprice") * 100).cast("long")
    gross = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(amount).alias("gross_amount"))
    table = spark.read.parquet(f"{sf_dir}/orders.parquet").join(gross, "o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "refunded").otherwise("partially_refunded")
    return table.select(F.concat(F.lit("ORD-"), F.col("o_orderkey")).alias("order_id"), F.col("o_orderdate").cast("date").alias("order_date"), F.concat(F.lit("CUST-"), F.col("o_custkey")).alias("customer_ref"), "gross_amount", F.lit("INR").alias("currency"), status.alias("status"))


def truth(statement: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(linkages: line_id, settlement_id; unresolvable: line_id) of bank()'s lines, by construction; debits and clones' lines link to nothing certain."""
    lines = statement.where("credit is not null").select("line_id", F.expr("substring(line_id, 4)").alias("settlement_id"))
    trapped = lines.where(F.col("line_id").endswith("c")).select(F.explode(F.array(F.col("line_id"), F.expr("substring(line_id, 1, length(line_id) - 1)"))).alias("line_id"))
    return lines, trapped


#: The same projection for DuckDB.
SQL = """
pays AS (
  SELECT 'pay_' || l_orderkey || '_' || l_linenumber || '_' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS txn_id,
    'ORD-' || l_orderkey AS order_id, l_shipdate AS captured_at, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount,
    'setl_' || l_suppkey || 'x' || ((year(l_shipdate) - 1995) * 12 + month(l_shipdate)) AS settlement_id,
    CAST(l_suppkey * 31 + ((year(l_shipdate) - 1995) * 12 + month(l_shipdate)) * 7 AS BIGINT) AS k, CAST(l_shipdate AS DATE) AS shipped FROM lineitem
), made0 AS (
  SELECT settlement_id, k, CAST(sum(amount) AS BIGINT) AS gross, max(shipped) + 2 AS settled_at, max(captured_at) AS last_capture, min(txn_id) AS first_leg FROM pays GROUP BY settlement_id, k
), made1 AS (
  SELECT *, (gross * 236 - (gross * 236) % 10000) // 10000 AS fee FROM made0
), made AS (
  SELECT *, (fee * 1800 - (fee * 1800) % 10000) // 10000 AS tax,
    gross - fee - (fee * 1800 - (fee * 1800) % 10000) // 10000 - CASE k % 30 WHEN 8 THEN 100000 WHEN 9 THEN 50000 ELSE 0 END AS net FROM made1
), paid AS (
  SELECT p.txn_id, CASE WHEN p.k % 30 = 7 AND p.txn_id = m.first_leg THEN NULL ELSE p.order_id END AS order_id, p.captured_at, p.amount, p.settlement_id, m.settled_at, p.k, p.txn_id = m.first_leg AS is_first
  FROM pays p JOIN made m ON p.settlement_id = m.settlement_id
), psp AS (
  SELECT txn_id, 'payment' AS txn_type, order_id, captured_at, amount, settlement_id, settled_at FROM paid
  UNION ALL SELECT txn_id || '_d', 'payment', order_id, captured_at, amount, CASE WHEN k % 40 = 5 THEN settlement_id END, CASE WHEN k % 40 = 5 THEN settled_at END FROM paid WHERE is_first AND k % 20 = 5 AND order_id IS NOT NULL
  UNION ALL SELECT 'fee_' || settlement_id, 'fee', NULL, last_capture, -fee, settlement_id, settled_at FROM made
  UNION ALL SELECT 'tax_' || settlement_id, 'tax', NULL, last_capture, -tax, settlement_id, settled_at FROM made
  UNION ALL SELECT 'cb_' || settlement_id, 'chargeback', 'ORD-X' || settlement_id, last_capture, -100000, settlement_id, settled_at FROM made WHERE k % 30 = 8
  UNION ALL SELECT 'rfnd_' || settlement_id, 'refund', 'ORD-Y' || settlement_id, last_capture, -50000, settlement_id, settled_at FROM made WHERE k % 30 = 9
  UNION ALL SELECT 'clone_' || settlement_id, 'payment', NULL, last_capture, net, settlement_id || 'c', settled_at FROM made WHERE k % 50 = 4
), lines0 AS (
  SELECT 'BL-' || settlement_id AS line_id, CASE WHEN k % 10 = 3 THEN settled_at + 6 ELSE settled_at + 1 END AS txn_date,
    CASE WHEN k % 50 = 4 THEN 'NEFT CR   PAYOUT' WHEN k % 20 = 0 THEN 'RZPX*ACME  RET PL' WHEN k % 10 = 0 THEN 'NEFT CR  PAYOUT' WHEN k % 10 IN (3, 6) THEN 'BY TRANSFER' ELSE 'NEFT CR  PROCESSOR SETL ' || settlement_id END AS narration,
    CASE WHEN k % 10 = 1 THEN net - 50 WHEN k % 10 = 2 THEN (net - net % 2) // 2 ELSE net END AS credit, CASE WHEN k % 10 = 6 THEN settlement_id END AS utr, k FROM made
), bank AS (
  SELECT line_id, txn_date, narration, credit, CAST(NULL AS BIGINT) AS debit, CAST(0 AS BIGINT) AS balance, utr FROM lines0
  UNION ALL SELECT line_id || 'c', txn_date, narration, credit, NULL, 0, utr FROM lines0 WHERE k % 50 = 4
  UNION ALL SELECT line_id || 'd', txn_date, 'CHARGES', NULL, 11800, 0, NULL FROM lines0 WHERE k % 60 = 11
), register AS (
  SELECT 'ORD-' || o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, 'CUST-' || o_custkey AS customer_ref, g.gross_amount, 'INR' AS currency,
    CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'refunded' ELSE 'partially_refunded' END AS status
  FROM orders JOIN (SELECT order_id, CAST(sum(amount) AS BIGINT) AS gross_amount FROM pays GROUP BY order_id) g ON g.order_id = 'ORD-' || o_orderkey
), marked AS (
  SELECT *, CASE WHEN txn_type NOT IN ('payment', 'refund', 'chargeback') OR order_id IS NULL THEN false WHEN settlement_id IS NOT NULL THEN rn > 1 ELSE n_settled > 0 OR rn > 1 END AS suppressed FROM (
    SELECT *, count(settlement_id) OVER (PARTITION BY txn_type, order_id, captured_at, amount) AS n_settled, row_number() OVER (PARTITION BY txn_type, order_id, captured_at, amount, settlement_id ORDER BY txn_id) AS rn FROM psp)
), active AS (
  SELECT txn_id, txn_type, order_id, captured_at, amount, settlement_id, settled_at FROM marked WHERE NOT suppressed
), totals AS (
  SELECT settlement_id, CAST(coalesce(sum(amount) FILTER (txn_type IN ('payment', 'adjustment')), 0) AS BIGINT) AS gross, CAST(coalesce(-sum(amount) FILTER (txn_type = 'fee'), 0) AS BIGINT) AS fees,
    CAST(coalesce(-sum(amount) FILTER (txn_type = 'tax'), 0) AS BIGINT) AS tax, CAST(coalesce(-sum(amount) FILTER (txn_type = 'refund'), 0) AS BIGINT) AS refunds,
    CAST(coalesce(-sum(amount) FILTER (txn_type IN ('chargeback', 'reserve')), 0) AS BIGINT) AS holds, CAST(sum(amount) AS BIGINT) AS net, count(*) FILTER (txn_type = 'payment') AS payment_legs, count(*) AS legs,
    coalesce(max(settled_at), max(CAST(captured_at AS DATE))) AS settled_on FROM active WHERE settlement_id IS NOT NULL GROUP BY settlement_id
), refs AS (
  SELECT line_id, coalesce(a.settlement_id, b.settlement_id, c.settlement_id) AS settlement_id FROM bank
  LEFT JOIN totals a ON a.settlement_id = nullif(regexp_extract(narration, '\\b(setl_[A-Za-z0-9]+)\\b', 1), '') LEFT JOIN totals b ON b.settlement_id = utr
  LEFT JOIN totals c ON c.settlement_id = nullif(regexp_extract(utr, '\\b(setl_[A-Za-z0-9]+)\\b', 1), '')
  WHERE coalesce(a.settlement_id, b.settlement_id, c.settlement_id) IS NOT NULL
), t0c AS (
  SELECT b.line_id, t.settlement_id, t.payment_legs, t.net, b.credit FROM bank b JOIN refs USING (line_id) JOIN totals t ON t.settlement_id = refs.settlement_id WHERE t.net = b.credit
), t0 AS (
  SELECT * FROM t0c QUALIFY count(*) OVER (PARTITION BY line_id) = 1 AND count(*) OVER (PARTITION BY settlement_id) = 1
), t1c AS (
  SELECT b.line_id, t.settlement_id, t.payment_legs, t.net, b.credit, count(*) OVER (PARTITION BY b.line_id) AS choices FROM bank b JOIN totals t ON t.net = b.credit AND abs(t.settled_on - b.txn_date) <= 2
  WHERE b.line_id NOT IN (SELECT line_id FROM t0) AND t.settlement_id NOT IN (SELECT settlement_id FROM t0)
), t1 AS (
  SELECT line_id, settlement_id, payment_legs, net, credit FROM (SELECT *, count(*) OVER (PARTITION BY settlement_id) AS rivals FROM t1c WHERE choices = 1 AND payment_legs = 1) WHERE rivals = 1
), t2c AS (
  SELECT line_id, settlement_id, payment_legs, net, credit, count(*) OVER (PARTITION BY line_id) AS choices FROM t1c WHERE line_id NOT IN (SELECT line_id FROM t1) AND settlement_id NOT IN (SELECT settlement_id FROM t1)
), t2 AS (
  SELECT line_id, settlement_id, payment_legs, net, credit FROM (SELECT *, count(*) OVER (PARTITION BY settlement_id) AS rivals FROM t2c WHERE choices = 1 AND payment_legs >= 2) WHERE rivals = 1
), t3c AS (
  SELECT b.line_id, t.settlement_id, t.payment_legs, t.net, b.credit, count(*) OVER (PARTITION BY b.line_id) AS choices FROM bank b JOIN totals t ON t.net BETWEEN b.credit - 100 AND b.credit + 100 AND abs(t.settled_on - b.txn_date) <= 2
  WHERE b.line_id NOT IN (SELECT line_id FROM t0 UNION ALL SELECT line_id FROM t1 UNION ALL SELECT line_id FROM t2)
    AND t.settlement_id NOT IN (SELECT settlement_id FROM t0 UNION ALL SELECT settlement_id FROM t1 UNION ALL SELECT settlement_id FROM t2)
), t3 AS (
  SELECT line_id, settlement_id, payment_legs, net, credit FROM (SELECT *, count(*) OVER (PARTITION BY settlement_id) AS rivals FROM t3c WHERE choices = 1) WHERE rivals = 1
), matched AS (
  SELECT *, net - credit AS delta FROM (SELECT 'T0' AS tier, 1.0::DOUBLE AS confidence, * FROM t0 UNION ALL SELECT 'T1', 0.95::DOUBLE, * FROM t1 UNION ALL SELECT 'T2', 0.99::DOUBLE, * FROM t2 UNION ALL SELECT 'T3', 0.8::DOUBLE, * FROM t3)
), undecided AS (
  SELECT DISTINCT 'T1' AS tier, line_id, 'ambiguous' AS why, choices AS width FROM t1c WHERE choices > 1
  UNION ALL SELECT DISTINCT 'T2', line_id, 'ambiguous', choices FROM t2c WHERE choices > 1 UNION ALL SELECT DISTINCT 'T3', line_id, 'ambiguous', choices FROM t3c WHERE choices > 1
  UNION ALL SELECT 'T0', line_id, 'contested', n FROM (SELECT *, count(*) OVER (PARTITION BY settlement_id) AS n FROM t0c) WHERE n > 1
  UNION ALL SELECT 'T1', line_id, 'contested', n FROM (SELECT *, count(*) OVER (PARTITION BY settlement_id) AS n FROM t1c WHERE choices = 1 AND payment_legs = 1) WHERE n > 1
  UNION ALL SELECT 'T2', line_id, 'contested', n FROM (SELECT *, count(*) OVER (PARTITION BY settlement_id) AS n FROM t2c WHERE choices = 1 AND payment_legs >= 2) WHERE n > 1
  UNION ALL SELECT 'T3', line_id, 'contested', n FROM (SELECT *, count(*) OVER (PARTITION BY settlement_id) AS n FROM t3c WHERE choices = 1) WHERE n > 1
), free AS (
  SELECT order_id, order_date, gross_amount FROM register WHERE order_id NOT IN (SELECT order_id FROM psp WHERE order_id IS NOT NULL)
), rec0 AS (
  SELECT a.txn_id, f.order_id, count(*) OVER (PARTITION BY a.txn_id) AS pop, f.order_date <= CAST(a.captured_at AS DATE) AND CAST(a.captured_at AS DATE) - f.order_date <= 7 AS in_week
  FROM active a JOIN free f ON f.gross_amount = a.amount WHERE a.txn_type = 'payment' AND a.order_id IS NULL
), rec1 AS (
  SELECT txn_id, order_id FROM rec0 WHERE pop = 1 OR in_week QUALIFY count(*) OVER (PARTITION BY txn_id) = 1
), recovered AS (
  SELECT txn_id, order_id FROM rec1 QUALIFY count(*) OVER (PARTITION BY order_id) = 1
), setlegs AS (
  SELECT a.settlement_id, g.order_id, min(a.txn_id) AS first FROM active a LEFT JOIN recovered r ON r.txn_id = a.txn_id JOIN register g ON g.order_id = coalesce(a.order_id, r.order_id)
  WHERE a.txn_type IN ('payment', 'refund', 'chargeback') AND a.settlement_id IS NOT NULL GROUP BY ALL
), sets AS (
  SELECT settlement_id, string_agg(order_id, ',' ORDER BY first, order_id) AS order_ids, count(*) AS n_orders FROM setlegs GROUP BY settlement_id
), loose AS (
  SELECT b.*, CASE WHEN b.line_id IN (SELECT line_id FROM undecided) THEN 'AMBIGUOUS_MULTI_CANDIDATE' WHEN b.line_id IN (SELECT line_id FROM refs) THEN 'AMOUNT_MISMATCH' WHEN credit IS NULL THEN 'ORPHAN_BANK_LINE'
    WHEN NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT settled_on FROM totals WHERE settlement_id NOT IN (SELECT settlement_id FROM matched)) u WHERE abs(u.settled_on - b.txn_date) <= 2) THEN 'ORPHAN_BANK_LINE'
    WHEN NOT regexp_matches(narration, '\\b(setl_[A-Za-z0-9]+)\\b') AND NOT regexp_matches(upper(regexp_replace(narration, '\\s+', ' ', 'g')), '\\bUTR[:\\s]*([A-Z0-9]{12,22})\\b')
      AND NOT regexp_matches(upper(regexp_replace(narration, '\\s+', ' ', 'g')), '(?:RZPX|RAZORPAY)\\*?([A-Z][A-Z ]{2,}?)(?:\\s+(?:PL|PVT|LTD)\\b|$)') THEN 'UNPARSEABLE_NARRATION' ELSE 'NO_SETTLEMENT_REF' END AS reason_code
  FROM bank b WHERE b.line_id NOT IN (SELECT line_id FROM matched)
), badlegs AS (
  SELECT m.txn_id, m.amount, CASE WHEN suppressed THEN 'DUPLICATE_PSP_TXN' WHEN settlement_id IS NULL THEN 'ORPHAN_PSP_TXN' WHEN txn_type = 'payment' AND m.order_id IS NULL AND r.txn_id IS NULL THEN 'MISSING_ORDER_REF' END AS reason_code
  FROM marked m LEFT JOIN recovered r ON r.txn_id = m.txn_id
), excepted AS (
  SELECT 'bank_line' AS subject_type, line_id AS subject_id, reason_code, coalesce(credit, debit, 0) AS amount FROM loose UNION ALL SELECT 'psp_txn', txn_id, reason_code, amount FROM badlegs WHERE reason_code IS NOT NULL
)
"""
