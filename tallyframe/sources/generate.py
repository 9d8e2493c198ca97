"""A seeded generator of adversarial reconciliation data: every value is a hash of seed, batch and purpose, so any size is made in parallel and reruns agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import pct_of
from tallyframe.types import FEE_BPS, TAX_BPS

#: What is wrong with a batch; the first of a hundred batches each, the rest are clean.
DEFECTS = (
    "many_to_one", "cross_period_refund", "fee_plus_gst", "garbled_narration", "duplicate_psp_txn", "rounding_break", "chargeback_hold", "split_settlement", "missing_order_ref", "ambiguous_unresolvable", "obfuscated_settlement_ref",
)
#: Orders of a batch, in turn.
SIZES = (1, 1, 2, 2, 3, 3, 4, 4, 5, 6)


@dataclass(frozen=True)
class Dataset:
    orders: DataFrame
    psp: DataFrame
    bank: DataFrame
    linkages: DataFrame
    unresolvable: DataFrame
    invoices: DataFrame
    defects: DataFrame


def _draw(seed: int, purpose: str, *keys: Column, below: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *keys), F.lit(below)).cast("long")


def separate(lines: DataFrame, reserved: DataFrame) -> DataFrame:
    """lines (line_id, txn_date, credit, posted) with dates such that no two have one date and credit, and none a reserved (txn_date, credit).

    Slots are claimed in rounds: first every line its own date, then the losers one, two and no days after posting. Of the
    claims to a free slot that of the least line_id wins. A fixed number of rounds, each a rank by slot; only lines
    that collide take part. A line without a free slot in its window is an error.
    """
    from tallyframe.operators.lineage import cut

    slot = ["txn_date", "credit"]
    held = reserved.select(*slot).distinct()
    meet = Window.partitionBy(*slot)
    counted = cut(lines.join(held.withColumn("kept", F.lit(True)), slot, "left").withColumn("n", F.count("*").over(meet)))
    free = counted.where("n = 1 and kept is null").select(*lines.columns)
    left, placed = cut(counted.where("n > 1 or kept is not null").select(*lines.columns)), None
    if left.isEmpty():
        return free
    taken = held.unionByName(free.select(*slot))
    for after in (None, 1, 2, 0):
        claims = left if after is None else left.withColumn("txn_date", F.date_add("posted", after))
        won = cut(claims.join(taken, slot, "left_anti").withColumn("place", F.row_number().over(meet.orderBy("line_id"))).where("place = 1").drop("place"))
        placed, taken = won if placed is None else placed.unionByName(won), taken.unionByName(won.select(*slot))
        left = cut(left.join(won, "line_id", "left_anti"))
    stuck = left.select("line_id", F.raise_error(F.concat(F.lit("no free date in the window of "), "line_id")).cast("date").alias("txn_date"), *(c for c in lines.columns if c not in ("line_id", "txn_date")))
    return free.unionByName(placed).unionByName(stuck.select(*lines.columns))


def generate(spark: SparkSession, batches: int, seed: int = 42, per_hundred: int = 2) -> Dataset:
    """Batches of orders settled together. Of each hundred, per_hundred have each defect in turn; gross amounts are distinct."""
    b = F.col("batch")
    slot = b % 100
    kinds = F.array(*(F.lit(d) for d in DEFECTS))
    defect = F.when(slot < per_hundred * len(DEFECTS), F.get(kinds, (slot % len(DEFECTS)).cast("int"))).otherwise("clean")
    base = spark.range(batches).select(F.col("id").alias("batch")).withColumns({"defect": defect, "size": F.get(F.array(*map(F.lit, SIZES)), (b % len(SIZES)).cast("int"))})
    base = base.withColumn("size", F.when(F.col("defect").isin("many_to_one", "ambiguous_unresolvable"), F.greatest("size", F.lit(3))).otherwise(F.col("size")))
    base = base.withColumns({"settled": F.date_add(F.lit("2026-01-01").cast("date"), (b * 2 + _draw(seed, "gap", b, below=2)).cast("int") % 720), "settlement_id": F.concat(F.lit("setl_G"), F.lpad(b.cast("string"), 9, "0"))})
    each = base.withColumn("i", F.explode(F.sequence(F.lit(1), "size"))).withColumn("number", b * 10 + F.col("i"))
    each = each.withColumns({"order_id": F.concat(F.lit("ORD-"), F.lpad("number", 10, "0")), "amount": (_draw(seed, "gross", F.col("number"), below=50_000) * 100 + 10_000).cast("long") * 1000 + F.col("number") % 100_000, "captured": F.date_sub("settled", 2)})
    orders = each.select("order_id", F.date_sub("captured", _draw(seed, "age", F.col("number"), below=3).cast("int")).alias("order_date"), F.concat(F.lit("CUST-"), _draw(seed, "who", F.col("number"), below=90_000)).alias("customer_ref"), F.col("amount").alias("gross_amount"), F.lit("INR").alias("currency"), F.lit("paid").alias("status"))
    gross = each.groupBy("batch", "defect", "settlement_id", "settled").agg(F.sum("amount").alias("gross"), F.max("amount").alias("largest"))
    fee = pct_of(F.col("gross"), FEE_BPS)
    refund = F.when(F.col("defect") == "cross_period_refund", pct_of(F.col("largest"), 5000)).otherwise(0).cast("long")
    hold = F.when(F.col("defect") == "chargeback_hold", F.col("largest")).otherwise(0).cast("long")
    money = gross.withColumns({"fee": fee, "tax": pct_of(fee, TAX_BPS), "refund": refund, "hold": hold}).withColumn("net", F.col("gross") - F.col("fee") - F.col("tax") - F.col("refund") - F.col("hold"))
    at = lambda d: F.col(d).cast("timestamp_ntz").alias("captured_at")
    anonymous = (F.col("defect") == "missing_order_ref") & (F.col("i") == 1)
    pays = each.select(F.concat(F.lit("pay_"), "number").alias("txn_id"), F.lit("payment").alias("txn_type"), F.when(~anonymous, F.col("order_id")).alias("order_id"), at("captured"), "amount", "settlement_id", F.col("settled").alias("settled_at"))
    mirror = _draw(seed, "mirror", b, below=10) < 3
    copies = each.where("defect = 'duplicate_psp_txn' and i = 1").select(F.concat(F.lit("pay_"), "number", F.lit("_z")).alias("txn_id"), F.lit("payment").alias("txn_type"), "order_id", at("captured"), "amount", F.when(~mirror, F.col("settlement_id")).alias("settlement_id"), F.when(~mirror, F.col("settled")).alias("settled_at"))
    leg = lambda prefix, kind, value: money.where(F.col(value) != 0).select(F.concat(F.lit(prefix), "batch").alias("txn_id"), F.lit(kind).alias("txn_type"), F.lit(None).cast("string").alias("order_id"), at("settled"), (-F.col(value)).alias("amount"), "settlement_id", F.col("settled").alias("settled_at"))
    twin = F.concat("settlement_id", F.lit("T"))
    twins = money.where("defect = 'ambiguous_unresolvable'")
    twin_legs = twins.select(F.concat(F.lit("pay_t"), "batch").alias("txn_id"), F.lit("payment").alias("txn_type"), F.lit(None).cast("string").alias("order_id"), at("settled"), F.col("net").alias("amount"), twin.alias("settlement_id"), F.col("settled").alias("settled_at"))
    psp = pays.unionByName(copies).unionByName(leg("adj_f", "fee", "fee")).unionByName(leg("adj_t", "tax", "tax")).unionByName(leg("rfnd_", "refund", "refund")).unionByName(leg("cb_", "chargeback", "hold")).unionByName(twin_legs)

    named = F.concat(F.lit("NEFT CR SETL "), "settlement_id")
    text = F.when(F.col("defect") == "garbled_narration", "NEFT CR   PAYOUT").when(F.col("defect").isin("ambiguous_unresolvable", "many_to_one"), "BY TRANSFER").when(F.col("defect") == "obfuscated_settlement_ref", F.concat(F.lit("NEFT/ST "), F.expr("substring(settlement_id, 6)"))).otherwise(named)
    credit = F.when(F.col("defect") == "rounding_break", F.col("net") - 50).otherwise(F.col("net"))
    late = F.when(F.col("defect") == "obfuscated_settlement_ref", 4 + _draw(seed, "late", b, below=6)).otherwise(_draw(seed, "post", b, below=2)).cast("int")
    parts = F.when(F.col("defect") == "split_settlement", F.array(pct_of(credit, 6000), credit - pct_of(credit, 6000))).when(F.col("defect") == "ambiguous_unresolvable", F.array(credit, credit)).otherwise(F.array(credit))
    delayed = F.when(F.col("defect") == "obfuscated_settlement_ref", late).otherwise(0)
    lines = money.select("batch", "defect", "settlement_id", F.date_add("settled", delayed).alias("posted"), F.date_add("settled", late).alias("txn_date"), text.alias("narration"), F.posexplode(parts).alias("part", "credit"))
    lines = lines.withColumn("line_id", F.concat(F.lit("BL-"), F.lpad(b.cast("string"), 9, "0"), F.lit("-"), "part"))
    trap = F.col("defect") == "ambiguous_unresolvable"
    lines = lines.where(trap).unionByName(separate(lines.where(~trap), lines.where(trap)))
    bank = lines.select("line_id", "txn_date", "narration", "credit", F.lit(None).cast("long").alias("debit"), F.lit(0).cast("long").alias("balance"), F.lit(None).cast("string").alias("utr"))
    sets = each.groupBy("settlement_id").agg(F.array_join(F.array_sort(F.collect_list("order_id")), ",").alias("order_ids"))
    leg_sets = psp.where("settlement_id is not null").groupBy("settlement_id").agg(F.array_sort(F.collect_set("txn_id")).alias("txn_ids"))
    linkages = lines.join(sets, "settlement_id").join(leg_sets, "settlement_id").select("line_id", "settlement_id", "order_ids", "txn_ids")
    hurt = lines.where("defect <> 'clean'").groupBy("batch", "defect").agg(F.array_sort(F.collect_set("line_id")).alias("affected_ids"))
    defects = hurt.select(F.col("defect").alias("defect_type"), "affected_ids", (F.col("defect") != "ambiguous_unresolvable").alias("resolvable"))
    trapped = lines.where("defect = 'ambiguous_unresolvable'").select("line_id")
    month = F.date_format("settled", "yyyy-MM")
    taxes = money.groupBy(month.alias("period")).agg(F.sum("fee").alias("taxable_value"), F.sum("tax").alias("tax"))
    short = F.when(F.substring("period", 6, 2) == "05", F.col("tax") - pct_of(F.col("tax"), 2500)).otherwise(F.col("tax"))
    invoices = taxes.where(F.substring("period", 6, 2) != "09").select(F.concat(F.lit("INV-"), "period").alias("invoice_no"), "period", "taxable_value", short.alias("gst_amount"), F.lit("29AAAAA0000A1Z5").alias("gstin"), F.last_day(F.to_date(F.concat("period", F.lit("-01")))).alias("invoice_date"))
    return Dataset(orders, psp, bank, linkages, trapped, invoices, defects)
