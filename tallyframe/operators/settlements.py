"""Settlements from their legs: duplicate suppression, order recovery, totals and order sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import expected_fee_and_tax
from tallyframe.types import ORDER_BEARING, RECOVERY_DAYS, TXN_TYPES

EVENT = ["txn_type", "order_id", "captured_at", "amount"]


def suppress_duplicates(psp: DataFrame) -> DataFrame:
    """psp with suppressed, and twins: in how many settlements the leg's event stands.

    An event is the type, order, capture time and amount of an order's leg. Within a settlement its least txn_id stays;
    unsettled copies of a settled leg go; of unsettled ones alone the least stays. Legs of the same event in several
    settlements are counted, never suppressed. Legs without an order, or of other types, are never copies.
    """
    eligible = F.coalesce(F.col("txn_type").isin(*ORDER_BEARING) & F.col("order_id").isNotNull(), F.lit(False))
    # dealt out by event, which both windows can use; legs that can't be copies aren't shuffled
    ranked = psp.where(eligible).repartition(*EVENT).withColumn("_rank", F.row_number().over(Window.partitionBy(*EVENT, "settlement_id").orderBy("txn_id")))
    # the first leg of each settlement of an event, counted
    settlements = F.count_if(F.col("settlement_id").isNotNull() & (F.col("_rank") == 1)).over(Window.partitionBy(*EVENT))
    gone = F.when(F.col("settlement_id").isNotNull(), F.col("_rank") > 1).otherwise((settlements > 0) | (F.col("_rank") > 1))
    marked = ranked.withColumns({"suppressed": gone, "twins": settlements.cast("long")}).drop("_rank")
    return marked.unionByName(psp.where(~eligible).withColumns({"suppressed": F.lit(False), "twins": F.lit(0).cast("long")}))


def active_legs(psp: DataFrame) -> DataFrame:
    return suppress_duplicates(psp).where("not suppressed").drop("suppressed", "twins")


def settlement_totals(active: DataFrame) -> DataFrame:
    """One row for each settlement: gross, fees, tax, refunds, holds, net, payment_legs, legs and settled_on. A leg of an unknown type is an error: it would be in the net and in none of its parts."""
    known = F.col("txn_type").isin(*TXN_TYPES)
    active = active.withColumn("amount", F.when(F.coalesce(known, F.lit(False)), F.col("amount")).otherwise(F.raise_error(F.format_string("leg %s is of no known type: %s", "txn_id", F.coalesce("txn_type", F.lit("null")))).cast("long")))
    part = lambda *types, sign=1: F.coalesce(F.sum(F.when(F.col("txn_type").isin(*types), F.lit(sign).cast("long") * F.col("amount"))), F.lit(0)).cast("long")
    return active.where("settlement_id is not null").groupBy("settlement_id").agg(
        part("payment", "adjustment").alias("gross"), part("fee", sign=-1).alias("fees"), part("tax", sign=-1).alias("tax"), part("refund", sign=-1).alias("refunds"),
        part("chargeback", "reserve", sign=-1).alias("holds"), F.sum("amount").alias("net"), F.count_if(F.col("txn_type") == "payment").alias("payment_legs"),
        F.count("*").alias("legs"), F.coalesce(F.max("settled_at"), F.max(F.col("captured_at").cast("date"))).alias("settled_on"),
    )


def fee_diagnosis(totals: DataFrame, payments: DataFrame) -> DataFrame:
    """(settlement_id, payment_gross, expected_fee, expected_tax, fee_gap, tax_gap, residual)."""
    gross = payments.where("txn_type = 'payment' and settlement_id is not null").groupBy("settlement_id").agg(F.sum("amount").alias("payment_gross"))
    joined = totals.join(gross, "settlement_id", "left").withColumn("payment_gross", F.coalesce("payment_gross", F.lit(0).cast("long")))
    fee, tax = expected_fee_and_tax(F.col("payment_gross"))
    return joined.select(
        "settlement_id", "payment_gross", fee.alias("expected_fee"), tax.alias("expected_tax"), (F.col("fees") - fee).alias("fee_gap"), (F.col("tax") - tax).alias("tax_gap"),
        (F.col("gross") - F.col("fees") - F.col("tax") - F.col("refunds") - F.col("holds") - F.col("net")).alias("residual"),
    )


def recover_orders(psp: DataFrame, active: DataFrame, orders: DataFrame) -> DataFrame:
    """(txn_id, order_id) of active payments without an order that one order alone explains, and that order no other such payment.

    Candidates are orders of that amount which no leg names, suppressed legs included. Where there are several, those
    dated in the week before the capture remain.
    """
    named = psp.where("order_id is not null").select("order_id")
    free = orders.join(named, "order_id", "left_anti").select(F.col("order_id").alias("found"), "order_date", F.col("gross_amount").alias("amount"))
    open_legs = active.where("txn_type = 'payment' and order_id is null").select("txn_id", "amount", F.col("captured_at").cast("date").alias("captured_on"))
    # counts by amount, and by amount and day, decide without a pair of every leg and order of one price
    by_day = free.groupBy("amount", F.col("order_date").alias("day")).agg(F.count("*").alias("n"), F.min("found").alias("found"))
    by_amount = by_day.groupBy("amount").agg(F.sum("n").alias("choices"), F.min("found").alias("sole"))
    priced = open_legs.join(by_amount, "amount")
    sole = priced.where("choices = 1").select("txn_id", F.col("sole").alias("found"))
    days = priced.where("choices > 1").select("txn_id", "amount", F.explode(F.sequence(F.date_sub("captured_on", RECOVERY_DAYS), "captured_on")).alias("day"))
    in_week = days.join(by_day, ["amount", "day"]).groupBy("txn_id").agg(F.sum("n").alias("n"), F.min("found").alias("found")).where("n = 1").select("txn_id", "found")
    claims = sole.unionByName(in_week).groupBy("found").agg(F.count("*").alias("rivals"), F.min("txn_id").alias("txn_id"))
    return claims.where("rivals = 1").select("txn_id", F.col("found").alias("order_id"))


def dangling_refs(active: DataFrame, orders: DataFrame) -> DataFrame:
    """Active legs of orders that the register doesn't have."""
    bearing = active.where(F.col("txn_type").isin(*ORDER_BEARING) & F.col("order_id").isNotNull())
    return bearing.join(orders.select("order_id"), "order_id", "left_anti").select("txn_id", "txn_type", "order_id", "settlement_id")


def _place(active: DataFrame, order: tuple[str, ...]) -> Column:
    return F.struct(*order) if order else F.col("ordinal" if "ordinal" in active.columns else "txn_id")


def order_sets(active: DataFrame, orders: DataFrame, recovered: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """(settlement_id, order_ids, n_orders): registered orders of each settlement, recovered ones too, joined by commas in order of their first legs: by the columns of order if named, by ordinal, the place in the file, where active has it, else by txn_id."""
    legs = active.where(F.col("txn_type").isin(*ORDER_BEARING) & F.col("settlement_id").isNotNull()).select("txn_id", "settlement_id", "order_id", _place(active, order).alias("place"))
    # only legs without an order meet the recovered ones
    filled = legs.where("order_id is null").drop("order_id").join(recovered.select("txn_id", "order_id"), "txn_id")
    known = legs.where("order_id is not null").unionByName(filled).drop("txn_id").join(orders.select("order_id"), "order_id", "left_semi")
    firsts = known.groupBy("settlement_id", "order_id").agg(F.min("place").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "order_id"))), lambda x: x["order_id"])
    return firsts.groupBy("settlement_id").agg(F.array_join(ordered, ",").alias("order_ids"), F.count("*").alias("n_orders"))


def leg_lists(active: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """(settlement_id, txn_ids): each settlement's legs as an array in the order of the file: by the columns of order if named, by ordinal where active has it, else by txn_id."""
    placed = active.where("settlement_id is not null").select("settlement_id", _place(active, order).alias("place"), "txn_id")
    legs = placed.groupBy("settlement_id").agg(F.array_sort(F.collect_list(F.struct("place", "txn_id"))).alias("legs"))
    return legs.select("settlement_id", F.transform("legs", lambda x: x["txn_id"]).alias("txn_ids"))
