"""Schemas and fixed values of settlement reconciliation. Money is whole minor units (paise) in longs."""

from __future__ import annotations

from pyspark.sql import types as T

ORDERS = T.StructType([
    T.StructField("order_id", T.StringType()), T.StructField("order_date", T.DateType()), T.StructField("customer_ref", T.StringType()),
    T.StructField("gross_amount", T.LongType()), T.StructField("currency", T.StringType()), T.StructField("status", T.StringType()),
])
PSP = T.StructType([
    T.StructField("txn_id", T.StringType()), T.StructField("txn_type", T.StringType()), T.StructField("order_id", T.StringType()), T.StructField("captured_at", T.TimestampNTZType()),
    T.StructField("amount", T.LongType()), T.StructField("settlement_id", T.StringType()), T.StructField("settled_at", T.DateType()),
])
BANK = T.StructType([
    T.StructField("line_id", T.StringType()), T.StructField("txn_date", T.DateType()), T.StructField("narration", T.StringType()), T.StructField("credit", T.LongType()),
    T.StructField("debit", T.LongType()), T.StructField("balance", T.LongType()), T.StructField("utr", T.StringType()),
])
INVOICE = T.StructType([
    T.StructField("invoice_no", T.StringType()), T.StructField("period", T.StringType()), T.StructField("taxable_value", T.LongType()),
    T.StructField("gst_amount", T.LongType()), T.StructField("gstin", T.StringType()), T.StructField("invoice_date", T.DateType()),
])

ORDER_STATUSES = ("paid", "refunded", "partially_refunded", "cancelled")
TXN_TYPES = ("payment", "refund", "fee", "tax", "chargeback", "adjustment", "reserve")
ORDER_BEARING = ("payment", "refund", "chargeback")
CURRENCY = "INR"
#: Days between settlement and bank posting, paise of tolerance, days from order to capture.
WINDOW_DAYS, TOLERANCE, RECOVERY_DAYS = 2, 100, 7
#: Fee rate of the processor and tax rate on the fee, in basis points.
FEE_BPS, TAX_BPS = 236, 1800
TIERS = ("T0", "T1", "T2", "T3", "LLM")
CONFIDENCE = {"T0": 1.00, "T1": 0.95, "T2": 0.99, "T3": 0.80, "LLM": 0.70}
REASONS = (
    "AMBIGUOUS_MULTI_CANDIDATE", "AMOUNT_MISMATCH", "ORPHAN_BANK_LINE", "UNPARSEABLE_NARRATION", "NO_SETTLEMENT_REF", "DUPLICATE_PSP_TXN", "ORPHAN_PSP_TXN", "MISSING_ORDER_REF",
)
#: When a run-to-run change counts: absolute for rates, relative for sizes.
RATE_MOVE, SIZE_MOVE = 0.01, 0.05
EXACT_METRICS, NEVER_METRICS = ("false_match_rate", "precision", "trap_capture_rate"), ("throughput",)
