"""Layouts of real files as DataFrame pipelines: raw rows to canonical records, and to a quarantine with a reason for each row that isn't one.

A layout names its columns, its rows to skip, the key that makes a row a repetition, a ladder of reasons, and the
records of a good row. The first reason that applies counts; a repeated key counts before the row's values do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import narration
from tallyframe.functions.money import parse_date, parse_paise
from tallyframe.sources.files import DETECTION, HEAD_BYTES, cell, decode, header_confidence, optional, read_rows, without_comments

QUARANTINE = ["path", "file_sha256", "row", "raw", "format_id", "reason"]


@dataclass(frozen=True)
class Layout:
    format_id: str
    table: str
    required: tuple[str, ...]
    distinctive: tuple[str, ...]
    reasons: Callable[[], list[tuple[Column, str]]]
    records: Callable[[DataFrame], DataFrame]
    key: Callable[[], Column] = field(default=lambda: F.lit(None).cast("string"))
    skip: Callable[[], Column] = field(default=lambda: F.lit(False))
    one_of: tuple[tuple[str, ...], ...] = ()
    #: A column whose values, if all full rows of a file have one of their own, name the file's rows.
    reference: str | None = None

    def confidence(self, names: list[str]) -> float:
        from tallyframe.sources.files import normalise_header

        have = {normalise_header(n) for n in names}
        if any(not any(normalise_header(n) in have for n in group) for group in self.one_of):
            return 0.0
        return header_confidence(names, self.required, self.distinctive)


def _missing(*names: str) -> list[tuple[Column, str]]:
    return [(optional(n).isNull(), "MISSING_VALUE") for n in names]


def _amounts(*names: str) -> list[tuple[Column, str]]:
    return [(optional(n).isNotNull() & parse_paise(cell(n)).isNull(), "BAD_DECIMAL") for n in names]


# ---- a payment processor's settlement report

#: Types of the report and their legs; types without a counterpart.
PROCESSOR_TYPES = {"payment": "payment", "refund": "refund", "adjustment": "adjustment", "dispute": "chargeback", "fee": "fee", "tax": "tax"}
PROCESSOR_UNSUPPORTED = ("transfer",)


def _moment(name: str) -> Column:
    return F.coalesce(*(F.try_to_timestamp(cell(name), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss"))).cast("timestamp_ntz")


def _fee() -> Column:
    return parse_paise(F.coalesce(cell("fee (exclusive tax)"), cell("fee")))


def _processor_reasons() -> list[tuple[Column, str]]:
    kind, money = F.lower(cell("type")), {n: parse_paise(cell(n)) for n in ("amount", "tax", "debit", "credit")}
    principal = F.when(money["credit"] != 0, money["amount"]).otherwise(-money["amount"])
    return [
        *_missing("entity_id", "type"), (kind.isin(*PROCESSOR_UNSUPPORTED), "UNSUPPORTED_ROW_TYPE"), (~kind.isin(*PROCESSOR_TYPES), "UNKNOWN_VALUE"), *_missing("currency"), (F.upper(cell("currency")) != "INR", "UNKNOWN_VALUE"),
        *_missing("amount"), *_amounts("amount"), (F.nullif(F.coalesce(cell("fee (exclusive tax)"), cell("fee")), F.lit("")).isNull(), "MISSING_VALUE"), (_fee().isNull(), "BAD_DECIMAL"), *_missing("tax", "debit", "credit"), *_amounts("tax", "debit", "credit"),
        ((money["debit"] != 0) == (money["credit"] != 0), "AMBIGUOUS_DIRECTION"), (principal - _fee() - money["tax"] != money["credit"] - money["debit"], "ARITHMETIC_MISMATCH"),
        *_missing("created_at"), (_moment("created_at").isNull(), "BAD_DATE"), (optional("settled_at").isNotNull() & parse_date(cell("settled_at"), "yyyy-MM-dd", "dd/MM/yyyy").isNull(), "BAD_DATE"),
    ]


def _processor_records(good: DataFrame) -> DataFrame:
    """The principal, and fee and tax legs that aren't zero; order_receipt before order_id."""
    kinds = F.create_map(*[F.lit(x) for pair in PROCESSOR_TYPES.items() for x in pair])
    amount = F.when(parse_paise(cell("credit")) != 0, parse_paise(cell("amount"))).otherwise(-parse_paise(cell("amount")))
    leg = lambda suffix, kind, value: F.struct(F.concat(cell("entity_id"), F.lit(suffix)).alias("txn_id"), kind.alias("txn_type"), value.alias("amount"))
    legs = F.array(leg("", kinds[F.lower(cell("type"))], amount), leg("_fee", F.lit("fee"), -_fee()), leg("_tax", F.lit("tax"), -parse_paise(cell("tax"))))
    full = good.select("row", "path", F.explode(F.filter(legs, lambda x: x["amount"] != 0)).alias("l"), F.coalesce(optional("order_receipt"), optional("order_id")).alias("order_id"), _moment("created_at").alias("captured_at"),
                       optional("settlement_id").alias("settlement_id"), parse_date(cell("settled_at"), "yyyy-MM-dd", "dd/MM/yyyy").alias("settled_at"))
    return full.select("path", "row", "l.txn_id", "l.txn_type", "order_id", "captured_at", "l.amount", "settlement_id", "settled_at")


# ---- bank statements


def _bank_reasons(date: str, form: str, text: str, out: str, into: str, balance: str, signed: bool) -> Callable[[], list[tuple[Column, str]]]:
    def reasons() -> list[tuple[Column, str]]:
        debit, credit = F.coalesce(parse_paise(cell(out)), F.lit(0)), F.coalesce(parse_paise(cell(into)), F.lit(0))
        suffixed = [(cell(n).rlike(r"(?i)\s*(cr|dr)\.?$"), "UNKNOWN_VALUE") for n in (out, into)] if signed else []
        return [
            *_missing(date, text, balance), (parse_date(cell(date), form).isNull(), "BAD_DATE"), *suffixed, *_amounts(out, into), (_balance(balance).isNull(), "BAD_DECIMAL"),
            ((debit < 0) | (credit < 0), "BAD_DECIMAL"), ((debit != 0) == (credit != 0), "AMBIGUOUS_DIRECTION"),
        ]

    return reasons


def _balance(name: str) -> Column:
    """A balance with a minus, or with Cr or Dr behind it."""
    bare = F.regexp_replace(cell(name), r"(?i)\s*(cr|dr)\.?$", "")
    value = parse_paise(bare)
    return F.when(cell(name).rlike(r"(?i)dr\.?$"), -value).otherwise(value)


#: Payment rails that a narration begins with, a reference, and one with its name before it.
RAILS, REFERENCE, MARKED = "NEFT|RTGS|IMPS|UPI|MMT", r"^(?=.*[0-9])[A-Za-z0-9]{10,22}$", r"(?i)\bUTR[:\s-]*([A-Za-z0-9]{10,22})\b"


def bank_utr(text: Column, last: bool) -> Column:
    """The bank's reference in a narration, or null: after the word UTR, else in the last part of a rail's narration, or (last is false) right after the rail."""
    marked = F.nullif(F.regexp_extract(text, MARKED, 1), F.lit(""))
    bare = F.trim(text)
    if last:
        found = F.when(bare.rlike(f"(?i)^(?:{RAILS})"), F.trim(F.element_at(F.split(bare, "[-/]"), -1)))
    else:
        found = F.regexp_extract(text, rf"(?i)\b(?:{RAILS})[-/]([A-Za-z0-9]{{10,22}})\b", 1)
    return F.coalesce(marked, F.when(found.rlike(REFERENCE), found))


def _bank_records(prefix: str, date: str, form: str, text: str, out: str, into: str, balance: str, reference: str | None) -> Callable[[DataFrame], DataFrame]:
    def records(good: DataFrame) -> DataFrame:
        """line_id is the bank's reference if all full rows of the file, good or not, have one of their own, else the physical line that the row begins at."""
        positional = F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("row").cast("string"), F.greatest(F.lit(5), F.length(F.col("row").cast("string"))), F.lit("0")))
        named = F.when(F.col("carried"), optional(reference)).otherwise(positional) if reference else positional
        side = lambda n: F.nullif(parse_paise(cell(n)), F.lit(0).cast("long"))
        utr = bank_utr(cell(text), reference is not None)
        return good.select("path", "row", named.alias("line_id"), parse_date(cell(date), form).alias("txn_date"), cell(text).alias("narration"), side(into).alias("credit"), side(out).alias("debit"), _balance(balance).alias("balance"), utr.alias("utr"))

    return records


# ---- a shop's orders

#: Statuses with and without a counterpart.
SHOP_STATUSES = {"paid": "paid", "refunded": "refunded", "partially_refunded": "partially_refunded", "voided": "cancelled"}
SHOP_UNSUPPORTED = ("authorized", "expired", "partially_paid", "pending")
_STAMP = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(?: ?[+-][0-9]{2}:?[0-9]{2}| ?UTC|Z)?$"


def _shop_date() -> Column:
    """The date as written: the offset is read, not applied."""
    return F.try_to_date(F.nullif(F.regexp_extract(cell("Created at"), _STAMP, 1), F.lit("")), "yyyy-MM-dd")


def _shop_reasons() -> list[tuple[Column, str]]:
    status = F.lower(cell("Financial Status"))
    return [
        *_missing("Name", "Email", "Financial Status"), (status.isin(*SHOP_UNSUPPORTED), "UNSUPPORTED_ROW_TYPE"), (~status.isin(*SHOP_STATUSES), "UNKNOWN_VALUE"), *_missing("Currency"), (F.upper(cell("Currency")) != "INR", "UNKNOWN_VALUE"),
        *_missing("Total"), *_amounts("Total"), (parse_paise(cell("Total")) < 0, "AMBIGUOUS_DIRECTION"), *_missing("Created at"), (_shop_date().isNull(), "BAD_DATE"),
    ]


def _shop_records(good: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in SHOP_STATUSES.items() for x in pair])
    return good.select("path", "row", cell("Name").alias("order_id"), _shop_date().alias("order_date"), cell("Email").alias("customer_ref"), parse_paise(cell("Total")).alias("gross_amount"), F.lit("INR").alias("currency"), kinds[F.lower(cell("Financial Status"))].alias("status"))


# ---- a courier's remittance

#: What a courier's columns mean and their usual names, and the deductions with their legs and prefixes.
COURIER_COLUMNS = {
    "remittance_ref": "Remittance Ref", "utr": "UTR", "remittance_date": "Remittance Date", "waybill": "Waybill", "order_id": "Order ID", "row_type": "Row Type", "delivery_date": "Delivery Date",
    "cod_amount": "COD Amount", "freight": "Freight Charge", "cod_fee": "COD Handling Fee", "rto": "RTO Charge", "gst": "GST",
}
COURIER_REQUIRED, COURIER_DISTINCTIVE = ("remittance_ref", "remittance_date", "waybill", "order_id", "cod_amount"), ("waybill", "freight", "cod_fee", "rto")
COURIER_DEDUCTIONS = (("freight", "fee", "frt"), ("cod_fee", "fee", "cdf"), ("rto", "fee", "rto"), ("gst", "tax", "gst"))
_COURIER_DATES = ("dd-MM-yyyy", "yyyy-MM-dd")


def courier(column_map: dict[str, str] | None = None) -> Layout:
    """The layout of a courier's remittance; column_map gives other names for some of COURIER_COLUMNS. Deduction columns that a file doesn't have are no deductions."""
    unknown = set(column_map or {}) - set(COURIER_COLUMNS)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}; names can be given for {sorted(COURIER_COLUMNS)}")
    names = {**COURIER_COLUMNS, **(column_map or {})}
    has = lambda role: optional(names[role])
    deducted = lambda role: F.coalesce(F.when(has(role).isNotNull(), parse_paise(cell(names[role]))), F.lit(0).cast("long"))

    def terms() -> tuple[Column, Column, Column, Column, Column]:
        """Kind, amount collected, bare reference, and the days of remittance and delivery."""
        kind = F.upper(F.coalesce(has("row_type"), F.lit("COD")))
        collected = F.when(kind == "COD", parse_paise(cell(names["cod_amount"]))).otherwise(F.lit(0).cast("long"))
        remitted = parse_date(cell(names["remittance_date"]), *_COURIER_DATES)
        delivered = F.when((kind == "COD") & has("delivery_date").isNotNull(), parse_date(cell(names["delivery_date"]), *_COURIER_DATES)).otherwise(remitted)
        return kind, collected, F.regexp_replace(cell(names["remittance_ref"]), "[^A-Za-z0-9]", ""), remitted, delivered

    def reasons() -> list[tuple[Column, str]]:
        kind, collected, reference, remitted, delivered = terms()
        shipped = kind == "COD"
        money = [(has(role).isNotNull() & parse_paise(cell(names[role])).isNull(), "BAD_DECIMAL") for role, *_ in COURIER_DEDUCTIONS]
        below = [(deducted(role) < 0, "AMBIGUOUS_DIRECTION") for role, *_ in COURIER_DEDUCTIONS]
        return [
            *_missing(names["remittance_ref"]), (reference == "", "MISSING_VALUE"), *_missing(names["remittance_date"]), (remitted.isNull(), "BAD_DATE"), (~kind.isin("COD", "DEDUCTION"), "UNKNOWN_VALUE"),
            (shipped & has("waybill").isNull(), "MISSING_VALUE"), (shipped & has("order_id").isNull(), "MISSING_VALUE"), (shipped & has("cod_amount").isNull(), "MISSING_VALUE"), (collected.isNull(), "BAD_DECIMAL"), (collected < 0, "AMBIGUOUS_DIRECTION"),
            *money, *below, (collected + sum(deducted(role) for role, *_ in COURIER_DEDUCTIONS) == 0, "AMBIGUOUS_DIRECTION"), (delivered.isNull(), "BAD_DATE"),
        ]

    def records(good: DataFrame) -> DataFrame:
        """A payment for what was collected, and a leg for each deduction; a row without a waybill is named by its remittance and line."""
        _, collected, reference, remitted, delivered = terms()
        subject = F.coalesce(has("waybill"), F.concat(reference, F.lit("L"), F.col("row")))
        leg = lambda prefix, kind, amount: F.struct(F.concat(F.lit(f"{prefix}_"), subject).alias("txn_id"), F.lit(kind).alias("txn_type"), amount.alias("amount"))
        legs = F.array(leg("cod", "payment", collected), *(leg(prefix, kind, -deducted(role)) for role, kind, prefix in COURIER_DEDUCTIONS))
        full = good.select("path", "row", F.explode(F.filter(legs, lambda x: x["amount"] != 0)).alias("l"), has("order_id").alias("order_id"), delivered.cast("timestamp_ntz").alias("captured_at"), narration.remittance_settlement(cell(names["remittance_ref"])).alias("settlement_id"), remitted.alias("settled_at"))
        return full.select("path", "row", "l.txn_id", "l.txn_type", "order_id", "captured_at", "l.amount", "settlement_id", "settled_at")

    return Layout("cod-remittance-delhivery-v1", "psp", tuple(names[r] for r in COURIER_REQUIRED), tuple(names[r] for r in COURIER_DISTINCTIVE), reasons, records, lambda: F.concat(F.lit("waybill:"), has("waybill")))


_FIRST = ("Date", "d/M/yy", "Narration", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance")
_SECOND = ("Transaction Date", "d-M-yyyy", "Transaction Remarks", "Withdrawal Amount (INR)", "Deposit Amount (INR)", "Balance (INR)")
LAYOUTS = (
    Layout("razorpay-settlement-v2", "psp", ("entity_id", "type", "debit", "credit", "amount", "currency", "tax", "created_at", "settlement_id"), ("settlement_utr", "order_receipt", "settled_at", "on_hold"), _processor_reasons, _processor_records,
           lambda: F.concat(F.lit("entity_id:"), optional("entity_id")), one_of=(("fee (exclusive tax)", "fee"),)),
    Layout("bank-csv-hdfc-v1", "bank", tuple(_FIRST[i] for i in (0, 2, 3, 4, 5)), ("Chq./Ref.No.", "Value Dt"), _bank_reasons(*_FIRST, signed=False), _bank_records("HDFC", *_FIRST, "Chq./Ref.No."), reference="Chq./Ref.No."),
    Layout("bank-csv-icici-v1", "bank", tuple(_SECOND[i] for i in (0, 2, 3, 4, 5)), ("S No.", "Value Date", "Cheque Number"), _bank_reasons(*_SECOND, signed=True), _bank_records("ICICI", *_SECOND, None)),
    Layout("orders-csv-shopify-v1", "orders", ("Name", "Email", "Financial Status", "Currency", "Total", "Created at"), ("Lineitem quantity", "Lineitem name", "Fulfillment Status", "Paid at", "Subtotal"), _shop_reasons, _shop_records,
           lambda: F.concat(F.lit("name:"), optional("Name")), lambda: optional("Name").isNotNull() & F.coalesce(optional("Financial Status"), optional("Total"), optional("Created at")).isNull()),
    courier(),
)
BY_ID = {x.format_id: x for x in LAYOUTS}


def parse(rows: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of raw rows in one layout. Blank rows and rows that the layout skips are neither."""
    blank = F.forall("cells", lambda c: F.trim(c) == "")
    key = F.coalesce(layout.key(), F.col("raw"))
    judged = rows.withColumn("blank", F.coalesce(blank, F.lit(False))).where(~F.col("blank")).withColumn("short", F.coalesce(F.size("cells") < F.size("header"), F.lit(True))).withColumn("long", F.coalesce(F.size("cells") > F.size("header"), F.lit(False)))
    judged = judged.withColumn("skipped", ~F.col("short") & ~F.col("long") & layout.skip()).where(~F.col("skipped"))
    whole = ~F.col("short") & ~F.col("long")
    first = F.min(F.when(whole, F.col("row"))).over(Window.partitionBy("path", key))
    judged = judged.withColumn("first", first)
    if layout.reference:
        own = optional(layout.reference)
        # a row a file
        carried = judged.where(whole).groupBy("path").agg(((F.count(own) == F.count("*")) & (F.count_distinct(own) == F.count("*"))).alias("carried"))
        judged = judged.join(carried, "path", "left")
    reason = F.when(F.col("cells").isNull(), "UNDECODABLE").when(F.col("short"), "TRUNCATED_ROW").when(F.col("long"), "EXTRA_FIELDS").when(F.col("row") > F.col("first"), "DUPLICATE_ROW")
    for condition, why in layout.reasons():
        reason = reason.when(condition, why)
    judged = judged.withColumn("reason", reason)
    records = layout.records(judged.where("reason is null"))
    fields = [c for c in records.columns if c not in ("path", "row")]
    prints = F.sha2(F.concat(F.lit(layout.format_id + "\n"), F.to_json(F.struct(*fields))), 256)
    return records.withColumn("fingerprint", prints), judged.where("reason is not null").withColumn("format_id", F.lit(layout.format_id)).select(*QUARANTINE)


def sniff(spark: SparkSession, path: str) -> list[tuple[float, str]]:
    """Every layout's confidence in one file's head, best first; the name of the file is never asked."""
    from tallyframe.sources.statements import is_mt940, is_statement_text

    content = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, HEAD_BYTES)).first()[0]
    text = decode(bytes(content))
    if text is None:
        return []
    body, _ = without_comments(text)
    names = (body.splitlines() or [""])[0].split(",")
    scores = [(x.confidence(names), x.format_id) for x in LAYOUTS] + [(is_mt940(body), "mt940-v1"), (is_statement_text(body), "slice-pdf-v1")]
    return sorted(scores, reverse=True)


#: Bytes up to which a file is one task's work; longer ones are read by ranges.
WHOLE_BYTES = 64_000_000


def read_any_rows(spark: SparkSession, path: str) -> DataFrame:
    """The raw rows of one file: at once, with the file's hash, or by many tasks without it."""
    from tallyframe.sources.lines import read_rows_by_range

    length = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return read_rows(spark, path) if length <= WHOLE_BYTES else read_rows_by_range(spark, path)


def detect(spark: SparkSession, path: str) -> str | None:
    """The layout of a file; None if none is sure enough or the two best are equally so."""
    scores = sniff(spark, path)
    return None if not scores or scores[0][0] < DETECTION or (len(scores) > 1 and scores[0][0] == scores[1][0]) else scores[0][1]


def ingest(spark: SparkSession, path: str) -> tuple[str | None, DataFrame | None, DataFrame]:
    """(format, records, quarantine) of a file; a file that no layout fits is one quarantine row."""
    from tallyframe.sources.statements import parse_mt940, parse_statement_text

    try:
        found = detect(spark, path)
    except Exception as error:  # the file itself can't be read: that is its verdict, whatever the store says
        return None, None, spark.createDataFrame([(path, None, 0, str(error)[:200], "unreadable", "UNREADABLE_FILE")], ", ".join(f"{c} {'int' if c == 'row' else 'string'}" for c in QUARANTINE))
    if found == "mt940-v1":
        return found, *parse_mt940(spark, path)
    if found == "slice-pdf-v1":
        return found, *parse_statement_text(spark, path)
    if found:
        return found, *parse(read_any_rows(spark, path), BY_ID[found])
    return None, None, spark.createDataFrame([(path, None, 0, "", "unreadable", "UNRECOGNISED_FORMAT")], ", ".join(f"{c} {'int' if c == 'row' else 'string'}" for c in QUARANTINE))
