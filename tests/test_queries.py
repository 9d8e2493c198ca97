import pytest

import __spark_entry__ as entry
from tallyframe.plans import queries as library

FAST = [n for n in library.ORACLE_SQL if n in {
    "canonical_orders", "canonical_psp", "canonical_bank", "narration_signals", "duplicate_suppression", "settlement_totals", "fee_diagnosis", "dangling_refs", "order_sets", "line_references", "band_join_candidates",
    "match_groups", "undecided_lines", "bank_line_exceptions", "psp_exceptions", "partition_check", "itc_periods", "scorecard", "hypothesis_verdicts", "running_balance", "parse_paise", "drift_reasons",
    "previous_run", "latest_run", "layout_records", "layout_quarantine", "event_windows",
    "analyst_verdicts", "analyst_residue", "leg_lists", "upload_union", "run_digest", "canonical_file", "physical_rows", "printed_statement", "exception_subjects", "run_history", "assisted_rates",
}]


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_sql(spark, sf_dir, same, name):
    same(library.QUERIES[name](spark, sf_dir), library.ORACLE_SQL[name])


def test_contract(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
