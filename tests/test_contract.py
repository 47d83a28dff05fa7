"""The driver contract, and queries against their SQL."""

import os

import pytest

import __spark_entry__ as contract
from tests.conftest import FOLDER
from tests.oracle import compare, connect
from vicinage.plans.checks import all_checks

CHECKS = all_checks()
# One or more of each kind; ALL_CHECKS=1 runs every query (python -m tests.oracle does so with timings).
SOME = ["p05_filter_listings", "p18_within_radius", "o01_relevance_order", "w01_dedupe_places", "w06_freshest_entries",
        "a01_overview", "a18_co_located", "u03_union_for_audit", "f05_unescape_html", "f12_read_dates", "f28_open_state",
        "j03_canonical_towns", "j04_towns_in_text", "j06_nearest_commune", "j07_assign_region", "j08_radius_join",
        "j18_resolve_locations", "j17_score_all", "w05_for_you", "w04_collapse_similar", "s02_open_data_json", "s03_ical",
        "s04_json_ld", "s09_event_links", "s16_upsert", "s17_apply_patches", "q07_clean_texts", "q13_build_listings",
        "q14_site_evidence", "t01_dedupe_pings", "t04_grant_stream", "t04_stored_ends", "t06_late_rows", "g01_simplify", "g02_chain_ways", "q11_route_geometry", "s20_refresh_curated"]


def test_entry_gives_rows(spark):
    rows = contract.entry(spark).collect()
    assert 0 < len(rows) <= 20 and "distance_km" not in rows[0].asDict()


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(CHECKS) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(CHECKS) if os.environ.get("ALL_CHECKS") else SOME)
def test_query_equals_its_sql(spark, name):
    con = connect(FOLDER)
    ok, note, _ = compare(spark, con, FOLDER, CHECKS[name])
    assert ok, note
