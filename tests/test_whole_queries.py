"""Queries over all rows of their operator, beside those whose SQL says a part of them."""

from collections import Counter

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def rows_of(spark, name):
    return QUERIES[name](spark, SF_DIR).collect()


def test_changed_alerts_have_texts(spark):
    level = {(r["run_id"], r["monitor_id"]): r["alert_level"] for r in rows_of(spark, "alert_severity")}
    rows = rows_of(spark, "all_alert_texts")
    changed = [r for r in rows if level[r["run_id"], r["monitor_id"]] == "changed"]
    assert {(r["run_id"], r["monitor_id"]) for r in rows} == set(level) and changed
    assert all(r["quiet_summary"] for r in changed)
    assert Counter(rows) - Counter(changed) == Counter(rows_of(spark, "alert_texts"))


def test_existing_profiles_are_merged(spark):
    from pagetide.plans import views as V

    def added(rows):
        return sum(r["llm_success_count"] + r["rule_success_count"] for r in rows)

    merged, learned = rows_of(spark, "merged_profiles"), rows_of(spark, "learned_profiles")
    existing = V.profiles(spark, SF_DIR).collect()
    assert added(learned) and added(merged) == added(existing) + added(learned)
    assert len(existing) <= len(merged) < len(existing) + len(learned)


def test_product_rows_have_all_fields(spark):
    for name, part, field in (("all_product_hint_rows", "product_hint_rows", "price"), ("all_product_evidence", "product_evidence", "brand")):
        rows = rows_of(spark, name)
        assert len({r["field"] for r in rows}) > 1
        assert Counter(r for r in rows if r["field"] == field) == Counter(rows_of(spark, part))
