"""The written report is the whole one."""

from conftest import SMALL

from sitefit.catalog import load


def test_report_holds_all_its_parts(spark):
    rows = load()[0]["write_report"](spark, SMALL).collect()
    parts = {r.part for r in rows}
    assert {"item", "source", "row", "total"} <= parts
    items, total = [r for r in rows if r.part == "item"], {r.key: r.checks for r in rows if r.part == "total"}
    assert total == {"total_items": len(items), "compliant_items": sum(r.compliant for r in items), "violations": sum(not r.compliant for r in items)}
    assert sum(r.checks for r in rows if r.part == "source") == sum(r.checks for r in items) > 0
