"""Steps of the domains: always planned, planned by column, and run."""

import pytest

from scrubline.core import ACTIONS
from scrubline.plans import programs, strategies


def steps(columns, texts, domain, **found):
    return [(s["action"], s["params"].get("column") or s["params"].get("columns")) for s in strategies.domain_steps(columns, texts, domain, found)]


def test_every_domain_names_known_actions():
    assert set(strategies.BASE) == set(strategies.CONDITIONAL) and len(strategies.BASE) == 10
    for domain in strategies.BASE:
        for target, action, _ in strategies.BASE[domain] + strategies.CONDITIONAL[domain]:
            assert action in ACTIONS and (target in strategies.CONDITIONS or target in ("table", "texts", "names", "dates", "currency", "numbers"))


@pytest.mark.parametrize("name,condition,want", [
    ("customer_age", "age", True), ("page", "age", False), ("mileage", "age", False), ("qty", "quantity", True), ("orderQty", "quantity", True),
    ("account", "quantity", False), ("l_quantity", "quantity", True), ("office", "discount", False), ("expires_at", "expiry", True), ("invalid", "expiry", False),
    ("zip", "postal_code", True), ("unzipped", "postal_code", False), ("DOB", "birth_date", True)])
def test_conditions_go_by_words(name, condition, want):
    assert strategies.fits(name, condition) is want


def test_base_and_conditional_steps():
    got = steps(["order_id", "price", "qty", "discount", "day"], ["price", "day"], "sales", currency=["price"], dates=["day"])
    assert got == [("remove_duplicates", None), ("standardise_mixed_dates", "day"), ("parse_currency", "price"), ("fill_missing", "qty"), ("clip_outliers", "discount")]
    got = steps(["full_name", "email", "phone", "zip", "age", "gender"], ["full_name", "email", "phone", "zip", "gender"], "customer")
    assert got[1:] == [("trim_whitespace", ["full_name", "email", "phone", "zip", "gender"]), ("standardise_capitalisation", ["full_name"]), ("flag_invalid_emails", "email"),
                       ("normalize_phone", "phone"), ("validate_postal_code", "zip"), ("clip_outliers", "age"), ("normalise_categories", ["gender"])]
    assert steps(["dob", "pulse"], ["dob"], "healthcare")[1:] == [("age_from_date", "dob"), ("clip_outliers", "dob_age"), ("clip_outliers", "pulse")]
    assert steps(["phone"], [], "logistics") == [("remove_duplicates", None)]  # a number is no text
    assert steps(["x"], [], "no such domain") == [("remove_duplicates", None)]


def test_a_table_of_people_is_cleaned(spark):
    rows = [(i, f" ann{i} LEE ", "Sales" if i % 2 else "SALES", None if i % 7 == 0 else 1000.0 + i, "19%02d-03-04" % (50 + i % 40)) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "employee_id int, employee_name string, department string, salary double, birth_date string")
    plan = programs.plan_smart_clean(df)
    assert plan[0]["domain"] == "hr" and [s for s in plan if s["action"] == "fill_missing"]
    out = programs.smart_auto_clean(df)
    assert not out["errors"]
    got = out["df"].collect()
    assert {r.department for r in got} == {"Sales"} and {r.employee_name for r in got} == {f"Ann{i} Lee" for i in range(60)}
    assert len(got) == 60 and all(r.salary is not None and 25 <= r.birth_date_age <= 90 for r in got)
    assert out["applied"][0]["rows_before"] == 65 and out["applied"][0]["rows_after"] == 60
