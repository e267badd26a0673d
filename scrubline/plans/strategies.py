"""Cleaning steps that a domain adds to those of the profile: some always, some if the table has certain columns."""

from __future__ import annotations

from ..core import name_words

# --- fixed values: words that tell a kind of column, and the steps of each domain -----------
CONDITIONS = {
    "quantity": ["qty", "quantity", "count"], "discount": ["discount", "off"], "phone": ["phone", "tel", "mobile"],
    "postal_code": ["postal", "zip"], "age": ["age"], "gender": ["gender", "sex"], "email": ["email"], "balance": ["balance"],
    "negative": ["debit", "expense", "cost"], "expiry": ["expire", "expiry", "expiration", "valid"], "sku": ["sku"],
    "salary": ["salary", "compensation", "pay"], "birth_date": ["birth", "dob"], "conversion": ["conversion"],
    "tracking": ["tracking", "awb", "bol"], "distance": ["distance", "miles", "km"], "vitals": ["vital", "bp", "pulse"],
    "rating": ["rating", "review", "stars"], "status": ["status"],
}
ZERO, TITLE, IQR, CENTS = {"strategy": "zero"}, {"strategy": "title"}, {"method": "iqr"}, {"decimals": 2}
#: domain -> steps (columns they go to, action, parameters); the columns are "table" for the
#: whole table, "texts", "names", "dates", "currency" or "numbers" as the profile found them, or a condition's
BASE = {
    "sales": [("table", "remove_duplicates", {}), ("dates", "standardise_mixed_dates", {}), ("currency", "parse_currency", {}),
              ("numbers", "parse_number_formatted", {})],
    "customer": [("table", "remove_duplicates", {}), ("texts", "trim_whitespace", {}), ("names", "standardise_capitalisation", TITLE),
                 ("email", "flag_invalid_emails", {})],
    "financial": [("table", "remove_duplicates", {}), ("dates", "standardise_mixed_dates", {}), ("currency", "parse_currency", {}),
                  ("table", "round_numeric", CENTS)],
    "inventory": [("table", "remove_duplicates", {}), ("table", "fill_missing", ZERO), ("numbers", "parse_number_formatted", {})],
    "hr": [("table", "remove_duplicates", {}), ("dates", "standardise_mixed_dates", {}), ("names", "standardise_capitalisation", TITLE),
           ("texts", "normalise_categories", {})],
    "marketing": [("table", "remove_duplicates", {}), ("dates", "standardise_mixed_dates", {}), ("numbers", "parse_number_formatted", {}),
                  ("table", "fill_missing", ZERO)],
    "logistics": [("table", "remove_duplicates", {}), ("dates", "standardise_mixed_dates", {}), ("texts", "normalise_categories", {}),
                  ("phone", "validate_phone", {})],
    "healthcare": [("table", "remove_duplicates", {}), ("dates", "standardise_mixed_dates", {}), ("names", "standardise_capitalisation", TITLE)],
    "ecommerce": [("table", "remove_duplicates", {}), ("dates", "standardise_mixed_dates", {}), ("currency", "parse_currency", {}),
                  ("table", "fill_missing", ZERO)],
    "general": [("table", "remove_duplicates", {}), ("texts", "trim_whitespace", {}), ("texts", "normalise_categories", {})],
}
CONDITIONAL = {
    "sales": [("quantity", "fill_missing", ZERO), ("discount", "clip_outliers", {"method": "iqr", "iqr_factor": 2.0})],
    "customer": [("phone", "normalize_phone", {}), ("postal_code", "validate_postal_code", {}), ("age", "clip_outliers", IQR),
                 ("gender", "normalise_categories", {})],
    "financial": [("balance", "fill_missing", ZERO), ("negative", "validate_range", {"min_val": 0})],
    "inventory": [("expiry", "standardise_mixed_dates", {}), ("expiry", "flag_future_dates", {}), ("sku", "normalise_categories", {})],
    "hr": [("salary", "fill_missing", {"strategy": "median"}), ("salary", "clip_outliers", IQR), ("birth_date", "age_from_date", {}),
           ("birth_date", "clip_outliers", IQR)],
    "marketing": [("conversion", "validate_range", {"min_val": 0, "max_val": 100})],
    "logistics": [("tracking", "trim_whitespace", {}), ("distance", "round_numeric", CENTS)],
    "healthcare": [("birth_date", "age_from_date", {}), ("birth_date", "clip_outliers", IQR),
                   ("vitals", "clip_outliers", {"method": "iqr", "iqr_factor": 3.0})],
    "ecommerce": [("rating", "validate_range", {"min_val": 1, "max_val": 5}), ("status", "normalise_categories", {})],
    "general": [("dates", "standardise_mixed_dates", {}), ("currency", "parse_currency", {})],
}
#: actions that take several columns at once
MANY = ["trim_whitespace", "standardise_capitalisation", "normalise_categories"]
#: actions for text, which other columns must not reach
TEXT_ONLY = [*MANY, "normalize_phone", "flag_invalid_emails", "validate_phone", "validate_postal_code", "standardise_mixed_dates"]
# --- end of fixed values -----------------------------------------------------------------------

#: words up to this length count only as whole words of a name: "age" is not in "page"
WHOLE_UP_TO = 5


def fits(name: str, condition: str) -> bool:
    """Whether a column's name tells a condition's kind; long words may be parts of a word."""
    whole = set(name_words(name)) | set(name_words(name, by_case=True))
    return any(w in whole if len(w) <= WHOLE_UP_TO else w in name.lower() for w in CONDITIONS[condition])


def domain_steps(columns: list[str], texts: list[str], domain: str, found: dict[str, list[str]]) -> list[dict]:
    """Base steps of a domain, then those whose columns the table has.

    ``found`` has the columns that the profile told to be "dates", "currency" or
    "numbers".  An age is made of a birth date first, and its outliers are those of the
    new column.  Unknown domains get the general steps.  Texts that
    the profile found to be numbers or money are no texts here.
    """
    read = set(found.get("currency", [])) | set(found.get("numbers", []))
    plain = [t for t in texts if t not in read]
    steps = []
    for target, action, params in BASE.get(domain, BASE["general"]) + CONDITIONAL.get(domain, CONDITIONAL["general"]):
        if target == "table":
            steps.append({"action": action, "params": dict(params)})
            continue
        if target == "texts":
            names = [c for c in plain if not any(w in c.lower() for w in ("email", "url", "id", "code"))] if action == "normalise_categories" else plain
        elif target == "names":
            names = [c for c in plain if "name" in name_words(c) + name_words(c, by_case=True)]
        elif target in CONDITIONS:
            names = [c for c in columns if fits(c, target) and (c in plain or action not in TEXT_ONLY)]
        else:
            names = found.get(target, [])
        if action in MANY:
            steps += [{"action": action, "params": {"columns": names} | params}] if names else []
        elif action in ("parse_currency", "parse_number_formatted"):
            steps += [{"action": action, "params": {"column": c, "new_col": c} | params} for c in names]
        elif target == "birth_date" and action == "clip_outliers":
            steps += [{"action": action, "params": {"column": f"{c}_age"} | params} for c in names]
        else:
            steps += [{"action": action, "params": {"column": c} | params} for c in names]
    return steps
