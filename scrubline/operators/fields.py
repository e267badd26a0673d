"""Domain field cleaning: one native Column expression per field, one select per table.

Fields are described by a few builders (keep-list, number, ladder of phrases,
last-four mask); empty text and null give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import action, col, with_exprs
from ..functions.dates import parse_dates, parse_epoch
from ..functions.numbers import to_number
from ..functions.text import contains_any, strip, title

Field = Callable[[Column], Column]


def _filled(make: Field) -> Field:
    """Apply to stripped text; blank text becomes null."""
    return lambda c: F.when(strip(c) != "", make(strip(c)))


def code(drop: str = r"[^A-Z0-9-]") -> Field:
    return _filled(lambda s: F.regexp_replace(F.upper(s), drop, ""))


def number(drop: str = r"[$, ]") -> Field:
    return lambda c: to_number(F.regexp_replace(strip(c), drop, ""))


def whole(c: Column) -> Column:
    """Integer part, cut towards zero."""
    value = to_number(strip(c))
    return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("long")


def last_four(mask: str) -> Field:
    def make(c):
        s = strip(c)
        digits = F.regexp_replace(s, r"\D", "")
        return F.when(F.length(digits) >= 4, F.concat(F.lit(mask), F.right(digits, F.lit(4)))).otherwise(s)
    return make


def digits_of(*lengths: int) -> Field:
    """Bare digits when their number fits, else the text as it is."""
    def make(c):
        s = strip(c)
        digits = F.regexp_replace(s, r"\D", "")
        return F.when(F.length(digits).isin(list(lengths)), digits).otherwise(s)
    return make


def ladder(rules: list[tuple[str, list[str]]], rest: Field = title) -> Field:
    """First rule with a phrase inside the lower-cased text gives the label."""
    def make(s):
        low = F.lower(s)
        chain = None
        for label, phrases in rules:
            test = contains_any(low, phrases)
            chain = F.when(test, label) if chain is None else chain.when(test, label)
        return chain.otherwise(rest(low))
    return _filled(make)


def lookup(table: dict[str, str], rest: Field) -> Field:
    def make(s):
        key = F.upper(s)
        found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.coalesce(F.try_element_at(found, key), rest(key))
    return _filled(make)


def scaled(drop: str, rescale: Field, low: float, high: float) -> Field:
    """Number, rescaled, limited to [low, high]."""
    def make(c):
        value = rescale(to_number(F.regexp_replace(strip(c), drop, "")))
        return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))
    return make


def _percent(v: Column) -> Column:
    return F.when(v > 1, v / 100).otherwise(v) * 100


def _units(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9.]", "")


def _blood(s):
    up = F.upper(s)
    # the two-letter group before its parts: "AB+" contains "B+"
    group = F.regexp_extract(up, r"(AB[+-]|A[+-]|B[+-]|O[+-])", 1)
    return F.when(group != "", group).otherwise(up)


def _ssn(s):
    return F.when(s.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.concat(F.lit("***-**-"), F.right(s, F.lit(4)))).otherwise(s)


def _dob(c):
    stamp = parse_dates(c, False)
    return F.when(F.year(stamp).between(1900, 2025), F.date_format(stamp, "yyyy-MM-dd")).otherwise(c)


def _iban(c):
    s = F.replace(F.upper(strip(c)), F.lit(" "))
    grouped = F.trim(F.regexp_replace(s, r"(.{4})", "$1 "))
    return F.when(s.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{4,30}$"), grouped).otherwise(s)


def _stars(c):
    v = to_number(F.regexp_replace(strip(c), r" stars|star", ""))
    return F.when(v.between(0, 5), v).when(v > 5, v / 20)


def _kilograms(c):
    s = F.lower(strip(c))
    value = to_number(_units(s))
    return F.when(contains_any(s, ["lb", "pound"]), value * 0.453592).otherwise(value)


def _pounds(c):
    s = F.lower(strip(c))
    value = to_number(_units(s))
    return (
        F.when(contains_any(s, ["kg", "kilogram"]), value * 2.20462)
        .when(F.contains(s, F.lit("stone")), value * 14).otherwise(value)
    )


def _inches(c):
    s = F.lower(strip(c))
    pattern = r"(\d+)\s*(?:['\"]|ft)?\s*(\d+)?"
    feet = F.regexp_extract(s, pattern, 1).try_cast("double")
    extra = F.coalesce(F.regexp_extract(s, pattern, 2).try_cast("double"), F.lit(0.0))
    return (
        F.when(contains_any(s, ["'", '"', "ft"]), feet * 12 + extra)
        .when(contains_any(s, ["cm", "centimeter"]), to_number(_units(s)) / 2.54)
        .otherwise(to_number(s))
    )


def _square_feet(c):
    s = F.regexp_replace(F.lower(strip(c)), "[, ]", "")
    value = F.regexp_extract(s, r"[\d.]+", 0).try_cast("double")
    return F.when(contains_any(s, ["sqm", "m2", "meter"]), value * 10.764).otherwise(value)


def _bedrooms(c):
    s = F.lower(strip(c))
    count = F.regexp_replace(s, r"[^0-9]", "").try_cast("long")
    return F.when(F.contains(s, F.lit("studio")) | F.contains(s, F.lit("0")), F.lit(0).cast("long")).otherwise(count)


def _mac(c):
    hexes = F.regexp_replace(F.upper(strip(c)), "[^0-9A-F]", "")
    pairs = F.regexp_replace(hexes, "(..)(?=.)", "$1:")
    return F.when(strip(c) != "", F.when(F.length(hexes) == 12, pairs).otherwise(c))


def _zip(c):
    s = strip(c)
    d = F.regexp_replace(s, r"\D", "")
    plus4 = F.concat(F.left(d, F.lit(5)), F.lit("-"), F.substr(d, F.lit(6)))
    return F.when(F.length(d) == 5, d).when(F.length(d) == 9, plus4).otherwise(s)


def _survey_rating(c):
    s = F.lower(strip(c))
    value = whole(c)
    opinion = (
        F.when(contains_any(s, ["strongly disagree", "very unsatisfied"]), 1)
        .when(contains_any(s, ["disagree", "unsatisfied"]), 2)
        .when(contains_any(s, ["strongly agree", "excellent", "very satisfied"]), 5)
        .when(contains_any(s, ["agree", "satisfied"]), 4)
        .when(contains_any(s, ["neutral", "neither"]), 3)
    )
    return F.when(value >= 0, F.least(value, F.lit(10))).otherwise(opinion).cast("long")


def _within(low: int, high: int) -> Field:
    def make(c):
        value = whole(c)
        return F.when(value.between(low, high), value)
    return make


def _jersey(c):
    value = whole(c)
    return F.when(value.between(0, 99), value).otherwise(F.pmod(value, F.lit(100)))


def _yes_no(s):
    low = F.lower(s)
    return (
        F.when(low.isin("yes", "y", "true", "1", "si", "yeah", "aye"), "Yes")
        .when(low.isin("no", "n", "false", "0", "nah", "nope"), "No").otherwise(title(low))
    )


def _money_symbols(c):
    return to_number(F.regexp_replace(strip(c), "[$€£¥₹₽₿,]", ""))


_id = code()
_money = number()

# --- fixed values: labels and the phrases that select them --------------------
DEPARTMENTS = [
    ("Human Resources", ["hr"]), ("Information Technology", ["it"]), ("Sales", ["sales"]),
    ("Marketing", ["marketing"]), ("Finance", ["finance"]), ("Operations", ["ops", "operations"]),
]
PERFORMANCE = [
    ("Exceeds Expectations", ["exceed", "exceeds", "exceptional", "5", "outstanding"]),
    ("Meets Expectations", ["meets", "satisfactory", "3", "4", "good"]),
    ("Needs Improvement", ["below", "needs", "improvement", "1", "2", "poor"]),
]
SHIPPING = [
    ("Delivered", ["delivered", "complete", "completed"]),
    ("In Transit", ["transit", "shipped", "in transit", "on the way"]),
    ("Pending", ["pending", "processing", "waiting"]), ("Cancelled", ["cancel", "cancelled"]),
]
TRANSACTIONS = [
    ("credit", ["credit", "deposit"]), ("debit", ["debit", "withdraw", "payment"]), ("transfer", ["transfer"]),
]
STOCK = [
    ("Out of Stock", ["out of stock", "outofstock", "oos", "unavailable"]),
    ("In Stock", ["in stock", "available", "instock"]),
    ("Low Stock", ["low stock", "low", "limited"]), ("Discontinued", ["discontinued", "end of life"]),
]
PROPERTY = [
    ("Townhouse", ["townhouse", "town house"]), ("Single Family", ["single family", "single-family", "house"]),
    ("Condo", ["condo", "condominium"]), ("Multi-Family", ["multi family", "multi-family", "duplex"]),
    ("Land", ["land", "lot", "acreage"]), ("Commercial", ["commercial"]),
]
SATISFACTION = [
    ("Very Unsatisfied", ["very unsatisfied", "very unhappy", "terrible"]),
    ("Unsatisfied", ["unsatisfied", "dissatisfied", "unhappy"]),
    ("Very Satisfied", ["very satisfied", "extremely happy", "delighted"]),
    ("Satisfied", ["satisfied", "happy", "pleased"]), ("Neutral", ["neutral", "neither"]),
]
LEAD_SOURCES = [
    ("Organic Search", ["google", "search", "organic"]), ("Social Media", ["facebook", "fb", "social"]),
    ("LinkedIn", ["linkedin"]), ("Referral", ["referral", "referred"]),
    ("Email Campaign", ["email", "newsletter"]), ("Direct", ["direct", "walk-in", "walkin"]),
    ("Trade Show", ["trade", "展会"]),
]
STAGES = [
    ("Closed Won", ["won", "closed won", "success"]), ("Closed Lost", ["lost", "closed lost", "failed"]),
    ("Negotiation", ["negotiation", "negotiating"]), ("Proposal", ["proposal", "quote"]),
    ("Qualified", ["qualified", "meeting"]), ("Lead", ["lead", "prospect"]),
]
INDUSTRIES = [
    ("Technology", ["tech", "technology", "software"]), ("Healthcare", ["healthcare", "health"]),
    ("Finance", ["finance", "financial", "banking"]), ("Retail", ["retail"]), ("E-commerce", ["ecommerce"]),
    ("Manufacturing", ["manufacturing"]), ("Education", ["education"]),
    ("Real Estate", ["real estate", "realestate"]),
]
GRADES = {
    "A+": "A", "A": "A", "A-": "A", "B+": "B", "B": "B", "B-": "B", "C+": "C", "C": "C", "C-": "C",
    "D+": "D", "D": "D", "D-": "D", "F": "F", "FAIL": "F", "PASS": "P",
}
MAJORS = [
    ("Computer Science", ["cs", "comp sci", "csci"]), ("Electrical Engineering", ["ee"]),
    ("Mechanical Engineering", ["mech eng"]), ("Marketing", ["mkt"]), ("Biology", ["bio"]),
    ("Political Science", ["poli sci"]), ("Psychology", ["psych"]),
]
ENROLLMENT = [
    ("Inactive", ["inactive"]),
    ("Active", ["active", "enrolled", "current", "full-time", "fulltime"]),
    ("Graduated", ["graduated", "complete", "graduation"]),
    ("Withdrawn", ["withdrawn", "dropped", "left", "quit"]),
    ("Suspended", ["suspended", "expelled", "dismissed"]), ("On Leave", ["on hold", "sabbatical", "leave"]),
]
PAYMENTS = [
    ("Cash", ["cash", "bill"]), ("Debit Card", ["debit"]), ("Credit Card", ["credit", "card"]),
    ("Mobile Payment", ["mobile", "apple pay", "google pay"]),
]
POSITIONS = {
    "PG": "Point Guard", "SG": "Shooting Guard", "SF": "Small Forward", "PF": "Power Forward",
    "C": "Center", "G": "Guard", "F": "Forward", "QB": "Quarterback", "RB": "Running Back",
    "WR": "Wide Receiver", "TE": "Tight End", "OL": "Offensive Line", "DL": "Defensive Line",
    "LB": "Linebacker", "CB": "Cornerback", "S": "Safety", "GK": "Goalkeeper", "DF": "Defender",
    "MF": "Midfielder", "FW": "Forward", "ST": "Striker", "LW": "Left Wing", "RW": "Right Wing",
}
# --- end of fixed values -----------------------------------------------------

_area = _square_feet
_address = _filled(lambda s: title(F.regexp_replace(s, r"\s+", " ")))
_rating_5 = scaled("", lambda v: F.when(v > 5, v / 20).otherwise(v), 0, 5)
_gpa = scaled("", lambda v: F.when(v > 10, v / 25).otherwise(v), 0, 4)
_share = scaled(r"[% ]", _percent, 0, 100)

DOMAINS: dict[str, dict[str, Field]] = {
    "healthcare": {
        "icd_code": _filled(F.upper),
        "ssn": _filled(_ssn),
        "npi": digits_of(10),
        "medication": _filled(lambda s: title(F.regexp_replace(s, r"\s+", " "))),
        "blood_group": _filled(_blood),
        "dob": _dob,
    },
    "financial": {
        "amount": _money, "balance": _money, "price": _money_symbols, "cost": _money_symbols,
        "account_no": last_four("****"), "iban": _iban, "card_number": last_four("****-****-****-"),
        "txn_type": ladder(TRANSACTIONS),
    },
    "ecommerce": {
        "sku": _id,
        "product_name": _filled(lambda s: title(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"[^a-zA-Z0-9\s\-&]", ""))),
        "category": _filled(lambda s: title(F.regexp_replace(F.lower(s), r"[^a-z0-9\s]", ""))),
        "rating": _stars,
    },
    "hr": {
        "emp_id": _id, "department": ladder(DEPARTMENTS), "salary": _money, "performance": ladder(PERFORMANCE),
    },
    "logistics": {
        "tracking_number": code("[^A-Z0-9]"), "weight": _kilograms,
        "dimensions": _filled(lambda s: F.regexp_replace(s, r"\s*x\s*", " x ")), "status": ladder(SHIPPING),
    },
    "inventory": {
        "sku": _id, "upc": digits_of(12, 13, 14), "quantity": whole, "unit_price": _money,
        "stock_status": ladder(STOCK),
        "location": _filled(lambda s: F.trim(F.regexp_replace(F.upper(s), "[^A-Z0-9]+", "-"), F.lit("-"))),
    },
    "iot": {
        "sensor_value": number("[, ]"), "reading": number("[, ]"), "mac_address": _mac,
        "ip_address": _filled(lambda s: s), "ip": _filled(lambda s: s), "timestamp": parse_epoch,
        "device_id": code("[^A-Z0-9]"), "battery_level": _share,
    },
    "realestate": {
        "property_address": _address, "address": _address, "price": _money, "amount": _money,
        "area": _area, "sqft": _area, "bedrooms": _bedrooms, "beds": _bedrooms,
        "bathrooms": lambda c: to_number(F.replace(strip(c), F.lit("½"), F.lit(".5"))),
        "baths": lambda c: to_number(F.replace(strip(c), F.lit("½"), F.lit(".5"))),
        "property_type": ladder(PROPERTY), "type": ladder(PROPERTY), "zip_code": _zip, "zipcode": _zip,
    },
    "survey": {
        "rating": _survey_rating, "nps_score": _within(-100, 100), "nps": _within(-100, 100),
        "yes_no": _filled(_yes_no), "satisfaction": ladder(SATISFACTION),
    },
    "customer": {
        "lead_source": ladder(LEAD_SOURCES), "source": ladder(LEAD_SOURCES), "deal_value": _money,
        "value": _money, "stage": ladder(STAGES), "status": ladder(STAGES), "industry": ladder(INDUSTRIES),
    },
    "student": {
        "student_id": _id, "id": _id, "gpa": _gpa, "grade": lookup(GRADES, lambda k: k), "attendance": _share,
        "major": ladder(MAJORS), "enrollment_status": ladder(ENROLLMENT),
    },
    "education": {
        "student_id": _id, "gpa": _gpa, "grade": lookup(GRADES, lambda k: k), "attendance": _share,
    },
    "manufacturing": {
        "production_id": _id, "batch_number": _id,
        "defect_rate": scaled("%", lambda v: F.when(v <= 1, v * 100).otherwise(v), 0, 100),
        "quality_score": scaled("%", lambda v: F.when(v > 10, v / 10).otherwise(v), 0, 100),
        "machine_id": code("[^A-Z0-9]"),
    },
    "restaurant": {
        "order_id": _id, "order": _id, "rating": _rating_5, "tip": number("[$,]"), "total_bill": _money,
        "payment_type": ladder(PAYMENTS),
    },
    "sports": {
        "player_id": _id, "id": _id, "jersey_number": _jersey, "score": whole, "height": _inches,
        "weight": _pounds, "position": lookup(POSITIONS, lambda k: k),
    },
}


def domain_fields(domain: str) -> dict[str, Field]:
    key = domain.lower()
    if key in DOMAINS:
        return DOMAINS[key]
    for name, table in DOMAINS.items():
        if name in key or key in name:
            return table
    return {}


@action("domain_clean", row_wise=True)
def domain_clean(df: DataFrame, domain: str) -> DataFrame:
    """Clean every known field of the domain in one projection."""
    table = domain_fields(domain)
    return with_exprs(df, {n: make(col(n).cast("string")) for n, make in table.items() if n in df.columns})
