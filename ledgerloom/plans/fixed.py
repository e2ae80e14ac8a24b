"""The vocabularies, codes and thresholds that results depend on."""

from __future__ import annotations

# State codes of tax ids, as the tax law numbers them.
STATE_NAMES = {
    "01": "Jammu and Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand", "06": "Haryana",
    "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim", "12": "Arunachal Pradesh",
    "13": "Nagaland", "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya", "18": "Assam",
    "19": "West Bengal", "20": "Jharkhand", "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat",
    "26": "Dadra and Nagar Haveli and Daman and Diu", "27": "Maharashtra", "28": "Andhra Pradesh", "29": "Karnataka", "30": "Goa",
    "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry", "35": "Andaman and Nicobar Islands",
    "36": "Telangana", "37": "Andhra Pradesh", "38": "Ladakh", "97": "Other Territory", "99": "Centre Jurisdiction",
}
STATE_ALIASES = {
    "j&k": "01", "jammu & kashmir": "01", "nct of delhi": "07", "orissa": "21", "pondicherry": "34", "dnh and dd": "26",
    "dadra & nagar haveli and daman & diu": "26", "a&n islands": "35", "andaman & nicobar islands": "35",
}

# Reverse charge: (id, keywords, only if the supplier is unregistered, to be confirmed by hand), in the order they are tried.
RCM_CATEGORIES = (
    ("gta_freight", ("gta", "goods transport agency", "freight", "transportation charges", "lorry freight", "truck freight"), False, False),
    ("legal_services", ("advocate", "legal fees", "legal services", "law firm", "attorney fees"), False, False),
    ("security_services", ("security services", "security guard", "security personnel"), False, False),
    ("director_fees", ("director fees", "director sitting fees", "director remuneration", "sitting fees"), False, False),
    ("sponsorship", ("sponsorship",), False, False),
    ("rent_unregistered_landlord", ("rent", "rental", "lease rent"), False, True),
    ("metal_scrap", ("metal scrap", "scrap metal", "iron scrap", "steel scrap", "ferrous scrap"), True, False),
)
# Blocked credit: (id, section, keywords), in the order they are tried.
BLOCKED_CATEGORIES = (
    ("motor_vehicles", "17(5)(a)/(ab)", ("motor vehicle", "car purchase", "vehicle insurance", "car insurance", "vehicle repair", "car repair", "vehicle maintenance", "car maintenance")),
    ("food_beverage", "17(5)(b)(i)", ("food", "beverage", "catering", "restaurant bill", "canteen")),
    ("employee_insurance_travel", "17(5)(b)(iii)-(iv)", ("health insurance", "life insurance", "rent a cab", "rent-a-cab", "leave travel", "ltc", "employee travel")),
    ("works_contract_immovable", "17(5)(c)/(d)", ("works contract", "building construction", "civil construction", "construction of building", "capital work in progress", "capitalised construction")),
    ("csr_expenditure", "17(5)(fa)", ("csr", "corporate social responsibility")),
    ("personal_use", "17(5)(g)", ("personal use", "personal consumption")),
    ("composition_scheme_purchase", "17(5)(e)", ()),
)
YES, NO = ("y", "yes", "true", "1"), ("n", "no", "false", "0")

# Tolerances and windows. Amounts are in paise.
TOLERANCE = 100
TIEBREAK_DAYS = 3
IDENTIFIER_DAYS, AMOUNT_DAYS = 45, 3
RATE_POINTS = 0.5
ELSEWHERE = 1
NEAR_FLOOR, NEAR_FACTOR, NEAR_SAMPLE = 5, 3, 4
RATE_SHARE = 0.01
MATERIALITY = 0.01
CONSTANT_SHARE, CONSTANT_SAMPLE = 0.85, 3

# Sheet classes.
SHEET_TYPES = ("bank_statement", "invoice_list", "sales_pos", "payroll")
SHEET_KEYWORDS = {
    "bank_statement": ("balance", "debit", "credit", "statement", "transaction", "withdrawal", "deposit", "sort code", "account"),
    "invoice_list": ("invoice", "vendor", "supplier", "due date", "po number", "purchase order", "bill", "net amount", "vat", "gross amount"),
    "sales_pos": ("sales", "revenue", "pos", "dine-in", "dine in", "takeaway", "delivery", "covers", "gross sales"),
    "payroll": ("wage", "wages", "salary", "salaries", "payroll", "overtime", "ni", "national insurance", "pension", "tronc", "gross pay", "net pay", "paye"),
}
DEBIT_CREDIT = ("debit", "credit", "dr", "cr", "paid in", "paid out", "withdrawal", "deposit", "in", "out", "money in", "money out")
KEYWORD_WEIGHTS = {"bank_statement": 1, "invoice_list": 1, "sales_pos": 1, "payroll": 1.5}
KEYWORD_CAP = 4
DOMINANT, HIGH_NUMERIC, HIGH_TEXT = 0.6, 0.5, 0.85
CATEGORY_COUNT, CATEGORY_RATIO = 12, 0.4
MODERATE_COUNT, MODERATE_LOW, MODERATE_HIGH = 4, 0.05, 0.9
PERIOD_COUNT, PERIOD_RATIO = 15, 0.6
POSITIVE_SHARE, MONOTONIC_SAMPLE, MONOTONIC_SHARE = 0.9, 3, 0.9
LEAST_SCORE, LEAST_MARGIN, HIGH_MARGIN = 3, 2, 4

# Points for what the columns of a sheet show.
SHEET_POINTS = {
    "bank_statement": {"dates": 2, "amounts of both signs": 5, "amounts that rise": 3, "debit and credit": 3},
    "invoice_list": {"dates": 2, "due dates": 1, "positive amounts": 3, "varied text": 2, "unique text": 1, "amounts of both signs": -3},
    "sales_pos": {"periods": 2, "three positive amounts": 3, "periods and categories": 1, "amounts of both signs": -3},
    "payroll": {"periods": 2, "three positive amounts": 2, "amounts of both signs": -3},
}
# Points for the fields that a tax sheet has.
ROLE_POINTS = {
    "gstr2a": {"gstin": 3, "taxable_value": 2, "two tax heads": 3, "invoice_number": 2, "trade_legal_name": 2, "official fields": 2, "books fields": -5},
    "purchase_register": {"dates": 2, "voucher_number": 3, "particulars": 2, "gstin": 3, "taxable_value": 2, "a tax head": 1, "official fields": -4},
}
# Words of column headings by field. A line is one way to name the field: each of its lists must have a term in the heading.
# A term that starts with = is a whole word, any other may be part of one.
HEADING_TERMS = {
    "taxable_value": [[["taxable", "assessable", "txbl", "=tv"]]],
    "igst": [[["=igst", "integrated tax", "integrated gst"]]],
    "cgst": [[["=cgst", "central tax", "central gst"]]],
    "sgst": [[["=sgst", "=ugst"]], [["=state", "=ut", "union territory"], ["=tax", "=gst"]]],
    "rate": [[["=rate"]]],
    "invoice_number": [[["invoice"], ["=no", "=number", "=num"]], [["invoice details"]]],
    "voucher_number": [[["voucher"], ["=no", "=number", "=num"]]],
    "particulars": [[["=particulars", "=narration"]]],
    "trade_legal_name": [[["trade", "legal name", "supplier name", "vendor name"]]],
    "place_of_supply": [[["place of supply"]]],
    "invoice_type": [[["invoice type"]]],
    "filing_period": [[["filing period", "return period", "gstr 1", "gstr 2a"]]],
    "reverse_charge": [[["reverse charge", "=rcm"]]],
}

# Roles of tax sheets.
ROLE_LEAST_SCORE, ROLE_LEAST_MARGIN = 5, 2
GSTIN_SHARE, GSTIN_MARGIN = 0.6, 0.1
SUGGESTION_SIMILARITY = 0.5
COLUMN_DRIFT, TAG_SIMILARITY, HEADER_SIMILARITY = 3, 0.8, 0.5
SHAREABLE_COLUMNS, SHAREABLE_TAGS = 4, 2

REVIEW_STATUSES = ("", "Confirmed OK — no action needed", "Needs follow-up", "Resolved elsewhere", "Disputed — see note")
REPORT_TABLES = (
    "summary", "extra_in_books", "extra_in_2a", "possible_matches", "mismatch", "wrong_head", "rcm", "ineligible_itc", "duplicates", "rate_mismatch",
)
