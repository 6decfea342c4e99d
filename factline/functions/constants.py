"""Figures, codes, labels and citations the rules are defined by."""

# Salary matching.
ALLOWANCE = 250_000
EXPANDED_BASE_AMOUNT = 7_500_000
STANDARD_FACTOR = 1.00
TRANSITION_FACTOR = 1.10
EXPANDED_FACTOR = 1.25
EXPANDED_DOUBLE = 2.00

# Trade shape.
AGGREGATION_BAR_DAYS = 60

# Roster.
STANDARD_MAX = 15
STANDARD_MIN = 14
TWO_WAY_MAX = 3

# Maximum salary.
MAX_UNDER_7 = 0.25
MAX_7_TO_9 = 0.30
MAX_10_PLUS = 0.35
HIGHER_FIFTH_YEAR = 0.30
HIGHER_DESIGNATED_VETERAN = 0.35
PRIOR_SALARY_MULTIPLIER = 1.05
ARENAS_FOURTH_YEAR_MOVEMENT = 0.045
CAP_GROWTH_ASSUMPTION = 1.045

# Trade eligibility.
ROOKIE_DAYS = 30
BAR_MONTHS = 3
RE_SIGNED_RAISE = 1.20

# Restriction rows: row, level, phrase completing "may not ...".
RESTRICTION_ROWS = [
    ("A", "first_apron", "sign or acquire a player using the Bi-annual Exception"),
    ("B", "first_apron", "sign or acquire a player using the Non-Taxpayer Mid-Level Exception"),
    (
        "C",
        "first_apron",
        "acquire a player on a contract signed under Art. VII 8(e)(1), i.e. take in a "
        "sign-and-trade",
    ),
    (
        "D",
        "first_apron",
        "sign a player waived during the Season whose pre-waiver salary exceeded the "
        "Non-Taxpayer Mid-Level",
    ),
    ("E", "first_apron", "acquire a player using an Expanded Traded Player Exception"),
    (
        "F",
        "first_apron",
        "use a Standard Traded Player Exception created in a prior Salary Cap Year",
    ),
    ("G", "first_apron", "acquire a player using a Transition Traded Player Exception"),
    (
        "H",
        "second_apron",
        "acquire a player using an exception created by aggregating two or more contracts",
    ),
    ("I", "second_apron", "send cash to another team in a trade"),
    (
        "J",
        "second_apron",
        "use a Traded Player Exception created by a signed-and-traded contract",
    ),
    ("K", "second_apron", "sign a player using the Taxpayer Mid-Level Exception"),
]

# Exception kind -> restriction row that using it triggers.
TRIGGERED_ROW = {"expanded": "E", "transition": "G", "aggregated": "H"}

# Violation code -> article, section, page, title.
CITATIONS = {
    "salary_matching_exceeded": ("VII", "6(j)(1)(i)", 264, "Standard Traded Player Exception"),
    "no_exception_available": ("VII", "6(j)(1)(iv)", 265, "Expanded Traded Player Exception"),
    "hard_cap_ceiling_exceeded": (
        "VII",
        "2(e)(2)(i)(B)",
        211,
        "A team engaging in a listed transaction may not exceed the applicable apron level "
        "for the remainder of the Salary Cap Year",
    ),
    "aggregation_two_month_bar": (
        "VII",
        "6(j)(4)(i)",
        266,
        "A contract acquired via an Exception may not be aggregated for two months",
    ),
    "player_trade_restricted": ("VII", "8", 284, "Trade Rules"),
    "roster_maximum_exceeded": ("VII", "8", 284, "Trade Rules"),
    "apron_transaction_barred": (
        "VII",
        "2(e)(2)(i)(A)",
        211,
        "A Team may not engage in a transaction set forth in the Transaction Restrictions "
        "Table if, immediately following such transaction, the Team's Apron Team Salary "
        "would exceed the Applicable Apron Level",
    ),
}

# Hold label -> rights class.
BIRD_RIGHTS = {
    "Bird": "Bird",
    "Restricted Bird": "Bird",
    "Early Bird": "Early Bird",
    "Non-Bird": "Non-Bird",
    "Restricted Non-Bird": "Non-Bird",
}
