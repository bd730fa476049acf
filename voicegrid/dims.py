"""Dictionaries used by the annotation and scoring operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Word lists, labels and thresholds that results depend on.
# ---------------------------------------------------------------------------

TOPIC_TERMS = {
    "billing_pricing": ["bill", "billing", "payment", "pay", "paid", "charge", "charged", "overcharge",
                        "overcharged", "refund", "credit", "debit", "dd", "tariff", "price", "cost",
                        "expensive", "cheap", "rate", "amount", "statement"],
    "service": ["customer service", "support", "agent", "staff", "call centre", "helpline", "complaint",
                "phone", "call", "called", "email", "chat", "contact", "query", "issue", "problem",
                "resolve", "helpful", "rude", "waiting", "response"],
    "switching_churn": ["switch", "switching", "leave", "leaving", "left", "join", "joined", "move",
                        "moved", "moving home", "exit fee", "competitive", "quote"],
    "technical_meter": ["meter", "smart meter", "reading", "installation", "engineer", "technical",
                        "outage", "supply", "fault", "error", "broken"],
    "app_website": ["app", "website", "online", "portal", "log in", "login", "account", "digital",
                    "site", "platform"],
    "green": ["green", "renewable", "eco", "carbon", "solar"],
}

MENTION_TERMS = {
    "Appointment Scheduling": ["appointment", "schedule", "slot", "visit"],
    "Customer Service": ["service", "support", "agent", "helpline", "call"],
    "Engineer Experience": ["engineer", "technician", "install", "repair", "visit"],
    "Response Speed": ["quick", "fast", "slow", "delay", "prompt", "timely"],
    "Value For Money": ["bill", "billing", "charge", "price", "cost", "tariff", "rate", "overcharge",
                        "refund"],
    "Net Zero": ["green", "eco", "renewable", "carbon", "sustainability", "solar"],
}

STEM_TERMS = {
    "Appointment Scheduling": ["appointment", "booking", "schedule", "engineer", "visit", "reschedule",
                               "cancel", "time", "slot", "booked", "arrival", "arrived", "late",
                               "no-show"],
    "Customer Service": ["service", "support", "helpline", "call", "centre", "agent", "representative",
                         "advisor", "team", "chat", "email", "complaint"],
    "Energy Readings": ["reading", "readings", "submit", "submitting", "estimate", "usage",
                        "consumption"],
    "Meter Installations": ["meter", "installation", "smart", "engineer", "install", "new", "exchange",
                            "fitted", "fitting"],
    "Value For Money": ["price", "cost", "tariff", "expensive", "cheap", "value", "overcharge", "deal",
                        "saving", "affordable", "competitive"],
    "Accounts and Billing": ["account", "bill", "billing", "payment", "payments", "paid",
                             "direct debit", "statement", "refund", "credit", "charge", "invoice"],
}

COSINE_TERMS = {
    "Appointment Scheduling": ["appointment", "schedule", "booking", "availability", "slot",
                               "reschedule", "booking system", "appointment time", "booked",
                               "cancelled appointment", "manage booking"],
    "Customer Service": ["customer service", "support", "agent", "representative", "helpline",
                         "complaint", "polite", "rude", "helpful", "unhelpful", "assistance",
                         "communication", "staff", "query", "enquiry", "contact centre"],
    "Response Speed": ["response", "speed", "quick", "fast", "slow", "wait time", "prompt", "delay",
                       "waiting", "quickly", "timely", "turnaround", "responsiveness"],
    "Engineer Experience": ["engineer", "technician", "visit", "on-site", "professional",
                            "knowledgeable", "skill", "attitude", "courteous", "efficient staff",
                            "workmanship", "expertise", "site visit"],
    "Solution Quality": ["solution", "quality", "fix", "resolve", "issue", "problem", "effective",
                         "reliable", "worked", "failed", "outcome", "resolution", "successful",
                         "poor quality", "fixed"],
    "Value For Money": ["value", "price", "cost", "expensive", "cheap", "affordable", "worth",
                        "tariff", "charges", "pricing", "overpriced", "good value", "fair price",
                        "economical", "cost-effective"],
    "Meter Installations": ["meter", "installation", "install", "fitting", "new meter", "smart meter",
                            "meter exchange", "engineer visit for meter", "meter setup",
                            "meter replaced", "commissioning"],
    "Energy Readings": ["reading", "energy usage", "consumption", "meter reading", "estimate",
                        "actual", "usage data", "smart meter reading", "inaccurate reading",
                        "submit reading", "view readings"],
    "Accounts & Billing": ["account", "billing", "invoice", "payment", "charge", "refund",
                           "statement", "direct debit", "overcharge", "billing error", "final bill",
                           "credit", "debt", "manage account"],
}

CATEGORY_TERMS = {
    "Boiler Services": ["boiler", "heating", "radiator", "asv", "service", "heat", "engineer",
                        "homecare"],
    "Plumbing & Drains": ["plumbing", "plumber", "drain", "pipe", "leak", "burst", "blockage",
                          "toilet", "sink", "sewer"],
    "Home Electrical": ["electrical", "socket", "wiring", "fuse", "circuit", "lighting", "breaker",
                        "power cut", "powercut", "rewire"],
    "Appliance Cover": ["appliance", "washing machine", "dishwasher", "fridge", "freezer", "oven",
                        "hob", "dryer", "tumble dryer", "microwave"],
    "Energy": ["energy", "electricity", "electric", "supplier", "meter", "tariff", "bill", "price",
               "standing charge", "direct debit", "account"],
}

RISK_TERMS = {
    "regulatory": {"ofgem": 1.0, "contract": 1.0, "terms": 0.5, "conditions": 0.5},
    "social": {"green": 1.0, "renewable": 1.0, "eco": 1.0, "carbon": 0.5, "solar": 0.5},
    "brand": {"will switch": 1.0, "looking to switch": 1.0, "switched to": 1.0, "moved to": 1.0,
              "consider switching": 1.0},
}

CHANNELS = ["app", "website", "email", "phone", "chat"]
PROMO_TERMS = ["introductory", "exit fee", "cheapest deal", "fixed for"]
REGULATORY_TERMS = ["ofgem", "t&c", "contract", "terms", "conditions"]
REASON_TERMS = ["because", "since", "as", "due to", "reason", "why", "so that"]
REASON_TERMS_SHORT = ["because", "as", "since", "so that"]
INTENT_TERMS = ["will switch", "looking to switch", "consider switching"]
OUTCOME_TERMS = ["switched to", "moved to", "changed to"]
DEBIT_TERMS = ["direct debit", "dd"]
PREPAY_TERMS = ["prepay", "prepayment", "pre-paid", "pay as you go", "payg", "top up", "top-up", "key",
                "card"]
GAS_TERMS = ["gas", "heating", "boiler", "fuel"]
POWER_TERMS = ["electricity", "electric", "power", "kwh", "plug", "socket", "voltage", "power cut",
               "power outage"]
OWN_BRAND = "british gas"

PRODUCT_LABELS = {
    "All": "🌎 All", "Gas Products": "🚿 Gas Products", "Energy": "⚡ Energy",
    "Plumbing & Drains": "🪠 Plumbing & Drains", "Appliance Cover": "📺 Appliance Cover",
    "Home Electrical": "🔦 Home Electrical", "Heating": "🔥 Heating",
    "Pest Control": "🐀 Pest Control", "Unknown": "🃏 Unknown",
}

MIN_REVIEW_CHARS = 15
SPAM_CONFIDENCE = 0.9
EVIDENCE_WEIGHT = 0.96
EVIDENCE_TOKEN_BUDGET = 16000
TOKENS_PER_REVIEW = 100
CHARS_PER_TOKEN = 4
LONG_REVIEW_WORDS = 150

# A few rows of each role, enough for tests and demonstrations. Real jobs pass their own
# lexicon as a DataFrame with the same columns.
SAMPLE_LEXICON = [
    ("good", 1.9, "word"), ("great", 3.1, "word"), ("helpful", 1.8, "word"), ("love", 3.2, "word"),
    ("excellent", 2.7, "word"), ("happy", 2.7, "word"), ("bad", -2.5, "word"),
    ("terrible", -2.1, "word"), ("awful", -2.0, "word"), ("rude", -2.0, "word"),
    ("slow", -1.0, "word"), ("problem", -1.7, "word"),
    ("very", 0.293, "booster"), ("really", 0.293, "booster"), ("extremely", 0.293, "booster"),
    ("slightly", -0.293, "booster"), ("barely", -0.293, "booster"),
    ("not", -0.74, "negator"), ("never", -0.74, "negator"), ("isn't", -0.74, "negator"),
    ("but", None, "contrast"),
    ("kind of", -0.293, "booster"), ("sort of", -0.293, "booster"), ("great deal of", 0.293, "booster"),
    ("great pains", -1.5, "idiom"), ("love to hate", -2.0, "idiom"),
]

# ---------------------------------------------------------------------------


def keyword_dim(spark: SparkSession, terms: Mapping[str, Sequence[str] | Mapping[str, float]]) -> DataFrame:
    """``(key, keyword, weight, ord)`` rows of a dictionary, in dictionary order."""
    rows, order = [], 0
    for key, words in terms.items():
        weights = words if isinstance(words, Mapping) else dict.fromkeys(words, 1.0)
        for word, weight in weights.items():
            rows.append((key, word, float(weight), order))
            order += 1
    return spark.createDataFrame(rows, "key string, keyword string, weight double, ord int")


def lexicon_dim(spark: SparkSession, rows: Sequence[tuple] = SAMPLE_LEXICON) -> DataFrame:
    """``(token, valence, role)``; role is word, booster, negator, contrast or idiom, one per token;
    boosters and idioms may be phrases of two or three words."""
    return spark.createDataFrame(list(rows), "token string, valence double, role string")


def label_dim(spark: SparkSession, labels: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(list(labels.items()), "code string, label string")
