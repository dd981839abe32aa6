"""Word lists, tables and limits that the results depend on. Everything here is data, not logic."""

GENERIC_WORDS = (
    "increased decreased increasing decreasing grew growth declined reported reporting was were is are has have had "
    "been being doubled tripled improved improving stood reaching and or the this that these those it its we our us "
    "their they them you your he she his her but then which who whom whose where when why how all any some "
    "few more most other into from for with by at to on as of in about above below between under over such an a"
).split()

VERB_PREDICATES = [
    "increased", "decreased", "grew", "doubled", "tripled", "declined", "was", "were", "is", "are", "reported", "stood",
    "improved", "reached", "totaled", "stood at", "was reported", "has increased", "has decreased", "is growing", "growing",
]

FRAGMENT_ENDINGS = ["and", "or", "by", "to", "of", "in", "for", "with", "driven by", "as of", "due to", "over", "under", "from", "that", "which", "including", "such as"]
FRAGMENT_PREFIXES = ["in fiscal ", "for the ", "and ", "or ", "but ", "then ", "which ", "as the ", "our ", "we ", "to "]
LOWER_CASE_NAMES = ["delhivery", "india", "rbi", "imf", "delonghi"]
PUNCTUATION_PREDICATES = [",", ".", "-", ";", "/", "\\", "&", "+"]

#: Values that say nothing by themselves, as alternatives of one anchored pattern.
LONE_NUMBERS = [r"\d+", r"\d+\s*fy\s*\d{2,4}", r"page\s*\d+", r"[ivxlcdm]+", r"[#*•\-.]+\s*\d+", r"note\s*\d+", r"[,.\-\s]+"]

METRIC_KEYWORDS = (
    "revenue profit ebitda margin income sales loss volume shipment capacity pressure power wattage retention headcount "
    "employees capital days growth turnover debt pat eps expenditure cost gdp inflation cpi deficit repo reserves rate "
    "export import trade tax cad receipts payments production"
).split()
ENTITY_TERMS = ["corp", "inc", "ltd", "limited", "delhivery", "acme", "technologies", "services", "company"]

#: In the order in which they are tried.
MULTIPLIERS = [
    ("crore", 1e7), ("crores", 1e7), ("cr", 1e7), ("lakh", 1e5), ("lakhs", 1e5), ("lac", 1e5), ("lacs", 1e5),
    ("billion", 1e9), ("billions", 1e9), ("bn", 1e9), ("b", 1e9), ("million", 1e6), ("millions", 1e6), ("mn", 1e6), ("m", 1e6),
    ("thousand", 1e3), ("thousands", 1e3), ("k", 1e3),
]
CURRENCY_SIGNS = [("₹", "INR"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY")]
CURRENCY_WORDS = [("rs", "INR"), ("inr", "INR"), ("usd", "USD"), ("eur", "EUR"), ("gbp", "GBP"), ("jpy", "JPY")]
CURRENCIES = ["INR", "USD", "EUR", "GBP", "JPY"]
UNITS = [
    ("liter", "liters"), ("liters", "liters"), ("litre", "liters"), ("litres", "liters"), ("l", "liters"), ("bar", "bar"), ("bars", "bar"),
    ("psi", "psi"), ("watt", "watts"), ("watts", "watts"), ("w", "watts"), ("kw", "kilowatts"), ("kilowatt", "kilowatts"), ("kg", "kg"),
    ("kilogram", "kg"), ("kilograms", "kg"), ("g", "grams"), ("gram", "grams"), ("grams", "grams"), ("hz", "hz"), ("volt", "volts"),
    ("volts", "volts"), ("v", "volts"), ("percent", "%"), ("percentage", "%"),
]

#: In the order in which they are tried; the first two match anywhere in the predicate, the others at whole words.
METRIC_FAMILIES = [
    ("SECTORAL_SALES", ["passenger vehicle sales", "two-wheeler sales", "three-wheeler sales", "commercial vehicle sales", "tractor sales", "auto sales", "vehicle sales"]),
    ("TAX_REVENUE", ["net tax revenue", "net tax revenues", "tax revenue", "tax revenues", "gross tax revenue", "direct tax", "indirect tax", "gst revenue", "non-tax revenue", "non-tax revenues"]),
    ("REVENUE", [
        "revenue", "total revenue", "gross revenue", "turnover", "income from operations", "revenue from contracts with customers", "service revenue",
        "operating revenue", "revenue from services", "fy24 revenue from services", "q4 fy24 revenue from services",
    ]),
    ("PROFITABILITY", ["ebitda", "ebitda profitability", "operating profit", "operating ebitda", "operating income", "net profit", "pat", "profit after tax", "net income", "profit before tax", "pbt", "loss after tax"]),
    ("MARGINS", ["margin", "ebitda margin", "profit margin", "net profit margin", "operating margin", "pat margin"]),
    ("PER_SHARE", ["loss per share", "earnings per share", "eps", "diluted eps", "basic eps", "book value per share"]),
    ("VOLUMES_OPERATIONAL", [
        "express parcels shipped", "parcel volume", "express parcel volume", "part truckload tonnage", "truckload tonnage", "tonnage", "shipments",
        "freight volume", "delivery network", "active customers",
    ]),
    ("WORKING_CAPITAL", ["nwc days", "net working capital days", "working capital", "cash conversion cycle"]),
    ("MACRO_GDP", ["gdp", "real gdp", "gdp growth", "real gdp growth", "economic growth", "gross domestic product", "gross domestic product (gdp) growth"]),
    ("MACRO_INFLATION", ["inflation", "cpi inflation", "headline inflation", "core inflation", "consumer price index", "cpi", "retail inflation"]),
    ("MACRO_FISCAL", ["fiscal deficit", "gross fiscal deficit", "revenue deficit", "primary deficit"]),
    ("MACRO_POLICY_RATE", ["repo rate", "policy repo rate", "policy rate", "reverse repo rate", "standing deposit facility"]),
    ("MACRO_EXTERNAL", ["current account deficit", "cad", "forex reserves", "foreign exchange reserves", "trade deficit"]),
    ("SPECIFICATION_PRESSURE", ["pump pressure", "operating pressure", "bar pressure", "pressure"]),
    ("SPECIFICATION_CAPACITY", ["water tank capacity", "tank capacity", "bean hopper capacity", "capacity"]),
    ("SPECIFICATION_POWER", ["power consumption", "wattage", "rated power", "power"]),
]
MODIFIER_CONFLICTS = [
    (["tax", "taxes"], ["service", "services", "contracts", "operations"]),
    (["passenger", "vehicle", "wheeler", "auto"], ["corporate", "total", "contracts", "services"]),
    (["headline"], ["core"]),
    (["gross"], ["net"]),
    (["direct"], ["indirect"]),
]
METRIC_STOP_WORDS = (
    "increased decreased increasing decreasing grew growth declined reported reporting was were is are has have "
    "doubled tripled stood reaching reached total totaled rate value count number the a an of for in and "
    "by at to with from our their its as per on"
).split()
ENTITY_STOP_WORDS = "the a an ltd limited inc corp corporation company group holdings technologies services our your its".split()

ABBREVIATIONS = "Rs INR Mr Mrs Ms Dr Ltd Inc Corp No Vol FY vs eg ie approx bn mn cr".split()
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st")]
INVISIBLE = "\u00ad\u200b\ufeff"
WIDE_SPACES = "\u00a0\u2009\u202f"

#: Limits: chunks, pairs, matching and grounding.
CHUNK_WORDS, OVERLAP_WORDS, PAIR_CAP = 1000, 150, 40
VERIFIED, PARTIAL, LEAST_QUALITY, LEAST_OVERLAP = 0.85, 0.60, 0.60, 0.35
LEAST_SUBJECT, LEAST_PREDICATE, LEAST_SCORE = 0.60, 0.65, 0.70
SAME_YEARS = ["2022", "2023", "2024", "2025", "2026"]
TOLERANCE = 0.015

#: Audit lists.
AUDIT_PREDICATES = ["increased", "decreased", "grew", "fell", "rose", "doubled", "tripled", "was", "is", "total", "the"]
AUDIT_VALUES = ["increased", "decreased", "grew", "fell", "rose", ",", "."]
AUDIT_SUBJECTS = ["we have", "that has", "our", "we", "the", "this revenue", "and total"]
AUDIT_VERBS = ["increased", "decreased", "grew", "fell", "rose"]

#: Extraction: entities, metrics, connecting words, values and periods.
COMPANIES = ["Delhivery", "DeLonghi", "Acme Corp", "Tata Motors", "Infosys", "Reliance", "Amazon"]
INSTITUTIONS = [("RBI", ["Reserve Bank of India", "RBI"]), ("IMF", ["IMF", "International Monetary Fund"]), ("India", ["India", "Government of India"])]
KNOWN_SUBJECTS = ["Delhivery", "Acme Logistics", "Acme Corp", "Acme", "DeLonghi", "Tata Motors", "Infosys", "Reliance", "Amazon", "India", "RBI", "IMF"]
FINANCIAL_METRICS = [
    "revenue from services", "revenue from operations", "revenue from contracts with customers", "total revenue", "revenue", "sales", "ebitda",
    "operating profit", "net profit", "pat", "loss per share", "earnings per share", "real gdp growth", "gdp growth", "domestic product (gdp) growth",
    "domestic product growth", "gross domestic product (gdp) growth", "gross domestic product growth", "real gdp", "gdp", "cpi inflation",
    "headline cpi inflation", "headline inflation", "core inflation", "retail inflation", "food inflation", "inflation", "gross fiscal deficit",
    "fiscal deficit", "current account deficit", "policy repo rate", "repo rate", "forex reserves", "foreign exchange reserves",
]
FINANCIAL_LINKS = [
    "reported", "recorded", "achieved", "generated", "stood at", "was", "is", "reached", "totaled", "projected at", "estimated to be", "estimated at",
    "forecast to be", "forecast at", "pegged at", "averaged", "moderated to", "remained unchanged at", "increased to", "increased by", "decreased to",
    "decreased by", "grew to", "grew by", "fell to", "fell by", "rose to", "rose by", "jumped to", "jumped by", "of", "at", "to",
]
AMOUNT_WORDS = ["crore", "cr", "lakh", "lac", "billion", "bn", "million", "mn", "thousand", "k", "%", "per cent", "percent"]
PERIOD = r"FY\s*(?:20\d{2}|\d{2})|Q[1-4]\s*FY\s*(?:20\d{2}|\d{2})|\d{4}-\d{2,4}|\d{4}"
PREFIX_VERBS = ["reported", "recorded", "achieved", "generated", "stood at", "was", "is", "reached", "totaled", "rated at", "of", "in", "for", "with", "as of"]
VOLUME_METRICS = [
    "express parcels shipped", "parcel volume", "express parcel volume", "part truckload tonnage", "truckload tonnage", "customer retention rate",
    "nwc days", "net working capital days",
]
VOLUME_VERBS = ["shipped", "handled", "delivered", "processed", "recorded", "achieved"]
VOLUME_UNITS = ["million", "mn", "billion", "bn", "thousand", "days", "%", "per cent", "tonnes", "tons"]
VOLUME_EMPTY_SUBJECTS = ["total", "our", "we", "the", "in", "and"]
DEVICE_METRICS = ["water tank capacity", "pump pressure", "operating pressure", "power consumption", "bean hopper capacity", "dimensions", "weight", "frequency", "voltage"]
DEVICE_VERBS = ["has", "features", "offers", "with", "operates with", "rated at"]
DEVICE_UNITS = ["liters", "litres", "l", "bar", "watts", "w", "kg", "grams", "g", "hz", "volts", "v"]
DEVICE_SHORT_UNITS = ["liters", "litres", "l", "bar", "watts", "w", "kg", "g", "hz", "v"]
DEVICE_EMPTY_SUBJECTS = ["machine", "appliance", "product", "device", "the", "this", "our", "an", "total"]
DEVICE_TAILS = ["features", "operates with", "has", "reported", "recorded", "stood at", "was", "is", "reached", "rated at"]
CALLOUT_UNITS = ["Mn", "Bn", "Cr", "K", "million", "billion", "crore", "lakh", "tonnes", "tons", r"sq\s*ft", "days", "%", "MW", "watts", "bar", "liters"]
CALLOUT_SKIP = ["page", "annual report", "delhivery limited", "corporate overview", "financial statements"]
CALLOUT_STOP = ["fy20", "fy21", "fy22", "fy23", "fy24", "year", "year ended", "transaction", "note", "nil"]
CALLOUT_WORDS = ["increased", "decreased", "total", "net", "our", "we", "the", "in", "for"]
CALLOUT_PERIODS = [
    ("Q4 FY2024", ["Q4 FY24", "Q4 FY 24", "Q4 FY2024"]), ("Q3 FY2024", ["Q3 FY24", "Q3 FY 24"]), ("FY2024", ["FY24", "FY 24", "2023-24", "FY2024"]),
    ("FY2023", ["FY23", "2022-23", "FY2023"]),
]

#: Model replies: words in place of a predicate, metrics that stand as subjects, subjects sought in the text, and allowed types.
REPLY_VALUE_WORDS = ["value", "amount", "metric", "figure", "level", "reported value"]
REPLY_METRICS = [
    "revenue", "sales", "ebitda", "profit", "net profit", "loss", "pat", "gdp", "real gdp", "inflation", "cpi", "fiscal deficit", "repo rate",
    "capacity", "pressure", "power consumption", "nwc days", "parcel volume",
]
REPLY_SUBJECTS = ["Delhivery", "DeLonghi", "Acme Corp", "Tata Motors", "Infosys", "Reliance", "Amazon", "India", "RBI", "IMF", "Reserve Bank of India", "Government of India"]
FACT_TYPES = ["financial_metric", "numerical_metric", "percentage", "date", "status", "comparison", "semantic_claim", "other"]
RELATION_TYPES = ["CORROBORATE", "CONTRADICT", "RECONCILE", "UNRELATED"]
