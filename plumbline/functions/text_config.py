"""Fixed values of the text evidence rules."""

from __future__ import annotations

# Terms that mark a material development.
MATERIAL_TERMS = [
    "earnings", "financial results", "revenue", "sales", "profit", "loss", "margin",
    "guidance", "forecast", "outlook", "acquisition", "acquire", "merger", "partnership",
    "joint venture", "contract", "agreement", "customer", "supplier", "product launch",
    "launches", "regulatory", "regulator", "investigation", "lawsuit", "litigation",
    "antitrust", "recall", "tariff", "supply shortage", "supply chain", "price increase",
    "chief executive", "ceo", "chief financial officer", "cfo", "resignation",
    "appointment", "layoff", "job cuts", "restructuring", "impairment", "bankruptcy",
    "dividend", "share repurchase", "stock buyback", "capital expenditure", "investment",
    "data breach", "cyberattack", "approval", "rejection",
]
# Phrases of generic or promotional pieces.
LOW_RELEVANCE_TERMS = [
    "stocks to buy", "best stocks", "top stocks", "reasons to buy", "millionaire maker",
    "make $100k", "six figures", "retire", "retirement portfolio", "my portfolio",
    "model portfolio", "etf", "exchange-traded fund", "fund that", "stock prediction",
    "price prediction", "magnificent seven", "could make you rich", "buy and hold forever",
    "passive income",
]
# Words left out of title comparison.
TITLE_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is",
    "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "will", "with", "why",
    "what", "how", "after", "before", "amid", "says", "said", "stock", "shares",
]
MIN_RELEVANCE = 2.0
TITLE_SIMILARITY = 0.68

# Filings shown per form.
RESEARCH_FORM_LIMITS = {"8-K": 5, "10-Q": 2, "10-K": 1}
HOLDING_FORM_LIMITS = {"8-K": 3, "10-Q": 1, "10-K": 1}
# Fixed values per form: excerpt size, section size, characters before and after a heading.
EXCERPT_SIZE = {"8-K": 12000, "10-Q": 10000, "10-K": 8000}
SECTION_SIZE = {"8-K": 4000, "10-Q": 3000, "10-K": 2500}
BEFORE_HEADING = {"8-K": 300, "10-Q": 500, "10-K": 500}
AFTER_HEADING = {"8-K": 2200, "10-Q": 2800, "10-K": 2600}
MERGE_GAP = 350
SEPARATOR = "\n\n---\n\n"

# Section headings per form.
HEADINGS = {
    "8-K": [
        "item 1.01", "entry into a material definitive agreement", "item 1.02",
        "termination of a material definitive agreement", "item 2.01",
        "completion of acquisition or disposition of assets", "item 2.02",
        "results of operations and financial condition", "item 2.05",
        "costs associated with exit or disposal activities", "item 2.06", "material impairments",
        "item 3.01", "notice of delisting", "item 5.02",
        "departure of directors or certain officers", "appointment of certain officers",
        "item 5.07", "submission of matters to a vote of security holders", "item 7.01",
        "regulation fd disclosure", "item 8.01", "other events", "item 9.01",
        "financial statements and exhibits", "earnings release", "financial results", "guidance",
        "acquisition", "disposition", "restructuring", "impairment",
    ],
    "10-Q": [
        "item 2. management's discussion and analysis",
        "item 2. management’s discussion and analysis",
        "item 3. quantitative and qualitative disclosures about market risk",
        "item 4. controls and procedures", "item 1a. risk factors",
        "management's discussion and analysis", "management’s discussion and analysis",
        "results of operations", "liquidity and capital resources",
        "critical accounting estimates", "risk factors",
        "quantitative and qualitative disclosures about market risk", "controls and procedures",
        "legal proceedings", "unregistered sales of equity securities",
    ],
    "10-K": [
        "item 1. business", "item 1a. risk factors", "item 3. legal proceedings",
        "item 7. management's discussion and analysis",
        "item 7. management’s discussion and analysis",
        "item 7a. quantitative and qualitative disclosures about market risk",
        "item 9a. controls and procedures", "business", "risk factors",
        "unresolved staff comments", "properties", "legal proceedings",
        "management's discussion and analysis", "management’s discussion and analysis",
        "results of operations", "liquidity and capital resources",
        "critical accounting estimates",
        "quantitative and qualitative disclosures about market risk", "controls and procedures",
        "market for registrant's common equity", "market for registrant’s common equity",
    ],
}
