"""Rule sets of the screens. Every value can be replaced by a parameter of the functions that use it."""

from __future__ import annotations

# The shipped rule set. Lists are matched as case-insensitive substrings, patterns as regular expressions.
PRIORITY_TITLES = [
    "sdet", "software development engineer in test", "software developer in test", "test automation", "qa automation",
    "quality assurance engineer", "quality assurance analyst",
]
ALLOWED_TITLES = [
    "test engineer", "testing engineer", "test analyst", "test consultant", "testing consultant", "test lead", "test specialist",
    "test infrastructure", "qa engineer", "qa analyst", "qa test", "qa specialist", "qa consultant", "quality engineer",
    "quality engineering", "quality assurance", "tester", "automation engineer", "automation analyst", "automation consultant",
    "engineer in test", "developer in test",
]
EXCLUDED_TITLES = [
    "hardware", "firmware", "embedded", "electronics", "silicon", "pcb", "asic", "fpga", "manufacturing", "fabrication", "welding",
    "cnc", "hvac", "building services", "building automation", "construction", "calibration", "scada", "iso 9001", "automotive",
    "aerospace", "pharmaceutical", "medical device", "clinical", "games tester", "game tester", "playtest", "localisation",
    "localization", "linguistic", "penetration", "sales engineer", "recruiter", "talent acquisition", "field service",
]
LOCATIONS = [
    r"\blondon\b", r"\bgreater london\b", r"\bunited kingdom\b", r"\buk\b",
    r"\bremote\b[^,;|]{0,25}\b(uk|u\.k\.|united kingdom|gb|great britain|england|scotland|wales|northern ireland)\b",
    r"\b(uk|u\.k\.|united kingdom|gb|great britain|england|scotland|wales|northern ireland)\b[^,;|]{0,25}\bremote\b",
]
STACK_PRIORITY = {
    "java": r"\bjava\b", "ruby": r"\bruby\b", "rails": r"\brails\b", "rspec": r"\brspec\b", "capybara": r"\bcapybara\b",
    "groovy": r"\bgroovy\b", "spock": r"\bspock\b", "maven": r"\bmaven\b", "junit": r"\bjunit\b", "spring": r"\bspring\b",
}
STACK_SECONDARY = {"javascript": r"\bjavascript\b", "node": r"\bnode(?:\.?js)?\b"}
STACK_DEALBREAKERS = {
    "c#": r"\bc#(?![a-z0-9])", "c++": r"\bc\+\+(?![a-z0-9])", ".net": r"\.net\b", "golang": r"\bgolang\b", "php": r"\bphp\b",
    "kotlin": r"\bkotlin\b", "swift": r"\bswift\b", "scala": r"\bscala\b", "python": r"\bpython\b", "pytest": r"\bpytest\b",
    "playwright": r"\bplaywright\b",
}
LANGUAGE_TIERS = {"priority": 3, "secondary": 2, "none": 1, "mismatch": 0}
CLEARANCE_BLOCKED = {
    "active_clearance": r"\b(?:active|current|existing|valid|live)\s+(?:sc|dv|esc|edv|ctc|nppv\d?)\b",
    "cleared_suffix": r"\b(?:sc|dv|esc|edv|ctc|nppv\d?)\b[\s\-]*cleared\b",
    "clearance_required": r"\b(?:sc|dv|esc|edv|ctc|nppv\d?)\s+clear\w*nce\b[^.;]{0,30}?\b(?:required|essential|mandatory|needed)\b",
    "must_hold": r"\bmust\s+(?:already\s+)?(?:hold|have|possess)\b[^.;]{0,50}?\b(?:sc|dv|esc|edv|ctc|nppv\d?)\b",
    "hold_clearance": r"\bhold\s+(?:an?\s+)?(?:active\s+|current\s+|existing\s+|valid\s+)?(?:sc|dv|esc|edv|ctc)\b",
    "held_clearance": r"\b(?:have\s+)?held\s+(?:security\s+)?(?:sc\s+|dv\s+)?clear\w*nce\b",
    "clearance_label": r"\bsecurity\s+clear\w*nce\s*[:\-]\s*(?:active|required|essential|mandatory|sc|dv|esc|edv)\b",
}
CLEARANCE_MENTION = {
    "token": r"\b(?:sc|dv|esc|edv|ctc|nppv\d?)\b", "bpss": r"\bbpss\b",
    "security": r"\bsecurity\s+(?:clear\w*nce|check|vetting)\b", "clearance": r"\bclear\w*nce\b",
}
CLEARANCE_DOWNGRADE = {
    "eligible": r"\beligib\w*", "obtain": r"\bobtain(?:ing|able|ed)?\b", "willing": r"\bwilling\s+to\s+(?:undergo|be|obtain)\b",
    "ability": r"\bability\s+to\s+(?:obtain|gain|hold|be\s+cleared|undergo)\b", "bpss": r"\bbpss\b", "non_sc": r"\bnon[\s\-]?sc\b",
    "not_mandated": r"\bnot\s+(?:mandated|required|essential)\b",
    "nice_to_have": r"\bwould\s+be\s+(?:a\s+)?(?:benefit|advantage|plus|bonus|nice)\b|\bnice\s+to\s+have\b|\bdesirable\b|\badvantageous\b|\bnot\s+essential\b",
}
REJECT_BLOCKED = True
TRUNCATED_CHARS = 400
LISTING_MARKERS = {
    "back-to-search": "❮\\s*back to last search|back to last search", "search-widget": r"What\?\s*Where\?\s*Search",
    "search-advanced": r"Search\s+Advanced", "job-in-place": r"\bJob in [A-Z][^.]{0,60}?\s*What\?",
    "results-count": r"\b\d[\d,]*\s+(?:jobs|results)\s+(?:found|matching)\b",
}
BODY_START = "Apply for this job|❮\\s*back to last search"
BODY_END = (
    r"\bPopular Jobs\b|\bTop job titles\b|\bTop job types\b|\bTop companies\b|\bTop locations\b|\bJobseekers\b|\bRecruiters\b|"
    r"\bPost a job\b|\bCountry selection\b|\bAdzuna Intelligence\b|\bBrowse jobs\b|\bValueMyCV\b|\bApplyIQ\b"
)
BODY_CHARS = 200
COMPANY_NOISE = ["ltd", "limited", "plc", "llc", "inc", "gmbh", "bv", "sa", "ag", "group", "holdings", "uk", "the", "co"]
TITLE_NOISE = [
    "x2", "x3", "x4", "x5", "x6", "2x", "3x", "contract", "contractor", "contracting", "permanent", "temp", "temporary", "ftc",
    "fixed", "term", "interim", "remote", "hybrid", "onsite", "on-site", "homebased", "home", "job", "role", "vacancy", "position",
    "opportunity", "opening", "ref", "reference", "urgent", "urgently", "asap", "immediate", "immediately", "new", "now", "hiring",
    "wanted", "required", "needed", "day", "days", "week", "weeks", "month", "months", "year", "years", "start", "starting", "date",
    "duration", "rate", "salary",
]
TITLE_QUANTITY = r"\b\d+\s*(?:month|months|week|weeks|year|years|day|days|hour|hours|hr|hrs|position|positions|role|roles|head|heads)\b|\b[xX]\s*\d+\b|\b\d+\s*[xX]\b"
CITIES = [
    "london", "bristol", "birmingham", "manchester", "newcastle", "edinburgh", "belfast", "coventry", "solihull", "leeds", "glasgow",
    "cardiff", "sheffield", "nottingham", "reading", "liverpool", "swindon", "croydon",
]
VAGUE_PLACES = ["uk", "united kingdom", "gb", "great britain", "england", "britain", "remote", "homeworker", "home based", "home-based", "anywhere", "nationwide"]

#: Tax year 2026/27 and the search settings.
RATES = {
    "target_salary": 60000.0, "days": 220.0,
    "personal_allowance": 12570.0, "basic_rate_limit": 50270.0, "higher_rate_limit": 125140.0,
    "basic_rate": 0.20, "higher_rate": 0.40, "additional_rate": 0.45, "taper_threshold": 100000.0,
    "ee_primary": 12570.0, "ee_upper_limit": 50270.0, "ee_main": 0.08, "ee_upper": 0.02,
    "er_secondary": 5000.0, "er_rate": 0.15, "levy_rate": 0.005, "levy_allowance": 15000.0,
    "dividend_allowance": 500.0, "dividend_basic": 0.1075, "dividend_higher": 0.3575, "dividend_additional": 0.3935,
    "ct_small_rate": 0.19, "ct_main_rate": 0.25, "ct_small_limit": 50000.0, "ct_main_limit": 250000.0, "ct_relief": 0.015,
    "pension_lower": 6240.0, "pension_upper": 50270.0, "pension_rate": 0.03,
    "umbrella_margin": 25.0 * 48.0, "umbrella_levy": True, "umbrella_pension": True,
    "company_salary": 12570.0, "company_fees": 1200.0, "company_pension": 0.0,
    "unknown_is_inside": True, "reject_below_threshold": True, "reject_sources": ("stated", "derived_from_advertised_salary"),
    "annualisation_days": 260.0, "plausible": (150.0, 2500.0),
}
