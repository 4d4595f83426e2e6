"""Small settings of the registered queries: entity names, word lists, effective dates.

They are arguments of the operators; a user passes their own.
"""

# (ticker, aliases, sector): invented words that occur in the test articles; "ontion" contains "ntion",
# so containment over-matches on purpose.
ENTITIES = [
    ("THTION", ["thtion", "attion"], "AFRICA"),
    ("ERTION", ["ertion", "thanea"], "AFRICA"),
    ("ERINER", ["eriner", "thanedble"], "AMERICA"),
    ("ONTION", ["ontion", "antion"], "AMERICA"),
    ("RETION", ["retion", "edtion"], "ASIA"),
    ("INTION", ["intion", "hation"], "ASIA"),
    ("NTION", ["ntion"], "EUROPE"),
    ("ENELLE", ["enelle", "auxqueau"], "EUROPE"),
]
SECTOR_MAP: dict[str, list[str]] = {}
for _ticker, _aliases, _sector in ENTITIES:
    SECTOR_MAP.setdefault(_sector, []).append(_ticker)
ALIASES = {t: a for t, a, _ in ENTITIES}
TICKERS = [t for t, _, _ in ENTITIES]

LEXICON = {"lement": 1, "aiment": 1, "oument": 1, "thened": 1, "queeau": -1, "ouelle": -1, "enelle": -1, "anding": -1}
KEYWORDS = ["thtion", "ouelle", "Schund"]

# Effective dates of a policy rate.
STEPS = [("1992-06-01", 8.25), ("1993-03-15", 9.0), ("1995-01-01", 10.5), ("1996-09-10", 9.75), ("1998-02-01", 8.0)]
