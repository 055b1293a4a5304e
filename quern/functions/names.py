"""Column-name tokens and review flags as expressions over a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Token sets and flag names of the profile report.
SENSITIVE_TOKENS = [
    "account", "address", "cookie", "device", "email", "employee", "gps", "guid", "ip",
    "latitude", "longitude", "name", "order", "password", "patient", "payment", "phone",
    "player", "receipt", "referrer", "secret", "session", "signature", "token",
    "transaction", "uri", "url", "user", "uuid",
]
ID_TOKENS = ["guid", "hash", "id", "identifier", "key", "uuid"]
TIME_TOKENS = [
    "created", "creation", "date", "datetime", "day", "epoch", "eventtime", "hour", "millis",
    "millisecond", "modified", "month", "time", "timestamp", "updated", "year",
]
OUTCOME_TOKENS = [
    "after", "click", "conversion", "convert", "cost", "future", "label", "next", "outcome",
    "post", "response", "result", "reward", "spend", "target",
]
NAME_FLAGS = [
    ("identifier_like_name", ID_TOKENS),
    ("sensitive_name_review", SENSITIVE_TOKENS),
    ("time_candidate", TIME_TOKENS),
    ("outcome_or_post_state_name_review", OUTCOME_TOKENS),
]
# Fixed values: (suffix, least length of the word, replacement). "ss" keeps its s.
INFLECTIONS = [("ies", 4, "y"), ("es", 4, ""), ("s", 3, ""), ("ed", 5, ""), ("ing", 6, "")]
ID_SUFFIXES = [("ids", 4), ("id", 3)]


def words_of(name: Column) -> Column:
    """Lower-case words split at separators, camel humps and acronym ends."""
    humps = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    humps = F.regexp_replace(humps, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), "[^a-z0-9]+"), lambda w: w != "")


def _stem(word: Column, suffix: str, least: int, put: str) -> Column:
    fits = word.endswith(suffix) & (F.length(word) >= least)
    if suffix == "s":
        fits = fits & ~word.endswith("ss")
    return F.when(fits, F.concat(word.substr(F.lit(1), F.length(word) - len(suffix)), F.lit(put)))


def _variants(word: Column) -> Column:
    stems = [_stem(word, *rule) for rule in INFLECTIONS]
    id_stem = F.coalesce(*[_stem(word, suffix, least, "") for suffix, least in ID_SUFFIXES])
    forms = F.array(word, *stems, id_stem, F.when(id_stem.isNotNull(), "id"))
    return F.filter(forms, lambda v: v.isNotNull())


def name_tokens(name: Column) -> Column:
    """Distinct words of a name with their conservative inflection variants."""
    return F.array_distinct(F.flatten(F.transform(words_of(name), _variants)))


def name_flags(name: Column) -> Column:
    tokens = name_tokens(name)
    hits = [
        F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, wanted))), flag)
        for flag, wanted in NAME_FLAGS
    ]
    return F.filter(F.array(*hits), lambda f: f.isNotNull())
