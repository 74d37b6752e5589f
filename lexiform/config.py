"""Options and fixed values of the ranking engine."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Thresholds, weights, caps and penalties of the ranking policy.
MIN_CONFIDENCE, MIN_MARGIN, HOTWORD_CONFIDENCE = 0.50, 0.04, 0.85
MAX_CANDIDATES, PREFLIGHT_ATTEMPTS, RANK_CACHE = 20, 3, 256
CAP_LANGUAGE, CAP_INTENT, CAP_TEMPLATE = 150_000, 5_000, 150
CAP_SLOT_VALUES, CAP_DYNAMIC, CAP_NOMINATED, CAP_SCORED = 20, 200, 64, 128
PREFILTER, SLOT_RESCUE, WILDCARD_RESCUE = 500, 32, 64
W_FUZZY, W_CHAR, W_BM25, W_INTENT = 0.33, 0.32, 0.20, 0.15
BM25_K1, BM25_B = 1.5, 0.75
NGRAM = 3
SLOT_RATIO, SLOT_MIN_LENGTH, REGISTRY_MIN_LENGTH = 75, 4, 5
WILDCARD_COVERAGE, STEM_ALIGNMENT, WILDCARD_WORD_PENALTY = 0.75, 0.60, 0.015
PARTIAL_CREDIT, NON_ENTITY_BLEND = 0.50, 0.05
TIE, NUMERIC_TOLERANCE, RANGE_TOLERANCE = 1e-12, 1e-5, 1e-9
CONTEXT_BOOST, CONTEXT_MISMATCH = 0.10, 0.85
ENTITY_UNCOVERED, NUMERIC_WITHOUT_QUERY, NUMERIC_LITERAL, NUMERIC_MISMATCH = 0.72, 0.78, 0.64, 0.05
NUMBER_ABSENT, STATIC_UNCOVERED, STATIC_CONFLICT = 0.78, 0.82, 0.74
UNANCHORED_ENTITY, UNANCHORED_SEMANTIC, WILDCARD_KNOWN = 0.88, 0.78, 0.78
HIGH_SCORE, HIGH_MARGIN = 0.80, 0.005
EMPTY_SLOT_SCORE, EMPTY_SLOT_MARGIN = 0.60, 0.035
SAFE_INTENT_LOW, SAFE_INTENT_HIGH, SAFE_INTENT_ADVANTAGE = 0.57, 0.74, 0.09
ZERO_INTENT_SCORE, ZERO_INTENT_MARGIN = 0.70, 0.07
# Candidate sources, best first.
SOURCES = ("custom_sentence", "built_in", "generated_sample")
# Keys of grammar sources whose sentences are the user's own.
CUSTOM_KEYS = ("config", "trigger", "custom_sentence")
# Letters folded to plain Latin, for every language and for German before that.
LATIN = {"đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "ı": "i", "ð": "d", "þ": "th"}
BY_LANGUAGE = {"de": {"ä": "ae", "ö": "oe", "ü": "ue"}}
# The intent preferred of each opposing pair in a tie.
OPPOSING = (
    ("HassTurnOn", "HassTurnOff"),
    ("HassMediaUnpause", "HassMediaPause"),
    ("HassMediaPlayerUnmute", "HassMediaPlayerMute"),
    ("HassUnpauseTimer", "HassPauseTimer"),
    ("HassIncreaseTimer", "HassDecreaseTimer"),
    ("HassMediaNext", "HassMediaPrevious"),
)
# List intents that mean one thing; state-neutral intents that carry an action's prefix.
EQUIVALENT = (("HassListAddItem", "HassShoppingListAddItem"), ("HassListCompleteItem", "HassShoppingListCompleteItem"), ("HassListRemoveItem", "HassShoppingListCompleteItem"))
NEUTRAL = ("HassNevermind", "HassRespond", "HassTimerStatus")
# Slots that name an entity, and slots that name a place.
ENTITY_SLOTS, LOCATION_SLOTS = ("name", "entity", "entity_name"), ("area", "area_name", "floor", "floor_name")
STORE_VERSION = 6


class OptionError(ValueError):
    """An option outside its range."""


@dataclass(frozen=True)
class Options:
    """User options; thresholds lie in [0, 1]. ``resolve`` prefers options, then stored data, then defaults."""

    min_confidence: float = MIN_CONFIDENCE
    min_margin: float = MIN_MARGIN
    hotword_confidence: float = HOTWORD_CONFIDENCE
    hotwords: tuple[str, ...] = ()
    max_candidates: int = MAX_CANDIDATES

    def __post_init__(self) -> None:
        for name in ("min_confidence", "min_margin", "hotword_confidence"):
            value = getattr(self, name)
            if not (isinstance(value, (int, float)) and math.isfinite(value) and 0 <= value <= 1):
                raise OptionError(f"{name} must lie between 0 and 1")
        if self.max_candidates < 1:
            raise OptionError("max_candidates must be at least 1")

    @classmethod
    def resolve(cls, options: dict | None = None, data: dict | None = None) -> Options:
        known = cls.__dataclass_fields__
        merged = {k: v for k, v in {**(data or {}), **(options or {})}.items() if k in known and v is not None}
        return cls(**merged)
