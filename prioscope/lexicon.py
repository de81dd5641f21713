"""Keyword lexicons: the contract data of the text signal.

A lexicon is plain data; ``prioscope.functions.text`` turns it into column
expressions. List order matters: ``top_keywords`` keeps the first hits in list order.

Matching semantics (all presets): a keyword counts once if it occurs anywhere in the
lower-cased text as a substring (no word boundaries); a pattern counts once if it
matches anywhere. ``.`` in a pattern means "any character except a newline".
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference behaviour for identical results.
# Weights of the four hit counts in the text score, and the label <-> level map.
# ---------------------------------------------------------------------------
WEIGHT_CRIT = 4.0
WEIGHT_ESC = 3.5
WEIGHT_NEG = 1.0
WEIGHT_HIGH = 2.0
WEIGHT_MED = 1.0
WEIGHT_LOW = 0.5
LEVELS = ["Low", "Medium", "High", "Critical"]  # level 1..4

# FIXED VALUES — preset "core" (training, batch CLI and notebook inference).
CORE_CRIT = [
    "outage", "down", "not working", "cannot access", "complete failure",
    "production down", "system crash", "data loss", "breach", "hacked",
    "urgent", "emergency", "immediately", "asap", "blocking", "showstopper",
    "critical bug", "broken", "unresponsive", "corrupted", "deleted",
    "locked out", "cannot login", "escalate",
]
CORE_HIGH = [
    "error", "failing", "failed", "issue", "problem", "bug", "wrong",
    "crash", "slow", "timeout", "not loading", "degraded", "unstable",
]
CORE_ESC = [
    r"need.{0,10}now", r"will.{0,10}cancel", r"legal.{0,10}action",
    r"team.{0,10}blocked", r"production.{0,5}issue",
]
CORE_NEG = [
    "can't", "cannot", "won't", "doesn't", "isn't",
    "unable to", "failed to", "not working",
]

# FIXED VALUES — preset "app" (interactive single-ticket scoring).
APP_CRIT = [
    "outage", "down", "not working", "cannot access", "complete failure",
    "production down", "system crash", "data loss", "breach", "hacked",
    "security incident", "urgent", "emergency", "immediately", "asap",
    "blocking", "showstopper", "critical bug", "broken", "unresponsive",
    "corrupted", "deleted", "locked out", "cannot login", "escalate",
]
APP_HIGH = CORE_HIGH
APP_ESC = CORE_ESC
APP_NEG = CORE_NEG

# FIXED VALUES — preset "baseline" (keyword-only challenge baseline).
BASELINE_CRIT = CORE_CRIT
BASELINE_HIGH = CORE_HIGH
BASELINE_ESC = [r"need.{0,10}now", r"will.{0,10}cancel", r"team.{0,10}blocked"]
BASELINE_NEG = ["can't", "cannot", "won't", "unable to", "not working"]

# FIXED VALUES — preset "full" (pseudo-labelling notebook).
FULL_CRIT = [
    "outage", "down", "not working", "cannot access", "complete failure",
    "production down", "system crash", "data loss", "breach", "hacked",
    "security incident", "urgent", "emergency", "immediately", "asap",
    "blocking", "show stopper", "showstopper", "critical bug", "broken",
    "unresponsive", "corrupted", "deleted", "locked out", "cannot login",
    "revenue impact", "customer impact", "escalate", "sla breach",
]
FULL_HIGH = [
    "error", "failing", "failed", "issue", "problem", "bug", "wrong",
    "incorrect", "unexpected", "crash", "slow", "performance", "timeout",
    "not loading", "broken", "malfunction", "disruption", "impact",
    "workaround", "degraded", "intermittent", "unstable",
]
FULL_MED = [
    "question", "help", "how to", "inquiry", "assistance", "guidance",
    "feature request", "enhancement", "suggestion", "update", "change",
    "configure", "setup", "install", "integration", "documentation",
]
FULL_LOW = [
    "general", "feedback", "cosmetic", "typo", "minor", "nice to have",
    "low priority", "when possible", "future", "wishlist",
]
FULL_ESC = [
    r"need.{0,10}now", r"contact.{0,10}ceo", r"contact.{0,10}manager",
    r"will.{0,10}cancel", r"switching.{0,10}competitor",
    r"legal.{0,10}action", r"sue", r"refund.{0,15}immediately",
    r"never.{0,10}work", r"completely broken", r"totally broken",
    r"multiple.{0,10}users.{0,10}affected", r"team.{0,10}blocked",
    r"production.{0,5}issue", r"mission.{0,5}critical",
]
FULL_NEG = [
    "can't", "cannot", "won't", "doesn't", "isn't", "aren't",
    "haven't", "hasn't", "never", "no longer", "not working",
    "unable to", "failed to",
]
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """Keyword lists and patterns of one scoring variant.

    ``top_keywords`` is ``"crit"`` (first 3 critical hits) or ``"crit_high"``
    (first 3 critical hits followed by the first 2 high hits, cut to 3).
    """

    name: str
    crit: tuple[str, ...]
    high: tuple[str, ...]
    esc: tuple[str, ...]
    neg: tuple[str, ...]
    med: tuple[str, ...] = ()
    low: tuple[str, ...] = ()
    top_keywords: str = "crit"
    weights: dict = field(default_factory=lambda: {
        "crit": WEIGHT_CRIT, "esc": WEIGHT_ESC, "neg": WEIGHT_NEG,
        "high": WEIGHT_HIGH, "med": WEIGHT_MED, "low": WEIGHT_LOW,
    })

    @staticmethod
    def of(name: str, crit, high, esc, neg, med=(), low=(), top_keywords="crit") -> "Lexicon":
        return Lexicon(name, tuple(crit), tuple(high), tuple(esc), tuple(neg),
                       tuple(med), tuple(low), top_keywords)


CORE = Lexicon.of("core", CORE_CRIT, CORE_HIGH, CORE_ESC, CORE_NEG)
APP = Lexicon.of("app", APP_CRIT, APP_HIGH, APP_ESC, APP_NEG, top_keywords="crit_high")
BASELINE = Lexicon.of("baseline", BASELINE_CRIT, BASELINE_HIGH, BASELINE_ESC, BASELINE_NEG)
FULL = Lexicon.of("full", FULL_CRIT, FULL_HIGH, FULL_ESC, FULL_NEG, FULL_MED, FULL_LOW)

_PRESETS = {lx.name: lx for lx in (CORE, APP, BASELINE, FULL)}


def preset(name: str | Lexicon) -> Lexicon:
    if isinstance(name, Lexicon):
        return name
    try:
        return _PRESETS[name]
    except KeyError:
        raise ValueError(f"unknown lexicon preset {name!r}; have {sorted(_PRESETS)}") from None
