"""Settings of the engine, all replaceable: word lists, lexicon, patterns, weights and limits.

The lists are this library's own defaults; a study brings its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Weights of the opportunity score, in percent of its maximum.
SCORE_WEIGHTS = {
    "prevalence": 0.22,
    "clean_prevalence": 0.18,
    "strong_prevalence": 0.16,
    "pain": 0.12,
    "evidence": 0.10,
    "urgency": 0.10,
    "commercial": 0.07,
    "workaround": 0.05,
}
LED_PENALTY = 0.35
Z = 1.96

STOPWORDS = (
    "a about after again all also am an and any are as at be because been before being but by can could did do does doing down during each even few for from further get got "
    "had has have having he her here hers him his how i if in into is it its itself just like lot make many may me might more most much my no nor not now of off on once one only "
    "or other our out over own really right said same say she should so some such than that the their them then there these they thing things this those through to too under "
    "until up us very was we well were what when where which while who whom why will with would yeah yes you your"
).split()

#: Words that a cell of a table uses for "nothing here".
EMPTY_WORDS = ("", "none", "n/a", "na", "unknown", "not stated", "not mentioned", "unclear", "null", "no")

#: What people say when they state a wish instead of showing a problem.
WANT_PATTERNS = (r"\bi wish\b", r"\bwould be (?:nice|great|good)\b", r"\bit'?d be (?:nice|great)\b", r"\bi(?:'d| would) (?:love|like|want)\b", r"\bwe(?:'d| would) (?:love|like|want)\b", r"\bif (?:only|there was|there were)\b", r"\bin an ideal world\b", r"\bwish list\b")

@dataclass(frozen=True)
class Pattern:
    """A lexicon entry that is a regular expression (matched in any case) instead of plain words."""

    regex: str


#: Category -> entries: phrases in plain words, or patterns.
LEXICON = {
    "time": ("time", "late", "wait", "hours", "minutes"),
    "paperwork": ("form", "forms", "paper", "document", "documents"),
    "people": ("team", "staff", "people", "colleague"),
    "systems": ("system", "software", "tool", "screen"),
    "money": ("cost", "price", "budget", "pay"),
    "errors": ("error", "mistake", "wrong", "problem"),
}


@dataclass(frozen=True)
class FlagRule:
    """A rule on an interviewer's utterance: its pattern, its weight, whether it also needs a question mark, and what it says."""

    pattern: str
    weight: int
    reason: str
    question: bool = False


FLAG_RULES = (
    FlagRule(r"(?i)\b(?:don'?t you|isn'?t it|wouldn'?t you|right)\b", 1, "asks for agreement", question=True),
    FlagRule(r"(?i)\b(?:our|this|the) (?:product|solution|feature|tool|platform)\b", 2, "names a solution"),
    FlagRule(r"(?i)\b(?:would you (?:use|buy|pay)|how much would you)\b", 2, "asks for a promise"),
    FlagRule(r"(?i)\b(?:imagine|what if|suppose|hypothetically)\b", 2, "hypothetical"),
    FlagRule(r"(?i)\b(?:how (?:bad|frustrating|annoying|painful)|that must be)\b", 1, "suggests a feeling", question=True),
)


@dataclass(frozen=True)
class Config:
    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    empty_words: tuple[str, ...] = EMPTY_WORDS
    want_patterns: tuple[str, ...] = WANT_PATTERNS
    lexicon: dict[str, tuple[str | Pattern, ...]] = field(default_factory=lambda: dict(LEXICON))
    flag_rules: tuple[FlagRule, ...] = FLAG_RULES
    #: Speakers that match are interviewers, whatever the metadata say.
    interviewer_pattern: str | None = None
    max_chars: int = 10_000
    overlap_turns: int = 3
    merge_gap_seconds: float = 2.0
    merge_max_chars: int = 1200
    bootstrap_reps: int = 1000
    bootstrap_seed: int = 42
    top_terms: int = 75
    cluster_distance: float = 0.35


DEFAULT = Config()
