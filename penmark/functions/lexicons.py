"""Word lists, patterns and thresholds that results depend on.

Fixed values: they must stay as they are for scores to be comparable.
"""

from __future__ import annotations

TRANSITION_PHRASES = (
    "furthermore", "moreover", "additionally", "besides", "likewise", "consequently", "therefore", "thus", "hence", "accordingly",
    "in conclusion", "to conclude", "finally", "lastly", "in contrast", "however", "nevertheless", "nonetheless", "on the other hand",
    "conversely", "similarly", "for example", "for instance", "specifically", "in particular", "in addition", "equally", "meanwhile",
)
FUNCTION_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on",
    "off", "over", "under", "again", "further", "once", "here", "there", "when", "where", "why", "how", "all", "each", "every", "both",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just",
)
COUNTED_FUNCTION_WORDS = ("the", "and", "of", "to", "a", "in", "that", "is", "was", "it")
SENTENCE_TRANSITIONS = (
    "furthermore", "moreover", "additionally", "however", "therefore", "thus", "consequently", "nevertheless", "meanwhile", "similarly",
    "conversely", "specifically", "in conclusion", "finally", "lastly", "in contrast", "on the other hand", "for example", "for instance",
    "in addition", "as a result", "accordingly",
)
ADVANCED_WORDS = (
    "furthermore", "moreover", "consequently", "nevertheless", "nonetheless", "accordingly", "subsequently", "predominantly", "predominant",
    "substantial", "significant", "comprehensive", "fundamental", "inherent", "intrinsic", "paradigm",
)
HEDGING_WORDS = (
    "might", "may", "could", "would", "possibly", "probably", "suggest", "indicate", "appear", "seem", "potentially", "approximately",
    "roughly", "generally", "typically",
)
CERTAINTY_WORDS = ("definitely", "certainly", "obviously", "clearly", "prove", "demonstrate", "establish", "confirm", "always", "never")
CITATIONS = (r"\([A-Z][a-z]+,?\s*\d{4}[a-z]?\)", r"\[[A-Z][a-z]+,?\s*\d{4}[a-z]?\]", r"\d+\s*\(\d{4}\)")
SUSPICIOUS_CITATION = r"\d{4}\)|[A-Z]\.\s*[A-Z]\."
LATIN_ABBREVIATIONS = (r"\be\.g\.", r"\bi\.e\.", r"\bet\s+al\.", r"\bvs\.", r"\bapprox\.")
PASSIVE = r"\b(was|were|been|being)\s+\w+ed\b"
VAGUE_NAMES = ("result", "data", "item", "value", "temp", "tmp", "arr", "list", "dict", "obj", "info", "res")
BRANCHING_KEYWORDS = ("if", "elif", "else", "for", "while", "try", "except", "finally", "and", "or")
PUNCTUATION = {
    "comma": ",", "semicolon": ";", "colon": ":", "exclamation": "!", "question": r"\?", "dash": "-", "quotes_double": '"',
    "quotes_single": "'", "parenthetical": r"\([^)]*\)",
}
LANGUAGE_FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "zh": "cjk", "ja": "cjk", "ko": "cjk", "ru": "cyrillic", "uk": "cyrillic", "ar": "semitic", "he": "semitic",
}
FAMILY_THRESHOLDS = {"germanic": 0.35, "romance": 0.40, "cjk": 0.25, "cyrillic": 0.35, "semitic": 0.30}
DEFAULT_FAMILY_THRESHOLD = 0.35

#: Common short words of the languages that the rule-based identification tells apart.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "is", "that", "with", "was"),
    "de": ("der", "die", "und", "das", "nicht", "von", "den", "für"),
    "fr": ("le", "la", "les", "et", "des", "que", "qui", "pour"),
    "es": ("el", "los", "las", "que", "y", "por", "una", "del"),
}
