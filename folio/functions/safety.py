"""Rules that screen questions and answers, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of personal data in the order in which they are reported.
PERSONAL = {
    "phone": r"(?:\+61\s?|0)(?:[2-478]|\(0[2-478]\))\s?\d{4}\s?\d{4}|04\d{2}\s?\d{3}\s?\d{3}",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "credit_card": r"\b(?:\d{4}[\s-]?){3}\d{4}\b",
    "tfn": r"(?i)\bTFN[:\s]+\d{3}[\s-]\d{3}[\s-]\d{3}\b",
    "address": r"(?i)\d+\s+[A-Za-z\s]+(?:Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Court|Ct|Lane|Ln|Way|Terrace|Tce),\s*[A-Za-z\s]+(?:NSW|VIC|QLD|SA|WA|TAS|NT|ACT)\s+\d{4}",
}
# Patterns of attempts to override instructions.
OVERRIDES = [
    r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions|commands|rules)",
    r"you\s+are\s+now\s+(?:a|an)",
    r"disregard\s+(?:all|any|the)",
    r"(?:system|assistant):\s*",
    r"```|\[/INST\]|</s>|\[SYSTEM\]",
    r"forget\s+(?:all|everything|your)",
    r"new\s+(?:instruction|command|rule)",
]
# Phrases that are never acceptable.
PHRASES = ["fuck", "shit", "commit suicide", "kill myself", "make a bomb", "build a weapon"]

#: What takes the place of a blocked question's or answer's text.
BLOCKED_QUERY = "This question was not processed for safety reasons."
BLOCKED_ANSWER = "This answer was withheld for safety and privacy reasons. Please rephrase the question."


def personal_data(text: Column) -> Column:
    """The kinds of personal data found, in a fixed order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(kind)) for kind, p in PERSONAL.items()]), lambda x: x.isNotNull())


def overrides_instructions(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in OVERRIDES)), F.lit(False))


def is_toxic(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(r"\b(?:" + "|".join(re.escape(p).replace("\\ ", " ") for p in PHRASES) + r")\b"), F.lit(False))


def verdict(text: Column, question: bool = True) -> Column:
    """struct(is_safe, violations, details, confidence); answers are not searched for overrides."""
    kinds = personal_data(text)
    rules = [F.when(F.size(kinds) > 0, F.concat(F.lit("pii:"), F.array_join(kinds, ",")))]
    if question:
        rules.append(F.when(overrides_instructions(text), F.lit("prompt_injection")))
    rules.append(F.when(is_toxic(text), F.lit("toxic_content")))

    def judged(found: Column) -> Column:
        safe = F.size(found) == 0
        return F.struct(
            safe.alias("is_safe"),
            found.alias("violations"),
            F.when(~safe, F.array_join(found, "; ")).alias("details"),
            F.when(safe, F.lit(0.95)).otherwise(F.lit(1.0)).alias("confidence"),
        )

    # through an array of one, so that every pattern is tried once although its result is named several times
    return F.transform(F.array(F.filter(F.array(*rules), lambda x: x.isNotNull())), judged)[0]
