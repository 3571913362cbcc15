"""Text quality, headings and page cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Subjects that make a short line a heading.
SUBJECTS = ["inflation", "labour market", "economic outlook", "forecast", "gdp", "unemployment", "wages", "financial conditions", "housing", "consumption", "investment", "trade", "monetary policy"]
# Lines that are a page's header or footer.
HEADER_LINES = [
    r"(?i)^\s*\d+\s+Reserve Bank of Australia\s*$",
    r"(?i)^\s*Page\s+\d+(\s+of\s+\d+)?\s*$",
    r"(?i)^\s*S\s*T\s*A\s*T\s*E\s*M\s*E\s*N\s*T.*P\s*O\s*L\s*I\s*C\s*Y\s*$",
    r"(?i)^\s*Financial\s+Stability\s+Review\s*$",
    r"^\s*[A-Z][a-z]+\s+20\d{2}\s*$",
    r"(?i)^\s*ANNUAL\s+REPORT\s+\d{4}\s*$",
]
FOOTER_LINES = [
    r"(?i)^\s*www\.rba\.gov\.au\s*$",
    r"(?i)^\s*©\s*Reserve Bank.*20\d{2}\s*$",
    r"(?i)^\s*\d{4}\s+Reserve\s+Bank\s*$",
    r"^\s*-?\s*\d+\s*-?\s*$",
]
#: White space as Unicode has it, for trimming and splitting.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
#: Ends of lines in page text.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def chunk_quality(text: Column) -> Column:
    """A score in 0..1: sentences of usual length, neither too short nor too long, few special characters."""
    words = F.regexp_count(text, F.lit(f"[^{SPACE[1:-1]}]+"))
    ends = F.length(text) - F.length(F.translate(text, ".!?", ""))
    odd = F.regexp_count(text, F.lit(rf"[^\p{{L}}\p{{N}}{SPACE[1:-1]}]"))

    def score(c: Column) -> Column:
        rate = c["words"] / F.greatest(F.lit(1), c["ends"])
        return (
            F.when(c["words"] == 0, 1.0).when(rate > 100, 0.7).when(rate < 5, 0.8).otherwise(1.0)
            * F.when(c["words"] < 50, 0.6).when(c["words"] > 2000, 0.9).otherwise(1.0)
            * F.when(c["odd"] / c["n"] > 0.3, 0.7).otherwise(1.0)
        )

    # the counts pass through a list of one, so that each is made once however often the score names it
    counts = F.array(F.struct(words.alias("words"), ends.alias("ends"), odd.alias("odd"), F.length(text).alias("n")))
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 10, 0.0).otherwise(F.get(F.transform(counts, score), F.lit(0)))


def subject_heading(text: Column) -> Column:
    """The first of a text's first five lines that is a heading on a known subject or numbered, or null."""
    lines = F.transform(F.slice(F.split(F.substring(text, 1, 500), "\n"), 1, 5), lambda x: F.trim(x))

    def heading(line: Column) -> Column:
        words = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
        low = F.lower(line)
        named = F.exists(F.array(*[F.lit(s) for s in SUBJECTS]), lambda s: F.contains(low, s))
        return (line != "") & ((named & words.between(1, 6)) | line.rlike(r"^\d+[.)]\s+[A-Z]"))

    return F.get(F.filter(lines, heading), F.lit(0))


def is_page_furniture(line: Column) -> Column:
    """Whether a stripped line is a known header or footer."""
    found = F.lit(False)
    for p in [*HEADER_LINES, *FOOTER_LINES]:
        found = found | line.rlike(p)
    return (line != "") & found


def clean_page(text: Column, repeated: Column | None = None) -> Column:
    """The paragraphs of a page without headers and footers; lines of a paragraph are joined by a space.

    Blank lines end a paragraph; a dropped header or footer does not. `repeated`: further lines to drop.
    """
    lines = F.transform(F.split(text, LINE_ENDS), stripped)
    kept = F.filter(lines, lambda x: ~is_page_furniture(x))
    if repeated is not None:
        kept = F.filter(kept, lambda x: (x == "") | ~F.array_contains(F.coalesce(repeated, F.array().cast("array<string>")), x))
    joined = F.array_join(F.transform(kept, lambda x: F.when(x == "", F.lit("\x01")).otherwise(x)), "\x02")
    paragraphs = F.split(joined, "(?:\x02?\x01\x02?)+")
    return F.array_join(F.filter(F.transform(paragraphs, lambda p: F.translate(p, "\x02", " ")), lambda p: p != ""), "\n\n")


def content_hash(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def keyword_match(keywords: Column, answer: Column) -> Column:
    """The share of keywords that the answer contains in any case; 1 if there are none."""
    # both are lowered once, not for each keyword
    both = F.array(F.struct(lowered(keywords).alias("keywords"), F.lower(F.coalesce(answer, F.lit(""))).alias("answer")))
    return F.get(F.transform(both, lambda x: lowered_match(x["keywords"], x["answer"])), F.lit(0))


def lowered(keywords: Column) -> Column:
    return F.transform(keywords, F.lower)


def lowered_match(keywords: Column, answer: Column) -> Column:
    """keyword_match for keywords and an answer that are in lower case."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(answer, k)))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) < 1, 1.0).otherwise(hits / F.size(keywords))
