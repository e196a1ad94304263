"""Text: white space, wrapping, characters, lines, numbers.

White space is ASCII white space; lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TXT_WIDTH = 72

#: Ranges of emoji and pictographs that no document font has.
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}\x{20E3}\x{1F1E6}-\x{1F1FF}]"
#: What the fonts of a fixed-layout export cover: Latin, Greek, Cyrillic, general punctuation.
COVERED = r"\x{20}-\x{7E}\x{A0}-\x{17F}\x{370}-\x{3FF}\x{400}-\x{4FF}\x{2010}-\x{2027}\x{2030}-\x{203A}\x{20AC}\x{2122}"
#: Symbols with plain stand-ins, longest first.
PORTABLE = (
    ("<=>", "<=>"), ("→", "->"), ("←", "<-"), ("↔", "<->"), ("⇒", "=>"), ("⇐", "<="), ("≤", "<="), ("≥", ">="), ("≠", "!="),
    ("≈", "~"), ("×", "x"), ("÷", "/"), ("−", "-"), ("∞", "infinity"), ("✓", "[x]"), ("✗", "[ ]"), ("•", "-"), ("…", "..."),
    ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"),
)
#: Names of Greek letters, in the order of the alphabet.
GREEK = (
    ("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("ε", "epsilon"), ("ζ", "zeta"), ("η", "eta"), ("θ", "theta"),
    ("ι", "iota"), ("κ", "kappa"), ("λ", "lambda"), ("μ", "mu"), ("ν", "nu"), ("ξ", "xi"), ("π", "pi"), ("ρ", "rho"),
    ("σ", "sigma"), ("τ", "tau"), ("φ", "phi"), ("χ", "chi"), ("ψ", "psi"), ("ω", "omega"),
)


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space as one space; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def word_count(c: Column) -> Column:
    """Words divided by white space; 0 for blank and null."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def wrap_line(line: Column, width: int = TXT_WIDTH, indent: str = "") -> Column:
    """One input line as an array of output lines; words are never split."""
    limit = max(width - len(indent), 1)
    words = F.filter(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, w: Column) -> Column:
        fits = F.length(acc["now"]) + 1 + F.length(w) <= limit
        return (
            F.when(acc["now"] == "", F.struct(acc["done"].alias("done"), w.alias("now")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit(" "), w).alias("now")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), w.alias("now")))
        )

    lines = F.aggregate(words, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return F.transform(lines, lambda x: F.concat(F.lit(indent), x))


def wrap_text(c: Column, width: int = TXT_WIDTH, indent: str = "") -> Column:
    """All lines of a text, wrapped, as an array."""
    return F.flatten(F.transform(F.split(c, "\n"), lambda x: wrap_line(x, width, indent)))


def wrap_prose(c: Column, width: int = TXT_WIDTH) -> Column:
    """Wrapped lines, but for fenced, table and indented ones, which stay as they are."""
    fence = lambda x: F.trim(x).rlike(r"^(```|~~~)")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("inside"))

    def step(acc: Column, x: Column) -> Column:
        raw = fence(x) | acc["inside"] | F.trim(x).startswith("|") | x.startswith("    ") | x.startswith("\t")
        return F.struct(
            F.concat(acc["out"], F.when(raw, F.array(x)).otherwise(wrap_line(x, width))).alias("out"),
            (acc["inside"] != fence(x)).alias("inside"),
        )

    return F.aggregate(F.split(c, "\n"), start, step, lambda acc: acc["out"])


def isolated_greek(c: Column) -> Column:
    """Greek letters that stand alone, by name."""
    for letter, name in GREEK:
        c = F.regexp_replace(c, f"(?<![\\x{{370}}-\\x{{3FF}}]){letter}(?![\\x{{370}}-\\x{{3FF}}])", name)
    return c


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


def portable_characters(c: Column) -> Column:
    """Symbols replaced by their stand-ins, longest first."""
    for symbol, plain in PORTABLE:
        c = F.replace(c, F.lit(symbol), F.lit(plain))
    return c


def unsupported_script(c: Column) -> tuple[Column, Column]:
    """Characters that the fonts don't cover as ``?``, and whether there were any."""
    shown = F.regexp_replace(c, f"[^{COVERED}\\x{{0}}-\\x{{1F}}]", "?")
    return shown, shown != c  # as fonts cover the ``?`` itself


def xml_safe(c: Column) -> Column:
    """Characters that XML 1.0 forbids as U+FFFD."""
    return F.regexp_replace(c, r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]", "�")


def strict_strikethrough(c: Column) -> Column:
    """``~~x~~`` as ``<del>x</del>``; single tildes are text."""
    return F.regexp_replace(c, r"~~([^~\n]+)~~", "<del>$1</del>")


def parse_span(c: Column) -> Column:
    """A rowspan or colspan: 1 for what isn't a number or below 1, 1000 at most."""
    n = F.expr("NULL").cast("int") if c is None else F.coalesce(c.try_cast("int"), F.lit(1))
    return F.least(F.greatest(n, F.lit(1)), F.lit(1000))


def format_number(c: Column, separator: str = ",") -> Column:
    """Thousands grouped."""
    out = F.format_number(c, 0)
    return out if separator == "," else F.replace(out, F.lit(","), F.lit(separator))


def format_duration(seconds: Column) -> Column:
    """``M:SS`` or ``H:MM:SS`` of rounded seconds, 0 at least; null stays null."""
    s = F.when(seconds.isNotNull(), F.greatest(F.floor(seconds + 0.5).cast("long"), F.lit(0)))
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest))).otherwise(
        F.concat(minutes.cast("string"), F.lit(":"), two(rest))
    )


def initcap_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def resolve_message(pinned: Column, english: Column, key: Column) -> Column:
    """Pinned language, else English, else the key; blank messages count as absent."""
    return F.coalesce(F.nullif(pinned, F.lit("")), F.nullif(english, F.lit("")), key)


def substitute(message: Column, values: list[Column]) -> Column:
    """``$1`` ... ``$9`` by position, ``$$`` as a dollar sign; places without a value stay."""
    mark = "\x01"
    out = F.replace(message, F.lit("$$"), F.lit(mark))
    for i, v in enumerate(values, 1):
        out = F.replace(out, F.lit(f"${i}"), v)
    return F.replace(out, F.lit(mark), F.lit("$"))
