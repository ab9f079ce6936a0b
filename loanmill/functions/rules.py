"""Record validation: one ordered rule list drives the checks, the casts and the reasons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. \A and \z because Java's $ also matches before a final newline.
INTEGER_TEXT = r"\A[0-9]+\z"
DECIMAL_TEXT = r"\A[0-9]+(\.[0-9]+)?\z"
FLAG_TEXT = r"\A[0-1]\z"

_LARGEST = 1.7976931348623157e308


def _not_negative(x: Column) -> Column:
    return x.between(0, _LARGEST)


def _positive(x: Column) -> Column:
    return (x > 0) & (x <= _LARGEST)


def _score_range(x: Column) -> Column:
    return x.between(300, 850)


@dataclass(frozen=True)
class Rule:
    """Format of one text column, its type, and the values allowed once cast."""

    column: str
    pattern: str
    type: str
    accepts: Callable[[Column], Column] | None = None
    format_says: str = "format"
    value_says: str = "value"

    def text(self) -> Column:
        return F.col(self.column)

    def typed(self) -> Column:
        return self.text().try_cast(self.type)

    def format_ok(self) -> Column:
        return self.text().rlike(self.pattern)

    def value_ok(self) -> Column:
        """Null for a null text; false when the text does not fit the type."""
        return F.coalesce(self.accepts(self.typed()), F.when(self.text().isNotNull(), False))

    def failed(self) -> list[Column]:
        """The definite failures: of the format, then of the value."""
        return [~self.format_ok()] + ([~self.value_ok()] if self.accepts else [])

    def words(self) -> list[str]:
        """What the reason says before the text, for each of `failed`."""
        says = [self.format_says] + ([self.value_says] if self.accepts else [])
        return [f"Invalid {self.column} {word}".rstrip() + ": " for word in says]


# The columns checked, in the order in which a reason is looked for.
RULES = [
    Rule("person_age", INTEGER_TEXT, "int", _not_negative),
    Rule("person_income", DECIMAL_TEXT, "double", _not_negative),
    Rule("person_emp_exp", INTEGER_TEXT, "int", _not_negative),
    Rule("loan_amnt", DECIMAL_TEXT, "double", _positive),
    Rule("loan_int_rate", DECIMAL_TEXT, "double", _not_negative),
    Rule("loan_percent_income", DECIMAL_TEXT, "double", _not_negative),
    Rule("cb_person_cred_hist_length", INTEGER_TEXT, "int", _not_negative),
    Rule("credit_score", DECIMAL_TEXT, "double", _score_range, value_says="range"),
    Rule("loan_status", FLAG_TEXT, "int", format_says=""),
]


def failure_number() -> Column:
    """Position (from 1) of the first check that definitely fails, else null.

    A number and not the text itself: a chain of 17 concatenations grows the generated
    method past what the JVM compiles.
    """
    first, *rest = (failed for rule in RULES for failed in rule.failed())
    case = F.when(first, 1)
    for number, failed in enumerate(rest, start=2):
        case = case.when(failed, number)
    return case


def failure_text(number: Column) -> Column:
    """The reason that belongs to a `failure_number`."""
    words = F.array(*(F.lit(w) for rule in RULES for w in rule.words()))
    texts = F.array(*(rule.text() for rule in RULES for _ in rule.words()))
    return F.concat(F.try_element_at(words, number), F.try_element_at(texts, number))


def outcome(number: Column) -> Column:
    """'reject' when a check definitely fails; 'valid' when all hold; 'unclassified'
    when nothing fails but a checked text is null (neither side takes such a row)."""
    complete = reduce(lambda a, b: a & b, (r.text().isNotNull() for r in RULES))
    return (
        F.when(number.isNotNull(), "reject")
        .when(complete, "valid")
        .otherwise("unclassified")
    )


def all_hold() -> Column:
    """True, false or null (undecided) as the conjunction of all checks is."""
    checks = [r.format_ok() for r in RULES] + [r.value_ok() for r in RULES if r.accepts]
    return reduce(lambda a, b: a & b, checks)
