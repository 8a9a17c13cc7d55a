"""Requisition numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailfold import fixed
from mailfold.functions.text import digits, grab, let, matches, strip, sub


def _long_enough(token: Column) -> Column:
    return F.when(digits(token) >= fixed.REQ_MIN_DIGITS, token)


def extract_requisition(subject: Column, body: Column) -> Column:
    """Labelled number, id label, mixed token, then a dash-set-off number in the subject."""

    def ladder(text: Column) -> Column:
        def numbers(low: Column) -> Column:
            return F.coalesce(
                let(grab(text, fixed.REQ_LABELLED, low=low), _long_enough),
                let(grab(text, fixed.REQ_ID_LABEL, low=low), _long_enough),
                grab(text, fixed.REQ_MIXED),
            )

        # every number has a digit
        return F.coalesce(
            F.when(text.rlike("[0-9]"), let(F.lower(text), numbers)),
            let(grab(subject, fixed.REQ_DASHED, low=subject), _long_enough),
        )

    return let(F.concat(subject, F.lit("\n"), body), ladder)


def canonical_requisition(raw: Column) -> Column:
    """One token with enough digits once label words are gone, else null."""
    token = sub(strip(raw), r"^#\s*", "")
    token = strip(sub(token, fixed.REQ_LABEL_PREFIX, ""))
    return let(token, lambda t: F.when(matches(t, fixed.REQ_VALID), _long_enough(t)))
