"""Answer letters and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rule.
TOKEN_BUDGET = 5_000_000
BASE_WEIGHT, TOKEN_WEIGHT = 0.7, 0.3


def normalize_answer(raw: Column, answer_format: Column) -> Column:
    """The first letter A-D (A-B for ``tf``); for ``multi`` all of them, distinct and sorted. Capitals that stand in no Latin word or number count; none gives empty.

    For ``multi``, a run of capitals A-D like ``ACD`` counts too.
    """
    text = F.coalesce(raw, F.lit(""))
    alone = F.regexp_extract(text, "(?<![A-Za-z0-9])([A-D])(?![A-Za-z0-9])", 1)
    truth = F.regexp_extract(text, "(?<![A-Za-z0-9])([AB])(?![A-Za-z0-9])", 1)
    runs = F.array_join(F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9])([A-D]+)(?![A-Za-z0-9])"), F.lit(1)), "")
    many = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(runs, F.lit("[A-D]"), F.lit(0)))), "")
    return F.when(answer_format == "multi", many).when(answer_format == "tf", truth).otherwise(alone)


def is_valid_answer(answer: Column, answer_format: Column) -> Column:
    """One letter A-D, for ``tf`` A or B, for ``multi`` letters in order; other formats have no valid answer."""
    ok = F.when(answer_format == "mcq", answer.rlike(r"^[A-D]\z")).when(answer_format == "tf", answer.rlike(r"^[AB]\z")).when(answer_format == "multi", answer.rlike(r"^A?B?C?D?\z") & (answer != ""))
    return F.coalesce(ok, F.lit(False))


def token_score(tokens: Column, budget: int = TOKEN_BUDGET) -> Column:
    """Share of the token budget that is left, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(budget) - tokens) / F.lit(float(budget))))


def final_score(accuracy: Column, tokens: Column, budget: int = TOKEN_BUDGET) -> Column:
    return F.lit(100.0) * accuracy * (F.lit(BASE_WEIGHT) + F.lit(TOKEN_WEIGHT) * token_score(tokens, budget))


def json_object(text: Column, schema: str) -> Column:
    """The object that model text holds, from its first to its last brace; null if it isn't one."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})
