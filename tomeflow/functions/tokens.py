"""Terms for lexical search, and texts built from questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM_PROMPT = "Answer the question from the evidence only. Reply with a JSON object: answer, and evidence as a list of doc_id, quoted_clause and reasoning."


def tokenize(text: Column) -> Column:
    """Lower-cased words and numbers, and every two neighbouring CJK characters (a lone one as it is)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    runs = F.regexp_extract_all(t, F.lit(r"\p{IsHan}+"), F.lit(0))

    def pairs(run: Column) -> Column:
        return F.when(F.length(run) < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))

    two_up = F.flatten(F.transform(runs, pairs))
    return F.concat(words, two_up)


def query_text(question: Column, options: Column) -> Column:
    """The question and the texts of its options, in the options' order."""
    return F.concat_ws(" ", question, F.array_join(F.map_values(options), " "))


def user_prompt(question: Column, options: Column, answer_format: Column, blocks: Column) -> Column:
    """Evidence, question, options and format as one text."""
    listed = F.array_join(F.transform(F.map_entries(options), lambda o: F.concat(o["key"], F.lit(". "), o["value"])), "\n")
    return F.concat(F.lit("Evidence:\n"), F.array_join(blocks, "\n\n"), F.lit("\n\nQuestion ("), answer_format, F.lit("): "), question, F.lit("\n"), listed)
