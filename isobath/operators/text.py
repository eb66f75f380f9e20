"""Keyword queries over several text columns, and chat history."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_keywords(query: str) -> list[list[tuple[str, bool]]]:
    """Groups of (term, wanted) joined by OR in any case; a quoted phrase is one literal term, an empty one stands in every text, a leading - negates."""
    groups: list[list[tuple[str, bool]]] = [[]]
    for part in re.finditer(r'"([^"]*)"|(\S+)', query):
        phrase, plain = part.groups()
        if phrase is not None:
            groups[-1].append((phrase.lower(), True))
        elif plain.upper() == "OR":
            groups.append([])
        elif plain.startswith("-") and len(plain) > 1:
            groups[-1].append((plain[1:].lower(), False))
        else:
            groups[-1].append((plain.lower(), True))
    return [g for g in groups if g]


def matches(query: str, fields: list[str]) -> Column:
    """Whether the fields, lower-cased and kept apart, satisfy the query; an empty query holds everywhere."""
    groups = parse_keywords(query)
    if not groups:
        return F.lit(True)
    hay = F.lower(F.concat_ws("\x01", *fields))

    def term(t: str, wanted: bool) -> Column:
        found = F.contains(hay, F.lit(t))
        return found if wanted else ~found

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [term(*t) for t in g]) for g in groups])


def last_messages(chat: DataFrame, n: int = 20) -> DataFrame:
    """The last n user and assistant messages of each conversation, oldest first by turn."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return chat.filter(F.col("role").isin("user", "assistant")).withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)
