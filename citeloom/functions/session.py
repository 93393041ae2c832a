"""The expressions of this package as SQL functions of a session.

A SQL function's body is an expression or a query in SQL, so a call is expanded where it stands and optimised with the rest
of the query; nothing runs outside the JVM.  Bodies are the column expressions themselves, written out as SQL: there is one
definition of each rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import references as E

_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'")
_OPERATOR = re.compile(r"(?<![\w`.])([<>=!+\-*/%&|^~]+|and|or|not)(?=\()", re.IGNORECASE)


def as_sql(value: Column) -> str:
    """A column expression as SQL: operators, which print as calls, become calls of the functions they are."""
    text = value._jc.node().sql()
    parts, at = [], 0
    for literal in _LITERAL.finditer(text):
        parts += [_OPERATOR.sub(r"`\1`", text[at:literal.start()]), literal.group()]
        at = literal.end()
    return "".join([*parts, _OPERATOR.sub(r"`\1`", text[at:])])


def scalar_functions() -> dict[str, tuple[str, str, Column]]:
    """Name to (arguments, type, expression)."""
    text, number = F.col("text"), F.col("number")
    return {
        "redact": ("text STRING", "STRING", T.redact(text)),
        "clean_title": ("text STRING, number STRING", "STRING", T.clean_title(text, number)),
        "normalise": ("text STRING", "STRING", T.normalise(text)),
        "term_key": ("text STRING", "STRING", T.term_key(text)),
        "reference_key": ("text STRING", "STRING", T.reference_key(text)),
        "citation_excerpt": ("text STRING", "STRING", T.excerpt(text)),
        "token_set": ("text STRING", "ARRAY<STRING>", T.token_set(text)),
        "legal_sentences": ("text STRING", "ARRAY<STRING>", T.sentences(text)),
    }


def table_functions() -> dict[str, tuple[str, str, Column]]:
    """Name to (arguments, columns, array of structs that gives the rows)."""
    return {"act_mentions": ("text STRING", "kind INT, at INT, title STRING, number STRING", E.mention_array(F.col("text")))}


def register(spark: SparkSession) -> None:
    """Create the functions in the session: ``SELECT redact(text)``, ``SELECT m.* FROM t, LATERAL act_mentions(t.text) m``."""
    for name, (arguments, kind, value) in scalar_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {as_sql(value)}")
    for name, (arguments, columns, value) in table_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) "
                  f"RETURN SELECT inline({as_sql(value)})")
