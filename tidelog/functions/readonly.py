"""Read-only test for SQL text, over a column of statements or one statement."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# How a statement may start and the words it may not hold.
READ_PREFIXES = ("select", "show", "describe", "explain")
WRITE_WORDS = (
    "insert", "update", "delete", "drop", "create",
    "alter", "truncate", "rename", "replace", "merge",
)

# Fixed value: the white space that is skipped before a statement.
LEADING_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Word boundaries are ASCII ones: a letter such as 'é' ends a word.
_WRITES = "(?<![a-z0-9_])(" + "|".join(WRITE_WORDS) + ")(?![a-z0-9_])"
_ESCAPED_CHAR = r"(?s)\\."
_LITERAL = r"'[^']*'"

# Doors that Spark SQL leaves open beside the words above: calls into the JVM, names put
# together at run time, and external scripts (USING followed by anything but a column
# list). The test looks at
# the whole text, comments and quoted text included, so it may refuse too much.
_JVM_CALL = re.compile(r"(?<![a-z0-9_])(reflect|try_reflect|java_method|identifier)(?![a-z0-9_])")
_SCRIPT = re.compile(r"(?<![a-z0-9_])using(?![a-z0-9_])(?!\s*\()")


class NotReadOnlyError(ValueError):
    """The statement is not a plain read."""


def is_read_only(sql: Column, ignore_literals: bool = False) -> Column:
    """Whether a statement starts as a read and holds none of the write words."""
    text = F.lower(F.ltrim(sql, F.lit(LEADING_SPACE)))
    words = text
    if ignore_literals:
        words = F.regexp_replace(F.regexp_replace(text, _ESCAPED_CHAR, ""), _LITERAL, "''")
    starts = reduce(or_, [text.startswith(prefix) for prefix in READ_PREFIXES])
    return starts & ~words.rlike(_WRITES)


def statement_is_read_only(sql: str, ignore_literals: bool = False) -> bool:
    text = sql.lstrip(LEADING_SPACE).lower()
    words = re.sub(_LITERAL, "''", re.sub(_ESCAPED_CHAR, "", text)) if ignore_literals else text
    return text.startswith(READ_PREFIXES) and not re.search(_WRITES, words)


def assert_read_only(sql: str, ignore_literals: bool = False) -> None:
    """Raise unless the statement passes the read-only test and uses no side door."""
    if not statement_is_read_only(sql, ignore_literals):
        raise NotReadOnlyError("only plain reads are allowed: this statement does not start as one or holds a write word")
    text = sql.lower()
    if _JVM_CALL.search(text) or _SCRIPT.search(text):
        raise NotReadOnlyError("the statement reaches for code outside Spark SQL")


# Nodes of a resolved plan that run code outside Spark SQL, however they were written.
_OUTSIDE = re.compile(r'"class":"[\w.]*\.(CallMethodViaReflection|TryReflect|ScriptTransformation|PythonUDF|ScalaUDF)"')


def assert_plan_inside(df: DataFrame) -> None:
    """Raise if the resolved statement calls the JVM, a script or a registered function."""
    if _OUTSIDE.search(df._jdf.queryExecution().analyzed().toJSON()):
        raise NotReadOnlyError("the statement reaches for code outside Spark SQL")
