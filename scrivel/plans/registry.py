"""The register of queries and SQL, and SQL fragments that say what the column functions do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrivel.functions import rules as R
from scrivel.functions.text import SPACES
from scrivel.plans.inputs import q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def sql_list(words) -> str:
    return ", ".join(q(w) for w in words)


def re2(pattern: str) -> str:
    """A pattern of the rules for DuckDB: flags that RE2 knows."""
    return pattern.replace("(?iu)", "(?i)")


def sql_any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {q(re2(p))})" for p in patterns) + ")"


def sql_holds(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def sql_first(column: str, table: dict[str, str]) -> str:
    """The value of the first keyword that the column holds."""
    return "CASE " + " ".join(f"WHEN contains({column}, {q(k)}) THEN {q(v)}" for k, v in table.items()) + " END"


#: Without white space of any kind at both ends.
STRIP_SQL = lambda x: f"trim({x}, {q(SPACES)})"
NOISE_SQL = lambda x: f"({STRIP_SQL(x)} = '' OR {sql_any(STRIP_SQL(x), R.NOISE)})"
LABEL_SQL = lambda x: f"({STRIP_SQL(x)} <> '' AND {sql_any(STRIP_SQL(x), R.FORM_LABELS)})"
CLEAN_SQL = lambda x: f"(NOT {NOISE_SQL(x)} AND NOT {LABEL_SQL(x)})"
FOLD_SQL = lambda x: f"lower(strip_accents({x}))"
NORM_SQL = lambda x: f"trim(regexp_replace(regexp_replace({FOLD_SQL(x)}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
#: The data lines of a text as a list.
DATA_SQL = lambda x: f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {STRIP_SQL('x')}), lambda x: {CLEAN_SQL('x')})"
NAME_SQL = lambda x: (
    f"(NOT {sql_holds(FOLD_SQL(x), [*R.NAME_PHRASES, *R.ORG_WORDS])} AND NOT regexp_matches({x}, '[@*#{{}}\\[\\]()=+<>]') AND len(list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '')) BETWEEN 2 AND 6"
    f" AND len(list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: length(w) > 15)) = 0 AND len(list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: regexp_matches(w, '^\\p{{L}}+$'))) >= 2"
    f" AND len(list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: length(w) = 1)) < 2)"
)


def mixed_lines(key: str, n: int, *options: str) -> str:
    """A text of n lines, each one of the options (SQL of both engines), in another mixture for each key."""
    steps = [1, 3, 7, 11, 17, 23, 31, 41, 53, 67, 83, 101]
    number = lambda k: f"(cast(floor({key} / {steps[k]}) as bigint) + {k} * {key})"
    cases = ["CASE " + number(k) + f" % {len(options)} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END" for k in range(n)]
    return "concat(" + ", chr(10), ".join(cases) + ")"
