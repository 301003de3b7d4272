"""Splitting scripts into statements, syntax checks and classification."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Statement:
    """A statement's text, its first line (from 1) and its place in the script."""

    text: str
    line: int
    start: int


_DOLLAR = re.compile(r"\$(?:[A-Za-z_]\w*)?\$")


def split(script: str, dialect: str = "ansi") -> list[Statement]:
    """Cut a script at its delimiters outside of quotes, comments and dollar quotes.

    ``dialect``: ``mssql`` also cuts at lines that are ``GO``; ``mysql`` follows ``DELIMITER`` lines and lets a backslash
    escape a quote. Comments alone make no statement.
    """
    out: list[Statement] = []
    delimiter, at, begin, n = ";", 0, 0, len(script)

    def close(end: int) -> None:
        text = script[begin:end]
        if _code(text):
            lead = re.match(r"(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*", text, re.S).end()  # the line of the first word, not of a comment before it
            out.append(Statement(text.strip(), script.count("\n", 0, begin + lead) + 1, begin + lead))

    while at < n:
        c = script[at]
        line_start = at == 0 or script[at - 1] == "\n"
        if line_start and dialect == "mssql" and (m := re.compile(r"[ \t]*GO[ \t]*(?:\d+)?[ \t]*(?=\n|$)", re.I).match(script, at)):
            close(at)
            at = begin = m.end()
        elif line_start and dialect == "mysql" and (m := re.compile(r"[ \t]*DELIMITER[ \t]+(\S+)[ \t]*(?:\n|$)", re.I).match(script, at)):
            close(at)
            delimiter, at = m[1], m.end()
            begin = at
        elif script.startswith("--", at) or (c == "#" and dialect == "mysql"):
            at = (script.find("\n", at) + 1) or n
        elif script.startswith("/*", at):
            at = (script.find("*/", at + 2) + 2) if "*/" in script[at + 2 :] else n
        elif c in "'\"`" or (c == "[" and dialect == "mssql"):
            at = _quoted(script, at, "]" if c == "[" else c, dialect == "mysql" and c != "`")
        elif c == "$" and (m := _DOLLAR.match(script, at)):
            end = script.find(m[0], m.end())
            at = n if end < 0 else end + len(m[0])
        elif script.startswith(delimiter, at):
            close(at)
            at = begin = at + len(delimiter)
        else:
            at += 1
    close(n)
    return out


def _quoted(script: str, at: int, mark: str, escapes: bool) -> int:
    at += 1
    while at < len(script):
        if escapes and script[at] == "\\":
            at += 2
        elif script[at] == mark:
            if script[at + 1 : at + 2] == mark:
                at += 2
            else:
                return at + 1
        else:
            at += 1
    return at


def _code(text: str) -> bool:
    return bool(re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).strip())


@dataclass(frozen=True)
class Diagnostic:
    """What is wrong with a statement and where in it."""

    message: str
    line: int
    column: int


def check(spark: SparkSession, sql: str) -> list[Diagnostic]:
    """Syntax errors of a statement by Spark's own parser; none if it parses."""
    from pyspark.errors import ParseException

    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        text = str(error if isinstance(error, ParseException) else getattr(error, "java_exception", error))
        where = re.search(r"line (\d+), pos (\d+)", text)
        return [Diagnostic(text.strip().splitlines()[0][:300], int(where[1]) if where else 1, int(where[2]) + 1 if where else 1)]
    return []


#: First words of each kind of statement.
KINDS = {
    "DQL": "select with values table from",
    "DML": "insert update delete merge replace upsert load copy",
    "DDL": "create alter drop truncate rename comment",
    "INFO": "show describe desc explain",
    "SESSION": "set use reset",
    "TRANSACTION": "begin commit rollback savepoint start",
    "CALL": "call execute exec",
    "STATS": "analyze refresh",
    "DCL": "grant revoke",
}


def classify(sql: str) -> str:
    """The kind of a statement; ``SELECT .. INTO`` is DDL, and a CTE counts by what it feeds."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().lstrip("(").lower()
    text = re.sub(r"'(?:[^']|'')*'", "''", text)
    word = (re.match(r"[a-z]+", text) or [""])[0]
    if word == "with":
        depth, at = 0, 0
        for m in re.finditer(r"[()]|\b(insert|update|delete|merge|select)\b", text):
            depth += {"(": 1, ")": -1}.get(m[0], 0)
            if depth == 0 and m[1]:
                at = m.start()
                break
        word, text = (re.match(r"[a-z]+", text[at:]) or ["with"])[0], text[at:]
    if word == "select" and re.search(r"\binto\s+(?!outfile|dumpfile)[\w.\[\]\"`#@]+\s+from\b", text):
        return "DDL"
    return next((kind for kind, words in KINDS.items() if word in words.split()), "UNKNOWN")


def with_limit(sql: str, most: int) -> str:
    """A query whose result has at most ``most`` rows."""
    return f"SELECT * FROM ({sql.rstrip().rstrip(';')}) AS limited LIMIT {int(most)}"


#: Text, names and comments, in which nothing is rewritten.
_KEPT = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", re.S)
#: Words that Spark's parser lacks and that change no rows, and what stands in their place.
DIALECT = {
    r"\bAS\s+(?:NOT\s+)?MATERIALIZED(?=\s*\()": "AS",
    r"\bSELECT\s+STRAIGHT_JOIN\b": "SELECT",
    r"\bSTRAIGHT_JOIN\b": "JOIN",
    r"\bDIRECTED\s+JOIN\b": "JOIN",
    r"\bALLOW\s+FILTERING\b": "",
    r"\bTOKEN\s*\(": "xxhash64(",
    r"\bUSING\s*<(?![=<>])": "ASC",
    r"\bUSING\s*>(?![=<>])": "DESC",
}


def _code_only(sql: str) -> str:
    """The text with quoted parts and comments left out."""
    return _KEPT.sub(" ", sql)


def adapted(sql: str) -> str:
    """A statement of another dialect without the words that only tell its engine how to run it."""
    parts = _KEPT.split(sql)
    for k in range(0, len(parts), 2):
        for pattern, new in DIALECT.items():
            parts[k] = re.sub(pattern, new, parts[k], flags=re.I)
    return "".join(parts)


def mixed_chain(sql: str) -> bool:
    """Whether a chain of set operations mixes them without parentheses, which strict dialects refuse."""
    chains: list[set[str]] = [set()]
    for m in re.finditer(r"[();]|\b(UNION|INTERSECT|EXCEPT|MINUS)\b(?:\s+(ALL)\b)?", _code_only(sql), re.I):
        if m[0] == "(":
            chains.append(set())
        elif m[0] == ")":
            chains.pop() if len(chains) > 1 else chains[0].clear()
        elif m[0] == ";":
            chains = [set()]
        else:
            chains[-1].add(f"{m[1]} {m[2] or ''}".upper().replace("MINUS", "EXCEPT"))
            if len(chains[-1]) > 1:
                return True
    return False


def run_script(spark: SparkSession, script: str, dialect: str = "ansi"):
    """Run a script's statements and return the last one's DataFrame. ``SET ROWCOUNT n`` limits the queries after it, 0 ends that."""
    most, out = 0, None
    for statement in split(script, dialect):
        if m := re.fullmatch(r"SET\s+ROWCOUNT\s+(\d+)", statement.text.strip(), re.I):
            most = int(m[1])
            continue
        text = adapted(statement.text)
        out = spark.sql(with_limit(text, most) if most and classify(text) == "DQL" else text)
    return out
