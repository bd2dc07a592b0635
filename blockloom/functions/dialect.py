"""SQL spellings of other engines that Spark lacks.

Functions become temporary SQL functions, which the optimizer inlines; what cannot be
one (aggregates, operators) is rewritten in the text, outside quotes.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# Name, parameters, result type, Spark expression.
FUNCTIONS = [
    ("strpos", "s STRING, part STRING", "INT", "instr(s, part)"),
    ("starts_with", "s STRING, part STRING", "BOOLEAN", "startswith(s, part)"),
    ("to_hex", "n BIGINT", "STRING", "lower(hex(n))"),
    ("sha224", "s STRING", "BINARY", "unhex(sha2(s, 224))"),
    ("sha256", "s STRING", "BINARY", "unhex(sha2(s, 256))"),
    ("sha384", "s STRING", "BINARY", "unhex(sha2(s, 384))"),
    ("sha512", "s STRING", "BINARY", "unhex(sha2(s, 512))"),
    ("digest", "s STRING, kind STRING", "BINARY", "unhex(CASE lower(kind) WHEN 'md5' THEN md5(s) WHEN 'sha224' THEN sha2(s, 224) WHEN 'sha256' THEN sha2(s, 256) WHEN 'sha384' THEN sha2(s, 384) WHEN 'sha512' THEN sha2(s, 512) END)"),
    ("to_timestamp_seconds", "n BIGINT", "TIMESTAMP_NTZ", "TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(n AS DECIMAL(18, 6)))"),
    ("to_timestamp_millis", "n BIGINT", "TIMESTAMP_NTZ", "TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(n / 1000BD AS DECIMAL(18, 6)))"),
    ("date_bin", "step INTERVAL DAY TO SECOND, at TIMESTAMP_NTZ, origin TIMESTAMP_NTZ", "TIMESTAMP_NTZ", "timestampadd(MICROSECOND, CAST(floor(timestampdiff(MICROSECOND, origin, at) / timestampdiff(MICROSECOND, origin, origin + step)) AS BIGINT) * timestampdiff(MICROSECOND, origin, origin + step), origin)"),
]
# Names that only differ, aggregates among them.
RENAMED = {"approx_distinct": "approx_count_distinct", "approx_percentile_cont": "percentile_approx", "approx_median": "median", "arrow_typeof": "typeof", "array_length": "array_size", "regexp_match": "regexp_extract_all", "character_length": "char_length"}

_STRING = re.compile(r"('(?:[^'\\]|\\.|'')*')")
_SIMILAR = re.compile(r"\b(not\s+)?similar\s+to\s*$", re.I)


def register_dialect(spark: SparkSession) -> None:
    """Create the functions in this session."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def similar_pattern(pattern: str) -> str:
    """The regular expression, for a whole match, of a SIMILAR TO pattern.

    % is any text and _ any character; | * + ? {n} ( ) [ ] are as in regular
    expressions, and everything else stands for itself.
    """
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 1
        elif inside:
            out.append(c)
            inside = c != "]"
        elif c == "[":
            out.append(c)
            inside = True
        else:
            out.append({"%": ".*", "_": ".", ".": "\\.", "^": "\\^", "$": "\\$"}.get(c, c))
        i += 1
    return f"^(?s:{''.join(out)})$"


def translate(text: str) -> str:
    """The query in Spark's spelling."""
    parts = _STRING.split(text)
    for i in range(0, len(parts), 2):
        for old, new in RENAMED.items():
            parts[i] = re.sub(rf"(?<![\w.`]){old}(?=\s*\()", new, parts[i], flags=re.I)
        found = _SIMILAR.search(parts[i])
        if found and i + 1 < len(parts):
            parts[i] = parts[i][: found.start()] + ("NOT " if found[1] else "") + "RLIKE "
            pattern = similar_pattern(parts[i + 1][1:-1].replace("''", "'"))
            parts[i + 1] = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "".join(parts)
