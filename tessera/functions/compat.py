"""Dialect functions as temporary SQL functions: expressions that Catalyst inlines, no Python on executors."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: name -> (parameters, result type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # integer and real division: a zero divisor gives null
    "t_idiv": ("a BIGINT, b BIGINT", "BIGINT", "a div nullif(b, 0)"),
    "t_imod": ("a BIGINT, b BIGINT", "BIGINT", "a % nullif(b, 0)"),
    "t_fdiv": ("a DOUBLE, b DOUBLE", "DOUBLE", "a / nullif(b, 0D)"),
    "t_shl": ("a BIGINT, n BIGINT", "BIGINT", "CASE WHEN n < 0 OR n > 63 THEN 0 ELSE shiftleft(a, cast(n AS INT)) END"),
    "t_shr": ("a BIGINT, n BIGINT", "BIGINT", "CASE WHEN n < 0 OR n > 63 THEN 0 ELSE shiftright(a, cast(n AS INT)) END"),
    "t_cast_int": ("s STRING", "BIGINT", "CASE WHEN s IS NOT NULL THEN coalesce(try_cast(s AS BIGINT), try_cast(try_cast(s AS DOUBLE) AS BIGINT), 0) END"),
    # fifteen significant digits, always with a point
    "t_fmt15": ("d DOUBLE", "STRING", "CASE WHEN d IS NOT NULL THEN regexp_replace(regexp_replace(regexp_replace(format_string('%.15g', d), '(\\\\.[0-9]*?)0+(?=e|$)', '$1'), '\\\\.(?=e|$)', '.0'), '^(-?[0-9]+)(?=e|$)', '$1.0') END"),
    # strings
    "t_length": ("s STRING", "BIGINT", "cast(char_length(s) AS BIGINT)"),
    "t_upper": ("s STRING", "STRING", f"translate(s, '{_LOWER}', '{_UPPER}')"),
    "t_lower": ("s STRING", "STRING", f"translate(s, '{_UPPER}', '{_LOWER}')"),
    "t_substr": (
        "s STRING, y BIGINT, z BIGINT", "STRING",
        "CASE WHEN s IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL THEN substring(s, "
        "cast(greatest(if(y < 0, char_length(s) + y + 1, y) + least(z, 0L), 1L) AS INT), "
        "cast(greatest(least(if(y < 0, char_length(s) + y + 1, y) + greatest(z, 0L), char_length(s) + 1L) - greatest(if(y < 0, char_length(s) + y + 1, y) + least(z, 0L), 1L), 0L) AS INT)) END",
    ),
    "t_substr2": ("s STRING, y BIGINT", "STRING", "t_substr(s, y, 1000000000L)"),
    "t_instr": ("s STRING, part STRING", "BIGINT", "cast(instr(s, part) AS BIGINT)"),
    "t_hex": ("s STRING", "STRING", "hex(s)"),
    "t_unicode": ("s STRING", "BIGINT", "cast(ascii(nullif(s, '')) AS BIGINT)"),
    "t_zeroblob": ("n BIGINT", "STRING", "repeat(char(0), cast(n AS INT))"),
    "t_quote": ("s STRING", "STRING", "coalesce(concat('\\'', replace(s, '\\'', '\\'\\''), '\\''), 'NULL')"),
    "t_quote_number": ("s STRING", "STRING", "coalesce(s, 'NULL')"),
    "t_like": ("p STRING, s STRING", "BOOLEAN", "s ILIKE p ESCAPE '\\u0001'"),
    # all but *, ? and [...] stands for itself; within brackets so do * and ?; a bracket that is not closed matches nothing
    "t_glob": (
        "p STRING, s STRING", "BOOLEAN",
        "s RLIKE concat('(?s)^', regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '([\\\\.{}()+$|])', '\\\\$1'), "
        "'(?<!\\[)\\^', '\\\\^'), '\\*(?![^\\[]*\\])', '.*'), '\\?(?![^\\[]*\\])', '.'), '\\[(?![^\\]]+\\])', '(?!)'), '$')".replace("\\", "\\\\"),
    ),
    # mathematics: outside the domain the result is null
    "t_sqrt": ("x DOUBLE", "DOUBLE", "CASE WHEN x >= 0 THEN sqrt(x) END"),
    "t_log10": ("x DOUBLE", "DOUBLE", "CASE WHEN x > 0 THEN log10(x) END"),
    "t_log": ("b DOUBLE, x DOUBLE", "DOUBLE", "CASE WHEN b > 0 AND b <> 1 AND x > 0 THEN ln(x) / ln(b) END"),
    "t_log2": ("x DOUBLE", "DOUBLE", "CASE WHEN x > 0 THEN log2(x) END"),
    "t_ln": ("x DOUBLE", "DOUBLE", "CASE WHEN x > 0 THEN ln(x) END"),
    "t_acos": ("x DOUBLE", "DOUBLE", "CASE WHEN abs(x) <= 1 THEN acos(x) END"),
    "t_asin": ("x DOUBLE", "DOUBLE", "CASE WHEN abs(x) <= 1 THEN asin(x) END"),
    "t_mod": ("a DOUBLE, b DOUBLE", "DOUBLE", "a % nullif(b, 0D)"),
    "t_sign": ("x DOUBLE", "BIGINT", "cast(sign(x) AS BIGINT)"),
    "t_ceil": ("x DOUBLE", "DOUBLE", "cast(ceil(x) AS DOUBLE)"),
    "t_floor": ("x DOUBLE", "DOUBLE", "cast(floor(x) AS DOUBLE)"),
    # dates: text in, text out
    "t_parse_dt": (
        "s STRING", "TIMESTAMP_NTZ",
        "CASE WHEN s = 'now' THEN cast(current_timestamp() AS TIMESTAMP_NTZ) ELSE cast(coalesce("
        "try_to_timestamp(s, 'yyyy-MM-dd HH:mm:ss'), try_to_timestamp(s, 'yyyy-MM-dd'), try_to_timestamp(s, 'yyyy-MM-dd HH:mm'), "
        "try_to_timestamp(s, 'yyyy-MM-dd\\'T\\'HH:mm:ss'), try_to_timestamp(concat('2000-01-01 ', s), 'yyyy-MM-dd HH:mm:ss'), try_to_timestamp(concat('2000-01-01 ', s), 'yyyy-MM-dd HH:mm')) AS TIMESTAMP_NTZ) END",
    ),
    "t_date": ("s STRING", "STRING", "date_format(t_parse_dt(s), 'yyyy-MM-dd')"),
    "t_time": ("s STRING", "STRING", "date_format(t_parse_dt(s), 'HH:mm:ss')"),
    "t_datetime": ("s STRING", "STRING", "date_format(t_parse_dt(s), 'yyyy-MM-dd HH:mm:ss')"),
    "t_random": ("", "BIGINT", "xxhash64(uuid())"),
}

def register(spark: SparkSession) -> None:
    """Create the functions in the session and let recursion go as deep as the dialect's; does nothing the second time."""
    if getattr(spark, "_tessera_functions", False):
        return
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "1000")
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    spark._tessera_functions = True


#: strftime conversion -> date_format pattern
_FORMATS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}


def strftime_pattern(fmt: str) -> str:
    """The date_format pattern of a strftime format; what it does not convert stays as it is."""
    out, plain = [], ""
    for piece in [*re.findall(r"%.|[^%]+|%", fmt, re.S), ""]:
        if piece and not (piece[0] == "%" and piece[1:] in _FORMATS):
            plain += "%" if piece == "%%" else piece
            continue
        if plain:
            out.append("'" + plain.replace("'", "''") + "'")
            plain = ""
        out.append(_FORMATS[piece[1:]] if piece else "")
    return "".join(out)
