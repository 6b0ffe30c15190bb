"""Scalar functions (STR, CND, MTH, DAT)."""

from __future__ import annotations

from ..functions.compat import strftime_pattern
from .registry import Family

FAMILY = Family()
sql = FAMILY.sql


def call(name: str, source: str, spark: str, duck: str, where: str = "") -> None:
    """One expression over a table's rows, beside the table's key."""
    key, origin = source.split("@")
    tail = f" FROM {origin}{where}"
    sql(name, f"SELECT {key}, {spark} AS v{tail}", f"SELECT {key}, {duck} AS v{tail}")


PART, CUST, DOCS, EVENT, ORDERS, NATION = "p_partkey@part", "c_custkey@customer", "doc_id@documents", "event_id@events", "o_orderkey@orders", "n_nationkey@nation"

call("str01_length", DOCS, "t_length(text)", "length(text)")
call("str02_upper", DOCS, "t_upper(text)", "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')")
call("str03_lower", DOCS, "t_lower(text)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
call("str04_trim", PART, "trim(concat('  ', p_name, ' '))", "trim('  ' || p_name || ' ')")
call("str05_ltrim", PART, "ltrim(concat('  ', p_name, ' '))", "ltrim('  ' || p_name || ' ')")
call("str06_rtrim", PART, "rtrim(concat('  ', p_name, ' '))", "rtrim('  ' || p_name || ' ')")
call("str07_substr3", PART, "t_substr(p_name, 2, 3)", "substr(p_name, 2, 3)")
call("str07_substr_zero", PART, "t_substr(p_name, 0, 4)", "substr(p_name, 0, 4)")
call("str07_substr_negative", PART, "t_substr(p_name, -4, 2)", "substr(p_name, -4, 2)")
call("str07_substr2", PART, "t_substr2(p_name, 4)", "substr(p_name, 4)")
call("str08_instr", DOCS, "t_instr(text, 'the')", "instr(text, 'the')")
call("str09_replace", PART, "replace(p_name, 'small', 'tiny')", "replace(p_name, 'small', 'tiny')")
call("str10_hex", DOCS, "t_hex(text)", "hex(text)")
call("str11_unicode", PART, "t_unicode(p_name)", "CAST(unicode(p_name) AS BIGINT)")
call("str12_char", PART, "concat(char(65 + p_size % 26), char(97 + p_size % 26))", "chr(65 + p_size % 26) || chr(97 + p_size % 26)")
call("str13_zeroblob", NATION, "t_length(t_zeroblob(n_nationkey))", "CAST(n_nationkey AS BIGINT)")
call("str14_printf", PART, "format_string('%s/%05d', p_brand, p_size)", "printf('%s/%05d', p_brand, p_size)")
call("str15_quote", CUST, "concat(t_quote(concat(c_name, '''s')), t_quote_number(cast(nullif(c_custkey, 5) AS STRING)))", "'''' || replace(c_name || '''s', '''', '''''') || '''' || coalesce(CAST(nullif(c_custkey, 5) AS VARCHAR), 'NULL')")
call("str16_like_function", PART, "CAST(t_like('%A_G%', p_name) AS INT)", "CAST(p_name ILIKE '%A_G%' AS INT)")
call("str17_glob_function", PART, "CAST(t_glob('*ing', p_name) AS INT)", "CAST(p_name GLOB '*ing' AS INT)")
call("cnd01_coalesce", PART, "coalesce(nullif(p_size, 1), nullif(p_size, 2), 0)", "coalesce(nullif(p_size, 1), nullif(p_size, 2), 0)")
call("cnd02_ifnull", PART, "ifnull(nullif(p_size, 7), -1)", "ifnull(nullif(p_size, 7), -1)")
call("cnd03_nullif", PART, "nullif(p_brand, 'Brand#11')", "nullif(p_brand, 'Brand#11')")
call("cnd04_iif", PART, "if(p_size > 25, 'large', 'small')", "CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END")
call("cnd05_max", PART, "greatest(p_size, 20, nullif(p_size, 30))", "greatest(p_size, 20, nullif(p_size, 30))")
call("cnd06_min", PART, "least(p_size, 20, nullif(p_size, 3))", "least(p_size, 20, nullif(p_size, 3))")
call("mth01_abs", CUST, "abs(c_acctbal)", "abs(c_acctbal)")
call("mth02_sign", CUST, "t_sign(c_acctbal)", "CAST(sign(c_acctbal) AS BIGINT)")
call("mth03_round", CUST, "round(c_acctbal, 1)", "round(c_acctbal, 1)")
call("mth03_round_half", PART, "round(CAST(p_size AS DOUBLE) / 2)", "round(CAST(p_size AS DOUBLE) / 2)")
call("mth04_ceil", CUST, "t_ceil(c_acctbal)", "ceil(c_acctbal)")
call("mth05_floor", CUST, "t_floor(c_acctbal)", "floor(c_acctbal)")
call("mth06_sqrt", CUST, "round(t_sqrt(c_acctbal), 9)", "round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 9)")
call("mth07_power", PART, "power(CAST(p_size AS DOUBLE), 2)", "power(CAST(p_size AS DOUBLE), 2)")
call("mth08_log10", CUST, "round(t_log10(c_acctbal), 9)", "round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 9)")
call("mth09_log_base", PART, "round(t_log(2, p_size), 9)", "round(CASE WHEN p_size > 0 THEN log(2, p_size) END, 9)")
call("mth10_log2", CUST, "round(t_log2(c_acctbal), 9)", "round(CASE WHEN c_acctbal > 0 THEN log2(c_acctbal) END, 9)")
call("mth11_ln", CUST, "round(t_ln(c_acctbal), 9)", "round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 9)")
call("mth12_exp", PART, "round(exp(CAST(p_size AS DOUBLE) / 20), 9)", "round(exp(CAST(p_size AS DOUBLE) / 20), 9)")
call("mth13_acos", PART, "round(t_acos(CAST(p_size AS DOUBLE) / 25), 9)", "round(CASE WHEN p_size <= 25 THEN acos(CAST(p_size AS DOUBLE) / 25) END, 9)")
call("mth14_asin", PART, "round(t_asin(CAST(p_size AS DOUBLE) / 25), 9)", "round(CASE WHEN p_size <= 25 THEN asin(CAST(p_size AS DOUBLE) / 25) END, 9)")
call("mth15_atan", PART, "round(atan(CAST(p_size AS DOUBLE)), 9)", "round(atan(CAST(p_size AS DOUBLE)), 9)")
call("mth16_atan2", CUST, "round(atan2(c_acctbal, CAST(c_custkey AS DOUBLE)), 9)", "round(atan2(c_acctbal, CAST(c_custkey AS DOUBLE)), 9)")
call("mth17_cos", PART, "round(cos(CAST(p_size AS DOUBLE)), 9)", "round(cos(CAST(p_size AS DOUBLE)), 9)")
call("mth18_sin", PART, "round(sin(CAST(p_size AS DOUBLE)), 9)", "round(sin(CAST(p_size AS DOUBLE)), 9)")
call("mth19_tan", PART, "round(tan(CAST(p_size AS DOUBLE)), 9)", "round(tan(CAST(p_size AS DOUBLE)), 9)")
call("mth20_pi", NATION, "round(pi(), 12)", "round(pi(), 12)")
call("mth21_mod", CUST, "round(t_mod(c_acctbal, 7), 6)", "round(c_acctbal % 7, 6)")
STAMP = "cast(o_orderdate AS STRING)"
call("dat01_date", ORDERS, f"t_date({STAMP})", "strftime(o_orderdate, '%Y-%m-%d')")
call("dat02_time", EVENT, "t_time(date_format(ts, 'yyyy-MM-dd HH:mm:ss'))", "strftime(ts, '%H:%M:%S')")
call("dat03_datetime", EVENT, "t_datetime(date_format(ts, 'yyyy-MM-dd HH:mm'))", "strftime(ts, '%Y-%m-%d %H:%M:00')")
call("dat04_strftime", EVENT, f"date_format(ts, \"{strftime_pattern('%d/%m/%Y at %H.%M %%')}\")", "strftime(ts, '%d/%m/%Y at %H.%M %%')")
call("dat05_parser", NATION, "concat_ws('|', t_datetime('2024-02-29'), t_datetime('07:08:09'), coalesce(t_datetime('2023-02-29'), 'bad'), coalesce(t_datetime('soon'), 'bad'), t_datetime('2024-01-02 03:04'))", "'2024-02-29 00:00:00|2000-01-01 07:08:09|bad|bad|2024-01-02 03:04:00'")
