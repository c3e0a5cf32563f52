"""Text as written on paper to typed values, as column expressions that dispatch on the kind of the field.

Every parser returns struct(value string, value_num double, value_date date, error string): `value` is the canonical
text of the value, one of the typed columns is set next to it for numbers and dates, `error` names the broken rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from .text import half_even_of, half_even_sql, let, number_text, plain, strip


def result(value=None, num=None, date=None, error=None) -> Column:
    null = F.lit(None)
    return F.struct((null if value is None else value).cast("string").alias("value"),
                    (null if num is None else num).cast("double").alias("value_num"),
                    (null if date is None else date).cast("date").alias("value_date"),
                    (null if error is None else error).cast("string").alias("error"))


def failed(code: str) -> Column:
    return result(error=F.lit(code))


def digits(text: Column) -> Column:
    cleaned = F.regexp_replace(text, r"[\s./-]", "")
    return F.when(cleaned.rlike(r"^[0-9]{3,12}$"), result(cleaned)).otherwise(failed("DIGITS_FORMAT"))


def code(text: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.upper(text), r"^CM\s*[:\-]?\s*", ""), r"\s", "")
    return F.when(cleaned.rlike(r"^[A-Z0-9-]{3,20}$"), result(cleaned)).otherwise(failed("CODE_FORMAT"))


def free_text(text: Column) -> Column:
    cleaned = F.regexp_replace(text, r"\s+", " ")
    return F.when(F.length(cleaned).between(2, 80), result(cleaned)).otherwise(failed("TEXT_LENGTH"))


WRITTEN_DATE = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2}|[0-9]{4})$"


def iso_text(text: Column) -> Column:
    """yyyy-MM-dd of a written date, or null; whether the day exists is not checked here."""
    pad = F.regexp_replace(F.regexp_replace(text, WRITTEN_DATE, "$3-0$2-0$1"), r"-0([0-9]{2})", "-$1")
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text).when(
        text.rlike(WRITTEN_DATE), F.regexp_replace(pad, r"^([0-9]{2})-", "20$1-"))


def date(text: Column, as_of: Column) -> Column:
    def judge(iso):
        return let(F.try_to_date(iso, "yyyy-MM-dd"), lambda day: (
            F.when(iso.isNull(), failed("DATE_FORMAT")).when(day.isNull(), failed("DATE_INVALID"))
            .when(day > as_of, failed("DATE_FUTURE")).otherwise(result(iso, date=day))))
    return let(iso_text(text), judge)


def bare_number(text: Column, unit_pattern: Column) -> Column:
    """The text of a number with decimal point, without its unit."""
    cleaned = strip(F.replace(F.lower(text), F.lit(","), F.lit(".")))
    return F.when(unit_pattern.isNull(), cleaned).otherwise(strip(F.regexp_replace(cleaned, F.coalesce(unit_pattern, F.lit("$")), F.lit(""))))


def number_of(bare: Column) -> Column:
    return F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)?$"), bare.try_cast("double"))


def decimal(text: Column, unit_pattern: Column, decimals: Column) -> Column:
    return let(let(bare_number(text, unit_pattern), number_of), lambda n: F.when(n.isNull(), failed("NOT_A_NUMBER")).otherwise(
        let(rounded(n, decimals), lambda r: result(number_text(r), r))))


def rounded(number: Column, decimals: Column) -> Column:
    return F.when(number == F.floor(number), number).when(decimals == 2, half_even_of(number, 2)).otherwise(half_even_of(number, 1))


def whole(text: Column, unit_pattern: Column) -> Column:
    return let(let(bare_number(text, unit_pattern), number_of), lambda n: (
        F.when(n.isNull(), failed("NOT_A_NUMBER")).when(n != F.floor(n), failed("NOT_WHOLE")).otherwise(result(number_text(n), n))))


def to_mmhg(number: Column) -> Column:
    """Below 30 a pressure is in cmHg."""
    return F.when(number < 30, number * 10).otherwise(number)


def off_whole(number: Column) -> Column:
    return F.abs(number - F.rint(number)) > 5e-7


def blood_pressure(text: Column, unit_pattern: Column) -> Column:
    return let(let(bare_number(text, unit_pattern), lambda b: to_mmhg(number_of(b))), lambda n: (
        F.when(n.isNull(), failed("NOT_A_NUMBER")).when(off_whole(n), failed("NOT_WHOLE")).otherwise(result(number_text(F.rint(n)), F.rint(n)))))


def gestational_parts(text: Column) -> Column:
    """array(weeks, days) of one unambiguous age, or null: days need a separator, a weeks unit or a `j`."""
    pattern = "^" + C.GESTATIONAL_AGE + "$"

    def judge(groups):  # weeks | unit | separator | days | day unit
        weeks_, unit, sep, days, day_unit = (F.get(groups, F.lit(i)) for i in range(5))
        clear = (days == "") | (unit != "") | (sep != "") | (day_unit != "")
        return F.when((F.size(groups) == 5) & clear, F.array(weeks_.try_cast("int"), F.coalesce(days.try_cast("int"), F.lit(0))))

    lowered = strip(F.lower(text))
    return let(F.split(F.when(lowered.rlike(pattern), F.regexp_replace(lowered, pattern, "$1|$2|$3|$4|$5")), r"\|"), judge)


GA_DECIMAL = r"^\s*[0-9]{1,2}[.,][0-9]+\s*(?:sa)?\s*$"


def gestational_age(text: Column) -> Column:
    def judge(parts):
        weeks_, days = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        total = weeks_ * 7 + days
        return (F.when(F.lower(text).rlike(GA_DECIMAL), failed("GA_DECIMAL")).when(parts.isNull(), failed("GA_FORMAT"))
                .when(days > 6, failed("GA_DAYS")).otherwise(result(total.cast("string"), total)))
    return let(gestational_parts(text), judge)


def enum(text: Column) -> Column:
    return let(enum_code(text), lambda c: F.when(c.isNull(), failed("NOT_AN_ANSWER")).otherwise(result(c)))


def choice(text: Column, spellings: Column) -> Column:
    """`spellings` is array<struct<code, spelling>> with spellings already plain."""
    return let(choice_code(text, spellings), lambda c: F.when(c.isNull(), failed("NOT_A_CHOICE")).otherwise(result(c)))


def choice_code(text: Column, spellings: Column) -> Column:
    return let(plain(text), lambda wanted: F.try_element_at(F.filter(spellings, lambda s: s["spelling"] == wanted), F.lit(1))["code"])


def enum_code(text: Column) -> Column:
    lowered = F.lower(text)
    chain = None
    for value, spellings in C.ENUM_SPELLINGS.items():
        chain = F.when(lowered.isin(spellings), value) if chain is None else chain.when(lowered.isin(spellings), value)
    return chain


KIND_COLUMNS = ["kind", "unit_pattern", "minimum", "maximum", "decimals", "spellings"]


def normalize_into(df: DataFrame, raw: str, out: str, as_of: Column, extra: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """N1 on rows that carry the catalog columns of their field: add the struct `out` for the text `raw`.

    The work is laid out in a few projections, each reading columns of the one before, so every expression is computed
    once per row inside generated code. `extra` adds kinds as functions from text to a result struct.
    """
    e = F.expr
    numeric = "kind IN ('decimal', 'int', 'bp')"
    enum_cases = " ".join(f"WHEN lower(_text) IN ({', '.join(C.literal(x) for x in xs)}) THEN '{v}'" for v, xs in C.ENUM_SPELLINGS.items())
    rows = df.withColumn("_text", strip(F.coalesce(F.col(raw), F.lit(""))))
    rows = rows.withColumns({
        "_bare": e(f"""CASE WHEN {numeric} THEN CASE WHEN unit_pattern IS NULL THEN trim(replace(lower(_text), ',', '.'))
            ELSE trim(regexp_replace(replace(lower(_text), ',', '.'), coalesce(unit_pattern, '$'), '')) END END"""),
        "_iso": F.when(F.col("kind") == "date", iso_text(F.col("_text"))),
        "_parts": F.when(F.col("kind") == "gestational_age", gestational_parts(F.col("_text"))),
        "_choice": F.when(F.col("kind") == "choice", choice_code(F.col("_text"), F.col("spellings"))),
        "_word": e(rf"""CASE kind WHEN 'digits' THEN regexp_replace(_text, r'[\s./-]', '')
            WHEN 'code' THEN regexp_replace(regexp_replace(upper(_text), r'^CM\s*[:\-]?\s*', ''), r'\s', '')
            WHEN 'text' THEN regexp_replace(_text, r'\s+', ' ') WHEN 'enum' THEN CASE {enum_cases} END END""")})
    rows = rows.withColumns({
        "_num": e(r"CASE WHEN _bare RLIKE r'^[0-9]+(\.[0-9]+)?$' THEN try_cast(_bare AS DOUBLE) END"), "_day": e("try_to_date(_iso, 'yyyy-MM-dd')"),
        "_weeks": e("get(_parts, 0)"), "_days": e("get(_parts, 1)"), "_word": e("coalesce(_word, _choice)")})
    rows = rows.withColumn("_num", e(f"""CASE kind WHEN 'bp' THEN CASE WHEN _num < 30 THEN _num * 10 ELSE _num END WHEN 'gestational_age' THEN CAST(_weeks * 7 + _days AS DOUBLE)
        WHEN 'decimal' THEN CASE WHEN _num = floor(_num) THEN _num WHEN decimals = 2 THEN {half_even_sql('_num', 2)} ELSE {half_even_sql('_num', 1)} END ELSE _num END"""))
    rows = rows.withColumns({"_error": e(rf"""CASE WHEN _text = '' THEN 'EMPTY'
        WHEN kind = 'digits' THEN CASE WHEN NOT _word RLIKE '^[0-9]{{3,12}}$' THEN 'DIGITS_FORMAT' END
        WHEN kind = 'code' THEN CASE WHEN NOT _word RLIKE '^[A-Z0-9-]{{3,20}}$' THEN 'CODE_FORMAT' END
        WHEN kind = 'text' THEN CASE WHEN NOT length(_word) BETWEEN 2 AND 80 THEN 'TEXT_LENGTH' END
        WHEN kind = 'enum' THEN CASE WHEN _word IS NULL THEN 'NOT_AN_ANSWER' END WHEN kind = 'choice' THEN CASE WHEN _word IS NULL THEN 'NOT_A_CHOICE' END
        WHEN kind = 'date' THEN CASE WHEN _iso IS NULL THEN 'DATE_FORMAT' WHEN _day IS NULL THEN 'DATE_INVALID' END
        WHEN kind = 'gestational_age' AND lower(_text) RLIKE r'{GA_DECIMAL}' THEN 'GA_DECIMAL' WHEN kind = 'gestational_age' AND _parts IS NULL THEN 'GA_FORMAT'
        WHEN kind = 'gestational_age' AND _days > 6 THEN 'GA_DAYS' WHEN {numeric} AND _num IS NULL THEN 'NOT_A_NUMBER'
        WHEN kind = 'int' AND _num <> floor(_num) THEN 'NOT_WHOLE' WHEN kind = 'bp' AND abs(_num - rint(_num)) > 5e-7D THEN 'NOT_WHOLE'
        WHEN _num < minimum THEN 'RANGE_LOW' WHEN _num > maximum THEN 'RANGE_HIGH' END"""), "_num": e("CASE WHEN kind = 'bp' THEN rint(_num) ELSE _num END")})
    rows = rows.withColumn("_error", F.when(F.col("_error").isNull() & (F.col("_day") > as_of), "DATE_FUTURE").otherwise(F.col("_error")))
    rows = rows.withColumn("_value", e(r"coalesce(_word, _iso, regexp_replace(CAST(CAST(_num AS DECIMAL(18, 6)) AS STRING), r'\.?0+$', ''))"))
    made = e("""named_struct('value', CASE WHEN _error IS NULL THEN _value END, 'value_num', CASE WHEN _error IS NULL THEN _num END,
        'value_date', CASE WHEN _error IS NULL THEN _day END, 'error', CASE WHEN _error IS NULL AND _value IS NULL THEN 'UNKNOWN_KIND' ELSE _error END)""")
    for name, parse in (extra or {}).items():
        made = F.when((F.col("kind") == name) & (F.col("_text") != ""), parse(F.col("_text"))).otherwise(made)
    return rows.withColumn(out, made).drop("_text", "_bare", "_iso", "_parts", "_choice", "_word", "_num", "_day", "_weeks", "_days", "_error", "_value")


def catalog_with_spellings(catalog: DataFrame, spellings: DataFrame) -> DataFrame:
    """The catalog with each field's plain spellings as an array; both inputs are fixed tables of tens of rows."""
    per_field = (spellings.select("field", F.struct("code", plain(F.col("spelling")).alias("spelling")).alias("s"))
                 .groupBy("field").agg(F.collect_list("s").alias("spellings")))
    return catalog.join(per_field, "field", "left")


def normalize_fields(rows: DataFrame, catalog: DataFrame, spellings: DataFrame, as_of: Column, raw: str = "raw_text",
                     extra: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Add value, value_num, value_date and error to long rows (field, raw text)."""
    table = catalog_with_spellings(catalog, spellings).select(
        F.col("field").alias("_f"), "kind", "unit_pattern", "minimum", "maximum", "decimals", "spellings")
    joined = rows.join(F.broadcast(table), rows["field"] == F.col("_f"), "left")
    parsed = normalize_into(joined, raw, "_parsed", as_of, extra)
    return parsed.select(*rows.columns, "_parsed.value", "_parsed.value_num", "_parsed.value_date", "_parsed.error")


def type_range_error(value: Column, kind: Column, minimum: Column, maximum: Column, choices: Column, as_of: Column) -> Column:
    """The rule a stored canonical value breaks, or null. Wrong type first, then range."""
    num = value.try_cast("double")
    parsed = F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(value, "yyyy-MM-dd"))
    numeric = kind.isin("int", "bp", "gestational_age", "decimal")
    return (F.when((kind == "digits") & ~value.rlike(r"^[0-9]{3,12}$"), "DIGITS_FORMAT")
            .when((kind == "code") & ~value.rlike(r"^[A-Z0-9-]{3,20}$"), "CODE_FORMAT")
            .when((kind == "text") & ~F.length(value).between(2, 80), "TEXT_LENGTH")
            .when((kind == "date") & parsed.isNull(), "DATE_INVALID")
            .when((kind == "date") & (parsed > as_of), "DATE_FUTURE")
            .when(numeric & num.isNull(), "NOT_A_NUMBER")
            .when(kind.isin("int", "bp", "gestational_age") & (num != F.floor(num)), "NOT_WHOLE")
            .when((kind == "enum") & ~value.isin(list(C.ENUM_SPELLINGS)), "NOT_AN_ANSWER")
            .when((kind == "choice") & ~F.coalesce(F.array_contains(choices, value), F.lit(False)), "NOT_A_CHOICE")
            .when(numeric & (num < minimum), "RANGE_LOW").when(numeric & (num > maximum), "RANGE_HIGH"))


def numeric_variants(raw: Column) -> Column:
    """Array of readings of a number cell; a vertical bar is the cell border or a 1, so it gives two."""
    swapped = F.translate(raw, *C.OCR_SWAPS)
    tidy = F.regexp_replace(F.translate(F.replace(swapped, F.lit(","), F.lit(".")), "_", ""), r"\s*([/.\-])\s*", r"$1")
    joined = strip(F.regexp_replace(tidy, r"(?<=[0-9])\s+(?=[0-9])", ""))
    return F.when(F.contains(joined, F.lit("|")), F.array(
        strip(F.replace(joined, F.lit("|"), F.lit(""))), F.replace(joined, F.lit("|"), F.lit("1")))).otherwise(F.array(joined))


def numeric_flags(raw: Column) -> Column:
    swapped = F.translate(raw, *C.OCR_SWAPS)
    return F.array_compact(F.array(F.when(swapped != raw, "OCR_CHARACTER_SUBSTITUTED"),
                                   F.when(F.contains(raw, F.lit("|")), "OCR_CHARACTER_UNCLEAR")))
