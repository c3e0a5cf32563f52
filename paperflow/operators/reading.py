"""Text of cells and labelled lines to field values with a status, a confidence and flags.

A field value is a long row (keys, field, raw_text, value, value_num, value_date, confidence, field_status,
validation_flags). Only one confident reading without any doubt is KNOWN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import normalize as N
from ..functions.text import norm, strip
from ..scale import stored
from .layout import PAGE, value_beside, with_centres

CELL = ["field", "text", "empty_reason", "spans"]
FV = ["field", "raw_text", "value", "value_num", "value_date", "confidence", "field_status", "validation_flags"]


def _flags(*pairs) -> Column:
    """Flags whose condition holds, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(test, flag) for test, flag in pairs]))).cast("array<string>")


def add_flag(flags: Column, test: Column, flag: str) -> Column:
    return F.when(test & ~F.array_contains(flags, flag), F.concat(flags, F.array(F.lit(flag)))).otherwise(flags)


def reading_catalog(catalog: DataFrame, spellings: DataFrame) -> DataFrame:
    """The catalog with each field's spellings and the number pattern its cells are searched for."""
    def pattern(i, other):
        cases = [f"WHEN field = '{n}' THEN {C.literal(pair[i])}" for n, pair in C.NUMBER_PATTERNS.items()]
        cases += [f"WHEN kind = '{k}' THEN {C.literal(pair[i])}" for k, pair in C.KIND_PATTERNS.items()]
        return F.expr(f"CASE {' '.join(cases)} ELSE '{other}' END")
    return N.catalog_with_spellings(catalog, spellings).withColumns({"pattern": pattern(0, ".+"), "suffix": pattern(1, "")})


def blank_or_dash(text: Column, confidence: Column, empty: Column, required: Column) -> Column:
    """struct(field_status, validation_flags) of an empty cell or a dash; null when there is something to read."""
    out = lambda status, flag: F.struct(status.alias("field_status"), F.array(flag).alias("validation_flags"))
    blank = F.coalesce(text, F.lit("")) == ""
    verified = (empty == "CELL_BLANK") & ~required
    return (F.when(blank, out(F.when(verified, "NOT_PROVIDED").otherwise("NEEDS_REVIEW"), F.coalesce(empty, F.lit("OCR_NO_TEXT"))))
            .when(text.isin(C.DASHES), out(F.lit("NOT_PROVIDED"), F.lit("MARKED_DASH"))))


def read_values(cells: DataFrame, table: DataFrame, as_of: Column, text: str = "text") -> DataFrame:
    """Field values of cells (field, text, confidence, empty_reason, spans); other columns pass through.

    `table` is `reading_catalog`, a fixed table of tens of rows.
    """
    keys = [c for c in cells.columns if c not in (text, "confidence", "empty_reason", "spans", "field")]
    info = F.broadcast(table.select(F.col("field").alias("_f"), "kind", "unit_pattern", "minimum", "maximum", "decimals",
                                    "required", "spellings", "pattern", "suffix"))
    raw = strip(F.col(text))
    rows = cells.join(info, F.col("field") == F.col("_f")).withColumns({
        "raw": raw, "conf": F.bround("confidence", 3), "worded": F.col("kind").isin("enum", "choice", "text"),
        "spans": F.coalesce("spans", F.lit(False)),
        "blank": blank_or_dash(raw, F.col("confidence"), F.col("empty_reason"), F.col("required"))})
    body = F.when(F.col("suffix") == "", F.col("raw")).otherwise(
        F.regexp_replace("raw", F.concat(F.lit(r"(?i)\s*"), F.col("suffix"), F.lit(r"\s*$")), F.lit("")))
    rows = rows.withColumns({"body": body}).withColumns({
        "variants": F.when(F.col("worded"), F.array(F.regexp_replace("raw", r"^[ _|]+|[ _|]+$", ""))).otherwise(N.numeric_variants(F.col("body"))),
        "found": F.when(F.col("worded"), F.array().cast("array<string>")).otherwise(N.numeric_flags(F.col("body")))})
    slash = r"^[0-9]{2}1[0-9]{2}/[0-9]{4}$"
    rows = rows.withColumns({"v1": F.get("variants", F.lit(0)), "v2": F.get("variants", F.lit(1))})
    repaired = (F.col("kind") == "date") & (F.col("v1").rlike(slash) | F.coalesce(F.col("v2").rlike(slash), F.lit(False)))
    fix = lambda v: F.when(F.col("repaired"), F.regexp_replace(v, r"^([0-9]{2})1([0-9]{2}/)", "$1/$2")).otherwise(F.col(v))
    rows = rows.withColumn("repaired", F.coalesce(repaired, F.lit(False))).withColumns({"v1": fix("v1"), "v2": fix("v2")})
    rows = rows.withColumn("ambiguous", (F.col("kind") == "gestational_age") & (
        F.col("v1").rlike(r"[0-9]\.[0-9]") | F.coalesce(F.col("v2").rlike(r"[0-9]\.[0-9]"), F.lit(False))))
    search = F.concat(F.lit("(?i)"), F.col("pattern"))
    rows = rows.withColumns({"m1": F.regexp_substr("v1", search), "m2": F.regexp_substr("v2", search)})
    rows = N.normalize_into(N.normalize_into(rows, "m1", "p1", as_of), "m2", "p2", as_of)

    def leftover(v, m):
        rest = F.substring(F.col(v), F.length(m) + 1, F.length(v))
        return ~(F.startswith(F.col(v), F.col(m)) & F.rlike(rest, F.concat(F.lit(r"(?i)^\s*"), F.col("suffix"), F.lit("$"))))

    ok1, ok2 = (F.col(f"m{i}").isNotNull() & F.col(f"p{i}.error").isNull() for i in (1, 2))
    rows = rows.withColumns({"ok1": ok1, "ok2": ok2}).withColumn("readings", (
        F.when(F.col("ok1") & F.col("ok2") & (F.col("p1.value") != F.col("p2.value")), 2)
        .when(F.col("ok1") | F.col("ok2"), 1).otherwise(0)))
    value = F.when(F.col("ok1"), F.col("p1")).otherwise(F.col("p2"))
    extra = F.when(F.col("ok1"), leftover("v1", "m1")).otherwise(leftover("v2", "m2"))
    single = (F.col("readings") == 1) & ~F.col("ambiguous")
    flags = F.array_distinct(F.concat(
        _flags((F.col("spans"), "OCR_TEXT_SPANS_COLUMNS")), F.col("found"),
        _flags((F.col("repaired"), "OCR_CHARACTER_SUBSTITUTED"), (F.col("ambiguous"), "GA_FORMAT_AMBIGUOUS"),
               (~F.col("ambiguous") & (F.col("readings") == 0), "OCR_UNPARSED"),
               (~F.col("ambiguous") & (F.col("readings") == 2), "OCR_CHARACTER_UNCLEAR"),
               (single & extra, "OCR_EXTRA_TEXT"), (single & (F.col("conf") < C.READING_CONFIDENCE), "OCR_LOW_CONFIDENCE"))))
    done = rows.withColumns({"_value": F.when(single, value), "_flags": flags})
    blank = F.col("blank").isNotNull()
    return done.select(
        *keys, "field", F.when(F.col("raw") != "", F.col("raw")).alias("raw_text"),
        *[F.when(~blank, F.col(f"_value.{c}")).alias(c) for c in ("value", "value_num", "value_date")],
        F.when(F.col("raw") != "", F.col("conf")).alias("confidence"),
        F.when(blank, F.col("blank.field_status")).when(F.size("_flags") > 0, "NEEDS_REVIEW").otherwise("KNOWN").alias("field_status"),
        F.when(blank, F.col("blank.validation_flags")).otherwise(F.col("_flags")).alias("validation_flags"))


def read_alike(cells: DataFrame, by: list[str], read) -> DataFrame:
    """`read` (field values from cells) done once for all cells that agree in `by` and in what their confidence decides.

    Forms are filled with the same few thousand texts, while a reading tries dozens of patterns. The different cells are read
    and stored; where they are few the planner sends them to every task, so the cells themselves are not shuffled.
    """
    conf, floor = F.col("confidence"), C.READING_CONFIDENCE
    # One confidence stands for all that are below the floor, those rounded up to it, and the others.
    stands = F.when(F.bround(conf, 3) < floor, 0.0).when(conf < floor, floor - 0.0001).when(conf.isNotNull(), 1.0)
    keyed = cells.withColumns({"_key": F.struct(*by, stands.alias("confidence")), "_conf": conf})
    found = stored(read(keyed.select("_key").distinct().select("_key", "_key.*")).drop("confidence"), "readings")
    rest = [c for c in cells.columns if c not in (*by, "confidence")]
    return (keyed.select("_key", "_conf", *rest).join(found, "_key")
            .withColumn("confidence", F.when(F.col("raw_text").isNotNull(), F.bround("_conf", 3))).drop("_key", "_conf"))


def _bp_variant(v: Column) -> Column:
    """struct(high, low, unit, flag) of one reading of a blood-pressure cell."""
    dated = v.rlike(C.DATE_TEXT) | v.rlike(r"^[0-9]{1,2}/0[0-9]$")
    fits = v.rlike(f"^{C.BP_TEXT}$")
    high, low = (F.regexp_extract(v, f"^{C.BP_TEXT}$", i).try_cast("double") for i in (1, 2))
    mixed = (high < 30) != (low < 30)
    mmhg = lambda x: F.when(x < 30, x * 10).otherwise(x)
    whole = lambda x: F.abs(x - F.rint(x)) <= 5e-7
    sys_, dia = mmhg(high), mmhg(low)
    valid = whole(sys_) & whole(dia) & sys_.between(60, 250) & dia.between(30, 150)
    null = F.lit(None)
    out = lambda h, l, u, f: F.struct(h.cast("double").alias("high"), l.cast("double").alias("low"),
                                      u.cast("string").alias("unit"), f.cast("string").alias("flag"))
    bad = lambda flag: out(null, null, null, F.lit(flag))
    return (F.when(v.isNull(), out(null, null, null, null)).when(dated, bad("BP_LOOKS_LIKE_DATE")).when(~fits, out(null, null, null, null))
            .when(mixed, bad("BP_UNITS_MIXED")).when(~valid, out(null, null, null, null))
            .when(dia >= sys_, bad("BP_ORDER_IMPLAUSIBLE"))
            .otherwise(out(F.rint(sys_), F.rint(dia), F.when(high < 30, "cmHg").otherwise("mmHg"), null)))


def read_bp(cells: DataFrame, text: str = "text") -> DataFrame:
    """A blood-pressure cell gives a systolic and a diastolic row; `normalized_from` is cmHg when it was scaled."""
    keys = [c for c in cells.columns if c not in (text, "confidence", "empty_reason", "spans", "field")]
    raw = strip(F.col(text))
    rows = cells.withColumns({"raw": raw, "conf": F.bround("confidence", 3), "spans": F.coalesce("spans", F.lit(False)),
                              "blank": blank_or_dash(raw, F.col("confidence"), F.col("empty_reason"), F.lit(False)),
                              "variants": N.numeric_variants(raw), "found": N.numeric_flags(raw)})
    rows = rows.withColumns({"b1": _bp_variant(F.get("variants", F.lit(0))), "b2": _bp_variant(F.get("variants", F.lit(1)))})
    ok1, ok2 = F.col("b1.high").isNotNull(), F.col("b2.high").isNotNull()
    differ = (F.col("b1.high") != F.col("b2.high")) | (F.col("b1.low") != F.col("b2.low"))
    rows = rows.withColumn("readings", F.when(ok1 & ok2 & differ, 2).when(ok1 | ok2, 1).otherwise(0))
    best = F.when(ok1, F.col("b1")).otherwise(F.col("b2"))
    doubts = F.array_compact(F.array(F.col("b1.flag"), F.col("b2.flag")))
    flags = F.array_distinct(F.concat(
        _flags((F.col("spans"), "OCR_TEXT_SPANS_COLUMNS")), F.col("found"), doubts,
        _flags((F.col("readings") == 0, "OCR_UNPARSED"), (F.col("readings") == 2, "OCR_CHARACTER_UNCLEAR"),
               ((F.col("readings") == 1) & (F.col("conf") < C.READING_CONFIDENCE), "OCR_LOW_CONFIDENCE"))))
    blank = F.col("blank").isNotNull()
    done = rows.withColumns({"_best": F.when((F.col("readings") == 1) & ~blank, best), "_flags": flags})
    pair = F.explode(F.array(F.struct(F.lit("systolic_bp_mmhg").alias("field"), F.col("_best.high").alias("num")),
                             F.struct(F.lit("diastolic_bp_mmhg").alias("field"), F.col("_best.low").alias("num"))))
    return done.withColumn("_fv", pair).select(
        *keys, "_fv.field", F.when(F.col("raw") != "", F.col("raw")).alias("raw_text"),
        F.col("_fv.num").cast("long").cast("string").alias("value"), F.col("_fv.num").alias("value_num"),
        F.lit(None).cast("date").alias("value_date"), F.when(F.col("raw") != "", F.col("conf")).alias("confidence"),
        F.when(blank, F.col("blank.field_status")).when(F.size("_flags") > 0, "NEEDS_REVIEW").otherwise("KNOWN").alias("field_status"),
        F.when(blank, F.col("blank.validation_flags")).otherwise(F.col("_flags")).alias("validation_flags"),
        F.when(F.col("_best.unit") == "cmHg", "cmHg").alias("normalized_from"))


def read_grid_cells(cells: DataFrame, table: DataFrame, as_of: Column) -> DataFrame:
    """All visit and laboratory rows of the grid: N13 for the pressure row, N12 for the others. A `source` of the cells
    becomes that of the fields."""
    def read(kinds: DataFrame) -> DataFrame:
        bp = read_bp(kinds.where("field = 'bp'")).drop("normalized_from")
        return read_values(kinds.where("field <> 'bp'"), table, as_of).unionByName(bp)

    own = [*PAGE, "slot", *(["source"] if "source" in cells.columns else [])]
    return read_alike(cells.select(*own, F.col("row").alias("field"), "text", "confidence", "empty_reason", "spans"), CELL, read)


def missing_rows(grids: DataFrame) -> DataFrame:
    """Fields of grid rows whose printed label was not found on the page: one row per slot for review."""
    fields = {"bp": ["systolic_bp_mmhg", "diastolic_bp_mmhg"]}
    have = F.transform("rows", lambda r: r["row"])
    gone = F.array_compact(F.array(*[F.when(~F.array_contains(have, name), f) for name, _p, _l, _lab in C.GRID_ROWS
                                     for f in fields.get(name, [name])]))
    spread = grids.select(*PAGE, F.explode("columns").alias("c"), gone.alias("_gone"))
    return spread.select(*PAGE, F.col("c.slot").alias("slot"), F.explode("_gone").alias("field")).withColumns({
        "raw_text": F.lit(None).cast("string"), "value": F.lit(None).cast("string"), "value_num": F.lit(None).cast("double"),
        "value_date": F.lit(None).cast("date"), "confidence": F.lit(None).cast("double"),
        "field_status": F.lit("NEEDS_REVIEW"), "validation_flags": F.array(F.lit("OCR_ROW_NOT_FOUND"))})


def demote(fields: DataFrame, floor: float = C.READING_CONFIDENCE, degraded: DataFrame | None = None,
           always: list[str] | None = None) -> DataFrame:
    """A KNOWN value below the engine's threshold, on a page with warnings, or of a field a person always confirms,
    goes to review with a flag. `degraded` has one row per page with warnings."""
    rows, tests = fields, []
    if degraded is not None:
        marks = degraded.select("page_ref").distinct().withColumn("_bad", F.lit(True))
        rows = rows.join(marks, "page_ref", "left")
    low = (F.col("field_status") == "KNOWN") & (F.col("confidence") < floor)
    tests.append((F.coalesce(low, F.lit(False)), "OCR_LOW_CONFIDENCE"))
    if degraded is not None:
        tests.append((F.coalesce("_bad", F.lit(False)), "PHOTO_QUALITY_LOW"))
    if always:
        tests.append((F.col("field").isin(always) & F.col("value").isNotNull(), "OCR_CONFIRM_REQUIRED"))
    flags, hit = F.col("validation_flags"), F.lit(False)
    for test, flag in tests:
        flags, hit = add_flag(flags, test, flag), hit | test
    return rows.withColumns({"validation_flags": flags, "field_status": F.when(
        hit & (F.col("field_status") == "KNOWN"), "NEEDS_REVIEW").otherwise(F.col("field_status"))}).drop("_bad")


# ------------------------------------------------------------------ labelled values

def clean_line(text: Column) -> Column:
    """Drop the writing line of the form, read as underscores or dots."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"[_…]+|\.{2,}", " "), r"\s+", " ")
    return F.regexp_replace(spaced, r"^[ .:]+|[ .:]+$", "")


def find_labels(lines: DataFrame, sections: DataFrame, table: list[tuple] = C.LABELLED) -> DataFrame:
    """The first line on each page that carries each printed label of the page's section; null box when it is missing.

    One aggregate over the lines with a minimum per label; the label list is fixed.
    """
    here = lines.join(sections.select(*PAGE, "section"), PAGE)
    text = norm(F.col("text"))
    box = F.struct("line_no", "text", "confidence", "x0", "y0", "x1", "y1")
    firsts = [F.min(F.when((F.col("section") == s) & text.rlike(p), box)).alias(f"l{i}") for i, (s, _f, p, _w) in enumerate(table)]
    found = here.groupBy(*PAGE, "section").agg(*firsts)
    rows = F.explode(F.array_compact(F.array(*[F.when(F.col("section") == s, F.struct(
        F.lit(f).alias("label"), F.col(f"l{i}").alias("box"))) for i, (s, f, _p, _w) in enumerate(table)])))
    return found.select(*PAGE, "section", rows.alias("r")).select(*PAGE, "section", "r.label", "r.box.*")


def read_labelled(lines: DataFrame, sections: DataFrame, table: DataFrame, as_of: Column) -> DataFrame:
    """Values written after printed labels, as field values per page."""
    labels = find_labels(lines, sections)
    beside = value_beside(labels.where("line_no IS NOT NULL"), lines).select(*PAGE, "label", F.lit(True).alias("found"), "value_text", "value_confidence")
    missing = labels.where("line_no IS NULL").select(*PAGE, "label", F.lit(False).alias("found"), F.lit(None).cast("string").alias("value_text"), F.lit(None).cast("double").alias("value_confidence"))
    return labelled_fields(beside.unionByName(missing), table, as_of)


def labelled_fields(beside: DataFrame, table: DataFrame, as_of: Column) -> DataFrame:
    """The field values of labels (label, found, value_text, value_confidence of each page)."""
    key = F.col("field").isin(C.DOCUMENT_FIELDS) & (F.col("field") != "last_menstrual_period")

    def read(kinds: DataFrame) -> DataFrame:
        cleaned = F.when(F.col("field") == "last_menstrual_period", F.col("raw")).otherwise(clean_line(F.col("raw")))
        cells = kinds.where("found").select("_key", "field", cleaned.alias("text"), "raw", "confidence", F.lit("OCR_NO_TEXT").alias("empty_reason"), F.lit(False).alias("spans"))
        extended = demote(read_values(cells.where(~key).drop("raw"), table, as_of), floor=0.0, always=C.CONFIRM_REQUIRED)
        gone = kinds.where(~F.col("found")).select("_key", "field").withColumns({
            "raw_text": F.lit(None).cast("string"), "value": F.lit(None).cast("string"), "value_num": F.lit(None).cast("double"),
            "value_date": F.lit(None).cast("date"), "confidence": F.lit(None).cast("double"),
            "field_status": F.lit("NEEDS_REVIEW"), "validation_flags": F.array(F.lit("OCR_LABEL_NOT_FOUND"))})
        return extended.select("_key", *FV).unionByName(_read_keys(cells.where(key), table, as_of)).unionByName(gone.select("_key", *FV))

    cells = beside.select(*PAGE, F.col("label").alias("field"), "found", F.col("value_text").alias("raw"), F.col("value_confidence").alias("confidence"))
    return read_alike(cells, ["field", "found", "raw"], read).select(*PAGE, *FV)


def _read_keys(cells: DataFrame, table: DataFrame, as_of: Column) -> DataFrame:
    """Cover fields: no format rule catches a misread digit, so a value that parses still needs a person. The raw text is
    kept as written; a bare writing line is unparsed writing, not an empty field."""
    info = F.broadcast(table.select(F.col("field").alias("_f"), "kind", "unit_pattern", "minimum", "maximum", "decimals", "spellings"))
    rows = N.normalize_into(cells.join(info, F.col("field") == F.col("_f")), "text", "p", as_of)
    empty = strip(F.coalesce("raw", F.lit(""))) == ""
    bad = F.col("p.error").isNotNull()
    flags = _flags((empty, "OCR_NO_TEXT"), (~empty & bad, "OCR_UNPARSED"), (~empty & ~bad, "OCR_CONFIRM_REQUIRED"),
                   (~empty & ~bad & (F.col("confidence") < C.READING_CONFIDENCE), "OCR_LOW_CONFIDENCE"))
    return rows.select("_key", "field", F.when(~empty, strip(F.col("raw"))).alias("raw_text"),
                       *[F.when(~bad, F.col(f"p.{c}")).alias(c) for c in ("value", "value_num", "value_date")],
                       F.when(~empty, F.bround("confidence", 3)).alias("confidence"), F.lit("NEEDS_REVIEW").alias("field_status"),
                       flags.alias("validation_flags"))


# ------------------------------------------------------------------ other tables on a page

def row_bands(labels: DataFrame) -> DataFrame:
    """Top and bottom of each row label of a page: halfway to its neighbours, half the usual pitch at the ends."""
    down = Window.partitionBy(*PAGE).orderBy("cy", "line_no")
    page = Window.partitionBy(*PAGE)
    near = labels.withColumns({"_before": F.lag("cy").over(down), "_after": F.lead("cy").over(down), "_n": F.count(F.lit(1)).over(page)})
    gaps = F.array_sort(F.array_compact(F.collect_list(F.col("_after") - F.col("cy")).over(page)))
    pitched = near.withColumn("_pitch", F.get(gaps, F.floor((F.col("_n") - 1) / 2).cast("int")))
    half = F.col("_pitch") / 2
    return pitched.where("_n >= 2").withColumns({
        "top": F.coalesce((F.col("_before") + F.col("cy")) / 2, F.col("cy") - half),
        "bottom": F.coalesce((F.col("_after") + F.col("cy")) / 2, F.col("cy") + half)}).drop("_before", "_after", "_n", "_pitch")


def _cell_text(lines: DataFrame, rects: DataFrame, keys: list[str], ink: DataFrame | None = None) -> DataFrame:
    """Text of each rectangle (keys + left, right, top, bottom): pieces whose centre lies inside, left to right."""
    inside = (F.col("cx") >= F.col("left")) & (F.col("cx") < F.col("right")) & (F.col("cy") >= F.col("top")) & (F.col("cy") < F.col("bottom"))
    texts = with_centres(lines).join(rects, PAGE).where(inside).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("x0"), F.col("line_no"), F.col("text")))).alias("_items"),
        F.min("confidence").alias("confidence"))
    text = strip(F.array_join(F.filter(F.transform("_items", lambda i: clean_line(i["text"])), lambda t: t != ""), " "))
    raw = strip(F.array_join(F.transform("_items", lambda i: i["text"]), " "))
    cells = rects.join(texts, keys, "left").withColumns({"text": text, "raw": raw, "spans": F.lit(False)}).drop("_items")
    if ink is None:
        return cells.withColumn("empty_reason", F.lit("OCR_NO_TEXT"))
    return cells.join(ink.select(*keys, "empty_reason"), keys, "left")


def read_abortions(lines: DataFrame, table: DataFrame, as_of: Column) -> DataFrame:
    """The cell of row `Avortement` under the column `Nombre`; pages without both go to review."""
    page = with_centres(lines)
    text = norm(F.col("text"))
    box = F.struct("line_no", "x0", "x1", "cy", "height")
    heads = page.groupBy(*PAGE).agg(F.min(F.when(text == "nombre", box)).alias("h"), F.min(F.when(text.rlike("^avortement"), box)).alias("r"))
    next_head = page.join(heads, PAGE).where((F.col("x0") > F.col("h.x1")) & (F.abs(F.col("cy") - F.col("h.cy")) < F.col("h.height"))
                                             ).groupBy(*PAGE).agg(F.min("x0").alias("nx"))
    frame = heads.join(next_head, PAGE, "left").withColumn("pitch", F.col("nx") - F.col("h.x0")).withColumns({
        "left": F.col("h.x0") - 0.1 * F.col("pitch"), "right": F.col("h.x0") + 0.9 * F.col("pitch")})
    labels = page.join(frame, PAGE).where((F.col("x1") < F.col("left")) & (F.col("cy") > F.col("h.cy") - 2 * F.col("h.height"))
                                          & (F.col("cy") < F.col("r.cy") + 4 * F.col("r.height")))
    band = row_bands(labels).where(F.col("line_no") == F.col("r.line_no")).select(*PAGE, "top", "bottom")
    rects = frame.join(band, PAGE).select(*PAGE, F.lit("abortions_count").alias("field"), "left", "right", "top", "bottom")
    cells = _cell_text(lines, rects, [*PAGE, "field"]).select(*PAGE, "field", "text", "confidence", "empty_reason", "spans")
    lost = heads.join(band, PAGE, "left_anti").select(*PAGE, F.lit(False).alias("found"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("confidence"))
    return abortion_fields(cells.select(*PAGE, F.lit(True).alias("found"), "text", "confidence").unionByName(lost), table, as_of)


def abortion_fields(cells: DataFrame, table: DataFrame, as_of: Column) -> DataFrame:
    """The field of each page from its cell (found, text, confidence)."""
    def read(kinds: DataFrame) -> DataFrame:
        field = F.lit("abortions_count").alias("field")
        own = kinds.where("found").select("_key", field, "text", "confidence", F.lit("OCR_NO_TEXT").alias("empty_reason"), F.lit(False).alias("spans"))
        lost = kinds.where(~F.col("found")).select("_key", field).withColumns({
            "raw_text": F.lit(None).cast("string"), "value": F.lit(None).cast("string"), "value_num": F.lit(None).cast("double"),
            "value_date": F.lit(None).cast("date"), "confidence": F.lit(None).cast("double"),
            "field_status": F.lit("NEEDS_REVIEW"), "validation_flags": F.array(F.lit("OCR_ROW_NOT_FOUND"))})
        return demote(read_values(own, table, as_of), floor=0.0, always=C.CONFIRM_REQUIRED).select("_key", *FV).unionByName(lost.select("_key", *FV))

    return read_alike(cells, ["found", "text"], read).select(*PAGE, *FV)


def read_previous_deliveries(lines: DataFrame, table: DataFrame, as_of: Column) -> DataFrame:
    """Date and mode of each previous delivery whose column holds writing; item = its column number 1..5."""
    page = with_centres(lines)
    text = norm(F.col("text"))
    number = F.regexp_extract(text, f"^{C.PREVIOUS_DELIVERY_HEADER}$", 1)
    heads = (page.where(number.rlike("^[1-5]$")).groupBy(*PAGE, number.cast("int").alias("n"))
             .agg(F.min(F.struct("line_no", "x0", "y1")).alias("h")))
    frame = heads.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct(F.col("h.x0").alias("x"), F.col("n")))).alias("order"),
        F.min(F.struct("n", F.col("h.x0").alias("x"))).alias("first"), F.max(F.struct("n", F.col("h.x0").alias("x"))).alias("last"),
        F.max("h.y1").alias("low_edge"))
    numbers = F.transform("order", lambda o: o["n"])
    frame = frame.where((F.col("count") >= 3) & (numbers == F.array_sort(numbers))).withColumn(
        "pitch", (F.col("last.x") - F.col("first.x")) / (F.col("last.n") - F.col("first.n")))
    frame = frame.withColumn("left1", F.col("first.x") + (1 - F.col("first.n") - 0.1) * F.col("pitch")).select(*PAGE, "low_edge", "pitch", "left1")
    stops = page.join(frame, PAGE).where(text.rlike(r"^gestation\b") & (F.col("cy") > F.col("low_edge"))).groupBy(*PAGE).agg(F.min("cy").alias("stop"))
    frame = frame.join(stops, PAGE, "left")
    labels = page.join(frame, PAGE).where((F.col("x1") < F.col("left1")) & (F.col("cy") > F.col("low_edge"))
                                          & (F.col("stop").isNull() | (F.col("cy") < F.col("stop"))))
    bands = row_bands(labels)
    band = F.struct("cy", "line_no", "top", "bottom")
    rows = bands.groupBy(*PAGE).agg(*[F.min(F.when(text.rlike(p), band)).alias(f"r{i}") for i, (_n, p) in enumerate(C.PREVIOUS_DELIVERY_ROWS)])
    rows = rows.where("r0 IS NOT NULL AND r1 IS NOT NULL").select(*PAGE, F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"r{i}").isNotNull(), F.struct(F.lit(n).alias("field"), F.col(f"r{i}.top").alias("top"), F.col(f"r{i}.bottom").alias("bottom")))
        for i, (n, _p) in enumerate(C.PREVIOUS_DELIVERY_ROWS)]))).alias("b")).select(*PAGE, "b.*")
    rects = frame.join(rows, PAGE).withColumn("item", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn(
        "left", F.col("left1") + (F.col("item") - 1) * F.col("pitch")).select(
        *PAGE, "item", "field", "left", (F.col("left") + F.col("pitch")).alias("right"), "top", "bottom")
    cells = _cell_text(lines, rects, [*PAGE, "item", "field"])
    written = cells.groupBy(*PAGE, "item").agg(F.bool_or((F.col("raw") != "") & ~F.col("raw").isin(C.DASHES)).alias("w")).where("w")
    kept = cells.where(F.col("field").startswith("previous_delivery")).join(written, [*PAGE, "item"], "left_semi")
    return delivery_fields(kept.select(*PAGE, "item", "field", "text", "confidence"), table, as_of)


def delivery_fields(cells: DataFrame, table: DataFrame, as_of: Column) -> DataFrame:
    """The fields of the cells (item, field, text, confidence) of previous deliveries."""
    seen = cells.withColumns({"empty_reason": F.lit("OCR_NO_TEXT"), "spans": F.lit(False)})
    return read_alike(seen, CELL, lambda kinds: demote(read_values(kinds, table, as_of), floor=0.0, always=C.CONFIRM_REQUIRED))
