"""From recognised lines to page sections, the visit grid, its cells, and decisions about photos.

Lines carry (document_id, page_ref, line_no, text, confidence, x0, y0, x1, y1). A page is one photo, so its lines are
bounded by what fits on paper; everything per page is an equi join or an aggregate on the page key. What there is once per
page (angle, grid) is the hashed side of a join, so that the many lines need no sort; lines dealt out by page stay there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.text import is_ascii, norm, strip
from ..scale import joined_text

PAGE = ["document_id", "page_ref"]


def with_centres(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2,
                              "height": F.col("y1") - F.col("y0")})


# ------------------------------------------------------------------ section and personal data

def page_signs(lines: DataFrame, signs: list[tuple[str, str]], keys: list[str] = PAGE, normalised: bool = False) -> DataFrame:
    """One boolean column `s<i>` per pattern: does the text of the page contain it, also across line ends."""
    text = F.col("text") if normalised else norm(F.col("text"))
    pages = joined_text(lines.select(*keys, "line_no", text.alias("text")), keys, "line_no", "text")
    return pages.select(*keys, *[F.col("text").rlike(p).alias(f"s{i}") for i, (_l, p) in enumerate(signs)])


def detect_section(lines: DataFrame, grids: DataFrame | None = None, signs: list[tuple[str, str]] = C.SECTION_SIGNS,
                   grid_section: str = "current_pregnancy", keys: list[str] = PAGE) -> DataFrame:
    """(page, section, section_confidence). Two distinct labels of one section are `high`; one label or a tie is
    `low`; none is `none`. A located grid decides unless another section shows at least two labels and more."""
    found = page_signs(lines, signs, keys)
    names = list(dict.fromkeys(label for label, _p in signs))
    scores = {n: sum((F.when(F.col(f"s{i}"), 1).otherwise(0) for i, (label, _p) in enumerate(signs) if label == n), F.lit(0))
              for n in names}
    scored = found.withColumn("_scores", F.sort_array(F.array(*[
        F.struct(scores[n].alias("score"), F.lit(n).alias("section")) for n in names]), asc=False))
    best, second = F.col("_scores")[0], F.col("_scores")[1]
    section = F.when((best["score"] == 0) | (best["score"] == second["score"]), "unknown").otherwise(best["section"])
    sure = (F.when(best["score"] == 0, "none").when(best["score"] == second["score"], "low")
            .when(best["score"] >= 2, "high").otherwise("low"))
    if grids is not None and grid_section in names:
        scored = scored.join(grids.select(*keys, F.lit(True).alias("_grid")), keys, "left")
        other = F.greatest(*[scores[n] for n in names if n != grid_section], F.lit(0))
        beaten = (other >= 2) & (other > scores[grid_section])
        section = F.when(F.col("_grid") & beaten, "unknown").when(F.col("_grid"), grid_section).otherwise(section)
        sure = F.when(F.col("_grid") & beaten, "low").when(F.col("_grid"), "high").otherwise(sure)
    return scored.select(*keys, section.alias("section"), sure.alias("section_confidence"))


def detect_pii(lines: DataFrame, labels: list[tuple[str, str]] = C.PII_LABELS, keys: list[str] = PAGE) -> DataFrame:
    """One row per page and category of personal data whose printed label is on the page; the value is not kept."""
    found = page_signs(lines, labels, keys)
    present = F.array_compact(F.array(*[F.when(F.col(f"s{i}"), label) for i, (label, _p) in enumerate(labels)]))
    return found.select(*keys, F.explode(F.array_distinct(present)).alias("category"), F.lit("NOT_EXTRACTED").alias("action"))


# ------------------------------------------------------------------ geometry

VISIT, MONTH = f"^(?:{C.VISIT_HEADER})$", f"^(?:{C.MONTH_HEADER})$"


def header_lines(lines: DataFrame) -> DataFrame:
    """The lines that read as the header of a visit column or of a month column, with `visit` telling which."""
    label, text = F.col("label"), F.col("text")
    # Most lines are told from a header without normalising them: an ASCII text keeps its letters.
    likely = ~is_ascii(text) | F.lower(text).rlike("|".join(C.HEADER_PIECES))
    # A generated column is made once for a line; the filter on a projected one would fold the text again for each pattern.
    return (lines.where(likely).withColumn("label", F.explode(F.array(norm(text)))).where(label.rlike(VISIT) | label.rlike(MONTH))
            .withColumn("visit", label.rlike(VISIT)))


def skew(lines: DataFrame) -> DataFrame:
    """Slope of the header row per page in radians; only pages with four anchors and a plausible slope."""
    anchors = header_lines(with_centres(lines))
    slope = anchors.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("cy", "cx").alias("slope"))
    angle = F.atan("slope")
    return slope.where((F.col("n") >= 4) & F.col("slope").isNotNull() & (F.abs(angle) <= C.MAX_SKEW_RADIANS)).select(
        *PAGE, angle.alias("angle"))


def deskew(lines: DataFrame, angles: DataFrame) -> DataFrame:
    """P5: rotate the box centres by the page's angle; sizes stay, the box as read is kept in sx0..sy1."""
    joined = with_centres(lines.join(angles.hint("shuffle_hash"), PAGE, "left")).withColumn("angle", F.coalesce("angle", F.lit(0.0)))
    cx = F.col("cx") * F.cos("angle") + F.col("cy") * F.sin("angle")
    cy = F.col("cy") * F.cos("angle") - F.col("cx") * F.sin("angle")
    half_w, half_h = (F.col("x1") - F.col("x0")) / 2, F.col("height") / 2
    turned = F.col("angle") != 0
    moved = {"x0": cx - half_w, "y0": cy - half_h, "x1": cx + half_w, "y1": cy + half_h}
    rest = [c for c in lines.columns if c not in moved]
    return joined.select(*rest, *[F.when(turned, e).otherwise(F.col(c)).alias(c) for c, e in moved.items()],
                         *[F.col(c).alias(f"s{c}") for c in moved], "angle")


def find_grid(lines: DataFrame) -> DataFrame:
    """One row per page with a visit grid: header_bottom, columns array<slot,left,right>, rows array<row,top,bottom>.

    One aggregate over the header-like lines gives the frame of each page; pages without exactly six visit and three month
    headers go no further, so the second pass looks at row labels of accepted pages only.
    """
    centred = with_centres(lines)
    anchors = header_lines(centred)
    visit, month = F.col("visit"), ~F.col("visit")
    heads = anchors.groupBy(*PAGE).agg(
        F.count_if(visit).alias("visits"), F.count_if(month).alias("months"),
        F.max(F.when(visit, F.col("x0"))).alias("last_visit"), F.min(F.when(month, F.col("x0"))).alias("first_month"),
        F.max("y1").alias("header_bottom"), F.array_sort(F.collect_list(F.struct("x0", "line_no", "cy", "height"))).alias("heads"))
    heads = heads.where("visits = 6 AND months = 3 AND last_visit < first_month")
    steps = F.sequence(F.lit(0), F.lit(7))
    gaps = F.array_sort(F.transform(steps, lambda i: F.get("heads", i + 1)["x0"] - F.get("heads", i)["x0"]))
    frames = heads.withColumns({"mid": F.array_sort(F.transform("heads", lambda h: h["cy"]))[4], "gaps": gaps}).withColumn(
        "width", (F.col("gaps")[3] + F.col("gaps")[4]) / 2)
    level = ~F.exists("heads", lambda h: F.abs(h["cy"] - F.col("mid")) > 2 * h["height"])
    lefts = F.transform("heads", lambda h: h["x0"] - 0.15 * F.col("width"))
    frames = frames.where(level).select(*PAGE, "header_bottom", "width", lefts.alias("lefts"))
    slots = F.array(*[F.lit(s) for s in C.GRID_SLOTS])
    columns = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(
        F.get(slots, i).alias("slot"), F.get("lefts", i).alias("left"),
        F.coalesce(F.get("lefts", i + 1), F.get("lefts", i) + F.col("width")).alias("right")))
    frames = frames.select(*PAGE, "header_bottom", columns.alias("columns"))

    labels = (centred.join(frames.hint("shuffle_hash"), PAGE)
              .where((F.col("cx") < F.col("columns")[0]["left"]) & (F.col("cy") > F.col("header_bottom"))))
    down = Window.partitionBy(*PAGE).orderBy("cy", "line_no")
    placed = labels.withColumns({"before": F.lag("cy").over(down), "after": F.lead("cy").over(down),
                                 "label": norm(F.col("text"))})
    band = F.struct(F.col("cy"), F.col("line_no"), F.col("before"), F.col("after"))
    firsts = [F.min(F.when(F.col("label").rlike(f"^(?:{p})" + r"(?:\s*\(.*\))?$"), band)).alias(f"r{i}")
              for i, (_f, p, _l, _lab) in enumerate(C.GRID_ROWS)]
    found = placed.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.median(F.col("after") - F.col("cy")).alias("pitch"),
                                      F.first("header_bottom").alias("header_bottom"), F.first("columns").alias("columns"), *firsts)
    half = F.col("pitch") / 2
    rows = F.array_compact(F.array(*[F.when(F.col(f"r{i}").isNotNull(), F.struct(
        F.lit(name).alias("row"),
        F.coalesce((F.col(f"r{i}.before") + F.col(f"r{i}.cy")) / 2, F.col(f"r{i}.cy") - half).alias("top"),
        F.coalesce((F.col(f"r{i}.after") + F.col(f"r{i}.cy")) / 2, F.col(f"r{i}.cy") + half).alias("bottom")))
        for i, (name, _p, _l, _lab) in enumerate(C.GRID_ROWS)]))
    return found.where("n >= 3 AND r0 IS NOT NULL").select(*PAGE, "header_bottom", "columns", rows.alias("rows"))


def words_with_offsets(text: Column) -> Column:
    """array<struct<word, start, stop>> of the words of a text, as shares of its length."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<word:string,start:double,stop:double>>").alias("out"))

    def step(acc, word):
        at = F.call_function("locate", word, text, acc["at"])
        size = F.length(text).cast("double")
        piece = F.struct(word.alias("word"), ((at - 1) / size).alias("start"), ((at - 1 + F.length(word)) / size).alias("stop"))
        return F.struct((at + F.length(word)).cast("int").alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(r"(\S+)"), 1), start, step, lambda acc: acc["out"])


def split_words(lines: DataFrame, keep: Column | None = None) -> DataFrame:
    """A box of several words becomes one box per word, placed in proportion to its characters.

    Rows where `keep` is true stay whole. `weak` marks a split word without a digit.
    """
    words = words_with_offsets(F.col("text"))
    whole = F.array(F.struct(F.col("text").alias("word"), F.lit(0.0).alias("start"), F.lit(1.0).alias("stop")))
    stay = F.lit(False) if keep is None else keep
    pieces = lines.withColumn("_split", ~stay).withColumn("_piece", F.explode(
        F.when(stay | (F.size(words) < 2), whole).otherwise(words)))
    width = F.col("x1") - F.col("x0")
    rest = [c for c in lines.columns if c not in ("text", "x0", "x1")]
    return pieces.select(*rest, F.col("_piece.word").alias("text"), (F.col("x0") + F.col("_piece.start") * width).alias("x0"),
                         (F.col("x0") + F.col("_piece.stop") * width).alias("x1"),
                         (F.col("_split") & ~F.col("_piece.word").rlike("[0-9]")).alias("weak"))


def assign_cells(lines: DataFrame, grids: DataFrame) -> DataFrame:
    """Pieces of text per page, slot and row. A box that spans columns is cut into words, and each cell it touches
    also gets a row without text whose `spans` is true.

    The range join is an equi join on the page whose grid rides along as plain columns, so a line is compared with the rows
    and columns of its own page only, in compiled code, and nothing is multiplied.
    """
    slots, bands = range(len(C.GRID_SLOTS)), range(len(C.GRID_ROWS))
    flat = grids.select(*PAGE, "header_bottom", *[F.get("columns", i)[side].alias(f"_{side}{i}") for i in slots for side in ("left", "right")],
                        *[F.get("rows", i)[part].alias(f"_{part}{i}") for i in bands for part in ("row", "top", "bottom")])
    placed = with_centres(lines).join(flat.hint("shuffle_hash"), PAGE).where(F.col("cy") > F.col("header_bottom"))
    row = F.coalesce(*[F.when((F.col("cy") >= F.col(f"_top{i}")) & (F.col("cy") < F.col(f"_bottom{i}")), F.col(f"_row{i}")) for i in bands])
    banded = placed.withColumn("row", row).where("row IS NOT NULL")
    width = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-6))
    touches = [F.least("x1", f"_right{i}") - F.greatest("x0", f"_left{i}") > C.SPAN_SHARE * width for i in slots]
    banded = banded.withColumn("_touched", sum((F.when(t, 1).otherwise(0) for t in touches), F.lit(0)))
    across = F.col("_touched") > 1
    words = words_with_offsets(F.col("text"))
    none = F.lit(None)

    def piece(word, start, stop, slot, weak, spans):
        return F.struct(word.cast("string").alias("text"), start.cast("double").alias("start"), stop.cast("double").alias("stop"),
                        slot.cast("string").alias("slot"), weak.cast("boolean").alias("weak"), spans.cast("boolean").alias("spans"))

    whole = piece(F.col("text"), F.lit(0.0), F.lit(1.0), none, across & ~F.col("text").rlike("[0-9]"), F.lit(False))
    cut = F.transform(words, lambda w: piece(w["word"], w["start"], w["stop"], none, ~w["word"].rlike("[0-9]"), F.lit(False)))
    marks = F.transform(F.array_compact(F.array(*[F.when(t, C.GRID_SLOTS[i]) for i, t in enumerate(touches)])), lambda s: piece(none, none, none, s, none, F.lit(True)))
    pieces = F.when(~across, F.array(whole)).otherwise(F.concat(F.when(F.size(words) < 2, F.array(whole)).otherwise(cut), marks))
    rest = [c for c in lines.columns if c not in ("text", "x0", "x1")]
    edges = [f"_{side}{i}" for i in slots for side in ("left", "right")]
    spread = banded.select(*rest, "row", *edges, "x0", "x1", F.explode(pieces).alias("p"))
    x0, x1 = (F.col("x0") + F.col(f"p.{side}") * (F.col("x1") - F.col("x0")) for side in ("start", "stop"))
    placed = spread.select(*rest, "row", *edges, F.col("p.text").alias("text"), x0.alias("x0"), x1.alias("x1"), "p.slot", "p.weak", "p.spans")
    middle = (F.col("x0") + F.col("x1")) / 2
    slot = F.coalesce(*[F.when((middle >= F.col(f"_left{i}")) & (middle < F.col(f"_right{i}")), C.GRID_SLOTS[i]) for i in slots])
    return placed.withColumn("slot", F.when(F.col("spans"), F.col("slot")).otherwise(slot)).where("slot IS NOT NULL").drop(*edges)


def filled_cells(pieces: DataFrame) -> DataFrame:
    """The cells that something was assigned to: text in reading order, lowest confidence, box, and doubts."""
    has_source = "sx0" in pieces.columns
    read = ~F.col("spans")
    box = {c: F.when(read, F.col(f"s{c}" if has_source else c)) for c in ("x0", "y0", "x1", "y1")}
    filled = pieces.groupBy(*PAGE, "slot", "row").agg(
        F.array_sort(F.collect_list(F.when(read, F.struct(F.col("x0"), F.col("line_no"), F.col("text"), F.col("weak"))))).alias("items"),
        F.min(F.when(read, F.col("confidence"))).alias("confidence"), F.min(box["x0"]).alias("bx0"), F.min(box["y0"]).alias("by0"),
        F.max(box["x1"]).alias("bx1"), F.max(box["y1"]).alias("by1"), F.bool_or("spans").alias("spans"))
    strong = F.array_join(F.transform(F.filter("items", lambda i: ~i["weak"]), lambda i: i["text"]), " ")
    return filled.withColumns({"text": strip(F.array_join(F.transform("items", lambda i: i["text"]), " ")), "strong_text": strip(strong)}).drop("items")


def grid_cells(pieces: DataFrame, grids: DataFrame) -> DataFrame:
    """Every cell of every grid with its text in reading order, lowest confidence, box, and doubts; also empty cells."""
    every = grids.select(*PAGE, "header_bottom", F.explode("columns").alias("c"), "rows").select(
        *PAGE, "header_bottom", "c.slot", "c.left", "c.right", F.explode("rows").alias("r")).select(
        *PAGE, "slot", "r.row", "left", F.greatest("r.top", "header_bottom").alias("top"), "right", F.col("r.bottom").alias("bottom"))
    return every.join(filled_cells(pieces), [*PAGE, "slot", "row"], "left").withColumns({
        "strong_text": F.coalesce("strong_text", F.lit("")), "spans": F.coalesce("spans", F.lit(False))})


def written_cells(pieces: DataFrame, grids: DataFrame) -> DataFrame:
    """The rows of `grid_cells` that hold a text. They meet the one row of their page's grid, so neither the pieces nor the
    ninety cells of each grid are dealt out by cell."""
    column = F.filter("columns", lambda c: c["slot"] == F.col("slot"))[0]
    row = F.filter("rows", lambda r: r["row"] == F.col("row"))[0]
    placed = filled_cells(pieces).where("text <> ''").join(grids.select(*PAGE, "header_bottom", "columns", "rows").hint("shuffle_hash"), PAGE)
    return placed.withColumns({"left": column["left"], "top": F.greatest(row["top"], "header_bottom"), "right": column["right"], "bottom": row["bottom"]}).drop("header_bottom", "columns", "rows")


def image_rect(cells: DataFrame, angle: str = "angle") -> DataFrame:
    """The cell corners turned back onto the photo: ix0, iy0, ix1, iy1."""
    xs = [F.col(x) * F.cos(angle) - F.col(y) * F.sin(angle) for x in ("left", "right") for y in ("top", "bottom")]
    ys = [F.col(x) * F.sin(angle) + F.col(y) * F.cos(angle) for x in ("left", "right") for y in ("top", "bottom")]
    return cells.withColumns({"ix0": F.least(*xs), "iy0": F.least(*ys), "ix1": F.greatest(*xs), "iy1": F.greatest(*ys)})


def empty_reason(cell) -> Column:
    """Why a cell without text has no value; `cell` gives its text, spans, ix0..iy1, width, height, has_image and ink_share."""
    w, h, t = cell("width"), cell("height"), C.FRAME_TOLERANCE
    outside = (cell("ix0") < -t * w) | (cell("iy0") < -t * h) | (cell("ix1") > (1 + t) * w) | (cell("iy1") > (1 + t) * h)
    known = w.isNotNull() & h.isNotNull() & (w > 0) & (h > 0)
    return (F.when(F.coalesce(cell("text"), F.lit("")) != "", F.lit(None))
            .when(cell("spans"), "OCR_TEXT_SPANS_COLUMNS").when(known & outside, "CELL_OUT_OF_FRAME")
            .when(~F.coalesce(cell("has_image"), F.lit(False)) | cell("ink_share").isNull(), "OCR_NO_TEXT")
            .when(cell("ink_share") > C.MAX_BLANK_INK, "CELL_INK_UNREAD").otherwise("CELL_BLANK"))


def cell_emptiness(cells: DataFrame) -> DataFrame:
    """`empty_reason` of each cell, as a column."""
    return cells.withColumn("empty_reason", empty_reason(F.col))


def _written(row: Column, strong_text: Column) -> Column:
    """Whether a cell is one of a visit and holds more than a dash."""
    return _of_visit(row) & (strong_text != "") & ~strong_text.isin(C.DASHES)


def _of_visit(row: Column) -> Column:
    return row.isin([name for name, _p, _l, lab in C.GRID_ROWS if not lab])


def visit_columns(cells: DataFrame) -> DataFrame:
    """P10: per page and slot: populated (a visit row holds more than a dash), ink_only, or blank."""
    inked = _of_visit(F.col("row")) & (F.col("empty_reason") == "CELL_INK_UNREAD")
    per_slot = cells.groupBy(*PAGE, "slot").agg(F.bool_or(_written(F.col("row"), F.col("strong_text"))).alias("populated"),
                                                F.bool_or(F.coalesce(inked, F.lit(False))).alias("inked"))
    return per_slot.select(*PAGE, "slot", "populated", (~F.col("populated") & F.col("inked")).alias("ink_only"))


def grid_summary(columns: DataFrame) -> DataFrame:
    """P10: per page the visit, unread and blank columns in printed order."""
    order = F.array_position(F.array(*[F.lit(s) for s in C.GRID_SLOTS]), F.col("slot"))

    def listed(test):
        picked = F.array_sort(F.collect_list(F.when(test, F.struct(order.alias("o"), F.col("slot").alias("s")))))
        return F.transform(picked, lambda x: x["s"])

    return columns.groupBy(*PAGE).agg(
        listed(F.col("populated")).alias("visit_columns"), listed(F.col("ink_only")).alias("unread_columns"),
        listed(~F.col("populated") & ~F.col("ink_only")).alias("blank_columns"))


def page_columns(pages: DataFrame, reason) -> DataFrame:
    """P10: `grid_summary` of pages whose cells are one array, which a page's grid bounds; `reason` gives why a cell is empty."""
    slots = lambda test: F.array_distinct(F.transform(F.filter("cells", test), lambda c: c["slot"]))
    inked = lambda c: _of_visit(c["row"]) & (reason(c) == "CELL_INK_UNREAD")
    printed = F.array(*[F.lit(s) for s in C.GRID_SLOTS])
    found = pages.select(*PAGE, F.array_distinct(F.transform("cells", lambda c: c["slot"])).alias("_all"), slots(lambda c: _written(c["row"], c["strong_text"])).alias("_text"), slots(inked).alias("_ink"))
    every, text, ink = F.array_intersect(printed, F.col("_all")), F.array_intersect(printed, F.col("_text")), F.array_intersect(printed, F.col("_ink"))
    return found.select(*PAGE, text.alias("visit_columns"), F.array_except(ink, "_text").alias("unread_columns"), F.array_except(F.array_except(every, "_text"), "_ink").alias("blank_columns"))


def value_beside(labels: DataFrame, lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """The text after `label:` in its own box, else the nearest box to its right on the same line.

    `labels` has one row per page and label with its box, so the join gives at most labels x lines of a page, and the
    nearest box is a minimum, not a sort.
    """
    # What follows the first colon of the label's own box.
    colons = F.translate("text", "\uff1a\ufe55\ufe13", ":::")  # full-width, small and vertical colons are the same sign
    own = F.when(F.contains(colons, F.lit(":")), strip(F.regexp_replace(colons, r"^[^:]*:", "")))
    known = with_centres(labels).withColumn("_own", own)
    boxes = with_centres(lines).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("line_no", "text", "confidence", "x0", "y0", "x1", "y1", "cy")])
    near = ((F.col("_line_no") != F.col("line_no")) & (F.col("_x0") >= F.col("x1") - 2)
            & (F.abs(F.col("_cy") - F.col("cy")) < 0.6 * F.col("height")) & (F.col("_x0") - F.col("x1") < 8 * F.col("height")))
    search = known.where((F.col("_own").isNull()) | (F.col("_own") == ""))
    beside = search.join(boxes, keys).where(near).groupBy(*keys, "label").agg(F.min(F.struct(
        "_x0", "_line_no", "_text", "_confidence", "_y0", "_x1", "_y1")).alias("_box"))
    joined = known.join(beside, [*keys, "label"], "left")
    inside = (F.col("_own").isNotNull()) & (F.col("_own") != "")
    pick = lambda own_value, box: F.when(inside, own_value).otherwise(F.col(f"_box.{box}"))
    rest = [c for c in labels.columns if c not in ("text", "confidence", "x0", "y0", "x1", "y1", "line_no")]
    return joined.select(*rest, "line_no", pick(F.col("_own"), "_text").alias("value_text"),
                         pick(F.col("confidence"), "_confidence").alias("value_confidence"),
                         pick(F.col("x0"), "_x0").alias("vx0"), pick(F.col("y0"), "_y0").alias("vy0"),
                         pick(F.col("x1"), "_x1").alias("vx1"), pick(F.col("y1"), "_y1").alias("vy1"))


# ------------------------------------------------------------------ boxes, photos, histograms

def mark_state(ink: Column, found: Column, labelled: Column) -> Column:
    """State of one checkbox from its measured ink."""
    return (F.when(~labelled, "LABEL_NOT_FOUND").when(~found | ink.isNull(), "BOX_NOT_FOUND")
            .when(ink >= C.MARKED_INK, "MARKED").when(ink <= C.UNMARKED_INK, "UNMARKED").otherwise("UNCLEAR"))


def mark_flag(state: Column) -> Column:
    return (F.when(state == "UNCLEAR", "CHECKBOX_UNCLEAR").when(state == "BOX_NOT_FOUND", "CHECKBOX_NOT_FOUND")
            .when(state == "LABEL_NOT_FOUND", "OCR_LABEL_NOT_FOUND"))


def resolve_choice(marks: DataFrame, keys: list[str]) -> DataFrame:
    """One value per group of boxes (state, option): exactly one marked and every other clearly empty."""
    flag = mark_flag(F.col("state"))
    kinds = ["CHECKBOX_NOT_FOUND", "CHECKBOX_UNCLEAR", "OCR_LABEL_NOT_FOUND"]
    marked = F.col("state") == "MARKED"
    grouped = marks.groupBy(*keys).agg(
        F.count_if(marked).alias("marked"), F.min(F.when(marked, F.col("option"))).alias("only"),
        *[F.bool_or(F.coalesce(flag == k, F.lit(False))).alias(f"d{i}") for i, k in enumerate(kinds)])
    doubts = F.array_compact(F.array(*[F.when(F.col(f"d{i}"), k) for i, k in enumerate(kinds)]))
    several, one, doubtful = F.col("marked") > 1, F.col("marked") == 1, F.size(doubts) > 0
    return grouped.select(
        *keys, F.when(one, F.col("only")).alias("value"),
        F.when(several | doubtful, "NEEDS_REVIEW").when(one, "KNOWN").otherwise("NOT_PROVIDED").alias("field_status"),
        F.when(several, F.concat(F.array(F.lit("CHECKBOX_MULTIPLE_MARKED")), doubts)).when(one | doubtful, doubts)
        .otherwise(F.array(F.lit("CHECKBOX_NONE_MARKED"))).alias("validation_flags"))


def box_marks(lines: DataFrame, squares: DataFrame, pages: DataFrame, catalog: list[tuple]) -> DataFrame:
    """State, ink and box of every check box of the catalog on every page.

    `catalog` has (field, option or null, pattern of the label, printed label); `squares` are the printed squares that were
    measured on a page: x0, y0, x1, y1, score of the outline, ink inside. A box belongs to a label when it lies round the
    start of the label's words, is as high as writing there, and has the best outline. Labels are found by one aggregate
    over the lines; each page's few squares meet its few labels.
    """
    text = norm(F.col("text"))
    box = F.struct("line_no", "x0", "y0", "x1", "y1", text.alias("text"))
    firsts = [F.min(F.when(text.rlike(pattern), box)).alias(f"l{i}") for i, (_f, _o, pattern, _l) in enumerate(catalog)]
    found = pages.select(*PAGE).join(lines.groupBy(*PAGE).agg(*firsts), PAGE, "left")
    start = lambda i, pattern: F.regexp_instr(F.col(f"l{i}.text"), F.lit(pattern)) - 1
    rows = F.explode(F.array(*[F.struct(
        F.lit(f).alias("field"), F.lit(o).cast("string").alias("option"), F.lit(label).alias("label"), F.lit(i).alias("order"),
        F.struct(*[F.col(f"l{i}.{c}").alias(c) for c in ("x0", "y0", "x1", "y1", "text")], start(i, pattern).alias("start")).alias("line"))
        for i, (f, o, pattern, label) in enumerate(catalog)]))
    labels = found.select(*PAGE, rows.alias("r")).select(*PAGE, "r.*")
    h = F.col("line.y1") - F.col("line.y0")
    cy = (F.col("line.y0") + F.col("line.y1")) / 2
    x = F.col("line.x0") + (F.col("line.x1") - F.col("line.x0")) * F.col("line.start") / F.greatest(F.length("line.text"), F.lit(1))
    side = F.greatest(F.col("q.x1") - F.col("q.x0"), F.col("q.y1") - F.col("q.y0"))
    near = ((F.col("q.x0") >= x - C.BOX_BEFORE * h) & (F.col("q.x1") <= x + C.BOX_AFTER * h) & (F.col("q.y0") >= cy - C.BOX_UP_DOWN * h)
            & (F.col("q.y1") <= cy + C.BOX_UP_DOWN * h) & side.between(C.BOX_SIDES[0] * h, C.BOX_SIDES[1] * h))
    each = squares.select(*PAGE, F.struct("x0", "y0", "x1", "y1", "score", "ink").alias("q"))
    # By outline, then size, then distance from the words.
    best = labels.where("line.x0 IS NOT NULL").join(each, PAGE).where(near).groupBy(*PAGE, "field", "order").agg(
        F.max_by("q", F.struct("q.score", side, -F.abs((F.col("q.x0") + F.col("q.x1")) / 2 - x))).alias("q"))
    joined = labels.join(best, [*PAGE, "field", "order"], "left")
    state = mark_state(F.col("q.ink"), F.col("q").isNotNull(), F.col("line.x0").isNotNull())
    return joined.select(*PAGE, "field", "option", "label", "order", state.alias("state"), F.col("q.ink").alias("ink"),
                         *[F.col(f"q.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def _evidence(marks: DataFrame, keys: list[str]) -> DataFrame:
    """The boxes looked at, in the order of the form, and the box round all that were found."""
    return marks.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("order", "label", "state", F.bround("ink", 3).alias("ink")))),
                    lambda m: F.struct(m["label"], m["state"], m["ink"])).alias("checkboxes"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def single_box_fields(marks: DataFrame) -> DataFrame:
    """Fields of one box each: a clear state is KNOWN, an empty box as UNMARKED; anything else goes to review."""
    flag = mark_flag(F.col("state"))
    values = marks.select(*PAGE, "field", F.when(flag.isNull(), F.col("state")).alias("value"),
                          F.when(flag.isNull(), "KNOWN").otherwise("NEEDS_REVIEW").alias("field_status"),
                          F.array_compact(F.array(flag)).alias("validation_flags"))
    return values.join(_evidence(marks, [*PAGE, "field"]), [*PAGE, "field"])


def choice_box_fields(marks: DataFrame) -> DataFrame:
    """Fields of a group of boxes, with the evidence of all of them."""
    return resolve_choice(marks, [*PAGE, "field"]).join(_evidence(marks, [*PAGE, "field"]), [*PAGE, "field"])


def photo_problem() -> Column:
    """The first reason a photo cannot be read, from its metrics."""
    return F.coalesce(
        F.when(~F.col("decodable"), "IMAGE_UNREADABLE"),
        F.when((F.col("bytes") < C.MIN_IMAGE_BYTES) | (F.least("width", "height") < C.MIN_IMAGE_SIDE), "IMAGE_TOO_SMALL"),
        F.when(F.col("mean") < C.DARK_MEAN, "IMAGE_TOO_DARK"), F.when(F.col("mean") > C.BRIGHT_MEAN, "IMAGE_OVEREXPOSED"),
        F.when(F.col("contrast") < C.MIN_CONTRAST, "IMAGE_LOW_CONTRAST"),
        F.when(F.col("sharpness") < C.MIN_SHARPNESS, "IMAGE_BLURRY"),
        F.when(F.col("text_lines") < C.MIN_TEXT_LINES, "NO_TEXT_FOUND"))


def triage_photos(metrics: DataFrame, lines: DataFrame | None = None, forced: Column | None = None) -> DataFrame:
    """retake_reason of a rejected photo; with `forced` the page is read and the problem becomes a warning."""
    if lines is not None:
        counts = lines.where("confidence >= 0.5").groupBy("page_ref").agg(F.count(F.lit(1)).alias("text_lines"))
        metrics = metrics.drop("text_lines").join(counts, "page_ref", "left").withColumn("text_lines", F.coalesce("text_lines", F.lit(0)))
    force = F.lit(False) if forced is None else forced
    return (metrics.withColumn("_problem", photo_problem())
            .withColumns({"retake_reason": F.when(~force, F.col("_problem")), "warning": F.when(force, F.col("_problem")),
                          "read": force | F.col("_problem").isNull()}).drop("_problem"))


def histogram_stats(histogram: DataFrame, keys: list[str], shares: dict[str, float], value: str = "value", count: str = "count") -> DataFrame:
    """First value whose cumulative count reaches each share of the total. A grey histogram has at most 256 rows."""
    summed = histogram.groupBy(*keys, value).agg(F.sum(count).alias("_c"))
    whole = Window.partitionBy(*keys)
    running = summed.withColumns({"_seen": F.sum("_c").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)),
                                  "_total": F.sum("_c").over(whole)})
    return running.groupBy(*keys).agg(*[F.min(F.when(F.col("_seen") >= s * F.col("_total"), F.col(value))).alias(n)
                                        for n, s in shares.items()])


def ink_and_contrast(histogram: DataFrame, keys: list[str], value: str = "value", count: str = "count") -> DataFrame:
    """Ink depth (p90 - p1, at least 40) and contrast (p99.5 - p0.5) per page."""
    p = histogram_stats(histogram, keys, {"p1": 0.01, "p90": 0.9, "p05": 0.005, "p995": 0.995}, value, count)
    return p.select(*keys, F.greatest(F.lit(C.MIN_INK_DEPTH), F.col("p90") - F.col("p1")).alias("ink_depth"),
                    (F.col("p995") - F.col("p05")).alias("contrast"))


# ------------------------------------------------------------------ pages and documents

def page_entries(pages: DataFrame) -> DataFrame:
    """One entry per page from (section, section_confidence, hint, unread_code, retake_reason, grid_found,
    grid_unread): a reviewer's section settles the page, otherwise the first doubt is the review reason."""
    hint = F.col("hint").isNotNull()
    read = F.col("unread_code").isNull()
    doubt = F.when(~read, F.col("unread_code")).when(F.col("section_confidence") == "none", "UNKNOWN_LAYOUT").when(
        F.col("section_confidence") == "low", "SECTION_UNCERTAIN")
    section = F.coalesce("hint", F.when(read, F.col("section")), F.lit("unknown"))
    on_grid = section == "current_pregnancy"
    grid_doubt = F.when(read & on_grid & ~F.coalesce("grid_found", F.lit(False)), "GRID_NOT_FOUND").when(
        read & on_grid & F.coalesce("grid_unread", F.lit(False)), "GRID_COLUMN_UNREAD")
    return pages.select(
        "document_id", "page_ref", section.alias("section"), F.when(hint, "reviewer").otherwise("detected").alias("section_source"),
        F.when(~hint & read, F.col("section_confidence")).alias("section_confidence"), read.alias("read"), "retake_reason",
        F.when(~hint, F.coalesce(doubt, grid_doubt)).alias("review_reason"))


def document_outcome(entries: DataFrame) -> DataFrame:
    """A document none of whose pages was read fails; the reason is the strongest over its pages."""
    counted = entries.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("read").alias("read_pages"),
        F.bool_and(F.col("retake_reason").isNotNull()).alias("_retake"),
        F.bool_or(F.coalesce(F.col("unread_code") == "OCR_TIMEOUT", F.lit(False))).alias("_timeout"))
    return counted.select("document_id", "pages", "read_pages", F.when(F.col("read_pages") > 0, "DRAFT")
                          .when(F.col("_retake"), "RETAKE_REQUIRED").when(F.col("_timeout"), "OCR_TIMEOUT")
                          .otherwise("OCR_FAILED").alias("outcome"))


def failed_pages(entries: DataFrame) -> DataFrame:
    """Why each page of a failed document was not read: the reason for a retake, else the code. A document may have any
    number of pages, so they stay rows."""
    failed = document_outcome(entries).where("read_pages = 0").select("document_id", "outcome")
    return entries.join(failed, "document_id").select("document_id", "page_ref", "outcome", F.coalesce("retake_reason", "unread_code").alias("reason"))


def newborn_period(lines: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """The period of a newborn page; a page with none or both titles has no row."""
    found = page_signs(lines, C.PERIOD_TITLES, keys)
    return found.where(F.col("s0") != F.col("s1")).select(*keys, F.when(F.col("s0"), "EARLY").otherwise("LATE").alias("period"))


def sections_present(entries: DataFrame, periods: DataFrame) -> DataFrame:
    """Extended sections a document may have: those printed on a page type that was read."""
    holds = {"identification": ["patient", "pregnancy", "previous_deliveries"], "current_pregnancy": ["pregnancy", "visit_labs"],
             "delivery": ["delivery", "newborns"], "newborn": ["newborn_consultations"]}
    read = entries.where("read")
    dated = read.where("section = 'newborn'").join(periods, ["document_id", "page_ref"], "left_semi")
    pages = read.where("section <> 'newborn'").unionByName(dated)
    names = None
    for page, found in holds.items():
        test, value = F.col("section") == page, F.array(*[F.lit(x) for x in found])
        names = F.when(test, value) if names is None else names.when(test, value)
    return pages.select("document_id", F.explode(names).alias("section")).distinct()


def bbox_fraction(x: Column, size: Column) -> Column:
    """P20: a pixel position as a share of the image, clamped to it, four decimals."""
    return F.bround(F.least(F.greatest(x / size, F.lit(0.0)), F.lit(1.0)), 4)


def with_sources(cells: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """P20: cells with their place on the photo (ix0..iy1, turned back by the page's angle) and `source`: page, row, column and
    box as shares of the image. `pages` has angle, width and height of each page; without it the cells have them."""
    sized = cells if pages is None else cells.join(pages.select(*PAGE, "angle", "width", "height"), PAGE, "left")
    placed = image_rect(sized.withColumn("angle", F.coalesce("angle", F.lit(0.0))))
    return cell_boxes(placed).withColumn("source", F.struct("page_ref", F.col("row").alias("row"), F.col("slot").alias("column"), "bbox")).drop("bbox", "angle")


def cell_boxes(cells: DataFrame) -> DataFrame:
    """P20: the box of each cell's text, or of the cell itself when it is empty, as fractions of the image."""
    def side(text, cell, size):
        return bbox_fraction(F.coalesce(F.col(text), F.col(cell)), F.col(size))
    return cells.withColumn("bbox", F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.array(
        side("bx0", "ix0", "width"), side("by0", "iy0", "height"), side("bx1", "ix1", "width"), side("by1", "iy1", "height"))))
