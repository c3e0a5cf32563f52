"""P4-P7, P10-P12 on whole pages at a time: the rules of `layout` in column form, for lines that stand together by page.

A page is one photo, so all that is asked of it can be answered in one pass over its lines, without a join or a shuffle.
Rows come as Arrow batches in which the rows of a page follow each other; the last page of a batch waits for the next one.
A block of pages is worked on as columns, and texts are looked at once for each different one. The results are those of
`layout.skew`, `deskew`, `find_grid`, `assign_cells`, `filled_cells` and `reading.find_labels` / `layout.value_beside`.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .. import catalog as C
from ..functions.text import BLANKS

# Values, not the module: functions sent to workers take them along.
SLOTS, ROWS, SPAN_SHARE, MAX_SKEW = list(C.GRID_SLOTS), [r[0] for r in C.GRID_ROWS], C.SPAN_SHARE, C.MAX_SKEW_RADIANS
VISIT, MONTH = (re.compile(f"^(?:{p})$", re.ASCII) for p in (C.VISIT_HEADER, C.MONTH_HEADER))
ROW_LABELS = [re.compile(f"^(?:{p})" + r"(?:\s*\(.*\))?$", re.ASCII) for _r, p, _l, _lab in C.GRID_ROWS]
LABELLED = [(section, field, re.compile(pattern, re.ASCII)) for section, field, pattern, _w in C.LABELLED]
DELIVERY_HEADER = re.compile(f"^{C.PREVIOUS_DELIVERY_HEADER}$", re.ASCII)
DELIVERY_ROWS = [(field, re.compile(pattern, re.ASCII)) for field, pattern in C.PREVIOUS_DELIVERY_ROWS]
DASHES = list(C.DASHES)
_BLANKS = dict.fromkeys(map(ord, BLANKS), " ")
_COLONS = dict.fromkeys(map(ord, "\uff1a\ufe55\ufe13"), ":")


def norm(text: str) -> str:
    """`functions.text.norm` of one text."""
    if not text.isascii():
        text = "".join(unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in text if ord(c) < 0x10000)
    return re.sub(r"\s+", " ", text.lower(), flags=re.ASCII).strip(" ")


def strip(text: str) -> str:
    """`functions.text.strip` of one text."""
    return (text if text.isascii() else text.translate(_BLANKS)).strip(" \t\n\x0b\f\r")


class Block:
    """The lines of whole pages: `page` numbers them, `document_id` and `page_ref` name each page, `text` is a code of `words`."""

    def __init__(self, document_id: pa.Array, page_ref: pa.Array, page, line_no, text, words: list[str], confidence, x0, y0, x1, y1):
        self.document_id, self.page_ref, self.pages = document_id, page_ref, len(page_ref)
        self.page, self.line_no, self.text, self.words, self.confidence = page, line_no, text, words, confidence
        self.x0, self.y0, self.x1, self.y1 = x0, y0, x1, y1
        self.labels = [norm(w) for w in words]

    def told(self, test: Callable[[str], bool]) -> np.ndarray:
        """Which lines' normalised text passes."""
        return np.array([bool(test(w)) for w in self.labels] or [False])[self.text]

    def named(self, page: np.ndarray) -> dict[str, pa.Array]:
        at = pa.array(page)
        return {"document_id": self.document_id.take(at), "page_ref": self.page_ref.take(at)}


def _sums(page: np.ndarray, value: np.ndarray, pages: int) -> np.ndarray:
    return np.bincount(page, value, pages)


def _per_page(how, page: np.ndarray, value: np.ndarray, pages: int, start: float) -> np.ndarray:
    out = np.full(pages, start)
    how.at(out, page, value)
    return out


def angles(b: Block) -> np.ndarray:
    """The slope of the header row of each page in radians, NaN without four anchors or a plausible slope."""
    head = np.flatnonzero(b.told(lambda w: VISIT.match(w) or MONTH.match(w)))
    page, x, y = b.page[head], (b.x0[head] + b.x1[head]) / 2, (b.y0[head] + b.y1[head]) / 2
    n = np.bincount(page, minlength=b.pages)
    known = ~(np.isnan(x) | np.isnan(y))
    page, x, y = page[known], x[known], y[known]
    # Against the page's first anchor, so that equal places differ by nothing at all.
    first = np.full(b.pages, -1)
    first[page[::-1]] = np.arange(len(page))[::-1]
    x, y, m = x - x[first[page]], y - y[first[page]], np.maximum(np.bincount(page, minlength=b.pages), 1)
    x, y = x - (_sums(page, x, b.pages) / m)[page], y - (_sums(page, y, b.pages) / m)[page]
    xx, xy = _sums(page, x * x, b.pages), _sums(page, x * y, b.pages)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arctan(np.where(xx > 0, xy / xx, np.nan))
    return np.where((n >= 4) & (np.abs(angle) <= MAX_SKEW), angle, np.nan)


def straightened(b: Block) -> np.ndarray:
    """P5: turn the lines of each page by its angle in place; the boxes as read are kept in sx0..sy1. Gives the angles used."""
    found = angles(b)
    used = np.where(np.isnan(found), 0.0, found)
    b.sx0, b.sy0, b.sx1, b.sy1 = b.x0, b.y0, b.x1, b.y1
    turn = used[b.page]
    cx, cy, cos, sin = (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2, np.cos(used)[b.page], np.sin(used)[b.page]
    mx, my, w, h = cx * cos + cy * sin, cy * cos - cx * sin, (b.x1 - b.x0) / 2, (b.y1 - b.y0) / 2
    moved = turn != 0
    b.x0, b.y0, b.x1, b.y1 = (np.where(moved, new, old) for new, old in ((mx - w, b.x0), (my - h, b.y0), (mx + w, b.x1), (my + h, b.y1)))
    return used


class Grids:
    """Of each page whether it has a grid, its header's bottom, the left edges and the last right edge of the nine columns,
    and top and bottom of each row (NaN where its label is missing)."""

    def __init__(self, b: Block):
        n, cx, cy, height = b.pages, (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2, b.y1 - b.y0
        self.found, self.bottom = np.zeros(n, bool), np.full(n, np.nan)
        self.lefts, self.right = np.full((n, 9), np.nan), np.full(n, np.nan)
        self.tops, self.bottoms = np.full((n, len(ROWS)), np.nan), np.full((n, len(ROWS)), np.nan)
        is_visit, is_month = b.told(VISIT.match), b.told(MONTH.match)
        # A text that reads as both is a visit, as there.
        visit, month = np.flatnonzero(is_visit), np.flatnonzero(is_month & ~is_visit)
        full = (np.bincount(b.page[visit], minlength=n) == 6) & (np.bincount(b.page[month], minlength=n) == 3)
        full &= _per_page(np.fmax, b.page[visit], b.x0[visit], n, -np.inf) < _per_page(np.fmin, b.page[month], b.x0[month], n, np.inf)
        head = np.sort(np.concatenate([visit, month]))
        head = head[full[b.page[head]]]
        if not len(head):
            return
        head = head[np.lexsort((height[head], cy[head], b.line_no[head], b.x0[head], b.page[head]))].reshape(-1, 9)
        page, x = b.page[head[:, 0]], b.x0[head]
        gaps, mid = np.sort(np.diff(x, axis=1), axis=1), np.sort(cy[head], axis=1)[:, 4:5]
        level = ~(np.abs(cy[head] - mid) > 2 * height[head]).any(axis=1)
        width = (gaps[:, 3] + gaps[:, 4]) / 2
        low = b.y1[head].max(axis=1)
        page, x, width, low = page[level], x[level], width[level], low[level]
        self.lefts[page], self.bottom[page] = x - 0.15 * width[:, None], low
        self.right[page] = self.lefts[page, 8] + width
        # Row labels: left of the columns and below the header, from top to bottom.
        near = np.flatnonzero((cx < self.lefts[b.page, 0]) & (cy > self.bottom[b.page]))
        near = near[np.lexsort((b.line_no[near], cy[near], b.page[near]))]
        page, y = b.page[near], cy[near]
        same = page[1:] == page[:-1]
        step = np.where(same, np.diff(y), np.nan)
        before, after = np.full(len(y), np.nan), np.full(len(y), np.nan)
        before[1:], after[:-1] = np.where(same, y[:-1], np.nan), np.where(same, y[1:], np.nan)
        count = np.bincount(page, minlength=n)
        where, step = page[:-1][same], step[same]
        step = step[np.lexsort((step, where))]
        steps = np.maximum(count - 1, 0)
        start = np.concatenate([[0], np.cumsum(steps)])[:-1]
        half = np.full(n, np.nan)
        some = steps > 0
        half[some] = (step[start[some] + (steps[some] - 1) // 2] + step[start[some] + steps[some] // 2]) / 4
        for i, pattern in enumerate(ROW_LABELS):
            hit = np.flatnonzero(np.array([bool(pattern.match(w)) for w in b.labels])[b.text[near]])[::-1]
            first = np.full(n, -1)
            first[page[hit]] = hit
            has = np.flatnonzero(first >= 0)
            f = first[has]
            self.tops[has, i] = np.where(np.isnan(before[f]), y[f] - half[has], (before[f] + y[f]) / 2)
            self.bottoms[has, i] = np.where(np.isnan(after[f]), y[f] + half[has], (after[f] + y[f]) / 2)
        self.found = (count >= 3) & ~np.isnan(self.tops[:, 0])

    def rows(self, b: Block) -> dict[str, pa.Array]:
        """The rows of `layout.find_grid`."""
        page = np.flatnonzero(self.found)
        lefts = self.lefts[page]
        rights = np.concatenate([lefts[:, 1:], self.right[page][:, None]], axis=1)
        columns = pa.StructArray.from_arrays([pa.array(SLOTS * len(page), pa.string()), pa.array(lefts.ravel()), pa.array(rights.ravel())], ["slot", "left", "right"])
        has = ~np.isnan(self.tops[page])
        names = pa.array(ROWS).take(pa.array(np.nonzero(has)[1]))
        rows = pa.StructArray.from_arrays([names, pa.array(self.tops[page][has]), pa.array(self.bottoms[page][has])], ["row", "top", "bottom"])
        ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return {**b.named(page), "header_bottom": pa.array(self.bottom[page]), "columns": pa.ListArray.from_arrays(ends(np.full(len(page), 9)), columns),
                "rows": pa.ListArray.from_arrays(ends(has.sum(axis=1)), rows)}


class Pieces:
    """Pieces of text by page, column and row, in the order of their lines. `line` is the line each comes from; `text`
    codes the words of the block, -1 for the mark of a cell that a box of another column touches (`spans`)."""

    def __init__(self, b: Block, g: Grids):
        cy = (b.y0 + b.y1) / 2
        line = np.flatnonzero(g.found[b.page] & (cy > g.bottom[b.page]))
        page, y, row = b.page[line], cy[line], np.full(len(line), -1)
        for i in reversed(range(len(ROWS))):
            row[(y >= g.tops[page, i]) & (y < g.bottoms[page, i])] = i
        keep = row >= 0
        line, page, row = line[keep], page[keep], row[keep]
        x0, x1 = b.x0[line], b.x1[line]
        share, touched, edges = SPAN_SHARE * np.maximum(x1 - x0, 1e-6), np.zeros(len(line), np.int8), [*g.lefts.T, g.right]
        middle, column = (x0 + x1) / 2, np.full(len(line), -1)
        touch = lambda i, at: np.minimum(x1[at], edges[i + 1][page[at]]) - np.maximum(x0[at], edges[i][page[at]]) > share[at]
        for i in range(9):
            low, high = edges[i][page], edges[i + 1][page]
            touched += np.minimum(x1, high) - np.maximum(x0, low) > share
            column[(column < 0) & (middle >= low) & (middle < high)] = i
        across, whole = touched > 1, np.flatnonzero((touched <= 1) & (column >= 0))
        out = [line[whole], page[whole], column[whole], row[whole], b.text[line[whole]], x0[whole], x1[whole], np.zeros(len(whole), bool), np.zeros(len(whole), bool)]
        more = []
        for k in np.flatnonzero(across):
            text, p = b.words[b.text[line[k]]], page[k]
            found = list(re.finditer(r"[^ \t\n\x0b\f\r]+", text))
            parts = [(text, 0.0, 1.0)] if len(found) < 2 else [(m.group(), m.start() / len(text), m.end() / len(text)) for m in found]
            for word, start, stop in parts:
                a, z = x0[k] + start * (x1[k] - x0[k]), x0[k] + stop * (x1[k] - x0[k])
                at = [i for i in range(9) if edges[i][p] <= (a + z) / 2 < edges[i + 1][p]]
                if at:
                    b.words.append(word)
                    more.append((line[k], p, at[0], row[k], len(b.words) - 1, a, z, not re.search("[0-9]", word), False))
            more += [(line[k], p, i, row[k], -1, np.nan, np.nan, False, True) for i in range(9) if touch(i, k)]
        if more:
            out = [np.concatenate([a, np.array(z, a.dtype)]) for a, z in zip(out, zip(*more))]
        self.line, self.page, self.column, self.row, self.text, self.x0, self.x1, self.weak, self.spans = out

    def rows(self, b: Block) -> dict[str, pa.Array]:
        code = pa.array(self.text, mask=self.text < 0)
        return {**b.named(self.page), "slot": pa.array(SLOTS).take(pa.array(self.column)), "row": pa.array(ROWS).take(pa.array(self.row)), "text": pa.array(b.words, pa.string()).take(code)}


class Cells:
    """The cells that something was assigned to, as `layout.filled_cells` gives them. `key` numbers page, column and row."""

    def __init__(self, b: Block, p: Pieces):
        key = (p.page.astype(np.int64) * 9 + p.column) * len(ROWS) + p.row
        order = np.lexsort((b.line_no[p.line], p.x0, key))
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        self.key = key[start]
        read, line = ~p.spans[order], p.line[order]
        spread = lambda values, how, none: how.reduceat(np.where(read, values, none), start) if len(start) else np.zeros(0)
        least, most = (lambda v: spread(v[line], np.fmin, np.nan)), (lambda v: spread(v[line], np.fmax, np.nan))
        self.confidence, self.bx0, self.by0, self.bx1, self.by1 = least(b.confidence), least(b.sx0), least(b.sy0), most(b.sx1), most(b.sy1)
        self.spans = np.logical_or.reduceat(~read, start) if len(start) else np.zeros(0, bool)
        words = [strip(w) for w in b.words] + [""]
        # Most cells hold one piece; the others are put together from left to right.
        self.text = p.text[order[start]] if len(start) else np.zeros(0, int)
        self.text = np.where(self.text < 0, len(words) - 1, self.text)
        self.strong = np.where(p.weak[order[start]], len(words) - 1, self.text) if len(start) else self.text
        size = np.diff(np.concatenate([start, [len(key)]]))
        for c in np.flatnonzero(size > 1):
            parts = [(p.x0[j], b.line_no[p.line[j]], b.words[p.text[j]], bool(p.weak[j])) for j in order[start[c]:start[c] + size[c]] if not p.spans[j]]
            parts.sort()
            words += [strip(" ".join(t for _x, _n, t, _w in parts)), strip(" ".join(t for _x, _n, t, w in parts if not w))]
            self.text[c], self.strong[c] = len(words) - 2, len(words) - 1
        self.words = pa.array(words, pa.string())
        self.empty = np.array([w == "" for w in words])

    def columns(self, b: Block, g: Grids, angle: np.ndarray, every: bool) -> dict[str, Callable[[], pa.Array]]:
        """The columns of `layout.grid_cells` (`every`) or `written_cells`, each made when it is asked for."""
        own = np.flatnonzero(~self.empty[self.text])
        if every:
            page = np.flatnonzero(g.found)
            key = ((page[:, None, None] * 9 + np.arange(9)[:, None]) * len(ROWS) + np.arange(len(ROWS)))[np.broadcast_to(~np.isnan(g.tops[page])[:, None, :], (len(page), 9, len(ROWS)))]
            at = np.searchsorted(self.key, key)
            has = at < len(self.key)
            has[has] = self.key[at[has]] == key[has]
            at = np.where(has, at, 0)
        else:
            key, at, has = self.key[own], own, np.ones(len(own), bool)
        page, slot, row = key // (9 * len(ROWS)), key // len(ROWS) % 9, key % len(ROWS)
        pick = lambda values: pa.array(np.where(has, values[at] if len(values) else 0, np.nan), from_pandas=True)
        words = lambda code: self.words.take(pa.array(code[at] if len(code) else at, mask=~has))
        return {"document_id": lambda: b.document_id.take(pa.array(page)), "page_ref": lambda: b.page_ref.take(pa.array(page)),
                "slot": lambda: pa.array(SLOTS).take(pa.array(slot)), "row": lambda: pa.array(ROWS).take(pa.array(row)),
                "text": lambda: words(self.text), "strong_text": lambda: words(self.strong).fill_null(""), "confidence": lambda: pick(self.confidence),
                **{c: (lambda c=c: pick(getattr(self, c))) for c in ("bx0", "by0", "bx1", "by1")},
                "spans": lambda: pa.array(has & (self.spans[at] if len(self.spans) else False)), "left": lambda: pa.array(g.lefts[page, slot]),
                "right": lambda: pa.array(np.where(slot < 8, g.lefts[page, np.minimum(slot + 1, 8)], g.right[page])),
                "top": lambda: pa.array(np.maximum(g.tops[page, row], g.bottom[page])), "bottom": lambda: pa.array(g.bottoms[page, row]),
                "angle": lambda: pa.array(angle[page])}


def _wanted(columns: dict, names: list[str]) -> dict[str, pa.Array]:
    return {n: columns[n]() for n in names}


# ------------------------------------------------------------------ what is asked of a block of pages

def skew_rows(b: Block, names: list[str]) -> dict[str, pa.Array]:
    found = angles(b)
    page = np.flatnonzero(~np.isnan(found))
    return {**b.named(page), "angle": pa.array(found[page])}


def line_rows(b: Block, names: list[str]) -> dict[str, pa.Array]:
    straightened(b)
    return {**b.named(b.page), "line_no": pa.array(b.line_no.astype(np.int32)), **{c: pa.array(getattr(b, c), from_pandas=True) for c in ("x0", "y0", "x1", "y1")}}


def grid_rows(b: Block, names: list[str]) -> dict[str, pa.Array]:
    straightened(b)
    return Grids(b).rows(b)


def piece_rows(b: Block, names: list[str]) -> dict[str, pa.Array]:
    straightened(b)
    return Pieces(b, Grids(b)).rows(b)


def _cells(b: Block, names: list[str], every: bool) -> dict[str, pa.Array]:
    angle = straightened(b)
    g = Grids(b)
    return _wanted(Cells(b, Pieces(b, g)).columns(b, g, angle, every), names)


def cell_rows(b: Block, names: list[str]) -> dict[str, pa.Array]:
    return _cells(b, names, True)


def written_rows(b: Block, names: list[str]) -> dict[str, pa.Array]:
    return _cells(b, names, False)


def page_cells(b: Block, names: list[str]) -> dict[str, pa.Array]:
    """All cells of a page as one array."""
    inner = ["slot", "row", "text", "strong_text", "spans"]
    angle = straightened(b)
    g = Grids(b)
    found = _wanted(Cells(b, Pieces(b, g)).columns(b, g, angle, True), inner)
    page = np.flatnonzero(g.found)
    sizes = 9 * (~np.isnan(g.tops[page])).sum(axis=1)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return {**b.named(page), "cells": pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([found[n] for n in inner], inner))}


def labelled_rows(section: str) -> Callable[[Block, list[str]], dict[str, pa.Array]]:
    """Per page of a section and label of its list: whether the label was found, and the text and confidence of its value."""
    def rows(b: Block, names: list[str]) -> dict[str, pa.Array]:
        straightened(b)
        cy, out = (b.y0 + b.y1) / 2, []
        colons = [w.translate(_COLONS) for w in b.words]
        own = [strip(w.split(":", 1)[1]) if ":" in w else "" for w in colons] + [None]
        every = np.arange(b.pages)
        for field, pattern in [(f, p) for s, f, p in LABELLED if s == section]:
            hit = np.flatnonzero(b.told(pattern.search))
            hit = hit[np.lexsort((b.line_no[hit], b.page[hit]))][::-1]
            first = np.full(b.pages, -1)
            first[b.page[hit]] = hit
            code = np.where(first >= 0, b.text[first], len(own) - 1)
            empty = np.array([not o for o in own])
            value, confidence = pa.array(own, pa.string()).take(pa.array(code)), np.where(first >= 0, b.confidence[first], np.nan)
            # The nearest box to the right, where the label's own box holds nothing.
            seek = (first >= 0) & empty[code]
            if seek.any():
                lines = np.flatnonzero(seek[b.page])
                f = first[b.page[lines]]
                height = b.y1[f] - b.y0[f]
                near = (b.line_no[lines] != b.line_no[f]) & (b.x0[lines] >= b.x1[f] - 2) & (np.abs(cy[lines] - cy[f]) < 0.6 * height) & (b.x0[lines] - b.x1[f] < 8 * height)
                lines = lines[near]
                lines = lines[np.lexsort((b.line_no[lines], b.x0[lines], b.page[lines]))][::-1]
                beside = np.full(b.pages, -1)
                beside[b.page[lines]] = lines
                has = beside >= 0
                raw = pa.array(b.words, pa.string()).take(pa.array(np.where(has, b.text[beside], 0), mask=~has))
                value = pa.compute.if_else(pa.array(seek), raw, value)
                confidence = np.where(seek, np.where(has, b.confidence[beside], np.nan), confidence)
            out.append({**b.named(every), "label": pa.array([field] * b.pages, pa.string()), "found": pa.array(first >= 0), "value_text": value, "value_confidence": pa.array(confidence, from_pandas=True)})
        return {n: pa.concat_arrays([o[n] for o in out]) for n in out[0]}
    return rows


# ------------------------------------------------------------------ the tables of an identification page

def clean_line(text: str) -> str:
    """`reading.clean_line` of one text."""
    return re.sub(r"\s+", " ", re.sub(r"[_…]+|\.{2,}", " ", text), flags=re.ASCII).strip(" .:")


def _bands(labels: list[tuple]) -> dict[tuple, tuple[float, float]]:
    """`reading.row_bands`: top and bottom of each label (cy, line_no, ...), none where there is only one."""
    labels = sorted(labels)
    if len(labels) < 2:
        return {}
    ys = [label[0] for label in labels]
    half = sorted(b - a for a, b in zip(ys, ys[1:]))[(len(ys) - 1) // 2] / 2
    return {label: ((ys[i - 1] + y) / 2 if i else y - half, (ys[i + 1] + y) / 2 if i + 1 < len(ys) else y + half) for i, (label, y) in enumerate(zip(labels, ys))}


class _Lines:
    """The lines of one page after the other as (cy, line_no, code, x0, x1, height, confidence, cx, y1)."""

    def __init__(self, b: Block):
        order = np.argsort(b.page, kind="stable")
        self.ends = np.cumsum(np.bincount(b.page, minlength=b.pages)).tolist()
        cx, cy = (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2
        self.rows = list(zip(*(v[order].tolist() for v in (cy, b.line_no, b.text, b.x0, b.x1, b.y1 - b.y0, b.confidence, cx, b.y1))))
        self.words, self.clean, self.raw = b.words, [clean_line(w) for w in b.words], [strip(w) for w in b.words]
        self.alone = [strip(w) for w in self.clean]

    def __iter__(self):
        start = 0
        for end in self.ends:
            yield self.rows[start:end]
            start = end

    def band(self, lines: list[tuple], top: float, bottom: float) -> list[tuple]:
        """The lines of a row from left to right."""
        return sorted((x0, no, self.words[code], code, c, x) for y, no, code, x0, _x1, _h, c, x, _y1 in lines if top <= y < bottom)

    def cell(self, band: list[tuple], left: float, right: float):
        """Text, text as written and least confidence of what stands in a column of a row; nulls where nothing does."""
        inside = [line for line in band if left <= line[5] < right]
        if not inside:
            return None, None, None
        known = [line[4] for line in inside if line[4] == line[4]]
        confidence = min(known) if known else None
        if len(inside) == 1:
            code = inside[0][3]
            return self.alone[code], self.raw[code], confidence
        return strip(" ".join(t for t in (self.clean[line[3]] for line in inside) if t)), strip(" ".join(line[2] for line in inside)), confidence


def abortion_rows(b: Block, names: list[str]) -> dict[str, pa.Array]:
    """Per page the cell of row `Avortement` under the column `Nombre`, and whether both were found."""
    is_head, is_row = [w == "nombre" for w in b.labels], [w.startswith("avortement") for w in b.labels]
    pages, out = _Lines(b), []
    for lines in pages:
        head = min(((no, x0, x1, y, h) for y, no, code, x0, x1, h, _c, _x, _y1 in lines if is_head[code]), default=None)
        row = min(((no, x0, x1, y, h) for y, no, code, x0, x1, h, _c, _x, _y1 in lines if is_row[code]), default=None)
        found = (False, None, None)
        if head and row:
            _no, hx0, hx1, hy, hh = head
            nexts = [x0 for y, _n, _k, x0, *_rest in lines if x0 > hx1 and abs(y - hy) < hh]
            if nexts:
                pitch = min(nexts) - hx0
                left, right = hx0 - 0.1 * pitch, hx0 + 0.9 * pitch
                bands = _bands([line for line in lines if line[4] < left and hy - 2 * hh < line[0] < row[3] + 4 * row[4]])
                own = [band for label, band in bands.items() if label[1] == row[0]]
                if own:
                    text, _raw, confidence = pages.cell(pages.band(lines, *own[0]), left, right)
                    found = (True, text, confidence)
        out.append(found)
    found, text, confidence = zip(*out) if out else ((), (), ())
    return {"document_id": b.document_id, "page_ref": b.page_ref, "found": pa.array(found, pa.bool_()), "text": pa.array(text, pa.string()), "confidence": pa.array(confidence, pa.float64())}


def delivery_rows(b: Block, names: list[str]) -> dict[str, pa.Array]:
    """Date and mode cells of each previous delivery whose column holds writing; item = its column number 1..5."""
    numbers = [int(m[1]) if (m := DELIVERY_HEADER.match(w)) and re.fullmatch("[1-5]", m[1] or "") else 0 for w in b.labels]
    is_stop = [bool(re.search(r"^gestation\b", w, re.ASCII)) for w in b.labels]
    is_row = [[bool(p.search(w)) for w in b.labels] for _f, p in DELIVERY_ROWS]
    pages, out = _Lines(b), []
    for at, lines in enumerate(pages):
        heads = {}
        for y, no, code, x0, _x1, _h, _c, _x, y1 in lines:
            if numbers[code]:
                heads[numbers[code]] = min(heads.get(numbers[code], (no, x0, y1)), (no, x0, y1))
        if len(heads) < 3 or [n for _x, n in sorted((h[1], n) for n, h in heads.items())] != sorted(heads):
            continue
        first, last, low = min(heads), max(heads), max(h[2] for h in heads.values())
        pitch = (heads[last][1] - heads[first][1]) / (last - first)
        left = heads[first][1] + (1 - first - 0.1) * pitch
        stop = min((line[0] for line in lines if is_stop[line[2]] and line[0] > low), default=float("inf"))
        bands = _bands([line for line in lines if line[4] < left and low < line[0] < stop])
        rows = [next((band for label, band in bands.items() if test[label[2]]), None) for test in is_row]
        if rows[0] is None or rows[1] is None:
            continue
        rows = [(field, pages.band(lines, *band)) for (field, _p), band in zip(DELIVERY_ROWS, rows) if band]
        for item in range(1, 6):
            x = left + (item - 1) * pitch
            cells = [(field, pages.cell(row, x, x + pitch)) for field, row in rows]
            if any(raw and raw not in DASHES for _f, (_t, raw, _c) in cells):
                out += [(at, item, field, text, confidence) for field, (text, _raw, confidence) in cells if field.startswith("previous_delivery")]
    at, item, field, text, confidence = zip(*out) if out else ((),) * 5
    return {**b.named(np.array(at, np.int64)), "item": pa.array(item, pa.int32()), "field": pa.array(field, pa.string()), "text": pa.array(text, pa.string()), "confidence": pa.array(confidence, pa.float64())}


PAGE_SCHEMA = "document_id string, page_ref string"
_TYPES = {"text": "string", "strong_text": "string", "document_id": "string", "page_ref": "string", "slot": "string", "row": "string", "spans": "boolean"}
SCHEMAS = {skew_rows: f"{PAGE_SCHEMA}, angle double", line_rows: f"{PAGE_SCHEMA}, line_no int, x0 double, y0 double, x1 double, y1 double",
           grid_rows: f"{PAGE_SCHEMA}, header_bottom double, columns array<struct<slot:string,left:double,right:double>>, rows array<struct<row:string,top:double,bottom:double>>",
           piece_rows: f"{PAGE_SCHEMA}, slot string, row string, text string",
           abortion_rows: f"{PAGE_SCHEMA}, found boolean, text string, confidence double", delivery_rows: f"{PAGE_SCHEMA}, item int, field string, text string, confidence double",
           page_cells: f"{PAGE_SCHEMA}, cells array<struct<slot:string,row:string,text:string,strong_text:string,spans:boolean>>"}
LABELLED_SCHEMA = f"{PAGE_SCHEMA}, label string, found boolean, value_text string, value_confidence double"


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut between pages."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table]).combine_chunks()
        last = page_starts(table)[-1]
        kept = table.slice(last)
        if last:
            yield table.slice(0, last)
    if kept is not None and kept.num_rows:
        yield kept


def page_starts(table: pa.Table) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        new[1:] = False
        for name in ("document_id", "page_ref"):
            values = table.column(name).combine_chunks()
            new[1:] |= pa.compute.not_equal(values.slice(1), values.slice(0, len(values) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def by_page(rows: DataFrame, block: Callable[[pa.Table], Block], ask: Callable[[Block, list[str]], dict[str, pa.Array]], names: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """`ask` of every page. The rows of a page must follow each other in one partition; `block` makes the lines of whole pages from them."""
    schema = schema or SCHEMAS.get(ask) or ", ".join(f"{n} {_TYPES.get(n, 'double')}" for n in names)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_pages(batches):
            found = ask(block(table), names)
            yield pa.RecordBatch.from_pydict(found)

    return rows.mapInArrow(answer, schema)


def block_of_lines(table: pa.Table) -> Block:
    """The block of rows that are lines already."""
    start = page_starts(table)
    page = np.repeat(np.arange(len(start)), np.diff(np.concatenate([start, [table.num_rows]])))
    column = lambda n: table.column(n).combine_chunks()
    text = column("text").fill_null("").dictionary_encode()
    at = pa.array(start)
    return Block(column("document_id").take(at), column("page_ref").take(at), page, column("line_no").to_numpy(zero_copy_only=False), text.indices.to_numpy(zero_copy_only=False).astype(np.int64), text.dictionary.to_pylist(),
                 *[column(n).to_numpy(zero_copy_only=False).astype(float) for n in ("confidence", "x0", "y0", "x1", "y1")])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
