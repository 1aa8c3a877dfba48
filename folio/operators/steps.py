"""The page rules as steps over ``Pages``; the operators of the same names say what they do."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .pages import Pages, Step, begins, codes, since, taken

STRIPS = 200
ENDINGS = ("-", "‐", "‑", "‒", "–", "—", "―")


def _sorted(p: Pages, *keys) -> np.ndarray:
    """The order by page, then by the keys; equal rows stay in order."""
    return np.lexsort((*reversed(keys), p.of))


def _ranks(texts: pa.Array) -> np.ndarray:
    """Whole numbers in order of the texts' bytes."""
    held = texts.dictionary_encode()
    names = [(v or "").encode() for v in held.dictionary.to_pylist()]
    rank = np.empty(len(names) + 1, np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    rank[-1] = -1
    return rank[pc.fill_null(held.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)]


def joined(texts: pa.Array, starts: np.ndarray, between: str) -> pa.Array:
    """The texts from each start to the next as one."""
    offsets = pa.array(np.append(starts, len(texts)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, texts), between).cast(texts.type)


def _least(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, starts) if len(starts) else values[:0]


def _most(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(values, starts) if len(starts) else values[:0]


def dedupe_letters(p: Pages) -> Pages:
    place = codes(p.of, p["left"], p["bottom"], p["top"], _ranks(p["text"]))
    order = codes(p.of, p["row"], p["k"], p["i"])
    at = np.argsort(order, kind="stable")
    _, first = np.unique(place[at], return_index=True)
    return p.take(np.sort(at[first]))


def edge_table(side: str, least: int = 4) -> Step:
    def step(p: Pages) -> Pages:
        x = (p["left"] + p["right"]) / 2 if side == "mid" else p[side]
        edge = np.floor(10 * x).astype(np.int64)
        _, first, n = np.unique(codes(p.of, edge), return_index=True, return_counts=True)
        at = first[n >= least]
        return p.of_columns(p.of[at], edge=edge[at], n=n[n >= least].astype(np.int64))

    return step


def edge_flags(p: Pages) -> Pages:
    def often(x: np.ndarray) -> np.ndarray:
        _, which, n = np.unique(codes(p.of, np.floor(10 * x).astype(np.int64)), return_inverse=True, return_counts=True)
        return n[which] >= 4

    mid = often((p["left"] + p["right"]) / 2)
    return Pages(p.keys, p.of, p.columns | {"left_edge": often(p["left"]) | mid, "right_edge": often(p["right"]) | mid})


def _baselines(p: Pages, apart: float) -> np.ndarray:
    """The line of each row: bottoms that differ by less than ``apart`` of the size, from one to the next, share one."""
    at = _sorted(p, p["bottom"])
    of, bottom, size = p.of[at], p["bottom"][at], p["size"][at]
    new = begins(of)
    new[1:] |= ~(bottom[1:] - bottom[:-1] < apart * size[1:])
    level = begins(of, bottom)
    last = np.append(np.flatnonzero(level)[1:], len(level)) - 1
    line = np.empty(len(p), np.int64)
    line[at] = np.cumsum(new)[last[np.cumsum(level) - 1]] if len(p) else 0
    return line


def _merged(p: Pages, at: np.ndarray, new: np.ndarray, between: str) -> Pages:
    """Runs of the rows in the order ``at``, each begun by ``new``, as one: left of the first, right of the last, lowest
    bottom, largest size above it; texts in order of left, and the font, if there is one, and size of the rightmost letter or
    of the leftmost word."""
    word, left = np.cumsum(new), p["left"][at]
    if (~new[1:] & (left[1:] == left[:-1])).any():  # at one place in order of text
        at = at[np.lexsort((_ranks(p["text"].take(pa.array(at))), left, word))]
    q, starts = p.take(at), np.flatnonzero(new)
    one = np.append(starts[1:], len(at)) - 1 if between == "" else starts
    if not len(starts):
        one = starts
    bottom, size = _least(q["bottom"], starts), q["size"][one]
    top = bottom + (size if between == "" else _most(q["size"], starts))
    font = {"font": taken(q["font"], one)} if "font" in p.columns else {}
    return q.of_columns(q.of[starts], text=joined(q["text"], starts, between), left=q["left"][starts], right=_most(q["right"], starts), bottom=bottom, top=top, size=size, **font)


def words_from_letters(p: Pages) -> Pages:
    line = _baselines(p, 0.1)
    at = np.lexsort((p["i"], p["left"], line))
    left, right, size = p["left"][at], p["right"][at], p["size"][at]
    new = begins(line[at])
    new[1:] |= ~(left[1:] - right[:-1] < 0.01 * size[1:])
    return _merged(p, at, new, "")


def lines_from_words(p: Pages) -> Pages:
    line = _baselines(p, 0.7)
    at = np.lexsort((*([p["k"], p["row"]] if "row" in p.columns else []), p["left"], line))
    left, right, size, start, stop = (p[c][at] for c in ("left", "right", "size", "left_edge", "right_edge"))
    gap = left[1:] - right[:-1]
    new = begins(line[at])
    new[1:] |= ~((gap > 0) & (gap <= 0.5 * size[:-1]) & ~start[1:] & ~stop[:-1])
    return _merged(p, at, new, " ")


def rows_of_bottoms(p: Pages) -> Pages:
    """Words of one bottom as one row, whatever lies between them."""
    at = _sorted(p, p["bottom"], p["left"], _ranks(p["text"]))
    q = p.take(at)
    starts = np.flatnonzero(begins(q.of, q["bottom"]))
    right, top, size = (_most(q[c], starts) for c in ("right", "top", "size"))
    return q.of_columns(q.of[starts], text=joined(q["text"], starts, " "), left=q["left"][starts], right=right, bottom=q["bottom"][starts], top=top, size=size)


def in_reading_order(p: Pages) -> Pages:
    return p.take(_sorted(p, -p["bottom"], p["left"]))


def reading_order(p: Pages) -> Pages:
    at = _sorted(p, -p["bottom"], p["left"], p["row"], p["k"])
    place = np.empty(len(p), np.int64)
    place[at] = np.arange(len(p)) - since(begins(p.of[at])) + 1
    return Pages(p.keys, p.of, p.columns | {"place": place})


def upper_medians(p: Pages, values: np.ndarray) -> np.ndarray:
    """For each page the value at place n / 2 of its sorted values."""
    at = _sorted(p, values)
    starts, counts = np.unique(p.of, return_index=True, return_counts=True)[1:]
    return values[at][starts + counts // 2]


def upper_median_size(p: Pages) -> Pages:
    return p.of_columns(np.arange(p.count), median=upper_medians(p, p["right"] - p["left"]))


def page_bounds(width: int, height: int) -> Step:
    def step(p: Pages) -> Pages:
        starts = np.flatnonzero(begins(p.of))
        low = {c: np.where(_least(p[c], starts) < 0, -10, 0).astype(np.int32) for c in ("left", "bottom")}
        high = {c: np.where(_most(p[c], starts) > most, most + 10, most).astype(np.int32) for c, most in (("right", width), ("top", height))}
        return p.of_columns(p.of[starts], **low, **high)

    return step


def strip_gaps(width: float, height: float) -> Step:
    w = width / STRIPS

    def step(p: Pages) -> Pages:
        at = _sorted(p, -p["bottom"], -p["top"])
        at = at[(p["right"][at] > 0) & (p["left"][at] < width)]
        low = np.maximum(np.floor(p["left"][at] / w), 0).astype(np.int64)
        high = np.minimum(np.ceil(p["right"][at] / w) - 1, STRIPS - 1).astype(np.int64)
        n = np.maximum(high - low + 1, 0)
        word = np.repeat(at, n)
        strip = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        cell = p.of[word] * STRIPS + strip
        least = int(cell.min()) if len(cell) else 0
        small = (cell - least).astype(np.uint16) if len(cell) and int(cell.max()) - least < 1 << 16 else cell
        by = np.argsort(small, kind="stable")
        cell, word = cell[by], word[by]
        new = begins(cell)
        last = np.append(new[1:], True)[: len(new)]
        bottom = p["bottom"][word]
        above = np.empty_like(bottom)
        above[1:] = bottom[:-1]
        above[new] = height
        place = np.concatenate([np.arange(len(cell)), np.flatnonzero(last)])
        high_, low_ = np.concatenate([above, bottom[last]]), np.concatenate([p["top"][word], np.zeros(int(last.sum()), bottom.dtype)])
        keep = high_ > low_
        place, high_, low_ = place[keep], high_[keep], low_[keep]
        order = np.argsort(place, kind="stable")
        place = place[order]
        return p.of_columns(cell[place] // STRIPS, strip=cell[place] % STRIPS, top=high_[order], bottom=low_[order])

    return step


def strip_islands(p: Pages) -> Pages:
    code = codes(p.of, p["top"], p["bottom"])
    at = np.lexsort((p["strip"], code))
    strip = p["strip"][at]
    new = begins(code[at])
    new[1:] |= strip[1:] != strip[:-1] + 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(at))[: len(starts)] - 1
    back = np.argsort(p.of[at][starts], kind="stable")
    starts, ends = starts[back], ends[back]
    return p.of_columns(p.of[at][starts], top=p["top"][at][starts], bottom=p["bottom"][at][starts], first_strip=strip[starts], last_strip=strip[ends])


def white_boxes(width: float, height: float, least: float = 0.3) -> Step:
    def step(p: Pages) -> Pages:
        gaps = strip_gaps(width, height)(p)
        kind = p["bottom"].dtype
        used = np.zeros(p.count * STRIPS, bool)
        inside = (p["right"] > 0) & (p["left"] < width)
        low = np.maximum(np.floor(p["left"][inside] / (width / STRIPS)), 0).astype(np.int64)
        high = np.minimum(np.ceil(p["right"][inside] / (width / STRIPS)) - 1, STRIPS - 1).astype(np.int64)
        n = np.maximum(high - low + 1, 0)
        used[np.repeat(p.of[inside] * STRIPS + low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = True
        empty = np.flatnonzero(~used)
        cell = np.concatenate([gaps.of * STRIPS + gaps["strip"], empty])
        by = np.argsort(cell, kind="stable")
        top, bottom = (np.concatenate([gaps[c], np.full(len(empty), v, kind)])[by] for c, v in (("top", height), ("bottom", 0)))
        runs = strip_islands(p.of_columns(cell[by] // STRIPS, strip=cell[by] % STRIPS, top=top, bottom=bottom))
        left, right = runs["first_strip"], runs["last_strip"] + 1
        edge = (left == 0) | (right == STRIPS) | (runs["top"] == height) | (runs["bottom"] == 0)
        at = np.flatnonzero(edge | (runs["top"] - runs["bottom"] >= least * upper_medians(p, p["size"])[runs.of]))
        return p.of_columns(runs.of[at], left=left[at], right=right[at], top=runs["top"][at], bottom=runs["bottom"][at])

    return step


def _spans(p: Pages) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of each page begin and end."""
    pages = np.arange(p.count)
    return np.searchsorted(p.of, pages, "left"), np.searchsorted(p.of, pages, "right")


def vertices(p: Pages) -> Pages:
    x = np.concatenate([p["left"], p["left"], p["right"], p["right"]])
    y = np.concatenate([p["top"], p["bottom"], p["top"], p["bottom"]])
    of = np.tile(p.of, 4)
    _, first = np.unique(codes(of, x, y), return_index=True)
    of, x, y = of[first], x[first], y[first]
    flags = np.zeros(len(x), np.int32)
    (low, high), (start, stop) = _spans(p), _spans(p.of_columns(of))
    left, right, top, bottom = p["left"], p["right"], p["top"], p["bottom"]
    for a, b, c, d in zip(low.tolist(), high.tolist(), start.tolist(), stop.tolist(), strict=True):
        wide = max(1, 500_000 // max(1, b - a))
        for s in range(c, d, wide):
            px, py = x[s : min(s + wide, d), None], y[s : min(s + wide, d), None]
            west, east, above, below = px > left[a:b], px < right[a:b], py < top[a:b], py > bottom[a:b]
            across, up = (px >= left[a:b]) & (px <= right[a:b]), (py <= top[a:b]) & (py >= bottom[a:b])
            west &= up
            east &= up
            above &= across
            below &= across
            flags[s : min(s + wide, d)] = 8 * (west & above).any(1) + 4 * (east & above).any(1) + 2 * (east & below).any(1) + (west & below).any(1)
    return p.of_columns(of, x=x, y=y, flags=flags)


#: Directions in and out of a corner by the quarters around it that are white: 8 north-west, 4 north-east, 2 south-east,
#: 1 south-west (fixed values). Outlines run clockwise around text.
ARROWS = {1: "NW", 2: "WS", 4: "SE", 7: "SW", 8: "EN", 11: "WN", 13: "NE", 14: "ES"}
#: Corners whose white quarters only touch are two corners.
TOUCHING = {5: (4, 1), 10: (8, 2)}


def corners(p: Pages) -> Pages:
    at = np.flatnonzero(p["flags"] % 3 != 0)
    flags = p["flags"][at]
    twice = np.isin(flags, list(TOUCHING))
    at = np.repeat(at, 1 + twice)
    second = ~begins(at)
    flags = p["flags"][at].copy()
    for both, (one, other) in TOUCHING.items():
        flags = np.where((p["flags"][at] == both), np.where(second, other, one), flags)
    ways = pa.array([ARROWS.get(k) for k in range(16)], pa.string()).take(pa.array(flags))
    ins, outs = (pc.utf8_slice_codeunits(ways, k, k + 1) for k in (0, 1))
    return p.of_columns(p.of[at], x=p["x"][at], y=p["y"][at], flags=flags.astype(np.int32), ins=ins, outs=outs)


def _ways(p: Pages) -> tuple[np.ndarray, np.ndarray]:
    letter = np.zeros((2, 16), np.uint8)
    for k, way in ARROWS.items():
        letter[:, k] = [ord(way[0]), ord(way[1])]
    return letter[0][p["flags"]], letter[1][p["flags"]]


def next_rows(p: Pages) -> np.ndarray:
    """For each corner the row of the nearest one that its way out leads into, or -1."""
    ins, outs = _ways(p)
    to = np.full(len(p), -1, np.int64)
    for way, along, across in (("N", "x", "y"), ("S", "x", "y"), ("E", "y", "x"), ("W", "y", "x")):
        asks, there = np.flatnonzero(outs == ord(way)), np.flatnonzero(ins == ord(way))
        if not len(asks) or not len(there):
            continue
        line, held = np.unique(codes(p.of, p[along]), return_inverse=True)[1], np.unique(p[across])
        n = len(held) + 1
        code = line[there] * n + np.searchsorted(held, p[across][there])
        by = np.argsort(code, kind="stable")
        there, code = there[by], code[by]
        if way in "NE":
            at = np.searchsorted(code, line[asks] * n + np.searchsorted(held, p[across][asks] + 1, "left"), "left")
        else:
            at = np.searchsorted(code, line[asks] * n + np.searchsorted(held, p[across][asks] - 1, "right") - 1, "right") - 1
        found = (at >= 0) & (at < len(there))
        at = np.clip(at, 0, len(there) - 1)
        found &= line[there[at]] == line[asks]
        to[asks[found]] = there[at[found]]
    return to


def next_corners(p: Pages) -> Pages:
    to = next_rows(p)
    at = pa.array(to, mask=to < 0)
    return Pages(p.keys, p.of, p.columns | {f"next_{c}": pa.array(p[c]).take(at) for c in ("x", "y", "flags")})


def outlines(p: Pages, to: np.ndarray) -> np.ndarray:
    """For each corner, in the order of the page, the number of the first of the corners that lead to one another."""
    n = len(p)
    ahead, least = np.where(to < 0, np.arange(n), to), np.arange(n)
    steps, longest = 1, int(np.bincount(p.of).max()) if n else 0
    while steps < 2 * longest:
        least = np.minimum(least, least[ahead])
        ahead = ahead[ahead]
        steps *= 2
    ring = least[ahead]  # the least of the ring, or the end, that it leads into
    first = np.full(n, n, np.int64)
    np.minimum.at(first, ring, np.arange(n))
    return first[ring]


def polygons(p: Pages) -> Pages:
    """Adds ``polygon`` from next_x, next_y and next_flags."""
    p = p.take(_sorted(p, p["x"], -p["y"], p["flags"]))
    there = ~np.asarray(pa.array(p["next_x"]).is_null())
    x, y, flags = (np.asarray(pc.fill_null(pa.array(p[f"next_{c}"]), 0)) for c in ("x", "y", "flags"))
    code = codes(*[np.concatenate(c) for c in ((p.of, p.of), (p["x"], x), (p["y"], y), (p["flags"], flags))])
    at = np.argsort(code[: len(p)], kind="stable")
    place = np.clip(np.searchsorted(code[: len(p)][at], code[len(p) :]), 0, max(0, len(p) - 1))
    to = np.where(there & (code[: len(p)][at][place] == code[len(p) :]), at[place], -1) if len(p) else np.empty(0, np.int64)
    return Pages(p.keys, p.of, p.columns | {"polygon": (outlines(p, to) - _spans(p)[0][p.of]).astype(np.int32)})


def polygon_boxes(p: Pages) -> Pages:
    at = np.argsort(codes(p.of, p["polygon"]), kind="stable")
    starts = np.flatnonzero(begins(p.of[at], p["polygon"][at]))
    x, y = p["x"][at], p["y"][at]
    return p.of_columns(p.of[at][starts], polygon=p["polygon"][at][starts], left=_least(x, starts), right=_most(x, starts), top=_most(y, starts), bottom=_least(y, starts))


def engulfed(slack: float = 0.1) -> Step:
    def step(p: Pages) -> Pages:
        at = _sorted(p, p["left"], -p["top"], p["right"], p["bottom"])
        left, right, top, bottom = (p[c][at] for c in ("left", "right", "top", "bottom"))
        held = np.zeros(len(p), bool)
        for a, b in zip(*(s.tolist() for s in _spans(p)), strict=True):
            wide = max(1, 500_000 // max(1, b - a))
            for s in range(a, b, wide):
                e = min(s + wide, b)
                over = (left[a:b] <= left[s:e, None] + slack) & (right[a:b] >= right[s:e, None] - slack) & (top[a:b] >= top[s:e, None] - slack) & (bottom[a:b] <= bottom[s:e, None] + slack)
                held[s:e] = (over & (np.arange(a, b) < np.arange(s, e)[:, None])).any(1)
        return p.take(at[~held])

    return step


def text_boxes(width: float, height: float) -> Step:
    def step(p: Pages) -> Pages:
        found = p
        for s in (white_boxes(width, height), vertices, corners, next_corners, polygons, polygon_boxes):
            found = s(found)
        page = (found["left"] == 0) & (found["right"] == STRIPS) & (np.abs(found["top"] - height) < 0.1) & (np.abs(found["bottom"]) < 0.1)
        q = engulfed()(found.take(np.flatnonzero(~page)))
        of, w = q.of, width / STRIPS
        return p.of_columns(of, xmin=q["left"] * w, ymin=q["bottom"].astype(float), xmax=q["right"] * w, ymax=q["top"].astype(float), box=np.arange(len(of)) - np.searchsorted(of, of, "left"))

    return step


def assigned(p: Pages, boxes: Pages, slack: float = 0.1) -> Pages:
    """The rows with the sides and number of each box of the page that holds them, as ``blocks.contains`` has it."""
    low, high = _spans(boxes)
    n = (high - low)[p.of]
    at = np.repeat(np.arange(len(p)), n)
    box = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[p.of], n)
    left, right, top, bottom = (p[c][at] for c in ("left", "right", "top", "bottom"))
    xmin, xmax, ymin, ymax = (boxes[c][box] for c in ("xmin", "xmax", "ymin", "ymax"))
    held = (left > xmin - slack) & (right < xmax + slack) & (top < ymax + slack) & (bottom > ymin - slack)
    held &= ~((left == xmin) & (right == xmax) & (top == ymax) & (bottom == ymin))
    box = box[held]
    return p.take(at[held], **{c: boxes[c][box] for c in boxes.columns})


def line_endings(texts: pa.Array) -> pa.Array:
    last = pc.utf8_slice_codeunits(texts, -1)
    hyphen, space = pc.is_in(last, pa.array(ENDINGS, texts.type)), pc.is_in(last, pa.array([" ", " "], texts.type))
    spaced = pc.binary_join_element_wise(texts, pa.scalar(" ", texts.type), pa.scalar("", texts.type))
    return pc.if_else(hyphen, pc.utf8_slice_codeunits(texts, 0, -1), pc.if_else(space, texts, spaced))


def text_blocks(p: Pages) -> Pages:
    """From elements with the boxes that hold them."""
    at = _sorted(p, p["box"], -p["bottom"], p["left"], _ranks(p["text"]))
    q = p.take(at)
    box = begins(q.of, q["box"])
    lower, indented, under = q["bottom"][1:] < q["bottom"][:-1], q["left"][1:] - q["left"][:-1] > 0.1, q["top"][1:] < q["bottom"][:-1]
    new = box.copy()
    new[1:] |= lower & indented & under
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(q))[: len(starts)] - 1
    part = (np.cumsum(new) - np.cumsum(new)[since(box)]) if len(q) else np.empty(0, np.int64)
    last = np.append(box[1:], True)[: len(box)][ends]  # no part of the box follows
    whole = np.zeros(len(q), bool)
    whole[ends] = True
    text = joined(pc.if_else(pa.array(whole), q["text"], line_endings(q["text"])), starts, "")
    bottom, top = np.where(last, q["ymin"][ends], q["bottom"][ends]).astype(float), np.where(part[starts] == 0, q["ymax"][starts], q["top"][starts]).astype(float)
    return q.of_columns(q.of[starts], box=q["box"][starts], part=part[starts], text=text, left=q["xmin"][starts], right=q["xmax"][starts], bottom=bottom, top=top, size=q["size"][starts])


def indent_breaks(p: Pages) -> Pages:
    q = in_reading_order(p)
    breaks = ~begins(q.of)
    breaks[1:] &= (q["bottom"][1:] < q["bottom"][:-1]) & (q["left"][1:] - q["left"][:-1] > 0.1)
    return Pages(q.keys, q.of, q.columns | {"breaks": breaks})


def paste_lines(p: Pages) -> Pages:
    text = line_endings(p["text"])
    at = _sorted(p, -p["bottom"], p["left"])
    tied = begins(p.of[at], p["bottom"][at], p["left"][at])
    if not tied.all():
        at = _sorted(p, -p["bottom"], p["left"], _ranks(text))
    starts = np.flatnonzero(begins(p.of[at]))
    return p.of_columns(p.of[at][starts], text=pc.utf8_rtrim(joined(text.take(pa.array(at)), starts, ""), " "))


def greedy_lines(p: Pages) -> Pages:
    """Words whose bottoms cannot meet are apart. Where words of one bottom and size neither overlap nor reach past the next
    one, each can only take the next; all others are taken word by word."""
    line = _levels(p)
    order = np.lexsort((-p["bottom"], p["left"], line))
    same = begins(line[order], p["left"][order], p["bottom"][order])
    if not same.all():
        order = np.lexsort((_ranks(p["text"]), -p["bottom"], p["left"], line))
    q, new = p.take(order), begins(line[order])
    n, starts = len(q), np.flatnonzero(new)
    left, right, bottom, size = (q[c].astype(float) for c in ("left", "right", "bottom", "size"))
    top, start, stop = q["top"].astype(float), q["left_edge"], q["right_edge"]
    odd = np.zeros(n, bool)
    if n:
        odd[1:] |= ~new[1:] & ((left[1:] <= right[:-1]) | (bottom[1:] != bottom[:-1]) | (size[1:] != size[:-1]))
        odd |= size <= 0
        odd[2:] |= ~new[2:] & ~new[1:-1] & (left[2:] <= right[:-2] + 0.5 * size[:-2])
        odd = np.logical_or.reduceat(odd, starts)[np.cumsum(new) - 1]
    head = np.arange(n)
    joins = np.zeros(n, bool)
    joins[1:] = ~new[1:] & ~odd[1:] & (left[1:] <= right[:-1] + 0.5 * size[:-1]) & ~(stop[:-1] | start[1:])
    head = since(~joins) if n else head
    into = np.arange(n)  # places in the order that the words of a line are read in
    stops = np.append(starts[1:], n)
    for a, b in zip(starts[odd[starts]].tolist(), stops[odd[starts]].tolist() if n else [], strict=True):
        if b - a > 1:
            _taken_in_turn(a, b, left, right, bottom, size, top, start, stop, head, into)
    by = np.lexsort((into, head))
    first = begins(head[by])
    at = np.flatnonzero(first)
    ends = np.append(at[1:], n)[: len(at)] - 1
    heads = head[by][at]
    plain = ~odd[heads]
    right, top = np.where(plain, right[by][ends], right[heads]), np.where(plain & (ends > at), size[heads] + bottom[heads], top[heads])
    font = {"font": taken(q["font"], heads)} if "font" in q.columns else {}
    out = q.of_columns(q.of[heads], text=joined(q["text"].take(pa.array(by)), at, " "), left=left[heads], right=right, bottom=bottom[heads], top=top, **font, size=size[heads])
    return out.take(np.argsort(out.of, kind="stable"))


def _levels(p: Pages) -> np.ndarray:
    """Numbers of runs of bottoms of a page that are less than 0.7 of its largest size apart, from one to the next."""
    at = _sorted(p, p["bottom"])
    of, bottom = p.of[at], p["bottom"][at]
    most = np.full(p.count, -np.inf)
    np.maximum.at(most, p.of, p["size"])
    new = begins(of)
    new[1:] |= bottom[1:] - bottom[:-1] >= 0.7 * most[of[1:]]
    line = np.empty(len(p), np.int64)
    line[at] = np.cumsum(new)
    return line


def _taken_in_turn(a: int, b: int, left, right, bottom, size, top, start, stop, head, into) -> None:
    """The exact rule over the words from ``a`` to ``b``: sets head, right and top, and the places in ``into``."""
    x, r, y, s, t, begin, end = (c[a:b].tolist() for c in (left, right, bottom, size, top, start, stop))
    gone, place = [False] * (b - a), 0
    for i in range(b - a):
        if gone[i]:
            continue
        head[a + i], into[a + i], place, at = a + i, a + place, place + 1, i + 1
        while at < b - a:
            gap = x[at] - r[i]
            if x[at] > r[i] + 0.5 * s[i]:
                break
            if not gone[at] and x[at] > r[i] and abs(y[at] - y[i]) < 0.7 * s[at] and not ((end[i] or begin[at]) and gap > 0):
                r[i], end[i], gone[at] = r[at], end[i] or end[at], True
                t[i] = max(s[i], s[at]) + y[i]
                head[a + at], into[a + at], place = a + i, a + place, place + 1
                at = i
            at += 1
    right[a:b], top[a:b] = r, t


def adjacent_letters(p: Pages) -> Pages:
    """Letters are met by their level, a bottom of the page, and on it from left to right: the first one right of a letter's
    left is the nearest."""
    seq, left, right, bottom, size = (p[c] for c in ("seq", "left", "right", "bottom", "size"))
    at = _sorted(p, bottom)
    new = begins(p.of[at], bottom[at])
    level = np.empty(len(p), np.int64)
    level[at] = np.cumsum(new) - 1
    of_level, height = p.of[at][new], bottom[at][new]
    places, rank = np.unique(left, return_inverse=True)
    n = len(places)
    code = level * n + rank
    by = np.lexsort((seq, code))
    code = code[by]
    nearest, found = np.full(len(p), -1, np.int64), np.zeros(len(p), bool)
    for way in (1, -1):
        shift, asks = 0 if way == 1 else -1, np.arange(len(p))
        while len(asks):
            other = level[asks] + shift
            there = (other >= 0) & (other < len(height))
            asks, other = asks[there], other[there]
            close = (of_level[other] == p.of[asks]) & (np.abs(height[other] - bottom[asks]) < 0.1 * size[asks])
            asks, other = asks[close], other[close]
            place = np.searchsorted(code, other * n + rank[asks], "right")
            ok = place < len(by)
            a, o = asks[ok], by[np.minimum(place, len(by) - 1)][ok]
            ok = (level[o] == other[ok]) & ((np.abs(left[o] - right[a]) < 0.01 * size[a]) | (left[o] < right[a]))
            a, o = a[ok], o[ok]
            better = ~found[a] | (left[o] < left[nearest[a]]) | ((left[o] == left[nearest[a]]) & (seq[o] < seq[nearest[a]]))
            nearest[a[better]], found[a] = o[better], True
            shift += way
    at = np.flatnonzero(found)
    return p.of_columns(p.of[at], seq=seq[at], next_seq=seq[nearest[at]])
