"""License scans: MinHash bands over overlapping text windows, then exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dairyframe.llm.common import table
from dairyframe.llm.suffix_groups import sliding_min
from dairyframe.llm.words import ALPHANUMERIC, GOLD, mix, shingle_hashes, word_hashes

NAME = "op5_license_scan"
ORACLE = None
#: Words to a shingle.
SHINGLE = 3
#: Share of a template's distinct shingles that a window has to hold.
CONTAINMENT = 0.8
#: Lengths of windows, times the template's: words put into a notice stretch its passage.
STRETCHES = (1.0, 1.5, 2.0)
#: 128 bands of 2 rows. A window of twice the template's length that holds 0.8 of it has similarity 0.8 / 2.2 at least
#: and shares no band with probability 1.3e-8.
BANDS, ROWS = 128, 2
#: Shingles whose coordinates are held at a time.
_BLOCK = 4096
#: Short public license notices.
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "BSD": "Released under the BSD License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met",
    "All-rights": "All rights reserved. No part of this publication may be reproduced without permission",
}
#: Other common wordings of the notices above, each a template of its own. Those of 3 or 4 shingles have to occur word for word.
WORDINGS = {
    "Apache-2.0": (
        "under the Apache License, Version 2.0",
        "under the Apache License 2.0",
        "under the terms of the Apache License 2.0",
        "under Apache License 2.0",
        "under the Apache 2.0 License",
        "Apache License Version 2.0, January 2004",
    ),
    "MIT": ("under the MIT License", "under an MIT License", "under MIT License", "under the terms of the MIT License"),
    "BSD": (
        "under the BSD License",
        "under a BSD License",
        "under the terms of the BSD License",
        "under a BSD-style License",
        "under the BSD 2-Clause License",
        "under the BSD 3-Clause License",
        "under the 2-Clause BSD License",
        "under the 3-Clause BSD License",
    ),
    "CC-BY-NC-4.0": ("under CC BY-NC 4.0", "under the CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 International"),
    "CC-BY-SA-4.0": ("under CC BY-SA 4.0", "under the CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "CC-BY-4.0": ("under CC BY 4.0", "under the CC BY 4.0 license", "Creative Commons Attribution 4.0 International"),
    "MPL-2.0": ("under the Mozilla Public License 2.0", "under the terms of the Mozilla Public License, version 2.0"),
}
_SEEDS = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


@dataclass
class Templates:
    """Per wording name, shingle set, length and the places of shingles that occur once; all shingles; per window length
    its wordings, sorted band keys and the wording of each key."""

    names: list[str]
    sets: list[np.ndarray]
    lengths: list[int]
    places: list[dict[int, int]]
    known: np.ndarray
    windows: dict[int, tuple[list[int], np.ndarray, np.ndarray]]


def coordinate_values(h: np.ndarray) -> np.ndarray:
    return mix(h[:, None] * _SEEDS)


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One key per band of each row of MinHash coordinates."""
    key = coordinates[:, ::ROWS]
    for r in range(1, ROWS):
        key = mix(key * GOLD + coordinates[:, r::ROWS])
    return key


def index_templates(templates: Mapping[str, str | Sequence[str]]) -> Templates:
    """Each wording of a template is indexed under the lengths of the windows that are looked up for it."""
    names, sets, lengths, places, by_width = [], [], [], [], {}
    for name in sorted(templates):
        wordings = [templates[name]] if isinstance(templates[name], str) else templates[name]
        for text in wordings:
            found = shingle_hashes(word_hashes(np.frombuffer(text.encode(), np.uint8), ALPHANUMERIC)[0], SHINGLE)
            if not len(found):
                continue
            for width in {int(np.ceil(len(found) * s)) for s in STRETCHES}:
                by_width.setdefault(width, []).append(len(names))
            names.append(name)
            sets.append(np.unique(found))
            lengths.append(len(found))
            values = found.tolist()
            places.append({v: i for i, v in enumerate(values) if values.count(v) == 1})
    windows = {}
    for width, members in by_width.items():
        keys = np.concatenate([band_keys(coordinate_values(sets[i]).min(axis=0, keepdims=True))[0] for i in members])
        order = np.argsort(keys, kind="stable")
        windows[width] = (members, keys[order], np.repeat(members, BANDS)[order])
    return Templates(names, sets, lengths, places, np.unique(np.concatenate([np.zeros(0, np.uint64), *sets])), windows)


def band_mates(h: np.ndarray, at: np.ndarray, width: int, keys: np.ndarray, members: np.ndarray) -> set[tuple[int, int]]:
    """(first shingle, template) of the windows starting ``at`` (ascending) that share a band key with a template."""
    pairs: set[tuple[int, int]] = set()
    # runs of windows that touch are worked out together
    cuts = [0, *(np.flatnonzero(np.diff(at) > width) + 1), len(at)]
    for a, b in zip(cuts, cuts[1:]):
        while a < b:
            end = min(b, int(np.searchsorted(at, at[a] + _BLOCK)))
            lo = at[a]
            mins = sliding_min(coordinate_values(h[lo : at[end - 1] + width]), width)
            own = band_keys(mins[at[a:end] - lo]).ravel()
            left, right = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            for i in np.flatnonzero(right > left):
                start = int(at[a + i // BANDS])
                pairs.update((start, int(m)) for m in members[left[i] : right[i]])
            a = end
    return pairs


def tightest(at: np.ndarray, values: list[int]) -> tuple[int, int]:
    """First and last entry of the shortest run of the places ``at`` that holds every value, the first of equals."""
    missing, held, best, a = len(set(values)), {}, (0, len(at) - 1), 0
    for b, v in enumerate(values):
        held[v] = held.get(v, 0) + 1
        missing -= held[v] == 1
        while held[values[a]] > 1:
            held[values[a]] -= 1
            a += 1
        if not missing and at[b] - at[a] < at[best[1]] - at[best[0]]:
            best = a, b
    return best


def find_licenses(data: bytes, index: Templates, containment: float = CONTAINMENT) -> list[tuple[str, int, int, float]]:
    """(template, first byte, end byte, share of the template's shingles) of each match in one text.

    Windows of 1, 1.5 and 2 times a template's length are looked up in the bands, one from each shingle that any
    template has: a window that holds a passage can be moved to the passage's first such shingle. A window that holds at
    least ``containment`` of the template's shingles is a match; its span is cut to the shortest run of words with
    these shingles. Of matches that overlap the one that keeps more to the template's order is returned (the end of one
    notice and the start of the next are no notice), then the higher share, the longer template, the shorter span, the first.
    """
    words, starts, ends = word_hashes(np.frombuffer(data, np.uint8), ALPHANUMERIC)
    h = shingle_hashes(words, SHINGLE)
    if not len(h) or not len(index.known):
        return []
    hits = np.flatnonzero(index.known[np.minimum(np.searchsorted(index.known, h), len(index.known) - 1)] == h)
    if not len(hits):
        return []
    own = {m: hits[np.isin(h[hits], s)] for m, s in enumerate(index.sets)}
    enough = {m: int(np.ceil(containment * len(s) - 1e-9)) for m, s in enumerate(index.sets)}
    spans: set[tuple[int, int, int]] = set()
    for width, (members, keys, owners) in index.windows.items():
        # texts shorter than a window are one window
        width = min(width, len(h))
        able = [m for m in members if len(own[m]) >= enough[m]]
        if not able:
            continue
        at = np.unique(np.minimum(np.concatenate([own[m] for m in able]), len(h) - width))
        # a window can match only where it holds enough shingles of one template
        dense = np.zeros(len(at), bool)
        for m in able:
            dense |= np.searchsorted(own[m], at + width) - np.searchsorted(own[m], at) >= max(enough[m], 1)
        at = at[dense]
        if len(at):
            for start, m in band_mates(h, at, width, keys, owners):
                a, b = np.searchsorted(own[m], (start, start + width))
                if b > a:
                    spans.add((m, int(a), int(b)))
    spots: set[tuple[int, float, int, int, int, int]] = set()
    for m, a, b in spans:
        at, seen = own[m][a:b], set()
        values = h[at].tolist()
        # the passage may end before the window does, where the next one begins
        for k, v in enumerate(values):
            if v in seen:
                continue
            seen.add(v)
            share = len(seen) / len(index.sets[m])
            if share >= containment:
                first, last = tightest(at[: k + 1], values[: k + 1])
                order = [index.places[m][x] for x in values[first : last + 1] if x in index.places[m]]
                turns = sum(y < x for x, y in zip(order, order[1:]))
                spots.add((turns, -share, -index.lengths[m], int(at[last] - at[first]), int(at[first]), m))
    found: list[tuple[str, int, int, float]] = []
    taken: list[tuple[int, int]] = []
    for _, share, _, more, start, m in sorted(spots):
        last = start + more + SHINGLE - 1
        if all(last < a or b < start for a, b in taken):
            taken.append((start, last))
            found.append((index.names[m], int(starts[start]), int(ends[last]), -share))
    return sorted(found, key=lambda f: (f[1], f[0]))


def every_wording() -> dict[str, tuple[str, ...]]:
    return {name: (text, *WORDINGS.get(name, ())) for name, text in TEMPLATES.items()}


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str | Sequence[str]] | None = None,
    *,
    containment: float = CONTAINMENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per match: doc_id, license, start and end byte in the UTF-8 text, containment.

    Words are runs of ASCII letters and digits without regard to case, so punctuation and line breaks don't matter. A
    template of fewer than SHINGLE words can't be found, and a passage can be twice as long as its template at most.
    The templates map a license to one or several wordings. Null, empty and too short texts have no match; no rows give none.
    Repeated rows are scanned each. Whole texts are scanned, in memory of a few times one text. The templates are a
    parameter, small, and travel with the tasks; other columns are ignored. There is no shuffle.
    """
    index = index_templates(every_wording() if templates is None else templates)
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("data"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("doc_id").to_pylist(), []
            for doc, data in zip(ids, batch.column("data")):
                found += [(doc, *match) for match in find_licenses(data.as_py(), index, containment)]
            columns = list(zip(*found)) if found else [[], [], [], [], []]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "start", "end", "containment"])

    return rows.mapInArrow(scan, "doc_id long, license string, start long, end long, containment double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
