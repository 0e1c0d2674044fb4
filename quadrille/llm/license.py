"""Licence scans: a sparse word n-gram softmax regression names each paragraph's licence family, or the unknown class; a
comparison with the family's templates confirms it."""

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, mix, prefix_hash, span_hash, utf8

# Usual notices of each family, and the paragraphs of the short licence texts.
TEMPLATES = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL version 3 or later.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "Apache-2.0": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "This project is available under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons Attribution NonCommercial License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal.",
        "This work is dedicated to the public domain under CC0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "GPL": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GPL version 2 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Use of this source code is governed by an MIT-style license.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
# Notices of licences that have no family here; they belong to the unknown class.
OTHER_LICENCES = [
    "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL.",
    "This work is licensed under the European Union Public License.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 1.0.",
    "This Source Code may also be made available under the Secondary Licenses of the Eclipse Public License.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "You can obtain a copy of the license at http://www.opensource.org/licenses/cddl1.php",
    "This library is free software; you can redistribute it under the Artistic License, or the same terms as Perl itself.",
    "Released under the terms of the Artistic License.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Distributed under the Boost Software License, Version 1.0.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Python Software Foundation License version 2.",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Microsoft Public License.",
    "This database is made available under the Open Database License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "The code is licensed under the Server Side Public License, version 1.",
    "Use of this software is subject to the Business Source License.",
    "Licensed under the Common Public License.",
    "This file is part of a proprietary product; redistribution in any form is not permitted.",
    "Permission to copy this document is denied without prior written consent.",
    "SPDX-License-Identifier: EPL-1.0",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: OFL-1.1",
]
# Sentences of the unknown class.
OTHERS = [
    "The driver showed a license to the officer and went on.",
    "She was licensed to practise medicine in the state of her birth.",
    "The version of the story that we know was released in the spring.",
    "The terms of the agreement are under review by the general assembly.",
    "This work was done under the direction of the public office.",
    "You may not use the lift in case of fire.",
    "A copy of the letter was found in the file.",
    "The permission of the author is not needed to read this text.",
    "The software and the documentation are free of charge for any person.",
    "All rights reserved.",
    "Copyright 2020 the authors.",
    "Subject to the terms of the contract, the parties may modify the plan.",
    "The international attribution of the painting is not certain.",
    "Licensed under a license of our own.",
    "Released under the name of the company.",
    "This project is available to the public.",
]
FAMILIES = [*sorted(TEMPLATES), "unknown"]
UNKNOWN = len(FAMILIES) - 1
BITS = 18
GRAMS = (1, 2, 3)  # words
EXAMPLES, EPOCHS, SEED = 60, 150, 11
#: A family is named where it is likelier than every other and than none.  It is confirmed where its calibrated probability is
#: as high as this, and so large a share of one of its templates is there.
PROBABLE, CONFIRMED = 0.2, 0.85

#: Letters in lower case; digits count as one digit; bytes beyond ASCII stay; line feeds stay; all others part words.
_TABLE = bytes(c if c > 127 or c == 10 or chr(c).islower() else c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 for c in range(256))


def unit_grams(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: first and last text; of each unit its text, its paragraph (counted over the run) and its line in it;
    and hashes of all word n-grams with the unit that each is of.

    A paragraph is what stands between lines without words.  Its units are its lines and, if it has several, the whole of it
    (line -1), as a notice can be wrapped, or be one line among others.
    """
    for i, j in chunks(texts):
        data = np.frombuffer((b"\n".join(texts[i:j]) + b"\n").translate(_TABLE), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        feed = data == 10
        edge = np.flatnonzero(np.diff(~feed & (data != 32), prepend=False))
        start, end = edge[::2], edge[1::2]
        word = span_hash(prefix_hash(data), start, end)
        rows = np.cumsum(feed)[start] if len(start) else np.zeros(0, np.int64)
        text = np.searchsorted(ends, start, "right")
        fresh = lambda x: np.diff(x, prepend=-2)
        line = np.cumsum(fresh(rows) > 0) - 1
        paragraph = np.cumsum((fresh(rows) > 1) | (fresh(text) > 0)) - 1
        first = np.flatnonzero(fresh(line))  # word
        top = np.flatnonzero(fresh(paragraph[first]))  # line
        several = np.flatnonzero(np.diff(np.append(top, len(first))) > 1)
        whole = np.full(len(top), -1)
        whole[several] = len(first) + np.arange(len(several))
        units = [line, whole[paragraph]]
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for n in GRAMS:
            m = len(word) - n + 1
            if m > 0:
                value = np.zeros(m, np.uint64)
                for k in range(n):
                    value = mix(value + word[k : m + k] + np.uint64(n))
                for unit in units:
                    inside = (unit[:m] == unit[n - 1 :]) & (unit[:m] >= 0)
                    hashes.append(value[inside])
                    owners.append(unit[:m][inside])
        of_line, nth = paragraph[first], np.arange(len(first)) - top[paragraph[first]] if len(first) else first
        yield i, j, np.append(text[first], text[first[top[several]]]), np.append(of_line, several), np.append(nth, np.full(len(several), -1)), np.concatenate(hashes), np.concatenate(owners)


def _features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (line, bucket) pairs of lines that are one paragraph each."""
    found = [np.unique(h >> np.uint64(64 - BITS)).astype(np.int64) for x in lines for *_, h, _ in unit_grams(utf8([x]))]
    return np.repeat(np.arange(len(lines)), [len(f) for f in found]), np.concatenate(found)


def probabilities(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _fit(row: np.ndarray, column: np.ndarray, n_columns: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression on the distinct (row, column) pairs of y's rows."""
    weights, bias = np.zeros((n_columns, len(FAMILIES))), np.zeros(len(FAMILIES))
    moments, target = np.zeros_like(weights), np.eye(len(FAMILIES))[y]
    for _ in range(EPOCHS):
        error = (probabilities(_logits(row, column, weights, bias, len(y))) - target) / len(y)
        slope = np.stack([np.bincount(column, error[row, k], n_columns) for k in range(len(FAMILIES))], 1) + 1e-5 * weights
        moments += slope**2
        weights -= 0.3 * slope / (np.sqrt(moments) + 1e-8)
        bias -= 0.5 * error.sum(0)
    bias[UNKNOWN] += 1.0  # a paragraph without a known n-gram is unknown
    return weights, bias


def _logits(row: np.ndarray, column: np.ndarray, weights: np.ndarray, bias: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(row, weights[column, k], n) for k in range(len(FAMILIES))], 1) + bias


@functools.cache
def model() -> dict:
    """Fitted on variants of the templates and of the other sentences (words left out, others around them).  The temperature of
    the probabilities is set by a first fit that has not seen every third template and sentence, on the variants of those."""
    rng = np.random.default_rng(SEED)
    filler = [w for t in OTHERS for w in t.split()]
    lines, labels, unseen = [], [], []
    for label, texts in enumerate([*(TEMPLATES[f] for f in FAMILIES[:-1]), OTHER_LICENCES + OTHERS]):
        for k in range(EXAMPLES * (8 if label == UNKNOWN else 1)):
            words = texts[k % len(texts)].split()
            if label == UNKNOWN and k % 3 == 2 and k >= len(texts):
                words = list(rng.permutation(filler)[: rng.integers(1, 40)])
            words = [w for w in words if rng.random() > (0.06 if k >= len(texts) else 0)] or words
            around = [list(rng.choice(filler, rng.integers(0, 8))) for _ in range(2)] if rng.random() < 0.5 else [[], []]
            lines.append(" ".join([*around[0], *words, *around[1]]))
            labels.append(label)
            unseen.append(k % len(texts) % 3 == 2)
    y, unseen = np.array(labels), np.array(unseen)
    row, bucket = _features(lines)
    known, column = np.unique(bucket, return_inverse=True)
    place = np.cumsum(~unseen) - 1
    seen_pairs = ~unseen[row]
    first = _fit(place[row[seen_pairs]], column[seen_pairs], len(known), y[~unseen])
    z = _logits(row, column, *first, len(y))[unseen]
    loss = {t: -np.log(probabilities(z / t)[np.arange(len(z)), y[unseen]] + 1e-12).mean() for t in np.geomspace(0.25, 8, 26)}
    weights, bias = _fit(row, column, len(known), y)
    seen = np.full(1 << BITS, -1, np.int32)
    seen[known] = np.arange(len(known))
    sets = [np.unique(np.concatenate([h for *_, h, _ in unit_grams(utf8([t]))])) for f in FAMILIES[:-1] for t in TEMPLATES[f]]
    return {
        "seen": seen, "weights": weights.astype(np.float32), "bias": bias, "temperature": min(loss, key=loss.get),
        "template": np.concatenate(sets), "template_of": np.repeat(np.arange(len(sets)), [len(s) for s in sets]), "sizes": np.array([len(s) for s in sets]),
        "family_of": np.repeat(np.arange(UNKNOWN), [len(TEMPLATES[f]) for f in FAMILIES[:-1]]),
    }


def similarity(m: dict, grams: np.ndarray, family: int) -> float:
    """Largest share of the distinct n-grams of one of the family's templates that are among grams."""
    own = np.unique(grams)
    of = m["template_of"][np.isin(m["template"], own)]
    share = np.bincount(of, minlength=len(m["sizes"])) / m["sizes"]
    return float(share[m["family_of"] == family].max())


def find(texts) -> list[tuple[int, list[tuple[int, int, str, float, float, bool]]]]:
    """Of each text its number of paragraphs, and what is named: paragraph, line, family, probability, similarity, confirmed.  A
    whole paragraph is left out if one of its lines is confirmed."""
    m = model()
    raw = utf8(texts)
    out: list[list] = [[] for _ in raw]
    n_paragraphs = np.zeros(len(raw), np.int64)
    for i, j, text, paragraph, line, hashes, owner in unit_grams(raw):
        n_paragraphs[i:j] = np.bincount(text[line == 0], minlength=j - i)
        first = np.concatenate([[0], np.cumsum(n_paragraphs[i:j])])
        column = m["seen"][(hashes >> np.uint64(64 - BITS)).astype(np.int64)]
        hit = np.flatnonzero(column >= 0)
        pair = np.unique(owner[hit] * np.int64(len(m["weights"])) + column[hit])
        rows, columns = np.divmod(pair, len(m["weights"]))
        if not len(rows):
            continue
        some, at = np.unique(rows, return_index=True)
        z = (np.add.reduceat(m["weights"][columns], at) + m["bias"]) / m["temperature"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p[:, :UNKNOWN].argmax(1)
        sure = set()
        for k in np.flatnonzero(p[np.arange(len(best)), best] > p[:, UNKNOWN]).tolist():  # lines come before whole paragraphs
            family, where = int(best[k]), int(some[k])
            if line[where] < 0 and paragraph[where] in sure:
                continue
            alike, chance = similarity(m, hashes[owner == where], family), float(p[k, family])
            confirmed = chance >= PROBABLE and alike >= CONFIRMED
            if confirmed:
                sure.add(paragraph[where])
            out[i + text[where]].append((int(paragraph[where] - first[text[where]]), int(line[where]), FAMILIES[family], chance, alike, confirmed))
    return [(int(n), sorted(found)) for n, found in zip(n_paragraphs, out)]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_paragraphs, found: array of (paragraph, line, family, probability, similarity, confirmed), for each row of docs.

    Paragraphs stand between lines without words.  Each line, and each paragraph of several lines as a whole (line -1), is
    named when a family is likelier than the unknown class, and confirmed when its calibrated probability is PROBABLE and a
    share of CONFIRMED of a template's n-grams is there.  A null or empty text has no paragraphs; rows are independent, so
    ties, repeated rows and an empty table need no care; other columns are dropped, whatever their names.
    """
    names = ("paragraph", "line", "family", "probability", "similarity", "confirmed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                made = find(part["text"])
                yield pd.DataFrame({"key": part["key"], "n_paragraphs": [n for n, _ in made], "found": [[dict(zip(names, f)) for f in found] for _, found in made]})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    schema = "key string, n_paragraphs long, found array<struct<paragraph:int,line:int,family:string,probability:double,similarity:double,confirmed:boolean>>"
    return rows.mapInPandas(run, schema).select(F.col("key").cast(docs.schema[key].dataType).alias(key), "n_paragraphs", "found")
