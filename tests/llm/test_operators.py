"""Each operator on a table with every kind of odd row, against a brute-force version or an exact round trip."""

import bisect
import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quadrille.llm import _common, chat, decontam, jaccard, license, lm, media, mixing, suffix, tokens, toxicity

from .conftest import prose, substituted

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


# --- GIF -----------------------------------------------------------------------------------------------------------


def test_gif_round_trip(documents, texts):
    read = media.read_frames(media.store_texts(documents)).select("doc_id", "n_bytes", "samples", "error", "frames").collect()
    got = ordered((r["doc_id"], r["n_bytes"], bytes(r["samples"])) for r in read)
    raw = [(i, (t or "").encode()) for i, t in texts]
    assert got == ordered((i, len(b), b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))) for i, b in raw)
    for r in read:
        assert r["error"] is None
        assert sum(sum(f["histogram"]) for f in r["frames"]) >= len(r["samples"])
        assert [f["start_cs"] for f in r["frames"]] == [10 * k for k in range(len(r["frames"]))]


def test_gif_empty_and_broken(spark, nothing):
    assert media.read_frames(media.store_texts(nothing)).count() == 0
    whole = media.encode_gifs([bytes(range(256))])[0]
    rows = [(1, None), (2, b""), (3, b"GIF89a"), (4, whole[:900]), (5, whole)]
    got = {r["id"]: r for r in media.read_frames(spark.createDataFrame(rows, "id long, gif binary")).collect()}
    assert got[1]["samples"] is None and got[1]["error"] is None
    assert all(got[k]["error"] for k in (2, 3, 4))
    vast = b"GIF89a\xff\xff\xff\xff" + whole[10:]
    assert [e for _, e in media.decode_gifs([vast])] == ["a canvas of too many pixels"]
    assert bytes(got[5]["samples"]) == bytes(range(256))


# a picture of ten by ten pixels in four colours, as a well-known description of the format gives its bytes
PICTURE = bytes.fromhex("47494638396 10a000a0091 0000ffffffff00000000ff000000 21f9040000000000 2c000000000a000a0000 02168c2d99872a1cdc33a00275ec95faa8de608c04914c0100 3b".replace(" ", ""))
ROWS = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3


def test_a_picture_by_its_bytes(spark):
    """A file that this library did not write, as it is and interlaced: rows 0 and 8, then 4, then 2 and 6, then the odd ones."""
    colours = {"0": (255, 255, 255), "1": (255, 0, 0), "2": (0, 0, 255)}
    place = PICTURE.index(b"\x2c") + 9
    interlaced = PICTURE[:place] + b"\x40" + PICTURE[place + 1 :]
    woven = [None] * 10
    for row, to in zip(ROWS, (0, 8, 4, 2, 6, 1, 3, 5, 7, 9)):
        woven[to] = row
    files = spark.createDataFrame([(1, PICTURE), (2, interlaced)], "id long, gif binary")
    got = {r["id"]: r for r in media.frame_table(files, "id").collect()}
    for i, rows in ((1, ROWS), (2, woven)):
        assert bytes(got[i]["rgba"]) == b"".join(bytes((*colours[c], 255)) for row in rows for c in row)
        assert sorted(n for n in got[i]["histogram"] if n) == [16, 42, 42] and (got[i]["width"], got[i]["height"]) == (10, 10)
    small = media.read_frames(files, most_pixels=99).collect()
    assert {r["error"] for r in small} == {"a canvas of too many pixels"} and all(r["error"] is None for r in media.read_frames(files, most_pixels=None).collect())


@pytest.mark.parametrize("seed", range(4))
def test_lzw_of_any_bytes(seed):
    rng = random.Random(seed)
    parts = [bytes(rng.randrange(1, 2 + 60 * seed) for _ in range(64 * rng.randrange(1, 400))) for _ in range(5)]
    codes = media.pack([media.lzw_codes(p) for p in parts])
    for p, found in zip(parts, media.lzw_samples(codes, 8, [len(p) for p in parts])):
        assert found.tobytes() == p


def small_gif(frames, disposal, clear=None):
    """2 by 2 pixels; each frame: x, y, w, h, indices."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + bytes([2, 0, 2, 0, 0x81, 0, 0]) + palette
    for x, y, w, h, indices in frames:
        codes, bits = [4, *itertools.chain.from_iterable((i, 4) for i in indices), 5], 3  # a clear code after each: three bits
        value = sum(c << bits * k for k, c in enumerate(codes))
        data = value.to_bytes(-(-len(codes) * bits // 8), "little")
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0, 0])
        out += b"\x2c" + bytes([x, 0, y, 0, w, 0, h, 0, 0, 2, len(data)]) + data + b"\0"
    return out + b"\x3b"


@pytest.mark.parametrize("disposal,expected", [(1, [[1, 1, 1, 1], [2, 1, 1, 1]]), (2, [[1, 1, 1, 1], [2, None, None, None]]), (3, [[1, 1, 1, 1], [2, None, None, None]])])
def test_gif_disposal(disposal, expected):
    (frames, error), = media.decode_gifs([small_gif([(0, 0, 2, 2, [1] * 4), (0, 0, 1, 1, [2])], disposal)])
    colours = {None: (0, 0, 0, 0), 1: (255, 0, 0, 255), 2: (0, 255, 0, 255)}
    seen = [[tuple(p) for p in f["canvas"].reshape(-1, 4).tolist()] for f in frames]
    assert error is None and seen == [[colours[c] for c in e] for e in expected]


def test_gif_transparency_and_frame_table(spark):
    gif = small_gif([(0, 0, 2, 2, [1] * 4), (0, 0, 2, 2, [3, 2, 3, 2])], 1, clear=3)
    rows = media.frame_table(spark.createDataFrame([(7, gif)], "id long, gif binary"), "id").orderBy("frame").collect()
    assert [(r["frame"], r["start_cs"], r["delay_cs"]) for r in rows] == [(0, 0, 5), (1, 5, 5)]
    last = np.frombuffer(bytes(rows[1]["rgba"]), np.uint8).reshape(4, 4)
    assert last[:, 0].tolist() == [255, 0, 255, 0] and last[:, 1].tolist() == [0, 255, 0, 255]


# --- LM --------------------------------------------------------------------------------------------------------------


def test_lm_counts_are_exact_and_scores_near(documents, texts):
    told = [(i, WORD.findall((t or "").translate(LOW)) + ["</s>"]) for i, t in texts]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in told]
    count, pairs, context, kinds = Counter(), Counter(), Counter(), Counter()
    for (_, ws), h in zip(told, held):
        if not h:
            count.update(ws)
            pairs.update(zip(["<s>", *ws], ws))
    for (a, _), n in pairs.items():
        context[a] += n
        kinds[a] += 1
    total, distinct = sum(count.values()), len(count)

    def model(ws):
        out = 0.0
        for a, b in zip(["<s>", *ws], ws):
            base = (count[b] + 1) / (total + distinct + 1)
            out += math.log10((max(pairs[a, b] - 0.75, 0) + 0.75 * kinds[a] * base) / context[a] if context[a] else base)
        return out

    expected = ordered((i, h, len(ws), sum(count[w] > 0 for w in ws), total) for (i, ws), h in zip(told, held))
    got = lm.score(documents).collect()
    assert ordered(tuple(r)[:5] for r in got) == expected
    base = {(i, len(ws)): sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws) for i, ws in told}
    for r in got:
        near = [model(ws) for i, ws in told if i == r["doc_id"] and len(ws) == r["n_tokens"]]
        assert any(abs(r["score"] - x) < 0.02 * r["n_tokens"] + 1e-6 for x in near)
        if r["doc_id"] is not None and r["doc_id"] < 30:
            assert abs(r["base_score"] - base[r["doc_id"], r["n_tokens"]]) < 1e-6


def test_lm_of_nothing(nothing):
    assert lm.score(nothing).count() == 0


@pytest.mark.parametrize("n,most", [(0, 1), (1, 9), (700, 1 << 40), (3000, 3100), (500, 3)])
def test_elias_fano(n, most):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, most, n).astype(np.uint64))
    fano = lm.EliasFano(*lm.EliasFano.parts(values))
    if n:
        assert (fano.get(np.arange(n)) == values).all()
        sought = rng.integers(0, int(values[-1]) + 1, 500).astype(np.uint64)
        assert (fano.successor(sought) == np.searchsorted(values, sought)).all()


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_mix(documents, texts):
    rows = mixing.mix_sources(documents).collect()
    assert ordered((r["doc_id"], r["size"]) for r in rows) == ordered((i, len(WORD.findall(t or ""))) for i, t in texts)
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(rs[0]["target"] for rs in by_source.values()) - total) < 1e-6 * total
    for rs in by_source.values():
        size, target = sum(r["size"] for r in rs), rs[0]["target"]
        assert rs[0]["source_size"] == size and target <= 3 * size
        assert abs(sum(r["taken"] for r in rs) - target) <= max(r["size"] for r in rs) / 2 + 1e-6
        assert all(r["taken"] == r["repeats"] * r["size"] <= 3 * r["size"] for r in rs)
    assert ordered(map(tuple, mixing.mix_sources(documents).collect())) == ordered(map(tuple, rows))


def test_water_filling(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, "d": 900, None: 1}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2]))
    capped = {"b", "c", None}
    rest = sum(sizes.values()) - 3 * sum(sizes[s] for s in capped)
    assert got == {s: 3.0 * sizes[s] if s in capped else rest * weights[s] / 2 for s in sizes}


def test_mix_of_nothing(nothing):
    assert mixing.mix_sources(nothing).count() == 0


# --- near copies -----------------------------------------------------------------------------------------------------


def sets(texts):
    out = []
    for t in texts:
        ws = WORD.findall((t or "").translate(LOW))
        out.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
    return out


def linked(texts):
    found = sets(texts)
    links = {k: set() for k in range(len(texts))}
    for a, b in itertools.combinations(range(len(texts)), 2):
        if found[a] and found[b] and 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b]):
            links[a].add(b)
            links[b].add(a)
    return links


def groups(links):
    left, out = set(links), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            k = todo.pop()
            part.add(k)
            todo += links[k] & left
            left -= links[k]
        out.append(part)
    return out


def test_links(documents, texts):
    links = linked([t for _, t in texts])
    least = {}
    for part in groups(links):
        keys = [texts[k][0] for k in part]
        least |= dict.fromkeys(part, None if None in keys else min(keys))
    expected = ordered((texts[k][0], least[k], len(links[k])) for k in links)
    assert ordered(tuple(r)[:3] for r in jaccard.link(documents).select("doc_id", "class_id", "n_links").collect()) == expected


@pytest.mark.parametrize("limit", [3, 2048])
def test_links_in_blocks(spark, monkeypatch, limit):
    """A group of near copies that is dealt over several pairs of blocks has the same links."""
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", limit)
    rng = random.Random(8)
    base = prose(rng, 120)
    texts = [substituted(rng, base, rng.randrange(5)) for _ in range(24)] + [prose(rng, 50)]
    links = linked(texts)
    got = jaccard.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {k: len(v) for k, v in links.items()}
    assert len({r["class_id"] for r in got}) == len(groups(links))


def test_links_where_a_block_is_empty(spark, monkeypatch):
    """Two texts that fall into the same of two blocks are linked once, however the pair of blocks is dealt."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 150)
    rng = random.Random(4)
    texts = [substituted(rng, t, k) for t in (prose(rng, 120) for _ in range(12)) for k in (0, 1)]
    links = linked(texts)
    got = jaccard.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {k: len(v) for k, v in links.items()}


def test_uneven_join(spark, monkeypatch):
    """Keys on both sides of the bound for a broadcast, and rows without a partner."""
    monkeypatch.setattr(_common, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 3), (3, 1), (4, 2)) for i in range(n)], "k long, i long")
    found = spark.createDataFrame([(1, "a", 40), (2, "b", 3), (3, "c", 1), (9, "d", 1)], "k long, v string, n long")
    for how in ("inner", "left"):
        got = _common.join_uneven(rows, found, ["k"], "n", how).select("k", "i", "v").collect()
        assert ordered(map(tuple, got)) == ordered(map(tuple, rows.join(found, "k", how).select("k", "i", "v").collect()))


def test_one_of_each_group_stays(documents, texts):
    parts = groups(linked([t for _, t in texts]))
    kept = jaccard.keep_one(documents)
    assert kept.columns == documents.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len(parts)
    for part in parts:
        keys = [texts[k][0] for k in part]
        first = None if None in keys else min(keys)
        assert sum((first, texts[k][1]) in rows for k in set(part) if texts[k][0] == first) >= 1


def test_links_of_nothing(nothing):
    assert jaccard.link(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0


def test_pruning_bound():
    least = jaccard.least_matches(0.8, jaccard.TOLERANCE)
    assert 0 < least[16] < 16 and all(least[n] / n <= 0.8 for n in least)


# --- chat ------------------------------------------------------------------------------------------------------------

TURNS = [
    (1, 0, "user", "hi <|end|> \\ <|turn|>"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", "a\\<|b <\\|x"), (1, 4, "user", "tail"),
    (2, 0, None, ""), (2, 0, "assistant", ""), (3, None, "system", "s"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (4, 0, "user<|text|>", "only \n user"),
]


def test_chat(spark):
    df = spark.createDataFrame([(*t, "c") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    convs = {}
    for c, turn, role, text in TURNS:
        convs.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    examples = chat.expand(df)
    for r in chat.digest(chat.read_back(examples)).collect():
        said = sorted(convs[r["conv_id"]])
        own = "".join(t for _, _, role, t in said if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, _, role, t in said)
        assert (r["n_turns"], r["turns_sha256"]) == (len(said), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(own.encode()).hexdigest())
    rows = examples.collect()
    assert sum(r["trainable"] for r in rows) == sum(t[2] == "assistant" for t in TURNS)
    for r in rows:
        inside = r["formatted"][r["loss_start"] : r["loss_end"]]
        assert not re.search(r"<\||</?s>|\[/?INST\]", inside)
        assert r["trainable"] or not inside
    plans = examples._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plans and "Arrow" not in plans


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.read_back(chat.expand(none))).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(12)
    items = [(k, prose(rng, rng.randrange(15, 60))) for k in range(12)] + [(50, None), (51, "too short"), (52, "")]
    docs = []
    for k in range(12):
        passage = items[k][1] if k % 3 == 0 else items[k][1].upper() if k % 3 == 1 else substituted(rng, items[k][1], 1)
        docs.append((k, prose(rng, 80) + "\n" + passage + ". " + prose(rng, 40)))
    docs += [(100 + k, prose(rng, 200)) for k in range(20)] + [(200, None), (201, ""), (None, items[0][1]), (0, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_overlaps(spark, leaks, bound):
    docs, items = leaks
    a, b = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item long"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.overlaps(a, b, broadcast_seeds=bound).collect()
    by_doc = {(r["doc_id"], r["item_id"]): r for r in found}
    for k in range(12):
        assert (k, k) in by_doc or (k % 3 == 2 and len(items[k][1].split()) < 20)
        if k % 3 < 2:
            assert by_doc[k, k]["n_equal"] >= len(items[k][1].split())
    assert {d for d, _ in by_doc} <= {*range(12), None}
    assert len(by_doc) == len(found)
    kept = {r["doc_id"] for r in decontam.decontaminate(a, b).collect()}
    assert {*range(100, 120), 200, 201} <= kept and not kept & {0, 3, 6, 9, 1, 4, None}


def test_overlaps_of_null_and_equal_keys(spark):
    rng = random.Random(13)
    first, second, third = (prose(rng, 25) for _ in range(3))
    docs = [(None, "x " + first), (None, "x x " + second), (1, first), (1, prose(rng, 30)), (1, "y " + second), (2, third), (2, third), (3, "z " + prose(rng, 40))]
    items = [(None, first), (None, third), (7, second), (8, None)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = [(None, None, 1, 0, 25, 25), (None, 7, 2, 0, 25, 25), (1, None, 0, 0, 25, 25), (1, 7, 1, 0, 25, 25), (2, None, 0, 0, 25, 25)]
    for bound in (1_000_000, 0):
        assert ordered(map(tuple, decontam.overlaps(a, b, broadcast_seeds=bound).collect())) == ordered(expected)
    assert sorted(r["text"] for r in decontam.decontaminate(a, b).collect()) == sorted([docs[3][1], docs[7][1]])


def test_overlaps_of_nothing(spark, nothing, documents):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.overlaps(nothing, items).count() == 0
    assert decontam.decontaminate(documents, items).count() == documents.count()
    assert decontam.overlaps(nothing, spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")).count() == 0


# --- licences --------------------------------------------------------------------------------------------------------


def test_licences(spark, documents, nothing, texts):
    rng = random.Random(3)
    known = [(f, t) for f, ts in license.TEMPLATES.items() for t in ts]
    rows = [(k, f"{prose(rng, 40)}\n\n{t}\n{prose(rng, 30)}") for k, (_, t) in enumerate(known)]
    found = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum([f["family"] for f in found[k]["found"] if f["confirmed"]] == [family] for k, (family, _) in enumerate(known))
    assert right >= 0.9 * len(known)
    assert all(r["n_paragraphs"] == 2 and all(f["line"] == 0 and f["paragraph"] == 1 for f in r["found"] if f["confirmed"]) for r in found.values())
    other = license.scan(documents).collect()
    assert len(other) == len(texts) and not any(f["confirmed"] for r in other for f in r["found"])
    assert license.scan(nothing).count() == 0
    for text in ("The driver showed his licence.", "Copyright 2020 the authors.", "Licensed under the Frobozz terms"):
        assert not any(f[5] for f in license.find([text])[0][1])


@pytest.mark.parametrize("line", [
    "MIT", "BSD", "Mozilla Public", "public license", "Creative Commons", "Permission is hereby denied.", "Eclipse Public License v 2.0", "Artistic License 2.0",
    "This Source Code Form is subject to the terms of the European Union Public Licence, v. 1.2.", "This work is licensed under CC BY-ND 4.0.", "Licensed under the zlib License.",
    "Licensed under the Vim License.", "SPDX-License-Identifier: EUPL-1.2", "Licensed under the EPL 2.0", "Released under the WTFPL.", "Distributed under the terms of the Ruby License.",
])
def test_other_licences_are_not_confirmed(line):
    rng = random.Random(2)
    for text in (line, f"{line}\n{prose(rng, 20)}", f"{prose(rng, 20)}\n\n{line}\n"):
        assert not any(f[5] for f in license.find([text])[0][1])


def test_wrapped_notices():
    """A notice over several lines is one paragraph; one of its lines that is confirmed stands for it."""
    notice = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    wrapped = "\n".join(textwrap.wrap(notice, 40))
    (n, found), (m, one), none = license.find([f"Copyright\n \n\n{wrapped}\n\nx", f"\n{notice}\ny", None])
    assert n == 3 and [f[:3] for f in found if f[5]] == [(1, -1, "MPL")]
    assert m == 1 and [f[:3] for f in one if f[5]] == [(0, 0, "MPL")] and none == (0, [])


def test_licence_probabilities():
    """Named paragraphs against plain loops over each line's n-grams."""
    m = license.model()
    word_hash = lambda w: _common.span_hash(_common.prefix_hash(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))
    text = "handor tiones\n\nReleased under the MIT License.\nThis book was released in 1999 under the name of the company\n  \nLicensed under CC BY-NC 4.0. or so\nx"
    units, sure, expected = [], set(), []
    for p, part in enumerate([["handor tiones"], text.split("\n")[2:4], text.split("\n")[5:]]):
        units += [(0, p, k, line) for k, line in enumerate(part)] + ([(1, p, -1, " ".join(part))] if len(part) > 1 else [])
    for _, paragraph, line, unit in sorted(units):
        words = unit.encode().translate(license._TABLE).split()
        grams = set()
        for n in license.GRAMS:
            for k in range(len(words) - n + 1):
                value = np.zeros(1, np.uint64)
                for w in words[k : k + n]:
                    value = _common.mix(value + word_hash(w) + np.uint64(n))
                grams.add(int(value[0]))
        columns = {int(m["seen"][g >> (64 - license.BITS)]) for g in grams} - {-1}
        if not columns:
            continue
        z = [(sum(float(m["weights"][c, f]) for c in columns) + m["bias"][f]) / m["temperature"] for f in range(len(license.FAMILIES))]
        p = [math.exp(x - max(z)) for x in z]
        best = max(range(license.UNKNOWN), key=lambda f: p[f])
        if p[best] <= p[license.UNKNOWN] or line < 0 and paragraph in sure:
            continue
        shares = []
        for k in np.flatnonzero(m["family_of"] == best).tolist():
            template = {int(g) for g, of in zip(m["template"], m["template_of"]) if of == k}
            shares.append(len(template & grams) / len(template))
        confirmed = p[best] / sum(p) >= license.PROBABLE and max(shares) >= license.CONFIRMED
        sure |= {paragraph} if confirmed else set()
        expected.append((paragraph, line, license.FAMILIES[best], p[best] / sum(p), max(shares), confirmed))
    (n, found) = license.find(["", text, "x y"])[1]
    expected.sort()
    assert n == 3 and [f[:3] + f[5:] for f in found] == [e[:3] + e[5:] for e in expected]
    assert all(abs(f[3] - e[3]) < 1e-5 and abs(f[4] - e[4]) < 1e-9 for f, e in zip(found, expected))
    assert {f[2] for f in found if f[5]} >= {"MIT", "CC-BY-NC"}


# --- suffix arrays ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    letters = ["ab", "abc", "a", "abcdefgh\0\xff"][seed % 4]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))).encode("latin-1") for _ in range(rng.randrange(1, 7))]
    texts += [texts[0] + b"zz", b"q" + texts[0], b"aaaa" * 10, b"aaaaaa" * 10]
    symbols, ends, _ = suffix.join(texts)
    order = suffix.suffix_array(symbols)
    value = [(int(x), k if x == 0 else -1) for k, x in enumerate(symbols)]
    assert order.tolist() == sorted(range(len(value)), key=lambda k: value[k:])
    common, _ = suffix.permuted_prefixes(symbols, ends, order)
    for a, b in zip(order.tolist(), order[1:].tolist()):
        n = 0
        while n < min(ends[a] - a, ends[b] - b) and symbols[a + n] == symbols[b + n]:
            n += 1
        assert common[b] == n


def brute_repeats(raws):
    window = suffix.WINDOW
    seen = Counter(hashlib.md5(b[k : k + window]).digest() for b in raws for k in range(len(b) - window + 1))
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[hashlib.md5(b[k : k + window]).digest()] > 1:
                gone[k : k + window] = b"\1" * window
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def rows_of_repeats():
    rng = random.Random(21)
    base = [prose(rng, 300) for _ in range(6)]
    passage = prose(rng, 90)
    texts = [*base, base[0], substituted(rng, base[1], 1), base[2][:500] + passage + base[3][:300], passage + "é" + passage[:450], base[4][7:900]]
    texts += [passage.replace(" ", "\n", 40) + base[3][:90], passage + "\n" + base[0][:50], " " + passage + " ", base[5][:400]]  # equal but for white space, and at ends
    texts += ["ab" * 700, "z" * 900, "", None, "é" * 300, prose(rng, 20)]
    return [(k % 15, t) for k, t in enumerate(texts)] + [(None, base[5][:410]), (3, base[3]), (3, base[3])]


@pytest.mark.parametrize("shard", [1500, 2_000_000])
def test_repeats_are_removed(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix, "SHARD", shard)  # the small one makes shards of several anchors and pairs of blocks
    rows = rows_of_repeats()
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    got = suffix.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated").collect()
    raws = [(t or "").encode() for _, t in rows]
    repeated = [len(b) - len(left) for b, left in zip(raws, brute_word_repeats(raws, suffix.WORDS))]
    assert ordered(map(tuple, got)) == ordered((i, *x, n) for (i, _), x, n in zip(rows, brute_repeats(raws), repeated))


def test_repeats_are_cut(documents, nothing):
    out = suffix.cut_repeats(documents)
    assert out.columns == documents.columns and out.count() == documents.count()
    assert out.filter("kept <> 'kept' OR n_bytes <> 'n_bytes' OR n_chars <> length(text)").count() == 0
    assert suffix.remove_repeats(nothing).count() == 0 and suffix.cut_repeats(nothing).count() == 0


def brute_word_repeats(raws, words):
    """As brute_repeats, and windows end sooner where so many words, with white space on both sides, are in them."""
    window = suffix.WINDOW
    strings = Counter(b[k : k + window] for b in raws for k in range(len(b) - window + 1))
    found = []
    for b in raws:
        b = b" " + re.sub(rb"[\x20\x09-\x0D]", b" ", b) + b" "
        spots = [(m.start() - 1, m.end() + 1) for m in re.finditer(rb"[^ ]+", b)]
        mine = []
        for k in range(len(b)):
            nth = bisect.bisect_left(spots, (k,)) + words - 1
            stop = spots[nth][1] if nth < len(spots) else k + window + 1
            end = min(k + window, stop)
            if end <= len(b):
                mine.append((k, end - (end == stop), b[k:end]))
        found.append(mine)
    seen = Counter(x for mine in found for _, _, x in mine)
    out = []
    for b, mine in zip(raws, found):
        gone = bytearray(len(b) + 2)
        for k in range(len(b) - window + 1):
            if strings[b[k : k + window]] > 1:
                gone[k + 1 : k + 1 + window] = b"\1" * window
        for k, end, x in mine:
            if seen[x] > 1:
                gone[k:end] = b"\1" * (end - k)
        out.append(bytes(x for x, g in zip(b, gone[1:]) if not g))
    return out


@pytest.mark.parametrize("shard", [1500, 2_000_000])
def test_repeats_of_words_are_cut(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix, "SHARD", shard)
    rng = random.Random(4)
    texts = [prose(rng, 60) for _ in range(9)]
    short = " ".join(rng.choice("abcdefgh") for _ in range(51))
    long, less = prose(rng, 55), prose(rng, 50)
    texts[0] += " " + short
    texts[1] = short.replace(" ", "\n") + "\n\n" + texts[1]
    texts[2] += "\n" + long + " " + texts[8][:90]
    texts[3] = long + "\t" + texts[3]
    texts[4] += " " + long + "x"
    texts[5] += " " + less + " " + texts[5]
    texts[6] += " " + less
    texts += [short, less, "", None, "a b " * 200, "é" * 300, "é" * 300, " " * 900, texts[0][30:]]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: r["text"] for r in suffix.cut_repeats(docs).collect()}
    for k, left in enumerate(brute_word_repeats([(t or "").encode() for t in texts], 51)):
        assert got[k] == left.decode(errors="ignore"), k
    assert short not in got[0] and long not in got[2] and less in got[6]


# --- toxicity --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    bad = ["idiot", "moron", "pathetic", "worthless"]
    texts, labels = [], []
    for k in range(240):
        words = prose(rng, rng.randrange(20, 200)).split(" ")
        for _ in range(3 if k % 3 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return toxicity.fit(texts[:180], labels[:180]), texts[180:], labels[180:]


def test_toxicity_held_out(model):
    fitted, texts, labels = model
    said = toxicity.score_texts(fitted, texts) >= toxicity.REJECT
    assert np.mean(said == np.array(labels)) >= 0.95
    clean, bad, misspelt = toxicity.score_texts(fitted, ["handor tiones " * 10, "handor tiones " * 5 + "moron idiot", "handor tiones " * 5 + "morron idiott"])
    assert clean < misspelt <= bad


def test_toxicity_scores(model, texts):
    """Scores against a plain loop: n-grams of each word, the mean of its values, the worst run of words."""
    fitted = model[0]
    kept = [t for _, t in texts if t is None or len(t) < 3000]
    for text, got in zip(kept, toxicity.score_texts(fitted, kept)):
        value = []
        for word in toxicity.spaced(text).split():
            framed = b" " + word + b" "
            found = [framed[k : k + n] for n in toxicity.GRAMS for k in range(len(framed) - n + 1)]
            at = [int(_common.span_hash(_common.prefix_hash(np.frombuffer(g, np.uint8)), np.array([0]), np.array([len(g)]))[0] >> np.uint64(64 - 17)) for g in found]
            value.append(sum(float(fitted["value"][k]) for k in at) / max(len(at), 1))
        run = min(len(value), toxicity.RUN)
        worst = max((sum(value[k : k + run]) / run for k in range(len(value) - run + 1)), default=None) if value else None
        expected = 0.0 if worst is None else 1 / (1 + math.exp(-(worst + fitted["bias"])))
        assert abs(got - expected) < 1e-6


def test_toxicity_rows(documents, nothing, texts, model):
    fitted = model[0]
    rows = toxicity.score(documents, fitted).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    assert ordered((r["doc_id"], r["held_out"]) for r in rows) == ordered((i, held(i)) for i, _ in texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    kept = toxicity.keep_clean(documents, fitted)
    assert kept.schema.names == documents.schema.names and kept.count() == sum(not r["predicted"] for r in rows)
    assert toxicity.score(nothing, fitted).count() == 0 and toxicity.keep_clean(nothing, fitted).count() == 0


def test_toxicity_without_labels(spark, documents):
    none = toxicity.train(documents, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(documents, none).filter("score > 1e-9 OR predicted = 1").count() == 0


# --- tokens ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("long", [3, 256])
def test_token_counts(monkeypatch, long):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(tokens, "LONG", long)
    rng = random.Random(1)
    texts = ["", " ", "  a  b", "a" * 400, "</s>hi<s>", "▁▁ a", "ｆｕｌｌ é ﬁ", "\0\1", "日本語テキスト" * 60, "ab" * 300 + "aab" * 200, " " * 50, "<unk> <0x0A>", "🙂"]
    texts += ["".join(rng.choice("aabbcceht  io\nn.,é") for _ in range(rng.randrange(80))) for _ in range(200)]
    model, merges = sentencepiece.SentencePieceProcessor(model_file=path), tokens.loaded(path)
    for t in texts:
        cut = tokens.PRE_TOKEN.findall(tokens.MARK + t.replace(" ", tokens.MARK)) if t else []
        assert (int(merges.count(cut).sum()) if cut else 0) == len(model.encode(t))


def test_token_rows(documents, nothing, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = [len(model.encode(t or "")) for _, t in texts]
    got = ordered(tuple(r) for r in tokens.count_tokens(documents, path).collect())
    assert got == ordered((i, len((t or "").encode()), k, k > 4096) for (i, t), k in zip(texts, n))
    assert tokens.count_tokens(nothing, path).count() == 0
