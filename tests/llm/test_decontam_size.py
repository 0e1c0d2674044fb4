"""What a large benchmark or long documents would make op6 hold."""

import contextlib
import io
import re

import pytest

from quadrille.llm import decontam


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def tables(spark):
    passage = [f"w{i * i % 97}x{i}" for i in range(14)]
    docs = [(n, " ".join([f"d{n}y{i}" for i in range(50 * n)] + passage[n % 2 :] + [f"e{n}z{i}" for i in range(9)])) for n in range(6)]
    items = [(i, " ".join(passage)) for i in range(40)] + [(99, " ".join(passage[1:] + ["more"])), (7, "one two three four five six seven eight nine ten")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_alignments_hold_no_whole_document(tables, bound):
    """Rows that are followed have an item's words of a document: a task that holds many of a long document's stays small."""
    plan = explained(decontam.overlaps(*tables, broadcast_seeds=bound))
    followed = [line for line in plan.splitlines() if "aggregate(transform(" in line]
    assert followed and not [line for line in followed if re.search(r"\bh#\d+", line)]


def test_a_large_benchmark_is_not_broadcast(tables):
    assert "Broadcast" not in explained(decontam.overlaps(*tables, broadcast_seeds=0))


@pytest.mark.parametrize("bound", [0, 33])
def test_equal_items_are_aligned_once(tables, bound):
    """40 equal items have the seeds of one, so they count once for the broadcast, too; each still has its rows."""
    df = decontam.overlaps(*tables, broadcast_seeds=bound)
    assert ("Broadcast" in explained(df)) == (bound == 33)
    got = {tuple(r) for r in df.collect()}
    want = {(n, i, 50 * n, n % 2, 14 - n % 2, 14 - n % 2) for n in range(6) for i in range(40)}
    want |= {(n, 99, 50 * n + 1 - n % 2, 0, 13, 13) for n in range(6)}
    assert got == want
