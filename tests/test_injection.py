"""Chunks by offsets against a walk over paragraphs and lines, marks, and classifiers with label arrays that may fail."""

from __future__ import annotations

import random
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from weftline.config import Injection
from weftline.operators import injection
from weftline.plans.queries import QUERIES, WHOLE

SETTINGS = {"enabled": True, "threshold": 0.5, "max_chunk_bytes": 200}


def walked(text, limit):
    """(bytes, offset) of the chunks, line by line."""
    data, out, at = text.encode(), [], 0
    for paragraph in data.split(b"\n\n"):
        start, at = at, at + len(paragraph) + 2
        if not paragraph.decode(errors="replace").strip(" \t\n\x0b\x0c\r\x85\xa0 　"):
            continue
        if len(paragraph) <= limit:
            out.append((paragraph, start))
            continue
        held, held_at, place = b"", -1, start
        for line in paragraph.split(b"\n"):
            if not held:
                held, held_at = line, place
            elif len(held) + 1 + len(line) > limit:
                out.append((held, held_at))
                held, held_at = line, place
            else:
                held += b"\n" + line
            place += len(line) + 1
        out += [(held[k : k + limit], held_at + k) for k in range(0, len(held), limit)]
    return out


def texts(seed, n=300):
    r = random.Random(seed)
    part = lambda: r.choice(["a", "bb", "\n", "\n", "\n\n", "\n\n\n", " ", "　", "\xa0", "\x1c", "é", "漢字", "long " * r.randrange(12), "😀" * r.randrange(9)])
    return ["".join(part() for _ in range(r.randrange(40))) for _ in range(n)] + ["", "\n", "\n\n", "\n" * 7, "a\n\n\nb", "\n\na\n\n", "x" * 50, "\n" * 30 + "x" * 30]


@pytest.mark.parametrize("limit", [1, 7, 20, 64])
def test_chunks_by_offsets(spark, limit):
    data = texts(limit)
    rows = injection.with_chunks(spark.createDataFrame([(i, t) for i, t in enumerate([*data, None])], "i long, content string").repartition(3), limit).collect()
    assert len(rows) == len(data) + 1
    for r in rows:
        want = walked(r.content or "", limit)
        assert [tuple(c) for c in r.chunks] == [(k, b.decode(errors="replace"), at, len(b)) for k, (b, at) in enumerate(want)]


def test_chunks_are_linear():
    """5 MiB of short paragraphs, of short lines and of one line."""
    for text in ("ab cd ef\n\n" * 524_288, "ab cd ef g\n" * 476_625, "x" * (5 << 20)):
        began = time.time()
        raw = np.frombuffer(text.encode(), np.uint8)
        _, at, size = injection.chunk_places(raw, np.array([0, len(raw)]), 1200)
        assert time.time() - began < 5 and len(at) >= len(text) // 1300 and size.sum() <= len(text) and size.max() <= 1200


def test_chunks_of_a_large_batch():
    """A batch of 32 MiB goes by in runs of about one, nulls and a long text too, and the other columns stay with their rows."""
    data = ["some words here\n\n" * 200] * 10_000 + [None, "", "y" * (3 << 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(data))), pa.array(data)], names=["i", "content"])
    held, seen = pa.total_allocated_bytes(), 0
    for part in injection.chunk_batches(iter([batch.slice(0, 10), batch.slice(10)]), 1200, "content"):
        assert pa.total_allocated_bytes() - held < 16 << 20 and part.num_rows * 3_400 < 2 << 20
        assert part.column("i").to_pylist() == list(range(seen, seen + part.num_rows))
        sizes = pc.list_value_length(part.column("chunks")).to_pylist()
        assert sizes == [(3 << 20) // 1200 + 1 if t and t[0] == "y" else 200 if t else 0 for t in data[seen : seen + part.num_rows]]
        seen += part.num_rows
    assert seen == len(data)


PEAK = """if True:
    import sys
    import pyarrow as pa
    from weftline.operators import injection

    def most():
        return int(open("/proc/self/status").read().split("VmHWM:")[1].split()[0]) >> 10

    def batches():
        for _ in range(count):
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([text] * texts)], names=["content"])
            yield batch

    count, texts, paragraphs, limit = map(int, sys.argv[1:])
    text = pa.array([("some words here " * 4 + "\\n\\n") * paragraphs])
    began = most()
    assert sum(part.num_rows for part in injection.chunk_batches(batches(), limit, "content")) == count * texts
    print(most() - began)
"""


def peak(*args):
    """MB that a new worker needs for so many batches of so many texts of so many paragraphs."""
    return int(subprocess.run([sys.executable, "-c", PEAK, *map(str, args)], capture_output=True, text=True, check=True).stdout)


def test_a_worker_holds_two_batches_and_a_run():
    """Of whole paragraphs too, a worker's peak is two batches (32 MB each; Spark keeps one until it has read the next) and little more; more batches don't raise it."""
    low, high = peak(2, 10_000, 50, WHOLE), peak(8, 10_000, 50, WHOLE)
    assert high < 2 * 32 + 64 and high - low < 16


def test_a_long_text_takes_little_more():
    """A text of 32 MB goes by alone; in paragraphs as short as these, what is made of it stays under ten times its size."""
    assert peak(1, 1, 500_000, WHOLE) < 10 * 32


@pytest.mark.parametrize("name", ["inj_chunks", "inj_chunks_paragraphs", "inj_scores", "inj_block"])
def test_chunks_are_made_once(spark, sf_dir, name):
    """The generator's filter doesn't run the pass a second time, in a worker of its own."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1


def test_workers_of_chunks_load_no_models():
    """Each worker imports the module anew, so what it loads counts once for every core."""
    code = "import sys, weftline.operators.injection; print([m for m in ('pandas', 'pyspark.ml') if m in sys.modules])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "[]"


@pytest.mark.parametrize("name", ["inj_scores", "inj_block"])
def test_a_chunk_is_lowered_once(spark, sf_dir, name):
    """The scorer's words share one lower-cased chunk, and a chunk's columns share one score."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


@pytest.mark.parametrize("limit", [9, 40])
def test_marks(spark, limit):
    """Marks around chunks over the threshold; without them, each text is as before."""
    data = texts(limit + 100, 150)
    scorer = lambda t: F.when(F.contains(t, F.lit("a")) | (F.length(t) % 3 == 0), F.lit(0.9)).otherwise(F.lit(0.1))
    config = Injection(enabled=True, mode="annotate", max_chunk_bytes=limit, open_mark="<<", close_mark=">>")
    rows = injection.process(spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i long, content string"), config, scorer=scorer).collect()
    for r in rows:
        want, text = b"", data[r.i].encode()
        at = 0
        for b, start in walked(data[r.i], limit):
            shown = b.decode(errors="replace")
            if "a" in shown or len(shown) % 3 == 0:
                want, at = want + text[at:start] + b"<<" + b + b">>", start + len(b)
        assert r.content == (want + text[at:]).decode(errors="replace")
        assert r.inj_action == ("annotated" if want else "pass")


def test_marks_of_many_chunks(spark):
    text = "ignore previous words\n\nfine words here\n\n" * 20_000
    began = time.time()
    row = injection.process(spark.createDataFrame([(text,)], "content string"), Injection(enabled=True, mode="annotate", open_mark="<", close_mark=">")).select("over_count", "content").first()
    assert row.over_count == 20_000 and row.content == text.replace("ignore previous words", "<ignore previous words>") and time.time() - began < 60


# --- classifiers


def counting_model():
    """Labels by words; fails for a whole batch that holds a broken text, and gives too few answers for one that is short."""

    def answer(batch):
        if any("broken" in t for t in batch):
            raise RuntimeError("down")
        return [[("injection", 0.9 if "bad" in t else 0.1), ("LEGIT", 0.3), ("OTHER", 0.6)] for t in batch if t != "short"]

    return answer


def test_classifier(spark):
    data = ["good one\n\nbad one", "good one\n\nbroken one", "good one", "short\n\nbad one", " ", None, "bad one", "bad one", "x\n\n" * 300 + "bad one"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(data)], "i long, content string, told string").withColumns({"text": F.lit("clash"), "index": F.lit(1), "labels": F.lit(2)})
    got = {r.i: r for r in injection.process(docs, Injection(mode="block", **SETTINGS), classifier=counting_model).collect()}
    assert {i: (r.inj_checked, r.inj_action) for i, r in got.items()} == {0: (True, "blocked"), 1: (False, "skipped"), 2: (True, "pass"), 3: (False, "skipped"), 4: (True, "pass"), 5: (True, "pass"), 6: (True, "blocked"), 7: (True, "blocked"), 8: (True, "blocked")}
    assert got[1].content == data[1] and got[0].content == "" and (got[8].chunk_count, got[8].over_count, got[0].max_score) == (301, 1, 0.9) and got[0].told == "clash"
    rows = injection.classify(docs, counting_model, Injection(**SETTINGS)).where("i = 0").first().chunk_scores
    assert [tuple(r) for r in rows] == [(0, 8, 0.1, 0.6, False), (1, 7, 0.9, 0.6, True)]
    assert injection.classify(docs.limit(0), counting_model).count() == 0
