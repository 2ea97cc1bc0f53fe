"""What the removal of passages keeps on disk: no shuffled files of finished steps, no bytes of stretches that meet by chance, rounds."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_operators import passages_by_force

from sieveline.llm import common, suffix_dedup


def shuffled(spark, most):
    """Shuffles that have files, when there are that few, or after two seconds: files are removed in the background."""
    for _ in range(10):
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        found = {n.split("_")[1] for n in names if n.startswith("shuffle_")}
        if len(found) <= most:
            break
        time.sleep(0.2)
    return found


def texts_of(seed, n):
    rnd = random.Random(seed)
    part = lambda k: "".join(rnd.choice("abcdefgh ijé") for _ in range(k))
    passages = [part(k) for k in (60, 99, 100, 130, 400)]
    return [(k, "".join(rnd.choice([rnd.choice(passages), part(rnd.randint(0, 150)), rnd.choice(passages)[7:]]) for _ in range(rnd.randint(0, 6)))) for k in range(n)]


def test_steps_leave_no_shuffled_files(spark):
    before = shuffled(spark, 0)
    rows = suffix_dedup._texts(spark.createDataFrame(texts_of(1, 60), "doc_id long, text string").repartition(4), "doc_id", "text")
    cuts = suffix_dedup._cuts(rows)  # all steps but the last; a count and a sum leave a number for each task
    assert len(shuffled(spark, len(before) + 2) - before) <= 2
    assert cuts.count() > 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_step_that_fails_leaves_the_setting(spark):
    with pytest.raises(Exception, match="boom"):
        common.tidied(spark.range(3).select(F.raise_error(F.lit("boom")).cast("int").alias("x")), "boom")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize(("shipped", "held", "limit"), [(0.02, 1 << 16, 4000), (0.3, 3, 4000), (0.05, 3, 20)])
def test_rounds_equal_brute_force(spark, monkeypatch, shipped, held, limit):
    for name, value in (("SHIPPED", shipped), ("HELD", held), ("STRETCHES", limit)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = texts_of(2, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_passages(docs).collect()}
    assert got == passages_by_force(rows)


def test_stretches_that_meet_by_chance_drop_out():
    """Texts that share 50 bytes, and no window, share anchors; no stretch of them stays open but those at the edges of a range."""
    rnd = random.Random(3)
    part = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    few, many = part(50), part(120)

    def still_open(common_part):
        rows = []
        for k in range(30):  # a slice for each text
            out = list(suffix_dedup._slice_digits(np.array([k]), np.array([k]), [(part(300) + common_part + part(300)).encode()]))[1]
            rows.append(out.select(["anchor", "id", "h", "at", "sides"]))
        table = pa.Table.from_batches(rows).sort_by("anchor")
        repeated = len(table) - len(set(table["anchor"].to_pylist()))
        kept = [b for b in suffix_dedup._shared(iter(table.combine_chunks().to_batches(max_chunksize=100))) if b.num_rows and b.column(0)[0].as_py() == suffix_dedup._OPEN]
        return repeated, sum(b.num_rows for b in kept)

    repeated, kept = still_open(few)
    assert repeated >= 29 and kept <= 2
    repeated, kept = still_open(many)
    assert repeated >= 29 and kept >= 30
