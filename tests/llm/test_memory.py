"""What a Python worker holds between slices; measured in a process of its own, with a worker's environment."""

import os
import subprocess
import sys
import weakref
from collections import Counter

import numpy as np
import public_tokenizers

from edgelog.llm import alignment, collocations, shared

ALIGNED = """
import random, re, sys
import pyarrow as pa
from edgelog.llm import alignment, shared

class Context:
    get = staticmethod(lambda: Context)
    partitionId = staticmethod(lambda: 0)

class Docs:
    def mapInArrow(self, work, schema):
        return work

def held():
    with open("/proc/self/smaps_rollup") as file:
        return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", file.read())[1]) >> 10

alignment.TaskContext = Context
draw = random.Random(3)
words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(30_000)]
texts = [" ".join(draw.choices(words, k=400)) for _ in range(2_000)]
batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
del texts, words
for row in alignment._slice_rows(Docs(), *sys.argv[1:], True, 2 << 20)(iter([batch])):
    left = held()
    del row
    shared.give_back()
    print(left - held())
"""


def test_aligned_slices_leave_no_freed_memory_behind():
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run(
        [sys.executable, "-c", ALIGNED, *paths], env={**os.environ, **shared._WORKERS, "PYTHONPATH": root},
        capture_output=True, text=True, check=True,
    )
    left = list(map(int, run.stdout.split()))
    assert len(left) > 2 and max(left) < 5, left


def test_windows_go_out_in_bounded_batches():
    held = collocations._Windows(2)
    codes = np.random.default_rng(5).integers(1, 2_000, 300_000)
    batches = [*held.add(codes, codes > 0), *held.flush()]
    assert len(batches) > 1 and max(b.num_rows for b in batches) <= 1 << 16
    found = {tuple(p): n for b in batches for p, n in zip(b.column("phrase").to_pylist(), b.column("n").to_pylist())}
    assert found == Counter(zip(codes[:-1].tolist(), codes[1:].tolist()))


def workers_of_a_task(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_tries_pass_by_in_one_worker(spark):
    draw = np.random.default_rng(8)
    texts = [draw.integers(0, 9, 700).astype(np.int32) for _ in range(5)]
    rows = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "codes binary").coalesce(2)
    pairs = {(int(a), int(b)) for a, b in draw.integers(1, 9, (40, 2))}
    tries = list(collocations._tries(spark.createDataFrame([(list(p), 1) for p in pairs], collocations.PHRASES), 8, 2))
    assert len(tries) > 2
    found = collocations._longer(rows, tries, 3, 1)
    assert workers_of_a_task(found) == 1  # each one has a process of its own, all at the same time
    expected = Counter(
        w for t in texts for w in zip(t.tolist(), t[1:].tolist(), t[2:].tolist()) if w[:2] in pairs and w[1:] in pairs
    )
    counted = Counter()
    for phrase, n in found.collect():
        counted[tuple(phrase)] += n
    assert counted == expected


def test_blocks_of_words_pass_by_in_one_worker(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "a b c, d e f g"), ("de", "g f zz a"), (None, "a b")], "lang string, text string")
    words, blocks = collocations.with_codes(collocations.word_counts(docs), 2)
    assert blocks > 2
    monkeypatch.setattr(collocations, "kept", lambda df: df)
    found = collocations.coded_texts(docs.coalesce(1), words, blocks)
    assert workers_of_a_task(found) == 1
    code = {(w.lang, bytes(w.word).decode()): w.code for w in words.collect()}
    codes = np.concatenate([np.frombuffer(r.codes, np.int32) for r in found.collect()])
    expected = [*((("en"), w) for w in "abc"), 0, *(("en", w) for w in "defg"), 0]
    expected += [*(("de", w) for w in ("g", "f", "zz", "a")), 0, ("und", "a"), ("und", "b")]
    assert [c for c in codes.tolist() if c] == [code[w] for w in expected if w]
    assert np.flatnonzero(codes == 0).tolist() in ([3, 8, 13], [0, 4, 9, 14])


def test_what_passes_by_is_not_kept(tmp_path):
    from pyspark.core.broadcast import Broadcast

    with open(tmp_path / "sent", "wb") as file:
        Broadcast.dump(Broadcast(path=""), [1, 2], file)
    sent = Broadcast(path=str(tmp_path / "sent"))
    assert collocations._passing(sent, False) == [1, 2] and not hasattr(sent, "_value")
    assert collocations._passing(sent, True) == [1, 2] and sent._value == [1, 2]


def test_steps_behind_the_encoding_drop_the_vocabularies(monkeypatch):
    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):
            return work

    paths = tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    monkeypatch.setattr(alignment, "_PAIRS", {paths: alignment._Pair(*paths)})
    encoder = weakref.ref(alignment._PAIRS[paths].a)
    assert encoder().memory <= 32 << 20
    assert list(alignment._slice_pairs(Rows())(iter([]))) == []
    assert not alignment._PAIRS and encoder() is None


def test_slices_travel_compressed():
    for values in (np.zeros(0, "<i4"), np.arange(5, dtype="<i8"), np.tile(np.arange(900, dtype="<i4"), 300)):
        packed = alignment._packed(values)
        assert (alignment._unpacked(packed, values.dtype.str) == values).all()
    assert len(packed) < values.nbytes // 4
