"""Audio leaves a Python worker in pieces of bounded size, however many files a batch has."""

import pyarrow as pa
import pytest

from speechframes.functions import audio
from speechframes.sources import wav


class Plain:
    """Stands for a table of files: gives back what Spark would run over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def pieces(step, **options):
    files = [audio.riff(bytes(100_000), 16_000)] * 300 + [b"junk", audio.riff(b"")]
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(len(files))], "content": files})
    return list(step(Plain(), **options)(iter([batch, batch])))


@pytest.mark.parametrize(("step", "column"), [(wav.normalise_audio, "pcm16"), (wav.scan_wavs, "pcm")])
def test_audio_in_pieces(spark, step, column):  # schemas are read by the session
    made = pieces(step)
    assert len(made) > 5 and max(b.nbytes for b in made) < wav.PIECE_BYTES + 500_000
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["path"] for r in rows] == [str(i) for i in range(302)] * 2
    assert [(len(r[column] or b""), r["reason"]) for r in rows[299:302]] == [(100_000, None), (0, "not-wav"), (0, "frames")]


def test_scan_keeps_nothing_of_what_it_gave_back(spark):
    """A worker's memory does not grow with the files that went through it."""
    content = audio.riff(bytes(30_000), 16_000)

    def files(n):
        for _ in range(n):
            yield pa.RecordBatch.from_pydict({"path": [str(i) for i in range(1000)], "content": [content] * 1000})

    def held():
        return next(int(line.split()[1]) >> 10 for line in open("/proc/self/status") if line.startswith("VmRSS"))

    step = wav.scan_wavs(Plain())
    sum(b.num_rows for b in step(files(2)))  # memory that the first batches touch
    before = held()
    assert sum(b.num_rows for b in step(files(10))) == 10_000
    assert held() - before < 100  # of 300 MB
