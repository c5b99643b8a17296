"""Composite jobs: what a caller runs end to end.

Model results are inputs (hypotheses, turns, embeddings) or come from a scoring
function that Spark runs over rows (``score_windows``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechframes.functions import controls as C
from speechframes.functions import formats
from speechframes.operators import assemble, crops, gallery, intervals, ordered, sessions, validate, windows
from speechframes.sources import sinks, tables, wav
from speechframes.functions.text import strip

KEYS = ["tenant_id", "session_id"]


def with_controls(messages: DataFrame) -> DataFrame:
    value = lambda name: C.header_value(F.col("headers"), name)
    made = C.stream_controls(value("x-outputs"), value("x-store-recording"), value("x-final-tracks"), value("x-refinement-tracks"))
    return messages.withColumn("controls", made).withColumn("tenant_id", F.coalesce(F.nullif("tenant_id", F.lit("")), F.lit("default")))


def record_sessions(chunks: DataFrame, idle_us: int, rate: int = 16000) -> DataFrame:
    """Finished recordings of chunks that want a final output: split at end markers, then at idle gaps."""
    wanted = with_controls(chunks).where(C.routed(F.col("controls"), "final"))
    marked = sessions.end_marker_sessions(wanted, KEYS).withColumnRenamed("recording", "_part")
    parts = sessions.idle_sessions(marked, [*KEYS, "_part"], idle_us)
    made = sessions.recording_summary(parts, [*KEYS, "_part", "recording"], rate, F.col("seq"), latest=["controls"])
    made = made.withColumn("store_recording", F.col("controls.store_recording"))
    return sinks.finished_events(made, F.col("controls.final_tracks")).drop("_part")


MOST_SAMPLES = 16 * 30 * 16_000  # sixteen windows of 30 s


def grouped(batches: Iterator[pd.DataFrame], alike: list[str], most: int, samples: str | None, most_samples: int) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by ``alike`` in groups of one kind: at most ``most`` rows, and at most ``most_samples`` once all are padded to the longest.

    What a batch leaves of a group is carried into the next batch. A row that is
    longer than the bound by itself is a group of its own.
    """
    held: pd.DataFrame | None = None

    def kind(frame: pd.DataFrame):  # nulls are a kind like any other
        plain = frame[alike].astype(object).where(frame[alike].notna(), None)
        return pd.factorize(pd.MultiIndex.from_frame(plain))[0]

    for part in batches:
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        kinds, at, longest = kind(held), 0, 0
        sizes = held[samples].fillna(0).to_numpy() if samples else None
        for row in range(len(held)):
            longer = max(longest, sizes[row]) if samples else 0
            if row > at and (kinds[row] != kinds[at] or row - at == most or longer * (row - at + 1) > most_samples):
                yield held.iloc[at:row]
                at, longer = row, sizes[row] if samples else 0
            longest = longer
        held = held.iloc[at:]
    if held is not None and len(held):
        yield held


def _scored(rows: DataFrame, alike: list[str], choose: Callable, schema: str, batch: int, samples: str | None, most_samples: int, spread: list[str] | None, salts: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in grouped(batches, alike, batch, samples, most_samples):
            made = choose(some)(some)
            if len(made) != len(some):
                raise ValueError(f"{len(some)} rows went in, {len(made)} results came out")
            yield pd.concat(made, ignore_index=True)

    if spread is not None:
        rows = rows.repartition(*alike, F.pmod(F.xxhash64(*spread), F.lit(salts)))
    return rows.sortWithinPartitions(*alike, *([samples] if samples else [])).mapInPandas(run, schema)


def score_windows(
    rows: DataFrame, transcribe: Callable, schema: str, language: str = "lang", batch: int = 16,
    samples: str | None = None, most_samples: int = MOST_SAMPLES, spread: list[str] | None = None, salts: int = 32,
) -> DataFrame:
    """Run a scoring function over rows of one language at a time, at most ``batch`` at once.

    transcribe(pandas frame) returns one result frame for each input row, in
    their order; any other number of results is an error. Groups are filled
    across Arrow batches. With ``samples``, a column of lengths, rows of like
    length go together and a group padded to its longest row has at most
    ``most_samples``. With ``spread``, columns that tell rows apart, rows of a
    language are brought together, a frequent one in ``salts`` parts; without it
    they are grouped where they lie.
    """
    return _scored(rows, [language], lambda some: transcribe, schema, batch, samples, most_samples, spread, salts)


def embed_samples(samples: DataFrame, embed: Callable, content: str = "content") -> DataFrame:
    """samples with embedding: embed(bytes) gives a vector; samples without content have none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if c is None else [float(x) for x in embed(bytes(c))] for c in batch], dtype=object)

    return samples.withColumn("embedding", F.pandas_udf(run, "array<double>")(content))


def score_profiles(
    rows: DataFrame, scorers: dict[str, Callable], default: str, schema: str, profile: str = "provider_profile_id", language: str = "lang", batch: int = 16,
    samples: str | None = None, most_samples: int = MOST_SAMPLES, spread: list[str] | None = None, salts: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """Results of the scoring function that each row's profile names (blank: the default), and the rows whose profile is unknown.

    One pass over the rows serves all profiles; options as for ``score_windows``.
    """
    if default not in scorers:
        raise ValueError(f"no scoring function for the default profile {default}")
    chosen = rows.withColumn(profile, F.coalesce(F.nullif(profile, F.lit("")), F.lit(default)))
    known = F.col(profile).isin(list(scorers))
    choose = lambda some: scorers[some[profile].iloc[0]]
    made = _scored(chosen.where(known), [profile, language], choose, schema, batch, samples, most_samples, spread, salts)
    return made, chosen.where(~known).withColumn("reason", F.lit("unknown-profile"))


def refine_windows(chunks: DataFrame, words: DataFrame, turns: DataFrame, size: int, track: str, names: DataFrame | None = None) -> DataFrame:
    """One refined event per slice: words of the slice with speakers, nested and moved to the absolute clock.

    words: session keys, slice_index, idx, word, s_ms, e_ms within the slice; turns: the same with turn_ord, speaker.
    """
    wanted = with_controls(chunks).where(C.routed(F.col("controls"), "refined", track))
    cut = windows.slices(wanted, KEYS, size)
    keys = [*KEYS, "slice_index"]
    labelled = intervals.assign_by_overlap(words, turns, keys, ["idx"])
    if names is not None:
        labelled = gallery.apply_names(labelled, names, KEYS)
    nested = assemble.transcripts(assemble.word_segments(labelled, keys, ["idx"], with_words=True), keys)
    base = F.col("base_sample") / 16000
    joined = cut.join(nested, keys).withColumn("segments", assemble.shift_segments(F.col("segments"), base))
    return joined.select(*keys, F.lit(track).alias("track_id"), base.alias("start_s"), ((F.col("base_sample") + F.col("n_samples")) / 16000).alias("end_s"), F.col("full_text").alias("text"), "segments", "flush_reason")


def finalize_recordings(recordings: DataFrame, asr: DataFrame, aligned: DataFrame, turns: DataFrame, track: str, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Transcripts of the recordings that want this final track, and the rejected ones.

    asr and aligned: segments (keys, idx, text, s_ms, e_ms). Alignment is used where it covers the speech.
    """
    routed = recordings.where(F.array_contains("controls.final_tracks", track) & F.col("controls.want_final"))
    unsafe = C.unsafe_policy(F.col("controls"))
    rejected = routed.where(unsafe).withColumn("reason", F.lit("unsafe-policy"))
    good = routed.where(~unsafe).select(*KEYS)
    choice = assemble.aligned_or_raw(asr, aligned, KEYS).select(*KEYS, "use")
    chosen = asr.withColumn("use", F.lit("asr")).unionByName(aligned.withColumn("use", F.lit("aligned"))).join(choice, [*KEYS, "use"]).join(good, KEYS, "left_semi")
    labelled = intervals.assign_by_overlap(assemble.clean_segments(chosen), turns, KEYS, ["idx"])
    if names is not None:
        labelled = gallery.apply_names(labelled, names, KEYS)
    made = assemble.transcripts(labelled.withColumn("island", F.col("idx")), KEYS)
    return made.withColumn("track_id", F.lit(track)), rejected


def with_coarse(segments: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """segments, and one without a speaker for each row of whole (keys, text, s_ms, e_ms) that has a text and no segment."""
    missed = whole.where(strip("text") != "").join(segments.select(*keys).distinct(), keys, "left_anti")
    columns = {"island": F.lit(1), "speaker": F.lit(""), "n_words": F.lit(0), "text": strip("text")}
    coarse = missed.withColumns(columns).select([F.col(f.name).cast(f.dataType).alias(f.name) for f in segments.schema])
    return segments.unionByName(coarse)


def realtime_finals(words: DataFrame, turns: DataFrame, commits: DataFrame, keys: list[str], names: DataFrame | None = None, gap: int = 750, transcripts: DataFrame | None = None) -> DataFrame:
    """Speaker-labelled finals per commit: turns merged, words owned once, best overlap or else the nearest turn, coalesced.

    transcripts: keys, commit, text of the commit's own interval. A commit that
    owns no word gives its text as one final without a speaker; without
    transcripts it gives none.
    """
    merged = intervals.merge_turns(turns, keys, gap).withColumnRenamed("island", "turn_ord")
    owned = intervals.owned_words(words, commits, keys).drop("s_ms", "e_ms").withColumnsRenamed({"w_start": "s_ms", "w_end": "e_ms"})
    labelled = intervals.assign_speakers(owned, merged, keys, ["idx"])
    if names is not None:
        labelled = gallery.apply_names(labelled, names, keys)
    made = assemble.word_segments(labelled, [*keys, "commit"], ["s_ms", "idx"])
    if transcripts is None:
        return made
    spans = commits.select(*keys, "commit", F.col("c_start").alias("s_ms"), F.col("c_end").alias("e_ms"))
    return with_coarse(made, transcripts.select(*keys, "commit", "text").join(spans, [*keys, "commit"]), [*keys, "commit"])


def split_by_turn(asr: DataFrame, turns: DataFrame, keys: list[str], longest: int = 90_000, least: int = 700, gap: int = 150, most: int = 40) -> DataFrame:
    """Segments for slices of two or more speakers and no more than ``longest``: one per merged turn; else the ASR segments with speakers."""
    spans = turns.groupBy(*keys).agg(F.count_distinct("speaker").alias("n"), F.max("e_ms").alias("e"))
    split = spans.where((F.col("n") >= 2) & (F.col("e") <= longest)).select(*keys)
    merged = intervals.merge_turns_capped(turns.join(split, keys, "left_semi"), keys, least, gap, most).select(*keys, "s_ms", "e_ms", "speaker", F.lit("turn").alias("mode"))
    rest = intervals.assign_by_overlap(asr.join(split, keys, "left_anti"), turns, keys, ["idx"]).select(*keys, "s_ms", "e_ms", "speaker", F.lit("overlap").alias("mode"))
    return merged.unionByName(rest)


HEARD = "s_ms long, e_ms long, text string"


def score_crops(crops: DataFrame, keys: list[str], key_schema: str, transcribe: Callable) -> DataFrame:
    """Segments that transcribe(pcm) hears in each crop: keys, turn_ord, pos, s_ms, e_ms (within the crop), text.

    transcribe gives any number of (s_ms, e_ms, text); blank texts are left out.
    Crops are spread by turn, a few at a time in a task.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"{key_schema}, turn_ord long, pos long, {HEARD}"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # one crop's audio at a time
                own = {k: batch.column(k)[row].as_py() for k in (*keys, "turn_ord")}
                heard = [(int(s), int(e), t.strip()) for s, e, t in transcribe(batch.column("pcm")[row].as_py()) if t and t.strip()]
                yield pa.RecordBatch.from_pylist([{**own, "pos": i, "s_ms": s, "e_ms": e, "text": t} for i, (s, e, t) in enumerate(heard)], schema=kind)

    return crops.select(*keys, "turn_ord", "pcm").repartition(*keys, "turn_ord").mapInArrow(run, schema)


def transcribe_by_turn(
    asr: DataFrame, turns: DataFrame, keys: list[str], key_schema: str, chunks: DataFrame | None = None, transcribe: Callable | None = None, names: DataFrame | None = None,
    longest: int = 90_000, least: int = 700, gap: int = 150, most: int = 40, rate: int = 16_000, heard: DataFrame | None = None,
) -> DataFrame:
    """Segments with text and speaker: keys, turn_ord, pos, s_ms, e_ms, text, speaker, mode.

    A session of two or more speakers whose audio is no longer than ``longest``
    is split: short turns go, neighbours of one speaker merge, each turn's audio
    (chunks: keys, seq, pcm) goes to ``transcribe``, and what comes back is moved
    to the turn's start (mode turn). Sessions that are not split, and those whose
    crops all came back empty, keep their recognised segments (asr: keys, idx,
    text, s_ms, e_ms) under the speaker that overlaps each by a tenth or more
    (mode overlap; turn_ord is null). Speakers get their name, else the raw label.

    ``heard`` (keys, turn_ord, pos, s_ms, e_ms, text) stands for results that were
    scored before.
    """
    voices = turns.where(strip("speaker") != "").groupBy(*keys).agg(F.count_distinct("speaker").alias("_n"), F.max("e_ms").alias("_end"))
    if chunks is not None:
        length = F.expr(f"sum(octet_length(pcm) div {crops.WIDTH}) * 1000 div {rate}").alias("_audio")
        voices = voices.join(chunks.groupBy(*keys).agg(length), keys).withColumn("_end", F.col("_audio"))
    split = voices.where((F.col("_n") >= 2) & (F.col("_end") <= longest)).select(*keys)
    merged = intervals.merge_turns_capped(turns.join(split, keys, "left_semi"), keys, least, gap, most).withColumnRenamed("island", "turn_ord")
    merged = tables.stored(merged, "merged-turns")
    if heard is None:
        samples = lambda c: F.expr(f"{c} * {rate} div 1000")
        audio = crops.turn_audio(chunks, merged.withColumn("s", samples("s_ms")).withColumn("e", samples("e_ms")), keys)
        heard = tables.stored(score_crops(audio, keys, key_schema, transcribe), "heard")  # two readers, one run of the model
    base = merged.select(*keys, "turn_ord", "speaker", F.greatest(F.lit(0).cast("long"), F.col("s_ms")).alias("_base"))
    said = heard.where(strip("text") != "").join(base, [*keys, "turn_ord"])
    said = said.select(*keys, "turn_ord", "pos", (F.col("_base") + F.col("s_ms")).alias("s_ms"), (F.col("_base") + F.col("e_ms")).alias("e_ms"), strip("text").alias("text"), "speaker", F.lit("turn").alias("mode"))
    # the results decide the branch: no segment of a session, and its recognised ones stand
    rest = intervals.assign_by_overlap(asr.join(said.select(*keys).distinct(), keys, "left_anti"), turns, keys, ["idx"])
    rest = rest.select(*keys, F.lit(None).cast("long").alias("turn_ord"), F.col("idx").cast("long").alias("pos"), "s_ms", "e_ms", "text", "speaker", F.lit("overlap").alias("mode"))
    both = said.unionByName(rest)
    return gallery.apply_names(both, names, keys) if names is not None else both


def enrich_epochs(words: DataFrame, turns: DataFrame, keys: list[str], epochs: DataFrame | None = None) -> DataFrame:
    """Restored words (text carries its spacing) of each epoch with epoch-scoped speakers, coalesced without separators.

    epochs: keys, epoch, text, s_ms, e_ms on the words' clock. An epoch without
    restored words or turns, or with a segment of no length, gives its whole text
    as one final without a speaker; without epochs it stays as the words give it.
    """
    labelled = intervals.assign_speakers(words, turns, [*keys, "epoch"], ["idx"], coverage=None)
    labelled = labelled.withColumn("speaker", F.when(F.col("speaker") != "", formats.epoch_label(F.col("epoch"), F.col("speaker"))).otherwise(""))
    made = assemble.word_segments(labelled, [*keys, "epoch"], ["idx"], separator="raw")
    if epochs is None:
        return made
    failed = made.where((F.col("speaker") == "") | (F.col("e_ms") <= F.col("s_ms"))).select(*keys, "epoch").distinct()
    return with_coarse(made.join(failed, [*keys, "epoch"], "left_anti"), epochs, [*keys, "epoch"])


def enrich_transcripts(epochs: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """Finals of epochs from their transcripts and aligned words: the words' spacing is restored, then ``enrich_epochs``.

    epochs: keys, epoch, text, s_ms, e_ms, words (array of start_s, end_s, text
    within the epoch). Where the words cannot be restored, the epoch's whole text
    is one final without a speaker.
    """
    own = [*keys, "epoch", "s_ms"]  # the epoch's start rides along, so words need no join to be moved
    crops = epochs.select(*own, F.col("text").alias("transcript"), ((F.col("e_ms") - F.col("s_ms")) / 1000).alias("duration_s"), "words")
    restored = ordered.restore_text(crops.where("transcript IS NOT NULL AND words IS NOT NULL"), own).where("reason IS NULL")
    moved = lambda c: (F.col("s_ms") + F.rint(F.col(c) * 1000)).cast("long")
    words = restored.select(*keys, "epoch", "idx", F.col("text").alias("word"), moved("start_s").alias("s_ms"), moved("end_s").alias("e_ms"))
    return enrich_epochs(words, turns, keys, epochs.select(*keys, "epoch", "text", "s_ms", "e_ms"))


def build_gallery(manifests: DataFrame, sample_embeddings: DataFrame, strict_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The gallery and the rejected manifests. sample_embeddings: url, embedding."""
    reason = validate.manifest_reason(manifests)
    if strict_root:
        reason = F.coalesce(reason, validate.strict_manifest_reason(F.col("folder"), strict_root, F.col("tenant_id")))
    judged = manifests.withColumn("reason", reason)
    samples = wav.sample_rows(judged.where("reason IS NULL")).where("reason IS NULL").join(sample_embeddings, "url")
    made = gallery.strict_gallery(samples) if strict_root else gallery.gallery(samples, speaker="speaker_id")
    return made, judged.where("reason IS NOT NULL")


def ingest_uploads(events: DataFrame, files: DataFrame, bucket: str, created_at) -> tuple[DataFrame, DataFrame]:
    """Recordings from uploaded files, and failure events. files: path (as in recording_url), length, content."""
    judged = events.withColumn("_why", validate.upload_reason(F.col("session_id"), F.col("tenant_id"), F.col("recording_url"), bucket))
    there = files.select(F.col("path").alias("recording_url"), F.col("length").alias("n_bytes"), "content")
    found = judged.join(there, "recording_url", "left").withColumn("_why", F.coalesce("_why", validate.upload_bounds(F.col("n_bytes"))))
    audio = wav.normalise_audio(found.where("_why IS NULL").select(F.col("recording_url").alias("path"), "content"))
    done = judged.where("_why IS NULL").join(audio.withColumnRenamed("path", "recording_url"), "recording_url")
    failed = found.where("_why IS NOT NULL").select("session_id", "tenant_id", F.col("_why").alias("reason")).unionByName(done.where("reason IS NOT NULL").select("session_id", "tenant_id", "reason"))
    return done.where("reason IS NULL").select(*KEYS, "recording_url", "n_samples", (F.col("n_samples") / 16000).alias("duration_s"), "pcm16"), sinks.failure_events(failed, created_at)


def offline_crops(turns: DataFrame, keys: list[str], longest: int = 30_000, hypotheses: DataFrame | None = None) -> DataFrame:
    """Crops of at most ``longest``, each part of the audio in one of them; with hypotheses the segments of these crops.

    hypotheses: keys, turn_ord, crop_s, text, words (array of start_s, end_s,
    text within the crop; null where nothing was aligned). Segments of crops with
    a text carry its words restored and moved to the recording's clock, or null
    where they cannot be restored.
    """
    crops = intervals.exclusive_crops(turns, keys, longest)
    if hypotheses is None:
        return crops
    own = [*keys, "turn_ord", "crop_s"]
    said = crops.join(hypotheses.withColumn("text", strip("text")).where("text <> ''"), own).withColumn("duration_s", (F.col("crop_e") - F.col("crop_s")) / 1000)
    restored = ordered.restore_text(said.where("words IS NOT NULL").withColumnRenamed("text", "transcript"), own).where("reason IS NULL")
    listed = restored.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("idx", "start_s", "end_s", "text"))).alias("words"))
    base, last = F.col("crop_s") / 1000, F.col("crop_e") / 1000
    moved = F.transform("words", lambda w: F.struct((base + w["start_s"]).alias("start_s"), F.least(last, base + w["end_s"]).alias("end_s"), w["text"].alias("text")))
    return said.drop("words").join(listed, own, "left").select(*keys, "turn_ord", "speaker", F.col("crop_s").alias("s_ms"), F.col("crop_e").alias("e_ms"), "text", moved.alias("words"))
