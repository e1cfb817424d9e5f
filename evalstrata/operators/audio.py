"""Audio: decoding, windows, energy levels, silence-aware boundaries, and merging of transcripts.

Audio columns are 16 kHz mono signed 16-bit little-endian samples.
"""

from __future__ import annotations

import io
import shutil
import subprocess
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AudioError, ConfigError
from ..functions.text import normalize_text, NormalizeConfig

#: Sample rate, bytes of a sample, and the longest window of the models in seconds.
RATE, SAMPLE_BYTES, LIMIT_S = 16_000, 2, 30.0
WINDOW_S, OVERLAP_S, SEARCH_S, FRAME_MS, SILENCE_DB, FLOOR_DB = 28.0, 2.0, 2.0, 20.0, -40.0, -120.0
#: Words that must and may match where transcripts meet.
LEAST_OVERLAP, MOST_OVERLAP = 2, 15


def decode(content: bytes, timeout: float = 120.0) -> bytes:
    """Samples of an audio file: WAV of the right form directly, others through ffmpeg if it is there."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            if (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (RATE, 1, 2):
                return w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        pass
    tool = shutil.which("ffmpeg")
    if not tool:
        raise AudioError("Only 16 kHz mono 16-bit WAV is read without ffmpeg.", "Install ffmpeg.")
    try:
        done = subprocess.run([tool, "-v", "error", "-i", "-", "-f", "s16le", "-ac", "1", "-ar", str(RATE), "-"], input=content, capture_output=True, timeout=timeout)
    except subprocess.TimeoutExpired:
        raise AudioError(f"ffmpeg took more than {timeout:g} s.") from None
    if done.returncode or not done.stdout:
        raise AudioError("ffmpeg can't read it: " + done.stderr.decode("utf-8", "replace")[-200:])
    return done.stdout


def to_wav(pcm: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, SAMPLE_BYTES, RATE, 0, "NONE", ""))
        w.writeframes(pcm)
    return out.getvalue()


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, pcm, error) of the audio files below a path."""

    def run(batches):
        for rows in batches:
            pcm, errors = [], []
            for content in rows["content"]:
                try:
                    pcm.append(decode(bytes(content)))
                    errors.append(None)
                except AudioError as e:
                    pcm.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"path": rows["path"], "pcm": pcm, "error": errors})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, pcm binary, error string")


def seconds(pcm: Column) -> Column:
    return F.octet_length(pcm) / float(RATE * SAMPLE_BYTES)


def check_window(window_s: float, overlap_s: float) -> None:
    if not 0 < window_s <= LIMIT_S:
        raise ConfigError(f"window_s must be in (0, {LIMIT_S:g}], not {window_s:g}.", "The models take 30 seconds at most.")
    if not 0 <= overlap_s < window_s:
        raise ConfigError("overlap_s must be at least 0 and below window_s.")


def windows(n: Column, rate: int = RATE, window_s: float = WINDOW_S, overlap_s: float = OVERLAP_S) -> Column:
    """array<struct<start, end>> of sample ranges that cover n samples, the last ending with them."""
    check_window(window_s, overlap_s)
    size, step = round(window_s * rate), round((window_s - overlap_s) * rate)
    more = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), more), lambda k: F.struct((k * step).alias("start"), F.least(k * step + size, n.cast("long")).alias("end")))


def levels(pcm: bytes, rate: int = RATE, frame_ms: float = FRAME_MS) -> np.ndarray:
    """RMS level of each whole frame in dB of full scale, silence at the floor."""
    if frame_ms <= 0:
        raise ConfigError("frame_ms must be above 0.")
    frame = max(1, round(frame_ms * rate / 1000))
    x = np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2").astype(np.float64) / 32768
    n = len(x) // frame
    if not n:
        return np.empty(0, np.float32)
    rms = np.sqrt((x[: n * frame].reshape(n, frame) ** 2).mean(axis=1))
    return np.maximum(20 * np.log10(np.maximum(rms, 1e-6)), FLOOR_DB).astype(np.float32)


def plain_windows(n: int, rate: int, window_s: float, overlap_s: float) -> list[tuple[int, int]]:
    check_window(window_s, overlap_s)
    size, step = round(window_s * rate), round((window_s - overlap_s) * rate)
    count = 1 + max(0, -(-(n - size) // step))
    return [(k * step, min(k * step + size, n)) for k in range(count)]


def quiet_windows(pcm: bytes, rate: int = RATE, window_s: float = WINDOW_S, overlap_s: float = OVERLAP_S, search_s: float = SEARCH_S, frame_ms: float = FRAME_MS, silence_db: float = SILENCE_DB) -> list[tuple[int, int]]:
    """Windows whose ends move to the middle of the quietest frame in reach, if that is silent; no window
    exceeds the models' limit. Each end depends on the one before it."""
    if search_s < 0:
        raise ConfigError("search_s must be at least 0.")
    n = len(pcm) // SAMPLE_BYTES
    grid = plain_windows(n, rate, window_s, overlap_s)
    reach = min(round(search_s * rate), max(0, round((LIMIT_S - window_s) * rate)))
    loud = levels(pcm, rate, frame_ms)
    if len(grid) < 2 or not reach or not len(loud):
        return grid
    overlap, limit, frame = round(overlap_s * rate), round(LIMIT_S * rate), max(1, round(frame_ms * rate / 1000))
    ends: list[int] = []
    for _, target in grid[:-1]:
        low = max(target - reach, (ends[-1] if ends else 0) + 1)
        high = min(target + reach, ends[-1] + limit - overlap if ends else limit)
        first, last = -(-low // frame), min(high // frame, len(loud) - 1)
        chosen = target
        if low <= high and first <= last:
            near = loud[first : last + 1]
            if near.min() <= silence_db:
                middles = (first + np.flatnonzero(near == near.min())) * frame + frame // 2
                chosen = int(np.clip(middles[np.abs(middles - target).argmin()], low, high))
        ends.append(chosen)
    starts = [0, *(e - overlap for e in ends)]
    return list(zip(starts, [*ends, n], strict=True))


def quiet_windows_column(pcm: Column, **settings: float) -> Column:
    @F.pandas_udf("array<struct<start:long,end:long>>")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda b: [{"start": s, "end": e} for s, e in quiet_windows(bytes(b), **settings)])

    return f(pcm)


def levels_column(pcm: Column) -> Column:
    @F.pandas_udf("array<float>")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda b: levels(bytes(b)))

    return f(pcm)


def window_rows(audio: DataFrame, key: str = "path", silence_aware: bool = False, **settings: float) -> DataFrame:
    """A row for each window of each clip: (key, window, start_s, end_s, pcm)."""
    cut = quiet_windows_column(F.col("pcm"), **settings) if silence_aware else windows((F.octet_length("pcm") / SAMPLE_BYTES).cast("long"), **settings)
    rows = audio.select(key, "pcm", F.posexplode(cut).alias("window", "at"))
    part = F.substring(F.col("pcm"), (F.col("at.start") * SAMPLE_BYTES + 1).cast("int"), ((F.col("at.end") - F.col("at.start")) * SAMPLE_BYTES).cast("int"))
    return rows.select(key, "window", (F.col("at.start") / float(RATE)).alias("start_s"), (F.col("at.end") / float(RATE)).alias("end_s"), part.alias("pcm"))


def merge(parts: list[str]) -> str:
    """Transcripts joined without the words that repeat where they meet: at least two in a row, whatever
    their case, punctuation and tone marks."""
    key = lambda w: normalize_text(w, NormalizeConfig(tones="strip"))
    out: list[str] = []
    for part in parts:
        own = part.split()
        most = min(len(out), len(own), MOST_OVERLAP)
        left, right = [key(w) for w in out[len(out) - most :]], [key(w) for w in own[:most]]
        same = next((k for k in range(most, LEAST_OVERLAP - 1, -1) if left[most - k :] == right[:k]), 0)
        out += own[same:]
    return " ".join(out)


def merged_transcripts(parts: DataFrame, key: str = "path") -> DataFrame:
    """Windows' texts (key, window, text, latency_ms) in order as one text for each key, latencies summed."""
    @F.pandas_udf("string")
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda ts: merge([t or "" for t in ts]))

    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("window", "text"))).alias("w"), F.sum("latency_ms").alias("latency_ms"))
    return rows.select(key, f(F.transform("w", lambda s: s["text"])).alias("text"), "latency_ms")
