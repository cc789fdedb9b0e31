"""Frame sampling as an ordered fold, cut into segments whose summaries compose.

Whether a frame is kept depends on the last processed frame and on windows that
earlier frames opened, so the walk over a video is sequential.  Videos are cut
into segments of frame numbers.

1. What came before reaches a segment through few states: the last processed
   frame, if the first frame here is not due anyway, or the ends of the open
   windows.  All of them come from the frames of a bounded reach before the
   segment, so one task walks the segment from every possible state at once.
   The walks meet soon (a forced frame, a closed window), and then go on as one.
   The summary maps each entry state to the exit state.
2. The summaries of a video are composed in order; each is a small map.
3. Every segment is walked once more from its true entry state, with the gray
   array of the last processed frame fetched by its number.

That is two passes over the rows whatever the length of a video, one for a video
inside one segment; no task holds more than a segment and its reach.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import lit
from ..session import durable
from .sampling import noise_keep
from .windows import SEGMENT


@dataclass(frozen=True)
class SampleConfig:
    interval: int = R.FRAME_INTERVAL
    step: int = R.DENSE_STEP
    diff_threshold: float = R.DIFF_THRESHOLD
    force_every: int = R.FORCE_EVERY
    dense_after: dict = field(default_factory=lambda: dict(R.DENSE_AFTER))
    blur_min: float = R.BLUR_MIN
    exposure_max: float = R.EXPOSURE_MAX
    exposure_extra: float = R.EXPOSURE_DENSE_EXTRA

    @property
    def reach(self) -> int:
        """Frames further back than this neither hold a window open nor keep a frame from being due."""
        return max(self.force_every, *self.dense_after.values())


INPUT = ["frame_idx", "gray", "blurred", "exposure", "noisy", "open_len", "relaxed_len"]
INPUT_SCHEMA = pa.schema(list(zip(INPUT, [pa.int64(), pa.list_(pa.float32()), pa.bool_(), pa.float64(), pa.bool_(), pa.int32(), pa.int32()])))
STATE = "last_idx bigint, last_gray array<float>, open_until bigint, relaxed_until bigint"
OUTPUT = "frame_idx bigint, outcome string, diff double"
# last processed frame, its gray array, end of any window, end of the windows that relax the exposure limit
EMPTY = (None, None, -1, -1)


def fold_input(df: DataFrame, cfg: SampleConfig) -> DataFrame:
    """Columns of the walk; everything that needs no state is decided here, in the JVM."""
    length = lambda c: f"CASE WHEN category = {lit(c)} THEN {cfg.dense_after[c]} ELSE 0 END"
    shell = f"CASE WHEN category = 'Help' OR (help_shell AND help_quality_score >= 3.0D) THEN {cfg.dense_after['Help']} ELSE 0 END"
    relaxed = f"greatest({length('Transition')}, {length('Feature game')})"
    return df.where(f"frame_idx % {cfg.interval} = 0 OR frame_idx % {cfg.step} = 0").selectExpr(
        "video_id", "frame_idx", "transform(gray, g -> CAST(g AS FLOAT)) AS gray", f"coalesce(blur_score < {cfg.blur_min}D, false) AS blurred",
        "coalesce(exposure_score, 0.0D) AS exposure", f"coalesce(NOT ({noise_keep()}), false) AS noisy",
        f"CAST(greatest({shell}, {relaxed}) AS INT) AS open_len", f"CAST({relaxed} AS INT) AS relaxed_len")


class Frames:
    """A stretch of frames of one video in order."""

    def __init__(self, table: pa.Table | pa.RecordBatch, entry_gray: np.ndarray | None = None):
        column = lambda c: table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(c)
        frame = column("frame_idx").to_numpy(zero_copy_only=False)
        order = np.argsort(frame, kind="stable")
        take = lambda c: column(c).to_numpy(zero_copy_only=False)[order]
        self.frame, self.blurred, self.exposure, self.noisy = frame[order], take("blurred"), take("exposure"), take("noisy")
        self.open_end, self.relaxed_end = (np.where(take(c) > 0, self.frame + take(c), -1) for c in ("open_len", "relaxed_len"))
        gray = column("gray").take(pa.array(order))
        sizes = np.asarray(gray.value_lengths().fill_null(0))
        values = gray.flatten().cast(pa.float64()).fill_null(0.0).to_numpy()
        self.gray = np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []
        if entry_gray is not None:  # reached as frame -1
            self.gray.append(entry_gray)
        n, even = len(self.frame), len(sizes) > 1 and sizes[0] > 0 and (sizes == sizes[0]).all()
        if even:
            grid = values.reshape(n, sizes[0])
            self.near = [0.0, *np.abs(grid[1:] - grid[:-1]).mean(axis=1).tolist()]
        else:
            self.near = [0.0, *(self._diff(i - 1, i) for i in range(1, n))]

    def _diff(self, i: int, j: int) -> float:
        a, b = self.gray[i], self.gray[j]
        return float(np.abs(a - b).mean()) if len(a) == len(b) and len(a) else 0.0

    def diff(self, i: int, j: int) -> float:
        """Mean absolute difference of two frames; most often the frame before, which is at hand."""
        return self.near[j] if i == j - 1 and i >= 0 else self._diff(i, j)

    def walk(self, cfg: SampleConfig, last_idx: int | None, last: int | None, open_until: int, relaxed_until: int, begin: int = 0):
        """Outcome and difference of each frame from ``begin`` on, and the state after the last one.

        ``last`` is the place of the last processed frame here, None where its gray array is not known.
        """
        outcomes, diffs = [], []
        columns = zip(range(begin, len(self.frame)), *(x[begin:].tolist() for x in (self.frame, self.blurred, self.exposure, self.noisy, self.open_end, self.relaxed_end)))
        for i, f, blurred, exposure, noisy, open_end, relaxed_end in columns:
            dense = f <= open_until
            if f % cfg.interval and not dense:
                outcomes.append("stride")
                diffs.append(0.0)
                continue
            diff = 0.0 if last is None else self.diff(last, i)
            diffs.append(diff)
            if last_idx is not None and diff < cfg.diff_threshold and not dense and f - last_idx < cfg.force_every:
                outcomes.append("unchanged")
                continue
            last_idx, last = f, i
            if blurred:
                outcomes.append("blurred")
            elif exposure >= cfg.exposure_max + (cfg.exposure_extra if f <= relaxed_until else 0.0):
                outcomes.append("overexposed")
            else:
                outcomes.append("noisy" if noisy else "kept")
                open_until, relaxed_until = max(open_until, open_end), max(relaxed_until, relaxed_end)
        return outcomes, diffs, (last_idx, last, open_until, relaxed_until)

    def exits(self, cfg: SampleConfig, begin: int) -> tuple[list[tuple], list[tuple]]:
        """Every state in which frame ``begin`` can be entered, and the state after the last frame for each.

        The frames before ``begin`` are the reach.  A state is (last processed
        frame or None: the first frame in turn is processed, ends of the windows).
        """
        first = int(self.frame[begin])
        opened = np.unique(np.concatenate([self.open_end[:begin], self.relaxed_end[:begin]]))
        relaxed = np.unique(self.relaxed_end[:begin])
        entries = [(None, -1, -1), *((int(f), -1, -1) for f in self.frame[:begin] if first - f < cfg.force_every)]
        for d in opened[opened >= first].tolist():
            entries += [(None, d, -1), *((None, d, e) for e in relaxed[(relaxed >= first) & (relaxed <= d)].tolist())]
        places = {int(f): i for i, f in enumerate(self.frame[:begin].tolist())}
        states = np.array([(-1 if r is None else places[r], d, e) for r, d, e in entries], np.int64)
        of = np.arange(len(states))
        i = begin
        while i < len(self.frame) and len(states) > 1:
            f = int(self.frame[i])
            last, opened, relaxed = states.T
            dense = f <= opened
            turn = dense | (f % cfg.interval == 0)
            due = dense | (last < 0) | (f - self.frame[last] >= cfg.force_every)
            for r in np.unique(last[turn & ~due]).tolist():
                if self.diff(r, i) >= cfg.diff_threshold:
                    due |= last == r
            done = turn & due
            fine = done & ~self.blurred[i] & ~(self.exposure[i] >= cfg.exposure_max + np.where(f <= relaxed, cfg.exposure_extra, 0.0))
            opened = np.where(fine, np.maximum(opened, self.open_end[i]), opened)
            relaxed = np.where(fine, np.maximum(relaxed, self.relaxed_end[i]), relaxed)
            # a window that has closed makes no difference any more
            states = np.stack([np.where(done, i, last), np.where(opened > f, opened, -1), np.where(relaxed > f, relaxed, -1)], axis=1)
            states, back = np.unique(states, axis=0, return_inverse=True)
            of = back.reshape(-1)[of]
            i += 1
        ends = []
        for last, opened, relaxed in states.tolist():
            *_, (idx, _, opened, relaxed) = self.walk(cfg, None if last < 0 else int(self.frame[last]), None if last < 0 else last, opened, relaxed, i)
            ends.append((idx, opened, relaxed))
        return entries, [ends[k] for k in of.tolist()]


def entry_of(state: tuple, first: int, cfg: SampleConfig) -> tuple:
    """The entry state of a segment that starts with frame ``first`` as its summary lists it."""
    last, opened, relaxed = state
    if opened >= first:
        return None, opened, relaxed if relaxed >= first else -1
    return (last if last is not None and first - last < cfg.force_every else None), -1, -1


_SUMMARY = "video_id bigint, seg bigint, nxt bigint, first bigint, " + ", ".join(f"{c} array<bigint>" for c in ("last", "opened", "relaxed", "to_last", "to_opened", "to_relaxed"))
_ENTRY = "video_id bigint, seg bigint, last_idx bigint, open_until bigint, relaxed_until bigint"


def _summaries(rows: DataFrame, followed: DataFrame, cfg: SampleConfig, width: int) -> DataFrame:
    """The map from entry to exit states of every segment that another one follows."""
    def summary(key, table):
        video, seg, nxt = (k.as_py() for k in key)
        frames = Frames(table)
        begin = int(np.searchsorted(frames.frame, seg * width))
        if begin == len(frames.frame):
            return pa.table({}, schema=schema)
        entries, exits = frames.exits(cfg, begin)
        lists = [[list(c)] for c in (*zip(*entries), *zip(*exits))]
        return pa.table([[video], [seg], [nxt], [int(frames.frame[begin])], *lists], schema=schema)

    names = [c.split() for c in _SUMMARY.split(", ")]
    schema = pa.schema([(n, pa.list_(pa.int64()) if k.startswith("array") else pa.int64()) for n, k in names])
    reached = rows.selectExpr(*[c for c in rows.columns if c != "seg"], f"explode(sequence(seg, CAST(floor((frame_idx + {cfg.reach}) / {width}) AS BIGINT))) AS seg")
    return reached.join(followed, ["video_id", "seg"]).groupBy("video_id", "seg", "nxt").applyInArrow(summary, _SUMMARY)


def _composed(summaries: DataFrame, cfg: SampleConfig) -> DataFrame:
    """The true entry state of every segment but the first of its video."""
    def run(batches):
        video, state = None, None
        for b in batches:
            out = []
            for v, _, nxt, first, last, opened, relaxed, *to in zip(*(c.to_pylist() for c in b.columns)):
                if v != video or state is None:
                    video, state = v, (None, -1, -1)
                k = list(zip(last, opened, relaxed)).index(entry_of(state, first, cfg))
                idx, opened, relaxed = (t[k] for t in to)
                state = (state[0] if idx is None else idx, opened, relaxed)
                out.append((v, nxt, *state))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], [c.split()[0] for c in _ENTRY.split(", ")])

    return summaries.repartition("video_id").sortWithinPartitions("video_id", "seg").mapInArrow(run, _ENTRY)


def sample_frames(df: DataFrame, cfg: SampleConfig = SampleConfig(), width: int = SEGMENT) -> DataFrame:
    """Outcome of every candidate frame: kept, stride, unchanged, blurred, overexposed or noisy.

    ``df`` has video_id, frame_idx, gray, category, help_shell and the score
    columns of the filters.
    """
    keys = ["video_id", "seg"]
    rows = durable(fold_input(df, cfg).selectExpr("*", f"CAST(floor(frame_idx / {width}) AS BIGINT) AS seg"))
    followed = durable(rows.select(*keys).distinct().selectExpr(*keys, "lead(seg) OVER (PARTITION BY video_id ORDER BY seg) AS nxt").where("nxt IS NOT NULL"))
    schema = pa.schema([("video_id", pa.int64()), ("frame_idx", pa.int64()), ("outcome", pa.string()), ("diff", pa.float64())])

    def walked(key, table, entry=None):
        last_idx, gray, opened, relaxed = EMPTY
        if entry is not None and entry.num_rows:
            last_idx, gray, opened, relaxed = (entry.column(c)[0].as_py() for c in ("last_idx", "last_gray", "open_until", "relaxed_until"))
        frames = Frames(table, None if last_idx is None else np.array(gray or [], np.float64))
        outcomes, diffs, _ = frames.walk(cfg, last_idx, None if last_idx is None else -1, opened, relaxed)
        return pa.table([pa.array(np.full(len(diffs), key[0].as_py())), frames.frame, outcomes, diffs], schema=schema)

    out = f"video_id bigint, {OUTPUT}"
    if followed.isEmpty():
        return rows.groupBy(*keys).applyInArrow(lambda key, table: walked(key, table), out)
    entries = durable(_composed(_summaries(rows, followed, cfg, width), cfg))
    seen = rows.selectExpr("video_id", "frame_idx AS last_idx", "gray AS last_gray").join(entries.where("last_idx IS NOT NULL"), ["video_id", "last_idx"])
    unseen = entries.where("last_idx IS NULL").selectExpr("*", "CAST(NULL AS array<float>) AS last_gray")
    states = seen.unionByName(unseen).withColumnsRenamed({"video_id": "of_video", "seg": "of_seg"})
    return rows.groupBy(*keys).cogroup(states.groupBy("of_video", "of_seg")).applyInArrow(walked, out)


def change_filter(df: DataFrame, threshold: float = R.DIFF_THRESHOLD, force_every: int = R.FORCE_EVERY, width: int = SEGMENT) -> DataFrame:
    """Frames that differ enough from the last processed one, or are due; no other filter."""
    plain = df.selectExpr("video_id", "frame_idx", "gray", "'Result' AS category", "1e9D AS blur_score", "0.0D AS exposure_score", "0.0D AS noise_score",
                          "0.0D AS feature_ui_score", "0.0D AS feature_active_score", "0.0D AS basegame_ui_score", "false AS help_shell", "0.0D AS help_quality_score")
    cfg = SampleConfig(interval=1, step=1, diff_threshold=threshold, force_every=force_every)
    return sample_frames(plain, cfg, width).where("outcome = 'kept'").select("video_id", "frame_idx", "diff")
