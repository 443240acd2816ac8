"""Keyframes of frame streams: the state of a session is its anchor and its best frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "session long, frame_id long, blur double"
_STATE = "anchor array<double>, best long, blur double"


def keyframes(frames: DataFrame, least: float = 0.01, idle: float | None = None) -> DataFrame:
    """The sharpest frame of each run, once the run has ended.

    frames is a stream of (session long, frame_id long, blur double, signature
    array<double>) whose micro-batches come in order of time; within one, frames are taken
    by frame_id. A run goes on while the mean difference of signatures from its first
    frame's stays below least; equally sharp frames go to the first. A row without a
    frame_id ends its session after the frames of its micro-batch: the last run is given
    out, and what follows begins anew. A session that gets no frame for idle seconds of the
    cluster's clock ends likewise, if idle is given; else it is kept until its end mark.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, best, blur = state.get if state.exists else (None, None, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], best, blur)], columns=["session", "frame_id", "blur"])
            return
        done, ended, held = [], False, []
        for batch in batches:
            ended |= bool(batch["frame_id"].isna().any())
            held.append(batch[batch["frame_id"].notna()])
        for f in pd.concat(held).sort_values("frame_id").itertuples():
            signature = np.asarray(f.signature, dtype=float)
            if anchor is None or np.abs(signature - np.asarray(anchor)).mean() >= least:
                if anchor is not None:
                    done.append((key[0], best, blur))
                anchor, best, blur = signature, int(f.frame_id), f.blur
            elif f.blur > blur:
                best, blur = int(f.frame_id), f.blur
        if ended:
            if anchor is not None:
                done.append((key[0], best, blur))
            if state.exists:
                state.remove()
        elif anchor is not None:
            state.update(([float(x) for x in anchor], int(best), float(blur)))
            if idle is not None:
                state.setTimeoutDuration(max(1, int(idle * 1000)))
        yield pd.DataFrame(done, columns=["session", "frame_id", "blur"])

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return frames.groupBy("session").applyInPandasWithState(run, _OUT, _STATE, "append", timeout)
