"""Rolling captions as a stream: each line once per window, with state per document that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from termloom.functions.text import clean_markup, collapse
from termloom.schemas import CUE_WINDOW_SECONDS

OUTPUT = "doc_id string, cue_no int, ts string, text string"
STATE = "lines array<string>, seen array<double>"


def rolling_stream(cues: DataFrame, seconds: float = CUE_WINDOW_SECONDS, arrived: str | None = None, late: str = "10 minutes", idle_seconds: int = 3600) -> DataFrame:
    """The streaming form of ``captions.rolling_lines`` over ``doc_id, cue_no, start, end, lines``.

    State is what each document has shown in the last ``seconds`` of its own time. It goes when a document has been
    silent for ``idle_seconds``: by the timestamps of the column ``arrived``, whose watermark trails by ``late``, else
    by the clock. Cues of one document must arrive in order; with ``arrived``, a cue older than the watermark is
    dropped; without, it is compared with what is known then. A cue after its document's state has gone begins anew.
    """
    clean = cues.withColumn("lines", F.filter(F.transform("lines", lambda x: collapse(clean_markup(x))), lambda x: x != ""))
    if arrived:
        clean = clean.withWatermark(arrived, late)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame([], columns=["doc_id", "cue_no", "ts", "text"])
        if state.hasTimedOut:
            state.remove()
            yield none
            return
        shown = dict(zip(*state.get, strict=True)) if state.exists else {}
        out, last = [], 0
        for frame in frames:
            if arrived:
                last = max(last, int(frame[arrived].max().timestamp() * 1000))
            for cue in frame.sort_values("cue_no").itertuples():
                shown = {line: at for line, at in shown.items() if cue.start - at <= seconds}
                before = set(shown)
                whole = int(cue.end)
                for line in cue.lines:
                    if line not in before:
                        out.append((key[0], cue.cue_no, f"{whole // 60}:{whole % 60:02d}", line))
                    shown[line] = cue.start
        if shown:
            state.update((list(shown), list(shown.values())))
            if arrived:
                state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_seconds * 1000)
            else:
                state.setTimeoutDuration(idle_seconds * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=none.columns) if out else none

    timeout = GroupStateTimeout.EventTimeTimeout if arrived else GroupStateTimeout.ProcessingTimeTimeout
    return clean.groupBy("doc_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", timeout)
