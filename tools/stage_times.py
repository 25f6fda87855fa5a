"""Slowest stages from a Spark event log (no UI needed).

usage: python tools/stage_times.py EVENT_LOG_FILE_OR_DIR [top_n]
"""

from __future__ import annotations

import json
import os
import sys


def _lines(path: str):
    """An event log file, or a rolling event-log directory (events_1_..., events_2_...)."""
    files = [path]
    if os.path.isdir(path):
        files = sorted(
            (os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_")),
            key=lambda f: int(os.path.basename(f).split("_")[1]),
        )
    for fp in files:
        if fp.endswith(".zstd"):  # Spark 4 compresses event logs with zstd by default
            import io

            import zstandard

            with open(fp, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(fp) as f:
                yield from f


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages, jobs = {}, {}
    if True:
        for line in _lines(path):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerStageCompleted":
                info = e["Stage Info"]
                start, end = info.get("Submission Time"), info.get("Completion Time")
                if start and end:
                    stages[(info["Stage ID"], info["Stage Attempt ID"])] = (
                        end - start, info["Number of Tasks"], info["Stage Name"][:80]
                    )
            elif ev == "SparkListenerJobStart":
                jobs[e["Job ID"]] = e.get("Submission Time")
    total = sum(d for d, _, _ in stages.values())
    print(f"{len(jobs)} jobs, {len(stages)} stages, {total / 1000:.1f} s of stage time")
    for (sid, att), (d, n, name) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:top]:
        print(f"stage {sid}.{att}: {d / 1000:7.2f} s  {n:5d} tasks  {name}")


if __name__ == "__main__":
    main()
