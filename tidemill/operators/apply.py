"""Carrying out a reclaim plan on a local file system. A dry run unless told otherwise.

Both files are compared again, byte for byte, at the moment of acting; similar
files are never acted on. One failure does not stop the rest.
"""

from __future__ import annotations

import filecmp
import os
import shutil
import uuid

from pyspark.sql import DataFrame


def link(keeper: str, victim: str) -> None:
    """Replace the victim by a hard link to the keeper, in one step."""
    temp = os.path.join(os.path.dirname(victim), f".{os.path.basename(victim)}.tidemill-link-{uuid.uuid4().int % 10**9}")
    os.link(keeper, temp)
    try:
        os.replace(temp, victim)
    except OSError:
        os.remove(temp)
        raise


def unique(dest: str) -> str:
    stem, ext = os.path.splitext(dest)
    n = 2
    while os.path.exists(dest):
        dest, n = f"{stem} ({n}){ext}", n + 1
    return dest


def quarantine(victim: str, dest: str) -> str:
    """Move; across file systems copy, compare, then delete."""
    dest = unique(dest)
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    try:
        os.rename(victim, dest)
    except OSError:
        shutil.copy2(victim, dest)
        if not filecmp.cmp(victim, dest, shallow=False):
            os.remove(dest)
            raise OSError("the copy differs") from None
        os.remove(victim)
    return dest


def apply(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """victim, action, status, bytes of each action, in order of victim, streamed to the driver."""
    spark, out = plan.sparkSession, []
    for r in plan.select("keeper", "victim", "action", "bytes", "dest").orderBy("victim").toLocalIterator():
        try:
            if not filecmp.cmp(r["keeper"], r["victim"], shallow=False):
                status = "content differs now"
            elif dry_run:
                status = "would be done"
            elif r["action"] == "link":
                link(r["keeper"], r["victim"])
                status = "done"
            else:
                quarantine(r["victim"], r["dest"])
                status = "done"
        except OSError as e:
            status = f"failed: {e.strerror or e}"
        out.append((r["victim"], r["action"], status, r["bytes"] if status == "done" else 0))
    return spark.createDataFrame(out, "victim string, action string, status string, bytes long")
