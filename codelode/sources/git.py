"""Commits and changed paths of a local Git repository, newest first."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

COMMITS = "commit_id string, scan_pos long, committed_at timestamp, author_name string, author_email string, message string"


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True, errors="replace").stdout


def read_history(spark: SparkSession, root: str, most: int = 100_000) -> tuple[DataFrame, DataFrame, list[str]]:
    """commits, commit_files (commit_id, path) and limitations of HEAD's history, changes against the first parent, renames under their new path. Of more than most commits the newest are read, and HISTORY_TRUNCATED says so."""
    import datetime

    raw = _git(root, "log", f"-{most + 1}", "-z", "-M", "--first-parent", "--root", "-m", "--name-status", "--format=%x01%H%x02%ct%x02%an%x02%ae%x02%s%x02")
    commits, files = [], []
    blocks = raw.split("\x01")[1:]
    for pos, block in enumerate(blocks[:most]):
        sha, when, name, mail, subject, rest = block.split("\x02", 5)
        commits.append((sha, pos, datetime.datetime.fromtimestamp(int(when), datetime.UTC), name, mail or None, subject))
        cells = [c for c in rest.replace("\n", "").split("\0") if c]
        k = 0
        while k < len(cells):
            renamed = cells[k][0] in "RC"
            files.append((sha, cells[k + 2] if renamed else cells[k + 1]))
            k += 3 if renamed else 2
    return spark.createDataFrame(commits, COMMITS), spark.createDataFrame(sorted(set(files)), "commit_id string, path string"), ["HISTORY_TRUNCATED"] if len(blocks) > most else []


def repository_facts(root: str) -> dict:
    """Branch, head, whether it is detached, shallow and clean, and the origin as it is configured."""
    ask = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True).stdout.strip() or None
    branch = ask("symbolic-ref", "--short", "-q", "HEAD")
    return {"head": ask("rev-parse", "HEAD"), "branch": branch, "detached": branch is None, "shallow": ask("rev-parse", "--is-shallow-repository") == "true", "clean": ask("status", "--porcelain") is None, "origin": ask("config", "--get", "remote.origin.url")}
