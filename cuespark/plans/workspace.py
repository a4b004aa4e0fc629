"""Workspaces and call control: paths of one recording's files, skipping finished work, retries."""

from __future__ import annotations

import functools
import os
import re
import time
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlsplit, urlunsplit

# Where each of a workspace's files lies.
FILES = {
    "info": "info.json", "status": "status.json", "output_video": "output.mp4", "output_card": "output.md", "log": "log/llm.log",
    "raw_audio": "transcribe/raw.mp3", "vocal_audio": "transcribe/vocal.mp3", "words_json": "transcribe/whisperx.json", "words_srt": "transcribe/whisperx.srt",
    "source_srt": "subtitle/src.srt", "translated_srt": "subtitle/trans.srt", "compare": "subtitle/compare.txt", "origin_text": "subtitle/origin.txt",
    "optimized_text": "subtitle/optimized.txt", "split_text": "subtitle/split.txt", "summary": "subtitle/summary.json", "cache": "cache", "origin": "origin",
}


def paths(folder: str | Path) -> dict[str, Path]:
    base = Path(folder).expanduser().resolve()
    return {"base": base, **{name: base / part for name, part in FILES.items()}}


def safe_name(title: str) -> str:
    """As ``functions.text.safe_name``, for one title."""
    return re.sub(r"\s+", " ", re.sub(r'[<>:"/\\|?*\x00-\x1f]+', "_", title).strip()).strip(" .")


def resolve(root: str | Path, title: str) -> Path:
    if not (name := safe_name(title)):
        raise ValueError("the title is empty after sanitizing")
    return Path(root).expanduser().resolve() / name


def create(root: str | Path, title: str) -> Path:
    folder = resolve(root, title)
    folder.mkdir(parents=True, exist_ok=False)
    return folder


def skip_if_done(*targets: str | os.PathLike | Callable[..., str | os.PathLike]):
    """A call whose target files all exist is skipped and gives None; targets may depend on its arguments."""

    def wrap(function):
        @functools.wraps(function)
        def call(*args, **kwargs):
            done = all(os.path.exists(t(*args, **kwargs) if callable(t) else t) for t in targets)
            return None if done else function(*args, **kwargs)

        return call

    return wrap


_RAISE = object()


def retrying(times: int = 0, delay: float = 1.0, default=_RAISE):
    """Call again after failures, pausing twice as long each time; then give ``default`` or raise."""

    def wrap(function):
        @functools.wraps(function)
        def call(*args, **kwargs):
            for attempt in range(times + 1):
                try:
                    return function(*args, **kwargs)
                except Exception:
                    if attempt < times:
                        time.sleep(delay * 2**attempt)
                    elif default is _RAISE:
                        raise
            return default

        return call

    return wrap


def base_url(url: str) -> str:
    """A service's address; an empty path becomes ``/v1``."""
    parts = urlsplit(url.strip())
    return urlunsplit(parts._replace(path=parts.path.rstrip("/") or "/v1"))


@contextmanager
def cancellable(spark, group: str):
    """Jobs started inside belong to one group; an error (an interrupt too) cancels those still running."""
    context = spark.sparkContext
    context.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield
    except BaseException:
        context.cancelJobGroup(group)
        raise
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


class Session:
    """The cache switch and folder of a run; opening twice or using a closed one is an error."""

    def __init__(self):
        self.folder: str | None = None
        self.enabled = True

    def open(self, folder: str) -> Session:
        if self.folder is not None:
            raise RuntimeError("the session is already open")
        self.folder = folder
        return self

    def cache(self, kind: str) -> str:
        if self.folder is None:
            raise RuntimeError("the session is not open")
        return f"{self.folder}/{kind}"

    def close(self) -> None:
        self.folder = None

    __enter__ = lambda self: self

    def __exit__(self, *_) -> None:
        self.close()
