"""JSON documents: bounded reads that tell absent from malformed, and atomic writes."""

from __future__ import annotations

import json
import os
import tempfile

from ..functions.fixed import LIMITS


def read_bounded(path: str, cap: int = LIMITS["json_bytes"]) -> tuple[str, str | None]:
    """(state, text); state: ok, absent, oversized, unreadable or malformed (not UTF-8). A byte-order mark is dropped."""
    try:
        with open(path, "rb") as f:
            raw = f.read(cap + 1)
    except FileNotFoundError:
        return "absent", None
    except OSError:
        return "unreadable", None
    if len(raw) > cap:
        return "oversized", None
    try:
        return "ok", raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "malformed", None


def read_json(path: str, cap: int = LIMITS["json_bytes"]) -> tuple[str, object]:
    """(state, value); states as of ``read_bounded``, malformed for what isn't JSON too. NaN isn't."""
    state, text = read_bounded(path, cap)
    if state != "ok":
        return state, None

    def no(x: str) -> None:
        raise ValueError(x)

    try:
        return "ok", json.loads(text, parse_constant=no)
    except (ValueError, RecursionError):
        return "malformed", None


def write_json(path: str, value: object) -> None:
    """Sorted keys, no NaN; the new file replaces the old one in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    if os.path.islink(path) or os.path.islink(folder):
        raise OSError(f"{path}: not written through a link")
    os.makedirs(folder, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(value, f, sort_keys=True, ensure_ascii=False, allow_nan=False, indent=2)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
