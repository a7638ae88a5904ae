"""The managed block: a brief of the glossary kept inside an agent's instruction file.

The block lies between two marker lines. The first carries a digest of the
body, so an edit by hand shows; the text around the block is never touched.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
import tempfile

from .evidence import BEGIN, END, HOSTS, brief

STATES = ("absent", "current", "stale", "edited", "uninspectable")


def render(glossary: dict) -> str:
    body = brief(glossary)
    return f"{BEGIN} sha256={hashlib.sha256(body.encode()).hexdigest()} -->\n{body}{END}\n"


def read_host(path: str, cap: int = 2_000_000) -> str | None:
    """The text of a regular file; empty if there is none, null if it is a link, too large or not UTF-8."""
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except FileNotFoundError:
        return ""
    except OSError:
        return None
    with os.fdopen(fd, "rb") as f:
        if not stat.S_ISREG(os.fstat(fd).st_mode):
            return None
        raw = f.read(cap + 1)
    try:
        return raw.decode("utf-8") if len(raw) <= cap else None
    except UnicodeDecodeError:
        return None


def _block(text: str) -> re.Match | None:
    """The one well-formed block; null where the markers are missing, repeated or out of order."""
    if text.count(BEGIN) != 1 or text.count(END) != 1:
        return None
    return re.search(f"^{re.escape(BEGIN)} sha256=([0-9a-f]{{64}}) -->\n(.*?)^{re.escape(END)}$\n?", text, re.M | re.S)


def status(text: str | None, glossary: dict) -> str:
    """One of STATES for a host file's text (null: it couldn't be read)."""
    if text is None:
        return "uninspectable"
    if BEGIN not in text and END not in text:
        return "absent"
    found = _block(text)
    if not found:
        return "uninspectable"
    if hashlib.sha256(found[2].encode()).hexdigest() != found[1]:
        return "edited"
    return "current" if found[2] == brief(glossary) else "stale"


def sync(path: str, glossary: dict, repair: bool = False) -> str:
    """Creates, appends or updates the block and returns the state found before.

    An edited block is replaced only on ``repair``; a file that can't be
    inspected is never written.
    """
    text = read_host(path)
    state = status(text, glossary)
    if state in ("current", "uninspectable") or (state == "edited" and not repair):
        return state
    new = render(glossary)
    if state == "absent":
        gap = "" if not text else "\n" if text.endswith("\n") else "\n\n"
        text = text + gap + new
    else:
        found = _block(text)
        text = text[: found.start()] + new + text[found.end() :]
    mode = stat.S_IMODE(os.stat(path).st_mode) if os.path.exists(path) else 0o644
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".part-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(part, mode)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
    return state


__all__ = ["HOSTS", "STATES", "read_host", "render", "status", "sync"]
