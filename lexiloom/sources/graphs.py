"""Graph documents in pieces: a JSON text's arrays are cut into runs of whole elements, none of it held as objects."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents

#: Arrays of a graph document, in the order in which they are looked for.
SECTIONS = ("nodes", "links", "edges", "communities")
#: Characters of a piece; an element that is longer is a piece of its own.
PIECE = 1_000_000
_BLANK = re.compile(r"[ \t\n\r]*")
PIECES = "section string, first long, json string"


@dataclass
class GraphText:
    """The pieces of each array (place of the first element, JSON array text), references counted from list lengths, and the members that are plain values."""

    pieces: dict[str, list[tuple[int, str]]] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    values: dict[str, object] = field(default_factory=dict)

    @property
    def refs(self) -> int:
        return sum(self.counts.values())

    def frame(self, spark: SparkSession) -> DataFrame:
        """``PIECES``, a piece a row and each dealt to a task of its own, as far as there are."""
        rows = [(s, first, text) for s in SECTIONS for first, text in self.pieces.get(s, [])]
        made = spark.createDataFrame(rows, PIECES)
        return made.repartition(len(rows)) if len(rows) > 1 else made


def cut_graph(text: str, piece: int = PIECE) -> GraphText:
    """The pieces of a graph document; ValueError for what isn't a JSON object. A repeated member's last value holds, as in JSON readers."""

    def no(x: str) -> None:
        raise ValueError(x)

    decoder, out = json.JSONDecoder(parse_constant=no), GraphText()
    skip = lambda at: _BLANK.match(text, at).end()

    def sign(at: int, wanted: str) -> str:
        if at >= len(text) or text[at] not in wanted:
            raise ValueError(f"{wanted} expected at {at}")
        return text[at]

    def array(at: int, name: str) -> int:
        pieces, start, first, n, refs = [], None, 0, 0, 0
        at = skip(at + 1)
        if at < len(text) and text[at] == "]":
            out.pieces[name], out.counts[name] = [], 0
            return at + 1
        while True:
            start = at if start is None else start
            value, end = decoder.raw_decode(text, at)
            n += 1
            if name == "communities" and isinstance(value, dict) and isinstance(value.get("nodes"), list):
                refs += len(value["nodes"])
            after = skip(end)
            last = sign(after, ",]") == "]"
            if last or end - start >= piece:
                pieces.append((first, "[" + text[start:end] + "]"))
                start, first = None, n
            if last:
                out.pieces[name], out.counts[name] = pieces, n + refs
                return after + 1
            at = skip(after + 1)

    at = skip(0)
    sign(at, "{")
    at = skip(at + 1)
    if at < len(text) and text[at] == "}":
        at += 1
    else:
        while True:
            sign(at, '"')
            key, at = decoder.raw_decode(text, at)
            at = skip(at)
            sign(at, ":")
            at = skip(at + 1)
            if key in SECTIONS and at < len(text) and text[at] == "[":
                at = array(at, key)
            else:
                value, at = decoder.raw_decode(text, at)
                out.values[key] = value
                if key in SECTIONS:
                    out.pieces.pop(key, None), out.counts.pop(key, None)
            at = skip(at)
            if sign(at, ",}") == "}":
                at += 1
                break
            at = skip(at + 1)
    if skip(at) != len(text):
        raise ValueError(f"text after the document at {at}")
    return out


def read_graph(path: str) -> tuple[str, GraphText | None]:
    """(state, pieces) of a graph document of bounded size; states as of ``documents.read_bounded``."""
    state, text = documents.read_bounded(path)
    if state != "ok":
        return state, None
    try:
        return "ok", cut_graph(text)
    except (ValueError, RecursionError):
        return "malformed", None


def elements(pieces: DataFrame, *sections: str) -> DataFrame:
    """(pos, o): the elements of the first of the sections that the document has, each as JSON text with its place."""
    named = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    own = pieces.where(F.col("section").isin(list(sections)))
    if len(sections) > 1:
        own = own.join(own.agg(F.min(named).alias("best")), named == F.col("best"))
    rows = own.select("first", F.posexplode(F.from_json("json", "array<string>")).alias("at", "o"))
    return rows.select((F.col("first") + F.col("at")).alias("pos"), "o")


__all__ = ["GraphText", "cut_graph", "elements", "read_graph"]
