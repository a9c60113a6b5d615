"""Main text of web pages by two-pass block rules.

Pass one labels each block by link density, length and stop-word density; pass two
gives the blocks that are too short to tell the label of the nearest decided one.
Only blocks below SHORT characters may be left to pass two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import by_value, need, slices

by_value(__name__, "vexel.llm.common")

#: Pages and bytes of them that are read in one go, to bound a task's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
SHORT = 70
#: Share of function words from which a block is prose: paragraphs of each language have more, lists and names less.
PROSE = 0.10
LINKS = 0.2

#: Function words of English, German, French and Spanish.
STOP = frozenset(
    """the of and to in a is that it for was on are as with his they at be this from i have or by one had not but what all were when we there can an your
    which their said if do will each about how up out them then she many some so these would other into has more her two him see no way could my than been who its now did get
    der die das und ist nicht von zu mit sich des auf für im dem ein eine einen einer als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei
    le la les de des du un une et est que qui dans en pour pas au sur par il elle ne se ce plus avec son sa ses ou mais nous vous ils sont cette aux été avoir être comme tout leur y lui ont
    el los las del y que en un una por con no se su al lo como más pero sus este ya o porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante es son ser fue era mi tu""".split()
)
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe)\b[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*>|<(/?)([a-z][a-z0-9:-]*)[^<>]*>|<[!?][^<>]*>",
    re.DOTALL | re.IGNORECASE,
)
#: What a head may hold, and what a select may hold; another tag (in a select, another block) ends one that wasn't closed.
IN_HEAD = frozenset("base basefont bgsound head html link meta title".split())
IN_SELECT = frozenset("option optgroup hr".split())
SELECT_END = re.compile(r"<(/?)select\b", re.IGNORECASE)
WORDS = re.compile(r"\w+")


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, characters inside links) of each block that has text, in order."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = at = 0
    link = False
    inside = ""  # "head", "title" in a head, "select", or "closed" in a select that has its end tag

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked, inside
        if inside == "head" and raw.strip():
            inside = ""
        if raw and not inside:
            text = unescape(raw)
            parts.append(text)
            if link:
                linked += len(" ".join(text.split()))

    for m in TAG.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        name = (m[3] or m[5] or "").lower()
        shuts = bool(m[2] or m[4])
        if inside in ("head", "title") and name:
            if name == "head" and shuts or name not in IN_HEAD:
                inside = ""
            elif name == "title":
                inside = "head" if shuts else "title"
        elif inside and (name == "select" and shuts or inside == "select" and name in BLOCK and name not in IN_SELECT):
            inside = ""
        if inside:
            continue
        if m[1]:
            pass
        elif name == "head" and not shuts:
            flush()
            inside = "head"
        elif name == "select":
            flush()
            if not shuts:
                end = SELECT_END.search(html, at)
                inside = "closed" if end and end[1] else "select"
        elif name == "a":
            link = not shuts
        elif name in BLOCK:
            flush()
            if name != "br":
                link = link and name in ("br", "div")
    say(html[at:])
    flush()
    return out


def decide(text: str, linked: int) -> bool | None:
    """Pass one: good, bad, or None for a block too short to tell."""
    if linked > LINKS * len(text) or "©" in text:
        return False
    if len(text) < SHORT:
        return False if linked else None
    return prose(text)


def prose(text: str) -> bool:
    found = WORDS.findall(text.lower())
    return sum(w in STOP for w in found) >= PROSE * max(1, len(found))


def together(texts: list[str], labels: list[bool | None]) -> list[bool | None]:
    """On a page without a good block, runs of blocks too short to tell are judged as one, if they are long enough that way."""
    out, i = list(labels), 0
    while True not in labels and i < len(out):
        j = i
        while j < len(out) and labels[j] is None:
            j += 1
        run = " ".join(texts[i:j])
        if len(run) >= SHORT:
            out[i:j] = [prose(run)] * (j - i)
        i = j + 1
    return out


def inherit(labels: list[bool | None]) -> list[bool]:
    """Pass two: an undecided block takes the label of the nearest decided one, the one before it if both are as near; bad if there is none."""
    n = len(labels)
    before: list[tuple[int, bool] | None] = [None] * n
    last = None
    for i, x in enumerate(labels):
        if x is not None:
            last = (i, x)
        before[i] = last
    out, last = [False] * n, None
    for i in range(n - 1, -1, -1):
        x = labels[i]
        if x is not None:
            last = (i, x)
            out[i] = x
            continue
        prior = before[i]
        if prior and (not last or i - prior[0] <= last[0] - i):
            out[i] = prior[1]
        elif last:
            out[i] = last[1]
    return out


def main_text(html: str | None) -> tuple[str | None, int, int]:
    """(good blocks, one a line; number of blocks; number of good ones). Null for null."""
    if html is None:
        return None, 0, 0
    found = blocks(html)
    good = inherit(together([t for t, _ in found], [decide(*b) for b in found]))
    kept = [t for (t, _), g in zip(found, good, strict=True) if g]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_blocks, n_good): one row for each page.

    A null page has null text, an empty one or one without a good block empty text. Broken markup is read as far as
    it can be: an unclosed tag is text; an unclosed comment, script, style, noscript, template, svg, math or iframe runs to the
    end, but an unclosed head or select only as far as it can. Whole pages are read, however
    long. Null ids and urls are passed on; repeated rows are extracted each. An empty table gives an empty one; extra
    columns are not read.
    """
    need(pages, html, page_id, url)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_blocks", T.IntegerType()), T.StructField("n_good", T.IntegerType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in slices(whole, "html", BATCH_BYTES, BATCH_ROWS)):
            got = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())],
                names=["page_id", "url", "text", "n_blocks", "n_good"],
            )

    return rows.mapInArrow(run, schema)
