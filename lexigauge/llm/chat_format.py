"""Quotation linking: conversations in reply order, without their quotes.

A message's lines are parsed by quote level (leading ``>`` marks). Own lines and quoted ones are normalised (lower case, white space to
one space) and hashed, line by line and passage by passage (successive lines of one level); quoted hashes are joined to the earliest message
of the conversation that has the passage as its own, if it comes before. A message replies to the one that most of its outermost
linked quotes come from, the later one of equals. Threads are found by doubling pointers along these links, so within a conversation
the order (thread_root, turn) puts each reply after what it answers. Own text stays, quotes and the line that introduces
a quote ("... wrote:") go.

Defined cases: null text has an empty body and no quotes; a quote found nowhere links nothing; a null conversation or turn links
nothing; a repeated row gets the same result; an empty table gives no rows; extra columns are ignored. A conversation is never gathered in
one task: links are joined by conversation and passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage
from .wordhash import slices

_QUOTE = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
_INTRODUCTION = re.compile(r"(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*\Z", re.I | re.S)


def parse(text: str | None) -> list[tuple[int, str]]:
    """Level and content of each line; own lines have level 0, and introductions of quotes are left out."""
    lines = []
    for line in (text or "").split("\n"):
        m = _QUOTE.match(line)
        lines.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    out = []
    for k, (level, line) in enumerate(lines):
        after = next((x for x, content in lines[k + 1 :] if x or content.strip()), 0) if line.rstrip().endswith(":") else 0
        if not (level < after and _INTRODUCTION.match(line.strip())):
            out.append((level, line))
    return out


def _key(text: str) -> int | None:
    plain = " ".join(text.lower().split())
    return int.from_bytes(blake2b(plain.encode(), digest_size=8).digest(), "big", signed=True) if plain else None


def units(lines: list[tuple[int, str]]) -> set[tuple[int, int]]:
    """Level and hash of each line and of each run of lines of one level."""
    found, run = set(), []
    for level, line in [*lines, (-1, "")]:
        if run and run[-1][0] != level:
            found.add((run[0][0], _key(" ".join(x for _, x in run))))
            run = []
        run.append((level, line))
        found.add((level, _key(line)))
    return {(level, key) for level, key in found if key is not None and level >= 0}


def body(lines: list[tuple[int, str]]) -> str:
    """Own lines, with no more than one empty line where quotes stood."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for level, x in lines if not level)).strip("\n")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        bodies, quoted, levels, own, quotes = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            lines = parse(text)
            found = sorted(units(lines))
            # without quotes in it, the text is its own body as it stands
            bodies.append(body(lines) if any(level for level, _ in lines) else text or "")
            quoted.append(sum(level > 0 for level, _ in lines))
            levels.append(max((level for level, _ in lines), default=0))
            own.append([k for level, k in found if not level])
            quotes.append([{"level": level, "key": k} for level, k in found if level])
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in kept), pa.array(bodies, pa.string()), pa.array(quoted, pa.int64()), pa.array(levels, pa.int32()),
                pa.array(own, pa.list_(pa.int64())), pa.array(quotes, pa.list_(pa.struct([("level", pa.int32()), ("key", pa.int64())]))),
            ],
            names=[*kept, "body", "n_quoted_lines", "n_levels", "own", "quotes"],
        )


def reply_order(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, reply_to, thread_root, n_quoted_lines, n_levels, n_linked, body), for ``messages (conv_id, turn, role, text)``."""
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = stage(
        rows.mapInArrow(_parsed, "conv_id bigint, turn bigint, role string, body string, n_quoted_lines bigint, n_levels int, own array<bigint>, quotes array<struct<level:int,key:bigint>>"),
        "parsed",
    )
    quotes = parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.key").distinct()
    sources = parsed.select("conv_id", "turn", F.explode("own").alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("source"))
    linked = stage(quotes.join(sources, ["conv_id", "key"]).where("source < turn"), "linked")
    votes = linked.groupBy("conv_id", "turn", "level", "source").agg(F.count("*").alias("n"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct(-F.col("level"), "n", "source")).alias("reply_to"), F.sum("n").alias("n_linked"))
    parents = stage(parents, "parents")
    roots = parents.select("conv_id", "turn", F.col("reply_to").alias("root"))
    for _ in range(64):
        up = roots.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"))
        higher = stage(roots.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        roots = higher.select("conv_id", "turn", "root")
        if not higher.where("moved").limit(1).count():
            break
    found = parents.join(roots, ["conv_id", "turn"])
    return parsed.join(found, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("thread_root"), "n_quoted_lines", "n_levels", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "body"
    )


def chat_lines(ordered: DataFrame) -> DataFrame:
    """One formatted line per message of ``reply_order``; sorted by conv_id, thread_root and turn they form the conversations."""
    return ordered.select("conv_id", "thread_root", "turn", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "body", F.lit("\n<|end|>")).alias("line"))
