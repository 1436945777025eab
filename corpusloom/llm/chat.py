"""Operator 3: chat formatting by quotation linking.

A message's lines have a quote level, the number of leading `>` signs. Runs of lines of one level are
passages. What a message says itself (level 0) is hashed as a whole, by paragraph and by line, after
normalising case and white space; so are the passages that it quotes. Quotes are joined to the first message
of the conversation that says the same, and the message answers the latest such original that comes
before it, found by its quotes of level 1, or of the next level where these find nothing. What has fewer than
`SHORT` characters, a whole passage or a line of a longer one, names its original only where nothing longer of
that level does. Chains of answers are followed to their first message, which names the thread; ordering by
(thread, turn) puts every answer behind what it answers, and gives each turn its position. Quotes, and the line that announces them, leave
the text.

Joins are on (conversation, hash) against one pre-aggregated original, so frequent lines and very long
conversations make no pairs, and no conversation is gathered in one task.

Defined cases: a null text is empty; a null conv_id or turn keeps its row but links with nothing; a
message that quotes nothing that was said starts a thread of its own; a quote of several originals answers the
latest; repeated rows get the same result each; an empty table gives no rows; further columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed, ranked
from .components import with_hot_keys

LEVEL = re.compile(r"^\s*((?:>\s?)+)(.*)$", re.DOTALL)
#: the line that announces a quote, such as "On Monday, A wrote:"
ANNOUNCED = re.compile(r"^(?:(?:on|am|le|el)\b.*|.*\b(?:wrote|schrieb|a écrit|escribió)\s*):\s*$", re.IGNORECASE)
#: what is shorter says little: it names a message if nothing longer of its level does
SHORT = 8


def levels(text: str | None) -> list[tuple[int, str]]:
    """(quote level, line without its signs) of every line."""
    out = []
    for line in (text or "").split("\n"):
        m = LEVEL.match(line)
        out.append((m[1].count(">"), m[2]) if m else (0, line))
    return out


def own_text(lines: list[tuple[int, str]]) -> str:
    """What a message says itself, without quotes and their announcements."""
    out = []
    for k, (level, line) in enumerate(lines):
        announces = level == 0 and ANNOUNCED.match(line) and k + 1 < len(lines) and lines[k + 1][0] > 0
        if level == 0 and not announces:
            out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def hashes(passage: str) -> dict[int, bool]:
    """Of the whole, its paragraphs and its lines, in normal form: whether they are short."""
    parts = {passage, *re.split(r"\n\s*\n", passage), *passage.split("\n")}
    norms = {" ".join(p.lower().split()) for p in parts}
    return {xxhash.xxh64_intdigest(n.encode()) - (1 << 63): len(n) < SHORT for n in norms if n}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for text in b["text"]:
            lines = levels(text)
            own = own_text(lines)
            quoted: dict[int, list[str]] = {}
            runs: list[tuple[int, list[str]]] = []
            for level, line in lines:
                if runs and runs[-1][0] == level:
                    runs[-1][1].append(line)
                else:
                    runs.append((level, [line]))
            for level, part in runs:
                if level:
                    quoted.setdefault(level, []).append("\n".join(part))
            ranks: dict[int, int] = {}  # of a quoted hash: by level, then longer passages first
            for level in sorted(quoted):
                for passage in quoted[level]:
                    for h, short in hashes(passage).items():
                        ranks[h] = min(ranks.get(h, 2 * level + short), 2 * level + short)
            n = sum(len(ps) for ps in quoted.values())
            out.append((own, sorted(hashes(own)), list(ranks), list(ranks.values()), n, max(quoted, default=0)))
        yield b[["conv_id", "turn"]].assign(**dict(zip(("clean", "says", "quotes", "ranks", "n_quotes", "max_level"), zip(*out, strict=True), strict=True))) if out else pd.DataFrame()


PARSED = "clean string, says array<long>, quotes array<long>, ranks array<int>, n_quotes long, max_level int"


def _parsed(texts: pd.Series) -> pd.DataFrame:
    frame = pd.DataFrame({"conv_id": 0, "turn": 0, "text": texts})
    return next(_parse(iter([frame]))).drop(columns=["conv_id", "turn"])


def linked(messages: DataFrame) -> DataFrame:
    """Every row as struct `row`, its text without quotes, with n_quotes, max_level, reply_to (turn or null), thread (turn) and position."""
    parsed = packed(messages).withColumn("found", F.pandas_udf(_parsed, PARSED)("row.text"))
    # the text as it came is not needed any more, so it is not written
    row = F.struct(*[F.col("found.clean").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in messages.columns])
    rows = checkpointed(parsed.select(row.alias("row"), F.col("found").dropFields("clean").alias("found")))
    where = rows.select(F.col("row.conv_id").alias("conv_id"), F.col("row.turn").alias("turn"), "found").where("conv_id is not null and turn is not null")
    says = where.select("conv_id", "turn", F.explode("found.says").alias("h"))
    asks = where.where("found.n_quotes > 0").select("conv_id", "turn", F.explode(F.arrays_zip(F.col("found.quotes").alias("h"), F.col("found.ranks").alias("rank"))).alias("asked")).select("conv_id", "turn", "asked.*")
    # only passages that somebody quotes need their original
    first = says.join(asks.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").groupBy("conv_id", "h").agg(F.min("turn").alias("said"))
    met = asks.join(first, ["conv_id", "h"]).where("said < turn").groupBy("conv_id", "turn", "rank").agg(F.max("said").alias("said"))
    answers = checkpointed(met.groupBy("conv_id", "turn").agg(F.min_by("said", "rank").alias("reply_to")))
    up = checkpointed(answers.withColumnRenamed("reply_to", "thread"))
    while True:  # pointer doubling: the number of rounds is the logarithm of the longest chain
        higher = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        nxt = checkpointed(up.join(higher, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), F.col("above").isNotNull().alias("moved")))
        up = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    links = answers.join(up, ["conv_id", "turn"])
    turns = where.select("conv_id", "turn").distinct().join(links, ["conv_id", "turn"], "left")
    # the order of the conversation: a rank over all turns, less that of the conversation's first one
    order = ranked(turns.withColumn("thread", F.coalesce("thread", "turn")), "conv_id", "thread", "turn")
    first = order.groupBy("conv_id").agg(F.min("rank").alias("first"))
    placed = with_hot_keys(order, first, "conv_id").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reply_to", "thread", (F.col("rank") - F.col("first")).alias("position"))
    out = rows.join(placed, (F.col("row.conv_id") == F.col("c")) & (F.col("row.turn") == F.col("t")), "left")
    return out.select("row", F.col("found.n_quotes").alias("n_quotes"), F.col("found.max_level").alias("max_level"), "reply_to", F.coalesce("thread", F.col("row.turn")).alias("thread"), "position")


def formatted(messages: DataFrame, pattern: str = "<|%s|>\n%s\n<|end|>\n") -> DataFrame:
    """conv_id, position, thread, turn, role, reply_to, n_quotes, max_level, text without quotes, and it as a chat turn.

    `position` (from 0) is the order of the conversation, by thread and turn; repeated rows share one.
    """
    return linked(messages).select(
        "row.conv_id",
        "position",
        "thread",
        "row.turn",
        "row.role",
        "reply_to",
        "n_quotes",
        "max_level",
        "row.text",
        F.format_string(pattern, F.coalesce("row.role", F.lit("user")), "row.text").alias("formatted"),
    )


def without_quotes(messages: DataFrame) -> DataFrame:
    """The rows and columns of `messages`, with the quotes out of the text."""
    return linked(messages).select(*[F.col(f"row.`{c}`") for c in messages.columns])
