"""Chat formatting by quotation linking.

A message's lines carry nested quote levels (leading `>` marks). Lines of one level with no blank line between form a
passage. Quoted passages are normalised (case, white space), hashed and joined to the message of the same conversation
that first said it, at an earlier turn. A message says its paragraphs, its whole body and, for partial quotes, its single
lines and sentences of at least PIECE_WORDS words (or PIECE_LETTERS letters of a script without spaces); a quote that is not linked as a whole is linked by such pieces of its
own. A message replies to the latest message that its level-one quotes come from, or, failing that, its deeper ones; in
each case whole quotes go before pieces. Following replies upwards gives each message its thread and depth, by pointer
jumping over (conversation, turn) pairs, so that no conversation is ever gathered in one place. Conversations come out in
reply order, thread by thread and by depth, with quotes left out, and with them the line that introduces a quote: the
last one before it, in any language, if it ends in a colon.

Defined cases: null and empty texts have no passages and an empty body; rows without conv_id or turn are linked with
nothing; of repeated rows of one turn each gets its body, and they share parent, thread and depth; a passage said twice counts as
said at its first turn; texts of any length are taken whole; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.staging import staged

QUOTED = regex.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", regex.DOTALL)
COLONS = (":", "\uff1a")
SENTENCE_END = regex.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])\s*")
PIECE_WORDS = 4
#: Scripts that put no spaces between words; so many of their letters count as PIECE_WORDS words.
UNSPACED, PIECE_LETTERS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"), 6
PARSED = "conv_id long, turn long, role string, body string, n_quotes long, said array<binary>, quoted array<struct<level:int,quote:binary,whole:boolean,passage:binary>>"


def passages(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and all passages with their level (0: the message's own)."""
    found: list[tuple[int, list[str]]] = []
    body: list[str] = []
    level, before = -1, 0
    for line in text.splitlines():
        m = QUOTED.fullmatch(line)
        here, rest = (m[1].count(">"), m[2]) if m else (0, line)
        if not rest.strip():
            level = -1
            if not here:
                body.append("")
            continue
        if here and before == 0:  # a quote begins: what introduces it goes
            last = next((k for k in range(len(body) - 1, -1, -1) if body[k]), None)
            if last is not None and body[last].rstrip().endswith(COLONS):
                del body[last:]
                found[-1][1].pop()
        before = here
        if here != level:
            found.append((here, []))
            level = here
        found[-1][1].append(rest)
        if not here:
            body.append(rest)
    own = regex.sub(r"\n{3,}", "\n\n", "\n".join(body)).strip("\n")
    return own, [(k, "\n".join(lines)) for k, lines in found if lines]


def pieces(passage: str) -> set[str]:
    """Lines of a passage, and sentences of its lines, each alone and all together, that are long enough to be told apart."""
    lines = passage.split("\n")
    found = {*lines, *(x for line in (*lines, " ".join(lines)) for x in SENTENCE_END.split(line))}
    return {x for x in found if len(x.split()) >= PIECE_WORDS or len(UNSPACED.findall(x)) >= PIECE_LETTERS}


def normal_hash(passage: str) -> bytes:
    return hashlib.blake2b(" ".join(passage.casefold().split()).encode(), digest_size=16).digest()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies, counts, said, quoted = [], [], [], []
        for text in batch.column(3).to_pylist():
            body, found = passages(text or "")
            bodies.append(body)
            own, quotes = [p for k, p in found if not k], [(k, p) for k, p in found if k]
            counts.append(len(quotes))
            said.append(list({normal_hash(p) for p in (*own, *(x for p in own for x in pieces(p)))} | ({normal_hash(body)} if body else set())))
            parts = {(k, normal_hash(q), p == q, normal_hash(p)) for k, q in quotes for p in (q, *pieces(q))}
            quoted.append([{"level": k, "quote": q, "whole": w, "passage": p} for k, q, w, p in parts])
        kinds = pa.list_(pa.binary()), pa.list_(pa.struct([("level", pa.int32()), ("quote", pa.binary()), ("whole", pa.bool_()), ("passage", pa.binary())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bodies, pa.string()), pa.array(counts, pa.int64()), pa.array(said, kinds[0]), pa.array(quoted, kinds[1])], names=["conv_id", "turn", "role", "body", "n_quotes", "said", "quoted"])


def _same(left: DataFrame, right: DataFrame, *names: tuple[str, str]):
    on = [left[a] == right[b] for a, b in names]
    out = on[0]
    for x in on[1:]:
        out = out & x
    return out


def reply_links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent, n_linked of each turn with a linked quote."""
    able = parsed.filter("conv_id is not null and turn is not null")
    origin = able.select(F.col("conv_id").alias("o_conv"), "turn", F.explode("said").alias("o_passage")).groupBy("o_conv", "o_passage").agg(F.min("turn").alias("o_turn"))
    quoted = able.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").distinct()
    linked = quoted.join(origin, _same(quoted, origin, ("conv_id", "o_conv"), ("passage", "o_passage"))).filter("o_turn < turn")
    latest = lambda near, whole: F.max(F.when((F.col("level") == 1 if near else F.lit(True)) & (F.col("whole") | F.lit(not whole)), F.col("o_turn")))
    parent = F.coalesce(latest(True, True), latest(True, False), latest(False, True), latest(False, False))
    return linked.groupBy("conv_id", "turn").agg(parent.alias("parent"), F.countDistinct("level", "quote").alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """Each linked turn's root and depth; every round doubles the length of the jumps."""
    jumps = staged(links.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).alias("depth")), "jumps")
    while True:
        above = jumps.select(F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("up").alias("a_up"), F.col("depth").alias("a_depth"))
        further = jumps.join(above, _same(jumps, above, ("conv_id", "a_conv"), ("up", "a_turn")), "left")
        jumps = staged(further.select("conv_id", "turn", F.coalesce("a_up", "up").alias("up"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"), F.col("a_up").isNotNull().alias("moved")), "jumps")
        moved = jumps.filter("moved").limit(1).count()
        jumps = jumps.select("conv_id", "turn", "up", "depth")
        if not moved:
            return jumps.withColumnRenamed("up", "root")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn, root_turn, depth, n_quotes, n_linked, body."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = staged(rows.mapInArrow(_parse, PARSED), "messages")
    links = staged(reply_links(parsed), "replies")
    roots = threads(links)
    both = links.join(roots, ["conv_id", "turn"]).select(F.col("conv_id").alias("l_conv"), F.col("turn").alias("l_turn"), "parent", "root", "depth", "n_linked")
    joined = parsed.join(both, _same(parsed, both, ("conv_id", "l_conv"), ("turn", "l_turn")), "left")
    return joined.select(
        "conv_id", "turn", "role", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "body",
    )


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Messages as conversations in reply order; a sort over ranges of keys, so that long conversations are split."""
    return link_quotes(messages).orderBy("conv_id", "root_turn", "depth", "turn")
