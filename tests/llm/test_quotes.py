"""Quotation linking as a whole against brute force, on generated threads with partial, nested and lost quotes."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from tessera.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, body int, parent string"
CJK = re.compile(r"[一-鿿぀-ヿ฀-๿]")


def parse(text):
    """(body, own passages, quoted passages with their level), line by line."""
    lines = []
    for line in (text or "").splitlines():
        m = re.match(r"[ \t]*((?:>[ \t]?)*)(.*)$", line, re.DOTALL)
        lines.append((m[1].count(">"), m[2] if m[1] else line))
    gone = set()
    for i, (level, rest) in enumerate(lines):
        before = [j for j in range(i) if lines[j][1].strip()]
        if level and rest.strip() and before and lines[before[-1]][0] == 0 and before[-1] not in gone and lines[before[-1]][1].rstrip().endswith((":", "：")):
            gone.add(before[-1])
    passages, body, open_ = [], [], None
    for i, (level, rest) in enumerate(lines):
        if not rest.strip():
            open_ = None
            body += [] if level else [""]
        elif i not in gone:
            if open_ != level:
                passages.append((level, []))
                open_ = level
            passages[-1][1].append(rest)
            body += [] if level else [rest]
        elif open_ != level:
            open_ = level
            passages.append((level, []))
    joined = [(k, "\n".join(x)) for k, x in passages if x]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(body)).strip("\n"), [p for k, p in joined if not k], [(k, p) for k, p in joined if k]


def normal(text):
    return " ".join(text.casefold().split())


def parts(passage):
    lines = passage.split("\n")
    out = set(lines)
    for text in (*lines, " ".join(lines)):
        out |= set(re.split(r"(?<=[.!?])\s+|(?<=[。！？])\s*", text))
    return {x for x in out if len(x.split()) >= 4 or len(CJK.findall(x)) >= 6}


def brute(rows):
    said, quoted = defaultdict(dict), defaultdict(set)
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            continue
        body, own, others = parse(text)
        for p in {normal(x) for p in own for x in (p, *parts(p))} | ({normal(body)} if body else set()):
            said[conv][p] = min(turn, said[conv].get(p, turn))
        quoted[conv, turn] |= {(k, normal(q), p == q, normal(p)) for k, q in others for p in (q, *parts(q))}
    up, linked = {}, {}
    for (conv, turn), found in quoted.items():
        met = [(k, q, whole, said[conv][p]) for k, q, whole, p in found if said[conv].get(p, turn) < turn]
        for rule in (lambda k, w: k == 1 and w, lambda k, w: k == 1, lambda k, w: w, lambda k, w: True):
            turns = [t for k, _, w, t in met if rule(k, w)]
            if turns:
                up[conv, turn] = max(turns)
                break
        linked[conv, turn] = len({(k, q) for k, q, _, _ in met})
    out = []
    for conv, turn, role, text in rows:
        body, _, others = parse(text)
        depth, root = 0, turn
        while (conv, root) in up:
            depth, root = depth + 1, up[conv, root]
        out.append((conv, turn, role, up.get((conv, turn)), root, depth, len(others), linked.get((conv, turn), 0), body))
    return sorted(out, key=str)


def made():
    rng = random.Random(21)
    words = ["alpha", "Beta", "gamma", "delta", "Epsilon", "zeta", "eta"]
    rows = []
    for conv in range(25):
        texts = []
        for turn in range(rng.randint(1, 9)):
            out = []
            for _ in range(rng.randint(0, 3)):
                if texts and rng.random() < 0.7:
                    source = rng.choice(texts) or ""
                    lines = source.split("\n")
                    if rng.random() < 0.5 and lines:  # some lines of it, or a sentence
                        lines = [rng.choice(lines)] if rng.random() < 0.6 else lines[: rng.randint(1, len(lines))]
                        if rng.random() < 0.4:
                            lines = [rng.choice(re.split(r"(?<=[.!?])\s+", lines[0]))]
                    out += [f"{rng.choice(['On Monday X wrote:', 'wrote：', 'No colon here'])}"] if rng.random() < 0.4 else []
                    out += [f"{'> ' if rng.random() < 0.8 else '>'}{x.upper() if rng.random() < 0.2 else x}" for x in lines] + [""]
                out += [" ".join(rng.choices(words, k=rng.randint(1, 7))) + rng.choice([".", "!", ""]) + (" " + " ".join(rng.choices(words, k=5)) + "." if rng.random() < 0.4 else "") for _ in range(rng.randint(0, 3))]
                out += ["今天的天气非常好。我们应该去公园散步吗？"] if rng.random() < 0.2 else []
                out += [""] * rng.randint(0, 3)
            texts.append("\n".join(out) if rng.random() < 0.97 else None)
            rows.append((conv, turn, "user", texts[-1]))
    return [*rows, rows[3], (0, 1, "x", "a second row of one turn, long enough"), (None, 1, "u", "> alpha"), (2, None, "u", "> beta"), (99, 0, None, ""), (98, 5, "u", "> > \n>\n> > deep words here now\nown:\n> q")]


def test_query_equals_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r[c] for c in ("conv_id", "turn", "role", "parent_turn", "root_turn", "depth", "n_quotes", "n_linked", "body")) for r in quotes.link_quotes(df).collect()), key=str)
    expected = brute(rows)
    assert sum(r[7] for r in expected) > 40 and any(r[5] > 2 for r in expected)
    assert got == expected
