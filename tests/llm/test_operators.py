"""Each operator against brute force and on the awkward rows: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, langid, mixing, near_dedup, quality, quotes, substring_dedup, suffix_dedup, warc
from tessera.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, starts long, n long"


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(300)]
    passage = rng.choices(vocabulary, k=90)
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 260))) for _ in range(n)]
    for i in range(0, n, 4):
        words = out[i].split()
        words[len(words) // 2 : len(words) // 2] = passage[: rng.randint(40, 90)]
        out[i] = (" \n\t").join(words) if i % 8 else " ".join(words)
    base = rng.choices(vocabulary, k=150)
    for _ in range(12):  # near copies
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary).upper()
        out.append(" ".join(copy))
    return [*out, out[1], out[2], out[2], None, "", "  \n ", "one two", "One two", "a\x00b c", "word " * 3000, " ".join(rng.choices(vocabulary, k=9000))]


@pytest.fixture(scope="module")
def rows():
    return [(i * 3 % 101 if i % 3 else i + 200, t) for i, t in enumerate(texts())] + [(None, "x y"), (None, None), (500, "dup text"), (500, "dup text"), (500, "other text")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, 1, "h", 2, 3) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# 1 ---------------------------------------------------------------------------------------------------------------------


def test_decontamination_matches_brute_force(spark, docs, rows, none):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [(1, " ".join(words(rows[0][1])[-60:-20])), (2, " ".join(words(rows[4][1])[3:30])), (10, "one two"), (3, None), (4, "..."), (5, "Dup"), (5, "Dup"), (None, "text")]
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, n long")
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add(i)
    expected = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if (ids := windows.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= ids
        names = sorted(str(x) for x in found if x is not None)
        expected.append((i, len(w), len(hit), names, bool(hit) and 20 * len(hit) >= len(w)))
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect()]
    assert Counter(map(str, got)) == Counter(map(str, expected))
    assert decontaminate.drop_contaminated(docs, bench).count() == sum(not e[-1] for e in expected)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated or n_hit > 0").count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------------


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.digest.hex(), r.keep_id, r.group_size) for r in got) == Counter((i, sha(t or ""), max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows)
    kept = Counter(r.digest.hex() for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.drop_copies(docs).columns == docs.columns and exact_dedup.drop_copies(docs).count() == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_index_takes_and_loses_digests(spark):
    make = lambda pairs: exact_dedup.digests(spark.createDataFrame(pairs, "doc_id long, text string"))
    content = lambda x: {(r.digest.hex(), r.copies, r.keep_id) for r in x.content.collect()}
    live = lambda x: x.filters.agg(F.sum("size")).first()[0]
    index = exact_dedup.build_index(make([(1, "a"), (2, "b"), (3, "a")]))
    index = exact_dedup.insert(index, make([(9, "a"), (4, "c")]))
    assert content(index) == {(sha("a"), 3, 9), (sha("b"), 1, 2), (sha("c"), 1, 4)} and live(index) == 3
    index = exact_dedup.delete(index, make([(0, "a"), (0, "unknown")]))
    assert content(index) == {(sha("b"), 1, 2), (sha("c"), 1, 4)} and live(index) == 2
    index = exact_dedup.insert(index, make([(7, "a")]))
    assert content(index) == {(sha("a"), 1, 7), (sha("b"), 1, 2), (sha("c"), 1, 4)} and live(index) == 3


def test_index_splits_and_reads_content_for_hits_only(spark, monkeypatch):
    read = []
    plain = exact_dedup.verified
    monkeypatch.setattr(exact_dedup, "verified", lambda index, hits: read.append(plain(index, hits).count()) or plain(index, hits))
    make = lambda ids: exact_dedup.digests(spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string"))
    index = exact_dedup.build_index(make(range(2000)))
    grown = exact_dedup.insert(index, make(range(1990, 4000)), digests_per_shard=500)
    assert read[0] == 0 and 10 <= read[1] < 60
    assert grown.shards > index.shards and grown.content.count() == 4000 == grown.filters.agg(F.sum("size")).first()[0]
    assert grown.content.filter("copies = 2").count() == 10
    assert grown.filters.count() == grown.shards and {r.shard for r in grown.content.select("shard").distinct().collect()} <= set(range(grown.shards))


def test_cuckoo_filter_overflows_and_resizes_from_stored_keys(spark):
    keys = [int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "little") for i in range(2000)]
    small = exact_dedup.CuckooFilter(8)
    assert not all(small.insert(k) for k in keys)
    signed = lambda v: np.array(v, np.uint64).view(np.int64).tolist()
    content = spark.createDataFrame([(0, k, str(k).encode(), 1, k, 1) for k in signed(keys[:20])], exact_dedup.CHANGES)
    held = exact_dedup.CuckooFilter(8)
    assert all(held.insert(k) for k in keys[:20])
    index = exact_dedup.Index(spark.createDataFrame([(0, 20, bytearray(held.cells.tobytes()))], exact_dedup.FILTERS), content, 1)
    got, filters = exact_dedup._entered(spark.createDataFrame([(0, k) for k in signed(keys)], "shard int, key long"), index, True)
    cells = filters.first().cells
    grown = exact_dedup.CuckooFilter(len(cells) // (2 * exact_dedup.CELLS), bytes(cells))
    assert grown.buckets > 8 and grown.contains_many(np.array(keys, np.uint64)).all() and all(grown.contains(k) for k in keys)
    assert {r.key for r in got.filter("hit").collect()} >= set(signed(keys[:20])) and got.filter("hit").count() < 40
    for k in keys[:1000]:
        grown.delete(k)
    assert all(grown.contains(k) for k in keys[1000:]) and sum(grown.contains(k) for k in keys[:1000]) < 20


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_quality_learns_and_keeps_all_rows(spark, docs, none):
    rng = random.Random(3)
    good = lambda: ". ".join(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(12)) for _ in range(6))
    bad = lambda: " ".join("".join(rng.choices("ABCD#$%", k=rng.randint(2, 8))) + "!!" for _ in range(60))
    made = [(i, (bad if i % 5 == 1 else good)(), int(i % 5 != 1)) for i in range(600)]
    frame = spark.createDataFrame([(i, t, "x") for i, t, _ in made] + [(None, None, "x"), (7, "", "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, q) for i, _, q in made if i % 3] + [(None, 1), (5, None), (99999, 1)], "doc_id long, quality int")
    got = quality.quality(frame, labels).collect()
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got)
    truth = {i: q for i, _, q in made}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert quality.quality(docs, labels.limit(0)).filter("score != 0.5").count() == 0
    assert quality.quality(none, labels).count() == 0
    assert quality.drop_poor(docs, labels).columns == docs.columns


def test_quality_weights_and_calibration_match_a_local_solve(spark):
    """Weights against ridge on the stacked rows, the calibration against means over all pools of neighbouring bins."""
    rng = random.Random(8)
    made = [(i, " ".join(rng.choices(["the", "of", "data", "x9!!", "$$$"], weights=[5, 5, 4, 1 + 4 * (i % 2), 1 + 4 * (i % 2)], k=30 + i % 50)), 1 - i % 2 if rng.random() < 0.9 else i % 2) for i in range(400)]
    frame = spark.createDataFrame(made, "doc_id long, text string, quality int")
    stats = quality.document_statistics(frame.drop("quality"), None).cache()
    scorer = quality.fit(stats, frame.select("doc_id", "quality"), lambda i: i % 4 != 0, features=24)
    rows = sorted((r.doc_id, r.stats, r.fold) for r in stats.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS))).collect() if r.doc_id % 4)
    y, fold = np.array([made[i][2] for i, _, _ in rows], float), np.array([f for _, _, f in rows])
    z = scorer.features(np.array([s for _, s, _ in rows]))

    def solve(z, y):
        penalty = np.diag([0.0] + [1.0] * 24) * quality.RIDGE * len(y) / 24 + 1e-9 * np.eye(25)
        return np.linalg.solve(z.T @ z + penalty, z.T @ y)

    assert np.allclose(z @ scorer.weights, z @ solve(z, y), atol=1e-6)
    raw = np.array([a @ solve(z[fold != f], y[fold != f]) for a, f in zip(z, fold, strict=True)])
    bins = np.floor(np.clip(raw, -0.5, 1.5) * quality.BINS / 2).astype(int)
    names = sorted(set(bins))
    n, mean = np.array([(bins == b).sum() for b in names]), np.array([y[bins == b].mean() for b in names])
    pooled = lambda i, j: (n[i : j + 1] * mean[i : j + 1]).sum() / n[i : j + 1].sum()
    best = [max(min(pooled(i, j) for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))]
    assert np.allclose(scorer.knots[1], best, atol=1e-9)


def test_isotonic_is_monotone_and_keeps_the_mean():
    y, w = np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1.0, 2, 1, 1, 3])
    fit = quality.isotonic(np.arange(5), y, w)
    assert (np.diff(fit) >= 0).all() and np.isclose((fit * w).sum(), (y * w).sum())


# 4 ---------------------------------------------------------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def removed_words(rows, length):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {q for k in range(len(w) - length + 1) if i is not None and first[tuple(w[k : k + length])] < i for q in range(k, k + length)}
        out.append((i, len(w), len(gone), sha(" ".join(x for q, x in enumerate(w) if q not in gone))))
    return Counter(out)


@pytest.mark.parametrize("length", [50, 20, 3])
def test_substring_dedup_matches_brute_force(docs, rows, none, length):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha.hex()) for r in substring_dedup.substring_dedup(docs, length).collect())
    assert got == removed_words(rows, length)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_levels_keep_only_windows_that_repeat(spark, monkeypatch):
    """Documents that share 15 words stay for the second level only, those that share 30 for the third, and so on."""
    assert substring_dedup.levels(50) == [13, 25, 50] and substring_dedup.levels(3) == [2, 3]
    rng = random.Random(41)
    word = lambda: f"w{rng.random()}"
    made = []
    for shared in (5, 20, 40, 70):
        passage = [word() for _ in range(shared)]
        made += [" ".join([*[word() for _ in range(60)], *passage, *[word() for _ in range(60)]]) for _ in range(2)]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    seen = []
    plain = substring_dedup.staged
    monkeypatch.setattr(substring_dedup, "staged", lambda df, name: (seen.append((name, (out := plain(df, name)).count())), out)[1])
    found = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(frame).collect()}
    assert [n for name, n in seen if name == "candidates"] == [6, 4] and dict(seen)["level"] == 2
    assert found == {i: 70 if i == 7 else 0 for i in range(8)}


def test_substring_levels_double(spark):
    rng = random.Random(4)
    shared = [f"w{rng.random()}" for _ in range(40)]
    frame = spark.createDataFrame([(k, " ".join([f"a{k}", *shared, *[f"b{k}_{j}" for j in range(30)]])) for k in range(3)], "doc_id long, text string")
    found = substring_dedup.substring_dedup(frame, 8, longest=64).collect()
    assert {r.longest_repeat for r in found} == {32} and sorted(r.n_removed for r in found) == [0, 40, 40]


# 5 ---------------------------------------------------------------------------------------------------------------------


def removed_bytes(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(x for x, g in zip(b, gone, strict=False) if not g))))
    return Counter(out)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup_matches_brute_force(docs, rows, none, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha.hex()) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == removed_bytes(rows, 200)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_array_by_difference_cover():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = rng.integers(1, 1 + int(rng.integers(1, 5)), int(rng.integers(0, 60)))
        assert list(suffix_dedup.suffix_array(s)) == sorted(range(len(s)), key=lambda i: tuple(s[i:]))
    for symbols in (np.ones(3000, np.int64), np.tile([1, 2], 1000), rng.integers(1, 1 << 40, 500)):
        order = suffix_dedup.suffix_array(symbols)
        assert list(order) == sorted(range(len(symbols)), key=lambda i: tuple(symbols[i:]))


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark, docs, none):
    made = [(i, "w " * (1 + i % 7), "big" if i % 10 else f"small{i % 30}", 1) for i in range(3000)] + [(9001, None, "big", 1), *[(9100 + i, "a b", None, 1) for i in range(200)], (9002, "a b", None, 1), (9002, "a b", None, 1)]
    frame = spark.createDataFrame(made, "doc_id long, text string, source string, n_tokens long")
    tokens = Counter()
    for _, t, s, _ in made:
        tokens[s] += len((t or "").split())
    total = sum(tokens.values())
    for goal, at_limit in ((0.5, False), (0.95, True)):
        taken = mixing.mixture(frame, target_entropy=goal).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
        share = {r.source: r.n / total for r in taken}
        entropy = -sum(p * np.log(p) for p in share.values() if p) / np.log(len(tokens))
        assert abs(sum(share.values()) - 1) < 0.02 and all(r.n <= 4 * tokens[r.source] for r in taken)
        assert max(share[s] * total / tokens[s] for s in share) > 3.9 if at_limit else abs(entropy - goal) < 0.03
    again = mixing.mixture(frame, target_entropy=0.9)
    assert again.groupBy("doc_id", "epoch", "source").count().filter("count > 1 and doc_id != 9002").count() == 0
    assert mixing.mixture(none).count() == 0 and mixing.mixture(docs).count() > 0


def test_blocks_are_ordered_by_ranges_as_by_a_whole_sort(spark):
    rng = random.Random(6)
    made = [(s, b, e, rng.randint(0, 9)) for s in ("a", None) for b in range(400 if s else 3) for e in range(2)]
    got = defaultdict(list)
    for r in mixing.in_order(spark.createDataFrame(made, "source string, block long, epoch long, in_block long")).collect():
        got[r.source, r.epoch].append((r.block_rank, r.block, r.through))
    size = {(s, b, e): n for s, b, e, n in made}
    key = lambda s, e, b: int(hashlib.md5(f"{mixing.SEED}:{e}:{s or ''}/{b}".encode()).hexdigest()[:15], 16)
    for (s, e), rows in got.items():
        through, expected = 0, []
        for rank, b in enumerate(sorted((b for x, b, y in size if (x, y) == (s, e)), key=lambda b, s=s, e=e: (key(s, e, b), b)), 1):
            through += size[s, b, e]
            expected.append((rank, b, through))
        assert sorted(rows) == expected


# 7 ---------------------------------------------------------------------------------------------------------------------


def test_quotes_link_and_go(spark):
    messages = [
        (1, 0, "user", "How do I sort a list?\n\nIt is long."), (1, 1, "assistant", "> how do i   SORT a list?\n\nUse sorted()."),
        (1, 2, "user", "On Monday X wrote:\n>> How do I sort a list?\n> Use sorted().\n\nThanks!"), (1, 3, "user", "> never said\nHm."), (1, 4, "user", None),
        (2, 0, "user", "> Use sorted().\nOther thread"), (None, 1, "user", "> x\ny"), (1, 5, "user", ""), (1, 6, "user", "Thanks!"), (1, 7, "x", "> Thanks!\n> > Use sorted().\nok"),
    ]
    frame = spark.createDataFrame([(*m, 1) for m in messages], "conv_id long, turn long, role string, text string, depth int")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(frame).collect()}
    assert len(got) == len(messages)
    assert [got[1, t].parent_turn for t in range(8)] == [None, 0, 1, None, None, None, None, 2]
    assert [got[1, t].root_turn for t in range(8)] == [0, 0, 0, 3, 4, 5, 6, 0]
    assert [got[1, t].depth for t in range(8)] == [0, 1, 2, 0, 0, 0, 0, 3]
    assert got[1, 2].body == "Thanks!" and got[1, 2].n_quotes == 2 and got[1, 4].body == "" and got[2, 0].parent_turn is None and got[None, 1].body == "y"
    order = [(r.root_turn, r.depth) for r in quotes.reply_ordered(frame.filter("conv_id = 1")).collect()]
    assert order == sorted(order)
    assert quotes.link_quotes(frame.limit(0)).count() == 0


def test_generated_threads_with_partial_and_nested_quotes(spark):
    """Parents are known by how the threads are made: whole, one line, one sentence or a run of paragraphs is quoted."""
    rng = random.Random(7)
    rows, truth = [], {}
    for conv in range(30):
        said, quoted = [], []  # own paragraphs and quoted lines of each turn
        for turn in range(rng.randint(1, 12)):
            parent = rng.choice([None, *range(turn)]) if turn else None
            lines = []
            if parent is not None:
                lines += rng.choice([[], ["Am Montag schrieb X:"], ["Le lundi, X a écrit :", ""]])
                lines += [f"> {x}" if x.startswith(">") else f"> > {x}" for x in quoted[parent][: rng.randint(0, 2)]]
                own = said[parent]
                kind = rng.randrange(4)
                first = own[0].split("\n")
                part = [own[0].upper().split("\n"), [first[0]], [first[1].split(". ")[0] + "."], [x for p in own[:2] for x in p.split("\n")]][kind]
                lines += [f"> {x}" for x in part] + [""]
            paragraphs = [f"line one of {conv} {turn} {k}\nfirst sentence number {conv} {turn} {k}. then another one of {conv} {turn} {k}." for k in range(3)]
            rows.append((conv, turn, "u", "\n".join(lines) + "\n" + "\n\n".join(paragraphs), "x"))
            said.append(paragraphs)
            quoted.append([x[2:] for x in lines if x.startswith("> ") and not x.startswith("> >")])
            up = truth.get((conv, parent))
            truth[conv, turn] = (parent, up[1] if up else turn, up[2] + 1 if up else 0, "\n\n".join(paragraphs))
    rows.append((0, 10_000, "u", "> " + "never said before " * 40_000 + "\nok", "x"))
    truth[0, 10_000] = (None, 10_000, 0, "ok")
    frame = spark.createDataFrame(rows + rows[:5], "conv_id long, turn long, role string, text string, said string")
    got = quotes.link_quotes(frame).collect()
    assert len(got) == len(rows) + 5
    for r in got:
        assert (r.parent_turn, r.root_turn, r.depth, r.body) == truth[r.conv_id, r.turn]


def test_long_reply_chain(spark):
    chain = [(1, t, "u", f"> line {t - 1}\nline {t}" if t else "line 0") for t in range(70)]
    got = quotes.link_quotes(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.depth == r.turn and r.root_turn == 0 for r in got)


# 8 ---------------------------------------------------------------------------------------------------------------------


def test_langid(spark, docs, none):
    rng = random.Random(8)
    sounds = {"aa": ["the", "and", "ing", "tion", "er"], "bb": ["ç", "eau", "oi", "que", "é"], "cc": ["sch", "ung", "ü", "ein", "der"]}
    made = [(i, " ".join("".join(rng.choices(sounds[k], k=rng.randint(1, 4))) for _ in range(30)), k) for i in range(240) for k in [sorted(sounds)[i % 3]]]
    frame = spark.createDataFrame([*made, (1000, None, "aa"), (1001, "", "aa"), (1002, "12 !! 3", "aa"), (None, "the and", None), (1003, "x" * 5000, "bb")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(frame).collect()}
    assert len(got) == 245 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    held = [(i, k) for i, _, k in made if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and sum(got[i].lang_pred == k for i, k in held) > 0.97 * len(held)
    assert langid.identify(frame.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred != 'und'").count() == 0
    assert langid.identify(none).count() == 0
    twice = langid.identify(frame.unionByName(frame).withColumn("score", F.lit(1)).withColumn("words", F.lit("w"))).groupBy("doc_id").agg(F.countDistinct("lang_pred", "score").alias("n"), F.count("*").alias("rows")).collect()
    assert all(r.n == 1 and r["rows"] == 2 for r in twice)


def test_rare_languages_are_learnt_from_all_their_rows(spark):
    rng = random.Random(81)
    made = [(i, " ".join("".join(rng.choices(["the", "ing", "er"], k=3)) for _ in range(12)), "big") for i in range(400)] + [(1000 + i, " ".join("".join(rng.choices(["ž", "ě", "ř"], k=3)) for _ in range(12)), "rare") for i in range(8)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = langid.learnt(frame, lambda i: i >= 0, train_docs=20)
    assert model.langs == ["big", "rare"] and np.allclose(model.prior, [400 / 408, 8 / 408])
    assert langid.predicted(frame.filter("lang = 'rare'"), model).filter("lang_pred = 'rare'").count() == 8


def test_forward_sums_all_segmentations():
    vocabulary = langid.pieces(langid.VOCABULARY)
    rng = np.random.default_rng(0)
    p = rng.random((len(vocabulary.texts), 2))
    p /= p.sum(axis=0)
    index = {t: i for i, t in enumerate(vocabulary.texts)}

    def brute(word, k):
        total = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            total[end] = sum(total[s] * p[index[word[s:end]], k] for s in range(end) if word[s:end] in index)
        return np.log(total[-1])

    words_ = [b" the", b" station", "  é".encode()[1:], b" x", b" " + b"in" * 29]
    got = langid.forward(words_, p, vocabulary)
    assert np.allclose(got, [[brute(w, k) for k in range(2)] for w in words_])
    # unspaced text of many scripts, cut where no piece crosses
    vowels = "aeiou"
    long = ["".join(rng.choice(list("漢字かな交じり文学研究所")) if rng.random() < 0.4 else "".join(rng.choice(list(vowels + "nstrl"), 6)) for _ in range(900)), "abc" + "漢" * 40, "x" * 5000, "station" * 400]
    for word in long:
        text = np.frombuffer(word.encode(), np.uint8)
        hashes, parts, codes, ptr = langid.word_list(text, np.array([0, len(text)]), vocabulary)
        assert b"".join(parts[c] for c in codes) == b" " + word.encode() and list(ptr) == [0, len(codes)]
        got = langid.forward(parts, p, vocabulary)[codes].sum(axis=0)
        scaled = []
        for k in range(2):
            total, logs, whole = [1.0], 0.0, b" " + word.encode()
            for end in range(1, len(whole) + 1):
                total.append(sum(total[-j] * p[index[whole[end - j : end]], k] for j in range(1, min(end, vocabulary.longest) + 1) if whole[end - j : end] in index))
                if total[-1] < 1e-200:
                    total, logs = [x * 1e200 for x in total[-vocabulary.longest - 1 :]], logs - 200 * np.log(10)
            scaled.append(np.log(total[-1]) + logs)
        assert np.allclose(got, scaled, rtol=1e-9)
    expected = np.zeros_like(p)
    langid.forward([b" the", b" it"], p, vocabulary, expected, np.ones((2, 2)))
    lengths = np.array([len(t) for t in vocabulary.texts])
    assert np.allclose((expected * lengths[:, None]).sum(axis=0), 4 + 3)  # each byte lies in one piece of every segmentation


# 9 ---------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<p>é</p>"), (2, None, None), (3, "http://b/\nx", ""), (4, "http://c/", "<p>é</p>"), (5, "http://d/", "z" * 100_000), (4, "http://c/", "<p>é</p>"), (None, "http://n/", "z" * 100_000)]
    frame = spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, digest string").repartition(2)
    folder = f"file://{tmp_path}/w"
    packages = warc.write_packages(frame, folder, zip64=True, package_bytes=100)
    index = warc.read_index(packages, folder)
    got = warc.read_records(index, folder, payloads=True).collect()
    html = {i: (h or "").encode() for i, _, h in pages}
    first = {}
    for i, h in sorted(((i, h) for i, h in html.items() if i is not None)):
        first.setdefault(h, i)
    assert len(got) == len(pages)
    for r in got:
        h = html[r.page_id]
        revisit = r.page_id != first[h]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", first[h] if revisit else None)
        assert r.payload == (None if revisit else h)
    path = packages.first().path
    with zipfile.ZipFile(path) as z:  # an independent reader agrees
        assert z.testzip() is None and set(z.namelist()) == {warc.DATA, warc.INDEX}
    assert warc.round_trip(frame.limit(0)).count() == 0 and warc.round_trip(frame).count() == len(pages)


def test_archives_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SPAN", 4096)
    rng = random.Random(9)
    frame = spark.createDataFrame([(i, f"http://h/{i}", "".join(rng.choices("abcdefgh", k=400))) for i in range(600)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    packages = warc.write_packages(frame, folder)
    assert packages.count() <= 4
    read = warc.read_records(warc.read_index(packages, folder), folder).withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in read.groupBy("task").count().collect()]
    assert sum(tasks) == 600 and len(tasks) > 8 and max(tasks) < 200


class _File(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_reads_packages_of_other_writers():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.comment = b"PK\5\6 in a comment"[:3] + b"!"
        with z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
            f.write(b"0123456789")
        z.writestr("b", b"xyz" * 100, zipfile.ZIP_DEFLATED)
    reader = warc.PackageReader(_File(data.getvalue()))
    assert reader.read("a", 3, 4) == b"3456"
    with pytest.raises(ValueError):
        reader.read("b")
    with pytest.raises(ValueError):
        warc.PackageReader(_File(b"no zip"))


# 10 --------------------------------------------------------------------------------------------------------------------


def near_brute(rows):
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = words(low(t))
        sets[i, t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = [k for k in sets if k[0] is not None]
    for n, a in enumerate(keys):
        for b in keys[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a[0]), root(b[0])))
                parent[y] = x
    return Counter((i, len(sets[i, t]), root(i) if i is not None else None, i is None or root(i) == i) for i, t in rows)


@pytest.mark.parametrize("side", [512, 3])
def test_near_dedup_matches_brute_force(spark, none, side, monkeypatch):
    monkeypatch.setattr(near_dedup, "SIDE", side)
    rng = random.Random(10)
    vocabulary = [f"v{k}" for k in range(400)]
    made = [(i, t) for i, t in enumerate(texts(5, 10))]
    for g in range(4):
        base = rng.choices(vocabulary, k=60)
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(60)] = rng.choice(vocabulary)
            made.append((100 + 20 * g + k, " ".join(copy)))
    made += [(None, made[-1][1]), (None, None)]
    frame = spark.createDataFrame([(*r, 1) for r in made], "doc_id long, text string, node long").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(frame).collect())
    assert got == near_brute(made)
    assert near_dedup.near_dedup(none).count() == 0 and near_dedup.keep_one_of_each(frame).columns == frame.columns


def _bucket(spark, frame):
    """All classes of frame as members of one bucket that no star links, and its links."""
    profiled = frame.mapInArrow(near_dedup._profile, near_dedup.PROFILE)
    classes = profiled.select(F.col("doc_id").alias("node"), "signature", "n_shingles").cache()
    members = classes.select(F.lit(5).cast("long").alias("band"), F.lit(0).alias("band_no"), "node")
    texts_ = near_dedup.candidate_texts(frame, members.select("node").distinct())
    return near_dedup.bucket_links(members, spark.createDataFrame([], "node long, comp long"), classes, texts_, 75, 1e-6).collect()


def test_links_of_a_large_bucket_are_a_forest(spark):
    rng = random.Random(12)
    vocabulary = [f"v{k}" for k in range(4000)]
    made = []
    for g in range(550):  # near pairs, far from each other
        base = rng.choices(vocabulary, k=40)
        made += [(2 * g, " ".join(base)), (2 * g + 1, " ".join([*base[:-1], "other"]))]
    got = _bucket(spark, spark.createDataFrame(made, "doc_id long, text string").repartition(4))
    assert sorted({tuple(sorted((r.a, r.b))) for r in got}) == [(2 * g, 2 * g + 1) for g in range(550)]
    same = [(i, " ".join(f"w{k + i % 7}" for k in range(100))) for i in range(1100)]  # all near all
    assert 1099 <= len(_bucket(spark, spark.createDataFrame(same, "doc_id long, text string"))) < 9 * 1024  # nine blocks


def test_near_dedup_at_default_sizes_on_a_bucket_of_over_1000(spark):
    rng = random.Random(13)
    base = [f"w{k}" for k in range(60)]
    made = [(i, " ".join([*base[: rng.randrange(3)], *base[3:58], f"t{i}"])) for i in range(1050)] + [(5000 + i, " ".join(rng.choices(base, k=60))) for i in range(50)]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(frame).collect())
    assert got == near_brute(made)


def test_pruning_bound_is_the_posterior():
    for n, least in zip(range(16, 129, 16), near_dedup.least_matches(75, 1e-6), strict=True):
        x = np.linspace(0, 1, 200_001)
        for m, below in ((least, False), (least - 1, True)):
            if m >= 0:
                density = x**m * (1 - x) ** (n - m)
                tail = density[x >= 0.75].sum() / density.sum()
                assert (tail < 1e-6) == below


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (103, 102)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


def test_near_rows_of_one_id_with_several_texts_keep_all_links(spark):
    rng = random.Random(3)
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")

    def near(words):
        out = list(words)
        out[rng.randrange(20, 40)] = "other"
        return " ".join(out)

    for one in (" ".join(a), " ".join(b)), (" ".join(b), " ".join(a)):
        rows = [(1, one[0]), (1, one[1]), (2, near(a)), (3, near(b)), (4, "alone " * 3), (5, None), (1, None)]
        got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    rows = [(7, " ".join(a)), (9, " ".join(a)), (9, " ".join(b)), (8, near(b)), (3, near(b))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {7: 3, 9: 3, 8: 3, 3: 3}


def test_partial_quotes_of_scripts_without_spaces(spark):
    said = "今天的天气非常好。我们应该去公园散步吗？也许明天更好。"
    rows = [(1, 0, "user", said), (1, 1, "assistant", "> 我们应该去公园散步吗？\n\n好的，走吧。"), (1, 2, "user", "> 好的\n\n可以"), (2, 0, "user", "ไปตลาดกันไหม\nวันนี้อากาศดีมากเลย"), (2, 1, "assistant", "> วันนี้อากาศดีมากเลย\nจริงด้วย")]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.n_linked) for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1] == (0, 1) and got[2, 1] == (0, 1) and got[1, 2] == (None, 0)  # two letters are no piece


def test_benchmark_items_of_all_sizes_from_one_split(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    items = [(f"i{n}", " ".join(rng.choices(words, k=n))) for n in (1, 2, 3, 4, 5, 9, 13, 20)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)) + (items[i % 8][1].split() if i % 3 else []) + rng.choices(words, k=5))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id string, text string"))
    expected = {}
    for i, text in docs:
        w, hit, held = text.split(), set(), set()
        for name, item in items:
            parts = item.split()
            m = min(13, len(parts))
            for o in range(len(parts) - m + 1):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == parts[o : o + m]:
                        hit |= set(range(p, p + m))
                        held.add(name)
        expected[i] = (len(hit), sorted(held))
    assert {r.doc_id: (r.n_hit, r["items"]) for r in got.collect()} == expected
    passed = decontaminate._matches(df, lambda m: m, [1, 2, 5])
    assert passed._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1


def test_periodic_texts_send_each_mark_once():
    import pyarrow as pa

    text = "a" * 50_000
    batch = lambda **c: iter([pa.RecordBatch.from_pydict(c)])
    out = next(suffix_dedup._survey(200)(batch(doc_id=[1], text=[text])))
    assert out.column(3)[0].as_py() == [{"mark": out.column(3)[0].as_py()[0]["mark"], "n": 50_000 - suffix_dedup.GRAM + 1}]
    out = next(substring_dedup._survey(13, 25)(batch(doc_id=[1], th=[2], text=["a " * 9000])))
    assert len(out.column(4)[0]) == 1
