"""Filter audit, mixing and the prefix trie against brute-force versions, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthospark.llm import filter_audit, mixing, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names of columns that the operators use inside, as further columns of the input.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key double, own string, mask string, words string, bucket long, size string"
LABELS = "doc_id long, quality int, toxic int, text string, source string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, None, None, "m", None, 1, None) for i, t, lang, s in rows], DOCS).repartition(3)


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    words = ["The", "of", "ÀB", "x", "USA", "#tag", "a&b", "naïve"] + ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(150)]
    texts = [" ".join(rng.choice(words[: rng.choice([12, 160])]) for _ in range(rng.choice([3, 90, 100, 130]))) + rng.choice(["", "\n", " \x0b"]) for _ in range(n // 3)]
    texts += ["", None, " \t\n", "A B C", "w " * 30_000]
    rows = [(i, texts[0] if i % 3 == 0 else rng.choice(texts), rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "Z", "", None, "é", "big", "big", "big"])) for i in range(n)]
    # Repeated rows, two texts under one id, and a row without an id.
    return [*rows, rows[0], rows[7], (5, "another text", "en", "a"), (None, "no id", "en", "a"), (-4, texts[0], "fr", "big")]


LABELLED = [(0, 1, 0), (3, 1, 1), (4, 0, 1), (6, None, None), (7, 0, 1), (7, 1, 0), (9, 1, None), (None, 1, 1), (5, 0, 0), (-4, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(*r, "x", None) for r in LABELLED], LABELS)


def failures(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang, _ in rows:
        if i is None:
            continue
        t = t or ""
        w = WORD.findall(t)
        failed = "".join(x for x, bad in zip("ABCDE", [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), i > first[t]], strict=True) if bad)
        yield lang or "", failed, any(r[0] == i and r[1] == 1 for r in LABELLED), any(r[0] == i and r[2] == 1 for r in LABELLED)


def test_filter_audit(spark, labels):
    rows = corpus()
    want = defaultdict(Counter)
    for part, failed, good, toxic in failures(rows):
        for order in itertools.permutations("ABCDE"):
            out = False
            for step, f in enumerate(order, 1):
                c = want[part, "".join(order), step]
                here = f in failed
                c["removed"] += here and not out
                c["redundant"] += here and out
                c["unique_fails"] += failed == f
                c["good_lost"] += here and not out and good
                c["toxic_lost"] += here and not out and toxic
                out |= here
                c["kept"] += not out
    for (part, order, step), c in want.items():
        c["shapley"] = sum(d["removed"] for (p, o, s), d in want.items() if p == part and o[s - 1] == order[step - 1])
    for most_cells in (1 << 15, filter_audit.MOST_CELLS):
        got = filter_audit.audit(documents(spark, rows), labels, most_cells).collect()
        assert len(got) == len(want) == 600 * 4
        assert all(r[k] == want[r.part, r.filter_order, r.step][k] for r in got for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def test_filter_audit_of_nothing(spark, labels):
    assert filter_audit.audit(documents(spark, []), labels).count() == 0
    assert filter_audit.audit(documents(spark, [(None, "x", "en", "a")]), labels.limit(0)).count() == 0
    got = filter_audit.audit(documents(spark, [(1, None, None, None), (2, "", None, "a")]), labels.limit(0)).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed, r.redundant, r.shapley) for r in got] == [("", 1, 1, 0, 60), ("", 0, 1, 1, 180), *[("", 0, 0, 0, 0)] * 3]


def test_sketch_clears_only_unique_keys(spark):
    """Every repeated key passes at every size of the sketch; of unique ones most are cleared while it isn't full."""
    rng = np.random.default_rng(1)
    unique, twice = rng.integers(-(1 << 63), 1 << 63, 3000), rng.integers(-(1 << 63), 1 << 63, 200)
    keys = spark.createDataFrame([(int(k),) for k in [*unique, *twice, *twice, 0, 0, -1, -1]], "key long").repartition(4)
    for most, least_cleared in ((1 << 15, 0.5), (1 << 29, 0.95)):
        may = filter_audit.may_repeat(spark, keys, most)
        passed = Counter(r.key for r in keys.where(may("key")).collect())
        assert all(passed[int(k)] == 2 for k in [*twice, 0, -1])
        assert sum(passed[int(k)] == 0 for k in unique) >= least_cleared * len(unique)


def aims(sizes, weights=mixing.WEIGHTS):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return {s: 3.0 * sizes[s] for s in names}
        share = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if weight[s] * share > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * share for s in names}
        full |= over


@pytest.mark.parametrize("buckets", [1, 7, 256])
def test_mix(spark, labels, buckets):
    rows = [*((i, t, lang, "big" if len(t or "") > 10_000 else s) for i, t, lang, s in corpus(8)), (7777, "w " * 40_000, "en", "big")]
    read = [(i, s, len(WORD.findall(t or ""))) for i, t, _, s in rows if i is not None]
    sizes = Counter()
    for _, s, n in read:
        sizes[s] += n
    want = aims(sizes)
    assert any(want[s] == 3 * sizes[s] for s in sizes) and any(want[s] < sizes[s] for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    good = {i: max(q for j, q, _ in LABELLED if j == i and q is not None) for i in {j for j, q, _ in LABELLED if q is not None}}
    expected = []
    for s in sizes:
        def key(r):
            u = (int(hashlib.md5(f"{r[0]}:{mixing.SEED}".encode()).hexdigest()[:13], 16) + 1) / 2**52
            return -math.log(u) / {1: mixing.GOOD, 0: mixing.BAD}.get(good.get(r[0]), mixing.UNKNOWN), r[0], r[2]

        spent, epochs = 0, int(want[s] // sizes[s]) if sizes[s] else 0
        left = math.floor(want[s] + 0.5) - epochs * sizes[s]
        for i, _, n in sorted((r for r in read if r[1] == s), key=key):
            expected.append((i, n, sizes[s], round(want[s], 6), epochs * n + max(0, min(n, left - spent))))
            spent += n
    got = mixing.mix(documents(spark, rows), labels, buckets=buckets)
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect()) == sorted(expected)
    taken = Counter()
    for r in got.collect():
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_mix_of_nothing(spark, labels):
    assert mixing.mix(documents(spark, []), labels).count() == 0
    got = mixing.mix(documents(spark, [(1, None, None, None), (2, " ", "e", "a"), (None, "x y", "e", "a")]), labels.limit(0)).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert [(r.taken, r.target) for r in mixing.mix(documents(spark, [(1, "x y z", "e", "a")]), labels).collect()] == [(3, 3.0)]


def test_good_documents_come_earlier(spark):
    rows = [(i, "w", "en", "big") for i in range(4000)] + [(9000 + i, "w w w w", "en", "small") for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0, "", "") for i in range(4000)], LABELS)
    got = [r for r in mixing.mix(documents(spark, rows), labels).collect() if r.source == "big"]
    taken = [sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert 1.2 * taken[1] < taken[0] and got[0].target < got[0].source_size


CONVERSATIONS = "conv_id long, turn long, role string, text string, path int, node string, turns string, block string, base int"


def talks(seed=4):
    rng = random.Random(seed)
    said = [(rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "", None, "a b", "a  b c", "ü"])) for _ in range(12)] + [("u", "r:x"), ("ur", ":x")]
    rows = []
    for c in [*range(0, 90), 200, 217, 1000, 1001, 5000]:
        if c in (40, 61):
            continue
        turns = [said[0]] * 2 if c % 3 == 0 else [rng.choice(said[:3]) for _ in range(rng.randrange(1, 7))]
        turns = turns if c != 71 else [rng.choice(said) for _ in range(300)]
        order = list(range(len(turns)))
        if c % 7 == 0:
            order[0] = None
        rows += [(c, o, *t) for o, t in zip(order, turns, strict=True)]
    rows += [(2, 0, *said[0]), (2, 0, *said[0]), (2, 0, *said[5]), (None, 0, "user", "x")]
    rng.shuffle(rows)
    return rows


def nodes_of(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(members[n]) - 1) * len(WORD.findall(n[-1][1])) if n else 0
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest())
        for n in members
    )


@pytest.mark.parametrize("shard_turns", [3, 40, 100_000])
def test_prefix_trie(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 4)
    rows = talks()
    df = spark.createDataFrame([(*r, None, None, "t", "b", 3) for r in rows], CONVERSATIONS).repartition(5)
    got = sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.shared_prefixes(df).collect())
    assert got == nodes_of(rows)


def test_prefix_trie_of_little(spark):
    of = lambda rows: sorted(map(tuple, prefix_trie.shared_prefixes(spark.createDataFrame([(*r, 1, "", "", "", 2) for r in rows], CONVERSATIONS)).collect()))
    assert of([]) == [] == of([(None, 1, "a", "b")])
    # Conversation 1 has h = 3 and no base: nothing is left of its single turn.
    assert zlib.crc32(b"1") % 4 == 3
    assert of([(1, 0, "u", "x y")]) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())] == nodes_of([(1, 0, "u", "x y")])


def test_trees_are_balanced():
    """Medians first: the way to a child among n siblings is about log2(n) long."""
    trie = prefix_trie.Trie()
    for m in prefix_trie.medians_first(1023):
        trie.insert([m, m % 7], 1, m, "")
    longest, todo = 0, [(trie.below[0], 1)]
    while todo:
        node, steps = todo.pop()
        longest = max(longest, steps)
        todo += [(x, steps + 1) for x in (trie.low[node], trie.high[node]) if x]
    assert longest == 10 and sorted(prefix_trie.medians_first(50)) == list(range(50))


def test_ids_stream_into_one_digest(spark):
    """Members of one sequence over many blocks are hashed in ascending order."""
    ids = random.Random(2).sample(range(30_000), 9_000)
    df = spark.createDataFrame([(i,) for i in ids], "conv_id long").select("conv_id", F.array(F.struct(F.unhex(F.lit("ab" * 16)).alias("code"), F.lit(2).alias("words"))).alias("turns"))
    got = {r.depth: r for r in prefix_trie.trie(df).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest() and (got[1].saved_tokens, got[0].n_convs, got[0].n_leaves) == (2 * 8999, 9000, 1)
