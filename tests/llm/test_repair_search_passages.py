"""Turn repair, ranked search and passage trees against plain Python, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import passage_trees, threshold_search, turn_repair

RND = random.Random(11)
WORDS = ["".join(RND.choice("abcdef") for _ in range(RND.randint(1, 6))) for _ in range(300)]


def words(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---------------------------------------------------------------- conversations


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault): shortest path, least edits first."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while True:
        cost, audit, i, made, kept = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit, "\n".join(kept)
        state = (i, made[-1:], not made)
        if state in done:
            continue
        done.add(state)

        def push(c, letter, at, initial, turn):
            new = made + initial
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + c, audit + letter, at, new, kept + turn))

        for role in ("user", "assistant"):
            push(2, "I", i, role[0], (f"{role}:",))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, made, kept))
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                push(extra, "K", i + 1, role[:1] or "?", (f"{role}:{text}",))
                for other in ("user", "assistant"):
                    push(2 + extra, "R", i + 1, other[0], (f"{other}:{text}",))


def repaired_brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        judged, seen = [], set()
        for _, role, text in mine:
            held = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not held else "duplicate" if (role, text) in seen else "" if held[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [r[0] for r in mine if r[0] is not None]
        faults = Counter(f for *_, f in judged)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, text = cheapest(judged)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations():
    rows = []
    for conv in range(60):
        for turn in range(RND.randint(0, 9)):
            role = RND.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"])
            rows.append((conv, turn if RND.random() < 0.9 else None, role, RND.choice(["a.", "b", "b", "Well?", "", " \n", None, "é!\t", words(3) + "."])))
    for turn in range(400):  # one long conversation, with turns that repeat far apart
        rows.append((77, turn * 2, RND.choice(["user", "assistant"]), words(2) + RND.choice([".", "", "!"]) if turn % 9 else "again."))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (None, None, "user", None), (88, 5, "user", "x" * 5000 + ".")]
    rows += [(89, 7, "assistant", f"{'y' * 70}{k}.") for k in range(1)] + [(90, 1, "user", "twice.")] * 3
    return rows


def test_turn_repair(spark, tmp_path, many_parts):
    rows = conversations()
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, known int")
    table.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.op11_turn_repair(spark, str(tmp_path)).collect()}
    assert got == repaired_brute(rows)


def test_repaired_turns(spark, many_parts):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    edits = turn_repair.repair(turn_repair.damaged(table)).collect()
    want = repaired_brute(rows)
    for conv, (*_, audit, digest) in want.items():
        mine = sorted((r for r in edits if r["conv_id"] == conv), key=lambda r: r["place"])
        assert "".join(r["edit"] for r in mine) == audit
        text = "\n".join(f"{r['role']}:{r['text']}" for r in mine if r["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == digest


def test_one_conversation_over_all_tasks(spark, tmp_path, many_parts):
    rows = [(5, t, ["user", "assistant"][t % 2 if t % 7 else 1], f"{t % 50} ok.") for t in range(900)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = turn_repair.op11_turn_repair(spark, str(tmp_path)).collect()
    assert [tuple(r)[1:] for r in got] == [repaired_brute(rows)[5]]


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert turn_repair.op11_turn_repair(spark, str(tmp_path)).count() == 0


# ---------------------------------------------------------------- ranked search


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked_brute(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    count, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, x in items if i == item for t in terms_of(x)}
        scores = []
        for doc, c, n in held:
            m = 100 - 50 + (50 * n * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return out


@pytest.mark.parametrize("k", [1, 4, 50])
def test_threshold_search(spark, k):
    texts = [words(RND.randint(1, 80)) for _ in range(80)] + [words(3000), "Same TEXT é日本 x9", "same text é日本 x9", None, "", " .,; ", "common " * 40]
    texts = [t + " common" if t and len(t) > 30 else t for t in texts] + ["same text"] * 70
    docs = [(i * 2, t) for i, t in enumerate(texts)] + [(None, "same text"), (4, "same other")]
    items = [(1, words(8)), (2, "same Text, same"), (3, "common"), (4, None), (5, "unheard-of-term"), (6, words(30) + " common same"), (6, "é日本"), (7, words(1))]
    got = threshold_search.search(
        spark.createDataFrame([(*d, 5, "n") for d in docs], "doc_id long, text string, n int, term string").repartition(4),
        spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id int"),
        k,
    )
    none = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(none, (tuple(r) for r in got.collect()))) == sorted(map(none, ranked_brute(docs, items, k)))


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert threshold_search.search(none, items).count() == 0
    assert threshold_search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0


# ---------------------------------------------------------------- passages


def passages_brute(docs, length):
    first = {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(w) - length + 1):
            if doc is not None:
                s = tuple(w[i : i + length])
                first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - length + 1):
            if doc is not None and first[tuple(w[i : i + length])] < doc:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def near(text, changes):
    out = text.split()
    for _ in range(changes):
        out[RND.randrange(len(out))] = RND.choice(WORDS)
    return " ".join(out)


PHRASE, PASSAGE, BASE = words(14), words(70), words(260)
PASSAGE_DOCS = (
    [None, "", " \t\n", words(49), words(50), "w " * 300, BASE, BASE, BASE.upper(), BASE.replace(" ", " \n\x0b", 20), "z" * 900 + " " + BASE]
    + [near(BASE, k) for k in (1, 1, 2, 3, 5, 8, 13)]
    + [f"{words(40)} {PHRASE} {words(40)}" for _ in range(30)]
    + [f"{words(10)} {PASSAGE} {words(20)}" for _ in range(12)]
    + [f"{PASSAGE} {PASSAGE}", "w " * 120, PASSAGE + " é日本", words(4000) + " " + PASSAGE]
)


@pytest.mark.parametrize("group", [passage_trees.GROUP, 3, 1])
def test_passage_trees(spark, group):
    docs = [((7 * i) % 101, t) for i, t in enumerate(PASSAGE_DOCS)]
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, version string, h int").repartition(5)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in passage_trees.remove_passages(table, group=group).collect())
    assert got == sorted(passages_brute(docs, 50))
    assert sum(r[2] for r in got) > 1000


def test_passages_of_other_lengths_and_repeated_ids(spark):
    docs = [(3, PASSAGE), (3, PASSAGE), (3, f"x {PASSAGE} y"), (1, near(PASSAGE, 3)), (9, f"{PASSAGE} {words(5)}"), (None, PASSAGE), (2, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    for length, gram in ((50, 10), (12, 4), (2, 1)):
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in passage_trees.remove_passages(table, length, gram, group=2).collect()]
        assert sorted(got, key=key) == sorted(passages_brute(docs, length), key=key)
    assert passage_trees.remove_passages(table.limit(0)).count() == 0


def test_subtree_depths():
    import numpy as np

    text = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 1, 2, 3], np.uint64)
    order, depth = passage_trees.subtree(text, np.arange(len(text)), 4)
    shared = lambda a, b: next((n for n in range(20) if max(a, b) + n >= len(text) or text[a + n] != text[b + n]), 20)
    assert all(min(d, 7) == min(shared(a, b), 7) for d, a, b in zip(depth[1:], order, order[1:]))
