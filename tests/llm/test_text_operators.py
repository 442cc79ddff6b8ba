"""The text operators against brute force, on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import jaccard_join, packing, pii, suffix_dedup

RND = random.Random(5)
WORDS = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 7))) for _ in range(400)]


def words(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


PASSAGE = words(60)
BASE = words(120)


def near(text, changes):
    out = text.split()
    for _ in range(changes):
        out[RND.randrange(len(out))] = RND.choice(WORDS)
    return " ".join(out)


TEXTS = (
    [None, "", " \n\t ", "one", "one", "One two three", "x" * 500, "ab" * 300, BASE, BASE, BASE.upper()]
    + [near(BASE, k) for k in (1, 1, 2, 2, 3, 4, 5, 6)]
    + [words(30) + " " + PASSAGE + " " + words(30) for _ in range(6)]
    + [words(50) for _ in range(6)]
    + [PASSAGE + " é ü 日本 " + PASSAGE, words(8000)]
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", "s", len(t or ""), "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_id string, h int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(docs, empty, hot):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, hot_segments=hot).collect()}
    seen = set()
    for i, text in enumerate(TEXTS):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        r = got[i * 3]
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest()), i
        assert r["n_spans"] == len(re.findall(b"\1+", bytes(gone)))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def removed(rows):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_removed"]))]


def test_suffix_dedup_of_repeated_and_missing_ids(spark):
    """A text under an id that another row has is still seen; equal rows keep one text; rows without id keep theirs."""
    p, a = words(150)[:600], words(150)[:640]
    docs = spark.createDataFrame([(1, p), (2, a), (2, p), (2, None), (3, p), (3, p), (None, p)], "doc_id long, text string")
    n = len(p)
    got = removed(suffix_dedup.remove_repeats(docs).collect())
    assert got == [(1, n, 0), (2, 0, 0), (2, n, n), (2, 640, 0), (3, n, n), (3, n, n), (None, n, 0)]
    again = suffix_dedup.remove_repeats(spark.createDataFrame([(5, p), (5, p)], "doc_id long, text string")).collect()
    assert removed(again) == [(5, n, 0), (5, n, n)]


def test_suffix_dedup_of_a_hot_phrase(spark):
    """A phrase under 100 bytes in every text, with other text around it, and one longer passage: split groups agree with brute force."""
    phrase, long = words(20)[:70], words(40)[:130]
    texts = [f"{words(15)} {phrase} {words(15)}" + (f" {long} {words(5)}" if i % 5 == 0 else "") for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    seen, want = set(), []
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            w = t[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        want.append((i, len(t), sum(gone)))
    assert sum(x[2] for x in want) > 0
    for hot in (5, 10**6):
        assert removed(suffix_dedup.remove_repeats(docs, hot_segments=hot).collect()) == want


def test_merge_needs_no_text():
    raw = np.frombuffer(b"abcab" * 60, np.uint8)
    names = suffix_dedup.block_names(raw, 20)
    same = defaultdict(set)
    for i in range(len(raw) - 20):
        same[raw[i : i + 20].tobytes()].add(int(names[i]))
    assert all(len(v) == 1 for v in same.values())
    assert len({next(iter(v)) for v in same.values()}) == len(same)


def jaccard_brute(texts):
    """(set size, smallest linked id) by id, from all pairs."""
    sets = {}
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == jaccard_brute({i * 3: text for i, text in enumerate(TEXTS)})
    assert jaccard_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("region_rows", [1024, 7])
def test_jaccard_join_of_near_copies_in_small_blocks(spark, region_rows):
    """Chains of copies on both sides of the threshold; blocks hold about three sets, regions are whole or in parts."""
    texts = [BASE]
    for _ in range(90):
        texts.append(near(RND.choice([BASE, RND.choice(texts)]), RND.randint(1, 5)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets, edges = jaccard_join.jaccard_links(rows, block=400, region_rows=region_rows)
    brute = jaccard_brute(dict(enumerate(texts)))
    root = {i: i for i in brute}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges.collect():
        x, y = sorted((find(r["a"]), find(r["b"])))
        root[y] = x
    assert {r["doc_id"]: (r["n"], find(r["doc_id"])) for r in sets.collect()} == brute
    assert 2 < len({c for _, c in brute.values()}) < 60


def test_jaccard_join_near_the_threshold_at_different_sizes(spark):
    """Sets between about 60 and 300 shingles, many of them just above and just below a link, against all pairs."""
    rnd, texts = random.Random(11), []
    for b in range(6):
        base = [f"w{b}x{rnd.randrange(10**6)}" for _ in range(rnd.choice([64, 130, 240]))]
        for k in range(14):
            mine = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 45))):
                mine[rnd.randrange(len(mine))] = f"n{rnd.randrange(10**6)}"
            mine += [f"t{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, len(base) // 5))] if k % 2 else []
            texts.append(" ".join(mine[: rnd.randint(len(mine) * 4 // 5, len(mine))] if k % 3 == 0 else mine))
    ids = rnd.sample(range(1_000), len(texts))
    rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    brute = jaccard_brute(dict(zip(ids, texts)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(rows).collect()} == brute
    assert 10 < len({c for _, c in brute.values()}) < 70


def test_jaccard_join_of_common_passages_visits_no_regions(spark, monkeypatch):
    """Texts that have a passage in common, and nothing else, aren't replicated; near copies among them still meet, once each."""
    made, rnd = defaultdict(list), random.Random(12)

    def kept(df, name, **options):
        made[name].append(keep(df, name, **options))
        return made[name][-1]

    keep = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", kept)
    passage = [f"p{k}" for k in range(16)]
    texts = [" ".join([f"a{rnd.randrange(10**7)}" for _ in range(50)] + passage + [f"b{rnd.randrange(10**7)}" for _ in range(50)]) for _ in range(200)]
    texts += [t + " more" for t in texts[:20]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(rows).collect()}
    assert got == {i: i - 200 if i >= 200 else i for i in range(220)}
    assert made["regions"][0].count() <= 40  # 220 if all holders of the passage met
    # Members of regions that hold several components are worked out once for each turn.
    assert len(made["split"]) == 2


def test_jaccard_join_of_words_that_fool_polynomials(spark):
    """Thue-Morse words and their complements collide in any polynomial hash modulo 2**64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = spark.createDataFrame([(1, word), (2, other), (3, word), (None, word)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(rows).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_joining_links_match_all_pairs():
    """Blocks by themselves: the links joined are those that all pairs of outsiders and members give."""
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([rnd.choice(base, 60, False), base[:110]])) for _ in range(40)]
    held = [(role, i, i % 17, x) for role in (0, 1) for i, x in enumerate(sets)]
    out = jaccard_join._joining_links(held, 80)
    root = list(range(17))
    full = list(range(17))

    def find(of, x):
        while of[x] != x:
            x = of[x]
        return x

    for x, y in zip(out["a"].to_pylist(), out["b"].to_pylist()):
        n = len(np.intersect1d(sets[x], sets[y]))
        assert 100 * n >= 80 * (len(sets[x]) + len(sets[y]) - n) and find(root, x % 17) != find(root, y % 17)
        root[find(root, x % 17)] = find(root, y % 17)
    for x in range(40):
        for y in range(40):
            n = len(np.intersect1d(sets[x], sets[y]))
            if 100 * n >= 80 * (len(sets[x]) + len(sets[y]) - n):
                full[find(full, x % 17)] = find(full, y % 17)
    groups = lambda of: {frozenset(c for c in range(17) if find(of, c) == r) for r in map(lambda c: find(of, c), range(17))}
    assert groups(root) == groups(full)


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    by, seq = defaultdict(list), defaultdict(list)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_files()[0])
    tokenizer.encode_special_tokens = True
    ids = {i * 3: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in enumerate(TEXTS)}
    for r in rows:
        by[r["doc_id"]].append((r["start"], r["length"]))
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, x in ids.items():
        at = 0
        for start, length in sorted(by[i]):
            assert start == at
            at += length
        assert at == len(x)
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


def test_packing_gives_added_tokens_their_own_id(spark):
    """Ids as the tokenizer gives them by itself, without a flag."""
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end + end, f"\n{end}\n  x {end}'s  ", f"{end[:-1]} {end[1:]} é{end}日", "plain"]
    tokenizer = Tokenizer.from_file(packing.default_files()[0])
    ids = [np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for t in texts]
    assert ids[0].tolist() == [64, 220, 50256, 275, 1]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    for r in rows:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())


def test_packing_takes_long_runs_of_white_space(spark):
    """A million blanks on end; the tokenizer encodes them, tiktoken's pattern overflows its stack."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_files()[0])
    blanks = " " * 1_100_000
    texts = [f"a{blanks}b  c", f"it's{blanks}\n", f"x{blanks}<|endoftext|>\u3000{' ' * 70_000}\u00e9 1\x1c" + "\t" * 70_000, "plain"]
    ids = [np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for t in texts]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    for r in rows:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())


def test_packing_encodes_unseen_words_without_python_for_each():
    """CPU of whole texts of new words against that of cutting these into words alone."""
    import time

    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    rnd = random.Random(11)
    texts = [" ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(4, 9))) for _ in range(20_000)) for _ in range(4)]
    encoder = packing.TextEncoder(*packing.default_files())
    cut = regex.compile(public_tokenizers.PATTERN).findall
    assert encoder.ids("warm up") and cut("warm up")
    shares = []
    for text in texts:
        begin = time.process_time()
        words = cut(text)
        between = time.process_time()
        ids = encoder.ids(text)
        shares.append((time.process_time() - between) / (between - begin))
        assert len(words) == 20_000
    assert ids == np.array(Tokenizer.from_file(packing.default_files()[0]).encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert min(shares) < 4


def test_least_squares_fill_the_window():
    histogram = np.zeros(2048, np.int64)
    histogram[[1000, 1048, 500, 700, 848]] = [10, 7, 20, 20, 20]
    layout = packing.Layout(histogram, 2048)
    assert (layout.taken <= histogram).all() and layout.taken[500] == layout.taken[700] == layout.taken[848] > 10
    assert layout.taken[1000] == layout.taken[1048] == 7


PII = [
    "mail a.b@c.de, a@b, x@y@z.com and a@b.c_d@e.f",
    "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 000255.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, " + "7" * 4000,
    "phone +1 (800) 555-1234, +12, +1-2-3-4-5-6-7-8-9-0 é 日本 +49 30 1234567",
    "Contact quickly borogrove a.b@c.de vorpal sword",
    "Contact quickly borogrove a.b@c.de vorpal sword",
    None,
    "",
]


def test_pii_patterns(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(PII)], "doc_id long, text string, kind int")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
            return 14 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    for i, text in enumerate(PII):
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns.values()) for m in re.finditer(p, text or "") if good(list(patterns)[k], m[0]))
        listed = ",".join(f"{list(patterns)[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (i, listed, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in patterns] == [sum(s[1] == j for s in spans) for j in range(4)]
    # Words that occur only beside the shared address reveal it.
    assert "term:" in got[4]["spans"] and got[4]["spans"] == got[5]["spans"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "a.b@c.de" not in clean[4] and "[EMAIL]" in clean[4] and clean[7] == ""
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_pii_terms_of_whole_texts(spark):
    """Terms by the definition, counted over whole texts; entities of two documents and of a third of all."""
    rnd = random.Random(11)
    some = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = []
    for i in range(90):
        text = [rnd.choice(some) for _ in range(rnd.randint(5, 60))]
        if i % 3 == 0:
            text[1] = "hot@all.org"
        if i % 10 == 0:
            text += [f"p{i // 20}@one.org", *[rnd.choice(some) for _ in range(40)], f"Far{'qrstu'[i // 20]}", "x", f"far{'qrstu'[i // 20]}"]
        texts.append(" ".join(text))
    words = [{w.lower() for w in re.findall(r"[A-Za-z]{3,}", t)} for t in texts]
    held = [set(re.findall(r"[a-z0-9]+@[a-z]+\.org", t)) for t in texts]
    total = len(texts)
    found = defaultdict(dict)
    for e in set().union(*held):
        n_entity = sum(e in h for h in held)
        for w in set().union(*(x for x, h in zip(words, held) if e in h)):
            n_both, n_term = sum(e in h and w in x for h, x in zip(held, words)), sum(w in x for x in words)
            pmi, content = np.log(total * n_both / (n_entity * n_term)), np.log(total / n_entity)
            if n_both >= 2 and pmi >= 0.9 * content:
                for i in range(total):
                    if e in held[i] and w in words[i]:
                        found[i][w] = found[i].get(w, False) or pmi >= 0.98 * content
    assert found[0]["farq"] and len(texts[0]) > 240 and any(len(f) > 2 for f in found.values())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        text = texts[r["doc_id"]]
        base = [m.span() for m in re.finditer(r"[a-z0-9]+@[a-z]+\.org", text)]
        want = [m.span() for m in re.finditer(r"[A-Za-z]{3,}", text) if m[0].lower() in found[r["doc_id"]] and not any(a < m.end() and m.start() < b for a, b in base)]
        assert [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("term")] == want
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert not re.search("farq", clean[0], re.I) and not re.search("farq", clean[10], re.I) and clean[1] == texts[1]


def test_pii_of_address_lists(spark):
    """Two texts with the same long list of addresses, and one with half of it: pairs are of classes, and spans are those of the definition."""
    listing = [f"user{'abcdefghij'[k % 10]}{k}@host{k % 7}.example.org" for k in range(20000)]
    texts = [" ".join(["Zanzibar", *listing]), " ".join(["zanzibar", *listing, "é"]), " ".join(listing[:10000] + ["Quixotic"])]
    texts += [f"plain words {words(20)}" for _ in range(19)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for i in range(3):
        base = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", texts[i])]
        assert got[i]["n_email"] == len(base)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"email:{a}:{b}" for a, b in base).encode()).hexdigest()
        assert ("term:0:8" in got[i]["spans"]) == (i < 2)  # in the two texts that share the second half of the list, and nowhere else
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0].replace(" ", "").replace("[EMAIL]", "").replace("[TERM]", "") == "" and clean[1].endswith(" é") and clean[2].endswith(" Quixotic")
    assert clean[0].count("[EMAIL]") == 20000 and clean[21] == texts[21]


def test_pii_with_many_hot_keys(spark, monkeypatch):
    """Where more keys are hot than may be sent to every task, spans stay the same."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PII * 3)], "doc_id long, text string")
    few = sorted((r["doc_id"], r["spans"]) for r in pii.find_pii(docs).collect())
    monkeypatch.setattr(pii, "HOT_KEYS", 0)
    assert sorted((r["doc_id"], r["spans"]) for r in pii.find_pii(docs).collect()) == few
