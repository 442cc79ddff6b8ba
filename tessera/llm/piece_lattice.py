"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice.

The vocabulary's pieces are the edges of a text's lattice, their scores add up. A forward Viterbi pass
gives each place its best score from the start; these are the exact heuristics of an A-star search
backward from the end, which so yields segmentations in order of score. Equal scores are ordered by
ids, read from the last piece to the first; this one rule holds for words and whole texts.

No piece spans a border between two characters that no piece holds side by side. So a text's lattice is a chain of segment lattices: a
segment is solved once per worker, and a text's N best combine the N - 1 segments whose second choice
comes first. Paths are back-pointers, so a segment of a whole long text costs memory in proportion.

A character without a piece costs ``UNKNOWN`` below the worst score and becomes byte pieces. A space
is put before the text, and the meta symbol counts as a space. A null or empty text has one
segmentation, of no pieces. Repeated rows are encoded each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import plain_rows, text_steps

BEST = 3
UNKNOWN = 10.0
META = "▁"
#: Words, and segments, that a worker remembers (checked between steps).
CACHE = 300_000
#: Characters from which a word isn't remembered, and a segment is solved by itself.
LONG = 64
_WORD = re.compile(" +[^ ]*")
_LOW = float("-inf")
_NEAR = 1e-9


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Flat:
    """Rows of small integers, one after another in an array that grows by doubling."""

    def __init__(self) -> None:
        self.data, self.begin, self.size = np.zeros(1 << 16, np.uint16), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.rows = self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of the new rows, whose elements stand one after another in ids."""
        while self.used + len(ids) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.rows + len(sizes) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.data[self.used : self.used + len(ids)] = ids
        rows = np.arange(self.rows, self.rows + len(sizes))
        self.begin[rows], self.size[rows] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.rows += len(sizes)
        return rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all elements of the rows, where each row starts: n + 1 offsets)."""
        size = self.size[rows]
        off = np.concatenate([[0], np.cumsum(size)])
        return self.data[np.repeat(self.begin[rows] - off[:-1], size) + np.arange(off[-1])], off


class Pieces(dict):
    """A vocabulary with scores; segmentations of words and texts. As a dict: words to their segments' numbers, remembered."""

    def __init__(self, model: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        edges = {m.id_to_piece(i).replace(META, " "): (i, m.get_score(i)) for i in plain}
        self.load(edges, {int(m.id_to_piece(i)[3:5], 16): i for i in range(m.vocab_size()) if m.is_byte(i)}, m.unk_id(), m.vocab_size())

    def load(self, edges: dict[str, tuple[int, float]], bytes_at: dict[int, int], unknown: int, size: int) -> None:
        self.edges, self.bytes_at, self.unknown = edges, bytes_at, unknown
        self.worst = min((s for _, s in edges.values()), default=0.0) - UNKNOWN
        #: By the first two characters, the longest piece that begins so; and pairs that stand in some piece.
        self.reach: dict[str, int] = {}
        self.inside = np.array(sorted({ord(e[k]) << 21 | ord(e[k + 1]) for e in edges for k in range(len(e) - 1)} or {-1}), np.int64)
        # Words begin at spaces, unless some piece holds a space after another character.
        self.words = (lambda t: [t]) if any(re.search("[^ ] ", e) for e in edges) else _WORD.findall
        for e in edges:
            self.reach[e[:2]] = max(self.reach.get(e[:2], 0), len(e))
        spelled = {i: t.encode("utf-8", "surrogatepass") for t, (i, _) in edges.items()} | {i: bytes([b]) for b, i in bytes_at.items()}
        parts = [spelled.get(i, b"") for i in range(size)]
        self.size = np.array([len(x) for x in parts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.spelled = np.frombuffer(b"".join(parts), np.uint8)
        # The pieces as a trie: sorted (node, character) keys, the node behind each, and its piece.
        nodes = {"": 0}
        for e in edges:
            for k in range(len(e)):
                nodes.setdefault(e[: k + 1], len(nodes))
        keys = np.array([nodes[t[:-1]] << 21 | ord(t[-1]) for t in nodes if t], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], (order + 1).astype(np.int64)
        self.piece, self.worth = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes))
        for e, (i, score) in edges.items():
            self.piece[nodes[e]], self.worth[nodes[e]] = i, score
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.score, self.loss, self.row = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        self.best = _Flat()
        self.lists: dict[tuple[int, int], list[tuple[float, tuple[int, ...], int]]] = {}

    # ------------------------------------------------------------ one lattice

    def _unknown_ids(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes_at.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass"))

    def arcs(self, word: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each place, the edges that end there: (start, ids, score)."""
        n = len(word)
        into: list[list] = [[] for _ in range(n + 1)]
        get, reach = self.edges.get, self.reach.get
        for start in range(n):
            hit = get(word[start])
            into[start + 1].append((start, (hit[0],), hit[1]) if hit else (start, self._unknown_ids(word[start]), self.worst))
            for end in range(start + 2, min(start + reach(word[start : start + 2], 0), n) + 1):
                hit = get(word[start:end])
                if hit:
                    into[end].append((start, (hit[0],), hit[1]))
        return into

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(score, ids) of the n best segmentations, best first, equal ones by ids from the last to the first."""
        into = self.arcs(word)
        front = [0.0] + [_LOW] * len(word)
        for end, arcs in enumerate(into):
            for start, _, s in arcs:
                if front[start] + s > front[end]:
                    front[end] = front[start] + s
        # The search tree: a node is a path from its place to the end.
        place, parent, via, cost, children = [len(word)], [-1], [()], [0.0], {}
        levels = {front[-1]: [0]}
        kept = [front[-1]]  # scores of that many different segmentations: what is worse than all of n is not needed
        out: list[tuple[float, tuple[int, ...]]] = []
        while levels and len(out) < n:
            top = max(levels)
            entries = [i for f in list(levels) if f >= top - _NEAR for i in levels.pop(f)]
            if len(entries) > 1:
                # Ids from the end are the tree's preorder with children by ids.
                wanted, entries, walk = set(entries), [], [0]
                while walk and len(entries) < n:
                    node = walk.pop()
                    if node in wanted:
                        entries.append(node)
                    walk += reversed(children.get(node, ()))
            stack = entries[::-1]
            # What follows an entry of this score precedes all others of it, so a stack is the queue.
            while stack and len(out) < n:
                node = stack.pop()
                if place[node] == 0:
                    ids: list[int] = []
                    at = node
                    while at >= 0:
                        ids += via[at]
                        at = parent[at]
                    out.append((cost[node], tuple(ids)))
                    continue
                mine, same = [], []
                for _, start, ids, s in sorted((ids[::-1], start, ids, s) for start, ids, s in into[place[node]]):
                    f = cost[node] + s + front[start]
                    if len(kept) == n and f < kept[0] - _NEAR:
                        continue
                    number = len(place)
                    place.append(start)
                    parent.append(node)
                    via.append(ids)
                    cost.append(cost[node] + s)
                    mine.append(number)
                    if f >= top - _NEAR:
                        same.append(number)
                        if len(same) == 1:
                            continue
                    else:
                        levels.setdefault(f, []).append(number)
                    (heappush if len(kept) < n else heappushpop)(kept, f)
                children[node] = mine
                stack += reversed(same)
        return out

    def two_scores(self, word: str) -> tuple[list[int], float, float]:
        """(best ids, its score, the second best's score), by forward Viterbi with two scores a place."""
        n = len(word)
        get, reach = self.edges.get, self.reach.get
        first, second, back = [0.0] + [_LOW] * n, [_LOW] * (n + 1), [None] * (n + 1)
        for start in range(n):
            a, b = first[start], second[start]
            hit = get(word[start]) or (self._unknown_ids(word[start]), self.worst)
            end, stop = start + 1, min(start + reach(word[start : start + 2], 0), n)
            while True:
                if hit:
                    score = a + hit[1]
                    if score > first[end]:
                        second[end] = max(first[end], b + hit[1])
                        first[end], back[end] = score, (start, hit[0])
                    else:
                        second[end] = max(second[end], score)
                if end >= stop:
                    break
                end += 1
                hit = get(word[start:end])
        if n and first[n] == second[n]:
            return list(self.n_best(word, 1)[0][1]), first[n], second[n]
        ids: list[int] = []
        place = n
        while place:
            place, more = back[place]
            if isinstance(more, int):
                ids.append(more)
            else:
                ids += more[::-1]
        return ids[::-1], first[n], second[n]

    # ------------------------------------------------------------ chains of segments

    def segments_of(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The segments of all words, cut where no piece spans, and each word's first one (n + 1 offsets)."""
        text = "".join(words)
        if not text:
            return [], np.zeros(len(words) + 1, np.int64)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = chars[:-1] << 21 | chars[1:]
        at = np.minimum(np.searchsorted(self.inside, pairs), len(self.inside) - 1)
        border = np.append(True, self.inside[at] != pairs)
        ends = np.cumsum([len(w) for w in words])
        border[ends[:-1]] = True
        begin = np.flatnonzero(border)
        return [text[x:y] for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(text)])], np.searchsorted(begin, np.append(0, ends))

    def solved(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all, their numbers, scores, losses) of many short segments of known characters: the two scores in step for all."""
        count = len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(count), size)
        start = np.arange(len(chars)) - off[owner]
        # Every piece from every place: all walk the trie together, and fewer at each step.
        at, node, length, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0, []
        while len(at):
            key = node << 21 | chars[at + length]
            hit = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[hit] == key
            at, node = at[known], self.to[hit[known]]
            length += 1
            whole = self.piece[node] >= 0
            found.append((at[whole], np.full(int(whole.sum()), length), node[whole]))
            inside = start[at] + length < size[owner[at]]
            at, node = at[inside], node[inside]
        at, length, node = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((length, start[at]))
        at, length, node = at[order], length[order], node[order]
        wide = int(size.max()) + 1
        first, second = np.full(count * wide, _LOW), np.full(count * wide, _LOW)
        piece, back = np.zeros(count * wide, np.int64), np.zeros(count * wide, np.int64)
        first[np.arange(count) * wide] = 0.0
        group = start[at] * wide + length
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(group)]):
            # One start and one length: each segment once.
            begin = owner[at[low:high]] * wide + start[at[low]]
            end, worth = begin + length[low], self.worth[node[low:high]]
            a, b, one = first[begin] + worth, second[begin] + worth, first[end]
            better = a > one
            second[end] = np.where(better, np.maximum(one, b), np.maximum(second[end], a))
            first[end] = np.where(better, a, one)
            won = end[better]
            piece[won], back[won] = self.piece[node[low:high][better]], length[low]
        place, columns = size.copy(), []
        while place.any():
            here = np.arange(count) * wide + place
            columns.append(np.where(place > 0, piece[here], -1))
            place = place - np.where(place > 0, back[here], 0)
        ids = np.stack(columns[::-1], 1)
        last = np.arange(count) * wide + size
        return ids[ids >= 0], (ids >= 0).sum(1), first[last], first[last] - second[last]

    def learn(self, words: list[str]) -> None:
        """Numbers for the segments of words that aren't known yet."""
        cuts, first = self.segments_of(words)
        number = self.number
        fresh = [t for t in set(cuts) if t not in number]
        plain = sorted([t for t in fresh if 1 < len(t) < LONG or t in self.edges], key=len)
        alone = [t for t in fresh if not (1 < len(t) < LONG or t in self.edges)]
        done: list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(0, len(plain), 1 << 14):
            part = plain[k : k + (1 << 14)]
            ids, sizes, score, loss = self.solved(part)
            tied = np.flatnonzero(~(loss > 0)).tolist()
            if tied:  # the rule for equal scores decides
                keep = np.ones(len(part), bool)
                keep[tied] = False
                alone += [part[i] for i in tied]
                ids, sizes, score, loss = ids[np.repeat(keep, sizes)], sizes[keep], score[keep], loss[keep]
                part = [part[i] for i in np.flatnonzero(keep).tolist()]
            done.append((part, ids, sizes, score, loss))
        for text in alone:
            ids, score, second = self.two_scores(text)
            done.append(([text], np.array(ids), np.array([len(ids)]), np.array([score]), np.array([score - second])))
        for part, *_ in done:
            number.update(zip(part, range(len(self.texts), len(self.texts) + len(part))))
            self.texts += part
        if done:
            rows = self.best.add(np.concatenate([x[1] for x in done]), np.concatenate([x[2] for x in done]))
            self.row = np.concatenate([self.row, rows])
            self.score = np.concatenate([self.score, *(x[3] for x in done)])
            self.loss = np.concatenate([self.loss, *(x[4] for x in done)])
        found = array("i", map(number.__getitem__, cuts)).tobytes()
        self.update(zip(words, map(found.__getitem__, map(slice, (4 * first[:-1]).tolist(), (4 * first[1:]).tolist()))))

    def choices(self, segment: int, n: int) -> list[tuple[float, tuple[int, ...], int]]:
        """(what it costs, ids from the last to the first, row) of a segment's n best."""
        found = self.lists.get((segment, n))
        if found is None:
            best = self.n_best(self.texts[segment], n)
            rows = [int(self.row[segment]), *self.best.add(np.concatenate([x[1] for x in best[1:]]), np.array([len(x[1]) for x in best[1:]])).tolist()] if len(best) > 1 else [int(self.row[segment])]
            found = [(best[0][0] - s, ids[::-1], row) for (s, ids), row in zip(best, rows)]
            self.lists[segment, n] = found
        return found

    def chains(self, texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, rank from 0, score) of every text's n best and the rows of ``best`` of all, with their offsets in the last."""
        if len(self) > CACHE or self.best.rows > CACHE or self.best.used > 16 * CACHE:
            self.forget()
        words = [self.words(" " + t.replace(META, " ")) if t else [] for t in texts]
        missing = [w for w in set(itertools.chain.from_iterable(words)) if w not in self]
        self.learn(missing)
        get = self.__getitem__
        raw = [b"".join(map(get, w)) for w in words]
        for w in missing:
            if len(w) >= LONG:
                del self[w]
        sizes = np.array([len(x) // 4 for x in raw], np.int64)
        chain = np.frombuffer(b"".join(raw), np.int32).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        loss, some = self.loss[chain], np.flatnonzero(sizes)
        total = np.zeros(len(texts))
        if len(some):
            total[some] = np.add.reduceat(self.score[chain], first[some])
        ranks, scores, swaps = [1] * len(texts), [[s] for s in total.tolist()], [[[]] for _ in texts]
        owner = np.repeat(np.arange(len(texts)), sizes)
        for d, at in self._cheapest(chain, loss, first, sizes, owner, n).items():
            lists = [self.choices(int(chain[p]), n) for p in at]
            picks = []
            for pick in itertools.product(*(range(len(c)) for c in lists)):
                chosen = [c[k] for c, k in zip(lists, pick)]
                picks.append((sum(c[0] for c in chosen), [c[1] for c in chosen[::-1]], [(p, c[2]) for p, c, k in zip(at, chosen, pick) if k]))
            picks.sort(key=lambda x: x[:2])
            ranks[d] = len(picks[:n])
            scores[d] = [scores[d][0] - x[0] for x in picks[:n]]
            swaps[d] = [x[2] for x in picks[:n]]
        text = np.repeat(np.arange(len(texts)), ranks)
        size = sizes[text]
        off = np.concatenate([[0], np.cumsum(size)])
        rows = self.row[chain[np.repeat(first[text] - off[:-1], size) + np.arange(off[-1])]]
        row = 0
        for d, changes in enumerate(swaps):
            for change in changes:
                for p, new in change:
                    rows[off[row] + p - first[d]] = new
                row += 1
        rank = np.arange(len(text)) - np.repeat(np.cumsum(ranks) - ranks, ranks)
        return text, rank, np.array(list(itertools.chain.from_iterable(scores))), rows, off

    def _cheapest(self, chain: np.ndarray, loss: np.ndarray, first: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n: int) -> dict[int, list[int]]:
        """For each text the places, in order, of the n - 1 segments whose second choice comes first.

        Of equal losses: those whose second choice has the smaller ids from the end, the later ones
        first, then the others, the earlier ones first.
        """
        some = np.flatnonzero(sizes)
        if n < 2 or not len(some):
            return {}
        # The (n - 1)-th smallest loss of each text; only what doesn't exceed it is looked at.
        left = loss.copy()
        bound = np.zeros(len(sizes))
        for _ in range(n - 1):
            low = np.minimum.reduceat(left, first[some])
            bound[some] = low
            hit = np.flatnonzero((left == bound[owner]) & np.isfinite(left))
            fresh = np.append(True, owner[hit][1:] != owner[hit][:-1]) if len(hit) else np.zeros(0, bool)
            left[hit[fresh]] = np.inf
        able = np.flatnonzero((loss <= bound[owner]) & np.isfinite(loss))
        smaller = {s: (c := self.choices(s, n))[1][1] < c[0][1] for s in np.unique(chain[able]).tolist()}
        out: dict[int, list[tuple]] = {}
        for p, d, s, x in zip(able.tolist(), owner[able].tolist(), chain[able].tolist(), loss[able].tolist()):
            out.setdefault(d, []).append((x, 0, -p) if smaller[s] else (x, 1, p))
        return {d: sorted(abs(k[2]) for k in sorted(keys)[: n - 1]) for d, keys in out.items()}

    def segmentations(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """(score, ids as 16-bit bytes) of the text's n best segmentations, best first."""
        _, _, score, rows, off = self.chains([text], n)
        return [(s, self.best.gather(rows[a:b])[0].astype("<u2").tobytes()) for s, a, b in zip(score.tolist(), off, off[1:])]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, pieces spelled out."""
        size = self.size[ids]
        return self.spelled[np.repeat(self.begin[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space put before it."""
        text = self.spell(ids).tobytes().decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, Pieces] = {}


def _pieces(model: str) -> Pieces:
    if model not in _MODELS:
        _MODELS[model] = Pieces(model)
    return _MODELS[model]


def _encode(model: str, best: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for step in text_steps(batches, step=1 << 19):
            texts = [t or "" for t in step.column(1).to_pylist()]
            text, rank, score, rows, off = pieces.chains(texts, best)
            ids, ends = pieces.best.gather(rows)
            begin = ends[off]  # where each segmentation's ids start
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(begin.tolist(), begin[1:].tolist())]
            spelled = pieces.spell(ids)
            place = np.concatenate([[0], np.cumsum(pieces.size[ids])])[begin]
            whole = [(" " + t.replace(META, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
            same = [spelled[a:b].tobytes() == whole[d] for d, a, b in zip(text.tolist(), place.tolist(), place[1:].tolist())]
            columns = [step.column(0).take(pa.array(text)), pa.array(rank + 1, pa.int32()), pa.array(np.diff(begin)), pa.array(score), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            names = ["doc_id", "rank", "n_pieces", "score", "ids_crc32", "round_trip"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, best: int = BEST, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, rank, n_pieces, score, ids_crc32, round_trip and, if asked, ids of the ``best`` segmentations of docs (doc_id, text)."""
    schema = "doc_id long, rank int, n_pieces long, score double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return plain_rows(docs, "doc_id", "text").mapInArrow(_encode(model or default_model(), best, with_ids), schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, rank and text of encoded (doc_id, rank, ids)."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], np.int64)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "rank", "text"])

    return plain_rows(encoded, "doc_id", "rank", "ids").mapInArrow(run, "doc_id long, rank int, text string")


def op6_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every whole text, as digests, and whether they decode to it."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
